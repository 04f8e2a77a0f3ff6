"""Sentences of texts in any language, script and format.

A text is first cut into units (paragraphs, or lines in list and transcript formats); units are cut after
terminators. Whether a full stop ends a sentence is disambiguated by the document itself: a word is an
abbreviation if it occurs elsewhere in the document with a full stop before a small letter or comma, and the
word after it opens a sentence if it opens one at an unambiguous place elsewhere, unless it is a proper name: seen
with a capital within sentences at least as often. Cases that the document leaves open fall back on the rates of the
same evidence over the corpus, counted in one pass and joined by word in Spark. Other rules
go by script: ideographic, danda and Arabic terminators; the Greek question mark; spaces between Thai words.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urdimbre.plans.lineage import cut, table

#: Marks by what they do.
OPENING, CLOSING = "¿¡«“„\"'‘(「『[{（", "»”“\"'’)」』]}）"
CLOSED_BY = {"«": "»", "“": "”", "„": "“”", "(": ")", "「": "」", "『": "』", "[": "]", "（": "）", '"': '"'}
FULL = "。！？।॥؟۔．"
#: Letters that an abbreviation without any other evidence has at most.
SHORT = 5

TERMINATOR = regex.compile(r"[.!?…;\u037e" + FULL + "]+")
QUOTE = regex.compile(r"[«»“”„\"()「」『』\[\]（）]")
#: List marker, time and speaker label at the start of a unit.
LABEL = regex.compile(r"\s*(?:\[?\d{1,2}:\d{2}(?::\d{2})?\]?\s*)?(?:\[\p{L}[^\]\n]{0,30}\]|\p{Lu}[\p{L} ]{0,20}(?:\s-|:)(?=\s)|[-—–•*·]|\d{1,3}[.)]|\p{L}\))?\s*")
#: What stands between a sentence and the next word without belonging to either's words: emoji, marks, markup.
BESIDE = regex.compile(r"(?:\s|<[^<>\s]*>|[\p{So}\p{Sk}\p{Cf}\p{M}️])+")
THAI_GAP = regex.compile(r"(?<=\p{Thai})[^\S\n]+(?=\p{Thai})")
THAI, MARK, SPEAKS, SOLID = (regex.compile(x) for x in (r"\p{Thai}", r"\p{M}", r"[\p{L}\p{N}]", r"\S"))
WORD = regex.compile(r"[\p{L}\p{M}]+")
LINE = regex.compile(r"[\n\f]")
BLANK_LINE = regex.compile(r"\n[^\S\n]*\n\s*|\f")
#: Evidence: where words stand in the document and, counted, in the corpus.
DOT_WITHIN = regex.compile(r"\.(?=[,;:]|[^\S\n]+\p{Ll}(?!\)))")
MARKED = regex.compile(r"[.!?]\s+[¿¡«“„\"(]*(\p{Lu}[\p{L}\p{M}]*)")
OPENER = r"[¿¡«“„\"(]*(\p{Lu}[\p{L}\p{M}]*)"
FIRST, BEGINS = regex.compile(OPENER), regex.compile(r"\n\s*\n\s*" + OPENER)
#: A capital after a small letter; of capitals in a row the second is no evidence.
AMONG = regex.compile(r"\s(?<=\p{Ll},?\s)(\p{Lu}[\p{L}\p{M}]*)(?:,?\s\p{Lu}[\p{L}\p{M}]*)?")
EDGES = regex.compile(r"[^\p{L}\p{M}.]+")
#: A full stop before a capital, and what stands before a place in the text.
BEFORE_CAPITAL = regex.compile(r"\.[»”“\"')\]]*\s+(\p{Lu}[\p{L}\p{M}]*\.?)")
WORDS_BACK, FIGURE_BACK = regex.compile(r"(?r)[\p{L}\p{M}.]+"), regex.compile(r"(?r)\p{N}+")
LETTERS = regex.compile(r"[\p{L}\p{M}]+")


def word_before(text: str, at: int) -> str:
    """Word that ends at a full stop, with the parts of an abbreviation before it; empty if none does."""
    found = WORDS_BACK.match(text, 0, at)
    return found.group().rsplit("..", 1)[-1].lstrip(".") if found and found.group()[-1] != "." else ""


def dotted(text: str) -> list[str]:
    """Words with a full stop before a small letter or a comma."""
    return [w for m in DOT_WITHIN.finditer(text) if (w := word_before(text, m.start()))]


def opens(text: str) -> list[str]:
    """Words that surely open a sentence: at the start, after a blank line, and after a mark that closes a long word or isn't a full stop."""
    first = FIRST.match(text)
    out = [first.group(1), *BEGINS.findall(text, first.end())] if first else BEGINS.findall(text)
    for m in MARKED.finditer(text):
        i = m.start()
        if text[i] != "." and i and (text[i - 1].isalnum() or MARK.match(text, i - 1)) or i >= 6 and LETTERS.fullmatch(text, i - 6, i):
            out.append(m.group(1))
    return out


def bare(text: str) -> list[str]:
    """Words without a full stop beside them."""
    return [t for t in EDGES.split(text) if t and "." not in t]


def cases(text: str) -> set[tuple[str, str]]:
    """A short word, known abbreviation or figure (``0``) with a full stop before a capital, and that word (with its own full stop, if any)."""
    out = set()
    for m in BEFORE_CAPITAL.finditer(text):
        w = word_before(text, m.start()) or ("0" if FIGURE_BACK.match(text, 0, m.start()) else "")
        if w:
            out.add((w, m.group(1)))
    return out


IN_DOCUMENT = {"dotted": dotted, "opens": opens, "among": AMONG.findall, "bare": bare}
#: Times that a word opens sentences, of the times that it is seen with a capital, under which it is no opening.
RARELY = 0.1


def _cases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open cases of each document."""
    for b in batches:
        ids, first, then = [], [], []
        for key, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
            for w, n in cases(text):
                ids.append(key), first.append(w), then.append(n)
        yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field("doc_id").type), pa.array(first, pa.string()), pa.array(then, pa.string())], names=["doc_id", "w", "n"])


def open_cases(docs: DataFrame) -> DataFrame:
    """``doc_id, w, n`` of documents without null texts."""
    return docs.select("doc_id", "text").mapInArrow(_cases, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, w string, n string")


def _evidence(words) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = words.value
        for b in batches:
            counts: dict[str, Counter] = {k: Counter() for k in IN_DOCUMENT}
            tokens: Counter = Counter()
            for text in b.column("text").to_pylist():
                for k in ("dotted", "opens", "among"):
                    counts[k].update(IN_DOCUMENT[k](text))
                tokens.update(text.split())
            for token, n in tokens.items():  # what parts tokens parts words too
                for w in bare(token):
                    counts["bare"][w] += n
            seen = [w for w in set().union(*counts.values()) if wanted is None or w in wanted]
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.string()), *(pa.array([counts[k][w] for w in seen], pa.int64()) for k in IN_DOCUMENT)], names=["word", *IN_DOCUMENT])

    return run


#: Distinct words of open cases that are sent to every task at most; with more, all words of the corpus are counted.
SENT = 200_000


def evidence(docs: DataFrame, words: DataFrame) -> DataFrame:
    """``word, dotted, opens, among, bare``: how often the corpus has each of ``words`` in each unambiguous place, counted in one pass."""
    few = words.limit(SENT + 1).count() <= SENT
    sent = docs.sparkSession.sparkContext.broadcast({r[0] for r in words.collect()} if few else None)
    counts = docs.select("text").mapInArrow(_evidence(sent), "word string, " + ", ".join(f"{k} bigint" for k in IN_DOCUMENT))
    return counts.groupBy("word").agg(*(F.sum(k).alias(k) for k in IN_DOCUMENT))


def kept_together(docs: DataFrame) -> DataFrame:
    """``doc_id, juntas``: the pairs ``w n`` of a document that the corpus holds for no end of a sentence."""
    cases = cut(open_cases(docs))
    names = cases.select("w", "n").distinct().withColumn("name", F.rtrim("n", F.lit(".")))
    words = cut(names.select(F.col("w").alias("word")).union(names.select("name")).distinct())
    seen = cut(evidence(docs, words))
    pairs = (
        names.join(seen.select(F.col("word").alias("w"), "dotted", "bare"), "w", "left").join(seen.select(F.col("word").alias("name"), "opens", "among"), "name", "left")
        .na.fill(0, ["dotted", "bare", "opens", "among"])
    )
    # Hardly ever seen without full stop, and before another abbreviation.
    never_bare = (F.col("bare") <= RARELY * F.col("dotted")) & (F.length("w") <= SHORT) & F.col("n").endswith(".") & (F.length("n") <= SHORT)
    shortened = (2 * F.col("dotted") > F.col("bare")) | never_bare
    no_opening = F.col("opens") <= RARELY * (F.col("opens") + F.col("among"))
    together = no_opening & F.when(F.col("w") == "0", F.col("among") > 0).otherwise(shortened)
    return cases.join(pairs.where(together).select("w", "n"), ["w", "n"]).groupBy("doc_id").agg(F.collect_set(F.concat_ws(" ", "w", "n")).alias("juntas"))


class Document:
    """One text being cut; ``together`` holds the pairs that the corpus keeps together."""

    def __init__(self, text: str, form: str | None, together: list[str] | None):
        self.text, self.form, self.together = text, (form or "").strip().lower(), set(together or ())
        self.known: dict[str, Counter] = {}
        self.thai = bool(THAI.search(text))

    def seen(self, kind: str, word: str) -> int:
        if kind not in self.known:
            self.known[kind] = Counter(IN_DOCUMENT[kind](self.text))
        return self.known[kind][word]

    def shortened(self, word: str) -> bool:
        dotted_ = self.seen("dotted", word)
        return dotted_ > 0 and 2 * dotted_ > self.seen("bare", word)

    def spans(self) -> list[tuple[int, int]]:
        parts = LINE if self.form in ("lista", "transcripcion") else BLANK_LINE
        out: list[tuple[int, int]] = []
        at = 0
        for m in parts.finditer(self.text):
            to, after = m.span()
            self.unit(at, to, out)
            at = after
        self.unit(at, len(self.text), out)
        return out

    def unit(self, start: int, end: int, out: list[tuple[int, int]]) -> None:
        """Adds the sentences of a unit to ``out``."""
        text = self.text
        if not self.thai and not TERMINATOR.search(text, start, end):
            self.trimmed(start, end, out)
            return
        label = LABEL.match(text, start, end).end()
        ends = [(m.start(), m.end(), False) for m in TERMINATOR.finditer(text, label, end)]
        if self.thai:
            ends = sorted(ends + [(m.start(), m.end(), True) for m in THAI_GAP.finditer(text, label, end)])
        if not ends:
            self.trimmed(start, end, out)
            return
        opened, closed = self.pairs(start, end)
        begins = set(opened)
        at = start
        for a, b, gap in ends:
            if a < at:
                continue
            k = bisect_left(opened, a) - 1  # outermost pairs don't overlap
            around = (opened[k], closed[k]) if k >= 0 and closed[k] > a else None
            if gap:
                to = a if not around else None
            elif around:
                to = around[1] + 1 if not text[b : around[1]].strip() else None
            else:
                to = b
            if to is None:
                continue
            if not gap:
                while to < end and text[to] in CLOSING and to not in begins:
                    to += 1
                if to < end and SOLID.search(text, to, end) and not self.ends(text, a, b, to, end, max(at, label), around):
                    continue
            self.trimmed(at, to, out)
            at = to
        self.trimmed(at, end, out)

    def trimmed(self, start: int, end: int, out: list[tuple[int, int]]) -> None:
        text = self.text
        while start < end and text[start].isspace():
            start += 1
        while start < end and text[end - 1].isspace():
            end -= 1
        if start < end:
            out.append((start, end))

    def pairs(self, start: int, end: int) -> tuple[list[int], list[int]]:
        """Opening and closing places of the outermost closed quotations and brackets of a unit, in order."""
        open_: list[int] = []
        opened: list[int] = []
        closed: list[int] = []
        text = self.text
        for m in QUOTE.finditer(text, start, end):
            q, i = m.group(), m.start()
            match = next((k for k in range(len(open_) - 1, -1, -1) if q in CLOSED_BY[text[open_[k]]]), None)
            if match is not None:
                o = open_[match]
                del open_[match:]
                while opened and opened[-1] > o:  # those within the new pair
                    opened.pop(), closed.pop()
                opened.append(o), closed.append(i)
            elif q in CLOSED_BY and (q != '"' or i == start or not text[i - 1].isalnum()):
                open_.append(i)
        return opened, closed

    def ends(self, text: str, a: int, b: int, to: int, end: int, start: int, around: tuple[int, int] | None) -> bool:
        """Whether the terminator at ``a:b``, closed at ``to``, ends the sentence begun at ``start``."""
        mark, gap = text[b - 1], text[to].isspace()
        if text[to] == " " and to + 1 < end and text[to + 1].isalnum():
            at = to + 1
        else:
            beside = BESIDE.match(text, to, end)
            at = beside.end() if beside else to
        if at >= end:
            return False
        following = text[at]
        while at < end and text[at] in OPENING:
            at += 1
        opened, first = text[at] is not following, text[at] if at < end else ""
        if following in ",;:)]}»”’—–-/…%" or first.islower():
            return False
        if around:
            introduced = bool(SPEAKS.search(text, start, around[0])) if around[0] > start else False
            return introduced if first.isalpha() and not first.isupper() else True
        if mark in FULL:
            return True
        if mark in ";\u037e":
            return mark == "\u037e" or _script(self.letter(start, a)) == "Greek"
        if text[a:b].count(".") > 1 or "…" in text[a:b]:
            return first.isupper()
        if mark in "!?":
            return True
        if not gap and to == b:
            before = text[a - 2 : a]
            return first.isupper() and not opened and (before.islower() and before.isalpha() or before[-1:].isdigit() or before[-1:] in "%)")
        if _script(self.letter(start, a)) in ("Devanagari", "Thai"):
            return False
        i = a
        while i > start and (text[i - 1] in ".·" or text[i - 1].isalnum() or MARK.match(text, i - 1)):
            i -= 1
        word = text[i:a]
        figure = word[-1:].isdigit()
        if first.isdigit():
            return figure or len(word) >= SHORT and not self.shortened(word)
        if opened or not first.isupper():
            return True
        name = WORD.match(text, at).group()
        key = "0" if figure else word
        held = not figure and self.shortened(word) or self.together and (f"{key} {name}" in self.together or f"{key} {name}." in self.together)
        return not held or self.opening(name)

    def letter(self, start: int, end: int) -> str:
        """Last letter of a stretch; empty if it has none."""
        i = end - 1
        while i >= start and not self.text[i].isalpha():
            i -= 1
        return self.text[i] if i >= start else ""

    def opening(self, name: str) -> bool:
        """Whether a word opens a sentence elsewhere in the document and isn't a proper name of it."""
        n = self.seen("opens", name)
        return n > 0 and n > self.seen("among", name)


SCRIPTS = {name: regex.compile(rf"\p{{{name}}}") for name in ("Greek", "Devanagari", "Thai")}


def _script(letter: str) -> str:
    if letter < "\u0370":
        return ""
    return next((name for name, own in SCRIPTS.items() if own.match(letter)), "")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, starts, ends = [], [], []
        for key, text, form, together in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "formato", "juntas"))):
            for start, end in Document(text, form, together).spans():
                ids.append(key)
                starts.append(start)
                ends.append(end)
        yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field("doc_id").type), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["doc_id", "inicio", "fin"])


def sentences(docs: DataFrame) -> DataFrame:
    """``doc_id, inicio, fin`` of every sentence of ``docs`` (``doc_id, text, formato``), in characters from 0.

    Null, empty and blank texts have no sentence; a null or unknown ``formato`` counts as prosa; rows that come
    more than once come out as often. Documents with a null id use only their own evidence.
    """
    rows = docs.select("doc_id", "text", "formato").where("text is not null")
    return (
        rows.join(kept_together(rows), "doc_id", "left")
        .mapInArrow(_cut, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, inicio int, fin int")
    )


def p8_found(spark, folder: str) -> DataFrame:
    """Sentences of every document."""
    return sentences(table(spark, folder, "documents"))


SQL: dict[str, str] = {}
QUERIES: dict[str, Callable] = {"p8_found": p8_found}
