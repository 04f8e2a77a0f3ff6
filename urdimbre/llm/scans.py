"""Text of scanned pages repaired into continuous paragraphs.

Page furniture. Lines among the first or last two of a page that look like a title or a page number are grouped
by a key that misreadings don't change (characters that look alike are one). A title is a running line if its
key repeats at the edges of pages and is almost never seen in their middle; a page number is one if the style
and the distance to the number of the page repeat in the document.

Divided words. A text line that ends in a hyphen goes on in the next text line, which furniture or the end of
the page may part from it; a hyphen stays if the hyphenated word is the commoner one elsewhere.

Misread words. The vocabulary holds the words of clean texts and those that pages repeat. Words outside it are
looked up with Levenshtein automata intersected with a trie of the vocabulary (``automaton``): every word within two
insertions, deletions, substitutions or look-alike pairs is found. Which edits scanners make is learnt from the data: an
edit is systematic if it explains a fair share of the words that it could happen to. Candidates are ranked by their
count, how often their edits happen, and the words beside them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from urdimbre.llm.automaton import Trie, scripts
from urdimbre.operators.sequences import running_sum
from urdimbre.plans.lineage import cut, table

#: Words that stand beside a page number.
PAGE_WORDS = ("página", "page", "seite", "pagina", "pág", "pag", "p", "s", "pg", "folio", "hoja", "blatt")
OF_WORDS = ("de", "of", "von", "sur", "di")
HYPHENS = "-‐\xad¬"
#: Words with signs or figures among letters, which no right word has.
ODD = regex.compile(r"[@\\ﬁﬂ]|(?<=\p{L})\p{N}|\p{N}(?=\p{L})")
#: Times that clean texts have a word which isn't misread, and that pages have a word which may be the right one.
BLESSED, PAGED = 3, 5
#: Share of all clean words from which a word is looked up in each task, so at most 200,000 are; rarer ones are joined.
COMMON = 5e-6
#: A misread word is seen at most this share of the times of the right one.
RARER = 0.1
#: Share of the words it could happen to that a systematic edit is seen in; words that are added to them against chance; times a word is seen to count.
SYSTEMATIC, SMOOTH, SEEN = 0.01, 20, 10
#: Vocabulary words in the trie of a task, and words that walk it.
SLICE, WALKED = 200_000, 20_000
EDGE = 2

WORD = re.compile(r"(?:[\w@]+|\\/)+(?:-(?:[\w@]+|\\/)+)*")
TOKEN = re.compile(r"[\w@|]+")
DIVIDED = re.compile(r"((?:[\w@]+|\\/)+)([-‐\xad¬])\s*$")
JOINED = re.compile(r"(?<=\w)[‐\xad¬]\s*\n\s*(?=[^\WA-ZÀ-Þ]|@)")
#: Word parts at the end and start of lines of which it isn't known whose the hyphen is.
UNSURE = re.compile(r"[\w@]+-\s*\n\s*[\w@-]+")
PUNCTUATION = ".,;:!?¡¿…()[]{}«»\"“”„'‘’—–|·%°"
OPENING = regex.compile(r"^\s*((?:[\p{Ll}\p{M}\p{N}@]|\\/)(?:[\p{L}\p{M}\p{N}@]|\\/|(?<=\p{L})-(?=\p{L}))*)")
DIGITS = str.maketrans({"l": "1", "I": "1", "i": "1", "|": "1", "o": "0", "O": "0", "S": "5", "s": "5", "B": "6", "b": "6", "z": "2", "Z": "2", "g": "9", "q": "9", "é": "6", "ó": "6"})
ALIKE = str.maketrans({"6": "b", "h": "b", "0": "b", "o": "b", "ó": "b", "é": "c", "1": "i", "l": "i", "í": "i", "|": "i", "5": "s", "2": "z", "9": "g", "q": "g", "@": "a", "e": "c", "u": "n", "f": "t"})


def shape(text: str) -> str:
    """Key of a text: lower case, characters that are misread for one another made one, then those read as two."""
    text = text.lower().replace("\\/", "v").replace("ﬁ", "fi").translate(ALIKE)
    return text.replace("rn", "m").replace("ci", "d").replace("vv", "w")


def division(line: str) -> re.Match | None:
    """The word part and hyphen that a line ends in; only its last word is looked at."""
    own = line.rstrip()
    return DIVIDED.search(line, own.rfind(" ") + 1) if own[-1:] in HYPHENS else None


NO_END, NO_START, NUMERALS = ".,;:!?»”\"" + HYPHENS, "«„\"(¿¡", "0123456789lIiOovVxX|"
PAGE_SHAPES, OF_SHAPES = {shape(w) for w in PAGE_WORDS}, {shape(w) for w in OF_WORDS}


def title_words(line: str) -> list[str] | None:
    """Words of a line that looks like a title, numbers and their marks left out."""
    line = line.strip()
    if not line or line[-1] in NO_END or line[0] in NO_START or line[0].islower() and line[0] != "l" and not line[1:6].isupper() or "%" in line:
        return None
    words = [w for w in TOKEN.findall(line) if w.strip(NUMERALS)]
    if not words or sum(map(len, words)) < 4 or not (words[0][0].isupper() or words[0][0] in "l105269@" or words[0][1:].isupper()):
        return None
    return words


def title_key(line: str) -> str | None:
    """Key of a line that looks like a title: its words by shape."""
    words = title_words(line)
    return words and shape(" ".join(words))


#: Roman numerals; the small ones are taken in any order, as scanners misread them.
NUMERAL = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
ROMAN = regex.compile(r"[ivxl]+|m*(?:c[dm]|d?c{0,3})(?:x[cl]|l?x{0,3})(?:i[xv]|v?i{0,3})")
#: Digits that a number surely holds; numbers above the second are page numbers only where they keep their distance to the page.
BIGINT, FEW = 18, 99_999
#: Up to four words without the signs that don't stand by page numbers; it ends at the fifth word, however long the line.
NUMBER_LIKE = re.compile(r"[^\w@|%,°:\"?!¿¡«»]*+(?:[\w@|]++[^\w@|%,°:\"?!¿¡«»]*+){1,4}")


def page_number(line: str) -> tuple[str, int] | None:
    """Style and value of a line that holds only a page number, with or without words and marks around it."""
    own = line.strip()
    if not own or own[-1] in ".:;!?\"" or not NUMBER_LIKE.fullmatch(own):
        return None
    words = TOKEN.findall(own)
    named = len(words) > 1 and shape(words[0]) in PAGE_SHAPES
    words = words[named:]
    numbers = [w for w in words if shape(w) not in OF_SHAPES]
    if not 1 <= len(numbers) <= 2 or len(words) > 3:
        return None
    if own == numbers[0] and (own.islower() or own.isupper()) and ROMAN.fullmatch(own.lower()) and set(own) != {"l"}:
        value, before = 0, 0
        for c in reversed(own.lower()):
            n = NUMERAL[c]
            value += n if n >= before else -n
            before = max(before, n)
        return "roman", value
    values = [w.translate(DIGITS) for w in numbers]
    if not all(v.isascii() and v.isdigit() for v in values) or len(values[0].lstrip("0")) > BIGINT or own == numbers[0] and not any(c.isdigit() or c == "l" for c in own):
        return None
    if not named and not any(c.isdigit() for c in own) and not regex.fullmatch(r"\W*[lIi|oO]+\W*", own):
        return None
    return regex.sub(r"\s+", " ", regex.sub(r"[^\W_]+|@", "9", own)), int(values[0].lstrip("0") or "0")


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines that look like furniture, and where."""
    for b in batches:
        out: list[tuple] = []
        for doc, number, text in zip(*(b.column(c).to_pylist() for c in ("documento_id", "numero", "texto"))):
            lines = (text or "").split("\n")
            full = [i for i, x in enumerate(lines) if x.strip()]
            edge = {*full[:EDGE], *full[-EDGE:]}
            width = max((len(lines[i]) for i in full if i not in edge), default=0)
            for i in full:
                page = page_number(lines[i]) if i in edge else None
                key = None if page else title_key(lines[i])
                if page or key:
                    filled = 0.85 * width <= len(lines[i].rstrip()) <= 1.1 * width  # as a line of running text is
                    out.append((doc, number, i, i in edge, key, *(page or (None, None)), not filled))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 8, (pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.bool_()))], names=["documento_id", "numero", "linea", "borde", "clave", "estilo", "valor", "suelta"])


def furniture(pages: DataFrame) -> DataFrame:
    """``documento_id, numero, linea, tipo`` of running lines (cabecera) and page numbers (folio) of distinct pages."""
    seen = cut(pages.select("documento_id", "numero", "texto").mapInArrow(_edges, "documento_id string, numero int, linea int, borde boolean, clave string, estilo string, valor bigint, suelta boolean"))
    titles = seen.where("clave is not null")
    by_doc = titles.groupBy("documento_id", "clave").agg(F.count(F.when(F.col("borde"), 1)).alias("bordes"), F.count(F.when(~F.col("borde"), 1)).alias("dentro"), F.min("suelta").alias("suelta"))
    running = (
        by_doc.groupBy("clave").agg(F.sum("bordes").alias("bordes"), F.sum("dentro").alias("dentro"), F.max("bordes").alias("repetida"), F.min("suelta").alias("suelta"))
        .where("repetida >= 2 and (repetida >= 3 or bordes >= 4 or suelta) and dentro <= 0.1 * bordes").select("clave")
    )
    heads = titles.where("borde").join(running, "clave", "left_semi").select("documento_id", "numero", "linea", F.lit("cabecera").alias("tipo"))
    numbers = seen.where("estilo is not null").withColumn("paso", F.col("valor") - F.col("numero"))
    kept = numbers.groupBy("documento_id", "estilo", "paso").agg(F.count_distinct("numero").alias("n"))
    # A style with words or marks is one by itself; a bare number must keep its distance to the page on several, nearly:
    # blank pages aren't always counted.
    near = Window.partitionBy("documento_id", "estilo").orderBy("paso").rangeBetween(-2, 2)
    known = numbers.join(kept.withColumn("cerca", F.sum("n").over(near)), ["documento_id", "estilo", "paso"])
    bare = F.col("estilo").isin("9", "roman")
    first = (F.col("paso") == 0) | (F.col("estilo") == "roman") & F.col("paso").between(-3, 0)
    folios = known.where(~bare & (F.col("valor") <= FEW) | (F.col("cerca") >= 2) | first).select("documento_id", "numero", "linea", F.lit("folio").alias("tipo"))
    return heads.union(folios).distinct()


def distinct_pages(pages: DataFrame) -> DataFrame:
    """One row per page (of differing copies the longest text, ties the smallest); pages without document, number or text are left out."""
    rows = pages.select("documento_id", F.col("numero").cast("int").alias("numero"), "texto").where("documento_id is not null and numero is not null and texto is not null")
    return rows.groupBy("documento_id", "numero").agg(F.max_by("texto", F.struct(F.length("texto"), F.xxhash64("texto"))).alias("texto"))


def marked(pages: DataFrame, found: DataFrame) -> DataFrame:
    """Pages with the numbers of their furniture lines as array ``fuera``."""
    lines = found.groupBy("documento_id", "numero").agg(F.collect_set("linea").alias("fuera"))
    return pages.join(lines, ["documento_id", "numero"], "left").withColumn("fuera", F.coalesce("fuera", F.array().cast("array<int>")))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the words of the text lines of a batch, divided words as one."""
    for b in batches:
        raw: Counter = Counter()
        for text, out in zip(b.column("texto").to_pylist(), b.column("fuera").to_pylist()):
            text = text or ""
            if out:
                skip = set(out)
                text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in skip)
            if "\n" in text:
                text = UNSURE.sub(" ", JOINED.sub("", text))
            raw.update(text.lower().split())
        count: Counter = Counter()
        for token, n in raw.items():
            for w in WORD.findall(token):
                count[w] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["palabra", "n"])


def word_counts(rows: DataFrame) -> DataFrame:
    """``palabra, n`` of rows ``texto, fuera``."""
    return rows.select("texto", "fuera").mapInArrow(_words, "palabra string, n bigint").groupBy("palabra").agg(F.sum("n").alias("n"))


def vocabulary(pages: DataFrame, clean: DataFrame | None) -> DataFrame:
    """``palabra, n, c``: how often marked pages and clean texts (``texto``) have each word with a letter."""
    paged = word_counts(pages).withColumn("c", F.lit(0).cast("bigint"))
    if clean is not None:
        told = word_counts(clean.select("texto", F.array().cast("array<int>").alias("fuera")))
        paged = paged.union(told.select("palabra", F.lit(0).cast("bigint"), F.col("n")))
    return paged.groupBy("palabra").agg(F.sum("n").alias("n"), F.sum("c").alias("c")).where(F.col("palabra").rlike(r"[\p{L}@]"))


def _retrieve(unknown: pa.Table, known: pa.Table) -> pa.Table:
    """Pairs of a word and a vocabulary word that it may be a misreading of, with the edits between them."""
    words, times = unknown.column("palabra").to_pylist(), unknown.column("n").to_numpy()
    trie = Trie(known.column("palabra").to_pylist())
    counts = dict(zip(known.column("palabra").to_pylist(), known.column("n").to_pylist()))
    of = np.array([counts[w] for w in trie.words], np.int64)
    most = np.array([1.0 if ODD.search(w) else RARER for w in words])
    out: list[tuple] = []
    for q, w, edits in trie.within(words):
        keep = (edits > 0) & (times[q] <= of[w] * most[q])
        for a, b, e in zip(q[keep].tolist(), w[keep].tolist(), edits[keep].tolist()):
            out.append((words[a], trie.words[b], int(of[b]), e, scripts(trie.words[b], words[a], e)))
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.list_(pa.list_(pa.string()))))], names=["palabra", "correcta", "veces", "ediciones", "guiones"])


def retrieved(unknown: DataFrame, known: DataFrame) -> DataFrame:
    """``palabra, correcta, veces, ediciones, guiones``: for each distinct word ``palabra, n`` every vocabulary word ``palabra, n``
    that is at most two edits away and common enough, with all shortest ways from it to the word.

    The vocabulary is cut into tries of about ``SLICE`` words and the words into blocks; each task walks one block down one trie.
    """
    slices = 1 + known.count() // SLICE
    many = unknown.count()
    blocks = max(1 + many // WALKED, min(unknown.sparkSession.sparkContext.defaultParallelism, 1 + many // 500))
    # Both sides need keys of one type: equal numbers of two types are hashed to different tasks and don't meet.
    own = lambda n: F.pmod(F.xxhash64("palabra"), F.lit(n)).cast("int")
    each = unknown.select("palabra", "n", own(blocks).alias("bloque"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("tramo"))
    words = known.select("palabra", "n", own(slices).alias("tramo"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("bloque"))
    return each.groupBy("bloque", "tramo").cogroup(words.groupBy("bloque", "tramo")).applyInArrow(_retrieve, "palabra string, correcta string, veces bigint, ediciones int, guiones array<array<string>>")


def edit_rates(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """``edicion, tasa`` of the systematic edits: the share of the words having its right part that are seen with it.

    Learnt from words one edit from the vocabulary; a word with several such candidates counts for each in part.
    """
    one = pairs.where("ediciones = 1")
    share = one.join(one.groupBy("palabra").agg((1 / F.count("*")).alias("parte")), "palabra")
    held = share.select("correcta", "parte", F.explode(F.flatten("guiones")).alias("edicion")).groupBy("edicion", "correcta").agg(F.max("parte").alias("parte"))
    seen = held.groupBy("edicion").agg(F.sum("parte").alias("vistas")).withColumn("de", F.substring_index("edicion", ">", 1))
    places = F.transform(F.sequence(F.lit(1), F.length("palabra")), lambda i: F.array(F.substring(F.col("palabra"), i, F.lit(1)), F.substring(F.col("palabra"), i, F.lit(2))))
    parts = F.explode(F.array_distinct(F.concat(F.array(F.lit("")), F.flatten(places)))).alias("de")
    could = known.where(F.col("n") >= SEEN).select(parts).groupBy("de").agg(F.count("*").alias("posibles"))
    rate = F.col("vistas") / (F.col("posibles") + SMOOTH)
    return seen.join(could, "de").select("edicion", rate.alias("tasa")).where(F.col("tasa") >= SYSTEMATIC)


def candidates(unknown: DataFrame, known: DataFrame) -> DataFrame:
    """``palabra, correcta, puntos``: all that each distinct word ``palabra, n`` may be a misreading of by systematic edits.

    A word with hyphens is misread if one of its parts is and the others are known; it has one candidate, of the likeliest parts.
    """
    inner = unknown.where("instr(palabra, '-') > 0").select("palabra", "n", F.posexplode(F.split("palabra", "-")).alias("k", "parte"))
    parts = inner.groupBy(F.col("parte").alias("palabra")).agg(F.sum("n").alias("n")).join(known.select("palabra"), "palabra", "left_anti").where("palabra <> ''")
    whole = unknown.where("instr(palabra, '-') = 0").select("palabra", "n")
    words = cut(whole.union(parts).groupBy("palabra").agg(F.sum("n").alias("n")))
    pairs = cut(retrieved(words, known))
    rates = edit_rates(pairs, known)
    ways = pairs.select("palabra", "correcta", "veces", F.posexplode("guiones").alias("g", "guion"))
    costs = ways.select("*", F.explode("guion").alias("edicion")).join(rates, "edicion").groupBy("palabra", "correcta", "veces", "g").agg(F.first(F.size("guion")).alias("todas"), F.count("*").alias("sabidas"), F.sum(F.log("tasa")).alias("peso"))
    scored = costs.where("sabidas = todas").groupBy("palabra", "correcta").agg((F.max("peso") + F.log(F.first("veces"))).alias("puntos"))
    scored = cut(scored)
    best = scored.groupBy(F.col("palabra").alias("parte")).agg(F.max_by("correcta", F.struct("puntos", "correcta")).alias("correcta"))
    known_part = known.select(F.col("palabra").alias("parte"), F.lit(True).alias("sabida"))
    mended = (
        inner.join(known_part, "parte", "left").join(best, "parte", "left").withColumn("buena", F.when(F.col("sabida"), F.col("parte")).otherwise(F.col("correcta")))
        .groupBy("palabra").agg(F.array_sort(F.collect_list(F.struct("k", "buena"))).alias("ps"), F.count_if(F.col("buena").isNull()).alias("faltan"))
        .where("faltan = 0").select("palabra", F.array_join(F.transform("ps", lambda p: p["buena"]), "-").alias("correcta"), F.lit(0.0).alias("puntos")).where("palabra <> correcta")
    )
    return scored.join(whole.select("palabra"), "palabra", "left_semi").union(mended)


def _seams(trusted) -> Callable:
    """Words outside the trusted ones with their lines, and hyphens at the end of text lines.

    ``clase``: palabra (a word, with those beside it), guion (a division within the page, the word joined), cola and cabeza (the last
    text line of the page ends in a division; the first word of its first text line)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good = trusted.value
        for b in batches:
            out: list[tuple] = []
            fine: dict[str, bool] = {}  # by token as it stands, whether it is a trusted word
            for doc, number, text, furniture in zip(*(b.column(c).to_pylist() for c in ("documento_id", "numero", "texto", "fuera"))):
                skip = set(furniture or ())
                lines = [(i, x) for i, x in enumerate(text.split("\n")) if i not in skip and x.strip()]
                here = set(text.lower().split())
                for t in here - fine.keys():
                    fine[t] = t.strip(PUNCTUATION) in good
                odd = [t for t in here if not fine[t]]
                tail = None
                for k, (i, line) in enumerate(lines):
                    start, end = 0, len(line)
                    opening = OPENING.match(line) if tail or k == 0 else None
                    if opening and not any(c.isalpha() or c == "@" for c in opening.group(1)):
                        opening = None
                    beyond = next(iter(line[opening.end() :].lower().split()), "").strip(PUNCTUATION) if opening else ""
                    if k == 0 and opening:
                        out.append((doc, number, "cabeza", i, i, opening.group(1), "", "", "", beyond))
                    if tail and opening:
                        out.append((doc, number, "guion", tail[0], i, tail[1], opening.group(1), *tail[2:], beyond))
                        start = opening.end()
                    divided = division(line)
                    tail = None
                    if divided:
                        end = divided.start()
                        ahead = line[:end].lower().rsplit(None, 1)
                        tail = (i, divided.group(1), divided.group(2), ahead[-1].strip(PUNCTUATION) if ahead else "")
                    body = line[start:end].lower()
                    tokens = body.split() if any(t in body for t in odd) or start else ()
                    for at, token in enumerate(tokens):
                        if not fine.get(token) and token.strip(PUNCTUATION) not in good:
                            for w in WORD.findall(token):
                                if w not in good and any(c.isalpha() or c == "@" for c in w):
                                    beside = (tokens[j].strip(PUNCTUATION) if 0 <= j < len(tokens) else "" for j in (at - 1, at + 1))
                                    out.append((doc, number, "palabra", i, i, w, "", "", *beside))
                if tail:
                    out.append((doc, number, "cola", tail[0], tail[0], tail[1], "", *tail[2:], ""))
            kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), *[pa.string()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 10, kinds)], names=["documento_id", "numero", "clase", "linea", "siguiente", "a", "b", "signo", "antes", "despues"])

    return run


SEAMS = "documento_id string, numero int, clase string, linea int, siguiente int, a string, b string, signo string, antes string, despues string"
#: Weight of the words beside a correction.
BESIDE = 1.5
#: Pages of a document looked over in one task; what follows the last of them is looked up apart.
STRETCH = 1000


def following(pages: DataFrame) -> DataFrame:
    """``documento_id, numero, despues``: the next page of the document that has text lines."""
    full = pages.select("documento_id", "numero", F.floor(F.col("numero") / STRETCH).alias("tramo"))
    firsts = full.groupBy("documento_id", "tramo").agg(F.min("numero").alias("primera"))
    firsts = firsts.select("documento_id", "tramo", F.lead("primera").over(Window.partitionBy("documento_id").orderBy("tramo")).alias("luego"))
    own = F.lead("numero").over(Window.partitionBy("documento_id", "tramo").orderBy("numero"))
    return full.withColumn("propia", own).join(firsts, ["documento_id", "tramo"]).select("documento_id", "numero", F.coalesce("propia", "luego").alias("despues"))


def noise(pages: DataFrame, clean: DataFrame | None) -> dict[str, DataFrame]:
    """What is wrong with the distinct ``pages``.

    ``lineas``: documento_id, numero, linea, tipo (cabecera, folio, guion, caracter). ``divididas``: the divided words,
    with the page and line that each goes on in. ``palabras``: documento_id, numero, linea, palabra, correcta of misread words.
    """
    spark = pages.sparkSession
    found = cut(furniture(pages))
    page = cut(marked(pages, found))
    counts = cut(vocabulary(page, clean))
    blessed = counts.where(F.col("c") >= BLESSED).select("palabra")
    lexicon = counts.where((F.col("c") >= BLESSED) | (F.col("n") >= PAGED)).select("palabra", (F.col("n") + F.col("c")).alias("n"))
    total = counts.agg(F.sum("c")).first()[0] or 0
    # At most 1 / COMMON words; the others are told apart by a join.
    trusted = spark.sparkContext.broadcast({r["palabra"] for r in counts.where(F.col("c") >= max(BLESSED, COMMON * total)).select("palabra").collect()})
    seams = cut(page.mapInArrow(_seams(trusted), SEAMS))
    over = (
        seams.where("clase = 'cola'").join(following(seams_pages(page)).withColumnRenamed("despues", "luego"), ["documento_id", "numero"])
        .join(seams.where("clase = 'cabeza'").select("documento_id", F.col("numero").alias("luego"), F.col("linea").alias("l"), F.col("a").alias("inicio"), F.col("despues").alias("tras")), ["documento_id", "luego"])
        .select("documento_id", "numero", F.col("luego").alias("pagina"), "linea", F.col("l").alias("siguiente"), "a", F.col("inicio").alias("b"), "signo", "antes", F.col("tras").alias("despues"))
    )
    within = seams.where("clase = 'guion'").select("documento_id", "numero", F.col("numero").alias("pagina"), "linea", "siguiente", "a", "b", "signo", "antes", "despues")
    divided = within.union(over).withColumn("junta", F.lower(F.concat("a", "b"))).withColumn("compuesta", F.lower(F.concat("a", F.lit("-"), "b")))
    seen = lambda c, name: lexicon.select(F.col("palabra").alias(c), F.col("n").alias(name))
    divided = divided.join(seen("junta", "nj"), "junta", "left").join(seen("compuesta", "nc"), "compuesta", "left")
    divided = cut(divided.where((F.col("signo") != "-") | (F.coalesce("nj", F.lit(0)) >= F.coalesce("nc", F.lit(0)))))
    words = seams.where("clase = 'palabra'").select("documento_id", "numero", "linea", F.col("a").alias("palabra"), F.lit(0).alias("corte"), F.lit(None).cast("int").alias("pagina"), F.lit(None).cast("int").alias("siguiente"), "antes", "despues")
    parts = divided.select("documento_id", "numero", "linea", F.col("junta").alias("palabra"), F.length("a").alias("corte"), "pagina", "siguiente", "antes", "despues")
    # Hyphenated words whose own hyphen ends the line, and pages' first and last halves that nothing joins, stay as they are.
    every = words.union(parts)
    # A word that clean texts have isn't misread; a divided one is on the line of the part that differs.
    distinct = cut(every.groupBy("palabra").agg(F.count("*").alias("n")).join(blessed, "palabra", "left_anti"))
    choices = cut(candidates(distinct, lexicon))
    best = choices.groupBy("palabra").agg(F.max_by("correcta", F.struct("puntos", "correcta")).alias("correcta"), F.count("*").alias("opciones"))
    wrong = cut(every.join(best, "palabra"))
    told = in_context(page, wrong.where("opciones > 1"), choices)
    wrong = wrong.join(told, ["antes", "palabra", "despues"], "left")
    wrong = cut(wrong.withColumn("correcta", F.coalesce("dicha", "correcta")).drop("dicha", "antes", "despues", "opciones"))
    second = (F.col("corte") > 0) & (F.substring("palabra", F.lit(1), F.col("corte")) == F.substring("correcta", F.lit(1), F.col("corte")))
    on = wrong.select("documento_id", F.when(second, F.col("pagina")).otherwise(F.col("numero")).alias("numero"), F.when(second, F.col("siguiente")).otherwise(F.col("linea")).alias("linea"), F.lit("caracter").alias("tipo"))
    lines = found.union(divided.select("documento_id", "numero", "linea", F.lit("guion").alias("tipo"))).union(on).distinct()
    return {"lineas": lines, "divididas": divided, "palabras": wrong, "opciones": choices, "paginas": page}


def in_context(page: DataFrame, open_: DataFrame, choices: DataFrame) -> DataFrame:
    """``antes, palabra, despues, dicha``: for each setting of a word with several candidates the one that its count, its edits
    and the words beside it speak for."""
    own = cut(open_.select("antes", "palabra", "despues").distinct().join(choices, "palabra"))
    pairs = own.select(F.col("antes").alias("a"), F.col("correcta").alias("b")).union(own.select("correcta", "despues")).where("a <> '' and b <> ''").distinct()
    near = cut(neighbours(page, pairs))
    before, after = (near.select(F.col(x).alias(c), F.col(y).alias("correcta"), F.col("n").alias(f"n_{c}")) for c, x, y in (("antes", "a", "b"), ("despues", "b", "a")))
    ranked = own.join(before, ["antes", "correcta"], "left").join(after, ["despues", "correcta"], "left")
    beside = sum(BESIDE * F.log1p(F.coalesce(f"n_{c}", F.lit(0))) for c in ("antes", "despues"))
    return ranked.groupBy("antes", "palabra", "despues").agg(F.max_by("correcta", F.struct(F.col("puntos") + beside, "correcta")).alias("dicha"))


def _bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the neighbouring words of the text lines of a batch."""
    marks = PUNCTUATION
    for b in batches:
        pages = pc.split_pattern(pc.utf8_lower(b.column("texto")), "\n")
        many = pages.value_lengths().to_numpy(zero_copy_only=False)
        page, first = np.repeat(np.arange(len(many)), many), np.cumsum(many) - many
        out = b.column("fuera")
        lost = np.repeat(first, out.value_lengths().to_numpy(zero_copy_only=False)) + out.flatten().to_numpy(zero_copy_only=False)
        text = np.ones(len(page), bool)
        text[lost] = False
        words = pc.utf8_split_whitespace(pages.flatten().filter(pa.array(text)))
        of = np.repeat(np.arange(len(words)), words.value_lengths().to_numpy(zero_copy_only=False))
        coded = words.flatten().dictionary_encode()
        bare = pc.utf8_trim(coded.dictionary, marks).dictionary_encode()
        code = bare.indices.to_numpy(zero_copy_only=False)[coded.indices.to_numpy(zero_copy_only=False)]
        names = bare.dictionary
        said = (pc.utf8_length(names).to_numpy(zero_copy_only=False) > 0)[code] if len(code) else np.zeros(0, bool)
        at = np.flatnonzero((of[1:] == of[:-1]) & said[1:] & said[:-1])
        pair, n = np.unique(code[at].astype(np.int64) * len(names) + code[at + 1], return_counts=True)
        yield pa.RecordBatch.from_arrays([names.take(pa.array(pair // max(len(names), 1))), names.take(pa.array(pair % max(len(names), 1))), pa.array(n, pa.int64())], names=["a", "b", "n"])


def neighbours(page: DataFrame, wanted: DataFrame) -> DataFrame:
    """``a, b, n``: how often the pairs of words ``wanted`` follow each other in the text lines of marked pages."""
    seen = page.select("texto", "fuera").mapInArrow(_bigrams, "a string, b string, n bigint")
    return seen.join(wanted, ["a", "b"], "left_semi").groupBy("a", "b").agg(F.sum("n").alias("n"))


def seams_pages(page: DataFrame) -> DataFrame:
    """Pages with at least one text line."""
    lines = F.split("texto", "\n")
    full = F.size(F.filter(lines, lambda x, i: (F.trim(x) != "") & ~F.array_contains("fuera", i)))
    return page.where(full > 0)


def read_chunks(chunks: DataFrame) -> DataFrame:
    """``id, documento_id, pagina, texto`` of chunks; those without id or text are left out, repeated rows stay."""
    pagina = F.col("pagina").cast("int") if "pagina" in chunks.columns else F.lit(None).cast("int")
    return chunks.where("id is not null and texto is not null").select("id", "documento_id", pagina.alias("pagina"), "texto")


#: Ids that are sent to every task at most; more are joined.
SENT = 100_000


def of_these(rows: DataFrame, ids: DataFrame, kind: str) -> DataFrame:
    """Semi or anti join of rows with a written table of distinct ``id``, which is broadcast only after its size is checked."""
    return rows.join(F.broadcast(ids) if ids.limit(SENT + 1).count() <= SENT else ids, "id", kind)


def line_key(line: Column) -> tuple[Column, Column]:
    """Two hashes by which a line of a document is found again."""
    return F.xxhash64("documento_id", line).alias("h"), F.xxhash64(F.lit(1), line, "documento_id").alias("g")


def chunk_lines(chunks: DataFrame) -> DataFrame:
    """``id, todas, pagina, linea, h, g`` of the lines of chunks that aren't blank."""
    own = chunks.select("id", "documento_id", "pagina", F.size(F.split("texto", "\n")).alias("todas"), F.posexplode(F.split("texto", "\n")).alias("linea", "renglon"))
    return own.where(F.btrim("renglon") != "").select("id", "todas", "pagina", "linea", *line_key(F.col("renglon")))


#: Marks the id of a chunk that is judged by itself.
ALONE = "\x01"


def sheets(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """The distinct pages, and as pages of their own the chunks with a line that isn't one of their document's pages."""
    own = cut(distinct_pages(pages))
    lines = own.select("documento_id", F.explode(F.split("texto", "\n")).alias("renglon")).select(*line_key(F.col("renglon"))).distinct()
    foreign = cut(chunk_lines(chunks).select("h", "g").distinct().join(lines, ["h", "g"], "left_anti"))
    if foreign.isEmpty():
        return own
    lone = cut(chunk_lines(chunks).join(foreign, ["h", "g"], "left_semi").select("id").distinct())
    alone = of_these(chunks, lone, "left_semi").select(F.concat(F.lit(ALONE), "id").alias("documento_id"), F.lit(1).alias("numero"), "texto")
    return cut(own.union(distinct_pages(alone)))


#: Pages from the one a chunk starts on in which its lines are looked for, where a document's equal lines differ in what is wrong.
AHEAD = 8


def moved(chunks: DataFrame, page: DataFrame, wrong: DataFrame) -> DataFrame:
    """``id, todas, linea, mal``: what is ``wrong`` (``documento_id, numero, malas``, an array of ``linea, mal``) with the lines of chunks.

    A chunk has whole lines of pages. Where equal lines of a document have different things wrong, the nearest page from the one
    that the chunk starts on tells; where none is near, the first of them.
    """
    told = page.join(wrong, ["documento_id", "numero"], "left").select("documento_id", "numero", "malas", F.posexplode(F.split("texto", "\n")).alias("linea", "renglon"))
    each = told.where(F.btrim("renglon") != "").select("numero", *line_key(F.col("renglon")), F.get(F.filter("malas", lambda m: m["linea"] == F.col("linea")), F.lit(0))["mal"].alias("mal"))
    known = each.groupBy("h", "g").agg(F.count("*").alias("n"), F.count("mal").alias("m"), F.min("mal").alias("a"), F.max("mal").alias("z"))
    known = cut(known.where("m > 0").withColumn("igual", (F.col("n") == F.col("m")) & (F.col("a") == F.col("z"))).drop("n", "m", "z"))
    own = cut(chunk_lines(chunks).join(known, ["h", "g"]))
    near = each.join(known.where("not igual").select("h", "g"), ["h", "g"], "left_semi").groupBy("h", "g", "numero").agg(F.max("mal").alias("mal"))
    open_ = own.where("not igual").withColumn("numero", F.explode(F.sequence(F.coalesce("pagina", F.lit(1)), F.coalesce("pagina", F.lit(1)) + AHEAD)))
    placed = open_.join(near, ["h", "g", "numero"]).groupBy("id", "linea").agg(F.min_by(F.struct("mal"), "numero").alias("x"))
    rest = own.where("not igual").join(placed, ["id", "linea"], "left").select("id", "todas", "linea", F.when(F.col("x").isNull(), F.col("a")).otherwise(F.col("x.mal")).alias("mal"))
    return own.where("igual").select("id", "todas", "linea", F.col("a").alias("mal")).union(rest.where("mal is not null"))


def noisy_lines(pages: DataFrame, chunks: DataFrame, clean: DataFrame | None) -> DataFrame:
    """``tabla, clave, linea, tipo`` of the noise of pages and chunks (see ``p2_found`` in TESTDATA.md).

    Chunks are whole lines of the pages of their document, so a line is judged where the page has it; chunks with a line
    that no page of their document has are judged by themselves. Null texts have no lines; repeated rows count once.
    """
    cuts = read_chunks(chunks)
    found = noise(sheets(pages, cuts), clean)
    lines = cut(found["lineas"])
    own = lines.where(~F.col("documento_id").startswith(ALONE))
    of_pages = own.select(F.lit("paginas").alias("tabla"), F.concat_ws(":", "documento_id", F.col("numero").cast("string")).alias("clave"), "linea", "tipo")
    lone = lines.where(F.col("documento_id").startswith(ALONE)).select(F.expr(f"substring(documento_id, {len(ALONE) + 1})").alias("id"), "linea", "tipo")
    wrong = own.groupBy("documento_id", "numero", "linea").agg(F.array_sort(F.collect_set("tipo")).alias("mal")).groupBy("documento_id", "numero").agg(F.collect_list(F.struct("linea", "mal")).alias("malas"))
    alone = cut(found["paginas"].where(F.col("documento_id").startswith(ALONE)).select(F.expr(f"substring(documento_id, {len(ALONE) + 1})").alias("id")))
    known = of_these(moved(cuts, found["paginas"].drop("fuera"), wrong), alone, "left_anti").groupBy("id", "todas").agg(F.collect_set(F.struct("linea", F.col("mal").alias("tipos"))).alias("malas"))
    outside = F.transform(F.filter("malas", lambda m: F.array_contains(m["tipos"], "cabecera") | F.array_contains(m["tipos"], "folio")), lambda m: m["linea"])
    last = F.array_max(F.array_except(F.sequence(F.lit(0), F.col("todas") - 1), outside))
    of_chunks = (
        known.select("id", last.alias("ultima"), F.explode("malas").alias("m")).select("id", "ultima", "m.linea", F.explode("m.tipos").alias("tipo"))
        .where("tipo <> 'guion' or linea < ultima").select("id", "linea", "tipo").union(lone).select(F.lit("trozos").alias("tabla"), F.col("id").alias("clave"), "linea", "tipo").distinct()
    )
    return of_pages.union(of_chunks)


def like(word: str, right: str) -> str:
    """``right`` in the case of ``word``."""
    letters = [c for c in word if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return right.upper()
    return right[:1].upper() + right[1:] if letters and word[0] == letters[0] and word[0].isupper() else right


#: Begins a line of which the first word went to the line before.
GLUED = "\x02"


def _paragraphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paragraphs of each text after its fixes; of each whether it begins one, its place (0 is a rest of what came before), and whether it is left open."""
    for b in batches:
        out: list[tuple] = []
        for table_, key, number, text, fixes in zip(*(b.column(c).to_pylist() for c in ("tabla", "clave", "numero", "texto", "arreglos"))):
            fix = {f["linea"]: f for f in fixes or ()}
            lines, first = [], True
            for i, line in enumerate(text.split("\n")):
                f = fix.get(i)
                if f and f["fuera"]:
                    continue
                if f and line.strip():
                    if f["quita"] and (table_ == "paginas" or not first):
                        rest = OPENING.sub("", line, count=1)
                        line = rest if rest[:1].isspace() else GLUED + rest
                    divided = division(line) if f["entera"] else None
                    end = divided.start() if divided else len(line)
                    right = {c["palabra"]: c["correcta"] for c in f["cambios"] or ()}
                    body = WORD.sub(lambda m: like(m.group(), right[m.group().lower()]) if m.group().lower() in right else m.group(), line[:end])
                    line = body + (like(divided.group(1), f["entera"]) if divided else line[end:])
                first = first and not line.strip()
                lines.append(line.strip())
            width = max(map(len, lines), default=0)
            held: list[list[str]] = []
            fresh = True
            for k, line in enumerate(lines):
                if not line:
                    fresh = True
                    continue
                title = title_key(line) is not None and len(line) < 0.6 * width and line[0].isupper() and (k + 1 == len(lines) or not lines[k + 1] or not lines[k + 1][0].islower())
                if fresh or title or not held:
                    held.append([])
                elif re.search(r"\w-$", held[-1][-1]) and line[0].islower():  # the hyphen is the word's own
                    line = GLUED + line
                held[-1].append(line)
                fresh = title or line[-1] in ".!?:" and len(line) < 0.8 * width
            begun = 0
            for k, p in enumerate(held):
                own = re.sub(r"(?<=.) \x02", "", re.sub(r"\s+", " ", " ".join(p)))
                begins = k > 0 or not (own[0].islower() or own[0] == GLUED)
                begun += begins
                out.append((table_, key, number, k, own, begins, begun, k == len(held) - 1 and own[-1] not in ".!?:\""))
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.int64(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 8, kinds)], names=["tabla", "clave", "numero", "k", "texto", "empieza", "orden", "abierto"])


def repaired(pages: DataFrame, chunks: DataFrame, clean: DataFrame | None) -> DataFrame:
    """``tabla, clave, numero, parrafo, texto``: the paragraphs of documents (clave = documento_id; numero: the page they begin on)
    and of chunks (clave = id), without furniture, with divided words joined and misread ones put right.

    A paragraph that a page leaves open, or that the next page begins in small letters, goes on across the page. Null and
    blank texts have no paragraph; repeated rows count once. Chunks with a line that no page of their document has are mended by themselves.
    """
    cuts = cut(read_chunks(chunks).groupBy("id").agg(F.max_by(F.struct("documento_id", "pagina", "texto"), F.struct(F.length("texto"), F.xxhash64("texto"))).alias("m")).select("id", "m.*"))
    found = noise(sheets(pages, cuts), clean)
    page = found["paginas"]
    at = ["documento_id", "numero", "linea"]
    out = found["lineas"].where("tipo in ('cabecera', 'folio')").select(*at, F.lit(True).alias("fuera"))
    words = found["palabras"]
    changes = words.where("corte = 0").groupBy(*at).agg(F.collect_set(F.struct("palabra", "correcta")).alias("cambios"))
    mended = words.where("corte > 0").select(*at, "correcta")
    whole = found["divididas"].join(mended, at, "left").select(*at, "pagina", "siguiente", F.coalesce("correcta", "junta").alias("entera"))
    taken = whole.select("documento_id", F.col("pagina").alias("numero"), F.col("siguiente").alias("linea"), F.lit(True).alias("quita")).distinct()
    fixes = cut(
        out.join(changes, at, "full").join(whole.groupBy(*at).agg(F.max("entera").alias("entera")), at, "full").join(taken, at, "full")
        .select(*at, F.struct("linea", F.coalesce("fuera", F.lit(False)).alias("fuera"), "cambios", "entera", F.coalesce("quita", F.lit(False)).alias("quita")).alias("f"))
    )
    kind = fixes.schema["f"].dataType.simpleString()
    none = F.array().cast(f"array<{kind}>")
    lone = F.col("documento_id").startswith(ALONE)
    of_pages = page.join(fixes.groupBy("documento_id", "numero").agg(F.collect_list("f").alias("arreglos")), ["documento_id", "numero"], "left")
    of_pages = of_pages.select(F.when(lone, "trozos").otherwise("paginas").alias("tabla"), F.when(lone, F.expr(f"substring(documento_id, {len(ALONE) + 1})")).otherwise(F.col("documento_id")).alias("clave"), F.when(lone, 0).otherwise(F.col("numero")).alias("numero"), "texto", F.coalesce("arreglos", none).alias("arreglos"))
    wrong = fixes.where(~lone).select("documento_id", "numero", F.struct("linea", F.struct("f.fuera", F.array_sort("f.cambios").alias("cambios"), "f.entera", "f.quita").alias("mal")).alias("m")).groupBy("documento_id", "numero").agg(F.collect_list("m").alias("malas"))
    alone = cut(page.where(lone).select(F.expr(f"substring(documento_id, {len(ALONE) + 1})").alias("id")))
    rest = of_these(cuts, alone, "left_anti")
    fixed = moved(rest, page.drop("fuera"), wrong).groupBy("id").agg(F.collect_list(F.struct("linea", "mal.fuera", "mal.cambios", "mal.entera", "mal.quita")).alias("arreglos"))
    of_chunks = rest.join(fixed, "id", "left").select(F.lit("trozos").alias("tabla"), F.col("id").alias("clave"), F.lit(0).alias("numero"), "texto", F.coalesce("arreglos", none).alias("arreglos"))
    kinds = "tabla string, clave string, numero int, k int, texto string, empieza boolean, orden bigint, abierto boolean"
    unglued = lambda c: F.regexp_replace(c, f" ?{GLUED}", "").alias("texto")
    # A chunk is whole by itself; only paragraphs of pages are joined across them.
    chunked = of_pages.where("tabla = 'trozos'").union(of_chunks).mapInArrow(_paragraphs, kinds).select("tabla", "clave", "numero", F.col("orden").alias("parrafo"), unglued(F.col("texto")))
    told = cut(of_pages.where("tabla = 'paginas'").mapInArrow(_paragraphs, kinds).drop("orden"))
    # A page's first paragraph goes on if it begins small or the page before was left open.
    after = following(seams_pages(page)).select(F.col("documento_id").alias("clave"), "numero", "despues")
    left = told.where("abierto").join(after, ["clave", "numero"]).select("clave", F.col("despues").alias("numero"), F.lit(0).alias("k"), F.lit("paginas").alias("tabla"), F.lit(True).alias("sigue"))
    starts = told.join(left, ["tabla", "clave", "numero", "k"], "left").withColumn("nuevo", (F.col("empieza") & F.col("sigue").isNull()).cast("int"))
    ordered = running_sum(starts, ["tabla", "clave"], "numero", "nuevo", "parrafo", ties=["k"])
    joined = ordered.groupBy("tabla", "clave", "parrafo").agg(F.array_sort(F.collect_list(F.struct("numero", "k", "texto"))).alias("ps"))
    paged = joined.select("tabla", "clave", F.get("ps", F.lit(0))["numero"].alias("numero"), "parrafo", unglued(F.array_join(F.transform("ps", lambda p: p["texto"]), " ")))
    return paged.unionByName(chunked)


def p2_found(spark, folder: str) -> DataFrame:
    """Noisy lines of pages and chunks and what is wrong with them."""
    clean = table(spark, folder, "documents").select(F.col("text").alias("texto"))
    return noisy_lines(table(spark, folder, "paginas"), table(spark, folder, "trozos"), clean)


def p2_parrafos(spark, folder: str) -> DataFrame:
    """Paragraphs of documents and chunks, mended."""
    clean = table(spark, folder, "documents").select(F.col("text").alias("texto"))
    return repaired(table(spark, folder, "paginas"), table(spark, folder, "trozos"), clean)


SQL: dict[str, str] = {}
QUERIES: dict[str, Callable] = {"p2_found": p2_found, "p2_parrafos": p2_parrafos}
