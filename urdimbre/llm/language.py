"""Languages of documents and of the segments of mixed texts.

For every language a character model is trained on labelled rows: interpolated Kneser-Ney of order ``ORDER``
over words with their edges. The models of all languages are stored together: for each order the sorted hashes
of the n-grams seen in any language, with the interpolated probability in each language, and the sorted hashes
of their contexts with the weight of the lower order. A text is cut at sentence ends; each piece is scored by
cross-entropy, a switch of language between pieces costs ``SWITCH`` nats (Viterbi), and a piece whose best
length-normalised cross-entropy is above what held-out rows show is rejected (``und``). Confidence is the
calibrated probability of the choice given its lead over the second language.

Training and calibration use every labelled row. Labels may be wrong, so a first round of models drops the pieces
that contradict their label before the second. For rejection and confidence each half of the rows is scored by
models of the other half. The driver gets counts only: of the distinct n-grams, and of scores by thousandths of a nat.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urdimbre.llm import scans
from urdimbre.plans.lineage import clear, cut, spread, table

ORDER = 5
SWITCH = 6.0
#: Letters that make a language present, and share of held-out pieces that rejection may lose at most.
PRESENT, LOST = 40, 0.002
UNKNOWN = "und"
#: Letters below which a piece isn't rejected by itself, and bounds of the evidence that confidence goes by, in nats.
SHORT = 20
EVIDENCE = np.array([1, 2, 4, 8, 16, 32, 64, 128.0])
#: Labelled pieces that a language needs for a bound on rejection (as many as it takes for 20 of them in a held-out fifth).
LEAST = 100
#: Steps in a nat by which entropies are counted for rejection, and distinct pieces or words that a task counts before it passes them on.
STEPS, HELD = 1000, 300_000
PIECE = re.compile(r"(?<=[.!?…;:।؟。！？])\s+|(?<=[。！？।])|\n[^\S\n]*\n\s*|\n(?=[«„“\"(¿¡\[]*[A-ZÀ-ÞΑ-ΩА-Я])")
WORD = re.compile(r"[^\W\d_]+")
#: Kinds of characters, and by code point the kinds of those met so far: what parts pieces as ``PIECE`` does, before a blank or anywhere; what may open a line, and with what it then begins.
LETTER, ALPHABETIC, BLANK, ENDS, PARTS, OPENS, CAPITAL, MET = (np.uint8(1 << k) for k in range(8))
KINDS = {LETTER: WORD, BLANK: re.compile(r"\s"), ENDS: re.compile("[.!?…;:؟]"), PARTS: re.compile("[।。！？]"), OPENS: re.compile(r"[«„“\"(¿¡\[]"), CAPITAL: re.compile("[A-ZÀ-ÞΑ-ΩА-Я]")}
_kinds = np.zeros(0x110000, np.uint8)
#: Characters of texts that are cut into words at a time, and words whose scores are added up at a time.
CHARS, WORDS = 1 << 18, 1 << 14
PRIME = np.uint64(1_000_003)


def gram_hash(codes: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` characters that end at each of ``ends``."""
    h = np.full(len(ends), np.uint64(n))
    for k in range(n - 1, -1, -1):
        h = h * PRIME + codes[ends - k]
        h ^= h >> np.uint64(29)
    return h


def coded(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of the words, a blank before and after each; of every predicted character its word and place in it."""
    text = " " + " ".join(words) + " " if words else " "
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter((len(w) for w in words), np.int64, len(words)) + 1
    word = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(word)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + 1
    return codes, word, place


@dataclass
class Models:
    """Models of ``languages``: by order, sorted n-gram hashes with a column of log probabilities per language, and contexts with back-off weights."""

    languages: list[str]
    grams: list[np.ndarray] = field(default_factory=list)
    logs: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    backs: list[np.ndarray] = field(default_factory=list)
    floor: np.ndarray | None = None
    most: np.ndarray | float = float("inf")
    agreed: np.ndarray = field(default_factory=lambda: np.linspace(0.5, 0.99, len(EVIDENCE) + 1))

    def score(self, words: list[str]) -> np.ndarray:
        """Log probability of every word in every language."""
        codes, word, place = coded(words)
        ends = np.arange(1, len(word) + 1)
        order = np.minimum(place + 1, ORDER)
        out = np.zeros((len(words), len(self.languages)))
        total = np.zeros((len(word), len(self.languages)), np.float32)
        for n in range(ORDER, 0, -1):
            at = np.flatnonzero(order == n)
            if not len(at):
                continue
            row, there = find(self.grams[n - 1], gram_hash(codes, ends[at], n))
            total[at[there]] += self.logs[n - 1][row[there]]
            lost = at[~there]
            order[lost] = n - 1
            if n > 1:
                row, there = find(self.contexts[n - 1], gram_hash(codes, ends[lost] - 1, n - 1))
                total[lost[there]] += self.backs[n - 1][row[there]]
            else:
                total[lost] += self.floor
        np.add.at(out, word, total)
        return out

    def confidence(self, evidence: np.ndarray) -> np.ndarray:
        """Share of held-out pieces with as much evidence (nats by which the best language leads) whose label agrees."""
        return self.agreed[np.searchsorted(EVIDENCE, evidence, side="right")]


def find(sorted_: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    row = np.minimum(np.searchsorted(sorted_, wanted), len(sorted_) - 1)
    return row, sorted_[row] == wanted


def text_hash(grams: list[str], n: int) -> np.ndarray:
    codes = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return gram_hash(codes, np.arange(1, len(grams) + 1) * n - 1, n)


def kneser_ney(counts: pd.DataFrame, languages: list[str]) -> Models:
    """Models from counts ``idioma, g, n`` of the n-grams of highest order and of those that begin a word."""
    models, below = Models(languages), None
    counts = counts.assign(k=counts["g"].str.len())
    raw = {k: c.pivot_table(index="g", columns="idioma", values="n", aggfunc="sum", fill_value=0).reindex(columns=languages, fill_value=0) for k, c in counts.groupby("k")}
    tables = {ORDER: raw.get(ORDER)}
    for k in range(ORDER - 1, 0, -1):
        above = tables[k + 1]
        seen = (above > 0).astype(int)
        seen.index = above.index.str[1:]
        seen = seen.groupby(level=0).sum()
        if k in raw:  # n-grams at the start of a word have no character before them
            start = raw[k][raw[k].index.str[0] == " "]
            seen = seen.add(start, fill_value=0)
        tables[k] = seen
    for k in range(1, ORDER + 1):
        t = tables[k]
        c = t.to_numpy(float)
        once, twice = (c == 1).sum(0), (c == 2).sum(0)
        d = np.where(once > 0, once / np.maximum(once + 2 * twice, 1), 0.5).clip(0.1, 0.9)
        of = t.index.str[:-1]
        sums = t.groupby(of).sum()
        kinds = (t > 0).groupby(of).sum().reindex(sums.index).to_numpy(float)
        whole = sums.to_numpy(float)
        back = np.where(whole > 0, d * kinds / np.maximum(whole, 1), 1.0)
        row = sums.index.get_indexer(of)
        own = np.where(whole[row] > 0, np.maximum(c - d, 0) / np.maximum(whole[row], 1), 0.0)
        if k == 1:
            uniform = 1 / (len(t) + 1)
            p = own + back[row] * uniform
            models.floor = np.log(back[0] * uniform).astype(np.float32)
        else:
            p = own + back[row] * below.reindex(t.index.str[1:]).to_numpy()
        below = pd.DataFrame(p, index=t.index, columns=languages)
        h = text_hash(list(t.index), k)
        by = np.argsort(h)
        models.grams.append(h[by])
        models.logs.append(np.log(np.maximum(p, 1e-12)).astype(np.float32)[by])
        hc = text_hash(list(sums.index), k - 1) if k > 1 else np.zeros(0, np.uint64)
        by = np.argsort(hc)
        models.contexts.append(hc[by])
        models.backs.append(np.log(np.maximum(back, 1e-12)).astype(np.float32)[by] if k > 1 else np.zeros((0, len(languages)), np.float32))
    return models


def kinds(codes: np.ndarray) -> np.ndarray:
    """Kinds of characters, as bits; a character is looked into when it is first met."""
    found = _kinds[codes]
    if not found.all():
        for c in np.unique(codes[found == 0]).tolist():
            own = chr(c)
            _kinds[c] = MET | sum(bit for bit, like in KINDS.items() if like.match(own)) | ALPHABETIC * own.isalpha()
        found = _kinds[codes]
    return found


def word_hash(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hash of words of so many letters each, one after the other: the sum of the mixed letters and their places."""
    first = np.cumsum(lengths) - lengths
    h = np.arange(len(codes), dtype=np.uint64)
    h -= np.repeat(first.astype(np.uint64), lengths)
    h <<= np.uint64(21)
    h |= codes
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h += np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(shift)
        h *= np.uint64(by)
    h ^= h >> np.uint64(31)
    return np.add.reduceat(h, first) if len(first) else h


def cut_words(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Of every word of the texts: its hash, text, place in it, length and whether a piece begins with it."""
    codes = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = kinds(codes)
    letter = np.append(kind & LETTER != 0, False)
    edge = np.flatnonzero(np.diff(letter, prepend=False))
    start, length = edge[::2], edge[1::2] - edge[::2]
    h = word_hash(codes[letter[:-1]], length)

    def beyond(at: np.ndarray, skip: np.ndarray) -> np.ndarray:
        """The first place from each on that is none to skip; after every text there is one."""
        on = skip[at]
        if on.any():
            rest = np.flatnonzero(~skip)
            at = np.where(on, rest[np.searchsorted(rest, at)], at)
        return at

    ends, line = np.flatnonzero(kind & ENDS), np.flatnonzero(codes == 10)
    empty = codes[beyond(line + 1, (kind & BLANK != 0) & (codes != 10))] == 10
    begins = kind[beyond(line + 1, kind & OPENS != 0)] & CAPITAL != 0
    # What begins with a letter-like number parts pieces and is no word.
    word = kind[start] & ALPHABETIC != 0
    parts = np.concatenate([ends[kind[ends + 1] & BLANK != 0], np.flatnonzero(kind & PARTS), line[empty | begins], start[~word]])
    start, length, h = start[word], length[word], h[word]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    of = np.cumsum(sizes) - sizes
    first = np.searchsorted(start, of)
    text = np.repeat(np.arange(len(texts)), np.diff(np.append(first, len(start))))
    fresh = np.zeros(len(start) + 1, bool)
    fresh[np.searchsorted(start, parts)] = True
    fresh[first] = True
    return h, text, start - of[text], length, fresh[:-1]


class Pieces:
    """The pieces of a batch of texts: for each its text, letters, length and score in every language, and with ``strings`` itself."""

    def __init__(self, texts: list[str | None], outside: list[list[int] | None], models: Models, strings: bool = False):
        plain, self.strings = [], []
        for text, out in zip(texts, outside):
            text = text or ""
            if out:
                skip = set(out)
                text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in skip)
            plain.append(text)
            if strings:
                self.strings += [x for x in PIECE.split(text) if WORD.search(x)]
        upto = np.cumsum([len(x) for x in plain])
        bounds = [0, *(np.flatnonzero(np.diff(upto // CHARS)) + 1).tolist(), len(plain)]
        each = [(i, cut_words(plain[i:j])) for i, j in zip(bounds, bounds[1:]) if i < j]
        h, text, place, length, fresh = (np.concatenate([np.zeros(0, t), *(x[k] + i if k == 1 else x[k] for i, x in each)]) for k, t in enumerate((np.uint64, np.int64, np.int64, np.int64, bool)))
        codes, distinct = pd.factorize(h)
        at = np.zeros(len(distinct), np.int64)
        at[codes[::-1]] = np.arange(len(codes))[::-1]
        lower, words = pd.factorize(np.array([plain[t][p : p + n].lower() for t, p, n in zip(text[at].tolist(), place[at].tolist(), length[at].tolist())], object))
        self.words = list(words)
        size = np.fromiter((len(w) for w in words), np.int64, len(words))
        # Words of one text with no break between them are a piece.
        self.own = own = lower[codes]
        self.starts = starts = np.flatnonzero(fresh)
        self.text = text[starts]
        self.score = self.summed(models.score(self.words))
        self.letters = np.add.reduceat(size[own], starts) if len(own) else own
        self.chars = self.letters + np.diff(np.append(starts, len(own)))

    def summed(self, score: np.ndarray) -> np.ndarray:
        """Scores of the pieces from those of ``words``."""
        out, bounds, i = np.zeros((len(self.starts), score.shape[1])), np.append(self.starts, len(self.own)), 0
        while i < len(out):
            j = max(i + 1, np.searchsorted(bounds, bounds[i] + WORDS, side="right") - 1)
            out[i:j] = np.add.reduceat(score[self.own[bounds[i] : bounds[j]]], bounds[i:j] - bounds[i], axis=0)
            i = j
        return out

    def languages(self, models: Models) -> np.ndarray:
        """Language of every piece, -1 where rejected: the best path through the pieces of each text."""
        n, best = len(self.text), np.zeros(len(self.text), np.int64)
        if not n:
            return best
        first = np.flatnonzero(np.append(True, self.text[1:] != self.text[:-1]))
        many = np.diff(np.append(first, n))
        back = np.zeros(self.score.shape, np.int16)
        state, last = self.score[first].copy(), first.copy()
        for step in range(1, many.max()):
            on = np.flatnonzero(many > step)
            top = state[on].argmax(1)
            stay = state[on] >= state[on, top][:, None] - SWITCH
            back[first[on] + step] = np.where(stay, np.arange(state.shape[1]), top[:, None])
            state[on] = np.where(stay, state[on], state[on, top][:, None] - SWITCH) + self.score[first[on] + step]
            last[on] = first[on] + step
        now = state.argmax(1)
        for step in range(many.max() - 1, -1, -1):
            on = np.flatnonzero(many > step)
            best[first[on] + step] = now[on]
            now[on] = back[first[on] + step, now[on]] if step else now[on]
        bound = np.broadcast_to(models.most, len(models.languages))[best]
        best[(-self.score[np.arange(n), best] / self.chars > bound) & (self.letters >= SHORT)] = -1
        return best

    def jumbled(self, models: Models) -> np.ndarray:
        """Score of every piece with the letters of each word jumbled, a word the same way everywhere."""
        return self.summed(models.score(["".join(random.Random(w).sample(w, len(w))) for w in self.words]))

    def lead(self) -> np.ndarray:
        """Nats by which the best language leads the second."""
        top = np.sort(self.score, axis=1)
        return top[:, -1] - top[:, -2] if top.shape[1] > 1 else np.full(len(top), np.inf)


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``idioma, mitad, trozo, n``: the pieces of labelled texts as words in lower case, and how often."""

    def counted(held: dict[tuple[str, int], Counter]) -> Iterator[pa.RecordBatch]:
        for (label, half), raw in held.items():
            count: Counter = Counter()
            for piece, n in raw.items():
                if words := WORD.findall(piece.lower()):
                    count[" ".join(words)] += n
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(count), pa.string()), pa.array([half] * len(count), pa.int32()), pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["idioma", "mitad", "trozo", "n"])

    held: dict[tuple[str, int], Counter] = {}
    for b in batches:
        for text, label, half in zip(*(b.column(c).to_pylist() for c in ("texto", "idioma", "mitad"))):
            held.setdefault((label, half), Counter()).update(PIECE.split(text))
        if sum(map(len, held.values())) > HELD:
            yield from counted(held)
            held = {}
    yield from counted(held)


def _grams(models) -> Callable:
    """Counts of n-grams by labelled language and half of the rows, of the pieces (see ``_told``) that the models, if any, give to it."""

    def told(words: dict[tuple[str, int], Counter]) -> Iterator[pa.RecordBatch]:
        for (label, half), own in words.items():
            count: Counter = Counter()
            for w, n in own.items():
                padded = f" {w} "
                for end in range(2, len(padded) + 1):
                    count[padded[max(0, end - ORDER) : end]] += n
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(count), pa.string()), pa.array([half] * len(count), pa.int32()), pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["idioma", "mitad", "g", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[tuple[str, int], Counter] = {}
        for b in batches:
            pieces, labels, halves, many = (b.column(c).to_pylist() for c in ("trozo", "idioma", "mitad", "n"))
            if models is not None:
                names = np.array(models.value.languages, object)
                agree = (names[Pieces(pieces, [None] * len(pieces), models.value).score.argmax(1)] == np.array(labels, object)).tolist()
            for k, (piece, label, half, n) in enumerate(zip(pieces, labels, halves, many)):
                if models is None or agree[k]:
                    own = words.setdefault((label, half), Counter())
                    for w in piece.split(" "):
                        own[w] += n
            if sum(map(len, words.values())) > HELD:
                yield from told(words)
                words = {}
        yield from told(words)

    return run


def plain_label(c: str) -> Column:
    return F.lower(F.trim(F.col(c)))


def codes_of(labels: DataFrame) -> DataFrame:
    """``etiqueta, codigo`` by plain label; labels that name no language, or several, have none."""
    own = labels.where("etiqueta is not null and codigo is not null").select(plain_label("etiqueta").alias("etiqueta"), F.lower("codigo").alias("codigo"))
    return own.groupBy("etiqueta").agg(F.min("codigo").alias("codigo"), F.count_distinct("codigo").alias("n")).where("n = 1").drop("n")


def train(rows: DataFrame) -> Models:
    """Models of the languages of labelled rows ``clave, texto, idioma``, all of them; rows without text or label are left out."""
    spark = rows.sparkSession
    rows = rows.where("texto is not null and idioma is not null and trim(texto) <> ''")
    rows = spread(rows.select("texto", "idioma", F.pmod(F.xxhash64(F.lit(5), "clave"), F.lit(2)).cast("int").alias("mitad")))
    pieces = cut(rows.mapInArrow(_told, "idioma string, mitad int, trozo string, n bigint"))
    models = None
    for _ in range(2):
        sent = None if models is None else spark.sparkContext.broadcast(models)
        grams = pieces.mapInArrow(_grams(sent), "idioma string, mitad int, g string, n bigint")
        counts = grams.groupBy("idioma", "mitad", "g").agg(F.sum("n").alias("n")).toArrow().to_pandas()
        if counts.empty:
            return Models([])
        models = kneser_ney(counts, sorted(counts["idioma"].unique()))
    halves = [kneser_ney(own, models.languages) if len(own := counts[counts["mitad"] != k]) else models for k in (0, 1)]
    calibrate(models, pieces.mapInArrow(_held(spark.sparkContext.broadcast(halves)), "clase int, k int, valor bigint, n bigint").groupBy("clase", "k", "valor").agg(F.sum("n").alias("n")).toArrow().to_pandas())
    return models


def _held(models) -> Callable:
    """``clase, k, valor, n``: how pieces (see ``_told``) do with the models of the other half of the rows.

    0: entropies (in ``STEPS`` of a nat) of pieces whose label is the best language ``k``, 1: those of the same texts jumbled,
    2: pieces by place of their evidence, of which with ``k`` 1 the label agrees.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, labels, halves, many = b.column("trozo").to_pylist(), b.column("idioma").to_pylist(), b.column("mitad").to_numpy(), b.column("n").to_numpy()
            for half, m in enumerate(models.value):
                at = np.flatnonzero(halves == half)
                if not len(at):
                    continue
                pieces = Pieces([texts[i] for i in at], [None] * len(at), m)
                label = np.array([m.languages.index(labels[i]) for i in at], np.int64)
                best, long = pieces.score.argmax(1), pieces.letters >= SHORT
                good, every = best == label, np.ones(len(at), bool)
                out = [(2, good.astype(np.int64), np.searchsorted(EVIDENCE, pieces.lead(), side="right"), every)]
                for clase, score, on in ((0, pieces.score, good & long), (1, pieces.jumbled(m), long)):
                    out.append((clase, score.argmax(1), np.rint(-score.max(1) / pieces.chars * STEPS).astype(np.int64), on))
                for clase, k, valor, on in out:
                    each, of = np.unique(np.stack([k[on], valor[on]]), axis=1, return_inverse=True)
                    n = np.bincount(of.ravel(), many[at][on], each.shape[1]).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), clase), pa.int32()), pa.array(each[0], pa.int32()), pa.array(each[1], pa.int64()), pa.array(n, pa.int64())], names=["clase", "k", "valor", "n"])

    return run


def quantile(values: np.ndarray, n: np.ndarray, q: float) -> float:
    """The quantile, linear between ranks, of values that occur ``n`` times each."""
    by = np.argsort(values)
    upto, place = np.cumsum(n[by]), q * (n.sum() - 1)
    low, high = (values[by][np.searchsorted(upto, rank, side="right")] for rank in (np.floor(place), np.ceil(place)))
    return float(low + (high - low) * (place - np.floor(place)))


def calibrate(models: Models, held: pd.DataFrame) -> None:
    """Sets the rejection bound and the confidence by evidence, rising, from the counts of held-out pieces (see ``_held``).

    The bound lies above nearly all held-out pieces, and at the entropy that all but a few of the same pieces have
    with the letters of each word jumbled: what looks no more like a language than that is rejected.
    """
    models.most = np.full(len(models.languages), np.inf)
    for k in range(len(models.languages)):
        own, off = (held[(held["clase"] == clase) & (held["k"] == k)] for clase in (0, 1))
        if own["n"].sum() >= LEAST and off["n"].sum() >= LEAST:
            models.most[k] = max(quantile(x["valor"].to_numpy(), x["n"].to_numpy(), q) for x, q in ((own, 1 - LOST), (off, 0.05))) / STEPS
    of = held[held["clase"] == 2]
    all_, right = (np.bincount(x["valor"], x["n"], len(EVIDENCE) + 1) for x in (of, of[of["k"] == 1]))
    models.agreed = np.maximum.accumulate((right + 1) / (all_ + 2))


KEEP = ("tabla", "clave", "etiqueta")
SEGMENT = "tabla string, clave string, etiqueta string, parte bigint, orden int, idioma string, confianza double, letras bigint, texto string"


def _segments(models, texts: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = models.value
        names = np.array([*m.languages, UNKNOWN], object)
        for b in batches:
            if not m.languages:
                continue
            pieces = Pieces(b.column("texto").to_pylist(), b.column("fuera").to_pylist(), m, texts)
            best = pieces.languages(m)
            new = np.flatnonzero(np.append(True, (pieces.text[1:] != pieces.text[:-1]) | (best[1:] != best[:-1]))) if len(best) else np.zeros(0, np.int64)
            if not len(new):
                continue
            letters = np.add.reduceat(pieces.letters, new)
            total = np.sort(np.add.reduceat(pieces.score, new, axis=0), axis=1)
            lead = total[:, -1] - total[:, -2] if total.shape[1] > 1 else np.full(len(new), np.inf)
            row = pieces.text[new]
            order = np.arange(len(new)) - np.searchsorted(row, row)
            strings = ["\n".join(pieces.strings[i:j]) for i, j in zip(new, [*new[1:], len(best)])] if texts else [None] * len(new)
            take = pa.array(row)
            sure = np.where(best[new] < 0, 0.0, m.confidence(lead))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c).take(take) for c in (*KEEP, "parte")), pa.array(order, pa.int32()), pa.array(names[best[new]], pa.string()), pa.array(sure, pa.float64()), pa.array(letters, pa.int64()), pa.array(strings, pa.string())],
                names=[*KEEP, "parte", "orden", "idioma", "confianza", "letras", "texto"],
            )

    return run


def segments(rows: DataFrame, models: Models, texts: bool = False) -> DataFrame:
    """Segments of one language of rows ``tabla, clave, etiqueta, parte, texto, fuera`` (numbers of the lines to leave aside).

    Null texts and texts without letters have no segment. ``texts`` asks for the segments' texts too.
    """
    sent = rows.sparkSession.sparkContext.broadcast(models)
    return rows.select(*KEEP, "parte", "texto", "fuera").mapInArrow(_segments(sent, texts), SEGMENT)


def _furniture_like(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of chunks that may be furniture."""
    for b in batches:
        out = [
            (key, doc, i, line)
            for key, doc, text in zip(*(b.column(c).to_pylist() for c in ("id", "documento_id", "texto")))
            for i, line in enumerate((text or "").split("\n"))
            if scans.title_words(line) or scans.page_number(line)
        ]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, (pa.string(), pa.string(), pa.int32(), pa.string()))], names=["id", "documento_id", "linea", "renglon"])


def records(spark, folder: str) -> DataFrame:
    """Texts of both tables to be told the language of: the distinct pages of ``documentos`` and the distinct ``trozos``."""
    pages = cut(scans.distinct_pages(table(spark, folder, "paginas")))
    found = cut(scans.furniture(pages))
    page = scans.marked(pages, found)
    docs = table(spark, folder, "documentos").where("id is not null").groupBy("id").agg(F.max("idioma").alias("etiqueta"))
    of_docs = page.join(docs, page["documento_id"] == docs["id"]).select(F.lit("documentos").alias("tabla"), F.col("id").alias("clave"), "etiqueta", F.col("numero").cast("bigint").alias("parte"), "texto", "fuera")
    chunks = cut(table(spark, folder, "trozos").select("id", "documento_id", "texto", "idioma").where("id is not null and texto is not null").dropDuplicates(["id"]))
    clear(spark)  # the shuffles of all texts that the tables above were made of
    raw = found.join(pages, ["documento_id", "numero"]).select("documento_id", F.get(F.split("texto", "\n"), F.col("linea")).alias("renglon")).distinct()
    like = chunks.mapInArrow(_furniture_like, "id string, documento_id string, linea int, renglon string")
    out = like.join(raw, ["documento_id", "renglon"], "left_semi").groupBy("id").agg(F.collect_set("linea").alias("fuera"))
    of_chunks = chunks.join(out, "id", "left").select(F.lit("trozos").alias("tabla"), F.col("id").alias("clave"), F.col("idioma").alias("etiqueta"), F.lit(0).cast("bigint").alias("parte"), "texto", F.coalesce("fuera", F.array().cast("array<int>")).alias("fuera"))
    return of_docs.union(of_chunks)


def models_of(spark, folder: str) -> Models:
    """Models trained on the labelled ``documents``."""
    docs = table(spark, folder, "documents")
    known = codes_of(table(spark, folder, "etiquetas_idioma"))
    return train(docs.withColumn("etiqueta", plain_label("lang")).join(known, "etiqueta").select(F.col("doc_id").alias("clave"), F.col("text").alias("texto"), F.col("codigo").alias("idioma")))


def p5_found(spark, folder: str) -> DataFrame:
    """Records with a language that their label doesn't name, or with several: a row for each language present."""
    found = segments(records(spark, folder), models_of(spark, folder))
    known = codes_of(table(spark, folder, "etiquetas_idioma"))
    present = found.where(F.col("idioma") != UNKNOWN).groupBy(*KEEP, "idioma").agg(F.sum("letras").alias("letras")).where(F.col("letras") >= PRESENT)
    labelled = present.withColumn("plana", plain_label("etiqueta")).join(known.withColumnRenamed("etiqueta", "plana"), "plana", "left")
    each = labelled.groupBy("tabla", "clave").agg(F.collect_set("idioma").alias("idiomas"), F.max("codigo").alias("codigo"))
    wrong = each.where((F.size("idiomas") > 1) | F.col("codigo").isNull() | (F.col("codigo") != F.get("idiomas", F.lit(0))))
    return wrong.select("tabla", "clave", F.explode("idiomas").alias("idioma"))


def p5_idiomas(spark, folder: str) -> DataFrame:
    """Language of every record with text: the one with most letters (ties: by name), its share of them and the mean confidence."""
    found = segments(records(spark, folder), models_of(spark, folder))
    each = found.groupBy("tabla", "clave", "idioma").agg(F.sum("letras").alias("letras"), (F.sum(F.col("confianza") * F.col("letras")) / F.sum("letras")).alias("confianza"))
    best = F.max_by(F.struct("idioma", "confianza", "letras"), F.struct("letras", "idioma")).alias("m")
    return each.groupBy("tabla", "clave").agg(best, F.sum("letras").alias("todas")).select("tabla", "clave", "m.idioma", "m.confianza", (F.col("m.letras") / F.col("todas")).alias("parte"))


def p5_segmentos(spark, folder: str) -> DataFrame:
    """Segments of the records in several languages: their order, language, confidence, letters and text."""
    found = cut(segments(records(spark, folder), models_of(spark, folder), texts=True))
    mixed = found.groupBy("tabla", "clave").agg(F.count_distinct("idioma").alias("n")).where("n > 1").select("tabla", "clave")
    return found.join(mixed, ["tabla", "clave"], "left_semi").select("tabla", "clave", "parte", "orden", "idioma", "confianza", "letras", "texto")


SQL: dict[str, str] = {}
QUERIES: dict[str, Callable] = {"p5_found": p5_found, "p5_idiomas": p5_idiomas, "p5_segmentos": p5_segmentos}
