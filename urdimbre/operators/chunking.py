"""Overlapping chunks of texts: whole sentences up to a length, the last ones repeated in the next chunk.

A document is one text, its pages one after another. Its sentences are units with lengths; prefix sums of the
lengths tell by search where the chunk that begins with a unit ends, and with which unit the next one begins. Stretches
of a document's pages are worked on in parallel, each from a guess of what the stretch before leaves open (at first:
nothing). Where the guess was wrong, a stretch is worked on again with what the one before really left, until
nothing changes: chunks of different beginnings soon coincide, so the second round is nearly always the last.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from urdimbre.functions.text import normalized
from urdimbre.plans.lineage import cut, shuffle_parts

LENGTH, OVERLAP, SHORTEST = 600, 150, 80
#: Pages of a document that a task holds at once.
STRETCH = 200
#: Fixed value: where sentences are parted.
END = re.compile(r"(?<=[.!?;])\s+|\n{2,}")
#: What a stretch leaves open: whole units of the chunk begun and whether it has new ones and repeated ones, the text of
#: the sentence begun, and whether the document has a chunk already. Texts with the pages they begin on.
UNIT = "struct<texto:string,numero:int>"
OPEN = f"struct<unidades:array<{UNIT}>,repetidas:int,abiertas:array<{UNIT}>,hay:boolean>"
UNIT_ARROW = pa.list_(pa.struct([("texto", pa.string()), ("numero", pa.int32())]))
OPEN_ARROW = pa.struct([("unidades", UNIT_ARROW), ("repetidas", pa.int32()), ("abiertas", UNIT_ARROW), ("hay", pa.bool_())])


def units(pages: list[tuple[int, str]], most: int, last: bool) -> tuple[list[tuple[int, str]], list[tuple[int, str]]]:
    """Units of texts that follow each other, each with the page that it begins on, and the texts of a sentence left open.

    A sentence above ``most`` characters is cut at the last blank within them, or at ``most``. Unless ``last``, the text
    after the last place where a sentence surely ends, or a long one is surely cut, stays open.
    """
    text = "\n".join(t for _, t in pages)
    starts = [0, *accumulate(len(t) + 1 for _, t in pages)][:-1]
    page_at = lambda i: pages[bisect_right(starts, i) - 1][0]
    done: list[tuple[int, str]] = []
    at = 0
    stops = [(m.start(), m.end()) for m in END.finditer(text) if last or m.end() < len(text)]
    for stop, then in [*stops, (len(text), None)]:
        while stop - at > most:
            blank = text.rfind(" ", at + 1, at + most)
            here = blank if blank > 0 else at + most
            done.append((page_at(at), text[at:here]))
            at = here
            while at < stop and text[at].isspace():
                at += 1
        if then is None and not last:
            break
        if text[at:stop].strip():
            done.append((page_at(at), text[at:stop]))
        at = stop if then is None else then
    rest = [] if last else [(p, t[max(0, at - s) :]) for (p, t), s in zip(pages, starts) if s + len(t) > at or (s + len(t) == at and s == at)]
    return done, rest


def chunked(own: list[tuple[int, str]], repeated: int, there: bool, most: int, overlap: int, shortest: int, last: bool) -> tuple[list[tuple[int, str]], int, int, bool]:
    """Chunks of units of which the first ``repeated`` were in the chunk before; first unit and number of repeated ones of the chunk left open; whether there is a chunk.

    A repeated unit takes room for a blank after it, as does every unit but the last of a chunk.
    """
    sums = [0, *accumulate(len(t) + 1 for _, t in own)]
    out: list[tuple[int, str]] = []
    i, new = 0, repeated
    while new < len(own):
        room = sums[i] + most + (new == i)
        end = max(new + 1, bisect_right(sums, room) - 1)
        if end >= len(own) and not last:
            break
        body = " ".join(t.strip() for _, t in own[i:end]).strip()
        if len(body) >= shortest or not there:
            out.append((own[i][0], body))
            there = True
        if end >= len(own):
            i = new = end
            break
        back = max(i, bisect_right(sums, sums[end] - overlap) - 1) if overlap else end
        back = max(back, bisect_left(sums, sums[end] + len(own[end][1]) - most))
        i, new = min(back, end), end
    return out, i, new - i, there


def _pack(most: int, overlap: int, shortest: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            told, left = [], []
            for pages, before, last in zip(*(b.column(c).to_pylist() for c in ("paginas", "antes", "ultimo"))):
                before = before or {"unidades": [], "repetidas": 0, "abiertas": [], "hay": False}
                pair = lambda xs: [(x["numero"], x["texto"]) for x in xs]
                fresh, rest = units(pair(before["abiertas"]) + pair(pages), most, last)
                held = pair(before["unidades"])
                out, first, repeated, there = chunked(held + fresh, before["repetidas"], before["hay"], most, overlap, shortest, last)
                named = lambda xs: [{"texto": t, "numero": p} for p, t in xs]
                told.append(named(out))
                left.append(None if last else {"unidades": named((held + fresh)[first:]), "repetidas": repeated, "abiertas": named(rest), "hay": there})
            keep = [b.column(c) for c in ("clave", "tramo")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(told, UNIT_ARROW), pa.array(left, OPEN_ARROW)], names=["clave", "tramo", "trozos", "deja"])

    return run


def chunks(pages: DataFrame, length: int = LENGTH, overlap: int = OVERLAP, shortest: int = SHORTEST, stretch: int = STRETCH) -> DataFrame:
    """``clave, indice, pagina, texto`` of pages ``clave, numero, texto``: each chunk with the page it starts on.

    Pages are normalised; null and blank ones are skipped, repeated ones count once, in order of ``numero`` and text. ``indice``
    counts from 0 in a document. A chunk under ``shortest`` is dropped unless it is the document's first.
    ``stretch`` (pages worked on at once) changes nothing but the room that a task needs.
    """
    if length <= 0 or not 0 <= overlap < length:
        raise ValueError("the length must be positive and the overlap from 0 to below it")
    own = pages.select("clave", F.col("numero").cast("int").alias("numero"), normalized(F.col("texto")).alias("texto")).where("texto <> '' and clave is not null and numero is not null")
    own = own.withColumn("parte", F.floor(F.col("numero") / stretch)).repartition(shuffle_parts(pages.sparkSession), "clave", "parte")
    held = cut(own.groupBy("clave", "parte").agg(F.array_sort(F.collect_set(F.struct("numero", "texto"))).alias("ps")))
    along = Window.partitionBy("clave").orderBy("parte")
    order = held.select("clave", "parte").withColumn("tramo", F.row_number().over(along)).withColumn("ultimo", F.lead("parte").over(along).isNull())
    placed = held.join(order, ["clave", "parte"]).select("clave", "tramo", "ultimo", F.transform("ps", lambda p: F.struct(p["texto"].alias("texto"), p["numero"].alias("numero"))).alias("paginas"))
    kinds = f"clave {pages.schema['clave'].dataType.simpleString()}, tramo int, trozos array<{UNIT}>, deja {OPEN}"
    pack = _pack(length, overlap, shortest)
    told = cut(placed.withColumn("antes", F.lit(None).cast(OPEN)).mapInArrow(pack, kinds))
    guessed = told.select("clave", (F.col("tramo") + 1).alias("tramo"), F.lit(None).cast(OPEN).alias("antes")).where(F.col("deja").isNotNull())
    while True:
        left = told.where("deja is not null").select("clave", (F.col("tramo") + 1).alias("tramo"), F.col("deja").alias("nuevo"))
        wrong = cut(left.join(guessed, ["clave", "tramo"]).where(~F.col("nuevo").eqNullSafe(F.col("antes"))).select("clave", "tramo", F.col("nuevo").alias("antes")))
        if wrong.isEmpty():
            break
        again = placed.join(wrong, ["clave", "tramo"]).mapInArrow(pack, kinds)
        told = cut(told.join(wrong.select("clave", "tramo"), ["clave", "tramo"], "left_anti").union(again))
        guessed = guessed.join(wrong.select("clave", "tramo"), ["clave", "tramo"], "left_anti").union(wrong)
    before = Window.partitionBy("clave").orderBy("tramo").rowsBetween(Window.unboundedPreceding, -1)
    starts = told.select("clave", "tramo", F.coalesce(F.sum(F.size("trozos")).over(before), F.lit(0)).alias("antes"))
    each = told.select("clave", "tramo", F.posexplode("trozos").alias("k", "t")).join(starts, ["clave", "tramo"])
    return each.select("clave", (F.col("antes") + F.col("k")).cast("int").alias("indice"), F.col("t.numero").alias("pagina"), F.col("t.texto").alias("texto"))
