"""Hybrid retrieval: exact dense candidates, coverage of the query's terms weighted by rarity, fusion, threshold, citation.

Queries are taken in blocks of bounded size; a block's matrix goes to every task, which keeps the best few of its
own rows for each query (a matrix product per batch), and the partial results are merged by query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from urdimbre.functions.stats import clamp, fused, idf
from urdimbre.functions.text import STEM, TERM, canonical_words, query_terms, snippet
from urdimbre.plans.lineage import cut

POOL, BEST, ALPHA, THRESHOLD, QUOTED = 60, 5, 0.5, 0.59, 400
#: Queries sent to every task for one scan of the rows, queries and rows multiplied at once (some tens of MB of scores).
BLOCK, QUERIES, ROWS = 16_000, 2_000, 4_096
#: The same where scores are fused, which takes several arrays of that size.
FUSED_ROWS = 512


def matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def highest(score: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` highest of each row, ties by id. A few times as many are parted first, unless ties reach beyond them."""
    few = 4 * most
    if score.shape[1] > few:
        at = np.argpartition(-score, few - 1, axis=1)[:, :few]
        part = np.take_along_axis(score, at, 1)
        if np.all(np.partition(-part, most - 1, axis=1)[:, most - 1] < -part.min(1)):
            score, ids = part, np.take_along_axis(ids, at, 1)
    keep = np.lexsort((ids, -score), axis=1)[:, :most]
    return np.take_along_axis(score, keep, 1), np.take_along_axis(ids, keep, 1)


def _nearest(queries, most: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, wanted = queries.value
        parts = [slice(at, at + QUERIES) for at in range(0, len(ids), QUERIES)]
        best, score = [np.zeros((len(ids[p]), 0), np.int64) for p in parts], [np.zeros((len(ids[p]), 0)) for p in parts]
        for b in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            own = matrix(b.column("vector"))
            keys = np.asarray(b.column("id"), np.int64)
            norm = np.linalg.norm(own, axis=1)
            unit = (own / np.where(norm > 0, norm, 1)[:, None]).T
            for k in range(len(parts)):
                got = np.round(wanted[parts[k]] @ unit, 6)
                score[k], best[k] = highest(np.hstack([score[k], got]), np.hstack([best[k], np.broadcast_to(keys, got.shape)]), most)
        for k, part in enumerate(parts):
            n = score[k].shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[part], n)), pa.array(best[k].ravel()), pa.array(score[k].ravel())], names=["consulta", "id", "denso"])

    return run


def dense_top(vectors: DataFrame, queries: DataFrame, most: int = POOL) -> DataFrame:
    """``consulta, id, denso, puesto``: for each query the ``most`` rows of highest cosine (6 digits; ties by id).

    ``vectors`` and ``queries``: ``id, vector``, arrays of one length; null vectors are left out, zero vectors score 0.
    """
    spark, parts = vectors.sparkSession, []
    own = vectors.where("vector is not null and id is not null").select(F.col("id").cast("bigint").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    asked = cut(queries.where("vector is not null and id is not null").select(F.col("id").cast("bigint").alias("id"), F.col("vector").cast("array<double>").alias("vector")))
    blocks = max(1, -(-asked.count() // BLOCK))
    for k in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k).toArrow()
        if not block.num_rows:
            continue
        m = matrix(block.column("vector"))
        norm = np.linalg.norm(m, axis=1)
        sent = spark.sparkContext.broadcast((np.asarray(block.column("id"), np.int64), m / np.where(norm > 0, norm, 1)[:, None]))
        parts.append(own.mapInArrow(_nearest(sent, most), "consulta bigint, id bigint, denso double"))
    if not parts:
        return spark.createDataFrame([], "consulta bigint, id bigint, denso double, puesto int")
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    place = F.row_number().over(Window.partitionBy("consulta").orderBy(F.col("denso").desc(), "id"))
    return every.withColumn("puesto", place).where(F.col("puesto") <= most)


def _extremes(queries, alphas: tuple[float, ...] | None) -> Callable:
    """Running best score of each query over rows with its label and over rows with another, for each alpha (none: the cosine)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, wanted, labels, terms, whole = queries.value
        best = np.full((len(alphas or (None,)), 2, len(ids)), -np.inf)
        for b in (part.slice(at, FUSED_ROWS) for part in batches for at in range(0, part.num_rows, FUSED_ROWS)):
            own, keys = matrix(b.column("vector")), np.asarray(b.column("id"), np.int64)
            norm = np.linalg.norm(own, axis=1)
            dense = np.round(wanted @ (own / np.where(norm > 0, norm, 1)[:, None]).T, 6)
            same = labels[:, None] == np.asarray(b.column("label"), np.int64)
            other = ids[:, None] != keys
            sides = (same & other, ~same & other)
            scores = [dense]
            if alphas:
                there: dict[str, list[int]] = {}
                for i, own_terms in enumerate(b.column("terminos").to_pylist()):
                    for t in own_terms or ():
                        if t in terms:
                            there.setdefault(t, []).append(i)
                has = np.zeros(dense.shape)
                for t, at in there.items():
                    asking, weights = terms[t]
                    has[np.ix_(asking, at)] += weights[:, None]
                cover = np.clip(has / np.where(whole > 0, whole, 1)[:, None], 0, 1)
                dense = np.clip(dense, 0, 1)
                # A query without terms (of which the whole weight is unknown), or alpha 1, scores by the cosine alone.
                alone = np.isnan(whole)[:, None]
                scores = (dense if a >= 1 else np.round(np.where(alone, dense, a * dense + (1 - a) * cover), 6) for a in alphas)
            for k, score in enumerate(scores):
                for side, of in enumerate(sides):
                    np.maximum(best[k, side], np.where(of, score, -np.inf).max(1), out=best[k, side])
        for a, (near, far) in zip(alphas or (1.0,), best):
            columns = (pa.array(x, mask=np.isinf(x)) for x in (near, far))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), a)), *columns], names=["consulta", "alfa", "propia", "ajena"])

    return run


def best_by_label(vectors: DataFrame, queries: DataFrame, alphas: tuple[float, ...] | None = None, lexicon: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``consulta, alfa, propia, ajena``: each query's best score over all other rows with its label, and over all with another.

    ``vectors`` and ``queries``: ``id, vector, label``; rows without one of them are left out. Without ``alphas`` the score
    is the cosine; with them it is fused with the coverage that ``lexicon`` (what ``lexical`` gives) holds, for each alpha. There
    is no pool: every row is scored. A score is null if no row has (or lacks) the label.
    """
    spark, parts = vectors.sparkSession, []
    usable = "vector is not null and id is not null and label is not null"
    columns = [F.col("id").cast("bigint").alias("id"), F.col("vector").cast("array<double>").alias("vector"), F.col("label").cast("bigint").alias("label")]
    own, asked = vectors.where(usable).select(*columns), queries.where(usable).select(*columns)
    if alphas:
        weights, there = lexicon
        terms = there.groupBy("id").agg(F.collect_set("termino").alias("terminos"))
        weighed = weights.groupBy("consulta").agg(F.collect_list(F.struct("termino", "peso")).alias("pesos"))
        own = cut(own.join(terms, "id", "left"))
        asked = asked.join(weighed.withColumnRenamed("consulta", "id"), "id", "left")
    asked = cut(asked)
    blocks = max(1, -(-asked.count() // QUERIES))
    for k in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k).toArrow()
        if not block.num_rows:
            continue
        m = matrix(block.column("vector"))
        norm = np.linalg.norm(m, axis=1)
        asking: dict[str, list[tuple[int, float]]] = {}
        whole = np.full(block.num_rows, np.nan)
        for i, pairs in enumerate(block.column("pesos").to_pylist() if alphas else ()):
            if pairs:
                whole[i] = sum(x["peso"] for x in pairs)
            for x in pairs or ():
                asking.setdefault(x["termino"], []).append((i, x["peso"]))
        held = {t: (np.array([i for i, _ in x]), np.array([w for _, w in x])) for t, x in asking.items()}
        sent = spark.sparkContext.broadcast((np.asarray(block.column("id"), np.int64), m / np.where(norm > 0, norm, 1)[:, None], np.asarray(block.column("label"), np.int64), held, whole))
        parts.append(own.mapInArrow(_extremes(sent, alphas), "consulta bigint, alfa double, propia double, ajena double"))
    if not parts:
        return spark.createDataFrame([], "consulta bigint, alfa double, propia double, ajena double")
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    return every.groupBy("consulta", "alfa").agg(F.max("propia").alias("propia"), F.max("ajena").alias("ajena"))


def stems_of_words(words: DataFrame, stems: DataFrame) -> DataFrame:
    """``palabra, termino``: the stems that occur in each distinct word. Words meet stems on their pieces of a stem's length."""
    pieces = F.flatten(F.transform(F.sequence(F.lit(TERM), F.lit(STEM)), lambda n: F.when(F.length("palabra") >= n, F.transform(F.sequence(F.lit(1), F.length("palabra") - n + 1), lambda i: F.substring(F.col("palabra"), i, n))).otherwise(F.array().cast("array<string>"))))
    return words.select("palabra", F.explode(F.array_distinct(pieces)).alias("termino")).join(stems, "termino", "left_semi")


def lexical(fragments: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Weights ``consulta, termino, df, peso`` of the queries' terms, and ``id, termino`` where a fragment has a term.

    ``fragments`` and ``queries``: ``id, texto``. A term is present if its stem occurs in the text; a term that no fragment
    has counts as rarest. Terms are at least as long as a word piece, so both sides meet on distinct words.
    """
    terms = cut(queries.select(F.col("id").alias("consulta"), F.explode(query_terms(F.col("texto"))).alias("termino")))
    own = fragments.select("id", F.explode(F.array_distinct(canonical_words(F.col("texto")))).alias("palabra"))
    meet = cut(stems_of_words(cut(own.select("palabra").distinct()), terms.select("termino").distinct()))
    there = cut(own.join(meet, "palabra").select("id", "termino").distinct())
    total = fragments.count()
    df = there.groupBy("termino").agg(F.count("*").alias("df"))
    weights = terms.join(df, "termino", "left").na.fill(0, ["df"]).withColumn("peso", idf(F.col("df"), F.lit(total)))
    return weights, there


def hybrid(vectors: DataFrame, texts: DataFrame, queries: DataFrame, query_texts: DataFrame, alpha: float = ALPHA, pool: int = POOL, best: int = BEST) -> DataFrame:
    """``consulta, id, denso, lexico, puntos, lugar``: the ``best`` of the dense pool by fused score (6 digits; ties keep the dense order).

    A query without terms, or alpha 1, scores by the clamped cosine alone, with a pool of just ``best``.
    """
    dense = cut(dense_top(vectors, queries, best if alpha >= 1 else pool))
    weights, there = lexical(texts, query_texts)
    weights = cut(weights)
    whole = weights.groupBy("consulta").agg(F.sum("peso").alias("todo"))
    found = dense.join(weights.select("consulta", "termino", "peso"), "consulta").join(there, ["id", "termino"]).groupBy("consulta", "id").agg(F.sum("peso").alias("hay"))
    scored = dense.join(whole, "consulta", "left").join(found, ["consulta", "id"], "left")
    cover = F.coalesce(F.when(F.col("todo") > 0, F.coalesce("hay", F.lit(0.0)) / F.col("todo")), F.lit(0.0))
    points = F.when(F.col("todo").isNull() | F.lit(alpha >= 1), clamp(F.col("denso"))).otherwise(fused(F.col("denso"), cover, alpha))
    scored = scored.withColumn("lexico", F.round(cover, 6)).withColumn("puntos", F.round(points, 6))
    place = F.row_number().over(Window.partitionBy("consulta").orderBy(F.col("puntos").desc(), "puesto"))
    return scored.withColumn("lugar", place).where(F.col("lugar") <= best).select("consulta", "id", "denso", "lexico", "puntos", "lugar")


def sufficient(found: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose own score reaches the threshold; a query may be left with none."""
    return found.where(F.col("puntos") >= threshold)


def cited(found: DataFrame, texts: DataFrame, most: int = QUOTED) -> DataFrame:
    """``found`` with the ``cita`` of each text and the score to 4 digits."""
    return found.join(texts.select("id", snippet(F.col("texto"), most).alias("cita")), "id").withColumn("puntos", F.round("puntos", 4))
