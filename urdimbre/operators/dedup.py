"""Exact and near duplicates of texts.

Texts are first grouped by hash, so copies (even a third of all rows) are one representative. Near duplicates
share enough of their sets of word shingles: representatives meet only on the rarest shingles of each (prefix
filtering), which every pair of the asked similarity must share, and are then compared exactly. A shingle that
very many texts have is in a prefix only if the whole text is that common.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urdimbre.functions.text import canonical_words
from urdimbre.plans.lineage import cut, shuffle_parts

WORDS, SIMILAR = 5, 0.8


def membership(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, huella, clase``: SHA-256 of every text and the smallest key that has it. Null texts are left out; an empty text is a text."""
    own = docs.select(F.col(key), F.sha2(F.encode(F.col(text), "UTF-8"), 256).alias("huella")).where(F.col("huella").isNotNull())
    first = own.groupBy("huella").agg(F.min(key).alias("clase"))
    return own.join(first, "huella").select(key, "huella", "clase")


def shingles(docs: DataFrame, key: str, text: str, words: int = WORDS, shortest: int = 0) -> DataFrame:
    """``key, n, fichas``: the distinct hashes of ``words`` words in a row; texts with fewer words than that, or than ``shortest``, have none (n is 0)."""
    own = docs.select(F.col(key), F.transform(canonical_words(F.col(text)), lambda w: F.xxhash64(w)).alias("w"))
    starts = F.when(F.size("w") >= max(words, shortest), F.sequence(F.lit(0), F.size("w") - words)).otherwise(F.array().cast("array<int>"))
    each = F.transform(starts, lambda i: F.xxhash64(*(F.get("w", i + k) for k in range(words))))
    return own.select(key, F.array_distinct(each).alias("fichas")).withColumn("n", F.size("fichas"))


def similar_pairs(sets: DataFrame, key: str, similar: float = SIMILAR) -> DataFrame:
    """``a, b, jaccard`` of all pairs a < b of ``shingles`` with a Jaccard similarity of ``similar`` or more.

    Shingles are in order of how many texts have them. A pair of the asked similarity meets within the first
    n - ceil(similar * n) + 1 of both; where it first meets, what is left on both sides must suffice for its overlap. Shingles
    of one text only come first and meet nothing, so just their number is needed and they aren't shuffled again.
    """
    sets = cut(sets.select(F.col(key).alias("k"), "fichas", "n"))
    each = sets.select("k", "n", F.explode("fichas").alias("f"))
    common = each.groupBy("f").agg(F.count("*").alias("df")).where("df > 1")
    ranked = each.join(common, "f").groupBy("k", "n").agg(F.array_sort(F.collect_list(F.struct("df", "f"))).alias("fs"))
    single = F.col("n") - F.size("fs")
    most = (F.col("n") - F.ceil(F.col("n") * similar - 1e-9) + 1 - single).cast("int")
    prefix = cut(ranked.where(most > 0).select("k", "n", single.alias("antes"), F.posexplode(F.slice("fs", F.lit(1), most)).alias("i", "x")).select("k", "n", (F.col("antes") + F.col("i")).alias("i"), F.col("x.f").alias("f")))
    a, b = (prefix.select(F.col("k").alias(x), F.col("n").alias(f"n{x}"), F.col("i").alias(f"i{x}"), "f") for x in "ab")
    least = F.ceil((F.col("na") + F.col("nb")) * (similar / (1 + similar)) - 1e-9)
    # At the first shingle that both have, at most the shorter rest is shared.
    near = (F.least("na", "nb") >= F.greatest("na", "nb") * similar - 1e-9) & (F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) >= least)
    met = cut(a.join(b, "f").where((F.col("a") < F.col("b")) & near).select("a", "b").distinct())
    side = lambda x: sets.select(F.col("k").alias(x), F.col("fichas").alias(f"f{x}"))
    shared = F.size(F.array_intersect("fa", "fb"))
    return met.join(side("a"), "a").join(side("b"), "b").select("a", "b", (shared / (F.size("fa") + F.size("fb") - shared)).alias("jaccard")).where(F.col("jaccard") >= similar)


def near_duplicates(docs: DataFrame, key: str, text: str, words: int = WORDS, similar: float = SIMILAR, shortest: int = 0) -> tuple[DataFrame, DataFrame]:
    """Pairs ``a, b, jaccard`` of class representatives (distinct texts), and the ``membership`` of every document."""
    members = cut(membership(docs, key, text))
    first = members.where(F.col(key) == F.col("clase")).select(key).distinct()
    own = docs.select(key, text).join(first, key, "left_semi")
    # The size of texts as they are shuffled says little about the work on them, so the parts stay as many as they are.
    own = own.repartition(shuffle_parts(docs.sparkSession), key).dropDuplicates([key])
    return similar_pairs(shingles(own, key, text, words, shortest), key, similar), members


def kept_first(docs: DataFrame, key: str, text: str, words: int = WORDS, similar: float = SIMILAR, shortest: int = 0) -> DataFrame:
    """``key, gemelo, motivo``: documents in order of ``key``, each kept unless a kept one before it is its copy (exacto) or near
    duplicate (solapamiento, of which the first kept is named). A dropped document drops no other; copies of one are judged like it.
    """
    pairs, members = near_duplicates(docs, key, text, words, similar, shortest)
    every = cut(pairs.select(F.col("a").alias("antes"), F.col("b").alias("luego")))
    links, dropped = every, every.select(F.col("antes").alias("k")).limit(0)
    while not links.isEmpty():  # each round writes what it decides and the links that are still open
        heads = links.select("antes").distinct().join(links.select(F.col("luego").alias("antes")).distinct(), "antes", "left_anti")
        out = cut(links.join(heads, "antes", "left_semi").select(F.col("luego").alias("k")).distinct())
        open_ = links.join(heads, "antes", "left_anti").join(out.select(F.col("k").alias("antes")), "antes", "left_anti")
        links = cut(open_.join(out.select(F.col("k").alias("luego")), "luego", "left_anti").select("antes", "luego"))
        dropped = dropped.union(out)
    twin = every.join(dropped.select(F.col("k").alias("antes")), "antes", "left_anti").groupBy(F.col("luego").alias("clase")).agg(F.min("antes").alias("cercano"))
    named = members.join(twin, "clase", "left")
    copy = F.col(key) != F.col("clase")
    return named.select(key, F.when(F.col("cercano").isNotNull(), F.col("cercano")).when(copy, F.col("clase")).alias("gemelo"), F.when(F.col("cercano").isNotNull(), "solapamiento").when(copy, "exacto").alias("motivo"))


def first_seen(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``; the whole row breaks ties. Aggregated, so a common key is no window."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.min(F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate([*order, *rest])])).alias("m")
    return rows.groupBy(*keys).agg(best).select(*keys, *(F.col(f"m._{len(order) + i}").alias(c) for i, c in enumerate(rest)))
