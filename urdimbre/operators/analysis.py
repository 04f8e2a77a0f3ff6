"""Offline analyses: cross tables, purity, frontiers, confusion, sweeps, integrity of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urdimbre.functions.stats import counted, percentiles, wilson


def crosstab(rows: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts of ``row`` by the given ``values`` of ``column``, in their order; missing cells are 0."""
    return rows.groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).na.fill(0, [str(v) for v in values])


def described(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, minimum, quartiles (linear) and maximum of ``value`` by ``keys``; null and NaN values don't count."""
    quart = percentiles(rows, keys, value, {"q1": 0.25, "mediana": 0.5, "q3": 0.75}, "linear", 4).withColumn("_g", F.struct(F.lit(0), *keys))
    ends = counted(rows, keys, value).groupBy(F.struct(F.lit(0), *keys).alias("_g")).agg(F.sum("_veces").alias("n"), F.min(value).alias("minimo"), F.max(value).alias("maximo"))
    return quart.join(ends, "_g").select(*keys, "n", "minimo", "q1", "mediana", "q3", "maximo")


def described_on(rows: DataFrame, key: str, given: list, by: str, value: str) -> DataFrame:
    """``described`` for each of the ``given`` values of ``key`` and each value of ``by``; n is 0 and the rest null where there are no rows."""
    cells = rows.select(by).distinct().withColumn(key, F.explode(F.array(*map(F.lit, given))))
    found = described(rows.where(F.col(key).isin(given)), [key, by], value)
    same = (cells[key] == found[key]) & cells[by].eqNullSafe(found[by])
    return cells.join(found, same, "left").select(cells[key], cells[by], F.coalesce("n", F.lit(0)).alias("n"), "minimo", "q1", "mediana", "q3", "maximo")


def flag_purity(rows: DataFrame, key: str, flag: Column, label: str) -> DataFrame:
    """By ``key``: rows where ``flag`` is true, and the commonest ``label`` among them (ties: the smallest) with its share."""
    each = rows.where(flag).groupBy(key, label).agg(F.count("*").alias("m"))
    best = F.min(F.struct((-F.col("m")).alias("menos"), F.col(label).alias("etiqueta"))).alias("b")
    return each.groupBy(key).agg(F.sum("m").alias("n"), best).select(key, "n", F.col("b.etiqueta").alias("comun"), F.round(-F.col("b.menos") / F.col("n"), 6).alias("pureza"))


def classes(cases: DataFrame, label: str, entity: str) -> DataFrame:
    """By ``label``: cases, distinct entities, and the Wilson interval of the class' share of all entities; null entities aren't counted."""
    each = cases.groupBy(label).agg(F.count("*").alias("casos"), F.count_distinct(entity).alias("entidades"))
    whole = cases.agg(F.count_distinct(entity).alias("todas"))
    low, high = wilson(F.col("entidades"), F.col("todas"))
    return each.crossJoin(F.broadcast(whole)).select(label, "casos", "entidades", F.round(low, 6).alias("desde"), F.round(high, 6).alias("hasta"))  # one row


def purity(rows: DataFrame, group: str, label: str) -> DataFrame:
    """Share of the commonest label in each group, and whether it reaches 0.95; null labels are a label."""
    each = rows.groupBy(group, label).agg(F.count("*").alias("n"))
    return each.groupBy(group).agg(F.sum("n").alias("n"), (F.max("n") / F.sum("n")).alias("pureza")).withColumn("pura", F.col("pureza") >= 0.95)


def constancy(rows: DataFrame, group: str, label: str) -> DataFrame:
    """Groups with more than one label: how many, and the smallest."""
    return rows.groupBy(group).agg(F.count_distinct(label).alias("distintas"), F.min(label).alias("primera")).where("distintas > 1")


def frontier(rows: DataFrame, key: str, value: str, low: Column, high: Column) -> DataFrame:
    """By ``key``: the largest value where ``low``, the smallest where ``high``, and the gap between them."""
    found = rows.groupBy(key).agg(F.max(F.when(low, F.col(value))).alias("mayor_bajo"), F.min(F.when(high, F.col(value))).alias("menor_alto"))
    return found.withColumn("hueco", F.col("menor_alto") - F.col("mayor_bajo"))


def confusion(rows: DataFrame, real: str, told: str) -> DataFrame:
    return rows.groupBy(real, told).agg(F.count("*").alias("n"))


def recall(rows: DataFrame, real: str, told: str) -> DataFrame:
    """Recall of each real class with its Wilson interval."""
    found = rows.groupBy(real).agg(F.count_if(F.col(real) == F.col(told)).alias("aciertos"), F.count("*").alias("n"))
    low, high = wilson(F.col("aciertos"), F.col("n"))
    return found.select(real, "aciertos", "n", F.round(F.col("aciertos") / F.col("n"), 6).alias("recall"), F.round(low, 6).alias("desde"), F.round(high, 6).alias("hasta"))


def sweep(rows: DataFrame, key: str, value: str, thresholds: list[float]) -> DataFrame:
    """Rows of each key at or above each threshold. The thresholds are columns of one aggregation, then rows."""
    found = rows.groupBy(key).agg(*(F.count_if(F.col(value) >= t).alias(f"_{i}") for i, t in enumerate(thresholds)))
    cells = F.explode(F.array(*(F.struct(F.lit(t).alias("umbral"), F.col(f"_{i}").alias("n")) for i, t in enumerate(thresholds))))
    return found.select(key, cells.alias("c")).select(key, "c.*")


def without_each(rows: DataFrame, group: str, value: str) -> DataFrame:
    """For each group the smallest and largest ``value`` of all other groups, from the two extremes of different groups."""
    each = rows.where(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(group).agg(F.min(value).alias("bajo"), F.max(value).alias("alto"))
    two = lambda c, f: F.slice(F.array_sort(F.collect_list(c)), 1, 2) if f else F.slice(F.sort_array(F.collect_list(c), False), 1, 2)
    # Of every hash bucket the two extremes, and of those the two of all: no task gets all groups.
    bucket = each.groupBy(F.pmod(F.xxhash64(group), F.lit(256)).alias("c")).agg(two(F.struct(F.col("bajo"), F.col(group)), True).alias("b"), two(F.struct(F.col("alto"), F.col(group)), False).alias("a"))
    ends = bucket.agg(F.slice(F.array_sort(F.flatten(F.collect_list("b"))), 1, 2).alias("b"), F.slice(F.sort_array(F.flatten(F.collect_list("a")), False), 1, 2).alias("a"))
    other = lambda xs, f: F.get(F.filter(xs, lambda x: x[group] != F.col(group)), F.lit(0))[f]
    return each.select(group).crossJoin(F.broadcast(ends)).select(group, other(F.col("b"), "bajo").alias("minimo_resto"), other(F.col("a"), "alto").alias("maximo_resto"))  # one row


def within_band(rows: DataFrame, base: Column, values: list[str], low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Rows outside ``base`` whose values all lie within the percentiles ``low``..``high`` (linear) of the rows in it."""
    held = rows.where(~F.coalesce(base, F.lit(False)))
    for v in values:
        band = percentiles(rows.where(base), [], v, {"_bajo": low, "_alto": high}, "linear")  # one row
        held = held.crossJoin(F.broadcast(band)).where(F.col(v).between(F.col("_bajo"), F.col("_alto"))).drop("_bajo", "_alto")
    return held


def key_report(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: distinct keys in both tables, only in the first, only in the second; nulls are no key."""
    x, y = (t.where(F.col(key).isNotNull()).select(key).distinct().withColumn(n, F.lit(1)) for t, n in ((a, "_a"), (b, "_b")))
    both = x.join(y, key, "full")
    return both.agg(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("ambas"), F.count_if(F.col("_b").isNull()).alias("solo_primera"), F.count_if(F.col("_a").isNull()).alias("solo_segunda"))


#: Distinct labels that a cross table may have.
LABELS = 10_000


def zero_cells(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs of a value of ``a`` and one of ``b`` that no row has; nulls are no value.

    The values of ``b`` are labels: more than ``LABELS`` of them are refused. Only the pairs that are missing are built.
    """
    own = rows.where(F.col(b).isNotNull()).select(b).distinct()
    if own.limit(LABELS + 1).count() > LABELS:
        raise ValueError(f"{b} has more than {LABELS} values")
    every = own.agg(F.collect_set(b).alias("_todas"))
    each = rows.where(F.col(a).isNotNull()).groupBy(a).agg(F.collect_set(b).alias("_hay"))
    return each.crossJoin(F.broadcast(every)).select(a, F.explode(F.array_except("_todas", "_hay")).alias(b))  # one row of labels


def joined_cases(cases: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many cases have a partner in ``others`` by all keys, how many have none, and how many rows the inner join gives."""
    n = others.groupBy(*keys).agg(F.count("*").alias("_n"))
    both = cases.join(n, keys, "left")
    return both.agg(F.count("_n").alias("con"), F.count_if(F.col("_n").isNull()).alias("sin"), F.coalesce(F.sum("_n"), F.lit(0)).alias("filas"))


def labelled(cases: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Left join of cases with labels by ``key``, with what it is checked for: ``etiquetas`` (rows of labels that the case meets; 0 and 1 are right)."""
    n = labels.groupBy(key).agg(F.count("*").alias("etiquetas"))
    return cases.join(n, key, "left").na.fill(0, ["etiquetas"])


def coded(rows: DataFrame, column: str, labels: DataFrame) -> DataFrame:
    """``rows`` with ``column`` replaced by the code that its spelling names in ``labels`` (``etiqueta, codigo``, a few rows); null if it names none or several."""
    known = labels.where("etiqueta is not null and codigo is not null").groupBy(F.lower(F.trim("etiqueta")).alias("_e")).agg(F.min(F.lower("codigo")).alias("_c"), F.count_distinct(F.lower("codigo")).alias("_m")).where("_m = 1")
    return rows.join(known, F.lower(F.trim(column)) == F.col("_e"), "left").withColumn(column, F.col("_c")).drop("_e", "_c", "_m")
