"""Statistics as columns and aggregates. The three conventions for percentiles are kept apart by name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from urdimbre.plans.lineage import cut


def usable(c: Column) -> Column:
    """The number, or null if it is NaN or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def counted(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """How often each value of ``value`` occurs in each group: what exact percentiles need, combined before the shuffle."""
    there = F.col(value).isNotNull()
    if rows.schema[value].dataType.typeName() in ("double", "float"):
        there &= ~F.isnan(value)
    return rows.where(there).groupBy(*keys, value).agg(F.count("*").alias("_veces"))


def percentiles(rows: DataFrame, keys: list[str], value: str, wanted: dict[str, float], how: str, digits: int | None = None) -> DataFrame:
    """``keys`` and a column for each of ``wanted`` (shares 0..1): percentiles of rank q * (n - 1) from 0.

    ``how``: linear (between the two ranks beside it), nearest (ties to even) or floor, which give a value of the group.
    Null keys are a group, null and NaN values don't count, a group without values has no row. Values are counted
    first; the distinct ones are cut into ranges of equally many across all groups, so neither a large group nor an
    outlier makes a task larger. Sums of ranges tell which ones hold the ranks, and only those are ranked.
    """
    each = counted(rows, keys, value).withColumn("_k", F.struct(F.lit(0), *keys))
    placed = cut(each.select("_k", F.col(value).alias("_v"), "_veces").repartitionByRange("_k", "_v").withColumn("_c", F.spark_partition_id()))
    before = Window.partitionBy("_k").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("_k", "_c").agg(F.sum("_veces").alias("_m"))
    ranges = sums.withColumn("_antes", F.coalesce(F.sum("_m").over(before), F.lit(0))).withColumn("_n", F.sum("_m").over(Window.partitionBy("_k")))
    place = lambda q: F.lit(float(q)) * (F.col("_n") - 1)
    ranks = lambda q: {"nearest": [F.bround(place(q))], "floor": [F.floor(place(q))], "linear": [F.floor(place(q)), F.ceil(place(q))]}[how]
    asked = [r.cast("bigint") + 1 for q in wanted.values() for r in ranks(q)]
    held = ranges.where(reduce(lambda a, b: a | b, [(r > F.col("_antes")) & (r <= F.col("_antes") + F.col("_m")) for r in asked])).drop("_m")
    upto = Window.partitionBy("_k", "_c").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = placed.join(held, ["_k", "_c"]).withColumn("_hasta", F.sum("_veces").over(upto) + F.col("_antes")).withColumn("_desde", F.col("_hasta") - F.col("_veces"))
    at = lambda r: F.max(F.when((r.cast("bigint") + 1 > F.col("_desde")) & (r.cast("bigint") + 1 <= F.col("_hasta")), F.col("_v")))
    parts = {f"_{i}_{j}": at(r) for i, q in enumerate(wanted.values()) for j, r in enumerate(ranks(q))}
    got = ranked.groupBy("_k", "_n").agg(*(c.alias(k) for k, c in parts.items()))

    def answer(i: int, q: float) -> Column:
        low = F.col(f"_{i}_0")
        out = low + (F.col(f"_{i}_1") - low) * (place(q) - F.floor(place(q))) if how == "linear" else low
        return out if digits is None else F.round(out, digits)

    return got.select(*(F.col("_k")[k].alias(k) for k in keys), *(answer(i, q).alias(k) for i, (k, q) in enumerate(wanted.items())))


def by_rank(rows: DataFrame, keys: list[str], value: str, wanted: dict[str, float], nearest: bool) -> DataFrame:
    """Percentiles that are values, of the nearest or the floored rank."""
    return percentiles(rows, keys, value, wanted, "nearest" if nearest else "floor")


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Score interval of a share, within 0 and 1; null for n = 0."""
    n = F.when(n > 0, n)
    share = k / n
    middle = (share + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), middle - half)), F.when(n > 0, F.least(F.lit(1.0), middle + half))


def idf(df: Column, total: Column) -> Column:
    """ln(1 + N / (1 + df)); 0 for an empty collection."""
    return F.when(total <= 0, F.lit(0.0)).otherwise(F.log(1 + total.cast("double") / (1 + F.greatest(F.lit(0), df))))


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def fused(dense: Column, lexical: Column, alpha: Column | float) -> Column:
    """alpha * dense + (1 - alpha) * lexical, each taken into 0..1."""
    a = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    return a * clamp(dense) + (1 - a) * clamp(lexical)


def add(a: Column, b: Column) -> Column:
    """Sum that takes a null for 0 unless both are null."""
    return F.when(a.isNull() & b.isNull(), None).otherwise(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
