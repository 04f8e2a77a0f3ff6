"""Running values along an order: sums, latest known values, streaks.

A key may hold a third of all rows, so a running value is found in two steps: the order is cut into stretches,
each stretch's own total is aggregated, the totals are carried along the stretches, and a window of one stretch
adds what came before. Rows with a null key or a null place in the order have no running value and are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WIDTH = 1024


def _stretched(rows: DataFrame, order: str, width: int) -> DataFrame:
    return rows.withColumn("_tramo", F.floor(F.col(order) / width))


def running_sum(rows: DataFrame, keys: list[str], order: str, value: str, out: str, width: int = WIDTH, ties: list[str] | None = None) -> DataFrame:
    """Adds ``out``, the sum of ``value`` up to each row by ``order`` (a number, not null; ``ties`` break its ties); nulls add nothing."""
    own = _stretched(rows, order, width)
    before = Window.partitionBy(*keys).orderBy("_tramo").rowsBetween(Window.unboundedPreceding, -1)
    carried = own.groupBy(*keys, "_tramo").agg(F.sum(value).alias("_suma")).withColumn("_antes", F.coalesce(F.sum("_suma").over(before), F.lit(0))).drop("_suma")
    upto = Window.partitionBy(*keys, "_tramo").orderBy(order, *(ties or [])).rowsBetween(Window.unboundedPreceding, 0)
    joined = own.withColumn("_hasta", F.coalesce(F.sum(value).over(upto), F.lit(0))).join(carried, [*keys, "_tramo"])
    return joined.withColumn(out, F.col("_hasta") + F.col("_antes")).drop("_hasta", "_antes", "_tramo")


def latest_known(rows: DataFrame, keys: list[str], order: str, values: list[str], width: int = WIDTH, ties: list[str] | None = None) -> DataFrame:
    """Replaces each of ``values`` by the latest that isn't null up to the row; a null never erases what was known."""
    own = _stretched(rows, order, width)
    place = F.struct(order, *(ties or []))
    last = own.groupBy(*keys, "_tramo").agg(*(F.max_by(v, F.when(F.col(v).isNotNull(), place)).alias(f"_u_{v}") for v in values))
    before = Window.partitionBy(*keys).orderBy("_tramo").rowsBetween(Window.unboundedPreceding, -1)
    last = last.select(*keys, "_tramo", *(F.last(f"_u_{v}", ignorenulls=True).over(before).alias(f"_u_{v}") for v in values))
    upto = Window.partitionBy(*keys, "_tramo").orderBy(order, *(ties or [])).rowsBetween(Window.unboundedPreceding, 0)
    found = own.select("*", *(F.last(v, ignorenulls=True).over(upto).alias(f"_v_{v}") for v in values)).join(last, [*keys, "_tramo"])
    return found.withColumns({v: F.coalesce(f"_v_{v}", f"_u_{v}") for v in values}).drop("_tramo", *(f"_{x}_{v}" for v in values for x in "uv"))


def streaks(rows: DataFrame, keys: list[str], order: str, failed: str, out: str = "racha", width: int = WIDTH, ties: list[str] | None = None) -> DataFrame:
    """Adds ``out``: how many rows in a row, up to this one, have ``failed`` true; a row where it isn't starts anew at 0."""
    counted = running_sum(rows.withColumn("_uno", F.lit(1)), keys, order, "_uno", "_n", width, ties)
    marked = counted.withColumn("_ultimo", F.when(F.coalesce(F.col(failed), F.lit(False)), None).otherwise(F.col("_n")))
    known = latest_known(marked, keys, "_n", ["_ultimo"], width)
    return known.withColumn(out, F.col("_n") - F.coalesce("_ultimo", F.lit(0))).drop("_uno", "_n", "_ultimo")
