"""The log as a stream: tailed counts, late telemetry, spells of speech."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urdimbre.plans.lineage import new_folder


def drained(stream: DataFrame, mode: str, name: str, keys: list[str] | None = None) -> DataFrame:
    """What a stream has given once all its present input is read, written to the shared folder.

    ``append`` rows are final. ``update`` gives the changed rows of each batch: of the rows of the same ``keys`` the last counts, so
    the stream keeps no state of closed windows. ``complete`` gives everything anew with each batch and suits small results only.
    """
    spark = stream.sparkSession
    base = new_folder(spark, f"stream-{name}")
    writer = stream.writeStream.option("checkpointLocation", f"{base}/at").outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{base}/out").start()
    elif mode == "complete":
        query = writer.foreachBatch(lambda batch, k: batch.write.mode("overwrite").parquet(f"{base}/out")).start()
    else:  # a batch that is run again replaces its own rows
        query = writer.foreachBatch(lambda batch, k: batch.write.mode("overwrite").parquet(f"{base}/out/_lote={k}")).start()
    query.awaitTermination()
    if mode != "update":
        return spark.read.schema(stream.schema).parquet(f"{base}/out")
    rest = [c for c in stream.columns if c not in keys]
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("_lote", T.LongType())])).parquet(f"{base}/out")
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_lote").alias("_u"))
    return last.select(*(F.col(c) if c in keys else F.col("_u")[c].alias(c) for c in stream.columns))


def tailed(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, a folder or one file, read as a stream of its files."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return stream.parquet(path)
    return stream.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())


def event_windows(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by type in tumbling windows of their time; in append and update mode rows of windows that the watermark has closed are left out."""
    return events.withColumn("en", F.col("ts").cast("timestamp")).withWatermark("en", late).groupBy(F.window("en", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("suma"))


def late_telemetry(turns: DataFrame, patches: DataFrame, late: str = "1 hour") -> DataFrame:
    """Turns ``llamada, turno_idx, en`` with the patch ``ms`` of the same turn that arrives within ``late``, or null once none can come."""
    a = turns.withWatermark("en", late).alias("a")
    b = patches.select(F.col("llamada").alias("_l"), F.col("turno_idx").alias("_t"), F.col("en").alias("_en"), "ms").withWatermark("_en", late)
    same = (F.col("llamada") == F.col("_l")) & (F.col("turno_idx") == F.col("_t")) & (F.col("_en") >= F.col("en")) & (F.col("_en") <= F.col("en") + F.expr(f"interval {late}"))
    return a.join(b, same, "left").select("llamada", "turno_idx", "en", "ms")


def spells(events: DataFrame, key: str, time: str, gap: str, least: int) -> DataFrame:
    """Spells of a key with pauses below ``gap`` and at least ``least`` rows: start, end, rows. Works on tables and streams."""
    found = events.groupBy(F.session_window(F.col(time).cast("timestamp"), gap).alias("w"), key).agg(F.count("*").alias("filas"), F.max(F.col(time).cast("timestamp")).alias("fin"))
    return found.where(F.col("filas") >= least).select(key, F.col("w.start").alias("inicio"), "fin", "filas")
