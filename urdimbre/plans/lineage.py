"""Cutting a plan's lineage with a table written to the cluster's shared folder."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_owned: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """Folder of ``spark.checkpoint.dir``. On one machine (tests) a temporary one is set where the session has none; on a cluster that is an error."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
    return current.get().rstrip("/")


def new_folder(spark: SparkSession, kind: str) -> str:
    """A new path in the application's own part of the shared folder, which goes when the driver ends."""
    own = f"{shared_folder(spark)}/urdimbre-{spark.sparkContext.applicationId}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.mkdirs(path) and own not in _owned:
        files.deleteOnExit(path)
        _owned.add(own)
    return f"{own}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later jobs neither recompute it nor lose it with an executor."""
    spark = df.sparkSession
    path = new_folder(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Has Spark delete the shuffles of jobs that nothing refers to any more, which else stay until the driver's memory fills."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    """Into how many parts the session shuffles; asked for by number, they aren't merged when they are small."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a scan before costly work on each: dealt to all cores if the files have fewer parts than that, else left as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows
