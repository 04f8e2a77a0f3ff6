"""Logs of one JSON object per line, and files of text."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

SUFFIXES = (".txt", ".md", ".markdown")
BROKEN = "_ilegible"


def parsed(lines: DataFrame, schema: T.StructType, column: str = "value") -> DataFrame:
    """Objects of the lines in ``column``; blank lines, broken ones and JSON that isn't an object are skipped."""
    own = lines.where(F.btrim(column).startswith("{"))
    wide = T.StructType([*schema.fields, T.StructField(BROKEN, T.StringType())])
    got = own.select(F.from_json(column, wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN}).alias("r"))
    return got.where(f"r.{BROKEN} is null").select("r.*").drop(BROKEN)


def read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Objects of the log at ``path``; a missing file has none."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return parsed(spark.read.text(path), schema)


def line_report(lines: DataFrame, schema: T.StructType, column: str = "value") -> DataFrame:
    """One row: lines that aren't blank, objects among them, and lines that can't be read."""
    full = lines.where(F.btrim(column) != "")
    good = parsed(full, schema, column).agg(F.count("*").alias("objetos"))
    return full.agg(F.count("*").alias("lineas")).crossJoin(good).withColumn("ilegibles", F.col("lineas") - F.col("objetos"))  # one row each


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """``fichero, linea, value`` of the lines of text files under ``path``, numbered from 1 in each file.

    Lines of a split of a file come in order, so a line's number is its place in the split after the lines of the splits before.
    """
    split = [F.col("_metadata.file_path").alias("fichero"), F.col("_metadata.file_block_start").alias("_desde")]
    rows = spark.read.option("recursiveFileLookup", True).text(path).select("value", *split, F.monotonically_increasing_id().alias("_id"))
    before = Window.partitionBy("fichero").orderBy("_desde").rowsBetween(Window.unboundedPreceding, -1)
    splits = rows.groupBy("fichero", "_desde").agg(F.count("*").alias("_n"), F.min("_id").alias("_primera"))
    starts = splits.select("fichero", "_desde", "_primera", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_antes"))
    return rows.join(starts, ["fichero", "_desde"]).select("fichero", (F.col("_antes") + F.col("_id") - F.col("_primera") + 1).alias("linea"), "value")


def bad_lines(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """Of ``numbered`` lines those that are neither blank nor a JSON object."""
    wide = T.StructType([*schema.fields, T.StructField(BROKEN, T.StringType())])
    read = F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN})
    good = F.btrim("value").startswith("{") & read[BROKEN].isNull()
    return lines.where((F.btrim("value") != "") & ~F.coalesce(good, F.lit(False)))


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def files(spark: SparkSession, root: str) -> DataFrame:
    """``ruta_relativa, escenario, numero, texto`` of the text files under ``root``, each one page (numero 1).

    The first folder below ``root`` is the scenario, ``(raíz)`` without one. Bytes that aren't UTF-8 become the replacement character.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    base = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toUri().getPath().rstrip("/") + "/"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    at = F.instr("path", F.lit(base))
    kept = found.withColumn("ruta_relativa", F.expr("path").substr(at + len(base), F.length("path"))).where(F.lower("path").rlike("(" + "|".join(map(re.escape, SUFFIXES)) + ")$"))
    first = F.when(F.contains("ruta_relativa", F.lit("/")), F.split("ruta_relativa", "/")[0]).otherwise("(raíz)")
    return kept.select("ruta_relativa", first.alias("escenario"), F.lit(1).alias("numero"), F.make_valid_utf8(F.col("content").cast("string")).alias("texto"))


def missing_columns(rows: DataFrame, wanted: list[str]) -> list[str]:
    """Columns that a table lacks, for a warning."""
    return [c for c in wanted if c not in rows.columns]
