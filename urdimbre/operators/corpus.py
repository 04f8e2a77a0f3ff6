"""Keeping a table of chunks: inventory, upsert, deletion, manifest, text layer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LAYER = 40


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``new`` in the place of old rows of the same key; of rows of ``new`` with one key the smallest, whole, is kept. Columns by name."""
    rest = [c for c in new.columns if c != key]
    one = new.groupBy(key).agg(F.min(F.struct(*rest)).alias("_m")).select(key, *(F.col("_m")[c].alias(c) for c in rest)) if rest else new.distinct()
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(one, allowMissingColumns=True)


def without(old: DataFrame, column: str, gone: DataFrame) -> DataFrame:
    """Rows whose ``column`` isn't in ``gone``; null stays."""
    return old.join(gone.select(column).distinct(), column, "left_anti")


def counted_of(old: DataFrame, column: str, gone: DataFrame) -> DataFrame:
    """By ``column``: the rows and distinct ids that ``without`` takes away; keys without any have no row."""
    return old.join(gone.select(column).distinct(), column, "left_semi").groupBy(column).agg(F.count("*").alias("filas"), F.count_distinct("id").alias("trozos"))


def inventory(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """``id, trozos_dichos, trozos_hay`` of every document, 0 where it has no chunk; repeated chunk ids count once."""
    have = chunks.groupBy(F.col("documento_id").alias("id")).agg(F.count_distinct(F.col("id")).alias("n"))
    return documents.select("id", F.col("trozos").alias("trozos_dichos")).join(have, "id", "left").select("id", "trozos_dichos", F.coalesce("n", F.lit(0)).alias("trozos_hay"))


def counts(chunks: DataFrame, by: list[str]) -> DataFrame:
    return chunks.groupBy(*by).agg(F.count_distinct("id").alias("trozos"), F.count_distinct("documento_id").alias("documentos"))


def text_layer(pages: DataFrame) -> DataFrame:
    """``documento_id, media, capa``: mean of the trimmed lengths of the pages, and whether it reaches ``LAYER``; a null page has length 0."""
    length = F.length(F.btrim(F.coalesce("texto", F.lit("")), F.lit(" \n\t\r")))
    return pages.groupBy("documento_id").agg(F.round(F.avg(length), 4).alias("media"), (F.avg(length) >= LAYER).alias("capa"))


def manifest(chunks: DataFrame, **parameters) -> DataFrame:
    """One row with what a version of the table holds, and the parameters that it was made with."""
    found = chunks.agg(F.count("*").alias("filas"), F.count_distinct("id").alias("trozos"), F.count_distinct("documento_id").alias("documentos"), F.max(F.length("texto")).alias("mayor"), F.sum(F.length("texto")).alias("caracteres"))
    return found.withColumns({k: F.lit(v) for k, v in parameters.items()}) if parameters else found


def too_large(spark, folder: str, most: int) -> list[tuple[str, int]]:
    """Files of a written table above ``most`` bytes, with their sizes."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(path, True)
    out = []
    while files.hasNext():
        f = files.next()
        if f.getLen() > most:
            out.append((f.getPath().toString(), f.getLen()))
    return sorted(out)
