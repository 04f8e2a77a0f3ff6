import tempfile
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urdimbre.operators import corpus
from urdimbre.plans import lineage
from urdimbre.plans.lineage import cut
from urdimbre.sources import jsonl
from urdimbre.streaming import logs

SCHEMA = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])


def test_jsonl(spark):
    root = Path(tempfile.mkdtemp(prefix="spark-"))
    (root / "log.jsonl").write_text('{"a": 1, "b": "x"}\n\n[{"a": 2}]\n{"a": 3, "b"\n"s"\n{"a": 4, "c": 1}\n')
    got = jsonl.read(spark, str(root / "log.jsonl"), SCHEMA)
    assert sorted((r.a, r.b or "") for r in got.collect()) == [(1, "x"), (4, "")]
    assert tuple(jsonl.line_report(spark.read.text(str(root / "log.jsonl")), SCHEMA).first()) == (5, 2, 3)
    assert jsonl.read(spark, str(root / "none.jsonl"), SCHEMA).count() == 0
    jsonl.append(got, str(root / "out"))
    jsonl.append(got, str(root / "out"))
    assert jsonl.read(spark, str(root / "out"), SCHEMA).count() == 4
    assert corpus.too_large(spark, str(root / "out"), 10) and not corpus.too_large(spark, str(root / "out"), 10**6)


def test_files(spark):
    root = Path(tempfile.mkdtemp(prefix="spark-"))
    (root / "rodilla").mkdir()
    (root / "rodilla" / "guia.md").write_text("Uno. Dos.")
    (root / "suelto.txt").write_text("Tres.")
    (root / "no.pdf").write_bytes(b"x")
    assert sorted((r.ruta_relativa, r.escenario) for r in jsonl.files(spark, str(root)).collect()) == [("rodilla/guia.md", "rodilla"), ("suelto.txt", "(raíz)")]
    assert jsonl.missing_columns(spark.range(1), ["id", "x"]) == ["x"]


def test_files_below_a_folder_named_twice(spark):
    root = Path(tempfile.mkdtemp(prefix="spark-")) / "data" / "x+y" / "data"
    (root / "a").mkdir(parents=True)
    (root / "a" / "uno.TXT").write_bytes(b"Uno \xff.")
    got = jsonl.files(spark, str(root)).collect()
    assert [(r.ruta_relativa, r.escenario, r.numero) for r in got] == [("a/uno.TXT", "a", 1)] and got[0].texto.startswith("Uno ")


def test_lines_keep_their_numbers_across_splits(spark):
    root = Path(tempfile.mkdtemp(prefix="spark-"))
    for k in range(2):
        (root / f"{k}.jsonl").write_text("".join(f'{{"a": {i}, "b": "{"x" * (i % 50)}"}}\n' if i % 10 or not i else "roto\n" for i in range(1, 3001)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    lines = jsonl.numbered(spark, str(root))
    assert lines.rdd.getNumPartitions() > 4
    bad = sorted((r.fichero[-7:], r.linea) for r in jsonl.bad_lines(lines, SCHEMA).collect())
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert bad == [(f"{k}.jsonl", i) for k in range(2) for i in range(10, 3001, 10)]


def test_late_rows_are_left_out(spark):
    """Rows behind the watermark change no window that was given; windows given more than once count as last given."""
    root = Path(tempfile.mkdtemp(prefix="spark-"))
    for k, rows in enumerate([[("2026-01-01 10:01:00", 1.0)], [("2026-01-01 10:05:00", 2.0), ("2026-01-01 14:00:00", 1.0)], [("2026-01-01 14:05:00", 1.0)], [("2026-01-01 10:30:00", 99.0), ("2026-01-01 14:10:00", 3.0)]]):
        spark.createDataFrame([("e", t, v) for t, v in rows], "event_type string, ts string, value double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(root / "t"))
        time.sleep(1.1)
    schema = spark.read.parquet(str(root / "t")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(root / "t"))
    got = {str(r.w.start)[11:16]: (r.n, r.suma) for r in logs.drained(logs.event_windows(stream), "update", "late", ["w", "event_type"]).collect()}
    assert got == {"10:00": (2, 3.0), "14:00": (3, 5.0)}


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        class _jsc:
            sc = staticmethod(lambda: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isEmpty": lambda self: True})()})())

        getConf = staticmethod(lambda: type("C", (), {"get": lambda self, k, d=None: d})())

    with pytest.raises(ValueError):
        lineage.shared_folder(type("Session", (), {"sparkContext": Context})())


def test_late_telemetry(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    turns = spark.createDataFrame([("a", 1, "2026-01-01 10:00:00"), ("a", 2, "2026-01-01 10:01:00"), ("z", 9, "2026-01-01 20:00:00")], "llamada string, turno_idx int, en string").withColumn("en", F.to_timestamp("en"))
    patch = spark.createDataFrame([("a", 1, "2026-01-01 10:00:20", 5.0), ("z", 8, "2026-01-01 20:00:00", 1.0)], "llamada string, turno_idx int, en string, ms double").withColumn("en", F.to_timestamp("en"))
    turns.coalesce(1).write.parquet(f"{root}/t")
    patch.coalesce(1).write.parquet(f"{root}/p")
    joined = logs.late_telemetry(logs.tailed(spark, f"{root}/t"), logs.tailed(spark, f"{root}/p"))
    got = {(r.llamada, r.turno_idx): r.ms for r in logs.drained(joined, "append", "late").collect()}
    assert got[("a", 1)] == 5.0 and got.get(("a", 2), None) is None


def test_spells(spark):
    rows = spark.createDataFrame([("u", "2026-01-01 10:00:00"), ("u", "2026-01-01 10:00:01"), ("u", "2026-01-01 10:05:00")], "k string, t string").withColumn("t", F.to_timestamp("t"))
    got = logs.spells(rows, "k", "t", "2 seconds", 2).collect()
    assert len(got) == 1 and got[0].filas == 2 and str(got[0].fin) == "2026-01-01 10:00:01"


def test_cut(spark):
    assert sorted(r.id for r in cut(spark.range(5)).collect()) == list(range(5))
