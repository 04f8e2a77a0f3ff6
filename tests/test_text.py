import unicodedata

import pytest
from pyspark.sql import functions as F

from urdimbre.functions import stats
from urdimbre.functions import text as tx


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("given", "wanted"),
    [("apendicec-\ntomía", "apendicectomía"), ("uno    dos\ntres", "uno dos\ntres"), ("a\x00b", "a b"), ("a\r\n\r\n\r\nb", "a\n\nb"), (None, None), ("", ""), (" \n\t ", "")],
)
def test_normalized(spark, given, wanted):
    assert one(spark, given, tx.normalized) == wanted


def test_accents_are_those_of_unicode(spark):
    assert all(unicodedata.normalize("NFD", a)[0] == b for a, b in zip(tx.ACCENTED, tx.BARE))
    assert one(spark, "Después, ¡ATENCIÓN!: la herida.", tx.canonical_words) == ["despues", "atencion", "la", "herida"]
    assert one(spark, None, tx.canonical_words) == []


@pytest.mark.parametrize(
    ("given", "wanted"), [("¿Puedo?", True), ("como debo lavarla", True), ("  Cuándo vuelvo", True), ("comodidad", False), ("me duele", False), ("", False), (None, False)]
)
def test_asks(spark, given, wanted):
    assert one(spark, given, tx.asks) is wanted


@pytest.mark.parametrize(("given", "wanted"), [("según el protocolo", "es"), ("the patient and their pain", "en"), ("12 34", "indeterminado"), ("", "indeterminado"), (None, "indeterminado")])
def test_language(spark, given, wanted):
    assert one(spark, given, tx.guessed_language) == wanted


def test_json(spark):
    for given in ('{"a": 1}', '```json\n{"a": 1}\n```', 'Claro: {"a": 1}}', '{"a": 1} y más'):
        assert one(spark, given, lambda c: F.get_json_object(tx.json_object(c), "$.a")) == "1"
    assert one(spark, "nada", tx.json_object) is None


def test_numbers(spark):
    assert [one(spark, x, tx.to_float) for x in ("37,5", "38", " 39.24 ", "caliente", None)] == [37.5, 38.0, 39.24, None, None]
    assert [one(spark, x, tx.to_integer) for x in ("7", "6.0", "3.5", "muchísimo", None)] == [7, 6, None, None, None]


def test_quote_and_snippet(spark):
    row = spark.createDataFrame([("ME DUELE, mucho", "hoy me duele mucho"), ("", "x"), (None, "x"), ("otra", None)], "q string, t string")
    assert [r[0] for r in row.select(tx.quoted(F.col("q"), F.col("t"))).collect()] == [True, False, False, False]
    assert one(spark, "a  b\nc", lambda c: tx.snippet(c, 10)) == "a b c"
    assert one(spark, "x" * 200, lambda c: tx.snippet(c, 100)) == "x" * 99 + "…"


def test_percentiles(spark):
    rows = spark.createDataFrame([(v,) for v in (100.0, 200.0, 300.0, 400.0)], "v double")
    own = stats.percentiles(rows, [], "v", {f"p{i}": p for i, p in enumerate((0.5, 0.95, 0.0, 1.0))}, "linear", 1).first()
    assert list(own) == [250.0, 385.0, 100.0, 400.0]
    assert list(stats.by_rank(rows.withColumn("k", F.lit(1)), ["k"], "v", {"a": 0.5}, nearest=True).first()) == [1, 300.0]
    assert list(stats.by_rank(rows.withColumn("k", F.lit(1)), ["k"], "v", {"a": 0.5}, nearest=False).first()) == [1, 200.0]
    assert stats.percentiles(rows.limit(0), [], "v", {"a": 0.5}, "linear").count() == 0


def test_wilson_and_sums(spark):
    row = spark.createDataFrame([(6, 6), (0, 0)], "k int, n int").select(*stats.wilson(F.col("k"), F.col("n"))).collect()
    assert round(row[0][0], 3) == 0.61 and round(row[0][1], 9) == 1.0 and tuple(row[1]) == (None, None)
    pair = spark.createDataFrame([(1, None), (None, None), (2, 3)], "a int, b int").select(stats.add(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in pair] == [1, None, 5]


def test_windows_and_value_with_quote(spark):
    text = spark.createDataFrame([("a" * 2500,), ("",), (None,), ("b" * 700,)], "t string")
    assert [[len(w) for w in r.w] for r in text.select(tx.windows(F.col("t")).alias("w")).collect()] == [[1200, 1200], [], [], [700]]
    rows = spark.createDataFrame([('{"x": {"valor": 3, "cita": "tres"}}',), ('{"x": {"valor": 3, "cita": 3}}',), ('{"x": 3}',), ('{"x": {"valor": null, "cita": "a"}}',), ("no",), (None,)], "j string")
    got = [(r.v, r.c) for r in rows.select(*(c.alias(k) for c, k in zip(tx.value_and_quote(F.col("j"), "x"), "vc"))).collect()]
    assert got == [("3", "tres")] + [(None, None)] * 5
