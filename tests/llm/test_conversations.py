import random
from datetime import datetime, timedelta

import pytest

from tests.compare import same
from urdimbre.llm import conversations as C

LOG = "tipo string, ts string, recibido_ts timestamp_ntz, llamada_id string, turno_idx int, transcripcion string, respuesta string"
START = datetime(2026, 1, 1)


def log(spark, rows):
    return spark.createDataFrame([(t, f"2026-01-01T00:00:{i % 60:02d}Z", START + timedelta(seconds=i), c, n, p, a) for i, (t, c, n, p, a) in enumerate(rows)], LOG)


def whole(call, n=2):
    return [("apertura", call, 0, "", "Hola"), *(("turno", call, i, f"dice {i}", f"responde {i}") for i in range(1, n + 1)), ("cierre", call, None, None, None)]


def left_out(spark, rows, calls):
    told = C.conversations(log(spark, rows))
    found = C.judged(spark.createDataFrame(calls, "llamada_id string, turno_idx int"), told)
    return sorted((r.llamada_id for r in found.where("broken").collect()), key=str)


def test_components_of_random_graphs(spark):
    rng = random.Random(1)
    edges = [(f"{rng.randrange(60):03d}", f"{rng.randrange(60):03d}") for _ in range(45)] + [(f"c{i:04d}", f"c{i + 1:04d}") for i in range(40)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    got = {r.node: r.component for r in C.components(spark.createDataFrame([*edges, (None, "x"), edges[0]], "u string, v string")).collect()}
    assert got == {x: top(x) for x in root}
    assert C.components(spark.createDataFrame([], "u string, v string")).count() == 0


@pytest.mark.parametrize(
    ("rows", "broken"),
    [
        (whole("a"), False),
        (whole("a")[1:], True),
        (whole("a")[:-1], True),
        (whole("a", 1)[:2] + whole("a", 1)[2:], True),
        ([*whole("a"), ("turno", " A ", 1, "DICE  1", None)], False),
        ([*whole("a"), ("turno", "a", 1, "otra cosa", "responde 1")], True),
        ([*whole("a"), ("turno", "a", 2, "[inaudible]", "  ")], False),
        ([whole("a")[0], ("turno", "a", 1, "dice", "..."), ("turno", "a", 2, "", "b"), whole("a")[-1]], True),
        ([whole("a")[0], ("turno", "a", 1, "(ruido)", "x"), ("turno", "a", 2, None, "b"), whole("a")[-1]], True),
        ([*whole("a"), (None, "a", 3, "x", "y"), ("turno", None, 1, "z", "z"), ("turno", "", 2, "z", "z")], False),
        ([*whole("a")[:2], ("TURNO ", "a", 2, "dice 2", None), ("turno", "a", 2, None, "responde 2"), whole("a")[-1]], False),
        ([], True),
    ],
)
def test_judged(spark, rows, broken):
    assert left_out(spark, [*rows, *whole("zz")], [("a", 2), ("zz", 2)]) == (["a"] if broken else [])


def test_edges(spark):
    rows = whole("a")
    assert left_out(spark, rows * 3, [("a", None), (None, 1)]) == [None]
    assert left_out(spark, rows, []) == []
    extra = log(spark, rows).selectExpr("*", "1 as node", "2 as component", "'x' as call", "'y' as kind")
    assert C.judged(spark.createDataFrame([("a", 2)], "llamada_id string, turno_idx int"), C.conversations(extra)).first().broken is False


def test_queries_equal_sql(spark, folder, duck):
    for name in C.SQL:
        same(C.QUERIES[name](spark, folder), duck, C.SQL[name])


def test_rows_without_id_join_what_they_quote(spark, tmp_path):
    at = lambda i: f"2026-01-01T00:00:{i:02d}Z"
    rows = [
        ("apertura", at(0), "a", 0, "", "Hola"), ("turno", at(1), "a", 1, "Me duele", "Espere"), ("turno", at(1), None, 1, "me  duele.", "espere"), ("turno", at(2), "a", 2, "Bien", "Vale"),
        ("turno", "2026-01-01T01:00:01+01:00", " ", 1, "Me duele", "Espere"), ("turno", at(5), None, 4, "Solo", "Sí"), ("turno", at(5), None, 4, "solo", "sí"), ("turno", at(1), None, 2, "Me duele", "Espere"),
        ("turno", at(7), "b", 1, "igual", "igual"), ("turno", at(7), "c", 1, "igual", "igual"), ("turno", at(7), None, 1, "igual", "igual"), ("turno", None, "d", 1, "sin", "hora"), ("turno", None, None, 1, "sin", "hora"),
    ]
    full = spark.createDataFrame([(t, ts, START + timedelta(seconds=i), c, n, p, a) for i, (t, ts, c, n, p, a) in enumerate(rows)], LOG)
    full.write.parquet(f"{tmp_path}/turnos.parquet")
    told = C.conversations(full).collect()
    assert {r.component for r in told if r.call} == {"a", "b", "c", "d"} and all(r.component == r.call for r in told if r.call)
    assert {(r.idx, r.patient.lower()) for r in told if not r.call and r.component == "a"} == {(1, "me  duele.")}
    got = {(r.llamada_id, r.turno_idx, r.hablante, r.texto) for r in C.p1_sin_id(spark, str(tmp_path)).collect()}
    assert got == {
        ("a", 1, "paciente", "me  duele."), ("a", 1, "agente", "espere"), (None, 4, "paciente", "Solo"), (None, 4, "agente", "Sí"), (None, 2, "paciente", "Me duele"), (None, 2, "agente", "Espere"),
        (None, 1, "paciente", "igual"), (None, 1, "agente", "igual"), (None, 1, "paciente", "sin"), (None, 1, "agente", "hora"),
    }


def test_the_search_joins_what_no_single_link_does(spark, monkeypatch):
    """A copy of a copy of a call's turn reaches the call, and replies without ids are one conversation, only by the search."""
    rows = [
        ("apertura", "00:00.000", "a", 0, "", "Hola"), ("turno", "00:10.900", "a", 1, "me duele", "espere"), ("turno", "00:11.500", None, 1, "Me duele", "Espere"), ("turno", "00:12.400", None, 1, "me duele", "espere"), ("turno", "00:13.300", None, 1, "me duele", "espere"),
        ("apertura", "30:00.000", None, 0, "", "Buenas"), ("turno", "30:30.000", None, 1, "quien es", "yo"), ("turno", "31:10.000", None, 2, "vale", "adiós"), ("turno", "50:00.000", None, 3, "tarde", "sí"),
        ("apertura", "40:00.000", None, 0, "", "uno"), ("apertura", "40:01.000", None, 0, "", "dos"), ("turno", "40:20.000", None, 1, "de cuál", "no sé"),
    ]
    log_ = spark.createDataFrame([(t, f"2026-01-01T00:{ts}Z", START + timedelta(seconds=i), c, n, p, a) for i, (t, ts, c, n, p, a) in enumerate(rows)], LOG)

    def groups():
        out = {}
        for r in C.conversations(log_).collect():
            out.setdefault(r.component, []).append((r.idx, r.patient or r.agent))
        return sorted(sorted(x, key=str) for x in out.values())

    got = groups()
    assert [len(x) for x in got if (0, "Hola") in x] == [5]
    assert [(0, "Buenas"), (1, "quien es"), (2, "vale")] in got and [(3, "tarde")] in got and [(1, "de cuál")] in got and [(0, "uno")] in got
    monkeypatch.setattr(C, "components", lambda x: x.groupBy(C.F.col("u").alias("node")).agg(C.F.min("v").alias("component")))
    assert groups() != got
