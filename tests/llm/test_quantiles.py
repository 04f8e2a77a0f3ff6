import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.compare import same
from urdimbre.llm import quantiles as Q


def test_code_is_in_order_and_close(spark):
    values = [0.0, 1e-9, 0.011, 0.5, 1.0, 999.9, 1000.0, 1e6, 1e12, None, float("nan"), float("inf"), -1.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).select(Q.code(F.col("v"))).collect()]
    assert got[9:] == [None] * 4 and got[:9] == sorted(got[:9]) and got[:2] == [0, 0] and got[8] == Q.CODES - 1
    for v, c in list(zip(values, got))[2:8]:
        assert abs(Q.decoded(np.array([c]))[0] / v - 1) < 1.5e-5


def test_dense_ranks_within_bound():
    rng = np.random.default_rng(0)
    for v in (np.exp(rng.normal(8, 0.5, 300_000)), np.minimum(rng.zipf(1.3, 300_000), 1e8).astype(float), rng.uniform(1, 1e5, 300_000)):
        codes = np.sort((np.floor((np.log2(v) - Q.LEAST) * Q.STEP) + 1).astype(np.int64))
        sketch = Q.counters(*np.unique(codes, return_counts=True))
        for p in (0.01, 0.1, 0.5, 0.9, 0.95, 0.99, 0.999):
            rank = np.array([int(np.ceil(p * len(v)))])
            got = Q.invert(sketch, rank)[0]
            low, high = np.searchsorted(codes, got), np.searchsorted(codes, got, "right")
            assert max(0, low + 1 - rank[0], rank[0] - high) <= Q.bound(sketch) * len(v)
        assert Q.bound(sketch) < 0.02


def coded(spark, n, seed):
    return spark.range(n).select(F.concat(F.lit("g"), (F.col("id") % 3).cast("string")).alias("g"), Q.code(F.exp(F.randn(seed) + 7)).alias("m"))


def test_parts_add_up_and_deletions(spark):
    rows = coded(spark, 3000, 1).cache()
    a, b = rows.where("m % 2 = 0"), rows.where("m % 2 = 1")
    whole = Q.merge(Q.build(rows, ("g",), ("m",)))
    parts = Q.merge(Q.build(a, ("g",), ("m",)), Q.build(b, ("g",), ("m",)))
    key = lambda s: sorted((r.grupo, r.n, tuple(r.codigos), tuple(r.cuentas)) for r in s.collect())
    assert key(whole) == key(parts)
    assert key(Q.merge(whole, Q.negated(Q.merge(Q.build(b, ("g",), ("m",)))))) == key(Q.merge(Q.build(a, ("g",), ("m",))))
    got = {r.grupo: r.p50 for r in Q.percentiles(whole).collect()}
    for g in ("g0", "g1", "g2"):
        codes = sorted(r.m for r in rows.where(F.col("g") == g).collect())
        assert got[g] == Q.decoded(np.array([codes[-(-len(codes) // 2) - 1]]))[0]


def test_dense_states_merge(spark):
    rows = coded(spark, 180_000, 2).withColumn("g", F.lit("uno")).cache()
    half = rows.where("m % 2 = 0")
    whole = Q.merge(Q.build(rows, ("g",), ("m",)))
    row = whole.first()
    assert row.contadores is not None and row.n == 180_000
    apart = Q.merge(Q.build(half, ("g",), ("m",)), Q.build(rows.where("m % 2 = 1"), ("g",), ("m",))).first()
    assert apart.contadores == row.contadores
    back = Q.percentiles(Q.merge(whole, Q.negated(Q.build(half, ("g",), ("m",))))).first()
    codes = np.sort(np.array([r.m for r in rows.where("m % 2 = 1").collect()]))
    assert back.n == len(codes)
    place = np.searchsorted(Q.decoded(codes), back.p90) / len(codes)
    assert abs(place - 0.9) < 0.01


def test_empty_and_null(spark):
    rows = spark.createDataFrame([(None, 5, "x"), ("a", None, "x")], "g string, m int, grupo string")
    assert Q.percentiles(Q.merge(Q.build(rows, ("g",), ("m",)))).count() == 0
    assert Q.percentiles(Q.merge(Q.build(rows.limit(0), ("g",), ("m",)))).count() == 0
    gone = Q.build(rows.select(F.lit("a").alias("g"), F.lit(3).alias("m")), ("g",), ("m",))
    assert [(r.n, r.p50) for r in Q.percentiles(Q.merge(gone, Q.negated(gone))).collect()] == [(0, None)]


def test_turns_count_once(spark, folder, duck):
    got = {r.grupo: r.n for r in Q.p3_percentiles(spark, folder).where("agrupacion = 'llamada_id' and medida = 'servidor_total'").collect()}
    want = duck.execute("""select id, count(v) from (select lower(trim(llamada_id)) as id, turno_idx, arg_min(latencia_ms.servidor_total, recibido_ts) filter (latencia_ms.servidor_total >= 0
      and not isnan(latencia_ms.servidor_total) and not isinf(latencia_ms.servidor_total)) as v from turnos where lower(trim(tipo)) = 'turno' and trim(llamada_id) <> '' group by all) group by id having count(v) > 0""").fetchall()
    assert got == dict(want)
    total = {r.medida: r.n for r in Q.p3_total_de_dias(spark, folder).collect()}
    assert set(total) == set(Q.MEASURES)


def test_copies_without_id_count_once(spark):
    spans = ", ".join(f"{m} double" for m in Q.MEASURES[2:])
    kind = f"tipo string, ts string, recibido_ts timestamp, llamada_id string, turno_idx int, latencia_ms struct<cliente_fin_habla_a_audio double, cliente_origen string, servidor_total double, spans struct<{spans}>>, transcripcion string, respuesta string"
    rows = [
        ("a", "2026-01-01T10:00:00Z", 1, "Me duele", "Espere"), (None, "2026-01-01T11:00:00+01:00", 1, "me duele.", "Espere"), (" ", "2026-01-01T10:00:00Z", 1, "Me duele", "Espere"),
        (None, "2026-01-01T10:00:00Z", 1, "Otra cosa", "Espere"), (None, "2026-01-01T10:00:00Z", 2, "Me duele", "Espere"), ("b", "2026-01-01T12:00:00Z", 1, "x", "y"), ("c", "2026-01-01T12:00:00Z", 1, "x", "y"), (None, "2026-01-01T12:00:00Z", 1, "x", "y"),
        (None, None, 1, "Me duele", "Espere"),
    ]
    log = spark.createDataFrame([("turno", ts, None, c, n, (100.0, None, 5.0, (1.0,) * 6), p, a) for c, ts, n, p, a in rows], kind)
    got = sorted((str(r.llamada_id), str(r.dia)) for r in Q.measured_turns(log).collect())
    day = "2026-01-01"
    assert got == sorted([("a", day), ("None", day), ("None", day), ("b", day), ("c", day), ("None", day), ("None", "None")])


def test_batches_are_bounded_by_bytes():
    wide = pa.record_batch({"x": pa.array([b"x" * 1000] * 100)})
    got = list(Q.batched(iter([wide, wide.slice(0, 3)]), 10**6, 10_000))
    assert sum(t.num_rows for t in got) == 103 and max(t.num_rows for t in got) <= 20


def test_control_equals_sql(spark, folder, duck):
    same(Q.p3_control(spark, folder), duck, Q.SQL["p3_control"])


def test_a_task_adds_up_its_counters():
    """Many batches of a wide group leave a task as one state; more wide groups than it holds leave in parts that add up."""
    rng = np.random.default_rng(1)
    batches = [pa.record_batch({"g": pa.array([f"g{k % 3}"] * 60_000), "m": pa.array(rng.integers(0, Q.CODES, 60_000), pa.int32())}) for k in range(12)]
    out = pa.Table.from_batches(list(Q.summarise(("g",), ("m",))(iter(batches))), Q.ARROW_STATE)
    assert sorted(out.column("grupo").to_pylist()) == ["g0", "g1", "g2"] and sum(out.column("n").to_pylist()) == 720_000
