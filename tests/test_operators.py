import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from urdimbre.functions import stats
from urdimbre.functions import text as tx
from urdimbre.operators import analysis, chunking, corpus, dedup, retrieval, sequences, turnlog
from urdimbre.plans.lineage import spread


def text_of(*parts):
    return " ".join(f"w{i}" for a, b in parts for i in range(a, b))


def test_near_duplicates_by_brute_force(spark):
    rng = random.Random(3)
    base = [[f"p{rng.randrange(500)}" for _ in range(60)] for _ in range(6)]
    docs = []
    for i in range(60):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            words[rng.randrange(60)] = f"q{rng.randrange(99)}"
        docs.append((i, " ".join(words)))
    docs += [(60, None), (61, ""), (62, "corto texto"), (63, docs[0][1])]
    table = spark.createDataFrame(docs, "k int, t string").withColumn("a", F.lit("clash")).withColumn("clase", F.lit(0))
    pairs, members = dedup.near_duplicates(table, "k", "t")
    sets = {}
    for k, t in docs:
        w = (t or "").split()
        if t is not None and not any(t == docs[j][1] for j in sets):
            sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    assert {(r.a, r.b) for r in pairs.collect()} == want and want
    assert {r.k: r.clase for r in members.collect()}[63] == 0 and members.count() == 63


def test_short_texts_have_no_shingles(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "uno dos tres cuatro"), (4, "uno dos tres cuatro cinco"), (5, "a b c d e a b c d e a")], "k int, t string")
    assert {r.k: r.n for r in dedup.shingles(docs, "k", "t").collect()} == {1: 0, 2: 0, 3: 0, 4: 1, 5: 5}
    assert {r.n for r in dedup.shingles(docs, "k", "t", shortest=20).collect()} == {0}


def test_spread_keeps_rows(spark):
    few, many = (spark.range(0, 50, 1, n) for n in (1, 16))
    assert spread(few).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread(many).rdd.getNumPartitions() == 16
    assert sorted(r.id for r in spread(few).collect()) == list(range(50))


def test_kept_first_chain(spark):
    a, b, c = text_of((0, 100)), text_of((8, 108)), text_of((16, 116))
    docs = spark.createDataFrame([(1, a), (2, b), (3, c), (4, b), (5, a), (6, "otro")], "k int, t string")
    got = {r.k: (r.gemelo, r.motivo) for r in dedup.kept_first(docs, "k", "t").collect()}
    assert got == {1: (None, None), 2: (1, "solapamiento"), 3: (None, None), 4: (1, "solapamiento"), 5: (1, "exacto"), 6: (None, None)}
    assert dedup.kept_first(docs.limit(0), "k", "t").count() == 0


def pages(spark, rows):
    return spark.createDataFrame(rows, "clave string, numero int, texto string")


def test_chunks(spark):
    text = " ".join(f"Esta es la frase número {i} de la guía." for i in range(200))
    got = [r.texto for r in chunking.chunks(pages(spark, [("d", 1, text)]), 300, 60).orderBy("indice").collect()]
    assert all(len(t) <= 300 for t in got) and len(got) > 10
    assert all(" ".join(a.split()[-4:]) in b for a, b in zip(got, got[1:]))
    plain = [r.texto for r in chunking.chunks(pages(spark, [("d", 1, text)]), 300, 0).orderBy("indice").collect()]
    assert " ".join(plain) == text
    long = [r.texto for r in chunking.chunks(pages(spark, [("d", 1, "palabra " * 200)]), 120, 20).collect()]
    assert all(len(t) <= 120 and set(t.split()) == {"palabra"} for t in long)


def test_chunk_pages_and_edges(spark):
    two = chunking.chunks(pages(spark, [("d", 1, "Alfa. " * 30), ("d", 2, "Beta. " * 30), ("d", 2, "Beta. " * 30), ("d", 3, None), ("e", 1, " \n ")]), 100, 0).orderBy("indice").collect()
    assert two[0].pagina == 1 and two[-1].pagina == 2 and {r.clave for r in two} == {"d"}
    with pytest.raises(ValueError):
        chunking.chunks(pages(spark, []), 100, 100)
    assert chunking.chunks(pages(spark, []), 100, 10).count() == 0


def test_chunks_by_search_over_all_ends(spark):
    """Every chunk is the longest run of units that fits, and repeats the fewest last units that are long enough, whatever the stretch."""
    rng = random.Random(8)
    words = lambda: " ".join("x" * rng.randrange(1, 12) for _ in range(rng.randrange(1, 14)))
    docs = {d: [(n, "".join(words() + rng.choice([". ", "! ", "\n\n", "; ", ", ", " "]) for _ in range(rng.randrange(0, 9)))) for n in range(1, 24)] for d in ("a", "b")}
    docs["c"] = [(n, "sin punto " * 30) for n in range(1, 9)] + [(9, "fin.")]
    rows = [(d, n, t) for d, ps in docs.items() for n, t in ps]
    got = [sorted((r.clave, r.indice, r.pagina, r.texto) for r in chunking.chunks(pages(spark, rows), 120, 30, 20, stretch=w).collect()) for w in (1, 2, 5, 200)]
    assert got[0] == got[1] == got[2] == got[3]
    clean = {(r.clave, r.numero): r.t for r in pages(spark, rows).select("clave", "numero", tx.normalized(F.col("texto")).alias("t")).collect()}
    for d, ps in docs.items():
        own, _ = chunking.units([(n, clean[d, n]) for n, _ in ps if clean[d, n]], 120, True)
        text, size = [t.strip() for _, t in own], [len(t) for _, t in own]
        assert "".join("".join(text).split()) == "".join("".join(clean[d, n] for n, _ in ps).split()) and max(size) <= 120
        want, i, new = [], 0, 0
        while new < len(own):
            fits = [e for e in range(new + 1, len(own) + 1) if sum(size[i:e]) + e - i - (new == i) <= 120]
            end = max(fits, default=new + 1)
            body = " ".join(text[i:end])
            if not want or len(body) >= 20:
                want.append((d, len(want), own[i][0], body))
            if end == len(own):
                break
            back = max([s for s in range(i, end + 1) if sum(size[s:end]) + end - s >= 30], default=i)
            i = next(s for s in range(back, end + 1) if sum(size[s:end]) + end - s + size[end] <= 120 or s == end)
            new = end
        assert [x for x in got[0] if x[0] == d] == want


@pytest.mark.parametrize("how", ["linear", "nearest", "floor"])
def test_percentiles_with_an_outlier_and_one_group(spark, how):
    rng = np.random.default_rng(9)
    values = [float(x) for x in rng.normal(0, 1, 3000)] + [1e300, -1e300]
    rows = [("a", v) for v in values] + [("b", float(i % 3)) for i in range(500)] + [("b", None), ("b", float("nan")), (None, 7.0), ("c", None)]
    table = spark.createDataFrame(rows, "g string, v double").withColumn("_v", F.lit("clash")).repartition(4)
    got = {r.g: r for r in stats.percentiles(table, ["g"], "v", {"x": 0.0, "y": 0.37, "z": 1.0}, how).collect()}
    assert set(got) == {"a", "b", None}
    for g, own in (("a", values), ("b", [float(i % 3) for i in range(500)]), (None, [7.0])):
        for k, q in (("x", 0.0), ("y", 0.37), ("z", 1.0)):
            at = q * (len(own) - 1)
            want = np.quantile(own, q) if how == "linear" else sorted(own)[round(at) if how == "nearest" else int(at)]
            assert abs(got[g][k] - want) <= 1e-9 * max(1, abs(want)), (g, k)
    assert stats.percentiles(table.limit(0), ["g"], "v", {"x": 0.5}, how).count() == 0
    one = stats.percentiles(table.where("g = 'a'"), [], "v", {"x": 0.5}, how).collect()
    assert len(one) == 1 and abs(one[0].x) < 0.2


def test_near_duplicates_on_skewed_shingles(spark):
    """A phrase that all texts share is no meeting place; a family of near copies keeps every link."""
    rng = random.Random(6)
    phrase = [f"c{i}" for i in range(12)]
    docs = [(i, " ".join(phrase + [f"u{i}x{j}" for j in range(40)])) for i in range(80)]
    base = [f"f{i}" for i in range(100)]
    for i in range(80, 100):
        w = list(base)
        w[rng.randrange(100)] = f"z{i}"
        docs.append((i, " ".join(w)))
    pairs = {(r.a, r.b) for r in dedup.near_duplicates(spark.createDataFrame(docs, "k int, t string"), "k", "t")[0].collect()}
    sets = {k: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for k, t in docs}
    assert pairs == {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8} and len(pairs) > 100
    assert dedup.near_duplicates(spark.createDataFrame(docs, "k int, t string"), "k", "t", shortest=200)[0].count() == 0


def test_running_values_by_brute_force(spark):
    rng = random.Random(5)
    rows = [(k, i, rng.choice([None, 1, 2, 3]), rng.random() < 0.6) for k in "ab" for i in range(100)]
    table = spark.createDataFrame(rows, "k string, i int, v int, f boolean")
    sums = {(r.k, r.i): r.s for r in sequences.running_sum(table, ["k"], "i", "v", "s", width=7).collect()}
    last = {(r.k, r.i): r.v for r in sequences.latest_known(table, ["k"], "i", ["v"], width=7).collect()}
    run = {(r.k, r.i): r.racha for r in sequences.streaks(table, ["k"], "i", "f", width=7).collect()}
    for key in "ab":
        total, known, streak = 0, None, 0
        for k, i, v, f in rows:
            if k == key:
                total, known, streak = total + (v or 0), known if v is None else v, streak + 1 if f else 0
                assert (sums[k, i], last[k, i], run[k, i]) == (total, known, streak)


def test_dense_top(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(300, 8))
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(900, None)], "id bigint, vector array<double>").repartition(5)
    got = {(r.consulta, r.puesto): r.id for r in retrieval.dense_top(rows, rows.where("id % 100 = 0"), 10).collect()}
    unit = m / np.linalg.norm(m, axis=1)[:, None]
    for q in (0, 100, 200):
        score = np.round(unit @ unit[q], 6)
        want = sorted(range(300), key=lambda i: (-score[i], i))[:10]
        assert [got[q, p] for p in range(1, 11)] == want
    assert retrieval.dense_top(rows, rows.limit(0), 10).count() == 0


def test_best_by_label_has_no_pool(spark, tmp_path):
    """A query whose 70 nearest rows have another label still has its own worst score; the hybrid score is fused for each alpha."""
    from urdimbre.plans import queries

    rng = np.random.default_rng(4)
    m = np.vstack([[1.0, 0, 0], np.column_stack([np.ones(70), rng.uniform(0, 0.1, (70, 2))]), [[0.2, 1, 0], [0.1, 1, 0]]])
    labels = [0, *[1] * 70, 0, None]
    words = ["rodilla herida fiebre", *["paseo largo"] * 70, "la rodilla y la fiebre", "rodilla"]
    spark.createDataFrame([(i, [float(x) for x in v], lab) for i, (v, lab) in enumerate(zip(m, labels))], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame(list(enumerate(words)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    unit = m / np.linalg.norm(m, axis=1)[:, None]
    near, far = round(float(unit[71] @ unit[0]), 6), round(float(max(unit[1:71] @ unit[0])), 6)
    got = {r.alfa: r for r in queries.alpha_sweep(spark, str(tmp_path)).collect()}
    assert abs(got[1.0].peor_propia - near) < 2e-6 and abs(got[1.0].mejor_ajena - far) < 2e-6
    n = len(words)
    idf = {"rodill": np.log(1 + n / 4), "herida": np.log(1 + n / 2), "fiebre": np.log(1 + n / 3)}
    cover = (idf["rodill"] + idf["fiebre"]) / sum(idf.values())
    found = queries.alpha_sweep_hybrid(spark, str(tmp_path)).collect()
    assert len(found) == len(queries.ALPHAS) and [r.alfa for r in found if r.mejor_alfa] == [0.0]
    for r in found:
        assert r.consultas == 1 and abs(r.peor_propia - (near if r.alfa == 1 else r.alfa * near + (1 - r.alfa) * cover)) < 2e-6
        assert abs(r.mejor_ajena - r.alfa * far) < 2e-6


def test_threshold_keeps_each_by_itself(spark):
    rows = spark.createDataFrame([(1, 0.8), (1, 0.31), (1, 0.72), (2, 0.21)], "consulta int, puntos double")
    assert [r.puntos for r in retrieval.sufficient(rows, 0.35).collect()] == [0.8, 0.72]


def test_corrections(spark):
    log = spark.createDataFrame([("a", 1, None), ("a", 2, 5.0), ("b", 1, 7.04)], "llamada string, turno_idx int, ms double")
    patch = spark.createDataFrame([("a", 1, 3.0, 1), ("a", 1, 4.0, 2), ("z", 1, 9.0, 1), ("b", 1, None, 5)], "llamada string, turno_idx int, ms double, en int")
    assert {(r.llamada, r.turno_idx): r.ms for r in turnlog.corrected(log, patch).collect()} == {("a", 1): 4.0, ("a", 2): 5.0, ("b", 1): 7.0}


def test_upsert_and_delete(spark):
    old = spark.createDataFrame([("1", "x"), ("2", "y"), (None, "z")], "id string, t string")
    new = spark.createDataFrame([("2", "Y"), ("3", "Z"), ("3", "Z")], "id string, t string")
    once = corpus.upsert(old, new, "id")
    assert sorted(r.t for r in once.collect()) == ["Y", "Z", "x", "z"]
    assert sorted(r.t for r in corpus.upsert(once, new, "id").collect()) == ["Y", "Z", "x", "z"]
    assert sorted(r.t for r in corpus.without(old, "id", new).collect()) == ["x", "z"]


def test_analyses_on_small_tables(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0), (None, 9.0)], "g string, v double")
    got = {r.g: (r.minimo_resto, r.maximo_resto) for r in analysis.without_each(rows, "g", "v").collect()}
    assert got == {"a": (2.0, 3.0), "b": (1.0, 3.0), "c": (1.0, 2.0)}
    cells = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (None, "z"), (3, None)], "a int, b string")
    assert sorted((r.a, r.b) for r in analysis.zero_cells(cells, "a", "b").collect()) == [(1, "z"), (2, "y"), (2, "z"), (3, "x"), (3, "y"), (3, "z")]
    assert analysis.zero_cells(cells.limit(0), "a", "b").count() == 0
    day = {(r.a, r.b): r.n for r in analysis.described_on(cells.withColumn("v", F.lit(2.0)), "a", [1, 9], "b", "v").collect()}
    assert day[1, "x"] == 1 and day[9, "x"] == 0 and day[9, None] == 0
    labels = spark.createDataFrame([("Español", "es"), ("raro", "es"), ("raro", "en"), (None, "fr")], "etiqueta string, codigo string")
    assert [r.l for r in analysis.coded(spark.createDataFrame([(" ESPAÑOL ",), ("raro",), (None,)], "l string"), "l", labels).orderBy(F.col("l").desc()).collect()] == ["es", None, None]
    ids = spark.createDataFrame([("Pac-007 / 01",), ("pac_7_1",), ("--",), (None,)], "i string").select(tx.plain_id(F.col("i")).alias("i")).collect()
    assert [r.i for r in ids] == ["pac_7_1", "pac_7_1", None, None]
    report = analysis.key_report(rows.withColumnRenamed("g", "k"), rows.limit(0).withColumnRenamed("g", "k"), "k").first()
    assert tuple(report) == (0, 3, 0)
    assert analysis.sweep(rows.limit(0), "g", "v", [1.0]).count() == 0


def test_highest_with_ties():
    rng = np.random.default_rng(2)
    for span in (2, 5, 1000):
        score = rng.integers(0, span, (4, 300)).astype(float)
        ids = np.broadcast_to(rng.permutation(300), score.shape)
        got, at = retrieval.highest(score, ids, 7)
        for r in range(4):
            want = sorted(zip(-score[r], ids[r]))[:7]
            assert [(-a, b) for a, b in zip(got[r], at[r])] == want
