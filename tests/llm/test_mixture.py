import numpy as np
from pyspark.sql import functions as F

from urdimbre.llm import mixture as M


def test_permutations():
    for n in (1, 2, 3, 10, 257, 1000):
        j = np.arange(n)
        one, two = (M.permuted(j, np.full(n, n), np.full(n, k)) for k in (5, 6))
        assert sorted(one) == list(j) and sorted(two) == list(j)
        assert n < 10 or list(one) != list(two)


def test_draws_hit_the_quotas(spark, monkeypatch):
    monkeypatch.setattr(M, "DRAWN", 3)  # several rounds of halving
    quota = {"a": 1234, "b": 77, "c": 0, "d": 5}
    got = sorted((r.fragmento, r.fuente, r.desde, r.n, r.lugar, r.total) for r in M.draws(spark, quota, shard=100).collect())
    total, sizes = {}, {}
    for k, s, first, n, place, size in got:
        assert first == total.get(s, 0) and place == sizes.get(k, 0) and size == (100 if k < 13 else 16)
        total[s] = total.get(s, 0) + n
        sizes[k] = sizes.get(k, 0) + n
    assert total == {"a": 1234, "b": 77, "d": 5} and sizes == {k: 100 if k < 13 else 16 for k in range(14)}
    assert M.draws(spark, {}).count() == 0


def test_halves_are_multinomial():
    """Counts of a half have the mean and nearly the spread of a multinomial draw, and never exceed a quota."""
    quota, rng = np.array([600, 300, 100]), np.random.default_rng(3)
    got = np.array([M.halved(quota, (200, 800), rng) for _ in range(2000)])
    assert (got.sum(1) == 200).all() and (got <= quota).all()
    share = quota / 1000
    assert np.abs(got.mean(0) - 200 * share).max() < 1 and np.abs(got.var(0) / (200 * share * (1 - share)) - 1).max() < 0.15


def test_quotas():
    assert M.quotas([("a", 1, 1, 100), ("b", 1, 2, 10), ("z", 5, 3, 0)]) == {"a": 20, "b": 20}
    assert M.quotas([("a", 1, 1, 100), ("b", 1, 2, 10)], total=100) == {"a": 50, "b": 20}
    assert M.quotas([]) == {}


def documents(spark):
    rows = [(i, "grande", list(range(i % 7))) for i in range(400)] + [(1000 + i, "chica", [9] * 5) for i in range(20)] + [(2000, None, [1, 2]), (2001, "otra", [])]
    return spark.createDataFrame(rows, "doc_id bigint, fuente string, ids array<int>").withColumn("n", F.lit("clash"))


def test_packing_keeps_every_token(spark):
    docs = documents(spark)
    blocks = M.packed(docs.drop("n"), 16).collect()
    assert sum(len(b.ids) for b in blocks if b.fuente == "grande") == sum(i % 7 for i in range(400))
    full = {}
    for b in blocks:
        full.setdefault(b.fuente, []).append((b.bloque, len(b.ids)))
    for own in full.values():
        own.sort()
        assert [k for k, _ in own] == list(range(len(own))) and all(n == 16 for _, n in own[:-1])
    assert M.packed(docs.drop("n").limit(0), 16).count() == 0


def test_mixture(spark):
    blocks = M.cut(M.packed(documents(spark).drop("n"), 16))
    goal = M.targets(spark.createDataFrame([("GRANDE ", 3.0, 1), ("chi-ca", 0.5, 2), ("Chica", 0.5, 4), ("falta", 2.0, 1), ("otra", None, 1), (None, 1.0, 1)], "source string, peso double, tope_repeticiones int"))
    found = M.mix(blocks, goal, shard=10).collect()
    uses = {}
    for r in found:
        uses[r.fuente, r.bloque] = uses.get((r.fuente, r.bloque), 0) + 1
    cap = {"grande": 1, "chica": 2}
    assert all(n <= cap[s] for (s, _), n in uses.items())
    share = sum(r.fuente == "grande" for r in found) / len(found)
    assert abs(share - 0.75) < 0.03
    assert len({(r.fragmento, r.posicion) for r in found}) == len(found)
    assert M.mix(blocks, goal.limit(0)).count() == 0


def test_report(spark, folder):
    for r in M.p7_informe(spark, folder).collect():
        assert r.usos <= r.tope or r.tokens_mezcla == 0
        assert abs((r.alcanzada or 0) - r.posible) < 0.05
