import random

from tests.compare import same
from urdimbre.llm import splits as S

ROWS = "fila_id bigint, trayectoria_id string, paciente_id string, grupo string, node string"


def rows(spark, given):
    return spark.createDataFrame([(*r, "clash", "clash") for r in given], ROWS)


def test_spellings_are_one(spark):
    given = [(1, "tray_pac_77_0000012_3", "pac_77_12"), (2, " TRAY-PAC-77-12-7", None), (3, None, "PAC 77 0012 "), (4, "tray_pac_77_13", None), (5, "tray_pac_77_13_2", "pac_9_9"), (6, None, None), (7, "", " "), (8, None, None), (None, "tray_pac_77_13_5", None)]
    got = {}
    for r in S.grouped(rows(spark, given)).collect():
        got.setdefault(r.grupo, set()).add(r.fila_id)
    assert sorted(map(lambda s: sorted(map(str, s)), got.values())) == [["1", "2", "3"], ["4", "5", "None"], ["6"], ["7"], ["8"]]


def test_components_of_random_graphs(spark):
    rng = random.Random(2)
    edges = [(f"t{rng.randrange(80):02d}", f"p{rng.randrange(80):02d}") for _ in range(70)] + [(f"t9{i:03d}", f"p9{i + d:03d}") for i in range(60) for d in (0, 1)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    got = {r.node: r.root for r in S.components(spark.createDataFrame([*edges, edges[0]], "a string, b string")).collect()}
    assert got == {x: top(x) for x in root}


def test_subset_by_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        items = [(s, rng.randrange(1, 4)) for s in rng.sample(range(1, 20), 4)]
        target = rng.uniform(0, sum(s * m for s, m in items))
        taken = S.subset_closest(items, target)
        assert all(taken.get(s, 0) <= m for s, m in items) and set(taken) <= {s for s, _ in items}
        reach = {0}
        for s, m in items:
            reach = {x + s * k for x in reach for k in range(m + 1)}
        assert abs(sum(s * k for s, k in taken.items()) - target) == min(abs(x - target) for x in reach)


def test_deal():
    dealt = S.deal([(1, 1000), (7, 3), (300, 1)], [("a", 0.8), ("b", 0.1), ("c", 0.1)])
    total = {}
    for s, parts in dealt.items():
        for name, k in parts:
            total[name] = total.get(name, 0) + s * k
    assert sum(total.values()) == 1321 and abs(total["b"] - 132.1) < 1 and abs(total["c"] - 132.1) < 1
    assert S.deal([(2, 4)], [("x", None), ("y", 0.0)])[2]


def test_split_keeps_groups_and_shares(spark):
    rng = random.Random(5)
    given = [(i, f"tray_pac_1_{rng.randrange(300)}_{i % 30}", rng.choice([None, f"pac_1_{rng.randrange(300)}"])) for i in range(1500)]
    given += [(5000 + i, f"tray_pac_1_9999_{i}", "pac_1_9999") for i in range(400)]
    shares = spark.createDataFrame([("train", 0.8), ("val", 0.1), ("test", 0.1)], "particion string, proporcion double")
    found = S.split(rows(spark, given), shares).collect()
    assert len(found) == len(given)
    of, size = {}, {}
    for r in found:
        assert of.setdefault(r.grupo, r.particion) == r.particion
        size[r.particion] = size.get(r.particion, 0) + 1
    assert sum(size.values()) == 1900
    assert S.split(rows(spark, []), shares).count() == 0
    assert {r.particion for r in S.split(rows(spark, given[:5]), shares.limit(0)).collect()} == {None}


def test_query_equals_sql(spark, folder, duck):
    same(S.p4_found(spark, folder), duck, S.SQL["p4_found"])


def test_report(spark, folder):
    got = {r.particion: r for r in S.p4_informe(spark, folder).collect()}
    assert abs(sum(r.alcanzada for r in got.values()) - 1) < 1e-9
    assert all(abs(r.alcanzada - r.proporcion) < 0.02 for r in got.values())


def test_bitsets_are_bounded_and_exact(monkeypatch):
    """Few kept bitsets give the totals that all give, and thousands of sizes take little room."""
    import random
    import tracemalloc

    rng = random.Random(2)
    for kept in (1, 3, 1000):
        monkeypatch.setattr(S, "KEPT", kept)
        for _ in range(30):
            items = [(rng.randrange(1, 30), rng.randrange(0, 5)) for _ in range(rng.randrange(0, 8))]
            items = list({s: (s, m) for s, m in items}.values())
            target = rng.uniform(0, 150)
            totals = {0}
            for s, m in items:
                totals = {t + s * k for t in totals for k in range(m + 1)}
            got = S.subset_closest(items, target)
            total = sum(s * k for s, k in got.items())
            assert all(k <= dict(items)[s] for s, k in got.items()) and abs(total - target) == min(abs(t - target) for t in totals)
    monkeypatch.setattr(S, "KEPT", 32)
    tracemalloc.start()
    got = S.deal([(s, 1) for s in range(1, 3001)], [("a", 0.8), ("b", 0.1), ("c", 0.1)])
    assert tracemalloc.get_traced_memory()[1] < 150e6
    tracemalloc.stop()
    rows = 3000 * 3001 // 2
    each = {name: sum(s * k for s, parts in got.items() for n, k in parts if n == name) for name in "abc"}
    assert sum(each.values()) == rows and abs(each["b"] - rows / 10) <= 3000 and abs(each["c"] - rows / 10) <= 3000
