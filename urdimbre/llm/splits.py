"""Splits that keep related records together.

Rows are related if they share a trajectory or a patient, directly or through other rows. The keys (not the
rows) are the nodes of a graph, and every distinct pair of keys found in a row is a link, so a key that holds
a third of all rows still gives one node. Components come from parallel hooking and shortcutting over a parent
table: every link hooks the larger root of its ends to the smaller one, then parents are replaced by their
parents' parents until trees are flat, and links are rewritten to the roots.

Components are dealt to splits by size: subset-sum bitsets over the multiplicities of the sizes choose, for all
splits but the largest, the set of components whose total is closest to the split's share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from urdimbre.plans.lineage import cut, table

#: Bits of a subset-sum bitset at most; larger totals are counted in units of several rows.
BITS = 1 << 22
#: Bitsets that are kept at most; those between are made again from the last one kept.
KEPT = 32
#: Components of each size that the bitsets choose among at least; of larger numbers the rest is dealt in proportion.
HELD = 16
#: Components ranked in one task at most, about.
RANKED = 200_000


def id_parts(c: Column) -> Column:
    """Runs of letters and of digits of an identifier: lower case, separators and zero padding dropped."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}]+|[0-9]+"), F.lit(0))
    return F.transform(runs, lambda x: F.regexp_replace(x, r"^0+(?=[0-9])", ""))


def trajectory_key(c: Column) -> Column:
    """``tray_pac_<series>_<number>`` of a trajectory id whatever its spelling, its day left out; null if there are no parts."""
    parts = F.slice(id_parts(c), 1, 4)
    return F.when(F.size(parts) > 0, F.concat(F.lit("t:"), F.array_join(parts, "_")))


def patient_key(c: Column) -> Column:
    parts = id_parts(c)
    return F.when(F.size(parts) > 0, F.concat(F.lit("p:"), F.array_join(parts, "_")))


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of undirected links ``a, b`` (strings): the root is the smallest node of the component.

    Links with one null end make the other end a node of its own; loops and repeats change nothing.
    """
    parents = cut(
        links.select(F.explode(F.array("a", "b")).alias("node")).where("node is not null").distinct().withColumn("root", F.col("node"))
    )
    open_links = links.where("a is not null and b is not null and a <> b").select("a", "b").distinct()
    while True:
        hooks = open_links.select(F.greatest("a", "b").alias("root"), F.least("a", "b").alias("to")).groupBy("root").agg(F.min("to").alias("to"))
        tree = cut(hooks)
        if tree.isEmpty():
            return parents
        while True:  # shortcutting: every hooked root points at its parent's parent, until all point at roots
            up = tree.select(F.col("root").alias("to"), F.col("to").alias("next"))
            tree = cut(tree.join(up, "to", "left").select("root", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
            if tree.where("moved").isEmpty():
                break
            tree = tree.drop("moved")
        tree = tree.select("root", "to")
        parents = cut(parents.join(tree, "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        at = lambda end: tree.select(F.col("root").alias(end), F.col("to").alias(f"{end}_to"))
        open_links = cut(
            open_links.join(at("a"), "a", "left").join(at("b"), "b", "left")
            .select(F.coalesce("a_to", "a").alias("a"), F.coalesce("b_to", "b").alias("b")).where("a <> b").distinct()
        )


def grouped(rows: DataFrame) -> DataFrame:
    """``fila_id, grupo`` of every row of a trajectory table; rows without any usable id are groups of their own.

    Repeated ``fila_id`` stay as they are; a null one takes part by its ids, and without ids is the group ``f:``.
    """
    keyed = rows.select("fila_id", trajectory_key(F.col("trayectoria_id")).alias("a"), patient_key(F.col("paciente_id")).alias("b"))
    keyed = cut(keyed)
    found = components(keyed.select("a", "b").distinct())
    own = F.concat(F.lit("f:"), F.coalesce(F.col("fila_id").cast("string"), F.lit("")))
    return (
        keyed.select("fila_id", F.coalesce("a", "b").alias("node")).join(found, "node", "left")
        .select("fila_id", F.coalesce("root", "node", own).alias("grupo"))
    )


def subset_closest(items: list[tuple[int, int]], target: float) -> dict[int, int]:
    """Of ``size, multiplicity`` pairs, how many of each size to take so that their total is closest to ``target``.

    A bitset holds the reachable totals; multiplicities are cut into powers of two, so each size shifts the
    bitset a logarithmic number of times. Totals above twice the target can't be closest and aren't kept. Ties take the smaller
    total. About ``KEPT`` of the bitsets are kept on the way; going back, each stretch between two is made again.
    """
    goal = max(0, round(target))
    mask = (1 << 2 * goal + max((s for s, m in items if m > 0), default=0) + 2) - 1
    pieces = [(size, k) for size, many in items for k in powers(many)]
    step = max(1, -(-len(pieces) // KEPT))
    grown = lambda reach, size, k: (reach | reach << size * k) & mask
    kept, total = [], 1
    for i, (size, k) in enumerate(pieces):
        if i % step == 0:
            kept.append(total)
        total = grown(total, size, k)
    below = total & ((1 << goal + 1) - 1)
    low = below.bit_length() - 1
    above = total >> goal
    high = goal + (above & -above).bit_length() - 1 if above else low
    left = low if abs(low - target) <= abs(high - target) else high
    taken: dict[int, int] = {}
    for block in range(len(kept) - 1, -1, -1):
        own = pieces[block * step : (block + 1) * step]
        reach = [kept[block]]
        for size, k in own[:-1]:
            reach.append(grown(reach[-1], size, k))
        for (size, k), before in zip(reversed(own), reversed(reach)):
            if not before >> left & 1:
                taken[size] = taken.get(size, 0) + k
                left -= size * k
    return taken


def powers(many: int) -> list[int]:
    """Powers of two, and a rest, whose sums are just the numbers up to ``many``."""
    out, k = [], 1
    while many > 0:
        out.append(min(k, many))
        many -= out[-1]
        k *= 2
    return out


def deal(sizes: list[tuple[int, int]], shares: list[tuple[str, float]]) -> dict[int, list[tuple[str, int]]]:
    """For each component size, how many components of it each split gets.

    ``sizes``: size and number of components; ``shares``: split and proportion (normalised here; null and
    negative count as 0; ties by name). Of each size all but ``HELD`` components, or as many as
    make up the largest one, are dealt in proportion to the shares, which leaves
    every split lacking its share of those held back; the bitsets share these out between two splits at a time, again and again
    while that brings their totals closer to what they lack.
    """
    shares = sorted(((name, max(0.0, p or 0.0)) for name, p in shares), key=lambda x: (x[1], x[0]))
    whole = sum(p for _, p in shares) or 1.0
    rows = sum(s * m for s, m in sizes)
    lacks = [rows * p / whole for _, p in shares]
    given = {s: [0] * len(shares) for s, _ in sizes}
    largest = max((s for s, _ in sizes), default=0)
    rest: dict[int, int] = {}
    for s, m in sorted(sizes, reverse=True):
        for i, (_, p) in enumerate(shares):
            given[s][i] = int((m - min(m, max(HELD, -(-largest // s)))) * (p / whole))
            lacks[i] -= s * given[s][i]
        rest[s] = m - sum(given[s])
    # What the splits lack is made up of the components held back: first all are the largest split's, then each pair of splits
    # shares out anew what both hold, until no pair comes closer.
    held = [dict.fromkeys(rest, 0) for _ in shares[:-1]] + [rest]
    off = lambda i: sum(s * k for s, k in held[i].items()) - lacks[i]
    tried = True
    while tried:
        tried = False
        for i in range(len(shares) - 1, -1, -1):
            for j in range(i):
                both = {s: held[i][s] + held[j][s] for s in rest if held[i][s] + held[j][s]}
                before = abs(off(i)) + abs(off(j)), max(abs(off(i)), abs(off(j)))
                if before[0] < 1:
                    continue
                old = held[i], held[j]
                got = shared_out(both, lacks[j] + (off(i) + off(j)) / 2)
                held[j] = {s: got.get(s, 0) for s in rest}
                held[i] = {s: both.get(s, 0) - got.get(s, 0) for s in rest}
                after = abs(off(i)) + abs(off(j)), max(abs(off(i)), abs(off(j)))
                if after[0] < before[0] - 1e-6 or after[0] < before[0] + 1e-6 and after[1] < before[1] - 1e-6:
                    tried = True
                else:
                    held[i], held[j] = old
    for i, own in enumerate(held):
        for s, k in own.items():
            given[s][i] += k
    return {s: [(name, k) for (name, _), k in zip(shares, g) if k] for s, g in given.items()}


def shared_out(have: dict[int, int], target: float) -> dict[int, int]:
    """``subset_closest`` of sizes with multiplicities, counted in units of several rows where the bitset would be too long."""
    unit = -(-max(1, sum(s * m for s, m in have.items())) // BITS)
    by_unit: dict[int, list[int]] = {}
    for s in sorted(have):
        by_unit.setdefault(max(1, round(s / unit)), []).append(s)
    taken = subset_closest([(u, sum(have[s] for s in ss)) for u, ss in by_unit.items()], target / unit)
    out: dict[int, int] = {}
    for u, k in taken.items():
        for s in by_unit[u]:
            out[s] = min(k, have[s])
            k -= out[s]
    return out


def split(rows: DataFrame, shares: DataFrame) -> DataFrame:
    """``fila_id, grupo, particion`` of every row: groups stay whole, splits come near their share of rows.

    ``shares``: ``particion, proporcion``, a table of a few rows. An empty one gives a null split. Only the
    number of groups of each size goes to the driver: sizes that differ number at most the root of twice the rows.
    """
    found = cut(grouped(rows))
    groups = cut(found.groupBy("grupo").agg(F.count("*").alias("filas")))
    spark = rows.sparkSession
    sizes = [(r["filas"], r["n"]) for r in groups.groupBy("filas").agg(F.count("*").alias("n")).collect()]
    wanted = [(r["particion"], r["proporcion"]) for r in shares.select("particion", "proporcion").where("particion is not null").collect()]
    dealt = deal(sizes, wanted) if wanted else {}
    ends = []
    for size, parts in dealt.items():
        upto = 0
        for name, k in parts:
            ends.append((size, upto, upto + k, name))
            upto += k
    plan = spark.createDataFrame(ends, T.StructType([T.StructField("filas", T.LongType()), T.StructField("desde", T.LongType()), T.StructField("hasta", T.LongType()), T.StructField("particion", T.StringType())]))
    buckets = 1 + sum(n for _, n in sizes) // RANKED
    # The place of a group among those of its size: its rank in a hash bucket, after the buckets before it.
    placed = groups.withColumn("cubo", F.pmod(F.xxhash64("grupo"), F.lit(buckets)))
    before = Window.partitionBy("filas").orderBy("cubo").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("filas", "cubo").agg(F.count("*").alias("n")).select("filas", "cubo", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("antes"))
    rank = F.row_number().over(Window.partitionBy("filas", "cubo").orderBy(F.xxhash64(F.lit(1), "grupo"), "grupo")) - 1
    placed = placed.withColumn("puesto", rank).join(starts, ["filas", "cubo"]).withColumn("puesto", F.col("puesto") + F.col("antes"))
    where = (placed["filas"] == plan["filas"]) & (placed["puesto"] >= plan["desde"]) & (placed["puesto"] < plan["hasta"])
    dealt_groups = placed.join(plan, where, "left").select("grupo", "particion")
    return found.join(dealt_groups, "grupo").select("fila_id", "grupo", "particion")


def p4_found(spark, folder: str) -> DataFrame:
    """Of every group of related rows: its smallest ``fila_id`` with each of the others."""
    found = cut(grouped(table(spark, folder, "trayectorias_postop_silver")).where("fila_id is not null"))
    least = found.groupBy("grupo").agg(F.min("fila_id").alias("fila_a"))
    return found.join(least, "grupo").where("fila_id <> fila_a").select("fila_a", F.col("fila_id").alias("fila_b"))


def p4_particiones(spark, folder: str) -> DataFrame:
    """Split of every row of the trajectories."""
    return split(table(spark, folder, "trayectorias_postop_silver"), table(spark, folder, "particiones_objetivo"))


def p4_informe(spark, folder: str) -> DataFrame:
    """Rows, groups and share reached by each split beside the share aimed at."""
    shares = table(spark, folder, "particiones_objetivo").select("particion", "proporcion")
    rows = p4_particiones(spark, folder)
    each = rows.groupBy("particion").agg(F.count("*").alias("filas"), F.count_distinct("grupo").alias("grupos"))
    total = each.agg(F.sum("filas").alias("todas"))
    return (
        shares.join(each, "particion", "left").crossJoin(F.broadcast(total))  # the total is one row
        .select("particion", "proporcion", F.coalesce("filas", F.lit(0)).alias("filas"), F.coalesce("grupos", F.lit(0)).alias("grupos"), (F.coalesce("filas", F.lit(0)) / F.col("todas")).alias("alcanzada"))
    )


def p4_control(spark, folder: str) -> DataFrame:
    """One row: the rows dealt, whether no trajectory and no patient is in two splits, and whether every share is reached to within a
    hundredth of a percent of the rows and the size of the largest group."""
    rows = table(spark, folder, "trayectorias_postop_silver").withColumn("fila_id", F.monotonically_increasing_id())
    rows = cut(rows)
    dealt = cut(split(rows, table(spark, folder, "particiones_objetivo")))
    keyed = rows.select("fila_id", F.explode(F.array_compact(F.array(trajectory_key(F.col("trayectoria_id")), patient_key(F.col("paciente_id"))))).alias("clave"))
    whole = keyed.join(dealt, "fila_id").groupBy("clave").agg(F.count_distinct("particion").alias("n")).agg(F.coalesce(F.max("n") <= 1, F.lit(True)).alias("enteras"))
    shares = table(spark, folder, "particiones_objetivo").where("particion is not null")
    each = shares.join(dealt.groupBy("particion").agg(F.count("*").alias("n")), "particion", "left").na.fill(0, ["n"])
    total = each.agg(F.sum("proporcion").alias("p"), F.sum("n").alias("filas"))
    largest = dealt.groupBy("grupo").agg(F.count("*").alias("m")).agg(F.max("m").alias("mayor"))
    off = F.abs(F.col("n") - F.col("filas") * F.col("proporcion") / F.col("p"))
    near = each.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(largest)).agg(F.max("filas").alias("filas"), F.min(off <= F.greatest(F.col("mayor"), F.col("filas") * 0.0001)).alias("cerca"))  # one row each
    return near.crossJoin(F.broadcast(whole)).select("filas", "enteras", "cerca")  # one row each


KEY_SQL = "array_to_string(list_transform({parts}, lambda x: regexp_replace(x, '^0+([0-9])', '\\1')), '_')"
RUNS_SQL = "regexp_extract_all(lower({c}), '\\p{{L}}+|[0-9]+')"
SQL = {
    "p4_found": f"""
with recursive claves as (
  select fila_id, nullif('t:' || {KEY_SQL.format(parts=RUNS_SQL.format(c='trayectoria_id') + '[1:4]')}, 't:') as a,
    nullif('p:' || {KEY_SQL.format(parts=RUNS_SQL.format(c='paciente_id'))}, 'p:') as b from trayectorias_postop_silver),
lazos as (select distinct a as x, b as y from claves where a is not null and b is not null union select distinct b, a from claves where a is not null and b is not null),
alcance as (
  select k as x, k as y from (select a as k from claves where a is not null union select b from claves where b is not null)
  union select alcance.x, lazos.y from alcance join lazos on alcance.y = lazos.x),
raiz as (select x, min(y) as grupo from alcance group by x),
filas as (select fila_id, grupo from claves join raiz on x = coalesce(a, b)),
menor as (select grupo, min(fila_id) as fila_a from filas group by grupo)
select fila_a, fila_id as fila_b from filas join menor using (grupo) where fila_id <> fila_a""",
}
SQL["p4_control"] = "select count(*) as filas, true as enteras, true as cerca from trayectorias_postop_silver"
QUERIES = {"p4_found": p4_found, "p4_particiones": p4_particiones, "p4_informe": p4_informe, "p4_control": p4_control}
