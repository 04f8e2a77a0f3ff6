"""Mixtures of sources at target weights.

The token streams of each source (its documents in a pseudorandom order) are packed into blocks of a fixed
length. The size of the mixture is chosen so that every source reaches its share without any block being used
more often than its cap allows, or given; then a source short of blocks stays at its cap. The mixture has shards of
one size. The counts of the sources in the shards are drawn from a multinomial without exceeding the quotas:
the shards are halved again and again, and each half draws its counts from the quotas of the whole, all halves of one
round in parallel, so the shards together hit the quotas. The slots of a source are numbered, and slot j takes block
perm(j mod blocks) of round j div blocks, where perm is a Feistel permutation keyed by source and round: blocks are
joined by that index.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from urdimbre.llm import tokens
from urdimbre.plans.lineage import cut, table

BLOCK = 256
#: Shards of a mixture at most, and slots of a shard at least.
SHARDS, SHARD = 4096, 16
#: Shards that one task draws at most.
DRAWN = 256
#: Documents ranked in one task at most, about.
RANKED = 200_000
SEED = 17


def plain_source(c: Column) -> Column:
    """Name of a source without case, blanks, ``-`` and ``_``; blank is null."""
    return F.nullif(F.regexp_replace(F.lower(c), r"[\s _-]+", ""), F.lit(""))


def targets(goal: DataFrame) -> DataFrame:
    """``fuente, peso, tope`` by plain name; spellings of one source are added up, with their lowest cap.

    Rows without a usable weight (null, NaN, not positive) set no target; a null cap counts as 1, a negative as 0.
    """
    usable = goal.select(plain_source(F.col("source")).alias("fuente"), "peso", F.greatest(F.lit(0), F.coalesce("tope_repeticiones", F.lit(1))).alias("tope"))
    usable = usable.where("fuente is not null and peso > 0 and not isnan(peso) and peso < double('infinity')")
    return usable.groupBy("fuente").agg(F.sum("peso").alias("peso"), F.min("tope").alias("tope"))


def packed(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Blocks ``fuente, bloque, ids, documentos`` of documents ``doc_id, fuente, ids``: all of ``block`` tokens but each source's last.

    Documents without tokens are in no block. Order within a source is by hash of ``doc_id``; offsets are sums
    over hash buckets and then within a bucket, so no task ranks a whole source.
    """
    sized = docs.where("fuente is not null and size(ids) > 0").withColumn("n", F.size("ids").cast("long")).withColumn("h", F.xxhash64(F.lit(SEED), "doc_id"))
    buckets = 1 + docs.count() // RANKED
    # Buckets are ranges of the hash, so that the order of buckets and hashes is one order.
    sized = sized.withColumn("cubo", F.floor((F.shiftrightunsigned("h", 33)) * buckets / F.lit(1 << 31)))
    before = Window.partitionBy("fuente").orderBy("cubo").rowsBetween(Window.unboundedPreceding, -1)
    starts = sized.groupBy("fuente", "cubo").agg(F.sum("n").alias("m")).select("fuente", "cubo", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("antes"))
    within = Window.partitionBy("fuente", "cubo").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("desde", F.coalesce(F.sum("n").over(within), F.lit(0))).join(starts, ["fuente", "cubo"])
    placed = placed.withColumn("desde", F.col("desde") + F.col("antes"))
    first, last = F.floor(F.col("desde") / block), F.floor((F.col("desde") + F.col("n") - 1) / block)
    pieces = placed.select("fuente", "doc_id", "ids", "desde", "n", F.explode(F.sequence(first, last)).alias("bloque"))
    low = F.greatest(F.lit(0), F.col("bloque") * block - F.col("desde"))
    high = F.least(F.col("n"), (F.col("bloque") + 1) * block - F.col("desde"))
    cuts = pieces.select("fuente", "bloque", F.struct((F.col("desde") + low).alias("at"), F.slice("ids", (low + 1).cast("int"), (high - low).cast("int")).alias("ids"), "doc_id").alias("p"))
    joined = cuts.groupBy("fuente", "bloque").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    return joined.select("fuente", "bloque", F.flatten(F.transform("ps", lambda p: p["ids"])).alias("ids"), F.array_distinct(F.transform("ps", lambda p: p["doc_id"])).alias("documentos"))


def quotas(sources: list[tuple[str, float, int, int]], total: int | None = None) -> dict[str, int]:
    """Slots of each source from ``name, weight, cap, blocks``: the largest mixture with every share reached, or of ``total`` slots."""
    there = [(s, w, cap * n) for s, w, cap, n in sources if cap * n > 0]
    whole = sum(w for _, w, _ in there)
    if total is None:
        total = min((room * whole / w for _, w, room in there), default=0)
    return {s: min(room, round(total * w / whole)) for s, w, room in there}


def halved(quota: np.ndarray, sizes: tuple[int, int], rng: np.random.Generator) -> np.ndarray:
    """Of the ``quota`` of each source what goes to the first half of ``sizes`` slots: multinomial counts, what a draw takes beyond a quota drawn again."""
    got, need = np.zeros_like(quota), sizes[0]
    while need:
        left = (quota - got).astype(float)
        got = np.minimum(got + rng.multinomial(need, left / left.sum()), quota)
        need = sizes[0] - int(got.sum())
    return got


def parted(part: dict, shard: int, seed: int) -> list[dict]:
    """The two halves of a run of shards: ``first, last`` (shards), ``counts`` and ``taken`` (of each source, in it and before it)."""
    first, last, counts, taken = part["first"], part["last"], np.array(part["counts"], np.int64), np.array(part["taken"], np.int64)
    middle = (first + last) // 2
    near = halved(counts, ((middle - first) * shard, int(counts.sum()) - (middle - first) * shard), np.random.default_rng((seed, first, last)))
    return [
        {"first": first, "last": middle, "counts": near.tolist(), "taken": taken.tolist()},
        {"first": middle, "last": last, "counts": (counts - near).tolist(), "taken": (taken + near).tolist()},
    ]


def _drawn(shard: int, seed: int, below: int) -> Callable:
    """Halves runs of shards until they have ``below`` shards or fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in b.to_pylist():
                open_, done = [part], []
                while open_:
                    p = open_.pop()
                    if p["last"] - p["first"] <= below:
                        done.append(p)
                    else:
                        open_ += parted(p, shard, seed)
                    if done and (len(done) >= 1000 or not open_):
                        yield pa.RecordBatch.from_pylist(done, schema=RUN_ARROW)
                        done = []

    return run


RUN = "first bigint, last bigint, counts array<bigint>, taken array<bigint>"
RUN_ARROW = pa.schema([("first", pa.int64()), ("last", pa.int64()), ("counts", pa.list_(pa.int64())), ("taken", pa.list_(pa.int64()))])


def draws(spark, quota: dict[str, int], shard: int | None = None, seed: int = SEED) -> DataFrame:
    """``fragmento, fuente, desde, n, lugar, total``: for every shard and source the first slot of the source, how many slots, the first
    place in the shard and the shard's size. The driver makes one row; the halves of long runs are drawn in parallel."""
    names = [s for s, n in sorted(quota.items()) if n]
    slots = sum(quota[s] for s in names)
    if not slots:
        return spark.createDataFrame([], "fragmento int, fuente string, desde bigint, n bigint, lugar bigint, total bigint")
    shard = shard or max(SHARD, -(-slots // SHARDS))
    shards = -(-slots // shard)
    rows = spark.createDataFrame([(0, shards, [quota[s] for s in names], [0] * len(names))], RUN)
    below = shards
    while below > 1:  # each round makes at most ``DRAWN`` parts of a run
        below = max(1, -(-below // DRAWN))
        rows = rows.mapInArrow(_drawn(shard, seed, below), RUN)
        rows = rows.repartition("first") if below > 1 else rows
    each = F.explode(F.transform("counts", lambda n, i: F.struct(F.get(F.array(*map(F.lit, names)), i).alias("fuente"), F.get("taken", i).alias("desde"), n.alias("n"), F.aggregate(F.slice("counts", F.lit(1), i), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("lugar")))).alias("x")
    total = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return rows.select(F.col("first").cast("int").alias("fragmento"), total.alias("total"), each).select("fragmento", "x.fuente", "x.desde", "x.n", "x.lugar", "total").where("n > 0")


def permuted(j: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Image of each ``j`` < ``n`` under the permutation of 0..n-1 named by ``key``: a Feistel network over the
    next power of four, walked until the image is below n."""
    half = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, open_ = j.astype(np.uint64), np.ones(len(j), bool)
    while open_.any():
        x, h, m, k = out[open_], half[open_], mask[open_], key[open_].astype(np.uint64)
        left, right = x >> h, x & m
        for turn in range(4):
            f = (right + k + np.uint64(turn * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            left, right = right, (left ^ (f >> np.uint64(33))) & m
        out[open_] = left << h | right
        open_ = out >= n.astype(np.uint64)
    return out.astype(np.int64)


#: Slots that are named at once, and about how many a task names.
NAMED, SLOTS = 100_000, 50_000


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Block and place of the slots of each drawn count."""
    for b in batches:
        shard, key, blocks, first, count, place, size = (b.column(c).to_numpy() for c in ("fragmento", "clave", "bloques", "desde", "n", "lugar", "total"))
        upto = np.cumsum(count)
        for at in range(0, int(upto[-1]) if len(upto) else 0, NAMED):
            slot = np.arange(at, min(at + NAMED, upto[-1]))
            row = np.searchsorted(upto, slot, side="right")
            own = slot - (upto - count)[row]
            j = first[row] + own
            turn = j // blocks[row]
            block = permuted(j % blocks[row], blocks[row], key[row] + turn * 1_000_003)
            spot = permuted(place[row] + own, size[row], shard[row].astype(np.int64) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(shard[row], pa.int32()), pa.array(spot, pa.int64()), b.column("fuente").take(pa.array(row)), pa.array(block, pa.int64()), pa.array(turn, pa.int32())], names=["fragmento", "posicion", "fuente", "bloque", "vuelta"])


def mix(blocks: DataFrame, goal: DataFrame, total: int | None = None, shard: int | None = None, seed: int = SEED) -> DataFrame:
    """``fragmento, posicion, fuente, bloque, vuelta, ids, documentos``: the mixture of ``blocks`` (written already) for the ``targets``.

    ``vuelta`` counts the earlier uses of the block. Sources without target or blocks are left out; without any the
    result is empty. The driver gets a row per source with a target; the shards are drawn by tasks.
    """
    spark = blocks.sparkSession
    have = blocks.groupBy("fuente").agg(F.count("*").alias("n"))
    sources = [(r["fuente"], r["peso"], r["tope"], r["n"]) for r in goal.join(have, "fuente").orderBy("fuente").collect()]
    n = {s: b for s, _, _, b in sources}
    keys = {s: seed * 1_000_000_007 + i * 998_244_353 for i, s in enumerate(sorted(n))}
    of = F.create_map(*(F.lit(x) for s in sorted(n) for x in (s, F.struct(F.lit(keys[s]).cast("bigint").alias("clave"), F.lit(n[s]).cast("bigint").alias("bloques"))))) if n else F.lit(None)
    quota = quotas(sources, total)
    drawn = draws(spark, quota, shard, seed)
    if not n:
        return drawn.limit(0).select("fragmento", F.lit(0).cast("bigint").alias("posicion"), "fuente", F.lit(0).cast("bigint").alias("bloque"), F.lit(0).alias("vuelta"), F.array().cast("array<int>").alias("ids"), F.array().cast(blocks.schema["documentos"].dataType).alias("documentos"))
    plan = drawn.withColumn("o", of[F.col("fuente")]).select("fragmento", "fuente", "o.clave", "o.bloques", "desde", "n", "lugar", "total")
    slots = plan.repartition(1 + sum(quota.values()) // SLOTS, "fragmento", "fuente").mapInArrow(_slots, "fragmento int, posicion bigint, fuente string, bloque bigint, vuelta int")
    return slots.join(blocks, ["fuente", "bloque"]).select("fragmento", "posicion", "fuente", "bloque", "vuelta", "ids", "documentos")


def corpus_blocks(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    rows = docs.where("text is not null and text <> ''").select(F.struct("doc_id", plain_source(F.col("source")).alias("fuente")).alias("k"), "text")
    coded = tokens.encode(rows, "k", "text")
    return cut(packed(cut(coded.select("k.doc_id", "k.fuente", "ids"))))


def p7_mezcla(spark, folder: str) -> DataFrame:
    """The mixture, block by block, with the documents that each holds."""
    return mix(corpus_blocks(spark, folder), targets(table(spark, folder, "mezcla_objetivo")))


def p7_informe(spark, folder: str) -> DataFrame:
    """Of every source with a target: ``fuente, objetivo, posible, alcanzada`` (shares), ``tokens_corpus, tokens_mezcla`` and the most often
    that a block is used beside its cap. ``objetivo`` is the share among all targets, ``posible`` that among sources with documents."""
    blocks = corpus_blocks(spark, folder)
    goal = targets(table(spark, folder, "mezcla_objetivo"))
    used = mix(blocks, goal).groupBy("fuente").agg(F.sum(F.size("ids")).alias("tokens_mezcla"), F.max(F.col("vuelta") + 1).alias("usos"))
    have = blocks.groupBy("fuente").agg(F.sum(F.size("ids")).alias("tokens_corpus"))
    every = Window.partitionBy(F.lit(0))  # one row per source with a target
    there = F.when(F.col("tokens_corpus") > 0, F.col("peso")).otherwise(0.0)
    return (
        goal.join(have, "fuente", "left").join(used, "fuente", "left").na.fill(0)
        .select("fuente", (F.col("peso") / F.sum("peso").over(every)).alias("objetivo"), F.try_divide(there, F.sum(there).over(every)).alias("posible"), F.try_divide("tokens_mezcla", F.sum("tokens_mezcla").over(every)).alias("alcanzada"), "tokens_corpus", "tokens_mezcla", "usos", "tope")
    )


def p7_control(spark, folder: str) -> DataFrame:
    """Of every source in the mixture: whether its blocks are used within its cap and its slots hit its quota, and whether the shards
    are full (but the last), hold each place once and hold the source in counts that vary as drawn ones do (not all alike, where it could)."""
    blocks = corpus_blocks(spark, folder)
    goal = targets(table(spark, folder, "mezcla_objetivo"))
    found = cut(mix(blocks, goal).select("fragmento", "posicion", "fuente", "bloque"))
    shards = found.groupBy("fragmento").agg(F.count("*").alias("n"), F.count_distinct("posicion").alias("k"), F.max("posicion").alias("z"))
    ends = shards.agg(F.max("fragmento").alias("ultimo"), F.count("*").alias("fragmentos"), F.max("n").alias("lleno"), F.min((F.col("n") == F.col("k")) & (F.col("z") + 1 == F.col("n"))).alias("lugares"))
    full = shards.crossJoin(F.broadcast(ends)).agg(F.min((F.col("n") == F.col("lleno")) | (F.col("fragmento") == F.col("ultimo"))).alias("llenos"), F.max("lugares").alias("lugares"), F.max("fragmentos").alias("fragmentos"))  # one row
    uses = found.groupBy("fuente", "bloque").agg(F.count("*").alias("u")).groupBy("fuente").agg(F.max("u").alias("usos"), F.sum("u").alias("n"))
    each = found.groupBy("fuente", "fragmento").agg(F.count("*").alias("m")).groupBy("fuente").agg(F.count_distinct("m").alias("cuentas"))
    have = blocks.groupBy("fuente").agg(F.count("*").alias("b"))
    room = goal.join(have, "fuente").where("tope > 0").withColumn("todo", F.sum("peso").over(Window.partitionBy(F.lit(0))))
    total = room.agg(F.min(F.col("tope") * F.col("b") * F.col("todo") / F.col("peso")).alias("total"))
    right = F.abs(F.col("n") - F.least(F.col("tope") * F.col("b"), F.round(F.col("total") * F.col("peso") / F.col("todo")))) <= 1
    return (
        room.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(full)).join(uses, "fuente").join(each, "fuente")  # one row each
        .select("fuente", (F.col("usos") <= F.col("tope")).alias("tope_cumplido"), right.alias("cuota_cumplida"), "llenos", "lugares", ((F.col("cuentas") > 1) | (F.col("n") < 2 * F.col("fragmentos")) | (F.col("fragmentos") < 3)).alias("sorteada"))
    )


_PLAIN = r"nullif(regexp_replace(lower(source), '[\s\x{a0}_-]+', '', 'g'), '')"
SQL = {
    "p7_control": f"""
with metas as (select {_PLAIN} as fuente, sum(peso) as peso, min(greatest(0, coalesce(tope_repeticiones, 1))) as tope from mezcla_objetivo where peso > 0 and not isnan(peso) and {_PLAIN} is not null group by all)
select fuente, true as tope_cumplido, true as cuota_cumplida, true as llenos, true as lugares, true as sorteada from metas
where tope > 0 and fuente in (select {_PLAIN} from documents where text <> '')""",
}
QUERIES = {"p7_mezcla": p7_mezcla, "p7_informe": p7_informe, "p7_control": p7_control}
