"""Percentiles of very large numeric columns from dyadic Count-sketches.

A value is encoded as one of 2^20 codes, in order and within 0.0014 % of the value. A state summarises the
codes of one group and measure. It holds one signed sketch for each binary resolution of the codes: for the
ten coarsest the nodes fit the width and are counted exactly (the finest of them is kept, the others are its
sums); for each of the ten finer ones a Count-sketch of ``DEPTH`` signed rows of ``WIDTH`` counters. A rank is
inverted by descending the resolutions, choosing the left or right half by the estimated count of the left.

States of parts (partitions, days, files) are merged by addition; counts may be negative, so parts can also be
taken away again. While a state has few distinct codes it is held as its counts by code (``codigos``,
``cuentas``), the vector of which the sketches are linear functions; past ``SPARSE`` codes it is turned into
counters (``contadores``). Percentiles of the first form have the error of the code alone; of the second form
the rank also errs, by at most the stated share ``cota`` of the count. It is the sum over the sketched levels of
sqrt(8 R / WIDTH), where R is the second moment of the level without its heaviest WIDTH / 8 cells (the tail bound of
a Count-sketch, of which the median of ``DEPTH`` rows is taken), read off the counters themselves.

The percentile p of n values is the value of rank ceil(p * n), the smallest having rank 1.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urdimbre.llm.conversations import NO_CALL, SAYS_SQL, WORDS_SQL, plain_id, words
from urdimbre.plans.lineage import cut, table

LEVELS, EXACT, DEPTH, WIDTH = 20, 10, 5, 1024
CODES = 1 << LEVELS
#: Distinct codes from which a state is held as counters.
SPARSE = 4_000
#: States of counters (0.4 MB each) that a task adds up before it sends them, bytes of states added at once, and parts that the counters of a key are first added in.
HELD, BYTES, SALTS = 64, 64 << 20, 64
#: Rows summarised at once in a task.
ROWS = 200_000
#: Turns of one call that are put into the same task; longer calls are spread.
SALT = 512
OCTAVES, LEAST = 40, -10
STEP = CODES / OCTAVES
MASK = (1 << 64) - 1
MEASURES = ("cliente_fin_habla_a_audio", "servidor_total", "stt", "extraccion", "politica", "rag", "redaccion", "tts")
PERCENTILES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
STATE = "agrupacion string, grupo string, medida string, n bigint, codigos array<int>, cuentas array<bigint>, contadores binary"
ARROW_STATE = pa.schema([("agrupacion", pa.string()), ("grupo", pa.string()), ("medida", pa.string()), ("n", pa.int64()), ("codigos", pa.list_(pa.int32())), ("cuentas", pa.list_(pa.int64())), ("contadores", pa.binary())])
KEY = ("agrupacion", "grupo", "medida")


def code(value: Column) -> Column:
    """Code of a measure in ms: 0 below 2^-10 (so also 0 ms), the last from 2^30 on; null for unusable values
    (null, NaN, infinite, negative)."""
    usable = value.isNotNull() & ~F.isnan(value) & (value >= 0) & (value < float("inf"))
    at = F.floor((F.log2(value) - LEAST) * STEP) + 1
    return F.when(usable, F.when(value < 2.0**LEAST, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(CODES - 1), at))).cast("int"))


def decoded(codes: np.ndarray) -> np.ndarray:
    """Middle of what each code stands for."""
    return np.where(codes == 0, 0.0, np.exp2((codes - 0.5) / STEP + LEAST))


def places(nodes: np.ndarray, level: int, row: int) -> tuple[np.ndarray, np.ndarray]:
    """Counter and sign of tree nodes in a row of a level's sketch, by multiply-shift hashing."""
    seed = 2 * (level * DEPTH + row) + 1
    add, times = (np.uint64(seed * k & MASK) for k in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))
    h = (nodes.astype(np.uint64) + add) * (times | np.uint64(1))
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(64 - 10)).astype(np.int64), np.where(h >> np.uint64(20) & np.uint64(1), 1, -1).astype(np.int64)


def counters(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Counters of the sketches of a vector of counts by code."""
    out = [np.bincount(codes >> LEVELS - EXACT, counts, 1 << EXACT)]
    for level in range(EXACT + 1, LEVELS + 1):
        for row in range(DEPTH):
            cell, sign = places(codes >> LEVELS - level, level, row)
            out.append(np.bincount(cell, sign * counts, WIDTH))
    return np.rint(np.concatenate(out)).astype(np.int64)


def invert(sketch: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Codes of ranks (from 1), by descending the levels."""
    exact = np.cumsum(sketch[: 1 << EXACT])
    node = np.minimum(np.searchsorted(exact, ranks), (1 << EXACT) - 1)
    left = ranks - np.where(node > 0, exact[node - 1], 0)
    total = sketch[node]
    for level in range(EXACT + 1, LEVELS + 1):
        rows = sketch[(1 << EXACT) + (level - EXACT - 1) * DEPTH * WIDTH :]
        both = []
        for child in (node * 2, node * 2 + 1):
            seen = []
            for row in range(DEPTH):
                cell, sign = places(child, level, row)
                seen.append(sign * rows[row * WIDTH + cell])
            both.append(np.median(seen, axis=0))
        # The parent's count is known better than its halves': the difference is shared between them.
        low = np.clip(both[0] + (total - both[0] - both[1]) / 2, 0, np.maximum(total, 0))
        right = left > low
        left = np.where(right, left - low, left)
        total = np.where(right, total - low, low)
        node = node * 2 + right
    return node


def batched(batches: Iterator[pa.RecordBatch], rows: int, size: int = BYTES) -> Iterator[pa.Table]:
    """Batches put together up to ``rows`` rows, or ``size`` bytes, cut where one has more bytes."""
    held, n, full = [], 0, 0
    for whole in batches:
        step = max(1, whole.num_rows * size // max(whole.nbytes, 1)) if whole.nbytes > size else max(whole.num_rows, 1)
        for at in range(0, whole.num_rows, step):
            b = whole.slice(at, step)
            held.append(b)
            n, full = n + b.num_rows, full + whole.nbytes * b.num_rows // whole.num_rows
            if n >= rows or full >= size:
                yield pa.Table.from_batches(held)
                held, n, full = [], 0, 0
    if n:
        yield pa.Table.from_batches(held)


def states(keys: pa.Table, ends: np.ndarray, codes: np.ndarray, counts: np.ndarray, dense: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """State rows: of key i the codes up to ``ends[i]``, or all of it in the counters ``dense[i]``."""
    starts = np.concatenate([[0], ends[:-1]])
    sums = np.concatenate([[0], np.cumsum(counts)])
    n = sums[ends] - sums[starts]
    for i in np.flatnonzero(ends - starts > SPARSE):
        if i not in dense:
            dense[i] = counters(codes[starts[i] : ends[i]], counts[starts[i] : ends[i]])
    for i, c in dense.items():
        n[i] = c[: 1 << EXACT].sum()
    blobs = [None] * len(ends)
    for i, c in dense.items():
        blobs[i] = c.tobytes()
    if dense:
        keep = np.ones(len(codes), bool)
        for i in dense:
            keep[starts[i] : ends[i]] = False
        kept = np.concatenate([[0], np.cumsum(keep)])
        offsets, codes, counts = kept[np.concatenate([[0], ends])], codes[keep], counts[keep]
    else:
        offsets = np.concatenate([[0], ends])
    offsets = pa.array(offsets, pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x, t)) for x, t in ((codes, pa.int32()), (counts, pa.int64()))]
    out = pa.table([*(keys.column(k) for k in KEY), pa.array(n, pa.int64()), *lists, pa.array(blobs, pa.binary())], schema=ARROW_STATE)
    yield from out.to_batches(max_chunksize=10_000 if not dense else 100)


def bound(sketch: np.ndarray) -> float:
    """Share of the count by which a rank read from the counters may err."""
    n = sketch[: 1 << EXACT].sum()
    rows = np.sort(sketch[1 << EXACT :].reshape(LEVELS - EXACT, DEPTH, WIDTH).astype(float) ** 2, axis=2)
    tail = np.median(rows[:, :, : WIDTH - WIDTH // 8].sum(2), axis=1)
    return float(np.sqrt(8 * tail / WIDTH).sum() / n) if n > 0 else 0.0


def summarise(groupings: tuple[str, ...], measures: tuple[str, ...]) -> Callable:
    """States of the rows of each task: one for every value of every grouping column, and measure."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for part in batched(batches, ROWS):
            for grouping in groupings:
                named = part.column(grouping).combine_chunks().dictionary_encode()
                if isinstance(named, pa.ChunkedArray):
                    named = named.combine_chunks()
                groups = named.indices.to_numpy(zero_copy_only=False)
                packed = []
                for m, name in enumerate(measures):
                    own = part.column(name).to_numpy()
                    use = ~np.isnan(own) & ~np.isnan(groups) if own.dtype.kind == "f" or groups.dtype.kind == "f" else np.ones(len(own), bool)
                    packed.append((groups[use].astype(np.int64) * len(measures) + m) << LEVELS | own[use].astype(np.int64))
                cells, counts = np.unique(np.concatenate(packed), return_counts=True)
                if not len(cells):
                    continue
                own = cells >> LEVELS
                last = np.flatnonzero(np.append(own[1:] != own[:-1], True))
                starts = np.append(0, last[:-1] + 1)
                wide = last + 1 - starts > SPARSE
                for i in np.flatnonzero(wide):  # counters are added up over the task
                    k, mine = own[last[i]], slice(starts[i], last[i] + 1)
                    key = (grouping, named.dictionary[int(k // len(measures))].as_py(), measures[k % len(measures)])
                    held[key] = held.pop(key, 0) + counters(cells[mine] & CODES - 1, counts[mine])
                    if len(held) > HELD:
                        first = next(iter(held))
                        yield from dense_states({first: held.pop(first)})
                keep = np.repeat(~wide, last + 1 - starts)
                cells, counts, at = cells[keep], counts[keep], own[last[~wide]]
                ends = np.cumsum((last + 1 - starts)[~wide])
                if len(at):
                    keys = pa.table({
                        "agrupacion": pa.array([grouping] * len(at), pa.string()), "grupo": named.dictionary.take(pa.array(at // len(measures))).cast(pa.string()),
                        "medida": pa.array(measures, pa.string()).take(pa.array(at % len(measures))),
                    })
                    yield from states(keys, ends, cells & CODES - 1, counts.astype(np.int64), {})
        yield from dense_states(held)

    return run


def dense_states(held: dict[tuple, np.ndarray]) -> Iterator[pa.RecordBatch]:
    if held:
        keys = pa.table({k: pa.array([key[i] for key in held], pa.string()) for i, k in enumerate(KEY)})
        none = np.zeros(0, np.int64)
        yield from states(keys, np.zeros(len(held), np.int64), none, none, dict(enumerate(held.values())))


def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the states of equal keys, which come one after another."""
    held: pa.Table | None = None
    for part in batched(batches, 50_000):
        part = part if held is None else pa.concat_tables([held, part])
        new = runs(part)
        held = sum_runs(part.slice(new[-1]), np.array([0]))
        if new[-1]:
            yield from sum_runs(part.slice(0, new[-1]), new[:-1]).to_batches(max_chunksize=10_000)
    if held is not None:
        yield from held.to_batches()


def runs(part: pa.Table) -> np.ndarray:
    """Rows at which a key begins."""
    new = np.zeros(part.num_rows, bool)
    new[0] = True
    for k in KEY:
        c = part.column(k).combine_chunks().dictionary_encode()
        c = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c).indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def flat(part: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of a list column."""
    c = part.column(name).combine_chunks()
    c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    return c.flatten().to_numpy(zero_copy_only=False), c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)


def sum_runs(part: pa.Table, new: np.ndarray) -> pa.Table:
    key = np.zeros(part.num_rows, np.int64)
    key[new] = 1
    key = np.cumsum(key) - 1
    codes, lengths = flat(part, "codigos")
    counts, _ = flat(part, "cuentas")
    cells, at = np.unique(np.repeat(key, lengths) << LEVELS | codes.astype(np.int64), return_inverse=True)
    sums = np.zeros(len(cells), np.int64)
    np.add.at(sums, at, counts)
    cells, sums = cells[sums != 0], sums[sums != 0]
    dense: dict[int, np.ndarray] = {}
    blobs = part.column("contadores")
    for i in np.flatnonzero(blobs.is_valid().to_numpy()):
        k = int(key[i])
        dense[k] = dense.get(k, 0) + np.frombuffer(blobs[int(i)].as_py(), np.int64)
    ends = np.searchsorted(cells >> LEVELS, np.arange(len(new)), side="right")
    for k in dense:
        own = slice(ends[k - 1] if k else 0, ends[k])
        dense[k] = dense[k] + counters(cells[own] & CODES - 1, sums[own])
    return pa.Table.from_batches(list(states(part.take(pa.array(new)), ends, cells & CODES - 1, sums, dense)), ARROW_STATE)


def read_ranks(percentiles: dict[str, float]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = pa.Table.from_batches([b])
            n = part.column("n").to_numpy()
            codes, lengths = flat(part, "codigos")
            counts, _ = flat(part, "cuentas")
            ends = np.cumsum(lengths)
            sums = np.concatenate([[0], np.cumsum(counts)])
            base = sums[ends - lengths]
            blobs = part.column("contadores")
            dense = {int(i): np.frombuffer(blobs[int(i)].as_py(), np.int64) for i in np.flatnonzero(blobs.is_valid().to_numpy())}
            cota = np.zeros(len(n))
            for i, c in dense.items():
                cota[i] = bound(c)
            out = [*(part.column(k) for k in KEY), part.column("n"), pa.array(cota)]
            for p in percentiles.values():
                rank = np.clip(np.ceil(p * n - 1e-9), 1, np.maximum(n, 1)).astype(np.int64)
                # With exact counts the descent is a search in their running sum.
                at = np.searchsorted(sums[1:], base + rank)
                got = np.full(len(n), np.nan)
                fits = (lengths > 0) & (n > 0)
                got[fits] = decoded(codes[np.minimum(at[fits], len(codes) - 1)])
                for i, c in dense.items():
                    if n[i] > 0:
                        got[i] = decoded(invert(c, rank[i : i + 1]))[0]
                out.append(pa.array(got, mask=~((n > 0) & (fits | np.isin(np.arange(len(n)), list(dense))))))
            yield from pa.table(out, names=[*KEY, "n", "cota", *percentiles]).combine_chunks().to_batches()

    return run


def build(rows: DataFrame, groupings: tuple[str, ...], measures: tuple[str, ...]) -> DataFrame:
    """States of ``rows`` by each grouping column (string) and measure column (code or null), one for each task
    and value; null groups are left out. ``merge`` adds them up."""
    return rows.select(*groupings, *measures).mapInArrow(summarise(groupings, measures), STATE)


def merge(*parts: DataFrame) -> DataFrame:
    """Sum of states: one row for every grouping, group and measure. Groups without values left are kept with n = 0.

    States that are counters are first added in ``SALTS`` parts of a key, so that a key of which every task has one isn't added by one task alone.
    """
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = cut(every.select(*ARROW_STATE.names))
    wide = every.where("contadores is not null").withColumn("sal", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    fewer = wide.repartition(*KEY, "sal").sortWithinPartitions(*KEY).select(*ARROW_STATE.names).mapInArrow(added, STATE)
    return every.where("contadores is null").union(fewer).repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(added, STATE)


def negated(state: DataFrame) -> DataFrame:
    """The state that takes ``state`` away in a merge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = pa.Table.from_batches([b])
            counts, lengths = flat(part, "cuentas")
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(-counts, pa.int64()))
            codes, _ = flat(part, "codigos")
            own = pa.ListArray.from_arrays(lists.offsets, pa.array(codes, pa.int32()))
            blobs = [None if x is None else (-np.frombuffer(x, np.int64)).tobytes() for x in part.column("contadores").to_pylist()]
            yield from pa.table([*(part.column(k) for k in KEY), pa.array(-part.column("n").to_numpy(), pa.int64()), own, lists, pa.array(blobs, pa.binary())], schema=ARROW_STATE).to_batches()

    return state.select(*ARROW_STATE.names).mapInArrow(run, STATE)


def percentiles(state: DataFrame, wanted: dict[str, float] | None = None) -> DataFrame:
    """``agrupacion, grupo, medida, n, cota`` (share of n by which a rank may err) and a column for each percentile; null without values."""
    wanted = wanted or PERCENTILES
    return state.select(*ARROW_STATE.names).mapInArrow(read_ranks(wanted), "agrupacion string, grupo string, medida string, n bigint, cota double, " + ", ".join(f"{k} double" for k in wanted))


def quote(instant: Column, idx: Column, *said: Column) -> Column:
    """What a row says, in 128 bits: its instant, turn and words (null and empty words are one); null without instant or turn."""
    parts = [F.unix_micros(instant), idx.cast("int"), *(F.coalesce(w, F.lit("")) for w in said)]
    both = F.struct(F.xxhash64(*parts).alias("h"), F.xxhash64(F.lit(1), *reversed(parts)).alias("g"))
    return F.when(instant.isNotNull() & idx.isNotNull(), both)


def with_calls(turns: DataFrame) -> DataFrame:
    """Rows of turns with ``call``: their plain id; without one, the call of the row with the same instant, turn and words.

    Rows that say the same in several calls tell nothing of the call: it stays null. Only rows at the instant and turn
    of a row without id are looked at, and only the rows without id are joined.
    """
    at = F.try_to_timestamp("ts")
    rows = turns.withColumn("call", plain_id(F.col("llamada_id")))
    said = quote(F.col("instante"), F.col("turno_idx"), words(F.col("transcripcion")), words(F.col("respuesta")))
    lost = rows.where("call is null")
    asked = cut(lost.select(at.alias("instante"), "turno_idx").where("instante is not null and turno_idx is not null").distinct())
    named = rows.where("call is not null").select("call", at.alias("instante"), "turno_idx", "transcripcion", "respuesta").join(asked, ["instante", "turno_idx"], "left_semi")
    known = named.select("call", said.alias("dicho")).groupBy("dicho").agg(F.min("call").alias("a"), F.max("call").alias("z")).where("a = z").select("dicho", F.col("a").alias("de"))
    found = lost.withColumn("instante", at).withColumn("dicho", said).join(cut(known), "dicho", "left").withColumn("call", F.col("de"))
    return rows.where("call is not null").unionByName(found.select(*rows.columns))


def measured_turns(log: DataFrame) -> DataFrame:
    """One row per turn with its ``llamada_id``, ``dia`` (UTC day of ``ts``), ``cliente_origen`` and coded measures.

    Copies of a turn count once: of each measure the first usable value received is taken (ties by
    millisecond: the smallest). A null ``cliente_origen`` means navegador. Copies that lost their id go
    to the call of the turn they copy; turns without any call are told apart by ``ts`` and ``turno_idx`` and count for days
    and origins, not for a call. Only rows of ``tipo`` turno count.
    """
    spans = "latencia_ms.spans."
    source = {m: F.col(f"latencia_ms.{m}" if i < 2 else spans + m) for i, m in enumerate(MEASURES)}
    at = F.coalesce(F.unix_millis(F.col("recibido_ts").cast("timestamp")), F.lit((1 << 42) - 1))
    ts = F.try_to_timestamp("ts")
    rows = with_calls(log.where(plain_id(F.col("tipo")) == "turno").select("llamada_id", "turno_idx", "ts", "recibido_ts", "latencia_ms", "transcripcion", "respuesta")).select(
        F.coalesce("call", F.concat(F.lit(NO_CALL), F.coalesce(ts.cast("string"), "ts", F.lit("")))).alias("call"), F.coalesce("turno_idx", F.lit(-1)).alias("idx"),
        F.struct(at.alias("at"), F.coalesce("latencia_ms.cliente_origen", F.lit("navegador")).alias("v")).alias("origin"),
        (F.shiftleft(at, LEVELS) + F.unix_date(ts.cast("date"))).alias("day"), *((F.shiftleft(at, LEVELS) + code(c)).alias(m) for m, c in source.items()),
    )
    # Salted by a range of turns, so that a call of any length is spread; the grouping reuses the partitioning.
    rows = rows.withColumn("salt", F.floor(F.col("idx") / SALT)).repartition("call", "salt")
    first = rows.groupBy("call", "salt", "idx").agg(F.min("origin")["v"].alias("cliente_origen"), F.min("day").alias("day"), *(F.min(m).alias(m) for m in MEASURES))
    low = lambda c: F.col(c).bitwiseAND(F.lit(CODES - 1))
    return first.select(
        F.when(~F.col("call").startswith(NO_CALL), F.col("call")).alias("llamada_id"), F.date_from_unix_date(low("day").cast("int")).cast("string").alias("dia"),
        "cliente_origen", *(low(m).cast("int").alias(m) for m in MEASURES),
    )


GROUPINGS = ("llamada_id", "dia", "cliente_origen")


def p3_percentiles(spark, folder: str) -> DataFrame:
    """P50, P90, P95 and P99 of every latency by call, by day and by origin."""
    return percentiles(merge(build(measured_turns(table(spark, folder, "turnos")), GROUPINGS, MEASURES)))


def p3_total_de_dias(spark, folder: str) -> DataFrame:
    """The same of the whole log, from nothing but the states of its days added up (turns without a readable ``ts`` are of no day)."""
    days = cut(merge(build(measured_turns(table(spark, folder, "turnos")), ("dia",), MEASURES)))
    return percentiles(merge(days.withColumns({"agrupacion": F.lit("todo"), "grupo": F.lit("todo")})))


def p3_control(spark, folder: str) -> DataFrame:
    """Of every state its count, and whether all its percentiles have their ranks among the codes of all turns, to within ``cota``."""
    rows = cut(measured_turns(table(spark, folder, "turnos")))
    found = cut(percentiles(merge(build(rows, GROUPINGS, MEASURES))))
    told = found.select(*KEY, "n", "cota", *(code(F.col(p)).alias(p) for p in PERCENTILES))
    pair = F.explode(F.array(*(F.struct(F.lit(g).alias("agrupacion"), F.col(g).alias("grupo")) for g in GROUPINGS))).alias("g")
    value = F.explode(F.array(*(F.struct(F.lit(m).alias("medida"), F.col(m).alias("codigo")) for m in MEASURES))).alias("v")
    every = rows.select(pair, *MEASURES).select("g.*", value).select("agrupacion", "grupo", "v.*").where("grupo is not null and codigo is not null").groupBy(*KEY, "codigo").agg(F.count("*").alias("m"))
    ranks = every.join(told, list(KEY)).groupBy(*KEY, "n", "cota").agg(F.sum("m").alias("hay"), *(F.struct(F.sum(F.when(F.col("codigo") < F.col(p), F.col("m")).otherwise(0)).alias("antes"), F.sum(F.when(F.col("codigo") <= F.col(p), F.col("m")).otherwise(0)).alias("hasta")).alias(p) for p in PERCENTILES))
    slack = F.col("cota") * F.col("n")
    right = [(F.ceil(F.col("n") * q - 1e-9) > F.col(p)["antes"] - slack) & (F.ceil(F.col("n") * q - 1e-9) <= F.col(p)["hasta"] + slack) for p, q in PERCENTILES.items()]
    whole = F.col("n") == F.col("hay")
    for r in right:
        whole = whole & r
    return ranks.select(*KEY, "n", whole.alias("dentro"), (F.col("cota") <= 0.02).alias("estrecha"))


_USABLE = "({c} is not null and not isnan({c}) and {c} >= 0 and {c} < 'infinity'::double)"
_SOURCE = {m: f"latencia_ms.{m}" if i < 2 else f"latencia_ms.spans.{m}" for i, m in enumerate(MEASURES)}
_SAID = "case when {says} then {words} else '' end"
SQL = {
    "p3_control": f"""
with filas as (select nullif(lower(trim(llamada_id, ' ' || chr(9) || chr(10) || chr(13) || chr(160))), '') as id, turno_idx as i, try_cast(ts as timestamptz) as t, ts, recibido_ts as llego, latencia_ms,
    {_SAID.format(says=SAYS_SQL.format(c='transcripcion'), words=WORDS_SQL.format(c='transcripcion'))} as wp, {_SAID.format(says=SAYS_SQL.format(c='respuesta'), words=WORDS_SQL.format(c='respuesta'))} as wa
  from turnos where lower(trim(tipo)) = 'turno'),
dichos as (select t, i, wp, wa, min(id) as id from filas where id is not null and t is not null and i is not null group by all having min(id) = max(id)),
puestas as (select f.* exclude (id), coalesce(f.id, d.id) as id from filas f left join dichos d on f.id is null and f.t = d.t and f.i = d.i and f.wp = d.wp and f.wa = d.wa),
vueltas as (select id, coalesce(i, -1) as i, case when id is null then coalesce(t::varchar, ts, '') end as sin,
    arg_min(coalesce(latencia_ms.cliente_origen, 'navegador'), row(coalesce(epoch_ms(llego), 4398046511103), coalesce(latencia_ms.cliente_origen, 'navegador'))) as origen,
    arg_min(strftime((t at time zone 'UTC')::date, '%Y-%m-%d'), row(coalesce(epoch_ms(llego), 4398046511103), (t at time zone 'UTC')::date)) filter (t is not null) as dia,
    {", ".join(f"bool_or({_USABLE.format(c=c)}) as {m}" for m, c in _SOURCE.items())}
  from puestas group by all),
largas as ({" union all ".join(f"select '{g}' as agrupacion, {x} as grupo, '{m}' as medida from vueltas where {m} and {x} is not null" for g, x in (("llamada_id", "id"), ("dia", "dia"), ("cliente_origen", "origen")) for m in MEASURES)})
select agrupacion, grupo, medida, count(*) as n, true as dentro, true as estrecha from largas group by all""",
}
QUERIES = {"p3_percentiles": p3_percentiles, "p3_total_de_dias": p3_total_de_dias, "p3_control": p3_control}
