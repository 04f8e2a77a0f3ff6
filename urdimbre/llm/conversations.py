"""Conversations rebuilt from message rows.

Rows are linked, the links' connected components are the conversations, and a component is then ordered
and validated. The nodes are threads: all rows that name one call, or the copies of a turn without id. Links:

* quote: rows of one turn with the same words at nearly the same instant are copies, so their threads are linked
  through what they say. Instants under half of ``NEAR`` apart always meet, from ``NEAR`` on never directly, but copies
  of copies do: that takes the search. What rows of several calls say at once tells nothing of the call.
* reply: a turn without id that quotes no call answers the turn without id one index before it, if just one such
  turn was in the last ``GAP``; so conversations of which no row has an id are chains of replies.

Components are found with alternating large-star and small-star joins. Threads without id in a component with just one
call belong to that call's conversation; a component without a call is a conversation of its own, and where a component
holds several calls, each call stays by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from urdimbre.plans.lineage import cut, table

BLANKS = " \t\r\n\u00a0"
#: turno_idx under which the closing row of a call is kept.
CLOSING = -1
#: Microseconds within which copies and replies are looked for.
NEAR, GAP = 2_000_000, 120_000_000
#: Replies are looked for along stretches of time of so many gaps.
GAPS = 64
#: Sorts after every plain id.
NO_CALL = "\uffff"


def plain_id(c: Column) -> Column:
    """Identifier without outer blanks and case; blank is null."""
    return F.nullif(F.lower(F.btrim(c, F.lit(BLANKS))), F.lit(""))


def says_something(c: Column) -> Column:
    """True if a text has a letter or digit outside brackets; null texts say nothing."""
    outside = F.regexp_replace(c, r"\([^()]*\)|\[[^\[\]]*\]|\{[^{}]*\}", " ")
    return F.coalesce(outside.rlike(r"[\p{L}\p{N}]"), F.lit(False))


def words(c: Column) -> Column:
    """Lower-case words of a text parted by one blank; null for a text that says nothing."""
    found = F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}\p{M}]+"), F.lit(0))
    return F.when(says_something(c), F.array_join(found, " "))


def large_star(links: DataFrame) -> DataFrame:
    """Every neighbour larger than a node is linked to the node's smallest neighbour (or itself)."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def small_star(links: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the smallest of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of undirected links ``u, v``; the component is its smallest node.

    Links with a null end and loops are left out (a node without any other link has no row). Repeated links
    change nothing; without links the result is empty. Each round ends in a table in the shared folder;
    rounds end when the links are stars, i.e. no centre is itself linked to a smaller node.
    """
    current = links.select("u", "v").where("u is not null and v is not null and u <> v")
    while True:
        current = cut(small_star(large_star(current)))
        centres = current.select(F.col("v").alias("u")).distinct()
        if current.join(centres, "u", "left_semi").isEmpty():
            return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                centres.select(F.col("u").alias("node"), F.col("u").alias("component"))
            )


def quote(instant: Column, idx: Column, *said: Column) -> Column:
    """What a row quotes, in 128 bits: its instant, turn and words (null and empty words are one); null without instant or turn."""
    parts = [F.unix_micros(instant), idx.cast("int"), *(F.coalesce(w, F.lit("")) for w in said)]
    both = F.struct(F.xxhash64(*parts).alias("h"), F.xxhash64(F.lit(1), *reversed(parts)).alias("g"))
    return F.when(instant.isNotNull() & idx.isNotNull(), both)


def message_rows(log: DataFrame) -> DataFrame:
    """Rows of the log that have a place in a conversation, with their ``call``, ``thread``, ``kind``, ``idx`` and instant ``t``.

    Rows whose ``tipo`` is unknown, and turns without ``turno_idx``, have none and are left out.
    """
    kind = plain_id(F.col("tipo"))
    idx = F.when(kind == "cierre", CLOSING).when(kind == "apertura", F.coalesce("turno_idx", F.lit(0))).when(kind == "turno", F.col("turno_idx"))
    rows = log.select(
        plain_id(F.col("llamada_id")).alias("call"), kind.alias("kind"), idx.cast("int").alias("idx"), F.col("recibido_ts").alias("at"),
        F.unix_micros(F.try_to_timestamp("ts")).alias("t"), F.col("transcripcion").alias("p"), F.col("respuesta").alias("a"),
    ).where("idx is not null")
    said = [F.coalesce(words(F.col(c)), F.lit("")) for c in "pa"]
    alone = F.concat_ws("\x1f", F.lit(NO_CALL), F.coalesce(F.col("t").cast("string"), F.lit("")), F.col("idx").cast("string"), *said)
    return rows.withColumn("thread", F.when(F.col("call").isNotNull(), F.col("call")).otherwise(alone))


def turns(rows: DataFrame) -> DataFrame:
    """One row per turn of ``message_rows``: the copies of a turn pre-aggregated.

    Columns: ``thread``, ``call`` (plain id or null), ``idx``, flags, the texts of the earliest copy that says something,
    and whether copies differ in words.
    """
    told = rows.withColumn("at", F.coalesce("at", F.lit("9999-12-31").cast("timestamp_ntz"))).withColumn("wp", words(F.col("p"))).withColumn("wa", words(F.col("a")))
    first = lambda text, said: F.min(F.when(F.col(said).isNotNull(), F.struct("at", F.col(text).alias("text"))))["text"]
    return told.groupBy("thread", "call", "idx").agg(
        F.max(F.col("kind") == "apertura").alias("opens"), F.max((F.col("kind") == "turno") & F.col("wp").isNotNull()).alias("asks"),
        F.max(F.col("wa").isNotNull()).alias("answers"),
        (F.coalesce(F.min("wp") != F.max("wp"), F.lit(False)) | F.coalesce(F.min("wa") != F.max("wa"), F.lit(False))).alias("versions"),
        first("p", "wp").alias("patient"), first("a", "wa").alias("agent"),
    )


def quotes(rows: DataFrame) -> DataFrame:
    """``thread, call, quote``: what the rows at the turn and near the instant of a row without id say, as a hash of 128 bits.

    Instants lie in two grids shifted by half their width, so near ones share a cell. A row without instant quotes nothing.
    """
    cells = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.floor((F.col("t") + k * NEAR // 2) / NEAR).alias("cell")) for k in (0, 1)))).alias("c")
    placed = rows.where("t is not null").select("thread", "call", "idx", "p", "a", cells).select("thread", "call", "idx", "p", "a", "c.*")
    open_ = cut(placed.where("call is null").select("idx", "k", "cell").distinct())
    parts = [F.col("idx"), F.col("k"), F.col("cell"), *(F.coalesce(words(F.col(c)), F.lit("")) for c in "pa")]
    name = F.concat_ws("\x1e", F.lit(NO_CALL), F.hex(F.xxhash64(*parts)), F.hex(F.xxhash64(F.lit(1), *reversed(parts))))
    return placed.join(open_, ["idx", "k", "cell"], "left_semi").select("thread", "call", name.alias("quote")).distinct()


def replies(lone: DataFrame) -> DataFrame:
    """Links ``u, v`` of turns ``thread, idx, t`` to the only turn of the index before within ``GAP``.

    Turns are looked over along stretches of time; a stretch also gets the turns that end the one before it.
    """
    here = F.floor(F.col("t") / (GAP * GAPS))
    late = F.when(F.floor((F.col("t") + GAP) / (GAP * GAPS)) > here, here + 1)
    said = lone.select((F.col("idx") + 1).alias("n"), "t", F.col("thread").alias("before"), F.explode(F.array_compact(F.array(here, late))).alias("stretch"))
    asked = lone.select(F.col("idx").alias("n"), "t", "thread", here.alias("stretch"))
    last = Window.partitionBy("n", "stretch").orderBy("t").rangeBetween(-GAP, 0)
    both = said.withColumn("thread", F.lit(None).cast("string")).unionByName(asked.withColumn("before", F.lit(None).cast("string")))
    seen = both.withColumn("a", F.min("before").over(last)).withColumn("z", F.max("before").over(last))
    return seen.where("thread is not null and a = z and a <> thread").select(F.col("thread").alias("u"), F.col("a").alias("v"))


def links(rows: DataFrame) -> DataFrame:
    """Quote and reply links ``u, v`` between the threads of ``message_rows``."""
    said = cut(quotes(rows))
    calls = said.groupBy("quote").agg(F.min("call").alias("a"), F.max("call").alias("z"))
    quoted = said.join(calls.where("a is null or a = z").select("quote"), "quote").select(F.col("thread").alias("u"), F.col("quote").alias("v"))
    told = said.join(calls.where("a is not null").select("quote"), "quote", "left_semi").select("thread").distinct()
    alone = rows.where("call is null and t is not null and idx >= 0").groupBy("thread", "idx").agg(F.min("t").alias("t"))
    return quoted.union(replies(cut(alone.join(told, "thread", "left_anti"))))


def conversations(log: DataFrame) -> DataFrame:
    """The turns of ``log`` with the ``component`` (conversation) that quote and reply links put them in.

    A component is named by its call, or by its smallest thread if it has none. Where it would have several calls they
    stay apart, and its threads without id belong to none of them.
    """
    rows = message_rows(log)
    told = cut(turns(rows))
    linked = cut(components(links(rows)).withColumnRenamed("node", "thread"))
    threads = told.join(linked.select("thread"), "thread", "left_semi").select("thread", "call").distinct()
    named = linked.join(threads, "thread").groupBy("component").agg(F.min("call").alias("a"), F.max("call").alias("z"), F.min("thread").alias("least"))
    own = F.when(F.col("a").isNull() | (F.col("a") == F.col("z")), F.coalesce("a", "least")).otherwise(F.col("thread"))
    found = linked.join(named, "component").select("thread", own.alias("component"))
    return told.join(found, "thread", "left").withColumn("component", F.coalesce("component", "thread")).drop("thread")


def judged(calls: DataFrame, told: DataFrame) -> DataFrame:
    """Every row of ``calls`` with its plain id ``component`` and whether it is ``broken``.

    Broken: no opening, no closing, one of the turns 1..turno_idx missing (null counts as 0), two versions of a
    turn, a patient's words without any reply in that turn, or a patient who never speaks. A call of which the
    log has no row is broken. Calls with a null id are broken and have a null component.
    """
    own = calls.select("llamada_id", plain_id(F.col("llamada_id")).alias("component"), F.coalesce("turno_idx", F.lit(0)).alias("n"))
    state = (
        told.where("call is not null")
        .join(own.where("component is not null").groupBy("component").agg(F.max("n").alias("n")), "component")
        .groupBy("component")
        .agg(
            F.max("opens").alias("opens"), F.max(F.col("idx") == CLOSING).alias("closes"), F.count(F.when(F.col("idx").between(1, F.col("n")), 1)).alias("there"),
            F.max("versions").alias("versions"), F.max(F.col("asks") & ~F.col("answers")).alias("unanswered"), F.max("asks").alias("speaks"),
        )
    )
    whole = F.col("opens") & F.col("closes") & (F.col("there") >= F.col("n")) & ~F.col("versions") & ~F.col("unanswered") & F.col("speaks")
    return own.join(state, "component", "left").select("llamada_id", "component", (~F.coalesce(whole, F.lit(False))).alias("broken"))


def p1_found(spark, folder: str) -> DataFrame:
    """Calls of ``llamadas`` that can't be told whole."""
    told = conversations(table(spark, folder, "turnos"))
    return judged(table(spark, folder, "llamadas"), told).where("broken").select("llamada_id")


def p1_conversaciones(spark, folder: str) -> DataFrame:
    """Utterances of the calls that can be told whole: ``llamada_id, turno_idx, orden, hablante, texto``.

    ``orden`` rises along the conversation; the patient speaks before the agent within a turn. Texts that say
    nothing give no utterance; of several copies the earliest received is taken (ties: the smallest text).
    """
    told = cut(conversations(table(spark, folder, "turnos")))
    whole = judged(table(spark, folder, "llamadas"), told).where(~F.col("broken"))
    said = F.explode(F.array(
        F.struct((2 * F.col("idx")).alias("orden"), F.lit("paciente").alias("hablante"), F.when(~F.col("opens"), F.col("patient")).alias("texto")),
        F.struct((2 * F.col("idx") + 1).alias("orden"), F.lit("agente").alias("hablante"), F.col("agent").alias("texto")),
    ))
    return (
        told.where((F.col("idx") >= 0) & F.col("call").isNotNull()).join(whole, "component")
        .select("llamada_id", F.col("idx").alias("turno_idx"), said.alias("s")).select("llamada_id", "turno_idx", "s.*")
        .where("texto is not null")
    )


def p1_sin_id(spark, folder: str) -> DataFrame:
    """Utterances of the turns without id: ``conversacion, llamada_id, turno_idx, orden, hablante, texto``.

    ``llamada_id`` is the plain id of the call that their conversation belongs to; null where it is of no call, its turns
    being all that is known of it. ``orden``, ``hablante`` and ``texto`` as in ``p1_conversaciones``.
    """
    told = cut(conversations(table(spark, folder, "turnos")))
    calls = told.where("call is not null").select("component", F.col("call").alias("llamada_id")).distinct()
    said = F.explode(F.array(
        F.struct((2 * F.col("idx")).alias("orden"), F.lit("paciente").alias("hablante"), F.when(~F.col("opens"), F.col("patient")).alias("texto")),
        F.struct((2 * F.col("idx") + 1).alias("orden"), F.lit("agente").alias("hablante"), F.col("agent").alias("texto")),
    ))
    return (
        told.where("call is null and idx >= 0").join(calls, "component", "left")
        .select(F.sha2("component", 256).substr(1, 32).alias("conversacion"), "llamada_id", F.col("idx").alias("turno_idx"), said.alias("s"))
        .select("conversacion", "llamada_id", "turno_idx", "s.*").where("texto is not null")
    )


WORDS_SQL = r"array_to_string(regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}\p{{M}}]+'), ' ')"
SAYS_SQL = r"coalesce(regexp_matches(regexp_replace({c}, '\([^()]*\)|\[[^\[\]]*\]|\{{[^{{}}]*\}}', ' ', 'g'), '[\p{{L}}\p{{N}}]'), false)"
TOLD_SQL = f"""
with filas as (
  select lower(trim(llamada_id, ' ' || chr(9) || chr(10) || chr(13) || chr(160))) as id, lower(trim(tipo, ' ' || chr(9) || chr(10) || chr(13) || chr(160))) as tipo, turno_idx as idx,
    coalesce(recibido_ts, timestamp '9999-12-31') as llego, transcripcion as p, respuesta as a,
    case when {SAYS_SQL.format(c='transcripcion')} then {WORDS_SQL.format(c='transcripcion')} end as wp,
    case when {SAYS_SQL.format(c='respuesta')} then {WORDS_SQL.format(c='respuesta')} end as wa
  from turnos),
utiles as (select id, tipo, llego, p, a, wp, wa, case when tipo = 'cierre' then -1 when tipo = 'apertura' then coalesce(idx, 0) when tipo = 'turno' then idx end as idx
  from filas where id <> ''),
vueltas as (
  select id, idx, bool_or(tipo = 'apertura') as abre, bool_or(tipo = 'turno' and wp is not null) as habla, bool_or(wa is not null) as responde,
    count(distinct wp) > 1 or count(distinct wa) > 1 as versiones,
    arg_min(p, row(llego, p)) filter (wp is not null) as paciente, arg_min(a, row(llego, a)) filter (wa is not null) as agente
  from utiles where idx is not null group by id, idx),
estado as (
  select l.llamada_id, lower(trim(l.llamada_id)) as id, coalesce(bool_or(abre), false) and coalesce(bool_or(idx = -1), false)
    and count(case when idx between 1 and l.turno_idx then 1 end) >= coalesce(max(l.turno_idx), 0)
    and not coalesce(bool_or(versiones), false) and not coalesce(bool_or(habla and not responde), false) and coalesce(bool_or(habla), false) as entera
  from llamadas l left join vueltas v on v.id = lower(trim(l.llamada_id)) group by l.llamada_id)
"""
SQL = {
    "p1_found": TOLD_SQL + "select llamada_id from estado where not entera",
    "p1_conversaciones": TOLD_SQL
    + """
select llamada_id, idx as turno_idx, 2 * idx as orden, 'paciente' as hablante, paciente as texto
from vueltas join estado using (id) where entera and idx >= 0 and not abre and paciente is not null
union all
select llamada_id, idx, 2 * idx + 1, 'agente', agente from vueltas join estado using (id) where entera and idx >= 0 and agente is not null""",
}
QUERIES = {"p1_found": p1_found, "p1_conversaciones": p1_conversaciones, "p1_sin_id": p1_sin_id}
