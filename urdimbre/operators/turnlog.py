"""Measures of a turn log: latencies, tokens, calls to models, retrieval, failures, late corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urdimbre.functions.stats import percentiles, usable

SPANS = ("stt", "extraccion", "politica", "rag", "redaccion", "tts")


def kind() -> Column:
    return F.lower(F.trim("tipo"))


def turns(log: DataFrame) -> DataFrame:
    return log.where(kind() == "turno")


def call() -> Column:
    return F.lower(F.trim("llamada_id"))


def summary(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``n, p50, p95, minimo, maximo`` of the usable values of each group, percentiles linear, one digit."""
    own = rows.withColumn(value, usable(F.col(value)))
    ends = own.where(F.col(value).isNotNull()).groupBy(F.struct(F.lit(0), *keys).alias("_g")).agg(F.count("*").alias("n"), F.round(F.min(value), 1).alias("minimo"), F.round(F.max(value), 1).alias("maximo"))
    found = percentiles(own, keys, value, {"p50": 0.5, "p95": 0.95}, "linear", 1).withColumn("_g", F.struct(F.lit(0), *keys))
    return found.join(ends, "_g").select(*keys, "n", "p50", "p95", "minimo", "maximo")


def latency_by_origin(log: DataFrame) -> DataFrame:
    """Client latency of the turns by ``origen``; a null origin is navegador. Openings don't count."""
    own = turns(log).select(F.coalesce("latencia_ms.cliente_origen", F.lit("navegador")).alias("origen"), F.col("latencia_ms.cliente_fin_habla_a_audio").alias("ms"))
    return summary(own, ["origen"], "ms")


def latency_by_span(log: DataFrame) -> DataFrame:
    own = turns(log).select(F.explode(F.array(*(F.struct(F.lit(s).alias("tramo"), F.col(f"latencia_ms.spans.{s}").alias("ms")) for s in SPANS))).alias("x")).select("x.*")
    return summary(own, ["tramo"], "ms")


def invocations(log: DataFrame) -> DataFrame:
    """Calls to models of the turns, one per row."""
    return turns(log).select(call().alias("llamada"), "turno_idx", F.explode("llm").alias("x")).select("llamada", "turno_idx", "x.*")


def tokens_by_model(log: DataFrame) -> DataFrame:
    """Invocations, tokens, retries and waits by model; null tokens add nothing, a null model is named so."""
    return invocations(log).groupBy(F.coalesce("modelo", F.lit("(sin modelo)")).alias("modelo")).agg(
        F.count("*").alias("invocaciones"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens_in", "tokens_out", "tokens_razonamiento", "reintentos", "reintentos_429")),
        F.round(F.coalesce(F.sum("espera_reintento_ms"), F.lit(0.0)), 1).alias("espera_ms"),
    )


def results_by_role(log: DataFrame) -> DataFrame:
    return invocations(log).groupBy(F.coalesce("rol", F.lit("?")).alias("rol"), F.coalesce("resultado", F.lit("?")).alias("resultado")).agg(F.count("*").alias("n"))


def failures(log: DataFrame) -> DataFrame:
    """Turns whose extraction or transcription failed, by cause."""
    own = turns(log)
    extraction = own.where("extraccion.resultado not in ('ok', 'no_invocado', '')").select(F.lit("extraccion").alias("etapa"), F.col("extraccion.resultado").alias("causa"))
    speech = own.where("stt.resultado not in ('ok', '')").select(F.lit("stt").alias("etapa"), F.col("stt.resultado").alias("causa"))
    return extraction.union(speech).groupBy("etapa", "causa").agg(F.count("*").alias("n"))


def retrieval(log: DataFrame) -> DataFrame:
    """One row: queries, turns answered with a source and without, and the mean of the best scores."""
    asked = F.coalesce(F.col("rag.consultas") > 0, F.lit(False))
    enough = F.coalesce(F.col("rag.suficiente"), F.lit(False))
    return turns(log).agg(
        F.coalesce(F.sum("rag.consultas"), F.lit(0)).alias("consultas"), F.count_if(asked & enough).alias("con_fuente"), F.count_if(asked & ~enough).alias("sin_fuente"),
        F.round(F.avg(F.when(asked, usable(F.col("rag.mejor_score")))), 4).alias("mejor_medio"),
    )


def totals(log: DataFrame) -> DataFrame:
    """One row: calls, closed calls, turns, turns that waited for a quota, seconds of audio."""
    waited = F.exists("llm", lambda x: F.coalesce(x["reintentos_429"], F.lit(0)) > 0)
    turn = kind() == "turno"
    return log.agg(
        F.count_distinct(F.when(turn, call())).alias("llamadas"), F.count_distinct(F.when(kind() == "cierre", call())).alias("cerradas"), F.count_if(turn).alias("turnos"),
        F.count_if(turn & F.coalesce(waited, F.lit(False))).alias("con_espera"), F.round(F.sum(F.when(turn, usable(F.col("stt.segundos_audio")))), 1).alias("segundos_audio"),
    )


def call_totals(log: DataFrame) -> DataFrame:
    """By call, openings included: turns, invocations, tokens, server time (tenths of ms and rows that have it). Rows without a call are left out."""
    ms = F.when(F.col("latencia_ms.servidor_total") >= 0, usable(F.col("latencia_ms.servidor_total")))
    own = log.where(kind().isin("turno", "apertura") & call().isNotNull())
    sum_of = lambda f: F.aggregate(F.coalesce("llm", F.array().cast(log.schema["llm"].dataType)), F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x[f], F.lit(0)))
    return own.groupBy(call().alias("llamada")).agg(
        F.count_if(kind() == "turno").alias("turnos"), F.coalesce(F.sum(F.greatest(F.size("llm"), F.lit(0))), F.lit(0)).alias("invocaciones"), F.sum(sum_of("tokens_in")).alias("tokens_in"),
        F.sum(sum_of("tokens_out")).alias("tokens_out"), F.coalesce(F.sum(F.round(ms * 10).cast("bigint")), F.lit(0)).alias("servidor_decimas"), F.count(ms).alias("servidor_filas"),
    )


def clean_turns(log: DataFrame) -> DataFrame:
    """Turns of the browser whose speech, extraction and calls to models all went well."""
    well = F.coalesce((F.size("llm") > 0) & F.forall("llm", lambda x: x["resultado"] == "ok"), F.lit(False))
    return turns(log).where((F.coalesce("latencia_ms.cliente_origen", F.lit("navegador")) == "navegador") & (F.col("stt.resultado") == "ok") & (F.col("extraccion.resultado") == "ok") & well)


def without_model(log: DataFrame) -> DataFrame:
    """One row: turns, and those in which no model was really called (no call, or none but with result no_invocado)."""
    called = F.exists("llm", lambda x: F.coalesce(x["resultado"], F.lit("?")) != "no_invocado")
    return turns(log).agg(F.count("*").alias("turnos"), F.count_if(~F.coalesce(called, F.lit(False))).alias("sin_modelo"))


def by_source(log: DataFrame) -> DataFrame:
    """Turns with a query to the corpus by the source of their reply: turns, queries, sufficient ones and declared limits."""
    enough = F.coalesce(F.col("rag.suficiente"), F.lit(False))
    own = turns(log).where(F.col("rag.consultas") > 0).groupBy(F.coalesce("fuente_respuesta", F.lit("?")).alias("fuente"))
    return own.agg(F.count("*").alias("turnos"), F.sum("rag.consultas").alias("consultas"), F.count_if(enough).alias("con_fuente"), F.count_if(~enough).alias("limite_declarado"))


def corrected(log: DataFrame, patches: DataFrame) -> DataFrame:
    """``log`` with ``ms`` replaced by the latest patch of its ``llamada, turno_idx``: ``llamada, turno_idx, ms, en`` (ties: the larger).

    A patch without row changes nothing; a null, NaN or infinite patch is none, and such a measure of ``log`` is null.
    Both sides keep their other rows and columns.
    """
    patches = patches.withColumn("ms", usable(F.col("ms")))
    last = patches.where("ms is not null").groupBy("llamada", "turno_idx").agg(F.max_by("ms", F.struct("en", "ms")).alias("_nuevo"))
    return log.join(last, ["llamada", "turno_idx"], "left").withColumn("ms", F.round(F.coalesce("_nuevo", usable(F.col("ms"))), 1)).drop("_nuevo")
