"""Queries of the library's operators over a folder of tables, and the same in SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from urdimbre.functions import stats
from urdimbre.functions import text as tx
from urdimbre.operators import analysis, chunking, corpus, dedup, retrieval, sequences, turnlog
from urdimbre.plans.lineage import cut, new_folder, spread, table
from urdimbre.sources import jsonl
from urdimbre.streaming import logs

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def documents(spark, folder: str, *columns: str) -> DataFrame:
    """Columns of the documents, for work on their texts."""
    return spread(table(spark, folder, "documents").select(*columns))


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def quoted_list(words: tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in words)


# Text -------------------------------------------------------------------------------------------------------

def plain_sql(c: str) -> str:
    return f"regexp_replace(translate(lower({c}), '{tx.ACCENTED}', '{tx.BARE}'), '\\p{{Mn}}', '', 'g')"


def words_sql(c: str) -> str:
    return f"list_filter(string_split(regexp_replace({plain_sql(f"coalesce({c}, '')")}, '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"


@query(r"""select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)),
  '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', ' ', 'g'), '([\p{L}\p{N}_])[-\x{ad}]\n([\p{L}\p{N}_])', '\1\2', 'g'), '[ \t\x{a0}\x{2007}\x{202f}]+', ' ', 'g'), '\n{2,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9)) as texto
from documents""")
def doc_normalize(spark, folder: str) -> DataFrame:
    return documents(spark, folder, "doc_id", "text").select("doc_id", tx.normalized(F.col("text")).alias("texto"))


@query("select doc_id, sha256(text) as huella from documents")
def doc_hash(spark, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("huella"))


@query(f"select doc_id, list_aggregate({words_sql('text')}, 'string_agg', ' ') as palabras, len({words_sql('text')}) as n from documents")
def canonical_words(spark, folder: str) -> DataFrame:
    words = tx.canonical_words(F.col("text"))
    return documents(spark, folder, "doc_id", "text").select("doc_id", F.when(F.size(words) > 0, F.array_join(words, " ")).alias("palabras"), F.size(words).alias("n"))


FUNCTION_SQL = f"""select doc_id, lang, len(list_filter(w, lambda x: x in ({quoted_list(tx.SPANISH)}))) as es, len(list_filter(w, lambda x: x in ({quoted_list(tx.ENGLISH)}))) as en
  from (select doc_id, lang, regexp_extract_all({plain_sql("coalesce(text, '')")}, '[a-z]+') as w from documents)"""
GUESS_SQL = "case when es > en then 'es' when en > es then 'en' else 'indeterminado' end"


@query(f"select doc_id, es, en, {GUESS_SQL} as idioma from ({FUNCTION_SQL})")
def lang_detect(spark, folder: str) -> DataFrame:
    spanish, english = tx.function_words(F.col("text"))
    return documents(spark, folder, "doc_id", "text").select("doc_id", spanish.alias("es"), english.alias("en"), tx.guessed_language(F.col("text")).alias("idioma"))


CODES_SQL = "(select lower(trim(etiqueta)) as e, min(lower(codigo)) as c from etiquetas_idioma where etiqueta is not null and codigo is not null group by 1 having count(distinct lower(codigo)) = 1)"
CODED_SQL = f"(select c as lang, es, en from ({FUNCTION_SQL}) f left join {CODES_SQL} k on lower(trim(f.lang)) = k.e)"


def _told(spark, folder: str) -> DataFrame:
    """Language that the label of each document names, and the one its function words tell."""
    told = documents(spark, folder, "lang", "text").select("lang", tx.guessed_language(F.col("text")).alias("idioma"))
    return analysis.coded(told, "lang", table(spark, folder, "etiquetas_idioma"))


@query(f"select lang, {GUESS_SQL} as idioma, count(*) as n from {CODED_SQL} group by all")
def lang_confusion(spark, folder: str) -> DataFrame:
    return analysis.confusion(_told(spark, folder), "lang", "idioma")


MARKED = r"""string_split(regexp_replace(regexp_replace(coalesce(text, ''), '([.!?;])\s+', '\1' || chr(1), 'g'), '\n{2,}', chr(1), 'g'), chr(1))"""


@query(f"""select formato, count(*) as oraciones, max(length(s)) as mayor from (select formato, unnest(list_filter({MARKED}, lambda s: regexp_matches(s, '[^\\s\\x{{a0}}]'))) as s from documents) group by formato""")
def sentence_stats(spark, folder: str) -> DataFrame:
    pieces = documents(spark, folder, "formato", "text").select("formato", F.explode(tx.sentence_pieces(F.col("text"))).alias("s"))
    return pieces.groupBy("formato").agg(F.count("*").alias("oraciones"), F.max(F.length("s")).alias("mayor"))


@query(rf"""select llamada_id, turno_idx, recibido_ts, trim(coalesce(transcripcion, '')) <> '' and (regexp_matches(trim(transcripcion), '[¿?]')
  or regexp_matches(lower(trim(transcripcion)), '^[^\p{{L}}\p{{N}}_]*({tx.QUESTION_OPENERS})($|[^\p{{L}}\p{{N}}_])')) as pregunta from turnos where lower(trim(tipo)) = 'turno'""")
def question_detect(spark, folder: str) -> DataFrame:
    return turnlog.turns(table(spark, folder, "turnos")).select("llamada_id", "turno_idx", "recibido_ts", tx.asks(F.col("transcripcion")).alias("pregunta"))


@query(rf"""select llamada_id, turno_idx, recibido_ts, coalesce(extraccion.pregunta_del_paciente, false) or (trim(coalesce(transcripcion, '')) <> '' and (regexp_matches(trim(transcripcion), '[¿?]')
  or regexp_matches(lower(trim(transcripcion)), '^[^\p{{L}}\p{{N}}_]*({tx.QUESTION_OPENERS})($|[^\p{{L}}\p{{N}}_])'))) as pregunta from turnos where lower(trim(tipo)) = 'turno'""")
def question_union(spark, folder: str) -> DataFrame:
    """The model's mark or the form of the text: the second only adds to the first."""
    told = F.coalesce("extraccion.pregunta_del_paciente", F.lit(False))
    return turnlog.turns(table(spark, folder, "turnos")).select("llamada_id", "turno_idx", "recibido_ts", (told | tx.asks(F.col("transcripcion"))).alias("pregunta"))


BARE_SQL = "trim(regexp_replace({}, '[^0-9a-z]+', ' ', 'g'))"


@query(f"""select llamada_id, turno_idx, recibido_ts, cita, coalesce({BARE_SQL.format(plain_sql('cita'))} <> '' and contains({BARE_SQL.format(plain_sql('transcripcion'))}, {BARE_SQL.format(plain_sql('cita'))}), false) as respaldada
  from (select *, upper(substring(case when turno_idx % 2 = 0 then transcripcion else respuesta end, 4, 12)) as cita from turnos where lower(trim(tipo)) = 'turno')""")
def quote_validate(spark, folder: str) -> DataFrame:
    own = turnlog.turns(table(spark, folder, "turnos")).withColumn("cita", F.upper(F.substring(F.when(F.col("turno_idx") % 2 == 0, F.col("transcripcion")).otherwise(F.col("respuesta")), 4, 12)))
    return own.select("llamada_id", "turno_idx", "recibido_ts", "cita", tx.quoted(F.col("cita"), F.col("transcripcion")).alias("respaldada"))


@query("""select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k from events""")
def json_tolerant(spark, folder: str) -> DataFrame:
    """Objects wrapped as models answer, with fences and a stray brace, are read as their clean form."""
    wrapped = F.concat(F.lit("```json\n"), F.col("props"), F.lit("}\n```"))
    return table(spark, folder, "events").select("event_id", F.get_json_object(tx.json_object(wrapped), "$.k").try_cast("bigint").alias("k"))


# Duplicates, chunks, corpus ---------------------------------------------------------------------------------


@query("select doc_id, sha256(text) as huella, min(doc_id) over (partition by sha256(text)) as clase from documents where text is not null")
def dup_exact(spark, folder: str) -> DataFrame:
    return dedup.membership(table(spark, folder, "documents"), "doc_id", "text")


PAIRS_SQL = f"""with p as (select min(doc_id) as k, text from documents where text is not null group by text),
  f as (select k, list_distinct(list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i:i + 4], ' '))) as s from (select k, {words_sql('text')} as w from p) where len(w) >= 5),
  e as (select k, len(s) as n, unnest(s) as x from f)
select a.k as a, b.k as b, count(*) / (a.n + b.n - count(*)) as jaccard from e a join e b on a.x = b.x and a.k < b.k group by a.k, b.k, a.n, b.n having count(*) / (a.n + b.n - count(*)) >= 0.8"""


@query(PAIRS_SQL)
def dup_pairs(spark, folder: str) -> DataFrame:
    """Similar pairs of class representatives; ``dup_exact`` has the membership."""
    return dedup.near_duplicates(documents(spark, folder, "doc_id", "text"), "doc_id", "text")[0]


#: In order of the later document: a pair drops it unless its earlier one is dropped.
KEEP_SQL = f"""with pares as ({PAIRS_SQL}), fuera as (select list_reduce(list_prepend([]::bigint[], coalesce(list([a, b] order by b, a), [])), lambda q, x: case when list_contains(q, x[1]) then q else list_append(q, x[2]) end) as q from pares),
  c as (select doc_id, min(doc_id) over (partition by sha256(text)) as clase from documents where text is not null), g as (select b as clase, min(a) as cercano from pares, fuera where not list_contains(q, a) group by all)
  select doc_id, case when cercano is not null then cercano when doc_id <> c.clase then c.clase end as gemelo, case when cercano is not null then 'solapamiento' when doc_id <> c.clase then 'exacto' end as motivo from c left join g using (clase)"""


@query(KEEP_SQL)
def dup_keep(spark, folder: str) -> DataFrame:
    return dedup.kept_first(documents(spark, folder, "doc_id", "text").where("text is not null"), "doc_id", "text")


@query()
def chunks(spark, folder: str) -> DataFrame:
    return chunking.chunks(spread(table(spark, folder, "paginas").select(F.col("documento_id").alias("clave"), "numero", "texto")))


@query("""select documento_id, round(avg(length(trim(coalesce(texto, ''), ' ' || chr(10) || chr(9) || chr(13)))), 4) as media, avg(length(trim(coalesce(texto, ''), ' ' || chr(10) || chr(9) || chr(13)))) >= 40 as capa
from paginas group by documento_id""")
def text_layer(spark, folder: str) -> DataFrame:
    return corpus.text_layer(table(spark, folder, "paginas"))


@query("select d.id, d.trozos as trozos_dichos, coalesce(n, 0) as trozos_hay from documentos d left join (select documento_id, count(distinct id) as n from trozos group by 1) t on t.documento_id = d.id")
def inventory(spark, folder: str) -> DataFrame:
    return corpus.inventory(table(spark, folder, "documentos"), table(spark, folder, "trozos"))


@query("select origen, idioma, count(distinct id) as trozos, count(distinct documento_id) as documentos from trozos group by all")
def chunk_counts(spark, folder: str) -> DataFrame:
    return corpus.counts(table(spark, folder, "trozos"), ["origen", "idioma"])


@query("select count(*) as filas, count(distinct id) as trozos, count(distinct documento_id) as documentos, max(length(texto)) as mayor, sum(length(texto))::bigint as caracteres, 600 as longitud, 150 as solape, 80 as minimo from trozos")
def manifest(spark, folder: str) -> DataFrame:
    return corpus.manifest(table(spark, folder, "trozos"), longitud=chunking.LENGTH, solape=chunking.OVERLAP, minimo=chunking.SHORTEST)


@query("select documento_id, count(*) as filas, count(distinct t.id) as trozos from trozos t where documento_id in (select id from documentos where estado <> 'disponible') group by all")
def deleted_counts(spark, folder: str) -> DataFrame:
    """What ``delete_document`` takes away, counted before."""
    gone = table(spark, folder, "documentos").where("estado <> 'disponible'").select(F.col("id").alias("documento_id"))
    return corpus.counted_of(table(spark, folder, "trozos"), "documento_id", gone)


@query(f"""with v as (select doc_id, k, substr(text, k * 1200 + 1, 1200) as w from (select doc_id, text, unnest(range(0, (length(text) + 1199) // 1200)) as k from documents where text <> '')),
  c as (select doc_id, k, length(w) as n, len({words_sql('w')}) as palabras from v where length(w) >= 600)
  select c as idioma, count(*) as ventanas, sum(n)::bigint as caracteres, sum(palabras)::bigint as palabras, round(min(n / palabras) filter (palabras > 0), 6) as minimo from c x join documents d using (doc_id) left join {CODES_SQL} k on lower(trim(d.lang)) = k.e group by all""".replace("select c as idioma", "select k.c as idioma"))
def window_ratio(spark, folder: str) -> DataFrame:
    """Windows of 1,200 characters of the documents by language: how many, their characters, and the fewest characters to a word."""
    docs = analysis.coded(documents(spark, folder, "lang", "text"), "lang", table(spark, folder, "etiquetas_idioma"))
    each = docs.select(F.col("lang").alias("idioma"), F.explode(tx.windows(F.col("text"))).alias("w")).select("idioma", F.length("w").alias("n"), F.size(tx.canonical_words(F.col("w"))).alias("palabras"))
    return each.groupBy("idioma").agg(F.count("*").alias("ventanas"), F.sum("n").alias("caracteres"), F.sum("palabras").cast("bigint").alias("palabras"), F.round(F.min(F.try_divide("n", "palabras")), 6).alias("minimo"))


@query("""select event_id, case when event_id % 3 = 0 then (json_extract_string(props, '$.k')) end as valor, case when event_id % 3 = 0 and json_extract_string(props, '$.k') is not null then event_type end as cita from events""")
def value_quotes(spark, folder: str) -> DataFrame:
    """Values with quotes as models answer them: an object with both is evidence; a bare value, or a quote that is no text, isn't."""
    value = F.get_json_object("props", "$.k")
    whole = F.to_json(F.struct(F.struct(value.alias("valor"), F.col("event_type").alias("cita")).alias("x")))
    bare, odd = F.to_json(F.struct(value.alias("x"))), F.to_json(F.struct(F.struct(value.alias("valor"), F.col("event_id").alias("cita")).alias("x")))
    answer = F.when(F.col("event_id") % 3 == 0, whole).when(F.col("event_id") % 3 == 1, bare).otherwise(odd)
    told, quote = tx.value_and_quote(tx.json_object(F.concat(F.lit("Respuesta:\n```json\n"), answer, F.lit("\n```"))), "x")
    return table(spark, folder, "events").select("event_id", told.alias("valor"), F.when(told.isNotNull(), quote).alias("cita"))


@query("""with n as (select distinct id, '* ' || texto as texto, documento_id, indice from trozos where pagina = 1)
select id, texto, documento_id, indice from trozos where id not in (select id from n) union all select * from n""")
def upsert_chunks(spark, folder: str) -> DataFrame:
    """Chunks of first pages come again with another text."""
    own = table(spark, folder, "trozos")
    old = own.select("id", "texto", "documento_id", "indice")
    return corpus.upsert(old, old.join(own.where("pagina = 1").select("id").distinct(), "id", "left_semi").withColumn("texto", F.concat(F.lit("* "), "texto")), "id")


@query("select id, documento_id, indice from trozos where documento_id not in (select id from documentos where estado <> 'disponible')")
def delete_document(spark, folder: str) -> DataFrame:
    gone = table(spark, folder, "documentos").where("estado <> 'disponible'").select(F.col("id").alias("documento_id"))
    return corpus.without(table(spark, folder, "trozos").select("id", "documento_id", "indice"), "documento_id", gone)


@query("select doc_id, source, n_chars from (select *, row_number() over (partition by lower(trim(source)) order by subido_en, doc_id) as r from documents) where r = 1")
def first_seen(spark, folder: str) -> DataFrame:
    own = table(spark, folder, "documents").select(F.lower(F.trim("source")).alias("f"), F.coalesce("subido_en", F.lit("9999-12-31").cast("timestamp_ntz")).alias("en"), "doc_id", "source", "n_chars")
    return dedup.first_seen(own, ["f"], ["en", "doc_id"]).select("doc_id", "source", "n_chars")


LENGTH_SQL = "min(n) filter (r > floor({q} * (m - 1)))"


@query(f"""select origen, max(m) as trozos, {LENGTH_SQL.format(q=0.05)} as p05, {LENGTH_SQL.format(q=0.5)} as p50, {LENGTH_SQL.format(q=0.95)} as p95, count(*) filter (n > 500) as largos
  from (select origen, length(texto) as n, row_number() over (partition by origen order by length(texto)) as r, count(*) over (partition by origen) as m from trozos where texto is not null) group by origen""")
def chunk_lengths(spark, folder: str) -> DataFrame:
    """Lengths of the chunks by origin (percentiles of floored rank), and how many are above 500 characters."""
    rows = table(spark, folder, "trozos").where("texto is not null").select("origen", F.length("texto").alias("n"))
    found = stats.by_rank(rows, ["origen"], "n", {"p05": 0.05, "p50": 0.5, "p95": 0.95}, nearest=False)
    return found.join(rows.groupBy("origen").agg(F.count("*").alias("trozos"), F.count_if(F.col("n") > 500).alias("largos")), "origen").select("origen", "trozos", "p05", "p50", "p95", "largos")


@query("select documento_id, numero, length(trim(texto)) as n from (select distinct documento_id, numero, texto from paginas where texto is not null) order by n, documento_id, numero limit 5")
def smallest_pages(spark, folder: str) -> DataFrame:
    """The five shortest pages: a report."""
    own = table(spark, folder, "paginas").where("texto is not null").select("documento_id", "numero", "texto").distinct()
    return own.select("documento_id", "numero", F.length(F.trim("texto")).alias("n")).orderBy("n", "documento_id", "numero").limit(5)


# Retrieval --------------------------------------------------------------------------------------------------


def _vectors(spark, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def _labelled(spark, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _texts(spark, folder: str) -> DataFrame:
    return documents(spark, folder, "doc_id", "text").select(F.col("doc_id").alias("id"), F.col("text").alias("texto"))


def _fused(spark, folder: str) -> DataFrame:
    vectors, texts = _vectors(spark, folder), _texts(spark, folder)
    return retrieval.hybrid(vectors, texts, vectors.where("id % 100 = 0"), texts.where("id % 100 = 0"))


DENSE_SQL = """v as (select vec_id as id, embedding::double[] as e, sqrt(list_inner_product(embedding::double[], embedding::double[])) as n from embeddings),
  d as (select q.id as consulta, v.id, round(list_inner_product(q.e, v.e) / q.n / v.n, 6) as denso from v q, v where q.id % 100 = 0),
  p as (select *, row_number() over (partition by consulta order by denso desc, id) as puesto from d qualify puesto <= 60)"""
TERMS_SQL = f"""t as (select distinct doc_id as consulta, unnest(list_transform(list_filter({words_sql('text')}, lambda w: length(w) >= 4 and w not in ({quoted_list(tx.SPANISH + tx.ENGLISH)})), lambda w: w[1:6])) as termino from documents where doc_id % 100 = 0),
  x as (select doc_id as id, ' ' || regexp_replace({plain_sql("coalesce(text, '')")}, '[^a-z0-9]+', ' ', 'g') as plano from documents),
  h as (select x.id, s.termino from x, (select distinct termino from t) s where contains(x.plano, s.termino)),
  w as (select t.consulta, t.termino, coalesce(f.df, 0) as df, ln(1 + (select count(*) from documents)::double / (1 + coalesce(f.df, 0))) as peso from t left join (select termino, count(*) as df from h group by 1) f using (termino))"""
HYBRID_SQL = f"""with {DENSE_SQL}, {TERMS_SQL},
  todo as (select consulta, sum(peso) as todo from w group by 1), hay as (select p.consulta, p.id, sum(w.peso) as hay from p join w using (consulta) join h on h.id = p.id and h.termino = w.termino group by 1, 2),
  s as (select p.*, todo, coalesce(coalesce(hay, 0) / todo, 0) as lex from p left join todo using (consulta) left join hay using (consulta, id)),
  b as (select consulta, id, denso, puesto, round(lex, 6) as lexico, round(case when todo is null then greatest(0, least(1, denso)) else 0.5 * greatest(0, least(1, denso)) + 0.5 * lex end, 6) as puntos from s)
  select *, row_number() over (partition by consulta order by puntos desc, puesto) as lugar from b qualify lugar <= 5"""


@query(f"with {DENSE_SQL} select consulta, id, denso, puesto from p")
def dense_topk(spark, folder: str) -> DataFrame:
    vectors = _vectors(spark, folder)
    return retrieval.dense_top(vectors, vectors.where("id % 100 = 0"))


@query(f"with {TERMS_SQL} select consulta, termino, df, round(peso, 6) as peso from w")
def term_weights(spark, folder: str) -> DataFrame:
    texts = _texts(spark, folder)
    return retrieval.lexical(texts, texts.where("id % 100 = 0"))[0].select("consulta", "termino", "df", F.round("peso", 6).alias("peso"))


@query(f"select consulta, id, denso, lexico, puntos, lugar from ({HYBRID_SQL})")
def hybrid_topk(spark, folder: str) -> DataFrame:
    return _fused(spark, folder)


@query(f"select consulta, count(*) as examinados, count(*) filter (puntos >= 0.59) as suficientes, max(puntos) as mejor from ({HYBRID_SQL}) group by consulta")
def retrieve_threshold(spark, folder: str) -> DataFrame:
    found = cut(_fused(spark, folder))
    enough = retrieval.sufficient(found).groupBy("consulta").agg(F.count("*").alias("suficientes"))
    every = found.groupBy("consulta").agg(F.count("*").alias("examinados"), F.max("puntos").alias("mejor"))
    return every.join(enough, "consulta", "left").select("consulta", "examinados", F.coalesce("suficientes", F.lit(0)).alias("suficientes"), "mejor")


CUT_SQL = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@query(f"""select consulta, id, lugar, round(puntos, 4) as puntos, case when length({CUT_SQL}) > 400 then rtrim({CUT_SQL}[1:399]) || '…' else {CUT_SQL} end as cita
  from ({HYBRID_SQL}) s join documents d on d.doc_id = s.id where puntos >= 0.59""")
def citations(spark, folder: str) -> DataFrame:
    return retrieval.cited(retrieval.sufficient(_fused(spark, folder)), _texts(spark, folder)).select("consulta", "id", "lugar", "puntos", "cita")


#: Weights of the sweep.
ALPHAS = (1.0, 0.75, 0.6, 0.5, 0.4, 0.25, 0.0)


@query(f"""with {DENSE_SQL}, l as (select p.*, q.label = e.label as igual from p join embeddings q on q.vec_id = consulta join embeddings e on e.vec_id = id where consulta <> id and puesto <= 6)
  select consulta, bool_or(igual) as acierto, count(*) filter (igual) as iguales from l group by consulta""")
def hit_at_k(spark, folder: str) -> DataFrame:
    """Whether one of the five nearest other vectors has the query's label."""
    labels = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "label")
    found = dense_topk(spark, folder).where("consulta <> id and puesto <= 6").join(labels, "id").join(labels.select(F.col("id").alias("consulta"), F.col("label").alias("suya")), "consulta")
    same = F.col("label") == F.col("suya")
    return found.groupBy("consulta").agg(F.max(same).alias("acierto"), F.count_if(same).alias("iguales"))


@query(f"""with {DENSE_SQL}, l as (select consulta, max(denso) filter (q.label = e.label) as propia, max(denso) filter (q.label <> e.label) as ajena
    from d join embeddings q on q.vec_id = consulta join embeddings e on e.vec_id = id where consulta <> id group by consulta)
  select a as alfa, round(min(a * propia + (1 - a)), 6) as peor_propia, round(max(a * ajena), 6) as mejor_ajena, round(min(a * propia + (1 - a)) - max(a * ajena), 6) as hueco from l, (select unnest([{", ".join(f"{a}::double" for a in ALPHAS)}]) as a) group by a""")
def alpha_sweep(spark, folder: str) -> DataFrame:
    """Gap between the worst own and the best foreign score of all queries, for each weight of the dense score (the label as the other).

    Each query's best scores are taken over all rows.
    """
    vectors = _labelled(spark, folder)
    best = retrieval.best_by_label(vectors, vectors.where("id % 100 = 0"))
    each = best.select("propia", "ajena", F.explode(F.array(*map(F.lit, ALPHAS))).alias("alfa"))
    own, foreign = F.min(F.col("alfa") * F.col("propia") + (1 - F.col("alfa"))), F.max(F.col("alfa") * F.col("ajena"))
    return each.groupBy("alfa").agg(F.round(own, 6).alias("peor_propia"), F.round(foreign, 6).alias("mejor_ajena"), F.round(own - foreign, 6).alias("hueco"))


FUSED_SQL = f"""{DENSE_SQL}, {TERMS_SQL},
  todo as (select consulta, sum(peso) as todo from w group by 1), hay as (select w.consulta, h.id, sum(w.peso) as hay from w join h using (termino) group by 1, 2),
  x2 as (select d.consulta, d.id, d.denso, todo, coalesce(coalesce(hay, 0) / todo, 0) as lex, q.label = e.label as suya from d join embeddings q on q.vec_id = d.consulta join embeddings e on e.vec_id = d.id left join todo using (consulta) left join hay using (consulta, id) where d.consulta <> d.id),
  f as (select consulta, alfa, max(puntos) filter (suya) as propia, max(puntos) filter (not suya) as ajena from (select consulta, id, suya, alfa, case when alfa >= 1 then greatest(0, least(1, denso)) when todo is null then greatest(0, least(1, denso))
    else round(alfa * greatest(0, least(1, denso)) + (1 - alfa) * least(1, lex), 6) end as puntos from x2, (select unnest([{", ".join(f"{a}::double" for a in ALPHAS)}]) as alfa)) group by all)"""


@query(f"""with {FUSED_SQL}, g as (select doc_id as consulta, {GUESS_SQL} as idioma from ({FUNCTION_SQL})),
  e2 as (select coalesce(idioma, 'indeterminado') as idioma, alfa, count(*) as consultas, min(propia) as peor_propia, max(ajena) as mejor_ajena, round(min(propia) - max(ajena), 6) as hueco from f left join g using (consulta) group by all)
  select *, row_number() over (partition by idioma order by hueco desc nulls last, alfa desc) = 1 and hueco is not null as mejor_alfa from e2""")
def alpha_sweep_hybrid(spark, folder: str) -> DataFrame:
    """The same of the hybrid score, by language of the query's text: own and foreign best over all rows by the fusion with each alpha.

    ``mejor_alfa``: whether the alpha has the language's widest gap (ties: the larger). A query without text is indeterminado.
    """
    vectors, texts = _labelled(spark, folder), _texts(spark, folder)
    asked = texts.where("id % 100 = 0")
    weights, there = retrieval.lexical(texts, asked)
    best = retrieval.best_by_label(vectors, vectors.where("id % 100 = 0"), ALPHAS, (weights, there))
    language = asked.select(F.col("id").alias("consulta"), tx.guessed_language(F.col("texto")).alias("idioma"))
    found = best.join(language, "consulta", "left").withColumn("idioma", F.coalesce("idioma", F.lit("indeterminado")))
    own, foreign = F.min("propia"), F.max("ajena")
    gaps = found.groupBy("idioma", "alfa").agg(F.count("*").alias("consultas"), own.alias("peor_propia"), foreign.alias("mejor_ajena"), F.round(own - foreign, 6).alias("hueco"))
    place = F.row_number().over(Window.partitionBy("idioma").orderBy(F.col("hueco").desc_nulls_last(), F.col("alfa").desc()))
    return gaps.withColumn("mejor_alfa", (place == 1) & F.col("hueco").isNotNull())


#: Fixed value: by how much a threshold lies above the best foreign score where the populations overlap.
ABOVE = 0.02


@query(f"""with {FUSED_SQL}, g as (select round(min(propia), 6) as peor_cubierta, round(max(ajena), 6) as mejor_ajena, count(propia) as cubiertas, count(ajena) as ajenas from f where alfa = 0.5)
  select *, round(peor_cubierta - mejor_ajena, 6) as hueco, round(case when peor_cubierta > mejor_ajena then (peor_cubierta + mejor_ajena) / 2 else mejor_ajena + {ABOVE} end, 6) as umbral from g""")
def population_gap(spark, folder: str) -> DataFrame:
    """Separation of covered queries (best fused score over rows of their label) from foreign ones (over all others), and the threshold:
    midway between the populations, or just above the foreign one where they overlap."""
    vectors, texts = _labelled(spark, folder), _texts(spark, folder)
    best = retrieval.best_by_label(vectors, vectors.where("id % 100 = 0"), (retrieval.ALPHA,), retrieval.lexical(texts, texts.where("id % 100 = 0")))
    ends = best.agg(F.round(F.min("propia"), 6).alias("peor_cubierta"), F.round(F.max("ajena"), 6).alias("mejor_ajena"), F.count("propia").alias("cubiertas"), F.count("ajena").alias("ajenas"))
    low, high = F.col("peor_cubierta"), F.col("mejor_ajena")
    return ends.withColumn("hueco", F.round(low - high, 6)).withColumn("umbral", F.round(F.when(low > high, (low + high) / 2).otherwise(high + ABOVE), 6))


# Turn log ---------------------------------------------------------------------------------------------------

TURNS = "(select *, lower(trim(llamada_id)) as llamada, lower(trim(tipo)) as clase_fila from turnos)"
FINITE = "not isnan({c}) and not isinf({c})"
SUMMARY = "count(*) as n, round(quantile_cont(ms, 0.5), 1) as p50, round(quantile_cont(ms, 0.95), 1) as p95, round(min(ms), 1) as minimo, round(max(ms), 1) as maximo"


@query(f"select origen, {SUMMARY} from (select coalesce(latencia_ms.cliente_origen, 'navegador') as origen, latencia_ms.cliente_fin_habla_a_audio as ms from {TURNS} where clase_fila = 'turno') where {FINITE.format(c='ms')} group by origen")
def turn_latency(spark, folder: str) -> DataFrame:
    return turnlog.latency_by_origin(table(spark, folder, "turnos"))


SPANS_SQL = " union all ".join(f"select '{s}' as tramo, latencia_ms.spans.{s} as ms from {TURNS} where clase_fila = 'turno'" for s in turnlog.SPANS)


@query(f"select tramo, {SUMMARY} from ({SPANS_SQL}) where {FINITE.format(c='ms')} group by tramo")
def turn_spans(spark, folder: str) -> DataFrame:
    return turnlog.latency_by_span(table(spark, folder, "turnos"))


CALLS_SQL = f"(select llamada, turno_idx, unnest(llm) as x from {TURNS} where clase_fila = 'turno')"


@query(f"""select coalesce(x.modelo, '(sin modelo)') as modelo, count(*) as invocaciones, {", ".join(f"coalesce(sum(x.{c}), 0)::bigint as {c}" for c in ("tokens_in", "tokens_out", "tokens_razonamiento", "reintentos", "reintentos_429"))},
  round(coalesce(sum(x.espera_reintento_ms), 0), 1) as espera_ms from {CALLS_SQL} group by all""")
def tokens_by_model(spark, folder: str) -> DataFrame:
    return turnlog.tokens_by_model(table(spark, folder, "turnos"))


@query(f"select coalesce(x.rol, '?') as rol, coalesce(x.resultado, '?') as resultado, count(*) as n from {CALLS_SQL} group by all")
def results_by_role(spark, folder: str) -> DataFrame:
    return turnlog.results_by_role(table(spark, folder, "turnos"))


@query(f"""select etapa, causa, count(*) as n from (select 'extraccion' as etapa, extraccion.resultado as causa from {TURNS} where clase_fila = 'turno' and extraccion.resultado not in ('ok', 'no_invocado', '')
  union all select 'stt', stt.resultado from {TURNS} where clase_fila = 'turno' and stt.resultado not in ('ok', '')) group by all""")
def failure_hist(spark, folder: str) -> DataFrame:
    return turnlog.failures(table(spark, folder, "turnos"))


@query(f"""select coalesce(sum(rag.consultas), 0)::bigint as consultas, count(*) filter (rag.consultas > 0 and rag.suficiente) as con_fuente, count(*) filter (rag.consultas > 0 and not coalesce(rag.suficiente, false)) as sin_fuente,
  round(avg(rag.mejor_score) filter (rag.consultas > 0 and {FINITE.format(c='rag.mejor_score')}), 4) as mejor_medio from {TURNS} where clase_fila = 'turno'""")
def rag_metrics(spark, folder: str) -> DataFrame:
    return turnlog.retrieval(table(spark, folder, "turnos"))


@query(f"""select count(distinct llamada) filter (clase_fila = 'turno') as llamadas, count(distinct llamada) filter (clase_fila = 'cierre') as cerradas, count(*) filter (clase_fila = 'turno') as turnos,
  count(*) filter (clase_fila = 'turno' and len(list_filter(llm, lambda x: x.reintentos_429 > 0)) > 0) as con_espera, round(sum(stt.segundos_audio) filter (clase_fila = 'turno' and {FINITE.format(c='stt.segundos_audio')}), 1) as segundos_audio from {TURNS}""")
def turn_totals(spark, folder: str) -> DataFrame:
    return turnlog.totals(table(spark, folder, "turnos"))


@query(f"""select llamada, count(*) filter (clase_fila = 'turno') as turnos, coalesce(sum(len(llm)), 0)::bigint as invocaciones, sum(coalesce(list_sum(list_transform(llm, lambda x: x.tokens_in)), 0))::bigint as tokens_in,
  sum(coalesce(list_sum(list_transform(llm, lambda x: x.tokens_out)), 0))::bigint as tokens_out, coalesce(sum(case when latencia_ms.servidor_total >= 0 and {FINITE.format(c='latencia_ms.servidor_total')} then round(latencia_ms.servidor_total * 10)::bigint end), 0)::bigint as servidor_decimas,
  count(*) filter (latencia_ms.servidor_total >= 0 and {FINITE.format(c='latencia_ms.servidor_total')}) as servidor_filas
  from {TURNS} where clase_fila in ('turno', 'apertura') and llamada is not null group by llamada""")
def call_totals(spark, folder: str) -> DataFrame:
    return turnlog.call_totals(table(spark, folder, "turnos"))


@query(f"""select llamada_id, turno_idx, recibido_ts, case when {FINITE.format(c='latencia_ms.servidor_total')} then latencia_ms.servidor_total end as ms from {TURNS} where clase_fila = 'turno' and coalesce(latencia_ms.cliente_origen, 'navegador') = 'navegador' and stt.resultado = 'ok'
  and extraccion.resultado = 'ok' and len(llm) > 0 and len(list_filter(llm, lambda x: x.resultado = 'ok')) = len(llm)""")
def clean_turns(spark, folder: str) -> DataFrame:
    return turnlog.clean_turns(table(spark, folder, "turnos")).select("llamada_id", "turno_idx", "recibido_ts", stats.usable(F.col("latencia_ms.servidor_total")).alias("ms"))


@query(f"""with f as (select llamada, turno_idx, recibido_ts as en, case when {FINITE.format(c='latencia_ms.cliente_fin_habla_a_audio')} then latencia_ms.cliente_fin_habla_a_audio end as ms from {TURNS} where clase_fila in ('turno', 'apertura') and llamada is not null),
  p as (select llamada, turno_idx, arg_max(ms, row(en, ms)) as nuevo from f where ms is not null and en is not null group by all)
  select f.llamada, f.turno_idx, f.en, round(coalesce(nuevo, ms), 1) as ms from f left join p on p.llamada = f.llamada and p.turno_idx = f.turno_idx""")
def telemetry_merge(spark, folder: str) -> DataFrame:
    """Every row of a turn takes the measure that was received last for it."""
    rows = turnlog.kind().isin("turno", "apertura") & turnlog.call().isNotNull()
    own = table(spark, folder, "turnos").where(rows).select(turnlog.call().alias("llamada"), "turno_idx", F.col("recibido_ts").alias("en"), F.col("latencia_ms.cliente_fin_habla_a_audio").alias("ms"))
    return turnlog.corrected(own, own.where("en is not null"))


def plain_id_sql(c: str) -> str:
    return f"nullif(array_to_string(list_transform(regexp_extract_all(lower({c}), '\\p{{L}}+|[0-9]+'), lambda x: regexp_replace(x, '^0+([0-9])', '\\1')), '_'), '')"


PATIENTS = f"(select * replace ({plain_id_sql('paciente_id')} as paciente_id) from trayectorias_postop_silver)"


# Percentiles, sequences -------------------------------------------------------------------------------------


@query("select event_type, round(quantile_cont(value, 0.5), 1) as p50, round(quantile_cont(value, 0.95), 1) as p95 from events group by event_type")
def percentile_linear(spark, folder: str) -> DataFrame:
    return stats.percentiles(table(spark, folder, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95}, "linear", 1)


RANK_SQL = "select event_type, min(value) filter (r > {f}(0.5 * (n - 1))) as p50, min(value) filter (r > {f}(0.95 * (n - 1))) as p95 from (select event_type, value, row_number() over (partition by event_type order by value) as r, count(*) over (partition by event_type) as n from events where value is not null) group by event_type"


@query(RANK_SQL.format(f="round_even_0").replace("round_even_0(0.5 * (n - 1))", "round_even(0.5 * (n - 1), 0)").replace("round_even_0(0.95 * (n - 1))", "round_even(0.95 * (n - 1), 0)"))
def percentile_nearest(spark, folder: str) -> DataFrame:
    return stats.by_rank(table(spark, folder, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95}, nearest=True)


@query(RANK_SQL.format(f="floor"))
def percentile_floor(spark, folder: str) -> DataFrame:
    return stats.by_rank(table(spark, folder, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95}, nearest=False)


@query(f"""select fila_id, last_value(dolor_nrs ignore nulls) over w as dolor_nrs, last_value(fiebre_c ignore nulls) over w as fiebre_c, last_value(herida ignore nulls) over w as herida
  from {PATIENTS} where paciente_id is not null and dia_postop is not null window w as (partition by paciente_id order by dia_postop, fila_id rows between unbounded preceding and current row)""")
def latest_signals(spark, folder: str) -> DataFrame:
    own = _trajectories(spark, folder).where("paciente_id is not null and dia_postop is not null").select("fila_id", "paciente_id", "dia_postop", "dolor_nrs", "fiebre_c", "herida")
    return sequences.latest_known(own, ["paciente_id"], "dia_postop", ["dolor_nrs", "fiebre_c", "herida"], ties=["fila_id"]).select("fila_id", "dolor_nrs", "fiebre_c", "herida")


LOG_ROWS = f"(select llamada, turno_idx, recibido_ts, stt.resultado as r, transcripcion as t from {TURNS} where clase_fila = 'turno' and llamada is not null and turno_idx is not null group by all)"


@query(f"""select llamada, turno_idx, recibido_ts, sum(length(coalesce(t, ''))) over (partition by llamada order by turno_idx, recibido_ts, t rows between unbounded preceding and current row)::bigint as caracteres from {LOG_ROWS}""")
def running_characters(spark, folder: str) -> DataFrame:
    rows = _log_rows(spark, folder).withColumn("_n", F.length(F.coalesce("t", F.lit(""))))
    return sequences.running_sum(rows, ["llamada"], "turno_idx", "_n", "caracteres", ties=["recibido_ts", "t"]).select("llamada", "turno_idx", "recibido_ts", "caracteres")


def _log_rows(spark, folder: str) -> DataFrame:
    own = turnlog.turns(table(spark, folder, "turnos")).select(turnlog.call().alias("llamada"), "turno_idx", "recibido_ts", F.col("stt.resultado").alias("r"), F.col("transcripcion").alias("t"))
    return own.where("llamada is not null and turno_idx is not null").distinct()


@query(f"""with o as (select *, row_number() over (partition by llamada order by turno_idx, recibido_ts, r, t) as k from {LOG_ROWS}),
  z as (select *, max(case when r in ('error', 'timeout') then 0 else k end) over (partition by llamada order by k) as u from o)
  select llamada, max(k - u) as racha from z group by llamada""")
def failure_streak(spark, folder: str) -> DataFrame:
    """Most failures of transcription in a row of every call."""
    rows = _log_rows(spark, folder).withColumn("fallo", F.col("r").isin("error", "timeout"))
    return sequences.streaks(rows, ["llamada"], "turno_idx", "fallo", ties=["recibido_ts", "r", "t"]).groupBy("llamada").agg(F.max("racha").alias("racha"))


# Analyses ---------------------------------------------------------------------------------------------------

#: Findings at the wound, from the mildest.
WOUNDS = ["normal", "eritema_leve", "secrecion_purulenta"]
TRAJECTORIES = "trayectorias_postop_silver"


def _trajectories(spark, folder: str) -> DataFrame:
    return table(spark, folder, TRAJECTORIES).withColumn("paciente_id", tx.plain_id(F.col("paciente_id")))


@query(f"select dia_postop, {', '.join(f"count(*) filter (herida = '{w}') as {w}" for w in WOUNDS)} from {TRAJECTORIES} group by dia_postop")
def crosstab_day_wound(spark, folder: str) -> DataFrame:
    return analysis.crosstab(table(spark, folder, TRAJECTORIES), "dia_postop", "herida", WOUNDS)


@query(f"select m.dia_postop, h.arquetipo_trayectoria from (select distinct dia_postop from {TRAJECTORIES} where dia_postop is not null) m, (select distinct arquetipo_trayectoria from {TRAJECTORIES} where arquetipo_trayectoria is not null) h where not exists (select 1 from {TRAJECTORIES} t where t.dia_postop = m.dia_postop and t.arquetipo_trayectoria = h.arquetipo_trayectoria)")
def zero_cells(spark, folder: str) -> DataFrame:
    """Days on which no row has a given archetype."""
    return analysis.zero_cells(table(spark, folder, TRAJECTORIES), "dia_postop", "arquetipo_trayectoria")


@query(f"select clase, criterio, count(*) as n, count(distinct llamada) as llamadas from {TURNS} where clase_fila = 'cierre' group by all")
def closing_hist(spark, folder: str) -> DataFrame:
    return table(spark, folder, "turnos").where(turnlog.kind() == "cierre").groupBy("clase", "criterio").agg(F.count("*").alias("n"), F.count_distinct(turnlog.call()).alias("llamadas"))


CALLS_OF = f"(select llamada_id, {plain_id_sql('paciente_id')} as paciente_id, dia_postop, clase from llamadas)"


def _calls(spark, folder: str) -> DataFrame:
    return table(spark, folder, "llamadas").withColumn("paciente_id", tx.plain_id(F.col("paciente_id")))


@query(f"""with c as (select clase, llamada from {TURNS} where clase_fila = 'cierre'), t as (select llamada, count(*) as m from {TURNS} where clase_fila = 'turno' and llamada is not null group by all), k as (select distinct clase, llamada from c where llamada is not null)
  select k.clase, count(*) as casos, coalesce(sum(m), 0)::bigint as turnos from k left join t using (llamada) group by all""")
def class_turns(spark, folder: str) -> DataFrame:
    """Classes of closings by case (a call with the class) and by turn of such calls."""
    log = table(spark, folder, "turnos")
    cases = log.where((turnlog.kind() == "cierre") & turnlog.call().isNotNull()).select("clase", turnlog.call().alias("llamada")).distinct()
    many = turnlog.turns(log).where(turnlog.call().isNotNull()).groupBy(turnlog.call().alias("llamada")).agg(F.count("*").alias("m"))
    return cases.join(many, "llamada", "left").groupBy("clase").agg(F.count("*").alias("casos"), F.coalesce(F.sum("m"), F.lit(0)).alias("turnos"))


@query(f"""select coalesce(fuente_respuesta, '?') as fuente, count(*) as turnos, sum(rag.consultas)::bigint as consultas, count(*) filter (coalesce(rag.suficiente, false)) as con_fuente, count(*) filter (not coalesce(rag.suficiente, false)) as limite_declarado
  from {TURNS} where clase_fila = 'turno' and rag.consultas > 0 group by all""")
def rag_by_source(spark, folder: str) -> DataFrame:
    return turnlog.by_source(table(spark, folder, "turnos"))


@query(f"""select count(*) as turnos, count(*) filter (coalesce(len(list_filter(llm, lambda x: coalesce(x.resultado, '?') <> 'no_invocado')), 0) = 0) as sin_modelo from {TURNS} where clase_fila = 'turno'""")
def turns_without_model(spark, folder: str) -> DataFrame:
    return turnlog.without_model(table(spark, folder, "turnos"))


@query(f"""select count(n) as con, count(*) filter (n is null) as sin, coalesce(sum(n), 0)::bigint as filas from {CALLS_OF} l
  left join (select paciente_id, dia_postop, count(*) as n from {PATIENTS} group by all) t on t.paciente_id = l.paciente_id and t.dia_postop = l.dia_postop""")
def case_join(spark, folder: str) -> DataFrame:
    """Calls with and without a row of the same patient and day."""
    return analysis.joined_cases(_calls(spark, folder), _trajectories(spark, folder), ["paciente_id", "dia_postop"])


@query(f"""with c as (select llamada_id, 'tray_' || paciente_id || '_' || dia_postop as caso from {CALLS_OF}), t as (select {plain_id_sql('trayectoria_id')} as caso, count(*) as n from {TRAJECTORIES} group by all)
  select c.llamada_id, c.caso, coalesce(n, 0) as etiquetas, coalesce(n, 0) = 1 as integra from c left join t using (caso)""")
def case_labels(spark, folder: str) -> DataFrame:
    """Calls joined with trajectory rows by a key computed of patient and day; a case is whole if it meets just one."""
    key = F.concat(F.lit("tray_"), "paciente_id", F.lit("_"), F.col("dia_postop").cast("string"))
    cases = _calls(spark, folder).select("llamada_id", key.alias("caso"))
    found = analysis.labelled(cases, table(spark, folder, TRAJECTORIES).select(tx.plain_id(F.col("trayectoria_id")).alias("caso")), "caso")
    return found.select("llamada_id", "caso", "etiquetas", (F.col("etiquetas") == 1).alias("integra"))


@query(f"""with t as (select count(distinct paciente_id) as m from {CALLS_OF}), e as (select clase, count(*) as casos, count(distinct paciente_id) as entidades from {CALLS_OF} group by clase), w as (select *, entidades as k, m as n, entidades / nullif(m, 0) as p from e, t)
  select clase, casos, entidades, round(greatest(0, (p + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n)), 6) as desde,
  round(least(1, (p + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n)), 6) as hasta from w""")
def class_patients(spark, folder: str) -> DataFrame:
    """Calls and distinct patients of each class, and the interval of the share of patients."""
    return analysis.classes(_calls(spark, folder), "clase", "paciente_id")


#: Fixed value: days that the per-day tables show, whether there are rows of them or not.
DAYS = [1, 3, 7, 14]


@query(f"""select d.dia_postop, c.herida, count(dolor_nrs) as n, min(dolor_nrs) as minimo, round(quantile_cont(dolor_nrs, 0.25), 4) as q1, round(quantile_cont(dolor_nrs, 0.5), 4) as mediana, round(quantile_cont(dolor_nrs, 0.75), 4) as q3, max(dolor_nrs) as maximo
  from (select unnest({DAYS}) as dia_postop) d, (select distinct herida from {TRAJECTORIES}) c left join {TRAJECTORIES} t on t.dia_postop = d.dia_postop and t.herida is not distinct from c.herida group by all""")
def pain_by_day(spark, folder: str) -> DataFrame:
    """Pain by wound on the given days; a cell without rows is there with n = 0."""
    return analysis.described_on(table(spark, folder, TRAJECTORIES), "dia_postop", DAYS, "herida", "dolor_nrs")


@query(f"""with e as (select dia_postop, coalesce(movilidad, '') as movilidad, count(*) as m from {TRAJECTORIES} where herida = 'secrecion_purulenta' group by all)
  select dia_postop, sum(m)::bigint as n, arg_min(movilidad, row(-m, movilidad)) as comun, round(max(m) / sum(m), 6) as pureza from e group by dia_postop""")
def flag_by_day(spark, folder: str) -> DataFrame:
    """How pure mobility is, by day, among rows with a purulent wound."""
    return analysis.flag_purity(table(spark, folder, TRAJECTORIES).withColumn("movilidad", F.coalesce("movilidad", F.lit(""))), "dia_postop", F.col("herida") == "secrecion_purulenta", "movilidad")


@query(f"""select arquetipo_trayectoria, count(dolor_nrs) as n, min(dolor_nrs) as minimo, round(quantile_cont(dolor_nrs, 0.25), 4) as q1, round(quantile_cont(dolor_nrs, 0.5), 4) as mediana, round(quantile_cont(dolor_nrs, 0.75), 4) as q3, max(dolor_nrs) as maximo
  from {TRAJECTORIES} where dolor_nrs is not null group by all""")
def pain_by_archetype(spark, folder: str) -> DataFrame:
    return analysis.described(table(spark, folder, TRAJECTORIES), ["arquetipo_trayectoria"], "dolor_nrs")


@query(f"select arquetipo_trayectoria, sum(n)::bigint as n, max(n) / sum(n) as pureza, max(n) / sum(n) >= 0.95 as pura from (select arquetipo_trayectoria, movilidad, count(*) as n from {TRAJECTORIES} group by all) group by all")
def archetype_purity(spark, folder: str) -> DataFrame:
    return analysis.purity(table(spark, folder, TRAJECTORIES), "arquetipo_trayectoria", "movilidad")


@query(f"select paciente_id, count(distinct arquetipo_trayectoria) as distintas, min(arquetipo_trayectoria) as primera from {PATIENTS} group by all having count(distinct arquetipo_trayectoria) > 1")
def label_constancy(spark, folder: str) -> DataFrame:
    return analysis.constancy(_trajectories(spark, folder), "paciente_id", "arquetipo_trayectoria")


@query(f"select dia_postop, a as mayor_bajo, b as menor_alto, b - a as hueco from (select dia_postop, max(fiebre_c) filter (herida = 'normal') as a, min(fiebre_c) filter (herida = 'secrecion_purulenta') as b from {TRAJECTORIES} group by all)")
def fever_frontier(spark, folder: str) -> DataFrame:
    return analysis.frontier(table(spark, folder, TRAJECTORIES), "dia_postop", "fiebre_c", F.col("herida") == "normal", F.col("herida") == "secrecion_purulenta")


WILSON_SQL = "(p + 1.96 * 1.96 / (2 * n) {s} 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n)"


@query(f"""select lang, k as aciertos, n, round(p, 6) as recall, round(greatest(0, {WILSON_SQL.format(s='-')}), 6) as desde, round(least(1, {WILSON_SQL.format(s='+')}), 6) as hasta
  from (select lang, count(*) filter (lang = {GUESS_SQL}) as k, count(*) as n, count(*) filter (lang = {GUESS_SQL}) / count(*) as p from {CODED_SQL} group by lang)""")
def recall_wilson(spark, folder: str) -> DataFrame:
    return analysis.recall(_told(spark, folder), "lang", "idioma")


#: Thresholds of the sweep.
FEVERS = [37.5, 37.6, 37.7, 37.8, 37.9, 38.0, 38.1]


@query(f"select herida, umbral, count(*) filter (fiebre_c >= umbral and not isnan(fiebre_c)) as n from {TRAJECTORIES}, (select unnest([{', '.join(f'{t}::double' for t in FEVERS)}]) as umbral) group by all")
def threshold_sweep(spark, folder: str) -> DataFrame:
    return analysis.sweep(table(spark, folder, TRAJECTORIES).withColumn("fiebre_c", stats.usable(F.col("fiebre_c"))), "herida", "fiebre_c", FEVERS)


@query(f"""with e as (select paciente_id, min(fiebre_c) as a, max(fiebre_c) as b from {PATIENTS} where paciente_id is not null and fiebre_c is not null group by all)
  select x.paciente_id, min(y.a) as minimo_resto, max(y.b) as maximo_resto from e x left join e y on x.paciente_id <> y.paciente_id group by all""")
def leave_one_out(spark, folder: str) -> DataFrame:
    return analysis.without_each(_trajectories(spark, folder), "paciente_id", "fiebre_c")


@query(f"""with b as (select quantile_cont(dolor_nrs, [0.1, 0.9]) as d, quantile_cont(fiebre_c, [0.1, 0.9]) as f from {TRAJECTORIES} where herida = 'normal')
  select fila_id, herida, dolor_nrs, fiebre_c from {TRAJECTORIES}, b where coalesce(herida, '') <> 'normal' and dolor_nrs between d[1] and d[2] and fiebre_c between f[1] and f[2]""")
def looks_normal(spark, folder: str) -> DataFrame:
    """Rows with another wound whose pain and fever lie where those of normal wounds do."""
    return analysis.within_band(table(spark, folder, TRAJECTORIES).select("fila_id", "herida", "dolor_nrs", "fiebre_c"), F.col("herida") == "normal", ["dolor_nrs", "fiebre_c"])


@query("""select count(*) filter (a.k is not null and b.k is not null) as ambas, count(*) filter (b.k is null) as solo_primera, count(*) filter (a.k is null) as solo_segunda
  from (select distinct lower(trim(llamada_id)) as k from turnos where llamada_id is not null) a full join (select distinct llamada_id as k from llamadas) b on a.k = b.k""")
def key_integrity(spark, folder: str) -> DataFrame:
    return analysis.key_report(table(spark, folder, "turnos").select(turnlog.call().alias("k")), table(spark, folder, "llamadas").select(F.col("llamada_id").alias("k")), "k")


# Sources and streams ----------------------------------------------------------------------------------------


@query("select event_id, user_id, event_type, value from events where event_id % 7 <> 0")
def jsonl_scan(spark, folder: str) -> DataFrame:
    """Events as lines of JSON, every seventh broken or no object, read back: what can't be read is skipped."""
    own = table(spark, folder, "events").select("event_id", F.to_json(F.struct("event_id", "user_id", "event_type", "value")).alias("j"))
    broken = F.when(F.col("event_id") % 14 == 0, F.concat(F.lit("["), F.col("j"), F.lit("]"))).otherwise(F.substring("j", 1, 20))
    lines = own.select(F.when(F.col("event_id") % 7 == 0, broken).otherwise(F.col("j")).alias("value"))
    return jsonl.parsed(lines, table(spark, folder, "events").select("event_id", "user_id", "event_type", "value").schema)


@query("select count(*) as lineas, count(*) filter (event_id % 7 <> 0) as objetos, count(*) filter (event_id % 7 = 0) as ilegibles from events")
def jsonl_report(spark, folder: str) -> DataFrame:
    own = table(spark, folder, "events").select(F.to_json(F.struct("event_id", "value")).alias("j"), "event_id")
    lines = own.select(F.when(F.col("event_id") % 7 == 0, F.substring("j", 1, 12)).otherwise(F.col("j")).alias("value"))
    return jsonl.line_report(lines, table(spark, folder, "events").select("event_id", "value").schema)


@query("""with n as (select event_id, event_id // 500 as bloque, row_number() over (partition by event_id // 500 order by event_id) as linea from events)
  select bloque, linea, event_id from n where event_id % 7 = 0""")
def jsonl_bad_lines(spark, folder: str) -> DataFrame:
    """Events written as files of JSON lines, some of them broken, and read back: file and number of every line that can't be read."""
    own = table(spark, folder, "events").select("event_id", F.floor(F.col("event_id") / 500).alias("bloque"), F.to_json(F.struct("event_id", "value")).alias("j"))
    rows = own.withColumn("value", F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("<"), F.col("j"))).otherwise(F.col("j"))).repartition("bloque").sortWithinPartitions("bloque", "event_id")
    path = new_folder(spark, "jsonl")
    rows.select("bloque", "value").write.partitionBy("bloque").text(path)
    bad = jsonl.bad_lines(jsonl.numbered(spark, path), table(spark, folder, "events").select("event_id", "value").schema)
    return bad.select(F.regexp_extract("fichero", r"bloque=(\d+)", 1).cast("bigint").alias("bloque"), "linea", F.regexp_extract("value", r'"event_id":(\d+)', 1).cast("bigint").alias("event_id"))


@query("select event_type, count(*) as n, round(sum(value), 2) as suma from events group by event_type")
def stream_tail(spark, folder: str) -> DataFrame:
    """Counts of a tailed table, complete once its files are read."""
    tail = logs.tailed(spark, f"{folder}/events.parquet").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("suma"))
    return logs.drained(tail, "complete", "tail")


@query("select time_bucket(interval '1 hour', ts) as inicio, event_type, count(*) as n, round(sum(value), 2) as suma from events group by all")
def stream_windows(spark, folder: str) -> DataFrame:
    """Hourly counts of the stream of events: windows are given again when they change and closed by the watermark (the table is one file, so nothing is late)."""
    found = logs.drained(logs.event_windows(logs.tailed(spark, f"{folder}/events.parquet")), "update", "windows", ["w", "event_type"])
    return found.select(F.col("w.start").cast("timestamp_ntz").alias("inicio"), "event_type", "n", "suma")


@query(f"""with f as (select distinct llamada, turno_idx, recibido_ts as en, latencia_ms.cliente_fin_habla_a_audio as ms from {TURNS} where clase_fila = 'turno' and llamada is not null and turno_idx is not null and recibido_ts is not null)
  select a.llamada, a.turno_idx, a.en, b.ms from f a join f b on a.llamada = b.llamada and a.turno_idx = b.turno_idx and b.en >= a.en and b.en <= a.en + interval '1 hour' where b.ms is not null and {FINITE.format(c='b.ms')} group by all""")
def stream_telemetry(spark, folder: str) -> DataFrame:
    """Turns of the log as one stream and their measures as another, joined where a measure comes within an hour of its turn."""
    log = logs.tailed(spark, f"{folder}/turnos.parquet").where((turnlog.kind() == "turno") & turnlog.call().isNotNull() & F.col("turno_idx").isNotNull() & F.col("recibido_ts").isNotNull())
    ms = stats.usable(F.col("latencia_ms.cliente_fin_habla_a_audio"))
    rows = log.select(turnlog.call().alias("llamada"), "turno_idx", F.col("recibido_ts").cast("timestamp").alias("en"), ms.alias("ms"))
    joined = logs.late_telemetry(rows.drop("ms"), rows.where("ms is not null"))
    found = logs.drained(joined, "append", "telemetry").where("ms is not null")
    return found.select("llamada", "turno_idx", F.col("en").cast("timestamp_ntz").alias("en"), "ms").distinct()


@query("""with e as (select user_id, ts, case when ts >= lag(ts) over (partition by user_id order by ts) + interval '6 hours' or lag(ts) over (partition by user_id order by ts) is null then 1 else 0 end as nuevo from events),
  s as (select user_id, ts, sum(nuevo) over (partition by user_id order by ts rows between unbounded preceding and current row) as k from e)
  select user_id, min(ts) as inicio, max(ts) as fin, count(*) as filas from s group by user_id, k having count(*) >= 2""")
def activity_spells(spark, folder: str) -> DataFrame:
    found = logs.spells(table(spark, folder, "events"), "user_id", "ts", "6 hours", 2)
    return found.select("user_id", F.col("inicio").cast("timestamp_ntz").alias("inicio"), F.col("fin").cast("timestamp_ntz").alias("fin"), "filas")
