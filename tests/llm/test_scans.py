import itertools
import random

import pytest

from urdimbre.llm import scans as S
from urdimbre.llm.automaton import Trie, scripts


@pytest.mark.parametrize(
    ("line", "number"),
    [("9", 9), ("  [12] ", 12), ("- 3 -", 3), ("Página 4 de 9", 4), ("Page 5 of 5", 5), ("Seite 1 von 4", 1), ("· 7 ·", 7), ("p. l8", 18), ("iii", 3), ("[l]", 1), ("15 / 16", 15), ("42.", None), ("39 %", None), ("38,9", None), ("semana 9.", None), ("Registro diario", None), ("", None),
     ("folio 000123", 123), ("CXII", 112), ("civic", None), ("- 1234567 -", 1234567), ("— " * 40 + "7", 7), ("0" * 5000, 0), ("9" * 5000, None)],
)
def test_page_numbers(line, number):
    found = S.page_number(line)
    assert (found and found[1]) == number


def test_title_keys_survive_misreading():
    assert S.title_key("MANUAL DE CUIDADOS TRAS LA CIRUGÍA   4") == S.title_key("12 | MANnAL DE CU1DADOS TRA5 LA CIRUGÍA")
    assert S.title_key("Fundación Ribera C1ara (ed. 2)") == S.title_key("Fundaclón Ribera Clara (ed. 2)")
    for line in ("una herida y el", "Termina aquí.", "12", "", "«Me duele", "abc-"):
        assert S.title_key(line) is None
    assert S.title_key("Guía de cuidados " + "muy " * 60 + "larga") == S.title_key("Guia de cu1dados " + "muy " * 60 + "larga")


def test_automata_find_all_within_two_edits():
    """Against the plain recursion over every vocabulary word: insertions, deletions, substitutions and look-alike pairs."""
    rng = random.Random(4)
    words = ["paciente", "pacientes", "dernier", "demier", "informe", "salvo", "médico", "casa", "cosa", "ñ", "a", "", "herida", "hospital", "x" * 70, *("".join(rng.choice("abcdlnrmu") for _ in range(rng.randrange(1, 7))) for _ in range(150))]
    trie = Trie(words)
    asked = ["paciete", "pacientte", "hospitel", "horida", "pacienta", "hérida", "pacicnte", "derner", "clemier", "infonne", "riz", "", "zzzzz", "x" * 69 + "y", *("".join(rng.choice("abcdlnrmu") for _ in range(rng.randrange(0, 7))) for _ in range(150))]
    got = {}
    for q, w, edits in trie.within(asked):
        for a, b, e in zip(q, w, edits):
            got[asked[a], trie.words[b]] = int(e)
    for w in asked:
        for v in set(words) - {""}:
            ways = scripts(v, w, 2)
            assert got.get((w, v)) == (len(ways[0]) if ways else None), (w, v)
    assert {v for (w, v) in got if w == "paciete"} == {"paciente", "pacientes"} and list(Trie([]).within(["a"]))[0][0].size == 0


def test_scripts():
    assert scripts("primera", "pnmera", 2) == [("ri>n",)] and scripts("casa", "casa", 2) == [()]
    assert scripts("modo", "rnocio", 2) == [] and ("m>rn", "d>cl") in scripts("modo", "rnoclo", 2)


def build(spark):
    clean = "El paciente debe mantener la herida seca. El tratamiento termina cuando el equipo lo confirme por escrito. La secreción amarillenta requiere aviso. El control médico-quirúrgico sigue."
    head = "Hospital Tres Robles (ed. 2)"
    pages = [("d", 1, f"El paciente debe mantener la herida seca. La secre-\n{head}\n- 1 -"), ("d", 2, f"{head}\nción amarillenta requiere aviso. El pacieute debe\nmantener. El control médico-\nquirúrgico sigue.\n- 2 -"), ("d", 3, f"{head}\nEl trata\xad\nmiento terrnina cuando\n\nel equipo lo confirme.\n- 3 -"), ("d", 3, f"{head}\nEl trata\xad\nmiento terrnina cuando\n\nel equipo lo confirme.\n- 3 -"), ("d", 4, None), ("e", 1, "  \n"), (None, 1, "x"), ("e", None, "y")]
    chunks = [("c1", "d", f"El paciente debe mantener la herida seca. La secre-\n{head}\nción amarillenta requiere aviso. El pacieute debe"), ("c2", "d", "mantener. El control médico-"), ("c3", "solo", "El pacieute debe"), ("c4", "d", None), ("c1", "d", f"El paciente debe mantener la herida seca. La secre-\n{head}\nción amarillenta requiere aviso. El pacieute debe")]
    table = lambda rows, kind: spark.createDataFrame(rows, kind).selectExpr("*", "'clash' as linea", "'clash' as tipo", "1 as fuera")
    lexicon = spark.createDataFrame([(clean,)] * 40, "texto string")
    return table(pages, "documento_id string, numero int, texto string"), table(chunks, "id string, documento_id string, texto string"), lexicon


def test_noisy_lines(spark):
    pages, chunks, clean = build(spark)
    got = sorted((r.tabla, r.clave, r.linea, r.tipo) for r in S.noisy_lines(pages, chunks, clean).collect())
    assert got == sorted(
        [
            ("paginas", "d:1", 0, "guion"), ("paginas", "d:1", 1, "cabecera"), ("paginas", "d:1", 2, "folio"), ("paginas", "d:2", 0, "cabecera"), ("paginas", "d:2", 1, "caracter"),
            ("paginas", "d:2", 5 - 1, "folio"), ("paginas", "d:3", 0, "cabecera"), ("paginas", "d:3", 1, "guion"), ("paginas", "d:3", 2, "caracter"), ("paginas", "d:3", 5, "folio"),
            ("trozos", "c1", 0, "guion"), ("trozos", "c1", 1, "cabecera"), ("trozos", "c1", 2, "caracter"), ("trozos", "c3", 0, "caracter"),
        ]
    )


def test_repaired(spark):
    pages, chunks, clean = build(spark)
    got = {}
    for r in S.repaired(pages, chunks, clean).orderBy("clave", "parrafo").collect():
        got.setdefault(r.clave, []).append(r.texto)
    assert got["d"][0] == "El paciente debe mantener la herida seca. La secreción amarillenta requiere aviso. El paciente debe mantener. El control médico-quirúrgico sigue."
    assert got["d"][1:] == ["El tratamiento termina cuando", "el equipo lo confirme."]
    assert got["c1"] == ["El paciente debe mantener la herida seca. La secreción amarillenta requiere aviso. El paciente debe"]
    assert set(got) == {"d", "c1", "c2", "c3"}


def test_empty_tables(spark):
    pages, chunks, clean = build(spark)
    assert S.noisy_lines(pages.limit(0), chunks.limit(0), clean).count() == 0
    assert S.noisy_lines(pages, chunks.limit(0), None).count() > 0
    assert list(itertools.islice(S.repaired(pages.limit(0), chunks.limit(0), clean).toLocalIterator(), 1)) == []


def test_running_lines_are_no_lines_of_text(spark):
    """A line as wide as the text that happens to stand twice at the edge of pages is no running line; a short title is."""
    body = "\n".join(["el texto de la página sigue con palabras que llenan el renglón hasta el final"] * 6)
    wide = "El equipo revisa la herida cada mañana y anota lo que ve en la hoja de control"
    pages = [("d", i, f"{wide if i < 3 else 'Otra cosa'}\n{body}\nfin.") for i in range(1, 6)] + [("e", i, f"{'Guía de casa' if i in (2, 4) else 'y sigue'}\n{body}\nfin.") for i in range(1, 6)]
    got = {(r.documento_id, r.numero) for r in S.furniture(spark.createDataFrame(pages, "documento_id string, numero int, texto string")).collect()}
    assert got == {("d", 3), ("d", 4), ("d", 5), ("e", 2), ("e", 4)}


def test_words_beside_tell_the_line_of_a_misreading(spark):
    """Of two corrections of a divided word, the one that follows "luna" elsewhere decides which of its lines is misread."""
    body = "\n".join(["brilla luna caradoea siempre"] * 3)
    pages = spark.createDataFrame([("d", 1, f"ayer vimos luna cara-\ndoca otra vez\n{body}")], "documento_id string, numero int, texto string")
    clean = spark.createDataFrame([("brilla luna siempre ayer vimos otra vez caradoea.",), ("earadoca earadoca",), ("earadoca earadoca earadoca",)] * 40, "texto string")
    chunks = spark.createDataFrame([], "id string, documento_id string, texto string")
    assert sorted((r.linea, r.tipo) for r in S.noisy_lines(pages, chunks, clean).collect()) == [(0, "guion"), (1, "caracter")]


def test_words_meet_the_vocabulary_in_every_task(spark):
    """Blocks of words and slices of the vocabulary find each other when they lie in several tasks, as large ones do."""
    known = [(f"{a}{b}{c}paciente", 100) for a in "bcdfg" for b in "aeiou" for c in "lmnrs"]
    unknown = [(w.replace("ente", x), 1) for w, _ in known for x in ("eute", "cnte", "enfe", "entc", "emte", "eente", "ente5", "ene", "nte", "entte")]
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    try:
        got = {(r.palabra, r.correcta) for r in S.retrieved(spark.createDataFrame(unknown, "palabra string, n bigint"), spark.createDataFrame(known, "palabra string, n bigint")).collect()}
    finally:
        spark.conf.unset(name)
    assert len({w for w, _ in got}) == len(unknown) == 1250
    assert {(w, v) for (w, _), v in zip(unknown, [k for k, _ in known for _ in range(10)])} <= got


def test_only_systematic_edits_are_misreadings(spark):
    """An edit that many words show is learnt; a rare word that only chance brings near another stays."""
    right = [f"{a}n{b}" for a in ("casa", "mes", "lla", "ro", "tri", "go") for b in ("te", "do", "ra", "li")]
    read = [w.replace("n", "u", 1) for w in right[:12]] + ["casanfe"]
    known = spark.createDataFrame([(w, 100) for w in right] + [(f"otra{chr(97 + i % 26)}{chr(97 + i // 26)}", 50) for i in range(300)], "palabra string, n bigint")
    unknown = spark.createDataFrame([(w, 1) for w in [*read, "casaute-mesndo", "otrazz", "goun"]], "palabra string, n bigint")
    got = {r.palabra: r.correcta for r in S.candidates(unknown, known).collect()}
    assert {w: got.get(w) for w in read[:12]} == dict(zip(read[:12], right[:12]))
    assert got["casaute-mesndo"] == "casante-mesndo" and "otrazz" not in got


def test_equal_lines_with_different_noise(spark):
    """A line that is a page number on one page and text on another is told by the page that the chunk starts on; a changed line judges its chunk by itself."""
    body = "El paciente descansa en casa y toma agua\n"
    pages = [("d", 1, f"{body}12\n{body}fin de la hoja\n1"), ("d", 2, f"{body * 3}2"), ("d", 12, f"{body * 3}12"), ("d", 13, f"{body * 3}13")]
    chunks = [("c1", "d", 1, f"{body}12\n{body}"), ("c2", "d", 12, f"{body}12"), ("c3", "d", 2, f"El pacieute descansa\n{body}")]
    clean = spark.createDataFrame([(body + "fin de la hoja El paciente descansa nunca antes",)] * 40, "texto string")
    got = sorted((r.clave, r.linea, r.tipo) for r in S.noisy_lines(spark.createDataFrame(pages, "documento_id string, numero int, texto string"), spark.createDataFrame(chunks, "id string, documento_id string, pagina int, texto string"), clean).where("tabla = 'trozos'").collect())
    assert ("c2", 1, "folio") in got and ("c3", 0, "caracter") in got and not [x for x in got if x[0] == "c1" and x[2] == "folio"]
