import pytest

from urdimbre.llm import sentences as S


def cut(text, form="prosa", together=()):
    return [text[a:b] for a, b in S.Document(text, form, list(together)).spans()]


@pytest.mark.parametrize(
    "wanted",
    [
        ["El Dr. de turno indicó 7,5 mg cada 3 h, aprox. hasta el jueves.", "Descanse."],
        ["«¿Puedo ducharme ya? ¿Y mojar la rodilla?», preguntó la paciente.", "¿Cuántas veces?"],
        ['La paciente dijo: "Ya camino sola por el pasillo."', "La Dra. que firmó el alta vino."],
        ['The nurse wrote: "No fever. Walks alone." and closed the file.', "(Home dressings need clean gloves.)", "Rest well."],
        ["Quedó pendiente la revisión... pero la paciente prefirió esperar.", "No sé…", "Bien."],
        ["« Puis-je me doucher ? Et conduire ? », a demandé la patiente.", "Bien !"],
        ["«Можно ли мне в душ? А за руль?» — спросила пациентка.", "Да."],
        ["Una temperatura de 37,4 °C no siempre indica infección; lo importante es: la tendencia.", "Sí."],
    ],
)
def test_sentences_parted_by_blanks(wanted):
    assert cut(" ".join(wanted)) == wanted
    assert cut("  " + "\n ".join(wanted) + "\n", "ajustado") == wanted


@pytest.mark.parametrize(
    "wanted",
    [["她说：“疼得少了。睡得也好。”", "“我可以洗澡吗？可以开车吗？”病人在电话里问。", "换药推迟了……因为病人想多休息。"], ["「もうお風呂に入れますか。運転はできますか。」と患者さんは尋ねました。", "氷を当てないでください！"]],
)
def test_scripts_without_spaces(wanted):
    assert cut("".join(wanted)) == wanted


def test_scripts():
    hindi = ["“क्या मैं नहा सकती हूँ? क्या गाड़ी चला सकती हूँ?” मरीज़ ने पूछा।", "डॉ. साहब ने 12.5 मि.ग्रा. लेने को कहा।"]
    greek = ["Μπορώ να κάνω ντους τώρα;", "Ο γιατρός έδωσε 0,5 mg, π.χ. μέχρι την Πέμπτη."]
    arabic = ["«هل أستطيع الاستحمام؟ وهل أقود السيارة؟» سألت المريضة.", "كانت الحرارة 37.2 درجة."]
    for wanted in (hindi, greek, arabic):
        assert cut(" ".join(wanted)) == wanted
    assert cut("เมื่อวานวัดไข้ได้ 37.2 องศา นอนหลับดี ห้ามวาง 3 ครั้ง") == ["เมื่อวานวัดไข้ได้ 37.2 องศา", "นอนหลับดี", "ห้ามวาง 3 ครั้ง"]


def test_units():
    text = "Antes de la revisión\n\nDescanse. Tenga a mano:\n1. Gasas limpias\n2. Vigilar. Avisar.\nb) Caminar 5 min. por la tarde"
    assert cut(text, "lista") == ["Antes de la revisión", "Descanse.", "Tenga a mano:", "1. Gasas limpias", "2. Vigilar.", "Avisar.", "b) Caminar 5 min. por la tarde"]
    assert cut("[00:12] Agente: ¿Cómo está? Dígame.\nP: bien gracias", "transcripcion") == ["[00:12] Agente: ¿Cómo está?", "Dígame.", "P: bien gracias"]
    assert cut("uno\ndos\r\n\r\ntres", "ajustado") == ["uno\ndos", "tres"]


def test_evidence_of_the_document():
    assert cut("Am 3. Tag kam sie. Gut.", together=["0 Tag"]) == ["Am 3. Tag kam sie.", "Gut."]
    assert cut("Vino el Lic. de ayer. El Lic. Pérez firmó. Fin.") == ["Vino el Lic. de ayer.", "El Lic. Pérez firmó.", "Fin."]
    assert cut("Vino el Lic. de ayer. ¿Quién? Pérez vino. Y con Pérez, con Pérez, el Lic. Pérez firmó. Fin.")[-2:] == ["Y con Pérez, con Pérez, el Lic. Pérez firmó.", "Fin."]
    assert cut("the end.The next. Done") == ["the end.", "The next.", "Done"]


def test_operator(spark, folder):
    docs = spark.createDataFrame([(1, "Hola. Adiós.", "prosa"), (1, "Hola. Adiós.", "prosa"), (2, None, "lista"), (3, " \n\t", None), (None, "Sí. No.", None), (4, "palabra " * 20000, "raro")], "doc_id bigint, text string, formato string").selectExpr("*", "1 as inicio", "'x' as juntas")
    got = sorted((str(r.doc_id), r.inicio, r.fin) for r in S.sentences(docs).collect())
    assert got == sorted([("1", 0, 5), ("1", 6, 12)] * 2 + [("None", 0, 3), ("None", 4, 7), ("4", 0, 159999)])
    assert S.sentences(docs.limit(0)).count() == 0
    found = {r.n for r in S.open_cases(spark.createDataFrame([(1, "Am 3. Tag. Vgl. S. 4 und etc. Gut.")], "doc_id int, text string")).collect()}
    assert {"Tag.", "S.", "Gut."} <= found


def test_corpus_evidence_is_a_rate(spark):
    """One sentence that opens with a word doesn't undo what hundreds show; the counts are those of the patterns."""
    texts = ["Am 3. Tag kam sie."] * 5 + ["Am ersten Tag, am zweiten Tag, am letzten Tag kam er."] * 60 + ["Ende. Tagelang geschah nichts, wirklich! Tag um Tag verging."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.juntas for r in S.kept_together(docs).collect()}
    assert set(got) == set(range(5)) and got[0] == ["0 Tag"]
    seen = {r.word: r for r in S.evidence(docs, spark.createDataFrame([("Tag",), ("kam",)], "word string")).collect()}
    assert seen["Tag"].opens == 1 and seen["Tag"].among == 60 * 3 + 1 - 1 or seen["Tag"].among >= 180
    assert set(seen) == {"Tag", "kam"}


def test_long_units_and_nested_quotes():
    """Thousands of marks in one unit, and pairs in pairs, are cut as short ones are."""
    piece = "Dijo «esto (o aquello). Sí» y calló. "
    assert len(cut(piece * 3000)) == 3000 and cut(piece * 2)[0] == piece.strip()
    assert len(cut("a. " * 5000 + "B")) >= 1
