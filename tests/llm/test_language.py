import random
import re
import time
import tracemalloc
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from urdimbre.llm import language as G
from urdimbre.llm import scans

BIG = "/root/testdata/sf0.01"


def counts(texts):
    from collections import Counter

    c = Counter()
    for label, text in texts:
        for w in text.split():
            p = f" {w} "
            for end in range(2, len(p) + 1):
                c[label, p[max(0, end - G.ORDER) : end]] += 1
    return pd.DataFrame([(a, g, n) for (a, g), n in c.items()], columns=["idioma", "g", "n"])


def test_probabilities_add_up_to_one():
    m = G.kneser_ney(counts([("es", "la casa de la cama cama"), ("en", "the cat sat on the mat")]), ["en", "es"])
    letters = sorted({c for c in "la casa de la cama the cat sat on mat"} | {" "})
    for before in ("", "c", "ca", "t"):
        whole = np.zeros(2)
        for c in letters:
            codes = np.array([ord(x) for x in f" {before}{c}"], np.uint64)
            ends, n = np.array([len(codes) - 1]), min(len(codes), G.ORDER)
            p = np.zeros(2)
            while True:
                row, there = G.find(m.grams[n - 1], G.gram_hash(codes, ends, n))
                if there[0]:
                    p += m.logs[n - 1][row[0]]
                    break
                if n == 1:
                    p += m.floor
                    break
                row, there = G.find(m.contexts[n - 1], G.gram_hash(codes, ends - 1, n - 1))
                if there[0]:
                    p += m.backs[n - 1][row[0]]
                n -= 1
            whole += np.exp(p)
        assert np.all(whole <= 1.0001) and np.all(whole > 0.9)


@pytest.fixture(scope="module")
def models(spark, folder):
    return G.models_of(spark, BIG)


def rows(spark, texts):
    return spark.createDataFrame([("t", str(i), None, 0, t, []) for i, t in enumerate(texts)], "tabla string, clave string, etiqueta string, parte bigint, texto string, fuera array<int>")


def test_held_out_accuracy(spark, models):
    texts = {
        "es": "Mañana tengo que ir al hospital con mi hermana para la revisión", "en": "Tomorrow I will have to go to the hospital with my sister", "fr": "Demain je dois aller à l'hôpital avec ma sœur pour le contrôle",
        "de": "Morgen muss ich mit meiner Schwester in das Krankenhaus gehen", "it": "Domani devo andare in ospedale con mia sorella per il controllo", "pt": "Amanhã tenho que ir ao hospital com a minha irmã para a consulta",
        "ru": "Завтра мне нужно поехать в больницу с сестрой", "el": "Αύριο πρέπει να πάω στο νοσοκομείο με την αδελφή μου", "th": "พรุ่งนี้ฉันต้องไปโรงพยาบาลกับพี่สาว", "zh": "如果明天发烧，请马上给医生打电话",
    }
    got = {int(r.clave): r.idioma for r in G.segments(rows(spark, texts.values()), models).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts)


def test_segments_of_a_mixed_text(spark, models):
    text = "Tome la medicación con alimentos y anote la hora. Never put ice straight on the wound! Descanse por la noche y camine despacio."
    got = [(r.idioma, r.letras) for r in G.segments(rows(spark, [text, None, "", "12 34", "x" * 50000]), models, texts=True).where("clave = '0'").orderBy("orden").collect()]
    assert [g[0] for g in got] == ["es", "en", "es"] and got[1][1] == 29
    everything = G.segments(rows(spark, [text, None, "", "12 34"]), models).collect()
    assert {r.clave for r in everything} == {"0"} and all(0 <= r.confianza <= 1 for r in everything)


def test_rejection(spark, models):
    got = G.segments(rows(spark, ["qzxw kvqj xxqz wqkz jqxv zzkq vwxq kqzj"]), models).collect()
    assert [r.idioma for r in got] == [G.UNKNOWN]


def test_lines_left_aside(spark, models):
    given = rows(spark, ["Hospital of the patients\nTome la medicación con alimentos"]).selectExpr("tabla", "clave", "etiqueta", "parte", "texto", "array(0) as fuera")
    assert [r.idioma for r in G.segments(given, models).collect()] == ["es"]


def test_lines_like_furniture_are_told_without_their_keys(monkeypatch):
    """Running text is refused at its fifth word and titles aren't brought to their shapes, however many lines there are."""
    lines = ["y anote la hora en que toma el medicamento", "Hospital de los pacientes del norte", "12", "Tome la medicación.", "", " — 3 — ", "iv", "a de b de c"]
    calls = {"shape": 0, "words": 0}

    class Counted:
        def findall(self, line, own=scans.TOKEN):
            calls["words"] += 1
            return own.findall(line)

    monkeypatch.setattr(scans, "shape", lambda text, own=scans.shape: (calls.__setitem__("shape", calls["shape"] + 1), own(text))[1])
    monkeypatch.setattr(scans, "TOKEN", Counted())
    many = pa.RecordBatch.from_pydict({"id": ["a"], "documento_id": ["d"], "texto": ["\n".join(lines[:2] * 500)]})
    assert sum(b.num_rows for b in G._furniture_like(iter([many]))) == 500
    assert calls == {"shape": 0, "words": 500}
    one = pa.RecordBatch.from_pydict({"id": ["a", "b"], "documento_id": ["d", "d"], "texto": ["\n".join(lines), None]})
    assert [r["renglon"] for b in G._furniture_like(iter([one])) for r in b.to_pylist()] == [lines[1], "12", " — 3 — ", "iv"]


def test_every_labelled_row_is_learnt_from(spark, monkeypatch):
    """The word of any one row of many is known to the models, and every piece counts for rejection and confidence."""
    said = [f"palabra{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}{chr(97 + i // 676)}q" for i in range(900)]
    told = []
    monkeypatch.setattr(G, "calibrate", lambda models, held, own=G.calibrate: (told.append(held), own(models, held))[1])
    models = G.train(spark.createDataFrame([(i, f"la casa de {w} y otras cosas", "es") for i, w in enumerate(said)] + [(1000 + i, "the house and other things", "en") for i in range(20)], "clave int, texto string, idioma string"))
    grams = G.text_hash([w[-4:] + " " for w in said], G.ORDER)
    assert models.languages == ["en", "es"] and G.find(models.grams[G.ORDER - 1], grams)[1].all()
    assert told[0].query("clase == 2")["n"].sum() == 920


def test_quantiles_of_counted_values():
    rng = np.random.default_rng(3)
    for many in (1, 2, 5, 1000):
        values = rng.integers(0, 50, many)
        each, n = np.unique(values, return_counts=True)
        for q in (0, 0.05, 0.5, 0.998, 1):
            assert G.quantile(each[::-1], n[::-1], q) == pytest.approx(np.quantile(values, q))


def test_no_labels(spark):
    empty = G.train(spark.createDataFrame([(1, None, "es"), (2, "hola", None)], "clave int, texto string, idioma string"))
    assert empty.languages == [] and G.segments(rows(spark, ["hola"]), empty).count() == 0
    labels = spark.createDataFrame([("ES ", "es"), ("es", "es"), ("x", None), ("d", "a"), ("D", "b"), (None, "c")], "etiqueta string, codigo string")
    assert [(r.etiqueta, r.codigo) for r in G.codes_of(labels).collect()] == [("es", "es")]


def test_queries(spark, folder):
    assert G.p5_found(spark, folder).count() > 0
    assert G.p5_idiomas(spark, folder).where("confianza < 0 or confianza > 1").count() == 0


def test_pieces_are_the_same_with_and_without_strings(models):
    texts = ["Hola. ¿Qué tal?\nMuy bien;\n\notra cosa…\nSeñales DE alarma", None, "", "一。二！三", "solo\nesto"]
    a, b = (G.Pieces(texts, [None] * 5, models, strings=x) for x in (False, True))
    assert list(a.text) == list(b.text) and list(a.letters) == [sum(map(str.isalpha, s)) for s in b.strings]


#: Words, and what parts pieces.
TOKEN = re.compile(r"[^\W\d_]+|[.!?…;:؟](?=\s)|[।。！？]|\n(?=[^\S\n]*\n)|\n(?=[«„“\"(¿¡\[]*[A-ZÀ-ÞΑ-ΩА-Я])")


def test_words_and_pieces_are_those_of_the_pattern(models, monkeypatch):
    """Whatever the characters and however the texts fall into blocks."""
    rng = random.Random(7)
    some = list(".!?…;:؟।。！？\n\n\n \t\r\x85\xa0«“\"(¿[AÀΩЯaяñ1²½Ⅳ٣ßİΣσς_-ेก中\0𝒳") + ["hola", "ΟΔΟΣ", "\n\n", "\n «A"]
    for _ in range(300):
        monkeypatch.setattr(G, "CHARS", rng.choice([1, 7, 50, 1 << 18]))
        monkeypatch.setattr(G, "WORDS", rng.choice([1, 5, 1 << 14]))
        texts = ["".join(rng.choices(some, k=rng.randint(0, 60))) for _ in range(rng.randint(0, 8))]
        want: list[tuple[int, list[str]]] = []
        for i, text in enumerate(texts):
            fresh = True
            for t in TOKEN.findall(text):
                if not t[0].isalpha():
                    fresh = True
                elif fresh:
                    want.append((i, [t.lower()]))
                    fresh = False
                else:
                    want[-1][1].append(t.lower())
        p = G.Pieces(texts, [None] * len(texts), models)
        ends = [*p.starts[1:], len(p.own)]
        assert [(t, [p.words[w] for w in p.own[i:j]]) for t, i, j in zip(p.text.tolist(), p.starts, ends)] == want
        assert p.letters.tolist() == [sum(map(len, ws)) for _, ws in want] and np.allclose(p.score, [models.score(ws).sum(0) for _, ws in want] if want else p.score)


def test_words_of_a_batch_take_little_memory(models):
    """Neither a string nor a row of scores is held for each word of a batch: 107 bytes (it was 205 with 13 languages)."""
    texts = ["Tome la medicación con alimentos y anote la hora. " * 20] * 1000
    tracemalloc.start()
    try:
        pieces = G.Pieces(texts, [None] * len(texts), models)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(pieces.own) == 180_000 and most / len(pieces.own) < 150, most / len(pieces.own)


def test_shuffles_of_all_texts_are_cleared(spark, folder):
    """Of those that the tables of records were made of only that of the last job may be left before texts are told the language of."""
    here = Path(spark.sparkContext.getConf().get("spark.local.dir"))
    files = lambda: {p.name for p in here.rglob("shuffle_*.data")}
    before, until = files(), time.time() + 15
    assert G.records(spark, folder).columns[0] == "tabla"
    while len(files() - before) > 1 and time.time() < until:
        time.sleep(0.2)
    assert len(files() - before) <= 1
