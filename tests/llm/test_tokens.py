import pytest

from urdimbre.llm import tokens as T

TEXTS = [
    (1, "Hello   world, it's 3.5 mg\n\n  twice"), (2, None), (3, ""), (4, " "), (5, "x" * 700), (6, "术后最初" * 200), (7, "a  \n b" * 90), (8, "<|endoftext|> y <|endoftext|>"),
    (9, "''''s's'd're" * 60), (10, "\t\t\t   \n" * 80), (11, "मरीज़ ने पूछा। 👩‍⚕️ " * 40), (1, "repetida"), (None, "sin id"), (12, "ab1 " * 900),
]


@pytest.mark.parametrize(("chunk", "overlap"), [(4096, 512), (64, 24), (20, 9), (7, 3)])
def test_chunks_give_the_same_ids(spark, chunk, overlap):
    coder = T._coder(open(T.VOCABULARY, "rb").read())
    docs = spark.createDataFrame(TEXTS, "doc_id bigint, text string").selectExpr("*", "1 as key", "2 as i", "3 as ids")
    got = sorted((str(r.doc_id), list(r.ids)) for r in T.encode(docs, chunk=chunk, overlap=overlap).collect())
    assert got == sorted((str(k), coder.encode_ordinary(t) if t else []) for k, t in TEXTS)


def test_same_as_the_other_library():
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(T.VOCABULARY.replace(".tiktoken", ".json"))
    other.encode_special_tokens = True
    coder = T._coder(open(T.VOCABULARY, "rb").read())
    assert all(coder.encode_ordinary(t) == other.encode(t, add_special_tokens=False).ids for _, t in TEXTS if t)


def test_round_trip(spark, folder):
    assert [tuple(r) for r in T.p6_vuelta(spark, folder).select("igual").distinct().collect()] == [(True,)]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert T.encode(empty).count() == 0 and T.decode(T.encode(empty)).count() == 0
