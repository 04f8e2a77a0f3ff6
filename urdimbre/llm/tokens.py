"""Encoding of a corpus with a public byte-level BPE vocabulary.

Texts of up to ``CHUNK`` characters are encoded where they lie. Longer ones are cut into overlapping chunks
that are pre-tokenised in parallel. Neighbouring chunks are stitched at the first place of their overlap where
the pre-token boundaries of both agree and every tokenisation must have one: between a character that isn't
white space (nor an apostrophe) and one of another class. Chunks whose overlap has no such place are joined to
the chunk before and encoded as one piece. Pieces are then encoded in parallel and their ids put one after
another. Decoding concatenates the raw bytes of the ids.

Null and empty texts have no ids: an empty list. Strings of special tokens are ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from urdimbre.plans.lineage import cut, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Characters of a chunk, and of what it shares with the next.
CHUNK, OVERLAP = 4096, 512
#: Fixed value: how the vocabulary's texts are divided before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Between two characters of different class, the first neither white space nor an apostrophe.
CHANGE = regex.compile(r"(?<=\p{L})(?!\p{L})|(?<=\p{N})(?!\p{N})|(?<=[^\s\p{L}\p{N}'])(?=[\s\p{L}\p{N}])")
PRE_TOKEN = regex.compile(PATTERN)


@lru_cache(maxsize=2)
def _coder(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def vocabulary_bytes(spark: SparkSession, path: str = VOCABULARY):
    """The vocabulary file (about 1 MB, read once on the driver), sent to the executors."""
    return spark.sparkContext.broadcast(Path(path).read_bytes())


def _encode(vocabulary, column: str) -> Callable:
    """Adds to every batch the ids of its text column, which it drops."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(vocabulary.value)
        for b in batches:
            ids = [coder.encode_ordinary(t) if t else [] for t in b.column(column).to_pylist()]
            rest = [n for n in b.schema.names if n != column]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in rest), pa.array(ids, pa.list_(pa.int32()))], names=[*rest, "ids"])

    return run


def boundaries(text: str, first: int, last: int) -> list[int]:
    """Pre-token boundaries of ``text``, tokenised from its start, from ``first`` to ``last`` at changes of class."""
    ends = set()
    for m in PRE_TOKEN.finditer(text):
        if m.end() > last:
            break
        if m.end() >= first:
            ends.add(m.end())
    return [m.start() for m in CHANGE.finditer(text, max(0, first - 1), min(len(text), last + 1)) if m.start() in ends and m.start() < len(text)]


def _chunks(size: int, overlap: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, text in zip(b.column("key").to_pylist(), b.column("text").to_pylist()):
                for at in range(0, len(text), size * 256):  # a very long text goes out in several batches
                    starts = range(at, min(len(text), at + size * 256), size)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key] * len(starts), pa.int64()), pa.array([s // size for s in starts], pa.int32()), pa.array([text[s : s + size + overlap] for s in starts], pa.string())],
                        names=["key", "i", "chunk"],
                    )

    return run


def _seams(size: int, overlap: int) -> Callable:
    """Of every chunk the boundaries in its first ``overlap`` characters, and in those it shares with the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("chunk").to_pylist()
            heads = [boundaries(t, 1, overlap - 1) for t in texts]
            tails = [[p - size for p in boundaries(t, size + 1, size + overlap - 1)] for t in texts]
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(heads, kind), pa.array(tails, kind)], names=[*b.schema.names, "head", "tail"])

    return run


def encode(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``id_column, ids`` of every row of ``docs``; repeated rows and ids come out as often as they come in."""
    voc = vocabulary_bytes(docs.sparkSession, vocabulary)
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    short = F.col("text").isNull() | (F.length("text") <= chunk)
    done = rows.where(short).mapInArrow(_encode(voc, "text"), f"id {kind}, ids array<int>")
    long = cut(rows.where(~short).withColumn("key", F.monotonically_increasing_id()))
    pieces = long.select("key", "text").mapInArrow(_chunks(chunk, overlap), "key bigint, i int, chunk string")
    seams = pieces.repartition("key", "i").mapInArrow(_seams(chunk, overlap), "key bigint, i int, chunk string, head array<int>, tail array<int>")
    along = Window.partitionBy("key").orderBy("i")
    agreed = F.try_element_at(F.array_sort(F.array_intersect("head", F.lag("tail").over(along))), F.lit(1))
    stitched = seams.withColumn("seam", F.when(F.col("i") == 0, 0).otherwise(agreed)).withColumn("piece", F.count("seam").over(along))
    # A piece is a stitched chunk and those after it that are not; it ends where the next one begins.
    joined = (
        stitched.groupBy("key", "piece").agg(F.array_sort(F.collect_list(F.struct("i", "chunk", "seam"))).alias("parts"))
        .withColumn("first", F.element_at("parts", 1)["seam"]).withColumn("next", F.lead("first").over(Window.partitionBy("key").orderBy("piece")))
        .withColumn("whole", F.concat(F.array_join(F.transform(F.slice("parts", 1, F.size("parts") - 1), lambda p: F.substring(p["chunk"], 1, chunk)), ""), F.element_at("parts", -1)["chunk"]))
        .withColumn("end", F.when(F.col("next").isNull(), F.length("whole")).otherwise((F.size("parts")) * chunk + F.col("next")))
        .select("key", "piece", F.substring("whole", F.col("first") + 1, F.col("end") - F.col("first")).alias("text"))
    )
    coded = joined.repartition("key", "piece").mapInArrow(_encode(voc, "text"), "key bigint, piece bigint, ids array<int>")
    whole = coded.groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("piece", "ids"))), lambda p: p["ids"])).alias("ids"))
    return done.union(long.select("key", "id").join(whole, "key").select("id", "ids")).withColumnRenamed("id", id_column)


def decode(coded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``coded`` with its ``ids`` replaced by the ``bytes`` they stand for; null ids give null."""
    voc = vocabulary_bytes(coded.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(voc.value)
        for b in batches:
            raw = [None if ids is None else coder.decode_bytes(ids) for ids in b.column("ids").to_pylist()]
            rest = [n for n in b.schema.names if n != "ids"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in rest), pa.array(raw, pa.binary())], names=[*rest, "bytes"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema if f.name != "ids"]
    return coded.mapInArrow(run, ", ".join([*fields, "bytes binary"]))


def p6_ids(spark, folder: str) -> DataFrame:
    """Token ids of every document."""
    return encode(table(spark, folder, "documents"))


def p6_vuelta(spark, folder: str) -> DataFrame:
    """Number of ids of every document, and whether decoding them gives its text again."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    coded = encode(docs).withColumn("n_ids", F.size("ids"))
    back = decode(coded).withColumn("vuelta", F.decode("bytes", "UTF-8")).select("doc_id", "n_ids", "vuelta")
    return docs.join(back, "doc_id").select("doc_id", "n_ids", (F.coalesce("text", F.lit("")) == F.col("vuelta")).alias("igual"))


def p6_control(spark, folder: str) -> DataFrame:
    """One row: documents, those without ids, and whether decoding gives every text again."""
    back = p6_vuelta(spark, folder)
    return back.agg(F.count("*").alias("documentos"), F.count_if(F.col("n_ids") == 0).alias("vacios"), F.min("igual").alias("iguales"))


SQL: dict[str, str] = {"p6_control": "select count(*) as documentos, count(*) filter (coalesce(text, '') = '') as vacios, true as iguales from documents"}
QUERIES = {"p6_ids": p6_ids, "p6_vuelta": p6_vuelta, "p6_control": p6_control}
