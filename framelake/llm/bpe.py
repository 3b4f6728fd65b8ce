"""Problem 8: encoding of a whole corpus with a public byte-level BPE tokenizer."""

from __future__ import annotations

import base64
import importlib.util
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.sources.tables import table

#: Folder of the vocabulary files, unless a call names another.
DEFAULT_FOLDER = "/opt/tokenizers"
#: Bytes of text after which the next forced boundary ends a fragment.
FRAGMENT_BYTES = 1024
#: Characters above which a text's fragments are spread over tasks instead of being encoded in one.
LONG_TEXT = 1 << 20

#: Pre-tokenization pattern of the vocabulary (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def tokenizer_file(name: str, folder: str | None = None) -> str:
    """Path of a vocabulary file: in `folder`, the default folder or the installed package."""
    for place in [folder, DEFAULT_FOLDER]:
        if place and os.path.exists(os.path.join(place, name)):
            return os.path.join(place, name)
    spec = importlib.util.find_spec("public_tokenizers")
    if spec and spec.origin:
        return os.path.join(os.path.dirname(spec.origin), name)
    raise FileNotFoundError(name)


def load(path: str):
    with open(path, "rb") as f:
        return loaded(f.read())


@lru_cache(maxsize=4)
def loaded(data: bytes):
    """(encoder, table of forced boundaries) of a vocabulary in .tiktoken form; once a Python worker."""
    import tiktoken

    ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in data.splitlines() if line.strip())}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), boundary_table(ranks)


def boundary_table(ranks: dict[bytes, int]) -> np.ndarray:
    """65,536 flags: True at a * 256 + b if no token holds byte a followed by byte b.

    No merge ever joins such a pair, so a text may be cut there, as long as the cut is also one of the
    pattern: here only cuts between a byte that is no white space and a space or line break count,
    where every pattern match ends (a match holds white space at its start or throughout, never after
    another character). Bytes of the left side are 0x21-0x7E or the last byte of a longer character
    whose character is no white space; non-ASCII white space ends in bytes that are left out.
    """
    inside = np.zeros(65536, bool)
    for t in ranks:
        b = np.frombuffer(t, np.uint8).astype(np.int64)
        inside[b[:-1] * 256 + b[1:]] = True
    cut = ~inside
    left = np.zeros(256, bool)
    left[0x21:0x7F] = True
    right = np.zeros(256, bool)
    right[[0x20, 0x0A]] = True
    return cut & (left[:, None] & right[None, :]).reshape(-1)


def fragments(data: bytes, table: np.ndarray, least: int = FRAGMENT_BYTES) -> list[bytes]:
    """Pieces of UTF-8 text, cut at the first forced boundary after every `least` bytes."""
    if len(data) <= least:
        return [data]
    b = np.frombuffer(data, np.uint8)
    spots = np.flatnonzero(table[b[:-1].astype(np.int64) * 256 + b[1:]]) + 1
    out, at = [], 0
    while len(data) - at > least:
        i = np.searchsorted(spots, at + least)
        if i == len(spots):
            break
        out.append(data[at : spots[i]])
        at = int(spots[i])
    out.append(data[at:])
    return out


def encode_texts(texts: list[str | None], vocabulary: bytes) -> list[list[int] | None]:
    """Ids of each text: fragments are encoded independently, each distinct one once, and joined."""
    encoder, cuts = loaded(vocabulary)
    pieces = [None if t is None else fragments(t.encode("utf-8", "surrogatepass"), cuts) for t in texts]
    distinct = list(dict.fromkeys(p for ps in pieces if ps for p in ps))
    ids = dict(zip(distinct, (encoder.encode_ordinary(p.decode("utf-8", "replace")) for p in distinct)))
    return [None if ps is None else [i for p in ps for i in ids[p]] for ps in pieces]


def _encode(df: DataFrame, keys: list[str], vocabulary: Broadcast) -> DataFrame:
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            step = 512
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                ids = pa.array(encode_texts(part.column("text").to_pylist(), vocabulary.value), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keys], ids], [*keys, "ids"])

    return df.select(*keys, "text").mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", ids array<int>")


def encode_corpus(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken", folder: str | None = None, long_text: int = LONG_TEXT) -> DataFrame:
    """doc_id, ids: the token ids of every document's whole text, without special tokens.

    Defined cases: a null text gives null, an empty text an empty list; strings that look like special
    tokens are ordinary text; repeated rows each give a row. Texts up to long_text characters are
    encoded where they are read, without a shuffle. Longer ones are cut at forced boundaries first,
    their fragments are spread over all tasks, and the ids are joined in order again, so that no task
    bears a whole huge text's encoding.
    """
    with open(tokenizer_file(vocabulary, folder), "rb") as f:  # about a megabyte, shipped to the tasks
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(doc_id).alias("k"), F.col(text).alias("text"))
    short = _encode(rows.where(F.col("text").isNull() | (F.length("text") <= long_text)), ["k"], shared)
    long = rows.where(F.length("text") > long_text).withColumn("r", F.monotonically_increasing_id())
    kind = dict(rows.dtypes)["k"]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = loaded(shared.value)[1]
        for b in batches:
            for r, k, t in zip(b.column("r").to_pylist(), b.column("k"), b.column("text").to_pylist()):
                ps = [p.decode("utf-8", "replace") for p in fragments(t.encode("utf-8", "surrogatepass"), cuts, 1 << 16)]
                n = len(ps)
                yield pa.RecordBatch.from_arrays([pa.array([r] * n, pa.int64()), pa.array([k.as_py()] * n, k.type), pa.array(range(n), pa.int32()), pa.array(ps, pa.string())], ["r", "k", "n", "text"])

    pieces = long.select("r", "k", "text").mapInArrow(split, f"r long, k {kind}, n int, text string")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    coded = _encode(pieces.repartition(tasks, "r", "n"), ["r", "k", "n"], shared)
    joined = coded.groupBy("r").agg(F.first("k").alias("k"), F.array_sort(F.collect_list(F.struct("n", "ids"))).alias("p"))
    joined = joined.select("k", F.flatten("p.ids").alias("ids"))
    return short.unionByName(joined).select(F.col("k").alias(doc_id), "ids")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"))


def p8_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Tokens and documents per kind of text."""
    docs = table(spark, d, "documents")
    n = encode_corpus(docs).select("doc_id", F.size("ids").alias("n"), F.col("ids").isNull().alias("empty"))
    both = n.join(docs.select("doc_id", "source"), "doc_id")
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.when(~F.col("empty"), F.col("n")).otherwise(0)).alias("tokens"))
