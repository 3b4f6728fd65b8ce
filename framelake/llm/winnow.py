"""Problem 9: passages of evaluation texts inside training texts."""

from __future__ import annotations

import html
import re
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.sources.tables import table

#: Consecutive words that make a passage.
PASSAGE = 12
#: Words of a fingerprinted gram, and consecutive grams of which the smallest is kept: any shared
#: span of GRAM + WINDOW - 1 = PASSAGE words shares its smallest gram on both sides.
GRAM = 4
WINDOW = PASSAGE - GRAM + 1
#: Bytes of fingerprints and word hashes of evaluation texts that a task holds at a time (a block).
HELD_BYTES = 32 << 20
#: Characters of training text that are scanned together.
SCAN_CHARS = 1 << 20

_TAG = re.compile(r"<(?:/?[A-Za-z][^<>]*|!--.*?--|![A-Za-z][^<>]*)>", re.S)
_BLOCK = re.compile(r"</?(?:br|p|div|li|ul|ol|dl|dt|dd|td|tr|th|table|h[1-6]|hr|blockquote|pre|section|article|option|img)\b", re.I)
_LINK = re.compile(r"!?\[([^\[\]]*)\]\(\s*<?[^()\s]*>?(?:\s+\"[^\"]*\")?\s*\)")
_WORD = re.compile(r"[^\W_]+")
_APOS = re.compile("(?<=[^\\W_])['’ʼ＇](?=[^\\W_])")
_INVISIBLE = {c: None for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cf"}


def words(text: str | None) -> list[str]:
    """Words of a text in normal form.

    Letter case, punctuation, spacing, line breaks, markup (tags, entities, Markdown links and
    marks), invisible signs and the composition of accented letters do not count; an apostrophe
    within a word is left out. A run of letters without blanks is one word, in any script. Null has
    no words.
    """
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(lambda m: " " if _BLOCK.match(m[0]) else "", text)
    if "](" in text:
        text = _LINK.sub(r"\1", text)
    if text.isascii():
        text = text.lower()
    else:
        text = unicodedata.normalize("NFKC", text.translate(_INVISIBLE))
        text = unicodedata.normalize("NFC", text.casefold())
    return _WORD.findall(_APOS.sub("", text))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all texts in a row, where each text's begin and the last ends).

    Each distinct word is hashed once."""
    every: list[str] = []
    at = [0]
    for t in texts:
        every += words(t)
        at.append(len(every))
    coded = pa.array(every, pa.large_string()).dictionary_encode()
    of_word = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    return of_word[coded.indices.to_numpy()] if every else np.empty(0, np.uint64), np.array(at, np.int64)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k word hashes."""
    return grams_at(h, np.arange(max(0, len(h) - k + 1)), k)


def grams_at(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k word hashes that begin at the given places."""
    acc = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            acc = acc * np.uint64(0x9E3779B97F4A7C15) + h[at + j]
            acc ^= acc >> np.uint64(29)
        acc *= np.uint64(0xBF58476D1CE4E5B9)
        acc ^= acc >> np.uint64(32)
    return acc


def winnowed(g: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the hashes that are smallest in some window of `window` consecutive ones (all that tie)."""
    if len(g) <= window:
        return np.flatnonzero(g == g.min()) if len(g) else np.empty(0, np.int64)
    least = _over(g, window, np.minimum)
    edge = np.full(window - 1, 0, np.uint64)
    most = _over(np.concatenate([edge, least, edge]), window, np.maximum)  # of the windows a place lies in
    return np.flatnonzero(most == g)


def _over(a: np.ndarray, window: int, f) -> np.ndarray:
    """f over every window of consecutive elements, by doubling."""
    n, out = 1, a
    while 2 * n <= window:
        out = f(out[: len(out) - n], out[n:])
        n *= 2
    rest = window - n
    return f(out[: len(out) - rest], out[rest:]) if rest else out


def _among(marks: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, from, to): which x are in the sorted marks, and the range of equal marks of each."""
    if not len(marks) or not len(x):
        none = np.empty(0, np.int64)
        return none, none, none
    lo = np.searchsorted(marks, x)
    i = np.flatnonzero(marks[np.minimum(lo, len(marks) - 1)] == x)
    return i, lo[i], np.searchsorted(marks, x[i], "right")


def _expand(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, number) of every number of the ranges lo..hi-1."""
    n = hi - lo
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


@dataclass(frozen=True)
class Held:
    """Fingerprints of a block of evaluation texts.

    Texts of PASSAGE words or more: winnowed grams with the place of each in `h`, sorted by hash.
    Shorter ones: one hash of the whole text, by its number of words, and the hashes of their first words.
    """

    h: np.ndarray
    at: np.ndarray
    marks: np.ndarray
    place: np.ndarray
    item: np.ndarray
    short: dict[int, tuple[np.ndarray, np.ndarray]]
    first: np.ndarray

    @staticmethod
    def of(texts: list[str | None]) -> Held:
        h, at = word_hashes(texts)
        marks, place, item = [], [], []
        short: dict[int, list[tuple[int, int]]] = {}
        first = []
        for i, (a, b) in enumerate(zip(at[:-1], at[1:])):
            if b - a >= PASSAGE:
                g = grams(h[a:b], GRAM)
                p = winnowed(g)
                marks.append(g[p])
                place.append(p + a)
                item.append(np.full(len(p), i))
            elif b > a:
                short.setdefault(int(b - a), []).append((int(grams(h[a:b], int(b - a))[0]), i))
                first.append(h[a])
        marks, place, item = (np.concatenate(x) if x else np.empty(0, kind) for x, kind in ((marks, np.uint64), (place, np.int64), (item, np.int64)))
        order = np.argsort(marks, kind="stable")
        whole = {n: sorted(rows) for n, rows in short.items()}
        return Held(h, at, marks[order], place[order], item[order], {n: (np.array([x for x, _ in r], np.uint64), np.array([i for _, i in r], np.int64)) for n, r in whole.items()}, np.unique(np.array(first, np.uint64)))

    def found(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(text, item): which of the texts holds a passage of which item, each pair once."""
        h, at = word_hashes(texts)
        docs, items = [], []
        owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
        g = grams(h, GRAM)
        p = winnowed(g)
        i, lo, hi = _among(self.marks, g[p])
        n, m = _expand(lo, hi)
        p = p[i][n]
        for a in range(0, len(p), 1 << 20):  # a hot gram has many hits
            d, x = p[a : a + (1 << 20)], m[a : a + (1 << 20)]
            long = self._extended(h, at, owner, d, x) >= PASSAGE
            docs.append(owner[d[long]])
            items.append(self.item[x[long]])
        starts = np.flatnonzero(np.isin(h, self.first)) if self.short else np.empty(0, np.int64)
        for n, (marks, of) in self.short.items():
            s = starts[starts + n <= at[1:][owner[starts]]] if len(starts) else starts
            i, lo, hi = _among(marks, grams_at(h, s, n))
            k, m = _expand(lo, hi)
            docs.append(owner[s[i][k]])
            items.append(of[m])
        both = np.unique(np.stack([np.concatenate(docs or [np.empty(0, np.int64)]), np.concatenate(items or [np.empty(0, np.int64)])]), axis=1)
        return both[0], both[1]

    def _extended(self, h: np.ndarray, at: np.ndarray, owner: np.ndarray, d: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Words that text and item share in a row around each hit of gram m at place d; 0 where the gram's words differ."""
        q, item, doc = self.place[m], self.item[m], owner[d]
        d_from, d_to, q_from, q_to = at[doc], at[doc + 1], self.at[item], self.at[item + 1]

        def same(by: int) -> np.ndarray:
            x, y = d + by, q + by
            inside = (x >= d_from) & (x < d_to) & (y >= q_from) & (y < q_to)
            return inside & (h[np.where(inside, x, 0)] == self.h[np.where(inside, y, 0)])

        total = np.full(len(d), GRAM)
        for j in range(GRAM):
            total[~same(j)] = 0
        for way in (-1, 1):
            on = total > 0
            for j in range(1, PASSAGE - GRAM + 1):
                on &= same(way * j + (GRAM - 1 if way > 0 else 0))
                total += on
        return total


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", held_bytes: int = HELD_BYTES) -> DataFrame:
    """doc_id, item_id: documents and the evaluation items of which each holds a passage.

    A passage is twelve consecutive words of the item, or the whole item if it has fewer. Winnowed
    fingerprints of both sides meet by hash with their places, and every hit is extended word by word
    to both sides (words are compared by 64-bit hashes); items below twelve words are met by a hash of
    their whole. Null, empty and wordless texts hold nothing and leak nothing; rows without id are
    left out; repeated texts each count; ids are of any type.

    The evaluation side is a query set that all rows are scanned against, in blocks of at most about
    held_bytes of fingerprints (by hash of the id; a single longer text is a block of its own size):
    one pass over the documents a block, without a shuffle, and no hot gram gathers rows in one task.
    """
    items = items.where(F.col(text).isNotNull() & F.col(item_id).isNotNull()).select(F.col(item_id).alias("i"), F.col(text).alias("t"))
    docs = docs.where(F.col(text).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("d"), F.col(text).alias("t"))
    # A word takes at most 8 bytes as a hash and, in half of all places, 24 as a fingerprint; two characters a word at least.
    size = 10 * (items.agg(F.sum(F.length("t").cast("long")).alias("n")).first()["n"] or 0)
    blocks = max(1, -(-size // held_bytes))
    found = None
    for b in range(blocks):
        own = _scanned(docs, items if blocks == 1 else items.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b))
        found = own if found is None else found.unionByName(own)
    return found.select(F.col("d").alias(doc_id), F.col("i").alias(item_id))


def _scanned(docs: DataFrame, items: DataFrame) -> DataFrame:
    rows = items.toArrow()
    shared = docs.sparkSession.sparkContext.broadcast((rows.column("i").combine_chunks(), Held.of(rows.column("t").to_pylist())))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held = shared.value
        for b in batches:
            upto, chars, texts = 0, 0, []
            for n, t in enumerate(b.column("t").to_pylist(), 1):
                texts.append(t)
                chars += len(t)
                if n == b.num_rows or chars > SCAN_CHARS:
                    d, i = held.found(texts)
                    yield pa.RecordBatch.from_arrays([b.column("d").take(pa.array(d + upto)), ids.take(pa.array(i))], ["d", "i"])
                    upto, chars, texts = n, 0, []

    return docs.mapInArrow(scan, f"d {dict(docs.dtypes)['d']}, i {dict(items.dtypes)['i']}")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_item"))


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    """Per item that leaked: split, source and the number of documents that hold it."""
    found = leaks(table(spark, d, "documents"), table(spark, d, "eval_item"))
    n = found.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))
    return n.join(table(spark, d, "eval_item").select("item_id", "split_name", "source_name"), "item_id")
