"""Problem 10: texts garbled by a wrong character encoding."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.session import cut
from framelake.sources.tables import table

#: Single-byte code pages that bytes may have been read in (fixed values).
READ_AS = ["cp1252", "latin-1", "cp437", "cp850", "cp852", "cp1250", "cp1251", "cp1254", "mac_roman", "koi8_r", "cp866", "iso8859_2", "iso8859_5", "iso8859_15", "mac_cyrillic"]
#: Code pages the bytes were written in, beside UTF-8 (fixed values).
WRITTEN_IN = ["cp1252", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "cp852", "cp866", "koi8_r", "iso8859_2", "iso8859_5", "iso8859_15", "mac_latin2", "mac_cyrillic"]
#: Multi-byte encodings other than UTF-8 and the pages their bytes are read in (fixed values).
WIDE, WIDE_READ_AS = ["euc_jp", "shift_jis", "gb18030"], ["cp1252", "latin-1", "cp1251", "mac_roman", "cp437"]
#: Those of them whose characters may hold bytes of ASCII.
ASCII_INSIDE = {"shift_jis", "gb18030"}
#: Places of the bigram and character tables.
PAIRS, CHARS = 1 << 20, 1 << 16
#: Rounds of expectation-maximization.
ROUNDS = 4
#: Characters of the original that must have been turned into others for a document to count.
LEAST = 3
#: Evidence (in nats) that a word needs before it speaks for a swap of its document.
MARGIN = 1.0
#: Evidence (in nats) a swap other than the document's main one must bring beyond its prior.
OTHER_SWAP = 6.0
#: Evidence (in nats) against a word in capitals that only its small letters speak for.
CAPITALS = 3.0
#: Sources are learned apart in this many classes, by hash: one each unless there are thousands.
CLASSES = 4096
#: Nats by which a form may lie below the likeliest one and still be kept in mind: more than what
#: the prior of a swap (at least 0.02 in all) and OTHER_SWAP can make up for.
FAR = 25.0
#: Bytes of restored forms that may be broadcast to the documents.
SENT_BYTES = 8 << 20
#: White space between words that no misreading yields.
BLANKS = " \n\t\r"
LOST = "�"

KEEP, LEARNED = "as it is", "learned"
#: A letter of an unknown page is believed if it has this share of its character's weight, this much
#: evidence (in nats) and this many different surroundings; a table needs this many such letters.
SURE, EVIDENCE, SURROUNDINGS, LETTERS = 0.9, 40.0, 5, 3
#: Rounds in which a character's letter is learned.
LETTER_ROUNDS = 5
#: Prior (in nats) of a learned table against none.
LEARNED_PRIOR = -4.0


@lru_cache(maxsize=None)
def _page(name: str) -> tuple[dict[str, int], str]:
    """(byte of each character, characters of all bytes); undefined bytes stand for themselves."""
    chars = []
    for b in range(256):
        try:
            chars.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            chars.append(chr(b))
    byte = {ch: b for b, ch in enumerate(chars)}
    for b in range(128, 160):  # C1 controls, which lenient readers pass through
        byte.setdefault(chr(b), b)
    return byte, "".join(chars)


def _to_bytes(s: str, page: str) -> bytes | None:
    byte = _page(page)[0]
    try:
        return bytes([byte[ch] for ch in s])
    except KeyError:
        return None


@lru_cache(maxsize=None)
def _table(read_as: str, written_in: str) -> dict[int, str]:
    """translate() table that undoes one single-byte swap."""
    byte, _ = _page(read_as)
    chars = _page(written_in)[1]
    return {ord(ch): chars[b] for ch, b in byte.items() if b >= 128 and chars[b] != ch}


_RUN = re.compile(r"[^\x00-\x7F]+")


def _undo_whole(s: str, read_as: str, written_in: str) -> str | None:
    data = _to_bytes(s, read_as)
    if data is None:
        return None
    if written_in in WRITTEN_IN:
        return s.translate(_table(read_as, written_in))
    try:
        return data.decode(written_in)
    except UnicodeDecodeError:
        return None


def undo(s: str, read_as: str, written_in: str) -> str | None:
    """s with each run of characters beyond ASCII as it was before it was written in one encoding and
    read in another; None where no run can be."""
    out = _RUN.sub(lambda m: _undo_whole(m[0], read_as, written_in) or m[0], s)
    return out if out != s and not out.isascii() else None


_LATIN = "A-Za-z\u00c0-\u024f"
_MIXED = re.compile(f"[{_LATIN}][\u0400-\u04ff]|[\u0400-\u04ff][{_LATIN}]|[{_LATIN}][\u0370-\u03ff\u2500-\u25ff\u3040-\u9fff\uac00-\ud7af\uff61-\uff9f][{_LATIN}]")


def plausible(s: str) -> bool:
    """False for forms that no text is written in: with control, unassigned, private or lost
    characters, with Latin next to Cyrillic letters, or with a sign of another script between Latin ones."""
    if not s.isprintable() and any(unicodedata.category(ch) in ("Cc", "Cn", "Co", "Cs") or ch == LOST for ch in s):
        return False
    return not _MIXED.search(s)


def is_blank(token: str) -> bool:
    """True if all characters beyond ASCII are spaces or invisible: no witness of any swap."""
    return all(ch.isascii() or ch.isspace() or unicodedata.category(ch) == "Cf" for ch in token)


@lru_cache(maxsize=None)
def swaps() -> tuple[tuple[str, str], ...]:
    """All single swaps (read as, written in)."""
    out = [(r, "utf-8") for r in READ_AS]
    out += [(r, w) for r in WIDE_READ_AS for w in WIDE]
    out += [(r, w) for r in READ_AS for w in WRITTEN_IN if r != w and (r, w) != ("latin-1", "cp1252") and _page(r)[1] != _page(w)[1]]
    return tuple(out)


@lru_cache(maxsize=100_000)
def _forms_of_run(run: str) -> dict[str, str]:
    """Form of a run of characters beyond ASCII by the swap (or chain of swaps) undone; most runs recur."""
    found: dict[str, str] = {}
    again = []
    for r, w in swaps():
        if w in ASCII_INSIDE:
            continue
        s = _undo_whole(run, r, w)
        if s is not None and s != run and not s.isascii():
            found[f"{w}>{r}"] = s
            if w == "utf-8":
                again.append((s, f"{w}>{r}"))
    while again:  # every step shortens the form
        deeper = []
        for s, how in again:
            for r in READ_AS:
                t = undo(s, r, "utf-8")
                if t is not None and t != run:
                    found[f"utf-8>{r}, {how}"] = t
                    deeper.append((t, f"utf-8>{r}, {how}"))
        again = deeper
    return found


def candidates(token: str) -> list[tuple[str, tuple[str, ...]]]:
    """(restored form, the swaps that lead to it) of every way a token may be read otherwise.

    A swap acts on each run of characters beyond ASCII by itself; runs that cannot come from it stay,
    as only a part of a word may be concerned."""
    found: dict[str, list[str]] = {}
    runs = list(_RUN.finditer(token))
    forms = [_forms_of_run(m[0]) for m in runs]
    hows = forms[0] if len(forms) == 1 else dict.fromkeys(h for f in forms for h in f)
    for how in hows:
        out, at = [], 0
        for m, f in zip(runs, forms):
            out += [token[at : m.start()], f.get(how, m[0])]
            at = m.end()
        found.setdefault("".join(out) + token[at:], []).append(how)
    for r in WIDE_READ_AS:
        for w in ASCII_INSIDE:
            s = _undo_whole(token, r, w)
            if s is not None and not s.isascii():
                found.setdefault(s, []).append(f"{w}>{r}")
    found.pop(token, None)
    return [(s, tuple(h)) for s, h in found.items() if plausible(s)]


def turned(token: str, restored: str, how: str) -> int:
    """Characters of the original that the swap turned into others."""
    a, b = _RUN.findall(token), _RUN.findall(restored)
    if len(a) != len(b):
        return sum(not ch.isascii() for ch in restored)
    single = "utf-8" not in how
    return sum(sum(x != y for x, y in zip(r, s)) if single and len(r) == len(s) else len(s) for r, s in zip(a, b) if r != s)


# --- bigram model -------------------------------------------------------------------------------

_DIGITS = str.maketrans("123456789", "000000000")


@lru_cache(maxsize=1 << 20)
def _place(pair: str) -> int:
    return xxhash.xxh32_intdigest(pair) % PAIRS


def _pairs(token: str) -> tuple[list[int], list[int]]:
    t = "\x02" + token.translate(_DIGITS) + "\x03"
    return [_place(t[i : i + 2]) for i in range(len(t) - 1)], [ord(ch) % CHARS for ch in t[:-1]]


class Bigrams:
    """Probability of a token by its character pairs, smoothed with single characters."""

    def __init__(self, pairs: np.ndarray, chars: np.ndarray):
        self.pairs, self.chars = pairs, chars
        self.total = float(chars.sum()) + 5000

        self.known: dict[str, float] = {}

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        return self.pairs.astype(np.float32), self.chars.astype(np.float32)

    def _pair(self, pair: str) -> float:
        before, after = self.chars[ord(pair[0]) % CHARS], self.chars[ord(pair[1]) % CHARS]
        return math.log((self.pairs[_place(pair)] + 2 * (after + 0.1) / self.total) / (before + 2))

    def log_without(self, token: str, n: float) -> float:
        """Log probability of a token by the counts of other documents: n of its own are taken out."""

        def one(t: str, n: float) -> float:
            t = "\x02" + t.translate(_DIGITS) + "\x03"
            total = 0.0
            for i in range(len(t) - 1):
                x, y = ord(t[i]) % CHARS, ord(t[i + 1]) % CHARS
                pair, before, after = self.pairs[_place(t[i : i + 2])] - n, self.chars[x] - n, self.chars[y] - n
                total += math.log((max(0.0, pair) + 2 * (max(0.0, after) + 0.1) / self.total) / (max(0.0, before) + 2))
            return total

        return max(one(token, n), one(token.lower(), 0.0) - CAPITALS) if _in_capitals(token) else one(token, n)

    def log(self, token: str) -> float:
        """Log probability; a word in capitals may also be judged by its small letters."""
        return max(self._log(token), self._log(token.lower()) - CAPITALS) if _in_capitals(token) else self._log(token)

    def _log(self, token: str) -> float:
        t = "\x02" + token.translate(_DIGITS) + "\x03"
        total, known = 0.0, self.known
        for i in range(len(t) - 1):
            k = t[i : i + 2]
            v = known.get(k)
            if v is None:
                v = known[k] = self._pair(k)
            total += v
        return total


def _in_capitals(token: str) -> bool:
    return token.isupper() and sum("A" <= ch <= "Z" for ch in token) >= 3


def _source_class(source: Column) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(source, F.lit(""))), F.lit(CLASSES)).cast("int")


_ODD = r"[^\x00-\x7F]"


def _odd_words(text: Column | str) -> Column:
    """Distinct words of a text with a character beyond ASCII."""
    return F.filter(F.array_distinct(F.split(text, f"[{BLANKS}]+")), lambda w: w.rlike(_ODD))


def _tokens(said: DataFrame) -> DataFrame:
    """token, n, by: words with a character beyond ASCII, and in how many documents, in all and by class of sources (at most CLASSES)."""
    by = said.groupBy("cls", "token").agg(F.count(F.lit(1)).alias("n"))
    return by.groupBy("token").agg(F.sum("n").alias("n"), F.collect_list(F.struct("cls", "n")).alias("by"))


_WAYS = pa.list_(pa.struct([("s", pa.string()), ("hows", pa.list_(pa.string()))]))
_TOKEN = "token string, n long, by array<struct<cls:int,n:long>>, c array<struct<s:string,hows:array<string>>>"


def _with_candidates(tokens: DataFrame, model: Model) -> DataFrame:
    """Adds c: the forms of each word that are not FAR less likely than the best one."""
    known = tokens.sparkSession.sparkContext.broadcast(model.bigrams.tables())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b2 = Bigrams(*known.value)
        for b in batches:
            c = []
            for t in b.column("token").to_pylist():
                ways = [(s, h, b2.log(s)) for s, h in ([] if is_blank(t) else candidates(t))]
                least = max([b2.log_without(t, 1.0), *(p for _, _, p in ways)]) - FAR if ways else 0.0
                c.append([{"s": s, "hows": h} for s, h, p in ways if p > least])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(c, _WAYS)], [*b.schema.names, "c"])

    return tokens.mapInArrow(run, _TOKEN)


class Model:
    """What expectation-maximization learns: bigrams, and by class of sources how often each swap occurs."""

    def __init__(self, bigrams: Bigrams | None, share: dict[int, dict[str, float]]):
        self.bigrams, self.share = bigrams, share
        self.every: dict[str, float] = {}
        for own in share.values():
            for how, w in own.items():
                self.every[how] = self.every.get(how, 0.0) + w
        self.total = sum(self.every.values())
        self.known: dict[tuple[int, str], float] = {}

    def prior(self, cls: int, how: str) -> float:
        v = self.known.get((cls, how))
        if v is None:
            v = self.known[cls, how] = self._prior(cls, how)
        return v

    def _prior(self, cls: int, how: str) -> float:
        s = self.share.get(cls)
        total = sum(s.values()) if s else 0.0
        base = (self.every.get(how, 0.0) + 0.02) / (self.total + 50)
        if how == KEEP:
            base = 0.95
        own = (s.get(how, 0.0) if s else 0.0) + 200 * base
        return math.log(own / (total + 200))


def learn(tokens: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, Model]:
    """(words with their candidate forms, model): expectation-maximization over the words with
    characters beyond ASCII.

    First all words as they stand are counted. Words that no swap could have made (or only into forms
    far less likely) are certain from then on; only the others take part in the rounds. E-step: the
    posterior of each swap for each word, from the bigrams of its restored form and the swap's share
    in the class of sources. M-step: bigrams of the restored forms and the swaps' shares, weighted by
    the posteriors: what they change against the first count. The tables that come to the driver have
    fixed sizes (2**20 bigram places, 2**16 characters, swaps by CLASSES).
    """
    tokens = cut(tokens.repartition(_tasks(tokens), F.xxhash64("token")))
    start = _counts(tokens.select("*", F.lit(None).cast("array<struct<s:string,hows:array<string>>>").alias("c")), Model(None, {}))
    model = Model(Bigrams(start[0], start[1]), start[2])
    rows = cut(_with_candidates(tokens, model))
    for _ in range(rounds - 1):
        pairs, chars, change = _counts(rows.where(F.size("c") > 0), model)
        share = {cls: {how: start[2].get(cls, {}).get(how, 0.0) + change.get(cls, {}).get(how, 0.0) for how in {*start[2].get(cls, {}), *change.get(cls, {})}} for cls in {*start[2], *change}}
        model = Model(Bigrams(start[0] + pairs, start[1] + chars), share)
    return rows, model


def _tasks(df: DataFrame) -> int:
    """Tasks for work that is heavy on the CPU but light on data."""
    spark = df.sparkSession
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _counts(rows: DataFrame, model: Model, tables: dict[int, dict[int, str]] | None = None) -> tuple[np.ndarray, np.ndarray, dict[int, dict[str, float]]]:
    """(bigram counts, character counts, weight of each swap by class) of the words as they stand where
    c is null, else what their posteriors change in those; with learned tables, what those change:
    a word of their class counts as its restored form where that is likelier by the other texts."""
    shared = rows.sparkSession.sparkContext.broadcast((model.bigrams and model.bigrams.tables(), model.share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, share = shared.value
        m = Model(known and Bigrams(*known), share)
        pairs, chars = np.zeros(PAIRS), np.zeros(CHARS)
        shares: dict[tuple[int, str], float] = {}
        for b in batches:
            for token, by, c in zip(*(b.column(x).to_pylist() for x in ("token", "by", "c"))):
                logs = evidence(m, token, [(x["s"], x["hows"]) for x in c or ()]) if tables is None else []
                weights: dict[str, float] = {}
                for x in by:
                    if tables is not None:
                        form = token.translate(tables.get(x["cls"], {}))
                        if form != token and m.bigrams.log(form) > m.bigrams.log_without(token, x["n"]):
                            weights[token] = weights.get(token, 0.0) - x["n"]
                            weights[form] = weights.get(form, 0.0) + x["n"]
                        continue
                    if c is not None:
                        shares[x["cls"], KEEP] = shares.get((x["cls"], KEEP), 0.0) - x["n"]
                        weights[token] = weights.get(token, 0.0) - x["n"]
                    for s, how, w in posteriors(m, x["cls"], logs):
                        shares[x["cls"], how] = shares.get((x["cls"], how), 0.0) + x["n"] * w
                        weights[s] = weights.get(s, 0.0) + x["n"] * w
                for s, w in weights.items():
                    if abs(w) > 1e-9:
                        for place, char in zip(*_pairs(s)):
                            pairs[place] += w
                            chars[char] += w
        for kind, a in (("p", pairs), ("c", chars)):
            at = np.flatnonzero(a)
            yield pa.RecordBatch.from_pydict({"kind": pa.array([kind] * len(at), pa.string()), "at": pa.array(at, pa.int64()), "how": pa.array([""] * len(at), pa.string()), "w": pa.array(a[at], pa.float64())})
        ks = list(shares)
        yield pa.RecordBatch.from_pydict({"kind": pa.array(["s"] * len(ks), pa.string()), "at": pa.array([k[0] for k in ks], pa.int64()), "how": pa.array([k[1] for k in ks], pa.string()), "w": pa.array([shares[k] for k in ks], pa.float64())})

    sums = rows.mapInArrow(run, "kind string, at long, how string, w double").groupBy("kind", "at", "how").agg(F.sum("w").alias("w"))
    got = sums.toPandas()
    pairs, chars = np.zeros(PAIRS), np.zeros(CHARS)
    for kind, a in (("p", pairs), ("c", chars)):
        part = got[got.kind == kind]
        a[part["at"].to_numpy(np.int64)] = part["w"].to_numpy()
    share: dict[int, dict[str, float]] = {}
    for r in got[got.kind == "s"].itertuples():
        share.setdefault(int(r.at), {})[r.how] = r.w
    shared.unpersist()
    return pairs, chars, share


def evidence(m: Model, token: str, ways: list[tuple[str, list[str]]]) -> list[tuple[str, str, float]]:
    """(form, swap, log probability) of a word and of its restored forms.

    The word as it stands is judged by other documents only, or else every rare garbled word would
    be its own witness.
    """
    if m.bigrams is None or not ways:
        return [(token, KEEP, 0.0)]
    out = [(token, KEEP, m.bigrams.log_without(token, 1.0))]
    least = out[0][2] - FAR
    for s, hows in ways:
        p = m.bigrams.log(s)
        if p > least:
            out += [(s, how, p) for how in hows]
    return out


def posteriors(m: Model, cls: int, logs: list[tuple[str, str, float]]) -> list[tuple[str, str, float]]:
    """(form, swap, posterior) of all that weigh a thousandth or more."""
    if len(logs) == 1:
        return [(logs[0][0], KEEP, 1.0)]
    full = [p + m.prior(cls, how) for _, how, p in logs]
    top = max(full)
    e = [(s, how, math.exp(x - top)) for (s, how, _), x in zip(logs, full) if x > top - 12]
    z = sum(x[2] for x in e)
    return [(s, how, x / z) for s, how, x in e if x > 1e-3 * z]


Way = tuple[tuple[str, ...], str, float]


def ways_of(bigrams: Bigrams, token: str, forms: list[tuple[str, list[str]]]) -> tuple[list[Way], list[Way]]:
    """(whole, part): (swaps, form, gain in nats) of the forms that are likelier than the word itself.

    part: forms in which only one run of characters beyond ASCII is restored."""
    own = bigrams.log(token)
    whole = [(tuple(hows), s, bigrams.log(s) - own) for s, hows in forms]
    runs, part = list(_RUN.finditer(token)), []
    if len(runs) > 1:
        known = {how for _, hows in forms for how in hows}
        for r in runs:
            for s, hows in candidates(r[0]):
                if apt := known.intersection(hows):
                    form = token[: r.start()] + s + token[r.end() :]
                    part.append((tuple(sorted(apt)), form, bigrams.log(form) - own))
    return [w for w in whole if w[2] > 0], [w for w in part if w[2] > 0]


class Restorer:
    """Restores documents by a learned model, the ways of their words and the learned tables of their class."""

    def __init__(self, model: Model, tables: dict[int, dict[int, str]] | None = None):
        self.m, self.tables = model, tables or {}

    def _prior(self, cls: int, how: str) -> float:
        return LEARNED_PRIOR + self.m.prior(cls, KEEP) if how == LEARNED else self.m.prior(cls, how)

    def _learned(self, cls: int, token: str) -> list[Way]:
        form = token.translate(self.tables[cls])
        return [((LEARNED,), form, g)] if form != token and (g := self.m.bigrams.log(form) - self.m.bigrams.log(token)) > 0 else []

    def restore(self, text: str, cls: int, ways: dict[str, tuple[list[Way], list[Way]]]) -> tuple[int, str | None, str]:
        """(characters of the original that were turned into others, main swap or None, text restored).

        The main swap is the one with most evidence over the document; its words need no further
        prior, words of other swaps need the more of it. Lost characters (U+FFFD) count and stay.
        """
        lost = text.count(LOST)
        parts = _split(text)
        keep = self.m.prior(cls, KEEP)
        gain: dict[str, float] = {}
        seen = []
        for i, t in enumerate(parts):
            own = ways.get(t)
            if cls in self.tables and not t.isascii() and (more := self._learned(cls, t)):
                own = ([*own[0], *more], own[1]) if own else (more, [])
            if own:
                seen.append((i, t, own))
                best: dict[str, float] = {}
                for hows, _, g in () if is_blank(t) else own[0]:
                    if g > MARGIN:
                        for how in hows:
                            best[how] = max(best.get(how, 0.0), g - MARGIN)
                for how, g in best.items():
                    gain[how] = gain.get(how, 0.0) + g
        total = {how: g + self._prior(cls, how) - keep for how, g in gain.items()}
        main = max(total, key=lambda h: (total[h], h)) if total else None
        if main is None or total[main] <= 0:
            return lost, None, text
        n = lost
        for i, t, (whole, part) in seen:
            best_g, to = 0.0, None
            for hows, s, g in [*whole, *[((main,), s, g) for hows, s, g in part if main in hows]]:
                for how in hows:
                    e = g if how == main else g + self._prior(cls, how) - keep - OTHER_SWAP
                    if e > best_g:
                        best_g, to = e, (how, s)
            if to:
                parts[i] = to[1]
                n += turned(t, to[1], to[0])
        return n, main, "".join(parts)


# --- unknown pages: free substitution tables ----------------------------------------------------


def surroundings(token: str) -> list[tuple[str, str, str]]:
    """(character before, character beyond ASCII, character after) wherever both neighbours are ASCII letters."""
    inner = lambda ch: ch.isascii() and ch.isalpha()
    return [(token[i - 1], token[i], token[i + 1]) for i in range(1, len(token) - 1) if not token[i].isascii() and inner(token[i - 1]) and inner(token[i + 1])]


def letter_of(bigrams: Bigrams, x: str, places: list[tuple[str, str, float]], letters: list[str]) -> tuple[str, float, float] | None:
    """(letter, share, evidence): what character x of one class of sources stands for, by
    expectation-maximization over its surroundings (before, after, times).

    E-step: the posterior of each letter at each place, from the bigrams on both sides and the
    letter's share; the character itself is judged by the counts of other texts only. M-step: the
    letters' shares. None if it stands for itself."""
    every = [x, *[y for y in letters if y != x]]
    n = np.array([k for _, _, k in places])
    at = lambda pairs: np.array([bigrams.pairs[_place(p)] for p in pairs])
    chars = bigrams.chars
    weight = np.array([chars[ord(y) % CHARS] for y in every], float)
    before = np.array([chars[ord(a) % CHARS] for a, _, _ in places], float)
    left = np.stack([at([a + y for a, _, _ in places]) for y in every], axis=1).astype(float)
    right = np.stack([at([y + b for _, b, _ in places]) for y in every], axis=1).astype(float)
    after = np.array([chars[ord(b) % CHARS] for _, b, _ in places], float)
    own = n.sum()
    left[:, 0], right[:, 0], weight[0] = np.maximum(left[:, 0] - n, 0), np.maximum(right[:, 0] - n, 0), max(weight[0] - own, 0.0)
    log = np.log((left + 2 * (weight[None, :] + 0.1) / bigrams.total) / (before[:, None] + 2)) + np.log((right + 2 * (after[:, None] + 0.1) / bigrams.total) / (weight[None, :] + 2))
    share = np.full(len(every), 0.5 / max(1, len(every) - 1))
    share[0] = 0.5
    for _ in range(LETTER_ROUNDS):
        post = log + np.log(share)[None, :]
        post = np.exp(post - post.max(1, keepdims=True))
        post /= post.sum(1, keepdims=True)
        share = (post * n[:, None]).sum(0) + 1e-6
        share /= share.sum()
    best = int(share.argmax())
    return None if best == 0 else (every[best], float(share[best]), float(((log[:, best] - log[:, 0]) * n).sum()))


def learned_tables(words: DataFrame, model: Model) -> dict[int, dict[int, str]]:
    """By class of sources: translate() table of the swap of pages that no known pages explain.

    Taken from the words that the known swaps leave as they are. What is summed over all words is how
    often a class has a character between two ASCII letters; each character is then solved by itself.
    Only letters that are sure come to the driver, at most one a character and class."""
    shared = words.sparkSession.sparkContext.broadcast((model.bigrams.tables(), model.share))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, share = shared.value
        m = Model(Bigrams(*known), share)
        held: dict[tuple[int, str, str, str], float] = {}
        for b in batches:
            for token, by, c in zip(*(b.column(x).to_pylist() for x in ("token", "by", "c"))):
                around = surroundings(token)
                if not around:
                    continue
                logs = evidence(m, token, [(x["s"], x["hows"]) for x in c])
                for x in by:
                    kept = sum(w for _, how, w in posteriors(m, x["cls"], logs) if how == KEEP)
                    for a, ch, z in around if kept > 0.5 else ():
                        held[x["cls"], ch, a, z] = held.get((x["cls"], ch, a, z), 0.0) + x["n"]
        cols = list(zip(*held)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.string()) for c in cols[1:]], pa.array(list(held.values()), pa.float64())], ["cls", "x", "a", "z", "n"])

    chars = model.bigrams.chars
    letters = [ch for ch in map(chr, range(0xA1, CHARS - 2048)) if chars[ord(ch)] >= 20 and ch.isalpha() and "LATIN" in unicodedata.name(ch, "")]

    def solved(t: pa.Table) -> pa.Table:
        bigrams = Bigrams(*shared.value[0])
        x = t.column("x")[0].as_py()
        spots = list(zip(t.column("a").to_pylist(), t.column("z").to_pylist(), t.column("n").to_pylist()))
        got = letter_of(bigrams, x, spots, letters) if len(spots) >= SURROUNDINGS else None
        sure = got is not None and got[1] >= SURE and got[2] >= EVIDENCE
        return pa.table([pa.array([t.column("cls")[0].as_py()] * sure, pa.int32()), pa.array([x] * sure, pa.string()), pa.array([got[0]] if sure else [], pa.string())], ["cls", "x", "y"])

    sums = words.mapInArrow(places, "cls int, x string, a string, z string, n double").groupBy("cls", "x", "a", "z").agg(F.sum("n").alias("n"))
    tables: dict[int, dict[int, str]] = {}
    for r in sums.groupBy("cls", "x").applyInArrow(solved, "cls int, x string, y string").collect():
        tables.setdefault(r["cls"], {})[ord(r["x"])] = r["y"]
    return {cls: t for cls, t in tables.items() if len(t) >= LETTERS and len(set(t.values())) == len(t)}


def _split(text: str) -> list[str]:
    """Words and the blanks between them, in turn."""
    return re.split(f"([{BLANKS}]+)", text)


_WAY = "array<struct<hows:array<string>,s:string,g:double>>"


def _ways(rows: DataFrame, model: Model) -> DataFrame:
    """token, whole, part: the ways of each word that has any."""
    known = rows.sparkSession.sparkContext.broadcast(model.bigrams.tables())
    kind = pa.list_(pa.struct([("hows", pa.list_(pa.string())), ("s", pa.string()), ("g", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b2 = Bigrams(*known.value)
        for b in batches:
            tokens, whole, part = [], [], []
            for t, c in zip(b.column("token").to_pylist(), b.column("c").to_pylist()):
                # Words odd by blanks only bear no witness, but may be restored by what the others say.
                w, p = ways_of(b2, t, candidates(t) if is_blank(t) else [(x["s"], x["hows"]) for x in c])
                if w or p:
                    tokens.append(t)
                    whole.append([{"hows": h, "s": s, "g": g} for h, s, g in w])
                    part.append([{"hows": h, "s": s, "g": g} for h, s, g in p])
            yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), pa.array(whole, kind), pa.array(part, kind)], ["token", "whole", "part"])

    return rows.select("token", "c").mapInArrow(run, f"token string, whole {_WAY}, part {_WAY}")


def restored(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", least: int = LEAST) -> DataFrame:
    """doc_id, n_turned, swap, restored: documents with at least `least` turned characters.

    Swaps of code pages are treated as substitution ciphers, by source. Between known pages (and UTF-8
    and the Japanese and Chinese encodings, also read wrongly several times) the tables are given,
    and expectation-maximization against character bigrams learns which of them acts where; for what
    they leave unexplained, the table itself is learned, letter by letter, and applied with
    translate() (swap 'learned'). `swap` is null where the
    original is lost (U+FFFD); its text is given as it is. Null and empty texts are never found; a
    null source is a source; repeated rows each count.

    Each distinct word is judged once; documents meet the ways of their words by a join, and only
    those with a word that may be restored, or with lost characters, are looked at.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("k"), F.col(text).alias("text"), _source_class(F.col(source)).alias("cls"))
    odd = rows.where(F.col("text").rlike(_ODD)).withColumn("h", F.xxhash64("text"))
    said = cut(odd.select("h", "cls", F.explode(_odd_words("text")).alias("token")))
    words, model = learn(_tokens(said))
    ways = cut(_ways(words, model))
    bytes_ = ways.agg(F.sum(F.length("token") + F.length(F.to_json("whole")) + F.length(F.to_json("part"))).alias("n")).first()["n"] or 0
    # Texts of one hash share their words' ways; those of words that a text lacks change nothing.
    of = said.select("h", "token").join(F.broadcast(ways) if bytes_ <= SENT_BYTES else ways, "token")
    of = of.groupBy("h").agg(F.collect_set(F.struct("token", "whole", "part")).alias("ways"))
    lost = F.length("text") - F.length(F.replace("text", F.lit(LOST)))
    tables = learned_tables(words, model)
    if tables:
        pairs, chars, _ = _counts(words, model, tables)
        model = Model(Bigrams(model.bigrams.pairs + pairs, model.bigrams.chars + chars), model.share)
    met = odd.join(of, "h", "left")
    hit = F.lit(False)
    if tables:
        marks = spark.createDataFrame([(cls, "[" + "".join(f"\\x{{{c:x}}}" for c in t) + "]") for cls, t in tables.items()], "cls int, marks string")
        met = met.join(F.broadcast(marks), "cls", "left")  # one row a class at most
        hit = F.coalesce(F.regexp_like("text", F.col("marks")), F.lit(False))
    met = met.where(F.col("ways").isNotNull() | (lost >= least) | hit)
    shared = spark.sparkContext.broadcast((model.share, tables, model.bigrams.tables() if tables else None))
    kind = dict(rows.dtypes)["k"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, learned, known = shared.value
        r = Restorer(Model(known and Bigrams(*known), share), learned)
        for b in batches:
            at, n, how, out = [], [], [], []
            for i, (t, cls, own) in enumerate(zip(*(b.column(x).to_pylist() for x in ("text", "cls", "ways")))):
                tuples = lambda ws: [(tuple(w["hows"]), w["s"], w["g"]) for w in ws]
                got = r.restore(t, cls, {w["token"]: (tuples(w["whole"]), tuples(w["part"])) for w in own or []})
                if got[0] >= least:
                    at.append(i)
                    n.append(got[0])
                    how.append(got[1])
                    out.append(got[2])
            keys = b.column("k").take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(n, pa.int32()), pa.array(how, pa.string()), pa.array(out, pa.string())], ["k", "n", "how", "out"])

    found = met.select("k", "text", "cls", "ways").mapInArrow(run, f"k {kind}, n int, how string, out string")
    return found.select(F.col("k").alias(doc_id), F.col("n").alias("n_turned"), F.col("how").alias("swap"), F.col("out").alias("restored"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return restored(table(spark, d, "documents")).select("doc_id")


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    return restored(table(spark, d, "documents"))
