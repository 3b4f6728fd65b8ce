"""Normal names: one spelling for every way a category or tag is written.

The reference table of names is a small dimension. It is read to the driver only behind a
check of its row count (`load_names`); tables of any size are joined by `resolve_column`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that separate or surround words in a name and carry no meaning (fixed values).
SEPARATORS = " \t\n\r\f\v\u0085             ​    　﻿_-‐‑‒–—./\\+"

#: Rows of a name table that may be held in a literal map.
MAX_NAMES = 20_000


def squeeze(name: Column | str) -> Column:
    """Lower case without blanks and word separators; null stays null."""
    c = F.col(name) if isinstance(name, str) else name
    return F.translate(F.lower(c), SEPARATORS, "")


def squeeze_text(name: str) -> str:
    return name.lower().translate({ord(ch): None for ch in SEPARATORS})


@dataclass(frozen=True)
class Names:
    """Lookup from squeezed spelling to a code (position in `names`, which is sorted)."""

    names: list[str]
    code_of: dict[str, int]
    columns: dict[str, list]

    def code(self, name: Column | str) -> Column:
        """Code of the normal name or null. One hash lookup in a literal map a row."""
        return F.try_element_at(self._map(), squeeze(name))

    def codes(self, tags: Column | str) -> Column:
        """Sorted distinct codes of a list of names; null or empty lists give an empty list."""
        t = F.col(tags) if isinstance(tags, str) else tags
        found = F.filter(F.transform(F.coalesce(t, F.array().cast("array<string>")), self.code), lambda c: c.isNotNull())
        return F.array_sort(F.array_distinct(found))

    def name(self, code: Column | str) -> Column:
        c = F.col(code) if isinstance(code, str) else code
        return F.get(F.array(*[F.lit(n) for n in self.names]), c)

    def _map(self) -> Column:
        return F.create_map(*[F.lit(x) for kv in sorted(self.code_of.items()) for x in (kv[0], kv[1])])


def spellings(ref: DataFrame, name: str = "category", synonyms: str = "synonyms") -> DataFrame:
    """spelling (squeezed, unique), name: a spelling of a name goes before one of a synonym."""
    own = ref.where(F.col(name).isNotNull()).select(squeeze(name).alias("spelling"), F.col(name).alias("name"), F.lit(0).alias("by"))
    more = ref.where(F.col(name).isNotNull()).select(F.explode(synonyms).alias("s"), F.col(name).alias("name"))
    both = own.unionByName(more.select(squeeze("s").alias("spelling"), "name", F.lit(1).alias("by"))).where("spelling <> ''")
    # Of several names with one spelling the last in order counts, as in load_names.
    return both.groupBy("spelling").agg(F.max_by("name", F.struct(-F.col("by"), F.col("name"))).alias("name"))


def resolve_column(df: DataFrame, column: str, ref: DataFrame, out: str, name: str = "category", synonyms: str = "synonyms") -> DataFrame:
    """df with `out`, the normal name of `column` or null, by a join: for reference tables of any size."""
    s = spellings(ref, name, synonyms).select(F.col("spelling").alias("_spelling"), F.col("name").alias(out))
    return df.withColumn("_spelling", squeeze(column)).join(s, "_spelling", "left").drop("_spelling")


def load_names(ref: DataFrame, name: str = "category", synonyms: str = "synonyms") -> Names:
    """Names of the reference table `ref`; a spelling of a name goes before one of a synonym."""
    extra = [c for c in ref.columns if c not in (name, synonyms)]
    rows = ref.select(name, synonyms, *extra).limit(MAX_NAMES + 1).collect()
    if len(rows) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} names: join them by resolve_column instead of loading them")
    rows = sorted((r for r in rows if r[name] is not None), key=lambda r: r[name])
    names = list(dict.fromkeys(r[name] for r in rows))
    place = {n: i for i, n in enumerate(names)}
    code_of: dict[str, int] = {}
    for r in rows:
        for s in r[synonyms] or []:
            if s is not None:
                code_of[squeeze_text(s)] = place[r[name]]
    for n in names:
        code_of[squeeze_text(n)] = place[n]
    code_of.pop("", None)
    first = {}
    for r in rows:
        first.setdefault(r[name], r)
    columns = {c: [first[n][c] for n in names] for c in extra}
    return Names(names, code_of, columns)


SPLITS = {
    "train": "train", "trn": "train", "training": "train",
    "val": "val", "valid": "val", "validation": "val", "dev": "val",
    "test": "test", "tst": "test", "testing": "test",
}


def split_of(name: Column | str) -> Column:
    """train, val or test, however written; other texts give null."""
    pairs = [F.lit(x) for kv in SPLITS.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), squeeze(name))
