"""Problem 7: same or near-same records across splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions.names import load_names, split_of
from framelake.llm.common import instance_key
from framelake.operators.live import latest
from framelake.session import cut
from framelake.sources.tables import table

#: Endings of image files, and what copying or resizing adds to a name (fixed values).
ENDING = r"\.(jpe?g|png|webp|gif|bmp|tiff?|heic|avif|jfif)$"
MARK = (
    r"(?:[ _.\-]*\(\d{1,3}\)|[ _.\-]*@\d+x|[ _.\-]+\d{2,5}x\d{2,5}|[ _.\-]+copy(?:[ _.\-]?\d{1,3}|[ _.\-]of)?"
    r"|[ _.\-]+(?:thumb|thumbnail|scaled|resized|small|medium|large|preview|orig|original|edited|final|duplicate|dup|backup|bak|cropped|lowres|highres|hd))$"
)
MARK_BEFORE = r"^(?:(?:copy|kopie|copie)(?:[ _.\-]*\(\d+\))?[ _.\-]+of[ _.\-]+|(?:thumb|thumbnail|resized|small)[_.\-]+)"
#: Letters of a name that may be wrong, missing or extra.
LETTERS = 2
#: Pieces a held-out name is cut into: edits of LETTERS letters leave one of them whole.
PIECES = LETTERS + 1


def core_name(filename: Column | str) -> Column:
    """File name without folder, ending, %-escapes and copy marks, in lower case; null stays null."""
    c = F.col(filename) if isinstance(filename, str) else filename
    c = F.regexp_replace(c, r"^.*[/\\]", "")
    c = F.when(F.contains(c, F.lit("%")), F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit(" "))), c)).otherwise(c)
    c = F.trim(F.lower(c))
    c = F.regexp_replace(F.regexp_replace(c, ENDING, ""), ENDING, "")
    for _ in range(3):
        c = F.regexp_replace(F.regexp_replace(c, MARK, ""), MARK_BEFORE, "")
    return c


def name_form(name: Column | str) -> tuple[Column, Column, Column]:
    """(flat: the name without separators, letters: flat with every digit three times, digits)."""
    c = F.col(name) if isinstance(name, str) else name
    flat = F.regexp_replace(c, r"[^\p{L}\p{N}]+", "")
    return flat, F.regexp_replace(flat, "([0-9])", "$1$1$1"), F.regexp_replace(flat, "[^0-9]+", "")


def _grams(names: DataFrame, places: list[tuple[int, int, int]]) -> DataFrame:
    """names with `h`, one row a gram. places: (letters the name is longer than the one that is cut, piece, shift).

    A name of n letters is cut into PIECES at even places; h is a hash of n, the piece's number, its
    letters, and the category and digits, in which names must agree."""
    at = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.lit(i).alias("i"), F.lit(s).alias("s")) for d, i, s in places])).alias("at")
    rows = names.select("category", "flat", F.xxhash64("category", "digits").alias("seed"), F.length("flat").alias("m"), at)
    rows = rows.select("category", "flat", "seed", "m", (F.col("m") - F.col("at.d")).alias("n"), F.col("at.i").alias("i"), F.col("at.s").alias("s"))
    begin, end = F.floor(F.col("n") * F.col("i") / PIECES).cast("int"), F.floor(F.col("n") * (F.col("i") + 1) / PIECES).cast("int")
    rows = rows.where("n >= 0").select("category", "flat", "seed", "m", "n", "i", (begin + F.col("s")).alias("from"), (end - begin).alias("size"))
    rows = rows.where((F.col("from") >= 0) & (F.col("from") + F.col("size") <= F.col("m")))
    return rows.select("category", "flat", F.xxhash64("seed", "n", "i", F.substring(F.col("flat"), F.col("from") + 1, F.col("size"))).alias("h"))


def held_grams(names: DataFrame) -> DataFrame:
    """The PIECES grams of every held-out name."""
    return _grams(names, [(0, i, 0) for i in range(PIECES)])


def train_grams(names: DataFrame) -> DataFrame:
    """Every gram a held-out name at most LETTERS letters away could share with a training name.

    For each length such a name may have and each of its pieces: the substrings at the places where
    the piece can stand if the edits before it and after it together are at most LETTERS.
    """
    places = []
    for d in range(-LETTERS, LETTERS + 1):
        for i in range(PIECES):
            places += [(d, i, s) for s in range(max(-i, d - (LETTERS - i)), min(i, d + (LETTERS - i)) + 1)]
    return _grams(names, places)


def near_names(train: DataFrame, held: DataFrame) -> DataFrame:
    """(category, train_name, held_name, containment) of names that agree up to LETTERS letters.

    Both sides hold distinct (category, flat) with their digits. The grams of the held-out names
    are partitioned by hash, the training names are scanned for hits, and containment is the share of
    a held-out name's grams that the training name holds; below 1 / PIECES no pair can be near. What
    is left is compared exactly: equal digits in order and at most LETTERS letters wrong, missing or
    extra (digits count threefold, so that an edit of one never passes).
    """
    t = train_grams(train).withColumnRenamed("flat", "train_name")
    e = held_grams(held).select(F.col("category").alias("hc"), F.col("flat").alias("held_name"), "h")
    met = t.join(e, "h").where("category = hc").groupBy("category", "train_name", "held_name").agg(F.count_distinct("h").alias("k"))
    (_, tl, td), (_, hl, hd) = name_form("train_name"), name_form("held_name")
    # Not as an equality, which the optimizer would take for a join key and compute for every gram.
    close = (F.levenshtein(td, hd, 0) >= 0) & (F.levenshtein(tl, hl, LETTERS) >= 0)
    return met.where(close).select("category", "train_name", "held_name", (F.col("k") / PIECES).alias("containment"))


def cross_split_pairs(rows: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """train_id, held_id, containment (and the held-out record's split and columns of `carry`) of
    records that show the same picture in training and held-out splits.

    rows: id, split (train, val, test or null), source, number (entity key or null), category (code or
    null), name (core name or null). Same entity key gives containment 1. Records with a null split
    belong to no side; a record without key and without category or name has no partner. Copies are
    compared once, as one (category, flat name); they meet their records at the very end, each pair
    once: a pair of equal keys is left to the keys.
    """
    carry = carry or []
    flat, _, digits = name_form("name")
    rows = cut(rows.where("split is not null").select("id", "split", "source", "number", "category", flat.alias("flat"), digits.alias("digits"), *[F.col(c).alias(f"carry_{c}") for c in carry]))
    extra = ["split", *[f"carry_{c}" for c in carry]]
    t, e = rows.where("split = 'train'"), rows.where("split <> 'train'")
    keyed = lambda df, x, *more: df.where("source is not null and number is not null").select(F.col("id").alias(x), "source", "number", *more)
    same = keyed(t, "train_id").join(keyed(e, "held_id", *extra), ["source", "number"]).select("train_id", "held_id", F.lit(1.0).alias("containment"), *extra)
    named = lambda df: df.where("category is not null and flat is not null and flat <> ''")
    forms = lambda df: named(df).select("category", "flat", "digits").distinct()
    near = near_names(forms(t), forms(e))
    key = F.when(F.col("source").isNotNull() & F.col("number").isNotNull(), F.struct("source", "number"))
    members = lambda df, x, n, *more: named(df).select(F.col("id").alias(x), "category", F.col("flat").alias(n), key.alias(f"key_{x}"), *more)
    alike = near.join(members(t, "train_id", "train_name"), ["category", "train_name"]).join(members(e, "held_id", "held_name", *extra), ["category", "held_name"])
    alike = alike.where(~F.coalesce(F.col("key_train_id") == F.col("key_held_id"), F.lit(False)))
    both = same.unionByName(alike.select("train_id", "held_id", "containment", *extra))
    return both.select("train_id", "held_id", "containment", "split", *[F.col(f"carry_{c}").alias(c) for c in carry])


def image_records(spark: SparkSession, d: str) -> DataFrame:
    names = load_names(table(spark, d, "category_ref"))
    cols = {
        "split": split_of("split_name"),
        "key": instance_key("instanceid"),
        "category": names.code("category"),
        "name": core_name("filename"),
        "source_name": F.col("source_name"),
    }
    live = latest(table(spark, d, "image"), "image_id", "ingested_at", cols)
    return live.select(F.col("image_id").alias("id"), "split", F.col("key.source").alias("source"), F.col("key.number").alias("number"), "category", "name", "source_name")


def p7_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = cross_split_pairs(image_records(spark, d))
    return pairs.select(F.col("held_id").alias("held_image_id"), F.col("train_id").alias("train_image_id"), F.round("containment", 6).alias("containment"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = cross_split_pairs(image_records(spark, d))
    return pairs.select(F.least("train_id", "held_id").alias("image_id_a"), F.greatest("train_id", "held_id").alias("image_id_b"))


def p7_counts(spark: SparkSession, d: str) -> DataFrame:
    """Per held-out split and source_name: pairs, and held-out and training images in them."""
    pairs = cross_split_pairs(image_records(spark, d), ["source_name"])
    return pairs.groupBy("split", "source_name").agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("held_id").alias("held_images"), F.count_distinct("train_id").alias("train_images"))
