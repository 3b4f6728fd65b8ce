"""Tags, confidences and free attributes of an object."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _list(t: Column) -> Column:
    return F.coalesce(t, F.array().cast("array<string>"))


def category(tags: Column) -> Column:
    """The first tag."""
    return F.get(tags, F.lit(0))


def has_tag(tags: Column, tag) -> Column:
    return F.coalesce(F.array_contains(tags, tag), F.lit(False))


def add_tag(tags: Column, tag) -> Column:
    t = _list(tags)
    return F.when(F.array_contains(t, tag), t).otherwise(F.array_append(t, tag))


def add_tags(tags: Column, more: Column) -> Column:
    return F.array_union(_list(tags), _list(more))


def confidence(confidences: Column, tag) -> Column:
    return F.try_element_at(confidences, tag if isinstance(tag, Column) else F.lit(tag))


def soft_tags(tags: Column, confidences: Column) -> Column:
    """array<struct<tag, conf>> of the distinct tags that have a confidence, best first."""
    pairs = F.transform(F.array_distinct(_list(tags)), lambda t: F.struct(F.try_element_at(confidences, t).alias("conf"), t.alias("tag")))
    return F.reverse(F.array_sort(F.filter(pairs, lambda p: p["conf"].isNotNull())))


def merged(*maps: Column) -> Column:
    """Right-biased union of maps (needs spark.sql.mapKeyDedupPolicy = LAST_WIN)."""
    return F.map_concat(*maps)


def public(attributes: Column) -> Column:
    """Attributes without those whose key starts with '__'."""
    return F.map_filter(attributes, lambda k, v: ~k.startswith("__"))


def set_attribute(attributes: Column, key: str, value) -> Column:
    return F.map_concat(F.map_filter(attributes, lambda k, v: k != key), F.create_map(F.lit(key), F.lit(value)))


def del_attribute(attributes: Column, key: str) -> Column:
    return F.map_filter(attributes, lambda k, v: k != key)


def as_list(x: Column) -> Column:
    return F.array(x)


def singleton(a: Column) -> Column:
    """The element of a list of one, else null."""
    return F.when(F.size(a) == 1, F.get(a, F.lit(0)))
