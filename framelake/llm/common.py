"""Keys shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def instance_key(instanceid: Column | str) -> Column:
    """struct(source, number) that an instanceid names, or null.

    'Source:00000792', 'source/00000792', 'SOURCE#792', ' source:train:792 ' name the same picture:
    source in lower case, number without leading zeros; a split name between them does not count.
    """
    c = F.lower(F.col(instanceid) if isinstance(instanceid, str) else instanceid)
    form = r"^\s*([a-z][a-z0-9_.-]*?)\s*[:/#|]\s*(?:[a-z]+\s*[:/#|]\s*)?([0-9]{1,18})\s*$"
    source, number = F.regexp_extract(c, form, 1), F.regexp_extract(c, form, 2)
    return F.when(number != "", F.struct(source.alias("source"), number.cast("long").alias("number")))


def identity_number(text: Column | str) -> Column:
    """Number that a text names as an identity ('n00012345', '"N12345"', 'wn:n-12345/'), or null."""
    c = F.lower(F.trim(F.col(text) if isinstance(text, str) else text))
    digits = F.regexp_extract(c, r'^[^0-9a-z]*(?:[a-z]+[:_ -])?n?[-_ ]?([0-9]{1,12})[^0-9a-z]*$', 1)
    return F.when(digits != "", digits.cast("long"))
