"""Texts, paths, addresses and times as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Endings by kind of file (fixed values).
IMAGE = ["jpg", "jpeg", "png", "tif", "tiff", "pgm", "ppm", "gif", "bmp", "webp"]
VIDEO = ["avi", "mp4", "mov", "wmv", "mpg", "mkv", "webm"]
ARCHIVE = ["zip", "gz", "tgz", "tar", "bz2", "tar.gz", "tar.bz2"]


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def has_ending(path: Column | str, *endings: str) -> Column:
    return F.coalesce(F.lower(_c(path)).rlike(r"\.(" + "|".join(e.replace(".", r"\.") for e in endings) + r")\z"), F.lit(False))


def is_url(path: Column | str) -> Column:
    return F.coalesce(F.lower(_c(path)).rlike(r"^(https?|ftp|s3|scp|rtsp|rtmp)://[^/\s]+"), F.lit(False))


def is_image_url(path: Column | str) -> Column:
    return is_url(path) & has_ending(path, *IMAGE)


def is_video_url(path: Column | str) -> Column:
    return is_url(path) & (has_ending(path, *VIDEO) | F.lower(_c(path)).rlike(r"^https?://(www\.)?(youtube\.com|youtu\.be)/"))


def has_scheme(path: Column | str, scheme: str) -> Column:
    return F.coalesce(F.lower(_c(path)).startswith(scheme + "://"), F.lit(False))


def is_youtube_url(path: Column | str) -> Column:
    return F.coalesce(F.lower(_c(path)).rlike(r"^https?://(www\.)?(youtube\.com|youtu\.be)/"), F.lit(False))


def is_email(text: Column | str) -> Column:
    return F.coalesce(_c(text).rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\z"), F.lit(False))


def is_image(path: Column | str) -> Column:
    return has_ending(path, *IMAGE)


def is_video(path: Column | str) -> Column:
    return has_ending(path, *VIDEO)


def is_archive(path: Column | str) -> Column:
    return has_ending(path, *ARCHIVE)


def is_hidden(path: Column | str) -> Column:
    return F.coalesce(file_tail(path).startswith("."), F.lit(False))


def file_tail(path: Column | str) -> Column:
    """Last part of a path; '/' and '\\' both separate."""
    return F.regexp_extract(_c(path), r"([^/\\]*)$", 1)


def file_path(path: Column | str) -> Column:
    """Folder of a path, without the last separator."""
    return F.regexp_replace(_c(path), r"[/\\]?[^/\\]*$", "")


def file_ext(path: Column | str, multidot: bool = True) -> Column:
    """Ending with its dot; with multidot all of '.tar.gz'. '' if there is none."""
    return F.regexp_extract(file_tail(path), r"^[^.]+((?:\.[^.]+)+)$" if multidot else r"^.+(\.[^.]+)$", 1)


def file_base(path: Column | str, multidot: bool = True) -> Column:
    """Last part without its ending."""
    return F.regexp_replace(file_tail(path), r"^([^.]+)(?:\.[^.]+)+$" if multidot else r"^(.+)\.[^.]+$", "$1")


def no_extension(path: Column | str) -> Column:
    return F.regexp_replace(_c(path), r"(?<=[^/\\.])(?:\.[^./\\]+)+$", "")


def to_extension(path: Column | str, ext: str) -> Column:
    return F.concat(no_extension(path), F.lit(ext if ext.startswith(".") else "." + ext))


def _join(folder: Column, tail: Column) -> Column:
    return F.when(folder == "", tail).otherwise(F.concat(folder, F.lit("/"), tail))


def new_base(path: Column | str, base: Column | str) -> Column:
    return _join(file_path(path), F.concat(F.lit(base) if isinstance(base, str) else base, file_ext(path)))


def new_path(path: Column | str, folder: str) -> Column:
    return _join(F.lit(folder.rstrip("/")), file_tail(path))


def new_prefix(path: Column | str, prefix: str) -> Column:
    return _join(file_path(path), F.concat(F.lit(prefix), file_tail(path)))


def repath(path: Column | str, old: str, new: str) -> Column:
    c = _c(path)
    return F.when(c.startswith(old), F.concat(F.lit(new), F.substring(c, F.lit(len(old) + 1), F.length(c)))).otherwise(c)


def to_filename(text: Column | str) -> Column:
    """Text with '_' for whatever a file name should not hold."""
    return F.regexp_replace(F.trim(_c(text)), r"[^A-Za-z0-9._-]+", "_")


def parent(path: Column | str) -> Column:
    return file_tail(file_path(path))


def string_hash(text: Column | str, n: int = 16) -> Column:
    return F.substring(F.sha2(_c(text), 256), 1, n)


def short_id(*cols: Column | str, n: int = 8) -> Column:
    """Deterministic short id of values."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *[_c(c).cast("string") for c in cols]), 256), 1, n)


def truncated(text: Column | str, n: int) -> Column:
    c = _c(text)
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("..."))).otherwise(c)


#: Characters that inner HTML needs escaped, in order (fixed values).
ESCAPES = [("\n", "<br>"), ("{", "&#123;"), ("}", "&#125;"), ('"', "&quot;"), ("'", "&#39;")]


def escaped(text: Column | str) -> Column:
    c = _c(text)
    for a, b in ESCAPES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def is_number(text: Column | str) -> Column:
    return _c(text).try_cast("double").isNotNull()


def is_json(text: Column | str) -> Column:
    return F.try_parse_json(_c(text)).isNotNull()


def clock(seconds: Column | str) -> Column:
    """MM:SS with unbounded minutes."""
    s = F.floor(_c(seconds)).cast("bigint")
    return F.concat(F.lpad(F.floor(s / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad(F.pmod(s, F.lit(60)).cast("string"), 2, "0"))


def stamp(ts: Column | str, form: str = "yyyyMMdd'T'HHmmss") -> Column:
    return F.date_format(_c(ts), form)


def mojoin(parts: Column, sep: str = ";") -> Column:
    return F.array_join(parts, sep)
