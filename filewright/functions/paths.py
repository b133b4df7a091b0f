"""Path columns: base name, extension, stem, relative head."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*\z", "")


def _last_part(name: Column) -> Column:
    """The last dot and what follows, if anything but dots stands before it."""
    last = F.substring_index(name, ".", -1)
    before = F.left(name, F.length(name) - F.length(last) - 1)
    starts = F.contains(name, F.lit(".")) & (F.ltrim(before, F.lit(".")) != "")
    return F.when(starts, F.concat(F.lit("."), last)).otherwise("")


def extension(name: Column) -> Column:
    """Lower-case extension with its dot; leading dots never start one."""
    return F.lower(_last_part(name))


def root_and_extension(name: Column) -> tuple[Column, Column]:
    """Split where ``extension`` does, case kept: ``a.tar.gz`` -> ``a.tar``, ``.gz``."""
    ext = _last_part(name)
    return F.left(name, F.length(name) - F.length(ext)), ext


def suffix(name: Column) -> Column:
    """Part from the last dot on, if something stands on both sides of that dot."""
    return F.regexp_extract(name, r"(?s)^.+(\.[^.]+)\z", 1)


def stem_and_suffix(name: Column) -> tuple[Column, Column]:
    ext = suffix(name)
    return F.left(name, F.length(name) - F.length(ext)), ext


def relative(path: Column, root: str) -> Column:
    """Path below ``root``; NULL for a path that is not below it."""
    prefix = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(prefix)), F.substring(path, len(prefix) + 1, 1 << 30))


def head(rel: Column) -> Column:
    return F.substring_index(rel, "/", 1)


def join(*parts: Column) -> Column:
    return F.concat_ws("/", *parts)
