"""Running totals, ranks and look-backs within groups of any size.

A window over a group runs in one task. Here rows are dealt out by ranges of group and order, so that a large group lies
in several neighbouring parts; each part is worked on alone, and every row adds what its group's other parts come to.
That works for whatever can be put together from parts: sums, the last value before a row, the first value after it.

The input is computed once, into a written table. The parts are ranges between bounds, which are quantiles of a sample: the rows
with the smallest hashes, merged from all tasks. A row's part follows from its own values and the bounds, so both the window and the
sums of parts can be computed from the table, in any order and again after a loss. A table that fits one part has no bounds.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filewright.session import cut_lineage

ROWS_PER_PART = 1 << 17
MOST_PARTS = 4096
SAMPLE_PER_PART = 16


@dataclass(frozen=True)
class Scan:
    """What a row gets from the rows of its group: see ``total``, ``before`` and ``after``."""

    kind: str
    value: Column


def total(value: Column) -> Scan:
    """Sum up to and including the row."""
    return Scan("total", value)


def before(value: Column) -> Scan:
    """The last value that is not NULL among earlier rows."""
    return Scan("before", value)


def after(value: Column) -> Scan:
    """The first value that is not NULL among later rows."""
    return Scan("after", value)


START, END = Window.unboundedPreceding, Window.unboundedFollowing


def _bounds(stored: DataFrame, columns: Sequence[str], rows_per_part: int) -> list[dict]:
    """Ascending values of ``columns`` that cut the rows into parts of about equal size; none for a table of one part."""
    parts = min(stored.count() // rows_per_part, MOST_PARTS)
    if parts < 2:
        return []
    key = F.struct(*columns)
    sample = stored.select(key.alias("k"), F.xxhash64(*columns).alias("h")).orderBy("h").limit(parts * SAMPLE_PER_PART)
    found = [json.loads(r.k) for r in sample.orderBy("k").select(F.to_json("k").alias("k")).collect()]
    return found[SAMPLE_PER_PART // 2::SAMPLE_PER_PART]


def _part(stored: DataFrame, columns: Sequence[str], bounds: list[dict]) -> Column:
    """Number of bounds up to a row's values, counted in two steps."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    fields = ", ".join(f"`{c}`: {stored.schema[c].dataType.simpleString()}" for c in columns)
    element = f"struct<{fields}>"
    here = F.struct(*columns)

    def passed(values: Column) -> Column:
        return F.size(F.filter(values, lambda b: b <= here))

    coarse = F.from_json(F.lit(json.dumps(bounds[step - 1::step])), f"array<{element}>")
    fine = F.from_json(F.lit(json.dumps([bounds[i:i + step - 1] for i in range(0, len(bounds) + 1, step)])), f"array<array<{element}>>")
    c = passed(coarse)
    return c * step + F.coalesce(passed(F.get(fine, c)), F.lit(0))


def scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Scan], rows_per_part: int | None = None) -> DataFrame:
    """Add a column for each entry of ``values``.

    ``order`` must be total within a group, group keys must not be NULL.
    """
    keys, order = list(keys), list(order)
    held = {f"_scan{i}": out for i, out in enumerate(values)}
    stored = cut_lineage(df.withColumns({v: values[out].value for v, out in held.items()}))
    bounds = _bounds(stored, [*keys, *order], rows_per_part or ROWS_PER_PART)
    if not bounds:
        here = Window.partitionBy(*keys).orderBy(*order)
        return stored.withColumns({out: _local(values[out].kind, v, here) for v, out in held.items()}).drop(*held)
    dealt = stored.withColumn("_part", _part(stored, [*keys, *order], bounds))
    here = Window.partitionBy("_part", *keys).orderBy(*order)
    local = dealt.withColumns({out: _local(values[out].kind, v, here) for v, out in held.items()})
    # What a part of a group comes to, and from that what the group's parts on one side come to.
    at = F.struct(*order)
    whole = {"total": lambda v: F.sum(v), "before": lambda v: F.max_by(v, F.when(F.col(v).isNotNull(), at)),
             "after": lambda v: F.min_by(v, F.when(F.col(v).isNotNull(), at))}
    sums = dealt.groupBy("_part", *keys).agg(*[whole[values[out].kind](v).alias(v) for v, out in held.items()])
    parts = Window.partitionBy(*keys).orderBy("_part")
    several = F.count("*").over(Window.partitionBy(*keys))
    earlier, later = parts.rowsBetween(START, -1), parts.rowsBetween(1, END)
    side = {"total": lambda v: F.sum(v).over(earlier), "before": lambda v: F.last(v, ignorenulls=True).over(earlier),
            "after": lambda v: F.first(v, ignorenulls=True).over(later)}
    offsets = sums.select("_part", *keys, several.alias("_parts"), *[side[values[out].kind](v).alias(f"_off{v}") for v, out in held.items()])
    joined = local.join(offsets.where("_parts > 1").drop("_parts"), ["_part", *keys], "left")
    put = {out: F.col(out) + F.coalesce(f"_off{v}", F.lit(0)) if values[out].kind == "total" else F.coalesce(out, f"_off{v}") for v, out in held.items()}
    return joined.withColumns(put).drop(*held, *[f"_off{v}" for v in held], "_part")


def _local(kind: str, value: str, here) -> Column:
    if kind == "total":
        return F.sum(value).over(here.rowsBetween(START, 0))
    if kind == "before":
        return F.last(value, ignorenulls=True).over(here.rowsBetween(START, -1))
    return F.first(value, ignorenulls=True).over(here.rowsBetween(1, END))


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """Add a column per entry of ``values``: its sum within ``keys`` up to and including the row."""
    return scan(df, keys, order, {out: total(v) for out, v in values.items()})


def rank_in_group(df: DataFrame, keys: Sequence[str], order: str, out: str) -> DataFrame:
    """Add ``out``: zero-based position by a unique whole-number column."""
    ranked = running_total(df, keys, [order], {out: F.lit(1)})
    return ranked.withColumn(out, (F.col(out) - 1).cast("bigint"))
