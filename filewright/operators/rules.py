"""File-name rules: markers, junk, keywords, archive fallback.

Each operator adds one nullable verdict column. Nothing here shuffles: markers
are literal patterns, keyword rules an index (``keyword_index``); both are
constants of the plan.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filewright import constants as C
from filewright.config import Taxonomy
from filewright.functions import paths, tokens
from filewright.functions.literals import array_of, quote
from filewright.functions.verdicts import verdict
from filewright.operators.keyword_index import indexes

# Rules of about fifty bytes in an index that travels with the plan; more rules make more indexes.
RULES_AT_ONCE = 200_000
# Patterns in one expression.
MARKERS_AT_ONCE = 200
REFERS = re.compile(r"\\[1-9]|\\k<|\(\?P?<[A-Za-z]")


def with_names(files: DataFrame, path: str = "path") -> DataFrame:
    """Add ``name``, ``ext`` and ``flat``."""
    named = files.withColumn("name", paths.basename(F.col(path)))
    return named.withColumns({
        "ext": paths.extension(F.col("name")),
        "flat": tokens.flat_name(F.col("name")),
    })


def _any_of(patterns: Sequence[str]) -> str:
    """One pattern found wherever any of the patterns is.

    Those that start at a word share that test, so that the list is tried once
    a word instead of once a character.
    """
    at_word = [p[2:] for p in patterns if p.startswith(r"\b") and not _has_outer_bar(p)]
    others = [p for p in patterns if not p.startswith(r"\b") or _has_outer_bar(p)]
    parts = [rf"\b(?:{'|'.join(at_word)})"] if at_word else []
    return "|".join([*parts, *(f"(?:{p})" for p in others)])


def _has_outer_bar(pattern: str) -> bool:
    """Whether a pattern has an alternation that no group closes in."""
    bare = re.sub(r"\\.|\[(?:\\.|[^\]])*\]", "", pattern)
    while (inner := re.sub(r"\([^()]*\)", "", bare)) != bare:
        bare = inner
    return "|" in bare


def _first_of(markers: Sequence[tuple[str, str, str]]) -> list[str]:
    """Expressions of which each gives the position of the first pattern found among some of the markers.

    Most names hold no marker; one alternation settles those. A pattern that refers back to a group, or names one, means
    something else inside a larger pattern, so those are tried one by one.
    """
    numbered = list(enumerate((pattern for pattern, _, _ in markers), 1))
    alone = [(i, p) for i, p in numbered if REFERS.search(p)]
    joined = [(i, p) for i, p in numbered if not REFERS.search(p)]
    out = [f"CASE WHEN rlike(flat, {quote(p)}) THEN {i} END" for i, p in alone]
    for start in range(0, len(joined), MARKERS_AT_ONCE):
        part = joined[start:start + MARKERS_AT_ONCE]
        cases = " ".join(f"WHEN rlike(flat, {quote(p)}) THEN {i}" for i, p in part)
        out.append(f"CASE WHEN rlike(flat, {quote(_any_of([p for _, p in part]))}) THEN CASE {cases} END END")
    return out


def with_markers(df: DataFrame, taxonomy: Taxonomy, out: str = "marker") -> DataFrame:
    """Verdict of the first marker pattern found in ``flat``."""
    if not taxonomy.markers:
        return df.withColumn(out, F.lit(None).cast("struct<category:string,confidence:int,method:string,reason:string>"))
    first = F.expr(f"least({', '.join([*_first_of(taxonomy.markers), 'CAST(NULL AS INT)'])}, CAST(NULL AS INT))")
    categories = array_of(c for _, c, _ in taxonomy.markers)
    reasons = array_of(r for _, _, r in taxonomy.markers)
    position = F.col("_position")
    return (
        df.withColumn("_position", first)
        .withColumn(out, F.when(position.isNotNull(), verdict(
            F.element_at(categories, position), C.CONFIDENCE_MARKER, C.METHOD_MARKER,
            F.element_at(reasons, position))))
        .drop("_position")
    )


def junk(taxonomy: Taxonomy) -> Column:
    """Verdict for hidden files and junk extensions."""
    hit = F.col("ext").isin(taxonomy.extensions(C.JUNK)) | F.startswith(F.col("name"), F.lit("."))
    return F.when(hit, verdict(C.JUNK, C.CONFIDENCE_JUNK, C.METHOD_RULES, C.REASON_JUNK))


def archive(taxonomy: Taxonomy) -> Column:
    """Verdict by extension alone, for archives and installers."""
    reason = F.concat(F.lit("Archive/installer fallback by extension '"), F.col("ext"), F.lit("'"))
    return F.when(F.col("ext").isin(taxonomy.extensions(C.ARCHIVES)),
                  verdict(C.ARCHIVES, C.CONFIDENCE_ARCHIVE, C.METHOD_RULES, reason))


def with_keyword(
    df: DataFrame, taxonomy: Taxonomy, out: str = "keyword", where: Column | None = None, at_once: int = RULES_AT_ONCE,
) -> DataFrame:
    """Verdict of the first keyword rule that fits extension and name.

    Rows for which ``where`` does not hold are not looked at.
    """
    hits = [index.first_hit(F.col("flat"), F.col("ext")) for index in indexes(taxonomy, at_once)]
    hit = F.coalesce(*hits) if hits else F.lit(None).cast("struct<category:string,keyword:string>")
    # Out of an array, so that no filter on the verdict is pushed below the look-up and repeats it.
    found = df.select("*", F.explode(F.array(hit if where is None else F.when(where, hit))).alias("_hit"))
    reason = F.concat(F.lit("Matched '"), F.col("_hit.keyword"), F.lit("' in filename"))
    return found.withColumn(out, F.when(F.col("_hit").isNotNull(), verdict(
        F.col("_hit.category"), C.CONFIDENCE_KEYWORD, C.METHOD_RULES, reason))).drop("_hit")


def with_rules(
    df: DataFrame, taxonomy: Taxonomy, out: str = "rules", settled: Column | None = None,
) -> DataFrame:
    """Junk, then keyword, then archive fallback; NULL where none applies.

    Keywords are not looked up for rows an earlier stage has ``settled``.
    """
    where = None if settled is None else settled.isNull()
    return with_keyword(df, taxonomy, "_keyword", where).withColumn(
        out, F.coalesce(junk(taxonomy), F.col("_keyword"), archive(taxonomy))).drop("_keyword")
