"""Snippets and redaction.

Character classes are spelled out so that the JVM treats white space, digits
and letters of every script the same way on each Spark version.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from filewright import constants as C
from filewright.functions.binding import let

# Unicode white space, as characters and as a regular-expression class body.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
    "\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

# What is redacted, in this order. Order decides the result, since
# a later entry sees the placeholders of the earlier ones.
ENTITIES = ["EMAIL", "PHONE", "URL", "JWT_TOKEN", "AWS_KEY"]
PATTERNS = {
    # The look-behind only skips starts inside a run already tried; it keeps
    # long runs without an @ linear.
    "EMAIL": r"(?:(?<![a-zA-Z0-9_.+-])|\G)[a-zA-Z0-9_.+-]++@[a-zA-Z0-9-]+\.[a-zA-Z0-9.-]+",
    "PHONE": (
        r"\+?\p{Nd}{1,4}?[-.S]?\(?\p{Nd}{1,3}?\)?[-.S]?\p{Nd}{1,4}[-.S]?\p{Nd}{1,4}[-.S]?\p{Nd}{1,9}"
    ).replace("S", SPACE),
    "URL": r"https?://(?:[-\p{L}\p{N}_.]|(?:%[\p{Nd}a-fA-F]{2}))+",
    "JWT_TOKEN": r"eyJ[a-zA-Z0-9_-]*\.[a-zA-Z0-9_-]*\.[a-zA-Z0-9_-]*",
    "AWS_KEY": r"[Aa][Kk\x{212a}][Ii\x{130}\x{131}][Aa][0-9A-Za-z\x{130}\x{131}\x{17f}\x{212a}]{16}",
}
# Most specific first: no key, token or address is broken up by the phone pattern.
SPECIFIC_FIRST = ["JWT_TOKEN", "AWS_KEY", "URL", "EMAIL", "PHONE"]


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text) == "", F.lit(True))


# Text that must be there for a pattern to match; looked up before the pattern runs.
NEEDED = {"EMAIL": "@", "URL": "://", "JWT_TOKEN": "eyJ"}


def _order(order: str) -> list[str]:
    if order == "default":
        return ENTITIES
    if order == "specific_first":
        return SPECIFIC_FIRST
    raise ValueError(f"unknown redaction order: {order!r}")


def _replace(text: Column, entity: str) -> Column:
    def replaced(t: Column) -> Column:
        return F.regexp_replace(t, PATTERNS[entity], f"[{entity}_REDACTED]")

    if entity not in NEEDED:
        return replaced(text)
    return let(text, lambda t: F.when(F.contains(t, F.lit(NEEDED[entity])), replaced(t)).otherwise(t))


def redact(text: Column, order: str = "default") -> Column:
    """Replace personal data by ``[<ENTITY>_REDACTED]``; NULL becomes ''."""
    out = F.coalesce(text, F.lit(""))
    for entity in _order(order):
        out = _replace(out, entity)
    return out


def _placeholders(text: Column, entity: str) -> Column:
    """How often an entity's placeholder stands in a text."""
    mark = f"[{entity}_REDACTED]"
    lost = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(mark), F.lit("")))
    return F.when(F.contains(text, F.lit("_REDACTED]")), lost / F.lit(len(mark))).otherwise(0)


def redaction_counts(text: Column, order: str = "default") -> Column:
    """Struct of hits per entity, each counted on what the earlier ones left.

    A hit leaves its placeholder, and no pattern matches inside or across one:
    so the placeholders gained are the hits, and each pattern runs once.
    """
    def counts(before: Column, after: Column) -> Column:
        gained = {e: _placeholders(after, e) - _placeholders(before, e) for e in ENTITIES}
        return F.struct(*[n.cast("int").alias(e.lower()) for e, n in gained.items()])

    return let(F.coalesce(text, F.lit("")), lambda before: let(redact(before, order), lambda after: counts(before, after)))


def snippet(
    text: Column, max_chars: int = C.SNIPPET_CHARS, order: str = "default", redact_first: bool = False,
) -> Column:
    """First ``max_chars`` characters, stripped, then redacted.

    ``redact_first`` redacts the whole text before the cut, so that no address
    is left half readable at the end of the snippet.
    """
    if redact_first:
        return strip(F.substring(redact(text, order), 1, max_chars))
    return redact(strip(F.substring(text, 1, max_chars)), order)
