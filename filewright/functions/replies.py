"""Scorer prompts and replies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from filewright import constants as C
from filewright.functions import text as X
from filewright.functions.binding import let
from filewright.functions.verdicts import unknown, verdict

PROMPT = """Decide which one of these categories the file belongs to:
{categories}

File name: {filename}
Start of its text: {snippet}

Trust clear markers in the file name. If neither name nor text points to a
category, answer Unknown_Unsorted with a low confidence.
Answer with one JSON object and nothing else, for example
{{"category": "Category_Name", "confidence": 95, "reason": "short explanation"}}
"""


def build_prompt(
    filename: Column, snippet: Column, categories: Sequence[str],
    template: str = PROMPT, redact_filename: bool = False,
) -> Column:
    """Fill a template with ``{categories}``, ``{filename}`` and ``{snippet}`` slots.

    The text between the slots becomes literals of one ``concat``, so a slot's
    content can never be read as a slot.
    """
    from string import Formatter

    slots = {
        "categories": F.lit(", ".join(categories)),
        "filename": X.redact(filename) if redact_filename else filename,
        "snippet": snippet,
    }
    parts = []
    for literal, slot, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if slot is not None:
            parts.append(F.coalesce(slots[slot], F.lit("")))
    return F.concat(*parts)


def strip_fence(reply: Column) -> Column:
    """Drop a Markdown code fence around a reply."""
    out = F.regexp_replace(X.strip(reply), r"\A```(?:json)?", "")
    return X.strip(F.regexp_replace(out, r"```\z", ""))


def _parse(cleaned: Column) -> Column:
    """Variant of a text that is one JSON value and nothing more, else NULL.

    The parser stops after the first value. Text behind it breaks either the
    array or the object it is wrapped in here.
    """
    keyed = F.try_parse_json(F.concat(F.lit('{"v":'), cleaned, F.lit("}")))

    def single(listed: Column) -> Column:
        alone = keyed.isNotNull() & F.try_variant_get(listed, "$[1]", "variant").isNull()
        return F.when(alone, F.try_variant_get(listed, "$[0]", "variant"))

    return let(F.try_parse_json(F.concat(F.lit("["), cleaned, F.lit("]"))), single)


def _plain_numbers(cleaned: Column) -> Column:
    """NaN and infinities as null: both give confidence 0."""
    return F.regexp_replace(cleaned, r"(?<=[:\[,\s])(?:NaN|-?Infinity)(?=\s*[,}\]])", "null")


def quoted(text: Column) -> Column:
    """Text in quotes with control characters escaped, as shown in reasons."""
    body = text
    for char, escape in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        body = F.replace(body, F.lit(char), F.lit(escape))
    double = F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"'))
    return F.when(double, F.concat(F.lit('"'), body, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'")))


def to_confidence(number: Column, text: Column) -> Column:
    """Integer in 0..100 from a JSON number, or from a text that is an integer."""
    whole = F.rlike(text, F.lit(rf"\A[{X.SPACE}]*[+-]?\p{{Nd}}+(?:_\p{{Nd}}+)*[{X.SPACE}]*\z"))
    from_text = F.when(whole, F.replace(X.strip(text), F.lit("_"), F.lit("")).try_cast("double"))
    value = F.coalesce(number, from_text, F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), value)).cast("int")


def _shown(value: Column, default: str) -> Column:
    """Text of a JSON value; a missing one is ``default``."""
    text = F.try_variant_get(value, "$", "string")
    kind = F.schema_of_variant(value)
    return (
        F.when(value.isNull(), F.lit(default))
        .when(F.is_variant_null(value), F.lit("None"))
        .when(kind == "BOOLEAN", F.initcap(text))
        .otherwise(F.coalesce(text, F.to_json(value)))
    )


def _verdict_of(data: Column, categories: Sequence[str]) -> Column:
    """Verdict of a JSON object."""
    def field(name: str) -> Column:
        return F.try_variant_get(data, f"$.{name}", "variant")

    def judged(parts: Column) -> Column:
        category, kind = parts["category"], parts["kind"]
        number = F.when(kind == "BOOLEAN", (parts["text"] == "true").cast("double")).when(kind != "STRING", parts["number"])
        overflow = F.coalesce((kind != "STRING") & number.isin(float("inf"), float("-inf")), F.lit(False))
        confidence = to_confidence(number, F.when(kind == "STRING", parts["text"]))
        return (
            F.when(overflow, F.lit(None))
            .when(category.isin(list(categories)), verdict(category, confidence, C.METHOD_MODEL, parts["reason"]))
            .otherwise(unknown(
                F.concat(F.lit("AI suggested unknown category "), quoted(category)), C.METHOD_MODEL))
        )

    return let(F.struct(
        let(field("category"), lambda v: _shown(v, C.UNKNOWN)).alias("category"),
        F.schema_of_variant(field("confidence")).alias("kind"),
        F.try_variant_get(data, "$.confidence", "string").alias("text"),
        F.try_variant_get(data, "$.confidence", "double").alias("number"),
        let(field("reason"), lambda v: _shown(v, C.REASON_DEFAULT_REPLY)).alias("reason"),
    ), judged)


def parse_reply(reply: Column, categories: Sequence[str]) -> Column:
    """Verdict struct of a raw scorer reply.

    Unknown with a telling reason for an empty reply, invalid JSON, JSON that
    is no object, or a category outside ``categories``. A number too large for
    a double declines (NULL).
    """
    def parsed(data: Column) -> Column:
        return (
            F.when(data.isNull(), unknown(C.REASON_BAD_JSON, C.METHOD_MODEL))
            .when(~F.startswith(F.schema_of_variant(data), F.lit("OBJECT")), unknown(C.REASON_NOT_OBJECT, C.METHOD_MODEL))
            .otherwise(_verdict_of(data, categories))
        )

    def answered(cleaned: Column) -> Column:
        return let(F.coalesce(_parse(cleaned), _parse(_plain_numbers(cleaned))), parsed)

    return F.when(X.is_blank(reply), unknown(C.REASON_EMPTY_REPLY, C.METHOD_MODEL)).otherwise(
        let(strip_fence(reply), answered))
