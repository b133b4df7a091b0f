"""The verdict struct every stage returns. NULL means the stage declined."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from filewright import constants as C
from filewright.functions.binding import let


def verdict(category, confidence, method, reason) -> Column:
    """Struct of the four fields; plain values become literals."""
    def col(value):
        return value if isinstance(value, Column) else F.lit(value)

    return F.struct(
        col(category).alias("category"),
        col(confidence).cast("int").alias("confidence"),
        col(method).alias("method"),
        col(reason).alias("reason"),
    )


def unknown(reason=C.REASON_NO_STAGE, method=C.METHOD_NONE) -> Column:
    return verdict(C.UNKNOWN, 0, method, reason)


def is_known(category: Column) -> Column:
    return category != C.UNKNOWN


def is_confident(category: Column, confidence: Column, threshold: int = C.DEFAULT_CONFIDENT) -> Column:
    return is_known(category) & (confidence >= threshold)


def accept(answer: Column, threshold: int = C.DEFAULT_ACCEPT) -> Column:
    """Keep a known verdict that reaches the threshold, otherwise decline."""
    return let(answer, lambda a: F.when(is_confident(a["category"], a["confidence"], threshold), a))


def first_known(*stages: Column) -> Column:
    """First stage whose verdict is present and known; unknown if there is none."""
    return F.coalesce(*[F.when(is_known(s["category"]), s) for s in stages], unknown())
