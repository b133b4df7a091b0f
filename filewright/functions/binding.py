"""Use a value several times without computing it several times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``. The value is bound to a lambda variable, so nested
    bodies stay as small as they are written, wherever the optimizer moves them."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
