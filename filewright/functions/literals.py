"""SQL text of literals, for long lists that go to the JVM in one call."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def array_of(texts: Iterable[str]) -> Column:
    return F.expr("array(" + ", ".join(quote(t) for t in texts) + ")")


def map_of(pairs: Iterable[tuple[str, str]]) -> Column:
    return F.expr("map(" + ", ".join(f"{quote(k)}, {quote(v)}" for k, v in pairs) + ")")
