"""Small tables with the cases that every operator must take: NULLs, empty and long texts, repeats, extra columns."""

import re

LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 300
ODD = [(1, "One fine day in May"), (1, "One fine day in May"), (None, "nameless words here"), (2, None), (3, ""), (4, " \t\n "), (5, LONG), (6, "Ünïcode 😀 text"), (7, "x")]
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def documents(spark, rows):
    """Documents with a column that clashes with names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "src0", len(t or ""), 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, h long")


def rows(df, *columns):
    """Rows as tuples in a fixed order, NULLs last."""
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda r: tuple((v is None, v) for v in r))
