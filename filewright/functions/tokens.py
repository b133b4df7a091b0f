"""File-name tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# A lower-to-upper change, the last capital before a lower-case letter, or a run
# of anything that is not ASCII alphanumeric.
BREAK = "(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|[^A-Za-z0-9]+"


def flat_name(name: Column) -> Column:
    """Lower-case words of a file name, extension included, joined by one space.

    Words end at a lower-to-upper change, before the last capital of an
    acronym that runs into a word, and at everything that is not ASCII
    alphanumeric.
    """
    return F.lower(F.trim(F.regexp_replace(name, BREAK, " ")))


def tokens(flat: Column) -> Column:
    return F.filter(F.split(flat, " "), lambda t: t != "")
