"""Multi-party perspective rotation of conversations.

For every participant the dialogue is rendered once with that speaker as the assistant, all others as named users, and
masks that train on the assistant's own turns only. A rendering is a sequence of segments, one row each, in order of
turns, with places in the whole rendering; a conversation is never gathered in one row or task. Places come from running
totals that are split within a conversation.

System turns are no participant's and stay system turns in every rendering. NULL roles speak as ``unknown``, NULL
texts are empty, rows without a conversation or a turn are left out. Equal turns are ordered by role and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filewright.operators.skew import running_total

SYSTEM = "system"
END = "<|end|>\n"


def header(role: Column, perspective: Column) -> Column:
    return F.when(role == SYSTEM, F.lit("<|system|>\n")).when(role == perspective, F.lit("<|assistant|>\n")).otherwise(
        F.concat(F.lit("<|user name="), role, F.lit("|>\n")))


def rotate(conversations: DataFrame) -> DataFrame:
    """``conv_id perspective turn role segment mask start end content_start``: one row per participant and turn.

    ``segment`` is the rendered turn, ``start`` and ``end`` are its characters in the rendering, ``content_start`` is
    where the text begins after the header, and ``mask`` is 1 on turns whose text and end mark count.
    """
    turns = conversations.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select(
        "conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    speakers = turns.where(F.col("role") != SYSTEM).select("conv_id", F.col("role").alias("perspective")).distinct()
    seen = turns.join(speakers, "conv_id")
    head = header(F.col("role"), F.col("perspective"))
    segments = seen.select(
        "conv_id", "perspective", "turn", "role", F.concat(head, "text", F.lit(END)).alias("segment"), F.length(head).alias("head"),
        F.when((F.col("role") == F.col("perspective")) & (F.col("role") != SYSTEM), 1).otherwise(0).alias("mask"))
    placed = running_total(segments, ["conv_id", "perspective"], ["turn", "role", "segment"], {"end": F.length("segment").cast("long")})
    return placed.select(
        "conv_id", "perspective", "turn", "role", "segment", "mask", (F.col("end") - F.length("segment")).alias("start"), "end",
        (F.col("end") - F.length("segment") + F.col("head")).alias("content_start"))


ROTATE_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
speakers AS (SELECT DISTINCT conv_id, role AS perspective FROM turns WHERE role <> '{SYSTEM}'),
rendered AS (
  SELECT t.conv_id, perspective, turn, role, text,
    CASE WHEN role = '{SYSTEM}' THEN '<|system|>' WHEN role = perspective THEN '<|assistant|>' ELSE '<|user name=' || role || '|>' END || chr(10) AS head,
    CAST(role = perspective AND role <> '{SYSTEM}' AS INT) AS mask
  FROM turns t JOIN speakers s ON t.conv_id = s.conv_id),
segments AS (SELECT *, head || text || '<|end|>' || chr(10) AS segment FROM rendered),
placed AS (
  SELECT *, CAST(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn, role, segment ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop
  FROM segments)
SELECT conv_id, perspective, turn, role, segment, mask, stop - length(segment) AS start, stop AS "end",
  stop - length(segment) + length(head) AS content_start
FROM placed
"""
