"""Prefix trie of conversations, screened by a count-min sketch of prefix digests.

Conversations are rebuilt first: of conversation c, the first h turns are those of conversation c - c % 100 (as far as it
has them), the others its own after its first h; h is crc32(c) % 6. A node stands for the rebuilt conversations, its
members, that begin with the same d turns; the root, with no turn, for all.

The digest of a prefix is a sum of hashes, one for each turn with its position, so digests are running totals and a
conversation of any length is dealt out over many tasks. A sketch of a few rows of counters takes in the digest of every
prefix. Counters never fall short, so a digest with a counter at one is that of one conversation alone: its node, and what
hangs below, is told in place, from the row itself. Only the other rows are shuffled and grouped exactly, by 128 bits.
A counter need only tell one from more, so it takes two bits; the sketch has a bounded size, and when the corpus outgrows it, more
prefixes go the exact way.

Sums over subtrees need no walk from level to level. Every childless node, and every saving, is booked once, with
the smallest member of its node at its depth; a running total from the deepest turn upwards then gives, for each member of a
node, what is booked below, and the node adds up its members.

NULL roles and texts are empty. Turns are taken in order of ``turn`` (NULL first), equal ones by role, then by the SHA-256 of
their text; rows without ``conv_id`` take no part; repeated rows are turns of their own. An empty table gives no nodes.
Columns besides ``conv_id turn role text`` are not looked at; texts of any length leave their row as hashes and a length.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filewright.operators.skew import running_total
from filewright.session import cut_lineage

GROUP, TURNS = 100, 6  # conversations that share a beginning, and one more than the most turns they share
SKETCH_ROWS = 4
SKETCH_CELLS = 1 << 23  # at most, for each row; one bit of each is sent to the tasks (4 MB in all)
BLOCK = 1 << 16  # cells added up at once
IDS_AT_ONCE = 1 << 14  # members joined into one piece of text
NODE = ["k1", "k2"]
OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def shared_turns(conv: Column, turns: int = TURNS) -> Column:
    return F.crc32(conv.cast("string").cast("binary")) % turns


def _hashes(*columns: Column) -> list[Column]:
    return [F.xxhash64(F.lit(seed), *columns) for seed in (1, 2)]


def rebuilt(conversations: DataFrame, group: int = GROUP, turns: int = TURNS) -> DataFrame:
    """(conv, depth, k1, k2, p1, p2, chars, last): a row for each prefix of each rebuilt conversation.

    ``k1 k2`` is the digest of the first ``depth`` turns, ``p1 p2`` that of one turn less, ``chars`` the code points
    of the last turn, ``last`` says that there are no more.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    t1, t2 = _hashes(role, text)
    own = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("turn"), role.alias("role"), F.sha2(text, 256).alias("tie"),
        F.length(text).cast("long").alias("chars"), t1.alias("t1"), t2.alias("t2"))
    ranked = cut_lineage(running_total(own, ["conv"], ["turn", "role", "tie"], {"rank": F.lit(1)}).select("conv", "rank", "chars", "t1", "t2"))
    sizes = ranked.groupBy("conv").agg(F.max("rank").alias("n"))
    base = F.col("conv") - F.col("conv") % group
    length = F.least(F.coalesce("base_n", F.lit(0)), shared_turns(F.col("conv"), turns)).cast("long")
    rest = F.greatest(F.col("n") - shared_turns(F.col("conv"), turns), F.lit(0))
    plan = cut_lineage(sizes.withColumn("base", base).join(sizes.select(F.col("conv").alias("base"), F.col("n").alias("base_n")), "base", "left").select(
        "conv", "base", length.alias("head"), (length + rest).alias("length")))
    skipped = shared_turns(F.col("conv"), turns)
    tail = ranked.where(F.col("rank") > skipped).join(plan.select("conv", "head", "length"), "conv").withColumn(
        "depth", F.col("head") + F.col("rank") - skipped)
    heads = ranked.where((F.col("rank") < turns) & (F.col("conv") % group == 0)).withColumnRenamed("conv", "base")
    head = plan.join(heads, "base").where("rank <= head").withColumn("depth", F.col("rank"))
    columns = ["conv", "depth", "length", "chars", "t1", "t2"]
    zero = F.lit(0).cast("long")
    root = plan.select("conv", zero.alias("depth"), "length", zero.alias("chars"), F.lit(None).cast("long").alias("t1"), F.lit(None).cast("long").alias("t2"))
    rows = tail.select(*columns).unionByName(head.select(*columns)).unionByName(root)
    # Sums of halves of 32 bits, so that no sum overflows; what counts of them are the lower 32 bits.
    halves = [F.when(F.col("t1").isNull(), zero).otherwise(part) for g in _hashes(F.col("depth"), F.col("t1"), F.col("t2"))
              for part in (F.shiftrightunsigned(g, 32), g.bitwiseAND(F.lit(0xFFFFFFFF)))]
    rows = rows.select("conv", "depth", "chars", (F.col("depth") == F.col("length")).alias("last"), *[h.alias(f"g{i}") for i, h in enumerate(halves)])
    summed = running_total(rows, ["conv"], ["depth"], {f"s{i}": F.col(f"g{i}") for i in range(4)})

    def digest(*sums: Column) -> list[Column]:
        low = [s.bitwiseAND(F.lit(0xFFFFFFFF)) for s in sums]
        return [F.shiftleft(low[i], 32).bitwiseOR(low[i + 1]) for i in (0, 2)]

    here = digest(*[F.col(f"s{i}") for i in range(4)])
    above = digest(*[F.col(f"s{i}") - F.col(f"g{i}") for i in range(4)])
    return summed.select("conv", "depth", here[0].alias("k1"), here[1].alias("k2"), above[0].alias("p1"), above[1].alias("p2"), "chars", "last")


def cells(k1: np.ndarray, k2: np.ndarray, row: int, width: int) -> np.ndarray:
    """Counters of digests in one row of a sketch whose width is a power of two."""
    mixed = (k1.view(np.uint64) + np.uint64(row) * (k2.view(np.uint64) | np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - width.bit_length() + 1)).astype(np.int64)


def twice_seen(prefixes: DataFrame, width: int, rows: int = SKETCH_ROWS) -> dict[int, bytes]:
    """Cells of a count-min sketch of the prefixes that counted two or more, as bits by blocks of ``BLOCK`` cells.

    Each task counts its prefixes; equal blocks of all tasks are added up where they meet, two bits a cell.
    """

    def count(batches):
        once, twice = (np.zeros(rows * width, bool) for _ in range(2))
        some = False
        for batch in batches:
            some = some or batch.num_rows > 0
            k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for row in range(rows):
                at, n = np.unique(row * width + cells(k1, k2, row, width), return_counts=True)
                twice[at] |= once[at] | (n > 1)
                once[at] = True
        if some:
            for block in range(0, rows * width, BLOCK):
                one, two = once[block:block + BLOCK], twice[block:block + BLOCK]
                if one.any():
                    yield pa.RecordBatch.from_arrays([
                        pa.array([block // BLOCK]), pa.array([np.packbits(one).tobytes()]), pa.array([np.packbits(two).tobytes()])], ["block", "once", "twice"])

    def add(batches):
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for block, one, two in zip(*(c.to_pylist() for c in batch.columns)):
                one, two = np.frombuffer(one, np.uint8), np.frombuffer(two, np.uint8)
                if block in held:
                    seen = held[block]
                    held[block] = [seen[0] | one, seen[1] | two | (seen[0] & one)]
                else:
                    held[block] = [one, two]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([two.tobytes() for _, two in held.values()])], ["block", "twice"])

    counted = prefixes.select("k1", "k2").mapInArrow(count, "block long, once binary, twice binary")
    return {r.block: bytes(r.twice) for r in counted.repartition("block").mapInArrow(add, "block long, twice binary").collect()}


def screen(prefixes: DataFrame, limit: int = SKETCH_CELLS, rows: int = SKETCH_ROWS) -> DataFrame:
    """Add ``single``, proven to be of one conversation, and ``above``, the same of the prefix one turn shorter."""
    width = BLOCK
    wanted = 16 * prefixes.count()
    while width < min(wanted, limit):
        width *= 2
    shared = prefixes.sparkSession.sparkContext.broadcast(twice_seen(prefixes, width, rows))
    schema = prefixes.schema
    at = {c: i for i, c in enumerate(schema.names)}

    def judge(batches):
        bits = np.zeros(rows * width // 8, np.uint8)
        for block, twice in shared.value.items():
            bits[block * BLOCK // 8:(block + 1) * BLOCK // 8] = np.frombuffer(twice, np.uint8)

        def single(k1, k2):
            found = np.zeros(len(k1), bool)
            for row in range(rows):
                cell = row * width + cells(k1, k2, row, width)
                found |= bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1 == 0
            return pa.array(found)

        for batch in batches:
            k1, k2, p1, p2 = (batch.column(at[c]).to_numpy() for c in ("k1", "k2", "p1", "p2"))
            yield pa.RecordBatch.from_arrays([*batch.columns, single(k1, k2), single(p1, p2)], [*schema.names, "single", "above"])

    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    return prefixes.mapInArrow(judge, f"{out}, single boolean, above boolean")


def digest_of_ends(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256): SHA-256 of the members ``conv`` of each node, ascending and joined by commas.

    Members are sorted in ranges over all tasks and joined into pieces there; only pieces of text meet, in order, where a
    node's digest is taken, one at a time.
    """
    names = [*NODE, "first", "ids"]

    def join(batches):
        node, held, first = None, [], None

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in (*node, first, ",".join(map(str, held)))], names)

        for batch in batches:
            for k1, k2, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if (k1, k2) != node or len(held) == IDS_AT_ONCE:
                    if held:
                        yield flush()
                    node, held, first = (k1, k2), [], conv
                held.append(conv)
        if held:
            yield flush()

    def hashed(batches):
        node, state = None, None

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in (*node, state.hexdigest())], [*NODE, "ends_sha256"])

        for batch in batches:
            for k1, k2, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if (k1, k2) != node:
                    if node:
                        yield flush()
                    node, state = (k1, k2), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        if node:
            yield flush()

    schema = "k1 long, k2 long, first long, ids string"
    dealt = ends.select(*NODE, "conv").repartitionByRange(*NODE, "conv").sortWithinPartitions(*NODE, "conv")
    pieces = dealt.mapInArrow(join, schema).repartition(*NODE).sortWithinPartitions(*NODE, "first")
    return pieces.mapInArrow(hashed, "k1 long, k2 long, ends_sha256 string")


def trie(conversations: DataFrame, group: int = GROUP, turns: int = TURNS, limit: int = SKETCH_CELLS) -> DataFrame:
    """One row per node, columns ``OUT``; (conv_id, depth) names a node."""
    rows = cut_lineage(screen(rebuilt(conversations, group, turns), limit))
    text = F.col("conv").cast("string")
    nothing, zero = F.sha2(F.lit(""), 256), F.lit(0).cast("long")
    member_of_itself = [
        F.col("conv").alias("conv_id"), F.col("depth"), F.lit(1).cast("long").alias("n_convs"), F.when(F.col("last"), 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), zero.alias("saved_tokens"), F.when(F.col("last"), F.sha2(text, 256)).otherwise(nothing).alias("ends_sha256")]
    single = rows.where("single").select(
        *member_of_itself, F.when((F.col("depth") > 0) & F.col("above"), F.col("conv")).alias("parent_conv_id"), "above", "p1", "p2")
    told = single.where("above OR depth = 0").select(*OUT)
    below_shared = single.where("NOT above AND depth > 0").drop("parent_conv_id")

    members = rows.where("NOT single")
    nodes = cut_lineage(members.groupBy(*NODE).agg(
        F.min("conv").alias("conv_id"), F.min("depth").alias("depth"), F.count("*").alias("n_convs"), F.min("chars").alias("chars"),
        F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.count_if("last").alias("n_ends")))
    parents = nodes.where("depth > 0").select("p1", "p2").unionAll(below_shared.select("p1", "p2"))
    children = parents.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    known = nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", zero))

    # Booked at the smallest member of a node, then added up from the deepest turn: at equal depth what is booked comes first.
    none = [F.lit(None).cast("long").alias(k) for k in NODE]
    booked = known.select(
        F.col("conv_id").alias("conv"), (-F.col("depth")).alias("up"), F.lit(0).alias("asks"), *none,
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    ends_alone = rows.where("single AND last").select(
        "conv", (-F.col("depth")).alias("up"), F.lit(0).alias("asks"), *none, zero.alias("saved"), F.lit(1).cast("long").alias("leaf"))
    asking = members.select("conv", (-F.col("depth")).alias("up"), F.lit(1).alias("asks"), *NODE, zero.alias("saved"), zero.alias("leaf"))
    below = running_total(booked.unionAll(ends_alone).unionAll(asking), ["conv"], ["up", "asks"], {
        "saved_tokens": F.col("saved"), "n_leaves": F.col("leaf")})
    sums = below.where("asks = 1").groupBy(*NODE).agg(F.sum("saved_tokens").alias("saved_tokens"), F.sum("n_leaves").alias("n_leaves"))

    above = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    ends = digest_of_ends(members.where("last"))
    # A node whose parent was proven to be of one conversation is of that one too.
    parent = F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "conv_id"))
    grouped = known.join(sums, NODE).join(ends, NODE, "left").join(above, ["p1", "p2"], "left").withColumns({
        "parent_conv_id": parent, "ends_sha256": F.coalesce("ends_sha256", nothing)})
    hung = below_shared.join(above, ["p1", "p2"])
    return told.unionByName(grouped.select(*OUT)).unionByName(hung.select(*OUT))


CRC = """list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, len(s) + 1), lambda i: CAST(ord(s[i]) AS BIGINT))),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)),
      lambda a, step: CASE WHEN a & 1 = 1 THEN xor(a >> 1, CAST(3988292384 AS BIGINT)) ELSE a >> 1 END))"""

TRIE_SQL = f"""
WITH RECURSIVE own AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS r
  FROM conversations WHERE conv_id IS NOT NULL),
plan AS (SELECT c, c - c % {GROUP} AS base, xor({CRC}, CAST(4294967295 AS BIGINT)) % {TURNS} AS h, n
  FROM (SELECT c, CAST(c AS VARCHAR) AS s, count(*) AS n FROM own GROUP BY c)),
heads AS (SELECT p.c, o.r AS d, o.role, o.text FROM plan p JOIN own o ON o.c = p.base AND o.r <= p.h),
kept AS (SELECT p.c, p.h, p.n, count(x.d) AS head FROM plan p LEFT JOIN heads x ON x.c = p.c GROUP BY p.c, p.h, p.n),
turns AS (
  SELECT c, d, role, text FROM heads
  UNION ALL SELECT o.c, k.head + o.r - k.h, o.role, o.text FROM own o JOIN kept k ON k.c = o.c AND o.r > k.h),
prefixes AS (
  SELECT c, d, role, text, list({{'r': role, 't': text}}) OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING) AS path FROM turns),
lengths AS (SELECT c, head + greatest(n - h, 0) AS l FROM kept),
rows AS (
  SELECT p.c, p.d, p.path, length(p.text) AS chars, p.d = l.l AS last FROM prefixes p JOIN lengths l ON l.c = p.c
  UNION ALL SELECT c, 0, [], 0, l = 0 FROM lengths),
nodes AS (
  SELECT path, d, min(c) AS c, count(*) AS n, min(chars) AS chars,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (last), '')) AS ends
  FROM rows GROUP BY path, d),
children AS (SELECT path[:d - 1] AS path, count(*) AS k FROM nodes WHERE d > 0 GROUP BY 1),
full_nodes AS (SELECT n.*, coalesce(k.k, 0) AS k FROM nodes n LEFT JOIN children k ON k.path = n.path),
-- Each node is found again at all prefixes of its smallest member.
sums AS (
  SELECT r.path, sum((n.n - 1) * n.chars) AS saved, count(*) FILTER (n.k = 0) AS leaves
  FROM full_nodes n JOIN rows r ON r.c = n.c AND r.d <= n.d GROUP BY r.path)
SELECT n.c AS conv_id, CAST(n.d AS BIGINT) AS depth, p.c AS parent_conv_id, n.n AS n_convs, n.k AS n_children,
  CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, n.ends AS ends_sha256
FROM full_nodes n JOIN sums s ON s.path = n.path LEFT JOIN nodes p ON n.d > 0 AND p.d = n.d - 1 AND p.path = n.path[:n.d - 1]
"""
