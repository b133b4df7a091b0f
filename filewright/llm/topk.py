"""Exact top-k by inner product without random access.

Candidates are cut into shards. In a shard each dimension is a list sorted by component, read from the end that a query's
weight prefers. All lists are read to the same depth, a step deeper each round. What has been read bounds every candidate:
from above as if each unread component equalled the last one read in its list, from below as if it equalled the last of
the list. Candidates whose upper bound lies below the k-th best lower bound cannot qualify; once few are left, or
the lists are read, only those left have their final scores resolved. Bounds of a block of queries against
a shard are matrix products over components clipped at the depth read.

Components are x -> floor(64 x); scores are integers and ties go to the smaller id. Vectors that are NULL, hold NULL or
non-finite components, or differ in length from the queries take no part, nor do rows with a NULL id. Rows that repeat an
id are rows of their own, and none of them is a candidate of its id's queries. Finite components of any size take part; one
of which floor(64 x) does not fit a long is an error, and so is a score among the best of a shard that does not fit one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE = 64
DEPTHS = (0.3, 0.5, 0.7, 0.85)  # share of each list read by the end of a round; afterwards all
FEW = 64  # candidates left for a query, at which reading on costs more than resolving
SHARD = 8192
BLOCK = 512


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): whole-number components of the vectors that take part."""
    def whole(v: Column) -> Column:
        scaled = F.lit(float(SCALE)) * v.cast("double")
        fits = (scaled >= F.lit(-2.0 ** 63)) & (scaled < F.lit(2.0 ** 63))
        return F.when(fits, F.floor(scaled).cast("long")).otherwise(F.raise_error(F.lit("a component times 64 does not fit a long")))

    x = F.transform("embedding", whole)
    sound = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & sound & (F.size("embedding") > 0)).select(
        F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def largest_size(x: np.ndarray) -> float:
    return max(-float(x.min()), float(x.max())) if x.size else 0.0


def search_shard(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, score) of the k best candidates of each query in a shard, and all that tie with the last."""
    largest = largest_size(x) * largest_size(q) * x.shape[1]
    # Above 2 ** 52 even doubles would round, and above 2 ** 62 longs might wrap; integers of any size then do all the work.
    kind = next((k for k, bits in ((np.float32, 24), (np.float64, 52), (np.int64, 62)) if largest < 2 ** bits), object)
    x, q = x.astype(kind), q.astype(kind)
    n = len(x)
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    lists = np.sort(x, axis=0)
    own = query_ids[:, None] == ids[None, :]
    open_ = ~own
    need = np.minimum(k, open_.sum(axis=1))
    active = np.flatnonzero(need > 0)
    ready = []
    for depth in DEPTHS if n > FEW else ():
        if not len(active):
            break
        at = min(n - 1, int(depth * n))
        top, bottom = lists[n - 1 - at], lists[at]  # last components read from above and from below
        upper = up[active] @ np.maximum(x, top).T + down[active] @ np.minimum(x, bottom).T
        lower = up[active] @ np.where(x >= top, x, lists[0]).T + down[active] @ np.where(x <= bottom, x, lists[-1]).T
        lower[~open_[active]] = -np.inf if kind is not np.int64 else np.iinfo(np.int64).min
        at_k = np.take_along_axis(np.partition(lower, n - k if n >= k else 0, axis=1), np.full((len(active), 1), max(0, n - k)), axis=1)
        short = need[active] < k  # fewer candidates than asked for: all of them qualify
        open_[active] &= (upper >= at_k) | short[:, None]
        few = open_[active].sum(axis=1) <= FEW
        ready.append(active[few])
        active = active[~few]
    rows, columns, scores = [], [], []
    for r in np.concatenate(ready).tolist() if ready else ():
        found = np.flatnonzero(open_[r])
        rows.append(np.full(len(found), r))
        columns.append(found)
        scores.append(x[found] @ q[r])
    if len(active):  # lists read to their ends: every bound is the score
        full = q[active] @ x.T
        for i, r in enumerate(active.tolist()):
            found = np.flatnonzero(open_[r])
            rows.append(np.full(len(found), r))
            columns.append(found)
            scores.append(full[i, found])
    out = []
    for r, c, s in zip(rows, columns, scores):
        if len(s) > k:
            keep = s >= np.partition(s, len(s) - k)[len(s) - k]
            r, c, s = r[keep], c[keep], s[keep]
            order = np.lexsort((ids[c], -s))[:k]
            r, c, s = r[order], c[order], s[order]
        out.append((r, c, s))
    if not out:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, int)
    return tuple(np.concatenate([o[i] for o in out]) for i in range(3))


def top_k(vectors: DataFrame, is_query: Column, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other vectors of each query vector."""
    all_ = usable(vectors)
    queries = all_.where(is_query)
    n, m = all_.count(), queries.count()
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-m // BLOCK))
    hashed = lambda salt, parts: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(parts)).cast("int")
    # Every shard meets every block of queries; a row goes to each block or shard once.
    candidates = all_.select(hashed("shard", shards).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(False).alias("query"), "vec_id", "x")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), hashed("block", blocks).alias("block"), F.lit(True).alias("query"), "vec_id", "x")

    def search(rows: pa.Table) -> pa.Table:
        flag = rows.column("query").to_numpy()
        ids = rows.column("vec_id").to_numpy()
        lists = rows.column("x").combine_chunks()
        sizes, values = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        out: list[list[np.ndarray]] = [[], [], []]
        for width in np.unique(sizes[flag]).tolist():
            fit = sizes == width
            take = lambda which: values[starts[which][:, None] + np.arange(width)]
            mine, theirs = np.flatnonzero(fit & ~flag), np.flatnonzero(fit & flag)
            # A query's own block may lie in any shard; ids tell it apart.
            if not len(mine):
                continue
            r, c, s = search_shard(ids[mine], take(mine), ids[theirs], take(theirs), k)
            for held, found in zip(out, (ids[theirs][r], ids[mine][c], s)):
                if found.dtype == object and any(not -2 ** 63 <= f < 2 ** 63 for f in found):
                    raise OverflowError("a score does not fit a long")
                held.append(found.astype(np.int64))
        columns = [np.concatenate(o) if o else np.zeros(0, np.int64) for o in out]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns)))

    found = candidates.unionAll(asked).groupBy("shard", "block").applyInArrow(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
