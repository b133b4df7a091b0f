"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation.

The centred rows X are never gathered, nor is their covariance formed. From a unit vector v the method alternates
u = Xv and v = Xᵀu, each made orthogonal to all earlier ones, which gives X V = U B with a small bidiagonal B on the
driver. One pass over the rows makes both products: a row's part of every u is its product with a vector as short as
the row (u_j = X w_j), so no u is stored, and the pass adds up Xᵀu, Uᵀu and uᵀu. Sums are numbers per dimension, added
up within tasks, then by Spark. The singular values of B over the root of n are the deviations, its right singular
vectors turned by V the components.

Steps end when the leading components have settled and what they and the rest of B leave of the variance is less
than the least of them, so that none can have been missed; at the latest after as many steps as dimensions. Where the
recurrence breaks down (a subspace that X maps to itself) it goes on from a new direction.

Entries c become x = floor(1024 c) + 100000. Rows whose vector is NULL, holds NULL or non-finite entries, or an entry whose
x does not fit 64 bits, take no part; of vectors of several lengths the longest take part. Rows that repeat an id are
rows of their own, NULL ids are kept, an empty table gives no rows, columns besides ``vec_id`` and ``embedding`` are not looked at.
A component without variance (fewer rows than dimensions, repeated dimensions) has no whitened value: NULL, explained 0.
``deviation`` is exact; where it does not fit 64 bits it is NULL and ``deviation_exact`` holds it as text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filewright.session import cut_lineage

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
SETTLED = 1e-15  # residual of a component against the largest
NO_VARIANCE = 1e-13  # of the largest variance: below it a component is rounding
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact string"
BATCH = 1 << 21  # entries handled at once in a task


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x): rows that take part, entries as whole numbers."""
    sound = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("c")).where(
        F.col("c").isNotNull() & ~F.exists("c", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) >= 2.0 ** 52)))
    x = F.transform("c", lambda v: F.floor(v * SCALE).cast("long") + SHIFT)
    longest = sound.agg(F.max(F.size("c")).alias("d")).first().d
    return sound.where(F.size("c") == (longest or 0)).select("vec_id", x.alias("x"))


def matrix(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and rows of a batch, in pieces of bounded size."""
    column = batch.column(1)
    d = len(column[0]) if len(column) else 0
    step = max(1, BATCH // max(1, d))
    for i in range(0, len(column), step):
        piece = column.slice(i, step)
        yield batch.column(0).slice(i, step), piece.flatten().to_numpy().reshape(len(piece), d)


def sums(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], kind: str) -> list:
    """``part`` of all pieces of the rows, added up: within tasks, then by Spark; as short as what ``part`` returns."""

    def run(batches):
        total = None
        for batch in batches:
            for _, x in matrix(batch):
                got = part(x)
                total = got if total is None else total + got
        if total is not None:
            import decimal

            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(len(total)), pa.int32()),
                pa.array([decimal.Decimal(int(v)) for v in total], pa.decimal128(38, 0)) if kind != "double" else pa.array(total)], ["at", "v"])

    found = rows.mapInArrow(run, f"at int, v {kind}").groupBy("at").agg(F.sum("v").alias("v")).collect()
    return [v for _, v in sorted((r["at"], r["v"]) for r in found)]


def centred(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """(n x - s) / n, the difference taken in whole numbers."""
    return (scaled(x, n, s) / n).astype(np.float64)


def scaled(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """n x - s, exact: in 64 bits where that holds, else in Python's whole numbers."""
    low, high = (int(x.min()), int(x.max())) if x.size else (0, 0)
    if n * max(abs(low), abs(high)) + max(map(abs, s), default=0) < 1 << 62:
        return n * x - np.array(s, np.int64)
    return n * x.astype(object) - np.array(s, object)


def orthogonal(v: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for b in basis:
            v = v - (b @ v) * b
    return v


def bidiagonalise(product: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, float]], d: int, trace: float, wanted: int):
    """(variances times n, components) of the leading ``wanted`` singular triplets, largest first.

    ``product(w, W)`` gives Xᵀu, Uᵀu and uᵀu for u = Xw and U = XW.
    """
    rng = np.random.default_rng(7)
    v = orthogonal(rng.standard_normal(d), [])
    v /= np.linalg.norm(v)
    right, left, back, alphas, betas = [v], np.zeros((d, 0)), np.zeros((d, 0)), [], []
    beta = 0.0
    while True:
        w = right[-1] - (beta * left[:, -1] if left.shape[1] else 0)
        xu, uu, norm2 = product(w, left)
        # Twice is enough; both times the coefficients come from sums over all rows, and a second pass only where it matters.
        lost = norm2 - uu @ uu
        w, xu = w - left @ uu, xu - back @ uu
        if lost < 0.5 * norm2:
            again, uu, norm2 = product(w, left)
            w, xu, lost = w - left @ uu, again - back @ uu, norm2 - uu @ uu
        alpha = np.sqrt(max(lost, 0.0))
        broken = alpha ** 2 <= 1e-28 * max(trace, 1e-300)
        alpha = 0.0 if broken else alpha
        u = np.zeros(d) if broken else w / alpha
        xu = np.zeros(d) if broken else xu / alpha
        alphas.append(alpha)
        left, back = np.column_stack([left, u]), np.column_stack([back, xu])
        k = len(alphas)
        p, sigma, q = np.linalg.svd(np.diag(alphas) + np.diag(betas, 1))
        if k == d:
            break
        v = orthogonal(xu - alpha * right[-1], right)
        beta = float(np.linalg.norm(v))
        if beta ** 2 <= 1e-28 * max(trace, 1e-300):
            beta = 0.0
            v = orthogonal(rng.standard_normal(d), right)
            v /= np.linalg.norm(v)
        else:
            v /= beta
        lead = min(wanted, k)
        settled = lead == wanted and np.all(beta * np.abs(p[-1, :lead]) <= SETTLED * sigma[0])
        if settled and trace - float(sigma @ sigma) < sigma[lead - 1] ** 2:
            break
        right.append(orthogonal(v, right))
        right[-1] /= np.linalg.norm(right[-1])
        betas.append(beta)
    lead = min(wanted, d)
    return sigma[:lead] ** 2, (np.column_stack(right) @ q.T)[:, :lead]


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per usable row and component: columns of ``SCHEMA``; components from 1 by falling variance."""
    rows = cut_lineage(usable(embeddings))
    spark = rows.sparkSession
    n = rows.count()
    d = len(rows.first().x) if n else 0
    if not d:
        return spark.createDataFrame([], SCHEMA)
    s = [int(v) for v in sums(rows, lambda x: x.sum(axis=0) if abs(x).max() < 1 << 40 else x.astype(object).sum(axis=0), "decimal(38,0)")]
    trace = sums(rows, lambda x: np.array([np.square(centred(x, n, s)).sum()]), "double")[0]

    def product(w: np.ndarray, left: np.ndarray):
        def part(x: np.ndarray) -> np.ndarray:
            c = centred(x, n, s)
            u = c @ w
            return np.concatenate([c.T @ u, (c @ left).T @ u, [u @ u]])

        got = np.array(sums(rows, part, "double"))
        return got[:d], got[d:-1], got[-1]

    energy, axes = bidiagonalise(product, d, trace, components)
    real = energy > NO_VARIANCE * max(energy[0], 1e-300) if trace > 0 else np.zeros(len(energy), bool)
    turn = axes / np.sqrt(np.where(real, energy, 1) / n)
    explained = [float(e / trace) if ok else 0.0 for e, ok in zip(energy, real)]
    k = len(energy)

    def gram(x: np.ndarray) -> np.ndarray:
        z = centred(x, n, s) @ turn
        return np.concatenate([(z.T @ z).ravel(), z.sum(axis=0)])

    got = np.array(sums(rows, gram, "double")) / n
    covariance = got[:k * k].reshape(k, k) - np.outer(got[k * k:], got[k * k:])
    off = np.abs(covariance - np.eye(k))[np.ix_(real, real)]
    error = float(off.max()) if off.size else 0.0

    def project(batches):
        for batch in batches:
            for ids, x in matrix(batch):
                whole = scaled(x, n, s)
                z = (whole / n).astype(np.float64) @ turn
                small = whole.dtype != object and int(np.abs(whole).max()) ** 2 * d < 1 << 62
                far = np.square(whole).sum(axis=1) if small else np.square(whole.astype(object)).sum(axis=1)
                fits = [int(v) < 1 << 63 for v in far]
                m = len(ids)
                at = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays([
                    ids.take(at), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, n)),
                    pa.array([int(v) if ok else None for v, ok in zip(far, fits)], pa.int64()).take(at),
                    pa.array(z.ravel(), mask=np.tile(~real, m)), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                    pa.array([None if ok else str(v) for v, ok in zip(far, fits)], pa.string()).take(at),
                ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"])

    return rows.mapInArrow(project, SCHEMA)
