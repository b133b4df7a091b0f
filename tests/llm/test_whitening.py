"""Whitening against a full eigendecomposition."""

import math

import numpy as np
import pytest

from filewright.llm import whitening
from filewright.llm.queries import QUERIES
from tests.conftest import DATA


def check(got, vectors, components=8):
    """Rows against ``numpy``'s eigenvectors of the covariance."""
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in vectors], object)
    n, d = x.shape
    s = x.sum(axis=0)
    c = ((n * x - s) / n).astype(float)
    e, axes = np.linalg.eigh(c.T @ c / n)
    e, axes = e[::-1], axes[:, ::-1]
    k = min(components, d)
    assert len(got) == n * k
    far = sorted((i, int(v)) for (i, _), v in zip(vectors, np.square(n * x - s).sum(axis=1)))
    assert sorted((r.vec_id, r.deviation if r.deviation is not None else int(r.deviation_exact)) for r in got if r.component == 1) == far
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error <= 1e-9
    for j in range(k):
        rows = sorted((r for r in got if r.component == j + 1), key=lambda r: r.vec_id)
        if e[j] <= 1e-12 * e[0] or e[0] == 0:
            assert all(r.whitened is None and r.explained == 0 for r in rows)
            continue
        assert all(abs(r.explained * e.sum() / e[j] - 1) < 1e-9 for r in rows)
        gap = min((abs(e[j] - e[i]) for i in range(d) if i != j), default=1)
        if gap > 1e-6 * e[0]:  # equal variances leave the axes free
            want = dict(zip((i for i, _ in vectors), c @ axes[:, j] / math.sqrt(e[j])))
            sign = np.sign(sum(want[r.vec_id] * r.whitened for r in rows))
            assert max(abs(want[r.vec_id] - sign * r.whitened) for r in rows) < 1e-7


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 3, 0) for i, v in vectors], "vec_id long, embedding array<float>, n int, x int").repartition(3)


def test_given_vectors(spark):
    rows = QUERIES["op13_whitening"](spark, DATA).collect()
    given = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    check(rows, sorted((r.vec_id, r.embedding) for r in given))


@pytest.mark.parametrize("shape", ["random", "few rows", "flat", "equal variances", "steep", "one", "narrow"])
def test_shapes(spark, shape):
    rng = np.random.default_rng(3)
    n, d = {"few rows": (5, 12), "one": (1, 4), "narrow": (40, 3)}.get(shape, (60, 10))
    x = rng.standard_normal((n, d))
    if shape == "flat":
        x[:, 3] = x[:, 4]
        x[:, 5] = 0.25
    if shape == "equal variances":
        x = np.array([[s * (i == j) for j in range(10)] for i in range(10) for s in (-1.0, 1.0)])
    if shape == "steep":
        x = x * 10.0 ** -np.arange(d)[None, :] * 50
    vectors = [(i, [float(np.float32(v)) for v in row]) for i, row in enumerate(x)]
    check(whitening.whiten(frame(spark, vectors)).collect(), vectors)


def test_odd_rows(spark):
    rng = np.random.default_rng(4)
    vectors = [(i, [float(np.float32(v)) for v in row]) for i, row in enumerate(rng.standard_normal((30, 4)))]
    odd = [(90, None), (91, [0.1, None, 0.1, 0.1]), (92, [math.nan] * 4), (93, [0.1, 0.1, math.inf, 0.1]), (94, []), (95, [0.5] * 3), (96, [3e38, 0.0, 0.0, 0.0])]
    check(whitening.whiten(frame(spark, vectors + odd)).collect(), vectors)
    repeated = vectors + [(3, [0.5, -0.5, 0.25, 1.0])] * 2
    got = whitening.whiten(frame(spark, repeated)).collect()
    assert sum(r.vec_id == 3 for r in got) == 3 * 4
    assert whitening.whiten(frame(spark, [])).collect() == [] and whitening.whiten(frame(spark, odd[:4])).collect() == []
    assert len(whitening.whiten(frame(spark, [(None, [0.5, 1.0]), (1, [0.25, -1.0])])).collect()) == 4


def test_exact_deviation_beyond_a_long(spark):
    vectors = [(0, [2.0 ** 40, 0.5]), (1, [0.25, -0.5]), (2, [-(2.0 ** 39), 1.0])]
    got = whitening.whiten(frame(spark, vectors)).collect()
    assert all(r.deviation is None for r in got)
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in vectors]
    s = [sum(c) for c in zip(*x)]
    want = {i: sum((3 * a - b) ** 2 for a, b in zip(v, s)) for i, v in enumerate(x)}
    assert {r.vec_id: int(r.deviation_exact) for r in got} == want
