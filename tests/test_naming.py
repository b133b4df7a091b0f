import os
import random

import pytest

from filewright.operators.naming import unique_names



def greedy(rows, existing, sep="_"):
    """One row after the other: the first free name."""
    taken, out = set(existing), {}
    for seq, folder, name in sorted(rows):
        root, ext = os.path.splitext(name)
        k, candidate = 0, name
        while (folder, candidate) in taken:
            k += 1
            candidate = f"{root}{sep}{k}{ext}"
        taken.add((folder, candidate))
        out[seq] = candidate
    return out


def named(spark, rows, existing=None, **options):
    plan = spark.createDataFrame(rows, "seq long, category string, name string")
    held = None if existing is None else spark.createDataFrame(list(existing), "category string, name string")
    return {r.seq: r.dest_name for r in unique_names(plan, held, **options).collect()}


@pytest.mark.parametrize("names, existing, want", [
    (["a.pdf", "a.pdf"], [], ["a.pdf", "a_1.pdf"]),
    (["a.pdf"], ["a.pdf"], ["a_1.pdf"]),
    (["a.pdf", "a.pdf", "a_1.pdf"], [], ["a.pdf", "a_1.pdf", "a_1_1.pdf"]),
    (["a_1.pdf", "a.pdf", "a.pdf"], [], ["a_1.pdf", "a.pdf", "a_2.pdf"]),
])
def test_golden_names(spark, names, existing, want):
    rows = [(i, "C", n) for i, n in enumerate(names)]
    got = named(spark, rows, [("C", e) for e in existing])
    assert [got[i] for i in range(len(names))] == want


@pytest.mark.parametrize("seed", range(4))
def test_random_plans_equal_one_by_one(spark, seed):
    # Many independent folders make one run a few hundred small cases.
    rng = random.Random(seed)
    pool = ["a.p", "a_1.p", "a_2.p", "a_3.p", "a_1_1.p", "a_1_2.p", "a_2_1.p", "a_01.p", "a", "a_1", "_1.p", "b.p", ".a", ".a_1"]
    rows, existing, seq = [], set(), list(range(3000))
    rng.shuffle(seq)
    for folder in range(150):
        some = rng.sample(pool, rng.randint(1, 5))
        for _ in range(rng.randint(1, 14)):
            rows.append((seq.pop(), f"c{folder}", rng.choice(some)))
        if rng.random() < 0.5:
            existing.update((f"c{folder}", rng.choice(some)) for _ in range(rng.randint(1, 3)))
    got = named(spark, rows, existing if seed % 2 else None)
    assert got == greedy(rows, existing if seed % 2 else [])


def test_one_name_holds_most_rows(spark):
    # Positions far apart use every bucket level.
    rows = [(i * 7919 * 100003 - 10**9, "C", "index.html") for i in range(1500)]
    rows += [(i * 31 + 10**13, "C", f"index_{i}.html") for i in range(1, 300)]
    assert named(spark, rows) == greedy(rows, [])
