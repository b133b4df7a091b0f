"""The similarity join against all pairs."""

import random

import numpy as np
import pytest

from filewright.llm import jaccard
from tests.llm.common import LONG, ODD, WORDS, documents, lower, rows


def shingles(text):
    words = WORDS.findall(lower(text))
    return {tuple(words[i:i + 4]) for i in range(len(words) - 3)} if len(words) >= 4 else {tuple(words)} - {()}


def brute(table, percent=85):
    sets = [shingles(t) for _, t in table]
    root = list(range(len(table)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(table)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    low = {}
    for i, (doc_id, _) in enumerate(table):
        if doc_id is not None:
            low[find(i)] = min(doc_id, low.get(find(i), doc_id))
    return sorted(((d, len(s), low.get(find(i))) for i, ((d, _), s) in enumerate(zip(table, sets))), key=lambda r: tuple((v is None, v) for v in r))


def copies(rng, n):
    """Texts of many lengths, each with copies of one to several changed words, and a template that most documents fill in."""
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    while len(out) < n:
        words = rng.choices(vocabulary, k=rng.choice([1, 3, 4, 5, 8, 12, 20, 40, 90, 300]))
        out.append(words)
        for _ in range(rng.choice([0, 1, 4])):
            near = list(words)
            for _ in range(rng.choice([0, 1, 1, 2, 5])):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            out.append(near + rng.choices(vocabulary, k=rng.choice([0, 0, 1, 3])))
    template = rng.choices(vocabulary, k=60)
    for i in range(n // 2):
        out.append([*template[:rng.choice([50, 58, 60])], f"number{i % 40}", rng.choice(vocabulary)])
    rng.shuffle(out)
    return [(i, " ".join(w)) for i, w in enumerate(out)]


@pytest.mark.parametrize("seed,block", [(1, jaccard.BLOCK_ELEMENTS), (2, 700), (3, 150)])
def test_equals_all_pairs(spark, seed, block, monkeypatch):
    monkeypatch.setattr(jaccard, "FAN", 3)
    monkeypatch.setattr(jaccard, "LEAVES", 4)
    monkeypatch.setattr(jaccard, "KEYS_AT_ONCE", 300)
    table = copies(random.Random(seed), 160)
    got = jaccard.similar(documents(spark, table).repartition(6), block=block)
    assert rows(got, "doc_id", "n_shingles", "component_id") == brute(table)


def test_odd_documents(spark):
    table = [*ODD, (8, LONG + " more"), (9, LONG * 100), (None, "nameless words here"), (10, "One fine day in MAY"), (11, "ONE fine day in may")]
    got = jaccard.similar(documents(spark, table))
    assert rows(got, "doc_id", "n_shingles", "component_id") == brute(table)
    assert jaccard.similar(documents(spark, [])).collect() == []


def test_linked_sets_share_a_key():
    """At sizes around the edges of classes and at the least similarity."""
    rng = np.random.default_rng(5)
    for n in [*range(1, 60), 99, 100, 277, 1000, 5000]:
        for _ in range(6):
            for m in {n, n + 1, int(n / 0.85)}:
                need = -(-85 * (n + m) // 185)
                if need > min(n, m):
                    continue
                pool = rng.integers(0, 1 << 63, n + m, dtype=np.int64).astype(np.uint64) * np.uint64(2)
                a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[:need], pool[n:n + m - need]]))
                assert jaccard.linked(a, b) and (np.array_equal(a, b) or set(jaccard.keys(a)) & set(jaccard.keys(b)))


def test_tree_leaves_out_no_link_and_many_pairs():
    rng = np.random.default_rng(6)
    families = [rng.integers(0, 1 << 63, 60, dtype=np.int64).astype(np.uint64) for _ in range(40)]
    sets = [np.unique(np.concatenate([f[:rng.integers(52, 61)], rng.integers(0, 1 << 63, 3, dtype=np.int64).astype(np.uint64)])) for f in families for _ in range(20)]
    sets = [sets[i] for i in jaccard.by_likeness(sets)]
    tree, seen = jaccard.tree_of(sets, jaccard.bits_for(sets)), set()
    jaccard.traverse(tree, tree, 85, lambda i, j: seen.add((min(i, j), max(i, j))))
    true = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if jaccard.linked(sets[i], sets[j])}
    assert true <= seen and len(seen) < 0.1 * len(sets) ** 2 / 2


def test_chain_gives_pairs_with_its_smallest_class(spark):
    """Pairs of neighbours alone would cost a round over all links for each doubling of a chain's length."""
    keys = [(i, [i, i + 1]) for i in range(50)]
    random.Random(7).shuffle(keys)
    pairs = jaccard.candidates(spark.createDataFrame(keys, "cls long, keys array<long>").coalesce(1))
    assert {tuple(r) for r in pairs.collect()} == {(0, i) for i in range(1, 50)}
    words = random.Random(8).choices([f"w{i}" for i in range(400)], k=300)
    sets = [jaccard.shingles(" ".join(words[2 * i:2 * i + 100])) for i in range(90)]
    assert not jaccard.linked(sets[0], sets[5]) and jaccard.linked(sets[0], sets[1])
    named = random.Random(9).sample(range(-1000, 1000), len(sets))
    placed = spark.createDataFrame([(0, 0, c, bytearray(s.tobytes())) for c, s in zip(named, sets)], "root long, block long, cls long, elements binary")
    assert sorted(map(tuple, jaccard.links_in_blocks(placed, 85).collect())) == [(min(named), c) for c in sorted(named)[1:]]


@pytest.mark.parametrize("block,calls", [(jaccard.BLOCK_ELEMENTS, 1), (700, 4)])
def test_clusters_of_one_block_need_no_rounds_over_links(spark, block, calls, monkeypatch):
    """Components are sought once for clusters; over links only where a cluster has several blocks."""
    words = random.Random(10).choices([f"w{i}" for i in range(400)], k=300)
    table = [(i, " ".join(words[2 * (i * 37 % 90):][:100])) for i in range(90)]
    seen, whole = [], jaccard.components
    monkeypatch.setattr(jaccard, "components", lambda edges: seen.append(edges) or whole(edges))
    got = jaccard.similar(documents(spark, table), block=block)
    assert rows(got, "doc_id", "n_shingles", "component_id") == brute(table)
    assert len(seen) == calls
