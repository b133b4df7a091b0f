"""Operators that learn: toxicity, the language model, and the pages' decision tree."""

import math
import random
import sys
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from filewright.llm import extract, hmm, toxicity
from filewright.llm.common import id_bucket
from tests.llm.common import ODD, WORDS, documents, lower, rows

BAD = ["vile", "rotten", "nasty"]


def corpus(n, seed=1):
    rng, docs, labels = random.Random(seed), [], []
    for i in range(n):
        words = [rng.choice("the of and to in is was on by for with as at from green house river stone walk open".split()) for _ in range(rng.randint(20, 200))]
        toxic = rng.random() < 0.2
        for _ in range(rng.randint(2, 4) if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(BAD) + rng.choice(["", "ness", "ly"])
        docs.append((1000 + i, " ".join(words)))
        labels.append((1000 + i, 1, int(toxic)))
    return docs, labels


def test_toxicity_on_held_out_labels(spark):
    docs, labels = corpus(900)
    table = spark.createDataFrame([*labels, (None, 1, 1), (1, 0, None), (1, 0, 7)], "doc_id long, quality int, toxic int")
    df = documents(spark, [*docs, *ODD])
    model = toxicity.fit(df, table, toxicity.learnable())
    got = toxicity.score(df, model).collect()
    assert len(got) == len(docs) + len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    told = {i: t for i, _, t in labels if crc32(str(i).encode()) % 3 == 1}
    right = Counter((told[r.doc_id], r.predicted) for r in got if r.doc_id in told)
    assert right[1, 1] >= 0.9 * (right[1, 1] + right[1, 0]) and right[0, 1] <= 0.01 * (right[0, 0] + right[0, 1])
    passages = [(dict(docs)[r.doc_id].split(), p) for r in got for p in r.passages]
    assert passages and all(text[p.first].startswith(tuple(BAD)) and p.chance <= toxicity.CHANCE for text, p in passages)
    kept = toxicity.keep_clean(df, model)
    assert kept.columns == df.columns and kept.count() == sum(not r.predicted for r in got)


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    df = documents(spark, ODD)
    assert {r.score for r in toxicity.score(df, toxicity.fit(df, none, toxicity.learnable())).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1, 1), (5, 1, 1)], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.score(df, toxicity.fit(df, one, F.lit(True))).collect()} == {1.0}
    empty = documents(spark, [])
    assert toxicity.score(empty, toxicity.fit(empty, none, toxicity.learnable())).collect() == []


def test_segments_are_the_maximal_ones():
    rng = random.Random(9)

    def plain(scores):
        """The best segment, then the same to its left and right."""
        best = max(((sum(scores[i:j]), -(j - i), -i, i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=(0,))
        if best[0] <= 1e-9:
            return []
        _, _, _, i, j = best
        return plain(scores[:i]) + [(i, j, best[0])] + [(a + j, b + j, s) for a, b, s in plain(scores[j:])]

    for _ in range(300):
        scores = [rng.choice([-31, -13, -7, 9, 17, 23]) if rng.random() < 0.7 else None for _ in range(rng.randint(0, 14))]
        dense = [-4 if s is None else s for s in scores]
        got = toxicity.segments([(i, s) for i, s in enumerate(scores) if s is not None], 4)
        want = plain(dense)
        assert got == want


def test_language_model(spark):
    docs = [*corpus(120, 2)[0], *ODD]
    got = hmm.score(documents(spark, docs), id_bucket("doc_id", 7) != 2).collect()
    tokens = lambda t: [*WORDS.findall(lower(t)), ""]
    held = lambda i: i is None or crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, t in docs if not held(i) for w in tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    want = []
    for i, t in docs:
        own = tokens(t)
        want.append((i, held(i), len(own), sum(counts[w] > 0 for w in own), total, sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in own)))
    key = lambda r: tuple((v is None, v) for v in r[:4])
    for have, expected in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert have[:5] == expected[:5] and have[5] == pytest.approx(expected[5])
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def test_language_model_without_training(spark):
    got = hmm.score(documents(spark, ODD), F.lit(False)).collect()
    assert {(r.n_known, r.train_tokens, r.base_score) for r in got} == {(0, 0, 0.0)} and all(math.isfinite(r.score) for r in got)
    assert hmm.score(documents(spark, []), F.lit(True)).collect() == []


def test_words_are_classed_at_once():
    """Class ids equal those taken word by word, from few calls whatever the number of words."""
    rng = random.Random(4)
    texts = [None, "", " ", " a", "a  b ", *["".join(rng.choice(" \t\n\x0b\x0c\r\x1c\x85\xa0aAbZÜ😀\0") for _ in range(rng.randint(0, 40))) for _ in range(3000)]]
    tokens = [[w.encode() for w in WORDS.findall(lower(t))] for t in texts]
    own = [w for w, _ in Counter(w for t in tokens for w in t).most_common(300)][::2]
    place = {w: i + 1 for i, w in enumerate(own)}
    want = [c for t in tokens for c in [*[place.get(w) or hmm.OWN + 1 + crc32(w[-3:]) % hmm.ENDINGS for w in t], 0]]
    column, known, calls = pa.array(["x", *texts])[1:], pa.array(own, pa.binary()), Counter()
    sys.setprofile(lambda frame, event, arg: calls.update([event]))
    try:
        words, sizes = hmm.split(column)
        got = hmm.with_ends(hmm.class_ids(words, known), sizes)
    finally:
        sys.setprofile(None)
    assert words.to_pylist() == [w for t in tokens for w in t] and sizes.tolist() == [len(t) for t in tokens] and got.tolist() == want
    assert len(want) > 15_000 and calls["call"] + calls["c_call"] < 5_000
    starts, lengths, first = hmm.stretches(np.array([1, 128, 129, 300]))
    assert (starts.tolist(), lengths.tolist()) == ([0, 1, 129, 257, 258, 386, 514], [1, 128, 128, 1, 128, 128, 44])
    assert first.tolist() == [True, True, True, False, True, False, False]


def test_forward_recursion_is_exact():
    """The scaled recursion equals the sum over all paths, and training never lowers the likelihood."""
    from itertools import product

    rng = np.random.default_rng(3)
    part = lambda *shape: (x := rng.random(shape)) / x.sum(axis=-1, keepdims=True)
    k = hmm.STATES
    model = hmm.Model(part(k), part(k), part(k, k), part(k, 5).T.copy())
    ids = np.array([0, 3, 1, 4, 2, 2, 0])
    got = hmm.log_likelihoods(ids, np.array([0, 4]), np.array([4, 3]), model)
    for begin, size, have in ((0, 4, got[0]), (4, 3, got[1])):
        own = ids[begin:begin + size]
        total = sum(math.prod([model.start[p[0]] * model.emit[own[0], p[0]], *[model.move[a, b] * model.emit[o, b] for a, b, o in zip(p, p[1:], own[1:])]])
                    for p in product(range(k), repeat=size))
        assert have == pytest.approx(math.log10(total))
    long = rng.integers(0, 5, 400)
    starts, lengths = np.array([0, 100, 250]), np.array([100, 150, 150])
    before = hmm.log_likelihoods(long, starts, lengths, model).sum()
    begin, _, moves, emits = hmm.expected_counts(long, starts, lengths, np.ones(3, bool), model)
    assert begin.sum() == pytest.approx(3) and emits.sum() == pytest.approx(400) and moves.sum() == pytest.approx(397)
    better = hmm.Model(begin / begin.sum(), model.inside, moves / moves.sum(axis=1, keepdims=True), emits / emits.sum(axis=0))
    assert hmm.log_likelihoods(long, starts, lengths, better).sum() > before


def test_main_text(spark):
    run = "words of running text that go on and on until the block is long enough to count as such "
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body class="has-sidebar">
    <header><h1>Site name</h1><nav><ul><li><a href="/">Home</a></li></ul></nav></header><div class="cookie-notice"><p>{run}</p></div>
    <aside><p>{run}</p></aside><article><header><h1>Head &amp; line</h1></header><p>{run}<a href="#">with a link</a>&nbsp;here</p><p>Short.</p>
    <div class="ad">{run}</div><ul><li>first item</li><li>second item</li></ul><form><label>Mail</label><input><button>Send</button></form>
    <p>Last<br>one<section class="comments"><h2>Comments</h2><p>{run}</p></section></article><footer>&copy; 2031 {run}</footer></body></html>"""
    want = f"Head & line\n{run}with a link here\nShort.\nfirst item\nsecond item\nLast one"
    rows_ = [(1, "u", page), (1, "u", page), (2, None, None), (3, "v", ""), (4, "w", "<p"), (5, "x", "<script>" + "a" * 10000), (None, "y", f"<div><p>{run}</p></div>")]
    df = spark.createDataFrame([(*r, "x") for r in rows_], "page_id long, url string, html string, text string")
    got = extract.extract(df).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == sorted(
        [(1, want, len(want)), (1, want, len(want)), (2, "", 0), (3, "", 0), (4, "", 0), (5, "", 0), (0, run.strip(), len(run.strip()))])
    assert extract.extract(df.limit(0)).collect() == []


def test_menus_without_tags_that_say_so():
    run = "plain running text of a page without any article element around it, " * 4
    page = f"<div><a>One</a> <a>Two</a></div><div><a>Three</a></div><h2>Title</h2><p>{run}</p><p>short one</p><p>{run}</p><div><a>Next</a> <a>More</a></div>"
    assert extract.main_text(page, extract.train()).split("\n") == ["Title", run.strip(), "short one", run.strip()]


def test_names_that_only_hold_a_word_are_weighed():
    run = "words of running text that go on and on until the block is long enough to count as such"
    inside = lambda part: extract.main_text(f"<article><h1>Head</h1><p>{run}</p>{part}<p>{run}</p></article>", extract.train()).split("\n")[2:-1]
    assert inside(f'<h2 id="related-work">Related work</h2><p id="notice">{run}</p>') == ["Related work", run]
    assert inside(f'<section id="search-methods"><h2>Search methods</h2><p>{run}</p></section>') == ["Search methods", run]
    assert inside(f'<section id="search"><h2>Search</h2><p>{run}</p></section>') == ["Search", run]
    assert inside(f'<div class="side-by-side"><div>left</div><div>{run}</div></div>') == ["left", run]
    assert inside('<div class="side-notes"><ul><li>first item</li><li>second item</li></ul></div>') == ["first item", "second item"]
    assert inside(f'<div class="ad is-visible">{run}</div><div class="has-icon comments"><p>{run}</p></div>') == []
    links = '<li><a href="/a">one more page</a></li>' * 3
    assert inside(f'<div class="related-posts"><h3>Related</h3><ul>{links}</ul></div>') == []
    assert inside(f'<aside><div class="side-by-side"><p>{run} {run}</p><p>short</p></div></aside>') == []
    page = f'<div class="site-footer">Some company, all rights reserved</div><article class="post comments-open"><p>{run}</p></article>'
    assert extract.main_text(page, extract.train()) == run
    plain = f'<div class="site-top">Five words of a notice</div><p>{run} {run}</p><div class="main-footer-bar">Some company, all rights reserved</div>'
    assert extract.main_text(plain, extract.train()) == f"{run} {run}"
