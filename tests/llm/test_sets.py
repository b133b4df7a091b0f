"""Top-k search, perspectives, and the pipeline."""

import math

import numpy as np
import pytest

import corpus_pipeline
from checks.compare import connect, normalised
from filewright.llm import perspectives, topk
from filewright.llm.queries import ORACLES, QUERIES
from tests.conftest import DATA
from tests.llm.common import ODD, documents


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, name):
    df, rel = QUERIES[name](spark, DATA), connect(DATA).execute(ORACLES[name])
    columns = [c[0] for c in rel.description]
    assert normalised(df.columns, df.collect()) == normalised(columns, rel.fetchall()) and sorted(columns) == sorted(df.columns)


def test_search_with_ties_and_unusable_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 150)
    monkeypatch.setattr(topk, "BLOCK", 8)
    rng = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in rng.integers(-3, 4, 6) / 16]) for i in range(600)]
    odd = [(700, None), (701, [0.1, None, 0.2, 0.1, 0.1, 0.1]), (702, [math.nan] * 6), (703, [math.inf] * 6), (704, []), (None, [0.1] * 6), (5, [0.25] * 6)]
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in [*vectors, *odd]], "vec_id long, embedding array<float>, label int, shard int")
    got = sorted(map(tuple, topk.top_k(df, df.vec_id % 20 == 0, 7).collect()))
    used = [(i, [math.floor(64 * x) for x in v]) for i, v in [*vectors, odd[-1]]]
    want = []
    for q, x in used:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in used if i != q)[:7]
            want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert got == sorted(want)
    assert topk.top_k(df.limit(0), df.vec_id % 20 == 0, 7).collect() == []


@pytest.mark.parametrize("largest", [2.0 ** 24, 2.0 ** 26, 2.0 ** 50])
def test_search_with_large_components(spark, largest):
    rng = np.random.default_rng(2)
    vectors = [(i, [float(x) for x in rng.integers(-3, 4, 4) / 16]) for i in range(1, 200)]
    # The two large ones meet in a score only where it fits.
    vectors += [(0, [largest, 0.5, -0.25, 0.0]), (500, [0.0, largest, 0.25, 0.5] if abs(largest) < 2.0 ** 50 else [0.0, 0.25, 0.5, 0.25])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, topk.top_k(df, df.vec_id % 20 == 0, 7).collect()))
    used = [(i, [math.floor(64 * x) for x in v]) for i, v in vectors]
    want = []
    for q, x in used:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in used if i != q)[:7]
            want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert got == sorted(want)


def test_search_says_what_does_not_fit(spark):
    def found(*large):
        df = spark.createDataFrame([(i, [x, 0.5]) for i, x in enumerate(large)], "vec_id long, embedding array<float>")
        return topk.top_k(df, df.vec_id % 20 == 0, 7).collect()

    with pytest.raises(Exception, match="a component times 64 does not fit a long"):
        found(2.0 ** 57, 0.25)
    with pytest.raises(Exception, match="a score does not fit a long"):
        found(2.0 ** 40, 2.0 ** 40)


def test_perspectives(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, "ann", "é😀"), (2, 0, None, "x"), (None, 0, "ann", "x"), (3, None, "ann", "x"),
             (4, 0, "system", "alone"), (5, 0, "ann", "same"), (5, 0, "ann", "same")]
    df = spark.createDataFrame([(*t, 0) for t in turns], "conv_id long, turn int, role string, text string, start long")
    out = perspectives.rotate(df).collect()
    views = {}
    for r in sorted(out, key=lambda r: (r.conv_id, r.perspective, r.turn, r.start)):
        text = views.setdefault((r.conv_id, r.perspective), "")
        assert r.start == len(text) and r.end == r.start + len(r.segment)
        views[r.conv_id, r.perspective] = text + r.segment
        assert r.mask == int(r.role == r.perspective) and r.segment[r.content_start - r.start - 2] == ">"
    assert sorted(views) == [(1, "ann"), (1, "bob"), (2, "unknown"), (5, "ann")]
    assert views[1, "ann"] == "<|system|>\nbe kind<|end|>\n<|assistant|>\nhi<|end|>\n<|user name=bob|>\n<|end|>\n<|assistant|>\né😀<|end|>\n"
    assert perspectives.rotate(df.limit(0)).collect() == []


def test_pipeline(spark, tmp_path):
    from filewright.llm import decontaminate, pii, simhash, toxicity

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    left = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        if name == "toxicity":
            labels = spark.read.parquet(f"{DATA}/labels.parquet")
            judged = toxicity.score(docs, toxicity.fit(docs, labels, toxicity.learnable())).collect()
            left = {i: t for i, t in left.items() if i not in {r.doc_id for r in judged if r.predicted}}
        elif name == "near_duplicates":
            left = {i: left[i] for i in {r.component_id for r in simhash.near_duplicates(docs).collect()}}
        elif name == "decontamination":
            bad = decontaminate.find(docs, spark.read.parquet(f"{DATA}/benchmark.parquet")).where("contaminated").collect()
            left = {i: t for i, t in left.items() if i not in {r.doc_id for r in bad}}
        else:
            automaton = pii.anchors()
            left = {i: pii.masked(t, pii.find_spans(t, automaton)) for i, t in left.items()}
        docs = spark.read.parquet(str(tmp_path / name))
        assert {r.doc_id: r.text for r in docs.collect()} == left, name
    done = corpus_pipeline.run(spark, DATA).collect()
    assert {r.doc_id for r in done} == set(left) and all(r.lossless for r in done)


def test_pipeline_takes_odd_documents(spark):
    docs = documents(spark, ODD)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    assert len(docs.collect()) == 6  # the repeat, and all but one of the three texts without words, are gone
    empty = documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, DATA)
    assert empty.collect() == []


def test_documents_keep_columns_of_any_name(spark):
    from filewright.llm import simhash

    names = ["_turn", "_text_key", "_doc_id", "turn", "key", "id", "doc", "whole", "root", "fp", "row"]
    df = spark.createDataFrame([(1, "one two three four five", *range(11)), (2, "one two three four five", *range(11)), (3, "other words", *range(11))],
                               "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]
