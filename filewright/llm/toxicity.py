"""Toxic passages by maximum-scoring segments.

Words, and beginnings of words, get log-odds between toxic and other documents under a Dirichlet prior that follows their
overall frequencies; each counts once a document, so that a text that repeats itself weighs no more than others. A word
scores as itself, or as its longest beginning, whose log-odds are unlikely to be chance, less a margin that keeps
the scores of ordinary text negative; all other words get a small negative score. One linear scan finds all maximal
scoring segments of a text. Scores of segments under ordinary text follow an extreme-value law, which gives each segment
the number of such segments expected by chance; a logistic curve turns the evidence of a document's best
segment into a score from 0 to 1. All significant segments are reported.

The model is fitted on about ``SAMPLE`` labelled rows, chosen by a hash of their ids. Labels that are NULL or neither
0 nor 1 are left out; of repeated labels the larger counts. NULL or empty texts hold no segment and are scored as such.
Without labels of both kinds every document gets the share of toxic labels (0.5 if there is none). Repeated rows give
repeated results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filewright.llm.common import id_bucket, map_texts
from filewright.llm.decontaminate import words_of

SAMPLE = 20_000
WORDS_KEPT = 50_000
BEGINNINGS = (6, 5, 4)  # bytes
PRIOR = 100.0  # weight of the prior in documents
Z = 2.5
MARGIN = 1.5
DRIFT = 0.05  # what a word without evidence costs a segment
CHANCE = 0.05  # segments expected by chance, below which one is significant
THRESHOLD = 0.7


@dataclass
class Model:
    words: dict[bytes, float]
    lam: float
    log_k: float
    weights: tuple[float, float, float]
    share: float  # of toxic labels; the score where nothing could be learnt

    def score(self, features: tuple[float, float]) -> float:
        if not self.words:
            return self.share
        a, b, c = self.weights
        return float(1 / (1 + np.exp(-np.clip(a + b * features[0] + c * features[1], -30, 30))))


def segments(scores: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, end, score) by the one-pass method of Ruzzo and Tompa.

    ``scores`` are (place, score) of the words that have one, in order; every other word scores ``-drift``.
    """
    open_: list[list] = []  # first, end, sum before, sum after
    total, last = 0.0, 0
    for place, s in scores:
        total -= drift * (place - last)
        last = place + 1
        if s <= 0:
            total += s
            continue
        new = [place, place + 1, total, total + s]
        total += s
        while True:
            # The nearest earlier candidate that starts lower; what it passes over can never be joined again.
            j = len(open_) - 1
            while j >= 0 and open_[j][2] >= new[2]:
                j = open_[j][4]
            if j < 0 or open_[j][3] >= new[3]:
                open_.append([*new, j])
                break
            new = [open_[j][0], new[1], open_[j][2], new[3]]
            del open_[j:]
    return [(first, end, after - before) for first, end, before, after, _ in open_]


class Scores(dict):
    """Scores of words by the model; None where there is none. Remembers a bounded number of words."""

    def __init__(self, words: dict[bytes, float]) -> None:
        super().__init__()
        self.words = words

    def __missing__(self, word: bytes) -> float | None:
        if len(self) >= 300_000:
            self.clear()
        found = self[word] = next((s for form in forms(word) if (s := self.words.get(form)) is not None), None)
        return found


def forms(word: bytes) -> list[bytes]:
    """A word and its beginnings, longest first; beginnings are marked by a star, which no word holds."""
    return [word, *[word[:n] + b"*" for n in BEGINNINGS if len(word) > n]]


def scan(text: str | None, scores: Scores, drift: float) -> tuple[int, list[tuple[int, int, float]]]:
    tokens = words_of(text)
    return len(tokens), segments([(i, s) for i, s in enumerate(map(scores.__getitem__, tokens)) if s is not None], drift)


def evidence(n: int, found: list[tuple[int, int, float]], lam: float, log_k: float) -> tuple[float, float]:
    """Of the best segment: its evidence (minus the logarithm of the number expected by chance), and its score, both damped."""
    if not found:
        return 0.0, 0.0
    best = max(s for _, _, s in found)
    return float(np.log1p(max(0.0, lam * best - log_k - np.log(n)))), float(np.log1p(best))


def sampled_labels(labels: DataFrame, learn: Column, sample: int) -> DataFrame:
    """(doc_id, toxic) of about ``sample`` labelled documents for which ``learn`` holds, or of all if there are fewer.

    A hash of the id decides, so the number strays from ``sample`` by a few square roots of it at most.
    """
    usable = labels.where(learn & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    one = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    share = (1 << 30) * sample // max(1, usable.count())
    return one.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n0, n1): documents of either kind in (toxic, text) with the word or beginning, and the number of all
    documents under the empty word. Counted in each task before the shuffle, which the sample bounds."""

    def run(batches):
        counts: list[dict] = [{}, {}]
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = counts[toxic]
                own[b""] = own.get(b"", 0) + 1
                for form in {f for w in set(words_of(text)) for f in forms(w)}:
                    own[form] = own.get(form, 0) + 1
        words = sorted(counts[0].keys() | counts[1].keys())
        for i in range(0, len(words), 50_000):
            part = words[i:i + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.binary()), *[pa.array([c.get(w, 0) for w in part], pa.int64()) for c in counts]], ["word", "n0", "n1"])

    return docs.select("toxic", "text").mapInArrow(run, "word binary, n0 long, n1 long").groupBy("word").agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def log_odds(counts: DataFrame, kept: int) -> dict[bytes, float]:
    """Scores of the ``kept`` words and beginnings with the clearest log-odds."""
    all_ = counts.where(F.length("word") == 0).first()
    n0, n1 = (float(all_.n0), float(all_.n1)) if all_ else (0.0, 0.0)
    if not n0 or not n1:
        return {}
    prior = F.lit(PRIOR) * (F.col("n0") + F.col("n1")) / (n0 + n1)
    odds = lambda n, total: F.log((n + prior) / (total + PRIOR + 1 - n - prior))
    delta = odds(F.col("n1"), n1) - odds(F.col("n0"), n0)
    spread = F.sqrt(1 / (F.col("n1") + prior) + 1 / (F.col("n0") + prior))
    rows = (counts.where(F.length("word") > 0).select("word", delta.alias("delta"), (delta / spread).alias("z"))
            .where(F.abs("z") >= Z).orderBy(F.desc(F.abs("z")), "word").limit(kept).collect())
    return {bytes(r.word): float(r.delta) - MARGIN for r in rows}


def fit(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE, kept: int = WORDS_KEPT) -> Model:
    """Model from the texts of ``docs`` with a label; log-odds from three quarters of the sample, calibration from the rest."""
    labelled = F.broadcast(sampled_labels(labels, learn, sample))  # about ``sample`` rows of twelve bytes
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(labelled, "doc_id").select("doc_id", "toxic", "text")
    held = F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(4)) == 0
    counts = word_counts(texts.where(~held))
    words = log_odds(counts, kept)
    rows = []
    if words:
        shared = docs.sparkSession.sparkContext.broadcast(words)

        def make():
            scores = Scores(shared.value)

            def work(batch: pa.RecordBatch) -> pa.RecordBatch:
                out = []
                for text in batch.column(2).to_pylist():
                    n, found = scan(text, scores, DRIFT)
                    out.append((n, [s for _, _, s in found]))
                return pa.RecordBatch.from_arrays(
                    [batch.column(1).cast(pa.int32()), pa.array([n for n, _ in out], pa.int64()), pa.array([s for _, s in out], pa.list_(pa.float64()))],
                    ["toxic", "n", "scores"])

            return work

        rows = map_texts(texts.where(held), "text", "toxic int, n long, scores array<double>", make).collect()
    toxic = [r.toxic for r in rows]
    if len(set(toxic)) < 2:
        ones = labelled.agg(F.sum("toxic").alias("s"), F.count("*").alias("n")).first()
        return Model({}, 1.0, 0.0, (0.0, 0.0, 0.0), (ones.s or 0) / ones.n if ones.n else 0.5)
    lam, log_k = extreme_value([(r.n, max(r.scores, default=0.0)) for r in rows if not r.toxic and r.n])
    x = np.array([evidence(r.n, [(0, 0, s) for s in r.scores], lam, log_k) for r in rows])
    return Model(words, lam, log_k, logistic(x, np.array(toxic, float)), float(np.mean(toxic)))


def extreme_value(best: list[tuple[int, float]]) -> tuple[float, float]:
    """lambda and log K of the law P(best < s) = exp(-K n exp(-lambda s)) that ordinary texts of n words follow, by moments."""
    if not best:
        return 1.0, 0.0
    n, s = np.array([b[0] for b in best], float), np.array([b[1] for b in best])
    # Ordinary texts that hardly vary leave the scale of the scores themselves, which are logarithms.
    lam = float(np.pi / (s.std() * 6 ** 0.5)) if s.std() > 1e-6 else 1.0
    return lam, float(np.mean(lam * s - np.log(n)) - 0.5772156649)


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Weights of a slightly damped logistic regression, by Newton steps."""
    design = np.column_stack([np.ones(len(x)), x])
    w, damp = np.zeros(3), np.array([1e-6, 1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + np.diag(damp), design.T @ (y - p) - damp * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def _work(shared, at: int):
    model = shared.value
    scores = Scores(model.words)

    def scored(batch: pa.RecordBatch):
        for text in batch.column(at).to_pylist():
            n, found = scan(text, scores, DRIFT)
            yield model.score(evidence(n, found, model.lam, model.log_k)), n, found, model

    return scored


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: ``doc_id score predicted`` and its significant ``passages`` (words first to last, score, chance)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scored = _work(shared, 1)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores, passages = [], []
            for value, n, found, own in scored(batch):
                scores.append(value)
                passages.append([
                    {"first": a, "last": b, "score": s, "chance": e} for a, b, s in found
                    if (e := float(np.exp(min(700.0, own.log_k + np.log(n) - own.lam * s)))) <= CHANCE])
            kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64()), ("chance", pa.float64())]))
            return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(scores, pa.float64()), pa.array(passages, kind)], ["doc_id", "score", "passages"])

        return work

    schema = "doc_id long, score double, passages array<struct<first:long,last:long,score:double,chance:double>>"
    out = map_texts(docs.select(F.col("doc_id").cast("long"), "text"), "text", schema, make)
    return out.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "passages")


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents predicted toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def make():
        scored = _work(shared, at)
        return lambda batch: batch.filter(pa.array([v < threshold for v, *_ in scored(batch)], pa.bool_()))

    return map_texts(docs, "text", docs.schema, make)


def learnable(column: str = "doc_id", folds: int = 3, held_out: int = 1) -> Column:
    """Whether labels of this row may be learnt from."""
    return id_bucket(column, folds) != held_out
