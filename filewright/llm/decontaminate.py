"""Benchmark decontamination by suffix arrays of the training words.

Each task builds suffix arrays over the words of its documents, a batch at a time. Only suffixes that begin a run of
benchmark words as long as the shortest window can match, so only those are sorted, by their first ``WINDOW`` words.
Every benchmark suffix is then looked for by binary search; the range it finds holds all places where it occurs
verbatim, and matches that continue are followed to their full length.

A benchmark beyond ``CHUNK_WORDS`` goes to the tasks in chunks, one after the other: what a chunk finds is written to the
shared folder before the one after the next is read, and merged at the end. Words are lower-cased runs of letters and digits and non-ASCII characters. An item of fewer words than a window is
one window; an item without words is none. NULL texts have no words, NULL item ids count as the empty string, items that
share an id count once, NULL document ids are kept, and repeated documents give repeated results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filewright.llm.common import map_texts
from filewright.session import cut_lineage

WINDOW = 13
CHUNK_WORDS = 1_000_000  # of the benchmark sent to the tasks at once: about 100 MB
# Bytes of word characters with A-Z in small letters; all other bytes become spaces.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORDS).split()


def sort_keys(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, window: int) -> np.ndarray:
    """Byte strings that sort as the first ``window`` words from each start, cut to the given lengths."""
    padded = np.concatenate([ids, np.zeros(window, ids.dtype)])
    rows = padded[starts[:, None] + np.arange(window)]
    rows[np.arange(window) >= lengths[:, None]] = 0
    return np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * window}").ravel()


class Benchmark:
    """Suffixes of a chunk of benchmark items, numbered by their words."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        self.window = window
        self.names = sorted({name for name, _ in items})
        at = {name: i for i, name in enumerate(self.names)}
        self.vocabulary: dict[bytes, int] = {}
        ids, starts, lengths, owners, base = [], [], [], [], 0
        for name, words in items:
            own = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            n = max(1, len(own) - window + 1)
            starts.extend(range(base, base + n))
            lengths.extend([min(window, len(own))] * n)
            owners.extend([at[name]] * n)
            ids += [*own, 0]
            base += len(own) + 1
        self.ids = np.array(ids, np.int64)
        starts, lengths = np.array(starts, np.int64), np.array(lengths, np.int64)
        keys = sort_keys(self.ids, starts, lengths, window)
        self.keys, number = np.unique(keys, return_inverse=True)
        self.lengths = np.zeros(len(self.keys), np.int64)
        self.lengths[number] = lengths
        order = np.argsort(number, kind="stable")
        self.places = starts[order]  # benchmark places of each distinct suffix, by first_place
        self.owners = np.array(owners, np.int64)[order]
        self.first_place = np.searchsorted(number[order], np.arange(len(self.keys) + 1))
        self.shortest = int(lengths.min())
        # The upper end of a range: the same words followed by the largest that there may be.
        rows = self.keys.view("u1").reshape(len(self.keys), 4 * window).copy()
        rows[np.arange(4 * window) >= 4 * self.lengths[:, None]] = 255
        self.uppers = rows.view(f"S{4 * window}").ravel()


def follow(ids: np.ndarray, at: int, bench: np.ndarray, places: np.ndarray) -> tuple[int, int]:
    """Length of the longest verbatim match that starts at ``at``, over the places of the benchmark, and its number."""
    best, which = 0, 0
    for k, place in enumerate(places.tolist()):
        n, step = 0, 64
        while True:
            a, b = ids[at + n:at + n + step], bench[place + n:place + n + step]
            m = min(len(a), len(b))
            same = (a[:m] == b[:m]) & (a[:m] > 0)
            if m < step or not same.all():
                n += int(m if same.all() else same.argmin())
                break
            n += step
        if n > best:
            best, which = n, k
    return best, which


def matches(texts: list[str | None], bench: Benchmark) -> list[tuple[int, list[tuple[int, int]], list[int], tuple[int, int, int]]]:
    """Of each text: its number of words, the runs of hit words, the numbers of the items found, and the longest match
    as (word, length, item)."""
    get, ids, ends = bench.vocabulary.get, [], []
    for text in texts:
        ids += [get(w, 0) for w in words_of(text)]
        ids.append(0)
        ends.append(len(ids))
    ids, ends = np.array(ids, np.int64), np.array(ends, np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    counts = (ends - starts - 1).tolist()
    zero = np.flatnonzero(ids == 0)
    ahead = zero[np.searchsorted(zero, np.arange(len(ids)))] - np.arange(len(ids))  # words of the benchmark from here on
    begins = np.flatnonzero(ahead >= bench.shortest)
    found = [(n, [], [], (0, 0, -1)) for n in counts]
    if not len(begins):
        return found
    keys = sort_keys(ids, begins, ahead[begins], bench.window)
    order = np.argsort(keys, kind="stable")
    suffixes = keys[order]
    low = np.searchsorted(suffixes, bench.keys, "left")
    high = np.searchsorted(suffixes, bench.uppers, "right")
    hit = np.flatnonzero(high > low)
    if not len(hit):
        return found
    repeats = high[hit] - low[hit]
    which = np.repeat(hit, repeats)
    rank = np.arange(repeats.sum()) - np.repeat(np.cumsum(repeats) - repeats, repeats) + np.repeat(low[hit], repeats)
    places = begins[order[rank]]
    change = np.zeros(len(ids) + 1, np.int64)
    np.add.at(change, places, 1)
    np.add.at(change, places + bench.lengths[which], -1)
    covered = np.cumsum(change)[:-1] > 0
    edge = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
    firsts, lasts = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    at = np.searchsorted(ends, firsts, "right").tolist()
    by_place = np.argsort(places, kind="stable")
    head = by_place[np.searchsorted(places[by_place], firsts)]  # a suffix found where each run begins
    for doc, first, last, w in zip(at, firsts.tolist(), lasts.tolist(), which[head].tolist()):
        base = int(starts[doc])
        found[doc][1].append((first - base, last - base))
        own = slice(bench.first_place[w], bench.first_place[w + 1])
        n, k = follow(ids, first, bench.ids, bench.places[own])
        if n > found[doc][3][1]:
            found[doc] = (*found[doc][:3], (first - base, n, int(bench.owners[own][k])))
    pairs = np.unique(np.searchsorted(ends, places, "right") * len(bench.keys) + which)
    for doc, w in zip((pairs // len(bench.keys)).tolist(), (pairs % len(bench.keys)).tolist()):
        found[doc][2].extend(bench.owners[bench.first_place[w]:bench.first_place[w + 1]].tolist())
    return found


def chunks(benchmark: DataFrame, window: int, words: int) -> Iterator[Benchmark]:
    """The benchmark in parts of about ``words`` words, read one after the other."""
    part, size = [], 0
    for row in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").toLocalIterator():
        if own := words_of(row.text):
            part.append((row.item_id, own))
            size += len(own)
        if size >= words:
            yield Benchmark(part, window)
            part, size = [], 0
    if part:
        yield Benchmark(part, window)


FOUND = "n_words long, hits array<struct<first:long,last:long>>, items array<string>, longest struct<n:long,first:long,item:string>"


def _found(docs: DataFrame, bench) -> DataFrame:
    """``docs`` (doc_id, text) with what one chunk finds in place of the text."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            own = bench.value
            rows = matches(batch.column(1).to_pylist(), own)
            kinds = [pa.int64(), pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])), pa.list_(pa.string()),
                     pa.struct([("n", pa.int64()), ("first", pa.int64()), ("item", pa.string())])]
            columns = [
                [r[0] for r in rows], [[{"first": a, "last": b} for a, b in r[1]] for r in rows],
                [[own.names[i] for i in sorted(set(r[2]))] for r in rows],
                [{"n": r[3][1], "first": r[3][0], "item": own.names[r[3][2]]} if r[3][1] else None for r in rows]]
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([hashlib.md5((t or "").encode()).hexdigest() for t in batch.column(1).to_pylist()], pa.string()) if own.many else pa.nulls(len(rows), pa.string()),
                 *map(pa.array, columns, kinds)], ["doc_id", "text_key", "n_words", "hits", "items", "longest"])

        return work

    return map_texts(docs, "text", f"doc_id {id_type}, text_key string, {FOUND}", make)


def _frames(docs: DataFrame, benchmark: DataFrame, window: int, chunk_words: int) -> list[DataFrame]:
    """What each chunk finds. With several, each is done with, and its broadcast released, before the one after the next is read."""
    context, parts = docs.sparkSession.sparkContext, chunks(benchmark, window, chunk_words)
    part, later = next(parts, None) or Benchmark([("", [b""])], window), next(parts, None)
    part.many = later is not None
    if not part.many:
        return [_found(docs, context.broadcast(part))]
    frames = []
    while part is not None:
        part.many = True
        shared = context.broadcast(part)
        frames.append(cut_lineage(_found(docs, shared)))
        shared.destroy()
        part = later
        later = next(parts, None)
    return frames


def _merged(frames: list[DataFrame], *keys: str) -> DataFrame:
    """Frames of several chunks as one: ``rows`` of all frames, ``hits``, ``items`` and ``longest`` per key."""
    found = frames[0]
    for frame in frames[1:]:
        found = found.unionAll(frame)
    # Equal rows of a repeated document stand once in each frame for each repeat.
    merged = found.groupBy(*keys, "text_key", "n_words").agg(
        F.count("*").alias("rows"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("runs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("longest").alias("longest"))
    joined = F.aggregate(
        "runs", F.expr("cast(array() as array<struct<first:long,last:long>>)"),
        lambda done, run: F.when(
            (F.size(done) > 0) & (run["first"] <= F.element_at(done, -1)["last"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
                F.element_at(done, -1)["first"].alias("first"), F.greatest(F.element_at(done, -1)["last"], run["last"]).alias("last")))),
        ).otherwise(F.concat(done, F.array(run))))
    return merged.withColumn("hits", joined)


def _hit_words() -> Column:
    return F.aggregate("hits", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"])


def _contaminated(n_hit: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= F.col("n_words"))


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """One row per document: ``doc_id n_words n_hit n_items items_sha256 contaminated items hits longest``.

    ``hits`` are runs of hit words (end exclusive), ``longest`` is the longest verbatim match that begins such a run.
    """
    frames = _frames(docs.select("doc_id", "text"), benchmark, window, chunk_words)
    found = frames[0]
    if len(frames) > 1:
        found = _merged(frames, "doc_id").withColumn("copy", F.explode(F.sequence(F.lit(1), F.floor(F.col("rows") / len(frames)))))
    n_hit = _hit_words()
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), "items", "hits", "longest").select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        _contaminated(F.col("n_hit")).alias("contaminated"), "items", "hits", "longest")


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """``docs`` without contaminated documents; the judgement is made beside each row, without a join, where one chunk holds the benchmark."""
    parts = chunks(benchmark, window, chunk_words)
    part = next(parts, None)
    if part is None:
        return docs
    if next(parts, None) is not None:
        del part, parts
        # The verdict follows from the text alone.
        frames = _frames(docs.select("doc_id", "text"), benchmark, window, chunk_words)
        bad = _merged(frames).where(_contaminated(_hit_words())).select("text_key")
        return docs.join(bad, F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary")) == bad["text_key"], "left_anti")
    part.many = False
    shared = docs.sparkSession.sparkContext.broadcast(part)
    at = docs.columns.index("text")

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(at).to_pylist()
            found = [(n, sum(b - a for a, b in runs)) for n, runs, _, _ in matches(texts, shared.value)]
            return batch.filter(pa.array([not (h and 20 * h >= n) for n, h in found], pa.bool_()))

        return work

    return map_texts(docs, "text", docs.schema, make)
