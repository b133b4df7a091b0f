"""Passages that repeat across documents, by FM-indexes over shards.

Every window of ``WINDOW`` words belongs to the shard of its smallest hash over ``GRAM`` words, so all places of one window
meet in one shard. Neighbouring windows with the same smallest hash form a segment, which travels as one; equal
segments travel once, with the smallest id that holds them. A shard indexes its segments (suffix array, BWT, wavelet
matrix) and streams them through backward search, which gives for each window the smallest id of a document that holds
it. Words of a document that a window from a smaller id covers are removed.

Where very many different segments meet in one hash, as around a passage that a large share of all documents holds,
they are dealt out anew window by window, by a hash over the whole window; every window that stands once then drops out.

Words are runs without ASCII white space, compared as hashes of 64 bits. NULL texts have no words. A row with a NULL id is
kept whole and never the reason for a removal. Rows that repeat an id are rows of their own, and none of them is a smaller one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filewright.llm.common import map_texts
from filewright.llm.fmindex import Index
from filewright.session import cut_lineage

WINDOW = 50
GRAM = 8
CROWD = 20_000  # different segments of one hash, beyond which they are dealt out by windows
SHARD_WORDS = 1_000_000  # of segments indexed at once, where segments of one hash allow
NUMBERS = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)


def gram_hashes(words: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """A hash of each run of ``size`` words."""
    n = len(words) - size + 1
    total = np.zeros(max(0, n), np.uint64)
    for k in range(size):
        total += mixed(words[k:k + n] + np.uint64(salt)) * NUMBERS[k]
    return mixed(total)


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each run of ``width`` values: doubling, then two overlapping runs."""
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def segments(words: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, windows) of the runs of windows with one smallest hash."""
    if len(words) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = window_minima(gram_hashes(words, gram), window - gram + 1)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    return least[first], first, np.diff(np.append(first, len(least)))


def digests(words: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of the content of each stretch of words."""
    data = words.tobytes()
    return np.array([xxhash.xxh3_64_intdigest(data[8 * a:8 * (a + n)]) for a, n in zip(first.tolist(), sizes.tolist())], np.uint64)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


PLACED = "doc_id long, text_key long, h long, c long, first int, windows int"


def place_segments(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """Segments of every document: hash, content and place."""

    def make():
        seen = WordHashes()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, parts = [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                words = np.array([seen[w] for w in words_of(text)], np.uint64)
                h, first, windows = segments(words, window, gram)
                if len(h):
                    rows.append(np.full(len(h), i))
                    parts.append((h, digests(words, first, windows + window - 1), first, windows))
            row = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))
            h, c, first, windows = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.uint64 if k < 2 else np.int64) for k in range(4))
            return pa.RecordBatch.from_arrays(
                [batch.column(0).take(row), batch.column(1).take(row), _signed(h), _signed(c), pa.array(first, pa.int32()), pa.array(windows, pa.int32())],
                ["doc_id", "text_key", "h", "c", "first", "windows"])

        return work

    return map_texts(docs, "text", PLACED, make)


def shared_segments(placed: DataFrame) -> DataFrame:
    """The placed segments whose hash stands in several documents; all others hold no repeated window."""
    shared = placed.groupBy("h").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    return cut_lineage(placed.join(shared.select("h"), "h", "left_semi"))


def distinct_segments(placed: DataFrame) -> DataFrame:
    """Different segments, with the smallest id and a place that holds them."""
    distinct = placed.groupBy("h", "c").agg(F.min(F.struct("doc_id", "text_key", "first", "windows")).alias("at"))
    return distinct.select("h", "c", "at.*")


def contents(docs: DataFrame, places: DataFrame, window: int) -> DataFrame:
    """(h, c, doc_id, words) of the placed segments, cut out of their texts."""
    wanted = places.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("first", "windows", "h", "c")).alias("own"))
    joined = docs.join(wanted, ["doc_id", "text_key"]).select("doc_id", "own", "text")

    def make():
        seen = WordHashes()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            doc, h, c, words = [], [], [], []
            for doc_id, own, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                hashed = np.array([seen[w] for w in words_of(text)], np.uint64)
                data = hashed.tobytes()
                for s in own:
                    doc.append(doc_id)
                    h.append(s["h"])
                    c.append(s["c"])
                    words.append(data[8 * s["first"]:8 * (s["first"] + s["windows"] + window - 1)])
            return pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(h, pa.int64()), pa.array(c, pa.int64()), pa.array(words, pa.binary())], ["doc_id", "h", "c", "words"])

        return work

    return map_texts(joined, "text", "doc_id long, h long, c long, words binary", make)


def split_windows(docs: DataFrame, places: DataFrame, window: int) -> DataFrame:
    """The placed segments dealt out as single windows, each hashed as a whole."""
    wanted = places.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("first", "windows")).alias("own"))
    joined = docs.join(wanted, ["doc_id", "text_key"]).select("doc_id", "text_key", "own", "text")

    def make():
        seen = WordHashes()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, h, c, first = [], [], [], []
            for i, (own, text) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                hashed = np.array([seen[w] for w in words_of(text)], np.uint64)
                for s in own:
                    part = hashed[s["first"]:s["first"] + s["windows"] + window - 1]
                    rows.append(np.full(s["windows"], i))
                    h.append(gram_hashes(part, window, 1))
                    c.append(gram_hashes(part, window, 2))
                    first.append(np.arange(s["first"], s["first"] + s["windows"]))
            row = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))
            join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
            return pa.RecordBatch.from_arrays(
                [batch.column(0).take(row), batch.column(1).take(row), _signed(join(h, np.uint64)), _signed(join(c, np.uint64)),
                 pa.array(join(first, np.int64), pa.int32()), pa.array(np.ones(len(row), np.int32))], ["doc_id", "text_key", "h", "c", "first", "windows"])

        return work

    return map_texts(joined, "text", PLACED, make)


def search(found: DataFrame, window: int) -> DataFrame:
    """(h, c, least): for each window of a segment the smallest id that holds it, from the index of its shard."""
    sharded = found.repartition("h").sortWithinPartitions("h", "c", "doc_id")

    def run(batches):
        def flush(h, c, doc, words):
            if not len(h):
                return
            _, number = np.unique(np.concatenate([np.frombuffer(w, np.uint64) for w in words]), return_inverse=True)
            symbols = number.astype(np.int64) + 1
            lengths = np.array([len(w) // 8 for w in words], np.int64)
            starts = np.cumsum(lengths) - lengths
            index = Index(symbols, starts, lengths, np.array(doc, np.int64), window)
            least = index.least_numbers(symbols, starts, lengths)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h, pa.int64()), pa.array(c, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in least])]), pa.int32()), pa.array(np.concatenate(least), pa.int64()))],
                ["h", "c", "least"])

        rows: list[list] = [[], [], [], []]
        size = 0
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in ("h", "c", "doc_id", "words")]
            for h, c, doc, words in zip(*columns):
                if rows[0] and rows[0][-1] == h and rows[1][-1] == c:
                    continue  # a repeated row of one document
                if size >= SHARD_WORDS and rows[0][-1] != h:
                    yield from flush(*rows)
                    rows, size = [[], [], [], []], 0
                for held, value in zip(rows, (h, c, doc, words)):
                    held.append(value)
                size += len(words) // 8
        yield from flush(*rows)

    return sharded.mapInArrow(run, "h long, c long, least array<long>")


def covered(placed: DataFrame, found: DataFrame, window: int) -> DataFrame:
    """(doc_id, text_key, first, last): words that windows from smaller ids cover, end exclusive."""
    joined = placed.join(found, ["h", "c"]).select("doc_id", "text_key", "first", "least")

    def run(batches):
        for batch in batches:
            least = batch.column(3)
            sizes = np.diff(least.offsets.to_numpy())
            values = least.flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), sizes)
            smaller = values < batch.column(0).to_numpy()[row]
            new = np.ones(len(values), bool)
            new[1:] = (row[1:] != row[:-1]) | (smaller[1:] != smaller[:-1])
            head = np.flatnonzero(new)
            size = np.diff(np.append(head, len(values)))
            head, size = head[smaller[head]], size[smaller[head]]
            offset = np.cumsum(sizes) - sizes
            first = batch.column(2).to_numpy()[row[head]] + head - offset[row[head]]
            take = pa.array(row[head])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(first, pa.int32()), pa.array(first + size + window - 1, pa.int32())],
                ["doc_id", "text_key", "first", "last"])

    return joined.mapInArrow(run, "doc_id long, text_key long, first int, last int")


def repeated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """(doc_id, text_key, first, last): repeated stretches of words in the rows of ``keyed(docs)``."""
    known = keyed(docs).where(F.col("doc_id").isNotNull())
    placed = shared_segments(cut_lineage(place_segments(known, window, gram)))
    distinct = cut_lineage(distinct_segments(placed))
    crowded = cut_lineage(distinct.groupBy("h").count().where(F.col("count") > crowd).select("h"))
    found = contents(known, distinct.join(crowded, "h", "left_anti"), window)
    if crowded.isEmpty():
        return covered(placed, search(found, window), window)
    windows = shared_segments(cut_lineage(split_windows(known, placed.join(crowded, "h", "left_semi"), window)))
    found = found.unionAll(contents(known, distinct_segments(windows), window))
    return covered(placed.unionAll(windows), search(found, window), window)


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")


def _apply(rows: DataFrame, ranges: DataFrame, make_rows, schema: str, text: str) -> DataFrame:
    own = ranges.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("first", "last")).alias("ranges"))
    return map_texts(rows.join(own, ["doc_id", "text_key"], "left"), text, schema, make_rows)


def remove(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """One row per row of ``docs``: ``doc_id n_words n_removed kept_sha256``."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[list] = [[], [], []]
            for text, ranges in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                words = words_of(text)
                keep = np.ones(len(words), bool)
                for r in ranges or ():
                    keep[r["first"]:r["last"]] = False
                kept = words if keep.all() else [w for w, k in zip(words, keep.tolist()) if k]
                for held, value in zip(out, (len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())):
                    held.append(value)
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256"])

        return work

    return _apply(keyed(docs), repeated(docs, window, gram, crowd), make, "doc_id long, n_words long, n_removed long, kept_sha256 string", "text")
