"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints that differ in at most ``RADIUS`` bits are linked; documents that links connect share a component.

Distinct fingerprints are routed so that every link meets in some group: of ``BLOCKS`` blocks of bits a link leaves at
least ``BLOCKS - RADIUS`` equal, so each fingerprint goes once to every choice of that many blocks. Within a task the
fingerprints, sorted by group, are stored as 64 vertical bit planes. The planes are compared with themselves shifted by
1, 2, 3 ... places: 64 pairs at once, distances kept in carry-save counters of a few bits, and words of 64 pairs left as
soon as every pair in them exceeds the radius. Pairs already known to be connected are not compared again, and only links
that connect something new leave the task, so a group of any number of copies gives fewer links than it has members.

Components follow from the links by hooking to the smallest neighbour until nothing changes, as joins over written tables.

Texts are lower-cased in A-Z; words are runs without ASCII white space; NULL texts have none, and texts without words get
fingerprint zero. Component ids are the smallest id, NULL ids last. Rows that repeat an id are rows of their own.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filewright.llm.common import LOWER, map_texts
from filewright.session import cut_lineage

RADIUS = 4
SHINGLE = 4
SEED = 42
BLOCKS = 6  # 15 routings by keys of 20 to 22 bits; a block more for about every 2**7 times the documents
PIECE = 1 << 16  # fingerprints compared at once, where groups allow
LANES = 1 << 15  # words of 64 pairs handled at once


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits, each set if over half of the shingle hashes have it set; zero without words."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts[:len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist())], np.uint64)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        counts += np.unpackbits(hashes[i:i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key, fp): a hash of the text, and the fingerprint as a signed number of 64 bits."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = np.array([fingerprint(t, shingle) for t in batch.column(2).to_pylist()], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], ["doc_id", "text_key", "fp"])

        return work

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return map_texts(rows, "text", "doc_id long, text_key long, fp long", make)


def route_masks(blocks: int, radius: int) -> list[int]:
    """One mask for each choice of blocks that a link leaves equal."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(parts, blocks - radius)]


class Forest:
    """Disjoint sets over 0 .. n-1, joined by arrays of pairs."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Join each pair; the result says which pairs connected something new."""
        new = np.zeros(len(a), bool)
        left = np.arange(len(a))
        while len(left):
            ra, rb = self.root[a[left]], self.root[b[left]]
            left = left[apart := ra != rb]
            low, high = np.minimum(ra, rb)[apart], np.maximum(ra, rb)[apart]
            if not len(left):
                break
            hooked, first = np.unique(high, return_index=True)  # each root hooks once a round
            self.root[hooked] = low[first]
            new[left[first]] = True
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up
        return new


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """(64, words) planes: bit i of plane b is bit b of fingerprint i; two words of zeros follow."""
    n = len(fps)
    bits = np.unpackbits(fps.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").T
    padded = np.zeros((64, (n + 63) // 64 * 64 + 128), np.uint8)
    padded[:, :n] = bits
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def shifted(words: np.ndarray, at: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Words of 64 bits that begin ``bits`` (0 to 63) after word ``at``."""
    high = np.where(bits > 0, words[at + 1] << ((64 - bits) & 63).astype(np.uint64), np.uint64(0))
    return (words[at] >> bits.astype(np.uint64)) | high


def near(planes: np.ndarray, word: np.ndarray, shift: np.ndarray, open_: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the open pairs (place, place + shift) in each word of 64 places, those within the radius: indices of words, and masks."""
    at, bits = word + shift // 64, shift % 64
    need = (radius + 1).bit_length()  # counters hold 0 to radius; what carries past is remembered as over
    counters = [np.zeros(len(word), np.uint64) for _ in range(need)]
    start = (1 << need) - (radius + 1)  # counting begins here, so that passing the radius carries out
    for k in range(need):
        if start >> k & 1:
            counters[k][:] = ~np.uint64(0)
    over, kept = ~open_, np.arange(len(word))
    for b in range(64):
        carry = planes[b][word] ^ shifted(planes[b], at, bits)
        for k in range(need):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over = over | carry
        if b % 4 == 3 and b >= 7:
            alive = over != ~np.uint64(0)
            if not alive.all():
                word, at, bits, over, kept = word[alive], at[alive], bits[alive], over[alive], kept[alive]
                counters = [c[alive] for c in counters]
                if not len(word):
                    break
    return kept, ~over


def links_within(fps: np.ndarray, ends: np.ndarray, radius: int) -> np.ndarray:
    """Pairs of places that connect fingerprints within the radius, as few as that takes.

    ``ends`` says for each place where its group ends; groups lie side by side.
    """
    n = len(fps)
    planes, forest, found = bit_planes(fps), Forest(n), []
    words = (n + 63) // 64
    reach = np.zeros(words * 64, np.int64)
    reach[:n] = ends - np.arange(n)  # shifts that stay within the group are below this
    widest = reach.reshape(words, 64).max(axis=1)
    shift, top = 1, int(widest.max())
    lanes = np.arange(64)
    while shift < top:
        # As many shifts at once as keep the arrays small; of each, the words where some pair lies in one group.
        usable = np.flatnonzero(widest > shift)
        count = max(1, min(top - shift, LANES // len(usable)))
        word = np.tile(usable, count)
        by = np.repeat(np.arange(shift, shift + count), len(usable))
        keep = widest[word] > by
        word, by = word[keep], by[keep]
        place = word[:, None] * 64 + lanes
        root = np.concatenate([forest.root, np.full(64 + top, -1)])
        pair = (reach[place] > by[:, None]) & (root[place] != root[place + by[:, None]])
        open_ = np.packbits(pair, axis=1, bitorder="little").view(np.uint64).ravel()
        some = open_ != 0
        if some.any():
            word, by, open_ = word[some], by[some], open_[some]
            which, mask = near(planes, word, by, open_, radius)
            hit = mask != 0
            which, mask = which[hit], mask[hit]
            if len(which):
                row, lane = np.nonzero(np.unpackbits(mask.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                a = word[which[row]] * 64 + lane
                b = a + by[which[row]]
                new = forest.join(a, b)
                found.append(np.column_stack([a[new], b[new]]))
                # A group that is connected throughout needs no further shift.
                starts = np.flatnonzero(np.concatenate([[True], ends[1:] != ends[:-1]]))
                low, high = np.minimum.reduceat(forest.root, starts), np.maximum.reduceat(forest.root, starts)
                done = np.repeat(low == high, np.diff(np.append(starts, n)))
                reach[:n][done] = 0
                widest = reach.reshape(words, 64).max(axis=1)
                top = int(widest.max())
        shift += count
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def links(distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Links (a, b), a < b, between the distinct fingerprints ``fp``; enough to connect all that lie within the radius."""
    masks = [m - (1 << 64) if m >= 1 << 63 else m for m in route_masks(blocks, radius)]
    # A key is the fingerprint under its mask, the mask's number spread into the hash that partitions.
    routed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("route", "part"))
    spread = routed.repartition("route", "part").sortWithinPartitions("route", "part", "fp")

    def compare(batches):
        def flush(route, part, fps):
            new = np.concatenate([[True], (route[1:] != route[:-1]) | (part[1:] != part[:-1])])
            group = np.cumsum(new) - 1
            size = np.bincount(group)
            many = size[group] > 1
            if not many.any():
                return None
            own = np.ascontiguousarray(fps[many]).view(np.uint64)
            inner = group[many]
            _, first, count = np.unique(inner, return_index=True, return_counts=True)
            pairs = links_within(own, np.repeat(first + count, count), radius)
            if not len(pairs):
                return None
            a, b = own.view(np.int64)[pairs[:, 0]], own.view(np.int64)[pairs[:, 1]]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        held: list[list[np.ndarray]] = [[], [], []]
        size = 0
        for batch in batches:
            for i, name in enumerate(("route", "part", "fp")):
                held[i].append(batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False))
            size += batch.num_rows
            if size < PIECE:
                continue
            route, part, fps = map(np.concatenate, held)
            last = np.flatnonzero((route != route[-1]) | (part != part[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last group may go on
            if cut:
                if (out := flush(route[:cut], part[:cut], fps[:cut])) is not None:
                    yield out
            held = [[route[cut:]], [part[cut:]], [fps[cut:]]]
            size = len(route) - cut
        if size:
            if (out := flush(*map(np.concatenate, held))) is not None:
                yield out

    return spread.mapInArrow(compare, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(fp, root): each fingerprint of an edge with the smallest fingerprint that links reach.

    Rounds of two steps, until one changes nothing: every vertex sends its larger neighbours to the smallest of its
    neighbours and itself, then its smaller neighbours and itself likewise.
    """
    star = cut_lineage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        large = _hook(star.select("u", "v").unionAll(star.select(F.col("v").alias("u"), F.col("u").alias("v"))), larger=True)
        small = cut_lineage(_hook(large, larger=False).where("u > v").distinct())
        same = small.join(star, ["u", "v"], "left_anti").isEmpty() and star.join(small, ["u", "v"], "left_anti").isEmpty()
        star = small
        if same:
            return star.select(F.col("u").alias("fp"), F.col("v").alias("root"))


def _hook(pairs: DataFrame, larger: bool) -> DataFrame:
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    joined = pairs.join(least, "u")
    if larger:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))


def classes(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(fp, root) of all fingerprints; those without links are their own roots."""
    distinct = cut_lineage(prints.select("fp").distinct())
    found = components(cut_lineage(links(distinct, radius, blocks)))
    return distinct.join(found, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``fingerprint`` (16 hexadecimal digits) and ``component_id``."""
    prints = cut_lineage(fingerprints(docs, shingle))
    lows = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    rooted = cut_lineage(lows.join(classes(prints, radius, blocks), "fp"))
    ids = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return prints.join(rooted.select("fp", "root").join(ids, "root").select("fp", "component_id"), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id, of rows that repeat it one of them."""
    prints = cut_lineage(fingerprints(docs, shingle))
    # NULL ids come last.
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id"), F.col("text_key"))
    best = prints.groupBy("fp").agg(F.min(row).alias("row"))
    kept = best.join(classes(prints, radius, blocks), "fp").groupBy("root").agg(F.min("row").alias("best")).select(
        F.col("best.doc_id").alias("id"), F.col("best.text_key").alias("key"))
    # The rows themselves lie in one column, so that their own columns may have any names.
    rows = docs.select(F.struct(*docs.columns).alias("whole"), docs["doc_id"].cast("long").alias("doc"), F.xxhash64(docs["text"]).alias("text_key"))
    found = rows.join(kept, F.col("doc").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")))
    turn = Window.partitionBy("key", "id").orderBy("key")
    return found.withColumn("turn", F.row_number().over(turn)).where("turn = 1").select("whole.*")
