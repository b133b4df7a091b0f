"""Similarity join of documents by the Jaccard coefficient of their word shingles, with signature trees.

Two sets of sizes a and b are linked if at least ``PERCENT`` of their union is shared; then they differ in at most
K = (100 - PERCENT)(a + b) / (100 + PERCENT) elements.

1. Documents with equal sets form one class; all below is done once for a class.
2. Candidates, without a miss: sets of similar size cut the range of hashes into the same buckets, of which linked ones have all but K
   in common, element for element. Each set keeps its K + 1 fullest non-empty buckets: of the buckets two linked sets have in
   common, the fullest is among those of both, since neither drops more than it has beyond K (a set with no more than K non-empty
   buckets also gets a key that it shares with all such sets of its size). Full buckets hardly ever agree by a common line alone. A key is a hash
   of a bucket's elements. What equal keys connect within a task is joined to its smallest class before it is shuffled, so a key sends
   one row a task, and again where equal keys of all tasks meet. Classes that keys connect form a cluster.
3. The sets of classes in clusters, and of no others, go to their cluster, dealt out in blocks of bounded size. A block
   builds a signature tree: a leaf holds a bitmap of a set's elements and its size, a node the OR of the bitmaps below and
   the range of sizes. Pairs of nodes are followed downwards from the root with itself; a pair is left when its sizes are too far
   apart, when the bits that both bitmaps share, and the elements that share a bit, are fewer than the least overlap needed, or
   when all below both is connected already. Pairs of leaves that remain are compared element by element.
4. Blocks of one cluster meet by the same rule: a tree over the blocks' own signatures yields the pairs of blocks that may hold
   links. Neighbours are compared first; of the other pairs, those go that are connected throughout by then.

Links connect what the results need and no more; components follow from them. A task that finds links gives each set they connect
with the smallest one, never in chains, which cost rounds over all links; where no cluster has several blocks, these are the
components already. Letters A-Z are lowered, words are runs without ASCII white space, fewer than ``SHINGLE`` words make one
shingle. NULL texts and texts without words have an empty set, which is linked with nothing, not even its like. Component ids are
the smallest id, NULL ids last; rows that repeat an id are rows of their
own; other columns are not looked at; an empty table gives no rows. Elements are hashes of 64 bits. Texts of any length are taken
whole: a set larger than a block is a block of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filewright.llm.common import LOWER, map_texts
from filewright.llm.simhash import Forest, components
from filewright.operators.skew import running_total
from filewright.session import cut_lineage

PERCENT = 85
SHINGLE = 4
CLASS_RATIO = 0.85  # of the smallest to the largest size of one class of sizes
SPARE_BUCKETS = 0.25  # beyond K + 1, for the emptiest to be dropped
KEYS_AT_ONCE = 1 << 18  # joined within a task
FILTER_BITS = 1 << 26  # of the filter that holds back sets without candidates: 8 MB
BLOCK_ELEMENTS = 1 << 20  # of a block of sets, 8 MB
FAN, LEAVES = 16, 64  # children of a node, of a lowest one
WORDS_AT_ONCE = 1 << 19  # of bitmaps compared at once
TREE_BITS = 1 << 27  # of a block's bitmaps, 16 MB
BLOCK_BITS = 1 << 12  # of a block's own bitmap
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit over all."""
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct shingles, ascending."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    hashes = np.fromiter(map(digest, words), np.uint64, len(words))
    if len(words) < size:
        return np.array([digest(b" ".join(words), 1)], np.uint64)
    out = np.zeros(len(words) - size + 1, np.uint64)
    for i in range(size):
        out = mix(out + hashes[i:len(out) + i] + U(i + 1))
    return np.unique(out)


def size_classes(limit: int = 1 << 44) -> np.ndarray:
    """Where classes of sizes begin."""
    edges = [1]
    while edges[-1] < limit:
        edges.append(max(edges[-1] + 1, int(edges[-1] / CLASS_RATIO)))
    return np.array(edges)


EDGES = size_classes()


def keys(elements: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Keys of which linked sets that are not equal share at least one."""
    n, out = len(elements), []
    own = int(np.searchsorted(EDGES, n, "right")) - 1 if n else len(EDGES)
    for size_class in (own, own + 1):
        # The next class too, where a larger set of it may be linked.
        if size_class + 1 >= len(EDGES) or (size_class > own and 100 * n < percent * int(EDGES[size_class])):
            continue
        differ = (100 - percent) * 2 * (int(EDGES[size_class + 1]) - 1) // (100 + percent)
        if not differ:
            continue
        buckets = differ + 3 + int(SPARE_BUCKETS * (differ + 1))
        at = (elements >> U(32)) * U(buckets) >> U(32)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        held = np.diff(np.append(first, n))
        found = mix(np.add.reduceat(mix(elements), first) ^ mix(at[first] + U(size_class << 40)))
        out.append(found[np.lexsort((found, held))[max(0, len(first) - differ - 1):]])
        if len(first) <= differ:
            out.append(mix(np.array([size_class << 40 | 1 << 39], np.uint64)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def class_of(elements: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(elements.tobytes(), 2)).astype(np.int64))


def described(docs: DataFrame, percent: int, size: int) -> DataFrame:
    """(doc_id, cls, n, keys): the class of equal sets (NULL for the empty one), its size and keys."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingles(t, size) for t in batch.column(1).to_pylist()]
            found = [keys(s, percent).view(np.int64) for s in sets]
            ends = np.cumsum([0, *map(len, found)])
            return pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([class_of(s) if len(s) else None for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *found])))], ["doc_id", "cls", "n", "keys"])

        return work

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_texts(rows, "text", "doc_id long, cls long, n long, keys array<long>", make)


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of what pairs connect: each class but the smallest ones, and the smallest class it is connected with."""
    both, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    forest = Forest(len(both))
    forest.join(at[:len(a)], at[len(a):])
    other = forest.root != np.arange(len(both))
    return both[forest.root[other]], both[other]


def joined(key: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of key and class: each key with the smallest class it is connected with, and each other class with its smallest one."""
    order = np.lexsort((cls, key))
    key, cls = key[order], cls[order]
    first = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    least = cls[first][np.cumsum(first) - 1] if len(key) else cls
    other = cls != least
    key, own = key[first], cls[first]
    a, b = stars(least[other], cls[other])
    if len(b):
        at = np.minimum(np.searchsorted(b, own), len(b) - 1)
        own = np.where(b[at] == own, a[at], own)
    return key, own, a, b


def candidates(described: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes, a < b, that connect all classes which share a key; different tasks may give the same pair."""

    def reduce(batches):
        """One row for each key, and for each pair two rows of a key of its own."""
        def flush(rows, classes):
            key, least, a, b = joined(np.concatenate(rows), np.concatenate(classes))
            own = mix(a.view(np.uint64) + mix(b.view(np.uint64))).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([key, own, own])), pa.array(np.concatenate([least, a, b]))], ["key", "cls"])

        rows, classes, held = [], [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                piece = batch.slice(i, 256)
                found = piece.column(1)
                rows.append(found.flatten().to_numpy())
                classes.append(np.repeat(piece.column(0).to_numpy(), pa.compute.list_value_length(found).to_numpy()))
                held += len(rows[-1])
                if held >= KEYS_AT_ONCE:
                    yield flush(rows, classes)
                    rows, classes, held = [], [], 0
        if held:
            yield flush(rows, classes)

    def meet(batches):
        import pyarrow.compute  # noqa: F401

        rows, classes, held = [], [], 0

        def flush():
            """Pairs of what is held; of that only the last key, whose group may go on, is kept."""
            nonlocal rows, classes, held
            key, least, a, b = joined(np.concatenate(rows), np.concatenate(classes))
            rows, classes, held = [key[-1:]], [least[-1:]], 1
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if batch.num_rows:
                rows.append(batch.column(0).to_numpy())
                classes.append(batch.column(1).to_numpy())
                held += batch.num_rows
                if held >= KEYS_AT_ONCE:
                    yield flush()
        if held:
            yield flush()

    few = described.where(F.col("cls").isNotNull()).select("cls", "keys").mapInArrow(reduce, "key long, cls long")
    return few.repartition("key").sortWithinPartitions("key", "cls").mapInArrow(meet, "a long, b long")


def sets_of(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(cls, doc_id, elements): sets of documents whose class is among ``wanted.cls``, and few others.

    What is sent to the tasks is a filter of bounded size, one bit for each hash of a class.
    """
    cell = F.col("cls").bitwiseAND(F.lit(FILTER_BITS - 1))
    words = wanted.select(F.shiftright(cell, 6).alias("word"), F.expr("shiftleft(1L, CAST(cls & 63 AS INT))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    found = words.toArrow()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(bits.tobytes())

    def make():
        known = np.frombuffer(shared.value, np.uint64)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, classes, sets = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                elements = shingles(text, size)
                if len(elements):
                    cls = class_of(elements)
                    at = cls & (FILTER_BITS - 1)
                    if int(known[at >> 6]) >> (at & 63) & 1:
                        ids.append(doc_id)
                        classes.append(cls)
                        sets.append(elements.tobytes())
            return pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["cls", "doc_id", "elements"])

        return work

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_texts(rows, "text", "cls long, doc_id long, elements binary", make)


class Tree:
    """Leaves in a given order, and above them nodes of some children each: bitmap, sizes, elements that share a bit."""

    def __init__(self, bitmaps: np.ndarray, low: np.ndarray, high: np.ndarray, excess: np.ndarray, start: int = 0) -> None:
        self.start, self.n = start, len(low)  # the places of its leaves among all
        self.levels = [(bitmaps, low, high, excess)]
        while len(low) > 1:
            at = np.arange(0, len(low), LEAVES if len(self.levels) == 1 else FAN)
            bitmaps, low = np.bitwise_or.reduceat(bitmaps, at, axis=0), np.minimum.reduceat(low, at)
            high, excess = np.maximum.reduceat(high, at), np.maximum.reduceat(excess, at)
            self.levels.append((bitmaps, low, high, excess))
        self.top = len(self.levels) - 1

    def span(self, level: int, i: int) -> slice:
        width = LEAVES * FAN ** (level - 1) if level else 1
        return slice(self.start + i * width, self.start + min(self.n, (i + 1) * width))

    def children(self, level: int, i: int) -> np.ndarray:
        fan = LEAVES if level == 1 else FAN
        return np.arange(i * fan, min(len(self.levels[level - 1][1]), (i + 1) * fan))


def bitmaps(sets: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """One bit for each element, and how many elements found theirs set."""
    out = np.zeros((len(sets), bits // 64), np.uint64)
    for i, s in enumerate(sets):
        row = np.zeros(bits, np.uint8)
        row[(s & U(bits - 1)).astype(np.int64)] = 1
        out[i] = np.packbits(row, bitorder="little").view(np.uint64)
    return out, np.array([len(s) for s in sets], np.int64) - np.bitwise_count(out).sum(axis=1, dtype=np.int64)


def tree_of(sets: list[np.ndarray], bits: int, start: int = 0) -> Tree:
    found, excess = bitmaps(sets, bits)
    sizes = np.array([len(s) for s in sets], np.int64)
    return Tree(found, sizes, sizes, excess, start)


def bits_for(sets: list[np.ndarray]) -> int:
    wanted, room = 4 * max(map(len, sets)), TREE_BITS // len(sets)
    bits = 64
    while bits < wanted and 2 * bits <= room:
        bits *= 2
    return bits


def pairs_left(a: tuple, b: tuple, percent: int) -> np.ndarray:
    """Which of all pairs of nodes may have a link below: a matrix."""
    (bits_a, low_a, high_a, excess_a), (bits_b, low_b, high_b, excess_b) = a, b
    keep = (100 * high_a[:, None] >= percent * low_b) & (100 * high_b >= percent * low_a[:, None])
    all_i, all_j = np.nonzero(keep)
    step = max(1, WORDS_AT_ONCE // bits_a.shape[1])
    for start in range(0, len(all_i), step):
        i, j = all_i[start:start + step], all_j[start:start + step]
        most = np.bitwise_count(bits_a[i] & bits_b[j]).sum(axis=1, dtype=np.int64) + np.minimum(excess_a[i], excess_b[j])
        most = np.minimum(most, np.minimum(high_a[i], high_b[j]))
        keep[i, j] = (100 + percent) * most >= percent * (low_a[i] + low_b[j])
    return keep


def traverse(left: Tree, right: Tree, percent: int, visit: Callable[[int, int], None], labels: np.ndarray | None = None) -> None:
    """Call ``visit`` with the places of all pairs of leaves that may be linked: of two trees, or of one tree with itself.

    Pairs below nodes whose ``labels`` are all the same are left out; ``visit`` may change labels.
    """
    def connected(a: slice, b: slice) -> bool:
        if labels is None:
            return False
        first = labels[a.start]
        return bool((labels[a] == first).all() and (labels[b] == first).all())

    def part(tree: Tree, level: int, at: np.ndarray) -> tuple:
        return tuple(x[at] for x in tree.levels[level])

    stack = [(left.top, 0, right.top, 0)]
    while stack:
        la, i, lb, j = stack.pop()
        own = left is right and la == lb and i == j
        if la == lb == 0:
            if not own:
                visit(left.start + i, right.start + j)
            continue
        if connected(left.span(la, i), right.span(lb, j)):
            continue
        down_a, down_b = la >= lb, lb >= la
        at_a = left.children(la, i) if down_a else np.array([i])
        at_b = right.children(lb, j) if down_b else np.array([j])
        la, lb = la - down_a, lb - down_b
        keep = pairs_left(part(left, la, at_a), part(right, lb, at_b), percent)
        if own:
            keep = np.triu(keep)
        found = np.argwhere(keep)
        # Near ones first, each with itself before all: what they connect need not be compared again.
        for x, y in found[np.argsort(-np.abs(found[:, 0] - found[:, 1]), kind="stable")]:
            stack.append((la, int(at_a[x]), lb, int(at_b[y])))


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    shared = int((b[at] == a).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


class Links:
    """Verified links between sets: ``labels`` say what they connect so far."""

    def __init__(self, sets: list[np.ndarray], labels: list[int], percent: int) -> None:
        self.sets, self.percent = sets, percent
        self.first, self.labels = np.array(labels, np.int64), np.array(labels, np.int64)

    def visit(self, i: int, j: int) -> None:
        if self.labels[i] != self.labels[j] and linked(self.sets[i], self.sets[j], self.percent):
            self.labels[self.labels == self.labels[j]] = self.labels[i]

    def rows(self) -> pa.RecordBatch:
        """Each label that links have joined to others, with the smallest of those."""
        new = self.first != self.labels
        a, b = stars(self.first[new], self.labels[new])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def by_likeness(sets: list[np.ndarray]) -> list[int]:
    """An order that puts similar sets side by side: by their smallest elements, which they are likely to share."""
    return sorted(range(len(sets)), key=lambda i: (int(sets[i][0]), int(sets[i][min(1, len(sets[i]) - 1)])))


def groups(batches, keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of sorted batches, gathered as long as their first columns stay the same."""
    at, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:keys] != at:
                if held:
                    yield at, held
                at, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield at, held


def members(rows: list[tuple]) -> tuple[list[int], list[np.ndarray], list]:
    """Classes, sets and labels of a block's rows (class, elements, label), in the order of a tree; repeated rows count once."""
    once = list({r[0]: r for r in rows}.values())
    sets = [np.frombuffer(r[1], np.uint64) for r in once]
    order = by_likeness(sets)
    return [once[i][0] for i in order], [sets[i] for i in order], [once[i][2] for i in order]


def links_in_blocks(placed: DataFrame, percent: int) -> DataFrame:
    """Links within each block of (root, block, cls, elements): each class with the smallest that links of the block reach."""

    def run(batches):
        for _, rows in groups(batches, 2):
            if len(rows) > 1:
                classes, sets, _ = members([(*r, None) for r in rows])
                links = Links(sets, classes, percent)
                tree = tree_of(sets, bits_for(sets))
                traverse(tree, tree, percent, links.visit, links.labels)
                yield links.rows()

    dealt = placed.select("root", "block", "cls", "elements").repartition("root", "block").sortWithinPartitions("root", "block")
    return dealt.mapInArrow(run, "a long, b long")


def block_pairs(placed: DataFrame, percent: int) -> DataFrame:
    """(root, x, y), x < y: pairs of blocks of a cluster that may hold links, by a tree over the blocks' signatures."""

    def sign(batches):
        for (root, block), rows in groups(batches, 2):
            found, excess = bitmaps([np.frombuffer(r[0], np.uint64) for r in rows], BLOCK_BITS)
            sizes = [len(r[0]) // 8 for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (
                root, block, np.bitwise_or.reduce(found, axis=0).tobytes(), min(sizes), max(sizes), int(excess.max()))], ["root", "block", "bits", "low", "high", "excess"])

    def pair(batches):
        for (root,), rows in groups(batches, 1):
            block, bits, low, high, excess = zip(*rows)
            tree = Tree(np.stack([np.frombuffer(b, np.uint64) for b in bits]), *(np.array(v, np.int64) for v in (low, high, excess)))
            found: list[tuple[int, int]] = []
            traverse(tree, tree, percent, lambda i, j: found.append((min(i, j), max(i, j))))
            if found:
                yield pa.RecordBatch.from_arrays([
                    pa.array([root] * len(found), pa.int64()), pa.array([block[i] for i, _ in found]), pa.array([block[j] for _, j in found])], ["root", "x", "y"])

    dealt = placed.select("root", "block", "elements").repartition("root", "block").sortWithinPartitions("root", "block")
    signed = dealt.mapInArrow(sign, "root long, block long, bits binary, low long, high long, excess long")
    return signed.repartition("root").sortWithinPartitions("root", "block").mapInArrow(pair, "root long, x long, y long")


def links_across(placed: DataFrame, pairs: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """Links between the blocks of each pair, where their sets are not all connected by ``links`` already; as pairs of roots by ``links``."""
    label = components(links).select(F.col("fp").alias("cls"), F.col("root").alias("label"))
    known = cut_lineage(placed.join(label, "cls", "left").withColumn("label", F.coalesce("label", "cls")))
    whole = known.groupBy("root", "block").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    sides = [whole.select("root", F.col("block").alias(s), F.col("low").alias(f"low_{s}"), F.col("high").alias(f"high_{s}")) for s in "xy"]
    left = pairs.join(sides[0], ["root", "x"]).join(sides[1], ["root", "y"]).where("least(low_x, low_y) <> greatest(high_x, high_y)").select("root", "x", "y")
    both = left.select("root", "x", "y", F.explode(F.array("x", "y")).alias("block")).join(known, ["root", "block"])

    def run(batches):
        for (_, x, y), rows in groups(batches, 3):
            parts = [members([r[1:] for r in rows if r[0] == b]) for b in (x, y)]
            sets, labels = (parts[0][k] + parts[1][k] for k in (1, 2))
            found = Links(sets, labels, percent)
            bits = bits_for(sets)
            one = tree_of(parts[0][1], bits)
            traverse(one, tree_of(parts[1][1], bits, one.n), percent, found.visit, found.labels)
            yield found.rows()

    dealt = both.select("root", "x", "y", "block", "cls", "elements", "label").repartition("root", "x", "y").sortWithinPartitions("root", "x", "y")
    return dealt.mapInArrow(run, "a long, b long")


def similar(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, block: int = BLOCK_ELEMENTS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_shingles`` and ``component_id``."""
    rows = cut_lineage(described(docs, percent, size))
    named = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id"))
    classes = cut_lineage(rows.where(F.col("cls").isNotNull()).groupBy("cls").agg(F.min(named).alias("low"), F.max("n").alias("n")).select(
        "cls", F.col("low.doc_id").alias("low"), "n"))
    above = components(candidates(rows)).select(F.col("fp").alias("cls"), "root")
    clusters = above.unionAll(above.select(F.col("root").alias("cls"), "root").distinct()).join(classes, "cls")
    placed = cut_lineage(running_total(clusters, ["root"], ["n", "cls"], {"total": F.col("n")}).select(
        "cls", "low", "root", F.floor((F.col("total") - 1) / block).cast("long").alias("block")))
    chosen = placed.withColumnRenamed("cls", "_cls")
    sets = cut_lineage(sets_of(docs, placed, size).join(chosen, (F.col("cls") == F.col("_cls")) & F.col("doc_id").eqNullSafe(F.col("low"))).select(
        "root", "block", "cls", "elements"))
    links = cut_lineage(links_in_blocks(sets, percent))
    several = placed.groupBy("root").agg(F.min("block").alias("first"), F.max("block").alias("last")).where("first < last").select("root")
    if several.isEmpty():
        root = links.select(F.col("b").alias("cls"), F.col("a").alias("root"))
    else:
        sets = sets.join(several, "root", "left_semi")
        pairs = cut_lineage(block_pairs(sets, percent))
        order = placed.select("root", "block").distinct()
        following = order.select("root", F.col("block").alias("x")).withColumn("y", F.lead("x").over(Window.partitionBy("root").orderBy("x")))
        near = pairs.join(following, ["root", "x", "y"], "left_semi")
        for part in (near, pairs.join(near, ["root", "x", "y"], "left_anti")):
            links = cut_lineage(links.unionAll(links_across(sets, part, links, percent)))
        root = components(links).select(F.col("fp").alias("cls"), "root")
    rooted = classes.join(root, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    ids = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    found = rooted.select("cls", "root").join(ids, "root").select("cls", "component_id")
    return rows.select("doc_id", "n", "cls").join(found, "cls", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))



JOIN_SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {SHINGLE} + 2), lambda i: array_to_string(w[i:i + {SHINGLE} - 1], ' '))) END AS s
  FROM words),
elements AS (SELECT doc_id, unnest(s) AS e FROM sets),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM elements x JOIN elements y ON x.e = y.e AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * n >= {PERCENT} * (len(x.s) + len(y.s) - n)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.low AS component_id
FROM sets s JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) m ON m.a = s.doc_id
"""
