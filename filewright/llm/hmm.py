"""Hidden Markov language model over word classes.

A text is a sequence of words and one end. A hidden state moves from token to token and emits a class; the class emits the
word. The ``OWN`` most frequent words and the end have classes of their own, all other words share ``ENDINGS`` classes
by a hash of their last bytes, so the model's size is fixed whatever the corpus holds. Within a class words have the
(smoothed) share of their counts in all training texts.

Each Baum-Welch round is one pass over all training texts: tasks run the scaled forward and backward recursions and add up
expected counts, Spark adds up those of the tasks, and the driver gets sums of fixed size. Training cuts texts into
stretches of ``STRETCH`` tokens that run side by side; scoring runs the scaled forward recursion over each text from end
to end, so the likelihood is exact.

Tasks hold the words of a piece of text as one Arrow array, look them up and take their hashes all at once, and run the
recursions over many sequences side by side; no step takes words one by one in Python.

Counts are kept for every word. Those of the most frequent ``SHARED`` words go to the tasks, all others meet the texts in a
join, in which no word is hot, since frequent ones are not in it.

NULL texts are empty: their one token is the end. Rows with a NULL id are scored, held out, and not learnt from. Repeated
rows count, and are scored, as often as they stand. Without training texts every word is unknown and the base score is 0.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filewright.llm.common import map_texts, slices
from filewright.session import cut_lineage

STATES = 6
OWN = 4096
ENDINGS = 512
SHARED = 131_072
ROUNDS = 3
STRETCH = 128
SMOOTH = 0.5  # added to each count within a class, with one place for a word never seen
TAIL = 3  # bytes of an ending
FLUSH = 600_000  # counts held in a task before they are merged, and go out if half of them are left
PIECE = 4 << 20  # bytes of text handled at once; only memory depends on it
SIDE = 1024  # stretches that run side by side


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, one after the other, and the number of words of each text."""
    found = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, sizes = found.flatten(), pc.list_value_length(found).to_numpy().astype(np.int64)
    some = pc.not_equal(pc.binary_length(words), 0)  # white space at either end of a text leaves an empty word
    none = np.flatnonzero(~some.to_numpy(zero_copy_only=False))
    if len(none):
        words = words.filter(some)
        sizes -= np.bincount(np.searchsorted(np.cumsum(sizes), none, "right"), minlength=len(sizes))
    return words.cast(pa.binary()), sizes


@cache
def crc_parts() -> list[tuple[int, np.ndarray]]:
    """For each length up to ``TAIL``: the CRC32 of zeros, and what each byte in each place changes in it."""
    found = []
    for n in range(TAIL + 1):
        zeros = crc32(bytes(n))
        found.append((zeros, np.array([[crc32(bytes(i) + bytes([b]) + bytes(n - i - 1)) ^ zeros for b in range(256)] for i in range(n)], np.uint32)))
    return found


def endings(words: pa.Array) -> np.ndarray:
    """The class of the ending of each word: CRC32 of its last ``TAIL`` bytes, which is a sum of one part a byte."""
    if not len(words):
        return np.zeros(0, np.int32)
    _, places, data = words.buffers()
    places = np.frombuffer(places, np.int32)[words.offset:words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    ends, sizes = places[1:], np.minimum(np.diff(places), TAIL)
    out = np.empty(len(words), np.int32)
    for n, (zeros, parts) in enumerate(crc_parts()):
        of = np.flatnonzero(sizes == n)
        crc = np.full(len(of), zeros, np.uint32)
        for i in range(n):
            crc ^= parts[i][data[ends[of] - n + i]]
        out[of] = crc % ENDINGS
    return out


def look_up(words: pa.Array, known: pa.Array) -> np.ndarray:
    """The place of each word in ``known``, -1 if it is not there."""
    return pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy()


def with_ends(classes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Class ids of the words of texts of so many words, and of the end of each text."""
    ends = np.cumsum(sizes + 1) - 1
    inside = np.ones(len(classes) + len(sizes), bool)
    inside[ends] = False
    out = np.zeros(len(inside), np.int32)
    out[inside] = classes
    return out


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n) over all texts; the empty word is the end. Counted in the tasks before the shuffle."""

    def run(batches):
        def merged() -> pa.Table:
            found = pa.Table.from_batches(held, schema).group_by("word", use_threads=False).aggregate([("n", "sum")])
            return found.select(["word", "n_sum"]).rename_columns(["word", "n"])

        schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])
        held, size, ends = [], 0, 0
        for batch in batches:
            for piece in slices(batch, 0, PIECE):
                counts = split(piece.column(0))[0].value_counts()
                held.append(pa.RecordBatch.from_arrays([counts.field("values"), counts.field("counts")], schema=schema))
                size += len(counts)
                ends += piece.num_rows
                if size >= FLUSH:
                    held = merged().to_batches(max_chunksize=100_000)
                    size = sum(b.num_rows for b in held)
                    if size >= FLUSH // 2:
                        yield from held
                        held, size = [], 0
        yield from merged().to_batches(max_chunksize=100_000)
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([b""], pa.binary()), pa.array([ends], pa.int64())], schema=schema)

    return texts.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Words:
    """What tasks know of the counts: the frequent words with their counts, and totals of the classes of endings."""

    top: pa.Array  # the most frequent words, falling; the first ``OWN`` have classes of their own
    counts: np.ndarray  # of those
    class_log: np.ndarray  # log10 of the smoothed size of each class of endings
    total: int
    distinct: int
    ends: int
    unigram: np.ndarray

    @property
    def classes(self) -> int:
        return OWN + 1 + ENDINGS

    @property
    def own(self) -> pa.Array:
        return self.top[:OWN]


def most_frequent(counts: DataFrame, most: int) -> list:
    """Rows of the words of the highest counts, in their order, and not more than ``most``.

    A histogram over powers of the count, of a few thousand rows at most, says from which count on; so tasks send no
    words but those.
    """
    power = F.floor(F.log2("n") * 64)
    cut, total = None, 0
    for r in sorted(counts.groupBy(power.alias("power")).count().collect(), key=lambda r: -r.power):
        total += r["count"]
        if total > most:
            break
        cut = r.power
    if cut is None:
        return []
    return sorted(counts.where(power >= cut).collect(), key=lambda r: (-r.n, bytes(r.word)))


def learn_words(counts: DataFrame) -> Words:
    sums = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    top = most_frequent(counts.where(F.length("word") > 0), SHARED)
    frequent = pa.array([bytes(r.word) for r in top], pa.binary())
    own = frequent[:OWN]

    def classed(batches):
        for batch in batches:
            found = batch.column(0)
            kind = np.where(look_up(found, own) < 0, endings(found), -1)
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), batch.column(1)], ["kind", "n"])

    rows = counts.where(F.length("word") > 0).mapInArrow(classed, "kind int, n long").groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    n, v = np.zeros(ENDINGS), np.zeros(ENDINGS)
    for r in rows:
        if r.kind >= 0:
            n[r.kind], v[r.kind] = r.n, r.v
    unigram = np.full(OWN + 1 + ENDINGS, 0.5)
    for i, r in enumerate(top[:OWN]):
        unigram[i + 1] += r.n
    unigram[OWN + 1:] += n
    ends = int(counts.where(F.length("word") == 0).agg(F.sum("n")).first()[0] or 0)
    unigram[0] += ends
    return Words(frequent, np.array([r.n for r in top], np.int64), np.log10(n + SMOOTH * (v + 1)), int(sums.n or 0), int(sums.v), ends, unigram / unigram.sum())


@dataclass
class Model:
    start: np.ndarray  # of a text
    inside: np.ndarray  # of a stretch that does not begin a text; training only
    move: np.ndarray
    emit: np.ndarray  # (classes, states), so that a token's row lies together


def initial(words: Words) -> Model:
    rng = np.random.default_rng(7)
    emit = words.unigram[:, None] * np.exp(rng.normal(0, 0.5, (words.classes, STATES)))
    move = np.full((STATES, STATES), 0.1 / (STATES - 1))
    np.fill_diagonal(move, 0.9)
    even = np.full(STATES, 1 / STATES)
    return Model(even, even, move, emit / emit.sum(axis=0))


def class_ids(words: pa.Array, own: pa.Array) -> np.ndarray:
    found = look_up(words, own) + 1
    other = np.flatnonzero(found == 0)
    found[other] = OWN + 1 + endings(words.take(pa.array(other)))
    return found


def stretches(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of the stretches of texts of so many tokens, and whether each begins its text."""
    parts = -(-sizes // STRETCH)
    text = np.repeat(np.arange(len(sizes)), parts)
    at = (np.arange(len(text)) - (np.cumsum(parts) - parts)[text]) * STRETCH
    return (np.cumsum(sizes) - sizes)[text] + at, np.minimum(sizes[text] - at, STRETCH), at == 0


def expected_counts(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, first: np.ndarray, model: Model):
    """Expected starts, starts inside, moves and emissions over stretches of class ids, by scaled recursions."""
    order = np.argsort(-lengths, kind="stable")
    starts, lengths, first = starts[order], lengths[order], first[order]
    longest, n = int(lengths[0]), len(starts)
    active = np.searchsorted(-lengths, -np.arange(longest), "left")  # stretches longer than t
    # Rows stand by t, and within t by stretch; at[t] is the first of t.
    at = np.concatenate([[0], np.cumsum(active)])
    token = np.concatenate([ids[starts[:m] + t] for t, m in enumerate(active)]).astype(np.int64)
    emit, one = model.emit.take(token, axis=0), np.ones(STATES)
    alpha = np.empty_like(emit)
    for t in range(longest):
        here = slice(at[t], at[t + 1])
        a = alpha[at[t - 1]:at[t - 1] + active[t]] @ model.move if t else np.where(first[:, None], model.start, model.inside)
        a *= emit[here]
        over = (1 / (a @ one))[:, None]
        np.multiply(a, over, out=alpha[here])
        emit[here] *= over
    moves, emits = np.zeros((STATES, STATES)), np.empty((len(model.emit), STATES))
    beta, gamma = np.ones((n, STATES)), np.empty_like(emit)
    for t in range(longest - 1, -1, -1):
        if t < longest - 1:
            k = active[t + 1]
            ahead = emit[at[t + 1]:at[t + 2]] * beta[:k]
            moves += alpha[at[t]:at[t] + k].T @ ahead
            beta[:k] = ahead @ model.move.T
        here = slice(at[t], at[t + 1])
        np.multiply(alpha[here], beta[:active[t]], out=gamma[here])
    for k in range(STATES):
        emits[:, k] = np.bincount(token, gamma[:, k], len(model.emit))
    return gamma[:n][first].sum(axis=0), gamma[:n][~first].sum(axis=0), moves * model.move, emits


def baum_welch(texts: DataFrame, words: Words, model: Model) -> Model:
    """One round over all ``texts``."""
    shared = texts.sparkSession.sparkContext.broadcast((words.own, model))  # of fixed size

    def run(batches):
        own, now = shared.value
        sums = None
        for batch in batches:
            for piece in slices(batch, 0, PIECE):
                words, sizes = split(piece.column(0))
                if not len(sizes):
                    continue
                ids = with_ends(class_ids(words, own), sizes)
                starts, lengths, first = stretches(sizes + 1)
                order = np.argsort(-lengths, kind="stable")  # those of a length together
                for i in range(0, len(order), SIDE):
                    of = order[i:i + SIDE]
                    parts = expected_counts(ids, starts[of], lengths[of], first[of], now)
                    sums = parts if sums is None else tuple(a + b for a, b in zip(sums, parts))
        if sums is not None:
            flat = np.concatenate([p.ravel() for p in sums])
            some = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(flat[some])], ["place", "value"])

    flat = np.zeros(STATES * 2 + STATES * STATES + words.classes * STATES)
    for r in texts.select("text").mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).collect():
        flat[r.place] = r.value
    begin, inside, moves, emits = np.split(flat, np.cumsum([STATES, STATES, STATES * STATES]))
    moves, emits = moves.reshape(STATES, STATES) + 0.1, emits.reshape(words.classes, STATES) + 0.1 * words.unigram[:, None]
    part = lambda x: (x + 0.1) / (x + 0.1).sum()
    return Model(part(begin), part(inside), moves / moves.sum(axis=1, keepdims=True), emits / emits.sum(axis=0))


def log_likelihoods(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, model: Model) -> np.ndarray:
    """log10 probability of each sequence of class ids, from end to end."""
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    total, one = np.zeros(len(starts)), np.ones(STATES)
    active = np.searchsorted(-lengths, -np.arange(int(lengths[0])), "left")
    a = model.start * model.emit.take(ids[starts], axis=0)
    for t, m in enumerate(active):
        if t:
            a = a[:m] @ model.move
            a *= model.emit.take(ids[starts[:m] + t], axis=0)
        s = a @ one
        total[:m] += np.log10(s)
        a *= (1 / s)[:, None]
    out = np.empty(len(total))
    out[order] = total
    return out


def train(texts: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, Words, Model]:
    """Counts of all words of the training texts, what tasks need of them, and the model."""
    counts = cut_lineage(count_words(texts))
    words = learn_words(counts)
    model = initial(words)
    for _ in range(rounds if words.total else 0):
        model = baum_welch(texts, words, model)
    return counts, words, model


SCHEMA = "key long, doc_id long, held_out boolean, word binary, times long, tokens long, known long, base double, score double"


def score(docs: DataFrame, learn: Column, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id held_out n_tokens n_known train_tokens base_score score``.

    The model learns from the rows for which ``learn``, a condition on ``doc_id``, holds.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts, words, model = train(docs.where(learn), rounds)
    shared = docs.sparkSession.sparkContext.broadcast((words, model))  # of fixed size
    base_size = float(np.log10(words.total + words.distinct + 1))
    rows = docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", (~F.coalesce(learn, F.lit(False))).alias("held_out"), "text")

    def make():
        own_words, own_model = shared.value
        # The last one is of all other words, whose place is -1. Words with a class of their own are all of it.
        log_base, log_share = np.append(np.log10(own_words.counts + 1), 0), np.append(np.log10(own_words.counts + SMOOTH), 0)
        log_share[:OWN] = 0

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys = batch.column(0).to_numpy()
            words, sizes = split(batch.column(3))
            lengths, text = sizes + 1, np.repeat(np.arange(len(sizes)), sizes)
            per_text = lambda of, values=None: np.bincount(of, values, len(sizes))
            place = look_up(words, own_words.top)
            classes = place + 1
            other = np.flatnonzero((place < 0) | (place >= OWN))
            classes[other] = OWN + 1 + endings(words.take(pa.array(other)))
            rare = np.flatnonzero(place < 0)
            known = sizes - per_text(text[rare]) + (own_words.ends > 0)
            base = per_text(text, log_base[place]) + (np.log10(own_words.ends + 1) if own_words.ends else 0)
            shares = per_text(text, log_share[place]) - per_text(text[other], own_words.class_log[classes[other] - OWN - 1])
            # The rare words of each text once, with the times they stand in it.
            coded = words.take(pa.array(rare)).dictionary_encode()
            among = max(len(coded.dictionary), 1)
            pairs, times = np.unique(text[rare] * among + coded.indices.to_numpy(), return_counts=True)
            likely = log_likelihoods(with_ends(classes, sizes), np.cumsum(lengths) - lengths, lengths, own_model) if len(sizes) else np.zeros(0)
            n, m = len(sizes), len(pairs)
            pad = lambda kind: pa.nulls(m, kind)
            both = lambda values, kind: pa.concat_arrays([pa.array(values, kind), pad(kind)])
            return pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([keys, keys[pairs // among]]), pa.int64()), pa.concat_arrays([batch.column(1), pad(pa.int64())]),
                pa.concat_arrays([batch.column(2), pad(pa.bool_())]),
                # A text's own row has a word that is none, another for each, so that the join deals them out evenly.
                pa.concat_arrays([pa.array([b" %d" % k for k in keys.tolist()], pa.binary()), coded.dictionary.take(pa.array(pairs % among))]),
                pa.array(np.concatenate([np.zeros(n, np.int64), times]), pa.int64()),
                both(lengths, pa.int64()), both(known, pa.int64()), both(base, pa.float64()), both(shares + likely, pa.float64()),
            ], ["key", "doc_id", "held_out", "word", "times", "tokens", "known", "base", "score"])

        return work

    pieces = map_texts(rows, "text", SCHEMA, make, PIECE).alias("p").join(counts, "word", "left")
    n = F.coalesce("n", F.lit(0))
    one = lambda c: F.max(c).alias(c)
    summed = pieces.groupBy("key").agg(
        one("doc_id"), one("held_out"), one("tokens"),
        F.sum(F.coalesce("known", F.when(n > 0, F.col("times")).otherwise(0))).alias("n_known"),
        F.sum(F.coalesce("base", F.col("times") * F.log10(n + 1))).alias("base"),
        F.sum(F.coalesce("score", F.col("times") * F.log10(n + SMOOTH))).alias("score"))
    return summed.select(
        "doc_id", "held_out", F.col("tokens").alias("n_tokens"), "n_known", F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("tokens") * base_size).alias("base_score"), "score")
