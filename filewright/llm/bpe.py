"""Byte-level BPE by backtracking over longest matches.

Bytes are mapped to Latin-1 characters, so that an Aho-Corasick automaton over the vocabulary finds the longest token
where the encoder stands. The encoder takes the longest token, checks that it may stand beside the one
before it (two tokens may if merging their bytes would have kept them apart; answers are remembered), falls back to
shorter tokens and steps back when none fits. Every position is left for good at most once, so a piece costs linear time,
and the result is that of merging pairs by rank.

NULL or empty texts have no tokens; NULL ids are kept; repeated rows give repeated results. Pieces and what
follows a space are remembered in the worker, up to a fixed number of entries.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filewright.llm.common import kept_in_worker, map_texts

KEPT_CHUNKS = 300_000
KEPT_PAIRS = 1_000_000
LONG_CHUNK = 64  # longer ones are encoded anew each time


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a file of base64 token and rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Remembered(dict):
    """Ids of pieces of text, with what stands before each of them."""

    def __init__(self, encode, before: str = "") -> None:
        super().__init__()
        self.encode, self.before = encode, before

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        ids = self.encode(self.before + chunk)
        if len(chunk) <= LONG_CHUNK:
            if len(self) >= KEPT_CHUNKS:
                self.clear()
            self[chunk] = ids
        return ids


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.split_text = regex.compile(pattern).findall
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        self.token_of = {token.decode("latin-1"): i for token, i in ranks.items()}
        for token, i in self.token_of.items():
            self.automaton.add_word(token, i)
        self.automaton.make_automaton()
        self.shorter: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.pairs: dict[int, bool] = {}  # by left * size of the vocabulary + right
        self.length_of = {i: len(b) for b, i in ranks.items()}
        self.longest_token = max(map(len, ranks))
        self.wide = max(ranks.values()) + 1
        self.pieces = Remembered(self.encode_piece)
        self.after_space = Remembered(self.encode_pieces, " ")
        self.touching = regex.compile(r"\s\s").search
        self.text_of = {i: str(i) for i in self.bytes_of}

    def prefix_of(self, token: int) -> int:
        """The longest token that is a proper prefix of ``token``, or -1."""
        found = self.shorter.get(token)
        if found is None:
            data, found = self.bytes_of[token], -1
            for n in range(len(data) - 1, 0, -1):
                if (i := self.ranks.get(data[:n])) is not None:
                    found = i
                    break
            self.shorter[token] = found
        return found

    def halves_of(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes ``token``; itself twice where there is none."""
        found = self.halves.get(token)
        if found is None:
            data, ranks = self.bytes_of[token], self.ranks
            parts = [data[i:i + 1] for i in range(len(data))]
            while len(parts) > 2:
                best = min(((r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None and r < token), default=None)
                if best is None:
                    break
                i = best[1]
                parts[i:i + 2] = [parts[i] + parts[i + 1]]
            found = (ranks[parts[0]], ranks[parts[1]]) if len(parts) == 2 and parts[0] in ranks and parts[1] in ranks else (token, token)
            self.halves[token] = found
        return found

    def may_stand(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both would have kept the two tokens apart.

        The latest merge on the inner sides is undone, again and again; the two would have met if some inner pair
        merges before the later of the merges that made its sides.
        """
        limit = float("inf")
        while True:
            met = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if met is not None and met < limit:
                return False
            for side in ((0, 1) if left > right else (1, 0)):
                if side == 0:
                    inner = self.halves_of(left)[1]
                    if inner != left:
                        limit, left = left, inner
                        break
                else:
                    inner = self.halves_of(right)[0]
                    if inner != right:
                        limit, right = right + 1, inner
                        break
            else:
                return True

    def longest(self, latin: str) -> int:
        """The longest token that starts ``latin``, or -1: the automaton's path, shortened to where a token ends."""
        n = self.automaton.longest_prefix(latin)
        get = self.token_of.get
        while n and (found := get(latin[:n])) is None:
            n -= 1
        return found if n else -1

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode()
        whole = self.ranks.get(data)
        if whole is not None:
            return (whole,)
        latin, n = data.decode("latin-1"), len(data)
        length_of, longest, known, wide = self.length_of, self.longest, self.pairs, self.wide
        dead: set[int] = set()  # ends that no encoding of the rest goes on from
        tokens: list[int] = []
        at, token = 0, longest(latin[:self.longest_token])
        while at < n:
            end = at + length_of[token]
            fits = end not in dead
            if fits and tokens:
                key = tokens[-1] * wide + token
                fits = known.get(key)
                if fits is None:
                    if len(known) >= KEPT_PAIRS:
                        known.clear()
                    fits = known[key] = self.may_stand(tokens[-1], token)
            if fits:
                tokens.append(token)
                at = end
                if at < n:
                    token = longest(latin[at:at + self.longest_token])
            elif (less := self.prefix_of(token)) >= 0:
                token = less
            elif not tokens:
                raise ValueError("the vocabulary lacks single bytes")
            else:
                dead.add(at)
                token = tokens.pop()
                at -= length_of[token]
        return tuple(tokens)

    def encode_pieces(self, text: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(self.pieces.__getitem__, self.split_text(text))))

    def encode(self, text: str) -> list[int]:
        """Ids of ``text``.

        A space between two characters that are no white space always starts a piece. A text whose white space
        stands alone is cut there, and what follows each space is looked up whole.
        """
        if not text or self.touching(text) or text[0].isspace() or text[-1].isspace():
            return list(self.encode_pieces(text))
        first, *rest = text.split(" ")
        ids = list(self.encode_pieces(first))
        ids.extend(chain.from_iterable(map(self.after_space.__getitem__, rest)))
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def codec_of(spark: SparkSession, path: str, pattern: str):
    """A function that gives the codec in a task. The ranks come from the driver's file and are broadcast; a vocabulary has a fixed size."""
    ranks = spark.sparkContext.broadcast(read_ranks(path))
    name = f"bpe_{hashlib.md5(f'{path}\n{pattern}'.encode()).hexdigest()}"
    return lambda: kept_in_worker(name, lambda: Codec(ranks.value, pattern))


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode each text and decode its ids again: the number of tokens and digests of the ids and of the decoded bytes."""
    codec_in_task = codec_of(docs.sparkSession, path, pattern)

    def make():
        codec = codec_in_task()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, ids_sha, decoded_sha = [], [], []
            for text in batch.column(1).to_pylist():
                ids = codec.encode(text or "")
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(codec.text_of.__getitem__, ids)).encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            return pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return work

    return map_texts(docs.select(F.col("doc_id").cast("long"), "text"), "text", SCHEMA, make)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id n_tokens ids lossless``: the ids of each text (none for NULL), and whether decoding them gives the text again."""
    codec_in_task = codec_of(docs.sparkSession, path, pattern)

    def make():
        codec = codec_in_task()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, same = [], []
            for text in batch.column(1).to_pylist():
                ids.append(codec.encode(text or ""))
                same.append(codec.decode(ids[-1]) == (text or "").encode())
            return pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(same, pa.bool_())],
                ["doc_id", "n_tokens", "ids", "lossless"])

        return work

    return map_texts(docs.select(F.col("doc_id").cast("long"), "text"), "text", "doc_id long, n_tokens long, ids array<int>, lossless boolean", make)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and the ``text`` of lists of ``ids``; bytes that are no UTF-8 become replacement characters, NULL stays NULL."""
    ranks = encoded.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches):
        bytes_of = {i: b for b, i in ranks.value.items()}
        for batch in batches:
            texts = [None if x is None else b"".join(map(bytes_of.__getitem__, x)).decode(errors="replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")
