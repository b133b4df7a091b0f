"""Each operator on documents against a brute-force version of it, and on the odd cases."""

import hashlib
import random
import re
import weakref

import public_tokenizers
import pytest
import tiktoken
import xxhash

from filewright.llm import bpe, decontaminate, passages, pii, simhash
from tests.llm.common import ODD, WORDS, documents, lower, rows

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def soup(rng, n, size=40):
    return " ".join(rng.choice(["the", "of", "Ab", "cde", "fg", "hi."] + [f"w{i}" for i in range(size)]) for _ in range(n))


def by_row(rows_):
    return sorted(rows_, key=lambda r: tuple((v is None, v) for v in r))


# ------------------------------------------------------------ near-duplicates

def plain_fingerprint(text):
    words = WORDS.findall(lower(text))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(docs):
    prints = [plain_fingerprint(t) for _, t in docs]
    root = list(range(len(docs)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                root[top(i)] = top(j)
    out = []
    for i, (doc, _) in enumerate(docs):
        ids = [d for j, (d, _) in enumerate(docs) if top(j) == top(i) and d is not None]
        out.append((doc, f"{prints[i]:016x}", min(ids, default=None)))
    return by_row(out)


def test_near_duplicates(spark):
    rng = random.Random(3)
    docs = list(ODD)
    for i in range(40):
        base = soup(rng, 120)
        docs.append((10 + 5 * i, base))
        for k in range(rng.randint(0, 4)):
            words = base.split()
            for _ in range(k):
                words[rng.randrange(len(words))] = "zz"
            docs.append((11 + 5 * i + k, " ".join(words)))
    docs += [(900 + i, docs[20][1]) for i in range(5)]
    df = documents(spark, docs)
    got = simhash.near_duplicates(df)
    assert rows(got, "doc_id", "fingerprint", "component_id") == plain_components(docs)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({c for _, _, c in plain_components(docs) if c is not None})


def test_near_duplicates_of_nothing(spark):
    assert simhash.near_duplicates(documents(spark, [])).collect() == [] and simhash.keep_one(documents(spark, [])).collect() == []
    assert rows(simhash.near_duplicates(documents(spark, [(None, None), (None, "a")])), "component_id") == [(None,), (None,)]


def test_a_large_group_gives_few_links():
    import numpy as np

    rng = np.random.default_rng(1)
    prints = np.unique(np.array([(1 << 63) ^ sum(1 << int(b) for b in set(rng.integers(0, 64, 3).tolist())) for _ in range(3000)], np.uint64))
    found = simhash.links_within(prints, np.full(len(prints), len(prints)), 4)
    assert len(found) < len(prints)


# ------------------------------------------------------------- personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    return [
        [m.span() for m in EMAIL.finditer(text)],
        [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))],
        [m.span() for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m))],
        [m.span() for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]]


def test_spans_equal_the_patterns():
    rng, automaton = random.Random(2), pii.anchors()
    parts = [*"01259@@..+ -()ab%é\n", "1.2.3.4", "a@b.c", "+12345", "4111111111111111", "4111-1111 1111 1111", "256.1.1.1", "://", "account "]
    for _ in range(20000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert pii.find_spans(text, automaton)[:4] == plain_spans(text), text


def test_personal_data(spark):
    docs = [*ODD, (20, "to a.b@c.org, 10.0.0.1 or +49 30 1234567"), (21, "card 4111 1111 1111 1111 see https://h.test/x?y. IBAN DE89 3704 0044 0532 0130 00")]
    got = {r.doc_id: r for r in pii.find(documents(spark, docs)).collect()}
    assert len(pii.find(documents(spark, docs)).collect()) == len(docs)
    assert got[20].spans == "email:3:12,ip:14:22,phone:26:40" and got[20].base_sha256 == sha(got[20].spans)
    assert [s.split(":")[0] for s in got[21].spans.split(",")] == ["card", "url", "account"] and got[21].n_card == 1
    assert got[2].spans == "" and got[2].base_sha256 == sha("")
    masked = {r.doc_id: r.text for r in pii.redact(documents(spark, docs)).collect()}
    assert masked[20] == "to <EMAIL>, <IP> or <PHONE>" and masked[2] is None and masked[1] == "One fine day in May"
    assert masked[21] == "card <CARD> see <URL>. IBAN <ACCOUNT>"


# ------------------------------------------------------------------- tokens

def test_encoding_equals_the_library(spark):
    ranks = bpe.read_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec, rng = bpe.Codec(ranks, public_tokenizers.PATTERN), random.Random(4)
    parts = ["a", "b", " ", "  ", "e", "é", "\n", "\t", "the", "in", "ing", "😀", "ß", "0", "漢", ".", "-", "'s", "aaaa", "<|endoftext|>"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert codec.encode(text) == library.encode_ordinary(text), text
    long = "ab" * 50_000
    assert codec.encode(long) == library.encode_ordinary(long)
    got = rows(bpe.round_trip(documents(spark, ODD), RANKS, public_tokenizers.PATTERN), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    want = [(i, len(ids := library.encode_ordinary(t or "")), sha(" ".join(map(str, ids))), sha(t or "")) for i, t in ODD]
    assert got == by_row(want)
    encoded = bpe.encode(documents(spark, ODD), RANKS, public_tokenizers.PATTERN)
    assert all(r.lossless for r in encoded.collect())
    assert rows(bpe.decode(encoded, RANKS), "doc_id", "text") == by_row([(i, t or "") for i, t in ODD])


# ------------------------------------------------------------ contamination

def plain_contamination(docs, items):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    out = []
    for doc, text in docs:
        words, hit, found = find(text), set(), set()
        for name, item in items:
            own = find(item)
            size = min(13, len(own))
            windows = {tuple(own[i:i + size]) for i in range(len(own) - size + 1)} if own else set()
            for i in range(len(words) - size + 1 if own else 0):
                if tuple(words[i:i + size]) in windows:
                    hit |= set(range(i, i + size))
                    found.add(name or "")
        out.append((doc, len(words), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(words)))
    return by_row(out)


@pytest.mark.parametrize("chunk_words", [10**6, 60])
def test_contamination(spark, chunk_words):
    rng = random.Random(6)
    items = [(f"i{k}", soup(rng, rng.choice([3, 12, 13, 14, 40]))) for k in range(12)] + [("i3", "same id"), ("e", ""), ("n", None), (None, "rare words"), ("r", "alpha beta gamma")]
    docs = [*ODD, (8, "rare words"), (9, "Rare, WORDS!")]
    for i in range(40):
        item = rng.choice(items)[1] or ""
        words = item.split()
        docs.append((100 + i, f"{soup(rng, rng.randint(0, 60))} {' '.join(words[rng.randint(0, 3):len(words) - rng.randint(0, 3)])} {soup(rng, rng.randint(0, 300))}"))
    bench = spark.createDataFrame(items, "item_id string, text string")
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    df = documents(spark, docs)
    want = plain_contamination(docs, items)
    assert rows(decontaminate.find(df, bench, chunk_words=chunk_words), *names) == want
    clean = decontaminate.keep_clean(df, bench, chunk_words=chunk_words)
    assert clean.columns == df.columns and rows(clean, "doc_id") == by_row([(w[0],) for w in want if not w[5]])
    assert decontaminate.find(documents(spark, []), bench).collect() == []
    assert not any(r.contaminated for r in decontaminate.find(df, bench.limit(0)).collect())


def test_longest_match(spark):
    item = " ".join(f"w{i}" for i in range(40))
    bench = spark.createDataFrame([("a", item)], "item_id string, text string")
    got = decontaminate.find(documents(spark, [(1, "x y " + " ".join(f"w{i}" for i in range(5, 35)) + " z")]), bench).first()
    assert got.longest.asDict() == {"n": 30, "first": 2, "item": "a"} and [tuple(h) for h in got.hits] == [(2, 32)]


# ----------------------------------------------------------------- passages

def plain_passages(docs, window=50):
    first = {}
    split = [((t or "").encode().split(), d) for d, t in docs]
    for words, doc in split:
        if doc is not None:
            for i in range(len(words) - window + 1):
                key = tuple(words[i:i + window])
                first[key] = min(first.get(key, doc), doc)
    out = []
    for words, doc in split:
        gone = set()
        for i in range(len(words) - window + 1):
            if doc is not None and first[tuple(words[i:i + window])] < doc:
                gone |= set(range(i, i + window))
        kept = [w for i, w in enumerate(words) if i not in gone]
        out.append((doc, len(words), len(gone), sha(b" ".join(kept))))
    return by_row(out)


@pytest.mark.parametrize("crowd", [20_000, 3])
def test_passages(spark, crowd):
    rng = random.Random(8)
    shared = [soup(rng, n, 400) for n in (49, 50, 51, 70, 130)]
    docs = [*ODD, (50, "tick " * 200), (51, "tick " * 90), (None, shared[3]), (52, shared[3]), (52, shared[4])]
    for i in range(60):
        docs.append((100 + i, " ".join([soup(rng, rng.randint(0, 40), 400), rng.choice(shared), soup(rng, rng.randint(0, 40), 400), shared[3] if i % 2 else ""])))
    rng.shuffle(docs)
    got = passages.remove(documents(spark, docs), crowd=crowd)
    assert rows(got, "doc_id", "n_words", "n_removed", "kept_sha256") == plain_passages(docs)
    assert passages.remove(documents(spark, [])).collect() == []


def test_index_finds_what_a_scan_finds():
    import numpy as np

    from filewright.llm.fmindex import Index

    rng = np.random.default_rng(5)
    texts = [rng.integers(1, 4, n) for n in (3, 30, 80, 1, 25, 60)]
    texts.append(texts[2][10:60])
    flat, lengths = np.concatenate(texts), np.array([len(t) for t in texts])
    starts, numbers = np.cumsum(lengths) - lengths, np.array([70, 60, 50, 40, 30, 20, 10])
    index = Index(flat, starts, lengths, numbers, 5)
    for text, found in zip(texts, index.least_numbers(flat, starts, lengths)):
        for i, n in enumerate(found.tolist()):
            want = min(k for other, k in zip(texts, numbers.tolist()) for j in range(len(other) - 4) if (other[j:j + 5] == text[i:i + 5]).all())
            assert n == want
        assert len(found) == max(0, len(text) - 4)


def test_benchmark_is_held_two_chunks_at_a_time(spark, monkeypatch):
    alive, most, whole = weakref.WeakSet(), [], decontaminate.Benchmark.__init__

    def watch(self, *args):
        whole(self, *args)
        alive.add(self)
        most.append(len(alive))

    monkeypatch.setattr(decontaminate.Benchmark, "__init__", watch)
    bench = spark.createDataFrame([(str(i), " ".join(f"b{i}w{j}" for j in range(20))) for i in range(5)], "item_id string, text string")
    docs = documents(spark, [(i, " ".join(f"b{i}w{j}" for j in range(20)) if i < 5 else "clean") for i in range(6)])
    found = decontaminate.find(docs, bench, chunk_words=20)
    assert len(most) >= 5 and max(most) <= 2
    assert sorted((r.doc_id, r.contaminated) for r in found.collect()) == [(i, i < 5) for i in range(6)]
    most.clear()
    assert [r.doc_id for r in decontaminate.keep_clean(docs, bench, chunk_words=20).collect()] == [5]
    assert max(most) <= 2


@pytest.mark.parametrize("piece", ["http://1", "http://", "a@", "+1 ", "http://a?b", "IBAN ", "1.1.1.", "x.http://1:"])
def test_a_megabyte_of_half_found_data_takes_linear_time(piece):
    import time

    automaton = pii.anchors()
    seconds = []
    for size in (1 << 17, 1 << 20):
        begin = time.process_time()
        pii.find_spans(piece * (size // len(piece)), automaton)
        seconds.append(time.process_time() - begin)
    assert seconds[1] < 24 * max(seconds[0], 0.02)


def test_many_copies_of_a_row_cost_in_proportion(spark):
    words = " ".join(f"w{i}" for i in range(80))
    table = [(1, words), *[(2, words + " tail")] * 3000]
    got = passages.remove(documents(spark, table)).groupBy("doc_id", "n_words", "n_removed").count().collect()
    assert sorted(map(tuple, got)) == [(1, 80, 0, 1), (2, 81, 80, 3000)]
