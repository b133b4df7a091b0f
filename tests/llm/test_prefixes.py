"""The prefix trie against plain dictionaries."""

import hashlib
import random
import zlib

import pytest

from filewright.llm import prefixes
from tests.llm.common import LONG


def brute(turns, group=100, most=6):
    own = {}
    for c, turn, role, text in turns:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(rows)] for c, rows in own.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % most
        base = c - (c % group if c >= 0 else -(-c % group))
        made[c] = own.get(base, [])[:h] + own[c][h:]
    members = {}
    for c, rows in made.items():
        for d in range(len(rows) + 1):
            members.setdefault(tuple(rows[:d]), []).append(c)
    out = []
    for node, convs in members.items():
        under = [n for n in members if n[:len(node)] == node]
        below = {n[:len(node) + 1] for n in under if len(n) > len(node)}
        leaves = sum(not any(len(m) == len(n) + 1 and m[:len(n)] == n for m in under) for n in under)
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in under if n)
        ends = ",".join(str(c) for c in sorted(convs) if len(made[c]) == len(node))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(below), leaves, saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def frame(spark, turns):
    return spark.createDataFrame([(*t, "x", 5) for t in turns], "conv_id long, turn long, role string, text string, depth string, k1 int").repartition(5)


def nodes(df, **options):
    return sorted((tuple(r[c] for c in prefixes.OUT) for r in prefixes.trie(df, **options).collect()), key=str)


@pytest.mark.parametrize("seed,limit", [(1, prefixes.SKETCH_CELLS), (2, prefixes.BLOCK), (3, prefixes.BLOCK)])
def test_equals_brute_force(spark, seed, limit, monkeypatch):
    if limit == prefixes.BLOCK:  # a sketch too small for its rows: most prefixes go the exact way
        monkeypatch.setattr(prefixes, "BLOCK", 16)
        limit = 16
    rng = random.Random(seed)
    turns = []
    for c in [*range(0, 40), *range(100, 130), *range(-7, 0), 4711, 4712, 4700, 10 ** 12 + 3]:
        for t in range(rng.choice([1, 1, 2, 3, 5, 9])):
            turns.append((c, rng.choice([t, None, 3]), rng.choice(["user", "bot", None]), rng.choice(["hi", "ho", "é😀", "", None])))
    turns += rng.sample(turns, 20) + [(None, 0, "user", "nobody's")]
    rng.shuffle(turns)
    assert nodes(frame(spark, turns), limit=limit) == brute(turns)


def test_copies_long_and_deep(spark):
    deep = [(c, t, "u", f"turn {t}") for c in (1, 2, 5) for t in range(60)]
    copies = [(c, t, "u", "same") for c in range(200, 260) for t in range(3)]
    turns = deep + copies + [(7, 0, "u", LONG * 70), (8, 0, "u", LONG * 70)]
    assert nodes(frame(spark, turns)) == brute(turns)


def test_empty_table_and_one_conversation(spark):
    assert nodes(frame(spark, [])) == []
    for turns in ([(7, 0, "u", "alone")], [(300, 0, "u", "alone"), (300, 1, "v", "b")], [(None, 0, "u", "x")]):
        assert nodes(frame(spark, turns)) == brute(turns)


def test_singletons_are_told_in_place(spark):
    turns = [(c, t, "u", f"{c} {t}") for c in range(1, 100) for t in range(4)]
    rows = prefixes.screen(prefixes.rebuilt(frame(spark, turns)))
    # No conversation has its base, so all prefixes but the root's are of one conversation.
    assert rows.where("single AND depth = 0").isEmpty() and rows.where("NOT single AND depth > 0").isEmpty()


def test_ends_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "IDS_AT_ONCE", 7)
    ids = list(range(100))
    got = prefixes.digest_of_ends(spark.createDataFrame([(1, 2, i) for i in ids], "k1 long, k2 long, conv long")).collect()
    assert [r.ends_sha256 for r in got] == [hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()]
