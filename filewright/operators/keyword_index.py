"""Keyword rules as a hash index.

Every rule has one key that a matching name must hold: a whole token, or the beginning of a token. A short word is a token,
a longer word begins one, and a phrase (found anywhere in the name, so that its first word may end a longer token) holds its
second word: whole where a third follows, else at the beginning of a token. A name looks up its tokens and their beginnings of the lengths
that occur, so its cost follows from its own length and not from the number of rules.

The index is a constant of the plan: one array of buckets, an entry being a key and the rank of its rule, and arrays of
what belongs to a rank. A bucket is reached by its number, in place, for every row; a table joined on the extension would have
its row copied beside every file. So there is no join, no shuffle and no explode. An index holds a bounded number of rules;
more rules make more of them, looked at in order.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from filewright import constants as C
from filewright.config import Taxonomy

WHOLE, BEGINNING = "=", "<"
LADDER = (3, 5, 8, 12, 20)  # lengths of beginnings; a longer one is taken where more than FEW rules share a shorter one
FEW = 8
SPARE = 8  # buckets for each rule, so that most look-ups end at an empty one
END = "\0"  # of an element; no key, needle or living keyword holds it


def held_word(cleaned: str, is_phrase: bool) -> tuple[str, str] | None:
    """The word that a name must hold for the rule, and how; None for a rule that no name can match, since names are split
    at all but ASCII letters and digits."""
    words = cleaned.split(" ")
    if not all(w.isascii() and w.isalnum() for w in words):
        return None
    if is_phrase:
        return (WHOLE if len(words) > 2 else BEGINNING), words[1]
    return (BEGINNING if len(cleaned) >= C.PREFIX_KEYWORD_LEN else WHOLE), cleaned


def keys_of(words: Sequence[tuple[str, str]]) -> list[str]:
    """A key for each word: itself if it is a whole token, else the shortest of its beginnings that few others share."""
    keys = [WHOLE + w if kind == WHOLE else "" for kind, w in words]
    left = [i for i, k in enumerate(keys) if not k]
    for n in (*LADDER, None):
        shared = Counter(words[i][1][:n] for i in left)
        for i in left:
            w = words[i][1]
            if n is None or len(w) <= n or shared[w[:n]] <= FEW:
                keys[i] = BEGINNING + w[:n]
        left = [i for i in left if not keys[i]]
    return keys


def needle_of(cleaned: str, is_phrase: bool) -> str:
    """What to look for in the flat name padded with one space on both sides."""
    if is_phrase:
        return cleaned
    return f" {cleaned}" if len(cleaned) >= C.PREFIX_KEYWORD_LEN else f" {cleaned} "


def constant(values: Sequence[str]) -> Column:
    """An array that is folded into one value when the plan is made, however long it is."""
    return F.split(F.lit(END.join(values)), END)


@dataclass(frozen=True)
class KeywordIndex:
    """Buckets of keys and ranks as texts `` key rank key rank ``, and needle, category and keyword by rank."""

    buckets: list[str]
    lengths: list[int]
    needles: list[str]
    categories: list[str]
    keywords: list[str]
    extensions: list[str]  # by rank, as ``|.a|.b|``

    @classmethod
    def of(cls, rules: Sequence[tuple[str, str, str, str, str]]) -> KeywordIndex:
        """From (key, needle, category, keyword, extensions) in the order in which rules win."""
        n = 1 << max(0, SPARE * len(rules) - 1).bit_length()
        buckets = [""] * n
        for rank, rule in enumerate(rules):
            at = zlib.crc32(rule[0].encode()) % n
            buckets[at] = f"{buckets[at] or ' '}{rule[0]} {rank} "
        lengths = sorted({len(r[0]) - 1 for r in rules if r[0][0] == BEGINNING})
        return cls(buckets, lengths, *([r[i] for r in rules] for i in range(1, 5)))

    def first_hit(self, flat: Column, ext: Column) -> Column:
        """(category, keyword) of the first rule that fits a name; NULL where none does."""
        padded = F.concat(F.lit(" "), flat, F.lit(" "))
        buckets, needles, allowed = (constant(v) for v in (self.buckets, self.needles, self.extensions))

        def keys(token: Column) -> Column:
            begun = [F.when(F.length(token) >= n, F.concat(F.lit(BEGINNING), F.left(token, F.lit(n)))) for n in self.lengths]
            return F.array(F.concat(F.lit(WHOLE), token), *begun)

        def bucket(key: Column) -> Column:
            return F.get(buckets, (F.crc32(key.cast("binary")) % len(self.buckets)).cast("int"))

        def ranks(key: Column) -> Column:
            return F.regexp_extract_all(bucket(key), F.concat(F.lit(" "), key, F.lit(" ([0-9]+)(?= )")), F.lit(1))

        def fits(rank: Column) -> Column:
            of_ext = (ext == "") | F.contains(F.get(allowed, rank), F.concat(F.lit("|"), ext, F.lit("|")))
            return of_ext & F.contains(padded, F.get(needles, rank))

        held = F.filter(F.flatten(F.transform(F.split(flat, " "), keys)), lambda k: F.contains(bucket(k), F.concat(F.lit(" "), k, F.lit(" "))))
        found = F.flatten(F.transform(held, ranks)).cast("array<int>")
        rank = F.array_min(F.filter(found, fits))
        return F.transform(F.array(rank), lambda r: F.when(r.isNotNull(), F.struct(
            F.get(constant(self.categories), r).alias("category"), F.get(constant(self.keywords), r).alias("keyword"))))[0]


def indexes(taxonomy: Taxonomy, at_once: int) -> list[KeywordIndex]:
    """Indexes of at most ``at_once`` rules; phrases first, then in taxonomy order, from one index to the next."""
    exts = {c: "|" + "".join(f"{e}|" for e in taxonomy.extensions(c)) for c in taxonomy.names}
    live = [(held_word(cleaned, phrase), needle_of(cleaned, phrase), category, keyword)
            for _, _, category, keyword, cleaned, phrase in sorted(taxonomy.keyword_rules(), key=lambda r: (not r[5], r[0], r[1]))]
    live = [r for r in live if r[0] is not None]
    out = []
    for i in range(0, len(live), at_once):
        part = live[i:i + at_once]
        out.append(KeywordIndex.of([(key, *r[1:], exts[r[2]]) for key, r in zip(keys_of([r[0] for r in part]), part)]))
    return out
