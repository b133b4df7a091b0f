"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, scheme marks, plus signs, digits and words that announce an
account. A deterministic parser for each kind then walks outwards from the anchor to the boundaries and validates what
lies between. Every parser reads a character a bounded number of times, so a text costs time linear in its length.

Kinds ``email ip card phone`` are the base; ``url account`` are added by the method. Spans of one kind do not overlap,
spans of different kinds may. NULL or empty texts have no spans; NULL ids are kept; repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filewright.llm.common import kept_in_worker, map_texts

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account")
DIGITS = frozenset("0123456789")
LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
LABEL = LETTERS | DIGITS | {"-"}
LOCAL = LETTERS | DIGITS | frozenset("._%+-")
PHONE = DIGITS | frozenset(" ().-")
SCHEMES = ("http", "https", "ftp", "ftps", "sftp", "ssh", "ws", "wss")
CUES = ("account", "acct", "iban", "konto", "compte", "cuenta")
URL_END = frozenset(" \t\n\r\x0b\x0c<>\"'`{}|\\^")


def anchors() -> ahocorasick.Automaton:
    """Automaton over everything that may start or sit inside a span; values are (kind of anchor, length)."""
    found = ahocorasick.Automaton()
    found.add_word("@", ("@", 1))
    found.add_word("+", ("+", 1))
    found.add_word("://", ("://", 3))
    for digit in DIGITS:
        found.add_word(digit, ("0", 1))
    for cue in CUES:
        for form in {cue, cue.capitalize(), cue.upper()}:
            found.add_word(form, ("cue", len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) << (i & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def expand_email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """Address around the at-sign, not reaching left of ``floor``."""
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    end, n, labels = at + 1, len(text), 0
    if start == at:
        return None
    while end < n and text[end] in LABEL:
        end += 1
        while end < n and text[end] in LABEL:
            end += 1
        labels += 1
        if end + 1 < n and text[end] == "." and text[end + 1] in LABEL:
            end += 1
        else:
            break
    return (start, end) if labels >= 2 else None


def expand_phone(text: str, plus: int) -> tuple[int, int] | None:
    n, end = len(text), plus + 2
    if plus + 1 >= n or text[plus + 1] not in DIGITS:
        return None
    while end < n and text[end] in PHONE:
        end += 1
    while end > plus + 3 and text[end - 1] not in DIGITS:
        end -= 1
    if end <= plus + 3 or text[end - 1] not in DIGITS:
        return None
    count = sum(c in DIGITS for c in text[plus:end])
    return (plus, end) if 8 <= count <= 15 else None


def chains(text: str, runs: list[tuple[int, int]], joints: str):
    """Maximal lists of digit runs with exactly one of ``joints`` between neighbours."""
    chain: list[tuple[int, int]] = []
    for run in runs:
        if chain and not (run[0] == chain[-1][1] + 1 and text[chain[-1][1]] in joints):
            yield chain
            chain = []
        chain.append(run)
    if chain:
        yield chain


def small_number(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


class UrlEnds:
    """Where the run of characters that a mark lies in ends, without what closes a sentence: found once for all marks of a run."""

    def __init__(self, text: str) -> None:
        self.text, self.run, self.end = text, 0, 0

    def after(self, at: int) -> int:
        text, n = self.text, len(self.text)
        if at >= self.run:
            self.run = at
            while self.run < n and text[self.run] not in URL_END:
                self.run += 1
            self.end = self.run
            while self.end > at and text[self.end - 1] in ".,;:!?)]*":
                self.end -= 1
        return max(at, self.end)


def expand_url(text: str, mark: int, floor: int, ends: UrlEnds) -> tuple[int, int] | None:
    start = mark
    while start > floor and text[start - 1] in LETTERS:
        start -= 1
    if text[start:mark].lower() not in SCHEMES:
        return None
    end = ends.after(mark + 3)
    # The host ends at the first of three signs; the next mark of the run holds one of them.
    host = end
    for sign in "/?#":
        at = text.find(sign, mark + 3, host)
        host = host if at < 0 else at
    name = text[mark + 3:host].rpartition("@")[2].split(":", 1)[0]
    return (start, end) if name == "localhost" or "." in name.strip(".") else None


def mod97(code: str) -> bool:
    code = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in code)) % 97 == 1


def expand_account(text: str, start: int) -> tuple[int, int] | None:
    """Account number that follows a cue at ``start``: an international one with its check sum, or 6 to 20 digits."""
    n = len(text)
    head = text[start:start + 12].lower()
    for word in (" number", " no.", " no", " nr.", " nr"):
        if head.startswith(word):
            start += len(word)
            break
    limit = min(n, start + 3)
    while start < limit and text[start] in " :#=":
        start += 1
    end, kept = start, []
    while end < n and len(kept) <= 34:
        c = text[end]
        if c in LETTERS or c in DIGITS:
            kept.append(c)
        elif not (c in " -" and end + 1 < n and (text[end + 1] in DIGITS or text[end + 1] in LETTERS)):
            break
        end += 1
        code = "".join(kept).upper()
        boundary = end >= n or not (text[end] in LETTERS or text[end] in DIGITS)
        if boundary and 15 <= len(code) <= 34 and code[:2].isalpha() and code[2:4].isdigit() and mod97(code):
            return start, end
    end = start
    digits = 0
    while end < n and digits <= 20:
        if text[end] in DIGITS:
            digits += 1
        elif not (digits and text[end] in " -" and end + 1 < n and text[end + 1] in DIGITS):
            break
        end += 1
    return (start, end) if 6 <= digits <= 20 and (end >= n or text[end] not in LETTERS) else None


def find_spans(text: str, automaton: ahocorasick.Automaton) -> list[list[tuple[int, int]]]:
    """Spans of ``text`` by kind, in order of ``KINDS``, each list ordered by start."""
    email, ip, card, phone, url, account = found = [[] for _ in KINDS]
    runs: list[tuple[int, int]] = []
    run_start = run_end = -1
    ends = UrlEnds(text)
    for last, (anchor, length) in automaton.iter(text):
        if anchor == "0":
            if last != run_end:
                if run_end >= 0:
                    runs.append((run_start, run_end))
                run_start = last
            run_end = last + 1
        elif anchor == "@":
            if span := expand_email(text, last, email[-1][1] if email else 0):
                email.append(span)
        elif anchor == "+":
            if span := expand_phone(text, last):
                phone.append(span)
        elif anchor == "://":
            if (floor := url[-1][1] if url else 0) <= last - 2 and (span := expand_url(text, last - 2, floor, ends)):
                url.append(span)
        elif (floor := account[-1][1] if account else 0) <= last and (span := expand_account(text, last + 1)):
            if span[0] >= floor:
                account.append(span)
    if run_end >= 0:
        runs.append((run_start, run_end))
        for chain in chains(text, runs, "."):
            for i in range(0, len(chain) - 3, 4):
                if all(small_number(text[s:e]) for s, e in chain[i:i + 4]):
                    ip.append((chain[i][0], chain[i + 3][1]))
        for chain in chains(text, runs, " -"):
            digits = "".join(text[s:e] for s, e in chain)
            if 16 <= len(digits) <= 19 and luhn(digits):
                card.append((chain[0][0], chain[-1][1]))
    return found


def listed(spans: list[list[tuple[int, int]]]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for kind, own in zip(KINDS, spans) for s, e in own)


def masked(text: str, spans: list[list[tuple[int, int]]]) -> str:
    """``text`` with spans replaced by their kind in capitals; of overlapping spans the first, longest and earliest kind counts."""
    flat = sorted((s, -e, k) for k, own in enumerate(spans) for s, e in own)
    out, at = [], 0
    for s, e, k in flat:
        if s >= at:
            out += [text[at:s], f"<{KINDS[k].upper()}>"]
            at = -e
        elif -e > at:  # the rest of a span that begins inside another
            at = -e
    return "".join([*out, text[at:]])


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, a digest of the base spans and all spans as text."""

    def make():
        automaton = kept_in_worker("pii_anchors", anchors)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [find_spans(t or "", automaton) for t in batch.column(1).to_pylist()]
            spans = [listed(r) for r in rows]
            base = [listed(r[:len(BASE)]) for r in rows]
            return pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), *[pa.array([len(r[k]) for r in rows], pa.int64()) for k in range(len(BASE))],
                 pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base], pa.string()), pa.array(spans, pa.string())],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

        return work

    return map_texts(docs.select(F.col("doc_id").cast("long"), "text"), "text", SCHEMA, make)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of every kind in ``text`` replaced by a placeholder; NULL texts stay NULL, all columns stay."""

    def make():
        automaton = kept_in_worker("pii_anchors", anchors)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            at = batch.schema.get_field_index("text")
            texts = [t if t is None else masked(t, find_spans(t, automaton)) for t in batch.column(at).to_pylist()]
            return batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

        return work

    return map_texts(docs, "text", docs.schema, make)
