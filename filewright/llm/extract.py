"""Main text of web pages from flat text blocks.

A page is read once into flat blocks: the text between block-level tags. Each block is described by its words and the
share of them in links, the same of the block before and after it, whether its element is one for running text or a heading,
and the innermost container that says what it is for (an article, or a menu, advert, form and so on by element, role, class or id).
Where a page marks its main text, what lies outside counts as set apart. A name that only holds such a word (``side-by-side``)
decides nothing: it is one more feature, weighed with words and density.
A decision tree decides which blocks are content. It is grown from ``LABELLED``, a small table of such descriptions.

NULL or empty pages give an empty text; unclosed and stray tags are tolerated; scripts, styles and comments that never
end run to the end of the page. Repeated pages give repeated results. Every text that is no content by the tree is
left out; nothing else is dropped or cut.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from filewright.llm.common import map_texts

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|svg|iframe|textarea|select|button|title|object|canvas|math|audio|video)\b(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*+>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)", re.DOTALL | re.IGNORECASE)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-a-zA-Z0-9_:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
TOKENS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr output q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
RUNNING = frozenset("p blockquote pre dd figcaption".split()) | HEADINGS
APART = frozenset("nav footer aside form head menu dialog fieldset".split())
MAIN = frozenset("article main".split())
MAIN_ROLES = frozenset("main article".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
MAIN_WORDS = frozenset("article content entry post story main body text".split())
APART_WORDS = frozenset(
    "nav navbar navigation menu menubar sidebar side footer foot banner ad ads adv advert advertisement advertising adsense sponsor sponsored promo "
    "promotion cookie cookies notice notices consent gdpr newsletter subscribe subscription signup popup modal overlay comment comments disqus "
    "reply replies respond related recommended recommendations share sharing social breadcrumb breadcrumbs pagination pager widget login search "
    "masthead toolbar copyright disclaimer alert toast skip teaser tags byline".split())
HEADER_WORDS = frozenset("header head topbar top".split())
BESIDES = frozenset("has with no without is".split())  # what is named after these is not the element itself
OWN_WORDS = frozenset("comment comments reply replies ad ads advert advertisement sponsored promo related teaser".split())

FEATURES = ("main", "apart", "running", "heading", "words", "density", "words_before", "density_before", "words_after", "density_after")
# The same for blocks inside an element with a word for a part set apart somewhere in its names, unless something sets them apart.
NAMED = [
    # inside an article: its text, and lists of links with what heads them
    (1, 0, 1, 0, 45, 0.0, 6, 0.0, 60, 0.1, 1), (1, 0, 1, 1, 2, 0.0, 60, 0.0, 30, 0.0, 1), (1, 0, 1, 0, 3, 0.0, 20, 0.0, 0, 0.0, 1),
    (1, 0, 0, 0, 40, 0.05, 5, 0.0, 70, 0.0, 1), (1, 0, 0, 0, 3, 0.0, 4, 0.0, 5, 0.0, 1), (1, 0, 1, 0, 50, 0.2, 30, 0.0, 40, 0.0, 1),
    (1, 0, 1, 0, 40, 0.0, 30, 0.0, 5, 1.0, 1), (1, 0, 0, 0, 25, 0.1, 30, 0.2, 6, 1.0, 1), (1, 0, 1, 1, 4, 0.0, 40, 0.0, 45, 0.0, 1),
    (1, 0, 1, 0, 10, 0.5, 30, 0.0, 12, 0.5, 0), (1, 0, 0, 0, 4, 1.0, 40, 0.0, 5, 1.0, 0), (1, 0, 0, 0, 30, 0.5, 3, 0.0, 20, 0.6, 0),
    (1, 0, 1, 1, 2, 0.0, 40, 0.0, 8, 1.0, 0), (1, 0, 1, 0, 3, 0.0, 60, 0.0, 6, 1.0, 0), (1, 0, 0, 0, 2, 0.0, 50, 0.0, 4, 1.0, 0),
    (1, 0, 1, 0, 60, 0.9, 30, 0.0, 30, 0.0, 0), (1, 0, 0, 0, 8, 1.0, 8, 1.0, 40, 0.0, 0),
    (1, 0, 1, 1, 1, 0.0, 18, 0.0, 4, 1.0, 0), (1, 0, 0, 0, 3, 0.0, 12, 0.0, 3, 1.0, 0), (1, 0, 1, 1, 4, 0.0, 6, 0.5, 5, 1.0, 0),
    (1, 0, 1, 0, 8, 0.0, 12, 0.0, 30, 0.0, 1), (1, 0, 0, 0, 1, 0.0, 18, 0.0, 18, 0.0, 1), (1, 0, 1, 0, 18, 0.0, 1, 0.0, 18, 0.0, 1),
    (1, 0, 0, 0, 3, 0.0, 3, 0.0, 3, 0.0, 1), (1, 0, 0, 0, 2, 0.0, 40, 0.0, 2, 0.0, 1), (1, 0, 1, 0, 6, 0.0, 50, 0.0, 0, 0.0, 1),
    (1, 0, 1, 1, 3, 0.0, 30, 0.0, 6, 0.0, 1), (1, 0, 0, 0, 12, 0.1, 20, 0.0, 10, 0.1, 1), (1, 0, 1, 0, 14, 0.0, 60, 0.0, 4, 0.2, 1),
    (1, 0, 1, 0, 5, 0.2, 8, 0.0, 1, 0.0, 1), (1, 0, 0, 0, 1, 0.0, 6, 1.0, 12, 0.0, 1),
    # no container says: long text with few links and what heads it; short notices are not content
    (0, 0, 1, 0, 60, 0.0, 35, 0.0, 50, 0.0, 1), (0, 0, 1, 0, 45, 0.1, 3, 0.0, 40, 0.0, 1), (0, 0, 0, 0, 60, 0.05, 4, 1.0, 45, 0.0, 1),
    (0, 0, 1, 0, 50, 0.2, 40, 0.0, 3, 1.0, 1), (0, 0, 1, 1, 4, 0.0, 3, 1.0, 60, 0.0, 1), (0, 0, 1, 1, 5, 0.0, 45, 0.0, 50, 0.0, 1),
    (0, 0, 1, 0, 20, 0.0, 5, 1.0, 3, 1.0, 0), (0, 0, 1, 0, 12, 0.0, 40, 0.0, 10, 0.0, 0), (0, 0, 0, 0, 20, 0.0, 40, 0.0, 0, 0.0, 0),
    (0, 0, 0, 0, 4, 1.0, 3, 1.0, 5, 1.0, 0), (0, 0, 1, 0, 40, 0.6, 30, 0.0, 20, 0.5, 0), (0, 0, 1, 1, 2, 0.0, 40, 0.0, 6, 1.0, 0),
    (0, 0, 1, 1, 3, 0.0, 50, 0.0, 12, 0.0, 0), (0, 0, 0, 0, 60, 0.8, 30, 0.0, 30, 0.0, 0), (0, 0, 1, 0, 3, 0.0, 60, 0.0, 60, 0.0, 0),
    (0, 0, 1, 0, 15, 0.0, 10, 0.0, 8, 0.0, 0), (0, 0, 0, 0, 6, 0.0, 4, 0.0, 0, 0.0, 0), (0, 0, 0, 0, 12, 0.0, 20, 0.0, 5, 0.0, 0),
    (0, 0, 1, 0, 9, 0.0, 0, 0.0, 0, 0.0, 0), (0, 0, 1, 0, 22, 0.0, 30, 0.0, 20, 0.0, 0), (0, 0, 1, 1, 3, 0.0, 4, 0.0, 2, 0.0, 0),
    (0, 0, 0, 0, 5, 0.0, 0, 0.0, 40, 0.0, 0), (0, 0, 0, 0, 8, 0.0, 3, 1.0, 60, 0.0, 0), (0, 0, 1, 0, 8, 0.0, 12, 0.0, 50, 0.0, 0),
    (0, 0, 0, 0, 15, 0.0, 20, 0.0, 55, 0.0, 0), (0, 0, 1, 0, 50, 0.0, 12, 0.0, 55, 0.0, 1),
    (0, 0, 1, 0, 55, 0.0, 60, 0.0, 8, 0.0, 1), (0, 0, 0, 0, 70, 0.0, 50, 0.0, 0, 0.0, 1), (0, 0, 1, 1, 4, 0.0, 12, 0.0, 60, 0.0, 1),
]
# Descriptions of blocks in the order of FEATURES, and whether the block is content.
LABELLED = [
    # inside an article: running text of any length, lists and tables; rows of links are not content
    (1, 0, 1, 1, 6, 0.0, 0, 0.0, 40, 0.0, 1), (1, 0, 1, 1, 2, 0.0, 60, 0.0, 30, 0.0, 1), (1, 0, 1, 0, 45, 0.0, 6, 0.0, 60, 0.1, 1),
    (1, 0, 1, 0, 1, 0.0, 30, 0.0, 50, 0.0, 1), (1, 0, 1, 0, 3, 0.0, 20, 0.0, 0, 0.0, 1), (1, 0, 1, 0, 30, 0.4, 25, 0.0, 30, 0.0, 1),
    (1, 0, 1, 0, 2, 0.0, 1, 0.0, 2, 0.0, 1), (1, 0, 0, 0, 12, 0.0, 30, 0.0, 10, 0.0, 1), (1, 0, 0, 0, 3, 0.0, 2, 0.0, 4, 0.0, 1),
    (1, 0, 0, 0, 80, 0.05, 5, 0.0, 70, 0.0, 1), (1, 0, 0, 0, 2, 0.0, 0, 0.0, 60, 0.0, 1), (1, 0, 1, 0, 8, 0.0, 6, 1.0, 5, 0.0, 1),
    (1, 0, 1, 0, 25, 0.0, 8, 0.0, 4, 1.0, 1), (1, 0, 1, 1, 5, 1.0, 0, 0.0, 40, 0.0, 1), (1, 0, 1, 0, 6, 0.5, 30, 0.0, 30, 0.0, 1),
    (1, 0, 1, 0, 10, 0.5, 30, 0.0, 5, 0.0, 1), (1, 0, 1, 0, 12, 0.6, 8, 0.0, 10, 0.0, 1), (1, 0, 0, 0, 15, 0.4, 20, 0.0, 4, 0.0, 1),
    (1, 0, 1, 0, 5, 0.8, 20, 0.0, 0, 0.0, 1), (1, 0, 1, 0, 20, 0.7, 6, 1.0, 7, 0.5, 1), (1, 0, 0, 0, 8, 0.6, 9, 0.6, 7, 0.6, 1),
    (1, 0, 0, 0, 3, 1.0, 3, 1.0, 3, 1.0, 0), (1, 0, 0, 0, 6, 1.0, 40, 0.0, 5, 1.0, 0), (1, 0, 0, 0, 2, 1.0, 3, 1.0, 20, 0.0, 0),
    (1, 0, 1, 0, 4, 1.0, 50, 0.0, 5, 1.0, 0), (1, 0, 1, 0, 3, 1.0, 4, 1.0, 0, 0.0, 0), (1, 0, 0, 0, 12, 1.0, 9, 1.0, 10, 1.0, 0),
    # inside a menu, footer, advert, form, notice or reader comment: nothing, however long
    (0, 1, 0, 0, 2, 1.0, 1, 1.0, 2, 1.0, 0), (0, 1, 0, 0, 9, 0.0, 40, 0.0, 0, 0.0, 0), (0, 1, 1, 0, 60, 0.0, 5, 1.0, 50, 0.0, 0),
    (0, 1, 1, 0, 12, 0.0, 10, 0.0, 11, 0.0, 0), (0, 1, 0, 0, 25, 0.0, 1, 1.0, 6, 0.0, 0), (0, 1, 1, 1, 3, 0.0, 50, 0.0, 20, 0.0, 0),
    (0, 1, 1, 0, 100, 0.1, 80, 0.0, 90, 0.0, 0), (0, 1, 1, 0, 3, 0.0, 0, 0.0, 5, 0.0, 0), (0, 1, 0, 0, 30, 0.3, 30, 0.2, 30, 0.3, 0),
    # no container says: long text with few links, and what stands between or heads it
    (0, 0, 1, 0, 40, 0.0, 35, 0.0, 50, 0.0, 1), (0, 0, 1, 0, 25, 0.1, 3, 0.0, 30, 0.0, 1), (0, 0, 0, 0, 60, 0.0, 4, 1.0, 45, 0.0, 1),
    (0, 0, 0, 0, 35, 0.15, 40, 0.0, 2, 1.0, 1), (0, 0, 1, 1, 6, 0.0, 3, 1.0, 40, 0.0, 1), (0, 0, 1, 1, 4, 0.0, 45, 0.0, 50, 0.0, 1),
    (0, 0, 1, 0, 5, 0.0, 30, 0.0, 40, 0.0, 1), (0, 0, 1, 0, 8, 0.0, 40, 0.0, 4, 1.0, 1), (0, 0, 1, 0, 6, 0.0, 7, 0.0, 30, 0.0, 1),
    (0, 0, 1, 0, 12, 0.0, 0, 0.0, 14, 0.0, 1), (0, 0, 1, 1, 5, 0.0, 0, 0.0, 25, 0.0, 1), (0, 0, 1, 0, 20, 0.0, 5, 0.0, 0, 0.0, 1),
    (0, 0, 1, 0, 4, 0.0, 35, 0.0, 0, 0.0, 1), (0, 0, 0, 0, 14, 0.0, 30, 0.0, 40, 0.0, 1), (0, 0, 1, 0, 9, 0.0, 2, 1.0, 12, 0.0, 1),
    (0, 0, 0, 0, 2, 1.0, 2, 1.0, 3, 1.0, 0), (0, 0, 0, 0, 3, 0.0, 2, 1.0, 2, 1.0, 0), (0, 0, 0, 0, 5, 0.0, 40, 0.0, 0, 0.0, 0),
    (0, 0, 0, 0, 7, 0.3, 4, 1.0, 3, 0.5, 0), (0, 0, 0, 0, 20, 0.9, 30, 0.0, 15, 0.9, 0), (0, 0, 0, 0, 4, 0.0, 3, 0.0, 5, 0.0, 0),
    (0, 0, 1, 0, 5, 1.0, 4, 1.0, 6, 1.0, 0), (0, 0, 0, 0, 12, 0.8, 40, 0.0, 0, 0.0, 0), (0, 0, 0, 0, 6, 0.5, 0, 0.0, 3, 1.0, 0),
    (0, 0, 0, 0, 8, 0.0, 50, 0.0, 4, 1.0, 0), (0, 0, 0, 0, 1, 0.0, 0, 0.0, 2, 1.0, 0), (0, 0, 1, 0, 30, 0.95, 30, 0.0, 30, 0.0, 0),
]


@dataclass
class Block:
    text: str
    words: int
    density: float
    main: int
    apart: int
    running: int
    heading: int
    element: int = 0  # 1 inside an element, not just a class, for the main text
    named: int = 0  # 1 inside an element whose names hold a word for a part set apart


def grow(rows: np.ndarray, labels: np.ndarray, least: int = 1):
    """Decision tree by Gini impurity: (feature, threshold, below, above) or a label."""
    share = labels.mean()
    if share in (0.0, 1.0) or len(labels) <= least:
        return int(share >= 0.5)
    best = None
    for f in range(rows.shape[1]):
        values = np.unique(rows[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = rows[:, f] < cut
            a, b = labels[low], labels[~low]
            impurity = len(a) * a.mean() * (1 - a.mean()) + len(b) * b.mean() * (1 - b.mean())
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, float(cut))
    if best is None:
        return int(share >= 0.5)
    low = rows[:, best[1]] < best[2]
    return best[1], best[2], grow(rows[low], labels[low], least), grow(rows[~low], labels[~low], least)


def train(table=LABELLED, named=NAMED):
    """The trees of blocks outside and inside elements with such names."""
    return tuple(grow(data[:, :-1], data[:, -1]) for data in (np.array(table, float), np.array(named, float)))


def decide(tree, row) -> int:
    while not isinstance(tree, int):
        feature, cut, below, above = tree
        tree = below if row[feature] < cut else above
    return tree


def purpose(tag: str, attributes: str, inside_main: bool) -> tuple[str, int]:
    """What an element says its content is: ``article``, ``main`` (by its class), ``apart``, or nothing; and whether
    a word for a part set apart is just in a name of it."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)} if attributes.strip() else {}
    role = found.get("role", "").lower()
    style = found.get("style", "").replace(" ", "").lower()
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style:
        return "apart", 0
    if tag in ("html", "body"):
        return "", 0
    # Ids of headings and running text name a place in it. Inside the main text, so may those of sections.
    ids = [] if tag in RUNNING else found.get("id", "").split()
    whole, words = set(), []
    for k, name in enumerate([*found.get("class", "").split(), *ids]):
        parts = {t.lower() for t in TOKENS.findall(name)}
        if not parts & BESIDES:
            words.append(parts)
            if not inside_main or k < len(found.get("class", "").split()):
                whole.add(name.lower())
    if tag in MAIN or role in MAIN_ROLES:
        if whole & OWN_WORDS:
            return "apart", 0
        return ("main", 1) if any(w & OWN_WORDS for w in words) else ("article", 0)
    if tag in APART or role in APART_ROLES or whole & APART_WORDS:
        return "apart", 0
    if (tag == "header" or whole & HEADER_WORDS) and not inside_main:
        return "apart", 0
    doubtful = APART_WORDS if inside_main else APART_WORDS | HEADER_WORDS
    named = int(any(w & doubtful for w in words))
    if tag in ("div", "section", "td") and any(w & MAIN_WORDS and not w & doubtful for w in words):
        return "main", named
    return "", named


def blocks(page: str) -> list[Block]:
    """Flat text blocks of a page in their order."""
    out: list[Block] = []
    stack: list[tuple[str, str, int]] = []  # open block-level elements with the purpose that holds inside
    parts: list[str] = []
    linked: list[str] = []
    links = 0

    def close() -> None:
        nonlocal parts, linked
        words = "".join(parts).split()
        if words:
            _, why, named = stack[-1] if stack else ("", "", 0)
            inner = next((t for t, *_ in reversed(stack) if t in RUNNING), "")
            out.append(Block(
                " ".join(words), len(words), min(1.0, len("".join(linked).split()) / len(words)), int(why in ("main", "article")), int(why == "apart"),
                int(bool(inner)), int(inner in HEADINGS), int(why == "article"), named))
        parts, linked = [], []

    def say(text: str) -> None:
        if "&" in text:
            text = html.unescape(text)
        parts.append(text)
        if links:
            linked.append(text)

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            say(page[at:m.start()])
        at = m.end()
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            if m[1]:
                say(" ")
            continue
        closing = m[2] or m[5]
        if tag == "a":
            links = 0 if closing else 1
            continue
        if tag in INLINE:
            if tag == "br":
                say(" ")
            elif not closing and purpose(tag, m[4] or m[7] or "", True)[0] == "apart":
                close()
                stack.append((tag, "apart", 0))
            elif closing and any(t == tag for t, *_ in stack):
                close()
                while stack.pop()[0] != tag:
                    pass
            continue
        close()
        if tag in VOID:
            continue
        if closing:
            if any(t == tag for t, *_ in stack):
                while stack.pop()[0] != tag:
                    pass
            continue
        if tag in RUNNING or tag in ("div", "section", "article", "ul", "ol", "table", "main", "nav", "footer", "aside", "header", "form"):
            # These end an open paragraph or heading.
            while stack and stack[-1][0] in (RUNNING - {"blockquote", "dd", "figcaption"} | INLINE):
                stack.pop()
        _, outer, outer_named = stack[-1] if stack else ("", "", 0)
        own, named = purpose(tag, m[4] or m[7] or "", outer in ("main", "article"))
        # A part set apart stays so, but an article in it counts: its container may never have been closed.
        why = own if own in ("apart", "article") or own == "main" and not outer else outer
        stack.append((tag, why, 0 if own == "article" else named or outer_named))
    if at < len(page):
        say(page[at:])
    close()
    return out


def main_text(page: str | None, tree) -> str:
    found = blocks(page or "")
    # Where a page says what its main text is, by an element or for most of its words, the rest stands apart.
    inside, outside = (sum(b.words for b in found if not b.apart and b.main == k) for k in (1, 0))
    if any(b.element for b in found) or inside > outside:
        for b in found:
            b.apart = b.apart or 1 - b.main
    edge = Block("", 0, 0.0, 0, 0, 0, 0)
    kept = []
    for before, b, after in zip([edge, *found], found, [*found[1:], edge]):
        row = (b.main, b.apart, b.running, b.heading, b.words, b.density, before.words, before.density, after.words, after.density)
        if decide(tree[b.named and not b.apart], row):
            kept.append(b.text)
    return "\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: ``page_id url text n_chars``."""
    tree = train()
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [main_text(h, tree) for h in batch.column(2).to_pylist()]
            return pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

        return work

    return map_texts(pages.select("page_id", "url", "html"), "html", f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long", make)
