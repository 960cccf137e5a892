"""Main text of web pages from flat text blocks.

A page becomes a flat sequence of text blocks. Each block has its number of words and its link density, those of the
blocks before and after it, and where it stands (inside an element that is the article, inside one that is not). A decision
tree, fitted on a small table of labelled blocks, says which blocks are main text.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML and words that pages use in class and id.
RAW = "script|style|noscript|template|iframe|svg|annotation-xml|annotation|textarea|select|object|canvas|audio|video|title"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
NOT_ARTICLE = frozenset("nav footer aside form menu dialog button search".split())
ROLES_OUT = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
HINTS_OUT = frozenset("ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs sidebar footer header masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget comment comments disqus reply replies respond form search pagination pager copyright legal disclaimer skip toolbar teaser".split())
HINTS_COMMENT = frozenset("comment comments reply replies related ad ads advert promo sponsored teaser".split())
HINTS_IN = frozenset("article content main story".split())
#: A hint after one of these says something about another element.
SWITCHES = frozenset("has with no without is".split())

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<svg(?![\w:-])[^>]*/>|<(?P<raw>{RAW})(?![\w:-])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<more>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*)>|<[!?][^>]*>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
HINT_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    text: str
    words: int
    link_words: int
    outside: bool  # in an element that is not the article
    inside: bool  # in an element that is


def _place(tag: str, more: str, in_main: bool) -> tuple[bool, bool, bool]:
    """(outside, inside, soft) that an element says of its content; soft: outside by words in class or id that do not hold for an article."""
    outside, inside, hidden, hints = tag in NOT_ARTICLE or tag == "header" and not in_main, tag in ("article", "main"), False, []
    for name, value in ATTRIBUTE.findall(more) if more else ():
        name, value = name.lower(), value.strip("\"'")
        if name == "role":
            outside |= value.lower() in ROLES_OUT
            inside |= value.lower() in ("main", "article")
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            hidden = True
        elif name in ("class", "id"):
            for one in value.split():
                found = [w.lower() for w in HINT_WORD.findall(one)]
                hints += [w for i, w in enumerate(found) if not (i and found[i - 1] in SWITCHES)]
    soft = False
    if hints and tag not in ("html", "body"):
        known = (HINTS_COMMENT if inside else HINTS_OUT) - ({"header"} if in_main else set())
        soft = not (outside or hidden or any(w in HINTS_COMMENT for w in hints))
        outside |= any(w in known for w in hints)
        inside |= not outside and any(w in HINTS_IN for w in hints)
    return outside or hidden, inside and not outside, outside and soft


def _tail(rest: str) -> str:
    """What follows the last token, up to markup that is cut off."""
    return rest[: rest.index("<")] if re.search(r"<[a-z/!]", rest, re.I) and "<" in rest else rest


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order; scripts, styles, comments and markup are gone, white space is one space."""
    found: list[Block] = []
    stack: list[tuple[str, int, bool, int]] = []
    pieces: list[str] = []
    link_pieces: list[str] = []
    n_out = n_soft = n_in = links = at = 0

    def flush() -> None:
        nonlocal pieces, link_pieces
        text = " ".join(entities.unescape("".join(pieces)).split())
        if text:
            words = text.count(" ") + 1
            linked = len(entities.unescape(" ".join(link_pieces)).split()) if link_pieces else 0
            found.append(Block(text, words, min(words, linked), n_out > 0, n_in > 0))
        pieces, link_pieces = [], []

    def close(i: int) -> None:
        nonlocal n_out, n_soft, n_in, links
        for _, outside, inside, soft in stack[i:]:
            n_out -= outside
            n_in -= inside
            n_soft -= soft
        del stack[i:]
        links = 0

    def say(text: str) -> None:
        pieces.append(text)
        if links:
            link_pieces.append(text)

    for m in TOKEN.finditer(page):
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "a":
            links = 0 if m["end"] else 1
        elif tag == "br":
            pieces.append(" ")
        elif tag in BLOCK:
            flush()
            if m["end"]:
                i = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)
                if i >= 0:
                    close(i)
            else:
                if stack and (stack[-1][0] == "p" or tag == "li" and stack[-1][0] == "li"):
                    close(len(stack) - 1)
                if tag not in VOID:
                    outside, inside, soft = _place(tag, m["more"], n_in > 0)
                    if tag in ("article", "main") and not outside and n_out == n_soft:
                        outside = soft = -n_out  # what stands around it is outside by a hint alone
                    stack.append((tag, outside, inside, soft))
                    n_out += outside
                    n_in += inside
                    n_soft += soft
    if at < len(page):
        say(_tail(page[at:]))
    flush()
    return found


def texts(page: str) -> list[str]:
    """The text of each of the page's blocks, without what tells main text from the rest."""
    found: list[str] = []
    pieces: list[str] = []
    at = 0

    def flush() -> None:
        text = "".join(pieces)
        pieces.clear()
        text = " ".join((entities.unescape(text) if "&" in text else text).split())
        if text:
            found.append(text)

    for m in TOKEN.finditer(page):
        start, end = m.span()
        if start > at:
            pieces.append(page[at:start])
        at = end
        tag = m["tag"]
        if tag is None:
            continue
        kind = tag if tag in BLOCK else tag.lower()  # names are mostly written small
        if kind == "br":
            pieces.append(" ")
        elif pieces and kind in BLOCK:
            if len(pieces) == 1 and pieces[0].isspace():
                pieces.clear()
            else:
                flush()
    if at < len(page):
        pieces.append(_tail(page[at:]))
    flush()
    return found


FEATURES = ("words", "link density", "words before", "link density before", "words after", "link density after", "outside", "place")


def features(page_blocks: list[Block]) -> np.ndarray:
    """A row per block; place is 1 inside the article, 0 on a page that marks none, -1 elsewhere on a page that does."""
    n = np.array([b.words for b in page_blocks], float)
    density = np.array([b.link_words / b.words for b in page_blocks], float)
    marked = any(b.inside for b in page_blocks)
    place = np.array([1 if b.inside else -1 if marked else 0 for b in page_blocks], float)
    outside = np.array([b.outside for b in page_blocks], float)
    shift = lambda v, k: np.concatenate([[0.0], v[:-1]]) if k < 0 else np.concatenate([v[1:], [0.0]])
    return np.stack([n, density, shift(n, -1), shift(density, -1), shift(n, 1), shift(density, 1), outside, place], axis=1)


#: Labelled blocks: the features above, then 1 for main text. Written by hand from typical pages.
LABELLED = (
    # paragraphs and headings in a marked article, among others
    (80, 0.0, 60, 0.0, 90, 0.0, 0, 1, 1), (45, 0.05, 12, 0.0, 70, 0.1, 0, 1, 1), (9, 0.0, 0, 0.0, 80, 0.0, 0, 1, 1),
    (2, 0.0, 30, 0.0, 40, 0.0, 0, 1, 1), (1, 0.0, 3, 0.0, 2, 0.0, 0, 1, 1), (1, 0.0, 4, 0.0, 8, 0.0, 0, 1, 1),
    (12, 0.0, 6, 1.0, 55, 0.0, 0, 1, 1), (300, 0.02, 12, 0.0, 10, 0.0, 0, 1, 1), (25, 0.3, 40, 0.0, 30, 0.2, 0, 1, 1),
    (20, 0.0, 3, 0.0, 5, 0.0, 0, 1, 1), (4, 0.0, 7, 0.0, 6, 0.0, 0, 1, 1), (60, 0.0, 2, 0.0, 1, 0.0, 0, 1, 1), (8, 0.0, 90, 0.0, 3, 0.0, 0, 1, 1),
    (33, 0.0, 0, 0.0, 0, 0.0, 0, 1, 1), (2, 0.0, 2, 0.0, 5, 1.0, 0, 1, 1), (13, 0.0, 150, 0.0, 0, 0.0, 0, 1, 1), (10, 0.2, 5, 0.0, 4, 0.0, 0, 1, 1),
    (7, 0.0, 10, 0.0, 8, 1.0, 0, 1, 1), (3, 0.0, 1, 1.0, 1, 0.0, 0, 1, 1), (5, 0.0, 9, 0.0, 0, 0.0, 0, 1, 1),
    (18, 0.5, 40, 0.0, 60, 0.0, 0, 1, 1), (40, 0.6, 30, 0.1, 50, 0.0, 0, 1, 1), (6, 1.0, 50, 0.0, 70, 0.0, 0, 1, 1),
    (4, 1.0, 22, 0.0, 35, 0.1, 0, 1, 1), (14, 0.0, 20, 0.0, 11, 0.0, 0, 1, 1), (1, 0.0, 0, 0.0, 0, 0.0, 0, 1, 1),
    (1, 0.0, 12, 0.0, 3, 1.0, 0, 1, 1), (4, 0.0, 60, 0.0, 2, 1.0, 0, 1, 1), (9, 0.0, 0, 0.0, 5, 1.0, 0, 1, 1), (16, 0.1, 33, 0.0, 4, 1.0, 0, 1, 1),
    (50, 0.4, 45, 0.0, 6, 1.0, 0, 1, 1), (110, 0.35, 20, 0.0, 2, 1.0, 0, 1, 1), (38, 0.45, 3, 1.0, 3, 1.0, 0, 1, 1), (3, 0.0, 2, 1.0, 4, 1.0, 0, 1, 1),
    (2, 0.0, 5, 0.0, 1, 1.0, 0, 1, 1), (70, 0.0, 9, 0.0, 8, 1.0, 0, 1, 1), (6, 0.2, 4, 0.0, 7, 1.0, 0, 1, 1), (28, 0.3, 1, 1.0, 3, 1.0, 0, 1, 1),
    # lists of links inside a marked article
    (3, 1.0, 4, 1.0, 2, 1.0, 0, 1, 0), (5, 1.0, 3, 1.0, 6, 1.0, 0, 1, 0), (2, 1.0, 2, 1.0, 3, 1.0, 0, 1, 0), (8, 1.0, 9, 1.0, 7, 1.0, 0, 1, 0),
    # in elements that are not the article, marked article around or not
    (6, 0.0, 1, 1.0, 9, 0.0, 1, -1, 0), (40, 0.0, 30, 0.0, 50, 0.0, 1, 1, 0), (120, 0.0, 80, 0.0, 60, 0.0, 1, 1, 0), (1, 1.0, 1, 1.0, 1, 1.0, 1, -1, 0),
    (25, 0.0, 12, 0.0, 30, 0.0, 1, 0, 0), (60, 0.0, 45, 0.0, 20, 0.0, 1, 0, 0), (3, 1.0, 2, 1.0, 4, 1.0, 1, 0, 0), (9, 0.0, 70, 0.0, 0, 0.0, 1, -1, 0),
    (15, 0.0, 7, 0.0, 0, 0.0, 1, 0, 0), (200, 0.01, 30, 0.0, 8, 0.0, 1, -1, 0), (2, 0.0, 9, 0.0, 3, 0.0, 1, 1, 0), (1, 0.0, 0, 0.0, 5, 0.0, 1, 0, 0),
    (7, 0.0, 1, 1.0, 11, 0.0, 1, -1, 0), (12, 0.0, 90, 0.0, 0, 0.0, 1, -1, 0), (18, 0.0, 3, 1.0, 75, 0.0, 1, 0, 0), (35, 0.2, 4, 1.0, 150, 0.0, 1, -1, 0),
    (55, 0.0, 0, 0.0, 64, 0.0, 1, 0, 0), (8, 0.0, 110, 0.0, 34, 0.0, 1, 1, 0), (14, 0.0, 28, 0.0, 90, 0.0, 1, 1, 0), (85, 0.0, 52, 0.0, 41, 0.0, 1, 0, 0),
    (5, 0.0, 66, 0.0, 48, 0.0, 1, 0, 0), (3, 0.0, 45, 0.0, 2, 0.0, 1, 1, 0), (22, 0.0, 19, 0.0, 37, 0.0, 1, -1, 0), (300, 0.0, 5, 0.0, 120, 0.0, 1, -1, 0),
    (10, 0.0, 0, 0.0, 33, 0.0, 1, -1, 0), (47, 0.1, 58, 0.0, 39, 0.0, 1, 0, 0), (4, 0.0, 2, 0.0, 80, 0.0, 1, 0, 0), (65, 0.0, 70, 0.0, 95, 0.0, 1, 1, 0),
    (16, 0.0, 1, 0.0, 44, 0.0, 1, 1, 0), (28, 0.0, 8, 0.0, 0, 0.0, 1, -1, 0), (6, 0.0, 40, 0.0, 62, 0.0, 1, 1, 0), (90, 0.0, 11, 0.0, 10, 0.0, 1, 1, 0),
    # outside the marked article, without a hint
    (12, 0.0, 1, 1.0, 9, 0.0, 0, -1, 0), (50, 0.0, 3, 0.0, 60, 0.0, 0, -1, 0), (3, 1.0, 3, 1.0, 2, 1.0, 0, -1, 0), (90, 0.1, 90, 0.0, 5, 0.0, 0, -1, 0),
    (20, 0.0, 35, 0.0, 45, 0.0, 0, -1, 0), (5, 0.0, 50, 0.0, 70, 0.0, 0, -1, 0), (38, 0.0, 0, 0.0, 52, 0.0, 0, -1, 0), (11, 0.0, 3, 1.0, 100, 0.0, 0, -1, 0),
    (65, 0.0, 40, 0.0, 33, 0.0, 0, -1, 0), (8, 0.0, 28, 0.0, 36, 0.0, 0, -1, 0), (110, 0.0, 75, 0.0, 80, 0.0, 0, -1, 0), (16, 0.0, 9, 0.0, 42, 0.0, 0, -1, 0),
    (7, 0.0, 80, 0.0, 0, 0.0, 0, -1, 0), (30, 0.0, 60, 0.0, 25, 0.0, 0, -1, 0), (1, 0.0, 2, 0.0, 9, 0.0, 0, -1, 0), (150, 0.0, 0, 0.0, 0, 0.0, 0, -1, 0),
    # pages without any mark: long blocks with few links, and short ones next to them
    (60, 0.0, 40, 0.0, 70, 0.0, 0, 0, 1), (25, 0.1, 60, 0.0, 30, 0.0, 0, 0, 1), (18, 0.0, 3, 1.0, 45, 0.0, 0, 0, 1), (120, 0.05, 2, 1.0, 3, 1.0, 0, 0, 1),
    (35, 0.2, 20, 0.0, 2, 1.0, 0, 0, 1), (6, 0.0, 50, 0.0, 60, 0.0, 0, 0, 1), (8, 0.0, 2, 1.0, 40, 0.0, 0, 0, 1), (3, 0.0, 45, 0.0, 38, 0.0, 0, 0, 1),
    (11, 0.0, 30, 0.0, 22, 0.0, 0, 0, 1), (16, 0.3, 25, 0.0, 33, 0.0, 0, 0, 1), (5, 0.0, 0, 0.0, 64, 0.0, 0, 0, 1), (20, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1),
    (2, 1.0, 3, 1.0, 2, 1.0, 0, 0, 0), (4, 1.0, 2, 1.0, 30, 0.0, 0, 0, 0), (3, 0.0, 2, 1.0, 4, 1.0, 0, 0, 0), (5, 0.0, 40, 0.0, 3, 1.0, 0, 0, 0),
    (7, 1.0, 0, 0.0, 5, 1.0, 0, 0, 0), (20, 0.9, 18, 0.8, 25, 0.9, 0, 0, 0), (30, 0.7, 3, 1.0, 28, 0.8, 0, 0, 0), (4, 0.0, 5, 0.0, 3, 0.0, 0, 0, 0),
    (6, 0.5, 30, 0.0, 4, 1.0, 0, 0, 0), (2, 0.0, 3, 1.0, 2, 0.0, 0, 0, 0), (9, 0.0, 50, 0.0, 0, 0.0, 0, 0, 0), (1, 0.0, 1, 1.0, 1, 1.0, 0, 0, 0),
)


@dataclass(frozen=True)
class Tree:
    """Leaf: ``feature`` is -1 and ``value`` the class; else rows at or below ``value`` go to ``low``."""

    feature: int
    value: float
    low: Tree | None = None
    high: Tree | None = None

    def classify(self, rows: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(rows), self.value)
        out, low = np.empty(len(rows)), rows[:, self.feature] <= self.value
        out[low] = self.low.classify(rows[low])
        out[~low] = self.high.classify(rows[~low])
        return out


def fit_tree(table=LABELLED, depth: int = 8) -> Tree:
    """Greedy splits by Gini impurity; ties go to the first feature and the lowest cut."""
    table = np.array(table, float)

    def grow(rows: np.ndarray, left: int) -> Tree:
        share = rows[:, -1].mean()
        if left == 0 or share in (0.0, 1.0):
            return Tree(-1, float(share >= 0.5))
        best = None
        for f in range(rows.shape[1] - 1):
            values = np.unique(rows[:, f])
            for cut in (values[:-1] + values[1:]) / 2:
                low = rows[:, f] <= cut
                impurity = sum(part.sum() * p * (1 - p) for part in (low, ~low) for p in (rows[part, -1].mean(),))
                if best is None or impurity < best[0] - 1e-12:
                    best = (impurity, f, float(cut))
        if best is None:
            return Tree(-1, float(share >= 0.5))
        low = rows[:, best[1]] <= best[2]
        return Tree(best[1], best[2], grow(rows[low], left - 1), grow(rows[~low], left - 1))

    return grow(table, depth)


def main_text(page: str | None, tree: Tree) -> tuple[str, int, int]:
    """(main text, its blocks, all blocks)."""
    found = blocks(page) if page else []
    if not found:
        return "", 0, 0
    kept = [b.text for b, keep in zip(found, tree.classify(features(found))) if keep]
    return "\n\n".join(kept), len(kept), len(found)


def extract(pages: DataFrame, tree: Tree, keep: tuple[str, ...] = ("page_id", "url"), html: str = "html") -> DataFrame:
    """Columns ``keep``, then text, n_chars, n_blocks (of the text) and n_all_blocks, for every row.

    A null or empty page, or one without main text, has an empty text. Whole pages are read, whatever their length; repeated
    rows each get a row.
    """
    chosen = pages.select(F.col(html).alias("__html"), *keep)

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [main_text(p, tree) for p in batch.column(0).to_pylist()]
            texts = [r[0] for r in rows]
            more = [pa.array(texts, pa.string()), *(pa.array(c, pa.int64()) for c in (list(map(len, texts)), [r[1] for r in rows], [r[2] for r in rows]))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *more], [*batch.schema.names[1:], "text", "n_chars", "n_blocks", "n_all_blocks"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema[1:])
    return chosen.mapInArrow(convert, f"{fields}, text string, n_chars long, n_blocks long, n_all_blocks long")
