"""Main text of HTML pages: flat text blocks, classified by a decision tree.

A page is cut at block-level tags into flat blocks of text. A block's features are
its words and link density, those of the blocks before and after it, and the mark
of the elements around it: -1 where one of them is page furniture (by its name,
class, id or role; what lies in furniture is furniture, whatever it calls itself),
1 in an element that names itself main text, 0 where nothing is said. A decision
tree grown on the labelled table below says which blocks are main text.

Names in class and id count by whole words between spaces. Of a word in parts
("site-header") the last part that is known decides, and layout modifiers
("has-sidebar", "no-ads") say nothing. A header that stands in main text keeps its
title. What is hidden (hidden, aria-hidden, display:none, visibility:hidden) and
inline furniture (a span of an advert) give no text.

Edge cases: null, empty and text-free pages give an empty text; unclosed elements
end where their container ends; an unclosed comment or script runs to the end of
the page; what is not a tag is text; repeated rows give the same result each;
other columns are not looked at.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skipscan.llm.common import batch_of, small_batches, table, text_bytes

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "mark")

#: (features, 1 if main text): blocks as they stand on pages, labelled by hand.
#: Neighbours beyond the page's ends have 0 words.
LABELLED = [
    # marked as main text: kept at any length, unless it is a list of links
    ((1, 0, 0, 0, 12, 0, 1), 1), ((11, 0, 0, 0, 40, 0, 1), 1), ((1, 0, 60, 0, 55, 0, 1), 1), ((2, 0, 30, 0, 8, 0, 1), 1), ((6, 0, 4, 0, 0, 0, 1), 1),
    ((120, 0, 8, 0, 60, 0, 1), 1), ((80, 0.1, 40, 0, 35, 0.2, 1), 1), ((45, 0.05, 8, 0, 14, 0, 1), 1), ((9, 0, 120, 0, 16, 0, 1), 1), ((24, 0.4, 50, 0, 80, 0, 1), 1),
    ((4, 0, 1, 1, 22, 0, 1), 1), ((13, 0, 4, 1, 31, 0, 1), 1), ((35, 0, 70, 0, 9, 1, 1), 1), ((3, 0.3, 33, 0, 41, 0, 1), 1), ((15, 0.5, 20, 0, 18, 0, 1), 1),
    ((1, 0, 9, 0, 15, 0, 1), 1), ((7, 0, 11, 0, 13, 0, 1), 1), ((300, 0, 10, 0, 10, 0, 1), 1), ((18, 0, 2, 0, 2, 0, 1), 1), ((2, 0, 2, 0, 2, 0, 1), 1),
    ((2, 1, 30, 0, 2, 1, 1), 0), ((3, 1, 2, 1, 2, 1, 1), 0), ((4, 1, 3, 1, 12, 0, 1), 0), ((1, 1, 1, 1, 1, 1, 1), 0), ((6, 0.95, 4, 1, 4, 1, 1), 0),
    # marked as furniture: dropped at any length
    ((1, 1, 0, 0, 1, 1, -1), 0), ((2, 1, 1, 1, 1, 1, -1), 0), ((1, 1, 1, 1, 8, 0, -1), 0), ((12, 0, 1, 1, 10, 0, -1), 0), ((8, 0, 1, 1, 11, 0, -1), 0),
    ((30, 0, 20, 0, 40, 0, -1), 0), ((90, 0, 60, 0, 2, 0, -1), 0), ((150, 0, 70, 0, 0, 0, -1), 0), ((16, 0, 55, 0, 0, 0, -1), 0), ((9, 0.1, 80, 0, 0, 0, -1), 0),
    ((45, 0.3, 10, 0, 12, 0, -1), 0), ((5, 0, 5, 0, 5, 0, -1), 0), ((25, 0.6, 90, 0, 30, 0.5, -1), 0), ((60, 0, 45, 0, 52, 0, -1), 0), ((3, 0, 25, 0, 25, 0, -1), 0),
    ((40, 0, 30, 0, 35, 0, -1), 0), ((25, 0, 70, 0, 60, 0, -1), 0), ((18, 0, 12, 0, 22, 0, -1), 0), ((200, 0, 150, 0, 120, 0, -1), 0), ((70, 0.1, 2, 1, 90, 0, -1), 0),
    ((35, 0, 120, 0, 14, 0, -1), 0), ((8, 0, 40, 0, 50, 0, -1), 0), ((110, 0, 18, 0, 16, 0, -1), 0), ((55, 0, 0, 0, 70, 0, -1), 0), ((14, 0, 90, 0, 33, 0, -1), 0),
    ((28, 0, 28, 0, 28, 0, -1), 0), ((65, 0, 9, 0, 44, 0, -1), 0), ((20, 0, 200, 0, 1, 0, -1), 0), ((80, 0, 33, 0, 8, 0, -1), 0), ((22, 0.2, 48, 0, 75, 0, -1), 0),
    # the end of main text
    ((40, 0, 120, 0, 0, 0, 1), 1), ((20, 0, 60, 0, 2, 0, 1), 1), ((90, 0, 200, 0, 5, 0, 1), 1), ((33, 0, 75, 0, 4, 0.5, 1), 1), ((6, 0, 80, 0, 1, 1, 1), 1),
    # nothing said: long text with few links is main text, and so is short text among it
    ((60, 0, 8, 0, 45, 0, 0), 1), ((45, 0.05, 60, 0, 70, 0.1, 0), 1), ((25, 0, 30, 0, 22, 0, 0), 1), ((32, 0.2, 4, 1, 50, 0, 0), 1), ((18, 0, 3, 1, 40, 0, 0), 1),
    ((120, 0.1, 0, 0, 0, 0, 0), 1), ((200, 0, 2, 1, 3, 1, 0), 1), ((16, 0, 28, 0, 3, 1, 0), 1), ((22, 0.1, 45, 0, 2, 1, 0), 1), ((8, 0, 40, 0, 35, 0, 0), 1),
    ((3, 0, 50, 0, 60, 0, 0), 1), ((10, 0, 3, 1, 55, 0, 0), 1), ((6, 0, 25, 0, 30, 0, 0), 1), ((12, 0, 22, 0, 19, 0, 0), 1), ((90, 0.25, 30, 0, 6, 1, 0), 1),
    ((1, 1, 0, 0, 1, 1, 0), 0), ((2, 1, 2, 1, 2, 1, 0), 0), ((4, 1, 3, 1, 40, 0, 0), 0), ((3, 1, 50, 0, 2, 1, 0), 0), ((12, 0.9, 5, 1, 6, 1, 0), 0),
    ((25, 0.8, 30, 0.7, 28, 0.9, 0), 0), ((40, 0.7, 12, 1, 9, 1, 0), 0), ((3, 0, 2, 1, 2, 1, 0), 0), ((5, 0, 4, 0.5, 2, 0, 0), 0), ((2, 0, 0, 0, 3, 1, 0), 0),
    ((7, 0.5, 3, 1, 4, 0.8, 0), 0), ((6, 0, 5, 0, 4, 0, 0), 0), ((8, 0.2, 3, 1, 0, 0, 0), 0), ((4, 0, 6, 0.6, 0, 0, 0), 0), ((9, 0.8, 45, 0, 50, 0, 0), 0),
    ((5, 0, 60, 0, 3, 1, 0), 0), ((6, 0, 45, 0, 0, 0, 0), 0), ((4, 1, 60, 0, 70, 0, 0), 0), ((30, 0.9, 80, 0, 60, 0, 0), 0), ((1, 0, 1, 1, 1, 1, 0), 0),
    # nothing said: what is around decides about short and middling text
    ((7, 0, 24, 0, 33, 0, 0), 1), ((5, 0, 18, 0, 44, 0, 0), 1), ((2, 0, 36, 0, 27, 0, 0), 1), ((9, 0, 70, 0, 15, 0, 0), 1), ((12, 0, 31, 0, 12, 0, 0), 1),
    ((11, 0, 16, 0, 20, 0, 0), 1), ((4, 0, 42, 0, 90, 0, 0), 1), ((8, 0, 2, 1, 38, 0, 0), 1), ((6, 0, 1, 1, 64, 0, 0), 1), ((13, 0, 52, 0, 6, 0, 0), 1),
    ((9, 0, 2, 1, 1, 1, 0), 0), ((11, 0, 3, 1, 2, 1, 0), 0), ((8, 0, 1, 1, 0, 0, 0), 0), ((12, 0, 4, 0.9, 3, 1, 0), 0), ((14, 0, 1, 1, 2, 1, 0), 0),
    ((6, 0, 3, 1, 5, 0.6, 0), 0), ((7, 0, 40, 0, 2, 1, 0), 0), ((4, 0, 28, 0, 1, 1, 0), 0), ((10, 0, 8, 0.8, 4, 0, 0), 0), ((5, 0, 9, 0, 0, 0, 0), 0),
    ((60, 0, 80, 0, 0, 0, 0), 1), ((34, 0, 110, 0, 3, 1, 0), 1), ((75, 0.1, 64, 0, 2, 0, 0), 1), ((26, 0, 90, 0, 5, 1, 0), 1), ((19, 0, 38, 0, 26, 0, 0), 1),
    ((17, 0.1, 3, 1, 30, 0, 0), 1), ((28, 0, 2, 1, 11, 0, 0), 1), ((35, 0.1, 1, 1, 2, 1, 0), 1), ((50, 0, 0, 0, 3, 0, 0), 1), ((22, 0, 14, 0, 1, 1, 0), 1),
]

#: What element names and words in class, id and role say.
FURNITURE_TAGS = frozenset("nav header footer aside form head dialog button select fieldset menu iframe noscript".split())
MAIN_TAGS = frozenset("article main".split())
FURNITURE_WORDS = frozenset(
    "nav navbar navigation menu header footer sidebar aside ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices popup modal overlay share sharing social comment comments reply replies respond disqus related recommended breadcrumb breadcrumbs widget newsletter subscribe signup login search form pagination pager toolbar copyright legal masthead skip complementary contentinfo alert dialog".split()
)
MAIN_WORDS = frozenset("article articlebody content main post entry story".split())
#: First parts of words that tell how a page is laid out and not what the element is.
LAYOUT_PARTS = frozenset("has no with without is js wp col row hide show".split())

BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: Blocks that end where the next of their kind, or their container, begins or ends.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr option legend caption figcaption summary".split())
VOID = frozenset("hr".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style|title|textarea|template|svg|math|object|audio|video|canvas)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|</?[a-z][^>]*+>|<[!?][^>]*+>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|style|aria-hidden)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
BARE_HIDDEN = re.compile(r"(?<![\w-])hidden(?![\w-])", re.I)
QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")


def grow(rows: list[tuple[tuple, int]], depth: int = 7) -> tuple | int:
    """A tree (feature, threshold, at most, above) or a label, by Gini impurity."""
    ones = sum(y for _, y in rows)
    if depth == 0 or ones in (0, len(rows)):
        return int(2 * ones >= len(rows))

    def impurity(part: list) -> float:
        p = sum(y for _, y in part) / len(part)
        return 2 * p * (1 - p) * len(part)

    best = None
    for f in range(len(rows[0][0])):
        values = sorted({x[f] for x, _ in rows})
        for a, b in zip(values, values[1:], strict=False):
            low = [r for r in rows if r[0][f] <= (a + b) / 2]
            high = [r for r in rows if r[0][f] > (a + b) / 2]
            cost = impurity(low) + impurity(high)
            if best is None or cost < best[0] - 1e-12:
                best = cost, f, (a + b) / 2, low, high
    if best is None:
        return int(2 * ones >= len(rows))
    return best[1], best[2], grow(best[3], depth - 1), grow(best[4], depth - 1)


def classify(tree: tuple | int, x: tuple) -> int:
    while not isinstance(tree, int):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def said_by(word: str) -> int:
    """What a word of a class, id or role says: -1 furniture, 1 main text, 0 nothing."""
    parts = [p.lower() for p in NAME_PART.findall(word)]
    if not parts or parts[0] in LAYOUT_PARTS:
        return 0
    for p in reversed(parts):
        if p in FURNITURE_WORDS:
            return -1
        if p in MAIN_WORDS:
            # "comment-content" is about a comment, "post-content" is not
            return -1 if any(q in FURNITURE_WORDS for q in parts) and p not in MAIN_TAGS else 1
    return 0


def mark_of(tag: str, attributes: str, around: int) -> int:
    """The mark in an element, from the one around it; HIDDEN_MARK where it is not shown."""
    said = -1 if tag in FURNITURE_TAGS else 1 if tag in MAIN_TAGS else 0
    if tag == "header" and around > 0:
        said = 0
    if attributes:
        if BARE_HIDDEN.search(QUOTED.sub("", attributes)):
            return HIDDEN_MARK
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "style":
                if HIDDEN.search(value):
                    return HIDDEN_MARK
            elif name == "aria-hidden":
                if value.lower() == "true":
                    return HIDDEN_MARK
            elif tag not in ("html", "body", "form"):
                told = [said_by(w) for w in value.split()]
                if -1 in told:
                    return -1
                said = said or max(told, default=0)
    if tag == "main" or (tag == "form" and around == 0):
        # a form may hold a whole page, whose main text says so; main in furniture alone is not believed
        return around if around < 0 and around != FORM_MARK else FORM_MARK if tag == "form" else 1
    if around == FORM_MARK:
        return said if said > 0 and tag in MAIN_TAGS else FORM_MARK
    return -1 if around < 0 else said or around


#: Not shown; and in a form, which is furniture unless its content says otherwise.
HIDDEN_MARK, FORM_MARK = -3, -2
INLINE = frozenset("span a b i u s em strong small big font ins del mark label code q sub sup cite abbr time data".split())


def blocks(page: str) -> list[tuple[str, int, int, int]]:
    """(text, words, words in links, mark) of each flat block with text, in page order."""
    out: list[tuple[str, int, int, int]] = []
    stack: list[tuple[str, int]] = []  # open block elements with the mark that holds in them
    parts: list[str] = []
    linked: list[str] = []
    in_link = at = 0
    muted, depth = "", 0  # the inline element whose text is left out, and how many of its name are open

    def end_block() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            mark = stack[-1][1] if stack else 0
            if text and mark != HIDDEN_MARK:
                out.append((text, text.count(" ") + 1, len("".join(linked).split()), max(mark, -1)))
            parts.clear()
            linked.clear()

    def add(raw: str) -> None:
        if muted:
            return
        text = entities.unescape(raw)
        parts.append(text)
        if in_link:
            linked.append(text + " ")

    for m in TOKEN.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if not (tag := m[3]):
            continue
        tag, closes = tag.lower(), bool(m[2])
        if muted:
            depth += 0 if tag != muted else -1 if closes else 1
            if depth and tag not in BLOCK_TAGS:
                continue
            muted = ""  # closed, or never closed and a block follows
            if tag not in BLOCK_TAGS:
                continue
        if tag in INLINE and not closes and m[4] and mark_of(tag, m[4], 0) < 0:
            muted, depth = tag, 1
        elif tag == "a":
            in_link = 0 if closes else 1
        elif tag == "br":
            parts.append(" ")
        elif tag in BLOCK_TAGS:
            end_block()
            if closes:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        in_link = 0
                        break
            elif tag not in VOID:
                if tag in LEAVES:
                    while stack and stack[-1][0] in LEAVES and (stack[-1][0] == tag or stack[-1][0] in ("p", "dt", "dd", "option") or stack[-1][0][0] == "h"):
                        stack.pop()
                elif stack and stack[-1][0] == "p":
                    stack.pop()
                around = stack[-1][1] if stack else 0
                stack.append((tag, HIDDEN_MARK if around == HIDDEN_MARK else mark_of(tag, m[4], around)))
    if at < len(page):
        add(page[at:])
    end_block()
    return out


def main_text(page: str, tree: tuple | int) -> str:
    found = blocks(page)
    shape = [(0, 0.0), *((n, min(1.0, k / n)) for _, n, k, _ in found), (0, 0.0)]
    return " ".join(b[0] for i, b in enumerate(found) if classify(tree, (*shape[i + 1], *shape[i], *shape[i + 2], b[3])))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for each row of pages."""
    small_batches(pages.sparkSession)
    tree = grow(LABELLED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py().decode("utf-8", "replace"), tree) for x in b.column("html")]
            yield batch_of(page_id=b.column("page_id"), url=b.column("url"), text=pa.array(texts, pa.string()), n_chars=pa.array([len(t) for t in texts], pa.int64()))

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_bytes("html").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op2(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
