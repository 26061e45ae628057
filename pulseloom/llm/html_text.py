"""Main text of web pages: flat blocks, classified by a decision tree.

A page becomes flat text blocks in page order; only scripts, styles and the like,
and what isn't shown, have none. Each block has its word count and link density,
those of both neighbours, and what the containers around it declare: whether one
is the main part, and whether one within or around that is furniture (a menu, a
sidebar, an advert, reader comments ...). A decision tree over these nine,
trained on the small labelled table below, says which blocks are main text: a
declaration alone decides nothing, since an article can stand in a "widget" and
an advert can be as long and as free of links as an article.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that are kept on the stack of open containers; their ends close what is open within them.
CONTAINER = frozenset("address article aside blockquote body button details dialog div dl fieldset figure footer form header main menu nav ol pre section select table ul".split())
#: Elements whose content is never text of the page.
RAW = frozenset("script style title textarea iframe noscript noembed noframes xmp template svg canvas object math audio video".split())
FURNITURE = frozenset("nav footer aside form menu dialog button select header fieldset".split())
FURNITURE_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|side-?bar|cookies?|consent|gdpr|notice|alert|pop-?up|modal|overlay|newsletter|subscribe|signup|sign-in|login|"
    r"nav|navbar|navigation|menu|breadcrumbs?|foot|footer|header|masthead|toolbar|pager|pagination|share|sharing|social|related|recommend\w*|comments?|comment-\w+|replies|disqus|widget|skip|hidden)(?:$|[\s_-])",
    re.I,
)
MAIN_NAME = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|main|content|body-?text|article-?body)(?:$|[\s_-])", re.I)
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^'">]|"[^"]*"|'[^']*')*+)>""")
NAMED = re.compile(r"""(?:^|[\s"'])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
UNSEEN = re.compile(r"""(?:^|[\s"'])(?:hidden(?=$|[\s/>=])|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)

FEATURES = ("prev_words", "prev_links", "words", "links", "next_words", "next_links", "main", "within", "around")

# The labelled table: blocks of pages as a reader sees them, by the first six FEATURES; the last value is 1 for main text.
# These are of pages that declare nothing.
PLAIN = (
    # articles: paragraphs, headings, one-word lines, quotes, captions; also articles of one or two short lines
    (0, 0.0, 9, 0.0, 80, 0.0, 1), (9, 0.0, 80, 0.0, 60, 0.05, 1), (80, 0.0, 60, 0.05, 1, 0.0, 1), (60, 0.05, 1, 0.0, 40, 0.0, 1), (1, 0.0, 40, 0.0, 3, 0.0, 1),
    (40, 0.0, 3, 0.0, 150, 0.02, 1), (3, 0.0, 150, 0.02, 12, 0.1, 1), (150, 0.02, 12, 0.1, 7, 0.0, 1), (12, 0.1, 7, 0.0, 0, 0.0, 1), (2, 0.0, 2, 0.0, 9, 0.2, 1),
    (5, 0.0, 1, 0.0, 1, 0.0, 1), (1, 0.0, 1, 0.0, 8, 0.1, 1), (8, 0.0, 4, 0.25, 20, 0.0, 1), (70, 0.0, 25, 0.3, 40, 0.0, 1), (40, 0.0, 18, 0.4, 22, 0.0, 1),
    (30, 0.0, 900, 0.0, 10, 0.3, 1), (6, 0.0, 5, 0.0, 5, 0.0, 1), (10, 0.3, 14, 0.0, 0, 0.0, 1), (0, 0.0, 4, 0.0, 0, 0.0, 1), (0, 0.0, 5, 0.0, 5, 0.0, 1),
    (5, 0.0, 5, 0.0, 0, 0.0, 1), (0, 0.0, 1, 0.0, 1, 0.0, 1), (3, 0.0, 3, 0.0, 2, 0.0, 1), (0, 0.0, 3, 0.0, 4, 0.0, 1), (40, 0.0, 2, 0.0, 60, 0.0, 1),
    (45, 0.0, 5, 0.0, 50, 0.0, 1), (3, 0.0, 60, 0.0, 70, 0.0, 1), (60, 0.0, 70, 0.05, 45, 0.0, 1), (70, 0.05, 45, 0.0, 5, 0.0, 1), (5, 0.0, 50, 0.1, 30, 0.0, 1),
    (8, 0.0, 35, 0.2, 33, 0.0, 1), (0, 0.0, 200, 0.0, 0, 0.0, 1), (30, 0.0, 18, 0.0, 25, 0.0, 1), (35, 0.0, 16, 0.0, 40, 0.0, 1), (0, 0.0, 12, 0.0, 40, 0.0, 1),
    # main text next to links: the first and last paragraphs of pages with bare menus, headings behind a menu, text before a list of links
    (2, 1.0, 40, 0.0, 4, 0.0, 1), (50, 0.1, 30, 0.0, 3, 1.0, 1), (25, 0.0, 20, 0.1, 2, 1.0, 1), (1, 1.0, 7, 0.0, 55, 0.0, 1), (1, 1.0, 9, 0.0, 30, 0.0, 1),
    (2, 1.0, 6, 0.0, 80, 0.0, 1), (1, 1.0, 4, 0.0, 60, 0.0, 1), (40, 0.0, 15, 0.0, 4, 1.0, 1), (60, 0.0, 12, 0.0, 2, 1.0, 1), (1, 1.0, 25, 0.0, 1, 1.0, 1), (2, 1.0, 70, 0.0, 2, 1.0, 1),
    # menus, lists of links, tags, further reading
    (0, 0.0, 1, 1.0, 1, 1.0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 0), (1, 1.0, 2, 1.0, 9, 0.0, 0), (0, 0.0, 2, 1.0, 2, 1.0, 0), (2, 1.0, 3, 1.0, 40, 0.0, 0), (60, 0.0, 4, 1.0, 4, 1.0, 0),
    (4, 1.0, 4, 1.0, 3, 1.0, 0), (4, 1.0, 3, 1.0, 0, 0.0, 0), (3, 0.0, 8, 1.0, 7, 1.0, 0), (50, 0.0, 12, 0.9, 6, 1.0, 0), (12, 1.0, 15, 0.9, 14, 1.0, 0), (5, 1.0, 30, 0.8, 20, 0.9, 0),
    (40, 0.0, 25, 0.7, 8, 1.0, 0), (50, 0.0, 6, 0.5, 3, 1.0, 0), (60, 0.0, 9, 0.6, 0, 0.0, 0), (80, 0.0, 12, 0.5, 5, 1.0, 0), (0, 0.0, 40, 0.6, 30, 0.0, 0), (30, 0.0, 3, 1.0, 50, 0.0, 0),
    # short lines among links: dates, counters, separators, copyright lines behind the last menu
    (3, 1.0, 2, 0.0, 2, 1.0, 0), (2, 1.0, 4, 0.0, 3, 1.0, 0), (1, 1.0, 1, 0.0, 1, 1.0, 0), (3, 1.0, 5, 0.0, 2, 1.0, 0), (6, 0.6, 3, 0.0, 3, 1.0, 0), (8, 1.0, 6, 0.0, 8, 1.0, 0),
    (3, 1.0, 5, 0.0, 0, 0.0, 0), (1, 1.0, 4, 0.0, 0, 0.0, 0), (2, 1.0, 3, 0.0, 0, 0.0, 0), (5, 1.0, 6, 0.0, 0, 0.0, 0), (0, 0.0, 2, 0.0, 1, 1.0, 0), (0, 0.0, 3, 0.0, 2, 1.0, 0), (2, 0.0, 4, 0.0, 5, 1.0, 0),
)


# Blocks of pages that declare something, by all FEATURES.
DECLARED = (
    # in the main part: paragraphs, headings, lines of a word; next to menus, adverts and footers
    (1, 1.0, 9, 0.0, 80, 0.0, 1, 0, 0, 1), (12, 0.0, 8, 0.0, 60, 0.0, 1, 0, 0, 1), (9, 0.0, 60, 0.0, 3, 0.0, 1, 0, 0, 1), (60, 0.0, 3, 0.0, 50, 0.0, 1, 0, 0, 1), (2, 1.0, 1, 0.0, 2, 1.0, 1, 0, 0, 1),
    (80, 0.0, 2, 0.0, 10, 0.1, 1, 0, 0, 1), (30, 0.0, 25, 0.0, 12, 0.0, 1, 0, 0, 1), (0, 0.0, 1, 0.0, 0, 0.0, 1, 0, 0, 1), (4, 0.0, 4, 0.0, 4, 0.0, 1, 0, 0, 1), (2, 1.0, 5, 0.0, 6, 0.0, 1, 0, 0, 1),
    (50, 0.0, 18, 0.4, 22, 0.0, 1, 0, 0, 1), (0, 0.0, 3, 0.34, 0, 0.0, 1, 0, 0, 1), (6, 0.0, 3, 0.34, 9, 0.0, 1, 0, 0, 1), (40, 0.0, 900, 0.0, 1, 1.0, 1, 0, 0, 1), (15, 0.0, 4, 0.0, 2, 1.0, 1, 0, 0, 1),
    # in the main part: lists of links
    (50, 0.0, 4, 1.0, 4, 1.0, 1, 0, 0, 0), (4, 1.0, 4, 1.0, 3, 1.0, 1, 0, 0, 0), (4, 1.0, 3, 1.0, 0, 0.0, 1, 0, 0, 0), (60, 0.0, 12, 0.9, 6, 1.0, 1, 0, 0, 0), (3, 0.0, 8, 1.0, 9, 0.0, 1, 0, 0, 0), (9, 0.0, 2, 1.0, 40, 0.0, 1, 0, 0, 0),
    # furniture: menus, adverts, notices, comments, footers, of any length
    (0, 0.0, 1, 1.0, 1, 1.0, 0, 1, 0, 0), (1, 1.0, 2, 1.0, 8, 0.0, 0, 1, 0, 0), (1, 1.0, 8, 0.0, 9, 0.0, 0, 1, 0, 0), (1, 1.0, 40, 0.0, 9, 0.0, 0, 1, 0, 0), (60, 0.0, 12, 0.0, 0, 0.0, 0, 1, 0, 0),
    (40, 0.0, 90, 0.0, 30, 0.0, 0, 1, 0, 0), (0, 0.0, 30, 0.0, 60, 0.0, 0, 1, 0, 0), (3, 0.0, 3, 0.0, 3, 0.0, 0, 1, 0, 0), (0, 0.0, 5, 0.0, 0, 0.0, 0, 1, 0, 0), (70, 0.0, 200, 0.0, 0, 0.0, 0, 1, 0, 0),
    (50, 0.0, 30, 0.0, 60, 0.0, 1, 1, 0, 0), (60, 0.0, 5, 0.0, 40, 0.0, 1, 1, 0, 0), (20, 0.0, 100, 0.0, 12, 0.0, 1, 1, 0, 0), (30, 0.0, 60, 0.1, 60, 0.0, 1, 1, 0, 0), (9, 0.0, 1, 0.0, 2, 0.0, 1, 1, 0, 0),
    # a main part that is also called furniture, or lies within it: articles if they are long, with their headings; teasers if not
    (0, 0.0, 40, 0.0, 0, 0.0, 1, 0, 1, 1), (9, 0.0, 60, 0.0, 80, 0.0, 1, 0, 1, 1), (60, 0.0, 80, 0.05, 30, 0.0, 1, 0, 1, 1), (2, 1.0, 30, 0.0, 45, 0.0, 1, 0, 1, 1), (40, 0.0, 28, 0.0, 1, 1.0, 1, 0, 1, 1),
    (1, 1.0, 9, 0.0, 60, 0.0, 1, 0, 1, 1), (0, 0.0, 6, 0.0, 40, 0.0, 1, 0, 1, 1), (12, 0.0, 8, 0.0, 50, 0.0, 1, 0, 1, 1),
    (5, 0.0, 12, 0.0, 4, 0.0, 1, 0, 1, 0), (12, 0.0, 10, 0.0, 12, 0.0, 1, 0, 1, 0), (3, 1.0, 14, 0.3, 4, 1.0, 1, 0, 1, 0), (60, 0.0, 9, 0.0, 8, 0.0, 1, 0, 1, 0), (0, 0.0, 5, 0.0, 9, 0.0, 1, 0, 1, 0), (9, 0.0, 4, 0.0, 0, 0.0, 1, 0, 1, 0),
    (9, 0.0, 40, 0.8, 12, 0.9, 1, 0, 1, 0), (40, 0.0, 6, 1.0, 50, 0.0, 1, 0, 1, 0), (60, 0.0, 4, 0.0, 3, 0.0, 1, 0, 1, 0), (1, 1.0, 15, 0.0, 15, 0.0, 1, 0, 1, 0),
)
LABELLED = tuple((*r[:6], 0, 0, 0, r[6]) for r in PLAIN) + DECLARED


def train_tree(spark: SparkSession, labelled=LABELLED, depth: int = 8):
    """Fit a decision tree; returns nested (feature, threshold, left, right) and leaves 0.0 or 1.0."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    schema = ", ".join(f"{c} double" for c in (*FEATURES, "label"))
    rows = spark.createDataFrame([tuple(map(float, r)) for r in labelled], schema).coalesce(1)
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    model = DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=2, impurity="entropy", seed=7).fit(rows)

    def walk(node):
        if node.getClass().getSimpleName() == "LeafNode":
            return node.prediction()
        return node.split().featureIndex(), node.split().threshold(), walk(node.leftChild()), walk(node.rightChild())

    return walk(model._call_java("rootNode"))


def classify(tree, features: tuple) -> bool:
    while isinstance(tree, tuple):
        feature, threshold, left, right = tree
        tree = left if features[feature] <= threshold else right
    return tree >= 0.5


class Block(NamedTuple):
    text: str
    words: int
    links: int
    #: Declared around it: a main part; furniture within that (or any, without a main part); furniture at or around it.
    main: bool
    within: bool
    around: bool


class Open(NamedTuple):
    """An open container, and what it and those around it declare."""

    name: str = ""
    main: bool = False
    within: bool = False
    around: bool = False
    unseen: bool = False

    def child(self, name: str, attrs: str) -> Open:
        named = " ".join(next(filter(None, x), "") for x in NAMED.findall(attrs)) if attrs else ""
        main = name in ("article", "main") or bool(named and MAIN_NAME.search(named))
        furniture = name != "body" and (name in FURNITURE and not (name == "header" and self.main) or bool(named and FURNITURE_NAME.search(named)))
        unseen = self.unseen or bool(attrs and UNSEEN.search(attrs)) and name != "body"
        if main:
            return Open(name, True, False, self.within or self.around or furniture, unseen)
        return Open(name, self.main, self.within or furniture, self.around, unseen)


def text_blocks(page: str) -> list[Block]:
    """The flat blocks of a page in its order; what isn't shown has none."""
    out: list[Block] = []
    parts: list[str] = []
    stack: list[Open] = []
    links = in_link = 0
    loose = False  # a quote of the page never ends: tags then end at the next angle bracket

    def text(raw: str) -> None:
        nonlocal links
        if raw:
            raw = html.unescape(raw) if "&" in raw else raw
            parts.append(raw)
            if in_link:
                links += len(raw.split())

    def end_block() -> None:
        nonlocal links
        if parts:
            own = stack[-1] if stack else Open()
            words = [] if own.unseen else "".join(parts).split()
            if words:
                out.append(Block(" ".join(words), len(words), min(links, len(words)), own.main, own.within, own.around))
            parts.clear()
        links = 0

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        text(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        nxt = page[lt + 1 : lt + 2]
        if nxt in ("!", "?"):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        if not (nxt.isascii() and nxt.isalpha()) and nxt != "/":
            text("<")
            at = lt + 1
            continue
        m = None if loose else TAG.match(page, lt)
        if m:
            closing, name, attrs, at = bool(m[1]), m[2].lower(), m[3], m.end()
        else:
            end = page.find(">", lt)
            if end < 0:
                break
            loose = loose or page[lt + 1 : end].count('"') % 2 == 1 or page[lt + 1 : end].count("'") % 2 == 1
            inner = page[lt + 1 : end]
            at = end + 1
            closing = inner.startswith("/")
            words = inner.lstrip("/").split(None, 1)
            if not words:
                continue
            name, attrs = words[0].rstrip("/").lower(), words[1] if len(words) > 1 else ""
        if name == "a":
            in_link = 0 if closing else 1
        elif name == "br":
            parts.append(" ")
        elif name in RAW and not closing:
            end_block() if name != "svg" else None
            if not attrs.rstrip().endswith("/"):
                end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
                close = page.find(">", end.end()) if end else -1
                at = n if close < 0 else close + 1
        elif name in BLOCK:
            end_block()
            if name in CONTAINER:
                if not closing:
                    stack.append((stack[-1] if stack else Open()).child(name, attrs))
                elif any(s[0] == name for s in stack):
                    while stack.pop()[0] != name:
                        pass
            in_link = 0 if name in CONTAINER else in_link
    end_block()
    return out


def features(blocks: list[Block]) -> list[tuple]:
    """FEATURES of each block of a page."""
    of = lambda b: (b.words, b.links / max(1, b.words))
    none = Block("", 0, 0, False, False, False)
    around = zip([none, *blocks], blocks, [*blocks[1:], none], strict=False)
    return [(*of(before), *of(b), *of(behind), b.main, b.within, b.around) for before, b, behind in around]


def main_text(page: str | None, tree) -> str:
    """The main blocks of a page, joined by empty lines."""
    blocks = text_blocks(page or "")
    return "\n\n".join(b.text for b, f in zip(blocks, features(blocks), strict=True) if classify(tree, f))


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of ``pages`` (page_id, url, html, any others).

    Null and empty pages, and pages without main text, have an empty text.
    Repeated rows give repeated rows, an empty table an empty result. White space in a block (no-break spaces
    too) becomes one space; a line break tag counts as white space.
    """
    tree = train_tree(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, tree) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
