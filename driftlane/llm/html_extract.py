"""Main text of a page by its maximum-scoring subsequence of words and tags.

A page is read as a sequence of words and tags. Words score positive; tags, and
words inside boilerplate, score negative. A linear scan finds the best
contiguous region, and its words are the text, block by block.

Weights come from labelled pages, those with exactly one <article>:

- a tag's weight is minus the smoothed share of its uses outside the article;
- an element is boilerplate by its name (menus, headers, footers, forms ...) or
  by a class, id or role of which most elements of the labelled pages hold no
  word of the article. Whole tokens count, so `share-price` isn't `share`. PRIOR
  gives a few plain tokens some uses outside to start from.

Counts are kept in a table of SLOTS hashed keys, so every tag and token of any
number of pages counts and what goes to the driver is bounded. Work is linear
in the page, broken ones too.

Defined cases: null and empty pages and pages without words give the empty
text; unclosed elements, comments and raw text end with the page; repeated rows
are extracted each; pages of any length are read whole; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlane.llm.common import Cache

#: Elements whose content is text, not markup.
RAW = frozenset("script style template noscript textarea svg math iframe object select xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html "
    "legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements that hold no main text.
BOILERPLATE = frozenset("head title nav header footer aside form button menu dialog label input".split())
#: Class, id and role tokens that count as seen PRIOR times outside the article.
KNOWN_TOKENS = tuple(
    "ad ads advert advertisement advertising sponsored promo cookie-notice cookie-banner cookies consent sidebar breadcrumb breadcrumbs comments comment comment-list newsletter "
    "navigation navbar banner contentinfo complementary search menu menubar".split()
)
PRIOR, OUTSIDE_SHARE, SLOTS = 50, 0.8, 1 << 18
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_INVISIBLE = re.compile(r"display\s*:\s*none", re.I)

WORD, OUTSIDE_WORD = 1.0, -1.0
LEAST_TAG, MOST_TAG = 0.02, 4.0


def slot(kind: str, name: str) -> int:
    return xxhash.xxh64_intdigest(f"{kind}:{name}".encode("utf-8", "replace")) % SLOTS


def _read(attributes: str) -> tuple[bool, list[str]]:
    """Whether an element is hidden, and its class, id and role tokens."""
    hidden, names = False, []
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id", "role"):
            names += value.split()
        else:
            hidden |= name == "hidden" and value != "false" or name == "aria-hidden" and value == "true" or name == "style" and bool(_INVISIBLE.search(value))
    return hidden, names


def tokens(page: str, marked=None, closed=None) -> Iterator[tuple[str, str, bool, int]]:
    """(kind, value, boilerplate, article depth): kind is `text`, `open` or `close`.

    marked(tokens) says whether an element with these tokens is boilerplate; closed(tokens, words, own) is told of each
    element with tokens how many words it held, and how many of them in the article.
    """
    at, open_, bad, articles = 0, [], 0, 0
    standing: Counter = Counter()  # open elements by name
    words, own = 0, 0

    def pop():
        nonlocal bad, articles
        name, was, names, w, o = open_.pop()
        standing[name] -= 1
        bad -= was
        articles -= name == "article"
        if closed and names:
            closed(names, words - w, own - o)
        return name

    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            text = page[at : m.start()]
            if closed and (n := len(text.split())):
                words, own = words + n, own + n * (articles > 0)
            yield "text", text, bad > 0, articles
        at = m.end()
        name = (m.group(2) or "").lower()
        if not name:
            continue
        if m.group(1):
            inside, depth = bad > 0, articles
            if standing[name]:
                while pop() != name:
                    pass
            yield "close", name, inside, min(depth, articles)
            continue
        if name in RAW:
            end = _raw_end(name).search(page, at)
            at = end.end() if end else len(page)
            yield "open", name, True, articles
            continue
        hidden, names = _read(m.group(3) or "")
        # within the article a title block stays main text
        was = hidden or bool(names and marked and marked(names)) or name in BOILERPLATE and not (name == "header" and articles)
        yield "open", name, bad > 0 or was, articles
        if name not in VOID and not (m.group(3) or "").endswith("/"):
            open_.append((name, int(was), names, words, own))
            standing[name] += 1
            bad += was
            articles += name == "article"
    if at < len(page):
        yield "text", page[at:], bad > 0, articles
    while open_:
        pop()


@cache
def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}\s*(?:>|\Z)", re.I)


@dataclass
class Weights:
    """Uses inside and outside the article by slot."""

    inside: np.ndarray = field(default_factory=lambda: np.zeros(SLOTS, np.int64))
    outside: np.ndarray = field(default_factory=lambda: np.zeros(SLOTS, np.int64))

    def __post_init__(self):
        self.outside = self.outside.copy()
        for name in KNOWN_TOKENS:
            self.outside[slot("token", name)] += PRIOR
        self._tags, self._tokens = Cache(self._tag, 10_000), Cache(self._token, 50_000)

    def _tag(self, name: str) -> float:
        k = slot("tag", name)
        i, o = int(self.inside[k]), int(self.outside[k])
        return -max(LEAST_TAG, MOST_TAG * ((o + 1) / (i + o + 2)) ** 3)

    def _token(self, name: str) -> bool:
        k = slot("token", name)
        i, o = int(self.inside[k]), int(self.outside[k])
        return (o + 0.5) / (i + o + 1) >= OUTSIDE_SHARE

    def tag(self, name: str) -> float:
        return self._tags[name]

    def marked(self, names: list[str]) -> bool:
        return any(self._tokens[n] for n in names)


def extract(page: str | None, weights: Weights) -> str:
    """The main text: blocks joined by newlines."""
    if not page:
        return ""
    items, scores = [], []
    for kind, value, bad, depth in tokens(page, weights.marked):
        within = bad and depth > 0  # an insert in the article: no text, but no reason to end it either
        if kind == "text":
            value = html_lib.unescape(value)
            n = len(value.split())
            items.append(("", None) if bad else ("text", value))
            scores.append(0.0 if within else n * (OUTSIDE_WORD if bad else WORD))
        else:
            items.append(("break", None) if value in BLOCKS else ("gap", None) if value == "br" else ("", None))
            scores.append(0.0 if within else weights.tag(value))
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, span = total, (start, i + 1)
    blocks, now = [], []
    for what, value in [*items[slice(*span)], ("break", None)]:
        if what == "text":
            now.append(value)
        elif what == "gap":
            now.append(" ")
        elif what == "break":
            if text := " ".join("".join(now).split()):
                blocks.append(text)
            now = []
    return "\n".join(blocks)


_ARTICLE = re.compile(r"<article[\s>]", re.I)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    inside, outside = Counter(), Counter()
    tags, names = Cache(lambda n: slot("tag", n), 10_000), Cache(lambda n: slot("token", n), 50_000)

    def closed(found, words, own):
        if words:
            (inside if own else outside).update({names[n] for n in found})

    for batch in batches:
        for page in batch.column(0):
            page = page.as_py() or ""
            if len(_ARTICLE.findall(page)) == 1:
                for kind, value, _, depth in tokens(page, closed=closed):
                    if kind != "text":
                        (inside if depth else outside)[tags[value]] += 1
    found = sorted({*inside, *outside})
    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([inside[n] for n in found], pa.int64()), pa.array([outside[n] for n in found], pa.int64())], names=["slot", "inside", "outside"])


def train(pages: DataFrame) -> Weights:
    """Weights from the pages that mark their article; at most SLOTS sums come to the driver."""
    rows = pages.select("html").mapInArrow(_count, "slot int, inside long, outside long").groupBy("slot").agg(F.sum("inside").alias("i"), F.sum("outside").alias("o")).toArrow()
    inside, outside = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)
    inside[rows.column("slot").to_numpy()], outside[rows.column("slot").to_numpy()] = rows.column("i").to_numpy(), rows.column("o").to_numpy()
    return Weights(inside, outside)


_ROWS = 128


def extract_pages(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    weights = weights or train(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                texts = [extract(page.as_py(), weights) for page in batch.column(2)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
