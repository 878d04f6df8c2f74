"""Benchmark decontamination with a broadcast set of normalised n-grams.

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased. Each
benchmark item gives its windows of NGRAM words; a shorter item, if it has any
word, is one window. Windows are hashed; a document's windows are looked up by
hash and each hit is verified word by word. Only runs of words that all occur
in the benchmark are looked at, so most of a document costs one look-up a word.

The hash set goes to the executors as plain arrays, only up to SLICE_BYTES of
benchmark text (some 15 times as much when built, at the most). A larger benchmark is worked through in slices of that size, one scan each, and
the hits are united, so the bound never drops an item. `clean` removes the
united hits and looks at what it changed again, in all slices.

Defined cases: null has no words; a null item_id is written as the text `null`;
repeated items with one id count once; repeated documents are judged each;
empty tables give empty results or no hits; other columns are kept by `clean`
and ignored by `inspect`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlane.llm.common import alnum_words, materialise, splitmix, tidied

NGRAM = 10
SLICE_BYTES = 8 << 20
_MULTIPLIER = 0x9E3779B97F4A7C15
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


class Windows:
    """The benchmark's windows: word numbers of all items in a row, and by window length sorted hashes with place and item."""

    def __init__(self, vocabulary: dict[bytes, int], words: np.ndarray, tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], names: list[str]):
        self.vocabulary, self.words, self.tables, self.names = vocabulary, words, tables, names

    @classmethod
    def build(cls, items: list[tuple[str, bytes]], ngram: int = NGRAM) -> "Windows":
        vocabulary: dict[bytes, int] = {}
        names = sorted({item for item, _ in items})
        number = {name: i for i, name in enumerate(names)}
        flat, places, at = [], {}, 0
        for item, text in items:
            ids = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in alnum_words(text)], np.uint32)
            n = min(ngram, len(ids))
            if n:
                own = places.setdefault(n, ([], []))
                own[0].append(at + np.arange(len(ids) - n + 1))
                own[1].append(np.full(len(ids) - n + 1, number[item], np.int32))
            flat.append(ids)
            at += len(ids)
        words = np.concatenate([*flat, np.empty(0, np.uint32)])
        tables = {}
        for n, (place, item) in places.items():
            place, item = np.concatenate(place), np.concatenate(item)
            hashes = cls._hash([words[place + i] for i in range(n)])
            order = np.lexsort((item, hashes))
            hashes, place, item = hashes[order], place[order], item[order]
            # of equal windows of one item, one is enough
            same = (hashes[1:] == hashes[:-1]) & (item[1:] == item[:-1])
            for i in range(n):
                same &= words[place[1:] + i] == words[place[:-1] + i]
            keep = np.concatenate([[True], ~same])
            tables[n] = (hashes[keep], place[keep], item[keep])
        return cls(vocabulary, words, tables, names)

    def state(self) -> tuple:
        """Plain values for a broadcast, which executors read without this library; at most some 30 bytes a word besides the text."""
        return self.vocabulary, self.words, self.tables, self.names

    @staticmethod
    def _hash(columns) -> np.ndarray:
        h = np.zeros(len(columns[0]), np.uint64)
        for column in columns:
            h = splitmix(h * np.uint64(_MULTIPLIER) + column)
        return h

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words are hit, and the items found."""
        hit, items = np.zeros(len(words) + 1, np.int64), set()
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in words), np.uint32, len(words))
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        for n, (hashes, place, owner) in self.tables.items():
            if len(words) < n:
                continue
            at = np.flatnonzero(known[n:] - known[:-n] == n)
            if not len(at):
                continue
            h = self._hash([ids[at + i] for i in range(n)])
            lo, hi = np.searchsorted(hashes, h), np.searchsorted(hashes, h, side="right")
            for k in np.flatnonzero(hi > lo):
                window, found = ids[at[k] : at[k] + n], slice(lo[k], hi[k])
                right = (self.words[place[found, None] + np.arange(n)] == window).all(axis=1)
                if right.any():
                    hit[at[k]] += 1
                    hit[at[k] + n] -= 1
                    items.update(owner[found][right].tolist())
        return np.cumsum(hit[:-1]) > 0, {self.names[i] for i in items}


def n_slices(benchmark: DataFrame, slice_bytes: int = SLICE_BYTES) -> int:
    """How many slices of about slice_bytes of text the benchmark makes."""
    return max(1, -(-(benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // slice_bytes))


def slices(benchmark: DataFrame, n: int) -> Iterator[list[tuple[str, bytes]]]:
    """The benchmark's items in n lists, each of a bounded size."""
    rows = benchmark.filter("text is not null").select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text").cast("binary").alias("text"))
    for i in range(n):
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i)
        yield [(r.item, bytes(r.text)) for r in part.collect()]


def _id_digest(items) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def inspect(documents: DataFrame, benchmark: DataFrame, ngram: int = NGRAM, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items (sorted ids)."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    rows = rows.select(F.lit(0).cast("long").alias("row"), "*")
    n = n_slices(benchmark, slice_bytes)
    if n > 1:
        rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()))
    whole = None
    for items in slices(benchmark, n):
        table = rows.sparkSession.sparkContext.broadcast(Windows.build(items, ngram).state())
        found = rows.mapInArrow(tidied(_inspector(table)), "row long, doc_id long, n_words long, hit array<int>, items array<string>")
        if whole is None:
            whole = found
        else:
            more = found.filter("size(hit) > 0").select("row", F.col("hit").alias("h"), F.col("items").alias("i"))
            both = lambda a, b: F.coalesce(F.array_union(a, b), a).alias(a)
            whole = materialise(whole.join(more, "row", "left").select("row", "doc_id", "n_words", both("hit", "h"), both("items", "i")))
    items = F.array_sort("items")
    return whole.select(
        "doc_id", "n_words", F.size("hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.size("hit") > 0).alias("contaminated"), items.alias("items"),
    )


def _inspector(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(*table.value)
        for batch in batches:
            n, hits, items = [], [], []
            for text in batch.column(2):
                words = alnum_words(text.as_py() or b"")
                hit, found = windows.scan(words)
                n.append(len(words))
                hits.append(np.flatnonzero(hit).astype(np.int32))
                items.append(sorted(found))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(n, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], names=["row", "doc_id", "n_words", "hit", "items"]
            )

    return run


def without_hits(text: bytes, windows: Windows) -> bytes:
    """The text without hit spans, first to last word of each; looked at again until nothing is hit."""
    while True:
        hit, _ = windows.scan(alnum_words(text))
        if not hit.any():
            return text
        text = without_words(text, hit)


def without_words(text: bytes, hit) -> bytes:
    """The text without the spans of hit words, first to last word of each."""
    spans = [m.span() for m in _WORD.finditer(text)]
    out, at, k = [], 0, 0
    while k < len(hit):
        if hit[k]:
            first = k
            while k + 1 < len(hit) and hit[k + 1]:
                k += 1
            out.append(text[at : spans[first][0]])
            at = spans[k][1]
        k += 1
    return b"".join([*out, text[at:]])


def clean(documents: DataFrame, benchmark: DataFrame, ngram: int = NGRAM, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The documents without hit spans; a document of which no word is left goes. n_chars follows the text."""
    columns, context = documents.columns, documents.sparkSession.sparkContext
    n = n_slices(benchmark, slice_bytes)
    if n == 1:
        table = context.broadcast(Windows.build(next(slices(benchmark, n)), ngram).state())
        return documents.mapInArrow(tidied(_cleaner(_without_all(table), columns)), documents.schema)
    rows, done = materialise(documents.withColumn("__row", F.monotonically_increasing_id())), []
    while True:
        found = []
        for items in slices(benchmark, n):
            table = context.broadcast(Windows.build(items, ngram).state())
            texts = rows.select("__row", F.lit(None).cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
            one = texts.mapInArrow(tidied(_inspector(table)), "row long, doc_id long, n_words long, hit array<int>, items array<string>")
            found.append(materialise(one.filter("size(hit) > 0").select(F.col("row").alias("__row"), "hit")))
        hits = materialise(reduce(DataFrame.unionByName, found).groupBy("__row").agg(F.array_distinct(F.flatten(F.collect_list("hit"))).alias("__hit")))
        done.append(rows.join(hits, "__row", "left_anti").select(*columns))
        if hits.isEmpty():
            return reduce(DataFrame.unionByName, done)
        hit = rows.join(hits, "__row").select(*columns, "__row", "__hit")
        rows = materialise(hit.mapInArrow(tidied(_cleaner(lambda: _without_united, hit.columns)), hit.schema).drop("__hit"))


def _without_all(table):
    def make():
        windows = Windows(*table.value)
        return lambda text, _: without_hits(text, windows)

    return make


def _without_united(text: bytes, at: list[int]) -> bytes:
    hit = np.zeros(len(alnum_words(text)), bool)
    hit[at] = True
    return without_words(text, hit)


def _cleaner(make, columns):
    at, chars = columns.index("text"), columns.index("n_chars") if "n_chars" in columns else None
    hits = columns.index("__hit") if "__hit" in columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cleaned = make()
        for batch in batches:
            changed, keep = {}, []
            for i, text in enumerate(batch.column(at)):
                raw = (text.as_py() or "").encode()
                new = cleaned(raw, batch.column(hits)[i].as_py() if hits is not None else None)
                if new is not raw:
                    changed[i] = new.decode()
                if new is raw or alnum_words(new):
                    keep.append(i)
            out = list(batch.columns)
            if changed:
                out[at] = pa.array([changed.get(i, t) for i, t in enumerate(out[at].to_pylist())], out[at].type)
                if chars is not None:
                    out[chars] = pa.array([len(changed[i]) if i in changed else n for i, n in enumerate(out[chars].to_pylist())], out[chars].type)
            yield pa.RecordBatch.from_arrays(out, names=batch.schema.names).take(pa.array(keep, pa.int64()))

    return run
