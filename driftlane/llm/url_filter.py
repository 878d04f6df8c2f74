"""URL verdicts: rules by longest host and path prefix, else host words and naive Bayes.

Where no rule fits, the host's labels are split into words by unigram Viterbi
(a concatenated name becomes the most probable sequence of known words), and a
multinomial naive Bayes over the words of host and path gives allow or block.

Unigrams are counted over the whole table: words of paths, and pieces of host
labels that hyphens part (a label without one may itself be a concatenation).
Naive Bayes is learnt from the urls that rules decide, without the words that
the rules themselves consist of, with add-ALPHA smoothing; the prior is the
smoothed share of blocked ones. Counts are kept in count-min sketches of fixed
size (ROWS x SLOTS), so every word of any table counts, no vocabulary is cut,
and what goes to the driver is bounded.

Defined cases: null urls and urls without `://` have empty host and path, no
rule, and are judged as no words, by the prior; a table without rule-decided
urls allows all; repeated rows are judged each; very long urls are split
whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlane.llm.common import Cache

#: (verdict, host, path prefix) of the production rules.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))

ROWS, BITS = 3, 18
SLOTS = 1 << BITS
#: Letters of the longest word that segmentation looks for, and the smoothing of naive Bayes.
LONGEST, ALPHA = 24, 0.5
_SEED = 42
_TOKEN = re.compile(r"[a-z]+|[0-9]+|[^\x00-\x7f]+")


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), upper, lower)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as struct(rule, verdict), or null. Longest: by the characters of host and path together."""
    best = None
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        mine = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        best = F.when(fits, mine) if best is None else F.when(fits, mine).otherwise(best)
    return best


@dataclass
class Counts:
    """A count-min sketch of word counts: never too small, and rarely too large."""

    table: np.ndarray = field(default_factory=lambda: np.zeros((ROWS, SLOTS), np.int64))
    total: int = 0
    types: int = 0

    def __getitem__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word.encode(), _SEED)
        return int(min(self.table[row, h >> row * BITS & SLOTS - 1] for row in range(ROWS)))

    @classmethod
    def of(cls, words: dict[str, int]) -> "Counts":
        out = cls(total=sum(words.values()), types=len(words))
        for word, n in words.items():
            h = xxhash.xxh64_intdigest(word.encode(), _SEED)
            for row in range(ROWS):
                out.table[row, h >> row * BITS & SLOTS - 1] += n
        return out


def counted(words: DataFrame) -> Counts:
    """The sketch of (word, n), one row per word; at most ROWS * SLOTS sums come to the driver."""
    h = F.xxhash64("word")
    slots = F.array(*[F.struct(F.lit(row).alias("row"), F.shiftright(h, row * BITS).bitwiseAND(F.lit(SLOTS - 1)).alias("slot")) for row in range(ROWS)])
    sums = words.select("n", F.explode(slots).alias("s")).groupBy("s.row", "s.slot").agg(F.sum("n").alias("n")).toArrow()
    total, types = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    out = Counts(np.zeros((ROWS, SLOTS), np.float32), total, types)
    row, slot, n = (sums.column(c).to_numpy() for c in ("row", "slot", "n"))
    out.table[row, slot] = n
    return out


@dataclass
class Model:
    """Unigram counts for segmentation, and word counts and numbers of urls of both classes."""

    unigrams: Counts
    allow: Counts = field(default_factory=Counts)
    block: Counts = field(default_factory=Counts)
    urls: tuple[int, int] = (0, 0)

    def _cost(self, word: str) -> float:
        n = self.unigrams[word]
        # an unknown word costs more with each letter, so known words are preferred wherever they fit
        return math.log((self.unigrams.total + 1) / n) if n else math.log(self.unigrams.total + 1) + 2.5 * len(word)

    def segment(self, name: str) -> list[str]:
        """The most probable words of a concatenated name; a piece longer than LONGEST only as one unknown rest."""
        best = [(0.0, 0)]
        for end in range(1, len(name) + 1):
            best.append(min((best[start][0] + self._cost(name[start:end]), start) for start in range(max(0, end - LONGEST), end)))
        words, end = [], len(name)
        while end:
            start = best[end][1]
            words.append(name[start:end])
            end = start
        return words[::-1]

    def words(self, host: str, path: str) -> list[str]:
        labels = host.split(".")[:-1] or host.split(".")  # the top-level domain says nothing here
        return [w for token in plain_tokens(".".join(labels) + "/" + path.lower()) for w in self.segment(token)]

    def log_odds(self, words: list[str]) -> float:
        """Of block against allow."""
        allowed, blocked = self.urls
        types = max(self.allow.types, self.block.types) + 1
        part = lambda word, counts: math.log((counts[word] + ALPHA) / (counts.total + ALPHA * types))
        known = [w for w in words if self.allow[w] or self.block[w]]
        return math.log((blocked + ALPHA) / (allowed + 2 * ALPHA)) + sum(part(w, self.block) - part(w, self.allow) for w in known)

    def verdict(self, host: str, path: str) -> str:
        return "block" if self.log_odds(self.words(host, path)) > 0 else "allow"


def plain_tokens(text: str) -> list[str]:
    return [t for t in _TOKEN.findall(text) if t.isascii() and t.isalpha()]


def _learner(model: Model, rules):
    """Words of decided urls with their verdict, without those of the rule."""
    own = {h + p: set(plain_tokens(f"{h}/{p}".lower())) for _, h, p in rules}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Cache(lambda hp: model.words(*hp), 100_000)
        for batch in batches:
            found: Counter = Counter()
            for host, path, rule, verdict in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found.update((w, verdict) for w in memo[host, path] if w not in own[rule])
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.string()), pa.array([v for _, v in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "verdict", "n"])

    return run


def train(pages: DataFrame, rules=RULES) -> Model:
    """Counts over the whole table, made by executors."""
    host, path = parts(F.col("url"))
    rows = pages.select(host.alias("host"), path.alias("path"))
    pieces = F.filter(F.split("host", r"\."), lambda x: x.contains("-"))
    words = rows.select(F.explode(F.split(F.concat_ws("/", F.array_join(pieces, "/"), F.lower("path")), "[^a-z]+")).alias("word")).filter("word <> ''")
    model = Model(counted(words.groupBy("word").agg(F.count("*").alias("n"))))
    decided = rows.withColumn("found", rule_of(F.col("host"), F.col("path"), rules)).filter("found is not null").select("host", "path", "found.rule", "found.verdict")
    urls = {r.verdict: r["count"] for r in decided.groupBy("verdict").count().collect()}
    seen = decided.mapInArrow(_learner(model, rules), "word string, verdict string, n long").groupBy("word", "verdict").agg(F.sum("n").alias("n"))
    side = lambda v: counted(seen.filter(F.col("verdict") == v).select("word", "n"))
    return Model(model.unigrams, side("allow"), side("block"), (urls.get("allow", 0), urls.get("block", 0)))


def _judge(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Cache(lambda hp: model.verdict(*hp), 100_000)
        for batch in batches:
            host, path, given = (batch.column(i).to_pylist() for i in (2, 3, 5))
            verdict = [v or memo[h, p] for h, p, v in zip(host, path, given, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(verdict, pa.string())], names=["page_id", "url", "host", "path", "rule", "verdict"])

    return run


def judge(pages: DataFrame, rules=RULES, model: Model | None = None) -> DataFrame:
    """One row per page: page_id, url, host, path, rule, verdict."""
    model = model or train(pages, rules)
    host, path = parts(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), path.alias("path"))
    found = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("found", found).select("page_id", "url", "host", "path", "found.rule", "found.verdict")
    return rows.mapInArrow(_judge(model), "page_id long, url string, host string, path string, rule string, verdict string")
