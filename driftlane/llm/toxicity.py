"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; documents of unknown label are the
rest. A linear model over hashed words and word beginnings is fitted in numpy
to the risk

    prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)])

where l is the logistic loss and prior the share of toxic rows among the labels
that may be learnt from; where the second part falls below zero, the step
raises it again instead. Only features go in that positives have clearly more
often than the unlabelled do (a z score) and that the unlabelled have about as
often as the prior foretells, so a few dozen positives suffice; their weights
stay non-negative. Copies and near copies within a sample count once. At the end the bias moves
so that 0.5 is where the corrected zero-one risk is least.

Both samples are bounded (POSITIVES, UNLABELLED) and picked by a hash of the
id; scoring reads every whole text once, in time linear in its words.

Defined cases: a null or empty text gets the score of no words; without any
positive every score is the prior (0 without labels); null labels are left
out; rows that repeat an id are scored each; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlane.llm.common import Cache, alnum_words, crc_of_id_col, tidied
from driftlane.llm.labelled import featurised, first_by_hash, one_column, scored, sigmoid, training_rows, word_hash

MODULUS, HELD_OUT = 5, 0
POSITIVES, UNLABELLED = 2000, 4000
BUCKETS, MOST_FEATURES, LEAST_Z, LEAST_SHARE = 1 << 22, 4096, 5.0, 0.25
#: Lengths in characters of the word beginnings that are features.
BEGINNINGS = (4, 5, 6)
SKETCH = 32
STEPS, RATE, DECAY = 300, 0.1, 1e-4


def word_buckets(word: bytes) -> tuple[int, ...]:
    """The word, and its beginnings where they are shorter than the word."""
    text = word.decode("utf-8", "replace")
    return (word_hash(word) % BUCKETS, *(word_hash(b"^" + text[:n].encode()) % BUCKETS for n in BEGINNINGS if len(text) > n))


def extractor():
    memo = Cache(word_buckets)

    def buckets(text: bytes) -> bytes:
        """The text's distinct buckets as 32-bit numbers."""
        return np.array(sorted(set().union(*map(memo.__getitem__, set(alnum_words(text))))), np.int32).tobytes()

    return one_column(buckets, "features", pa.binary())


@dataclass
class Model:
    bias: float
    weights: dict[int, float]

    def scorer(self):
        bias, weights = self.bias, self.weights
        memo = Cache(lambda w: tuple(b for b in word_buckets(w) if b in weights))

        def score(text: bytes) -> float:
            found = set().union(*map(memo.__getitem__, set(alnum_words(text))))
            return float(sigmoid(bias + sum(weights[b] for b in sorted(found))))

        return one_column(score, "score", pa.float64())


class _Rows:
    """Sets of columns as flat arrays."""

    def __init__(self, sets: list[np.ndarray], columns: int):
        self.n, self.columns = len(sets), columns
        self.row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        self.col = np.concatenate(sets) if sets else np.empty(0, np.int64)

    def dot(self, w):
        return np.bincount(self.row, w[self.col], self.n)

    def back(self, d):
        return np.bincount(self.col, d[self.row], self.columns)


def thinned(sets: list) -> list[np.ndarray]:
    """The sets without those whose SKETCH smallest buckets share half or more with those of one kept before."""
    kept, owners = [], {}
    for one in map(np.asarray, sets):
        sketch = one[:SKETCH].tolist()
        shared = Counter(k for b in sketch for k in owners.get(b, ()))
        if sketch and max(shared.values(), default=0) * 2 >= len(sketch):
            continue
        for b in sketch:
            owners.setdefault(b, []).append(len(kept))
        kept.append(one)
    return kept


def fit(positive: list, unlabelled: list, prior: float) -> Model:
    """Fits to lists of bucket arrays."""
    if not positive or not unlabelled or not 0 < prior < 1:
        base = min(max(prior, 1e-6), 1 - 1e-6)
        return Model(float(np.log(base / (1 - base))), {})
    whole = len(positive) / len(unlabelled)
    positive, unlabelled = thinned(positive), thinned(unlabelled)
    prior = min(prior * len(positive) / len(unlabelled) / whole, 0.95)  # of what is left
    count = lambda sets: np.bincount(np.concatenate([*map(np.asarray, sets), np.empty(0)]).astype(np.int64), minlength=BUCKETS)
    cp, cu = count(positive), count(unlabelled)
    p, u = cp / len(positive), (cu + 1) / (len(unlabelled) + 2)
    z = (p - u) / np.sqrt(u * (1 - u) * (1 / len(positive) + 1 / len(unlabelled)))
    kept = np.flatnonzero((z >= LEAST_Z) & (cp >= 3) & (cu >= LEAST_SHARE * prior * p * len(unlabelled)))
    kept = kept[np.argsort(-z[kept], kind="stable")][:MOST_FEATURES]
    place = np.full(BUCKETS, -1)
    place[kept] = np.arange(len(kept))
    narrow = lambda sets: _Rows([x[x >= 0] for x in (place[np.asarray(s, np.int64)] for s in sets)], len(kept))
    xp, xu = narrow(positive), narrow(unlabelled)

    theta = np.zeros(len(kept) + 1)
    theta[-1] = np.log(prior / (1 - prior))
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        gp, gu = xp.dot(theta[:-1]) + theta[-1], xu.dot(theta[:-1]) + theta[-1]
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        dp_pos = -sigmoid(-gp) * prior / xp.n  # of the loss of positives as positives
        dp_neg, du = -sigmoid(gp) * prior / xp.n, sigmoid(gu) / xu.n
        dp, du = (dp_pos + dp_neg, du) if negative >= 0 else (-dp_neg, -du)
        grad = np.append(xp.back(dp) + xu.back(du) + DECAY * theta[:-1], dp.sum() + du.sum())
        mean = 0.9 * mean + 0.1 * grad
        square = 0.999 * square + 0.001 * grad**2
        theta -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        np.maximum(theta[:-1], 0, out=theta[:-1])
    theta[-1] -= _cut(xp.dot(theta[:-1]) + theta[-1], xu.dot(theta[:-1]) + theta[-1], prior)
    return Model(float(theta[-1]), {int(k): float(w) for k, w in zip(kept, theta[:-1], strict=True)})


def _extract(batches):
    return extractor()(batches)


def _cut(gp: np.ndarray, gu: np.ndarray, prior: float) -> float:
    """The middle of the values of g at which prior * misses + (found in unlabelled - prior * found in positives) is least."""
    edges = np.unique(np.concatenate([gp, gu]))
    missed = np.searchsorted(np.sort(gp), edges) / len(gp)
    found = 1 - np.searchsorted(np.sort(gu), edges) / len(gu)
    best = int(np.argmin(prior * missed + np.maximum(0, found - prior * (1 - missed))))
    return float(edges[best] + edges[best - 1]) / 2 if best else float(edges[0]) - 1


def train(documents: DataFrame, labels: DataFrame) -> Model:
    rows = training_rows(labels, "toxic", MODULUS, HELD_OUT)
    n, toxic = rows.agg(F.count("*"), F.sum(F.col("label"))).first()
    positive = [r.doc_id for r in first_by_hash(rows.filter("label = 1"), POSITIVES).collect()]
    # unlabelled: any document that isn't held out; its label, if it has one, isn't looked at
    rest = documents.select(F.col("doc_id").cast("long").alias("doc_id")).filter(F.col("doc_id").isNotNull() & (F.pmod(crc_of_id_col(), F.lit(MODULUS)) != HELD_OUT)).distinct()
    unlabelled = [r.doc_id for r in first_by_hash(rest, UNLABELLED).collect()]
    found = {r.doc_id: np.frombuffer(r.features, np.int32) for r in featurised(documents, sorted({*positive, *unlabelled}), _extract, "doc_id long, features binary")}
    return fit([found[i] for i in positive if i in found], [found[i] for i in unlabelled if i in found], (toxic or 0) / n if n else 0.0)


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    return scored(documents, train(documents, labels).scorer(), MODULUS, HELD_OUT)


def keep_clean(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents not predicted toxic, all columns kept, in one pass."""
    columns, scorer = documents.columns, train(documents, labels).scorer()
    at = columns.index("text")

    def run(batches):
        for batch in batches:
            text = batch.column(at).cast(pa.binary())
            scores = next(iter(scorer(iter([pa.RecordBatch.from_arrays([text, text], names=["doc_id", "text"])]))))
            yield batch.filter(pa.array([s < 0.5 for s in scores.column(1).to_pylist()], pa.bool_()))

    return documents.mapInArrow(tidied(run), documents.schema)
