"""Text quality by a factorisation machine.

A document is a sparse vector: hashed words (square roots of their shares),
structure statistics cut into bins (case, symbols, separators, repetition,
lines, word lengths), and its length as metadata. The machine scores

    b + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)

so pairwise interactions of rank RANK cost time linear in the non-zero
features. It is trained in numpy by Adam on a bounded sample of labelled rows
(SAMPLE, picked by a hash of the id). Scoring reads every whole text once.

Defined cases: a null or empty text is scored as a text without words; without
labelled rows every score is 0.5; null labels are left out; rows that repeat an
id are scored each; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from driftlane.llm.common import Cache
from driftlane.llm.labelled import featurised, first_by_hash, one_column, scored, sigmoid, training_rows, word_hash

MODULUS, HELD_OUT = 3, 1
SAMPLE, RANK, WORDS = 6000, 8, 1 << 12
EPOCHS, BATCH, RATE, DECAY, WORD_DECAY = 40, 128, 0.02, 1e-4, 1e-3

#: Edges of each statistic's bins.
EDGES = (0.002, 0.01, 0.03, 0.08, 0.2, 0.4, 0.7)
LENGTH_EDGES = (1, 5, 20, 80, 200, 600, 2000)
STATISTICS = ("upper", "digit", "symbol", "bang", "bar", "repeat", "unique", "top_word", "line_repeat", "short_lines", "long_words", "ended")
BINS = len(EDGES) + 1
SIZE = WORDS + (len(STATISTICS) + 1) * BINS
_UPPER = bytes(range(65, 91))
_DIGIT = b"0123456789"
_SYMBOL = b"#$%&*@^~<>{}[]\\_=+"


def statistics(text: bytes) -> tuple[list[float], list[bytes]]:
    """Values of STATISTICS, each from 0 to 1, and the words."""
    words = text.split()
    n, size = max(1, len(words)), max(1, len(text))
    share = lambda chars: (len(text) - len(text.translate(None, chars))) / size
    lines = [x for x in text.split(b"\n") if x.strip()]
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    top = max(counts.values(), default=0)
    return [
        share(_UPPER), share(_DIGIT), share(_SYMBOL), share(b"!"), share(b"|"),
        sum(map(bytes.__eq__, words, words[1:])) / n, len(counts) / n, top / n if n > 20 else 0.0,
        1 - len(set(lines)) / len(lines) if lines else 0.0, sum(len(x) < 20 for x in lines) / len(lines) if lines else 0.0,
        sum(len(w) > 14 for w in counts) / n, sum(w[-1:] in b".!?" for w in words) / n,
    ], words


_EDGES, _LENGTHS = np.array(EDGES), np.array(LENGTH_EDGES)


def features(text: bytes, memo: Cache) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values."""
    values, words = statistics(text)
    base = WORDS + np.arange(len(values) + 1) * BINS
    base[:-1] += np.searchsorted(_EDGES, values, side="right")
    base[-1] += np.searchsorted(_LENGTHS, len(words), side="right")
    if words:
        count = np.bincount(np.fromiter(map(memo.__getitem__, words), np.int64, len(words)), minlength=WORDS)
        hit = np.flatnonzero(count)
        return np.concatenate([hit, base]), np.concatenate([np.sqrt(count[hit] / len(words)), np.ones(len(base))])
    return base, np.ones(len(base))


def word_memo() -> Cache:
    return Cache(lambda w: word_hash(re.sub(rb"[^a-z0-9\x80-\xff]+", b"", w.lower())) % WORDS)


@dataclass
class Machine:
    bias: float
    w: np.ndarray
    v: np.ndarray

    def raw(self, columns: np.ndarray, values: np.ndarray) -> float:
        v = self.v[columns] * values[:, None]
        return float(self.bias + self.w[columns] @ values + 0.5 * ((v.sum(axis=0) ** 2) - (v**2).sum(axis=0)).sum())

    def scorer(self):
        memo = word_memo()
        return one_column(lambda text: float(sigmoid(self.raw(*features(text, memo)))), "score", pa.float64())


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Machine:
    rng = np.random.default_rng(7)
    w, v = np.zeros(SIZE), rng.normal(0, 0.02, (SIZE, RANK))
    if not len(rows):
        return Machine(0.0, w, v * 0)
    good = np.clip(labels.mean(), 0.01, 0.99)
    bias = float(np.log(good / (1 - good)))
    # each class weighs so that neither is lost where it is rare
    weight = np.where(labels == 1, 1.0, min(4.0, np.sqrt(good / (1 - good))))
    decay = np.full(SIZE, DECAY)
    decay[:WORDS] = WORD_DECAY
    state = [np.zeros_like(x) for x in (w, w, v, v)] + [0.0, 0.0]
    step = 0
    epochs = max(4, min(EPOCHS, 60_000 // len(rows)))
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            row = np.repeat(np.arange(len(part)), [len(rows[i][0]) for i in part])
            col, val = (np.concatenate([rows[i][k] for i in part]) for k in (0, 1))
            sums = np.zeros((len(part), RANK))
            vx = v[col] * val[:, None]
            np.add.at(sums, row, vx)
            squares = np.bincount(row, (vx**2).sum(axis=1), len(part))
            out = bias + np.bincount(row, w[col] * val, len(part)) + 0.5 * ((sums**2).sum(axis=1) - squares)
            d = (sigmoid(out) - labels[part]) * weight[part] / len(part)
            gw = np.bincount(col, d[row] * val, SIZE) + decay * w
            gv = decay[:, None] * v
            np.add.at(gv, col, d[row, None] * val[:, None] * (sums[row] - vx))
            gb, step = d.sum(), step + 1
            for k, (x, g) in enumerate(((w, gw), (v, gv))):
                m, s = state[2 * k], state[2 * k + 1]
                m += 0.1 * (g - m)
                s += 0.01 * (g**2 - s)
                x -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
            bias -= RATE * gb
    return Machine(bias, w, v)


def train(documents: DataFrame, labels: DataFrame) -> Machine:
    rows = first_by_hash(training_rows(labels, "quality", MODULUS, HELD_OUT), SAMPLE).collect()
    label = {r.doc_id: r.label for r in rows}

    def extract(batches):
        memo = word_memo()
        for batch in batches:
            found = [features(t.as_py() or b"", memo) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([c.astype(np.int32) for c, _ in found], pa.list_(pa.int32())), pa.array([x.astype(np.float32) for _, x in found], pa.list_(pa.float32()))], names=["doc_id", "columns", "values"]
            )

    found = featurised(documents, sorted(label), extract, "doc_id long, columns array<int>, values array<float>")
    found = sorted({r.doc_id: r for r in found}.items())
    return fit([(np.array(r["columns"], np.int64), np.array(r["values"])) for _, r in found], np.array([label[i] for i, _ in found], float))


def quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    return scored(documents, train(documents, labels).scorer(), MODULUS, HELD_OUT)
