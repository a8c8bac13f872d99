"""Document quality by naive-Bayes support vectors (operator 10).

A text's features are the indicators of its token 1- and 2-grams, hashed to
2 ** bits columns; tokens are words and single punctuation marks.  Columns are
scaled by the log-count ratio of the two classes, and a linear hinge-loss
(L1) support vector machine is fitted to them by dual coordinate descent.  As
in the published form, the weights are drawn towards their mean magnitude by
1 - beta.  A document is scored by one sum over its distinct features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import textcore as tc
from .common import labelled_sample, ready

BITS = 18
SCHEMA = "doc_id bigint, score double, quality int"


def features(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each distinct feature of each text, in order."""
    data, offsets = tc.raw(tc.lowered(column))
    rows = len(offsets) - 1
    none = np.zeros(0, np.int64)
    if not len(data):
        return none, none
    word = tc._WORD[data]
    mark = ~word & (data > 32)
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    begins[heads] |= word[heads]
    begins |= mark
    start = np.flatnonzero(begins)
    if not len(start):
        return none, none
    # a token ends before the next non-word byte, token or text
    stop = np.flatnonzero(~word)
    after = np.searchsorted(stop, start)
    end = np.concatenate([stop, [len(data)]])[after]
    end = np.where(mark[start], start + 1, end)
    row = np.searchsorted(offsets, start, side="right") - 1
    end = np.minimum(end, offsets[row + 1])
    h = tc.hash_spans(data, start, end)
    two = tc.grams(h, row, 2)
    key = np.concatenate([h >> np.uint64(64 - bits), two[two != tc.TOP] >> np.uint64(64 - bits)])
    at = np.concatenate([row, row[two != tc.TOP]]).astype(np.uint64)
    both = np.sort((at << np.uint64(bits)) | key)
    both = both[np.concatenate([[True], both[1:] != both[:-1]])]
    return (both >> np.uint64(bits)).astype(np.int64), (both & np.uint64((1 << bits) - 1)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    weight: np.ndarray
    bias: float
    bits: int

    def score(self, column: pa.Array) -> np.ndarray:
        row, at = features(column, self.bits)
        return np.bincount(row, self.weight[at], minlength=len(column)) + self.bias


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, dims: int, c: float, epochs: int, seed: int, tolerance: float = 1e-3) -> np.ndarray:
    """Weights of the L1-loss linear support vector machine, by dual coordinate descent over random permutations."""
    w, alpha = np.zeros(dims), np.zeros(len(rows))
    square = np.array([v @ v for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        most, least = -np.inf, np.inf
        for i in rng.permutation(len(rows)):
            if square[i] == 0:
                continue
            g = y[i] * (w[rows[i]] @ values[i]) - 1
            projected = min(g, 0.0) if alpha[i] == 0 else max(g, 0.0) if alpha[i] == c else g
            most, least = max(most, projected), min(least, projected)
            if projected:
                new = min(max(alpha[i] - g / square[i], 0.0), c)
                w[rows[i]] += (new - alpha[i]) * y[i] * values[i]
                alpha[i] = new
        if most - least < tolerance:
            break
    return w


def fit(
    sample: list[tuple[str, int]], bits: int = BITS, smoothing: float = 1.0, c: float = 0.1, beta: float = 0.25, epochs: int = 40,
    held: float = 0.25, max_false_rate: float = 0.005, seed: int = 10,
) -> Model | None:
    """The model of (text, class) pairs; None if a class is missing.

    The last `held` share of each class is kept out; the bias is set so that at
    most max_false_rate of the kept-out good texts score below 0.
    """
    sides = {k: [t for t, y in sample if y == k] for k in (0, 1)}
    if not sides[0] or not sides[1]:
        return None
    kept = {k: max(1, int(len(v) * (1 - held))) for k, v in sides.items()}
    texts = sides[0][: kept[0]] + sides[1][: kept[1]]
    y = np.array([-1.0] * kept[0] + [1.0] * kept[1])
    rows, ats = [], []
    for i in range(0, len(texts), 256):
        row, at = features(pa.array(texts[i : i + 256], type=pa.large_string()), bits)
        rows.append(row + i), ats.append(at)
    row, at = np.concatenate(rows), np.concatenate(ats)
    dims = 1 << bits
    p = smoothing + np.bincount(at[y[row] > 0], minlength=dims)
    q = smoothing + np.bincount(at[y[row] < 0], minlength=dims)
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    # columns seen in no text say nothing: their ratio would only reflect the classes' lengths
    ratio[p + q == 2 * smoothing] = 0.0
    bound = np.searchsorted(row, np.arange(len(texts) + 1))
    # one more column, always 1, is the bias while fitting
    each = [np.append(at[i:j], dims) for i, j in zip(bound, bound[1:])]
    values = [np.append(ratio[e[:-1]], 1.0) for e in each]
    w = descend(each, values, y, dims + 1, c, epochs, seed)
    used = ratio != 0
    mean = np.abs(w[:-1][used]).mean() if used.any() else 0.0
    model = Model(((1 - beta) * mean + beta * w[:-1]) * ratio, 0.0, bits)
    good = sides[1][kept[1] :] or sides[1]
    scores = np.sort(np.concatenate([model.score(pa.array(good[i : i + 256], type=pa.large_string())) for i in range(0, len(good), 256)]))
    return Model(model.weight, -float(scores[int(len(scores) * max_false_rate)]), bits)


def train(docs: DataFrame, labels: DataFrame, per_class: int = 3000, seed: int = 10, **options) -> Model | None:
    """Fit on a bounded sample: at most per_class labelled documents of each class (see labelled_sample)."""
    return fit(labelled_sample(docs, labels, "quality", per_class, seed), **options)


def classify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score and quality (1 where the score is at least 0) of every row, over its whole text.

    A null or empty text has no features and the bias for a score; a null
    doc_id is carried; repeated rows are scored each time; other columns are
    ignored; an empty table gives an empty result.  Without a model scores are
    0 and all is good.
    """
    spark = ready(docs)
    shared = spark.sparkContext.broadcast(model)  # 2 ** bits weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in tc.steps(batch, "text"):
                score = model.score(tc.column(part, "text")) if model else np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [pc.cast(tc.column(part, "doc_id"), pa.int64()), pa.array(score), pa.array((score >= 0).astype(np.int32))], names=["doc_id", "score", "quality"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
