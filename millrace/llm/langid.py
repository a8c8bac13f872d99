"""Language identification (operator 5).

Sparse multinomial logistic regression on TF-IDF character 1- to 3-grams.
Grams of lower-cased code points (all that aren't letters count as one blank)
are hashed to 2 ** BITS columns; document frequencies are counted over all
documents; rows are scaled to unit length.  Training is
follow-the-regularised-leader with per-coordinate steps and an elastic net:
the L1 part leaves most weights exactly zero.  The temperature that divides
the scores is fitted on held-out documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textcore as tc
from .common import bounded_texts, cut, ready

BITS = 16
SCHEMA = "doc_id bigint, predicted string, confidence double"
#: Text of the training sample for each language, and the languages that are learned.
SAMPLE_BYTES = 16 << 20
MAX_LANGUAGES = 200


def counts(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, times) of each distinct gram of each text, in order."""
    low = tc.lowered(column)
    data, _ = tc.raw(low)
    none = np.zeros(0, np.int64)
    if not len(data):
        return none, none, none
    code = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.uint64)
    length = pc.utf8_length(low).to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(length)), length).astype(np.uint64)
    code[(code < 128) & ((code < 97) | (code > 122))] = 32
    row <<= np.uint64(bits)
    keys = []
    for n in (1, 2, 3):
        if len(code) < n:
            break
        m = len(code) - n + 1
        x = code[:m] + np.uint64(n << 60)
        for j in range(1, n):
            x = x * np.uint64(0x100000001B3) + code[j : j + m]
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x >>= np.uint64(64 - bits)
        x |= row[:m]
        keys.append(x[row[:m] == row[n - 1 :]] if n > 1 else x)
    key = np.concatenate(keys)
    if len(length) <= 1 << (32 - bits):
        key = key.astype(np.uint32)  # sorts twice as fast
    key.sort()
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    times = np.diff(np.concatenate([head, [len(key)]]))
    key = key[head].astype(np.int64)
    return key >> bits, key & ((1 << bits) - 1), times


def frequencies(docs: DataFrame, bits: int = BITS) -> tuple[np.ndarray, int]:
    """How many texts hold each column, and how many texts there are; over all rows, summed up per task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << bits, np.int64), 0
        for batch in batches:
            for part in tc.steps(batch, "text"):
                total += np.bincount(counts(tc.column(part, "text"), bits)[1], minlength=1 << bits)
                n += part.num_rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(total[at], n))], names=["at", "n"])

    rows = docs.select("text").mapInArrow(run, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    at, n = rows["at"].to_numpy(), rows["n"].to_numpy()
    out = np.zeros(1 << bits, np.int64)
    out[at[at >= 0]] = n[at >= 0]
    return out, int(n[at < 0].sum())


@dataclass(frozen=True)
class Model:
    languages: list[str]
    idf: np.ndarray
    weight: np.ndarray
    bias: np.ndarray
    temperature: float
    bits: int

    def logits(self, column: pa.Array) -> np.ndarray:
        row, at, times = counts(column, self.bits)
        return _scores(*_scaled(row, at, times, self.idf, len(column)), self.weight, self.bias, len(column))

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        p = _softmax(self.logits(column) / self.temperature)
        best = p.argmax(axis=1)
        return best, p[np.arange(len(p)), best]


def _scaled(row: np.ndarray, at: np.ndarray, times: np.ndarray, idf: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    value = times * idf[at]
    norm = np.sqrt(np.bincount(row, value * value, minlength=rows))
    return row, at, value / np.where(norm > 0, norm, 1)[row]


def _scores(row: np.ndarray, at: np.ndarray, value: np.ndarray, weight: np.ndarray, bias: np.ndarray, rows: int) -> np.ndarray:
    return np.stack([np.bincount(row, weight[at, c] * value, minlength=rows) for c in range(weight.shape[1])], axis=1) + bias


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(
    sample: list[tuple[str, str]], seen: np.ndarray, n: int, bits: int = BITS, alpha: float = 1.0, beta: float = 1.0,
    l1: float = 0.02, l2: float = 0.001, epochs: int = 5, batch: int = 32, held: float = 0.2, seed: int = 5,
) -> Model | None:
    """Train on (text, language) pairs, all but the held share, and calibrate on that; None without any pair."""
    languages = sorted({y for _, y in sample})
    if not languages:
        return None
    idf = np.log((1 + n) / (1 + seen)) + 1.0
    y = np.array([languages.index(k) for _, k in sample])
    row, at, value = _scaled(*counts(pa.array([t for t, _ in sample], type=pa.large_string()), bits), idf, len(sample))
    bound = np.searchsorted(row, np.arange(len(sample) + 1))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(sample))
    kept = max(1, int(len(order) * (1 - held)))
    training, testing = order[:kept], order[kept:]
    dims, k = 1 << bits, len(languages)
    z, g2 = np.zeros((dims + 1, k)), np.zeros((dims + 1, k))  # the last row is the bias

    def weights(rows: np.ndarray | slice) -> np.ndarray:
        zz, penalty = z[rows], np.full((len(z[rows]), 1), l1)
        w = -(zz - np.sign(zz) * penalty) / ((beta + np.sqrt(g2[rows])) / alpha + l2)
        return np.where(np.abs(zz) <= penalty, 0.0, w)

    for _ in range(epochs):
        rng.shuffle(training)
        for i in range(0, len(training), batch):
            part = training[i : i + batch]
            pick = np.concatenate([np.arange(bound[r], bound[r + 1]) for r in part])
            local = np.repeat(np.arange(len(part)), np.diff(bound)[part])
            used, where = np.unique(at[pick], return_inverse=True)
            w, b = weights(used), weights(slice(dims, dims + 1))
            p = _softmax(np.stack([np.bincount(local, w[where, c] * value[pick], minlength=len(part)) for c in range(k)], axis=1) + b)
            p[np.arange(len(part)), y[part]] -= 1
            p /= len(part)
            grad = np.stack([np.bincount(where, p[local, c] * value[pick], minlength=len(used)) for c in range(k)], axis=1)
            for rows, w_old, g in ((used, w, grad), (np.array([dims]), b, p.sum(axis=0)[None])):
                step = (np.sqrt(g2[rows] + g * g) - np.sqrt(g2[rows])) / alpha
                z[rows] += g - step * w_old
                g2[rows] += g * g
    all_w = weights(slice(0, dims + 1))
    model = Model(languages, idf, all_w[:-1], all_w[-1], 1.0, bits)
    if len(testing):
        logits = model.logits(pa.array([sample[i][0] for i in testing], type=pa.large_string()))
        model = Model(languages, idf, model.weight, model.bias, temperature(logits, y[testing]), bits)
    return model


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor in [1/100, 100] that minimises the negative log likelihood, by golden section on its logarithm."""
    def loss(t: float) -> float:
        x = logits / np.exp(t)
        x = x - x.max(axis=1, keepdims=True)
        return float((np.log(np.exp(x).sum(axis=1)) - x[np.arange(len(y)), y]).mean())

    a, b, r = np.log(0.01), np.log(100.0), (5**0.5 - 1) / 2
    c, d = b - r * (b - a), a + r * (b - a)
    for _ in range(60):
        if loss(c) <= loss(d):
            b, d = d, c
            c = b - r * (b - a)
        else:
            a, c = c, d
            d = a + r * (b - a)
    return float(np.exp((a + b) / 2))


def sample(docs: DataFrame, per_language: int, seed: int, max_bytes: int = SAMPLE_BYTES, max_languages: int = MAX_LANGUAGES) -> list[tuple[str, str]]:
    """(text, lang) of at most per_language documents of each language, and at most max_bytes of text a language, by a seeded hash of doc_id.

    First a hash threshold thins each language to about twice the number wanted
    (its ids are counted by sketches, which need no shuffle of them), so that
    nothing after it sees more than a multiple of that many ids.  A doc_id of
    two languages is left out.  Of more than max_languages languages those with
    the most documents are learned.
    """
    ids = docs.where("lang IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "lang")
    sizes = ids.groupBy("lang").agg(F.approx_count_distinct("doc_id", 0.02).alias("size")).orderBy(F.desc("size"), "lang").limit(max_languages)
    at = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30))
    share = (F.lit(2.0) * per_language + 64) / F.col("size") * (1 << 30)
    thin = ids.join(F.broadcast(cut(sizes)), "lang").withColumn("at", at).where(F.col("at") < share)
    thin = thin.groupBy("doc_id", "at").agg(F.min("lang").alias("lang"), F.max("lang").alias("top")).where("lang = top")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("at", "doc_id"))
    chosen = thin.withColumn("rank", rank).where(F.col("rank") <= per_language).select(F.col("doc_id").alias("id"), F.col("lang").alias("y"), "at")
    return bounded_texts(docs, cut(chosen), max_bytes)


def train(docs: DataFrame, per_language: int = 500, seed: int = 5, bits: int = BITS, **options) -> Model | None:
    """Document frequencies from all of docs; weights from at most per_language labelled documents of each language."""
    ready(docs)
    return fit(sample(docs, per_language, seed), *frequencies(docs, bits), bits=bits, **options)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, predicted language and calibrated confidence of every row, over its whole text.

    A null or empty text gets what the bias says; a null doc_id is carried;
    repeated rows are judged each time; other columns (lang too) are ignored;
    an empty table gives an empty result.  Without a model (no row has a
    language) the prediction is null and the confidence 0.
    """
    spark = ready(docs)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in tc.steps(batch, "text"):
                if model:
                    best, sure = model.predict(tc.column(part, "text"))
                    name = pa.array(model.languages, type=pa.string()).take(pa.array(best))
                else:
                    name, sure = pa.nulls(part.num_rows, pa.string()), np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([pc.cast(tc.column(part, "doc_id"), pa.int64()), name, pa.array(sure)], names=["doc_id", "predicted", "confidence"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
