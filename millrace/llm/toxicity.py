"""Toxicity by compression distance (operator 8).

Two zstandard dictionaries are trained, one on toxic and one on ordinary text.  A
text is cut into windows; each window is compressed with both, and the bytes that
the toxic dictionary saves are the window's gain.  Which match the compressor
finds hangs on chance (what positions share a slot of its tables, what a training
run happened to take in), and with one pair of dictionaries this chance is larger
than what a toxic word saves.  It is averaged out: PAIRS pairs are trained on the
samples in other orders, and a window's gain is the mean over all of them.  To
save time, windows whose mean over the first SCREEN pairs is under `doubt` have
gain 0 and aren't compressed any further.

A dictionary is a general part, trained on a part of the ordinary sample, with the
entropy tables, and behind it (nearest to the window) what the trainer takes from
the class's own windows.  Both dictionaries of a pair share the general part.
Training goes in two rounds.  The first takes all windows of either half of the
sample and judges those of the other half by them; the toxic windows that gain
more than nearly all ordinary ones, and a random part of the ordinary windows, are
what the second round's dictionaries are trained on.  Without this most of the
room goes to what both classes have in common.

What a window gains beyond a threshold (a quantile of held-out ordinary windows)
is its excess.  Two measures of a text are taken: all excess over the square root
of the number of windows, for texts toxic throughout, and the largest excess of a
few neighbouring windows, for a passage in a long text.  Both grow with a text's
length by chance alone; each is therefore given as its distance from the median of
held-out ordinary documents of like length, in units of the distance from there to
their 95th percentile.  The score is the greater of the two, held against a
threshold calibrated on all held-out ordinary documents.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame

from . import textcore as tc
from .common import keep_rows, labelled_sample, ready

PAIRS = 24
SCREEN = 6
WINDOW = 128
#: Neighbouring windows that make a passage, and the least width of a measure, in bytes.
PASSAGE = 4
LEAST_WIDTH = 0.25
#: Training documents of the general part, the least windows worth training on, and how many threads train.
GENERAL_DOCS = 800
LEAST_PIECES = 50
THREADS = 4
SCHEMA = "doc_id bigint, windows bigint, gain double, score double, toxic boolean"


@dataclass(frozen=True)
class Pair:
    toxic: bytes
    ordinary: bytes


@dataclass(frozen=True)
class Model:
    """by_length: the square root of the windows, and median and width of either measure, of ordinary texts by rising length.

    tails: what hardly any ordinary text reaches in either measure, so that both count alike.
    """

    pairs: tuple[Pair, ...]
    window: int
    level: int
    screen: int = 0
    doubt: float = 0.0
    usual: float = 0.0
    threshold: float = 0.0
    by_length: tuple[tuple[float, ...], ...] = ()
    tails: tuple[float, float] = (1.0, 1.0)

    def beyond(self, count: np.ndarray, whole: np.ndarray, passage: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Either measure's distance from the usual one for the text's length."""
        x = np.sqrt(count)
        at, *known = map(np.array, self.by_length)
        mid, width, mid_p, width_p = (np.interp(x, at, u) for u in known)
        longer = np.maximum(x / at[-1], 1)  # longer than all held-out texts: chance gains go on like the square root
        return (whole - mid * longer) / (width * longer), (passage - mid_p) / width_p

    def score(self, count: np.ndarray, whole: np.ndarray, passage: np.ndarray) -> np.ndarray:
        a, b = self.beyond(count, whole, passage)
        return np.where(whole > 0, np.maximum(np.maximum(a / self.tails[0], b / self.tails[1]), 0), 0.0)


def _compressor(dictionary: bytes, level: int) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(dictionary)
    d.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)


def windows(data: bytes, size: int, first: int = 0, upto: int | None = None) -> list[int]:
    """Ends of consecutive windows of at most size bytes of data[first:upto], cut after a space where their second half has one."""
    ends, at, n, find = [], first, len(data) if upto is None else upto, data.rfind
    while n - at > size:
        space = find(b" ", at + size // 2, at + size)
        at = space + 1 if space > 0 else at + size
        ends.append(at)
    if n > at:
        ends.append(n)
    return ends


def _cut(texts: list[bytes], size: int) -> list[bytes]:
    out = []
    for t in texts:
        ends = windows(t, size)
        out += [t[a:b] for a, b in zip([0, *ends], ends)]
    return out


def lengths(compressor: zstandard.ZstdCompressor, data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Compressed lengths of spans of data, each on its own, in one call."""
    spans = np.stack([start, end - start], axis=1).astype("<u8")
    made = compressor.multi_compress_to_buffer(zstandard.BufferWithSegments(data, spans.tobytes()))
    return np.fromiter((len(made[i]) for i in range(len(made))), np.int64, len(made))


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.pairs = [(_compressor(p.toxic, model.level), _compressor(p.ordinary, model.level)) for p in model.pairs]

    def gains(self, data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The mean gain of each window; 0 where the first pairs see none."""
        out, at = np.zeros(len(start)), np.arange(len(start))
        for k, (toxic, ordinary) in enumerate(self.pairs):
            if k and k == self.model.screen:
                keep = out >= self.model.doubt * k
                out[~keep], at = 0.0, np.flatnonzero(keep)
            if not len(at):
                break
            a, b = start[at], end[at]
            out[at] += lengths(ordinary, data, a, b) - lengths(toxic, data, a, b)
        return out / max(len(self.pairs), 1)

    def each(self, pieces: list[bytes], pool: ThreadPoolExecutor) -> np.ndarray:
        """The mean gain of each piece over all pairs."""
        end = np.cumsum([len(p) for p in pieces], dtype=np.int64)
        start, data = np.concatenate([[0], end[:-1]]), b"".join(pieces)
        found = pool.map(lambda p: lengths(p[1], data, start, end) - lengths(p[0], data, start, end), self.pairs) if pieces else []
        return sum(found, np.zeros(len(pieces))) / max(len(self.pairs), 1)

    def cut(self, column: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """The lower-cased texts as one run of bytes, start and end of their windows, and each text's number of them."""
        raw, offsets = tc.raw(tc.lowered(column))
        data, at = raw.tobytes(), offsets.tolist()
        ends = [windows(data, self.model.window, a, b) for a, b in zip(at, at[1:])]
        start = [a for first, e in zip(at, ends) for a in (first, *e[:-1]) if e]
        return data, np.array(start, np.int64), np.array([x for e in ends for x in e], np.int64), np.array([len(e) for e in ends], np.int64)

    def measure(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows, excess, excess by the square root of windows and best passage's excess of each text."""
        data, start, end, count = self.cut(column)
        excess = np.maximum(self.gains(data, start, end) - self.model.usual, 0)
        total = np.concatenate([[0], np.cumsum(excess)])
        bound = np.concatenate([[0], np.cumsum(count)])
        gain = np.add.reduceat(np.append(excess, 0.0), np.minimum(bound[:-1], len(excess))) * (count > 0) if len(count) else np.zeros(0)
        passage = np.zeros(len(count))
        if len(excess):
            row = np.repeat(np.arange(len(count)), count)
            upto = np.minimum(np.arange(len(excess)) + PASSAGE, bound[row + 1])
            np.maximum.at(passage, row, total[upto] - total[:-1])
        # running sums leave traces of rounding where there is no excess
        passage[gain == 0] = 0.0
        return count, gain, gain / np.sqrt(np.maximum(count, 1)), passage

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows, excess and score of each text."""
        count, gain, whole, passage = self.measure(column)
        return count, gain, self.model.score(count, whole, passage)


def _by_length(count: np.ndarray, *measures: np.ndarray, least: int = 50, most: int = 8) -> tuple[tuple[float, ...], ...]:
    """Model.by_length from the windows and measures of ordinary texts, in classes of at least `least` of them where there are as many."""
    classes = np.array_split(np.argsort(count, kind="stable"), max(1, min(most, len(count) // least)))
    rows = []
    for c in classes:
        row = [max(1.0, float(np.sqrt(count[c]).mean()))]
        for m in measures:
            mid, high = np.percentile(m[c], [50, 95])
            row += [float(mid), max(float(high - mid), LEAST_WIDTH)]
        rows.append(row)
    return tuple(zip(*rows))


def _trained(size: int, pieces: list[bytes], k: int, d: int = 8) -> bytes:
    try:
        return zstandard.train_dictionary(size, pieces, k=k, d=d).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself, without tables
        return b" ".join(pieces)[-size:]


def _general(ordinary: list[bytes], rng: random.Random, window: int, size: int) -> bytes:
    return _trained(size, _cut(rng.sample(ordinary, min(len(ordinary), GENERAL_DOCS)), 2 * window), 48)


def _pair(pieces: dict[int, list[bytes]], base: bytes, rng: random.Random, own: int, k: int) -> Pair:
    """One pair of dictionaries; the order of the samples decides what the trainer takes from them."""
    # the trainer puts tables before the content: only content of the size wanted is taken
    segments = {y: _trained(own + 1024, rng.sample(p, len(p)), k)[-own:] for y, p in pieces.items()}
    return Pair(base + segments[1], base + segments[0])


def _mined(data: dict[int, list[bytes]], pool: ThreadPoolExecutor, seed: int, pairs: int, window: int, level: int, general: int, rounds: tuple[tuple[int, int], ...], share: float) -> dict[int, list[bytes]]:
    """Training windows of both classes; either half's are found by dictionaries trained on the other half's.

    Toxic windows are those with a gain that only 1 - share of the ordinary
    ones reach; of the ordinary ones a random part, four for each toxic window.
    All windows of a class if there are too few.  Rounds are (size, k) of their
    dictionaries; each is trained on what the one before it found.
    """
    rng = random.Random(seed)
    mixed = {y: rng.sample(t, len(t)) for y, t in data.items()}
    halves = [{y: t[i::2] for y, t in mixed.items()} for i in (0, 1)]
    cut = [{y: _cut(t, window // 2) for y, t in h.items()} for h in halves]
    pieces = [{y: _cut(t, window) for y, t in h.items()} for h in halves]
    for number, (own, k) in enumerate(rounds):
        found = []
        for i in (0, 1):  # judged by the other half
            def one(e: int) -> Pair:
                r = random.Random(f"{seed} {number} {i} {e}")
                return _pair(pieces[1 - i], _general(halves[1 - i][0], r, window, general), r, own, k)

            judge = Scorer(Model(tuple(pool.map(one, range(pairs))), window, level))
            gain = {y: judge.each(w, pool) for y, w in cut[i].items()}
            limit = np.quantile(gain[0], share) if cut[i][0] else 0.0
            toxic = [w for w, g in zip(cut[i][1], gain[1]) if g > limit]
            few = len(toxic) < LEAST_PIECES // 2
            found.append({1: cut[i][1] if few else toxic, 0: cut[i][0] if few else rng.sample(cut[i][0], min(len(cut[i][0]), 4 * len(toxic)))})
        pieces = found
    return {y: pieces[0][y] + pieces[1][y] for y in (0, 1)}


def fit(
    sample: list[tuple[str, int]], pairs: int = PAIRS, window: int = WINDOW, level: int = 3, general: int = 65536, own: int = 3072, k: int = 14,
    mining: tuple[tuple[int, int], ...] = ((12288, 20), (4096, 16)), mining_pairs: int = 14, share: float = 0.99, screen: int = SCREEN, doubt: float = 0.25, usual_share: float = 0.97,
    max_false_rate: float = 0.003, seed: int = 8,
) -> Model | None:
    """Train on (text, toxic) pairs but the last third of the ordinary and the last tenth of the toxic ones, and calibrate on those.

    mining and share: see _mined.  A window's usual gain is what usual_share of
    the held-out ordinary windows stay below.  The
    threshold is the lowest score that at most max_false_rate of the held-out
    ordinary documents reach; the score allows for length (see Model).  Where
    nearly all held-out toxic documents lie beyond it, it is set a fifth of the
    way towards them, as few held-out documents don't show how far ordinary ones
    reach.  None if either class has fewer than five documents: then nothing
    can be learned and no document is toxic.
    """
    sides: dict[int, list[str]] = {0: [], 1: []}
    for text, y in sample:
        sides[y].append(text)
    if min(map(len, sides.values())) < 5:
        return None
    train = {0: sides[0][: max(3, len(sides[0]) * 2 // 3)], 1: sides[1][: max(3, len(sides[1]) * 9 // 10)]}
    held, toxic = (pa.array(sides[y][len(train[y]) :], type=pa.large_string()) for y in (0, 1))
    data = {y: [t.lower().encode() for t in texts] for y, texts in train.items()}
    with ThreadPoolExecutor(THREADS) as pool:
        pieces = _mined(data, pool, seed, mining_pairs, window, level, general, mining, share)

        def one(e: int) -> Pair:
            r = random.Random(f"{seed} {e}")
            return _pair(pieces, _general(data[0], r, window, general), r, own, k)

        model = Model(tuple(pool.map(one, range(pairs))), window, level, screen, doubt)
    scorer = Scorer(model)
    text, start, end, _ = scorer.cut(held)
    scorer.model = model = replace(model, usual=float(np.quantile(scorer.gains(text, start, end), usual_share)) if len(start) else 0.0)
    count, _, whole, passage = scorer.measure(held)
    model = replace(model, by_length=_by_length(count, whole, passage))
    tails = (float(np.quantile(m, 1 - max_false_rate)) for m in model.beyond(count, whole, passage))
    model = replace(model, tails=tuple(max(t, 1.0) for t in tails))
    scores = np.sort(model.score(count, whole, passage))
    threshold = max(float(scores[-1 - int(len(scores) * max_false_rate)]) + 1e-9, 0.5)
    count, _, whole, passage = scorer.measure(toxic)
    further = float(np.quantile(model.score(count, whole, passage), 0.02)) - threshold
    return replace(model, threshold=threshold + max(further, 0.0) / 5)


def train(docs: DataFrame, labels: DataFrame, per_class: int = 4000, seed: int = 8, **options) -> Model | None:
    """Fit on a bounded sample: at most per_class labelled documents of each class (see labelled_sample)."""
    return fit(labelled_sample(docs, labels, "toxic", per_class, seed), seed=seed, **options)


def classify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, windows, gain (bytes beyond the usual), score and verdict of every row of docs, over its whole text.

    A null or empty text has no windows, score 0 and isn't toxic; a null doc_id
    is carried; a repeated row is judged each time; other columns are ignored.
    An empty table gives an empty result.  Without a model nothing is toxic.
    """
    ready(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model and Scorer(model)
        for batch in batches:
            for part in tc.steps(batch, "text"):
                if scorer:
                    count, gain, score = scorer(tc.column(part, "text"))
                    toxic = score >= model.threshold
                else:
                    count = np.zeros(part.num_rows, np.int64)
                    gain, score, toxic = np.zeros(part.num_rows), np.zeros(part.num_rows), count > 0
                yield pa.RecordBatch.from_arrays(
                    [pc.cast(tc.column(part, "doc_id"), pa.int64()), pa.array(count), pa.array(gain), pa.array(score), pa.array(toxic)],
                    names=["doc_id", "windows", "gain", "score", "toxic"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def reject(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs without the rows that classify() calls toxic, all columns kept, in one pass and without a join."""
    ready(docs)
    if model is None:
        return docs
    holder: list[Scorer] = []  # one scorer for each Python worker, made there

    def decide(column: pa.Array) -> np.ndarray:
        if not holder:
            holder.append(Scorer(model))
        return holder[0](column)[2] < model.threshold

    return keep_rows(docs, decide)
