"""Benchmark decontamination by winnowing (operator 2).

Of every w consecutive hashes of k words the least is kept as a fingerprint
(equal least ones all), in documents and in benchmark items alike.  A span of
k + w - 1 words that both share therefore has a fingerprint in common wherever
it lies: none is missed.  Common fingerprints are extended to the left and
right, and the maximal spans of at least k + w - 1 words are reported.  Of an item
of k words or more that is shorter than that, a span is reported if it is the whole
item; the first k words of such items are looked up at every place of a text.
Items of less than k words say too little to be looked for.

Text that repeats itself shares each fingerprint at many places with an item that
does so too.  Only pairs of places are extended of which the fingerprint before
isn't shared as well at the same distance (within k words, so that nothing lies
between): each maximal span has such a pair, its first, and few others.  The work
is that of the spans, not that of all pairs of places.

The benchmark's words are broadcast while they fit BROADCAST_BYTES (its size is
summed first).  A larger benchmark is joined on the fingerprints by a shuffle,
and the texts of the pairs found are compared with the same extension; both
ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .common import broadcast_if_small, cut, fresh, keep_rows, ready

K, W = 8, 6
BROADCAST_BYTES = 64 << 20
PAIR_BYTES = 32 << 20
SCHEMA = "doc_id bigint, item_id bigint, doc_start bigint, item_start bigint, n_words bigint, item_words bigint"


class Index:
    """The words and fingerprints of some items; salts, if given, keep their hashes apart."""

    def __init__(self, column: pa.Array, k: int, w: int, salts: np.ndarray | None = None):
        words = tc.words(column)
        self.hash, self.row, self.bounds = words.hash, words.row, words.bounds()
        g = _salted(tc.grams(self.hash, self.row, k), self.row, salts)
        at = tc.winnow(g, self.row, k, w)
        label = _before(g, self.row, at, k)
        order = np.lexsort((label, g[at]))
        self.print, self.at, self.label = g[at][order], at[order], label[order]
        # fingerprints with equal labels lie together
        both = _both(self.print, self.label)
        head = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
        end = np.append(head[1:], len(both))
        rank = np.argsort(both[head], kind="stable")
        self.block, self.first, self.last = both[head][rank], head[rank], end[rank]
        self.sieve = _sieve(self.print)
        size = np.diff(self.bounds)
        start = self.bounds[:-1][(size >= k) & (size < k + w - 1)]
        self.short_at = start[np.argsort(g[start], kind="stable")]
        self.short = g[self.short_at]
        self.short_sieve = _sieve(self.short)


def _sieve(prints: np.ndarray) -> tc.Sieve:
    bits = np.zeros(tc.Sieve.size(len(prints)) // 8, np.uint8)
    for slot in tc.Sieve.slots(prints, len(bits) * 8):
        np.bitwise_or.at(bits, slot >> np.uint64(3), np.uint8(1) << (slot & np.uint64(7)).astype(np.uint8))
    return tc.Sieve(bits)


def _before(g: np.ndarray, row: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """A hash of the fingerprint before each one and of the way to it; 0 where there is none within k words."""
    out = np.zeros(len(at), np.uint64)
    if len(at) > 1:
        way = at[1:] - at[:-1]
        near = (way <= k) & (row[at[1:]] == row[at[:-1]])
        out[1:][near] = tc.mix(g[at[:-1]] ^ tc.mix(way.astype(np.uint64)))[near] | np.uint64(1)
    return out


def _both(prints: np.ndarray, label: np.ndarray) -> np.ndarray:
    return tc.mix(prints ^ tc.mix(label))


def _salted(g: np.ndarray, row: np.ndarray, salts: np.ndarray | None) -> np.ndarray:
    if salts is None:
        return g
    out = np.where(g == tc.TOP, tc.TOP, tc.mix(g ^ salts[row]))
    return np.where((g != tc.TOP) & (out == tc.TOP), np.uint64(0), out)


def _ranges(first: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, first, first + 1, ... of many) for each index."""
    row = np.repeat(np.arange(len(many)), many)
    return row, first[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)


def matches(column: pa.Array, index: Index, k: int, w: int, salts: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(text, item, start in the text, start in the item, words) of every maximal shared span of k + w - 1 words or more, or of a whole item."""
    doc = tc.words(column)
    g = _salted(tc.grams(doc.hash, doc.row, k), doc.row, salts)
    at = tc.winnow(g, doc.row, k, w)
    label = _before(g, doc.row, at, k)
    hit = index.sieve.has(g[at])
    at, label = at[hit], label[hit]
    first, last = np.searchsorted(index.print, g[at], "left"), np.searchsorted(index.print, g[at], "right")
    # places with the same fingerprint before them are passed over
    both = _both(g[at], label)
    place = np.minimum(np.searchsorted(index.block, both), max(len(index.block) - 1, 0))
    if len(index.block):
        same = (index.block[place] == both) & (label != 0)
        same &= (index.first[place] >= first) & (index.last[place] <= last)
        skip, after = np.where(same, index.first[place], last), np.where(same, index.last[place], last)
    else:
        skip = after = last
    x, a = _ranges(first, skip - first)
    y, b = _ranges(after, last - after)
    i, j = np.concatenate([at[x], at[y]]), index.at[np.concatenate([a, b])]
    if len(index.short):
        some = np.flatnonzero(index.short_sieve.has(g) & (g != tc.TOP))
        low = np.searchsorted(index.short, g[some], "left")
        z, c = _ranges(low, np.searchsorted(index.short, g[some], "right") - low)
        i, j = np.concatenate([i, some[z]]), np.concatenate([j, index.short_at[c]])
    none = np.zeros(0, np.int64)
    if salts is not None and len(i):
        same = doc.row[i] == index.row[j]
        i, j = i[same], j[same]
    if not len(i):
        return none, none, none, none, none
    bounds = doc.bounds()
    r, s = doc.row[i], index.row[j]
    left = _extend(doc.hash, index.hash, i - 1, j - 1, np.minimum(i - bounds[r], j - index.bounds[s]), -1)
    right = _extend(doc.hash, index.hash, i, j, np.minimum(bounds[r + 1] - i, index.bounds[s + 1] - j), 1)
    n = left + right
    keep = n >= np.minimum(k + w - 1, np.maximum(np.diff(index.bounds)[s], k))
    found = np.unique(np.stack([r[keep], s[keep], (i - left - bounds[r])[keep], (j - left - index.bounds[s])[keep], n[keep]], axis=1), axis=0)
    return tuple(found.T)


def _extend(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray, step: int, cells: int = 1 << 21) -> np.ndarray:
    """How many words agree from each pair of places on, most at most; in blocks that grow, then by powers of two."""
    got = np.zeros(len(i), np.int64)
    live, block, done = np.flatnonzero(most > 0), 1, 0
    while len(live):
        if done >= 128 and len(live) >= 64:  # long spans, and many: their words aren't compared one by one
            x, y, left = i[live] + step * got[live], j[live] + step * got[live], most[live] - got[live]
            low = [min(z.min(), (z + step * (left - 1)).min()) for z in (x, y)]
            high = [max(z.max(), (z + step * (left - 1)).max()) + 1 for z in (x, y)]
            if high[1] - low[1] <= cells:
                one, two = a[low[0] : high[0]], b[low[1] : high[1]]
                if step < 0:
                    one, two, x, y = one[::-1], two[::-1], high[0] - 1 - x, high[1] - 1 - y
                else:
                    x, y = x - low[0], y - low[1]
                got[live] += _doubling(one, two, x, y, left)
                break
        block = min(2 * block, max(2, cells // len(live)))
        done += block
        ahead = got[live][:, None] + np.arange(block)
        inside = ahead < most[live][:, None]
        ahead = np.where(inside, ahead, 0) * step
        agree = (a[i[live][:, None] + ahead] == b[j[live][:, None] + ahead]) & inside
        run = np.where(agree.all(axis=1), block, agree.argmin(axis=1))
        got[live] += run
        live = live[(run == block) & (got[live] < most[live])]
    return got


def _doubling(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """The same from hashes of 1, 2, 4, ... words at every place: the length's binary digits, from the highest."""
    levels = [(a, b)]
    for p in range(1, int(most.max()).bit_length()):
        half = 1 << (p - 1)
        if min(len(a), len(b)) < 2 * half:
            break
        levels.append(tuple(tc.mix(x[:-half] * tc._ROLL + tc.mix(x[half:])) for x in levels[-1]))
    got = np.zeros(len(i), np.int64)
    for p in reversed(range(len(levels))):
        x, y = levels[p]
        at = np.flatnonzero(got + (1 << p) <= most)
        at = at[x[i[at] + got[at]] == y[j[at] + got[at]]]
        got[at] += 1 << p
    return got


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").alias("item")).where("item IS NOT NULL")


def _fits(benchmark: DataFrame, limit: int) -> bool:
    # a word takes two bytes of text or more, and 32 bytes of index
    size = _items(benchmark).agg(F.sum(F.octet_length("item")), F.count(F.lit(1))).first()
    return 8 * (size[0] or 0) + 8 * size[1] <= limit


def _build(benchmark: DataFrame, k: int, w: int) -> tuple[pa.Array, np.ndarray, Index]:
    table = _items(benchmark).toArrow()
    index = Index(table["item"], k, w)
    return table["item_id"].combine_chunks(), np.diff(index.bounds), index


def contamination(docs: DataFrame, benchmark: DataFrame, k: int = K, w: int = W, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Every maximal span of k + w - 1 words or more, or of a whole item of k words or more, that a document shares with a benchmark item.

    Starts count words (see textcore); n_words is the span's and item_words the
    item's length.  A repeated row gives its rows again, a null doc_id or
    item_id is carried, null and shorter texts match nothing; further columns
    are ignored and empty tables give an empty result.
    """
    spark = ready(docs)
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    if _fits(benchmark, broadcast_bytes):
        shared = spark.sparkContext.broadcast(_build(benchmark, k, w))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, lengths, index = shared.value
            for batch in batches:
                for part in tc.steps(batch, "text"):
                    r, s, x, y, n = matches(tc.column(part, "text"), index, k, w)
                    if len(r):
                        yield _rows(tc.column(part, "doc_id").take(pa.array(r)), ids.take(pa.array(s)), x, y, n, lengths[s])

        return d.mapInArrow(run, SCHEMA)
    return _by_shuffle(d, _items(benchmark), k, w)


def _rows(ids: pa.Array, items: pa.Array, x: np.ndarray, y: np.ndarray, n: np.ndarray, words: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [ids, items, *(pa.array(v.astype(np.int64)) for v in (x, y, n, words))],
        names=["doc_id", "item_id", "doc_start", "item_start", "n_words", "item_words"],
    )


def _prints(df: DataFrame, text: str, key: str, k: int, w: int, short: str | None = None) -> DataFrame:
    """The fingerprints of texts; for items shorter than a window their first gram ("first"), to be met by every gram of a text ("all")."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tc.steps(batch, text):
                words = tc.words(tc.column(part, text))
                g = tc.grams(words.hash, words.row, k)
                if short == "first":
                    size = np.diff(words.bounds())
                    at = words.bounds()[:-1][(size >= k) & (size < k + w - 1)]
                else:
                    at = np.flatnonzero(g != tc.TOP) if short else tc.winnow(g, words.row, k, w)
                pair = pa.table({"print": pa.array(g[at].view(np.int64)), key: tc.column(part, key).take(pa.array(words.row[at]))})
                yield from pair.group_by(["print", key]).aggregate([]).select(["print", key]).to_batches()

    return df.mapInArrow(run, f"print bigint, {key} binary").distinct()


def _met(texts: DataFrame, items: DataFrame) -> DataFrame:
    return texts.join(items, "print").select("dk", "ik")


def _by_shuffle(d: DataFrame, items: DataFrame, k: int, w: int) -> DataFrame:
    """The same rows for a benchmark of any size: joins on fingerprints, then on the texts of the pairs."""
    # rows are named by what they hold, as ids may be null or repeated
    name = lambda c: F.unhex(F.sha2(F.col(c), 256))
    left, right = d.where("text IS NOT NULL").withColumn("dk", name("text")), items.withColumn("ik", name("item"))
    texts, benchmark = left.select("text", "dk"), right.select("item", "ik")
    pairs = _met(_prints(texts, "text", "dk", k, w), _prints(benchmark, "item", "ik", k, w))
    short = cut(_prints(benchmark, "item", "ik", k, w, "first"))
    if not short.isEmpty():
        pairs = pairs.union(_met(_prints(texts, "text", "dk", k, w, "all"), short))
    pairs = pairs.distinct()
    pairs = broadcast_if_small(cut(pairs), PAIR_BYTES, 80)
    both = left.join(pairs, "dk").join(right, "ik").select("doc_id", "text", "item_id", "item")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tc.steps(batch, "text"):
                salts = tc.mix(np.arange(part.num_rows, dtype=np.uint64))
                index = Index(tc.column(part, "item"), k, w, salts)
                r, s, x, y, n = matches(tc.column(part, "text"), index, k, w, salts)
                if len(r):
                    at = pa.array(r)
                    yield _rows(tc.column(part, "doc_id").take(at), tc.column(part, "item_id").take(at), x, y, n, np.diff(index.bounds)[s])

    return both.mapInArrow(run, SCHEMA)


def decontaminate(docs: DataFrame, benchmark: DataFrame, k: int = K, w: int = W, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs without the rows that share a span of k + w - 1 words or more, or a whole item of k words or more, with an item; all columns kept."""
    spark = ready(docs)
    if _fits(benchmark, broadcast_bytes):
        shared = spark.sparkContext.broadcast(_build(benchmark, k, w))

        def decide(column: pa.Array) -> np.ndarray:
            keep = np.ones(len(column), bool)
            keep[matches(column, shared.value[2], k, w)[0]] = False
            return keep

        return keep_rows(docs, decide)
    d = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    name = fresh(docs, "gone")
    gone = cut(_by_shuffle(d, _items(benchmark), k, w).select(F.col("doc_id").alias(name)).distinct())
    return docs.join(broadcast_if_small(gone, PAIR_BYTES, 16), F.xxhash64("text") == F.col(name), "left_anti")
