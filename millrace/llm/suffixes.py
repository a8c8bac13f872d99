"""Repeated long passages by a logarithmic family of suffix arrays (operator 3).

A passage is repeated if `least` consecutive words occur at two places of the
corpus.  Suffixes are compared by their first `least` words: an array holds the
suffixes in the order of a 64-bit fingerprint of those words, in which all that
share them are neighbours, and neighbours are compared word for word.

Family.add() takes a batch: it sorts the batch's suffixes into an array,
merge-scans it against each level, marks what matches on both sides, and makes
what is left a new level; while the last level is at least as large as the one
before it the two are merged, so levels grow geometrically and each suffix is
moved a logarithmic number of times.  Levels hold one suffix for each distinct
beginning and the words of the stretches that these lie in, so copies by the
thousand take no more room than one.

The corpus is spread over families by content: a window of `least` words goes
to the family of its minimiser, the least hash of its K-word grams, and equal
windows have equal minimisers.  Neighbouring windows mostly share theirs and
travel as one stretch of words.  A window whose minimiser occurs only once in
the whole corpus cannot repeat; minimisers are counted first, those that occur
again go into a Bloom filter of bounded size, and the other windows stay where
they are.  What the filter lets through by mistake is found unrepeated later.

repeats() does this for a whole table at once; Index keeps the levels as tables
and takes batches as they come.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import delete
from . import textcore as tc
from .common import cut, ready

LEAST = 50
K = 16
#: A batch of a family, in words; memory in a task is a small multiple of it and of the distinct stretches.
BATCH_WORDS = 1 << 20
MAX_FILTER_BITS = 1 << 28
#: Occurrences beyond which a minimiser is hot (its stretches would be some 20 million words in one task), and words after which a family ends with the key it is at.
HOT = 1 << 18
FAMILY_WORDS = 1 << 23
_SLICE = 19


def _prefix(x: np.ndarray, m: int) -> np.ndarray:
    """Fingerprint of the m words from each position where m words are left, by doubling."""
    power, width, have, mult = x, 1, 0, tc.mix(np.array([3], np.uint64))[0] | np.uint64(1)
    out, left = None, m
    with np.errstate(over="ignore"):
        while left:
            if left & 1:
                if out is None:
                    out, have = power, width
                else:
                    n = len(x) - have - width + 1
                    out = out[:n] * mult + power[have : have + n]
                    have += width
            left >>= 1
            if left:
                power = power[: len(power) - width] * mult + power[width:]
                width *= 2
                mult = mult * mult
    return tc.mix(out)


class Array:
    """A level: fingerprints in order, each suffix's stretch, place in it, and whether it was met again.

    It holds the words of its own stretches (with start and tag of each) and no others.
    """

    def __init__(self, key: np.ndarray, row: np.ndarray, at: np.ndarray, seen: np.ndarray, words: np.ndarray, start: np.ndarray, tag: np.ndarray):
        self.key, self.row, self.at, self.seen, self.words, self.start, self.tag = key, row, at, seen, words, start, tag

    def text(self, pick: np.ndarray, least: int) -> np.ndarray:
        """The first `least` words of some suffixes."""
        return self.words[(self.start[self.row[pick]] + self.at[pick])[:, None] + np.arange(least)]

    def only(self, keep: np.ndarray) -> Array:
        """The suffixes to keep, and the stretches that they need."""
        used, row = np.unique(self.row[keep], return_inverse=True)
        ends = np.append(self.start[1:], len(self.words))
        size = (ends - self.start)[used]
        first = np.cumsum(size) - size
        words = self.words[np.repeat(self.start[used] - first, size) + np.arange(size.sum())]
        return Array(self.key[keep], row, self.at[keep], self.seen[keep], words, first, self.tag[used])

    def merged(self, other: Array) -> Array:
        order = np.argsort(np.concatenate([self.key, other.key]), kind="stable")  # two sorted runs
        key, at, seen = (np.concatenate([x, y])[order] for x, y in ((self.key, other.key), (self.at, other.at), (self.seen, other.seen)))
        row = np.concatenate([self.row, other.row + len(self.start)])[order]
        return Array(key, row, at, seen, np.concatenate([self.words, other.words]), np.concatenate([self.start, other.start + len(self.words)]), np.concatenate([self.tag, other.tag]))


class Family:
    """Levels of suffixes, one for each distinct beginning: what repeats is given back and takes no room."""

    def __init__(self, least: int = LEAST):
        self.least = least
        self.levels: list[Array] = []
        self.rows = 0

    @property
    def size(self) -> int:
        """Words held."""
        return sum(len(x.words) for x in self.levels)

    def _equal(self, a: Array, i: np.ndarray, b: Array, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), bool)
        for k in range(0, len(out), 1 << 15):
            part = slice(k, k + (1 << 15))
            out[part] = (a.text(i[part], self.least) == b.text(j[part], self.least)).all(axis=1)
        return out

    def add(self, words: np.ndarray, sizes: np.ndarray, tags: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Adds stretches of words; returns (tag, place) of suffixes already known to be repeats.

        A stretch's tag is its number unless tags are given (a row for each).
        """
        m = self.least
        first = np.cumsum(sizes) - sizes
        tags = np.arange(self.rows, self.rows + len(sizes)) if tags is None else tags
        self.rows += len(sizes)
        if len(words) < m:
            return tags[:0], np.zeros(0, np.int64)
        many = np.maximum(sizes - m + 1, 0)
        row = np.repeat(np.arange(len(sizes)), many)
        at = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        key = _prefix(tc.mix(words.astype(np.uint64)), m)[first[row] + at]
        order = np.argsort(key, kind="stable")
        batch = Array(key[order], row[order], at[order], np.zeros(len(key), bool), words, first, tags)
        # neighbours of the batch's own array
        key = batch.key
        twin = np.flatnonzero(key[1:] == key[:-1]) + 1
        twin = twin[self._equal(batch, twin, batch, twin - 1)]
        again = np.zeros(len(key), bool)
        again[twin] = True
        batch.seen[twin - 1] = True
        batch.seen &= ~again
        # merge scan against each level
        for level in self.levels:
            place = np.minimum(np.searchsorted(level.key, key), len(level.key) - 1)
            hit = np.flatnonzero(level.key[place] == key)
            hit = hit[self._equal(batch, hit, level, place[hit])]
            level.seen[place[hit]] = True
            again[hit] = True
        out = tags[batch.row[again]], batch.at[again]
        if not again.all():
            self.levels.append(batch.only(~again))
        while len(self.levels) > 1 and len(self.levels[-1].key) >= len(self.levels[-2].key):
            b, a = self.levels.pop(), self.levels.pop()
            self.levels.append(a.merged(b))
        return out

    def repeated(self) -> tuple[np.ndarray, np.ndarray]:
        """(tag, place) of the suffixes in the levels that were met again."""
        if not self.levels:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return (np.concatenate([x.tag[x.row[x.seen]] for x in self.levels]), np.concatenate([x.at[x.seen] for x in self.levels]))


def _minimisers(column: pa.Array, least: int, k: int) -> tuple[tc.Words, np.ndarray, np.ndarray]:
    w = tc.words(column)
    m, whole = tc.window_minima(tc.grams(w.hash, w.row, k), w.row, k, least - k + 1)
    return w, m, whole


def _counted(docs: DataFrame, least: int, k: int) -> DataFrame:
    """Minimisers that occur at two places or more, and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tc.steps(batch, "text"):
                w = tc.words(tc.column(part, "text"))
                g = tc.grams(w.hash, w.row, k)
                key, n = np.unique(g[tc.winnow(g, w.row, k, least - k + 1)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int32))], names=["key", "n"])

    return docs.select("text").mapInArrow(run, "key bigint, n int").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1")


def _filter(keys: DataFrame, max_bits: int) -> tc.Sieve:
    """A Bloom filter of keys; its slices are made in parallel, and it never exceeds max_bits."""
    bits = tc.Sieve.size(keys.count(), max_bits)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(np.concatenate(tc.Sieve.slots(b.column(0).to_numpy().view(np.uint64), bits))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((at >> _SLICE).astype(np.int32)), pa.array(at)], names=["slice", "slot"])

    def fill(table: pa.Table) -> pa.Table:
        slice_ = table["slice"][0].as_py()
        at = table["slot"].to_numpy() - (slice_ << _SLICE)
        flags = np.zeros(min(bits, 1 << _SLICE), bool)
        flags[at] = True
        return pa.table({"slice": pa.array([slice_], pa.int32()), "bits": pa.array([np.packbits(flags, bitorder="little").tobytes()])})

    made = keys.select("key").mapInArrow(slots, "slice int, slot bigint").groupBy("slice").applyInArrow(fill, "slice int, bits binary").collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in made:
        at = r["slice"] << (_SLICE - 3)
        out[at : at + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return tc.Sieve(out)


def _runs(tag: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tag, from, to) of the words that neighbouring suffixes cover; tags have a row for each suffix."""
    order = np.lexsort((at, *tag.T[::-1]))
    tag, at = tag[order], at[order]
    head = np.ones(len(at), bool)
    head[1:] = (tag[1:] != tag[:-1]).any(axis=1) | (at[1:] > at[:-1] + 1)
    tail = np.concatenate([head[1:], [True]]) if len(at) else head
    return tag[head], at[head], at[tail] + least


def _stretches(docs: DataFrame, least: int, k: int, sieve=None, hot=None) -> DataFrame:
    """key, doc_id, start and words of the stretches of neighbouring windows with one minimiser: all, or those the filter lets through and `hot` doesn't hold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tc.steps(batch, "text"):
                w, m, whole = _minimisers(tc.column(part, "text"), least, k)
                take = whole.copy()
                if sieve is not None:
                    take[whole] = sieve.value.has(m[whole])
                if hot is not None:
                    take[take] = ~hot.value.has(m[take])
                i = np.flatnonzero(take)
                if not len(i):
                    continue
                head = np.ones(len(i), bool)
                head[1:] = (i[1:] != i[:-1] + 1) | (m[i[1:]] != m[i[:-1]])
                a, b = i[head], i[np.concatenate([head[1:], [True]])] + least
                size = b - a
                flat = np.repeat(a - (np.cumsum(size) - size), size) + np.arange(size.sum())
                words = w.hash[flat].astype(np.uint32)
                row = w.row[a]
                offsets = pa.py_buffer(np.concatenate([[0], np.cumsum(size * 4)]).astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(m[a].view(np.int64)), tc.column(part, "doc_id").take(pa.array(row)), pa.array(a - w.bounds()[row]),
                     pa.Array.from_buffers(pa.binary(), len(a), [None, offsets, pa.py_buffer(words.tobytes())])],
                    names=["key", "doc_id", "start", "words"],
                )

    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return docs.mapInArrow(run, "key bigint, doc_id bigint, start bigint, words binary")


def _hot_windows(docs: DataFrame, least: int, k: int, hot) -> DataFrame:
    """doc_id, start and end of the repeated windows among those with a hot minimiser.

    A minimiser that occurs very often would bring all its stretches to one
    task.  Its windows are named by 128 bits of their words instead; equal ones
    are counted where they are before they move, and those that repeat are found
    by a join, whose skewed keys can be split.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tc.steps(batch, "text"):
                w, m, whole = _minimisers(tc.column(part, "text"), least, k)
                take = whole.copy()
                take[whole] = hot.value.has(m[whole])
                i = np.flatnonzero(take)
                if len(i):
                    one, two = (_prefix(tc.mix(w.hash ^ np.uint64(salt)), least)[i].view(np.int64) for salt in (0, 0x5BD1E995))
                    row = w.row[i]
                    yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), tc.column(part, "doc_id").take(pa.array(row)), pa.array(i - w.bounds()[row])], names=["one", "two", "doc_id", "start"])

    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    windows = cut(docs.mapInArrow(run, "one bigint, two bigint, doc_id bigint, start bigint"))
    again = windows.groupBy("one", "two").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    found = windows.where("doc_id IS NOT NULL").join(again, ["one", "two"], "left_semi")
    return found.select("doc_id", "start", (F.col("start") + least).alias("end"))


def _repeated(stretches: DataFrame, least: int, batch_words: int, family_words: int) -> DataFrame:
    """doc_id, start and end of what repeats among stretches: equal keys are in one partition, in order of the key, and in one family.

    A family ends with the key at which it has taken family_words words, so a
    task's memory is bounded by that and by the stretches of one key.
    """
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, taken, last = Family(least), 0, None
        held: list[pa.RecordBatch] = []
        size = 0

        def rows(tag: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(at):
                tag, a, b = _runs(tag, at, least)
                known = tag[:, 1] == 0
                doc, start = tag[known, 0], tag[known, 2]
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(start + a[known]), pa.array(start + b[known])], names=["doc_id", "start", "end"])

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, size, taken
            t = pa.Table.from_batches(held)
            held, size = [], 0
            lengths = pc.binary_length(t["words"]).to_numpy().astype(np.int64) // 4
            words = np.concatenate([np.frombuffer(b"".join(x.to_pylist()), "<u4") for x in t["words"].chunks])
            doc = t["doc_id"]
            tags = np.stack([pc.fill_null(doc, 0).to_numpy(), pc.is_null(doc).to_numpy().astype(np.int64), t["start"].to_numpy()], axis=1)
            taken += len(words)
            yield from rows(*family.add(words, lengths, tags))

        for batch in batches:
            keys, at = tc.column(batch, "key").to_numpy(), 0
            while at < len(keys):
                upto = len(keys)
                if taken + size // 4 >= family_words:  # on to the end of this key
                    other = np.flatnonzero(keys[at:] != last)
                    upto = at + int(other[0]) if len(other) else upto
                if upto > at:
                    held.append(batch.slice(at, upto - at))
                    size += pc.sum(pc.binary_length(tc.column(held[-1], "words"))).as_py() or 0
                    last = keys[upto - 1]
                if held and (size >= 4 * batch_words or upto < len(keys)):
                    yield from flush()
                if upto < len(keys):
                    yield from rows(*family.repeated())
                    family, taken = Family(least), 0
                at = upto
        if held:
            yield from flush()
        yield from rows(*family.repeated())

    return stretches.repartition("key").sortWithinPartitions("key").mapInArrow(match, "doc_id bigint, start bigint, end bigint")


def _islands(covered: DataFrame) -> DataFrame:
    """doc_id, start, end and n_words of the union of the stretches of each document."""
    # rows repeated under one doc_id give the same stretches: they are one before they meet
    covered = covered.groupBy("doc_id", "start").agg(F.max("end").alias("end"))
    order = Window.partitionBy("doc_id").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = covered.withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1))
    island = marked.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return (
        island.groupBy("doc_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .select("doc_id", "start", "end", (F.col("end") - F.col("start")).alias("n_words"))
    )


def repeats(
    docs: DataFrame, least: int = LEAST, k: int = K, batch_words: int = BATCH_WORDS, max_filter_bits: int = MAX_FILTER_BITS, hot: int = HOT, family_words: int = FAMILY_WORDS,
) -> DataFrame:
    """doc_id, start, end and n_words of each maximal stretch covered by repeated passages of at least `least` words.

    Words are counted from 0, end is exclusive (see textcore for words).  Every
    occurrence is reported, the first too, and also passages that repeat within
    one document.  A repeated row counts as another occurrence.  The stretches
    of several texts under one doc_id are given as one union.  Rows without
    doc_id count as occurrences but aren't reported; null, empty and shorter
    texts have no passages; other columns are ignored; an empty table gives an
    empty result.  Minimisers that occur more than `hot` times go another way,
    with the same result (see _hot_windows).
    """
    spark = ready(docs)
    keys = cut(_counted(docs, least, k))
    sieve = spark.sparkContext.broadcast(_filter(keys, max_filter_bits))
    often = keys.where(F.col("n") > hot)
    if often.isEmpty():
        return _islands(_repeated(_stretches(docs, least, k, sieve), least, batch_words, family_words))
    # the filter for these may let others through as well: a window's way follows from its minimiser alone
    apart = spark.sparkContext.broadcast(_filter(often, max_filter_bits))
    found = _repeated(_stretches(docs, least, k, sieve, apart), least, batch_words, family_words)
    return _islands(found.unionByName(_hot_windows(docs, least, k, apart)))


class Index:
    """A family kept in a folder that all executors share, for corpora that arrive batch by batch.

    A level is a table of stretches.  add() scans a batch against the stretches
    of each level that have its minimisers, and returns what repeats; then the
    batch becomes a level, and while the last level is at least as large as the
    one before it both are written as one.  The list of levels is a table with a
    number of its own, written last: what a lost job leaves behind isn't listed.
    Unlike repeats() it can't know which windows will never come again, so all
    are kept: about two and a half times the text.
    """

    SCHEMA = "key bigint, doc_id bigint, start bigint, words binary"

    def __init__(self, spark: SparkSession, folder: str, least: int = LEAST, k: int = K, batch_words: int = BATCH_WORDS):
        self.spark, self.folder, self.least, self.k, self.batch_words = spark, folder.rstrip("/"), least, k, batch_words

    def _version(self) -> int:
        """The greatest number of a whole list of levels; -1 for none."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/levels-*/_SUCCESS")
        found = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
        return max((int(f.getPath().getParent().getName().split("-")[1]) for f in found or []), default=-1)

    def levels(self) -> list[tuple[str, int]]:
        """(name, stretches) of each level, the oldest and largest first."""
        n = self._version()
        if n < 0:
            return []
        rows = self.spark.read.schema("place int, name string, size bigint").parquet(f"{self.folder}/levels-{n}").collect()
        return [(r["name"], r["size"]) for r in sorted(rows)]

    def _level(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(f"{self.folder}/{name}")

    def add(self, docs: DataFrame) -> DataFrame:
        """What repeats() says of the batch and of older documents that share a passage with it; columns and odd rows as there."""
        ready(docs)
        levels, gone = self.levels(), []
        name = f"level-{uuid.uuid4().hex}"
        _stretches(docs, self.least, self.k).write.parquet(f"{self.folder}/{name}")
        new = self._level(name)
        met = new
        for old, _ in levels:
            met = met.unionByName(self._level(old).join(new.select("key").distinct(), "key", "left_semi"))
        found = cut(_islands(_repeated(met, self.least, self.batch_words, FAMILY_WORDS)))  # before any level is merged away
        levels.append((name, new.count()))
        while len(levels) > 1 and levels[-1][1] >= levels[-2][1]:
            (b, n), (a, m) = levels.pop(), levels.pop()
            merged = f"level-{uuid.uuid4().hex}"
            self._level(a).unionByName(self._level(b)).repartition("key").sortWithinPartitions("key").write.parquet(f"{self.folder}/{merged}")
            levels.append((merged, m + n))
            gone += [a, b]
        version = self._version()
        rows = [(i, x, n) for i, (x, n) in enumerate(levels)]
        self.spark.createDataFrame(rows, "place int, name string, size bigint").coalesce(1).write.parquet(f"{self.folder}/levels-{version + 1}")
        for old in gone:
            delete(self.spark, f"{self.folder}/{old}")
        if version >= 0:
            delete(self.spark, f"{self.folder}/levels-{version}")
        return found
