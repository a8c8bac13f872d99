"""SimHash near-duplicates by vantage-point trees (operator 6).

Fingerprint: 256 SimHash bits (WORDS of 64) over a text's distinct words.  Two
fingerprints are a pair if they differ in at most `radius` bits, whatever the
texts' lengths.  A length code (UNARY * ln(words)) is kept beside the bits; a
caller can ask for pairs within `slack` of it, and by default there is no limit.

Search: a vantage-point tree is grown on a bounded sample of the fingerprints.
A node splits at a radius round a vantage point - a fingerprint, or the empty
unary code - whichever leaves the fewest points within reach of the boundary.
Every fingerprint has one home shard, and as a query visits the shards beyond
each boundary that its ball crosses (|d - cut| <= reach); the rest is pruned.
At the radius of near copies distances of unrelated texts crowd round half the
bits, where no vantage point prunes, and the tree is often a single shard.

Within a shard pigeonhole bands prune: cut into m bands, fingerprints within
the radius differ in at most t = ceil((radius + 1) / m) - 1 bits of some band
(for 51: 3 bits of one of 13).  Taken round the ring of bands, one such band can
even be chosen so that it and the l - 1 after it differ by l * radius / m bits at
most, for every l.  So a task looks up the values within t bits of each point's in
its bands, and of what it finds counts the AFTER bits behind the band first: of
unrelated fingerprints next to none are left, and of the rest all bits are counted.
A pair is given by the first band that finds it.  All bounds are exact, so no pair
is lost.  Large
shards are cut into tiles, and a task compares two tiles of at most about
TILE_POINTS points: with T tiles each fingerprint is sent to T + 1 tasks.  Only
while tiles are too few to occupy the cluster are the bands of two tiles spread
over several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .common import broadcast_if_small, cut, fresh, ready

UNARY = 100
WORDS = 4
PRINT = tuple(f"f{i}" for i in range(WORDS))
KEY = (*PRINT, "code")
TASK = ("leaf", "tile", "block", "share")
RADIUS = 51
#: No limit: a pair is defined by the radius alone.
SLACK = 1 << 30
#: Below this many words the fingerprint is a hash of the word sequence: only equal sequences pair.
LEAST_WORDS = 8
SAMPLE = 40_000
LEAF_SHARE = 1 / 64
TILE_POINTS = 1 << 21
BAND_BITS = 20
BAND_REACH = 3
#: Bits behind a band that are counted before all of them: they fit a word, and three bands of 13.
AFTER = 59
#: Pairs of tiles that aren't worth spreading further, for each core.
TASKS_A_CORE = 2
REMOVED_BYTES = 64 << 20

_LANES = np.array([sum(((v >> b) & 1) << (16 * b) for b in range(4)) for v in range(16)], dtype=np.uint64)
_SEGMENT = 32_768


def _bits_of(feature: np.ndarray) -> list[np.ndarray]:
    """WORDS independent 64-bit hashes of each feature."""
    return [feature if not i else tc.mix(feature + np.uint64(i)) for i in range(WORDS)]


def _simhash(feature: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """(WORDS, rows) from 64-bit features sorted by row: each bit's majority.

    Four bits are counted at once in the 16-bit lanes of a 64-bit sum.
    """
    out = np.zeros((WORDS, rows), np.uint64)
    if not len(feature):
        return out
    starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(row)]]))
    pieces = -(-sizes // _SEGMENT)
    owner = np.repeat(np.arange(len(starts)), pieces)
    first = np.cumsum(pieces) - pieces
    cuts = starts[owner] + (np.arange(len(owner)) - first[owner]) * _SEGMENT
    present = row[starts]
    for half, f in enumerate(_bits_of(feature)):
        for nibble in range(16):
            lanes = np.add.reduceat(_LANES[(f >> np.uint64(4 * nibble)) & np.uint64(15)], cuts)
            for b in range(4):
                ones = ((lanes >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
                if len(owner) != len(starts):
                    ones = np.add.reduceat(ones, first)
                out[half, present] |= (2 * ones > sizes).astype(np.uint64) << np.uint64(4 * nibble + b)
    return out


def fingerprint(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The SimHash (WORDS, texts) and the number of words of each text."""
    w = tc.words(column)
    bounds = w.bounds()
    n = np.diff(bounds)
    # 40 bits of hash tell the words of one text apart; rows of one step fit 24 bits
    key = np.sort((w.row.astype(np.uint64) << np.uint64(40)) | (w.hash >> np.uint64(24)))
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    out = _simhash(tc.mix(key & np.uint64((1 << 40) - 1)), (key >> np.uint64(40)).astype(np.int64), w.rows)
    for i in np.flatnonzero((n > 0) & (n < LEAST_WORDS)):
        h = np.uint64(n[i])
        for x in w.hash[bounds[i] : bounds[i + 1]]:
            h = tc.mix(np.array([h ^ x]))[0]
        out[:, i] = [x[0] for x in _bits_of(np.array([h]))]
    return out, n


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text, the SimHash words and the length code of each row with at least one word, in one pass."""
    ready(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tc.steps(batch, "text"):
                words, n = fingerprint(tc.column(part, "text"))
                ids = pc.cast(tc.column(part, "doc_id"), pa.int64())
                code = np.floor(UNARY * np.log(np.maximum(n, 1))).astype(np.int32)
                out = pa.RecordBatch.from_arrays([ids, tc.column(part, "text_hash"), *(pa.array(x.view(np.int64)) for x in words), pa.array(code)], names=["doc_id", "text_hash", *KEY])
                yield out.filter(pa.array(n > 0))

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, f"doc_id bigint, text_hash bigint, {_DDL}")


_DDL = ", ".join([f"{c} bigint" for c in PRINT] + ["code int"])
#: The words of some fingerprints, and their length codes.
Points = tuple[np.ndarray, np.ndarray]


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints whose words lie on the first axis; the rest is broadcast."""
    d = np.bitwise_count(a[0] ^ b[0]).astype(np.uint16)
    for x, y in zip(a[1:], b[1:]):
        d += np.bitwise_count(x ^ y)
    return d


@dataclass
class Tree:
    """Split nodes: vantage (None: the empty unary code), cut, and the two sides; a leaf has its number."""

    leaf: int = -1
    vantage: tuple[int, ...] | None = None
    cut: int = 0
    inner: Tree | None = None
    outer: Tree | None = None
    leaves: int = field(default=1)

    def distance(self, words: np.ndarray, code: np.ndarray) -> np.ndarray:
        if self.vantage is None:
            return code.astype(np.int64)
        return hamming(words, np.array(self.vantage, np.uint64)[:, None]).astype(np.int64)

    def route(self, words: np.ndarray, code: np.ndarray, radius: int, slack: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(point, leaf, whether it is the point's home) for every shard that a point's ball reaches."""
        points, leaves, homes = [], [], []

        def down(node: Tree, at: np.ndarray, home: np.ndarray) -> None:
            if not len(at):
                return
            if node.inner is None:
                points.append(at), leaves.append(np.full(len(at), node.leaf)), homes.append(home)
                return
            d = node.distance(words[:, at], code[at])
            reach = slack if node.vantage is None else radius
            inside = d <= node.cut
            # a pair within reach on the inner side needs d - reach <= cut, on the outer d + reach > cut
            into, out = d - reach <= node.cut, d + reach > node.cut
            down(node.inner, at[into], (home & inside)[into])
            down(node.outer, at[out], (home & ~inside)[out])

        down(self, np.arange(len(code)), np.ones(len(code), bool))
        return np.concatenate(points or [np.zeros(0, np.int64)]), np.concatenate(leaves or [np.zeros(0, np.int64)]), np.concatenate(homes or [np.zeros(0, bool)])


def grow(words: np.ndarray, code: np.ndarray, radius: int, slack: int, leaf_share: float = LEAF_SHARE, tries: int = 6, seed: int = 6) -> Tree:
    """A vantage-point tree on sample points; splits until a leaf has leaf_share of them or no split prunes."""
    rng = np.random.default_rng(seed)
    least = max(2, int(len(code) * leaf_share))
    counter = iter(range(1 << 30))

    def split(at: np.ndarray) -> Tree:
        best = None
        if len(at) > least:
            options: list[tuple[int, ...] | None] = [None]
            options += [tuple(map(int, words[:, i])) for i in rng.choice(at, min(tries, len(at)), replace=False)]
            for v in options:
                node = Tree(vantage=v)
                d = node.distance(words[:, at], code[at])
                node.cut = int(np.median(d))
                reach = slack if v is None else radius
                inner, outer = (d - reach <= node.cut).mean(), (d + reach > node.cut).mean()
                share = inner**2 + outer**2  # comparisons left, in units of all
                if share < 0.95 and (best is None or share < best[0]):
                    best = (share, node, d <= node.cut)
        if best is None or best[2].all() or not best[2].any():
            return Tree(leaf=next(counter))
        _, node, inside = best
        node.inner, node.outer = split(at[inside]), split(at[~inside])
        return node

    root = split(np.arange(len(code)))
    root.leaves = next(counter)
    return root


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (point, least point) of the connected components of a graph on integers."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        np.minimum.at(new, label[x], least)
        np.minimum.at(new, label[y], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def _bands(radius: int) -> tuple[list[int], int]:
    """Edges of the bands and the bits that a pair within radius differs by, at most, in one of them."""
    bits = 64 * WORDS
    m = min(bits, max(-(-bits // BAND_BITS), -(-(radius + 1) // (BAND_REACH + 1))))
    return [bits * i // m for i in range(m + 1)], -(-(radius + 1) // m) - 1


def _value(words: np.ndarray, low: int, high: int) -> np.ndarray:
    """Bits low to high of fingerprints whose words lie on the first axis; beyond the last bit the first follows."""
    w, shift = divmod(low % (64 * WORDS), 64)
    v = words[w] >> np.uint64(shift)
    if shift + high - low > 64:
        v = v | (words[(w + 1) % WORDS] << np.uint64(64 - shift))
    return (v & np.uint64((1 << (high - low)) - 1)).astype(np.int64)


def _most(radius: int, band: int) -> int:
    """The bits that a pair differs by, at most, in a band and the AFTER bits behind it, if that band finds it."""
    edges, _ = _bands(radius)
    m, covered, end = len(edges) - 1, 1, 0
    while end < AFTER:
        at = (band + covered) % m
        end += edges[at + 1] - edges[at]
        covered += 1
    return covered * radius // m


def _finds(differ: np.ndarray, radius: int, band: int) -> np.ndarray:
    """Whether band finds pairs with these differing bits (words on the first axis)."""
    edges, reach = _bands(radius)
    low, high = edges[band : band + 2]
    n = np.bitwise_count(_value(differ, low, high)).astype(np.int64)
    return (n <= reach) & (n + np.bitwise_count(_value(differ, high, high + AFTER)) <= _most(radius, band))


def _runs(first: np.ndarray, many: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, partner) with partners first[row] : first[row] + many[row], about most of them at a time."""
    total, at = np.cumsum(many), 0
    while at < len(many):
        done = total[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(total, done + most, "right")))
        c = many[at:upto]
        row = np.repeat(np.arange(at, upto), c)
        yield row, np.arange(len(row)) + np.repeat(first[at:upto] - (total[at:upto] - c - done), c)
        at = upto


@dataclass
class _Side:
    """Points in the order of their values in a band: first and number of each value, and the AFTER bits behind it.

    The first `layers` points of every value are looked up without asking
    whether they are there, as an eighth of the values at least has the last
    of them; `rest` are the points beyond, `more` the values that have such.
    """

    order: np.ndarray
    value: np.ndarray
    start: np.ndarray
    count: np.ndarray
    after: list[np.ndarray]
    more: np.ndarray
    rest: np.ndarray

    @staticmethod
    def of(words: np.ndarray, low: int, high: int) -> _Side:
        value = _value(words, low, high)
        order = np.argsort(value, kind="stable")
        value, after = value[order], _value(words, high, high + AFTER)[order].view(np.uint64)
        count = np.bincount(value, minlength=1 << (high - low))
        start = np.cumsum(count) - count
        layers = 1
        while np.count_nonzero(count > layers) * 8 >= len(count):
            layers += 1
        rest = np.flatnonzero(np.arange(len(value)) - start[value] >= layers)
        after = np.concatenate([after, np.zeros(layers, np.uint64)])
        return _Side(order, np.concatenate([value, np.full(layers, -1)]), start, count, [after[k:] for k in range(layers)], count > layers, rest)

    def lookup(self, rows: np.ndarray, other: _Side, masks: list[int], most: int, whole: bool, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, point of the other side) whose values differ by one of the masks, and by `most` bits at most with those behind; if not whole, the other's rest is left out."""
        aims, firsts, words, counts = (np.empty(block, t) for t in (np.int64, np.int64, np.uint64, np.uint8))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for at in range(0, len(rows), block):
            own = rows[at : at + block]
            value, after = self.value[own], self.after[0][own]
            aim, first, word, bits = (x[: len(own)] for x in (aims, firsts, words, counts))
            for mask in masks:
                left = most - mask.bit_count()
                np.bitwise_xor(value, mask, out=aim)
                other.start.take(aim, out=first, mode="clip")  # other modes than raise need no copy
                for k, x in enumerate(other.after):
                    x.take(first, out=word, mode="clip")
                    np.bitwise_xor(word, after, out=word)
                    np.bitwise_count(word, out=bits)
                    if bits.min() > left:
                        continue
                    near = np.flatnonzero(bits <= left)
                    j = first[near] + k
                    there = other.value[j] == aim[near]
                    found.append((own[near[there]], j[there]))
                    held += len(near)
                hit = np.flatnonzero(other.more.take(aim)) if whole else ()
                if len(hit):
                    for row, j in _runs(first[hit] + len(other.after), other.count[aim[hit]] - len(other.after), 1 << 18):
                        near = np.flatnonzero(np.bitwise_count(other.after[0].take(j) ^ after[hit[row]]) <= left)
                        found.append((own[hit[row[near]]], j[near]))
                        held += len(near)
                        if held > 1 << 18:
                            yield tuple(map(np.concatenate, zip(*found)))
                            found, held = [], 0
                if held > 1 << 16:
                    yield tuple(map(np.concatenate, zip(*found)))
                    found, held = [], 0
        if found:
            yield tuple(map(np.concatenate, zip(*found)))


def _near(q: Points, h: Points | None, radius: int, slack: int, band: int, block: int = 1 << 14) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Index pairs and distances of queries and home points in reach, of which band is the first that finds them.

    Without home points the pairs are those among the queries, each once.
    """
    edges, reach = _bands(radius)
    low, high = edges[band : band + 2]
    alone = h is None
    (qw, qc), (hw, hc) = q, q if alone else h
    if not len(qc) or not len(hc):
        return

    def tested(i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        differ = qw[:, i] ^ hw[:, j]
        d = np.bitwise_count(differ).sum(axis=0, dtype=np.int64)
        at = np.flatnonzero((d <= radius) & (np.abs(qc[i] - hc[j]) <= slack))
        at = at[_finds(differ[:, at], radius, band)]
        for b in range(band):
            at = at[~_finds(differ[:, at], radius, b)]
        if len(at):
            yield i[at], j[at], d[at]

    if len(hc) * len(qc) < 1 << 20:  # less than the lookups take
        for row, j in _runs(np.arange(1, len(qc) + 1) if alone else np.zeros(len(qc), np.int64), len(hc) - np.arange(1, len(qc) + 1) if alone else np.full(len(qc), len(hc)), 1 << 18):
            yield from tested(row, j)
        return
    a = _Side.of(qw, low, high)
    b = a if alone else _Side.of(hw, low, high)
    most = _most(radius, band)
    for top in range(-1, high - low):
        # masks by their highest bit; among the queries themselves it is enough to look from those without it
        masks = [0] if top < 0 else [(1 << top) | sum(1 << x for x in c) for k in range(reach) for c in combinations(range(top), k)]
        rows, rest = np.arange(len(qc)), b.rest
        if alone and top < 0:
            for i, j in _runs(rows + 1, (a.start + a.count)[a.value[rows]] - rows - 1, 1 << 18):
                near = np.bitwise_count(a.after[0].take(i) ^ a.after[0].take(j)) <= most
                yield from tested(a.order[i[near]], a.order[j[near]])
            continue
        if alone:
            rows, rest = rows[(a.value[rows] >> top) & 1 == 0], rest[(a.value[rest] >> top) & 1 == 1]
        for i, j in a.lookup(rows, b, masks, most, False, block):
            yield from tested(a.order[i], b.order[j])
        for j, i in b.lookup(rest, a, masks, most, True, block):
            yield from tested(a.order[i], b.order[j])


def _sharded(distinct: DataFrame, radius: int, slack: int) -> DataFrame:
    """leaf, tile, block, share, home and the point's columns: what each task of the search gets.

    A task holds the home points of a tile against the points of one block of
    visitors (those of another tile, or of other leaves), in its share of the
    bands: with `shares` of them, band b belongs to share b % shares.
    """
    spark = distinct.sparkSession
    n = distinct.count()
    take = distinct.orderBy(F.xxhash64(*KEY), "node").limit(SAMPLE).toArrow() if n else distinct.limit(0).toArrow()
    tree = grow(*_points(take), radius, slack)
    tile_points = TILE_POINTS

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, leaf, own = tree.route(*_points(b), radius, slack)
            yield pa.RecordBatch.from_arrays([pa.array(leaf[own].astype(np.int32))], names=["leaf"])

    counts = {r["leaf"]: r["count"] for r in distinct.mapInArrow(home, "leaf int").groupBy("leaf").count().collect()}
    tiles = np.ones(tree.leaves, np.int64)
    for leaf, size in counts.items():
        tiles[leaf] = -(-size // tile_points)
    tiles_b = spark.sparkContext.broadcast((tree, tiles))
    meetings = int((tiles**2).sum() if tree.leaves > 1 else (tiles * (tiles + 1) // 2).sum())
    shares = max(1, min(len(_bands(radius)[0]) - 1, -(-TASKS_A_CORE * spark.sparkContext.defaultParallelism // meetings)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, tiles = tiles_b.value
        for b in batches:
            words, code = _points(b)
            p, leaf, own = tree.route(words, code, radius, slack)
            at_home = np.zeros(len(code), np.int64)
            at_home[p[own]] = leaf[own]
            keep = leaf >= at_home[p]  # a pair across shards is found in the one with the greater number
            p, leaf, own = p[keep], leaf[keep], own[keep]
            tile = (tc.mix(words[0] ^ tc.mix(words[1])) % tiles[at_home].astype(np.uint64)).astype(np.int64)
            # as a visitor: in its own leaf the tiles after its own, elsewhere all of them
            own_tile = tile[p]
            first = np.where(own, own_tile + 1, 0)
            visit, t = _spread(first, tiles[leaf] - first)
            # at home: against the tiles before, itself, and visitors from other leaves
            lone = np.flatnonzero(own)
            meet, k = _spread(np.zeros(len(lone), np.int64), own_tile[lone] + 1 if tree.leaves == 1 else tiles[leaf[lone]])
            row = np.concatenate([visit, lone[meet]])
            at_tile, block = np.concatenate([t, own_tile[lone[meet]]]), np.concatenate([np.where(own[visit], own_tile[visit], own_tile[visit] % tiles[leaf[visit]]), k])
            home = np.arange(len(row)) >= len(visit)
            for share in range(shares):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaf[row].astype(np.int32)), pa.array(at_tile.astype(np.int32)), pa.array(block.astype(np.int32)), pa.array(np.full(len(row), share, np.int32)), pa.array(np.full(len(row), shares, np.int32)),
                     pa.array(home), *(b.column(b.schema.get_field_index(c)).take(pa.array(p[row])) for c in (*KEY, "node"))],
                    names=["leaf", "tile", "block", "share", "shares", "home", *KEY, "node"],
                )

    sent = distinct.mapInArrow(run, f"leaf int, tile int, block int, share int, shares int, home boolean, {_DDL}, node bigint")
    # a fixed number of partitions: few rows are much work here, and would be put together by their size
    return sent.repartition(min(20_000, 4 * meetings * shares), *TASK)


def _spread(first: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, first + 0, 1, ... many - 1) for each index."""
    row = np.repeat(np.arange(len(many)), many)
    return row, first[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)


def _points(t: pa.RecordBatch | pa.Table) -> Points:
    def get(c: str) -> np.ndarray:
        x = t.column(t.schema.get_field_index(c))
        return (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x).to_numpy(zero_copy_only=False)

    return np.stack([get(c).view(np.uint64) for c in PRINT]), get("code").astype(np.int64)


def _search(distinct: DataFrame, radius: int, slack: int, forest: bool) -> DataFrame:
    """Pairs (a, b, distance) of distinct fingerprints' nodes.  Or, as forest, only edges (a, b) that join the
    same components, and with b null the number of pairs that a node is in (n; to be summed up)."""

    def find(table: pa.Table) -> pa.Table:
        words, code = _points(table)
        own, node = (table[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("home", "node"))
        tile, block, share, shares = (table[c][0].as_py() for c in ("tile", "block", "share", "shares"))
        h, hn = (words[:, own], code[own]), np.flatnonzero(own)
        v, vn = (words[:, ~own], code[~own]), np.flatnonzero(~own)
        a, b, d, held = [], [], [], 0
        degree = np.zeros(len(node), np.int64)
        for band in range(share, len(_bands(radius)[0]) - 1, shares):
            for q, qn, to in ((h, hn, None), (v, vn, h)):
                if to is None and tile != block:  # among themselves once
                    continue
                for i, j, far in _near(q, to, radius, slack, band):
                    a.append(qn[i]), b.append(hn[j])
                    if not forest:
                        d.append(far)
                        continue
                    degree += np.bincount(a[-1], minlength=len(node)) + np.bincount(b[-1], minlength=len(node))
                    held += len(i)
                    if held > 1 << 20:
                        x, y = _forest(np.concatenate(a), np.concatenate(b))
                        a, b, held = [x], [y], len(x)
        a = np.concatenate(a) if a else np.zeros(0, np.int64)
        b = np.concatenate(b) if b else np.zeros(0, np.int64)
        if not forest:
            d = np.concatenate(d) if d else np.zeros(0, np.int64)
            return pa.table({"a": np.minimum(node[a], node[b]), "b": np.maximum(node[a], node[b]), "distance": d.astype(np.int32)})
        a, b = _forest(a, b)
        met = np.flatnonzero(degree)
        empty = pa.nulls(len(met), pa.int64())
        return pa.table({
            "a": pa.array(np.concatenate([node[a], node[met]])), "b": pa.concat_arrays([pa.array(node[b]), empty]),
            "n": pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(degree[met])]),
        })

    schema = "a bigint, b bigint, n bigint" if forest else "a bigint, b bigint, distance int"
    return _sharded(distinct, radius, slack).groupBy(*TASK).applyInArrow(find, schema)


def _distinct(prints: DataFrame) -> DataFrame:
    """The different fingerprints: least doc_id (rep), number of rows, and a number of their own (node)."""
    found = prints.groupBy(*KEY).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    return cut(found.withColumn("node", F.monotonically_increasing_id()))


def pairs(docs: DataFrame, radius: int = RADIUS, slack: int = SLACK) -> DataFrame:
    """All pairs (a, b, distance), a < b, of documents with different fingerprints in reach, and
    (least, other, 0) for each further document of one fingerprint.  See groups() for odd rows."""
    prints = cut(fingerprints(docs).where("doc_id IS NOT NULL"))
    distinct = _distinct(prints)
    same = prints.join(distinct.where("copies > 1"), list(KEY)).where("doc_id <> rep")
    found = _search(distinct, radius, slack, False)
    for c in ("a", "b"):
        found = found.join(distinct.select(F.col("node").alias(c), F.col("rep").alias(f"{c}_rep")), c)
    found = found.where("a_rep <> b_rep").select(F.least("a_rep", "b_rep").alias("a"), F.greatest("a_rep", "b_rep").alias("b"), "distance")
    # of one doc_id with several texts the nearest counts
    found = found.unionByName(same.select(F.col("rep").alias("a"), F.col("doc_id").alias("b"), F.lit(0).alias("distance")))
    return found.groupBy("a", "b").agg(F.min("distance").alias("distance"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b) but the roots; root is a component's least node.

    Alternating large-star and small-star steps; every round is cut, and the
    rounds grow with the logarithm of the longest chain.  Least neighbours are
    aggregated and joined, so the edges of a hub are never in one task alone.
    """
    state, last = cut(edges.select("a", "b").where("a <> b").distinct()), None
    while True:
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = cut(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))  # here a > b always
        small = least.select("a", F.col("m").alias("b")).union(large.join(least, "a").where("b <> m").select("b", "m")).where("a <> b").distinct()
        state = cut(small)
        # an order-free digest of the edges: unchanged means converged
        now = state.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == last:
            return state.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last = now


def _named(distinct: DataFrame, radius: int, slack: int) -> DataFrame:
    """KEY, the group's node and the number of links of every fingerprint that is linked or has several rows."""
    found = cut(_search(distinct, radius, slack, True))
    linked = components(found.where("b IS NOT NULL"))
    roots = linked.unionByName(linked.select(F.col("root").alias("node"), "root").distinct())
    links = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    named = distinct.join(roots, "node", "left").join(links, "node", "left").where("copies > 1 OR root IS NOT NULL")
    return cut(named.select(*KEY, F.coalesce("root", "node").alias("group"), F.coalesce("links", F.lit(0)).alias("links")))


def groups(docs: DataFrame, radius: int = RADIUS, slack: int = SLACK) -> DataFrame:
    """doc_id, group_id, kept and links for every document with a near copy.

    A group is a connected component of the pairs, named by its least doc_id,
    the one kept; links is the number of different fingerprints within the
    radius of the document's own (copies with the same one aren't counted).
    Rows without doc_id or without a word (null, empty, punctuation) belong to
    no group; texts shorter than LEAST_WORDS words group only with equal word
    sequences; rows of one doc_id are one document, and one with texts in two
    groups has a row for each; other columns are ignored.  An empty table has
    no groups.
    """
    prints = cut(fingerprints(docs).where("doc_id IS NOT NULL"))
    named = _named(_distinct(prints), radius, slack)
    found = cut(prints.join(named, list(KEY)).groupBy("doc_id", "group").agg(F.max("links").alias("links")))
    # one doc_id twice with the same text isn't a group
    names = found.groupBy("group").agg(F.min("doc_id").alias("group_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return found.join(names, "group").select("doc_id", "group_id", (F.col("doc_id") == F.col("group_id")).alias("kept"), "links")


def deduplicate(docs: DataFrame, radius: int = RADIUS, slack: int = SLACK) -> DataFrame:
    """docs with one row of each group of near copies, all columns unchanged.

    Here rows are judged one by one: the row with a group's least doc_id stays
    (nulls last; of several texts under it the one with the least hash), and of
    rows that repeat it with the same text any one.  Rows without a word stay.
    """
    prints = cut(fingerprints(docs))
    named = _named(_distinct(prints), radius, slack)
    rows = cut(prints.join(named, list(KEY)).groupBy("group", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")))
    # nulls last: a struct with the null flag first
    order = F.struct(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), F.col("text_hash"))
    stays = rows.groupBy("group").agg(F.min(order).alias("least"))
    judged = rows.join(stays, "group").withColumn("stays", order == F.col("least"))
    key, print_, again = fresh(docs, "gone"), fresh(docs, "gone_text"), fresh(docs, "gone_row")
    gone = cut(judged.where("n > 1 OR NOT stays").select(F.col("doc_id").alias(key), F.col("text_hash").alias(print_), F.col("stays").alias(again)))
    same = F.col("doc_id").eqNullSafe(F.col(key)) & (F.xxhash64("text") == F.col(print_))
    left = docs.join(broadcast_if_small(gone.drop(again), REMOVED_BYTES, 24), same, "left_anti")
    repeated = gone.where(again).drop(again)
    if repeated.isEmpty():
        return left
    one = docs.join(broadcast_if_small(repeated, REMOVED_BYTES, 24), same, "left_semi").withColumn(print_, F.xxhash64("text"))
    return left.unionByName(one.dropDuplicates(["doc_id", print_]).drop(print_))
