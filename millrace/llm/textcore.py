"""Vectorised text primitives shared by the operators of this subpackage.

A *word* is a maximal run of ASCII letters and digits or other non-ASCII
characters after lower-casing; Unicode punctuation and spaces in U+0080-00BF,
U+2000-207F, U+3000-303F and the full-width forms separate words as ASCII
punctuation does.  Scripts written without spaces have a word for each character:
kana and Han ideographs (U+3040-9FFF, U+F900-FAFF, U+20000-33FFF).  Words
are represented by 64-bit hashes, so every later step is numpy arithmetic on
whole Arrow batches instead of per-row Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: The characters that are words of their own, and those that make words in runs, as classes of a regular expression (after lower-casing).
SINGLE = r"\x{3040}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{33FFF}"
JOINED = (
    r"a-z0-9\x{00C0}-\x{1FFF}\x{2080}-\x{2FFF}\x{A000}-\x{F8FF}\x{FB00}-\x{FEFF}\x{FF10}-\x{FF19}\x{FF21}-\x{FF3A}\x{FF41}-\x{FF5A}"
    r"\x{FF66}-\x{1FFFF}\x{34000}-\x{10FFFF}"
)
WORD = f"[{SINGLE}]|[{JOINED}]+"

#: Bytes of text handled by one vectorised step; bounds the Python workers' memory.
STEP_BYTES = 2 << 20

_WORD = np.zeros(256, dtype=bool)
_WORD[ord("a") : ord("z") + 1] = True
_WORD[ord("A") : ord("Z") + 1] = True
_WORD[ord("0") : ord("9") + 1] = True
_WORD[128:] = True

#: Which of U+FF00 to U+FF7F belong to words.
_WIDE = np.array([0x10 <= c <= 0x19 or 0x21 <= c <= 0x3A or 0x41 <= c <= 0x5A or c >= 0x66 for c in range(128)])

_M1 = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xBF58476D1CE4E5B9)
_M3 = np.uint64(0x94D049BB133111EB)
_ROLL = np.uint64(0xD6E8FEB86659FD93)
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every output bit depends on every input bit."""
    x = x + _M1
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """The words of some rows, in order: hash, row number, first and last byte + 1."""

    hash: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    rows: int

    def bounds(self) -> np.ndarray:
        """Index of each row's first word, with the total at the end."""
        return np.searchsorted(self.row, np.arange(self.rows + 1))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def lowered(column: pa.Array) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))


def words(column: pa.Array) -> Words:
    """Tokenise a string column (see the module's definition of a word)."""
    data, offsets = raw(lowered(column))
    n, rows = len(data), len(offsets) - 1
    if n == 0:
        z = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), z, z, z, rows)
    inside = _WORD[data]
    for lead, second in ((0xC2, None), (0xE2, (0x80, 0x81)), (0xE3, (0x80,))):
        at = np.flatnonzero(data[:-1] == lead)
        if second is not None:
            at = at[np.isin(data[at + 1], second)]
        for k in range(2 if second is None else 3):
            inside[at + k] = False
    single = np.zeros(0, np.int64)
    if data.max() >= 0xE3:
        two = np.append(data[1:], 0).astype(np.uint16) | (data.astype(np.uint16) << 8)  # a lead byte and the next
        wide = np.flatnonzero((two == 0xEFBC) | (two == 0xEFBD))
        point = (two[wide] & 1).astype(np.int64) * 64 + data[np.minimum(wide + 2, n - 1)] - 0x80  # from U+FF00
        mark = wide[~_WIDE[np.clip(point, 0, 127)]]
        for k in range(3):
            inside[mark + k] = False
        single = np.flatnonzero(((two >= 0xE381) & (two < 0xEA00)) | ((two >= 0xEFA4) & (two < 0xEFAC)) | ((two >= 0xF0A0) & (two < 0xF0B4)))
    begins, ends = inside.copy(), np.zeros(n, dtype=bool)
    begins[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < n]
    begins[heads] |= inside[heads]
    ends[:-1] = inside[:-1] & ~inside[1:]
    ends[-1] = inside[-1]
    cuts = offsets[1:][offsets[1:] > 0] - 1
    ends[cuts] |= inside[cuts]
    if len(single):
        after = single + np.where(data[single] >= 0xF0, 4, 3)
        begins[single] = ends[after - 1] = True
        ends[single[single > 0] - 1] |= inside[single[single > 0] - 1]
        begins[after[after < n]] |= inside[after[after < n]]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    counts = np.diff(np.searchsorted(start, offsets))
    return Words(hash_spans(data, start, end), np.repeat(np.arange(rows), counts), start, end, rows)


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    length = end - start
    h = length.astype(np.uint64) * _M3
    live = np.arange(len(start))
    for block in range(8):
        if block:
            live = live[length[live] > 8 * block]
        if not len(live):
            break
        whole = len(live) == len(start)
        left = np.minimum(length if whole else length[live], 8 * block + 8) - 8 * block
        keep = TOP >> ((8 - left).astype(np.uint64) * np.uint64(8))
        value = eight[(start if whole else start[live]) + 8 * block] & keep
        if whole:
            h = (h ^ value) * _ROLL
            h ^= h >> np.uint64(32)
        else:
            x = (h[live] ^ value) * _ROLL
            h[live] = x ^ (x >> np.uint64(32))
    for i in np.flatnonzero(length > 64):
        h[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes())
    return mix(h)


def grams(h: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position; TOP where a row ends before."""
    n = len(h)
    out = np.full(n, TOP, dtype=np.uint64)
    if n < k:
        return out
    m = n - k + 1
    x = h[:m].copy()
    for j in range(1, k):
        x *= _ROLL
        x += h[j : j + m]
    x = mix(x)
    x[x == TOP] = 0
    x[row[:m] != row[k - 1 :]] = TOP
    out[:m] = x
    return out


def _slide(x: np.ndarray, w: int, pick: Callable) -> np.ndarray:
    """pick (minimum or maximum) over x[i : i + w]; len(x) - w + 1 results."""
    done = 1
    while done * 2 <= w:
        x = pick(x[:-done], x[done:])
        done *= 2
    return pick(x[: len(x) - (w - done)], x[w - done :]) if done < w else x


def window_minima(g: np.ndarray, row: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """The least gram hash of each window of w grams, and which windows lie within one row."""
    if len(g) < w + k - 1:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    m = _slide(g, w, np.minimum)[: len(g) - (w + k - 1) + 1]
    return m, row[: len(m)] == row[w + k - 2 : w + k - 2 + len(m)]


def winnow(g: np.ndarray, row: np.ndarray, k: int, w: int) -> np.ndarray:
    """Positions that are the least of some window of w grams (equal ones all count)."""
    m, whole = window_minima(g, row, k, w)
    if not len(m):
        return np.zeros(0, np.int64)
    pad = np.zeros(w - 1, np.uint64)
    best = _slide(np.concatenate([pad, np.where(whole, m, np.uint64(0)), pad]), w, np.maximum)
    at = np.flatnonzero(best == g[: len(best)])
    return at[g[at] != TOP]


def steps(batch: pa.RecordBatch, column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most limit bytes of text each (one row at least)."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    total = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    at = 0
    while at < batch.num_rows:
        upto = int(np.searchsorted(total, total[at] + limit, side="right")) - 1
        upto = min(max(upto, at + 1), batch.num_rows)
        yield batch.slice(at, upto - at)
        at = upto


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def lists(flat: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column of flat values cut at bounds."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat, type=kind))


class Sieve:
    """A fixed-size Bloom filter (two probes) over 64-bit hashes.

    Its size depends on the number of hashes but never exceeds max_bits, so it
    can always be broadcast; when full it merely lets more rows through to the
    exact join that follows.
    """

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(len(bits) * 8 - 1)

    @staticmethod
    def size(n: int, max_bits: int = 1 << 28) -> int:
        return min(max_bits, 1 << max(16, int(max(n, 1) * 24).bit_length()))

    @staticmethod
    def slots(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64(bits - 1)
        return h & mask, (mix(h) >> np.uint64(20)) & mask

    def __contains__(self, h: int) -> bool:
        return bool(self.has(np.array([h], np.uint64))[0])

    def has(self, h: np.ndarray) -> np.ndarray:
        a, b = self.slots(h, len(self.bits) * 8)
        hit = (self.bits[a >> np.uint64(3)] >> (a & np.uint64(7)).astype(np.uint8)) & 1
        out = hit.astype(bool)
        at = np.flatnonzero(out)
        b = b[at]
        out[at] = ((self.bits[b >> np.uint64(3)] >> (b & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
        return out
