"""Audio features of media columns (operator 7).

A clip is a binary column of little-endian 16-bit mono samples and its rate.
It is resampled by a polyphase filter, cut into overlapping frames, and turned
into log-mel energies; frames are grouped into segments by hysteresis: a run
above the low level counts if it reaches the high one.  Each segment gives
tensors of one fixed shape (FRAMES, MELS) with their time spans, the last one
padded with the floor.  Spark holds a tensor as array<float>; tensors() and
write_tensors() give Arrow's fixed_shape_tensor extension type.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import file_system, local_path
from .common import ready
from .textcore import steps

SCHEMA = "id bigint, segment int, part int, start_s double, end_s double, frames int, features array<float>"
FLOOR = math.log(1e-10)
#: Samples of a period that are still worth a matrix, cells of its rows and of branches held at a time, and bytes of clips done together.
STEP = 1024
CELLS = 1 << 20
KERNEL_CELLS = 1 << 22
BATCH_BYTES = 4 << 20


@dataclass(frozen=True)
class Settings:
    rate: int = 8000
    window: int = 200
    hop: int = 80
    size: int = 256
    mels: int = 40
    low_hz: float = 60.0
    frames: int = 32
    high_db: float = -26.0
    low_db: float = -38.0
    least: int = 3
    gap: int = 2
    half_taps: int = 16


def kernel(up: int, down: int, half_taps: int) -> np.ndarray:
    """The polyphase branches, (up, taps), of a Hann-windowed sinc that cuts at the lower of both half rates."""
    cut = 1 / max(up, down)
    half = int(half_taps * max(1.0, down / up))
    t = np.arange(-half * up, half * up + up)
    h = np.sinc(t * cut) * cut * up
    h *= np.where(np.abs(t) <= half * up, 0.5 + 0.5 * np.cos(np.pi * t / (half * up)), 0.0)
    return h.reshape(2 * half + 1, up).T.copy()


def _direct(x: np.ndarray, up: int, down: int, n: int, half_taps: int) -> np.ndarray:
    """Each output on its own, for rates whose branches would be too many to hold; 2 * half_taps products for each sample of x."""
    cut, half = min(1.0, up / down), int(half_taps * max(1.0, down / up))
    out = np.empty(n)
    for m in range(n):
        centre = m * down / up
        low, high = max(0, math.ceil(centre - half)), min(len(x), math.floor(centre + half) + 1)
        t = centre - np.arange(low, high)
        out[m] = (x[low:high] * np.sinc(t * cut) * cut * (0.5 + 0.5 * np.cos(np.pi * t / half))).sum()
    return out


def resample_all(clips: list[np.ndarray], source: int, target: int, half_taps: int = 16, block: int = 1 << 15) -> list[np.ndarray]:
    """Clips of one rate at another: ceil(len * target / source) samples each; outside of a clip is silence.

    The branches repeat every `up` outputs, for which the input moves on by
    `down` samples: so many outputs of one such period are one row of a matrix
    product, over all clips together.
    """
    g = math.gcd(source, target)
    up, down = target // g, source // g
    sizes = [-(-len(x) * up // down) for x in clips]
    if up == down:
        return [x.astype(np.float64) for x in clips]
    if 2 * half_taps * down > KERNEL_CELLS:
        return [_direct(x, up, down, n, half_taps) for x, n in zip(clips, sizes)]
    h = kernel(up, down, half_taps)
    taps = h.shape[1]
    half = (taps - 1) // 2
    # outputs of a step: whole periods while these are short, else a part of one
    step = max(1, min(STEP // up, STEP // down)) * up if up <= STEP and down <= STEP else up
    if down > STEP or up > STEP:
        return [_by_phase(x, h, up, down, n, block) for x, n in zip(clips, sizes)]
    move = step // up * down
    m = np.arange(step)
    phase, base = m * down % up, m * down // up
    # output m lies at base + phase / up; tap k of its branch is for the sample half - k after base
    matrix = np.zeros((move + taps, step))
    for k in range(taps):
        matrix[base + taps - 1 - k, m] = h[phase, k]
    rows, counts = [], []
    for x, n in zip(clips, sizes):
        count = -(-n // step)
        padded = np.zeros(max(0, count - 1) * move + move + taps)
        take = min(len(x), len(padded) - half)
        padded[half : half + take] = x[:take]
        rows.append(np.lib.stride_tricks.sliding_window_view(padded, move + taps)[::move][:count])
        counts.append(count)
    out = [[] for _ in clips]
    at = 0
    while at < len(clips):  # some clips at a time, so that their rows stay small
        upto, cells = at, 0
        while upto < len(clips) and (upto == at or cells + counts[upto] * (move + taps) <= CELLS):
            cells += counts[upto] * (move + taps)
            upto += 1
        if upto == at + 1:  # a long clip, by itself in parts
            parts = max(1, CELLS // (move + taps))
            out[at] = np.concatenate([rows[at][i : i + parts] @ matrix for i in range(0, counts[at], parts)] or [np.zeros((0, step))]).ravel()[: sizes[at]]
        else:
            made = np.concatenate(rows[at:upto]) @ matrix
            ends = np.cumsum(counts[at:upto])
            for c, e in zip(range(at, upto), ends):
                out[c] = made[e - counts[c] : e].ravel()[: sizes[c]]
        at = upto
    return out


def _by_phase(x: np.ndarray, h: np.ndarray, up: int, down: int, n: int, block: int) -> np.ndarray:
    """The branch of every output by itself, for rates with long periods."""
    half = (h.shape[1] - 1) // 2
    padded = np.concatenate([np.zeros(half + 1), x, np.zeros(half + 1)])
    out = np.empty(n)
    back = np.arange(h.shape[1])
    block = max(1, min(block, CELLS // h.shape[1]))
    for at in range(0, n, block):
        m = np.arange(at, min(n, at + block))
        phase, base = m * down % up, m * down // up
        out[m] = np.einsum("ij,ij->i", padded[base[:, None] + (half - back) + half + 1], h[phase])
    return out


def resample(x: np.ndarray, source: int, target: int, half_taps: int = 16, block: int = 1 << 15) -> np.ndarray:
    """One clip; see resample_all."""
    return resample_all([x], source, target, half_taps, block)[0]


def filterbank(s: Settings) -> np.ndarray:
    """(mels, size / 2 + 1) triangles, evenly spaced on the mel scale."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    points = 700 * (10 ** (np.linspace(mel(s.low_hz), mel(s.rate / 2), s.mels + 2) / 2595) - 1)
    f = np.arange(s.size // 2 + 1) * s.rate / s.size
    a, b, c = points[:-2, None], points[1:-1, None], points[2:, None]
    return np.maximum(0, np.minimum((f - a) / (b - a), (c - f) / (c - b)))


def log_mel(y: np.ndarray, s: Settings, bank: np.ndarray, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """(frames, mels) log energies and each frame's level in dB of full scale; a short clip is padded to one frame."""
    energy, level, _ = log_mel_all([y], s, bank, block)
    return energy, level


def log_mel_all(clips: list[np.ndarray], s: Settings, bank: np.ndarray, block: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log_mel() of several clips, one after the other, and the number of frames of each."""
    views = []
    for y in clips:
        if len(y) < s.window:
            y = np.concatenate([y, np.zeros(s.window - len(y))])
        views.append(np.lib.stride_tricks.sliding_window_view(y, s.window)[:: s.hop])
    counts = np.array([len(v) for v in views], np.int64)
    hann = np.hanning(s.window + 1)[:-1]
    energy, level = np.empty((counts.sum(), s.mels)), np.empty(counts.sum())
    done, at, start = 0, 0, 0  # frames done, clip, frame of the clip
    while at < len(views):
        parts, room = [], block
        while at < len(views) and room:
            part = views[at][start : start + room]
            parts.append(part)
            room -= len(part)
            start += len(part)
            if start == len(views[at]):
                at, start = at + 1, 0
        v = np.concatenate(parts)
        spectrum = np.fft.rfft(v * hann, s.size, axis=1)
        power = (spectrum.real**2 + spectrum.imag**2) / s.size
        energy[done : done + len(v)] = np.log(np.maximum(power @ bank.T, 1e-10))
        level[done : done + len(v)] = 10 * np.log10(np.maximum(np.einsum("ij,ij->i", v, v) / s.window, 1e-10))
        done += len(v)
    return energy, level, counts


def segments(level: np.ndarray, s: Settings) -> list[tuple]:
    """Frames [from, to): runs at low_db or more, joined over gaps of at most `gap`, of at least `least` frames, that reach high_db."""
    on = np.concatenate([[False], level >= s.low_db, [False]])
    start, end = np.flatnonzero(~on[:-1] & on[1:]), np.flatnonzero(on[:-1] & ~on[1:])
    joined: list[list[int]] = []
    for a, b in zip(start.tolist(), end.tolist()):
        if joined and a - joined[-1][1] <= s.gap:
            joined[-1][1] = b
        else:
            joined.append([a, b])
    return [(a, b) for a, b in joined if b - a >= s.least and level[a:b].max() >= s.high_db]


def clip_features(clips: list[bytes], rate: int, s: Settings, bank: np.ndarray) -> tuple[list[tuple], list[np.ndarray]]:
    """(clip, segment, part, start_s, end_s, frames) of each tensor of clips of one rate, and the tensors, flat."""
    samples = [np.frombuffer(pcm, "<i2", count=len(pcm) // 2) / 32768.0 for pcm in clips]
    some = [i for i, x in enumerate(samples) if len(x)]
    energy, level, counts = log_mel_all(resample_all([samples[i] for i in some], rate, s.rate, s.half_taps), s, bank)
    rows, tensors_, first = [], [], 0
    for clip, count in zip(some, counts.tolist()):
        e, lv = energy[first : first + count], level[first : first + count]
        first += count
        for i, (a, b) in enumerate(segments(lv, s)):
            for k, at in enumerate(range(a, b, s.frames)):
                upto = min(b, at + s.frames)
                tensor = np.full((s.frames, s.mels), FLOOR, np.float32)
                tensor[: upto - at] = e[at:upto]
                rows.append((clip, i, k, at * s.hop / s.rate, ((upto - 1) * s.hop + s.window) / s.rate, upto - at))
                tensors_.append(tensor.ravel())
    return rows, tensors_


def features(clips: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per tensor of the clips (id, audio, rate): see the module, and SCHEMA for the columns.

    Times are in seconds from the clip's start; frames counts a tensor's rows
    that aren't padding.  Null, empty or silent audio and a null or
    non-positive rate give no rows; an odd last byte is ignored; a null id is
    carried, repeated rows are done each time, other columns are ignored, and
    an empty table gives an empty result.  Clips of one rate are worked off
    together, long ones in blocks; any positive rate that an int holds is done.
    """
    ready(clips)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bank = filterbank(settings)
        for b in batches:
            for part in steps(b, "audio", BATCH_BYTES):
                ids, audio, rates = (part.column(j).to_pylist() for j in range(3))
                known: dict[int, list[int]] = {}
                for i, (pcm, rate) in enumerate(zip(audio, rates)):
                    if pcm and rate and rate > 0:
                        known.setdefault(rate, []).append(i)
                for rate, which in known.items():  # clips of one rate are done together
                    rows, tensors_ = clip_features([audio[i] for i in which], rate, settings, bank)
                    if rows:
                        clip, *cols = zip(*rows)
                        size = settings.frames * settings.mels
                        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * size), pa.array(np.concatenate(tensors_), type=pa.float32()))
                        kinds = (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int32())
                        own = pa.array([ids[which[c]] for c in clip], type=pa.int64())
                        yield pa.RecordBatch.from_arrays([own, *(pa.array(c, type=k) for c, k in zip(cols, kinds)), flat], names=["id", "segment", "part", "start_s", "end_s", "frames", "features"])

    return clips.selectExpr("cast(id as bigint) AS id", "cast(audio as binary) AS audio", "cast(rate as int) AS rate").mapInArrow(run, SCHEMA)


def tensors(table: pa.Table | pa.RecordBatch, settings: Settings = Settings()) -> pa.Table:
    """A result (or part of one) with its features as Arrow fixed_shape_tensor of (frames, mels)."""
    table = pa.table(table) if isinstance(table, pa.RecordBatch) else table
    kind = pa.fixed_shape_tensor(pa.float32(), (settings.frames, settings.mels), dim_names=("frame", "mel"))
    column = table["features"].combine_chunks()
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = pa.FixedSizeListArray.from_arrays(column.flatten().cast(pa.float32()), settings.frames * settings.mels)
    return table.set_column(table.schema.get_field_index("features"), "features", pa.ExtensionArray.from_storage(kind, flat))


def write_tensors(df: DataFrame, folder: str, settings: Settings = Settings()) -> DataFrame:
    """Writes a result as Arrow files with tensor columns to a folder all executors share; returns (file, rows).

    folder is a path or a URI that Arrow or Hadoop knows.  Every task writes one
    file under its partition's number and moves it when it is whole, so a task
    that is tried again leaves no half file.
    """
    fs, p = file_system(df.sparkSession, folder)
    fs.mkdirs(p)
    own = local_path(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as afs
        from pyspark import TaskContext

        context = TaskContext.get()
        to, base = (afs.LocalFileSystem(), own) if own else afs.FileSystem.from_uri(folder)
        name = f"{base.rstrip('/')}/part-{context.partitionId():05d}.arrow"
        draft, out, writer, rows = f"{name}.{context.taskAttemptId()}", None, None, 0
        for b in batches:
            if not b.num_rows:
                continue
            t = tensors(b, settings)
            if writer is None:
                out = to.open_output_stream(draft)
                writer = pa.ipc.new_file(out, t.schema)
            writer.write_table(t)
            rows += t.num_rows
        if writer:
            writer.close()
            out.close()
            to.move(draft, name)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([rows], pa.int64())], names=["file", "rows"])

    return df.sparkSession.createDataFrame(df.mapInArrow(run, "file string, rows bigint").collect(), "file string, rows bigint")


SONIFIED_RATE = 11025
_NOTE = 220


def sonify(embeddings: DataFrame) -> DataFrame:
    """id, audio and rate: embeddings made audible, as the test tables hold no recordings.

    Dimension i sounds for 20 ms at 200 + 40 i Hz as loud as its share of the
    largest; a null, empty or all-zero vector is silence, null values are 0.
    """
    ready(embeddings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = np.arange(_NOTE) / SONIFIED_RATE
        notes = np.zeros((0, _NOTE))
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                vectors = part.column(1)
                lengths = np.array([len(v) if v is not None else 0 for v in vectors.to_pylist()])
                flat = np.nan_to_num(np.abs(vectors.flatten().to_numpy(zero_copy_only=False).astype(float)), posinf=np.finfo(float).max)
                if lengths.max(initial=0) > len(notes):
                    notes = 20000 * np.sin(2 * np.pi * (200 + 40 * np.arange(lengths.max()) % 4000)[:, None] * t)
                out, first = [], 0
                for n in lengths.tolist():
                    v = flat[first : first + n]
                    first += n
                    top = v.max(initial=0.0)
                    out.append(np.rint((v / top if top > 0 else v)[:, None] ** 2 * notes[:n]).astype("<i2").tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary()), pa.array([SONIFIED_RATE] * len(out), pa.int32())], names=["id", "audio", "rate"])

    return embeddings.selectExpr("cast(vec_id as bigint) AS vec_id", "cast(embedding as array<double>) AS embedding").mapInArrow(run, "id bigint, audio binary, rate int")
