"""Whole images inside tasks, for operators whose pixels need the pixels around them.

Rows are shuffled once, by frame, and arrive sorted by it; many small images are laid out on one canvas, and a square around
a pixel is a difference of running totals, whatever its radius. A task holds one image, or some small ones, at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

FRAME = ["sequence_id", "frame_index"]
#: Cells of a canvas that several images share; one image may be larger.
CELLS = 1 << 22


def by_frame(rows: DataFrame) -> DataFrame:
    return rows.repartition(*FRAME).sortWithinPartitions(*FRAME)


def _starts(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
    change = np.zeros(rows.num_rows, bool)
    for name in FRAME:
        column = rows.column(name)
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        change[1:] |= codes[1:] != codes[:-1]
    change[:1] = True
    return np.flatnonzero(change)


def whole_frames(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, start of each frame) of one or more whole frames, from batches sorted by frame; a frame may span batches."""
    waiting, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = _starts(batch)
        first, last = (tuple(batch.column(c)[int(k)].as_py() for c in FRAME) for k in (0, starts[-1]))
        if first == last == key:
            waiting.append(batch)
            continue
        done = waiting + [batch.slice(0, starts[-1])] if starts[-1] else waiting
        if done:
            table = pa.Table.from_batches(done)
            yield table, _starts(table)
        waiting, key = [batch.slice(starts[-1])], last
    if waiting:
        table = pa.Table.from_batches(waiting)
        yield table, _starts(table)


def numbers(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(values with 0 for null, which aren't null)."""
    column = table.column(name)
    known = pc.is_valid(column).to_numpy()
    return (pc.fill_null(column, 0) if column.null_count else column).to_numpy(), known


def stacks(u: np.ndarray, v: np.ndarray, frame: np.ndarray, margin: int) -> Iterator[tuple[np.ndarray, np.ndarray, tuple[int, int]]]:
    """(rows, their flat places, shape) of canvases that hold images under one another, with ``margin`` empty places around each."""
    if not len(frame):
        return
    _, frame = np.unique(frame, return_inverse=True)
    box = []
    for at in (u.astype(np.int64), v.astype(np.int64)):
        low, high = np.full(frame.max() + 1, np.iinfo(np.int64).max), np.full(frame.max() + 1, np.iinfo(np.int64).min)
        np.minimum.at(low, frame, at)
        np.maximum.at(high, frame, at)
        box.append((at - low[frame] + margin, high - low + 1))
    (across, wide), (down, high) = box
    width, high = int(wide.max()) + 2 * margin, high + margin
    part = np.cumsum(high * width) // CELLS
    for p in np.unique(part):
        mine = part == p
        top = np.zeros(len(part), np.int64)
        top[mine] = np.cumsum(high[mine]) - high[mine]
        rows = np.flatnonzero(mine[frame])
        yield rows, (down[rows] + top[frame[rows]]) * width + across[rows], (int(high[mine].sum()) + margin, width)


def around(counts: np.ndarray, radius: int) -> np.ndarray:
    """Sums over the square of ``radius`` around each place; outside the canvas is 0."""
    for axis in (0, 1):
        pad = [(radius + 1, radius) if a == axis else (0, 0) for a in (0, 1)]
        total = np.moveaxis(np.cumsum(np.pad(counts, pad), axis), axis, 0)
        counts = np.moveaxis(total[2 * radius + 1 :] - total[: -2 * radius - 1], 0, axis)
    return counts


def _near(flags: np.ndarray, u: np.ndarray, v: np.ndarray, frame: np.ndarray, radius: int) -> np.ndarray:
    out = np.zeros(len(flags), bool)
    for rows, flat, shape in stacks(u, v, frame, radius):
        marked = np.bincount(flat[flags[rows]], minlength=shape[0] * shape[1]).reshape(shape)
        out[rows] = around(marked, radius).ravel()[flat] > 0
    return out


def near_valid(depth: np.ndarray, u: np.ndarray, v: np.ndarray, frame: np.ndarray, radius: int) -> np.ndarray:
    """Whether a pixel of the same image in the square around has depth."""
    return _near(depth > 0, u, v, frame, radius)


def eroded(depth: np.ndarray, u: np.ndarray, v: np.ndarray, frame: np.ndarray, radius: int) -> np.ndarray:
    return np.where(_near(depth <= 0, u, v, frame, radius), 0, depth)


def filled(depth: np.ndarray, u: np.ndarray, v: np.ndarray, frame: np.ndarray, radius: int) -> np.ndarray:
    """Depth with holes filled by the mean of depths within the circle, weighted by one over the distance, truncated."""
    out, steps = depth.copy(), range(-radius, radius + 1)
    near = near_valid(depth, u, v, frame, radius)
    for rows, flat, (high, width) in stacks(u, v, frame, radius):
        good = depth[rows] > 0
        count = np.bincount(flat[good], minlength=high * width)
        total = np.bincount(flat[good], depth[rows][good], minlength=high * width)
        holes = np.flatnonzero((depth[rows] == 0) & near[rows])
        at, weight, value = flat[holes], np.zeros(len(holes)), np.zeros(len(holes))
        for i in steps:
            for j in steps:
                if 0 < i * i + j * j <= radius * radius:
                    w, there = 1 / np.sqrt(i * i + j * j), at + j * width + i
                    weight += w * count[there]
                    value += w * total[there]
        some = weight > 0
        out[rows[holes[some]]] = np.floor(np.round(value[some] / weight[some], 6))
    return out
