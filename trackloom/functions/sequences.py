"""Nested track arrays of an Arrow batch as flat numpy vectors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


@dataclass
class Flat:
    """One element per kept reading, ordered by (row of the batch, frame)."""

    row: np.ndarray
    frame: np.ndarray
    visible: np.ndarray  # 0 hidden, 1 visible, -1 unknown
    box: np.ndarray  # n x 4, NaN where the box is missing or malformed


def _spans(arr: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of every list; a null list has length 0."""
    return arr.offsets.to_numpy()[:-1].astype(np.int64), pc.fill_null(pc.list_value_length(arr), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[i] .. start[i] + n[i] - 1 for every i, one after the other."""
    first = np.cumsum(n) - n
    return np.arange(int(n.sum())) - np.repeat(first - start, n)


def _numbers(arr: pa.Array, null: float = np.nan) -> np.ndarray:
    return pc.fill_null(arr.cast(pa.float64()), null).to_numpy(zero_copy_only=False)


def flatten(frames: pa.ListArray, bboxes: pa.ListArray, visible: pa.ListArray) -> Flat:
    """The arrays are parallel; positions beyond the shortest array, null frames and repeats of a frame are dropped."""
    (f0, fn), (b0, bn), (v0, vn) = _spans(frames), _spans(bboxes), _spans(visible)
    n = np.minimum(np.minimum(fn, bn), vn)
    row = np.repeat(np.arange(len(n)), n)
    frame = _numbers(frames.values)[_ranges(f0, n)]
    vis = pc.fill_null(visible.values.cast(pa.int8()), -1).to_numpy(zero_copy_only=False)[_ranges(v0, n)]
    x0, xn = _spans(bboxes.values)
    coord = _numbers(bboxes.values.values)
    at = _ranges(b0, n)
    box = np.full((len(at), 4), np.nan)
    ok = xn[at] == 4
    box[ok] = coord[x0[at][ok][:, None] + np.arange(4)] if ok.any() else box[ok]
    keep = ~np.isnan(frame)
    row, frame, vis, box = row[keep], frame[keep].astype(np.int64), vis[keep], box[keep]
    order = np.lexsort((np.arange(len(row)), frame, row))
    row, frame, vis, box = row[order], frame[order], vis[order], box[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (frame[1:] != frame[:-1])
    return Flat(row[first], frame[first], vis[first], box[first])


def follows(flat: Flat) -> np.ndarray:
    """True where a reading is of the frame right after the reading before, in the same row."""
    out = np.zeros(len(flat.row), bool)
    out[1:] = (flat.row[1:] == flat.row[:-1]) & (flat.frame[1:] == flat.frame[:-1] + 1)
    return out
