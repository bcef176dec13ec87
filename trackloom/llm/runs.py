"""Runs of like consecutive frames, each collapsed into one event.

Method: boundary interval lookup. Within a chunk of entities (one Arrow batch of whole sequences) the positions where a
run starts are gathered into one sorted array; every reading finds its run by binary search in it, and
the runs are aggregated by their number. An entity is one nested row, so nothing is shuffled before
the (few) runs come out, however many rows one video has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.functions.sequences import Flat, flatten, follows

RUNS = "video_id string, obj_id int, start_frame bigint, end_frame bigint, n_frames bigint, visible boolean, duration_s double"


def starts(flat: Flat, tolerance: float) -> np.ndarray:
    """Sorted positions at which a run starts."""
    with np.errstate(invalid="ignore"):
        like = (np.abs(flat.box[1:] - flat.box[:-1]) <= tolerance).all(1) & (flat.visible[1:] == flat.visible[:-1]) & (flat.visible[1:] >= 0)
    same = np.zeros(len(flat.row), bool)
    same[1:] = like
    return np.flatnonzero(~(same & follows(flat)))


def _seconds(batch: pa.RecordBatch, row: np.ndarray, frame: np.ndarray) -> np.ndarray:
    stamps = batch["timestamps"]
    n = stamps.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    value = stamps.values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    ok = (frame >= 0) & (frame < n[row])
    out = np.full(len(row), np.nan)
    out[ok] = value[stamps.offsets.to_numpy()[row[ok]] + frame[ok]]
    return out


def _collapse(tolerance: float):
    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = flatten(batch["frames"], batch["bboxes"], batch["visible"])
            first = starts(flat, tolerance)
            run = np.searchsorted(first, np.arange(len(flat.row)), side="right") - 1
            n = np.bincount(run, minlength=len(first)) if len(first) else np.zeros(0, int)
            end = first + n - 1
            row = flat.row[first]
            seconds = _seconds(batch, row, flat.frame[end]) - _seconds(batch, row, flat.frame[first])
            rows = pa.array(row)
            visible = flat.visible[first]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["video_id"].take(rows),
                    batch["obj_id"].take(rows).cast(pa.int32()),
                    pa.array(flat.frame[first], pa.int64()),
                    pa.array(flat.frame[end], pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array(visible == 1, pa.bool_(), mask=visible < 0),
                    pa.array(seconds, pa.float64(), mask=np.isnan(seconds)),
                ],
                names=["video_id", "obj_id", "start_frame", "end_frame", "n_frames", "visible", "duration_s"],
            )

    return collapse


def collapse_runs(tracks: DataFrame, tolerance: float = 2) -> DataFrame:
    """video_id, obj_id, start_frame, end_frame, n_frames, visible, duration_s: one row a run, single frames included.

    A frame continues a run if it is the frame right after, `visible` is the same and each box coordinate differs by
    at most tolerance. Null visibility and null or malformed boxes continue nothing. Frames may be in any order;
    of a repeated frame number the first counts. duration_s is the time from the first to the last frame, null where
    timestamps lack. Copies of a document give the same runs, which come out once; documents without objects none.
    """
    seq = tracks.select("video_id", "timestamps", F.explode("objects").alias("o")).select("video_id", "timestamps", "o.obj_id", "o.frames", "o.bboxes", "o.visible")
    return seq.mapInArrow(_collapse(tolerance), RUNS).distinct()
