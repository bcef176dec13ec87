"""Choosing videos and repairing tracks: the operators that are sequential by nature."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Videos that the greedy choice takes into the driver at once (flags and classes only). Larger pools are cut to those that can still be chosen.
MOST_POOL = 2_000_000
# fixed values: seconds and number of objects of the classes with their wanted shares; scales of the score
DURATIONS = [("short", 15, 0.15), ("medium", 40, 0.55), ("long", None, 0.30)]
DENSITIES = [("sparse", 5, 0.10), ("moderate", 9, 0.45), ("dense", None, 0.45)]
SLOT_SCALE, DURATION_SCALE, DENSITY_SCALE, SOURCE_PENALTY, MOST_OF_A_SOURCE = 10.0, 2.0, 1.5, -3.0, 0.45


def greedy_cover(pool: pd.DataFrame, slots: dict[str, tuple[int, float]], total: int) -> list[str]:
    """Greedy weighted cover: each round takes the video with the highest score, until the slots are full and no score is positive; then the best by quality.

    The score is the weighted shortfall of the video's open slots, plus what its duration and density class lack of their shares, less a
    penalty if its source has too large a share. pool: video_id, score (quality), one 0/1 column a slot, and, where known, duration, n_objects
    and source; slots: wanted number and weight. Ties go to the first in the order of pool.
    """
    flags = pool[list(slots)].to_numpy(float)
    want, weight = (np.array(x, float) for x in zip(*slots.values())) if slots else (np.zeros(0), np.zeros(0))
    n = len(pool)

    def classes(column: str, table: list[tuple[str, float | None, float]]) -> tuple[np.ndarray, np.ndarray]:
        if column not in pool:
            return np.zeros(n, int), np.ones(1)
        return np.searchsorted([x[1] for x in table[:-1]], pool[column].to_numpy(float), "right"), np.array([x[2] for x in table])

    (duration, long), (density, dense) = classes("duration", DURATIONS), classes("n_objects", DENSITIES)
    source = pd.factorize(pool["source"], use_na_sentinel=False)[0] if "source" in pool else None
    have, free, chosen = np.zeros(len(slots)), np.ones(n, bool), []
    counts = [np.zeros(len(long)), np.zeros(len(dense)), np.zeros(0 if source is None else source.max(initial=-1) + 1)]
    while len(chosen) < min(total, n):
        gain = flags @ (np.maximum(want - have, 0) / np.maximum(want, 1) * weight * SLOT_SCALE)
        if chosen:
            k = len(chosen)
            if "duration" in pool:
                gain = gain + ((long - counts[0] / k) * DURATION_SCALE)[duration]
            if "n_objects" in pool:
                gain = gain + ((dense - counts[1] / k) * DENSITY_SCALE)[density]
            if source is not None:
                gain = gain + np.where(counts[2] / k > MOST_OF_A_SOURCE, SOURCE_PENALTY, 0)[source]
        gain[~free] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] <= 0 and (have >= want).all():
            break
        chosen.append(best)
        free[best] = False
        have += flags[best]
        counts[0][duration[best]] += 1
        counts[1][density[best]] += 1
        if source is not None:
            counts[2][source[best]] += 1
    rest = np.flatnonzero(free)
    rest = rest[np.argsort(-pool["score"].to_numpy(float)[rest], kind="stable")]
    chosen += rest[: max(0, total - len(chosen))].tolist()
    return pool["video_id"].iloc[chosen].tolist()


def select_videos(profiles: DataFrame, slots: dict[str, tuple[int, float]], total: int) -> DataFrame:
    """video_id, place of the chosen videos. profiles: one narrow row a video (see greedy_cover()).

    Videos alike in slots, duration class, density class and source score alike in every round, so of each such group the first `total` by
    video_id and the first `total` by quality are all that can be chosen: the pool that reaches the driver has at most 2 x total videos a group.
    """
    extra = [c for c in ("duration", "n_objects", "source") if c in profiles.columns]
    narrow = profiles.select("video_id", "score", *extra, *(F.col(s).cast("int").alias(s) for s in slots))
    group = [*slots]
    if "duration" in extra:
        group.append((F.when(F.col("duration") < 15, 0).when(F.col("duration") < 40, 1).otherwise(2)).alias("d"))
    if "n_objects" in extra:
        group.append((F.when(F.col("n_objects") < 5, 0).when(F.col("n_objects") < 9, 1).otherwise(2)).alias("o"))
    if "source" in extra:
        group.append("source")
    by = lambda *order: F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    pool = narrow.withColumns({"r": by("video_id"), "q": by(F.desc("score"), "video_id")}).where((F.col("r") <= total) | (F.col("q") <= total)).drop("r", "q").orderBy("video_id").limit(MOST_POOL + 1).toPandas()
    if len(pool) > MOST_POOL:
        raise ValueError(f"more than {MOST_POOL} videos of different kinds; fewer slots or a smaller total are needed")
    chosen = greedy_cover(pool, slots, total)
    return profiles.sparkSession.createDataFrame(list(zip(chosen, range(len(chosen)))), "video_id string, place int")


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pairs of one video by rising jump; a track that was absorbed takes no further part, one that absorbed may go on."""
    absorbed: set[int] = set()
    out = []
    for row in pdf.sort_values(["jump_px", "obj_a", "obj_b"], kind="stable").itertuples():
        if row.obj_a in absorbed or row.obj_b in absorbed:
            continue
        absorbed.add(row.obj_b)
        out.append((row.video_id, row.obj_a, row.obj_b, len(out)))
    return pd.DataFrame(out, columns=["video_id", "kept", "absorbed", "step"])


def merge_steps(pairs: DataFrame) -> DataFrame:
    """video_id, kept, absorbed, step (order within the video). pairs: video_id, obj_a, obj_b, jump_px; a video has few objects."""
    return pairs.groupBy("video_id").applyInPandas(_merge, "video_id string, kept int, absorbed int, step int")


def merge_fragments(pairs: DataFrame) -> DataFrame:
    """video_id, kept, absorbed: the pairs of fragments to join."""
    return merge_steps(pairs).drop("step")


def _roots(pdf: pd.DataFrame) -> pd.DataFrame:
    """Last keeper of each track of one video's merges, and the track's turn when its keeper's hidden frames are filled."""
    members: dict[int, list[int]] = {}
    for row in pdf.sort_values("step").itertuples():
        members.setdefault(row.kept, [row.kept]).extend(members.pop(row.absorbed, [row.absorbed]))
    out = [(pdf["video_id"].iloc[0], obj, root, turn) for root, own in members.items() for turn, obj in enumerate(own)]
    return pd.DataFrame(out, columns=["video_id", "obj_id", "root", "turn"])


def merged_frames(frames: DataFrame, steps: DataFrame) -> DataFrame:
    """frames with absorbed tracks gone: a frame that their keeper doesn't show is filled from them, in the order of the merges.

    frames: a row an object and frame (video_id, obj_id, frame, visible, ...). Tracks without merges pass through; merges (counted per keeper) is added.
    """
    roots = steps.groupBy("video_id").applyInPandas(_roots, "video_id string, obj_id int, root int, turn int")
    count = steps.groupBy("video_id", F.col("kept").alias("root")).agg(F.count(F.lit(1)).alias("merges"))
    one = frames.join(roots, ["video_id", "obj_id"], "left").withColumn("root", F.coalesce("root", "obj_id")).withColumn("turn", F.coalesce("turn", F.lit(0)))
    own = [c for c in frames.columns if c not in ("video_id", "obj_id", "frame")]
    first = F.min_by(F.struct(*own), F.struct((~F.coalesce("visible", F.lit(False))).alias("h"), F.col("turn").alias("t")))
    picked = one.groupBy("video_id", F.col("root").alias("obj_id"), "frame").agg(first.alias("r")).select("video_id", "obj_id", "frame", "r.*")
    return picked.join(count.withColumnRenamed("root", "obj_id"), ["video_id", "obj_id"], "left").na.fill(0, ["merges"])


def probe_order(n: int) -> list[int]:
    """Frames in the order in which they are probed: the middle, then the middles of the halves, and so on."""
    out, level = [], [(0, n - 1)]
    while level:
        following = []
        for low, high in level:
            if low <= high:
                mid = (low + high) // 2
                out.append(mid)
                following += [(low, mid - 1), (mid + 1, high)]
        level = following
    return out


