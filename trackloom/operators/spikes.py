"""Implausible readings in measured sequences, judged by what is normal for their source.

Two passes over the sequences, which stay where they are:

1. an exponentially weighted chart runs over each sequence's steps (of the box centre, and of the log area). It starts from the first few
   steps, clips what is far beyond its limit before that could move mean and scale, and so learns what is usual. Means and scales are summed
   by source, next to a small histogram of exact repeats. Sums and histograms are mergeable, so only a few hundred rows
   per source and task are shuffled; limits() turns them into the chart of the source and its longest usual rest;
2. a control chart runs over each sequence. Its mean and scale start from the source's, move with the sequence's own
   (clipped) steps and are drawn back to the source's; a reading beyond mean + CHART_SCALES * scale is suspected, leaves both alone,
   and becomes a spike if the sequence returns within two frames. A departure that lasts is a move and is accepted.
   Run-length counters find stuck stretches; physical limits find impossible boxes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.functions.sequences import Flat, flatten, follows

#: Histogram bins of run lengths: exact up to here, then 24 a decade or 10 % wide each; bin 0 holds what is smaller than SMALLEST.
BINS_A_DECADE = 24
SMALLEST = 0.01
EXACT_RUN = 256
#: A reading is suspected beyond mean + so many scales of the chart; the least scales, in pixels and in log area.
CHART_SCALES = 6.0
AREA_SCALES = 20.0
LEAST_STEP, LEAST_AREA = 0.5, 0.015
#: A spike lasts so many frames at most.
LONGEST_SPIKE = 2
#: Weight of a new value in mean and scale of a chart, and of the source's chart that draws them back.
WEIGHT = 0.1
BACK = 0.1
#: While learning, values are clipped at so many scales; a chart starts from the median of its first steps and counts after the warm-up.
CLIP_SCALES, FIRST_STEPS, WARM_UP = 3.0, 5, 20
#: Rest lengths beyond mean + REST_SCALES deviations, and beyond REST_FACTOR times the longest usual rest, are stuck.
REST_SCALES = 4.0
REST_FACTOR = 1.5
#: Chart of a source without two neighbouring good readings.
UNBOUNDED = 1e18
#: So many rows of limits may be broadcast; beyond it they are joined by shuffle.
MOST_BROADCAST = 4096

STEP, AREA, RUN = 0, 1, 2
#: n readings with sums of the chart's mean and scale (STEP, AREA), or n runs of a length's bin (RUN).
LEARNED = "source string, kind int, bin int, n bigint, mean double, scale double"
LIMITS = "source string, step_mean double, step_scale double, area_mean double, area_scale double, longest_rest double"
FLAGGED = "video_id string, obj_id int, frame bigint, reason string"


def _bin(x: np.ndarray) -> np.ndarray:
    return np.where(x < SMALLEST, 0, 1 + np.floor(np.log10(np.maximum(x, SMALLEST) / SMALLEST) * BINS_A_DECADE + 1e-9)).astype(np.int32)


def _value(b: np.ndarray) -> np.ndarray:
    """Upper edge of a bin."""
    return np.where(b == 0, 0.0, SMALLEST * 10 ** (b / BINS_A_DECADE))


def impossible(flat: Flat, width: np.ndarray, height: np.ndarray) -> np.ndarray:
    """Visible boxes without extent or outside the picture; NaN width or height sets no bound."""
    x1, y1, x2, y2 = flat.box.T
    w, h = width[flat.row], height[flat.row]
    with np.errstate(invalid="ignore"):
        bad = (x2 <= x1) | (y2 <= y1) | (flat.box < 0).any(1) | (np.maximum(x1, x2) > w) | (np.maximum(y1, y2) > h)
    return (flat.visible == 1) & bad


def _measures(flat: Flat, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centre and log area, NaN where a reading is hidden, unknown or impossible."""
    c = (flat.box[:, :2] + flat.box[:, 2:]) / 2
    with np.errstate(invalid="ignore", divide="ignore"):
        a = np.log((flat.box[:, 2] - flat.box[:, 0]) * (flat.box[:, 3] - flat.box[:, 1]))
    c, a = c.copy(), np.where(good, a, np.nan)
    c[~good] = np.nan
    return c, a


def _repeats(flat: Flat) -> tuple[np.ndarray, np.ndarray]:
    """First position and length of each maximal stretch of visible frames with exactly the same box."""
    same = np.zeros(len(flat.row), bool)
    same[1:] = (flat.box[1:] == flat.box[:-1]).all(1) & (flat.visible[1:] == 1) & (flat.visible[:-1] == 1)
    same &= follows(flat)
    start = np.flatnonzero(~same)
    n = np.diff(np.append(start, len(flat.row)))
    seen = flat.visible[start] == 1
    return start[seen], n[seen]


def _flat(batch: pa.RecordBatch) -> tuple[Flat, np.ndarray]:
    flat = flatten(batch["frames"], batch["bboxes"], batch["visible"])
    size = [batch[k].cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False) for k in ("width", "height")]
    return flat, impossible(flat, *size)


def _matrices(flat: Flat) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sequences as rows of matrices of bounded size, those of like length together: (row of the batch, positions, which of them exist)."""
    rows, start, n = np.unique(flat.row, return_index=True, return_counts=True)
    order = np.argsort(n, kind="stable")
    i = 0
    while i < len(order):
        j = i + 1
        while j < len(order) and (j + 1 - i) * n[order[j]] <= 2_000_000 and n[order[j]] <= 2 * n[order[i]] + 16:
            j += 1
        group = order[i:j]
        length = n[group].max()
        inside = np.arange(length) < n[group][:, None]
        yield rows[group], np.where(inside, start[group][:, None] + np.arange(length), 0), inside
        i = j


def _learn(x: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row of x (NaN: no value) the sums of mean and scale of its chart after the warm-up, and their number."""
    rows, length = x.shape
    there = ~np.isnan(x)
    place = np.cumsum(there, 1)
    total = place[:, -1] if length else np.zeros(rows, int)
    first = np.where(there & (place <= FIRST_STEPS), x, np.nan)
    start = np.zeros(rows)
    some = total > 0
    start[some] = np.nanmedian(first[some], 1)
    mean, scale = start.copy(), np.maximum(start, least)
    sums, scales, count = np.zeros(rows), np.zeros(rows), np.zeros(rows, np.int64)
    warm = np.minimum(WARM_UP, total // 2)
    for t in range(length):
        here = there[:, t]
        v = np.minimum(np.where(here, x[:, t], 0), mean + CLIP_SCALES * np.maximum(scale, least))  # clipped before it enters mean and scale
        scale = np.where(here, (1 - WEIGHT) * scale + WEIGHT * np.abs(v - mean), scale)
        mean = np.where(here, (1 - WEIGHT) * mean + WEIGHT * v, mean)
        counts = here & (place[:, t] > warm)
        sums, scales, count = sums + np.where(counts, mean, 0), scales + np.where(counts, scale, 0), count + counts
    return sums, scales, count


def _steps(flat: Flat, bad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Step of the centre and change of the log area from the frame before; NaN where there is none."""
    c, a = _measures(flat, (flat.visible == 1) & ~bad)
    step, change = np.full(len(a), np.nan), np.full(len(a), np.nan)
    step[1:] = np.hypot(*(c[1:] - c[:-1]).T)
    change[1:] = np.abs(a[1:] - a[:-1])
    near = follows(flat)
    step[~near], change[~near] = np.nan, np.nan
    return step, change


def _learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat, bad = _flat(batch)
        parts = []
        step, change = _steps(flat, bad)
        for rows, at, inside in _matrices(flat):
            for kind, x, least in ((STEP, step, LEAST_STEP), (AREA, change, LEAST_AREA)):
                sums, scales, n = _learn(np.where(inside, x[at], np.nan), least)
                parts.append(pd.DataFrame({"row": rows, "kind": kind, "bin": 0, "n": n, "mean": sums, "scale": scales}))
        start, n = _repeats(flat)
        start, n = start[n > 1], n[n > 1]
        parts.append(pd.DataFrame({"row": flat.row[start], "kind": RUN, "bin": np.where(n <= EXACT_RUN, n, EXACT_RUN + _bin(n.astype(float))), "n": 1, "mean": 0.0, "scale": 0.0}))
        codes, names = pd.factorize(batch["source"].to_pandas().astype(object), use_na_sentinel=False)
        out = pd.concat(parts)
        out = out.assign(s=codes[out["row"].to_numpy(int)]).groupby(["s", "kind", "bin"], as_index=False)[["n", "mean", "scale"]].sum()
        yield pa.RecordBatch.from_arrays(
            [pa.array([None if pd.isna(names[i]) else names[i] for i in out["s"]], pa.string()), pa.array(out["kind"], pa.int32()), pa.array(out["bin"], pa.int32()), pa.array(out["n"], pa.int64()), pa.array(out["mean"], pa.float64()), pa.array(out["scale"], pa.float64())],
            names=["source", "kind", "bin", "n", "mean", "scale"],
        )


def longest_rest(length: np.ndarray, n: np.ndarray) -> float:
    """Limit of usual rests: lengths enter mean and scale only within the limit so far, which grows until it holds."""
    if not len(length):
        return float("inf")
    order = np.argsort(length)
    length, n = length[order].astype(float), n[order].astype(float)
    limit = 3 * length[min(np.searchsorted(np.cumsum(n), n.sum() / 2), len(n) - 1)]
    for _ in range(100):
        inside = length <= limit
        x, w = length[inside], n[inside]
        mean = np.average(x, weights=w)
        new = max(mean + REST_SCALES * np.sqrt(np.average((x - mean) ** 2, weights=w)), REST_FACTOR * x.max())
        if new <= limit:
            break
        limit = new
    return float(limit)


def _limits(pdf: pd.DataFrame) -> pd.DataFrame:
    def chart(kind: int, least: float) -> tuple[float, float]:
        part = pdf[pdf["kind"] == kind]
        n = part["n"].sum()
        return (part["mean"].sum() / n, max(least, part["scale"].sum() / n)) if n else (UNBOUNDED, UNBOUNDED)

    runs = pdf[pdf["kind"] == RUN]
    bins, n = runs["bin"].to_numpy(), runs["n"].to_numpy()
    length = np.where(bins <= EXACT_RUN, bins, _value(bins - EXACT_RUN))
    (sm, ss), (am, as_) = chart(STEP, LEAST_STEP), chart(AREA, LEAST_AREA)
    return pd.DataFrame({"source": [pdf["source"].iloc[0]], "step_mean": [sm], "step_scale": [ss], "area_mean": [am], "area_scale": [as_], "longest_rest": [longest_rest(length, n)]})


def sequences(tracks: DataFrame) -> DataFrame:
    """One row per object of a track document, with what its chart needs."""
    obj = F.explode("objects").alias("o")
    return tracks.select("video_id", "source", F.col("metadata.width").alias("width"), F.col("metadata.height").alias("height"), obj).select(
        "video_id", "source", "width", "height", "o.obj_id", "o.frames", "o.bboxes", "o.visible"
    )


def source_limits(seq: DataFrame) -> DataFrame:
    """The chart (mean and scale of steps and of changes of the log area) and longest usual rest of each source (null is a source of its own)."""
    learned = seq.select("source", "width", "height", "frames", "bboxes", "visible").mapInArrow(_learned, LEARNED)
    return learned.groupBy("source", "kind", "bin").agg(*(F.sum(c).alias(c) for c in ("n", "mean", "scale"))).groupBy("source").applyInPandas(_limits, LIMITS)


def _chart(x: np.ndarray, y: np.ndarray, a: np.ndarray, linked: np.ndarray, step: tuple[np.ndarray, np.ndarray], area: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Spikes in sequences of equal length, one per row; linked: the reading follows the one before without a gap.

    step and area: mean and scale of each row's source, from which its own start and to which they are drawn back.
    """
    rows, length = x.shape
    spike = np.zeros((rows, length), bool)
    px, py, pa_ = x[:, 0].copy(), y[:, 0].copy(), a[:, 0].copy()  # last accepted reading
    mean, scale = step[0].copy(), step[1].copy()
    amean, ascale = area[0].copy(), area[1].copy()
    waiting = np.zeros(rows, int)  # suspected readings since
    for t in range(1, length):
        here, there = ~np.isnan(x[:, t]), ~np.isnan(px)
        broken = here & (~linked[:, t] | ~there)
        gone = ~here
        moved = np.hypot(x[:, t] - px, y[:, t] - py)
        grown = np.abs(a[:, t] - pa_)
        limit, alimit = mean + CHART_SCALES * scale, amean + AREA_SCALES * ascale
        alike = (moved <= limit + waiting * mean) & (grown <= alimit + waiting * amean)
        judged = here & ~broken
        back = judged & alike & (waiting > 0)
        for w in range(1, LONGEST_SPIKE + 1):
            of = np.flatnonzero(back & (waiting == w))
            for k in range(1, w + 1):
                # what is flagged departs from the frame after as well as from the frame before
                far = (np.hypot(x[of, t - k] - x[of, t], y[of, t - k] - y[of, t]) > limit[of]) | (np.abs(a[of, t - k] - a[of, t]) > alimit[of])
                spike[of[far], t - k] = True
        suspected = judged & ~alike
        lasting = suspected & (waiting >= LONGEST_SPIKE)
        accept = (judged & alike) | broken | lasting
        calm = judged & alike & (waiting == 0)
        v, g = np.where(calm, np.minimum(moved, limit), 0), np.where(calm, np.minimum(grown, alimit), 0)
        own = 1 - WEIGHT - BACK
        mean, scale = np.where(calm, own * mean + WEIGHT * v + BACK * step[0], mean), np.where(calm, own * scale + WEIGHT * np.abs(v - mean) + BACK * step[1], scale)
        amean, ascale = np.where(calm, own * amean + WEIGHT * g + BACK * area[0], amean), np.where(calm, own * ascale + WEIGHT * np.abs(g - amean) + BACK * area[1], ascale)
        mean, scale = np.where(broken, step[0], mean), np.where(broken, step[1], scale)
        amean, ascale = np.where(broken, area[0], amean), np.where(broken, area[1], ascale)
        px, py, pa_ = np.where(accept, x[:, t], px), np.where(accept, y[:, t], py), np.where(accept, a[:, t], pa_)
        px = np.where(gone, np.nan, px)
        waiting = np.where(accept | gone, 0, np.where(suspected, waiting + 1, waiting))
    return spike


def _spikes(flat: Flat, good: np.ndarray, step: tuple[np.ndarray, np.ndarray], area: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Charts of all sequences of a batch."""
    out = np.zeros(len(flat.row), bool)
    c, a = _measures(flat, good)
    linked = follows(flat)
    for rows, at, inside in _matrices(flat):
        x, y, z = (np.where(inside, v[at], np.nan) for v in (c[:, 0], c[:, 1], a))
        with np.errstate(invalid="ignore"):
            found = _chart(x, y, z, linked[at] & inside, (step[0][rows], step[1][rows]), (area[0][rows], area[1][rows]))
        out[at[found & inside]] = True
    return out


def _flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat, bad = _flat(batch)
        sm, ss, am, as_, rest = (batch[k].to_numpy(zero_copy_only=False) for k in ("step_mean", "step_scale", "area_mean", "area_scale", "longest_rest"))
        spike = _spikes(flat, (flat.visible == 1) & ~bad, (sm, ss), (am, as_))
        start, n = _repeats(flat)
        stuck = start[n > rest[flat.row[start]]]
        at = np.concatenate([np.flatnonzero(bad), np.flatnonzero(spike), stuck])
        reason = np.repeat(["impossible", "spike", "stuck"], [bad.sum(), spike.sum(), len(stuck)])
        rows = pa.array(flat.row[at])
        yield pa.RecordBatch.from_arrays([batch["video_id"].take(rows), batch["obj_id"].take(rows).cast(pa.int32()), pa.array(flat.frame[at], pa.int64()), pa.array(reason, pa.string())], names=["video_id", "obj_id", "frame", "reason"])


def flag_readings(tracks: DataFrame) -> DataFrame:
    """video_id, obj_id, frame, reason (impossible, spike, stuck) of each flagged visible reading, each once.

    A stuck stretch gives its first frame. Hidden readings and unknown visibility are never flagged; a null or malformed
    box is skipped; a null width or height bounds nothing; documents without objects give no rows. A
    repeated frame number counts once. Copies of a document give the same rows, which are returned once.
    """
    seq = sequences(tracks)
    limits = source_limits(seq).withColumnRenamed("source", "of")
    from trackloom.session import cut

    limits = cut(limits)
    if limits.count() <= MOST_BROADCAST:
        limits = F.broadcast(limits)
    # a source without two neighbouring good readings has no limits: only impossible readings are flagged there
    joined = seq.join(limits, seq["source"].eqNullSafe(F.col("of")), "left").drop("of", "source").na.fill(UNBOUNDED, ["step_mean", "step_scale", "area_mean", "area_scale", "longest_rest"])
    return joined.mapInArrow(_flag, FLAGGED).distinct()


def rates(tracks: DataFrame) -> DataFrame:
    """Flagged readings by source and reason, with the number of readings of the source."""
    once = tracks.groupBy("video_id").agg(F.first("source", ignorenulls=True).alias("source"), F.max(F.expr("aggregate(objects, 0L, (s, o) -> s + coalesce(size(o.frames), 0))")).alias("readings"))
    flagged = flag_readings(tracks).groupBy("video_id", "reason").agg(F.count(F.lit(1)).alias("n"))
    total = once.groupBy("source").agg(F.sum("readings").alias("readings"))
    found = once.join(flagged, "video_id").groupBy("source", "reason").agg(F.sum("n").alias("flagged"))
    found = found.withColumnRenamed("source", "of")
    return total.join(found, total["source"].eqNullSafe(found["of"])).select("source", "reason", "flagged", "readings")
