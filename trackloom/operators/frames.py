"""Track documents as one row per object and frame, and per-frame states."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom import vocab as V
from trackloom.operators.delivery import keep_one
from trackloom.session import cut

OBJECT = ["video_id", "obj_id"]


def by_frame():
    """Window over an object's frames in order."""
    return Window.partitionBy(*OBJECT).orderBy("frame")


#: Copies of documents that may be broadcast by position; beyond it bitmaps per file tell them.
MOST_COPIES = 1_000_000


def documents(tracks: DataFrame) -> DataFrame:
    """One document per video (copies differ in processing time only); null video ids are dropped.

    Of a table in files only identifiers and positions are shuffled, and later copies are left out where they lie; the nested documents never move.
    """
    named = tracks.where("video_id is not null")
    try:
        at = tracks.select("video_id", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).where("video_id is not null")
    except AnalysisException:  # not straight from files
        return named.dropDuplicates(["video_id"])
    first = at.groupBy("video_id").agg(F.min(F.struct("file", "row")).alias("at"), F.count(F.lit(1)).alias("n")).where("n > 1")
    few = cut(first.select("video_id", "at.*", "n"))
    if (few.agg(F.sum("n")).first()[0] or 0) <= MOST_COPIES:
        # of videos with copies the first row is kept; the test is by value, so that the scan stays where it is
        wide = tracks.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row")).where("video_id is not null")
        first = F.broadcast(few.select(F.col("video_id").alias("__v"), F.col("file").alias("__f"), F.col("row").alias("__r")))
        joined = wide.join(first, wide["video_id"] == F.col("__v"), "left")
        return joined.where("__v is null or (__file = __f and __row = __r)").select(*tracks.columns)
    return keep_one(tracks, ["video_id"], []).where("video_id is not null")


def objects(docs: DataFrame) -> DataFrame:
    """One row per object: track_ord is its place in the document, n_video the number of frames of the video."""
    head = ["video_id", "source", F.col("metadata.width").alias("width"), F.col("metadata.height").alias("height"), F.col("metadata.duration").alias("duration"), F.size("timestamps").alias("n_video")]
    return docs.select(*head, F.posexplode("objects").alias("track_ord", "o")).select("video_id", "source", "width", "height", "duration", "n_video", "track_ord", "o.*")


def frames(docs: DataFrame) -> DataFrame:
    """One row per object and frame: frame, x1..y2, visible, confidence, area; n_obj is the number of frames of the object."""
    zipped = F.explode(F.arrays_zip("frames", "bboxes", "visible", "confidence", "mask_areas")).alias("r")
    one = objects(docs).select("video_id", "width", "height", "n_video", "track_ord", "obj_id", "label", F.size("frames").alias("n_obj"), zipped)
    box = F.col("r.bboxes")
    return one.select(
        "video_id", "width", "height", "n_video", "track_ord", "obj_id", "label", "n_obj", F.col("r.frames").alias("frame"),
        *(F.get(box, F.lit(i)).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))),
        F.col("r.visible").alias("visible"), F.col("r.confidence").alias("confidence"), F.col("r.mask_areas").alias("area"),
    ).where("frame is not null")


def near_border(x1: Column, y1: Column, x2: Column, y2: Column, w: Column, h: Column, margin: float = V.BORDER) -> Column:
    return (x1 < w * margin) | (y1 < h * margin) | (x2 > w * (1 - margin)) | (y2 > h * (1 - margin))


def border(prefix: str = "") -> Column:
    return near_border(*(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2")), F.col("width"), F.col("height"))


def iou(a: str, b: str) -> Column:
    """Intersection over union of boxes in columns a.x1.. and b.x1..; 0 without union."""
    side = lambda p, lo, hi: F.greatest(F.lit(0), F.col(f"{p}{hi}") - F.col(f"{p}{lo}"))
    inter = F.greatest(F.lit(0), F.least(f"{a}x2", f"{b}x2") - F.greatest(f"{a}x1", f"{b}x1")) * F.greatest(F.lit(0), F.least(f"{a}y2", f"{b}y2") - F.greatest(f"{a}y1", f"{b}y1"))
    union = side(a, "x1", "x2") * side(a, "y1", "y2") + side(b, "x1", "x2") * side(b, "y1", "y2") - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def bucket(value: Column, table: list[tuple[str, float | None]]) -> Column:
    """Name of the first bucket whose upper bound exceeds the value."""
    out = F.lit(table[-1][0])
    for name, high in reversed(table[:-1]):
        out = F.when(value < high, name).otherwise(out)
    return out


def time_bucket(frame: Column, n: Column) -> Column:
    return F.when(n <= 1, V.TIME_BUCKETS[0][0]).otherwise(bucket(F.greatest(F.lit(0.0), F.least(F.lit(0.9999), frame / (n - 1))), V.TIME_BUCKETS))


def place(x1: Column, y1: Column, x2: Column, y2: Column, w: Column, h: Column) -> Column:
    """3 x 3 place of the box centre; the middle row and column drop out of the name."""
    cx, cy = (x1 + x2) / 2, (y1 + y2) / 2
    x = F.when(cx < w * 0.33, "left").when(cx > w * 0.67, "right").otherwise("center")
    y = F.when(cy < h * 0.33, "upper").when(cy > h * 0.67, "lower").otherwise("middle")
    return F.when((w <= 0) | (h <= 0), "center").when(y == "middle", x).when(x == "center", y).otherwise(F.concat_ws("-", y, x))


def states(f: DataFrame) -> DataFrame:
    """f with baseline (median area of the visible frames among the ten before, else the first visible area) and state."""
    seen = F.when(F.col("visible") & (F.col("area") > 0), F.col("area"))
    past = F.percentile(seen, F.lit(0.5)).over(by_frame().rowsBetween(-V.BASELINE_WINDOW, -1))
    whole = by_frame().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    base = F.coalesce(past, F.first(seen, ignorenulls=True).over(whole).cast("double"), F.lit(0.0))
    ratio = F.col("area") / F.col("baseline")
    hidden = ~F.coalesce("visible", F.lit(False)) | (F.coalesce("area", F.lit(0)) == 0)
    state = F.when(hidden, "invisible").when(F.col("baseline") <= 0, "normal").when(ratio < V.FULL_RATIO, "invisible").when(ratio < V.PARTIAL_RATIO, "partial").otherwise("normal")
    return f.withColumn("baseline", base).withColumn("state", state)


def state_runs(s: DataFrame) -> DataFrame:
    """Maximal runs of one state: run, state, start, end, n, and what surrounds a run for event detection.

    prev_*: the box before the run; first_*: its first box; ahead: visible frames among the first four of the run.
    """
    changed = (F.col("state") != F.lag("state").over(by_frame())) | F.lag("state").over(by_frame()).isNull()
    ahead = F.sum((F.col("state") != "invisible").cast("int")).over(by_frame().rowsBetween(0, V.MIN_REAPPEAR + 1))
    boxes = [c for k in ("x1", "y1", "x2", "y2") for c in (F.lag(k).over(by_frame()).alias(f"prev_{k}"),)]
    keep = ["width", "height", "n_video", "track_ord", "label", "frame", "state", "x1", "y1", "x2", "y2"]
    marked = s.select(*OBJECT, *keep, changed.cast("int").alias("changed"), ahead.alias("ahead"), *boxes)
    numbered = marked.withColumn("run", F.sum("changed").over(by_frame()))
    first = [F.min_by(c, "frame").alias(c if c.startswith("prev") or c == "ahead" else f"first_{c}") for c in ("prev_x1", "prev_y1", "prev_x2", "prev_y2", "x1", "y1", "x2", "y2", "ahead")]
    return numbered.groupBy(*OBJECT, "run", "state").agg(*(F.first(c).alias(c) for c in ("width", "height", "n_video", "track_ord", "label")), F.min("frame").alias("start"), F.max("frame").alias("end"), F.count(F.lit(1)).alias("n"), *first)
