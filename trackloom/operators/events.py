"""Events of objects and pairs of objects, found with windows over frame states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom import vocab as V
from trackloom.operators.frames import OBJECT, border, by_frame, documents, frames, iou, state_runs, states, time_bucket

#: Columns of an event; frame is null for ranges, start and end for points, other for events of one object.
EVENT = ["video_id", "type", "obj_id", "other", "frame", "start", "end", "track_ord", "emit", "n_video", "label", "after_event", "detail"]


def state_changes(s: DataFrame) -> DataFrame:
    """Jumps of area (else of position) between neighbouring visible frames, at least JUMP_GAP frames after the last one kept."""
    lag = lambda c: F.lag(c).over(by_frame())
    shown = (F.col("state") != "invisible") & (lag("state") != "invisible")
    grown = F.when(lag("area") > 0, F.abs(F.col("area") - lag("area")) / lag("area"))
    shift = F.hypot((F.col("x1") + F.col("x2") - lag("x1") - lag("x2")) / 2, (F.col("y1") + F.col("y2") - lag("y1") - lag("y2")) / 2) / F.hypot("width", "height")
    jumps = s.select(*OBJECT, "track_ord", "n_video", "label", "frame", shown.alias("shown"), grown.alias("grown"), shift.alias("shift"))
    jumps = jumps.where(F.col("shown") & ((F.col("grown") > V.AREA_JUMP) | (F.col("shift") > V.POSITION_JUMP)))
    value = F.when(F.col("grown") > V.AREA_JUMP, F.col("grown")).otherwise(F.col("shift"))
    listed = jumps.groupBy(*OBJECT, "track_ord", "n_video", "label").agg(F.array_sort(F.collect_list(F.struct("frame", value.alias("v")))).alias("c"))
    # whether a jump counts depends on the last one that did, so the candidates of an object are folded in order
    kept = F.expr(f"aggregate(c, cast(array() as array<struct<frame:int,v:double>>), (a, x) -> if(size(a) = 0 or x.frame - element_at(a, -1).frame >= {V.JUMP_GAP}, concat(a, array(x)), a))")
    out = listed.select(*OBJECT, "track_ord", "n_video", "label", F.explode(kept).alias("k")).select(*OBJECT, "track_ord", "n_video", "label", "k.frame", "k.v")
    null = lambda t: F.lit(None).cast(t)
    return out.select(
        "video_id", F.lit("state_change").alias("type"), "obj_id", null("int").alias("other"), F.col("frame").cast("int").alias("frame"), null("int").alias("start"), null("int").alias("end"), "track_ord",
        (F.lit(10**9) + F.col("frame")).cast("long").alias("emit"), "n_video", "label", null("string").alias("after_event"), F.col("v").alias("detail"),
    )


def object_events(s: DataFrame) -> DataFrame:
    """All events of single objects (EVENT columns) from frames with states; a run gives up to three, from one pass over the runs."""
    runs = state_runs(s)
    w = Window.partitionBy(*OBJECT).orderBy("run")
    shown = (F.col("state") != "invisible").cast("int")
    back = border("first_")
    runs = runs.select(
        "video_id", "obj_id", "state", "start", "end", "n", "track_ord", "n_video", "label", back.alias("border"), border("prev_").alias("left"),
        *(F.lead(c).over(w).alias(f"next_{c}") for c in ("start", "ahead")), F.lead(back).over(w).alias("next_border"), F.coalesce(F.max(shown).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    )
    kind = F.when(F.col("left"), "exit_frame").otherwise("full_occlusion")
    none = F.lit(None)

    def one(when: Column, kind: Column, emit: Column, frame: Column = none, span: bool = False, after: Column = none, detail: Column = none) -> Column:
        start, end = (F.col("start"), F.col("end")) if span else (none, none)
        return F.when(when, F.struct(kind.alias("type"), frame.cast("int").alias("frame"), start.cast("int").alias("start"), end.cast("int").alias("end"), emit.cast("long").alias("emit"), after.cast("string").alias("after_event"), detail.cast("double").alias("detail")))

    at = 1 + F.col("start") * 4
    visible, gone = F.col("state") != "invisible", (F.col("state") == "invisible") & (F.col("n") >= V.MIN_FULL) & (F.col("before") == 1)
    came = gone & F.col("next_start").isNotNull() & (F.col("next_ahead") >= V.MIN_REAPPEAR)
    found = F.array(
        one(visible & (F.col("before") == 0) & (F.col("start") > 2), F.when(F.col("border"), "enter_frame").otherwise("appear"), F.lit(0), frame=F.col("start")),
        one((F.col("state") == "partial") & (F.col("n") >= V.MIN_PARTIAL), F.lit("partial_occlusion"), at, span=True),
        one(gone, kind, at, span=True),
        one(gone & F.col("next_start").isNull(), F.lit("disappear"), at + 2, frame=F.col("start"), after=kind),
        one(came & F.col("next_border"), F.lit("enter_frame"), at + 1, frame=F.col("next_start"), after=kind),
        one(came, F.lit("reappear"), at + 2, frame=F.col("next_start"), after=kind, detail=F.col("n")),
    )
    listed = runs.select("video_id", "obj_id", "track_ord", "n_video", "label", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("e"))
    events = listed.select("video_id", "e.type", "obj_id", F.lit(None).cast("int").alias("other"), "e.frame", "e.start", "e.end", "track_ord", "e.emit", "n_video", "label", "e.after_event", "e.detail")
    return events.unionByName(state_changes(s))


def pair_frames(f: DataFrame) -> DataFrame:
    """Pairs of objects of a video (in track order) at the frames where both are visible: a_*, b_* columns."""
    cols = ["track_ord", "obj_id", "label", "n_obj", "x1", "y1", "x2", "y2"]
    shown = f.where("visible")
    a = shown.select("video_id", "frame", "width", "height", "n_video", *(F.col(c).alias(f"a_{c}") for c in cols))
    b = shown.select("video_id", "frame", *(F.col(c).alias(f"b_{c}") for c in cols))
    return a.join(b, ["video_id", "frame"]).where("a_track_ord < b_track_ord")


def interactions(f: DataFrame) -> DataFrame:
    """Stretches of overlapping boxes of two objects, as EVENT columns (detail: mean overlap) with b_label."""
    over = pair_frames(f).withColumn("iou", iou("a_", "b_")).where(f"iou > {V.OVERLAP_IOU}")
    pair = Window.partitionBy("video_id", "a_obj_id", "b_obj_id").orderBy("frame")
    island = over.withColumn("island", F.col("frame") - F.row_number().over(pair))
    runs = island.groupBy("video_id", "a_obj_id", "b_obj_id", "island").agg(
        *(F.first(c).alias(c) for c in ("a_track_ord", "b_track_ord", "a_label", "b_label", "a_n_obj", "b_n_obj", "n_video")), F.min("frame").alias("start"), F.max("frame").alias("end"), F.count(F.lit(1)).alias("n"), F.avg("iou").alias("iou")
    )
    kept = runs.where((F.col("n") >= V.MIN_OVERLAP) & (F.col("n") / F.least("a_n_obj", "b_n_obj") <= V.MAX_OVERLAP_SHARE))
    return kept.select(
        "video_id", F.lit("interaction").alias("type"), F.col("a_obj_id").alias("obj_id"), F.col("b_obj_id").alias("other"), F.lit(None).cast("int").alias("frame"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"),
        F.col("a_track_ord").alias("track_ord"), (F.lit(2 * 10**9) + F.col("b_track_ord") * 100_000 + F.col("start")).cast("long").alias("emit"), "n_video", F.col("a_label").alias("label"), F.lit(None).cast("string").alias("after_event"), F.col("iou").alias("detail"), "b_label",
    )


def all_events(tracks: DataFrame) -> DataFrame:
    """Every event of every video with event_id (its place by frame) and canonical frames at, mid."""
    f = frames(documents(tracks))
    both = object_events(states(f)).unionByName(interactions(f), allowMissingColumns=True)
    at = F.coalesce("frame", "start")
    mid = F.coalesce("frame", F.floor((F.col("start") + F.col("end")) / 2)).cast("int")
    order = Window.partitionBy("video_id").orderBy("at", F.col("other").isNotNull(), "track_ord", "emit")
    return both.withColumn("at", at).withColumn("mid", mid).withColumn("event_id", (F.row_number().over(order) - 1)).withColumn("temporal_position", time_bucket(F.col("mid"), F.col("n_video")))


def own(events: DataFrame) -> DataFrame:
    """Events of single objects."""
    return events.where("other is null")


def touching(events: DataFrame) -> DataFrame:
    """One row per event and object it involves (interactions twice)."""
    who = F.array(F.struct("obj_id", "label"), F.when(F.col("other").isNotNull(), F.struct(F.col("other").alias("obj_id"), F.col("b_label").alias("label"))))
    return events.withColumn("who", F.explode(F.filter(who, lambda x: x.isNotNull()))).drop("obj_id", "label").select("*", "who.obj_id", "who.label").drop("who")
