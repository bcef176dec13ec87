"""Queries over track documents: states, runs, events, pairs, timelines and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom import vocab as V
from trackloom.operators import events as E
from trackloom.operators import frames as R
from trackloom.functions.labels import label_parts
from trackloom.operators.ranking import ordinal
from trackloom.operators.selection import merge_steps, merged_frames
from trackloom.plans import sqltext as T
from trackloom.session import cut
from trackloom.session import cut as _cut
from trackloom.tables import load


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return R.documents(load(spark, d, "tracks"))


def _frames(spark: SparkSession, d: str) -> DataFrame:
    return R.frames(_docs(spark, d))


def _events(spark: SparkSession, d: str, made: DataFrame | None = None) -> DataFrame:
    """All events (or those already made), written once to the shared folder: far smaller than the frames, and read several times below."""
    return made if made is not None else cut(E.all_events(load(spark, d, "tracks")))


def event_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events by type."""
    return _events(spark, d).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sum("at").alias("frames"))


def rolling_baseline(spark: SparkSession, d: str) -> DataFrame:
    return R.states(_frames(spark, d)).select("video_id", "obj_id", "frame", "area", "baseline", "state")


def frame_state_runs(spark: SparkSession, d: str) -> DataFrame:
    return R.state_runs(R.states(_frames(spark, d))).select("video_id", "obj_id", "state", F.col("start").alias("start_frame"), F.col("end").alias("end_frame"), "n")


def detected_events(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select("video_id", "event_id", "type", "obj_id", "other", "frame", F.col("start").alias("start_frame"), F.col("end").alias("end_frame"), "temporal_position", "after_event", F.round("detail", 6).alias("detail"))


def occlusion_events(spark: SparkSession, d: str) -> DataFrame:
    e = E.object_events(R.states(_frames(spark, d))).where("type in ('partial_occlusion', 'full_occlusion', 'exit_frame')")
    return e.select("video_id", "obj_id", "type", F.col("start").alias("start_frame"), F.col("end").alias("end_frame"), (F.col("end") - F.col("start") + 1).alias("duration_frames"))


def state_change_cooldown(spark: SparkSession, d: str) -> DataFrame:
    return E.state_changes(R.states(_frames(spark, d))).select("video_id", "obj_id", "frame", F.round("detail", 6).alias("ratio"))


def pair_covisibility(spark: SparkSession, d: str) -> DataFrame:
    pairs = E.pair_frames(_frames(spark, d)).groupBy("video_id", F.col("a_obj_id").alias("obj_a"), F.col("b_obj_id").alias("obj_b")).agg(F.count(F.lit(1)).alias("n"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.first("n_video").alias("n_video"))
    return pairs.where("n >= 3").withColumn("ratio", F.round(F.col("n") / F.greatest(F.lit(1), "n_video"), 6)).drop("n_video")


def pair_interactions(spark: SparkSession, d: str) -> DataFrame:
    e = E.interactions(_frames(spark, d))
    return e.select("video_id", F.col("obj_id").alias("obj_a"), F.col("other").alias("obj_b"), F.col("start").alias("start_frame"), F.col("end").alias("end_frame"), F.round("detail", 6).alias("mean_iou"))


def occluder_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Other objects that overlap the last visible box around the start of a full occlusion: the first hit of each, by overlap."""
    f = _frames(spark, d)
    full = E.object_events(R.states(f)).where("type = 'full_occlusion'").select("video_id", "obj_id", F.col("start").alias("gone"))
    last = f.where("visible").select("video_id", "obj_id", "frame", *(F.col(c).alias(f"r_{c}") for c in ("x1", "y1", "x2", "y2")))
    # the last frame with visible = true before the occlusion
    ref = full.join(last, ["video_id", "obj_id"]).where("frame < gone").groupBy("video_id", "obj_id", "gone").agg(*(F.max_by(f"r_{c}", "frame").alias(f"r_{c}") for c in ("x1", "y1", "x2", "y2")))
    near = ref.withColumn("frame", F.explode(F.sequence(F.greatest(F.lit(0), F.col("gone") - V.OCCLUDER_FRAMES), F.col("gone") + V.OCCLUDER_FRAMES)))
    other = f.where("visible").select("video_id", "frame", F.col("obj_id").alias("occluder"), *(F.col(c).alias(f"o_{c}") for c in ("x1", "y1", "x2", "y2")))
    hit = near.join(other, ["video_id", "frame"]).where("occluder <> obj_id").withColumn("iou", R.iou("r_", "o_")).where(f"iou > {V.OCCLUDER_IOU}")
    first = hit.groupBy("video_id", "obj_id", "gone", "occluder").agg(F.round(F.min_by("iou", "frame"), 6).alias("iou"))
    rank = Window.partitionBy("video_id", "obj_id", "gone").orderBy(F.desc("iou"), "occluder")
    return first.withColumn("rank", F.row_number().over(rank)).withColumnRenamed("gone", "start_frame")


def cross_event_pairs(spark: SparkSession, d: str) -> DataFrame:
    own = E.own(_events(spark, d)).where("type <> 'state_change'").select("video_id", "obj_id", "type", "at", "event_id")
    a, b = (own.select("video_id", "obj_id", *(F.col(c).alias(f"{c}_{k}") for c in ("type", "at", "event_id"))) for k in "ab")
    return a.join(b, ["video_id", "obj_id"]).where("event_id_a < event_id_b and type_a <> type_b and at_b - at_a >= 2").select("video_id", "obj_id", "event_id_a", "event_id_b", "type_a", "type_b")


def _last_hidden(e: DataFrame) -> DataFrame:
    """As-of: every reappearance with the latest occlusion or exit of its object that ended by then."""
    kind = F.when(F.col("type").isin("full_occlusion", "exit_frame"), F.struct(F.col("type").alias("cause"), F.col("start").alias("s"), F.col("end").alias("e")))
    # an ordered window instead of an inequality join: one pass over an object's events
    w = Window.partitionBy("video_id", "obj_id").orderBy(F.coalesce("end", "frame"), F.col("frame").isNotNull(), "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = E.own(e).withColumn("h", F.last(kind, ignorenulls=True).over(w))
    return own.where("type = 'reappear' and h is not null").select("video_id", "obj_id", "label", "event_id", "frame", "h.cause", "h.s", "h.e")


def asof_prev_event(spark: SparkSession, d: str) -> DataFrame:
    return _last_hidden(_events(spark, d)).select("video_id", "obj_id", "event_id", "cause", F.col("s").alias("start_frame"), F.col("e").alias("end_frame"))


def identity_candidates(spark: SparkSession, d: str, made: DataFrame | None = None) -> DataFrame:
    """Siblings that could be mistaken for a returning object: same noun, visible while it was hidden, elsewhere when it returns."""
    f = _frames(spark, d)
    hidden = _last_hidden(_events(spark, d, made)).where(F.col("e") - F.col("s") >= V.SIBLING_HIDDEN_S * V.FPS)
    names = R.objects(_docs(spark, d)).select("video_id", "obj_id", label_parts(F.col("label")).alias("p")).select("video_id", "obj_id", F.col("p.base").alias("base"), F.col("p.modifiers").alias("mods"))
    sib = names.select("video_id", F.col("obj_id").alias("sib"), "base", F.col("mods").alias("sib_mods"))
    pair = hidden.join(names, ["video_id", "obj_id"]).join(sib, ["video_id", "base"]).where("sib <> obj_id and mods <> sib_mods and base <> ''")
    seen = f.select("video_id", F.col("obj_id").alias("sib"), F.col("frame").alias("at"), "visible", *(F.col(c).alias(f"s_{c}") for c in ("x1", "y1", "x2", "y2")), "width", "height")
    during = pair.join(seen.select("video_id", "sib", "at", "visible"), ["video_id", "sib"]).where("at between s and e").groupBy("video_id", "obj_id", "event_id", "sib", "frame", "s", "e").agg(F.avg(F.col("visible").cast("int")).alias("covis"))
    own = f.select("video_id", "obj_id", "frame", *(F.col(c).alias(f"t_{c}") for c in ("x1", "y1", "x2", "y2")))
    there = during.where(f"covis >= {V.SIBLING_COVISIBLE}").join(own, ["video_id", "obj_id", "frame"]).join(seen.drop("visible").withColumnRenamed("at", "frame"), ["video_id", "sib", "frame"])
    there = there.where("t_x2 > t_x1 and t_y2 > t_y1 and s_x2 > s_x1 and s_y2 > s_y1")
    far = F.hypot((F.col("t_x1") + F.col("t_x2") - F.col("s_x1") - F.col("s_x2")) / 2, (F.col("t_y1") + F.col("t_y2") - F.col("s_y1") - F.col("s_y2")) / 2) / F.hypot("width", "height")
    return there.withColumn("distance", far).where(f"distance >= {V.SIBLING_DISTANCE}").select("video_id", "obj_id", F.col("sib").alias("sibling"), "event_id", F.round((F.col("e") - F.col("s")) / V.FPS, 6).alias("hidden_s"), F.round("covis", 6).alias("covisibility"), F.round("distance", 6).alias("distance"))


def visible_range(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("visible")
    return _frames(spark, d).groupBy("video_id", "obj_id").agg(F.min(F.when(v, F.col("frame"))).alias("first_frame"), F.max(F.when(v, F.col("frame"))).alias("last_frame"), F.count_if(v).alias("visible_frames"), F.min_by(F.when(v, (F.col("x1") + F.col("x2")) / 2), F.when(v, F.col("frame"))).alias("first_x"), F.max_by(F.when(v, (F.col("y1") + F.col("y2")) / 2), F.when(v, F.col("frame"))).alias("last_y"))


def _swaps(f: DataFrame) -> DataFrame:
    """Jumps of more than SWAP_JUMP diagonals from the visible valid frame before, at most SWAP_FRAMES earlier."""
    ok = f.where("visible and x2 > x1 and y2 > y1").select("video_id", "obj_id", "frame", "width", "height", ((F.col("x1") + F.col("x2")) / 2).alias("cx"), ((F.col("y1") + F.col("y2")) / 2).alias("cy"))
    lag = lambda c: F.lag(c).over(R.by_frame())
    jump = ok.select("*", lag("frame").alias("before"), F.hypot(F.col("cx") - lag("cx"), F.col("cy") - lag("cy")).alias("jump_px"))
    return jump.where((F.col("frame") - F.col("before") <= V.SWAP_FRAMES) & (F.col("jump_px") > V.SWAP_JUMP * F.hypot("width", "height")))


def swap_detection(spark: SparkSession, d: str) -> DataFrame:
    return _swaps(_frames(spark, d)).select("video_id", "obj_id", F.col("before").alias("frame_before"), F.col("frame").alias("frame_after"), F.round("jump_px", 6).alias("jump_px"))


def _confidence(f: DataFrame, merges: Column | None = None) -> DataFrame:
    """swaps, mean, ratio and confidence of every object; merges: how often fragments were joined into it."""
    swaps = _swaps(f).groupBy("video_id", "obj_id").agg(F.count(F.lit(1)).alias("swaps"))
    one = f.groupBy("video_id", "obj_id").agg(F.max(F.lit(0) if merges is None else merges).alias("merges"), F.count_if("visible").alias("visible_frames"), F.coalesce(F.avg(F.when(F.col("visible"), F.coalesce("confidence", F.lit(0.0)))), F.lit(0.0)).alias("mean"), (F.count_if("visible") / F.greatest(F.lit(1), F.first("n_video"))).alias("ratio"))
    out = one.join(swaps, ["video_id", "obj_id"], "left").na.fill(0, ["swaps"])
    penalty = lambda each, n: F.greatest(F.lit(0.0), 1 - F.lit(each) * F.col(n))
    return out.withColumn("confidence", F.col("mean") * penalty(0.15, "merges") * penalty(0.25, "swaps") * F.when(F.col("ratio") < 0.3, 0.8).otherwise(1.0))


def instance_confidence(spark: SparkSession, d: str) -> DataFrame:
    return _confidence(_frames(spark, d)).select("video_id", "obj_id", "swaps", F.round("mean", 6).alias("mean_confidence"), F.round("ratio", 6).alias("visible_ratio"), F.round("confidence", 6).alias("confidence"))


def repaired_tracks(spark: SparkSession, d: str) -> DataFrame:
    """Track repair from end to end: short fragments dropped, fragments of one object joined and filled, then swaps and confidence of what is left."""
    f = _frames(spark, d)
    kept = f.join(short_fragments(spark, d).where("kept").select("video_id", "obj_id"), ["video_id", "obj_id"], "left_semi")
    merged = merged_frames(kept, merge_steps(_mergeable(kept)))
    return _confidence(merged, F.col("merges")).select("video_id", "obj_id", "visible_frames", "merges", "swaps", F.round(F.round("confidence", 8), 4).alias("confidence"), (F.round(F.round("confidence", 8), 4) >= V.CONFIDENT).alias("confident"))


def repair_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals over all videos, and the spread of confidence (smallest, upper median, mean, largest)."""
    n = R.objects(_docs(spark, d)).agg(F.count(F.lit(1)).alias("tracks"))
    r = repaired_tracks(spark, d).agg(F.count(F.lit(1)).alias("kept"), F.sum("merges").alias("merges"), F.sum("swaps").alias("swaps"), F.count_if("confident").alias("confident"), F.round(F.min("confidence"), 6).alias("least"), F.round(F.avg("confidence"), 6).alias("mean"), F.round(F.max("confidence"), 6).alias("most"), F.expr("percentile_disc(0.5) within group (order by confidence)").alias("median"))
    return r.join(F.broadcast(n)).withColumn("share", F.round(F.col("confident") / F.col("kept"), 6))


def confident_objects(spark: SparkSession, d: str) -> DataFrame:
    """video_id, obj_id of objects that questions of the stricter kinds may be about."""
    return _confidence(_frames(spark, d)).where(F.round("confidence", 4) >= V.CONFIDENT).select("video_id", "obj_id")


def short_fragments(spark: SparkSession, d: str) -> DataFrame:
    n = _frames(spark, d).groupBy("video_id", "obj_id").agg(F.count_if("visible").alias("visible_frames"), F.first("n_video").alias("n"))
    return n.withColumn("kept", F.col("visible_frames") >= F.greatest(F.lit(V.MIN_TRACK_FRAMES), F.floor(F.col("n") * V.MIN_TRACK_SHARE))).drop("n")


def _mergeable(f: DataFrame) -> DataFrame:
    """Fragments of one label that don't overlap in time: the later starts soon after, near where the earlier ended."""
    v = F.when(F.col("visible"), F.col("frame"))
    ends = f.groupBy("video_id", "obj_id", "label").agg(F.first("width").alias("w"), F.first("height").alias("h"), F.min(v).alias("f0"), F.max(v).alias("f1"), *(F.min_by((F.col(f"{c}1") + F.col(f"{c}2")) / 2, v).alias(f"{c}_first") for c in "xy"), *(F.max_by((F.col(f"{c}1") + F.col(f"{c}2")) / 2, v).alias(f"{c}_last") for c in "xy"))
    a = ends.select("video_id", "label", "w", "h", F.col("obj_id").alias("obj_a"), F.col("f1").alias("a_end"), F.col("x_last").alias("ax"), F.col("y_last").alias("ay"))
    b = ends.select("video_id", "label", F.col("obj_id").alias("obj_b"), F.col("f0").alias("b_start"), F.col("x_first").alias("bx"), F.col("y_first").alias("by"))
    both = a.join(b, ["video_id", "label"]).where(f"obj_a <> obj_b and a_end < b_start and b_start - a_end <= {V.MERGE_GAP_S * V.FPS}")
    return both.withColumn("jump_px", F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))).where(F.col("jump_px") <= V.MERGE_JUMP * F.hypot("w", "h")).select("video_id", "obj_a", "obj_b", (F.col("b_start") - F.col("a_end")).alias("gap"), "jump_px")


def mergeable_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _mergeable(_frames(spark, d)).withColumn("jump_px", F.round("jump_px", 6))


def event_counts_map(spark: SparkSession, d: str) -> DataFrame:
    c = _events(spark, d).groupBy("video_id", "type").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("video_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "type", "n"))), ",").alias("counts"), F.count(F.lit(1)).alias("types"), F.count_if(F.col("type") != "state_change").alias("meaningful"))


def timeline_stats(spark: SparkSession, d: str) -> DataFrame:
    base = _frames(spark, d).groupBy("video_id", "obj_id").agg(F.count(F.lit(1)).alias("total"), F.count_if("visible").alias("visible_frames"))
    e = E.touching(_events(spark, d)).groupBy("video_id", "obj_id").agg(F.count(F.lit(1)).alias("n_events"), F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"))
    return base.join(e, ["video_id", "obj_id"], "left").select("video_id", "obj_id", "total", "visible_frames", F.coalesce("n_events", F.lit(0)).alias("n_events"), "types")


def _counts(e: DataFrame) -> DataFrame:
    return e.groupBy("video_id").pivot("type", V.EVENT_TYPES).count().na.fill(0)


def video_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Five independent rules, each adding its reason; quality score from event counts."""
    docs, e = _docs(spark, d), _events(spark, d)
    objs = E.touching(e).groupBy("video_id").agg(F.countDistinct("obj_id").alias("involved"))
    one = docs.select("video_id", F.size("objects").alias("n_objects"), F.col("metadata.duration").alias("duration")).join(_counts(e), "video_id", "left").join(objs, "video_id", "left").na.fill(0)
    c = F.col
    occluded, reentered = (c("full_occlusion") > 0) & (c("reappear") > 0), (c("exit_frame") > 0) & ((c("enter_frame") > 0) | (c("reappear") > 0))
    meaningful = sum((c(t) for t in V.EVENT_TYPES if t != "state_change"), F.lit(0))
    score = sum((c(t) * w for t, w in V.QUALITY.items()), c("n_objects")) + F.when(occluded, 10).otherwise(0) + F.when(reentered, 5).otherwise(0)
    rules = [
        (c("n_objects") < V.MIN_OBJECTS, "too_few_objects"),
        (meaningful < V.MIN_EVENTS, "too_few_meaningful_events"),
        (~(occluded | reentered | (c("partial_occlusion") > 0)) & (c("interaction") < V.MIN_INTERACTIONS), "no_occlusion_events_and_few_interactions"),
        (c("duration") < V.MIN_SECONDS, "too_short"),
        (c("duration") > V.MAX_SECONDS, "too_long"),
        (c("involved") < 2, "events_involve_few_objects"),
    ]
    reasons = F.filter(F.array(*(F.when(r, n) for r, n in rules)), lambda x: x.isNotNull())
    return one.select("video_id", F.array_join(reasons, ",").alias("reasons"), (F.size(reasons) == 0).alias("passed"), score.cast("long").alias("score"))


def reason_histogram(spark: SparkSession, d: str) -> DataFrame:
    v = video_verdict(spark, d).where("reasons <> ''")
    return v.select(F.explode(F.split("reasons", ",")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def pass_rate_by_source(spark: SparkSession, d: str) -> DataFrame:
    return video_verdict(spark, d).join(_docs(spark, d).select("video_id", "source"), "video_id").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("passed"), F.round(100 * F.avg(F.col("passed").cast("int")), 1).alias("rate"))


def phenomenon_profile(spark: SparkSession, d: str) -> DataFrame:
    """Twelve flags a video: which kinds of question its events, pairs and objects can carry."""
    e = _events(spark, d)
    c = F.col
    per = E.own(e).groupBy("video_id", "obj_id", "type").agg(F.count(F.lit(1)).alias("n"))
    chain = per.where("type <> 'state_change'").groupBy("video_id", "obj_id").agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("m"))
    chain = chain.groupBy("video_id").agg(F.max("k").alias("k"))
    most = per.groupBy("video_id").agg(F.max("n").alias("m"))
    twins = identity_candidates(spark, d, e).groupBy("video_id").agg(F.count(F.lit(1)).alias("twins"))
    base = R.objects(_docs(spark, d)).select("video_id", "obj_id", label_parts(F.col("label"))["base"].alias("base"))
    seen = pair_covisibility(spark, d).where("ratio >= 0.3").join(base.withColumnRenamed("obj_id", "obj_a").withColumnRenamed("base", "base_a"), ["video_id", "obj_a"]).join(base.withColumnRenamed("obj_id", "obj_b").withColumnRenamed("base", "base_b"), ["video_id", "obj_b"])
    pairs = seen.where("base_a <> '' and base_b <> '' and base_a <> base_b").groupBy("video_id").agg(F.count(F.lit(1)).alias("pairs"))
    sure = confident_objects(spark, d).groupBy("video_id").agg(F.count(F.lit(1)).alias("sure"))
    w = _counts(e)
    for x in (chain, most, twins, pairs, sure):
        w = w.join(x, "video_id", "left")
    w = w.na.fill(0)
    kinds = sum(((c(t) > 0).cast("int") for t in V.EVENT_TYPES if t != "state_change"), F.lit(0))
    flags = {
        "occlusion_reappear": (c("full_occlusion") > 0) & (c("reappear") > 0), "partial_occlusion": c("partial_occlusion") > 0, "exit_reenter": (c("exit_frame") > 0) & ((c("enter_frame") > 0) | (c("reappear") > 0)),
        "appear_disappear": (c("appear") > 0) | (c("disappear") > 0), "state_change": c("state_change") > 0, "interaction": c("interaction") > 0, "multi_phenomenon": kinds >= 3, "has_reappear_identity_candidate": c("twins") > 0,
        "has_conditional_state_pair": c("pairs") > 0, "has_countable_event": c("m") >= 2, "has_cross_event_chain": c("k") >= 3, "has_high_confidence_objects": c("sure") >= 2,
    }
    return w.select("video_id", *(v.alias(k) for k, v in flags.items()))


def percentile_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Score thresholds at the positions int(n * 0.30) and int(n * 0.75) of the ordered scores, and videos by tier."""
    v = _cut(video_verdict(spark, d).select("video_id", "score"))
    n = v.agg(F.count(F.lit(1)).alias("n"))
    ranked = ordinal(v, [F.col("score"), F.col("video_id")], "r")
    cut = ranked.join(F.broadcast(n)).agg(F.max(F.when(F.col("r") == F.floor(F.col("n") * 0.30), F.col("score"))).alias("p30"), F.max(F.when(F.col("r") == F.floor(F.col("n") * 0.75), F.col("score"))).alias("p75"))
    tier = F.when(F.col("score") <= F.col("p30"), "easy").when(F.col("score") < F.col("p75"), "medium").otherwise("hard")
    return v.join(F.broadcast(cut)).withColumn("tier", tier).groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"), F.max("score").alias("high"))


def confidence_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Buckets closed below and open above; a confidence of exactly 1 falls in none."""
    c = instance_confidence(spark, d).where("confidence < 1")
    b = F.when(F.col("confidence") < 0.3, "[0,.3)").when(F.col("confidence") < 0.5, "[.3,.5)").when(F.col("confidence") < 0.7, "[.5,.7)").when(F.col("confidence") < 0.9, "[.7,.9)").otherwise("[.9,1)")
    return c.groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (
    event_counts, rolling_baseline, frame_state_runs, detected_events, occlusion_events, state_change_cooldown, pair_covisibility, pair_interactions, occluder_candidates, cross_event_pairs, asof_prev_event,
    identity_candidates, visible_range, swap_detection, instance_confidence, repaired_tracks, repair_totals, short_fragments, mergeable_pairs, event_counts_map, timeline_stats, video_verdict, reason_histogram, pass_rate_by_source, phenomenon_profile, percentile_tiers, confidence_histogram,
)}

_LABEL = r"""trim(regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '#[0-9]+$', ''), '^\s*(the |a |an )', ''), '\s+(on|in|at|near|beside|next to|by|of|from|behind|in front of|above|below|under|over)\s+the\s+\w+$', ''))"""
_VISIBLE = "WITH " + T.FRAMES
_SWAPS = """, ok AS (SELECT video_id, obj_id, frame, width, height, (x1 + x2) / 2.0 AS cx, (y1 + y2) / 2.0 AS cy FROM frames WHERE visible AND x2 > x1 AND y2 > y1),
    swaps AS (SELECT * FROM (SELECT *, lag(frame) OVER w AS before, sqrt(pow(cx - lag(cx) OVER w, 2) + pow(cy - lag(cy) OVER w, 2)) AS jump FROM ok WINDOW w AS (PARTITION BY video_id, obj_id ORDER BY frame))
        WHERE frame - before <= 3 AND jump > 0.35 * sqrt(pow(width, 2) + pow(height, 2)))"""
_CONFIDENCE = _VISIBLE + _SWAPS + """, conf AS (SELECT f.video_id, f.obj_id, coalesce(s.n, 0) AS swaps, f.mean, f.ratio, f.mean * greatest(0, 1 - 0.25 * coalesce(s.n, 0)) * CASE WHEN f.ratio < 0.3 THEN 0.8 ELSE 1 END AS confidence
    FROM (SELECT video_id, obj_id, coalesce(avg(CASE WHEN visible THEN coalesce(confidence, 0) END), 0) AS mean, count(*) FILTER (visible) / greatest(1, any_value(n_video))::DOUBLE AS ratio FROM frames GROUP BY ALL) f
    LEFT JOIN (SELECT video_id, obj_id, count(*) AS n FROM swaps GROUP BY ALL) s ON s.video_id = f.video_id AND s.obj_id = f.obj_id)"""
_ASOF = T.EVENTS + """, own AS (SELECT * FROM events_of WHERE other IS NULL),
    prev AS (SELECT r.video_id, r.obj_id, r.event_id, r.frame, arg_max(h.type, (h.e, h.event_id)) AS cause, arg_max(h.s, (h.e, h.event_id)) AS hs, max(h.e) AS he
        FROM own r JOIN own h ON h.video_id = r.video_id AND h.obj_id = r.obj_id AND h.type IN ('full_occlusion', 'exit_frame') AND h.e <= r.frame WHERE r.type = 'reappear' GROUP BY ALL)"""
_COUNTS = ", ".join(f"count(*) FILTER (type = '{t}') AS {t}" for t in V.EVENT_TYPES)
_VERDICT = T.TOUCHING + f""", counts AS (SELECT video_id, {_COUNTS} FROM events_of GROUP BY 1), involved AS (SELECT video_id, count(DISTINCT obj_id) AS involved FROM touching GROUP BY 1),
    joined AS (SELECT d.video_id, d.source, len(d.objects) AS n_objects, coalesce(d.metadata.duration, 0) AS duration, {", ".join(f"coalesce({t}, 0) AS {t}" for t in V.EVENT_TYPES)}, coalesce(involved, 0) AS involved
        FROM docs d LEFT JOIN counts c ON c.video_id = d.video_id LEFT JOIN involved i ON i.video_id = d.video_id),
    verdict AS (SELECT video_id, source, array_to_string(list_filter([
        CASE WHEN n_objects < 2 THEN 'too_few_objects' END,
        CASE WHEN appear + enter_frame + exit_frame + partial_occlusion + full_occlusion + reappear + disappear + interaction < 3 THEN 'too_few_meaningful_events' END,
        CASE WHEN NOT (full_occlusion > 0 AND reappear > 0) AND NOT (exit_frame > 0 AND (enter_frame > 0 OR reappear > 0)) AND partial_occlusion = 0 AND interaction < 2 THEN 'no_occlusion_events_and_few_interactions' END,
        CASE WHEN duration < 5 THEN 'too_short' END, CASE WHEN duration > 90 THEN 'too_long' END, CASE WHEN involved < 2 THEN 'events_involve_few_objects' END], lambda x: x IS NOT NULL), ',') AS reasons,
        full_occlusion * 5 + reappear * 5 + partial_occlusion * 3 + exit_frame * 3 + enter_frame * 3 + appear * 2 + disappear * 2 + state_change + interaction * 3 + n_objects
        + CASE WHEN full_occlusion > 0 AND reappear > 0 THEN 10 ELSE 0 END + CASE WHEN exit_frame > 0 AND (enter_frame > 0 OR reappear > 0) THEN 5 ELSE 0 END AS score FROM joined)"""
SQL = {
    "event_counts": T.EVENTS + "SELECT type, count(*) AS n, sum(first_frame)::BIGINT AS frames FROM events_of GROUP BY type",
    "rolling_baseline": "WITH " + T.STATES + "SELECT video_id, obj_id, frame, area, baseline, state FROM states",
    "frame_state_runs": "WITH " + T.RUNS + "SELECT video_id, obj_id, state, s AS start_frame, e AS end_frame, n FROM runs",
    "detected_events": T.EVENTS + "SELECT video_id, event_id, type, obj_id, other, frame, s AS start_frame, e AS end_frame, temporal_position, after_event, round(detail, 6) AS detail FROM events_of",
    "occlusion_events": T.EVENTS + "SELECT video_id, obj_id, type, s AS start_frame, e AS end_frame, e - s + 1 AS duration_frames FROM events_of WHERE type IN ('partial_occlusion', 'full_occlusion', 'exit_frame')",
    "state_change_cooldown": T.EVENTS + "SELECT video_id, obj_id, frame, round(detail, 6) AS ratio FROM events_of WHERE type = 'state_change'",
    "pair_covisibility": _VISIBLE + """SELECT a.video_id, a.obj_id AS obj_a, b.obj_id AS obj_b, count(*) AS n, min(a.frame) AS first_frame, max(a.frame) AS last_frame, round(count(*) / greatest(1, any_value(a.n_video))::DOUBLE, 6) AS ratio
        FROM frames a JOIN frames b ON a.video_id = b.video_id AND a.frame = b.frame AND a.track_ord < b.track_ord WHERE a.visible AND b.visible GROUP BY 1, 2, 3 HAVING count(*) >= 3""",
    "pair_interactions": T.EVENTS + "SELECT video_id, obj_id AS obj_a, other AS obj_b, s AS start_frame, e AS end_frame, round(detail, 6) AS mean_iou FROM events_of WHERE other IS NOT NULL",
    "occluder_candidates": T.EVENTS + """, full_occ AS (SELECT video_id, obj_id, s AS gone FROM events_of WHERE type = 'full_occlusion'),
        refs AS (SELECT g.video_id, g.obj_id, g.gone, arg_max(f.x1, f.frame) AS x1, arg_max(f.y1, f.frame) AS y1, arg_max(f.x2, f.frame) AS x2, arg_max(f.y2, f.frame) AS y2
            FROM full_occ g JOIN frames f ON f.video_id = g.video_id AND f.obj_id = g.obj_id AND f.visible AND f.frame < g.gone GROUP BY ALL),
        hits AS (SELECT r.video_id, r.obj_id, r.gone, o.obj_id AS occluder, o.frame, greatest(0, least(r.x2, o.x2) - greatest(r.x1, o.x1)) * greatest(0, least(r.y2, o.y2) - greatest(r.y1, o.y1)) AS inter,
            greatest(0, r.x2 - r.x1) * greatest(0, r.y2 - r.y1) + greatest(0, o.x2 - o.x1) * greatest(0, o.y2 - o.y1) AS areas
            FROM refs r JOIN frames o ON o.video_id = r.video_id AND o.obj_id <> r.obj_id AND o.visible AND o.frame BETWEEN r.gone - 2 AND r.gone + 2),
        firsts AS (SELECT video_id, obj_id, gone, occluder, round(arg_min(inter / (areas - inter)::DOUBLE, frame), 6) AS iou FROM hits WHERE areas > inter AND inter / (areas - inter)::DOUBLE > 0.1 GROUP BY ALL)
        SELECT video_id, obj_id, gone AS start_frame, occluder, iou, row_number() OVER (PARTITION BY video_id, obj_id, gone ORDER BY iou DESC, occluder) AS rank FROM firsts""",
    "cross_event_pairs": T.EVENTS + """SELECT a.video_id, a.obj_id, a.event_id AS event_id_a, b.event_id AS event_id_b, a.type AS type_a, b.type AS type_b FROM events_of a JOIN events_of b
        ON a.video_id = b.video_id AND a.obj_id = b.obj_id AND a.event_id < b.event_id WHERE a.other IS NULL AND b.other IS NULL AND a.type <> 'state_change' AND b.type <> 'state_change' AND a.type <> b.type AND b.first_frame - a.first_frame >= 2""",
    "asof_prev_event": _ASOF + "SELECT video_id, obj_id, event_id, cause, hs AS start_frame, he AS end_frame FROM prev",
    "identity_candidates": _ASOF + f""", parts AS (SELECT video_id, o.obj_id AS obj_id, {_LABEL.format("o.label")} AS p FROM objs),
        names AS (SELECT video_id, obj_id, regexp_extract(p, '(\\S+)$', 1) AS base, trim(regexp_replace(p, '\\S+$', '')) AS mods FROM parts),
        pairs AS (SELECT h.*, s.obj_id AS sib FROM prev h JOIN names t ON t.video_id = h.video_id AND t.obj_id = h.obj_id JOIN names s ON s.video_id = t.video_id AND s.base = t.base AND s.obj_id <> t.obj_id AND s.mods <> t.mods WHERE t.base <> '' AND h.he - h.hs >= 3),
        during AS (SELECT p.video_id, p.obj_id, p.event_id, p.frame, p.sib, p.hs, p.he, avg(f.visible::INT) AS covis FROM pairs p JOIN frames f ON f.video_id = p.video_id AND f.obj_id = p.sib AND f.frame BETWEEN p.hs AND p.he GROUP BY ALL),
        far AS (SELECT d.*, sqrt(pow((t.x1 + t.x2 - s.x1 - s.x2) / 2.0, 2) + pow((t.y1 + t.y2 - s.y1 - s.y2) / 2.0, 2)) / sqrt(pow(t.width, 2) + pow(t.height, 2)) AS distance
            FROM during d JOIN frames t ON t.video_id = d.video_id AND t.obj_id = d.obj_id AND t.frame = d.frame JOIN frames s ON s.video_id = d.video_id AND s.obj_id = d.sib AND s.frame = d.frame
            WHERE d.covis >= 0.5 AND t.x2 > t.x1 AND t.y2 > t.y1 AND s.x2 > s.x1 AND s.y2 > s.y1)
        SELECT video_id, obj_id, sib AS sibling, event_id, round((he - hs) / 3.0, 6) AS hidden_s, round(covis, 6) AS covisibility, round(distance, 6) AS distance FROM far WHERE distance >= 0.1""",
    "visible_range": _VISIBLE + """SELECT video_id, obj_id, min(frame) FILTER (visible) AS first_frame, max(frame) FILTER (visible) AS last_frame, count(*) FILTER (visible) AS visible_frames,
        arg_min((x1 + x2) / 2.0, frame) FILTER (visible) AS first_x, arg_max((y1 + y2) / 2.0, frame) FILTER (visible) AS last_y FROM frames GROUP BY ALL""",
    "swap_detection": _VISIBLE + _SWAPS + "SELECT video_id, obj_id, before AS frame_before, frame AS frame_after, round(jump, 6) AS jump_px FROM swaps",
    "instance_confidence": _CONFIDENCE + "SELECT video_id, obj_id, swaps, round(mean, 6) AS mean_confidence, round(ratio, 6) AS visible_ratio, round(confidence, 6) AS confidence FROM conf",
    "short_fragments": _VISIBLE + "SELECT video_id, obj_id, count(*) FILTER (visible) AS visible_frames, count(*) FILTER (visible) >= greatest(5, floor(any_value(n_video) * 0.02)) AS kept FROM frames GROUP BY ALL",
    "mergeable_pairs": _VISIBLE + """, ends AS (SELECT video_id, obj_id, label, any_value(width) AS w, any_value(height) AS h, min(frame) AS f0, max(frame) AS f1, arg_min((x1 + x2) / 2.0, frame) AS xf, arg_min((y1 + y2) / 2.0, frame) AS yf,
        arg_max((x1 + x2) / 2.0, frame) AS xl, arg_max((y1 + y2) / 2.0, frame) AS yl FROM frames WHERE visible GROUP BY ALL)
        SELECT a.video_id, a.obj_id AS obj_a, b.obj_id AS obj_b, b.f0 - a.f1 AS gap, round(sqrt(pow(a.xl - b.xf, 2) + pow(a.yl - b.yf, 2)), 6) AS jump_px FROM ends a JOIN ends b ON a.video_id = b.video_id AND a.label = b.label AND a.obj_id <> b.obj_id
        WHERE a.f1 < b.f0 AND b.f0 - a.f1 <= 6 AND sqrt(pow(a.xl - b.xf, 2) + pow(a.yl - b.yf, 2)) <= 0.15 * sqrt(pow(a.w, 2) + pow(a.h, 2))""",
    "event_counts_map": T.EVENTS + "SELECT video_id, string_agg(type || '=' || n, ',' ORDER BY type || '=' || n) AS counts, count(*) AS types, count(*) FILTER (type <> 'state_change') AS meaningful FROM (SELECT video_id, type, count(*) AS n FROM events_of GROUP BY ALL) GROUP BY video_id",
    "timeline_stats": T.TOUCHING + """SELECT f.video_id, f.obj_id, f.total, f.visible_frames, coalesce(e.n, 0) AS n_events, e.types FROM (SELECT video_id, obj_id, count(*) AS total, count(*) FILTER (visible) AS visible_frames FROM frames GROUP BY ALL) f
        LEFT JOIN (SELECT video_id, obj_id, count(*) AS n, string_agg(DISTINCT type, ',' ORDER BY type) AS types FROM touching GROUP BY ALL) e ON e.video_id = f.video_id AND e.obj_id = f.obj_id""",
    "video_verdict": _VERDICT + "SELECT video_id, reasons, reasons = '' AS passed, score FROM verdict",
    "reason_histogram": _VERDICT + "SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(reasons, ',')) AS reason FROM verdict WHERE reasons <> '') GROUP BY reason",
    "pass_rate_by_source": _VERDICT + "SELECT source, count(*) AS n, count(*) FILTER (reasons = '') AS passed, round(100 * avg((reasons = '')::INT), 1) AS rate FROM verdict GROUP BY source",
    "percentile_tiers": _VERDICT + """, ranked AS (SELECT score, row_number() OVER (ORDER BY score, video_id) - 1 AS r, count(*) OVER () AS n FROM verdict),
        cuts AS (SELECT max(score) FILTER (r = floor(n * 0.30)) AS p30, max(score) FILTER (r = floor(n * 0.75)) AS p75 FROM ranked)
        SELECT CASE WHEN score <= p30 THEN 'easy' WHEN score < p75 THEN 'medium' ELSE 'hard' END AS tier, count(*) AS n, min(score) AS low, max(score) AS high FROM verdict, cuts GROUP BY 1""",
    "confidence_histogram": _CONFIDENCE + "SELECT CASE WHEN c < 0.3 THEN '[0,.3)' WHEN c < 0.5 THEN '[.3,.5)' WHEN c < 0.7 THEN '[.5,.7)' WHEN c < 0.9 THEN '[.7,.9)' ELSE '[.9,1)' END AS bucket, count(*) AS n FROM (SELECT round(confidence, 6) AS c FROM conf) WHERE c < 1 GROUP BY 1",
}
_PROFILE = f"""counts AS (SELECT video_id, {_COUNTS} FROM events_of GROUP BY 1), per AS (SELECT video_id, obj_id, type, count(*) AS n FROM events_of WHERE other IS NULL GROUP BY ALL),
        chain AS (SELECT video_id, max(k) AS k FROM (SELECT video_id, obj_id, count(*) AS k FROM per WHERE type <> 'state_change' GROUP BY ALL) GROUP BY 1), most AS (SELECT video_id, max(n) AS m FROM per GROUP BY 1)"""
_BASES = f"bases AS (SELECT video_id, o.obj_id AS obj_id, regexp_extract({_LABEL.format('o.label')}, '(\\S+)$', 1) AS base FROM objs)"
SQL["phenomenon_profile"] = (
    "WITH twins AS (SELECT video_id, count(*) AS twins FROM (" + SQL["identity_candidates"] + ") GROUP BY 1), seen AS (" + SQL["pair_covisibility"] + "), sure AS (SELECT video_id, count(*) AS sure FROM (" + SQL["instance_confidence"] + ") WHERE round(confidence, 4) >= 0.7 GROUP BY 1), "
    + "profile AS (" + T.EVENTS + ", " + _PROFILE + """ SELECT c.*, coalesce(m, 0) AS m, coalesce(k, 0) AS k FROM counts c LEFT JOIN chain USING (video_id) LEFT JOIN most USING (video_id)), named AS (WITH """ + T.OBJECTS + ", " + _BASES + """ SELECT * FROM bases),
    pairs AS (SELECT s.video_id, count(*) AS pairs FROM seen s JOIN named a ON a.video_id = s.video_id AND a.obj_id = s.obj_a JOIN named b ON b.video_id = s.video_id AND b.obj_id = s.obj_b WHERE s.ratio >= 0.3 AND a.base <> '' AND b.base <> '' AND a.base <> b.base GROUP BY 1)
    SELECT video_id, full_occlusion > 0 AND reappear > 0 AS occlusion_reappear, partial_occlusion > 0 AS partial_occlusion, exit_frame > 0 AND (enter_frame > 0 OR reappear > 0) AS exit_reenter, appear > 0 OR disappear > 0 AS appear_disappear, state_change > 0 AS state_change, interaction > 0 AS interaction,
        (appear > 0)::INT + (enter_frame > 0)::INT + (exit_frame > 0)::INT + (partial_occlusion > 0)::INT + (full_occlusion > 0)::INT + (reappear > 0)::INT + (disappear > 0)::INT + (interaction > 0)::INT >= 3 AS multi_phenomenon,
        coalesce(twins, 0) > 0 AS has_reappear_identity_candidate, coalesce(pairs, 0) > 0 AS has_conditional_state_pair, m >= 2 AS has_countable_event, k >= 3 AS has_cross_event_chain, coalesce(sure, 0) >= 2 AS has_high_confidence_objects
    FROM profile LEFT JOIN twins USING (video_id) LEFT JOIN pairs USING (video_id) LEFT JOIN sure USING (video_id)"""
)
_REPAIRED = "WITH RECURSIVE " + T.FRAMES + """, counted AS (SELECT video_id, obj_id, any_value(label) AS label, any_value(width) AS w, any_value(height) AS h, any_value(n_video) AS n_video, count(*) FILTER (visible) AS v FROM frames GROUP BY 1, 2),
    left_over AS (SELECT * FROM counted WHERE v >= greatest(5, floor(n_video * 0.02))),
    ends AS (SELECT f.video_id, f.obj_id, min(frame) AS f0, max(frame) AS f1, arg_min((x1 + x2) / 2.0, frame) AS xf, arg_min((y1 + y2) / 2.0, frame) AS yf, arg_max((x1 + x2) / 2.0, frame) AS xl, arg_max((y1 + y2) / 2.0, frame) AS yl FROM frames f JOIN left_over USING (video_id, obj_id) WHERE visible GROUP BY 1, 2),
    pairs AS (SELECT a.video_id, a.obj_id AS a, b.obj_id AS b, row_number() OVER (PARTITION BY a.video_id ORDER BY sqrt(pow(a.xl - b.xf, 2) + pow(a.yl - b.yf, 2)), a.obj_id, b.obj_id) AS r
        FROM ends a JOIN left_over la ON la.video_id = a.video_id AND la.obj_id = a.obj_id JOIN ends b ON b.video_id = a.video_id AND b.obj_id <> a.obj_id JOIN left_over lb ON lb.video_id = b.video_id AND lb.obj_id = b.obj_id AND lb.label = la.label
        WHERE a.f1 < b.f0 AND b.f0 - a.f1 <= 6 AND sqrt(pow(a.xl - b.xf, 2) + pow(a.yl - b.yf, 2)) <= 0.15 * sqrt(pow(la.w, 2) + pow(la.h, 2))),
    walk AS (SELECT DISTINCT video_id, 0::BIGINT AS r, []::INT[] AS gone, []::INT[] AS into_ FROM pairs
        UNION ALL SELECT w.video_id, p.r, CASE WHEN list_contains(gone, p.a) OR list_contains(gone, p.b) THEN gone ELSE list_append(gone, p.b) END, CASE WHEN list_contains(gone, p.a) OR list_contains(gone, p.b) THEN into_ ELSE list_append(into_, p.a) END FROM walk w JOIN pairs p ON p.video_id = w.video_id AND p.r = w.r + 1),
    steps AS (SELECT video_id, unnest(gone) AS absorbed, unnest(into_) AS kept FROM walk QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY r DESC) = 1),
    roots AS (SELECT video_id, obj_id, obj_id AS root FROM left_over WHERE NOT EXISTS (SELECT 1 FROM steps s WHERE s.video_id = left_over.video_id AND s.absorbed = left_over.obj_id)
        UNION ALL SELECT s.video_id, s.absorbed, r.root FROM roots r JOIN steps s ON s.video_id = r.video_id AND s.kept = r.obj_id),
    filled AS (SELECT f.video_id, r.root AS obj_id, f.frame, f.width, f.height, f.n_video, f.visible, f.confidence, f.x1, f.y1, f.x2, f.y2 FROM frames f JOIN roots r ON r.video_id = f.video_id AND r.obj_id = f.obj_id QUALIFY row_number() OVER (PARTITION BY f.video_id, r.root, f.frame ORDER BY NOT f.visible, f.obj_id <> r.root, f.obj_id) = 1),
    ok AS (SELECT video_id, obj_id, frame, width, height, (x1 + x2) / 2.0 AS cx, (y1 + y2) / 2.0 AS cy FROM filled WHERE visible AND x2 > x1 AND y2 > y1),
    swaps AS (SELECT video_id, obj_id, count(*) AS n FROM (SELECT *, lag(frame) OVER w AS before, sqrt(pow(cx - lag(cx) OVER w, 2) + pow(cy - lag(cy) OVER w, 2)) AS jump FROM ok WINDOW w AS (PARTITION BY video_id, obj_id ORDER BY frame)) WHERE frame - before <= 3 AND jump > 0.35 * sqrt(pow(width, 2) + pow(height, 2)) GROUP BY 1, 2),
    merges AS (SELECT video_id, kept, count(*) AS n FROM steps GROUP BY 1, 2),
    rated AS (SELECT f.video_id, f.obj_id, f.v AS visible_frames, coalesce(m.n, 0) AS merges, coalesce(s.n, 0) AS swaps, f.mean * greatest(0, 1 - 0.15 * coalesce(m.n, 0)) * greatest(0, 1 - 0.25 * coalesce(s.n, 0)) * CASE WHEN f.ratio < 0.3 THEN 0.8 ELSE 1 END AS confidence
        FROM (SELECT video_id, obj_id, count(*) FILTER (visible) AS v, coalesce(avg(CASE WHEN visible THEN coalesce(confidence, 0) END), 0) AS mean, count(*) FILTER (visible) / greatest(1, any_value(n_video))::DOUBLE AS ratio FROM filled GROUP BY 1, 2) f
        LEFT JOIN merges m ON m.video_id = f.video_id AND m.kept = f.obj_id LEFT JOIN swaps s ON s.video_id = f.video_id AND s.obj_id = f.obj_id)"""
SQL["repaired_tracks"] = _REPAIRED + "SELECT video_id, obj_id, visible_frames, merges, swaps, round(round(confidence, 8), 4) AS confidence, round(round(confidence, 8), 4) >= 0.7 AS confident FROM rated"
SQL["repair_totals"] = _REPAIRED + """, r AS (SELECT *, round(round(confidence, 8), 4) AS c FROM rated) SELECT (SELECT count(*) FROM objs) AS tracks, count(*) AS kept, sum(merges)::BIGINT AS merges, sum(swaps)::BIGINT AS swaps, count(*) FILTER (c >= 0.7) AS confident,
    round(min(c), 6) AS least, round(avg(c), 6) AS mean, round(max(c), 6) AS most, quantile_disc(c, 0.5) AS median, round(count(*) FILTER (c >= 0.7) / count(*)::DOUBLE, 6) AS share FROM r"""
