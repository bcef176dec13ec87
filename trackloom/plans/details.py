"""Details of events and objects, and the reports over videos, items and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom import vocab as V
from trackloom.functions.labels import label_parts
from trackloom.functions.modifiers import MODIFIERS, holds
from trackloom.operators import answers as O
from trackloom.operators import events as E
from trackloom.operators import frames as R
from trackloom.operators.selection import DENSITIES, DURATIONS
from trackloom.plans import sqltext as T
from trackloom.plans import units as U
from trackloom.plans.events import _docs, _events, _frames, phenomenon_profile, video_verdict
from trackloom.plans.events import SQL as _EVENT_SQL
from trackloom.plans.items import _hash, _items, _key_of, _scored
from trackloom.plans.items_sql import _ANSWER, ITEMS, SCORED
from trackloom.plans.selected import SLOTS
from trackloom.tables import load

# fixed values: sources with the number of videos wanted; items wanted of each dimension; chance of a guess by format; most objects and least visible share of a tracked video; frames a second looked at, and most frames
TARGETS = {"charades": 400, "ovis": 200, "mose": 200, "perception_test": 150, "star": 150}
CHANCE = {"mcq_4": 0.25, "sp": 0.5, "numerical": 0.25, "ordering_3": 1 / 6, "ordering_4": 1 / 24}
MOST_OBJECTS, LEAST_VISIBLE, LOOK_FPS, MOST_FRAMES = 20, 0.1, 6, 300
#: Items of each dimension in the verified subset, and of the sample by format.
VERIFIED, SAMPLE = 20, 100


def _class(value: Column, table: list[tuple[str, float | None, float]]) -> Column:
    return R.bucket(value, [(name, high) for name, high, _ in table])


def event_details(spark: SparkSession, d: str) -> DataFrame:
    """Of every event of an object: where its first box lies, how long it lasts (frames, both ends counted) and its times in seconds."""
    e = E.own(_events(spark, d)).select("video_id", "event_id", "obj_id", "type", "frame", "start", "end", F.col("at").alias("first"))
    f = _frames(spark, d).select("video_id", "obj_id", F.col("frame").alias("first"), "x1", "y1", "x2", "y2", "width", "height")
    times = _docs(spark, d).select("video_id", "timestamps")
    j = e.join(f, ["video_id", "obj_id", "first"], "left").join(times, "video_id")
    at = lambda c: F.round(F.get("timestamps", F.col(c)), 3)
    n = F.col("end") - F.col("start") + 1
    return j.select("video_id", "event_id", "type", R.place(*(F.col(c) for c in ("x1", "y1", "x2", "y2", "width", "height"))).alias("place"), n.alias("frames"), F.when(n.isNotNull(), R.bucket(n / V.FPS, V.DURATION_BUCKETS)).alias("duration"), at("frame").alias("at_s"), at("start").alias("start_s"), at("end").alias("end_s"))


def bucket_classifiers(spark: SparkSession, d: str) -> DataFrame:
    """Duration and density class of each video."""
    n = F.size("objects")
    return _docs(spark, d).select("video_id", _class(F.coalesce("metadata.duration", F.lit(0.0)), DURATIONS).alias("duration_class"), n.alias("n_objects"), _class(n, DENSITIES).alias("density_class"))


def timeline_details(spark: SparkSession, d: str) -> DataFrame:
    """Of each object: visible share, first and last visible frame, its events in order, counts by type (without interactions) and types that occur once."""
    v = F.col("visible")
    base = _frames(spark, d).groupBy("video_id", "obj_id").agg(F.round(F.count_if(v) / F.greatest(F.lit(1), F.count(F.lit(1))), 3).alias("ratio"), F.min(F.when(v, F.col("frame"))).alias("first_frame"), F.max(F.when(v, F.col("frame"))).alias("last_frame"))
    e = E.touching(_events(spark, d))
    listed = e.groupBy("video_id", "obj_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "type"))), lambda x: x["type"]), ",").alias("events"))
    per = e.where("type <> 'interaction'").groupBy("video_id", "obj_id", "type").agg(F.count(F.lit(1)).alias("n"))
    counts = per.groupBy("video_id", "obj_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "type", "n"))), ",").alias("counts"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("n") == 1, F.col("type")))), ",").alias("single"))
    return base.join(listed, ["video_id", "obj_id"], "left").join(counts, ["video_id", "obj_id"], "left")


def first_last_box(spark: SparkSession, d: str) -> DataFrame:
    v, box = F.when(F.col("visible"), F.col("frame")), F.struct(((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"))
    g = _frames(spark, d).where("visible").groupBy("video_id", "obj_id").agg(F.min_by(box, v).alias("a"), F.max_by(box, v).alias("b"))
    return g.select("video_id", "obj_id", F.col("a.x").alias("first_x"), F.col("a.y").alias("first_y"), F.col("b.x").alias("last_x"), F.col("b.y").alias("last_y"))


def label_flags(spark: SparkSession, d: str) -> DataFrame:
    """Which kinds of modifier a label holds."""
    o = R.objects(_docs(spark, d))
    return o.select("video_id", "obj_id", *(holds(F.col("label"), k).alias(k) for k in MODIFIERS))


def duplicate_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels, without their numbers, that several objects of a video share."""
    o = R.objects(_docs(spark, d)).select("video_id", "obj_id", F.regexp_replace("label", r"\s*#[0-9]+$", "").alias("bare"))
    return o.where("bare is not null").groupBy("video_id", "bare").agg(F.count(F.lit(1)).alias("n"), F.min("obj_id").alias("first_obj")).where("n >= 2")


def trackable_objects(spark: SparkSession, d: str) -> DataFrame:
    """The first objects of each video that are visible in more than a tenth of its frames."""
    seen = _frames(spark, d).groupBy("video_id", "track_ord", "obj_id").agg(F.count_if("visible").alias("v"), F.first("n_video").alias("n"))
    kept = seen.where(F.col("v") / F.greatest(F.lit(1), F.col("n")) > LEAST_VISIBLE)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("video_id").orderBy("track_ord"))).where(F.col("place") <= MOST_OBJECTS).select("video_id", "obj_id", "place")


def frame_stride(spark: SparkSession, d: str) -> DataFrame:
    """Frames of the original video that are looked at: every stride-th, thinned evenly to the most allowed."""
    m = _docs(spark, d).select("video_id", F.col("metadata.original_fps").alias("fps"), F.col("metadata.total_frames").alias("total")).where("total > 0 and fps > 0")
    m = m.withColumn("stride", F.greatest(F.lit(1), F.floor(F.col("fps") / LOOK_FPS).cast("int"))).withColumn("n", F.ceil(F.col("total") / F.col("stride")).cast("int")).withColumn("k", F.least("n", F.lit(MOST_FRAMES)))
    i = m.select("video_id", "stride", "n", "k", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("i"))
    return i.select("video_id", "i", (F.when(F.col("k") == F.col("n"), F.col("i")).otherwise(F.floor(F.col("i") * (F.col("n") - 1) / (F.col("k") - 1)).cast("int")) * F.col("stride")).alias("frame"))


def source_status(spark: SparkSession, d: str) -> DataFrame:
    """Videos of each source against the number wanted: ok from a half up."""
    r = load(spark, d, "video_registry").where("path is not null").groupBy("source").agg(F.countDistinct("path").alias("n"))
    want = spark.createDataFrame(list(TARGETS.items()), "source string, target int")
    j = want.join(r, "source", "left").na.fill(0, ["n"])
    return j.select("source", "target", "n", F.when(F.col("n") >= 0.5 * F.col("target"), "ok").when(F.col("n") > 0, "partial").otherwise("missing").alias("status"))


def pool_analysis(spark: SparkSession, d: str) -> DataFrame:
    """Passed videos that can fill each slot, against the number wanted."""
    p = phenomenon_profile(spark, d).join(video_verdict(spark, d).where("passed").select("video_id"), "video_id", "left_semi")
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("slot"), F.lit(n).alias("target"), F.col(k).alias("has")) for k, (n, _) in SLOTS.items()))).alias("s")
    n = p.select(each).groupBy("s.slot", "s.target").agg(F.count_if("s.has").alias("available"))
    return n.withColumn("status", F.when(F.col("available") >= F.col("target"), "OK").when(F.col("available") >= 0.8 * F.col("target"), "TIGHT").otherwise("LOW"))


def modifier_pool(spark: SparkSession, d: str) -> DataFrame:
    """Modifiers of each noun over all videos."""
    o = R.objects(_docs(spark, d)).select("video_id", label_parts(F.col("label")).alias("p")).where("p.base <> ''")
    return o.groupBy(F.col("p.base").alias("base")).agg(F.countDistinct("video_id").alias("videos"), F.array_join(F.array_sort(F.collect_set(F.nullif(F.col("p.modifiers"), F.lit("")))), ",").alias("modifiers"))


def _split(spark: SparkSession, d: str) -> DataFrame:
    """qa_id, dim, tier, format, video_id, verified: the first of each dimension by hash are verified, the rest is large."""
    i = _items(spark, d).select("qa_id", F.coalesce("dim", F.lit("unknown")).alias("dim"), "tier", "format", "video_id")
    quota = i.select(F.col("dim").alias("g")).distinct().withColumn("quota", F.lit(VERIFIED))
    return O.smallest(i, ["dim"], _hash("42", "qa_id"), quota, ["g"]).withColumn("verified", F.col("place").isNotNull()).drop("g", "place")


def verified_split(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d).select("qa_id", F.when(F.col("verified"), "verified").otherwise("large").alias("subset"))


def sampling_report(spark: SparkSession, d: str) -> DataFrame:
    """Both subsets by dimension, tier and format, with the videos of each."""
    each = F.explode(F.array(*(F.struct(F.lit(g).alias("grouping"), F.coalesce(g, F.lit("unknown")).alias("value")) for g in ("dim", "tier", "format")))).alias("g")
    s = _split(spark, d).select("verified", "video_id", each)
    return s.groupBy("g.grouping", "g.value").agg(F.count(F.lit(1)).alias("available"), F.count_if("verified").alias("verified"), F.count_if(~F.col("verified")).alias("large"), F.countDistinct(F.when(F.col("verified"), F.col("video_id"))).alias("verified_videos"))


def video_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Videos of both subsets, and of each alone."""
    v = _split(spark, d).where("video_id is not null").groupBy("video_id").agg(F.max(F.col("verified").cast("int")).alias("v"), F.max((~F.col("verified")).cast("int")).alias("l"))
    return v.groupBy(F.when((F.col("v") == 1) & (F.col("l") == 1), "both").when(F.col("v") == 1, "verified").otherwise("large").alias("videos")).agg(F.count(F.lit(1)).alias("n"))


def format_sample(spark: SparkSession, d: str) -> DataFrame:
    """A sample in proportion to formats, at least one of each (halves are rounded to even)."""
    i = _items(spark, d).select("qa_id", F.coalesce("format", F.lit("mcq_4")).alias("format"))
    c = i.groupBy(F.col("format").alias("g")).agg(F.count(F.lit(1)).alias("n"))
    whole = c.agg(F.sum("n").alias("whole"))
    quota = c.join(F.broadcast(whole)).select("g", F.least("n", F.greatest(F.lit(1), F.bround(F.lit(float(SAMPLE)) * F.col("n") / F.col("whole"), 0).cast("bigint"))).alias("quota"))
    return O.smallest(i, ["format"], _hash("13", "qa_id"), quota, ["g"]).where("place is not null").select("qa_id", "format")


def answer_baselines(spark: SparkSession, d: str) -> DataFrame:
    """What guessing scores by format: a letter by hash, always A, the most common answer; and chance."""
    i = _items(spark, d).where("format in ('mcq_4', 'sp') and correct_answer is not null").select("qa_id", "format", _key_of().alias("answer"))
    c = i.groupBy("format", "answer").agg(F.count(F.lit(1)).alias("n"), F.min("qa_id").alias("first")).groupBy("format").agg(F.max("n").alias("most"))
    guess = F.char(65 + F.conv(F.substring(_hash("6", "qa_id"), 1, 4), 16, 10).cast("int") % F.when(F.col("format") == "sp", 2).otherwise(4))
    g = i.groupBy("format").agg(F.count(F.lit(1)).alias("n"), F.count_if(guess == F.col("answer")).alias("random"), F.count_if(F.col("answer") == "A").alias("always_a"))
    return g.join(c, "format").select("format", "n", "random", "always_a", F.col("most").alias("frequency"), F.when(F.col("format") == "sp", CHANCE["sp"]).otherwise(CHANCE["mcq_4"]).alias("chance"))


def model_report(spark: SparkSession, d: str) -> DataFrame:
    """One line a model, best first: accuracy in percent, overall and by tier."""
    s = _scored(spark, d).withColumn("c", F.col("correct").cast("int"))
    pct = lambda c: F.when(c.isNotNull(), F.format_string("%.1f", F.round(100 * c, 1))).otherwise("--")
    return s.groupBy("model").agg(F.count(F.lit(1)).alias("n"), pct(F.avg("c")).alias("overall"), *(pct(F.avg(F.when(F.col("tier") == t, F.col("c")))).alias(t) for t in V.TIER_WEIGHTS))


def selection_report(spark: SparkSession, d: str) -> DataFrame:
    """Passed videos by duration class, density class and source, with the lowest, upper median and highest score."""
    v = video_verdict(spark, d).where("passed").join(bucket_classifiers(spark, d), "video_id").join(_docs(spark, d).select("video_id", "source"), "video_id")
    each = F.explode(F.array(*(F.struct(F.lit(g).alias("grouping"), F.coalesce(c, F.lit("unknown")).alias("value")) for g, c in (("duration", "duration_class"), ("density", "density_class"), ("source", "source"))))).alias("g")
    return v.select("score", each).groupBy("g.grouping", "g.value").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"), F.max("score").alias("high"))


def quality_order(spark: SparkSession, d: str) -> DataFrame:
    """Passed videos by falling score, numbered over the whole table; ties by identifier."""
    from trackloom.operators.ranking import ordinal

    return ordinal(video_verdict(spark, d).where("passed").select("video_id", "score"), [F.desc("score"), F.col("video_id")], "place")


def orders_kept(spark: SparkSession, d: str) -> DataFrame:
    """Orders that are usable, or whose item is on a list of exceptions (here those verified by hand)."""
    k, o = F.regexp_extract("format", r"([0-9]+)$", 1).cast("int"), F.col("correct_order")
    good = F.coalesce((F.size(o) == k) & (F.size(F.array_distinct(o)) == F.size(o)) & F.forall(o, lambda x: x.isin("A", "B", "C", "D")), F.lit(False))
    i = _items(spark, d).where("format like 'ordering%'")
    return i.select("qa_id", F.when(good, "kept").when(F.col("realization_method") == "manual", "excepted").otherwise("dropped").alias("state"))


#: What tells an object from others of its label, best first: condition, confidence, words ({b}: the label). o_* are of the others; Spark and DuckDB read them alike.
REF_EXPRS = [
    ("h <> 'center' and o_same_h = 0", 0.90, "'the ' || {b} || ' on the ' || h"),
    ("cx_spread >= width * 0.05 and is_left", 0.88, "'the leftmost ' || {b}"),
    ("cx_spread >= width * 0.05 and is_right", 0.88, "'the rightmost ' || {b}"),
    ("reappears and not o_reappears", 0.87, "'the ' || {b} || ' that reappears after being hidden'"),
    ("occluded and not o_occluded", 0.86, "'the ' || {b} || ' that gets occluded'"),
    ("o_min_first - first_frame >= 3", 0.85, "'the ' || {b} || ' that appears first'"),
    ("exits and not o_exits", 0.85, "'the ' || {b} || ' that exits the frame'"),
    ("enters and not o_enters", 0.84, "'the ' || {b} || ' that enters the frame'"),
    ("first_frame - o_max_first >= 3", 0.83, "'the ' || {b} || ' that appears later'"),
    ("area > 0 and area > o_max_area * 1.5", 0.82, "'the larger ' || {b}"),
    ("area > 0 and area < o_min_area * 0.67", 0.82, "'the smaller ' || {b}"),
    ("first_frame is not null and o_same_h = 0", 0.80, "'the ' || {b} || ' on the ' || h"),
    ("first_frame < o_min_first_h", 0.75, "'the ' || {b} || ' on the ' || h || ' that appears first'"),
]
_EXPR = "CASE " + " ".join(f"WHEN {c} THEN {w.replace('{b}', 'bare')}" for c, _, w in REF_EXPRS) + " ELSE label END"
_SURE = "CASE " + " ".join(f"WHEN {c} THEN {k}" for c, k, _ in REF_EXPRS) + " ELSE 0.0 END"
REF_GATE = 0.5


def _ref_exprs(spark: SparkSession, d: str) -> DataFrame:
    """video_id, obj_id, expr, confidence of every object: unique labels have .95, of those that several objects share the best of REF_EXPRS, 0 if none holds."""
    f = U.ref_expr_features(spark, d).select("video_id", "obj_id", "cx", "area", F.col("column").alias("h"))
    first = _frames(spark, d).groupBy("video_id", "obj_id").agg(F.min(F.when(F.col("visible"), F.col("frame"))).alias("first_frame"), F.first("width").alias("width"))
    has = lambda t: F.coalesce(F.max(F.col("type") == t), F.lit(False))
    kinds = E.touching(_events(spark, d)).groupBy("video_id", "obj_id").agg(has("reappear").alias("reappears"), has("full_occlusion").alias("occluded"), has("exit_frame").alias("exits"), has("enter_frame").alias("enters"))
    o = R.objects(_docs(spark, d)).select("video_id", "obj_id", "label", F.regexp_replace("label", r"\s*#[0-9]+$", "").alias("bare")).where("bare is not null")
    flags = ["reappears", "occluded", "exits", "enters"]
    a = o.join(first, ["video_id", "obj_id"], "left").join(f, ["video_id", "obj_id"], "left").join(kinds, ["video_id", "obj_id"], "left").na.fill(False, flags).withColumn("area", F.coalesce("area", F.lit(0)))
    # a label is shared by few objects of a video
    b = a.select("video_id", "bare", F.col("obj_id").alias("other"), *(F.col(c).alias(f"b_{c}") for c in ("h", "cx", "area", "first_frame", *flags)))
    same = F.col("b_h") == F.col("h")
    left = (F.col("b_cx") < F.col("cx")) | ((F.col("b_cx") == F.col("cx")) & (F.col("other") < F.col("obj_id")))
    right = (F.col("b_cx") > F.col("cx")) | ((F.col("b_cx") == F.col("cx")) & (F.col("other") > F.col("obj_id")))
    others = a.join(b, ["video_id", "bare"]).where("other <> obj_id").groupBy("video_id", "obj_id").agg(
        F.count_if(same).alias("o_same_h"), F.max("b_area").alias("o_max_area"), F.min("b_area").alias("o_min_area"), F.min("b_first_frame").alias("o_min_first"), F.max("b_first_frame").alias("o_max_first"), F.min(F.when(same, F.col("b_first_frame"))).alias("o_min_first_h"),
        F.greatest(F.max(F.col("b_cx")), F.first("cx")).alias("hi"), F.least(F.min("b_cx"), F.first("cx")).alias("lo"), (F.count_if(left) == 0).alias("no_left"), (F.count_if(right) == 0).alias("no_right"), *(F.max(f"b_{c}").alias(f"o_{c}") for c in flags),
    )
    j = a.join(others, ["video_id", "obj_id"], "left").withColumns({"cx_spread": F.col("hi") - F.col("lo"), "is_left": F.col("no_left") & F.col("cx").isNotNull(), "is_right": F.col("no_right") & F.col("cx").isNotNull()})
    alone = F.col("o_same_h").isNull()
    return j.select("video_id", "obj_id", F.when(alone, F.concat(F.lit("the "), F.col("bare"))).otherwise(F.expr(_EXPR)).alias("expr"), F.when(alone, 0.95).otherwise(F.expr(_SURE).cast("double")).alias("confidence"))


def referring_expressions(spark: SparkSession, d: str) -> DataFrame:
    return _ref_exprs(spark, d)


def ref_gated_units(spark: SparkSession, d: str) -> DataFrame:
    """Existence units whose subject can be told from the others, under the name that tells it; objects without a label keep none."""
    u = U.unit_existence(spark, d).join(_ref_exprs(spark, d), ["video_id", "obj_id"], "left")
    return u.where(F.coalesce(F.col("confidence") >= REF_GATE, F.lit(True))).select("video_id", "obj_id", "event_type", "polarity", F.col("expr").alias("subject"))


QUERIES = {f.__name__: f for f in (referring_expressions, ref_gated_units, event_details, bucket_classifiers, timeline_details, first_last_box, label_flags, duplicate_labels, trackable_objects, frame_stride, source_status, pool_analysis, modifier_pool, verified_split, sampling_report, video_overlap, format_sample, answer_baselines, model_report, selection_report, quality_order, orders_kept)}


def _cases(value: str, table: list[tuple[str, float | None, float]]) -> str:
    return "CASE " + " ".join(f"WHEN {value} < {high} THEN '{name}'" for name, high, _ in table[:-1]) + f" ELSE '{table[-1][0]}' END"


_PLACE = """CASE WHEN width <= 0 OR height <= 0 THEN 'center' WHEN y = 'middle' THEN x WHEN x = 'center' THEN y ELSE y || '-' || x END"""
_DURATION = _cases("coalesce(metadata.duration, 0)", DURATIONS)
_DENSITY = _cases("len(objects)", DENSITIES)
_SPLIT = f"WITH {ITEMS}, split AS (SELECT qa_id, coalesce(dim, 'unknown') AS dim, tier, format, video_id, row_number() OVER (PARTITION BY coalesce(dim, 'unknown') ORDER BY md5('42:' || qa_id)) <= {VERIFIED} AS verified FROM items)"
_OF = "lower(trim(coalesce(o.label, '')))"
SQL = {
    "event_details": T.EVENTS + f""", e AS (SELECT v.*, f.x1, f.y1, f.x2, f.y2, f.width, f.height, d.timestamps FROM events_of v JOIN docs d ON d.video_id = v.video_id LEFT JOIN frames f ON f.video_id = v.video_id AND f.obj_id = v.obj_id AND f.frame = v.first_frame WHERE v.other IS NULL),
        p AS (SELECT *, CASE WHEN (x1 + x2) / 2.0 < width * 0.33 THEN 'left' WHEN (x1 + x2) / 2.0 > width * 0.67 THEN 'right' ELSE 'center' END AS x, CASE WHEN (y1 + y2) / 2.0 < height * 0.33 THEN 'upper' WHEN (y1 + y2) / 2.0 > height * 0.67 THEN 'lower' ELSE 'middle' END AS y, e - s + 1 AS n FROM e)
        SELECT video_id, event_id, type, {_PLACE} AS place, n AS frames, CASE WHEN n / 3.0 < 0.5 THEN 'very briefly' WHEN n / 3.0 < 2 THEN 'briefly' WHEN n / 3.0 < 5 THEN 'for several seconds' WHEN n IS NOT NULL THEN 'for an extended period' END AS duration, round(timestamps[frame + 1], 3) AS at_s, round(timestamps[s + 1], 3) AS start_s, round(timestamps[e + 1], 3) AS end_s FROM p""",
    "bucket_classifiers": f"WITH {T.DOCS} SELECT video_id, {_DURATION} AS duration_class, len(objects)::INT AS n_objects, {_DENSITY} AS density_class FROM docs",
    "timeline_details": T.TOUCHING + """, per AS (SELECT video_id, obj_id, type, count(*) AS n FROM touching WHERE type <> 'interaction' GROUP BY ALL), c AS (SELECT video_id, obj_id, string_agg(type || '=' || n, ',' ORDER BY type || '=' || n) AS counts, coalesce(string_agg(type, ',' ORDER BY type) FILTER (n = 1), '') AS single FROM per GROUP BY 1, 2),
        l AS (SELECT video_id, obj_id, string_agg(type, ',' ORDER BY event_id, type) AS events FROM touching GROUP BY 1, 2), b AS (SELECT video_id, obj_id, round(count(*) FILTER (visible) / greatest(1, count(*))::DOUBLE, 3) AS ratio, min(frame) FILTER (visible) AS first_frame, max(frame) FILTER (visible) AS last_frame FROM frames GROUP BY 1, 2)
        SELECT b.*, l.events, c.counts, c.single FROM b LEFT JOIN l USING (video_id, obj_id) LEFT JOIN c USING (video_id, obj_id)""",
    "first_last_box": "WITH " + T.FRAMES + " SELECT video_id, obj_id, arg_min((x1 + x2) / 2.0, frame) AS first_x, arg_min((y1 + y2) / 2.0, frame) AS first_y, arg_max((x1 + x2) / 2.0, frame) AS last_x, arg_max((y1 + y2) / 2.0, frame) AS last_y FROM frames WHERE visible GROUP BY 1, 2",
    "label_flags": "WITH " + T.OBJECTS + " SELECT video_id, o.obj_id AS obj_id, " + ", ".join("(" + " OR ".join(f"contains({_OF}, '{m}')" for m in words) + f") AS {k}" for k, words in MODIFIERS.items()) + " FROM objs",
    "duplicate_labels": "WITH " + T.OBJECTS + r" SELECT video_id, regexp_replace(o.label, '\s*#[0-9]+$', '') AS bare, count(*) AS n, min(o.obj_id) AS first_obj FROM objs WHERE o.label IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2",
    "trackable_objects": "WITH " + T.FRAMES + f" SELECT video_id, obj_id, row_number() OVER (PARTITION BY video_id ORDER BY track_ord) AS place FROM (SELECT video_id, track_ord, obj_id, count(*) FILTER (visible) AS v, any_value(n_video) AS n FROM frames GROUP BY 1, 2, 3) WHERE v / greatest(1, n)::DOUBLE > 0.1 QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY track_ord) <= {MOST_OBJECTS}",
    "frame_stride": f"""WITH {T.DOCS}, m AS (SELECT video_id, metadata.total_frames AS total, greatest(1, floor(metadata.original_fps / {LOOK_FPS})::INT) AS stride FROM docs WHERE metadata.total_frames > 0 AND metadata.original_fps > 0), n AS (SELECT *, ceil(total / stride::DOUBLE)::INT AS n, least(ceil(total / stride::DOUBLE)::INT, {MOST_FRAMES}) AS k FROM m),
        i AS (SELECT *, unnest(range(0, k)) AS i FROM n) SELECT video_id, i::INT AS i, (CASE WHEN k = n THEN i ELSE (i * (n - 1)) // (k - 1) END * stride)::INT AS frame FROM i""",
    "source_status": "WITH want(source, target) AS (VALUES " + ", ".join(f"('{k}', {v})" for k, v in TARGETS.items()) + "), r AS (SELECT source, count(DISTINCT path) AS n FROM video_registry WHERE path IS NOT NULL GROUP BY 1) SELECT source, target, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) >= 0.5 * target THEN 'ok' WHEN n > 0 THEN 'partial' ELSE 'missing' END AS status FROM want LEFT JOIN r USING (source)",
    "pool_analysis": "WITH profile_of AS (" + _EVENT_SQL["phenomenon_profile"] + "), verdict_of AS (" + _EVENT_SQL["video_verdict"] + "), p AS (SELECT * FROM profile_of WHERE video_id IN (SELECT video_id FROM verdict_of WHERE passed)), n AS (" + " UNION ALL ".join(f"SELECT '{k}' AS slot, {n} AS target, count(*) FILTER ({k}) AS available FROM p" for k, (n, _) in SLOTS.items()) + ") SELECT *, CASE WHEN available >= target THEN 'OK' WHEN available >= 0.8 * target THEN 'TIGHT' ELSE 'LOW' END AS status FROM n",
    "modifier_pool": "WITH " + T.OBJECTS + ", " + U._PARTS + r" SELECT base, count(DISTINCT video_id) AS videos, coalesce(string_agg(DISTINCT nullif(mods, ''), ',' ORDER BY nullif(mods, '')), '') AS modifiers FROM (SELECT video_id, CASE WHEN core <> '' THEN regexp_extract(core, '(\S+)$', 1) ELSE bare END AS base, trim(regexp_replace(core, '\S+$', '')) AS mods FROM cored) WHERE base <> '' GROUP BY 1",
    "verified_split": _SPLIT + " SELECT qa_id, CASE WHEN verified THEN 'verified' ELSE 'large' END AS subset FROM split",
    "sampling_report": _SPLIT + " " + " UNION ALL ".join(f"SELECT '{g}' AS grouping, coalesce({g}, 'unknown') AS value, count(*) AS available, count(*) FILTER (verified) AS verified, count(*) FILTER (NOT verified) AS large, count(DISTINCT video_id) FILTER (verified) AS verified_videos FROM split GROUP BY 2" for g in ("dim", "tier", "format")),
    "video_overlap": _SPLIT + ", v AS (SELECT video_id, bool_or(verified) AS v, bool_or(NOT verified) AS l FROM split WHERE video_id IS NOT NULL GROUP BY 1) SELECT CASE WHEN v AND l THEN 'both' WHEN v THEN 'verified' ELSE 'large' END AS videos, count(*) AS n FROM v GROUP BY 1",
    "format_sample": f"WITH {ITEMS}, f AS (SELECT qa_id, coalesce(format, 'mcq_4') AS format FROM items), q AS (SELECT format, least(count(*), greatest(1, round_even({SAMPLE}.0 * count(*) / (SELECT count(*) FROM f), 0)::BIGINT)) AS quota FROM f GROUP BY 1) SELECT qa_id, f.format FROM f JOIN q USING (format) QUALIFY row_number() OVER (PARTITION BY f.format ORDER BY md5('13:' || qa_id)) <= any_value(quota) OVER (PARTITION BY f.format)",
    "answer_baselines": f"""WITH {ITEMS}, i AS (SELECT qa_id, format, {_ANSWER} AS answer FROM items WHERE format IN ('mcq_4', 'sp') AND correct_answer IS NOT NULL), c AS (SELECT format, max(n) AS most FROM (SELECT format, answer, count(*) AS n FROM i GROUP BY 1, 2) GROUP BY 1)
        SELECT format, count(*) AS n, count(*) FILTER (answer = chr((65 + ('0x' || substr(md5('6:' || qa_id), 1, 4))::INT % CASE WHEN format = 'sp' THEN 2 ELSE 4 END)::INT)) AS random, count(*) FILTER (answer = 'A') AS always_a, any_value(most) AS frequency, CASE WHEN format = 'sp' THEN 0.5 ELSE 0.25 END::DOUBLE AS chance FROM i JOIN c USING (format) GROUP BY format""",
    "model_report": SCORED + " SELECT model, count(*) AS n, " + ", ".join(f"coalesce(printf('%.1f', round(100 * avg(correct::INT){f}, 1)), '--') AS {n}" for n, f in (("overall", ""), *((t, f" FILTER (tier = '{t}')") for t in V.TIER_WEIGHTS))) + " FROM scored GROUP BY model",
    "selection_report": "WITH verdict_of AS (" + _EVENT_SQL["video_verdict"] + f"), classes AS (WITH {T.DOCS} SELECT video_id, {_DURATION} AS duration, {_DENSITY} AS density, coalesce(source, 'unknown') AS source FROM docs), v AS (SELECT * FROM verdict_of JOIN classes USING (video_id) WHERE passed) " + " UNION ALL ".join(f"SELECT '{g}' AS grouping, {g} AS value, count(*) AS n, min(score) AS low, max(score) AS high FROM v GROUP BY 2" for g in ("duration", "density", "source")),
    "quality_order": "WITH verdict_of AS (" + _EVENT_SQL["video_verdict"] + ") SELECT video_id, score, row_number() OVER (ORDER BY score DESC, video_id) - 1 AS place FROM verdict_of WHERE passed",
    "orders_kept": f"""WITH {ITEMS} SELECT qa_id, CASE WHEN coalesce(len(correct_order) = regexp_extract(format, '([0-9]+)$', 1)::INT AND len(list_distinct(correct_order)) = len(correct_order) AND len(list_filter(correct_order, lambda x: x NOT IN ('A', 'B', 'C', 'D'))) = 0, false) THEN 'kept' WHEN realization_method = 'manual' THEN 'excepted' ELSE 'dropped' END AS state FROM items WHERE format LIKE 'ordering%'""",
}
_REFS = f"""feat AS ({U.SQL["ref_expr_features"]}), base AS ({T.TOUCHING}, k AS (SELECT video_id, obj_id, bool_or(type = 'reappear') AS reappears, bool_or(type = 'full_occlusion') AS occluded, bool_or(type = 'exit_frame') AS exits, bool_or(type = 'enter_frame') AS enters FROM touching GROUP BY 1, 2),
        v AS (SELECT video_id, obj_id, min(frame) FILTER (visible) AS first_frame, any_value(width) AS width FROM frames GROUP BY 1, 2)
        SELECT o.video_id, o.o.obj_id AS obj_id, o.o.label AS label, regexp_replace(o.o.label, '\\s*#[0-9]+$', '') AS bare, v.first_frame, v.width, coalesce(reappears, false) AS reappears, coalesce(occluded, false) AS occluded, coalesce(exits, false) AS exits, coalesce(enters, false) AS enters
        FROM objs o LEFT JOIN v ON v.video_id = o.video_id AND v.obj_id = o.o.obj_id LEFT JOIN k ON k.video_id = o.video_id AND k.obj_id = o.o.obj_id WHERE o.o.label IS NOT NULL),
    a AS (SELECT b.*, f.cx, f."column" AS h, coalesce(f.area, 0) AS area FROM base b LEFT JOIN feat f USING (video_id, obj_id)),
    n AS (SELECT x.video_id, x.obj_id, count(*) FILTER (y.h = x.h) AS o_same_h, max(y.area) AS o_max_area, min(y.area) AS o_min_area, min(y.first_frame) AS o_min_first, max(y.first_frame) AS o_max_first, min(y.first_frame) FILTER (y.h = x.h) AS o_min_first_h, greatest(max(y.cx), any_value(x.cx)) - least(min(y.cx), any_value(x.cx)) AS cx_spread,
        count(*) FILTER (y.cx < x.cx OR (y.cx = x.cx AND y.obj_id < x.obj_id)) = 0 AS no_left, count(*) FILTER (y.cx > x.cx OR (y.cx = x.cx AND y.obj_id > x.obj_id)) = 0 AS no_right, bool_or(y.reappears) AS o_reappears, bool_or(y.occluded) AS o_occluded, bool_or(y.exits) AS o_exits, bool_or(y.enters) AS o_enters
        FROM a x JOIN a y ON y.video_id = x.video_id AND y.bare = x.bare AND y.obj_id <> x.obj_id GROUP BY 1, 2),
    j AS (SELECT a.*, n.* EXCLUDE (video_id, obj_id), no_left AND cx IS NOT NULL AS is_left, no_right AND cx IS NOT NULL AS is_right FROM a LEFT JOIN n USING (video_id, obj_id)),
    refs AS (SELECT video_id, obj_id, CASE WHEN o_same_h IS NULL THEN 'the ' || bare ELSE {_EXPR} END AS expr, CASE WHEN o_same_h IS NULL THEN 0.95 ELSE {_SURE} END::DOUBLE AS confidence FROM j)"""
SQL["referring_expressions"] = "WITH " + _REFS + " SELECT video_id, obj_id, expr, confidence FROM refs"
SQL["ref_gated_units"] = "WITH " + _REFS + ", u AS (" + U.SQL["unit_existence"] + ") SELECT u.video_id, u.obj_id, event_type, polarity, expr AS subject FROM u LEFT JOIN refs USING (video_id, obj_id) WHERE coalesce(confidence >= 0.5, true)"
