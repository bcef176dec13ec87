"""Question units drawn from events, one query a dimension; and a few operators on whole videos."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom import vocab as V
from trackloom.functions.labels import label_parts
from trackloom.functions.modifiers import holds
from trackloom.operators import events as E
from trackloom.operators import frames as R
from trackloom.plans.events import _docs, _events, _frames, _last_hidden, confident_objects, identity_candidates, occluder_candidates
from trackloom.plans import sqltext as T
from trackloom.plans.events import _ASOF, SQL as _EVENT_SQL
from trackloom.tables import load

_OBJ = ["video_id", "obj_id"]


def _sure(df: DataFrame, spark: SparkSession, d: str, *names: str) -> DataFrame:
    """df where the objects in the named columns are tracked with confidence."""
    for n in names or ("obj_id",):
        df = df.join(confident_objects(spark, d).withColumnRenamed("obj_id", n), ["video_id", n], "left_semi")
    return df


def _own(spark: SparkSession, d: str, made: DataFrame | None = None) -> DataFrame:
    return E.own(_events(spark, d, made)).where("type <> 'state_change'")


def unit_temporal_location(spark: SparkSession, d: str, made: DataFrame | None = None) -> DataFrame:
    """An event type that occurs once, or first and last of two; more often it would be ambiguous."""
    e = _own(spark, d, made).where((F.col("n_video") > 1) & ~holds(F.col("label"), "temporal"))
    w = Window.partitionBy(*_OBJ, "type")
    e = e.withColumn("k", F.count(F.lit(1)).over(w)).withColumn("r", F.row_number().over(w.orderBy("mid", "event_id"))).where("k <= 2")
    prefix = F.when(F.col("k") == 2, F.when(F.col("r") == 1, "first").otherwise("last"))
    return e.select(*_OBJ, F.col("type").alias("event_type"), "event_id", prefix.alias("prefix"), F.col("temporal_position").alias("bucket"))


def unit_duration_category(spark: SparkSession, d: str, made: DataFrame | None = None) -> DataFrame:
    """Ranges of at least .3 s whose instances all fall in one bucket; the first is the anchor."""
    e = E.touching(_events(spark, d, made)).where("type in ('full_occlusion', 'partial_occlusion', 'exit_frame', 'interaction')")
    s = e.withColumn("s", (F.col("end") - F.col("start")) / V.FPS).where("s >= 0.3")
    b = s.withColumn("bucket", R.bucket(F.col("s"), V.DURATION_BUCKETS))
    g = b.groupBy(*_OBJ, F.col("type").alias("event_type")).agg(F.countDistinct("bucket").alias("k"), F.min("event_id").alias("event_id"), F.min_by("bucket", "event_id").alias("bucket"), F.round(F.min_by("s", "event_id"), 2).alias("seconds"))
    return g.where("k = 1").drop("k")


def unit_spatial_change(spark: SparkSession, d: str, made: DataFrame | None = None) -> DataFrame:
    """Where an object went between its first and last visible box, unless that is ambiguous."""
    v = F.when(F.col("visible"), F.col("frame"))
    f = _frames(spark, d).where(~holds(F.col("label"), "spatial"))
    box = F.struct("x1", "y1", "x2", "y2")
    g = f.groupBy(*_OBJ).agg(F.min_by(box, v).alias("a"), F.max_by(box, v).alias("b"), F.min(v).alias("f0"), F.max(v).alias("f1"), F.first("width").alias("w"), F.first("height").alias("h"))
    g = g.where("f0 <> f1 and a.x2 > a.x1 and b.x2 > b.x1")
    g = g.withColumn("dx", (F.col("b.x1") + F.col("b.x2") - F.col("a.x1") - F.col("a.x2")) / 2).withColumn("dy", (F.col("b.y1") + F.col("b.y2") - F.col("a.y1") - F.col("a.y2")) / 2)
    g = g.withColumn("ratio", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")) / F.sqrt(F.col("w") * F.col("w") + F.col("h") * F.col("h")))
    dx, dy = F.abs("dx"), F.abs("dy")
    answer = (
        F.when(F.col("ratio") < 0.10, "stays in roughly the same place").when(F.col("ratio") <= 0.20, None)
        .when(dx > dy * 1.5, F.when(F.col("dx") > 0, "moves from left to right").otherwise("moves from right to left"))
        .when(dy > dx * 1.5, F.when(F.col("dy") > 0, "moves from top to bottom").otherwise("moves from bottom to top"))
    )
    return g.select(*_OBJ, answer.alias("answer"), F.round("ratio", 6).alias("ratio")).where("answer is not null")


def unit_existence(spark: SparkSession, d: str, made: DataFrame | None = None) -> DataFrame:
    """Types an object has (yes), and the first by name that its video has and it lacks (no)."""
    e = _own(spark, d, made)
    yes = e.select(*_OBJ, F.col("type").alias("event_type")).distinct()
    of = yes.groupBy("video_id").agg(F.collect_set("event_type").alias("video_types"))
    objs = R.objects(_docs(spark, d)).select(*_OBJ)
    own = yes.groupBy(*_OBJ).agg(F.collect_set("event_type").alias("own"))
    no = objs.join(of, "video_id").join(own, _OBJ, "left").select(*_OBJ, F.array_min(F.array_except("video_types", F.coalesce("own", F.array().cast("array<string>")))).alias("event_type")).where("event_type is not null")
    return yes.withColumn("polarity", F.lit("yes")).unionByName(no.withColumn("polarity", F.lit("no")))


def unit_mechanism(spark: SparkSession, d: str, made: DataFrame | None = None) -> DataFrame:
    e = _events(spark, d, made)
    one = lambda df: df.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy(*_OBJ))).where("k = 1")
    how = F.when(F.col("cause") == "full_occlusion", "fully blocked").otherwise("left the frame")
    single = one(E.own(e).where("type = 'reappear'")).select(*_OBJ, "event_id")
    back = _last_hidden(e).join(single, [*_OBJ, "event_id"], "left_semi").select(*_OBJ, F.lit("reappear").alias("scenario"), "event_id", how.alias("mechanism"))
    gone = one(E.own(e).where("type = 'disappear'")).withColumnRenamed("after_event", "cause").select(*_OBJ, F.lit("disappear").alias("scenario"), "event_id", how.alias("mechanism"))
    return back.unionByName(gone)


def unit_count(spark: SparkSession, d: str, made: DataFrame | None = None) -> DataFrame:
    e = E.own(_events(spark, d, made)).where(F.col("type").isin("full_occlusion", "partial_occlusion", "reappear", "state_change") & ~holds(F.col("label"), "temporal", "count"))
    e = _sure(e, spark, d)
    g = e.groupBy(*_OBJ, F.col("type").alias("event_type")).agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return g.withColumn("answer", F.when(F.col("n") <= 4, F.col("n").cast("string")).otherwise("5 or more"))


def unit_ordering(spark: SparkSession, d: str, made: DataFrame | None = None) -> DataFrame:
    """The earliest events of at least three types, all at least .5 s apart; four of them where there are four."""
    e = _sure(_own(spark, d, made).where(~holds(F.col("label"), "temporal")), spark, d)
    first = e.groupBy(*_OBJ, "type").agg(F.min(F.struct("mid", "event_id")).alias("m")).select(*_OBJ, "type", "m.mid", "m.event_id")
    w = Window.partitionBy(*_OBJ)
    s = first.withColumn("r", F.row_number().over(w.orderBy("mid", "event_id"))).withColumn("gap", F.col("mid") - F.lag("mid").over(w.orderBy("mid", "event_id"))).withColumn("k", F.count(F.lit(1)).over(w)).withColumn("least", F.min("gap").over(w))
    g = s.where("k >= 3 and least >= 1 and r <= 4").groupBy(*_OBJ).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "type"))), lambda x: x["type"]), ",").alias("event_types"), F.count(F.lit(1)).alias("k"))
    return g


def unit_identity(spark: SparkSession, d: str, made: DataFrame | None = None) -> DataFrame:
    c = _sure(identity_candidates(spark, d, made), spark, d, "obj_id", "sibling")
    return c.select("video_id", "obj_id", "sibling", F.col("event_id").alias("reappear_event_id"), F.lit("the same one").alias("answer"))


def unit_occluder(spark: SparkSession, d: str, gap: float = V.OCCLUDER_GAP) -> DataFrame:
    """Best and second occluder of a full occlusion where the best leads by at least `gap` of overlap and neither label is numbered."""
    c = _sure(occluder_candidates(spark, d), spark, d)
    name = R.objects(_docs(spark, d)).select("video_id", F.col("obj_id").alias("occluder"), "label")
    top = c.where("rank <= 2").join(name, ["video_id", "occluder"])
    g = top.groupBy("video_id", "obj_id", "start_frame").agg(*(F.max(F.when(F.col("rank") == r, F.col(x))).alias(f"{x}_{r}") for r in (1, 2) for x in ("label", "iou")))
    return g.where((F.col("iou_1") - F.col("iou_2") >= gap) & ~F.col("label_1").rlike("#[0-9]+$") & ~F.col("label_2").rlike("#[0-9]+$")).select("video_id", "obj_id", "start_frame", F.col("label_1").alias("answer"), F.col("label_2").alias("distractor"))


def _names(spark: SparkSession, d: str) -> DataFrame:
    o = R.objects(_docs(spark, d)).select("video_id", "obj_id", "track_ord", "label", label_parts(F.col("label")).alias("p"))
    return o.select("video_id", "obj_id", "track_ord", "label", F.col("p.base").alias("base"))


def unit_conditional_state(spark: SparkSession, d: str, made: DataFrame | None = None) -> DataFrame:
    """State of another object (first in track order with another noun) at the anchor event of an object."""
    rank = F.expr("array_position(array('appear', 'reappear', 'disappear', 'exit_frame', 'enter_frame', 'full_occlusion'), type)")
    e = E.own(_events(spark, d, made)).withColumn("rank", rank).where("rank > 0")
    anchor = e.groupBy(*_OBJ).agg(F.min(F.struct(F.col("rank"), (-F.col("event_id")).alias("o"), F.col("mid"), F.col("type"))).alias("a")).select(*_OBJ, F.col("a.mid").alias("anchor_frame"), F.col("a.type").alias("anchor_type"))
    n = _names(spark, d)
    b = n.select("video_id", F.col("obj_id").alias("partner"), F.col("track_ord").alias("t"), F.col("base").alias("b"))
    f = _frames(spark, d)
    seen = F.when(F.col("visible") & (F.col("area") > 0), F.col("area"))
    w = R.by_frame()
    past = F.array_sort(F.collect_list(seen).over(w.rowsBetween(-V.BASELINE_WINDOW, -1)))
    base = F.get(past, F.floor(F.size(past) / 2).cast("int"))
    v = F.col("visible").cast("int")
    before, after = F.max(v).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.max(v).over(w.rowsBetween(0, Window.unboundedFollowing))
    state = F.when(~F.col("visible"), F.when((before == 1) & (after == 1), "fully hidden").otherwise("not yet appeared or already gone")).when((F.col("area") > 0) & (F.col("area") / base < V.PARTIAL_RATIO), "partly hidden").otherwise("fully visible")
    at = f.select("video_id", F.col("obj_id").alias("partner"), F.col("frame").alias("anchor_frame"), state.alias("answer"))
    pair = anchor.join(n, _OBJ).join(b, "video_id").where("partner <> obj_id and base <> b and b <> ''")
    pair = _sure(pair, spark, d, "obj_id", "partner").join(at, ["video_id", "partner", "anchor_frame"])
    one = pair.withColumn("r", F.row_number().over(Window.partitionBy(*_OBJ).orderBy("t"))).where("r = 1")
    return one.select(*_OBJ, "anchor_type", "anchor_frame", "partner", "answer")


def unit_cross_order(spark: SparkSession, d: str, made: DataFrame | None = None) -> DataFrame:
    """First pair of events, a second or more apart, of two objects with different nouns."""
    e = _sure(_own(spark, d, made).where(~holds(F.col("label"), "temporal")), spark, d).join(_names(spark, d).select("video_id", "obj_id", "base"), _OBJ)
    a, b = (e.select("video_id", *(F.col(c).alias(f"{k}_{c}") for c in ("obj_id", "base", "event_id", "mid"))) for k in "ab")
    p = a.join(b, "video_id").where(f"b_obj_id > a_obj_id and not (a_base <> '' and a_base = b_base) and abs(a_mid - b_mid) >= {V.FPS}")
    g = p.groupBy("video_id", F.col("a_obj_id").alias("obj_a"), F.col("b_obj_id").alias("obj_b")).agg(F.min(F.struct("a_event_id", "b_event_id", "a_mid", "b_mid")).alias("m"))
    return g.select("video_id", "obj_a", "obj_b", F.col("m.a_event_id").alias("event_a"), F.col("m.b_event_id").alias("event_b"), F.when(F.col("m.a_mid") < F.col("m.b_mid"), "a").otherwise("b").alias("first"))


def units_by_dim(spark: SparkSession, d: str) -> DataFrame:
    """Units of every dimension in one table, counted."""
    events = _events(spark, d)
    parts = [q(spark, d, events).select("video_id", F.lit(n).alias("dim")) for n, q in (("temporal_location", unit_temporal_location), ("duration_category", unit_duration_category), ("relative_spatial_change", unit_spatial_change), ("event_existence", unit_existence), ("reappear_or_disappear", unit_mechanism), ("event_count", unit_count), ("event_ordering", unit_ordering), ("reappear_identity", unit_identity), ("conditional_state", unit_conditional_state), ("cross_object_order", unit_cross_order))]
    return reduce(DataFrame.unionByName, parts).groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("video_id").alias("videos"))


def ref_expr_features(spark: SparkSession, d: str) -> DataFrame:
    """Upper median of centre and area over visible frames, and thirds of the picture, per object."""
    f = _frames(spark, d).where("visible")
    up = lambda c: F.get(F.array_sort(F.collect_list(c)), F.floor(F.count(F.lit(1)) / 2).cast("int"))
    g = f.groupBy(*_OBJ).agg(up((F.col("x1") + F.col("x2")) / 2).alias("cx"), up((F.col("y1") + F.col("y2")) / 2).alias("cy"), up("area").alias("area"), F.first("width").alias("w"), F.first("height").alias("h"))
    third = lambda c, s, a, b, m: F.when(c < s / 3, a).when(c > s * 2 / 3, b).otherwise(m)
    return g.select(*_OBJ, "cx", "cy", "area", third(F.col("cx"), F.col("w"), "left", "right", "center").alias("column"), third(F.col("cy"), F.col("h"), "top", "bottom", "middle").alias("row"))


QUERIES = {f.__name__: f for f in (unit_temporal_location, unit_duration_category, unit_spatial_change, unit_existence, unit_mechanism, unit_count, unit_ordering, unit_identity, unit_occluder, unit_conditional_state, unit_cross_order, units_by_dim, ref_expr_features)}

_HOLDS = {
    "temporal": "(" + " OR ".join(f"contains(lower(coalesce(label, '')), '{m}')" for m in ("first", "earlier", "later", "last", "appears first", "that comes back")) + ")",
    "spatial": "(" + " OR ".join(f"contains(lower(coalesce(label, '')), '{m}')" for m in ("leftmost", "rightmost", "upper", "lower", "top", "bottom", "left side", "right side", "on the left", "on the right")) + ")",
    "count": "(" + " OR ".join(f"contains(lower(coalesce(label, '')), '{m}')" for m in ("only", "single", "twice", "thrice", "multiple", "many")) + ")",
}
_PARTS = r"""parsed AS (SELECT video_id, track_ord, o.obj_id AS obj_id, o.label AS label, regexp_replace(trim(regexp_replace(lower(trim(coalesce(o.label, ''))), '#[0-9]+$', '')), '^(the |a |an )', '') AS bare FROM objs),
    cored AS (SELECT *, trim(regexp_replace(bare, '\s+(?:on|in|at|near|beside|next to|by|of|from|behind|in front of|above|below|under|over)\s+the\s+\w+$', '')) AS core FROM parsed),
    names AS (SELECT video_id, track_ord, obj_id, label, CASE WHEN core <> '' THEN regexp_extract(core, '(\S+)$', 1) ELSE bare END AS base FROM cored)"""
_SURE = "(SELECT video_id, obj_id FROM (" + _EVENT_SQL["instance_confidence"] + ") WHERE round(confidence, 4) >= 0.7)"
_OWN = ", mine AS (SELECT * FROM events_of WHERE other IS NULL AND type <> 'state_change')"
SQL = {
    "unit_temporal_location": T.EVENTS + _OWN + f""", k AS (SELECT *, count(*) OVER (PARTITION BY video_id, obj_id, type) AS k, row_number() OVER (PARTITION BY video_id, obj_id, type ORDER BY mid, event_id) AS r FROM mine WHERE n_video > 1 AND NOT {_HOLDS['temporal']})
        SELECT video_id, obj_id, type AS event_type, event_id, CASE WHEN k = 2 THEN CASE r WHEN 1 THEN 'first' ELSE 'last' END END AS prefix, temporal_position AS bucket FROM k WHERE k <= 2""",
    "unit_duration_category": T.TOUCHING + """, d AS (SELECT *, (e - s) / 3.0 AS sec FROM touching WHERE type IN ('full_occlusion', 'partial_occlusion', 'exit_frame', 'interaction') AND (e - s) / 3.0 >= 0.3),
        b AS (SELECT *, CASE WHEN sec < 0.5 THEN 'very briefly' WHEN sec < 2 THEN 'briefly' WHEN sec < 5 THEN 'for several seconds' ELSE 'for an extended period' END AS bucket FROM d)
        SELECT video_id, obj_id, type AS event_type, min(event_id) AS event_id, arg_min(bucket, event_id) AS bucket, round(arg_min(sec, event_id), 2)::DOUBLE AS seconds FROM b GROUP BY ALL HAVING count(DISTINCT bucket) = 1""".replace("GROUP BY ALL", "GROUP BY video_id, obj_id, type"),
    "unit_spatial_change": "WITH " + T.FRAMES + f""", g AS (SELECT video_id, obj_id, any_value(width) AS w, any_value(height) AS h, min(frame) AS f0, max(frame) AS f1, arg_min(x1, frame) AS ax1, arg_min(y1, frame) AS ay1, arg_min(x2, frame) AS ax2, arg_min(y2, frame) AS ay2,
        arg_max(x1, frame) AS bx1, arg_max(y1, frame) AS by1, arg_max(x2, frame) AS bx2, arg_max(y2, frame) AS by2 FROM frames WHERE visible AND NOT {_HOLDS['spatial']} GROUP BY video_id, obj_id),
        m AS (SELECT *, (bx1 + bx2 - ax1 - ax2) / 2.0 AS dx, (by1 + by2 - ay1 - ay2) / 2.0 AS dy FROM g WHERE f0 <> f1 AND ax2 > ax1 AND bx2 > bx1), r AS (SELECT *, sqrt(dx * dx + dy * dy) / sqrt(w * w + h * h) AS ratio FROM m),
        a AS (SELECT video_id, obj_id, ratio, CASE WHEN ratio < 0.1 THEN 'stays in roughly the same place' WHEN ratio <= 0.2 THEN NULL WHEN abs(dx) > abs(dy) * 1.5 THEN CASE WHEN dx > 0 THEN 'moves from left to right' ELSE 'moves from right to left' END
            WHEN abs(dy) > abs(dx) * 1.5 THEN CASE WHEN dy > 0 THEN 'moves from top to bottom' ELSE 'moves from bottom to top' END END AS answer FROM r)
        SELECT video_id, obj_id, answer, round(ratio, 6) AS ratio FROM a WHERE answer IS NOT NULL""",
    "unit_existence": T.EVENTS + _OWN + """, yes AS (SELECT DISTINCT video_id, obj_id, type FROM mine), no AS (SELECT o.video_id, o.o.obj_id AS obj_id, min(v.type) AS type FROM objs o JOIN (SELECT DISTINCT video_id, type FROM yes) v ON v.video_id = o.video_id
            WHERE NOT EXISTS (SELECT 1 FROM yes y WHERE y.video_id = o.video_id AND y.obj_id = o.o.obj_id AND y.type = v.type) GROUP BY ALL)
        SELECT video_id, obj_id, type AS event_type, 'yes' AS polarity FROM yes UNION ALL SELECT video_id, obj_id, type, 'no' FROM no""",
    "unit_mechanism": _ASOF + """, once AS (SELECT video_id, obj_id, type, min(event_id) AS event_id, any_value(after_event) AS cause FROM own WHERE type IN ('reappear', 'disappear') GROUP BY 1, 2, 3 HAVING count(*) = 1)
        SELECT p.video_id, p.obj_id, 'reappear' AS scenario, p.event_id, CASE p.cause WHEN 'full_occlusion' THEN 'fully blocked' ELSE 'left the frame' END AS mechanism FROM prev p JOIN once o ON o.video_id = p.video_id AND o.obj_id = p.obj_id AND o.event_id = p.event_id
        UNION ALL SELECT video_id, obj_id, type, event_id, CASE cause WHEN 'full_occlusion' THEN 'fully blocked' ELSE 'left the frame' END FROM once WHERE type = 'disappear'""",
    "unit_count": T.EVENTS + f"SELECT video_id, obj_id, type AS event_type, count(*) AS n, CASE WHEN count(*) <= 4 THEN count(*)::VARCHAR ELSE '5 or more' END AS answer FROM events_of WHERE other IS NULL AND type IN ('full_occlusion', 'partial_occlusion', 'reappear', 'state_change') AND NOT {_HOLDS['temporal']} AND NOT {_HOLDS['count']} AND (video_id, obj_id) IN {_SURE} GROUP BY 1, 2, 3 HAVING count(*) >= 2",
    "unit_ordering": T.EVENTS + _OWN + f""", f AS (SELECT video_id, obj_id, type, mid, event_id FROM mine WHERE NOT {_HOLDS['temporal']} AND (video_id, obj_id) IN {_SURE} QUALIFY row_number() OVER (PARTITION BY video_id, obj_id, type ORDER BY mid, event_id) = 1),
        r AS (SELECT *, row_number() OVER w AS r, mid - lag(mid) OVER w AS gap, count(*) OVER (PARTITION BY video_id, obj_id) AS k FROM f WINDOW w AS (PARTITION BY video_id, obj_id ORDER BY mid, event_id)), l AS (SELECT *, min(gap) OVER (PARTITION BY video_id, obj_id) AS least FROM r)
        SELECT video_id, obj_id, string_agg(type, ',' ORDER BY r) AS event_types, count(*) AS k FROM l WHERE k >= 3 AND least >= 1 AND r <= 4 GROUP BY 1, 2""",
    "unit_identity": "SELECT video_id, obj_id, sibling, event_id AS reappear_event_id, 'the same one' AS answer FROM (" + _EVENT_SQL["identity_candidates"] + ") WHERE (video_id, obj_id) IN " + _SURE + " AND (video_id, sibling) IN " + _SURE,
    "unit_occluder": "WITH " + T.OBJECTS + ", c AS (" + _EVENT_SQL["occluder_candidates"] + """), l AS (SELECT c.*, o.o.label AS label FROM c JOIN objs o ON o.video_id = c.video_id AND o.o.obj_id = c.occluder WHERE rank <= 2),
        g AS (SELECT video_id, obj_id, start_frame, max(label) FILTER (rank = 1) AS l1, max(label) FILTER (rank = 2) AS l2, max(iou) FILTER (rank = 1) AS i1, max(iou) FILTER (rank = 2) AS i2 FROM l GROUP BY 1, 2, 3)
        SELECT video_id, obj_id, start_frame, l1 AS answer, l2 AS distractor FROM g WHERE i1 - i2 >= 0.3 AND (video_id, obj_id) IN """ + _SURE + """ AND NOT regexp_matches(l1, '#[0-9]+$') AND NOT regexp_matches(l2, '#[0-9]+$')""",
    "unit_conditional_state": T.EVENTS + f""", {_PARTS}, ranked AS (SELECT *, list_position(['appear', 'reappear', 'disappear', 'exit_frame', 'enter_frame', 'full_occlusion'], type) AS rank FROM events_of WHERE other IS NULL),
        anchors AS (SELECT video_id, obj_id, type, mid FROM ranked WHERE rank > 0 QUALIFY row_number() OVER (PARTITION BY video_id, obj_id ORDER BY rank, event_id DESC) = 1),
        past AS (SELECT video_id, obj_id, frame, visible, area, list(CASE WHEN visible AND area > 0 THEN area END) OVER (PARTITION BY video_id, obj_id ORDER BY frame ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS p,
            max(visible::INT) OVER (PARTITION BY video_id, obj_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, max(visible::INT) OVER (PARTITION BY video_id, obj_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM frames),
        based_area AS (SELECT *, list_sort(list_filter(p, lambda x: x IS NOT NULL)) AS q FROM past),
        at_frame AS (SELECT *, CASE WHEN NOT visible THEN CASE WHEN b = 1 AND a = 1 THEN 'fully hidden' ELSE 'not yet appeared or already gone' END WHEN area > 0 AND area / q[(len(q) // 2) + 1]::DOUBLE < 0.5 THEN 'partly hidden' ELSE 'fully visible' END AS answer FROM based_area)
        SELECT x.video_id, x.obj_id, x.type AS anchor_type, x.mid AS anchor_frame, s.obj_id AS partner, s.answer FROM anchors x JOIN names n ON n.video_id = x.video_id AND n.obj_id = x.obj_id JOIN names m ON m.video_id = x.video_id AND m.obj_id <> x.obj_id AND m.base <> n.base AND m.base <> ''
        JOIN at_frame s ON s.video_id = x.video_id AND s.obj_id = m.obj_id AND s.frame = x.mid WHERE (x.video_id, x.obj_id) IN {_SURE} AND (m.video_id, m.obj_id) IN {_SURE} QUALIFY row_number() OVER (PARTITION BY x.video_id, x.obj_id ORDER BY m.track_ord) = 1""",
    "unit_cross_order": T.EVENTS + _OWN + f""", {_PARTS}, j AS (SELECT e.*, n.base FROM mine e JOIN names n ON n.video_id = e.video_id AND n.obj_id = e.obj_id WHERE NOT {_HOLDS['temporal'].replace('label', 'e.label')} AND (e.video_id, e.obj_id) IN {_SURE})
        SELECT a.video_id, a.obj_id AS obj_a, b.obj_id AS obj_b, a.event_id AS event_a, b.event_id AS event_b, CASE WHEN a.mid < b.mid THEN 'a' ELSE 'b' END AS first FROM j a JOIN j b ON b.video_id = a.video_id AND b.obj_id > a.obj_id AND NOT (a.base <> '' AND a.base = b.base) AND abs(a.mid - b.mid) >= 3
        QUALIFY row_number() OVER (PARTITION BY a.video_id, a.obj_id, b.obj_id ORDER BY a.event_id, b.event_id) = 1""",
    "ref_expr_features": "WITH " + T.FRAMES + """, g AS (SELECT video_id, obj_id, list_sort(list((x1 + x2) / 2.0)) AS cx, list_sort(list((y1 + y2) / 2.0)) AS cy, list_sort(list(area)) AS area, any_value(width) AS w, any_value(height) AS h FROM frames WHERE visible GROUP BY 1, 2),
        m AS (SELECT video_id, obj_id, cx[len(cx) // 2 + 1] AS cx, cy[len(cy) // 2 + 1] AS cy, area[len(area) // 2 + 1] AS area, w, h FROM g)
        SELECT video_id, obj_id, cx, cy, area, CASE WHEN cx < w / 3.0 THEN 'left' WHEN cx > w * 2 / 3.0 THEN 'right' ELSE 'center' END AS column, CASE WHEN cy < h / 3.0 THEN 'top' WHEN cy > h * 2 / 3.0 THEN 'bottom' ELSE 'middle' END AS row FROM m""".replace("AS column", 'AS "column"').replace("AS row", 'AS "row"'),
}
SQL["units_by_dim"] = "SELECT dim, count(*) AS n, count(DISTINCT video_id) AS videos FROM (" + " UNION ALL ".join(
    f"SELECT video_id, '{n}' AS dim FROM ({SQL[q]})" for n, q in (("temporal_location", "unit_temporal_location"), ("duration_category", "unit_duration_category"), ("relative_spatial_change", "unit_spatial_change"), ("event_existence", "unit_existence"), ("reappear_or_disappear", "unit_mechanism"), ("event_count", "unit_count"), ("event_ordering", "unit_ordering"), ("reappear_identity", "unit_identity"), ("conditional_state", "unit_conditional_state"), ("cross_object_order", "unit_cross_order"))
) + ") GROUP BY dim"
