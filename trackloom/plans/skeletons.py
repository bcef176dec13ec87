"""Questions with their options, statements and answers, built from the units of every dimension.

Texts are put together by SQL expressions that Spark and DuckDB read alike. What the benchmark draws at random is drawn by the hash of a question's
key: the order of options, which statement comes first, how events are presented, and which questions get a made-up subject.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom import vocab as V
from trackloom.functions.labels import label_parts
from trackloom.operators import frames as R
from trackloom.plans import sqltext as T
from trackloom.plans import units as U
from trackloom.plans.events import _docs, _events
from trackloom.session import cut


def _phrase(table: dict[str, str], column: str, partner: str = "'another object'") -> str:
    cases = " ".join(f"WHEN {column} = '{k}' THEN " + ("'" + v.replace("{partner}", f"' || coalesce({partner}, 'another object') || '") + "'") for k, v in table.items())
    return f"CASE {cases} ELSE replace({column}, '_', ' ') END"


_VERB = f"({_phrase(V.VERBS, 'event_type')})"
_STATE = f"({_phrase(V.CONDITIONS, 'event_type', 'partner_label')})"
_FIRST, _SECOND = (f"({_phrase(V.VERBS, c)})" for c in ("type_a", "type_b"))
_NO_THE = "trim(CASE WHEN lower(substr({0}, 1, 4)) = 'the ' THEN substr({0}, 5) ELSE {0} END)"

#: Of each dimension: parts of a question's key, its event type, question, right text, wrong text (pairs) or all texts (options).
SPECS = {
    "temporal_location": ("event_id", "event_type", f"CASE WHEN prefix = 'first' THEN 'When in the video does ' || label || ' first ' || {_VERB} || '?' WHEN prefix = 'last' THEN 'The last time ' || label || ' ' || {_VERB} || ', when is it?' ELSE 'When in the video does ' || label || ' ' || {_VERB} || '?' END", "bucket", V.TIMES),
    "duration_category": ("event_id", "event_type", f"'How long does ' || label || ' stay ' || {_STATE} || '?'", "bucket", V.DURATIONS),
    "relative_spatial_change": ("''", "cast(null as varchar(30))", "'How does ' || label || ' move across the frame during the video?'", "answer", V.DIRECTIONS),
    "conditional_state": ("partner", "anchor_type", f"'At the moment ' || label || ' ' || {_VERB} || ', what is the state of ' || partner_label || '?'", "answer", V.STATES),
    "event_existence": ("event_type || polarity", "event_type", f"'Does ' || label || ' ever ' || {_VERB} || ' in the video?'", f"CASE WHEN polarity = 'yes' THEN label || ' does ' || {_VERB} ELSE label || ' never ' || {_VERB} END", f"CASE WHEN polarity = 'yes' THEN label || ' never ' || {_VERB} ELSE label || ' does ' || {_VERB} END"),
    "reappear_or_disappear": ("event_id", "scenario", "CASE WHEN scenario = 'reappear' THEN 'Before ' || label || ' comes back into view, was it fully blocked or did it leave the frame?' ELSE 'When ' || label || ' disappears, does it get fully blocked or leave the frame?' END",
        *(f"label || CASE WHEN (mechanism = 'fully blocked') {'=' if right else '<>'} true THEN CASE WHEN scenario = 'reappear' THEN ' was fully blocked before coming back' ELSE ' got fully blocked' END ELSE CASE WHEN scenario = 'reappear' THEN ' left the frame before coming back' ELSE ' left the frame' END END" for right in (True, False))),
    "reappear_identity": ("sibling || ':' || reappear_event_id", "'reappear'", "'After ' || label || ' comes back into view, is it the same ' || base || ' as before, or a different one?'", "'the ' || base || ' that comes back is the same one as before'", "'the ' || base || ' that comes back is a different one'"),
    "occluder_identity": ("start_frame", "'full_occlusion'", "'What is likely blocking ' || label || ' at the moment it becomes fully hidden?'", f"'the ' || {_NO_THE.format('answer')} || ' likely blocks it'", f"'the ' || {_NO_THE.format('distractor')} || ' likely blocks it'"),
    "cross_object_order": ("obj_b || ':' || event_a || ':' || event_b", "type_a", "'Which event happens first in the video?'", *(f"CASE WHEN (first = 'a') {'=' if right else '<>'} true THEN label || ' ' || {_FIRST} || ' before ' || partner_label || ' ' || {_SECOND} ELSE partner_label || ' ' || {_SECOND} || ' before ' || label || ' ' || {_FIRST} END" for right in (True, False))),
    "event_count": ("event_type", "event_type", f"'How many times does ' || label || ' ' || {_VERB} || ' in the video?'", "answer", None),
    "event_ordering": ("''", "cast(null as varchar(30))", "'Put the following events for ' || label || ' in order from earliest to latest.'", "event_types", None),
}
UNITS = {
    "temporal_location": "unit_temporal_location", "duration_category": "unit_duration_category", "relative_spatial_change": "unit_spatial_change", "event_existence": "unit_existence", "reappear_or_disappear": "unit_mechanism", "event_count": "unit_count",
    "event_ordering": "unit_ordering", "reappear_identity": "unit_identity", "occluder_identity": "unit_occluder", "conditional_state": "unit_conditional_state", "cross_object_order": "unit_cross_order",
}
COLUMNS = ["skeleton_id", "video_id", "obj_id", "subject_label", "dim", "tier", "format", "event_type", "question", "option_a", "option_b", "option_c", "option_d", "statement_a", "statement_b", "events", "correct_answer"]


def _named(u: DataFrame, dim: str, names: DataFrame, events: DataFrame) -> DataFrame:
    """Units with the label and noun of their subject, and of the other object where there is one."""
    if dim == "cross_object_order":
        kinds = events.select("video_id", "event_id", "type")
        for k in "ab":
            u = u.join(kinds.withColumnsRenamed({"event_id": f"event_{k}", "type": f"type_{k}"}), ["video_id", f"event_{k}"])
        u = u.withColumnRenamed("obj_a", "obj_id")
    u = u.join(names, ["video_id", "obj_id"])
    other = {"conditional_state": "partner", "cross_object_order": "obj_b"}.get(dim)
    if other:
        u = u.join(names.select("video_id", F.col("obj_id").alias(other), F.col("label").alias("partner_label")), ["video_id", other])
    if dim == "duration_category":
        touched = events.select("video_id", "event_id", F.col("obj_id").alias("e_obj"), F.col("label").alias("e_label"), F.col("b_label").alias("e_other"))
        u = u.join(touched, ["video_id", "event_id"]).withColumn("partner_label", F.when(F.col("e_obj") == F.col("obj_id"), F.col("e_other")).otherwise(F.col("e_label")))
    return u.withColumn("event_type", F.col("anchor_type")) if dim == "conditional_state" else u


def _skeleton(u: DataFrame, dim: str) -> DataFrame:
    key, kind, question, right, other = SPECS[dim]
    tier, fmt = V.DIMENSIONS[dim]
    base = u.select("video_id", "obj_id", F.col("label").alias("subject_label"), F.expr(f"'{dim}:' || video_id || ':' || obj_id || ':' || {key}").alias("key"), F.expr(kind).alias("event_type"), F.expr(question).alias("question"), F.expr(right).alias("right"), *([F.expr(other).alias("wrong")] if isinstance(other, str) else []))
    base = base.withColumns({"dim": F.lit(dim), "tier": F.lit(tier), "format": F.lit(fmt), "skeleton_id": F.substring(F.md5("key"), 1, 12)})
    null = F.lit(None).cast("string")
    out = {c: null for c in COLUMNS if c.startswith(("option", "statement")) or c == "events"} | {"correct_answer": F.col("right")}
    if isinstance(other, list):
        by = lambda salt: lambda x: F.struct(F.md5(F.concat(F.lit(salt), "key", F.lit(":"), x)).alias("h"), x.alias("x"))
        rest = F.slice(F.transform(F.array_sort(F.transform(F.filter(F.array(*map(F.lit, other)), lambda x: x != F.col("right")), by("d:"))), lambda s: s["x"]), 1, 3)
        base = base.withColumn("all", F.transform(F.array_sort(F.transform(F.concat(F.array("right"), rest), by("o:"))), lambda s: s["x"]))
        out |= {f"option_{x}": F.col("all")[i] for i, x in enumerate("abcd")} | {"correct_answer": F.char(64 + F.array_position("all", F.col("right")))}
    elif isinstance(other, str):
        heads = F.substring(F.md5(F.concat(F.lit("sp:"), "key")), 1, 1) < "8"
        out |= {"statement_a": F.when(heads, F.col("right")).otherwise(F.col("wrong")), "statement_b": F.when(heads, F.col("wrong")).otherwise(F.col("right")), "correct_answer": F.when(heads, "A").otherwise("B")}
    elif dim == "event_ordering":
        kinds = F.split("right", ",")
        order = F.transform(F.array_sort(F.transform(F.sequence(F.lit(1), F.size(kinds)), lambda i: F.struct(F.md5(F.concat(F.lit("e:"), "key", F.lit(":"), i.cast("string"))).alias("h"), i.alias("i")))), lambda s: s["i"])
        base = base.withColumns({"kinds": kinds, "order": order})
        phrase = F.create_map(*(F.lit(v) for kv in V.VERBS.items() for v in kv))
        shown = F.transform("order", lambda i, k: F.concat(F.char(65 + k), F.lit(": it "), F.element_at(phrase, F.element_at("kinds", i))))
        out |= {"events": F.array_join(shown, "|"), "correct_answer": F.array_join(F.transform(F.sequence(F.lit(1), F.size("kinds")), lambda i: F.char(64 + F.array_position("order", i))), ",")}
        base = base.withColumn("format", F.concat(F.lit("ordering_"), F.size("kinds").cast("string")))
    return base.select(*(out.get(c, F.col(c) if c in base.columns else null).cast("int" if c == "obj_id" else "string").alias(c) for c in COLUMNS))


def built(spark: SparkSession, d: str, dims: list[str] | None = None) -> DataFrame:
    """Questions of the dimensions, in one table; units without a label, or with a null in any text, give none."""
    events = _events(spark, d)
    names = R.objects(_docs(spark, d)).select("video_id", "obj_id", "label", label_parts(F.col("label"))["base"].alias("base"))
    parts = []
    for dim in dims or SPECS:
        unit = getattr(U, UNITS[dim])
        u = unit(spark, d) if dim == "occluder_identity" else unit(spark, d, events)
        parts.append(_skeleton(_named(u, dim, names, events), dim).where("question is not null and correct_answer is not null"))
    return reduce(DataFrame.unionByName, parts)


def _one(dim: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return built(spark, d, [dim])

    query.__name__ = f"skeleton_{dim}"
    query.__doc__ = f"Questions of {dim}."
    return query


def skeleton_counts(spark: SparkSession, d: str) -> DataFrame:
    """Questions by dimension, tier and format."""
    s = built(spark, d)
    each = F.explode(F.array(*(F.struct(F.lit(g).alias("grouping"), F.col(g).alias("value")) for g in ("dim", "tier", "format")))).alias("g")
    return s.select(each).groupBy("g.grouping", "g.value").agg(F.count(F.lit(1)).alias("n"))


def fake_subject(spark: SparkSession, d: str) -> DataFrame:
    """A subject that a video doesn't show, for each question that may have one: the same noun with a modifier that the noun has elsewhere and
    the video doesn't use with it (four times of five, if there is one), else a label of another video whose noun the video lacks and that has no number; the smallest hash wins."""
    o = R.objects(_docs(spark, d)).select("video_id", "obj_id", "label", label_parts(F.col("label")).alias("p")).where("label is not null")
    o = cut(o.select("video_id", "obj_id", "label", F.col("p.base").alias("base"), F.col("p.modifiers").alias("mods"), F.col("p.digit").alias("digit")))
    q = built(spark, d, V.MADE_UP_DIMS).select("skeleton_id", "video_id", "obj_id").join(o.select("video_id", "obj_id", "base"), ["video_id", "obj_id"])
    pool = o.where("base <> '' and mods <> ''").select("base", "mods").distinct()
    used = o.select("video_id", "base", "mods").distinct()
    near = q.where("base <> ''").join(pool, "base").join(used, ["video_id", "base", "mods"], "left_anti")
    h = lambda col: F.md5(F.concat(F.lit("f:"), "skeleton_id", F.lit(":"), col))
    near = near.groupBy("skeleton_id").agg(F.min_by(F.concat("mods", F.lit(" "), "base"), h(F.col("mods"))).alias("near"))
    # one label a noun (the smallest), and so many nouns that their list is one small row
    labels = o.where("not digit and base <> ''").groupBy("base").agg(F.min("label").alias("label")).orderBy(F.md5("base"), "base").limit(MOST_NOUNS)
    listed = labels.agg(F.collect_list(F.struct("base", "label")).alias("pool"))
    nouns = o.groupBy("video_id").agg(F.collect_set("base").alias("nouns"))
    fits = F.filter("pool", lambda x: ~F.array_contains("nouns", x["base"]))
    far = q.join(nouns, "video_id").join(F.broadcast(listed)).select("skeleton_id", F.get(F.array_sort(F.transform(fits, lambda x: F.struct(h(x["base"]).alias("h"), x["label"].alias("l")))), F.lit(0))["l"].alias("far")).dropDuplicates(["skeleton_id"])
    keep = F.conv(F.substring(F.md5(F.concat(F.lit("g:"), "skeleton_id")), 1, 8), 16, 10).cast("double") / F.lit(2.0**32) < 0.8
    out = q.select("skeleton_id").distinct().join(near, "skeleton_id", "left").join(far, "skeleton_id", "left")
    return out.select("skeleton_id", F.coalesce(F.when(keep, F.col("near")), F.col("far"), F.col("near"), F.lit("purple umbrella")).alias("subject"))


#: Nouns that a made-up subject is drawn from: those with the smallest hashes.
MOST_NOUNS = 200


def made_up_questions(spark: SparkSession, d: str) -> DataFrame:
    """Questions after the roll: 5 % ask about a made-up subject (variant a), or what a real one never does (variant b), 10 % get such a wrong option."""
    q = built(spark, d, V.MADE_UP_DIMS).join(fake_subject(spark, d), "skeleton_id")
    u = lambda salt: F.conv(F.substring(F.md5(F.concat(F.lit(salt), "skeleton_id")), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    verb = F.coalesce(F.element_at(F.create_map(*(F.lit(v) for kv in V.VERBS.items() for v in kv)), F.col("event_type")), F.lit("moves"))
    both = F.col("dim").isin(V.MADE_UP_BOTH)
    a = ~both | (u("w:") < 0.5)
    roll = F.when(u("r:") < V.MADE_UP_RATE, "question").when(u("r:") < V.MADE_UP_RATE + V.MADE_UP_OPTION_RATE, "distractor").otherwise("none")
    text = F.when(a, F.concat(F.lit("there is no "), "subject", F.lit(" in this video"))).otherwise(F.concat("subject_label", F.lit(" never "), verb))
    q = q.withColumns({"roll": roll, "made": text, "a": a})
    # the right option says so, or the first wrong one
    target = F.when(F.col("roll") == "question", F.col("correct_answer")).when(F.col("roll") == "distractor", F.when(F.col("correct_answer") == "A", "B").otherwise("A"))
    options = {f"option_{x}": F.when(F.coalesce(target == x.upper(), F.lit(False)), F.col("made")).otherwise(F.col(f"option_{x}")) for x in "abcd"}
    asked = F.when((F.col("roll") == "question") & F.col("a"), F.replace("question", F.col("subject_label"), F.col("subject"))).otherwise(F.col("question"))
    tag = F.when(F.col("roll") == "question", F.when(F.col("a"), "variant_a").otherwise("variant_b"))
    return q.select("skeleton_id", "dim", asked.alias("question"), *(v.alias(k) for k, v in options.items()), "correct_answer", tag.alias("hallucination"), (F.col("roll") == "distractor").alias("has_hallucination_distractor"))


QUERIES = {f.__name__: f for f in (*map(_one, SPECS), skeleton_counts, fake_subject, made_up_questions)}

_NAMES = "named AS (SELECT video_id, obj_id, label, base FROM (WITH " + T.OBJECTS + ", " + U._PARTS + " SELECT * FROM names))"
_KINDS = "kinds AS (" + T.EVENTS + " SELECT video_id, event_id, type, obj_id AS e_obj, label AS e_label, other_label AS e_other FROM events_of)"


def _sql(dim: str) -> str:
    key, kind, question, right, other = SPECS[dim]
    tier, fmt = V.DIMENSIONS[dim]
    who = "u.obj_a" if dim == "cross_object_order" else "u.obj_id"
    columns, joins = "u.*, n.label, n.base", f" JOIN named n ON n.video_id = u.video_id AND n.obj_id = {who}"
    if dim == "cross_object_order":
        columns = "u.*, u.obj_a AS obj_id, n.label, n.base, ka.type AS type_a, kb.type AS type_b, m.label AS partner_label"
        joins += " JOIN kinds ka ON ka.video_id = u.video_id AND ka.event_id = u.event_a JOIN kinds kb ON kb.video_id = u.video_id AND kb.event_id = u.event_b JOIN named m ON m.video_id = u.video_id AND m.obj_id = u.obj_b"
    if dim == "conditional_state":
        columns += ", m.label AS partner_label, u.anchor_type AS event_type"
        joins += " JOIN named m ON m.video_id = u.video_id AND m.obj_id = u.partner"
    if dim == "duration_category":
        columns += ", CASE WHEN k.e_obj = u.obj_id THEN k.e_other ELSE k.e_label END AS partner_label"
        joins += " JOIN kinds k ON k.video_id = u.video_id AND k.event_id = u.event_id"
    made = f"u AS ({U.SQL[UNITS[dim]]}), {_NAMES}" + (f", {_KINDS}" if dim in ("cross_object_order", "duration_category") else "")
    base = f"""WITH {made}, j AS (SELECT {columns} FROM u{joins}), b AS (SELECT video_id, obj_id, label AS subject_label, '{dim}:' || video_id || ':' || obj_id || ':' || {key} AS key, {kind} AS event_type, {question} AS question, {right} AS answer_text{', ' + other + ' AS wrong' if isinstance(other, str) else ''} FROM j)"""
    head = f"substr(md5(key), 1, 12) AS skeleton_id, video_id, obj_id, subject_label, '{dim}' AS dim, '{tier}' AS tier, {{0}} AS format, event_type, question"
    none = lambda *names: ", ".join(f"NULL::VARCHAR AS {n}" for n in names)
    options, pairs = [f"option_{x}" for x in "abcd"], ["statement_a", "statement_b"]
    if isinstance(other, list):
        listed = "[" + ", ".join(f"'{x}'" for x in other) + "]"
        by = lambda salt, items: f"list_transform(list_sort(list_transform({items}, lambda x: {{'h': md5('{salt}' || key || ':' || x), 'x': x}})), lambda s: s.x)"
        rest = by("d:", f"list_filter({listed}, lambda x: x <> answer_text)") + "[1:3]"
        return base + f", o AS (SELECT *, {by('o:', f'list_concat([answer_text], {rest})')} AS every FROM b WHERE answer_text IS NOT NULL) SELECT {head.format(repr(fmt))}, " + ", ".join(f"every[{i + 1}] AS {n}" for i, n in enumerate(options)) + f", {none(*pairs, 'events')}, chr((64 + list_position(every, answer_text))::INT) AS correct_answer FROM o WHERE question IS NOT NULL"
    if isinstance(other, str):
        coin = "substr(md5('sp:' || key), 1, 1) < '8'"
        return base + f" SELECT {head.format(repr(fmt))}, {none(*options)}, CASE WHEN {coin} THEN answer_text ELSE wrong END AS statement_a, CASE WHEN {coin} THEN wrong ELSE answer_text END AS statement_b, {none('events')}, CASE WHEN {coin} THEN 'A' ELSE 'B' END AS correct_answer FROM b WHERE question IS NOT NULL"
    if dim == "event_ordering":
        verbs = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in V.VERBS.items()) + "}"
        order = "list_transform(list_sort(list_transform(range(1, len(k) + 1), lambda i: {'h': md5('e:' || key || ':' || i), 'i': i})), lambda s: s.i)"
        return base + f", s AS (SELECT *, string_split(answer_text, ',') AS k FROM b), o AS (SELECT *, {order} AS ord FROM s) SELECT {head.format(chr(39) + 'ordering_' + chr(39) + ' || len(k)')}, {none(*options, *pairs)}, array_to_string(list_transform(ord, lambda i, p: chr((64 + p)::INT) || ': it ' || {verbs}[k[i]]), '|') AS events, array_to_string(list_transform(range(1, len(k) + 1), lambda i: chr((64 + list_position(ord, i))::INT)), ',') AS correct_answer FROM o"
    return base + f" SELECT {head.format(repr(fmt))}, {none(*options, *pairs, 'events')}, answer_text AS correct_answer FROM b WHERE question IS NOT NULL"


SQL = {f"skeleton_{dim}": _sql(dim) for dim in SPECS}
SQL["skeleton_counts"] = "WITH s AS (" + " UNION ALL ".join(f"SELECT dim, tier, format FROM ({_sql(dim)})" for dim in SPECS) + ") " + " UNION ALL ".join(f"SELECT '{g}' AS grouping, {g} AS value, count(*) AS n FROM s GROUP BY 2" for g in ("dim", "tier", "format"))
