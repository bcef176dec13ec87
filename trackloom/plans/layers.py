"""Queries over the necessity layers: results, combinations, survival and what was lost where.

The prediction log stands for the recorded trials: a layer's trials are the predictions of the models of some kind or category in the
registry, in order of their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.functions.text import key_text
from trackloom.operators import layers as L
from trackloom.plans.items import _items, _preds, _scored
from trackloom.plans.items_sql import ITEMS, SCORED
from trackloom.tables import load

#: Which models of the registry a layer's trials come from: its column and values.
TRIALS = {"text_only": ("kind", ["openai_text", "logic"]), "single_frame": ("kind", ["hf_video"]), "ordered": ("category", ["closed"]), "shuffled": ("category", ["closed_thinking"])}
LAYERS = ["text_only", "single_frame", "shuffled"]


def _once(spark: SparkSession, d: str) -> DataFrame:
    """qa_id (key), dim, tier, format, hallucination tag of each item, once."""
    tag = F.coalesce("hallucination", F.when(F.col("has_hallucination_distractor"), "distractor_only"), F.lit("none"))
    return _items(spark, d).select(key_text(F.col("qa_id")).alias("qa_id"), "dim", "tier", "format", tag.alias("tag")).dropDuplicates(["qa_id"])


def _results(spark: SparkSession, d: str) -> DataFrame:
    registry = load(spark, d, "model_registry").select(key_text(F.col("model")).alias("model"), "kind", "category").dropDuplicates(["model"])
    s = _scored(spark, d).select("qa_id", "model", "format", "correct").join(registry, "model").withColumnRenamed("model", "trial")
    of = {name: s.where(F.col(column).isin(values)) for name, (column, values) in TRIALS.items()}
    return L.layer_results(_once(spark, d), of["text_only"], of["single_frame"], of["ordered"], of["shuffled"])


def layer_results(spark: SparkSession, d: str) -> DataFrame:
    return _results(spark, d)


def _wide(spark: SparkSession, d: str) -> DataFrame:
    """Items with one column a layer: passed, or null where it has no result."""
    r = _results(spark, d).groupBy("qa_id").agg(*(F.max(F.when(F.col("layer") == n, F.col("passed"))).alias(n) for n in LAYERS))
    return _once(spark, d).join(r, "qa_id", "left")


def _ok(*names: str):
    out = F.lit(True)
    for n in names:
        out = out & F.coalesce(n, F.lit(True))
    return out


def layer_combine(spark: SparkSession, d: str) -> DataFrame:
    """An item passes unless some layer failed it; layers that lack it count as passed."""
    return _wide(spark, d).select("qa_id", _ok(*LAYERS).alias("passed"))


def layer_intersection(spark: SparkSession, d: str) -> DataFrame:
    """Items that every layer has and passed."""
    return _wide(spark, d).where("text_only and single_frame and shuffled").select("qa_id")


def survival_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    """Items in, items left and rate by tier, dimension and format, in one pass."""
    w = _wide(spark, d).select(*(F.coalesce(g, F.lit("unknown")).alias(g) for g in ("tier", "dim", "format")), _ok(*LAYERS).alias("passed"))
    each = F.explode(F.array(*(F.struct(F.lit(g).alias("grouping"), F.col(g).alias("value")) for g in ("tier", "dim", "format")))).alias("g")
    return w.select("passed", each).groupBy("g.grouping", "g.value").agg(F.count(F.lit(1)).alias("n_in"), F.count_if("passed").alias("n_out"), F.round(100 * F.avg(F.col("passed").cast("int")), 1).alias("rate"))


def fail_attribution(spark: SparkSession, d: str) -> DataFrame:
    return _wide(spark, d).groupBy("dim").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(~F.coalesce(k, F.lit(True))).alias(f"{k}_failed") for k in LAYERS))


def funnel_by_stage(spark: SparkSession, d: str) -> DataFrame:
    """Items of each tier left after each stage, with their part of the stage in percent."""
    j = _wide(spark, d)
    verified = _items(spark, d).select(key_text(F.col("qa_id")).alias("qa_id"), F.coalesce("verification_passed", F.lit(True)).alias("verified")).dropDuplicates(["qa_id"])
    j = j.join(verified, "qa_id")
    stages = F.array(F.lit("all"), F.when(F.col("verified"), "verified"), *(F.when(F.col("verified") & _ok(*LAYERS[:k]), f"after_{k}") for k in (1, 2, 3)))
    n = j.select("tier", F.explode(F.filter(stages, lambda x: x.isNotNull())).alias("stage")).groupBy("stage", "tier").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy("stage")), 1))


def hallucination_survival(spark: SparkSession, d: str) -> DataFrame:
    return _wide(spark, d).groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.count_if(_ok(*LAYERS)).alias("passed"))


def numerical_predictions(spark: SparkSession, d: str, most: int = 5) -> DataFrame:
    """The most common recorded answers to numerical items by right answer; ties by answer."""
    i = _items(spark, d).where("format = 'numerical' and correct_answer is not null").select(key_text(F.col("qa_id")).alias("qa_id"), "correct_answer").dropDuplicates(["qa_id"])
    p = _preds(spark, d).select("qa_id", F.coalesce(F.get("extracted_answer", F.lit(0)), F.lit("none")).alias("predicted"))
    n = i.join(p, "qa_id").groupBy("correct_answer", "predicted").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy("correct_answer").orderBy(F.desc("n"), "predicted"))).where(F.col("place") <= most)


def spatial_answers(spark: SparkSession, d: str) -> DataFrame:
    """Right option texts of the spatial dimension, and how many of their items are left."""
    i = _items(spark, d).where("dim = 'relative_spatial_change' and format = 'mcq_4'")
    text = F.element_at(F.array(*(f"option_{x}" for x in "abcd")), F.array_position(F.array(*map(F.lit, "ABCD")), F.col("correct_answer")).cast("int"))
    i = i.where("correct_answer in ('A', 'B', 'C', 'D')").select(key_text(F.col("qa_id")).alias("qa_id"), text.alias("text")).dropDuplicates(["qa_id"])
    return i.join(_wide(spark, d).select("qa_id", _ok(*LAYERS).alias("passed")), "qa_id").groupBy("text").agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("passed"))


def identity_survival(spark: SparkSession, d: str) -> DataFrame:
    """The identity dimension: items, and how many each layer ran on and failed."""
    w = _wide(spark, d).where("dim = 'reappear_identity'")
    return w.agg(F.count(F.lit(1)).alias("n"), *(F.count(k).alias(f"{k}_ran") for k in LAYERS), *(F.count_if(~F.col(k)).alias(f"{k}_failed") for k in LAYERS))


def majority_vote(spark: SparkSession, d: str) -> DataFrame:
    """Most common single answer over models, and by how many; ties by answer."""
    v = _preds(spark, d).where("size(extracted_answer) = 1").groupBy("qa_id", F.col("extracted_answer")[0].alias("answer")).agg(F.count(F.lit(1)).alias("votes"))
    return v.groupBy("qa_id").agg(F.min_by("answer", F.struct(-F.col("votes"), F.col("answer"))).alias("answer"), F.max("votes").alias("votes"))


def probe_early_stop(spark: SparkSession, d: str) -> DataFrame:
    """Single-frame probes of all predictions of an item: how many until the format's number of hits was reached or couldn't be any more."""
    r = L.run(_scored(spark, d).select("qa_id", "format", F.col("model").alias("trial"), "correct"), L.SINGLE_FRAME)
    return r.select("qa_id", F.col("used").alias("probes"), (~F.col("held")).alias("passed"))


QUERIES = {f.__name__: f for f in (layer_results, layer_combine, layer_intersection, survival_grouping_sets, fail_attribution, funnel_by_stage, hallucination_survival, numerical_predictions, spatial_answers, identity_survival, majority_vote, probe_early_stop)}

_CASE = {name: tuple("CASE " + " ".join(f"WHEN format LIKE '{k}%' THEN {v[i]}" for k, v in t.items() if k) + f" ELSE {t[''][i]} END" for i in (0, 1)) for name, t in (("text_only", L.TEXT_ONLY), ("single_frame", L.SINGLE_FRAME), ("ordered", L.SHUFFLED), ("shuffled", L.SHUFFLED))}


def _run(name: str, source: str) -> str:
    most, need = _CASE[name]
    return f"""{name}_t AS (SELECT qa_id, correct, {most} AS most, {need} AS need, row_number() OVER (PARTITION BY qa_id ORDER BY model) AS r FROM {source}),
    {name}_p AS (SELECT *, sum(correct::INT) OVER (PARTITION BY qa_id ORDER BY r) AS hits, count(*) OVER (PARTITION BY qa_id) AS n FROM {name}_t WHERE r <= most),
    {name}_r AS (SELECT qa_id, min(r) AS used, arg_min(hits, r) AS hits, arg_min(hits >= need, r) AS held FROM {name}_p WHERE hits >= need OR hits + n - r < need OR r = n GROUP BY qa_id)"""


_RUNS = ", ".join(_run(name, f"(SELECT s.* FROM scored s JOIN model_registry m ON lower(trim(m.model)) = s.model WHERE m.{column} IN ({', '.join(repr(v) for v in values)}))") for name, (column, values) in TRIALS.items())
_NOT = {k: f"coalesce(dim NOT IN ({', '.join(repr(x) for x in v)}), true)" for k, v in L.EXEMPT.items()}
_ALL = SCORED + f""", once AS (SELECT lower(trim(qa_id)) AS qa_id, any_value(dim) AS dim, any_value(tier) AS tier, any_value(format) AS format, any_value(coalesce(hallucination, CASE WHEN has_hallucination_distractor THEN 'distractor_only' END, 'none')) AS tag, bool_and(coalesce(verification_passed, true)) AS verified FROM items GROUP BY 1), {_RUNS},
    results AS (SELECT qa_id, 'text_only' AS layer, used, hits, NOT held AS passed FROM once JOIN text_only_r USING (qa_id) WHERE {_NOT['text_only']} UNION ALL SELECT qa_id, 'single_frame', used, hits, NOT held FROM once JOIN single_frame_r USING (qa_id) WHERE {_NOT['single_frame']}
        UNION ALL SELECT qa_id, 'shuffled', s.used, s.hits, NOT (s.held AND coalesce(o.held, false)) FROM once JOIN shuffled_r s USING (qa_id) LEFT JOIN ordered_r o USING (qa_id) WHERE {_NOT['shuffled']}),
    wide AS (SELECT o.*, {', '.join(f"(SELECT passed FROM results r WHERE r.qa_id = o.qa_id AND layer = '{k}') AS {k}" for k in LAYERS)} FROM once o), combined AS (SELECT *, coalesce(text_only, true) AND coalesce(single_frame, true) AND coalesce(shuffled, true) AS passed FROM wide)"""
SQL = {
    "layer_results": _ALL + " SELECT qa_id, layer, used, hits::BIGINT AS hits, passed FROM results",
    "layer_combine": _ALL + " SELECT qa_id, passed FROM combined",
    "layer_intersection": _ALL + " SELECT qa_id FROM wide WHERE text_only AND single_frame AND shuffled",
    "survival_grouping_sets": _ALL + " " + " UNION ALL ".join(f"SELECT '{g}' AS grouping, coalesce({g}, 'unknown') AS value, count(*) AS n_in, count(*) FILTER (passed) AS n_out, round(100 * avg(passed::INT), 1) AS rate FROM combined GROUP BY coalesce({g}, 'unknown')" for g in ("tier", "dim", "format")),
    "fail_attribution": _ALL + " SELECT dim, count(*) AS n, " + ", ".join(f"count(*) FILTER (NOT {k}) AS {k}_failed" for k in LAYERS) + " FROM wide GROUP BY dim",
    "funnel_by_stage": _ALL + """, staged AS (SELECT unnest(list_filter(['all', CASE WHEN verified THEN 'verified' END, CASE WHEN verified AND coalesce(text_only, true) THEN 'after_1' END, CASE WHEN verified AND coalesce(text_only, true) AND coalesce(single_frame, true) THEN 'after_2' END, CASE WHEN verified AND passed THEN 'after_3' END], lambda x: x IS NOT NULL)) AS stage, tier FROM combined),
        n AS (SELECT stage, tier, count(*) AS n FROM staged GROUP BY ALL) SELECT *, round(100 * n / sum(n) OVER (PARTITION BY stage)::DOUBLE, 1) AS percent FROM n""",
    "hallucination_survival": _ALL + " SELECT tag, count(*) AS n, count(*) FILTER (passed) AS passed FROM combined GROUP BY tag",
    "numerical_predictions": SCORED.replace("scored AS (", "unused AS (") + """, n AS (SELECT i.correct_answer, coalesce(p.extracted_answer[1], 'none') AS predicted, count(*) AS n FROM (SELECT lower(trim(qa_id)) AS qa_id, any_value(correct_answer) AS correct_answer FROM items WHERE format = 'numerical' AND correct_answer IS NOT NULL GROUP BY 1) i JOIN latest p USING (qa_id) GROUP BY ALL)
        SELECT *, row_number() OVER (PARTITION BY correct_answer ORDER BY n DESC, predicted) AS place FROM n QUALIFY row_number() OVER (PARTITION BY correct_answer ORDER BY n DESC, predicted) <= 5""",
    "spatial_answers": _ALL + """, s AS (SELECT lower(trim(qa_id)) AS qa_id, any_value([option_a, option_b, option_c, option_d][ascii(correct_answer) - 64]) AS text FROM items WHERE dim = 'relative_spatial_change' AND format = 'mcq_4' AND correct_answer IN ('A', 'B', 'C', 'D') GROUP BY 1)
        SELECT text, count(*) AS n, count(*) FILTER (passed) AS passed FROM s JOIN combined USING (qa_id) GROUP BY text""",
    "identity_survival": _ALL + " SELECT count(*) AS n, " + ", ".join(f"count({k}) AS {k}_ran" for k in LAYERS) + ", " + ", ".join(f"count(*) FILTER (NOT {k}) AS {k}_failed" for k in LAYERS) + " FROM wide WHERE dim = 'reappear_identity'",
    "majority_vote": SCORED.replace("scored AS (", "unused AS (") + " SELECT qa_id, answer, votes FROM (SELECT qa_id, extracted_answer[1] AS answer, count(*) AS votes FROM latest WHERE len(extracted_answer) = 1 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY qa_id ORDER BY votes DESC, answer) = 1",
    "probe_early_stop": SCORED + ", " + _run("single_frame", "scored") + " SELECT qa_id, used AS probes, NOT held AS passed FROM single_frame_r",
}
