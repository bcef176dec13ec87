"""Queries over items and predictions: extraction, scoring, sampling, balancing and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom import vocab as V
from trackloom.functions import answers as A
from trackloom.functions.labels import label_parts
from trackloom.functions.text import key_text
from trackloom.operators import answers as O
from trackloom.operators import frames as R
from trackloom.operators.ranking import ordinal
from trackloom.tables import load


def _items(spark: SparkSession, d: str) -> DataFrame:
    """Items without the exact copies."""
    return load(spark, d, "qa_items").where("qa_id is not null").dropDuplicates(["qa_id"])


def _preds(spark: SparkSession, d: str) -> DataFrame:
    """The last prediction of every message; only the columns that scoring needs are aggregated."""
    p = load(spark, d, "preds")
    last = p.select(key_text(p["qa_id"]).alias("qa_id"), key_text(p["model"]).alias("model"), F.struct("delivered_at", "delivery_id", "extracted_answer").alias("r"))
    return last.groupBy("qa_id", "model").agg(F.max("r").alias("r")).select("qa_id", "model", "r.*")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    i = _items(spark, d).select(key_text(F.col("qa_id")).alias("qa_id"), F.coalesce("dim", F.lit("unknown")).alias("dim"), F.coalesce("tier", F.lit("unknown")).alias("tier"), "format", F.substring_index("video_id", "_", 1).alias("source"), "hallucination", "has_hallucination_distractor", "correct_answer", "correct_order")
    j = i.join(_preds(spark, d), "qa_id")
    tag = F.when(F.col("hallucination").isin("variant_a", "variant_b"), F.col("hallucination")).when(F.col("has_hallucination_distractor"), "distractor_only").otherwise("clean")
    return j.select("qa_id", "model", "dim", "tier", "format", "source", tag.alias("bucket"), F.col("extracted_answer").isNull().alias("invalid"), A.correct(F.col("extracted_answer"), F.col("format"), F.col("correct_answer"), F.col("correct_order")).alias("correct"))


def extracted_answers(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "preds")
    return p.select("delivery_id", A.extract(p["raw_response"], p["format"]).alias("answer"))


def extraction_agreement(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "preds")
    own, given = A.extract(p["raw_response"], p["format"]), F.array_join("extracted_answer", ",")
    return p.groupBy("format").agg(F.count(F.lit(1)).alias("n"), F.count_if(own.eqNullSafe(given)).alias("same"), F.count_if(own.isNull()).alias("none"))


def preds_last_wins(spark: SparkSession, d: str) -> DataFrame:
    return _preds(spark, d).select("qa_id", "model", "delivery_id")


def score_items(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("qa_id", "model", "correct", "invalid")


def metrics_overall(spark: SparkSession, d: str) -> DataFrame:
    total = _items(spark, d).agg(F.count(F.lit(1)).alias("n_total"))
    m = _scored(spark, d).groupBy("model").agg(F.count(F.lit(1)).alias("n_scored"), F.count_if("invalid").alias("n_invalid"), F.round(F.avg(F.col("correct").cast("int")), 6).alias("overall"))
    return m.join(F.broadcast(total)).withColumn("n_missing", F.col("n_total") - F.col("n_scored"))


def metrics_by_group(spark: SparkSession, d: str) -> DataFrame:
    """One pass for all four groupings."""
    s = _scored(spark, d)
    groups = F.explode(F.array(*(F.struct(F.lit(g).alias("grouping"), F.col(g).alias("value")) for g in ("dim", "tier", "format", "source", "bucket")))).alias("g")
    return s.select("model", "correct", groups).groupBy("model", F.col("g.grouping").alias("grouping"), F.col("g.value").alias("value")).agg(F.count(F.lit(1)).alias("total"), F.count_if("correct").alias("n_correct"))


def metrics_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d)
    out = s.groupingSets([[F.col("dim")], [F.col("tier")], [F.col("format")], []], F.col("dim"), F.col("tier"), F.col("format")).agg(F.count(F.lit(1)).alias("total"), F.count_if("correct").alias("n_correct"))
    return out


def metrics_macro_dim(spark: SparkSession, d: str) -> DataFrame:
    per = _scored(spark, d).groupBy("model", "dim").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("correct").cast("int")).alias("acc"))
    return per.groupBy("model").agg(F.round(F.coalesce(F.avg(F.when(F.col("n") >= V.MIN_DIM_ITEMS, F.col("acc"))), F.lit(0.0)), 6).alias("macro_dim"), F.count_if(F.col("n") >= V.MIN_DIM_ITEMS).alias("dims"))


def metrics_tier_weighted(spark: SparkSession, d: str) -> DataFrame:
    weight = F.lit(0.0)
    for t, w in V.TIER_WEIGHTS.items():
        weight = F.when(F.col("tier") == t, w).otherwise(weight)
    per = _scored(spark, d).groupBy("model", "tier").agg(F.avg(F.col("correct").cast("int")).alias("acc"))
    return per.groupBy("model").agg(F.round(F.sum(F.col("acc") * weight), 6).alias("tier_weighted"))


def metrics_hda(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("bucket").isin("variant_a", "variant_b")
    return _scored(spark, d).groupBy("model").agg(F.count_if(v).alias("n"), F.round(F.try_divide(F.count_if(v & F.col("correct")), F.count_if(v)), 6).alias("hda"))


def _key_of() -> Column:
    return F.coalesce(F.array_join("correct_order", ","), "correct_answer")


def frequency_baseline(spark: SparkSession, d: str) -> DataFrame:
    """Most common answer of each format; ties go to the answer of the smallest qa_id."""
    c = _items(spark, d).groupBy("format", _key_of().alias("answer")).agg(F.count(F.lit(1)).alias("n"), F.min("qa_id").alias("first"))
    w = Window.partitionBy("format").orderBy(F.desc("n"), "first")
    return c.withColumn("r", F.row_number().over(w)).where("r = 1").select("format", "answer", "n")


def answer_distribution(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d).groupBy("format", _key_of().alias("answer")).agg(F.count(F.lit(1)).alias("n"))


def _hash(seed: str, *cols: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), *cols))


def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("dim").orderBy(_hash("42", "qa_id"))
    return _items(spark, d).withColumn("r", F.row_number().over(w)).where("r <= 20").select("qa_id", "dim")


def largest_remainder(spark: SparkSession, d: str, n: int = 100) -> DataFrame:
    """Quotas of n items by dim in proportion; what rounding leaves goes to the largest remainders, larger names first."""
    c = _items(spark, d).where("dim is not null").groupBy("dim").agg(F.count(F.lit(1)).alias("k"))
    t = c.agg(F.sum("k").alias("t"))
    q = c.join(F.broadcast(t)).withColumn("base", F.floor(F.col("k") * n / F.col("t"))).withColumn("rest", (F.col("k") * n) % F.col("t"))
    short = q.agg((F.lit(n) - F.sum("base")).alias("short"))
    r = q.withColumn("r", F.row_number().over(Window.orderBy(F.desc("rest"), F.desc("dim"))))
    return r.join(F.broadcast(short)).select("dim", (F.col("base") + (F.col("r") <= F.col("short")).cast("int")).alias("quota"))


def balance_answers(spark: SparkSession, d: str) -> DataFrame:
    """Per dim every answer is cut to the rarest answer's number; variant items (an answer of their own) are kept."""
    i = _items(spark, d).where("dim is not null").select("qa_id", "dim", "hallucination", F.coalesce(F.get("correct_order", F.lit(0)), "correct_answer").alias("key")).where("key is not null")
    free = i.where("hallucination is not null").select("qa_id", "dim")
    rest = i.where("hallucination is null")
    size = rest.groupBy("dim", "key").agg(F.count(F.lit(1)).alias("n"))
    quota = size.join(size.groupBy("dim").agg(F.min("n").alias("quota")), "dim").select(F.col("dim").alias("g"), F.col("key").alias("k"), "quota")
    kept = O.smallest(rest, ["dim", "key"], _hash("7", "qa_id"), quota, ["g", "k"]).where("place is not null")
    return kept.select("qa_id", "dim").unionByName(free)


def video_cap_roundrobin(spark: SparkSession, d: str, most: int = 8) -> DataFrame:
    """At most `most` items a video: all variants, then one dim after another. Of a dim of a video only the first `most` by hash can be chosen, so the order
    of turns is over few rows whatever the number of a video's items."""
    i = _items(spark, d).where("dim is not null and video_id is not null").select("qa_id", "video_id", "dim", F.col("hallucination").isNotNull().alias("v"))
    variants, rest = i.where("v"), i.where("not v")
    taken = variants.groupBy("video_id").agg(F.count(F.lit(1)).alias("taken"))
    quota = rest.select(F.col("video_id").alias("g"), F.col("dim").alias("k")).distinct().withColumn("quota", F.lit(most))
    first = O.smallest(rest, ["video_id", "dim"], _hash("5", "qa_id"), quota, ["g", "k"]).where("place is not null")
    turn = first.withColumn("turn", F.row_number().over(Window.partitionBy("video_id").orderBy("place", _hash("5", "dim"), "qa_id")))
    kept = turn.join(taken, "video_id", "left").where(F.col("turn") + F.coalesce("taken", F.lit(0)) <= most)
    return variants.select("qa_id", "video_id").unionByName(kept.select("qa_id", "video_id"))


def option_shuffle(spark: SparkSession, d: str) -> DataFrame:
    i = _items(spark, d).where("format = 'mcq_4' and option_a is not null and option_b is not null and option_c is not null and option_d is not null")
    o = i.select("qa_id", F.element_at(F.array("option_a", "option_b", "option_c", "option_d"), F.ascii("correct_answer") - 64).alias("right"), F.posexplode(F.array("option_a", "option_b", "option_c", "option_d")).alias("k", "text"))
    r = o.withColumn("r", F.row_number().over(Window.partitionBy("qa_id").orderBy(_hash("3", "qa_id", "text"), "k")))
    return r.groupBy("qa_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "text"))), lambda x: x["text"]), "|").alias("options"), F.min(F.when(F.col("text") == F.col("right"), F.char(64 + F.col("r")))).alias("answer"))


def ordering_validity(spark: SparkSession, d: str) -> DataFrame:
    k = F.regexp_extract("format", r"([0-9]+)$", 1).cast("int")
    o = F.col("correct_order")
    reason = F.when(o.isNull() | (F.size(o) == 0), "missing").when(F.size(o) != k, "length").when(F.size(F.array_distinct(o)) != F.size(o), "repeated").when(F.exists(o, lambda x: ~x.isin("A", "B", "C", "D")), "letter").otherwise("ok")
    return _items(spark, d).where("format like 'ordering%'").select("qa_id", reason.alias("reason"))


def item_verification(spark: SparkSession, d: str) -> DataFrame:
    """Checks of polished against raw text: empty, short question, word overlap, statement ratio, repeated options."""
    i = _items(spark, d)
    words = lambda c: F.array_distinct(F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " ")), " "))
    raw, pol = words(F.col("question")), words(F.col("polished_question"))
    share = F.size(F.array_intersect(raw, pol)) / F.greatest(F.lit(1), F.size(raw))
    options = F.filter(F.array(*(f"polished_option_{x}" for x in "abcd")), lambda x: x.isNotNull())
    ratio = F.length("polished_statement_a") / F.greatest(F.lit(1), F.length("polished_statement_b"))
    checks = [
        (F.coalesce("polished_question", F.lit("")) == "", "no_question"),
        (F.length("polished_question") < 5, "short_question"),
        (share < 0.25, "low_overlap"),
        (F.size(F.array_distinct(options)) < F.size(options), "repeated_options"),
        ((ratio > 3) | (ratio < 1 / 3), "statement_ratio"),
    ]
    found = F.filter(F.array(*(F.when(c, n) for c, n in checks)), lambda x: x.isNotNull())
    return i.select("qa_id", F.array_join(found, ",").alias("issues"))


def label_parse(spark: SparkSession, d: str) -> DataFrame:
    o = R.objects(R.documents(load(spark, d, "tracks"))).select("video_id", "obj_id", "label", label_parts(F.col("label")).alias("p"))
    return o.select("video_id", "obj_id", "label", "p.base", "p.modifiers", "p.digit")


def sibling_groups(spark: SparkSession, d: str) -> DataFrame:
    return label_parse(spark, d).where("base <> ''").groupBy("video_id", "base").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("obj_id")).cast("array<string>"), ",").alias("members")).where("n >= 2")


def label_numbering(spark: SparkSession, d: str) -> DataFrame:
    """The second and later objects of a label in a video get a number."""
    o = R.objects(R.documents(load(spark, d, "tracks"))).withColumn("bare", F.regexp_replace("label", r"\s*#[0-9]+$", ""))
    r = F.row_number().over(Window.partitionBy("video_id", "bare").orderBy("track_ord"))
    return o.select("video_id", "obj_id", F.when(r > 1, F.concat("bare", F.lit(" #"), r)).otherwise(F.col("bare")).alias("label"))


def resume_todo(spark: SparkSession, d: str) -> DataFrame:
    """Items that some model of the registry has still to answer, with the number of such models: those without an error-free prediction."""
    models = load(spark, d, "model_registry").select(key_text(F.col("model")).alias("model")).distinct()
    done = load(spark, d, "preds").where("error is null").select(key_text(F.col("qa_id")).alias("qa_id"), key_text(F.col("model")).alias("model")).distinct()
    n = models.agg(F.count(F.lit(1)).alias("models"))
    counted = done.join(models, "model", "left_semi").groupBy("qa_id").agg(F.count(F.lit(1)).alias("done"))
    i = _items(spark, d).select(key_text(F.col("qa_id")).alias("qa_id")).distinct().join(counted, "qa_id", "left").join(F.broadcast(n))
    return i.select("qa_id", (F.col("models") - F.coalesce("done", F.lit(0))).alias("todo")).where("todo > 0")


def todo(items: DataFrame, preds: DataFrame, model: str) -> DataFrame:
    """qa_id of the items without an error-free prediction of one model."""
    done = preds.where("error is null").where(key_text(F.col("model")) == F.lit(model.strip().lower())).select(key_text(F.col("qa_id")).alias("qa_id")).distinct()
    return items.select(key_text(F.col("qa_id")).alias("qa_id")).distinct().join(done, "qa_id", "left_anti")


def shard_slice(spark: SparkSession, d: str, shards: int = 4) -> DataFrame:
    i = _items(spark, d).select("qa_id")
    n = i.agg(F.count(F.lit(1)).alias("n"))
    r = ordinal(i, [F.col("qa_id")], "r").join(F.broadcast(n))
    return r.select("qa_id", F.floor(F.col("r") / F.ceil(F.col("n") / shards)).cast("int").alias("shard"))


def frame_sampling(spark: SparkSession, d: str, k: int = 8) -> DataFrame:
    """k frames of each video: with both ends, and by floor(i n / k) without the last."""
    doc = R.documents(load(spark, d, "tracks")).select("video_id", F.size("timestamps").alias("n")).where("n > 1")
    i = doc.select("video_id", "n", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("i"))
    return i.select("video_id", "i", F.expr(f"int(i * (n - 1) div {k - 1})").alias("inclusive"), F.expr(f"int(i * n div {k})").alias("exclusive"))


def hallucination_roll(spark: SparkSession, d: str) -> DataFrame:
    u = F.conv(F.substring(_hash("11", "qa_id"), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    return _items(spark, d).select("qa_id", F.when(u < 0.05, "question").when(u < 0.15, "distractor").otherwise("none").alias("roll"))


def subset_overlap(spark: SparkSession, d: str) -> DataFrame:
    i = _items(spark, d).where("video_id is not null")
    a, b = i.where("tier = 'tier1'").select("video_id"), i.where("tier = 'tier2'").select("video_id")
    return a.intersect(b)


def light_polish(spark: SparkSession, d: str) -> DataFrame:
    q = F.trim("question")
    asks = F.lower(q).rlike("^(what|which|when|where|who|why|how|does|do|did|is|are|was|were|of|in|at|on|for|during|once)\\b")
    cap = F.concat(F.upper(F.substring(q, 1, 1)), F.substring(q, 2, 100000))
    return _items(spark, d).where("question is not null").select("qa_id", F.when(cap.rlike("[.?!]$"), cap).when(asks, F.concat(cap, F.lit("?"))).otherwise(F.concat(cap, F.lit("."))).alias("text"))


def clean_projection(spark: SparkSession, d: str) -> DataFrame:
    """Polished text where there is some, else the raw one."""
    pick = lambda p, r: F.trim(F.coalesce(F.nullif(F.trim(p), F.lit("")), F.nullif(F.trim(r), F.lit("")), F.lit("")))
    return _items(spark, d).select("qa_id", "format", pick("polished_question", "question").alias("question"), *(pick(f"polished_option_{x}", f"option_{x}").alias(f"option_{x}") for x in "abcd"), _key_of().alias("answer"))


def registry_status(spark: SparkSession, d: str) -> DataFrame:
    r = load(spark, d, "video_registry").where("path is not null").dropDuplicates(["path"])
    return r.groupBy("source", "format").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("video_id").alias("videos"))


QUERIES = {f.__name__: f for f in (
    extracted_answers, extraction_agreement, preds_last_wins, score_items, metrics_overall, metrics_by_group, metrics_grouping_sets, metrics_macro_dim, metrics_tier_weighted, metrics_hda, frequency_baseline, answer_distribution,
    stratified_sample, largest_remainder, balance_answers, video_cap_roundrobin, option_shuffle, ordering_validity, item_verification,
    label_parse, sibling_groups, label_numbering, resume_todo, shard_slice, frame_sampling, hallucination_roll, subset_overlap, light_polish, clean_projection, registry_status,
)}
