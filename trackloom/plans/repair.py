"""Queries of the item repair chain: letter case, pairs, identity pairs, four options and orders; and checks of polished texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom import vocab as V
from trackloom.operators import answers as O
from trackloom.plans.items import _hash, _items
from trackloom.plans.items_sql import ITEMS

_TEXTS = ["statement_a", "statement_b", "option_a", "option_b", "option_c", "option_d"]


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return O.upper_answers(_items(spark, d).where("format = 'sp'").select("qa_id", "dim", "correct_answer", *_TEXTS)).where("correct_answer in ('A', 'B')").drop("repaired")


def answer_case(spark: SparkSession, d: str) -> DataFrame:
    return O.upper_answers(_items(spark, d).select("qa_id", "correct_answer")).select("qa_id", F.col("correct_answer").alias("answer"), "repaired")


def sp_rebalance(spark: SparkSession, d: str) -> DataFrame:
    """Half the surplus of A answers is swapped to B, in hash order; only where A leads."""
    r = O.rebalance_pairs(_pairs(spark, d), _hash("9", "qa_id"))
    return r.select("qa_id", F.col("correct_answer").alias("answer"), "flipped", "statement_a", "statement_b", "option_a", "option_b")


def reid_rebalance(spark: SparkSession, d: str) -> DataFrame:
    """Identity items after the rebalancing of pairs: half of them, in order of the identifier's hash, end with A."""
    after = O.rebalance_pairs(_pairs(spark, d), _hash("9", "qa_id")).drop("flipped").where("dim = 'reappear_identity'")
    r = O.rebalance_identity(after, _hash("10", "qa_id"))
    return r.select("qa_id", F.col("correct_answer").alias("answer"), "flipped", "statement_a", "statement_b")


def mcq_rebalance(spark: SparkSession, d: str) -> DataFrame:
    i = O.upper_answers(_items(spark, d).where("format = 'mcq_4'").select("qa_id", "correct_answer", *_TEXTS[2:])).where("correct_answer in ('A', 'B', 'C', 'D')").drop("repaired")
    r = O.rebalance_options(i, _hash("12", "qa_id"))
    return r.select("qa_id", F.col("correct_answer").alias("answer"), "moved", *(f"option_{x}" for x in "abcd"))


def repair_summary(spark: SparkSession, d: str) -> DataFrame:
    """Items by format, answer and whether the repair changed it, over the whole chain; broken orders are left out."""
    i = _items(spark, d)
    pairs = reid_then_pairs(spark, d)
    options = mcq_rebalance(spark, d).select("qa_id", F.lit("mcq_4").alias("format"), "answer", F.col("moved").alias("changed"))
    k = F.regexp_extract("format", r"([0-9]+)$", 1).cast("int")
    o = F.col("correct_order")
    good = (F.size(o) == k) & (F.size(F.array_distinct(o)) == F.size(o)) & F.forall(o, lambda x: x.isin("A", "B", "C", "D"))
    orders = i.where("format like 'ordering%'").where(good).select("qa_id", "format", F.array_join("correct_order", ",").alias("answer"), F.lit(False).alias("changed"))
    numbers = i.where("format = 'numerical'").select("qa_id", "format", F.col("correct_answer").alias("answer"), F.lit(False).alias("changed"))
    every = pairs.unionByName(options).unionByName(orders).unionByName(numbers)
    return every.groupBy("format", "answer").agg(F.count(F.lit(1)).alias("n"), F.count_if("changed").alias("changed"))


def reid_then_pairs(spark: SparkSession, d: str) -> DataFrame:
    """qa_id, format, answer, changed of all pairs after both rebalancings."""
    first = O.rebalance_pairs(_pairs(spark, d), _hash("9", "qa_id")).withColumnRenamed("flipped", "changed")
    same = F.coalesce(F.col("dim") == "reappear_identity", F.lit(False))
    second = O.rebalance_identity(first.where(same), _hash("10", "qa_id")).withColumn("changed", F.col("changed") != F.col("flipped")).drop("flipped")
    return first.where(~same).unionByName(second).select("qa_id", F.lit("sp").alias("format"), F.col("correct_answer").alias("answer"), "changed")


def _locked(column: str, labels: list[str]) -> Column:
    """First label that the text holds."""
    return F.get(F.filter(F.array(*map(F.lit, labels)), lambda x: F.contains(F.lower(F.coalesce(column, F.lit(""))), x)), F.lit(0))


def lock_checks(spark: SparkSession, d: str) -> DataFrame:
    """Phrases that must survive polishing: a dimension's labels in every option or statement, the patterns of made-up subjects, and numerical answers."""
    c = F.col
    holds = lambda col, mark: F.coalesce(F.contains(F.lower(col), F.lit(mark)), F.lit(False))
    issues = []
    for dim, labels in V.LOCKS.items():
        for fmt, kind, letters in (("mcq_4", "option", "abcd"), ("sp", "statement", "ab")):
            if fmt == "mcq_4" and dim == "reappear_identity":
                continue
            for x in letters:
                label = _locked(f"{kind}_{x}", labels)
                issues.append(F.when((c("dim") == dim) & (c("format") == fmt) & label.isNotNull() & ~F.coalesce(F.contains(F.lower(f"polished_{kind}_{x}"), label), F.lit(False)), F.concat(F.lit(f"{kind}_{x} ("), label, F.lit(")"))))
    letters = F.array(*map(F.lit, "ABCD"))
    at = F.array_position(letters, c("correct_answer")).cast("int")
    polished = F.array(*(F.coalesce(f"polished_option_{x}", F.lit("")) for x in "abcd"))
    raw = F.array(*(F.coalesce(f"option_{x}", F.lit("")) for x in "abcd"))
    right = F.when(at > 0, F.element_at(polished, at))
    wrong = lambda texts, mark: F.exists(F.arrays_zip(texts.alias("t"), letters.alias("l")), lambda z: (z["l"] != F.coalesce("correct_answer", F.lit(""))) & F.contains(F.lower(z["t"]), F.lit(mark)))
    four = c("format") == "mcq_4"
    tag = F.coalesce("hallucination", F.lit(""))
    for name, mark in (("a", V.MADE_UP_A), ("b", V.MADE_UP_B)):
        issues.append(F.when(four & (tag == f"variant_{name}") & ~holds(right, mark), f"hallu_{name}_lost"))
        issues.append(F.when(four & ~tag.isin("variant_a", "variant_b") & F.coalesce("has_hallucination_distractor", F.lit(False)) & wrong(raw, mark) & ~wrong(polished, mark), f"hallu_distractor_{name}_lost"))
    issues.append(F.when((c("format") == "numerical") & (F.coalesce("correct_answer", F.lit("")) != "5 or more") & ~F.coalesce(c("correct_answer").rlike("^[0-9]+$"), F.lit(False)), "numerical_answer_invalid"))
    found = F.filter(F.array(*issues), lambda x: x.isNotNull())
    return _items(spark, d).select("qa_id", F.array_join(found, ",").alias("issues"))


def rolled_back(spark: SparkSession, d: str) -> DataFrame:
    """Field by field: a blank or lock-breaking polished text gives way to the raw one."""
    locks = lock_checks(spark, d)
    i = _items(spark, d).join(locks, "qa_id")
    fields = ["question", *(f"option_{x}" for x in "abcd"), "statement_a", "statement_b"]
    broken = lambda f: F.contains("issues", F.lit(f"{f} (")) | F.contains("issues", F.lit("hallu_")) if f.startswith("option") else F.contains("issues", F.lit(f"{f} ("))
    pick = lambda f: F.when(broken(f), F.col(f)).otherwise(F.coalesce(F.nullif(F.trim(f"polished_{f}"), F.lit("")), F.col(f))).alias(f)
    back = lambda f: F.when(F.col(f).isNotNull() & (broken(f) | (F.trim(F.coalesce(f"polished_{f}", F.lit(""))) == "")), f)
    names = F.filter(F.array(*map(back, fields)), lambda x: x.isNotNull())
    return i.select("qa_id", *map(pick, fields), F.array_join(names, ",").alias("rolled_back"))


def skeleton_validity(spark: SparkSession, d: str) -> DataFrame:
    """What an item lacks: basic fields, the texts and answer that its format needs."""
    c = F.col
    blank = lambda f: F.trim(F.coalesce(f, F.lit(""))) == ""
    fmt = F.coalesce("format", F.lit(""))
    checks = [F.when(F.coalesce(f, F.lit("")) == "", f) for f in ("skeleton_id", "video_id", "dim", "format", "question")]
    whole = [F.coalesce(f, F.lit("")) != "" for f in ("skeleton_id", "video_id", "dim", "format", "question")]
    ready = whole[0] & whole[1] & whole[2] & whole[3] & whole[4]
    checks += [F.when(ready & (fmt == "mcq_4") & blank(f), f) for f in (*(f"option_{x}" for x in "abcd"), "correct_answer")]
    checks += [F.when(ready & (fmt == "sp") & blank(f), f) for f in ("statement_a", "statement_b", "correct_answer")]
    allowed = F.when(fmt == "mcq_4", c("correct_answer").isin("A", "B", "C", "D")).when(fmt == "sp", c("correct_answer").isin("A", "B"))
    checks.append(F.when(ready & fmt.isin("mcq_4", "sp") & ~F.coalesce(allowed, F.lit(False)), "correct_answer_invalid"))
    checks.append(F.when(ready & (fmt == "numerical") & blank("correct_answer"), "correct_answer"))
    order = fmt.startswith("ordering_")
    checks.append(F.when(ready & order & (F.coalesce(F.size("events"), F.lit(0)) <= 0), "events"))
    checks.append(F.when(ready & order & F.exists("events", lambda e: (F.coalesce(e["label"], F.lit("")) == "") | (F.coalesce(e["event_text"], F.lit("")) == "")), "events_incomplete"))
    checks.append(F.when(ready & order & (F.coalesce(F.size("correct_order"), F.lit(0)) <= 0), "correct_order"))
    checks.append(F.when(ready & ~(fmt.isin("mcq_4", "sp", "numerical") | order), "unknown_format"))
    found = F.filter(F.array(*checks), lambda x: x.isNotNull())
    return _items(spark, d).select("qa_id", F.array_join(found, ",").alias("missing"))


def realization_counts(spark: SparkSession, d: str) -> DataFrame:
    """Polished items by dimension, format, tier, method, tag and outcome, and by issue (its name before the bracket), in one pass."""
    i = _items(spark, d).withColumn("tag", F.coalesce("hallucination", F.when(F.col("has_hallucination_distractor"), "distractor_only"), F.lit("none"))).withColumn("outcome", F.coalesce("verification_passed", F.lit(True)).cast("string"))
    groups = [F.struct(F.lit(g).alias("grouping"), F.coalesce(c, F.lit("unknown")).alias("value")) for g, c in (("dim", "dim"), ("format", "format"), ("tier", "tier"), ("method", "realization_method"), ("tag", "tag"), ("outcome", "outcome"))]
    issues = F.transform(F.coalesce("verification_issues", F.array().cast("array<string>")), lambda x: F.struct(F.lit("issue").alias("grouping"), F.trim(F.substring_index(x, "(", 1)).alias("value")))
    return i.select(F.explode(F.concat(F.array(*groups), issues)).alias("g")).groupBy("g.grouping", "g.value").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (answer_case, sp_rebalance, reid_rebalance, mcq_rebalance, repair_summary, lock_checks, rolled_back, skeleton_validity, realization_counts)}

_CASED = f"WITH {ITEMS}, cased AS (SELECT * REPLACE (CASE WHEN correct_answer IN ('a', 'b', 'c', 'd') THEN upper(correct_answer) ELSE correct_answer END AS correct_answer) FROM items)"
_SP = _CASED + """, sp AS (SELECT *, statement_a IS NOT NULL AND statement_b IS NOT NULL AS stated, option_a IS NOT NULL AND option_b IS NOT NULL AS optional, row_number() OVER (PARTITION BY correct_answer ORDER BY md5('9:' || qa_id)) AS r FROM cased WHERE format = 'sp' AND correct_answer IN ('A', 'B')),
    n AS (SELECT greatest(0, floor((count(*) FILTER (correct_answer = 'A') - count(*) FILTER (correct_answer = 'B')) / 2.0)) AS flips FROM sp),
    f AS (SELECT sp.*, correct_answer = 'A' AND r <= flips AND (stated OR optional) AS flipped FROM sp, n),
    one AS (SELECT qa_id, dim, flipped, CASE WHEN flipped THEN 'B' ELSE correct_answer END AS answer, CASE WHEN flipped AND stated THEN statement_b ELSE statement_a END AS statement_a, CASE WHEN flipped AND stated THEN statement_a ELSE statement_b END AS statement_b,
        CASE WHEN flipped AND NOT stated THEN option_b ELSE option_a END AS option_a, CASE WHEN flipped AND NOT stated THEN option_a ELSE option_b END AS option_b FROM f)"""
_REID = _SP + """, ri AS (SELECT * EXCLUDE (flipped), flipped AS before, row_number() OVER (PARTITION BY answer ORDER BY md5('10:' || qa_id)) AS r FROM one WHERE dim = 'reappear_identity'),
    rn AS (SELECT count(*) FILTER (answer = 'A') - count(*) // 2 AS over_ FROM ri),
    rf AS (SELECT ri.*, answer = CASE WHEN over_ > 0 THEN 'A' ELSE 'B' END AND r <= abs(over_) AND ((statement_a IS NOT NULL AND statement_b IS NOT NULL) OR (option_a IS NOT NULL AND option_b IS NOT NULL)) AS flipped FROM ri, rn),
    two AS (SELECT qa_id, before, flipped, CASE WHEN flipped THEN translate(answer, 'AB', 'BA') ELSE answer END AS answer, CASE WHEN flipped THEN statement_b ELSE statement_a END AS statement_a, CASE WHEN flipped THEN statement_a ELSE statement_b END AS statement_b FROM rf)"""
_FIELDS = ["skeleton_id", "video_id", "dim", "format", "question"]
_READY = " AND ".join(f"coalesce({f}, '') <> ''" for f in _FIELDS)
_LISTED = ["CASE WHEN coalesce({0}, '') = '' THEN '{0}' END".format(f) for f in _FIELDS]
_LISTED += [f"CASE WHEN ready AND format = 'mcq_4' AND trim(coalesce({f}, '')) = '' THEN '{f}' END" for f in ("option_a", "option_b", "option_c", "option_d", "correct_answer")]
_LISTED += [f"CASE WHEN ready AND format = 'sp' AND trim(coalesce({f}, '')) = '' THEN '{f}' END" for f in ("statement_a", "statement_b", "correct_answer")]
_LISTED += ["CASE WHEN ready AND ((format = 'mcq_4' AND coalesce(correct_answer, '') NOT IN ('A', 'B', 'C', 'D')) OR (format = 'sp' AND coalesce(correct_answer, '') NOT IN ('A', 'B'))) THEN 'correct_answer_invalid' END", "CASE WHEN ready AND format = 'numerical' AND trim(coalesce(correct_answer, '')) = '' THEN 'correct_answer' END",
    "CASE WHEN ready AND format LIKE 'ordering%' AND coalesce(len(events), 0) = 0 THEN 'events' END", "CASE WHEN ready AND format LIKE 'ordering%' AND len(list_filter(events, lambda e: coalesce(e.label, '') = '' OR coalesce(e.event_text, '') = '')) > 0 THEN 'events_incomplete' END",
    "CASE WHEN ready AND format LIKE 'ordering%' AND coalesce(len(correct_order), 0) = 0 THEN 'correct_order' END", "CASE WHEN ready AND format NOT IN ('mcq_4', 'sp', 'numerical') AND format NOT LIKE 'ordering%' THEN 'unknown_format' END"]


def _lock(kind: str, x: str, dim: str, labels: list[str], fmt: str) -> str:
    first = "list_filter([" + ", ".join(f"'{v}'" for v in labels) + f"], lambda v: contains(lower(coalesce({kind}_{x}, '')), v))[1]"
    return f"CASE WHEN dim = '{dim}' AND format = '{fmt}' AND {first} IS NOT NULL AND NOT coalesce(contains(lower(polished_{kind}_{x}), {first}), false) THEN '{kind}_{x} (' || {first} || ')' END"


_LOCKS = [_lock(kind, x, dim, labels, fmt) for dim, labels in V.LOCKS.items() for fmt, kind, letters in (("mcq_4", "option", "abcd"), ("sp", "statement", "ab")) if not (fmt == "mcq_4" and dim == "reappear_identity") for x in letters]
for _n, _m in (("a", V.MADE_UP_A), ("b", V.MADE_UP_B)):
    _LOCKS.append(f"CASE WHEN format = 'mcq_4' AND coalesce(hallucination, '') = 'variant_{_n}' AND NOT coalesce(contains(lower(pol[ascii(correct_answer) - 64]), '{_m}'), false) THEN 'hallu_{_n}_lost' END")
    _wrong = "len(list_filter({0}, lambda v, i: chr((64 + i)::INT) <> coalesce(correct_answer, '') AND contains(lower(v), '" + _m + "'))) > 0"
    _LOCKS.append(f"CASE WHEN format = 'mcq_4' AND coalesce(hallucination, '') NOT IN ('variant_a', 'variant_b') AND coalesce(has_hallucination_distractor, false) AND {_wrong.format('raw')} AND NOT {_wrong.format('pol')} THEN 'hallu_distractor_{_n}_lost' END")
_LOCKS.append("CASE WHEN format = 'numerical' AND coalesce(correct_answer, '') <> '5 or more' AND NOT coalesce(regexp_full_match(correct_answer, '[0-9]+'), false) THEN 'numerical_answer_invalid' END")
_LOCKED = f"WITH {ITEMS}, lists AS (SELECT *, [" + ", ".join(f"coalesce(polished_option_{x}, '')" for x in "abcd") + "] AS pol, [" + ", ".join(f"coalesce(option_{x}, '')" for x in "abcd") + "] AS raw FROM items), locks AS (SELECT *, array_to_string(list_filter([" + ", ".join(_LOCKS) + "], lambda x: x IS NOT NULL), ',') AS issues FROM lists)"
_BROKEN = {f: f"contains(issues, '{f} (')" + (" OR contains(issues, 'hallu_')" if f.startswith("option") else "") for f in ("question", "option_a", "option_b", "option_c", "option_d", "statement_a", "statement_b")}
SQL = {
    "answer_case": f"WITH {ITEMS} SELECT qa_id, CASE WHEN correct_answer IN ('a', 'b', 'c', 'd') THEN upper(correct_answer) ELSE correct_answer END AS answer, coalesce(correct_answer IN ('a', 'b', 'c', 'd'), false) AS repaired FROM items",
    "sp_rebalance": _SP + " SELECT qa_id, answer, flipped, statement_a, statement_b, option_a, option_b FROM one",
    "reid_rebalance": _REID + " SELECT qa_id, answer, flipped, statement_a, statement_b FROM two",
    "lock_checks": _LOCKED + " SELECT qa_id, issues FROM locks",
    "rolled_back": _LOCKED + " SELECT qa_id, " + ", ".join(f"CASE WHEN {b} THEN {f} ELSE coalesce(nullif(trim(polished_{f}), ''), {f}) END AS {f}" for f, b in _BROKEN.items()) + ", array_to_string(list_filter([" + ", ".join(f"CASE WHEN {f} IS NOT NULL AND ({b} OR trim(coalesce(polished_{f}, '')) = '') THEN '{f}' END" for f, b in _BROKEN.items()) + "], lambda x: x IS NOT NULL), ',') AS rolled_back FROM locks",
    "skeleton_validity": f"WITH {ITEMS}, r AS (SELECT *, {_READY} AS ready FROM items) SELECT qa_id, array_to_string(list_filter([" + ", ".join(_LISTED) + "], lambda x: x IS NOT NULL), ',') AS missing FROM r",
    "realization_counts": f"WITH {ITEMS}, t AS (SELECT *, coalesce(hallucination, CASE WHEN has_hallucination_distractor THEN 'distractor_only' END, 'none') AS tag, coalesce(verification_passed, true)::VARCHAR AS outcome FROM items) " + " UNION ALL ".join(f"SELECT '{g}' AS grouping, coalesce({c}, 'unknown') AS value, count(*) AS n FROM t GROUP BY 2" for g, c in (("dim", "dim"), ("format", "format"), ("tier", "tier"), ("method", "realization_method"), ("tag", "tag"), ("outcome", "outcome")))
    + " UNION ALL SELECT 'issue', trim(string_split(x, '(')[1]), count(*) FROM (SELECT unnest(verification_issues) AS x FROM t) GROUP BY 2",
}
