"""Queries of the strict and the lenient extraction of answers, and of replies' forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions import strict as S
from trackloom.functions.text import key_text
from trackloom.plans.items import _items
from trackloom.plans.items_sql import _EXTRACT, _QA, ITEMS
from trackloom.tables import load


def _with_items(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Predictions as delivered, with columns of their items; the text-heavy side is joined by its key only."""
    p = load(spark, d, "preds").select("delivery_id", key_text(F.col("qa_id")).alias("k"), "format", "raw_response")
    i = _items(spark, d).select(key_text(F.col("qa_id")).alias("k"), *columns)
    return p.join(i, "k", "left")


def extract_strict(spark: SparkSession, d: str) -> DataFrame:
    """Answer of every delivery by the rules of the necessity filter."""
    j = _with_items(spark, d, "correct_order")
    return j.where("format is not null").select("delivery_id", S.extract_strict(F.col("raw_response"), F.col("format"), F.col("correct_order")).alias("answer"))


def extractor_disagreement(spark: SparkSession, d: str) -> DataFrame:
    """Where the two sets of rules differ, by format."""
    from trackloom.functions import answers as A

    j = _with_items(spark, d, "correct_order").where("format is not null")
    one, two = A.extract(F.col("raw_response"), F.col("format")), S.extract_strict(F.col("raw_response"), F.col("format"), F.col("correct_order"))
    return j.groupBy("format").agg(F.count(F.lit(1)).alias("n"), F.count_if(~one.eqNullSafe(two)).alias("differ"), F.count_if(one.isNull() & two.isNotNull()).alias("only_strict"), F.count_if(one.isNotNull() & two.isNull()).alias("only_usual"))


def normalize_match(spark: SparkSession, d: str) -> DataFrame:
    """Answers found by number words or by the text of the one option or statement that fits, where the usual extraction finds none."""
    j = _with_items(spark, d, *(f"option_{x}" for x in "abcd"), "statement_a", "statement_b").where("format is not null")
    pick = lambda *names: F.coalesce(*(F.nullif(F.col(n), F.lit("")) for n in names))
    choices = [pick("option_a", "statement_a"), pick("option_b", "statement_b"), F.nullif(F.col("option_c"), F.lit("")), F.nullif(F.col("option_d"), F.lit(""))]
    return j.select("delivery_id", S.fallback(F.col("raw_response"), F.col("format"), choices).alias("answer"))


def strip_thinking(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "preds").where("raw_response is not null")
    return p.select("delivery_id", F.length(S.without_thinking(p["raw_response"])).alias("length"))


def token_budgets(spark: SparkSession, d: str) -> DataFrame:
    """Most tokens a reply of each model may have, by format; the registry is a small table of models."""
    m = load(spark, d, "model_registry").select("model", "is_thinking")
    f = _items(spark, d).select("format").where("format is not null").distinct()
    # the registry as one row
    listed = m.agg(F.collect_list(F.struct("model", "is_thinking")).alias("models"))
    return f.join(F.broadcast(listed)).select("format", F.inline("models")).select("model", "format", S.token_budget(F.col("format"), F.col("is_thinking")).alias("tokens"))


QUERIES = {f.__name__: f for f in (extract_strict, extractor_disagreement, normalize_match, strip_thinking, token_budgets)}

_N = r"[^\p{L}\p{N}_]"
_TRIM = r"regexp_replace(raw_response, '^\s+|\s+$', '', 'g')"


def _letter(one: str) -> str:
    allowed = ", ".join(f"'{x}'" for x in one.split("|"))
    return rf"""coalesce(CASE WHEN t IN ({allowed}) THEN t END, nullif(regexp_extract(t, 'ANSWER\s*[:\-]?\s*({one})(?:{_N}|$)', 1), ''), nullif(regexp_extract(t, '(?:^|[^A-Z])({one})\s*[.,):\]"'']', 1), ''), nullif(regexp_extract(t, '(?:^|\s)({one})(?:\s|$)', 1), ''))"""


_STRICT = rf"""WITH {ITEMS}, keyed AS (SELECT {_QA} AS k, * FROM items), j AS (SELECT p.delivery_id, p.format, p.raw_response, i.correct_order FROM preds p LEFT JOIN keyed i ON i.k = {_QA.replace('qa_id', 'p.qa_id')} WHERE p.format IS NOT NULL),
    u AS (SELECT *, upper({_TRIM}) AS t, coalesce(len(correct_order), CASE WHEN format = 'ordering_4' THEN 4 ELSE 3 END) AS k, ltrim(regexp_extract(raw_response, '(?:^|{_N})([0-9]+)(?:{_N}|$)', 1), '0') AS num FROM j),
    chars AS (SELECT *, list_filter(string_split(upper(raw_response), ''), lambda x: x IN ('A', 'B', 'C', 'D', 'E', 'F', 'G', 'H') AND ascii(x) - 64 <= k) AS all_letters FROM u),
    letters AS (SELECT *, list_filter(all_letters, lambda x, i: list_position(all_letters, x) = i) AS uniq FROM chars),
    strict AS (SELECT *, CASE WHEN coalesce(raw_response, '') = '' THEN NULL WHEN format LIKE 'ordering\_%' ESCAPE '\' THEN CASE WHEN len(uniq) = k THEN array_to_string(uniq, ',') END
        WHEN format = 'sp' THEN {_letter('A|B')}
        WHEN format = 'numerical' THEN CASE WHEN regexp_matches(raw_response, '(?i)(?:^|{_N})[0-9]+\s*\+?\s*or\s+more(?:{_N}|$)') OR regexp_matches(raw_response, '(?i)(?:^|{_N})(?:five|5)(?:{_N}|$)') OR length(num) > 1 OR num IN ('5', '6', '7', '8', '9') THEN '5 or more' WHEN num IN ('2', '3', '4') THEN num END
        ELSE {_letter('A|B|C|D')} END AS answer FROM letters)"""
_NORM = "trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9\\s]+', ' ', 'g'), '\\s+', ' ', 'g'))"
_WORDS = " ".join(f"WHEN regexp_matches(t, '(?:^| ){w}(?: |$)') THEN '{n}'" for w, n in S.NUMBER_WORDS)
_HIT = "(contains(t, o{0}) OR contains(o{0}, t) OR len(list_intersect(list_distinct(string_split(t, ' ')), list_distinct(string_split(o{0}, ' ')))) / len(list_distinct(string_split(o{0}, ' ')))::DOUBLE >= 0.7)"
_HITS = ", ".join(f"CASE WHEN coalesce(o{x}, '') <> '' AND {_HIT.format(x)} AND (format = 'mcq_4' OR (format = 'sp' AND '{x}' IN ('a', 'b'))) THEN '{x.upper()}' END" for x in "abcd")
SQL = {
    "extract_strict": _STRICT + " SELECT delivery_id, answer FROM strict",
    "extractor_disagreement": "WITH one AS (" + _EXTRACT + " SELECT delivery_id, answer FROM answers), two AS (" + _STRICT + " SELECT delivery_id, format, answer FROM strict) SELECT format, count(*) AS n, count(*) FILTER (one.answer IS DISTINCT FROM two.answer) AS differ, count(*) FILTER (one.answer IS NULL AND two.answer IS NOT NULL) AS only_strict, count(*) FILTER (one.answer IS NOT NULL AND two.answer IS NULL) AS only_usual FROM one JOIN two USING (delivery_id) GROUP BY format",
    "normalize_match": "WITH base AS (" + _EXTRACT + f" SELECT delivery_id, answer FROM answers), {ITEMS}, keyed AS (SELECT {_QA} AS k, * FROM items), "
    + f"j AS (SELECT p.delivery_id, p.format, p.raw_response, b.answer AS usual, {_NORM.format('p.raw_response')} AS t, " + ", ".join(_NORM.format(f"coalesce(nullif(option_{x}, ''), nullif(statement_{x}, ''))" if x in "ab" else f"nullif(option_{x}, '')") + f" AS o{x}" for x in "abcd")
    + f" FROM preds p JOIN base b USING (delivery_id) LEFT JOIN keyed i ON i.k = {_QA.replace('qa_id', 'p.qa_id')} WHERE p.format IS NOT NULL), h AS (SELECT *, list_filter([{_HITS}], lambda x: x IS NOT NULL) AS hits FROM j)"
    + f" SELECT delivery_id, coalesce(usual, CASE WHEN coalesce(raw_response, '') = '' THEN NULL WHEN format = 'numerical' THEN CASE WHEN regexp_matches(t, '(?:^| )(?:5\\s*or\\s*more|five or more|at least five)(?: |$)') THEN '5 or more' {_WORDS} END WHEN len(hits) = 1 THEN hits[1] END) AS answer FROM h",
    "strip_thinking": r"""WITH a AS (SELECT delivery_id, regexp_replace(raw_response, '(?s)<think>.*?</think>', '', 'g') AS t FROM preds WHERE raw_response IS NOT NULL), b AS (SELECT delivery_id, CASE WHEN contains(t, '<think>') AND NOT contains(t, '</think>') THEN string_split(t, '<think>')[1] ELSE t END AS t FROM a)
        SELECT delivery_id, length(regexp_replace(t, '^\s+|\s+$', '', 'g'))::INT AS length FROM b""",
    "token_budgets": f"WITH {ITEMS} SELECT model, format, CASE WHEN is_thinking THEN 18432 WHEN format LIKE 'ordering%' THEN 256 ELSE 64 END AS tokens FROM (SELECT DISTINCT format FROM items WHERE format IS NOT NULL), model_registry",
}
