"""Queries of the general training-data operators: p1 (redelivered messages) and p7 (implausible readings)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.operators import delivery, spikes
from trackloom.tables import load

MESSAGE = ["qa_id", "model"]
LOG_ORDER = ["delivered_at", "delivery_id"]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with more than one row."""
    return delivery.redelivered(load(spark, sf_dir, "preds"), MESSAGE, LOG_ORDER)


def p1_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole prediction log with one row a message, the first delivered."""
    kept = delivery.keep_one(load(spark, sf_dir, "preds"), MESSAGE, LOG_ORDER)
    return kept.withColumn("extracted_answer", F.array_join("extracted_answer", ","))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged readings."""
    return spikes.flag_readings(load(spark, sf_dir, "tracks")).select("video_id", "obj_id", "frame").distinct()


def p7_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged readings per source and reason."""
    return spikes.rates(load(spark, sf_dir, "tracks"))


QUERIES = {"p1_found": p1_found, "p1_kept": p1_kept, "p7_found": p7_found, "p7_rates": p7_rates}

_KEY = r"lower(regexp_replace({0}, '^[\s\p{{Z}}\x{{200B}}\x{{FEFF}}]+|[\s\p{{Z}}\x{{200B}}\x{{FEFF}}]+$', '', 'g'))"
_QA, _MODEL = _KEY.format("qa_id"), _KEY.format("model")
SQL = {
    "p1_found": f"SELECT {_QA} AS qa_id, {_MODEL} AS model FROM preds WHERE qa_id IS NOT NULL AND model IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1",
    "p1_kept": f"""SELECT delivery_id, batch_id, delivered_at, qa_id, model, format, raw_response,
        array_to_string(extracted_answer, ',') AS extracted_answer, latency_s, error
        FROM preds QUALIFY row_number() OVER (PARTITION BY {_QA}, {_MODEL} ORDER BY delivered_at NULLS LAST, delivery_id) = 1""",
}
