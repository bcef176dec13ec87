"""Queries of the training-data operators for texts, sequences and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import abuse, mixing, pairs, quota, residue, runs, tokens, truncation
from trackloom.llm.sql import SQL as SQL
from trackloom.tables import load

FIELDS = ["dim", "tier", "format"]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of at least two like frames."""
    return runs.collapse_runs(load(spark, sf_dir, "tracks")).where("n_frames >= 2").select("video_id", "obj_id", "start_frame", "end_frame").distinct()


def p2_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run, single frames included, with its number of frames and duration."""
    return runs.collapse_runs(load(spark, sf_dir, "tracks"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defective messages, each with its likeliest defect."""
    return pairs.found(load(spark, sf_dir, "preds"), load(spark, sf_dir, "qa_items"))


def p3_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every defect kept for a message, with its posterior."""
    return pairs.labelled(load(spark, sf_dir, "preds"), load(spark, sf_dir, "qa_items")).drop("rank")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with template residue or error text."""
    return residue.found(load(spark, sf_dir, "qa_items"))


def p4_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items without residue (as delivered, copies included): identifier, fields and scores."""
    items = load(spark, sf_dir, "qa_items")
    narrow = items.select("qa_id", "video_id", "dim", "format", *residue.FIELDS)
    return residue.scored(narrow, residue.train(items)).where("not residue").drop("residue")


def p4_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak label against decision of the classifier, on texts of videos it never saw."""
    return residue.validation(load(spark, sf_dir, "qa_items"))


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets and what the sample reaches, by category."""
    return quota.draw(load(spark, sf_dir, "qa_items"), load(spark, sf_dir, "sample_targets"), FIELDS)[1]


def p5_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drawn items."""
    return quota.draw(load(spark, sf_dir, "qa_items"), load(spark, sf_dir, "sample_targets"), FIELDS)[0]


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages whose response breaks off."""
    return truncation.judged(load(spark, sf_dir, "preds"), load(spark, sf_dir, "qa_items")).where("truncated").select("qa_id", "model")


def p6_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of truncated responses by model."""
    return truncation.rates(load(spark, sf_dir, "preds"), load(spark, sf_dir, "qa_items"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encode_corpus(load(spark, sf_dir, "documents"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen documents with copy number and virtual finish time."""
    return mixing.mix(mixing.sized(load(spark, sf_dir, "documents")), load(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares of the sources."""
    from trackloom.session import cut

    docs, targets = cut(mixing.sized(load(spark, sf_dir, "documents"))), load(spark, sf_dir, "mix_targets")
    return mixing.shares(mixing.mix(docs, targets), docs, targets)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with an offending passage."""
    return abuse.scored(load(spark, sf_dir, "documents"), load(spark, sf_dir, "doc_reviews")).where("offending").select("doc_id").distinct()


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document."""
    return abuse.scored(load(spark, sf_dir, "documents"), load(spark, sf_dir, "doc_reviews"))


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offending documents by source."""
    return abuse.rates(load(spark, sf_dir, "documents"), load(spark, sf_dir, "doc_reviews"))


QUERIES = {
    "p2_found": p2_found,
    "p2_collapsed": p2_collapsed,
    "p3_found": p3_found,
    "p3_labels": p3_labels,
    "p4_found": p4_found,
    "p4_clean": p4_clean,
    "p4_validation": p4_validation,
    "p5_sample": p5_sample,
    "p5_report": p5_report,
    "p6_found": p6_found,
    "p6_rates": p6_rates,
    "p8_ids": p8_ids,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_scores": p10_scores,
    "p10_rates": p10_rates,
}
