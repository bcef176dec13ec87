"""Mixing sources to target shares of the total size.

Method: weighted fair queueing. The documents of a source stand in an order shuffled by hash, copy by copy; a
document's virtual finish time is the tokens of its source up to and with it, divided by the source's share. All
documents ordered by that time and cut at the total budget give the mix: while a source lasts, it has its share at
any point of the order; when it is exhausted the others go on in proportion to theirs.

Running sums over a source are taken in two levels (sums of hash buckets, then within a bucket), so no task ever holds a source, however
large its part is. The time of the cut is known beforehand to within a few documents: at time t a source has given between share * t tokens
and one document less, so documents below one bound are in, those above another are out, and only the few between are ordered and summed. The mix comes out
range-sorted by finish time.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.tokens import FOLDER, token_count
from trackloom.session import cut

#: Rows that one bucket of a running sum holds on average.
BUCKET_ROWS = 200_000
#: Most sources of the targets.
MOST_SOURCES = 10_000


def _hash(seed: int, *cols: Column) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def sized(documents: DataFrame, name: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """doc_id, source, tokens of every document with at least one token and a source; each doc_id once."""
    narrow = documents.where(F.col("source").isNotNull() & F.col("text").isNotNull() & (F.col("text") != ""))
    counted = narrow.select("doc_id", "source", token_count(narrow["text"], name, folder).alias("tokens"))
    return counted.groupBy("doc_id").agg(F.min(F.struct("source", "tokens")).alias("d")).select("doc_id", "d.source", "d.tokens")


def running_sum(df: DataFrame, group: list[str], bucket: Column, order: list[Column], value: str, out: str) -> DataFrame:
    """df with the sum of value over the rows of the group up to and with the row; bucket rises with order and is small."""
    df = df.withColumn("__bucket", bucket)
    sums = df.groupBy(*group, "__bucket").agg(F.sum(value).alias("__sum"))
    before = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__sum")
    inner = Window.partitionBy(*group, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = df.withColumn("__inner", F.sum(value).over(inner)).join(before, [*group, "__bucket"])
    return joined.withColumn(out, F.col("__inner") + F.col("__before")).drop("__bucket", "__inner", "__before")


def mix(docs: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 7) -> DataFrame:
    """doc_id, source, copy, tokens, finish: the chosen documents; ordered by finish they are the mix.

    docs: doc_id, source, tokens (see sized()). targets: source, target_share, max_repeats; sources
    without a positive share, or not listed, contribute nothing, and no document comes more than max_repeats times
    (at least once). budget: total tokens, by default the tokens of the listed sources taken once. The document that
    crosses the budget is the first left out. Ties are broken by doc_id.
    """
    targets = targets.where("source is not null and target_share > 0").groupBy("source").agg(F.max("target_share").alias("share"), F.max(F.greatest(F.lit(1), F.coalesce("max_repeats", F.lit(1)))).alias("repeats"))
    docs = cut(docs.join(targets, "source"))
    total = docs.groupBy("source").agg(F.sum("tokens").alias("own"), F.count(F.lit(1)).alias("rows"))
    whole = total.agg(F.sum("own").alias("tokens"), F.sum("rows").alias("rows")).first()
    if not whole["tokens"]:
        return docs.select("doc_id", "source", F.lit(1).alias("copy"), "tokens", F.lit(0.0).alias("finish")).limit(0)
    budget = whole["tokens"] if budget is None else budget
    buckets = int(whole["rows"] // BUCKET_ROWS) + 1

    # one row a document: where it stands within one copy of its source
    spot = F.shiftrightunsigned(_hash(seed, F.col("doc_id")), 1)
    placed = running_sum(docs.withColumn("spot", spot), ["source"], (F.col("spot") / F.lit(2.0**63) * buckets).cast("int"), [F.col("spot"), F.col("doc_id")], "tokens", "up_to")
    placed = placed.join(total.select("source", "own"), "source")
    copies = placed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))))
    copies = copies.withColumn("finish", ((F.col("copy") - 1) * F.col("own") + F.col("up_to")) / F.col("share"))
    # tokens given by time t lie between the sources' shares of t, as far as these last, and one document a source less
    facts = total.join(targets, "source").join(docs.groupBy("source").agg(F.max("tokens").alias("longest")), "source").limit(MOST_SOURCES + 1).toPandas()
    if len(facts) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    most, share = (facts["own"] * facts["repeats"]).to_numpy(float), facts["share"].to_numpy(float)
    sure, open_ = time_of(most, share, budget), time_of(most, share, budget + float(facts["longest"].sum()))
    slack = 1e-9  # of rounding
    needed = placed.withColumn("copies", F.least(F.col("repeats"), F.floor(F.lit(min(open_, 1e18)) * F.col("share") / F.col("own")) + 1).cast("int"))
    copies = needed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    timed = copies.withColumn("finish", ((F.col("copy") - 1) * F.col("own") + F.col("up_to")) / F.col("share")).select("doc_id", "source", "copy", "tokens", "finish")
    order = [F.col("finish"), F.col("source"), F.col("doc_id"), F.col("copy")]
    if np.isinf(sure):
        chosen = timed
    else:
        timed = cut(timed.where(F.col("finish") <= open_ * (1 + slack)))
        inside = timed.where(F.col("finish") <= sure * (1 - slack))
        spent = inside.agg(F.sum("tokens")).first()[0] or 0
        # the documents that may cross the budget: at most a few a source
        edge = timed.where(F.col("finish") > sure * (1 - slack)).withColumn("total", F.sum("tokens").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
        chosen = inside.unionByName(edge.where(F.col("total") + spent <= budget).drop("total"))
    return chosen.repartitionByRange(*order).sortWithinPartitions(*order)


def time_of(most: np.ndarray, share: np.ndarray, tokens: float) -> float:
    """The time at which sources that give share * t tokens, up to most, have given so many together; infinite if they never do."""
    ends = np.sort(most / share)
    given = np.array([np.minimum(most, share * t).sum() for t in ends])
    i = int(np.searchsorted(given, tokens))
    if i == len(ends):
        return float("inf")
    before, start = (given[i - 1], ends[i - 1]) if i else (0.0, 0.0)
    rate = share[most / share > start].sum()
    return float(start + (tokens - before) / rate)


def shares(mixed: DataFrame, docs: DataFrame, targets: DataFrame) -> DataFrame:
    """Target and actual share, documents, tokens, most copies and state of each listed source."""
    used = mixed.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("copy").alias("copies"))
    there = docs.groupBy("source").agg(F.sum("tokens").alias("available"))
    one = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    out = one.join(used, "source", "left").join(there, "source", "left").na.fill(0, ["tokens", "documents", "copies", "available"])
    whole = mixed.agg(F.sum("tokens").alias("whole"))
    share = F.coalesce(F.col("tokens") / F.col("whole"), F.lit(0.0))
    state = F.when(F.col("available") == 0, "absent").when(F.col("tokens") + F.col("available") * 0.001 >= F.col("available") * F.col("max_repeats"), "exhausted").otherwise("met")
    return out.join(F.broadcast(whole)).select("source", "target_share", share.alias("actual_share"), "tokens", "documents", "copies", "max_repeats", "available", state.alias("state"))
