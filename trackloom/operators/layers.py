"""Necessity layers over recorded trials: does an item fall without its video, with one frame, or with its frames shuffled?

Each layer runs up to so many trials of an item and stops as soon as enough were right, or enough can't be reached any more. Here the trials are
rows (qa_id, dim, format, trial, correct); what would have run before the stop is found with a running sum. An item whose dimension is
exempt, or that has no trials, passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: most trials and right ones needed to fail, by format (what isn't listed has the values of the empty name); exempt dimensions
TEXT_ONLY = {"sp": (3, 3), "": (1, 1)}
SINGLE_FRAME = {"mcq_4": (8, 3), "sp": (8, 5), "ordering": (6, 2), "numerical": (8, 3), "": (8, 3)}
SHUFFLED = {"sp": (3, 3), "": (1, 1)}
EXEMPT = {"text_only": ["reappear_identity", "event_count"], "single_frame": ["reappear_identity"], "shuffled": ["reappear_identity"]}


def by_format(fmt: Column, table: dict[str, tuple[int, int]], place: int) -> Column:
    out = F.lit(table[""][place])
    for name, values in table.items():
        if name:
            out = F.when(fmt.startswith(name), values[place]).otherwise(out)
    return out


def applies(layer: str, dim: Column) -> Column:
    """Whether the layer runs on items of the dimension (null: it does)."""
    return F.coalesce(~dim.isin(EXEMPT[layer]), F.lit(True))


def run(trials: DataFrame, table: dict[str, tuple[int, int]]) -> DataFrame:
    """qa_id, used (trials until the stop), hits, held (enough right ones) of each item with trials."""
    w = Window.partitionBy("qa_id").orderBy("trial")
    t = trials.withColumn("r", F.row_number().over(w)).withColumn("most", by_format(F.col("format"), table, 0)).withColumn("need", by_format(F.col("format"), table, 1)).where("r <= most")
    t = t.withColumn("hits", F.sum(F.col("correct").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("qa_id")))
    stop = (F.col("hits") >= F.col("need")) | (F.col("hits") + F.col("n") - F.col("r") < F.col("need")) | (F.col("r") == F.col("n"))
    return t.where(stop).groupBy("qa_id").agg(F.min("r").alias("used"), F.min_by("hits", "r").alias("hits"), F.min_by(F.col("hits") >= F.col("need"), "r").alias("held"))


def layer_results(items: DataFrame, text_only: DataFrame, single_frame: DataFrame, ordered: DataFrame, shuffled: DataFrame) -> DataFrame:
    """qa_id, layer, used, hits, passed of every item that has trials of the layer and isn't exempt. items: qa_id, dim, once each.

    text_only and single_frame fail an item that enough trials get right; shuffled fails it if both the ordered and the shuffled frames do.
    """
    o, s = run(ordered, SHUFFLED), run(shuffled, SHUFFLED)
    last = s.join(o.select("qa_id", F.col("held").alias("in_order")), "qa_id", "left").withColumn("held", F.col("held") & F.coalesce("in_order", F.lit(False))).drop("in_order")
    found = [(run(text_only, TEXT_ONLY), "text_only"), (run(single_frame, SINGLE_FRAME), "single_frame"), (last, "shuffled")]
    parts = [items.where(applies(name, F.col("dim"))).select("qa_id").join(df, "qa_id").select("qa_id", F.lit(name).alias("layer"), "used", "hits", (~F.col("held")).alias("passed")) for df, name in found]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
