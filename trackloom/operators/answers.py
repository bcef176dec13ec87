"""Repairing and balancing the answers of items: pairs and options change places, so that no letter is right too often.

Items carry qa_id, format, correct_answer and the texts of their choices. Which items are changed is chosen by the smallest hashes (or
identifiers), found without a window over all items of a letter: counts of hash ranges give the range that the quota falls in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.session import cut

RANGES = 4096


def smallest(df: DataFrame, group: list[Column | str], order: Column, quota: DataFrame, names: list[str]) -> DataFrame:
    """df with place: the number (from 1) of a row in its group by order (a text of hexadecimal digits), null beyond the group's quota.

    quota: names (the group) and quota. Rows of a range below the quota's are numbered within ranges, so a group of any size is spread.
    """
    keyed = df.withColumns({**{n: g if isinstance(g, Column) else F.col(g) for n, g in zip(names, group)}, "__o": order})
    keyed = keyed.withColumn("__range", F.conv(F.substring("__o", 1, 3), 16, 10).cast("int"))
    sizes = keyed.groupBy(*names, "__range").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*names).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("__before", before).join(quota, names).where("__before < quota").select(*names, "__range", "__before", "quota")
    inside = F.row_number().over(Window.partitionBy(*names, "__range").orderBy("__o"))
    placed = keyed.join(sizes, [*names, "__range"], "left")
    place = F.when(F.col("__before").isNotNull(), F.col("__before") + inside)
    return placed.withColumn("place", F.when(place <= F.col("quota"), place)).drop("__o", "__range", "__before", "quota")


def upper_answers(items: DataFrame) -> DataFrame:
    """Lower-case answers of four options in upper case; repaired says which."""
    low = F.col("correct_answer").isin("a", "b", "c", "d")
    return items.withColumn("repaired", F.coalesce(low, F.lit(False))).withColumn("correct_answer", F.when(low, F.upper("correct_answer")).otherwise(F.col("correct_answer")))


def swap_pair(items: DataFrame, flip: Column) -> DataFrame:
    """Statements A and B (else options A and B) of the chosen items change places, and so does the right answer. Items that have neither pair stay."""
    c = F.col
    stated, optional = c("statement_a").isNotNull() & c("statement_b").isNotNull(), c("option_a").isNotNull() & c("option_b").isNotNull()
    does = F.coalesce(flip, F.lit(False)) & (stated | optional)
    s, o = does & stated, does & ~stated
    new = {
        "statement_a": F.when(s, c("statement_b")).otherwise(c("statement_a")), "statement_b": F.when(s, c("statement_a")).otherwise(c("statement_b")),
        "option_a": F.when(o, c("option_b")).otherwise(c("option_a")), "option_b": F.when(o, c("option_a")).otherwise(c("option_b")),
        "correct_answer": F.when(does, F.translate("correct_answer", "AB", "BA")).otherwise(c("correct_answer")), "flipped": does,
    }
    return items.withColumns(new)


def _letters(items: DataFrame) -> DataFrame:
    return items.agg(F.count_if(F.col("correct_answer") == "A").alias("a"), F.count_if(F.col("correct_answer") == "B").alias("b"), F.count(F.lit(1)).alias("n"))


def rebalance_pairs(items: DataFrame, order: Column) -> DataFrame:
    """Half of the surplus of A over B is swapped, the first by order; nothing where B leads. items: statement pairs only."""
    n = _letters(items).select(F.lit("A").alias("g"), F.greatest(F.lit(0), F.floor((F.col("a") - F.col("b")) / 2)).alias("quota"))
    placed = smallest(items, ["correct_answer"], order, n, ["g"])
    return swap_pair(placed, F.col("place").isNotNull()).drop("g", "place")


def rebalance_identity(items: DataFrame, order: Column) -> DataFrame:
    """So many are swapped, the first by order, that half of the items (rounded down) have A. items: those of one dimension."""
    n = _letters(items).withColumn("over", F.col("a") - F.floor(F.col("n") / 2))
    quota = n.select(F.when(F.col("over") > 0, "A").otherwise("B").alias("g"), F.abs("over").alias("quota"))
    placed = smallest(items, ["correct_answer"], order, quota, ["g"])
    return swap_pair(placed, F.col("place").isNotNull()).drop("g", "place")


def letter_plan(counts: dict[str, int]) -> list[tuple[str, str, int]]:
    """(from, to, how many): the letter most above a quarter gives to the one most below, one by one, while both are off by more than a half.

    Letters that are right nowhere receive nothing. Only four counts are looked at, whatever the number of items.
    """
    now, fair = dict(counts), sum(counts.values()) / 4
    moved: dict[tuple[str, str], int] = {}
    while True:
        high, low = [x for x in now if now[x] - fair > 0.5], [x for x in now if fair - now[x] > 0.5]
        if not high or not low:
            break
        a, b = max(high, key=lambda x: (now[x], -ord(x))), max(low, key=lambda x: (fair - now[x], -ord(x)))
        # as many at once as leave the choice of both letters as it is, at least one
        others_high, others_low = [now[x] for x in high if x != a], [now[x] for x in low if x != b]
        room = min([now[a] - max(others_high, default=0), min(others_low, default=10**18) - now[b], int(now[a] - fair), int(fair - now[b])])
        k = max(1, room - 1)
        now[a] -= k
        now[b] += k
        moved[a, b] = moved.get((a, b), 0) + k
    return [(a, b, k) for (a, b), k in moved.items()]


def rebalance_options(items: DataFrame, order: Column) -> DataFrame:
    """Right answers spread over the letters by letter_plan(): the options of both letters change places. items: four options, answers A to D."""
    spark = items.sparkSession
    counts = {r["correct_answer"]: r["n"] for r in items.groupBy("correct_answer").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most four rows
    rows, start = [], {}
    for a, b, k in letter_plan({x: n for x, n in counts.items() if x in ("A", "B", "C", "D")}):
        rows.append((a, b, start.get(a, 0), start.get(a, 0) + k))
        start[a] = start.get(a, 0) + k
    plan = spark.createDataFrame(rows, "g string, to string, low bigint, high bigint")
    placed = smallest(items, ["correct_answer"], order, spark.createDataFrame(list(start.items()), "g string, quota bigint"), ["g"])
    p = F.broadcast(plan.withColumnRenamed("g", "of"))  # at most twelve rows
    joined = placed.join(p, (F.col("g") == F.col("of")) & (F.col("place") > F.col("low")) & (F.col("place") <= F.col("high")), "left")
    own, new = F.col("correct_answer"), F.coalesce("to", "correct_answer")
    texts = F.create_map(*(x for k in "abcd" for x in (F.lit(k.upper()), F.col(f"option_{k}"))))
    option = lambda k: F.when(new == k.upper(), F.element_at(texts, own)).when(own == k.upper(), F.element_at(texts, new)).otherwise(F.col(f"option_{k}")).alias(f"option_{k}")
    keep = [F.col(c) for c in items.columns if c not in {"correct_answer", *(f"option_{k}" for k in "abcd")}]
    return joined.select(*keep, *(option(k) for k in "abcd"), new.alias("correct_answer"), F.col("to").isNotNull().alias("moved"))
