"""A sample whose shares of several fields follow targets.

Method: mergeable reservoirs. The reservoir of a cell (a combination of listed categories) is the part of its items with the smallest
hashes; it is kept as counts of hash ranges, which merge by addition before and after the shuffle and stay small however large
the sample is. From the final counts the feasible quota of every cell is found, and the reservoir is trimmed to it by hash, which is a uniform
draw: ranges below the quota are taken whole, and only the range that the quota falls in is ordered. No task holds a cell.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.session import cut

#: Items of a hash range on average (over all cells), and least number of ranges.
RANGE_ITEMS, LEAST_RANGES = 200_000, 64


def quotas(count: np.ndarray, axes: list[np.ndarray], share: list[np.ndarray], least: list[np.ndarray], size: int, rounds: int = 2000) -> np.ndarray:
    """Whole numbers of items per cell, at most count: proportional fitting to the targets of every axis, within what is there.

    axes[k][i] is the category of cell i on axis k. A category's goal is share x size, raised to its least number;
    what a category lacks is spread over the others of its axis by their shares.
    """
    goals = []
    for of, s, low in zip(axes, share, least):
        there = np.bincount(of, weights=count, minlength=len(s))
        want = np.minimum(np.maximum(np.round(s * size), low), there)
        for _ in range(100):
            gap = size - want.sum()
            room = (there > want) & (s > 0) if gap > 0 else (want > low)
            if abs(gap) < 1e-6 or not room.any():
                break
            want = np.clip(want + np.where(room, gap * np.where(room, s, 0) / max(s[room].sum(), 1e-12), 0), np.minimum(low, there), there)
        goals.append(want)
    x = np.minimum(count, np.maximum(count * size / max(count.sum(), 1), 1e-9))
    for _ in range(rounds):
        old = x.copy()
        for of, goal in zip(axes, goals):
            now = np.bincount(of, weights=x, minlength=len(goal))
            x = np.minimum(x * (goal / np.maximum(now, 1e-12))[of], count)
        if np.abs(x - old).max(initial=0) < 1e-6:
            break
    base = np.floor(x + 1e-9).astype(int)
    goals_i = [np.round(g).astype(int) for g in goals]
    # the rest goes, in steps that shrink to single items, to the cell whose categories lack most; each step shortens the distance to the goals
    whole = int(min(size, count.sum()))
    while base.sum() < whole:
        lack = sum(np.clip(g - np.bincount(of, weights=base, minlength=len(g)), -1, None)[of] for of, g in zip(axes, goals_i))
        score = np.where(base < count, lack + 1e-3 * (x - base), -np.inf)
        best = int(np.argmax(score))
        if score[best] == -np.inf:
            break
        base[best] += int(min(max(1, (whole - base.sum()) // (4 * len(count))), count[best] - base[best]))
    # least numbers first: move single items from well supplied cells
    for of, low in zip(axes, least):
        there = np.bincount(of, weights=count, minlength=len(low)).astype(int)
        for c in range(len(low)):
            for _ in range(int(min(low[c], there[c])) + 1):
                have = np.bincount(of, weights=base, minlength=len(low))
                if have[c] >= min(low[c], there[c]):
                    break
                into = np.flatnonzero((of == c) & (base < count))
                if not len(into):
                    break
                spare = [np.bincount(o, weights=base, minlength=len(m)) - m for o, m in zip(axes, least)]
                out = np.flatnonzero((base > 0) & np.all([s[o] > 0 for s, o in zip(spare, axes)], axis=0) & (of != c))
                base[into[np.argmax(count[into] - base[into])]] += 1
                if len(out):
                    base[out[np.argmax(base[out])]] -= 1
    return _nearer(base, count, axes, goals_i, least)


def _nearer(base: np.ndarray, count: np.ndarray, axes: list[np.ndarray], goals: list[np.ndarray], least: list[np.ndarray], most: int = 5000) -> np.ndarray:
    """Single items are moved between cells while that brings the categories nearer to their goals, taken relative to the goals, so that rare ones count."""
    if not len(base):
        return base
    base = base.copy()
    for _ in range(most):
        have = [np.bincount(of, weights=base, minlength=len(g)) for of, g in zip(axes, goals)]
        cost = lambda h, g: np.abs(h - g) / np.maximum(g, 1)
        add = sum((cost(h + 1, g) - cost(h, g))[of] for of, h, g in zip(axes, have, goals))
        free = sum((cost(h - 1, g) - cost(h, g))[of] for of, h, g in zip(axes, have, goals))
        may = (base > 0) & np.all([(h - 1 >= np.minimum(low, h))[of] for of, h, low in zip(axes, have, least)], axis=0)
        into = int(np.argmin(np.where(base < count, add, np.inf)))
        # categories that both cells share keep their number
        same = sum(np.where(of == of[into], (cost(h + 1, g) - cost(h, g))[of[into]] + (cost(h - 1, g) - cost(h, g))[of[into]], 0) for of, h, g in zip(axes, have, goals))
        gain = np.where(may & (np.arange(len(base)) != into), add[into] + free - same, np.inf)
        out = int(np.argmin(gain))
        if base[into] >= count[into] or gain[out] > -1e-9:
            break
        base[into] += 1
        base[out] -= 1
    return base


def _targets(targets: DataFrame, fields: list[str], most: int) -> dict[str, pd.DataFrame]:
    rows = targets.where(F.col("field").isin(fields) & F.col("category").isNotNull()).groupBy("field", "category").agg(F.max(F.coalesce("target_share", F.lit(0.0))).alias("share"), F.max(F.coalesce("min_items", F.lit(0))).alias("least")).limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"more than {most} target categories")
    return {f: rows[rows["field"] == f].sort_values("category").reset_index(drop=True) for f in fields}


def draw(items: DataFrame, targets: DataFrame, fields: list[str], size: int | None = None, fraction: float = 0.25, key: str = "qa_id", seed: int = 11, most_categories: int = 200) -> tuple[DataFrame, DataFrame]:
    """The sample (key and fields) and a report by field and category.

    targets: field, category, target_share, min_items, at most most_categories rows. Repeated rows of a key count once.
    Items with a null or unlisted category in any field are not drawn. size: number of items, by default fraction of
    those that can be drawn, and at least what the least numbers need. report: field, category, target_share,
    min_items, available, drawn, actual_share, state: met, exhausted where every item is drawn and the goal
    isn't reached, absent where there is none, short or over where other fields' targets stand against it.
    """
    spark = items.sparkSession
    want = _targets(targets, fields, most_categories)
    cell = F.lit(0)
    for f in fields:
        names = want[f]["category"].tolist()
        index = F.array_position(F.array(*map(F.lit, names)).cast("array<string>"), F.col(f)) - 1
        cell = F.when(cell.isNull() | (index < 0), None).otherwise(cell * len(names) + index)
    once = items.groupBy(key).agg(*(F.min(f).alias(f) for f in fields))
    narrow = once.select(cell.cast("int").alias("cell"), F.xxhash64(F.lit(seed), F.col(key)).alias("h"), F.col(key).cast("string").alias("id")).where("cell is not null and id is not null")
    narrow = cut(narrow)
    n = narrow.count()
    if size is None:
        floor = max((int(want[f]["least"].sum()) for f in fields), default=0)
        size = max(floor, round(fraction * n))
    ranges = max(LEAST_RANGES, n // RANGE_ITEMS + 1)
    ranged = narrow.withColumn("range", (F.shiftrightunsigned("h", 1) / F.lit(2.0**63) * ranges).cast("int"))
    reservoirs = cut(ranged.groupBy("cell", "range").agg(F.count(F.lit(1)).alias("n")))
    counts = reservoirs.groupBy("cell").agg(F.sum("n").alias("n")).toPandas().sort_values("cell")
    cells, count = counts["cell"].to_numpy(int), counts["n"].to_numpy(float)
    axes, rest = [], cells.copy()
    for f in reversed(fields):
        axes.insert(0, rest % max(len(want[f]), 1))
        rest = rest // max(len(want[f]), 1)
    share = [want[f]["share"].to_numpy(float) for f in fields]
    least = [want[f]["least"].to_numpy(float) for f in fields]
    quota = quotas(count, axes, share, least, size) if len(cells) else np.zeros(0, int)

    limit = spark.createDataFrame([(int(c), int(q)) for c, q in zip(cells, quota)], "cell int, quota bigint")
    up_to = F.sum("n").over(Window.partitionBy("cell").orderBy("range").rowsBetween(Window.unboundedPreceding, 0))
    edges = reservoirs.join(F.broadcast(limit), "cell").withColumn("up_to", up_to).where("up_to - n < quota")
    # of the last range of each cell only what the quota leaves
    edges = edges.select("cell", "range", F.when(F.col("up_to") > F.col("quota"), F.col("quota") - F.col("up_to") + F.col("n")).alias("rest"))
    kept = ranged.join(edges, ["cell", "range"])
    last = kept.where("rest is not null").withColumn("r", F.row_number().over(Window.partitionBy("cell").orderBy(F.shiftrightunsigned("h", 1), "h", "id"))).where("r <= rest")
    drawn = kept.where("rest is null").unionByName(last.drop("r"))
    index, columns = F.col("cell"), []
    for f in reversed(fields):
        names = want[f]["category"].tolist() or [""]
        columns.insert(0, F.element_at(F.array(*map(F.lit, names)), (index % len(names) + 1).cast("int")).alias(f))
        index = F.floor(index / len(names))
    sample = drawn.select(F.col("id").alias(key), *columns)

    rows = []
    for f, of, s, low in zip(fields, axes, share, least):
        there = np.bincount(of, weights=count, minlength=len(s)) if len(cells) else np.zeros(len(s))
        got = np.bincount(of, weights=quota, minlength=len(s)) if len(cells) else np.zeros(len(s))
        whole = max(quota.sum(), 1)
        for i, name in enumerate(want[f]["category"]):
            goal = max(round(s[i] * size), low[i])
            near = max(1.0, 0.02 * goal)
            state = "absent" if there[i] == 0 else "met" if abs(got[i] - goal) <= near else "over" if got[i] > goal else "exhausted" if got[i] >= there[i] else "short"
            rows.append((f, name, float(s[i]), int(low[i]), int(there[i]), int(got[i]), float(got[i] / whole), state))
    report = spark.createDataFrame(rows, "field string, category string, target_share double, min_items bigint, available bigint, drawn bigint, actual_share double, state string")
    return sample, report
