"""Object labels: base noun, modifiers and the kinds of modifier they hold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: prepositions of a trailing phrase
PREPOSITIONS = "on|in|at|near|beside|next to|by|of|from|behind|in front of|above|below|under|over"


def label_parts(label: Column) -> Column:
    """struct<base, modifiers, digit>: the last word without number, article and trailing phrase; the words before it; whether a number follows."""
    low = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    bare = F.trim(F.regexp_replace(low, r"#[0-9]+$", ""))
    bare = F.regexp_replace(bare, r"^(the |a |an )", "")
    core = F.trim(F.regexp_replace(bare, rf"\s+(?:{PREPOSITIONS})\s+the\s+\w+$", ""))
    words = F.filter(F.split(core, r"\s+"), lambda w: w != "")
    base = F.when(F.size(words) > 0, F.element_at(words, -1)).otherwise(bare)
    mods = F.when(F.size(words) > 1, F.array_join(F.slice(words, 1, F.size(words) - 1), " ")).otherwise("")
    return F.struct(base.alias("base"), mods.alias("modifiers"), low.rlike(r"#[0-9]+$").alias("digit"))
