"""Modifiers that a label may not hold in questions of some kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words that place an object, order it in time or count it (found anywhere in the label, also within words)
MODIFIERS = {
    "spatial": [
        "leftmost", "rightmost", "upper", "lower", "top", "bottom",
        "left side", "right side", "on the left", "on the right",
        "upper-left", "upper-right", "lower-left", "lower-right",
        "on the top", "on the bottom",
    ],
    "temporal": [
        "first", "earlier", "later", "last", "appears first",
        "that appears first", "that shows up first", "that comes back",
    ],
    "count": [
        "only", "single", "twice", "thrice", "multiple", "many",
    ],
}


def holds(label: Column, *kinds: str) -> Column:
    """Whether the label holds a modifier of one of the kinds; false for null."""
    low = F.lower(F.coalesce(label, F.lit("")))
    out = F.lit(False)
    for k in kinds:
        for m in MODIFIERS[k]:
            out = out | low.contains(m)
    return out
