"""Text expressions shared by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_text(col: Column | str) -> Column:
    """An identifier as it is compared: lower case, without white space (any Unicode separator) at either end."""
    col = F.col(col) if isinstance(col, str) else col
    return F.lower(F.regexp_replace(col, r"^[\s\p{Z}\x{200B}\x{FEFF}]+|[\s\p{Z}\x{200B}\x{FEFF}]+$", ""))
