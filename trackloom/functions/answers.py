"""Answer extraction from free text, and comparison with the key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = r"[\p{L}\p{N}_]"
_NOT_WORD = r"[^\p{L}\p{N}_]"


def final_region(text: Column) -> Column:
    """What follows the first closed reasoning block if that isn't blank, else the text without closed blocks."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""))
    tail = F.regexp_replace(F.regexp_extract(t, r"(?is)^.*?</think>(.*)$", 1), r"^\s+|\s+$", "")
    return F.when(tail != "", tail).otherwise(F.regexp_replace(F.regexp_replace(t, r"(?is)<think>.*?</think>", " "), r"^\s+|\s+$", ""))


def tokens(text: Column) -> Column:
    return F.split(F.upper(F.trim(F.regexp_replace(text, rf"{_NOT_WORD}+", " "))), " ")


def letter(text: Column, allowed: str) -> Column:
    """Announced letter at the start, else a letter at the end, else the first allowed letter that stands alone."""
    t = final_region(text)
    start = F.upper(F.regexp_extract(t, rf"(?i)^[\s*\"'`(\[]*(?:answer\s*[:\-]\s*|the\s+answer\s+is\s+|option\s+)?[\s*\"'`(\[]*([A-D])(?:{_NOT_WORD}|$)", 1))
    end = F.upper(F.regexp_extract(t, rf"(?i)(?:^|{_NOT_WORD})([A-D])[\s.)\]\"'`]*$", 1))
    ok = list(allowed)
    return F.when(start.isin(ok), start).when(end.isin(ok), end).otherwise(F.get(F.filter(tokens(t), lambda x: x.isin(ok)), F.lit(0)))


def number(text: Column) -> Column:
    """2, 3, 4 or '5 or more'; null for other numbers and for none."""
    t = final_region(text)
    first = F.get(F.filter(tokens(t), lambda x: x.rlike("^[0-9]+$")), F.lit(0))
    bare = F.regexp_replace(first, "^0+", "")
    return F.when(t.rlike(rf"(?i)(?:^|{_NOT_WORD})5\s*(?:or\s*more|more)(?:{_NOT_WORD}|$)"), "5 or more").when(bare.isin("2", "3", "4"), bare).when((F.length(bare) > 1) | bare.isin("5", "6", "7", "8", "9"), "5 or more")


def order(text: Column, k: int) -> Column:
    """The first k different letters that stand alone, joined by commas; null if there are fewer."""
    found = F.array_distinct(F.filter(tokens(final_region(text)), lambda x: x.isin("A", "B", "C", "D")))
    return F.when(F.size(found) >= k, F.array_join(F.slice(found, 1, k), ","))


def extract(text: Column, fmt: Column) -> Column:
    """By format; null for unknown formats."""
    return F.when(fmt == "mcq_4", letter(text, "ABCD")).when(fmt == "sp", letter(text, "AB")).when(fmt == "numerical", number(text)).when(fmt == "ordering_3", order(text, 3)).when(fmt == "ordering_4", order(text, 4))


def correct(extracted: Column, fmt: Column, answer: Column, order_key: Column) -> Column:
    """False without an extracted answer; orders must agree in every place."""
    right = F.when(fmt.startswith("ordering"), F.coalesce(extracted == order_key, F.lit(False)) & (F.size(order_key) > 0)).otherwise(F.get(extracted, F.lit(0)) == answer)
    return F.coalesce(right, F.lit(False))
