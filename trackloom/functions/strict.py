"""The stricter extraction of answers that the necessity filter uses, the lenient fallback of the evaluation, and replies' forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackloom.functions import answers as A

_N = A._NOT_WORD
# fixed values: number words in the order in which they are tried, and what they stand for
NUMBER_WORDS = [("two", "2"), ("twice", "2"), ("three", "3"), ("thrice", "3"), ("four", "4"), ("five", "5 or more"), ("six", "5 or more"), ("seven", "5 or more"), ("eight", "5 or more"), ("nine", "5 or more"), ("ten", "5 or more")]
#: Share of an option's words that a reply must hold to mean it.
SHARED_WORDS = 0.7


def strict_letter(text: Column, allowed: str) -> Column:
    """The whole text, else an announced letter, else one before a closing sign, else one between white space; never a letter within a word."""
    t = F.upper(F.regexp_replace(text, r"^\s+|\s+$", ""))
    one = "|".join(allowed)
    found = lambda pattern: F.nullif(F.regexp_extract(t, pattern, 1), F.lit(""))
    return F.coalesce(F.when(t.isin(*allowed), t), found(rf"ANSWER\s*[:\-]?\s*({one})(?:{_N}|$)"), found(rf"(?:^|[^A-Z])({one})\s*[.,):\]\"']"), found(rf"(?:^|\s)({one})(?:\s|$)"))


def strict_order(text: Column, k: Column) -> Column:
    """Every letter of the first k anywhere in the text, in order of first use; null unless all k are there."""
    found = F.filter(F.array_distinct(F.split(F.upper(text), "")), lambda x: F.array_contains(F.slice(F.array(*map(F.lit, "ABCDEFGH")), F.lit(1), k), x))
    return F.when(F.size(found) == k, F.array_join(found, ","))


def strict_number(text: Column) -> Column:
    """'5 or more' for any 'N or more' and any 5 or five, else the first number."""
    first = F.regexp_replace(F.regexp_extract(text, rf"(?:^|{_N})([0-9]+)(?:{_N}|$)", 1), "^0+", "")
    many = text.rlike(rf"(?i)(?:^|{_N})[0-9]+\s*\+?\s*or\s+more(?:{_N}|$)") | text.rlike(rf"(?i)(?:^|{_N})(?:five|5)(?:{_N}|$)")
    return F.when(many | (F.length(first) > 1) | first.isin("5", "6", "7", "8", "9"), "5 or more").when(first.isin("2", "3", "4"), first)


def extract_strict(text: Column, fmt: Column, order_key: Column) -> Column:
    """By format; an order has as many letters as the item's key, else as the format says. Null for an empty text; other formats are read as four options."""
    k = F.coalesce(F.size(order_key), F.when(fmt == "ordering_4", 4).otherwise(3))
    k = F.when(order_key.isNull(), F.when(fmt == "ordering_4", 4).otherwise(3)).otherwise(k)
    out = F.when(fmt.startswith("ordering_"), strict_order(text, k)).when(fmt == "sp", strict_letter(text, "AB")).when(fmt == "numerical", strict_number(text)).otherwise(strict_letter(text, "ABCD"))
    return F.when(F.coalesce(text, F.lit("")) != "", out)


def normal_words(text: Column) -> Column:
    """Lower case, ASCII letters and digits only, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]+", " "), r"\s+", " "))


def fallback(text: Column, fmt: Column, choices: list[Column]) -> Column:
    """The usual extraction, else a number word, else the only choice that holds the text, is held by it or shares most of its words with it.

    choices: text of option or statement A, B, C, D (null where there is none); of format sp only the first two count.
    """
    t = normal_words(text)
    word = F.when(t.rlike(r"(?:^| )(?:5\s*or\s*more|five or more|at least five)(?: |$)"), "5 or more")
    for w, n in NUMBER_WORDS:
        word = word.when(t.rlike(rf"(?:^| ){w}(?: |$)"), n)
    own = F.array_distinct(F.split(t, " "))
    hits = []
    for letter, c in zip("ABCD", choices):
        o = normal_words(c)
        words = F.array_distinct(F.split(o, " "))
        hit = F.contains(t, o) | F.contains(o, t) | (F.size(F.array_intersect(own, words)) / F.size(words) >= SHARED_WORDS)
        hits.append(F.when((F.coalesce(o, F.lit("")) != "") & hit & ((fmt == "mcq_4") | ((fmt == "sp") & F.lit(letter in "AB"))), letter))
    found = F.filter(F.array(*hits), lambda x: x.isNotNull())
    later = F.when(fmt == "numerical", word).when(F.size(found) == 1, F.get(found, F.lit(0)))
    return F.coalesce(A.extract(text, fmt), F.when(F.coalesce(text, F.lit("")) != "", later))


def without_thinking(text: Column) -> Column:
    """The text without closed reasoning (tags in lower case only); what follows a tag that is never closed is dropped."""
    t = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    t = F.when(t.contains("<think>") & ~t.contains("</think>"), F.substring_index(t, "<think>", 1)).otherwise(t)
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def visible_text(parts: Column) -> Column:
    """Text of a chat message given as an array of struct<type, text>."""
    return F.concat_ws("", F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"]))


# fixed values: words whose objects aren't tracked
SKIPPED = ["wall", "floor", "ceiling", "sky", "background", "room", "light"]


def object_list(text: Column) -> Column:
    """Names of objects in a reply: its first JSON array of texts, else what stands between separators and numbers, without the skipped; trimmed, in lower case, each once, shorter than 50."""
    listed = F.from_json(F.regexp_extract(text, r"(?s)(\[.*?\])", 1), "array<string>")
    short = lambda names: F.array_distinct(F.filter(names, lambda x: (x != "") & (F.length(x) < 50)))
    split = F.transform(F.split(text, r"[\n,;•\-0-9.]+"), lambda x: F.lower(F.regexp_replace(F.trim(x), "^[\"']+|[\"']+$", "")))
    other = F.filter(split, lambda x: (F.length(x) > 1) & ~x.rlike("|".join(SKIPPED)))
    return short(F.when(listed.isNotNull(), F.transform(listed, lambda x: F.lower(F.trim(x)))).otherwise(other))


def without_the(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "(?i)^the ", ""))


def token_budget(fmt: Column, thinking: Column) -> Column:
    """Most tokens of a reply."""
    return F.when(F.coalesce(thinking, F.lit(False)), 18432).when(fmt.startswith("ordering"), 256).otherwise(64)
