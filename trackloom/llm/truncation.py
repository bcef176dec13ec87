"""Responses that stop before they are finished.

Structure decides where it can: blocks never closed and broken escapes. Open ends, which have neither an end of a sentence nor an answer, are
judged by two kinds of evidence, of which the second needs no copy of the text:

- near-copies: texts are banded by min-hash signatures of their five-word shingles. Each open text meets the longest text of each of its
  buckets (a map-side aggregate, so a bucket's size doesn't matter); the pair is verified (0.8 or more of the shorter's shingles are in
  the longer) and its words aligned, and the text counts as a copy that ends early if its alignment ends where the longer goes on. Open texts that
  this and their closing words leave undecided then meet every other longer text of their buckets, in blocks;
- terminality of the closing word: how often the word closes sentences in the whole corpus and how often it stands within them, and for words
  seen nowhere else, how many longer words they begin. Texts that close their other sentences are expected to close the last one too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions.text import key_text
from trackloom.session import cut

WORDS = 5
SIMILAR = 0.8
BANDS, ROWS = 8, 4
#: Score of an open end: style (no other sentence is closed, one is, each further one adds, up to a limit), limits of the closing word's log odds, evidence that it is
#: broken (a rare word that begins others), evidence of a verified near-copy that goes on.
ONE_SENTENCE, SEVERAL, EACH, MOST_STYLE = -1.5, 2.5, 0.6, 4.5
MOST_WORD, MOST_BROKEN, RARE = 4.0, 3.0, 20
COPY = 6.0
#: Words at the end of a text that are aligned; texts of a bucket's block that an undecided text meets at once.
TAIL, BLOCK = 200, 500
#: Characters at the end of a text that an answer at its end lies within.
END = 200
#: So many pairs may be broadcast to the scan that fetches their texts.
MOST_PAIRS = 1_000_000

_ANSWER = r"(?:[A-H](?:\s*(?:,|->|→|>|\s)\s*[A-H])*|\d{1,3}(?: or more)?)"
#: An answer at the end, behind something that announces it.
ANSWER_END = rf"(?:^\s*|[:\-–—(\"'*\n>]\s*|\.\.\.\s*|\b(?i:answer|option|is|hence|choose|say|so|choice)\s+){_ANSWER}[\s)\]\"'*.!,}}\x{{1F300}}-\x{{1FAFF}}]*$"
#: The whole text is a stand-in for no value, which is no answer, but not cut either.
STAND_IN = r"(?i)^[\s\W]*(?:n/?a|null|none|nil|nan|undefined|unknown|empty|no answer|answer|the answer|response|output)?[\s\W]*$"
#: Ends of a sentence, with what may stand behind it.
CLOSED = r"(?:[.!?。！？…]|\x{1F300}|[\x{1F300}-\x{1FAFF}])[\"'”’»)\]*_`\s\x{1F300}-\x{1FAFF}]*$"
ESCAPE = r"(?:\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?|&(?:[a-zA-Z]{1,7}|#\d{0,5})?|\x{FFFD})\s*$"
ASKS = r"(?is)^[\s>\"'*]*(?:(?:q|question|you asked)\s*[:.-]\s*)?[\"']?(?:what|when|where|which|who|whose|why|how|in what|in which|at what|at which|at the moment|during|for how|on how|of the|once|does|do|did|is|are|was|count|arrange|sort|order|put|rank)\b"


def answer_end(text: Column) -> Column:
    """Whether an answer stands at the end, looked for in the last END characters (no answer is longer), which a letter in front keeps from being a start."""
    return F.when(F.length(text) <= END, text).otherwise(F.concat(F.lit("x"), F.substring(text, -END, END))).rlike(ANSWER_END)


def body(text: Column) -> Column:
    """The text without closed reasoning."""
    return F.when(text.contains("</think>"), F.regexp_replace(text, r"(?s)<think>.*?</think>", "")).otherwise(text)


def _odd(text: Column, mark: str) -> Column:
    return text.contains(mark) & (((F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))) / len(mark)) % 2 == 1)


def open_block(text: Column) -> Column:
    """A block that is never closed: reasoning, JSON, code fence, tag, bold type or a quotation around everything."""
    rest = F.trim(body(text))
    json = rest.rlike(r"^[{\[]\s*(\"|$)") & F.get_json_object(rest, "$").isNull()
    tag = rest.startswith("<answer>") & ~rest.contains("</answer>")
    quote = rest.startswith('"') & (F.length(rest) > 1) & _odd(rest, '"')
    return rest.contains("<think>") | json | _odd(rest, "```") | tag | _odd(rest, "**") | quote


def unfinished(text: Column) -> Column:
    """No end of a sentence and no answer at the end."""
    rest = F.rtrim(body(text), F.lit(_SPACE))
    json = rest.rlike(r"^\s*[{\[]") & F.get_json_object(rest, "$").isNotNull()
    return ~rest.rlike(CLOSED) & ~answer_end(rest) & rest.rlike(r"[\p{L}\d]") & ~F.regexp_replace(rest, r"</?\w+>", "").rlike(STAND_IN) & ~json


_SPACE = " \t\n\r\x0b\x0c"


def open_sentence(text: Column) -> Column:
    """What follows the last end of a sentence."""
    return F.regexp_extract(F.regexp_replace(body(text), r"\s+$", ""), r"(?s)((?:(?![.!?。！？]\s|\n\n).)*)$", 1)


def closing_word(text: Column) -> Column:
    return F.lower(F.regexp_extract(body(text), r"([\p{L}\p{M}']+|\S)\s*$", 1))


def closing_words(texts: DataFrame, text: str) -> DataFrame:
    """word, closes (times before the end of a sentence), all: over every word of all texts. Words as they are written are counted before
    the shuffle; signs are taken off the few different ones afterwards."""
    written = texts.select(F.explode(F.split(F.lower(F.col(text)), r"[\s\"(]+")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    words = written.select(F.regexp_replace("w", r"^[^\p{L}]+|[^\p{L}]+$", "").alias("word"), F.col("w").rlike(r"[.!?][\"')*]*$").alias("end"), "n")
    return words.where("word <> ''").groupBy("word").agg(F.coalesce(F.sum(F.when(F.col("end"), F.col("n"))), F.lit(0)).alias("closes"), F.sum("n").alias("all"))


def with_odds(ends: DataFrame, stats: DataFrame) -> DataFrame:
    """ends (word, ...) with odds: log odds that a text that stops behind the word isn't finished, and broken: log odds that the word itself isn't."""
    closers = ends.select("word").distinct()
    begins = stats.where("length(word) > 1").select("word", "all", F.explode(F.expr("transform(sequence(1, length(word) - 1), i -> substr(word, 1, i))")).alias("start"))
    begins = begins.join(closers.withColumnRenamed("word", "start"), "start", "left_semi").groupBy("start").agg(F.sum("all").alias("longer"))
    own = closers.join(stats, "word", "left").join(begins.withColumnRenamed("start", "word"), "word", "left").na.fill(0, ["all", "closes", "longer"])
    odds = F.log((F.col("all") - F.col("closes") + 0.5) / (F.col("closes") + 0.5))
    broken = F.when(F.col("all") < RARE, F.log((F.col("longer") + 0.5) / (F.col("all") + 0.5))).otherwise(0.0)
    own = own.select("word", F.greatest(F.lit(-MOST_WORD), F.least(F.lit(MOST_WORD), odds)).alias("odds"), F.greatest(F.lit(0.0), F.least(F.lit(MOST_BROKEN), broken)).alias("broken"))
    return ends.join(own, "word")


_A = np.random.default_rng(17).integers(1, 2**61, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = np.random.default_rng(18).integers(0, 2**62, BANDS * ROWS, dtype=np.uint64)


def _signatures(words: list[list[str]], held: dict[str, int]) -> list[list[int]]:
    """Bucket of every band of each text (words in lower case), none for texts below WORDS words; all texts at once."""
    import xxhash

    long = [i for i, w in enumerate(words) if len(w) >= WORDS]
    out: list[list[int]] = [[] for _ in words]
    flat = [w for i in long for w in words[i]]
    for w in flat:
        if w not in held:
            held[w] = xxhash.xxh64_intdigest(w)
    if not flat:
        return out
    h = np.fromiter((held[w] for w in flat), np.uint64, len(flat))
    n = np.array([len(words[i]) for i in long])
    s = h[: len(h) - WORDS + 1].copy()
    for k in range(1, WORDS):
        s = s * np.uint64(0x9E3779B97F4A7C15) ^ h[k : len(h) - WORDS + 1 + k]
    first = np.cumsum(n) - n
    inside = np.ones(len(s), bool)
    for k in range(1, WORDS):  # shingles across two texts
        at = first[1:] - k
        inside[at[at < len(s)]] = False
    s = s[inside]
    start = first - np.arange(len(n)) * (WORDS - 1)
    mixed = np.zeros((len(n), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        for b in range(BANDS):
            low = np.minimum.reduceat(s * _A[b * ROWS + k] + _B[b * ROWS + k], start)
            mixed[:, b] = (mixed[:, b] ^ low) * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed ^= mixed >> np.uint64(31)
    for i, row in zip(long, mixed.view(np.int64).tolist()):
        out[i] = row
    return out


def _bands(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    held: dict[str, int] = {}
    for texts in batches:
        if len(held) > 500_000:
            held.clear()
        yield pd.Series([row for k in range(0, len(texts), 500) for row in _signatures([t.lower().split() for t in texts.iloc[k : k + 500]], held)])


def ends_early(short: str, long: str) -> bool:
    """Whether short is a near-copy of long, and aligned with it (words, free ends in long) stops where long goes on.

    The last word of short may be broken; long must go on with it, or with a word that begins so.
    """
    s, l = short.lower().split(), long.lower().split()
    grams = lambda w: {tuple(w[i : i + WORDS]) for i in range(max(1, len(w) - WORDS + 1))}
    own = grams(s[:-1])
    if len(s) < 2 or len(own & grams(l)) < SIMILAR * len(own):
        return False
    body = s[:-1][-TAIL:]
    code = {w: i for i, w in enumerate(dict.fromkeys(l))}
    there = np.array([code[w] for w in l])
    step = np.arange(len(l) + 1)
    cost = np.zeros(len(l) + 1, np.int64)
    for i, w in enumerate(body):
        new = np.empty_like(cost)
        new[0] = i + 1
        new[1:] = np.minimum(cost[:-1] + (there != code.get(w, -1)), cost[1:] + 1)
        cost = np.minimum.accumulate(new - step) + step
    best = cost.min()
    if best > (1 - SIMILAR) * len(body):
        return False
    return any(j < len(l) and l[j].startswith(s[-1]) and (len(l) > j + 1 or l[j] != s[-1]) for j in np.flatnonzero(cost == best).tolist())


def _verified(pairs: DataFrame, open_texts: DataFrame, texts: DataFrame) -> DataFrame:
    """tid of pairs (tid, other) whose alignment ends early. The long texts are fetched by a broadcast of the pairs where they are few."""
    pairs = cut(pairs)
    few = pairs.count() <= MOST_PAIRS
    long = texts.select(F.col("tid").alias("other"), F.col("text").alias("long"))
    long = long.join(F.broadcast(pairs) if few else pairs, "other").dropDuplicates(["tid", "other"])
    both = long.join(open_texts.select("tid", F.col("text").alias("short")), "tid")
    early = F.pandas_udf(lambda a, b: pd.Series([ends_early(x, y) for x, y in zip(a, b)]), "boolean")
    return both.where(early("short", "long")).select("tid").distinct()


def banded(texts: DataFrame) -> DataFrame:
    """tid, n (words), band: a row for each bucket of each text of WORDS words or more."""
    long = texts.withColumn("n", F.size(F.split(F.trim("text"), r"\s+"))).where(F.col("n") >= WORDS)
    return long.select("tid", "n", F.explode(F.pandas_udf(_bands, "array<bigint>")("text")).alias("band"))


def copies(open_texts: DataFrame, texts: DataFrame, undecided: DataFrame | None = None) -> DataFrame:
    """tid of each open text with a verified near-copy that goes on where it ends.

    open_texts and texts: tid, text; repeated rows count once. Every open text is compared with the longest text of each of its buckets, those of undecided
    (tid; by default all) that this leaves unmatched with all longer texts of their buckets.
    """
    wanted = cut(banded(open_texts).distinct())
    members = banded(texts).join(wanted.select("band").distinct(), "band", "left_semi").distinct()
    members = cut(members.join(members.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "band"))
    longest = members.groupBy("band").agg(F.max(F.struct("n", "tid")).alias("long"))
    first = wanted.join(longest, "band").where("long.n > n").select("tid", F.col("long.tid").alias("other")).distinct()
    found = cut(_verified(first, open_texts, texts))
    rest = wanted.join(found, "tid", "left_anti")
    if undecided is not None:
        rest = rest.join(undecided.select("tid").distinct(), "tid", "left_semi")
    # every longer member, block by block: a bucket of any size is spread over its blocks
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    asked = rest.join(members.select("band", "size").distinct(), "band").select("tid", "n", "band", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    there = members.select("band", F.col("tid").alias("other"), F.col("n").alias("m"), F.pmod(F.xxhash64("tid"), blocks).cast("int").alias("block"))
    second = asked.join(there, ["band", "block"]).where("m > n").select("tid", "other").distinct().join(first, ["tid", "other"], "left_anti")
    return found.union(_verified(second, open_texts, texts)).distinct()


def early_ends(texts: DataFrame) -> DataFrame:
    """tid of each unfinished text with a verified near-copy that goes on where it ends. texts: tid, text, unfinished."""
    return copies(texts.where("unfinished"), texts)


def item_texts(items: DataFrame) -> DataFrame:
    """qa (key) and said: the words of an item's question, options and statements in every wording, one row an item."""
    names = [c for c in items.columns if c in {"question", "polished_question", *(f"{p}option_{x}" for p in ("", "polished_") for x in "abcd"), *(f"{p}statement_{x}" for p in ("", "polished_") for x in "ab")}]
    text = F.concat_ws(" ", *names) if names else F.lit("")
    events = [F.concat_ws(" ", F.col(f"{c}.event_text")) for c in ("events", "polished_events") if c in items.columns]
    asked = F.concat_ws(" ", *(c for c in ("question", "polished_question") if c in items.columns))
    return items.select(key_text(items["qa_id"]).alias("qa"), plain(F.concat_ws(" ", text, *events)).alias("said"), plain(asked).alias("asked")).where("qa is not null").groupBy("qa").agg(F.max(F.struct("said", "asked")).alias("i")).select("qa", "i.said", "i.asked")


def plain(text: Column) -> Column:
    """Letters and digits in lower case, single spaces between words."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}#]+", " "))


def open_ends(preds: DataFrame) -> DataFrame:
    """qa_id, model, tid, text, structural of every message that shows a sign of being cut, each message and text once; one pass."""
    text = F.col("raw_response")
    rows = preds.select(key_text(preds["qa_id"]).alias("qa_id"), key_text(preds["model"]).alias("model"), text).where("qa_id is not null and model is not null and raw_response is not null")
    tail = F.when(F.length(text) <= END, text).otherwise(F.substring(text, -END, END))
    rows = rows.withColumn("structural", open_block(text) | tail.rlike(ESCAPE))
    return rows.where(F.col("structural") | unfinished(text)).select("qa_id", "model", F.xxhash64("raw_response").alias("tid"), text.alias("text"), "structural").distinct()


def judged(preds: DataFrame, items: DataFrame, stats: DataFrame | None = None, match: bool = True) -> DataFrame:
    """qa_id, model, score, truncated of every message whose text shows any sign of being cut, with the evidence; each message once.

    score above 0 means truncated; structural signs (open block, broken escape) score 9. Evidence: structural, copied (a near-copy goes on),
    word (log odds of the closing word, broken words included), style, repeats. Null and blank responses, and messages with a null
    identifier, give no row. An open end that only repeats the item's question or an option is complete. stats: closing_words() of the corpus, by default
    of preds; match: look for near-copies.
    """
    found = cut(open_ends(preds))
    text = F.col("text")
    texts = preds.where("raw_response is not null").select(F.xxhash64("raw_response").alias("tid"), F.col("raw_response").alias("text"))
    rest = found.where("not structural")
    sentence = open_sentence(text)
    closed = F.size(F.regexp_extract_all(body(text), F.lit(r"([.!?。！？][\"'”’»)*_`]*)(?=\s)"), 1))
    ends = rest.select("qa_id", "model", "tid", closing_word(text).alias("word"), sentence.rlike(ASKS).alias("asks"), F.when(closed > 0, F.least(F.lit(MOST_STYLE), SEVERAL + EACH * (closed - 1))).otherwise(ONE_SENTENCE).alias("style"), plain(body(text)).alias("response"))
    ends = with_odds(ends, cut(closing_words(texts, "text")) if stats is None else stats).join(item_texts(items).withColumnRenamed("qa", "qa_id"), "qa_id", "left")
    response = F.regexp_replace("response", r"^(?:q|question|you asked|answer|option) ", "")
    repeats = F.coalesce(F.size(F.array_except(F.split(response, " "), F.split(F.concat_ws(" ", "said", F.lit("a b c d")), " "))) == 0, F.lit(False))
    # without its item, a question that ends on a word that closes sentences counts as repeated
    alone = F.col("said").isNull() & F.col("asks") & (F.col("odds") < 0)
    ends = cut(ends.select("qa_id", "model", "tid", (F.col("odds") + F.col("broken")).alias("word"), "style", (repeats | alone).alias("repeats")))
    alone_score = F.col("style") + F.col("word")
    undecided = ends.where(~F.col("repeats") & (alone_score <= 0) & (alone_score + COPY > 0))
    matched = copies(rest.select("tid", "text").distinct(), texts, undecided) if match else ends.select("tid").limit(0)
    matched = matched.withColumn("copied", F.lit(True))
    score = F.when(F.col("repeats"), -9.0).otherwise(alone_score + F.when(F.col("copied"), COPY).otherwise(0.0))
    judged_ends = ends.join(matched, "tid", "left").select("qa_id", "model", score.alias("score"), F.lit(False).alias("structural"), F.coalesce("copied", F.lit(False)).alias("copied"), "word", "style", "repeats")
    null = F.lit(None)
    broken = found.where("structural").select("qa_id", "model", F.lit(9.0).alias("score"), F.lit(True).alias("structural"), F.lit(False).alias("copied"), null.cast("double").alias("word"), null.cast("double").alias("style"), F.lit(False).alias("repeats"))
    evidence = ["score", "structural", "copied", "word", "style", "repeats"]
    both = broken.unionByName(judged_ends).groupBy("qa_id", "model").agg(F.max(F.struct(*evidence)).alias("e"))
    return both.select("qa_id", "model", *(f"e.{c}" for c in evidence)).withColumn("truncated", F.col("score") > 0)


def rates(preds: DataFrame, items: DataFrame) -> DataFrame:
    """model, messages, truncated, share of each model (keys compared trimmed and in lower case)."""
    every = preds.select(key_text(preds["qa_id"]).alias("qa_id"), key_text(preds["model"]).alias("model")).where("qa_id is not null and model is not null").distinct().groupBy("model").agg(F.count(F.lit(1)).alias("messages"))
    cut = judged(preds, items).where("truncated").groupBy("model").agg(F.count(F.lit(1)).alias("truncated"))
    return every.join(cut, "model", "left").na.fill(0, ["truncated"]).withColumn("share", F.col("truncated") / F.col("messages"))
