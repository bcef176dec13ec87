"""Template residue and error-page text in the fields of items.

Method: a regularised linear classifier on hashed n-grams, length and title features. Its labels are weak: phrases of
response statuses, placeholders and fillers. It is trained on a bounded sample of labelled texts (and on clean ones into which
residue was put, both seeds and what the phrases matched, so that small tables teach as much as large ones). A fifth of the videos is
held out: they set the cutoff and validate it. The classifier alone decides; the phrases are used for training only. Every text of every item is
scored where it lies, without a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm import grams

FIELDS = ["polished_question", "polished_option_a", "polished_statement_a"]

#: Signs of residue (Java and Python syntax alike): placeholders, fillers, statuses, script notices.
PHRASES = [
    r"\{\{[^}]*\}\}|\$\{[^}]*\}|\{%[^%]*%\}|<%[^%]*%>|%\(\w+\)[sdfr]|%[sd](?![A-Za-z])|@@\w+@@|__[A-Za-z_]+__|\{\w*\}|##\w+##|\$\w+\$",
    r"\[(?:insert\b[^\]]*|placeholder[^\]]*|your\b[^\]]*|[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*)\]|<(?:insert\b[^>]*|your\b[^>]*|placeholder[^>]*|[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*)>",
    r"(?i)\[\s*insert\b|<\s*insert\b|\[\s*placeholder|<\s*your\b|\bplaceholder\b|\bundefined\b|\bNaN\b|\[object object\]",
    r"(?i)\b(?:todo|fixme|tbd|tbc|xxx)\b|\blorem\b|\bipsum\b|\bdolor\b|\basdf|\bqwerty|\bdummy text\b|\bsample (?:option |question |statement )?text\b|\b(?:text|content|question|answer) (?:goes )?here\b|\btype something\b|\bfoo bar\b",
    r"(?i)(?:^|\s)string$|^\s*(?:null|none|n/a|test|text|option|question)\s*$|\.\.\.\s*$|^\s*$",
    r"(?i)</?(?:html|head|title|body|noscript|script|div|span|p|br)\b[^>]*>|javascript|\bscripting\b|\bscripts?\b[^.]*\b(?:enabled?|support|switched|turn|disabled?|reload|allow)|\b(?:enable|activate|turn on|allow|support)\b[^.]*\b(?:scripts?|cookies)\b",
    r"(?i)\b[45]\d\d\b[ :-]{1,3}(?:not found|bad gateway|gateway|service unavailable|forbidden|too many|internal|error|unauthorized)|\berror[ :-]{1,3}[45]\d\d\b|internal server error|bad gateway|gateway time|service unavailable|access denied|permission to view|page you requested|page not found|could not be found|something went wrong|unexpected error|session (?:has )?(?:expired|timed out)|down for maintenance|upstream connect|checking your browser|verify you are human|\"error\"\s*:|overloaded|try again later|please sign in|too many requests|connection (?:refused|reset|timed out)",
]
ANY = "|".join(f"(?:{p})" for p in PHRASES)

#: Seeds of residue put into clean texts for training: whole or appended lines, and what stands in place of a word.
LINES = [
    "404 Not Found", "403 Forbidden", "502 Bad Gateway", "503 Service Unavailable", "Error 429: too many requests", "Internal Server Error", "Access denied. You do not have permission to view this page.",
    "The page you requested could not be found.", "Something went wrong. Please try again later.", "Your session has expired, please sign in again.", "This service is down for maintenance.",
    "An unexpected error occurred while processing your request.", "upstream connect error or reset before headers", "Checking your browser before you proceed...", '{"error": {"code": 500, "message": "overloaded"}}',
    "<html><head><title>500</title></head><body></body></html>", "Gateway time-out: no response in time.", "Please enable JavaScript to continue.", "JavaScript is disabled in your browser.",
    "Your browser does not support scripts.", "You need to enable scripts to run this app.", "This site requires scripts and cookies.", "<noscript>Enable scripts</noscript>", "Please turn on scripting and reload.",
    "Lorem ipsum dolor sit amet", "Your text here.", "Insert content here", "Question text goes here", "Sample option text", "Dummy text, to be replaced.", "This is a placeholder.", "[placeholder]", "<your answer>",
    "TODO", "TODO: write this", "TBD", "FIXME later", "xxx xxx xxx", "asdf asdf", "Type something", "string", "...",
]
SLOTS = ["name", "label", "subject", "object", "obj_a", "noun", "event_verb", "target", "time", "k", "x", "partner", "answer"]
FORMS = ["{{%s}}", "{{ %s }}", "${%s}", "{%s}", "{0}", "<%% %s %%>", "{%% %s %%}", "%%(%s)s", "%%s", "@@%s@@", "__%U__", "[%U]", "<%U>", "[insert %s]", "<insert %s here>", "undefined"]
#: Seeds of what belongs to the scene although it holds brackets, signs or such words: put behind a word of clean texts, which stay clean.
SCENE = ['with the tag [{w}]', '(the one marked {n}%)', 'with a label "{w}"', 'holding page {n} of the {w}', "next to the error message on the {w}", "under the {w} board", "#{n}", 'that says "{w}"', "by the script {w}", "and the {w} template", "[{w}]", "({w})", "& the {w}"]

BITS = 18
SHAPES = [(0, 1), (0, 1, 2), (0, 1, 2, 3)]
#: Most labelled texts of either class that the training sample holds, and the part of the videos kept for validation.
MOST_A_CLASS = 6000
HELD_OUT = 5
#: Texts are scored in pieces of so many characters (with overlap), so that a long text can't drown its residue.
PIECE, OVERLAP = 400, 80
EPOCHS, L2 = 8, 2e-5
#: Ends of a piece, which no text holds; only the ends of a whole text are marked.
START, END = "\x02", "\x03"
#: Texts whose scores a task keeps, since options are few and come again and again.
HELD = 100_000
_SHAPE = str.maketrans({**{c: "A" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, **{c: "a" for c in "abcdefghijklmnopqrstuvwxyz"}, **{c: "0" for c in "0123456789"}})


def _slot(rng: np.random.Generator) -> str:
    form, name = FORMS[rng.integers(len(FORMS))], SLOTS[rng.integers(len(SLOTS))]
    if "%U" in form:
        return form.replace("%U", name.upper())
    return form % name if form.count("%s") - form.count("%%s") == 1 else form.replace("%%", "%")


def spoiled(clean: list[str], n: int, seed: int = 3, known: list[str] | None = None) -> list[str]:
    """n texts with residue: a line alone or after a clean text, or a slot in place of a word. known: what phrases matched elsewhere."""
    rng = np.random.default_rng(seed)
    clean = clean or ["text"]
    out = []
    for i in range(n):
        text = clean[rng.integers(len(clean))]
        line = LINES[rng.integers(len(LINES))]
        words = text.split(" ")
        if i % 4 == 0:
            new = line
        elif i % 4 == 1:
            new = f"{text.rstrip('?. ')} {line}"
        else:
            words[rng.integers(len(words))] = known[rng.integers(len(known))] if known and i % 4 == 3 else _slot(rng)
            new = " ".join(words)
        out.append(new.upper() if rng.random() < 0.1 else new.lower() if rng.random() < 0.1 else new)
    return out


def decorated(clean: list[str], n: int, seed: int = 6) -> list[str]:
    """n clean texts with a scene's own brackets, signs or words put in."""
    rng = np.random.default_rng(seed)
    vocabulary = [w for w in dict.fromkeys(w for t in clean for w in t.split()) if w.isalpha() and w.islower()] or ["cup"]
    out = []
    for i in range(n if clean else 0):
        words = clean[rng.integers(len(clean))].split(" ")
        put = SCENE[i % len(SCENE)].replace("{w}", vocabulary[rng.integers(len(vocabulary))]).replace("{n}", str(rng.integers(2, 999)))
        words.insert(int(rng.integers(1, len(words) + 1)), put)
        out.append(" ".join(words))
    return out


def _pieces(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Overlapping pieces of the texts, and the text each is of; the first starts and the last ends with a mark."""
    parts, of = [], []
    for i, t in enumerate(texts):
        t = f"{START}{t.strip()}{END}"
        for a in range(0, max(1, len(t) - OVERLAP), PIECE - OVERLAP):
            parts.append(t[a : a + PIECE])
            of.append(i)
    return parts, np.array(of, np.int64)


def features(parts: list[str]) -> grams.Grams:
    """Each piece's n-grams (in lower case, and of the shape: letters and digits as A, a, 0), its words and pairs of words, and one
    gram each for length, first letter, case, end and number of words. Weights are 1: a little residue counts in a long piece too."""
    low = grams.hashed([p.lower() for p in parts], SHAPES, BITS)
    shape = grams.hashed([p.translate(_SHAPE) for p in parts], SHAPES[1:], BITS)
    words, of, extra, owner = [], [], [], []
    for i, t in enumerate(parts):
        s = t.strip(START + END + " ")
        own = t.lower().split()
        words += own
        of += [i] * len(own)
        extra += map(hash_name, (f"length={len(s).bit_length()}", f"first={'u' if s[:1].isupper() else 'l' if s[:1].islower() else 'o'}", f"case={s.isupper()}", f"end={s[-1:] if not s[-1:].isalnum() else 'w'}", f"words={min(len(own), 12)}"))
        owner += [i] * 5
    h, of = np.fromiter(map(hash_name, words), np.int64, len(words)), np.array(of, np.int64)
    pair = ((h[:-1] * 31 + h[1:]) * 0x9E3779B1 >> 7) & ((1 << BITS) - 1)
    together = of[:-1] == of[1:]
    ids = np.concatenate([low.ids, shape.ids ^ np.int64(0x15A5A), np.array(extra, np.int64), h, pair[together]])
    text = np.concatenate([low.text, shape.text, np.array(owner, np.int64), of, of[:-1][together]])
    return grams.Grams(ids, text, np.ones(len(ids)), len(parts))


@lru_cache(maxsize=200_000)
def hash_name(name: str) -> int:
    return zlib.crc32(name.encode()) >> (32 - BITS)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    cutoff: float = 0.5

    def score(self, texts: list[str]) -> np.ndarray:
        """Probability of residue; that of a text's worst piece. 0 for blank texts."""
        out = np.zeros(len(texts))
        at = [i for i, t in enumerate(texts) if t and not t.isspace()]
        for k in range(0, len(at), 512):
            parts, of = _pieces([texts[i] for i in at[k : k + 512]])
            p = 1 / (1 + np.exp(-np.clip(grams.project(features(parts), self.weights) + self.bias, -30, 30)))
            np.maximum.at(out, np.array(at[k : k + 512])[of], p)
        return out


def texts_of(items: DataFrame, fields: list[str] = FIELDS) -> DataFrame:
    """qa_id, video_id, text and weak label (1 residue, 0 clean and verified, null unclear) of every filled field."""
    label = F.when(F.col("text").rlike(ANY), 1).when(F.coalesce("verification_passed", F.lit(True)), 0)
    return _filled(items, fields).withColumn("label", label)


def _filled(items: DataFrame, fields: list[str]) -> DataFrame:
    """qa_id, video_id, verification_passed, text, held_out of every field that isn't blank."""
    one = items.select("qa_id", F.coalesce("video_id", F.lit("")).alias("video_id"), "verification_passed", F.explode(F.array(*fields)).alias("text")).where("trim(text) <> ''")
    return one.withColumn("held_out", F.pmod(F.xxhash64("video_id"), F.lit(HELD_OUT)) == 0)


def _sample(items: DataFrame, fields: list[str], most: int) -> pd.DataFrame:
    """text, label, held_out, found: at most `most` labelled texts of each class, those with the smallest hashes. Residue is rare, so every text is
    looked at for it; of the clean ones only a share is (about four times as many as wanted, by hash), which spares the phrases' cost."""
    texts = _filled(items, fields)
    n = texts.count()
    share = min(1.0, 4.0 * most / max(n, 1))
    h = F.xxhash64("qa_id", "text")
    few = texts.where(F.pmod(h, F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    clean = few.where(~F.col("text").rlike(ANY) & F.coalesce("verification_passed", F.lit(True))).orderBy(h, "text").select("text", F.lit(0).alias("label"), "held_out", F.lit(None).cast("string").alias("found"))
    dirty = texts.where(F.col("text").rlike(ANY)).select("text", F.lit(1).alias("label"), "held_out", F.trim(F.regexp_extract("text", f"({ANY})", 1)).alias("found")).distinct().orderBy(F.xxhash64("text"), "text", "held_out")
    return pd.concat([x.limit(most).toPandas() for x in (clean, dirty)])


def _fit(clean: list[str], dirty: list[str]) -> Model:
    texts, label = clean + dirty, np.repeat([0.0, 1.0], [len(clean), len(dirty)])
    parts, of = _pieces(texts)
    y = label[of]
    # residue may be in any piece of a long text: such pieces of a text with residue teach nothing
    several = (np.bincount(of, minlength=len(texts)) > 1)[of] & (y > 0)
    parts, y = [p for p, s in zip(parts, several) if not s], y[~several]
    if not len(y):
        return Model(np.zeros(1 << BITS), -30.0)
    g = features(parts)
    order = np.argsort(g.text, kind="stable")
    w, bias = grams.logistic(g.ids[order], g.text[order], g.weight, y, BITS, l2=L2, epochs=EPOCHS, rate=0.1)
    return Model(w, bias)


def best_cutoff(p: np.ndarray, label: np.ndarray) -> float:
    """The middle (in log odds) of the widest stretch of cutoffs with the best F1; 0.5 if a class is missing."""
    if label.min(initial=1) == 1 or label.max(initial=0) == 0:
        return 0.5
    z = np.log(np.clip(p, 1e-9, 1 - 1e-9) / (1 - np.clip(p, 1e-9, 1 - 1e-9)))
    order = np.argsort(-z)
    right = np.cumsum(label[order])
    f1 = 2 * right / (np.arange(1, len(z) + 1) + label.sum())
    s = z[order]
    gap = s - np.append(s[1:], s[-1] - 1)
    ok = np.flatnonzero((f1 >= f1[gap > 0].max() - 1e-12) & (gap > 0))
    i = ok[np.argmax(gap[ok])]
    return float(1 / (1 + np.exp(-(s[i] - gap[i] / 2))))


def train(items: DataFrame, most: int = MOST_A_CLASS, fields: list[str] = FIELDS) -> Model:
    """Fitted on at most `most` texts of each class and as many spoiled ones, none of a held-out video; those set the cutoff."""
    rows = _sample(items, fields, most)
    part = lambda label, held: rows.loc[(rows["label"] == label) & (rows["held_out"] == held), "text"].tolist()
    known = [x for x in rows.loc[(rows["label"] == 1) & ~rows["held_out"].astype(bool), "found"].dropna().tolist() if x and len(x) < 60 and " " not in x.strip()]
    clean, dirty = part(0, False), part(1, False)
    model = _fit(clean + decorated(clean, most // 4), dirty + spoiled(clean, most, known=known))
    clean, dirty = part(0, True), part(1, True)
    dirty = dirty + spoiled(clean, len(clean) // 10, seed=4)
    if clean:
        model.cutoff = best_cutoff(model.score(clean + dirty), np.repeat([0, 1], [len(clean), len(dirty)]))
    return model


def score(model: Model, text: Column) -> Column:
    """Probability that the text holds residue; 0 for null and blank texts."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held: dict[str, float] = {}
        for texts in batches:
            new = [t for t in texts.dropna().unique() if t not in held]
            if len(held) + len(new) > HELD:
                held.clear()
                new = list(texts.dropna().unique())
            held.update(zip(new, model.score(new)))
            yield texts.map(held).fillna(0.0).astype(float)

    return F.pandas_udf(run, "double")(text)


def scored(items: DataFrame, model: Model | None = None, cutoff: float | None = None, fields: list[str] = FIELDS) -> DataFrame:
    """items with p_<field> and residue (boolean). Null and blank texts are no residue; repeated rows stay repeated."""
    model = model or train(items, fields=fields)
    cutoff = model.cutoff if cutoff is None else cutoff
    out = items
    for f in fields:
        out = out.withColumn(f"p_{f}", score(model, items[f]))
    return out.withColumn("residue", F.greatest(F.lit(0.0), *(f"p_{f}" for f in fields)) >= cutoff)


def found(items: DataFrame, cutoff: float | None = None) -> DataFrame:
    """qa_id of the items with residue, each once."""
    narrow = items.select("qa_id", *FIELDS)
    return scored(narrow, train(items), cutoff).where("residue").select("qa_id").distinct()


def validation(items: DataFrame, most: int = MOST_A_CLASS) -> DataFrame:
    """Texts of held-out videos by weak label and decision of the classifier."""
    model = train(items, most)
    unseen = texts_of(items).where("held_out and label is not null")
    return unseen.groupBy("label", (score(model, F.col("text")) >= model.cutoff).cast("int").alias("decision")).agg(F.count(F.lit(1)).alias("texts"))
