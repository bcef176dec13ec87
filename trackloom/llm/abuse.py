"""Abusive, hateful or sexual passages in documents.

Method: a support vector machine on a gap-weighted subsequence kernel. The kernel counts common subsequences of three to six
characters with every pattern of gaps inside a span of six, each gap paid for by decay, so insults with letters inserted, swapped or left out stay close. Nyström
landmarks (chosen far from each other) give the machine a finite feature space; since the kernel has
explicit coordinates (one a subsequence), landmarks, whitening and machine fold into one weight a coordinate, and a passage
is scored by summing weights. A document's score is that of its worst passage; passages are windows of words.

Training sentences are seeds and the windows of all reviewed documents: those of documents found harmless are negative, and of each
document found offensive the worst windows under the model so far are positive. A part of the reviewed documents is held out, and all of it sets the cutoff.
The machine is that of all windows, though few are ever held: a harmless window beyond the margin costs nothing, so the machine is fitted to a working set, all harmless documents
are scored with it, and what lies inside the margin joins the set, until nothing is new. Scoring, features and the sums of each Newton step are made where the rows lie; the driver gets
sums of fixed size, the landmarks and the words of the model. Trained once for each set of reviewed documents (the weights are kept in the shared folder); scoring is one pass over the documents without a shuffle.
"""

from __future__ import annotations

import hashlib
import html
import inspect
import pickle
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import grams, seeds
from trackloom.llm.grams import _MULTIPLIERS, Grams, hashed, norms
from trackloom.session import cut, shared_dir

#: Span of a subsequence, and offsets of its characters: every pattern of gaps for three and four, one gap at most for five characters.
SPAN = 6
SHAPES = (
    [(0, *x) for x in combinations(range(1, SPAN - 1), 2)]
    + [(0, *x) for x in combinations(range(1, SPAN), 3)]
    + [(0, *x) for x in combinations(range(1, SPAN), 4)]
    + [tuple(range(SPAN))]
)
#: Bits of a coordinate's id, decay a gap; the table of weights that passages are scored with has 2 ** SLOT_BITS places.
BITS, DECAY, SLOT_BITS = 62, 0.7, 20
#: Part of each length in the kernel of a text with itself; gaps share it by their decay.
PARTS = {3: 0.4, 4: 0.4, 5: 0.12, 6: 0.08}
_GAPS = [DECAY ** (x[-1] + 1 - len(x)) for x in SHAPES]
WEIGHTS = [g * (PARTS[len(x)] / sum(h * h for y, h in zip(SHAPES, _GAPS) if len(y) == len(x))) ** 0.5 for x, g in zip(SHAPES, _GAPS)]
#: Places of the table of sums by the characters they are of.
KNOWN_BITS = 20
_PAD = "\x00" * (SPAN - 1)
LANDMARKS = 700
#: (words, stride) of the passages scored.
WINDOWS = [(3, 1), (5, 2), (8, 3)]
#: Harmless windows that the working set starts from and landmarks are taken from; of the reviewed documents every HELD_OUT-th is held out for the cutoff.
MOST_NEGATIVE = 9000
HELD_OUT = 4
#: Harmless windows that score above INSIDE cost something; those above NEAR join the working set with them, to spare passes. Those above SLIP that occur once, or far less often than in offensive documents, may be reviewers' slips.
#: What is TIMES as frequent in offensive documents as in harmless ones isn't harmless, however often reviewers erred.
#: Passages of offensive documents below LEAST are far from anything offensive known: many harmless documents have such.
INSIDE, NEAR, SLIP, LEAST, TIMES = -1.0, -1.2, 0.6, -0.3, 10
ROUNDS = 2
#: Weight of the machine's errors against its size; steps to a score in the counts that the cutoff is set from.
C, STEPS = 50_000.0, 4096
#: Texts that are turned into grams at once while training, and that meet the landmarks at once, so that the driver's memory stays small.
BLOCK, MEET = 500, 50
#: Scores above it offend where too few documents are reviewed to set the cutoff, with the part of harmless ones that may lie above; the machine's margins are at -1 and 1.
CUTOFF, CALM, LEAST_REVIEWED = 0.05, 0.01, 25

_ZERO_WIDTH = re.compile("[​-‏⁠﻿­]")
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,200}>")
_SPELLED = re.compile(r"(?<!\w)(?:\w[.\-_·]){2,}\w(?!\w)|(?<![^\W_])(?:\w ){3,}\w(?![^\W_])")
_REPEATED = re.compile(r"([^*])\1{2,}")
_LEET = str.maketrans("013457$@!€|", "oieastsaiei")
_LEETED = re.compile(r"(?=\S*[^\W\d_])(?=\S*[\d$@!€|])[\w$@!€|]+")
_MIXED = re.compile(r"[^\W\d_][\d$@!€|](?=\w)|[\d$@!€|][^\W\d_]")
_MASKED = re.compile(r"\w+\*{2,}\w*")
_WORD = re.compile(r"\S+")
#: Letters of other scripts that look like Latin ones.
_LOOKALIKE = str.maketrans("аеорсухіјѕԁһкмтвнАЕОРСУХІЈЅКМТВНαεορτυνικ", "aeopcyxijsdhkmtbhaeopcyxijskmtbhaeoptuvik")
_LATIN = re.compile(r"[a-zA-Z]")
_COMBINING = re.compile(f"[{''.join(chr(c) for c in range(0x300, 0x3100) if unicodedata.combining(chr(c)))}]")
_FOREIGN = re.compile(r"[Ͱ-ӿ]")


def _leet(m: re.Match) -> str:
    word = m.group()
    tail = len(word) - len(word.rstrip("!|"))
    core = word[: len(word) - tail]
    digits = sum(c.isdigit() for c in core)
    if not tail and not digits and not re.search(r"[$@!€|]", core) or (digits > 3 and len(core) >= 8 and re.fullmatch(r"[0-9a-f]+", core)):
        return word
    return core.translate(_LEET) + word[len(core) :]


def normalise(text: str) -> str:
    """Lower case without accents, look-alikes, digits for letters, spelled-out, stretched or invisible characters."""
    if "Ã" in text or "â€" in text:
        try:
            text = text.encode("cp1252").decode("utf-8")
        except UnicodeError:
            pass
    text = _TAG.sub(" ", html.unescape(_ZERO_WIDTH.sub("", text)))
    if _FOREIGN.search(text):
        text = " ".join(w.translate(_LOOKALIKE) if _LATIN.search(w) else w for w in text.split(" "))
    if text.isascii():
        text = " ".join(text.lower().split())
    else:
        text = _COMBINING.sub("", unicodedata.normalize("NFKD", text).casefold())
        text = " ".join(text.split())
    if _MIXED.search(text):
        text = _LEETED.sub(_leet, text)
    text = _SPELLED.sub(lambda m: re.sub(r"[.\-_· ]", "", m.group()), text)
    return _REPEATED.sub(r"\1", text)


def windows(text: str) -> list[tuple[int, int]]:
    """Start and end (characters) of the passages of a normalised text: windows of words, and the last words of each size."""
    at = [m.span() for m in _WORD.finditer(text)]
    if not at:
        return []
    out = []
    for size, stride in WINDOWS:
        last = max(len(at) - size, 0)
        for i in [*range(0, last, stride), last]:
            out.append((at[i][0], at[min(i + size, len(at)) - 1][1]))
    return sorted(set(out))


def _passages(point: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first and last + 1 position of the windows of all texts at once. Text i has the code points base[i] to base[i + 1], with a blank at either end."""
    blank = (point == 32) | (point == 0)
    start = np.flatnonzero(~blank[1:] & blank[:-1]) + 1
    end = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    of = np.searchsorted(base, start, "right") - 1
    n = np.bincount(of, minlength=len(base) - 1)
    first = np.cumsum(n) - n
    texts, lo, hi = [], [], []
    for size, stride in WINDOWS:
        some = np.flatnonzero(n)
        last = np.maximum(n[some] - size, 0)
        k = -(-last // stride) + 1  # windows at 0, stride, ... below last, and at last
        owner = np.repeat(some, k)
        i = np.minimum((np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)) * stride, np.repeat(last, k))
        texts.append(owner)
        lo.append(start[first[owner] + i])
        hi.append(end[first[owner] + np.minimum(i + size, n[owner]) - 1])
    return np.concatenate(texts), np.concatenate(lo), np.concatenate(hi)


@dataclass
class Machine:
    """coordinates (rising) and their weights; see fold(). made: the space and the weights in it that they come from; where it is known, tasks get this and fold it themselves."""

    coordinates: np.ndarray
    weights: np.ndarray
    bias: float
    masked: dict[str, str] = field(default_factory=dict)
    cutoff: float = 0.0
    slots: tuple[np.ndarray, np.ndarray] | None = field(default=None, repr=False)
    known: tuple[np.ndarray, np.ndarray] | None = field(default=None, repr=False)
    made: tuple[Space, np.ndarray] | None = field(default=None, repr=False)

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights by the first bits of the id, and eight further bits that tell a coordinate from others in its place."""
        if self.slots is None:
            weight, tag = np.zeros(1 << SLOT_BITS, np.float32), np.zeros(1 << SLOT_BITS, np.uint8)
            order = np.argsort(np.abs(self.weights), kind="stable")  # of two in one place the heavier stays
            at = self.coordinates[order] >> (BITS - SLOT_BITS)
            weight[at] = self.weights[order]
            tag[at] = (self.coordinates[order] >> (BITS - SLOT_BITS - 8)) & 255
            self.slots = weight, tag
        return self.slots

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the hashes that are coordinates, and their weights."""
        weight, tag = self.table()
        slot = (h >> np.uint64(64 - SLOT_BITS)).astype(np.int32)
        at = np.flatnonzero(tag[slot] == ((h >> np.uint64(64 - SLOT_BITS - 8)) & np.uint64(255)).astype(np.uint8))
        return at, weight[slot[at]]

    def __getstate__(self):
        return {**self.__dict__, "slots": None, "known": None} | ({"coordinates": None, "weights": None} if self.made else {})

    def __setstate__(self, state):
        self.__dict__.update(state)
        if self.made:
            self.coordinates, self.weights = self.made[0].fold(self.made[1])

    def clean(self, text: str) -> str:
        """normalise(), and words with starred letters as the offending word that they fit, where there is one."""
        return self.unmasked(normalise(text))

    def unmasked(self, text: str) -> str:
        return _MASKED.sub(lambda m: self.masked.get(m.group(), m.group()), text) if "*" in text else text

    def starting(self, point: np.ndarray) -> np.ndarray:
        """Weighted sum of the coordinates that start at each position: a function of the SPAN characters from there, so it is kept by their hash."""
        n = len(point) - SPAN + 1
        if n <= 0:
            return np.zeros(0)
        h = np.zeros(n, np.uint64)
        for k in range(SPAN):
            h = (h ^ point[k : k + n]) * _MULTIPLIERS[k]
            h ^= h >> np.uint64(29)
        if self.known is None:
            self.known = np.zeros(1 << KNOWN_BITS, np.uint64), np.zeros(1 << KNOWN_BITS, np.float32)
        keys, values = self.known
        slot = (h >> np.uint64(64 - KNOWN_BITS)).astype(np.int32)
        out = values[slot].astype(np.float64)
        new = np.flatnonzero(keys[slot] != h)
        if len(new):
            _, first, back = np.unique(h[new], return_index=True, return_inverse=True)
            at = new[first]
            heads: dict[tuple[int, ...], np.ndarray] = {}
            points = [point[at + k] for k in range(SPAN)]
            total = np.zeros(len(at))
            for shape, w in zip(SHAPES, WEIGHTS):
                hit, value = self.hits(_hash(points, shape, heads))
                total[hit] += w * value
            out[new] = total[back]
            keys[slot[at]], values[slot[at]] = h[at], total
        return out

    def passages(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Score of every passage of normalised texts, the text it is of, and its span in that text."""
        # behind each text stand characters that are in no coordinate, so that none reaches into the next
        data = "".join(f" {t} {_PAD}" for t in texts).encode("utf-32-le", "surrogatepass")
        point = np.frombuffer(data, np.uint32).astype(np.uint64)
        base = np.cumsum([0] + [len(t) + 2 + len(_PAD) for t in texts])
        sums, squares = np.zeros(len(point) + 1), np.zeros(len(point) + 1)
        sums[1 : max(len(point) - SPAN + 2, 1)] = self.starting(point)
        left = np.repeat(base[1:], np.diff(base)) - len(_PAD) - np.arange(len(point))  # characters of the text from here on
        for last in {shape[-1] for shape in SHAPES}:
            squares[1:] += (left > last) * sum(w * w for x, w in zip(SHAPES, WEIGHTS) if x[-1] == last)
        sums, squares = np.cumsum(sums), np.cumsum(squares)
        of, a, b = _passages(point, base) if len(point) else (np.zeros(0, np.int64),) * 3
        lo, hi = a - 1, np.minimum(b, len(point))  # with the blank before; grams that start in the passage
        score = (sums[hi] - sums[lo]) / np.sqrt(np.maximum(squares[hi] - squares[lo], 1e-9)) + self.bias
        return score, of, a - base[of] - 1, b - base[of] - 1

    def alone(self, texts: list[str]) -> np.ndarray:
        """Score of each normalised text taken as one passage."""
        out = []
        for i in range(0, len(texts), BLOCK):
            g, n = _grams(texts[i : i + BLOCK])
            at, value = self.hits(g.ids.astype(np.uint64) << np.uint64(64 - BITS))
            out.append(np.bincount(g.text[at], weights=g.weight[at] * value, minlength=g.texts) / n + self.bias)
        return np.concatenate(out) if out else np.zeros(0)

    def score(self, texts: list[str], clean: Callable[[str], str] | None = None) -> np.ndarray:
        """Worst passage of each raw text, -9 for a text without words. clean: what is left to do to the texts, by default all."""
        out = np.full(len(texts), -9.0)
        step = 256
        for i in range(0, len(texts), step):
            score, of, _, _ = self.passages([(clean or self.clean)(t) for t in texts[i : i + step]])
            np.maximum.at(out, of + i, score)
        return out


def _hash(points: list[np.ndarray], shape: tuple[int, ...], heads: dict[tuple[int, ...], np.ndarray]) -> np.ndarray:
    """Hashes of a shape, as grams.hashed() gives them, from the characters at each offset; those of its beginning are taken from heads."""
    key = (len(shape), *shape[:-1])
    if key not in heads:
        h = np.full(len(points[0]), len(shape), np.uint64)
        for k, off in enumerate(shape[:-1]):
            h = (h ^ points[off]) * _MULTIPLIERS[k]
            h ^= h >> np.uint64(29)
        heads[key] = h
    h = (heads[key] ^ points[shape[-1]]) * _MULTIPLIERS[len(shape) - 1]
    return h ^ (h >> np.uint64(29))


def _grams(texts: list[str]) -> tuple[Grams, np.ndarray]:
    g = hashed(texts, SHAPES, BITS, WEIGHTS)
    return g, norms(g)


class Postings:
    """Normalised coordinates of some texts, by coordinate: which texts hold it, and how much."""

    def __init__(self, texts: list[str]):
        g, n = _grams(texts)
        order = np.argsort(g.ids, kind="stable")
        ids = g.ids[order]
        self.text, self.weight, self.texts = g.text[order], (g.weight / n[g.text])[order], len(texts)
        self.coordinates, self.first = np.unique(ids, return_index=True)
        self.count = np.diff(np.append(self.first, len(ids)))
        self.there = np.zeros(1 << SLOT_BITS, bool)  # spares most searches
        self.there[self.coordinates >> (BITS - SLOT_BITS)] = True

    def kernel(self, texts: list[str]) -> np.ndarray:
        """Normalised kernel of texts with these (texts x these)."""
        out = np.zeros((len(texts), self.texts), np.float32)
        for i in range(0, len(texts), MEET):
            g, n = _grams(texts[i : i + MEET])
            some = np.flatnonzero(self.there[g.ids >> (BITS - SLOT_BITS)])
            at = np.minimum(np.searchsorted(self.coordinates, g.ids[some]), len(self.coordinates) - 1)
            known = self.coordinates[at] == g.ids[some]
            at, some = at[known], some[known]
            of, w = g.text[some], g.weight[some] / n[g.text[some]]
            count = self.count[at]
            place = np.arange(count.sum()) + np.repeat(self.first[at] - (np.cumsum(count) - count), count)
            flat = np.repeat(of * self.texts, count) + self.text[place]
            out[i : i + MEET] = np.bincount(flat, weights=np.repeat(w, count) * self.weight[place], minlength=g.texts * self.texts).reshape(g.texts, self.texts)
        return out


def _spread(texts: list[str], n: int, seed: int) -> list[str]:
    """About n of the texts, each far from those before: the farthest of a random few, again and again."""
    rng = np.random.default_rng(seed)
    texts = sorted(set(texts))
    if len(texts) <= n:
        return texts
    pool = [texts[i] for i in rng.permutation(len(texts))[: 3 * n]]
    near = np.zeros(len(pool))
    chosen: list[int] = [0]
    for _ in range(n // 25):
        near = np.maximum(near, Postings([pool[i] for i in chosen[-25:]]).kernel(pool).max(1))
        near[chosen] = 2
        chosen += [int(i) for i in np.argsort(near)[:25]]
    return [pool[i] for i in dict.fromkeys(chosen)][:n]


class Space:
    """The Nyström space of some landmarks: coordinates of texts, and weights folded back onto subsequences.

    Tasks get the texts of the landmarks and make the space of them, once a worker: as arrays it would be a broadcast, of which every executor writes a copy to its disk.
    """

    def __init__(self, positive: list[str], negative: list[str], landmarks: int = LANDMARKS, seed: int = 3):
        self._make(_spread(positive, landmarks // 2, seed) + _spread(negative, landmarks // 2, seed))

    def _make(self, marks: list[str]) -> None:
        self.texts = tuple(marks)
        self.marks = Postings(marks)
        value, vector = np.linalg.eigh(self.marks.kernel(marks).astype(np.float64))
        self.white = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-3))) @ vector.T

    def __reduce__(self):
        return _space, (self.texts,)

    def fold(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coordinates of the landmarks and the weight of each."""
        m = self.marks
        return m.coordinates, np.add.reduceat(m.weight * (self.white @ w)[m.text], m.first)


@lru_cache(maxsize=1)
def _space(texts: tuple[str, ...]) -> Space:
    space = Space.__new__(Space)
    space._make(list(texts))
    return space


def newton(space: Space, examples: DataFrame, w: np.ndarray | None = None, rounds: int = 25) -> np.ndarray:
    """Weights (bias last) in the space of the machine on all examples (x: their features; y: 1 or -1; cost): squared hinge loss by Newton steps from w."""
    n = len(space.white) + 1
    ridge = np.ones(n)
    ridge[-1] = 1e-3
    w = np.zeros(n) if w is None else w
    tasks = min(_tasks(examples), 1 + examples.count() // 1500)
    for _ in range(rounds):
        total = _summed(examples, lambda rows, w=w: _step(rows, w), tasks)
        new = np.linalg.solve(total[:, :-1] + np.diag(ridge), total[:, -1])
        done = np.abs(new - w).max() <= 1e-5 * np.abs(new).max()
        w = new
        if done:  # the same examples cost something as before
            break
    return w


def _step(rows: pd.DataFrame, w: np.ndarray) -> np.ndarray:
    """Both sides of the equations of a Newton step, summed over the rows that cost something under w."""
    out = np.zeros((len(w), len(w) + 1))
    y, cost = rows["y"].to_numpy(), rows["cost"].to_numpy()
    for i in range(0, len(rows), BLOCK):
        x = np.frombuffer(b"".join(rows["x"].iloc[i : i + BLOCK]), np.float32).reshape(-1, len(w) - 1).astype(np.float64)
        x, ys = np.c_[x, np.ones(len(x))], y[i : i + BLOCK]
        at = ys * (x @ w) < 1
        xc = x[at] * cost[i : i + BLOCK][at][:, None]
        out[:, :-1] += xc.T @ x[at]
        out[:, -1] += xc.T @ ys[at]
    return out


def _summed(rows: DataFrame, of: Callable[[pd.DataFrame], np.ndarray], tasks: int) -> np.ndarray:
    """Sum over all rows of symmetric arrays with one further column, added up where the rows lie, then in some tasks, so that the driver gets few; sent without the lower half."""

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for f in frames:
            if len(f):
                total = of(f) if total is None else total + of(f)
        if total is not None:
            yield pd.DataFrame({"sum": [total[~np.tri(*total.shape, -1, dtype=bool)].tobytes()]})

    def again(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for f in frames:
            for b in f["sum"]:
                total = np.frombuffer(b) if total is None else total + np.frombuffer(b)
        if total is not None:
            yield pd.DataFrame({"sum": [total.tobytes()]})

    parts = rows.coalesce(tasks).mapInPandas(first, "sum binary")
    if tasks > 16:
        parts = parts.repartition(int(tasks**0.5)).mapInPandas(again, "sum binary")
    total = sum(np.frombuffer(b.as_buffer()) for b in parts.toArrow()["sum"])
    n = int((2 * len(total) + 2.25) ** 0.5 - 1.5 + 0.5)
    out = np.zeros((n, n + 1))
    out[~np.tri(n, n + 1, -1, dtype=bool)] = total
    return out + np.tril(np.c_[out[:, :-1].T, np.zeros(n)], -1)


def featured(space: Space, parts: DataFrame) -> DataFrame:
    """part, weight, x of every row, kept in the shared folder."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in range(0, len(f), BLOCK):
                g = f.iloc[i : i + BLOCK]
                x = (space.marks.kernel(g["part"].tolist()) @ space.white).astype(np.float32)
                yield g.assign(x=[v.tobytes() for v in x])[["part", "weight", "x"]]

    return cut(_spread_out(parts.select("part", "weight")).mapInPandas(run, "part string, weight double, x binary"))


def _tasks(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _spread_out(rows: DataFrame) -> DataFrame:
    return rows.repartition(_tasks(rows))


def seed_sentences(seed: int = 1, times: int = 6) -> tuple[list[str], list[str]]:
    """Seeds with their slots filled, each `times` over."""
    rng = np.random.default_rng(seed)
    pick = lambda words: words[rng.integers(len(words))]
    out = []
    for s in seeds.OFFENDING:
        for _ in range(times if "{" in s else 1):
            t = s
            for slot, words in (("{i}", seeds.INSULTS), ("{a}", seeds.ADJECTIVES), ("{g}", seeds.GROUPS)):
                while slot in t:
                    t = t.replace(slot, pick(words), 1)
            out.append(t)
    return [normalise(t) for t in dict.fromkeys(out)], [normalise(t) for t in seeds.HARMLESS]


def garbled(texts: list[str], share: float, seed: int = 2) -> list[str]:
    """Some of the texts with a word misspelled: neighbours swapped, a letter doubled, dropped or inserted."""
    rng = np.random.default_rng(seed)
    out = []
    for t in texts:
        words = t.split(" ")
        long = [i for i, w in enumerate(words) if len(w) > 3]
        if long and rng.random() < share:
            i = long[rng.integers(len(long))]
            w, p = words[i], int(rng.integers(1, len(words[i]) - 1))
            words[i] = [w[:p] + w[p + 1] + w[p] + w[p + 2 :], w[:p] + w[p] + w[p:], w[:p] + w[p + 1 :], w[:p] + "x" + w[p:]][rng.integers(4)]
            out.append(" ".join(words))
    return out


def _masks(words: list[str]) -> dict[str, str]:
    """Starred forms of words, first letters and last letters kept."""
    out: dict[str, str] = {}
    for w in words:
        for a in (1, 2):
            for b in (0, 1, 2):
                if len(w) - a - b >= 2:
                    out.setdefault(w[:a] + "*" * (len(w) - a - b) + w[len(w) - b :], w)
    return out


@dataclass
class Reviewed:
    """rows: text, verdict (1 offensive), held of every reviewed document. Only the cutoff is set from those held out."""

    rows: DataFrame

    def __len__(self) -> int:
        return self.rows.count()

    def mark(self) -> tuple:
        """Changes with the documents, not with their order."""
        h = F.xxhash64("text", "verdict", "held")
        return tuple(self.rows.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(20,0)")), F.bit_xor(F.xxhash64(F.lit("p10"), "text", "verdict", "held"))).first())


def reviewed(documents: DataFrame, reviews: DataFrame) -> Reviewed:
    """All reviewed documents but those in dispute."""
    verdict = reviews.where("doc_id is not null and offensive is not null").groupBy("doc_id").agg(F.avg("offensive").alias("mean"))
    verdict = verdict.where("mean <> 0.5").select("doc_id", (F.col("mean") > 0.5).cast("int").alias("verdict"))
    both = documents.select("doc_id", "text").where("text is not null").join(verdict, "doc_id")
    return Reviewed(both.select("text", "verdict", (F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0).alias("held")))


def best_cutoff(score: np.ndarray, verdict: np.ndarray, share: float | None = None, count: np.ndarray | None = None) -> float:
    """The cutoff with the best F1 for verdicts. Among nearly equal ones (reviewers err) the middle of their range.

    Too few offensive documents set none: then all but CALM of the harmless ones lie below it, and it is CUTOFF at least.
    share: of offensive documents among all, where the sample's own isn't it. count: documents of each score and verdict, by default one.
    """
    count = np.ones(len(score)) if count is None else count.astype(float)
    bad, good = count[verdict == 1].sum(), count[verdict == 0].sum()
    if bad < LEAST_REVIEWED or good < LEAST_REVIEWED:
        return max(CUTOFF, float(np.quantile(score[verdict == 0], 1 - CALM, weights=count[verdict == 0], method="inverted_cdf"))) if good else CUTOFF
    order = np.argsort(-score)
    share = share or bad / (bad + good)
    weight = (count * np.where(verdict == 1, share / bad, (1 - share) / good))[order]
    hit = np.cumsum(weight * (verdict[order] == 1))
    f1 = 2 * hit / (np.cumsum(weight) + hit[-1])
    near = score[order][f1 >= f1.max() - 0.002]
    return float((near.max() + near.min()) / 2)


def _pairs(text: str) -> list[tuple[str, str]]:
    words = [w.strip(".,!?;:\"()") for w in text.split()]
    return list(zip(words, words[1:]))


def _each(rows: DataFrame, of: Callable[[list[str]], Iterator[tuple]], schema: str) -> DataFrame:
    """The rows that `of` makes of blocks of texts."""
    names = [c.split()[0] for c in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = f["text"].tolist()
            for i in range(0, len(texts), 256):
                if made := list(of(texts[i : i + 256])):
                    yield pd.DataFrame(made, columns=names)

    return rows.select("text").mapInPandas(run, schema)


def usual_windows(clean: DataFrame, most: int) -> tuple[list[str], list[str]]:
    """Of all windows of normalised texts the `most` that occur most often, and as many by their hash."""
    parts = _each(clean, lambda texts: ((t[a:b],) for t in texts for a, b in windows(t)), "part string").groupBy("part").agg(F.count(F.lit(1)).alias("n"))

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        often = drawn = None
        for f in frames:
            often = pd.concat([often, f]).sort_values(["n", "h"], ascending=[False, True])[:most]
            drawn = pd.concat([drawn, f]).sort_values("h")[:most]
        if often is not None:
            yield pd.concat([often, drawn]).drop_duplicates("part")

    some = cut(parts.withColumn("h", F.xxhash64("part")).mapInPandas(best, "part string, n long, h long"))
    return [[r["part"] for r in some.orderBy(*order).limit(most).collect()] for order in ((F.desc("n"), "h"), ("h", "part"))]


def hard_windows(machine: Machine, clean: DataFrame, dirty: DataFrame | None = None, odds: float = 0.0) -> DataFrame:
    """part, n, score of all windows of normalised texts that score above NEAR where they stand, but those that may be slips. dirty: offensive texts, odds: how many harmless ones there are to one."""

    def run(texts: list[str]) -> Iterator[tuple]:
        score, of, start, end = machine.passages(texts)
        for j in np.flatnonzero(score > NEAR):
            yield texts[of[j]][start[j] : end[j]], float(score[j])

    every = _each(clean, run, "part string, score double").withColumn("bad", F.lit(0))
    if dirty is not None:
        every = every.union(_each(dirty, run, "part string, score double").withColumn("bad", F.lit(1)))
    hard = every.groupBy("part").agg(F.count_if(F.col("bad") == 0).alias("n"), F.sum("bad").alias("m"), F.max("score").alias("score")).where("n > 0")
    return hard.where(~((F.col("score") > SLIP) & ((F.col("n") < 2) | (F.col("n") * TIMES < F.col("m") * odds)))).drop("m")


def fit(space: Space, positive: DataFrame, negative: list[DataFrame], clean: DataFrame | None, machine: Machine | None = None, w: np.ndarray | None = None, dirty: DataFrame | None = None, odds: float = 0.0) -> tuple[Machine, list[DataFrame], np.ndarray]:
    """The machine of the positive rows (as featured() gives them) and every window of the harmless texts, both classes of equal weight, its negative rows and its weights in the space.

    negative: the working set so far, machine: what the first further rows are found with, by default that of the working set, w: weights to start from. Without texts the machine is that of the rows given.
    A harmless window weighs as if those inside the margin at first were all of its class, or as one of the first working set where that is larger.
    """
    plus, minus = positive.agg(F.sum("weight")).first()[0], sum(x.agg(F.sum("weight")).first()[0] for x in negative)
    size = None
    while True:
        if machine is not None:
            held = negative[0].select("part")
            for x in negative[1:]:
                held = held.union(x.select("part"))
            hard = cut(hard_windows(machine, clean, dirty, odds))
            inside = F.col("score") > INSIDE
            if size is None:
                size = max(minus, hard.where(inside).count())
                first = True
            new = hard.join(held, "part", "left_anti")
            found = new.agg(F.count_if(inside)).first()[0]
            if found:
                negative = [*negative, featured(space, new.withColumn("weight", F.lit(1.0)))]
            elif not first:
                return machine, negative, w
            first = False
        rows = positive.select("x", F.lit(1.0).alias("y"), (F.col("weight") * (0.5 * C / plus)).alias("cost"))
        for x in negative:
            rows = rows.union(x.select("x", F.lit(-1.0), F.col("weight") * (0.5 * C / (size or minus))))
        w = newton(space, rows, w)
        machine = Machine(*space.fold(w[:-1]), float(w[-1]), made=(space, w[:-1]))
        if clean is None:
            return machine, negative, w


def _common(clean: DataFrame, dirty: DataFrame, odds: float) -> DataFrame:
    """Word pairs of two harmless texts at least that aren't far more frequent in offensive ones; odds: how many harmless ones there are to one."""
    pairs = lambda rows: _each(rows, lambda texts: (("\t".join(p),) for t in texts for p in set(_pairs(t))), "pair string")
    both = pairs(clean).withColumn("bad", F.lit(0)).union(pairs(dirty).withColumn("bad", F.lit(1)))
    return both.groupBy("pair").agg(F.count_if(F.col("bad") == 0).alias("n"), F.sum("bad").alias("m")).where((F.col("n") > 1) & (F.col("n") * TIMES >= F.col("m") * odds)).select("pair")


def _offending(machine: Machine, dirty: DataFrame, common: DataFrame) -> DataFrame:
    """part, weight (how often) of the three worst passages of each offensive document above LEAST."""

    def run(texts: list[str]) -> Iterator[tuple]:
        texts = [machine.unmasked(t) for t in texts]
        score, of, start, end = machine.passages(texts)
        order = np.lexsort((-score, of))
        place = np.arange(len(order)) - np.searchsorted(of[order], of[order])
        for j in order[(place < 3) & (score[order] > LEAST)]:
            yield (texts[of[j]][start[j] : end[j]],)

    found = cut(_each(dirty, run, "part string").groupBy("part").agg(F.count(F.lit(1)).cast("double").alias("weight")))
    # what harmless documents say too, word pair by word pair, isn't what the verdict was for, nor what is far from anything offensive known
    pairs = _each(found.select(F.col("part").alias("text")), lambda texts: ((t, "\t".join(p)) for t in texts for p in set(_pairs(t))), "part string, pair string")
    return cut(found.join(pairs.join(common, "pair", "left_anti").select("part").distinct(), "part", "left_semi"))


def train(rows: pd.DataFrame | Reviewed, most_negative: int = MOST_NEGATIVE) -> Machine:
    """The machine from seeds and reviewed documents (text, verdict; held, if given, marks those that only set the cutoff)."""
    if isinstance(rows, pd.DataFrame):
        rows = Reviewed(SparkSession.builder.getOrCreate().createDataFrame(rows if "held" in rows else rows.assign(held=False)))
    spark = rows.rows.sparkSession
    table = lambda parts: spark.createDataFrame(pd.Series(parts).value_counts().astype(float).rename_axis("part").reset_index(name="weight"))
    lower = F.pandas_udf(lambda texts: texts.map(normalise), "string")
    every = cut(_spread_out(rows.rows).select(lower("text").alias("text"), "verdict", "held"))
    clean, dirty = (every.where((F.col("verdict") == v) & ~F.col("held")) for v in (0, 1))
    bad, good = seed_sentences()
    seeded = bad + garbled(bad, 0.3)
    odds = clean.count() / max(dirty.count(), 1)
    common = cut(_common(clean, dirty, odds))
    known = cut(_each(clean, lambda texts: ((w,) for w in {w for t in texts for w in t.split()}), "word string").distinct())
    words = [w for s in seeds.INSULTS + seeds.ADJECTIVES + seeds.GROUPS for w in normalise(s).split()] + [w for t in bad for w in t.replace(",", " ").split() if len(w) > 3]
    often, drawn = usual_windows(clean, most_negative // 4)
    pool = list(dict.fromkeys(often + drawn))
    space = Space(seeded, good + pool)
    # this one only proposes the first passages and landmarks; the machines of the rounds are those of all windows
    machine, _, w = fit(space, featured(space, table(seeded)), [featured(space, table(good * 3 + pool))], None)
    machine.masked = _masks(list(dict.fromkeys(words)))
    for r in range(ROUNDS):
        found = _offending(machine, dirty, common)
        new = _each(found.select(F.col("part").alias("text")), lambda texts: ((w,) for t in texts for w in (x.strip(".,!?;:") for x in t.split()) if len(w) > 3 and w.isalpha()), "word string").distinct()
        words += sorted(x["word"] for x in new.join(known, "word", "left_anti").collect())
        if r == 0:
            worst = [x["part"] for x in hard_windows(machine, clean, dirty, odds).orderBy(F.desc("score"), "part").limit(most_negative // 3).collect()]
            drawn_too = [x["part"] for x in found.orderBy(F.xxhash64("part")).limit(3 * LANDMARKS).collect()]
            pool = list(dict.fromkeys(worst + pool))
            space = Space(seeded + drawn_too, good + pool)
            negative, w, machine = [featured(space, table(good * 3 + pool))], None, None
        positive = featured(space, table(seeded).union(found.select("part", "weight")))
        machine, negative, w = fit(space, positive, negative, clean, machine, w, dirty, odds)
        machine.masked, machine.cutoff = _masks(list(dict.fromkeys(words))), CUTOFF
    machine = final = replace(machine, made=None)  # scoring needs no space
    at = F.pandas_udf(lambda texts: pd.Series(final.score(texts.tolist(), final.unmasked)), "double")
    held = every.where("held").select("verdict", F.floor(at("text") * STEPS).alias("step")).groupBy("verdict", "step").count().toPandas()
    if len(held):
        machine.cutoff = best_cutoff((held["step"].to_numpy() + 0.5) / STEPS, held["verdict"].to_numpy(), count=held["count"].to_numpy())
    return machine


_models: dict[str, Machine] = {}


def trained(documents: DataFrame, reviews: DataFrame) -> Machine:
    """The machine of these tables' reviewed documents; what was trained on the same documents before is taken from the shared folder."""
    rows = reviewed(documents, reviews)
    state = (rows.mark(), *(inspect.getsource(m) for m in (sys.modules[__name__], grams, seeds)))
    key = hashlib.md5(repr(state).encode("utf-8", "surrogatepass")).hexdigest()
    if key not in _models:
        spark = documents.sparkSession
        path = f"{shared_dir(spark)}/trackloom-models/{key}"
        try:
            _models[key] = pickle.loads(spark.read.parquet(path).first()["model"])
        except AnalysisException:  # not trained yet
            _models[key] = train(rows)
            spark.createDataFrame([(bytearray(pickle.dumps(_models[key])),)], "model binary").write.mode("overwrite").parquet(path)
    return _models[key]


def scores(text: Column, machine: Machine) -> Column:
    """Score of the text's worst passage; above machine.cutoff it offends. -9 for null, empty and blank texts."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(machine.score([t or "" for t in texts]))

    return F.pandas_udf(run, "double")(text)


def scored(documents: DataFrame, reviews: DataFrame) -> DataFrame:
    """doc_id, source, score, offending of every document; repeated rows stay repeated."""
    machine = trained(documents, reviews)
    return documents.select("doc_id", "source", scores(documents["text"], machine).alias("score")).withColumn("offending", F.col("score") > machine.cutoff)


def rates(documents: DataFrame, reviews: DataFrame) -> DataFrame:
    """source, documents, offending, rate; a null source is a source of its own."""
    return scored(documents, reviews).groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("offending").cast("int")).alias("offending")).withColumn("rate", F.col("offending") / F.col("documents"))
