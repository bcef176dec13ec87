"""Parts of the methods against brute force: min-hash recall, alignment, kernel, quotas and the cut of a mix."""

import itertools
import pickle
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.llm import abuse as A
from trackloom.llm import mixing as M
from trackloom.llm import quota as Q
from trackloom.llm import residue as R
from trackloom.llm import truncation as T


def shingles(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_bands_find_nine_of_ten_pairs_of_similarity_point_eight():
    r = random.Random(7)
    vocabulary = [f"w{i}" for i in range(3000)]
    found = total = 0
    for _ in range(400):
        one = [r.choice(vocabulary) for _ in range(r.randint(30, 120))]
        two = list(one)
        for _ in range(r.randint(0, 2)):
            two[r.randrange(len(two))] = r.choice(vocabulary)
        two = two[: len(two) - r.randint(0, 4)]
        a, b = shingles(one), shingles(two)
        if len(a & b) / len(a | b) >= 0.8:
            x, y = T._signatures([one, two], {})
            total += 1
            found += bool({*enumerate(x)} & {*enumerate(y)})
    assert total > 200 and found / total >= 0.9


def test_signatures_do_not_depend_on_the_batch():
    words = [["a", "b"], list("abcdefgh"), [], list("xyzxyzxyz"), list("abcdefgh")]
    many = T._signatures(words, {})
    assert many == [T._signatures([w], {})[0] for w in words] and many[1] == many[4] and many[0] == many[2] == []


def test_alignment():
    long = " ".join(f"w{i}" for i in range(50))
    cut = " ".join(long.split()[:44])
    assert T.ends_early(cut + " w4", long) and T.ends_early(cut.replace("w40", "other") + " w44", long)
    assert not T.ends_early(long, long) and not T.ends_early(cut + " elsewhere", long) and not T.ends_early("something else that is long enough here", long) and not T.ends_early("a", long)


def test_undecided_texts_meet_every_longer_text_of_their_buckets(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 3)
    r = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(base[:55]) + " w5", True), (2, " ".join(base), False)]
    # longer texts of the same buckets that go on otherwise: the longest isn't the one that fits
    rows += [(10 + k, " ".join(base[:55]) + " " + " ".join(f"z{k}{r.random()}" for _ in range(6)), False) for k in range(20)]
    texts = spark.createDataFrame(rows + rows[:3], "tid bigint, text string, unfinished boolean")
    assert [x["tid"] for x in T.early_ends(texts).collect()] == [1]
    assert T.early_ends(texts.limit(0)).count() == 0


def test_closing_words_and_broken_words(spark):
    said = ["The cup is gone. The cup moves. It is gone."] * 30 + ["The folded cup is gone."] * 30
    texts = spark.createDataFrame([(t,) for t in said] + [(None,), ("",)], "text string")
    ends = spark.createDataFrame([("gone",), ("the",), ("fold",), ("never",)], "word string")
    got = {r["word"]: (r["odds"], r["broken"]) for r in T.with_odds(ends, T.closing_words(texts, "text")).collect()}
    assert got["gone"][0] < -3 and got["the"][0] > 3 and got["fold"] == (0.0, 3.0) and got["never"] == (0.0, 0.0)


def brute_kernel(a, b):
    def phi(text):
        text = f" {text} "
        out = {}
        for n in (3, 4, 5, 6):
            shapes = [x for x in A.SHAPES if len(x) == n]
            for shape, weight in ((x, A.WEIGHTS[A.SHAPES.index(x)]) for x in shapes):
                for i in range(len(text) - shape[-1]):
                    g = "".join(text[i + o] for o in shape)
                    out.setdefault(g, []).append(weight)
        return out

    x, y = phi(a), phi(b)
    dot = lambda p, q: sum(sum(p[g]) * sum(q[g]) for g in p.keys() & q.keys())
    norm = lambda p: np.sqrt(sum(w * w for v in p.values() for w in v))
    return dot(x, y) / norm(x) / norm(y)


def test_kernel_against_brute_force():
    texts = ["you idiot", "you i.diot", "the cup moves", "yo idiot you"]
    k = A.Postings(texts).kernel(texts)
    for i, j in itertools.product(range(4), range(4)):
        assert k[i, j] == pytest.approx(brute_kernel(texts[i], texts[j]), rel=1e-4)
    assert k[0, 1] > 3 * k[0, 2]
    assert {len(s) for s in A.SHAPES} == {3, 4, 5, 6} and all(s[-1] < A.SPAN for s in A.SHAPES)


def test_passages_are_scored_like_texts_of_their_own():
    rng = np.random.default_rng(1)
    marks = A.Postings(["you stupid idiot", "the cup moves left", "go away fool"])
    m = A.Machine(marks.coordinates, rng.normal(size=len(marks.coordinates)), 0.3)
    text = "the cup moves left and you stupid idiot go away now"
    score, of, a, b = m.passages([text, "", "idiot"])
    whole = {(x, y) for x, y in A.windows(text)}
    assert {(x, y) for x, y, o in zip(a, b, of) if o == 0} == whole
    short = [(s, x, y) for s, x, y, o in zip(score, a, b, of) if o == 2]
    assert len(short) == 3 and short[0][0] == pytest.approx(m.alone(["idiot"])[0], abs=1e-5)


def test_every_reviewed_document_counts(spark):
    documents = spark.range(14_000).selectExpr("id as doc_id", "concat('the cup moves to place ', id) as text")
    reviews = documents.selectExpr("doc_id", "int(doc_id % 2) as offensive")
    rows = A.reviewed(documents, reviews)
    assert len(rows) == 14_000 and rows.rows.where("held").count() > 3000
    assert rows.mark() == A.reviewed(documents.orderBy(F.desc("doc_id")), reviews).mark() != A.reviewed(documents.where("doc_id > 0"), reviews).mark()


def test_machine_is_that_of_all_harmless_windows(spark):
    bad, good = A.seed_sentences(times=1)
    bad, texts = bad[:60], [f"{t} and then {u}" for t, u in zip(good, reversed(good))]
    space = A.Space(bad, good[:10], 40)
    table = lambda parts: spark.createDataFrame([(t, 1.0) for t in parts], "part string, weight double")
    clean = spark.createDataFrame([(t,) for t in texts], "text string")
    machine, negative, w = A.fit(space, A.featured(space, table(bad)), [A.featured(space, table(good[:10]))], clean)
    held = {r["part"] for x in negative for r in x.collect()}
    score, of, a, b = machine.passages(texts)
    inside = [(texts[i][x:y], s) for s, i, x, y in zip(score, of, a, b) if s > A.INSIDE]
    parts = [t for t, _ in inside]
    assert len(held) > 40 and all(t in held or s > A.SLIP and parts.count(t) < 2 for t, s in inside)
    # Newton steps summed over tasks, against the sum over all rows at once
    x = (space.marks.kernel(bad + good) @ space.white).astype(np.float32)
    rows = [(bytes(v.tobytes()), 1.0 if i < len(bad) else -1.0, 2.0) for i, v in enumerate(x)]
    w = A.newton(space, spark.createDataFrame(rows, "x binary, y double, cost double").repartition(5))
    x, y = np.c_[x, np.ones(len(x))].astype(float), np.array([r[1] for r in rows])
    at = y * (x @ w) < 1
    ridge = np.r_[np.ones(len(w) - 1), 1e-3]
    assert ridge * w == pytest.approx(2.0 * x[at].T @ (y - x @ w)[at], abs=1e-6)


def test_training_broadcasts_nothing(spark, monkeypatch):
    sent, broadcast = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda context, value: sent.append(len(value)) or broadcast(context, value))
    words = ["".join(x) for x in np.random.default_rng(4).choice(list("abcdefghijklmnopqrstuvwxyz"), (3000, 6))]
    bad, good = ([" ".join(words[i : i + 5]) for i in range(k, k + 1500, 5)] for k in (0, 1500))
    space = A.Space(bad, good, 600)
    assert sum(x.nbytes for x in (space.white, space.marks.weight, space.marks.coordinates)) > 4 << 20
    table = lambda parts: spark.createDataFrame([(t, 1.0) for t in parts], "part string, weight double")
    machine, _, _ = A.fit(space, A.featured(space, table(bad[:40])), [A.featured(space, table(good[:40]))], None)
    assert machine.coordinates.nbytes + machine.weights.nbytes > 1 << 20
    hard = A.hard_windows(machine, spark.createDataFrame([(bad[0],), (bad[0],)], "text string")).collect()
    assert hard and not sent
    again = pickle.loads(pickle.dumps(machine))
    assert again.score(bad[:50] + good[:50]) == pytest.approx(machine.score(bad[:50] + good[:50]))


def test_sums_of_many_tasks_reach_the_driver_as_arrow(spark, monkeypatch):
    rows = spark.createDataFrame([(float(i),) for i in range(100)], "v double").repartition(20)
    monkeypatch.setattr(type(rows), "collect", lambda self: pytest.fail("rows of sums are collected as Python objects"))
    one = lambda v: np.outer([1.0, v, v * v], [1.0, v, v * v, 7.0])
    assert np.array_equal(A._summed(rows, lambda f: sum(one(v) for v in f["v"]), 20), sum(one(float(i)) for i in range(100)))


def test_verdicts_in_error_make_no_passage_harmless(spark):
    table = lambda texts: spark.createDataFrame([(t,) for t in texts], "text string")
    clean = table(["the cup moves"] * 1000 + ["hateful words"] * 3)
    dirty = table(["the cup moves and hateful words"] * 100)
    assert {r["pair"] for r in A._common(clean, dirty, 10.0).collect()} == {"the\tcup", "cup\tmoves"}


def test_cutoffs():
    assert A.best_cutoff(np.array([2.0, 1.9, -1.0]), np.array([1, 1, 0])) >= A.CUTOFF
    score, verdict = np.r_[np.linspace(1, 2, 100), np.linspace(-2, 0, 300)], np.r_[np.ones(100), np.zeros(300)].astype(int)
    assert 0 <= A.best_cutoff(score, verdict) <= 1.05
    assert A.best_cutoff(score, verdict) == pytest.approx(A.best_cutoff(score, verdict, count=np.full(400, 3)))
    mixed = np.array([2.0, 1.0, 0.0]), np.array([1, 0, 1])
    assert A.best_cutoff(*mixed, count=np.array([900, 500, 30])) == 2 and A.best_cutoff(*mixed, count=np.array([30, 40, 900])) == 0
    assert 0.1 < R.best_cutoff(np.array([0.9, 0.8, 0.1, 0.05]), np.array([1, 1, 0, 0])) < 0.8 and R.best_cutoff(np.array([0.3]), np.array([0])) == 0.5


def test_quotas_reach_rare_categories():
    count = np.array([1000.0, 1000, 12, 900])
    axes = [np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])]
    q = Q.quotas(count, axes, [np.array([0.9, 0.1]), np.array([0.5, 0.5])], [np.array([1.0, 1]), np.array([1.0, 1])], 400)
    assert q.sum() == 400 and abs(q[:2].sum() - 360) <= 2 and abs(q[[0, 2]].sum() - 200) <= 2


def test_the_cut_of_a_mix_against_brute_force(spark):
    r = random.Random(5)
    rows = [(i, s, r.randint(1, 50)) for i, s in enumerate(r.choice("aaaaaabbc") for _ in range(400))]
    d = spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint")
    t = spark.createDataFrame([("a", 0.2, 1), ("b", 0.3, 2), ("c", 0.5, 4), ("d", 0.001, 9)], "source string, target_share double, max_repeats int")
    every = sorted((x["finish"], x["source"], x["doc_id"], x["copy"], x["tokens"]) for x in M.mix(d, t, budget=10**9).collect())
    for budget in (1, 60, 1500, 5000, 12000):
        want, total = set(), 0
        for _, _, doc, copy, tokens in every:
            total += tokens
            if total > budget:
                break
            want.add((doc, copy))
        assert {(x["doc_id"], x["copy"]) for x in M.mix(d, t, budget=budget).collect()} == want, budget
