import numpy as np

from trackloom.llm import mixing as M
from trackloom.llm import quota as Q

TARGETS = "field string, category string, target_share double, min_items int"


def items(spark, n=400):
    rows = [(f"q{i}", "a" if i % 10 < 7 else "b" if i % 10 < 9 else "c", "t1" if i % 3 else "t2", i) for i in range(n)]
    return spark.createDataFrame([*rows, *rows[:50], ("x", None, "t1", 1), (None, "a", "t1", 1), ("y", "other", "t1", 1)], "qa_id string, dim string, tier string, cell int")


def test_sample_meets_targets_and_reports_the_rest(spark):
    targets = spark.createDataFrame([("dim", "a", 0.5, 5), ("dim", "b", 0.3, 5), ("dim", "c", 0.15, 5), ("dim", "none", 0.05, 2), ("tier", "t1", 0.5, 10), ("tier", "t2", 0.5, 10)], TARGETS)
    sample, report = Q.draw(items(spark), targets, ["dim", "tier"], size=100)
    rows = sample.collect()
    assert len(rows) == 100 == len({r["qa_id"] for r in rows})
    by = {(r["field"], r["category"]): r for r in report.collect()}
    assert by["dim", "none"]["state"] == "absent" and by["tier", "t1"]["drawn"] == 50 and by["tier", "t2"]["state"] == "met"
    assert abs(by["dim", "a"]["drawn"] - 52) <= 3 and by["dim", "c"]["drawn"] >= 15
    for f in ("dim", "tier"):
        for c in {r[f] for r in rows}:
            assert by[f, c]["drawn"] == sum(r[f] == c for r in rows)


def test_small_categories_keep_their_least_number(spark):
    rows = [(f"q{i}", "a" if i else "b", "t") for i in range(200)]
    df = spark.createDataFrame(rows, "qa_id string, dim string, tier string")
    targets = spark.createDataFrame([("dim", "a", 0.99, 5), ("dim", "b", 0.01, 3), ("tier", "t", 1.0, 0)], TARGETS)
    by = {r["category"]: r for r in Q.draw(df, targets, ["dim", "tier"], size=20)[1].collect()}
    assert by["b"]["drawn"] == 1 and by["b"]["state"] == "exhausted" and by["a"]["drawn"] == 19


def test_empty_tables(spark):
    targets = spark.createDataFrame([("dim", "a", 1.0, 1), ("tier", "t1", 1.0, 1)], TARGETS)
    sample, report = Q.draw(items(spark).limit(0), targets, ["dim", "tier"])
    assert sample.count() == 0 and {r["state"] for r in report.collect()} == {"absent"}
    assert Q.draw(items(spark), targets.limit(0), ["dim", "tier"])[0].count() == 0


def test_quotas_stay_within_counts():
    r = np.random.default_rng(2)
    for _ in range(20):
        count = r.integers(0, 50, 12).astype(float)
        axes = [np.arange(12) // 4, np.arange(12) % 4]
        q = Q.quotas(count, axes, [np.full(3, 1 / 3), np.full(4, 0.25)], [np.full(3, 2.0), np.full(4, 2.0)], 60)
        assert (q >= 0).all() and (q <= count).all() and q.sum() <= max(60, 14) + 8


def docs(spark, sizes, n=60):
    return spark.createDataFrame([(k * 1000 + i, s, t) for k, (s, t) in enumerate(sizes.items()) for i in range(n)], "doc_id bigint, source string, tokens bigint")


def test_shares_caps_and_budget(spark):
    d = docs(spark, {"a": 100, "b": 100, "small": 5})
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 1), ("small", 0.1, 2), ("none", 0.1, 3)], "source string, target_share double, max_repeats int")
    m = M.mix(d, t, budget=8000).cache()
    rows = m.collect()
    assert 7900 <= sum(r["tokens"] for r in rows) <= 8000
    assert len({(r["doc_id"], r["copy"]) for r in rows}) == len(rows) and max(r["copy"] for r in rows if r["source"] == "small") == 2
    by = {r["source"]: r for r in M.shares(m, d, t).collect()}
    assert by["none"]["state"] == "absent" and by["small"]["state"] == "exhausted" and by["small"]["tokens"] == 600
    assert abs(by["a"]["tokens"] / by["b"]["tokens"] - 5 / 3) < 0.12


def test_order_is_a_fair_queue_against_brute_force(spark):
    d = docs(spark, {"a": 10, "b": 30}, 40)
    t = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    rows = sorted((r["finish"], r["source"], r["doc_id"], r["copy"], r["tokens"]) for r in M.mix(d, t, budget=900).collect())
    so_far = {"a": 0, "b": 0}
    for finish, source, _, _, tokens in rows:
        so_far[source] += tokens
        assert abs(finish - so_far[source] / 0.5) < 1e-6


def test_mix_of_nothing_and_buckets(spark, monkeypatch):
    t = spark.createDataFrame([("a", 0.5, 1), (None, 0.5, 1), ("b", None, 1)], "source string, target_share double, max_repeats int")
    assert M.mix(docs(spark, {"a": 1}).limit(0), t).count() == 0
    d = docs(spark, {"a": 7}, 200)
    whole = {r["doc_id"]: r["finish"] for r in M.mix(d, t).collect()}
    monkeypatch.setattr(M, "BUCKET_ROWS", 10)
    assert {r["doc_id"]: r["finish"] for r in M.mix(d, t).collect()} == whole and len(whole) == 200
