from datetime import datetime

import pytest

from trackloom.operators.delivery import keep_one, redelivered, winners

SCHEMA = "delivery_id bigint, delivered_at timestamp_ntz, qa_id string, model string, k0 string, copies int, raw_response string"


@pytest.fixture
def log(spark, tmp_path):
    def write(rows, files=3):
        path = str(tmp_path / "log")
        spark.createDataFrame(rows, SCHEMA).repartition(files).write.parquet(path)
        return spark.read.parquet(path)

    return write


def row(i, qa, model, day=1, text="x"):
    return (i, datetime(2026, 1, day), qa, model, "c", 7, text)


def test_one_row_of_each_message_and_clashing_columns(log):
    df = log([row(1, "q1", "m"), row(2, " Q1\t", "M"), row(3, "q1", "m2", 2), row(4, "q1", "m2", 1), row(5, "q2", "m"), row(6, "q1", "m", 1)])
    assert {tuple(r) for r in redelivered(df, ["qa_id", "model"], ["delivered_at", "delivery_id"]).collect()} == {("q1", "m"), ("q1", "m2")}
    kept = keep_one(df, ["qa_id", "model"], ["delivered_at", "delivery_id"])
    assert kept.columns == df.columns
    assert sorted(r["delivery_id"] for r in kept.collect()) == [1, 4, 5]


def test_nulls_in_the_key_stay_and_nulls_in_the_order_come_last(log):
    df = log([(1, None, "q", "m", None, None, None), row(2, "q", "m", 3), row(3, None, "m"), row(4, None, "m"), row(5, "q", None)])
    assert sorted(r["delivery_id"] for r in keep_one(df, ["qa_id", "model"], ["delivered_at"]).collect()) == [2, 3, 4, 5]
    assert redelivered(df, ["qa_id", "model"], ["delivered_at"]).count() == 1


def test_ties_keep_one_and_hot_keys(log):
    df = log([row(0, "hot", "m") for _ in range(500)] + [row(i, f"q{i}", "m", text="long " * 1000) for i in range(50)], files=5)
    assert keep_one(df, ["qa_id", "model"], ["delivered_at", "delivery_id"]).count() == 51
    assert winners(df, ["qa_id", "model"], ["delivered_at"]).agg({"copies": "max"}).first()[0] == 500


def test_empty_table(log):
    df = log([])
    assert keep_one(df, ["qa_id", "model"], ["delivered_at"]).count() == 0
    assert redelivered(df, ["qa_id", "model"], ["delivered_at"]).count() == 0
