from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tests.conftest import track
from trackloom.functions import answers as A
from trackloom.functions.labels import label_parts
from trackloom.operators import events as E
from trackloom.operators.ranking import ordinal
from trackloom.operators.selection import greedy_cover, merge_fragments, probe_order

# fixed values: extraction cases
CASES = [
    ("A", "mcq_4", "A"), ("D.", "mcq_4", "D"), ("Answer: B", "mcq_4", "B"), ("**C**", "mcq_4", "C"), ("The answer is C.", "mcq_4", "C"), ("Based on the video, I think B is correct.", "mcq_4", "B"), ("E", "mcq_4", None), ("", "mcq_4", None),
    ("A", "sp", "A"), ("answer: B", "sp", "B"), ("D", "sp", None), ("3", "numerical", "3"), ("The answer is 4.", "numerical", "4"), ("5 or more", "numerical", "5 or more"), ("5+", "numerical", "5 or more"),
    ("It happens 7 times", "numerical", "5 or more"), ("twice", "numerical", None), ("", "numerical", None), ("1", "numerical", None), ("3 of 5", "numerical", "3"), ("99999999999999999999", "numerical", "5 or more"), ("B, A, C", "ordering_3", "B,A,C"), ("B,A,C", "ordering_3", "B,A,C"), ("D, B, A, C", "ordering_4", "D,B,A,C"),
    ("Order: A then B then C then D", "ordering_4", "A,B,C,D"), ("<think>reasoning with A B C D</think>\n\nB, A, C", "ordering_3", "B,A,C"), ("A, B", "ordering_3", None), ("CAB", "ordering_3", None), ("<think>A</think> B", "mcq_4", "B"), (None, "mcq_4", None), ("A", "other", None),
]


def test_extraction(spark):
    df = spark.createDataFrame([(i, t, f, w) for i, (t, f, w) in enumerate(CASES)], "i int, t string, f string, w string")
    bad = df.withColumn("got", A.extract(F.col("t"), F.col("f"))).where(~F.col("got").eqNullSafe(F.col("w"))).collect()
    assert bad == []


@pytest.mark.parametrize("label,base,mods,digit", [("the red cup #2", "cup", "red", True), ("cup on the left", "cup", "", False), ("man in black jacket", "jacket", "man in black", False), ("", "", "", False), (None, "", "", False)])
def test_labels(spark, label, base, mods, digit):
    got = spark.createDataFrame([(label,)], "l string").select(label_parts(F.col("l")).alias("p")).first()["p"]
    assert tuple(got) == (base, mods, digit)


def test_events_of_one_track(tracks):
    visible = [not 6 <= i <= 8 for i in range(12)]
    d = track("v", [(0, "cup", list(range(12)), [[40, 40, 60, 60] if v else [0, 0, 0, 0] for v in visible], visible)])
    d["objects"][0]["mask_areas"] = [0 if not v else 40 if i in (4, 5) else 100 for i, v in enumerate(visible)]
    got = [(r["event_id"], r["type"], r["frame"], r["start"], r["end"], r["temporal_position"]) for r in E.all_events(tracks([d])).orderBy("event_id").collect()]
    assert got == [(0, "partial_occlusion", None, 4, 5, "early"), (1, "full_occlusion", None, 6, 8, "late"), (2, "reappear", 9, None, None, "end")]


def test_events_of_empty_and_null_documents(tracks):
    assert E.all_events(tracks([])).count() == 0
    assert E.all_events(tracks([track("e", []), track(None, [(0, "cup", [0], [[1, 1, 2, 2]], [True])])])).count() == 0


def test_ordinal(spark):
    got = ordinal(spark.range(1000).withColumn("k", F.col("id") % 7), [F.col("k"), F.col("id")]).orderBy("ordinal").collect()
    assert [r["ordinal"] for r in got] == list(range(1000))
    assert [(r["k"], r["id"]) for r in got] == sorted((i % 7, i) for i in range(1000))
    assert ordinal(spark.range(0), [F.col("id")]).count() == 0


def test_cover_merge_and_probes(spark):
    import pandas as pd

    pool = pd.DataFrame({"video_id": list("abcd"), "score": [1, 2, 3, 4], "x": [1, 1, 0, 0], "y": [1, 0, 1, 0]})
    assert greedy_cover(pool, {"x": (1, 1.0), "y": (1, 1.0)}, 2) == ["a", "d"]
    assert greedy_cover(pool.iloc[:0], {"x": (1, 1.0)}, 2) == []
    pairs = spark.createDataFrame([("v", 0, 1, 0.0), ("v", 1, 2, 0.0), ("w", 3, 4, 5.0)], "video_id string, obj_a int, obj_b int, jump_px double")
    assert {tuple(r) for r in merge_fragments(pairs).collect()} == {("v", 0, 1), ("w", 3, 4)}
    assert probe_order(0) == [] and probe_order(1) == [0] and sorted(probe_order(16)) == list(range(16)) and probe_order(16)[0] == 7


def test_sources_and_stream(spark, tmp_path):
    from trackloom import schemas
    from trackloom.sources import documents as S
    from trackloom.streaming import predictions as P

    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.json").write_text('{"video_id": "a",\n "objects": []}')
    (tmp_path / "docs" / "_meta.json").write_text('{"video_id": "meta"}')
    (tmp_path / "docs" / "broken.json").write_text("{")
    assert [r["video_id"] for r in S.read_documents(spark, str(tmp_path / "docs")).collect()] == ["a"]
    (tmp_path / "p.jsonl").write_text('{"qa_id": "q", "model": "m", "extracted_answer": "A"}\n\nno json\n{"model": "m"}\n{"qa_id": "q", "model": "m", "extracted_answer": ["B", "A"]}\n')
    assert [r["extracted_answer"] for r in S.read_predictions(spark, str(tmp_path / "p.jsonl")).collect()] == [["B", "A"]]
    old, new = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int"), spark.createDataFrame([("b", 2), ("c", 2)], "k string, v int")
    assert sorted(map(tuple, S.upsert(old, new, ["k"]).collect())) == [("a", 1), ("b", 2), ("c", 2)]
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    (src / "1.json").write_text('{"qa_id": "q", "model": "m", "format": "sp"}\n')
    for _ in range(2):
        P.run_resumable(spark, str(src), schemas.PREDS, out, str(tmp_path / "cp"), ["qa_id", "model"])
        assert spark.read.parquet(out).count() == 1
    (src / "2.json").write_text('{"qa_id": "q", "model": "m", "format": "mcq_4"}\n')
    P.run_resumable(spark, str(src), schemas.PREDS, out, str(tmp_path / "cp"), ["qa_id", "model"])
    assert [r["format"] for r in spark.read.parquet(out).collect()] == ["mcq_4"]
    log = spark.createDataFrame([("q", "m", datetime(2026, 1, 1), None), ("Q ", "m", datetime(2026, 1, 1), "e")], "qa_id string, model string, delivered_at timestamp, error string")
    assert [(r["n"], r["errors"]) for r in P.rate_by_window(log).collect()] == [(2, 1)]
