"""Hand-computed cases of track repair, answer repair, layers, strict extraction and sources."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import track
from trackloom.functions import strict as S
from trackloom.operators import answers as O
from trackloom.operators import frames as R
from trackloom.operators import layers as L
from trackloom.operators import selection
from trackloom.plans import events as P

PAIRS = "video_id string, obj_a int, obj_b int, jump_px double"


def test_a_track_may_absorb_several_but_an_absorbed_one_nothing(spark):
    pairs = spark.createDataFrame([("v", 0, 1, 0.0), ("v", 0, 2, 1.0), ("v", 1, 3, 2.0), ("v", 4, 0, 3.0), ("w", 5, 5, 0.0)], PAIRS)
    got = {tuple(r) for r in selection.merge_fragments(pairs.where("video_id = 'v'")).collect()}
    assert got == {("v", 0, 1), ("v", 0, 2), ("v", 4, 0)}
    assert selection.merge_fragments(pairs.limit(0)).count() == 0


def test_fragments_are_filled_in_their_keeper(spark, tracks):
    box, n = [40, 40, 60, 60], list(range(12))
    shown = lambda span: [i in span for i in n]
    boxes = lambda span: [box if i in span else [0, 0, 0, 0] for i in n]
    a, b, c = range(0, 5), range(7, 12), range(5, 6)
    doc = track("v", [(0, "cup", n, boxes(a), shown(a)), (1, "cup", n, boxes(b), shown(b)), (2, "lamp", n, boxes(c), shown(c))])
    f = R.frames(R.documents(tracks([doc])))
    pairs = P._mergeable(f)
    assert [(r["obj_a"], r["obj_b"], r["gap"], r["jump_px"]) for r in pairs.collect()] == [(0, 1, 3, 0.0)]
    merged = selection.merged_frames(f, selection.merge_steps(pairs))
    assert sorted(r["frame"] for r in merged.where("obj_id = 0 and visible").collect()) == [*a, *b]
    assert {(r["obj_id"], r["merges"]) for r in merged.select("obj_id", "merges").distinct().collect()} == {(0, 1), (2, 0)}
    rated = {r["obj_id"]: r for r in P._confidence(merged, F.col("merges")).collect()}
    assert rated[0]["confidence"] == pytest.approx(0.9 * 0.85) and rated[2]["confidence"] == pytest.approx(0.9 * 0.8)


def test_swaps_and_merges_lower_confidence(tracks):
    n = list(range(10))
    far = [[0, 0, 10, 10] if i < 5 else [80, 80, 90, 90] for i in n]
    f = R.frames(R.documents(tracks([track("v", [(0, "cup", n, far, [True] * 10)])])))
    assert P._confidence(f, F.lit(2)).first()["confidence"] == pytest.approx(0.9 * 0.7 * 0.75)


def options(spark, answers):
    rows = [(f"q{i:02d}", x, *(f"{x if k == x else 'wrong ' + k} {i}" for k in "ABCD")) for i, x in enumerate(answers)]
    return spark.createDataFrame(rows, "qa_id string, correct_answer string, option_a string, option_b string, option_c string, option_d string")


@pytest.mark.parametrize("answers, counts, moves", [("AAAAABCD", {"A": 2, "B": 2, "C": 2, "D": 2}, 3), ("AAAAAABC", {"A": 4, "B": 2, "C": 2}, 2)])
def test_right_letters_are_spread(spark, answers, counts, moves):
    r = O.rebalance_options(options(spark, answers), F.md5("qa_id")).collect()
    assert sum(x["moved"] for x in r) == moves and {k: sum(x["correct_answer"] == k for x in r) for k in counts} == counts and len(r) == len(answers)
    # the text that was right still is, and no text is lost
    for x in r:
        i = int(x["qa_id"][1:])
        assert x[f"option_{x['correct_answer'].lower()}"] == f"{answers[i]} {i}" and len({x[f"option_{k}"] for k in "abcd"}) == 4


def one_by_one(counts):
    now, fair = dict(counts), sum(counts.values()) / 4
    while True:
        high, low = [x for x in now if now[x] - fair > 0.5], [x for x in now if fair - now[x] > 0.5]
        if not high or not low:
            return now
        now[max(high, key=lambda x: (now[x], -ord(x)))] -= 1
        now[max(low, key=lambda x: (fair - now[x], -ord(x)))] += 1


def test_letter_plan_ends_where_single_moves_end():
    import random

    r = random.Random(4)
    for _ in range(200):
        counts = {x: r.randint(0, 90) for x in "ABCD" if r.random() < 0.9}
        counts = {k: v for k, v in counts.items() if v}
        now = dict(counts)
        for a, b, k in O.letter_plan(counts):
            now[a] -= k
            now[b] += k
        assert sorted(now.values()) == sorted(one_by_one(counts).values()) and all(v >= 0 for v in now.values())


def test_pairs_change_places(spark):
    rows = [(f"q{i}", "A" if i < 7 else "B", f"right {i}" if i < 7 else "w", "w" if i < 7 else f"right {i}", None, None) for i in range(10)] + [("none", "A", None, None, None, None)]
    df = spark.createDataFrame(rows, "qa_id string, correct_answer string, statement_a string, statement_b string, option_a string, option_b string")
    r = O.rebalance_pairs(df, F.md5("qa_id")).collect()
    assert len(r) == 11 and sum(x["flipped"] for x in r) in (1, 2)  # an item without texts uses up its place
    for x in r:
        if x["qa_id"] != "none":
            assert x["statement_a" if x["correct_answer"] == "A" else "statement_b"].startswith("right")
    even = O.rebalance_identity(df.where("qa_id <> 'none'"), F.md5("qa_id")).collect()
    assert sum(x["correct_answer"] == "A" for x in even) == 5
    assert O.rebalance_pairs(df.limit(0), F.md5("qa_id")).count() == 0


def test_smallest_against_a_window(spark):
    df = spark.range(3000).select((F.col("id") % 3).cast("string").alias("g0"), F.col("id").cast("string").alias("qa_id"))
    quota = spark.createDataFrame([("0", 10), ("1", 2000), ("2", 0)], "g string, quota int")
    got = O.smallest(df, ["g0"], F.md5("qa_id"), quota, ["g"]).where("place is not null").collect()
    want = {}
    for r in df.select("g0", "qa_id", F.md5("qa_id").alias("h")).collect():
        want.setdefault(r["g0"], []).append((r["h"], r["qa_id"]))
    assert {(r["g0"], r["qa_id"], r["place"]) for r in got} == {(g, q, i + 1) for g, n in (("0", 10), ("1", 2000)) for i, (_, q) in enumerate(sorted(want[g])[:n])}


def test_layers_stop_early(spark):
    def trials(rows):
        return spark.createDataFrame([(q, "d", f, i, c == "T") for q, f, s in rows for i, c in enumerate(s)], "qa_id string, dim string, format string, trial int, correct boolean")

    text = L.run(trials([("a", "sp", "TTF"), ("b", "sp", "TTT"), ("c", "mcq_4", "T"), ("d", "mcq_4", "FT")]), L.TEXT_ONLY)
    assert {r["qa_id"]: (r["used"], r["held"]) for r in text.collect()} == {"a": (3, False), "b": (3, True), "c": (1, True), "d": (1, False)}
    probes = L.run(trials([("hit", "mcq_4", "TTTTTTTT"), ("miss", "mcq_4", "FFFFFFFF"), ("sp", "sp", "TTTTFFFT"), ("order", "ordering_4", "FTFFFF")]), L.SINGLE_FRAME)
    assert {r["qa_id"]: (r["used"], r["held"]) for r in probes.collect()} == {"hit": (3, True), "miss": (6, False), "sp": (8, True), "order": (6, False)}
    items = spark.createDataFrame([("x", "d"), ("y", "reappear_identity"), ("z", None)], "qa_id string, dim string")
    yes, no = (trials([(q, "mcq_4", c) for q in "xyz"]) for c in "TF")
    r = {(x["qa_id"], x["layer"]): x["passed"] for x in L.layer_results(items, yes, no, yes, no).collect()}
    assert r == {("x", "text_only"): False, ("z", "text_only"): False, ("x", "single_frame"): True, ("z", "single_frame"): True, ("x", "shuffled"): True, ("z", "shuffled"): True}


@pytest.mark.parametrize("text, fmt, want", [
    ("CAB", "ordering_3", "C,A,B"), ("3 of 5", "numerical", "5 or more"), ("3 or more", "numerical", "5 or more"), ("cannot determine", "mcq_4", None), ("D", "sp", None), ("1", "numerical", None), ("A dog is first", "mcq_4", "A"),
    ("Answer: b", "sp", "B"), ("", "mcq_4", None), (None, "sp", None), ("000", "numerical", None), ("12345678901234567890123", "numerical", "5 or more"), ("I choose (C).", "mcq_4", "C"), ("AB", "ordering_3", None),
])
def test_strict_answers(spark, text, fmt, want):
    df = spark.createDataFrame([(text, fmt, None)], "t string, f string, o array<string>")
    assert df.select(S.extract_strict(F.col("t"), F.col("f"), F.col("o")).alias("a")).first()["a"] == want


def test_fallback_and_replies(spark):
    choices = [F.lit("the red cup"), F.lit("the blue lamp"), F.lit(None).cast("string"), F.lit(None).cast("string")]
    df = spark.createDataFrame([("It must be the blue lamp there", "mcq_4"), ("the", "sp"), ("it came back twice", "numerical"), ("seven", "numerical"), (None, "sp")], "t string, f string")
    assert [r["a"] for r in df.select(S.fallback(F.col("t"), F.col("f"), choices).alias("a")).collect()] == ["B", None, "2", "5 or more", None]
    one = lambda c, t: spark.createDataFrame([(t,)], "t string").select(c(F.col("t")).alias("a")).first()["a"]
    assert one(S.without_thinking, "<think>a</think> B <think>cut") == "B" and one(S.without_thinking, "<think>cut") == "" and one(S.without_thinking, None) is None
    assert one(S.object_list, 'Here: ["Cup", "cup ", "red lamp"]') == ["cup", "red lamp"] and one(S.object_list, "1. Dog\n2. the wall\n3. cat") == ["dog", "cat"]
    assert one(S.without_the, "The cup") == "cup" and one(S.without_the, "theatre") == "theatre"


def test_registry_paths_and_layers(spark, tmp_path):
    from trackloom import schemas
    from trackloom.sources import documents as D

    (tmp_path / "list.json").write_text('[{"video_id": "s_a", "source": "s", "path": "/x/a.mp4", "format": "video_file"}]')
    (tmp_path / "map.json").write_text('{"s_b": {"source": "s", "path": "rel/b.mp4", "format": "video_file"}}')
    reg = D.read_registry(spark, str(tmp_path / "list.json")).unionByName(D.read_registry(spark, str(tmp_path / "map.json")))
    assert {r["video_id"]: r["path"] for r in reg.collect()} == {"s_a": "/x/a.mp4", "s_b": "rel/b.mp4"}
    files = spark.createDataFrame([("/r/rel/b.mp4",), ("/r/s/c_d.webm",), ("/r/s_e.mov",), ("/r/s/f",)], "path string")
    videos = spark.createDataFrame([(v,) for v in ("s_a", "s_b", "s_c_d", "s_e", "s_f", "s_g")], "video_id string")
    got = {r["video_id"]: r["found"] for r in D.resolve_paths(videos, files, reg, "/r").collect()}
    assert got == {"s_a": None, "s_b": "/r/rel/b.mp4", "s_c_d": "/r/s/c_d.webm", "s_e": "/r/s_e.mov", "s_f": "/r/s/f", "s_g": None}
    (tmp_path / "layer1_0.json").write_text('{"items": [{"qa_id": "q1", "layer1_result": {"passed": false}}, {"qa_id": "q2"}]}')
    (tmp_path / "layer1_1.json").write_text('{"items": [{"qa_id": "q1", "layer1_result": {"passed": true}}, {"qa_id": "q3", "layer1_result": "odd"}]}')
    (tmp_path / "layer1_2.json").write_text("{broken")
    layer = D.read_layer_results(spark, str(tmp_path / "layer1_*.json"), "layer1")
    assert {r["qa_id"]: r["passed"] for r in layer.collect()} == {"q1": True, "q3": True}
    items = spark.createDataFrame([("q3", 0), ("q2", 1), ("q1", 2)], "qa_id string, ordinal int")
    assert [(r["qa_id"], r["missing"]) for r in D.in_item_order(items, layer).collect()] == [("q3", False), ("q2", True), ("q1", False)]
    (tmp_path / "items").mkdir()
    (tmp_path / "items" / "v.json").write_text('{"qa_items": [{"qa_id": "q1"}]}')
    assert [r["qa_id"] for r in D.read_items(spark, str(tmp_path / "items"), "qa_id: string").collect()] == ["q1"]
    (tmp_path / "items" / "_all.json").write_text('[{"qa_id": "q8"}]')
    D.write_ids(videos, str(tmp_path / "ids"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "ids")).collect()][0] == "s_a"
    assert D.link_script(reg).count() == 2 and D.without_counts(reg.withColumn("x_counts", F.lit(1))).columns == reg.columns
    assert schemas.REGISTRY.startswith("video_id")


def test_copies_of_documents_in_files(spark, tracks, tmp_path):
    docs = [track("v", [(0, "cup", [0], [[1, 1, 2, 2]], [True])]), track("v", [(0, "cup", [0], [[1, 1, 2, 2]], [True])]) | {"processing_time": 9.0}, track("w", []), track(None, [])]
    tracks(docs).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert sorted(r["video_id"] for r in R.documents(df).collect()) == ["v", "w"] and R.documents(df).columns == df.columns
    assert R.documents(df.limit(0)).count() == 0


def test_shared_folder_is_asked_for_off_local_masters():
    from unittest.mock import MagicMock

    from trackloom.session import shared_dir

    spark = MagicMock()
    spark.conf.get.return_value = None
    spark.sparkContext.getConf().get.return_value = None
    spark.sparkContext.master = "spark://host:7077"
    with pytest.raises(ValueError):
        shared_dir(spark)
