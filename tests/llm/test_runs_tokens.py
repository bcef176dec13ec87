import os
import random

import pytest

from tests.conftest import track
from trackloom.llm.runs import collapse_runs
from trackloom.llm import tokens as T

HAS_FILES = os.path.isdir(T.FOLDER)


def brute(frames, boxes, visible):
    rows = sorted({f: (b, v) for f, b, v in reversed(list(zip(frames, boxes, visible)))}.items())
    out, start = [], 0
    for i in range(1, len(rows) + 1):
        (f0, (b0, v0)), cont = rows[i - 1], False
        if i < len(rows):
            f1, (b1, v1) = rows[i]
            cont = f1 == f0 + 1 and v0 == v1 and v0 is not None and b0 is not None and b1 is not None and len(b0) == len(b1) == 4 and all(abs(p - q) <= 2 for p, q in zip(b0, b1))
        if not cont:
            out.append((rows[start][0], rows[i - 1][0], i - start))
            start = i
    return out


def test_against_brute_force(tracks):
    r = random.Random(4)
    docs, want = [], set()
    for k in range(20):
        n = r.randint(0, 40)
        frames = r.sample(range(60), n) + ([5, 5] if k % 5 == 0 and n else [])
        boxes = [r.choice([[10, 10, 20, 20], [11, 12, 20, 19], [13, 10, 20, 20], [0, 0, 0, 0], None, [1, 2]]) for _ in frames]
        visible = [r.choice([True, True, False, None]) for _ in frames]
        docs.append(track(f"v{k}", [(3, "cup", frames, boxes, visible)], n=60))
        want |= {(f"v{k}", 3, *x) for x in brute(frames, boxes, visible)}
    got = {(x["video_id"], x["obj_id"], x["start_frame"], x["end_frame"], x["n_frames"]) for x in collapse_runs(tracks(docs)).collect()}
    assert got == want


def test_copies_durations_and_empty(tracks):
    d = track("v", [(0, "cup", [2, 1, 0], [[0, 0, 5, 5]] * 3, [True] * 3), (1, "x", [], [], [])])
    got = collapse_runs(tracks([d, d | {"processing_time": 9.0}])).collect()
    assert len(got) == 1 and got[0]["n_frames"] == 3 and abs(got[0]["duration_s"] - 2 / 3) < 1e-9 and got[0]["visible"] is True
    assert collapse_runs(tracks([])).count() == 0 and collapse_runs(tracks([track("e", [])])).count() == 0


@pytest.mark.skipif(not HAS_FILES, reason="no vocabulary files")
def test_every_cut_is_exact():
    own = T.tokenizer("byte_bpe_50k")
    r = random.Random(1)
    letters = list("ab xqZ'sstrevlmd  \t\n\r  .,!?0129éß日本🙂́-_ 　") + ["<|endoftext|>", "'ll", "  "]
    for _ in range(3000):
        text = "".join(r.choice(letters) for _ in range(r.randint(1, 50)))
        assert own.encode(text) == own.encoding.encode_ordinary(text), text


@pytest.mark.skipif(not HAS_FILES, reason="no vocabulary files")
def test_ids_of_a_table(spark):
    long = "word " * 50_000 + "q" * 30_000
    df = spark.createDataFrame([(1, "hello <|endoftext|>", 5), (2, "", 5), (3, None, 5), (4, long, 5), (4, long, 5)], "doc_id bigint, text string, ids int")
    got = sorted((r["doc_id"], len(r["ids"])) for r in T.encode_corpus(df).collect())
    enc = T.tokenizer("byte_bpe_50k").encoding
    assert got == sorted([(1, len(enc.encode_ordinary("hello <|endoftext|>"))), (2, 0), (3, 0), (4, n := len(enc.encode_ordinary(long))), (4, n)])
    ids = T.encode_corpus(df.where("doc_id = 1")).first()["ids"]
    assert enc.decode(ids) == "hello <|endoftext|>" and 50256 not in ids
    assert T.encode_corpus(df.limit(0)).count() == 0
