import math
import random

import numpy as np

from tests.conftest import track
from trackloom.operators.spikes import flag_readings, longest_rest, rates


def walk(seed, n=60, step=8):
    """A box that moves at constant speed back and forth inside the picture."""
    r = random.Random(seed)
    x, y, dx, dy, out = r.randint(100, 300), r.randint(100, 300), step, 3, []
    for _ in range(n):
        x, y = x + dx, y + dy
        if not 20 < x < 560:
            dx = -dx
        if not 20 < y < 420:
            dy = -dy
        out.append([x, y, x + 40, y + 40])
    return out


def docs():
    clean = [track(f"v{k}", [(o, "cup", list(range(60)), walk(10 * k + o), [True] * 60) for o in range(3)], width=640, height=480) for k in range(6)]
    bad = walk(999)
    bad[10] = [600, 10, 610, 20]  # spike of one frame
    bad[20] = [20, 440, 60, 470]
    bad[21] = [25, 440, 65, 470]  # spike of two
    bad[30] = [50, 50, 40, 90]  # no extent
    bad[31] = [-5, 50, 40, 90]
    for i in range(40, 58):
        bad[i] = bad[40]  # stuck
    return clean + [track("bad", [(0, "cup", list(range(60)), bad, [True] * 60)], width=640, height=480)]


def test_planted_readings_are_found_and_nothing_else(tracks):
    # a few rests of two frames make the usual rest known
    made = docs()
    for d in made[:6]:
        for o in d["objects"]:
            o["bboxes"][5] = o["bboxes"][4]
    got = {tuple(r) for r in flag_readings(tracks(made)).collect()}
    assert {g for g in got if g[0] != "bad"} == set()
    assert got == {("bad", 0, 10, "spike"), ("bad", 0, 20, "spike"), ("bad", 0, 21, "spike"), ("bad", 0, 30, "impossible"), ("bad", 0, 31, "impossible"), ("bad", 0, 40, "stuck")}


def test_order_of_frames_copies_and_a_lasting_move(tracks):
    b = walk(1)
    moved = b[:30] + [[x1 + 150 if x1 < 300 else x1 - 150, y1, x2 + 150 if x1 < 300 else x2 - 150, y2] for x1, y1, x2, y2 in b[30:]]
    order = list(range(60))
    random.Random(3).shuffle(order)
    made = [track(f"c{k}", [(0, "cup", list(range(60)), walk(50 + k), [True] * 60)], width=640, height=480) for k in range(5)]
    one = track("m", [(0, "cup", order, [moved[i] for i in order], [True] * 60)], width=640, height=480)
    got = flag_readings(tracks([*made, one, one | {"processing_time": 2.0}])).where("video_id = 'm' and reason = 'spike'").collect()
    assert got == []


def test_hidden_null_and_malformed_readings(tracks):
    d = track("n", [(0, "cup", [0, 1, 2, 3, 4], [[1, 1, 9, 9], [0, 0, 0, 0], None, [1, 2], [5, 5, 3, 9]], [True, False, None, True, True]), (1, "x", [], [], [])])
    d["metadata"]["width"] = None
    d["source"] = None
    assert [tuple(r) for r in flag_readings(tracks([d])).collect()] == [("n", 0, 4, "impossible")]
    assert rates(tracks([d])).count() == 1


def test_empty_table_and_documents_without_objects(tracks):
    assert flag_readings(tracks([])).count() == 0
    assert flag_readings(tracks([track("e", [])])).count() == 0


def test_limit_of_rests():
    assert math.isinf(longest_rest(np.array([]), np.array([])))
    limit = longest_rest(np.array([2, 3, 4, 5, 30, 40]), np.array([500, 200, 100, 50, 3, 2]))
    assert 5 < limit < 30
