"""The tracker's steps on scripted frames, its assignments against brute force, lifecycles and folds over batches."""

from __future__ import annotations

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from witnesslake.streaming import tracker

SECOND = 10**9


def box(x, y=0.5, w=0.1, h=0.2):
    return (x, y, x + w, y + h)


def test_assignments_against_brute_force():
    rnd = random.Random(3)
    for _ in range(150):
        n, m = rnd.randint(1, 5), rnd.randint(1, 5)
        cost = np.array([[rnd.choice([np.inf, rnd.random()]) for _ in range(m)] for _ in range(n)])
        best = max(((sum(1 for i, j in p if np.isfinite(cost[i, j])), -sum(cost[i, j] for i, j in p if np.isfinite(cost[i, j]))) for p in ([*zip(rows, cols, strict=True)] for k in [min(n, m)] for rows in itertools.permutations(range(n), k) for cols in itertools.combinations(range(m), k))))
        got = tracker.optimal(cost)
        assert len({i for i, _ in got}) == len({j for _, j in got}) == len(got)
        assert (len(got), round(-sum(cost[i, j] for i, j in got), 9)) == (best[0], round(best[1], 9))
        left, want = cost.copy(), []
        while np.isfinite(left).any():
            i, j = np.unravel_index(left.argmin(), left.shape)
            want.append((int(i), int(j)))
            left[i], left[:, j] = np.inf, np.inf
        assert tracker.greedy(cost) == want


def test_a_moving_object_keeps_its_track_and_recovers():
    t = tracker.Tracker()
    ids = [t.step(k * SECOND // 5, [box(0.1 + 0.02 * k)])[0][0] for k in range(6)]
    assert {i for i, *_ in ids} == {1}
    assert [s for _, s, _ in ids] == ["tentative", "tentative", "confirmed", "confirmed", "confirmed", "confirmed"]
    for k in range(6, 9):
        assert t.step(k * SECOND // 5, []) == ([], [])
    assert t.tracks[0].state == "coasting"
    assert t.step(9 * SECOND // 5, [box(0.1 + 0.02 * 9)])[0][0][:2] == (1, "confirmed")


def test_tracks_end():
    t = tracker.Tracker()
    t.step(0, [box(0.1)])
    assert t.step(1, []) == ([], [(1, "missed")])  # a tentative one at once
    for k in range(2, 6):
        t.step(k, [box(0.1)])
    ended = [t.step(k, [])[1] for k in range(6, 6 + tracker.MOST_COAST + tracker.MOST_LOST + 1)]
    assert [e for e in ended if e] == [[(2, "lost_window")]]
    for k in range(100, 104):
        t.step(k * SECOND, [box(0.1)])
    assert t.step(104 * SECOND + tracker.MOST_UNMEASURED_NS, [])[1] == [(3, "unmeasured")]


def test_frames_out_of_order_and_ambiguous_matches_are_refused():
    t = tracker.Tracker()
    for k in range(4):
        t.step(k * SECOND, [box(0.1)])
    assert t.step(2 * SECOND, [box(0.1)]) is None
    found, _ = t.step(4 * SECOND, [box(0.09), box(0.11)])
    assert [i for i, *_ in found] == [2, 3]
    assert t.tracks[0].state == "coasting"


def test_the_table_is_bounded():
    t = tracker.Tracker()
    grid = [box(0.01 * (i % 100), 0.01 * (i // 100), 0.001, 0.001) for i in range(tracker.MOST_TRACKS)]
    t.step(0, grid)
    _, ended = t.step(1, [*grid, box(0.5, 0.9, 0.001, 0.001)])
    assert len(t.tracks) == tracker.MOST_TRACKS
    assert ended == [(1, "evicted")]


def test_folds_over_batches_equal_plain_steps(spark):
    rnd = random.Random(9)
    rows = [(cam, k * SECOND, k * 10 + i, *box(min(0.9, 0.1 * i + 0.01 * k + rnd.random() * 0.01), 0.1 * i)) for cam in ("a", "b", "c") for k in range(30) for i in range(4) if rnd.random() > 0.2]
    want = []
    for cam in "abc":
        t = tracker.Tracker("optimal")
        for k in sorted({r[1] for r in rows if r[0] == cam}):
            frame = sorted(r for r in rows if r[0] == cam and r[1] == k)
            out, ended = t.step(k, [r[3:] for r in frame])
            want += [(cam, k, r[2], *x) for r, x in zip(frame, out, strict=True)] + [(cam, k, None, i, why, None) for i, why in ended]
    rnd.shuffle(rows)
    df = spark.createDataFrame([*rows, (None, 1, 1, *box(0.1)), ("a", None, 1, *box(0.1))], "camera_id string, t_ns long, det_index long, x1 double, y1 double, x2 double, y2 double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = tracker.track(df, "optimal").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert tracker.track(df.limit(0)).collect() == []


def test_lifecycles(spark):
    s = SECOND
    rows = [(1, None, "provisional"), (9, None, "provisional"), (2, 100 * s, "provisional"), (2, 97 * s, "expired"), (3, 100 * s, "active"), (3, 99 * s, "occluded"), (3, 90 * s, "dormant"), (3, -20 * s, "departed"), (3, -500 * s, "expired")]
    df = spark.createDataFrame(rows, "n int, last long, want string")
    assert [r.got for r in df.select(tracker.lifecycle_at(100 * s, F.col("n"), F.col("last")).alias("got")).collect()] == [r[2] for r in rows]
