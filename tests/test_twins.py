"""Folds and frame steps against plain Python, on odd rows too."""

from __future__ import annotations

import random

import pytest

from witnesslake.operators import attention, ordered, spatial
from witnesslake.streaming import stateful

CALLS = "camera_id string, t_ns long, ordinal long, failed boolean"


@pytest.fixture(scope="module")
def calls(spark):
    rnd = random.Random(4)
    rows = sorted({(rnd.choice("abc"), rnd.randint(0, 300)) for _ in range(250)})
    rows = [(c, t, i, rnd.random() < 0.5) for i, (c, t) in enumerate(rows)]
    shuffled = list(rows)
    rnd.shuffle(shuffled)
    return rows, spark.createDataFrame(shuffled, CALLS)


def test_sampler(calls):
    rows, df = calls
    want, last = [], {}
    for c, t, i, _ in rows:
        if c not in last or t - last[c] >= 10:
            last[c] = t
            want.append((c, t, i))
    assert sorted(map(tuple, stateful.sample_frames(df, 1e8).collect())) == want


def test_token_bucket(calls):
    rows, df = calls
    want, state = [], {}
    for c, t, i, _ in rows:
        tokens, since = state.get(c, (2.0, t))
        while t >= since + 25:
            tokens, since = min(2.0, tokens + 2), since + 25
        if tokens >= 1:
            tokens -= 1
            want.append((c, t, i))
        state[c] = tokens, since
    assert sorted(map(tuple, stateful.token_bucket(df, 2, 25).collect())) == want


def test_rate_limit(calls):
    rows, df = calls
    want, state = [], {}
    for c, t, i, _ in rows:
        held = state[c] = [x for x in state.get(c, []) if x > t - 30]
        want.append((c, t, i, len(held) < 4))
        if len(held) < 4:
            held.append(t)
    assert sorted(map(tuple, stateful.rate_limited(df, 4, 30).collect())) == want


def test_corrections_are_always_published(spark):
    rows = [("a", 0, 0, "x", False), ("a", 1, 1, "x", True), ("a", 2, 2, "x", None), ("a", 9, 3, "x", False), ("b", 0, 4, "x", True)]
    got = stateful.suppress(spark.createDataFrame(rows, "subject string, t_ns long, ordinal long, digest string, always boolean"), 7).collect()
    assert sorted(r.ordinal for r in got) == [0, 1, 3, 4]


def test_breaker(calls):
    rows, df = calls
    want, state = [], {}
    for c, t, i, failed in rows:
        row, until = state.get(c, (0, -1))
        if t < until:
            want.append((c, t, i, False))
            continue
        row = row + 1 if failed else 0
        state[c] = (0, t + 20) if row == 3 else (row, until)
        want.append((c, t, i, True))
    assert sorted(map(tuple, stateful.breaker(df, 3, 20).collect())) == want


def _iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    shared = max(w, 0) * max(h, 0)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - shared
    return shared / union if union > 0 else 0.0


def _boxes(rnd, n):
    out = []
    for _ in range(n):
        x, y = rnd.choice([0.0, 0.1, 0.2, 0.5]), rnd.choice([0.0, 0.1, 0.3])
        out.append((x, y, x + rnd.choice([0.0, 0.2, 0.4]), y + rnd.choice([0.2, 0.3])))
    return out


def test_overlap_suppression(spark):
    rnd = random.Random(5)
    rows = [(f"f{f}", i, rnd.choice("pv"), round(rnd.random(), 1), *b) for f in range(40) for i, b in enumerate(_boxes(rnd, rnd.randint(1, 9)))]
    want = []
    for f in {r[0] for r in rows}:
        kept = []
        for r in sorted((r for r in rows if r[0] == f), key=lambda r: (-r[3], r[1])):
            if not any(r[2] == k[2] and _iou(r[4:], k[4:]) >= 0.45 for k in kept):
                kept.append(r)
        want += [(f, k[1]) for k in kept]
    df = spark.createDataFrame(rows, "frame string, det_index long, class_id string, score double, x1 double, y1 double, x2 double, y2 double")
    assert sorted(map(tuple, spatial.suppress_overlaps(df).collect())) == sorted(want)
    assert spatial.suppress_overlaps(df.limit(0)).collect() == []


def test_greedy_match(spark):
    rnd = random.Random(6)
    schema = "frame string, subject string, x1 double, y1 double, x2 double, y2 double"
    side = lambda k: [(f"f{f}", f"{k}{i}", *b) for f in range(30) for i, b in enumerate(_boxes(rnd, rnd.randint(0, 6)))]
    truth, predicted = side("t"), side("p")
    want = []
    for f in {r[0] for r in truth}:
        free = sorted(r for r in predicted if r[0] == f)
        for t in sorted(r for r in truth if r[0] == f):
            best, most = None, 0.0
            for p in free:
                if (v := _iou(t[2:], p[2:])) > most:
                    best, most = p, v
            hit = best if best and most >= 0.5 else None
            if hit:
                free.remove(hit)
            want.append((f, t[1], hit and hit[1], round(most, 9)))
    got = spatial.greedy_match(spark.createDataFrame(truth, schema), spark.createDataFrame(predicted, schema)).collect()
    assert sorted(((r.frame, r.subject, r.matched, round(r.iou, 9)) for r in got), key=str) == sorted(want, key=str)


def test_smoothed_motion(spark):
    rnd = random.Random(7)
    rows = [(f"o{k}", i, i * 10**9 + rnd.randint(0, 10**8), rnd.random(), rnd.random()) for k in range(5) for i in range(rnd.randint(1, 12))]
    want = {}
    for k in {r[0] for r in rows}:
        points, v = sorted(r[2:] for r in rows if r[0] == k), None
        for a, b in zip(points, points[1:], strict=False):
            n = [(b[j] - a[j]) / ((b[0] - a[0]) / 1e9) for j in (1, 2)]
            v = n if v is None else [0.6 * x + 0.4 * y for x, y in zip(n, v, strict=True)]
        if v:
            want[k] = [round(x, 9) for x in v]
    got = attention.ema_motion(spark.createDataFrame(rows, "object_id string, depth long, t_ns long, x double, y double")).collect()
    assert {r.object_id: [round(r.vx, 9), round(r.vy, 9)] for r in got} == want


def test_order_within_large_groups(spark):
    """Spans of an hour and gaps of many: places, neighbours and carried values as one window gives them."""
    rnd = random.Random(8)
    hour = ordered.SPAN_NS
    rows = [(rnd.choice("ab"), rnd.choice([0, 1, 1, 2, 9, 40]) * hour + rnd.choice([0, 5, hour - 1]), i, rnd.choice([None, f"v{i}"])) for i in range(120)]
    df = spark.createDataFrame(rows, "g string, t_ns long, i long, v string")
    got = {r.i: r for r in ordered.neighbours(ordered.carried(ordered.numbered(df, "g", "i", "place"), ["g"], ["i"], "v"), "g", "i", "i").collect()}
    for g in "ab":
        mine, held = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])), None
        for k, r in enumerate(mine):
            held = r[3] or held
            x = got[r[2]]
            assert (x.place, x.found, x.previous, x.next) == (k + 1, held, mine[k - 1][2] if k else None, mine[k + 1][2] if k + 1 < len(mine) else None)


def test_tree_digest_has_many_levels(spark):
    import hashlib

    sha = lambda parts: hashlib.sha256("\n".join(parts).encode()).hexdigest()
    rows = [("a", i, f"d{i}") for i in range(30)] + [("b", 0, "x")]
    got = dict(map(tuple, ordered.tree_digest(spark.createDataFrame(rows, "g string, p long, d string"), "g", "p", "d", 3).collect()))
    for g in "ab":
        level = [d for k, _, d in rows if k == g]
        for _ in range(4):
            level = [sha(level[i : i + 3]) for i in range(0, len(level), 3)]
        assert got[g] == level[0]
