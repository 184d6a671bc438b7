"""Erasure over graphs with cycles, servability and decision frames against plain Python and SQL."""

from __future__ import annotations

import random

import pytest

from tests.conftest import SF, rows_of
from witnesslake import catalog
from witnesslake.operators import evidence


@pytest.mark.parametrize("seed", [1, 2])
def test_erasure_takes_what_derives(spark, seed):
    draw = random.Random(seed)
    edges = [(draw.randint(0, 39), draw.randint(0, 39)) for _ in range(45)] + [(1, 2), (2, 3), (3, 1), (5, 5), (None, 7), (8, None)]
    records = [(i, i % 3 if i != 9 else None, f"h{draw.randint(0, 12)}", draw.randint(1, 9)) for i in range(40)] + [(50, 0, None, 1)]
    gone = new = {1, 5, 50}
    while new:
        new = {b for a, b in edges if a in new and b is not None} - gone
        gone = gone | new
    held = {(t, h) for i, t, h, _ in records if i not in gone and h is not None}
    want = {i: "kept" if i not in gone else "record_erased" if (t, h) in held else "erased" for i, t, h, _ in records}
    frame = spark.createDataFrame(records, "evidence_id long, tenant_id long, content_hash string, size_bytes long")
    roots = spark.createDataFrame([(1,), (5,), (50,), (None,), (99,)], "id long")
    got = evidence.erase(frame, spark.createDataFrame(edges, "source long, id long"), roots)
    assert {r.evidence_id: r.fate for r in got.collect()} == want and {2, 3} <= gone
    sizes = {}
    for i, t, h, n in records:
        if want[i] == "erased":
            sizes[t, h] = max(n, sizes.get((t, h), 0))
    assert {(r.tenant_id, r.erased, r.bytes) for r in evidence.reclaimed(got).collect()} == {(t, sum(want[i] != "kept" for i, x, *_ in records if x == t), sum(n for (x, _), n in sizes.items() if x == t)) for t in {x for i, x, *_ in records if want[i] != "kept"}}
    assert evidence.reached(spark.createDataFrame([], "source long, id long"), roots.limit(0)).collect() == []


def test_decision_frames_are_never_later(spark):
    draw = random.Random(6)
    frames = [(f"c{draw.randint(0, 1)}", f"o{draw.randint(0, 2)}", f"f{i:03d}", draw.randint(0, 100)) for i in range(120)]
    made = [(i, f"c{draw.randint(0, 1)}", f"o{draw.randint(0, 3)}", draw.randint(0, 110)) for i in range(60)]
    got = evidence.decision_frames(spark.createDataFrame(made, "decision_id int, camera_id string, object_id string, at_ns long"), spark.createDataFrame(frames, "camera_id string, object_id string, frame_ref string, t_ns long"), 7).collect()
    want = {}
    for i, c, o, at in made:
        found = [(t, f) for c2, o2, f, t in frames if (c2, o2) == (c, o) and at - 7 <= t <= at]
        want[i] = (*max(found)[::-1], "decision-frame") if found else (None, None, "context-frame")
    assert {r.decision_id: (r.frame_ref, r.captured_ns, r.kind) for r in got} == want
    assert {w[2] for w in want.values()} == {"decision-frame", "context-frame"}


@pytest.mark.parametrize("name", ["evidence_erased", "evidence_reclaimed", "evidence_servability", "decision_frame"])
def test_matches_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF), duck.sql(catalog.ORACLES[name])
    cols = sorted(got.columns)
    assert rows_of(got, cols) == sorted(map(str, want.select(", ".join(cols)).fetchall()))
