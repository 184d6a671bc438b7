"""The frame ledger against a bounded ring in plain Python."""

from __future__ import annotations

import random
from collections import deque

import pytest

from tests.conftest import SF, rows_of
from witnesslake import catalog
from witnesslake.operators import ledger


@pytest.mark.parametrize("capacity", [1, 5, 100])
def test_entries_are_those_of_a_ring(spark, capacity):
    draw = random.Random(capacity)
    records = [(f"c{i % 2}", f"f{i}", i, 10 * i - draw.randint(-3, 9), 10 * i) for i in range(1, 60)]
    some = lambda x: x if draw.random() < 0.6 else None
    notes = [(n, f"f{draw.randint(1, 62)}", draw.randint(0, 700), some(1.5 * n), some(n % 4), some(n % 2), some([f"o{n}"]), some([]), some("bad")) for n in range(150)]
    rings, out = {c: deque(maxlen=capacity) for c in ("c0", "c1")}, {}
    for t, kind, _, x in sorted([(r[4], 0, r[2], r) for r in records] + [(n[2], 1, n[0], n) for n in notes], key=lambda e: e[:3]):
        if kind == 0:
            rings[x[0]].append(x[1])
            out[x[1]] = [x[0], False, False, 0.0, 0, 0, [], [], ""]
        elif any(x[1] in ring for ring in rings.values()):
            e = out[x[1]]
            e[1], e[2] = True, e[2] or x[4] is not None or x[5] is not None
            e[3:] = [old if new is None else new for old, new in zip(e[3:], x[3:], strict=True)]
        assert t is not None
    frame = spark.createDataFrame(records, "camera_id string, frame_ref string, sequence long, captured_at_ns long, received_at_ns long")
    said = spark.createDataFrame(random.Random(1).sample(notes, len(notes)), "note_id long, frame_ref string, at_ns long, processing_ms double, detection_count int, observation_count int, object_ids array<string>, evidence_refs array<string>, error string")
    got = {r.frame_ref: r for r in ledger.entries(frame, said, capacity).collect()}
    assert {k: [r.camera_id, r.processed, r.counts_reported, r.processing_ms, r.detection_count, r.observation_count, r.object_ids, r.evidence_refs, r.error] for k, r in got.items()} == out
    assert {k for k, r in got.items() if r.held} == {x for ring in rings.values() for x in ring}
    assert all(r.empty == ((r.observation_count == 0) if r.counts_reported else None) for r in got.values())
    assert ledger.entries(frame.limit(0), said).collect() == []


def test_matches_sql(spark, duck):
    got, want = catalog.QUERIES["frame_ledger"](spark, SF), duck.sql(catalog.ORACLES["frame_ledger"])
    cols = sorted(got.columns)
    assert rows_of(got, cols) == sorted(map(str, want.select(", ".join(cols)).fetchall()))
