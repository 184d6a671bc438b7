"""Edge rows on small fixtures: unknown is neither true nor false, ties, empty tables, streaming against batch."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from witnesslake.functions import geometry, text
from witnesslake.operators import evaluation, incidents, log, rules, spatial, state
from witnesslake.streaming import stateful

ATTRS = "object_id string, attr_key string, attr_value string, observed_at_ns long, valid_until_ns long"
RULE = rules.Rule("r", "high", ("person",), (rules.Condition("g", "eq", "on", guard=True), rules.Condition("a", "eq", "worn", ("hidden",)), rules.Condition("b", "in", ("2", "3"))))


def _state(spark, held):
    objects = spark.createDataFrame([("o", "cam", "person.child"), ("v", "cam", "vehicle"), ("n", "cam", None)], "object_id string, camera_id string, class_id string")
    rows = [("o", k, v, 5, until) for k, v, until in held]
    judged = rules.outcomes(objects, spark.createDataFrame(rows, ATTRS), [RULE], 10)
    return {r.object_id: r.state for r in rules.findings(judged).collect()}


@pytest.mark.parametrize(
    ("held", "want"),
    [
        ([("g", "on", None), ("a", "worn", None), ("b", "2", None)], "COMPLIANT"),
        ([("g", "off", None), ("a", "none", None)], "NOT_APPLICABLE"),
        ([("a", "none", None), ("b", "1", None)], "UNKNOWN"),
        ([("g", "on", None), ("a", "none", None)], "VIOLATION"),
        ([("g", "on", None), ("a", "hidden", None), ("b", "3", None)], "UNKNOWN"),
        ([("g", "on", None), ("a", "worn", 9), ("b", "3", None)], "UNKNOWN"),
        ([("g", "on", None), ("a", "worn", 10), ("b", "three", None)], "VIOLATION"),
        ([("g", "on", None), ("a", None, None), ("b", "2", None)], "UNKNOWN"),
    ],
)
def test_rule_states(spark, held, want):
    assert _state(spark, held) == {"o": want}


def test_polygons(spark):
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    dented = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.5, 0.2), (0.0, 1.0)]
    points = spark.createDataFrame([(0.5, 0.5, square), (1.0, 0.5, square), (0.0, 0.0, square), (0.5, 0.5, dented), (0.1, 0.1, dented), (0.1, 0.1, dented[:2])], "x double, y double, v array<struct<x:double,y:double>>")
    assert [r.i for r in points.select(geometry.in_polygon(F.col("x"), F.col("y"), F.col("v")).alias("i")).collect()] == [True, False, True, False, True, False]


def test_iou_of_apart_and_degenerate(spark):
    rows = [(0.0, 0.0, 1.0, 1.0, 2.0, 2.0, 3.0, 3.0), (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), (0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 1.0, 0.5)]
    df = spark.createDataFrame(rows, ", ".join(f"{b}{c} double" for b in "ab" for c in ("x1", "y1", "x2", "y2")))
    assert [r.i for r in df.select(geometry.iou("a", "b").alias("i")).collect()] == [0.0, 0.0, 0.5]


def test_merged_intervals(spark):
    spans = spark.createDataFrame([("c", 0, 5), ("c", 3, 8), ("c", 8, 9), ("c", 11, 12), ("d", 1, 2)], "camera_id string, since_ns long, until_ns long")
    assert sorted(map(tuple, state.merged_intervals(spans, "camera_id").collect())) == [("c", 0, 9), ("c", 11, 12), ("d", 1, 2)]


def test_as_of_tolerance_is_inclusive(spark):
    left = spark.createDataFrame([("c", 10, "l1"), ("c", 41, "l2"), ("d", 5, "l3")], "camera_id string, t_ns long, ref string")
    right = spark.createDataFrame([("c", 10, "r1"), ("c", 5, "r0")], "camera_id string, t_ns long, ref string")
    got = {r.ref: r.found_ref for r in spatial.as_of(left, right, ["camera_id"], 31).collect()}
    assert got == {"l1": "r1", "l2": "r1", "l3": None}
    assert {r.ref: r.found_ref for r in spatial.as_of(left, right, ["camera_id"], 30).collect()}["l2"] is None


def test_greedy_match_consumes(spark):
    box = "frame string, subject string, x1 double, y1 double, x2 double, y2 double"
    truth = spark.createDataFrame([("f", "a", 0.0, 0.0, 1.0, 1.0), ("f", "b", 0.0, 0.0, 1.0, 1.0), ("g", "c", 0.0, 0.0, 1.0, 1.0)], box)
    found = spark.createDataFrame([("f", "p", 0.0, 0.0, 1.0, 0.5)], box)
    assert {r.subject: r.matched for r in spatial.greedy_match(truth, found).collect()} == {"a": "p", "b": None, "c": None}


def test_scores_are_null_without_support(spark):
    pairs = spark.createDataFrame([("q", "P", "P"), ("q", "P", None)], "attribute string, truth string, predicted string")
    got = {r.state: (r.precision, r.recall, r.f1) for r in evaluation.scores(pairs, ("P", "N")).collect()}
    assert got["P"] == (1.0, 0.5, round(2 / 3, 9))
    assert got["N"] == (None, None, None)


def test_split_refuses_leaks(spark):
    with pytest.raises(ValueError, match="two sides"):
        evaluation.split_sides(spark.createDataFrame([("a",)], "k string"), "k", ["a"], ["a"])


def test_incident_reopens(spark):
    rows = [(1, 1, "open"), (2, 2, "open"), (3, 3, "resolve"), (4, 4, "resolve"), (5, 5, "open")]
    events = spark.createDataFrame([(i, "o", "s", "r", at, a) for i, at, a in rows], "event_id long, org string, subject string, rule_id string, at long, action string")
    got = sorted((r.opened_at, r.observed_at, r.n_opens, r.resolved_at, r.status) for r in incidents.fold_incidents(events).collect())
    assert got == [(1, 2, 2, 3, "resolved"), (5, 5, 1, None, "active")]


def test_append_drops_repeats_in_batch(spark):
    cols = "observation_id string, camera_id string, t_ns long, log_position long"
    old = spark.createDataFrame([("a", "c", 1, 1)], cols)
    batch = spark.createDataFrame([("a", "c", 1, 0), ("b", "c", 2, 0), ("b", "c", 2, 0), ("z", "d", 3, 0)], cols)
    assert sorted((r.observation_id, r.log_position) for r in log.append_idempotent(old, batch).collect()) == [("b", 2), ("z", 1)]


def test_log_digest_is_flat(spark):
    """One list of run digests a camera, for few runs and for many, as the query's SQL has it."""
    sha = lambda parts: hashlib.sha256("\n".join(parts).encode()).hexdigest()
    sizes = {"a": 700, "b": 1, "c": 4, "d": 5, "e": 12}
    rows = [(f"i{c}{p}", "view" if p % 3 else None, p * 7, f"o{p % 4}", "person", c, p) for c, n in sizes.items() for p in range(1, n + 1)]
    want = {}
    for c, n in sizes.items():
        lines = ["|".join(str(x) for x in r[:5] if x is not None) for r in rows if r[5] == c]
        runs = [sha(lines[i : i + 2]) for i in range(0, n, 2)]
        want[c] = (sha(runs), len(runs))
    random.Random(2).shuffle(rows)
    obs = spark.createDataFrame(rows, "observation_id string, kind string, t_ns long, object_id string, class_id string, camera_id string, log_position long")
    for batch in (7, 10000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            assert {r.camera_id: (r.digest, r.n_runs) for r in log.digest_by_camera(obs, 2).collect()} == want
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert log.digest_by_camera(obs.limit(0)).collect() == []


def test_percentile_rules(spark):
    row = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],)], "v array<double>").select(text.percentile_floor(F.col("v"), 0.5).alias("a"), text.percentile_nearest(F.col("v"), 0.5).alias("b")).first()
    assert (row.a, row.b) == (3.0, 2.0)


def test_text_functions(spark):
    raw = spark.createDataFrame([("a: 1\nb : x:y\nnope\na: 2", "cam/e3/f17", "token = abc 0123456789abcdef0123456789abcdef")], "kv string, ref string, s string")
    row = raw.select(text.key_values(F.col("kv"), ("a", "b", "c")).alias("m"), *(c.alias(n) for c, n in zip(text.frame_parts(F.col("ref")), "xyz", strict=True)), text.scrubbed(F.col("s")).alias("s")).first()
    assert row.m == {"a": "2", "b": "x:y", "c": None}
    assert (row.x, row.y, row.z) == ("cam", 3, 17)
    assert row.s == "token=[redacted] [redacted]"


def _python_suppress(rows, heartbeat):
    last, out = {}, []
    for s, t, o, d in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if stateful.admit(last.get(s), t, d, heartbeat):
            last[s] = (t, d)
            out.append((s, t, o))
    return sorted(out)


def test_suppression_batch_and_stream(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(rnd.choice("abc"), t, t, rnd.choice("xy")) for t in range(200)]
    schema = "subject string, t_ns long, ordinal long, digest string"
    want = _python_suppress(rows, 7)
    assert sorted(map(tuple, stateful.suppress(spark.createDataFrame(rows, schema), 7).collect())) == want
    for i in range(4):  # files arrive one by one
        spark.createDataFrame(rows[i * 50 : i * 50 + 50], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = stateful.suppress_stream(stream, 7).writeStream.format("memory").queryName("published").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("published").collect())) == want


def test_streaming_fold_equals_batch(spark, tmp_path):
    rows = [(f"o{i % 3}", f"k{i % 2}", f"v{i}", i * 7 % 50, i) for i in range(60)]
    schema = "object_id string, attr_key string, attr_value string, t_ns long, event_id long"
    for i in range(3):
        spark.createDataFrame(rows[i * 20 : i * 20 + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stateful.fold_to_table(spark, stream, str(tmp_path / "out"), str(tmp_path / "c"))
    got = {(r.object_id, r.attr_key): r.attr_value for r in spark.read.parquet(str(tmp_path / "out/v=2")).collect()}
    batch = state.current_attributes(spark.createDataFrame([(*r, None) for r in rows], schema + ", valid_until_ns long"))
    assert got == {(r.object_id, r.attr_key): r.attr_value for r in batch.collect()}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "subject string, t_ns long, ordinal long, digest string")
    assert stateful.suppress(empty).count() == 0
    assert log.page_after(spark.createDataFrame([], "observation_id string, t_ns long"), (0, ""), 5).count() == 0
