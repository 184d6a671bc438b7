"""Demands and crop admission against one writer and one budget in plain Python."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from tests.conftest import SF, rows_of
from witnesslake import catalog
from witnesslake.operators import demands

KNOWN = [("a", True), ("b", True), ("c", False)]


def drawn(seed):
    draw = random.Random(seed)
    return [(i, draw.choice(["d1", "d2", "d3"]), draw.randint(0, 60), draw.choice(["register", "update", "revoke"]), draw.choice(["p", "p", "q"]), draw.choice([["a"], ["a", "c"], ["x"], ["x", "y"], ["c"], ["b", "x"], []]), draw.choice([1, 3 * 10**9])) for i in range(80)]


def plain(commands):
    live, out, versions = {}, {}, []
    count = Counter()
    for i, d, at, action, who, attributes, fresh in sorted(commands, key=lambda c: (c[2], c[0])):
        can = dict(KNOWN)
        good, bad = [a for a in attributes if can.get(a)], [a + (":no_capable_model" if a in can else ":attribute_not_registered") for a in attributes if not can.get(a)]
        status = "rejected" if attributes and not any(a in can for a in attributes) else "partially_accepted" if bad else "accepted"
        close = lambda: versions.append((*live.pop(d), at)) if d in live else None  # noqa: B023, E731
        owner = live[d][2] if d in live else None
        if action != "register" and owner is None:
            result = "unknown"
        elif owner not in (None, who):
            result = "forbidden"
        elif action != "revoke" and status == "rejected":
            result = "withdrawn" if action == "update" else "rejected"
        else:
            result = "applied"
        if result in ("applied", "withdrawn"):
            count[d] += 1
            close()
            if action != "revoke" and result == "applied":
                live[d] = (d, count[d], who, status, max(fresh, 2 * 10**9), at)
        out[i] = (result, count[d], status, good, bad)
    return out, {*versions, *((*x, None) for x in live.values())}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_demands_are_those_of_one_writer(spark, tmp_path, seed):
    commands = drawn(seed)
    frame = spark.createDataFrame(commands, "command_id long, demand_id string, at_ns long, action string, principal string, attributes array<string>, freshness_ns long")
    # the log is appended to in parts
    demands.append(frame.where("at_ns < 30"), f"{tmp_path}/log")
    demands.append(frame.where("at_ns >= 30"), f"{tmp_path}/log")
    known = spark.createDataFrame(KNOWN, "attribute string, producible boolean")
    judged = demands.outcomes(demands.acknowledge(spark.read.parquet(f"{tmp_path}/log"), known, 2 * 10**9))
    outcomes, versions = plain(commands)
    assert {r.command_id: (r.outcome, r.version, r.status, r.satisfiable, r.unsatisfiable) for r in judged.collect()} == outcomes
    stored = demands.versions(judged)
    got = {(r.demand_id, r.version, r.subscriber, r.status, r.effective_ns, r.since_ns, r.until_ns) for r in stored.collect()}
    assert got == versions and {x[0] for x in outcomes.values()} == {"applied", "unknown", "forbidden", "withdrawn", "rejected"}
    for t in (-1, 20, 100):
        assert {(r.demand_id, r.version) for r in demands.as_of(stored, t).collect()} == {x[:2] for x in versions if x[5] <= t and (x[6] is None or x[6] > t)}


@pytest.mark.parametrize(("budget", "ceiling"), [(0, 2), (7, 2), (25, 3), (1000, 1)])
def test_admission_is_that_of_one_budget(spark, budget, ceiling):
    draw = random.Random(budget)
    requests = [(f"c{draw.randint(0, 2)}", draw.randint(0, 29), i, draw.randint(0, 3), draw.random() < 0.3, ["d", f"e{i % 2}"]) for i in range(200)]
    frame = spark.createDataFrame(requests, "camera_id string, t_ns long, request_id long, priority int, refunded boolean, demand_ids array<string>")
    want, calls, window, credit = {}, Counter(), None, 0
    for t, cam in sorted({(r[1], r[0]) for r in requests}):
        if t // 10 != window:
            window, credit = t // 10, budget
        taken, back = 0, 0
        for r in sorted((r for r in requests if (r[1], r[0]) == (t, cam)), key=lambda r: (-r[3], r[2])):
            if taken >= ceiling:
                want[r[2]] = "preempted"
            elif credit < 1:
                want[r[2]] = "exhausted"
            else:
                want[r[2]], taken, credit, back = "admitted", taken + 1, credit - 1, back + r[4]
                for d in r[5] if not r[4] else []:
                    calls[window, d] += 1
        credit += back
    admitted = demands.admit(frame, budget, ceiling, 10)
    assert {r.request_id: r.outcome for r in admitted.collect()} == want
    assert {(r.window_no, r.demand_id): r.calls for r in demands.demand_calls(admitted, 10).collect()} == calls
    assert "Window" not in "".join(x for x in admitted._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window" in x and "camera_id" not in x)  # noqa: SLF001


@pytest.mark.parametrize("name", ["demand_acknowledgements", "demand_versions", "demands_as_of", "crop_admission", "demand_calls"])
def test_matches_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF), duck.sql(catalog.ORACLES[name])
    cols = sorted(got.columns)
    assert rows_of(got, cols) == sorted(map(str, want.select(", ".join(cols)).fetchall()))
