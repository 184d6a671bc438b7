"""Rule documents against plain Python over the same documents; subscriptions against a test of each."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF, rows_of
from witnesslake import catalog
from witnesslake.functions import values
from witnesslake.operators import documents, evaluator, incidents, subscriptions
from witnesslake.queries.evaluator import _subscriptions

DAY = 86_400 * 10**9


def below(class_id, wanted):
    return class_id == wanted or class_id.startswith(f"{wanted}.")


def plain_compare(op, held, want):
    number = lambda v: isinstance(v, int | float) and not isinstance(v, bool)
    if op in ("eq", "ne"):
        return (held == want) == (op == "eq")
    if op in ("in", "not_in"):
        return (held in want) == (op == "in")
    if not number(held) or not number(want):
        return None
    return {"gt": held > want, "gte": held >= want, "lt": held < want, "lte": held <= want}[op]


def plain_findings(docs, objects, held, coverage, gaps):
    """(finding, document, state, failed, unknown, reasons) of every rule on every object that it covers."""
    out = set()
    for number, body in docs.items():
        for rule in json.loads(body)["rules"]:
            for o, cam, cls, now in objects:
                cams, classes = rule.get("scope", {}).get("camera_ids", []), rule.get("subject_classes", [])
                if (cams and cam not in cams) or (classes and not any(below(cls, c) for c in classes)):
                    continue
                ev = rule.get("evidence", {})
                mine = held.get((o, now), {})
                unsure = any(k not in mine or now > mine[k][2] for k in ev.get("requires", []))

                def judge(c):
                    op, have = c.get("operator", "eq").lower(), mine.get(c["attribute"])  # noqa: B023
                    if c["attribute"] in gaps:
                        return "CAPABILITY_GAP"
                    if ev.get("require_full_coverage") and coverage.get(cam, 1) < 1:  # noqa: B023
                        return "COVERAGE_GAP"
                    if op == "present":
                        return have is not None
                    if have is None:
                        return "ATTRIBUTE_ABSENT"
                    if have[0] in c.get("unknown_values", []) and isinstance(have[0], str):
                        return "NOT_OBSERVABLE"
                    if now > have[2] or (ev.get("max_staleness_ms") is not None and now - have[1] > ev["max_staleness_ms"] * 10**6):  # noqa: B023
                        return "ATTRIBUTE_STALE"
                    if unsure:  # noqa: B023
                        return "EVIDENCE_UNVERIFIED"
                    said = plain_compare(op, have[0], c["value"])
                    return "VALUE_UNPARSEABLE" if said is None else said

                guard = [judge(c) for c in rule.get("when", [])]
                looked, state = guard, None
                if False in guard:
                    state = "NOT_APPLICABLE"
                elif any(isinstance(x, str) for x in guard):
                    state = "UNKNOWN"
                else:
                    looked = guard + (need := [judge(c) for c in rule["require"]])
                    state = "VIOLATION" if False in need else "UNKNOWN" if any(isinstance(x, str) for x in need) else "COMPLIANT"
                reasons = sorted({x for x in looked if isinstance(x, str)})
                out.add((f"{rule['rule_id']}@{rule['version']}:{o}:{now}", number, state, sum(x is False for x in looked), sum(isinstance(x, str) for x in looked), ",".join(reasons)))
    return out


def drawn(seed):
    draw = random.Random(seed)
    pool = ["worn", "absent", "no", True, False, 0, 1, 2.5, 10**7, 1e7, 2**53 + 1, [1, "a,t:b"], [], ["a", "b"]]
    attributes = ["a", "b", "c", "d", "gone"]

    def condition():
        op = draw.choice(["eq", "NE", "in", "not_in", "gt", "gte", "lt", "lte", "present", None])
        c = {"attribute": draw.choice(attributes), "unknown_values": draw.choice([[], ["no"], ["no", "absent"]])}
        if op:
            c["operator"] = op
        if op != "present":
            c["value"] = draw.sample(pool, draw.randint(0, 4)) if op in ("in", "not_in") else draw.choice(pool)
        return c

    def rule(i):
        return {
            "rule_id": f"r{i}", "version": draw.choice(["1", "2"]), "severity": draw.choice(["", "low", "high"]), "subject_classes": draw.choice([[], ["person"], ["person", "person.child"], ["vehicle.truck", "person.child"]]), "scope": draw.choice([{}, {"camera_ids": ["c1"]}, {"camera_ids": ["c1", "c2"]}]),
            "evidence": draw.choice([{}, {"max_staleness_ms": 1000}, {"requires": ["d"]}, {"requires": ["d", "a"], "require_full_coverage": True}, {"max_staleness_ms": None, "require_full_coverage": True}]), "when": [condition() for _ in range(draw.randint(0, 2))], "require": [condition() for _ in range(draw.randint(1, 3))],
        }

    docs = {n: json.dumps({"version": "v", "rules": [rule(20 * n + i) for i in range(20)]}) for n in range(2)}
    objects = [(f"o{i}", f"c{i % 3}", draw.choice(["person", "person.child", "vehicle", "vehicle.truck.x", "persona"]), now) for i in range(12) for now in (5000 * 10**6, 9000 * 10**6)]
    held = {}
    for o, _, _, now in objects:
        held[o, now] = {a: (draw.choice(pool), now - draw.choice([0, 500, 3000]) * 10**6, now + draw.choice([-1, 0, 10])) for a in attributes[:4] if draw.random() < 0.8}
    return docs, objects, held


@pytest.mark.parametrize("seed", [1, 2])
def test_findings_are_the_plain_ones(spark, seed):
    docs, objects, held = drawn(seed)
    coverage, gaps = {"c1": 0.5, "c2": 1.0}, {"gone"} if seed == 1 else set()
    rules = evaluator.rule_rows(documents.parse(spark.createDataFrame(list(docs.items()), "document_id int, body string")))
    seen = spark.createDataFrame(objects, "object_id string, camera_id string, class_id string, now_ns long")
    rows = [(o, now, a, json.dumps(v), at, until) for (o, now), x in held.items() for a, (v, at, until) in x.items()]
    have = spark.createDataFrame(rows, "object_id string, now_ns long, attr_key string, j string, observed_at_ns long, valid_until_ns long").withColumn("value", values.of_json(F.col("j")))
    found = evaluator.evaluate(rules, seen, have, spark.createDataFrame(list(coverage.items()), "camera_id string, fraction double"), spark.createDataFrame([(g,) for g in gaps], "attribute string"))
    got = [(r.finding_id, r.document_id, r.state, r.n_failed, r.n_unknown, r.reasons) for r in found.collect()]
    want = plain_findings(docs, objects, held, coverage, gaps)
    assert len(got) == len(set(got)) and set(got) == want
    assert {w[2] for w in want} == {"COMPLIANT", "VIOLATION", "UNKNOWN", "NOT_APPLICABLE"}
    assert {"COVERAGE_GAP", "ATTRIBUTE_ABSENT", "NOT_OBSERVABLE", "ATTRIBUTE_STALE", "VALUE_UNPARSEABLE"} <= {x for w in want for x in w[5].split(",")}


def test_the_plan_does_not_grow_with_the_rules(spark):
    seen = spark.createDataFrame([("o", "c", "person", 1)], "object_id string, camera_id string, class_id string, now_ns long")
    have = spark.createDataFrame([("o", 1, "a", 0, 9)], "object_id string, now_ns long, attr_key string, observed_at_ns long, valid_until_ns long").withColumn("value", values.of_text(F.lit("worn")))

    def found(n):
        body = json.dumps({"rules": [{"rule_id": f"r{i}", "version": "1", "require": [{"attribute": "a", "value": "worn" if i % 2 else "x"}]} for i in range(n)]})
        return evaluator.evaluate(evaluator.rule_rows(documents.parse(spark.createDataFrame([(1, body)], "document_id int, body string"))), seen, have)

    size = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("\n")  # noqa: E731, SLF001
    assert size(found(3)) == size(found(3000))
    assert {r.state: r["count"] for r in found(3000).groupBy("state").count().collect()} == {"COMPLIANT": 1500, "VIOLATION": 1500}


def test_incidents_of_findings(spark):
    states = ["VIOLATION", "UNKNOWN", "VIOLATION", "COMPLIANT", "NOT_APPLICABLE", "VIOLATION"]
    rows = [("r", s, "o", t, f"r@1:o:{t}", sev) for sev in ("high", "informational") for t, s in enumerate(states)]
    found = spark.createDataFrame(rows, "rule_id string, state string, object_id string, evaluated_at_ns long, finding_id string, severity string")
    got = incidents.fold_incidents(evaluator.incident_events(found, F.lit("org"))).orderBy("opened_at").collect()
    assert [(r.opened_at, r.observed_at, r.n_opens, r.resolved_at, r.status) for r in got] == [(0, 2, 2, 3, "resolved"), (5, 5, 1, None, "active")]


def test_subscriptions_are_found(spark):
    draw = random.Random(4)
    kinds, cams, classes, keys = ["k1", "k2", "k3"], ["c1", "c2"], ["p", "p.q", "p.q.r", "v", "pq"], ["a", "b"]
    pick = lambda x: draw.choice([[], None, draw.sample(x, 1), draw.sample(x, 2)])
    subs = [(i, pick(kinds), pick(cams), pick(classes), pick(keys)) for i in range(150)]
    obs = [(f"o{i}", draw.choice([*kinds, None]), draw.choice([*cams, None]), draw.choice([*classes, None]), draw.choice([*keys, None])) for i in range(80)]
    got = subscriptions.matches(spark.createDataFrame(obs, "observation_id string, kind string, camera_id string, class_id string, attr_key string"), spark.createDataFrame(subs, "subscription int, kinds array<string>, cameras array<string>, classes array<string>, keys array<string>"))
    got = [(r.subscription, r.observation_id) for r in got.collect()]
    want = {(s, o) for s, a, b, c, d in subs for o, w, x, y, z in obs if (not a or w in a) and (not b or x in b) and (not c or (y and any(below(y, q) for q in c))) and (not d or z in d)}
    assert len(got) == len(set(got)) and set(got) == want


def test_subscription_totals(spark):
    draw = random.Random(9)
    kinds, cams, classes, keys = ["k1", "k2", "k3"], ["c1", "c2"], ["p", "p.q", "p.q.r", "v", "pq"], ["a", "b"]
    pick = lambda x: draw.choice([[], None, draw.sample(x, 1), draw.sample(x, 2)])
    subs = [(i // 2, pick(kinds), pick(cams), pick(classes), pick(keys)) for i in range(120)]  # two rows each: an observation counts for both
    obs = [(i, draw.choice([*kinds, None]), draw.choice([*cams, None]), draw.choice([*classes, None]), draw.choice([*keys, None])) for i in range(90)]
    frames = spark.createDataFrame(obs, "event_id long, kind string, camera_id string, class_id string, attr_key string"), spark.createDataFrame(subs, "subscription int, kinds array<string>, cameras array<string>, classes array<string>, keys array<string>")
    want = {}
    for s, a, b, c, d in subs:
        for o, w, x, y, z in obs:
            if (not a or w in a) and (not b or x in b) and (not c or (y and any(below(y, q) for q in c))) and (not d or z in d):
                want.setdefault(s, []).append(o)
    assert sorted(map(tuple, subscriptions.totals(*frames, "event_id").collect())) == sorted((s, len(v), min(v), max(v)) for s, v in want.items())
    assert subscriptions.totals(frames[0].limit(0), frames[1], "event_id").collect() == subscriptions.totals(frames[0], frames[1].limit(0), "event_id").collect() == []


def test_the_subscription_query_makes_no_pairs(spark):
    """Its joins make a row an entry of the index at most, however many observations an entry finds."""
    got = catalog.QUERIES["subscription_index"](spark, SF)
    pairs, made, plans = sum(r.n for r in got.collect()), [], [got._jdf.queryExecution().executedPlan()]  # noqa: SLF001
    while plans:
        plan = plans.pop()
        kind = plan.getClass().getSimpleName()
        if "Join" in kind:
            made.append(plan.metrics().get("numOutputRows").get().value())
        inner = "executedPlan" if kind == "AdaptiveSparkPlanExec" else "plan" if kind.endswith("QueryStageExec") else None
        plans += [getattr(plan, inner)()] if inner else [plan.children().apply(i) for i in range(plan.children().size())]
    assert 0 < sum(made) <= subscriptions.index(_subscriptions(spark, SF)).count() < pairs


@pytest.mark.parametrize("name", ["findings_from_documents", "incidents_from_findings", "subscription_index"])
def test_matches_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF), duck.sql(catalog.ORACLES[name])
    cols = sorted(got.columns)
    assert rows_of(got, cols) == sorted(map(str, want.select(", ".join(cols)).fetchall()))
