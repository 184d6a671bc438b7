"""Typed values, schemas and documents against what plain Python says of the same values."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from witnesslake.functions import values
from witnesslake.operators import documents, exposure, perception, rules

HELD = [True, False, 0, 1, 1.0, -7, 2.5, "worn", "1", "", [1], ["worn", True], [], None, 10**7, 1e7, 0.0001, 1e-4 + 1e-20, 1e22, 10**22, 2**53, 2**53 + 1, float(2**53), -0.0, 1e300, 2.0**70, 2**70, 2**70 + 1, 1e37, 10**37]
HELD += [["a,t:b"], ["a", "b"], [[1, 2.0], [3]], [[1.0, 2], [3]], [[1], [2.0, 3]], [None], [[]], ["1:n"], "null", {"a": 1}, {"b": 1}]
NUMBERS = lambda v: isinstance(v, int | float) and not isinstance(v, bool)


def said(op, held, expected):
    """What Python's own comparison says; null where two values have no order."""
    if op in ("eq", "ne"):
        return (held == expected) == (op == "eq")
    if op in ("in", "not_in"):
        return (held in expected) == (op == "in")
    if not (NUMBERS(held) and NUMBERS(expected)):
        return None
    return {"gt": held > expected, "gte": held >= expected, "lt": held < expected, "lte": held <= expected}[op]


def test_compare_matrix(spark):
    large = (10**7, 1e-4, 1e22, 2**53, 2**53 + 1, float(2**53 + 2), -0.0, 2**70, 2.0**70, 1e300, 10**37, ["a", "b"], ["a,t:b"], [[1, 2], [3]], [None], "null", {"a": 1})
    asked = [(op, x) for op in ("eq", "ne", "gt", "gte", "lt", "lte") for x in (True, 0, 1, 2.5, "worn", "1", "-7", *large)] + [(op, [10**7, 1e-4, [1.0, 2], ["a,t:b"]]) for op in ("in", "not_in")] + [(op, x) for op in ("in", "not_in") for x in ((1, "worn"), (False, None), ())]
    rows = [(i, k, op, json.dumps(v), json.dumps(x)) for i, v in enumerate(HELD) for k, (op, x) in enumerate(asked)]
    pairs = spark.createDataFrame(rows, "i int, k int, op string, held string, expected string").select("i", "k", "op", values.of_json(F.col("held")).alias("h"), values.of_json(F.col("expected")).alias("x"))
    for r in pairs.select("i", "k", values.compare(F.col("op"), F.col("h"), F.col("x")).alias("c")).collect():
        op, x = asked[r.k]
        assert r.c == said(op, HELD[r.i], list(x) if isinstance(x, tuple) else x), (op, HELD[r.i], x)
    literal = spark.range(1).select(values.compare("in", values.of_python(1e7), values.of_python((10**7, "x"))).alias("c"))
    assert literal.first().c is True


@pytest.mark.parametrize(("op", "value", "want"), [("eq", 1, False), ("ne", True, True), ("in", (1, 2), False), ("not_in", (1, "x"), False), ("gt", 0, None), ("lte", "9", None), ("eq", "x", True)])
def test_text_has_no_order_and_equals_no_number(spark, op, value, want):
    assert spark.createDataFrame([("x",)], "s string").select(rules.compare(op, F.col("s"), value).alias("c")).first().c == want


def test_type_reasons(spark):
    cases = [
        ("true", "bool", [], False, None), ("1", "bool", [], False, "expected_boolean"), ('"a"', "enum", ["a"], False, None), ('"b"', "enum", ["a"], False, "outside_domain"), ("true", "scalar", [], False, "expected_number"),
        ("0.5", "scalar", ["0:1"], False, None), ("1.5", "scalar", ["0:1"], False, "outside_range"), ("9", "scalar", ["low:high"], False, None), ("-1", "count", [], False, "negative_count"), ("1.5", "count", [], False, "expected_integer"),
        ('["a"]', "enum", ["a"], True, None), ('["a","b"]', "enum", ["a"], True, "outside_domain"), ('"a"', "enum", ["a"], True, "expected_sequence"), ('["a"]', "enum", ["a"], False, "expected_single"), ("[1,2.5]", "vector", [], False, None),
        ("[1,true]", "vector", [], False, "vector_not_numbers"), ("[]", "vector", [], False, "expected_vector"), ('""', "relation", [], False, "expected_referent"), ('"bag"', "relation", ["bag"], False, None), ("null", "text", [], False, "expected_text"),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, j string, t string, d array<string>, m boolean, want string")
    got = df.select("i", "want", documents.type_reason(F.col("j"), F.col("t"), F.col("d"), F.col("m")).alias("got")).collect()
    assert [(r.i, r.got) for r in got] == [(r.i, r.want) for r in got]


def test_strict_json(spark):
    texts = ["1", " 1 \n", "1 trash", "1}", '1,"x":2', '1,"v":2', "{} {}", '{"a":1} and {"b":2}', '[1]]', "", " ", None, "null", '"a"', "tru", "01", '{"a":1,}', '{"a":{"b":[1,2]}} //', '1,"end":0} {', "[1,2", "nan", "'a'"]

    def strictly(t):
        try:
            return json.dumps(json.loads(t))
        except (TypeError, ValueError):
            return None

    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", F.to_json(values.strict(F.col("t"))).alias("j")).collect()
    assert {texts[r.i]: r.j and json.dumps(json.loads(r.j)) for r in got} == {t: strictly(t) for t in texts}
    said = spark.createDataFrame([('{"a":1} and {"b":2}',), ('so {"a":1} it is',), ('{"a":1}',)], "t string").select(documents.coerce_object(F.col("t")).alias("c")).collect()
    assert [(r.c.fields, r.c.reparsed, bool(r.c.unparsed)) for r in said] == [(None, False, True), ({"a": "1"}, True, False), ({"a": "1"}, False, False)]
    refused = spark.createDataFrame([("1 trash",), ("1",)], "j string").select(documents.type_reason(F.col("j"), F.lit("count"), F.array().cast("array<string>"), F.lit(False)).alias("r")).collect()
    assert [r.r for r in refused] == ["expected_integer", None]
    assert documents.parse(spark.createDataFrame([(1, '{"rules":[]} x')], "document_id int, body string")).first().reject == "not_json"


def test_documents_of_odd_shapes(spark):
    bodies = {0: None, 1: "", 2: "[]", 3: "{}", 4: '{"rules":null}', 5: '{"rules":[{"rule_id":"a","version":"1","require":[{"attribute":"x"}]}]}', 6: '{"rules":[{"rule_id":"a","version":"1","require":[{"attribute":"x","operator":"in","value":"y"}]}]}', 7: '{"rules":[{"version":"1","require":[{"attribute":"x","operator":"present"}]}]}', 8: '{"rules":[{"rule_id":"a","version":"1","require":[{"operator":"present"}]}]}', 9: '{"rules":[{"rule_id":"a","version":"1","require":[{"attribute":"x","value":0}]}]}'}
    got = {r.document_id: r.reject for r in documents.parse(spark.createDataFrame(list(bodies.items()), "document_id int, body string")).collect()}
    assert got == {0: "not_json", 1: "not_json", 2: None, 3: None, 4: "rules_not_a_list", 5: "missing_value", 6: "in_without_list", 7: "missing_rule_id", 8: "missing_attribute", 9: None}


def test_chains_of_merges(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (200, 201), (201, 200)]
    got = dict(map(tuple, exposure.resolved(spark.createDataFrame(links, "object_id long, merged_into long")).collect()))
    assert {k: v for k, v in got.items() if k < 200} == {**dict.fromkeys(range(40), 40), 100: 101}


def test_percentiles_by_range(spark):
    import random

    rnd = random.Random(1)
    rows = [(g, round(rnd.choice([-3, 0, 5, 200]) * rnd.random(), 2)) for g in "abc" for _ in range(300)] + [("d", 7.0)] + [("e", None)]
    got = {r.g: r for r in exposure.summary(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()}
    for g in "abcd":
        v = sorted(x for h, x in rows if h == g)
        assert (got[g].n, got[g].least, got[g].p50, got[g].p95, got[g].most) == (len(v), v[0], v[min(len(v) - 1, int(0.5 * len(v)))], v[min(len(v) - 1, int(0.95 * len(v)))], v[-1])
    assert "e" not in got


def test_points_on_the_horizon_have_no_place(spark):
    df = spark.createDataFrame([(0.0, 1.0), (0.5, 0.5)], "x double, y double")
    flat = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, -1.0, 1.0]]
    got = df.select(*(c.alias(n) for c, n in zip(perception.projected(F.col("x"), F.col("y"), flat), "gh", strict=True))).collect()
    assert [tuple(r) for r in got] == [(None, None), (1.0, 1.0)]
    none = df.select(perception.projected(F.col("x"), F.col("y"), [[0.0] * 3] * 3)[0].alias("g")).collect()
    assert {r.g for r in none} == {None}


def test_summary_of_infinities(spark):
    inf, nan = float("inf"), float("nan")
    rows = [("a", v) for v in (1.0, inf, -inf, 2.0, -3.0, 0.0, inf)] + [("b", nan), ("b", 1.0)]
    got = {r.g: (r.n, r.least, r.p50) for r in exposure.summary(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()}
    assert got["a"] == (7, -inf, 1.0)
    assert got["b"][:2] == (2, 1.0) and got["b"][2] != got["b"][2]
