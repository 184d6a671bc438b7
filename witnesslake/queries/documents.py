"""Rule documents, typed values, attribute schemas and model answers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from witnesslake.catalog import _obs, query
from witnesslake.functions import values
from witnesslake.operators import documents
from witnesslake.sources.views import table

#: A value as JSON by an event's number, in words that Spark and SQL share.
_HELD = """case k % 11 when 0 then 'true' when 1 then 'false' when 2 then '1' when 3 then '1.0' when 4 then '0' when 5 then '"1"' when 6 then '"worn"' when 7 then 'null' when 8 then '[1]' when 9 then '2.5' else '-7' end"""
EXPECTED = [("eq", 1), ("eq", True), ("eq", "worn"), ("ne", 1.0), ("ne", "1"), ("in", (1, "worn")), ("in", (0, None)), ("not_in", (2.5, True)), ("gt", 0), ("gt", "0"), ("gte", 1), ("lt", 2.5), ("lt", True), ("lte", -7), ("present", None)]


@query("""
    , t(held, eq, same) as (values ('true', 'n1', null), ('false', 'n0', null), ('1', 'n1', 1), ('1.0', 'n1', 1), ('0', 'n0', 0), ('"1"', 't1', null), ('"worn"', 'tworn', null), ('null', '', null), ('[1]', 'l1', null), ('2.5', 'n2.5', 2.5), ('-7', 'n-7', -7)),
    x(i, op, keys, n) as (values (0, 'eq', ['n1'], null), (1, 'eq', ['n1'], null), (2, 'eq', ['tworn'], null), (3, 'ne', ['n1'], null), (4, 'ne', ['t1'], null), (5, 'in', ['n1', 'tworn'], null), (6, 'in', ['n0', ''], null), (7, 'not_in', ['n2.5', 'n1'], null),
        (8, 'gt', [], 0), (9, 'gt', [], null), (10, 'gte', [], 1), (11, 'lt', [], 2.5), (12, 'lt', [], null), (13, 'lte', [], -7), (14, 'present', [], null)),
    h as (select HELD as held, count(*) as n from obs group by 1)
    select x.i, h.held, case op when 'eq' then list_contains(keys, eq) when 'in' then list_contains(keys, eq) when 'ne' then not list_contains(keys, eq) when 'not_in' then not list_contains(keys, eq)
        when 'gt' then same > x.n when 'gte' then same >= x.n when 'lt' then same < x.n when 'lte' then same <= x.n else true end as outcome, h.n from h join t using (held), x
""".replace("HELD", _HELD))  # fmt: skip
def rule_compare_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All operators over values of all kinds: what each comparison says, and of how many observations."""
    held = _obs(spark, sf_dir).groupBy(F.expr(_HELD).alias("held")).agg(F.count("*").alias("n")).select("held", "n", values.of_json(F.col("held")).alias("v"))
    asked = json.dumps([{"i": i, "op": op, "x": json.dumps(x)} for i, (op, x) in enumerate(EXPECTED)])
    wanted = F.transform(F.from_json(F.lit(asked), "array<struct<i: int, op: string, x: string>>"), lambda w: F.struct(w["i"].alias("i"), w["op"].alias("op"), values.of_json(w["x"]).alias("x")))
    return held.select("held", "n", "v", F.inline(wanted)).select("i", "held", values.compare(F.col("op"), F.col("v"), F.col("x")).alias("outcome"), "n")


#: A rule document by a number i, with one fault or none, in words that Spark and SQL share.
_R1 = """concat('{"rule_id":"r', i % 5, '","version":"', case when i % 19 = 0 then '' else '1' end, '","severity":"high","subject_classes":["person"],"evidence":{"max_staleness_ms":', i * 100, '},"when":[{"attribute":"a0","operator":"present"}],"require":', case when i % 11 = 0 then '[]' else concat('[{"attribute":"a1","operator":"', case when i % 13 = 0 then 'like' else 'EQ' end, '","value":', i % 4, '},{"attribute":"a2","operator":"in","value":', case when i % 17 = 0 then '"x"' else '["x",true,1.5]' end, '}]') end, '}')"""
_R2 = """concat('{"rule_id":"r', case when i % 7 = 0 then i % 5 else 9 end, '","version":"2","require":[{"attribute":"a3","value":"worn"}]}')"""
_BODY = f"""concat('{{"version":"v', i % 3, '","rules":', case when i % 29 = 0 then '{{}}' else concat('[', {_R1}, ',', {_R2}, ']') end, case when i % 23 = 0 then '' else '}}' end)"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("i")).select(F.col("i").alias("document_id"), F.expr(_BODY).alias("body"))


@query("""with d as (select c_custkey as i from customer) select i as document_id, case when i % 23 = 0 then 'not_json' when i % 29 = 0 then 'rules_not_a_list' when i % 11 <> 0 and i % 13 = 0 then 'unknown_operator' when i % 11 <> 0 and i % 17 = 0 then 'in_without_list'
    when i % 19 = 0 then 'missing_version' when i % 11 = 0 then 'empty_require' when i % 7 = 0 then 'duplicate_rule_id' end as reject from d""")
def ruleset_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.parse(_documents(spark, sf_dir)).select("document_id", "reject")


@query(f"""with d as (select i as document_id, json({_BODY}) as b from (select c_custkey as i from customer) where i % 23 > 0 and i % 29 > 0 and i % 13 > 0 and i % 17 > 0 and i % 19 > 0 and i % 11 > 0 and i % 7 > 0),
    r as (select document_id, b->>'$.version' as version, unnest(range(0, cast(json_array_length(b, '$.rules') as int))) as rule, b from d), q as (select document_id, version, rule, json_extract(b, '$.rules[' || rule || ']') as r from r),
    c as (select *, 'require' as part, unnest(range(0, cast(json_array_length(r, '$.require') as int))) as ord from q union all select *, 'when' as part, unnest(range(0, cast(coalesce(json_array_length(r, '$.when'), 0) as int))) as ord from q),
    x as (select document_id, version, cast(rule as int) as rule, r->>'$.rule_id' as rule_id, part, cast(ord as int) as ord, json_extract(r, '$.' || part || '[' || ord || ']') as c from c)
    select document_id, version, rule, rule_id, part, ord, c->>'$.attribute' as attribute, lower(coalesce(c->>'$.operator', 'eq')) as operator, case coalesce(json_type(c, '$.value'), 'NULL') when 'NULL' then 'null' when 'VARCHAR' then 'text' when 'ARRAY' then 'list' else 'int' end as kind,
        case coalesce(json_type(c, '$.value'), 'NULL') when 'NULL' then 'null' when 'VARCHAR' then 't:' || (c->>'$.value') when 'ARRAY' then 'l:t:x,n:1.0,n:1.5' else 'n:' || (c->>'$.value') || '.0' end as key from x""")
def ruleset_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.conditions(documents.parse(_documents(spark, sf_dir)))


SCHEMA = [
    ("posture", "enum", ["standing", "seated"], False, ["person"], "active"), ("headwear", "bool", [], False, ["person"], "active"), ("height", "scalar", ["0:2"], False, [], "active"), ("people", "count", ["0:x"], False, [], "active"),
    ("label", "text", [], False, ["vehicle"], "active"), ("carries", "relation", ["bag"], False, ["person.child"], "active"), ("speed", "vector", [], False, [], "active"), ("tags", "enum", ["red", "blue"], True, [], "active"), ("old", "text", [], False, [], "deprecated"), ("extra", "text", [], False, [], "active"),
]
_SCHEMA = "key string, value_type string, domain array<string>, multi boolean, applies_to array<string>, status string"
#: A model's answer by a number k: its field and value, in words that Spark and SQL share.
_FIELD = "case k % 12 when 0 then 'posture' when 1 then 'headwear' when 2 then 'height' when 3 then 'people' when 4 then 'label' when 5 then 'carries' when 6 then 'speed' when 7 then 'tags' when 8 then 'old' when 9 then 'extra' when 10 then 'unheard' else 'height' end"
_VALUE = """case (k + event_id) % 13 when 0 then '"standing"' when 1 then '"flying"' when 2 then 'true' when 3 then '1' when 4 then '-1' when 5 then '2.5' when 6 then '""' when 7 then '["red"]' when 8 then '["red",1]' when 9 then '[1,2.5]' when 10 then '[]' when 11 then 'null' else '"bag"' end"""
_ONE = """case value_type
    when 'bool' then case when v not in ('true') then 'expected_boolean' end
    when 'enum' then case when substr(v, 1, 1) <> '"' then 'expected_string' when not list_contains(domain, v) then 'outside_domain' end
    when 'scalar' then case when v not in ('1', '-1', '2.5') then 'expected_number' when v in ('-1', '2.5') then 'outside_range' end
    when 'count' then case when v not in ('1', '-1') then 'expected_integer' when v = '-1' then 'negative_count' end
    when 'text' then case when substr(v, 1, 1) <> '"' then 'expected_text' end
    when 'relation' then case when substr(v, 1, 1) <> '"' or v = '""' then 'expected_referent' when not list_contains(domain, v) then 'outside_domain' end end"""


@query(f""", s(field, value_type, domain, multi, cls, status) as (values ('posture', 'enum', ['"standing"', '"seated"'], false, 'person', 'active'), ('headwear', 'bool', [], false, 'person', 'active'), ('height', 'scalar', [], false, '', 'active'), ('people', 'count', [], false, '', 'active'),
        ('label', 'text', [], false, 'vehicle', 'active'), ('carries', 'relation', ['"bag"'], false, 'person.child', 'active'), ('speed', 'vector', [], false, '', 'active'), ('tags', 'enum', [], true, '', 'active'), ('old', 'text', [], false, '', 'deprecated'), ('extra', 'text', [], false, '', 'active')),
    a as (select event_id as answer_id, class_id, {_FIELD} as field, {_VALUE} as v from obs)
    select answer_id, class_id, a.field, v as value, case when s.field is null then 'unregistered' when status = 'deprecated' then 'deprecated' when a.field = 'extra' then 'undeclared' when cls <> '' and class_id <> cls and not starts_with(class_id, cls || '.') then 'class_not_applicable'
        when value_type = 'vector' then case when v = '["red"]' or v = '["red",1]' then 'vector_not_numbers' when v = '[1,2.5]' then null else 'expected_vector' end
        when multi then case v when '["red"]' then null when '[]' then null when '["red",1]' then 'expected_string' when '[1,2.5]' then 'expected_string' else 'expected_sequence' end
        when substr(v, 1, 1) = '[' then 'expected_single' else {_ONE} end as reason from a left join s using (field)""")
def model_output_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each answer's field against the attribute schemas: accepted (null) or why not."""
    answers = _obs(spark, sf_dir).select(F.col("event_id").alias("answer_id"), "class_id", F.expr(_FIELD).alias("field"), F.expr(_VALUE).alias("value"))
    return documents.validate_fields(answers, spark.createDataFrame(SCHEMA, _SCHEMA), [k for k, *_ in SCHEMA if k != "extra"])


_KEY = "concat(case k % 4 when 0 then 'is_' when 1 then 'HAS-' when 2 then 'head.' else '' end, case k % 9 when 0 then 'employee' when 1 then 'headwear' when 2 then 'Unsafe.late' when 3 then 'ok' when 4 then 'status' when 5 then 'lately' when 6 then 'good' when 7 then 'dwell_waiting' else 'colour' end)"
_SAID = "case event_id % 5 when 0 then 'A brim or a strap is seen' when 1 then ' seen ' when 2 then 'This Implies a role of theirs' when 3 then 'the hat must be seen on them' else 'the colour of the cloth is seen' end"


@query(f""", a as (select event_id, {_KEY} as key, {_SAID} as said from obs) select event_id, case when regexp_matches(lower(key), '(^|[_.-])employee($|[_.-])') then 'token:employee' when contains(lower(key), 'unsafe.late') then 'token:late' when contains(key, 'waiting') then 'token:waiting'
    when lower(key) in ('is_ok', 'is_good', 'is_bad', 'is_normal', 'is_valid', 'is_correct', 'status') then 'verdict_key' when event_id % 5 = 1 then 'no_evidence' when event_id % 5 in (2, 3) then 'premise' end as reject from a""")
def neutrality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _obs(spark, sf_dir).select("event_id", documents.neutrality(F.expr(_KEY), F.expr(_SAID)).alias("reject"))


_RAW = """case k % 6 when 0 then concat('{"state":"', attr_value, '","n":', k, '}') when 1 then concat('Sure! {"state":"', attr_value, '"} is what I see.') when 2 then '["worn"]' when 3 then '' when 4 then concat('state: ', attr_value) else concat('{"state":"', attr_value, '","seen":true,"n":null') end"""


@query(f""", a as (select event_id, k, attr_value, {_RAW} as raw from obs) select event_id, case when k % 6 < 2 then '"' || attr_value || '"' end as state, case when k % 6 = 0 then cast(k as varchar) end as n, k % 6 = 1 as reparsed, case when k % 6 in (2, 4, 5) then raw end as unparsed from a""")
def json_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared keys of a model's raw answer; undeclared and unparsable text is told apart, nothing is repaired."""
    c = _obs(spark, sf_dir).select("event_id", documents.coerce_object(F.expr(_RAW)).alias("c"))
    return c.select("event_id", F.element_at("c.fields", F.lit("state")).alias("state"), F.element_at("c.fields", F.lit("n")).alias("n"), "c.reparsed", "c.unparsed")


_TOKEN = "case k % 8 when 0 then 'TRUE' when 1 then 'false' when 2 then 'None' when 3 then '' when 4 then concat('', k) when 5 then '1.50' when 6 then 'yes' else '1e2' end"


@query("select event_id, case k % 8 when 0 then 'bool' when 1 then 'bool' when 2 then 'null' when 3 then 'null' when 4 then 'int' when 5 then 'num' when 6 then 'text' else 'num' end as kind, case k % 8 when 0 then 1 when 1 then 0 when 4 then k when 5 then 1.5 when 7 then 100 end::double as n from obs")
def bare_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = values.of_json(values.bare(F.expr(_TOKEN)))
    return _obs(spark, sf_dir).select("event_id", v.alias("v")).select("event_id", "v.kind", "v.n")
