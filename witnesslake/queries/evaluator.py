"""Rule documents to findings to incidents, and the index of subscriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from witnesslake.catalog import START, _attrs, _obs, query
from witnesslake.functions import values
from witnesslake.operators import documents, evaluator, incidents, state, subscriptions
from witnesslake.sources import views
from witnesslake.sources.views import table

#: The times at which all rules are evaluated.
PASSES = [START + d * views.DAY_NS for d in (3, 6, 12)]
#: A nation's rule by its number k, in words that Spark and SQL share.
_RULE = """concat('{"rule_id":"r', k, '","version":"1","severity":"', case k % 3 when 0 then 'informational' when 1 then 'low' else 'high' end, '","subject_classes":', case k % 4 when 0 then '[]' when 1 then '["person"]' when 2 then '["vehicle","vehicle.forklift"]' else '["person.child"]' end,
    ',"scope":{"camera_ids":', case when k % 5 = 0 then '["cam-1","cam-2"]' else '[]' end, '},"evidence":{"max_staleness_ms":', case when k % 6 = 1 then '172800000' else 'null' end, ',"requires":', case when k % 7 = 2 then '["a3"]' else '[]' end, ',"require_full_coverage":', case when k % 8 = 3 then 'true' else 'false' end,
    '},"when":', case k % 3 when 0 then '[{"attribute":"a0","operator":"present"}]' when 1 then '[{"attribute":"a0","operator":"ne","value":"absent","unknown_values":["unknown"]}]' else '[]' end,
    ',"require":[{"attribute":"a', case when k % 9 = 4 then 9 else k % 5 end, '","operator":"', case k % 4 when 0 then 'eq","value":"worn"' when 1 then 'ne","value":"absent"' when 2 then 'in","value":["worn",7]' else 'NOT_IN","value":["absent"]' end, ',"unknown_values":["not_visible"]},{"attribute":"score","operator":"gte","value":', k * 3, '.0}]}')"""


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document a region, with a rule a nation."""
    rules = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("document_id"), F.col("n_nationkey").alias("k")).select("document_id", F.struct("k", F.expr(_RULE).alias("r")).alias("r"))
    bodies = rules.groupBy("document_id").agg(F.array_sort(F.collect_list("r")).alias("r"))
    return documents.parse(bodies.select("document_id", F.concat(F.lit('{"version":"2","rules":['), F.array_join(F.transform("r", lambda x: x["r"]), ","), F.lit("]}")).alias("body")))


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs, rules = _obs(spark, sf_dir), evaluator.rule_rows(_parsed(spark, sf_dir))
    times = F.explode(F.array(*map(F.lit, PASSES)))
    objects = state.objects(obs).select("object_id", "camera_id", "class_id", times.alias("now_ns"))
    # an object also holds, as its score, the number of its latest measured observation
    scores = obs.where("kind = 'spatial'").select("object_id", F.lit("score").alias("attr_key"), values.of_json(F.col("k").cast("string")).alias("value"), "t_ns", F.lit(None).cast("long").alias("valid_until_ns"), "event_id")
    said = views.attributes(obs).select("object_id", "attr_key", values.of_text(F.col("attr_value")).alias("value"), "t_ns", "valid_until_ns", "event_id").unionByName(scores)
    latest = F.max_by(F.struct("value", F.col("t_ns").alias("observed_at_ns"), "valid_until_ns"), F.struct("t_ns", "event_id"))
    held = said.withColumn("now_ns", times).where("t_ns <= now_ns").groupBy("object_id", "now_ns", "attr_key").agg(latest.alias("h")).select("object_id", "now_ns", "attr_key", "h.*")
    # cameras with an odd number of errors count as half seen
    coverage = obs.groupBy("camera_id").agg(F.when(F.count_if(F.col("kind") == "coverage") % 2 == 1, 0.5).otherwise(1.0).alias("fraction"))
    asked = rules.select(F.explode("conditions").alias("c")).select(F.col("c.attribute").alias("attribute")).distinct()
    gaps = asked.join(said.select(F.col("attr_key").alias("attribute")).distinct(), "attribute", "left_anti")
    return evaluator.evaluate(rules, objects, held, coverage, gaps)


_FOUND = f"""
    , pass as (select unnest([{', '.join(map(str, PASSES))}]) as now_ns),
    r as (select n_regionkey as document_id, n_nationkey as k, 'r' || n_nationkey as rule_id, case n_nationkey % 3 when 0 then 'informational' when 1 then 'low' else 'high' end as severity from nation),
    said as (select object_id, attr_key, attr_value as v, null::double as n, t_ns, valid_until_ns, event_id from attrs union all select object_id, 'score', null, k::double, t_ns, null, event_id from obs where kind = 'spatial'),
    hold as (select object_id, now_ns, attr_key, arg_max(struct_pack(v := v, n := n, at := t_ns, until := valid_until_ns), (t_ns, event_id)) as h from said, pass where t_ns <= now_ns group by all),
    cov as (select camera_id, case when count(*) filter (kind = 'coverage') % 2 = 1 then 0.5 else 1.0 end as fraction from obs group by 1),
    pair as (select object_id, camera_id, class_id, now_ns, r.*, fraction from objs join cov using (camera_id), pass, r where (k % 4 = 0 or (k % 4 = 1 and starts_with(class_id, 'person')) or (k % 4 = 2 and starts_with(class_id, 'vehicle')) or (k % 4 = 3 and class_id = 'person.child')) and (k % 5 > 0 or camera_id in ('cam-1', 'cam-2'))),
    c as (select *, true as guard, 'a0' as attribute, case k % 3 when 0 then 'present' else 'ne' end as op from pair where k % 3 < 2 union all select *, false, case when k % 9 = 4 then 'a9' else 'a' || (k % 5) end, (['eq', 'ne', 'in', 'not_in'])[k % 4 + 1] from pair union all select *, false, 'score', 'gte' from pair),
    j as (select c.*, hold.h, e.h as e from c left join hold on hold.object_id = c.object_id and hold.now_ns = c.now_ns and hold.attr_key = c.attribute left join hold e on e.object_id = c.object_id and e.now_ns = c.now_ns and e.attr_key = 'a3'),
    w as (select *, case when attribute not in (select attr_key from said) then 'CAPABILITY_GAP' when k % 8 = 3 and fraction < 1 then 'COVERAGE_GAP' when op = 'present' then null when h is null then 'ATTRIBUTE_ABSENT' when h.v = case when guard then 'unknown' else 'not_visible' end then 'NOT_OBSERVABLE'
        when now_ns > h.until or (k % 6 = 1 and now_ns - h.at > 172800000000000) then 'ATTRIBUTE_STALE' when k % 7 = 2 and (e is null or now_ns > e.until) then 'EVIDENCE_UNVERIFIED' end as reason from j),
    s as (select *, case when reason is not null then null when op = 'present' then h is not null when op = 'gte' then h.n >= k * 3 when op = 'eq' then h.v = 'worn' when op = 'in' then h.v = 'worn' else h.v <> 'absent' end as ok from w),
    g as (select *, max(case when guard and ok = false then 2 when guard and ok is null then 1 else 0 end) over (partition by object_id, now_ns, k) as stop from s),
    found as (select rule_id, severity, document_id, object_id, camera_id, now_ns as evaluated_at_ns, case when max(stop) = 2 then 'NOT_APPLICABLE' when max(stop) = 1 then 'UNKNOWN' when bool_or(ok = false) then 'VIOLATION' when bool_or(ok is null) then 'UNKNOWN' else 'COMPLIANT' end as state,
        cast(count(*) filter (ok = false) as int) as n_failed, cast(count(*) filter (ok is null) as int) as n_unknown, coalesce(string_agg(distinct reason, ',' order by reason), '') as reasons from g where stop = 0 or guard group by all)
"""


@query(f"{_FOUND} select rule_id || '@1:' || object_id || ':' || evaluated_at_ns as finding_id, document_id, severity, camera_id, state, n_failed, n_unknown, reasons from found")
def findings_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir).select("finding_id", "document_id", "severity", "camera_id", "state", "n_failed", "n_unknown", "reasons")


@query(f"""{_FOUND}, ev as (select ('t' || (cast(substr(camera_id, 5) as int) % 2)) as org, object_id as subject, rule_id, evaluated_at_ns as t, state from found where severity <> 'informational' and state in ('VIOLATION', 'COMPLIANT')),
    runs as (select *, coalesce(sum(case when state = 'COMPLIANT' then 1 else 0 end) over (partition by org, subject, rule_id order by t rows between unbounded preceding and 1 preceding), 0) as run from ev)
    select org, subject, rule_id, min(t) filter (state = 'VIOLATION') as opened_at, max(t) filter (state = 'VIOLATION') as observed_at, count(*) filter (state = 'VIOLATION') as n_opens, max(t) filter (state = 'COMPLIANT') as resolved_at, case when max(t) filter (state = 'COMPLIANT') is null then 'active' else 'resolved' end as status
    from runs group by org, subject, rule_id, run having count(*) filter (state = 'VIOLATION') > 0""")
def incidents_from_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three passes of evaluation, folded: what was violated, for how long, and whether it still is."""
    tenant = F.concat(F.lit("t"), (F.substring("camera_id", 5, 9).cast("int") % 2).cast("string"))
    return incidents.fold_incidents(evaluator.incident_events(_findings(spark, sf_dir), tenant))


def _subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A subscription a customer: lists of kinds, cameras, classes and keys, some empty."""
    k = F.col("c_custkey")
    some = lambda test, *items: F.when(test, F.array(*items)).otherwise(F.array().cast("array<string>"))
    kind = lambda i: F.element_at(F.array(*map(F.lit, views.KINDS.values())), (i % 5 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(
        k.alias("subscription"), some(k % 7 > 0, kind(k), kind(k + 2)).alias("kinds"), some(k % 11 > 0, F.concat(F.lit("cam-"), k % 8)).alias("cameras"),
        some(k % 3 > 0, F.element_at(F.array(*map(F.lit, ("person", "vehicle.forklift"))), (k % 2 + 1).cast("int")), F.element_at(F.array(*map(F.lit, ("person.child", "vehicle"))), (k % 2 + 1).cast("int"))).alias("classes"), some(k % 5 > 0, F.concat(F.lit("a"), F.floor(k / 8) % 5)).alias("keys"),
    )


@query("""select c_custkey as subscription, count(*) as n, min(event_id) as first_event, max(event_id) as last_event from customer join obs on
    (c_custkey % 7 = 0 or kind in ((['presence', 'spatial', 'attribute', 'lifecycle', 'coverage'])[c_custkey % 5 + 1], (['presence', 'spatial', 'attribute', 'lifecycle', 'coverage'])[(c_custkey + 2) % 5 + 1])) and (c_custkey % 11 = 0 or camera_id = 'cam-' || (c_custkey % 8))
    and (c_custkey % 3 = 0 or starts_with(class_id, case c_custkey % 2 when 0 then 'person' else 'vehicle' end)) and (c_custkey % 5 = 0 or attr_key = 'a' || (c_custkey // 8 % 5)) group by 1""")
def subscription_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many observations each subscription gets, and the first and last of them."""
    obs = views.observations(spark, sf_dir, placed=False)
    return subscriptions.totals(obs, _subscriptions(spark, sf_dir), "event_id").withColumnsRenamed({"first": "first_event", "last": "last_event"})
