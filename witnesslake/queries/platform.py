"""Findings as records, incidents made of them, metrics, invariants, demands, schedules and rings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from witnesslake.catalog import _RULES_SQL, JUDGED, NOW, START, _judged, _log, _obs, query
from witnesslake.operators import incidents, platform, rules, state
from witnesslake.sources import views
from witnesslake.sources.views import table


@query(f"""{_RULES_SQL}, parts as (select rule_id, object_id, arg_min(case when v is not null then 'ev-' || attribute end, ord) filter (v is not null) as evidence_ref, coalesce(string_agg(attribute, ',' order by ord) filter (satisfied is null), '') as unresolved from judged group by 1, 2)
    select rule_id || '@2:' || object_id || ':{JUDGED}' as finding_id, rule_id, '2' as rule_version, 'v7' as ruleset_version, severity, state, object_id, camera_id, evidence_ref, unresolved, reasons, case rule_id when 'head' then 'kitchen' end as label, {JUDGED // 1000} as evaluated_us from found join parts using (rule_id, object_id)""")
def finding_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = _judged(spark, sf_dir)
    held = state.current_attributes(views.attributes(_obs(spark, sf_dir))).select("object_id", F.col("attr_key").alias("attribute"), F.concat(F.lit("ev-"), "attr_key").alias("evidence_ref"))
    meta = spark.createDataFrame([(r, "2", {"place": "kitchen"} if r == "head" else {}) for r in ("head", "dock", "fresh", "ghost")], "rule_id string, rule_version string, labels map<string,string>")
    found = platform.assembled(judged.join(held, ["object_id", "attribute"], "left"), meta, JUDGED, "v7")
    return found.withColumn("label", F.try_element_at("labels", F.lit("place"))).withColumn("evaluated_us", F.unix_micros("evaluated_at")).drop("labels", "evaluated_at")


@query(f"{_RULES_SQL} select rule_id, object_id, case state when 'VIOLATION' then 'open' else 'resolve' end as action from found where state in ('VIOLATION', 'COMPLIANT')")
def incident_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What findings do to incidents: violations open or repeat, compliance resolves, the rest changes nothing."""
    return rules.apply_findings(rules.findings(_judged(spark, sf_dir)), F.lit(JUDGED)).select("rule_id", "object_id", "action")


@query("select o_orderkey as incident_id, case when o_orderstatus = 'F' then 'resolved' when o_orderstatus = 'P' or o_orderkey % 5 = 0 then 'acknowledged' else 'active' end as status, case when o_orderstatus = 'P' then 'before' when o_orderstatus = 'O' and o_orderkey % 5 = 0 then 'clerk' end as acknowledged_by from orders")
def incidents_acknowledged(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    given = o.select(F.col("o_orderkey").alias("incident_id"), F.when(F.col("o_orderstatus") == "F", "resolved").when(F.col("o_orderstatus") == "P", "acknowledged").otherwise("active").alias("status"), F.when(F.col("o_orderstatus") == "P", "before").alias("acknowledged_by"))
    return incidents.acknowledge(given, given.where("incident_id % 5 = 0").select("incident_id"), "clerk").select("incident_id", "status", "acknowledged_by")


_SERIES = "select kind as name, camera_id as c, case when k % 3 = 0 then class_id end as l, k::double as value from obs"


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = F.when(F.col("k") % 3 == 0, F.create_map(F.lit("class"), "class_id", F.lit("camera"), "camera_id")).otherwise(F.create_map(F.lit("camera"), "camera_id"))
    return _obs(spark, sf_dir).select(F.col("kind").alias("name"), labels.alias("labels"), F.col("k").cast("double").alias("value"))


@query(f"select name, max(v) as total from (select name, l is null, sum(value) as v from ({_SERIES}) group by 1, 2) group by 1")
def counter_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return platform.counter_totals(_series(spark, sf_dir))


@query(f""", s as ({_SERIES}), k as (select name, name || '|camera=' || c || case when l is null then '' else ',class=' || l end as key, sum(value) as value from s group by 1, 2), p as (select *, row_number() over (partition by name order by key) as nth from k)
    select name, case when nth <= 10 then key else name || '|overflow' end as key, sum(value) as value from p group by 1, 2""")
def metric_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series by key, with a cap on how many a name may have."""
    return platform.capped_series(_series(spark, sf_dir), 10)


@query(f""", s as ({_SERIES}) select '# TYPE ' || name || ' counter' as line from (select distinct name from s) union all select name || '{{camera="' || c || '"}} ' || cast(cast(sum(value) as bigint) as varchar) as line from s, (select count(*) from obs) group by name, c""")
def openmetrics_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _series(spark, sf_dir)
    heads = s.select(F.concat(F.lit("# TYPE "), "name", F.lit(" counter")).alias("line")).distinct()
    by = s.groupBy("name", F.element_at("labels", F.lit("camera")).alias("c")).agg(F.sum("value").cast("long").cast("string").alias("v"))
    return heads.unionByName(by.select(F.concat("name", F.lit('{camera="'), "c", F.lit('"} '), "v").alias("line")))


@query("""select event_id, array_to_string(list_filter([case when event_id % 97 = 0 then 'negative_uncertainty' end, case when event_id % 31 = 0 then 'supersedes_itself' end, case when event_id % 37 = 0 then 'descends_from_itself' end, case when kind <> 'coverage' and event_id % 11 = 0 then 'no_object' end,
    case when kind = 'coverage' and event_id % 11 > 0 then 'coverage_of_an_object' end, case when kind = 'attribute' and event_id % 7 = 0 then 'no_attribute' end, case when kind in ('presence', 'spatial') and event_id % 13 = 0 then 'no_box' end], lambda x: x is not null), ',') as broken from obs""")
def envelope_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, one = F.col("event_id"), F.col("observation_id")
    broken = platform.violations(F.col("kind"), F.when(e % 11 > 0, F.col("object_id")), F.when(e % 7 > 0, F.col("attr_key")), e % 13 > 0, F.when(e % 31 == 0, one), one, F.when(e % 37 == 0, F.array(one)).otherwise(F.array(F.lit("other"))), F.when(e % 97 == 0, -1).otherwise(5))
    return _obs(spark, sf_dir).select("event_id", F.array_join(broken, ",").alias("broken"))


@query(f"""with d as (select o_orderkey as demand_id, o_custkey % 40 as subscriber, o_orderpriority as content, epoch_us(o_orderdate) as r, epoch_us(o_orderdate) + 86400000000 * (o_orderkey % 700) as x, case when o_orderkey % 6 = 0 then epoch_us(o_orderdate) + 86400000000 * 30 end as w from orders),
    g as (select *, case when w <= 850000000000000 then 'withdrawn' when x <= 850000000000000 then 'expired' end as gone from d) select demand_id, subscriber, coalesce(gone, case when row_number() over (partition by subscriber, content, gone is null order by r, demand_id) = 1 then 'active' else 'duplicate' end) as status from g""")
def demand_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = 86400 * 10**9
    r, k = views.wall_ns(F.col("o_orderdate")), F.col("o_orderkey")
    d = table(spark, sf_dir, "orders").select(k.alias("demand_id"), (F.col("o_custkey") % 40).alias("subscriber"), F.col("o_orderpriority").alias("content"), r.alias("registered_ns"), (r + k % 700 * day).alias("expires_at_ns"), F.when(k % 6 == 0, r + 30 * day).alias("withdrawn_ns"))
    return platform.demand_status(d, 850_000_000_000_000_000)


@query("select event_id, coalesce(lag(k % 3) over (partition by camera_id order by t_ns, event_id) = k % 3, false) as duplicate from obs")
def duplicate_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return platform.duplicate_frames(_obs(spark, sf_dir).withColumn("digest", F.col("k") % 3), "digest").select("event_id", "duplicate")


@query("select camera_id, t_ns // 60000000000 * 60000000000 as window_ns, count(*) as offered, count(*) filter (kind <> 'coverage') as admitted from obs group by 1, 2")
def scheduler_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling minutes of frames offered and admitted."""
    return _obs(spark, sf_dir).groupBy("camera_id", (F.expr("t_ns div 60000000000") * 60_000_000_000).alias("window_ns")).agg(F.count("*").alias("offered"), F.count_if(F.col("kind") != "coverage").alias("admitted"))


@query("select camera_id, event_id, back from (select camera_id, event_id, max(log_position) over (partition by camera_id) - log_position + 1 as back from obs) where back <= 16")
def decision_frame_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest frames of each camera, read off the positions."""
    placed = _log(spark, sf_dir).select("camera_id", "event_id", "log_position")
    last = placed.groupBy("camera_id").agg(F.max("log_position").alias("last"))
    return placed.join(last, "camera_id").select("camera_id", "event_id", (F.col("last") - F.col("log_position") + 1).alias("back")).where("back <= 16")


@query(f"select c_custkey, c_custkey % 40 * 3600 > 86400 as too_large, case when c_custkey % 40 * 3600 > 86400 then null else {START} + c_custkey % 40 * 3600000000000 end as until_ns from customer")
def window_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of more than a day are refused."""
    span = F.col("c_custkey") % 40 * 3600 * 10**9
    return table(spark, sf_dir, "customer").select("c_custkey", (span > views.DAY_NS).alias("too_large"), F.when(span <= views.DAY_NS, F.lit(START) + span).alias("until_ns"))


@query("select class_id, attr_key, count(*) as n, max(t_ns) as last_ns from attrs group by 1, 2")
def capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is produced of which class."""
    return views.attributes(_obs(spark, sf_dir)).groupBy("class_id", "attr_key").agg(F.count("*").alias("n"), F.max("t_ns").alias("last_ns"))


@query(f"select object_id, camera_id from objs where observation_count >= 3 and {NOW} - last_seen_ns <= {15 * views.DAY_NS}")
def registry_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = (F.col("observation_count") >= 3) & (F.lit(NOW) - F.col("last_seen_ns") <= 15 * views.DAY_NS)
    return state.objects(_obs(spark, sf_dir)).where(live).select("object_id", "camera_id")


@query("with s(site, camera_id) as (select 'site-' || (s_suppkey % 4), 'cam-' || s_suppkey from supplier) select camera_id from s where site in ('site-1', 'site-3') or camera_id = 'cam-2'")
def scope_cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cameras of a scope: those of its sites and those it names."""
    k = F.col("s_suppkey")
    cameras = table(spark, sf_dir, "supplier").select(F.concat(F.lit("site-"), k % 4).alias("site"), F.concat(F.lit("cam-"), k).alias("camera_id"))
    return cameras.where(F.col("site").isin("site-1", "site-3") | (F.col("camera_id") == "cam-2")).select("camera_id")


@query("select event_id, 'kind=' || kind || ';camera=' || camera_id || ';value=' || case when k % 4 = 0 then '' else cast(k as varchar) end as wire from obs")
def event_wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event's own fields as text; what is missing stays empty."""
    return _obs(spark, sf_dir).select("event_id", F.concat(F.lit("kind="), "kind", F.lit(";camera="), "camera_id", F.lit(";value="), F.coalesce(F.when(F.col("k") % 4 > 0, F.col("k").cast("string")), F.lit(""))).alias("wire"))
