"""What callers ask: objects, snapshots, coverage, subscriptions, pages, rankings, reports, times and digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from witnesslake.catalog import NOW, START, _attrs, _log, _obs, query
from witnesslake.functions import text
from witnesslake.operators import documents, exposure, state
from witnesslake.sources import views
from witnesslake.sources.views import table

CAMERAS = ["cam-0", "cam-1", "cam-2"]
_IN = "('cam-0', 'cam-1', 'cam-2')"


@query(f"""select 'obj-' || c_custkey as object_id, case when o.object_id is null then 'unknown' when o.camera_id not in {_IN} then 'out_of_scope' else 'found' end as status, case when o.camera_id in {_IN} then o.class_id end as class_id, case when o.camera_id in {_IN} then o.last_seen_ns end as last_seen_ns
    from customer left join objs o on o.object_id = 'obj-' || c_custkey""")
def get_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "customer").select(F.concat(F.lit("obj-"), F.col("c_custkey")).alias("object_id"))
    return exposure.get_objects(asked, state.objects(_obs(spark, sf_dir)).select("object_id", "camera_id", "class_id", "last_seen_ns"), CAMERAS).drop("camera_id")


_PARTS = ", parts as (select camera_id, camera_id <> 'cam-1' as healthy from (select distinct camera_id from objs)), permitted(camera_id) as (values ('cam-0'), ('cam-1'), ('cam-2'), ('cam-9'))"


def _partitions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    objects = state.objects(_log(spark, sf_dir)).select("object_id", "camera_id", "log_position")
    parts = objects.select("camera_id").distinct().withColumn("healthy", F.col("camera_id") != "cam-1")
    return objects, parts, spark.createDataFrame([("cam-0",), ("cam-1",), ("cam-2",), ("cam-9",)], "camera_id string")


@query(f"{_PARTS} select object_id, camera_id, log_position from objs where camera_id in (select camera_id from parts semi join permitted using (camera_id) where healthy)")
def state_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exposure.snapshot(*_partitions(spark, sf_dir))[0]


@query(f"{_PARTS} select camera_id, case when healthy is null then 'missing' else 'degraded' end as why from permitted left join parts using (camera_id) where healthy is null or not healthy")
def snapshot_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exposure.snapshot(*_partitions(spark, sf_dir))[1]


_STATUS = "case c_custkey % 5 when 0 then 'blind' when 1 then 'disconnected' when 2 then 'starved' else 'observing' end"


@query(f"select 't' || (c_nationkey % 3) as tenant_id, count(*) filter (s = 'observing') as observing, count(*) filter (s in ('blind', 'disconnected')) as blind, count(*) filter (s = 'starved') as degraded, round(count(*) filter (s = 'observing') / count(*), 9) as fraction from (select *, {_STATUS} as s from customer) group by 1")
def coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exposure.coverage_summary(table(spark, sf_dir, "customer").select(F.concat(F.lit("t"), F.col("c_nationkey") % 3).alias("tenant_id"), F.expr(_STATUS).alias("status")))


SUBSCRIPTIONS = [{"name": "all"}, {"name": "people", "classes": ["person"], "kinds": ["attribute", "spatial"]}, {"name": "cam1", "cameras": ["cam-1"], "keys": ["a1", "a2"]}, {"name": "lift", "classes": ["vehicle.forklift"], "kinds": ["lifecycle"]}]


@query("""select subscription, observation_id from obs, (values ('all'), ('people'), ('cam1'), ('lift')) s(subscription) where case subscription when 'all' then true when 'people' then (class_id = 'person' or starts_with(class_id, 'person.')) and kind in ('attribute', 'spatial')
    when 'cam1' then camera_id = 'cam-1' and attr_key in ('a1', 'a2') else class_id = 'vehicle.forklift' and kind = 'lifecycle' end""")
def subscription_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exposure.subscribed(_obs(spark, sf_dir), SUBSCRIPTIONS)


@query("select event_id, demand from (select event_id, k from obs), (values ('d1', []), ('d2', ['r1', 'r3']), ('d3', ['r2'])) d(demand, regions) where len(regions) = 0 or list_has_any(regions, ['r' || (k % 4), 'r' || (k % 3)])")
def region_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demands that cover an observation by region; one without regions covers all."""
    held = F.array(F.concat(F.lit("r"), F.col("k") % 4), F.concat(F.lit("r"), F.col("k") % 3))
    wanted = {"d1": [], "d2": ["r1", "r3"], "d3": ["r2"]}
    hits = F.array_compact(F.array(*(F.when(F.lit(not r) | F.arrays_overlap(held, F.array(*map(F.lit, r)).cast("array<string>")), F.lit(d)) for d, r in wanted.items())))
    return _obs(spark, sf_dir).select("event_id", F.explode(hits).alias("demand"))


@query("select object_id, camera_id from objs order by camera_id, object_id limit 500")
def state_query_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.objects(_obs(spark, sf_dir)).select("object_id", "camera_id").orderBy("camera_id", "object_id").limit(500)


@query("select observation_id, t_ns, (select count(*) from obs) as total from obs order by t_ns, observation_id limit 250 offset 1000")
def ledger_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, total = exposure.page(_obs(spark, sf_dir).select("observation_id", "t_ns"), ["t_ns", "observation_id"], 1000, 250)
    return rows.withColumn("total", F.lit(total).cast("long"))


@query("select event_id, kind from (select event_id, kind from obs where event_id > 100 order by event_id desc limit 200)")
def tap_records_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _obs(spark, sf_dir).where("event_id > 100").orderBy(F.desc("event_id")).limit(200).select("event_id", "kind")




@query("""with b as (select s_suppkey as adapter_id, list_distinct(['a' || (s_suppkey % 4), 'a' || (s_suppkey % 3), 'a1']) as produces, s_suppkey % 2 = 0 as remote, s_suppkey % 3 > 0 as deterministic, s_acctbal as cost from supplier),
    r as (select *, 3 - len(list_intersect(produces, ['a0', 'a1', 'a2'])) as missing from b), q as (select *, row_number() over (order by missing, remote, not deterministic, cost, adapter_id) as rank from r),
    f as (select list_intersect(produces, ['a0', 'a1', 'a2']) as needed from q where rank = 1), a as (select adapter_id, rank, missing, rank > 1 and list_has_all(produces, needed) as able from q, f)
    select adapter_id, cast(rank as int) as rank, cast(missing as int) as missing, able and sum(cast(able as int)) over (order by rank) <= 2 as fallback from a""")
def understander_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    produces = F.array_distinct(F.array(F.concat(F.lit("a"), k % 4), F.concat(F.lit("a"), k % 3), F.lit("a1")))
    bound = table(spark, sf_dir, "supplier").select(k.alias("adapter_id"), produces.alias("produces"), (k % 2 == 0).alias("remote"), (k % 3 > 0).alias("deterministic"), F.col("s_acctbal").alias("cost"))
    return exposure.ranked_understanders(bound, ["a0", "a1", "a2"])


@query("select camera_id, object_id, row_number() over (partition by camera_id order by object_id) as nth from objs")
def subjects_by_camera(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.objects(_obs(spark, sf_dir)).select("camera_id", "object_id", F.expr("row_number() over (partition by camera_id order by object_id)").cast("long").alias("nth"))


@query("select object_id, row_number() over (partition by camera_id order by observation_count < 3, last_seen_ns desc, object_id) <= 20 as kept from objs")
def eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provisional objects, seen fewer than three times, are the first to go."""
    objects = state.objects(_obs(spark, sf_dir)).withColumn("provisional", F.col("observation_count") < 3)
    return exposure.evict(objects, 20).select("object_id", "kept")


@query("select object_id, camera_id, row_number() over (partition by camera_id order by first_seen_ns, object_id) as nth from objs where observation_count < 3")
def shed_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    provisional = state.objects(_obs(spark, sf_dir)).where("observation_count < 3")
    return provisional.select("object_id", "camera_id", F.expr("row_number() over (partition by camera_id order by first_seen_ns, object_id)").cast("long").alias("nth"))


@query("""select event_id, array_to_string(list_sort(list_concat(list_filter(a, lambda x: not list_contains(b, x)), list_filter(b, lambda x: not list_contains(a, x)))), ',') as touched from (select event_id, list_distinct(['r' || (k % 4), 'r' || (k % 3)]) as a, list_distinct(['r' || (k % 5), 'r' || (k % 2)]) as b from obs)""")
def touched_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = lambda m, n: F.array(F.concat(F.lit("r"), F.col("k") % m), F.concat(F.lit("r"), F.col("k") % n))
    return _obs(spark, sf_dir).select("event_id", F.array_join(exposure.symmetric_difference(two(4, 3), two(5, 2)), ",").alias("touched"))


@query("select c_custkey, array_to_string(list_sort(list_intersect(['cam-' || (c_custkey % 8), 'cam-' || (c_nationkey % 8), 'cam-1'], ['cam-0', 'cam-1', 'cam-2'])), ',') as cameras from customer")
def scope_narrowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a caller may see of what it asks for."""
    asked = F.array(F.concat(F.lit("cam-"), F.col("c_custkey") % 8), F.concat(F.lit("cam-"), F.col("c_nationkey") % 8), F.lit("cam-1"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(F.array_sort(F.array_intersect(asked, F.array(*map(F.lit, CAMERAS)))), ",").alias("cameras"))


@query("select observation_id from obs where event_id % 3 > 0 and event_id % 5 = 0")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of a batch that the log holds already."""
    obs = _obs(spark, sf_dir)
    return obs.where("event_id % 5 = 0").join(obs.where("event_id % 3 > 0").select("observation_id"), "observation_id", "left_semi").select("observation_id")


@query(f"select object_id, attr_key from held semi join (select object_id from objs where last_seen_ns >= {START + 10 * views.DAY_NS}) using (object_id)")
def retain_only_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = _obs(spark, sf_dir)
    live = state.objects(obs).where(F.col("last_seen_ns") >= START + 10 * views.DAY_NS).select("object_id")
    return state.current_attributes(views.attributes(obs)).join(live, "object_id", "left_semi").select("object_id", "attr_key")


@query("""with t as (select distinct lower(replace(p_type, ' ', '.')) as class_id from part union select distinct lower(split_part(p_type, ' ', 1)) from part), p as (select distinct lower(replace(p_type, ' ', '.')) as class_id from part where p_partkey % 3 = 0 union select 'never.heard')
    select class_id, 'unknown' as status from p where class_id not in (select class_id from t) union all select class_id, case when exists (from p where p.class_id = t.class_id or starts_with(p.class_id, t.class_id || '.')) then 'producible' else 'absent' end from t where class_id <> 'unknown'""")
def taxonomy_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    name = F.lower(F.replace(F.col("p_type"), F.lit(" "), F.lit(".")))
    classes = part.select(name.alias("class_id")).union(part.select(F.split_part(name, F.lit("."), F.lit(1))))
    produced = part.where("p_partkey % 3 = 0").select(name.alias("class_id")).union(spark.createDataFrame([("never.heard",)], "class_id string"))
    return exposure.taxonomy_coverage(classes, produced)


@query("select object_id, array_to_string(list_filter(['a0', 'a3', 'a1', 'a9'], lambda x: not list_contains(coalesce(keys, []), x)), ',') as unsatisfied from (select object_id, (select list(attr_key) from held h where h.object_id = o.object_id) as keys from objs o)")
def unsatisfied_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested keys that an object does not hold, in the order requested."""
    obs = _obs(spark, sf_dir)
    held = state.current_attributes(views.attributes(obs)).groupBy("object_id").agg(F.collect_set("attr_key").alias("keys"))  # a key of the schema once
    left = F.array_except(F.array(*map(F.lit, ("a0", "a3", "a1", "a9"))), F.coalesce("keys", F.array().cast("array<string>")))
    return state.objects(obs).select("object_id").join(held, "object_id", "left").select("object_id", F.array_join(left, ",").alias("unsatisfied"))


@query("select event_id, o.object_id, o.class_id from (select event_id, object_id from obs where kind = 'lifecycle') join objs o using (object_id)")
def lifecycle_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = _obs(spark, sf_dir)
    return obs.where("kind = 'lifecycle'").select("event_id", "object_id").join(state.objects(obs).select("object_id", "class_id"), "object_id").select("event_id", "object_id", "class_id")


@query("select event_id, case when camera_id in ('cam-0', 'cam-1', 'cam-2', 'cam-3') then 'rest-' || (cast(substr(camera_id, 5) as int) % 2) end as restaurant_id from obs")
def camera_restaurant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The restaurant of an enabled camera; others have none."""
    known = spark.createDataFrame([(f"cam-{i}", f"rest-{i % 2}") for i in range(4)], "camera_id string, restaurant_id string")
    return _obs(spark, sf_dir).join(F.broadcast(known), "camera_id", "left").select("event_id", "restaurant_id")


@query("""with recursive m as (select c_custkey as o, c_custkey // 3 as into_ from customer where c_custkey % 4 > 0 and c_custkey >= 3), r as (select o, into_ as s from m union all select r.o, m.into_ from r join m on r.s = m.o)
    select o as object_id, s as survivor from r where s not in (select o from m)""")
def merged_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The object that stands at the end of a chain of merges."""
    merges = table(spark, sf_dir, "customer").where("c_custkey % 4 > 0 and c_custkey >= 3").select(F.col("c_custkey").alias("object_id"), F.expr("c_custkey div 3").alias("merged_into"))
    return exposure.resolved(merges)


@query("""select count(*) as entries, count(*) filter (kind <> 'coverage') as processed, count(*) filter (k % 3 = 0) as measured, count(*) filter (kind = 'presence') as empty, count(*) filter (kind = 'coverage') as errors, sum(k) as total_k, (select count(*) from obs) as total from (select * from obs order by t_ns, observation_id limit 1000)""")
def ledger_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the first thousand entries, as the ledger clamps them; the total is of all."""
    obs = _obs(spark, sf_dir)
    first, total = exposure.page(obs, ["t_ns", "observation_id"], 0, exposure.LEDGER_LIMIT)
    is_ = lambda c: F.count_if(F.expr(c))
    return first.agg(F.count("*").alias("entries"), is_("kind <> 'coverage'").alias("processed"), is_("k % 3 = 0").alias("measured"), is_("kind = 'presence'").alias("empty"), is_("kind = 'coverage'").alias("errors"), F.sum("k").alias("total_k"), F.lit(total).cast("long").alias("total"))


_L = "list_sort(list(l_extendedprice))"


@query(f"select l_shipdate::date as day, count(*) as n, min(l_extendedprice) as least, {_L}[least(count(*), cast(floor(0.5 * count(*)) as bigint) + 1)] as p50, {_L}[least(count(*), cast(floor(0.95 * count(*)) as bigint) + 1)] as p95, max(l_extendedprice) as most from lineitem group by 1")
def histogram_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exposure.summary(table(spark, sf_dir, "lineitem").withColumn("day", F.col("l_shipdate").cast("date")), "day", "l_extendedprice")


@query("select camera_id as label, cast(sum(k) as double) as total from obs where kind = 'attribute' group by 1")
def counter_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A counter summed by the value of one of its labels, kept as a map."""
    series = _obs(spark, sf_dir).select(F.col("kind").alias("name"), F.create_map(F.lit("camera"), "camera_id", F.lit("class"), "class_id").alias("labels"), F.col("k").cast("double").alias("value"))
    return series.where("name = 'attribute'").groupBy(F.element_at("labels", "camera").alias("label")).agg(F.sum("value").alias("total"))


@query("""select kind as name, round(list_sort(list(value))[least(count(*) - 1, cast(floor(0.5 * count(*)) as bigint)) + 1], 6) as p50 from obs join (select kind as q, min(class_id || '/' || camera_id) as s from obs where value is not null group by 1) on q = kind and s = class_id || '/' || camera_id where value is not null group by 1""")
def histogram_p50(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median of each name's first histogram that counted anything; a histogram is a class's on a camera."""
    samples = _obs(spark, sf_dir).select(F.col("kind").alias("name"), F.concat_ws("/", "class_id", "camera_id").alias("series"), "value")
    return exposure.first_medians(samples).select("name", F.round("p50", 6).alias("p50"))


@query("select camera_id, t_ns // 3600000000000 as hour, round(least(4, count(*) / 3600.0::double / 0.0002), 9) as pressure, round(least(1, count(*) / (3600 * 0.0005::double)), 9) as effective_rate from obs group by 1, 2")
def scheduler_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admitted frames an hour against the budget and against what is expected."""
    by = _obs(spark, sf_dir).groupBy("camera_id", F.expr("t_ns div 3600000000000").alias("hour")).agg(F.count("*").alias("n"))
    return by.select("camera_id", "hour", F.round(F.least(F.lit(4.0), F.col("n") / F.lit(3600.0) / F.lit(0.0002)), 9).alias("pressure"), F.round(F.least(F.lit(1.0), F.col("n") / F.lit(3600 * 0.0005)), 9).alias("effective_rate"))


@query("select camera_id, case when observation_count < 3 then 'provisional' when observation_count < 10 then 'active' else 'established' end as lifecycle, count(*) as n, round(count(*) / 512.0::double, 9) as saturation from objs group by 1, 2")
def registry_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    state_of = F.when(F.col("observation_count") < 3, "provisional").when(F.col("observation_count") < 10, "active").otherwise("established")
    return state.objects(_obs(spark, sf_dir)).groupBy("camera_id", state_of.alias("lifecycle")).agg(F.count("*").alias("n"), F.round(F.count("*") / F.lit(512.0), 9).alias("saturation"))


@query("select substr(c_mktsegment, 1, 1) as mode, count(*) as subscriptions, sum(c_custkey % 50) as delivered, sum(c_custkey % 7) as dropped, count(*) filter (c_custkey % 7 > 3) as lagging from customer group by 1")
def hub_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").groupBy(F.substring("c_mktsegment", 1, 1).alias("mode")).agg(F.count("*").alias("subscriptions"), F.sum(k % 50).alias("delivered"), F.sum(k % 7).alias("dropped"), F.count_if(k % 7 > 3).alias("lagging"))


_CLOCK = "case {} % 6 when 0 then 'ptp_locked' when 1 then 'ntp_synced' when 2 then 'rtcp_derived' when 3 then 'estimated' when 4 then 'unknown' else 'sundial' end"
_MS = "case {} % 6 when 0 then 1 when 1 then 10 when 2 then 50 when 3 then 500 else 5000 end"


@query(f"""with t as (select event_id, greatest(event_id * 1000, {_MS.format('event_id')} * 1000000::bigint) as a, greatest(user_id * 1000, {_MS.format('user_id')} * 1000000::bigint) as b, event_id % 6 = 4 or user_id % 6 = 4 as un from events) select event_id, a as uncertainty_ns, not un and a + b <= 600000000 as fusable from t""")
def time_fusability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uncertainty with its floor by clock, and whether an event's two times may be compared within 600 ms."""
    e = table(spark, sf_dir, "events").select("event_id", *(F.expr(_CLOCK.format(c)).alias(f"{n}_clock") for n, c in (("a", "event_id"), ("b", "user_id"))), "user_id")
    e = e.select("event_id", "a_clock", "b_clock", exposure.uncertainty_ns(F.col("event_id") * 1000, F.col("a_clock")).alias("uncertainty_ns"), exposure.uncertainty_ns(F.col("user_id") * 1000, F.col("b_clock")).alias("b"))
    return e.select("event_id", "uncertainty_ns", exposure.fusable(F.col("uncertainty_ns"), F.col("a_clock"), F.col("b"), F.col("b_clock"), 600 * 10**6).alias("fusable"))




@query(f"with t as (select event_id, event_id % 14 between 1 and 12 and event_id % 5 < 4 as good, make_timestamp(2024, cast(greatest(1, least(12, event_id % 14)) as int), 10, cast(event_id % 10 as int), 30, 0) as w from events) select event_id, case when good then epoch_us(w) * 1000 + case event_id % 5 when 1 then -7200000000000 when 2 then 250000000 else 0 end end as ns from t")
def iso_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("2024-"), F.lpad((F.col("event_id") % 14).cast("string"), 2, "0"), F.lit("-10T0"), F.col("event_id") % 10, F.lit(":30:00"), F.expr("case event_id % 5 when 0 then 'Z' when 1 then '+02:00' when 2 then '.250Z' when 3 then '' else ' noon' end"))
    return table(spark, sf_dir, "events").select("event_id", exposure.iso_ns(said).alias("ns"))


@query("select event_id, sha256(concat_ws('|', kind, object_id, class_id, concat_ws(',', cast(floor(x1 * 1000 + 0.5) as bigint), cast(floor(y1 * 1000 + 0.5) as bigint), cast(floor(x2 * 1000 + 0.5) as bigint), cast(floor(y2 * 1000 + 0.5) as bigint)), attr_key || '=' || attr_value)) as digest from obs")
def suppression_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _obs(spark, sf_dir).select("event_id", exposure.content_digest().alias("digest"))


@query("select item_id, sha256(text) as hash, 'sha256:' || sha256(text) as blob_ref, length(sha256(text)) as n from benchmark")
def payload_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payload's hash, its reference and, parsed back from that, the hash's length."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.sha2("text", 256).alias("hash")).withColumn("blob_ref", F.concat(F.lit("sha256:"), "hash"))
    return b.withColumn("n", F.length(F.element_at(F.split("blob_ref", ":", 2), -1)).cast("long"))


@query("select p_partkey, array_to_string(list_filter(regexp_split_to_array(lower(replace(p_name, ' ', '_') || '.' || p_brand), '[_.-]'), lambda t: t <> ''), ',') as tokens from part")
def key_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit("."), F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(documents.key_tokens(key), ",").alias("tokens"))


@query("""with e as (select doc_id % 7 as org, sha256(text) as hash, min(doc_id) as first, count(*) as puts, max(octet_length(encode(text))) as size from documents where text is not null group by 1, 2) select org, hash, first, puts, size, org = 3 as erased from e""")
def evidence_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content-addressed: equal payloads of an organisation are one record; those of an erased scope are tombstones."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    held = docs.groupBy((F.col("doc_id") % 7).alias("org"), F.sha2("text", 256).alias("hash")).agg(F.min("doc_id").alias("first"), F.count("*").alias("puts"), F.max(F.octet_length("text")).cast("long").alias("size"))
    return held.withColumn("erased", F.col("org") == 3)


@query(f"select camera_id, max(t_ns) as since_ns, {NOW} as until_ns, 'restart' as reason from obs group by 1")
def restart_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After a restart each camera was unseen from its last record until now."""
    return _obs(spark, sf_dir).groupBy("camera_id").agg(F.max("t_ns").alias("since_ns")).select("camera_id", "since_ns", F.lit(NOW).alias("until_ns"), F.lit("restart").alias("reason"))


@query("select camera_id, t_ns // 3600000000000 as hour, count(*) as n, string_agg(distinct kind, ',' order by kind) as kinds from obs group by 1, 2")
def audit_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append-only audit rows as counts, with the actions seen."""
    return _obs(spark, sf_dir).groupBy("camera_id", F.expr("t_ns div 3600000000000").alias("hour")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


@query("select object_id, attr_key, substr(attr_value, 1, 3) || case when length(attr_value) > 3 then '…' else '' end as short from held")
def bounded_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.current_attributes(_attrs(spark, sf_dir)).select("object_id", "attr_key", text.bounded(F.col("attr_value"), 3).alias("short"))


