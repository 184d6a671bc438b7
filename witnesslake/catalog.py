"""All queries of the library with their SQL, by name: (spark, sf_dir) to a DataFrame, and DuckDB SQL for the same rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from witnesslake.functions import geometry, text
from witnesslake.operators import attention, evaluation, exposure, incidents, log, ordered, rules, spatial, state
from witnesslake.sources import jsonlog, views
from witnesslake.sources.views import table
from witnesslake.streaming import stateful

QUERIES: dict = {}
ORACLES: dict = {}

#: The start of the event table, and an instant some days later at which state is judged.
START = 1_704_067_200 * 10**9
NOW = START + 20 * views.DAY_NS
WINDOW = (START + views.DAY_NS, START + 8 * views.DAY_NS)

OBS = """
    obs as (select *, t_ns + 86400000000000 as valid_until_ns, row_number() over (partition by camera_id order by t_ns, event_id) as log_position from (
        select event_id, lpad(cast(event_id as varchar), 12, '0') as observation_id, 'cam-' || (user_id % 8) as camera_id, 't' || ((user_id % 8) % 2) as tenant_id, 'obj-' || user_id as object_id,
            (['person', 'person.child', 'vehicle', 'vehicle.forklift'])[user_id % 4 + 1] as class_id,
            case event_type when 'view' then 'presence' when 'click' then 'spatial' when 'purchase' then 'attribute' when 'signup' then 'lifecycle' when 'error' then 'coverage' end as kind,
            epoch_us(ts) * 1000 as t_ns, k, value, cast(k % 10 as double) / 12 as x1, cast(k // 10 as double) / 12 as y1,
            cast(k % 10 as double) / 12 + 0.05::double + least(value, 400.0::double) / 4000 as x2, cast(k // 10 as double) / 12 + 0.1::double as y2,
            'a' || (k % 5) as attr_key, (['worn', 'absent', 'not_visible', 'worn', 'unknown', 'worn'])[k % 6 + 1] as attr_value
        from (select *, cast(regexp_extract(props, '(\\d+)', 1) as int) as k from events))),
    attrs as (select * from obs where kind = 'attribute'),
    held as (select object_id, attr_key, arg_max(attr_value, (t_ns, event_id)) as attr_value, max(t_ns) as observed_at_ns, arg_max(valid_until_ns, (t_ns, event_id)) as valid_until_ns, count(*) as n_seen from attrs group by all),
    objs as (select object_id, camera_id, tenant_id, class_id, min(t_ns) as first_seen_ns, max(t_ns) as last_seen_ns, max(case when kind = 'spatial' then t_ns end) as last_confirmed_ns, count(*) as observation_count, max(log_position) as log_position from obs where kind <> 'coverage' group by all)
"""


def query(sql: str | None = None):  # noqa: ANN201
    """Registers a function as a query, with its SQL after the views."""

    def put(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = f"with {OBS} {sql}" if re.search(r"\b(obs|attrs|held|objs)\b", sql) else sql
        return f

    return put


def _obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.observations(spark, sf_dir).drop("log_position")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observations with their positions."""
    return views.observations(spark, sf_dir)


def _attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.attributes(_obs(spark, sf_dir))


RULES = [
    rules.Rule("head", "high", ("person",), (rules.Condition("a0", "eq", "worn", ("not_visible", "unknown"), guard=True), rules.Condition("a1", "eq", "worn", ("not_visible", "unknown")), rules.Condition("a2", "ne", "absent", ("not_visible",)))),
    rules.Rule("dock", "low", (), (rules.Condition("a3", "in", ("worn", "absent"), ("unknown",)), rules.Condition("a4", "present")), cameras=("cam-1", "cam-2", "cam-3")),
    rules.Rule("fresh", "medium", ("vehicle",), (rules.Condition("a2", "eq", "worn"),), max_staleness_ns=5 * views.DAY_NS, requires=("a3",)),
    rules.Rule("ghost", "critical", ("vehicle.forklift",), (rules.Condition("a9", "eq", "worn"),)),
]
#: Attribute values are judged at this time; held ones are then partly expired.
JUDGED = START + 3 * views.DAY_NS


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = _obs(spark, sf_dir)
    return rules.outcomes(state.objects(obs), state.current_attributes(views.attributes(obs)), RULES, JUDGED)


_V = "(select * from held where object_id = o.object_id and attr_key = '{a}')"
_RULES_SQL = f"""
    , cond(rule_id, severity, cls, cams, ord, attribute, op, vals, unknowns, guard, stale, requires) as (values
        ('head', 'high', 'person', '', 0, 'a0', 'eq', ['worn'], ['not_visible', 'unknown'], true, null, null), ('head', 'high', 'person', '', 1, 'a1', 'eq', ['worn'], ['not_visible', 'unknown'], false, null, null),
        ('head', 'high', 'person', '', 2, 'a2', 'ne', ['absent'], ['not_visible'], false, null, null), ('dock', 'low', '', 'cam-1,cam-2,cam-3', 0, 'a3', 'in', ['worn', 'absent'], ['unknown'], false, null, null),
        ('dock', 'low', '', 'cam-1,cam-2,cam-3', 1, 'a4', 'present', [], [], false, null, null), ('fresh', 'medium', 'vehicle', '', 0, 'a2', 'eq', ['worn'], [], false, {5 * views.DAY_NS}, 'a3'), ('ghost', 'critical', 'vehicle.forklift', '', 0, 'a9', 'eq', ['worn'], [], false, null, null)),
    pairs as (select o.object_id, o.camera_id, o.class_id, c.* from objs o join cond c on (c.cls = '' or o.class_id = c.cls or starts_with(o.class_id, c.cls || '.')) and (c.cams = '' or list_contains(string_split(c.cams, ','), o.camera_id))),
    outs as (select p.*, h.attr_value as v, case
            when p.op = 'present' then null when h.attr_value is null then 'ATTRIBUTE_ABSENT' when list_contains(p.unknowns, h.attr_value) then 'NOT_OBSERVABLE'
            when {JUDGED} > h.valid_until_ns or (p.stale is not null and {JUDGED} - h.observed_at_ns > p.stale) then 'ATTRIBUTE_STALE'
            when p.requires is not null and (r.attr_value is null or {JUDGED} > r.valid_until_ns or {JUDGED} - r.observed_at_ns > p.stale) then 'EVIDENCE_UNVERIFIED' end as reason
        from pairs p left join held h on h.object_id = p.object_id and h.attr_key = p.attribute left join held r on r.object_id = p.object_id and r.attr_key = p.requires),
    judged as (select *, case when op = 'present' then v is not null when reason is not null then null when op = 'ne' then not list_contains(vals, v) else list_contains(vals, v) end as satisfied from outs),
    found as (select rule_id, severity, object_id, camera_id, case when bool_or(guard and satisfied = false) then 'NOT_APPLICABLE' when bool_or(guard and satisfied is null) then 'UNKNOWN' when bool_or(not guard and satisfied = false) then 'VIOLATION' when bool_or(not guard and satisfied is null) then 'UNKNOWN' else 'COMPLIANT' end as state,
        count(*) filter (satisfied = false) as n_failed, count(*) filter (satisfied is null) as n_unknown, coalesce(string_agg(distinct reason, ',' order by reason), '') as reasons from judged group by all)
"""


@query(f"{_RULES_SQL} select rule_id, state, count(*) as n from found group by all")
def findings_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.findings(_judged(spark, sf_dir)).groupBy("rule_id", "state").agg(F.count("*").alias("n"))


@query(f"{_RULES_SQL} select * from found")
def findings_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.findings(_judged(spark, sf_dir))


@query(f"{_RULES_SQL} select rule_id, attribute, coalesce(reason, case when satisfied then 'held' else 'failed' end) as outcome, count(*) as n from judged group by all")
def condition_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).groupBy("rule_id", "attribute", F.coalesce("reason", F.when(F.col("satisfied"), "held").otherwise("failed")).alias("outcome")).agg(F.count("*").alias("n"))


@query("select 'ghost' as rule_id, 'a9' as attribute from attrs having count(*) filter (attr_key = 'a9') = 0")
def rule_unproducible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.unproducible(spark, RULES, _attrs(spark, sf_dir)).select("rule_id", "attribute")


@query("select * from objs")
def state_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.objects(_log(spark, sf_dir)).drop("box")


@query("select * from held")
def attributes_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.current_attributes(_attrs(spark, sf_dir))


@query("select object_id, depth, t_ns, round((x1 + x2) / 2, 9) as x, round(y2, 9) as y from (select *, row_number() over (partition by object_id order by t_ns desc, event_id desc) as depth from obs where kind = 'spatial') where depth <= 64")
def trajectory_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.trajectory_ring(_obs(spark, sf_dir)).select("object_id", "depth", "t_ns", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


@query("select object_id, attr_key, back - 1 as depth, attr_value, t_ns from (select *, row_number() over (partition by object_id, attr_key order by t_ns desc) as back from (select distinct on (object_id, attr_key, t_ns) * from attrs order by object_id, attr_key, t_ns, log_position desc)) where back between 2 and 9")
def attribute_history_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.attribute_ring(views.attributes(_log(spark, sf_dir)))


@query("select object_id, depth, before, attr_value, t_ns from (select *, row_number() over (partition by object_id order by t_ns desc, event_id desc) as depth from (select *, lag(attr_value) over (partition by object_id order by t_ns, event_id) as before from attrs) where before is null or before <> attr_value) where depth <= 16")
def value_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.value_changes(_attrs(spark, sf_dir))


@query(f"select object_id, class_id, last_seen_ns from objs where (class_id = 'person' or starts_with(class_id, 'person.')) and camera_id in ('cam-0', 'cam-1', 'cam-5') and last_seen_ns >= {START + 10 * views.DAY_NS}")
def state_query_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = state.objects(_obs(spark, sf_dir)).where(log.covers(["person"], F.col("class_id")) & F.col("camera_id").isin("cam-0", "cam-1", "cam-5") & (F.col("last_seen_ns") >= START + 10 * views.DAY_NS))
    return found.select("object_id", "class_id", "last_seen_ns")


@query("select object_id from objs where object_id in (select object_id from held where attr_key = 'a1' and attr_value = 'worn') and object_id not in (select object_id from held where attr_key = 'a2' and attr_value = 'absent')")
def attribute_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = _obs(spark, sf_dir)
    held = state.current_attributes(views.attributes(obs)).cache()
    have, without = held.where("attr_key = 'a1' and attr_value = 'worn'"), held.where("attr_key = 'a2' and attr_value = 'absent'")
    return state.objects(obs).select("object_id").join(have, "object_id", "left_semi").join(without, "object_id", "left_anti")


@query("select observation_id, t_ns from obs where kind in ('attribute', 'spatial') and starts_with(class_id, 'person') and attr_key in ('a1', 'a2')")
def history_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _obs(spark, sf_dir).where(log.history_filter(["attribute", "spatial"], ["person"], ["a1", "a2"])).select("observation_id", "t_ns")


@query("select observation_id, camera_id, log_position from obs where camera_id = 'cam-3' and log_position >= 10 and log_position < 200")
def log_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.range_scan(_log(spark, sf_dir), "cam-3", 10, 200).select("observation_id", "camera_id", "log_position")


@query("select observation_id, t_ns from obs order by t_ns, observation_id limit 100")
def history_page_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.page_after(_obs(spark, sf_dir), None, 100).select("observation_id", "t_ns")


@query("select observation_id, t_ns from obs order by t_ns, observation_id limit 100 offset 100")
def history_page_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = _obs(spark, sf_dir)
    last = log.page_after(obs, None, 100).agg(F.max(F.struct("t_ns", "observation_id")).alias("c")).first().c
    return log.page_after(obs, (last.t_ns, last.observation_id), 100).select("observation_id", "t_ns")


@query("select object_id, observation_id, back from (select *, row_number() over (partition by object_id order by t_ns desc, observation_id desc) as back from obs) where back <= 5")
def history_of_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.last_of_object(_obs(spark, sf_dir), 5).select("object_id", "observation_id", "back")


@query("select camera_id, observation_id, coalesce(last, 0) + row_number() over (partition by camera_id order by t_ns, observation_id) as log_position from obs left join (select camera_id, max(log_position) as last from obs where event_id % 3 > 0 group by 1) using (camera_id) where event_id % 3 = 0")
def idempotent_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch that repeats some of the log, and itself."""
    obs = _log(spark, sf_dir)
    batch = obs.where("event_id % 3 = 0 or event_id % 5 = 0")
    return log.append_idempotent(obs.where("event_id % 3 > 0"), batch.unionByName(batch)).select("camera_id", "observation_id", "log_position")


@query(f"select observation_id from obs where t_ns >= {START + 5 * views.DAY_NS}")
def log_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.truncate_prefix(_log(spark, sf_dir), START + 5 * views.DAY_NS).select("observation_id")


@query("select camera_id, count(*) as n from obs where event_id not in (select event_id - 7 from obs where event_id % 50 = 7) group by 1")
def superseded_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = _obs(spark, sf_dir)
    corrections = obs.where("event_id % 50 = 7").select(F.lpad((F.col("event_id") - 7).cast("string"), 12, "0").alias("supersedes"))
    return log.without_superseded(obs, corrections).groupBy("camera_id").agg(F.count("*").alias("n"))


@query("""select camera_id, sha256(string_agg(d, chr(10) order by run)) as digest, count(*) as n_runs from (select camera_id, (log_position - 1) // 256 as run, sha256(string_agg(concat_ws('|', observation_id, kind, cast(t_ns as varchar), object_id, class_id), chr(10) order by log_position)) as d from obs group by 1, 2) group by 1""")
def log_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.digest_by_camera(_log(spark, sf_dir))


_GAPS = f"""
    , edges as (select *, lag(blind) over (partition by camera_id order by t_ns, event_id) as before from (select camera_id, t_ns, event_id, kind = 'coverage' as blind from obs)),
    spans as (select camera_id, t_ns, blind, lead(t_ns) over (partition by camera_id order by t_ns, event_id) as u from edges where before is null or before <> blind),
    gaps as (select camera_id, greatest(t_ns, {WINDOW[0]}) as since_ns, least(coalesce(u, {WINDOW[1]}), {WINDOW[1]}) as until_ns from spans where blind),
    clipped as (select * from gaps where until_ns > since_ns)
"""


@query(f"{_GAPS} select * from clipped")
def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.coverage_gaps(_obs(spark, sf_dir), *WINDOW)


@query(f"{_GAPS} select c.camera_id, round(1 - coalesce(sum(until_ns - since_ns), 0)::double / {WINDOW[1] - WINDOW[0]}, 9) as fraction from (select distinct camera_id from obs) c left join clipped using (camera_id) group by 1")
def coverage_window_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.coverage_fraction(_obs(spark, sf_dir), *WINDOW)


@query(f", last as (select camera_id, tenant_id, arg_max(kind, (t_ns, event_id)) as kind, max(t_ns) as seen from obs group by all) select tenant_id, count(*) filter (kind <> 'coverage') as observing, count(*) filter (kind = 'coverage') as blind, round(count(*) filter (kind <> 'coverage')::double / count(*), 9) as fraction, max({NOW} - seen) as max_lag_ns from last group by 1")
def coverage_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = _obs(spark, sf_dir).groupBy("camera_id", "tenant_id").agg(F.max_by("kind", F.struct("t_ns", "event_id")).alias("kind"), F.max("t_ns").alias("at"))
    seeing = F.count_if(F.col("kind") != "coverage")
    return last.groupBy("tenant_id").agg(seeing.alias("observing"), F.count_if(F.col("kind") == "coverage").alias("blind"), F.round(seeing / F.count("*"), 9).alias("fraction"), F.max(F.lit(NOW) - F.col("at")).alias("max_lag_ns"))


@query("select tenant_id, camera_id, count(distinct object_id) as n_objects, count(*) as n_observations from obs group by all")
def site_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _obs(spark, sf_dir).groupBy("tenant_id", "camera_id").agg(F.countDistinct("object_id").alias("n_objects"), F.count("*").alias("n_observations"))


@query("select camera_id, observation_id, lag(observation_id) over w as previous, lead(observation_id) over w as next from obs window w as (partition by camera_id order by t_ns, observation_id)")
def frame_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.frame_neighbours(_obs(spark, sf_dir))


def _polygon(name: str) -> str:
    """The ray-casting test of a region on (px, py), written out edge by edge."""
    vs = views.REGIONS[name]
    parts = [f"(case when ({y1}::double > py) <> ({y2}::double > py) and px < ({x2}::double - {x1}::double) * (py - {y1}::double) / ({y2}::double - {y1}::double) + {x1}::double then 1 else 0 end)" for (x2, y2), (x1, y1) in zip(vs, vs[-1:] + vs[:-1], strict=True) if y1 != y2]
    return f"({' + '.join(parts)}) % 2 = 1"


_INSIDE = ", pts as (select *, (x1 + x2) / 2 as px, y2 as py from obs where kind = 'spatial'), inside as (" + " union all ".join(f"select '{r}' as region_id, * from pts where {_polygon(r)}" for r in views.REGIONS) + ")"


@query(f"{_INSIDE} select region_id, observation_id from inside")
def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.in_regions(_obs(spark, sf_dir).where("kind = 'spatial'"), views.regions(spark)).select("region_id", "observation_id")


@query(f"""{_INSIDE}, stay as (select region_id, object_id, min(t_ns) as first from inside group by all) select r.region_id, count(object_id) as n_objects, coalesce(max({NOW} - first), 0) as max_dwell_ns, coalesce(cast(floor(avg(({NOW} - first)::double / 1000000000)) as bigint), 0) as mean_dwell_s from (values {", ".join(f"('{r}')" for r in views.REGIONS)}) r(region_id) left join stay using (region_id) group by 1""")
def region_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = views.regions(spark)
    return spatial.occupancy(spatial.in_regions(_obs(spark, sf_dir).where("kind = 'spatial'"), regions), regions, NOW)


@query(f"""{_INSIDE}, marked as (select object_id, t_ns, observation_id, observation_id in (select observation_id from inside where region_id = 'dock') as inside from pts), edges as (select *, lag(inside) over (partition by object_id order by t_ns, observation_id) as before from marked),
    turns as (select object_id, inside, t_ns, lead(t_ns) over (partition by object_id order by t_ns, observation_id) as exit_ns from edges where inside <> coalesce(before, false)) select object_id, t_ns as enter_ns, exit_ns, exit_ns - t_ns as dwell_ns from turns where inside""")
def region_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.region_visits(_obs(spark, sf_dir).where("kind = 'spatial'"), views.regions(spark), "dock")


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    obs = _obs(spark, sf_dir).withColumn("ref", F.col("observation_id"))
    return obs.where("kind = 'attribute'"), obs.where("kind = 'presence'")


_ASOF = "select a.camera_id, a.t_ns, a.observation_id as ref, {} as found_ref from (select * from obs where kind = 'attribute') a asof left join (select camera_id, t_ns, max(observation_id) as observation_id from obs where kind = 'presence' group by all) p on a.camera_id = p.camera_id and a.t_ns >= p.t_ns"


@query(_ASOF.format("case when a.t_ns - p.t_ns <= 600000000000 then p.observation_id end"))
def nearest_before_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.as_of(*_sides(spark, sf_dir), ["camera_id"], 600 * 10**9)


@query(_ASOF.format("p.observation_id"))
def nearest_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.as_of(*_sides(spark, sf_dir), ["camera_id"], None)


@query("select object_id, camera_id, arg_max(observation_id, (t_ns, observation_id)) as ref from obs group by 1, 2")
def latest_for_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _obs(spark, sf_dir).groupBy("object_id", "camera_id").agg(F.max_by("observation_id", F.struct("t_ns", "observation_id")).alias("ref"))


_PAIR = "select a.observation_id as a_id, b.observation_id as b_id, a.x1 as ax1, a.y1 as ay1, a.x2 as ax2, a.y2 as ay2, b.x1 as bx1, b.y1 as by1, b.x2 as bx2, b.y2 as by2 from obs a join obs b on a.camera_id = b.camera_id and b.log_position = a.log_position + 1"


@query(f""", pair as ({_PAIR}), m as (select *, greatest(least(ax2, bx2) - greatest(ax1, bx1), 0) * greatest(least(ay2, by2) - greatest(ay1, by1), 0) as i, (ax2 - ax1) * (ay2 - ay1) as p, (bx2 - bx1) * (by2 - by1) as q from pair)
    select a_id, b_id, round(i / (p + q - i), 6) as iou, round(least(1, sqrt(pow((ax1 + ax2 - bx1 - bx2) / 2, 2) + pow((ay1 + ay2 - by1 - by2) / 2, 2)) / sqrt(2)), 6) as distance, round(1 - least(p, q) / greatest(p, q), 6) as penalty from m""")
def box_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each box with its camera's next."""
    box = F.struct("observation_id", "x1", "y1", "x2", "y2")
    beside = ordered.neighbours(_obs(spark, sf_dir).select("camera_id", "t_ns", "event_id", box.alias("box")), "camera_id", "event_id", "box").where("next is not null")
    pairs = beside.select("box.observation_id", F.col("next.observation_id").alias("b_id"), *(F.col(f"{of}.{c}").alias(f"{side}{c}") for side, of in (("a", "box"), ("b", "next")) for c in ("x1", "y1", "x2", "y2")))
    return pairs.select(F.col("observation_id").alias("a_id"), "b_id", F.round(geometry.iou("a", "b"), 6).alias("iou"), F.round(geometry.centre_distance("a", "b"), 6).alias("distance"), F.round(geometry.scale_penalty("a", "b"), 6).alias("penalty"))


@query("select camera_id, observation_id, round(case when x2 > 1 or y2 > 1 then 1 - (greatest(least(x2, 1) - x1, 0) * greatest(least(y2, 1) - y1, 0)) / ((x2 - x1) * (y2 - y1)) else 0 end, 6) as truncation from obs")
def truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _obs(spark, sf_dir).select("camera_id", "observation_id", F.round(F.abs(geometry.truncation(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))), 6).alias("truncation"))


@query("select event_id as t, case when value <= 0 then 'no_area' when value < 48 then 'too_small' when (k % 11) / 10.0 > 0.5 then 'truncated' when (k % 7) / 6.0 > 0.7 then 'occluded' when (k % 13) / 12.0 > 0.85 then 'blurred' else 'pass' end as reason from obs")
def quality_gate_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = _obs(spark, sf_dir).select(F.col("event_id").alias("t"), "value", *((F.col("k") % (n + 1) / n).alias(c) for c, n in (("tr", 10), ("oc", 6), ("bl", 12))))
    return graded.select("t", evaluation.quality_reason(F.col("value"), F.col("tr"), F.col("oc"), F.lit(None).cast("double"), F.col("bl"), F.lit(None).cast("string"), F.lit(None).cast("string")).alias("reason"))


_PAIRS = "select 'quality' as attribute, case quality when 1 then 'PRESENT' else 'ABSENT' end as truth, case when doc_id % 13 = 0 then null when n_chars > 900 then 'PRESENT' when doc_id % 7 = 0 then 'UNKNOWN' else 'ABSENT' end as predicted, source from labels join documents using (doc_id)"
STATES = ("PRESENT", "ABSENT", "NOT_VISIBLE", "UNKNOWN")


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source"), "doc_id")
    predicted = F.when(F.col("doc_id") % 13 == 0, None).when(F.col("n_chars") > 900, "PRESENT").when(F.col("doc_id") % 7 == 0, "UNKNOWN").otherwise("ABSENT")
    return both.select(F.lit("quality").alias("attribute"), F.when(F.col("quality") == 1, "PRESENT").otherwise("ABSENT").alias("truth"), predicted.alias("predicted"), "source")


@query(f"select attribute, truth, coalesce(predicted, '<none>') as predicted, count(*) as n from ({_PAIRS}) group by all")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.confusion(_labelled(spark, sf_dir))


@query(f"""select attribute, state, tp, support, round(tp / nullif(n, 0), 9) as precision, round(tp / nullif(support, 0), 9) as recall, round(2 * (tp / nullif(n, 0)) * (tp / nullif(support, 0)) / nullif(tp / nullif(n, 0) + tp / nullif(support, 0), 0), 9) as f1
    from (select attribute, state, count(*) filter (truth = state and predicted = state) as tp, count(*) filter (predicted = state) as n, count(*) filter (truth = state) as support from ({_PAIRS}), (values ('PRESENT'), ('ABSENT'), ('NOT_VISIBLE'), ('UNKNOWN')) s(state) group by all)""")
def prf_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.scores(_labelled(spark, sf_dir), STATES)


@query("select side, count(*) as n, count(distinct source) as n_groups from (select *, case when source in ('src1', 'src2') then 'test' when source in ('src3') then 'validation' else 'train' end as side from documents) group by 1")
def dataset_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = evaluation.split_sides(table(spark, sf_dir, "documents").select("source"), "source", ["src1", "src2"], ["src3"])
    return sides.groupBy("side").agg(F.count("*").alias("n"), F.countDistinct("source").alias("n_groups"))


@query("select object_id, class_id, share from (select *, row_number() over (partition by object_id order by round(w, 9) desc, class_id) as r, round(w / nullif(sum(w) over (partition by object_id), 0), 6) as share from (select l_partkey as object_id, l_returnflag as class_id, sum(greatest(l_discount, 0)) as w from lineitem group by all)) where r = 1")
def class_distribution_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.best_class(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("object_id"), F.col("l_returnflag").alias("class_id"), F.col("l_discount").alias("weight")))


_P = "list_sort(list(value))"


@query(f"select event_type, count(*) as n, min(value) as least, {_P}[least(count(*), cast(floor(0.5 * count(*)) as bigint) + 1)] as p50, {_P}[least(count(*), cast(floor(0.95 * count(*)) as bigint) + 1)] as p95, max(value) as most from events group by 1")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact index rule; only the values of the ranges that hold the ranks are sorted."""
    return exposure.summary(table(spark, sf_dir, "events"), "event_type", "value")


@query("select 't' || (c_nationkey % 2) as organization_id, count(*) as n from customer group by 1")
def camera_count_by_tenant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy(F.concat(F.lit("t"), F.col("c_nationkey") % 2).alias("organization_id")).agg(F.count("*").alias("n"))


_INCIDENT = "select o_orderkey as event_id, o_custkey % 10 as org, o_custkey as subject, substr(o_orderpriority, 1, 1) as rule_id, o_orderdate as tm, case o_orderstatus when 'F' then 'resolve' else 'open' end as action from orders"


@query(f"""with e as ({_INCIDENT}), r as (select *, coalesce(sum(case when action = 'resolve' then 1 else 0 end) over (partition by org, subject, rule_id order by tm, event_id rows between unbounded preceding and 1 preceding), 0) as run from e)
    select org, subject, rule_id, min(tm) filter (action = 'open') as opened_at, max(tm) filter (action = 'open') as observed_at, count(*) filter (action = 'open') as n_opens, max(tm) filter (action = 'resolve') as resolved_at, case when count(*) filter (action = 'resolve') > 0 then 'resolved' else 'active' end as status from r group by org, subject, rule_id, run having count(*) filter (action = 'open') > 0""")
def incidents_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    events = o.select(F.col("o_orderkey").alias("event_id"), (F.col("o_custkey") % 10).alias("org"), F.col("o_custkey").alias("subject"), F.substring("o_orderpriority", 1, 1).alias("rule_id"), F.col("o_orderdate").alias("at"), F.when(F.col("o_orderstatus") == "F", "resolve").otherwise("open").alias("action"))
    return incidents.fold_incidents(events)


@query("select o_orderkey, case o_orderstatus when 'F' then 'resolved' when 'O' then 'active' else 'acknowledged' end as status from orders where not (o_orderstatus = 'F' and o_orderdate < timestamp '1997-01-01')")
def retention_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("at"), F.when(F.col("o_orderstatus") == "F", "resolved").when(F.col("o_orderstatus") == "O", "active").otherwise("acknowledged").alias("status"))
    return incidents.retention(o, "1997-01-01").select("o_orderkey", "status")


@query("select status, count(*) as n, cast(sum(size) as double) as bytes from (select l_quantity as size, case when l_orderkey % 50 = 0 then 'ERASED' when l_shipdate < timestamp '1994-01-01' then 'EXPIRED' when l_quantity <= 0 then 'NOT_FOUND' else 'STORED' end as status from lineitem) group by 1")
def evidence_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ref"), F.col("l_quantity").alias("size"), (F.col("l_shipdate") < F.lit("1994-01-01").cast("timestamp_ntz")).alias("expired"))
    gone = table(spark, sf_dir, "orders").where("o_orderkey % 50 = 0").select(F.col("o_orderkey").alias("ref"))
    return incidents.evidence_status(records, gone).groupBy("status").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query("select o_orderkey, o_orderdate from orders order by o_orderdate desc, o_orderkey limit 200")
def audit_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(200)


@query("select camera_id, max(total) as total from (select camera_id, kind, sum(value) as total from (select camera_id, kind, round(value * 100) as value from obs) group by 1, 2) group by 1")
def counter_total_max_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = _obs(spark, sf_dir).groupBy("camera_id", "kind").agg(F.sum(F.round(F.col("value") * 100)).alias("total"))
    return by.groupBy("camera_id").agg(F.max("total").alias("total"))


@query("select doc_id, case when lower(trim(source)) = 'src0' then 'NOT_VISIBLE' when lower(trim(source)) = 'src1' then 'UNKNOWN' else 'PRESENT' end as state, replace(source || '/' || lang, '/', '_') as safe, length(text) > 255 as cut from documents")
def answer_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("source") == "src0", " Not_Visible ").when(F.col("source") == "src1", "UNKNOWN").otherwise(F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", text.state_of_answer(raw).alias("state"), text.path_safe(F.concat_ws("/", "source", "lang")).alias("safe"), (F.length(text.bounded(F.col("text"))) == 256).alias("cut"))


@query("select event_id, epoch_us(ts) // 1000 as ms from events")
def ulid_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = table(spark, sf_dir, "events").select("event_id", views.wall_ns(F.col("ts")).alias("ns"))
    return timed.select("event_id", text.ulid_ms(text.ulid_of(F.expr("ns div 1000000"), F.col("event_id"))).alias("ms"))


@query(""", lost as (select object_id || '/' || attr_key as id, arg_max(attr_value, (t_ns, event_id)) as a, max(t_ns) as b, arg_max(valid_until_ns, (t_ns, event_id)) as c from attrs where event_id % 17 > 0 group by 1),
    j as (select coalesce(x.id, y.id) as id, x.id is null or y.id is null as one_side, x.a as xa, y.a as ya, x.b as xb, y.b as yb, x.c as xc, y.c as yc from (select object_id || '/' || attr_key as id, attr_value as a, observed_at_ns as b, valid_until_ns as c from held) x full join lost y on x.id = y.id)
    select id, 'presence' as field from j where one_side union all select id, 'attr_value' from j where xa is distinct from ya union all select id, 'observed_at_ns' from j where xb is distinct from yb union all select id, 'valid_until_ns' from j where xc is distinct from yc""")
def live_vs_replay_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State folded from the whole log against state replayed from one that lost rows: where they differ."""
    attrs, key = _attrs(spark, sf_dir), F.concat_ws("/", "object_id", "attr_key")
    live, replayed = (state.current_attributes(a).withColumn("id", key) for a in (attrs, attrs.where("event_id % 17 > 0")))
    return state.differences(live, replayed, "id", ["attr_value", "observed_at_ns", "valid_until_ns"])


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _obs(spark, sf_dir).where("kind = 'attribute'").select(F.concat_ws("/", "object_id", "attr_key").alias("subject"), "t_ns", F.col("event_id").alias("ordinal"), F.col("attr_value").alias("digest"))


@query("select subject, count(*) as n from (select object_id || '/' || attr_key as subject, attr_value, lag(attr_value) over (partition by object_id, attr_key order by t_ns, event_id) as before from attrs) where before is null or before <> attr_value group by 1")
def suppression_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a heartbeat, what is published is what differs from the fact before."""
    return stateful.suppress(_facts(spark, sf_dir), 1 << 62).groupBy("subject").agg(F.count("*").alias("n"))


@query(f"""select subject, t_ns, ordinal from (with recursive f as (select object_id || '/' || attr_key as subject, t_ns, event_id as ordinal, attr_value as digest, row_number() over (partition by object_id, attr_key order by t_ns, event_id) as rn from attrs),
    r as (select subject, rn, t_ns, ordinal, t_ns as last, digest, true as sent from f where rn = 1 union all select subject, rn, t_ns, ordinal, case when sends then t_ns else last end, case when sends then now else held end, sends from (
        select f.subject, f.rn, f.t_ns, f.ordinal, r.last, r.digest as held, f.digest as now, f.digest <> r.digest or f.t_ns - r.last >= {views.DAY_NS} as sends from r join f on f.subject = r.subject and f.rn = r.rn + 1)) select * from r where sent)""")
def suppression_heartbeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stateful.suppress(_facts(spark, sf_dir), views.DAY_NS)


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _obs(spark, sf_dir).select("camera_id", "t_ns", F.col("event_id").alias("ordinal"), (F.col("k") % 3 == 0).alias("failed"))


@query("""select camera_id, t_ns, ordinal from (with recursive f as (select camera_id, t_ns, event_id as ordinal, k % 3 = 0 as failed, row_number() over (partition by camera_id order by t_ns, event_id) as rn from obs), r as (select camera_id, rn, t_ns, ordinal, t_ns as last, true as kept from f where rn = 1 union all select f.camera_id, f.rn, f.t_ns, f.ordinal, case when f.t_ns - r.last >= 2000000000000 then f.t_ns else r.last end, f.t_ns - r.last >= 2000000000000 from r join f on f.camera_id = r.camera_id and f.rn = r.rn + 1) select * from r where kept)""")
def frame_sampler(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stateful.sample_frames(_frames(spark, sf_dir), 0.0005)


@query("""select camera_id, t_ns, ordinal from (with recursive f as (select camera_id, t_ns, event_id as ordinal, k % 3 = 0 as failed, row_number() over (partition by camera_id order by t_ns, event_id) as rn from obs), r as (select camera_id, rn, t_ns, ordinal, t_ns as since, 2.0 as tokens, true as kept from f where rn = 1
        union all select camera_id, rn, t_ns, ordinal, since, case when tokens >= 1 then tokens - 1 else tokens end, tokens >= 1 from (select f.camera_id, f.rn, f.t_ns, f.ordinal, r.since + w * 3600000000000 as since, case when w > 0 then least(3.0, r.tokens + w * 3.0) else r.tokens end as tokens from r join f on f.camera_id = r.camera_id and f.rn = r.rn + 1, lateral (select (f.t_ns - r.since) // 3600000000000 as w)))
    select * from r where kept)""")
def token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stateful.token_bucket(_frames(spark, sf_dir), 3, 3600 * 10**9)


@query("""select camera_id, t_ns, ordinal, passed from (with recursive f as (select camera_id, t_ns, event_id as ordinal, k % 3 = 0 as failed, row_number() over (partition by camera_id order by t_ns, event_id) as rn from obs), r as (select camera_id, rn, t_ns, ordinal, [t_ns] as held, true as passed from f where rn = 1
        union all select camera_id, rn, t_ns, ordinal, case when len(held) < 20 then list_append(held, t_ns) else held end, len(held) < 20 from (select f.camera_id, f.rn, f.t_ns, f.ordinal, list_filter(r.held, lambda x: x > f.t_ns - 86400000000000) as held from r join f on f.camera_id = r.camera_id and f.rn = r.rn + 1))
    select * from r)""")
def rate_limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stateful.rate_limited(_frames(spark, sf_dir), 20, views.DAY_NS)


@query("""select camera_id, t_ns, ordinal, passed from (with recursive f as (select camera_id, t_ns, event_id as ordinal, k % 3 = 0 as failed, row_number() over (partition by camera_id order by t_ns, event_id) as rn from obs), r as (select camera_id, rn, t_ns, ordinal, cast(failed as int) as failures, cast(0 as bigint) as open_until, true as passed from f where rn = 1
        union all select camera_id, rn, t_ns, ordinal, case when not through then failures when n >= 3 then 0 else n end, case when through and n >= 3 then t_ns + 7200000000000 else open_until end, through from (select f.camera_id, f.rn, f.t_ns, f.ordinal, r.failures, r.open_until, f.t_ns >= r.open_until as through, case when f.failed then r.failures + 1 else 0 end as n from r join f on f.camera_id = r.camera_id and f.rn = r.rn + 1))
    select * from r)""")
def circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stateful.breaker(_frames(spark, sf_dir), 3, 7200 * 10**9)


@query()
def overlap_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _log(spark, sf_dir).select(F.concat_ws("/", "camera_id", F.floor(F.col("log_position") / 25)).alias("frame"), F.col("event_id").alias("det_index"), "class_id", F.col("value").alias("score"), "x1", "y1", "x2", "y2")
    return spatial.suppress_overlaps(found)


@query()
def greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _log(spark, sf_dir).select(F.concat_ws("/", "camera_id", F.floor(F.col("log_position") / 40)).alias("frame"), F.col("observation_id").alias("subject"), "x1", "y1", "x2", "y2", "kind")
    return spatial.greedy_match(boxes.where("kind = 'spatial'").drop("kind"), boxes.where("kind = 'presence'").drop("kind"))


_APART = "sqrt(pow(l.x - s.x, 2) + pow(l.y - s.y, 2))"


@query(f""", cut as (select object_id, camera_id, class_id, t_ns, (x1 + x2) / 2 as x, y2 as y, t_ns - lag(t_ns) over w as since, lead(t_ns) over w - t_ns as until from obs window w as (partition by object_id order by t_ns, event_id)),
    p as (select s.object_id, l.object_id as lost_id, s.t_ns as first_ns, {_APART} as d, (1 - {_APART} / 0.25::double) * (1 - (s.t_ns - l.t_ns)::double / {views.DAY_NS // 4}) as score
        from cut l join cut s on l.camera_id = s.camera_id and l.class_id = s.class_id and l.object_id <> s.object_id and s.t_ns > l.t_ns and s.t_ns - l.t_ns <= {views.DAY_NS // 4} where coalesce(l.until > {views.DAY_NS}, true) and coalesce(s.since > {views.DAY_NS}, true)),
    r as (select *, row_number() over o as rank, score - lead(score) over o as margin from p where d <= 0.25 and score >= 0.3 window o as (partition by object_id, first_ns order by score desc, lost_id))
    select object_id, first_ns, case when not coalesce(margin < 0.15, false) then lost_id end as matched, coalesce(margin < 0.15, false) as ambiguous, round(score, 6) as score, round(margin, 6) as margin from r where rank = 1""")
def reentry_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits of an object are cut where it is unseen for a day; an ended visit may go on as another object's."""
    obs = _obs(spark, sf_dir)
    order = "over (partition by object_id order by t_ns, event_id)"
    cut = obs.select("object_id", "camera_id", "class_id", "t_ns", ((F.col("x1") + F.col("x2")) / 2).alias("x"), F.col("y2").alias("y"), (F.col("t_ns") - F.expr(f"lag(t_ns) {order}")).alias("since"), (F.expr(f"lead(t_ns) {order}") - F.col("t_ns")).alias("until"))
    day = views.DAY_NS
    lost = cut.where(F.coalesce(F.col("until") > day, F.lit(True))).select("object_id", "camera_id", "class_id", F.col("t_ns").alias("last_ns"), "x", "y")
    seen = cut.where(F.coalesce(F.col("since") > day, F.lit(True))).select("object_id", "camera_id", "class_id", F.col("t_ns").alias("first_ns"), "x", "y")
    return spatial.reentries(lost, seen, day // 4, 0.25)


@query("select date_trunc('hour', ts) as start, event_type, count(*) as n from events group by all")
def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = stateful.windowed_counts(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return got.withColumn("start", F.col("start").cast("timestamp_ntz"))


# Attention, encoding, views and tallies.

DEMANDS = [("d1", [], ["person"], ["a0", "a1"], 5000), ("d2", ["cam-1", "cam-2"], [], ["a1", "a2"], 2000), ("d3", ["cam-5"], ["vehicle.forklift"], ["a2"], 500)]
_DEMANDS = """, demands(demand, cams, cls, attributes, freshness_ms) as (values ('d1', [], ['person'], ['a0', 'a1'], 5000), ('d2', ['cam-1', 'cam-2'], [], ['a1', 'a2'], 2000), ('d3', ['cam-5'], ['vehicle.forklift'], ['a2'], 500)),
    matched as (select o.object_id, d.* from objs o join demands d on (len(cams) = 0 or list_contains(cams, o.camera_id)) and (len(cls) = 0 or o.class_id = cls[1] or starts_with(o.class_id, cls[1] || '.')))"""


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    demands = spark.createDataFrame(DEMANDS, "demand_id string, camera_ids array<string>, class_ids array<string>, attributes array<string>, freshness_ms long")
    return attention.match_demands(state.objects(_obs(spark, sf_dir)), demands)


@query(f"{_DEMANDS} select object_id, demand from matched")
def demand_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir).select("object_id", "demand")


@query(f"{_DEMANDS} select object_id, attribute, min(freshness_ms) as freshness_ms, string_agg(distinct demand, ',' order by demand) as demands from (select object_id, demand, freshness_ms, unnest(attributes) as attribute from matched) group by 1, 2")
def demand_required_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention.required_attributes(_matched(spark, sf_dir))


@query(f"""select object_id, attr_key, case when attr_value in ('unknown') then 'ATTRIBUTE_MISSING' when n_seen % 7 = 0 then 'QUALITY_IMPROVED' when {NOW} - observed_at_ns > {15 * views.DAY_NS} then 'STALE' when n_seen > 6 then 'LIFECYCLE' when n_seen % 5 >= 4 then 'APPEARANCE' when n_seen % 3 = 0 then 'LOW_CONFIDENCE' when {NOW} - observed_at_ns >= 300000000000 then 'PERIODIC' else 'FRESH_ENOUGH' end as reason from held""")
def trigger_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_seen")
    reason = attention.trigger(F.col("attr_value") == "unknown", F.lit(True), F.lit(NOW) - F.col("observed_at_ns"), F.lit(15 * views.DAY_NS), n > 6, (n % 5) / 16.0, (n % 3) * 0.5, n % 7 == 0)
    return state.current_attributes(_attrs(spark, sf_dir)).select("object_id", "attr_key", reason.alias("reason"))


@query("select o_orderkey as arrival, priority from (select *, case substr(o_orderpriority, 1, 1) when '1' then 'critical' when '2' then 'interactive' when '3' then 'standard' when '4' then 'background' else 'other' end as priority from orders) order by case priority when 'critical' then 1 when 'interactive' then 2 when 'standard' then 3 when 'background' then 4 else 5 end, o_orderkey limit 100")
def priority_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.element_at(F.create_map(*(F.lit(x) for kv in zip("1234", attention.PRIORITIES, strict=True) for x in kv)), F.substring("o_orderpriority", 1, 1))
    requests = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("arrival"), F.coalesce(names, F.lit("other")).alias("priority"))
    return attention.by_priority(requests, 100).select("arrival", "priority")


@query("select object_id, attr_key, case when attr_key in ('a0', 'a1') and starts_with(class_id, 'person') then 'people' when attr_key in ('a1', 'a2') then 'any' when attr_key = 'a4' and class_id = 'vehicle' or attr_key = 'a4' and starts_with(class_id, 'vehicle.') then 'wheels' end as rule from (select distinct object_id, attr_key, class_id from attrs)")
def governing_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _attrs(spark, sf_dir).select("object_id", F.col("attr_key").alias("attribute"), "class_id").distinct()
    return attention.governing(asked, [("people", ["a0", "a1"], ["person"]), ("any", ["a1", "a2"], []), ("wheels", ["a4"], ["vehicle"])]).select("object_id", F.col("attribute").alias("attr_key"), "rule")


@query("select adapter, prompt, chunk, count(*) as n, min(arrival) as first from (select camera_id as adapter, kind as prompt, event_id as arrival, (row_number() over (partition by camera_id, kind order by event_id) - 1) // 16 as chunk from obs) group by 1, 2, 3")
def micro_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention.batches(_obs(spark, sf_dir).select(F.col("camera_id").alias("adapter"), F.col("kind").alias("prompt"), F.col("event_id").alias("arrival")), 16)


@query()
def motion_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention.ema_motion(state.trajectory_ring(_obs(spark, sf_dir)))


@query("select observation_id, kind, object_id, class_id, t_ns, round(value, 9) as value from obs")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each observation encoded as a JSON line and decoded again."""
    got = jsonlog.decode(jsonlog.encode(_log(spark, sf_dir)).select("line")).where("not bad")
    return got.select("observation_id", "kind", "object_id", "class_id", "t_ns", F.round("value", 9).alias("value"))


@query(f"{_RULES_SQL} select rule_id, object_id, case state when 'VIOLATION' then rule_id || ': ' || n_failed || ' failed' when 'UNKNOWN' then rule_id || ': unknown (' || reasons || ')' when 'NOT_APPLICABLE' then rule_id || ': not applicable' else rule_id || ': holds' end as sentence from found")
def finding_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents.sentence(rules.findings(_judged(spark, sf_dir))).select("rule_id", "object_id", "sentence")


@query("select tenant_id, camera_id, kind, count(*) as n from obs group by all")
def tallies_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _obs(spark, sf_dir).groupBy("tenant_id", "camera_id", "kind").agg(F.count("*").alias("n"))


@query("select camera_id, observation_id, round(avg(case when kind = 'coverage' then 1 else 0 end) over (partition by camera_id order by log_position rows between 99 preceding and current row), 9) as rate from obs")
def trailing_rejection_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = F.expr("avg(case when kind = 'coverage' then 1 else 0 end) over (partition by camera_id order by log_position rows between 99 preceding and current row)")
    return _log(spark, sf_dir).select("camera_id", "observation_id", F.round(rate, 9).alias("rate"))


@query("select camera_id, t_ns, streak from (select *, row_number() over (partition by camera_id, island order by log_position) as streak from (select *, sum(case when before is null or before <> k % 2 then 1 else 0 end) over (partition by camera_id order by log_position) as island from (select *, lag(k % 2) over (partition by camera_id order by log_position) as before from obs))) where streak = 4")
def frozen_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suspicion exactly when a camera's digest has been the same four times."""
    order = "over (partition by camera_id order by log_position)"
    marked = _log(spark, sf_dir).select("camera_id", "t_ns", "log_position", (F.col("k") % 2).alias("digest")).withColumn("before", F.expr(f"lag(digest) {order}"))
    islands = marked.withColumn("island", F.expr(f"sum(case when before is null or before <> digest then 1 else 0 end) {order}"))
    return islands.withColumn("streak", F.expr("row_number() over (partition by camera_id, island order by log_position)").cast("long")).where("streak = 4").select("camera_id", "t_ns", "streak")


@query("select state, count(*) as n from (select case when o_orderdate <= timestamp '1995-06-01' then 'EXPIRED' else 'retained' end as state from orders) group by 1")
def evidence_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("expires_at"), F.lit("retained").alias("state"))
    return incidents.sweep(records, "1995-06-01", erase=False).groupBy("state").agg(F.count("*").alias("n"))


@query("select source, lang, count(*) as n, sum(case when quality = 1 then 1 else 0 end) as good, count(distinct doc_id) >= 20 as measurable from documents join labels using (doc_id) group by 1, 2")
def dataset_quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    return both.groupBy("source", "lang").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("good"), (F.countDistinct("doc_id") >= 20).alias("measurable"))


@query("select l_returnflag as class_id, count(*) as n, round(median(l_quantity), 6) as med, min(l_discount) as least, round(median(l_quantity * l_discount), 6) as med_area from lineitem group by 1")
def geometry_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("class_id")).agg(F.count("*").alias("n"), F.round(F.median("l_quantity"), 6).alias("med"), F.min("l_discount").alias("least"), F.round(F.median(F.col("l_quantity") * F.col("l_discount")), 6).alias("med_area"))


from witnesslake import queries  # noqa: E402, F401 (they add themselves to QUERIES and ORACLES)
