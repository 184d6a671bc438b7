"""Demands acknowledged and stored by version, and crops admitted by a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from witnesslake.catalog import _obs, query
from witnesslake.operators import demands
from witnesslake.sources.views import DAY_NS, table

#: Attributes a0 to a4 can be produced, a5 and a6 are registered only.
_CAPABILITIES = [(f"a{i}", i < 5) for i in range(7)]
_AT = (9000 * DAY_NS, 10000 * DAY_NS)


def _commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order is a command on its customer's demand."""
    o = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        o.alias("command_id"), F.col("o_custkey").alias("demand_id"), (F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * DAY_NS).alias("at_ns"),
        F.when(o % 4 < 2, "register").when(o % 4 == 2, "update").otherwise("revoke").alias("action"), F.concat(F.lit("s"), F.when(o % 13 == 0, 99).otherwise(F.col("o_custkey") % 7)).alias("principal"),
        F.when(o % 17 == 0, F.array(F.lit("a8"))).otherwise(F.array(F.concat(F.lit("a"), o % 5), F.concat(F.lit("a"), o % 9))).alias("attributes"), ((o % 20) * 200_000_000).alias("freshness_ns"),
    )


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame(_CAPABILITIES, "attribute string, producible boolean")
    return demands.outcomes(demands.acknowledge(_commands(spark, sf_dir), known, 2 * 10**9))


_JUDGED = f"""(with recursive c as (select o_orderkey as command_id, o_custkey as demand_id, cast(datediff('day', date '1970-01-01', cast(o_orderdate as date)) as bigint) * {DAY_NS} as at_ns, case when o_orderkey % 4 < 2 then 'register' when o_orderkey % 4 = 2 then 'update' else 'revoke' end as action,
        's' || case when o_orderkey % 13 = 0 then 99 else o_custkey % 7 end as principal, case when o_orderkey % 17 = 0 then [8] else [o_orderkey % 5, o_orderkey % 9] end as a, greatest(o_orderkey % 20 * 200000000, 2000000000) as effective_ns from orders),
    s as (select *, case when list_min(a) > 6 then 'rejected' when list_max(a) > 4 then 'partially_accepted' else 'accepted' end as status, row_number() over (partition by demand_id order by at_ns, command_id) as rn from c),
    f as (select 0 as rn, demand_id, cast(null as bigint) as command_id, cast(null as varchar) as owner, 0 as version, '' as outcome from (select distinct demand_id from s)
        union all select s.rn, s.demand_id, s.command_id, case when x not in ('applied', 'withdrawn') then f.owner when s.action = 'revoke' or x = 'withdrawn' then null else s.principal end, f.version + cast(x in ('applied', 'withdrawn') as int), x
            from f join s on s.demand_id = f.demand_id and s.rn = f.rn + 1, lateral (select case when s.action <> 'register' and f.owner is null then 'unknown' when f.owner <> s.principal then 'forbidden' when s.action <> 'revoke' and s.status = 'rejected' then case s.action when 'update' then 'withdrawn' else 'rejected' end else 'applied' end as x))
    select s.*, outcome, version from s join f using (demand_id, command_id))"""


@query(f"""select command_id, demand_id, action, status, outcome, version, effective_ns, array_to_string(list_transform(list_filter(a, lambda x: x < 5), lambda x: 'a' || x), ',') as satisfiable,
    array_to_string(list_transform(list_filter(a, lambda x: x > 4), lambda x: 'a' || x || case when x > 6 then ':attribute_not_registered' else ':no_capable_model' end), ',') as unsatisfiable from {_JUDGED}""")
def demand_acknowledgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select("command_id", "demand_id", "action", "status", "outcome", "version", "effective_ns", *(F.array_join(c, ",").alias(c) for c in ("satisfiable", "unsatisfiable")))


_VERSIONS = f"(select demand_id, version, principal as subscriber, status, effective_ns, at_ns as since_ns, until_ns from (select *, lead(at_ns) over (partition by demand_id order by version) as until_ns from {_JUDGED} where outcome in ('applied', 'withdrawn')) where action <> 'revoke' and outcome = 'applied')"


@query(f"select * from {_VERSIONS}")
def demand_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demands.versions(_judged(spark, sf_dir)).drop("satisfiable", "unsatisfiable")


@query(" union all ".join(f"select {t} as at_ns, status, count(*) as n, count(distinct subscriber) as subscribers from {_VERSIONS} where since_ns <= {t} and (until_ns is null or until_ns > {t}) group by status" for t in _AT))
def demands_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds at two times, from one log of commands."""
    stored = demands.versions(_judged(spark, sf_dir))
    early, late = (demands.as_of(stored, t).groupBy("status").agg(F.count("*").alias("n"), F.countDistinct("subscriber").alias("subscribers")).select(F.lit(t).alias("at_ns"), "status", "n", "subscribers") for t in _AT)
    return early.unionByName(late)


_WINDOW, _BUDGET, _CEILING = 86_400 * 10**9, 60, 3


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An observation is a request; a camera's hour is a frame, a day a window."""
    return _obs(spark, sf_dir).select("camera_id", F.expr("t_ns div 3600000000000 * 3600000000000").alias("t_ns"), F.col("event_id").alias("request_id"), (F.col("k") % 10).alias("priority"), (F.col("k") % 4 == 0).alias("refunded"), F.array(F.concat(F.lit("d"), F.col("k") % 6), F.concat(F.lit("e"), F.col("k") % 3)).alias("demand_ids"))


_ADMITTED = f"""(with recursive q as (select camera_id, t_ns // 3600000000000 * 3600000000000 as t, event_id as request_id, k, k % 4 = 0 as refunded, row_number() over (partition by camera_id, t_ns // 3600000000000 order by k % 10 desc, event_id) as place from obs),
    g as (select t // {_WINDOW} as w, t, camera_id, least(count(*), {_CEILING}) as n, list(cast(refunded as int) order by place) as back, row_number() over (partition by t // {_WINDOW} order by t, camera_id) as rn from q group by t, camera_id),
    f as (select w, rn, t, camera_id, n, back, {_BUDGET} as credit from g where rn = 1
        union all select g.w, g.rn, g.t, g.camera_id, g.n, g.back, f.credit - least(f.credit, f.n) + coalesce(list_sum(f.back[1 : least(f.credit, f.n)]), 0) from f join g on g.w = f.w and g.rn = f.rn + 1)
    select q.*, w, case when place <= {_CEILING} and place <= credit then 'admitted' when credit >= {_CEILING} then 'preempted' else 'exhausted' end as outcome from q join f using (t, camera_id))"""


@query(f"select camera_id, t as t_ns, request_id, outcome from {_ADMITTED}")
def crop_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demands.admit(_requests(spark, sf_dir), _BUDGET, _CEILING, _WINDOW).select("camera_id", "t_ns", "request_id", "outcome")


@query(f"select w as window_no, d as demand_id, count(*) as calls from (select w, unnest(['d' || (k % 6), 'e' || (k % 3)]) as d from {_ADMITTED} where outcome = 'admitted' and not refunded) group by 1, 2")
def demand_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demands.demand_calls(demands.admit(_requests(spark, sf_dir), _BUDGET, _CEILING, _WINDOW), _WINDOW)
