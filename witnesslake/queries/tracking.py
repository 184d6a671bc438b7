"""Tracks, lifecycles, merges and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from witnesslake.catalog import NOW, START, _log, _obs, query
from witnesslake.operators import exposure, state
from witnesslake.sources import views
from witnesslake.streaming import tracker


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of eight observations of a camera are a frame; frames are a second apart."""
    frame = F.expr("log_position div 8")
    return _log(spark, sf_dir).select("camera_id", (frame * 10**9).alias("t_ns"), F.col("event_id").alias("det_index"), "x1", "y1", "x2", "y2")


@query()
def tracker_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracker.track(_found(spark, sf_dir))


@query()
def tracker_optimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracker.track(_found(spark, sf_dir), "optimal")


_H = 3600
_JUDGED = START + 6 * views.DAY_NS


@query(f"""select object_id, case when observation_count < 3 or last_confirmed_ns is null then case when {_JUDGED} - last_confirmed_ns >= 3000000000 * {_H} then 'expired' else 'provisional' end when {_JUDGED} - last_confirmed_ns >= 600000000000 * {_H} then 'expired' when {_JUDGED} - last_confirmed_ns >= 120000000000 * {_H} then 'departed'
    when {_JUDGED} - last_confirmed_ns >= 10000000000 * {_H} then 'dormant' when {_JUDGED} > last_confirmed_ns then 'occluded' else 'active' end as lifecycle from objs""")
def object_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sweep at a time, with horizons stretched to the data's pace."""
    objects = state.objects(_obs(spark, sf_dir))
    return objects.select("object_id", tracker.lifecycle_at(_JUDGED, F.col("observation_count"), F.col("last_confirmed_ns"), _H).alias("lifecycle"))


@query("""with recursive m as (select 'obj-' || o as o, 'obj-' || (o // 2) as s from (select distinct user_id as o from events) where o % 3 > 0 and o > 1), r as (select o, s from m union all select r.o, m.s from r join m on r.s = m.o), e as (select * from r where s not in (select o from m)),
    b as (select 'obj-' || user_id as object_id, min(epoch_us(ts) * 1000) as f, max(epoch_us(ts) * 1000) as l, count(*) as n from events where event_type <> 'error' group by 1)
    select coalesce(s, object_id) as object_id, min(f) as first_seen_ns, max(l) as last_seen_ns, cast(sum(n) as bigint) as observation_count, count(s) as merged_from from b left join e on b.object_id = e.o group by 1""")
def registry_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects after merges, whose chains are followed to their ends."""
    obs = _obs(spark, sf_dir)
    ids = obs.select(F.expr("cast(substring(object_id, 5) as long)").alias("o")).distinct().where("o % 3 > 0 and o > 1")
    ends = exposure.resolved(ids.select(F.concat(F.lit("obj-"), "o").alias("object_id"), F.concat(F.lit("obj-"), F.expr("o div 2")).alias("merged_into")))
    return tracker.merged_objects(state.objects(obs), ends).drop("last_confirmed_ns")


@query(f"select case when object_id = 'obj-3' and t_ns >= {START + 5 * views.DAY_NS} then 'obj-3b' else object_id end as object_id, count(*) as observation_count, max(t_ns) as last_seen_ns from obs where kind <> 'coverage' group by 1")
def registry_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parted = tracker.split_at(_obs(spark, sf_dir), "obj-3", START + 5 * views.DAY_NS, "obj-3b")
    return state.objects(parted).select("object_id", "observation_count", "last_seen_ns")


@query(f"select camera_id, count(*) filter (l = 'expired') as expired, count(*) filter (l <> 'expired') as held from (select camera_id, case when {NOW} - last_seen_ns >= 600000000000 * {_H} then 'expired' else 'held' end as l from objs) group by 1")
def retention_by_camera(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = F.lit(NOW) - F.col("last_seen_ns") >= tracker.RETENTION_NS * _H
    return state.objects(_obs(spark, sf_dir)).groupBy("camera_id").agg(F.count_if(gone).alias("expired"), F.count_if(~gone).alias("held"))
