"""Erasure with all that derives from it, servability, and frames of decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from witnesslake.catalog import START, _obs, query
from witnesslake.operators import evidence
from witnesslake.sources.views import DAY_NS, table

_TOLERANCE = 2 * DAY_NS
#: Which orders derive from or supersede which, in words that Spark and SQL share; some ways lead back to where they began.
_EDGES = [("o_custkey * 10", "o_orderkey", "o_orderkey % 3 = 0"), ("o_orderkey", "o_orderkey + 1", "o_orderkey % 5 = 0"), ("o_orderkey + 1", "o_orderkey", "o_orderkey % 5 = 0"), ("o_orderkey", "o_custkey", "o_orderkey % 7 = 0")]


def _erased(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    o = F.col("o_orderkey")
    records = orders.select(o.alias("evidence_id"), (F.col("o_custkey") % 4).alias("tenant_id"), F.concat(F.lit("h"), o % 2000).alias("content_hash"), (1000 + o % 2000).alias("size_bytes"))
    edges = None
    for source, to, where in _EDGES:
        part = orders.where(where).select(F.expr(source).alias("source"), F.expr(to).alias("id"))
        edges = part if edges is None else edges.unionByName(part)
    return evidence.erase(records, edges, orders.where("o_orderdate < timestamp'1995-02-01' and o_custkey % 4 = 1").select(o.alias("id")))


_ERASED = "(with recursive e(source, id) as (" + " union all ".join(f"select {s}, {t} from orders where {w}" for s, t, w in _EDGES) + """),
    g as (select o_orderkey as id from orders where o_orderdate < timestamp '1995-02-01' and o_custkey % 4 = 1 union select e.id from g join e on e.source = g.id),
    r as (select o_orderkey as evidence_id, o_custkey % 4 as tenant_id, 'h' || (o_orderkey % 2000) as content_hash, 1000 + o_orderkey % 2000 as size_bytes, o_orderkey in (select id from g) as gone from orders)
    select *, case when not gone then 'kept' when bool_or(not gone) over (partition by tenant_id, content_hash) then 'record_erased' else 'erased' end as fate from r)"""


@query(f"select evidence_id, tenant_id, fate from {_ERASED}")
def evidence_erased(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes when the early records of a tenant go."""
    return _erased(spark, sf_dir).select("evidence_id", "tenant_id", "fate")


@query(f"select tenant_id, count(*) as erased, cast(coalesce((select sum(b) from (select max(size_bytes) as b from {_ERASED} y where fate = 'erased' and y.tenant_id = x.tenant_id group by content_hash)), 0) as bigint) as bytes from {_ERASED} x where fate <> 'kept' group by tenant_id")
def evidence_reclaimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.reclaimed(_erased(spark, sf_dir))


@query(f"""select o_custkey as evidence_ref, case when o_custkey % 9 = 0 then 'no_such_record' when o_custkey % 7 = 0 then 'deleted' when o_custkey % 5 = 0 or {START} + (o_custkey % 40) * {DAY_NS} <= {START} + 10 * {DAY_NS} then 'expired' when o_custkey % 4 = 0 then 'bytes_missing' when o_custkey % 11 = 0 then 'integrity_failed' else 'servable' end as status
    from (select c_custkey as o_custkey from customer)""")
def evidence_servability(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    asked = table(spark, sf_dir, "customer").select(k.alias("evidence_ref"), "c_custkey")
    records = asked.where(k % 9 > 0).select("evidence_ref", F.when(k % 7 == 0, "DELETED").when(k % 5 == 0, "EXPIRED").otherwise("RETAINED").alias("state"), (F.lit(START) + (k % 40) * DAY_NS).alias("expires_at_ns"), F.sha2(k.cast("string"), 256).alias("content_hash"), F.concat(F.lit("s"), k).alias("storage_ref"))
    blobs = asked.where(k % 4 > 0).select(F.concat(F.lit("s"), k).alias("storage_ref"), F.when(k % 11 == 0, "other").otherwise(F.sha2(k.cast("string"), 256)).alias("digest"))
    return evidence.servability(asked.select("evidence_ref"), records, blobs, START + 10 * DAY_NS)


@query(f"""select d.event_id as decision_id, d.object_id, max(struct_pack(t := f.t_ns, r := f.observation_id)).r as frame_ref, max(f.t_ns) as captured_ns, case when max(f.t_ns) is null then 'context-frame' else 'decision-frame' end as kind from (select * from attrs where attr_value = 'absent') d
    left join (select * from obs where kind in ('spatial', 'presence')) f on f.camera_id = d.camera_id and f.object_id = d.object_id and f.t_ns <= d.t_ns and f.t_ns >= d.t_ns - {_TOLERANCE} group by 1, 2""")
def decision_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frame behind each attribute that was seen to be absent."""
    obs = _obs(spark, sf_dir)
    made = obs.where("kind = 'attribute' and attr_value = 'absent'").select(F.col("event_id").alias("decision_id"), "camera_id", "object_id", F.col("t_ns").alias("at_ns"))
    frames = obs.where("kind in ('spatial', 'presence')").select("camera_id", "object_id", F.col("observation_id").alias("frame_ref"), "t_ns")
    return evidence.decision_frames(made, frames, _TOLERANCE).select("decision_id", "object_id", "frame_ref", "captured_ns", "kind")
