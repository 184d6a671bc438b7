"""The frame ledger over the observation log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from witnesslake.catalog import _obs, query
from witnesslake.operators import ledger

_CAPACITY, _DAY = 40, 86_400 * 10**9


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """An observation is a frame, noted twice: soon after it, and, of every other, days later with other fields."""
    obs, k = _obs(spark, sf_dir), F.col("k")
    ref = F.concat_ws(":", "camera_id", F.col("event_id").cast("string"))
    records = obs.select("camera_id", ref.alias("frame_ref"), F.col("event_id").alias("sequence"), (F.col("t_ns") - k * 10**6).alias("captured_at_ns"), F.col("t_ns").alias("received_at_ns"))
    none = F.lit(None)
    first = obs.where(k % 5 > 0).select((F.col("event_id") * 2).alias("note_id"), ref.alias("frame_ref"), (F.col("t_ns") + 10**9).alias("at_ns"), F.col("k").cast("double").alias("processing_ms"), F.when(k % 3 == 0, k).alias("detection_count"), none.cast("int").alias("observation_count"), F.array("object_id").alias("object_ids"), none.cast("array<string>").alias("evidence_refs"), none.cast("string").alias("error"))
    second = obs.where(k % 2 == 0).select((F.col("event_id") * 2 + 1).alias("note_id"), ref.alias("frame_ref"), (F.col("t_ns") + (k % 4) * _DAY).alias("at_ns"), none.cast("double").alias("processing_ms"), F.when(k % 7 == 0, k + 1).alias("detection_count"), F.when(k % 4 == 0, k % 8).alias("observation_count"), none.cast("array<string>").alias("object_ids"), F.array(F.lit("e")).alias("evidence_refs"), F.when(k % 6 == 0, "slow").alias("error"))
    return records, first.unionByName(second)


@query(f"""select camera_id, frame_ref, queue_delay_ms, processed, counts_reported, processing_ms, detection_count, observation_count, n_objects, error, empty, held from (with f as (select *, max(log_position) over (partition by camera_id) as newest from obs),
    n as (select event_id * 2 as note_id, event_id, t_ns + 1000000000 as at_ns, k::double as ms, case when k % 3 = 0 then k end as d, null::int as o, 1 as objects, null as e from obs where k % 5 > 0 union all select event_id * 2 + 1, event_id, t_ns + (k % 4) * {_DAY}, null, case when k % 7 = 0 then k + 1 end, case when k % 4 = 0 then k % 8 end, null, case when k % 6 = 0 then 'slow' end from obs where k % 2 = 0),
    l as (select n.*, f.log_position, (select max(g.log_position) from f g where g.camera_id = f.camera_id and g.t_ns <= n.at_ns) as latest from n join f using (event_id)),
    m as (select event_id, arg_max(ms, (at_ns, note_id)) filter (ms is not null) as ms, arg_max(d, (at_ns, note_id)) filter (d is not null) as d, arg_max(o, (at_ns, note_id)) filter (o is not null) as o, max(objects) as objects, arg_max(e, (at_ns, note_id)) filter (e is not null) as e, bool_or(d is not null or o is not null) as counted from l where latest - log_position < {_CAPACITY} group by 1)
    select camera_id, camera_id || ':' || f.event_id as frame_ref, k::double as queue_delay_ms, m.event_id is not null as processed, coalesce(counted, false) as counts_reported, coalesce(ms, 0) as processing_ms, coalesce(d, 0) as detection_count, coalesce(o, 0) as observation_count, coalesce(objects, 0) as n_objects, coalesce(e, '') as error, case when counted then coalesce(o, 0) = 0 end as empty, newest - log_position < {_CAPACITY} as held from f left join m on m.event_id = f.event_id)""")
def frame_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame with what its notes say, those left out that came when it had aged out."""
    out = ledger.entries(*_sides(spark, sf_dir), _CAPACITY)
    return out.select("camera_id", "frame_ref", "queue_delay_ms", "processed", "counts_reported", "processing_ms", "detection_count", "observation_count", F.size("object_ids").alias("n_objects"), "error", "empty", "held")
