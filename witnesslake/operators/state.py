"""Current state as a fold of the log: latest values, rings, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from witnesslake.operators import ordered
from witnesslake.sources import store

RING, ATTRIBUTE_RING, CLASS_RING = 64, 8, 16


def objects(obs: DataFrame) -> DataFrame:
    """One row an object: monotone first and last times, last position, box and counts; no coverage facts."""
    seen = obs.where("kind <> 'coverage'")
    measured = F.when(F.col("kind") == "spatial", F.col("t_ns"))
    last = F.max_by(F.struct("x1", "y1", "x2", "y2"), F.struct("t_ns", "event_id"))
    return seen.groupBy("object_id", "camera_id", "tenant_id", "class_id").agg(F.min("t_ns").alias("first_seen_ns"), F.max("t_ns").alias("last_seen_ns"), F.max(measured).alias("last_confirmed_ns"), F.count("*").alias("observation_count"), *(F.max(c).alias(c) for c in obs.columns if c == "log_position"), last.alias("box"))


def current_attributes(attrs: DataFrame) -> DataFrame:
    """The value an object holds for each key: the latest observed, ties to the later arrival."""
    order = F.struct("t_ns", "event_id")
    return attrs.groupBy("object_id", "attr_key").agg(F.max_by("attr_value", order).alias("attr_value"), F.max("t_ns").alias("observed_at_ns"), F.max_by("valid_until_ns", order).alias("valid_until_ns"), F.count("*").alias("n_seen"))


def attribute_ring(attrs: DataFrame, size: int = ATTRIBUTE_RING) -> DataFrame:
    """The prior values of each key, newest first: older arrivals than the held one never enter."""
    held = attrs.withColumn("top", F.expr("max(t_ns) over (partition by object_id, attr_key order by log_position, event_id rows between unbounded preceding and current row)")).where("t_ns >= top")
    last = held.withColumn("last", F.expr("row_number() over (partition by object_id, attr_key, t_ns order by log_position desc)")).where("last = 1")
    back = last.withColumn("back", F.expr("row_number() over (partition by object_id, attr_key order by t_ns desc)"))
    return back.where((F.col("back") > 1) & (F.col("back") <= size + 1)).select("object_id", "attr_key", (F.col("back") - 1).alias("depth"), "attr_value", "t_ns")


def trajectory_ring(obs: DataFrame, size: int = RING) -> DataFrame:
    """The newest bottom-centre points of each object."""
    back = obs.where("kind = 'spatial'").withColumn("depth", F.expr("row_number() over (partition by object_id order by t_ns desc, event_id desc)"))
    return back.where(F.col("depth") <= size).select("object_id", "depth", "t_ns", ((F.col("x1") + F.col("x2")) / 2).alias("x"), F.col("y2").alias("y"))


def value_changes(attrs: DataFrame, size: int = CLASS_RING) -> DataFrame:
    """Rows whose value differs from the object's one before, newest first, in a ring."""
    changed = attrs.withColumn("before", F.expr("lag(attr_value) over (partition by object_id order by t_ns, event_id)")).where("before is null or before <> attr_value")
    return changed.withColumn("depth", F.expr("row_number() over (partition by object_id order by t_ns desc, event_id desc)")).where(F.col("depth") <= size).select("object_id", "depth", "before", "attr_value", "t_ns")


def coverage_gaps(obs: DataFrame, since: int, until: int) -> DataFrame:
    """Each camera's blind intervals clipped to a window: an error opens one, the next other fact closes it."""
    status = obs.select("camera_id", "t_ns", "event_id", (F.col("kind") == "coverage").alias("blind"))
    edges = ordered.neighbours(status, "camera_id", "event_id", "blind").where("previous is null or previous <> blind").drop("previous", "next")
    # changes of status are few, so they are stored rather than found anew for each side of the next step
    edges = store.cut(edges)
    spans = ordered.neighbours(edges, "camera_id", "event_id", "t_ns").where("blind").withColumnRenamed("next", "until_ns")
    clipped = spans.select("camera_id", F.greatest("t_ns", F.lit(since)).alias("since_ns"), F.least(F.coalesce("until_ns", F.lit(until)), F.lit(until)).alias("until_ns"))
    return clipped.where("until_ns > since_ns")


def merged_intervals(spans: DataFrame, key: str) -> DataFrame:
    """Unions of overlapping [since_ns, until_ns) by key."""
    reach = spans.withColumn("reach", F.expr(f"max(until_ns) over (partition by {key} order by since_ns, until_ns rows between unbounded preceding and 1 preceding)"))
    islands = reach.withColumn("island", F.expr(f"sum(case when reach is null or since_ns > reach then 1 else 0 end) over (partition by {key} order by since_ns, until_ns)"))
    return islands.groupBy(key, "island").agg(F.min("since_ns").alias("since_ns"), F.max("until_ns").alias("until_ns")).drop("island")


def coverage_fraction(obs: DataFrame, since: int, until: int) -> DataFrame:
    """1 less the covered share of gaps, by camera; overlaps count once."""
    gaps = merged_intervals(coverage_gaps(obs, since, until), "camera_id").groupBy("camera_id").agg(F.sum(F.col("until_ns") - F.col("since_ns")).alias("blind"))
    cameras = obs.select("camera_id").distinct()
    return cameras.join(gaps, "camera_id", "left").select("camera_id", F.round(1 - F.coalesce("blind", F.lit(0)).cast("double") / (until - since), 9).alias("fraction"))


def differences(live: DataFrame, replayed: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Fields in which two states of a key differ; a key on one side alone differs in `presence`."""
    l, r = live.select(key, *(F.col(f).alias(f"l_{f}") for f in fields)).withColumn("l", F.lit(True)), replayed.select(F.col(key).alias("k"), *(F.col(f).alias(f"r_{f}") for f in fields)).withColumn("r", F.lit(True))
    both = l.join(r, F.col(key) == F.col("k"), "full_outer")
    odd = [F.when(F.col("l").isNull() | F.col("r").isNull(), "presence"), *(F.when(~F.col(f"l_{f}").eqNullSafe(F.col(f"r_{f}")), f) for f in fields)]
    return both.select(F.coalesce(key, "k").alias(key), F.explode(F.array(*odd)).alias("field")).where("field is not null")
