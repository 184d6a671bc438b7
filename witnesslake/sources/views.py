"""Observation views over event tables: one typed fact per event, in log order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from witnesslake.operators import ordered
from witnesslake.sources import store

#: An attribute value stays valid for a day.
DAY_NS = 86_400 * 10**9
KINDS = {"view": "presence", "click": "spatial", "purchase": "attribute", "signup": "lifecycle", "error": "coverage"}
STATES = ("worn", "absent", "not_visible", "worn", "unknown", "worn")
CLASSES = ("person", "person.child", "vehicle", "vehicle.forklift")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wall_ns(ts: Column) -> Column:
    """Nanoseconds since 1970 of a zone-less timestamp, whatever the session's zone."""
    return F.unix_micros(F.from_utc_timestamp(ts.cast("timestamp"), F.current_timezone())) * 1000


def _pick(values: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (at % len(values) + 1).cast("int"))


def observations(spark: SparkSession, sf_dir: str, placed: bool = True) -> DataFrame:
    """The log: identity, time, class, box and attribute of each observation and, if `placed`, its position within its camera.

    Positions are assigned once, as by an append, and stored with the log.
    """
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", F.regexp_extract("props", r"(\d+)", 1).cast("int").alias("k"))
    u = F.col("user_id")
    x1, y1 = (F.col("k") % 10).cast("double") / 12, F.floor(F.col("k") / 10).cast("double") / 12
    kind = F.element_at(F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv)), F.col("event_type"))
    facts = events.select(
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("observation_id"), F.concat(F.lit("cam-"), u % 8).alias("camera_id"), F.concat(F.lit("t"), (u % 8) % 2).alias("tenant_id"),
        F.concat(F.lit("obj-"), u).alias("object_id"), _pick(CLASSES, u).alias("class_id"), kind.alias("kind"), wall_ns(F.col("ts")).alias("t_ns"), "k", "value",
        x1.alias("x1"), y1.alias("y1"), (x1 + 0.05 + F.least("value", F.lit(400.0)) / 4000).alias("x2"), (y1 + 0.1).alias("y2"),
        F.concat(F.lit("a"), F.col("k") % 5).alias("attr_key"), _pick(STATES, F.col("k")).alias("attr_value"), "event_id",
    )
    facts = facts.withColumn("valid_until_ns", F.col("t_ns") + DAY_NS)
    if not placed:
        return facts

    def log() -> DataFrame:
        # in the log's order, so scans of a camera, its positions or its times skip most row groups
        numbered = ordered.numbered(facts, "camera_id", "event_id", "log_position")
        return numbered.repartition("camera_id", F.expr(f"t_ns div {DAY_NS}")).sortWithinPartitions("camera_id", "log_position")

    return store.made_once(spark, f"{sf_dir}/events.parquet", "log", log)


def attributes(obs: DataFrame) -> DataFrame:
    """Attribute observations alone."""
    return obs.where(F.col("kind") == "attribute").select("object_id", "camera_id", "class_id", "attr_key", "attr_value", "t_ns", "valid_until_ns", "event_id", *(c for c in obs.columns if c == "log_position"))


REGIONS = {"dock": ((0.0, 0.0), (0.5, 0.0), (0.5, 0.6), (0.0, 0.6)), "bay": ((0.4, 0.2), (0.9, 0.2), (0.9, 0.9), (0.65, 0.5), (0.4, 0.9)), "far": ((0.95, 0.95), (1.0, 0.95), (1.0, 1.0))}


def regions(spark: SparkSession) -> DataFrame:
    """A convex, a concave and a remote polygon."""
    point = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
    return spark.createDataFrame([(k, list(v)) for k, v in REGIONS.items()], T.StructType([T.StructField("region_id", T.StringType()), T.StructField("vertices", T.ArrayType(point))]))
