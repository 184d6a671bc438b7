"""The observation log as JSON lines: encode, append, scan, decode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "observation_id string, kind string, tenant_id string, camera_id string, object_id string, class_id string, t_ns long, attr_key string, attr_value string, value double, frame_ref string"
KINDS = ("presence", "spatial", "attribute", "lifecycle", "coverage")


def encode(obs: DataFrame) -> DataFrame:
    """(camera_id, line): one JSON object an observation, null fields left out."""
    ref = F.format_string("%s/e%d/f%d", "camera_id", F.lit(0), "log_position")
    row = obs.withColumn("frame_ref", ref).select(*(c.split()[0] for c in SCHEMA.split(", ")))
    return row.select("camera_id", F.to_json(F.struct(*row.columns)).alias("line"))


def decode(lines: DataFrame) -> DataFrame:
    """Observations of (line); blank and undecodable lines, unknown kinds and missing ids are null rows of `bad`, never errors."""
    parsed = lines.where(F.trim("line") != "").select(F.from_json("line", f"{SCHEMA}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("o")).select("o.*")
    good = F.col("_corrupt").isNull() & F.col("observation_id").isNotNull() & F.col("kind").isin(*KINDS) & F.col("t_ns").isNotNull()
    return parsed.withColumn("bad", ~F.coalesce(good, F.lit(False))).drop("_corrupt")


def append(obs: DataFrame, path: str) -> None:
    """Adds lines to a folder a camera."""
    encode(obs).withColumnRenamed("camera_id", "camera").write.mode("append").partitionBy("camera").text(path)


def scan(spark: SparkSession, path: str, cameras: list[str] | None = None) -> DataFrame:
    """Decoded observations of some cameras' folders (all, if None); partition pruning skips the rest."""
    lines = spark.read.text(path).withColumnRenamed("value", "line")
    return decode((lines if cameras is None else lines.where(F.col("camera").isin(cameras))).select("line")).where("not bad").drop("bad")
