"""What to look at: demands, triggers, priority, grouping; how objects move."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from witnesslake.operators.log import covers

#: Fixed order of priority classes; unknown ones come last.
PRIORITIES = ("critical", "interactive", "standard", "background")
PERIODIC_NS, APPEARANCE, LOW_CONFIDENCE = 300 * 10**9, 0.25, 0.5


def match_demands(objects: DataFrame, demands: DataFrame) -> DataFrame:
    """Objects with each demand that serves them: camera in scope (empty: all) and class covered (empty: all). Demands are few."""
    d = demands.withColumnRenamed("demand_id", "demand")
    within = (F.size("camera_ids") == 0) | F.array_contains("camera_ids", F.col("camera_id"))
    covered = (F.size("class_ids") == 0) | F.coalesce(F.exists("class_ids", lambda k: (F.col("class_id") == k) | F.startswith(F.col("class_id"), F.concat(k, F.lit(".")))), F.lit(False))
    return objects.join(F.broadcast(d), within & covered)


def required_attributes(matched: DataFrame) -> DataFrame:
    """Of each object and attribute the strictest freshness and the demands that ask, in order."""
    each = matched.withColumn("attribute", F.explode("attributes"))
    return each.groupBy("object_id", "attribute").agg(F.min("freshness_ms").alias("freshness_ms"), F.array_join(F.array_sort(F.collect_set("demand")), ",").alias("demands"))


def trigger(missing: Column, seen_before: Column, age_ns: Column, freshness_ns: Column, changed: Column, appearance: Column, confidence: Column, improved: Column) -> Column:
    """The first reason to look again, cheapest first. `improved`: a gate refused the last crop, and conditions are now good enough."""
    return (
        F.when(freshness_ns.isNull(), "NO_DEMAND").when(missing & ~seen_before, "FIRST_SIGHT").when(missing, "ATTRIBUTE_MISSING").when(improved, "QUALITY_IMPROVED").when(age_ns > freshness_ns, "STALE").when(changed, "LIFECYCLE")
        .when(appearance >= APPEARANCE, "APPEARANCE").when(confidence < LOW_CONFIDENCE, "LOW_CONFIDENCE").when(age_ns >= PERIODIC_NS, "PERIODIC").otherwise("FRESH_ENOUGH")
    )


def by_priority(requests: DataFrame, n: int) -> DataFrame:
    """The first n requests by priority class, then arrival."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*(F.lit(p) for p in PRIORITIES)), F.col("priority")), F.lit(0)), F.lit(len(PRIORITIES) + 1))
    return requests.withColumn("rank", rank).orderBy("rank", "arrival").limit(n)


def governing(candidates: DataFrame, rules: list[tuple[str, list[str], list[str]]]) -> DataFrame:
    """Each candidate's first rule, in document order, of (name, attributes, classes)."""
    first = F.lit(None).cast("string")
    for name, attributes, classes in reversed(rules):
        first = F.when(F.col("attribute").isin(attributes) & covers(classes, F.col("class_id")), name).otherwise(first)
    return candidates.withColumn("rule", first)


def batches(keys: DataFrame, size: int) -> DataFrame:
    """Groups of equal (adapter, prompt) cut into chunks of at most `size`, in order of arrival."""
    nth = F.expr("row_number() over (partition by adapter, prompt order by arrival)")
    return keys.withColumn("chunk", F.floor((nth - 1) / size)).groupBy("adapter", "prompt", "chunk").agg(F.count("*").alias("n"), F.min("arrival").alias("first"))


def ema_motion(points: DataFrame, alpha: float = 0.6) -> DataFrame:
    """Smoothed velocity of each object at its last of at most 64 points: v = alpha * now + (1 - alpha) * v, per second."""
    track = points.groupBy("object_id").agg(F.array_sort(F.collect_list(F.struct("t_ns", "x", "y"))).alias("p")).where(F.size("p") > 1)
    steps = F.filter(F.zip_with(F.slice(F.col("p"), 1, F.size("p") - 1), F.slice(F.col("p"), 2, F.size("p") - 1), lambda a, b: F.struct(((b["t_ns"] - a["t_ns"]) / 1e9).alias("dt"), (b["x"] - a["x"]).alias("dx"), (b["y"] - a["y"]).alias("dy"))), lambda s: s["dt"] > 0)
    start = F.struct(F.lit(None).cast("double").alias("vx"), F.lit(None).cast("double").alias("vy"))

    def fold(v: Column, s: Column) -> Column:
        nx, ny = s["dx"] / s["dt"], s["dy"] / s["dt"]
        return F.struct(F.when(v["vx"].isNull(), nx).otherwise(alpha * nx + (1 - alpha) * v["vx"]).alias("vx"), F.when(v["vy"].isNull(), ny).otherwise(alpha * ny + (1 - alpha) * v["vy"]).alias("vy"))

    return track.select("object_id", F.aggregate(steps, start, fold).alias("v")).select("object_id", "v.vx", "v.vy")
