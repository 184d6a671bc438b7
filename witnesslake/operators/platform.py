"""What the platform says of itself: findings as records, metrics, invariants, demands, schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from witnesslake.operators.rules import findings


def assembled(judged: DataFrame, meta: DataFrame, now_ns: int, ruleset_version: str) -> DataFrame:
    """Findings of judged conditions as records.

    judged(rule_id, object_id, camera_id, ord, guard, satisfied, reason, evidence_ref) and
    meta(rule_id, rule_version, labels). The id is made of rule, version, object
    and time, so a replay gives it again; the evidence is that of the first
    condition with any; conditions without an answer and their reasons are listed in order.
    """
    first = F.min_by("evidence_ref", F.when(F.col("evidence_ref").isNotNull(), F.col("ord"))).alias("evidence_ref")
    listed = F.array_sort(F.collect_list(F.when(F.col("satisfied").isNull(), F.struct("ord", "attribute"))))  # conditions of one rule
    parts = judged.groupBy("rule_id", "object_id").agg(first, F.array_join(F.transform(listed, lambda x: x["attribute"]), ",").alias("unresolved"))
    full = findings(judged).join(parts, ["rule_id", "object_id"]).join(F.broadcast(meta), "rule_id")
    name = F.concat("rule_id", F.lit("@"), "rule_version", F.lit(":"), "object_id", F.lit(f":{now_ns}"))
    at = F.timestamp_micros(F.lit(now_ns // 1000)).alias("evaluated_at")
    return full.select(name.alias("finding_id"), "rule_id", "rule_version", F.lit(ruleset_version).alias("ruleset_version"), "severity", "state", "object_id", "camera_id", "evidence_ref", "unresolved", "reasons", "labels", at)


def metric_key(name: Column, labels: Column) -> Column:
    """`name|label=value,label=value` with labels (a map) in order; the name alone without any."""
    pairs = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.when(F.size(pairs) > 0, F.concat(name, F.lit("|"), F.array_join(pairs, ","))).otherwise(name)


def counter_totals(series: DataFrame) -> DataFrame:
    """series(name, labels, value) as (name, total): sums by the set of label names, of which the largest counts.

    A breakdown never exceeds its whole, and a placeholder never outweighs what was counted.
    """
    names = F.array_join(F.array_sort(F.map_keys("labels")), ",")
    return series.groupBy("name", names.alias("signature")).agg(F.sum("value").alias("v")).groupBy("name").agg(F.max("v").alias("total"))


def capped_series(series: DataFrame, cap: int = 64) -> DataFrame:
    """At most `cap` label sets of a name by themselves, in their order; the rest is summed as `overflow`."""
    by = series.groupBy("name", metric_key(F.col("name"), F.col("labels")).alias("key")).agg(F.sum("value").alias("value"))
    place = by.withColumn("nth", F.expr("row_number() over (partition by name order by key)"))
    return place.groupBy("name", F.when(F.col("nth") <= cap, F.col("key")).otherwise(F.concat("name", F.lit("|overflow"))).alias("key")).agg(F.sum("value").alias("value"))


def violations(kind: Column, object_id: Column, attribute: Column, has_box: Column, supersedes: Column, observation_id: Column, lineage: Column, uncertainty_ns: Column) -> Column:
    """Which invariants of its type an observation breaks, in order."""
    found = F.array(
        F.when(uncertainty_ns < 0, "negative_uncertainty"), F.when(supersedes == observation_id, "supersedes_itself"), F.when(F.array_contains(lineage, observation_id), "descends_from_itself"),
        F.when(kind.isin("presence", "spatial", "attribute", "lifecycle") & object_id.isNull(), "no_object"), F.when((kind == "coverage") & object_id.isNotNull(), "coverage_of_an_object"),
        F.when((kind == "attribute") & attribute.isNull(), "no_attribute"), F.when(kind.isin("presence", "spatial") & ~has_box, "no_box"),
    )
    return F.array_compact(found)


def demand_status(demands: DataFrame, now_ns: int) -> DataFrame:
    """demands(demand_id, subscriber, content, registered_ns, expires_at_ns, withdrawn_ns) with status.

    Withdrawn before expired before duplicate (an earlier live one of the same
    subscriber asks the same) before active.
    """
    gone = F.when(F.col("withdrawn_ns") <= now_ns, "withdrawn").when(F.col("expires_at_ns") <= now_ns, "expired")
    live = demands.withColumn("gone", gone)
    first = F.expr("row_number() over (partition by subscriber, content, gone is null order by registered_ns, demand_id) = 1")
    return live.withColumn("first", first).select("demand_id", "subscriber", F.coalesce("gone", F.when(F.col("first"), "active").otherwise("duplicate")).alias("status"))


def duplicate_frames(frames: DataFrame, digest: str, by: str = "camera_id", order: str = "t_ns, event_id") -> DataFrame:
    """frames with `duplicate`: whether a frame shows what the one before it showed."""
    return frames.withColumn("duplicate", F.coalesce(F.expr(f"lag({digest}) over (partition by {by} order by {order})") == F.col(digest), F.lit(False)))
