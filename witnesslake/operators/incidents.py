"""Incidents, evidence and retention as folds of event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold_incidents(events: DataFrame) -> DataFrame:
    """(org, subject, rule) event streams of open and resolve to incidents: an open while one is open repeats it.

    A resolve closes the open incident; a later open begins another. Runs between
    resolves are islands: one row each, with first, last and number of opens.
    """
    order = "over (partition by org, subject, rule_id order by at, event_id)"
    runs = events.withColumn("run", F.expr(f"coalesce(sum(case when action = 'resolve' then 1 else 0 end) {order.replace('event_id)', 'event_id rows between unbounded preceding and 1 preceding)')}, 0)"))
    folded = runs.groupBy("org", "subject", "rule_id", "run").agg(F.min(F.when(F.col("action") == "open", F.col("at"))).alias("opened_at"), F.max(F.when(F.col("action") == "open", F.col("at"))).alias("observed_at"), F.count_if(F.col("action") == "open").alias("n_opens"), F.max(F.when(F.col("action") == "resolve", F.col("at"))).alias("resolved_at"))
    return folded.where("n_opens > 0").withColumn("status", F.when(F.col("resolved_at").isNotNull(), "resolved").otherwise("active")).drop("run")


def retention(incidents: DataFrame, cutoff: str) -> DataFrame:
    """What stays: all that isn't resolved, and resolved ones not before the cutoff."""
    return incidents.where(~((F.col("status") == "resolved") & (F.col("at") < F.lit(cutoff).cast("timestamp_ntz"))))


def evidence_status(records: DataFrame, tombstones: DataFrame) -> DataFrame:
    """ERASED where a tombstone names the record, EXPIRED past its time, NOT_FOUND without bytes, else STORED."""
    t = tombstones.select(F.col("ref").alias("gone")).distinct()
    status = F.when(F.col("gone").isNotNull(), "ERASED").when(F.col("expired"), "EXPIRED").when(F.col("size") <= 0, "NOT_FOUND").otherwise("STORED")
    return records.join(t, F.col("ref") == F.col("gone"), "left").withColumn("status", status).drop("gone")


def acknowledge(incidents: DataFrame, ids: DataFrame, actor: str) -> DataFrame:
    """Active incidents of ids(incident_id) become acknowledged; acknowledged ones stay as they are, resolved ones too."""
    named = ids.select(F.col("incident_id").alias("i_")).where("i_ is not null").distinct()
    marked = incidents.join(named, F.col("incident_id") == F.col("i_"), "left")
    hit = F.col("i_").isNotNull() & (F.col("status") == "active")
    out = marked.withColumn("acknowledged_by", F.when(hit, actor).otherwise(F.col("acknowledged_by")))
    return out.withColumn("status", F.when(hit, "acknowledged").otherwise(F.col("status"))).drop("i_")


def sweep(records: DataFrame, now: str, erase: bool) -> DataFrame:
    """Records past their time are marked EXPIRED, and erased only if asked."""
    over = F.col("expires_at") <= F.lit(now).cast("timestamp_ntz")
    marked = records.withColumn("state", F.when(over, "EXPIRED").otherwise(F.col("state")))
    return marked.where("state <> 'EXPIRED'") if erase else marked


def sentence(findings: DataFrame) -> DataFrame:
    """What a finding says: failed attributes, reasons for not knowing, or that it holds."""
    said = F.when(F.col("state") == "VIOLATION", F.concat(F.col("rule_id"), F.lit(": "), F.col("n_failed").cast("string"), F.lit(" failed"))).when(F.col("state") == "UNKNOWN", F.concat(F.col("rule_id"), F.lit(": unknown ("), F.col("reasons"), F.lit(")"))).when(F.col("state") == "NOT_APPLICABLE", F.concat(F.col("rule_id"), F.lit(": not applicable"))).otherwise(F.concat(F.col("rule_id"), F.lit(": holds")))
    return findings.withColumn("sentence", said)
