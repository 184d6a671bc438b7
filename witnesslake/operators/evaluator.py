"""Rule documents evaluated: rules, conditions and values are rows, so a plan is the same for one rule or many thousands.

Rules meet the objects of their classes by a join on class, their conditions
meet what an object holds by a join on object and attribute, and an object's
outcomes under one rule are gathered, as many as the rule has conditions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from witnesslake.functions import values

#: Severities whose violations become incidents: fixed values.
RAISING = ("low", "medium", "high", "critical")
KEY = ["object_id", "now_ns", "document_id", "rule"]


def rule_rows(parsed: DataFrame) -> DataFrame:
    """A row a rule of the documents that are not refused, with its conditions (guards first) as an array."""
    rules = parsed.where("reject is null").select("document_id", F.col("version").alias("ruleset_version"), F.posexplode("rules").alias("rule", "r"))
    part = lambda name: F.transform(F.col(f"r.{name}"), lambda c, i: F.struct(F.lit(name).alias("part"), i.alias("ord"), *(c[x].alias(x) for x in ("attribute", "operator", "value", "unknown_values"))))
    own = F.col("r.classes")
    # a class below another of the list says nothing more
    widest = F.filter(own, lambda c: ~F.exists(own, lambda d: F.startswith(c, F.concat(d, F.lit(".")))))
    return rules.select(
        "document_id", "ruleset_version", "rule", "r.rule_id", F.col("r.version").alias("rule_version"), "r.severity", F.array_distinct(widest).alias("classes"), "r.cameras", (F.col("r.max_staleness_ms") * 10**6).alias("max_staleness_ns"),
        "r.requires", "r.full_coverage", F.concat(part("when"), part("require")).alias("conditions"),
    )


def class_chain(class_id: Column) -> Column:
    """A class and all above it: person.child, person."""
    parts = F.split(class_id, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))


def evaluate(rules: DataFrame, objects: DataFrame, held: DataFrame, coverage: DataFrame | None = None, gaps: DataFrame | None = None) -> DataFrame:
    """Findings of rule_rows() on objects(object_id, camera_id, class_id, now_ns), each judged at its time.

    held(object_id, now_ns, attr_key, value, observed_at_ns, valid_until_ns) has
    typed values; coverage(camera_id, fraction) and gaps(attribute) may be
    missing, and a camera without coverage counts as seen in full. One row an
    object, time and rule that covers its class and camera. Why a condition is
    unknown, in order: nothing produces the attribute, the camera was not seen in
    full where the rule asks for that, it is absent, it says that it could not be
    seen, it is stale, corroboration is missing or stale, values have no order.
    """
    keyed = rules.withColumn("class", F.explode(F.when(F.size("classes") == 0, F.array(F.lit(""))).otherwise(F.col("classes"))))
    seen = objects.select("object_id", "camera_id", "class_id", "now_ns", F.explode(F.concat(F.array(F.lit("")), F.coalesce(class_chain(F.col("class_id")), F.array().cast("array<string>")))).alias("class"))
    pairs = seen.join(keyed, "class").where((F.size("cameras") == 0) | F.array_contains("cameras", F.col("camera_id")))
    pairs = pairs.withColumn("fraction", F.lit(None).cast("double")) if coverage is None else pairs.join(coverage.select(F.col("camera_id").alias("cam_"), "fraction"), F.col("camera_id") == F.col("cam_"), "left").drop("cam_")
    none = F.lit(None)
    evidence = F.transform("requires", lambda k, i: F.struct(F.lit("evidence").alias("part"), i.alias("ord"), k.alias("attribute"), none.cast("string").alias("operator"), values.of_text(none.cast("string")).alias("value"), none.cast("array<string>").alias("unknown_values")))
    asked = pairs.withColumn("c", F.explode(F.concat("conditions", evidence))).drop("conditions", "requires", "classes", "cameras", "class").withColumn("attribute", F.col("c.attribute"))
    asked = asked.withColumn("gap", F.lit(False)) if gaps is None else asked.join(gaps.select("attribute", F.lit(True).alias("gap")).distinct(), "attribute", "left")
    answered = asked.join(held.select("object_id", "now_ns", F.col("attr_key").alias("attribute"), F.struct("value", "observed_at_ns", "valid_until_ns").alias("h")), ["object_id", "now_ns", "attribute"], "left")
    kept = ("camera_id", "class_id", "ruleset_version", "rule_id", "rule_version", "severity", "max_staleness_ns", "full_coverage", "fraction")
    listed = answered.groupBy(*KEY).agg(*(F.first(c).alias(c) for c in kept), F.collect_list(F.struct("c", "h", F.coalesce("gap", F.lit(False)).alias("gap"))).alias("all"))
    now, expired = F.col("now_ns"), lambda h: F.coalesce(F.col("now_ns") > h["valid_until_ns"], F.lit(False))
    unsure = F.exists("all", lambda x: (x["c"]["part"] == "evidence") & (x["h"].isNull() | expired(x["h"])))
    stale = lambda h: expired(h) | F.coalesce(now - h["observed_at_ns"] > F.col("max_staleness_ns"), F.lit(False))
    blind = F.col("full_coverage") & (F.coalesce("fraction", F.lit(1.0)) < 1)

    def assess(x: Column) -> Column:
        c, h = x["c"], x["h"]
        refused = F.coalesce(F.array_contains(c["unknown_values"], F.when(h["value"]["kind"] == "text", F.substring(h["value"]["key"], 3, 1 << 30))), F.lit(False))
        early = F.when(x["gap"], "CAPABILITY_GAP").when(blind, "COVERAGE_GAP")
        late = F.when(h.isNull(), "ATTRIBUTE_ABSENT").when(refused, "NOT_OBSERVABLE").when(stale(h), "ATTRIBUTE_STALE").when(F.col("unsure"), "EVIDENCE_UNVERIFIED")
        found = values.compare(c["operator"], h["value"], c["value"])
        reason = F.coalesce(early, F.when(c["operator"] != "present", F.coalesce(late, F.when(found.isNull(), "VALUE_UNPARSEABLE"))))
        satisfied = F.when(reason.isNull(), F.when(c["operator"] == "present", h.isNotNull()).otherwise(found))
        return F.struct((c["part"] == "when").alias("guard"), c["ord"].alias("ord"), c["attribute"].alias("attribute"), satisfied.alias("satisfied"), reason.alias("reason"))

    judged = listed.withColumn("unsure", unsure).withColumn("outcomes", F.array_sort(F.transform(F.filter("all", lambda x: x["c"]["part"] != "evidence"), assess)))
    some = lambda test: F.exists("outcomes", test)
    failed, open_ = lambda o: F.coalesce(~o["satisfied"], F.lit(False)), lambda o: o["satisfied"].isNull()
    state = (
        F.when(some(lambda o: o["guard"] & failed(o)), "NOT_APPLICABLE").when(some(lambda o: o["guard"] & open_(o)), "UNKNOWN").when(some(lambda o: ~o["guard"] & failed(o)), "VIOLATION")
        .when(some(lambda o: ~o["guard"] & open_(o)), "UNKNOWN").otherwise("COMPLIANT")
    )
    # a guard that doesn't hold ends the matter: the requirements aren't looked at
    judged = judged.withColumn("state", state).withColumn("looked", F.when((F.col("state") == "NOT_APPLICABLE") | some(lambda o: o["guard"] & open_(o)), F.filter("outcomes", lambda o: o["guard"])).otherwise(F.col("outcomes")))
    return judged.select(
        F.concat(F.col("rule_id"), F.lit("@"), F.col("rule_version"), F.lit(":"), F.col("object_id"), F.lit(":"), now.cast("string")).alias("finding_id"), "document_id", "ruleset_version", "rule_id", "rule_version", "severity", "object_id", "camera_id", "class_id",
        now.alias("evaluated_at_ns"), "state", F.size(F.filter("looked", failed)).alias("n_failed"), F.size(F.filter("looked", open_)).alias("n_unknown"),
        F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.transform("looked", lambda o: o["reason"])))), ",").alias("reasons"), F.coalesce("fraction", F.lit(1.0)).alias("coverage_fraction"), F.col("looked").alias("outcomes"),
    )


def incident_events(findings: DataFrame, org: Column) -> DataFrame:
    """What findings do to incidents, for incidents.fold_incidents: violations that raise open one, compliance resolves, unknown changes nothing.

    An incident's time is that of the evaluation, not of the processing.
    """
    raising = F.col("severity").isin(*RAISING) & F.col("state").isin("VIOLATION", "COMPLIANT")
    return findings.where(raising).select(org.alias("org"), F.col("object_id").alias("subject"), "rule_id", F.col("evaluated_at_ns").alias("at"), F.col("finding_id").alias("event_id"), F.when(F.col("state") == "VIOLATION", "open").otherwise("resolve").alias("action"))
