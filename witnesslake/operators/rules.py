"""Three-valued rules: conditions on held attributes become findings."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from witnesslake.operators.log import covers

OPERATORS = ("eq", "ne", "in", "not_in", "gt", "gte", "lt", "lte", "present")


@dataclass(frozen=True)
class Condition:
    attribute: str
    operator: str
    value: object = None
    unknown_values: tuple[str, ...] = ()
    guard: bool = False


@dataclass(frozen=True)
class Rule:
    rule_id: str
    severity: str
    classes: tuple[str, ...]
    conditions: tuple[Condition, ...]
    max_staleness_ns: int | None = None
    cameras: tuple[str, ...] = ()
    requires: tuple[str, ...] = field(default=())


def compare(operator: str, held: Column, value: object) -> Column:
    """True, false or, where the two have no order, null. `held` is a text column, so no number equals it or has an order with it; values of all kinds are compared in functions/values.py."""
    if operator in ("gt", "gte", "lt", "lte"):
        return F.lit(None).cast("boolean")
    wanted = [v for v in (value if operator in ("in", "not_in") else (value,)) if isinstance(v, str)]
    found = held.isin(wanted) if wanted else F.when(held.isNotNull(), F.lit(False))
    return found if operator in ("eq", "in") else ~found


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """(rule_id, severity, ord, attribute, operator, guard): a row a condition."""
    rows = [(r.rule_id, r.severity, i, c.attribute, c.operator, c.guard) for r in rules for i, c in enumerate(r.conditions)]
    return spark.createDataFrame(rows, "rule_id string, severity string, ord int, attribute string, operator string, guard boolean")


def outcomes(objects: DataFrame, held: DataFrame, rules: list[Rule], now_ns: int) -> DataFrame:
    """Each condition of each rule on each object that it covers: satisfied or not, or null with a reason.

    Reasons in order: an absent attribute, an unobservable value, a stale one, a
    missing or stale corroboration, values without an order. `held` has an
    object's values one a row; they meet the object once, as a map.
    """
    value = F.struct("attr_value", "observed_at_ns", "valid_until_ns")
    maps = held.groupBy("object_id").agg(F.map_from_entries(F.collect_list(F.struct("attr_key", value.alias("v")))).alias("attrs"))
    views = objects.join(maps, "object_id", "left")
    made = []
    for rule in rules:
        covered = covers(list(rule.classes), F.col("class_id")) & (F.col("camera_id").isin(list(rule.cameras)) if rule.cameras else F.lit(True))
        for i, c in enumerate(rule.conditions):
            satisfied, reason = _assess(c, rule, now_ns)
            made.append(F.when(covered, F.struct(F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.severity).alias("severity"), F.lit(i).alias("ord"), F.lit(c.attribute).alias("attribute"), F.lit(c.guard).alias("guard"), satisfied.alias("satisfied"), reason.alias("reason"))))
    return views.select("object_id", "camera_id", "class_id", F.explode(F.filter(F.array(*made), lambda o: o.isNotNull())).alias("o")).select("object_id", "camera_id", "class_id", "o.*")


def _stale(v: Column, rule: Rule, now_ns: int) -> Column:
    over = F.coalesce(F.lit(now_ns) > v["valid_until_ns"], F.lit(False))
    return over if rule.max_staleness_ns is None else over | (F.lit(now_ns) - v["observed_at_ns"] > rule.max_staleness_ns)


def _assess(c: Condition, rule: Rule, now_ns: int) -> tuple[Column, Column]:
    v = F.element_at("attrs", F.lit(c.attribute))
    if c.operator == "present":
        return v.isNotNull(), F.lit(None).cast("string")
    unsure = F.lit(False)
    for key in rule.requires:
        other = F.element_at("attrs", F.lit(key))
        unsure = unsure | other.isNull() | F.coalesce(_stale(other, rule, now_ns), F.lit(False))
    found = compare(c.operator, v["attr_value"], c.value)
    reason = F.when(v.isNull(), "ATTRIBUTE_ABSENT").when(v["attr_value"].isin(list(c.unknown_values)) if c.unknown_values else F.lit(False), "NOT_OBSERVABLE").when(_stale(v, rule, now_ns), "ATTRIBUTE_STALE").when(unsure, "EVIDENCE_UNVERIFIED").when(found.isNull(), "VALUE_UNPARSEABLE")
    return F.when(reason.isNull(), found), reason


def findings(judged: DataFrame) -> DataFrame:
    """One row a rule and object: a false guard beats all, an unknown guard all but it; then false beats unknown."""
    guard, need = F.col("guard"), ~F.col("guard")
    some = lambda c: F.coalesce(F.max(c), F.lit(False))
    state = F.when(some(guard & (F.col("satisfied") == F.lit(False))), "NOT_APPLICABLE").when(some(guard & F.col("satisfied").isNull()), "UNKNOWN").when(some(need & (F.col("satisfied") == F.lit(False))), "VIOLATION").when(some(need & F.col("satisfied").isNull()), "UNKNOWN").otherwise("COMPLIANT")
    reasons = F.array_join(F.array_sort(F.collect_set("reason")), ",")
    return judged.groupBy("rule_id", "severity", "object_id", "camera_id").agg(state.alias("state"), F.count_if(F.col("satisfied") == F.lit(False)).alias("n_failed"), F.count_if(F.col("satisfied").isNull()).alias("n_unknown"), reasons.alias("reasons"))


def unproducible(spark: SparkSession, rules: list[Rule], producible: DataFrame) -> DataFrame:
    """(rule_id, attribute) that nothing produces."""
    return rule_table(spark, rules).select("rule_id", "attribute").distinct().join(producible.select(F.col("attr_key").alias("attribute")).distinct(), "attribute", "left_anti")


def apply_findings(found: DataFrame, observed_at: Column) -> DataFrame:
    """Incidents: a violation opens or repeats, compliance resolves, unknown changes nothing."""
    return found.where("state in ('VIOLATION', 'COMPLIANT')").withColumn("action", F.when(F.col("state") == "VIOLATION", "open").otherwise("resolve")).withColumn("observed_at", observed_at)
