"""Rule documents and attribute schemas: what they hold, and why one is refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from witnesslake.functions import values
from witnesslake.operators.log import covers
from witnesslake.operators.rules import OPERATORS

CONDITION = "attribute string, operator string, value variant"


def _text(v: Column, path: str) -> Column:
    return F.trim(F.coalesce(F.try_variant_get(v, path, "string"), F.lit("")))


def _list(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _texts(v: Column, path: str) -> Column:
    return F.transform(_list(v, path), lambda c: F.try_variant_get(c, "$", "string"))


def _conditions(v: Column, path: str) -> Column:
    """A rule's conditions; the operator is eq where none is given."""
    return F.transform(_list(v, path), lambda c: F.struct(_text(c, "$.attribute").alias("attribute"), F.lower(F.coalesce(F.try_variant_get(c, "$.operator", "string"), F.lit("eq"))).alias("operator"), values.of_variant(F.try_variant_get(c, "$.value", "variant")).alias("value"), _texts(c, "$.unknown_values").alias("unknown_values")))


def parse(documents: DataFrame) -> DataFrame:
    """documents(document_id, body) with version, rules and reject: why the whole document is refused, or null.

    In order: no JSON, `rules` that are no list, then rule by rule an unknown
    operator, a condition without attribute or, but for `present`, without a
    value, `in` or `not_in` without a list, a rule without id, version or
    requirement, and at last an id used twice. A document without a version is
    1.0.0, one without rules is legal.
    """
    v = values.strict(F.col("body"))
    rule = lambda r: F.struct(_text(r, "$.rule_id").alias("rule_id"), _text(r, "$.version").alias("version"), F.coalesce(F.try_variant_get(r, "$.severity", "string"), F.lit("")).alias("severity"), _texts(r, "$.subject_classes").alias("classes"), _texts(r, "$.scope.camera_ids").alias("cameras"), _texts(r, "$.evidence.requires").alias("requires"), F.coalesce(F.try_variant_get(r, "$.evidence.require_full_coverage", "boolean"), F.lit(False)).alias("full_coverage"), F.try_variant_get(r, "$.evidence.max_staleness_ms", "long").alias("max_staleness_ms"), _conditions(r, "$.require").alias("require"), _conditions(r, "$.when").alias("when"))
    parsed = documents.select("document_id", v.alias("v"))
    listed = F.try_variant_get("v", "$.rules", "array<variant>")
    parsed = parsed.select("document_id", "v", listed.alias("listed"), F.try_variant_get("v", "$.rules", "variant").isNull().alias("none"))
    parsed = parsed.select("document_id", F.coalesce(F.try_variant_get("v", "$.version", "string"), F.lit("1.0.0")).alias("version"), F.col("v").isNull().alias("bad"), (F.col("listed").isNull() & ~F.col("none")).alias("odd"), F.transform(F.coalesce("listed", F.array().cast("array<variant>")), rule).alias("rules"))
    wrong = F.filter(F.transform("rules", _refused), lambda x: x.isNotNull())
    ids = F.transform("rules", lambda r: r["rule_id"])
    reject = F.when(F.col("bad"), "not_json").when(F.col("odd"), "rules_not_a_list").when(F.size(wrong) > 0, F.get(wrong, F.lit(0))).when(F.size(F.array_distinct(ids)) < F.size(ids), "duplicate_rule_id")
    return parsed.select("document_id", "version", "rules", reject.alias("reject"))


def _refused(r: Column) -> Column:
    odd = F.filter(F.transform(F.concat(r["require"], r["when"]), lambda c: F.when(~c["operator"].isin(*OPERATORS), "unknown_operator").when(c["attribute"] == "", "missing_attribute").when((c["operator"] != "present") & (c["value"]["kind"] == "null"), "missing_value").when(c["operator"].isin("in", "not_in") & (c["value"]["kind"] != "list"), "in_without_list")), lambda x: x.isNotNull())
    return F.when(F.size(odd) > 0, F.get(odd, F.lit(0))).when(r["rule_id"] == "", "missing_rule_id").when(r["version"] == "", "missing_version").when(F.size(r["require"]) == 0, "empty_require")


def conditions(parsed: DataFrame) -> DataFrame:
    """A row a condition of the documents that are not refused, in document order."""
    rules = parsed.where(F.col("reject").isNull()).select("document_id", "version", F.posexplode("rules").alias("rule", "r"))
    part = lambda name: F.transform(F.col(f"r.{name}"), lambda c, i: F.struct(F.lit(name).alias("part"), i.alias("ord"), c.alias("c")))
    flat = rules.select("document_id", "version", "rule", "r.rule_id", F.explode(F.concat(part("require"), part("when"))).alias("p"))
    return flat.select("document_id", "version", "rule", "rule_id", "p.part", "p.ord", "p.c.attribute", "p.c.operator", F.col("p.c.value.kind").alias("kind"), F.col("p.c.value.key").alias("key"))


def _range_reason(n: Column, domain: Column) -> Column:
    low, high = (F.split_part(F.get(domain, F.lit(0)), F.lit(":"), F.lit(i)).try_cast("double") for i in (1, 2))
    limited = (F.size(domain) == 1) & F.contains(F.get(domain, F.lit(0)), F.lit(":")) & low.isNotNull() & high.isNotNull()
    return F.when(limited & ~n.between(low, high), "outside_range")


def _one_reason(v: Column, value_type: Column, domain: Column) -> Column:
    """Why a single value is refused by its type, or null. A boolean is no number, a malformed range no limit."""
    kind, text = v["kind"], v["kind"] == "text"
    said = F.when(text, F.substring(v["key"], 3, 1 << 30))
    return (
        F.when((value_type == "bool") & (kind != "bool"), "expected_boolean").when((value_type == "enum") & ~text, "expected_string").when((value_type == "enum") & ~F.array_contains(domain, said), "outside_domain")
        .when((value_type == "scalar") & ~kind.isin("int", "num"), "expected_number").when((value_type == "count") & (kind != "int"), "expected_integer").when((value_type == "count") & (v["n"] < 0), "negative_count")
        .when(value_type.isin("scalar", "count"), _range_reason(v["n"], domain)).when((value_type == "text") & ~text, "expected_text")
        .when((value_type == "relation") & (~text | (said == "")), "expected_referent").when((value_type == "relation") & (F.size(domain) > 0) & ~F.array_contains(domain, said), "outside_domain")
        .when((value_type == "vector") & ((kind != "list") | (F.size(v["items"]) == 0)), "expected_vector")
    )


def type_reason(json: Column, value_type: Column, domain: Column, multi: Column) -> Column:
    """Why the value of a JSON text does not fit a schema, or null.

    A single value must be no list and a multiple one a list, all of whose items
    fit; a vector is itself a list. Components of a vector must be numbers, and
    booleans are none.
    """
    variant = values.strict(json)
    v = values.of_variant(variant)
    items = F.try_variant_get(variant, "$", "array<variant>")
    first = lambda reasons: F.get(F.filter(reasons, lambda x: x.isNotNull()), F.lit(0))
    each = first(F.transform(items, lambda x: _one_reason(values.of_variant(x), value_type, domain)))
    odd = F.exists(items, lambda x: ~F.coalesce(F.schema_of_variant(x).rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"), F.lit(False)))
    vector = F.when((v["kind"] != "list") | (F.size(v["items"]) == 0), "expected_vector").when(odd, "vector_not_numbers")
    return F.when(value_type == "vector", vector).when(multi & (v["kind"] != "list"), "expected_sequence").when(multi, each).when(v["kind"] == "list", "expected_single").otherwise(_one_reason(v, value_type, domain))


def validate_fields(answers: DataFrame, schema: DataFrame, declared: list[str]) -> DataFrame:
    """answers(answer_id, class_id, field, value as JSON text) with reason: why a field is refused, or null.

    In order: a key that is not registered, one deprecated, one that the prompt
    did not declare, a class that the attribute does not apply to, a value that
    does not fit.
    """
    joined = answers.join(F.broadcast(schema), answers["field"] == schema["key"], "left")
    applies = (F.size("applies_to") == 0) | F.exists("applies_to", lambda a: (F.col("class_id") == a) | F.startswith(F.col("class_id"), F.concat(a, F.lit("."))))
    fits = type_reason(F.col("value"), F.col("value_type"), F.col("domain"), F.col("multi"))
    reason = F.when(F.col("key").isNull(), "unregistered").when(F.col("status") == "deprecated", "deprecated").when(~F.col("field").isin(declared), "undeclared").when(~applies, "class_not_applicable").otherwise(fits)
    return joined.select("answer_id", "class_id", "field", "value", reason.alias("reason"))


# Tokens of keys that name a role, a verdict, a threshold or a business noun; keys that are verdicts; phrases of a premise.
FORBIDDEN_TOKENS = """
employee staff customer shopper visitor patient nurse doctor guard intruder trespasser suspect owner driver operator worker manager vip
compliant compliance violation violating unauthorized authorised authorized permitted forbidden illegal suspicious abnormal anomalous anomaly threat danger dangerous unsafe risky alert incident
excessive insufficient overcrowded crowded congested busy idle loitering queueing waiting delayed late overdue understaffed overstaffed
order invoice sku shift appointment booking
""".split()
FORBIDDEN_KEYS = ("is_ok", "is_good", "is_bad", "is_normal", "is_valid", "is_correct", "status")
WEAK_PHRASES = ("implies", "means", "indicates that they are", "should", "must", "policy", "rule", "requirement", "because they are", "obviously")
LEAST_JUSTIFICATION = 12


def key_tokens(key: Column) -> Column:
    return F.filter(F.split(F.lower(key), r"[_.\-]"), lambda t: t != "")


def neutrality(key: Column, justification: Column) -> Column:
    """Why an attribute's key or justification is refused, or null."""
    offending = F.sort_array(F.array_intersect(key_tokens(key), F.array(*map(F.lit, FORBIDDEN_TOKENS))))
    said = F.lower(justification)
    weak = F.lit(False)
    for phrase in WEAK_PHRASES:
        weak = weak | F.contains(said, F.lit(phrase))
    return F.when(F.size(offending) > 0, F.concat(F.lit("token:"), F.get(offending, F.lit(0)))).when(F.lower(key).isin(*FORBIDDEN_KEYS), "verdict_key").when(F.length(F.trim(justification)) < LEAST_JUSTIFICATION, "no_evidence").when(weak, "premise")


def coerce_object(raw: Column) -> Column:
    """struct(fields: map of JSON texts by key, reparsed, unparsed): a strict JSON object, else the first in prose; nothing is repaired."""
    text = F.trim(F.coalesce(raw, F.lit("")))
    inner = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    as_map = lambda t: F.when(F.schema_of_variant(values.strict(t)).startswith("OBJECT"), F.try_variant_get(values.strict(t), "$", "map<string,variant>"))
    whole, within = as_map(text), as_map(inner)
    fields = F.transform_values(F.coalesce(whole, within), lambda _, v: F.to_json(v))
    return F.struct(fields.alias("fields"), (whole.isNull() & within.isNotNull()).alias("reparsed"), F.when(whole.isNull() & within.isNull() & (text != ""), text).alias("unparsed"))


__all__ = ["conditions", "coerce_object", "covers", "key_tokens", "neutrality", "parse", "type_reason", "validate_fields"]
