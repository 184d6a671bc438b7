"""Offline evaluation: confusion, rates and failures by state, totals, run comparison, splits, lint of annotations, quality gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(pairs: DataFrame) -> DataFrame:
    """Counts of (attribute, truth, predicted); no prediction is `<none>`."""
    return pairs.groupBy("attribute", "truth", F.coalesce("predicted", F.lit("<none>")).alias("predicted")).agg(F.count("*").alias("n"))


def scores(pairs: DataFrame, states: tuple[str, ...]) -> DataFrame:
    """Precision (null if never predicted), recall (null without support) and F1 (null if either is, or both are 0) of each state."""
    side = lambda c: F.transform(F.array(*(F.lit(s) for s in states)), lambda s: F.struct(s.alias("state"), F.coalesce(F.col("truth") == s, F.lit(False)).alias("t"), F.coalesce(F.col("predicted") == s, F.lit(False)).alias("p")))  # noqa: E731, ARG005
    rows = pairs.select("attribute", F.explode(side(None)).alias("s")).select("attribute", "s.*")
    counted = rows.groupBy("attribute", "state").agg(F.count_if(F.col("t") & F.col("p")).alias("tp"), F.count_if(F.col("p")).alias("n_predicted"), F.count_if(F.col("t")).alias("support"))
    p, r = F.col("tp") / F.nullif("n_predicted", F.lit(0)), F.col("tp") / F.nullif("support", F.lit(0))
    rated = counted.withColumn("precision", p).withColumn("recall", r)
    f1 = 2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0))
    return rated.select("attribute", "state", "tp", "support", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"), F.round(f1, 9).alias("f1"))


def split_sides(frames: DataFrame, key: str, test: list[str], validation: list[str]) -> DataFrame:
    """Each frame's side by its group; a group named on both sides is an error."""
    if both := set(test) & set(validation):
        raise ValueError(f"groups on two sides: {sorted(both)}")
    return frames.withColumn("side", F.when(F.col(key).isin(test), "test").when(F.col(key).isin(validation), "validation").otherwise("train"))


def best_class(evidence: DataFrame) -> DataFrame:
    """Each object's class of most weight (ties: the smaller id) with its share; negative weights count as 0."""
    w = evidence.groupBy("object_id", "class_id").agg(F.sum(F.greatest("weight", F.lit(0.0))).alias("w"))
    ranked = w.withColumn("rank", F.expr("row_number() over (partition by object_id order by round(w, 9) desc, class_id)")).withColumn("total", F.expr("sum(w) over (partition by object_id)"))
    return ranked.where("rank = 1").select("object_id", "class_id", F.round(F.col("w") / F.nullif("total", F.lit(0.0)), 6).alias("share"))


#: Gates of a crop, fixed values: least height in pixels and most of the other grades.
GATES = {"scale": 48.0, "truncation": 0.5, "occlusion": 0.7, "crowding": 0.9, "blur": 0.85}


def quality_reason(scale: Column, truncation: Column, occlusion: Column, crowding: Column, blur: Column, exposure: Column, overall: Column, gates: dict[str, float] = GATES) -> Column:
    """The first gate that a crop fails, else `pass`; a null grade fails none."""
    return (
        F.when(scale <= 0, "no_area").when(scale < gates["scale"], "too_small").when(truncation > gates["truncation"], "truncated").when(occlusion > gates["occlusion"], "occluded").when(crowding > gates["crowding"], "occluded")
        .when(blur > gates["blur"], "blurred").when(exposure.isin("under", "over"), "exposure").when(overall == "insufficient", F.when(scale.isNull(), "too_small").otherwise("no_area")).otherwise("pass")
    )


def quality_level(scale: Column, truncation: Column, occlusion: Column, blur: Column, exposure: Column, good_scale: float = 96.0, gates: dict[str, float] = GATES) -> Column:
    """The verdict of the worst grade; without blur or exposure it is `good` at best."""
    bad = (scale < gates["scale"]) | (truncation > gates["truncation"]) | (occlusion > gates["occlusion"]) | F.coalesce(blur > gates["blur"], F.lit(False))
    fair = (scale < good_scale) | (truncation > gates["truncation"] / 2) | (occlusion > gates["occlusion"] / 2) | F.coalesce(blur > gates["blur"] / 2, F.lit(False)) | F.coalesce(exposure.isin("under", "over"), F.lit(False))
    best = blur.isNotNull() & exposure.isNotNull() & (blur < gates["blur"] / 4)
    return F.when(bad, "insufficient").when(fair, "marginal").when(best, "excellent").otherwise("good")


DECIDED = ("PRESENT", "ABSENT")
#: What a recorded gate says of a failure, in the order asked: fixed values.
GATE_CATEGORIES = (("too_blurry", "motion_blur"), ("too_small", "low_resolution"), ("too_occluded", "occlusion"), ("too_truncated", "truncation"), ("degenerate", "crop_failure"))


def category(truth: Column, predicted: Column, quality: Column, skip: Column, model_used: Column) -> Column:
    """The stage that a wrong answer is laid to: what a gate recorded, else what the two states say."""
    out = None
    for token, name in GATE_CATEGORIES:
        seen = F.contains(F.coalesce(quality, F.lit("")), F.lit(token)) | F.contains(F.coalesce(skip, F.lit("")), F.lit(token))
        out = F.when(seen, name) if out is None else out.when(seen, name)
    read, said = truth.isin(*DECIDED), predicted.isin(*DECIDED)
    return out.when((truth == "NOT_VISIBLE") & said, "unknown_handling_failure").when(read & (predicted == "NOT_VISIBLE"), "semantic_model_failure").when(read & said, F.when(model_used, "vlm_failure").otherwise("semantic_model_failure")).otherwise("unknown_failure_reason")


def attribute_reports(rows: DataFrame) -> DataFrame:
    """By attribute: matched, correct, accuracy (null without matches), share of answers that refuse, claims on what the annotator could not see, missing answers.

    rows(attribute, truth, predicted, matched); a matched row without an answer is missing.
    """
    m = F.col("matched")
    agg = rows.groupBy("attribute").agg(
        F.count_if(m).alias("matched"), F.count_if(m & (F.col("truth") == F.col("predicted"))).alias("correct"), F.count_if(m & (F.col("predicted") == "NOT_VISIBLE")).alias("refused"),
        F.count_if(m & (F.col("truth") == "NOT_VISIBLE") & F.col("predicted").isin(*DECIDED)).alias("unsupported_claims"), F.count_if(m & F.col("predicted").isNull()).alias("missing"),
    )
    share = lambda c: F.round(F.col(c) / F.nullif("matched", F.lit(0)), 9)
    return agg.select("attribute", "matched", "correct", share("correct").alias("accuracy"), share("refused").alias("not_visible_rate"), "unsupported_claims", "missing")


def totals(rows: DataFrame, frames: DataFrame, spurious: DataFrame) -> DataFrame:
    """One row: frames, annotated, matched and unmatched subjects, spurious predictions, recall, calls by 1000 frames and by person."""
    a = rows.agg(F.count("*").alias("annotated"), F.count_if("matched").alias("matched"), F.count_if(~F.col("matched")).alias("unmatched"))
    b = frames.agg(F.count("*").alias("frames"), F.sum("calls").alias("calls"))
    c = spurious.agg(F.count("*").alias("spurious"))
    one = a.join(b).join(c)  # a row each
    per = lambda x, y: F.round(F.col(x) / F.nullif(y, F.lit(0)), 9)
    return one.select("frames", "annotated", "matched", "unmatched", "spurious", per("matched", "annotated").alias("detection_recall"), F.round(F.col("calls") * 1000 / F.nullif("frames", F.lit(0)), 9).alias("calls_per_1000_frames"), per("calls", "matched").alias("calls_per_person"))


def compared(runs: DataFrame, tags: list[str]) -> DataFrame:
    """runs(run, metric, value) as a row a metric with a column a run."""
    return runs.groupBy("metric").pivot("run", tags).agg(F.first("value"))


def lint(people: DataFrame, attributes: list[str]) -> DataFrame:
    """All issues of annotations people(frame_id, frame_row, source, person_id, visibility, attribute, state, observability, note), a row a noted attribute.

    (frame_id, person_id, attribute, issue), each as often as it occurs.
    """
    known, decided = F.col("attribute").isin(attributes), F.col("state").isin(*DECIDED)
    frames = people.select("frame_id", "frame_row", "source").distinct()
    persons = people.groupBy("frame_id", "frame_row", "person_id", "person_row").agg(F.max("visibility").alias("visibility"), F.count("attribute").alias("noted"))
    none = F.lit("")
    later = lambda by, order: F.expr(f"row_number() over (partition by {by} order by {order}) > 1")
    of_frame = lambda df, issue: df.select("frame_id", none.alias("person_id"), none.alias("attribute"), F.lit(issue).alias("issue"))
    of_person = lambda df, issue: df.select("frame_id", "person_id", none.alias("attribute"), F.lit(issue).alias("issue"))
    of_entry = lambda df, issue: df.select("frame_id", "person_id", "attribute", F.lit(issue).alias("issue"))
    noted = people.where(F.col("attribute").isNotNull())
    unseen = ~F.coalesce(F.col("observability").isin("observable", "partially_observable"), F.lit(False))
    return (
        of_frame(frames.withColumn("again", later("frame_id", "frame_row")).where("again"), "duplicate_frame").unionByName(of_frame(frames.where(F.col("source") != "human_visual_inspection"), "non_human_annotation"))
        .unionByName(of_person(persons.where(F.col("person_id") == ""), "missing_person_id")).unionByName(of_person(persons.withColumn("again", later("frame_id, frame_row, person_id", "person_row")).where("again"), "duplicate_person"))
        .unionByName(of_entry(noted.where(~known), "unknown_attribute")).unionByName(of_entry(noted.where(decided & unseen), "decided_state_without_observability"))
        .unionByName(of_entry(noted.where((F.col("state") == "NOT_VISIBLE") & (F.col("observability") == "observable") & (F.coalesce("note", none) == "")), "unexplained_refusal"))
        .unionByName(of_person(persons.where((F.col("visibility") == "not_visible") & (F.col("noted") > 0)), "ppe_on_invisible_person"))
    )
