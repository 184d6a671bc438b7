"""Detections, crops, calibration and projection as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONFIDENCE, MOST_DETECTIONS, CLAMP = 0.25, 300, 1e-3


def normalised(raw: DataFrame, taxonomy: DataFrame, targets: list[str], confidence: float = CONFIDENCE, most: int = MOST_DETECTIONS) -> DataFrame:
    """raw(frame, det_index, class_id, score, x1, y1, x2, y2) with verdict, resolved class and box clamped to the frame.

    In order: a class that the taxonomy(class_id, superseded_by) lacks and a box
    that leaves the frame by more than CLAMP break the contract; then a low
    score, a class not asked for, and what is beyond the `most` best of a frame.
    """
    known = raw.join(F.broadcast(taxonomy.withColumnRenamed("class_id", "known")), F.col("class_id") == F.col("known"), "left")
    resolved = F.coalesce("superseded_by", "class_id")
    beyond = F.greatest(-F.col("x1"), -F.col("y1"), F.col("x2") - 1, F.col("y2") - 1, F.lit(0.0))
    asked = F.lit(False)
    for t in targets:
        asked = asked | (resolved == t) | resolved.startswith(f"{t}.")
    verdict = F.when(F.col("known").isNull(), "unknown_class").when(beyond > CLAMP, "box_outside").when(F.col("score") < confidence, "below_threshold").when(~asked, "not_requested").otherwise("kept")
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(c))).alias(c)
    judged = known.select("frame", "det_index", resolved.alias("class_id"), "score", verdict.alias("verdict"), (beyond > 0).alias("clamped"), *(unit(c) for c in ("x1", "y1", "x2", "y2")))
    # a frame's detections are what one picture holds
    nth = judged.withColumn("nth", F.when(F.col("verdict") == "kept", F.expr("row_number() over (partition by frame, verdict = 'kept' order by score desc, det_index)")))
    return nth.withColumn("verdict", F.when(F.col("nth") > most, "beyond_limit").otherwise(F.col("verdict"))).drop("nth")


def crowding(boxes: DataFrame) -> DataFrame:
    """(frame, det_index, crowding): the largest share of a box that another of its frame covers; none without area."""
    a = boxes.select("frame", "det_index", "x1", "y1", "x2", "y2")
    b = boxes.select(F.col("frame").alias("f"), F.col("det_index").alias("j"), *(F.col(c).alias(f"b{c}") for c in ("x1", "y1", "x2", "y2")))
    width = F.greatest(F.lit(0.0), F.least("x2", "bx2") - F.greatest("x1", "bx1"))
    height = F.greatest(F.lit(0.0), F.least("y2", "by2") - F.greatest("y1", "by1"))
    share = width * height / F.nullif((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")), F.lit(0.0))
    both = a.join(b, (F.col("frame") == F.col("f")) & (F.col("det_index") != F.col("j")), "left")
    return both.groupBy("frame", "det_index").agg(F.coalesce(F.max(share), F.lit(0.0)).alias("crowding"))


def strictest(attributes: Column, thresholds: list[tuple[str, float]], default: float) -> Column:
    """Of the thresholds that the attributes declare the one of the largest least scale, else the default."""
    declared = F.array(*(F.struct(F.lit(least).cast("double").alias("least"), F.lit(key).alias("key")) for key, least in thresholds))
    held = F.filter(declared, lambda t: F.array_contains(attributes, t["key"]))
    return F.coalesce(F.array_max(F.transform(held, lambda t: t["least"])), F.lit(default))


def unmet(scale: Column, truncation: Column, occlusion: Column, least_scale: float, most_truncation: float, most_occlusion: float) -> Column:
    """The first requirement that a crop fails, or null; what is not measured fails none."""
    return F.when(scale < least_scale, "scale").when(truncation > most_truncation, "truncation").when(occlusion > most_occlusion, "occlusion")


def corroborate(space: Column, class_id: Column, score: Column, native: Column, other_share: Column, rule: dict) -> Column:
    """Why a claim needs corroborating, the first reason of the rule's, or null. Another label space than the rule's is not its business."""
    sensitive = F.lit(False)
    for c in rule["classes"]:
        sensitive = sensitive | (class_id == c) | class_id.startswith(f"{c}.")
    first = F.when(sensitive, "class").when(score < rule["confidence_below"], "confidence").when(~native, "vocabulary").when(other_share > rule["instability_above"], "instability")
    return F.when(space.isin(rule["spaces"]), first)


def padded(x1: Column, y1: Column, x2: Column, y2: Column, padding: float) -> tuple[Column, Column, Column, Column]:
    """A box with a share of its size added on each side, within the frame."""
    px, py = (x2 - x1) * padding, (y2 - y1) * padding
    low, high = (lambda c: F.greatest(F.lit(0.0), c)), (lambda c: F.least(F.lit(1.0), c))
    return low(x1 - px), low(y1 - py), high(x2 + px), high(y2 + py)


def temperature(raw: Column, t: float) -> Column:
    """Logistic scaling of a score, which is kept from 0 and 1 by a millionth."""
    p = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), raw))
    return 1 / (1 + F.exp(-F.ln(p / (1 - p)) / t))


def piecewise(raw: Column, knots: list[tuple[float, float]]) -> Column:
    """Linear between knots that ascend, constant beyond them."""
    out = F.when(raw <= knots[0][0], F.lit(knots[0][1])).when(raw >= knots[-1][0], F.lit(knots[-1][1]))
    for (x0, y0), (x1, y1) in zip(knots, knots[1:], strict=False):
        out = out.when(raw <= x1, F.lit(y0) + (raw - x0) / (x1 - x0) * (y1 - y0) if x1 > x0 else F.lit(y1))
    return out


def projected(x: Column, y: Column, m: list[list[float]]) -> tuple[Column, Column]:
    """A point on the ground by a homography; none on the horizon or where the matrix has no inverse."""
    det = m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])
    w = x * m[2][0] + y * m[2][1] + m[2][2]
    sound = (F.abs(w) >= 1e-12) & F.lit(abs(det) >= 1e-10)
    return F.when(sound, (x * m[0][0] + y * m[0][1] + m[0][2]) / w), F.when(sound, (x * m[1][0] + y * m[1][1] + m[1][2]) / w)


def ground_ellipse(gx: Column, gy: Column, at_unit: float, suspect: Column) -> tuple[Column, Column]:
    """Half axes of a ground point's uncertainty: it grows with distance, threefold where the calibration is suspect."""
    major = at_unit * F.greatest(F.lit(1.0), F.sqrt(gx * gx + gy * gy)) * F.when(suspect, 3.0).otherwise(1.0)
    return major, major * 0.6


def association_confidence(cost: Column, runner_up: Column) -> Column:
    """One less the cost, by the margin over the runner-up: full from 0.3 on."""
    base = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - cost))
    return F.when(runner_up.isNull(), base).otherwise(base * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.greatest(F.lit(0.0), runner_up - cost) / 0.3)))


def head_point(points: Column, threshold: float = 0.5) -> Column:
    """struct(state, x, y, best) of keypoints (x, y, c): the mean of those sure enough, by their confidence."""
    seen = F.filter(points, lambda p: p["c"] >= threshold)
    best = F.array_max(F.transform(points, lambda p: p["c"]))
    total = lambda f: F.aggregate(seen, F.lit(0.0), lambda acc, p: acc + f(p))
    weight = F.nullif(total(lambda p: p["c"]), F.lit(0.0))
    state = F.when(F.size(seen) > 0, "located").when(best >= threshold / 2, "low_confidence").otherwise("not_located")
    return F.struct(state.alias("state"), (total(lambda p: p["x"] * p["c"]) / weight).alias("x"), (total(lambda p: p["y"] * p["c"]) / weight).alias("y"), best.alias("best"))
