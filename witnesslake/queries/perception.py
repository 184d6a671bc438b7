"""Detections, crops, calibration, projection and association."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from witnesslake.catalog import _log, _obs, query
from witnesslake.functions import geometry
from witnesslake.operators import perception
from witnesslake.sources.views import table

_DET = """, det as (select camera_id || '/' || (log_position // 25) as frame, event_id as det_index, case k % 9 when 0 then 'unheard' when 1 then 'lorry' else class_id end as class_id, (k % 20) / 20.0::double as score, x1, y1, x2 + case k % 10 when 3 then 0.0005 when 7 then 0.2 else 0 end::double as x2, y2 from obs)"""


def _detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    frame = F.concat(F.col("camera_id"), F.lit("/"), F.expr("log_position div 25"))
    found = F.when(k % 9 == 0, "unheard").when(k % 9 == 1, "lorry").otherwise(F.col("class_id"))
    over = F.when(k % 10 == 3, 0.0005).when(k % 10 == 7, 0.2).otherwise(0.0)
    return _log(spark, sf_dir).select(frame.alias("frame"), F.col("event_id").alias("det_index"), found.alias("class_id"), (k % 20 / F.lit(20.0)).alias("score"), "x1", "y1", (F.col("x2") + over).alias("x2"), "y2")


def _taxonomy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("person", None), ("person.child", None), ("vehicle", None), ("vehicle.forklift", None), ("lorry", "vehicle.truck")], "class_id string, superseded_by string")


@query(f"""{_DET}, t as (select *, case class_id when 'unheard' then null when 'lorry' then 'vehicle.truck' else class_id end as r, greatest(-x1, -y1, x2 - 1, y2 - 1, 0) as beyond from det),
    v as (select *, case when r is null then 'unknown_class' when beyond > 0.001 then 'box_outside' when score < 0.25 then 'below_threshold' when not (r = 'vehicle' or starts_with(r, 'vehicle.') or r = 'person.child') then 'not_requested' else 'kept' end as verdict from t),
    n as (select *, row_number() over (partition by frame, verdict = 'kept' order by score desc, det_index) as nth from v)
    select det_index, coalesce(r, class_id) as class_id, case when verdict = 'kept' and nth > 3 then 'beyond_limit' else verdict end as verdict, beyond > 0 as clamped, round(least(1, x2), 9) as x2 from n""")
def detections_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract, thresholds, requested classes and the best few of each frame."""
    got = perception.normalised(_detections(spark, sf_dir), _taxonomy(spark), ["vehicle", "person.child"], most=3)
    return got.select("det_index", "class_id", "verdict", "clamped", F.round("x2", 9).alias("x2"))


@query(f"""{_DET} select a.det_index, round(coalesce(max(greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) / ((a.x2 - a.x1) * (a.y2 - a.y1))), 0), 6) as crowding from det a left join det b on a.frame = b.frame and a.det_index <> b.det_index group by a.det_index""")
def crowding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perception.crowding(_detections(spark, sf_dir)).select("det_index", F.round("crowding", 6).alias("crowding"))


@query("select event_id, coalesce(list_max(list_filter([case when k % 2 = 0 then 64.0 end, case when k % 3 = 0 then 96.0 end, case when k % 5 = 0 then 128.0 end], lambda x: x is not null)), 48)::double as least_scale from obs")
def strictest_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The floor of a crop that serves several attributes."""
    k = F.col("k")
    asked = F.array_compact(F.array(F.when(k % 2 == 0, "posture"), F.when(k % 3 == 0, "headwear"), F.when(k % 5 == 0, "gloves"), F.lit("colour")))
    return _obs(spark, sf_dir).select("event_id", perception.strictest(asked, [("posture", 64), ("headwear", 96), ("gloves", 128)], 48.0).alias("least_scale"))


@query("select event_id, case when k % 4 > 0 and value < 60 then 'scale' when (k % 11) / 10.0::double > 0.4 then 'truncation' when k % 3 > 0 and (k % 7) / 6.0::double > 0.6 then 'occlusion' end as unmet from obs")
def crop_requirement(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    return _obs(spark, sf_dir).select("event_id", perception.unmet(F.when(k % 4 > 0, F.col("value")), k % 11 / F.lit(10.0), F.when(k % 3 > 0, k % 7 / F.lit(6.0)), 60, 0.4, 0.6).alias("unmet"))


@query("select event_id, case when k % 3 = 2 then null when class_id = 'person' or starts_with(class_id, 'person.') then 'class' when (k % 10) / 10.0::double < 0.3 then 'confidence' when k % 7 = 0 then 'vocabulary' when (k % 9) / 9.0::double > 0.5 then 'instability' end as reason from obs")
def corroboration_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    space = F.when(k % 3 == 2, "native").otherwise("closed_set")
    rule = {"spaces": ["closed_set"], "classes": ["person"], "confidence_below": 0.3, "instability_above": 0.5}
    return _obs(spark, sf_dir).select("event_id", perception.corroborate(space, F.col("class_id"), k % 10 / F.lit(10.0), k % 7 != 0, k % 9 / F.lit(9.0), rule).alias("reason"))


@query("""select event_id, round(greatest(0, x1 - 0.15 * (x2 - x1)), 9) as x1, round(greatest(0, y1 - 0.15 * (y2 - y1)), 9) as y1, round(least(1, x2 + 0.15 * (x2 - x1)), 9) as x2, round(least(1, y2 + 0.15 * (y2 - y1)), 9) as y2, round((y2 - y1) * 1080, 6) as scale_pixels from obs""")
def crop_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = _obs(spark, sf_dir)
    box = perception.padded(*(F.col(c) for c in ("x1", "y1", "x2", "y2")), 0.15)
    return obs.select("event_id", *(F.round(b, 9).alias(c) for b, c in zip(box, ("x1", "y1", "x2", "y2"), strict=True)), F.round((F.col("y2") - F.col("y1")) * 1080, 6).alias("scale_pixels"))


#: The part of a body that shows an attribute.
PARTS = {"a0": "head", "a1": "head", "a2": "hands", "a3": "torso"}


@query("select object_id, coalesce(case when attr_key in ('a0', 'a1') then 'head' when attr_key = 'a2' then 'hands' when attr_key = 'a3' then 'torso' end, 'whole') as part, string_agg(attr_key, ',' order by attr_key) as attributes from held group by 1, 2")
def evidence_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of one part are asked of one crop."""
    part = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in PARTS.items() for x in kv)), F.col("attr_key")), F.lit("whole"))
    held = _obs(spark, sf_dir).where("kind = 'attribute'").select("object_id", "attr_key").distinct()
    return held.groupBy("object_id", part.alias("part")).agg(F.array_join(F.array_sort(F.collect_list("attr_key")), ",").alias("attributes"))  # a few keys


@query("""with r as (select event_id, (event_id % 101) / 100.0::double as raw from events), p as (select event_id, raw, least(1 - 1e-6, greatest(1e-6, raw)) as b from r)
    select event_id, round(1 / (1 + exp(-ln(b / (1 - b)) / 1.7)), 9) as by_temperature, round(case when raw <= 0.1 then 0.05 when raw >= 0.9 then 0.8 when raw <= 0.5 then 0.05 + (raw - 0.1) / 0.4 * 0.25 else 0.3 + (raw - 0.5) / 0.4 * 0.5 end, 9) as by_knots from p""")
def calibrated_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 101 / F.lit(100.0)).alias("raw"))
    return e.select("event_id", F.round(perception.temperature(F.col("raw"), 1.7), 9).alias("by_temperature"), F.round(perception.piecewise(F.col("raw"), [(0.1, 0.05), (0.5, 0.3), (0.9, 0.8)]), 9).alias("by_knots"))


HOMOGRAPHY = [[4.0, 0.5, -1.0], [0.2, 6.0, 0.3], [0.1, -1.2, 1.2]]


@query(""", p as (select event_id, k, (x1 + x2) / 2 as x, y2 as y from obs), w as (select *, x * 0.1::double + y * -1.2::double + 1.2::double as w from p), g as (select event_id, k, case when abs(w) >= 1e-12 then (x * 4.0::double + y * 0.5::double + -1.0::double) / w end as gx, case when abs(w) >= 1e-12 then (x * 0.2::double + y * 6.0::double + 0.3::double) / w end as gy from w)
    select event_id, round(gx, 6) as gx, round(gy, 6) as gy, round(0.05 * greatest(1, sqrt(gx * gx + gy * gy)) * case when k % 5 = 0 then 3 else 1 end, 6) as semi_major, round(0.05 * greatest(1, sqrt(gx * gx + gy * gy)) * case when k % 5 = 0 then 3 else 1 end * 0.6, 6) as semi_minor from g""")
def ground_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bottom centres on the ground with their uncertainty."""
    gx, gy = perception.projected((F.col("x1") + F.col("x2")) / 2, F.col("y2"), HOMOGRAPHY)
    g = _obs(spark, sf_dir).select("event_id", (F.col("k") % 5 == 0).alias("suspect"), gx.alias("gx"), gy.alias("gy"))
    major, minor = perception.ground_ellipse(F.col("gx"), F.col("gy"), 0.05, F.col("suspect"))
    return g.select("event_id", *(F.round(c, 6).alias(n) for c, n in ((F.col("gx"), "gx"), (F.col("gy"), "gy"), (major, "semi_major"), (minor, "semi_minor"))))


_MOVE = "over (partition by object_id order by t_ns, event_id)"


@query(f""", p as (select object_id, event_id, t_ns, (x1 + x2) / 2 as x, lag((x1 + x2) / 2) {_MOVE} as px, lag(t_ns) {_MOVE} as pt from obs where kind = 'spatial')
    select event_id, round(x + (x - px) / ((t_ns - pt) / 1e9::double) * 2, 6) as x, 0.02::double * 2 as sigma from p where t_ns > pt""")
def linear_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where an object's last two points lead in two seconds, and how sure that is."""
    p = _obs(spark, sf_dir).where("kind = 'spatial'").withColumn("x", (F.col("x1") + F.col("x2")) / 2)
    p = p.select("event_id", "t_ns", "x", F.expr(f"lag(x) {_MOVE}").alias("px"), F.expr(f"lag(t_ns) {_MOVE}").alias("pt")).where("t_ns > pt")
    speed = (F.col("x") - F.col("px")) / ((F.col("t_ns") - F.col("pt")) / F.lit(1e9))
    return p.select("event_id", F.round(F.col("x") + speed * 2, 6).alias("x"), F.lit(0.02 * 2).alias("sigma"))


_NEXT = """, pair as (select a.observation_id as a_id, b.observation_id as b_id, b.log_position - a.log_position as step, a.x1 as ax1, a.y1 as ay1, a.x2 as ax2, a.y2 as ay2, b.x1 as bx1, b.y1 as by1, b.x2 as bx2, b.y2 as by2 from obs a join obs b on a.camera_id = b.camera_id and b.log_position in (a.log_position + 1, a.log_position + 2)),
    m as (select *, greatest(least(ax2, bx2) - greatest(ax1, bx1), 0) * greatest(least(ay2, by2) - greatest(ay1, by1), 0) as i, (ax2 - ax1) * (ay2 - ay1) as p, (bx2 - bx1) * (by2 - by1) as q from pair),
    c as (select a_id, step, 0.6 * (1 - i / (p + q - i)) + 0.25 * least(1, sqrt(pow((ax1 + ax2 - bx1 - bx2) / 2, 2) + pow((ay1 + ay2 - by1 - by2) / 2, 2)) / sqrt(2)) + 0.15 * (1 - least(p, q) / greatest(p, q)) as cost from m)"""


@query(f"""{_NEXT} select a.a_id, round(a.cost, 6) as cost, round(greatest(0, least(1, 1 - a.cost)) * case when b.cost is null then 1 else greatest(0, least(1, greatest(0, b.cost - a.cost) / 0.3)) end, 6) as confidence from c a left join c b on a.a_id = b.a_id and b.step = 2 where a.step = 1""")
def association_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cost of taking a camera's next box for this one, and how sure that is beside the one after it."""
    order = "over (partition by camera_id order by log_position)"
    cols = ("x1", "y1", "x2", "y2")
    p = _log(spark, sf_dir).select("observation_id", *(F.col(c).alias(f"a{c}") for c in cols), *(F.expr(f"lead({c}, {n}) {order}").alias(f"{s}{c}") for s, n in (("b", 1), ("c", 2)) for c in cols)).where("bx1 is not null")
    p = p.select(F.col("observation_id").alias("a_id"), geometry.association_cost("a", "b").alias("cost"), F.when(F.col("cx1").isNotNull(), geometry.association_cost("a", "c")).alias("other"))
    return p.select("a_id", F.round("cost", 6).alias("cost"), F.round(perception.association_confidence(F.col("cost"), F.col("other")), 6).alias("confidence"))


@query(""", p as (select event_id, [{'x': x1, 'y': y1, 'c': (k % 10) / 10.0::double}, {'x': x2, 'y': y1, 'c': (k % 7) / 10.0::double}, {'x': x1, 'y': y2, 'c': (k % 4) / 10.0::double}] as ps from obs), s as (select *, list_filter(ps, lambda p: p.c >= 0.5) as seen, list_max(list_transform(ps, lambda p: p.c)) as best from p)
    select event_id, case when len(seen) > 0 then 'located' when best >= 0.25 then 'low_confidence' else 'not_located' end as state, round(list_sum(list_transform(seen, lambda p: p.x * p.c)) / list_sum(list_transform(seen, lambda p: p.c)), 9) as x, round(list_sum(list_transform(seen, lambda p: p.y * p.c)) / list_sum(list_transform(seen, lambda p: p.c)), 9) as y from s""")
def head_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    point = lambda x, y, m: F.struct(F.col(x).alias("x"), F.col(y).alias("y"), (F.col("k") % m / F.lit(10.0)).alias("c"))
    h = _obs(spark, sf_dir).select("event_id", perception.head_point(F.array(point("x1", "y1", 10), point("x2", "y1", 7), point("x1", "y2", 4))).alias("h"))
    return h.select("event_id", "h.state", F.round("h.x", 9).alias("x"), F.round("h.y", 9).alias("y"))
