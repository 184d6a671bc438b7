"""Joins in space and time: regions, as-of lookup, neighbours, re-entry, greedy matching."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from witnesslake.functions import boxes, geometry
from witnesslake.operators import ordered

TOLERANCE_NS = 30 * 10**9


def in_regions(obs: DataFrame, regions: DataFrame) -> DataFrame:
    """Observations with each region that holds their bottom centre; regions are few and broadcast after a bounding-box test."""
    xs, ys = F.transform("vertices", lambda v: v["x"]), F.transform("vertices", lambda v: v["y"])
    boxed = regions.select("region_id", "vertices", F.array_min(xs).alias("rx1"), F.array_max(xs).alias("rx2"), F.array_min(ys).alias("ry1"), F.array_max(ys).alias("ry2"))
    points = obs.withColumn("px", (F.col("x1") + F.col("x2")) / 2).withColumn("py", F.col("y2"))
    near = points.join(F.broadcast(boxed), F.col("px").between(F.col("rx1"), F.col("rx2")) & F.col("py").between(F.col("ry1"), F.col("ry2")))
    return near.where(geometry.in_polygon(F.col("px"), F.col("py"), F.col("vertices"))).drop("vertices", "rx1", "rx2", "ry1", "ry2")


def occupancy(inside: DataFrame, regions: DataFrame, now_ns: int) -> DataFrame:
    """Each region's objects whose latest observation is in it, with longest and mean dwell; empty regions too."""
    present = inside.groupBy("region_id", "object_id").agg(F.max("t_ns").alias("last"), F.min("t_ns").alias("first"))
    counted = present.groupBy("region_id").agg(F.count("*").alias("n_objects"), F.max(F.lit(now_ns) - F.col("first")).alias("max_dwell_ns"), F.floor(F.avg((F.lit(now_ns) - F.col("first")).cast("double") / 10**9)).alias("mean_dwell_s"))
    return regions.select("region_id").join(counted, "region_id", "left").select("region_id", F.coalesce("n_objects", F.lit(0)).alias("n_objects"), F.coalesce("max_dwell_ns", F.lit(0)).alias("max_dwell_ns"), F.coalesce("mean_dwell_s", F.lit(0)).alias("mean_dwell_s"))


def region_visits(obs: DataFrame, regions: DataFrame, region_id: str) -> DataFrame:
    """An object's stays in a region: runs of observations inside, with entry, exit (the next outside) and dwell."""
    one = F.broadcast(regions.where(F.col("region_id") == region_id).select("region_id", "vertices").limit(1))  # a row
    within = geometry.in_polygon((F.col("x1") + F.col("x2")) / 2, F.col("y2"), F.col("vertices"))
    marked = obs.select("observation_id", "object_id", "t_ns", "x1", "x2", "y2", F.lit(region_id).alias("region_id")).join(one, "region_id", "left").select("observation_id", "object_id", "t_ns", F.coalesce(within, F.lit(False)).alias("inside"))
    order = "over (partition by object_id order by t_ns, observation_id)"
    edges = marked.withColumn("before", F.expr(f"lag(inside) {order}")).where("inside <> coalesce(before, false)")
    return edges.withColumn("exit_ns", F.expr(f"lead(t_ns) {order}")).where("inside").select("object_id", F.col("t_ns").alias("enter_ns"), "exit_ns", (F.col("exit_ns") - F.col("t_ns")).alias("dwell_ns"))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], tolerance_ns: int | None = TOLERANCE_NS) -> DataFrame:
    """Each left row with the newest right row of its keys at or before its time and within the tolerance.

    Both sides are one stream in the order of time, in which the last right row
    is carried forward: one shuffle, no pairs. Right rows at the left's own time count.
    """
    carried = F.struct(F.col("t_ns").alias("t_ns"), F.col("ref").alias("ref"))
    both = left.select(*keys, "t_ns", F.col("ref").alias("l_ref"), F.lit(None).cast("struct<t_ns:bigint,ref:string>").alias("r")).withColumn("side", F.lit(1)).unionByName(right.select(*keys, "t_ns", F.lit(None).cast("string").alias("l_ref"), carried.alias("r")).withColumn("side", F.lit(0)))
    both = both.withColumn("r_ref", F.col("r.ref"))
    held = ordered.carried(both, keys, ["side", "r_ref"], "r").where("side = 1")
    near = F.lit(True) if tolerance_ns is None else F.col("t_ns") - F.col("found.t_ns") <= tolerance_ns
    return held.select(*keys, "t_ns", F.col("l_ref").alias("ref"), F.when(near, F.col("found.ref")).alias("found_ref"))


def frame_neighbours(obs: DataFrame) -> DataFrame:
    """Each observation with those of its camera just before and after it."""
    return ordered.neighbours(obs.select("camera_id", "t_ns", "observation_id"), "camera_id", "observation_id", "observation_id").select("camera_id", "observation_id", "previous", "next")


#: Least score of a re-entry, and the margin below which the best one is ambiguous: fixed values.
REENTRY_SCORE, REENTRY_MARGIN = 0.3, 0.15


def reentries(lost: DataFrame, seen: DataFrame, most_ns: int, most_distance: float) -> DataFrame:
    """Arrivals that may continue a lost object of the same camera and class, near in time and space: the best one with its score and margin.

    Without a score of REENTRY_SCORE there is none; one that is hardly better
    than the next is ambiguous and matches nothing. Time is cut into steps of
    `most_ns`, so an arrival meets only its own step and the one before.
    """
    step = lambda c: F.floor(F.col(c) / most_ns)
    l = lost.select(F.col("object_id").alias("lost_id"), "camera_id", "class_id", F.col("last_ns").alias("lost_ns"), F.col("x").alias("lx"), F.col("y").alias("ly"), F.explode(F.array(step("last_ns"), step("last_ns") + 1)).alias("step"))
    s = seen.withColumn("step", step("first_ns"))
    pairs = l.join(s, ["camera_id", "class_id", "step"]).where((F.col("first_ns") > F.col("lost_ns")) & (F.col("first_ns") - F.col("lost_ns") <= most_ns) & (F.col("lost_id") != F.col("object_id")))
    distance = F.sqrt(F.pow(F.col("lx") - F.col("x"), 2) + F.pow(F.col("ly") - F.col("y"), 2))
    scored = pairs.withColumn("d", distance).where(F.col("d") <= most_distance).withColumn("score", (1 - F.col("d") / most_distance) * (1 - (F.col("first_ns") - F.col("lost_ns")).cast("double") / most_ns)).where(F.col("score") >= REENTRY_SCORE)
    order = "over (partition by object_id, first_ns order by score desc, lost_id)"
    best = scored.withColumn("rank", F.expr(f"row_number() {order}")).withColumn("margin", F.col("score") - F.expr(f"lead(score) {order}")).where("rank = 1")
    ambiguous = F.coalesce(F.col("margin") < REENTRY_MARGIN, F.lit(False))
    return best.select("object_id", "first_ns", F.when(~ambiguous, F.col("lost_id")).alias("matched"), ambiguous.alias("ambiguous"), F.round("score", 6).alias("score"), F.round("margin", 6).alias("margin"))


def greedy_match(truth: DataFrame, predicted: DataFrame, least: float = 0.5) -> DataFrame:
    """In each frame every truth, in order, takes the free prediction of strictly largest IoU, if that reaches `least`.

    The choice depends on those before, so frames are gone through one by one.
    """
    fields = ["frame", "subject", *boxes.CORNERS]
    both = truth.select(*fields, F.lit(0).alias("side")).unionByName(predicted.select(*fields, F.lit(1).alias("side")))

    def match(frame: pd.DataFrame) -> pd.DataFrame:
        t, p = frame[frame["side"] == 0], frame[frame["side"] == 1]
        iou, names = boxes.iou_matrix(t[boxes.CORNERS].to_numpy(), p[boxes.CORNERS].to_numpy()), p["subject"].to_numpy()
        free, matched, most = np.ones(len(p), bool), [], []
        for row in iou:
            left = np.where(free, row, 0.0)
            j = int(left.argmax()) if len(left) else -1
            most.append(float(left[j]) if j >= 0 else 0.0)
            hit = j >= 0 and most[-1] > 0 and most[-1] >= least
            matched.append(names[j] if hit else None)
            if hit:
                free[j] = False
        return pd.DataFrame({"frame": t["frame"], "subject": t["subject"], "matched": pd.Series(matched, index=t.index, dtype=object), "iou": pd.Series(most, index=t.index, dtype=float)})

    return boxes.by_frame(both, ["side", "subject"], match, "frame string, subject string, matched string, iou double")


def suppress_overlaps(detections: DataFrame, most: float = 0.45) -> DataFrame:
    """Greedy class-wise non-maximum suppression in each frame: by score, then index; what overlaps a kept one by `most` or more goes."""

    def keep(frame: pd.DataFrame) -> pd.DataFrame:
        near = boxes.iou_matrix(*[frame[boxes.CORNERS].to_numpy()] * 2) >= most
        near &= frame["class_id"].to_numpy()[:, None] == frame["class_id"].to_numpy()[None]
        kept = np.zeros(len(frame), bool)
        for i in range(len(frame)):
            kept[i] = not (near[i] & kept).any()
        return frame.loc[kept, ["frame", "det_index"]]

    return boxes.by_frame(detections.select("frame", "det_index", "class_id", "score", *boxes.CORNERS), [F.desc("score"), "det_index"], keep, "frame string, det_index long")
