"""Multi-object tracking and object lifecycles.

A tracker's answer to a frame depends on its own answers to all before it, so
frames of a camera are folded in order: Spark sends a camera's detections to one
task, sorted, and they stream through it in Arrow batches. The task holds the
tracks alive at the time, MOST_TRACKS at most, never the camera's history.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from witnesslake.functions.boxes import iou_matrix

# Weights and limits of association, frames of the track's life, the table's size.
IOU_WEIGHT, DISTANCE_WEIGHT, SCALE_WEIGHT = 0.6, 0.25, 0.15
MOST_COST, LEAST_IOU, GATE, MARGIN = 0.7, 0.1, 3.0, 0.05
RECOVERY = {"coasting": 0.6, "lost": 0.5}
CONFIRM_HITS, MOST_COAST, MOST_LOST, MOST_AGE, MOST_UNMEASURED_NS = 3, 5, 15, 36_000, 30 * 10**9
MOST_TRACKS = 256
UNCERTAINTY = 0.05

Box = tuple[float, float, float, float]


@dataclass
class Track:
    local_id: int
    box: Box
    measured_ns: int
    state: str = "tentative"
    hits: int = 1
    age: int = 1
    coast: int = 0
    confidence: float = 1.0
    velocity: tuple[float, float] = (0.0, 0.0)

    def predicted(self, t_ns: int) -> tuple[Box, float]:
        """The last measured box carried on at its speed, and how unsure that is."""
        s = max(0, t_ns - self.measured_ns) / 1e9
        dx, dy = self.velocity[0] * s, self.velocity[1] * s
        x1, y1, x2, y2 = self.box
        return (x1 + dx, y1 + dy, x2 + dx, y2 + dy), UNCERTAINTY * s


def costs(predicted: np.ndarray, boxes: np.ndarray, gates: np.ndarray) -> np.ndarray:
    """Association costs of tracks (rows) and boxes; infinite beyond the gate."""
    a, b, overlap = predicted[:, None], boxes[None], iou_matrix(predicted, boxes)
    p, q = ((x[..., 2] - x[..., 0]) * (x[..., 3] - x[..., 1]) for x in (a, b))
    with np.errstate(divide="ignore", invalid="ignore"):
        scale = np.where((p > 0) & (q > 0), 1 - np.minimum(p, q) / np.maximum(p, q), 1.0)
    apart = np.hypot(a[..., 0] + a[..., 2] - b[..., 0] - b[..., 2], a[..., 1] + a[..., 3] - b[..., 1] - b[..., 3]) / 2
    apart = np.minimum(1.0, apart / math.sqrt(2))
    cost = IOU_WEIGHT * (1 - overlap) + DISTANCE_WEIGHT * apart + SCALE_WEIGHT * scale
    return np.where((overlap < LEAST_IOU) & (apart > gates[:, None]), np.inf, cost)


def greedy(cost: np.ndarray) -> list[tuple[int, int]]:
    """Cheapest pairs first, ties to the lower track, then to the lower box."""
    rows, cols = np.nonzero(np.isfinite(cost))
    taken_rows, taken_cols, out = set(), set(), []
    for k in np.lexsort((cols, rows, cost[rows, cols])):
        i, j = int(rows[k]), int(cols[k])
        if i not in taken_rows and j not in taken_cols:
            taken_rows.add(i)
            taken_cols.add(j)
            out.append((i, j))
    return out


def optimal(cost: np.ndarray) -> list[tuple[int, int]]:
    """The assignment of most pairs and then least cost, by shortest augmenting paths (Kuhn 1955, Munkres 1957)."""
    n, m = cost.shape
    if n > m:
        return [(i, j) for j, i in optimal(cost.T)]
    big = 1 + 2 * max(n, m)
    full = np.where(np.isfinite(cost), cost, big)
    u, v, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for i in range(n):
        reach, came, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, last = i, -1
        while row >= 0:
            slack = full[row] - u[row] - v
            base = 0.0 if last < 0 else reach[last]
            better = ~done & (base + slack < reach)
            reach[better], came[better] = base + slack[better], last
            last = int(np.where(done, np.inf, reach).argmin())
            done[last] = True
            row = int(owner[last])
        end = reach[last]
        for j in np.flatnonzero(done):
            if owner[j] >= 0:
                u[owner[j]] += end - reach[j]
            v[j] -= end - reach[j]
        u[i] += end
        while last >= 0:
            before = int(came[last])
            owner[last] = owner[before] if before >= 0 else i
            last = before
    return sorted((int(i), j) for j, i in enumerate(owner) if i >= 0 and np.isfinite(cost[i, j]))


@dataclass
class Tracker:
    """The tracks of one camera; `step` takes a frame and says what became of each detection and track."""

    assign: str = "greedy"
    tracks: list[Track] = field(default_factory=list)
    next_id: int = 1
    last_ns: int | None = None

    def step(self, t_ns: int, boxes: list[Box]) -> tuple[list[tuple[int, str, float | None]], list[tuple[int, str]]] | None:
        """(local id, state, cost) of each box, and (local id, why) of tracks that ended; None for a frame out of order."""
        if self.last_ns is not None and t_ns <= self.last_ns:
            return None
        self.last_ns = t_ns
        matched, cost = self._matched(t_ns, boxes)
        ended: list[tuple[int, str]] = []
        out: list[tuple[int, str, float | None]] = [(0, "", None)] * len(boxes)
        for i, track in enumerate(self.tracks):
            if (j := matched.get(i)) is None:
                self._miss(track, t_ns, ended)
            else:
                self._hit(track, t_ns, boxes[j], ended)
                out[j] = (track.local_id, track.state, float(cost[i, j]))
        self.tracks = [t for t in self.tracks if t.state != "terminated"]
        for j, box in enumerate(boxes):
            if not out[j][0]:
                if len(self.tracks) >= MOST_TRACKS:
                    weakest = min(self.tracks, key=lambda t: (t.state != "tentative", -t.coast, t.confidence, t.local_id))
                    self.tracks.remove(weakest)
                    ended.append((weakest.local_id, "evicted"))
                self.tracks.append(Track(self.next_id, box, t_ns))
                out[j] = (self.next_id, "tentative", None)
                self.next_id += 1
        return out, ended

    def _matched(self, t_ns: int, boxes: list[Box]) -> tuple[dict[int, int], np.ndarray]:
        """Track to box, without matches whose runner-up is nearly as good: a track rather coasts than goes wrong."""
        if not self.tracks or not boxes:
            return {}, np.zeros((len(self.tracks), len(boxes)))
        ahead = [t.predicted(t_ns) for t in self.tracks]
        cost = costs(np.array([b for b, _ in ahead]), np.array(boxes, float), GATE * np.array([u for _, u in ahead]))
        most = np.array([MOST_COST * RECOVERY.get(t.state, 1.0) for t in self.tracks])
        cost = np.where(cost <= most[:, None], cost, np.inf)
        out = {}
        for i, j in (greedy if self.assign == "greedy" else optimal)(cost):
            others = np.delete(cost[i], j)
            runner_up = others.min() if len(others) else np.inf
            if runner_up - cost[i, j] >= MARGIN:
                out[i] = j
                self.tracks[i].confidence = float(max(0.0, 1 - cost[i, j]) * min(1.0, (runner_up - cost[i, j]) / 0.3))
        return out, cost

    def _hit(self, track: Track, t_ns: int, box: Box, ended: list[tuple[int, str]]) -> None:
        s = (t_ns - track.measured_ns) / 1e9
        track.velocity = tuple((box[k] + box[k + 2] - track.box[k] - track.box[k + 2]) / 2 / s for k in (0, 1))
        track.box, track.measured_ns, track.hits, track.age, track.coast = box, t_ns, track.hits + 1, track.age + 1, 0
        if track.age >= MOST_AGE:
            track.state = "terminated"
            ended.append((track.local_id, "max_age"))
        elif track.state != "tentative" or track.hits >= CONFIRM_HITS:
            track.state = "confirmed"

    def _miss(self, track: Track, t_ns: int, ended: list[tuple[int, str]]) -> None:
        track.age, track.coast, track.confidence = track.age + 1, track.coast + 1, track.confidence * 0.7
        before = track.state
        if before != "tentative" and t_ns - track.measured_ns >= MOST_UNMEASURED_NS:
            track.state, why = "terminated", "unmeasured"
        elif track.age >= MOST_AGE:
            track.state, why = "terminated", "max_age"
        elif before == "tentative":
            track.state, why = "terminated", "missed"
        elif track.coast > MOST_COAST + MOST_LOST:
            track.state, why = "terminated", "lost_window"
        else:
            track.state, why = "lost" if track.coast > MOST_COAST else "coasting", ""
        if track.state == "terminated":
            ended.append((track.local_id, why))


TRACKED = "camera_id string, t_ns long, det_index long, local_id long, state string, cost double"


def track(detections: DataFrame, assign: str = "greedy") -> DataFrame:
    """detections(camera_id, t_ns, det_index, x1, y1, x2, y2): each with its track, and a row without det_index a track that ended.

    Detections of one camera and time are a frame. Frames come in order, as
    sorted; an order within a stream is Spark's to keep. Rows of no camera or
    time take no part.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        camera, frame, rows, tracker, out = None, None, [], Tracker(assign), []

        def close() -> None:
            got = tracker.step(frame, [r[1:] for r in rows])
            if got is not None:
                out.extend((camera, frame, r[0], *x) for r, x in zip(rows, got[0], strict=True))
                out.extend((camera, frame, None, i, why, None) for i, why in got[1])

        def flushed() -> pd.DataFrame:
            df = pd.DataFrame(out, columns=["camera_id", "t_ns", "det_index", "local_id", "state", "cost"]).astype({"det_index": "Int64"})
            out.clear()
            return df

        for batch in batches:
            for r in batch.itertuples(index=False):
                if (r.camera_id, r.t_ns) != (camera, frame):
                    if rows:
                        close()
                    if r.camera_id != camera:
                        tracker = Tracker(assign)
                    camera, frame, rows = r.camera_id, r.t_ns, []
                rows.append((r.det_index, r.x1, r.y1, r.x2, r.y2))
            yield flushed()
        if rows:
            close()
        yield flushed()

    known = detections.where("camera_id is not null and t_ns is not null").select("camera_id", "t_ns", "det_index", "x1", "y1", "x2", "y2")
    return known.repartition("camera_id").sortWithinPartitions("camera_id", "t_ns", "det_index").mapInPandas(fold, TRACKED)


#: Horizons of an object's life in nanoseconds, fixed values, and the sightings that confirm one.
PROVISIONAL_NS, OCCLUSION_NS, DORMANT_NS, RETENTION_NS, CONFIRM = 3 * 10**9, 10 * 10**9, 120 * 10**9, 600 * 10**9, 3


def lifecycle_at(now_ns: Column | int, observation_count: Column, last_confirmed_ns: Column, scale: int = 1) -> Column:
    """What an object is at a time, `scale` times the usual horizons after it was last measured.

    Unconfirmed ones expire soon; confirmed ones pass from active over occluded,
    dormant and departed to expired. One never measured is unconfirmed.
    """
    now = F.lit(now_ns) if isinstance(now_ns, int) else now_ns
    since = now - last_confirmed_ns
    unsure = (observation_count < CONFIRM) | last_confirmed_ns.isNull()
    return (
        F.when(unsure, F.when(F.coalesce(since >= PROVISIONAL_NS * scale, F.lit(False)), "expired").otherwise("provisional")).when(since >= RETENTION_NS * scale, "expired").when(since >= DORMANT_NS * scale, "departed")
        .when(since >= OCCLUSION_NS * scale, "dormant").when(since > 0, "occluded").otherwise("active")
    )


def merged_objects(objects: DataFrame, survivors: DataFrame) -> DataFrame:
    """objects(object_id, first_seen_ns, last_seen_ns, last_confirmed_ns, observation_count) after merges(object_id, survivor).

    The survivor takes over first and last times and counts; `merged_from` says
    how many went into it.
    """
    keyed = objects.join(survivors, "object_id", "left").withColumn("into", F.coalesce("survivor", "object_id"))
    out = keyed.groupBy("into").agg(F.min("first_seen_ns").alias("first_seen_ns"), F.max("last_seen_ns").alias("last_seen_ns"), F.max("last_confirmed_ns").alias("last_confirmed_ns"), F.sum("observation_count").alias("observation_count"), F.count_if(F.col("survivor").isNotNull()).alias("merged_from"))
    return out.withColumnRenamed("into", "object_id")


def split_at(obs: DataFrame, object_id: str, t_ns: int, new_id: str) -> DataFrame:
    """Observations of one object from a time on become those of a new one."""
    moved = (F.col("object_id") == object_id) & (F.col("t_ns") >= t_ns)
    return obs.withColumn("object_id", F.when(moved, new_id).otherwise(F.col("object_id")))
