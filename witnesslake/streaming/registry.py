"""Registry ingest: tracks of a camera become objects that outlive them.

A frame's tracks are bound to objects: a track goes on with its own object,
continues one that was lost near by and not long ago, or makes a new one. What
an object is then follows from what was measured. All of a camera's objects
bear on each binding, so frames of a camera are folded in order, in batch over
sorted rows and on a stream with the objects as state. Both hold MOST_OBJECTS
objects a camera at most; a camera's history is never held.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Life of an object in nanoseconds and sightings, how many a camera holds, and what allows a binding.
CONFIRM, PROVISIONAL_NS, OCCLUSION_NS, DORMANT_NS, RETENTION_NS = 3, 3 * 10**9, 10 * 10**9, 120 * 10**9, 600 * 10**9
MOST_OBJECTS = 512
MOST_DISTANCE, MOST_GAP_NS, MARGIN, LEAST_SCORE, EPOCH_PENALTY = 0.25, 30 * 10**9, 0.15, 0.3, 0.5
#: Share of the picture that counts as its edge.
EDGE = 0.02

TRACKS = "camera_id string, t_ns long, track_id string, epoch long, predicted boolean, class_id string, confidence double, x1 double, y1 double, x2 double, y2 double, bind_to string"
FACTS = "camera_id string, t_ns long, seq long, fact string, object_id string, track_id string, was string, now string, cause string, score double"


@dataclass(frozen=True)
class Policy:
    """Horizons of an object's life, and the period of sweeps, which none has if it is zero."""

    confirm: int = CONFIRM
    provisional_ns: int = PROVISIONAL_NS
    occlusion_ns: int = OCCLUSION_NS
    dormant_ns: int = DORMANT_NS
    retention_ns: int = RETENTION_NS
    most_objects: int = MOST_OBJECTS
    most_gap_ns: int = MOST_GAP_NS
    sweep_ns: int = 0


def measured(state: str, count: int, policy: Policy) -> tuple[str, str]:
    """State and cause after a sighting, which is the count-th."""
    if state == "provisional" and count < policy.confirm:
        return "provisional", "first_detections"
    return "active", {"occluded": "re_association_succeeded", "dormant": "re_entry_matched"}.get(state, "confirmation_threshold_met")


def unmeasured(state: str, since_ns: int, policy: Policy, left: bool = False) -> tuple[str, str]:
    """State and cause where nothing was measured, one step a call."""
    if state == "active":
        return ("dormant", "left_field_of_view") if left else ("occluded", "measurement_lost")
    horizon, after, cause, stays = {
        "provisional": (policy.provisional_ns, "expired", "never_confirmed", "first_detections"), "occluded": (policy.occlusion_ns, "dormant", "occlusion_exceeded_horizon", "measurement_lost"),
        "dormant": (policy.dormant_ns, "departed", "departure_horizon_exceeded", "occlusion_exceeded_horizon"), "departed": (policy.retention_ns, "expired", "retention_horizon", "departure_horizon_exceeded"),
    }[state]
    return (after, cause) if since_ns >= horizon else (state, stays)


def alike(a: str, b: str) -> bool:
    """Classes of which one is or refines the other."""
    return a == b or a.startswith(f"{b}.") or b.startswith(f"{a}.")


@dataclass
class Held:
    object_id: str
    class_id: str
    box: list[float] | None
    confirmed_ns: int
    first_ns: int
    state: str = "provisional"
    count: int = 1
    track_id: str | None = None
    weights: dict[str, float] = field(default_factory=dict)

    def centre(self) -> tuple[float, float] | None:
        return None if self.box is None else ((self.box[0] + self.box[2]) / 2, (self.box[1] + self.box[3]) / 2)

    def see(self, row: dict, now: int) -> str | None:
        """Takes in a sighting; the new class if the evidence now says another."""
        self.count += 1
        if row["predicted"]:
            return None
        self.confirmed_ns, self.box = now, row["box"]
        return self.weigh(row)

    def weigh(self, row: dict) -> str | None:
        self.weights[row["class_id"]] = self.weights.get(row["class_id"], 0.0) + max(0.0, row["confidence"])
        # of equal weights the first name
        best = min(self.weights, key=lambda c: (-self.weights[c], c))
        if sum(self.weights.values()) > 0 and best != self.class_id:
            self.class_id = best
            return best
        return None


@dataclass
class Registry:
    """The objects of one camera. frame() and sweep() say what happened, as FACTS without the camera."""

    camera_id: str
    policy: Policy = Policy()
    objects: dict[str, Held] = field(default_factory=dict)
    now_ns: int | None = None
    epoch: int | None = None
    made: int = 0
    seq: int = 0
    facts: list[tuple] = field(default_factory=list)

    def say(self, fact: str, object_id: str | None = None, track_id: str | None = None, was: str | None = None, now: str | None = None, cause: str | None = None, score: float | None = None) -> None:
        self.seq += 1
        self.facts.append((self.camera_id, self.now_ns, self.seq, fact, object_id, track_id, was, now, cause, score))

    def frame(self, t_ns: int, rows: list[dict]) -> None:
        """One frame's tracks, in their order. A frame from before the last one is reported and left out."""
        if self.now_ns is not None and t_ns < self.now_ns:
            self.say("late", cause=str(t_ns))
            return
        self.sweeps(t_ns - 1)
        self.now_ns = t_ns
        epoch = max((r["epoch"] for r in rows), default=self.epoch)
        crossing = self.epoch is not None and epoch != self.epoch
        self.epoch, touched = epoch, set()
        for row in rows:
            if row["bind_to"] is not None:
                self.bind(row)
        for row in rows:
            held = self.absorb(row, crossing)
            if held is None:
                continue
            touched.add(held.object_id)
            self.say("updated", held.object_id, row["track_id"], now=held.class_id)
            if row["predicted"]:
                self.move(held, *unmeasured(held.state, t_ns - held.confirmed_ns, self.policy))
            else:
                self.move(held, *measured(held.state, held.count, self.policy))
        for key in sorted(self.objects):
            held = self.objects[key]
            if key in touched or held.state == "expired":
                continue
            held.track_id = None
            after = unmeasured(held.state, t_ns - held.confirmed_ns, self.policy, self.at_edge(held))
            held.count += 1
            self.move(held, *after)

    def sweeps(self, until_ns: int) -> None:
        """All sweeps that are due up to a time; none are where no objects are left."""
        every = self.policy.sweep_ns
        while every and self.now_ns is not None and self.objects:
            at = (self.now_ns // every + 1) * every
            if at > until_ns:
                break
            self.now_ns = at
            for key in sorted(self.objects):
                self.age(self.objects[key])

    def age(self, held: Held) -> None:
        """Over as many horizons as have passed: what a sweep finds depends on the time alone, not on how often there is one."""
        was, state, cause = held.state, held.state, None
        while state != "expired":
            after, why = unmeasured(state, self.now_ns - held.confirmed_ns, self.policy)
            if after == state:
                break
            state, cause = after, why
        if cause is not None:
            if state not in ("provisional", "active"):
                held.track_id = None
            held.state = state
            self.say("lifecycle", held.object_id, was=was, now=state, cause=cause)
        if held.state == "expired":
            del self.objects[held.object_id]

    def move(self, held: Held, state: str, cause: str) -> None:
        if state != held.state:
            self.say("lifecycle", held.object_id, was=held.state, now=state, cause=cause)
            held.state = state

    def at_edge(self, held: Held) -> bool:
        return held.box is not None and (min(held.box[:2]) <= EDGE or max(held.box[2:]) >= 1 - EDGE)

    def bind(self, row: dict) -> None:
        """A track is said to be an object by hand; objects that are gone take none."""
        held = self.objects.get(row["bind_to"])
        if held is None or held.state == "expired":
            self.say("bind_refused", row["bind_to"], row["track_id"], cause="unknown_object" if held is None else "terminal")
            return
        for other in self.objects.values():
            if other.track_id == row["track_id"]:
                other.track_id = None
        held.track_id = row["track_id"]
        self.say("bound", held.object_id, row["track_id"], cause="manual", score=1.0)

    def absorb(self, row: dict, crossing: bool) -> Held | None:
        track, now = row["track_id"], self.now_ns
        own = next((h for k in sorted(self.objects) if (h := self.objects[k]).track_id == track and h.state != "expired"), None)
        if own is not None and own.state == "departed" and not row["predicted"]:
            # what has left isn't measured again: the sighting is of a new object
            own.track_id = None
            return self.make(row, "after_departure", own.object_id, 1.0)
        if own is None:
            scored = sorted((-s, h.object_id) for h in self.objects.values() if (s := self.score(h, row, crossing)) is not None)
            if scored and not (len(scored) > 1 and scored[1][0] - scored[0][0] < MARGIN):
                own = self.objects[scored[0][1]]
                own.track_id = track
                self.say("reentered", own.object_id, track, was=own.state, cause="epoch_rebind" if crossing else "spatio_temporal", score=-scored[0][0])
            else:
                return self.make(row, "ambiguous" if scored else "first_sight", ",".join(k for _, k in scored) or None, -scored[0][0] if scored else 1.0)
        if (said := own.see(row, now)) is not None:
            self.say("reclassified", own.object_id, track, now=said)
        return own

    def score(self, held: Held, row: dict, crossing: bool) -> float | None:
        """How well an object that no track has continues in this one: near in place and time, both falling to nothing at their limits."""
        if held.state not in ("occluded", "dormant") or held.track_id is not None or not alike(held.class_id, row["class_id"]):
            return None
        gap, here, there = max(0, self.now_ns - held.confirmed_ns), held.centre(), row["box"]
        distance = 1.0 if here is None or there is None else min(1.0, math.hypot((there[0] + there[2]) / 2 - here[0], (there[1] + there[3]) / 2 - here[1]) / math.sqrt(2))
        if gap > self.policy.most_gap_ns or distance > MOST_DISTANCE:
            return None
        score = (1 - distance / MOST_DISTANCE) * (1 - gap / self.policy.most_gap_ns) * (EPOCH_PENALTY if crossing else 1.0)
        return score if score >= LEAST_SCORE else None

    def make(self, row: dict, cause: str, others: str | None, score: float) -> Held | None:
        """A new object; where there are too many, the oldest unconfirmed one goes, and without such the track is refused."""
        if len(self.objects) >= self.policy.most_objects:
            unsure = min((h for h in self.objects.values() if h.state == "provisional"), key=lambda h: (h.first_ns, h.object_id), default=None)
            if unsure is None:
                self.say("refused", track_id=row["track_id"], cause="population_capped")
                return None
            del self.objects[unsure.object_id]
            self.say("lifecycle", unsure.object_id, was="provisional", now="expired", cause="population_shed")
        self.made += 1
        held = Held(f"{self.camera_id}/{self.made:09d}", row["class_id"], row["box"], self.now_ns, self.now_ns, track_id=row["track_id"])
        held.weigh(row)
        self.objects[held.object_id] = held
        self.say("created", held.object_id, row["track_id"], was=others, now="provisional", cause=cause, score=score)
        return held

    def taken(self) -> list[tuple]:
        out, self.facts = self.facts, []
        return out


def _row(r: object) -> dict:
    """A row of TRACKS by name; a box needs all four sides."""
    box = [float(getattr(r, c)) for c in ("x1", "y1", "x2", "y2")]
    return {
        "track_id": r.track_id, "epoch": 0 if pd.isna(r.epoch) else int(r.epoch), "predicted": bool(r.predicted) if not pd.isna(r.predicted) else False, "class_id": r.class_id if isinstance(r.class_id, str) else "",
        "confidence": 0.0 if pd.isna(r.confidence) else float(r.confidence), "box": None if any(map(math.isnan, box)) else box, "bind_to": r.bind_to if isinstance(r.bind_to, str) else None,
    }


def _known(tracks: DataFrame) -> DataFrame:
    bind = F.col("bind_to") if "bind_to" in tracks.columns else F.lit(None).cast("string").alias("bind_to")
    return tracks.where("camera_id is not null and t_ns is not null and track_id is not null").select(*(c.split()[0] for c in TRACKS.split(", ")[:-1]), bind)


def _table(facts: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(facts, columns=[c.split()[0] for c in FACTS.split(", ")])


def ingest(tracks: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """TRACKS to FACTS: objects created, updated, re-entered, reclassified and bound, tracks refused, and every change of an object's state with its cause.

    Rows of one camera and time are a frame, its tracks in the order of their
    ids. `bind_to` (optional) binds a track to an object by hand. Rows without a
    camera, time or track take no part.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        registry, frame, rows, out = None, None, [], []
        for batch in batches:
            for r in batch.itertuples(index=False):
                if registry is None or (r.camera_id, r.t_ns) != (registry.camera_id, frame):
                    if rows:
                        registry.frame(frame, rows)
                        out += registry.taken()
                    if registry is None or r.camera_id != registry.camera_id:
                        registry = Registry(r.camera_id, policy)
                    frame, rows = int(r.t_ns), []
                rows.append(_row(r))
            yield _table(out)
            out = []
        if rows:
            registry.frame(frame, rows)
            yield _table(registry.taken())

    return _known(tracks).repartition("camera_id").sortWithinPartitions("camera_id", "t_ns", "track_id").mapInPandas(fold, FACTS)


class _Ingest(StatefulProcessor):
    """Frames wait in state until the watermark has passed them, so they are folded in order however they arrive."""

    def __init__(self, policy: Policy) -> None:
        self.policy = policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "t_ns long, n long", "row string")
        self.objects = handle.getMapState("objects", "object_id string", "held string")
        self.camera = handle.getValueState("camera", "now_ns long, epoch long, made long, seq long, n long")

    def _load(self, camera: str) -> tuple[Registry, int]:
        now, epoch, made, seq, n = self.camera.get() if self.camera.exists() else (None, None, 0, 0, 0)
        held = {k[0]: Held(**json.loads(v[0])) for k, v in self.objects.iterator()}
        return Registry(camera, self.policy, held, now, epoch, made, seq), n

    def _save(self, registry: Registry, n: int) -> None:
        for key in [k[0] for k in self.objects.keys()]:
            if key not in registry.objects:
                self.objects.removeKey((key,))
        for key, held in registry.objects.items():
            self.objects.updateValue((key,), (json.dumps(asdict(held)),))
        self.camera.update((registry.now_ns, registry.epoch, registry.made, registry.seq, n))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ARG002
        now, epoch, made, seq, n = self.camera.get() if self.camera.exists() else (None, None, 0, 0, 0)
        for batch in rows:
            for r in batch.itertuples(index=False):
                n += 1
                self.waiting.updateValue((int(r.t_ns), n), (json.dumps(_row(r)),))
            for at in {-(-int(t) // 10**6) for t in batch["t_ns"].unique()}:
                self.handle.registerTimer(at)
        self.camera.update((now, epoch, made, seq, n))
        yield _table([])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # all up to the watermark has come, so other timers of this batch find nothing left
        until = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 10**6
        frames: dict[int, list] = {}
        due = [(k, v) for k, v in self.waiting.iterator() if k[0] <= until]
        for (t_ns, n), (row,) in due:
            frames.setdefault(t_ns, []).append((json.loads(row), n))
            self.waiting.removeKey((t_ns, n))
        registry, count = self._load(key[0])
        for t_ns in sorted(frames):
            registry.frame(t_ns, [r for r, _ in sorted(frames[t_ns], key=lambda x: (x[0]["track_id"], x[1]))])
        # objects of a camera that falls silent age too
        registry.sweeps(until)
        self._save(registry, count)
        if registry.policy.sweep_ns and registry.objects:
            self.handle.registerTimer(-(-((registry.now_ns // registry.policy.sweep_ns + 1) * registry.policy.sweep_ns) // 10**6))
        yield _table(registry.taken())

    def close(self) -> None:
        pass


def ingest_stream(tracks: DataFrame, policy: Policy = Policy(), late: str = "10 seconds") -> DataFrame:
    """ingest on a stream, in the order of time whatever that of arrival. Rows behind the watermark are Spark's to drop and count.

    The state store must be one that transformWithState takes (RocksDB). What
    is held of a camera is its objects and the frames within `late`.
    """
    timed = _known(tracks).withColumn("ts", F.timestamp_micros(F.expr("t_ns div 1000"))).withWatermark("ts", late)
    return timed.groupBy("camera_id").transformWithStateInPandas(_Ingest(policy), FACTS, "append", "EventTime")
