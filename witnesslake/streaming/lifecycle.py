"""Lives of objects from their sightings: every change of state with its time and cause.

An object is provisional until it was seen often enough. What is seen no more is
soon occluded, then dormant, departed and expired, each as its horizon passes:
these changes have a time of their own and need no further input. A sighting
brings an occluded or dormant object back; after departure it begins another
life, whose name has the time of its first sighting.

In batch a life's bounds come from an automaton over gaps between sightings and
the changes from the sightings' neighbours; on a stream, timers make them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from witnesslake.operators import automaton, ordered
from witnesslake.streaming.registry import CONFIRM, DORMANT_NS, OCCLUSION_NS, PROVISIONAL_NS, RETENTION_NS

#: An object is occluded if it isn't seen for a frame.
LOST_NS = 10**9
CHANGES = "object_id string, life_ns long, at_ns long, was string, now string, cause string"


@dataclass(frozen=True)
class Horizons:
    confirm: int = CONFIRM
    lost_ns: int = LOST_NS
    provisional_ns: int = PROVISIONAL_NS
    occlusion_ns: int = OCCLUSION_NS
    dormant_ns: int = DORMANT_NS
    retention_ns: int = RETENTION_NS

    def scaled(self, by: int) -> Horizons:
        return Horizons(self.confirm, *(by * x for x in (self.lost_ns, self.provisional_ns, self.occlusion_ns, self.dormant_ns, self.retention_ns)))

    def passing(self, confirmed: bool) -> list[tuple[int, str, str, str]]:
        """(time since the last sighting, state before, after, cause) of the changes that come of themselves."""
        if not confirmed:
            return [(self.provisional_ns, "provisional", "expired", "never_confirmed")]
        return [(self.lost_ns, "active", "occluded", "measurement_lost"), (self.occlusion_ns, "occluded", "dormant", "occlusion_exceeded_horizon"), (self.dormant_ns, "dormant", "departed", "departure_horizon_exceeded"), (self.retention_ns, "departed", "expired", "retention_horizon")]

    def before(self, since_ns: int, confirmed: bool) -> str:
        """The state in which a sighting finds the object, so long after the one before."""
        passed = [after for ns, _, after, _ in self.passing(confirmed) if since_ns > ns]
        return passed[-1] if passed else "active" if confirmed else "provisional"


#: What a sighting does to an object, by the state that it finds it in.
FOUND = {"provisional": "confirmation_threshold_met", "occluded": "re_association_succeeded", "dormant": "re_entry_matched"}


def changes(sightings: DataFrame, until_ns: int, horizons: Horizons = Horizons(), span_ns: int | None = automaton.SPAN_NS) -> DataFrame:
    """sightings(object_id, t_ns, event_id) to CHANGES up to a time. Sightings of one instant count each; a horizon that passes at a sighting's very instant doesn't pass."""
    h, n = horizons, horizons.confirm
    at = ordered.neighbours(sightings.select("object_id", "t_ns", "event_id").where("object_id is not null and t_ns is not null"), "object_id", "event_id", "t_ns")
    gap = F.col("t_ns") - F.col("previous")
    symbol = F.when(F.col("previous").isNull() | (gap <= h.provisional_ns), 0).when(gap <= h.dormant_ns, 1).otherwise(2)
    # state 0: nothing yet; k: k sightings of this life, n for all more. By what gap an unconfirmed and a confirmed life ends.
    step = [[1, *((1 if s >= (1 if k < n else 2) else min(k + 1, n)) for k in range(1, n + 1))] for s in range(3)]
    seen = automaton.scan(at.withColumn("symbol", symbol), "object_id", ["event_id"], "symbol", step, 0, span_ns)
    begins = (F.col("state_before") == 0) | (F.col("symbol") >= F.when(F.col("state_before") < n, 1).otherwise(2))
    lives = ordered.carried(seen.withColumn("begun", F.when(begins, F.col("t_ns"))), ["object_id"], ["event_id"], "begun").withColumnRenamed("found", "life_ns")
    # whether the next sighting is of another life
    ended = ordered.neighbours(lives, "object_id", "event_id", "life_ns").withColumn("last", F.col("next").isNull() | (F.col("next") != F.col("life_ns"))).drop("previous", "next")
    rows = ended.join(at.select(F.col("object_id").alias("o_"), F.col("event_id").alias("e_"), F.col("previous").alias("before_ns"), F.col("next").alias("next_ns")), (F.col("object_id") == F.col("o_")) & (F.col("event_id") == F.col("e_")))
    new = F.col("begun").isNotNull()
    confirmed_before, confirmed = (F.col("state_before") >= n) & ~new, F.col("state") >= n
    since = F.col("t_ns") - F.col("before_ns")
    found = F.when(since > h.occlusion_ns, "dormant").when(since > h.lost_ns, "occluded").otherwise("active")
    change = lambda at_ns, was, now, cause: F.struct(at_ns.alias("at_ns"), was.alias("was"), F.lit(now).alias("now"), cause.alias("cause"))
    none = F.lit(None).cast("string")
    sighted = (
        F.when(new, change(F.col("t_ns"), none, "provisional" if n > 1 else "active", F.lit("first_detections")))
        .when(confirmed_before & (found != "active"), change(F.col("t_ns"), found, "active", F.when(found == "dormant", FOUND["dormant"]).otherwise(FOUND["occluded"])))
        .when(~confirmed_before & confirmed, change(F.col("t_ns"), F.lit("provisional"), "active", F.lit(FOUND["provisional"])))
    )
    bound = F.when(F.col("last"), F.lit(until_ns + 1)).otherwise(F.least(F.col("next_ns"), F.lit(until_ns + 1)))
    passing = [F.when((confirmed if c else ~confirmed) & (F.col("t_ns") + ns < bound), change(F.col("t_ns") + ns, F.lit(was), now, F.lit(cause))) for c in (False, True) for ns, was, now, cause in h.passing(c)]
    out = rows.select("object_id", "life_ns", F.explode(F.array_compact(F.array(sighted, *passing))).alias("c"))
    return out.select("object_id", "life_ns", "c.*").where(F.col("at_ns") <= until_ns)


class Life:
    """One object's lives, in plain steps: the current one and those that only wait to expire."""

    def __init__(self, object_id: str, horizons: Horizons, lives: list[list] | None = None) -> None:
        self.object_id, self.horizons = object_id, horizons
        #: [life, last sighting, sightings, horizons passed]
        self.lives = lives or []
        self.out: list[tuple] = []

    def see(self, t_ns: int) -> None:
        """A sighting; horizons that end before it pass first."""
        self.pass_time(t_ns - 1)
        n, life = self.horizons.confirm, self.lives[-1] if self.lives else None
        if life is None or self.state(life) in ("departed", "expired"):
            self.lives.append([t_ns, t_ns, 1, 0])
            self.out.append((self.object_id, t_ns, t_ns, None, "provisional" if n > 1 else "active", "first_detections"))
            return
        was, life[1], life[2], life[3] = self.state(life), t_ns, life[2] + 1, 0
        now = "active" if life[2] >= n else "provisional"
        if now != was:
            self.out.append((self.object_id, life[0], t_ns, was, now, FOUND[was]))

    def state(self, life: list) -> str:
        passed = self.horizons.passing(life[2] >= self.horizons.confirm)
        return passed[life[3] - 1][2] if life[3] else passed[0][1]

    def pass_time(self, until_ns: int) -> None:
        for life in self.lives:
            for ns, was, now, cause in self.horizons.passing(life[2] >= self.horizons.confirm)[life[3] :]:
                if life[1] + ns > until_ns:
                    break
                life[3] += 1
                self.out.append((self.object_id, life[0], life[1] + ns, was, now, cause))
        self.lives = [x for x in self.lives if self.state(x) != "expired"]

    def next_ns(self) -> int | None:
        """When the next horizon passes."""
        return min((x[1] + self.horizons.passing(x[2] >= self.horizons.confirm)[x[3]][0] for x in self.lives), default=None)


class _Lives(StatefulProcessor):
    def __init__(self, horizons: Horizons) -> None:
        self.horizons = horizons

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "t_ns long", "n long")
        self.lives = handle.getValueState("lives", "lives string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ARG002
        for batch in rows:
            for t_ns, n in batch["t_ns"].value_counts().items():
                held = self.waiting.getValue((int(t_ns),))[0] if self.waiting.containsKey((int(t_ns),)) else 0
                self.waiting.updateValue((int(t_ns),), (held + int(n),))
                self.handle.registerTimer(-(-int(t_ns) // 10**6))
        yield _changed([])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # all up to the watermark has come, so other timers of this batch find nothing left
        until = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 10**6
        life = Life(key[0], self.horizons, json.loads(self.lives.get()[0]) if self.lives.exists() else None)
        for t_ns, n in sorted((k[0], v[0]) for k, v in self.waiting.iterator() if k[0] <= until):
            for _ in range(n):
                life.see(t_ns)
            self.waiting.removeKey((t_ns,))
        life.pass_time(until)
        if life.lives:
            self.lives.update((json.dumps(life.lives),))
            self.handle.registerTimer(-(-life.next_ns() // 10**6))
        else:
            self.lives.clear()
        yield _changed(life.out)

    def close(self) -> None:
        pass


def _changed(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in CHANGES.split(", ")])
    return out.astype({"life_ns": "int64", "at_ns": "int64"})


def changes_stream(sightings: DataFrame, horizons: Horizons = Horizons(), late: str = "10 seconds") -> DataFrame:
    """changes on a stream: each as the watermark passes its time, with no further sighting needed. An object that has expired holds no state."""
    timed = sightings.where("object_id is not null and t_ns is not null").select("object_id", "t_ns", F.timestamp_micros(F.expr("t_ns div 1000")).alias("ts")).withWatermark("ts", late)
    return timed.groupBy("object_id").transformWithStateInPandas(_Lives(horizons), CHANGES, "append", "EventTime")
