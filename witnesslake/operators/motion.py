"""Motion of objects: velocity, heading, acceleration, and states of motion with hysteresis."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from witnesslake.operators import automaton, ordered

# The speed below which an object stands and below which it has no heading, frames that settle a state, turns that make it erratic, degrees of a turn.
FLOOR, NOISE_FLOOR, SETTLE, ERRATIC_TURNS, TURN = 0.01, 1e-3, 3, 3, 90.0
MOTIONS = ("unknown", "stationary", "moving", "erratic")
#: How long the object has stood (below zero) or moved, up to what settles it.
_RUNS = tuple(range(-SETTLE, SETTLE + 1))
_STATES = list(itertools.product(_RUNS, MOTIONS[:-1], range(ERRATIC_TURNS)))
ERRATIC = len(_STATES)


def _step(state: int, moves: bool, turned: bool) -> int:
    if state == ERRATIC:
        return state
    run, motion, turns = _STATES[state]
    if turns + turned >= ERRATIC_TURNS:
        return ERRATIC
    run = min(SETTLE, max(run, 0) + 1) if moves else max(-SETTLE, min(run, 0) - 1)
    motion = "stationary" if run == -SETTLE else "moving" if run == SETTLE else motion
    return _STATES.index((run, motion, turns + turned))


#: Of symbols 2 * moves + turned.
STEPS = [[_step(s, moves, turned) for s in range(ERRATIC + 1)] for moves in (False, True) for turned in (False, True)]
START = _STATES.index((0, "unknown", 0))


def kinematics(points: DataFrame, second_ns: int = 10**9) -> DataFrame:
    """points(object_id, t_ns, event_id, x, y) with velocity (vx, vy), speed, heading and acceleration.

    Velocity is that from the point before, per `second_ns`; none at a first
    point or within the same instant. A heading is clockwise in degrees from +x,
    null below the noise floor; acceleration is the change of speed since the
    point before.
    """
    at = ordered.neighbours(points.withColumn("here", F.struct("t_ns", "x", "y")), "object_id", "event_id", "here").drop("next")
    s = (F.col("t_ns") - F.col("previous.t_ns")).cast("double") / second_ns
    over = lambda c: F.when(s > 0, (F.col(c) - F.col(f"previous.{c}")) / s)
    moved = at.withColumns({"vx": over("x"), "vy": over("y"), "s": F.when(s > 0, s)}).drop("here", "previous").withColumn("speed", F.hypot("vx", "vy"))
    moved = moved.withColumn("heading", F.when(F.col("speed") >= NOISE_FLOOR, F.pmod(F.degrees(F.atan2("vy", "vx")) + 360.0, F.lit(360.0))))
    faster = ordered.neighbours(moved, "object_id", "event_id", "speed").drop("next")
    return faster.withColumn("acceleration", (F.col("speed") - F.col("previous")) / F.col("s")).drop("previous", "s")


def turned(moved: DataFrame) -> DataFrame:
    """moved with `turned`: whether the heading differs by over TURN degrees from the latest one before."""
    held = ordered.carried(moved, ["object_id"], ["event_id"], "heading")
    before = ordered.neighbours(held, "object_id", "event_id", "found").drop("next", "found")
    apart = F.abs(F.col("heading") - F.col("previous"))
    return before.withColumn("turned", F.coalesce(F.least(apart, 360.0 - apart) > TURN, F.lit(False))).drop("previous")


def motion_states(moved: DataFrame, span_ns: int | None = automaton.SPAN_NS) -> DataFrame:
    """object_id, t_ns, event_id, speed, heading, acceleration and `motion`, as the object has it after each point.

    SETTLE points in a row below the floor make it stationary, as many above it
    moving, and ERRATIC_TURNS turns erratic for good; until something settles it
    is what it was, at first unknown. A point without a velocity counts as still.
    """
    marked = turned(moved).withColumn("symbol", (F.coalesce(F.col("speed"), F.lit(0.0)) >= FLOOR).cast("int") * 2 + F.col("turned").cast("int"))
    scanned = automaton.scan(marked.select("object_id", "t_ns", "event_id", "speed", "heading", "acceleration", "symbol"), "object_id", ["event_id"], "symbol", STEPS, START, span_ns)
    names = F.array(*(F.lit(_STATES[s][1]) for s in range(ERRATIC)), F.lit("erratic"))
    return scanned.select("object_id", "t_ns", "event_id", "speed", "heading", "acceleration", F.element_at(names, F.col("state") + 1).alias("motion"))


def class_winners(sightings: DataFrame) -> DataFrame:
    """sightings(object_id, t_ns, event_id, class_id, confidence): where the class that an object is said to be changes.

    The class is that of the most accumulated confidence, of equal ones the
    first by name. Each row is a change: (object_id, t_ns, event_id, was, class_id,
    share), share being the winner's part of all evidence. A class's sum at a
    row is a running one; the winner before and after it follow from the sums,
    by the newest row of every class: no pair of rows is ever made.
    """
    weighed = sightings.withColumn("w", F.greatest(F.coalesce("confidence", F.lit(0.0)), F.lit(0.0)))
    classes = F.array_sort(F.collect_set("class_id"))
    known = weighed.groupBy(F.col("object_id").alias("of")).agg(classes.alias("classes"))
    running = "over (partition by object_id order by t_ns, event_id)"
    # sums of all classes of an object, which are few, at each of its rows
    wide = weighed.join(known, F.col("object_id") == F.col("of")).select("object_id", "t_ns", "event_id", "class_id", "w", F.posexplode("classes").alias("nth", "c"))
    sums = wide.withColumn("sum", F.expr("sum(if(class_id = c, w, 0D)) over (partition by object_id, c order by t_ns, event_id)"))
    at = sums.groupBy("object_id", "t_ns", "event_id").agg(F.min(F.struct((-F.col("sum")).alias("neg"), F.col("c").alias("c"))).alias("best"), F.sum("sum").alias("total"))
    best = at.where("total > 0").select("object_id", "t_ns", "event_id", F.col("best.c").alias("class_id"), (-F.col("best.neg") / F.col("total")).alias("share"))
    return best.withColumn("was", F.expr(f"lag(class_id) {running}")).where("was is null or was <> class_id").select("object_id", "t_ns", "event_id", "was", "class_id", F.round("share", 9).alias("share"))
