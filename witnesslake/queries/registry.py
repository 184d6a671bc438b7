"""Objects from tracks, their lives with causes, states of motion, and the classes they are said to be."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from witnesslake.catalog import START, _log, _obs, query
from witnesslake.operators import motion
from witnesslake.sources import views
from witnesslake.streaming import lifecycle, registry

#: Horizons are stretched to the data's pace: an hour for each second.
_H = 3600
_UNTIL = START + 40 * views.DAY_NS
_S = 10**9


def _tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of eight observations of a camera are a frame, a second apart; a track is an object's for some frames, every fifth row a prediction."""
    rows = _log(spark, sf_dir).select("camera_id", (F.expr("log_position div 8") * _S).alias("t_ns"), F.concat_ws("/", "object_id", F.expr("log_position div 400").cast("string")).alias("track_id"), F.expr("log_position div 4000").alias("epoch"), "k", "class_id", "value", "x1", "y1", "x2", "y2", "event_id")
    said = F.struct("epoch", (F.col("k") % 5 == 0).alias("predicted"), "class_id", (F.least("value", F.lit(400.0)) / 400).alias("confidence"), "x1", "y1", "x2", "y2")
    # an object seen twice in a frame: its later row
    return rows.groupBy("camera_id", "t_ns", "track_id").agg(F.max_by(said, "event_id").alias("r")).select("camera_id", "t_ns", "track_id", "r.*")


@query()
def registry_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of all frames of all cameras, with sweeps every second."""
    return registry.ingest(_tracks(spark, sf_dir), registry.Policy(sweep_ns=_S))


@query()
def registry_facts_by_camera(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = registry.ingest(_tracks(spark, sf_dir), registry.Policy(sweep_ns=_S))
    return facts.groupBy("camera_id", "fact", "was", "now", "cause").agg(F.count("*").alias("n"))


def _sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _obs(spark, sf_dir).where("kind = 'spatial'")


_LIFE = f"""(with recursive s as (select object_id, t_ns, row_number() over (partition by object_id order by t_ns, event_id) as rn from obs where kind = 'spatial'),
    r as (select object_id, rn, t_ns, t_ns as life_ns, 1 as k, cast(null as bigint) as since from s where rn = 1
        union all select s.object_id, s.rn, s.t_ns, case when s.t_ns - r.t_ns > (case when r.k < 3 then 3 else 120 end) * {_S * _H} then s.t_ns else r.life_ns end,
            case when s.t_ns - r.t_ns > (case when r.k < 3 then 3 else 120 end) * {_S * _H} then 1 else r.k + 1 end, s.t_ns - r.t_ns from r join s on s.object_id = r.object_id and s.rn = r.rn + 1),
    n as (select *, case when lead(life_ns) over w is distinct from life_ns then {_UNTIL} + 1 else least(lead(t_ns) over w, {_UNTIL} + 1) end as bound from r window w as (partition by object_id order by rn)),
    h(confirmed, ns, was, now, cause) as (values (false, 3, 'provisional', 'expired', 'never_confirmed'), (true, 1, 'active', 'occluded', 'measurement_lost'), (true, 10, 'occluded', 'dormant', 'occlusion_exceeded_horizon'),
        (true, 120, 'dormant', 'departed', 'departure_horizon_exceeded'), (true, 600, 'departed', 'expired', 'retention_horizon'))
    select object_id, life_ns, t_ns as at_ns, null as was, 'provisional' as now, 'first_detections' as cause from n where k = 1 and t_ns <= {_UNTIL}
    union all select object_id, life_ns, t_ns, 'provisional', 'active', 'confirmation_threshold_met' from n where k = 3 and t_ns <= {_UNTIL}
    union all select object_id, life_ns, t_ns, 'dormant', 'active', 're_entry_matched' from n where k > 3 and since > 10 * {_S * _H} and t_ns <= {_UNTIL}
    union all select object_id, life_ns, t_ns, 'occluded', 'active', 're_association_succeeded' from n where k > 3 and since > {_S * _H} and since <= 10 * {_S * _H} and t_ns <= {_UNTIL}
    union all select object_id, life_ns, t_ns + ns * {_S * _H}, was, now, cause from n join h on confirmed = (k >= 3) where t_ns + ns * {_S * _H} < bound)"""


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.changes(_sightings(spark, sf_dir), _UNTIL, lifecycle.Horizons().scaled(_H), 100 * 3600 * _S)


@query(f"select object_id, life_ns, at_ns, was, now, cause from {_LIFE}")
def lifecycle_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir)


@query(f"select now, cause, count(*) as n, count(distinct object_id) as objects from {_LIFE} group by 1, 2")
def lifecycle_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir).groupBy("now", "cause").agg(F.count("*").alias("n"), F.countDistinct("object_id").alias("objects"))


_MOVED = f"""(with p as (select object_id, t_ns, event_id, (x1 + x2) / 2 as x, (y1 + y2) / 2 as y from obs where kind = 'spatial'),
    l as (select *, lag(x) over w as px, lag(y) over w as py, cast(t_ns - lag(t_ns) over w as double) / {_S * _H} as s from p window w as (partition by object_id order by t_ns, event_id)),
    v as (select *, case when s > 0 then (x - px) / s end as vx, case when s > 0 then (y - py) / s end as vy from l),
    m as (select *, sqrt(vx * vx + vy * vy) as speed from v),
    q as (select *, case when speed >= 1e-3 then (degrees(atan2(vy, vx)) + 360) % 360 end as heading from m),
    b as (select *, last_value(heading ignore nulls) over (partition by object_id order by t_ns, event_id rows between unbounded preceding and 1 preceding) as held, lag(speed) over (partition by object_id order by t_ns, event_id) as slower from q)
    select *, (speed - slower) / case when s > 0 then s end as acceleration, coalesce(least(abs(heading - held), 360 - abs(heading - held)) > 90, false) as turned, coalesce(speed, 0) >= 0.01 as moves from b)"""


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sightings(spark, sf_dir).select("object_id", "t_ns", "event_id", ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"))


def _moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion.kinematics(_points(spark, sf_dir), _S * _H)


@query(f"select object_id, t_ns, event_id, round(vx, 6) + 0 as vx, round(vy, 6) + 0 as vy, round(speed, 6) + 0 as speed, round(heading, 4) + 0 as heading, round(acceleration, 6) + 0 as acceleration from {_MOVED}")
def object_kinematics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _moved(spark, sf_dir).select("object_id", "t_ns", "event_id", *((F.round(c, 4 if c == "heading" else 6) + 0.0).alias(c) for c in ("vx", "vy", "speed", "heading", "acceleration")))


@query(f"""select object_id, t_ns, event_id, coalesce(last_value(says ignore nulls) over (partition by object_id order by t_ns, event_id rows between unbounded preceding and current row), 'unknown') as motion from (
    select *, case when turns >= 3 then 'erratic' when row_number() over (partition by object_id, moves, island order by t_ns, event_id) >= 3 then case when moves then 'moving' else 'stationary' end end as says from (
        select *, sum(cast(turned as int)) over w as turns, row_number() over w - row_number() over (partition by object_id, moves order by t_ns, event_id) as island from {_MOVED} window w as (partition by object_id order by t_ns, event_id)))""")
def motion_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After every point, with an automaton scanned over spans of time."""
    return motion.motion_states(_moved(spark, sf_dir), 24 * 3600 * _S).select("object_id", "t_ns", "event_id", "motion")


@query("""with c as (select user_id as object_id, epoch_us(ts) * 1000 as t_ns, event_id, event_type as class_id, cast(round(coalesce(value, 0) * 100) as bigint) as w from events),
    k as (select object_id, t_ns, event_id, n.class_id as class_id, sum(case when n.class_id = c.class_id then w else 0 end) over (partition by object_id, n.class_id order by t_ns, event_id) as s from c join (select distinct user_id as object_id, event_type as class_id from events) n using (object_id)),
    b as (select object_id, t_ns, event_id, arg_min(class_id, (-s, class_id)) as class_id, max(s) / sum(s) as share from k group by all having sum(s) > 0),
    l as (select *, lag(class_id) over (partition by object_id order by t_ns, event_id) as was from b)
    select object_id, t_ns, event_id, was, class_id, round(share, 9) as share from l where was is distinct from class_id""")
def class_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each user mostly does, by accumulated value: a running arg-max, where it changes."""
    events = views.table(spark, sf_dir, "events")
    whole = F.round(F.coalesce("value", F.lit(0.0)) * 100)
    return motion.class_winners(events.select(F.col("user_id").alias("object_id"), views.wall_ns(F.col("ts")).alias("t_ns"), "event_id", F.col("event_type").alias("class_id"), whole.alias("confidence")))
