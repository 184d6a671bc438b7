"""What callers ask of the platform: objects, snapshots, coverage, subscriptions, pages, rankings, reports."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from witnesslake.sources.store import cut

DAY_NS = 86_400 * 10**9
#: Most rows of a ledger page and summary.
LEDGER_LIMIT = 1000
#: Typical uncertainty in milliseconds by quality of a clock, fixed values.
CLOCKS = {"ptp_locked": 1, "ntp_synced": 10, "rtcp_derived": 50, "estimated": 500, "unknown": 5000}


def get_objects(asked: DataFrame, objects: DataFrame, cameras: list[str]) -> DataFrame:
    """asked(object_id) with what is held of it and a status: found, out_of_scope or unknown. What is out of scope is not shown."""
    known = asked.join(objects, "object_id", "left")
    status = F.when(F.col("camera_id").isNull(), "unknown").when(~F.col("camera_id").isin(cameras), "out_of_scope").otherwise("found")
    shown = known.withColumn("status", status)
    return shown.select("object_id", "status", *(F.when(F.col("status") == "found", F.col(c)).alias(c) for c in objects.columns if c != "object_id"))


def snapshot(objects: DataFrame, partitions: DataFrame, permitted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Objects of the permitted cameras whose partition is whole, and the permitted cameras (camera_id, why) that are missing or degraded."""
    state = permitted.join(partitions, "camera_id", "left")
    whole = state.where(F.coalesce(F.col("healthy"), F.lit(False))).select("camera_id")
    incomplete = state.where(~F.coalesce(F.col("healthy"), F.lit(False))).select("camera_id", F.when(F.col("healthy").isNull(), "missing").otherwise("degraded").alias("why"))
    return objects.join(whole, "camera_id", "left_semi"), incomplete


def coverage_summary(cameras: DataFrame) -> DataFrame:
    """cameras(tenant_id, status) as counts of those observing, blind (or disconnected) and degraded, and the share observing; none without cameras."""
    s = F.col("status")
    seeing, blind = F.count_if(s == "observing"), F.count_if(s.isin("blind", "disconnected"))
    return cameras.groupBy("tenant_id").agg(seeing.alias("observing"), blind.alias("blind"), F.count_if(~s.isin("observing", "blind", "disconnected")).alias("degraded"), F.round(seeing / F.count("*"), 9).alias("fraction"))


def subscribed(obs: DataFrame, subscriptions: list[dict]) -> DataFrame:
    """(subscription, observation_id): each observation with the subscriptions whose types, cameras, classes and keys cover it; an empty list covers all.

    The subscriptions are a list of the caller's and become one array of tests a row.
    """

    def covers(s: dict) -> Column:
        any_of = lambda column, wanted: F.coalesce(F.col(column).isin(wanted), F.lit(False)) if wanted else F.lit(True)
        classes = [F.coalesce((F.col("class_id") == c) | F.col("class_id").startswith(f"{c}."), F.lit(False)) for c in s.get("classes", [])]
        return any_of("kind", s.get("kinds", [])) & any_of("camera_id", s.get("cameras", [])) & any_of("attr_key", s.get("keys", [])) & (reduce(or_, classes) if classes else F.lit(True))

    hits = F.array_compact(F.array(*(F.when(covers(s), F.lit(s["name"])) for s in subscriptions)))
    return obs.select(F.explode(hits).alias("subscription"), "observation_id")


def page(rows: DataFrame, order: list[str], offset: int, limit: int) -> tuple[DataFrame, int]:
    """A slice in the order given, and how many rows there are in all."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(min(max(limit, 1), LEDGER_LIMIT)), rows.count()


def evict(objects: DataFrame, capacity: int, by: str = "camera_id") -> DataFrame:
    """objects with `kept`: of each camera the `capacity` most valuable, provisional ones going first, then those seen longest ago."""
    order = f"row_number() over (partition by {by} order by provisional, last_seen_ns desc, object_id)"
    return objects.withColumn("kept", F.expr(order) <= capacity)


def symmetric_difference(a: Column, b: Column) -> Column:
    return F.array_sort(F.concat(F.array_except(a, b), F.array_except(b, a)))


def taxonomy_coverage(classes: DataFrame, produced: DataFrame) -> DataFrame:
    """(class_id, status): produced classes that the taxonomy lacks are unknown, those of it that nothing at or below produces are absent, the rest producible."""
    known = classes.select("class_id").distinct()
    made = produced.select("class_id").distinct()
    unknown = made.join(known, "class_id", "left_anti").withColumn("status", F.lit("unknown"))
    # a produced class stands for itself and all above it
    parts = F.split("class_id", r"\.")
    above = made.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))).alias("class_id")).distinct().withColumn("made", F.lit(True))
    held = known.where(F.col("class_id") != "unknown").join(above, "class_id", "left")
    return unknown.unionByName(held.select("class_id", F.when(F.col("made"), "producible").otherwise("absent").alias("status")))


def resolved(merges: DataFrame) -> DataFrame:
    """merges(object_id, merged_into) as (object_id, survivor), however long the chain; an object in a cycle has none.

    Pointers double: each round halves what is left of a chain, so a chain of n
    takes log2(n) rounds, each a join of the table with itself.
    """
    links = cut(merges.select("object_id", F.col("merged_into").alias("survivor")))
    for _ in range(64):
        on = links.select(F.col("object_id").alias("k"), F.col("survivor").alias("beyond"))
        links = cut(links.join(on, F.col("survivor") == F.col("k"), "left").select("object_id", F.coalesce("beyond", "survivor").alias("survivor")))
        if links.join(links.select(F.col("object_id").alias("survivor")), "survivor", "left_semi").where(F.col("survivor") != F.col("object_id")).isEmpty():
            break
    return links.where(F.col("survivor") != F.col("object_id"))


def ranked_understanders(bound: DataFrame, requested: list[str]) -> DataFrame:
    """bound(adapter_id, produces, remote, deterministic, cost) with rank and fallback.

    Best first: fewest requested keys missing, local, deterministic, cheap, then
    by id. Up to two next ones that produce all that the first does are its fallbacks.
    """
    asked = F.array(*map(F.lit, requested))
    missing = F.size(F.array_except(asked, "produces"))
    ranked = bound.where(F.arrays_overlap(asked, "produces")).withColumn("missing", missing)
    ranked = ranked.withColumn("rank", F.expr("row_number() over (order by missing, remote, not deterministic, cost, adapter_id)"))  # adapters of one deployment: a few
    first = ranked.where("rank = 1").select(F.array_intersect(asked, "produces").alias("needed"))
    stand_in = ranked.join(F.broadcast(first)).withColumn("able", (F.col("rank") > 1) & (F.size(F.array_except("needed", "produces")) == 0))
    nth = F.expr("sum(cast(able as int)) over (order by rank)")
    return stand_in.withColumn("nth", nth).select("adapter_id", "rank", "missing", (F.col("able") & (F.col("nth") <= 2)).alias("fallback"))


def uncertainty_ns(given_ns: Column, clock: Column) -> Column:
    """The larger of what is given and what is typical of the clock; an unheard-of clock counts as unknown."""
    typical = F.element_at(F.create_map(*(F.lit(x) for kv in CLOCKS.items() for x in kv)), F.coalesce(clock, F.lit("unknown")))
    return F.greatest(given_ns, F.coalesce(typical, F.lit(CLOCKS["unknown"])).cast("long") * 1_000_000)


def fusable(a_ns: Column, a_clock: Column, b_ns: Column, b_clock: Column, scale_ns: int) -> Column:
    """Whether two times may be compared: both clocks known, and together no less certain than the phenomenon is long."""
    return (a_clock != "unknown") & (b_clock != "unknown") & (a_ns + b_ns <= scale_ns)


def iso_ns(text: Column) -> Column:
    """Microseconds since 1970 of an ISO-8601 time in nanoseconds; without a zone it is UTC, what is none is null."""
    zoned = F.when(text.rlike(r"(Z|[+-]\d\d:?\d\d)$"), text).otherwise(F.concat(text, F.lit("Z")))
    return F.unix_micros(F.try_to_timestamp(F.when(text.rlike(r"^\d{4}-\d\d-\d\d([T ]\d\d:\d\d(:\d\d(\.\d+)?)?)?(Z|[+-]\d\d:?\d\d)?$"), zoned))) * 1000


def content_digest(places: int = 3) -> Column:
    """What makes an observation new: type, object, class, box to so many decimals and attribute; never id, time or publication."""
    box = F.concat_ws(",", *(F.floor(F.col(c) * 10**places + 0.5).cast("string") for c in ("x1", "y1", "x2", "y2")))
    return F.sha2(F.concat_ws("|", "kind", "object_id", "class_id", box, F.concat_ws("=", "attr_key", "attr_value")), 256)


def summary(rows: DataFrame, by: str, value: str, fractions: dict[str, float] | None = None) -> DataFrame:
    """Count, least, most and percentiles of each group, by the index rule min(n - 1, int(f * n)).

    Two passes: counts by narrow ranges of values (64 to a power of two) find the
    range that holds each rank; only the values of those ranges are then ranked.
    So no task sorts a whole group.
    """
    fractions = fractions or {"p50": 0.5, "p95": 0.95}
    v = F.col(value)
    # infinities and what is no number have ranges of their own, behind all others
    size = F.when(F.isnan(v), 1 << 41).when(F.abs(v) == float("inf"), 1 << 40).otherwise(F.floor(64 * F.log2(F.when(F.isnan(v) | (F.abs(v) == float("inf")), 1.0).otherwise(F.abs(v)))) + (1 << 20))
    given = rows.where(v.isNotNull()).select(by, v.alias("v"), F.when(v == 0, 0).when(v > 0, size).otherwise(-size).cast("long").alias("bin"))
    bins = given.groupBy(by, "bin").agg(F.count("*").alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
    upto = bins.withColumn("upto", F.expr(f"sum(c) over (partition by {by} order by bin)")).withColumn("n", F.expr(f"sum(c) over (partition by {by})"))
    asked = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.least(F.col("n"), F.floor(F.lit(f) * F.col("n")) + 1).alias("rank")) for name, f in fractions.items())))
    wanted = upto.select(by, "bin", "upto", "c", asked.alias("a")).where((F.col("upto") >= F.col("a.rank")) & (F.col("upto") - F.col("c") < F.col("a.rank"))).select(by, "bin", "a.name", (F.col("a.rank") - F.col("upto") + F.col("c")).alias("within"))
    counts = given.join(wanted, [by, "bin"]).groupBy(by, "name", "within", "v").agg(F.count("*").alias("c"))
    ranked = counts.withColumn("upto", F.expr(f"sum(c) over (partition by {by}, name order by v)"))
    found = ranked.where(F.col("upto") >= F.col("within")).groupBy(by).pivot("name", list(fractions)).agg(F.min("v"))
    return upto.groupBy(by).agg(F.max("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most")).join(found, by)


def first_medians(samples: DataFrame) -> DataFrame:
    """samples(name, series, value) to name and p50: the median, by the index rule, of the name's first series in order that has samples."""
    series = samples.groupBy("name").agg(F.min(F.when(F.col("value").isNotNull(), F.col("series"))).alias("first")).withColumnRenamed("name", "n_")
    chosen = samples.join(series, (F.col("name") == F.col("n_")) & (F.col("series") == F.col("first")), "left_semi")
    return summary(chosen.withColumnRenamed("name", "of_"), "of_", "value", {"p50": 0.5}).select(F.col("of_").alias("name"), "p50")
