"""Demands for attributes: what is acknowledged of them, a store of their versions, and the crops that a budget admits.

The store is a log of commands, appended to and never rewritten. What holds at
any time is a fold of the commands up to it, demand by demand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: No demand is served more freshly than this: a fixed value.
LEAST_FRESHNESS_NS = 10**9


def acknowledge(commands: DataFrame, capabilities: DataFrame, sustainable_ns: int = 0) -> DataFrame:
    """commands(command_id, attributes, freshness_ns, ...) with what is said to each: satisfiable and unsatisfiable attributes, effective freshness and status.

    capabilities(attribute, producible) has the registered attributes. A demand
    of none but unregistered ones is rejected, one that can be met in part
    accepted in part, also where nothing can produce any of it just now; one
    without attributes is accepted. Attributes keep the demand's order.
    """
    known = capabilities.groupBy(F.col("attribute").alias("a_")).agg(F.max("producible").alias("producible"))
    each = commands.select("command_id", F.posexplode("attributes").alias("nth", "attribute")).join(known, F.col("attribute") == F.col("a_"), "left")
    reason = F.when(F.col("a_").isNull(), "attribute_not_registered").when(~F.col("producible"), "no_capable_model")
    listed = each.groupBy("command_id").agg(F.array_sort(F.collect_list(F.struct("nth", "attribute", reason.alias("reason")))).alias("all"))
    said = commands.join(listed, "command_id", "left").withColumn("all", F.coalesce("all", F.array().cast("array<struct<nth: int, attribute: string, reason: string>>")))
    good, bad = F.filter("all", lambda x: x["reason"].isNull()), F.filter("all", lambda x: x["reason"].isNotNull())
    nothing = (F.size("all") > 0) & F.forall("all", lambda x: F.coalesce(x["reason"] == "attribute_not_registered", F.lit(False)))
    return said.select(
        *commands.columns, F.transform(good, lambda x: x["attribute"]).alias("satisfiable"), F.transform(bad, lambda x: F.concat(x["attribute"], F.lit(":"), x["reason"])).alias("unsatisfiable"),
        F.greatest("freshness_ns", F.lit(LEAST_FRESHNESS_NS), F.lit(sustainable_ns)).alias("effective_ns"), F.when(nothing, "rejected").when(F.size(bad) > 0, "partially_accepted").otherwise("accepted").alias("status"),
    )


def outcomes(acknowledged: DataFrame) -> DataFrame:
    """acknowledged commands(demand_id, at_ns, command_id, action, principal, status, ...) with `outcome`, applied or why not, and the demand's `version` after each.

    In order of time and then of command_id: register makes a demand its
    principal's or replaces an own one, update replaces what is there, revoke
    closes it. Refused are rejected demands, updates and revokes of what isn't
    there, and whatever touches another's demand. A rejected update has closed
    what it was to replace (`withdrawn`), as it revokes before it registers. A
    demand's commands are folded in one array, as one writer would.
    """
    step = "named_struct('owner', {owner}, 'version', {version}, 'out', concat(acc.out, array(named_struct('command_id', x.command_id, 'outcome', {outcome}, 'version', {version}))))"
    outcome = "case when x.action <> 'register' and acc.owner is null then 'unknown' when acc.owner is not null and acc.owner <> x.principal then 'forbidden' when x.action <> 'revoke' and x.status = 'rejected' then if(x.action = 'update', 'withdrawn', 'rejected') else 'applied' end"
    owner = f"case when {outcome} not in ('applied', 'withdrawn') then acc.owner when x.action = 'revoke' or x.status = 'rejected' then cast(null as string) else x.principal end"
    version = f"case when {outcome} in ('applied', 'withdrawn') then acc.version + 1 else acc.version end"
    start = "named_struct('owner', cast(null as string), 'version', 0, 'out', cast(array() as array<struct<command_id: bigint, outcome: string, version: int>>))"
    listed = acknowledged.groupBy("demand_id").agg(F.array_sort(F.collect_list(F.struct("at_ns", F.col("command_id").cast("long").alias("command_id"), "action", "principal", "status"))).alias("all"))
    folded = listed.select(F.explode(F.expr(f"aggregate(all, {start}, (acc, x) -> {step.format(owner=owner, version=version, outcome=outcome)}, acc -> acc.out)")).alias("o")).select(F.col("o.command_id").alias("c_"), "o.outcome", "o.version")
    return acknowledged.join(folded, F.col("command_id") == F.col("c_")).drop("c_")


def versions(judged: DataFrame) -> DataFrame:
    """The demands that outcomes() lets stand: a row a version, from when and, if replaced or revoked, until when."""
    applied = judged.where("outcome in ('applied', 'withdrawn')")
    ended = applied.withColumn("until_ns", F.expr("lead(at_ns) over (partition by demand_id order by version)"))
    return ended.where("action <> 'revoke' and outcome = 'applied'").select("demand_id", "version", F.col("principal").alias("subscriber"), "satisfiable", "unsatisfiable", "effective_ns", "status", F.col("at_ns").alias("since_ns"), "until_ns")


def as_of(stored: DataFrame, at_ns: int) -> DataFrame:
    """The versions that hold at a time."""
    return stored.where((F.col("since_ns") <= at_ns) & (F.col("until_ns").isNull() | (F.col("until_ns") > at_ns)))


def append(commands: DataFrame, path: str) -> None:
    """Adds commands to the store's log; one writer at a time, ids not used before."""
    commands.write.mode("append").parquet(path)


def admit(requests: DataFrame, budget: int, ceiling: int, window_ns: int, order: str = "priority desc, request_id") -> DataFrame:
    """requests(camera_id, t_ns, request_id, refunded, ...) with `outcome`: admitted, preempted or exhausted.

    A camera's requests of one time are a frame, which takes them by `order`, its
    first `ceiling` at most. All frames share `budget` calls in each window of
    time, in the order of time and camera; what a frame gives back (`refunded`)
    later frames of the window may spend. Only frames are ranked: of each, a
    row with its number of requests and of refunds among the first ones goes into
    the fold of its window, so no window's requests ever meet.
    """
    placed = requests.withColumns({"window_": F.expr(f"t_ns div {window_ns}"), "place_": F.expr(f"row_number() over (partition by camera_id, t_ns order by {order})")})
    back = F.transform(F.array_sort(F.collect_list(F.when(F.col("place_") <= ceiling, F.struct("place_", F.col("refunded").cast("int").alias("r"))))), lambda x: x["r"])
    frames = placed.groupBy("window_", "t_ns", "camera_id").agg(F.least(F.count("*"), F.lit(ceiling)).cast("int").alias("n"), back.alias("back"))
    listed = frames.groupBy("window_").agg(F.array_sort(F.collect_list(F.struct("t_ns", "camera_id", "n", "back"))).alias("frames"))
    took = "least(acc.credit, x.n)"
    step = f"named_struct('credit', acc.credit - {took} + aggregate(slice(x.back, 1, {took}), 0, (s, r) -> s + r), 'out', concat(acc.out, array(named_struct('t_ns', x.t_ns, 'camera_id', x.camera_id, 'credit', acc.credit))))"
    start = f"named_struct('credit', {int(budget)}, 'out', cast(array() as array<struct<t_ns: bigint, camera_id: string, credit: int>>))"
    credits = listed.select(F.explode(F.expr(f"aggregate(frames, {start}, (acc, x) -> {step}, acc -> acc.out)")).alias("f")).select(F.col("f.t_ns").alias("t_"), F.col("f.camera_id").alias("cam_"), "f.credit")
    joined = placed.join(credits, (F.col("t_ns") == F.col("t_")) & F.col("camera_id").eqNullSafe(F.col("cam_")))
    outcome = F.when((F.col("place_") <= ceiling) & (F.col("place_") <= F.col("credit")), "admitted").when(F.col("credit") >= ceiling, "preempted").otherwise("exhausted")
    return joined.withColumn("outcome", outcome).drop("window_", "place_", "t_", "cam_", "credit")


def demand_calls(admitted: DataFrame, window_ns: int) -> DataFrame:
    """(window_no, demand_id, calls): what each demand has had of each window, refunds taken off."""
    spent = admitted.where("outcome = 'admitted' and not refunded").select(F.expr(f"t_ns div {window_ns}").alias("window_no"), F.explode("demand_ids").alias("demand_id"))
    return spent.groupBy("window_no", "demand_id").agg(F.count("*").alias("calls"))
