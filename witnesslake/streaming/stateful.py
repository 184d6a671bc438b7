"""Operators whose result depends on what they last let through, as batch and as Structured Streaming.

The batch forms fold each key's rows in order through an iterator of Arrow
batches, so a hot key is bounded in memory by one batch and its state.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

HEARTBEAT_NS = 30 * 10**9


def admit(last: tuple[int, str] | None, t_ns: int, digest: str, heartbeat_ns: int = HEARTBEAT_NS) -> bool:
    """Whether a fact is published: the first, a changed one, or one a heartbeat after the last published."""
    return last is None or digest != last[1] or t_ns - last[0] >= heartbeat_ns


def _folded(df: DataFrame, key: str, order: list[str], schema: str, start: Callable[[], object], step: Callable) -> DataFrame:
    """step(state, row) -> (state, out or None), over each key's rows in order; keys of a partition follow each other."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                k = getattr(row, key)
                if current != (k,):
                    current, state = (k,), start()
                state, made = step(state, row)
                if made is not None:
                    out.append(made)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(fold, schema)


def suppress(facts: DataFrame, heartbeat_ns: int = HEARTBEAT_NS) -> DataFrame:
    """(subject, t_ns, ordinal, digest) to those published; where a column `always` is true, as for corrections, the fact is in any case."""

    def step(last, row):  # noqa: ANN001, ANN202
        if row.always or admit(last, row.t_ns, row.digest, heartbeat_ns):
            return (row.t_ns, row.digest), (row.subject, row.t_ns, row.ordinal)
        return last, None

    always = F.coalesce("always", F.lit(False)) if "always" in facts.columns else F.lit(False)
    return _folded(facts.select("subject", "t_ns", "ordinal", "digest", always.alias("always")), "subject", ["t_ns", "ordinal"], "subject string, t_ns long, ordinal long", lambda: None, step)


def sample_frames(frames: DataFrame, fps: float) -> DataFrame:
    """Frames a full interval after the last accepted of their camera."""
    gap = int(1e9 / fps)

    def step(last, row):  # noqa: ANN001, ANN202
        return (row.t_ns, (row.camera_id, row.t_ns, row.ordinal)) if last is None or row.t_ns - last >= gap else (last, None)

    return _folded(frames.select("camera_id", "t_ns", "ordinal"), "camera_id", ["t_ns", "ordinal"], "camera_id string, t_ns long, ordinal long", lambda: None, step)


def token_bucket(calls: DataFrame, allowance: float, window_ns: int) -> DataFrame:
    """Calls that a budget of `allowance` tokens a window admits; whole windows refill, credit is capped by the burst."""
    burst = max(1.0, allowance)

    def step(state, row):  # noqa: ANN001, ANN202
        tokens, since = (burst, row.t_ns) if state is None else state
        whole = (row.t_ns - since) // window_ns
        if whole > 0:
            tokens, since = min(burst, tokens + whole * allowance), since + whole * window_ns
        if tokens >= 1:
            return (tokens - 1, since), (row.camera_id, row.t_ns, row.ordinal)
        return (tokens, since), None

    return _folded(calls.select("camera_id", "t_ns", "ordinal"), "camera_id", ["t_ns", "ordinal"], "camera_id string, t_ns long, ordinal long", lambda: None, step)


def rate_limited(calls: DataFrame, most: int = 600, window_ns: int = 60 * 10**9) -> DataFrame:
    """Calls with whether they were admitted: fewer than `most` admitted ones lie within the window before it. Holds `most` times a caller."""

    def step(admitted, row):  # noqa: ANN001, ANN202
        while admitted and admitted[0] <= row.t_ns - window_ns:
            admitted.popleft()
        passed = len(admitted) < most
        if passed:
            admitted.append(row.t_ns)
        return admitted, (row.camera_id, row.t_ns, row.ordinal, passed)

    return _folded(calls.select("camera_id", "t_ns", "ordinal"), "camera_id", ["t_ns", "ordinal"], "camera_id string, t_ns long, ordinal long, passed boolean", deque, step)


def breaker(calls: DataFrame, failures: int = 3, cooldown_ns: int = 30 * 10**9) -> DataFrame:
    """Calls with whether the circuit let them through: it opens after `failures` in a row, for the cooldown."""

    def step(state, row):  # noqa: ANN001, ANN202
        row_failures, open_until = state
        if row.t_ns < open_until:
            return state, (row.camera_id, row.t_ns, row.ordinal, False)
        row_failures = row_failures + 1 if row.failed else 0
        return ((0, row.t_ns + cooldown_ns) if row_failures >= failures else (row_failures, open_until)), (row.camera_id, row.t_ns, row.ordinal, True)

    return _folded(calls.select("camera_id", "t_ns", "ordinal", "failed"), "camera_id", ["t_ns", "ordinal"], "camera_id string, t_ns long, ordinal long, passed boolean", lambda: (0, -(1 << 62)), step)


def suppress_stream(facts: DataFrame, heartbeat_ns: int = HEARTBEAT_NS) -> DataFrame:
    """suppress on a stream that arrives in order: the last published fact of each subject is its state, for good. timed_suppression() needs neither."""
    always = F.coalesce("always", F.lit(False)) if "always" in facts.columns else F.lit(False)

    def publish(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["t_ns", "ordinal"])
        last, out = (state.get if state.exists else None), []
        for row in rows.itertuples(index=False):
            if row.always or admit(last, row.t_ns, row.digest, heartbeat_ns):
                last = (row.t_ns, row.digest)
                out.append((key[0], row.t_ns, row.ordinal))
        if last is not None:
            state.update(last)
        yield pd.DataFrame(out, columns=["subject", "t_ns", "ordinal"])

    given = facts.select("subject", "t_ns", "ordinal", "digest", always.alias("always"))
    return given.groupBy("subject").applyInPandasWithState(publish, "subject string, t_ns long, ordinal long", "t_ns long, digest string", "append", GroupStateTimeout.NoTimeout)


class _Suppression(StatefulProcessor):
    """Facts wait until the watermark has passed them. What was last published is forgotten a heartbeat later: from then on the next fact is published in any case."""

    def __init__(self, heartbeat_ns: int) -> None:
        self.heartbeat_ns = heartbeat_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "t_ns long, ordinal long", "digest string, always boolean")
        self.last = handle.getValueState("last", "t_ns long, digest string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ARG002
        for batch in rows:
            for r in batch.itertuples(index=False):
                self.waiting.updateValue((int(r.t_ns), int(r.ordinal)), (r.digest, bool(r.always)))
            for at in {-(-int(t) // 10**6) for t in batch["t_ns"].unique()}:
                self.handle.registerTimer(at)
        yield pd.DataFrame([], columns=["subject", "t_ns", "ordinal"])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        until = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 10**6
        last, out = self.last.get() if self.last.exists() else None, []
        for (t_ns, ordinal), (digest, always) in sorted((tuple(k), tuple(v)) for k, v in self.waiting.iterator() if k[0] <= until):
            if always or admit(last, t_ns, digest, self.heartbeat_ns):
                last = (t_ns, digest)
                out.append((key[0], t_ns, ordinal))
            self.waiting.removeKey((t_ns, ordinal))
        if last is not None and last[0] + self.heartbeat_ns > until:
            self.last.update(tuple(last))
            self.handle.registerTimer(-(-(last[0] + self.heartbeat_ns) // 10**6))
        else:
            self.last.clear()
        yield pd.DataFrame(out, columns=["subject", "t_ns", "ordinal"])

    def close(self) -> None:
        pass


def timed_suppression(facts: DataFrame, heartbeat_ns: int = HEARTBEAT_NS, late: str = "10 seconds") -> DataFrame:
    """suppress on a stream in any order of arrival within `late`; a subject that is silent for a heartbeat holds no state.

    An ordinal must be one of its kind within a subject and time. The state store must be one that transformWithState takes (RocksDB).
    """
    always = F.coalesce("always", F.lit(False)) if "always" in facts.columns else F.lit(False)
    given = facts.where("subject is not null and t_ns is not null").select("subject", "t_ns", "ordinal", "digest", always.alias("always"), F.timestamp_micros(F.expr("t_ns div 1000")).alias("ts"))
    return given.withWatermark("ts", late).groupBy("subject").transformWithStateInPandas(_Suppression(heartbeat_ns), "subject string, t_ns long, ordinal long", "append", "EventTime")


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts by event time and type; works on a table and, with the watermark, on a stream. Not from the reference."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def fold_to_table(spark: SparkSession, stream: DataFrame, path: str, checkpoint: str) -> None:
    """Drains a stream of (object_id, attr_key, attr_value, t_ns, event_id) into a table of latest values, versioned by batch."""

    def merge(batch: DataFrame, version: int) -> None:
        order = F.struct("t_ns", "event_id")
        news = batch.groupBy("object_id", "attr_key").agg(F.max(order).alias("at"), F.max_by("attr_value", order).alias("attr_value"))
        if version:
            news = news.unionByName(spark.read.parquet(f"{path}/v={version - 1}"))
        news.groupBy("object_id", "attr_key").agg(F.max("at").alias("at"), F.max_by("attr_value", "at").alias("attr_value")).write.mode("overwrite").parquet(f"{path}/v={version}")

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
