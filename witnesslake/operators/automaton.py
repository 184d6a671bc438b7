"""Automata over large groups: a row's state depends on all rows before it, yet no task reads a whole group.

What a run of rows does to an automaton is a function of states to states, and
functions of neighbouring runs compose. So a group is cut into spans of time:
each span's function is made on its own, the few functions of a group are
composed in order, and with the state that it is entered in each span is then
gone through on its own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Length of a span; the result doesn't depend on it.
SPAN_NS = 3600 * 10**9


def scan(rows: DataFrame, by: str, order: Sequence[str], symbol: str, step: Sequence[Sequence[int]], start: int = 0, span_ns: int | None = SPAN_NS) -> DataFrame:
    """rows with `state`, the automaton's after each row of its group, and `state_before`.

    `step[symbol][state]` is the next state. Rows are taken by t_ns and then by
    `order`, which should leave no ties; with span_ns None a group is one span.
    Rows whose symbol is null leave the state as it is.
    """
    steps = np.array([*step, range(len(step[0]))], dtype=np.int32)
    spanned = rows.withColumn("span_", F.expr(f"t_ns div {span_ns}") if span_ns else F.lit(0).cast("long"))
    sorted_by = [by, "span_", "t_ns", *order]

    def symbols(batch: pd.DataFrame) -> np.ndarray:
        return batch[symbol].fillna(len(step)).to_numpy(np.int64)

    def runs(batch: pd.DataFrame) -> Iterator[tuple[object, int, int, int]]:
        """(group, span, begin, end) of the runs of a sorted batch."""
        keys, spans = batch[by].to_numpy(object), batch["span_"].to_numpy(np.int64)
        edges = np.flatnonzero((keys[1:] != keys[:-1]) | (spans[1:] != spans[:-1])) + 1
        for lo, hi in zip([0, *edges], [*edges, len(batch)], strict=True):
            if hi > lo:
                yield keys[lo], spans[lo], lo, hi

    def functions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, made = None, None
        for batch in batches:
            said, out = symbols(batch), []
            for group, span, lo, hi in runs(batch):
                if (group, span) != key:
                    if key is not None:
                        out.append((*key, made.tolist()))
                    key, made = (group, span), np.arange(steps.shape[1], dtype=np.int32)
                for s in said[lo:hi]:
                    made = steps[s][made]
            yield pd.DataFrame(out, columns=[by, "span_", "does"])
        if key is not None:
            yield pd.DataFrame([(*key, made.tolist())], columns=[by, "span_", "does"])

    kind = dict(rows.dtypes)[by]
    done = spanned.select(*sorted_by, symbol).repartition(by, "span_").sortWithinPartitions(*sorted_by).mapInPandas(functions, f"{by} {kind}, span_ long, does array<int>")
    # a row a span: the states that a group's spans are entered in, one after the other
    listed = F.array_sort(F.collect_list(F.struct("span_", "does")))
    entered = F.aggregate(listed, F.struct(F.lit(start).alias("at"), F.array().cast("array<struct<span_: long, enter: int>>").alias("out")), lambda acc, x: F.struct(F.element_at(x["does"], acc["at"] + 1).alias("at"), F.concat(acc["out"], F.array(F.struct(x["span_"].alias("span_"), acc["at"].alias("enter")))).alias("out")), lambda acc: acc["out"])
    entries = done.groupBy(F.col(by).alias("by_")).agg(entered.alias("entries")).select("by_", F.inline("entries")).withColumnRenamed("span_", "at_")
    joined = spanned.join(entries, F.col(by).eqNullSafe(F.col("by_")) & (F.col("span_") == F.col("at_"))).drop("by_", "at_")

    def states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, at = None, start
        for batch in batches:
            said, enter = symbols(batch), batch["enter"].to_numpy(np.int64)
            before, after = np.empty(len(batch), np.int32), np.empty(len(batch), np.int32)
            for group, span, lo, hi in runs(batch):
                if (group, span) != key:
                    key, at = (group, span), enter[lo]
                for i in range(lo, hi):
                    before[i], at = at, steps[said[i], at]
                    after[i] = at
            yield batch.drop(columns=["span_", "enter"]).assign(state_before=before, state=after)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", state_before int, state int"
    return joined.repartition(by, "span_").sortWithinPartitions(*sorted_by).mapInPandas(states, schema)
