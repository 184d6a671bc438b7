"""Order within large groups, such as a camera's log, without a task that holds a whole group.

A group is cut into spans of time. A window then sorts one span of one group;
what it needs of the spans before or after comes from a table of one row a span,
joined on the window's own keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Length of a span.
SPAN_NS = 3600 * 10**9


def _spanned(rows: DataFrame) -> DataFrame:
    return rows.withColumn("span_", F.expr(f"t_ns div {SPAN_NS}"))


def numbered(rows: DataFrame, by: str, tie: str, name: str) -> DataFrame:
    """rows with `name`: the place of each in its group, from 1, by t_ns and then by the tie."""
    spans = _spanned(rows)
    counts = spans.groupBy(by, "span_").agg(F.count("*").alias("n_"))
    before = counts.select(F.col(by).alias("by_"), F.col("span_").alias("at_"), F.expr("coalesce(sum(n_) over (partition by {0} order by span_ rows between unbounded preceding and 1 preceding), 0)".format(by)).alias("before_"))
    joined = spans.join(before, (F.col(by) == F.col("by_")) & (F.col("span_") == F.col("at_")))
    place = F.col("before_") + F.expr(f"row_number() over (partition by {by}, span_ order by t_ns, {tie})")
    return joined.withColumn(name, place.cast("long")).drop("span_", "by_", "at_", "before_")


def neighbours(rows: DataFrame, by: str, tie: str, column: str) -> DataFrame:
    """rows with `previous` and `next`: a column's value in the rows before and after in the group."""
    spans = _spanned(rows)
    order = F.struct("t_ns", tie)
    ends = spans.groupBy(by, "span_").agg(F.min_by(column, order).alias("first_"), F.max_by(column, order).alias("last_"))
    over = f"over (partition by {by} order by span_)"
    beside = ends.select(F.col(by).alias("by_"), F.col("span_").alias("at_"), F.expr(f"lag(last_) {over}").alias("last_"), F.expr(f"lead(first_) {over}").alias("first_"))
    joined = spans.join(beside, (F.col(by) == F.col("by_")) & (F.col("span_") == F.col("at_")))
    within = f"over (partition by {by}, span_ order by t_ns, {tie})"
    # the first and last rows of a span look beyond it
    out = joined.withColumn("previous", F.coalesce(F.expr(f"lag({column}) {within}"), F.when(F.expr(f"row_number() {within}") == 1, F.col("last_"))))
    out = out.withColumn("next", F.expr(f"lead({column}, 1, first_) {within}"))
    return out.drop("span_", "by_", "at_", "first_", "last_")


def carried(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """rows with `found`: the latest value that isn't null in the group, up to the row itself, by t_ns and then `order`."""
    spans = _spanned(rows)
    last = F.max_by(value, F.when(F.col(value).isNotNull(), F.struct("t_ns", *order)))
    ends = spans.groupBy(*keys, "span_").agg(last.alias("last_"))
    by = ", ".join(keys)
    before = ends.select(*(F.col(k).alias(f"{k}_") for k in keys), F.col("span_").alias("at_"), F.expr(f"last(last_, true) over (partition by {by} order by span_ rows between unbounded preceding and 1 preceding)").alias("before_"))
    on = F.col("span_") == F.col("at_")
    for k in keys:
        on = on & (F.col(k) == F.col(f"{k}_"))
    within = F.expr(f"last({value}, true) over (partition by {by}, span_ order by t_ns, {', '.join(order)} rows between unbounded preceding and current row)")
    return spans.join(before, on).withColumn("found", F.coalesce(within, F.col("before_"))).drop("span_", "at_", "before_", *(f"{k}_" for k in keys))


def tree_digest(digests: DataFrame, by: str, place: str, digest: str, width: int = 256) -> DataFrame:
    """digests(by, place, digest) as one a group: level by level, `width` digests of neighbouring places become one, until one is left.

    No row ever holds more than `width`; the levels grow with the logarithm of the places.
    """
    level = digests.select(by, F.col(place).cast("long").alias("place"), F.col(digest).alias("digest"))
    most = level.agg(F.max("place")).first()[0]
    while most is not None:
        listed = F.array_sort(F.collect_list(F.struct("place", "digest")))
        level = level.groupBy(by, F.expr(f"place div {width}").alias("place")).agg(F.sha2(F.array_join(F.transform(listed, lambda s: s["digest"]), "\n"), 256).alias("digest"))
        if most < width:
            break
        most //= width
    return level.select(by, "digest")


def flat_digest(digests: DataFrame, by: str, place: str, digest: str) -> DataFrame:
    """digests(by, place, digest) as one a group, with their number n: the SHA-256 of all of them in order of place, a newline between two.

    SHA-256 has no parts that could be joined, so a task goes through a group's
    digests one after the other; it holds a batch of them, never the group.
    """
    nothing = object()

    def chained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, made, n = nothing, hashlib.sha256(), 0
        for batch in batches:
            out = []
            for group, d in zip(batch[by], batch[digest], strict=True):
                if group != key:
                    if key is not nothing:
                        out.append((key, made.hexdigest(), n))
                    key, made, n = group, hashlib.sha256(), 0
                made.update(f"\n{d}".encode() if n else d.encode())
                n += 1
            yield pd.DataFrame(out, columns=[by, "digest", "n"])
        if key is not nothing:
            yield pd.DataFrame([(key, made.hexdigest(), n)], columns=[by, "digest", "n"])

    rows = digests.select(by, place, digest).repartition(by).sortWithinPartitions(by, place)
    return rows.mapInPandas(chained, f"{by} {dict(digests.dtypes)[by]}, digest string, n long")
