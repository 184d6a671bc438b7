"""Subscriptions as an inverted index: a join on what they ask for, no test an entry a row."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from witnesslake.operators.evaluator import class_chain

#: A subscription's lists and the observation's column that each is about.
DIMENSIONS = {"kinds": "kind", "cameras": "camera_id", "classes": "class_id", "keys": "attr_key"}


def _shape() -> Column:
    """Which lists a subscription has, as bits; an empty or null one asks for nothing."""
    return sum((F.when(F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0, 1 << b).otherwise(0) for b, c in enumerate(DIMENSIONS)), F.lit(0))


def index(subscriptions: DataFrame) -> DataFrame:
    """(subscription, shape, terms): a row for each combination of what a subscription's lists name.

    A class below another of its list is left out, so no observation finds a
    subscription twice.
    """
    out = subscriptions.select("subscription", _shape().alias("shape"), *DIMENSIONS)
    out = out.withColumn("classes", F.filter("classes", lambda c: ~F.exists("classes", lambda d: F.startswith(c, F.concat(d, F.lit("."))))))
    for b, c in enumerate(DIMENSIONS):
        named = F.when(F.col("shape").bitwiseAND(1 << b) > 0, F.array_distinct(c)).otherwise(F.array(F.lit(None).cast("string")))
        out = out.withColumn(c, F.explode(named))
    return out.select("subscription", "shape", F.struct(*DIMENSIONS).alias("terms"))


def _looked_up(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """What rows ask the index for, as shape_ and terms_ in place of the observation's columns: once for each set of lists in use, with their classes and those above them."""
    shapes = [r["shape"] for r in entries.select("shape").distinct().orderBy("shape").collect()]  # 16 rows at most
    in_use = F.from_json(F.lit(json.dumps(shapes)), "array<int>")
    asked = rows.withColumn("shape_", F.explode(in_use))
    # a class stands for itself and those above it where the shape has classes
    classes = F.when(F.col("shape_").bitwiseAND(4) > 0, class_chain(F.col("class_id"))).otherwise(F.array(F.lit(None).cast("string")))
    asked = asked.withColumn("class_id", F.explode(classes))
    terms = F.struct(*(F.when(F.col("shape_").bitwiseAND(1 << b) > 0, F.col(v)).alias(c) for b, (c, v) in enumerate(DIMENSIONS.items())))
    known = F.lit(True)
    for b, v in enumerate(DIMENSIONS.values()):
        known = known & ((F.col("shape_").bitwiseAND(1 << b) == 0) | F.col(v).isNotNull())
    return asked.where(known).withColumn("terms_", F.to_json(terms)).drop(*DIMENSIONS.values())


def _found(probes: DataFrame, entries: DataFrame) -> DataFrame:
    """probes with the subscriptions that their terms lead to."""
    stored = entries.select("subscription", "shape", F.to_json("terms").alias("terms"))
    return probes.join(stored, (F.col("shape") == F.col("shape_")) & (F.col("terms") == F.col("terms_"))).drop("shape", "shape_", "terms", "terms_")


def matches(obs: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(subscription, observation_id): observations with the subscriptions(subscription, kinds, cameras, classes, keys) that cover them.

    A subscription covers an observation if each of its lists that isn't empty
    holds the observation's value, a class also all classes below it. Each
    observation is looked up once for each set of lists in use, of which there
    are 16 at most, with its class and those above it.
    """
    entries = index(subscriptions)
    probes = _looked_up(obs.select("observation_id", *DIMENSIONS.values()), entries)
    return _found(probes, entries).select("subscription", "observation_id")


def totals(obs: DataFrame, subscriptions: DataFrame, value: str) -> DataFrame:
    """(subscription, n, first, last): how many observations matches() finds for each subscription, and the least and greatest of their values.

    Observations of like kind, camera, class and key are counted before they are
    looked up, and so are those that ask the index the same, so an entry of the
    index finds one row at most and no pairs are made.
    """
    entries = index(subscriptions)
    summed = (F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
    alike = obs.groupBy(*DIMENSIONS.values()).agg(F.count("*").alias("n"), F.min(value).alias("first"), F.max(value).alias("last"))
    probes = _looked_up(alike, entries).groupBy("shape_", "terms_").agg(*summed)
    # the file that subscriptions come from says little of the size of their index: it is never broadcast
    return _found(probes.hint("merge"), entries).groupBy("subscription").agg(*summed)
