"""The frame ledger: what became of each frame, merged from notes that come later, field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from witnesslake.operators import ordered

#: Frames that a camera's ledger holds: a fixed value.
CAPACITY = 512
FIELDS = ("processing_ms", "detection_count", "observation_count", "object_ids", "evidence_refs", "error")


def effective_notes(records: DataFrame, notes: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame]:
    """records with their `position` in the camera's ledger, and the notes that found their frame there.

    A note comes to nothing if its frame isn't recorded yet at the note's time,
    or if `capacity` frames of the camera have been recorded since. Positions and
    the latest one at a note's time are found span of time by span of time, so a
    hot camera is no one task's work.
    """
    placed = ordered.numbered(records.withColumn("t_ns", F.col("received_at_ns")), "camera_id", "sequence", "position").drop("t_ns")
    of = placed.select(F.col("frame_ref").alias("r_"), "camera_id", "position")
    asked = notes.join(of, F.col("frame_ref") == F.col("r_")).drop("r_")
    none = F.lit(None).cast("long")
    # a record of a note's own time comes before it
    both = placed.select("camera_id", F.col("received_at_ns").alias("t_ns"), F.lit(0).alias("kind"), F.col("sequence").alias("n"), F.col("position").alias("latest"), none.alias("note_id")).unionByName(
        asked.select("camera_id", F.col("at_ns").alias("t_ns"), F.lit(1).alias("kind"), F.col("note_id").alias("n"), none.alias("latest"), "note_id")
    )
    latest = ordered.carried(both, ["camera_id"], ["kind", "n"], "latest").where("kind = 1").select(F.col("note_id").alias("n_"), "found")
    live = asked.join(latest, F.col("note_id") == F.col("n_")).where((F.col("found") >= F.col("position")) & (F.col("found") - F.col("position") < capacity))
    return placed, live.drop("camera_id", "position", "n_", "found")


def entries(records: DataFrame, notes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """A row a frame: the record, each field as the latest note that gives it says, and whether the ledger still holds it.

    records(camera_id, frame_ref, sequence, captured_at_ns, received_at_ns) and
    notes(note_id, frame_ref, at_ns, and FIELDS, of which any may be null).
    `processed` says that any note came, `counts_reported` that one gave a count:
    only then is a frame without observations `empty`, else that is unknown.
    """
    placed, live = effective_notes(records, notes, capacity)
    order = F.struct("at_ns", "note_id")
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    counted = (F.col("detection_count").isNotNull() | F.col("observation_count").isNotNull()).cast("int")
    merged = live.groupBy(F.col("frame_ref").alias("r_")).agg(*map(latest, FIELDS), (F.max(counted) == 1).alias("counts_reported"))
    newest = placed.groupBy(F.col("camera_id").alias("c_")).agg(F.max("position").alias("newest"))
    both = placed.join(merged, F.col("frame_ref") == F.col("r_"), "left").join(newest, F.col("camera_id") == F.col("c_"))
    reported = F.coalesce("counts_reported", F.lit(False))
    text = F.array().cast("array<string>")

    def given(c: str, otherwise: Column) -> Column:
        return F.coalesce(c, otherwise).alias(c)

    return both.select(
        "camera_id", "frame_ref", "sequence", "captured_at_ns", "received_at_ns", F.greatest(F.lit(0.0), (F.col("received_at_ns") - F.col("captured_at_ns")) / 1e6).alias("queue_delay_ms"), F.col("r_").isNotNull().alias("processed"), reported.alias("counts_reported"),
        given("processing_ms", F.lit(0.0)), given("detection_count", F.lit(0)), given("observation_count", F.lit(0)), given("object_ids", text), given("evidence_refs", text), given("error", F.lit("")),
        F.when(reported, F.coalesce("observation_count", F.lit(0)) == 0).alias("empty"), (F.col("newest") - F.col("position") < capacity).alias("held"),
    )
