"""Evidence: what may be served, what an erasure takes with it, and the frame that a decision was made on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from witnesslake.sources import store


def reached(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(id): all that edges(source, id) reach from roots(id), these included; cycles end where they began.

    Each round joins the newly found ids alone with the edges and drops those
    known before, so the rounds are as many as the longest shortest way has
    edges. Null ids reach nothing.
    """
    links = store.cut(edges.where("source is not null and id is not null").select("source", "id").distinct())
    known = new = store.cut(roots.where("id is not null").select("id").distinct())
    while not new.isEmpty():
        step = links.join(new.select(F.col("id").alias("source")), "source", "left_semi").select("id").distinct()
        new = store.cut(step.join(known, "id", "left_anti"))
        known = store.cut(known.unionByName(new))
    return known


def erase(records: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """records(evidence_id, tenant_id, content_hash, size_bytes, ...) with `fate` after the erasure of roots(id) and all that derives from them: kept, erased, or record_erased.

    A record goes with what it derives from or supersedes (edges). Its content,
    shared by all records of a tenant with its hash, goes with the last of them:
    where another record still needs it only the record goes. A tombstone, the
    record without content, stays of each.
    """
    gone = reached(edges, roots).withColumnRenamed("id", "gone")
    marked = records.join(gone, F.col("evidence_id") == F.col("gone"), "left")
    held = marked.where("gone is null").select(F.col("tenant_id").alias("t_"), F.col("content_hash").alias("h_")).distinct()
    both = marked.join(held, F.col("tenant_id").eqNullSafe(F.col("t_")) & (F.col("content_hash") == F.col("h_")), "left")
    fate = F.when(F.col("gone").isNull(), "kept").when(F.col("h_").isNotNull(), "record_erased").otherwise("erased")
    return both.withColumn("fate", fate).drop("gone", "t_", "h_")


def reclaimed(erased: DataFrame) -> DataFrame:
    """(tenant_id, erased, bytes): tombstones and the bytes of contents that no record holds any more, each content once."""
    blobs = erased.where("fate = 'erased'").groupBy("tenant_id", "content_hash").agg(F.max("size_bytes").alias("bytes"))
    freed = blobs.groupBy(F.col("tenant_id").alias("t_")).agg(F.sum("bytes").alias("bytes"))
    count = erased.where("fate <> 'kept'").groupBy("tenant_id").agg(F.count("*").alias("erased"))
    return count.join(freed, F.col("tenant_id").eqNullSafe(F.col("t_")), "left").select("tenant_id", "erased", F.coalesce("bytes", F.lit(0)).alias("bytes"))


def servability(asked: DataFrame, records: DataFrame, blobs: DataFrame, now_ns: int) -> DataFrame:
    """asked(evidence_ref) with why each may not be served, or servable.

    records(evidence_ref, state, expires_at_ns, content_hash, storage_ref) and
    blobs(storage_ref, digest) of what the store really has. In order: no such
    record, deleted, past its retention (even if its bytes are still there),
    bytes missing, bytes of another digest than recorded.
    """
    r, b = records.select("evidence_ref", "state", "expires_at_ns", "content_hash", F.col("storage_ref").alias("at_")), blobs.select(F.col("storage_ref").alias("b_"), F.col("digest").alias("d_"))
    joined = asked.join(r, "evidence_ref", "left").join(b, F.col("at_") == F.col("b_"), "left")
    expired = (F.col("state") != "RETAINED") | F.coalesce(F.col("expires_at_ns") <= now_ns, F.lit(False))
    why = (
        F.when(F.col("state").isNull(), "no_such_record").when(F.col("state") == "DELETED", "deleted").when(expired, "expired").when(F.col("b_").isNull(), "bytes_missing")
        .when((F.coalesce("content_hash", F.lit("")) != "") & ~F.col("content_hash").eqNullSafe(F.col("d_")), "integrity_failed").otherwise("servable")
    )
    return joined.select("evidence_ref", why.alias("status"))


def decision_frames(decisions: DataFrame, frames: DataFrame, tolerance_ns: int) -> DataFrame:
    """decisions(decision_id, camera_id, object_id, at_ns) with the frame that each was made on: frame_ref, captured_ns and kind.

    It is the newest of frames(camera_id, object_id, frame_ref, t_ns) that holds
    the object, at the decision's time or up to the tolerance before it, never
    after; of several of one time that of the greatest ref. Where there is none
    the kind is context-frame, so nothing claims to be what it isn't. Time is cut
    into steps of the tolerance: a decision meets its own step and the one before.
    """
    step = lambda c: F.expr(f"{c} div {tolerance_ns}")
    asked = decisions.withColumn("step_", F.explode(F.array(step("at_ns"), step("at_ns") - 1)))
    held = frames.select(F.col("camera_id").alias("c_"), F.col("object_id").alias("o_"), step("t_ns").alias("s_"), F.struct("t_ns", "frame_ref").alias("f"))
    near = (F.col("camera_id") == F.col("c_")) & (F.col("object_id") == F.col("o_")) & (F.col("step_") == F.col("s_")) & (F.col("f.t_ns") <= F.col("at_ns")) & (F.col("f.t_ns") >= F.col("at_ns") - tolerance_ns)
    best = asked.join(held, near, "left").groupBy("decision_id", "camera_id", "object_id", "at_ns").agg(F.max("f").alias("f"))
    return best.select("decision_id", "camera_id", "object_id", "at_ns", "f.frame_ref", F.col("f.t_ns").alias("captured_ns"), F.when(F.col("f").isNull(), "context-frame").otherwise("decision-frame").alias("kind"))
