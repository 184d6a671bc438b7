"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected at random onto a few axes, shifted and put in the order of
a Hilbert curve, several times over. Spark range-partitions each ordering; ranks
along it cut it into tiles. A query looks through a window of neighbouring ranks
on every curve; what its windows hold is merged and ranked by the exact measure.

How wide windows must be depends on the vectors, so it is measured: a bounded
sample of queries is compared with all vectors, and the window is the rank
distance within which the wanted share of their true neighbours lies on the
nearest curve.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from witnesslake.llm.common import cut, small_batches

CURVES, AXES, AXIS_BITS = 8, 8, 7
SEED = 20
#: Rows that centres and scales are fitted on, and queries that the window is measured on: those of the smallest hashes.
FIT_ROWS, PROBES = 4096, 96
#: Share of true neighbours that windows are to hold.
WANTED = 0.96
#: Vectors of a tile and queries compared with it at once, at most.
TILE, QUERIES = 4096, 4096


def hilbert(grid: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of points (n, axes) with `bits` bits an axis, after Skilling (2004)."""
    x = grid.astype(np.int64).copy()
    axes, top = x.shape[1], 1 << bits - 1
    level = top
    while level > 1:
        low = level - 1
        for i in range(axes):
            high = (x[:, i] & level) != 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(high, low, swap)
            x[:, i] ^= swap
        level >>= 1
    for i in range(1, axes):
        x[:, i] ^= x[:, i - 1]
    flip, level = np.zeros(len(x), np.int64), top
    while level > 1:
        flip ^= np.where(x[:, -1] & level, level - 1, 0)
        level >>= 1
    x ^= flip[:, None]
    place = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            place = place << 1 | x[:, i] >> b & 1
    return place


def _projections(dim: int) -> np.ndarray:
    """(curves, dim, axes): orthonormal axes for each curve."""
    rng = np.random.default_rng(SEED)
    return np.stack([np.linalg.qr(rng.normal(size=(dim, min(dim, AXES))))[0] for _ in range(CURVES)])


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 0))


def _stored_as(embeddings: DataFrame) -> str:
    """Single precision is kept where it is given, which halves what is shuffled; scores are always in double."""
    given = embeddings.schema["embedding"].dataType.simpleString()
    return given if given == "array<float>" else "array<double>"


def vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x) of rows that take part: no null, zero or non-finite vector or component, no null id, and the commonest dimension."""
    x = F.col("embedding").cast(_stored_as(embeddings))
    odd = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    good = embeddings.select("vec_id", x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & ~F.coalesce(F.exists("x", odd), F.lit(True)) & F.exists("x", lambda v: v != 0))
    common = good.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    return good.where(F.size("x") == (common.dim if common else 0))


def _top(scores: np.ndarray, least: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row the columns of its k largest scores, ties to the smaller `least`; -inf never counts."""
    for i, row in enumerate(scores):
        if len(row) > 4 * k:
            edge = np.partition(row, len(row) - k)[len(row) - k]
            at = np.flatnonzero((row >= edge) & (row > -np.inf))
        else:
            at = np.flatnonzero(row > -np.inf)
        yield i, at[np.lexsort((least[at], -row[at]))[:k]]


def search(embeddings: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest found of each row whose vec_id is divisible by `every`.

    Nearness is the inner product in double precision; ties go to the smaller
    vec_id; a query isn't its own neighbour. Equal vectors are searched once and
    give their smallest ids. Rows that take no part (see vectors) neither ask nor
    answer; with fewer candidates than k all are returned. A vec_id repeated
    counts once, with that of its vectors whose hash is smallest. An empty table
    gives an empty result.
    """
    spark = embeddings.sparkSession
    small_batches(spark)
    good = vectors(embeddings)
    ids = cut(good.groupBy("vec_id").agg(F.min_by("x", F.xxhash64("x")).alias("x")).select("vec_id", F.xxhash64("x").alias("uid"), "x"))
    # of equal vectors no more than k + 1 ids can be among the nearest
    ranked = ids.selectExpr("*", "row_number() over (partition by uid order by vec_id) as nth").where(f"nth <= {k + 1}")
    unique = cut(ranked.groupBy("uid").agg(F.first("x").alias("x"), F.array_sort(F.collect_list("vec_id")).alias("ids")))
    asked = cut(ids.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("uid").alias("q")))
    total = unique.count()
    result = "query_id long, rank int, vec_id long, score double"
    if not total or asked.isEmpty():
        return spark.createDataFrame([], result)
    placed = _placed(unique, asked)
    window = _window(unique, placed, k)
    found = _compare(placed, window, total, k)
    best = found.groupBy("q", "uid", "least").agg(F.max("score").alias("score")).selectExpr("*", "row_number() over (partition by q order by score desc, least) as nth").where(f"nth <= {k + 1}")
    members = best.join(unique.select("uid", "ids"), "uid").select("q", "score", F.explode("ids").alias("vec_id"))
    lists = members.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))), 1, k + 1).alias("near"))  # (k + 1) ** 2 at most
    mine = asked.join(lists, "q").select("query_id", F.slice(F.filter("near", lambda s: s["vec_id"] != F.col("query_id")), 1, k).alias("near"))
    flat = mine.select("query_id", F.posexplode("near").alias("at", "n"))
    return flat.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("n.vec_id").alias("vec_id"), (-F.col("n.far")).alias("score"))


def _placed(unique: DataFrame, asked: DataFrame) -> DataFrame:
    """(curve, rank, uid, x, least, asks): each distinct vector's rank on each curve."""
    sample = _stack(pd.Series([r.x for r in unique.orderBy(F.xxhash64("uid")).limit(FIT_ROWS).select("x").collect()]))
    axes = _projections(sample.shape[1])
    shadow = np.einsum("nd,cda->cna", sample, axes)
    centre, scale = shadow.mean(axis=1), np.maximum(shadow.std(axis=1), 1e-12)
    shift = np.random.default_rng(SEED + 1).uniform(-0.5, 0.5, centre.shape)
    cells = 1 << AXIS_BITS

    def curves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = _stack(batch["x"])
            for c in range(CURVES) if len(batch) else ():
                y = (x @ axes[c] - centre[c]) / scale[c] + shift[c]
                grid = np.clip((y + 4) / 8 * cells, 0, cells - 1)
                yield batch.assign(curve=np.int32(c), place=hilbert(grid, AXIS_BITS))

    asks = asked.select(F.col("q").alias("uid")).distinct().withColumn("asks", F.lit(True))
    rows = unique.select("uid", "x", F.element_at("ids", 1).alias("least")).join(asks, "uid", "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
    kind = rows.schema["x"].dataType.simpleString()
    keyed = rows.mapInPandas(curves, f"uid long, x {kind}, least long, asks boolean, curve int, place long")
    n = int(unique.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed.repartitionByRange(n, "curve", "place", "uid").sortWithinPartitions("curve", "place", "uid")

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            yield batch.drop(columns="place").assign(part=part, nth=np.arange(before, before + len(batch)))
            before += len(batch)

    numbered = cut(ordered.mapInPandas(number, f"uid long, x {kind}, least long, asks boolean, curve int, part int, nth long"))
    sizes = numbered.groupBy("part", "curve").agg(F.count("*").alias("n"), F.min("nth").alias("first")).orderBy("curve", "part").collect()  # partitions and curves
    at, offsets = {}, []
    for r in sizes:
        offsets.append((r.part, r.curve, at.get(r.curve, 0) - r["first"]))
        at[r.curve] = at.get(r.curve, 0) + r.n
    base = F.broadcast(unique.sparkSession.createDataFrame(offsets, "part int, curve int, base long"))
    return numbered.join(base, ["part", "curve"]).select("curve", (F.col("base") + F.col("nth")).alias("rank"), "uid", "x", "least", "asks")


def _window(unique: DataFrame, placed: DataFrame, k: int) -> int:
    """The rank distance that holds the wanted share of the probes' true neighbours."""
    first = placed.where("curve = 0")
    probes = first.where("asks").orderBy(F.xxhash64("uid")).limit(PROBES).select("uid", "x").collect()
    ours, asked = _stack(pd.Series([p.x for p in probes])), [p.uid for p in probes]

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                scores = ours @ _stack(batch["x"]).T
                for i, at in _top(scores, batch["least"].to_numpy(), k + 1):
                    yield pd.DataFrame({"q": asked[i], "uid": batch["uid"].to_numpy()[at], "score": scores[i, at]})

    nearest = first.select("uid", "x", "least").mapInPandas(exact, "q long, uid long, score double")
    nearest = nearest.selectExpr("*", "row_number() over (partition by q order by score desc, uid) as nth").where(f"nth <= {k + 1} and q <> uid").select("q", "uid")
    ranks = placed.select("curve", "rank", "uid")
    theirs = ranks.join(F.broadcast(nearest), "uid")  # (k + 1) * PROBES rows at most
    mine = ranks.where(F.col("uid").isin(asked)).select("curve", F.col("uid").alias("q"), F.col("rank").alias("own"))
    gaps = theirs.join(F.broadcast(mine), ["curve", "q"]).groupBy("q", "uid").agg(F.min(F.abs(F.col("rank") - F.col("own"))).alias("gap"))
    gaps = np.array([r.gap for r in gaps.select("gap").collect()])
    return max(k, int(np.quantile(gaps, WANTED)) + 1) if len(gaps) else k


def _compare(placed: DataFrame, window: int, total: int, k: int) -> DataFrame:
    """(q, uid, least, score): the k + 1 best of each query in each tile that its windows touch."""
    tile = max(64, min(TILE, window // 3))
    parts = max(1, -(-(2 * window + tile) // QUERIES))
    last = (total - 1) // tile
    slot = F.pmod(F.xxhash64("uid"), F.lit(parts)).cast("int")
    to = F.sequence(F.greatest(F.lit(0), F.floor((F.col("rank") - window) / tile)), F.least(F.lit(last), F.floor((F.col("rank") + window) / tile)))
    queries = placed.where("asks").select(F.col("curve").alias("q_curve"), slot.alias("q_slot"), F.col("uid").alias("q"), F.col("x").alias("q_x"), F.col("rank").alias("q_rank"), F.explode(to).alias("q_tile"))
    rows = placed.select("curve", F.floor(F.col("rank") / tile).alias("tile"), "rank", "uid", "x", "least", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("slot"))

    def best(asks: pd.DataFrame, has: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asks) and len(has):
            x, ranks, least, uids = _stack(has["x"]), has["rank"].to_numpy(), has["least"].to_numpy(), has["uid"].to_numpy()
            for at in range(0, len(asks), 512):
                some = asks.iloc[at : at + 512]
                scores = _stack(some["q_x"]) @ x.T
                scores[np.abs(some["q_rank"].to_numpy()[:, None] - ranks) > window] = -np.inf
                for i, top in _top(scores, least, k + 1):
                    out.append(pd.DataFrame({"q": some["q"].iloc[i], "uid": uids[top], "least": least[top], "score": scores[i, top]}))
        return pd.concat(out) if out else pd.DataFrame({"q": [], "uid": [], "least": [], "score": []})

    pairs = queries.groupBy("q_curve", "q_tile", "q_slot").cogroup(rows.groupBy("curve", "tile", "slot"))
    return pairs.applyInPandas(best, "q long, uid long, least long, score double")
