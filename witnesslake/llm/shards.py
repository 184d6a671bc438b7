"""Sharding by histogram sort: near-equal bytes, one exchange.

Rows are ordered by a hash of their text, then of their doc_id. Rounds of exact
histograms count the bytes below candidate boundaries; only cells that hold a
wanted splitter and are still too coarse are probed again, more finely, until
each splitter meets its tolerance. Then every row is exchanged once, to its range.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from witnesslake.llm.common import cut

#: Bits of the key in the first histogram and added by each further round.
FIRST_BITS, MORE_BITS = 12, 8
#: Parts of a shard's bytes by which a splitter may miss; equal texts within it stay in one shard.
TOLERANCE = 0.005
KEY_BITS = 63


def _digits(depth: int, bits: int):  # noqa: ANN202
    """Column: the top bits of the composite key (g, d), as a long; depth 0 is g, 1 is d within one g."""
    return F.shiftrightunsigned("gd"[depth], KEY_BITS - bits)


def splitters(keyed: DataFrame, n: int, tolerance: float) -> list[tuple[int, int]]:
    """n-1 boundaries of the key (g, d): a row belongs right of those not above its key.

    keyed has g, d (63 bits each) and size. Each boundary's bytes below differ
    from its even share by the tolerance at most, or by one row's (or one
    repeated row's) where no finer cut exists.
    """
    probe = F.sum("size").alias("bytes"), F.min("g").alias("lo"), F.max("g").alias("hi"), F.count("*").alias("n")
    # a cell: (depth, g if depth is 1, bits, prefix); its first key is its boundary
    rows = keyed.groupBy(_digits(0, FIRST_BITS).alias("p")).agg(*probe).collect()  # 2**FIRST_BITS at most
    cells = sorted(((r.p << KEY_BITS - FIRST_BITS, 0), r.bytes, (0, 0, FIRST_BITS, r.p), r.lo, r.hi, r.n) for r in rows)
    total = sum(c[1] for c in cells)
    wanted, slack = [total * i / n for i in range(1, n)], max(1.0, tolerance * total / n)
    while cells:
        ends, below = [], 0
        for c in cells:
            ends.append(below := below + c[1])
        starts, coarse = [e - c[1] for e, c in zip(ends, cells, strict=True)], set()
        for w in wanted:
            i = min(bisect.bisect_left(ends, w), len(cells) - 1)
            if min(w - starts[i], ends[i] - w) > slack and cells[i][5] > 1 and cells[i][2][:3:2] != (1, KEY_BITS):
                coarse.add(i)
        if not coarse:
            return [min(((abs(w - s), c[0]) for s, c in zip(starts, cells, strict=True)), default=(0, (0, 0)))[1] for w in wanted] if cells else []
        # a cell of one g goes on with d, whose rows share a text
        todo = {}
        for i in coarse:
            depth, g, bits, prefix = cells[i][2]
            if depth == 0 and (cells[i][3] == cells[i][4] or bits == KEY_BITS):
                todo[i] = (1, cells[i][3], MORE_BITS, None)
            else:
                todo[i] = (depth, g, min(KEY_BITS, bits + MORE_BITS), prefix)
        finer, parts = [c for i, c in enumerate(cells) if i not in coarse], None
        for depth, g, bits in sorted({(d, g, b) for d, g, b, _ in todo.values()}):
            inside = [cells[i][2] for i, x in todo.items() if x[:3] == (depth, g, bits)]
            if depth == 0:
                held = _digits(0, inside[0][2]).isin([c[3] for c in inside])
            else:
                held = F.col("g") == g
                if inside[0][0] == 1:
                    held &= _digits(1, inside[0][2]).isin([c[3] for c in inside])
            part = keyed.where(held).groupBy(F.lit(depth).alias("depth"), F.lit(g).cast("long").alias("of"), F.lit(bits).alias("bits"), _digits(depth, bits).alias("p")).agg(*probe)
            parts = part if parts is None else parts.union(part)
        for r in parts.collect():  # 2**MORE_BITS a splitter at most
            first = (r.p << KEY_BITS - r.bits, 0) if r.depth == 0 else (r.of, r.p << KEY_BITS - r.bits)
            finer.append((first, r.bytes, (r.depth, r.of, r.bits, r.p), r.lo, r.hi, r.n))
        cells = sorted(finer)
    return [(0, 0)] * (n - 1)


def shard(docs: DataFrame, shards: int = 8, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each row, shards near equal in bytes.

    Size is the text's UTF-8 bytes (null: none) plus 1. Equal texts stand side
    by side in one shard, but where keeping them whole would miss the tolerance
    they are divided by doc_id; rows repeated in full always share a shard. A
    null doc_id is a value like any other. An empty table stays empty, other
    columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"), F.shiftrightunsigned(F.xxhash64(text), 1).alias("g"), F.shiftrightunsigned(F.xxhash64("doc_id"), 1).alias("d"))
    keyed = cut(keyed)
    ranged, n = to_ranges(keyed, shards, tolerance)
    # one exchange deals the ranges; each is a fraction of a shard
    counts = ranged.groupBy("shard", "range").agg(F.count("*").alias("n")).collect()  # a row a range
    offset, before = {}, {}
    for r in sorted(counts):
        offset[r.range] = before.get(r.shard, 0)
        before[r.shard] = offset[r.range] + r.n
    base = F.element_at(F.create_map(*(F.lit(x) for kv in offset.items() for x in kv)), F.col("range")) if offset else F.lit(0)
    slotted = ranged.selectExpr("*", "row_number() over (partition by range order by g, d, doc_id) as nth")
    return slotted.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (base + F.col("nth") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def to_ranges(keyed: DataFrame, shards: int, tolerance: float) -> tuple[DataFrame, int]:
    """keyed with `shard` and `range`; ranges cut each shard for the exchange and need only a rough tolerance."""
    each = max(1, -(-int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards))
    edges = splitters(keyed, shards, tolerance)
    fine = sorted({*edges, *splitters(keyed, shards * each, 0.25)} - {(0, 0)})
    place = lambda bounds: sum((F.when(_not_below(b), 1).otherwise(0) for b in bounds), F.lit(0)) if len(bounds) <= 16 else _search(bounds)
    return keyed.withColumn("shard", place(edges)).withColumn("range", place(fine)), len(fine) + 1


def _not_below(bound: tuple[int, int]):  # noqa: ANN202
    g, d = bound
    return (F.col("g") > g) | ((F.col("g") == g) & (F.col("d") >= d))


def _search(bounds: list[tuple[int, int]]):  # noqa: ANN202
    """How many bounds aren't above the key, by binary search in nested conditions."""

    def among(lo: int, hi: int):  # noqa: ANN202
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(_not_below(bounds[mid]), among(mid + 1, hi)).otherwise(among(lo, mid))

    return among(0, len(bounds))
