"""SimHash near-duplicates: exact Hamming comparison of tiles.

Every fingerprint has a cell, the bit counts of its four 16-bit quarters. Two
fingerprints within `radius` bits have cells whose counts differ by `radius` in
sum at most, so each cell's tile is compared, by exclusive-or and bit counts,
with the tiles of those cells alone; all other tile pairs are skipped. Cells of
many fingerprints are cut into tiles of bounded size on both sides. A tile pair
gives back a spanning forest of its links, never all pairs within a group.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from witnesslake.llm.common import LOWER, cut, free_name, small_batches
from witnesslake.llm.graph import components

RADIUS = 3
SHINGLE_WORDS = 3
#: Fingerprints of a tile's left side; its right side has as many of each of up to 65 cells.
TILE = 8192
#: Shingles hashed at once and pairs compared at once: bound a task's memory.
AT_ONCE, PAIRS_AT_ONCE = 1 << 15, 1 << 20


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """Bit i is set if it is in over half of the shingles' XXH64 (seed 42); no words: zero. As a signed integer."""
    tokens = (text or "").encode().translate(LOWER).split()
    if not tokens:
        return 0
    grams = map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False)) if len(tokens) >= words else iter([b" ".join(tokens)])
    total, counts = max(1, len(tokens) - words + 1), np.zeros(64, np.int64)
    while (hashes := np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in itertools.islice(grams, AT_ONCE)), np.uint64)).size:
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> Column:
    """A function of a text column: its fingerprint as a long (null: zero, like any text without words)."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, words) for t in texts], dtype="int64")

    return of


def _forest(left: np.ndarray, right: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Of all pairs within the radius, links that connect the same fingerprints."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    kept, step = [], max(1, PAIRS_AT_ONCE // max(1, len(right)))
    bits = np.bitwise_count(right)
    order = np.argsort(bits, kind="stable")
    right, bits = right[order], bits[order].astype(np.int16)
    mine = np.bitwise_count(left).astype(np.int16)
    order = np.argsort(mine, kind="stable")
    left, mine = left[order], mine[order]
    for at in range(0, len(left), step):
        rows = left[at : at + step]
        lo, hi = np.searchsorted(bits, mine[at] - radius), np.searchsorted(bits, mine[min(at + step, len(left)) - 1] + radius, "right")
        i, j = np.nonzero(np.bitwise_count(rows[:, None] ^ right[None, lo:hi]) <= radius)
        for a, b in zip(rows[i].tolist(), right[lo:hi][j].tolist(), strict=True):
            if a != b and (x := find(a)) != (y := find(b)):
                parent[y] = x
                kept.append((a, b))
    return kept


def _offsets(radius: int) -> list[tuple[int, int, int, int]]:
    """Cells to compare with: of each two opposite ones the later."""
    span = range(-radius, radius + 1)
    return [d for d in itertools.product(span, repeat=4) if sum(map(abs, d)) <= radius and d >= (0, 0, 0, 0)]


def _tiles(prints: DataFrame, radius: int, tile: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of the tile pairs: (fp, cell, i, j) and (r_fp, r_cell, r_i, r_j).

    Part i of a cell meets part j of each cell near it, both of about `tile` fingerprints.
    """
    quarter = [F.bit_count(F.shiftrightunsigned("fp", 16 * i).bitwiseAND(0xFFFF)) for i in range(4)]
    names = [f"q{i}" for i in range(4)]
    cell = F.col("q0") + 17 * F.col("q1") + 289 * F.col("q2") + 4913 * F.col("q3")
    placed = prints.select("fp", *(q.alias(n) for q, n in zip(quarter, names, strict=True)))
    near = F.array(*(F.struct(*(F.lit(x).alias(f"d{i}") for i, x in enumerate(d))) for d in _offsets(radius)))

    def sent(df: DataFrame, *kept: str) -> DataFrame:
        """Each row at each cell that its own is compared with."""
        out = df.withColumn("d", F.explode(near)).select(*kept, *((F.col(f"q{i}") + F.col(f"d.d{i}")).alias(f"q{i}") for i in range(4)))
        return out.where(" and ".join(f"{n} between 0 and 16" for n in names)).withColumn("cell", cell)

    # 17**4 cells at most
    sizes = cut(placed.groupBy(*names).agg(F.ceil(F.count("*") / tile).cast("int").alias("parts")))
    most = sent(sizes.where("parts > 1"), "parts").groupBy("cell").agg(F.max("parts").alias("n_right"))
    parts = F.broadcast(sizes.select(cell.alias("of"), "parts").join(most, F.col("of") == F.col("cell"), "left").select("of", "parts", F.coalesce("n_right", F.lit(1)).alias("n_right")))
    own = F.broadcast(sizes.select(cell.alias("mine"), F.col("parts").alias("n_own")))
    side = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = placed.withColumn("cell", cell).join(parts, F.col("cell") == F.col("of")).withColumn("i", side("parts")).select("fp", "cell", "i", each("n_right").alias("j"))
    right = placed.join(own, cell == F.col("mine")).withColumn("r_j", side("n_own"))
    right = sent(right, "fp", "r_j").join(parts, F.col("cell") == F.col("of")).select(F.col("fp").alias("r_fp"), F.col("cell").alias("r_cell"), each("parts").alias("r_i"), "r_j")
    return left, right


def links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Of distinct fingerprints `fp` (long), links (a, b) that connect all within the radius, directly or through others."""
    left, right = _tiles(prints, radius, tile)

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = _forest(a["fp"].to_numpy().view(np.uint64), b["r_fp"].to_numpy().view(np.uint64), radius) if len(a) and len(b) else []
        return pd.DataFrame(np.array(found, np.uint64).reshape(-1, 2).view(np.int64), columns=["a", "b"])

    return left.groupBy("cell", "i", "j").cogroup(right.groupBy("r_cell", "r_i", "r_j")).applyInPandas(compare, "a long, b long")


def with_components(docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id that links reach.

    Null and empty texts have the fingerprint zero, linked like any other. A
    null doc_id never is a component_id unless the component has no other;
    repeated rows stay repeated, an empty table stays empty, other columns are
    ignored. Only distinct fingerprints are compared, so copies cost nothing.
    """
    printed = cut(docs.select("doc_id", fingerprints(docs, words)(F.col("text")).alias("fp")))
    return printed.select("doc_id", "fp").join(_component_of(printed, radius), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _component_of(printed: DataFrame, radius: int) -> DataFrame:
    """(fp, component_id) for each distinct fingerprint of printed(doc_id, fp)."""
    rooted = _rooted(cut(printed.groupBy("fp").agg(F.min("doc_id").alias("least"))), radius)
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "of")
    return rooted.join(smallest, F.col("root") == F.col("of")).select("fp", "component_id")


def _rooted(least: DataFrame, radius: int) -> DataFrame:
    """least(fp, least) of distinct fingerprints with `root`, the fingerprint that stands for the component."""
    roots = cut(components(links(least.select("fp"), radius)))
    return least.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def keep_first(docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id, with all columns.

    Repeated rows of that doc_id: one stays. Components without any doc_id keep
    one row each, and a doc_id that is the smallest of several components keeps
    one row in each of them. Columns of any name survive.
    """
    found_id, found_mark, mark = free_name(docs, "found_id", "found_mark", "mark")
    marked = docs.withColumn(mark, F.xxhash64(F.coalesce("text", F.lit(""))))
    printed = cut(marked.select("doc_id", F.col(mark).alias("mark"), fingerprints(docs, words)(F.col("text")).alias("fp")))
    # a row without a doc_id comes last
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    rooted = _rooted(cut(printed.groupBy("fp").agg(F.min(order).alias("least"))), radius)
    kept = rooted.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.doc_id").alias(found_id), F.col("least.mark").alias(found_mark))
    found = marked.join(kept, marked["doc_id"].eqNullSafe(kept[found_id]) & (marked[mark] == kept[found_mark]), "left_semi")
    return found.dropDuplicates(["doc_id", mark]).select(*docs.columns)
