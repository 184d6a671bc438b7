"""Benchmark decontamination: a prefix-filtered join of item windows with documents.

A window's words are ordered by their rarity over all documents. To contain the
window a text must contain its rarest word, its prefix; so only there is the
window looked up. The word's place in the window gives the one place where the
window may begin (positional bound), the window's length must fit into the text
(length bound), and the words there are compared exactly.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from witnesslake.llm.common import LOWER, cut, free_name, small_batches

WINDOW = 13
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: UTF-8 bytes of item words that are broadcast at a time, whose index takes some 40 times as much in a worker; a larger benchmark is joined in that many blocks.
BLOCK_BYTES = 1 << 22
#: Words of an item that stay together in a block; neighbouring parts overlap by a window less a word.
PART_WORDS = 2000
SHARE = 20


def words_of(text: str | None) -> list[str]:
    """A-Z are lower-cased, all other characters are not."""
    return WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(LOWER).decode("utf-8", "surrogatepass"))


Index = dict[str, list[tuple[int, int, dict[tuple[str, ...], list]]]]


def windows_of(words: list[str]) -> Iterator[tuple[str, ...]]:
    for i in range(max(1, len(words) - WINDOW + 1) if words else 0):
        yield tuple(words[i : i + WINDOW])


def build_index(parts: list[tuple[object, list[str]]], counts: dict[str, int]) -> Index:
    """Rarest word of each window to (its place, the window's length, the windows)."""
    by: dict[str, dict[tuple[int, int], dict[tuple[str, ...], list]]] = {}
    for item, words in parts:
        for w in windows_of(words):
            at = min(range(len(w)), key=lambda i: (counts.get(w[i], 0), w[i]))
            items = by.setdefault(w[at], {}).setdefault((at, len(w)), {}).setdefault(w, [])
            if item not in items:
                items.append(item)
    return {word: [(at, n, found) for (at, n), found in places.items()] for word, places in by.items()}


def search(words: list[str], index: Index) -> tuple[list[tuple[int, int]], set]:
    """Where windows occur, as merged (start, end), and the items they are of."""
    found, items = [], set()
    for i in [i for i, w in enumerate(words) if w in index]:
        for at, n, windows in index[words[i]]:
            start = i - at
            if start >= 0 and start + n <= len(words) and (hit := windows.get(tuple(words[start : start + n]))):
                found.append((start, start + n))
                items.update(hit)
    return merged(found), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _parts(benchmark: DataFrame) -> DataFrame:
    """(item_id, words, bytes): items, those without an id too, in parts of bounded length."""

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for item, text in zip(batch["item_id"].astype(object).where(batch["item_id"].notna(), None), batch["text"], strict=True):
                words, step = words_of(text), PART_WORDS - WINDOW + 1
                for i in range(0, max(1, len(words) - WINDOW + 1), step) if words else ():
                    joined = " ".join(words[i : i + PART_WORDS])
                    rows.append((item, joined, len(joined.encode())))
            yield pd.DataFrame(rows, columns=["item_id", "words", "bytes"])

    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInPandas(cut_up, "item_id string, words string, bytes long")


def _count(docs: DataFrame, vocabulary: set[str]) -> dict[str, int]:
    """How often each of the block's words stands in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter[str] = Counter()
        for batch in batches:
            for text in batch["text"]:
                total.update(filter(shared.value.__contains__, words_of(text)))
        yield pd.DataFrame(list(total.items()), columns=["word", "n"])

    counted = docs.select("text").mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r.word: r.n for r in counted.collect()}  # a row a word of the block


def _finder(docs: DataFrame, parts: list[tuple[str, list[str]]]) -> Column:
    """A function of a text column: n_words, the merged hits and the items of one block."""
    index = docs.sparkSession.sparkContext.broadcast(build_index(parts, _count(docs, {w for _, words in parts for w in words})))

    @F.pandas_udf("n_words long, starts array<long>, ends array<long>, items array<string>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                words = words_of(text)
                spans, items = search(words, index.value)
                rows.append((len(words), [a for a, _ in spans], [b for _, b in spans], sorted(items, key=lambda i: (i is None, i or ""))))
            yield pd.DataFrame(rows, columns=["n_words", "starts", "ends", "items"])

    return find


def _covered(starts: Column | str, ends: Column | str) -> Column:
    @F.pandas_udf("long")
    def covered(starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([sum(b - a for a, b in merged(list(zip(s, e, strict=True)))) for s, e in zip(starts, ends, strict=True)], dtype="int64")

    return covered(starts, ends)


def find_windows(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, n_hit and items (array of item_id as strings, sorted): each whole text against all items.

    docs' columns of those names must be free. Null text has no words; items
    of null text or without words have no windows; repeated items count once
    by item_id, all items without one as a single null that ends the list;
    repeated documents stay repeated.
    """
    small_batches(docs.sparkSession)
    # different ones alone, so that hashing spreads them evenly over the blocks
    parts = cut(_parts(benchmark).distinct())
    total = parts.agg(F.sum("bytes")).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    [found] = free_name(docs, "found")
    if blocks == 1:  # total is at most block_bytes
        rows = [(r.item_id, r.words.split(" ")) for r in parts.collect()]
        out = docs.withColumn(found, _finder(docs, rows)(F.col("text")))
        return out.select(*docs.columns, f"{found}.n_words", _covered(f"{found}.starts", f"{found}.ends").alias("n_hit"), f"{found}.items")
    key, of, hits = F.xxhash64("text", F.sha2(F.coalesce("text", F.lit("")), 256)), *free_name(docs, "of", "hits")
    tables = []
    for b in range(blocks):
        mine = parts.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)) == b)
        if not (rows := [(r.item_id, r.words.split(" ")) for r in mine.collect()]):
            continue
        got = docs.select(key.alias(of), _finder(docs, rows)(F.col("text")).alias(hits)).where(F.size(f"{hits}.starts") > 0).dropDuplicates([of])
        tables.append(cut(got))
    table = reduce(DataFrame.union, tables).groupBy(of).agg(*(F.flatten(F.collect_list(f"{hits}.{c}")).alias(c) for c in ("starts", "ends", "items")))  # a list a block
    empty = lambda c: F.coalesce(c, F.array().cast("array<long>"))
    n_words = _finder(docs.limit(0), [])(F.col("text"))
    out = docs.withColumn(found, n_words).withColumn(hits, key).join(table, F.col(hits) == F.col(of), "left")
    return out.select(*(docs[c] for c in docs.columns), f"{found}.n_words", _covered(empty(F.col("starts")), empty(F.col("ends"))).alias("n_hit"), F.array_sort(F.array_distinct(F.coalesce(table["items"], F.array().cast("array<string>")))).alias("items"))


def _contaminated() -> Column:
    return (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))


def judge(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each document.

    Null and empty texts have no words and are clean. An empty benchmark hits
    nothing, an empty table stays empty, other columns are ignored. Items
    without an item_id count as one in n_items and are not in the digest.
    """
    found = find_windows(docs.select("doc_id", "text"), benchmark, block_bytes)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), _contaminated().alias("contaminated"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated ones; rows and columns are otherwise unchanged."""
    renamed = docs.toDF(*(c if c == "text" else f"_{i}" for i, c in enumerate(docs.columns)))
    kept = find_windows(renamed, benchmark).where(~_contaminated()).select(*renamed.columns)
    return kept.toDF(*docs.columns)
