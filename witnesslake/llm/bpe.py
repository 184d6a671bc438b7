"""Byte-level BPE, encoded and decoded as a monoid tree reduction.

A piece of text is cut into halves down to single bytes. Two neighbours are
joined by encoding anew a window around their boundary, which grows until the
tokens outside it are stable: a token sequence is the encoding of its bytes
exactly if every two neighbouring tokens, encoded together, give themselves
again, so the join is right as soon as the pairs at the window's two edges do.
Decoding concatenates the tokens' bytes.

What two neighbouring tokens give and what short halves and pieces give is
remembered by a worker, in two generations of bounded size: all of it comes from
joins, and forgetting costs time alone.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import struct
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from witnesslake.llm.common import small_batches

#: Bytes of a window that are searched pair by pair; longer ones by a heap.
SHORT = 96
#: Pieces, halves and pairs of tokens that a worker remembers in each of two generations (some 100 to 200 bytes each), and the bytes of the longest piece remembered.
PIECES, HALVES, PAIRS, REMEMBERED_BYTES = 100_000, 60_000, 150_000, 40
#: Bits of a token id: two make the key of a pair. Stands for a pair that gives itself again.
ID_BITS, ITSELF = 32, ()
Ids = Sequence[int]
#: Stands for the rank of two tokens that don't merge.
NONE = 1 << 62
#: A vocabulary file is broadcast; larger ones are refused.
VOCABULARY_BYTES = 64 << 20


class Kept(dict):
    """Results of make by key: those of the latest `most` keys at least, of twice as many at most."""

    def __init__(self, make: Callable, most: int) -> None:
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):  # noqa: ANN001, ANN204
        if (got := self.old.get(key)) is None:
            got = self.make(key)
        if len(self) >= self.most:
            self.old = self.copy()
            self.clear()
        self[key] = got
        return got


class Codec:
    """ranks: token bytes to id; a lower id merges first."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks, self.token = ranks, {i: b for b, i in ranks.items()}
        self.pairs = Kept(self._together, PAIRS)
        self.halves = Kept(self._halved, HALVES)

    def leaf(self, data: bytes) -> list[int]:
        """The merges in order of rank, leftmost first, searched one by one."""
        get, starts = self.ranks.get, [*range(len(data) + 1)]
        pairs = [get(data[i : i + 2], NONE) for i in range(len(data) - 1)]
        while pairs and (best := min(pairs)) != NONE:
            at = pairs.index(best)
            del pairs[at], starts[at + 1]
            if at:
                pairs[at - 1] = get(data[starts[at - 1] : starts[at + 1]], NONE)
            if at < len(pairs):
                pairs[at] = get(data[starts[at] : starts[at + 2]], NONE)
        return [self.ranks[data[i:j]] for i, j in zip(starts, starts[1:], strict=False)]

    def window(self, data: bytes) -> list[int]:
        """Like leaf, in n log n steps: a heap of pairs over a linked list."""
        if len(data) <= SHORT:
            return self.leaf(data)
        get, n = self.ranks.get, len(data)
        part = [data[i : i + 1] for i in range(n)]
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(r, i, 2) for i in range(n - 1) if (r := get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i]
            if not part[i] or j >= n or len(part[i]) + len(part[j]) != size:
                continue  # one of the two has merged since
            part[i], part[j], after[i] = part[i] + part[j], b"", after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := get(both := part[a] + part[b])) is not None:
                    heapq.heappush(heap, (r, a, len(both)))
        return [self.ranks[p] for p in part if p]

    def _together(self, pair: int) -> Ids:
        """What two tokens' bytes are encoded to."""
        a, b = pair >> ID_BITS, pair & (1 << ID_BITS) - 1
        both = tuple(self.leaf(self.token[a] + self.token[b]))
        return ITSELF if both == (a, b) else both

    def stable(self, a: int, b: int) -> bool:
        return self.pairs[a << ID_BITS | b] is ITSELF

    def join(self, left: Ids, right: Ids) -> Ids:
        """The ids of two neighbours' bytes from the ids of each."""
        if not left or not right:
            return left or right
        mid, k = self.pairs[left[-1] << ID_BITS | right[0]], 1
        if mid is ITSELF:
            return left + right
        while True:
            a, b = max(0, len(left) - k), min(len(right), k)
            if (not a or self.stable(left[a - 1], mid[0])) and (b == len(right) or self.stable(mid[-1], right[b])):
                return left[:a] + mid + right[b:]
            k *= 2
            mid = tuple(self.window(self.decode(left[-k:]) + self.decode(right[:k])))

    def tree(self, data: bytes) -> Ids:
        return self.halves[data] if len(data) <= REMEMBERED_BYTES else self._halved(data)

    def _halved(self, data: bytes) -> Ids:
        if len(data) < 2:
            return (self.ranks[data],) if data else ()
        half = len(data) // 2
        return self.join(self.tree(data[:half]), self.tree(data[half:]))

    def encode(self, piece: bytes) -> Ids:
        """A match of the pattern that is a token as a whole is that token."""
        whole = self.ranks.get(piece)
        return self.tree(piece) if whole is None else (whole,)

    def decode(self, ids: Ids) -> bytes:
        if len(ids) <= 1 << 12:
            return b"".join(map(self.token.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


class Packed(Kept):
    """Pieces to their ids as little-endian 32-bit integers."""

    def __init__(self, codec: Codec) -> None:
        super().__init__(lambda piece: self.of(piece.encode()), PIECES)
        self.codec = codec

    def of(self, piece: bytes) -> bytes:
        ids = self.codec.encode(piece)
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, piece: str) -> bytes:
        return super().__missing__(piece) if len(piece) <= REMEMBERED_BYTES else self.make(piece)


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


class Splitter:
    """All matches of a pattern. Where every character of a text is below U+0250, `re` finds them, with the classes of letters, digits and space written out; it is twice as fast."""

    def __init__(self, pattern: str) -> None:
        self.general = regex.compile(pattern)
        for spoken, written in CLASSES:
            pattern = pattern.replace(rf"\s\p{{L}}\p{{N}}", SPACE + LETTERS + DIGITS).replace(spoken, written)
        self.latin = None if "\\" in pattern.replace(SPACE, "") else re.compile(pattern)

    def findall(self, text: str) -> list[str]:
        return self.general.findall(text) if self.latin is None or BEYOND.search(text) else self.latin.findall(text)


#: Letters, numbers and white space below U+0250, as Unicode has them.
LETTERS, DIGITS, SPACE = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
CLASSES = ((r"\p{L}", f"[{LETTERS}]"), (r"\p{N}", f"[{DIGITS}]"), (r"\S", f"[^{SPACE}]"), (r"\s", f"[{SPACE}]"))
BEYOND = re.compile("[^\x00-ɏ]")

_tables: dict[tuple[str, str], tuple[Packed, Splitter]] = {}


def _table(data: bytes, pattern: str) -> tuple[Packed, Splitter]:
    """Parsed once in each worker."""
    key = (hashlib.sha256(data).hexdigest(), pattern)
    if key not in _tables:
        _tables[key] = (Packed(Codec(parse_ranks(data))), Splitter(pattern))
    return _tables[key]


def _vocabulary(spark: SparkSession, path: str):  # noqa: ANN202
    with open(path, "rb") as file:
        data = file.read(VOCABULARY_BYTES + 1)
    if len(data) > VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {VOCABULARY_BYTES} bytes")
    return spark.sparkContext.broadcast(data)


def encoder(spark: SparkSession, path: str, pattern: str) -> Column:
    """A function of a text column: its ids as packed little-endian 32-bit integers (null and empty text: none)."""
    shared = _vocabulary(spark, path)
    small_batches(spark)

    @F.pandas_udf("binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        packed, split = _table(shared.value, pattern)
        for texts in batches:
            yield pd.Series([b"".join(map(packed.__getitem__, split.findall(t))) if t else b"" for t in texts], dtype=object)

    return encode


def decoder(spark: SparkSession, path: str) -> Column:
    """A function of a column of packed ids: the bytes they stand for (null: none)."""
    shared = _vocabulary(spark, path)
    small_batches(spark)

    @F.pandas_udf("binary")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _table(shared.value, "")[0].codec
        for ids in batches:
            yield pd.Series([codec.decode(np.frombuffer(x, "<u4").tolist()) if x else b"" for x in ids], dtype=object)

    return decode


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs with `ids`: array<int>, the tokens of each whole text. A column of that name is replaced.

    Null and empty texts have no ids. Nothing else of a row changes, repeated
    rows stay repeated, an empty table stays empty.
    """
    return docs.withColumn("ids", _unpacked(encoder(docs.sparkSession, path, pattern)(F.col("text"))))


def _unpacked(packed: Column) -> Column:
    @F.pandas_udf("array<int>")
    def unpack(ids: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(x, "<u4").astype("int32") for x in ids], dtype=object)

    return unpack(packed)


def token_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each whole text, encoded and decoded again.

    Null text counts as empty: no tokens, the digests of no bytes. Rows with a
    null or repeated doc_id are kept as they are; other columns are ignored.
    """
    shared = _vocabulary(docs.sparkSession, path)
    small_batches(docs.sparkSession)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        packed, split = _table(shared.value, pattern)
        for texts in batches:
            rows = []
            for text in texts:
                ids = b"".join(map(packed.__getitem__, split.findall(text))) if text else b""
                decoded = packed.codec.decode(np.frombuffer(ids, "<u4").tolist())
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", digest(F.col("text")).alias("d")).select("doc_id", "d.*")
