"""Cross-tokenizer alignment: how the tokens of two tokenizers lie on each other, over a corpus.

Both tokenizers cut the same bytes of a text into tokens. Where both have an end,
a group ends; where byte ranges overlap, tokens are linked. How many documents
link a pair of ids is known only over the whole corpus, so each document's pairs
and their multiplicities are dealt by side id: all pairs of one A id meet in one
bucket. Buckets are cut into parts of bounded size, by runs of documents, and
each part is cogrouped with the counts of its bucket's pairs, both as sorted
streams that spill. There the pairs' counts and their maximum by A id are looked
up and leave as contributions to documents, which are summed by document.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import sentencepiece
import tiktoken
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from witnesslake.llm.common import cut, discard, small_batches, stored

#: A pair of ids in one integer: B's ids have so many bits.
B_BITS = 20
#: A ids are dealt to so many buckets; a document contributes one row of each at most. Pairs of documents in a part of a bucket, at about; documents in a run, which stays in one part.
BUCKETS, PART, RUN = 64, 2_000_000, 1024
#: Pairs whose counts one task holds before it passes them on, and words whose tokens a worker remembers at once.
HELD, WORDS = 4_000_000, 150_000
#: Runs of white space that tiktoken's pattern can't pass; texts with one are left to the other library.
LONG_SPACE = re.compile(r"\s{5000}")
#: White space of piece models.
BAR = "▁"
#: What the two sides' patterns or pieces see otherwise; texts with these, and with words of so many characters, are encoded whole.
ODD, LONG_WORD = (BAR, *map(chr, range(0x1C, 0x20))), 1000
#: Words end where a space follows what is no white space: no token of either side lies across. At each space, unless white space stands before one.
WORD = re.compile(r"\s*\S+(?:[^\S ]\s*\S+)*(?:[^\S ]\s*)?|\s+")
SPACED = [f"{chr(c)} " for c in range(0x3001) if chr(c).isspace()]


def _words(text: str) -> list[str]:
    """The words of a space and the text, each without the space that it begins with."""
    if any(x in text for x in SPACED) or text[0] == " ":
        return [w[1:] for w in WORD.findall(f" {text}")]
    return text.split(" ")


def byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: printable ones of Latin-1 for themselves, those from 256 on for the rest in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """Byte-level BPE of a vocabulary file of the `tokenizers` library.

    Where the file's ids follow its merges, as ranks must, tiktoken encodes by
    the same vocabulary at three times the speed; else the library itself does.
    """

    def __init__(self, vocabulary: str, pattern: str) -> None:
        said, letters = json.loads(vocabulary), byte_alphabet()
        vocab = said["model"]["vocab"]
        added = {t["content"] for t in said.get("added_tokens") or []}
        self.library = tokenizers.Tokenizer.from_str(vocabulary)
        self.library.encode_special_tokens = True
        self.bytes = [b""] * (max([*vocab.values(), *(t["id"] for t in said.get("added_tokens") or []), -1]) + 1)
        for entry, i in vocab.items():
            self.bytes[i] = entry.encode() if entry in added else bytes(letters[c] for c in entry)
        merged = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in said["model"]["merges"]]
        ranked = None not in merged and merged == sorted(set(merged)) and not said.get("normalizer")
        ranks = {self.bytes[i]: i for entry, i in vocab.items() if entry not in added}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}) if ranked else None

    def encode(self, text: str) -> list[int]:
        if self.fast is None or LONG_SPACE.search(text):
            return self.library.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


class Pieces:
    """A sentencepiece model, which puts a space before each text."""

    def __init__(self, model: bytes) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(BAR, " ").encode() for i, p in enumerate(pieces)]
        self.space = [self.model.piece_to_id(BAR)]
        probe = " a  b "
        #: No piece goes on past a word's end and spaces stay as they are: words can be encoded one by one.
        self.by_word = not any(BAR in p.lstrip(BAR) for p in pieces) and b"".join(self.bytes[i] for i in self.model.encode(probe)) == f" {probe}".encode()

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text)


@dataclass
class Alignment:
    a: np.ndarray
    b: np.ndarray
    #: Of each side's tokens, how many groups end before them.
    a_group: np.ndarray
    b_group: np.ndarray
    n_groups: int
    #: Places of the tokens that each link ties.
    a_link: np.ndarray
    b_link: np.ndarray


NOTHING = Alignment(*(np.zeros(0, np.int64) for _ in range(4)), 0, *(np.zeros(0, np.int64) for _ in range(2)))


class Aligner:
    def __init__(self, vocabulary: str, pattern: str, model: bytes) -> None:
        self.a, self.b = ByteLevel(vocabulary, pattern), Pieces(model)
        self.a_size, self.b_size = (np.array([len(x) for x in side.bytes], np.int64) for side in (self.a, self.b))
        # each id with what follows it within a group and at its end; last of all without anything
        self.words = np.array([f"{i}{mark}" for side, marks in ((self.a, ",|"), (self.b, ",;")) for mark in marks for i in range(len(side.bytes))], dtype=object)
        self.by_word = self.a.fast is not None and self.b.by_word
        #: Both sides' ids of words, packed, and words that one side doesn't give back.
        self.a_ids: dict[str, bytes] = {}
        self.b_ids: dict[str, bytes] = {}
        self.odd: set[str] = set()

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Both sides' ids; None if a side's bytes aren't the text's."""
        words = _words(text) if self.by_word and not any(c in text for c in ODD) else []
        if not words or max(map(len, words)) > LONG_WORD:
            return self.whole(text)
        if new := set(words).difference(self.a_ids):
            self.learn([w for w in new if w and not w[-1].isspace()])
            for word in new.difference(self.a_ids):
                self.learn([word])
        out = None if self.odd and not self.odd.isdisjoint(words) else tuple(np.frombuffer(b"".join(map(ids.__getitem__, words)), "<i4").astype(np.int64) for ids in (self.a_ids, self.b_ids))
        if len(self.a_ids) > WORDS:
            self.a_ids, self.b_ids, self.odd = {}, {}, set()
        return out

    def whole(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        a, b, want = self.a.encode(f" {text}"), self.b.encode(text) if text else self.b.space, f" {text}".encode()
        good = all(b"".join(map(side.bytes.__getitem__, ids)) == want for side, ids in ((self.a, a), (self.b, b)))
        return (np.array(a, np.int64), np.array(b, np.int64)) if good else None

    def learn(self, words: list[str]) -> None:
        """Encodes new words as one text, which is cut where words end; one by one where a side doesn't give it back."""
        found = self.whole(" ".join(words)) if words else None
        if found is None:
            for word in words if len(words) > 1 else []:
                self.learn([word])
            if len(words) == 1:
                self.odd.add(words[0])
                self.a_ids[words[0]] = self.b_ids[words[0]] = b""
            return
        ends = np.cumsum([len(w.encode()) + 1 for w in words])
        for known, size, ids in ((self.a_ids, self.a_size, found[0]), (self.b_ids, self.b_size, found[1])):
            packed, cuts = ids.astype("<i4").tobytes(), [0, *(4 * size[ids].cumsum().searchsorted(ends, "right")).tolist()]
            known.update(zip(words, map(packed.__getitem__, map(slice, cuts, cuts[1:])), strict=False))

    def align(self, text: str | None) -> Alignment:
        """The tokens of a text; nothing where it has none or one side's bytes aren't the text's."""
        found = self.tokens(text) if text else None
        if found is None:
            return NOTHING
        a, b = found
        a_end, b_end = self.a_size[a].cumsum(), self.b_size[b].cumsum()
        ends = np.zeros(a_end[-1] + 1, np.uint8)
        ends[a_end] = 1
        ends[b_end] |= 2
        every = np.flatnonzero(ends)
        ends = ends[every]
        # at every end, how many tokens of each side, and groups, end before it
        is_a, is_b, both = ends & 1 > 0, ends & 2 > 0, ends == 3
        a_link, b_link, group = (np.cumsum(x) - x for x in (is_a, is_b, both))
        return Alignment(a, b, group[is_a], group[is_b], int(both.sum()), a_link, b_link)

    def groups(self, x: Alignment) -> str:
        """`a1,a2|b1;a3|b2,b3`: the ids of each group."""
        if not x.n_groups:
            return ""
        a_last, b_last = (np.append(g[1:] != g[:-1], True) for g in (x.a_group, x.b_group))
        a_count, b_count = (np.bincount(g, minlength=x.n_groups) for g in (x.a_group, x.b_group))
        out = np.empty(len(x.a) + len(x.b), dtype=object)
        # before a token stand its side's tokens and the other side's of earlier groups (of B's also those of A in its own)
        out[np.arange(len(x.a)) + (np.cumsum(b_count) - b_count)[x.a_group]] = self.words[x.a + len(self.a.bytes) * a_last]
        out[np.arange(len(x.b)) + np.cumsum(a_count)[x.b_group]] = self.words[2 * len(self.a.bytes) + x.b + len(self.b.bytes) * b_last]
        return "".join(out.tolist())[:-1]


@cache
def _aligner(vocabulary: str, pattern: str, model: bytes) -> Aligner:
    return Aligner(vocabulary, pattern, model)


def tokenised(docs: DataFrame, vocabulary: str, pattern: str, model: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of each row, stored with a `row` of its own.

    `pairs` and `times` are the linked pairs of ids, in order, and how often each is linked, as packed integers.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(vocabulary, encoding="utf-8") as f, open(model, "rb") as g:
        shared = spark.sparkContext.broadcast((f.read(), pattern, g.read()))  # two files of fixed size

    @F.pandas_udf("n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        aligner = _aligner(*shared.value)
        for texts in batches:
            rows = []
            for text in texts:
                x = aligner.align(text)
                pairs, times = np.unique(x.a[x.a_link] << B_BITS | x.b[x.b_link], return_counts=True)
                said = hashlib.sha256(aligner.groups(x).encode()).hexdigest() if x.n_groups else ""
                rows.append((len(x.a), len(x.b), x.n_groups, len(x.a_link), said, pairs.astype("<i8").tobytes(), times.astype("<i4").tobytes()))
            yield pd.DataFrame(rows, columns=["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return stored(docs.select("doc_id", tokens(F.col("text")).alias("t")).select(F.monotonically_increasing_id().alias("row"), "doc_id", "t.*"))


def _bucket(pairs: np.ndarray) -> np.ndarray:
    return (pairs >> B_BITS) % BUCKETS


def pair_counts(found: DataFrame) -> DataFrame:
    """(bucket, pair, n): each pair of ids with the number of rows that link it; tasks count their own rows first."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def counted() -> pd.DataFrame:
            pairs, n = np.unique(np.concatenate(held), return_counts=True)
            return pd.DataFrame({"bucket": _bucket(pairs).astype("int32"), "pair": pairs, "n": n.astype("int64")})

        for batch in batches:
            held += [np.frombuffer(p, "<i8") for p in batch["pairs"]]
            size += sum(map(len, held[-len(batch) :]))
            if size >= HELD:
                yield counted()
                held, size = [], 0
        if held:
            yield counted()

    return found.select("pairs").mapInPandas(count, "bucket int, pair long, n long").groupBy("bucket", "pair").agg(F.sum("n").alias("n"))


def contributions(found: DataFrame, counts: DataFrame) -> DataFrame:
    """(row, n_best, count_sum): what the pairs of each bucket add to each row."""
    small_batches(found.sparkSession)
    # a row a bucket: how many parts it is cut into
    parts = {r.bucket: max(1, -(-r.n // PART)) for r in counts.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    of = np.array([parts.get(b, 1) for b in range(BUCKETS)], np.int64)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = [np.frombuffer(p, "<i8") for p in batch["pairs"]]
            rows = np.repeat(batch["row"].to_numpy(np.int64), [len(p) for p in pairs])
            times = np.concatenate([np.frombuffer(t, "<i4") for t in batch["times"]])
            pairs = np.concatenate(pairs)
            bucket = _bucket(pairs)
            # a part follows from the row alone, so a task that runs again deals alike
            part = (rows // RUN * 2654435761 >> 8) % of[bucket]
            order = np.lexsort((rows, pairs, part, bucket))
            bucket, part, rows, pairs, times = (x[order] for x in (bucket, part, rows, pairs, times))
            edges = np.flatnonzero(np.diff(bucket * (int(of.max()) + 1) + part)) + 1
            cut_up = [[x.tobytes() for x in np.split(y, edges)] if len(y) else [] for y in (rows, pairs, times)]
            first = np.concatenate([[0], edges])[: len(cut_up[0])].astype(int)
            yield pd.DataFrame({"bucket": bucket[first].astype("int32"), "part": part[first].astype("int64"), "rows": cut_up[0], "pairs": cut_up[1], "times": cut_up[2]})

    def add(counted: pd.DataFrame, dealt: pd.DataFrame) -> pd.DataFrame:
        if not len(dealt):
            return pd.DataFrame({"row": [], "n_best": [], "count_sum": []}).astype("int64")
        order = np.argsort(known := counted["pair"].to_numpy(np.int64))
        known, n = known[order], counted["n"].to_numpy(np.int64)[order]
        begins = np.flatnonzero(np.diff(known >> B_BITS, prepend=-1))
        best = n == np.repeat(np.maximum.reduceat(n, begins), np.diff(np.append(begins, len(n))))
        rows, pairs, times = (np.concatenate([np.frombuffer(x, kind) for x in dealt[c]]) for c, kind in (("rows", "<i8"), ("pairs", "<i8"), ("times", "<i4")))
        at = known.searchsorted(pairs)
        row, place = np.unique(rows, return_inverse=True)
        sums = [np.zeros(len(row), np.int64) for _ in range(2)]
        for into, what in zip(sums, (times * best[at], times * n[at]), strict=True):
            np.add.at(into, place, what)
        return pd.DataFrame({"row": row, "n_best": sums[0], "count_sum": sums[1]})

    dealt = found.select("row", "pairs", "times").where(F.octet_length("pairs") > 0).mapInPandas(deal, "bucket int, part long, rows binary, pairs binary, times binary")
    each = F.from_json(F.lit(json.dumps({str(b): n for b, n in parts.items()})), "map<string, long>")
    sent = counts.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.try_element_at(each, F.col("bucket").cast("string")) - 1)))
    return sent.groupBy("bucket", "part").cogroup(dealt.groupBy("bucket", "part")).applyInPandas(add, "row long, n_best long, count_sum long")


def alignment(docs: DataFrame, vocabulary: str, pattern: str, model: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each whole text.

    `vocabulary` is a byte-level vocabulary file (side A, which reads a space and
    the text), `pattern` its pattern of words, `model` a piece model (side B).
    Texts that are null or empty, or that either side's bytes don't give back,
    have zeros and ''. Each row counts as a document, repeated rows and rows
    without a doc_id too; an empty table stays empty, other columns are ignored.
    """
    found = tokenised(docs, vocabulary, pattern, model)
    counts = cut(pair_counts(found))
    sums = contributions(found, counts).groupBy(F.col("row").alias("of")).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    joined = found.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(sums, F.col("row") == F.col("of"), "left")
    out = cut(joined.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256"))
    discard(found)
    return out
