"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader updates.

Words are runs of letters, of digits or of other marks, as written; a feature is
a hashed word or pair of neighbours (one slot for all pairs of a word and itself), its value the share of the text's n-grams
times SCALE. A score is the sparse dot product of those values and the weights.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from witnesslake.llm.common import free_name, small_batches

BITS = 18
SCALE = 20.0
#: Labelled rows learnt from, at most: those with the smallest hashes of doc_id. All labels if there are fewer.
TRAINING_ROWS = 6000
EPOCHS = 3
#: Step and penalties of the updates.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.002
THRESHOLD = 0.3
#: Words hashed at once, and hashes a worker remembers.
AT_ONCE, REMEMBERED = 1 << 16, 150_000
WORD = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
MIX = np.uint64(0x9E3779B97F4A7C15)


class Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return out


_hashes = Hashes()


def _slots(text: str) -> Iterator[np.ndarray]:
    """Hashed words and pairs of a text, in bounded parts."""
    last, words = None, (m.group() for m in WORD.finditer(text)) if len(text) > 1 << 22 else iter(WORD.findall(text))
    while True:
        part = [h for _, h in zip(range(AT_ONCE), map(_hashes.__getitem__, words), strict=False)]
        if not part:
            return
        one = np.array(part, np.uint64)
        with_last = one if last is None else np.concatenate(([last], one))
        # a word again, whichever it is, is one feature
        two = np.where(with_last[:-1] == with_last[1:], MIX, with_last[:-1] * MIX ^ with_last[1:])
        last = one[-1]
        yield np.concatenate((one, two * MIX)) >> np.uint64(64 - BITS)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The slots of a text in ascending order and their values; a text without words has none."""
    counts, total = None, 0
    for slots in _slots(text or ""):
        at, n = np.unique(slots, return_counts=True)
        if counts is not None:
            at, where = np.unique(np.concatenate((counts[0], at)), return_inverse=True)
            n = np.bincount(where, np.concatenate((counts[1], n))).astype(np.int64)
        counts, total = (at, n), total + len(slots)
    if counts is None:
        return np.zeros(0, np.int64), np.zeros(0)
    return counts[0].astype(np.int64), counts[1] * (SCALE / total)


def margin(text: str | None, weights: np.ndarray) -> float:
    """The sparse dot product, with the bias in the last weight."""
    total = n = 0.0
    for slots in _slots(text or ""):
        total += float(weights[slots.astype(np.int64)].sum())
        n += len(slots)
    return float(weights[-1]) + (SCALE * total / n if n else 0.0)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights after the updates in the order of rows; the last is the bias."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    for _ in range(epochs):
        for at, value, label in rows:
            i, x = np.append(at, size), np.append(value, 1.0)
            step = (BETA + np.sqrt(n[i])) / ALPHA + L2
            w = np.where(np.abs(z[i]) <= L1, 0.0, -(z[i] - np.sign(z[i]) * L1) / step)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - label) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    step = (BETA + np.sqrt(n)) / ALPHA + L2
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / step).astype(np.float32)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning; a null doc_id is."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> np.ndarray:
    """Weights learnt from `labels` (doc_id, quality) of documents that aren't held out.

    Null labels and labels without a document teach nothing; a label repeated
    counts as often as it stands there. Of a doc_id with several texts that of
    the smallest hash teaches. Without any label all weights are zero.
    """
    chosen = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(rows)
    # one text of each doc_id, so that documents repeated do not swell what is learnt from: `rows` rows at most
    asked = F.broadcast(chosen.select("doc_id").distinct())
    texts = docs.select("doc_id", "text").join(asked, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    texts = texts.join(F.broadcast(chosen), "doc_id")

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [features(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "quality": batch["quality"], "at": [a.astype(np.int32) for a, _ in got], "value": [v for _, v in got]})

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        taught = [(at.astype(np.int64), value, q) for b in batches for at, value, q in zip(b["at"], b["value"], b["quality"], strict=True)]
        yield pd.DataFrame({"weights": [train(taught).tobytes()]})

    small_batches(docs.sparkSession)
    hashed = texts.mapInPandas(extract, "doc_id long, quality int, at array<int>, value array<double>")
    model = hashed.repartition(1).sortWithinPartitions(F.xxhash64("doc_id", F.lit(1)), "doc_id", "quality").mapInPandas(learn, "weights binary").first()
    return np.frombuffer(model.weights, np.float32) if model else np.zeros((1 << BITS) + 1, np.float32)


def scorer(docs: DataFrame, weights: np.ndarray) -> Column:
    """A function of a text column: the probability of label 1, as a double (null and empty: the bias alone)."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2**BITS + 1 floats
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            m = np.array([margin(t, shared.value) for t in texts], float)
            yield pd.Series(1 / (1 + np.exp(-np.clip(m, -35, 35))))

    return score


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each document, scored on its whole text.

    Only the text enters a score: equal texts have equal scores, null and empty
    ones that of the bias. Repeated rows stay, an empty table stays empty, other
    columns are ignored.
    """
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scorer(docs, fit(docs, labels))(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """docs without those that the classifier rejects; rows and columns are otherwise unchanged."""
    [mark] = free_name(docs, "score")
    weights = fit(docs, labels) if weights is None else weights
    return docs.withColumn(mark, scorer(docs, weights)(F.col("text"))).where(F.col(mark) >= THRESHOLD).drop(mark)
