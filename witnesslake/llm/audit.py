"""Filter interaction audit: what each filter removes in every order, by inclusion and exclusion.

A document's failures are five flags. For each of the 32 sets of filters one sum
counts, as products of flags, the documents that fail all filters of the set.
Those joint counts decide everything else: their Möbius inversion gives how many
documents survive any set of filters, hence what a filter removes after others,
what only it would catch and what others caught before it; and as dividends of
the game "documents removed by a set" they give each filter's Shapley value.
So the rows are read once, however many orders are asked about.
"""

from __future__ import annotations

import itertools
import json
import math
from functools import reduce
from operator import add, mul

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from witnesslake.llm.common import discard, stored

#: The least words, distinct words and most capitals in a hundred, marks that no text may hold.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = 50, 65, 5, r"[#$%&*|]"
SPACE = r"[\x20\x09-\x0D]+"
FILTERS = "ABCDE"
#: What is counted: all documents, good ones, toxic ones.
WEIGHTS = ("n", "good", "toxic")


def text_failures(text: Column) -> dict[str, Column]:
    """Filters A to D as conditions of failure on a text without nulls."""
    words = F.array_remove(F.split(text, SPACE, -1), "")
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * F.size(words),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > MOST_CAPITALS * F.length(text),
        "D": text.rlike(MARKS),
    }


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, A, B, C, D, E): each row of docs with its failures.

    A null text counts as empty, a null source as the part ''. E fails if a
    smaller doc_id has the same text anywhere in docs; rows that share a doc_id
    are no copies of each other, and rows without one neither fail E nor make
    others fail. Equal texts are found by SHA-256. Other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    narrow = stored(docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), *(c.alias(k) for k, c in text_failures(text).items()), F.unhex(F.sha2(text, 256)).alias("digest")))
    first = narrow.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("least")).withColumnRenamed("digest", "of")
    # the first of each text is joined to itself alone, so a text of many copies is no hot key
    own = (F.col("digest") == F.col("of")) & (F.col("doc_id") == F.col("least"))
    out = narrow.join(first, own, "left").select("doc_id", "part", *"ABCD", (F.col("doc_id").isNotNull() & F.col("least").isNull()).alias("E"))
    out.behind = narrow
    return out


def marked(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """failed with `good` and `toxic`: whether any label of the doc_id says so; documents without a label are neither."""
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("of")).agg(*(F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(k) for k, c in (("good", "quality"), ("toxic", "toxic"))))
    return failed.join(said, F.col("doc_id") == F.col("of"), "left").drop("of").fillna(False, ["good", "toxic"])


def subsets(names: str) -> list[str]:
    """All sets of names; place i holds the names whose bits are set in i."""
    return ["".join(c for b, c in enumerate(names) if i >> b & 1) for i in range(1 << len(names))]


def joint_failures(failed: DataFrame, names: str = FILTERS) -> DataFrame:
    """(part, n, good, toxic): by part, arrays that count at place S the documents failing all filters of S."""
    flag = {c: F.col(c).cast("long") for c in (*names, *WEIGHTS[1:])}

    def sums(weight: str) -> Column:
        own = [] if weight == "n" else [flag[weight]]
        return F.array(*(F.sum(reduce(mul, [*own, *(flag[c] for c in s)], F.lit(1).cast("long"))) for s in subsets(names))).alias(weight)

    return failed.groupBy("part").agg(*map(sums, WEIGHTS))


def survivors(joint: Column, names: str = FILTERS) -> Column:
    """Möbius inversion of joint counts: at place P the number of documents that no filter of P fails."""
    signed = lambda s: joint[s] * (-1 if s.bit_count() % 2 else 1)
    return F.array(*(reduce(add, [signed(s) for s in range(p + 1) if s & p == s]) for p in range(1 << len(names))))


def shapley(joint: Column, names: str = FILTERS) -> Column:
    """By filter, what it removes summed over all orders: each set's dividend goes to its filters in equal shares."""
    orders, every = math.factorial(len(names)), range(1, 1 << len(names))
    share = lambda s: joint[s] * (orders // s.bit_count() * (1 if s.bit_count() % 2 else -1))
    return F.array(*(reduce(add, [share(s) for s in every if s >> b & 1]) for b in range(len(names))))


def steps(names: str = FILTERS) -> Column:
    """Every step of every order: the sets of filters before and after it, and its own filter's place."""
    rows, place = [], {c: b for b, c in enumerate(names)}
    for order in itertools.permutations(names):
        before = 0
        for k, c in enumerate(order):
            rows.append({"filter_order": "".join(order), "step": k + 1, "place": place[c], "before": before, "after": before | 1 << place[c]})
            before |= 1 << place[c]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<filter_order: string, step: int, place: int, before: int, after: int>>")


def report(joint: DataFrame, names: str = FILTERS) -> DataFrame:
    """A row for each part, order and step, from the parts' joint counts."""
    alive = joint.select("part", F.col("n").alias("joint"), *(survivors(F.col(w), names).alias(w) for w in WEIGHTS), shapley(F.col("n"), names).alias("shares"))
    at = alive.select("*", F.explode(steps(names)).alias("s")).select("*", "s.*")
    lost = lambda w: F.get(w, F.col("before")) - F.get(w, F.col("after"))
    full = F.lit((1 << len(names)) - 1)
    bit = F.col("before").bitwiseXOR(F.col("after"))
    return at.select(
        "part", "filter_order", "step", F.get("n", F.col("after")).alias("kept"), lost("n").alias("removed"), (F.get("joint", bit) - lost("n")).alias("redundant"),
        (F.get("n", full.bitwiseXOR(bit)) - F.get("n", full)).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.get("shares", F.col("place")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and counts of all 120 orders of the five filters, for each source.

    An empty table has no parts and so no rows; repeated rows each count;
    doc_ids may repeat in labels. Handling of nulls: failures() and marked().
    """
    failed = failures(docs)
    joint = stored(joint_failures(marked(failed, labels)))
    discard(failed.behind)
    return report(joint)
