"""Line dedup: an exact set-similarity join of lines, on DataFrame functions alone.

A line is the set of its words. Words are ordered by their rarity over all
documents, so two lines of Jaccard similarity 0.8 or more share a word of their
short prefixes: a fifth of the longer set's words and a ninth of the shorter's.
Lines meet there, length and positional filters and a bound on the difference of
parity signatures drop nearly all false pairs, and the rest is verified on the
words themselves. The later line of a pair is removed.

Equal sets are one item of the join, so copies cost nothing. In each large group
of a prefix word every set is first tried against the earliest set and some just
before it, which settles most of a group of near copies with few pairs a line;
only sets without a match yet are then joined with all others. Texts are split once
into 32-bit hashes of words, which serve to find pairs; two words of one hash can
only add a pair, which the verification then drops.
"""

from __future__ import annotations

from functools import reduce
from math import log2
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from witnesslake.llm.common import discard, free_name, stored

#: White space within a line but the space itself.
ODD_SPACES, ODD_SPACE = "\t\x0b\x0c\r", r"[\t\x0B-\r]"
#: Counts of words are kept by hash in so many buckets, sent to the driver in BLOCKS: bounds the table that orders them. Levels of a count to each power of two.
BUCKETS, BLOCKS, LEVELS = 1 << 18, 1 << 8, 4
#: Bits of a word's hash in its place in the order; above them stands the level of its count.
HASH_BITS = 33
#: Sets of fewer words have no match but themselves; those of fewer than SHORT are told apart by their words, as one word is more than they may differ in.
LEAST, SHORT = 4, 9
#: Sets from which on the signature has 128 bits.
LONG = 48
#: Words of a set, the last of its prefix, in whose groups it is tried first if they have as many sets as TRIED_GROUP, how many sets before it there, and sets of a part of such a group, which bound the rows of one task. None affects the result.
TRIED_WORDS, TRIED_GROUP, TRIED_BEFORE, TRIED_PART = 3, 256, 12, 4096
#: Passes of the last join, each over its share of words: bounds what is shuffled, and so on disk, at once.
PASSES = 2
#: Rows of a set or line that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Sets that stand on more than this share of all lines are broadcast apart: there are at most as many as fit into the whole.
HEAVY_SHARE = 1 / 2000
#: Keys of a partial sum that Spark's fast map holds, as a power of two: all BUCKETS.
FAST_KEYS, FAST_KEYS_BITS = "spark.sql.codegen.aggregate.fastHashMap.capacityBit", "18"
NONE = "array<int>"


def _lines(text: Column) -> Column:
    """A text's lines, with spaces for all other white space in them."""
    odd = reduce(or_, (F.contains(text, F.lit(c)) for c in ODD_SPACES))
    return F.split(F.when(odd, F.regexp_replace(text, ODD_SPACE, " ")).otherwise(text), "\n", -1)


def _words(line: Column) -> Column:
    words = F.split(line, " ")
    return F.when(F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" ")) | F.contains(line, F.lit("  ")), F.array_remove(words, "")).otherwise(words)


def _hashed(docs: DataFrame) -> DataFrame:
    """(doc_id, h, line, sid, words): each line that has words, with its set's id and its distinct words as hashes."""
    split = docs.select("doc_id", F.xxhash64("text").alias("h"), F.posexplode(_lines(F.col("text"))).alias("line", "said"))
    # lines without words go before their hashes are made: a condition on those would make them twice
    split = split.where(F.ltrim("said") != "").select("*", F.sort_array(F.array_distinct(F.transform(_words(F.col("said")), lambda w: F.hash(w)))).alias("words"))
    sid = F.when(F.size("words") < SHORT, F.xxhash64(F.sort_array(F.array_distinct(_words(F.col("said")))))).otherwise(F.xxhash64("words"))
    return split.select("doc_id", "h", "line", sid.alias("sid"), "words")


def _levels(hashed: DataFrame) -> Column:
    """By bucket of a word's hash, the logarithm of the number of lines that its words are in."""
    words = hashed.select(F.explode("words").alias("w")).groupBy(F.col("w").bitwiseAND(BUCKETS - 1).cast("long").alias("id")).agg(F.count("*").alias("n"))
    every = words.unionByName(hashed.sparkSession.range(BUCKETS).withColumn("n", F.lit(0).cast("long"))).groupBy("id").agg(F.sum("n").alias("n"))
    level = F.floor(LEVELS * F.log2(F.greatest("n", F.lit(1)))).cast("int").alias("level")
    block = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", level))), lambda x: x["level"]), ",")
    conf = hashed.sparkSession.conf
    before = conf.get(FAST_KEYS)
    conf.set(FAST_KEYS, FAST_KEYS_BITS)
    try:
        blocks = every.groupBy(F.floor(F.col("id") / (BUCKETS // BLOCKS)).alias("at")).agg(block.alias("levels")).orderBy("at").collect()  # BLOCKS rows
    finally:
        conf.set(FAST_KEYS, before)
    return F.from_json(F.lit(f"[{','.join(b.levels for b in blocks)}]"), "array<bigint>")


def _sets(hashed: DataFrame, levels: Column) -> DataFrame:
    """(sid, first, copies, n, sig, half, prefix): each distinct set with its first line, its number of lines, size, signature and rarest words."""
    n = F.size("words")
    # values that are never null, by their type as well, are sorted as plain numbers
    rarest = F.sort_array(F.transform("words", lambda k: F.coalesce(F.shiftleft(F.get(levels, k.bitwiseAND(BUCKETS - 1)), HASH_BITS) + k, F.lit(0).cast("long"))))
    # a bit is set if an odd number of words falls on it: bits of two sets differ for words that only one of them has
    sig = F.expr("aggregate(words, 0L, (a, k) -> a ^ shiftleft(1L, k))")
    half = F.expr("aggregate(words, 0L, (a, k) -> if((k & 64) = 0, a, a ^ shiftleft(1L, k)))")
    marked = hashed.select("sid", "doc_id", "h", "line", n.alias("n"), F.when(n >= LEAST, sig).alias("sig"), F.when(n >= LONG, half).otherwise(F.lit(0).cast("long")).alias("half"), F.when(n >= LEAST, F.slice(rarest, 1, F.floor(n / 5).cast("int") + 1)).alias("prefix"))
    # what follows the place of the first line is the same on all lines of a set
    first = F.min(F.struct("doc_id", "h", "line", "n", "sig", "half", "prefix")).alias("f")
    grouped = marked.groupBy("sid").agg(first, F.count("*").alias("copies"))
    return grouped.select("sid", F.struct("f.doc_id", "f.h", "f.line").alias("first"), "copies", "f.n", "f.sig", "f.half", "f.prefix")


def _may_match(a: str, b: str, na: Column, nb: Column) -> Column:
    """Length filter, and that the signatures differ in no more bits than the sets may differ in words: a ninth of both sizes."""
    whole = F.col(f"{a}sig").bitwiseXOR(F.col(f"{b}sig"))
    half = F.col(f"{a}half").bitwiseXOR(F.col(f"{b}half"))
    bits = F.when((na >= LONG) & (nb >= LONG), F.bit_count(half) + F.bit_count(whole.bitwiseXOR(half))).otherwise(F.bit_count(whole))
    return (5 * na >= 4 * nb) & (5 * nb >= 4 * na) & (9 * bits <= na + nb)


def _contents(sets: DataFrame, *more: str) -> DataFrame:
    return sets.where(F.col("n") >= LEAST).select("sid", F.coalesce("first.doc_id", F.lit(-(1 << 63))).alias("doc"), "n", "sig", "half", "prefix", *more)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _tried(contents: DataFrame) -> DataFrame:
    """Pairs (sid, other): each set with the earliest set in parts of its words' large groups, and with those just before it.

    Words at the end of the prefix serve, as the rarest are often a copy's own misprints.
    """
    last = F.greatest(F.lit(1), F.size("prefix") + 1 - TRIED_WORDS)
    rare = contents.select("sid", "doc", "n", "sig", "half", F.explode(F.slice("prefix", last, TRIED_WORDS)).alias("word"))
    # a word of so many sets is in as many lines, so its level tells most small groups without counting them
    rare = rare.where(F.col("word") >= (int(LEVELS * log2(TRIED_GROUP)) - 1 << HASH_BITS))
    large = stored(rare.groupBy("word").agg(F.count("*").alias("sets")).where(F.col("sets") >= TRIED_GROUP))
    rare = rare.join(_small(large), "word").withColumn("part", F.pmod("sid", F.ceil(F.col("sets") / TRIED_PART)))
    by = Window.partitionBy("word", "part").orderBy("doc", "sid")
    one = F.struct(F.col("sid").alias("other"), F.col("n").alias("o_n"), F.col("sig").alias("o_sig"), F.col("half").alias("o_half"))
    before = F.array(F.first(one).over(by), *(F.lag(one, i + 1).over(by) for i in range(TRIED_BEFORE)))
    met = rare.select("sid", "n", "sig", "half", before.alias("others")).select("sid", "n", "sig", "half", F.inline("others"))
    out = stored(met.where(F.col("other").isNotNull() & (F.col("other") != F.col("sid")) & _may_match("", "o_", F.col("n"), F.col("o_n"))).select("sid", "other").distinct())
    discard(large)
    return out


def _left(contents: DataFrame, share: int, few_done: bool) -> DataFrame:
    """Pairs (sid, other) that meet at a word of one share of PASSES, pass the filters and whose later set is not `done`, that is matched.

    Longer sets without a match meet all shorter ones, matched ones only those without a match: no two matched sets meet.
    few_done: the words of matched sets may be broadcast.
    """
    undone, done = contents.where("not done"), contents.where("done")
    mine = F.pmod("word", F.lit(PASSES)) == share
    # size and place of a word in one column: fewer and smaller rows to shuffle
    packed = (F.shiftleft(F.col("n").cast("long"), 32) + F.col("pos")).alias("place")

    def at_words(rows: DataFrame, prefix: Column, doc: Column) -> DataFrame:
        return rows.select("sid", "n", "sig", "half", doc.alias("doc"), F.posexplode(prefix).alias("pos", "word")).where(mine).select("word", "sid", packed, "sig", "half", "doc")

    short, first_doc = F.slice("prefix", 1, F.floor(F.col("n") / 9).cast("int") + 1), F.lit(-(1 << 63)).cast("long")
    of_all = at_words(contents, short, F.when(F.col("done"), F.col("doc")).otherwise(first_doc))
    n, m, p, q = ((F.shiftright(c, 32) if high else c.bitwiseAND((1 << 32) - 1)) for high in (True, False) for c in (F.col("place"), F.col("o_place")))
    ordered = (m < n) | ((m == n) & (F.col("o_sid") < F.col("sid")))
    # what is shared before, here and behind must reach 9 * overlap >= 4 * (n + m)
    placed = 9 * (1 + F.least(p, q) + F.least(n - 1 - p, m - 1 - q)) >= 4 * (n + m)
    may = (F.col("word") == F.col("o_word")) & ordered & _may_match("", "o_", n, m) & placed
    other = lambda rows: rows.select(*(F.col(c).alias(f"o_{c}") for c in rows.columns))
    first = at_words(undone, F.col("prefix"), F.col("doc")).join(other(of_all), may & (F.col("doc") >= F.col("o_doc")))
    later = at_words(done, F.col("prefix"), F.col("doc"))
    second = (F.broadcast(later) if few_done else later).join(other(at_words(undone, short, F.col("doc"))), may & (F.col("doc") <= F.col("o_doc")))
    return first.select("sid", F.col("o_sid").alias("other")).union(second.select("sid", "o_sid")).distinct()


def _similar(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """The later sets of those pairs (later, earlier) whose words have a similarity of 0.8 or more."""
    both = pairs.join(words.toDF("later", "mine"), "later").join(words.toDF("earlier", "theirs"), "earlier")
    shared = F.size(F.array_intersect("mine", "theirs"))
    return both.where(9 * shared >= 4 * (F.size("mine") + F.size("theirs"))).select(F.col("later").alias("sid")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """Of pairs (sid, other) with a similarity of 0.8 or more, the later sets.

    One similar earlier set is enough: one pair of each later set is verified first, the others only where that one fails.
    """
    wanted = pairs.select("sid").union(pairs.select("other")).distinct()
    places = sets.select("sid", "first").join(_small(wanted), "sid")
    # the lines wanted of one document, which is split once for all of them
    asked = stored(places.groupBy(F.col("first.doc_id").alias("d"), F.col("first.h").alias("dh")).agg(F.collect_list(F.struct("sid", "first")).alias("asked")))
    at = docs.join(_small(asked), F.col("doc_id").eqNullSafe(F.col("d")) & (F.xxhash64("text") == F.col("dh"))).select(_lines(F.col("text")).alias("lines"), "asked")
    at = at.select("lines", F.explode("asked").alias("a")).select("a.sid", F.array_distinct(_words(F.get("lines", F.col("a.first.line")))).alias("words"), "a.first")
    # documents may be repeated
    at = stored(at.groupBy("sid").agg(F.first("words").alias("words"), F.first("first").alias("first")))
    first = at.select("sid", "first")
    both = pairs.join(first, "sid").join(first.toDF("other", "o_first"), "other")
    swapped = F.col("o_first") < F.col("first")
    ordered = stored(both.select(F.when(swapped, F.col("sid")).otherwise(F.col("other")).alias("later"), F.when(swapped, F.col("other")).otherwise(F.col("sid")).alias("earlier")))
    words = at.select("sid", "words")
    sure = stored(_similar(ordered.groupBy("later").agg(F.min("earlier").alias("earlier")), words))
    rest = ordered.join(_small(sure.toDF("later")), "later", "left_anti")
    out = stored(sure.union(_similar(rest, words)))
    discard(asked, at, ordered, sure)
    return out


def _gone(lines: DataFrame, judged: DataFrame) -> DataFrame:
    """Lines of the sets judged that go. No task gets all lines of a set that many lines are."""
    few = judged.count() <= BROADCAST_ROWS
    if few:
        met = lines.join(F.broadcast(judged), "sid")
    else:
        heavy = judged.where(F.col("copies") > F.lit(HEAVY_SHARE) * F.lit(lines.count()))  # 1 / HEAVY_SHARE rows at most
        light = judged.join(F.broadcast(heavy.select("sid")), "sid", "left_anti")
        met = lines.join(F.broadcast(heavy), "sid").unionByName(lines.join(F.broadcast(heavy.select("sid")), "sid", "left_anti").join(light, "sid"))
    return met.where(F.col("near") | (F.struct("doc_id", "h", "line") != F.col("first"))).select("doc_id", "h", "line")


def later_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, h, removed): of documents that lose lines, the hash of the text and the line numbers, from 0, in order."""
    docs = docs.select("doc_id", "text")
    hashed = stored(_hashed(docs), random=True)
    lines = stored(hashed.select("doc_id", "h", "line", "sid"))
    sets = stored(_sets(hashed, _levels(hashed)), random=True)
    discard(hashed)
    tried = _tried(_contents(sets))
    early = _verified(tried, sets, docs)
    kept, told = sets, sets.join(_small(early.withColumn("done", F.lit(True))), "sid", "left").withColumn("done", F.coalesce("done", F.lit(False)))
    if early.count() > BROADCAST_ROWS:  # a few matched sets are looked up wherever sets are read, of many it is written down
        kept = told = stored(told, random=True)
        discard(sets)
    discard(tried)
    # a prefix has a fifth of the words and one more
    few_done = (told.where("done").agg(F.sum(F.floor(F.col("n") / 5) + 1)).first()[0] or 0) <= BROADCAST_ROWS
    left = [stored(_left(_contents(told, "done"), share, few_done)) for share in range(PASSES)]
    # similar sets share many words, so most of their pairs are met in each pass
    met = stored(reduce(DataFrame.union, left).distinct())
    discard(*left)
    late = _verified(met, kept, docs)
    discard(met)
    near = _small(early.union(late).distinct())
    said = "sid", "first", "copies"
    repeated = kept.where("copies > 1").select(*said).join(near, "sid", "left_anti").withColumn("near", F.lit(False))
    judged = stored(kept.select(*said).join(near, "sid", "left_semi").withColumn("near", F.lit(True)).unionByName(repeated))
    out = stored(_gone(lines, judged).groupBy("doc_id", "h").agg(F.array_sort(F.collect_set("line")).alias("removed")))
    discard(lines, kept, early, late, judged)
    return out


def _with_removed(docs: DataFrame, name: str) -> DataFrame:
    d, h, removed = free_name(docs, "gone_doc", "gone_h", name)
    gone = later_lines(docs).toDF(d, h, removed)
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone[d]) & (F.xxhash64(docs["text"]) == gone[h]), "left").select(*(docs[c] for c in docs.columns), F.coalesce(gone[removed], F.array().cast(NONE)).alias(removed))


def remove_lines(docs: DataFrame) -> DataFrame:
    """docs with later near-equal lines taken out of the texts; `n_chars`, if there, is counted anew.

    Lines are parted by line feeds and compared as sets of words as written, parted by white space; the earlier is that of the smaller doc_id, then of the smaller
    place. A line goes if any earlier line, kept or not, is similar to it. Lines
    without words stay. Null texts stay null, a text may become empty, no row is
    dropped. A document repeated in full, doc_id included, counts once and its
    rows lose the same lines. Null doc_ids come first. Columns of any name survive.
    """
    [name] = free_name(docs, "removed")
    marked = _with_removed(docs, name)
    kept = F.filter(F.split("text", "\n", -1), lambda line, i: ~F.array_contains(F.col(name), i))
    out = marked.withColumn("text", F.when(F.size(name) == 0, F.col("text")).otherwise(F.array_join(kept, "\n")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(name) == 0, F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*docs.columns)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and removed (line numbers from 0, comma-joined) of each document.

    Null text has no lines, empty text one without words. Repeated rows stay, an
    empty table stays empty, other columns are ignored.
    """
    feeds = F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    counted = docs.select("doc_id", F.xxhash64("text").alias("text_h"), F.coalesce(feeds + 1, F.lit(0)).alias("n_lines"), F.col("text").isNull().alias("none"))
    gone = later_lines(docs).toDF("d", "h", "removed")
    out = counted.join(gone, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_h") == F.col("h")), "left")
    removed = F.coalesce("removed", F.array().cast(NONE))
    return out.select("doc_id", F.when(F.col("none"), 0).otherwise(F.col("n_lines")).cast("long").alias("n_lines"), F.size(removed).cast("long").alias("n_removed"), F.array_join(removed.cast("array<string>"), ",").alias("removed"))
