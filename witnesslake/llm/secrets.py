"""Secret scans: fixed patterns, and a battery of randomness tests under false-discovery control.

Long tokens are read in the encoding their characters suggest. Three tests ask
whether the characters are uniform and independent over its alphabet: chi-squared,
runs about the middle, correlation of neighbours. A token is a discovery if none
of them speaks against randomness and ordinary text would hardly look like it,
being as even and changing as often between small letters, capitals and digits.
That chance falls with the length, and the Benjamini-Hochberg bound is taken over
all tokens of one encoding and like length in all documents, so that many short
or ordinary tokens do not hide a long key. All of it is DataFrame functions, each
linear in a text's length and matches.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from witnesslake.llm.common import cut

#: Kinds with their patterns, the group whose length counts and that length; fixed values.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (("assign", ASSIGN, 2, 8), ("access", r"AKIA[A-Z0-9]{12,}", 0, 16), ("hex", r"[0-9a-f]{32,}", 0, 32))
#: Tokens that are tested.
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
DIGITS, LOW, UP = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings in the order they are tried: pattern, alphabet, and the sums of squares and cubes of the shares that its characters have in ordinary text.
ENCODINGS = (
    (r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", DIGITS + "abcdef", 0.17, 0.035),
    (r"^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", DIGITS + "ABCDEF", 0.17, 0.035),
    (r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$", UP + "234567", 0.066, 0.0057),
    (r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9]+$", UP + LOW + DIGITS, 0.062, 0.0053),
    (r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9+/]+$", UP + LOW + DIGITS + "+/", 0.06, 0.005),
    (r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9_-]+$", UP + LOW + DIGITS + "-_", 0.06, 0.005),
)
#: Randomness is rejected below this chance; share of discoveries that may be false.
REJECT, FALSE_SHARE = 0.01, 0.01
#: Share of neighbouring letters and digits of an ordinary token, at most, that are of different kinds.
TURNS = 0.25
#: Bins of log10 of a chance and classes of length (by powers of two) for the bounds: bound the table they are read from.
BINS, LOWEST, LENGTHS = 20, -40, 32
#: Matches of a text whose places are summed up at once.
BLOCK = 64
SPAN = "struct<start:int,`end`:int,token:string,counted:int>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value made once."""
    return F.transform(F.array(value), use)[0]


def _running(values: Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The array of zero and what the steps through values make of it, in turn. Appends each time, so values must be few."""
    return F.aggregate(values, F.array(zero), lambda acc, v: F.concat(acc, F.array(step(F.element_at(acc, -1), v))))


def spans(text: Column, pattern: str, group: int) -> Column:
    """Leftmost non-overlapping matches with their places in code points, end exclusive."""
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("before"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("token"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part"))
    lengths = F.transform(F.filter(parts, lambda x: x["token"].isNotNull()), lambda x: F.struct(F.length(x["before"]).alias("before"), F.length(x["token"]).alias("long"), x["token"].alias("token"), F.length(x["part"]).alias("counted")))

    def placed(block: Column, begin: Column) -> Column:
        ends = F.slice(_running(block, begin, lambda at, x: at + x["before"] + x["long"]), 2, BLOCK)
        return F.zip_with(block, ends, lambda x, end: F.struct((end - x["long"]).alias("start"), end.alias("end"), x["token"].alias("token"), x["counted"].alias("counted")))

    def blocked(found: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / BLOCK).cast("int")), lambda i: F.slice(found, i * BLOCK + 1, F.lit(BLOCK)))
        return _let(blocks, lambda b: F.flatten(F.zip_with(b, _running(F.transform(b, lambda x: F.aggregate(x, F.lit(0), lambda acc, m: acc + m["before"] + m["long"])), F.lit(0), lambda at, n: at + n), lambda block, at: F.when(block.isNotNull(), placed(block, at)).otherwise(F.array().cast(f"array<{SPAN}>")))))

    return F.when(text.rlike(pattern), _let(lengths, blocked)).otherwise(F.array().cast(f"array<{SPAN}>"))


def _upper(z: Column) -> Column:
    """The normal law's upper tail, within 0.0002 near the middle and in proportion far out."""
    far = F.exp(-z * z / 2) / (F.greatest(z, F.lit(1.0)) * 2.5066)
    near = 1 / (1 + F.exp(0.07056 * z * z * z + 1.5976 * z))
    return F.when(z > 3, far).when(z < -30, F.lit(1.0)).otherwise(near)


def _changes(text: Column) -> Column:
    """How many neighbouring characters differ."""
    return F.regexp_count(text, F.lit(r"(?s)(.)(?!\1|\z)")).cast("double")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def _tests(token: Column, alphabet: str, squares: float, cubes: float) -> Column:
    """The chance that uniform text is as uneven, and that ordinary text looks as random."""
    place = lambda c: F.position(c, F.lit(alphabet)).cast("double") - 1
    half = len(alphabet) // 2
    products = _let(F.transform(F.split(token, ""), place), lambda x: _total(F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1), lambda a, b: a * b)))
    plain = F.regexp_replace(token, r"[+/_-]", "")
    kinds = F.translate(plain, DIGITS + LOW + UP, "0" * len(DIGITS) + "a" * len(LOW) + "A" * len(UP))
    seen = F.struct(
        F.length(token).cast("double").alias("n"), F.length(plain).cast("double").alias("plain"), _changes(kinds).alias("turns"),
        F.transform(F.array(*map(F.lit, alphabet)), lambda c: (F.length(token) - F.length(F.replace(token, c, F.lit("")))).cast("double")).alias("counts"),
        (_changes(F.translate(token, alphabet, "0" * half + "1" * (len(alphabet) - half))) + 1).alias("runs"),
        products.alias("products"), (place(F.left(token, F.lit(1))) + place(F.right(token, F.lit(1)))).alias("ends"),
    )
    return _let(seen, lambda t: _let(_sums(t, half), lambda m: _battery(t, m, float(len(alphabet)), squares, cubes)))


def _sums(t: Column, half: int) -> Column:
    counts = t["counts"]
    weighted = lambda power: _total(F.transform(counts, lambda c, i: c * F.pow(i.cast("double"), F.lit(float(power)))))
    ones = _total(F.transform(counts, lambda c, i: F.when(i >= half, c).otherwise(F.lit(0.0))))
    return F.struct(_total(F.transform(counts, lambda c: c * c)).alias("square"), ones.alias("ones"), weighted(1).alias("first"), weighted(2).alias("second"))


def _battery(t: Column, m: Column, k: float, squares: float, cubes: float) -> Column:
    n, square, ones, df = t["n"], m["square"], m["ones"], k - 1
    p_chi = _upper((F.pow((square * (k / n) - n) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / (2 / (9 * df)) ** 0.5)
    mean = 1 + 2 * ones * (n - ones) / n
    p_runs = F.when((ones == 0) | (ones == n), F.lit(0.0)).otherwise(2 * _upper(F.abs(t["runs"] - mean) / F.sqrt(F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(1e-9)))))
    middle = m["first"] / n
    spread = m["second"] - n * middle * middle
    beside = t["products"] - middle * (2 * m["first"] - t["ends"]) + (n - 1) * middle * middle
    p_serial = 2 * _upper(F.abs(beside / F.greatest(spread, F.lit(1e-9)) + 1 / n) * F.sqrt(n))
    expected = n + n * (n - 1) * squares
    varied = 2 * n * (n - 1) * (squares - squares**2) + 4 * n * (n - 1) * (n - 2) * (cubes - squares**2)
    p_even = _upper((expected - square) / F.sqrt(varied))
    steps = F.greatest(t["plain"] - 1, F.lit(1.0))
    p_turns = _upper((t["turns"] - 0.5 - TURNS * steps) / F.sqrt(steps * (TURNS * (1 - TURNS))))
    both = F.greatest(p_even * p_turns, F.lit(1e-300))  # of two independent chances, by Fisher
    return F.struct(F.least(F.lit(1.0), 3 * F.least(p_chi, p_runs, p_serial)).alias("uniform"), F.least(F.lit(1.0), both * (1 - F.log(both))).alias("text"))


def candidates(text: Column) -> Column:
    """Tokens in a known encoding with their places, the stratum of encoding and length, and the two chances."""
    tested = None
    for i, (pattern, alphabet, squares, cubes) in reversed(list(enumerate(ENCODINGS))):
        stratum = lambda s, i=i: F.least(F.lit(LENGTHS - 1), F.floor(F.log2(F.length(s["token"]))).cast("int")) + i * LENGTHS
        use = lambda s, p=pattern, a=alphabet, q=squares, c=cubes, of=stratum: (s["token"].rlike(p), F.struct(of(s).alias("stratum"), _tests(s["token"], a, q, c).alias("p")))
        tested = (lambda s, use=use, rest=tested: F.when(*use(s)).otherwise(rest(s) if rest else F.lit(None)))
    with_tests = F.transform(spans(text, TOKEN, 0), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), tested(s).alias("t")))
    flat = F.transform(with_tests, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["t"]["stratum"].alias("stratum"), s["t"]["p"].alias("p")))
    return F.filter(flat, lambda s: s["p"].isNotNull())


def bounds(tested: DataFrame, share: float = FALSE_SHARE) -> list[float]:
    """By stratum, the Benjamini-Hochberg bound on `text` chances of all its tokens in tested.cand, read from counts by bin."""
    at = F.greatest(F.lit(LOWEST * BINS), F.ceil(F.log10(F.greatest("c.p.text", F.lit(1e-300))) * BINS))
    bins = tested.select(F.explode("cand").alias("c")).groupBy(F.col("c.stratum").alias("stratum"), at.alias("bin")).agg(F.count("*").alias("n"))
    rows = bins.orderBy("stratum", "bin").collect()  # BINS * -LOWEST + 1 a stratum at most
    total, below, best = Counter(), Counter(), [0.0] * (LENGTHS * len(ENCODINGS))
    for r in rows:
        total[r.stratum] += r.n
    for r in rows:
        below[r.stratum] += r.n
        if (edge := 10.0 ** (r.bin / BINS)) * total[r.stratum] / below[r.stratum] <= share:
            best[r.stratum] = edge
    return best


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_random of each whole text.

    `spans` has the base ones and, as kind `random`, discoveries of the tests
    that overlap none of them. Null text counts as empty: no spans, the digest
    of no bytes. Repeated rows stay, an empty table stays empty, other columns
    are ignored. Equal texts get equal spans; as the bound is over all
    documents, what is found beyond the base may change with the corpus: where
    random tokens are rare among many ordinary ones of the same encoding and
    like length, short ones (below some 30 characters) stay below the bound.
    """
    text = F.coalesce("text", F.lit(""))
    long_enough = lambda least: lambda s: s["counted"] >= least
    base = [F.filter(spans(text, pattern, group), long_enough(least)).alias(kind) for kind, pattern, group, least in BASE]
    found = docs.select("doc_id", *base, candidates(text).alias("cand"))
    narrow = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    found = cut(found.select("doc_id", *(narrow(F.col(k)).alias(k) for k, *_ in BASE), "cand"))
    most = F.array(*map(F.lit, bounds(found)))
    named = lambda i, k: lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), s["end"].alias("end"), F.lit(k).alias("name"))
    every = F.concat(*(F.transform(k, named(i, k)) for i, (k, *_) in enumerate(BASE)))
    new = F.filter("cand", lambda s: (s["p"]["uniform"] >= REJECT) & (s["p"]["text"] <= F.get(most, s["stratum"])) & ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    random = F.transform(new, named(len(BASE), "random"))
    said = lambda c: F.array_join(F.transform(F.array_sort(c), lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    with_base = found.withColumn("base", every).withColumn("random", random)
    return with_base.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k, *_ in BASE), F.sha2(said(F.col("base")), 256).alias("base_sha256"), said(F.concat("base", "random")).alias("spans"), F.size("random").cast("long").alias("n_random"))
