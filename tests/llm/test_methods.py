"""That results come through the methods named, and that these agree with plain formulas."""

from __future__ import annotations

import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from tests.conftest import SF
from witnesslake.llm import bpe, htmltext, linededup, quality, queries, secrets, shards

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


# Byte pair encoding.


def test_pieces_come_from_joins(duck, monkeypatch):
    with open(PATH, "rb") as f:
        ranks = bpe.parse_ranks(f.read())
    codec, seen = bpe.Codec(ranks), []
    join = bpe.Codec.join
    monkeypatch.setattr(bpe.Codec, "join", lambda self, a, b: seen.append(join(self, a, b)) or seen[-1])
    split = bpe.Splitter(public_tokenizers.PATTERN)
    pieces = {p.encode() for (t,) in duck.sql("select text from documents where text is not null").fetchall() for p in split.findall(t)}
    many = [p for p in pieces if p not in ranks]
    assert len(many) > 1000
    for p in many:
        seen.clear()
        assert codec.decode(codec._halved(p)) == p  # noqa: SLF001
        assert seen[-1] == codec.tree(p)  # the last join made it


def test_joins_of_hard_pieces(monkeypatch):
    with open(PATH, "rb") as f:
        ranks = bpe.parse_ranks(f.read())
    known = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    for name in ("PIECES", "HALVES", "PAIRS"):
        monkeypatch.setattr(bpe, name, 50)  # forgetting changes nothing
    codec, rnd = bpe.Codec(ranks), random.Random(11)
    for letters in ("a", "ab", " ", "the ", "0", "=-", "é日", "aAbB"):
        for n in (2, 3, 17, 64, 257, 2000):
            s = "".join(rnd.choice(letters) for _ in range(n))
            assert list(codec.encode(s.encode())) == known.encode_ordinary(s)


# Pages.


def _page(rnd: random.Random) -> tuple[str, str]:
    """A page and its article's text; nothing but elements says what is what."""
    words = lambda n: " ".join("".join(rnd.choice("abcdefgilmnoprstu") for _ in range(rnd.randint(1, 9))) for _ in range(n))
    inside = [words(rnd.randint(1, 8))] + [words(rnd.choice([1, 2, 30, 80])) + rnd.choice([".", "", "!"]) for _ in range(rnd.randint(0, 8))]
    article = f"<h1>{inside[0]}</h1>" + "".join(f"<p>{x}</p>" for x in inside[1:])
    menu = "<nav><ul>" + "".join(f"<li><a href='/{i}'>{words(rnd.randint(1, 3))}</a></li>" for i in range(rnd.randint(2, 9))) + "</ul></nav>"
    aside = "".join(f"<aside><p>{words(rnd.choice([3, 40]))}.</p></aside>" for _ in range(rnd.randint(0, 2)))
    main = rnd.choice(["article", "main"])
    return f"<html><head><title>t</title></head><body>{menu}<div hidden>{words(25)}.</div><{main}>{article}{aside}</{main}><footer><p>{words(rnd.choice([4, 50]))}.</p></footer></body></html>", "\n".join(inside)


def test_pages_of_known_articles(spark):
    rnd = random.Random(8)
    pages = [_page(rnd) for _ in range(200)]
    rows = [(i, f"u{i}", h, "extra") for i, (h, _) in enumerate(pages)] + [(0, "u0", pages[0][0], "again"), (900, None, None, ""), (901, "", "<p>" + "word " * 200_000, "")]
    got = htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert all(by[i].text == want and by[i].n_chars == len(want) for i, (_, want) in enumerate(pages))
    assert by[900].text == ""
    assert len(by[901].text.split()) == 200_000


def test_the_cut_decides_against_leans(duck, monkeypatch):
    """Blocks whose label is another than their own lean, looks and evidence together; pages that go through max-flow."""
    flow, flows = htmltext._flow, []  # noqa: SLF001
    monkeypatch.setattr(htmltext, "_flow", lambda *a: flows.append(1) or flow(*a))
    cells, pages = Counter(), [htmltext.Reader(h) for (h,) in duck.sql("select html from pages").fetchall()]
    for p in pages:
        cells.update((htmltext.cell(b), b.kind == htmltext.MAIN) for b in p.blocks if b.kind in (htmltext.MAIN, *htmltext.BESIDES))
    weights, other = htmltext.learn(dict(cells)), 0
    for p in pages:
        leans, edges = htmltext.graph(p, weights)
        cut = htmltext.minimum_cut(leans, edges)
        other += sum((x > 0) != c for x, c in zip(leans, cut, strict=True))
    assert other > 0
    many = "".join(f"<div><p>{'word ' * k}{mark}</p></div>" for k in range(1, 60) for mark in ("", "."))
    assert htmltext.main_text(f"<main>{many}<div class=comments>{many}</div></main>", weights).count("\n") == 2 * 59 - 1
    assert flows
    # no capacity of a holder outweighs what its blocks can bring against it
    assert max(map(abs, htmltext.EVIDENCE.values())) <= htmltext.MOST


def test_misleading_names_are_outvoted():
    rnd = random.Random(3)
    for name in ("sidebar", "promo widget", "related comments", "nav-menu", "ad", "x1 y2"):
        text = [" ".join("".join(rnd.choice("aeinrst") for _ in range(rnd.randint(2, 9))) for _ in range(rnd.randint(25, 60))) + "." for _ in range(rnd.randint(3, 7))]
        inside = "".join(f"<p>{x}</p>" for x in [text[0], "A short line", *text[1:]])
        menu = "".join(f"<div class=c{i}><a href='/{i}'>item {i}</a></div>" for i in range(6))
        page = f"<body><div class='z9'>{menu}</div><div class='{name}'>{inside}</div><footer><p>{text[0]}</footer></body>"
        assert htmltext.main_text(page) == "\n".join([text[0], "A short line", *text[1:]])
        # where the page says what its text is, the same name keeps its word
        page = f"<body><main><p>{text[1]}</p></main><div class='{name}'><p>{text[2]}</p></div></body>"
        assert htmltext.main_text(page).startswith(text[1]) and (text[2] in htmltext.main_text(page)) == (name == "x1 y2")


def test_deep_and_unclosed_pages():
    began = time.perf_counter()
    assert htmltext.main_text("<div>w " * 100_000) is not None
    assert htmltext.main_text("<div>w " * 20_000 + "</section>" * 20_000 + "<i>" * 20_000 + "<p>x" * 20_000 + "</div>" * 20_000) is not None
    rnd = random.Random(1)
    parts = ["<p>a b", "<p>" + "word " * 40 + ".", "<li>x", "<div class=ad><p>" + "word " * 30 + ".</div>"]
    assert htmltext.main_text("<main>" + "".join(rnd.choice(parts) for _ in range(20_000)) + "</main>")
    assert time.perf_counter() - began < 60


def test_long_lists_stay():
    items = [f"item {i}" for i in range(3000)]
    assert htmltext.main_text("<article><h1>t</h1><ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul></article>") == "\n".join(["t", *items])
    comments = "".join(f"<p>{'a long remark of many words ' * 8}.</p>" for _ in range(20))
    assert htmltext.main_text(f"<article><p>{'text ' * 30}.</p></article><div class=comments>{comments}</div>") == "text " * 30 + "."


def test_looks_decide_without_holders():
    text = "A sentence of the text with words enough to be read by all who come here."
    page = f"<body><div><div>{text}</div><div>Short.</div><div>{text}</div></div><div><div><a href=/>one</a></div><div><a href=/>two</a></div></div></body>"
    assert htmltext.main_text(page) == f"{text}\nShort.\n{text}"


def test_the_classifier_is_a_logistic_regression():
    rnd = random.Random(1)
    cells = {((rnd.randint(0, 14), rnd.randint(0, 4), rnd.random() < 0.5, rnd.random() < 0.2, rnd.random() < 0.3), rnd.random() < 0.6): rnd.randint(1, 30) for _ in range(80)}
    w = np.array(htmltext.learn(cells))
    total = {k: sum(n for (_, y), n in cells.items() if y == k) for k in (True, False)}

    def loss(w):
        out = htmltext.RIDGE * (w @ w) / 2
        for (c, y), n in cells.items():
            m = float(np.array(htmltext._row(c)) @ w)  # noqa: SLF001
            out += htmltext.KIND_WEIGHT * n / total[y] * math.log1p(math.exp(-m if y else m))
        return out

    assert all(loss(w) <= loss(w + d) for d in np.concatenate((np.eye(6), -np.eye(6))) * 1e-3)


# Secrets.


def _normal(z: float) -> float:
    return math.erfc(z / math.sqrt(2)) / 2


def _plain_battery(token: str, alphabet: str, squares: float, cubes: float) -> tuple[float, float]:
    x, n, k = [alphabet.index(c) for c in token], len(token), len(alphabet)
    square = sum(c * c for c in Counter(x).values())
    chi = sum((Counter(x)[i] - n / k) ** 2 / (n / k) for i in range(k))
    p_chi = _normal(((chi / (k - 1)) ** (1 / 3) - (1 - 2 / (9 * (k - 1)))) / math.sqrt(2 / (9 * (k - 1))))
    up = [v >= k / 2 for v in x]
    ones, runs = sum(up), 1 + sum(a != b for a, b in zip(up, up[1:], strict=False))
    mean = 1 + 2 * ones * (n - ones) / n
    p_runs = 0.0 if ones in (0, n) else 2 * _normal(abs(runs - mean) / math.sqrt((mean - 1) * (mean - 2) / (n - 1)))
    middle = sum(x) / n
    serial = sum((a - middle) * (b - middle) for a, b in zip(x, x[1:], strict=False)) / sum((v - middle) ** 2 for v in x)
    p_serial = 2 * _normal(abs(serial + 1 / n) * math.sqrt(n))
    p_even = _normal((n + n * (n - 1) * squares - square) / math.sqrt(2 * n * (n - 1) * (squares - squares**2) + 4 * n * (n - 1) * (n - 2) * (cubes - squares**2)))
    kinds = ["0" if c.isdigit() else "a" if c.islower() else "A" for c in token if c.isalnum()]
    turns, steps = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)), len(kinds) - 1
    p_turns = _normal((turns - 0.5 - secrets.TURNS * steps) / math.sqrt(steps * secrets.TURNS * (1 - secrets.TURNS)))
    both = max(1e-300, p_even * p_turns)
    return min(1.0, 3 * min(p_chi, p_runs, p_serial)), min(1.0, both * (1 - math.log(both)))


def _tested(alphabet, squares, cubes):
    return lambda t: secrets._tests(t, alphabet, squares, cubes)  # noqa: SLF001


def test_battery_against_plain_formulas(spark):
    rnd, tokens = random.Random(4), []
    for i, (_, alphabet, *_) in enumerate(secrets.ENCODINGS):
        tokens += [(i, "".join(rnd.choice(alphabet[:m]) for _ in range(n))) for n in (20, 33, 64, 300) for m in (len(alphabet), len(alphabet) // 2)]
    for i, (_, alphabet, squares, cubes) in enumerate(secrets.ENCODINGS):
        mine = [t for j, t in tokens if j == i]
        df = spark.createDataFrame([(t,) for t in mine], "t string")
        for r in df.select("t", F.transform(F.array("t"), _tested(alphabet, squares, cubes))[0].alias("p")).collect():
            uniform, text = _plain_battery(r.t, alphabet, squares, cubes)
            assert r.p.uniform == pytest.approx(uniform, abs=0.002)
            assert math.log10(max(1e-250, r.p.text)) == pytest.approx(math.log10(max(1e-250, text)), abs=0.1 + 0.02 * abs(math.log10(max(1e-250, text))))


def test_bounds_are_benjamini_hochberg(spark):
    rnd = random.Random(5)
    p = {s: [10 ** (-6 * rnd.random() ** (s + 1)) for _ in range(400)] for s in range(3)}
    rows = [([{"stratum": s, "p": {"text": x}}],) for s in p for x in p[s]]
    got = secrets.bounds(spark.createDataFrame(rows, "cand array<struct<stratum:int,p:struct<text:double>>>"), 0.05)
    for s, values in p.items():
        ranked = sorted(values)
        want = max((x for i, x in enumerate(ranked, 1) if x * len(ranked) / i <= 0.05), default=0.0)
        # bins round a chance up, so the bound may stop a bin below the exact one, never above a bin's width
        assert got[s] <= want * 10 ** (1 / secrets.BINS) and (not want or sum(x <= got[s] for x in ranked) >= 0.8 * sum(x <= want for x in ranked))


def test_rare_keys_among_ordinary_tokens(spark):
    rnd = random.Random(6)
    letters = secrets.UP + secrets.LOW + secrets.DIGITS
    key = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    plain = lambda: "-".join("".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(4, 9))) for _ in range(4)) + f"-{rnd.randint(1, 99)}"
    keys = [key(40) for _ in range(8)] + [key(32) for _ in range(8)]
    rows = [(i, f"see {k} here") for i, k in enumerate(keys)] + [(100 + i, " ".join(plain() for _ in range(80))) for i in range(100)]
    got = {r.doc_id: r.spans for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i] == f"random:4:{4 + len(k)}" for i, k in enumerate(keys)) >= 13
    assert sum(bool(got[100 + i]) for i in range(100)) <= 2


def test_long_tokens_and_many_matches(spark):
    rnd = random.Random(7)
    token = "".join(rnd.choice(secrets.UP + secrets.LOW + secrets.DIGITS) for _ in range(200_000))
    many = "é ".join(f"token={token[i : i + 12]}" for i in range(5000))
    got = {r.doc_id: r for r in secrets.scan(spark.createDataFrame([(1, f"x {token}"), (2, many)], "doc_id long, text string")).collect()}
    assert got[1].spans == "random:2:200002"
    assert got[2].n_assign == 5000
    assert got[2].spans.split(",")[-1] == f"assign:{len(many) - 18}:{len(many)}"


# Quality.


def test_training_against_a_dense_twin(spark, duck):
    """The same updates with a weight for each slot, kept as plain numbers."""
    texts = dict(duck.sql("select doc_id, text from documents").fetchall())
    labels = [(i, q) for i, q in duck.sql("select doc_id, quality from labels").fetchall() if zlib.crc32(str(i).encode()) % 5]
    rows = [(*quality.features(texts[i]), q) for i, q in labels[:60]]
    got = quality.train(rows, epochs=2)
    z, n = {}, {}

    def weight(i):
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= quality.L1 else -(zi - math.copysign(quality.L1, zi)) / ((quality.BETA + math.sqrt(n.get(i, 0.0))) / quality.ALPHA + quality.L2)

    for _ in range(2):
        for at, value, y in rows:
            x = dict(zip(at.tolist(), value.tolist(), strict=True)) | {1 << quality.BITS: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / quality.ALPHA * w[i]
                n[i] = n.get(i, 0.0) + g * g
    assert np.count_nonzero(got) > 100
    assert all(got[i] == pytest.approx(weight(i), abs=1e-5) for i in [*z, 0, 1, 2])


def test_features_are_hashed_words_and_pairs():
    mix = 0x9E3779B97F4A7C15
    h = [xxhash.xxh64_intdigest(w) for w in ("ab", "12", "!?")]
    pairs = [(((a * mix) % (1 << 64) ^ b) * mix) % (1 << 64) for a, b in zip(h, h[1:], strict=False)]
    at, value = quality.features("ab 12!?")
    assert dict(zip(at.tolist(), value.tolist(), strict=True)) == {k: c * quality.SCALE / 5 for k, c in Counter(x >> (64 - quality.BITS) for x in h + pairs).items()}


def test_a_document_repeated_often_teaches_once(spark):
    docs = spark.createDataFrame([(i, f"good text number {i} of many" if i % 2 else f"%%% ### {i} $$$") for i in range(40)] + [(1, "good text number 1 of many")] * 3000, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    assert (quality.fit(docs, labels) == quality.fit(docs.distinct(), labels)).all()


# Lines and shards.


def test_lines_whose_signatures_say_nothing(spark, monkeypatch):
    """Without the signatures' filter far more pairs are verified, on their words, with the same result."""
    monkeypatch.setattr(linededup, "BUCKETS", 1 << 8)
    monkeypatch.setattr(linededup, "BLOCKS", 1 << 2)
    monkeypatch.setattr(linededup, "_may_match", lambda a, b, na, nb: (5 * na >= 4 * nb) & (5 * nb >= 4 * na))
    rnd = random.Random(3)
    lines = [" ".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") * 2 for _ in range(rnd.randint(9, 14))) for _ in range(120)]
    lines += [x + " zz" for x in lines[:20]]
    docs = spark.createDataFrame([(i, "\n".join(lines[i * 7 : i * 7 + 7])) for i in range(20)], "doc_id long, text string")
    exact = {r.doc_id: r.removed for r in linededup.report(docs).collect()}
    seen, want = [], {}
    for i in range(20):
        gone = []
        for k, line in enumerate(lines[i * 7 : i * 7 + 7]):
            words = set(line.split())
            if any(9 * len(words & s) >= 4 * (len(words) + len(s)) for s in seen):
                gone.append(k)
            seen.append(words)
        want[i] = ",".join(map(str, gone))
    assert exact == want


def test_large_groups_are_tried_first(spark, monkeypatch):
    monkeypatch.setattr(linededup, "TRIED_GROUP", 8)
    rnd = random.Random(2)
    base = [f"word{i}" for i in range(60)]
    texts = {}
    for i in range(200):
        words = list(base)
        for _ in range(rnd.randint(0, 3)):
            words[rnd.randrange(60)] = f"new{i}x{rnd.randrange(99)}"
        texts[i] = " ".join(words)
    got = {r.doc_id: r.removed for r in linededup.report(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    sets = [set(texts[i].split()) for i in range(200)]
    want = {i: "0" if any(9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])) for j in range(i)) else "" for i in range(200)}
    assert got == want


def test_prefixes_are_sorted_as_plain_numbers(spark, tmp_path):
    """Stored words may be null by their type; their places in the order may not, else they are sorted as boxed values."""
    linededup._hashed(spark.createDataFrame([(1, "one two three four five six")], "doc_id long, text string")).write.parquet(f"{tmp_path}/hashed")
    hashed = spark.read.parquet(f"{tmp_path}/hashed")
    assert not linededup._sets(hashed, linededup._levels(hashed)).schema["prefix"].dataType.containsNull


def test_any_similar_earlier_set_is_enough(spark):
    """The pair of a later set that is verified first may fail where another does not."""
    lines = ["a b c d e f g h i j", "k l m n o p q r s t", "k l m n o p q r s u", "v w x y z"]
    docs = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "doc_id long, text string")
    sets = docs.selectExpr("doc_id + 1 as sid", "struct(doc_id, xxhash64(text) as h, 0 as line) as first")
    pairs = spark.createDataFrame([(3, 1), (2, 3), (4, 1)], "sid long, other long")
    assert [r.sid for r in linededup._verified(pairs, sets, docs).collect()] == [3]


def test_pairs_met_in_several_passes_are_verified_once(spark, monkeypatch):
    """Near copies share words of every pass; each of their pairs is handed on once, and sets are written once."""
    asked, written, verified, store = [], [], linededup._verified, linededup.stored

    def counted(pairs, sets, docs):
        asked.append((pairs.count(), pairs.distinct().count()))
        return verified(pairs, sets, docs)

    def noted(df, random=False):
        written.append(df.columns)
        return store(df, random)

    monkeypatch.setattr(linededup, "_verified", counted)
    monkeypatch.setattr(linededup, "stored", noted)
    docs = spark.createDataFrame([(i, " ".join([*(f"word{k}" for k in range(40)), f"new{i}"])) for i in range(12)], "doc_id long, text string")
    got = {r.doc_id: r.removed for r in linededup.report(docs).collect()}
    assert got == {i: "0" if i else "" for i in range(12)}
    assert all(rows == different for rows, different in asked)
    assert asked[-1][0] == 66
    assert sum("prefix" in columns for columns in written) == 1


def test_many_matched_sets_are_written_down(spark, monkeypatch):
    """Above BROADCAST_ROWS the sets matched early are told by a table of their own; the result is the same."""
    monkeypatch.setattr(linededup, "TRIED_GROUP", 4)
    rnd = random.Random(5)
    texts = []
    for i in range(60):
        words = [f"word{k}" for k in range(30)]
        words[rnd.randrange(30)] = f"new{i}"
        texts.append((i, " ".join(words) + f"\nline {i} of its own has other{i} words{i} in{i}"))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    few = {r.doc_id: r.removed for r in linededup.report(docs).collect()}
    monkeypatch.setattr(linededup, "BROADCAST_ROWS", 3)
    assert {r.doc_id: r.removed for r in linededup.report(docs).collect()} == few == {i: "0" if i else "" for i in range(60)}


def test_heavy_sets_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(linededup, "BROADCAST_ROWS", 5)
    monkeypatch.setattr(linededup, "HEAVY_SHARE", 0.2)
    rows = [(i, "the same line of words here\n" + (f"line {i // 2} has its own words in it" if i else "")) for i in range(60)]
    got = {r.doc_id: r.removed for r in linededup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: "" if i == 0 else "0" if i == 1 or i % 2 == 0 else "0,1" for i in range(60)}


def test_splitters_against_recounting(spark, duck):
    """Bytes of each shard counted anew: each edge misses its even share by the tolerance or one group of equal texts."""
    rows = queries.op8_shards(spark, SF).collect()
    sizes = [sum(r.size for r in rows if r.shard == s) for s in range(8)]
    total, below = sum(sizes), 0
    slack = shards.TOLERANCE * total / 8
    largest = max(r.size for r in rows)
    for s in range(7):
        below += sizes[s]
        assert abs(below - total * (s + 1) / 8) <= max(slack, largest)
    by_text = {}
    for r in rows:
        by_text.setdefault((r.text_crc32, r.size), set()).add(r.shard)
    assert sum(len(s) > 1 for s in by_text.values()) <= 7
