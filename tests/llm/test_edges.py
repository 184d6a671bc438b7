"""Nulls, empty and odd texts, ties, repeated rows, empty tables and clashing columns; blocks and hot groups."""

from __future__ import annotations

import random

import duckdb
import numpy as np
import pandas as pd
import pytest
import tiktoken
from public_tokenizers import PATTERN, path
from pyspark.sql import functions as F

from tests.conftest import rows_of
from tests.llm.test_queries import brute_components
from witnesslake.llm import ann, bpe, decontam, graph, htmltext, linededup, quality, queries, secrets, shards, simhash, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long, removed string, score string, fp string"
RANKS = path("byte_bpe_50k.tiktoken")
LONG = "word" * 3000 + "\n" + " ".join(f"w{i % 50}" for i in range(4000))


@pytest.fixture(scope="module")
def odd(spark):
    texts = [(1, None), (2, ""), (3, "one two three four five six\nseven"), (4, "one two three four five six\nother words"), (4, "one two three four five six\nother words"), (None, "alone here"), (None, None), (5, LONG), (6, " \n\t\n "), (7, "ſ K é 日本 \x1c\x85x")]
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "r", "s", "f") for i, t in texts], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(3, 1, 0), (4, 0, None), (None, 1, 0), (9, None, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "One, two THREE"), (2, None), (3, ""), (3, "four five"), (4, " ".join(f"w{i}" for i in range(40)))], "item_id long, text string")


def test_all_take_odd_rows(spark, odd, labels, bench):
    n = odd.count()
    for out in (quality.score(odd, labels), decontam.judge(odd, bench), secrets.scan(odd), linededup.report(odd), shards.shard(odd), bpe.token_digests(odd, RANKS, PATTERN), simhash.with_components(odd)):
        assert len(out.collect()) == n
    for out in (quality.keep_good(odd, labels), linededup.remove_lines(odd), simhash.keep_first(odd), decontam.keep_clean(odd, bench)):
        assert out.columns == odd.columns
        out.collect()


def test_all_take_empty_tables(spark, odd, labels, bench):
    none = odd.limit(0)
    for out in (quality.score(none, labels.limit(0)), decontam.judge(none, bench.limit(0)), secrets.scan(none), linededup.report(none), linededup.remove_lines(none), shards.shard(none), bpe.token_digests(none, RANKS, PATTERN), simhash.with_components(none), simhash.keep_first(none), decontam.keep_clean(none, bench)):
        assert out.collect() == []
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert urls.filter_urls(pages).collect() == htmltext.extract(pages).collect() == []
    assert {r.contaminated for r in decontam.judge(odd, bench.limit(0)).collect()} == {False}


def test_url_rules(spark):
    cases = {
        "http://a.com/": ("a.com", "/", "com/", "allow"), "http://A.Example.COM/en/x?q#f": ("a.example.com", "/en/x", "example.com/en/", "block"), "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"), "http://x.net/es/": ("x.net", "/es/", "net/es/", "block"), "http://net/fr/é": ("net", "/fr/é", "net/fr/", "block"), "http://x.net/ES/": ("x.net", "/ES/", None, "allow"),
        "http://org/.example.com/en/": ("org", "/.example.com/en/", None, "allow"), "http://a.com": ("a.com", "", None, "allow"), "a.com/": ("", "", None, "allow"), "x://": ("", "", None, "allow"), None: ("", "", None, "allow"), "http://a?b.com/://c.com/": ("a", "", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(cases)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(pages).collect()}
    assert got == dict(enumerate(cases.values()))


def test_globs_of_many_words():
    globs = ["a*c", "a**c", "?b", "x" * 150, "*.net/*"]
    subjects = ["abc", "a/c", "ac", "éb", "/b", "x" * 150, "x" * 149, "q.net/p", "q.net/p/r", ""]
    want = {"abc": (1, 1, 0, 0, 0), "a/c": (0, 1, 0, 0, 0), "ac": (1, 1, 0, 0, 0), "éb": (0, 0, 1, 0, 0), "x" * 150: (0, 0, 0, 1, 0), "q.net/p": (0, 0, 0, 0, 1)}
    got = urls.match(urls.compile_globs(globs), subjects)
    assert urls.match(urls.compile_globs(["*.com/**", "*.net/x/**"]), ["a.com/" + "x/" * 1_000_000, "b.net/" + "y" * 50]).tolist() == [[True, False], [False, False]]
    assert [tuple(map(int, r)) for r in got] == [want.get(s, (0,) * 5) for s in subjects]


def test_bpe_on_random_texts():
    with open(RANKS, "rb") as f:
        data = f.read()
    known = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.parse_ranks(data), special_tokens={})
    packed, split = bpe._table(data, PATTERN)  # noqa: SLF001
    rnd = random.Random(7)
    for _ in range(300):
        letters = rnd.choice(["a", "ab", "abc ", "aA1 \n\t", "é日x\x1c\x85​ ", "0123", "-=_*#'s", "   \n\r x", "<|endoftext|>"])
        s = "".join(rnd.choice(letters) for _ in range(rnd.choice([1, 5, 40, 300, 1500])))
        ids = [i for p in split.findall(s) for i in packed.codec.encode(p.encode())]
        assert ids == known.encode_ordinary(s)
        assert packed.codec.decode(ids) == s.encode()


def test_blocks_find_what_one_block_finds(spark, bench):
    rows = [(i, " ".join(f"w{(i * 3 + j) % 60}" for j in range(60))) for i in range(12)] + [(3, "x four five one two three"), (3, "x four five one two three")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = sorted(map(str, decontam.judge(docs, bench).collect()))
    assert sorted(map(str, decontam.judge(docs, bench, block_bytes=40).collect())) == one
    assert any("contaminated=True" in r for r in one)


def test_items_without_an_id_give_hits(spark):
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(20))
    docs = pd.DataFrame([(0, words(0)), (1, f"{words(1)} {words(2)}"), (2, words(3)), (3, "short item"), (4, f"{words(4)} none")], columns=["doc_id", "text"])
    items = pd.DataFrame([(None, words(0)), (5, words(1)), (None, words(2)), (None, words(1)), (None, "short item"), (None, None), (6, words(4))], columns=["item_id", "text"]).astype({"item_id": "Int64"})
    duck = duckdb.connect()
    duck.register("documents", docs)
    duck.register("benchmark", items)
    given = spark.createDataFrame([(None if pd.isna(i) else int(i), t) for i, t in items.itertuples(index=False)], "item_id long, text string")
    for block_bytes in (decontam.BLOCK_BYTES, 40):
        got = decontam.judge(spark.createDataFrame(docs), given, block_bytes)
        want = duck.sql(queries.ORACLES["op4_decontamination"])
        assert rows_of(got, sorted(got.columns)) == sorted(map(str, want.select(", ".join(sorted(got.columns))).fetchall()))
        assert {r.doc_id for r in got.where("contaminated").collect()} == {0, 1, 3, 4}


def test_repeated_items_do_not_fill_a_block(spark, monkeypatch):
    seen, finder = [], decontam._finder  # noqa: SLF001
    monkeypatch.setattr(decontam, "_finder", lambda docs, parts: seen.append(sum(len(" ".join(w)) for _, w in parts)) or finder(docs, parts))
    items = [(0, "the same passage again")] * 200 + [(i, f"passage {i} of the benchmark") for i in range(1, 40)]
    docs = spark.createDataFrame([(0, "the same passage again"), (1, "passage 7 of the benchmark"), (2, "else")], "doc_id long, text string")
    got = decontam.judge(docs, spark.createDataFrame(items, "item_id long, text string"), block_bytes=500)
    assert {r.doc_id: (r.n_hit, r.n_items) for r in got.collect()} == {0: (4, 1), 1: (5, 1), 2: (0, 0)}
    assert max(seen) <= 2 * 500


def test_secret_without_a_keyword(spark):
    rnd = random.Random(5)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(rnd.choice(letters) for _ in range(60)) for _ in range(20)]
    rows = [(i, f"the id {k} was seen") for i, k in enumerate(keys)] + [(100 + i, "internationalizationandlocalizationofsoftware2 " * 2 + "zzzzzzzzzzzzzzzzzzzzzzzzzzzzzzz1 0123456789012345678901234567") for i in range(20)]
    got = {r.doc_id: r.spans for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i] == "random:7:67" for i in range(20)) >= 17
    assert all(not got[100 + i] for i in range(20))


def test_html_parts():
    page = """<html><head><title>T</title></head><body class="ad-free"><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice">We use cookies.</div>
    <article><h2>Head&amp;line</h2><p>A first &lt;p&gt; of&nbsp;the   text,<br>with words enough.<p>Short.<script>if (a < b) { "</p>" }</script><div class="comments"><p>Nice article, I have read it all and liked it much.</p></div></article>
    <aside>More to read here.</aside><form><label>Mail</label><input></form><footer>&copy; us</footer><p hidden>unseen words</body></html>"""
    assert htmltext.main_text(page) == "Head&line\nA first <p> of the text, with words enough.\nShort."
    for odd in (None, "", "<", "<p", "</p></div>", "<!-- open", "<script>x", "a < b & c", "<p class='x>y", "<![if]>x"):
        assert isinstance(htmltext.main_text(odd), str)
    assert htmltext.main_text("<nav>a b c</nav><footer>d</footer>") == ""


def test_html_wrappers_and_foreign_elements():
    text = "A sentence of the text with words enough to be read."
    for wrapper in ("content-sidebar-wrap", "has-sidebar", "no-comments", "site with-left-sidebar"):
        assert htmltext.main_text(f"<div class='{wrapper}'><article><p>{text}</article></div>") == text
    assert htmltext.main_text(f"<div class='layout has-sidebar no-comments'><div class=post><p>{text}</div></div>") == text
    comment = "<section class=comments><article><p>Nice text, I have read it all and liked it much.</article></section>"
    for beside in ("<aside>{}</aside>", "<div hidden>{}</div>", "<main><div class=sidebar>{}</div></main>"):
        assert htmltext.main_text(beside.format(f"<article><p>{text}</article>")) == ""
    assert htmltext.main_text(f"<div class=has-sidebar><main><p>{text}{comment}</main></div>") == text
    assert htmltext.main_text(f"<article><p>{text}<svg class='x'/> And more.<p>Area <math><mi>a</mi><mo>+</mo><mspace/><mi>b</mi><annotation>a+b</annotation></math> it is.<svg><text>drawn</text></svg></article>") == f"{text} And more.\nArea a+ b it is."


def test_minimum_cut_is_minimal():
    rnd = random.Random(2)
    for _ in range(60):
        n = rnd.randint(1, 8)
        leans = [rnd.uniform(-2, 2) for _ in range(n)]
        edges = [(a, b, rnd.uniform(0, 1.5)) for a in range(n) for b in range(a) if rnd.random() < 0.5]
        cost = lambda on, leans=leans, edges=edges: sum(-x * o for x, o in zip(leans, on, strict=True)) + sum(w * (on[a] != on[b]) for a, b, w in edges)
        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert abs(cost(htmltext.minimum_cut(leans, edges)) - best) < 1e-9


def test_neighbours_of_copies_and_odd_vectors(spark):
    rnd = np.random.default_rng(1)
    rows = [(i, rnd.normal(size=6).astype(float).tolist()) for i in range(200)] + [(i, [1.0] * 6) for i in range(200, 300)]
    rows += [(300, None), (301, [0.0] * 6), (302, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (303, [float("nan")] * 6), (304, [1.0]), (None, [1.0] * 6)]
    got = {}
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert set(got) == {i for i in range(0, 300, 20)}
    assert all(len(v) == 20 for v in got.values())
    assert not any(v >= 300 or v == q for q, found in got.items() for _, v in found)


def test_neighbours_with_ties_and_repeated_ids(spark):
    """Few rows, so windows hold all: exact, ties between unlike vectors to the smaller id, one vector of each id."""
    rnd = np.random.default_rng(3)
    rows = [(i, rnd.integers(-2, 3, 5).astype(float).tolist()) for i in range(1, 90)] + [(0, [1.0, 1.0, 0.0, 0.0, 0.0]), (0, [0.0, 0.0, 1.0, 1.0, 0.0]), (7, [1.0] * 5)]
    for kind in ("float", "double"):
        df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
        held = {r.vec_id: np.array(r.x) for r in ann.vectors(df).groupBy("vec_id").agg(F.min_by("x", F.xxhash64("x")).alias("x")).collect()}
        got = {}
        for r in ann.search(df).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert set(got) == {i for i in held if i % 20 == 0}
        for q, found in got.items():
            want = sorted(((i, float(held[q] @ x)) for i, x in held.items() if i != q), key=lambda c: (-c[1], c[0]))[:20]
            assert found == want


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(0, 100)] + [(200, 201), (5, 5), (None, 3)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**dict.fromkeys(range(101), 0), 200: 200, 201: 200}


def test_tiles_of_a_group_of_near_copies(spark):
    base = [f"word{i}" for i in range(80)]
    rnd = random.Random(4)
    texts = {}
    for i in range(60):
        words = list(base)
        words[rnd.randrange(80)] = f"new{i}"
        texts[i] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute_components(texts)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.with_components(docs).collect()} == want
    prints = docs.select(simhash.fingerprints(docs)(F.col("text")).alias("fp")).distinct()
    assert simhash.links(prints, tile=8).count() > 0  # many tiles on both sides
    assert simhash.keep_first(docs).count() == len({c for _, c in want.values()})


def test_tiles_next_to_a_crowded_cell(spark):
    rnd = random.Random(6)
    four = lambda: sum(1 << b for b in rnd.sample(range(15), 4))
    crowd = {four() | four() << 16 | four() << 32 | four() << 48 for _ in range(3000)}
    few = {x | 1 << 15 for x in rnd.sample(sorted(crowd), 20)}
    prints = spark.createDataFrame([(x,) for x in crowd | few], "fp long")
    _, right = simhash._tiles(prints, 3, 100)  # noqa: SLF001
    assert right.groupBy("r_cell", "r_i", "r_j").count().agg(F.max("count")).first()[0] <= 2 * 100
    got = [dict(map(tuple, graph.components(simhash.links(prints, tile=tile)).collect())) for tile in (100, 1 << 20)]
    assert got[0] == got[1]
    assert few <= set(got[0])


def test_one_row_of_each_component_is_kept(spark):
    word = lambda i: " ".join(f"{i}word{j}" for j in range(40))
    rows = [(None, word(i)) for i in (0, 1, 2, 2)] + [(7, word(3)), (7, word(4)), (7, word(4)), (8, word(4)), (None, word(5)), (9, word(5))]
    docs = spark.createDataFrame([(i, t, "kept") for i, t in rows], "doc_id long, text string, mark string")
    got = sorted(((r.doc_id, r.text) for r in simhash.keep_first(docs).collect()), key=str)
    assert got == sorted([(None, word(0)), (None, word(1)), (None, word(2)), (7, word(3)), (7, word(4)), (9, word(5))], key=str)


def test_shards_split_a_hot_group(spark):
    rows = [(i, "copy " * 50) for i in range(400)] + [(i, f"text {i} " * 20) for i in range(400, 800)]
    got = shards.shard(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    assert len(got) == 8
    assert max(r.b for r in got) - min(r.b for r in got) <= 800
