"""Queries with SQL against it, and the SQL-free ones against brute force, on the smallest tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash

from tests.conftest import SF, rows_of
from witnesslake.llm import bpe, queries


def lowered(s: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


@pytest.fixture(scope="module")
def docs(duck):
    return dict(duck.sql("select doc_id, text from documents").fetchall())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF), duck.sql(queries.ORACLES[name])
    cols = sorted(got.columns)
    assert rows_of(got, cols) == sorted(map(str, want.select(", ".join(cols)).fetchall()))


def test_quality_on_held_out(spark, duck, docs):
    rows = {r.doc_id: r for r in queries.op1_quality(spark, SF).collect()}
    assert set(rows) == set(docs)
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
        assert r.predicted == int(r.score >= 0.3)
    truth = {i: q for i, q in duck.sql("select doc_id, quality from labels").fetchall() if rows[i].held_out}
    good, bad = [rows[i].score for i, q in truth.items() if q], [rows[i].score for i, q in truth.items() if not q]
    assert min(good) >= 0.3
    assert np.mean([g > b for g in good for b in bad]) > 0.95 if bad else True


def test_neighbours_recall(spark, duck):
    rows = duck.sql("select vec_id, embedding from embeddings order by vec_id").fetchall()
    ids, x = np.array([i for i, _ in rows]), np.array([e for _, e in rows], float)
    got = defaultdict(list)
    for r in queries.op3_neighbours(spark, SF).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(got) == {i for i in ids if i % 20 == 0}
    hit = total = 0
    for q, found in got.items():
        found.sort()
        s = x @ x[ids == q][0]
        score = dict(zip(ids, s, strict=True))
        s[ids == q] = -np.inf
        want = ids[np.lexsort((ids, -s))[:20]]
        assert [r for r, *_ in found] == list(range(1, len(found) + 1))
        assert all(abs(score[v] - c) < 1e-9 and v != q for _, v, c in found)
        hit, total = hit + len({*want} & {v for _, v, _ in found}), total + len(want)
    assert hit / total >= 0.9


def test_base_secrets(spark, docs):
    kinds = (("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile("[0-9a-f]+"), 0, 32))
    for r in queries.op5_secrets(spark, SF).collect():
        spans = sorted((m.start(), k, m.end(), kind) for k, (kind, p, g, n) in enumerate(kinds) for m in p.finditer(docs[r.doc_id] or "") if len(m[g]) >= n)
        said = [f"{kind}:{a}:{b}" for a, _, b, kind in spans]
        assert r.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert set(said) <= set(r.spans.split(",")) or not said


def test_line_dedup_is_exact(spark, docs):
    seen, by_word, want = [], defaultdict(list), {}
    for i in sorted(docs):
        gone = []
        for k, line in enumerate((docs[i] or "").split("\n")):
            words = frozenset(re.findall(r"[^ \t-\r]+", line))
            shared = defaultdict(int)
            for w in words:
                for j in by_word[w]:
                    shared[j] += 1
            if any(9 * n >= 4 * (len(words) + len(seen[j])) for j, n in shared.items()):
                gone.append(k)
            if words:
                seen.append(words)
                for w in words:
                    by_word[w].append(len(seen) - 1)
        want[i] = ",".join(map(str, gone))
    assert {r.doc_id: r.removed for r in queries.op7_line_dedup(spark, SF).collect()} == want


def test_shards(spark, docs):
    rows = queries.op8_shards(spark, SF).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {i: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs.items()}
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert set(by) == set(range(8))
    assert all(sorted(r.slot for r in s) == list(range(len(s))) for s in by.values())
    sizes = [sum(r.size for r in s) for s in by.values()]
    assert max(sizes) - min(sizes) <= 2 * max(r.size for r in rows)


def test_bpe_equals_tiktoken(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = bpe.parse_ranks(f.read())
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in queries.op9_bpe(spark, SF).collect():
        ids = known.encode_ordinary(docs[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest()


def brute_fingerprint(text: str) -> int:
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] * bool(w)
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(texts: dict) -> dict:
    prints = {i: brute_fingerprint(t or "") for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(texts):
        for j in sorted(texts):
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 3 and (a := find(i)) != (b := find(j)):
                root[max(a, b)] = min(a, b)
    return {i: (f"{prints[i]:016x}", find(i)) for i in texts}


def test_simhash_components(spark, docs):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op10_simhash(spark, SF).collect()}
    assert got == brute_components(docs)
