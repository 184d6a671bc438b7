"""The pipeline's stages, each on all that its predecessor kept, against brute force."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from tests.conftest import SF
from tests.llm.test_queries import brute_components, lowered
from witnesslake.llm import bpe, quality


def brute_lines(texts: dict) -> dict:
    """Texts without lines of which an earlier one, kept or not, has nearly the same words."""
    seen, out = [], {}
    for i in sorted(texts, key=lambda i: (i is not None, i)):
        kept = []
        for line in (texts[i] or "").split("\n"):
            words = frozenset(re.findall(r"[^ \t-\r]+", line))
            if not words or not any(9 * len(words & s) >= 4 * (len(words) + len(s)) for s in seen):
                kept.append(line)
            if words:
                seen.append(words)
        out[i] = None if texts[i] is None else "\n".join(kept)
    return out


def brute_contaminated(text: str, items: list[str]) -> bool:
    words_of = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t or ""))
    words, hit = words_of(text), set()
    joined = f" {' '.join(words)} "
    for item in items:
        w = words_of(item)
        for k in range(max(1, len(w) - 12) if w else 0):
            part = w[k : k + 13]
            if f" {' '.join(part)} " in joined:
                hit.update(j for i in range(len(words) - len(part) + 1) if words[i : i + len(part)] == part for j in range(i, i + len(part)))
    return bool(hit) and 20 * len(hit) >= len(words)


def test_stages_against_brute_force(spark, duck, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [t for (t,) in duck.sql("select text from benchmark").fetchall()]
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.parse_ranks(f.read()), special_tokens={})
    weights = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out, before = stage(spark, docs, SF), texts
        assert name == "bpe" or out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name == "bpe":
            break
        texts = {r.doc_id: r.text for r in docs.collect()}
        assert docs.count() == len(texts)
        if name == "quality":
            score = lambda t: 1 / (1 + np.exp(-quality.margin(t, weights)))
            want = {i: t for i, t in before.items() if score(t) >= quality.THRESHOLD}
        elif name == "line_dedup":
            want = brute_lines(before)
            assert all(r.n_chars == len(r.text) for r in docs.collect() if r.text != before[r.doc_id])
        elif name == "near_dedup":
            want = {c: before[c] for _, c in brute_components(before).values()}
        else:
            want = {i: t for i, t in before.items() if not brute_contaminated(t, items)}
        assert texts == want
        assert texts != before
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in docs.collect()}
    ids = {i: known.encode_ordinary(t or "") for i, t in texts.items()}
    assert got == {i: (len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256((texts[i] or "").encode()).hexdigest()) for i, x in ids.items()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == set(texts)


def test_stages_take_empty_tables_and_missing_ids(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, gone_doc string"
    word = lambda k: " ".join(f"{k}word{j}" for j in range(40))
    rows = [(None, word(0), "en", "s", 9, ""), (None, None, None, None, None, None), (None, "", "en", "s", 0, ""), (1, word(1), "en", "s", 9, ""), (1, word(1), "en", "s", 9, ""), (2, word(2), "en", "s", 9, ""), (3, word(2), "en", "s", 9, "")]
    for k, docs in enumerate((spark.createDataFrame(rows, schema), spark.createDataFrame([], schema))):
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, SF).write.parquet(str(tmp_path / f"{k}{name}"))
            docs = spark.read.parquet(str(tmp_path / f"{k}{name}"))
        assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        assert docs.isEmpty() == bool(k)
