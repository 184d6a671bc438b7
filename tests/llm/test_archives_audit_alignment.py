"""WARC archives, the filter audit and tokenizer alignment: brute force, exact round trips, odd rows."""

from __future__ import annotations

import base64
import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import pytest
import public_tokenizers as public
import sentencepiece
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.conftest import SF
from witnesslake.llm import align, audit, queries, warc

JSON, MODEL = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")
PAGES = "page_id long, url string, html string, digest string, payload string, key string"


def sha1(payload: bytes) -> str:
    return hashlib.sha1(payload).hexdigest()  # noqa: S324


def brute_revisits(pages: list[tuple]) -> list[tuple]:
    latest = {}
    for i, _, h in pages:
        if i is not None:
            latest[h or ""] = max(i, latest.get(h or "", i))
    out = []
    for i, _, h in pages:
        raw, to = (h or "").encode(), latest.get(h or "")
        again = len(raw) >= 1000 and to is not None and to != i
        out.append((i, len(raw), sha1(raw), "revisit" if again else "response", to if again else None))
    return sorted(out, key=str)


def test_warc_on_the_table(spark, duck):
    pages = duck.sql("select page_id, url, html from pages").fetchall()
    assert sorted((tuple(r) for r in queries.op11_warc(spark, SF).collect()), key=str) == brute_revisits(pages)


def odd_pages() -> list[tuple]:
    long, same = "x" * 3_000_000, "é" * 500
    return [(1, "http://a/", same), (7, "http://b/ü?q=\r\nX: y", same), (3, None, same), (None, "u", same), (7, "http://b/", same), (4, "u", "é" * 499), (5, "u", "é" * 499), (6, "", None), (8, "u", ""), (9, "u", long), (2, "u", long), (None, None, long + "y"), (None, None, long + "y")]


def test_warc_on_odd_pages(spark, tmp_path):
    rows = odd_pages()
    pages = spark.createDataFrame([(*r, "d", "p", "k") for r in rows], PAGES)
    assert sorted((tuple(r) for r in warc.round_trip(pages).collect()), key=str) == brute_revisits(rows)
    warc.write(pages, f"{tmp_path}/a")
    got = warc.with_payloads(warc.read(spark, f"{tmp_path}/a")).collect()
    assert sorted((int(r.page_id), bytes(r.payload).decode()) for r in got if r.page_id) == sorted((i, h or "") for i, _, h in rows if i)
    assert {r.url for r in got if r.page_id == "7"} == {"http://b/ü?q=%0D%0AX:%20y", "http://b/"}
    assert warc.round_trip(pages.limit(0)).collect() == []
    # ids that are text
    named = spark.createDataFrame([("a b/<é>", "u", "z" * 1000), ("b", "u", "z" * 1000)], "page_id string, url string, html string")
    assert {(r.page_id, r.refers_to) for r in warc.round_trip(named).collect()} == {("a b/<é>", "b"), ("b", None)}


def test_archives_have_a_dictionary_and_a_frame_a_record(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    warc.write(pages, f"{tmp_path}/a")
    files = [f.read_bytes() for f in (tmp_path / "a").glob("part-*")]
    seen = 0
    for data in files:
        found = list(warc.frames(data))
        assert found[0][:2] == (warc.DICTIONARY_FRAME, 0) and found[-1][2] == len(data)
        # plain use of the library: the dictionary, then frame by frame
        held = zstandard.ZstdDecompressor().decompress(data[8 : found[0][2]])
        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held))
        plain = [reader.decompress(data[b:e]) for m, b, e in found if m == warc.FRAME]
        assert all(x.startswith(b"WARC/1.1\r\n") and x.endswith(b"\r\n\r\n") for x in plain)
        seen += len(plain)
    assert seen == pages.count()


def test_reader_reports_what_is_wrong():
    good = warc.record("1", "u", b"abc", sha1(b"abc"))
    pack = zstandard.ZstdCompressor(write_checksum=True).compress
    said = lambda raw: [r["problem"] for _, r in warc.records(raw)]
    assert said(b"") == [] and said(pack(good) + pack(good)) == [None, None]
    broken = [good.replace(b"WARC/1.1", b"HTTP/1.1"), good.replace(b"Content-Length: 3", b"Content-Length: 4"), good.replace(b"abc", b"abd"), good[:-1], good.replace(b"WARC-Date", b"WARC Date"), good.replace(b"WARC-Type: response\r\n", b""), good.replace(sha1(b"abc").encode(), b"0" * 40), b""]
    for x in broken:
        first, second = said(pack(x) + pack(good))
        assert first and second is None
    whole = pack(good)
    assert [bool(x) for x in said(whole + whole[:-3])] == [False, True]
    assert [bool(x) for x in said(whole + b"junk")] == [False, True]
    flipped = bytearray(whole)
    flipped[-1] ^= 1  # the checksum
    assert [bool(x) for x in said(bytes(flipped) + whole)] == [True, False]
    assert said(warc.DICTIONARY_FRAME.to_bytes(4, "little") + (3).to_bytes(4, "little") + b"abc" + whole)[0]
    assert said(warc.GAP.encode() + whole + warc.GAP.encode()) == [None]
    # a record of another writer: no HTTP, a folded header, sizes left to the stream
    other = b"WARC/1.0\r\nWARC-Type: metadata\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Date: d\r\nX-Note: a\r\n  b\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    stream = zstandard.ZstdCompressor(write_content_size=False).compressobj()
    ((_, r),) = warc.records(stream.compress(other) + stream.flush())
    assert (r["record_type"], r["payload"], r["page_id"], r["problem"]) == ("metadata", b"hi", None, None)


def brute_audit(docs: list[tuple], labels: list[tuple]) -> set[tuple]:
    first, failed = {}, []
    for i, _, t in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for i, s, t in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and first[t] < i}
        mine = [(q, x) for j, q, x in labels if j is not None and j == i]
        failed.append((s or "", {k for k, v in f.items() if v}, any(q == 1 for q, _ in mine), any(x == 1 for _, x in mine)))
    out, removed = {}, Counter()
    for part in {s for s, *_ in failed}:
        mine = [x[1:] for x in failed if x[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = mine
            for k, c in enumerate(order):
                lost, left = [x for x in left if c in x[0]], [x for x in left if c not in x[0]]
                out[part, "".join(order), k + 1] = (len(left), len(lost), sum(c in x[0] for x in mine) - len(lost), sum(x[0] == {c} for x in mine), sum(x[1] for x in lost), sum(x[2] for x in lost))
                removed[part, c] += len(lost)
    return {(*key, *row, removed[key[0], key[1][key[2] - 1]]) for key, row in out.items()}


def test_audit_on_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(60))
    docs = [(1, "s", None), (2, "s", ""), (3, None, long), (4, "", long), (4, "s", long), (None, "s", long), (5, "t", long + " #"), (6, "t", "AB " * 80), (7, "t", "AB " * 80), (7, "t", "AB " * 80), (8, "t", "ſK é\x85\x1c日本 " * 30), (9, "u", long + "x" * 200_000), (None, "u", "a")]
    labels = [(3, 1, 0), (4, 0, 1), (4, 1, None), (None, 1, 1), (7, None, 1), (99, 1, 1)]
    frame = spark.createDataFrame([(*d, "x", True, 0) for d in docs], "doc_id long, source string, text string, part string, A boolean, good int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = [tuple(r) for r in audit.audit(frame, marks).collect()]
    assert len(got) == 4 * 600 and set(got) == brute_audit(docs, labels)
    assert audit.audit(frame.limit(0), marks).collect() == []
    assert {r[-3:-1] for r in map(tuple, audit.audit(frame, marks.limit(0)).collect())} == {(0, 0)}


def test_inversion_on_other_numbers_of_filters(spark):
    rows = [("p", *(random.Random(i).random() < 0.4 for _ in range(1)), i % 2 == 0, i % 3 == 0, i % 5 == 0, False) for i in range(40)]
    frame = spark.createDataFrame(rows, "part string, X boolean, Y boolean, Z boolean, good boolean, toxic boolean")
    (alive,) = audit.joint_failures(frame, "XYZ").select(audit.survivors(F.col("n"), "XYZ"), audit.survivors(F.col("good"), "XYZ")).collect()
    for at, names in enumerate(audit.subsets("XYZ")):
        ok = [r for r in rows if not any(r[1 + "XYZ".index(c)] for c in names)]
        assert (alive[0][at], alive[1][at]) == (len(ok), sum(r[4] for r in ok))


def brute_alignment(texts: list[str | None]) -> list[tuple]:
    a_model, b_model = Tokenizer.from_file(JSON), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    a_model.encode_special_tokens = True
    letters = align.byte_alphabet()
    linked, rows = [], []
    for t in texts:
        a_ids = a_model.encode(" " + t, add_special_tokens=False).ids if t else []
        b_ids = b_model.encode(t) if t else []
        a_bytes = [bytes(letters[c] for c in a_model.id_to_token(i)) for i in a_ids]
        b_bytes = [bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode() for i in b_ids]
        if not t or {b"".join(a_bytes), b"".join(b_bytes)} != {(" " + t).encode()}:
            linked.append([])
            rows.append((0, 0, 0, 0, ""))
            continue
        spans = [[], []]
        for out, parts in zip(spans, (a_bytes, b_bytes), strict=True):
            at = 0
            for p in parts:
                out.append((at, at + len(p)))
                at += len(p)
        links, j = [], 0
        for i, (lo, hi) in enumerate(spans[0]):
            while spans[1][j][1] <= lo:
                j += 1
            links += [(a_ids[i], b_ids[k]) for k in itertools.takewhile(lambda k: k < len(b_ids) and spans[1][k][0] < hi, itertools.count(j))]
        ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        said, i, j = [], 0, 0
        for e in ends:
            group = []
            for ids, side, k in ((a_ids, spans[0], i), (b_ids, spans[1], j)):
                n = next(m for m in range(k, len(ids)) if side[m][1] == e) + 1
                group.append(",".join(map(str, ids[k:n])))
                i, j = (n, j) if side is spans[0] else (i, n)
            said.append("|".join(group))
        linked.append(links)
        rows.append((len(a_ids), len(b_ids), len(ends), len(links), hashlib.sha256(";".join(said).encode()).hexdigest()))
    counts = Counter(p for links in linked for p in set(links))
    most = defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    return [(*r[:4], sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), r[4]) for r, links in zip(rows, linked, strict=True)]


def test_alignment_on_the_table(spark, duck):
    docs = duck.sql("select doc_id, text from documents").fetchall()
    got = {r.doc_id: tuple(r)[1:] for r in queries.op13_alignment(spark, SF).collect()}
    assert got == dict(zip((i for i, _ in docs), brute_alignment([t for _, t in docs]), strict=True))


@pytest.mark.parametrize("part", [align.PART, 50])
def test_alignment_on_odd_rows(spark, monkeypatch, part):
    monkeypatch.setattr(align, "PART", part)
    monkeypatch.setattr(align, "RUN", 2)
    texts = [None, "", " ", "  ", "a", "a ", " a", "a▁b", "one two", "one two", "One  two\n\nthree<|endoftext|><s></s>", "日本語のテキスト é ſ \x85\x1c\x00", "<0x41> A", "▁", "😀👍🏽 x", "ab" * 40_000, " " * 9000 + "x", "\t" * 50 + "y " * 3000, "don't we'll I'M 12345 ,,,;;"]
    frame = spark.createDataFrame([(i if i != 3 else None, t, "r", "p", 0) for i, t in enumerate(texts)] + [(9, texts[9], "r", "p", 0)], "doc_id long, text string, row string, pairs string, of int")
    got = sorted((tuple(r) for r in align.alignment(frame, JSON, public.PATTERN, MODEL).collect()), key=str)
    want = brute_alignment([*texts, texts[9]])
    assert got == sorted(((i if i != 3 else None, *w) for i, w in zip([*range(len(texts)), 9], want, strict=True)), key=str)
    assert align.alignment(frame.limit(0), JSON, public.PATTERN, MODEL).collect() == []


def test_tokens_equal_the_libraries():
    with open(JSON, encoding="utf-8") as f, open(MODEL, "rb") as g:
        aligner = align.Aligner(f.read(), public.PATTERN, g.read())
    assert aligner.by_word
    with open(public.path("byte_bpe_50k.tiktoken"), "rb") as f:
        assert {base64.b64decode(x): int(i) for x, i in map(bytes.split, f)} == {b: i for i, b in enumerate(aligner.a.bytes[:50256])}
    draw = random.Random(5)
    for _ in range(3000):
        text = "".join(draw.choice(["a", "b", "the", " ", " ", "  ", "\n", "\t", "\n ", "\xa0", ".", "'s", "é", "中", "😀", "0", "<s>", "A"]) for _ in range(draw.randint(0, 40)))
        if text:
            assert aligner.a.encode(" " + text) == aligner.a.library.encode(" " + text, add_special_tokens=False).ids
            found, whole = aligner.tokens(text), (aligner.a.library.encode(" " + text, add_special_tokens=False).ids, aligner.b.model.encode(text))
            assert tuple(x.tolist() for x in found) == whole
    # every character, in the midst and at the ends of words
    for lo in range(0, 0x110000, 4096):
        text = " ".join(f"a{chr(c)}b {chr(c)} 1{chr(c)}" for c in range(lo, lo + 4096) if not 0xD800 <= c < 0xE000 and not 0x1C <= c < 0x20 and chr(c) != align.BAR)
        if text:
            assert tuple(x.tolist() for x in aligner.tokens(text)) == (aligner.a.library.encode(" " + text, add_special_tokens=False).ids, aligner.b.model.encode(text))
