"""WARC archives in Zstandard, a frame for each record, with the dictionary in front.

The writer decides by digest which records are revisits, deals all records to
archives of bounded size and lets Spark's own writer store the frames: they go
to any store that Spark writes to, and a lost task leaves nothing behind. The
writer's separator of rows is an empty skippable frame, which readers pass over.

The reader takes the dictionary from the leading skippable frame, finds each
frame's end by its block headers, decodes one frame a record and checks headers,
lengths and digests; what it can't read it reports as a row with a problem.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from witnesslake.llm.common import cut, delete, discard, shared_folder, small_batches, stored

#: Payloads of fewer bytes are always stored in full.
REVISIT_BYTES = 1000
#: Payload bytes of an archive: bounds what a reader holds at once. Level of compression.
ARCHIVE_BYTES, LEVEL = 16 << 20, 3
#: The dictionary is made from so many pages, so many characters of each, chosen by digest; it affects sizes alone.
SAMPLE_PAGES, SAMPLE_CHARS, DICTIONARY_BYTES = 256, 8192, 65536
#: Of records, as pages have no date of their own.
DATE = "1970-01-01T00:00:00Z"
# Fixed values of the formats.
FRAME, DICTIONARY_FRAME, SKIPPABLE, DICTIONARY = 0xFD2FB528, 0x184D2A5D, 0x184D2A50, 0xEC30A437
#: A skippable frame of no bytes.
GAP = "P*M\x18\0\0\0\0"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_URN = "urn:x-page:"
#: What a header's line can't hold.
UNSAFE = re.compile(r"[\x00-\x20\x7f]")
NAMES = "record_id record_type page_id url date refers_to payload_bytes payload_digest payload problem".split()
SCHEMA = "archive string, at long, record_id string, record_type string, page_id string, url string, date string, refers_to string, payload_bytes long, payload_digest string, payload binary, problem string"


def record(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None = None, date: str = DATE) -> bytes:
    """One record: a response, or a revisit of the page that it refers to, which holds the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if refers_to is None else b"")
    urn = lambda i: f"<{RECORD_URN}{quote(i, safe='')}>"
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, digest)}>" if page_id is None else urn(page_id)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url)))
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", urn(refers_to))]
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]  # noqa: S324
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    """Header lines by lower-cased name; lines that begin with white space go on with the one before."""
    lines: list[str] = []
    for line in head.decode().split("\r\n"):
        if line[:1] in (" ", "\t") and lines:
            lines[-1] += " " + line.strip(" \t")
        elif line:
            lines.append(line)
    out = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not re.fullmatch(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name):
            raise ValueError(f"header line {line[:60]!r}")
        out.setdefault(name.lower(), value.strip(" \t"))
    return out


def _length(fields: dict[str, str]) -> int:
    said = fields.get("content-length", "")
    if not re.fullmatch("[0-9]+", said):
        raise ValueError(f"Content-Length {said!r}")
    return int(said)


def _page(uri: str | None) -> str | None:
    said = (uri or "").removeprefix("<").removesuffix(">")
    return unquote(said.removeprefix(RECORD_URN)) if said.startswith(RECORD_URN) else None


def parse(raw: bytes) -> dict[str, object]:
    """What a record says, by NAMES; ValueError where its headers, lengths or digests are wrong."""
    version, _, rest = raw.partition(b"\r\n")
    head, blank, rest = rest.partition(b"\r\n\r\n")
    if not re.fullmatch(rb"WARC/[01]\.[0-9]+", version) or not blank:
        raise ValueError("no WARC header")
    fields = _fields(head)
    missing = [k for k in ("warc-type", "warc-record-id", "warc-date", "content-length") if k not in fields]
    if missing:
        raise ValueError(f"no {', '.join(missing)}")
    block, end = rest[: _length(fields)], rest[_length(fields) :]
    if end != b"\r\n\r\n":
        raise ValueError("the block's length isn't Content-Length")
    kind, payload, size = fields["warc-type"], block, len(block)
    if fields.get("content-type", "").startswith("application/http"):
        http, blank, payload = block.partition(b"\r\n\r\n")
        if not http.startswith(b"HTTP/") or not blank:
            raise ValueError("no HTTP header")
        inner = _fields(http.partition(b"\r\n")[2])
        size = _length(inner) if kind == "revisit" or "content-length" in inner else len(payload)
        if kind != "revisit" and size != len(payload):
            raise ValueError("the payload's length isn't the HTTP Content-Length")
    for name, content in (("warc-block-digest", block), ("warc-payload-digest", None if kind == "revisit" else payload)):
        algorithm, _, said = fields.get(name, "").partition(":")
        if content is not None and algorithm.lower() == "sha1" and re.fullmatch("[0-9a-f]{40}", said) and hashlib.sha1(content).hexdigest() != said:  # noqa: S324
            raise ValueError(f"{name} is wrong")
    digest = fields.get("warc-payload-digest", "").partition(":")[2] or None
    return {"record_id": fields["warc-record-id"], "record_type": kind, "page_id": _page(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "date": fields["warc-date"], "refers_to": _page(fields.get("warc-refers-to")), "payload_bytes": size, "payload_digest": digest, "payload": None if kind == "revisit" else payload, "problem": None}


def frames(data: bytes) -> Iterator[tuple[int, int, int]]:
    """(magic, begin, end) of each frame, skippable ones included, by lengths and block headers; ValueError at the first that is cut off."""
    at, word = 0, lambda i, n: int.from_bytes(data[i : i + n], "little")
    while at < len(data):
        magic, begin = word(at, 4), at
        if magic & ~0xF == SKIPPABLE:
            at += 8 + word(at + 4, 4)
        elif magic == FRAME:
            try:
                header = data[at : at + 18]
                at, checked = at + zstandard.frame_header_size(header), zstandard.get_frame_parameters(header).has_checksum
            except zstandard.ZstdError as e:
                raise ValueError(f"frame at {begin}: {e}") from e
            last = 0
            while not last:
                if at + 3 > len(data):
                    raise ValueError(f"frame at {begin} is cut off")
                last, kind, size = word(at, 3) & 1, word(at, 3) >> 1 & 3, word(at, 3) >> 3
                at += 3 + (1 if kind == 1 else size)
            at += 4 * checked
        else:
            raise ValueError(f"no frame at {begin}")
        if at > len(data):
            raise ValueError(f"frame at {begin} is cut off")
        yield magic, begin, at


def dictionary_frame(dictionary: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return DICTIONARY_FRAME.to_bytes(4, "little") + len(packed).to_bytes(4, "little") + packed


def _decoder(content: bytes) -> zstandard.ZstdDecompressor:
    """For the frames behind a dictionary, which may itself be compressed."""
    if int.from_bytes(content[:4], "little") == FRAME:
        content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
    if int.from_bytes(content[:4], "little") != DICTIONARY:
        raise ValueError("the first frame holds no dictionary")
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))


def records(data: bytes) -> Iterator[tuple[int, dict[str, object]]]:
    """(place, record) of an archive; a frame that can't be read gives a record of nothing but its problem, and the next ones follow unless the frame is cut off."""
    decoder, at = zstandard.ZstdDecompressor(), 0
    try:
        for magic, begin, end in frames(data):
            at = end
            if begin == 0 and magic == DICTIONARY_FRAME:
                decoder = _decoder(data[8:end])
            elif magic == FRAME:
                try:
                    one = decoder.decompressobj()
                    raw = one.decompress(data[begin:end])
                    yield begin, parse(raw) if one.eof else {"problem": "the frame ends early"}
                except (ValueError, zstandard.ZstdError) as e:
                    yield begin, {"problem": str(e)}
    except (ValueError, zstandard.ZstdError) as e:
        yield at, {"problem": str(e)}


def revisits(pages: DataFrame) -> tuple[DataFrame, int, str]:
    """(of, refers_to): the key of each page whose payload another page holds, and that page; the bytes of all payloads; and the greatest of the SAMPLE_PAGES smallest digests.

    Of equal payloads of REVISIT_BYTES and more the largest page_id holds it.
    A page without a page_id can refer to another but can't be referred to;
    repeated rows of the page that holds a payload all hold it.
    """
    narrow = stored(pages.select("page_id", F.sha2(_payload(), 256).alias("digest"), F.octet_length(_payload()).cast("long").alias("bytes")))
    large = narrow.where(F.col("bytes") >= REVISIT_BYTES)
    holders = stored(large.groupBy(F.col("digest").alias("held")).agg(F.max("page_id").alias("latest"), F.count("*").alias("n")).where("n > 1 and latest is not null"))
    # both sides are dealt for the join alone, so Spark can split a payload of very many pages
    found = large.join(holders, F.col("digest") == F.col("held")).where(~F.col("page_id").eqNullSafe(F.col("latest")))
    out = stored(found.select(_key(F.col("digest")).alias("of"), F.col("latest").cast("string").alias("refers_to")).distinct())
    total = narrow.agg(F.sum("bytes")).first()[0] or 0
    digests = narrow.select("digest").distinct().orderBy("digest").limit(SAMPLE_PAGES).collect()
    discard(narrow, holders)
    return out, total, digests[-1].digest if digests else ""


def _payload() -> Column:
    return F.coalesce("html", F.lit(""))


def _key(digest: Column) -> Column:
    """Pages of one key have the same payload and page_id."""
    return F.concat_ws("/", digest, F.col("page_id").cast("string"))


def train(pages: DataFrame, most: str) -> bytes | None:
    """A dictionary from the pages whose digests are at most `most`, one of each digest: the same for the same pages; None where there are too few."""
    digest = F.sha2(_payload(), 256)
    sample = pages.where(digest <= most).groupBy(digest.alias("digest")).agg(F.first(F.substring(_payload(), 1, SAMPLE_CHARS)).alias("s")).orderBy("digest").collect()  # SAMPLE_PAGES rows
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [r.s.encode() for r in sample if r.s]).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return None


def write(pages: DataFrame, folder: str, date: str = DATE) -> None:
    """A record for each row of pages(page_id, url, html), in new archives in the folder.

    A null html is an empty payload; a null url leaves its header out; null or
    repeated page_ids: revisits(). Other columns are ignored. No pages: no
    records, and the archive is empty.
    """
    spark = pages.sparkSession
    small_batches(spark)
    again, total, most = revisits(pages)
    n, dictionary = max(1, -(-total // ARCHIVE_BYTES)), train(pages, most)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        options = {} if dictionary is None else {"dict_data": zstandard.ZstdCompressionDict(dictionary)}
        encoder = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, **options)
        front = [] if dictionary is None else [dictionary_frame(dictionary)]
        for batch in batches:
            rows = zip(*(batch[c] for c in ("id", "url", "payload", "digest", "refers_to")), strict=True)
            yield pd.DataFrame({"frame": front + [encoder.compress(record(i, url, payload.encode(), digest, to, date)) for i, url, payload, digest, to in rows]})
            front = []

    keyed = pages.select(F.col("page_id").cast("string").alias("id"), "url", _payload().alias("payload"), F.sha1(_payload()).alias("digest"), _key(F.sha2(_payload(), 256)).alias("key")).repartition(n, "key")
    marked = keyed.join(again.repartition(n, "of"), F.col("key") == F.col("of"), "left").select("id", "url", "payload", "digest", "refers_to")
    # bytes pass through a string column unchanged
    marked.mapInPandas(pack, "frame binary").select(F.col("frame").cast("string").alias("value")).write.option("lineSep", GAP).text(folder)
    discard(again)


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """A row for each record of the archives in the folder: where it stands, what it says, its payload if wanted, and the problem where it can't be read."""
    small_batches(spark)

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows, held = [], 0
                for at, said in records(bytes(content)):
                    held += len(said.get("payload") or b"") if payloads else 0
                    rows.append((path, at, *(said.get(k) if payloads or k != "payload" else None for k in NAMES)))
                    if len(rows) >= 1000 or held > ARCHIVE_BYTES:
                        yield _frame(rows)
                        rows, held = [], 0
                yield _frame(rows)

    return spark.read.format("binaryFile").load(folder).select("path", "content").mapInPandas(unpack, SCHEMA)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["archive", "at", *NAMES], dtype=object)
    return out.assign(at=out["at"].astype("int64"), payload_bytes=out["payload_bytes"].astype("Int64"))


def with_payloads(read_back: DataFrame) -> DataFrame:
    """The pages behind records that read() gave: page_id, url, payload; a revisit has the payload of the response that it refers to, null if that is missing."""
    held = read_back.where("record_type = 'response' and page_id is not null").groupBy(F.col("page_id").alias("id"), F.col("payload_digest").alias("digest")).agg(F.first("payload").alias("held"))
    rows = read_back.where("record_type in ('response', 'revisit')")
    again = (F.col("refers_to") == F.col("id")) & (F.col("payload_digest") == F.col("digest"))
    return rows.join(held, again, "left").select("page_id", "url", F.coalesce("payload", "held").alias("payload"))


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each page, as read back from archives written for it.

    The archives go once they are read. A record that can't be read fails the query.
    """
    spark, kind = pages.sparkSession, dict(pages.dtypes)["page_id"]
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, folder)
    good = F.when(F.col("problem").isNull(), F.col("record_type")).otherwise(F.raise_error(F.concat_ws(": ", "archive", "problem")))
    got = cut(read(spark, folder, payloads=False).select(F.col("page_id").cast(kind), "payload_bytes", "payload_digest", good.alias("record_type"), F.col("refers_to").cast(kind)))
    delete(spark, folder)
    return got
