"""WARC archives: written with segmentation and chunked framing, read back and reassembled.

Archives are text files whose records end in CRLF CRLF, gzipped; Spark's own writer and
reader move the bytes. Reading splits at the version line that opens a record. Records of one origin are
grouped by their origin identifier, ordered by segment number and checked against the
total length; the HTTP body is then decoded from its chunks.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import shared_dir

VERSION = b"WARC/1.1\r\n"
END = b"\r\n\r\n"
CHUNK, SEGMENT = 8192, 16384
#: Payloads below this are always stored whole.
REVISIT_BYTES = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def chunked(body: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing; a chunk ends inside any text that looks like a record's version line."""
    cuts = sorted({*range(0, len(body), size), *(m.start() + 4 for m in re.finditer(re.escape(VERSION), body)), len(body)})
    parts = [b"%x\r\n%b\r\n" % (b - a, body[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(data: bytes) -> bytes:
    """Body of a chunked message; ValueError where the framing is broken."""
    out, at = [], 0
    while True:
        line = data.find(b"\r\n", at)
        if line < 0:
            raise ValueError("chunk size line missing")
        size = int(data[at:line].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        out.append(data[line + 2 : line + 2 + size])
        at = line + 2 + size
        if data[at : at + 2] != b"\r\n" or len(out[-1]) != size:
            raise ValueError("chunk cut short")
        at += 2


def segments(block: bytes, size: int = SEGMENT) -> list[bytes]:
    """Pieces of a block, one at least."""
    return [block[at : at + size] for at in range(0, max(len(block), 1), size)]


def _record(kind: str, rid: str, fields: dict[str, str], block: bytes, date: str) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{rid}>", "WARC-Date": date, **fields, "Content-Length": str(len(block))}
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block


def records_of(page: str, url: str, payload: bytes, digest: str, first: str | None, date: str, segment: int) -> list[bytes]:
    """The records of one page, without their closing CRLF CRLF."""
    rid = f"urn:page:{page}:{digest[:16]}"
    url = re.sub(r"[\r\n]+", " ", url)
    url = re.sub(r"WARC/1\.1$", "WARC/1.%31", url)  # would end in a version line
    fields = {"WARC-Target-URI": url, "WARC-Payload-Digest": f"sha256:{digest}"}
    if first is not None:
        head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        more = {"WARC-Refers-To": f"<urn:page:{first}:{digest[:16]}>", "WARC-Profile": PROFILE, "Content-Type": "application/http; msgtype=response"}
        return [_record("revisit", rid, fields | more, head, date)]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    fields["Content-Type"] = "application/http; msgtype=response"
    parts = segments(block, segment)
    if len(parts) == 1:
        return [_record("response", rid, fields, block, date)]
    out = [_record("response", rid, fields | {"WARC-Segment-Number": "1"}, parts[0], date)]
    for k, part in enumerate(parts[1:], 2):
        last = {"WARC-Segment-Total-Length": str(len(block))} if k == len(parts) else {}
        out.append(_record("continuation", f"{rid}:{k}", {"WARC-Target-URI": url, "WARC-Segment-Origin-ID": f"<{rid}>", "WARC-Segment-Number": str(k), **last}, part, date))
    return out


def write_warc(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", segment: int = SEGMENT, date: str = "2025-01-01T00:00:00Z") -> None:
    """Writes one record (or segmented record) per row as gzipped WARC files under `path`.

    Of rows with equal payloads of at least 100 bytes, those with the smallest id are
    responses and the others revisit it. Null payloads are empty; null urls are ''; null
    ids count as larger than all others. Repeated rows are records of their own. Further
    columns are ignored.
    """
    body = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), body.alias("payload"), F.sha2(body, 256).alias("digest"))
    large = F.octet_length("payload") >= REVISIT_BYTES
    firsts = df.select(F.col(id_col).alias("id"), body.alias("payload")).where(large).groupBy(F.sha2("payload", 256).alias("digest")).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    joined = rows.join(firsts, "digest", "left").select("id", "url", "payload", "digest", F.when(large & ~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 256):
                out: list[bytes] = []
                for row in batch.slice(lo, 256).to_pylist():
                    first = None if row["first"] is None else str(row["first"])
                    out += records_of("null" if row["id"] is None else str(row["id"]), row["url"], row["payload"], row["digest"], first, date, segment)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    text = joined.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    text.write.option("lineSep", END.decode()).option("compression", "gzip").text(path)


def _parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one record, read without its version line; ValueError if the block isn't as long as it says."""
    if not raw.endswith(END):
        raise ValueError(f"record without its closing CRLF CRLF: {raw[:200]!r}")
    head, _, block = raw[: -len(END)].partition(END)
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if colon:
            fields[name.strip().lower()] = value.strip()
    if int(fields.get("content-length", -1)) != len(block):
        raise ValueError(f"record {fields.get('warc-record-id')}: {len(block)} bytes instead of {fields.get('content-length')}")
    return fields, block


_SCHEMA = "record_id string, record_type string, uri string, refers_to string, payload_digest string, payload_bytes long, n_segments int, payload binary"
_NAMES = [f.split()[0] for f in _SCHEMA.split(", ")]
_TYPES = [pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.binary()]


def _agrees(said: str, payload: bytes) -> bool:
    """Whether a declared digest is the payload's: SHA-256 in hex, SHA-1 in hex or base32; other kinds aren't judged."""
    kind, _, value = said.rpartition(":")
    if kind.lower() in ("", "sha256"):
        return value.lower() == hashlib.sha256(payload).hexdigest()
    if kind.lower() == "sha1":
        found = hashlib.sha1(payload)
        return value.lower() == found.hexdigest() or value.upper() == base64.b32encode(found.digest()).decode()
    return True


def _finished(fields: dict[str, str], block: bytes, n: int, keep: bool) -> tuple:
    """A logical record: HTTP body decoded, payload digest verified."""
    kind, said = fields["warc-type"], fields.get("warc-payload-digest", "")
    payload, size = None, None
    if block.startswith(b"HTTP/"):
        head, _, body = block.partition(END)
        if kind == "revisit":  # no payload of its own: its length stands in the stored HTTP header
            stated = re.search(rb"(?im)^content-length:\s*(\d+)", head)
            size = int(stated[1]) if stated else None
        else:
            payload = dechunked(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked", head) else body
    elif kind != "revisit":
        payload = block
    if payload is not None:
        size = len(payload)
        if said and not _agrees(said, payload):
            raise ValueError(f"record {fields['warc-record-id']}: its payload doesn't have the digest {said}")
        said = hashlib.sha256(payload).hexdigest()
    target = fields.get("warc-refers-to")
    return fields["warc-record-id"].strip("<>"), kind, fields.get("warc-target-uri"), target and target.strip("<>"), said.removeprefix("sha256:"), size, n, payload if keep else None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], _NAMES)


def read_warc(spark: SparkSession, path: str, with_payload: bool = True, version: str = "1.1") -> DataFrame:
    """Logical records of the WARC files of one `version` (1.0 or 1.1) under `path`, segments put together.

    The version line is the reader's separator, so files are split like any text; it has no
    proper part that is also its beginning, which the reader's matching at buffer ends needs.

    Columns: ``record_id, record_type, uri, refers_to, payload_digest, payload_bytes,
    n_segments, payload``. Fails where a block isn't as long as declared, a segment is
    missing, the total length is wrong, chunked framing is broken or a payload doesn't have
    its SHA-256 or SHA-1 digest. Revisits have no payload; their digest and length are the
    declared ones, the length null where the stored HTTP header has none.
    Repeated segmented records come out as often as they went in.
    """
    raw = spark.read.option("lineSep", f"WARC/{version}\r\n").text(path)
    head = F.substring_index("value", END.decode(), 1)
    cut = head.contains("WARC-Segment-Number:")
    data = F.col("value").cast("binary").alias("raw")  # not through string functions: a cut may part a character

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 256):
                yield _batch([_finished(*_parsed(x.as_py()), 1, with_payload) for x in batch.slice(lo, 256).column(0)])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 256):
                rows = []
                for x in batch.slice(lo, 256).column(0):
                    fields, block = _parsed(x.as_py())
                    origin = fields.get("warc-segment-origin-id", fields["warc-record-id"])
                    rows.append((origin, int(fields["warc-segment-number"]), "\r\n".join(f"{k}: {v}" for k, v in fields.items()), block))
                cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string(), pa.int32(), pa.string(), pa.binary()], strict=True)], ["origin", "number", "head", "block"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["origin"] != now:
                    if parts:
                        yield _batch(_together(parts, with_payload))
                    now, parts = row["origin"], []
                parts.append((row["number"], row["head"], row["block"]))
        if parts:
            yield _batch(_together(parts, with_payload))

    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    single = raw.where(~cut & (F.length("value") > 0)).select(data).mapInArrow(whole, _SCHEMA)
    pieces = raw.where(cut).select(data).mapInArrow(parse, "origin string, number int, head string, block binary")
    pieces = pieces.repartition(width, "origin").sortWithinPartitions("origin", "number")
    return single.unionByName(pieces.mapInArrow(assemble, _SCHEMA))


def _together(parts: list[tuple[int, str, bytes]], keep: bool) -> list[tuple]:
    """One origin's segments, in order of their numbers, as logical records."""
    times = sum(n == 1 for n, *_ in parts)
    chain = [p for k, p in enumerate(parts) if k == 0 or p[0] != parts[k - 1][0]]
    origin = dict(line.split(": ", 1) for line in chain[0][1].split("\r\n") if ": " in line)
    last = dict(line.split(": ", 1) for line in chain[-1][1].split("\r\n") if ": " in line)
    block = b"".join(b for *_, b in chain)
    if [n for n, *_ in chain] != list(range(1, len(chain) + 1)):
        raise ValueError(f"record {origin['warc-record-id']}: segments {[n for n, *_ in chain]}")
    if int(last.get("warc-segment-total-length", -1)) != len(block):
        raise ValueError(f"record {origin['warc-record-id']}: {len(block)} bytes in all instead of {last.get('warc-segment-total-length')}")
    return [_finished(origin, block, len(chain), keep)] * times


def op9_warc_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    got = read_warc(spark, path, with_payload=False)
    page = lambda c: F.nullif(F.split(F.col(c), ":")[2], F.lit("null")).cast("long")
    return got.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


OP9_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(encode(coalesce(html, ''))) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
