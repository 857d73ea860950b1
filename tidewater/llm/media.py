"""Signature sniffing of media columns.

An Aho-Corasick automaton finds magic bytes anywhere in a blob. Each hit goes to its
format's validator, which walks the structure and returns the format's true length, or
nothing. A hit at offset 0 (or the format's fixed offset) gives the blob's type, which
corrects the declared one; later hits that validate are carved as embedded media.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WAV_RATE = 8000
PAD = 192


def _png(b: bytes, at: int) -> int:
    """Chunks with right CRCs from IHDR to IEND."""
    p, first = at + 8, True
    while p + 12 <= len(b):
        n = int.from_bytes(b[p : p + 4], "big")
        kind, end = b[p + 4 : p + 8], p + 12 + n
        if end > len(b) or (first and (kind != b"IHDR" or n != 13)):
            return 0
        if zlib.crc32(b[p + 4 : p + 8 + n]) != int.from_bytes(b[p + 8 + n : end], "big"):
            return 0
        if kind == b"IEND":
            return end - at
        p, first = end, False
    return 0


def _gif(b: bytes, at: int) -> int:
    """Logical screen, colour tables and blocks up to the trailer."""
    if at + 13 > len(b):
        return 0
    flags, p, images = b[at + 10], at + 13, 0
    if flags & 0x80:
        p += 3 << ((flags & 7) + 1)
    while p < len(b):
        kind = b[p]
        if kind == 0x3B:
            return p + 1 - at if images else 0
        if kind == 0x21:
            p += 2
        elif kind == 0x2C:
            if p + 10 > len(b):
                return 0
            p += 11 + ((3 << ((b[p + 9] & 7) + 1)) if b[p + 9] & 0x80 else 0)
            images += 1
        else:
            return 0
        while p < len(b) and b[p]:
            p += 1 + b[p]
        p += 1
    return 0


def _jpeg(b: bytes, at: int) -> int:
    """Marker segments with lengths, then scans up to EOI."""
    p, frame = at + 2, False
    while p + 4 <= len(b):
        if b[p] != 0xFF:
            return 0
        kind = b[p + 1]
        if kind == 0xFF:
            p += 1
            continue
        if kind == 0xD9:
            return p + 2 - at if frame else 0
        if kind < 0xC0 or 0xD0 <= kind <= 0xD8:
            return 0
        n = int.from_bytes(b[p + 2 : p + 4], "big")
        if n < 2:
            return 0
        frame |= kind in (0xC0, 0xC1, 0xC2, 0xC3)
        p += 2 + n
        if kind == 0xDA:
            while True:
                p = b.find(b"\xff", p)
                if p < 0 or p + 1 >= len(b):
                    return 0
                if b[p + 1] == 0 or 0xD0 <= b[p + 1] <= 0xD7:
                    p += 2
                    continue
                break
            if b[p + 1] == 0xD9:
                return p + 2 - at if frame else 0
    return 0


def _bmp(b: bytes, at: int) -> int:
    """File size, header size, planes, depth and pixel offset agree."""
    if at + 54 > len(b):
        return 0
    size, _, off, head, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", b, at + 2)
    if head not in (40, 52, 56, 108, 124) or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or width <= 0 or not height:
        return 0
    row = (width * bits + 31) // 32 * 4
    return size if 14 + head <= off < size <= len(b) - at and (off + row * abs(height) <= size or bits < 16) else 0


def _riff(b: bytes, at: int) -> int:
    """A RIFF form whose chunks fill its length exactly."""
    if at + 12 > len(b):
        return 0
    n = int.from_bytes(b[at + 4 : at + 8], "little")
    end, p, kinds = at + 8 + n, at + 12, []
    if end > len(b):
        return 0
    while p + 8 <= end:
        kinds.append(b[p : p + 4])
        size = int.from_bytes(b[p + 4 : p + 8], "little")
        p += 8 + size + (size & 1)
    if p not in (end, end + 1) or not kinds:
        return 0
    form = b[at + 8 : at + 12]
    if form == b"WAVE":
        return end - at if kinds[0] == b"fmt " and b"data" in kinds else 0
    if form == b"WEBP":
        return end - at if kinds[0] in (b"VP8 ", b"VP8L", b"VP8X") else 0
    return end - at if form == b"AVI " else 0


def _gzip(b: bytes, at: int) -> int:
    """One member that inflates to its end with a right trailer."""
    if at + 18 > len(b) or b[at + 3] & 0xE0:
        return 0
    engine = zlib.decompressobj(31)
    try:
        p = at
        while p < len(b) and not engine.eof:
            piece = b[p : p + 65536]
            p += len(piece)
            while piece:  # bounded output, whatever the ratio
                engine.decompress(piece, 1 << 20)
                piece = engine.unconsumed_tail
    except zlib.error:
        return 0
    return p - len(engine.unused_data) - at if engine.eof else 0


def _zip(b: bytes, at: int) -> int:
    """The end record's directory offset and size lead back to this local header."""
    p = at
    while (p := b.find(b"PK\x05\x06", p + 1)) >= 0:
        if p + 22 > len(b):
            return 0
        count, size, off, note = struct.unpack_from("<HIIH", b, p + 10)
        if count and at + off + size == p and b[at + off : at + off + 4] == b"PK\x01\x02" and p + 22 + note <= len(b):
            return p + 22 + note - at
    return 0


def _pdf(b: bytes, at: int) -> int:
    """A header with a version, then startxref and, before any other header, the last end mark: updated files have several."""
    if not (b[at + 5 : at + 6].isdigit() and b[at + 6 : at + 7] == b"."):
        return 0
    other = b.find(b"%PDF-", at + 5)
    end = b.rfind(b"%%EOF", at, other if other >= 0 else len(b))
    return end + 5 - at if end >= 0 and b.find(b"startxref", at, end) >= 0 else 0


def _ogg(b: bytes, at: int) -> int:
    """Pages of one stream from its first to its last flag."""
    p, serial = at, None
    while p + 27 <= len(b) and b[p : p + 4] == b"OggS" and b[p + 4] == 0:
        flags, own, n = b[p + 5], b[p + 14 : p + 18], b[p + 26]
        if serial is None and not flags & 2 or serial not in (None, own) or p + 27 + n > len(b):
            return 0
        serial = own
        p += 27 + n + sum(b[p + 27 : p + 27 + n])
        if p > len(b):
            return 0
        if flags & 4:
            return p - at
    return 0


def _flac(b: bytes, at: int) -> int:
    """STREAMINFO and the other metadata blocks; the audio runs to the blob's end."""
    p, first = at + 4, True
    while p + 4 <= len(b):
        n = int.from_bytes(b[p + 1 : p + 4], "big")
        if first and (b[p] & 0x7F or n != 34):
            return 0
        last, p, first = b[p] & 0x80, p + 4 + n, False
        if last:
            return len(b) - at if p < len(b) and b[p : p + 1] == b"\xff" else 0
    return 0


def _tiff(b: bytes, at: int) -> int:
    """The first directory lies inside and its entries are well typed."""
    order = "little" if b[at : at + 2] == b"II" else "big"
    p = at + int.from_bytes(b[at + 4 : at + 8], order)
    if p < at + 8 or p + 2 > len(b):
        return 0
    n = int.from_bytes(b[p : p + 2], order)
    if not n or p + 6 + 12 * n > len(b):
        return 0
    kinds = [int.from_bytes(b[p + 4 + 12 * k : p + 6 + 12 * k], order) for k in range(n)]
    return len(b) - at if all(1 <= k <= 13 for k in kinds) else 0


def _mp4(b: bytes, at: int) -> int:
    """Boxes from ftyp on, with moov or moof and mdat among them; hit is 4 bytes in."""
    p, kinds = at, []
    while p + 8 <= len(b):
        n, kind = int.from_bytes(b[p : p + 4], "big"), b[p + 4 : p + 8]
        if n == 1 and p + 16 <= len(b):
            n = int.from_bytes(b[p + 8 : p + 16], "big")
        if n < 8 or p + n > len(b) or not kind.isalnum():
            break
        kinds.append(kind)
        p += n
    return p - at if kinds[:1] == [b"ftyp"] and {b"mdat", b"moov", b"moof", b"meta"} & set(kinds) else 0


#: Magic bytes, how far they lie inside the format, MIME type, validator. Public format facts.
SIGNATURES: list[tuple[bytes, int, str, Callable[[bytes, int], int]]] = [
    (b"\x89PNG\r\n\x1a\n", 0, "image/png", _png),
    (b"GIF87a", 0, "image/gif", _gif),
    (b"GIF89a", 0, "image/gif", _gif),
    (b"\xff\xd8\xff", 0, "image/jpeg", _jpeg),
    (b"BM", 0, "image/bmp", _bmp),
    (b"RIFF", 0, "riff", _riff),
    (b"\x1f\x8b\x08", 0, "application/gzip", _gzip),
    (b"PK\x03\x04", 0, "application/zip", _zip),
    (b"%PDF-", 0, "application/pdf", _pdf),
    (b"OggS", 0, "audio/ogg", _ogg),
    (b"fLaC", 0, "audio/flac", _flac),
    (b"II*\x00", 0, "image/tiff", _tiff),
    (b"MM\x00*", 0, "image/tiff", _tiff),
    (b"ftyp", 4, "video/mp4", _mp4),
]
_FORMS = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/x-msvideo"}
OPAQUE = "application/octet-stream"


def automaton() -> ahocorasick.Automaton:
    """All magic bytes in one automaton; bytes stand as code points 0 to 255."""
    found = ahocorasick.Automaton()
    for k, (magic, *_rest) in enumerate(SIGNATURES):
        found.add_word(magic.decode("latin-1"), k)
    found.make_automaton()
    return found


def sniff(blob: bytes, hits: ahocorasick.Automaton) -> tuple[str, int, list[tuple[int, int, str]]]:
    """Type and length of the blob, and the media embedded behind its start.

    The type is ``application/octet-stream`` and the length the blob's where nothing
    validates at the start. An embedded hit must lie outside media carved before it.
    """
    kind, length, carved, free = OPAQUE, len(blob), [], 1
    for end, k in hits.iter(blob.decode("latin-1")):
        magic, inset, mime, valid = SIGNATURES[k]
        at = end - len(magic) + 1 - inset
        if at < 0 or (0 < at < free):
            continue
        if n := valid(blob, at):
            mime = _FORMS.get(blob[at + 8 : at + 12], mime) if mime == "riff" else mime
            if at == 0:
                kind, length = mime, n
            else:
                carved.append((at, n, mime))
                free = at + n
    return kind, length, carved


def wav(samples: bytes, rate: int = WAV_RATE) -> bytes:
    """8-bit mono PCM; the samples stand in the data chunk unchanged."""
    odd = len(samples) & 1
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + odd, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples + b"\0" * odd


def wav_samples(blob: bytes) -> tuple[bytes, int, int, int]:
    """Samples, rate, channels and bits of a validated WAV blob."""
    p, fmt = 12, (0, 0, 0)
    while p + 8 <= len(blob):
        size = int.from_bytes(blob[p + 4 : p + 8], "little")
        if blob[p : p + 4] == b"fmt ":
            _, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", blob, p + 8)
            fmt = rate, channels, bits
        if blob[p : p + 4] == b"data":
            return blob[p + 8 : p + 8 + size], *fmt
        p += 8 + size + (size & 1)
    return b"", *fmt


def sniff_media(df: DataFrame, id_col: str, blob_col: str, declared_col: str | None = None) -> DataFrame:
    """Sniffed type, corrected declaration and carved media of each blob.

    Returns ``id, declared, sniffed, corrected, length, n_bytes, carved`` with carved an
    array of (at, length, type). Null blobs: all but id and declared null, carved empty.
    Empty blobs are ``application/octet-stream`` of length 0. A null declaration counts as
    corrected where anything was recognised. One row per input row, repeated rows too;
    nulls in `id_col` are kept, further columns are ignored.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = automaton()
        for batch in batches:
            rows = []
            for declared, blob in zip(batch[1].to_pylist(), batch[2].to_pylist(), strict=True):
                if blob is None:
                    rows.append((declared, None, None, None, None, []))
                    continue
                found, length, carved = sniff(blob, hits)
                fixed = found != OPAQUE and found != declared
                rows.append((declared, found, fixed, length, len(blob), [{"at": a, "length": n, "type": t} for a, n, t in carved]))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            types = [pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.struct([("at", pa.int64()), ("length", pa.int64()), ("type", pa.string())]))]
            names = ["id", "declared", "sniffed", "corrected", "length", "n_bytes", "carved"]
            yield pa.RecordBatch.from_arrays([batch[0], *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names)

    source = df.select(F.col(id_col).alias("id"), (F.col(declared_col) if declared_col else F.lit(None)).cast("string").alias("declared"), F.col(blob_col).cast("binary").alias("blob"))
    return source.mapInArrow(run, f"id {kind}, declared string, sniffed string, corrected boolean, length long, n_bytes long, carved array<struct<at:long,length:long,type:string>>")


def text_as_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared: str = OPAQUE) -> DataFrame:
    """Each text stored as a WAV of 8-bit samples, sniffed, validated and read back.

    The UTF-8 bytes are padded with spaces to a positive multiple of 192 and become the
    samples. The stored bytes go through `sniff`; only what its validator accepts is read
    back. Columns: ``id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature, media_type, corrected, n_carved, mean_sample, zero_crossings``.

    Null and empty texts store 192 spaces with n_bytes 0; null ids stay null; equal texts
    give equal values; repeated rows give repeated results. Further columns are ignored.
    """
    kind = df.schema[id_col].dataType.simpleString()
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media_type", "corrected", "n_carved", "mean_sample", "zero_crossings"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.float64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = automaton()
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                rows = [_stored((t.as_buffer().to_pybytes() if t.is_valid else b""), hits, declared) for t in part[1]]
                cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part[0], *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names)

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_type string, corrected boolean, n_carved int, mean_sample double, zero_crossings long")


def _stored(body: bytes, hits: ahocorasick.Automaton, declared: str) -> tuple:
    media = wav(body + b" " * (-len(body) % PAD or (0 if body else PAD)))
    found, length, carved = sniff(media, hits)
    payload, rate, channels, bits = wav_samples(media[:length])
    samples = np.frombuffer(payload, np.uint8)
    above = samples >= 128
    mean, crossings = float(samples.mean()), int((above[1:] != above[:-1]).sum())
    feature = f"{found};pcm_u{bits};rate={rate};channels={channels};samples={len(payload)};mean={mean:.3f};crossings={crossings};carved={len(carved)}"
    return len(body), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, found, found != declared, len(carved), mean, crossings


def op1_media_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return text_as_media(docs).withColumnRenamed("id", "doc_id")
