"""Media columns: signature sniffing with Aho-Corasick and structural validators.

One automaton finds every magic byte string of a value in a single scan; a validator of
the format then walks its headers, chunk lengths and checksums. Only confirmed media
count: the one at offset 0 corrects the declared type, later ones are carved as
(offset, length, type). Work is per row inside Arrow batches, without a shuffle.

Texts are carried as media by :func:`store_texts`: UTF-8, zero bytes up to a positive
multiple of 64, as 8-bit samples of one of three formats that the payload's checksum
chooses: mono PCM in a WAV container, or rows of 64 grey pixels in a BMP or a PNG image.
The type that is declared with the value comes from another part of the checksum, as in a
feed with wrong labels; on reading, the sniffed type alone chooses the decoder. Media that
a text itself holds are carved from the samples.

Edge cases: null or empty text is 64 zero bytes. Null content has null results, empty
content is ``application/octet-stream`` of length 0. An unknown or broken value keeps
its declared type (null: ``application/octet-stream``). Equal values give equal rows;
extra columns pass through :func:`sniff_media`.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwork.llm.common import arrow_batch, text_blocks

UNKNOWN = "application/octet-stream"

# ---------------------------------------------------------------- validators: length, or 0


def _riff(d: bytes, at: int) -> int:
    if len(d) < at + 12:
        return 0
    size = struct.unpack_from("<I", d, at + 4)[0] + 8
    return size if size >= 12 and at + size <= len(d) else 0


def _wav(d: bytes, at: int) -> int:
    end = at + _riff(d, at)
    if end == at or d[at + 8 : at + 12] != b"WAVE":
        return 0
    pos, seen = at + 12, set()
    while pos + 8 <= end:
        seen.add(d[pos : pos + 4])
        pos += 8 + struct.unpack_from("<I", d, pos + 4)[0]
        pos += pos & 1 if at % 2 == 0 else 0
    return end - at if {b"fmt ", b"data"} <= seen and pos in (end, end + 1) else 0


def _webp(d: bytes, at: int) -> int:
    return _riff(d, at) if d[at + 8 : at + 12] == b"WEBP" and d[at + 12 : at + 15] == b"VP8" else 0


def _avi(d: bytes, at: int) -> int:
    return _riff(d, at) if d[at + 8 : at + 12] == b"AVI " and d[at + 12 : at + 16] == b"LIST" else 0


def _png(d: bytes, at: int) -> int:
    pos, first = at + 8, True
    while pos + 12 <= len(d):
        size, kind = struct.unpack_from(">I4s", d, pos)
        if pos + 12 + size > len(d) or first != (kind == b"IHDR"):
            return 0
        if zlib.crc32(d[pos + 4 : pos + 8 + size]) != struct.unpack_from(">I", d, pos + 8 + size)[0]:
            return 0
        pos, first = pos + 12 + size, False
        if kind == b"IEND":
            return pos - at
    return 0


def _gif(d: bytes, at: int, walks: dict) -> int:
    ends, stops = walks.setdefault("gif blocks", {}), walks.setdefault("gif", {})  # what an earlier walk met from a place on, a later one meets too

    def blocks(pos: int) -> int:
        passed = []
        while pos < len(d) and d[pos] and pos not in ends:
            passed.append(pos)
            pos += d[pos] + 1
        end = ends.get(pos, pos + 1)
        ends.update(dict.fromkeys(passed, end))
        return end

    if len(d) < at + 13:
        return 0
    flags = d[at + 10]
    pos = at + 13 + (3 << (flags & 7) + 1 if flags & 128 else 0)
    passed, stop = [], 0
    while pos < len(d):
        if pos in stops:
            stop = stops[pos]
            break
        passed.append(pos)
        if d[pos] == 0x3B:
            stop = pos + 1
            break
        if d[pos] == 0x21:
            pos = blocks(pos + 2)
        elif d[pos] == 0x2C and pos + 10 < len(d):
            local = d[pos + 9]
            pos = blocks(pos + 10 + (3 << (local & 7) + 1 if local & 128 else 0) + 1)
        else:
            break
    stops.update(dict.fromkeys(passed, stop))
    return stop - at if stop else 0


def _jpeg(d: bytes, at: int, walks: dict) -> int:
    stops = walks.setdefault("jpeg", {})
    pos, passed, stop = at + 2, [], 0
    while pos + 4 <= len(d) and d[pos] == 0xFF:
        if pos in stops:
            stop = stops[pos]
            break
        passed.append(pos)
        if d[pos + 1] == 0xDA:  # entropy-coded data up to the end marker
            asked, end = walks.get("jpeg end", (len(d) + 1, -1))
            if not (asked <= pos and (end < 0 or end >= pos)):
                end = d.find(b"\xff\xd9", pos)
                walks["jpeg end"] = (pos, end)
            stop = end + 2 if end >= 0 else 0
            break
        pos += 2 + struct.unpack_from(">H", d, pos + 2)[0]
    stops.update(dict.fromkeys(passed, stop))
    return stop - at if stop else 0


def _bmp(d: bytes, at: int) -> int:
    if len(d) < at + 26:
        return 0
    size, zero, start, header = struct.unpack_from("<IIII", d, at + 2)
    return size if zero == 0 and header in (12, 40, 52, 56, 108, 124) and 26 <= start <= size and at + size <= len(d) else 0


def _pdf(d: bytes, at: int) -> int:
    if len(d) < at + 8 or not (d[at + 5 : at + 6].isdigit() and d[at + 6 : at + 7] == b"."):
        return 0
    # Updates are appended with an end mark of their own, so the last mark before the next file counts.
    following = d.find(b"%PDF-", at + 5)
    limit = following if following >= 0 else len(d)
    end = d.rfind(b"%%EOF", at, limit)
    return end + 5 - at if end >= 0 and d.find(b"startxref", at, end) >= 0 else 0


def _zip(d: bytes, at: int, walks: dict) -> int:
    if "zip" not in walks:  # of every end record once: where its archive begins, and where that ends
        stops = walks["zip"] = {}
        end = d.find(b"PK\x05\x06")
        while 0 <= end <= len(d) - 22:
            size, start, comment = struct.unpack_from("<IIH", d, end + 12)
            if end + 22 + comment <= len(d):
                stops.setdefault(end - size - start, end + 22 + comment)
            end = d.find(b"PK\x05\x06", end + 4)
    stop = walks["zip"].get(at, 0) if len(d) >= at + 30 else 0
    return stop - at if stop else 0


def _gzip(d: bytes, at: int) -> int:
    work, rest = zlib.decompressobj(31), d[at:]
    try:
        while not work.eof and rest:  # checked to its end, a piece of the output at a time
            work.decompress(rest, 1 << 20)
            rest = work.unconsumed_tail
        while not work.eof and work.decompress(b"", 1 << 20):
            pass
    except zlib.error:
        return 0
    return len(d) - at - len(work.unused_data) if work.eof else 0


def _ogg(d: bytes, at: int) -> int:
    pos = at
    while d[pos : pos + 4] == b"OggS" and pos + 27 <= len(d):
        table = d[pos + 27 : pos + 27 + d[pos + 26]]
        last, size = d[pos + 5] & 4, 27 + len(table) + sum(table)
        if d[pos + 4] or len(table) < d[pos + 26] or pos + size > len(d):
            return 0
        pos += size
        if last:
            return pos - at
    return 0


def _flac(d: bytes, at: int) -> int:
    pos = at + 4
    while pos + 4 <= len(d):
        last, kind, size = d[pos] >> 7, d[pos] & 127, int.from_bytes(d[pos + 1 : pos + 4], "big")
        if pos == at + 4 and (kind, size) != (0, 34) or pos + 4 + size > len(d):
            return 0
        pos += 4 + size
        if last:
            return len(d) - at if d[pos : pos + 1] == b"\xff" else 0
    return 0


#: magic bytes, type, validator
SIGNATURES = [
    (b"RIFF", "audio/wav", _wav),
    (b"RIFF", "image/webp", _webp),
    (b"RIFF", "video/x-msvideo", _avi),
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"BM", "image/bmp", _bmp),
    (b"%PDF-", "application/pdf", _pdf),
    (b"PK\x03\x04", "application/zip", _zip),
    (b"\x1f\x8b\x08", "application/gzip", _gzip),
    (b"OggS", "audio/ogg", _ogg),
    (b"fLaC", "audio/flac", _flac),
]


_WALKERS = (_gif, _jpeg, _zip)  # remember what they met in a value, so that many beginnings cost no more than one


def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for magic in dict.fromkeys(s[0] for s in SIGNATURES):
        out.add_word(magic.decode("latin-1"), magic)
    out.make_automaton()
    return out


def sniff(finder: ahocorasick.Automaton, data: bytes, only_first: bool = False) -> list[tuple[int, int, str]]:
    """Confirmed media (offset, length, type), leftmost first; or just the one at offset 0.

    Carving does not restart inside a confirmed medium, except that a container at
    offset 0 that fills the value is looked into.
    """
    found, free, walks = [], 0, {}
    for end, magic in finder.iter(data.decode("latin-1")):
        at = end + 1 - len(magic)
        if only_first and (at or found):
            break
        if at < free:
            continue
        for known, kind, check in SIGNATURES:
            if known == magic and (size := check(data, at, walks) if check in _WALKERS else check(data, at)):
                found.append((at, size, kind))
                free = at + size if at or size < len(data) else 0
                break
    return found


# ---------------------------------------------------------------- texts as 8-bit samples

WIDTH = 64  # pixels a row; payloads are whole rows


def to_wav(payload: bytes, rate: int = 8000) -> bytes:
    """8-bit mono PCM; the payload has an even length."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload)) + payload


def from_wav(stored: bytes) -> bytes:
    """The samples of a WAV file, by walking its chunks."""
    pos = 12
    while stored[pos : pos + 4] != b"data":
        pos += 8 + struct.unpack_from("<I", stored, pos + 4)[0]
    size = struct.unpack_from("<I", stored, pos + 4)[0]
    return stored[pos + 8 : pos + 8 + size]


_GREYS = b"".join(bytes([g, g, g, 0]) for g in range(256))


def to_bmp(payload: bytes) -> bytes:
    """8-bit grey pixels, top row first."""
    head = 14 + 40 + len(_GREYS)
    file = struct.pack("<2sIII", b"BM", head + len(payload), 0, head)
    info = struct.pack("<IiiHHIIiiII", 40, WIDTH, -(len(payload) // WIDTH), 1, 8, 0, len(payload), 2835, 2835, 256, 256)
    return file + info + _GREYS + payload


def from_bmp(stored: bytes) -> bytes:
    size, _, start = struct.unpack_from("<III", stored, 2)
    width, height = struct.unpack_from("<ii", stored, 18)
    if (width, height >= 0, stored[54 : 54 + len(_GREYS)] != _GREYS) != (WIDTH, False, False):
        raise ValueError("not a grey image of this width, top row first")
    return stored[start:size]


def to_png(payload: bytes) -> bytes:
    """8-bit grey pixels; every row is stored as it is."""
    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    plain = np.hstack([np.zeros((len(rows), 1), np.uint8), rows]).tobytes()
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(plain, 1)) + chunk(b"IEND", b"")


def from_png(stored: bytes) -> bytes:
    """The pixels of a grey image whose rows are unfiltered."""
    pos, data, width = 8, [], 0
    while pos + 12 <= len(stored):
        size, kind = struct.unpack_from(">I4s", stored, pos)
        if kind == b"IHDR":
            width = struct.unpack_from(">I", stored, pos + 8)[0]
        elif kind == b"IDAT":
            data.append(stored[pos + 8 : pos + 8 + size])
        pos += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, width + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].tobytes()


#: type, writer, reader; the payload's checksum chooses the form and, by itself, the declared type
FORMS = [("audio/wav", to_wav, from_wav), ("image/bmp", to_bmp, from_bmp), ("image/png", to_png, from_png)]
DECLARED = ("audio/wav", "image/bmp", "image/png", UNKNOWN, "text/plain")


def stored_form(payload: bytes) -> tuple[bytes, str]:
    """(media, declared type) of a payload."""
    check = zlib.crc32(payload)
    return FORMS[check % len(FORMS)][1](payload), DECLARED[check // len(FORMS) % len(DECLARED)]


def read_back(finder: ahocorasick.Automaton, stored: bytes) -> tuple[bytes, str]:
    """(samples, type) of a stored value; nothing but its bytes tells the type."""
    kind = next((k for _, _, k in sniff(finder, stored, only_first=True)), UNKNOWN)
    reader = {k: read for k, _, read in FORMS}.get(kind)
    if reader is None:
        raise ValueError(f"no reader for {kind}")
    return reader(stored), kind


def features(finder: ahocorasick.Automaton, samples: bytes, kind: str, declared: str) -> str:
    """Types, and statistics of the samples around the 8-bit midpoint; media inside them are carved."""
    x = np.frombuffer(samples, dtype=np.uint8)
    signs = x >= 128
    carved = "+".join(f"{k}@{at}:{n}" for at, n, k in sniff(finder, samples)) or "none"
    return f"type={kind};declared={declared};corrected={int(kind != declared)};samples={len(x)};sum={int(x.sum(dtype=np.int64))};peak={int(x.max(initial=0))};crossings={int(np.count_nonzero(signs[1:] != signs[:-1]))};carved={carved}"


_STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("mime", pa.string())])
_READ = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()),
    ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()),
])


def _stored(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes, str]]:
    for first, end, offsets, data in text_blocks(batch):
        raw = data.tobytes()
        for i in range(end - first):
            text = raw[offsets[i] : offsets[i + 1]]
            yield len(text), *stored_form(text + bytes(-len(text) % 64 if text else 64))


def _store_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = list(_stored(batch))
        yield arrow_batch(_STORED, [batch.column(0), *([r[i] for r in rows] for i in range(3))])


def _read_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    finder = automaton()
    for batch in batches:
        rows = []
        for n, stored, declared in _stored(batch):
            back, kind = read_back(finder, stored)
            rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), features(finder, back, kind, declared)))
        yield arrow_batch(_READ, [batch.column(0), *([r[i] for r in rows] for i in range(7))])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media, mime): every text as a media value and its declared type."""
    return _texts(docs).mapInArrow(_store_pass, "doc_id long, n_bytes long, media binary, mime string")


def text_media_report(docs: DataFrame) -> DataFrame:
    """Store every text, read it back, and report digests, lengths and features."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return _texts(docs).mapInArrow(_read_pass, schema)


def sniff_media(df: DataFrame, content: str = "content", declared: str = "mime") -> DataFrame:
    """``df`` with media_type (the declared one, corrected), corrected and carved."""
    plain = df.drop("media_type", "corrected", "carved")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = automaton()
        kind = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string())]))
        for batch in batches:
            types, fixed, carved = [], [], []
            for value, said in zip(batch.column(content), batch.column(declared).to_pylist(), strict=True):
                if not value.is_valid:
                    types.append(said), fixed.append(None), carved.append(None)
                    continue
                found = sniff(finder, value.as_buffer().to_pybytes())
                real = next((k for at, _, k in found if at == 0), said or UNKNOWN)
                types.append(real), fixed.append(real != said)
                carved.append([{"offset": at, "length": n, "type": k} for at, n, k in found if at])
            new = [pa.array(types, pa.string()), pa.array(fixed, pa.bool_()), pa.array(carved, kind)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "media_type", "corrected", "carved"])

    part = T.StructType().add("offset", "long").add("length", "long").add("type", "string")
    schema = T.StructType([*plain.schema.fields]).add("media_type", "string").add("corrected", "boolean").add("carved", T.ArrayType(part))
    return plain.mapInArrow(run, schema)
