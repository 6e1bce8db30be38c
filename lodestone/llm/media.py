"""Media columns: signature sniffing with Aho-Corasick and structural validators.

One pass of an automaton over the bytes finds every magic number; the validator of its format then walks the
structure (chunk lengths, checksums, trailers) and gives the length, or rejects the place. What stands at the start
decides the type, whatever was declared; valid media further in are carved, unless they lie inside one already carved
at that level.

Marks that end a format (a zip's end record, a pdf's startxref, a jpeg's markers) are found once for all places and
looked up from each, so that many magic numbers in one long value do not each read on to its end.

Nulls and edge cases: null or empty media have the type null and nothing carved. Truncated or damaged media are
rejected and keep `application/octet-stream`. A very long value is walked whole. Where two formats start at one place
the one that is valid counts. Repeated rows get the same result each; an empty table gives no rows. All columns pass
through; `sniffed` is added, in place of a column of that name.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import column, texts_of, with_struct

UNKNOWN = "application/octet-stream"


class Marks:
    """Places in a value that several validators ask for; each kind is looked for once, when first asked for."""

    def __init__(self, b: bytes) -> None:
        self.b, self.held = b, {}

    def of(self, mark: bytes) -> list[int]:
        if mark not in self.held:
            self.held[mark] = [m.start() for m in re.finditer(re.escape(mark), self.b)]
        return self.held[mark]

    def after(self, mark: bytes, at: int) -> int:
        """The first place of the mark from `at` on, or -1."""
        places = self.of(mark)
        k = bisect_left(places, at)
        return places[k] if k < len(places) else -1

    def marker(self, at: int) -> int:
        """The first 0xFF from `at` on that is no stuffed or restart byte of a jpeg's scan, or -1."""
        if "jpeg" not in self.held:
            a = np.frombuffer(self.b, np.uint8)
            this, after = a[:-1], a[1:]
            self.held["jpeg"] = np.flatnonzero((this == 0xFF) & (after != 0) & ((after < 0xD0) | (after > 0xD7)))
        places = self.held["jpeg"]
        k = int(np.searchsorted(places, at))
        return int(places[k]) if k < len(places) else -1

    def archives(self) -> dict[int, int]:
        """Where zip archives start, by their end records, and the first such record's place."""
        if "zip" not in self.held:
            found: dict[int, int] = {}
            for end in self.of(b"PK\x05\x06"):
                if end + 22 <= len(self.b):
                    size, start = _u32(self.b, end + 12), _u32(self.b, end + 16)
                    if end >= size + start and self.b[end - size : end - size + 4] == b"PK\x01\x02":
                        found.setdefault(end - size - start, end)
            self.held["zip"] = found
        return self.held["zip"]


def _u32(b: bytes, at: int) -> int:
    return struct.unpack_from("<I", b, at)[0]


def png(b: bytes, at: int, marks: Marks) -> int:
    """Length, or 0 if it is none: chunks with right checksums, IHDR first, to IEND."""
    p = at + 8
    while p + 12 <= len(b):
        n = struct.unpack_from(">I", b, p)[0]
        if p + 12 + n > len(b) or (p == at + 8) != (b[p + 4 : p + 8] == b"IHDR") or p == at + 8 and n != 13:
            return 0
        if zlib.crc32(memoryview(b)[p + 4 : p + 8 + n]) != struct.unpack_from(">I", b, p + 8 + n)[0]:
            return 0
        if b[p + 4 : p + 8] == b"IEND":
            return p + 12 + n - at
        p += 12 + n
    return 0


def gif(b: bytes, at: int, marks: Marks) -> int:
    """Screen, colour tables and blocks to the trailer."""
    if at + 13 > len(b):
        return 0
    flags, p = b[at + 10], at + 13
    p += 3 << ((flags & 7) + 1) if flags & 0x80 else 0
    while p < len(b):
        if b[p] == 0x3B:
            return p + 1 - at
        if b[p] == 0x21:
            p += 2
        elif b[p] == 0x2C and p + 10 <= len(b):
            flags = b[p + 9]
            p += 10 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0) + 1
        else:
            return 0
        while p < len(b) and b[p]:
            p += b[p] + 1
        p += 1
    return 0


def jpeg(b: bytes, at: int, marks: Marks) -> int:
    """Marker segments, at least one scan, to the end marker."""
    p, scans = at + 2, 0
    while p + 4 <= len(b) and b[p] == 0xFF:
        marker = b[p + 1]
        if marker == 0xD9:
            return p + 2 - at if scans else 0
        if marker < 0xC0:
            return 0
        p += 2 + struct.unpack_from(">H", b, p + 2)[0]
        if marker == 0xDA:
            scans += 1
            if (p := marks.marker(p)) < 0:
                return 0
    return p + 2 - at if scans and b[p : p + 2] == b"\xff\xd9" else 0


def wav(b: bytes, at: int, marks: Marks) -> int:
    """RIFF size within the bytes, a fmt chunk before the data chunk, chunks that fill the size."""
    if at + 12 > len(b) or b[at + 8 : at + 12] != b"WAVE":
        return 0
    end, p, seen = at + 8 + _u32(b, at + 4), at + 12, []
    if end > len(b):
        return 0
    while p + 8 <= end:
        n = _u32(b, p + 4)
        seen.append(b[p : p + 4])
        p += 8 + n + (n & 1)
    return end - at if p == end and b"data" in seen and b"fmt " in seen[: seen.index(b"data")] else 0


def bmp(b: bytes, at: int, marks: Marks) -> int:
    """Sizes of file and header that agree."""
    if at + 26 > len(b):
        return 0
    n, start, header = _u32(b, at + 2), _u32(b, at + 10), _u32(b, at + 14)
    return n if header in (12, 40, 52, 56, 64, 108, 124) and 14 + header <= start <= n and at + n <= len(b) and not _u32(b, at + 6) else 0


def gz(b: bytes, at: int, marks: Marks) -> int:
    """A member that inflates with the right checksum; its output is thrown away piece by piece."""
    if at + 18 > len(b) or b[at + 2] != 8 or b[at + 3] & 0xE0:
        return 0
    d, p = zlib.decompressobj(31), at
    try:
        while not d.eof and p < len(b):
            piece = d.unconsumed_tail or b[p : p + 65536]
            p += 0 if d.unconsumed_tail else len(piece)
            d.decompress(piece, 1 << 20)
    except zlib.error:
        return 0
    return p - len(d.unused_data) - at if d.eof else 0


def zip_(b: bytes, at: int, marks: Marks) -> int:
    """A local header whose archive's end record points back to it."""
    end = marks.archives().get(at, -1)
    return min(len(b), end + 22 + struct.unpack_from("<H", b, end + 20)[0]) - at if end >= at else 0


def pdf(b: bytes, at: int, marks: Marks) -> int:
    """A version, a startxref and the end mark after it."""
    if at + 8 > len(b) or not b[at + 5 : at + 6].isdigit():
        return 0
    x = marks.after(b"startxref", at)
    end = marks.after(b"%%EOF", x) if x >= 0 else -1
    return end + 5 - at if end >= 0 else 0


#: Magic bytes of the formats, with their types and validators.
FORMATS = [
    (b"\x89PNG\r\n\x1a\n", "image/png", png), (b"GIF87a", "image/gif", gif), (b"GIF89a", "image/gif", gif),
    (b"\xff\xd8\xff", "image/jpeg", jpeg), (b"RIFF", "audio/wav", wav), (b"BM", "image/bmp", bmp),
    (b"\x1f\x8b", "application/gzip", gz), (b"PK\x03\x04", "application/zip", zip_), (b"%PDF-", "application/pdf", pdf),
]


class Sniffer:
    def __init__(self) -> None:
        self.automaton = ahocorasick.Automaton()
        for k, (magic, _, _) in enumerate(FORMATS):
            self.automaton.add_word(magic.decode("latin-1"), k)
        self.automaton.make_automaton()

    def sniff(self, b: bytes) -> tuple[str | None, int, list[tuple[int, int, str]]]:
        """Type and length of what stands at the start (its own, or unknown and all bytes), and (offset, length, type) of what is embedded."""
        if not b:
            return None, 0, []
        kind, size, carved, clear, marks = UNKNOWN, len(b), [], 0, Marks(b)
        for end, k in self.automaton.iter(b.decode("latin-1")):
            magic, name, validate = FORMATS[k]
            at = end + 1 - len(magic)
            if at and at < clear or not (n := validate(b, at, marks)):
                continue
            if at:
                carved.append((at, n, name))
                clear = at + n
            else:
                kind, size = name, n
        return kind, size, carved


FIELDS = [
    T.StructField("type", T.StringType()), T.StructField("length", T.LongType()), T.StructField("corrected", T.BooleanType()),
    T.StructField("carved", T.ArrayType(T.StructType([T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()), T.StructField("type", T.StringType())]))),
]
_CARVED = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string())]))


def sniff(df: DataFrame, media: str = "media", declared: str = "declared_type") -> DataFrame:
    """The rows with `sniffed`: the true type, its length, whether the declared type was wrong, and embedded media."""

    def factory():
        own = Sniffer()

        def make(batch: pa.RecordBatch) -> list[pa.Array]:
            found = [own.sniff(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in column(batch, media).cast(pa.large_binary())]
            said = column(batch, declared).to_pylist()
            carved = [[{"offset": o, "length": n, "type": t} for o, n, t in c] for _, _, c in found]
            return [
                pa.array([k for k, _, _ in found], pa.string()), pa.array([n for _, n, _ in found], pa.int64()),
                pa.array([k is not None and k != s for (k, _, _), s in zip(found, said)], pa.bool_()), pa.array(carved, _CARVED),
            ]

        return make

    return with_struct(df, "sniffed", FIELDS, factory)


RATE = 8000


def to_wav(payload: bytes) -> bytes:
    """Samples of 8 bits, one channel."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload)) + payload


def wav_data(b: bytes) -> bytes:
    """The samples of a valid file."""
    p = 12
    while b[p : p + 4] != b"data":
        n = _u32(b, p + 4)
        p += 8 + n + (n & 1)
    return b[p + 8 : p + 8 + _u32(b, p + 4)]


def as_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (each whole text padded with zeros to a multiple of 64, as WAV) and the declared type, which is right for an even number of bytes and says nothing else."""

    def run(batches):
        for batch in batches:
            texts, ids = texts_of(batch).cast(pa.large_binary()), column(batch, "doc_id")
            step = max(1, 2_000_000 * len(texts) // max(1, texts.nbytes))
            for i in range(0, len(texts), step):
                raw = [x.as_buffer().to_pybytes() for x in texts[i : i + step]]
                media = [to_wav(x + bytes(-len(x) % 64 or (0 if x else 64))) for x in raw]
                yield pa.RecordBatch.from_arrays(
                    [ids[i : i + step], pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary()), pa.array([UNKNOWN if len(x) % 2 else "audio/wav" for x in raw], pa.string())],
                    names=["doc_id", "n_bytes", "media", "declared_type"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary, declared_type string")


MEASURES = [
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()),
    T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType()),
]


def measure(df: DataFrame) -> DataFrame:
    """Sniffed media with `measured`: digests of the payload as read back, and features of its samples."""

    def factory():
        def make(batch: pa.RecordBatch) -> list[pa.Array]:
            out: list[list] = [[] for _ in MEASURES]
            for x, s in zip(column(batch, "media"), column(batch, "sniffed").to_pylist()):
                stored = x.as_buffer().to_pybytes()
                payload = wav_data(stored[: s["length"]]) if s["type"] == "audio/wav" else b""
                samples = np.frombuffer(payload, np.uint8)
                crossings = int(np.count_nonzero((samples[1:] >= 128) != (samples[:-1] >= 128)))
                carved = ",".join(f"{c['type']}@{c['offset']}+{c['length']}" for c in s["carved"])
                feature = f"{s['type']};declared_wrong={int(s['corrected'])};samples={len(samples)};sum={int(samples.sum(dtype=np.int64))};crossings={crossings};carved=[{carved}]"
                for held, value in zip(out, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature)):
                    held.append(value)
            return [pa.array(v, pa.string() if f.dataType == T.StringType() else pa.int64()) for v, f in zip(out, MEASURES)]

        return make

    return with_struct(df, "measured", MEASURES, factory)
