"""Signature sniffing of media columns: find magic bytes, confirm structure and lengths, correct types, carve what is embedded.

An Aho-Corasick automaton over all magic strings and end marks locates candidates at any offset, and where media may
end, in one pass; the validator of a candidate's format then walks its structure (chunk lengths, checksums) and looks
its end up among the marks, so repeated magic bytes cost no search each. Only confirmed media count, so text that
happens to hold a magic string stays text. A confirmed medium at offset 0 corrects the declared type; the others are
carved. Media inside a confirmed medium are reported with it, not on their own. A PDF goes on over the sections that
were added to it, a gzip file over all its members.

Formats: WAV, PNG, GIF, JPEG, BMP, PDF, gzip, ZIP. Defined results: a null or empty value has the type
`application/x-empty` and carves nothing; values may be of any length that a row can hold; of candidates at one place
the first in the list of magic bytes that holds counts; repeated rows are returned as often as they come, equal bytes
with equal results; a null key or doc_id stays null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from bisect import bisect_left
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The formats' magic bytes with their types.
MAGIC = [
    (b"RIFF", "audio/wav"),
    (b"\x89PNG\r\n\x1a\n", "image/png"),
    (b"GIF87a", "image/gif"),
    (b"GIF89a", "image/gif"),
    (b"\xff\xd8\xff", "image/jpeg"),
    (b"BM", "image/bmp"),
    (b"%PDF-", "application/pdf"),
    (b"\x1f\x8b\x08", "application/gzip"),
    (b"PK\x03\x04", "application/zip"),
]
#: The marks at which media end, or that must stand before their end.
JPEG_END, PDF_END, PDF_TABLE, PDF_START, ZIP_END = b"\xff\xd9", b"%%EOF", b"startxref", b"%PDF-", b"PK\x05\x06"
EMPTY, UNKNOWN, TEXT = "application/x-empty", "application/octet-stream", "text/plain"


def _times(x: int, y: int) -> int:
    """The product of two polynomials over two elements, lowest power in the highest bit, by the checksum's modulus."""
    product = 0
    for bit in range(31, -1, -1):
        if x >> bit & 1:
            product ^= y
        y = y >> 1 ^ (0xEDB88320 if y & 1 else 0)
    return product


#: The powers 8, 16, 32, ... of the variable: what 1, 2, 4, ... zero bytes do to a checksum.
_ZEROS = [1 << 23]
for _ in range(40):
    _ZEROS.append(_times(_ZEROS[-1], _ZEROS[-1]))
CRC_STEP = 1 << 12


class Marks:
    """Where the marks stand in a value, and what was found out about it on the way."""

    def __init__(self, b: bytes, places: dict[bytes, list[int]]):
        self.places, self.b = places, b
        self.ends: dict[str, dict[int, int | None]] = {}  # of chains of blocks, from each of their places
        self.sums: list[int] = [0]  # checksums of the first 0, 1, 2, ... steps
        self.archives: dict[int, int] = {}  # where a ZIP archive would begin -> its end, from each end record
        for end in places[ZIP_END]:
            if end + 22 <= len(b):
                size, offset, note = struct.unpack_from("<IIH", b, end + 12)
                start = end - offset - size
                if start >= 0 and end + 22 + note <= len(b) and b[end - size : end - size + 4] == b"PK\x01\x02":
                    self.archives.setdefault(start, end + 22 + note)

    def walk(self, chain: str, at: int, step: Callable[[int], int | None]) -> int | None:
        """Where a chain of blocks ends: step gives a block's end, its complement if it is the last, None if it is none."""
        ends, path = self.ends.setdefault(chain, {}), []
        p: int | None = at
        while p is not None and p >= 0 and p not in ends:
            path.append(p)
            p = step(p)
        end = None if p is None else ~p if p < 0 else ends[p]
        for place in path:
            ends[place] = end
        return end

    def crc(self, start: int, end: int) -> int:
        """The CRC-32 of a range, from sums of the value's beginnings: no range is read over and over."""
        while len(self.sums) * CRC_STEP <= end:
            k = len(self.sums) - 1
            self.sums.append(zlib.crc32(self.b[k * CRC_STEP : (k + 1) * CRC_STEP], self.sums[k]))

        def upto(p: int) -> int:
            return zlib.crc32(self.b[p - p % CRC_STEP : p], self.sums[p // CRC_STEP])

        if end - start <= 2 * CRC_STEP:
            return zlib.crc32(self.b[start:end])
        moved, n, k = upto(start), end - start, 0
        while n:
            if n & 1:
                moved = _times(_ZEROS[k], moved)
            n, k = n >> 1, k + 1
        return upto(end) ^ moved

    def after(self, mark: bytes, at: int) -> int | None:
        found = self.places[mark]
        i = bisect_left(found, at)
        return found[i] if i < len(found) else None


def wav(b: bytes, at: int, marks: Marks) -> int | None:
    """The length of the medium at `at`, None if its structure does not hold; so in all validators."""
    if len(b) < at + 12 or b[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > len(b):
        return None
    p, seen = at + 12, set()
    while p + 8 <= end:
        name, size = b[p : p + 4], struct.unpack_from("<I", b, p + 4)[0]
        if p + 8 + size > end or (name == b"fmt " and size < 16) or (name == b"data" and b"fmt " not in seen):
            return None
        seen.add(name)
        p += 8 + size + size % 2
    return end - at if p in (end, end + 1) and b"data" in seen else None


def png(b: bytes, at: int, marks: Marks) -> int | None:
    """A header of 13 bytes, then chunks with right checksums up to the last; chunks that candidates share are walked once."""
    if b[at + 8 : at + 16] != b"\x00\x00\x00\rIHDR":
        return None

    def step(p: int) -> int | None:
        if p + 12 > len(b):
            return None
        size, name = struct.unpack_from(">I4s", b, p)
        if p + 12 + size > len(b) or (p == at + 8) != (name == b"IHDR"):
            return None
        if marks.crc(p + 4, p + 8 + size) != struct.unpack_from(">I", b, p + 8 + size)[0]:
            return None
        return ~(p + 12 + size) if name == b"IEND" else p + 12 + size

    end = marks.walk("png", at + 8, step)
    return None if end is None else end - at


def gif(b: bytes, at: int, marks: Marks) -> int | None:
    """A header, then extensions and images of sub-blocks up to the trailer; each place is walked once, whoever comes by."""
    if len(b) < at + 13:
        return None
    flags = b[at + 10]

    def sub_block(p: int) -> int | None:
        return None if p >= len(b) else p + 1 + b[p] if b[p] else ~(p + 1)

    def block(p: int) -> int | None:
        if p >= len(b):
            return None
        kind = b[p]
        if kind == 0x3B:
            return ~(p + 1)
        if kind == 0x21:
            return marks.walk("sub-blocks", p + 2, sub_block)
        if kind == 0x2C and p + 10 <= len(b):
            local = b[p + 9]
            return marks.walk("sub-blocks", p + 11 + (3 << (local & 7) + 1 if local & 0x80 else 0), sub_block)
        return None

    end = marks.walk("gif", at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0), block)
    return None if end is None else end - at


def jpeg(b: bytes, at: int, marks: Marks) -> int | None:
    p = at + 2
    while p + 4 <= len(b) and b[p] == 0xFF:
        kind, size = b[p + 1], struct.unpack_from(">H", b, p + 2)[0]
        if size < 2:
            return None
        p += 2 + size
        if kind == 0xDA:  # entropy-coded data up to the end mark
            end = marks.after(JPEG_END, p)
            return None if end is None else end + 2 - at
    return None


def bmp(b: bytes, at: int, marks: Marks) -> int | None:
    if len(b) < at + 30:
        return None
    size, reserved, pixels, header = struct.unpack_from("<IIII", b, at + 2)
    planes, depth = struct.unpack_from("<HH", b, at + 26)
    fits = not reserved and header in (40, 52, 56, 108, 124) and 14 + header <= pixels <= size <= len(b) - at
    return size if fits and planes == 1 and depth in (1, 4, 8, 16, 24, 32) else None


def pdf(b: bytes, at: int, marks: Marks) -> int | None:
    table, last = marks.after(PDF_TABLE, at), None
    following = marks.after(PDF_START, at + 1)
    while table is not None and b[at + 5 : at + 6].isdigit():
        end = marks.after(PDF_END, table)
        if end is None or (last is not None and following is not None and following < end):
            break
        last = end
        table = marks.after(PDF_TABLE, end)
    return None if last is None else last + 5 - at


def member(b: bytes, at: int) -> int | None:
    """Where the gzip member at `at` ends."""
    stream, p = zlib.decompressobj(31), at
    try:
        while p < len(b) and not stream.eof:  # in small steps: the output is not kept
            piece = stream.unconsumed_tail or b[p : p + 65536]
            p += 0 if stream.unconsumed_tail else len(piece)
            stream.decompress(piece, 1 << 20)
        return p - len(stream.unused_data) if stream.eof else None
    except zlib.error:
        return None


def gzipped(b: bytes, at: int, marks: Marks) -> int | None:
    last, end = None, member(b, at)
    while end is not None:
        last = end
        end = member(b, last) if b[last : last + 3] == b"\x1f\x8b\x08" else None
    return None if last is None else last - at


def zipped(b: bytes, at: int, marks: Marks) -> int | None:
    end = marks.archives.get(at)
    return None if end is None else end - at


VALIDATE: dict[str, Callable[[bytes, int, Marks], int | None]] = {
    "audio/wav": wav,
    "image/png": png,
    "image/gif": gif,
    "image/jpeg": jpeg,
    "image/bmp": bmp,
    "application/pdf": pdf,
    "application/gzip": gzipped,
    "application/zip": zipped,
}


def sniffer() -> Callable[[bytes], list[tuple[str, int, int]]]:
    """bytes -> confirmed (type, start, length) by start, none inside another."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    ends = (JPEG_END, PDF_END, PDF_TABLE, PDF_START, ZIP_END)
    kinds = {m: [k for magic, k in MAGIC if magic == m] for m in {*(m for m, _ in MAGIC), *ends}}
    for mark, of in kinds.items():
        automaton.add_word(mark.decode("latin-1"), (mark, of))
    automaton.make_automaton()

    def sniff(data: bytes) -> list[tuple[str, int, int]]:
        places: dict[bytes, list[int]] = {m: [] for m in ends}
        candidates = []
        for last, (mark, of) in automaton.iter(data.decode("latin-1")):
            at = last + 1 - len(mark)
            candidates += [(at, kind) for kind in of]
            if mark in places:
                places[mark].append(at)
        found: list[tuple[str, int, int]] = []
        marks, free = Marks(data, places) if candidates else None, 0
        for at, kind in candidates:
            if at >= free and (length := VALIDATE[kind](data, at, marks)):
                found.append((kind, at, length))
                free = at + length
        return found

    return sniff


def is_text(data: bytes) -> bool:
    try:
        data.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return b"\x00" not in data


CARVED = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("bytes", pa.binary())]))
SNIFFED = "array<struct<kind:string,start:long,length:long,bytes:binary>>"


def sniff_column(df: DataFrame, key: str, data: str, declared: str | None = None) -> DataFrame:
    """key, declared, actual, corrected, carved of every row: the confirmed type and the media embedded in the value."""
    cols = [F.col(key).alias("key"), F.col(data).cast("binary").alias("data"), (F.col(declared).cast("string") if declared else F.lit(None).cast("string")).alias("declared")]
    kind = df.schema[key].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sniff = sniffer()
        for batch in batches:
            actual, carved = [], []
            for value in batch.column(1).to_pylist():
                found = sniff(value) if value else []
                whole = bool(found) and found[0][1] == 0
                actual.append(found[0][0] if whole else EMPTY if not value else TEXT if is_text(value) else UNKNOWN)
                carved.append([{"kind": k, "start": s, "length": n, "bytes": value[s : s + n]} for k, s, n in found[whole:]])
            corrected = [a != d for a, d in zip(actual, batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(actual, pa.string()), pa.array(corrected), pa.array(carved, CARVED)], names=["key", "declared", "actual", "corrected", "carved"])

    return df.select(*cols).mapInArrow(task, f"key {kind}, declared string, actual string, corrected boolean, carved {SNIFFED}")


def wav_of(payload: bytes, rate: int = 8000) -> bytes:
    """One channel of 8-bit samples that are the payload's bytes (of even number)."""
    return b"".join((b"RIFF", struct.pack("<I", 36 + len(payload)), b"WAVEfmt ", struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8), b"data", struct.pack("<I", len(payload)), payload))


def samples_of(medium: bytes) -> bytes:
    """The samples of a confirmed WAV, by walking its chunks."""
    p = 12
    while medium[p : p + 4] != b"data":
        size = struct.unpack_from("<I", medium, p + 4)[0]
        p += 8 + size + size % 2
    return medium[p + 8 : p + 8 + struct.unpack_from("<I", medium, p + 4)[0]]


STORED = "doc_id long, n_bytes long, media binary"


def store_texts(docs: DataFrame, block: int = 64) -> DataFrame:
    """Every text as UTF-8, filled with zero bytes up to a positive multiple of `block`, as a WAV of 8-bit samples."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [t.encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            media = [wav_of(r + bytes(max(block, -(-len(r) // block) * block) - len(r))) for r in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(task, STORED)


READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, declared string, actual string, n_carved long"


def read_back(stored: DataFrame, declared: str = UNKNOWN, tail: int = 64) -> DataFrame:
    """Sniff the stored bytes, correct the declared type, read the samples of the confirmed medium and describe them.

    feature: the confirmed type, the number of samples, the counts of samples below 32 and above 127, and the types of media within.
    """
    names = [c.split()[0] for c in READ.split(", ")]
    low, high = bytes(range(32)), bytes(range(128, 256))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sniff = sniffer()
        for batch in batches:
            rows = []
            for doc, n, medium in zip(*(batch.column(i).to_pylist() for i in range(3))):
                found = sniff(medium)
                if not found or found[0] != ("audio/wav", 0, len(medium)):
                    raise ValueError("the stored bytes are no whole WAV")
                payload = samples_of(medium)
                inner = sniff(payload)
                controls, upper = len(payload) - len(payload.translate(None, low)), len(payload) - len(payload.translate(None, high))
                feature = f"{found[0][0]};samples={len(payload)};control={controls};high={upper};embedded={','.join(k for k, _, _ in inner)}"
                rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-tail:]), len(medium), hashlib.sha256(medium).hexdigest(), feature, declared, found[0][0], len(inner)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string() if k in ("payload_sha256", "media_sha256", "feature", "declared", "actual") else pa.int64()) for k, x in zip(names, zip(*rows))], names=names)

    return stored.mapInArrow(task, READ)
