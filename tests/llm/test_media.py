import gzip
import hashlib
import io
import struct
import time
import zipfile
import zlib

import pytest

from rowparity.llm import media


def png() -> bytes:
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\x00\x00")) + chunk(b"IEND", b"")


def zipped() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello")
    return out.getvalue()


SAMPLES = {
    "audio/wav": media.wav_of(b"abcdef"),
    "image/png": png(),
    "image/gif": b"GIF89a\x01\x00\x01\x00\x80\x00\x00\x00\x00\x00\xff\xff\xff\x2c\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02\x44\x01\x00\x3b",
    "image/jpeg": b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x04cd" + b"data" + b"\xff\xd9",
    "image/bmp": b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\x00" * 4,
    "application/pdf": b"%PDF-1.4\n1 0 obj\nendobj\nstartxref\n9\n%%EOF",
    "application/gzip": gzip.compress(b"hello " * 100),
    "application/zip": zipped(),
}


@pytest.mark.parametrize("kind", SAMPLES)
def test_each_format_is_confirmed_and_carved(kind):
    sniff, data = media.sniffer(), SAMPLES[kind]
    assert sniff(data) == [(kind, 0, len(data))]
    assert sniff(b"text before " + data + b" and after") == [(kind, 12, len(data))]
    assert sniff(data[:-3]) == [] or kind == "application/pdf" and sniff(data[:-3]) == []
    assert all(k != kind for k, s, n in sniff(data[:6] + b"\xee" * 40))


def test_magic_strings_in_text_are_no_media():
    assert media.sniffer()(b"BM is RIFF GIF89a %PDF-1 PK\x03\x04 \xff\xd8\xff " * 20) == []


def test_several_media_and_none_inside_another():
    inner = SAMPLES["image/png"]
    outer = media.wav_of(inner + b"\x00" * (len(inner) % 2))
    assert [k for k, _, _ in media.sniffer()(outer + b"--" + inner)] == ["audio/wav", "image/png"]


def test_declared_types_are_corrected(spark):
    rows = [(1, SAMPLES["image/png"], "image/jpeg", "-"), (2, SAMPLES["image/gif"], "image/gif", "-"), (3, None, None, "-"), (4, b"", "x", "-"), (5, b"plain", "text/plain", "-"), (6, b"\x00\xfe", None, "-"), (6, b"see " + SAMPLES["image/gif"], "text/plain", "-")]
    out = media.sniff_column(spark.createDataFrame(rows, "id long, data binary, kind string, key string"), "id", "data", "kind")
    got = [(r["key"], r["actual"], r["corrected"], [c["kind"] for c in r["carved"]]) for r in out.collect()]
    assert got == [(1, "image/png", True, []), (2, "image/gif", False, []), (3, media.EMPTY, True, []), (4, media.EMPTY, True, []), (5, "text/plain", False, []), (6, media.UNKNOWN, True, []), (6, media.UNKNOWN, True, ["image/gif"])]
    assert out.where("key = 6").collect()[1]["carved"][0]["bytes"] == SAMPLES["image/gif"]


def test_round_trip(documents, odd_rows):
    rows = odd_rows + [(30, "x" * 64), (31, "x" * 65)]
    stored = media.store_texts(documents(rows))
    got = sorted((tuple(r)[:7] for r in media.read_back(stored).collect()), key=str)
    expected = []
    for i, t in rows:
        raw = (t or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        kept = media.wav_of(payload)
        expected.append((i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(kept), hashlib.sha256(kept).hexdigest()))
    assert got == sorted(expected, key=str)
    import wave

    for r in stored.limit(3).collect():
        with wave.open(io.BytesIO(bytes(r["media"]))) as w:
            assert (w.getsampwidth(), w.getnchannels()) == (1, 1)
    assert media.read_back(media.store_texts(documents(rows).where("false"))).count() == 0


def test_broken_media_are_refused(spark):
    bad = spark.createDataFrame([(1, 3, SAMPLES["audio/wav"][:-1])], "doc_id long, n_bytes long, media binary")
    with pytest.raises(Exception, match="no whole WAV"):
        media.read_back(bad).collect()


def test_added_sections_and_members_belong_to_the_medium():
    sniff = media.sniffer()
    added = SAMPLES["application/pdf"] + b"\n2 0 obj\nendobj\nstartxref\n41\n%%EOF"
    assert sniff(b"--" + added + b" -- " + SAMPLES["application/pdf"]) == [("application/pdf", 2, len(added)), ("application/pdf", 6 + len(added), len(SAMPLES["application/pdf"]))]
    members = gzip.compress(b"a" * 100) + gzip.compress(b"b" * 100)
    assert sniff(members + b"\x1f\x8b\x08 no member") == [("application/gzip", 0, len(members))]


@pytest.mark.parametrize("mark", [b"%PDF-1 ", b"PK\x03\x04abc", b"\xff\xd8\xff\xda\x00\x02ab", b"PK\x05\x06" + b"\x00" * 18 + b"PK\x03\x04", b"%PDF-1 startxref "])
def test_repeated_magic_bytes_take_linear_time(mark):
    sniff, data = media.sniffer(), mark * (560_000 // len(mark))
    began = time.process_time()
    assert sniff(data) == []
    assert time.process_time() - began < 2


def chunk(name, data=b""):
    return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))


HEADER = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0))


@pytest.mark.parametrize(
    "mark",
    [b"GIF89aAAAAAAA!", b"GIF87a" + b"\x01\x00" * 3 + b"\x00\x21\x01\x01\x00", b"GIF89aAAAA\x00AA!\xf9\x00,", HEADER, b"\x89PNG\r\n\x1a\n", HEADER + chunk(b"tEXt", b"a")],
)
def test_repeated_gif_and_png_take_linear_time(mark):
    sniff = media.sniffer()
    for n in (140_000, 560_000):
        began = time.process_time()
        assert sniff(mark * (n // len(mark))) == []
        assert time.process_time() - began < 1.5


def test_png_chunks_that_overlap_are_not_read_again_and_again():
    """Every candidate claims a chunk up to the end, of which only the checksum tells that it is none."""
    sniff, n = media.sniffer(), 600_000
    unit = len(HEADER) + 8
    data = b"".join(HEADER + struct.pack(">I4s", n - (k + 1) * unit - 12, b"IDAT") for k in range(n // unit - 1))
    began = time.process_time()
    assert sniff(data + b"x" * (n - len(data))) == []
    assert time.process_time() - began < 12


def test_checksums_of_ranges():
    data = bytes(range(256)) * 400
    marks = media.Marks(data, {m: [] for m in (media.ZIP_END,)})
    for start, end in ((0, 0), (0, 100), (3, 50_000), (4096, 12_288), (1, len(data)), (77, 8_300)):
        assert marks.crc(start, end) == zlib.crc32(data[start:end])


def test_chains_that_meet_are_right_for_both():
    """Two GIFs, the second begun inside a comment of the first, whose chains of blocks come together."""
    tail = b"\x2c" + b"\x00" * 8 + b"\x00" + b"\x02" + b"\x01\x44\x00" + b"\x3b"
    inner = b"GIF89a" + b"\x01\x00\x01\x00\x00\x00\x00"
    outer = b"GIF89a" + b"\x01\x00\x01\x00\x00\x00\x00" + b"\x21\xfe" + bytes([len(inner)]) + inner + b"\x00" + tail
    assert media.sniffer()(b".." + outer + b"..") == [("image/gif", 2, len(outer))]
