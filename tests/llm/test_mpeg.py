import hashlib
import random
import struct
import zlib
from fractions import Fraction

from tidegate.llm import mpeg


def test_round_trip():
    for n in (0, 1, 575, 576, 577, 50_000):
        data = random.Random(n).randbytes(n)
        stored = mpeg.encode(mpeg.padded(data))
        got = mpeg.parse(stored)
        assert mpeg.decode(stored) == mpeg.padded(data) and len(mpeg.padded(data)) % 576 == 0
        assert got["bad_checksums"] == 0 and got["skipped"] == 0 and got["tags"] == ["ID3v2.4"]
        assert got["table"]["frames"] == len(got["offsets"]) == len(mpeg.padded(data)) // 576
        assert got["seconds"] == len(got["offsets"]) * 1152 / 48000


def test_resynchronises_and_sees_damage():
    stored = bytearray(mpeg.encode(mpeg.padded(b"\xff\xfa\xc4\xc0" * 1000)))
    n = len(mpeg.parse(bytes(stored))["offsets"])
    stored[-1 * mpeg.FRAME + 10] ^= 1
    assert mpeg.parse(bytes(stored))["bad_checksums"] == 1
    junk = bytes(stored[: mpeg.FRAME * 3 + 29]) + b"junk\xff\x00" * 7 + bytes(stored[mpeg.FRAME * 3 + 29 :]) + b"TAG" + b"\0" * 125
    got = mpeg.parse(junk)
    assert len(got["offsets"]) == n and got["skipped"] == 42 and "ID3v1" in got["tags"]
    assert mpeg.decode(junk, got) == mpeg.padded(b"\xff\xfa\xc4\xc0" * 1000)


def test_headers():
    assert mpeg.header(b"\xff\xfb\x90\x00")["size"] == 417  # 128 kbit/s at 44.1 kHz
    assert mpeg.header(b"\xff\xf3\x40\xc0")["samples"] == 576
    assert mpeg.header(b"\xff\xe3\x40\xc0")["hertz"] == 11025
    assert mpeg.header(b"\xff\xff\xff\xff") is None and mpeg.header(b"\x00\xff\x90\x00") is None


def test_query(spark):
    rows = [(1, "é" * 400, "x"), (1, "é" * 400, "y"), (2, None, ""), (None, "", ""), (3, "z" * 70_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, feature string")
    got = {(r.doc_id, r.n_bytes): r for r in mpeg.media_digests(docs).collect()}
    assert len(got) == 4
    for i, t, _ in rows:
        p = mpeg.padded((t or "").encode())
        r = got[i, len((t or "").encode())]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        stored = mpeg.encode(p)
        n = len(p) // 576
        start = len(stored) - n * 672
        assert r.media_sha256 == hashlib.sha256(stored).hexdigest() and r.frame_offsets == [start + 672 * k for k in range(n)]
        assert (r.frames, r.samples, Fraction(r.duration_numerator, r.duration_denominator)) == (n, 1152 * n, Fraction(1152 * n, 48000))
        assert (r.table_frames, r.table_bytes, r.bad_checksums, r.skipped_bytes, r.tags) == (n, (n + 1) * 672, 0, 0, ["ID3v2.4"])
        seek = zlib.crc32(struct.pack(f"<{n}Q", *r.frame_offsets))
        assert r.feature == f"frames={n};samples={1152 * n};seconds={Fraction(3 * n, 125)};bad=0;skipped=0;vbr={n};tags=ID3v2.4;seek={seek:08x}"
    assert mpeg.media_digests(docs.limit(0)).count() == 0
    assert all(mpeg.decode(r.media) for r in mpeg.media(docs).collect())


def test_index_of_any_stream(spark):
    """Streams of other rates and layers, damaged, empty or none at all."""
    slow = (b"\xff\xfb\x90\x00" + b"\0" * 413) * 5  # 128 kbit/s at 44.1 kHz
    mixed = slow + (b"\xff\xf3\x40\xc0" + b"\0" * (mpeg.header(b"\xff\xf3\x40\xc0")["size"] - 4)) * 3
    broken = bytearray(mpeg.encode(mpeg.padded(b"x" * 2000)))
    broken[-mpeg.FRAME + 8] ^= 1
    rows = [(1, slow), (2, mixed), (3, bytes(broken)), (4, b""), (5, None), (6, b"no audio"), (None, slow)]
    got = {
        r.doc_id: r for r in mpeg.indexed(
            spark.createDataFrame(
                [(i, None if m is None else bytearray(m), "x") for i, m in rows], "doc_id long, media binary, frames string"
            )
        ).collect()
    }
    length = lambda r: Fraction(r.duration_numerator, r.duration_denominator)
    assert length(got[1]) == Fraction(5 * 1152, 44100) and got[1].frame_offsets == [417 * k for k in range(5)] and got[1].table_frames is None
    assert length(got[2]) == Fraction(5 * 1152, 44100) + Fraction(3 * 576, mpeg.header(b"\xff\xf3\x40\xc0")["hertz"]) and got[2].frames == 8
    assert got[3].bad_checksums == 1 and got[3].frames == 4
    assert all((got[i].frames, length(got[i]), got[i].frame_offsets, got[i].tags) == (0, 0, [], []) for i in (4, 5, 6))
    assert got[None].frames == 5
