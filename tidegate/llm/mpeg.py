"""MPEG audio columns.

Writing puts a payload into MPEG-1 Layer III frames (mono, 48 kHz, 224 kbit/s, checksummed): each
frame's main data holds one 576-byte unit of the payload. An ID3v2 tag and a frame with a
variable-bitrate table (frame count, byte count, 100 seek points) stand before them. Reading
resynchronises on frame headers, parses tag and table, verifies the checksums and gives exact
durations and the offset of every frame.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, small_batches

UNIT = 576
# Fixed values of MPEG audio: bit rates (kbit/s) by version group and layer, sampling rates, samples in a frame.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}
SAMPLES = {(1, 1): 384, (1, 2): 1152, (1, 3): 1152, (2, 1): 384, (2, 2): 1152, (2, 3): 576}
#: Layer III, protected, 224 kbit/s, 48 kHz, mono: 672 bytes, of which 4 header, 2 checksum, 17 side information.
HEADER = bytes((0xFF, 0xFA, 0xC4, 0xC0))
FRAME, BODY = 672, 23
VERSIONS = {0: 2.5, 2: 2, 3: 1}
#: What is known of a stream: exact duration in seconds as a fraction, and where each frame begins.
INDEX = "frames long, samples long, duration_numerator long, duration_denominator long, frame_offsets array<long>, table_frames long, table_bytes long, bad_checksums long, skipped_bytes long, tags array<string>"
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, " + INDEX


def crc_table() -> np.ndarray:
    """Of the polynomial x^16 + x^15 + x^2 + 1, most significant bit first."""
    out = np.zeros(256, np.uint16)
    for i in range(256):
        r = i << 8
        for _ in range(8):
            r = (r << 1 ^ 0x8005 if r & 0x8000 else r << 1) & 0xFFFF
        out[i] = r
    return out


CRC = crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """Checksum of each row of bytes."""
    r = np.full(len(rows), 0xFFFF, np.uint16)
    for k in range(rows.shape[1]):
        r = (r << np.uint16(8)) ^ CRC[(r >> np.uint16(8)) ^ rows[:, k]]
    return r


def header(word: bytes) -> dict | None:
    """What four bytes say if they can be a frame header; free-format frames are not taken."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version, layer = VERSIONS.get(word[1] >> 3 & 3), 4 - (word[1] >> 1 & 3)
    rate, hz = word[2] >> 4, word[2] >> 2 & 3
    if version is None or layer == 4 or rate in (0, 15) or hz == 3 or word[3] & 3 == 2:
        return None
    kbps, hertz = BITRATES[min(2, int(version + 0.5)) if version != 1 else 1, layer][rate], RATES[version][hz]
    samples = SAMPLES[1 if version == 1 else 2, layer]
    pad = word[2] >> 1 & 1
    size = (12000 * kbps // hertz + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbps // hertz + pad
    mono = word[3] >> 6 == 3
    side = 0 if layer != 3 else (17 if mono else 32) if version == 1 else (9 if mono else 17)
    return {
        "version": version, "layer": layer, "kbps": kbps, "hertz": hertz, "samples": samples, "size": size, "protected": not word[1] & 1,
        "side": side, "mono": mono
    }


def tag(size_hint: int) -> bytes:
    body = b"TENC" + struct.pack(">IH", 9, 0) + b"\x00tidegate"
    n = len(body)
    return b"ID3\x04\x00\x00" + bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127)) + body


def encode(payload: bytes) -> bytes:
    """The payload, whose length is a multiple of 576, as MPEG audio."""
    n = len(payload) // UNIT
    frames = np.zeros((n + 1, FRAME), np.uint8)
    frames[:, :4] = np.frombuffer(HEADER, np.uint8)
    if n:
        frames[1:, BODY : BODY + UNIT] = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
    total = (n + 1) * FRAME
    seek = bytes(min(255, (k * (n + 1) // 100) * FRAME * 256 // total) for k in range(100))
    table = b"Xing" + struct.pack(">III", 7, n, total) + seek
    frames[0, BODY : BODY + len(table)] = np.frombuffer(table, np.uint8)
    crc = crc16(np.concatenate([frames[:, 2:4], frames[:, 6:BODY]], axis=1))
    frames[:, 4], frames[:, 5] = crc >> 8, crc & 255
    return tag(n) + frames.tobytes()


def parse(data: bytes) -> dict:
    """Tags, table, frames, checksums and duration of a stream, whatever stands between its frames.

    A header counts if another frame, or the end, follows where it says; else the search goes on one
    byte later, so junk and sync-like payload bytes are passed over.
    """
    at, end, tags = 0, len(data), []
    while data[at : at + 3] == b"ID3" and at + 10 <= end:
        size = data[at + 6] << 21 | data[at + 7] << 14 | data[at + 8] << 7 | data[at + 9]
        tags.append(f"ID3v2.{data[at + 3]}")
        at += 10 + size + (10 if data[at + 5] & 16 else 0)
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        tags.append("ID3v1")
        end -= 128
    known: dict[bytes, dict | None] = {}
    offsets, heads, skipped, locked = [], [], 0, False
    while at + 4 <= end:
        word = data[at : at + 4]
        if word not in known:
            known[word] = header(word)
        h = known[word]
        good = h is not None and at + h["size"] <= end
        if good and not locked and at + h["size"] < end:
            good = at + h["size"] + 4 <= end and header(data[at + h["size"] : at + h["size"] + 4]) is not None
        if good:
            offsets.append(at)
            heads.append(h)
            at += h["size"]
            locked = True
        else:
            locked = False
            at2 = data.find(b"\xff", at + 1, end)
            at2 = end if at2 < 0 else at2
            skipped += at2 - at
            at = at2
    table = None
    if heads:
        h = heads[0]
        body = offsets[0] + 4 + 2 * h["protected"] + h["side"]
        if data[body : body + 4] in (b"Xing", b"Info"):
            flags, p = struct.unpack_from(">I", data, body + 4)[0], body + 8
            table = {}
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    table[name] = struct.unpack_from(">I", data, p)[0]
                    p += 4
            if flags & 4:
                table["toc"] = data[p : p + 100]
        elif data[offsets[0] + 36 : offsets[0] + 40] == b"VBRI":
            size, count = struct.unpack_from(">II", data, offsets[0] + 46)
            table = {"frames": count, "bytes": size}
    if table is not None:
        offsets, heads = offsets[1:], heads[1:]
    bad = 0
    raw = np.frombuffer(data, np.uint8)
    for side in {h["side"] for h in heads if h["protected"] and h["layer"] == 3}:
        o = np.array([o for o, h in zip(offsets, heads) if h["side"] == side and h["protected"] and h["layer"] == 3])
        span = np.concatenate([raw[o[:, None] + np.arange(2, 4)], raw[o[:, None] + np.arange(6, 6 + side)]], axis=1)
        bad += int((crc16(span) != (raw[o + 4].astype(np.uint16) << np.uint16(8) | raw[o + 5])).sum())
    hertz = heads[0]["hertz"] if heads else 0
    samples = sum(h["samples"] for h in heads)
    duration = sum((Fraction(n * m, hz) for (m, hz), n in Counter((h["samples"], h["hertz"]) for h in heads).items()), Fraction(0))
    return {
        "duration": duration, "tags": tags, "table": table, "offsets": offsets, "heads": heads, "skipped": skipped, "bad_checksums": bad,
        "samples": samples, "hertz": hertz, "seconds": samples / hertz if hertz else 0.0
    }


def decode(data: bytes, parsed: dict | None = None) -> bytes:
    """The payload of a stream made by encode()."""
    parsed = parsed or parse(data)
    if not parsed["offsets"]:
        return b""
    o = np.array(parsed["offsets"])
    if int(o[-1] - o[0]) == (len(o) - 1) * FRAME and (np.diff(o) == FRAME).all():
        return np.frombuffer(data, np.uint8, len(o) * FRAME, int(o[0])).reshape(-1, FRAME)[:, BODY : BODY + UNIT].tobytes()
    return b"".join(data[x + BODY : x + BODY + UNIT] for x in parsed["offsets"])


def padded(text: bytes) -> bytes:
    return text + b"\xff" * (UNIT - len(text) % UNIT if len(text) % UNIT or not text else 0)


def media(docs: DataFrame) -> DataFrame:
    """doc_id and the stored bytes of each text: the media column itself."""
    import pyarrow as pa

    small_batches(docs.sparkSession, 256)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([encode(padded(t or b"")) for t in as_bytes(batch.column(1))], pa.binary())],
                names=["doc_id", "media"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, media binary")


def index_of(parsed: dict) -> tuple:
    """The values of INDEX. A table that is not there, or does not say, is null."""
    table, d = parsed["table"] or {}, parsed["duration"]
    return len(parsed["offsets"]), parsed["samples"], d.numerator, d.denominator, parsed["offsets"], table.get("frames"), table.get("bytes"), parsed["bad_checksums"], parsed["skipped"], parsed["tags"]


def index_types() -> list:
    import pyarrow as pa

    kinds = {"long": pa.int64(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return [kinds[x.split()[1]] for x in INDEX.split(", ")]


def indexed(media: DataFrame) -> DataFrame:
    """doc_id and INDEX of each stream of a media column (doc_id, media), whoever wrote it.

    Null or empty media, or media without a frame, have no frames and last 0 seconds. A frame's time is that of the samples
    before it, so the offsets are a seek table as fine as can be.
    """
    import pyarrow as pa

    small_batches(media.sparkSession, 256)
    names = ["doc_id", *(x.split()[0] for x in INDEX.split(", "))]

    def run(batches):
        for batch in batches:
            cols = list(zip(*(index_of(parse(m or b"")) for m in batch.column(1).to_pylist()))) or [()] * (len(names) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, index_types()))], names=names)

    return media.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("media").cast("binary").alias("media")).mapInArrow(run, "doc_id long, " + INDEX)


def described(text: bytes | None) -> tuple:
    text = text or b""
    stored = encode(padded(text))
    parsed = parse(stored)
    payload = decode(stored, parsed)
    toc = zlib.crc32(np.array(parsed["offsets"], "<u8").tobytes())
    feature = f"frames={len(parsed['offsets'])};samples={parsed['samples']};seconds={parsed['duration']};bad={parsed['bad_checksums']};skipped={parsed['skipped']};vbr={parsed['table']['frames'] if parsed['table'] else -1};tags={','.join(parsed['tags'])};seek={toc:08x}"
    return len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, *index_of(parsed)


def media_digests(docs: DataFrame) -> DataFrame:
    """Stores every text as MPEG audio, reads it back and describes both forms.

    A null text is an empty one: one unit of padding. A null doc_id stays null; repeated rows give
    repeated results; other columns are ignored. Long texts are one stream of many frames.
    """
    import pyarrow as pa

    small_batches(docs.sparkSession, 256)
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), *index_types()]
        for batch in batches:
            cols = list(zip(*map(described, as_bytes(batch.column(1))))) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
