"""Removal of repeated 50-byte strings by a hash-compared suffix sort.

Sorting every suffix of a large corpus at once is out of reach, so the suffixes are first brought
together by content. Of each 50-byte string, the 16-byte gram with the least hash is its anchor: equal
strings have equal anchors, wherever they stand. Anchors are dealt by hash; those that two documents
share (with the 17 bytes on one side, as any 50-byte string has) get their surroundings (the 84 bytes that hold all 50-byte strings around the anchor). The
surroundings of one anchor are two sets of suffixes, to its right and (reversed) to its left. Each set is
merge-sorted; two suffixes are compared through prefix polynomial hashes, where binary search finds
their common extension, and the extensions of neighbours are verified byte by byte. A string around
the anchor is the same in two documents if they share a class on both sides.

Nothing is sampled: every 50-byte string has an anchor. Equal surroundings inside a batch of documents are
settled there, before the shuffle, so copies and shared passages weigh one row a batch; what different batches
share is found by the sort alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, frugal, mix, partitions, small_batches

SPAN, GRAM = 50, 16
LEFT, RIGHT = SPAN - GRAM, SPAN
WIDTH = LEFT + RIGHT
#: A 50-byte string reaches at least so far beyond its anchor on one side.
HALF = LEFT // 2
#: Documents are taken together until they have so many bytes.
CHUNK = 4 << 20
U64 = np.uint64
C1, C2, BASE = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x100000001B3)
#: Kinds of rows; where several meet, texts come last.
ANCHORS, MARKS, TEXT = 0, 1, 2
#: Bytes of the compression dictionary, and texts that it is made from.
DICTIONARY, DICTIONARY_TEXTS = 48_000, 400
SCHEMA = "key long, doc_id long, kind int, data binary"


def words_of(buf: bytes, n: int) -> np.ndarray:
    """The eight bytes from each of the first n places as an integer."""
    return np.ndarray((n,), "<u8", buffer=buf, strides=(1,)).astype(U64)


def anchors(buf: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of all 50-byte strings inside the documents [start, end) of buf.

    buf has 24 bytes to spare after the last document.
    """
    n = int(ends[-1]) if len(ends) else 0
    if n < SPAN:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    with np.errstate(over="ignore"):
        v = words_of(buf, n + 8)
        h = mix(v[:n] * C1 + v[8:] * C2) | U64(1)
    least = h.copy()
    for s in (1, 2, 4, 8, 16):
        least[:-s] = np.minimum(least[:-s], least[s:])
    least[:-3] = np.minimum(least[:-3], least[3:])
    for a, b in zip(starts.tolist(), ends.tolist()):
        least[max(a, b - SPAN + 1) : b] = 0
    for s in (1, 2, 4, 8, 16):
        least[s:] = np.maximum(least[s:], least[:-s])
    least[3:] = np.maximum(least[3:], least[:-3])
    at = np.flatnonzero(least == h)
    return at, h[at]


def merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the bytes that the intervals [a, b) cover."""
    if not len(a):
        return a, b
    o = np.argsort(a, kind="stable")
    a, b = a[o], np.maximum.accumulate(b[o])
    new = np.concatenate([[True], a[1:] > b[:-1]])
    return a[new], np.concatenate([b[:-1][new[1:]], b[-1:]])


def pack(a, b) -> bytes:
    return np.stack([a, b]).astype("<u4").tobytes()


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(data, "<u4").reshape(2, -1).astype(np.int64)
    return x[0], x[1]


def planes(x: np.ndarray) -> bytes:
    """The bytes of an array by significance, so that high bytes, mostly equal, compress well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def unplaned(data: bytes, kind: str, n: int, at: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * size, at).reshape(size, n).T).view(kind).ravel()


def side_hashes(v: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 17 bytes to the left and to the right of the anchors at these places; v: words_of() the buffer."""
    with np.errstate(over="ignore"):
        sides = []
        for a, b, c in ((-HALF, -HALF + 8, -8), (GRAM, GRAM + 8, GRAM + HALF - 8)):
            sides.append(mix((v[at + a] * C1 ^ v[at + b]) * C2 ^ v[at + c]))
    return sides[0], sides[1]


def doc_bucket(doc: np.ndarray, parts: int) -> np.ndarray:
    return (mix(doc.astype(np.int64).view(U64)) % U64(parts)).astype(np.int64)


def dealt(bucket: np.ndarray, kind: int, arrays: list):
    """(bucket, 0, kind, data) rows, one for each bucket, of parallel arrays; read again by columns()."""
    o = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.diff(bucket[o])) + 1
    for s in np.split(o, cut):
        if len(s):
            yield int(bucket[s[0]]), 0, kind, np.array([len(s)], "<u4").tobytes() + b"".join(planes(x[s]) for x in arrays)


def columns(blobs: list[bytes], kinds: tuple) -> list[np.ndarray]:
    """The parallel arrays of blobs of dealt(), put together."""
    out: list[list] = [[np.zeros(0, k)] for k in kinds]
    for d in blobs:
        n, at = int(np.frombuffer(d, "<u4", 1)[0]), 4
        for x, k in zip(out, kinds):
            x.append(unplaned(d, k, n, at))
            at += n * np.dtype(k).itemsize
    return [np.concatenate(x) for x in out]


def marks_rows(doc, a, b, parts):
    """Rows for the intervals [a, b) of documents, merged within each."""
    o = np.lexsort((a, doc))
    doc, a, b = doc[o].astype(np.int64), a[o].astype(np.int64), b[o].astype(np.int64)
    if not len(doc):
        return
    # Running ends, begun anew in each document: documents are laid far apart on one line.
    step = int(b.max()) + 2
    new_doc = np.concatenate([[True], doc[1:] != doc[:-1]])
    base = (np.cumsum(new_doc) - 1) * step
    top = np.maximum.accumulate(b + base)
    new = np.concatenate([[True], (a + base)[1:] > top[:-1]])
    ends = np.concatenate([top[:-1][new[1:]], top[-1:]]) - base[new]
    doc, a = doc[new], a[new]
    yield from dealt(doc_bucket(doc, parts), MARKS, [doc.astype("<i8"), a.astype("<u4"), ends.astype("<u4")])


MARK_KINDS = ("<i8", "<u4", "<u4")
FOUND_KINDS = ("<i8", "<u4", "<u8")


def deal(rows):
    """A record batch of (key, doc_id, kind, data) rows."""
    import pyarrow as pa

    cols = list(zip(*rows)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["key", "doc_id", "kind", "data"]
    )


def find_anchors(parts: int):
    """Batches (doc_id, text) to anchors by bucket, and marks of what repeats inside a batch."""

    def chunk(ids, texts):
        lens = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(lens)
        starts = ends - lens
        buf = b"\0" * 40 + b"".join(texts) + b"\0" * 64
        at, h = anchors(buf[40:], starts, ends)
        if not len(at):
            return
        which = np.searchsorted(ends, at, side="right")
        doc = np.array(ids, np.int64)[which]
        pos = at - starts[which]
        lav, rav = np.minimum(LEFT, pos), np.minimum(RIGHT, ends[which] - at)
        whole = (lav == LEFT) & (rav == RIGHT)
        v = words_of(buf, len(buf) - 8)
        key = h.copy()
        with np.errstate(over="ignore"):
            for k in (*range(0, WIDTH - 8, 8), WIDTH - 8):
                key = (key ^ v[at + 40 - LEFT + k]) * C2
                key ^= key >> U64(29)
        key[~whole] = mix(np.arange(len(at), dtype=U64)[~whole]) ^ h[~whole]
        o = np.lexsort((doc, key))
        first = np.concatenate([[True], key[o][1:] != key[o][:-1]])
        lead = o[np.maximum.accumulate(np.where(first, np.arange(len(o)), 0))]
        again = np.flatnonzero(doc[o] != doc[lead])
        gone = np.zeros(len(at), bool)
        if len(again):
            raw = np.frombuffer(buf, np.uint8)
            for piece in np.array_split(again, max(1, len(again) // 20_000)):
                x, y = o[piece], lead[piece]
                span = np.arange(40 - LEFT, 40 + RIGHT)
                same = whole[x] & whole[y] & (raw[at[x][:, None] + span] == raw[at[y][:, None] + span]).all(axis=1)
                gone[x[same]] = True
            yield from marks_rows(doc[gone], pos[gone] - LEFT, pos[gone] + RIGHT, parts)
        left, right = side_hashes(v, at + 40)
        for x, short in ((left, lav < HALF), (right, rav < GRAM + HALF)):
            x[short] = mix(at[short].astype(U64))
        # 40 bits of the anchor's hash, then 12 of what stands to its left and 12 of what stands to its right.
        h = h >> U64(24) << U64(24) | left >> U64(52) << U64(12) | right >> U64(52)
        doc, pos, h = doc[~gone], pos[~gone], h[~gone]
        bucket = (h >> U64(24)) % U64(parts)
        o = np.argsort(bucket, kind="stable")
        doc, pos, h, bucket = doc[o], pos[o], h[o], bucket[o]
        cut = np.flatnonzero(np.diff(bucket)) + 1
        for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(h)]):
            if hi > lo:
                new = np.flatnonzero(np.concatenate([[True], np.diff(doc[lo:hi]) != 0]))
                head = np.array([hi - lo, len(new)], "<u4").tobytes()
                yield int(bucket[lo]), 0, ANCHORS, head + h[lo:hi].astype("<u8").tobytes() + planes(pos[lo:hi].astype("<u4")) + planes(doc[lo:hi][new].astype("<i8")) + planes(
                    np.diff([*new, hi - lo]).astype("<u4")
                )

    def run(batches):
        ids, texts, size = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                if i is None or t is None or len(t) < SPAN:
                    continue
                ids.append(i)
                texts.append(t)
                size += len(t)
                if size >= CHUNK:
                    yield deal(chunk(ids, texts))
                    ids, texts, size = [], [], 0
        if ids:
            yield deal(chunk(ids, texts))

    return run


def share_anchors(parts: int):
    """Of a bucket's anchors, those that another document may share with half of their surroundings, by document's bucket; marks pass."""

    def run(batches):
        blobs = []
        for batch in batches:
            rows = batch.to_pylist()
            yield deal([(r["key"], 0, MARKS, r["data"]) for r in rows if r["kind"] == MARKS])
            blobs += [r["data"] for r in rows if r["kind"] == ANCHORS]
        if blobs:
            yield deal(shared_in(blobs, parts))

    return run


def shared_in(blobs: list[bytes], parts: int):
    hs, docs, poss = [], [], []
    for d in blobs:
        n, m = np.frombuffer(d, "<u4", 2).tolist()
        hs.append(np.frombuffer(d, "<u8", n, 8))
        poss.append(unplaned(d, "<u4", n, 8 + 8 * n))
        docs.append(np.repeat(unplaned(d, "<i8", m, 8 + 12 * n), unplaned(d, "<u4", m, 8 + 12 * n + 8 * m)))
    h, doc, pos = np.concatenate(hs), np.concatenate(docs), np.concatenate(poss)
    # Candidates: another document has the anchor with the same left side, or with the same right side.
    shared = np.zeros(len(h), bool)
    for key in (h >> U64(12), h >> U64(24) << U64(12) | h & U64(4095)):
        o = np.argsort(key)
        runs = np.flatnonzero(np.concatenate([[True], key[o][1:] != key[o][:-1]]))
        shared[o] |= np.repeat(np.minimum.reduceat(doc[o], runs) != np.maximum.reduceat(doc[o], runs), np.diff([*runs, len(h)]))
    h, doc, pos = h[shared] >> U64(24), doc[shared], pos[shared]
    o = np.lexsort((pos, doc))
    h, doc, pos = h[o], doc[o], pos[o]
    yield from dealt(doc_bucket(doc, parts), ANCHORS, [doc.astype("<i8"), pos.astype("<u4"), h.astype("<u8")])


def surround(parts: int, dictionary: bytes):
    """A document bucket's shared anchors, then its texts, to the surroundings of the anchors, by anchor's bucket; marks pass."""

    def run(batches):
        blobs, found, held, size = [], None, [], 0
        unpacked = decompressor(dictionary)

        def flush():
            doc, pos, h, lav, rav, ctx = (np.concatenate(x) for x in zip(*held))
            bucket = h % U64(parts)
            o = np.argsort(bucket, kind="stable")
            cut = np.flatnonzero(np.diff(bucket[o])) + 1
            for s in np.split(o, cut):
                if len(s):
                    raw = b"".join(
                        [
                            np.array([len(s)], "<u4").tobytes(), planes(h[s].astype("<u8")), planes(doc[s].astype("<i8")),
                            planes(pos[s].astype("<u4")), lav[s].astype(np.uint8).tobytes(), rav[s].astype(np.uint8).tobytes(),
                            ctx[s].tobytes()
                        ]
                    )
                    yield int(bucket[s[0]]), 0, ANCHORS, zstandard.compress(raw, 3)

        for batch in batches:
            out = []
            for key, i, kind, data in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == MARKS:
                    out.append((key, 0, MARKS, data))
                    continue
                if kind == ANCHORS:
                    blobs.append(data)
                    continue
                if found is None:
                    doc, pos, h = columns(blobs, FOUND_KINDS)
                    o = np.lexsort((pos, doc))
                    found, blobs = (doc[o], pos[o].astype(np.int64), h[o]), []
                lo, hi = np.searchsorted(found[0], [i, i + 1])
                if lo == hi:
                    continue
                text = unpacked(data)
                pos, h = found[1][lo:hi], found[2][lo:hi]
                inside = pos + GRAM <= len(text)
                pos, h = pos[inside], h[inside]
                raw = np.frombuffer(b"\0" * LEFT + text + b"\0" * RIGHT, np.uint8)
                ctx = raw[pos[:, None] + np.arange(WIDTH)]
                held.append((np.full(len(pos), i, np.int64), pos, h, np.minimum(LEFT, pos), np.minimum(RIGHT, len(text) - pos), ctx))
                size += len(pos)
                if size > 200_000:
                    out += flush()
                    held, size = [], 0
            yield deal(out)
        if held:
            yield deal(flush())

    return run


def prefix_hashes(mat: np.ndarray) -> np.ndarray:
    """Polynomial hash of each prefix of each row."""
    out = np.zeros((len(mat), mat.shape[1] + 1), U64)
    with np.errstate(over="ignore"):
        for k in range(mat.shape[1]):
            out[:, k + 1] = out[:, k] * BASE + mat[:, k] + U64(1)
        return out


class Suffixes:
    """Suffixes as rows of bytes with lengths; compared through their prefix hashes."""

    def __init__(self, mat: np.ndarray, length: np.ndarray):
        self.mat, self.length, self.hash = mat, length.astype(np.int64), prefix_hashes(mat)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of rows a and b, by binary search over hashes."""
        lo, hi = np.zeros(len(a), np.int64), np.minimum(self.length[a], self.length[b])
        while (lo < hi).any():
            mid = (lo + hi + 1) >> 1
            same = self.hash[a, mid] == self.hash[b, mid]
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = self.common(a, b)
        over = (n >= self.length[a]) | (n >= self.length[b])
        k = np.minimum(n, self.mat.shape[1] - 1)
        return np.where(over, self.length[a] < self.length[b], self.mat[a, k] < self.mat[b, k])

    def sorted(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order, common): rows sorted inside each group (equal values stand together); extension shared with the one before.

        Bottom-up merge sort, all groups at once: in each pass every row finds its place in the sibling run by binary search.
        """
        n = len(group)
        order = np.arange(n)
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.zeros(0, np.int64)
        sizes = np.diff([*first, n])
        start, size = np.repeat(first, sizes), np.repeat(sizes, sizes)
        width = 1
        while n and width < sizes.max():
            p = np.flatnonzero(size > width)
            base = start[p] + (p - start[p]) // (2 * width) * (2 * width)
            end = start[p] + size[p]
            mid, top = np.minimum(base + width, end), np.minimum(base + 2 * width, end)
            left = p < mid
            lo, hi = np.where(left, mid, base), np.where(left, top, mid)
            own = order[p]
            while (open_ := np.flatnonzero(lo < hi)).size:
                m = (lo[open_] + hi[open_]) >> 1
                x, y = own[open_], order[m]
                right = np.where(left[open_], self.less(y, x), ~self.less(x, y))
                lo[open_], hi[open_] = np.where(right, m + 1, lo[open_]), np.where(right, hi[open_], m)
            place = np.where(left, p + lo - mid, base + (p - mid) + (lo - base))
            order[place] = own
            width *= 2
        common = np.zeros(n, np.int64)
        if n > 1:
            a, b = order[:-1], order[1:]
            k = self.common(a, b)
            # Verification: the true extension, and the order that it implies.
            cols = np.arange(self.mat.shape[1])
            inside = cols < np.minimum(self.length[a], self.length[b])[:, None]
            true = ((self.mat[a] == self.mat[b]) & inside).cumprod(axis=1).sum(axis=1)
            same = group[a] == group[b]
            if (true[same] != k[same]).any():
                rows = sorted(range(n), key=lambda i: (group[i], self.mat[i, : self.length[i]].tobytes()))
                order = np.array(rows)
                a, b = order[:-1], order[1:]
                inside = cols < np.minimum(self.length[a], self.length[b])[:, None]
                true = ((self.mat[a] == self.mat[b]) & inside).cumprod(axis=1).sum(axis=1)
                same = group[a] == group[b]
            common[1:] = np.where(same, true, -1)
        if n:
            common[0] = -1
        return order, common


def distinct(mat: np.ndarray, length: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, number): a row for each different suffix of a group, in order of group, and the number of its suffix for every row.

    Equal suffixes stand together in any order, so one of them is sorted for all. Hashes find them, bytes decide.
    """
    wide = np.zeros((len(mat), -(-mat.shape[1] // 8) * 8), np.uint8)
    wide[:, : mat.shape[1]] = mat
    key = length.astype(U64)
    with np.errstate(over="ignore"):
        for col in wide.view("<u8").T:
            key = (key ^ col) * C2
            key ^= key >> U64(29)
    o = np.lexsort((key, group))
    x, y = o[1:], o[:-1]
    new = np.ones(len(o), bool)
    new[1:] = (group[x] != group[y]) | (key[x] != key[y]) | (length[x] != length[y]) | (wide[x] != wide[y]).any(axis=1)
    number = np.empty(len(o), np.int64)
    number[o] = np.cumsum(new) - 1
    return o[new], number


def repeated(h, doc, pos, lav, rav, ctx) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, end): strings around these anchors that a smaller document also has, by the suffix sort of both sides.

    Suffixes that extend each other far enough are neighbours in the order, so they are one class for each length; a string that
    reaches j bytes to the left of the anchor is the same in two documents if they share the classes of both its ends.
    """
    o = np.lexsort((doc, h))
    h, doc, pos, lav, rav, ctx = (x[o] for x in (h, doc, pos, lav, rav, ctx))
    runs = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    sizes = np.diff([*runs, len(h)])
    # An anchor in one document only has nothing to compare.
    some = np.flatnonzero(np.repeat(doc[runs] != doc[runs + sizes - 1], sizes))
    if not len(some):
        return doc[:0], pos[:0], pos[:0]
    group = np.repeat(np.arange(len(runs)), sizes)[some]
    doc, pos, lav, rav, ctx = (x[some] for x in (doc, pos, lav, rav, ctx))
    sides = []
    for mat, length in ((ctx[:, LEFT:], rav), (ctx[:, :LEFT][:, ::-1], lav)):
        rows, number = distinct(np.ascontiguousarray(mat), length, group)
        order, common = Suffixes(np.ascontiguousarray(mat[rows]), length[rows]).sorted(group[rows])
        sides.append((number, order, common))
    (right, ro, rc), (left, lo_, lc) = sides
    # Rows with the same suffixes on both sides have the same strings; the first is the least document's.
    pairs, first, pair = np.unique(right * len(lo_) + left, return_index=True, return_inverse=True)
    at_right, at_left, least, reach_l, reach_r = right[first], left[first], doc[first], lav[first], rav[first]
    class_r, class_l = np.empty(len(ro), np.int64), np.empty(len(lo_), np.int64)
    smallest = np.full((len(pairs), LEFT + 1), np.iinfo(np.int64).max)
    for j in range(LEFT + 1):
        class_r[ro] = np.cumsum(rc < SPAN - j)
        class_l[lo_] = np.cumsum(lc < j)
        ok = np.flatnonzero((reach_l >= j) & (reach_r >= SPAN - j))
        both = class_r[at_right[ok]] * (len(lo_) + 1) + class_l[at_left[ok]]
        s = np.lexsort((least[ok], both))
        ok, both = ok[s], both[s]
        if len(ok):
            head = np.maximum.accumulate(np.where(np.concatenate([[True], both[1:] != both[:-1]]), np.arange(len(ok)), 0))
            smallest[ok, j] = least[ok[head]]
    # All strings found around one anchor overlap in it: they are one span, from the farthest left to the farthest right.
    out = []
    for lo in range(0, len(doc), 50_000):
        marks = doc[lo : lo + 50_000, None] > smallest[pair[lo : lo + 50_000]]
        hit = np.flatnonzero(marks.any(axis=1))
        far, near = LEFT - marks[hit, ::-1].argmax(axis=1), marks[hit].argmax(axis=1)
        out.append((doc[lo + hit], pos[lo + hit] - far, pos[lo + hit] - near + SPAN))
    return tuple(np.concatenate(x) for x in zip(*out))


def compare(parts: int):
    """Surroundings of an anchor bucket to marks by document's bucket; marks pass."""

    def run(batches):
        held = []
        for batch in batches:
            rows = batch.to_pylist()
            yield deal([(r["key"], 0, MARKS, r["data"]) for r in rows if r["kind"] == MARKS])
            for r in rows:
                if r["kind"] == ANCHORS:
                    d = zstandard.decompress(r["data"])
                    n = int(np.frombuffer(d, "<u4", 1)[0])
                    held.append(
                        (
                            unplaned(d, "<u8", n, 4), unplaned(d, "<i8", n, 4 + 8 * n), unplaned(d, "<u4", n, 4 + 16 * n).astype(np.int64),
                            np.frombuffer(d, np.uint8, n, 4 + 20 * n).astype(np.int64),
                            np.frombuffer(d, np.uint8, n, 4 + 21 * n).astype(np.int64),
                            np.frombuffer(d, np.uint8, n * WIDTH, 4 + 22 * n).reshape(n, WIDTH)
                        )
                    )
        if held:
            doc, a, b = repeated(*(np.concatenate(x) for x in zip(*held)))
            yield deal(marks_rows(doc, a, b, parts))

    return run


def gather_marks(batches):
    """A document bucket's marks to one row for each document."""
    blobs = []
    for batch in batches:
        blobs += batch.column(3).to_pylist()
    doc, a, b = columns(blobs, MARK_KINDS)
    o = np.argsort(doc, kind="stable")
    doc, a, b = doc[o], a[o].astype(np.int64), b[o].astype(np.int64)
    cut = [0, *(np.flatnonzero(np.diff(doc)) + 1).tolist(), len(doc)]
    rows = []
    for lo, hi in zip(cut, cut[1:]):
        if hi > lo:
            rows.append((0, int(doc[lo]), MARKS, pack(*merged(a[lo:hi], b[lo:hi]))))
        if len(rows) == 4096:
            yield deal(rows)
            rows = []
    yield deal(rows)


def compressor(dictionary: bytes):
    kept = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=3, dict_data=kept).compress


def decompressor(dictionary: bytes):
    kept = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdDecompressor(dict_data=kept).decompress


def dictionary_of(docs: DataFrame) -> bytes:
    """A dictionary that makes compressed texts smaller, from a bounded number of texts; empty if there are too few. It changes sizes only."""
    rows = docs.where("text is not null").select(F.substring("text", 1, 4000).alias("text")).limit(DICTIONARY_TEXTS).collect()
    try:
        return zstandard.train_dictionary(DICTIONARY, [r.text.encode() for r in rows]).as_bytes() if len(rows) >= 50 else b""
    except zstandard.ZstdError:
        return b""


def compressed(docs: DataFrame, dictionary: bytes, parts: int) -> DataFrame:
    """(key, doc_id, kind, data): texts as compressed bytes, so that shuffles move less; null is empty."""
    import pyarrow as pa

    def run(batches):
        packed = compressor(dictionary)
        for batch in batches:
            n = len(batch)
            ids = batch.column(0)
            key = doc_bucket(np.array([x or 0 for x in ids.to_pylist()], np.int64), parts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(key, pa.int64()), ids, pa.array([TEXT] * n, pa.int32()),
                    pa.array([packed(t or b"") for t in as_bytes(batch.column(1))], pa.binary())
                ],
                names=["key", "doc_id", "kind", "data"]
            )

    return docs.mapInArrow(run, SCHEMA)


def removed_spans(docs: DataFrame, dictionary: bytes) -> DataFrame:
    """(doc_id, marks binary) of the documents that lose bytes; docs has doc_id and text."""
    parts = partitions(docs.sparkSession)
    to = lambda df: df.repartitionById(parts, F.col("key").cast("int"))
    shared = to(docs.mapInArrow(frugal(find_anchors(parts)), SCHEMA)).mapInArrow(frugal(share_anchors(parts)), SCHEMA)
    texts = compressed(docs.where("doc_id is not null"), dictionary, parts)
    near = to(shared.unionByName(texts)).sortWithinPartitions("kind").mapInArrow(frugal(surround(parts, dictionary)), SCHEMA)
    marks = to(near).mapInArrow(frugal(compare(parts)), SCHEMA)
    return to(marks).mapInArrow(gather_marks, SCHEMA).select("doc_id", F.col("data").alias("marks"))


def without(text: bytes, marks) -> tuple[bytes, int]:
    """The bytes that are left and the number of maximal removed runs."""
    if not marks:
        return text, 0
    a, b = unpack(marks)
    b = np.minimum(b, len(text))
    a, b = a[a < b], b[a < b]
    edges = [0, *np.stack([a, b], axis=1).ravel().tolist(), len(text)]
    return b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2])), len(a)


def plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    A null text is empty; texts under 50 bytes lose nothing. A null doc_id is smaller than none: its row
    keeps all and takes nothing from others. Rows that repeat a doc_id are one document: a span found in
    one of them is removed from each. Other columns are ignored; an empty table gives no row.
    """
    import pyarrow as pa

    small_batches(docs.sparkSession)
    rows = plain(docs)
    parts, dictionary = partitions(docs.sparkSession), dictionary_of(rows)

    def run(batches):
        unpacked = decompressor(dictionary)
        for batch in batches:
            n, m, k, s = [], [], [], []
            for data, marks in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                text = unpacked(data)
                kept, spans = without(text, marks)
                n.append(len(text))
                m.append(len(text) - len(kept))
                k.append(spans)
                s.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(k, pa.int64()), pa.array(s, pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            )

    out = compressed(rows, dictionary, parts).select("doc_id", "data").join(removed_spans(rows, dictionary), "doc_id", "left")
    return out.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut_texts(docs: DataFrame) -> DataFrame:
    """docs with the repeated bytes gone from text; n_chars, where there, follows. A character that loses a byte goes.

    A null text stays null, and so does the text of a row without doc_id; repeated rows lose the same. Names that
    clash with the operator's own are safe, as a row's columns travel as one.
    """
    import pyarrow as pa

    small_batches(docs.sparkSession)
    names = docs.columns

    def cut(batches):
        for batch in batches:
            texts = as_bytes(batch.column(1))
            kept = [t if m is None or t is None else without(t, m)[0] for t, m in zip(texts, batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([None if t is None else t.decode("utf-8", "ignore") for t in kept], pa.string())],
                names=["_row", "_text"]
            )

    own = docs.select(F.col("doc_id").cast("long").alias("_k"), F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"))
    joined = own.join(removed_spans(plain(docs), dictionary_of(plain(docs))).withColumnRenamed("doc_id", "_k"), "_k", "left")
    joined = joined.select("_row", F.col("_row")["text"].cast("string").alias("_text"), "marks").mapInArrow(
        cut, joined.select("_row", F.lit(None).cast("string").alias("_text")).schema
    )
    put = {"text": F.col("_text")} | ({"n_chars": F.length("_text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in names else {})
    return joined.select(*((put[c] if c in put else F.col("_row").getField(c)).alias(c) for c in names))
