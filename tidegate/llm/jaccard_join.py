"""N-gram Jaccard join: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

1. Every text becomes its set of shingle hashes; sets that are equal are one from then on.
2. Blocking. A set has 48 signatures, each of four minima of hashes over its shingles; two sets of similarity J share none
   with probability (1 - J^4)^48, at J = 0.8 once in 10^11. Under a signature, sets are brought together if their sizes
   allow a link and 28 of 64 further four-bit minima agree: that loses a pair of similarity 0.8 five times in 10^12, and
   parts sets that only share a passage. Under a signature of very many sets all come together, unasked. What is
   brought together are coarse groups; nobody in different groups is linked.
3. Each group is searched exactly by T-occurrence. The index holds leaders: a set that links with a
   leader joins its ball. By the triangle inequality of the Jaccard distance, whatever links with a member of a
   ball has a similarity of 0.6 or more with its leader; so a set looks for leaders of that overlap, and only
   inside the balls of those does it look for links. Both searches are DivideSkip: short inverted lists are
   merged by a heap, skipping ahead where too few lists are left, long ones are probed by binary search.
   Inside a dense group each set needs one leader, not all pairs.
4. Large groups are split into blocks of bounded size, the group's first set in each. What a block could not
   connect with the group's largest component is searched in every other block.

Sets are compared by 64-bit hashes of their shingles, and taken for equal if 128 bits of all of them and their number are.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left

import numpy as np
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, as_bytes, components, dropped, edge_batches, forest, frugal, merge_forests, mix, partitions, small_batches, stored

SHINGLE, PERCENT = 5, 80
CHUNK, SIGNED, CACHE_WORDS = 2 << 20, 6 << 20, 150_000
#: Sets of at most so many shingles are linked only if they are equal.
EQUAL_ONLY = 3
#: Signatures of a set, minima in each; minima of a sketch, and how many must agree.
BANDS, ROWS, SKETCH, AGREE = 48, 4, 64, 28
#: Sets under one signature that come together unasked: in a chunk of texts, and in all.
HOT, LARGE = 64, 512
#: Sets and shingles in a block at most, about.
BLOCK, BLOCK_SHINGLES = 512, 400_000
#: Members of a ball that get no index of their own.
FEW = 24
U64 = np.uint64
P1, P2 = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)
NODE = "node long, root long, block int, role int, data binary"


class Words(dict):
    """64-bit hash of a word."""

    def __missing__(self, word):
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


WORDS = Words()


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text; with fewer than five words, of the whole sequence."""
    words = (text or b"").translate(LOWER).split()
    if not words:
        return np.zeros(0, U64)
    w = np.fromiter(map(WORDS.__getitem__, words), U64, len(words))
    k = min(SHINGLE, len(w))
    n = len(w) - k + 1
    with np.errstate(over="ignore"):
        h = w[:n] + U64(k)
        for i in range(1, k):
            h = h * P1 + w[i : i + n]
    return np.unique(mix(h))


def linked(both: int, n: int, m: int) -> bool:
    return 100 * both >= PERCENT * (n + m - both)


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum()) if len(y) else 0


def plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def chunks(batches, most: int = CHUNK):
    """(ids, sets) of some megabytes of text at a time."""
    ids, sets, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
            ids.append(i)
            sets.append(shingle_set(t))
            size += len(t or b"")
            if size >= most:
                yield ids, sets
                ids, sets, size = [], [], 0
    if ids:
        yield ids, sets


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        a, b = int(mix(s * P2).sum(dtype=U64)), int(mix(s ^ P1).sum(dtype=U64))
    return a - (1 << 64) * (a >> 63), b - (1 << 64) * (b >> 63)


def summarise(batches):
    """Size and fingerprint of each document's set."""
    import pyarrow as pa

    for ids, sets in chunks(batches):
        prints = [fingerprint(s) for s in sets]
        cols = [ids, [len(s) for s in sets], [p[0] for p in prints], [p[1] for p in prints]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "n", "f1", "f2"])


def odd_numbers(n: int, seed: int) -> np.ndarray:
    return (mix(np.arange(1, n + 1, dtype=U64) * P1 + U64(seed)) >> U64(32)).astype(np.uint32) | np.uint32(1)


MUL, XOR = odd_numbers(BANDS * ROWS, 1), odd_numbers(BANDS * ROWS, 2)
#: Equal halves of a byte, by the exclusive or of two bytes.
EQUAL = np.array([(x & 15 == 0) + (x >> 4 == 0) for x in range(256)], np.uint8)


def minima(s: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set of shingles."""
    x, out = (s >> U64(32)).astype(np.uint32), np.full(len(MUL), 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(x), 1024):
        out = np.minimum(out, ((x[None, lo : lo + 1024] ^ XOR[:, None]) * MUL[:, None]).min(axis=1))
    return out


def signed(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, sketch) of each set, one row each."""
    low = np.array([minima(s) for s in sets], np.uint32).reshape(len(sets), BANDS * ROWS)
    sig = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U64) * P2, (len(sets), BANDS))
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            sig = mix((sig ^ low[:, k::ROWS].astype(U64)) * P1)
    half = (low[:, :: BANDS * ROWS // SKETCH] & np.uint32(15)).astype(np.uint8)
    return sig, half[:, ::2] | half[:, 1::2] << 4


def may_link(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, sketches: np.ndarray) -> np.ndarray:
    """Of the pairs (x, y) of rows, those whose sizes and sketches allow a link."""
    n, m = sizes[x], sizes[y]
    ok = 100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)
    at = np.flatnonzero(ok)
    ok[at] = EQUAL[sketches[x[at]] ^ sketches[y[at]]].sum(axis=1) >= AGREE
    return ok


def brought_together(sig: np.ndarray, docs: np.ndarray, sizes: np.ndarray, sketches: np.ndarray, open_: np.ndarray):
    """Edges (rows) between sets that a signature brings together; open_: signatures under which all come together."""
    at = np.lexsort((docs, sig))
    sig = sig[at]
    first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, np.int64)
    size = np.diff([*first, len(sig)])
    unasked = np.repeat((size > LARGE) | np.isin(sig[first], open_), size)
    start, size = np.repeat(first, size), np.repeat(size, size)
    # Each with the first of its run; whom that leaves out, with all the others.
    place = np.arange(len(sig))
    rest = np.flatnonzero(place != start)
    ok = unasked[rest]
    ok[~ok] = may_link(at[rest][~ok], at[start[rest]][~ok], sizes, sketches)
    a, b = [at[rest[ok]]], [at[start[rest[ok]]]]
    alone = np.zeros(len(sig), bool)
    alone[rest[~ok]] = True
    left = np.flatnonzero(alone)
    ends = np.cumsum(size[left])
    for lo, hi in spans(ends, 500_000):
        u = np.repeat(left[lo:hi], size[left[lo:hi]])
        v = start[u] + np.arange(len(u)) - np.repeat(ends[lo:hi] - size[left[lo:hi]] - (ends[lo - 1] if lo else 0), size[left[lo:hi]])
        pick = (v != start[u]) & (v != u) & (~alone[v] | (v < u))
        u, v = at[u[pick]], at[v[pick]]
        ok = may_link(u, v, sizes, sketches)
        a.append(u[ok])
        b.append(v[ok])
    return np.concatenate(a), np.concatenate(b)


def spans(ends: np.ndarray, most: int):
    """[lo, hi) ranges whose sums, ending at ends, are about `most` at most."""
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most)))
        yield lo, hi
        lo = hi


def sign(parts: int):
    """Signatures by bucket, with sizes and sketches, and edges between documents that met.

    Of the equal sets of a chunk of texts only one signs. Sets under one signature that are many in a chunk are brought
    together there and send on the least of them, so a signature of a third of all documents is one row a chunk.
    """
    import pyarrow as pa

    def run(batches):
        for ids, sets in chunks(batches, SIGNED):
            once: dict = {}
            for i, s in zip(ids, sets):
                if i is not None and len(s) > EQUAL_ONLY:
                    p = (len(s), *fingerprint(s))
                    if p not in once or i < once[p][0]:
                        once[p] = (i, s)
            if once:
                docs = np.array([i for i, _ in once.values()], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*packed(docs, [s for _, s in once.values()], parts)), (pa.int64(), pa.binary()))],
                    names=["key", "data"]
                )

    return run


def packed(docs: np.ndarray, sets: list[np.ndarray], parts: int):
    """(bucket, blob) rows of a chunk; see unpacked()."""
    sizes = np.array([len(s) for s in sets], np.int64)
    sig, sketches = signed(sets)
    at = np.repeat(np.arange(len(docs)), BANDS)
    sig = sig.ravel()
    o = np.lexsort((docs[at], sig))
    sig, at = sig[o], at[o]
    first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    size = np.diff([*first, len(sig)])
    hot = np.repeat(size > HOT, size)
    start = np.repeat(first, size)
    a, b = forest(docs[at[hot]], docs[at[start[hot]]])
    keep = ~hot | (start == np.arange(len(sig)))
    sig, at, hot = sig[keep], at[keep], hot[keep]
    there, bucket = (mix(b.view(U64)) % U64(parts)).astype(np.int64), (sig % U64(parts)).astype(np.int64)
    e, o = np.argsort(there, kind="stable"), np.argsort(bucket, kind="stable")
    a, b, there, sig, at, hot, bucket = a[e], b[e], there[e], sig[o], at[o], hot[o], bucket[o]
    keys = np.unique(np.concatenate([bucket, there]))
    for key, lo, hi, elo, ehi in zip(keys.tolist(), *(np.searchsorted(x, keys, side) for x in (bucket, there) for side in ("left", "right"))):
        rows = at[lo:hi]
        six = (sig[lo:hi] >> U64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
        head = np.array([hi - lo, ehi - elo], "<u4")
        yield key, b"".join(
            x.tobytes() for x in (
                head, docs[rows].astype("<i8"), a[elo:ehi].astype("<i8"), b[elo:ehi].astype("<i8"), sizes[rows].astype("<u4"),
                sketches[rows], hot[lo:hi].astype(np.uint8), six
            )
        )


def unpacked(bucket: int, data: bytes):
    """(documents, edges' ends, sizes, sketches, signatures, whether all come together); a row for each signature of a document."""
    n, e = np.frombuffer(data, "<u4", 2).tolist()
    out, at = [], 8
    for kind, k in (("<i8", n), ("<i8", e), ("<i8", e), ("<u4", n), ("u1", n * SKETCH // 2), ("u1", n), ("u1", 6 * n)):
        out.append(np.frombuffer(data, kind, k, at))
        at += out[-1].nbytes
    docs, a, b, sizes, sketches, hot, six = out
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :6] = six.reshape(n, 6)
    return docs, a, b, sizes.astype(np.int64), sketches.reshape(n, -1), wide.view("<u8").ravel() << U64(16) | U64(bucket & 0xFFFF), hot.astype(bool)


def meet(batches):
    """A bucket's signatures and edges to a spanning forest (document, least document of its tree)."""
    got = [unpacked(bucket, d) for batch in batches for bucket, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
    if got:
        docs, a, b, sizes, sketches, sig, hot = (np.concatenate(x) for x in zip(*got))
        x, y = brought_together(sig, docs, sizes, sketches, np.unique(sig[hot]))
        yield from edge_batches(*forest(np.concatenate([a, docs[x]]), np.concatenate([b, docs[y]])))


def divide_skip(lists: list[list[int]], need: int, mu: float = 0.01) -> list[int]:
    """Ids that stand in at least `need` of the sorted lists.

    The longest lists, L = need / (mu log M + 1) of them, are left to binary probes. The others are merged by a
    heap: an id in at least need - L of them is a candidate; else the heap pops as many ids as could not
    reach that, and their lists skip to the next id that still can.
    """
    if len(lists) < need or need <= 0:
        return []
    lists = sorted(lists, key=len)
    longest = len(lists[-1])
    n_long = min(int(need / (mu * max(1, longest.bit_length()) + 1)), need - 1, len(lists)) if longest > 1 else 0
    n_long = min(n_long, sum(1 for x in lists if len(x) > 4))
    short, long_ = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    least = need - n_long
    heap = [(x[0], k, 0) for k, x in enumerate(short) if x]
    heapq.heapify(heap)
    out = []
    while len(heap) >= least:
        top = heap[0][0]
        popped = []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap))
        count = len(popped)
        if count >= least:
            for k, x in enumerate(long_):
                if count >= need or count + len(long_) - k < need:
                    break
                at = bisect_left(x, top)
                count += at < len(x) and x[at] == top
            if count >= need:
                out.append(top)
            for _, k, at in popped:
                if at + 1 < len(short[k]):
                    heapq.heappush(heap, (short[k][at + 1], k, at + 1))
        else:
            # least - 1 - count more lists may go ahead too: their ids cannot be in enough lists.
            while heap and len(popped) < least - 1:
                popped.append(heapq.heappop(heap))
            if not heap:
                break
            goal = heap[0][0]
            for _, k, at in popped:
                at = bisect_left(short[k], goal, at)
                if at < len(short[k]):
                    heapq.heappush(heap, (short[k][at], k, at))
    return out


class Index:
    """Inverted lists of the sets added so far; ids rise."""

    def __init__(self):
        self.lists: dict[int, list[int]] = {}

    def add(self, number: int, tokens: list[int]) -> None:
        for t in tokens:
            if (x := self.lists.get(t)) is None:
                self.lists[t] = [number]
            else:
                x.append(number)

    def search(self, tokens: list[int], need: int) -> list[int]:
        get = self.lists.get
        return divide_skip([x for t in tokens if (x := get(t)) is not None], need)


class Linker:
    """Single linkage of sets, exact; adds them one by one and gives the links that connect components."""

    def __init__(self):
        self.leaders, self.sets, self.parent, self.balls, self.links = Index(), [], [], {}, []

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.links.append((y, x))

    def add(self, s: np.ndarray) -> None:
        x, n, tokens = len(self.sets), len(s), s.tolist()
        self.sets.append(s)
        self.parent.append(x)
        own, near = None, []
        for y in self.leaders.search(tokens, -(-3 * n // 5)):
            both, m = overlap(s, self.sets[y]), len(self.sets[y])
            if linked(both, n, m):
                self.join(x, y)
                own = y if own is None else own
            elif 5 * both >= 3 * (n + m - both):
                near.append(y)
        for y in near:
            # A leader alone in its ball has been compared already; few members are compared one by one.
            members = self.balls[y][0]
            if len(members) > 1 and self.root(x) != self.root(y):
                for z in members[1:] if len(members) <= FEW else self.ball(y).search(tokens, -(-PERCENT * n // 100)):
                    if linked(overlap(s, self.sets[z]), n, len(self.sets[z])):
                        self.join(x, z)
                        break
        if own is None:
            self.leaders.add(x, tokens)
            self.balls[x] = ([x], None, 0)
        else:
            self.balls[own][0].append(x)

    def ball(self, y: int) -> Index:
        members, index, done = self.balls[y]
        index = index or Index()
        for z in members[done:]:
            index.add(z, self.sets[z].tolist())
        self.balls[y] = (members, index, len(members))
        return index


def group_links(nodes: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect the components of a group, by node."""
    linker = Linker()
    order = sorted(range(len(nodes)), key=lambda k: nodes[k])
    for k in order:
        linker.add(sets[k])
    return [(nodes[order[a]], nodes[order[b]]) for a, b in linker.links]


def cross_links(nodes, sets, queries, asked) -> list[tuple[int, int]]:
    """A link of each query set with every component of the others that it links with; others are one block."""
    index, out = Index(), []
    for k, s in enumerate(sets):
        index.add(k, s.tolist())
    for q, s in zip(queries, asked):
        for k in index.search(s.tolist(), -(-PERCENT * len(s) // 100)):
            if nodes[k] != q and linked(overlap(s, sets[k]), len(s), len(sets[k])):
                out.append((min(q, nodes[k]), max(q, nodes[k])))
    return out


def groups_of(batches):
    """Whole groups of rows (node, root, block, role, data) sorted by root and block."""
    key, rows = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if (r["root"], r["block"]) != key:
                if rows:
                    yield rows
                key, rows = (r["root"], r["block"]), []
            rows.append(r)
    if rows:
        yield rows


def set_in(row: dict) -> np.ndarray:
    return shingle_set(zstandard.decompress(row["data"]))


def link_groups(batches):
    for rows in groups_of(batches):
        base = [r for r in rows if r["role"] == 0]
        ask = [r for r in rows if r["role"] == 1]
        sets = [set_in(r) for r in base]
        if ask:
            links = cross_links([r["node"] for r in base], sets, [r["node"] for r in ask], [set_in(r) for r in ask])
        else:
            links = group_links([r["node"] for r in base], sets)
        if links := [x for x in links if x[0] != x[1]]:
            yield from edge_batches(*np.array(links, np.int64).T)


def in_groups(rows: DataFrame, parts: int) -> DataFrame:
    rows = rows.select("node", "root", "block", "role", "data")
    return rows.repartition(parts, "root", "block").sortWithinPartitions("root", "block").mapInArrow(frugal(link_groups), "a long, b long")


def compressed(batches):
    import pyarrow as pa

    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([pack(t or b"") for t in as_bytes(batch.column(1))], pa.binary())], names=["doc_id", "text"]
        )


def links(rows: DataFrame, own: DataFrame) -> DataFrame:
    """Verified links (a, b), stored, that connect the components of the different sets.

    rows: doc_id, text. own: (doc_id, n_shingles, rep), rep the least document with the same set.
    """
    spark = rows.sparkSession
    parts = partitions(spark)
    met = rows.mapInArrow(
        frugal(sign(parts)), "key long, data binary"
    ).repartitionById(parts, F.col("key").cast("int")).mapInArrow(frugal(meet), "a long, b long")
    # A document's trees meet under it: what is left is about one edge a document, whatever the buckets.
    met = met.repartition(parts, "a").mapInArrow(frugal(merge_forests), "a long, b long")
    copies = own.where("rep < doc_id").groupBy("doc_id").agg(F.min("rep").alias("rep"))
    for end in ("a", "b"):
        met = met.join(copies.select(F.col("doc_id").alias(end), "rep"), end, "left").withColumn(end, F.coalesce("rep", end)).drop("rep")
    coarse = components(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    weights = own.where("rep = doc_id").groupBy(F.col("doc_id").alias("node")).agg(F.max("n_shingles").alias("n"))
    heavy = coarse.join(weights, "node")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int")
    placed = heavy.join(heavy.groupBy("root").agg(blocks.alias("blocks")), "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = stored(placed.select("node", "root", "n", "blocks", "block"))
    dropped(coarse)
    texts = rows.where("doc_id is not null").mapInArrow(frugal(compressed), "doc_id long, text binary")
    # Repeated rows of a doc_id are one node.
    # A merge join at every size: the nodes are no bounded number.
    sets = stored(texts.join(placed.hint("merge"), texts.doc_id == placed.node).select("node", "root", "n", "blocks", "block", F.col("text").alias("data")))
    base = sets.withColumn("role", F.lit(0))
    firsts = base.where("node = root and blocks > 1").withColumn(
        "at", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    ).where("at <> block").drop("block").withColumnRenamed("at", "block")
    found = stored(in_groups(base.unionByName(firsts), parts))
    large = placed.where("blocks > 1")
    if large.isEmpty():
        dropped(placed, sets)
        return found
    again = components(found)
    part = stored(large.join(again.withColumnRenamed("root", "part"), "node", "left").withColumn("part", F.coalesce("part", "node")))
    dropped(again)
    main = part.groupBy("root", "part").agg(F.count("*").alias("c")).groupBy("root").agg(F.max_by("part", F.struct("c", "part")).alias("main"))
    rest = stored(part.join(main, "root").where("part <> main").select("node", "root", "n", "blocks"))
    dropped(part)
    if not rest.isEmpty():
        # Each block meets each bounded lot of what the largest component lacks; block numbers name both.
        lots = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int")
        counts = rest.groupBy("root").agg(lots.alias("lots"))
        asking = rest.join(counts, "root").select("node", F.pmod(F.xxhash64("node", F.lit(7)), F.col("lots")).cast("int").alias("lot"), "lots")
        wide = sets.where("blocks > 1")
        asked = wide.join(asking, "node").withColumn(
            "at", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        ).withColumn("block", F.col("at") * F.col("lots") + F.col("lot")).withColumn("role", F.lit(1))
        there = wide.join(counts, "root").withColumn(
            "lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1))
        ).withColumn("block", F.col("block") * F.col("lots") + F.col("lot")).withColumn("role", F.lit(0))
        cols = ["node", "root", "block", "role", "data"]
        more = stored(in_groups(there.select(cols).unionByName(asked.select(cols)), parts))
        first, found = found, stored(found.unionByName(more))
        dropped(first, more)
    dropped(placed, sets, rest)
    return found


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    component_id is the smallest doc_id that links reach. A null, empty or blank text has no shingle and is
    linked with nothing; a null doc_id neither, and its component is null. doc_id is a key: repeated rows give
    repeated results. Other columns are ignored; an empty table gives no row.
    """
    small_batches(docs.sparkSession, 256)
    rows = plain(docs)
    summary = stored(rows.mapInArrow(frugal(summarise), "doc_id long, n long, f1 long, f2 long"))
    own = summary.withColumnRenamed("n", "n_shingles")
    same = own.where("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "f1", "f2").agg(
        F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")
    ).where("rep < last").drop("last")
    own = stored(
        own.join(same, ["n_shingles", "f1", "f2"], "left").select(
            "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id")).alias("rep")
        )
    )
    found = links(rows, own)
    roots = components(found)
    dropped(summary, found)
    return own.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "rep")).alias("component_id")
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without those that link, directly or not, with a smaller doc_id; rows without doc_id stay."""
    names = docs.columns
    keep = jaccard_components(docs).where("doc_id is not null and doc_id = component_id").select(F.col("doc_id").alias("_k")).distinct()
    own = docs.select(F.col("doc_id").cast("long").alias("_k"), F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"))
    first = own.where("_k is not null").join(keep, "_k", "left_semi").dropDuplicates(["_k"])
    return first.unionByName(own.where("_k is null")).select(*(F.col("_row").getField(c).alias(c) for c in names))
