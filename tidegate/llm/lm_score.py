"""LM scoring by masked pseudo-likelihood.

Every token of a text is predicted from the words on both sides: P(word | two words before, two after) =
P(class | window) * P(word | class). A network with one hidden layer, trained in numpy, gives the first factor; the
second comes from counts of all words of all documents. The sum of the logarithms scores a document.

Beside the network, the documents that are scored are witnesses for each other: where a word stands between two words, the
share of the other windows with these two that hold the same word is mixed in, the masked one left out. What is said
once gets nothing by this, what is said again elsewhere does. Only windows beside an uncommon word are looked up: others tell
little and are left to the network, and so no window that is looked up is a large share of all.

Counted over all documents: every word, for the vocabulary, the classes and the share of a word in its class. Words
outside the vocabulary have one class and one row of the network, and their own counts, which are joined. The network
is trained on every token of all documents, in rounds: a hash deals the documents to rounds, each task goes over its own
documents of the round, and the changes are averaged, each row of a table by how often a task used it. How documents lie in
tasks changes the averages a little, and so the scores.
"""

from __future__ import annotations

import copy
from collections import Counter

import numpy as np
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, frugal, mix, partitions, small_batches, stored

#: Words of the vocabulary, classes that are one word, classes of the rest; hidden units; words on each side.
VOCABULARY, SINGLE, SHARED, HIDDEN, SIDE = 16384, 40, 23, 16, 2
#: Where the rounds of training end, as shares of the documents; step.
ROUNDS, RATE = (1 / 16, 1 / 4, 1.0), 0.05
#: Less than one in so many tokens is an uncommon word. How many other windows weigh as much as the network.
UNCOMMON, BALANCE = 1 << 17, 1.0
#: Distinct words that a task counts before it hands them on; tokens taken together, tokens scored at once.
HELD_WORDS, AT_ONCE, CACHED = 400_000, 65_536, 4096
#: Lots of tasks whose changes are summed apart.
SALTS = 16
#: Tokens of a step on all documents, rows of a table that move together.
BATCH, BLOCK = 4096, 2048
#: Letters and digits lower-cased, bytes of longer characters as they are, all else between words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))


def tokens(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def count_words(batches):
    import pyarrow as pa

    def rows(seen):
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    seen: Counter = Counter()
    for batch in batches:
        for t in as_bytes(batch.column(1)):
            seen.update(tokens(t))
        if len(seen) > HELD_WORDS:
            yield rows(seen)
            seen = Counter()
    yield rows(seen)


class Numbers(dict):
    """Numbers of words; all others have one."""

    other = 0

    def __missing__(self, word):
        return self.other


class WindowModel:
    """Vocabulary, classes, and the network: sums of position tables through tanh to class scores."""

    def __init__(self, words: list[tuple[bytes, int]], rare_words: int, rare_tokens: int, seed: int = 5):
        self.words = Numbers((w, k) for k, (w, _) in enumerate(words))
        counts = np.array([n for _, n in words], float)
        v = self.rare = self.words.other = len(words)
        self.pad = v + 1
        cls = np.zeros(v + 1, np.int64)
        cls[: min(SINGLE, v)] = np.arange(min(SINGLE, v))
        if v > SINGLE:
            # The rest by frequency, in classes of about equal weight.
            mass = np.cumsum(counts[SINGLE:]) / counts[SINGLE:].sum()
            cls[SINGLE:v] = SINGLE + np.minimum((mass * SHARED).astype(int), SHARED - 1)
        cls[v] = SINGLE + SHARED
        self.cls = cls
        full = np.append(counts, max(rare_tokens, 1))
        weight = np.bincount(cls, full, minlength=SINGLE + SHARED + 1)
        inside = np.append(counts, weight[-1] / max(rare_words, 1))
        self.inside = np.log(inside / weight[cls])
        self.rare_level = float(np.log(inside[-1]))
        # Uncommon words, and all outside the vocabulary; padding is no word.
        self.telling = np.append(counts * UNCOMMON < counts.sum() + rare_tokens, [True, False])
        self.prior = np.log(np.maximum(weight, 0.5) / np.maximum(weight, 0.5).sum())
        rng = np.random.default_rng(seed)
        self.tables = (rng.standard_normal((2 * SIDE, v + 2, HIDDEN)) * 0.1).astype(np.float32)
        self.bias = np.zeros(HIDDEN, np.float32)
        self.out = (rng.standard_normal((HIDDEN, SINGLE + SHARED + 1)) * 0.1).astype(np.float32)
        self.out_bias = self.prior.astype(np.float32).copy()

    def ids(self, text: bytes | None) -> np.ndarray:
        return self.numbered(tokens(text))

    def numbered(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.words.__getitem__, words), np.int32, len(words))

    def windows(self, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(padded ids, places of tokens): documents one after the other with padding between."""
        gap = np.full(SIDE, self.pad, np.int32)
        padded = np.concatenate([gap, *(x for p in parts for x in (p, gap))])
        return padded, np.flatnonzero(padded != self.pad)

    def hidden(self, padded: np.ndarray, at: np.ndarray) -> np.ndarray:
        offsets = [o for o in range(-SIDE, SIDE + 1) if o]
        h = self.tables[0][padded[at + offsets[0]]]
        for k, o in enumerate(offsets[1:], 1):
            h += self.tables[k][padded[at + o]]
        h += self.bias
        return np.tanh(h, out=h)

    def bounded(self) -> bool:
        """Whether no score of a class can leave a float's range as an exponent: hidden units are between -1 and 1."""
        return float(np.abs(self.out).sum(axis=0).max() + np.abs(self.out_bias).max()) < 60

    def memory(self) -> list[np.ndarray]:
        return [np.full(x.shape, 1e-4, np.float32) for x in (self.tables, self.bias, self.out, self.out_bias)]

    def step(self, padded: np.ndarray, at: np.ndarray, memory: list[np.ndarray], rate: float = RATE) -> None:
        h = self.hidden(padded, at)
        s = h @ self.out + self.out_bias
        p = np.exp(s if self.bounded() else s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(at)), self.cls[padded[at]]] -= 1
        back = (p @ self.out.T) * (1 - h * h)
        for x, m, g in ((self.out, memory[2], h.T @ p), (self.out_bias, memory[3], p.sum(axis=0)), (self.bias, memory[1], back.sum(axis=0))):
            m += g * g
            x -= rate * g / np.sqrt(m)
        for k, o in enumerate(o for o in range(-SIDE, SIDE + 1) if o):
            near = padded[at + o]
            # Sixteen bits are sorted by digits.
            order = np.argsort(near.astype(np.uint16) if self.pad < 1 << 16 else near, kind="stable")
            near = near[order]
            starts = np.flatnonzero(np.r_[True, near[1:] != near[:-1]])
            rows, g = near[starts], np.add.reduceat(back[order], starts, axis=0)
            memory[0][k][rows] += g * g
            self.tables[k][rows] -= rate * g / np.sqrt(memory[0][k][rows])

    def changes(self, texts):
        """(block, change times weight and weight) of the parameters by one pass over all tokens of texts; no rows without a token."""
        own = copy.copy(self)
        own.tables, own.bias, own.out, own.out_bias = (x.copy() for x in (self.tables, self.bias, self.out, self.out_bias))
        memory, rng, total = own.memory(), np.random.default_rng(6), 0
        used = np.zeros(self.tables.shape[:2], np.float32)

        def learn(parts):
            padded, places = own.windows(parts)
            order = rng.permutation(places)
            for lo in range(0, len(order), BATCH):
                own.step(padded, order[lo : lo + BATCH], memory)
            for k, o in enumerate(o for o in range(-SIDE, SIDE + 1) if o):
                used[k] += np.bincount(padded[places + o], minlength=used.shape[1])
            return len(places)

        parts, held = [], 0
        for t in texts:
            parts.append(own.ids(t))
            held += len(parts[-1])
            if held >= AT_ONCE:
                total += learn(parts)
                parts, held = [], 0
        total += learn(parts) if held else 0
        if not total:
            return
        for k in range(2 * SIDE):
            for lo in range(0, used.shape[1], BLOCK):
                w = used[k, lo : lo + BLOCK, None]
                yield k * (1 << 20) + lo, np.hstack([(own.tables[k, lo : lo + BLOCK] - self.tables[k, lo : lo + BLOCK]) * w, w])
        yield -1, np.append(
            np.concatenate([(getattr(own, x) - getattr(self, x)).ravel() for x in ("bias", "out", "out_bias")]) * np.float32(total),
            np.float32(total)
        )

    def change(self, block: int, values: np.ndarray) -> None:
        """Applies a block's sum over all tasks."""
        if block >= 0:
            v = values.reshape(-1, HIDDEN + 1)
            k, lo = divmod(block, 1 << 20)
            self.tables[k, lo : lo + len(v)] += v[:, :-1] / np.maximum(v[:, -1:], 1)
            return
        v, at = values[:-1] / values[-1], 0
        for x in (self.bias, self.out, self.out_bias):
            x += v[at : at + x.size].reshape(x.shape)
            at += x.size

    def log_probs(self, parts: list[np.ndarray]) -> np.ndarray:
        """Conditional log-probability of each token of all parts, in order."""
        padded, places = self.windows(parts)
        out, bounded = np.zeros(len(places)), self.bounded()
        for lo in range(0, len(places), CACHED):
            at = places[lo : lo + CACHED]
            s = self.hidden(padded, at) @ self.out + self.out_bias
            top = np.float32(0) if bounded else s.max(axis=1)
            total = np.log(np.exp(s if bounded else s - top[:, None]).sum(axis=1)) + top
            token = padded[at]
            out[lo : lo + CACHED] = s[np.arange(len(at)), self.cls[token]].astype(float) - total + self.inside[token]
        return out

    def score(self, texts: list[bytes | None]) -> tuple[list[int], list[float]]:
        """(tokens, sum of their log-probabilities) of each text."""
        return self.score_ids([self.ids(t) for t in texts])

    def score_ids(self, parts: list[np.ndarray], logs: np.ndarray | None = None) -> tuple[list[int], list[float]]:
        n = [len(p) for p in parts]
        sums = np.concatenate([[0.0], np.cumsum(self.log_probs(parts) if logs is None else logs)])
        ends = np.cumsum(n)
        return n, [float(x) for x in sums[ends] - sums[ends - np.array(n, int)]] if n else []

    def looked_up(self, parts: list[np.ndarray], words: list[list[bytes]], logs: np.ndarray) -> tuple[np.ndarray, ...]:
        """(document, hash of the neighbours with that of the word in its last 16 bits, logarithm of the word's probability) of the windows that other documents may witness."""
        named = [x.astype(np.uint64) for x in parts]
        for x, own in zip(named, words):
            rare = np.flatnonzero(x == self.rare)
            x[rare] = hashes([own[k] for k in rare])
        padded, places = self.windows(parts)
        left, right = padded[places - 1], padded[places + 1]
        some = np.flatnonzero((self.telling[left] | self.telling[right]) & (left != self.pad) & (right != self.pad))
        gap = np.zeros(SIDE, np.uint64)
        spread = np.concatenate([gap, *(x for p in named for x in (p, gap))])
        at = places[some]
        key, word = mix(mix(spread[at - 1]) ^ spread[at + 1] * ODD), mix(spread[at])
        doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])[some]
        return doc, key >> WORD_BITS << WORD_BITS | word >> np.uint64(48), logs[some]


def witnessed(code: np.ndarray, log: np.ndarray) -> np.ndarray:
    """What each window's logarithm gains by the other windows with its neighbours; all of them are given."""
    o = np.argsort(code)
    code, log = code[o], log[o]
    if not len(o):
        return log
    key = code >> WORD_BITS
    new_key, new = (np.concatenate([[True], x[1:] != x[:-1]]) for x in (key, code))
    total, same = (np.diff([*np.flatnonzero(x), len(o)])[np.cumsum(x) - 1] - 1.0 for x in (new_key, new))
    weight = total / (total + BALANCE)
    share = same / np.maximum(total, 1)
    gain = np.zeros(len(o))
    some = np.flatnonzero(total)
    gain[o[some]] = np.log((1 - weight[some]) * np.exp(log[some]) + weight[some] * share[some]) - log[some]
    return gain


def counted(docs: DataFrame) -> DataFrame:
    """(word, n) of every word of all documents."""
    return stored(plain(docs).mapInArrow(count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))


def fit(docs: DataFrame, counts: DataFrame | None = None) -> WindowModel:
    """Counts all words of all documents, then trains the network on each document once: a sixteenth of them, then more, then the rest."""
    rows = plain(docs)
    counts = counted(docs) if counts is None else counts
    # The network's vocabulary is bounded, so these rows are.
    words = [(bytes(r.word), r.n) for r in counts.orderBy(F.desc("n"), "word").limit(VOCABULARY).collect()]
    total = counts.agg(F.count("*").alias("words"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).first()
    model = WindowModel(words, total.words - len(words), total.tokens - sum(n for _, n in words))
    lot = F.pmod(F.xxhash64("doc_id", "text", F.lit(23)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    for low, high in zip((0.0, *ROUNDS), ROUNDS):
        train_on_all(rows.where((lot >= low) & (lot < high)), model)
    return model


def summed(batches):
    """(block, salt, v) to one row for each block of the task, its sum; rows stream by."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, v in zip(batch.column(0).to_pylist(), batch.column(2)):
            x = np.frombuffer(v.as_buffer(), np.float32).astype(float)
            total[block] = total[block] + x if block in total else x
    for block, x in total.items():
        yield change_row(block, 0, x)


def change_row(block: int, salt: int, v: np.ndarray):
    import pyarrow as pa

    cols = ([block], pa.int64()), ([salt], pa.int64()), ([v.astype(np.float32).tobytes()], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in cols], names=["block", "salt", "v"])


def train_on_all(rows: DataFrame, model: WindowModel) -> None:
    """A pass over every token of the rows: tasks' changes are summed by block, by lots of tasks first, so the driver gets one model."""
    from pyspark import TaskContext

    small_batches(rows.sparkSession, 256)
    shared, parts = rows.sparkSession.sparkContext.broadcast(model), partitions(rows.sparkSession)
    schema = "block long, salt long, v binary"

    def learn(batches):
        salt = TaskContext.get().partitionId() % SALTS
        for block, v in shared.value.changes(t for batch in batches for t in as_bytes(batch.column(1))):
            yield change_row(block, salt, v)

    lots = rows.mapInArrow(learn, schema).repartition(parts, "block", "salt").mapInArrow(summed, schema)
    for r in lots.repartition(parts, "block").mapInArrow(summed, schema).collect():
        model.change(r.block, np.frombuffer(bytes(r.v), np.float32))


#: Kinds of packed rows: counts of words, rare words of documents, sums for documents, documents, windows of documents.
COUNTS, RARE, SUMS, DOCS, WINDOWS = range(5)
KINDS = {
    COUNTS: ("<u8", "<i8"), RARE: ("<u8", "<i8", "<i4"), SUMS: ("<i8", "<f8"), DOCS: ("<i8", "<i8", "<i8", "<f8", "u1"),
    WINDOWS: ("<u8", "<f2", "<i8")
}


def dealt(kind: int, bucket: np.ndarray, *arrays: np.ndarray):
    """A record batch of (key, kind, data): parallel arrays, packed by bucket."""
    import pyarrow as pa

    o = np.argsort(bucket.astype(np.uint16) if len(bucket) and bucket.max() < 1 << 16 else bucket, kind="stable")
    bucket, arrays = bucket[o], [x[o].astype(k) for x, k in zip(arrays, KINDS[kind])]
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])).tolist() if len(o) else []
    if kind in ROW:
        row = arrays[ROW[kind]]
        first = row[cut]
        row[1:] -= row[:-1].copy()
        row[cut] = first
    data = [zstandard.compress(b"".join(x[lo:hi].tobytes() for x in arrays), 1) for lo, hi in zip(cut, [*cut[1:], len(o)])]
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[cut], pa.int32()), pa.array([kind] * len(cut), pa.int32()), pa.array(data, pa.binary())],
        names=["key", "kind", "data"]
    )


def gathered(blobs: list[bytes], kind: int) -> list[np.ndarray]:
    """The arrays of blobs of dealt(), put together."""
    out: list[list[np.ndarray]] = [[np.zeros(0, k)] for k in KINDS[kind]]
    width = sum(np.dtype(k).itemsize for k in KINDS[kind])
    for blob in blobs:
        data, at = zstandard.decompress(blob), 0
        n = len(data) // width
        for x, k in zip(out, KINDS[kind]):
            x.append(np.frombuffer(data, k, n, at))
            at += x[-1].nbytes
        if kind in ROW:
            out[ROW[kind]][-1] = np.cumsum(out[ROW[kind]][-1])
    return [np.concatenate(x) for x in out]


ODD, WORD_BITS = np.uint64(0x9E3779B97F4A7C15), np.uint64(16)
#: Columns of rows that are in order of a document's row: differences are stored.
ROW = {RARE: 1, WINDOWS: 2}


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def own_counts(rare_level: float, parts: int):
    """A bucket's words and windows to what they add to the documents that have them; documents pass."""

    def run(batches):
        held: dict = {COUNTS: [], RARE: [], WINDOWS: []}
        for batch in batches:
            keep = pc.equal(batch.column(1), DOCS)
            yield batch.filter(keep)
            rest = batch.filter(pc.invert(keep))
            for kind, data in zip(rest.column(1).to_pylist(), rest.column(2).to_pylist()):
                held[kind].append(data)
        (word, n), (used, row, times) = (gathered(held[k], k) for k in (COUNTS, RARE))
        o = np.argsort(word)
        word, n = word[o], n[o]
        at = np.minimum(np.searchsorted(word, used), max(0, len(word) - 1))
        known = word[at] == used if len(word) else np.zeros(len(used), bool)
        code, log, asked = gathered(held[WINDOWS], WINDOWS)
        row = np.concatenate([row[known], asked])
        rows, where = np.unique(row, return_inverse=True)
        gains = np.concatenate([times[known] * (np.log(n[at[known]]) - rare_level), witnessed(code, log.astype(float))])
        more = np.bincount(where, gains, minlength=len(rows)) if len(rows) else np.zeros(0)
        yield dealt(SUMS, rows % parts, rows, more)

    return run


def finished(batches):
    """A bucket's documents with what their rare words add."""
    import pyarrow as pa

    held: dict = {SUMS: [], DOCS: []}
    for batch in batches:
        for kind, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            held[kind].append(data)
    (row, more), (docs, ids, n, pll, no_id) = (gathered(held[k], k) for k in (SUMS, DOCS))
    o = np.argsort(docs)
    docs, ids, n, pll, no_id = docs[o], ids[o], n[o], pll[o], no_id[o]
    pll = pll + np.bincount(np.searchsorted(docs, row), more, minlength=len(docs))[: len(docs)] if len(docs) else pll
    for lo in range(0, len(docs), 8192):
        cut = slice(lo, lo + 8192)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[cut], pa.int64(), mask=no_id[cut].astype(bool)), pa.array(n[cut], pa.int64()), pa.array(pll[cut], pa.float64())],
            names=["doc_id", "n_tokens", "pll"]
        )


def scored(docs: DataFrame, model: WindowModel, counts: DataFrame | None = None, witnesses: bool = False) -> DataFrame:
    """doc_id, n_tokens, pll, pll_per_token of every whole text.

    With counts, words outside the vocabulary have the share of their own count in their class; without, its mean. With
    witnesses, docs' other windows are mixed in. Rare words, counts and windows are dealt by hash (64 bits, taken for the
    words) and meet in arrays, so no token is a row; no word or window that is dealt is a large share of all.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    small_batches(spark, 256)
    shared = spark.sparkContext.broadcast(model)
    parts, apart = partitions(spark), counts is not None
    packed = "key int, kind int, data binary"

    def run(batches):
        m = shared.value
        for batch in batches:
            words = [tokens(t) for t in as_bytes(batch.column(1))]
            ids = [m.numbered(x) for x in words]
            logs = m.log_probs(ids)
            n, s = m.score_ids(ids, logs)
            rows = np.array(batch.column(2).to_pylist(), np.int64)
            doc = batch.column(0)
            yield dealt(
                DOCS, rows % parts, rows, np.array(doc.fill_null(0).to_pylist(), np.int64), np.array(n, np.int64), np.array(s, float),
                np.array(doc.is_null().to_pylist(), bool)
            )
            if apart:
                rare = [np.unique(hashes([x[k] for k in np.flatnonzero(i == m.rare)]), return_counts=True) for x, i in zip(words, ids)]
                word, times = (np.concatenate(x) for x in zip(*rare))
                yield dealt(RARE, (word % np.uint64(parts)).astype(np.int64), word, np.repeat(rows, [len(h) for h, _ in rare]), times)
            if witnesses and len(logs):
                at, code, log = m.looked_up(ids, words, logs)
                yield dealt(WINDOWS, ((code >> WORD_BITS) % np.uint64(parts)).astype(np.int64), code, log, rows[at])

    def pack(batches):
        for batch in batches:
            word = hashes(batch.column(0).to_pylist())
            yield dealt(COUNTS, (word % np.uint64(parts)).astype(np.int64), word, batch.column(1).to_numpy())

    to = lambda df: df.repartitionById(parts, "key")
    out = plain(docs).withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, packed)
    if apart:
        out = out.unionByName(counts.select("word", "n").mapInArrow(pack, packed))
    if apart or witnesses:
        out = to(out).mapInArrow(frugal(own_counts(model.rare_level, parts)), packed)
    out = to(out).mapInArrow(frugal(finished), "doc_id long, n_tokens long, pll double")
    return out.select("doc_id", "n_tokens", "pll", F.when(F.col("n_tokens") > 0, F.col("pll") / F.col("n_tokens")).alias("pll_per_token"))


def lm_scores(docs: DataFrame) -> DataFrame:
    """Fits on docs and scores all of docs.

    A text without a word (null, empty) has 0 tokens, pll 0 and no pll_per_token. Repeated rows count as often as they
    come and score alike. Other columns are ignored; an empty table gives no row.
    """
    counts = counted(docs)
    return scored(docs, fit(docs, counts), counts, True)
