"""Phrase collocation mining with pivot partitioning.

Texts are coded once: chunks of codes with the chunk's words. Word counts are sums over chunks. The frequent words' counts
go, folded into a table of fixed size, to all tasks, which rewrite the codes: a word too rare for any phrase is blank. The
pivot of an n-gram is its rarest word, the first of equally rare ones. For every place of a word, the stretch around it in
which it is the pivot, at most three words to each side, is a fragment; equal fragments of a chunk are one with a count.
Fragments go to their pivot's bucket. There n-grams around the pivot are counted: each occurrence in one bucket only, so a
count is final where it is made. A pivot that would fill a bucket is dealt over all of them, and its counts are added up.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LOWER, dropped, frugal, mix, small_batches, stored

#: A phrase occurs at least LEAST times and has 2 to LONGEST words; the best TOP of each language are returned.
LEAST, LONGEST, TOP = 30, 4, 2000
#: A phrase goes if a longer one that holds it occurs at least COVERED percent as often.
COVERED = 80
#: Scores are whole numbers of 1 / SCALE.
SCALE = 1_000_000
#: Words of a chunk; bytes that are split at once; words whose fragments one bucket should hold.
CHUNK, SLICE, BUCKET = 1 << 19, 4 << 20, 6 << 20
#: Entries of the table of words' counts that goes to all tasks, 8 bytes each. With more frequent words than entries, counts
#: of words that share one are added: fewer words are blank and pivots less rare, with the same result.
SLOTS = 1 << 20
#: So many of the commonest words have codes that all tasks know; others are named in each row that has them.
KNOWN = 49_151

# Separators become full stops, which no word can hold; what is left of white space separates words.
TABLE = bytes(46 if b in b".,;:!?\x0a\x0b\x0c\x0d" else LOWER[b] for b in range(256))
SIDE = LONGEST - 1
SPAN = 2 * SIDE + 1

CODED = "lang string, words array<binary>, counts array<long>, codes binary"
ROUTED = "bucket int, wide boolean, lang string, words array<binary>, n int, width int, places binary"


def slices(text: bytes):
    """(words, whether a piece ends after them) of a text, some megabytes at a time; a piece's end is the word b'.'."""
    text = text.translate(TABLE).replace(b".", b" . ")
    at = 0
    while len(text) - at > SLICE:
        stop = text.rfind(b" . ", at, at + SLICE)
        whole = stop >= 0
        stop = stop + 2 if whole else text.find(b" ", at + SLICE)
        if stop < 0:
            break
        yield text[at:stop].split(), whole
        at = stop
    yield [*text[at:].split(), b"."], True


class Chunk:
    """Codes of words in order of appearance, 0 between pieces."""

    def __init__(self):
        self.code, self.parts, self.size = defaultdict(count().__next__), [], 0
        self.code[b"."]

    def add(self, words: list[bytes]) -> None:
        self.parts.append(np.fromiter(map(self.code.__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def columns(self) -> tuple:
        codes, words = np.concatenate(self.parts), list(self.code)[1:]
        kind = np.uint16 if len(words) < 1 << 16 else np.int32
        return words, np.bincount(codes, minlength=len(words) + 1)[1:].tolist(), codes.astype(kind).tobytes()


def coded(docs: DataFrame) -> DataFrame:
    """Texts as chunks of codes, of one language each."""
    import pyarrow as pa

    def run(batches):
        chunks: dict[str, Chunk] = defaultdict(Chunk)

        def row(lang):
            words, counts, codes = chunks.pop(lang).columns()
            return pa.RecordBatch.from_arrays(
                [pa.array([lang]), pa.array([words], pa.list_(pa.binary())), pa.array([counts], pa.list_(pa.int64())), pa.array([codes], pa.binary())],
                names=["lang", "words", "counts", "codes"]
            )

        held = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                for words, whole in slices(text.as_buffer().to_pybytes()):
                    chunks[lang].add(words)
                    held += len(words)
                    if whole and chunks[lang].size >= CHUNK:
                        held -= chunks[lang].size
                        yield row(lang)
                while held >= 4 * CHUNK:  # many languages side by side
                    most = max(chunks, key=lambda k: chunks[k].size)
                    held -= chunks[most].size
                    yield row(most)
        for lang in list(chunks):
            yield row(lang)

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.where(F.length("text") > 0).mapInArrow(frugal(run), CODED)


def slot(lang: str, words: list[bytes]) -> np.ndarray:
    seed = zlib.crc32(lang.encode() + b"\0")
    return np.fromiter((zlib.crc32(w, seed) for w in words), np.int64, len(words))


def rarity_table(words: DataFrame, least: int, slots: int) -> np.ndarray:
    """Counts of the words that occur often enough, added up by slot: an upper bound of each word's count, 0 for most rare words."""
    at = F.crc32(F.concat(F.col("lang").cast("binary"), F.lit(b"\0"), F.col("word").cast("binary"))) % slots
    found = words.where(F.col("n") >= least).groupBy(at.alias("at")).agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(slots, np.int64)
    out[found["at"].to_numpy()] = found["n"].to_numpy()
    return out


def fragments(codes: np.ndarray, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, pivots' codes): a row for each word that is the pivot of some n-gram, with its neighbours' codes around it, 0 beyond.

    codes has SIDE zeros at both ends. To the left all words are more frequent, to the right none is rarer.
    """
    r = rarity[codes]
    n = len(codes) - 2 * SIDE
    own, places = r[SIDE : SIDE + n], np.zeros((n, SPAN), np.int32)
    places[:, SIDE] = codes[SIDE : SIDE + n]
    linked = np.zeros(n, bool)
    for step, better in ((-1, np.greater), (1, np.greater_equal)):
        open_ = own > 0
        for j in range(step, step * LONGEST, step):
            open_ = open_ & better(r[SIDE + j : SIDE + j + n], own)
            places[:, SIDE + j] = np.where(open_, codes[SIDE + j : SIDE + j + n], 0)
            if abs(j) == 1:
                linked |= open_
    return places[linked], places[linked, SIDE]


def combined(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different rows of codes, and the sums of their counts. Sorted by a hash; should two rows share one, by themselves."""
    if not len(rows):
        return rows, counts
    h = hashed(rows)
    order = np.argsort(h)
    new = np.ones(len(h), bool)
    new[1:] = h[order][1:] != h[order][:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    if (rows[order] != rows[order[first]]).any():
        rows, at = np.unique(rows, axis=0, return_inverse=True)
        total = np.zeros(len(rows), np.int64)
        np.add.at(total, at.ravel(), counts)
        return rows, total
    starts = np.flatnonzero(new)
    return rows[order[starts]], np.add.reduceat(counts[order], starts)


def hashed(rows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(rows), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(rows.shape[1]):
            h = (h ^ rows[:, j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return mix(h)


def packed(places: np.ndarray, counts: np.ndarray) -> tuple[int, bytes]:
    """(bytes of a code, compressed columns) of fragments in order of their pivots: the columns, then the counts."""
    import pyarrow as pa

    kind = np.uint16 if places.max() < 1 << 16 else np.int32
    raw = np.ascontiguousarray(places.T.astype(kind)).tobytes() + counts.astype(np.int32).tobytes()
    return np.dtype(kind).itemsize, pa.Codec("zstd", 1).compress(raw, asbytes=True)


def unpacked(row: dict) -> tuple[np.ndarray, np.ndarray]:
    import pyarrow as pa

    n, width = row["n"], row["width"]
    raw = pa.Codec("zstd", 1).decompress(row["places"], n * (SPAN * width + 4)).to_pybytes()
    places = np.frombuffer(raw, np.uint16 if width == 2 else np.int32, SPAN * n).reshape(SPAN, n).T.astype(np.int32)
    return places, np.frombuffer(raw, np.int32, n, SPAN * width * n).astype(np.int64)


def routed(chunks: DataFrame, rarity, common, total: int, buckets: int) -> DataFrame:
    """Fragments by their pivot's bucket; those of a pivot with more words than a bucket's share are wide and dealt over all buckets.

    The first codes stand for the common words, those after them for the row's own.
    """
    import pyarrow as pa

    def run(batches):
        table, places_of = rarity.value, {w: i for i, w in enumerate(common.value, 1)}
        for batch in batches:
            for row in batch.to_pylist():
                lang, words = row["lang"], row["words"]
                codes = np.frombuffer(row["codes"], np.uint16 if len(words) < 1 << 16 else np.int32).astype(np.int32)
                at = np.concatenate([[0], slot(lang, words)])
                rare = table[at % len(table)]
                rare[0] = 0
                everywhere = np.fromiter((places_of.get(w, 0) for w in (None, *words)), np.int32, len(words) + 1)
                codes = np.concatenate([np.zeros(SIDE, np.int32), codes, np.zeros(SIDE, np.int32)])
                spread = mix(at.astype(np.uint64) + np.uint64(1))
                for lo in range(0, len(codes) - 2 * SIDE, CHUNK):
                    yield from sent(lang, [None, *words], rare, everywhere, spread, codes[lo : lo + CHUNK + 2 * SIDE])

    def sent(lang, words, rare, everywhere, spread, codes):
        places, _ = fragments(codes, rare)
        places, counts = combined(places, np.ones(len(places), np.int64))
        if not len(places):
            return
        pivots = places[:, SIDE]
        wide = rare[pivots] > total // buckets
        key = spread[pivots]
        key = np.where(wide, mix(key ^ hashed(places)), key)
        group = (key % np.uint64(buckets)).astype(np.int64) * 2 + wide
        order = np.argsort(group << 32 | pivots)
        places, counts, group = places[order], counts[order], group[order]
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        rows = []
        for lo, hi in zip(starts, [*starts[1:], len(group)]):
            part = places[lo:hi]
            own = np.unique(part[(everywhere[part] == 0) & (part > 0)])
            names = everywhere.copy() if len(own) else everywhere
            names[own] = len(common.value) + 1 + np.arange(len(own))
            rows.append((int(group[lo]) // 2, bool(group[lo] % 2), lang, [words[k] for k in own.tolist()], hi - lo, *packed(names[part], counts[lo:hi])))
        kinds = (pa.int32(), pa.bool_(), pa.string(), pa.list_(pa.binary()), pa.int32(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["bucket", "wide", "lang", "words", "n", "width", "places"])

    return chunks.mapInArrow(frugal(run), ROUTED)


def mined(rows: DataFrame, common, least: int) -> DataFrame:
    """(lang, phrase, a): counts of the n-grams of 2 to LONGEST words that each bucket's pivots own; of wide pivots, parts of counts."""
    import pyarrow as pa

    def counted(places, counts, least):
        """(n-grams, counts) of one length after another."""
        for length in range(2, LONGEST + 1):
            windows, weights, hashes = [], [], []
            for start in range(SIDE - length + 1, SIDE + 1):
                has = (places[:, start] > 0) & (places[:, start + length - 1] > 0)
                windows.append(places[has, start : start + length])
                weights.append(counts[has])
                hashes.append(hashed(windows[-1]) & np.uint64((1 << 20) - 1))
            # What falls with others on one of a million sums and still is too rare needs no sorting.
            sums = np.zeros(1 << 20)
            for h, c in zip(hashes, weights):
                sums += np.bincount(h.astype(np.int64), c, minlength=1 << 20)
            often = [sums[h.astype(np.int64)] >= least for h in hashes]
            grams, n = combined(np.concatenate([w[o] for w, o in zip(windows, often)]), np.concatenate([c[o] for c, o in zip(weights, often)]))
            yield grams[n >= least], n[n >= least]

    def finish(lang, wide, names, parts):
        places, counts = combined(np.concatenate([p for p, _ in parts]), np.concatenate([c for _, c in parts]))
        for grams, n in counted(places, counts, 1 if wide else least):
            for lo in range(0, len(grams), 100_000):
                text = [b" ".join([names[k] for k in g]).decode() for g in grams[lo : lo + 100_000].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(text), pa.string()), pa.array(text, pa.string()), pa.array(n[lo : lo + 100_000])], names=["lang", "phrase", "a"])

    def run(batches):
        fixed = [b"", *common.value]
        at, code, parts = None, None, []

        def names():
            return fixed + list(code)

        for batch in batches:
            for row in batch.to_pylist():
                key = row["bucket"], row["lang"], row["wide"]
                if key != at:
                    if parts:
                        yield from finish(at[1], at[2], names(), parts)
                    at, code, parts = key, defaultdict(count(len(fixed)).__next__), []
                places, counts = unpacked(row)
                own = np.fromiter(map(code.__getitem__, row["words"]), np.int32, len(row["words"]))
                local = places >= len(fixed)
                places[local] = own[places[local] - len(fixed)]
                parts.append((places, counts))
        if parts:
            yield from finish(at[1], at[2], names(), parts)

    return rows.mapInArrow(frugal(run), "lang string, phrase string, a long")


def ngram_counts(docs: DataFrame, least: int = LEAST, slots: int = SLOTS, bucket: int = BUCKET, known: int = KNOWN) -> tuple[DataFrame, DataFrame]:
    """(lang, word, n) of all words, and (lang, phrase, a) of the n-grams that occur at least so often; both stored."""
    spark = docs.sparkSession
    small_batches(spark)
    chunks = stored(coded(docs))
    words = chunks.select("lang", F.inline(F.arrays_zip(F.col("words").alias("word"), F.col("counts").alias("n"))))
    words = stored(words.groupBy("lang", F.col("word").cast("string").alias("word")).agg(F.sum("n").alias("n")))
    total = words.agg(F.sum("n")).first()[0] or 0
    rarity = spark.sparkContext.broadcast(rarity_table(words, least, slots))
    most = words.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(known).collect()
    common = spark.sparkContext.broadcast([r.word.encode() for r in most])
    buckets = max(1, -(-total // bucket))
    rows = routed(chunks, rarity, common, total, buckets).repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "lang", "wide")
    # Wide pivots' parts come together; all other counts are alone here.
    grams = stored(mined(rows, common, least).groupBy("lang", "phrase").agg(F.sum("a").alias("a")).where(F.col("a") >= least))
    dropped(chunks)
    return words, grams


def collocations(
    docs: DataFrame, least: int = LEAST, top: int = TOP, covered: int = COVERED, scale: int = SCALE, slots: int = SLOTS, bucket: int = BUCKET, known: int = KNOWN
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases.

    A-Z become a-z; texts are split at separators and line ends, pieces at spaces and tabs; phrases do not cross pieces. A
    null lang is `und`, together with rows that say so; null and empty texts have no words; a language without phrases has
    no row. Of equal scores the more frequent phrase is first, then the first in byte order. Repeated rows count again.
    Other columns, doc_id included, are ignored. Tasks hold a chunk or a bucket; the driver holds the table of counts and
    the commonest words, both of fixed size.
    """
    words, grams = ngram_counts(docs, least, slots, bucket, known)
    grams = grams.withColumn("ws", F.split("phrase", " "))
    n = F.size("ws")
    inner = F.flatten(
        F.transform(F.sequence(F.lit(2), n - 1), lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice("ws", i, k), " ")))
    )
    holders = grams.where(n > 2).select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = grams.join(holders, ["lang", "phrase"], "left").where(F.coalesce(F.col("longer") * 100 < F.col("a") * covered, F.lit(True)))
    counts = words.where(F.col("n") >= least).select("lang", F.col("word").alias("part"), F.col("n").alias("f")).unionByName(
        grams.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    )
    cuts = kept.select("lang", "phrase", "a", "ws", F.explode(F.sequence(F.lit(1), n - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("ws", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("ws", F.col("k") + 1, n), " ").alias("rest")
    )
    for side, name in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(counts.select("lang", F.col("part").alias(side), F.col("f").alias(name)), ["lang", side])
    score = F.expr(f"(CAST({2 * scale} AS DECIMAL(10,0)) * CAST(a AS DECIMAL(20,0))) DIV (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.cast("long").alias("score"), "k", "l", "r")).alias("cut"))
    best = best.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # First the best of parts of a language, then of what these leave: no task sorts a language's phrases.
    some = best.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order)))
    some = some.where(F.col("rank") <= top).withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return some.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: The same, from all n-grams of all pieces.
ORACLE = f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM w, (SELECT unnest(range(1, {LONGEST + 1})) AS k) WHERE len(ws) >= k),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, k AS len, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= {LEAST}),
i AS (SELECT c.lang, array_to_string(c.ws[x:x + y - 1], ' ') AS phrase, max(c.a) AS longer FROM c, (SELECT unnest(range(1, {LONGEST + 1})) AS x), (SELECT unnest(range(2, {LONGEST})) AS y) WHERE y < len AND x + y - 1 <= len GROUP BY ALL),
s AS (SELECT c.lang, c.phrase, c.a, c.len, c.ws FROM c LEFT JOIN i ON i.lang = c.lang AND i.phrase = c.phrase WHERE i.longer IS NULL OR 100 * i.longer < {COVERED} * c.a),
u AS (SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS first, array_to_string(ws[k + 1:len], ' ') AS rest FROM s, (SELECT unnest(range(1, {LONGEST})) AS k) WHERE k < len),
v AS (SELECT u.lang, u.phrase, u.a, u.k, x.f AS l, y.f AS r, CAST(CAST({2 * SCALE} AS HUGEINT) * u.a // (x.f + y.f) AS BIGINT) AS score FROM u JOIN f x ON x.lang = u.lang AND x.phrase = u.first JOIN f y ON y.lang = u.lang AND y.phrase = u.rest),
b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n.n, score FROM b JOIN n ON n.lang = b.lang QUALIFY rank <= {TOP}
"""
