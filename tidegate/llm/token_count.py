"""Token counts by the whole-token shortcut.

Most pre-tokens of a text are themselves strings of the vocabulary. Whether such a string encodes alone as that one
token is a property of the vocabulary, so it is proved once, before any text is read: the merges are run on every string
of the vocabulary, and those that end as a single token are kept. A pre-token among them counts one without a merge; only
the others are merged.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import LATER_ASSIGNED, ForcedBoundaryBpe, byte_names, odd
from .common import small_batches

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_whole long, n_merged long"
#: A document with more tokens is over the limit.
LIMIT = 512
#: Counts of merged pre-tokens of at most so many characters are remembered, so many of them at a time.
CACHE_CHARS, CACHE_PIECES = 40, 500_000

# The byte-level pre-tokenizer's pattern. The first form is right for all texts, the second, in the
# standard library's terms, for texts without odd() characters.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
PLAIN = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
CONTROL = re.compile(r"[\x1c-\x1f]")
# Letters and digits that this pre-tokenizer's tables don't have. Its split knows U+A7CC, and lacks two more.
LATER = re.compile(f"(?!\ua7cc){LATER_ASSIGNED.pattern}|[\ua7ce\ua7dd]")


def pretokens(text: str) -> list[str]:
    """The pieces that are encoded apart, in order; joined they are the text."""
    if not CONTROL.search(text) and (text.isascii() or odd().isdisjoint(text)):
        return PLAIN.findall(text)
    # What Unicode assigned after the tokenizer's tables is a symbol to it.
    return [text[m.start() : m.end()] for m in PATTERN.finditer(LATER.sub("\u2603", text))]


class Merges(ForcedBoundaryBpe):
    """A byte-level vocabulary's merges; merged() is inherited, the word-end form's tables are not needed."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab = spec["model"]["vocab"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.names = byte_names()
        pairs = [p if isinstance(p, list) else p.split(" ") for p in spec["model"]["merges"]]
        self.rank = {(self.vocab[a], self.vocab[b]): r for r, (a, b) in enumerate(pairs)}
        self.made = [self.vocab[a + b] for a, b in pairs]
        self.none = len(pairs)
        self.first = [self.vocab[c] for c in self.names]

    def ids(self, raw: bytes) -> list[int]:
        return self.merged([self.first[b] for b in raw])


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(path)


@lru_cache(maxsize=2)
def proved(path: str) -> frozenset[str]:
    """The strings of the vocabulary that encode alone as their one token, as text; those that are no text of their own are left out."""
    m = merges(path)
    number = {c: b for b, c in enumerate(m.names)}
    out = []
    for token, i in m.vocab.items():
        raw = bytes(number[c] for c in token)
        if m.ids(raw) == [i]:
            try:
                out.append(raw.decode())
            except UnicodeDecodeError:  # part of a character: never a pre-token
                pass
    return frozenset(out)


class Counts(dict):
    """Tokens of a pre-token: one if it was proved whole, else what its merges leave, remembered for a while."""

    def __init__(self, path: str, whole: frozenset[str]):
        super().__init__(dict.fromkeys(whole, 1))
        self.path, self.whole, self.kept = path, whole, []

    def __missing__(self, piece: str) -> int:
        n = len(merges(self.path).ids(piece.encode()))
        if len(piece) <= CACHE_CHARS:
            if len(self.kept) >= CACHE_PIECES:
                for old in self.kept:
                    del self[old]
                self.kept.clear()
            self[piece] = n
            self.kept.append(piece)
        return n

    def of(self, text: str, special) -> tuple[int, int, int]:
        """Tokens of a text, its pre-tokens that are whole tokens, and the others."""
        tokens = whole = other = 0
        for k, part in enumerate(special.split(text) if special else [text]):
            if k % 2:  # a special token's own string
                tokens += 1
                continue
            pieces = pretokens(part)
            n = len(pieces)
            merged = n - sum(map(self.whole.__contains__, pieces))
            tokens += sum(map(self.__getitem__, pieces)) if merged else n
            whole += n - merged
            other += merged
        return tokens, whole, other


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than limit), and how the pre-tokens were counted: n_whole directly, n_merged by merges.

    path: the vocabulary file, the same on every machine. The proof is made once, on the driver, from that file alone; what
    goes to the tasks is at most the vocabulary's strings. A special token's string inside a text is that token. A null or
    empty text has no bytes and no tokens; a null doc_id stays null; repeated rows give repeated results; other columns of
    docs are ignored. A very long pre-token takes n log n steps; a text is held whole by its task, and no more than a batch.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    small_batches(spark)
    whole = spark.sparkContext.broadcast(proved(path))

    def run(batches):
        m = merges(path)
        counts = Counts(path, whole.value)
        special = re.compile("(" + "|".join(map(re.escape, sorted(m.special, key=len, reverse=True))) + ")") if m.special else None
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = [counts.of(t, special) for t in texts]
            columns = [[len(t.encode()) for t in texts], [x[0] for x in found], [x[1] for x in found], [x[2] for x in found]]
            n_bytes, n, direct, other = (pa.array(c, pa.int64()) for c in columns)
            over = pa.array([x[0] > limit for x in found], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, n, over, direct, other], names=["doc_id", "n_bytes", "n_tokens", "over_limit", "n_whole", "n_merged"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
