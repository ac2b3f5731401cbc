"""BPE encoding and decoding with forced boundaries.

A byte pair that occurs inside no vocabulary token can never be merged, so a word is cut there for
certain; the fragments are encoded independently and their ids concatenated.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from functools import lru_cache

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Words of at most so many characters are remembered, so many of them.
CACHE_CHARS, CACHE_WORDS = 40, 300_000


def byte_names() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + rest.index(b)) for b in range(256)]


# Letters and digits assigned after Unicode 16.0, which the tokenizer's pattern takes as symbols.
LATER = """
0558 058b-058c 088f 0c5c 0cdc 208f 209d-209f a7cc a7cf a7d2 a7d4 a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee
11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20
18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2
1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f
"""
LATER_ASSIGNED = re.compile("[" + "".join("-".join(re.escape(chr(int(x, 16))) for x in r.split("-")) for r in LATER.split()) + "]")


# Capitals that have had a lower case since Unicode 16.0.
NEW_CASE = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
NEW_CASE |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
CONTROL = re.compile(r"[\x1c-\x1f]")
#: The tokenizer's pattern in the standard library's terms; right for texts without odd() characters; the second for ASCII.
PLAIN = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
PLAIN_ASCII = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-z]+|[0-9]|[^ \t-\ra-z0-9]+")


@lru_cache(maxsize=1)
def odd() -> frozenset:
    """Characters that PLAIN, the pattern library and later Unicode versions class differently."""
    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    found = set(map(chr, NEW_CASE)) | set(LATER_ASSIGNED.findall(points))
    for ours, theirs in ((r"[^\W\d_]", r"\p{L}"), (r"\d", r"\p{N}"), (r"\s", r"\s")):
        found |= set(re.findall(ours, points)) ^ set(regex.findall(theirs, points))
    return frozenset(found)


class Fragments(dict):
    """ids of a piece of text without white space, as bytes; computed when first asked for."""

    def __init__(self, owner):
        self.owner = owner

    def __missing__(self, piece):
        words = (PLAIN_ASCII if piece.isascii() else PLAIN).findall(piece)
        ids = b"".join([i.to_bytes(4, "little") for w in words for i in self.owner.encode_word(w)])
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
                self.owner.text_of.clear()
            self[piece] = ids
        return ids


class Texts(dict):
    """Decoded bytes of such a piece."""

    def __init__(self, owner):
        self.owner = owner

    def __missing__(self, piece):
        text = self.owner.decode_bytes(self.owner.ids_of[piece])
        if len(piece) <= CACHE_CHARS:
            self[piece] = text
        return text


class ForcedBoundaryBpe:
    """Encoder and decoder of a tokenizers JSON file of the word-end BPE kind."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.vocab = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.names = byte_names()
        number = {c: b for b, c in enumerate(self.names)}
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        self.rank = {(self.vocab[a], self.vocab[b]): r for r, (a, b) in enumerate(pairs)}
        self.made = [self.vocab[a + b] for a, b in pairs]
        self.none = len(pairs)
        joined = bytearray(65536)
        for token in self.vocab:
            body = token[: -len(self.end)] if self.end and token.endswith(self.end) else token
            raw = [number[c] for c in body if c in number]
            for a, b in zip(raw, raw[1:]):
                joined[a << 8 | b] = 1
        self.joined = joined
        self.first = [self.vocab.get(c) for c in self.names]
        self.last = [self.vocab.get(c + self.end) for c in self.names]
        self.token = {i: t.encode() for t, i in [*self.vocab.items(), *self.special.items()]}
        self.text_of = Texts(self)
        self.ids_of = Fragments(self)

    def cuts(self, raw: bytes) -> list[int]:
        """Where raw is cut for certain, its two ends included."""
        joined = self.joined
        return [0, *(i for i in range(1, len(raw)) if not joined[raw[i - 1] << 8 | raw[i]]), len(raw)]

    def merged(self, ids: list[int]) -> list[int]:
        """The lowest-ranked pair is joined, the leftmost first, until none is left."""
        n = len(ids)
        if n < 200:
            get, none = self.rank.get, self.none
            ranks = [get(p, none) for p in zip(ids, ids[1:])]
            while ranks and (m := min(ranks)) < none:
                i = ranks.index(m)
                ids[i] = self.made[m]
                del ids[i + 1], ranks[i]
                if i:
                    ranks[i - 1] = get((ids[i - 1], ids[i]), none)
                if i < len(ranks):
                    ranks[i] = get((ids[i], ids[i + 1]), none)
            return ids
        after, before, alive = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
        heap: list = []

        def push(i, a, b):
            if (r := self.rank.get((a, b))) is not None:
                heapq.heappush(heap, (r, i, a, b, self.made[r]))

        for i in range(n - 1):
            push(i, ids[i], ids[i + 1])
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = new, False, after[j]
            if after[i] >= 0:
                before[after[i]] = i
                push(i, new, ids[after[i]])
            if before[i] >= 0:
                push(before[i], ids[before[i]], new)
        return [x for x, here in zip(ids, alive) if here]

    def encode_word(self, word: str) -> list[int]:
        raw = word.encode()
        ends = self.cuts(raw)
        out: list[int] = []
        for lo, hi in zip(ends, ends[1:]):
            ids = [self.first[b] for b in raw[lo:hi]]
            if hi == len(raw):
                ids[-1] = self.last[raw[-1]]
            out += self.merged(ids)
        return out

    def pieces(self, part: str) -> list[str] | None:
        """Lower-cased pieces between white space of a text without special tokens; None if it has odd characters.

        Characters are lower-cased one by one, so a capital sigma never takes its final form. White
        space separates words whatever its length and is dropped.
        """
        if part.isascii():
            return [x.decode() for x in part.lower().encode().split()] if CONTROL.search(part) else part.lower().split()
        part = self.normal(part)
        return part.split() if odd().isdisjoint(part) else None

    @staticmethod
    def normal(part: str) -> str:
        return unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()

    def odd_ids(self, part: str) -> bytes:
        """ids of a part with odd characters: the pattern library, whose letters of later versions count as symbols."""
        part = self.normal(part).translate(NEW_CASE)
        words = [part[m.start() : m.end()] for m in self.pattern.finditer(LATER_ASSIGNED.sub("\u2603", part))]
        return b"".join([i.to_bytes(4, "little") for w in words for i in self.encode_word(w)])

    def parts(self, text: str):
        """(special, string) parts of a text in order."""
        if self.special_pattern is None or "<|" not in text:
            yield False, text
            return
        for k, part in enumerate(self.special_pattern.split(text)):
            if part:
                yield bool(k % 2), part

    def encode_bytes(self, text: str) -> bytes:
        """ids of a text as little-endian unsigned 32-bit integers."""
        return self.both(text)[0]

    def decode_bytes(self, ids: bytes) -> bytes:
        """UTF-8 of the decoded text: the file names no decoder, so tokens are joined by a space."""
        return b" ".join([self.token[i] for i in memoryview(ids).cast("I")]) if ids else b""

    def both(self, text: str) -> tuple[bytes, bytes]:
        """ids and decoded bytes. Decoding joins tokens by a space, so it can be done word by word."""
        ids, texts = [], []
        for special, part in self.parts(text):
            if special:
                ids.append(self.special[part].to_bytes(4, "little"))
                texts.append(part.encode())
            elif (pieces := self.pieces(part)) is None:
                ids.append(self.odd_ids(part))
                if ids[-1]:
                    texts.append(self.decode_bytes(ids[-1]))
            elif pieces:
                ids.append(b"".join(map(self.ids_of.__getitem__, pieces)))
                texts.append(b" ".join(map(self.text_of.__getitem__, pieces)))
        return b"".join(ids), b" ".join(texts)

    def encode(self, text: str | None) -> list[int]:
        return list(memoryview(self.encode_bytes(text or "")).cast("I"))

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(b"".join(i.to_bytes(4, "little") for i in ids)).decode()


@lru_cache(maxsize=2)
def load(path: str) -> ForcedBoundaryBpe:
    return ForcedBoundaryBpe(path)


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row.

    path: the vocabulary file, the same on every machine. A null or empty text has no token; a null
    doc_id stays null; repeated rows give repeated results; other columns of docs are ignored.
    """
    import pyarrow as pa

    small_batches(docs.sparkSession)

    def run(batches):
        bpe = load(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n, a, b = [], [], []
            for text in texts:
                ids, decoded = bpe.both(text or "")
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(decoded).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>) of every row, for those who want the tokens themselves."""
    import pyarrow as pa

    small_batches(docs.sparkSession)

    def run(batches):
        bpe = load(path)
        for batch in batches:
            ids = [bpe.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")
