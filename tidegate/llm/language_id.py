"""Language identification by string kernels.

The blended-spectrum presence kernel of two texts counts the n-grams (of one to three bytes of lower-cased
letters and their separators) that both have, divided by the geometric mean of what each has. Landmarks
(Nystroem) make it finite: a text's features are its kernels with the landmarks, whitened. One ridge
regression for each language, one against the rest, is fitted on them. Scoring takes batches of texts through
two matrix products.

Only the fit is made on a sample of labelled rows, by hash of the id: PER_LANGUAGE of each language, fewer if the languages
are so many that this would be more than ROWS.
"""

from __future__ import annotations

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, small_batches, stored

#: Labelled rows of each language and of all that a fit may use, about; landmarks in all, one of each language at least; the ridge.
PER_LANGUAGE, ROWS, LANDMARKS, RIDGE = 300, 20_000, 160, 0.3
#: N-grams that fewer than so many training texts have are not kept; texts whose grams are in memory at once.
LEAST_TEXTS, AT_ONCE = 2, 512
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
LETTER = regex.compile(r"\p{L}")
#: ASCII letters lower-cased, other ASCII bytes are separators; bytes of longer characters stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def grams(text: bytes) -> np.ndarray:
    """Codes of the n-grams of a text, repeated ones too: one to three bytes."""
    x = np.frombuffer(b" " + text.translate(FOLD) + b" ", np.uint8).astype(np.int32)
    two = x[:-1] << 8 | x[1:]
    three = two[:-1] << 8 | x[2:]
    return np.concatenate([x, two + (1 << 8), three + ((1 << 8) + (1 << 16))])


CODES = (1 << 8) + (1 << 16) + (1 << 24)


class KernelModel:
    """Languages, n-gram numbering, landmarks and coefficients; small, and the same for every task."""

    def __init__(self, texts: list[bytes], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE):
        self.langs = sorted(set(langs))
        sets = [np.unique(grams(t)) for t in texts]
        codes, counts = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.int32), np.zeros(0, int))
        keep = np.flatnonzero(counts >= min(LEAST_TEXTS, max(1, len(sets) // 2)))
        self.codes = codes[keep]
        pick = np.concatenate(
            [np.flatnonzero(np.array(langs) == c)[: max(1, landmarks // max(1, len(self.langs)))] for c in self.langs]
        ) if langs else np.zeros(0, int)
        self.landmarks = self.normal(self.presence([texts[i] for i in pick]))
        k = np.concatenate([self.kernels(texts[lo : lo + AT_ONCE]) for lo in range(0, len(texts), AT_ONCE)] or [np.zeros((0, len(pick)), np.float32)])
        values, vectors = np.linalg.eigh(self.landmarks @ self.landmarks.T) if len(pick) else (np.zeros(0), np.zeros((0, 0)))
        good = values > 1e-6 * max(values.max(initial=0), 1e-12)
        self.whiten = (vectors[:, good] / np.sqrt(values[good])).astype(np.float32)
        z = np.concatenate([k @ self.whiten, np.ones((len(k), 1), np.float32)], axis=1).astype(np.float64)
        y = np.array([[1.0 if c == lang else -1.0 for c in self.langs] for lang in langs]).reshape(len(k), len(self.langs))
        share = np.array([langs.count(c) for c in langs], float)
        w = 1.0 / np.maximum(share, 1)
        penalty = ridge * np.eye(z.shape[1]) * w.sum() / max(1, len(k))
        penalty[-1, -1] = 1e-9
        self.beta = np.linalg.solve(z.T @ (z * w[:, None]) + penalty, z.T @ (y * w[:, None])).astype(np.float32) if len(k) else np.zeros((1, 0), np.float32)

    def presence(self, texts: list[bytes]) -> np.ndarray:
        table = self.numbers()
        out = np.zeros((len(texts), len(self.codes) + 1), np.float32)
        for k, t in enumerate(texts):
            out[k, table[grams(t)]] = 1
        out[:, -1] = 0
        return out[:, :-1]

    def numbers(self) -> np.ndarray:
        """Number of each code; the last number stands for all that are not kept. Made once in a process."""
        if getattr(self, "table", None) is None:
            self.table = np.full(CODES, len(self.codes), np.uint16 if len(self.codes) < 1 << 16 else np.uint32)
            self.table[self.codes] = np.arange(len(self.codes))
        return self.table

    @staticmethod
    def normal(x: np.ndarray) -> np.ndarray:
        return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))

    def kernels(self, texts: list[bytes]) -> np.ndarray:
        """The kernel of each text with each landmark."""
        return self.normal(self.presence(texts)) @ self.landmarks.T

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """One column for each language."""
        k = self.kernels(texts)
        return np.concatenate([k @ self.whiten, np.ones((len(texts), 1), np.float32)], axis=1) @ self.beta

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "table"}

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        real = [k for k, t in enumerate(texts) if t and LETTER.search(t)]
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        if real and self.langs:
            s = self.scores([texts[k].encode("utf-8", "surrogatepass") for k in real])
            e = np.exp(3 * (s - s.max(axis=1, keepdims=True)))
            p = e.max(axis=1) / e.sum(axis=1)
            for k, best, q in zip(real, s.argmax(axis=1), p):
                langs[k], scores[k] = self.langs[best], float(min(1.0, q))
        return langs, scores


def held_out(doc_id):
    """Whether a document may not be learned from; a null id may not either, but is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame) -> KernelModel:
    """Learns from text and lang of rows that are not held out: about PER_LANGUAGE of each language, ROWS in all.

    A first pass counts labels over all rows; the share to take of each language follows, by hash of the id, so the driver
    gets a bounded number of rows, and the same ones in every run.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = usable.groupBy("lang").count()
    lot = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    counts = stored(counts)
    quota = max(1, min(PER_LANGUAGE, ROWS // max(1, counts.count())))
    # Rows that repeat an id are one, so that no id brings more than its share.
    some = usable.join(counts, "lang").where(lot * F.col("count") <= quota).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    rows = sorted(some.collect(), key=lambda r: (r.doc_id, r.lang, r.text))
    dropped(counts)
    rows = [r for r in rows if LETTER.search(r.text)]
    return KernelModel([r.text.encode() for r in rows], [r.lang for r in rows])


def predicted(docs: DataFrame, model: KernelModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every whole text."""
    import pyarrow as pa

    small_batches(docs.sparkSession, 256)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            langs, scores = m.predict(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def language_id(docs: DataFrame) -> DataFrame:
    """Fits on docs and predicts all of docs.

    A text that is null or has no letter is `und` with score 0, and so is every text if nothing can be learned.
    Languages tie to the first in order. Repeated rows give repeated results; other columns are ignored.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return predicted(plain, fit(plain))
