import random
import re
from collections import Counter, defaultdict

import numpy as np

from tidegate.llm import phrases
from tidegate.llm.phrases import SIDE, Chunk, collocations, combined, fragments, ngram_counts, slices

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def pieces_of(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER))]


def counts_of(rows):
    f = defaultdict(Counter)
    for lang, text in rows:
        for ws in pieces_of(text):
            for k in range(1, 5):
                f[lang or "und"].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    return f


def brute(rows, least=30, top=2000):
    out = []
    for lang, f in counts_of(rows).items():
        n = sum(c for g, c in f.items() if len(g) == 1)
        candidates = {g: c for g, c in f.items() if len(g) > 1 and c >= least}
        kept = []
        for g, a in candidates.items():
            holds = lambda h: any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1))  # noqa: B023, E731
            if any(len(h) > len(g) and 100 * c >= 80 * a and holds(h) for h, c in candidates.items()):
                continue
            score, _, left, right = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            kept.append((-score, -a, " ".join(g).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, le, r, n, -s) for i, (s, a, p, le, r) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def made_up(seed, n=160):
    """Texts of few words, with passages that many share, repeated words, separators of all kinds and long documents."""
    rng = random.Random(seed)
    words = ["a", "B", "the", "of", "É", "x1", "zz", "q\x00r", "New", "york", "city", "ß", "a", "the", "the"] + [f"r{i}" for i in range(9)]
    passage = "Once upon a Time there was; the End of New York city"
    rows = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", "!?", "\x0b", "\r\n"]) for _ in range(rng.randint(0, 120)))
        rows.append((rng.choice(["en", "en", "de", None, "und"]), text + (passage if i % 3 == 0 else "")))
    return [*rows, ("en", "the " * 3000), ("en", None), ("fr", ""), ("fr", " \n"), ("en", "New York " * 40 + passage), ("en", "New York " * 40 + passage)]


def test_against_brute_force(spark):
    rows = made_up(1, 600)
    docs = spark.createDataFrame([(i, a, t, 1, "x") for i, (a, t) in enumerate(rows)], "doc_id long, lang string, text string, rank int, phrase string")
    want = brute(rows, 12)
    assert len(want) > 60 and {w[0] for w in want} == {"en", "de", "und"}
    # With 5 common words rows name the others; a bucket of 900 words makes frequent pivots wide; 1 slot makes all words equally rare.
    for settings in ({"known": 5}, {"bucket": 900, "known": 0}, {"slots": 1, "bucket": 5000}):
        assert sorted(map(tuple, collocations(docs.repartition(3), 12, **settings).collect())) == want, settings
    assert sorted(map(tuple, collocations(docs).collect())) == brute(rows)
    assert sorted(map(tuple, collocations(docs, least=5, top=7).collect())) == brute(rows, 5, 7)
    assert collocations(docs.limit(0)).collect() == []


def test_all_counts(spark):
    rows = made_up(2, 60)
    docs = spark.createDataFrame(rows, "lang string, text string")
    f = counts_of(rows)
    words, grams = ngram_counts(docs, 3, slots=16, bucket=400, known=2)
    assert {tuple(r) for r in words.collect()} == {(a, g[0], c) for a, x in f.items() for g, c in x.items() if len(g) == 1}
    assert sorted(map(tuple, grams.collect())) == sorted((a, " ".join(g), c) for a, x in f.items() for g, c in x.items() if len(g) > 1 and c >= 3)


def test_fragments_own_each_ngram_once():
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 9, 400).astype(np.int32)
    rarity = np.array([0, 0, 5, 5, 7, 9, 30, 30, 2])
    padded = np.concatenate([np.zeros(SIDE, np.int32), codes, np.zeros(SIDE, np.int32)])
    places, pivots = fragments(padded, rarity)
    found = Counter()
    for row, pivot in zip(places, pivots):
        for length in (2, 3, 4):
            for start in range(SIDE - length + 1, SIDE + 1):
                gram = row[start : start + length]
                if gram.all():
                    found[tuple(gram)] += 1
                    assert rarity[pivot] == min(rarity[gram]) and gram[np.argmin(rarity[gram])] == pivot
    want = Counter(tuple(codes[i : i + k]) for k in (2, 3, 4) for i in range(len(codes) - k + 1) if (rarity[codes[i : i + k]] > 0).all())
    assert found == want


def test_rows_with_one_hash_stay_apart(monkeypatch):
    rows = np.array([[1, 2], [3, 4], [1, 2], [5, 6], [3, 4], [1, 2]], np.int32)
    want = {(1, 2): 12, (3, 4): 6, (5, 6): 3}
    for fake in (None, lambda r: np.zeros(len(r), np.uint64)):
        if fake:
            monkeypatch.setattr(phrases, "hashed", fake)
        got, n = combined(rows, np.array([1, 2, 1, 3, 4, 10]))
        assert dict(zip(map(tuple, got.tolist()), n.tolist())) == want


def test_long_texts_are_split_in_slices(monkeypatch):
    monkeypatch.setattr(phrases, "SLICE", 40)
    for text in ("one two three " * 50, "a b. c d, " * 60, "x" * 500, "x" * 100 + " y" + "z" * 100 + ".w v u" * 30, ""):
        chunk = Chunk()
        for words, _ in slices(text.encode()):
            chunk.add(words)
        names, codes = [".", *(w.decode() for w in chunk.columns()[0])], np.concatenate(chunk.parts)
        flat = " ".join(names[c] for c in codes)
        assert [p.split() for p in flat.split(".") if p.split()] == [p for p in pieces_of(text) if p]
