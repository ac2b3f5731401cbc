import hashlib
import random

import numpy as np

from tidegate.llm import suffix_dedup as sd


def brute(rows):
    """rows: (doc_id, bytes) -> {doc_id: (n, removed, spans, sha)}"""
    least = {}
    for i, t in rows:
        for k in range(len(t) - 49):
            s = t[k : k + 50]
            least[s] = min(least.get(s, i), i)
    out = {}
    for i, t in rows:
        cover = bytearray(len(t))
        for k in range(len(t) - 49):
            if least[t[k : k + 50]] < i:
                cover[k : k + 50] = b"\1" * 50
        kept = bytes(c for c, x in zip(t, cover) if not x)
        spans = sum(1 for k, x in enumerate(cover) if x and (k == 0 or not cover[k - 1]))
        out[i] = (len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abé") for _ in range(r.randint(1, 4)))
    passages = [" ".join(word() for _ in range(r.choice((15, 25, 40)))) for _ in range(4)]
    texts = []
    for _ in range(n):
        kind = r.random()
        if kind < 0.2 and texts:
            texts.append(r.choice(texts))
        elif kind < 0.4 and texts:
            t = list(r.choice(texts))
            for _ in range(r.randint(1, 3)):
                if t:
                    t[r.randrange(len(t))] = "Q"
            texts.append("".join(t))
        else:
            parts = [" ".join(word() for _ in range(r.randint(0, 40)))]
            while r.random() < 0.6:
                parts += [r.choice(passages)[r.randint(0, 5) :], " ".join(word() for _ in range(r.randint(0, 9)))]
            texts.append(r.choice(("", " ")).join(parts))
    return texts + ["", "a" * 49, "a" * 50, "a" * 300, "ab" * 200, "a" * 70]


def run(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "doc_id long, text string, n_bytes string").repartition(parts)
    return sd.suffix_dedup(df).collect()


def test_against_brute_force(spark):
    for seed in range(4):
        texts = corpus(seed)
        ids = random.Random(seed).sample(range(-5, 500), len(texts))
        got = {r.doc_id: tuple(r)[1:] for r in run(spark, [(i, t, "x") for i, t in zip(ids, texts)])}
        assert got == brute([(i, t.encode()) for i, t in zip(ids, texts)])


def test_on_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in sd.suffix_dedup(docs.repartition(5)).collect()}
    assert got == brute([(r.doc_id, (r.text or "").encode()) for r in docs.collect()])


def test_edges(spark):
    t = "the same passage of text which is over fifty bytes long, twice"
    got = run(spark, [(1, t, ""), (1, t, ""), (2, t, ""), (None, t, ""), (3, None, ""), (4, "x", "")])
    assert sorted((r.doc_id or -1, r.n_removed) for r in got) == [(-1, 0), (1, 0), (1, 0), (2, len(t)), (3, 0), (4, 0)]
    assert run(spark, []) == []
    docs = spark.createDataFrame([(1, t, 5), (2, "é" + t + "é", 5)], "doc_id long, text string, n_chars int")
    assert {tuple(r) for r in sd.cut_texts(docs).collect()} == {(1, t, len(t)), (2, "éé", 2)}


def test_suffix_sort():
    r = np.random.default_rng(1)
    mat = r.integers(97, 99, (500, 12)).astype(np.uint8)
    length, group = r.integers(0, 13, 500), np.sort(r.integers(0, 6, 500))
    order, common = sd.Suffixes(mat, length).sorted(group)
    rows = [(int(group[i]), mat[i, : length[i]].tobytes()) for i in order]
    assert rows == sorted(rows) and sorted(order) == list(range(500))
    for k in range(1, 500):
        (g, a), (g2, b) = rows[k - 1], rows[k]
        want = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) if g == g2 else -1
        assert common[k] == want


def around(text, at):
    """The surroundings of the anchor at a place: (left bytes there, right bytes there, all bytes)."""
    raw = np.frombuffer(b"\0" * sd.LEFT + text + b"\0" * sd.RIGHT, np.uint8)
    return min(sd.LEFT, at), min(sd.RIGHT, len(text) - at), raw[at : at + sd.WIDTH]


def test_sort_decides(monkeypatch):
    """What documents share around an anchor comes from the sorted suffixes alone: without their common extensions nothing is found."""
    r = random.Random(3)
    noise = lambda n: bytes(r.randrange(97, 123) for _ in range(n))
    shared = noise(58)
    texts = [noise(30) + shared + noise(30), noise(20) + shared + noise(40), noise(50) + shared[4:] + noise(9), noise(40) + shared[10:] + noise(9)]
    at = [t.index(shared[20:36]) for t in texts]
    lav, rav, ctx = zip(*(around(t, p) for t, p in zip(texts, at)))
    args = np.full(4, 7, np.uint64), np.arange(4), np.array(at), np.array(lav), np.array(rav), np.array(ctx)
    doc, a, b = sd.repeated(*args)
    assert sorted(zip(doc.tolist(), a.tolist(), b.tolist())) == [(1, 20, 78), (2, 50, 104)]
    sort = sd.Suffixes.sorted
    monkeypatch.setattr(sd.Suffixes, "sorted", lambda self, group: (sort(self, group)[0], np.full(len(group), -1)))
    assert len(sd.repeated(*args)[0]) == 0


def test_distinct_suffixes():
    r = np.random.default_rng(2)
    mat = r.integers(0, 2, (300, 9)).astype(np.uint8)
    length, group = r.integers(7, 10, 300), np.sort(r.integers(0, 4, 300))
    rows, number = sd.distinct(mat, length, group)
    key = lambda i: (int(group[i]), int(length[i]), mat[i].tobytes())
    assert (np.diff(group[rows]) >= 0).all() and len({key(i) for i in rows}) == len(rows) == len({key(i) for i in range(300)})
    assert all(key(rows[number[i]]) == key(i) for i in range(300))
