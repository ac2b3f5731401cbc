import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidegate.llm import jaccard_join as jj


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets}


def corpus(seed, n=120):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(40)]
    passage = [r.choice(vocab) for _ in range(30)]
    texts = []
    for _ in range(n):
        kind = r.random()
        if kind < 0.15 and texts:
            texts.append(r.choice(texts).upper())
        elif kind < 0.6 and texts:
            w = r.choice(texts[: 6 + len(texts) // 4]).split(" ")
            for _ in range(r.randint(1, 4)):
                k = r.randrange(len(w) or 1)
                w[k : k + r.randint(0, 2)] = [r.choice(vocab)] * r.randint(0, 2)
            texts.append(" ".join(w))
        else:
            texts.append(" ".join([r.choice(vocab) for _ in range(r.choice((1, 3, 5, 7, 9, 30, 80, 200)))] + (passage if r.random() < 0.5 else [])))
    return texts + ["", " \n ", "a b", "A  b", "é È", "É è"]


def result(spark, rows, parts=3):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string").repartition(parts)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jj.jaccard_components(df).collect()}


def test_against_brute_force(spark):
    for seed in (0, 1):
        texts = corpus(seed)
        ids = random.Random(seed).sample(range(-3, 900), len(texts))
        rows = list(zip(ids, texts))
        assert result(spark, rows) == brute(rows)


def test_blocks(spark, monkeypatch):
    """Groups in blocks of a few sets: what a block leaves apart is searched in the others."""
    monkeypatch.setattr(jj, "BLOCK", 5)
    monkeypatch.setattr(jj, "AGREE", 0)
    texts = corpus(7, 160)
    rows = list(enumerate(texts))
    assert result(spark, rows) == brute(rows)


def random_pair(r, n):
    """Two sets of hashes, linked or nearly so."""
    s = np.unique(r.integers(0, 1 << 62, n).astype(np.uint64) * np.uint64(3))
    return s, np.unique(np.concatenate([s[r.random(len(s)) > r.random() * 0.2], r.integers(0, 1 << 62, int(r.integers(0, n // 4 + 1))).astype(np.uint64)]))


def test_signatures_bring_linked_sets_together():
    """Each linked pair shares a signature under which it may link; sets that share a fifth hardly ever meet."""
    r = np.random.default_rng(0)
    pairs = [random_pair(r, int(r.integers(4, 400))) for _ in range(3000)]
    pairs = [(s, t) for s, t in pairs if min(len(s), len(t)) > 3 and jj.linked(jj.overlap(s, t), len(s), len(t))]
    assert len(pairs) > 1000
    sets = [x for p in pairs for x in p]
    sig, sketches = jj.signed(sets)
    sizes = np.array([len(s) for s in sets])
    x, y = np.arange(0, len(sets), 2), np.arange(1, len(sets), 2)
    assert (sig[x] == sig[y]).any(axis=1).all() and jj.may_link(x, y, sizes, sketches).all()
    base = r.integers(0, 1 << 62, 60).astype(np.uint64)
    shared = [np.unique(np.concatenate([base, r.integers(0, 1 << 62, 240).astype(np.uint64)])) for _ in range(200)]
    sig, sketches = jj.signed(shared)
    x, y = np.triu_indices(200, 1)
    assert ((sig[x] == sig[y]).any(axis=1) & jj.may_link(x, y, np.array(list(map(len, shared))), sketches)).mean() < 0.001


def test_brought_together_against_all_pairs():
    """Edges of runs of any size connect what all pairs of a run would; large and open runs come together whole."""
    r = np.random.default_rng(5)
    for large in (3, 1000):
        n = 60
        ids, sizes, sketches = r.permutation(n), r.integers(90, 130, n), r.integers(0, 256, (8, 32))[r.integers(0, 8, n)].astype(np.uint8)
        sketches ^= (r.random((n, 32)) < 0.3).astype(np.uint8)
        sig, at = r.integers(0, 12, 200).astype(np.uint64), r.integers(0, n, 200)
        open_ = np.array([3], np.uint64)
        jj.LARGE, kept = large, jj.LARGE
        x, y = jj.brought_together(sig, ids[at], sizes[at], sketches[at], open_)
        x, y = at[x], at[y]
        jj.LARGE = kept
        want = list(range(n))
        edges = []
        for k in range(12):
            run = at[sig == k]
            for i in run:
                for j in run:
                    if k == 3 or len(run) > large or jj.may_link(np.array([i]), np.array([j]), sizes, sketches)[0]:
                        edges.append((i, j))
        for _ in range(n):
            for i, j in edges:
                want[i] = want[j] = min(want[i], want[j])
        got = list(range(n))
        for _ in range(n):
            for i, j in zip(x, y):
                got[i] = got[j] = min(got[i], got[j])
        assert got == want


def test_packed_and_hot(monkeypatch):
    """What a chunk sends on is read again; a signature of many sets is one open row and edges."""
    monkeypatch.setattr(jj, "HOT", 4)
    r = np.random.default_rng(6)
    base = r.integers(0, 1 << 62, 200).astype(np.uint64)
    sets = [
        np.unique(np.append(base[:199], U)) for U in r.integers(0, 1 << 62, 9).astype(np.uint64)
    ] + [np.unique(r.integers(0, 1 << 62, 50).astype(np.uint64)) for _ in range(5)]
    docs = np.arange(100, 114)[::-1].copy()
    blobs = list(jj.packed(docs, sets, 3))
    assert len(blobs) == 3
    got = [jj.unpacked(*b) for b in blobs]
    edges = {(int(x), int(y)) for g in got for x, y in zip(g[1], g[2])}
    assert edges == {(d, 105) for d in range(106, 114)}
    sig, _ = jj.signed(sets)
    near = {d: set((sig[k] >> np.uint64(16)).tolist()) for k, d in enumerate(docs.tolist())}
    for docs_, _, _, sizes, sketches, sigs, hot in got:
        for s, d, h in zip((sigs >> np.uint64(16)).tolist(), docs_.tolist(), hot):
            assert s in near[d] and (not h or d < 110)
    assert any(g[6].any() for g in got)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sets(st.integers(0, 30), max_size=25).map(sorted), max_size=12), st.integers(1, 8))
def test_divide_skip(lists, need):
    lists = [x for x in lists if x]
    want = [i for i in range(31) if sum(i in x for x in lists) >= need]
    assert jj.divide_skip(lists, need) == want


def test_linker_against_all_pairs():
    r = np.random.default_rng(3)
    for _ in range(30):
        base = r.integers(0, 1 << 40, 60)
        sets = [np.unique(np.where(r.random(60) < r.choice((0.03, 0.08, 0.3)), r.integers(0, 1 << 40, 60), base)).astype(np.uint64) for _ in range(60)]
        linker = jj.Linker()
        for s in sets:
            linker.add(s)
        want = list(range(60))
        for _ in range(60):
            for i in range(60):
                for j in range(i):
                    if jj.linked(jj.overlap(sets[i], sets[j]), len(sets[i]), len(sets[j])):
                        want[i] = want[j] = min(want[i], want[j])
        got = [linker.root(i) for i in range(60)]
        assert got == want


def test_edges(spark):
    df = spark.createDataFrame(
        [
            (1, "a b c d e f", 0), (1, "a b c d e f", 0), (None, "a b c d e f", 0), (2, None, 0), (3, " ", 0), (4, "x " * 20000, 0),
            (5, "x", 0)
        ],
        "doc_id long, text string, n_shingles int"
    )
    got = sorted(map(tuple, jj.jaccard_components(df).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (None, 2, None), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 5)], key=str)
    assert jj.jaccard_components(df.limit(0)).count() == 0
    kept = jj.one_of_each(df)
    assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5]
