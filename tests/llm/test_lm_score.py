import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidegate.llm import lm_score as lm


def test_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = lm.fit(docs)
    got = {r.doc_id: r for r in lm.scored(docs, model).collect()}
    for r in docs.collect()[:25]:
        words = lm.tokens(r.text.encode())
        ids = [model.words.get(w, model.rare) for w in words]
        padded = [model.pad] * 2 + ids + [model.pad] * 2
        total = 0.0
        for k in range(len(ids)):
            h = model.bias.astype(float).copy()
            for t, o in enumerate((0, 1, 3, 4)):
                h += model.tables[t][padded[k + o]]
            s = np.tanh(h) @ model.out + model.out_bias
            e = np.exp(s - s.max())
            total += math.log(e[model.cls[ids[k]]] / e.sum()) + model.inside[ids[k]]
        assert got[r.doc_id].n_tokens == len(words)
        assert abs(got[r.doc_id].pll - total) < 1e-3 * max(1, len(words))


def test_distribution_and_learning(spark):
    """Probabilities of all words sum to one, and the network beats the counts alone on texts it has not seen."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = lm.fit(docs)
    for c in set(model.cls.tolist()) - {lm.SINGLE + lm.SHARED}:
        assert abs(np.exp(model.inside[model.cls == c]).sum() - 1) < 1e-6
    texts = [r.text.encode() for r in docs.where(F.col("doc_id") % 7 == 3).limit(80).collect()]
    n, s = model.score(texts)
    alone = sum(float((model.prior[model.cls[i]] + model.inside[i]).sum()) for i in map(model.ids, texts))
    assert sum(s) > alone
    mixed = []
    for t in texts:
        w = t.split()
        random.Random(1).shuffle(w)
        mixed.append(b" ".join(w))
    assert sum(model.score(mixed)[1]) < sum(s)


def test_counts_cover_all_documents(spark):
    docs = spark.createDataFrame([(i, f"common word{i}") for i in range(500)], "doc_id long, text string")
    model = lm.fit(docs)
    assert model.words[b"common"] == 0 and len(model.words) == 501


def test_rare_words_have_their_own_counts(spark, monkeypatch):
    """A word outside the vocabulary has the share of its own count in the rare class."""
    monkeypatch.setattr(lm, "VOCABULARY", 2)
    docs = spark.createDataFrame([(1, "a a a b b b p"), (2, "a a a b b b q"), (3, "a a a b b b q"), (4, "r r r r"), (4, "q")], "doc_id long, text string")
    counts = lm.counted(docs)
    model = lm.fit(docs, counts)
    with_own, mean = ({r.doc_id: r.pll for r in lm.scored(docs, model, c).collect()} for c in (counts, None))
    rare = 4 + 3 + 1  # r, q, p
    assert abs((with_own[2] - with_own[1]) - math.log(3) - (mean[2] - mean[1])) < 1e-6
    assert abs((with_own[1] - mean[1]) - (math.log(1 / rare) - model.inside[model.rare])) < 1e-6


def test_witnesses_against_brute_force(spark, monkeypatch):
    """Each window looked up is mixed with the share of its word in all other windows between the same words."""
    monkeypatch.setattr(lm, "VOCABULARY", 8)
    r = random.Random(2)
    rows = [
        (i, " ".join(r.choice("aabbcdefghijkl") for _ in range(r.randint(0, 40)))) for i in range(30)
    ] + [(30, "c j e f"), (31, "c j e f"), (32, "a"), (33, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    model = lm.fit(docs)
    plain, got = ({x.doc_id: x.pll for x in lm.scored(docs, model, None, w).collect()} for w in (False, True))
    words = {i: [w.encode() for w in (t or "").split()] for i, t in rows}
    telling = lambda w: w not in model.words or model.telling[model.words[w]]
    inner = lambda x: [(x[k - 1], x[k], x[k + 1]) for k in range(1, len(x) - 1) if telling(x[k - 1]) or telling(x[k + 1])]
    seen = Counter(e for x in words.values() for e in inner(x))
    gained = 0
    for i, x in words.items():
        logs, entries, want = model.log_probs([model.numbered(x)]), inner(x), 0.0
        at = [k for k in range(1, len(x) - 1) if telling(x[k - 1]) or telling(x[k + 1])]
        for k, e in zip(at, entries):
            n = sum(c for (a, _, b), c in seen.items() if (a, b) == (e[0], e[2])) - 1
            if n:
                want += math.log(math.exp(logs[k]) / (n + 1) + n / (n + 1) * (seen[e] - 1) / n) - logs[k]
        assert abs(got[i] - plain[i] - want) < 2e-3 * max(1, len(x))
        gained += bool(entries)
    assert gained > 15


def test_what_occurs_twice_scores_higher(spark, monkeypatch):
    """Documents that the corpus holds twice stand out from those of the same kind that it holds once."""
    monkeypatch.setattr(lm, "VOCABULARY", 200)
    r = random.Random(9)
    words = ["".join(r.choice("abcdefghiklmnoprstu") for _ in range(r.randint(3, 8))) for _ in range(1500)]
    make = lambda: " ".join(words[min(int(r.paretovariate(0.4)), 1500) - 1] for _ in range(300))
    texts = [make() for _ in range(240)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(1000 + i, texts[i]) for i in range(40)], "doc_id long, text string")
    got = {x.doc_id: x.pll for x in lm.lm_scores(docs).collect()}
    line = sorted(got[i] for i in range(40, 240))[180]
    assert sum(got[i] > line for i in range(40)) > 24


def test_every_document_trains(spark):
    """Every token of every text is a training window in just one round, late words of long texts too."""
    long = "a b " * 60_000
    docs = spark.createDataFrame([(i, long) for i in range(4)] + [(9, "a b " * 60_000 + "late words here " * 50), (None, "c"), (10, None)], "doc_id long, text string")
    model = lm.fit(docs)
    before = lm.WindowModel(sorted([(b"a", 300_000), (b"b", 300_000), (b"here", 50), (b"late", 50), (b"words", 50), (b"c", 1)], key=lambda x: (-x[1], x[0])), 0, 0)
    assert model.words == before.words
    for w in (b"late", b"words", b"here"):
        assert np.abs(model.tables[:, model.words[w]] - before.tables[:, model.words[w]]).max() > 1e-3


def test_rounds_take_each_token_once(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = docs.unionByName(docs.limit(3)).repartition(5)
    trained = []

    def note(rows, model):
        trained.append([r.text for r in rows.collect()])

    monkeypatch.setattr(lm, "train_on_all", note)
    lm.fit(docs)
    assert len(trained) == len(lm.ROUNDS) and all(trained)
    assert sorted(t for part in trained for t in part) == sorted(r.text for r in docs.collect())


def test_partitions_change_scores_little(spark):
    """The rows' tasks decide what is averaged with what: scores per token move by a fifth of their spread over documents at most."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    one, two = ({r.doc_id: r.pll / max(1, r.n_tokens) for r in lm.scored(docs, lm.fit(docs.repartition(n, "doc_id")), None, False).collect()} for n in (2, 6))
    some = list(one)
    a, b = (np.array([x[i] for i in some]) for x in (one, two))
    assert np.abs((a - a.mean()) - (b - b.mean())).mean() < 0.2 * a.std() and np.corrcoef(a, b)[0, 1] > 0.95


def test_edges(spark):
    rows = [(1, "a b c"), (1, "a b c"), (None, "a"), (2, None), (3, " !!"), (4, "z " * 90_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("x"))
    got = sorted((r.doc_id or 0, r.n_tokens) for r in lm.lm_scores(docs).collect())
    assert got == [(0, 1), (1, 3), (1, 3), (2, 0), (3, 0), (4, 90_000)]
    assert lm.lm_scores(docs.limit(0)).count() == 0
