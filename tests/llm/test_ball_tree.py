import hashlib

import numpy as np

from tidegate.llm import ball_tree
from tidegate.llm.ball_tree import ball_tree as build
from tidegate.llm.ball_tree import centroid_clusters, first_centroids, grown, integers, moved, walk
from tidegate.llm.common import stored


def brute(rows, k=40, rounds=5, seed=2):
    """rows: (vec_id, integers). The contract, distance by distance."""
    ids, x = [r[0] for r in rows], np.array([r[1] for r in rows], np.int64)
    order = sorted(range(len(rows)), key=lambda i: (hashlib.sha256(f"{seed}:{ids[i]}".encode()).hexdigest() if ids[i] is not None else "none", x[i].tolist()))
    c = x[order[:k]]
    nearest = lambda: np.array([((c - v) ** 2).sum(axis=1).argmin() for v in x])
    for _ in range(rounds):
        own = nearest()
        c = np.array([[t // int((own == j).sum()) for t in x[own == j].sum(axis=0).tolist()] if (own == j).any() else c[j] for j in range(len(c))])
    own = nearest()
    d = ((x - c[own]) ** 2).sum(axis=1)
    sums = np.bincount(own, d, minlength=len(c))
    hashes = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in c.tolist()]
    return sorted([(i, int(j), int(e), int(sums[j]), int(d.sum()), hashes[j]) for i, j, e in zip(ids, own, d)], key=str)


def scaled(values):
    return [int(np.floor(256 * np.float64(np.float32(v)))) for v in values]


def test_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, scaled(r.embedding)) for r in df.collect()]
    want = brute(rows)
    for n, block, leaf in ((1, 4096, 24), (7, 64, 3)):
        got = centroid_clusters(df.repartition(n), block=block, leaf=leaf)
        assert sorted(map(tuple, got.collect()), key=str) == want


def test_whole_balls_on_clustered_vectors(spark):
    """Where vectors lie close together, balls go to their centroid whole, and the result is the same."""
    rng = np.random.default_rng(3)
    at = rng.normal(size=(30, 64)) * 4
    rows = [(i, (at[i % 30] + rng.normal(size=64) * 0.01).tolist()) for i in range(1500)] + [(5000 + i, at[0].tolist()) for i in range(700)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    assert sorted(map(tuple, centroid_clusters(df, block=400).collect()), key=str) == brute([(i, scaled(v)) for i, v in rows])
    kept = integers(df)
    c = first_centroids(kept, 40, 2)
    _, ways = moved(stored(grown(kept, 64)), c)
    assert ways["whole"] > 1000 and ways["whole"] + ways["single"] == 2200


def test_ties_go_to_the_smaller_number():
    x = np.zeros((50, 2), np.int64)
    x[:, 0] = np.arange(50) % 5
    order, centres, radii, spans, sums = build(x, 2)
    c = np.array([[4, 1], [0, 1], [0, -1], [4, -1], [0, 1]])
    own = np.zeros(50, int)
    for lo, hi, k, _ in walk((x[order], centres, radii, spans), c):
        own[lo:hi] = k
    assert own.tolist() == [((c - v) ** 2).sum(axis=1).argmin() for v in x[order]]
    assert sorted(order) == list(range(50)) and (sums[0] == x.sum(axis=0)).all()
    for lo, hi, left, right in spans:
        assert left < 0 or (spans[left][0], spans[left][1], spans[right][1]) == (lo, spans[right][0], hi)


def test_edges(spark):
    one = [0.5] * 64
    rows = [(1, one, "a"), (1, one, "b"), (None, one, "c"), (2, None, "d"), (3, [], "e"), (4, [*one[1:], None], "f"), (5, [*one[1:], float("nan")], "g"),
            (6, [*one[1:], float("-inf")], "h"), (7, [*one, 0.1], "i"), (8, [1e30] * 64, "j"), (9, [-0.001] * 64, "k")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster string")
    kept = [(1, scaled(one)), (1, scaled(one)), (None, scaled(one)), (9, [-1] * 64)]
    assert sorted(map(tuple, centroid_clusters(df).collect()), key=str) == brute(kept)
    assert centroid_clusters(df.limit(0)).collect() == [] and ball_tree.NO_ID < 0
