"""Centroid clustering filtered by ball trees.

Each partition builds metric trees over blocks of its vectors and stores them once; a node has its ball's centre and radius,
the number of its vectors and their integer sum. A round walks every tree from the root with all centroids as candidates. By
the triangle inequality a centroid is out for a whole ball if its distance to the centre, less the radius, is more than the
nearest centroid's distance plus the radius. A ball with one candidate left gives its count and sum at once, without its
vectors; otherwise its children are asked, and in a leaf the candidates' distances are computed exactly in integers. A round
returns one row of sums for each centroid; vectors never move again.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, small_batches, stored

DIMENSIONS, SCALE, CENTROIDS, ROUNDS, SEED = 64, 256, 40, 5, 2
#: Vectors of one tree, and of a leaf whose vectors are not all equal.
BLOCK, LEAF = 4096, 24
#: Scaled components below this in size have squared distances that fit a long: 64 * (2 * 2**27)**2 = 2**62.
MOST = 1 << 27

TREES = "vec_ids array<long>, vectors binary, centres binary, radii binary, spans binary, sums binary"
OUT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def integers(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): kept vectors as floor(scale * component).

    Kept are vectors of the right length whose components are all there and finite, and below MOST in size when scaled, as
    the squared distances of others are no longs. A null vec_id stays null.
    """
    x = F.col("embedding")
    scaled = F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")))
    fine = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v.cast("double")) * scale < MOST - 1), F.lit(False)))
    return vectors.where((F.size(x) == dimensions) & fine).select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("x"))


def first_centroids(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors least by hash of the id, as rows; rows without id come last, equal ids in order of their components."""
    order = F.coalesce(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256), F.lit("none"))
    return np.array([r.x for r in kept.orderBy(order, "x").limit(k).collect()], np.int64)


def ball_tree(x: np.ndarray, leaf: int = LEAF) -> tuple:
    """(order, centres, radii, spans, sums) of integer rows x; a span is a node's range of order and its children, -1 in a leaf."""
    order, centres, radii, spans, sums = np.arange(len(x)), [], [], [], []
    todo = [(0, len(x), None)]
    while todo:
        lo, hi, parent = todo.pop()
        at, rows = len(spans), x[order[lo:hi]]
        if parent is not None:
            spans[parent[0]][parent[1]] = at
        total = rows.sum(axis=0)
        centre = total / (hi - lo)
        away = np.sqrt(((rows - centre) ** 2).sum(axis=1))
        same = (rows == rows[0]).all()
        if same:  # any number of copies is one point
            centre, away = rows[0].astype(np.float64), away * 0
        spans.append([lo, hi, -1, -1])
        centres.append(centre)
        radii.append(away.max())
        sums.append(total)
        if hi - lo <= leaf or same:
            continue
        far = rows[away.argmax()]
        from_far = ((rows - far) ** 2).sum(axis=1)
        other = rows[from_far.argmax()]
        near = from_far <= ((rows - other) ** 2).sum(axis=1)
        part = order[lo:hi]
        order[lo:hi] = np.concatenate([part[near], part[~near]])
        cut = lo + int(near.sum())
        todo += [(lo, cut, (at, 2)), (cut, hi, (at, 3))]
    return order, np.array(centres), np.array(radii), np.array(spans, np.int32), np.array(sums, np.int64)


def walk(tree: tuple, centroids: np.ndarray):
    """(lo, hi, cluster or clusters, node or -1): balls that go to one centroid whole, and leaves settled vector by vector."""
    x, centres, radii, spans = tree
    exact = centroids.astype(np.float64)
    todo = [(0, np.arange(len(centroids)))]
    while todo:
        node, candidates = todo.pop()
        lo, hi, left, right = spans[node]
        if len(candidates) > 1:
            d = np.sqrt(((exact[candidates] - centres[node]) ** 2).sum(axis=1))
            # A little is added for rounding, so that no centroid that might win or tie is lost.
            candidates = candidates[d <= (d.min() + 2 * radii[node]) * (1 + 1e-9) + 1e-6]
        if len(candidates) == 1:
            yield lo, hi, candidates[0], node
        elif left >= 0:
            todo += [(left, candidates), (right, candidates)]
        else:
            rows = x[lo : lo + 1] if radii[node] == 0 else x[lo:hi]
            d = ((rows[:, None, :] - centroids[candidates][None, :, :]) ** 2).sum(axis=2)
            own = candidates[d.argmin(axis=1)]  # of equal ones the first, which has the smallest number
            if radii[node] == 0:
                yield lo, hi, own[0], node
            else:
                yield lo, hi, own, -1


def grown(kept: DataFrame, dimensions: int, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """Trees over blocks of each partition's vectors, a row for each: their arrays in the order of the leaves."""
    import pyarrow as pa

    def run(batches):
        def tree(ids, rows):
            x = np.concatenate(rows)
            order, centres, radii, spans, sums = ball_tree(x, leaf)
            ids = np.concatenate(ids)[order]
            packed = [x[order].astype(np.int32), centres, radii, spans, sums]
            known = ids != NO_ID
            return pa.RecordBatch.from_arrays(
                [pa.array([pa.array(ids, mask=~known).to_pylist()], pa.list_(pa.int64())), *(pa.array([a.tobytes()], pa.binary()) for a in packed)],
                names=["vec_ids", "vectors", "centres", "radii", "spans", "sums"]
            )

        ids, rows, held = [], [], 0
        for batch in batches:
            i = batch.column(0).fill_null(NO_ID).to_numpy()
            x = batch.column(1).flatten().to_numpy().reshape(len(i), dimensions)
            for lo in range(0, len(i), block):
                ids.append(i[lo : lo + block])
                rows.append(x[lo : lo + block])
                held += len(ids[-1])
                if held >= block:
                    yield tree(ids, rows)
                    ids, rows, held = [], [], 0
        if held:
            yield tree(ids, rows)

    return kept.mapInArrow(run, TREES)


#: Stands for a null id inside arrays.
NO_ID = -(1 << 63)


def unpacked(batch, dimensions: int):
    """(ids, (vectors, centres, radii, spans), sums) of each tree of a batch."""
    for row in batch.to_pylist():
        x = np.frombuffer(row["vectors"], np.int32).reshape(-1, dimensions).astype(np.int64)
        centres = np.frombuffer(row["centres"]).reshape(-1, dimensions)
        spans = np.frombuffer(row["spans"], np.int32).reshape(-1, 4)
        yield row["vec_ids"], (x, centres, np.frombuffer(row["radii"]), spans), np.frombuffer(row["sums"], np.int64).reshape(-1, dimensions)


def moved(trees: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, dict]:
    """The centroids after a round, each the floor of its vectors' mean; and how many vectors went by whole balls and one by one.

    A task sends a row for each centroid, with sums that Spark adds; as many rows as centroids come to the driver.
    """
    import pyarrow as pa

    dimensions = centroids.shape[1]

    def run(batches):
        count, total = np.zeros((len(centroids), 2), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            for _, tree, sums in unpacked(batch, dimensions):
                for lo, hi, own, node in walk(tree, centroids):
                    if node >= 0:
                        count[own, 0] += hi - lo
                        total[own] += sums[node]
                    else:
                        np.add.at(count[:, 1], own, 1)
                        np.add.at(total, own, tree[0][lo:hi])
        used = np.flatnonzero(count.sum(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array(count[used, 0]), pa.array(count[used, 1]), pa.array(total[used].tolist(), pa.list_(pa.int64()))],
            names=["cluster", "whole", "single", "total"]
        )

    parts = trees.mapInArrow(run, "cluster int, whole long, single long, total array<long>")
    sums = parts.groupBy("cluster").agg(F.sum("whole"), F.sum("single"), *(F.sum(F.get("total", F.lit(j))) for j in range(dimensions))).collect()
    out, ways = centroids.copy(), {"whole": 0, "single": 0}
    for cluster, whole, single, *total in sums:
        out[cluster] = [t // (whole + single) for t in total]
        ways["whole"] += whole
        ways["single"] += single
    return out, ways


def assigned(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector: its nearest centroid and the exact squared distance."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for ids, tree, _ in unpacked(batch, centroids.shape[1]):
                own = np.zeros(len(ids), np.int32)
                for lo, hi, k, _ in walk(tree, centroids):
                    own[lo:hi] = k
                d = ((tree[0] - centroids[own]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(own), pa.array(d)], names=["vec_id", "cluster", "distance"])

    return trees.mapInArrow(run, "vec_id long, cluster int, distance long")


def centroid_clusters(
    vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED,
    block: int = BLOCK, leaf: int = LEAF
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector (see integers).

    All arithmetic is in integers, so the result does not depend on partitions, blocks or leaves. Of equally near centroids
    the smaller number wins; a centroid without vectors stays where it is. With fewer than k kept vectors there are as many
    centroids as vectors; without any the result is empty. Repeated rows are vectors of their own; rows without vec_id
    count too. Other columns are ignored. The driver holds k centroids, nothing else.
    """
    spark = vectors.sparkSession
    small_batches(spark, 4096)
    kept = integers(vectors, dimensions, scale)
    centroids = first_centroids(kept, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], OUT)
    trees = stored(grown(kept, dimensions, block, leaf))
    for _ in range(rounds):
        centroids, _ = moved(trees, centroids)
    rows = stored(assigned(trees, centroids))
    dropped(trees)
    inertia = {r.cluster: int(r.d) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    names = [",".join(map(str, c.tolist())) for c in centroids]
    own = lambda values: F.get(F.array(*map(F.lit, values)), F.col("cluster"))
    return rows.select(
        "vec_id", "cluster", "distance", own([inertia.get(c, 0) for c in range(len(names))]).cast("long").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"), F.sha2(own(names), 256).alias("centroid_sha256")
    )
