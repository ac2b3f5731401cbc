"""Boosted regression trees grown from histograms that tasks sum and Spark adds.

Rows become bin codes once, in stored blocks: a number's bin between exact quantiles, a category's place among its levels, 0
where it is missing or was not seen at the fit. A pass over the blocks sums, for the open nodes of a tree, gradient, weight
and rows by feature and code; what comes to the driver is nodes x features x bins, whatever the number of rows. Gradients are
whole multiples of a power of two, so sums are exact and a model is the same at any partitioning.

Three ways to grow: by level, with a learned side for missing values; leaf by leaf, the best gain first, with categories split
by their sorted ratio of gradient to weight; symmetric, one split for a whole level.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.storage import drop, stored
from .selection import quantiles

#: Weights are whole multiples of 2**-20; gradients of a power of two, 2**-24 of the largest label's distance from the mean at most.
WEIGHT_BITS, GRADIENT_BITS = 20, 24
#: Trees after which the rows' scores are written anew, so that a pass never applies more than so many.
REST = 8
#: Most levels of a category; the rarer ones count as unseen.
LEVELS = 254
BLOCKS = "codes binary, y binary, weight binary, score binary"
GROWTH = ("level", "leaf", "symmetric")


class Bins:
    """Codes of features: 1 to the number of bins in order, 0 for what is missing or unseen."""

    def __init__(self, numeric: list[str], categorical: list[str] = [], most: int = 64):
        if not 2 <= most <= LEVELS + 1:
            raise ValueError(f"bins: 2 to {LEVELS + 1}")
        if len(set(numeric) | set(categorical)) < len(numeric) + len(categorical) or not numeric and not categorical:
            raise ValueError("features must be there and differ")
        self.numeric, self.categorical, self.most, self.edges, self.levels = list(numeric), list(categorical), most, {}, {}

    @property
    def features(self) -> list[str]:
        return self.numeric + self.categorical

    def fit(self, prepared: DataFrame) -> Bins:
        """prepared: a table with columns()."""
        if self.numeric:
            names = [f"_f{i}" for i in range(len(self.numeric))]
            cuts = quantiles(prepared, [], names, [k / self.most for k in range(1, self.most)]).first()
            self.edges = {c: sorted(set(q or [])) for c, q in zip(self.numeric, cuts)}
        for i, c in enumerate(self.categorical, len(self.numeric)):
            found = prepared.where(F.col(f"_f{i}").isNotNull()).groupBy(F.col(f"_f{i}").alias("v")).count()
            self.levels[c] = sorted(r.v for r in found.orderBy(F.desc("count"), "v").limit(LEVELS).collect())
        return self

    def size(self) -> int:
        """One more than the largest code."""
        return 1 + max([len(e) + 1 for e in self.edges.values()] + [len(v) for v in self.levels.values()])

    def columns(self, df: DataFrame) -> list:
        """Numbers as doubles, categories as text, as codes() takes them."""
        return [F.col(f"`{c}`").cast("double").alias(f"_f{i}") for i, c in enumerate(self.numeric)] + [
            F.col(f"`{c}`").cast("string").alias(f"_f{len(self.numeric) + i}") for i, c in enumerate(self.categorical)
        ]

    def codes(self, columns: list) -> np.ndarray:
        """Of Arrow columns, a row for each row and a column for each feature."""
        import pyarrow as pa
        import pyarrow.compute as pc

        out = np.zeros((len(columns[0]), len(self.features)), np.uint8)
        for i, c in enumerate(self.numeric):
            v = columns[i].cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
            out[:, i] = np.where(np.isnan(v), 0, 1 + np.searchsorted(self.edges[c], v, side="left"))
        for i, c in enumerate(self.categorical, len(self.numeric)):
            at = pc.index_in(columns[i].cast(pa.string()), pa.array(self.levels[c], pa.string()))
            out[:, i] = 1 + at.fill_null(-1).to_numpy(zero_copy_only=False)
        return out


class Tree:
    """Nodes in arrays: a row goes left if its code's entry of the node's table says so; -1 for the feature of a leaf."""

    def __init__(self, size: int):
        self.size, self.feature, self.table, self.left, self.right, self.value, self.gain = size, [], [], [], [], [], []

    def add(self, value: float) -> int:
        for array, x in ((self.feature, -1), (self.table, np.zeros(self.size, bool)), (self.left, -1), (self.right, -1), (self.value, value), (self.gain, 0.0)):
            array.append(x)
        return len(self.feature) - 1

    def split(self, node: int, best: dict) -> tuple[int, int]:
        left, right = self.add(0.0), self.add(0.0)
        self.feature[node], self.table[node], self.gain[node] = best["feature"], best["left"], best["gain"]
        self.left[node], self.right[node] = left, right
        return left, right

    def leaves(self, codes: np.ndarray) -> np.ndarray:
        """The node where each row ends."""
        feature, table, left, right = np.array(self.feature), np.array(self.table), np.array(self.left), np.array(self.right)
        node, rows = np.zeros(len(codes), np.int64), np.arange(len(codes))
        while len(rows):
            rows = rows[feature[node[rows]] >= 0]
            at = node[rows]
            node[rows] = np.where(table[at, codes[rows, feature[at]]], left[at], right[at])
        return node

    def scores(self, codes: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaves(codes)]

    def kept(self, wanted: set[int]) -> Tree:
        """The tree with only these of its splits."""
        out = Tree(self.size)

        def copy(node):
            at = out.add(self.value[node])
            if node in wanted:
                out.feature[at], out.table[at], out.gain[at] = self.feature[node], self.table[node], self.gain[node]
                out.left[at], out.right[at] = copy(self.left[node]), copy(self.right[node])
            return at

        copy(0)
        return out

    def as_dict(self) -> dict:
        return {"size": self.size, "feature": self.feature, "left": self.left, "right": self.right, "value": self.value, "gain": self.gain, "table": [np.flatnonzero(t).tolist() for t in self.table]}

    @classmethod
    def of(cls, d: dict) -> Tree:
        out = cls(d["size"])
        out.feature, out.left, out.right, out.value, out.gain = d["feature"], d["left"], d["right"], d["value"], d["gain"]
        for at in d["table"]:
            row = np.zeros(out.size, bool)
            row[at] = True
            out.table.append(row)
        return out


class Boosted:
    """A sum of trees on the mean label; settings are explained at the top of the module and in fit()."""

    family = "trees"

    def __init__(
        self, numeric: list[str], categorical: list[str] = [], growth: str = "level", rounds: int = 20, depth: int = 4, leaves: int = 31,
        rate: float = 0.1, l2: float = 1.0, least_weight: float = 1.0, least_gain: float = 0.0, smooth: float = 10.0, bins: int = 64,
        ones_weight: float = 1.0, ahead: int = 8
    ):
        if growth not in GROWTH:
            raise ValueError(f"unknown growth: {growth}")
        if rounds < 0 or depth < 1 or leaves < 2 or not 0 < rate or l2 < 0 or least_weight <= 0 or ones_weight <= 0 or ahead < 1:
            raise ValueError("settings out of range")
        self.bins = Bins(numeric, categorical, bins)
        self.growth, self.rounds, self.depth, self.leaves, self.rate, self.l2 = growth, rounds, depth, leaves, float(rate), float(l2)
        self.least_weight, self.least_gain, self.smooth = float(least_weight), float(least_gain), float(smooth)
        self.ones_weight, self.ahead = float(ones_weight), ahead
        self.base, self.unit, self.trees = 0.0, 1.0, []

    # Fitting

    def fit(self, train: DataFrame, label: str) -> Boosted:
        """Rows without a label are left out; labels equal to one weigh ones_weight. Without rows the score is 0 everywhere."""
        y = F.col(f"`{label}`").cast("double")
        weight = F.when(y == 1, F.lit(self.ones_weight)).otherwise(F.lit(1.0))
        rows = stored(train.where(y.isNotNull() & ~F.isnan(y)).select(y.alias("_y"), weight.alias("_w"), *self.bins.columns(train)))
        self.bins.fit(rows)
        size = rows.agg(F.count("*"), F.avg(F.col("_y").cast("decimal(38,12)")), F.max(F.abs("_y"))).first()
        self.trees, self.base = [], float(size[1] or 0.0)
        if not size[0]:
            return self
        # A score can leave the range of the labels by little, so three bits are spare.
        self.unit = 2.0 ** (np.ceil(np.log2(max(size[2] + abs(self.base), 1e-300))) - GRADIENT_BITS)
        blocks, fresh = self.blocks(rows), []
        drop(rows)
        for _ in range(self.rounds):
            if len(fresh) == REST:
                last, blocks = blocks, self.rescored(blocks, fresh)
                drop(last)
                fresh = []
            tree = getattr(self, f"_by_{self.growth}")(lambda tree, nodes: self.sums(blocks, fresh, tree, nodes))
            fresh.append(tree)
            self.trees.append(tree)
        drop(blocks)
        return self

    def blocks(self, rows: DataFrame) -> DataFrame:
        import pyarrow as pa

        bins, base = self.bins, self.base

        def run(batches):
            for b in batches:
                if len(b):
                    codes = bins.codes(b.columns[2:])
                    y, weight = b.column(0).to_numpy(), b.column(1).to_numpy()
                    parts = [codes, y, weight, np.full(len(b), base)]
                    yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in parts], names=["codes", "y", "weight", "score"])

        return stored(rows.mapInArrow(run, BLOCKS))

    def _unpacked(self, batch):
        width = len(self.bins.features)
        for row in batch.to_pylist():
            yield np.frombuffer(row["codes"], np.uint8).reshape(-1, width), *(np.frombuffer(row[c]) for c in ("y", "weight", "score"))

    def rescored(self, blocks: DataFrame, trees: list[Tree]) -> DataFrame:
        """The blocks with these trees in their scores."""
        import pyarrow as pa

        def run(batches):
            for b in batches:
                new = []
                for codes, _, _, score in self._unpacked(b):
                    for t in trees:
                        score = score + t.scores(codes)
                    new.append(score.tobytes())
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(new, pa.binary())], names=["codes", "y", "weight", "score"])

        return stored(blocks.mapInArrow(run, BLOCKS))

    def sums(self, blocks: DataFrame, fresh: list[Tree], tree: Tree, nodes: list[int]) -> np.ndarray:
        """(node, feature, code, [gradient, weight, rows]) sums over all rows that are in these nodes of the tree."""
        import pyarrow as pa

        size, width, unit = self.bins.size(), len(self.bins.features), self.unit
        trees = list(fresh)

        def run(batches):
            place = np.full(len(tree.feature), -1)
            place[nodes] = np.arange(len(nodes))
            total = np.zeros((len(nodes), width, size, 3), np.int64)
            for b in batches:
                for codes, y, weight, score in self._unpacked(b):
                    at = place[tree.leaves(codes)]
                    inside = at >= 0
                    codes, y, weight, score, at = codes[inside], y[inside], weight[inside], score[inside], at[inside]
                    for t in trees:
                        score = score + t.scores(codes)
                    parts = np.rint(weight * (score - y) / unit), np.rint(weight * (1 << WEIGHT_BITS)), None
                    for f in range(width):
                        key = at * size + codes[:, f]
                        for k, part in enumerate(parts):
                            # Whole numbers below 2**53 add up exactly in doubles.
                            total[:, f, :, k] += np.bincount(key, part, len(nodes) * size).astype(np.int64).reshape(len(nodes), size)
            node, feature, code = np.nonzero(total[..., 2])
            columns = [pa.array(a.astype(np.int32)) for a in (node, feature, code)] + [pa.array(total[node, feature, code, k]) for k in range(3)]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "feature", "code", "g", "h", "n"])

        parts = blocks.mapInArrow(run, "node int, feature int, code int, g long, h long, n long")
        rows = parts.groupBy("node", "feature", "code").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).toArrow()
        out = np.zeros((len(nodes), width, size, 3), np.int64)
        node, feature, code = (rows[c].to_numpy() for c in ("node", "feature", "code"))
        for k, c in enumerate("ghn"):
            out[node, feature, code, k] = rows[c].to_numpy()
        return out

    def _value(self, g, h):
        return -(g * self.unit) / (h / (1 << WEIGHT_BITS) + self.l2)

    def _part(self, g, h):
        return (g * self.unit) ** 2 / (h / (1 << WEIGHT_BITS) + self.l2)

    def _candidates(self, sums: np.ndarray, feature: int, ordered: bool = True) -> tuple:
        """(gradient and weight on the left, left tables) of a node's possible splits on a feature, the same list for each node.

        A number: codes up to a cut, with what is missing to the right or to the left. A category, unless its codes are in
        order: the levels of lowest ratio; what is missing or unseen goes right.
        """
        size = self.bins.size()
        if feature < len(self.bins.numeric) or ordered:
            running = np.cumsum(sums[1:], axis=0)
            left = np.concatenate([running, running + sums[0]])
            tables = np.arange(size)[None, :] <= np.arange(1, size)[:, None]
            tables[:, 0] = False
            with_missing = tables.copy()
            with_missing[:, 0] = True
            return left, np.concatenate([tables, with_missing])
        here = 1 + np.flatnonzero(sums[1:, 2])
        ratio = sums[here, 0] * self.unit / (sums[here, 1] / (1 << WEIGHT_BITS) + self.smooth)
        here = here[np.lexsort((here, ratio))]
        tables = np.zeros((len(here), size), bool)
        for k in range(len(here)):
            tables[k, here[: k + 1]] = True
        return np.cumsum(sums[here], axis=0), tables

    @staticmethod
    def _last_alike(k: int, rows: np.ndarray, tables: np.ndarray) -> int:
        """The last cut after k that sends the same rows left: values that only other rows have stay with their neighbours, not with what is missing."""
        while k + 1 < len(rows) and rows[k + 1] == rows[k] and tables[k + 1, 0] == tables[k, 0]:
            k += 1
        return k

    def _best(self, sums: np.ndarray, ordered: bool = False) -> dict | None:
        """The split of most gain of a node, the first of equal ones; None if none is allowed."""
        total, best = sums[0].sum(axis=0), None
        for f in range(len(sums)):
            left, tables = self._candidates(sums[f], f, ordered)
            right = total - left
            gain = self._part(left[:, 0], left[:, 1]) + self._part(right[:, 0], right[:, 1]) - self._part(total[0], total[1])
            allowed = np.minimum(left[:, 1], right[:, 1]) >= self.least_weight * (1 << WEIGHT_BITS)
            gain = np.where(allowed & (gain > self.least_gain), gain, -np.inf)
            if len(gain) and gain.max() > (best["gain"] if best else 0.0):
                k = self._last_alike(int(gain.argmax()), left[:, 2], tables)
                best = {"feature": f, "left": tables[k], "gain": float(gain[k]), "sums": (left[k], right[k])}
        return best

    def _split(self, tree: Tree, node: int, best: dict) -> tuple[int, int]:
        children = tree.split(node, best)
        for child, (g, h, _) in zip(children, best["sums"]):
            tree.value[child] = self.rate * float(self._value(g, h))
        return children

    def _root(self, sums) -> tuple[Tree, np.ndarray]:
        tree = Tree(self.bins.size())
        tree.add(0.0)
        found = sums(tree, [0])[0]
        g, h, _ = found[0].sum(axis=0)
        tree.value[0] = self.rate * float(self._value(g, h))
        return tree, found

    def _by_level(self, sums) -> Tree:
        """All nodes of a level from one pass."""
        tree, found = self._root(sums)
        nodes, found = [0], found[None]
        for depth in range(self.depth):
            if depth:
                found = sums(tree, nodes)
            following = []
            for node, s in zip(nodes, found):
                if best := self._best(s):
                    following += self._split(tree, node, best)
            if not following:
                break
            nodes = following
        return tree

    def _by_leaf(self, sums) -> Tree:
        """The leaf of most gain is split until there are enough. One pass looks at the children of several leaves, which the queue
        may want next; only those that it takes in order stay."""
        tree, found = self._root(sums)
        splits, children, open_, taken = {0: self._best(found)}, {}, [0], set()
        while len(open_) < self.leaves:
            able = sorted((n for n in open_ if splits[n]), key=lambda n: (-splits[n]["gain"], n))
            if not able:
                break
            if able[0] not in children:
                look = [n for n in able if n not in children][: self.ahead]
                for n in look:
                    children[n] = self._split(tree, n, splits[n])
                below = [c for n in look for c in children[n]]
                for c, s in zip(below, sums(tree, below)):
                    splits[c] = self._best(s)
            taken.add(able[0])
            open_.remove(able[0])
            open_ += children[able[0]]
        return tree.kept(taken)

    def _by_symmetric(self, sums) -> Tree:
        """One split for all nodes of a level: the most gain in sum; nodes may be empty."""
        tree, found = self._root(sums)
        nodes, found = [0], found[None]
        for depth in range(self.depth):
            if depth:
                found = sums(tree, nodes)
            best = None
            for f in range(found.shape[1]):
                each = [self._candidates(s[f], f) for s in found]
                totals = found[:, f].sum(axis=1)
                gain = sum(
                    self._part(left[:, 0], left[:, 1]) + self._part(*(t - left)[:, :2].T) - self._part(t[0], t[1]) for (left, _), t in zip(each, totals)
                )
                allowed = sum(np.minimum(left[:, 1], t[1] - left[:, 1]) >= self.least_weight * (1 << WEIGHT_BITS) for (left, _), t in zip(each, totals)) > 0
                gain = np.where(allowed & (gain > self.least_gain), gain, -np.inf)
                if gain.max() > (best[0] if best else 0.0):
                    k = self._last_alike(int(gain.argmax()), sum(left[:, 2] for left, _ in each), each[0][1])
                    best = float(gain[k]), f, each[0][1][k], [(left[k], t - left[k]) for (left, _), t in zip(each, totals)]
            if not best:
                break
            gain, f, table, parts = best
            following = []
            for node, part in zip(nodes, parts):
                following += self._split(tree, node, {"feature": f, "left": table, "gain": gain / len(nodes), "sums": part})
            nodes = following
        return tree

    # Use

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        """df with the score of each row; what is missing goes where the fit sent it."""
        import pyarrow as pa

        bins, trees, base = self.bins, self.trees, self.base

        @F.pandas_udf("double")
        def score(x: pd.DataFrame) -> pd.Series:
            codes = bins.codes([pa.Array.from_pandas(x[c]) for c in x.columns])
            out = np.full(len(x), base)
            for t in trees:
                out = out + t.scores(codes)
            return pd.Series(out)

        if not trees:
            return df.withColumn(name, F.lit(base))
        return df.withColumn(name, score(F.struct(*bins.columns(df))))

    def importances(self, kind: str = "gain") -> dict[str, float]:
        """Shares of the splits' gain, or of their number, by feature; 0 for a feature without a split."""
        if kind not in ("gain", "splits"):
            raise ValueError(f"unknown kind: {kind}")
        out = dict.fromkeys(self.bins.features, 0.0)
        for t in self.trees:
            for f, gain in zip(t.feature, t.gain):
                if f >= 0:
                    out[self.bins.features[f]] += gain if kind == "gain" else 1.0
        total = sum(out.values()) or 1.0
        return {c: v / total for c, v in out.items()}

    def save(self, path: str) -> None:
        """One row of text at path, by Spark, so that any shared storage will do."""
        b = self.bins
        d = {"family": self.family, "numeric": b.numeric, "categorical": b.categorical, "bins": b.most, "edges": b.edges, "levels": b.levels, "growth": self.growth,
             "base": self.base, "unit": self.unit, "rate": self.rate, "l2": self.l2, "trees": [t.as_dict() for t in self.trees]}
        _session().createDataFrame([(json.dumps(d),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, path: str) -> Boosted:
        d = json.loads(_session().read.text(path, wholetext=True).first()[0])
        out = cls(d["numeric"], d["categorical"], d["growth"], bins=d["bins"], rate=d["rate"], l2=d["l2"])
        out.bins.edges, out.bins.levels, out.base, out.unit = d["edges"], d["levels"], d["base"], d["unit"]
        out.trees = [Tree.of(t) for t in d["trees"]]
        return out


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession()


def ordered_statistics(
    df: DataFrame, categories: list[str], label: str, order: list[str], prior: float, weight: float = 1.0, blocks: int = 64
) -> DataFrame:
    """df with <category>_statistic: the mean label of the category's earlier rows, drawn to prior as by weight rows.

    Earlier is by order, strictly: rows equal in all of it do not see each other, so no row sees its own label. Rows without
    a label have a statistic and add nothing; a null category is one of its own. Rows are dealt to ranges of the first order
    column; sums run over ranges and inside a range, so a category with a third of all rows fills no task.
    """
    if not order:
        raise ValueError("an order is needed")
    first = F.col(order[0])
    cuts = sorted(set(df.select(F.percentile_approx(first.cast("double"), [k / blocks for k in range(1, blocks)], 1000).alias("q")).first().q or []))
    at = F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<double>")
    out = df.withColumn("_at", F.size(F.filter(at, lambda x: x < first.cast("double"))))
    for c in categories:
        y = F.col(f"`{label}`").cast("double")
        key = [F.col(f"`{c}`").isNull(), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))]
        sums = out.groupBy(key[0].alias("_null"), key[1].alias("_key"), "_at").agg(F.sum(y).alias("_s"), F.count(y).alias("_n"))
        w = W.partitionBy("_null", "_key").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
        sums = sums.select("_null", "_key", "_at", F.coalesce(F.sum("_s").over(w), F.lit(0.0)).alias("_s0"), F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_n0"))
        out = out.withColumn("_null", key[0]).withColumn("_key", key[1]).join(sums, ["_null", "_key", "_at"])
        # Up to the last row of the same place in the order, less that place's own rows.
        inside = W.partitionBy("_null", "_key", "_at").orderBy(*order).rangeBetween(W.unboundedPreceding, 0)
        same = W.partitionBy("_null", "_key", "_at", *order)
        s = F.coalesce(F.sum(y).over(inside), F.lit(0.0)) - F.coalesce(F.sum(y).over(same), F.lit(0.0)) + F.col("_s0")
        n = F.count(y).over(inside) - F.count(y).over(same) + F.col("_n0")
        out = out.withColumn(f"{c}_statistic", (s + F.lit(prior * weight)) / (n + F.lit(weight))).drop("_null", "_key", "_s0", "_n0")
    return out.drop("_at")


class Categorical:
    """Symmetric trees on numbers and ordered statistics of categories, in time order.

    At the fit a row has the statistics of strictly earlier rows; a row to predict has those of all training rows, and the
    prior where its category was not seen.
    """

    def __init__(self, numeric: list[str], categorical: list[str], order: list[str], weight: float = 1.0, **settings):
        if not categorical:
            raise ValueError("categories are needed")
        self.numeric, self.categorical, self.order, self.weight, self.prior, self.totals = list(numeric), list(categorical), list(order), float(weight), 0.0, {}
        self.trees = Boosted(self.numeric + [f"{c}_statistic" for c in categorical], growth="symmetric", **settings)

    def fit(self, train: DataFrame, label: str) -> Categorical:
        y = F.col(f"`{label}`").cast("double")
        train = stored(train.where(y.isNotNull() & ~F.isnan(y)).select(*{*self.numeric, *self.categorical, *self.order, label}))
        self.prior = float(train.agg(F.avg(y.cast("decimal(38,12)"))).first()[0] or 0.0)
        self.trees.fit(ordered_statistics(train, self.categorical, label, self.order, self.prior, self.weight), label)
        # Kept as tables: a category may have any number of levels.
        self.totals = {
            c: stored(train.groupBy(F.col(f"`{c}`").cast("string").alias("_key")).agg(F.sum(y.cast("decimal(38,12)")).cast("double").alias("_s"), F.count(y).alias("_n")))
            for c in self.categorical
        }
        drop(train)
        return self

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        out = df
        for c, table in self.totals.items():
            known = table.withColumn("_null", F.col("_key").isNull()).withColumn("_key", F.coalesce("_key", F.lit("")))
            out = out.withColumn("_null", F.col(f"`{c}`").isNull()).withColumn("_key", F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")))
            out = out.join(known, ["_null", "_key"], "left")
            s, n = F.coalesce("_s", F.lit(0.0)), F.coalesce("_n", F.lit(0))
            out = out.withColumn(f"{c}_statistic", (s + F.lit(self.prior * self.weight)) / (n + F.lit(self.weight))).drop("_null", "_key", "_s", "_n")
        return self.trees.predict(out, name).select(*df.columns, name)


def permutation_importances(
    df: DataFrame, predict, features: list[str], key: str, y: str = "y", p: str = "prediction", seed: int = 42, rows: int = 256
) -> DataFrame:
    """(feature, rmse, increase): the error when a feature's values change places, and what it adds to the error of the rows as they are.

    Rows are dealt by hash of key to blocks of about so many rows and put in order of another hash; a feature's values move
    on by a number of places that the block and the feature decide. So no sort spans the table, and reruns agree. predict
    adds p to a DataFrame; it is called once, on each row with one feature changed at a time.
    """
    if not features:
        raise ValueError("features are needed")
    n = df.count()
    number = lambda *x: F.conv(F.substring(F.md5(F.concat_ws("|", *x)), 1, 8), 16, 10).cast("long")
    k = F.col(key).cast("string")
    held = F.struct(*df.columns)
    blocks = df.select((number(F.lit(f"{seed}b"), k) % max(1, -(-n // rows))).alias("_b"), F.md5(F.concat_ws("|", F.lit(f"{seed}o"), k)).alias("_o"), held.alias("_r"))
    blocks = blocks.groupBy("_b").agg(F.sort_array(F.collect_list(F.struct("_o", F.col(f"_r.{key}").alias("_k"), "_r"))).alias("_rows"))
    shifts = F.array(
        F.struct(F.lit(None).cast("string").alias("feature"), F.lit(0).cast("long").alias("by")),
        *(F.struct(F.lit(c).alias("feature"), (1 + number(F.lit(f"{seed}s{c}"), F.col("_b").cast("string")) % F.greatest(F.size("_rows") - 1, F.lit(1))).alias("by")) for c in features)
    )
    each = blocks.select("_rows", F.explode(shifts).alias("_s")).select("_rows", "_s", F.posexplode("_rows").alias("_i", "_own"))
    other = F.element_at("_rows", ((F.col("_i") + F.col("_s.by")) % F.size("_rows") + 1).cast("int"))
    each = each.select("_s.feature", F.col("_own._r").alias("_r"), other["_r"].alias("_o"))
    value = lambda c: F.when(F.col("feature") == c, F.col(f"_o.{c}")).otherwise(F.col(f"_r.{c}")) if c in features else F.col(f"_r.{c}")
    moved = each.select(F.col("feature").alias("_feature"), *(value(c).alias(c) for c in df.columns))
    e = F.col(y) - F.col(p)
    errors = predict(moved).groupBy("_feature").agg(F.sqrt(F.avg(e * e)).alias("rmse"))
    # As many rows as features, and one for the rows as they are.
    one = errors.agg(F.max(F.when(F.col("_feature").isNull(), F.col("rmse"))).alias("_asis"), F.collect_list(F.struct(F.col("_feature").alias("feature"), "rmse")).alias("_e"))
    return one.select("_asis", F.inline("_e")).where("feature is not null").select("feature", "rmse", (F.col("rmse") - F.col("_asis")).alias("increase"))


def most_important(importances: DataFrame, n: int = 10, by: str = "increase", tie: str = "feature") -> DataFrame:
    return importances.orderBy(F.desc(by), tie).limit(n)
