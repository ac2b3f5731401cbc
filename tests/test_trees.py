import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegate.functions import storage
from tidegate.plans import selection
from tidegate.plans.trees import Boosted, Categorical, ordered_statistics, permutation_importances


class Brute:
    """The trees of one process: rows are moved about, sums are taken split by split in whole numbers."""

    def __init__(self, x, y, kinds, edges, levels, growth, rounds=3, depth=3, leaves=6, rate=0.3, l2=1.0, least=2.0, smooth=10.0, ones=1.0):
        self.x, self.kinds, self.edges, self.levels, self.l2, self.least, self.smooth = x, kinds, edges, levels, l2, least, smooth
        self.base = sum(y) / len(y)
        self.unit = 2.0 ** (math.ceil(math.log2(max(map(abs, y)) + abs(self.base))) - 24)
        self.w = [ones if v == 1 else 1.0 for v in y]
        self.scores = [self.base] * len(y)
        for _ in range(rounds):
            self.g = [round(w * (s - v) / self.unit) for w, s, v in zip(self.w, self.scores, y)]
            for rows in self.grow(growth, depth, leaves):
                g, h = self.total(rows)
                for i in rows:
                    self.scores[i] += rate * -(g * self.unit) / (h + l2)

    def total(self, rows):
        return sum(self.g[i] for i in rows), sum(self.w[i] for i in rows)

    def part(self, rows):
        g, h = self.total(rows)
        return (g * self.unit) ** 2 / (h + self.l2)

    def sides(self, f, rows, ordered):
        """Sets of rows that may go left, by tests on raw values."""
        values = {i: self.x[i][f] for i in rows}
        if self.kinds[f] == "number":
            for missing in (False, True):
                for e in [*self.edges[f], math.inf]:
                    yield ("n", e, missing), [i for i, v in values.items() if (missing if v is None else v <= e)]
            return
        by = {v: self.total([i for i in rows if values[i] == v]) for v in self.levels[f] if v in values.values()}
        order = sorted(by, key=lambda v: (by[v][0] * self.unit / (by[v][1] + self.smooth), v))
        for k in range(len(order)):
            yield ("c", tuple(order[: k + 1])), [i for i, v in values.items() if v in order[: k + 1]]

    def best(self, rows):
        found, top = None, 0.0
        for f in range(len(self.kinds)):
            for test, left in self.sides(f, rows, False):
                right = sorted(set(rows) - set(left))
                if min(self.total(left)[1], self.total(right)[1]) < self.least:
                    continue
                gain = self.part(left) + self.part(right) - self.part(rows)
                if gain > top + 1e-12 * abs(top):
                    found, top = (gain, left, right), gain
        return found

    def grow(self, growth, depth, leaves):
        rows = list(range(len(self.x)))
        if growth == "level":
            def down(rows, d):
                b = self.best(rows) if d else None
                return down(b[1], d - 1) + down(b[2], d - 1) if b else [rows]

            return down(rows, depth)
        if growth == "leaf":
            out = [(self.best(rows), rows)]
            while len(out) < leaves and any(b for b, _ in out):
                k = max((k for k in range(len(out)) if out[k][0]), key=lambda k: out[k][0][0])
                b, _ = out.pop(k)
                out += [(self.best(b[1]), b[1]), (self.best(b[2]), b[2])]
            return [r for _, r in out]
        nodes = [rows]
        for _ in range(depth):
            found, top = None, 0.0
            for f in range(len(self.kinds)):
                each = [list(self.sides(f, r, True)) for r in nodes]
                for k in range(len(each[0])):
                    pairs = [(e[k][1], sorted(set(r) - set(e[k][1]))) for e, r in zip(each, nodes)]
                    if not any(min(self.total(a)[1], self.total(b)[1]) >= self.least for a, b in pairs):
                        continue
                    gain = sum(self.part(a) + self.part(b) - self.part(a + b) for a, b in pairs)
                    if gain > top + 1e-12 * abs(top):
                        found, top = pairs, gain
            if not found:
                break
            nodes = [side for pair in found for side in pair]
        return [n for n in nodes if n]


def made_up(n=240, seed=4):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        a, b = float(rng.normal()), float(rng.integers(0, 6))
        c = [None, "u", "v", "w", "xx", "y"][int(rng.integers(0, 6))]
        y = 3 * (a > 0.3) - 2 * (b == 2) + {"u": 4, "xx": -3}.get(c, 0) + float(rng.normal()) * 0.3
        out.append((i, None if rng.random() < 0.2 else a, None if rng.random() < 0.05 else b, c, 1.0 if rng.random() < 0.1 else round(y, 3)))
    return out


SCHEMA = "k long, a double, b double, c string, y double"


@pytest.mark.parametrize("growth", ["level", "leaf", "symmetric"])
def test_against_one_process(spark, growth):
    rows = made_up()
    df = spark.createDataFrame([*rows, (999, 1.0, 1.0, "u", None)], SCHEMA)
    categorical = ["c"] if growth == "leaf" else []
    settings = {"growth": growth, "rounds": 9 if growth == "level" else 3, "depth": 3, "leaves": 6, "rate": 0.3, "least_weight": 2.0, "bins": 8, "ones_weight": 2.5}
    models = [Boosted(["a", "b"], categorical, ahead=n, **settings).fit(df.repartition(n), "y") for n in (1, 5)]
    assert models[0].trees and [t.as_dict() for t in models[0].trees] == [t.as_dict() for t in models[1].trees]
    edges = models[0].bins.edges
    for c, at in (("a", 1), ("b", 2)):
        known = [r[at] for r in rows if r[at] is not None]
        assert edges[c] == sorted(set(np.percentile(known, [100 * k / 8 for k in range(1, 8)]).tolist())) or np.allclose(edges[c], sorted(set(np.percentile(known, [100 * k / 8 for k in range(1, 8)]))))
    x = [[r[1], r[2]] + ([r[3]] if categorical else []) for r in rows]
    brute = Brute(x, [r[4] for r in rows], ["number", "number"] + ["category"] * len(categorical), [edges["a"], edges["b"]],
                  [None, None, models[0].bins.levels.get("c")], growth, settings["rounds"], ones=2.5)
    got = {r.k: r.prediction for r in models[1].predict(df).collect()}
    assert np.allclose([got[r[0]] for r in rows], brute.scores, atol=1e-9)
    errors = [np.mean([(p - r[4]) ** 2 for p, r in zip(s, rows)]) for s in ([brute.base] * len(rows), [got[r[0]] for r in rows])]
    assert errors[1] < 0.8 * errors[0]


def test_missing_and_unseen(spark):
    """Missing values go where they belong; a level that the fit did not see is treated as missing."""
    rows = [(i, None if i % 4 == 0 else float(i % 3), 0.0, "pq"[i % 2], (5.0 if i % 4 == 0 else 0.0) + i % 2) for i in range(200)]
    model = Boosted(["a"], ["c"], growth="leaf", rounds=30, rate=0.5, l2=0.0).fit(spark.createDataFrame(rows, SCHEMA), "y")
    new = spark.createDataFrame([(1, None, 0.0, "p", 0.0), (2, 1.0, 0.0, "q", 0.0), (3, float("nan"), 0.0, "never", 0.0), (4, 9.0, 0.0, None, 0.0)], SCHEMA)
    got = {r.k: r.prediction for r in model.predict(new).collect()}
    assert abs(got[1] - 5) < 0.1 and abs(got[2] - 1) < 0.1 and got[3] > 4.5 and got[4] < 1.5
    gains = model.importances()
    assert abs(sum(gains.values()) - 1) < 1e-12 and gains["a"] > gains["c"] > 0 and set(model.importances("splits")) == {"a", "c"}


def test_edges(spark, tmp_path):
    df = spark.createDataFrame(made_up(60), SCHEMA)
    empty = Boosted(["a"]).fit(df.limit(0), "y")
    assert empty.trees == [] and {r.prediction for r in empty.predict(df).collect()} == {0.0}
    flat = Boosted(["a", "b"], rounds=2).fit(df.withColumn("y", F.lit(2.5)), "y")
    assert {r.prediction for r in flat.predict(df).collect()} == {2.5}
    model = Boosted(["a"], ["c"], growth="leaf", rounds=3).fit(df, "y")
    model.save(str(tmp_path / "m"))
    again = Boosted.load(str(tmp_path / "m"))
    assert sorted(map(tuple, again.predict(df).collect()), key=str) == sorted(map(tuple, model.predict(df).collect()), key=str)
    for bad in ({"growth": "up"}, {"bins": 1}, {"rate": 0}):
        with pytest.raises(ValueError):
            Boosted(["a"], **bad)
    with pytest.raises(ValueError):
        Boosted(["a"], ["a"])


def brute_statistics(rows, at, prior, weight=1.0):
    out = {}
    for r in rows:
        seen = [s[4] for s in rows if s[at] == r[at] and s[0] // 3 < r[0] // 3 and s[4] is not None]
        out[r[0]] = (sum(seen) + prior * weight) / (len(seen) + weight)
    return out


def test_ordered_statistics(spark):
    """Equal to the definition; a changed label changes nobody's statistic but later ones of its category."""
    rows = [r[:4] + (None if r[0] % 17 == 0 else r[4],) for r in made_up(150)]
    stats = lambda rows: {
        r.k: r.c_statistic for r in ordered_statistics(
            spark.createDataFrame(rows, SCHEMA).withColumn("t", F.floor(F.col("k") / 3)).repartition(3), ["c"], "y", ["t"], 0.7, blocks=5
        ).collect()
    }
    got, want = stats(rows), brute_statistics(rows, 3, 0.7)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    for at in (7, 80, 149):
        changed = [r[:4] + (99.0,) if r[0] == at else r for r in rows]
        after = stats(changed)
        moved = {k for k in got if abs(got[k] - after[k]) > 1e-9}
        assert moved == {r[0] for r in rows if r[3] == rows[at][3] and r[0] // 3 > at // 3}


def test_categorical_family(spark):
    rows = made_up(200)
    df = spark.createDataFrame(rows, SCHEMA)
    model = Categorical(["a", "b"], ["c"], ["k"], rounds=5, depth=3, rate=0.3, bins=8).fit(df, "y")
    new = spark.createDataFrame([(1, 0.0, 1.0, "never", 0.0), (2, 0.0, 1.0, "u", 0.0), (3, 0.0, 1.0, None, 0.0)], SCHEMA)
    got = {r.k: r.prediction for r in model.predict(new).collect()}
    assert got[2] > got[1] and model.predict(new).columns == [*new.columns, "prediction"]
    for t in model.trees.trees:  # one test for all nodes of a level
        levels = {0: [0]}
        while levels[max(levels)]:
            here = levels[max(levels)]
            assert len({(t.feature[n], tuple(np.flatnonzero(t.table[n]))) for n in here}) == 1
            levels[max(levels) + 1] = [c for n in here if t.feature[n] >= 0 for c in (t.left[n], t.right[n])]


def test_permutation_importances(spark):
    df = spark.createDataFrame([(i, float(i % 13), float(i % 7), 2.0 * (i % 13)) for i in range(500)], "k long, a double, b double, y double")
    predict = lambda d: d.withColumn("prediction", F.col("a") * 2 + F.col("b") * 0)
    got = {r.feature: r for r in permutation_importances(df, predict, ["a", "b"], "k", rows=50).collect()}
    again = {r.feature: r for r in permutation_importances(df.repartition(7), predict, ["a", "b"], "k", rows=50).collect()}
    assert got["b"].increase == 0.0 and 5 < got["a"].increase < 15 and got["a"].rmse == pytest.approx(again["a"].rmse, abs=1e-9)
    assert permutation_importances(df.limit(0), predict, ["a"], "k").collect() == []


@pytest.mark.parametrize("by", [[], ["g"]])
def test_quantiles_without_value_maps(spark, by):
    rng = np.random.default_rng(9)
    rows = [([None, "p", "q"][i % 3], float(rng.integers(0, 20)), None if i % 5 == 0 else float(np.exp(rng.normal() * 12)) * (-1) ** i, None) for i in range(900)]
    df = spark.createDataFrame([*rows, ("lone", 1.5, float("inf"), None), ("lone", 1.5, float("nan"), None)], "g string, u double, v double, w double")
    at = [0.0, 0.025, 0.25, 0.5, 0.75, 0.99, 1.0]
    finite = df.withColumn("v", F.when(F.abs("v") < float("inf"), F.col("v")))
    want = finite.groupBy(*by).agg(*(F.percentile(c, F.array(*map(F.lit, at))).alias(c) for c in "uvw")).collect()
    assert sorted(selection.quantiles(df, by, ["u", "v", "w"], at, 64 if by else 4096).collect(), key=str) == sorted(want, key=str)
    assert len(selection.quantiles(df.limit(0), by, ["u"], at).collect()) == (not by)


def test_a_value_looks_at_the_intervals_of_its_bin(spark, monkeypatch):
    """63 quantiles leave up to 126 open intervals; later passes look them up by bin, and the values are numpy's."""
    plans = []

    def noted(df):
        plans.append(df._jdf.queryExecution().analyzed().toString())
        return storage.stored(df)

    monkeypatch.setattr(selection, "stored", noted)
    x = np.random.default_rng(6).lognormal(0, 3, 500)
    p = [k / 64 for k in range(1, 64)]
    got = selection.quantiles(spark.createDataFrame([(float(v),) for v in x], "v double"), [], ["v"], p, bins=64).first().v
    assert np.allclose(got, np.quantile(x, p), rtol=1e-12, atol=0)
    passes = [t for t in plans if "posexplode" in t or "explode" in t]
    assert len(passes) > 1 and all("element_at" in t for t in passes)
