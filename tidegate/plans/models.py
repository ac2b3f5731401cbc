"""Model families. Fits read the training rows only; each can be saved and loaded.

Ridge needs one pass: the Gram matrix of the prepared features is summed in Spark and solved on the driver, whatever the number of rows.
Boosted trees are Spark ML's. The network is numpy, trained by averaging the gradients of partitions.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: How families take a category: as text with a word for what is missing, as text or nothing, or as a number like all else.
CATEGORIES = {"xgboost": "number", "catboost": "named", "lightgbm": "text", "ridge": "number", "neural": "number"}


def matrix(df: DataFrame, family: str, features: list[str], categorical: list[str] = [], keep: list[str] = []) -> DataFrame:
    """df's columns keep and the features as a family's backend takes them; no statistics of labels or rows enter.

    Numbers are single precision, missing ones stay null. A category is a whole number; what is no number is an error.
    """
    if family not in CATEGORIES:
        raise ValueError(f"unknown family: {family}")
    if missing := [c for c in [*features, *keep] if c not in df.columns]:
        raise ValueError(f"columns missing: {missing}")
    how = CATEGORIES[family]

    def encoded(c):
        number = F.col(f"`{c}`").cast("double")
        number = F.when(~F.isnan(number), number)
        if c not in categorical or how == "number":
            return number.cast("float").alias(c)
        text = number.cast("long").cast("string")
        return (F.coalesce(text, F.lit("missing")) if how == "named" else text).alias(c)

    return df.select(*keep, *map(encoded, features))


#: Levels of a category; one with more is refused.
MOST_LEVELS = 1000


class Preparation:
    """Medians for missing values, an indicator of them, and scales, all from training rows; other columns one-hot."""

    def __init__(self, numeric: list[str], categorical: list[str] = []):
        self.numeric, self.categorical, self.stats, self.levels = numeric, categorical, {}, {}

    def fit(self, train: DataFrame) -> Preparation:
        if self.numeric:
            row = train.agg(*(F.median(c).alias(f"m_{c}") for c in self.numeric), *(F.stddev_pop(c).alias(f"s_{c}") for c in self.numeric)).first()
            self.stats = {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in self.numeric}
        for c in self.categorical:
            found = train.select(F.coalesce(F.col(c).cast("double"), F.lit(-1.0))).distinct().limit(MOST_LEVELS + 1).collect()
            if len(found) > MOST_LEVELS:
                raise ValueError(f"{c} has more than {MOST_LEVELS} levels; it is no category for one-hot columns")
            self.levels[c] = sorted(r[0] for r in found)
        return self

    def columns(self) -> list:
        out = []
        for c, (m, s) in self.stats.items():
            out += [(F.coalesce(F.col(c).cast("double"), F.lit(float(m))) / F.lit(float(s))), F.col(c).isNull().cast("double")]
        for c, levels in self.levels.items():
            out += [(F.coalesce(F.col(c).cast("double"), F.lit(-1.0)) == F.lit(x)).cast("double") for x in levels]
        return out

    def vector(self):
        return F.array(F.lit(1.0), *self.columns())


class Ridge:
    """Least squares with a penalty on all but the intercept."""

    def __init__(self, preparation: Preparation, alpha: float = 1.0, weights=None):
        self.preparation, self.alpha, self.coefficients = preparation, alpha, weights

    def fit(self, train: DataFrame, label: str) -> Ridge:
        self.preparation.fit(train)
        x = train.where(F.col(label).isNotNull()).select(self.preparation.vector().alias("x"), F.col(label).cast("double").alias("y"))
        p = 1 + len(self.preparation.columns())

        def products(batches):
            """A task's sum of the outer products of (x, y)."""
            import pyarrow as pa

            total = np.zeros((p, p + 1))
            for b in batches:
                m = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(b), p)
                total += m.T @ np.hstack([m, b.column(1).to_numpy(zero_copy_only=False)[:, None]])
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["g"])

        # One row of p * (p + 1) sums for each task.
        sums = np.sum([r.g for r in x.mapInArrow(products, "g array<double>").collect()] or [np.zeros(p * (p + 1))], axis=0).reshape(p, p + 1)
        g, b = sums[:, :p], sums[:, p]
        penalty = self.alpha * np.eye(p)
        penalty[0, 0] = 0
        self.coefficients = np.linalg.lstsq(g + penalty, b, rcond=None)[0].tolist()
        return self

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        terms = [F.lit(1.0), *self.preparation.columns()]
        total = F.lit(0.0)
        for w, c in zip(self.coefficients, terms):
            total = total + F.lit(float(w)) * c
        return df.withColumn(name, total)

    def save(self, path: str) -> None:
        p = self.preparation
        with open(path, "w", encoding="utf-8") as f:
            json.dump(
                {
                    "family": "ridge", "numeric": p.numeric, "categorical": p.categorical, "stats": p.stats, "levels": p.levels,
                    "alpha": self.alpha, "coefficients": self.coefficients
                },
                f
            )

    @classmethod
    def load(cls, path: str) -> Ridge:
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        p = Preparation(d["numeric"], d["categorical"])
        p.stats, p.levels = {k: tuple(v) for k, v in d["stats"].items()}, d["levels"]
        return cls(p, d["alpha"], d["coefficients"])


class Network:
    """One hidden layer on prepared features; full-batch steps whose gradients are summed over partitions."""

    def __init__(self, preparation: Preparation, hidden: int = 16, steps: int = 30, rate: float = 0.05, seed: int = 0):
        self.preparation, self.hidden, self.steps, self.rate, self.seed, self.weights = preparation, hidden, steps, rate, seed, None

    def fit(self, train: DataFrame, label: str) -> Network:
        self.preparation.fit(train)
        x = train.where(F.col(label).isNotNull()).select(self.preparation.vector().alias("x"), F.col(label).cast("double").alias("y")).persist()
        stats = x.agg(F.avg("y"), F.stddev_pop("y"), F.count("*")).first()
        mean, scale, n = stats[0] or 0.0, stats[1] or 1.0, max(1, stats[2])
        p, h = 1 + len(self.preparation.columns()), self.hidden
        rng = np.random.default_rng(self.seed)
        w = [rng.standard_normal((p, h)) / np.sqrt(p), rng.standard_normal(h) / np.sqrt(h), np.zeros(1)]
        seen = [np.full(a.shape, 1e-8) for a in w]

        for _ in range(self.steps):
            now = [a.copy() for a in w]

            def gradient(batches, now=now):
                import pandas as pd

                total = [np.zeros_like(a) for a in now]
                for b in batches:
                    if len(b):
                        m = np.stack(b.x.to_numpy())
                        t = np.tanh(m @ now[0])
                        e = t @ now[1] + now[2] - (b.y.to_numpy() - mean) / scale
                        total = [a + g for a, g in zip(total, (m.T @ (np.outer(e, now[1]) * (1 - t * t)), t.T @ e, np.array([e.sum()])))]
                yield pd.DataFrame({"g": [np.concatenate([a.ravel() for a in total])]})

            # One short row for each partition comes back.
            g = np.sum([r.g for r in x.mapInPandas(gradient, "g array<double>").collect()], axis=0) / n
            at = 0
            for k, a in enumerate(w):
                part = g[at : at + a.size].reshape(a.shape)
                at += a.size
                seen[k] += part * part
                a -= self.rate * part / np.sqrt(seen[k])
        x.unpersist()
        self.weights = [a.tolist() for a in w] + [mean, scale]
        return self

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        w1, w2, b, mean, scale = self.weights
        terms = [F.lit(1.0), *self.preparation.columns()]
        total = F.lit(b[0])
        for k, out in enumerate(w2):
            z = F.lit(0.0)
            for row, c in zip(w1, terms):
                z = z + F.lit(row[k]) * c
            total = total + F.lit(out) * F.tanh(z)
        return df.withColumn(name, total * F.lit(scale) + F.lit(mean))

    def save(self, path: str) -> None:
        p = self.preparation
        with open(path, "w", encoding="utf-8") as f:
            json.dump(
                {
                    "family": "network", "numeric": p.numeric, "categorical": p.categorical, "stats": p.stats, "levels": p.levels,
                    "hidden": self.hidden, "weights": self.weights
                },
                f
            )

    @classmethod
    def load(cls, path: str) -> Network:
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        out = cls(Preparation(d["numeric"], d["categorical"]), d["hidden"])
        out.preparation.stats, out.preparation.levels, out.weights = {k: tuple(v) for k, v in d["stats"].items()}, d["levels"], d["weights"]
        return out


class Boosted:
    """Spark ML's boosted trees; missing features are -1 beside an indicator, labels equal to one may weigh more."""

    def __init__(self, features: list[str], ones_weight: float = 1.0, **settings):
        self.features, self.ones_weight, self.settings, self.model = features, float(ones_weight), settings, None

    def prepared(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler

        known = [F.coalesce(F.col(c).cast("double"), F.lit(-1.0)).alias(f"_f_{c}") for c in self.features]
        missing = [F.col(c).isNull().cast("double").alias(f"_n_{c}") for c in self.features]
        return VectorAssembler(inputCols=[f"_{k}_{c}" for k in "fn" for c in self.features], outputCol="_features").transform(df.select("*", *known, *missing))

    def fit(self, train: DataFrame, label: str) -> Boosted:
        from pyspark.ml.regression import GBTRegressor

        rows = self.prepared(train.withColumn("_w", F.when(F.col(label) == 1, self.ones_weight).otherwise(1.0)))
        self.model = GBTRegressor(featuresCol="_features", labelCol=label, weightCol="_w", predictionCol="prediction", seed=42, **self.settings).fit(rows)
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        return self.model.transform(self.prepared(df)).select(*df.columns, "prediction")

    def save(self, path: str) -> None:
        """The trees at path, by Spark; features and settings beside them, as a table of one row."""
        self.model.write().overwrite().save(f"{path.rstrip('/')}/trees")
        spec = json.dumps({"family": "boosted", "features": self.features, "ones_weight": self.ones_weight, "settings": self.settings})
        _session().createDataFrame([(spec,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path.rstrip('/')}/spec")

    @classmethod
    def load(cls, path: str) -> Boosted:
        from pyspark.ml.regression import GBTRegressionModel

        d = json.loads(_session().read.text(f"{path.rstrip('/')}/spec").first()[0])
        out = cls(d["features"], d["ones_weight"], **d["settings"])
        out.model = GBTRegressionModel.load(f"{path.rstrip('/')}/trees")
        return out


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession()


def boosted(train: DataFrame, features: list[str], label: str, ones_weight: float = 1.0, **settings):
    """A fitted Boosted's predict(df)."""
    return Boosted(features, ones_weight, **settings).fit(train, label).predict


def load(path: str):
    """A saved model of any family: a file of ridge or network, or a folder of trees."""
    import os

    if os.path.isdir(path) or "://" in path:
        return Boosted.load(path)
    with open(path, encoding="utf-8") as f:
        family = json.load(f)["family"]
    return {"ridge": Ridge, "network": Network}[family].load(path)
