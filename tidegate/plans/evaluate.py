"""Splits, folds, label purging, imputation, scaling, metrics and bootstrap."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def chronological(df: DataFrame, n: int, share: float = 0.8) -> DataFrame:
    """df (row_id 0..n-1) with part: development up to the share, then test."""
    return df.withColumn("part", F.when(F.col("row_id") < int(share * n), "development").otherwise("test"))


def hashed(df: DataFrame, keys: list[str], parts: int, seed: int = 42, name: str = "fold") -> DataFrame:
    """Shuffled folds: by hash, so a row's fold does not depend on the others."""
    text = F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys), F.lit(str(seed)))
    return df.withColumn(name, (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % parts).cast("int"))


def expanding(df: DataFrame, n: int, k: int, time: str = "t") -> DataFrame:
    """df (row_id 0..n-1 in time order) with fold: its validation block in k expanding folds, -1 before the first.

    Fold i validates n // (k + 1) rows from n - (k - i) * (n // (k + 1)) on; a boundary inside equal times moves to the first of them.
    """
    size = n // (k + 1)
    if not size:
        raise ValueError("too few rows for the folds")
    edges = [n - (k - i) * size for i in range(k)]
    # The boundaries are k rows; each moves to where its equal times begin.
    moved = df.where(F.col("row_id").isin(edges)).select(time).distinct().join(
        df.select(time, "row_id"), time
    ).groupBy(time).agg(F.min("row_id").alias("first"))
    firsts = dict(df.where(F.col("row_id").isin(edges)).join(moved, time).select("row_id", "first").collect())
    fold = F.lit(-1)
    for i, edge in enumerate(edges):
        fold = F.when(F.col("row_id") >= firsts[edge], F.lit(i)).otherwise(fold)
    return df.withColumn("fold", fold)


def purged(df: DataFrame, folds: DataFrame, label_time: str = "act", cut: str = "cut") -> DataFrame:
    """(fold, row_id) of training rows: before the fold's first row, with labels strictly older than its least cut. As many folds as there are."""
    edges = folds.where("fold >= 0").groupBy("fold").agg(F.min("row_id").alias("begin"), F.min(cut).alias("least")).orderBy("fold").collect()
    if not edges:
        return df.select(F.lit(0).alias("fold"), "row_id").limit(0)
    each = F.array(*(F.struct(F.lit(r.fold).alias("fold"), F.lit(r.begin).alias("begin"), F.lit(r.least).alias("least")) for r in edges))
    rows = df.select("row_id", label_time, F.explode(each).alias("e"))
    return rows.where((F.col("row_id") < F.col("e.begin")) & (F.col(label_time) < F.col("e.least"))).select("e.fold", "row_id")


def describe(df: DataFrame, by: list[str], time: str, label: str) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count("*").alias("rows"), F.min(time).alias("first_time"), F.max(time).alias("last_time"), F.avg(label).alias("target_mean"),
        F.stddev_pop(label).alias("target_std"), F.avg(F.abs(label)).alias("mean_absolute_target")
    )


def shared_runs(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys)).agg(F.count("*").alias("shared_runs"))


def impute(df: DataFrame, group: str, columns: list[str], most: float = 0.3, quantiles=None) -> DataFrame:
    """Missing values become their group's median; a column that a group lacks in more than the share of rows goes there.

    quantiles: selection.quantiles where groups have too many different values for percentile()'s table of them.
    """
    gaps = [F.avg(F.col(c).isNull().cast("double")).alias(f"_g_{c}") for c in columns]
    if quantiles:
        found = quantiles(df, [group], columns, [0.5]).select(F.col(group).alias("_group"), *(F.get(c, F.lit(0)).alias(f"_m_{c}") for c in columns))
        g = df.groupBy(group).agg(*gaps).join(found, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")
    else:
        g = df.groupBy(group).agg(*(F.median(c).alias(f"_m_{c}") for c in columns), *gaps)
    kept = [c for c in df.columns if c not in columns]
    return df.join(g, group).select(*kept, *(F.when(F.col(f"_g_{c}") <= most, F.coalesce(c, f"_m_{c}")).alias(c) for c in columns))


def robust_scale(df: DataFrame, train: DataFrame, columns: list[str], quantiles=None) -> DataFrame:
    """Median and quartiles of the training rows only; a column without spread keeps its scale. quantiles: as in impute()."""
    at = [0.25, 0.5, 0.75]
    q = (quantiles(train, [], columns, at) if quantiles else train.agg(*(F.percentile(c, F.array(*map(F.lit, at))).alias(c) for c in columns))).first()
    scaled = lambda c, low, mid, high: ((F.col(c) - F.lit(mid)) / F.lit(high - low if high > low else 1.0)).alias(c)
    return df.select(
        *(c for c in df.columns if c not in columns),
        *(scaled(c, *(q[c] or (None, None, None))) if q[c] else F.lit(None).cast("double").alias(c) for c in columns)
    )


def metrics(df: DataFrame, by: list[str] = [], y: str = "y", p: str = "p") -> DataFrame:
    """r2, rmse, mae, wmape and its signed form in one pass; null where a denominator is 0."""
    e = F.col(y) - F.col(p)
    g = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(e * e).alias("_e2"), F.sum(F.abs(e)).alias("_e1"), F.sum(F.abs(y)).alias("_y1"),
        F.sum(y).alias("_y"), F.var_pop(y).alias("_v")
    )
    div = lambda a, b: F.try_divide(a, F.nullif(b, F.lit(0.0)))
    return g.select(
        *by, "n", (1 - div(F.col("_e2"), F.col("_v") * F.col("n"))).alias("r2"), F.sqrt(F.col("_e2") / F.col("n")).alias("rmse"),
        (F.col("_e1") / F.col("n")).alias("mae"), (100 * div(F.col("_e1"), F.col("_y1"))).alias("wmape"),
        (100 * div(F.col("_e1"), F.col("_y"))).alias("wmape_signed")
    )


def mean_fold_rmse(df: DataFrame, fold: str = "fold", y: str = "y", p: str = "p") -> DataFrame:
    """The mean of the folds' rmse beside the pooled one; the two differ."""
    e = (F.col(y) - F.col(p)) * (F.col(y) - F.col(p))
    g = df.groupBy(fold).agg(F.sum(e).alias("s"), F.count("*").alias("n"))
    return g.agg(F.avg(F.sqrt(F.col("s") / F.col("n"))).alias("mean_fold_rmse"), F.sqrt(F.sum("s") / F.sum("n")).alias("pooled_rmse"))


def best_prefix(scores: DataFrame, order: str = "candidate", score: str = "score", budgets: tuple = (10, 20, 50, 100)) -> DataFrame:
    """The best score among the first k candidates, for each budget."""
    w = W.orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return scores.select(F.row_number().over(W.orderBy(order)).alias("budget"), F.min(score).over(w).alias("best")).where(F.col("budget").isin(list(budgets)))


def bootstrap_weights(days: int, reps: int, seed: int = 42) -> np.ndarray:
    """Multinomial weights of days, one row for each replicate."""
    return np.random.default_rng(seed).multinomial(days, np.full(days, 1 / days), size=reps)


def _day_sums(df: DataFrame, day: str, y: str, a: str, b: str) -> DataFrame:
    err = lambda c: F.col(c) - F.col(y)
    return df.groupBy(day).agg(
        F.count("*").alias("n"), *(F.sum(F.abs(err(c))).alias(f"{c}1") for c in (a, b)),
        *(F.sum(err(c) * err(c)).alias(f"{c}2") for c in (a, b))
    )


def _intervals(seen: DataFrame, reps: DataFrame, a: str, b: str) -> DataFrame:
    """(metric, difference, low, high, reps) from the sums of all days and those of each replicate."""
    delta = [
        (F.col(f"{a}1") / F.col("n") - F.col(f"{b}1") / F.col("n")).alias("mae"),
        (F.sqrt(F.col(f"{a}2") / F.col("n")) - F.sqrt(F.col(f"{b}2") / F.col("n"))).alias("rmse")
    ]
    seen, reps, out = seen.select(*delta), reps.select(*delta), None
    for m in ("mae", "rmse"):
        q = reps.agg(F.percentile(m, F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.count("*").alias("reps"))
        row = seen.select(F.lit(m).alias("metric"), F.col(m).alias("difference")).join(q).select(
            "metric", "difference", F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"), "reps"
        )
        out = row if out is None else out.unionByName(row)
    return out


def paired_bootstrap(df: DataFrame, weights: DataFrame, day: str = "day", y: str = "y", a: str = "a", b: str = "b") -> DataFrame:
    """Differences of mae and rmse of two predictions with 95% intervals from day blocks.

    Rows are summed by day first; weights (rep, day, w) then join the days' sums, so only replicates times days rows meet.
    """
    d = _day_sums(df, day, y, a, b)
    sums = lambda w: [F.sum(F.col(c) * w).alias(c) for c in ("n", f"{a}1", f"{b}1", f"{a}2", f"{b}2")]
    return _intervals(d.agg(*sums(F.lit(1))), d.join(weights, day).groupBy("rep").agg(*sums(F.col("w"))), a, b)


#: Days whose weights are drawn together.
DAY_BLOCK = 1024


def block_draws(days: int, block: int, reps: int, seed: int, size: int = DAY_BLOCK) -> np.ndarray:
    """(replicate, day of the block) how often each day is drawn, of as many draws with replacement as there are days.

    The draws go down a binary tree over blocks: at each node a binomial number goes left, with a generator seeded by the
    node. A block needs the nodes above it only, so any task can make any block's weights, and always the same ones.
    """
    left, right, draws = 0, -(-days // size), np.full(reps, days)
    while right - left > 1:
        middle = (left + right) // 2
        here = min(right * size, days) - left * size
        down = np.random.default_rng([seed, left, right]).binomial(draws, (middle - left) * size / here)
        left, right, draws = (left, middle, down) if block < middle else (middle, right, draws - down)
    here = min(right * size, days) - left * size
    return np.random.default_rng([seed, left, right, 1]).multinomial(draws, np.full(here, 1 / here))


def multinomial_bootstrap(
    df: DataFrame, reps: int = 2000, seed: int = 42, day: str = "day", y: str = "y", a: str = "a", b: str = "b", size: int = DAY_BLOCK
) -> DataFrame:
    """As paired_bootstrap, with multinomial weights that each task makes for its own blocks of days.

    No table of weights exists: a block of days' sums times its weights gives one row for each replicate, and these are added.
    Weights depend on the order of the days and the seed alone. A null day is a day. Without rows there is no replicate.
    """
    from ..functions.storage import stored
    from ..operators.ingest import row_ids

    d = stored(row_ids(_day_sums(df, day, y, a, b), [day], "_at"))
    days = d.count()
    names = ["n", f"{a}1", f"{b}1", f"{a}2", f"{b}2"]

    def replicates(pdf):
        import pandas as pd

        pdf = pdf.sort_values("_at")
        w = block_draws(days, int(pdf["_at"].iloc[0]) // size, reps, seed, size)
        out = pd.DataFrame(w @ pdf[names].to_numpy(float), columns=names)
        out.insert(0, "rep", np.arange(reps))
        return out

    parts = d.groupBy(F.floor(F.col("_at") / size).alias("_block")).applyInPandas(replicates, "rep long, " + ", ".join(f"`{c}` double" for c in names))
    return _intervals(d.agg(*(F.sum(c).alias(c) for c in names)), parts.groupBy("rep").agg(*(F.sum(c).alias(c) for c in names)), a, b)


def largest_errors(df: DataFrame, k: int = 20, y: str = "y", p: str = "p", tie: str = "row_id") -> DataFrame:
    return df.withColumn("abs_error", F.abs(F.col(y) - F.col(p))).orderBy(F.desc("abs_error"), tie).limit(k)


def input_ages(df: DataFrame, prediction: str, stamps: list[str]) -> DataFrame:
    """The least minutes between prediction and each input clock, and rows without one."""
    return df.agg(
        *(F.min((F.col(prediction) - F.col(s)) / F.lit(6e7)).alias(f"{s}_least_age") for s in stamps),
        *(F.count_if(F.col(s).isNull()).alias(f"{s}_missing") for s in stamps)
    )


def audit_summary(df: DataFrame, columns: list[str], quantiles=None) -> DataFrame:
    """(name, n, mean, low quartile, median, high quartile, least, most) of columns, in one scan; with quantiles as in impute(), in some."""
    at = [0.25, 0.5, 0.75]
    known = quantiles(df, [], columns, at).first() if quantiles else None

    def summary(c):
        q = F.lit(known[c]).cast("array<double>") if known else F.percentile(c, F.array(*map(F.lit, at)))
        parts = {"name": F.lit(c), "n": F.count(c), "mean": F.avg(c).cast("double")}
        parts |= {name: F.get(q, F.lit(k)) for k, name in enumerate(("q25", "q50", "q75"))}
        parts |= {"least": F.min(c).cast("double"), "most": F.max(c).cast("double")}
        return F.struct(*(v.alias(k) for k, v in parts.items()))

    return df.agg(F.array(*map(summary, columns)).alias("_s")).select(F.inline("_s"))


def sampled_parameters(space: dict[str, list], n: int, seed: int = 42) -> list[dict]:
    """Random candidates; a longer list begins with a shorter one."""
    rng = np.random.default_rng(seed)
    return [{k: v[int(rng.integers(len(v)))] for k, v in space.items()} for _ in range(n)]
