"""Queries of tree models, their statistics and importances, rule search, replicates and exact quantiles over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import storage
from ..operators import ingest
from ..sources import windows
from . import adapter, evaluate, policy, selection, trees
from .queries import query, tidy
from .study_queries import CONTROLS, PRED, controls

NUMBERS = ["history_count", "oldest_pending_minutes", "previous_delay", "context_arrival_180m_max_delay"]


def parted(spark, sf_dir):
    """Controls in time order with their part, development or test."""
    rows = ingest.row_ids(controls(spark, sf_dir).drop("row_id"), ["t", "o_orderkey"])
    return evaluate.chronological(rows, rows.count())


def scored(model, rows):
    fitted = model.fit(rows.where("part = 'development'"), "y")
    return tidy(fitted.predict(rows).select("o_orderkey", "part", "y", "prediction"), 6)


@query("histogram_boosted_scores")
def histogram_boosted_scores(spark, sf_dir):
    """Trees by level with a learned side for missing values, fitted on the development part and applied to all rows."""
    return scored(trees.Boosted(NUMBERS, rounds=3, depth=3, ones_weight=2.0), parted(spark, sf_dir))


@query("leafwise_scores")
def leafwise_scores(spark, sf_dir):
    """Trees leaf by leaf, with categories as they are."""
    return scored(trees.Boosted(NUMBERS, ["status", "priority"], growth="leaf", rounds=2, leaves=8), parted(spark, sf_dir))


@query("categorical_scores")
def categorical_scores(spark, sf_dir):
    """Symmetric trees on ordered statistics of categories."""
    return scored(trees.Categorical(NUMBERS[:2], ["priority", "o_custkey"], ["t", "o_orderkey"], rounds=2, depth=3), parted(spark, sf_dir))


def earlier(category: str) -> str:
    rows = f"PARTITION BY {category} ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP"
    return f"round((coalesce(sum(y) OVER ({rows}), 0) + 1.5 * 2) / (count(y) OVER ({rows}) + 2), 6) AS {category}_statistic"


@query("ordered_target_statistics", PRED + f"SELECT o_orderkey, {earlier('priority')}, {earlier('o_custkey')} FROM p")
def ordered_target_statistics(spark, sf_dir):
    """The mean label of a category's strictly earlier rows; a category of all rows' fifth, and one of some rows."""
    out = trees.ordered_statistics(adapter.predictions(spark, sf_dir), ["priority", "o_custkey"], "y", ["t"], 1.5, 2.0)
    return tidy(out.select("o_orderkey", "priority_statistic", "o_custkey_statistic"), 6)


def hashed(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)"


@query("permutation_importance", PRED + f""", f AS (SELECT *, CAST(o_custkey % 11 AS DOUBLE) AS load FROM p),
b AS (SELECT *, {hashed("'42b|' || o_orderkey")} % greatest(1, CAST(ceil(n / 256.0) AS BIGINT)) AS block FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY md5('42o|' || o_orderkey)) - 1 AS i, count(*) OVER (PARTITION BY block) AS size FROM b),
s AS (SELECT r.*, feature, (i + 1 + {hashed("'42s' || feature || '|' || block")} % greatest(size - 1, 1)) % size AS other FROM r, (VALUES ('p'), ('b'), ('load')) v(feature)),
m AS (SELECT s.feature, s.y, CASE WHEN s.feature = 'p' THEN x.p ELSE s.p END AS p, CASE WHEN s.feature = 'b' THEN x.b ELSE s.b END AS b, CASE WHEN s.feature = 'load' THEN x.load ELSE s.load END AS load FROM s JOIN r x ON x.block = s.block AND x.i = s.other),
e AS (SELECT feature, sqrt(avg(power(y - (0.7 * p + 0.3 * b + 0.05 * load), 2))) AS rmse FROM m GROUP BY feature), a AS (SELECT sqrt(avg(power(y - (0.7 * p + 0.3 * b + 0.05 * load), 2))) AS asis FROM f)
SELECT feature, round(rmse, 6) AS rmse, round(rmse - asis, 6) AS increase FROM e, a ORDER BY rmse - asis DESC, feature LIMIT 2""")
def permutation_importance(spark, sf_dir):
    """The two inputs on which fixed scores depend most."""
    rows = adapter.predictions(spark, sf_dir).withColumn("load", (F.col("o_custkey") % 11).cast("double"))
    predict = lambda df: df.withColumn("prediction", 0.7 * F.col("p") + 0.3 * F.col("b") + 0.05 * F.col("load"))
    return tidy(trees.most_important(trees.permutation_importances(rows, predict, ["p", "b", "load"], "o_orderkey"), 2), 6)


@query("gain_importances")
def gain_importances(spark, sf_dir):
    """The features whose splits gain most in trees fitted on the development part."""
    model = trees.Boosted(NUMBERS, ["priority"], growth="leaf", rounds=2, leaves=6).fit(parted(spark, sf_dir).where("part = 'development'"), "y")
    rows = [(c, float(v)) for c, v in model.importances().items()]
    return tidy(trees.most_important(spark.createDataFrame(rows, "feature string, gain double"), 3, "gain"), 6)


@query(
    "exact_quantiles",
    "SELECT l_returnflag, " + ", ".join(
        f"round(quantile_cont({x}, {p}), 6) AS {name}_{k}" for x, name in (("l_extendedprice", "price"), ("l_quantity", "quantity")) for k, p in enumerate((0.025, 0.5, 0.975))
    ) + " FROM lineitem GROUP BY l_returnflag"
)
def exact_quantiles(spark, sf_dir):
    """Quantiles of two columns by group, from counting passes."""
    rows = adapter.read(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"))
    q = selection.quantiles(rows, ["l_returnflag"], ["price", "quantity"], [0.025, 0.5, 0.975])
    return tidy(q.select("l_returnflag", *(F.get(c, F.lit(k)).alias(f"{c}_{k}") for c in ("price", "quantity") for k in range(3))), 6)


CONFIGURATIONS = 12


@query("rule_search", CONTROLS + f""", r AS (SELECT * FROM (VALUES (10.0), (20.0), (30.0)) a(cap), (VALUES (120.0), (180.0), (240.0), (300.0)) b(threshold), (VALUES (1.0), (1.25), (1.5), (1.75), (2.0)) m(multiplier)),
w AS (SELECT i, printf('c%02d', i) AS configuration FROM range({CONFIGURATIONS}) x(i)), z AS (SELECT c.*, configuration, CASE WHEN o_orderkey % 23 <> i THEN p * i / {CONFIGURATIONS - 1} + b * (1 - i / {CONFIGURATIONS - 1}) END AS z FROM c, w WHERE fold >= 0),
j AS (SELECT configuration, fold, cap, threshold, multiplier, y - CASE WHEN history_count > 0 THEN CASE WHEN oldest_pending_minutes > threshold THEN greatest(z, multiplier * oldest_pending_minutes) ELSE z END WHEN is_departure = 1 THEN least(z, cap) ELSE z END AS e FROM z, r),
g AS (SELECT configuration, fold, cap, threshold, multiplier, sqrt(avg(e * e)) AS m FROM j GROUP BY ALL)
SELECT configuration, CAST(cap AS DOUBLE) AS cap, CAST(threshold AS DOUBLE) AS threshold, CAST(multiplier AS DOUBLE) AS multiplier, round(avg(m), 6) AS mean_rmse FROM g GROUP BY ALL""")
def rule_search(spark, sf_dir):
    """All 720 rules on twelve blends, from sums of cells."""
    names = {f"c{i:02d}": i / (CONFIGURATIONS - 1) for i in range(CONFIGURATIONS)}
    rows = controls(spark, sf_dir).where("fold >= 0")
    blends = {c: F.when(F.col("o_orderkey") % 23 != i, F.col("p") * F.lit(w) + F.col("b") * F.lit(1 - w)) for i, (c, w) in enumerate(names.items())}
    return tidy(policy.rule_search(rows.withColumns(blends), {c: c for c in names}, policy.rule_grid()).drop("rule", "rank"), 6)


#: Random candidates; the first of a longer list are those of a shorter one.
CANDIDATES = evaluate.sampled_parameters({"cap": [5.0, 10.0, 20.0, 40.0], "threshold": [60.0, 120.0, 300.0], "multiplier": [0.25, 0.5, 1.0, 1.5]}, 40)


@query(
    "sampled_candidates", CONTROLS + ", r AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {c['cap']}, {c['threshold']}, {c['multiplier']})" for k, c in enumerate(CANDIDATES)) + """) v(candidate, cap, threshold, multiplier)),
j AS (SELECT candidate, fold, y - CASE WHEN history_count > 0 THEN CASE WHEN oldest_pending_minutes > threshold THEN greatest(p, multiplier * oldest_pending_minutes) ELSE p END WHEN is_departure = 1 THEN least(p, cap) ELSE p END AS e FROM c, r WHERE fold >= 0),
g AS (SELECT candidate, fold, sqrt(avg(e * e)) AS m FROM j GROUP BY ALL), s AS (SELECT candidate, avg(m) AS score FROM g GROUP BY candidate)
SELECT CAST(candidate AS BIGINT) AS candidate, round(score, 6) AS score, round(min(score) OVER (ORDER BY candidate), 6) AS best FROM s"""
)
def sampled_candidates(spark, sf_dir):
    """Forty random rules scored on the table's folds, with the best so far."""
    rules = [policy.Rule(c["cap"], c["threshold"], c["multiplier"]) for c in CANDIDATES]
    scores = policy.rule_search(controls(spark, sf_dir).where("fold >= 0"), {"p": "p"}, rules).select(F.col("rule").alias("candidate"), F.col("mean_rmse").alias("score"))
    best = evaluate.best_prefix(scores, budgets=tuple(range(1, len(rules) + 1)))
    return tidy(scores.join(best.withColumn("candidate", F.col("budget").cast("long") - 1).drop("budget"), "candidate"), 6)


@query("multinomial_bootstrap")
def multinomial_bootstrap(spark, sf_dir):
    """Two predictions compared over days drawn with replacement; the weights come from a seeded generator that SQL does not have."""
    rows = adapter.predictions(spark, sf_dir).withColumn("day", F.floor(F.col("t") / F.lit(86_400_000_000)))
    return tidy(evaluate.multinomial_bootstrap(rows, 500, a="p", b="b"), 6)


@query("published_orders", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def published_orders(spark, sf_dir):
    """Orders published as two versions, the second of which is read back after its blocks were verified."""
    rows = adapter.read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    at = storage.new_path(spark)
    windows.publish(rows.where("o_orderstatus = 'F'"), at)
    version = windows.publish(rows, at)
    if windows.verify_published(spark, at, version).count():
        raise ValueError("blocks differ from what was written")
    return windows.read_published(spark, at, version)
