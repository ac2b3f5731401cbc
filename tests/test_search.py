import math
import random

import numpy as np
import pytest

from tidegate.plans import evaluate, selection
from tidegate.plans.policy import Rule, grid_scores, rule_search


def brute(rows, p_at, rule):
    folds = {}
    for fold, y, q, history, departure, *ps in rows:
        p = ps[p_at]
        if y is None:
            continue
        if history is not None and history > 0:
            if q is not None and rule.threshold is not None and q > rule.threshold:
                p = max(x for x in (p, rule.multiplier * q) if x is not None)
        elif history is not None and departure == 1 and rule.cap is not None:
            p = min(x for x in (p, rule.cap) if x is not None)
        if p is not None:
            folds.setdefault(fold, []).append((y - p) ** 2)
    return np.mean([math.sqrt(np.mean(e)) for e in folds.values()])


def test_rule_search(spark):
    """Every rule on every prediction, with nulls, ties at the cuts, repeated rows and rules without a cap or a floor."""
    rng = random.Random(8)
    pick = lambda values, none=0.1: None if rng.random() < none else rng.choice(values)
    rows = [
        (rng.randrange(3), pick([-3.0, 0.0, 12.5, 300.0], 0.05), pick([0.0, 100.0, 120.0, 240.0, 250.5]), pick([0, 0, 1, 3]), pick([0.0, 1.0, 1.0]),
         pick([-5.0, 10.0, 10.5, 30.0, 250.5]), pick([0.0, 20.0, 480.0])) for _ in range(400)
    ]
    df = spark.createDataFrame([*rows, *rows[:20]], "fold int, y double, oldest_pending_minutes double, history_count int, is_departure double, a double, b double")
    rows += rows[:20]
    rules = [Rule(c, t, m) for c in (10.0, None, 30.0) for t, m in ((100.0, 1.0), (120.0, 2.5), (240.0, 1.0), (None, None))]
    got = rule_search(df, {"first": "a", "second": "b"}, rules).collect()
    assert len(got) == 24 and sorted(r["rank"] for r in got) == list(range(1, 25))
    for r in got:
        want = brute(rows, 0 if r.configuration == "first" else 1, Rule(r.cap, r.threshold, r.multiplier))
        assert r.mean_rmse == pytest.approx(want, abs=1e-9), r
    order = [r.mean_rmse for r in sorted(got, key=lambda r: r["rank"])]
    assert order == sorted(order)
    alone = sorted(r.mean_rmse for r in grid_scores(df, rules, "a").collect())
    assert np.allclose(alone, sorted(r.mean_rmse for r in got if r.configuration == "first"))
    assert rule_search(df.limit(0), {"first": "a"}, rules).collect() == []


def test_draws_of_days():
    """As many draws as days; every block agrees with itself, and days are drawn alike."""
    days, reps, size = 1000, 400, 64
    w = np.concatenate([evaluate.block_draws(days, k, reps, 7, size) for k in range(-(-days // size))], axis=1)
    assert w.shape == (reps, days) and (w.sum(axis=1) == days).all()
    assert (evaluate.block_draws(days, 9, reps, 7, size) == w[:, 9 * size : 10 * size]).all()
    assert abs(w.mean() - 1) < 1e-12 and abs(w.var() - 1) < 0.02 and abs(w.mean(axis=0) - 1).max() < 0.25
    both = np.cov(w[:, 0], w[:, -1])
    assert abs(both[0, 1]) < 0.2


def test_multinomial_bootstrap(spark):
    rng = np.random.default_rng(1)
    rows = [(int(d), float(rng.normal()), float(rng.normal()), float(rng.normal())) for d in rng.integers(0, 150, 3000)] + [(None, 0.0, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "day int, y double, a double, b double")
    got = {n: evaluate.multinomial_bootstrap(df.repartition(n), 300, 5, size=32).collect() for n in (1, 6)}
    for x, z in zip(*got.values()):
        assert tuple(x)[0] == tuple(z)[0] and np.allclose(tuple(x)[1:], tuple(z)[1:], atol=1e-9)
    days = sorted({r[0] for r in rows}, key=lambda d: (d is not None, d))
    s = np.array([[sum(f(r) for r in rows if r[0] == d) for f in (lambda r: 1, lambda r: abs(r[2] - r[1]), lambda r: abs(r[3] - r[1]))] for d in days])
    w = np.concatenate([evaluate.block_draws(len(days), k, 300, 5, 32) for k in range(-(-len(days) // 32))], axis=1)
    n, a, b = (w @ s).T
    mae = got[1][0]
    assert (mae.metric, mae.reps) == ("mae", 300) and np.allclose([mae.low, mae.high], np.percentile((a - b) / n, [2.5, 97.5]))


def test_exact_selection_in_its_users(spark):
    df = spark.createDataFrame([("p" if i % 3 else "q", None if i % 7 == 0 else float(i * 37 % 50), float(i % 11)) for i in range(300)] + [(None, None, 1.0)], "g string, u double, v double")
    same = lambda x, y: sorted(x.collect(), key=str) == sorted(y.collect(), key=str)
    assert same(evaluate.impute(df, "g", ["u"]), evaluate.impute(df, "g", ["u"], quantiles=selection.quantiles))
    assert same(evaluate.robust_scale(df, df.where("v < 9"), ["u", "v"]), evaluate.robust_scale(df, df.where("v < 9"), ["u", "v"], selection.quantiles))
    assert same(evaluate.audit_summary(df, ["u", "v"]), evaluate.audit_summary(df, ["u", "v"], selection.quantiles))
