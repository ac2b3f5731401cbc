"""Queries of ingest, encodings, weather, readiness, evaluation and policy over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import encode
from ..functions.clock import DAY, MINUTE
from ..operators import ingest, origin, weather
from . import adapter, evaluate, policy
from .queries import BASE, INBOUND, home, query, tidy

STUDY = """
WITH x AS (SELECT l_orderkey, l_linenumber, epoch_us(l_shipdate) AS us, l_shipdate AS ts, l_quantity - 25 AS t, l_discount * 100 AS p, l_tax * 60 AS i, l_extendedprice % 20 AS w, l_extendedprice % 27 AS g, l_quantity + 50 AS h, l_quantity - 25 + l_discount * 30 - 1 AS dp,
  CASE WHEN l_linenumber % 3 <> 0 THEN l_tax * 10 END AS s, l_extendedprice % 2000 AS v, l_suppkey AS n, CAST(l_returnflag = 'N' AS DOUBLE) AS stopping FROM lineitem),
c AS (SELECT *, CASE WHEN t < 0 AND (i > 1 OR p > 3) AND (w > 10 OR g > 15) AND v < 1000 THEN 'Blizzard' WHEN t < 0 AND (i > 2 OR p > 5) AND s > 0 THEN 'Heavy Snow' WHEN t < -20 THEN 'Extreme Cold' WHEN t > 2 AND (i > 4 OR p > 10) THEN 'Heavy Rain'
  WHEN t > -2 AND t < 2 AND (p > 0 OR i > 0) THEN 'Freezing Rain' WHEN t > -2 AND t < 2 AND h > 80 AND dp - t < 2 AND p > 0 THEN 'Black Ice' WHEN p <= 0.1 AND v < 1000 AND h > 95 THEN 'Dense Fog' WHEN w > 15 OR g > 20 THEN 'High Winds' WHEN t > 30 THEN 'Extreme Heat' ELSE 'Normal Clear' END AS paper,
  CASE WHEN t < 0 AND (i > 1 OR p > 3) AND (w > 10 OR g > 15) AND v < 1000 THEN 'Blizzard' WHEN t < 0 AND (i > 2 OR p > 5) AND s > 0 THEN 'Heavy Snow' WHEN t < -20 THEN 'Extreme Cold' WHEN t > 2 AND (i > 4 OR p > 10) THEN 'Heavy Rain'
  WHEN t >= -2 AND t <= 2 AND h > 80 AND abs(dp - t) < 2 AND p <= 0.5 THEN 'Black Ice' WHEN t >= -2 AND t <= 2 AND (p > 0 OR i > 0) THEN 'Freezing Rain' WHEN p <= 0.1 AND v < 1000 AND h > 95 THEN 'Dense Fog' WHEN w > 15 OR g > 20 THEN 'High Winds' WHEN t > 30 THEN 'Extreme Heat' ELSE 'Normal Clear' END AS cur,
  CASE WHEN t < 0 AND (i > 1 OR p > 3) AND (w > 10 OR g > 15) AND v < 1000 THEN 'Blizzard' WHEN t < 0 AND (i > 2 OR p > 5) AND s > 0 THEN 'Heavy Snow' WHEN t < -20 THEN 'Extreme Cold' WHEN t > 2 AND (i > 4 OR p > 10) THEN 'Heavy Rain'
  WHEN t >= -2 AND t <= 2 AND (p > 0 OR i > 0) THEN 'Freezing Rain' WHEN t >= -2 AND t <= 2 AND h > 80 AND abs(dp - t) < 2 AND p > 0 THEN 'Black Ice' WHEN p <= 0.1 AND v < 1000 AND h > 95 THEN 'Dense Fog' WHEN w > 15 OR g > 20 THEN 'High Winds' WHEN t > 30 THEN 'Extreme Heat' ELSE 'Normal Clear' END AS leg FROM x)
"""


@query(
    "weather_category_onehot",
    STUDY + "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, " + ", ".join(
        f"""CAST(paper = '{c}' AS DOUBLE) AS "{encode.CATEGORIES[k]}" """ for k, c in enumerate(encode.CATEGORY_NAMES)
    ) + " FROM c"
)
def weather_category_onehot(spark, sf_dir):
    df = adapter.study_rows(spark, sf_dir)
    return tidy(
        df.select("l_orderkey", "l_linenumber", encode.weather_category().alias("c")).select(
            "l_orderkey", "l_linenumber", *encode.one_hot(F.col("c"), encode.CATEGORY_NAMES)
        )
    )


@query("weather_category_rules", STUDY + "SELECT paper AS category_paper, cur AS category_current, leg AS category_legacy, count(*) AS n FROM c GROUP BY ALL")
def weather_category_rules(spark, sf_dir):
    cats = {"paper": "paper", "current": "author-current", "legacy": "author-legacy"}
    df = adapter.study_rows(spark, sf_dir).select(*(encode.weather_category(r).alias(f"category_{k}") for k, r in cats.items()))
    return df.groupBy(*(f"category_{k}" for k in cats)).agg(F.count("*").alias("n"))


@query("cyclic_study", STUDY + """SELECT DISTINCT us, round(sin(2 * pi() * month(ts) / 12), 8) + 0.0 AS month_sin, round(cos(2 * pi() * month(ts) / 12), 8) + 0.0 AS month_cos, round(sin(2 * pi() * (hour(ts) + minute(ts) / 60.0) / 24), 8) + 0.0 AS hour_sin, round(cos(2 * pi() * (hour(ts) + minute(ts) / 60.0) / 24), 8) + 0.0 AS hour_cos,
 round(sin(2 * pi() * (dayofweek(ts) + 1) / 7), 8) + 0.0 AS day_week_sin, round(cos(2 * pi() * (dayofweek(ts) + 1) / 7), 8) + 0.0 AS day_week_cos FROM x""")
def cyclic_study(spark, sf_dir):
    return tidy(adapter.study_rows(spark, sf_dir).select("us").distinct().select("us", *encode.study_cycles(F.col("us"))))


@query(
    "wind_vector",
    "SELECT event_id, round(-value * sin(radians(event_id % 360)), 8) + 0.0 AS wind_east, round(-value * cos(radians(event_id % 360)), 8) + 0.0 AS wind_north FROM events WHERE value IS NOT NULL"
)
def wind_vector(spark, sf_dir):
    e = adapter.read(spark, sf_dir, "events").where("value is not null")
    return tidy(e.select("event_id", *encode.wind_vector(F.col("value"), F.col("event_id") % 360)))


@query(
    "cohort_filter_dedup",
    """SELECT l_orderkey, l_linenumber, l_shipdate, l_quantity, l_returnflag FROM (SELECT *, row_number() OVER (PARTITION BY l_shipdate, l_quantity, l_returnflag ORDER BY l_orderkey * 10 + l_linenumber) AS r FROM lineitem WHERE l_shipdate IS NOT NULL AND isfinite(l_quantity)) WHERE r = 1"""
)
def cohort_filter_dedup(spark, sf_dir):
    l = adapter.read(spark, sf_dir, "lineitem").withColumn("ord", F.col("l_orderkey") * 10 + F.col("l_linenumber"))  # noqa: E741
    return ingest.dedup(
        ingest.valid_rows(l, ["l_shipdate"], "l_quantity"), ["l_shipdate", "l_quantity", "l_returnflag"], "ord"
    ).select("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity", "l_returnflag")


@query(
    "duplicate_audit",
    """SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_shipdate, l_quantity ORDER BY l_orderkey * 10 + l_linenumber) AS r FROM lineitem) WHERE r > 1"""
)
def duplicate_audit(spark, sf_dir):
    l = adapter.read(spark, sf_dir, "lineitem").withColumn("ord", F.col("l_orderkey") * 10 + F.col("l_linenumber"))  # noqa: E741
    return ingest.duplicates(l, ["l_shipdate", "l_quantity"], "ord").select("l_orderkey", "l_linenumber")


@query(
    "conflicting_duplicates",
    """SELECT l_partkey, l_shipdate, count(DISTINCT l_quantity) + max(CAST(l_quantity IS NULL AS INT)) AS "values" FROM lineitem GROUP BY l_partkey, l_shipdate HAVING count(DISTINCT l_quantity) + max(CAST(l_quantity IS NULL AS INT)) > 1"""
)
def conflicting_duplicates(spark, sf_dir):
    return ingest.conflicts(adapter.read(spark, sf_dir, "lineitem"), ["l_partkey", "l_shipdate"], "l_quantity")


@query("event_order_row_id", "SELECT event_id, row_number() OVER (ORDER BY ts, user_id, event_type, event_id) - 1 AS row_id FROM events")
def event_order_row_id(spark, sf_dir):
    return ingest.row_ids(adapter.read(spark, sf_dir, "events"), ["ts", "user_id", "event_type", "event_id"]).select("event_id", "row_id")


@query("first_appearance_order", "SELECT event_id, min(event_id) OVER (PARTITION BY CAST(ts AS DATE), user_id) AS first_ord FROM events")
def first_appearance_order(spark, sf_dir):
    e = adapter.read(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return ingest.first_appearance(e, "day", "user_id", "event_id").select("event_id", "first_ord")


@query("semi_join_reduction", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_join_reduction(spark, sf_dir):
    c = adapter.read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return adapter.read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(c, "o_custkey", "left_semi")


@query("frozen_cohort_scan", "SELECT event_id, event_type, value FROM events WHERE event_id < 5000")
def frozen_cohort_scan(spark, sf_dir):
    return adapter.read(spark, sf_dir, "events").where("event_id < 5000").select("event_id", "event_type", "value")


@query("bounded_observation_scan", BASE + "b AS (SELECT max(cut) AS c FROM q WHERE qid < 3000) SELECT ord, act FROM f WHERE act < (SELECT c FROM b)")
def bounded_observation_scan(spark, sf_dir):
    q, f = home(spark, sf_dir)
    bound = q.where("qid < 3000").agg(F.max("cut")).first()[0]
    return ingest.bounded_scan(f, bound or 0).select("ord", "act")


@query("prior_run_append", BASE + """cur AS (SELECT * FROM f WHERE d >= DATE '2024-01-15' OR (d = DATE '2024-01-14' AND n < 5)), pr AS (SELECT * FROM f WHERE d < DATE '2024-01-15'),
ok AS (SELECT pr.d, pr.n FROM pr WHERE NOT EXISTS (SELECT 1 FROM cur WHERE cur.d = pr.d AND cur.n = pr.n) GROUP BY pr.d, pr.n HAVING max(pr.s) >= (SELECT min(s) FROM cur) - 43200000000)
SELECT ord FROM cur UNION ALL SELECT pr.ord FROM pr JOIN ok USING (d, n)""")
def prior_run_append(spark, sf_dir):
    f = adapter.feed(spark, sf_dir)
    now = f.where("d >= date'2024-01-15' or (d = date'2024-01-14' and n < 5)")
    return ingest.append_prior_runs(now, f.where("d < date'2024-01-15'"), "2024-01-15").select("ord")


READY = INBOUND + """
dc AS (SELECT * FROM f WHERE ty = 'DEPARTURE' AND ready IS NOT NULL),
ro1 AS (SELECT ow.qid, ow.cut, dc.*, (dc.ready - dc.s) / 6e7 AS dl, CASE WHEN dc.act < ow.cut THEN (dc.act - dc.ready) / 6e7 END AS tk, row_number() OVER (PARTITION BY ow.qid ORDER BY dc.ready DESC, dc.s, dc.ord) AS z FROM ow JOIN dc ON dc.d = ow.d AND dc.n = ow.n AND dc.ready < ow.cut AND dc.acc < ow.cut AND NOT (dc.s = ow.s AND dc.ty = ow.ty AND dc.st = ow.st))
"""


@query("readiness_own", READY + """SELECT q.qid, CASE WHEN count(r.ord) > 0 THEN count(r.ord) END AS ready_own_count, round(max(dl) FILTER (z = 1), 8) AS ready_own_last_delay_minutes, round(max(dl), 8) AS ready_own_max_delay_minutes, round(avg(dl), 8) AS ready_own_mean_delay_minutes, round((any_value(q.cut) - max(ready)) / 6e7, 8) AS ready_own_last_age_minutes,
 round(max(tk) FILTER (z = 1), 8) AS ready_own_last_to_actual_minutes, round(avg(tk), 8) AS ready_own_mean_to_actual_minutes, round(max(tk), 8) AS ready_own_max_to_actual_minutes FROM q LEFT JOIN ro1 r ON q.qid = r.qid GROUP BY q.qid""")
def readiness_own(spark, sf_dir):
    return tidy(origin.readiness_own(*home(spark, sf_dir)))


@query("readiness_summary", READY + """, rc AS (SELECT ib.qid, ib.gap, ib.od, ib.o_n, (dc.ready - dc.s) / 6e7 AS dl, CASE WHEN dc.act < ib.cut THEN (dc.act - dc.ready) / 6e7 END AS tk, (ib.cut - dc.ready) / 6e7 AS age, row_number() OVER (PARTITION BY ib.qid, ib.od, ib.o_n ORDER BY dc.ready DESC, dc.s, dc.ord) AS z FROM ib JOIN dc ON dc.d = ib.od AND dc.n = ib.o_n AND dc.ready < ib.cut AND dc.acc < ib.cut),
rw AS (SELECT rc.*, m AS "window", row_number() OVER (PARTITION BY qid, m ORDER BY gap, od, o_n) AS k FROM rc, (VALUES (180), (720)) b(m) WHERE z = 1 AND gap <= m)
SELECT qid, CAST("window" AS BIGINT) AS "window", count(*) AS "count", round(avg(dl), 8) AS mean_delay_minutes, round(max(dl), 8) AS max_delay_minutes, round(max(dl) FILTER (k = 1), 8) AS closest_delay_minutes, round(max(age) FILTER (k = 1), 8) AS closest_age_minutes, round(max(tk) FILTER (k = 1), 8) AS closest_to_actual_minutes, round(avg(tk), 8) AS mean_to_actual_minutes, round(max(tk), 8) AS max_to_actual_minutes FROM rw GROUP BY qid, "window" """)
def readiness_summary(spark, sf_dir):
    return tidy(origin.readiness_inbound(*home(spark, sf_dir)))


SERIES = BASE + """
sr0 AS (SELECT CASE event_type WHEN 'view' THEN 't2m' WHEN 'click' THEN 'ws_10min' WHEN 'signup' THEN 'wd_10min' WHEN 'purchase' THEN 'r_1h' ELSE 'snow_aws' END AS parameter, s AS t, CASE WHEN event_type = 'view' THEN value - 10 WHEN event_type = 'purchase' AND ord % 11 = 0 THEN -1 WHEN event_type = 'error' AND ord % 13 = 0 THEN -5 ELSE value END AS v FROM e),
sr AS (SELECT parameter, t, CASE WHEN parameter = 'r_1h' AND v = -1 THEN 0.0 ELSE v END AS value FROM sr0 WHERE NOT (parameter IN ('snow_aws', 'ws_10min') AND v < 0) AND NOT (parameter = 'r_1h' AND v < 0 AND v <> -1)),
ps AS (SELECT q.qid, q.cut - 3600000000 AS dl, p AS parameter FROM q, (VALUES ('t2m'), ('ws_10min'), ('wd_10min'), ('r_1h'), ('snow_aws')) v(p))
"""
PARAMETERS = ["t2m", "ws_10min", "wd_10min", "r_1h", "snow_aws"]


@query("asof_weather", SERIES + """, j AS (SELECT ps.*, sr.t, sr.value FROM ps ASOF LEFT JOIN sr ON ps.parameter = sr.parameter AND ps.dl > sr.t)
SELECT qid, parameter, CASE WHEN dl - t <= 7200000000 THEN round(value, 8) END AS value, CASE WHEN dl - t <= 7200000000 THEN round((dl - t) / 6e7 + 90, 8) END AS age_minutes FROM j""")
def asof_weather(spark, sf_dir):
    q, _ = home(spark, sf_dir)
    return tidy(weather.latest(q, weather.clean(adapter.series(spark, sf_dir)), PARAMETERS).select("qid", "parameter", "value", "age_minutes"))


@query("rolling_weather", SERIES + """, g AS (SELECT ps.*, m AS hours FROM ps, (VALUES (6), (24)) b(m)), j AS (SELECT g.*, sr.t, sr.value FROM g LEFT JOIN sr ON g.parameter = sr.parameter AND sr.t < g.dl AND sr.t >= g.dl - CAST(g.hours AS BIGINT) * 3600000000),
a AS (SELECT qid, parameter, hours, count(t) AS n, avg(value) AS mean, min(value) AS mn, max(value) AS mx, sum(value) AS sm, arg_max(value, t) - arg_min(value, t) AS change, count(t) >= ceil(hours * 0.75) AND max(t) >= any_value(dl) - 7200000000 AS ok FROM j GROUP BY qid, parameter, hours)
SELECT qid, parameter, CAST(hours AS BIGINT) AS hours, n, CASE WHEN ok THEN round(mean, 8) END AS mean, CASE WHEN ok THEN round(mn, 8) END AS "min", CASE WHEN ok THEN round(mx, 8) END AS "max", CASE WHEN ok THEN round(sm, 8) END AS "sum", CASE WHEN ok THEN round(change, 8) + 0.0 END AS change FROM a""")
def rolling_weather(spark, sf_dir):
    q, _ = home(spark, sf_dir)
    return tidy(weather.rolling(q, weather.clean(adapter.series(spark, sf_dir)), PARAMETERS).drop("used"), 8)


@query(
    "month_coverage",
    "SELECT strftime(ts, '%Y-%m') AS month, CASE event_type WHEN 'view' THEN 't2m' WHEN 'click' THEN 'ws_10min' WHEN 'signup' THEN 'wd_10min' WHEN 'purchase' THEN 'r_1h' ELSE 'snow_aws' END AS parameter, count(*) AS rows, count(value) AS known FROM events GROUP BY 1, 2"
)
def month_coverage(spark, sf_dir):
    return weather.coverage(adapter.series(spark, sf_dir))


@query("month_impute", """WITH x AS (SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m') AS month, CASE WHEN (l_orderkey + l_linenumber) % (CASE WHEN month(l_shipdate) % 2 = 0 THEN 2 ELSE 5 END) <> 0 THEN l_quantity END AS v FROM lineitem), g AS (SELECT month, median(v) AS m, avg(CAST(v IS NULL AS DOUBLE)) AS gap FROM x GROUP BY month)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, month, CASE WHEN gap <= 0.3 THEN coalesce(v, m) END AS v FROM x JOIN g USING (month)""")
def month_impute(spark, sf_dir):
    l = adapter.read(spark, sf_dir, "lineitem")  # noqa: E741
    v = F.when((F.col("l_orderkey") + F.col("l_linenumber")) % F.when(F.month("l_shipdate") % 2 == 0, 2).otherwise(5) != 0, F.col("l_quantity"))
    return tidy(evaluate.impute(l.select("l_orderkey", "l_linenumber", F.date_format("l_shipdate", "yyyy-MM").alias("month"), v.alias("v")), "month", ["v"]))


@query("robust_scale", """WITH q AS (SELECT quantile_cont(l_quantity, 0.25) AS a, median(l_quantity) AS b, quantile_cont(l_quantity, 0.75) AS c, quantile_cont(l_tax, 0.25) AS ta, median(l_tax) AS tb, quantile_cont(l_tax, 0.75) AS tc FROM lineitem WHERE l_orderkey % 5 <> 0)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round((l_quantity - b) / (c - a), 8) + 0.0 AS l_quantity, round((l_tax - tb) / (tc - ta), 8) + 0.0 AS l_tax FROM lineitem, q""")
def robust_scale(spark, sf_dir):
    l = adapter.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")  # noqa: E741
    return tidy(evaluate.robust_scale(l, l.where("l_orderkey % 5 <> 0"), ["l_quantity", "l_tax"]))


PRED = """WITH o AS (SELECT *, epoch_us(o_orderdate) AS t, o_totalprice % 97 - 40 AS y FROM orders),
p AS (SELECT o_orderkey, o_orderdate, o_orderstatus AS status, o_orderpriority AS priority, t, y, y * 0.8 + o_custkey % 7 - 3 AS p, y * 0.6 + o_custkey % 11 - 4 AS b, o_custkey, row_number() OVER (ORDER BY t, o_orderkey) - 1 AS row_id, count(*) OVER () AS n FROM o),
ed AS (SELECT i, n - (5 - i) * (n // 6) AS e FROM (SELECT any_value(n) AS n FROM p), range(5) r(i)),
mv AS (SELECT ed.i, (SELECT min(row_id) FROM p WHERE t = (SELECT t FROM p x WHERE x.row_id = ed.e)) AS f FROM ed),
fo AS (SELECT p.*, (SELECT count(*) FROM mv WHERE mv.f <= p.row_id) - 1 AS fold FROM p)
"""


def folded(spark, sf_dir):
    df = ingest.row_ids(adapter.predictions(spark, sf_dir), ["t", "o_orderkey"])
    return evaluate.expanding(df, df.count(), 5)


@query("ts_split_folds", PRED + "SELECT o_orderkey, row_id, fold FROM fo")
def ts_split_folds(spark, sf_dir):
    return tidy(folded(spark, sf_dir).select("o_orderkey", "row_id", "fold"))


@query(
    "fold_purge",
    PRED + """, l AS (SELECT *, t + 86400000000 * (o_orderkey % 90) AS act, t - 1800000000 AS cut FROM fo), g AS (SELECT fold, min(row_id) AS b, min(cut) AS c FROM l WHERE fold >= 0 GROUP BY fold) SELECT g.fold, count(*) AS rows, CAST(sum(l.row_id) AS BIGINT) AS row_sum FROM l JOIN g ON l.row_id < g.b AND l.act < g.c GROUP BY g.fold"""
)
def fold_purge(spark, sf_dir):
    df = folded(spark, sf_dir).withColumn("act", F.col("t") + F.lit(DAY) * (F.col("o_orderkey") % 90)).withColumn("cut", F.col("t") - F.lit(30 * MINUTE))
    return tidy(evaluate.purged(df, df).groupBy("fold").agg(F.count("*").alias("rows"), F.sum("row_id").alias("row_sum")))


@query(
    "split_description",
    PRED + """, s AS (SELECT *, CASE WHEN row_id < CAST(floor(0.8 * n) AS BIGINT) THEN 'development' ELSE 'test' END AS part FROM p) SELECT part, count(*) AS rows, min(t) AS first_time, max(t) AS last_time, round(avg(y), 6) AS target_mean, round(stddev_pop(y), 6) AS target_std, round(avg(abs(y)), 6) AS mean_absolute_target FROM s GROUP BY part"""
)
def split_description(spark, sf_dir):
    df = ingest.row_ids(adapter.predictions(spark, sf_dir), ["t", "o_orderkey"])
    return tidy(evaluate.describe(evaluate.chronological(df, df.count()), ["part"], "t", "y"), 6)


@query(
    "shared_runs",
    PRED + """, s AS (SELECT *, row_id < CAST(floor(0.8 * n) AS BIGINT) AS dev FROM p) SELECT count(*) AS shared_runs FROM (SELECT o_custkey FROM s WHERE dev INTERSECT SELECT o_custkey FROM s WHERE NOT dev)"""
)
def shared_runs(spark, sf_dir):
    df = ingest.row_ids(adapter.predictions(spark, sf_dir), ["t", "o_orderkey"])
    s = evaluate.chronological(df, df.count())
    return evaluate.shared_runs(s.where("part = 'development'"), s.where("part = 'test'"), ["o_custkey"])


METRICS = """count(*) AS n, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, round(avg(abs(y - p)), 6) AS mae, round(100 * sum(abs(y - p)) / nullif(sum(abs(y)), 0), 6) AS wmape, round(100 * sum(abs(y - p)) / nullif(sum(y), 0), 4) AS wmape_signed FROM p"""


def metric_cols(df):
    return tidy(df.withColumn("wmape_signed", F.round("wmape_signed", 4)), 6)


@query("metrics_overall", PRED + "SELECT " + METRICS)
def metrics_overall(spark, sf_dir):
    return metric_cols(evaluate.metrics(adapter.predictions(spark, sf_dir)))


@query("metrics_by_group", PRED + "SELECT status, priority, " + METRICS + " GROUP BY status, priority")
def metrics_by_group(spark, sf_dir):
    return metric_cols(evaluate.metrics(adapter.predictions(spark, sf_dir), ["status", "priority"]))


@query("metrics_by_month", PRED + "SELECT strftime(o_orderdate, '%Y-%m') AS month, " + METRICS + " GROUP BY 1")
def metrics_by_month(spark, sf_dir):
    df = adapter.predictions(spark, sf_dir).withColumn("month", F.date_format(F.date_from_unix_date(F.floor(F.col("t") / F.lit(DAY)).cast("int")), "yyyy-MM"))
    return metric_cols(evaluate.metrics(df, ["month"]))


@query(
    "mean_fold_rmse",
    PRED + ", g AS (SELECT fold, sum((y - p) * (y - p)) AS s, count(*) AS c FROM fo WHERE fold >= 0 GROUP BY fold) SELECT round(avg(sqrt(s / c)), 6) AS mean_fold_rmse, round(sqrt(sum(s) / sum(c)), 6) AS pooled_rmse FROM g"
)
def mean_fold_rmse(spark, sf_dir):
    return tidy(evaluate.mean_fold_rmse(folded(spark, sf_dir).where("fold >= 0")), 6)


@query(
    "best_candidate_prefix",
    "WITH s AS (SELECT p_partkey AS candidate, p_retailprice % 13 AS score FROM part WHERE p_partkey <= 100), r AS (SELECT row_number() OVER (ORDER BY candidate) AS budget, min(score) OVER (ORDER BY candidate ROWS UNBOUNDED PRECEDING) AS best FROM s) SELECT budget, round(best, 8) AS best FROM r WHERE budget IN (10, 20, 50, 100)"
)
def best_candidate_prefix(spark, sf_dir):
    s = adapter.read(spark, sf_dir, "part").where("p_partkey <= 100").select(
        F.col("p_partkey").alias("candidate"), (F.col("p_retailprice") % 13).alias("score")
    )
    return tidy(evaluate.best_prefix(s))


@query("largest_errors", PRED + "SELECT o_orderkey, round(abs(y - p), 8) AS abs_error FROM p ORDER BY abs(y - p) DESC, o_orderkey LIMIT 20")
def largest_errors(spark, sf_dir):
    return tidy(evaluate.largest_errors(adapter.predictions(spark, sf_dir), 20, tie="o_orderkey").select("o_orderkey", "abs_error"))


@query("daily_block_bootstrap", PRED + """, d AS (SELECT o_orderkey % 40 AS day, count(*) AS n, sum(abs(p - y)) AS p1, sum(abs(b - y)) AS b1, sum((p - y) * (p - y)) AS p2, sum((b - y) * (b - y)) AS b2 FROM p GROUP BY 1),
w AS (SELECT r.i AS rep, d.day, (r.i * 7 + d.day * 13 + (r.i * d.day) % 5) % 4 AS w FROM range(200) r(i), range(40) d(day)), j AS (SELECT rep, sum(n * w) AS n, sum(p1 * w) AS p1, sum(b1 * w) AS b1, sum(p2 * w) AS p2, sum(b2 * w) AS b2 FROM d JOIN w USING (day) GROUP BY rep),
x AS (SELECT p1 / n - b1 / n AS mae, sqrt(p2 / n) - sqrt(b2 / n) AS rmse FROM j), z AS (SELECT sum(p1) / sum(n) - sum(b1) / sum(n) AS mae, sqrt(sum(p2) / sum(n)) - sqrt(sum(b2) / sum(n)) AS rmse FROM d)
SELECT 'mae' AS metric, round((SELECT mae FROM z), 6) AS difference, round(quantile_cont(mae, 0.025), 6) AS low, round(quantile_cont(mae, 0.975), 6) AS high, count(*) AS reps FROM x UNION ALL SELECT 'rmse', round((SELECT rmse FROM z), 6), round(quantile_cont(rmse, 0.025), 6), round(quantile_cont(rmse, 0.975), 6), count(*) FROM x""")
def daily_block_bootstrap(spark, sf_dir):
    """Day blocks are 40 groups; the weights table (replicate, day, weight) is an input, here by a rule."""
    df = adapter.predictions(spark, sf_dir).withColumn("day", F.col("o_orderkey") % 40)
    w = spark.range(8000).select((F.col("id") % 200).alias("rep"), F.floor(F.col("id") / 200).alias("day"))
    w = w.withColumn("w", (F.col("rep") * 7 + F.col("day") * 13 + (F.col("rep") * F.col("day")) % 5) % 4)
    return tidy(evaluate.paired_bootstrap(df, w, a="p", b="b"), 6)


CONTROLS = PRED + """, c AS (SELECT *, o_orderkey % 3 AS history_count, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey % 2 AS DOUBLE) END AS is_departure, CAST(o_custkey % 400 AS DOUBLE) AS oldest_pending_minutes, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_custkey % 9 - 4 AS DOUBLE) END AS previous_delay,
 CASE WHEN o_orderkey % 6 <> 0 THEN CAST(o_custkey % 120 AS DOUBLE) END AS context_arrival_180m_max_delay, o_orderkey % 5 AS origin_actual_presence_count, CASE WHEN o_orderkey % 9 <> 0 THEN CAST(o_custkey % 200 AS DOUBLE) END AS origin_720m_max_last_delay FROM fo)"""


def controls(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return folded(spark, sf_dir).select(
        "*", (k % 3).alias("history_count"), F.when(k % 7 != 0, (k % 2).cast("double")).alias("is_departure"),
        (c % 400).cast("double").alias("oldest_pending_minutes"), F.when(k % 4 != 0, (c % 9 - 4).cast("double")).alias("previous_delay"),
        F.when(k % 6 != 0, (c % 120).cast("double")).alias("context_arrival_180m_max_delay"), (k % 5).alias("origin_actual_presence_count"),
        F.when(k % 9 != 0, (c % 200).cast("double")).alias("origin_720m_max_last_delay"),
    )


@query(
    "residual_baseline",
    CONTROLS + "SELECT o_orderkey, CASE WHEN history_count > 0 AND oldest_pending_minutes > 120 THEN greatest(coalesce(previous_delay, 0), oldest_pending_minutes * 0.5) ELSE coalesce(previous_delay, 0) END AS baseline FROM c"
)
def residual_baseline(spark, sf_dir):
    return tidy(controls(spark, sf_dir).select("o_orderkey", policy.baseline(0.5, 120.0).alias("baseline")))


@query("rule_grid_scores", CONTROLS + """, r AS (SELECT * FROM (VALUES (10.0), (20.0), (30.0)) a(cap), (VALUES (120.0), (180.0), (240.0), (300.0)) b(threshold), (VALUES (1.0), (1.25), (1.5), (1.75), (2.0)) m(multiplier)),
j AS (SELECT fold, cap, threshold, multiplier, y - CASE WHEN history_count > 0 THEN CASE WHEN oldest_pending_minutes > threshold THEN greatest(p, multiplier * oldest_pending_minutes) ELSE p END WHEN is_departure = 1 THEN least(p, cap) ELSE p END AS e FROM c, r WHERE fold >= 0),
g AS (SELECT fold, cap, threshold, multiplier, sqrt(avg(e * e)) AS m FROM j GROUP BY ALL) SELECT CAST(cap AS DOUBLE) AS cap, CAST(threshold AS DOUBLE) AS threshold, CAST(multiplier AS DOUBLE) AS multiplier, round(avg(m), 6) AS mean_rmse FROM g GROUP BY ALL""")
def rule_grid_scores(spark, sf_dir):
    return tidy(policy.grid_scores(controls(spark, sf_dir).where("fold >= 0"), policy.rule_grid()), 6)


@query("blend_policy", CONTROLS + """, a AS (SELECT *, coalesce(is_departure = 1, false) AS dep, coalesce(previous_delay <= 0, false) AS early FROM c), b1 AS (SELECT *, CASE WHEN dep THEN 0.25 * p + 0.75 * b ELSE 0.6 * p + 0.4 * b END AS raw FROM a),
b2 AS (SELECT *, CASE WHEN early THEN (raw + 1.5) * 0.9 ELSE raw + 1.5 END AS t1 FROM b1), b3 AS (SELECT *, CASE WHEN coalesce(context_arrival_180m_max_delay <= 60, false) THEN 0.7 * t1 + 0.3 * b ELSE t1 END AS t2 FROM b2), b4 AS (SELECT *, CASE WHEN early AND t2 > 20 THEN t2 * 1.2 ELSE t2 END AS transformed FROM b3)
SELECT o_orderkey, round(raw, 8) + 0.0 AS raw, round(transformed, 8) + 0.0 AS transformed, round(CASE WHEN NOT history_count > 0 AND dep AND origin_actual_presence_count > 0 AND coalesce(origin_720m_max_last_delay > 120, false) THEN transformed WHEN history_count > 0 AND oldest_pending_minutes > 240 THEN greatest(transformed, 1.5 * oldest_pending_minutes) WHEN NOT history_count > 0 AND dep THEN least(transformed, 10) ELSE transformed END, 8) + 0.0 AS final FROM b4""")
def blend_policy(spark, sf_dir):
    rules = policy.Policy({"p": 0.6, "b": 0.4}, {"p": 0.25, "b": 0.75}, "b", 0.3, 1.5, 0.9, tail=20.0, tail_scale=1.2, rule=policy.Rule(10.0, 240.0, 1.5))
    return tidy(rules.apply(controls(spark, sf_dir)).select("o_orderkey", "raw", "transformed", "final"))


@query(
    "provenance_violations",
    BASE + "x AS (SELECT q.cut, f.act, f.acc, f.ord % 3 AS c FROM q JOIN f ON q.qid = f.ord) SELECT 'act' AS stamp, count(*) FILTER (act >= cut) AS late, count(*) FILTER (act IS NULL AND c > 0) AS missing FROM x UNION ALL SELECT 'acc', count(*) FILTER (acc >= cut - 3600000000), 0 FROM x"
)
def provenance_violations(spark, sf_dir):
    q, f = home(spark, sf_dir)
    rows = q.join(f.select(F.col("ord").alias("qid"), "act", "acc"), "qid").withColumn("c", F.col("qid") % 3)
    return policy.provenance_violations(rows, "cut", {"act": 0, "acc": 60}, {"act": ["c"]})


@query(
    "profile_conflicts",
    "WITH a AS (SELECT o_orderkey AS k, o_custkey AS u, o_totalprice AS v FROM orders WHERE o_orderkey % 10 <> 1), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END AS u, o_totalprice + o_orderkey % 2 AS v FROM orders WHERE o_orderkey % 10 <> 2), j AS (SELECT a.k AS ak, b.k AS bk, a.u AS au, b.u AS bu, a.v AS av, b.v AS bv FROM a FULL JOIN b ON a.k = b.k) SELECT 'u' AS name, count(*) FILTER (ak IS NOT NULL AND bk IS NOT NULL AND au IS DISTINCT FROM bu) AS differing FROM j UNION ALL SELECT 'v', count(*) FILTER (ak IS NOT NULL AND bk IS NOT NULL AND av IS DISTINCT FROM bv) FROM j UNION ALL SELECT 'k', count(*) FILTER (ak IS NULL OR bk IS NULL) FROM j"
)
def profile_conflicts(spark, sf_dir):
    o = adapter.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("u"), F.col("o_totalprice").alias("v"))
    b = o.where("k % 10 <> 2").select("k", F.when(F.col("k") % 5 != 0, F.col("u")).alias("u"), (F.col("v") + F.col("k") % 2).alias("v"))
    return policy.mismatches(o.where("k % 10 <> 1"), b, "k", ["u", "v"])


@query(
    "input_ages",
    BASE + "x AS (SELECT q.s, f.act, f.acc FROM q JOIN f ON q.qid = f.ord) SELECT round(min((s - act) / 6e7), 8) AS act_least_age, round(min((s - acc) / 6e7), 8) AS acc_least_age, count(*) FILTER (act IS NULL) AS act_missing, count(*) FILTER (acc IS NULL) AS acc_missing FROM x"
)
def input_ages(spark, sf_dir):
    q, f = home(spark, sf_dir)
    return tidy(evaluate.input_ages(q.join(f.select(F.col("ord").alias("qid"), "act", "acc"), "qid"), "s", ["act", "acc"]))


@query(
    "presence_counts",
    BASE + "x AS (SELECT ord, CAST(ord % 4 AS DOUBLE) + CAST(act IS NOT NULL AS INT) + CAST(delay IS NOT NULL AS INT) AS presence FROM f) SELECT * FROM x"
)
def presence_counts(spark, sf_dir):
    _, f = home(spark, sf_dir)
    return tidy(policy.presence_counts(f.withColumn("c", F.col("ord") % 4), ["c"], ["act", "delay"], "presence").select("ord", "presence"))


@query(
    "audit_summary",
    "SELECT 'value' AS name, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.25), 6) AS q25, round(median(value), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75, min(value) AS least, max(value) AS most FROM events"
)
def audit_summary(spark, sf_dir):
    return tidy(evaluate.audit_summary(adapter.read(spark, sf_dir, "events"), ["value"]), 6)
