"""Queries of provenance, wide contracts, guards, order and streams over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import storage
from ..functions.clock import MINUTE
from ..operators import feed as fd
from ..operators import ingest, provenance, route, weather, wide
from ..streaming import pending as streams
from ..streaming import history_log, timed
from . import adapter, evaluate, policy
from .queries import BASE, CONTEXT, INBOUND, ROUTE, SQL, TERMINAL, home, query, tidy
from .study_queries import PARAMETERS, PRED, SERIES, controls

STAMPS = "SELECT q.qid, max(u.act) AS latest_act, max(u.acc) AS latest_acc, count(u.act) AS used_act, count(u.acc) AS used_acc FROM q LEFT JOIN u ON q.qid = u.qid GROUP BY q.qid"
HOURS3 = "10800000000"


@query("network_provenance", BASE + ROUTE + f""",
nb AS (SELECT c.qid, c.context, c.cut, f.*, coalesce(f.act < c.cut, false) AS old FROM ctx c JOIN f ON f.st = c.station AND NOT (f.d = c.d AND f.n = c.n) AND f.acc < c.cut AND ((f.act < c.cut AND f.act >= c.cut - {HOURS3}) OR (f.s < c.cut AND f.s >= c.cut - {HOURS3}))),
u AS (SELECT qid, CASE WHEN done THEN act END AS act, acc FROM rt
 UNION ALL SELECT qid, act, acc FROM nb WHERE old AND act >= cut - {HOURS3} AND delay IS NOT NULL
 UNION ALL SELECT qid, act, acc FROM nb WHERE old AND s < cut AND s >= cut - {HOURS3}
 UNION ALL SELECT qid, NULL, acc FROM nb WHERE NOT old
 UNION ALL SELECT nb.qid, max(c.act), max(c.acc) FROM nb JOIN f c ON c.d = nb.d AND c.n = nb.n AND c.act < nb.cut AND c.acc < nb.cut AND c.s >= nb.s WHERE NOT nb.old GROUP BY nb.qid, nb.context, nb.ord)
""" + STAMPS)
def network_provenance(spark, sf_dir):
    return provenance.network(*home(spark, sf_dir))


@query("turnaround_provenance", TERMINAL + CONTEXT.strip() + f""",
own AS (SELECT q.qid, q.ty = 'DEPARTURE' AND ro.origin = 370 AS first, ro.accepted FROM q JOIN ro ON ro.d = q.d AND ro.n = q.n AND ro.valid AND ro.accepted < q.cut),
tm AS (SELECT te.*, ro.accepted FROM te JOIN ro ON ro.d = te.d AND ro.n = te.n),
u AS (SELECT qid, CAST(NULL AS BIGINT) AS act, accepted AS acc FROM own
 UNION ALL SELECT qid, act, acc FROM nb WHERE old AND act >= cut - {HOURS3}
 UNION ALL SELECT qid, NULL, accepted FROM tm
 UNION ALL SELECT qid, act, NULL FROM tm WHERE old AND act >= cut - {HOURS3} AND delay IS NOT NULL
 UNION ALL SELECT tm.qid, c.act, c.acc FROM tm JOIN own ON own.qid = tm.qid AND own.first JOIN f c ON c.d = tm.d AND c.n = tm.n AND c.act < tm.cut AND c.acc < tm.cut AND c.s <= tm.s AND c.delay IS NOT NULL WHERE tm.s >= tm.fs - {HOURS3} AND tm.s <= tm.fs - 1200000000
 UNION ALL SELECT qid, NULL, acc FROM w WHERE due
 UNION ALL SELECT qid, by_act, by_acc FROM w WHERE due AND by_act IS NOT NULL
 UNION ALL SELECT tm.qid, max(c.act), max(c.acc) FROM tm JOIN f c ON c.d = tm.d AND c.n = tm.n AND c.act < tm.cut AND c.acc < tm.cut AND c.s >= tm.s WHERE tm.s < tm.cut AND NOT tm.old GROUP BY tm.qid, tm.ord)
""" + STAMPS)
def turnaround_provenance(spark, sf_dir):
    return provenance.turnaround(*home(spark, sf_dir))


@query("origin_provenance", INBOUND + """
u AS (SELECT ow.qid, CAST(NULL AS BIGINT) AS act, ro.accepted AS acc FROM ow JOIN ro ON ro.d = ow.d AND ro.n = ow.n
 UNION ALL SELECT ib.qid, NULL, ro.accepted FROM ib JOIN ro ON ro.d = ib.od AND ro.n = ib.o_n
 UNION ALL SELECT ib.qid, c.act, NULL FROM ib JOIN f c ON c.d = ib.od AND c.n = ib.o_n AND c.act < ib.cut)
""" + STAMPS)
def origin_provenance(spark, sf_dir):
    return provenance.origin(*home(spark, sf_dir))


@query("readiness_provenance", INBOUND + """
dr AS (SELECT * FROM f WHERE ty = 'DEPARTURE' AND ready IS NOT NULL),
x AS (SELECT ow.qid, ow.cut, r.d, r.n, r.act, r.ready FROM ow JOIN dr r ON r.d = ow.d AND r.n = ow.n AND r.ready < ow.cut AND r.acc < ow.cut AND NOT (r.s = ow.s AND r.ty = ow.ty AND r.st = ow.st)
 UNION ALL SELECT ib.qid, ib.cut, r.d, r.n, r.act, r.ready FROM ib JOIN dr r ON r.d = ib.od AND r.n = ib.o_n AND r.ready < ib.cut AND r.acc < ib.cut),
u AS (SELECT qid, ready, CASE WHEN act < cut THEN act END AS act, NULL AS acc FROM x UNION ALL SELECT DISTINCT x.qid, NULL, NULL, ro.accepted FROM x JOIN ro ON ro.d = x.d AND ro.n = x.n),
y AS (SELECT qid, max(ready) AS a, max(act) AS b, count(ready) AS na, count(act) AS nb FROM u GROUP BY qid), z AS (SELECT x.qid, max(ro.accepted) AS c, count(DISTINCT (x.d, x.n)) AS nc FROM x JOIN ro ON ro.d = x.d AND ro.n = x.n GROUP BY x.qid)
SELECT q.qid, y.a AS latest_ready, y.b AS latest_act, z.c AS latest_acc, coalesce(y.na, 0) AS used_ready, coalesce(y.nb, 0) AS used_act, coalesce(z.nc, 0) AS used_acc FROM q LEFT JOIN y ON q.qid = y.qid LEFT JOIN z ON q.qid = z.qid""")
def readiness_provenance(spark, sf_dir):
    return provenance.readiness(*home(spark, sf_dir))


@query("weather_provenance", SERIES + """, lt AS (SELECT ps.qid, ps.parameter, max(sr.t) AS t FROM ps JOIN sr ON sr.parameter = ps.parameter AND sr.t < ps.dl AND sr.t >= ps.dl - 7200000000 GROUP BY ALL),
ro AS (""" + "SELECT qid, parameter, CAST(hours AS BIGINT) AS hours, n, (CASE WHEN ok THEN 5 ELSE 0 END) + CAST(n > 0 AS INT) AS k, t FROM (SELECT g.qid, g.parameter, g.hours, count(sr.t) AS n, max(sr.t) AS t, count(sr.t) >= ceil(g.hours * 0.75) AND max(sr.t) >= any_value(g.dl) - 7200000000 AS ok FROM (SELECT ps.*, m AS hours FROM ps, (VALUES (6), (24)) b(m)) g LEFT JOIN sr ON g.parameter = sr.parameter AND sr.t < g.dl AND sr.t >= g.dl - CAST(g.hours AS BIGINT) * 3600000000 GROUP BY g.qid, g.parameter, g.hours)" + """),
u AS (SELECT qid, t, 1 AS k FROM lt UNION ALL SELECT qid, t, k FROM ro)
SELECT qid, max(t) AS latest_t, CAST(sum(coalesce(k, 0)) AS BIGINT) AS used FROM (SELECT qid, NULL AS t, 0 AS k FROM q UNION ALL SELECT * FROM u) GROUP BY qid""")
def weather_provenance(spark, sf_dir):
    q, _ = home(spark, sf_dir)
    series = weather.clean(adapter.series(spark, sf_dir))
    return provenance.weather(weather.latest(q, series, PARAMETERS), weather.rolling(q, series, PARAMETERS))


def pivoted(
    source: str, keys: list[str], names: dict[str, tuple[str, str]],
    base: str = "SELECT event_id AS qid FROM events WHERE event_type = 'purchase'"
) -> str:
    cells = ", ".join(f'max({column}) FILTER ({condition}) AS "{name}"' for name, (condition, column) in names.items())
    return f"SELECT b.qid, {cells} FROM ({base}) b LEFT JOIN ({source}) x ON b.qid = x.qid GROUP BY b.qid"


NETWORK = {
    f"network_{k}_{w}m_{x}": (f"context = '{k}'", f'"{w}m_{x}"')
    for k in ("previous_station", "next_station", "route_ahead")
    for w in (60, 180)
    for x in ("count", "mean_delay", "max_delay", "last_delay", "pending_count", "oldest_pending_minutes")
}


@query("network_wide", pivoted(SQL["network_station_windows"], ["context"], NETWORK))
def network_wide(spark, sf_dir):
    q, f = home(spark, sf_dir)
    return tidy(route.network_wide(q, route.network(q, f)))


STATION = {
    f"home_context_{k.lower()}_{w}m_{x}": (
        f"kind = '{k}' AND \"window\" = {w}", x
    ) for k in ("ARRIVAL", "DEPARTURE") for w in (60, 180) for x in wide.STATION
}


@query(
    "turnaround_wide",
    f"SELECT a.*, c.origin_departure AS home_origin_departure, {', '.join(f'b.terminating_{x} AS home_terminating_{x}' for x in wide.TERMINATING)}, {', '.join(f'c.{x} AS turnaround_{x}' for x in wide.CANDIDATE)} FROM ({pivoted(SQL['turnaround_context'], ['kind', 'window'], STATION)}) a JOIN ({SQL['turnaround_terminating']}) b ON a.qid = b.qid JOIN ({SQL['turnaround_candidate']}) c ON a.qid = c.qid"
)
def turnaround_wide(spark, sf_dir):
    return tidy(wide.turnaround(*home(spark, sf_dir)))


ORIGIN = {f"origin_context_{w}m_{x}": (f'"window" = {w}', f'"{x}"') for w in (180, 720) for x in wide.ORIGIN}
REVERSE = {f"origin_reverse_{w}m_{x}": (f'"window" = {w}', column) for w in (180, 720) for x, column in wide.REVERSE.items()}


@query(
    "origin_wide",
    f"SELECT a.*, c.* EXCLUDE (qid), CASE WHEN a.origin_context_elapsed_minutes IS NOT NULL THEN 1.0 END AS origin_context_route_known FROM ({pivoted(SQL['origin_context'], ['window'], {'origin_context_elapsed_minutes': ('true', 'elapsed_minutes')} | ORIGIN)}) a JOIN ({pivoted(SQL['origin_reverse'], ['window'], REVERSE)}) c ON a.qid = c.qid"
)
def origin_wide(spark, sf_dir):
    return tidy(wide.origin(*home(spark, sf_dir)))


READINESS = {f"ready_origin_{w}m_{x}": (f'"window" = {w}', f'"{x}"') for w in (180, 720) for x in wide.READY_ORIGIN}


@query(
    "readiness_wide",
    f"SELECT a.*, b.* EXCLUDE (qid) FROM ({SQL['readiness_own']}) a JOIN ({pivoted(SQL['readiness_summary'], ['window'], READINESS)}) b ON a.qid = b.qid"
)
def readiness_wide(spark, sf_dir):
    return tidy(wide.readiness(*home(spark, sf_dir)))


@query(
    "deployment_guard",
    BASE + "x AS (SELECT s, cut + (qid % 3) * 600000000 AS cut FROM q) SELECT count(*) FILTER (s - cut < 1800000000) AS young, count(*) FILTER (s < 1704153600000000) AS early FROM x"
)
def deployment_guard(spark, sf_dir):
    q, _ = home(spark, sf_dir)
    return policy.deployable(q.withColumn("cut", F.col("cut") + F.col("qid") % 3 * F.lit(10 * MINUTE)), "s", "cut", 1704153600_000000)


@query("query_invariants", BASE + """x AS (SELECT q.qid // 2 AS row_id, q.s AS prediction, q.s, q.cut + (q.qid % 5 // 4) * 60000000 AS cut, q.cut AS prediction_cut, f.act AS source_act, q.qid % 3 AS history_count, f.acc < q.cut AS known, f.stopping, q.n AS query_n, CASE WHEN q.qid % 11 = 0 THEN 0 ELSE q.n END AS source_n FROM q JOIN f ON q.qid = f.ord)
SELECT 'row_id_known' AS invariant, count(*) FILTER (row_id IS NULL) AS rows FROM x UNION ALL SELECT 'row_id_in_range', count(*) FILTER (row_id < 0 OR row_id >= 4000) FROM x UNION ALL SELECT 'snapshot_age', count(*) FILTER (prediction - cut < 1800000000) FROM x UNION ALL SELECT 'prediction_is_schedule', count(*) FILTER (prediction <> s) FROM x
UNION ALL SELECT 'cuts_agree', count(*) FILTER (prediction_cut <> cut) FROM x UNION ALL SELECT 'before_cut:source_act', count(*) FILTER (source_act >= cut) FROM x UNION ALL SELECT 'history_has:source_act', count(*) FILTER (history_count > 0 AND source_act IS NULL) FROM x UNION ALL SELECT 'masked_plan', count(*) FILTER (NOT coalesce(known, false) AND stopping IS NOT NULL) FROM x
UNION ALL SELECT 'same_run:source_n', count(*) FILTER (history_count > 0 AND source_n IS DISTINCT FROM query_n) FROM x UNION ALL SELECT 'row_id_unique', count(*) FROM (SELECT row_id FROM x GROUP BY row_id HAVING count(*) > 1)""")
def query_invariants(spark, sf_dir):
    q, f = home(spark, sf_dir)
    k = F.col("qid")
    rows = q.join(f.select(F.col("ord").alias("qid"), F.col("act").alias("source_act"), "acc", "stopping"), "qid").select(
        F.floor(k / 2).alias("row_id"), F.col("s").alias("prediction"), "s",
        (F.col("cut") + F.floor(k % 5 / 4) * F.lit(MINUTE)).alias("cut"), F.col("cut").alias("prediction_cut"), "source_act",
        (k % 3).alias("history_count"), (F.col("acc") < F.col("cut")).alias("known"), "stopping", F.col("n").alias("query_n"),
        F.when(k % 11 == 0, 0).otherwise(F.col("n")).alias("source_n")
    )
    rules = policy.Invariants(rows=4000, clocks=("source_act",), sources=("source_act",), masked=("stopping",), same_run=(("source_n", "query_n"),))
    return rules.violations(rows)


@query(
    "chronological_order",
    "WITH x AS (SELECT o_orderkey, epoch_us(o_orderdate) AS t, max(epoch_us(o_orderdate)) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM orders) SELECT count(*) FILTER (t < m) AS rows FROM x"
)
def chronological_order(spark, sf_dir):
    return policy.unordered(adapter.predictions(spark, sf_dir), "o_orderkey", "t")


@query(
    "policy_replay",
    SQL["blend_policy"].replace(
        "SELECT o_orderkey, round(raw", ", res AS (SELECT o_orderkey, round(raw", 1
    ) + ") SELECT o_orderkey, final + 1 AS saved, final FROM res WHERE o_orderkey % 50 = 1"
)
def policy_replay(spark, sf_dir):
    rules = policy.policy_of(
        {
            "arrival": {"p": 0.6, "b": 0.4}, "departure": {"p": 0.25, "b": 0.75}, "auxiliary": "b", "auxiliary_weight": 0.3, "bias": 1.5,
            "early_scale": 0.9, "tail": 20.0, "tail_scale": 1.2, "rule": {"cap": 10.0, "threshold": 240.0, "multiplier": 1.5}
        }
    )
    rows = controls(spark, sf_dir)
    saved = rules.apply(rows).select("o_orderkey", (F.col("final") + (F.col("o_orderkey") % 50 == 1).cast("double")).alias("saved"))
    return tidy(policy.replayed(rows.join(saved, "o_orderkey"), rules, key="o_orderkey"))


@query(
    "keep_last_report",
    "SELECT l_partkey, l_suppkey, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS ord, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey * 10 + l_linenumber DESC) = 1"
)
def keep_last_report(spark, sf_dir):
    rows = adapter.read(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("ord"), "l_quantity"
    )
    return tidy(fd.one_of(rows, ["l_partkey", "l_suppkey"], "last"))


@query(
    "plan_and_reports",
    BASE + "r AS (SELECT ord, CASE WHEN ord % 9 = 0 THEN delay + 1 ELSE delay END AS delay, CASE WHEN ord % 9 = 0 THEN act + 60000000 ELSE act END AS act FROM f) SELECT f.ord, CAST(f.d AS VARCHAR) AS d, f.n, CAST(f.st AS BIGINT) AS st, f.ty, f.s, f.acc, r.act, r.delay FROM f LEFT JOIN r ON f.ord = r.ord AND r.act IS NOT NULL"
)
def plan_and_reports(spark, sf_dir):
    """A timetable and its reports under archive names; a corrected report comes later and counts."""
    _, f = home(spark, sf_dir)
    names = [
        F.col("d").alias("departureDate"), F.col("n").alias("trainNumber"), F.col("st").alias("stationUICCode"), F.col("ty").alias("type"),
        F.timestamp_micros("s").alias("scheduledTime")
    ]
    plan = fd.plan_of(f.select(*names, F.timestamp_micros("acc").alias("timetableAcceptanceDate"), F.col("ord").alias("o")), "o")
    first = f.where("act is not null").select(
        *names, F.timestamp_micros("act").alias("actualTime"), F.col("delay").alias("differenceInMinutes"), F.col("ord").alias("o")
    )
    more = f.where("act is not null and ord % 9 = 0").select(
        *names, F.timestamp_micros(F.col("act") + F.lit(MINUTE)).alias("actualTime"), (F.col("delay") + 1).alias("differenceInMinutes"),
        (F.col("ord") + F.lit(1 << 40)).alias("o")
    )
    out = fd.feed_of(plan, fd.reports_of(first.unionByName(more), "o"))
    return tidy(out.select("ord", F.col("d").cast("string").alias("d"), "n", "st", "ty", "s", "acc", "act", "delay"))


@query("aligned_columns", PRED + "SELECT p.o_orderkey, p.y, CASE WHEN p.o_orderkey % 3 <> 0 THEN p.b END AS extra FROM p")
def aligned_columns(spark, sf_dir):
    rows = adapter.predictions(spark, sf_dir)
    return tidy(
        wide.aligned(
            rows.select("o_orderkey", "y"), rows.where("o_orderkey % 3 <> 0").select("o_orderkey", F.col("b").alias("extra")), "o_orderkey",
            ["extra"]
        )
    )


MATRIX = {"xgboost": "CAST({0} AS FLOAT)", "catboost": "coalesce(CAST({0} AS VARCHAR), 'missing')", "lightgbm": "CAST({0} AS VARCHAR)"}


@query(
    "model_matrix",
    "SELECT o_orderkey, " + ", ".join(
        f"{how.format('CASE WHEN o_custkey % 9 <> 0 THEN o_custkey END')} AS customer_{family}, CAST(o_orderkey % 64 / 4 AS FLOAT) AS share_{family}" for family,
        how in MATRIX.items()
    ) + " FROM orders",
)
def model_matrix(spark, sf_dir):
    """One table of features as three families take it."""
    from . import models

    rows = adapter.read(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_custkey") % 9 != 0, F.col("o_custkey")).alias("customer"),
        (F.col("o_orderkey") % 64 / 4).alias("share")
    )
    out = None
    for family in MATRIX:
        m = models.matrix(rows, family, ["customer", "share"], ["customer"], ["o_orderkey"])
        m = m.withColumnsRenamed({c: f"{c}_{family}" for c in ("customer", "share")})
        out = m if out is None else out.join(m, "o_orderkey")
    return tidy(out)


@query("shuffled_folds", "SELECT o_orderkey, CAST('0x' || substr(md5(o_orderkey || '|42'), 1, 8) AS BIGINT) % 5 AS fold FROM orders")
def shuffled_folds(spark, sf_dir):
    """Each row's fold, by hash of its key."""
    return tidy(evaluate.hashed(adapter.predictions(spark, sf_dir), ["o_orderkey"], 5).select("o_orderkey", "fold"))


def messages(spark, sf_dir):
    """Events as a stream of files, in the engine's terms."""
    events = adapter.read(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.select(
        F.to_date("ts").alias("d"), (F.col("user_id") % 25).alias("n"), adapter.chosen("event_type", adapter.STATIONS).alias("st"),
        F.col("ts").cast("timestamp").alias("known_at"), F.unix_micros(F.col("ts").cast("timestamp")).alias("s"),
        F.col("value").alias("delay"), (F.col("event_id") % 4 == 0).alias("done"), F.col("event_id")
    )


@query(
    "stream_station_windows",
    "WITH e AS (SELECT CASE event_type WHEN 'click' THEN 100 WHEN 'view' THEN 200 WHEN 'signup' THEN 300 WHEN 'purchase' THEN 370 WHEN 'error' THEN 400 END AS st, epoch_us(ts) AS t, value FROM events), w AS (SELECT st, value, (t // 1800000000 - i) * 1800000000 AS start FROM e, range(6) r(i)) SELECT CAST(st AS BIGINT) AS st, start AS start_us, count(value) AS n, round(avg(value), 6) AS mean_delay, max(value) AS max_delay FROM w GROUP BY ALL"
)
def stream_station_windows(spark, sf_dir):
    """The sliding context as a stream, run to its end."""
    out = streams.run_to_end(streams.station_windows(messages(spark, sf_dir)), mode="complete")
    return tidy(out.select("st", F.unix_micros("window.start").alias("start_us"), "n", "mean_delay", "max_delay"), 6)


@query(
    "stream_pending",
    "WITH e AS (SELECT CAST(ts AS DATE) AS d, user_id % 25 AS n, epoch_us(ts) AS s, event_id % 4 = 0 AS done FROM events), m AS (SELECT d, n, max(s) FILTER (done) AS done_until FROM e GROUP BY ALL) SELECT CAST(m.d AS VARCHAR) AS d, m.n, count(DISTINCT e.s) AS pending_count, min(e.s) AS oldest_scheduled, any_value(m.done_until) AS done_until FROM m LEFT JOIN e ON e.d = m.d AND e.n = m.n AND NOT e.done AND (m.done_until IS NULL OR e.s > m.done_until) GROUP BY m.d, m.n"
)
def stream_pending(spark, sf_dir):
    """Pending events as keyed state, after the last message of each run."""
    out = streams.run_to_end(streams.pending(messages(spark, sf_dir).select("d", "n", "s", "done")), mode="update")
    return out.withColumn("d", F.col("d").cast("string"))


@query("stream_once", "SELECT count(DISTINCT (user_id % 25, event_type, ts)) AS events FROM events")
def stream_once(spark, sf_dir):
    """A stream that repeats itself, without its repeats."""
    rows = messages(spark, sf_dir)
    return streams.run_to_end(streams.once(rows.unionByName(rows), ["n", "st", "known_at"], "400 days")).agg(F.count("*").alias("events"))


@query(
    "stream_runs_over",
    "WITH e AS (SELECT CAST(ts AS DATE) AS d, user_id % 25 AS n, epoch_us(ts) AS s, event_id % 4 = 0 AS done FROM events), m AS (SELECT d, n, max(s) FILTER (done) AS done_until, max(s) AS last FROM e GROUP BY ALL), x AS (SELECT max(s) AS now FROM e), p AS (SELECT m.d, m.n, count(DISTINCT e.s) AS pending_count, min(e.s) AS oldest_scheduled, max(e.s) AS latest, any_value(m.done_until) AS done_until, any_value(m.last) AS last FROM m LEFT JOIN e ON e.d = m.d AND e.n = m.n AND NOT e.done AND (m.done_until IS NULL OR e.s > m.done_until) GROUP BY m.d, m.n) SELECT CAST(d AS VARCHAR) AS d, n, pending_count, oldest_scheduled, done_until FROM p, x WHERE greatest(coalesce(latest // 1000 + 86400000, 0), last // 1000 + 7200000) <= now // 1000 - 7200000"
)
def stream_runs_over(spark, sf_dir):
    """What was pending when each run's timer ended it; runs whose time is not up have no row."""
    out = streams.run_to_end(timed.pending_runs(messages(spark, sf_dir).select("d", "n", "s", "done", "known_at")), mode="update")
    return out.where("over").drop("over")


@query(
    "stream_sessions",
    "WITH e AS (SELECT CAST(ts AS DATE) AS d, user_id % 25 AS n, epoch_us(ts) AS t, value FROM events), b AS (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY d, n ORDER BY t) >= 5400000000, true) AS fresh FROM e), s AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY d, n ORDER BY t) AS k FROM b), x AS (SELECT max(t) - 7200000000 AS mark FROM e) SELECT CAST(d AS VARCHAR) AS d, n, min(t) AS start_us, max(t) + 5400000000 AS end_us, count(*) AS events, round(avg(value), 6) AS mean_delay, max(value) AS max_delay FROM s, x GROUP BY d, n, k, mark HAVING max(t) + 5400000000 <= mark"
)
def stream_sessions(spark, sf_dir):
    """Reports of a run without a gap, given when the watermark has passed their end."""
    out = streams.run_to_end(streams.run_sessions(messages(spark, sf_dir)))
    return tidy(out.select(F.col("d").cast("string").alias("d"), "n", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "events", "mean_delay", "max_delay"), 6)


LOG = """WITH e AS (SELECT CAST(ts AS DATE) AS d, user_id % 25 AS n, CASE event_type WHEN 'click' THEN 100 WHEN 'view' THEN 200 WHEN 'signup' THEN 300 WHEN 'purchase' THEN 370 WHEN 'error' THEN 400 END AS st, epoch_us(ts) AS s, event_id AS id, CASE WHEN event_id % 17 <> 0 THEN round(value, 3) END AS v FROM events),
r AS (SELECT d, n, st, s, v AS delay, id AS known, id % 3 + 1 AS version FROM e WHERE id % 3 < 2 UNION ALL SELECT d, n, st, s, v + 5, id + 10000000, 3 FROM e WHERE id % 6 = 1 UNION ALL SELECT d, n, st, s, v + 9, id - 10000000, 3 FROM e WHERE id % 30 = 3),
l AS (SELECT version AS upto, r.* FROM r UNION ALL SELECT 2, r.* FROM r WHERE version = 1 UNION ALL SELECT 3, r.* FROM r WHERE version < 3),
x AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY upto, d, n, st, s ORDER BY known DESC, version DESC) = 1)
"""


@query(
    "history_versions",
    LOG + "SELECT CAST(upto AS BIGINT) AS version, CAST(st AS BIGINT) AS st, count(*) AS events, count(delay) AS reported, round(avg(delay), 6) AS mean_delay, round(sum(delay * delay), 3) AS squares FROM x GROUP BY upto, st"
)
def history_versions(spark, sf_dir):
    """What three versions of a log knew of the stations: reports, more reports, then corrections and stale ones."""
    events = adapter.read(spark, sf_dir, "events").select(
        F.to_date("ts").alias("d"), (F.col("user_id") % 25).alias("n"), adapter.chosen("event_type", adapter.STATIONS).alias("st"),
        F.lit("ARRIVAL").alias("ty"), F.unix_micros(F.col("ts").cast("timestamp")).alias("s"), F.lit(None).cast("long").alias("act"),
        F.when(F.col("event_id") % 17 != 0, F.round("value", 3)).alias("delay"), F.col("event_id").alias("known_at")
    )
    k, apart = F.col("known_at"), 10_000_000
    late = events.where(k % 6 == 1).withColumn("delay", F.col("delay") + 5).withColumn("known_at", k + apart)
    stale = events.where(k % 30 == 3).withColumn("delay", F.col("delay") + 9).withColumn("known_at", k - apart)
    log = history_log.HistoryLog(spark, storage.new_path(spark))
    out = None
    for batch in (events.where(k % 3 == 0), events.where(k % 3 == 1), late.unionByName(stale)):
        version = log.append(batch)
        now = log.summary("stations", version).withColumn("version", F.lit(version).cast("long"))
        out = now if out is None else out.unionByName(now)
    return out.select("version", "st", "events", "reported", F.round("mean_delay", 6).alias("mean_delay"), F.round("squares", 3).alias("squares"))


@query("boosted_scores")
def boosted_scores(spark, sf_dir):
    """Boosted trees fitted on the development part and applied to all rows."""
    from . import models

    rows = ingest.row_ids(controls(spark, sf_dir).drop("row_id"), ["t", "o_orderkey"])
    parts = evaluate.chronological(rows, rows.count())
    model = models.Boosted(["history_count", "oldest_pending_minutes", "previous_delay"], maxIter=3, maxDepth=3).fit(parts.where("part = 'development'"), "y")
    return model.predict(parts).select("o_orderkey", "part", "y", "prediction")


@query("ridge_scores")
def ridge_scores(spark, sf_dir):
    """Ridge fitted in one pass on the development part and applied to all rows."""
    from . import models

    rows = ingest.row_ids(controls(spark, sf_dir).drop("row_id"), ["t", "o_orderkey"])
    parts = evaluate.chronological(rows, rows.count())
    model = models.Ridge(models.Preparation(["oldest_pending_minutes", "previous_delay"], ["history_count"])).fit(parts.where("part = 'development'"), "y")
    return tidy(model.predict(parts).select("o_orderkey", "part", "y", "prediction"), 6)
