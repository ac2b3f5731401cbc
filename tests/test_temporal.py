"""Hand-computed values, strict boundaries and perturbations of the point-in-time operators."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegate.functions.clock import MINUTE
from tidegate.operators import feed as fd
from tidegate.operators import history, ingest, origin, route, turnaround, weather
from tidegate.operators.temporal import as_of, in_window

DAY = dt.date(2024, 1, 1)
SCHEMA = "d date, n long, st int, ty string, s long, acc long, act long, delay double, ord long, cat string, stopping boolean, commercial boolean, train_type string, table_type string, ready long"


def at(h, m=0):
    return (19723 * 1440 + h * 60 + m) * MINUTE


def row(k, n, st, ty, s, act=None, delay=None, acc=None, cat="Long-distance", ready=None):
    return (DAY, n, st, ty, s, at(10) if acc is None else acc, act, delay, k, cat, True, True, "IC", "REGULAR", ready)


@pytest.fixture
def frame(spark):
    def make(rows):
        f = spark.createDataFrame([row(k, *r) if not isinstance(r, dict) else row(k, **r) for k, r in enumerate(rows)], SCHEMA)
        return f

    return make


def asks(f, ord_, lag=30):
    return fd.asked(f.where(F.col("ord") == ord_).select("ord", *fd.KEY), "ord", lag)


ROWS = [
    (23, 10, "DEPARTURE", at(12, 0), at(12, 10), 10.0),
    (23, 20, "ARRIVAL", at(12, 20), None, None),
    (23, 20, "DEPARTURE", at(12, 25), None, None),
    (23, 370, "DEPARTURE", at(13, 0), at(13, 5), 5.0),
    (24, 370, "ARRIVAL", at(12, 0), at(12, 5), 5.0),
    (25, 370, "ARRIVAL", at(12, 20), None, None),
    (26, 370, "ARRIVAL", at(12, 10), None, None),
    (26, 400, "ARRIVAL", at(12, 15), at(12, 16), None),
]


def test_history_and_context(frame):
    f = frame(ROWS)
    h = history.run_history(asks(f, 3), f).first()
    assert (h.history_count, h.previous_delay, h.previous_age_minutes, h.previous_scheduled_gap_minutes) == (1, 10.0, 20.0, 60.0)
    assert (h.pending_count, h.oldest_pending_minutes, h.next_expected_gap_minutes) == (2, 10.0, 40.0)
    assert (h.origin_station, h.scheduled_run_elapsed_minutes, h.scheduled_route_position, h.previous_station) == (10, 60.0, 3, 10)
    c = history.station_context(asks(f, 3), f).first()
    # 26's missing report is resolved by its later event although that has no delay.
    assert (c.home_recent_count, c.home_recent_mean_delay, c.home_pending_count, c.home_resolved_count, c.home_oldest_pending_minutes) == (1, 5.0, 1, 1, 10.0)


def test_equality_at_the_cut_is_excluded(frame):
    for act, acc, n in ((at(12, 30), at(10), 0), (at(12, 30) - 1, at(10), 1), (at(12, 10), at(12, 30), 0), (at(12, 10), at(12, 30) - 1, 1)):
        f = frame([(23, 10, "DEPARTURE", at(12, 0), act, 10.0, acc), ROWS[3]])
        assert history.run_history(asks(f, 1), f).first().history_count == n


def test_the_future_changes_nothing(frame):
    names = lambda df: sorted(map(tuple, df.collect()))
    f = frame(ROWS)
    changed = frame(
        [
            *ROWS[:3], (23, 370, "DEPARTURE", at(13, 0), at(15, 0), 120.0), *ROWS[4:], (27, 370, "ARRIVAL", at(13, 30), at(12, 40), 99.0),
            (23, 500, "ARRIVAL", at(14, 0), at(13, 50), -10.0)
        ]
    )
    for build in (
        history.run_history, history.station_context, route.network, turnaround.context, lambda q,
        g: turnaround.candidates(q, turnaround.terminating(q, g), g)
    ):
        assert names(build(asks(f, 3), f)) == names(build(asks(changed, 3), changed))


def test_without_a_run(frame, spark):
    f = frame(ROWS)
    q = spark.createDataFrame([(1, DAY, 999, 370, "ARRIVAL", at(13), at(12, 30))], "qid long, d date, n long, st int, ty string, s long, cut long")
    h = history.run_history(q, f).first()
    assert h.history_count == 0 and h.pending_count is None and h.oldest_pending_minutes is None
    assert history.snapshot(q, f).count() == 1


def test_enriched(frame):
    f = frame([
        (1, 100, "DEPARTURE", at(11, 0), at(11, 2), 2.0), (1, 200, "ARRIVAL", at(11, 10), at(11, 14), 4.0),
        (1, 200, "DEPARTURE", at(11, 15), at(11, 25), 10.0), (1, 300, "ARRIVAL", at(11, 40), None, None),
        (1, 300, "DEPARTURE", at(11, 50), None, None), (1, 370, "ARRIVAL", at(12, 0), None, None),
        (1, 370, "DEPARTURE", at(12, 10), None, None), (1, 500, "ARRIVAL", at(13, 0), None, None),
    ])
    e = route.enriched(asks(f, 6), f).first()
    assert (e.clean_pending_count, e.clean_oldest_pending_minutes, e.last_scheduled_delay, e.scheduled_order_delay_change) == (0, 0.0, 10.0, 6.0)
    assert (e.scheduled_order_delay_slope, e.recent_delay_acceleration, e.recent3_median_delay) == (6 / 5, 4.0, 4.0)
    # Dwell: 300 from 11:40 to 11:50, 370 from 12:00 to the query's 12:10.
    assert (e.planned_dwell_after_source_minutes, e.planned_running_after_source_minutes, e.delay_after_planned_dwell) == (20.0, 35.0, 0.0)
    assert (e.planned_total_events, e.planned_total_stations, e.planned_destination_station, e.minutes_to_next_scheduled_event) == (8, 5, 500, 0.0)
    s = {(r.context, r.station) for r in route.route_stations(asks(f, 6), f).collect()}
    assert s == {("previous_station", 200), ("next_station", 300), ("route_ahead", 300), ("route_ahead", 370)}


def test_origin_reverse_and_readiness(frame):
    f = frame([
        (1, 370, "DEPARTURE", at(13, 0), at(13, 5), 5.0), (1, 900, "ARRIVAL", at(15, 0), None, None),
        {"n": 2, "st": 900, "ty": "DEPARTURE", "s": at(10, 30), "act": at(10, 45), "delay": 15.0, "ready": at(10, 35), "acc": at(9)},
        {"n": 2, "st": 370, "ty": "ARRIVAL", "s": at(12, 0), "acc": at(9)},
        (3, 500, "DEPARTURE", at(9), at(9, 1), 1.0), (3, 370, "ARRIVAL", at(12, 50), None, None),
    ])
    q = asks(f, 0)
    o = {r.window: r for r in origin.origin_context(q, f).collect()}
    # Run 3 ends less than 15 minutes before the start.
    assert (
        o[180]["count"], o[180].reverse_count, o[180].closest_gap_minutes, o[180].closest_last_delay, o[180].closest_projected_delay,
        o[180].closest_pending_minutes
    ) == (1, 1, 60.0, 15.0, 0.0, 30.0)
    assert (o[720].reverse_gap_minutes, o[720].reverse_last_delay, o[720].reverse_end_age_minutes) == (60.0, 15.0, None)
    r = {x.window: x for x in origin.readiness_inbound(q, f).collect()}
    assert (r[180]["count"], r[180].closest_delay_minutes, r[180].closest_to_actual_minutes, r[180].closest_age_minutes) == (1, 5.0, 10.0, 115.0)
    assert origin.readiness_own(q, f).first().ready_own_count is None


def test_turnaround(frame):
    f = frame([
        (1, 370, "DEPARTURE", at(13, 0), None, None), (1, 900, "ARRIVAL", at(15, 0), None, None),
        (2, 800, "DEPARTURE", at(11), at(11, 20), 20.0), (2, 370, "ARRIVAL", at(12, 35), None, None),
        (3, 800, "DEPARTURE", at(10), at(10, 5), 5.0), (3, 370, "ARRIVAL", at(12, 0), at(12, 10), 10.0),
    ])
    q = asks(f, 0)
    c = turnaround.candidates(q, turnaround.terminating(q, f), f).first()
    assert (c.origin_departure, c.candidate_count, c.candidate_unobserved_count, c.candidate_scheduled_gap_minutes) == (1.0, 2, 1, 25.0)
    assert (
        c.candidate_last_known_delay, c.candidate_observation_age_minutes, c.candidate_projected_departure_delay,
        c.worst_projected_departure_delay
    ) == (20.0, 70.0, 25.0, 25.0)


def test_service_history(spark):
    days = [
        (
            k, DAY + dt.timedelta(k), 5, "ARRIVAL", at(12) + k * 1440 * MINUTE, at(11, 30) + k * 1440 * MINUTE,
            at(12, k) + k * 1440 * MINUTE, float(k), True, k % 2, k, 1.0
        ) for k in range(40)
    ]
    rows = spark.createDataFrame(
        days,
        "qid long, d date, n long, ty string, s long, cut long, act long, delay double, known boolean, history_count long, pending_count long, previous_age_minutes double"
    )
    s = {r.qid: r for r in history.service_history(rows).collect()}
    assert s[0].service_observed_runs is None and s[1].service_mean_delay == 0.0
    assert (s[39].service_observed_runs, s[39].service_max_delay, s[39].service_last_delay, s[39].service_median_delay) == (28, 38.0, 38.0, 24.5)


def test_as_of_and_ranges(spark):
    q = spark.createDataFrame([(1, "a", 100), (2, "a", 50), (3, "a", 260), (4, "b", 100), (5, "a", 221)], "qid long, k string, t long")
    f = spark.createDataFrame([("a", 50, 1.0), ("a", 99, 2.0), ("a", 100, 3.0), ("b", 101, 4.0), (None, 99, 9.0)], "k string, u long, v double")
    got = {r.qid: (r.u, r.v) for r in as_of(q, f, ["k"], "t", "u", ["v"], 120).collect()}
    assert got == {1: (99, 2.0), 2: (None, None), 3: (None, None), 4: (None, None), 5: (None, None)}
    assert {r.qid: r.u for r in as_of(q, f, ["k"], "t", "u", ["v"], 121).collect()}[5] == 100
    pairs = sorted((r.qid, r.u) for r in in_window(q, f, ["k"], "u", F.col("t") - 50, F.col("t"), 50).collect())
    assert pairs == [(1, 50), (1, 99)]


def test_weather(spark):
    hours = [("t2m", at(h), float(h)) for h in range(10)] + [
        ("r_1h", at(h), -1.0 if h == 3 else 2.0) for h in range(10)
    ] + [("snow_aws", at(h), -7.0) for h in range(10)]
    s = weather.clean(spark.createDataFrame(hours, "parameter string, t long, value double"))
    q = spark.createDataFrame([(1, at(11, 30), at(11)), (2, at(13), at(12, 30))], "qid long, s long, cut long")
    now = {(r.qid, r.parameter): r for r in weather.latest(q, s, ["t2m", "r_1h", "snow_aws"]).collect()}
    # Deadline 10:00: strictly before is 09:00, 60 + 90 minutes old.
    assert (now[1, "t2m"].value, now[1, "t2m"].age_minutes, now[1, "snow_aws"].value, now[2, "t2m"].value) == (9.0, 150.0, None, None)
    past = {(r.qid, r.parameter, r.hours): r for r in weather.rolling(q, s, ["t2m", "r_1h"]).collect()}
    assert (
        past[1, "t2m", 6].n, past[1, "t2m", 6]["mean"], past[1, "r_1h", 6]["sum"], past[1, "t2m", 24]["mean"], past[1, "t2m", 6].change
    ) == (6, 6.5, 12.0, None, 5.0)
    flat = weather.wide(
        q, weather.latest(q, s, ["t2m", "r_1h", "ws_10min", "wd_10min"]),
        weather.rolling(q, s, ["t2m", "r_1h", "ws_10min", "wg_10min", "snow_aws"]), ["t2m", "r_1h", "ws_10min", "wd_10min"]
    )
    assert {r.qid: r.fmi_freezing_precipitation for r in flat.collect()} == {1: 0.0, 2: None}


def test_feed(spark):
    plan = spark.createDataFrame(
        [("2024-01-01", 1, 370, "ARRIVAL", "2024-01-01T12:00:00.000Z", "2024-01-01T10:00:00.000Z")],
        "departureDate string, trainNumber int, stationUICCode int, type string, scheduledTime string, timetableAcceptanceDate string"
    )
    seen = spark.createDataFrame(
        [
            ("2024-01-01", 1, 370, "ARRIVAL", "2024-01-01T12:00:00.000Z", "2024-01-01T14:05:00+02:00", 5.0, 1),
            ("2024-01-01", 1, 370, "ARRIVAL", "2024-01-01T12:00:00.000Z", "junk", float("nan"), 2)
        ],
        "departureDate string, trainNumber int, stationUICCode int, type string, scheduledTime string, actualTime string, differenceInMinutes double, o int"
    )
    f = fd.feed_of(fd.plan_of(plan), fd.reports_of(seen, "o"), keep="first").first()
    assert f.s == at(12) and f.act == at(12, 5) and f.delay == 5.0
    last = fd.feed_of(fd.plan_of(plan), fd.reports_of(seen, "o")).first()
    assert last.act is None and last.delay is None
    with pytest.raises(Exception, match="duplicate key"):
        fd.feed_of(fd.plan_of(plan.union(plan)), fd.reports_of(seen, "o")).collect()


def test_ingest(spark):
    df = spark.createDataFrame([(k, k % 3, None if k % 2 else 1) for k in range(10)], "o long, a long, b long")
    assert sorted(r.o for r in ingest.dedup(df, ["a", "b"], "o").collect()) == [0, 1, 2, 3, 4, 5]
    assert sorted(r.o for r in ingest.dedup(df, ["a", "b"], "o", "last").collect()) == [4, 5, 6, 7, 8, 9]
    assert [r.row_id for r in ingest.row_ids(df, ["a", "o"]).orderBy("a", "o").collect()] == list(range(10))
    assert ingest.row_ids(df.limit(0), ["a", "o"]).count() == 0
    assert ingest.previous_source("matched_data_flat_2020_01.parquet") == ("matched_data_flat_2019_12.parquet", "2020-01-01")
    with pytest.raises(ValueError):
        ingest.previous_source("other.parquet")


def test_conflicts_in_tasks_of_bounded_rows(spark, monkeypatch):
    """Tasks grow in number with the rows, a key's rows meet in one of them, and missing values and keys count."""
    monkeypatch.setattr(ingest, "TASK_ROWS", 100)
    rows = [(k % 400, None if k % 5 == 0 else "x", float(k // 400 % 3) if k % 7 else None) for k in range(2000)] + [(None, None, 1.0), (None, None, 2.0)]
    out = ingest.conflicts(spark.createDataFrame(rows, "a long, b string, v double"), ["a", "b"], "v")
    want = {}
    for a, b, v in rows:
        want.setdefault((a, b), set()).add(v)
    assert {(r.a, r.b): r["values"] for r in out.collect()} == {k: len(v) for k, v in want.items() if len(v) > 1}
    assert out.rdd.getNumPartitions() >= 20


def test_rolling_holds_two_windows_of_values(spark):
    """A slice is as long as the longest window, and a sum does not depend on what came before the window."""
    g, hour = np.random.default_rng(1), 60 * MINUTE
    t = np.sort(g.choice(24 * 30 * 60, 3000, replace=False)) * MINUTE
    value = np.where(g.random(3000) < 0.02, 1e9, g.integers(0, 999, 3000) / 100)
    cut = g.integers(0, 24 * 30, 200) * hour
    alone = {k: math.fsum(value[(t < c) & (t >= c - 24 * hour)]) for k, c in enumerate(cut - hour)}
    found = weather.windows_of(t, value, cut - hour, 24 * hour)
    assert {int(k): s for k, s in zip(found["at"], found["sum"])} == {k: s for k, s in alone.items() if s}
    series = spark.createDataFrame([("t2m", int(a), float(b)) for a, b in zip(t, value)], "parameter string, t long, value double")
    out = weather.rolling(spark.createDataFrame([(k, int(c)) for k, c in enumerate(cut)], "qid long, cut long"), series, ["t2m"], stale=24 * 60)
    got = {r.qid: r["sum"] for r in out.where("hours = 24").collect() if r["sum"] is not None}
    assert len(got) > 150 and all(s == alone[k] for k, s in got.items())
    text = out._jdf.queryExecution().analyzed().toString()
    assert str(24 * hour) in text and str(96 * hour) not in text
