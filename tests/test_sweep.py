"""Sweeps: the same values as by all pairs, on clocks with ties and gaps, and plans in which queries and events are not joined."""

import datetime as dt
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegate.operators import feed as fd
from tidegate.operators import history, provenance, route, sweep, turnaround

from .test_temporal import SCHEMA, at, row


def noise(spark, n=240, runs=3, seed=5):
    """A feed of few runs in a few hours: many equal times, late plans, missing reports."""
    g = np.random.default_rng(seed)
    pick = lambda values: values[int(g.integers(len(values)))]
    rows = []
    for k in range(n):
        s = at(9) + int(g.integers(0, 300)) * 60_000_000
        act = None if g.random() < 0.2 else s + int(g.integers(-3, 60)) * 60_000_000
        rows.append(row(k, int(g.integers(1, runs + 1)), pick([100, 200, 370]), pick(["ARRIVAL", "DEPARTURE"]), s, act, None if g.random() < 0.2 else float(g.integers(-3, 40)), s - int(g.integers(0, 8)) * 1_200_000_000))
    return spark.createDataFrame(rows, SCHEMA)


def asks(f):
    return fd.asked(f.where("st = 370").select("ord", *fd.KEY), "ord")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def sides(spark):
    f = noise(spark).cache()
    return asks(f), f, asks(f).collect(), f.collect()


def of_run(q, events):
    return [e for e in events if (e.d, e.n) == (q.d, q.n) and e.acc < q.cut]


def test_run_history_meets_no_pair(sides):
    q, f, asked, events = sides
    df = history.run_history(q, f)
    assert "Join" not in plan(df)
    got = {r.qid: r for r in df.collect()}
    assert len(got) == len(asked) > 50
    for x in asked:
        p = [e for e in of_run(x, events) if e.s < x.s]
        done = [e for e in p if e.act is not None and e.act < x.cut]
        u = sorted((e for e in done if e.delay is not None), key=lambda e: (e.act, e.ord), reverse=True)
        m = max((e.s for e in done), default=-1)
        open_ = [e.s for e in p if e.s < x.cut and e not in done and e.s > m]
        r = got[x.qid]
        assert (r.history_count, r.pending_count, r.scheduled_route_position or 0) == (len(u), len(open_), len(p))
        assert (r.previous_delay, r.second_previous_delay) == tuple(u[k].delay if len(u) > k else None for k in (0, 1))
        assert r.oldest_pending_minutes == ((x.cut - min(open_)) / 6e7 if open_ else 0.0)
        assert r.next_expected_gap_minutes == ((x.s - min((e.s for e in p if e.s > u[0].s), default=x.s)) / 6e7 if u else None)
        assert (r.latest_act, r.latest_acc) == (max((e.act for e in done), default=None), max((e.acc for e in p), default=None))


def test_spans_and_stabs():
    g = np.random.default_rng(1)
    v = g.integers(0, 50, 37)
    least, at, bound = sweep.Spans(v), g.integers(0, 38, 200), g.integers(0, 50, 200)
    assert least.after(at, bound).tolist() == [next((k for k in range(a, 37) if v[k] < b), 37) for a, b in zip(at, bound)]
    assert least.before(at, bound).tolist() == [next((k for k in range(a - 1, -1, -1) if v[k] < b), -1) for a, b in zip(at, bound)]
    start, cut, own = g.integers(0, 90, 150), g.integers(0, 100, 80), g.integers(0, 4, 80)
    end, group, value = start + g.integers(-2, 30, 150), g.integers(0, 4, 150), g.permutation(150)
    s = sweep.Stabs(cut, own)
    holds = (start < cut[:, None]) & (cut[:, None] <= end) & (group != own[:, None])
    assert s.total(start, end, group).tolist() == holds.sum(1).tolist()
    assert s.total(start, end, group, value).tolist() == (holds * value).sum(1).tolist()
    best = s.best(start, end, group, sweep.ordered(value))
    assert best.tolist() == [int(np.argmax(np.where(h, value, -1))) if h.any() else -1 for h in holds]
    key = g.integers(0, 40, 150)
    least = g.integers(0, 45, 80)
    some = (start < cut[:, None]) & (key >= least[:, None])
    assert sweep.dominant(start, key, [value], cut, least)[0].tolist() == [int(value[h].max()) if h.any() else sweep.NONE for h in some]


def test_enriched_meets_no_pair(sides):
    q, f, asked, events = sides
    df = route.enriched(q, f)
    assert "Join" not in plan(df)
    got = {r.qid: r for r in df.collect()}
    assert len(got) == len(asked)
    for x in asked:
        r, k = got[x.qid], sorted(of_run(x, events), key=lambda e: (e.s, e.st, e.ty, e.ord))
        done = [e for e in k if e.s < x.s and e.act is not None and e.act < x.cut]
        u = [e for e in reversed(done) if e.delay is not None]
        m = max((e.s for e in done), default=-1)
        p = [e for e in k if e.s < min(x.s, x.cut) and e.s > m and e not in done]
        assert (r.clean_pending_count, r.planned_total_events or 0, r.planned_total_stations or 0) == (len(p), len(k), len({e.st for e in k}))
        assert (r.latest_pending_station, r.last_scheduled_station) == (p[-1].st if p else None, u[0].st if u else None)
        assert (r.enriched_latest_act, r.enriched_latest_acc) == (max((e.act for e in done), default=None), max((e.acc for e in k), default=None))
        if not u:
            assert r.planned_dwell_after_source_minutes is None and r.recent5_mean_delay is None
            continue
        d, src = [e.delay for e in u[:5]], u[0].s
        assert r.recent5_mean_delay == pytest.approx(np.mean(d)) and r.recent5_std_delay == pytest.approx(np.std(d))
        assert r.recent3_median_delay == np.median(d[:3])
        came = lambda st, to: max((e.s for e in k if e.ty == "ARRIVAL" and e.st == st and src <= e.s < to), default=to)
        dwell = sum(e.s - min(e.s, came(e.st, e.s + 1)) for e in k if e.ty == "DEPARTURE" and src < e.s < x.s)
        if x.ty == "DEPARTURE" and any((e.st, e.ty, e.s) == (x.st, x.ty, x.s) for e in k):
            dwell += x.s - came(x.st, x.s)
        assert r.planned_dwell_after_source_minutes == pytest.approx(dwell / 6e7)
        ahead = [e for e in k if src < e.s <= x.s]
        assert (r.next_scheduled_event_station, r.planned_events_after_source) == (ahead[0].st if ahead else None, sum(e.s < x.s for e in ahead))


def test_route_stations_meet_no_pair(sides):
    q, f, asked, events = sides
    df = route.route_stations(q, f)
    assert "Join" not in plan(df)
    want = []
    for x in asked:
        k = sorted((e for e in of_run(x, events) if e.s <= x.s), key=lambda e: (e.s, e.st, e.ty, e.ord))
        done = [e for e in k if e.s < x.s and e.act is not None and e.act < x.cut]
        ahead = list(dict.fromkeys(e.st for e in k if not done or e.s > done[-1].s))[:3]
        want += [(x.qid, "previous_station", e.st) for e in done[-1:]] + [(x.qid, "next_station", s) for s in ahead[:1]]
        want += [(x.qid, "route_ahead", s) for s in ahead]
    assert sorted((r.qid, r.context, r.station) for r in df.collect()) == sorted(want)


def around(x, station, events, w=180):
    """Pending and seen events of other runs, and the latest clocks of what resolved those that are no longer pending."""
    near = [e for e in events if e.st == station and (e.d, e.n) != (x.d, x.n) and e.acc < x.cut]
    old = lambda e: e.act is not None and e.act < x.cut
    seen = [e for e in near if old(e) and e.act >= x.cut - w * 60_000_000]
    wait = [e for e in near if not old(e) and x.cut - w * 60_000_000 <= e.s < x.cut]
    by = [[c for c in events if (c.d, c.n) == (e.d, e.n) and c.act is not None and c.act < x.cut and c.acc < x.cut and c.s >= e.s] for e in wait]
    return seen, [e for e, b in zip(wait, by) if not b], [c for b in by for c in b], sum(map(bool, by))


def test_station_context_meets_no_pair(sides):
    q, f, asked, events = sides
    df = history.station_context(q, f)
    assert "o_act" not in plan(df).split("FlatMapCoGroups")[0]  # events meet queries in no join
    got = {r.qid: r for r in df.collect()}
    for x in asked:
        seen, open_, by, n = around(x, 370, events)
        told, r = [e for e in seen if e.delay is not None], got[x.qid]
        assert (r.home_recent_count, r.home_pending_count, r.home_resolved_count) == (len(told), len(open_), n)
        assert (r.home_recent_mean_delay, r.home_recent_max_delay) == ((pytest.approx(np.mean([e.delay for e in told])), max(e.delay for e in told)) if told else (None, None))
        assert r.home_oldest_pending_minutes == ((x.cut - min(e.s for e in open_)) / 6e7 if open_ else 0.0)
        assert r.context_act == max((e.act for e in told + by), default=None)
        assert r.context_acc == max((e.acc for e in told + by + open_), default=None)


def test_network_meets_no_pair(sides):
    q, f, asked, events = sides
    df = route.network(q, f)
    got = {(r.qid, r.context): r for r in df.collect()}
    at = {}
    for r in route.route_stations(q, f).collect():
        at.setdefault((r.qid, r.context), []).append(r.station)
    assert got.keys() == at.keys()
    by_id = {x.qid: x for x in asked}
    for (qid, context), stations in at.items():
        for w in (60, 180):
            seen, open_ = [], []
            for st in stations:
                a, b, *_ = around(by_id[qid], st, events, w)
                seen += [e for e in a if e.delay is not None]
                open_ += b
            r, last = got[qid, context], max(seen, key=lambda e: (e.act, -e.s, -e.st, e.delay), default=None)
            assert (r[f"{w}m_count"], r[f"{w}m_pending_count"]) == (len(seen), len(open_))
            assert r[f"{w}m_last_delay"] == (last.delay if last else None)


def test_provenance_and_kinds_meet_no_pair(sides):
    q, f, asked, events = sides
    df = provenance.network(q, f)
    assert "o_act" not in plan(df).split("FlatMapCoGroups")[0]
    stamps = {r.qid: r for r in df.collect()}
    kinds = {(r.qid, r.kind, r.window): r for r in turnaround.context(q, f).collect()}
    at = [(r.qid, r.station) for r in route.route_stations(q, f).collect()]
    for x in asked:
        own = [e for e in of_run(x, events) if e.s <= x.s]
        done = [e for e in own if e.s < x.s and e.act is not None and e.act < x.cut]
        act, acc, n_act, n_acc = [e.act for e in done], [e.acc for e in own], len(done), len(own)
        for st in (s for k, s in at if k == x.qid):
            seen, open_, by, n = around(x, st, events)
            near = [e for e in events if e.st == st and (e.d, e.n) != (x.d, x.n) and e.acc < x.cut and x.cut - 180 * 60_000_000 <= e.s < x.cut]
            old = [e for e in near if e.act is not None and e.act < x.cut]
            told = [e for e in seen if e.delay is not None]
            act += [e.act for e in told + old + by]
            acc += [e.acc for e in near + told + by]
            n_act += len(told) + len(old) + n
            n_acc += len(told) + len(near) + n
        r = stamps[x.qid]
        assert (r.latest_act, r.latest_acc, r.used_act, r.used_acc) == (max(act, default=None), max(acc, default=None), n_act, n_acc)
        for w in (60, 180):
            seen, open_, *_ = around(x, 370, [e for e in events if e.ty == "ARRIVAL" or e.st != 370], w)
            assert kinds[x.qid, "ARRIVAL", w].observed_count == len(seen)


def test_turnarounds_meet_no_pair(spark):
    g, rows = np.random.default_rng(3), []
    for n in range(40):
        begin = int(g.integers(0, 240))
        stops = [370, 100, 200] if n % 2 else [100, 370, 200, 370]
        for k, st in enumerate(stops):
            s = at(8) + (begin + 15 * k) * 60_000_000
            act = None if g.random() < 0.3 else s + int(g.integers(0, 30)) * 60_000_000
            rows.append(row(len(rows), n, st, "DEPARTURE" if k == 0 else "ARRIVAL", s, act, float(g.integers(0, 40)) if g.random() < 0.8 else None, at(7)))
    f = spark.createDataFrame(rows, SCHEMA).cache()
    q, events = asks(f), f.collect()
    ends = turnaround.terminating(q, f)
    df = turnaround.candidates(q, ends, f)
    got, pairs = {r.qid: r for r in df.collect()}, {r.qid: r for r in turnaround.reported(q, ends, f).collect()}
    assert sum(r.candidate_count or 0 for r in got.values()) > 50
    for x in q.collect():
        may = [e for e in events if e.st == 370 and e.ty == "ARRIVAL" and e.n % 2 == 0 and e.n != x.n and x.s - 180 * 60_000_000 <= e.s <= x.s - 20 * 60_000_000]
        told = [[c for c in events if c.n == e.n and c.delay is not None and c.act is not None and c.act < x.cut and c.s <= e.s] for e in may]
        r, p = got[x.qid], pairs.get(x.qid)
        assert (p.pairs if p else 0) == sum(map(len, told))
        assert (p.act if p else None) == max((c.act for t in told for c in t), default=None)
        if r.origin_departure == 1:
            assert r.candidate_count == len(may)
            late = [max(0.0, max(t, key=lambda c: c.s).delay + 30 - (x.s - e.s) / 6e7) for e, t in zip(may, told) if t]
            assert r.worst_projected_departure_delay == (pytest.approx(max(late)) if late else None)


def test_service_history_takes_no_step_for_each_pair(spark):
    """Days, ties, late clocks, infinite and missing numbers, queries that may not ask: as by all pairs, with one sweep a group."""
    g = np.random.default_rng(3)
    base, minute = at(12), 60_000_000
    day = lambda s: None if s is None else dt.date(1970, 1, 1) + dt.timedelta(s // (1440 * minute))
    rows = []
    for k in range(400):
        s = base + int(g.integers(0, 9)) * 12 * 1440 * minute + int(g.integers(0, 4)) * 600 * minute
        cut, act = s - 30 * minute, None if g.random() < 0.1 else s + int(g.integers(-2, 3)) * 45 * minute
        pick = lambda *x: x[int(g.integers(len(x)))]
        rows.append((k, day(s) if g.random() < 0.97 else None, pick(1, 1, 1, 2, None), pick("A", "A", "D"), s, cut, act, pick(None, 0.5, -3.0, 4.25, 11.0, 11.0, float("inf")), pick(True, True, True, False, None), pick(None, 0, 2), pick(0, 3), pick(None, 1.5, 7.0)))
    names = "qid long, d date, n long, ty string, s long, cut long, act long, delay double, known boolean, history_count long, pending_count long, previous_age_minutes double"
    got = {r.qid: r for r in history.service_history(spark.createDataFrame(rows, names)).collect()}
    assert len(got) == len(rows)
    span, seen = 28 * 1440 * minute, 0
    for qid, d, n, ty, _, cut, *_, known, _, _, _ in rows:
        past = [r for r in rows if known and d and n and r[1] and r[2] == n and r[3] == ty and r[1] != d and r[6] is not None and r[6] < cut and r[4] < cut and r[6] >= cut - span]
        r = got[qid]
        if not past:
            assert all(r[c] is None for c in history.SERVICE)
            continue
        seen += 1
        numbers = lambda i: [p[i] for p in past if p[i] is not None]  # noqa: E731, B023
        same = lambda x, f, y: x is None if not y else x == pytest.approx(f(y), nan_ok=True)
        last = max(past, key=lambda p: (p[6], -p[0]))
        delays = numbers(7)
        assert same(r.service_mean_delay, np.mean, delays) and same(r.service_max_delay, np.max, delays) and same(r.service_median_delay, np.median, delays)
        if np.isfinite(delays).all():
            assert same(r.service_p90_delay, lambda y: np.quantile(y, 0.9), delays)
        assert (r.service_observed_runs, r.service_last_delay) == (len(past), last[7])
        assert r.service_latest == max(last[6], *(p[4] for p in past)) and r.service_last_age_minutes == pytest.approx((cut - last[6]) / minute)
        assert same(r.service_history_coverage, lambda y: np.mean(np.array(y) > 0), numbers(9))
        assert same(r.service_mean_pending, np.mean, numbers(10)) and same(r.service_mean_previous_age, np.mean, numbers(11))
    assert seen > 150


def test_service_history_work_grows_with_rows():
    """A number with 60,000 queries and outcomes of one month: by all pairs this took minutes."""
    g, n = np.random.default_rng(4), 60_000
    minute = 60_000_000
    act = np.sort(g.integers(0, 30 * 1440, n)) * minute
    past = {c: g.integers(0, 50, n).astype(float) for c in history.OUTCOME} | {"qid": np.arange(n), "act": act, "s": act - minute, "d": act // (1440 * minute)}
    began = time.process_time()
    out = history.service_sweep(act, past["d"], past, 28 * 1440 * minute)
    assert time.process_time() - began < 30
    k = n - 1
    low = np.searchsorted(act, act[k] - 28 * 1440 * minute)
    mine = low + np.flatnonzero((act[low:] < act[k]) & (past["d"][low:] != past["d"][k]))
    assert out["service_observed_runs"][0][k] == len(mine)
    assert out["service_p90_delay"][0][k] == pytest.approx(np.quantile(past["delay"][mine], 0.9))
