"""Timers, restarts and sinks of streams; the append-only history."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegate.streaming import history_log, timed

MESSAGES = "d string, n long, s long, done boolean, at string"


def message(n, hour, s_hour, done=False, day=1):
    return ("2024-01-01", n, 1704067200_000000 + s_hour * 3600_000000, done, f"2024-01-{day:02d} {hour:02d}:00:00")


PARTS = [
    [message(1, 8, 9), message(1, 8, 10), message(2, 8, 9), message(3, 9, 12)],
    [message(1, 10, 10, True), message(2, 10, 8, True), message(4, 10, 11)],
    [message(5, 23, 1, day=4), message(3, 23, 12, True, day=4)],
]


def feed(spark, path, k):
    rows = spark.createDataFrame(PARTS[k], MESSAGES).select("d", "n", "s", "done", F.to_timestamp("at").alias("known_at"))
    rows.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drive(spark, tmp_path, stops):
    """All parts in order; the stream is stopped and goes on from its checkpoint after each stop."""
    path, at = str(tmp_path / f"in{len(stops)}"), str(tmp_path / f"out{len(stops)}")
    for k in range(len(PARTS)):
        stream = feed(spark, path, k)
        if k in stops:
            out = timed.run_to_end(timed.pending_runs(stream, "1 hour", quiet_hours=2, limit_hours=24), at, "update")
    return {tuple(r) for r in out.where("over").collect()}, at


def test_timers_and_restart(spark, tmp_path):
    """A run ends once with what is left, its state goes, and a restart changes nothing."""
    once, at = drive(spark, tmp_path, [2])
    again, _ = drive(spark, tmp_path, [0, 1, 2])
    assert once == again
    ended = {r[1]: r for r in once}
    assert ended[1][2:5] == (0, None, PARTS[1][0][2]) and ended[2][2] == 1 and ended[4][2] == 1 and set(ended) == {1, 2, 4}
    left = {r.key.n for r in timed.state_rows(spark, at, "open").collect()} | {r.key.n for r in timed.state_rows(spark, at, "until").collect()}
    assert left == {3, 5}



def test_state_is_asked_for_what_stays_open():
    """Of a batch of 20,000 messages only those open at its end cost a call to the state, in whatever order the frames come."""

    class Map(dict):
        calls = 0

        def updateValue(self, k, v):
            self.calls += 1
            self[k] = v

        def removeKey(self, k):
            self.calls += 1
            del self[k]

    class Value(list):
        def exists(self):
            return bool(self)

        def get(self):
            return self[0]

        def update(self, x):
            self[:] = [x]

    class Timers(list):
        registerTimer, deleteTimer = list.append, list.remove

    machine = timed.Pending(1000, 10_000)
    machine.handle, machine.open, machine.until, machine.alarm = Timers(), Map(), Value(), Value()
    frames = [pd.DataFrame({"s": range(k, 20_000, 4), "done": [k == 1] * 5000, "at_ms": [7] * 5000}) for k in (0, 1, 2, 3)]
    (out,) = machine.handleInputRows(("d", 1), iter(frames), None)
    assert out.iloc[0].tolist() == ["d", 1, 2, 19_998, 19_997, False]
    assert machine.open.keys() == {(19_998,), (19_999,)} and machine.open.calls == 2 and machine.handle == [10_019]
    more = [pd.DataFrame({"s": [19_998, 30_000, 19_999], "done": [True, False, False], "at_ms": [90_000] * 3})]
    (out,) = machine.handleInputRows(("d", 1), iter(more), None)
    assert out.iloc[0].tolist() == ["d", 1, 2, 19_999, 19_998, False] and machine.open.keys() == {(19_999,), (30_000,)} and machine.handle == [91_000]


def test_sink_without_rows(spark, tmp_path):
    empty = spark.createDataFrame([], "n long, v double")
    empty.write.parquet(str(tmp_path / "none"))
    out = timed.run_to_end(spark.readStream.schema(empty.schema).parquet(str(tmp_path / "none")), str(tmp_path / "at"))
    assert out.columns == ["n", "v"] and out.count() == 0


def recomputed(rows, by):
    last = {}
    for r in rows:
        if r[:5] not in last or r[7] > last[r[:5]][7]:
            last[r[:5]] = r
    out = {}
    for r in last.values():
        out.setdefault(tuple(r[k] for k in by), []).append(r[6])
    return {
        k: (len(v), sum(x is not None for x in v), round(sum(x or 0 for x in v), 6), round(sum((x or 0) ** 2 for x in v), 6)) for k, v in out.items()
    }


def test_history_log(spark, tmp_path):
    rng, log = random.Random(2), history_log.HistoryLog(spark, str(tmp_path / "log"))
    seen, known = [], 0
    event = lambda: ("2024-01-01", rng.randrange(3), rng.choice([10, None, 30]), rng.choice(["ARRIVAL", "DEPARTURE"]), rng.randrange(8))
    schema = history_log.REPORT.replace("d date", "d string")
    assert log.versions() == [] and log.reports().count() == 0
    for size in (40, 25, 0, 1):
        batch = []
        for _ in range(size):
            known += 1
            batch.append((*event(), None, rng.choice([None, 1.25, -3.5, 100.0]), known if rng.random() < 0.8 else known - 30))
        batch = [b for i, b in enumerate(batch) if not any(x[:5] == b[:5] and x[7] == b[7] for x in batch[:i] + seen)]
        seen += batch
        version = log.append(spark.createDataFrame(batch, schema))
        for name, by in (("stations", [2]), ("services", [1, 3])):
            got = log.summary(name, version).collect()
            keys = history_log.SUMMARIES[name]
            assert {tuple(r[k] for k in keys): (r.events, r.reported, round((r.mean_delay or 0) * r.reported, 6), round(r.squares or 0, 6)) for r in got} == recomputed(seen, by)
    assert log.versions() == [1, 2, 3, 4]
    assert {r.version for r in log.reports(2).collect()} <= {1, 2} and log.summary("stations", 0).count() == 0
    # One report changes one station and one service, whatever the log holds.
    change = spark.read.parquet(str(tmp_path / "log" / "versions" / "v00000004" / "stations"))
    assert change.count() <= 1
    with pytest.raises(ValueError, match="no version"):
        log.reports(9)


def test_history_log_commits_whole_versions(spark, tmp_path, monkeypatch):
    """What a writer that died left behind is not read, and of two writers of a version one is refused."""
    log = history_log.HistoryLog(spark, str(tmp_path / "log"))
    one = spark.createDataFrame([("2024-01-01", 1, 10, "ARRIVAL", 5, None, 2.0, 1)], history_log.REPORT.replace("d date", "d string"))
    log.append(one)
    one.write.parquet(str(tmp_path / "log" / "staging" / "dead" / "reports"))
    assert log.reports().count() == 1 and log.versions() == [1]
    other = history_log.HistoryLog(spark, str(tmp_path / "log"))
    monkeypatch.setattr(other, "versions", lambda: [])
    with pytest.raises(ValueError, match="written by another"):
        other.append(one)
    assert log.versions() == [1] and log.reports().count() == 1
