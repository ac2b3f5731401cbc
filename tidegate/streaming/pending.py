"""The engine's notions on streams: knowledge-time watermarks, sliding station context, and pending events as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .timed import run_to_end  # noqa: F401  part of this module's interface


def once(stream: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """Events of a stream without repeats of a key within the watermark; stream has a timestamp column known_at."""
    return stream.withWatermark("known_at", late).dropDuplicatesWithinWatermark(keys)


def station_windows(stream: DataFrame, late: str = "2 hours", width: str = "180 minutes", slide: str = "30 minutes") -> DataFrame:
    """Delays reported at each station in sliding windows of knowledge time; a window is given when it is complete."""
    return stream.withWatermark("known_at", late).groupBy(F.window("known_at", width, slide), "st").agg(
        F.count("delay").alias("n"), F.avg("delay").alias("mean_delay"), F.max("delay").alias("max_delay")
    )


def run_sessions(stream: DataFrame, late: str = "2 hours", gap: str = "90 minutes") -> DataFrame:
    """Reports of a run without a gap as one session, given when it is over: its bounds, events and delays."""
    g = stream.withWatermark("known_at", late).groupBy(F.session_window("known_at", gap).alias("w"), "d", "n")
    return g.agg(F.count("*").alias("events"), F.avg("delay").alias("mean_delay"), F.max("delay").alias("max_delay")).select(
        "d", "n", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "mean_delay", "max_delay"
    )


def reports_within(plan: DataFrame, reports: DataFrame, hours: int = 12) -> DataFrame:
    """Planned events (planned_at) with their reports (known_at) of the next hours: a stream-stream interval join by run and event."""
    a = plan.withWatermark("planned_at", f"{hours} hours").alias("a")
    b = reports.withWatermark("known_at", f"{hours} hours").alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in ("d", "n", "st", "ty", "s")]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return a.join(
        b,
        on & (F.col("b.known_at") >= F.col("a.planned_at")) & (
            F.col("b.known_at") <= F.col("a.planned_at") + F.expr(f"interval {hours} hours")
        ),
        "leftOuter"
    ).select("a.*", "b.delay", "b.known_at")


STATE = "done_until long, open array<long>"
OUT = "d date, n long, pending_count long, oldest_scheduled long, done_until long"


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A planned event opens; a done one closes all events of the run that are scheduled no later."""
    until, open_ = state.get if state.exists else (None, [])
    open_ = set(open_ or [])
    for frame in frames:
        for s, done in zip(frame["s"], frame["done"]):
            s = int(s)
            if done:
                until = s if until is None else max(until, s)
            else:
                open_.add(s)
    open_ = sorted(x for x in open_ if until is None or x > until)
    state.update((until, open_))
    yield pd.DataFrame(
        {
            "d": [key[0]], "n": [key[1]], "pending_count": [len(open_)],
            "oldest_scheduled": pd.array([open_[0] if open_ else None], "Int64"), "done_until": pd.array([until], "Int64")
        }
    )


def pending(stream: DataFrame) -> DataFrame:
    """(d, n, s, done) messages to the run's pending events after each batch (update mode). State is one run's open schedule times."""
    return stream.groupBy("d", "n").applyInPandasWithState(_step, OUT, STATE, "update", GroupStateTimeout.NoTimeout)
