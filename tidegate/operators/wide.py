"""Long rows by window as one row for each query, under fixed column names.

Every family's columns are all there whatever the data: a window or subset without rows is null, except counts of
queries whose route is known.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import origin as origin_
from . import turnaround as turnaround_

# Names of summaries, in order.
STATION = ("observed_count", "delay_count", "mean_delay", "max_delay", "last_delay", "pending_count", "resolved_count", "oldest_pending_minutes")
TERMINATING = ("recent_count", "recent_mean_delay", "recent_max_delay", "last_delay", "last_observation_age_minutes", "pending_count", "oldest_pending_minutes")
CANDIDATE = (
    "candidate_count", "candidate_unobserved_count", "candidate_scheduled_gap_minutes", "candidate_last_known_delay",
    "candidate_observation_age_minutes", "candidate_pending_minutes", "candidate_projected_departure_delay",
    "worst_projected_departure_delay"
)
ORIGIN = (
    "count", "unobserved_count", "reverse_count", "closest_gap_minutes", "closest_last_delay", "closest_observation_age_minutes",
    "closest_pending_minutes", "closest_projected_delay", "closest_pending_projection", "max_projected_delay", "max_pending_projection",
    "mean_last_delay", "max_last_delay"
)
REVERSE = {
    "closest_gap_minutes": "reverse_gap_minutes", "closest_last_delay": "reverse_last_delay",
    "closest_projected_delay": "reverse_projected_delay", "closest_observation_age_minutes": "reverse_observation_age_minutes",
    "closest_pending_minutes": "reverse_pending_minutes", "closest_terminal_completion_age_minutes": "reverse_end_age_minutes",
    "closest_terminal_to_planned_departure_minutes": "reverse_end_to_start_minutes"
}
READY_OWN = (
    "count", "last_delay_minutes", "max_delay_minutes", "mean_delay_minutes", "last_age_minutes", "last_to_actual_minutes",
    "mean_to_actual_minutes", "max_to_actual_minutes"
)
READY_ORIGIN = (
    "count", "mean_delay_minutes", "max_delay_minutes", "closest_delay_minutes", "closest_age_minutes", "closest_to_actual_minutes",
    "mean_to_actual_minutes", "max_to_actual_minutes"
)


def turnaround_columns(prefix: str = "home", windows: tuple = turnaround_.WINDOWS) -> list[str]:
    station = [f"{prefix}_context_{kind}_{w}m_{name}" for kind in ("arrival", "departure") for w in windows for name in STATION]
    return station + [f"{prefix}_origin_departure"] + [f"{prefix}_terminating_{x}" for x in TERMINATING] + [f"turnaround_{x}" for x in CANDIDATE]


def origin_columns(windows: tuple = origin_.WINDOWS, reverse: bool = True) -> list[str]:
    out = ["origin_context_route_known", "origin_context_elapsed_minutes"] + [f"origin_context_{w}m_{x}" for w in windows for x in ORIGIN]
    return out + [f"origin_reverse_{w}m_{x}" for w in windows for x in REVERSE] * reverse


def readiness_columns(windows: tuple = origin_.WINDOWS) -> list[str]:
    return [f"ready_own_{x}" for x in READY_OWN] + [f"ready_origin_{w}m_{x}" for w in windows for x in READY_ORIGIN]


def flat(q: DataFrame, long: DataFrame, names: dict[str, tuple]) -> DataFrame:
    """(qid, names): each name is (condition, column) of the one long row that it comes from. One aggregate."""
    g = long.groupBy("qid").agg(*(F.max(F.when(condition, F.col(column))).alias(name) for name, (condition, column) in names.items()))
    return q.select("qid").join(g, "qid", "left")


def turnaround(q: DataFrame, feed: DataFrame, prefix: str = "home", windows: tuple = turnaround_.WINDOWS) -> DataFrame:
    """One row for each query, its columns those of turnaround_columns()."""
    rows = turnaround_.context(q, feed, windows)
    names = {
        f"{prefix}_context_{kind.lower()}_{w}m_{x}": (
            (F.col("kind") == kind) & (F.col("window") == w), x
        ) for kind in ("ARRIVAL", "DEPARTURE") for w in windows for x in STATION
    }
    ends = turnaround_.terminating(q, feed)
    some = turnaround_.candidates(q, ends, feed)
    out = flat(q, rows, names).join(turnaround_.terminating_summary(q, ends, feed), "qid").join(some, "qid")
    renamed = {f"{prefix}_origin_departure": "origin_departure"} | {
        f"{prefix}_terminating_{x}": f"terminating_{x}" for x in TERMINATING
    } | {f"turnaround_{x}": x for x in CANDIDATE}
    return out.select("qid", *(F.col(renamed.get(c, c)).alias(c) for c in turnaround_columns(prefix, windows)))


def origin(q: DataFrame, feed: DataFrame, windows: tuple = origin_.WINDOWS, reverse: bool = True) -> DataFrame:
    """One row for each query, its columns those of origin_columns(); null throughout where the own route is not known."""
    rows = origin_.origin_context(q, feed, windows)
    at = {w: F.col("window") == w for w in windows}
    names = {"origin_context_elapsed_minutes": (F.lit(True), "elapsed_minutes")}
    names |= {f"origin_context_{w}m_{x}": (at[w], x) for w in windows for x in ORIGIN}
    names |= {f"origin_reverse_{w}m_{x}": (at[w], column) for w in windows for x, column in REVERSE.items()}
    known = rows.select("qid").distinct().withColumn("origin_context_route_known", F.lit(1.0))
    return flat(q, rows, names).join(known, "qid", "left").select("qid", *origin_columns(windows, reverse))


def readiness(q: DataFrame, feed: DataFrame, windows: tuple = origin_.WINDOWS) -> DataFrame:
    """One row for each query, its columns those of readiness_columns()."""
    rows = origin_.readiness_inbound(q, feed, windows)
    names = {f"ready_origin_{w}m_{x}": (F.col("window") == w, x) for w in windows for x in READY_ORIGIN}
    return origin_.readiness_own(q, feed).join(flat(q, rows, names), "qid").select("qid", *readiness_columns(windows))


def same_columns(a: DataFrame, names: list[str]) -> DataFrame:
    """a with exactly these columns, in this order; a missing or extra one is an error."""
    if missing := [c for c in names if c not in a.columns]:
        raise ValueError(f"columns missing: {missing}")
    if extra := [c for c in a.columns if c not in names]:
        raise ValueError(f"columns not declared: {extra}")
    return a.select(*names)


def aligned(base: DataFrame, extra: DataFrame, key: str, names: list[str]) -> DataFrame:
    """base with extra's columns for its own keys: keys that extra lacks get nulls, others of extra go. A name that base has is an error."""
    if clash := set(names) & set(base.columns):
        raise ValueError(f"columns are there already: {sorted(clash)}")
    return base.join(same_columns(extra, [key, *names]), key, "left")
