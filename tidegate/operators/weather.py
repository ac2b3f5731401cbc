"""Sensor series: as-of values and rolling summaries before a lagged deadline."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clock import HOUR, MINUTE, minutes
from .temporal import as_of

# Summaries as (parameter, hours, statistic).
ROLLING = [
    ("t2m", 6, "mean"), ("t2m", 6, "min"), ("t2m", 6, "max"), ("t2m", 24, "min"), ("t2m", 24, "max"), ("ws_10min", 6, "max"),
    ("wg_10min", 6, "max"), ("r_1h", 6, "sum"), ("r_1h", 24, "sum"), ("snow_aws", 24, "change")
]
NOT_NEGATIVE = ["snow_aws", "r_1h", "ws_10min", "wg_10min", "vis"]
LAG, STALE, COVERAGE = 60, 120, 0.75


def clean(series: DataFrame, rain: str = "r_1h", not_negative: list[str] = NOT_NEGATIVE) -> DataFrame:
    """(parameter, t, value): -1 of the rain sensor is none; other negative amounts are unknown; unknown values go."""
    v = F.when((F.col("parameter") == rain) & (F.col("value") == -1), F.lit(0.0)).when(
        F.col("parameter").isin(not_negative) & (F.col("value") < 0), F.lit(None)
    ).otherwise(F.col("value").cast("double"))
    return series.select("parameter", "t", v.alias("value")).where(
        "value is not null and not isnan(value) and abs(value) < double('Infinity')"
    ).dropDuplicates(["parameter", "t"])


def deadlines(q: DataFrame, lag: int = LAG) -> DataFrame:
    return q.withColumn("deadline", F.col("cut") - F.lit(lag * MINUTE))


def latest(q: DataFrame, series: DataFrame, parameters: list[str], stale: int = STALE, lag: int = LAG) -> DataFrame:
    """(qid, parameter, value, age_minutes): the last value strictly before the deadline, at most stale minutes old; null if none."""
    asked = deadlines(q, lag).select("qid", "deadline", F.explode(F.array(*map(F.lit, parameters))).alias("parameter"))
    out = as_of(asked, series, ["parameter"], "deadline", "t", ["value"], stale * MINUTE)
    return out.select(
        "qid", "parameter", "value", (minutes(F.col("deadline"), F.col("t")) + F.lit(float(lag + 30))).alias("age_minutes"),
        F.col("t").alias("used")
    )


def extremes(values: np.ndarray, low: np.ndarray, high: np.ndarray, pick) -> np.ndarray:
    """The least or greatest value of each range [low, high), none empty: two overlapping spans of a power of two cover it."""
    k = np.frexp(high - low)[1] - 1
    out, level = np.empty(len(low)), values
    for now in range(int(k.max(initial=-1)) + 1):
        if now:  # spans twice as long; shorter ones are not needed any more
            half = 1 << now - 1
            level = pick(level[:-half], level[half:])
        at = np.flatnonzero(k == now)
        out[at] = pick(level[low[at]], level[high[at] - (1 << now)])
    return out


def windows_of(t: np.ndarray, value: np.ndarray, at: np.ndarray, width: int) -> dict[str, np.ndarray]:
    """Count, extremes, sum, change and last time of the values (in order of t) in [at - width, at), of those that have any."""
    low, high = np.searchsorted(t, at - width), np.searchsorted(t, at)
    some = np.flatnonzero(high > low)
    low, high = low[some], high[some]
    # Running sums of whole 2**-20ths, which are exact, and of what is left, so that a window's sum is the same wherever the slice begins.
    unit = float(1 << 20)
    small = len(value) * np.abs(value).max(initial=0) < 1 << 42
    whole = np.floor(value * unit).astype(np.int64) if small else np.zeros(len(value), np.int64)
    steps, sums = (np.concatenate([[0], np.cumsum(x, dtype=x.dtype)]) for x in (whole, (value - whole / unit).astype(np.longdouble)))
    total = ((steps[high] - steps[low]) / np.longdouble(unit) + (sums[high] - sums[low])).astype(float)
    return {
        "at": some, "n": high - low, "min": extremes(value, low, high, np.minimum), "max": extremes(value, low, high, np.maximum),
        "sum": total, "mean": total / (high - low), "change": value[high - 1] - value[low], "used": t[high - 1]
    }


def rolling(q: DataFrame, series: DataFrame, parameters: list[str], hours: tuple = (6, 24), stale: int = STALE, lag: int = LAG) -> DataFrame:
    """(qid, parameter, hours, n, mean, min, max, sum, change): of values in [deadline - hours, deadline).

    Summaries are null unless three quarters of the hours are covered and the last value is fresh; n always counts.
    Queries and values meet by parameter in slices of time, values in the slice after theirs too, as in as_of(). Inside a
    slice running sums and ranges of powers of two answer each query in a few steps, however dense the values are: a frame
    of Spark's would be gone over again for every row. Slices are as long as the longest window, the shortest that have values in two
    slices only, so a task holds the queries of one window and the values of two.
    """
    import pyarrow as pa

    width = max(hours) * HOUR
    asked = deadlines(q, lag).select(
        F.col("qid").cast("long").alias("qid"), F.col("deadline").alias("t"), F.explode(F.array(*map(F.lit, parameters))).alias("parameter")
    )
    asked = asked.select(
        "parameter", F.floor(F.col("t") / F.lit(width)).alias("slice"), "t", "qid", F.lit(True).alias("asks"),
        F.lit(None).cast("double").alias("value")
    )
    here = F.floor(F.col("t") / F.lit(width))
    known = series.where(F.col("parameter").isin(parameters) & F.col("value").isNotNull())
    known = known.select(
        "parameter", F.explode(F.array(here, here + 1)).alias("slice"), "t", F.lit(None).cast("long").alias("qid"),
        F.lit(False).alias("asks"), F.col("value").cast("double").alias("value")
    )

    def summaries(key, table):
        t, asks = table["t"].to_numpy(), table["asks"].to_numpy(zero_copy_only=False)
        value, ids, at = table["value"].to_numpy(), table["qid"].filter(table["asks"]).to_numpy(), t[asks]
        order = np.argsort(t[~asks], kind="stable")
        facts, value = t[~asks][order], value[~asks][order]
        parts = []
        for h in hours:
            found = windows_of(facts, value, at, h * HOUR)
            n = np.zeros(len(at), np.int64)
            n[found["at"]] = found["n"]
            cols = {
                "qid": pa.array(ids), "parameter": pa.repeat(key[0], len(at)),
                "hours": pa.array(np.full(len(at), h, np.int32)), "n": pa.array(n)
            }
            for name in ("mean", "min", "max", "sum", "change", "used"):
                one = found.pop(name)
                full = np.zeros(len(at), one.dtype)
                full[found["at"]] = one
                cols[name] = pa.array(full, mask=n == 0)
            parts.append(pa.table(cols | {"deadline": pa.array(at)}))
        return pa.concat_tables(parts)

    schema = "qid long, parameter string, hours int, n long, mean double, min double, max double, sum double, change double, used long, deadline long"
    rows = asked.unionByName(known).groupBy("parameter", "slice").applyInArrow(summaries, schema)
    ok = (F.col("n") >= F.ceil(F.col("hours") * F.lit(COVERAGE))) & (F.col("used") >= F.col("deadline") - F.lit(stale * MINUTE))
    return rows.select("qid", "parameter", "hours", "n", *(F.when(ok, F.col(c)).alias(c) for c in ("mean", "min", "max", "sum", "change")), "used")


def wide(q: DataFrame, now: DataFrame, past: DataFrame, parameters: list[str], prefix: str = "fmi") -> DataFrame:
    """One row for each query: values, ages, the fixed summaries and counts, freezing rain, wind components."""
    pick = lambda p, c: F.max(F.when(F.col("parameter") == p, F.col(c)))
    a = now.groupBy("qid").agg(
        *(pick(p, "value").alias(f"{prefix}_{p}") for p in parameters),
        *(pick(p, "age_minutes").alias(f"{prefix}_{p}_age_minutes") for p in parameters)
    )
    at = lambda p, h, c: F.max(F.when((F.col("parameter") == p) & (F.col("hours") == h), F.col(c)))
    b = past.groupBy("qid").agg(
        *(at(p, h, s).alias(f"{prefix}_{p}_{h}h_{s}") for p, h, s in ROLLING),
        *(at(p, h, "n").alias(f"{prefix}_{p}_{h}h_count") for p, h in dict.fromkeys((p, h) for p, h, _ in ROLLING))
    )
    out = q.select("qid").join(a, "qid", "left").join(b, "qid", "left")
    c = lambda p: F.col(f"{prefix}_{p}")
    east = -c("ws_10min") * F.sin(F.radians(c("wd_10min")))
    north = -c("ws_10min") * F.cos(F.radians(c("wd_10min")))
    frozen = F.when(c("r_1h").isNotNull() & c("t2m").isNotNull(), F.when(c("t2m") <= 1, c("r_1h")).otherwise(0.0))
    return out.select("*", frozen.alias(f"{prefix}_freezing_precipitation"), east.alias(f"{prefix}_wind_east"), north.alias(f"{prefix}_wind_north"))


def coverage(series: DataFrame) -> DataFrame:
    """Rows and known values by month and parameter."""
    month = F.date_format(F.date_from_unix_date(F.floor(F.col("t") / F.lit(24 * HOUR)).cast("int")), "yyyy-MM")
    return series.groupBy(month.alias("month"), "parameter").agg(F.count("*").alias("rows"), F.count("value").alias("known"))


def enough(hours: int) -> int:
    return math.ceil(hours * COVERAGE)
