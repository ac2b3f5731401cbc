"""The latest clocks of everything that a query's features used, and how much that was.

Each family gives (qid, latest_act, latest_acc, ...) by its own rules of what it may use; all of it is strictly before the
cut. plans.policy checks these stamps, so a family whose builder saw too much is found out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sweep
from .feed import HOME
from .origin import decisions, inbound
from .route import WINDOWS, home_origin, own_route, route_stations
from .station import shown
from .turnaround import at_ends, reported, terminating


def uses(df: DataFrame, act=None, acc=None, ready=None) -> DataFrame:
    """(qid, act, acc, ready) of what rows stand for; nothing: null."""
    none = F.lit(None).cast("long")
    pick = lambda c: none if c is None else F.col(c) if isinstance(c, str) else c
    return df.select("qid", pick(act).alias("act"), pick(acc).alias("acc"), pick(ready).alias("ready"))


def latest(q: DataFrame, parts: list[DataFrame], columns: tuple = ("act", "acc")) -> DataFrame:
    """(qid, latest_*, used_*) over all parts; maxima and counts combine before the shuffle."""
    rows = reduce(DataFrame.unionByName, parts)
    g = rows.groupBy("qid").agg(*(F.max(c).alias(f"latest_{c}") for c in columns), *(F.count(c).alias(f"used_{c}") for c in columns))
    out = q.select("qid").join(g, "qid", "left")
    return out.select("qid", *(f"latest_{c}" for c in columns), *(F.coalesce(f"used_{c}", F.lit(0)).alias(f"used_{c}") for c in columns))


def network(q: DataFrame, feed: DataFrame, windows: tuple = WINDOWS) -> DataFrame:
    """Of the route's own accepted plan and reports, and of the events at its stations."""
    at, longest = route_stations(q, feed), max(windows)

    def route(own, run, cut, s):
        reached, done = sweep.Timeline(run.reached), sweep.Timeline(run.done)
        act, acc = done.latest(run.act, cut), reached.latest(run.acc, cut)
        known = lambda x: (x, x > sweep.NONE)
        return {"qid": own["qid"], "act": known(act), "acc": known(acc), "used_act": done.count(cut), "used_acc": reached.count(cut)}

    own = sweep.by_run(q, feed, {c: "long" for c in ("qid", *STAMP)}, route)
    rows = shown(at, feed, ["qid", "context"], "station", (longest,), clocks=True)
    return stamped(
        q, [
            own, stamp(rows, "told_act", "told_acc", "told", "told"), stamp(rows, "old_act", "old_acc", "old", "old"),
            stamp(rows, None, "wait_acc", None, F.col("pending") + F.col("resolved")), stamp(rows, "by_act", "by_acc", "resolved", "resolved")
        ]
    )


STAMP = ("act", "acc", "used_act", "used_acc")


def stamp(rows: DataFrame, *columns) -> DataFrame:
    """(qid, STAMP) of rows that stand for many: their latest clocks and how many had one."""
    pick = lambda c: F.lit(None).cast("long") if c is None else F.col(c) if isinstance(c, str) else c
    return rows.select("qid", *(pick(c).alias(name) for c, name in zip(columns, STAMP)))


def stamped(q: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """latest() of such rows."""
    g = reduce(DataFrame.unionByName, parts).groupBy("qid").agg(
        *(F.max(c).alias(f"latest_{c}") for c in STAMP[:2]), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in STAMP[2:])
    )
    out = q.select("qid").join(g, "qid", "left")
    return out.select("qid", "latest_act", "latest_acc", *(F.coalesce(c, F.lit(0)).alias(c) for c in STAMP[2:]))


def turnaround(q: DataFrame, feed: DataFrame, home: int = HOME) -> DataFrame:
    """Of the events at home, the runs that end there, and the candidates for the query's own train set."""
    ends = terminating(q, feed, home)
    first = q.join(home_origin(q, feed, home).where("origin_departure = 1").select("qid"), "qid", "left_semi")
    rows, near = shown(q.withColumn("home", F.lit(home)), feed, ["qid"], "home", (180,), clocks=True, home=home), at_ends(q, ends, feed, False)
    return stamped(
        q, [
            stamp(own_route(q, feed), None, "accepted", None, F.lit(1)), stamp(rows, "seen_act", "seen_acc", "seen", "seen"),
            stamp(near, None, "ends_acc", None, "ends"), stamp(near, "recent_act", None, "recent", None),
            stamp(reported(first, ends, feed), "act", "acc", "pairs", "pairs"), stamp(rows, None, "wait_acc", None, F.col("pending") + F.col("resolved")),
            stamp(rows, "by_act", "by_acc", "resolved", "resolved"),
            stamp(near, None, None, "resolved", "resolved")  # their clocks are among those of all at home
        ]
    )


def origin(q: DataFrame, feed: DataFrame) -> DataFrame:
    """Of the query's own route and the runs that end where it begins; used_act counts their reports, used_acc routes."""
    pairs = inbound(q, feed)
    events = feed.where("act is not null").select(F.col("d").alias("o_d"), F.col("n").alias("o_n"), F.col("act").alias("e_act"))
    told = pairs.select("qid", "o_d", "o_n", "cut").join(events, ["o_d", "o_n"]).where("e_act < cut")
    return latest(q, [uses(own_route(q, feed, False), None, "accepted"), uses(pairs, None, "o_accepted"), uses(told, "e_act")])


def readiness(q: DataFrame, feed: DataFrame) -> DataFrame:
    """Of decisions on the query's own run (not on its own event) and on inbound runs; used_acc counts routes with a decision."""
    own = own_route(q, feed, False).select("qid", "d", "n", "st", "ty", "s", "cut", "accepted")
    made = decisions(feed)
    mine = own.join(made, (F.col("d") == F.col("r_d")) & (F.col("n") == F.col("r_n"))).where(
        "r_ready < cut and r_acc < cut and not (r_s = s and r_ty = ty and r_st = st)"
    )
    theirs = inbound(q, feed).withColumnRenamed("o_accepted", "accepted").join(
        made, (F.col("o_d") == F.col("r_d")) & (F.col("o_n") == F.col("r_n"))
    ).where("r_ready < cut and r_acc < cut")
    rows = mine.select("qid", "cut", "accepted", "r_d", "r_n", "r_act", "r_ready").unionByName(
        theirs.select("qid", "cut", "accepted", "r_d", "r_n", "r_act", "r_ready")
    )
    routes = rows.groupBy("qid", "r_d", "r_n").agg(F.max("accepted").alias("accepted"))
    return latest(
        q, [uses(rows, F.when(F.col("r_act") < F.col("cut"), F.col("r_act")), None, "r_ready"), uses(routes, None, "accepted")],
        ("ready", "act", "acc")
    )


def weather(now: DataFrame, past: DataFrame) -> DataFrame:
    """(qid, latest_t, used): the latest measurement that values and summaries used, and how many of them are known."""
    values = now.select("qid", F.when(F.col("value").isNotNull(), F.col("used")).alias("t"), F.col("value").isNotNull().cast("long").alias("n"))
    known = sum((F.col(c).isNotNull().cast("long") for c in ("mean", "min", "max", "sum", "change")), F.lit(0).cast("long"))
    sums = past.select("qid", F.col("used").alias("t"), (known + (F.col("n") > 0).cast("long")).alias("n"))
    return values.unionByName(sums).groupBy("qid").agg(F.max("t").alias("latest_t"), F.sum("n").alias("used"))
