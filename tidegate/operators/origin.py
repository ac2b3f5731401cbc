"""Runs that end where a query's run begins: what they tell of its start; and readiness decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clock import MINUTE, minutes
from .route import own_route, routes
from .temporal import in_window

WINDOWS = (180, 720)
ALLOWANCE = 30.0


def inbound(q: DataFrame, feed: DataFrame) -> DataFrame:
    """Pairs of a query (route known) and another valid long-distance run that ends, by an arrival, at the query's origin
    720 to 15 minutes before its start, accepted before the cut."""
    own = own_route(q, feed, False).select("qid", "d", "n", "cut", F.col("origin").alias("o_terminus"), "start", F.col("terminus").alias("own_end"))
    ends = routes(feed, False).where("valid and end_type = 'ARRIVAL' and end_cat = 'Long-distance'")
    ends = ends.select(*(F.col(c).alias(f"o_{c}") for c in ("d", "n", "accepted", "origin", "terminus", "finish", "end_act")))
    pairs = in_window(own, ends, ["o_terminus"], "o_finish", F.col("start") - F.lit(720 * MINUTE), F.col("start") - F.lit(15 * MINUTE), 720 * MINUTE)
    same = F.col("o_d").eqNullSafe(F.col("d")) & F.col("o_n").eqNullSafe(F.col("n"))
    return pairs.where(~same & (F.col("o_accepted") < F.col("cut")))


def origin_context(q: DataFrame, feed: DataFrame, windows: tuple = WINDOWS) -> DataFrame:
    """(qid, window, ...) of queries whose own route is known: counts, the closest inbound run, the closest one that comes back the way, extremes."""
    own = own_route(q, feed, False).select("qid", "cut", "start", minutes(F.col("s"), F.col("start")).alias("elapsed_minutes"))
    pairs = inbound(q, feed)
    e = feed.where("act is not null and delay is not null").select(
        F.col("d").alias("o_d"), F.col("n").alias("o_n"), F.col("s").alias("e_s"), F.col("ty").alias("e_ty"), F.col("ord").alias("e_ord"),
        F.col("act").alias("e_act"), F.col("delay").alias("e_delay")
    )
    known = pairs.select("qid", "o_d", "o_n", "cut").join(e, ["o_d", "o_n"]).where("e_act < cut").groupBy("qid", "o_d", "o_n").agg(
        F.max(
            F.struct("e_s", F.when(F.col("e_ty") == "ARRIVAL", 1).otherwise(0).alias("a"), -F.col("e_ord"), "e_delay", "e_act")
        ).alias("k")
    )
    rows = pairs.join(known, ["qid", "o_d", "o_n"], "left")
    ended = F.coalesce(F.col("o_end_act") < F.col("cut"), F.lit(False))
    gap, late = minutes(F.col("start"), F.col("o_finish")), F.when(ended, F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), minutes(F.col("cut"), F.col("o_finish")))
    )
    rows = rows.select(
        "qid", "o_finish", "o_d", "o_n", gap.alias("gap"), late.alias("late"), (~ended).alias("open"),
        F.coalesce(F.col("o_origin") == F.col("own_end"), F.lit(False)).alias("back"), F.col("k")["e_delay"].alias("delay"),
        minutes(F.col("cut"), F.col("k")["e_act"]).alias("age"),
        F.when(F.col("k").isNotNull(), F.greatest(F.lit(0.0), F.col("k")["e_delay"] + F.lit(ALLOWANCE) - gap)).alias("projection"),
        F.when(late > 0, F.greatest(F.lit(0.0), late + F.lit(ALLOWANCE) - gap)).otherwise(0.0).alias("late_projection"),
        F.when(ended, minutes(F.col("cut"), F.col("o_end_act"))).alias("end_age"),
        F.when(ended, minutes(F.col("start"), F.col("o_end_act"))).alias("end_gap"),
        F.explode(F.array(*map(F.lit, windows))).alias("window"),
    ).where("gap <= window")
    # The first of equal finishes counts: the smaller run.
    pick = F.struct(
        "o_finish", -F.datediff("o_d", F.lit("1970-01-01")), -F.col("o_n"), "gap", "delay", "age", "late", "projection", "late_projection",
        "end_age", "end_gap"
    )
    g = rows.groupBy("qid", "window").agg(
        F.count("*").alias("count"), F.count_if("open").alias("unobserved_count"), F.count_if("back").alias("reverse_count"),
        F.max(pick).alias("near"), F.max(F.when(F.col("back"), pick)).alias("rev"), F.avg("delay").alias("mean_last_delay"),
        F.max("delay").alias("max_last_delay"), F.max("projection").alias("max_projected_delay"),
        F.max("late_projection").alias("max_pending_projection")
    )
    grid = own.select("qid", "elapsed_minutes", F.explode(F.array(*map(F.lit, windows))).alias("window"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    near, rev = F.col("near"), F.col("rev")
    return grid.join(g, ["qid", "window"], "left").select(
        "qid", "window", "elapsed_minutes", zero("count"), zero("unobserved_count"), zero("reverse_count"),
        near["gap"].alias("closest_gap_minutes"), near["delay"].alias("closest_last_delay"),
        near["age"].alias("closest_observation_age_minutes"), near["late"].alias("closest_pending_minutes"),
        near["projection"].alias("closest_projected_delay"), near["late_projection"].alias("closest_pending_projection"), "mean_last_delay",
        "max_last_delay", "max_projected_delay", "max_pending_projection",
        rev["gap"].alias("reverse_gap_minutes"), rev["delay"].alias("reverse_last_delay"),
        rev["projection"].alias("reverse_projected_delay"), rev["age"].alias("reverse_observation_age_minutes"),
        rev["late"].alias("reverse_pending_minutes"), rev["end_age"].alias("reverse_end_age_minutes"),
        rev["end_gap"].alias("reverse_end_to_start_minutes"),
    )


def decisions(feed: DataFrame) -> DataFrame:
    """Departures with a readiness decision."""
    return feed.where("ty = 'DEPARTURE' and ready is not null and acc is not null and s is not null").select(
        *(F.col(c).alias(f"r_{c}") for c in ("d", "n", "st", "ty", "s", "acc", "act", "ord", "ready"))
    )


def _took(cut="cut"):
    """Minutes from decision to departure, if that had happened before the cut."""
    return F.when(F.col("r_act") < F.col(cut), minutes(F.col("r_act"), F.col("r_ready")))


def readiness_own(q: DataFrame, feed: DataFrame) -> DataFrame:
    """Decisions on the query's own run (not on its own event) known before the cut; null throughout if there is none."""
    own = own_route(q, feed, False).select("qid", "d", "n", "st", "ty", "s", "cut")
    rows = own.join(decisions(feed), (F.col("d") == F.col("r_d")) & (F.col("n") == F.col("r_n"))).where(
        "r_ready < cut and r_acc < cut and not (r_s = s and r_ty = ty and r_st = st)"
    )
    rows = rows.withColumn("delay", minutes(F.col("r_ready"), F.col("r_s"))).withColumn("took", _took())
    g = rows.groupBy("qid", "cut").agg(
        F.count("*").alias("ready_own_count"), F.max(F.struct("r_ready", -F.col("r_s"), -F.col("r_ord"), "delay", "took")).alias("z"),
        F.max("delay").alias("ready_own_max_delay_minutes"), F.avg("delay").alias("ready_own_mean_delay_minutes"),
        F.avg("took").alias("ready_own_mean_to_actual_minutes"), F.max("took").alias("ready_own_max_to_actual_minutes")
    )
    g = g.select(
        "qid", "ready_own_count", F.col("z")["delay"].alias("ready_own_last_delay_minutes"), "ready_own_max_delay_minutes",
        "ready_own_mean_delay_minutes", minutes(F.col("cut"), F.col("z")["r_ready"]).alias("ready_own_last_age_minutes"),
        F.col("z")["took"].alias("ready_own_last_to_actual_minutes"), "ready_own_mean_to_actual_minutes", "ready_own_max_to_actual_minutes"
    )
    return q.select("qid").join(g, "qid", "left")


def readiness_inbound(q: DataFrame, feed: DataFrame, windows: tuple = WINDOWS) -> DataFrame:
    """(qid, window, ...): the latest decision on each inbound run that has one; windows without one have no row."""
    rows = inbound(q, feed).join(decisions(feed), (F.col("o_d") == F.col("r_d")) & (F.col("o_n") == F.col("r_n"))).where("r_ready < cut and r_acc < cut")
    rows = rows.withColumn("delay", minutes(F.col("r_ready"), F.col("r_s"))).withColumn("took", _took())
    one = rows.groupBy("qid", "cut", "start", "o_d", "o_n", "o_finish").agg(
        F.max(F.struct("r_ready", -F.col("r_s"), -F.col("r_ord"), "delay", "took")).alias("z")
    )
    one = one.select(
        "qid", "o_d", "o_n", minutes(F.col("start"), F.col("o_finish")).alias("gap"), F.col("z")["delay"].alias("delay"),
        F.col("z")["took"].alias("took"), minutes(F.col("cut"), F.col("z")["r_ready"]).alias("age"),
        F.explode(F.array(*map(F.lit, windows))).alias("window")
    ).where("gap <= window")
    g = one.groupBy("qid", "window").agg(
        F.count("*").alias("count"), F.avg("delay").alias("mean_delay_minutes"), F.max("delay").alias("max_delay_minutes"),
        F.min(F.struct("gap", "o_d", "o_n", "delay", "age", "took")).alias("near"), F.avg("took").alias("mean_to_actual_minutes"),
        F.max("took").alias("max_to_actual_minutes")
    )
    near = F.col("near")
    return g.select(
        "qid", "window", "count", "mean_delay_minutes", "max_delay_minutes", near["delay"].alias("closest_delay_minutes"),
        near["age"].alias("closest_age_minutes"), near["took"].alias("closest_to_actual_minutes"), "mean_to_actual_minutes",
        "max_to_actual_minutes"
    )
