"""Feeds and queries.

A feed row is one planned event of a dated run: d (date), n (run number), st (station), ty (ARRIVAL or
DEPARTURE), s (scheduled), acc (plan accepted), act (happened), delay, ord (input order), cat, stopping,
commercial, train_type, table_type, ready. A query asks what was known before cut = s - lag.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.clock import MINUTE, micros, number, yes
from ..functions.encode import schedule_cycles

HOME, LAG = 370, 30
KEY, RUN = ["d", "n", "st", "ty", "s"], ["d", "n"]
#: Column names of archives and of the engine.
NAMES = {"d": "departureDate", "n": "trainNumber", "st": "stationUICCode", "ty": "type"}


def input_order(df: DataFrame, order: str | None):
    """The input order as a column: the given one, or a hash of the row, the same however files are split. Equal rows are interchangeable."""
    if order:
        return F.col(order).cast("long")
    return F.xxhash64(*(F.col(f"`{c}`").cast("string") for c in sorted(df.columns)))


def plan_of(schedules: DataFrame, order: str | None = None) -> DataFrame:
    """Engine columns of a timetable; columns it lacks are null. order: the column with the input order; without one, rows that
    only their place tells apart have an arbitrary but repeatable order."""
    have = set(schedules.columns)
    opt = lambda name, kind: (F.col(name) if name in have else F.lit(None)).cast(kind)
    time = lambda name: micros(schedules, name) if name in have else F.lit(None).cast("long")
    return schedules.select(
        F.col("departureDate").cast("date").alias("d"), F.col("trainNumber").cast("long").alias("n"),
        F.col("stationUICCode").cast("int").alias("st"), F.col("type").alias("ty"),
        time("scheduledTime").alias("s"), time("timetableAcceptanceDate").alias("acc"), input_order(schedules, order).alias("ord"),
        opt("trainCategory", "string").alias("cat"), opt("trainStopping", "boolean").alias("stopping"),
        opt("commercialStop", "boolean").alias("commercial"), opt("trainType", "string").alias("train_type"),
        opt("timetableType", "string").alias("table_type"),
    )


def reports_of(observed: DataFrame, order: str | None = None) -> DataFrame:
    """(key, act, delay, ord) of observations."""
    return observed.select(
        F.col("departureDate").cast("date").alias("d"), F.col("trainNumber").cast("long").alias("n"),
        F.col("stationUICCode").cast("int").alias("st"), F.col("type").alias("ty"),
        micros(observed, "scheduledTime").alias("s"), micros(observed, "actualTime").alias("act"),
        number(F.col("differenceInMinutes")).alias("delay"), input_order(observed, order).alias("ord"),
    )


def one_of(df: DataFrame, keys: list[str], keep: str = "last") -> DataFrame:
    """One row for each key: the first or the last in order of ord; null keys are equal."""
    order = F.col("ord").desc() if keep == "last" else F.col("ord").asc()
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where("_rn = 1").drop("_rn")


def unique_or_fail(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, which fails when it runs if a key repeats."""
    n = F.count(F.lit(1)).over(W.partitionBy(*keys))
    return df.withColumn("_n", n).where(
        F.when(F.col("_n") > 1, F.raise_error(F.lit(f"duplicate key {keys}"))).otherwise(F.lit(True)).cast("boolean")
    ).drop("_n")


def feed_of(plan: DataFrame, reports: DataFrame, keep: str = "last") -> DataFrame:
    """The plan with each event's report, the last (or first) one of a key; a plan that repeats a key fails."""
    seen = one_of(reports, KEY, keep).select(*KEY, "act", "delay")
    return unique_or_fail(plan, KEY).join(seen, KEY, "left")


def asked(rows: DataFrame, qid: str, lag: int = LAG) -> DataFrame:
    """Queries from rows with engine columns: qid, key, cut."""
    return rows.select(F.col(qid).cast("long").alias("qid"), *KEY, (F.col("s") - F.lit(lag * MINUTE)).alias("cut"))


def focal(q: DataFrame, plan: DataFrame) -> DataFrame:
    """q with its own plan row's facts and known: whether that row was accepted before the cut. Facts are null unless known."""
    facts = plan.select(*KEY, F.col("acc").alias("focal_acc"), "stopping", "commercial", "train_type", "table_type")
    out = q.join(facts, KEY, "left").withColumn("known", yes(F.col("focal_acc") < F.col("cut")))
    return out.select(
        *q.columns, "known",
        *(F.when(F.col("known"), F.col(c)).alias(c) for c in ("focal_acc", "stopping", "commercial", "train_type", "table_type"))
    )


def static_features(q: DataFrame, plan: DataFrame) -> DataFrame:
    """Timetable features of the query's own event, all null unless its plan was accepted before the cut."""
    f = focal(q, plan)
    masked = lambda c, name: F.when(F.col("known"), c).alias(name)
    cycles = [
        masked(c, n) for c,
        n in zip(
            schedule_cycles(F.col("s")), ["month_sin", "month_cos", "hour_sin", "hour_cos", "weekday_sin", "weekday_cos", "day_of_month"]
        )
    ]
    flag = lambda c, v, name: masked(F.coalesce((F.col(c) == v).cast("double"), F.lit(0.0)), name)
    return f.select(
        "qid", F.col("known").alias("metadata_known"), masked(F.col("n").cast("double"), "train_number"),
        masked(F.col("stopping").cast("double"), "train_stopping"), masked(F.col("commercial").cast("double"), "commercial_stop"),
        masked((F.col("ty") == "DEPARTURE").cast("double"), "is_departure"), *cycles,
        flag("train_type", "IC", "train_type_ic"), flag("train_type", "S", "train_type_s"), flag("train_type", "P", "train_type_p"),
        flag("train_type", "MV", "train_type_mv"), flag("table_type", "ADHOC", "timetable_adhoc"),
    )


def semi_by_run(df: DataFrame, runs: DataFrame, keep: bool = True) -> DataFrame:
    """Rows of df whose run is (or is not) among runs."""
    return df.join(runs.select(*RUN).distinct(), RUN, "left_semi" if keep else "left_anti")
