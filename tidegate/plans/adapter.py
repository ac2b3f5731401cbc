"""The test tables in the engine's terms: events as a feed of runs, or as sensor series; line items as study rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clock import MINUTE, micros

STATIONS = {"click": 100, "view": 200, "signup": 300, "purchase": 370, "error": 400}
SENSORS = {"view": "t2m", "click": "ws_10min", "signup": "wd_10min", "purchase": "r_1h", "error": "snow_aws"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chosen(column: str, values: dict):
    out = F
    for k, v in values.items():
        out = out.when(F.col(column) == k, F.lit(v))
    return out.otherwise(F.lit(None))


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    k, m, i, n = F.get_json_object("props", "$.k").cast("long"), (F.floor(F.col("value") / 4) - 3).cast("long"), F.col("event_id"), F.col("user_id") % 25
    e = e.withColumn("_s", micros(e, "ts"))
    s = F.col("_s")
    return e.select(
        F.to_date("ts").alias("d"), n.alias("n"), chosen("event_type", STATIONS).alias("st"),
        F.when(i % 2 == 0, "ARRIVAL").otherwise("DEPARTURE").alias("ty"), s.alias("s"),
        (s - F.lit(30 * MINUTE) * k).alias("acc"), F.when(k % 10 != 0, s + m * F.lit(MINUTE)).alias("act"),
        F.when(i % 17 != 0, m.cast("double")).alias("delay"), i.alias("ord"),
        F.when(n % 3 != 0, "Long-distance").otherwise("Freight").alias("cat"), (i % 5 != 0).alias("stopping"), (i % 7 != 0).alias("commercial"),
        F.get(F.array(*map(F.lit, ("IC", "S", "P", "MV"))), (n % 4).cast("int")).alias("train_type"),
        F.when(k % 7 == 0, "ADHOC").otherwise("REGULAR").alias("table_type"),
        F.when(i % 3 == 0, s + (k - 60) * F.lit(MINUTE)).alias("ready"),
    )


def queries_at_home(f: DataFrame) -> DataFrame:
    from ..operators.feed import KEY, asked

    return asked(f.where("st = 370").select("ord", *KEY), "ord")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    v = F.when(F.col("event_type") == "view", F.col("value") - 10).when(
        (F.col("event_type") == "purchase") & (F.col("event_id") % 11 == 0), -1.0
    ).when((F.col("event_type") == "error") & (F.col("event_id") % 13 == 0), -5.0).otherwise(F.col("value"))
    return e.select(chosen("event_type", SENSORS).alias("parameter"), micros(e, "ts").alias("t"), v.alias("value"))


def study_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items read as weather rows."""
    l = read(spark, sf_dir, "lineitem")  # noqa: E741
    q, p, d, t = F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    return l.select(
        "l_orderkey", "l_linenumber", micros(l, "l_shipdate").alias("us"), (q - 25).alias("Air temperature"),
        (d * 100).alias("Precipitation amount"), (t * 60).alias("Precipitation intensity"), (p % 20).alias("Wind speed"),
        (p % 27).alias("Gust speed"),
        (q + 50).alias("Relative humidity"), (q - 25 + d * 30 - 1).alias("Dew-point temperature"),
        F.when(F.col("l_linenumber") % 3 != 0, t * 10).alias("Snow depth"), (p % 2000).alias("Horizontal visibility"),
        F.col("l_suppkey").alias("trainNumber"), (F.col("l_returnflag") == "N").alias("trainStopping"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as predictions in time order: y, two predictions p and b, day, row_id, cut, label time."""
    o = read(spark, sf_dir, "orders")
    o = o.withColumn("t", micros(o, "o_orderdate"))
    y = F.col("o_totalprice") % 97 - 40
    return o.select(
        "o_orderkey", "t", y.alias("y"), (y * 0.8 + F.col("o_custkey") % 7 - 3).alias("p"),
        (y * 0.6 + F.col("o_custkey") % 11 - 4).alias("b"), F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"), "o_custkey"
    )
