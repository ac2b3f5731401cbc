"""Temporal joins: ranges, as-of, and what later events resolve.

Spark plans a pure range join as a nested loop. Here a range becomes an equi-join on time buckets as wide as the
range, so a query meets two buckets, with the exact condition as residue; big keys split by time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.clock import MINUTE


def in_window(left: DataFrame, right: DataFrame, keys: list[str], clock: str, low: Column, high: Column, width: int, how: str = "inner") -> DataFrame:
    """Pairs with equal keys and low <= right.clock < high; low and high are columns of left, at most width microseconds apart.

    Other columns of the two sides have different names. Keys are taken from the left.
    """
    span = F.sequence(F.floor(low / F.lit(width)), F.floor((high - 1) / F.lit(width)))
    a = left.withColumn("_low", low).withColumn("_high", high).where("_low < _high").withColumn("_bucket", F.explode(span))
    b = right.withColumn("_bucket", F.floor(F.col(clock) / F.lit(width)))
    out = a.join(b, [*keys, "_bucket"], how).where((F.col(clock) >= F.col("_low")) & (F.col(clock) < F.col("_high")))
    return out.drop("_bucket", "_low", "_high")


def as_of(queries: DataFrame, facts: DataFrame, keys: list[str], at: str, clock: str, values: list[str], tolerance: int) -> DataFrame:
    """Of each query the last fact with at - tolerance <= clock < at, strictly before; the facts' columns are null if there is none.

    Both sides go through one sorted pass by key: a union and a running last value, no pair is made. Keys with a long
    history are split by time: facts are repeated in the next slice, so a slice is all that a query needs.
    """
    width = max(1, 4 * tolerance)
    q = queries.select(
        *keys, F.col(at).alias("_t"), F.floor(F.col(at) / F.lit(width)).alias("_slice"), F.lit(0).alias("_side"),
        F.struct(*queries.columns).alias("_q"),
        F.lit(None).cast(facts.select(F.struct(clock, *values).alias("v")).schema["v"].dataType).alias("_v")
    )
    f = facts.where(F.col(clock).isNotNull()).withColumn("_here", F.floor(F.col(clock) / F.lit(width)))
    f = f.withColumn("_slice", F.explode(F.array(F.col("_here"), F.col("_here") + 1)))
    f = f.select(
        *keys, F.col(clock).alias("_t"), "_slice", F.lit(1).alias("_side"), F.lit(None).cast(q.schema["_q"].dataType).alias("_q"),
        F.struct(clock, *values).alias("_v")
    )
    # At one time queries come first, so a fact at that very time is not seen.
    w = W.partitionBy(*keys, "_slice").orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, 0)
    out = q.unionByName(f).withColumn("_last", F.last("_v", ignorenulls=True).over(w)).where("_side = 0")
    fresh = F.col("_last")[clock] >= F.col("_t") - F.lit(tolerance)
    return out.select("_q.*", *(F.when(fresh, F.col("_last")[c]).alias(c) for c in (clock, *values)))


def buckets(df: DataFrame, clock: str, minutes: int) -> Column:
    return F.floor(F.col(clock) / F.lit(minutes * MINUTE))
