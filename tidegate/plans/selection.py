"""Exact quantiles of many columns and groups without a table of their values.

A few passes count the values of each interval that still holds a wanted rank in a fixed number of bins; the bin with the
rank, cut to its least and greatest value, is the next interval. An interval of one value is the answer. State is a row for
each open interval, whatever the number of rows or of different values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.storage import stored

#: Bins of an interval in one pass.
BINS = 4096


def _bin(v: Column, lo: Column, hi: Column, bins: int, by_size: bool) -> Column:
    """Which of an interval's bins holds v: equal ones, or in turn ones that grow with the distance from its low end.

    Both rise with v, and the ends fall into the first and the last bin, so every pass narrows every interval.
    """
    u = (v / 2 - lo / 2) / (hi / 2 - lo / 2)
    if not by_size:
        return F.floor(u * (bins - 1))
    return F.when(u == 0, 0).otherwise(1 + F.floor(F.greatest(F.lit(0.0), (F.log2(u) + 60) / 60) * (bins - 2)))


def order_statistics(values: DataFrame, ranks: DataFrame, bins: int = BINS) -> DataFrame:
    """(g, c, rank, value) for values (g, c, v) and ranks (g, c, n, ranks, lo, hi): the rank-th least v from 0; stored."""
    start = ("lo", "hi", F.col("lo").alias("low"), F.col("hi").alias("high"))
    state = stored(ranks.select("g", "c", *start, F.lit(0).cast("long").alias("below"), F.array_distinct("ranks").alias("ranks")))
    done, turn = [], 0
    while True:
        done.append(state.where("lo = hi").select("g", "c", F.explode("ranks").alias("rank"), F.col("lo").alias("value")))
        open_ = state.where("lo < hi")
        if open_.isEmpty():
            break
        # After the first pass an interval lies in one bin of it; a value looks at the intervals of its own bin only.
        first = lambda v: _bin(F.col(v), F.col("low"), F.col("high"), bins, False) if turn else F.lit(0)  # noqa: E731, B023
        whole = ["g", "c", "low", "high"]
        intervals = open_.groupBy(*whole, first("lo").cast("long").alias("k")).agg(F.collect_list(F.struct("lo", "hi")).alias("i"))
        intervals = intervals.groupBy(*whole).agg(F.map_from_entries(F.collect_list(F.struct("k", "i"))).alias("m"))
        near = F.try_element_at("m", first("v").cast("long"))
        rows = values.join(intervals, ["g", "c"]).select("g", "c", "v", F.explode(F.filter(near, lambda i: (i.lo <= F.col("v")) & (F.col("v") <= i.hi))).alias("i"))
        at = _bin(F.col("v"), F.col("i.lo"), F.col("i.hi"), bins, bool(turn % 2))
        found = rows.select("g", "c", "v", F.col("i.lo").alias("from"), at.alias("bin")).groupBy("g", "c", "from", "bin").agg(
            F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")
        )
        before = F.sum("n").over(W.partitionBy("g", "c", "from").orderBy("bin").rowsBetween(W.unboundedPreceding, -1))
        found = found.withColumn("before", F.coalesce(before, F.lit(0))).join(open_.select(*whole, F.col("lo").alias("from"), "below", "ranks"), ["g", "c", "from"])
        found = found.select(*whole, "lo", "hi", (F.col("below") + F.col("before")).alias("start"), "n", "ranks")
        inside = F.filter("ranks", lambda r: (r >= F.col("start")) & (r < F.col("start") + F.col("n")))
        state = stored(found.select(*whole, "lo", "hi", F.col("start").alias("below"), inside.alias("ranks")).where(F.size("ranks") > 0))
        turn += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def quantiles(df: DataFrame, by: list[str], columns: list[str], probabilities: list[float], bins: int = BINS) -> DataFrame:
    """by and, for each column, the array of its exact quantiles, interpolated as percentile() does.

    Null, NaN and infinite values are left out; a group without values has null; null groups are groups. Repeated rows count
    each time. An empty table gives no group, or one row of nulls without by.
    """
    each = F.array(*(F.struct(F.lit(k).alias("c"), F.col(c).cast("double").alias("v")) for k, c in enumerate(columns)))
    values = df.select(F.struct(F.lit(0).alias("_"), *by).alias("g"), F.inline(each))
    values = values.where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")))
    sizes = stored(values.groupBy("g", "c").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    places = F.array(*(F.lit(float(p)) * (F.col("n") - 1) for p in probabilities))
    ranks = F.flatten(F.transform(places, lambda x: F.array(F.floor(x), F.ceil(x))))
    found = order_statistics(values, sizes.withColumn("ranks", ranks), bins)
    known = found.groupBy("g", "c").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))
    value = lambda r: F.element_at("at", r)
    mixed = F.transform(
        places, lambda x: F.when(F.floor(x) == F.ceil(x), value(F.floor(x))).otherwise((F.ceil(x) - x) * value(F.floor(x)) + (x - F.floor(x)) * value(F.ceil(x)))
    )
    long = sizes.join(known, ["g", "c"]).select("g", "c", mixed.alias("q"))
    wide = long.groupBy("g").agg(*(F.max(F.when(F.col("c") == k, F.col("q"))).alias(c) for k, c in enumerate(columns)))
    if not by:
        return wide.agg(*(F.max(c).alias(c) for c in columns))
    groups = df.select(F.struct(F.lit(0).alias("_"), *by).alias("g")).distinct()
    return groups.join(wide, "g", "left").select(*(F.col(f"g.{b}").alias(b) for b in by), *columns)
