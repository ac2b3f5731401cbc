"""Ingest: validity, deterministic deduplication, orders, month files and the runs of the month before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.clock import MINUTE
from .feed import RUN

#: Rows of a task that keeps a table of them.
TASK_ROWS = 1_250_000
MONTH_FILE = r"matched_data_flat_(\d{4})_(\d{2})\.parquet$"


def valid_rows(df: DataFrame, times: list[str], label: str) -> DataFrame:
    """Rows whose times (micros) are known and whose label is a finite number."""
    ok = F.col(label).isNotNull() & ~F.isnan(label) & (F.abs(label) < F.lit(float("inf")))
    for t in times:
        ok = ok & F.col(t).isNotNull()
    return df.where(ok)


def dedup(df: DataFrame, columns: list[str], order: str, keep: str = "first") -> DataFrame:
    """One row for each combination of columns, nulls being equal: the first or last by order."""
    by = W.partitionBy(*columns).orderBy(F.col(order).asc() if keep == "first" else F.col(order).desc())
    return df.withColumn("_rn", F.row_number().over(by)).where("_rn = 1").drop("_rn")


def duplicates(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """The rows that dedup(keep="first") drops, for audit."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*columns).orderBy(order))).where("_rn > 1").drop("_rn")


def conflicts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys with more than one different value; a missing value is one too.

    Rows go by key to tasks of about TASK_ROWS, as keys are hardly ever equal: adding up before the shuffle would hold a table of all
    that a task reads, and merged small partitions one of all that fits into them.
    """
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // TASK_ROWS))
    v = F.count_distinct(value) + F.max(F.col(value).isNull().cast("int"))
    return df.select(*keys, value).repartition(n, *keys).groupBy(*keys).agg(v.alias("values")).where("values > 1")


def row_ids(df: DataFrame, order: list[str], name: str = "row_id") -> DataFrame:
    """df with 0, 1, ... in total order, without sorting all rows in one task.

    Ranges of the first order column, cut at its quantiles, are numbered apart and moved by the rows before them. The cuts
    are values, so a recomputed task finds the same ranges. Nulls come first.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = df.agg(
        F.percentile_approx(order[0], F.array(*(F.lit((k + 1) / n) for k in range(n - 1))) if n > 1 else F.array(F.lit(0.5)), F.lit(1000))
    ).first()[0] or []
    bounds = F.array(*map(F.lit, sorted(set(cuts)))) if cuts else None
    part = F.when(F.col(order[0]).isNull(), F.lit(-1)).otherwise(F.size(F.filter(bounds, lambda x: x < F.col(order[0])))) if cuts else F.lit(0)
    parts = df.withColumn("_part", part)
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    base = sizes.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inside = parts.withColumn("_in", F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1)
    return inside.join(base, "_part").withColumn(name, (F.col("_base") + F.col("_in")).cast("long")).drop("_part", "_base", "_in")


def first_appearance(df: DataFrame, group: str, key: str, order: str) -> DataFrame:
    """df with first_ord, where key first appears in its group; rows stand by group, first_ord, order."""
    return df.withColumn("first_ord", F.min(order).over(W.partitionBy(group, key)))


def month_files(spark: SparkSession, directory: str, first: int, last: int, expected: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """The monthly archives of some years, with source_file; fails if their number is not as expected. Columns prune the scan."""
    df = spark.read.option("pathGlobFilter", "matched_data_flat_*.parquet").parquet(directory)
    if columns:
        df = df.select(*columns, "_metadata")
    df = df.withColumn("source_file", F.col("_metadata.file_name")).drop("_metadata") if "_metadata" in df.columns else df.select(
        "*", F.col("_metadata.file_name").alias("source_file")
    )
    df = df.where(F.regexp_extract("source_file", MONTH_FILE, 1).try_cast("int").between(first, last))
    if expected is not None and (found := df.select("source_file").distinct().count()) != expected:
        raise ValueError(f"expected {expected} months, found {found}")
    return df


def previous_source(name: str) -> tuple[str, str]:
    """The month file before this one, and this one's first day."""
    import re

    m = re.fullmatch("(.*)" + MONTH_FILE, name)
    if not m or m[1]:
        raise ValueError(f"not a monthly source: {name}")
    y, k = int(m[2]), int(m[3])
    py, pk = (y, k - 1) if k > 1 else (y - 1, 12)
    return f"matched_data_flat_{py:04d}_{pk:02d}.parquet", f"{y:04d}-{k:02d}-01"


def append_prior_runs(plan: DataFrame, prior: DataFrame, month_start: str, lookback: int = 720) -> DataFrame:
    """plan with whole runs of the month before that it lacks and that end late enough to matter.

    A run that the plan has is never filled from the older file. The bound is the plan's least schedule less lookback minutes.
    """
    old = prior.where(F.col("d") < F.lit(month_start).cast("date")).join(plan.select(*RUN).distinct(), RUN, "left_anti")
    least = plan.agg(F.min("s")).first()[0]
    ends = old.groupBy(*RUN).agg(F.max("s").alias("_end")).where(F.col("_end") >= F.lit(least) - F.lit(lookback * MINUTE)).select(*RUN)
    return plan.unionByName(old.join(ends, RUN, "left_semi"))


def bounded_scan(reports: DataFrame, bound_us: int) -> DataFrame:
    """Reports that happened before the bound: a literal, so that the scan prunes."""
    return reports.where(F.col("act") < F.lit(bound_us))
