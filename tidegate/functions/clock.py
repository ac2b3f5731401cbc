"""Clocks. Inside the engine every time is a BIGINT of microseconds since 1970 (UTC); null means unknown."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MINUTE = 60_000_000
HOUR, DAY = 60 * MINUTE, 1440 * MINUTE


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds of a column that holds a timestamp (with or without zone), a date, or an ISO-8601 string; unparsable: null."""
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), c)
    if isinstance(kind, T.StringType):
        c = F.try_to_timestamp(c)
    elif isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long") * F.lit(DAY)
    return F.unix_micros(c)


def minutes(later: Column, earlier: Column) -> Column:
    return (later - earlier) / F.lit(float(MINUTE))


def number(c: Column) -> Column:
    """A double in which NaN and infinities are null: comparisons with what is missing are never true."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def yes(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))
