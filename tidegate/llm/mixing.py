"""Mixing sources to target weights, in DataFrame functions only.

Every row has a hash-random key. Within each source the rows stand in key order: key ranges (prefixes of
the key) are sorted and summed apart, the ranges' sums are summed before them, and so every row knows
the words before it. A source takes whole epochs while its budget allows and is cut at the exact word.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WS, stored

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
#: Rows that one key range holds on average, at most.
RANGE_ROWS = 20_000


def sized(docs: DataFrame) -> DataFrame:
    """What the mix needs of each row: id, source, words, key, hash of the text."""
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.regexp_count(t, F.lit(WS.replace("[", "[^"))).cast("long").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("key"),
        F.xxhash64(t).alias("h"),
    )


def targets(sources: DataFrame) -> DataFrame:
    """sources: (source, source_size). Adds target, by filling at the weights' level up to each cap.

    Only one row for each source is sorted here.
    """
    by = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.get(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(by) - 1) % len(WEIGHTS))
    s = sources.withColumn("w", weight.cast("double")).withColumn(
        "cap", (MOST * F.col("source_size")).cast("double")
    ).withColumn("r", F.col("cap") / F.col("w"))
    up = W.orderBy("r", F.col("source").asc_nulls_last())
    budget = F.lit(SHARE) * F.sum("source_size").over(W.partitionBy())
    s = s.withColumn(
        "level",
        (
            budget - F.coalesce(F.sum("cap").over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
        ) / F.sum("w").over(up.rowsBetween(0, W.unboundedFollowing))
    )
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("r"), F.struct("r", "level"))).over(W.partitionBy())["level"])
    return s.select("source", "source_size", F.least("cap", F.col("level") * F.col("w")).alias("target"))


def taken(rows: DataFrame) -> DataFrame:
    """rows of sized() with source_size, target and taken."""
    totals = stored(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")))
    most = totals.agg(F.max("n")).first()[0] or 0
    digits = max(1, math.ceil(math.log(max(1, most / RANGE_ROWS), 16)) + 1)
    rows = rows.withColumn("range", F.substring("key", 1, digits)).withColumn("s", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    ranges = rows.groupBy("s", "range").agg(F.sum("size").alias("sum"))
    ranges = ranges.select(
        "s", "range",
        F.coalesce(F.sum("sum").over(W.partitionBy("s").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before")
    )
    goal = targets(totals.drop("n")).withColumn("s", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).drop("source")
    inside = F.coalesce(F.sum("size").over(W.partitionBy("s", "range").orderBy("key", "size", "h").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    out = rows.withColumn("inside", inside).join(ranges, ["s", "range"]).join(goal, "s")
    goal_words = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(goal_words / F.greatest("source_size", F.lit(1)))).otherwise(F.lit(0))
    rest = goal_words - epochs * F.col("source_size") - F.col("before") - F.col("inside")
    return out.select(
        "doc_id", "source", "h", "size", "source_size", "target",
        (epochs * F.col("size") + F.greatest(F.lit(0), F.least(rest, F.col("size")))).cast("long").alias("taken")
    )


def mix_plan(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row.

    A null text has size 0 and takes nothing; a null source is a source of its own, the last one; rows
    with one id stand in order of size and text; an empty table gives no row. Other columns are ignored.
    """
    return taken(stored(sized(docs))).select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame) -> DataFrame:
    """docs as mixed: a row for each whole copy, then one with the first words of a copy that is cut.

    The columns are docs' own. A cut copy ends after its last word and is otherwise as it was, white space too. Rows with
    equal id and text share what they take alike. Rows that take nothing go, so null and blank texts do.
    """
    names = docs.columns
    plan = taken(stored(sized(docs))).groupBy(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_k"), F.col("h").alias("_h")
    ).agg(F.floor(F.sum("taken") / F.count("*")).alias("_taken"), F.max("size").alias("_size")).where("_taken > 0")
    own = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"),
        F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).alias("_k"),
        F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("_h")
    )
    rows = own.join(plan, ["_k", "_h"]).withColumn("_part", F.explode(F.sequence(F.lit(1).cast("bigint"), F.ceil(F.col("_taken") / F.col("_size")))))
    left = F.col("_taken") - (F.col("_part") - 1) * F.col("_size")
    whole = F.col("_row")["text"].cast("string")
    words = F.regexp_extract_all(whole, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), 1)
    text = F.when(left >= F.col("_size"), whole).otherwise(F.array_join(F.slice(words, F.lit(1), F.greatest(left, F.lit(0)).cast("int")), ""))
    put = {"text": text} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in names else {})
    return rows.select(*((put[c] if c in put else F.col("_row").getField(c)).alias(c) for c in names))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS w,
         CAST(2 * source_size AS DOUBLE) AS cap FROM totals),
levels AS (
  SELECT *, cap / w AS r, (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
goals AS (SELECT source, source_size, least(cap, w * (SELECT level FROM levels WHERE level <= r ORDER BY r, level LIMIT 1)) AS target FROM levels),
placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sized),
epochs AS (
  SELECT p.doc_id, p.size, g.source_size, g.target, p.before,
         CASE WHEN g.source_size > 0 THEN floor(floor(g.target) / g.source_size) ELSE 0 END AS n
  FROM placed p JOIN goals g ON p.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(n * size + greatest(0, least(floor(target) - n * source_size - before, size)) AS BIGINT) AS taken FROM epochs
"""
