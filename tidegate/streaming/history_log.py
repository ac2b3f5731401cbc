"""An append-only history that later queries may read as of any version, with summaries kept from what each version adds.

A version is a folder: the reports it brought, with the time they became known, and the change they make to the summaries of
stations and services. A report of an event that is already there corrects it: its change takes the old values out and puts
the new ones in, so a late or corrected report touches its own keys only. Versions are written beside the log and moved into it in
one rename, so readers see a whole version or none; two writers of one version cannot both win where a rename is atomic.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: An event of a run, and what a report says about it.
EVENT = ["d", "n", "st", "ty", "s"]
REPORT = "d date, n long, st long, ty string, s long, act long, delay double, known_at long"
SUMMARIES = {"stations": ["st"], "services": ["n", "ty"]}
#: Sums are exact, so that what is taken out is what was put in.
EXACT = "decimal(38,9)"


class HistoryLog:
    """The log at a path; every method sees what is committed when it is called."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        at = self._hadoop(f"{self.path}/versions")
        if not self._fs.exists(at):
            return []
        return sorted(int(f.getPath().getName().removeprefix("v")) for f in self._fs.listStatus(at))

    def _part(self, versions: list[int], name: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/versions/v{k:08d}/{name}" for k in versions]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _chosen(self, version: int | None) -> list[int]:
        known = self.versions()
        if version is not None and version not in known and version != 0:
            raise ValueError(f"no version {version}")
        return known if version is None else [k for k in known if k <= version]

    def reports(self, version: int | None = None) -> DataFrame:
        """The last report of each event as of a version (0: before the first), by the time it became known, then by version."""
        last = W.partitionBy(*EVENT).orderBy(F.desc("known_at"), F.desc("version"))
        rows = self._part(self._chosen(version), "reports", f"{REPORT}, version long")
        return rows.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")

    def summary(self, name: str, version: int | None = None) -> DataFrame:
        """keys, events, reported, mean_delay and squares of a summary as of a version, from the versions' changes alone."""
        keys = SUMMARIES[name]
        kinds = {"st": "st long", "n": "n long", "ty": "ty string"}
        rows = self._part(self._chosen(version), name, ", ".join(kinds[k] for k in keys) + f", events long, reported long, total {EXACT}, squares {EXACT}")
        g = rows.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("events", "reported", "total", "squares"))).where("events > 0")
        mean = F.col("total").cast("double") / F.nullif(F.col("reported"), F.lit(0))
        return g.select(*keys, "events", "reported", mean.alias("mean_delay"), F.col("squares").cast("double").alias("squares"))

    def append(self, reports: DataFrame) -> int:
        """Commits reports as the next version. Of several reports of one event in a version the last known counts, of equal ones the
        greatest. A report known no later than the one that is there changes nothing, but is kept. An empty version is a version."""
        from ..functions.storage import drop, stored

        version = max(self.versions(), default=0) + 1
        names = [f.split()[0] for f in REPORT.split(", ")]
        rows = stored(reports.select(*(F.col(f.split()[0]).cast(f.split()[1]).alias(f.split()[0]) for f in REPORT.split(", "))))
        new = rows.withColumn("_r", F.row_number().over(W.partitionBy(*EVENT).orderBy(F.desc("known_at"), F.desc_nulls_last("act"), F.desc_nulls_last("delay"))))
        new = new.where("_r = 1").drop("_r")
        # Only events that the new reports name are looked up.
        same = F.lit(True)
        for c in EVENT:
            same = same & F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
        old = self.reports().alias("o").join(new.select(*EVENT, F.col("known_at").alias("_now")).alias("n"), same).where("o.known_at < n._now").select("o.*")
        kept = self.reports().alias("o")
        fresh = new.alias("n").join(kept, same & (F.col("o.known_at") >= F.col("n.known_at")), "left_anti")
        change = stored(fresh.select(*names, F.lit(1).alias("sign")).unionByName(old.select(*names, F.lit(-1).alias("sign"))))
        staged = f"{self.path}/staging/{uuid.uuid4().hex}"
        rows.withColumn("version", F.lit(version).cast("long")).write.parquet(f"{staged}/reports")
        delay, sign = F.col("delay").cast(EXACT), F.col("sign")
        for name, keys in SUMMARIES.items():
            change.groupBy(*keys).agg(
                F.sum(sign).alias("events"), F.sum(F.when(delay.isNotNull(), sign)).cast("long").alias("reported"),
                F.sum(delay * sign).cast(EXACT).alias("total"), F.sum((F.col("delay") * F.col("delay")).cast(EXACT) * sign).cast(EXACT).alias("squares")
            ).write.parquet(f"{staged}/{name}")
        drop(rows, change)
        to = self._hadoop(f"{self.path}/versions/v{version:08d}")
        self._fs.mkdirs(to.getParent())
        if self._fs.exists(to) or not self._fs.rename(self._hadoop(staged), to):
            raise ValueError(f"version {version} was written by another; append again")
        return version
