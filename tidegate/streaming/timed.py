"""A run's pending events as a state machine with timers: state that ends, and results that go to files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

OUT = "d string, n long, pending_count long, oldest_scheduled long, done_until long, over boolean"
#: Where timers and maps of state live.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Pending(StatefulProcessor):
    """A planned event opens; a done one closes all that are scheduled no later. A run ends, and its state goes, once nothing is
    open and the watermark has passed its last message by quiet_ms, or once it has passed the last scheduled event by limit_ms."""

    def __init__(self, quiet_ms: int, limit_ms: int):
        self.quiet_ms, self.limit_ms = quiet_ms, limit_ms

    def init(self, handle) -> None:
        self.handle = handle
        # Every run has one timer, so all state ends; Spark's time to live goes by the clock on the wall, not by the events'.
        self.open = handle.getMapState("open", "s long", "planned long")
        self.until = handle.getValueState("until", "s long")
        self.alarm = handle.getValueState("alarm", "at long")

    def row(self, key: tuple, left: list[int], until: int | None, over: bool) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "d": [key[0]], "n": [key[1]], "pending_count": [len(left)], "oldest_scheduled": pd.array([min(left, default=None)], "Int64"),
                "done_until": pd.array([until], "Int64"), "over": [over]
            }
        )

    def known(self) -> tuple[list[int], int | None]:
        return [k[0] for k in self.open.keys()], self.until.get()[0] if self.until.exists() else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        """Only what is open after the whole batch goes to the state, as each of its calls is a round trip to Spark."""
        old, until = self.known()
        last, fresh = 0, []
        for frame in rows:
            s, done = frame["s"].to_numpy(np.int64), frame["done"].to_numpy(bool)
            last = max(last, int(frame["at_ms"].max()))
            if done.any():
                top = int(s[done].max())
                until = top if until is None else max(until, top)
            fresh.append(np.unique(s[~done] if until is None else s[~done & (s > until)]))
        new = np.unique(np.concatenate(fresh)) if fresh else np.empty(0, np.int64)
        new = {int(s) for s in (new if until is None else new[new > until])}
        if until is not None:
            self.until.update((until,))
        kept = {s for s in old if until is None or s > until}
        for s in set(old) - kept:
            self.open.removeKey((s,))
        for s in new - kept:
            self.open.updateValue((s,), (1,))
        left = list(kept | new)
        due = max(left) // 1000 + self.limit_ms if left else 0
        at = max(due, last + self.quiet_ms)
        if self.alarm.exists():
            self.handle.deleteTimer(self.alarm.get()[0])
        self.handle.registerTimer(at)
        self.alarm.update((at,))
        yield self.row(key, left, until, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = self.row(key, *self.known(), True)
        self.open.clear(), self.until.clear(), self.alarm.clear()
        yield out

    def close(self) -> None:
        pass


def pending_runs(stream: DataFrame, late: str = "2 hours", quiet_hours: float = 2, limit_hours: float = 24) -> DataFrame:
    """(d, n, s, done, known_at) messages to the run's pending events after each batch, and once more, over, when the run ends.

    s is in microseconds. Messages of one batch count together, in whatever order they come; one that comes after its run's
    end begins the run anew. Null keys are runs of their own; messages without s or known_at are left out.
    """
    hour = 3_600_000
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = stream.where("s is not null and known_at is not null").select(
        F.col("d").cast("string").alias("d"), "n", "s", F.coalesce("done", F.lit(False)).alias("done"), "known_at", F.unix_millis("known_at").alias("at_ms")
    )
    machine = Pending(int(quiet_hours * hour), int(limit_hours * hour))
    return rows.withWatermark("known_at", late).groupBy("d", "n").transformWithStateInPandas(machine, OUT, "Update", "EventTime")


def run_to_end(df: DataFrame, at: str | None = None, mode: str = "append") -> DataFrame:
    """Drives a bounded stream to its end into files under at, in the shared folder unless told otherwise, and reads them back.

    A batch's files are written whole and once more if the batch is repeated, and the checkpoint is beside them: the same at
    goes on where a stopped or lost run ended. In complete mode the last batch is the result. No row passes the driver.
    """
    from ..functions.storage import new_path

    spark = df.sparkSession
    at = at or new_path(spark)
    if "batch" in df.columns:
        raise ValueError("a column named batch is needed for the batches")

    def keep(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/rows/batch={k}")

    # So that there is a table even without a batch.
    spark.createDataFrame([], df.schema).write.mode("overwrite").parquet(f"{at}/rows/batch=-1")
    query = df.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(df.schema.add("batch", "long")).parquet(f"{at}/rows")
    if mode == "complete":
        rows = rows.where(F.col("batch") == (rows.agg(F.max("batch")).first()[0] or 0))
    return rows.drop("batch")


def state_rows(spark: SparkSession, at: str, variable: str) -> DataFrame:
    """What a machine that wrote to at still remembers in a variable of its state."""
    return spark.read.format("statestore").option("stateVarName", variable).load(f"{at}/checkpoint")
