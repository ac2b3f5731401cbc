"""What the operators of this subpackage share: tables, batches, shared storage."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Words are maximal runs of anything but ASCII white space; bytes.split() splits on exactly these bytes.
WS = r"[\x20\x09-\x0D]+"
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Arrow batches that stay small when single texts are long. Lowers the session's limits where they are higher, and leaves lower ones alone."""
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", 16 << 20)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; one of the machine only where it is unset and Spark is one process."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir is not set: executors and the driver need a folder that they share")
    if not at:
        at = "file://" + tempfile.mkdtemp(prefix="tidegate-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/t{uuid.uuid4().hex}"


def stored(df: DataFrame, *by: str) -> DataFrame:
    """Cuts the lineage: df as a table in the shared folder, in folders by these columns."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.partitionBy(*by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes stored tables that no plan reads any more."""
    for t in tables:
        at = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def as_bytes(column) -> list:
    """UTF-8 bytes of a string column of a record batch; null: None."""
    import pyarrow as pa

    return column.cast(pa.binary()).to_pylist()


def release() -> None:
    """Gives a Python worker's free memory back to the system; workers live on from stage to stage."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def frugal(run):
    """A function of batches that releases memory when it ends."""

    def wrapped(batches):
        yield from run(batches)
        release()

    return wrapped


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xCA9B0C7EBA1DA115)
        return h ^ (h >> np.uint64(32))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) of the edges (a, b), without the least ones: fewer rows than nodes."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[x], label[y]
        open_ = x != y
        if not open_.any():
            break
        x, y = np.minimum(x, y)[open_], np.maximum(x, y)[open_]
        np.minimum.at(label, y, x)
        while (label[label] != label).any():
            label = label[label]
    pick = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[pick], nodes[label[pick]]


def edge_batches(a: np.ndarray, b: np.ndarray):
    import pyarrow as pa

    for lo in range(0, len(a), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + 50_000].copy(), pa.int64()) for x in (a, b)], names=["a", "b"])


def merge_forests(batches):
    """Edges of a task to a spanning forest of them."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for batch in batches:
        a.append(batch.column(0).to_numpy())
        b.append(batch.column(1).to_numpy())
    yield from edge_batches(*forest(np.concatenate(a), np.concatenate(b)))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b: long), stored: the smallest node that its links reach.

    Alternating large and small stars; each round cuts its lineage in shared storage and drops the table before it. Only
    (node, neighbour) rows move, and minima combine before the shuffle.
    """
    from pyspark.sql import functions as F

    e = stored(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").distinct())
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        last, e = e, stored(small)
        dropped(last)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    roots = e.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    out = stored(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()))
    dropped(e)
    return out
