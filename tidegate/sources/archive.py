"""Sources and sinks: weather XML, readiness messages, tables, manifests, content hashes, checkpoints of searches."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clock import MINUTE
from ..operators.feed import KEY
from .shared import put_whole, read_bytes

ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"


def observations(text: str):
    """(parameter, station, time, value) of each point of each member of a feature collection, whatever lies between them.

    A member is an observation with one identifier, one observed property and its points at any depth. What is no feature
    collection, or a member that lacks one of these, is an error; a collection without members has no rows.
    """
    from urllib.parse import parse_qs, urlsplit
    from xml.etree import ElementTree

    if "<!DOCTYPE" in text:
        raise ValueError("not a feature collection: a document type is declared")
    try:
        root = ElementTree.fromstring(text.encode())
    except ElementTree.ParseError as e:
        raise ValueError(f"not a feature collection: {e}") from None
    local = lambda e: e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""
    if local(root) != "FeatureCollection":
        raise ValueError(f"not a feature collection: {local(root)}")
    for member in root:
        if local(member) != "member":
            continue
        found: dict = {"identifier": None, "observedProperty": None}
        points = []
        for e in member.iter():
            name = local(e)
            if name == "identifier" and found[name] is None:
                found[name] = (e.text or "").strip()
            elif name == "observedProperty" and found[name] is None:
                link = next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == "href"), "")
                found[name] = parse_qs(urlsplit(link).query).get("param", [None])[0]
            elif name == "MeasurementTVP":
                part = {local(x): (x.text or "").strip() for x in e}
                points.append((part.get("time", ""), part.get("value", "")))
        if not all(found.values()) or not found["identifier"].isdigit():
            raise ValueError(f"a member without {' or '.join(k for k, v in found.items() if not v) or 'a numeric identifier'}")
        for time, value in points:
            yield found["observedProperty"], int(found["identifier"]), time, value


def weather_xml(df: DataFrame, column: str, station: int | None = None, parameters: list[str] | None = None) -> DataFrame:
    """(parameter, t, value, station) of WaterML time series in a string column, one response in each row.

    Measurement times must name a zone; another station, an unknown parameter, or a document that is no feature collection
    of observations fails the job that reads it. A null document has no rows; what is no number is unknown.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for text in batch.column(0).to_pylist():
                cols = list(zip(*observations(text))) if text is not None else []
                if cols:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.string()))],
                        names=["parameter", "station", "time", "text"]
                    )

    p = df.select(F.col(column).cast("string").alias("x")).mapInArrow(run, "parameter string, station long, time string, text string")
    time = F.col("time")
    t = F.when(time.rlike(ISO), F.unix_micros(F.try_to_timestamp(time))).otherwise(
        F.raise_error(F.concat(F.lit("measurement time without zone: "), time)).cast("long")
    )
    name, at = F.col("parameter"), F.col("station").cast("int")
    if parameters is not None:
        name = F.when(name.isin(parameters), name).otherwise(F.raise_error(F.concat(F.lit("unexpected parameter: "), name)))
    if station is not None:
        at = F.when(at == station, at).otherwise(F.raise_error(F.lit("unexpected station")).cast("int"))
    return p.select(name.alias("parameter"), t.alias("t"), F.col("text").try_cast("double").alias("value"), at.alias("station"))


def message(raw: Column) -> Column:
    """A readiness message, JSON or a printed dictionary, as struct<accepted, timestamp>; null if it is none."""
    text = raw
    for python, plain in ((r"\bTrue\b", "true"), (r"\bFalse\b", "false"), (r"\bNone\b", "null")):
        text = F.regexp_replace(text, python, plain)
    return F.from_json(text, "accepted string, timestamp string, _bad string", {"allowSingleQuotes": "true", "columnNameOfCorruptRecord": "_bad"})


def readiness(rows: DataFrame, raw: str, bound_us: int | None = None) -> DataFrame:
    """rows with ready (micros) and malformed.

    Only accepted messages with a full ISO time count. Empty words and scalars say nothing; what cannot be read, or has no proper
    time though accepted, is malformed. Decisions at or after the bound are not seen.
    """
    r = F.trim(F.col(raw))
    empty = r.isNull() | r.isin("", "nan", "None", "null")
    object_ = r.startswith("{")
    scalar = r.rlike(r"^(-?[0-9.eE+-]+|true|false|True|False|\".*\"|'.*'|\[.*\]|\(.*\))$")
    m = message(F.when(~empty & object_, r))
    fine = F.coalesce(m["_bad"].isNull(), F.lit(False)) & object_
    # The flag itself must be true; a text that says so is not.
    accepted = fine & F.coalesce(m["accepted"] == "true", F.lit(False)) & r.rlike(r"[\"']accepted[\"']\s*:\s*(true|True)\b")
    stamp = F.when(F.coalesce(m["timestamp"].rlike(ISO), F.lit(False)), F.unix_micros(F.try_to_timestamp(m["timestamp"])))
    malformed = ~empty & ((object_ & ~fine) | (~object_ & ~scalar) | (accepted & stamp.isNull()))
    ready = F.when(accepted, stamp)
    if bound_us is not None:
        ready = F.when(ready < F.lit(bound_us), ready)
    return rows.withColumn("ready", ready).withColumn("malformed", F.coalesce(malformed, F.lit(False)))


def with_readiness(feed: DataFrame, decisions: DataFrame) -> DataFrame:
    """feed with ready of the first decision of each key."""
    first = decisions.where("ready is not null").groupBy(*KEY).agg(F.min_by("ready", "ord").alias("ready"))
    return feed.drop("ready").join(first, KEY, "left")


def content_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of files; each file is hashed where it is read."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_table(df: DataFrame, path: str, kind: str = "parquet", by: list[str] | None = None) -> None:
    """Parquet, CSV (with a header) or JSON lines, in partitions by columns if wanted."""
    w = df.write.mode("overwrite")
    w = w.partitionBy(*by) if by else w
    w.option("header", "true").format(kind).save(path)


def merge_manifests(base: dict, *added: dict) -> dict:
    """Union of manifests: lists grow without repeats, mappings merge, other values must agree."""
    out = dict(base)
    for m in added:
        for k, v in m.items():
            if k not in out:
                out[k] = v
            elif isinstance(v, list):
                out[k] = out[k] + [x for x in v if x not in out[k]]
            elif isinstance(v, dict):
                out[k] = merge_manifests(out[k], v)
            elif out[k] != v:
                raise ValueError(f"manifests disagree on {k}")
    return out


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file on any storage that Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def get_text(spark: SparkSession, path: str) -> str:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_profile(df: DataFrame, path: str, manifest: dict) -> None:
    """A table and its manifest beside it, with the columns it has."""
    write_table(df, path)
    put_text(df.sparkSession, path.rstrip("/") + ".manifest.json", json.dumps(manifest | {"columns": df.columns}, indent=1))


def read_profile(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The table and manifest; fails if a declared column is missing."""
    manifest = json.loads(get_text(spark, path.rstrip("/") + ".manifest.json"))
    df = spark.read.parquet(path)
    if missing := set(manifest["columns"]) - set(df.columns):
        raise ValueError(f"columns missing: {sorted(missing)}")
    return df, manifest


def write_arrays(df: DataFrame, path: str, columns: list[str], most: int = 1 << 24) -> None:
    """Columns as one numpy archive on the driver's disk, in df's order. A sink of results of known size: more rows are an error."""
    import numpy as np

    rows = df.select(*columns).limit(most + 1).toArrow()
    if rows.num_rows > most:
        raise ValueError(f"more than {most} rows; write a table instead")
    np.savez_compressed(path, **{c: rows[c].to_numpy() for c in columns})


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """The table that write_arrays() wrote."""
    import numpy as np
    import pyarrow as pa

    with np.load(path, allow_pickle=False) as z:
        return spark.createDataFrame(pa.table({c: z[c] for c in z.files}))


class SearchLog:
    """Results of a search on shared storage, a file for each: a resumed search must have the same configuration and continues
    after what is there."""

    def __init__(self, directory: str, config: dict):
        self.directory = directory.rstrip("/")
        found = read_bytes(f"{self.directory}/config.json")
        if found is None:
            put_whole(f"{self.directory}/config.json", json.dumps(config).encode())
        elif json.loads(found) != config:
            raise ValueError("the search was begun with another configuration")
        self.done = []
        while (result := read_bytes(self._at(len(self.done)))) is not None:
            self.done.append(json.loads(result))

    def _at(self, k: int) -> str:
        return f"{self.directory}/results/{k:06d}.json"

    def run(self, candidates: list, score) -> list[dict]:
        for k, c in enumerate(candidates):
            if k < len(self.done):
                if self.done[k]["candidate"] != c:
                    raise ValueError(f"result {k} belongs to another candidate")
                continue
            self.done.append({"candidate": c, "score": score(c)})
            put_whole(self._at(k), json.dumps(self.done[-1]).encode())
        return self.done


def weekly_windows(start_us: int, end_us: int) -> list[tuple[int, int]]:
    """Request windows of at most a week that cover [start, end)."""
    week = 7 * 1440 * MINUTE
    return [(t, min(t + week, end_us)) for t in range(start_us, end_us, week)]


def wait_of(retry_after: str | float | None, attempt: int, now: float | None = None) -> float:
    """Seconds to wait: what the server asks for, in seconds or as a date, else twice as long each time; five minutes at most."""
    from email.utils import parsedate_to_datetime
    from time import time

    wait = float(2**attempt)
    if retry_after is not None:
        try:
            wait = float(retry_after)
        except ValueError:
            try:
                wait = parsedate_to_datetime(str(retry_after)).timestamp() - (time() if now is None else now)
            except ValueError:
                pass
    return min(max(wait, 0.0), 300.0)


def http_get(url_of, timeout: float = 60.0):
    """get(window) for fetch_cached(): the body at url_of(window). A refusal is an OSError that carries the server's Retry-After."""
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    def get(window: tuple[int, int]) -> bytes:
        try:
            with urlopen(Request(url_of(window), headers={"Accept": "application/xml"}), timeout=timeout) as response:
                return response.read()
        except HTTPError as e:
            refused = OSError(f"HTTP {e.code}")
            refused.retry_after = e.headers.get("Retry-After")
            raise refused from e

    return get


def fetch_cached(window: tuple[int, int], cache: str, get, tries: int = 4, sleep=None) -> bytes:
    """The response for a window, from the cache if its hash is right, else by get(window) with back-off; get may raise with a retry_after."""
    import hashlib
    import time

    sleep = sleep or time.sleep
    os.makedirs(cache, exist_ok=True)
    at = os.path.join(cache, f"{window[0]}_{window[1]}.xml")
    if os.path.exists(at) and os.path.exists(at + ".sha256"):
        with open(at, "rb") as f, open(at + ".sha256", encoding="ascii") as h:
            if hashlib.sha256(body := f.read()).hexdigest() == h.read().strip():
                return body
    for k in range(tries):
        try:
            body = get(window)
            break
        except OSError as e:
            if k == tries - 1:
                raise
            sleep(wait_of(getattr(e, "retry_after", None), k))
    with open(at, "wb") as f:
        f.write(body)
    with open(at + ".sha256", "w", encoding="ascii") as f:
        f.write(hashlib.sha256(body).hexdigest())
    return body
