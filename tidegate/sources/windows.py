"""A web archive as a Spark source, and tables that are published whole.

weekly_archive: a partition for each request window; a task asks for its window, waits as the server says, and keeps the answer
by the hash of its content on shared storage. published: tasks write files and hash their blocks as they go; one manifest,
moved into place when all tasks are done, is the commit. Storage is reached through pyarrow, which must know it.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .archive import http_get, wait_of, weekly_windows
from .shared import put_whole, read_bytes, storage

#: Bytes that are hashed as one block.
BLOCK = 8 << 20


class Window(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class WeeklyArchive(DataSource):
    """Options: url with {start} and {end} (seconds), from_us, to_us, cache (a shared folder), tries."""

    @classmethod
    def name(cls) -> str:
        return "weekly_archive"

    def schema(self) -> str:
        return "start_us long, end_us long, url string, sha256 string, body binary"

    def reader(self, schema) -> WeeklyReader:
        return WeeklyReader(dict(self.options))


class WeeklyReader(DataSourceReader):
    def __init__(self, options: dict):
        if missing := {"url", "from_us", "to_us", "cache"} - set(options):
            raise ValueError(f"options missing: {sorted(missing)}")
        self.url, self.cache, self.tries = options["url"], options["cache"].rstrip("/"), int(options.get("tries", 4))
        self.bounds = int(options["from_us"]), int(options["to_us"])

    def partitions(self) -> list[Window]:
        return [Window(*w) for w in weekly_windows(*self.bounds)]

    def read(self, partition: Window | None):
        if partition is None:  # Spark's one partition of an empty span
            return
        url = self.url.format(start=partition.start // 1_000_000, end=partition.end // 1_000_000)
        body = self.cached(url)
        if body is None:
            body = self.asked(url)
            digest = hashlib.sha256(body).hexdigest()
            put_whole(f"{self.cache}/objects/{digest}", body)
            put_whole(f"{self.cache}/answers/{hashlib.sha256(url.encode()).hexdigest()}", digest.encode())
        yield partition.start, partition.end, url, hashlib.sha256(body).hexdigest(), body

    def cached(self, url: str) -> bytes | None:
        """The kept answer, if there is one and its content has the hash under which it is kept."""
        digest = read_bytes(f"{self.cache}/answers/{hashlib.sha256(url.encode()).hexdigest()}")
        if digest is None or not re.fullmatch(rb"[0-9a-f]{64}", digest):
            return None
        body = read_bytes(f"{self.cache}/objects/{digest.decode()}")
        return body if body is not None and hashlib.sha256(body).hexdigest() == digest.decode() else None

    def asked(self, url: str) -> bytes:
        get = http_get(lambda _: url)
        for k in range(self.tries):
            try:
                return get((0, 0))
            except OSError as e:
                if k == self.tries - 1:
                    raise
                time.sleep(wait_of(getattr(e, "retry_after", None), k))
        raise ValueError("tries must be one or more")


def weekly_archive(spark: SparkSession, url: str, from_us: int, to_us: int, cache: str, tries: int = 4) -> DataFrame:
    """(start_us, end_us, url, sha256, body) of each week's answer; an empty span has no rows."""
    spark.dataSource.register(WeeklyArchive)
    options = {"url": url, "from_us": str(from_us), "to_us": str(to_us), "cache": cache, "tries": str(tries)}
    return spark.read.format("weekly_archive").options(**options).load()


class Hashing:
    """A file that hashes what goes through it, block by block."""

    closed = False

    def __init__(self, stream):
        self.stream, self.size, self.held, self.blocks, self.whole = stream, 0, hashlib.sha256(), [], hashlib.sha256()

    def write(self, data) -> int:
        data = bytes(data)
        self.stream.write(data)
        self.whole.update(data)
        at = 0
        while at < len(data):
            take = min(len(data) - at, BLOCK - self.size % BLOCK)
            self.held.update(data[at : at + take])
            self.size, at = self.size + take, at + take
            if self.size % BLOCK == 0:
                self.blocks.append(self.held.hexdigest())
                self.held = hashlib.sha256()
        return len(data)

    def writable(self) -> bool:
        return True

    def readable(self) -> bool:
        return False

    def seekable(self) -> bool:
        return False

    def tell(self) -> int:
        return self.size

    def flush(self) -> None:
        pass

    def close(self) -> None:
        if not self.closed:
            self.closed = True
            if self.size % BLOCK:
                self.blocks.append(self.held.hexdigest())
            self.stream.close()


class Written(WriterCommitMessage):
    def __init__(self, file: dict | None):
        self.file = file


class Published(DataSource):
    """Options: path; version, which must be the next one."""

    @classmethod
    def name(cls) -> str:
        return "published"

    def writer(self, schema, overwrite: bool) -> PublishedWriter:
        return PublishedWriter(dict(self.options), schema)


class PublishedWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema):
        self.path, self.version, self.schema = options["path"].rstrip("/"), int(options["version"]), schema.json()

    def write(self, iterator) -> Written:
        """A task's rows as one file; a task that is run again writes another, and only the one that Spark takes is listed."""
        import pyarrow as pa
        import pyarrow.parquet as pq

        files, at = storage(f"{self.path}/data/{uuid.uuid4().hex}.parquet")
        files.create_dir(at.rsplit("/", 1)[0], recursive=True)
        sink, out, rows = None, None, 0
        for batch in iterator:
            if batch.num_rows:
                if out is None:
                    sink = Hashing(files.open_output_stream(at, compression=None))
                    out = pq.ParquetWriter(pa.PythonFile(sink, "w"), batch.schema)
                out.write_batch(batch)
                rows += batch.num_rows
        if out is None:
            return Written(None)
        out.close()
        sink.close()
        return Written({"file": at.rsplit("/", 1)[1], "rows": rows, "bytes": sink.size, "sha256": sink.whole.hexdigest(), "blocks": sink.blocks})

    def commit(self, messages: list) -> None:
        parts = sorted((m.file for m in messages if m is not None and m.file), key=lambda f: f["file"])
        manifest = {"version": self.version, "schema": json.loads(self.schema), "block": BLOCK, "files": parts}
        to = f"{self.path}/manifests/{self.version:08d}.json"
        if read_bytes(to) is not None:
            raise ValueError(f"version {self.version} is there already")
        put_whole(to, json.dumps(manifest).encode())

    def abort(self, messages: list) -> None:
        """What tasks wrote stays unlisted; the last version goes on being read."""


def published_versions(path: str) -> list[int]:
    import pyarrow.fs as fs

    files, at = storage(path.rstrip("/") + "/manifests")
    found = files.get_file_info(fs.FileSelector(at, allow_not_found=True))
    return sorted(int(f.base_name.removesuffix(".json")) for f in found if re.fullmatch(r"\d{8}\.json", f.base_name))


def publish(df: DataFrame, path: str) -> int:
    """df as the next version at path. A job or task that dies before the commit changes nothing for readers."""
    df.sparkSession.dataSource.register(Published)
    version = max(published_versions(path), default=0) + 1
    df.write.format("published").option("path", path).option("version", str(version)).mode("append").save()
    return version


def manifest_of(path: str, version: int | None = None) -> dict:
    known = published_versions(path)
    if not known or version is not None and version not in known:
        raise ValueError(f"no version {'at all' if version is None else version} at {path}")
    return json.loads(read_bytes(f"{path.rstrip('/')}/manifests/{version or known[-1]:08d}.json"))


def read_published(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version, the last one unless told otherwise."""
    from pyspark.sql.types import StructType

    m = manifest_of(path, version)
    schema = StructType.fromJson(m["schema"])
    files = [f"{path.rstrip('/')}/data/{f['file']}" for f in m["files"]]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def verify_published(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(file, block) of blocks that are not as they were written; -1 for a missing file or one of another size.

    Files are read in tasks, block by block, whatever their size.
    """
    m = manifest_of(path, version)
    where, block = path.rstrip("/"), m["block"]
    files = [(f["file"], f["bytes"], f["blocks"]) for f in m["files"]]
    if not files:
        return spark.createDataFrame([], "file string, block long")
    listed = spark.createDataFrame(files, "file string, bytes long, blocks array<string>").repartition(min(len(files), 1000))

    def run(batches):
        import pandas as pd
        import pyarrow.fs as fs

        for b in batches:
            bad = []
            for name, size, blocks in zip(b["file"], b["bytes"], b["blocks"]):
                store, at = storage(f"{where}/data/{name}")
                info = store.get_file_info(at)
                if info.type == fs.FileType.NotFound or info.size != size:
                    bad.append((name, -1))
                    continue
                with store.open_input_stream(at, compression=None) as f:
                    bad += [(name, k) for k, want in enumerate(blocks) if hashlib.sha256(f.read(block)).hexdigest() != want]
            yield pd.DataFrame(bad, columns=["file", "block"])

    return listed.mapInPandas(run, "file string, block long")
