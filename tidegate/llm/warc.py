"""WARC archives and their Merkle fixity audit.

Records are hashed where they lie. The leaves of a tree are records in order of id; a node covers a fixed range of ids
(16 times that of its children) and hashes its children's hashes in order, with the range of offsets that each takes inside
the node. Offsets count from the node's own start, so a lost or longer record changes the nodes above it and none beside
it. Two replicas are compared from the roots down: only the children of nodes that differ are looked at, so sound archives
cost a few rows and damage is located in a few steps. In the leaves that differ, records are matched by content.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import dropped, new_path, partitions, small_batches, stored

#: Children of a node, as bits of the id; levels above the records. A shard is a node of level SHARD.
BITS, LEVELS, SHARD = 4, 5, 3
#: Where records without id are: a leaf by content, in so many shards.
LOOSE, LOOSE_SHARDS = -(1 << 56), 1024
#: Level of rows that are records.
RECORD = -1
GZIP, PIECE = b"\x1f\x8b\x08", 1 << 20
CLOSE, NEXT = b"\r\n\r\n", re.compile(rb"WARC/1\.\d\r?\n")
#: The end of a record and the beginning of the next; how far a length may reach past that.
BETWEEN, AHEAD = re.compile(rb"\r\n\r\nWARC/1\.\d\r?\n"), 16 << 20
ID = re.compile(r"^<urn:page:(-?\d+)>$")
LEAF = "page_id long, digest string, length long"
NODE = "level int, key long, page_id long, digest string, length long, copies long, start long, stop long"


class Source:
    """Bytes from pieces; what was read may be put back."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held, self.pos, self.at = pieces, b"", 0, 0

    def more(self) -> bool:
        piece = next(self.pieces, None)
        self.held = self.held[self.pos :] + (piece or b"")
        self.pos = 0
        return piece is not None

    def take(self, n: int) -> bytes:
        out = self.held[self.pos : self.pos + n]
        self.pos += len(out)
        self.at += len(out)
        return out

    def read(self, n: int) -> bytes:
        """n bytes, or what is left."""
        parts, size = [], 0
        while size < n:
            part = self.take(n - size)
            parts.append(part)
            size += len(part)
            if size < n and not self.more():
                break
        return b"".join(parts)

    def line(self) -> bytes:
        while (end := self.held.find(b"\n", self.pos)) < 0 and self.more():
            pass
        return self.take((end + 1 or len(self.held)) - self.pos)

    def back(self, data: bytes) -> None:
        """data: the bytes before the next one to be read."""
        if len(data) <= self.pos:
            self.pos -= len(data)
        else:
            self.held, self.pos = data + self.held[self.pos :], 0
        self.at -= len(data)


def records(source: Source) -> Iterator[tuple[int, dict, bytes, bytes]]:
    """(offset, headers, block, all bytes with the closing lines) of each record; damaged stretches are skipped to the next record.

    A record whose length is wrong ends where the next one begins. A length is taken as wrong, too, if it reaches more than
    AHEAD bytes past the first end of a record with the beginning of another; so one record at a time is in memory, and
    AHEAD bytes of others, whatever a damaged length says.
    """
    while line := source.line():
        if not line.startswith(b"WARC/"):
            continue
        start, headers, head = source.at - len(line), {}, [line]
        while (line := source.line()).strip():
            head.append(line)
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        head.append(line)
        size = headers.get("content-length", "")
        n = int(size) if size.isascii() and size.isdigit() else 0
        block, other = bytearray(), None
        while len(block) < n and (other is None or len(block) - other <= AHEAD) and (part := source.read(min(PIECE, n - len(block)))):
            block += part
            if other is None and (m := BETWEEN.search(block, max(0, len(block) - len(part) - 32))):
                other = m.start()
        close = source.read(4) if len(block) == n else b""
        if close != CLOSE:
            # The length is wrong, or the record is cut off: it ends where the next one begins.
            block += close
            at = 0
            while (m := NEXT.search(block, max(0, at))) is None and (part := source.read(PIECE)):
                at = len(block) - 16
                block += part
            if m:
                source.back(bytes(block[m.start() :]))
                del block[m.start() :]
            close = CLOSE if block.endswith(CLOSE) else b""
            if close:
                del block[-4:]
        yield start, headers, bytes(block), b"".join((*head, block, close))


def inflated(stream) -> Iterator[bytes]:
    """The bytes of a file, piece by piece: of all members if it is gzipped; a damaged member ends where the next one begins."""
    held = stream.read(PIECE)
    if not held.startswith(GZIP[:2]):
        while held:
            yield held
            held = stream.read(PIECE)
        return
    while held:
        member = zlib.decompressobj(31)
        try:
            while not member.eof:
                if not held and not (held := stream.read(PIECE)):
                    return
                piece = member.decompress(held, PIECE)
                held = member.unused_data if member.eof else member.unconsumed_tail
                if piece:
                    yield piece
        except zlib.error:
            held = held[1:]
        while GZIP not in held and (piece := stream.read(PIECE)):
            held = held[-2:] + piece
        at = held.find(GZIP)
        held = held[at:] if at >= 0 else b""


def opened(path: str):
    """(file system, path) of a path or URI that executors see."""
    import pyarrow.fs as fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path if re.match(r"^[a-z][a-z0-9+.-]*:", path) else f"file://{path}"))


def records_in(path: str) -> Iterator[tuple[int, dict, bytes, bytes]]:
    files, at = opened(path)
    with files.open_input_stream(at, compression=None) as stream:
        yield from records(Source(inflated(stream)))


def write_warc(archive: DataFrame, path: str) -> DataFrame:
    """Writes the records (column record: binary) as gzipped WARC files, each record a member of its own; gives (file, records, bytes), stored.

    Tasks stream; a task that is run again writes a file of another name, and only files that are listed count.
    """
    import pyarrow as pa

    small_batches(archive.sparkSession, 256)

    def run(batches):
        name = new_name(path)
        files, at = opened(name)
        files.create_dir(at.rpartition("/")[0], recursive=True)
        n = size = 0
        with files.open_output_stream(at, compression=None) as out:
            for batch in batches:
                for record in batch.column(0).to_pylist():
                    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
                    data = pack.compress(record or b"") + pack.flush()
                    out.write(data)
                    n, size = n + 1, size + len(data)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name], pa.string()), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["file", "records", "bytes"]
        )

    return stored(archive.select("record").mapInArrow(run, "file string, records long, bytes long"))


def new_name(path: str) -> str:
    import uuid

    return f"{path}/{uuid.uuid4().hex}.warc.gz"


def files_at(spark, path: str) -> DataFrame:
    """(file) of the files at a path, without their content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"))


def each_file(files: DataFrame) -> DataFrame:
    return files.select("file").repartition(partitions(files.sparkSession), "file")


def read_warc(files: DataFrame) -> DataFrame:
    """(file, offset, record_id, type, uri, date, block) of the records of WARC files (column file), gzipped or not. Files are streamed, never read whole."""
    import pyarrow as pa

    names = ["file", "offset", "record_id", "type", "uri", "date", "block"]
    types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary())

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for file in batch.column(0).to_pylist():
                for at, h, b, _ in records_in(file):
                    rows.append((file, at, h.get("warc-record-id"), h.get("warc-type"), h.get("warc-target-uri"), h.get("warc-date"), b))
                    size += len(b)
                    if len(rows) == 256 or size > 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return each_file(files).mapInArrow(run, "file string, offset long, record_id string, type string, uri string, date string, block binary")


def leaves_of_files(files: DataFrame) -> DataFrame:
    """(page_id, digest, length) of the records of WARC files, hashed as they are read. A record whose id is damaged has none."""
    import pyarrow as pa

    def run(batches):
        rows = []

        def batch_of():
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 3, (pa.int64(), pa.string(), pa.int64()))],
                names=["page_id", "digest", "length"]
            )

        for batch in batches:
            for file in batch.column(0).to_pylist():
                for _, h, _, record in records_in(file):
                    m = ID.match(h.get("warc-record-id", ""))
                    page = int(m[1]) if m and -(1 << 63) <= int(m[1]) < 1 << 63 else None
                    rows.append((page, hashlib.sha256(record).hexdigest(), len(record)))
                    if len(rows) == 4096:
                        yield batch_of()
                        rows.clear()
        yield batch_of()

    return each_file(files).mapInArrow(run, LEAF)


def page_records(pages: DataFrame) -> DataFrame:
    """(page_id, record): each page as the bytes of a WARC record. Null html is empty, null url has no target line."""
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    page = F.col("page_id").cast("long")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page.cast("string"), F.lit("none")),
        F.lit(">\r\nWARC-Date: 2000-01-01T00:00:00Z\r\n"),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.col("url").cast("string"), r"[\r\n]", " "), F.lit("\r\n")), F.lit("")),
        F.lit("Content-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return pages.select(page.alias("page_id"), F.concat(head, body, F.lit("\r\n\r\n")).cast("binary").alias("record"))


def leaves(archive: DataFrame) -> DataFrame:
    """(page_id, digest, length) of each record (page_id, record)."""
    return archive.select("page_id", F.sha2("record", 256).alias("digest"), F.octet_length("record").cast("long").alias("length"))


def build(batches):
    """Rows (key, page_id, digest, length, copies) in order of key to nodes up to shards, and records with their ranges in the shard.

    One pass; in memory is one open node of each level.
    """
    import pyarrow as pa

    types = (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    names = [c.split()[0] for c in NODE.split(", ")]
    open_: list = [None] * (SHARD + 1)  # (node, hash, start) of each level
    rows, at = [], 0

    def close(upto):
        for level in range(upto + 1):
            node, h, start = open_[level]
            rows.append((level, node, None, h.hexdigest(), None, None, start, at))
            if level < SHARD:
                _, above, base = open_[level + 1]
                above.update(b"%d:%s:%d:%d|" % (node, h.hexdigest().encode(), start - base, at - base))

    for batch in batches:
        for key, page, digest, length, copies in zip(*(c.to_pylist() for c in batch.columns)):
            last = next((level for level in range(SHARD, -1, -1) if open_[level] is None or open_[level][0] != key >> BITS * level), -1)
            if last >= 0:
                if open_[0] is not None:
                    close(last)
                at = 0 if last == SHARD else at
                for level in range(last, -1, -1):
                    open_[level] = (key >> BITS * level, hashlib.sha256(b"%d|" % level), at)
            open_[0][1].update(f"{page}:{digest}:{length}:{copies}|".encode())
            rows.append((RECORD, key, page, digest, length, copies, at, at + length * copies))
            at += length * copies
        if len(rows) > 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
            rows = []
    if open_[0] is not None:
        close(SHARD)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def tree(rows: DataFrame) -> dict[int, DataFrame]:
    """Stored nodes (key, digest, ...) by level, the records themselves at RECORD. A node's range of ids is fixed, so replicas with lost records still line up.

    Equal records of one id are one row with their number, counted before they are gathered.
    """
    word = F.conv(F.substring("digest", 1, 13), 16, 10).cast("long")
    key = F.coalesce("page_id", F.lit(LOOSE) + F.pmod(word, F.lit(LOOSE_SHARDS << BITS * SHARD)))
    once = rows.groupBy(key.alias("key"), "page_id", "digest", "length").agg(F.count("*").alias("copies"))
    dealt = once.repartition(partitions(rows.sparkSession), F.shiftright("key", BITS * SHARD)).sortWithinPartitions("key", "page_id", "digest", "length")
    table = stored(dealt.select("key", "page_id", "digest", "length", "copies").mapInArrow(build, NODE), "level")
    out = {level: table.where(F.col("level") == level).drop("level") for level in range(RECORD, SHARD + 1)}
    out[None] = table
    for level in range(SHARD + 1, LEVELS + 1):
        child = F.struct("key", "digest", (F.col("stop") - F.col("start")).alias("size"))
        up = out[level - 1].groupBy(F.shiftright("key", BITS).alias("key")).agg(
            F.sort_array(F.collect_list(child)).alias("children"), F.lit(0).cast("long").alias("start"),
            F.sum(F.col("stop") - F.col("start")).alias("stop")
        )
        digest = F.sha2(
            F.concat_ws(
                "|", F.lit(level), F.transform("children", lambda c: F.concat_ws(":", c["key"], c["digest"], c["size"]))
            ).cast("binary"),
            256
        )
        out[level] = stored(up.select("key", digest.alias("digest"), "start", "stop"))
    return out


def descend(a: dict[int, DataFrame], b: dict[int, DataFrame]) -> DataFrame:
    """Leaves (key), stored, in which two trees differ or that only one has, found from the roots down."""
    bad = None
    for level in range(LEVELS, -1, -1):
        x, y = (t[level].select("key", "digest") for t in (a, b))
        if bad is not None:
            x, y = (t.join(bad.withColumnRenamed("key", "parent"), F.shiftright("key", BITS) == F.col("parent"), "left_semi") for t in (x, y))
        both = x.withColumnRenamed("digest", "d1").join(y.withColumnRenamed("digest", "d2"), "key", "full_outer")
        last, bad = bad, stored(both.where(~F.col("d1").eqNullSafe(F.col("d2"))).select("key"))
        if last is not None:
            dropped(last)
    return bad


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """Compares the leaves (page_id, digest, length) of two replicas; a row for each record that either has.

    page_id, shard, status, intact, offset, length, record_sha256, replica_offset, replica_length, replica_sha256, shard_root.
    status: intact; changed (the second has another record of that id in its place); lost (only the first has it); extra
    (only the second). offset: in the shard, in order of id. replica_*: of changed and extra ones. shard_root: of the first.
    An empty archive has no record. Records without id are told apart by content: a changed one is lost and extra.
    Of repeated records as many are intact as both have.
    """
    a, b = tree(first), tree(second)
    bad = descend(a, b)
    names = ["key", "page_id", "digest", "length"]
    good = a[RECORD].join(bad, "key", "left_anti").select(
        *names, "copies", "start", F.lit("intact").alias("status"),
        *(F.lit(None).cast(t).alias(c) for c, t in (("r_start", "long"), ("r_length", "long"), ("r_digest", "string"))),
        F.col("page_id").alias("r_page_id")
    )
    x, y = (t[RECORD].join(bad, "key", "left_semi") for t in (a, b))
    x, y = x.alias("x"), y.alias("y")
    same = F.lit(True)
    for c in names:
        same = same & F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
    n, m = (F.coalesce(F.col(f"{t}.copies"), F.lit(0)) for t in "xy")
    both = stored(
        x.join(y, same, "full_outer").select(
            *(F.coalesce(f"x.{c}", f"y.{c}").alias(c) for c in names), F.col("x.start").alias("start"), F.col("y.start").alias("r_start"),
            n.alias("n"), m.alias("m")
        )
    )
    kept = both.where("least(n, m) > 0").select(
        *names, F.least("n", "m").alias("copies"), "start", F.lit("intact").alias("status"),
        *(F.lit(None).cast(t).alias(c) for c, t in (("r_start", "long"), ("r_length", "long"), ("r_digest", "string"))),
        F.col("page_id").alias("r_page_id")
    )
    order = W.partitionBy("key").orderBy("page_id", "digest", "length", "copy")

    def left(over, under, start):
        """What one side has more of, row by row, numbered within the leaf."""
        rows = both.where(F.col(over) > F.col(under)).withColumn("copy", F.explode(F.sequence(F.col(under), F.col(over) - 1)))
        return rows.withColumn("at", F.row_number().over(order)).select(*names, "at", (F.col(start) + F.col("copy") * F.col("length")).alias("start"))

    u, v = left("n", "m", "start").alias("u"), left("m", "n", "r_start").alias("v")
    status = F.when(F.col("u.at").isNull(), "extra").when(F.col("v.at").isNull(), "lost").otherwise("changed")
    odd = u.join(v, (F.col("u.key") == F.col("v.key")) & (F.col("u.at") == F.col("v.at")), "full_outer").select(
        F.coalesce("u.key", "v.key").alias("key"), *(F.col(f"u.{c}").alias(c) for c in names[1:]), F.lit(1).cast("long").alias("copies"),
        F.col("u.start").alias("start"), status.alias("status"), F.col("v.start").alias("r_start"), F.col("v.length").alias("r_length"),
        F.col("v.digest").alias("r_digest"), F.col("v.page_id").alias("r_page_id")
    )
    rows = good.unionByName(kept).unionByName(odd).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    rows = rows.withColumn("shard", F.shiftright("key", BITS * SHARD))
    out = rows.join(a[SHARD].select(F.col("key").alias("shard"), F.col("digest").alias("shard_root")), "shard", "left")
    return out.select(
        F.when(F.col("status") == "extra", F.col("r_page_id")).otherwise(F.col("page_id")).alias("page_id"),
        "shard",
        "status",
        (F.col("status") == "intact").alias("intact"),
        (F.col("start") + F.col("copy") * F.col("length")).alias("offset"),
        "length",
        F.col("digest").alias("record_sha256"),
        F.col("r_start").alias("replica_offset"),
        F.col("r_length").alias("replica_length"),
        F.col("r_digest").alias("replica_sha256"),
        "shard_root",
    )


def damaged(archive: DataFrame, one_in: int) -> DataFrame:
    """A copy with simulated damage: by hash, of so many records one has its middle byte changed, one is lost and one is longer by a byte."""
    half = F.floor(F.octet_length("record") / 2).cast("int")
    lot = F.conv(F.substring(F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long") % one_in
    other = F.when(F.substring(F.col("record"), half, F.lit(1)) == F.lit(b"#"), F.lit(b"%")).otherwise(F.lit(b"#"))
    start, stop = F.substring(F.col("record"), F.lit(1), half - 1), F.octet_length("record")
    rot = F.concat(start, other, F.substring(F.col("record"), half + 1, stop))
    longer = F.concat(start, other, F.substring(F.col("record"), half, stop))
    return archive.where(lot != 1).withColumn("record", F.when(lot == 0, rot).when(lot == 2, longer).otherwise(F.col("record")))


def fixity(pages: DataFrame, one_in: int = 64) -> DataFrame:
    """Archives pages, writes a replica with simulated damage as WARC files in shared storage, reads them back and audits them."""
    archive = page_records(pages)
    files = write_warc(damaged(archive, one_in), new_path(pages.sparkSession))
    return audit(leaves(archive), leaves_of_files(files))
