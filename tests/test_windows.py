import json
import threading
from email.utils import formatdate
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from time import time

import pytest
from pyspark.sql import functions as F

from tidegate.sources import windows

WEEK = 7 * 86_400_000_000


@pytest.fixture
def server():
    """Refuses each week's first request: with a date, with seconds, or without a word."""
    asked, lock = [], threading.Lock()

    class Server(BaseHTTPRequestHandler):
        def do_GET(self):
            with lock:
                first = self.path not in asked
                asked.append(self.path)
                k = len(set(asked))
            body = f"<x>{self.path}</x>".encode()
            self.send_response(429 if first else 200)
            if first and k % 3:
                self.send_header("Retry-After", formatdate(time() + 1, usegmt=True) if k % 3 == 1 else "0")
            self.end_headers()
            self.wfile.write(b"" if first else body)

        def log_message(self, *args):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield s, asked
    s.shutdown()


def test_weekly_archive(spark, tmp_path, server):
    """A partition for a week; refusals are waited for; kept answers are not asked for again, damaged ones are."""
    s, asked = server
    url = f"http://127.0.0.1:{s.server_port}/?from={{start}}&to={{end}}"
    read = lambda: windows.weekly_archive(spark, url, 0, 3 * WEEK + 5_000_000, str(tmp_path / "cache"))
    df = read()
    assert df.rdd.getNumPartitions() == 4
    rows = {r.start_us: r for r in df.collect()}
    assert list(sorted(rows)) == [0, WEEK, 2 * WEEK, 3 * WEEK] and rows[3 * WEEK].end_us == 3 * WEEK + 5_000_000
    assert all(bytes(r.body) == f"<x>/?from={r.start_us // 10**6}&to={r.end_us // 10**6}</x>".encode() for r in rows.values())
    n = len(asked)
    assert n == 8 and df.where(F.sha2("body", 256) == F.col("sha256")).count() == 4 and len(asked) == n
    (tmp_path / "cache" / "objects" / rows[WEEK].sha256).write_bytes(b"damaged")
    assert {r.start_us: bytes(r.body) for r in read().collect()} == {k: bytes(r.body) for k, r in rows.items()} and len(asked) == n + 1
    assert windows.weekly_archive(spark, url, 5, 5, str(tmp_path / "cache")).count() == 0


def test_refused_for_good(spark, tmp_path):
    with pytest.raises(Exception, match="refused|URLError|Connection"):
        windows.weekly_archive(spark, "http://127.0.0.1:9/{start}{end}", 0, 1, str(tmp_path), tries=1).collect()
    with pytest.raises(Exception, match="options missing"):
        spark.read.format("weekly_archive").load().count()


def test_publish(spark, tmp_path):
    at = str(tmp_path / "t")
    one = spark.range(1000).withColumn("v", F.col("id") * 0.5).withColumn("s", F.when(F.col("id") % 3 != 0, F.concat(F.lit("é"), "id"))).repartition(3)
    assert windows.publish(one, at) == 1
    assert sorted(windows.read_published(spark, at).collect()) == sorted(one.collect()) and windows.verify_published(spark, at).count() == 0
    # A job whose task dies leaves the old version as it is.
    fail = one.withColumn("v", F.when(F.col("id") == 997, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        windows.publish(fail, at)
    assert windows.published_versions(at) == [1] and windows.read_published(spark, at).count() == 1000
    assert windows.publish(one.limit(0), at) == 2 and windows.read_published(spark, at).count() == 0
    assert windows.read_published(spark, at, 1).count() == 1000 and windows.read_published(spark, at).columns == one.columns
    with pytest.raises(ValueError, match="no version"):
        windows.read_published(spark, at, 9)


def test_blocks_tell_damage(spark, tmp_path, monkeypatch):
    at = tmp_path / "t"
    windows.publish(spark.range(20_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("h")).coalesce(1), str(at))
    m = json.loads((at / "manifests" / "00000001.json").read_text())
    file = at / "data" / m["files"][0]["file"]
    data = file.read_bytes()
    import hashlib

    assert m["files"][0]["sha256"] == hashlib.sha256(data).hexdigest() and m["files"][0]["rows"] == 20_000
    # Blocks of 4096 bytes, as a file of more than two thousand million bytes has blocks of 8 million.
    m["block"], m["files"][0]["blocks"] = 4096, [hashlib.sha256(data[k : k + 4096]).hexdigest() for k in range(0, len(data), 4096)]
    (at / "manifests" / "00000001.json").write_text(json.dumps(m))
    assert windows.verify_published(spark, str(at)).count() == 0
    file.write_bytes(data[:9000] + bytes([data[9000] ^ 1]) + data[9001:])
    assert [r.block for r in windows.verify_published(spark, str(at)).collect()] == [2]
    file.write_bytes(data[:-1])
    assert [r.block for r in windows.verify_published(spark, str(at)).collect()] == [-1]
    file.unlink()
    assert [r.block for r in windows.verify_published(spark, str(at)).collect()] == [-1]


def test_hashing_in_blocks(monkeypatch, tmp_path):
    import hashlib

    monkeypatch.setattr(windows, "BLOCK", 10)
    for sizes in ([25], [3, 7, 10, 1, 4], [10, 10], []):
        data = bytes(range(sum(sizes)))
        with open(tmp_path / "f", "wb") as f:
            out, at = windows.Hashing(f), 0
            for n in sizes:
                out.write(data[at : at + n])
                at += n
            out.close()
        assert out.blocks == [hashlib.sha256(data[k : k + 10]).hexdigest() for k in range(0, len(data), 10)] and out.size == len(data)
        assert (tmp_path / "f").read_bytes() == data and out.whole.hexdigest() == hashlib.sha256(data).hexdigest()
