import gzip
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tidegate.llm import warc


def brute(first, second):
    """page_id -> status by comparing records one by one; ids are keys."""
    out = {}
    for i in first.keys() | second.keys():
        out[i] = "extra" if i not in first else "lost" if i not in second else "intact" if first[i] == second[i] else "changed"
    return out


def offsets(recs, ids):
    at, out = {}, {}
    for i in sorted(ids):
        out[i] = at.get(i >> 12, 0)
        at[i >> 12] = out[i] + len(recs[i])
    return out


def test_audit_against_brute_force(spark):
    """Pages archived, damaged (changed, lost, longer), written as WARC files, read and audited."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    archive = warc.page_records(pages)
    first = {r.page_id: bytes(r.record) for r in archive.collect()}
    second = {r.page_id: bytes(r.record) for r in warc.damaged(archive, 16).collect()}
    rows = warc.fixity(pages, 16).collect()
    got = {r.page_id: r for r in rows}
    want = brute(first, second)
    assert len(rows) == len(want) and {"changed", "lost", "intact"} == set(want.values())
    assert {i: r.status for i, r in got.items()} == want
    one, two = offsets(first, first), offsets(second, second)
    for i, r in got.items():
        assert r.record_sha256 == hashlib.sha256(first[i]).hexdigest() and r.length == len(first[i]) and r.offset == one[i]
        assert r.intact == (r.status == "intact") and r.shard == i >> 12
        if r.status == "changed":
            assert (r.replica_sha256, r.replica_length, r.replica_offset) == (hashlib.sha256(second[i]).hexdigest(), len(second[i]), two[i])
        else:
            assert r.replica_sha256 is None


def archive_of(spark, recs):
    return spark.createDataFrame([(i, bytearray(r)) for i, r in recs], "page_id long, record binary")


@pytest.mark.parametrize("what", ["lost", "extra", "longer", "flipped", "none", "all"])
def test_one_record(spark, what):
    """One lost, extra, resized or flipped record of a full shard is named, and none beside it."""
    first = {i: b"record %d" % i for i in range(0, 9000, 3)}
    second = dict(first)
    if what in ("lost", "all"):
        del second[36]
    if what in ("extra", "all"):
        second[37] = b"new"
    if what in ("longer", "all"):
        second[4200] += b"more"
    if what in ("flipped", "all"):
        second[8997] = b"recorD 8997"
    got = warc.audit(*(warc.leaves(archive_of(spark, x.items())) for x in (first, second)))
    assert {r.page_id: r.status for r in got.collect()} == brute(first, second)


def test_descends_only_where_roots_differ(spark):
    first = {i: b"record %d" % i for i in range(0, 40000, 7)}
    second = {**first, 20006: b"x"}
    a, b = (warc.tree(warc.leaves(archive_of(spark, x.items()))) for x in (first, second))
    assert [r.key for r in warc.descend(a, b).collect()] == [20006]
    for level in range(warc.LEVELS + 1):
        x, y = ({r.key: r.digest for r in t[level].collect()} for t in (a, b))
        assert [k for k in x if x[k] != y[k]] == [20006 >> 4 * level]


def test_files(spark, tmp_path):
    """Records come back from files as they were written; gzipped or not, after junk, with wrong lengths, in damaged members."""
    recs = [b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Length: 3\r\n\r\nab%d\r\n\r\n" % (i, i) for i in range(6)]
    for parts in (1, 4):
        files = warc.write_warc(archive_of(spark, enumerate(recs)).repartition(parts), f"{tmp_path}/w{parts}")
        assert files.agg(F.sum("records")).first()[0] == 6
        assert sorted(r.block for r in warc.read_warc(files).collect()) == [b"ab%d" % i for i in range(6)]
        assert sorted(
            (r.page_id, r.digest, r.length) for r in warc.leaves_of_files(files).collect()
        ) == [(i, hashlib.sha256(r).hexdigest(), len(r)) for i, r in enumerate(recs)]
    at = tmp_path / "x"
    at.mkdir()
    (at / "plain.warc").write_bytes(b"junk\n" + b"".join(recs))
    (at / "gz.warc.gz").write_bytes(b"".join(map(gzip.compress, recs)))
    (at / "length.warc").write_bytes(recs[0] + recs[1].replace(b"Length: 3", b"Length: 9") + recs[2].replace(b"Length: 3", b"Length: 99999") + recs[3])
    members = [gzip.compress(r) for r in recs]
    members[2] = members[2][:30] + b"\xff\xff\xff" + members[2][33:]
    (at / "rot.warc.gz").write_bytes(b"".join(members))
    got = {}
    for r in warc.read_warc(warc.files_at(spark, str(at))).collect():
        got.setdefault(r.file.rpartition("/")[2], []).append((r.offset, r.record_id, r.block))
    assert [x[2] for x in got["plain.warc"]] == [x[2] for x in got["gz.warc.gz"]] == [b"ab%d" % i for i in range(6)]
    assert [x[0] for x in got["plain.warc"]] == [5 + len(recs[0]) * i for i in range(6)]
    assert [x[2] for x in got["length.warc"]] == [b"ab0", b"ab1", b"ab2", b"ab3"]
    assert {b"ab0", b"ab1", b"ab3", b"ab4", b"ab5"} <= {x[2] for x in got["rot.warc.gz"]}


def test_pieces():
    """Streams of any piece size give the same records."""
    recs = b"".join(b"WARC/1.1\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (n, b"x" * n) for n in (0, 1, 70_000, 5))
    for step in (1, 7, 4096, 1 << 20):
        data = recs if step > 1 else recs[-200:]
        got = [len(b) for _, _, b, _ in warc.records(warc.Source(iter([data[k : k + step] for k in range(0, len(data), step)])))]
        assert got == ([0, 1, 70_000, 5] if step > 1 else [5])
    packed = b"".join(zlib.compress(recs[k : k + 1000], wbits=31) for k in range(0, len(recs), 1000))
    import io

    assert b"".join(warc.inflated(io.BytesIO(packed))) == recs


def test_damaged_length_is_bounded(monkeypatch):
    """A length of terabytes costs the bytes ahead, not the rest of the file, and no other record; a record that holds records stays whole."""
    monkeypatch.setattr(warc, "AHEAD", 1 << 16)
    monkeypatch.setattr(warc, "PIECE", 1 << 12)
    rec = lambda body, n=None: b"WARC/1.1\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(body) if n is None else n, body)
    bodies = [b"%d " % i * 300 for i in range(2000)]
    nested = rec(b"inner") * 20
    data = rec(nested) + rec(b"damaged", 10**12) + b"".join(map(rec, bodies))
    given = 0

    def pieces():
        nonlocal given
        for k in range(0, len(data), 4096):
            given += 1
            yield data[k : k + 4096]

    source, most, got = warc.Source(pieces()), 0, []
    for _, _, block, _ in warc.records(source):
        got.append(block)
        most = max(most, len(source.held))
        if block == b"damaged":
            assert given * 4096 < 3 * (1 << 16)
    assert got == [nested, b"damaged", *bodies] and most < 3 * (1 << 16)


def test_edges(spark):
    rows = [(None, None, None), (None, "u", "x"), (1, None, "y"), (1, None, "y"), (2, "é\n", "é" * 40000), (-5, "u", "z"), (9_000_000, "u", "long " * 100_000)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, offset int")
    archive = warc.page_records(pages)
    same = warc.audit(warc.leaves(archive), warc.leaves(archive)).collect()
    assert len(same) == 7 and all(r.intact for r in same)
    assert sorted(r.offset for r in same if r.page_id == 1) == [0, next(r.length for r in same if r.page_id == 1)]
    got = warc.fixity(pages).collect()
    assert len(got) >= 7 and {r.page_id for r in got} == {None, 1, 2, -5, 9_000_000}
    # Repeated rows: as many are intact as both have. Without id, a changed record is lost and extra.
    one = warc.leaves(archive_of(spark, [(1, b"a"), (1, b"a"), (1, b"b"), (None, b"c"), (None, b"d")]))
    two = warc.leaves(archive_of(spark, [(1, b"a"), (1, b"x"), (None, b"c"), (None, b"D")]))
    got = sorted((r.page_id or 0, r.status, r.length or r.replica_length) for r in warc.audit(one, two).collect())
    assert got == [(0, "extra", 1), (0, "intact", 1), (0, "lost", 1), (1, "changed", 1), (1, "intact", 1), (1, "lost", 1)]
    assert warc.fixity(pages.limit(0)).count() == 0
    empty = warc.leaves(archive.limit(0))
    assert {r.status for r in warc.audit(empty, warc.leaves(archive)).collect()} == {"extra"}
    assert {r.status for r in warc.audit(warc.leaves(archive), empty).collect()} == {"lost"}
