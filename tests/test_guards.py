"""Guards that refuse, wide contracts, recipes, provenance, sinks and streams."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegate.functions import encode
from tidegate.functions.clock import MINUTE
from tidegate.operators import feed as fd
from tidegate.operators import provenance, wide
from tidegate.plans import evaluate, models, policy
from tidegate.sources import archive
from tidegate.streaming import pending as streams

from .test_temporal import ROWS, asks, frame  # noqa: F401  a fixture

POLICY = {"arrival": {"p": 1.0}, "departure": {"p": 1.0}, "auxiliary": "b", "auxiliary_weight": 0.5, "rule": {"cap": 10.0}}


def test_deployment_guard(spark):
    df = spark.createDataFrame([(100 * MINUTE, 70 * MINUTE, 60 * MINUTE, 1)], "t long, cut long, act long, n int")
    assert policy.require_deployable(df, "t", "cut", 100 * MINUTE, {"act": 0}, {"act": ["n"]}).count() == 1
    with pytest.raises(ValueError, match="less than 30"):
        policy.require_deployable(df.withColumn("cut", F.col("cut") + 1), "t", "cut", 0)
    with pytest.raises(ValueError, match="less than 30"):
        policy.require_deployable(df.withColumn("cut", F.lit(None).cast("long")), "t", "cut", 0)
    with pytest.raises(ValueError, match="before the model"):
        policy.require_deployable(df, "t", "cut", 100 * MINUTE + 1)
    for act in (F.col("cut"), F.lit(None).cast("long")):
        with pytest.raises(ValueError, match="act"):
            policy.require_deployable(df.withColumn("act", act), "t", "cut", 0, {"act": 0}, {"act": ["n"]})
    with pytest.raises(ValueError, match="lags"):
        policy.provenance_violations(df, "cut", {"act": -1})
    assert policy.deployable(df.limit(0), "t", "cut", 0).first() == (0, 0)


def test_invariants(spark):
    good = spark.createDataFrame(
        [(k, 100 * MINUTE * (k + 1), 100 * MINUTE * (k + 1) - 30 * MINUTE, 5, 1, True, 3, 3) for k in range(3)],
        "row_id long, prediction long, cut long, act long, history_count int, known boolean, n int, source_n int"
    ).withColumn("stop", F.lit(1))
    rules = policy.Invariants(rows=3, clocks=("act",), sources=("act",), masked=("stop",), same_run=(("source_n", "n"),))
    assert rules.require(good).count() == 3
    for name, change in {
        "row_id_in_range": ("row_id", F.lit(-1)), "row_id_known": ("row_id", F.lit(None).cast("long")),
        "row_id_unique": ("row_id", F.lit(1)), "snapshot_age": ("cut", F.col("prediction")), "before_cut:act": ("act", F.col("cut")),
        "history_has:act": ("act", F.lit(None).cast("long")), "masked_plan": ("known", F.lit(False)),
        "same_run:source_n": ("source_n", F.lit(4))
    }.items():
        with pytest.raises(ValueError, match=name):
            rules.require(good.withColumn(*change))
    assert policy.unordered(good).first().rows == 0
    assert policy.unordered(good.withColumn("prediction", -F.col("prediction"))).first().rows == 2
    with pytest.raises(ValueError, match="missing"):
        rules.violations(good.drop("cut"))


def test_recipe(spark, tmp_path):
    (tmp_path / "m.json").write_text("weights")
    import hashlib

    recipe = policy.Recipe("r", ("a", "b"), POLICY, {"m.json": hashlib.sha256(b"weights").hexdigest()})
    digest = recipe.write(str(tmp_path / "r.json"))
    assert policy.Recipe.load(str(tmp_path / "r.json"), str(tmp_path), digest) == recipe and recipe.digest() == digest
    with pytest.raises(ValueError, match="changed"):
        policy.Recipe.load(str(tmp_path / "r.json"), str(tmp_path), "0" * 64)
    body = json.loads((tmp_path / "r.json").read_text())
    for change in ({"name": "x"}, {"policy": POLICY | {"bias": 9.0}}):
        (tmp_path / "t.json").write_text(json.dumps(body | change))
        with pytest.raises(ValueError, match="changed"):
            policy.Recipe.load(str(tmp_path / "t.json"), str(tmp_path))
    policy.Recipe("r", ("a", "a"), POLICY, {}).write(str(tmp_path / "u.json"))
    with pytest.raises(ValueError, match="repeat"):
        policy.Recipe.load(str(tmp_path / "u.json"), str(tmp_path))
    policy.Recipe("r", ("a",), POLICY, {"../x": ""}).write(str(tmp_path / "v.json"))
    with pytest.raises(ValueError, match="directory"):
        policy.Recipe.load(str(tmp_path / "v.json"), str(tmp_path))
    (tmp_path / "m.json").write_text("other")
    with pytest.raises(ValueError, match="changed since"):
        policy.Recipe.load(str(tmp_path / "r.json"), str(tmp_path), digest)
    with pytest.raises(ValueError, match="not a policy"):
        policy.policy_of(POLICY | {"unknown": 1})


def test_replay(spark):
    df = spark.createDataFrame(
        [(k, float(k), 0.0, 1.0, None, None, 0, 0, None, None) for k in range(4)],
        "row_id long, p double, b double, is_departure double, previous_delay double, context_arrival_180m_max_delay double, history_count int, origin_actual_presence_count int, origin_720m_max_last_delay double, oldest_pending_minutes double"
    )
    rules = policy.policy_of(POLICY)
    saved = rules.apply(df).withColumn("saved", F.col("final")).drop("raw", "transformed", "final")
    policy.require_replay(saved, rules)
    for value in (F.col("saved") + 1e-3, F.lit(None).cast("double")):
        with pytest.raises(ValueError, match="2"):
            policy.require_replay(saved.withColumn("saved", F.when(F.col("row_id") == 2, value).otherwise(F.col("saved"))), rules)


def test_aligned_profiles(spark):
    a = spark.createDataFrame([(1, 1.0), (2, None)], "k long, v double")
    policy.require_aligned(a, a, "k", ["v"])
    for b in (a.where("k = 1"), a.fillna(0.0)):
        with pytest.raises(ValueError, match="differ"):
            policy.require_aligned(a, b, "k", ["v"])
    extra = spark.createDataFrame([(2, "x"), (3, "y")], "k long, w string")
    assert sorted(map(tuple, wide.aligned(a, extra, "k", ["w"]).collect())) == [(1, 1.0, None), (2, None, "x")]
    for bad, names in ((extra, ["w", "z"]), (extra.withColumn("z", F.lit(1)), ["w"]), (extra, ["v"])):
        with pytest.raises(ValueError):
            wide.aligned(a, bad, "k", names)


def test_wide_contracts(frame):  # noqa: F811
    f = frame(ROWS)
    q = asks(f, 3)
    t = wide.turnaround(q, f)
    assert t.columns == ["qid", *wide.turnaround_columns()] and len(t.columns) == 49
    assert t.first().home_context_arrival_60m_observed_count == 1 and t.first().home_context_arrival_60m_oldest_pending_minutes is not None
    o = wide.origin(q, f)
    assert o.columns == ["qid", *wide.origin_columns()] and len(wide.origin_columns(reverse=False)) == 28 and len(o.columns) == 43
    assert o.first().origin_context_route_known == 1.0 and o.first().origin_context_180m_count == 0
    r = wide.readiness(q, f)
    assert r.columns == ["qid", *wide.readiness_columns()] and len(r.columns) == 25 and r.first().ready_own_count is None
    unknown = wide.origin(q.withColumn("st", F.lit(5)), f).first()
    assert unknown.origin_context_route_known is None and unknown.origin_context_180m_count is None


def test_provenance_is_before_the_cut(frame):  # noqa: F811
    """Every family's stamps are before the cut, and a fact at the cut changes none of them."""
    f = frame(ROWS)
    q = asks(f, 3)
    cut = q.first().cut
    late = f.unionByName(frame([(27, 370, "ARRIVAL", cut - 5 * MINUTE, cut, 9.0)]).withColumn("ord", F.lit(99).cast("long")))
    for family in (provenance.network, provenance.turnaround, provenance.origin, provenance.readiness):
        got = family(q, f).first()
        stamps = [getattr(got, c) for c in got.__fields__ if c.startswith("latest")]
        assert all(s is None or s < cut for s in stamps)
        assert family(q, late).first().latest_act == got.latest_act
        assert family(q.limit(0), f).count() == 0
    t = provenance.turnaround(q, f).first()
    assert t.used_act > 0 and t.used_acc > t.used_act


def test_order_does_not_depend_on_partitions(spark):
    rows = [("2024-01-01", 1, 10, "ARRIVAL", "2024-01-01T10:00:00Z", f"2024-01-01T10:0{k}:00Z", float(k)) for k in range(8)]
    df = spark.createDataFrame(
        rows,
        "departureDate string, trainNumber long, stationUICCode int, type string, scheduledTime string, actualTime string, differenceInMinutes double"
    )
    got = {fd.one_of(fd.reports_of(df.repartition(n)), fd.KEY).first().delay for n in (1, 3, 8)}
    assert len(got) == 1


def test_purge_takes_all_folds(spark):
    df = spark.range(110).select(F.col("id").alias("row_id"), F.col("id").alias("t"), F.col("id").alias("act"), F.col("id").alias("cut"))
    folds = evaluate.expanding(df, 110, 10)
    got = evaluate.purged(folds, folds).groupBy("fold").count().collect()
    assert {r.fold: r["count"] for r in got} == {k: 10 + 10 * k for k in range(10)}
    assert evaluate.purged(folds, folds.where("fold < 0")).count() == 0


def test_audit_in_one_scan(spark):
    df = spark.createDataFrame([(1, 2.0, None), (3, None, None)], "a long, b double, c double")
    got = {r.name: (r.n, r["mean"], r.q50, r.least, r.most) for r in evaluate.audit_summary(df, ["a", "b", "c"]).collect()}
    assert got == {"a": (2, 2.0, 2.0, 1.0, 3.0), "b": (1, 2.0, 2.0, 2.0, 2.0), "c": (0, None, None, None, None)}


def test_trees_are_saved(spark, tmp_path):
    df = spark.range(80).select(
        (F.col("id") % 7).cast("double").alias("x"), F.when(F.col("id") % 3 != 0, F.col("id") % 5).alias("z"),
        (F.col("id") % 7 * 2.0).alias("y")
    )
    model = models.Boosted(["x", "z"], maxIter=2, maxDepth=2).fit(df, "y")
    model.save(str(tmp_path / "b"))
    again = models.load(str(tmp_path / "b"))
    assert again.features == ["x", "z"] and again.predict(df).collect() == model.predict(df).collect()
    ridge = models.Ridge(models.Preparation(["x"])).fit(df, "y")
    ridge.save(str(tmp_path / "r.json"))
    assert models.load(str(tmp_path / "r.json")).coefficients == ridge.coefficients
    x = np.array([[1.0, k % 7 / np.std([j % 7 for j in range(80)]), 0.0] for k in range(80)])
    want = np.linalg.lstsq(x.T @ x + np.diag([0.0, 1.0, 1.0]), x.T @ np.array([k % 7 * 2.0 for k in range(80)]), rcond=None)[0]
    assert np.allclose(ridge.coefficients, want)
    with pytest.raises(ValueError, match="levels"):
        models.Preparation([], ["id"]).fit(spark.range(models.MOST_LEVELS + 1))


def test_matrix_of_each_family(spark):
    df = spark.createDataFrame([(1, 5.0, "2.5"), (2, None, None), (3, float("nan"), "-1")], "k long, c double, x string")
    got = {f: [tuple(r) for r in models.matrix(df, f, ["c", "x"], ["c"], ["k"]).orderBy("k").collect()] for f in models.CATEGORIES}
    assert got["ridge"] == got["neural"] == got["xgboost"] == [(1, 5.0, 2.5), (2, None, None), (3, None, -1.0)]
    assert got["catboost"] == [(1, "5", 2.5), (2, "missing", None), (3, "missing", -1.0)]
    assert got["lightgbm"] == [(1, "5", 2.5), (2, None, None), (3, None, -1.0)]
    with pytest.raises(ValueError, match="family"):
        models.matrix(df, "other", ["c"])
    with pytest.raises(ValueError, match="missing"):
        models.matrix(df, "ridge", ["y"])
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        models.matrix(df.withColumn("x", F.lit("word")), "ridge", ["x"]).collect()


def test_small_helpers(spark, frame):  # noqa: F811
    """Runs kept or left out, the first decision of a key, weights of days that add up."""
    f = frame(ROWS)
    runs = f.where("n = 23").select(*fd.RUN)
    assert {r.n for r in fd.semi_by_run(f, runs).collect()} == {23} and 23 not in {r.n for r in fd.semi_by_run(f, runs, False).collect()}
    told = f.where("ord = 0").select(*fd.KEY)
    decisions = told.withColumns({"ready": F.lit(5).cast("long"), "ord": F.lit(2)}).unionByName(
        told.withColumns({"ready": F.lit(7).cast("long"), "ord": F.lit(1)})
    )
    got = {r.ord: r.ready for r in archive.with_readiness(f, decisions).collect()}
    assert got[0] == 7 and all(v is None for k, v in got.items() if k)
    weights = evaluate.bootstrap_weights(30, 50)
    assert weights.shape == (50, 30) and (weights.sum(axis=1) == 30).all() and (weights == evaluate.bootstrap_weights(30, 50)).all()


def test_arrays(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5), (2, 1.5)], "k long, v double")
    archive.write_arrays(df, str(tmp_path / "a.npz"), ["k", "v"])
    assert sorted(map(tuple, archive.read_arrays(spark, str(tmp_path / "a.npz")).collect())) == [(1, 0.5), (2, 1.5)]
    with pytest.raises(ValueError, match="more than"):
        archive.write_arrays(df, str(tmp_path / "b.npz"), ["k"], most=1)


FLAT = """<c:FeatureCollection xmlns:c="u"><c:member><o:Observation xmlns:o="v" xmlns:l="w"><o:observedProperty l:href="https://x/m?param=t2m"/><identifier>7</identifier>
<TVPs><MeasurementTVP><time>2020-01-02T10:00:00+02:00</time><value>-3.5</value></MeasurementTVP></TVPs></o:Observation></c:member></c:FeatureCollection>"""


def test_weather_members_of_any_kind(spark):
    df = spark.createDataFrame([(FLAT,), (None,), ('<FeatureCollection xmlns="u"/>',)], "x string")
    assert [tuple(r) for r in archive.weather_xml(df, "x", 7, ["t2m"]).collect()] == [("t2m", 1577952000_000000, -3.5, 7)]
    for bad in (
        "<html><body>Error</body></html>", "not XML", "", FLAT.replace("<identifier>7</identifier>", ""), FLAT.replace("?param=t2m", ""),
        "<!DOCTYPE a><FeatureCollection/>"
    ):
        with pytest.raises(Exception, match="not a feature collection|a member without"):
            archive.weather_xml(spark.createDataFrame([(bad,)], "x string"), "x").collect()


def test_retry_after():
    assert archive.wait_of(None, 3) == 8.0 and archive.wait_of("7", 0) == 7.0 and archive.wait_of("junk", 1) == 2.0
    assert archive.wait_of("Thu, 01 Jan 1970 00:01:40 GMT", 0, now=40.0) == 60.0 and archive.wait_of("9999", 0) == 300.0 and archive.wait_of("-5", 0) == 0.0


def test_http_client(tmp_path):
    """A refused request waits as long as the server says; the answer is kept with its hash and not asked for again."""
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    asked = []

    class Server(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            self.send_response(503 if len(asked) == 1 else 200)
            self.send_header("Retry-After", "7")
            self.end_headers()
            self.wfile.write(b"<x/>")

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    waits = []
    get = archive.http_get(lambda w: f"http://127.0.0.1:{server.server_port}/?from={w[0]}&to={w[1]}")
    for _ in range(2):
        assert archive.fetch_cached((1, 2), str(tmp_path), get, sleep=waits.append) == b"<x/>"
    assert waits == [7.0] and asked == ["/?from=1&to=2"] * 2
    (tmp_path / "1_2.xml").write_bytes(b"damaged")
    assert archive.fetch_cached((1, 2), str(tmp_path), get) == b"<x/>" and len(asked) == 3
    server.shutdown()


def test_scenarios():
    assert list(encode.SCENARIOS) == [
        n for n in encode.CATEGORY_NAMES[1:] if n != "Freezing Rain" and n != "Black Ice"
    ][:4] + ["Freezing Rain", "Black Ice"] + encode.CATEGORY_NAMES[7:]
    with pytest.raises(ValueError):
        encode.weather_category("other")


def test_streams(spark, tmp_path):
    """Sessions and the interval join of streams, driven by files."""
    rows = [("2024-01-01", 1, 10, "ARRIVAL", 0, f"2024-01-01 10:{m:02d}:00", float(m)) for m in (0, 10, 50)] + [
        ("2024-01-01", 1, 10, "ARRIVAL", 0, "2024-01-02 10:00:00", 5.0), ("2024-01-01", 2, 10, "ARRIVAL", 0, "2024-01-09 10:00:00", 1.0)
    ]
    df = spark.createDataFrame(
        rows, "d string, n long, st int, ty string, s long, at string, delay double"
    ).select("d", "n", "st", "ty", "s", F.to_timestamp("at").alias("known_at"), "delay")
    for k, part in enumerate((df.where("n = 1"), df.where("n = 2"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "r"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "r"))
    got = streams.run_to_end(streams.run_sessions(stream, gap="30 minutes")).collect()
    assert sorted((r.n, r.events, r.mean_delay) for r in got)[:3] == [(1, 1, 5.0), (1, 1, 50.0), (1, 2, 5.0)]
    plan = stream.select("d", "n", "st", "ty", "s", F.col("known_at").alias("planned_at")).where("delay in (0.0, 50.0)")
    both = streams.run_to_end(streams.reports_within(plan, stream, 2)).where("delay is not null").collect()
    assert sorted((r.planned_at.minute, r.delay) for r in both) == [(0, 0.0), (0, 10.0), (0, 50.0), (50, 50.0)]
