import json

import pytest
from pyspark.sql import functions as F

from tidegate.functions import encode
from tidegate.operators import ingest
from tidegate.plans import evaluate, models, policy
from tidegate.sources import archive
from tidegate.streaming import pending as st

WX = [
    "Air temperature", "Precipitation amount", "Precipitation intensity", "Wind speed", "Gust speed", "Relative humidity",
    "Dew-point temperature", "Snow depth", "Horizontal visibility"
]


def test_weather_categories(spark):
    cases = [((-1, 4, 0, 11, 0, 0, 0, 0, 500), "Blizzard"), ((-1, 6, 0, 0, 0, 0, 0, 1, 5000), "Heavy Snow"), ((-21, 0, 0, 0, 0, 0, 0, 0, 5000), "Extreme Cold"), ((3, 11, 0, 0, 0, 0, 0, 0, 5000), "Heavy Rain"), ((0, 1, 0, 0, 0, 0, 0, 0, 5000), "Freezing Rain"),
             ((2, 1, 0, 0, 0, 90, 2, 0, 5000), "Normal Clear"), ((5, 0, 0, 0, 0, 96, 0, 0, 500), "Dense Fog"), ((5, 0, 0, 16, 0, 0, 0, 0, 5000), "High Winds"), ((31, 0, 0, 0, 0, 0, 0, 0, 5000), "Extreme Heat"), ((None,) * 9, "Normal Clear"), ((float("nan"),) * 9, "Normal Clear")]
    df = spark.createDataFrame([tuple(float(x) if x is not None else None for x in c) for c, _ in cases], ", ".join(f"`{w}` double" for w in WX))
    assert [r[0] for r in df.select(encode.weather_category()).collect()] == [c for _, c in cases]
    ice = df.limit(6).select(encode.weather_category("author-legacy").alias("a"), encode.weather_category("author-current").alias("b")).collect()[5]
    assert (ice.a, ice.b) == ("Freezing Rain", "Freezing Rain")
    with pytest.raises(ValueError):
        encode.weather_category("other")
    assert [len(v) for v in encode.feature_sets().values()] == [26, 16, 18] and [len(v) for v in encode.feature_sets(True, True).values()] == [28, 18, 19]


def test_study_features(spark):
    row = spark.createDataFrame(
        [(1704628800_000000, 7, True, *([1.0] * 9))],
        "us long, trainNumber int, trainStopping boolean, " + ", ".join(f"`{w}` double" for w in WX)
    )
    r = encode.study_features(row, F.col("us")).first()  # a Sunday at 12:00
    assert abs(r.hour_cos + 1) < 1e-9 and abs(r.day_week_sin - 0.781831) < 1e-5 and r.train_id == 7.0 and r.trainStopping == 1.0
    assert sum(r[c] for c in encode.CATEGORIES) == 1


def test_metrics(spark):
    df = spark.createDataFrame([(-2.0, -1.0), (0.0, 1.0), (2.0, 1.0), (4.0, 3.0)], "y double, p double")
    m = evaluate.metrics(df).first()
    assert (m.mae, m.rmse, round(m.r2, 9), m.wmape, m.wmape_signed) == (1.0, 1.0, 0.8, 50.0, 100.0)
    assert evaluate.metrics(df.where("y = 0")).first().wmape is None


def test_folds(spark):
    df = spark.range(120).select(F.col("id").alias("row_id"), F.when(F.col("id").between(38, 42), 40).otherwise(F.col("id")).alias("t"))
    f = evaluate.expanding(df, 120, 5)
    sizes = {r.fold: r["count"] for r in f.groupBy("fold").count().collect()}
    assert sizes == {-1: 20, 0: 18, 1: 22, 2: 20, 3: 20, 4: 20}
    p = evaluate.purged(f.withColumn("act", F.col("t") + 3).withColumn("cut", F.col("t") - 1), f.withColumn("cut", F.col("t") - 1))
    assert {r.fold: r["count"] for r in p.groupBy("fold").count().collect()} == {0: 16, 1: 36, 2: 56, 3: 76, 4: 96}
    with pytest.raises(ValueError):
        evaluate.expanding(df, 4, 5)
    assert evaluate.sampled_parameters({"a": [1, 2, 3], "b": [4, 5]}, 5) == evaluate.sampled_parameters({"a": [1, 2, 3], "b": [4, 5]}, 9)[:5]


def test_impute_and_scale(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", 5.0), ("a", None), ("b", 1.0), ("b", None)], "g string, v double")
    assert sorted((r.g, r.v or -1) for r in evaluate.impute(df, "g", ["v"]).collect()) == [("a", 1.0), ("a", 3.0), ("a", 3.0), ("a", 5.0), ("b", -1), ("b", -1)]
    train = spark.createDataFrame([(float(k), 5.0) for k in range(5)], "x double, c double")
    assert [tuple(r) for r in evaluate.robust_scale(train, train, ["x", "c"]).orderBy("x").collect()][0] == (-1.0, 0.0)


def test_policy(spark):
    cols = "history_count long, is_departure double, oldest_pending_minutes double, previous_delay double, context_arrival_180m_max_delay double, origin_actual_presence_count long, origin_720m_max_last_delay double, a double, b double"
    df = spark.createDataFrame(
        [
            (0, 1.0, 0.0, None, None, 0, None, 50.0, 0.0), (2, 0.0, 300.0, 5.0, None, 0, None, 50.0, 0.0),
            (0, 1.0, 0.0, None, None, 1, 130.0, 50.0, 0.0), (1, None, 0.0, -1.0, 30.0, 0, None, 400.0, 100.0)
        ],
        cols
    )
    p = policy.Policy({"a": 1.0}, {"a": 0.5, "b": 0.5}, "b", 0.25, 1.0, 0.5, tail_scale=2.0, tail=100.0, rule=policy.Rule(20.0, 240.0, 1.5))
    assert [r.final for r in p.apply(df).collect()] == [20.0, 450.0, 26.0, (401 * 0.5 * 0.75 + 25) * 2]
    for bad in ({"arrival": {"a": 0.5}}, {"auxiliary_weight": 1.0}, {"tail_scale": 0.0}, {"bias": float("nan")}):
        with pytest.raises(ValueError):
            policy.Policy(**({"arrival": {"a": 1.0}, "departure": {"a": 1.0}, "auxiliary": "b", "auxiliary_weight": 0.5} | bad))
    with pytest.raises(ValueError):
        policy.Rule(threshold=1.0)
    assert len(policy.rule_grid()) == 60


def test_provenance(spark):
    df = spark.createDataFrame([(100, 99, 1), (100, 100, 0), (100, None, 2)], "cut long, t long, c long")
    r = policy.provenance_violations(df, "cut", {"t": 0}, {"t": ["c"]}).first()
    assert (r.late, r.missing) == (1, 1)
    with pytest.raises(ValueError, match="too new"):
        policy.require_provenance(df, "cut", {"t": 0})
    with pytest.raises(ValueError, match="undeclared"):
        policy.provenance_violations(df, "cut", {"t": 0}, {"u": ["c"]})


def test_models(spark, tmp_path):
    df = spark.range(400).select(
        F.col("id"), (F.col("id") % 17).cast("double").alias("x"),
        F.when(F.col("id") % 5 != 0, (F.col("id") % 7).cast("double")).alias("z"), (F.col("id") % 3).cast("int").alias("c")
    )
    df = df.withColumn("y", 2 * F.col("x") + 3 * F.coalesce("z", F.lit(3.0)) + 5 * (F.col("c") == 1).cast("double"))
    ridge = models.Ridge(models.Preparation(["x", "z"], ["c"]), 1e-3).fit(df, "y")
    assert ridge.predict(df).agg(F.max(F.abs(F.col("prediction") - F.col("y")))).first()[0] < 0.1
    ridge.save(str(tmp_path / "m.json"))
    again = models.Ridge.load(str(tmp_path / "m.json"))
    assert again.coefficients == ridge.coefficients
    net = models.Network(models.Preparation(["x"]), 8, 25).fit(df, "y")
    var = df.agg(F.var_pop("y")).first()[0]
    assert net.predict(df).agg(F.avg((F.col("prediction") - F.col("y")) ** 2)).first()[0] < var
    boost = models.boosted(df, ["x", "z", "c"], "y", maxIter=3, maxDepth=3)
    assert boost(df).agg(F.avg((F.col("prediction") - F.col("y")) ** 2)).first()[0] < var


def test_readiness_messages(spark):
    raw = [
        '{"accepted": true, "timestamp": "2024-01-01T10:00:00.000Z"}',
        "{'accepted': True, 'source': None, 'timestamp': '2024-01-01T12:00:00+02:00'}",
        '{"accepted": false, "timestamp": "2024-01-01T10:00:00Z"}', "nan", None, "5", '{"accepted": true}', "__import__('os')",
        '{"accepted": true, "timestamp": "2024-01-01"}', '{"accepted": "true", "timestamp": "2024-01-01T10:00:00Z"}'
    ]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(raw)], "k long, r string")
    got = {r.k: (r.ready, r.malformed) for r in archive.readiness(df, "r").collect()}
    ten = 1704103200_000000
    assert got == {
        0: (ten, False), 1: (ten, False), 2: (None, False), 3: (None, False), 4: (None, False), 5: (None, False), 6: (None, True),
        7: (None, True), 8: (None, True), 9: (None, False)
    }
    assert archive.readiness(df, "r", ten).where("ready is not null").count() == 0


XML = """<?xml version="1.0"?><wfs:FeatureCollection xmlns:wfs="http://www.opengis.net/wfs/2.0" xmlns:om="http://www.opengis.net/om/2.0" xmlns:omso="http://inspire.ec.europa.eu/schemas/omso/3.0" xmlns:gml="http://www.opengis.net/gml/3.2" xmlns:wml2="http://www.opengis.net/waterml/2.0" xmlns:xlink="http://www.w3.org/1999/xlink" xmlns:sams="s" xmlns:sam="t" xmlns:target="u">
<wfs:member><omso:PointTimeSeriesObservation><om:observedProperty xlink:href="http://x/meta?observableProperty=observation&amp;param=t2m&amp;language=eng"/><om:featureOfInterest><sams:SF_SpatialSamplingFeature><sam:sampledFeature><target:LocationCollection><target:member><target:Location><gml:identifier codeSpace="c">101799</gml:identifier></target:Location></target:member></target:LocationCollection></sam:sampledFeature></sams:SF_SpatialSamplingFeature></om:featureOfInterest>
<om:result><wml2:MeasurementTimeseries><wml2:point><wml2:MeasurementTVP><wml2:time>{t}</wml2:time><wml2:value>1.5</wml2:value></wml2:MeasurementTVP></wml2:point><wml2:point><wml2:MeasurementTVP><wml2:time>2020-01-01T11:00:00Z</wml2:time><wml2:value>NaN</wml2:value></wml2:MeasurementTVP></wml2:point></wml2:MeasurementTimeseries></om:result></omso:PointTimeSeriesObservation></wfs:member></wfs:FeatureCollection>"""


def test_weather_xml(spark):
    df = spark.createDataFrame([(XML.format(t="2020-01-01T10:00:00Z"),)], "x string")
    rows = archive.weather_xml(df, "x", 101799, ["t2m"]).orderBy("t").collect()
    assert [(r.parameter, r.station, r.value) for r in rows][0] == ("t2m", 101799, 1.5) and rows[0].t == 1577872800_000000 and len(rows) == 2
    for bad in ({"station": 5}, {"parameters": ["other"]}):
        with pytest.raises(Exception, match="unexpected"):
            archive.weather_xml(df, "x", **bad).collect()
    with pytest.raises(Exception, match="zone"):
        archive.weather_xml(spark.createDataFrame([(XML.format(t="2020-01-01T10:00:00"),)], "x string"), "x").collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "k long, v string")
    archive.write_profile(df, str(tmp_path / "p"), {"source": "x"})
    again, manifest = archive.read_profile(spark, str(tmp_path / "p"))
    assert again.collect() == df.collect() and manifest["columns"] == ["k", "v"]
    for kind in ("csv", "json"):
        archive.write_table(df, str(tmp_path / kind), kind)
    assert archive.content_hashes(spark, str(tmp_path / "csv" / "*.csv")).first().bytes > 0
    assert archive.merge_manifests({"a": [1], "b": {"c": 1}}, {"a": [1, 2], "b": {"d": 2}, "e": 3}) == {"a": [1, 2], "b": {"c": 1, "d": 2}, "e": 3}
    with pytest.raises(ValueError):
        archive.merge_manifests({"a": 1}, {"a": 2})
    log = archive.SearchLog(str(tmp_path / "s"), {"seed": 1})
    assert len(log.run([1, 2], lambda c: c * 2)) == 2
    assert len(archive.SearchLog(str(tmp_path / "s"), {"seed": 1}).run([1, 2, 3], lambda c: 0)) == 3
    with pytest.raises(ValueError):
        archive.SearchLog(str(tmp_path / "s"), {"seed": 2})
    calls = []

    def get(window):
        calls.append(window)
        if len(calls) == 1:
            raise OSError("busy")
        return b"x"

    w = archive.weekly_windows(0, 10 * 86_400_000_000)
    assert len(w) == 2 and archive.fetch_cached(
        w[0], str(tmp_path / "c"), get, sleep=lambda s: None
    ) == archive.fetch_cached(w[0], str(tmp_path / "c"), get) == b"x" and len(calls) == 2


def test_month_files(spark, tmp_path):
    for name, k in (("matched_data_flat_2018_01", 1), ("matched_data_flat_2017_12", 2), ("other", 3)):
        spark.createDataFrame([(k, k)], "k long, z long").coalesce(1).write.parquet(str(tmp_path / "raw" / name))
        part = next((tmp_path / "raw" / name).glob("*.parquet"))
        (tmp_path / "in").mkdir(exist_ok=True)
        part.rename(tmp_path / "in" / f"{name}.parquet")
    got = ingest.month_files(spark, str(tmp_path / "in"), 2018, 2024, 1, ["k"]).collect()
    assert [(r.k, r.source_file) for r in got] == [(1, "matched_data_flat_2018_01.parquet")]
    with pytest.raises(ValueError):
        ingest.month_files(spark, str(tmp_path / "in"), 2018, 2024, 84)


def test_streams(spark, tmp_path):
    rows = [{"d": "2024-01-01", "n": 1, "s": s, "done": done} for s, done in ((10, False), (20, False), (30, False), (20, True))]
    (tmp_path / "a.json").write_text("\n".join(map(json.dumps, rows)))
    stream = spark.readStream.schema("d date, n long, s long, done boolean").json(str(tmp_path))
    got = st.run_to_end(st.pending(stream), mode="update").collect()
    assert [(r.n, r.pending_count, r.oldest_scheduled, r.done_until) for r in got] == [(1, 1, 30, 20)]
    ev = [{"st": 1, "known_at": f"2024-01-01T1{h}:05:00", "delay": float(h), "k": h // 2} for h in range(8)]
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "b.json").write_text("\n".join(map(json.dumps, ev)))
    s2 = spark.readStream.schema("st int, known_at timestamp, delay double, k int").json(str(tmp_path / "b"))
    w = st.run_to_end(st.station_windows(s2))
    assert w.count() > 0 and w.agg(F.max("n")).first()[0] == 3
    assert st.run_to_end(st.once(s2, ["k"])).count() == 4
