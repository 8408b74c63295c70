"""Operators on tables, files and grids that were added later, on small fixtures and against plain versions."""

import json
import math
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import Window
from pyspark.sql import functions as F

from lakestat.engine import Engine
from lakestat.functions import geo, scalar, text
from lakestat.operators import baseline, dashboard, history, ml, mutations, raster, relational, spatial
from lakestat.sources import readers
from lakestat.streaming import history as streaming

RING = "array<struct<lon:double,lat:double>>"


def square(x, y, w=1.0):
    x, y = float(x), float(y)
    return [(x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y)]


@pytest.fixture
def elsewhere(spark):
    """A session in another time zone."""
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    yield spark
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_instants_do_not_depend_on_the_session(elsewhere):
    shown = ["2024-05-18T05:26:49Z", "2024-05-18T05:26:49", "2024-05-18T10:56:49+05:30", "2024-05-18", "no", None]
    df = elsewhere.createDataFrame([(s,) for s in shown], "s string").select(F.unix_micros(text.utc(F.col("s"))).alias("t"), text.iso(text.utc(F.col("s"))).alias("i"))
    at = 1716010009 * 10**6
    assert [r.t for r in df.collect()] == [at, at, at, 1715990400 * 10**6, None, None]
    assert [r.i for r in df.collect()] == ["2024-05-18T05:26:49+00:00"] * 3 + ["2024-05-18T00:00:00+00:00", None, None]


def test_codes_and_days(spark):
    r = spark.sql("select 7 id, 'a/b\\\\c' name, '2024-01-02' d, ' ' none").select(text.body_code(F.col("id")), text.safe_name(F.col("name")), text.day_start(F.col("d")), text.day_end(F.col("d")), text.day_end(F.col("none"))).first()
    assert tuple(r) == ("WB_DB_7", "a_b_c", datetime(2024, 1, 2), datetime(2024, 1, 2, 23, 59, 59), None)


def test_properties_override_on_a_plain_session(spark):
    spark.conf.unset("spark.sql.mapKeyDedupPolicy")
    a = "id int, water_body_id int, analysis_id int, indicator string, severity string, status string, ring " + RING
    alerts = spark.createDataFrame([(1, 5, 9, "algal", "HIGH", "Active", None), (2, 5, 9, "algal", "LOW", "active", square(0, 0)), (3, 5, 9, "algal", "LOW", "closed", None)], a)
    features = spark.createDataFrame([(9, [(square(1, 1), {"indicator": "own", "alert_id": "no"}), (None, {}), (square(2, 2), None)])], f"id int, features array<struct<ring:{RING},properties:map<string,string>>>")
    got = {r.feature_id: r.properties for r in dashboard.alert_features(alerts, features).collect()}
    ids = {"alert_id": "1", "water_body_id": "5"}
    assert got == {"1-0": {"indicator": "own", "severity": "HIGH"} | ids, "1-2": {"indicator": "algal", "severity": "HIGH"} | ids, "2": {"indicator": "algal", "severity": "LOW", "alert_id": "2", "water_body_id": "5"}}


def test_collections(spark):
    f = spark.createDataFrame([(1, "b", square(0, 0), {"k": "v"}), (1, "a", square(1, 1), {}), (2, "c", None, {})], f"body int, feature_id string, ring {RING}, properties map<string,string>")
    got = {r.body: json.loads(r.collection) for r in dashboard.feature_collections(f, "body").collect()}
    assert [x["id"] for x in got[1]["features"]] == ["a", "b"] and got[1]["features"][1]["properties"] == {"k": "v"} and got[1]["type"] == "FeatureCollection"
    assert got[1]["features"][1]["geometry"]["coordinates"] == [[list(p) for p in square(0.0, 0.0)]] and got[2]["features"] == []


def test_evidence_defaults(spark):
    docs = ['{"anomaly_detected": true, "evidence": ["x"], "turbidity": 1}', "{}", '{"evidence": null, "anomaly_detected": null}', None, "broken"]
    got = [tuple(r) for r in spark.createDataFrame([(d,) for d in docs], "d string").select(*[c.alias(k) for k, c in text.evidence(F.col("d")).items()]).select("turbidity", "anomaly_detected", "evidence").collect()]
    assert got == [(1.0, True, ["x"]), (None, False, []), (None, None, None), (None, False, []), (None, False, [])]


def test_analyze_twice(spark):
    """The same scene again updates its observation, appends an analysis, and alerts only from a band on."""
    bodies = spark.createDataFrame([(1, True), (2, False)], "id long, active boolean")
    obs = spark.createDataFrame([], "id long, water_body_id long, scene_id string, satellite string, observation_date timestamp_ntz, cloud_percentage double, source_url string, quality_score double")
    analyses = spark.createDataFrame([], "id long, observation_id long, created_at timestamp_ntz, anomaly_detected boolean, model_name string")
    alerts = spark.createDataFrame([], "id long, water_body_id long, analysis_id long, date timestamp_ntz, indicator string, severity string, confidence double, affected_area_km2 double, status string, note string")
    schema = "water_body_id long, scene_id string, satellite string, observation_date timestamp_ntz, created_at timestamp_ntz, cloud_percentage double, source_url string, turbidity_score double, chlorophyll_score double, algal_score double, area_score double, anomaly_score double, anomaly_level string, confidence double, affected_area_km2 double"
    row = lambda body, scene, day, cloud, score, level: (body, scene, "S2", datetime(2024, 1, day), datetime(2024, 2, day), cloud, "u", 0.1, 0.6, 0.6, 0.9, score, level, 0.5, 1.0)
    engine = Engine(spark, bodies, obs, analyses, alerts)
    for batch in ([row(1, "A", 1, 20.0, 0.1, "NONE"), row(1, "B", 2, 0.0, 0.6, "MEDIUM"), row(2, "C", 3, 0.0, 0.9, "HIGH")], [row(1, "A", 4, 50.0, 0.3, "LOW")]):
        out = {k: spark.createDataFrame(v.collect(), v.schema) for k, v in engine.analyze(spark.createDataFrame(batch, schema)).items()}
        engine = Engine(spark, bodies, **out)
    got = sorted((r.id, r.scene_id, r.observation_date.day, r.quality_score) for r in engine.observations.collect())
    assert got == [(1, "A", 4, 0.5), (2, "B", 2, 1.0)]
    assert sorted((r.id, r.observation_id, r.anomaly_detected) for r in engine.analyses.collect()) == [(1, 1, False), (2, 2, True), (3, 1, True)]
    assert sorted((r.id, r.analysis_id, r.indicator, r.severity, r.status) for r in engine.alerts.collect()) == [(1, 2, "chlorophyll", "MEDIUM", "active"), (2, 3, "chlorophyll", "LOW", "active")]


def test_numbers_follow_the_order_across_ranges(spark):
    names = [f"n{k:04}" for k in range(500)]
    random.Random(1).shuffle(names)
    df = mutations.numbered(spark.createDataFrame([(n,) for n in names], "name string").repartition(7), 100, ["name"])
    assert [(r.id, r.name) for r in df.orderBy("id").collect()] == [(101 + k, f"n{k:04}") for k in range(500)]
    assert mutations.numbered(df.drop("id").limit(0), 5, ["name"]).count() == 0


def test_patch_refuses_a_null_ring(spark):
    table = spark.createDataFrame([(1, "a", square(0.0, 0.0), 1.0), (2, "b", square(0.0, 0.0), 1.0)], f"id int, name string, ring {RING}, area_sq_km double")
    changes = spark.createDataFrame([(1, "x", None, ["name", "ring"]), (2, "y", None, ["name"])], f"id int, name string, ring {RING}, given array<string>")
    assert [tuple(r) for r in mutations.patch_errors(changes).collect()] == [(1, "ring_is_null")]
    assert sorted(r.name for r in mutations.patch(table, changes).collect()) == ["a", "y"]
    with pytest.raises(LookupError):
        relational.required(table, 3)
    assert relational.required(table, 2).first().name == "b"


@pytest.mark.parametrize("seed", [1, 2])
def test_boxes_against_brute_force(spark, seed):
    r = random.Random(seed)
    box = lambda k: (k, x := r.uniform(-8, 8), y := r.uniform(-8, 8), x + r.choice([0, 0.01, 0.5, 3, 40]), y + r.choice([0, 0.3, 1, 20]))
    left, right = [box(k) for k in range(120)], [box(k) for k in range(90)] + [(90, 0.5, 0.5, 0.5, 0.5), (91, 0.5, 0.5, 1.0, 1.0)]
    schema = "{} int, xmin double, ymin double, xmax double, ymax double"
    got = [tuple(x) for x in spatial.boxes_meeting(spark.createDataFrame(left, schema.format("a")), spark.createDataFrame(right, schema.format("b")), "a", "b").collect()]
    want = {(p[0], q[0]) for p in left for q in right if p[1] <= q[3] and p[3] >= q[1] and p[2] <= q[4] and p[4] >= q[2]}
    assert len(got) == len(set(got)) and set(got) == want


def test_percentiles_of_many_bodies_at_once():
    r = np.random.default_rng(5)
    body, at, v, used = r.integers(0, 7, 300), r.integers(0, 20, 300), r.integers(0, 9, 300) / 4, r.random(300) < 0.7
    got = baseline.prior_percentiles(at, v, used, [0.5, 0.9], body)
    for i in range(300):
        before = v[(body == body[i]) & (at < at[i]) & used]
        for share, found in zip((50, 90), got, strict=True):
            assert np.isnan(found[i]) if not len(before) else found[i] == pytest.approx(np.percentile(before, share), abs=1e-12)


def test_equal_places_and_rings_are_measured_once(spark, monkeypatch):
    rows, plain = [], spatial.measured
    monkeypatch.setattr(spatial, "measured", lambda df, *more: rows.append(df.count()) or plain(df, *more))
    points = spark.createDataFrame([(k, 75.0 + k % 2 * 10, 18.0) for k in range(40)] + [(40, None, 18.0)], "point_id long, lon double, lat double")
    bodies = spark.createDataFrame([(k, square(75.0 + k % 3 / 100, 18.01)) for k in range(30)] + [(30, None)], "id long, ring array<struct<lon:double,lat:double>>")
    got = [(r.point_id, r.body) for r in spatial.bodies_near(points, bodies, 30.0).collect()]
    assert sorted(got) == [(p, b) for p in range(0, 40, 2) for b in range(30)] and rows == [3]


def test_results_of_equal_boxes_are_dealt_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(spatial, "PAIRS", 2000, raising=False)
    boxes = lambda n, key, w: spark.range(n).select(F.col("id").alias(key), *[F.lit(v).alias(c) for c, v in zip(("xmin", "ymin", "xmax", "ymax"), (1.0, 1.0, 1.0 + w, 1.0 + w), strict=True)])
    for n, m in ((300, 200), (50, 1200)):
        df = spatial.boxes_meeting(boxes(n, "a", 3.0), boxes(m, "b", 0.01), "a", "b")
        each = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(each) == df.distinct().count() == n * m and max(each) <= 15_000


def test_dense_cells_are_parts_of_both_sides(spark, monkeypatch):
    monkeypatch.setattr(spatial, "DENSE", 5)
    left = [(k, k * 0.001, 0.0, k * 0.001 + 0.003, 1.0) for k in range(60)]
    right = [(k, k * 0.002, 0.5, k * 0.002 + 0.0005, 0.6) for k in range(40)]
    sides = [spark.createDataFrame(rows, f"{key} long, xmin double, ymin double, xmax double, ymax double") for key, rows in (("a", left), ("b", right))]
    got = [(r.a, r.b) for r in spatial.boxes_meeting(*sides, "a", "b").collect()]
    assert sorted(got) == [(a[0], b[0]) for a in left for b in right if a[1] <= b[3] and b[1] <= a[3]]


def test_bodies_near(spark):
    bodies = spark.createDataFrame([(1, square(73.0, 18.0)), (2, square(80.0, 18.0))], f"id int, ring {RING}")
    points = spark.createDataFrame([(1, 73.5, 18.5), (2, 74.1, 18.5), (3, 77.0, 18.5), (4, 79.9, 60.0)], "point_id int, lon double, lat double")
    got = {(r.point_id, r.body): r.distance_km for r in spatial.bodies_near(points, bodies, 30.0).collect()}
    assert set(got) == {(1, 1), (2, 1)} and got[1, 1] == 0.0 and 10 < got[2, 1] < 11


def test_csv_files_with_other_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("water_body_id,observation_date,turbidity_measured\n1,2024-01-01,3.5\nbad\n")
    (tmp_path / "b.csv").write_text("observation_date,algal_density_measured,water_body_id\n2024-01-02,7,2\n")
    (tmp_path / "c.csv").write_text("observation_date,algal_density_measured,water_body_id\n2024-01-03,8.5,3\n")
    (tmp_path / "d.csv").write_bytes(b"")
    (tmp_path / "notes.txt").write_text("x,y\n1,2\n")
    got = {str(r.water_body_id): (r.turbidity_measured, r.algal_density_measured) for r in readers.ground_truth(spark, str(tmp_path)).collect()}
    assert got == {"1": (3.5, None), "bad": (None, None), "2": (None, 7.0), "3": (None, 8.5)}
    assert readers.ground_truth(spark, str(tmp_path / "none")).columns == []


def test_geojson_in_metres(spark, tmp_path):
    x, y = (spark.range(1).select(*[c.alias(n) for n, c in zip("xy", geo.to_utm(F.lit(73.8), F.lit(18.5), F.lit(43), F.lit(False)), strict=True)]).first())
    ring = [[x, y], [x + 100, y], [x + 100, y + 100], [x, y]]
    doc = lambda crs: json.dumps({"crs": {"type": "name", "properties": {"name": crs}}, "features": [{"type": "Feature", "properties": {"name": crs}, "geometry": {"type": "Polygon", "coordinates": [ring]}}]})
    for k, crs in enumerate(("urn:ogc:def:crs:EPSG::32643", "urn:ogc:def:crs:OGC:1.3:CRS84", "EPSG:9999")):
        (tmp_path / f"{k}.geojson").write_text(doc(crs))
    got = {r.properties["name"]: r.ring for r in readers.geojson(spark, str(tmp_path)).collect()}
    assert set(got) == {"urn:ogc:def:crs:EPSG::32643", "urn:ogc:def:crs:OGC:1.3:CRS84"}
    assert got["urn:ogc:def:crs:EPSG::32643"][0].lon == pytest.approx(73.8, abs=1e-8) and got["urn:ogc:def:crs:EPSG::32643"][0].lat == pytest.approx(18.5, abs=1e-8)
    web = spark.range(1).select(readers.to_degrees(F.struct(F.lit(8215378.42).alias("lon"), F.lit(2096451.6).alias("lat")), F.lit(3857)).alias("p")).first().p
    assert web.lon == pytest.approx(73.8, abs=1e-4) and web.lat == pytest.approx(18.507, abs=1e-2)


def test_window_of_a_box_in_degrees(spark):
    p = spark.range(100 * 100).select(F.lit(1).alias("scene_id"), F.floor(F.col("id") / 100).cast("int").alias("row"), (F.col("id") % 100).cast("int").alias("col"))
    x, y = spark.range(1).select(*geo.to_utm(F.lit(73.8), F.lit(18.5), F.lit(43), F.lit(False))).first()
    left, top = x - 300, y + 700
    d = 1e-9
    got = readers.window_of_box(p, (73.8, 18.5, 73.8 + d, 18.5 + d), 50.0, left, top, 10.0, 100, 100, 43).agg(F.min("col"), F.max("col"), F.min("row"), F.max("row"), F.count("*")).first()
    assert tuple(got) == (25, 34, 65, 74, 100)
    assert readers.window_of_box(p, (73.8, 18.5, 73.8 + d, 18.5 + d), 5000.0, left, top, 10.0, 100, 100, 43).count() == 100 * 100


def test_rasters_are_written_by_scene(spark, tmp_path):
    p = spark.createDataFrame([(1, 0, 0, 0.5, True), (1, 0, 1, None, None), (2, 0, 0, 0.25, False)], "scene_id long, row int, col int, b02 double, water boolean")
    readers.write_raster(p.drop("water"), str(tmp_path / "r"))
    readers.write_raster(p.drop("water").where("scene_id = 2").withColumn("b02", F.lit(0.75)), str(tmp_path / "r"))
    assert sorted((r.scene_id, r.col, r.b02) for r in spark.read.parquet(str(tmp_path / "r")).where("b02 is not null").collect()) == [(1, 0, 0.5), (2, 0, 0.75)]
    readers.write_mask(p, str(tmp_path / "m"))
    assert sorted((r.scene_id, r.col, r.water) for r in spark.read.parquet(str(tmp_path / "m")).collect()) == [(1, 0, 1), (1, 1, 0), (2, 0, 0)]
    f = spark.createDataFrame([("a", square(0, 0), {"k": "v"})], f"feature_id string, ring {RING}, properties map<string,string>")
    readers.write_geojson(f, str(tmp_path / "lines"))
    readers.write_collection(f, str(tmp_path / "one"))
    assert json.loads(spark.read.text(str(tmp_path / "lines")).first().value)["id"] == "a"
    assert len(json.loads(spark.read.text(str(tmp_path / "one")).first().value)["features"]) == 1


def test_promoted_models(spark, tmp_path):
    stats = spark.createDataFrame([(1, 0.4, 0.2, 0.3, 2.0)], "scene_id int, turbidity double, chlorophyll double, algal double, ndti_mean double")
    model = Pipeline(stages=[SQLTransformer(statement="select *, ndti_mean as prediction from __THIS__")]).fit(stats)
    model.save(str(tmp_path / "t"))
    manifest = {"model_version": "v7", "models": {"turbidity_measured": {"file": "t", "promoted": True}, "chlorophyll_measured": {"file": "t", "promoted": False}, "algal_density_measured": {"file": "gone", "promoted": True}}}
    (tmp_path / ml.MANIFEST).write_text(json.dumps(manifest, indent=1))
    version, models = ml.promoted_models(spark, str(tmp_path))
    r = ml.indicators(stats, models).first()
    assert version == "v7" and set(models) == {"turbidity_measured"}
    assert (r.turbidity, r.turbidity_mode, r.chlorophyll, r.chlorophyll_mode) == (1.0, "model_calibrated", 0.2, "spectral_indicator_only")
    assert ml.promoted_models(spark, str(tmp_path / "none")) == (None, {})
    assert list(ml.FEATURES)[5:8] == ["red_green_ratio_mean", "red_reflectance_mean", "ndci_mean"] and len(ml.FEATURES) == 19


def pixels_of(spark, masks, column="water"):
    rows = [(k, r, c, bool(m[r, c])) for k, m in masks.items() for r in range(m.shape[0]) for c in range(m.shape[1])]
    return spark.createDataFrame(rows, f"scene_id long, row int, col int, {column} boolean")


def test_scenes_split_between_batches(spark):
    g = np.random.default_rng(4)
    masks = {k: g.random((6, 9)) < 0.5 for k in range(40)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    got = {(r.scene_id, r.row, r.col): r.component for r in raster.with_components(pixels_of(spark, masks)).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for k, m in masks.items():
        labels, _ = raster.label(m)
        want |= {(k, r, c): labels[r, c] for r, c in zip(*np.nonzero(m), strict=True)}
    assert got == want


def test_buffer_is_a_distance(spark):
    g = np.random.default_rng(5)
    mask = g.random((30, 30)) < 0.01
    for radius in (1.0, 4.5, 9.0):
        out = raster.buffered(mask, radius)
        near = lambda r, c: any(math.hypot(max(abs(r - i) - 0.5, 0), max(abs(c - j) - 0.5, 0)) <= radius for i, j in np.argwhere(mask))  # noqa: B023, E731
        assert np.array_equal(out, [[near(r, c) for c in range(30)] for r in range(30)])


def test_boundaries_drop_slivers(spark):
    a, b = np.zeros((12, 12), bool), np.zeros((4, 4), bool)
    a[1:7, 1:7] = True
    a[3, 3] = False  # a hole
    a[7, 7] = a[8, 8] = True  # touch at a corner
    a[10:12, 10:12] = True  # 400 square metres
    got = {r.scene_id: r for r in raster.boundaries(pixels_of(spark, {1: a, 2: b}), 500000.0, 2000000.0, 10.0, 43).collect()}
    assert not got[2].detected and got[2].polygons == []
    assert got[1].detected and len(got[1].polygons) == 1 and len(got[1].polygons[0]) == 2


def test_anomaly_extent(spark):
    """A 6 by 6 scene with 2 by 2 anomalous pixels, and one without any."""
    rows = [(k, r, c, True, 0.8, 0.2, 0.5 if k == 1 and 2 <= r <= 3 and 2 <= c <= 3 else 0.2, 0.5 if k == 1 and 2 <= r <= 3 and 2 <= c <= 3 else 0.2) for k in (1, 2) for r in range(6) for c in range(6)]
    df = spark.createDataFrame(rows, "scene_id long, row int, col int, water boolean, confidence double, turbidity double, chlorophyll double, algal double")
    scored = raster.pixel_scores(df, {k: (0.2, 0.05) for k in ("turbidity", "chlorophyll", "algal")})
    got = {r.scene_id: tuple(r)[1:] for r in raster.anomaly_extent(scored, raster.pixel_area_km2(10.0, 0.0, 0.0, -10.0)).collect()}
    assert got == {1: (4, 0.0004, 0.8), 2: (0, None, None)}
    region = raster.anomaly_regions(scored).collect()
    assert [(r.scene_id, r.pixels, r.dominant) for r in region] == [(1, 4, "chlorophyll")]


def test_status_and_bands(spark):
    df = spark.createDataFrame([("ok", "valid"), ("ok", "insufficient_baseline"), ("ok_with_warning", "insufficient_baseline"), ("degraded", "valid")], "mask string, base string")
    assert [r.s for r in df.select(scalar.pipeline_status(F.col("mask"), F.col("base")).alias("s")).collect()] == ["ok", "insufficient_baseline", "quality_warning", "degraded"]
    assert spark.range(1).select(scalar.band(F.lit(None).cast("double")).alias("b")).first().b is None


def test_stream_agrees_with_the_batch_form(spark, tmp_path):
    """Nulls, ineligible and equal records included, a stream scores records as the batch form does."""
    r = random.Random(9)
    schema = "water_body_id long, observation_date timestamp, seq long, mask_quality_status string, turbidity_indicator double, chlorophyll_indicator double, algal_indicator double, water_area_km2 double, cloud_percentage double"
    value = lambda: None if r.random() < 0.1 else round(r.random(), 3)
    rows = [(k % 3, datetime(2024, 1 + k // 28, 1 + k % 28), k, r.choice(["ok", "ok", "degraded"]), value(), value(), value(), value(), 0.0) for k in range(120)]
    for k in range(0, 120, 40):
        spark.createDataFrame(rows[k : k + 40], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        streaming.scored_stream(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    got = {(x.water_body_id, x.observation_date): x for x in spark.read.parquet(str(tmp_path / "out")).collect()}
    once = baseline.anomalies(baseline.prior_baseline(spark.createDataFrame(rows, schema)))
    assert len(got) == 120
    for x in once.collect():
        y = got[x.water_body_id, x.observation_date]
        assert (y.prior_count, y.baseline_status, y.anomaly_level) == (x.prior_count, x.baseline_status, x.anomaly_level)
        assert (x.anomaly_score is None) == (y.anomaly_score is None or math.isnan(y.anomaly_score))
        assert x.anomaly_score is None or y.anomaly_score == pytest.approx(x.anomaly_score, abs=2e-4)


def test_daily_counts(spark, tmp_path):
    schema = "water_body_id long, observation_date timestamp, cloud_percentage double"
    rows = [(1, datetime(2024, 1, 1, 3), 5.0), (1, datetime(2024, 1, 1, 20), 50.0), (1, datetime(2024, 1, 2), 1.0), (2, datetime(2024, 1, 1), None)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    q = streaming.daily_counts(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.water_body_id, r.day.start.day, r.records, r.worst_cloud) for r in spark.table("days").collect())
    assert got == [(1, 1, 2, 50.0), (1, 2, 1, 1.0), (2, 1, 1, None)]


def test_scores_need_no_percentiles(spark):
    df = spark.createDataFrame([], "water_body_id long, observation_date timestamp_ntz, mask_quality_status string, cloud_percentage double, turbidity_indicator double, chlorophyll_indicator double, algal_indicator double, water_area_km2 double")
    assert "percentile" not in baseline.anomalies(baseline.prior_baseline(df))._jdf.queryExecution().optimizedPlan().toString()
    assert history.snapshots is not None


def test_tables_of_a_database(spark):
    """A table read in ranges of its key, from the database that Spark brings along."""
    url, driver = "jdbc:derby:memory:lakes;create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    spark.range(100).select("id", (F.col("id") * 2).alias("x")).write.jdbc(url, "lakes", properties={"driver": driver})
    df = readers.jdbc(spark, url, "lakes", "id", 0, 100, 4, driver=driver).toDF("id", "x")
    assert df.rdd.getNumPartitions() == 4 and df.where("id >= 90").count() == 10 and df.where("x != 2 * id").isEmpty()


def test_numbers_of_more_rows_than_a_range_sample(spark):
    """Ids are distinct, consecutive and the same in every run over the result, ties and repeated rows included."""
    rows = spark.range(300_000).select((F.col("id") * 7919 % 100_003).alias("k"), (F.col("id") % 3).alias("v")).repartition(9)
    df = mutations.numbered(rows, 1000, ["k"])
    for _ in range(2):
        low, high, n, distinct = df.agg(F.min("id"), F.max("id"), F.count("*"), F.count_distinct("id")).first()
        assert (low, high, n, distinct) == (1001, 301_000, 300_000, 300_000)
    places = df.select("k", F.row_number().over(Window.orderBy("k", "id")).alias("n"), "id")
    assert places.where("id != n + 1000").count() == 0
    again = mutations.numbered(rows, 1000, ["k"])
    assert df.exceptAll(again).count() == 0
    repeated = mutations.numbered(spark.range(50).select(F.lit("x").alias("k"), F.create_map(F.lit("a"), F.lit(1)).alias("m")), 0, ["k"])
    assert sorted(r.id for r in repeated.collect()) == list(range(1, 51))


def test_inserts_of_many_rows(spark):
    table = spark.range(1, 1001).select("id", F.col("id").cast("string").alias("name"))
    new = spark.range(200_000).select(F.concat(F.lit("n"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("name"))
    df = mutations.insert(table, new, ["name"])
    assert df.where("id > 1000 and name != concat('n', lpad(id - 1001, 6, '0'))").count() == 0
    assert df.agg(F.count("*"), F.count_distinct("id"), F.max("id")).first()[:] == (201_000, 201_000, 201_000)


def test_alerts_of_their_own_analysis(spark):
    """Two results of one scene, and a stored analysis of a later time: each alert points to what raised it."""
    observations = spark.createDataFrame([(5, 1, "S", None)], "id long, water_body_id long, scene_id string, satellite string")
    stored = spark.createDataFrame([(90, 5, datetime(2030, 1, 1))], "id long, observation_id long, created_at timestamp").withColumns({"analysis_data": F.lit(None).cast("string"), "model_name": F.lit("m"), "model_version": F.lit("1")})
    alerts = spark.createDataFrame([], "id long, water_body_id long, analysis_id long, date timestamp, indicator string, severity string, explanation string, confidence double, status string")
    schema = "water_body_id long, scene_id string, observation_date timestamp, created_at timestamp, anomaly_score double, anomaly_level string, turbidity_score double, chlorophyll_score double, algal_score double, explanation array<string>, turbidity_indicator double"
    day = datetime(2024, 1, 1)
    results = [(1, "S", day, datetime(2024, 1, k), s, level, t, 0.2, 0.1, [f"said {k}"], t / 2) for k, s, level, t in ((2, 0.6, "MEDIUM", 0.9), (3, 0.1, "NONE", 0.0), (4, 0.3, "LOW", 0.15))]
    placed = mutations.placed_results(stored, observations, spark.createDataFrame(results, schema))
    analyses = {r.id: r for r in mutations.appended_analyses(stored, placed).collect()}
    assert sorted(analyses) == [90, 91, 92, 93] and [analyses[k].created_at.day for k in (91, 92, 93)] == [2, 3, 4]
    document = json.loads(analyses[93].analysis_data)
    assert document["evidence"] == ["said 4"] and document["individual_scores"] == {"turbidity": 0.15, "chlorophyll": 0.2, "algal": 0.1}
    assert document["turbidity"] == 0.075 and document["confidence"] is None and document["anomaly_detected"] is True and len(document) == 19
    got = mutations.appended_alerts(alerts, placed).orderBy("id").collect()
    assert [(r.id, r.analysis_id, r.indicator, r.severity, json.loads(r.explanation)["messages"]) for r in got] == [(1, 91, "turbidity", "MEDIUM", ["said 2"]), (2, 93, "chlorophyll", "LOW", ["said 4"])]
    assert set(json.loads(got[0].explanation)) == {"messages", "indicator_scores", "spatial_note"}


def test_boxes_of_every_size_and_dense_cells(spark, monkeypatch):
    """Tiny to world-wide boxes, bounds that make no box, many boxes on one spot: as brute force, in every half."""
    monkeypatch.setattr(spatial, "DENSE", 8)
    r = random.Random(4)
    box = lambda k: (k, x := r.uniform(-170, 170) if k % 3 else 5.0, y := r.uniform(-80, 80) if k % 3 else 5.0, x + r.choice([0, 1e-5, 0.004, 0.7, 9, 200]), y + r.choice([0, 1e-4, 0.02, 2, 60]))
    left, right = [box(k) for k in range(250)], [box(k) for k in range(200)]
    left += [(900, None, 0.0, 1.0, 1.0), (901, 0.0, 0.0, float("nan"), 1.0), (902, 6.0, 6.0, 5.0, 7.0)]
    schema = "{} int, xmin double, ymin double, xmax double, ymax double"
    got = [tuple(x) for x in spatial.boxes_meeting(spark.createDataFrame(left, schema.format("a")), spark.createDataFrame(right, schema.format("b")), "a", "b").collect()]
    want = {(p[0], q[0]) for p in left[:250] for q in right if p[1] <= q[3] and p[3] >= q[1] and p[2] <= q[4] and p[4] >= q[2]}
    assert len(got) == len(set(got)) and set(got) == want
    assert spatial.boxes_meeting(spark.createDataFrame([], schema.format("a")), spark.createDataFrame(right, schema.format("b")), "a", "b").count() == 0


def test_boxes_are_compared_where_they_may_meet(spark):
    """No key holds all rows, and pairs that are tested are within a small factor of those that meet."""
    boxes = lambda n, key, side: spark.range(n).select(F.col("id").alias(key), (F.rand(n) * 40).alias("xmin"), (F.rand(n + 1) * 40).alias("ymin")).withColumns({"xmax": F.col("xmin") + side, "ymax": F.col("ymin") + side})
    a, b = boxes(4000, "a", 0.8).cache(), boxes(3000, "b", 0.05).cache()
    met = spatial.boxes_meeting(a, b, "a", "b").count()
    sized = [df.select(F.col(k).alias("key"), *spatial.BOX).withColumn("level", spatial._level({c: F.col(c) for c in spatial.BOX})) for df, k in ((a, "a"), (b, "b"))]
    coarse = spatial._in_cells(sized[0], F.col("level")).groupBy("at", "x", "y").agg(F.count("*").alias("n"))
    fine = spatial._in_cells(sized[1], F.lit(spatial._levels(sized[0])[0])).groupBy("at", "x", "y").agg(F.count("*").alias("k"))
    tested, most = coarse.join(fine, ["at", "x", "y"]).agg(F.sum(F.col("n") * F.col("k")), F.max("n")).first()
    assert met > 3000 and tested < 10 * met and most < 100


def test_bodies_near_beyond_the_antimeridian(spark):
    bodies = spark.createDataFrame([(1, square(-179.95, 10.0)), (2, square(179.0, 10.0)), (3, square(0.0, 89.5))], f"id int, ring {RING}").withColumn("active", F.lit(True))
    points = spark.createDataFrame([(1, 179.98, 10.5), (2, -179.99, 10.5), (3, 150.0, 89.9)], "point_id int, lon double, lat double")
    got = {(r.point_id, r.body): r.distance_km for r in spatial.bodies_near(points, bodies, 60.0).collect()}
    assert {k for k in got if k[0] < 3} == {(1, 1), (1, 2), (2, 1), (2, 2)} and got[1, 2] == 0.0 and 7 < got[1, 1] < 8 and 4 < got[2, 1] < 5
    engine = Engine(spark, bodies, bodies, bodies, bodies)
    assert [(r.id, r.distance_km) for r in engine.nearby(179.98, 10.5, 60.0).collect()] == [(2, 0.0), (1, got[1, 1])]


def test_order_statistics():
    r = np.random.default_rng(3)
    for n in (1, 2, 7, 64, 300):
        v = np.round(r.normal(size=n), 1)
        first = r.integers(1, n + 1, 200)
        k = (first * r.random(200)).astype(np.int64)
        got = baseline.OrderStatistics(v).smallest(first, k)
        assert (got == [np.sort(v[:m])[i] for m, i in zip(first, k)]).all()


def test_percentiles_of_long_and_odd_histories(spark):
    """As sorting what was before each record; a body of 100,000 records in seconds."""
    r = np.random.default_rng(8)
    n = 400
    at, v, used = r.integers(0, 120, n), np.round(r.normal(size=n), 2), r.random(n) < 0.7
    got = baseline.prior_percentiles(at, v, used, [0.1, 0.5, 0.9])
    for i in range(n):
        before = v[(at < at[i]) & used]
        for share, x in zip((0.1, 0.5, 0.9), got):
            assert np.isnan(x[i]) if not len(before) else x[i] == pytest.approx(np.percentile(before, share * 100))
    schema = "water_body_id long, observation_date timestamp, mask_quality_status string, turbidity_indicator double, chlorophyll_indicator double, algal_indicator double, water_area_km2 double"
    rows = [(k % 3 or None, datetime(2024, 1, 1 + k // 4), ("ok", "ok", "degraded")[k % 3 if k % 7 else 0], float(k * 37 % 11) if k % 5 else None, 1.0, float(-k), k / 3) for k in range(100)] + [(1, None, "ok", 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, schema)
    for x in baseline.prior_baseline(df, None, baseline.KEYS).collect():
        own = [q for q in rows if q[0] == x.water_body_id and q[1] and x.observation_date and q[1] < x.observation_date and q[2] == "ok"]
        t = [q[3] for q in own if q[3] is not None]
        assert (x.turbidity_prior is None) == (len(own) < 3)
        if x.turbidity_prior is not None and t:
            assert tuple(x.turbidity_prior[k] for k in ("p10", "p25", "median", "p75", "p90")) == pytest.approx(tuple(np.percentile(t, (10, 25, 50, 75, 90))))
            assert (x.turbidity_prior.min, x.turbidity_prior.max) == (min(t), max(t))
    start = __import__("time").perf_counter()
    baseline.prior_percentiles(np.arange(100_000), r.normal(size=100_000), np.ones(100_000, dtype=bool), list(baseline.SHARES.values()))
    assert __import__("time").perf_counter() - start < 15


def test_scene_choice_against_brute_force(spark):
    from datetime import timedelta

    from lakestat.operators import scenes

    r = random.Random(12)
    day = datetime(2023, 11, 1)
    items = [(f"s{k:03}", r.choice([1, 2, None]), day + timedelta(days=r.randrange(0, 500), hours=r.choice([0, 6, 23])), r.choice([5.0, 19.9, 20.0, 35.0, 45.0, 59.0, 80.0, None])) for k in range(160)]
    items += [("z1", 1, day, 5.0), ("z0", 1, day, 5.0), ("z2", 3, datetime(2025, 12, 31, 12), 59.0)]
    targets = [(k, r.choice([1, 2]), day + timedelta(days=r.randrange(-100, 620), hours=12)) for k in range(120)] + [(500, 1, day), (501, 3, datetime(2025, 10, 3)), (502, 3, datetime(2025, 10, 2)), (503, 4, day), (504, None, day)]
    s = spark.createDataFrame(items, "scene_id string, body int, datetime timestamp, cloud double").repartition(5)
    t = spark.createDataFrame(targets, "target_id int, body int, target_date timestamp")
    chosen = scenes.choose(t, s)
    want = {}
    for k, body, date in targets:
        for n, (days, most) in enumerate(scenes.LADDER, 1):
            near = [(abs(x - date), c, i) for i, b, x, c in items if b == body and body and c is not None and c < most and abs((x.date() - date.date()).days) <= days]
            if near:
                want[k] = (n, min(near)[2])
                break
    assert {x.target_id: (x.attempt, x.scene_id) for x in chosen.collect()} == want
    assert sorted(x.target_id for x in scenes.unmatched(t, chosen).collect()) == sorted(k for k, *_ in targets if k not in want)
    plan = chosen._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan


def test_discovery_falls_back_on_a_failing_source(spark):
    """The second source is used where the first fails at once, fails while it is read, or is empty."""
    bodies = spark.createDataFrame([(1, "A", "Lake", None, "s", square(0.0, 0.0), 1.0, "osm", True)], f"id long, name string, type string, district string, state string, ring {RING}, area_sq_km double, source string, active boolean")
    engine = Engine(spark, bodies, bodies, bodies, bodies)
    elements = spark.createDataFrame([(0, "way", {"name": "B", "natural": "water"}, square(3.0, 3.0))], f"pos long, type string, tags map<string,string>, ring {RING}")
    features = spark.createDataFrame([(0, square(5.0, 5.0), "C", "Lake", "d")], f"pos long, ring {RING}, `WB Name` string, Category string, DIST_NAME string")

    def missing():
        raise OSError("no such file")

    late = features.withColumn("Category", F.when(F.raise_error(F.lit("broken row")).isNull(), "Lake"))
    for first in (missing, late, features.limit(0), None, lambda: spark.read.parquet("/nowhere/at/all")):
        assert sorted(r.name for r in engine.discover(first, elements, "osm").collect()) == ["A", "B"]
    assert sorted(r.name for r in engine.discover(lambda: features, missing, "survey").collect()) == ["A", "C"]
    assert engine.discover(features.limit(0), elements.limit(0), "osm").count() == 1
    with pytest.raises(OSError):
        engine.discover(None, missing, "osm")
