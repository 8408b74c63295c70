"""Operators against small fixtures and plain versions."""

import math
from collections import deque
from datetime import datetime, timezone

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakestat.functions import geo, scalar
from lakestat.operators import baseline, dashboard, discovery, history, ml, mutations, raster, relational, scenes, spectral

UTC = timezone.utc


def record(day, status, value, month=1):
    return (1, datetime(2024, month, day), status, 0.0, value, value, value, value)


HISTORY = "water_body_id long, observation_date timestamp_ntz, mask_quality_status string, cloud_percentage double, turbidity_indicator double, chlorophyll_indicator double, algal_indicator double, water_area_km2 double"


@pytest.mark.parametrize(
    ("statuses", "status", "count"),
    [(("ok", "low_confidence_mask", "ok"), "insufficient_baseline", 2), (("ok", "ok_with_warning", "ok"), "valid", 3), (("ok", "ok", "ok"), "valid", 3)],
)
def test_baseline_gate(spark, statuses, status, count):
    rows = [record(1, s, v, m) for m, (s, v) in enumerate(zip(statuses, (0.1, 0.2, 0.3), strict=True), 1)]
    r = baseline.whole_baseline(spark.createDataFrame(rows, HISTORY)).first()
    assert (r.status, r.observation_count) == (status, count)
    assert r.turbidity is None if count < 3 else r.turbidity["mean"] == pytest.approx(0.2)


def test_prior_is_strict(spark):
    rows = [record(d, "ok", v) for d, v in ((1, 0.1), (2, 0.2), (3, 0.3), (3, 0.9), (4, 0.4))] + [record(5, "degraded", 9.0), record(6, "ok", 0.5)]
    got = {(r.observation_date.day, r.turbidity_indicator): r for r in baseline.prior_baseline(spark.createDataFrame(rows, HISTORY)).collect()}
    assert got[3, 0.3].prior_count == got[3, 0.9].prior_count == 2 and got[3, 0.3].baseline_status == "insufficient_baseline"
    assert got[4, 0.4].prior_count == 4 and got[4, 0.4].turbidity_prior["mean"] == pytest.approx(0.375)
    assert got[6, 0.5].prior_count == 5


def test_scores_and_bands(spark):
    rows = [record(d, "ok", 0.2) for d in (1, 2, 3)] + [record(4, "ok", 0.2), record(5, "ok", 0.9)]
    df = baseline.anomalies(baseline.prior_baseline(spark.createDataFrame(rows, HISTORY)))
    got = {r.observation_date.day: r for r in df.collect()}
    assert got[1].anomaly_score == 0 and got[1].anomaly_level == "NONE" and got[1].codes == []
    assert got[4].anomaly_score == 0
    assert got[5].turbidity_score == 0.8 and got[5].anomaly_score == 0.8 and got[5].anomaly_level == "HIGH"
    assert got[5].codes == ["TURBIDITY_ELEVATED", "CHLOROPHYLL_ELEVATED", "ALGAL_ELEVATED", "AREA_INCREASE", "COMPOUND_ANOMALY", "COMPOUND_ANOMALY"]
    assert got[5].explanation[0].startswith("TURBIDITY_ELEVATED: Turbidity indicator (0.9000) is 3.0 standard deviations above baseline mean (0.2000)")
    alert = baseline.alerts(df).collect()
    assert [(a.indicator, a.severity) for a in alert] == [("turbidity", "high")]
    bands = spark.createDataFrame([(x,) for x in (0.2499, 0.25, 0.5, 0.75, 1.0)], "x double").select(scalar.band(F.col("x")).alias("b"))
    assert [r.b for r in bands.collect()] == ["NONE", "LOW", "MEDIUM", "HIGH", "HIGH"]


def test_missing_values_stay_missing(spark):
    df = spark.createDataFrame([(None, 1.0), (1.0, 0.0), (1.0, 1e-9), (1.0, 2.0)], "a double, b double")
    got = df.select(scalar.ratio(F.col("a"), F.col("b")).alias("r"), scalar.rescaled(F.col("a"), 0.0, 2.0).alias("s"), scalar.rescaled(F.col("a"), 1.0, 1.0).alias("c")).collect()
    assert [r.r for r in got] == [None, None, None, 0.5] and [r.s for r in got] == [None, 0.5, 0.5, 0.5] and [r.c for r in got] == [None, 0.5, 0.5, 0.5]


def test_calibration(spark):
    rows = [(0, "04.00", "2020-01-01"), (1001, "04.00", "2020-01-01"), (999, "04.00", "x"), (999, "03.01", "2023-01-01"), (2000, None, "2022-01-25"), (2000, None, "2022-01-24"), (20000, None, None)]
    df = spark.createDataFrame(rows, "dn int, b string, d string").withColumn("o", scalar.has_offset(F.col("b"), F.col("d")))
    got = [r.r for r in df.select(scalar.reflectance(F.col("dn"), F.col("o")).alias("r")).collect()]
    assert got == [None, pytest.approx(1e-4), 0.0, pytest.approx(0.0999), pytest.approx(0.1), pytest.approx(0.2), 1.0]


RING = "ring array<struct<lon:double,lat:double>>"


def box(lon, lat, w):
    return [(lon, lat), (lon + w, lat), (lon + w, lat + w), (lon, lat + w), (lon, lat)]


def test_area_and_validity(spark):
    rows = [(box(73.8, 18.5, 0.1),), (box(73.8, 18.5, 0.1)[:4],), (box(181.0, 0.0, 1.0),), ([],), (None,)]
    got = spark.createDataFrame(rows, RING).select(geo.area_km2(F.col("ring")).alias("a"), geo.valid_ring(F.col("ring")).alias("v"), geo.valid_ring(F.col("ring"), False).alias("u")).collect()
    assert got[0].a == pytest.approx(116.853989, abs=1e-5)
    assert [(r.v, r.u) for r in got] == [(True, True), (False, False), (False, True), (False, False), (False, False)]


def test_distance_and_projection(spark):
    df = spark.createDataFrame([(box(73.8, 18.5, 0.1),)], RING)
    d = lambda x, y: geo.distance_m(F.col("ring"), F.lit(x), F.lit(y))
    inside, east, corner = df.select(d(73.85, 18.55), d(74.0, 18.55), d(74.0, 18.7)).first()
    assert inside == 0 and east == pytest.approx(10556.0, rel=2e-4) and corner > east
    x, y = geo.to_utm(F.lit(75.0), F.lit(18.0), F.lit(43), F.lit(False))
    north = np.linspace(0, math.radians(18), 20001)
    arc = np.trapezoid(geo.A * (1 - geo.E2) / (1 - geo.E2 * np.sin(north) ** 2) ** 1.5, north)  # of the central meridian
    assert df.select(x, y).first() == (pytest.approx(500000), pytest.approx(0.9996 * arc, abs=1e-2))
    lon, lat = geo.from_utm(F.lit(300000.0), F.lit(2050000.0), F.lit(43), F.lit(False))
    back = geo.to_utm(lon, lat, F.lit(43), F.lit(False))
    assert df.select(*back).first() == (pytest.approx(300000, abs=1e-3), pytest.approx(2050000, abs=1e-3))


def test_scene_choice(spark):
    s = [("older", 1, datetime(2024, 5, 3, 5), 0.01), ("near", 1, datetime(2024, 5, 18, 5), 1.47), ("cloudy", 2, datetime(2024, 5, 18), 25.0), ("clear", 2, datetime(2024, 5, 4), 5.0), ("last", 3, datetime(2024, 8, 10), 59.0), ("far", 4, datetime(2023, 5, 18), 0.0), ("tie1", 5, datetime(2024, 5, 17, 5, 26, 49), 9.0), ("tie2", 5, datetime(2024, 5, 19, 5, 26, 49), 3.0)]
    scenes_df = spark.createDataFrame(s, "scene_id string, body long, datetime timestamp_ntz, cloud double")
    targets = spark.createDataFrame([(b, b, datetime(2024, 5, 18, 5, 26, 49)) for b in range(1, 6)], "target_id long, body long, target_date timestamp_ntz")
    chosen = scenes.choose(targets, scenes_df)
    assert {r.target_id: (r.scene_id, r.attempt) for r in chosen.collect()} == {1: ("near", 1), 2: ("clear", 1), 3: ("last", 6), 5: ("tie2", 1)}
    assert [r.target_id for r in scenes.unmatched(targets, chosen).collect()] == [4]


def test_history_edge_cases(spark):
    o = spark.createDataFrame([(k, b, datetime(2024, 1, k), "s") for k, b in ((1, 1), (2, 1), (3, 2), (4, 3), (5, 3))], "id long, water_body_id long, observation_date timestamp_ntz, satellite string")
    t = datetime(2024, 2, 1)
    a = [(10, 1, t, 0.1, None, 0.5, None), (11, 1, t, 0.2, None, 0.6, True), (12, 2, t, 0.4, 0.3, None, False), (13, 3, t, None, None, None, None)]
    a = spark.createDataFrame(a, "id long, observation_id long, created_at timestamp_ntz, turbidity double, chlorophyll double, anomaly_score double, anomaly_detected boolean")
    line = {r.observation_id: r for r in history.timeline(o, a).collect()}
    assert line[1].analysis_id == 11 and line[4].analysis_id is None and line[4].anomaly_detected is None and line[3].anomaly_detected is False
    trend = {r.water_body_id: r for r in history.trend(o, a).collect()}
    assert (trend[1].analysed, trend[1].anomalies, trend[1].min_turbidity) == (2, 1, 0.2) and trend[3].analysed == 0 and trend[2].max_turbidity is None
    both = {r.water_body_id: r for r in history.comparison(o, a).collect()}
    assert both[1].change_turbidity == pytest.approx(0.2) and both[1].change_chlorophyll is None and not both[2].available and 3 not in both
    with pytest.raises(ValueError):
        relational.between(o, "observation_date", "2024-02-01", "2024-01-01")


def flood(mask, corners):
    h, w = mask.shape
    out, n = np.zeros((h, w), int), 0
    near = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if corners else [])
    for r in range(h):
        for c in range(w):
            if mask[r, c] and not out[r, c]:
                n += 1
                todo = deque([(r, c)])
                out[r, c] = n
                while todo:
                    y, x = todo.popleft()
                    for dy, dx in near:
                        q = (y + dy, x + dx)
                        if 0 <= q[0] < h and 0 <= q[1] < w and mask[q] and not out[q]:
                            out[q] = n
                            todo.append(q)
    return out, n


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 12), st.integers(1, 12), st.integers(0, 2**32 - 1), st.floats(0.1, 0.9))
def test_raster_against_brute_force(h, w, seed, share):
    mask = np.random.default_rng(seed).random((h, w)) < share
    for corners in (False, True):
        labels, n = raster.label(mask, corners)
        want, m = flood(mask, corners)
        assert n == m and np.array_equal(labels, want)
        assert raster.label(mask.T, corners)[1] == n
    at = np.argwhere(mask)
    for k in (1, 3):
        want = np.array([[any(abs(r - y) + abs(c - x) <= k for y, x in at) for c in range(w)] for r in range(h)]) if len(at) else mask
        assert np.array_equal(raster.dilated(mask, k), want)
    outside, _ = flood(np.pad(~mask, 1, constant_values=True), False)
    assert np.array_equal(raster.filled(mask), outside[1:-1, 1:-1] != outside[0, 0])
    rings = raster.outline(mask)
    area = sum(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:], strict=False)) for r in rings) / 2
    assert area == mask.sum() and all(r[0] == r[-1] for r in rings)
    outer = sum(1 for r in rings if sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:], strict=False)) > 0)
    assert outer == flood(mask, True)[1]


def test_closing_eats_the_edge():
    mask = np.zeros((6, 6), bool)
    mask[0:3, 2] = True
    mask[0:3, 4] = True
    out = raster.closed(mask, 3)
    around = lambda m, r, c: [m[i, j] if 0 <= i < 6 and 0 <= j < 6 else False for i in range(r - 1, r + 2) for j in range(c - 1, c + 2)]
    wide = np.array([[any(around(mask, r, c)) for c in range(6)] for r in range(6)])
    assert np.array_equal(out, [[all(around(wide, r, c)) for c in range(6)] for r in range(6)])
    assert not out[0].any() and out[1, 2:5].all() and not out[:, 1].any()


def test_fragments_are_joined():
    mask, expected = np.zeros((120, 180), bool), np.zeros((120, 180), bool)
    for k in range(3):
        mask[30:90, 20 + 42 * k : 58 + 42 * k] = True
    expected[25:95, 15:150] = True
    context = raster.buffered(expected, 15)
    joined = raster.less_fragmented(mask, expected, context)
    assert raster.fragmentation(joined)[2] < raster.fragmentation(mask)[2] and (joined & expected).sum() >= 0.99 * joined.sum()


def scene(spark, prior=True):
    rows = []
    for r in range(60):
        for c in range(60):
            wet = (15 <= r < 45 and 10 <= c < 40) or (2 <= r < 12 and 48 <= c < 58)
            rows.append((1, r, c, 0.02, 0.06 if wet else 0.01, 0.03 if wet else 0.01, 0.08 if wet else 0.4, 0.02 if wet else 0.3, 6 if wet else 0, (15 <= r < 45 and 10 <= c < 40) if prior else None))
    return spark.createDataFrame(rows, "scene_id long, row int, col int, b02 double, b03 double, b04 double, b08 double, b11 double, scl int, expected boolean")


def test_segmentation_uses_the_footprint(spark):
    got = raster.mask_report(raster.segment(scene(spark))).first()
    assert got.water_pixels == got.expected_pixels == got.overlap_pixels == 900 and got.status == "ok" and got.inside_pct == 100 and got.out_pct == 0
    free = raster.mask_report(raster.segment(scene(spark, False))).first()
    assert free.water_pixels == 1000 and free.components == 2 and free.expected_pixels == free.overlap_pixels == 0


def test_regions(spark):
    rows = [(1, r, c, True, 0.8, 0.2, *([0.5 if 2 <= r <= 3 and 2 <= c <= 3 else 0.2] * 2)) for r in range(6) for c in range(6)]
    df = spark.createDataFrame(rows, "scene_id long, row int, col int, water boolean, confidence double, turbidity double, chlorophyll double, algal double")
    got = raster.anomaly_regions(raster.pixel_scores(df, {k: (0.2, 0.05) for k in ("turbidity", "chlorophyll", "algal")})).collect()
    assert [(r.pixels, r.area_km2, round(r.confidence, 6), r.dominant) for r in got] == [(4, 0.0004, 0.8, "chlorophyll")]


def test_outlines_and_footprints(spark):
    df = spark.createDataFrame([(1, r, c, 1) for r, c in ((0, 0), (0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1), (2, 2), (3, 3))], "scene_id long, row int, col int, component long")
    got = {r.part: r for r in raster.outlines(df, 500000.0, 2000000.0, 10.0, 43).withColumn("area", geo.area_km2(F.col("ring"))).collect()}
    assert len(got) == 2 and got[1].area == pytest.approx(1e-4, rel=2e-3) and got[0].area == pytest.approx(10e-4, rel=2e-3)
    grid = spark.createDataFrame([(1, r, c) for r in range(4) for c in range(4)], "scene_id long, row int, col int")
    triangle = spark.createDataFrame([(1, [(1.0, 39.0), (31.0, 39.0), (1.0, 9.0), (1.0, 39.0)])], "scene_id long, ring array<struct<lon:double,lat:double>>")
    touched = raster.footprint(grid, triangle, 0.0, 40.0, 10.0).where("expected").count()
    inside = raster.footprint(grid, triangle, 0.0, 40.0, 10.0, False).where("expected").count()
    assert touched == 10 and inside == 6


def test_empty_mask(spark):
    df = scene(spark).withColumn("water", F.lit(False))
    r = spectral.indicators(df).first()
    assert r.turbidity is None and spectral.indicators(df, parity=True).first().turbidity == 1.0


BODY = "id long, name string, type string, district string, state string, ring array<struct<lon:double,lat:double>>, area_sq_km double, source string, active boolean"


def test_upsert(spark):
    table = spark.createDataFrame([(1, "A", "Lake", "d", "s", box(0.0, 0.0, 1.0), 1.0, "osm", False), (2, "B", "Lake", None, "s", box(0.0, 0.0, 1.0), 1.0, "osm", True)], BODY)
    new = spark.createDataFrame([("A", "Lake", None, box(0.0, 0.0, 0.1)), ("C", "Pond", "x", box(0.0, 0.0, 0.2))], "name string, type string, district string, " + RING)
    up = mutations.upsert_bodies(table, new, "osm", "M")
    got = {r.name: r for r in up.collect()}
    assert (got["A"].id, got["A"].district, got["A"].active, got["A"].change) == (1, "d", True, "updated") and got["A"].area_sq_km == pytest.approx(123.0, abs=1.5)
    assert (got["C"].id, got["C"].change) == (3, "imported") and got["B"].change == "kept"
    assert tuple(mutations.change_counts(up).first()) == (2, 1, 1)
    moved = mutations.patch(table, spark.createDataFrame([(2, box(0.0, 0.0, 0.1))], "id long, " + RING)).where("id = 2").first()
    assert moved.area_sq_km == pytest.approx(123.0, abs=1.5) and moved.name == "B"
    with pytest.raises(ValueError):
        mutations.patch(table, table.select("id"))
    assert [r.id for r in mutations.not_deletable(table, spark.createDataFrame([(1,), (2,), (9,)], "id long")).orderBy("id").collect()] == [1, 9]


def test_discovery(spark):
    rows = [(0, "way", {"name": "Big", "water": "lake"}, box(0.0, 0.0, 0.2)), (1, "way", {"name": "BIG ", "natural": "water"}, box(0.0, 0.0, 0.3)), (2, "node", {"name": "x"}, box(0.0, 0.0, 0.3)), (3, "way", {"name": " "}, box(0.0, 0.0, 0.3)), (4, "way", {"name": "open"}, box(0.0, 0.0, 0.3)[:4]), (5, "relation", {"name": "R", "landuse": "reservoir", "district": "D"}, box(0.0, 0.0, 0.4))]
    got = discovery.from_elements(spark.createDataFrame(rows, "pos int, type string, tags map<string,string>, " + RING), 10).collect()
    assert [(r.name, r.type, r.district) for r in got] == [("R", "Reservoir", "D"), ("Big", "Lake", None)]
    assert discovery.limited(0) == 1 and discovery.limited(999) == 200
    assert discovery.stitched([[(0, 0), (1, 0)], [(1, 1), (1, 0)], [(1, 1), (0, 1), (0, 0)], [(5, 5), (6, 6)]]) == [[(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]]
    line = lambda *p: [(float(x), float(y)) for x, y in p]
    members = [(9, 0, "outer", line((0, 0), (1, 0), (1, 1))), (9, 1, None, line((0, 0), (0, 1), (1, 1))), (9, 2, "inner", line((0, 0), (9, 9)))]
    ring = discovery.relation_rings(spark.createDataFrame(members, "element_id long, pos int, role string, line array<struct<lon:double,lat:double>>")).first().ring
    assert len(ring) == 5 and ring[0] == ring[-1]


def test_formats(spark):
    df = spark.createDataFrame([(1.234,), (-0.5,), (None,), (math.nan,)], "x double")
    got = df.select(dashboard.fixed(F.col("x")).alias("f"), dashboard.percent(F.col("x")).alias("p"), dashboard.signed(F.col("x")).alias("s")).collect()
    assert [tuple(r) for r in got] == [("1.23", "123.4%", "+1.234"), ("-0.50", "-50.0%", "-0.500"), ("—", "—", "—"), ("—", "—", "—")]


def test_formats_keep_the_sign_of_what_rounds_to_zero(spark):
    df = spark.createDataFrame([(-0.0,), (-0.0004,), (0.0004,), (0.0,), (-1.005e7,)], "x double")
    got = df.select(dashboard.fixed(F.col("x")).alias("f"), dashboard.percent(F.col("x")).alias("p"), dashboard.signed(F.col("x")).alias("s")).collect()
    assert [tuple(r) for r in got] == [("-0.00", "-0.0%", "-0.000"), ("-0.00", "-0.0%", "-0.000"), ("0.00", "0.0%", "+0.000"), ("0.00", "0.0%", "0.000"), ("-10050000.00", "-1005000000.0%", "-10050000.000")]


def test_dominant_takes_the_first_of_equal(spark):
    df = spark.createDataFrame([(0.5, 0.5, 0.1), (0.1, 0.4, 0.4), (None, None, None)], "a double, b double, c double")
    assert [r.d for r in df.select(baseline.dominant({k: F.col(k) for k in "abc"}).alias("d")).collect()] == ["a", "b", "multiple"]


def test_training_needs_enough_rows(spark):
    f = spark.createDataFrame([(k, "d", float(k)) for k in range(12)], "water_body_id long, observation_date string, x double")
    t = spark.createDataFrame([(k, "d", float("nan") if k < n else 1.0) for n in (1,) for k in range(12)], "water_body_id long, observation_date string, turbidity_measured double")
    assert ml.training_rows(f, t, ["x"]).count() == 11 and ml.training_rows(f, t.where("water_body_id < 5"), ["x"]).count() == 0
    assert ml.indicators(spark.createDataFrame([(1, None, 0.5, 0.25)], "scene_id long, turbidity double, chlorophyll double, algal double")).first().turbidity == 0.0
