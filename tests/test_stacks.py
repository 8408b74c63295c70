"""Scenes handled together: the same masks and checks as one by one, and one meeting of their pixels."""

import re

import numpy as np
from pyspark.sql import functions as F

from lakestat.operators import raster
from lakestat.plans import registry


def test_stacks_are_their_scenes():
    """Raw masks of one extent as a stack, refined ones among them, against each alone."""
    g = np.random.default_rng(11)
    raw, expected = np.zeros((4, 90, 110), bool), np.zeros((4, 90, 110), bool)
    for k in range(2):
        for q in range(5):
            raw[k, 20:70, 6 + 20 * q : 20 + 20 * q - k] = True
        expected[k, 15:80, 3:108] = True
    raw[2] = np.kron(g.random((18, 22)) < 0.4, np.ones((5, 5), bool))
    expected[2, :30, 40:] = True
    for given in (expected, None):
        got = raster.segmented(raw, given)
        want = [raster.segmented(m, None if given is None else given[k]) for k, m in enumerate(raw)]
        assert np.array_equal(got, want)
        assert [tuple(f) for f in zip(*raster.fragmentations(got), strict=True)] == [raster.fragmentation(m) for m in want]
    near = raster.buffered(expected, 15)
    cleaned = raster.anchored(raster.filled(raster.closed(raster.without_specks(raw & near), 3)), expected, near)
    assert [bool(x.any()) for x in raster.segmented(raw, expected) & ~cleaned] == [True, True, False, False]
    for corners in (False, True):
        count, labels = raster.in_scene(*raster.label(raw, corners))
        for k, m in enumerate(raw):
            alone, n = raster.label(m, corners)
            assert n == count[k] and np.array_equal(labels[k], alone)


def test_scenes_of_many_extents_meet_once(spark):
    """Several extents, places below 0, footprints given for some scenes or some pixels only, and small batches."""
    g = np.random.default_rng(12)
    rows, scenes = [], {}
    for k in range(60):
        h, w = ((8, 8), (9, 5), (30, 40))[k % 3]
        wet = np.kron(g.random((-(-h // 4), -(-w // 4))) < 0.6, np.ones((4, 4), bool))[:h, :w]
        within, scl = np.zeros((h, w), bool), np.where(g.random((h, w)) < 0.1, 9, 0)
        within[1:-1, 1:-2] = True
        scenes[k] = (wet, within if k % 4 else None, scl)
        for r in range(h):
            for c in range(w):
                known = None if k % 4 == 0 else True if within[r, c] else None if k % 4 == 1 else False
                rows.append((k, r - 3, c + 2, 0.06 if wet[r, c] else 0.01, 0.03, 0.08 if wet[r, c] else 0.4, 0.02 if wet[r, c] else 0.3, int(scl[r, c]), known, f"{k}"))
    df = spark.createDataFrame(rows, "scene_id long, row int, col int, b03 double, b04 double, b08 double, b11 double, scl int, expected boolean, note string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        pixels = raster.segment(df)
        water = {(r.scene_id, r.row, r.col): r.water for r in pixels.collect()}
        once = raster.segment_report(df)
        twice = raster.mask_report(pixels)
        assert pixels.columns == [*df.columns, "water", "confidence"] and pixels.where("note != scene_id").count() == 0
        got = {r.scene_id: r for r in once.collect()}
        assert got == {r.scene_id: r for r in twice.collect()} and len(got) == 60
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k, (wet, within, scl) in scenes.items():
        want = raster.segmented(wet, within)
        assert {(r, c): water[k, r - 3, c + 2] for r, c in np.ndindex(want.shape)} == {(r, c): want[r, c] for r, c in np.ndindex(want.shape)}
        inside = within if within is not None else np.zeros_like(wet)
        cloudy = int(((scl == 9) & raster.dilated(want, raster.CLOUD_PIXELS)).sum())
        n, largest, broken = raster.fragmentation(want)
        r = got[k]
        assert (r.total_pixels, r.water_pixels, r.components, r.largest_pixels, r.fragmentation, r.cloud_pixels) == (wet.size, int(want.sum()), n, largest, broken, cloudy)
        assert (r.has_prior, r.expected_pixels, r.overlap_pixels) == (within is not None, int(inside.sum()), int((want & inside).sum()))


def test_mask_quality_moves_pixels_once(spark):
    plan = registry.QUERIES["mask_quality"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bExchange\b", plan)) == 1 and "Join" not in plan


def test_scenes_longer_than_what_is_gathered(spark):
    """A scene of more pixels than are gathered at once, with small ones before and after it."""
    side = 300
    assert side * side > raster.AT_ONCE
    ids = spark.range(side * side + 2 * 16)
    big = F.col("id").between(16, side * side + 15)
    place = F.when(big, F.col("id") - 16).otherwise(F.col("id") % 16)
    wide = F.when(big, F.lit(side)).otherwise(4)
    df = ids.select(F.when(big, 5).otherwise(F.when(F.col("id") < 16, 1).otherwise(9)).cast("long").alias("scene_id"), F.floor(place / wide).cast("int").alias("row"), (place % wide).cast("int").alias("col"))
    df = df.repartition(4).withColumn("water", F.col("col") % 2 == 0).coalesce(1)
    got = {tuple(r) for r in raster.component_summary(raster.with_components(df)).select("scene_id", "components", "largest_pixels").collect()}
    assert got == {(1, 2, 4), (5, side // 2, side), (9, 2, 4)}
