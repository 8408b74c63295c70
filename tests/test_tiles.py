"""Masks in tiles against the same operators on whole arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakestat.operators import raster, tiles


def blocks(seed, h, w, share=0.5):
    """Blocks of wet pixels with specks and holes."""
    g = np.random.default_rng(seed)
    wet = np.kron(g.random((-(-h // 8), -(-w // 8))) < share, np.ones((8, 8), bool))[:h, :w]
    return wet ^ (g.random((h, w)) < 0.04)


def pixels(spark, scenes, shift=(0, 0)):
    rows = [(k, r + shift[0], c + shift[1], bool(m[r, c]), bool(e[r, c]) if e is not None else None) for k, (m, e) in scenes.items() for r in range(m.shape[0]) for c in range(m.shape[1])]
    return spark.createDataFrame(rows, "scene_id long, row int, col int, raw boolean, expected boolean")


def array(rows, shape, shift=(0, 0)):
    out = np.zeros(shape, bool)
    for r, c in rows:
        out[r - shift[0], c - shift[1]] = True
    return out


def test_components_cross_tiles(spark):
    g = np.random.default_rng(1)
    spiral = np.zeros((21, 21), bool)
    r = c = 0
    lo, hi, steps = 0, 20, []
    while lo <= hi:
        steps += [(lo, x) for x in range(lo, hi + 1)] + [(y, hi) for y in range(lo, hi + 1)] + [(hi, x) for x in range(lo + 1, hi + 1)] + [(y, lo + 1) for y in range(lo + 2, hi + 1)]
        lo, hi = lo + 2, hi - 2
    for r, c in steps:
        spiral[r, c] = True
    scenes = {1: (g.random((19, 23)) < 0.55, None), 2: (spiral, None), 3: (np.zeros((3, 3), bool), None), 4: (np.ones((9, 5), bool), None)}
    df = pixels(spark, scenes, (-5, 3))
    for corners in (False, True):
        got = {(r.scene_id, r.row + 5, r.col - 3): r.component for r in tiles.with_components(df, "raw", corners, tile=4).collect()}
        want = {}
        for k, (m, _) in scenes.items():
            labels, _ = raster.label(m, corners)
            want |= {(k, r, c): labels[r, c] for r, c in zip(*np.nonzero(m), strict=True)}
        assert got == want


@pytest.mark.parametrize("side", [4, 16])
def test_morphology_has_margins(spark, side):
    m = blocks(2, 37, 29)
    df = tiles.tiled(pixels(spark, {7: (m, None)}, (2, -9)).withColumnRenamed("raw", "mask"), ["mask"], side)
    got = lambda t: array([(r.row, r.col) for r in tiles.pixels_of(t, "out", side).collect()], m.shape, (2, -9))
    assert np.array_equal(got(tiles.buffered(df, "mask", "out", 4.5, side)), raster.buffered(m, 4.5))
    assert np.array_equal(got(tiles.dilated(df, "mask", "out", 3, side)), raster.dilated(m, 3))
    for k in (3, 9):
        assert np.array_equal(got(tiles.closed(df, "mask", "out", k, side)), raster.closed(m, k))
    for name in ("filled", "without_specks"):
        assert np.array_equal(got(getattr(tiles, name)(df, "mask", tile=side).withColumnRenamed("mask", "out")), getattr(raster, name)(m))


def test_segmentation_in_tiles_is_that_of_whole_scenes(spark):
    three, prior = np.zeros((120, 180), bool), np.zeros((120, 180), bool)
    for k in range(3):
        three[30:90, 20 + 42 * k : 58 + 42 * k] = True
    prior[25:95, 15:150] = True
    near = np.zeros((70, 90), bool)
    near[10:50, 20:60] = True
    scenes = {1: (three, prior), 2: (blocks(3, 70, 90), near), 3: (blocks(4, 50, 60), None), 4: (np.zeros((20, 20), bool), near[:20, :20]), 5: (blocks(5, 90, 70, 0.55), np.ones((90, 70), bool)), 6: (blocks(6, 40, 40), np.zeros((40, 40), bool))}
    masks, figures = tiles.segment(pixels(spark, scenes), 32)
    found = {}
    for r in tiles.pixels_of(masks, "mask", 32).collect():
        found.setdefault(r.scene_id, []).append((r.row, r.col))
    told = {r.scene_id: r for r in figures.collect()}
    assert set(told) == set(scenes) and told[1].kernel > 0
    for k, (m, e) in scenes.items():
        want = raster.segmented(m, e)
        assert np.array_equal(array(found.get(k, []), m.shape), want), k
        n, largest, broken = raster.fragmentation(want)
        assert (told[k].components, told[k].largest_pixels, told[k].pixels) == (n, largest, want.sum()) and abs(told[k].fragmentation - broken) < 1e-12
        assert told[k].overlap_pixels == ((want & e).sum() if e is not None else 0)


def test_odd_pixels(spark):
    df = spark.createDataFrame([(1, 0, 0, None, None), (1, 40, 40, True, None), (1, 40, 40, False, None), (None, 1, 1, True, True), (2, None, 1, True, True), (3, 1, None, True, True)], "scene_id long, row int, col int, raw boolean, expected boolean")
    t = tiles.tiled(df.withColumnRenamed("raw", "mask"), ["mask"], 16)
    assert t.count() == 9 and [tuple(r) for r in tiles.pixels_of(t, "mask", 16).collect()] == [(1, 40, 40)]
    assert [tuple(r) for r in tiles.with_components(df, "raw", tile=16).collect()] == [(1, 40, 40, 1)]
    masks, figures = tiles.segment(df.limit(0), 16)
    assert masks.count() == 0 and figures.count() == 0 and tiles.with_components(df.where(F.lit(False)), "raw").count() == 0


def test_mosaics_against_whole_arrays(spark):
    from lakestat.plans import model, registry

    d = "/root/testdata/sf0.001"
    df = model.mosaic(spark, d).toPandas()
    got = {r.scene_id: r for r in registry.QUERIES["mosaic_masks"](spark, d).collect()}
    assert set(got) == set(df["scene_id"])
    for k, part in df.groupby("scene_id"):
        m, e = (raster.grid(part, c, False).astype(bool) for c in ("raw", "expected"))
        want = raster.segmented(m, e)
        assert (got[k].pixels, got[k].overlap_pixels) == (want.sum(), (want & e).sum()) and (got[k].components, got[k].largest_pixels) == raster.fragmentation(want)[:2]


def whole_rings(mask, corners=(0, 0)):
    """{(component, hole, pixels, ring)} of a mask by the walks over a whole array."""
    labels, n = raster.label(mask, True)
    found = set()
    for k in range(1, n + 1):
        for ring in raster.outline(labels == k):
            area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False)) // 2
            found.add((k, area < 0, abs(area), tuple((x + corners[1], y + corners[0]) for x, y in ring)))
    return found


def test_rings_cross_tiles(spark):
    g = np.random.default_rng(11)
    board = np.indices((11, 9)).sum(axis=0) % 2 == 0
    nested = np.zeros((23, 23), bool)
    for k in range(0, 11, 2):
        nested[k : 23 - k, k : 23 - k] = True
        nested[k + 1 : 22 - k, k + 1 : 22 - k] = False
    comb = np.zeros((9, 40), bool)
    comb[0], comb[:, ::2] = True, True
    scenes = {1: (g.random((19, 23)) < 0.55, None), 2: (board, None), 3: (np.zeros((3, 3), bool), None), 4: (np.ones((9, 12), bool), None), 5: (nested, None), 6: (comb, None), 7: (g.random((8, 30)) < 0.35, None)}
    for side in (4, 16):
        got = {}
        for r in tiles.outlines(pixels(spark, scenes, (-5, 3)), "raw", side).collect():
            got.setdefault(r.scene_id, []).append((r.component, r.hole, r.pixels, tuple((p.x, p.y) for p in r.ring)))
        for k, (m, _) in scenes.items():
            rows = got.get(k, [])
            assert len(rows) == len(set(rows)) and set(rows) == whole_rings(m, (-5, 3)), (side, k)


def test_polygons_nest_their_holes(spark):
    m = blocks(12, 41, 33)
    m[5:30, 5:30] = True
    m[10:20, 10:20], m[12:15, 12:15] = False, True
    df = pixels(spark, {1: (m, None), 2: (np.zeros((4, 4), bool), None)}).withColumnRenamed("raw", "water")
    want = {r.scene_id: r for r in raster.boundaries(df, 500000.0, 2000000.0, 10.0, 43).collect()}
    got = tiles.boundaries(df, 500000.0, 2000000.0, 10.0, 43, tile=8).orderBy("component").collect()
    as_text = lambda polygons: [[[(p.lon, p.lat) for p in ring] for ring in rings] for rings in polygons]
    assert as_text([r.rings for r in got]) == as_text(want[1].polygons) and {r.scene_id for r in got} == {1} and not want[2].detected
    assert max(len(r.rings) for r in got) > 2 and all(r.m2 > raster.SLIVER_M2 for r in got)


def test_rings_of_odd_pixels(spark):
    df = spark.createDataFrame([(1, 0, 0, None, 1), (1, 40, 40, True, 2), (1, 40, 40, False, 3), (None, 1, 1, True, 4), (2, None, 1, True, 5)], "scene_id long, row int, col int, raw boolean, ring int")
    got = tiles.outlines(df, "raw", 16).collect()
    assert [(r.scene_id, r.component, r.hole, r.pixels, [(p.x, p.y) for p in r.ring]) for r in got] == [(1, 1, False, 1, [(40, 40), (41, 40), (41, 41), (40, 41), (40, 40)])]
    assert tiles.outlines(df.limit(0), "raw").count() == 0


def test_mosaic_rings_against_whole_arrays(spark):
    from lakestat.plans import model, registry

    d = "/root/testdata/sf0.001"
    df = model.mosaic(spark, d).toPandas()
    got = {}
    for r in registry.QUERIES["mosaic_outlines"](spark, d).collect():
        got.setdefault(r.scene_id, set()).add((r.component, r.hole, r.pixels, tuple((p.x, p.y) for p in r.ring)))
    for k, part in df.groupby("scene_id"):
        assert got[k] == whole_rings(raster.grid(part, "raw", False).astype(bool), (part["row"].min(), part["col"].min()))
