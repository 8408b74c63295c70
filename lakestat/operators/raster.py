"""Neighbourhood operators on masks: components, morphology, outlines, and the segmentation of a scene.

Scenes are small grids. Whole scenes meet in Arrow batches, and those of one extent are handled together by numpy, as an
array over scene, row and column: functions of masks work along the last two axes. Everything per pixel stays in column
expressions around it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geo, scalar

# Limits of the segmentation and its checks.
SPECK, EXPANSION, CONTEXT_PIXELS, CLOUD_PIXELS = 15, 60, 15, 5
REFINE_OVER, FRAGMENTED, KERNELS, INSIDE_LEAST, GROWTH_MOST, GAIN = 500, 0.50, (5, 7, 9), 85.0, 2.0, 0.05
WATER_LEAST, WATER_MOST, CLOUD_MOST, COVERAGE_WARNING, INSIDE_WARNING = 0.5, 95.0, 20.0, 5.0, 50.0
REGION_LEAST, REGION_SCORE = 4, 0.5


def label(mask: np.ndarray, corners: bool = False) -> tuple[np.ndarray, int]:
    """Components numbered from 1 in raster order, and their number; sides connect, and ``corners`` if asked.

    Roots are hooked to smaller ones and pointers doubled, so rounds grow with the logarithm of a component's extent.
    """
    at = np.arange(mask.size).reshape(mask.shape)
    pairs = [(at[..., :-1], at[..., 1:]), (at[..., :-1, :], at[..., 1:, :])] + ([(at[..., :-1, :-1], at[..., 1:, 1:]), (at[..., :-1, 1:], at[..., 1:, :-1])] if corners else [])
    flat = mask.ravel()
    i, j = (np.concatenate([p[k].ravel() for p in pairs]) for k in (0, 1))
    both = flat[i] & flat[j]
    i, j, root = i[both], j[both], np.arange(mask.size)
    while len(i):
        np.minimum.at(root, np.maximum(root[i], root[j]), np.minimum(root[i], root[j]))
        while not np.array_equal(root, further := root[root]):
            root = further
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
    number = np.cumsum(flat & (root == at.ravel()))
    return np.where(flat, number[root], 0).reshape(mask.shape), int(number[-1]) if mask.size else 0


def sizes(labels: np.ndarray, n: int) -> np.ndarray:
    """Pixels of each component; place 0, the background, counts none."""
    size = np.bincount(labels.ravel(), minlength=n + 1)
    size[0] = 0
    return size


def dilated(mask: np.ndarray, steps: int) -> np.ndarray:
    """Pixels within ``steps`` moves along rows and columns."""
    for _ in range(steps):
        out = mask.copy()
        out[..., 1:, :] |= mask[..., :-1, :]
        out[..., :-1, :] |= mask[..., 1:, :]
        out[..., 1:] |= mask[..., :-1]
        out[..., :-1] |= mask[..., 1:]
        mask = out
    return mask


def buffered(mask: np.ndarray, radius: float) -> np.ndarray:
    """Pixels whose middle is within ``radius`` pixels of the square of a mask pixel.

    So many rows away, these are the columns within a width of one: counts along the row differ at its ends.
    """
    reach, (h, w) = int(radius + 0.5), mask.shape[-2:]
    counts = np.zeros((*mask.shape[:-1], w + 1), dtype=np.int32)
    np.cumsum(mask, axis=-1, dtype=np.int32, out=counts[..., 1:])
    out, c = np.zeros_like(mask), np.arange(w)
    for dy in range(min(reach, h - 1) + 1):
        wide = max(dx for dx in range(reach + 1) if np.hypot(max(dx - 0.5, 0), max(dy - 0.5, 0)) <= radius)
        near = counts.take(np.minimum(c + wide + 1, w), axis=-1) > counts.take(np.maximum(c - wide, 0), axis=-1)
        out[..., dy:, :] |= near[..., : h - dy, :]
        out[..., : h - dy, :] |= near[..., dy:, :]
    return out


def _window(mask: np.ndarray, k: int, every: bool) -> np.ndarray:
    for axis in (-2, -1):
        n, along = mask.shape[axis], np.moveaxis(mask, axis, -1)
        p = np.pad(along, [(0, 0)] * (mask.ndim - 1) + [(k // 2, k // 2)])
        views = [p[..., d : d + n] for d in range(k)]
        mask = np.moveaxis((np.logical_and if every else np.logical_or).reduce(views), -1, axis)
    return mask


def closed(mask: np.ndarray, k: int) -> np.ndarray:
    """Closing by a k x k square; beyond the edge is background, which takes pixels there."""
    return _window(_window(mask, k, False), k, True)


def filled(mask: np.ndarray) -> np.ndarray:
    """With background that the edge does not reach filled."""
    labels, n = label(~mask)
    outside = np.zeros(n + 1, dtype=bool)
    for edge in (labels[..., 0, :], labels[..., -1, :], labels[..., 0], labels[..., -1]):
        outside[edge] = True
    return mask | ~outside[labels]


def without_specks(mask: np.ndarray, least: int = SPECK) -> np.ndarray:
    """Components of fewer pixels removed."""
    labels, n = label(mask)
    return (sizes(labels, n) >= least)[labels] & mask


def in_scene(labels: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Components of each scene of a stack, and the labels numbered from 1 in each."""
    scene = np.zeros(n + 1, dtype=np.int64)
    scene[labels] = np.arange(len(labels))[:, None, None]
    count = np.bincount(scene[1:], minlength=len(labels))
    return count, np.where(labels > 0, labels - (np.cumsum(count) - count)[:, None, None], 0)


def fragmentations(masks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``fragmentation`` of each scene of a stack."""
    labels, n = label(masks)
    count, _ = in_scene(labels, n)
    largest, pixels = np.zeros(len(masks), dtype=np.int64), masks.sum(axis=(-2, -1))
    np.maximum.at(largest, np.repeat(np.arange(len(masks)), count), sizes(labels, n)[1:])
    return count, largest, 1.0 - np.where(pixels > 0, largest / np.maximum(pixels, 1), 0.0)


def fragmentation(mask: np.ndarray) -> tuple[int, int, float]:
    """Number of components, pixels of the largest, and 1 less its share (1 for an empty mask)."""
    n, largest, broken = fragmentations(mask[None])
    return int(n[0]), int(largest[0]), float(broken[0])


def anchored(mask: np.ndarray, expected: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Components that meet the footprint, or are near it and large."""
    labels, n = label(mask)
    meets = np.bincount(labels[expected], minlength=n + 1) > 0
    near = np.bincount(labels[context], minlength=n + 1) > 0
    keep = meets | (near & (sizes(labels, n) >= EXPANSION))
    keep[0] = False
    return keep[labels]


def less_fragmented(mask: np.ndarray, expected: np.ndarray, context: np.ndarray) -> np.ndarray:
    """A wider closing where it joins a fragmented mask without leaving the footprint; else the mask."""
    pixels, before = int(mask.sum()), fragmentation(mask)[2]
    if pixels <= REFINE_OVER or before <= FRAGMENTED:
        return mask
    options = []
    for k in KERNELS:
        option = anchored(filled(closed(mask, k)) & context, expected, context)
        n, after = int(option.sum()), fragmentation(option)[2]
        inside = 100.0 * (option & expected).sum() / max(n, 1)
        if n > pixels and inside >= INSIDE_LEAST and n <= GROWTH_MOST * pixels and after < before - GAIN:
            options.append((after, n, k, option))
    return min(options, key=lambda o: o[:3])[3] if options else mask


def segmented(raw: np.ndarray, expected: np.ndarray | None) -> np.ndarray:
    """Raw water pixels cleaned: context, specks, closing, holes, footprint, fragmentation, in this order."""
    if expected is None:
        return filled(closed(without_specks(raw), 3))
    context = buffered(expected, CONTEXT_PIXELS)
    mask = anchored(filled(closed(without_specks(raw & context), 3)), expected, context)
    if mask.ndim == 2:
        return less_fragmented(mask, expected, context)
    for k in np.flatnonzero(mask.sum(axis=(-2, -1)) > REFINE_OVER):
        mask[k] = less_fragmented(mask[k], expected[k], context[k])
    return mask


def outline(mask: np.ndarray) -> list[list[tuple[int, int]]]:
    """Closed rings of (col, row) corners around the pixels of a mask, pixels that touch at a corner in one ring.

    Sides are walked with the mask on the right; where four sides meet, the walk turns left, over the corner.
    """
    p = np.pad(mask, 1)
    inner = p[1:-1, 1:-1]
    out: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for beyond, a, b in (((slice(None, -2), slice(1, -1)), (0, 0), (1, 0)), ((slice(1, -1), slice(2, None)), (1, 0), (1, 1)), ((slice(2, None), slice(1, -1)), (1, 1), (0, 1)), ((slice(1, -1), slice(None, -2)), (0, 1), (0, 0))):
        for r, c in zip(*np.nonzero(inner & ~p[beyond]), strict=True):
            out.setdefault((int(c) + a[0], int(r) + a[1]), []).append((int(c) + b[0], int(r) + b[1]))
    rings = []
    while out:
        start = min(out)
        ring, at, came = [start], start, None
        while True:
            options = out[at]
            left = (came[1], -came[0]) if came else None
            to = next((o for o in options if left and (o[0] - at[0], o[1] - at[1]) == left), options[0])
            options.remove(to)
            if not options:
                del out[at]
            step = (to[0] - at[0], to[1] - at[1])
            if step == came:
                ring.pop()
            ring.append(to)
            at, came = to, step
            if at == start:
                break
        rings.append(ring)
    return rings


def grid(pixels: pd.DataFrame, column: str, fill) -> np.ndarray:
    """A column of one scene's pixels as an array over its rows and columns."""
    r, c = pixels["row"].to_numpy(), pixels["col"].to_numpy()
    out = np.full((r.max() - r.min() + 1, c.max() - c.min() + 1), fill)
    out[r - r.min(), c - c.min()] = pixels[column].fillna(fill).to_numpy()
    return out


# Pixels gathered before scenes are run, and the most pixels of a stack of more than one scene.
AT_ONCE, STACKED = 1 << 16, 1 << 18


@dataclass
class Stack:
    """Scenes of one extent: their first rows, all their rows in the batch, and where these are in (scene, row, column)."""

    firsts: np.ndarray
    rows: np.ndarray
    at: tuple[np.ndarray, np.ndarray, np.ndarray]
    shape: tuple[int, int, int]

    def grid(self, values: np.ndarray, fill=False) -> np.ndarray:
        """A column of the batch as an array over scenes, their rows and columns."""
        out = np.full(self.shape, fill)
        out[self.at] = values[self.rows]
        return out


def column(batch: pa.Table, name: str) -> np.ndarray:
    return batch[name].to_numpy()


def stacks(batch: pa.Table, given: str | None = None) -> Iterator[Stack]:
    """The scenes of a batch by extent, and apart where any pixel has ``given``."""
    scene, row, col = (column(batch, c) for c in ("scene_id", "row", "col"))
    first = np.flatnonzero(np.concatenate([[True], scene[1:] != scene[:-1]]))
    n = np.diff(first, append=len(scene))
    r0, c0 = np.minimum.reduceat(row, first), np.minimum.reduceat(col, first)
    h, w = (np.maximum.reduceat(v, first).astype(np.int64) - v0 + 1 for v, v0 in ((row, r0), (col, c0)))
    apart = np.logical_or.reduceat(column(batch, given), first) if given else np.zeros(len(first), dtype=bool)
    kinds, kind, count = np.unique(np.stack([h, w, apart], axis=1), axis=0, return_inverse=True, return_counts=True)
    ordered, end = np.argsort(kind.ravel(), kind="stable"), np.cumsum(count)
    for (height, width, _), a, b in zip(kinds, end - count, end, strict=True):
        most = max(STACKED // int(height * width), 1)
        for k in range(a, b, most):
            chosen = ordered[k : min(k + most, b)]
            place = np.repeat(np.arange(len(chosen)), n[chosen])
            rows = np.arange(len(place)) + (first[chosen] - (np.cumsum(n[chosen]) - n[chosen]))[place]
            yield Stack(first[chosen], rows, (place, row[rows] - r0[chosen][place], col[rows] - c0[chosen][place]), (len(chosen), int(height), int(width)))


def by_scene(pixels: DataFrame, run: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``run`` on the pixels of many scenes at once: rows meet by scene, and batches are cut where one ends.

    ``run`` takes and returns an Arrow table of whole scenes. A scene that is split between batches waits for its rest.
    """

    def scenes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            last = batch["scene_id"][-1].as_py()
            if rows < AT_ONCE or held[0]["scene_id"][0].as_py() == last:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            end = int(np.searchsorted(column(table, "scene_id"), last))
            yield from run(table.slice(0, end)).to_batches()
            held, rows = table.slice(end).to_batches(), len(table) - end
        if held:
            yield from run(pa.Table.from_batches(held).combine_chunks()).to_batches()

    return pixels.where("scene_id is not null").repartition("scene_id").sortWithinPartitions("scene_id").mapInArrow(scenes, schema)


def places() -> list[Column]:
    return [F.col("scene_id").cast("long"), F.col("row").cast("int"), F.col("col").cast("int")]


def with_components(pixels: DataFrame, mask: str = "water", corners: bool = False) -> DataFrame:
    """(scene_id, row, col, component): mask pixels with their component's number within the scene."""

    def run(batch: pa.Table) -> pa.Table:
        component = np.empty(len(batch), dtype=np.int64)
        for stack in stacks(batch):
            labels, n = label(stack.grid(np.ones(len(batch), dtype=bool)), corners)
            component[stack.rows] = in_scene(labels, n)[1][stack.at]
        return batch.append_column("component", pa.array(component))

    return by_scene(pixels.where(mask).select(*places()), run, "scene_id long, row int, col int, component long")


def component_summary(components: DataFrame) -> DataFrame:
    """Per scene: components, mask pixels, the largest, its share and the fragmentation."""
    each = components.groupBy("scene_id", "component").agg(F.count("*").alias("n"))
    share = F.max("n") / F.sum("n")
    return each.groupBy("scene_id").agg(F.count("*").alias("components"), F.sum("n").alias("water_pixels"), F.max("n").alias("largest_pixels"), share.alias("largest_ratio"), (1 - share).alias("fragmentation"))


def water_rule() -> Column:
    return scalar.is_water(F.col("b03"), F.col("b04"), F.col("b08"), F.col("b11"), F.col("scl"))


def raw_water(pixels: DataFrame) -> DataFrame:
    """Pixels with the water rule's verdict ``raw``."""
    return pixels.withColumn("raw", water_rule())


def _flags() -> dict[str, Column]:
    """What masks and their checks take of a pixel, without nulls: the footprint, whether that is given, and clouds."""
    cloud = F.coalesce(F.col("scl").isin(*scalar.CLOUD_CLASSES), F.lit(False))
    return {"_expected": F.coalesce("expected", F.lit(False)), "_given": F.col("expected").isNotNull(), "_cloud": cloud}


def _cleaned(batch: pa.Table) -> Iterator[tuple[Stack, np.ndarray, np.ndarray, bool]]:
    """The scenes of a batch with their cleaned masks, footprints, and whether these are given."""
    raw, expected, given = (column(batch, c) for c in ("_raw", "_expected", "_given"))
    for stack in stacks(batch, "_given"):
        within, known = stack.grid(expected), bool(given[stack.rows].any())
        yield stack, segmented(stack.grid(raw), within if known else None), within, known


def segment(pixels: DataFrame) -> DataFrame:
    """Pixels (scene_id, row, col, bands, scl, expected) with water and confidence; expected may be null throughout."""
    key = ["scene_id", "row", "col"]
    given = pixels.select(*key, *[c for c in pixels.columns if c not in key])
    names = given.columns

    def run(batch: pa.Table) -> pa.Table:
        water = np.zeros(len(batch), dtype=bool)
        for stack, mask, _, _ in _cleaned(batch):
            water[stack.rows] = mask[stack.at]
        return batch.select(names).append_column("water", pa.array(water))

    flags = _flags()
    df = given.withColumns({"_raw": water_rule(), "_expected": flags["_expected"], "_given": flags["_given"]})
    df = by_scene(df, run, T.StructType([*given.schema.fields, T.StructField("water", T.BooleanType())]))
    return df.withColumn("confidence", scalar.water_confidence(F.col("b03"), F.col("b08"), F.col("b11"), F.col("scl"), F.col("water")))


_REPORT = "scene_id long, total_pixels long, water_pixels long, components long, largest_pixels long, fragmentation double, cloud_pixels long, has_prior boolean, expected_pixels long, overlap_pixels long"


def _reported(batch: pa.Table, found: Iterator[tuple[Stack, np.ndarray, np.ndarray, bool]]) -> pa.Table:
    """A row of counts for each scene of stacks with masks, footprints, and whether these are given."""
    scene, cloud, names, parts = column(batch, "scene_id"), column(batch, "_cloud"), [c.split()[0] for c in _REPORT.split(", ")], []
    for stack, mask, expected, known in found:
        n, largest, broken = fragmentations(mask)
        size = mask[0].size
        total = lambda m: m.sum(axis=(-2, -1), dtype=np.int64)
        cloudy = total(stack.grid(cloud) & dilated(mask, CLOUD_PIXELS))
        rows = [scene[stack.firsts], np.full(len(n), size), total(mask), n, largest, broken, cloudy, np.full(len(n), known), total(expected), total(mask & expected)]
        parts.append(pa.table(dict(zip(names, rows, strict=True))))
    return pa.concat_tables(parts).combine_chunks()


def mask_report(segmented_pixels: DataFrame) -> DataFrame:
    """Per scene the checks of its mask, with status, warnings and failures as codes."""

    def run(batch: pa.Table) -> pa.Table:
        water, expected, given = (column(batch, c) for c in ("_water", "_expected", "_given"))
        return _reported(batch, ((k, k.grid(water), k.grid(expected), bool(given[k.rows].any())) for k in stacks(batch, "_given")))

    flags = _flags() | {"_water": F.coalesce("water", F.lit(False))}
    return mask_status(by_scene(segmented_pixels.select(*places(), *[c.alias(k) for k, c in flags.items()]), run, _REPORT))


def segment_report(pixels: DataFrame) -> DataFrame:
    """``mask_report`` of ``segment``; scenes meet once, and only what is asked of a pixel travels."""
    flags = _flags() | {"_raw": water_rule()}
    df = pixels.select(*places(), *[c.alias(k) for k, c in flags.items()])
    return mask_status(by_scene(df, lambda batch: _reported(batch, _cleaned(batch)), _REPORT))


def mask_status(report: DataFrame) -> DataFrame:
    """Counts of ``mask_report`` with percentages, codes and status."""
    water, overlap = F.col("water_pixels"), F.col("overlap_pixels")
    df = report.withColumn("water_pct", water / F.col("total_pixels") * 100).withColumn("water_area_km2", water * 1e-4)
    df = df.withColumn("largest_ratio", F.when(water > 0, F.col("largest_pixels") / water).otherwise(0.0))
    df = df.withColumn("cloud_pct", F.col("cloud_pixels") / F.greatest(water, F.lit(1)) * 100)
    df = df.withColumn("inside_pct", F.when(F.col("has_prior") & (water > 0), overlap / water * 100).otherwise(0.0))
    df = df.withColumn("out_pct", F.when(F.col("has_prior") & (water > 0), 100 - F.col("inside_pct")).otherwise(0.0))
    df = df.withColumn("coverage_pct", F.when(F.col("has_prior") & (F.col("expected_pixels") > 0), overlap / F.col("expected_pixels") * 100).otherwise(0.0))
    failures = [
        F.when(F.col("water_pct") < WATER_LEAST, "too_little_water").when(F.col("water_pct") > WATER_MOST, "too_much_water"),
        F.when((F.col("fragmentation") > FRAGMENTED) & (water > REFINE_OVER), "fragmentation"),
        F.when(F.col("cloud_pct") > CLOUD_MOST, "cloud"),
    ]
    warnings = [
        F.when(F.col("has_prior") & (water > 0) & (F.col("coverage_pct") < COVERAGE_WARNING), "low_coverage"),
        F.when(F.col("has_prior") & (water > REFINE_OVER) & (F.col("inside_pct") < INSIDE_WARNING), "outside_footprint"),
    ]
    df = df.withColumn("failures", F.array_compact(F.array(*failures))).withColumn("warnings", F.array_compact(F.array(*warnings)))
    status: Column = (
        F.when(F.array_contains("failures", "cloud"), "excessive_cloud_overlap")
        .when(F.array_contains("failures", "fragmentation"), "low_confidence_mask")
        .when(F.size("failures") > 0, "degraded")
        .when(F.size("warnings") > 0, "ok_with_warning")
        .otherwise("ok")
    )
    return df.withColumn("status", status).withColumn("is_valid", F.size("failures") == 0)


def pixel_scores(pixels: DataFrame, baseline: dict[str, tuple[float, float]]) -> DataFrame:
    """Water pixels with a score per indicator and their weighted mean ``score`` (0 outside water)."""
    weights = {k: scalar.SCORE_WEIGHTS[k] for k in ("turbidity", "chlorophyll", "algal") if k in baseline}
    df = pixels
    for k in weights:
        z = scalar.z_score(F.col(k), F.lit(baseline[k][0]), F.lit(baseline[k][1]))
        df = df.withColumn(f"{k}_score", F.coalesce(scalar.z_to_score(z, None), F.lit(0.0)))
    total = sum(weights.values())
    score = sum((w / total * F.col(f"{k}_score") for k, w in weights.items()), F.lit(0.0))
    return df.withColumn("score", F.when(F.col("water"), score).otherwise(0.0))


def pixel_area_km2(a: float, b: float, d: float, e: float) -> float:
    """Area of a pixel of an affine transform with x = a col + b row + c and y = d col + e row + f."""
    return abs(a * e - b * d) / 1e6


def anomalous_pixels(scored: DataFrame) -> DataFrame:
    """(scene_id, row, col, region, score, confidence, scores): anomalous water pixels with the number of their region.

    Components connected by sides and smaller than REGION_LEAST go; what remains is grouped by sides and corners. Only
    anomalous pixels travel.
    """

    def run(batch: pa.Table) -> pa.Table:
        region = np.empty(len(batch), dtype=np.int64)
        for stack in stacks(batch):
            labels, n = label(without_specks(stack.grid(np.ones(len(batch), dtype=bool)), REGION_LEAST), True)
            region[stack.rows] = in_scene(labels, n)[1][stack.at]
        return batch.append_column("region", pa.array(region)).filter(pa.array(region > 0))

    values = ["score", "confidence", *(f"{k}_score" for k in ("turbidity", "chlorophyll", "algal") if f"{k}_score" in scored.columns)]
    # Through inline, scores are worked out once: as a plain filter their whole expression would be repeated.
    once = F.inline(F.array(F.struct((F.col("water") & (F.col("score") >= REGION_SCORE)).alias("hot"), *[F.col(c).cast("double").alias(c) for c in values])))
    hot = scored.select(*places(), once).where("hot").drop("hot")
    return by_scene(hot, run, f"scene_id long, row int, col int, {', '.join(f'{c} double' for c in values)}, region long")


def anomaly_regions(scored: DataFrame, pixel_area_km2: float = 1e-4) -> DataFrame:
    """Per scene its regions of anomalous water pixels with their statistics."""
    names = [k for k in ("turbidity", "chlorophyll", "algal") if f"{k}_score" in scored.columns]
    means = [F.avg(f"{k}_score").alias(f"{k}_score") for k in names]
    df = anomalous_pixels(scored).groupBy("scene_id", "region").agg(F.count("*").alias("pixels"), F.avg("score").alias("score"), F.avg("confidence").alias("confidence"), *means)
    first = F.array_max(F.array(*[F.struct(F.col(f"{k}_score").alias("s"), F.lit(-i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(names)]))
    return df.withColumn("area_km2", F.round(F.col("pixels") * pixel_area_km2, 6)).withColumn("dominant", first["k"])


def anomaly_extent(scored: DataFrame, pixel_area_km2: float = 1e-4) -> DataFrame:
    """Per scene: anomalous pixels in regions, their area and mean confidence; without any 0 pixels and nulls."""
    found = anomalous_pixels(scored).groupBy("scene_id").agg(F.count("*").alias("n"), F.avg("confidence").alias("c"))
    df = scored.select("scene_id").distinct().join(found, "scene_id", "left")
    return df.select("scene_id", F.coalesce("n", F.lit(0)).alias("anomalous_pixels"), F.round(F.col("n") * pixel_area_km2, 6).alias("affected_area_km2"), F.round("c", 4).alias("confidence"))


def footprint(pixels: DataFrame, bodies: DataFrame, left: float, top: float, size: float, all_touched: bool = True) -> DataFrame:
    """Pixels with ``expected``: whether they belong to the body's ring, in the raster's own metres.

    With ``all_touched`` every pixel that meets the ring counts, else those whose middle is inside. ``bodies``
    (scene_id, ring) has one row per scene and is joined by it.
    """
    x, y = F.lit(left) + F.col("col") * size, F.lit(top) - F.col("row") * size
    inside = geo.touches(F.col("ring"), x, y - size, x + size, y) if all_touched else geo.contains(F.col("ring"), x + size / 2, y - size / 2)
    return pixels.join(bodies.select("scene_id", "ring"), "scene_id", "left").withColumn("expected", inside).drop("ring")


def degrees(x: Column, y: Column, zone: int, south: bool) -> Column:
    """A point of a zone, in metres, as (lon, lat)."""
    lon, lat = geo.from_utm(x, y, F.lit(zone), F.lit(south))
    return F.struct(lon.alias("lon"), lat.alias("lat"))


def outlines(components: DataFrame, left: float, top: float, size: float, zone: int, south: bool = False) -> DataFrame:
    """(scene_id, component, part, ring): the rings around each component in degrees; ``part`` 0 is the outer one.

    ``components``: scene_id, row, col, component, with pixels that touch at a corner in one component.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = part["row"].min(), part["col"].min()
        rings = sorted(outline(grid(part.assign(_in=True), "_in", False).astype(bool)), key=lambda r: (-len(r), r))
        rings = sorted(rings, key=lambda r: -abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:], strict=False))))
        rows = [(part["scene_id"].iloc[0], part["component"].iloc[0], k, [{"x": left + (c0 + x) * size, "y": top - (r0 + y) * size} for x, y in ring]) for k, ring in enumerate(rings)]
        return pd.DataFrame(rows, columns=["scene_id", "component", "part", "flat"])

    flat = components.groupBy("scene_id", "component").applyInPandas(run, "scene_id long, component long, part int, flat array<struct<x:double,y:double>>")

    return flat.select("scene_id", "component", "part", F.transform("flat", lambda p: degrees(p["x"], p["y"], zone, south)).alias("ring"))


# Fixed value: outlines of at most this area, in square metres, are not part of a boundary.
SLIVER_M2 = 2000.0


def boundaries(mask: DataFrame, left: float, top: float, size: float, zone: int, south: bool = False) -> DataFrame:
    """(scene_id, detected, polygons): the outline of each scene's water mask in degrees, without slivers.

    ``mask``: scene_id, row, col, water. polygons: an array over components (pixels that touch at a corner in one) of an
    array of rings, the outer first, holes after it. Components share no side, so together they are their union. An
    outline's area is that of its pixels.
    """
    parts = with_components(mask, corners=True)
    large = parts.groupBy("scene_id", "component").agg((F.count("*") * size * size).alias("m2")).where(F.col("m2") > SLIVER_M2)
    rings = outlines(parts.join(large.select("scene_id", "component"), ["scene_id", "component"]), left, top, size, zone, south)
    each = rings.groupBy("scene_id", "component").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "ring"))), lambda r: r["ring"]).alias("rings"))
    whole = each.groupBy("scene_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("component", "rings"))), lambda p: p["rings"]).alias("polygons"))
    df = mask.select("scene_id").distinct().join(whole, "scene_id", "left")
    none = F.array().cast("array<array<array<struct<lon:double,lat:double>>>>")
    return df.select("scene_id", F.col("polygons").isNotNull().alias("detected"), F.coalesce("polygons", none).alias("polygons"))
