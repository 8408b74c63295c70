"""Masks in tiles: components, morphology and the segmentation of ``raster`` for scenes larger than a task.

A scene is a table of square tiles, a row each, whose masks are bitmaps (TILE x TILE bits). What looks at neighbours gets
a margin from the tiles around; components are numbered within tiles, tied where they meet over a border, and contracted
by joins. No row is larger than a tile with its margin, and keys are tiles or components, never a whole scene. Each step is
kept in ``spark.checkpoint.dir`` (see ``stored``), so a lost executor costs the tiles it held. Joins are merges by hint:
a broadcast at every step would send the driver more the more scenes there are.

Tables of tiles have scene_id, kernel (0; a width of closing where several are tried), ti, tj, the scene's first and last
rows and columns r0, r1, c0, c1, and binary columns, one per mask.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from . import raster

TILE = 256
KEY = ["scene_id", "kernel"]
AT = [*KEY, "ti", "tj"]
EXTENT = ["r0", "r1", "c0", "c1"]
_AT = "scene_id long, kernel int, ti int, tj int"


def bits(mask: np.ndarray) -> bytes:
    """A mask as a bitmap, row after row."""
    return np.packbits(mask).tobytes()


def mask_of(packed: bytes, shape: tuple[int, int]) -> np.ndarray:
    """The mask of a bitmap."""
    return np.unpackbits(np.frombuffer(packed, np.uint8), count=shape[0] * shape[1]).reshape(shape).astype(bool)


# Rows of tiles that are handed on together.
BATCH = 64


def _mapped(df: DataFrame, run: Callable[..., Iterator], schema: str) -> DataFrame:
    """``run`` on each row; what it yields, tuples or frames of the schema, is handed on a few tiles at a time."""
    names = [f.split()[0] for f in schema.split(", ")]

    def frame(held: list) -> pd.DataFrame:
        return pd.concat(held, ignore_index=True) if isinstance(held[0], pd.DataFrame) else pd.DataFrame(held, columns=names)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []
        for part in frames:
            for row in part.itertuples(index=False):
                held += run(row)
                if len(held) >= BATCH:
                    yield frame(held)
                    held = []
        if held:
            yield frame(held)

    # Tiles are few bytes and much work: left to their bytes, they would all be one task's.
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism).mapInPandas(batches, schema)


def tiled(pixels: DataFrame, masks: list[str], tile: int = TILE) -> DataFrame:
    """Tiles of the boolean columns ``masks`` of pixels (scene_id, row, col, ...), with ``<mask>_given`` for the scene.

    ``given`` is whether the mask is other than null anywhere. Pixels that are null or absent between a scene's first and
    last rows and columns are false; pixels without scene, row or column are left out; of repeated ones any sets the bit.
    """
    df = pixels.where("scene_id is not null and row is not null and col is not null")
    ti, tj = (F.floor(F.col(c) / tile).cast("int") for c in ("row", "col"))
    place = (F.pmod("row", F.lit(tile)) * tile + F.pmod("col", F.lit(tile))).cast("int")
    ends = [f(c).cast("int").alias(e) for c, e, f in (("row", "r0", F.min), ("row", "r1", F.max), ("col", "c0", F.min), ("col", "c1", F.max))]
    cells = df.groupBy(F.col("scene_id").cast("long").alias("scene_id"), ti.alias("ti"), tj.alias("tj")).agg(*ends, *[F.collect_list(F.when(F.col(m), place)).alias(m) for m in masks], *[F.bool_or(F.col(m).isNotNull()).alias(f"{m}_given") for m in masks])
    cells = stored(cells)
    given = [f"{m}_given" for m in masks]
    whole = cells.groupBy("scene_id").agg(F.min("r0").alias("r0"), F.max("r1").alias("r1"), F.min("c0").alias("c0"), F.max("c1").alias("c1"), *[F.bool_or(g).alias(g) for g in given])
    for t, a, b in (("ti", "r0", "r1"), ("tj", "c0", "c1")):
        whole = whole.withColumn(t, F.explode(F.sequence(F.floor(F.col(a) / tile).cast("int"), F.floor(F.col(b) / tile).cast("int"))))
    df = whole.withColumn("kernel", F.lit(0)).hint("merge").join(cells.select("scene_id", "ti", "tj", *masks), ["scene_id", "ti", "tj"], "left")
    schema = f"{_AT}, {', '.join(f'{e} int' for e in EXTENT)}, {', '.join(f'{g} boolean' for g in given)}, {', '.join(f'{m} binary' for m in masks)}"

    def pack(t) -> Iterator[tuple]:
        maps = []
        for m in masks:
            found, at = np.zeros(tile * tile, bool), getattr(t, m)
            if at is not None:
                found[np.asarray(at, dtype=np.int64)] = True
            maps.append(bits(found))
        yield (*[getattr(t, c) for c in [*AT, *EXTENT, *given]], *maps)

    return stored(_mapped(df.select(*AT, *EXTENT, *given, *masks), pack, schema))


def _inside(t, tile: int, margin: int = 0) -> np.ndarray:
    """Which places of a tile with its margin belong to the scene."""
    r, c = (np.arange(-margin, tile + margin) + k * tile for k in (t.ti, t.tj))
    return ((r >= t.r0) & (r <= t.r1))[:, None] & ((c >= t.c0) & (c <= t.c1))


def _shared(d: int, tile: int, reach: int) -> slice:
    """The places of a tile that lie within ``reach`` of the tile ``d`` further on."""
    return slice(max(0, d * tile - reach), min(tile, (d + 1) * tile + reach))


def _margins(tiles: DataFrame, mask: str, reach: int, tile: int) -> DataFrame:
    """Tiles with the strips of a mask that lie on them or within ``reach`` of them.

    A tile sends its neighbours the strips that they need, empty ones not at all. ``reach`` may exceed a tile.
    """
    around = -(-reach // tile)

    def send(t) -> Iterator[tuple]:
        own, found = mask_of(getattr(t, mask), (tile, tile)), []
        for ti in range(max(t.ti - around, t.r0 // tile), min(t.ti + around, t.r1 // tile) + 1):
            for tj in range(max(t.tj - around, t.c0 // tile), min(t.tj + around, t.c1 // tile) + 1):
                di, dj = ti - t.ti, tj - t.tj
                strip = own[_shared(di, tile, reach), _shared(dj, tile, reach)]
                if (di, dj) == (0, 0) or strip.any():
                    found.append((t.scene_id, t.kernel, ti, tj, t.r0, t.r1, t.c0, t.c1, struct.pack("<ii", di, dj) + bits(strip)))
        yield from found

    sent = _mapped(tiles.select(*AT, *EXTENT, mask), send, f"{_AT}, {', '.join(f'{e} int' for e in EXTENT)}, strip binary")
    return sent.groupBy(*AT, *EXTENT).agg(F.collect_list("strip").alias("strips"))


def _met(t, reach: int, tile: int) -> np.ndarray:
    """The mask of a tile with its margin, of its strips."""
    whole = np.zeros((tile + 2 * reach,) * 2, bool)
    for strip in t.strips:
        (di, dj), rest = struct.unpack("<ii", strip[:8]), strip[8:]
        r, c = _shared(di, tile, reach), _shared(dj, tile, reach)
        to = [slice(s.start - d * tile + reach, s.stop - d * tile + reach) for s, d in ((r, di), (c, dj))]
        whole[to[0], to[1]] = mask_of(rest, (r.stop - r.start, c.stop - c.start))
    return whole


def with_margin(tiles: DataFrame, mask: str, out: str, reach: int, run: Callable[[np.ndarray, np.ndarray, int], np.ndarray], tile: int = TILE) -> DataFrame:
    """Tiles with ``out``: ``run(mask with a margin, what of it is in the scene, kernel)`` without the margin."""

    def meet(t) -> Iterator[tuple]:
        done = run(_met(t, reach, tile), _inside(t, tile, reach), t.kernel)
        yield (t.scene_id, t.kernel, t.ti, t.tj, bits(done[reach:-reach, reach:-reach]))

    return stored(tiles.drop(out).hint("merge").join(_mapped(_margins(tiles, mask, reach, tile), meet, f"{_AT}, {out} binary"), AT))


def buffered(tiles: DataFrame, mask: str, out: str, radius: float, tile: int = TILE) -> DataFrame:
    """``raster.buffered`` over tiles, within the scene."""
    return with_margin(tiles, mask, out, int(radius + 0.5) + 1, lambda m, inside, _: raster.buffered(m, radius) & inside, tile)


def dilated(tiles: DataFrame, mask: str, out: str, steps: int, tile: int = TILE) -> DataFrame:
    """``raster.dilated`` over tiles, within the scene."""
    return with_margin(tiles, mask, out, max(steps, 1), lambda m, inside, _: raster.dilated(m, steps) & inside, tile)


def closed(tiles: DataFrame, mask: str, out: str, most: int, tile: int = TILE) -> DataFrame:
    """``raster.closed`` over tiles by a square of ``most``, or of the tile's kernel where that is not 0.

    What the first half grows beyond the scene is background again before the second, as at the edge of an array.
    """

    def run(m: np.ndarray, inside: np.ndarray, kernel: int) -> np.ndarray:
        k = kernel or most
        grown = np.lib.stride_tricks.sliding_window_view(np.pad(m, k // 2), (k, k)).any(axis=(2, 3)) & inside
        return np.lib.stride_tricks.sliding_window_view(np.pad(grown, k // 2), (k, k)).all(axis=(2, 3)) & inside

    return with_margin(tiles, mask, out, 2 * (most // 2), run, tile)


def roots(links: DataFrame, key: list[str]) -> DataFrame:
    """(key, node, root) of every node of ``links`` (key, a, b): the smallest node of the key that it reaches.

    Every node points to its smallest neighbour, pointers are followed to their ends by doubling, and links between
    different ends make the next round; nodes with links halve at least.
    """
    links, known = stored(links.where("a != b").distinct()), None
    while True:
        both = links.select(*key, "a", "b").union(links.select(*key, "b", "a"))
        ends = stored(both.groupBy(*key, F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("root")))
        while True:
            up = ends.select(*key, F.col("node").alias("root"), F.col("root").alias("top"))
            moved = stored(ends.hint("merge").join(up, [*key, "root"], "left").select(*key, "node", F.coalesce("top", "root").alias("root"), (F.col("top") != F.col("root")).alias("moved")))
            ends = moved.drop("moved")
            if moved.where("moved").isEmpty():
                break
        step = ends.select(*key, F.col("node").alias("root"), F.col("root").alias("top"))
        known = ends if known is None else stored(known.hint("merge").join(step, [*key, "root"], "left").select(*key, "node", F.coalesce("top", "root").alias("root")))
        for c in ("a", "b"):
            links = links.hint("merge").join(ends.select(*key, F.col("node").alias(c), F.col("root").alias(f"_{c}")), [*key, c])
        links = stored(links.select(*key, F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).where("a != b").distinct())
        if links.isEmpty():
            return known


_PARTS = f"{_AT}, role string, local int, id long, n long, edge boolean, meets long, near long, row int, col int"


def _labels(t, mask: str, dry: bool, corners: bool, tile: int) -> tuple[np.ndarray, int]:
    m = mask_of(getattr(t, mask), (tile, tile))
    return raster.label(_inside(t, tile) & ~m if dry else m, corners)


def components(tiles: DataFrame, mask: str, dry: bool = False, corners: bool = False, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """Components of a mask, or of what is ``dry`` in its scene, as two tables.

    Parts: a row for each component within a tile (AT, local, its number there; root). Whole ones (KEY, root): pixels n,
    whether they touch the scene's ``edge``, and how many pixels ``meets`` and ``near`` lie in the masks ``expected`` and
    ``context``, if tiles have these. A root is the place of the component's first pixel in its scene, row after row.
    """
    beside = [m for m in ("expected", "context") if m in tiles.columns]

    def run(t) -> Iterator[pd.DataFrame]:
        labels, n = _labels(t, mask, dry, corners, tile)
        if not n:
            return
        wide, r, c = t.c1 - t.c0 + 1, np.arange(tile) + t.ti * tile, np.arange(tile) + t.tj * tile
        first = np.unique(labels.ravel(), return_index=True)[1][-n:]
        ids = (t.ti * tile + first // tile - t.r0).astype(np.int64) * wide + (t.tj * tile + first % tile - t.c0)
        count = {m: np.bincount(labels[mask_of(getattr(t, m), (tile, tile))], minlength=n + 1)[1:] for m in beside}
        edge = np.zeros(n + 1, bool)
        edge[labels[((r == t.r0) | (r == t.r1))[:, None] | ((c == t.c0) | (c == t.c1))]] = True
        at = {"scene_id": t.scene_id, "kernel": t.kernel, "ti": t.ti, "tj": t.tj}
        none = np.zeros(n, np.int64)
        yield pd.DataFrame({**at, "role": "part", "local": np.arange(1, n + 1), "id": ids, "n": np.bincount(labels.ravel(), minlength=n + 1)[1:], "edge": edge[1:], "meets": count.get("expected", none), "near": count.get("context", none), "row": 0, "col": 0})
        # Pixels of the first row and column wait; those of the last ones ask for what is beyond.
        sides = range(-1, 2) if corners else (0,)
        wait = [(r, np.full(tile, c[0]), labels[:, 0]), (np.full(tile, r[0]), c, labels[0])]
        ask = [(r + d, np.full(tile, c[-1] + 1), labels[:, -1]) for d in sides] + [(np.full(tile, r[-1] + 1), c + d, labels[-1]) for d in sides]
        for role, lines in (("wait", wait), ("ask", ask)):
            y, x, k = (np.concatenate(v) for v in zip(*lines, strict=True))
            y, x, k = y[k > 0], x[k > 0], k[k > 0]
            if len(k):
                yield pd.DataFrame({**at, "role": role, "local": k, "id": ids[k - 1], "n": 0, "edge": False, "meets": 0, "near": 0, "row": y, "col": x})

    found = stored(_mapped(tiles.select(*AT, *EXTENT, *{mask, *beside}), run, _PARTS))
    sides = [found.where(F.col("role") == role).select(*KEY, "row", "col", F.col("id").alias(name)) for role, name in (("wait", "a"), ("ask", "b"))]
    tied = roots(sides[0].hint("merge").join(sides[1], [*KEY, "row", "col"]).select(*KEY, "a", "b"), KEY)
    parts = found.where("role = 'part'").hint("merge").join(tied.withColumnRenamed("node", "id"), [*KEY, "id"], "left").withColumn("root", F.coalesce("root", "id"))
    whole = parts.groupBy(*KEY, "root").agg(F.sum("n").alias("n"), F.bool_or("edge").alias("edge"), F.sum("meets").alias("meets"), F.sum("near").alias("near"))
    return parts.select(*AT, "local", "root"), whole


def _picked(tiles: DataFrame, mask: str, parts: DataFrame, kept: DataFrame, tile: int, dry: bool = False) -> DataFrame:
    """Tiles whose mask is its ``kept`` components (KEY, root) alone, or with them added if they are ``dry`` ones."""
    chosen = parts.hint("merge").join(kept.select(*KEY, "root"), [*KEY, "root"]).groupBy(*AT).agg(F.collect_list("local").alias("_locals"))

    def run(t) -> Iterator[pd.DataFrame]:
        m = mask_of(getattr(t, mask), (tile, tile))
        take = np.zeros((tile, tile), bool)
        if t.wanted is not None:
            labels, n = _labels(t, mask, dry, False, tile)
            keep = np.zeros(n + 1, bool)
            keep[np.asarray(t.wanted, dtype=np.int64)] = True
            take = keep[labels]
        yield (t.scene_id, t.kernel, t.ti, t.tj, bits(m | take if dry else take))

    new = _mapped(tiles.hint("merge").join(chosen, AT, "left").select(*AT, *EXTENT, mask, F.col("_locals").alias("wanted")), run, f"{_AT}, {mask} binary")
    return stored(tiles.drop(mask).hint("merge").join(new, AT))


def without_specks(tiles: DataFrame, mask: str, least: int = raster.SPECK, tile: int = TILE) -> DataFrame:
    """Components of fewer pixels removed, however many tiles they cross."""
    parts, whole = components(tiles, mask, tile=tile)
    return _picked(tiles, mask, parts, whole.where(F.col("n") >= least), tile)


def filled(tiles: DataFrame, mask: str, tile: int = TILE) -> DataFrame:
    """Background that the scene's edge does not reach filled."""
    parts, whole = components(tiles, mask, dry=True, tile=tile)
    return _picked(tiles, mask, parts, whole.where("not edge"), tile, dry=True)


def both(tiles: DataFrame, mask: str, other: str) -> DataFrame:
    """Tiles with the mask limited to another."""

    def run(t) -> Iterator[pd.DataFrame]:
        a, b = (np.frombuffer(getattr(t, m), np.uint8) for m in (mask, other))
        yield (t.scene_id, t.kernel, t.ti, t.tj, (a & b).tobytes())

    return stored(tiles.drop(mask).hint("merge").join(_mapped(tiles.select(*AT, mask, other), run, f"{_AT}, {mask} binary"), AT))


def _anchored(tiles: DataFrame, tile: int) -> tuple[DataFrame, DataFrame]:
    """Tiles whose mask keeps what meets the footprint or is large and near it, and the figures of each KEY's mask."""
    parts, whole = components(tiles, "mask", tile=tile)
    free = tiles.select(*KEY, "expected_given").distinct()
    kept = stored(whole.hint("merge").join(free, KEY).where((~F.col("expected_given")) | (F.col("meets") > 0) | ((F.col("near") > 0) & (F.col("n") >= raster.EXPANSION))))
    figures = kept.groupBy(*KEY).agg(F.sum("n").alias("pixels"), F.count("*").alias("components"), F.max("n").alias("largest_pixels"), F.sum("meets").alias("overlap_pixels"))
    figures = free.hint("merge").join(figures, KEY, "left").fillna(0, ["pixels", "components", "largest_pixels", "overlap_pixels"])
    broken = F.when(F.col("pixels") > 0, 1 - F.col("largest_pixels") / F.col("pixels")).otherwise(1.0)
    return _picked(tiles, "mask", parts, kept, tile), stored(figures.withColumn("fragmentation", broken))


def segment(pixels: DataFrame, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """The segmentation of ``raster.segment`` over tiles: (tiles with ``mask``, figures of each scene's mask).

    ``pixels``: scene_id, row, col, raw (the water rule's verdict), expected (null throughout where no footprint is
    known). Figures: pixels, components, largest_pixels, overlap_pixels, fragmentation, and the kernel of the closing that
    was taken (0: none). Scenes without a pixel have no row.
    """
    base = tiled(pixels.select("scene_id", "row", "col", F.col("raw").alias("mask"), F.col("expected").cast("boolean").alias("expected")), ["mask", "expected"], tile)
    some = base.where("expected_given")
    base = buffered(some, "expected", "context", raster.CONTEXT_PIXELS, tile).unionByName(base.where("not expected_given").withColumn("context", F.lit(b"\xff" * (-(-tile * tile // 8)))))
    base = without_specks(both(base, "mask", "context"), "mask", tile=tile)
    base = filled(closed(base, "mask", "mask", 3, tile), "mask", tile)
    base, figures = _anchored(base, tile)
    open_ = figures.where(F.col("expected_given") & (F.col("pixels") > raster.REFINE_OVER) & (F.col("fragmentation") > raster.FRAGMENTED))
    tried = base.hint("merge").join(open_.select("scene_id"), "scene_id", "left_semi").withColumn("kernel", F.explode(F.array(*map(F.lit, raster.KERNELS))))
    tried = filled(closed(stored(tried), "mask", "mask", max(raster.KERNELS), tile), "mask", tile)
    tried, options = _anchored(both(tried, "mask", "context"), tile)
    old = open_.select("scene_id", F.col("pixels").alias("_pixels"), F.col("fragmentation").alias("_broken"))
    inside = 100.0 * F.col("overlap_pixels") / F.greatest("pixels", F.lit(1))
    fits: Column = (F.col("pixels") > F.col("_pixels")) & (inside >= raster.INSIDE_LEAST) & (F.col("pixels") <= raster.GROWTH_MOST * F.col("_pixels")) & (F.col("fragmentation") < F.col("_broken") - raster.GAIN)
    best = options.hint("merge").join(old, "scene_id").where(fits).groupBy("scene_id").agg(F.min(F.struct("fragmentation", "pixels", "kernel"))["kernel"].alias("_best"))

    def chosen(df: DataFrame) -> DataFrame:
        return df.hint("merge").join(best, "scene_id", "left").where(F.col("kernel") == F.coalesce("_best", F.lit(0))).drop("_best")

    return stored(chosen(base.unionByName(tried))), stored(chosen(figures.unionByName(options)).drop("expected_given"))


def pixels_of(tiles: DataFrame, mask: str, tile: int = TILE) -> DataFrame:
    """(scene_id, row, col) of the pixels of a mask."""

    def run(t) -> Iterator[pd.DataFrame]:
        r, c = np.nonzero(mask_of(getattr(t, mask), (tile, tile)))
        yield pd.DataFrame({"scene_id": t.scene_id, "row": r + t.ti * tile, "col": c + t.tj * tile})

    return _mapped(tiles.select("scene_id", "ti", "tj", mask), run, "scene_id long, row int, col int")


def _numbers(tiles: DataFrame, whole: DataFrame) -> DataFrame:
    """(scene_id, root, component): components numbered in the order of their first pixels.

    A component's number is its place in its row of pixels after the components that begin in rows before.
    """
    wide = tiles.select("scene_id", (F.col("c1") - F.col("c0") + 1).alias("wide")).distinct()
    begun = stored(whole.hint("merge").join(wide, "scene_id").select("scene_id", "root", F.expr("root div wide").alias("line")))
    lines = begun.groupBy("scene_id", "line").agg(F.count("*").alias("n"))
    before = lines.select("scene_id", "line", (F.sum("n").over(Window.partitionBy("scene_id").orderBy("line")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("scene_id", "line").orderBy("root"))
    return begun.withColumn("place", place).hint("merge").join(before, ["scene_id", "line"]).select("scene_id", "root", (F.col("before") + F.col("place")).alias("component"))


def with_components(pixels: DataFrame, mask: str = "water", corners: bool = False, tile: int = TILE) -> DataFrame:
    """(scene_id, row, col, component): as ``raster.with_components``, numbers in the order of first pixels, over tiles."""
    tiles = tiled(pixels.select("scene_id", "row", "col", F.col(mask).alias("mask")), ["mask"], tile)
    parts, whole = components(tiles, "mask", corners=corners, tile=tile)
    known = parts.hint("merge").join(_numbers(tiles, whole), ["scene_id", "root"]).groupBy(*AT).agg(F.map_from_entries(F.collect_list(F.struct("local", "component"))).alias("numbers"))
    known = known.select(*AT, F.transform(F.array_sort(F.map_keys("numbers")), lambda k: F.element_at("numbers", k)).alias("numbers"))

    def run(t) -> Iterator[pd.DataFrame]:
        labels, _ = _labels(t, "mask", False, corners, tile)
        r, c = np.nonzero(labels)
        yield pd.DataFrame({"scene_id": t.scene_id, "row": r + t.ti * tile, "col": c + t.tj * tile, "component": np.asarray(t.numbers, dtype=np.int64)[labels[r, c] - 1]})

    return _mapped(tiles.hint("merge").join(known, AT).select(*AT, *EXTENT, "mask", "numbers"), run, "scene_id long, row int, col int, component long")


# Headings along a pixel's sides with the pixel on the right, as (row, column): top, right, bottom, left. What is left of
# a heading is the heading before it.
_HEADINGS = np.array([(0, 1), (1, 0), (0, -1), (-1, 0)])
_CHAIN = f"{_AT}, local int, id long, next long, twice long, xs array<int>, ys array<int>"


def _chains(t, tile: int) -> Iterator[tuple]:
    """The walks along the sides of a tile's pixels, each until it leaves the tile or closes.

    A walk has the id of its first side and that of the side after its last, its turns as corners (xs, ys), and twice the
    area that it bounds, which adds up over the walks of a ring. It follows ``raster.outline``: left where the pixel
    ahead on the left is in the mask, else on where the one ahead is, else around its own pixel.
    """
    m = _met(t, 1, tile)
    own = m[1:-1, 1:-1]
    sides = np.stack([own & ~m[1 + r : 1 + r + tile, 1 + c : 1 + c + tile] for r, c in np.roll(_HEADINGS, 1, axis=0)])
    side, r, c = np.nonzero(sides)
    if not len(side):
        return
    number = np.full(sides.shape, -1)
    number[sides] = np.arange(len(side))
    ahead = np.stack([r, c], axis=1) + _HEADINGS[side]
    beside = ahead + _HEADINGS[side - 1]
    left, on = (m[at[:, 0] + 1, at[:, 1] + 1] for at in (beside, ahead))
    to = np.where(left[:, None], beside, np.where(on[:, None], ahead, np.stack([r, c], axis=1)))
    turned = np.where(left, side - 1, np.where(on, side, side + 1)) % 4
    here = ((to >= 0) & (to < tile)).all(axis=1)
    follows = np.full(len(side), -1)
    follows[here] = number[turned[here], to[here, 0], to[here, 1]]

    row, col = np.int64(t.ti) * tile, np.int64(t.tj) * tile
    wide = t.c1 - t.c0 + 1
    place = lambda y, x, s: ((y + row - t.r0) * wide + (x + col - t.c0)) * 4 + s
    ids, nexts = place(r, c, side), place(to[:, 0], to[:, 1], turned)
    x0, y0 = c + col + np.isin(side, (1, 2)), r + row + np.isin(side, (2, 3))
    x1, y1 = x0 + _HEADINGS[side, 1], y0 + _HEADINGS[side, 0]
    twice, bends = x0 * y1 - x1 * y0, side != turned
    labels, _ = raster.label(own, True)

    led = np.zeros(len(side), bool)
    led[follows[here]] = True
    step, done = follows.tolist(), [False] * len(side)
    for first in [*np.flatnonzero(~led).tolist(), *np.flatnonzero(led).tolist()]:
        walk, k = [], first
        while k >= 0 and not done[k]:
            done[k] = True
            walk.append(k)
            k = step[k]
        if walk:
            w = np.array(walk)
            at = w[bends[w]]
            yield (t.scene_id, t.kernel, t.ti, t.tj, int(labels[r[first], c[first]]), int(ids[first]), int(nexts[w[-1]]), int(twice[w].sum()), x1[at], y1[at])


def outlines(pixels: DataFrame, mask: str = "water", tile: int = TILE) -> DataFrame:
    """(scene_id, component, hole, pixels, ring): the rings of ``raster.outline`` around each component, over tiles.

    Pixels that touch at a corner are in one component; its number is that of ``with_components``. A component has one
    outer ring; its holes are its other ones, so rings are nested by it. ``pixels`` is the extent of the ring itself. A ring
    is an array of corners (x to the right, y down, the pixel (row, col) having x from col to col + 1), from the smallest
    and back to it. Walks are made in tiles, joined where they cross a border and put in order by doubling; a ring is a
    row, and nothing else is held whole. A scene without such pixels has no row; for odd pixels see ``tiled``.
    """
    tiles = tiled(pixels.select("scene_id", "row", "col", F.col(mask).alias("mask")), ["mask"], tile)
    parts, whole = components(tiles, "mask", corners=True, tile=tile)
    chains = stored(_mapped(_margins(tiles, "mask", 1, tile), lambda t: _chains(t, tile), _CHAIN))
    open_ = chains.where("id != next").select(*KEY, "id", "next")
    rings = roots(open_.select(*KEY, F.col("id").alias("a"), F.col("next").alias("b")), KEY).select(*KEY, F.col("node").alias("id"), F.col("root").alias("ring"))
    # How many walks of the ring begin with this one, up to the ring's first walk.
    order = open_.hint("merge").join(rings, [*KEY, "id"]).select(*KEY, "id", "ring", F.when(F.col("next") != F.col("ring"), F.col("next")).alias("to"), F.lit(1).alias("more"))
    order = stored(order)
    while not order.where("to is not null").isEmpty():
        then = order.select(*KEY, F.col("id").alias("to"), F.col("to").alias("_to"), F.col("more").alias("_more"))
        order = stored(order.hint("merge").join(then, [*KEY, "to"], "left").select(*KEY, "id", "ring", F.col("_to").alias("to"), (F.col("more") + F.coalesce("_more", F.lit(0))).alias("more")))
    placed = chains.hint("merge").join(order.select(*KEY, "id", "ring", "more"), [*KEY, "id"], "left").hint("merge").join(parts, [*AT, "local"])
    walks = F.array_sort(F.collect_list(F.struct((-F.coalesce("more", F.lit(0))).alias("place"), "xs", "ys")))
    each = placed.groupBy("scene_id", F.coalesce("ring", "id").alias("ring")).agg(F.min("root").alias("root"), F.sum("twice").alias("twice"), walks.alias("walks"))
    flat = [F.flatten(F.col("walks")[k]) for k in ("xs", "ys")]
    each = each.select("scene_id", "root", "twice", F.zip_with(*flat, lambda x, y: F.struct(x.alias("x"), y.alias("y"))).alias("points"))
    first = F.array_min("points")
    at = F.array_position("points", first).cast("int")
    ring = F.concat(F.slice("points", at, F.size("points")), F.slice("points", F.lit(1), at - 1), F.array(first))
    numbered = each.hint("merge").join(_numbers(tiles, whole), ["scene_id", "root"])
    return numbered.select("scene_id", "component", (F.col("twice") < 0).alias("hole"), F.abs(F.expr("twice div 2")).alias("pixels"), ring.alias("ring"))


def boundaries(pixels: DataFrame, left: float, top: float, size: float, zone: int, south: bool = False, mask: str = "water", tile: int = TILE) -> DataFrame:
    """(scene_id, component, m2, rings): the polygons of ``raster.boundaries`` over tiles, a row each, without slivers.

    ``rings`` are in degrees, the outer first, then the holes, larger ones first. Components share no side, so a scene's
    polygons together are their union. A component's area, ``m2``, is that of its pixels. A scene without polygons has no row.
    """
    rings = outlines(pixels, mask, tile).select("scene_id", "component", F.struct((-F.col("pixels")).alias("pixels"), (-F.size("ring")).alias("corners"), "ring", "hole").alias("r"))
    inner = F.when(F.col("r.hole"), F.col("r.pixels")).otherwise(-F.col("r.pixels"))
    whole = rings.groupBy("scene_id", "component").agg((F.sum(inner) * size * size).alias("m2"), F.array_sort(F.collect_list("r")).alias("all"))
    on_earth = F.transform("all", lambda r: F.transform(r["ring"], lambda p: raster.degrees(left + p["x"] * size, top - p["y"] * size, zone, south)))
    return whole.where(F.col("m2") > raster.SLIVER_M2).select("scene_id", "component", "m2", on_earth.alias("rings"))
