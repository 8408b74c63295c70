"""Joins of points, boxes and polygons: equi-joins on the cells of a grid, then the exact test.

A box is as coarse as its longer side: cells of its level are at least as long, so it covers at most four of them. Two
boxes meet at the coarser of their levels. So the join has two halves: left boxes on their own level against right
boxes on that level and finer, and right boxes on their own level against finer left ones. Each half puts the coarser
side into the cells of its own level only, and the finer side into those of the coarser levels that the other side
has. A pair is tested only where both boxes lie in one cell that is not much longer than one of them.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..session import stored

#: Degrees of the finest cells, and the coarsest level (cells double from level to level).
CELL, TOP = 2.0**-7, 17
#: Boxes of one side in a cell beyond which the cell is divided into parts.
DENSE = 4096
#: Tests of two boxes, and resulting pairs, that a task is to have.
TESTS, PAIRS = 1 << 26, 1 << 22
BOX = ("xmin", "ymin", "xmax", "ymax")


def _level(box: dict[str, Column]) -> Column:
    """The finest level whose cells are as long as the box."""
    side = F.greatest(box["xmax"] - box["xmin"], box["ymax"] - box["ymin"])
    return F.least(F.lit(TOP), F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(side / CELL, F.lit(1.0))) - 1e-9))).cast("int")


def _in_cells(boxes: DataFrame, level: Column) -> DataFrame:
    """A row for each cell (at, x, y) of the level that a box covers."""
    df = boxes.withColumn("at", level)
    size = F.pow(F.lit(2.0), F.col("at")) * CELL
    for c, low, high in (("x", "xmin", "xmax"), ("y", "ymin", "ymax")):
        df = df.withColumn(c, F.explode(F.sequence(F.floor(F.col(low) / size), F.floor(F.col(high) / size))))
    return df


def _levels(boxes: DataFrame) -> list[int]:
    return sorted(r.level for r in boxes.select("level").distinct().collect())  # TOP + 1 at most


def _half(coarse: DataFrame, fine: DataFrame, levels: list[int], same: bool) -> DataFrame:
    """(coarse, fine) keys of boxes that meet where ``coarse`` is the coarser, or as coarse if ``same`` allows it.

    ``levels``: those of the coarse side. In a dense cell both sides are dealt to parts, and each part of one meets each
    of the other, so a group tests DENSE by DENSE boxes or about as many; groups are dealt to as many tasks as their
    tests need.
    """
    above = F.filter(F.array(*map(F.lit, levels)), lambda n: n >= F.col("level") if same else n > F.col("level"))
    sides = {"a": _in_cells(coarse, F.col("level")), "b": _in_cells(fine.withColumn("up", F.explode(above)), F.col("up")).drop("up")}
    cell = ["at", "x", "y"]
    a, b = (df.groupBy(*cell).agg(F.count("*").alias(f"n_{p}")) for p, df in sides.items())
    cells = stored(a.join(b, cell))
    tests = cells.agg(F.sum(F.col("n_a").cast("double") * F.col("n_b"))).first()[0] or 0.0
    # Few by their bound: each stands for DENSE rows. Not broadcast by force, for the rows may be very many.
    dense = cells.select(*cell, *[F.ceil(F.col(f"n_{p}") / DENSE).cast("int").alias(f"of_{p}") for p in "ab"]).where("of_a > 1 or of_b > 1")
    for p, q in ("ab", "ba"):
        df = sides[p].join(dense, cell, "left").withColumn(f"p_{p}", F.pmod(F.xxhash64("key", *BOX), F.coalesce(f"of_{p}", F.lit(1))).cast("int"))
        df = df.withColumn(f"p_{q}", F.explode(F.sequence(F.lit(0), F.coalesce(f"of_{q}", F.lit(1)) - 1))).drop("of_a", "of_b", "level")
        sides[p] = df.repartition(_tasks(df.sparkSession, tests, TESTS), *cell, "p_a", "p_b").alias(p)
    pairs = sides["a"].join(sides["b"].hint("merge"), [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*cell, "p_a", "p_b")])
    meet = [F.col(f"{p}.{c}min") <= F.col(f"{q}.{c}max") for c in "xy" for p, q in ("ab", "ba")]
    size = F.pow(F.lit(2.0), F.col("a.at")) * CELL
    # Each pair once: in the cell where the boxes' common part begins.
    begins = [F.floor(F.greatest(f"a.{c}min", f"b.{c}min") / size) == F.col(f"a.{c}") for c in "xy"]
    for test in (*meet, *begins):
        pairs = pairs.where(test)
    return pairs.select(F.col("a.key").alias("coarse"), F.col("b.key").alias("fine"))


def _tasks(spark: SparkSession, work: float, most: int) -> int:
    """Tasks for so much work, ``most`` to each; one for each core at the least."""
    return max(spark.sparkContext.defaultParallelism, min(50_000, ceil(work / most)))


def _numbered(df: DataFrame, columns: list[str], number: str) -> DataFrame:
    """The distinct values of these columns with a number each, kept so that the numbers stay."""
    return stored(df.select(*columns).distinct().withColumn(number, F.monotonically_increasing_id()))


def _meeting(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b) keys of boxes (key, xmin, ymin, xmax, ymax) that share a point, each pair once."""
    a, b = (df.withColumn("level", _level({c: F.col(c) for c in BOX})) for df in (a, b))
    a_coarser = _half(a, b, _levels(a), True).select(F.col("coarse").alias("a"), F.col("fine").alias("b"))
    return a_coarser.union(_half(b, a, _levels(b), False).select(F.col("fine").alias("a"), F.col("coarse").alias("b")))


def _expanded(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """``pairs`` (a, b, ...) of different boxes or places as pairs of the rows of ``left`` (a, ...) and ``right`` (b, ...).

    All results with one ``a`` are divided into parts of a quarter of PAIRS: the side with more rows is dealt to them, the
    other goes to each. Tasks have PAIRS on average.
    """
    pairs = stored(pairs)
    n, m = left.groupBy("a").agg(F.count("*").alias("n")), right.groupBy("b").agg(F.count("*").alias("m"))
    sizes = stored(pairs.select("a", "b").join(m, "b").groupBy("a").agg(F.sum("m").cast("double").alias("m")).join(n, "a"))
    total = sizes.agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0.0
    many = F.least(F.greatest("n", "m"), F.ceil(4 * F.col("n") * F.col("m") / PAIRS)).cast("int")
    parts = sizes.select("a", many.alias("of"), (F.col("n") >= F.col("m")).alias("left_dealt"))

    def dealt(df: DataFrame, here: Column) -> DataFrame:
        own = F.pmod(F.xxhash64(*[c for c in df.columns if c != "a"]), F.col("of")).cast("int")
        part = F.when(here, F.array(own)).otherwise(F.sequence(F.lit(0), F.col("of") - 1))
        return df.join(parts, "a").withColumn("part", F.explode(part)).drop("of", "left_dealt")

    left, right = dealt(left, F.col("left_dealt")), dealt(pairs.join(right, "b").drop("b"), ~F.col("left_dealt"))
    tasks = _tasks(left.sparkSession, total, PAIRS)
    left, right = (df.repartition(tasks, "a", "part") for df in (left, right))
    return left.join(right.hint("merge"), ["a", "part"]).drop("a", "part")


def boxes_meeting(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """(left_key, right_key) of every two rows whose boxes (xmin, ymin, xmax, ymax) share a point, each pair once.

    Boxes with a null or not finite bound, or with ends the wrong way round, meet nothing. Rows that repeat a key are
    boxes of their own. Different boxes meet first, then the rows that have them.
    """
    def boxed(df: DataFrame, key: str, number: str) -> tuple[DataFrame, DataFrame]:
        sound = (F.col("xmin") <= F.col("xmax")) & (F.col("ymin") <= F.col("ymax")) & (F.abs("xmin") < 1e9) & (F.abs("ymin") < 1e9) & (F.abs("xmax") < 1e9) & (F.abs("ymax") < 1e9)
        rows = df.select(F.col(key).alias(f"key_{number}"), *[F.col(c).cast("double").alias(c) for c in BOX]).where(sound)
        boxes = _numbered(rows, list(BOX), number)
        return rows.join(boxes, list(BOX)).drop(*BOX), boxes.withColumnRenamed(number, "key")

    (a, a_boxes), (b, b_boxes) = boxed(left, left_key, "a"), boxed(right, right_key, "b")
    return _expanded(_meeting(a_boxes, b_boxes), a, b).select(F.col("key_a").alias(left_key), F.col("key_b").alias(right_key))


def scenes_of_bodies(items: DataFrame, bodies: DataFrame) -> DataFrame:
    """(scene_id, body) of every item (scene_id, xmin, ymin, xmax, ymax) and body (id, ring) whose boxes meet."""
    b = bodies.select(F.col("id").alias("body"), *[c.alias(k) for k, c in geo.bounds(F.col("ring")).items()])
    return boxes_meeting(items, b, "scene_id", "body")


def reach(lat: Column, km: float) -> tuple[Column, Column]:
    """Degrees of longitude and latitude that hold every point within so many kilometres."""
    up = km / 110.0
    return F.least(F.lit(180.0), F.lit(up) / F.greatest(F.lit(0.01), F.cos(F.radians(F.least(F.lit(89.0), F.abs(lat) + up))))), F.lit(up)


def turned(lon: Column, ring: Column) -> Column:
    """The longitude, by whole turns, that lies nearest to the middle of a polygon's box: -179.9 is 180.1 beside 179.8."""
    box = geo.bounds(ring)
    return lon + 360 * F.round(((box["xmin"] + box["xmax"]) / 2 - lon) / 360)


def measured(df: DataFrame, lon: Column, lat: Column, km: float) -> DataFrame:
    """Rows (with a ``ring``) within so many kilometres of a point, with ``distance_km``.

    Through inline, the longitude and the distance are worked out once: as plain columns their whole expressions
    would be repeated wherever they are used, within the loop over edges too.
    """
    for name, value in (("_lon", turned(lon, F.col("ring"))), ("_m", geo.distance_m(F.col("ring"), F.col("_lon"), lat))):
        df = df.select("*", F.inline(F.array(F.struct(value.alias(name)))))
    return df.where(F.col("_m") <= km * 1000).withColumn("distance_km", F.round(F.col("_m") / 1000, 3)).drop("_lon", "_m")


def near(bodies: DataFrame, lon: float, lat: float, km: float) -> DataFrame:
    """Bodies within so many kilometres of one point, with ``distance_km``: boxes first, then distances on the spheroid."""
    across, up = reach(F.lit(lat), km)
    box, at = geo.bounds(F.col("ring")), turned(F.lit(lon), F.col("ring"))
    close = (box["xmin"] <= at + across) & (box["xmax"] >= at - across) & (box["ymin"] <= lat + up) & (box["ymax"] >= lat - up)
    return measured(bodies.where(close), F.lit(lon), F.lit(lat), km)


def bodies_near(points: DataFrame, bodies: DataFrame, km: float) -> DataFrame:
    """(point_id, body, distance_km) of every point (point_id, lon, lat) and body within so many kilometres.

    Points' boxes of that reach meet the bodies' boxes on grid cells; what remains is measured on the spheroid. A box
    that passes 180 degrees is looked up a whole turn further as well, and a pair counts on the turn where the two
    are nearest. Different places and rings are measured once, however many points and bodies have them.
    """
    places = _numbered(points.where("lon is not null and lat is not null"), ["lon", "lat"], "a")
    shapes = _numbered(bodies.where("ring is not null"), ["ring"], "b")
    across, up = reach(F.col("lat"), km)
    turns = F.array_compact(F.array(F.lit(0.0), F.when(F.col("lon") - across < -180, 360.0), F.when(F.col("lon") + across > 180, -360.0)))
    p = places.select("a", "lon", "lat", F.explode(turns).alias("turn"), across.alias("across"))
    at = F.col("lon") + F.col("turn")
    p = p.select(F.struct("a", "lon", "lat", "turn").alias("point"), (at - F.col("across")).alias("xmin"), (F.col("lat") - up).alias("ymin"), (at + F.col("across")).alias("xmax"), (F.col("lat") + up).alias("ymax"))
    b = shapes.select("b", *[c.alias(k) for k, c in geo.bounds(F.col("ring")).items()])
    pairs = boxes_meeting(p, b, "point", "b").join(shapes, "b")
    lon = F.col("point.lon")
    here = pairs.where(F.abs(turned(lon, F.col("ring")) - lon - F.col("point.turn")) < 1)
    found = measured(here, lon, F.col("point.lat"), km).select("point.a", "b", "distance_km")
    left, right = points.join(places, ["lon", "lat"]).select("a", "point_id"), bodies.join(shapes, "ring").select("b", F.col("id").alias("body"))
    return _expanded(found, left, right).select("point_id", "body", "distance_km")
