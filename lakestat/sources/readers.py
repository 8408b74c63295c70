"""Readers for the formats that water-quality data come in, and writers for results."""

from __future__ import annotations

import io
import logging
import zipfile
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

RING = "array<struct<lon:double,lat:double>>"
FEATURES = "features array<struct<id:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder; filters and columns are pushed into the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def jdbc(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, parts: int = 64, **options: str) -> DataFrame:
    """A table of a relational database, read in ranges of its key."""
    return spark.read.jdbc(url, name, column=key, lowerBound=low, upperBound=high, numPartitions=parts, properties=options)


def first_usable(*readers: Callable[[], DataFrame]) -> DataFrame:
    """The first reader's rows that can be read and are not empty; the last failure if none is.

    Whether there are rows is asked of the first partitions only, before the rows are read for good.
    """
    failure: Exception = ValueError("no source had rows")
    for read in readers:
        try:
            df = read()
            if not df.isEmpty():
                return df
        except Exception as e:  # noqa: BLE001  a source may fail in any way
            failure = e
    raise failure


def _first_geojson(data: bytes) -> str | None:
    if not zipfile.is_zipfile(io.BytesIO(data)):
        return data.decode("utf-8")
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        name = next((n for n in sorted(z.namelist()) if n.lower().endswith((".geojson", ".json"))), None)
        return z.read(name).decode("utf-8") if name else None


def ring_of(coordinates: Column) -> Column:
    """Array of [lon, lat] arrays to an array of points."""
    return F.transform(coordinates, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))


def to_degrees(point: Column, epsg: Column) -> Column:
    """A (lon, lat) point of a reference system, given by its number, in degrees on WGS84.

    Known are 4326 (also if null), 3857, and the UTM zones 326xx and 327xx; the points of others are null.
    """
    from ..functions import geo

    x, y = point["lon"], point["lat"]
    south = epsg.between(32701, 32760)
    lon, lat = geo.from_utm(x, y, F.pmod(epsg, F.lit(100)), south)
    utm = F.struct(lon.alias("lon"), lat.alias("lat"))
    web = F.struct(F.degrees(x / geo.A).alias("lon"), F.degrees(F.atan(F.sinh(y / geo.A))).alias("lat"))
    return F.when(F.coalesce(epsg, F.lit(4326)) == 4326, point).when(epsg == 3857, web).when(epsg.between(32601, 32660) | south, utm)


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """(pos, properties, ring) of the features of GeoJSON files, zipped or not, in degrees; of multipolygons the largest part.

    A file's reference system is the number at the end of its ``crs`` name; none, or CRS84, is degrees on WGS84. A file
    is read whole by one task.
    """
    from ..functions import geo

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_first_geojson(x) for x in b.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(found, pa.string())], names=["path", "text"])

    files = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(texts, "path string, text string")
    doc = F.from_json("text", f"crs struct<properties:struct<name:string>>, {FEATURES}")
    rows = files.select("path", doc.alias("d")).select("path", F.regexp_extract(F.col("d.crs.properties.name"), r":(\d{4,5})$", 1).try_cast("int").alias("epsg"), F.posexplode("d.features").alias("pos", "f"))
    kind, shape = F.col("f")["geometry"]["type"], F.col("f")["geometry"]["coordinates"]
    degrees = lambda ring: F.transform(ring, lambda p: to_degrees(p, F.col("epsg")))
    simple = degrees(ring_of(F.from_json(shape, "array<array<array<double>>>")[0]))
    parts = F.transform(F.from_json(shape, "array<array<array<array<double>>>>"), lambda p: degrees(ring_of(p[0])))
    ring = F.when(kind == "Polygon", simple).when(kind == "MultiPolygon", geo.largest_part(parts))
    return rows.select("pos", F.col("f")["properties"].alias("properties"), ring.alias("ring")).where("ring is not null and not exists(ring, p -> p is null)")


def elements(spark: SparkSession, path: str) -> DataFrame:
    """(pos, element_id, type, tags, ring, members) of captured map-service responses."""
    schema = "elements array<struct<id:bigint,type:string,tags:map<string,string>,geometry:array<struct<lon:double,lat:double>>,members:array<struct<type:string,role:string,geometry:array<struct<lon:double,lat:double>>>>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode("elements").alias("pos", "e"))
    return rows.select("pos", F.col("e.id").alias("element_id"), F.col("e.type").alias("type"), F.coalesce("e.tags", F.from_json(F.lit("{}"), "map<string,string>")).alias("tags"), F.col("e.geometry").alias("ring"), F.col("e.members").alias("members"))


def scene_items(spark: SparkSession, path: str) -> DataFrame:
    """(scene_id, datetime, cloud, platform, baseline, bounds, assets) of catalogue items, one JSON object per line."""
    schema = "id string, bbox array<double>, properties struct<datetime:string,platform:string,`eo:cloud_cover`:double,`s2:processing_baseline`:string>, assets map<string,struct<href:string>>"
    df = spark.read.schema(schema).json(path)
    box = {n: F.get("bbox", F.lit(i)).alias(n) for i, n in enumerate(("xmin", "ymin", "xmax", "ymax"))}
    return df.select(
        F.col("id").alias("scene_id"), text.utc(F.col("properties.datetime")).alias("datetime"), F.col("properties.`eo:cloud_cover`").alias("cloud"), F.col("properties.platform").alias("platform"),
        F.col("properties.`s2:processing_baseline`").alias("baseline"), *box.values(), F.transform_values("assets", lambda _, a: a["href"]).alias("assets"), F.map_contains_key("assets", "SCL").alias("has_scl"),
    )


def ground_truth(spark: SparkSession, folder: str) -> DataFrame:
    """All CSV files of a folder, united by column name; a column that a file lacks is null there.

    Files with the same header are read together. A group of files that cannot be read is logged and left out, and
    broken lines have nulls. Without any file there are no rows and no columns.
    """
    try:
        lines = spark.read.text(f"{folder}/*.csv").select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
        headers = lines.where("trim(value) != ''").groupBy("file").agg(F.min_by("value", "at").alias("header"))
        groups = headers.groupBy("header").agg(F.array_sort(F.collect_list("file")).alias("files")).orderBy("header").collect()
    except AnalysisException:
        groups = []
    read = []
    for g in groups:
        try:
            read.append(spark.read.csv(g.files, header=True, inferSchema=True, mode="PERMISSIVE"))
        except Exception as e:  # noqa: BLE001  a file may be broken in any way
            logging.getLogger(__name__).error("left out %s: %s", g.files[0], e)
    if not read:
        return spark.createDataFrame([], "water_body_id string, observation_date string").drop("water_body_id", "observation_date")
    types: dict[str, set[str]] = {}
    for df in read:
        for name, kind in df.dtypes:
            types.setdefault(name, set()).add(kind)
    # Where files differ, numbers are doubles and all else is text.
    clash = {n: "double" if t <= {"int", "bigint", "double"} else "string" for n, t in types.items() if len(t) > 1}
    read = [df.withColumns({n: F.col(n).cast(t) for n, t in clash.items() if n in df.columns}) for df in read]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), read)


def history(spark: SparkSession, folder: str, body: int | None = None) -> DataFrame:
    """Stored histories; with a body, only its partition is read."""
    df = spark.read.parquet(folder)
    return df if body is None else df.where(F.col("water_body_id") == body)


def write_history(df: DataFrame, folder: str) -> None:
    """Histories by body; only the bodies in ``df`` are replaced."""
    df.repartition("water_body_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("water_body_id").parquet(folder)


def write_geojson(df: DataFrame, path: str) -> None:
    """Features (feature_id, ring, properties) as GeoJSON text, one feature per line."""
    points = F.transform("ring", lambda p: F.array(p["lon"], p["lat"]))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(points).alias("coordinates"))
    df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.col("feature_id").alias("id"), geometry.alias("geometry"), "properties")).alias("value")).write.mode("overwrite").text(path)


def write_collection(features: DataFrame, path: str) -> None:
    """Features (feature_id, ring, properties) as one GeoJSON FeatureCollection, a file of one line. For small results."""
    from ..operators.dashboard import feature_collections

    feature_collections(features.withColumn("_all", F.lit(1)), "_all").select("collection").coalesce(1).write.mode("overwrite").text(path)


def write_raster(pixels: DataFrame, path: str) -> None:
    """Bands by scene as Parquet: scene_id, row, col and float bands; no data is null. Only the scenes given are replaced."""
    bands = [F.col(c).cast("float").alias(c) if t == "double" else F.col(c) for c, t in pixels.dtypes]
    out = pixels.select(bands).repartition("scene_id").sortWithinPartitions("scene_id", "row", "col")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scene_id").parquet(path)


def write_mask(pixels: DataFrame, path: str, mask: str = "water") -> None:
    """A mask by scene as Parquet: scene_id, row, col and 0 or 1 as a byte."""
    write_raster(pixels.select("scene_id", "row", "col", F.coalesce(F.col(mask), F.lit(False)).cast("byte").alias(mask)), path)


def metric_bounds(box: tuple[float, float, float, float], zone: int, south: bool = False, buffer: float = 0.0) -> dict[str, Column]:
    """Bounds in a UTM zone's metres of a box in degrees (xmin, ymin, xmax, ymax), its sides followed, widened by a buffer."""
    from ..functions import geo

    xmin, ymin, xmax, ymax = box
    steps = [k / 20 for k in range(21)]
    along = [(xmin + t * (xmax - xmin), y) for t in steps for y in (ymin, ymax)] + [(x, ymin + t * (ymax - ymin)) for t in steps for x in (xmin, xmax)]
    points = [geo.to_utm(F.lit(x), F.lit(y), F.lit(zone), F.lit(south)) for x, y in along]
    xs, ys = F.array(*[p[0] for p in points]), F.array(*[p[1] for p in points])
    return {"xmin": F.array_min(xs) - buffer, "ymin": F.array_min(ys) - buffer, "xmax": F.array_max(xs) + buffer, "ymax": F.array_max(ys) + buffer}


def window_of_box(
    pixels: DataFrame, box: tuple[float, float, float, float], buffer: float, left: float, top: float, pixel: float, height: int, width: int, zone: int, south: bool = False
) -> DataFrame:
    """Pixels of a box in degrees, widened by a buffer in metres: whole pixels within the raster.

    Offset and size are rounded apart, as whole pixels of the window. The bounds are constants when the scan is planned.
    """
    b = metric_bounds(box, zone, south, buffer)
    at = {k: F.round(v).cast("long") for k, v in {"col": (b["xmin"] - left) / pixel, "row": (top - b["ymax"]) / pixel, "w": (b["xmax"] - b["xmin"]) / pixel, "h": (b["ymax"] - b["ymin"]) / pixel}.items()}
    c0, r0 = F.greatest(F.lit(0), at["col"]), F.greatest(F.lit(0), at["row"])
    c1, r1 = c0 + F.least(width - c0, at["w"]), r0 + F.least(height - r0, at["h"])
    return pixels.where((F.col("col") >= c0) & (F.col("col") < c1) & (F.col("row") >= r0) & (F.col("row") < r1))


def window(pixels: DataFrame, left: float, top: float, pixel: float, box: tuple[float, float, float, float], height: int, width: int) -> DataFrame:
    """Pixels of a metric box (xmin, ymin, xmax, ymax), whole pixels, within the raster; pushed down as ranges."""
    xmin, ymin, xmax, ymax = box
    col0, col1 = max(0, round((xmin - left) / pixel)), min(width, round((xmax - left) / pixel))
    row0, row1 = max(0, round((top - ymax) / pixel)), min(height, round((top - ymin) / pixel))
    return pixels.where(F.col("col").between(col0, col1 - 1) & F.col("row").between(row0, row1 - 1))


def finer(pixels: DataFrame, coarse: DataFrame, value: str) -> DataFrame:
    """Pixels with the nearest value of a layer of half the resolution."""
    c = coarse.select("scene_id", F.col("row").alias("_r"), F.col("col").alias("_c"), value)
    return pixels.withColumn("_r", F.floor(F.col("row") / 2).cast("int")).withColumn("_c", F.floor(F.col("col") / 2).cast("int")).join(c, ["scene_id", "_r", "_c"], "left").drop("_r", "_c")


def finer_smooth(pixels: DataFrame, coarse: DataFrame, value: str) -> DataFrame:
    """Pixels with a bilinear value of a layer of half the resolution: four neighbours, those beyond the edge left out."""
    y, x = (F.col("row") + 0.5) / 2 - 0.5, (F.col("col") + 0.5) / 2 - 0.5
    near = pixels.select("scene_id", "row", "col", F.explode(F.array(*[F.struct((F.floor(y) + i).cast("int").alias("r"), (F.floor(x) + j).cast("int").alias("c")) for i in (0, 1) for j in (0, 1)])).alias("n"), y.alias("_y"), x.alias("_x"))
    near = near.select("scene_id", "row", "col", F.col("n.r").alias("_r"), F.col("n.c").alias("_c"), ((1 - F.abs(F.col("n.r") - F.col("_y"))) * (1 - F.abs(F.col("n.c") - F.col("_x")))).alias("_w"))
    c = coarse.select("scene_id", F.col("row").alias("_r"), F.col("col").alias("_c"), F.col(value).alias("_v")).where("_v is not null")
    found = near.join(c, ["scene_id", "_r", "_c"]).groupBy("scene_id", "row", "col").agg((F.sum(F.col("_w") * F.col("_v")) / F.sum("_w")).alias(value))
    return pixels.join(found, ["scene_id", "row", "col"], "left")
