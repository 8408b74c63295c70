"""Readers, writers and incremental histories."""

import json
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lakestat.operators import baseline
from lakestat.sources import readers
from lakestat.streaming import history

SQUARE = [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0], [0.0, 0.0]]


def test_geojson_zip(spark, tmp_path):
    small = [[[x / 2, y / 2] for x, y in SQUARE]]
    features = [{"type": "Feature", "properties": {"name": "P"}, "geometry": {"type": "Polygon", "coordinates": [SQUARE]}}, {"type": "Feature", "properties": {"name": "M"}, "geometry": {"type": "MultiPolygon", "coordinates": [small, [SQUARE]]}}, {"type": "Feature", "properties": {}, "geometry": None}]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("readme.txt", "no")
        z.writestr("x/b.geojson", json.dumps({"type": "FeatureCollection", "features": features}))
    got = {r.properties["name"]: r for r in readers.geojson(spark, str(tmp_path / "a.zip")).collect()}
    assert [list(p) for p in got["P"].ring] == SQUARE and [list(p) for p in got["M"].ring] == SQUARE and len(got) == 2


def test_elements_and_failover(spark, tmp_path):
    doc = {"elements": [{"id": 5, "type": "way", "tags": {"name": "A"}, "geometry": [{"lon": x, "lat": y} for x, y in SQUARE]}, {"id": 6, "type": "relation", "members": [{"type": "way", "role": "outer", "geometry": []}]}]}
    (tmp_path / "e.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "none.json").write_text('{"elements": []}')
    read = lambda n: lambda: readers.elements(spark, str(tmp_path / n))
    got = readers.first_usable(read("missing.json"), read("none.json"), read("e.json")).collect()
    assert [(r.element_id, r.tags) for r in got] == [(5, {"name": "A"}), (6, {})]
    with pytest.raises(ValueError):
        readers.first_usable(read("none.json"))


def test_scene_items(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"id": "S2A_1", "bbox": [1, 2, 3, 4], "properties": {"datetime": "2024-05-18T05:26:49Z", "eo:cloud_cover": 1.5, "s2:processing_baseline": "05.10"}, "assets": {"SCL": {"href": "u"}}}))
    r = readers.scene_items(spark, str(tmp_path / "s.json")).first()
    assert (r.scene_id, r.datetime, r.cloud, r.baseline, r.xmax, r.has_scl, r.assets) == ("S2A_1", datetime(2024, 5, 18, 5, 26, 49), 1.5, "05.10", 3.0, True, {"SCL": "u"})


def test_history_partitions(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.1), (2, 0.2)], "water_body_id int, x double")
    readers.write_history(df, str(tmp_path / "h"))
    readers.write_history(spark.createDataFrame([(2, 0.9)], df.schema), str(tmp_path / "h"))
    assert sorted((r.water_body_id, r.x) for r in readers.history(spark, str(tmp_path / "h")).collect()) == [(1, 0.1), (2, 0.9)]
    one = readers.history(spark, str(tmp_path / "h"), 1)
    assert one.count() == 1 and "PartitionFilters: [isnotnull(water_body_id" in one._jdf.queryExecution().toString()


def test_rasters(spark):
    p = spark.range(16).select(F.lit(1).alias("scene_id"), F.floor(F.col("id") / 4).cast("int").alias("row"), (F.col("id") % 4).cast("int").alias("col"))
    coarse = spark.createDataFrame([(1, 0, 0, 0.0), (1, 0, 1, 4.0), (1, 1, 0, 8.0), (1, 1, 1, 12.0)], "scene_id int, row int, col int, v double")
    near = {(r.row, r.col): r.v for r in readers.finer(p, coarse, "v").collect()}
    smooth = {(r.row, r.col): r.v for r in readers.finer_smooth(p, coarse, "v").collect()}
    assert near[3, 1] == 8.0 and near[1, 2] == 4.0
    assert smooth[0, 0] == 0.0 and smooth[1, 1] == pytest.approx(3.0) and smooth[3, 3] == 12.0
    assert readers.window(p, 0.0, 40.0, 10.0, (11.0, 8.0, 29.0, 100.0), 4, 4).count() == 2 * 3


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("water_body_id,observation_date,turbidity_measured\n1,2024-01-01,3.5\nbad\n")
    assert readers.ground_truth(spark, str(tmp_path)).where("turbidity_measured is not null").count() == 1


def test_incremental_history(spark, tmp_path):
    schema = "water_body_id long, observation_date timestamp, seq long, mask_quality_status string, turbidity_indicator double, chlorophyll_indicator double, algal_indicator double, water_area_km2 double, cloud_percentage double"
    row = lambda d, s, v, ok="ok": (1, datetime(2024, 1, d), s, ok, v, v, v, v, 0.0)
    batches = [[row(1, 1, 0.1), row(2, 2, 0.2), row(3, 3, 0.3), row(4, 4, 0.25)], [row(3, 5, 0.9), row(6, 6, 0.5), row(2, 7, 0.2, "degraded")]]
    for k, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = history.scored_stream(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination()
        assert q.exception() is None, k
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    got = {(r.observation_date.day, r.prior_count): r for r in out}
    assert len(out) == 7 and got[4, 3].baseline_status == "valid" and got[3, 2].anomaly_score == 0
    once = spark.createDataFrame(batches[0], schema).withColumn("observation_date", F.col("observation_date").cast("timestamp_ntz"))
    batch = {r.seq: r.anomaly_score for r in baseline.anomalies(baseline.prior_baseline(once)).collect()}
    assert got[4, 3].anomaly_score == pytest.approx(batch[4], abs=2e-4)
    assert got[6, 3].anomaly_score == pytest.approx(0.0251, abs=2e-4)  # against 0.1, 0.9 and 0.25: what was replaced counts no more
