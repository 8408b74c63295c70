"""Inserts, partial updates, soft deletes and keyed upserts as joins; tables are written anew, never in place."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, scalar
from ..session import settled
from .baseline import INDICATORS, dominant
from .relational import last_per_key


def numbered(rows: DataFrame, start: int, order: list[str]) -> DataFrame:
    """``rows`` with ids start + 1, start + 2, ... in the given order, ties by a hash of all columns.

    Rows are dealt to ranges of the order and sorted there, and what came out is kept (see ``settled``): which row lies
    where is decided once, however often the result is computed. A row's id is its place in its range after the rows
    of the ranges before it, of which one count each is collected.
    """
    hashed = [f.name for f in rows.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    keys = [*order, F.xxhash64(*hashed)]
    fixed = settled(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33).cast("int"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r.part: r.n for r in fixed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    before = list(accumulate([start, *(sizes.get(k, 0) for k in range(max(sizes, default=0) + 1))]))
    return fixed.withColumn("id", F.get(F.lit(before), part) + place + 1).drop("_at")


def insert(table: DataFrame, rows: DataFrame, order: list[str]) -> DataFrame:
    """The table with new rows, whose ids follow the largest."""
    return table.unionByName(numbered(rows, _top(table), order), allowMissingColumns=True)


def patch_errors(changes: DataFrame) -> DataFrame:
    """(id, error) of changes that can't be made: none given, or a ring given as null.

    ``changes`` may have ``given``, the names of the fields that were supplied, to tell null from absent.
    """
    given = F.col("given") if "given" in changes.columns else F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in changes.columns if c != "id"]))
    null_ring = F.array_contains(given, "ring") & F.col("ring").isNull() if "ring" in changes.columns else F.lit(False)
    error = F.when(F.coalesce(F.size(given), F.lit(0)) <= 0, "nothing_to_change").when(null_ring, "ring_is_null")
    return changes.select("id", error.alias("error")).where("error is not null")


def patch(table: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows with the changes' values where these are given (not null). A new ring gives a new area, its own.

    Changes with an error (see ``patch_errors``) change nothing.
    """
    cols = [c for c in changes.columns if c not in ("id", "given")]
    if not cols:
        raise ValueError("nothing to change")
    sound = changes.join(patch_errors(changes).select("id"), "id", "left_anti")
    new = sound.select("id", *[F.col(c).alias(f"_{c}") for c in cols])
    df = table.join(new, "id", "left")
    for c in cols:
        df = df.withColumn(c, F.coalesce(F.col(f"_{c}"), F.col(c)))
    if "ring" in cols:
        df = df.withColumn("area_sq_km", F.when(F.col("_ring").isNotNull(), geo.area_km2(F.col("ring"))).otherwise(F.col("area_sq_km")))
    return df.select(table.columns)


def soft_delete(table: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of these ids made inactive."""
    gone = ids.select("id").distinct().withColumn("_gone", F.lit(True))
    return table.join(gone, "id", "left").withColumn("active", F.col("active") & F.col("_gone").isNull()).select(table.columns)


def not_deletable(table: DataFrame, ids: DataFrame) -> DataFrame:
    """Ids that are unknown or inactive already."""
    return ids.select("id").distinct().join(table.where("active").select("id"), "id", "left_anti")


def upsert_bodies(table: DataFrame, candidates: DataFrame, source: str, state: str) -> DataFrame:
    """The table with candidates merged in by (name, type, source), and what happened to each row in ``change``.

    A match gets the candidate's ring and area, becomes active, and keeps its district where the candidate has none.
    New rows get ids after the largest, by name and type. Candidates are distinct by (name, type).
    """
    keys = ["name", "type", "source"]
    c = candidates.select("name", "type", F.lit(source).alias("source"), "district", "ring", geo.area_km2(F.col("ring")).alias("area_sq_km"), F.lit(state).alias("state"), F.lit(True).alias("active"))
    given = c.select(*keys, *[F.col(x).alias(f"_{x}") for x in ("district", "ring", "area_sq_km", "state", "active")])
    hit = F.col("_active").isNotNull()
    old = table.join(given, keys, "left").withColumns(
        {
            "change": F.when(hit, "updated").otherwise("kept"),
            "district": F.coalesce("_district", "district"),
            "ring": F.coalesce("_ring", "ring"),
            **{x: F.when(hit, F.col(f"_{x}")).otherwise(F.col(x)) for x in ("area_sq_km", "state", "active")},
        }
    )
    new = numbered(c.join(table.select(*keys), keys, "left_anti").withColumn("change", F.lit("imported")), _top(table), ["name", "type"])
    return old.unionByName(new, allowMissingColumns=True).select(*table.columns, "change")


def change_counts(upserted: DataFrame) -> DataFrame:
    """How many rows were discovered, imported and updated."""
    n = {k: F.count_if(F.col("change") == k) for k in ("imported", "updated")}
    return upserted.agg((n["imported"] + n["updated"]).alias("discovered"), *[v.alias(k) for k, v in n.items()])


def upsert_history(history: DataFrame, new: DataFrame) -> DataFrame:
    """Records with those of the same body and date replaced by the last given one."""
    both = history.withColumn("_seq", F.lit(0)).unionByName(new.withColumn("_seq", F.col("seq") + 1).drop("seq"), allowMissingColumns=True)
    return last_per_key(both, ["water_body_id", "observation_date"], "_seq").drop("_seq")


def _top(table: DataFrame) -> int:
    return table.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first()["top"]


def upsert_observations(table: DataFrame, results: DataFrame) -> DataFrame:
    """The table with results' observations merged in by (water_body_id, scene_id); a match keeps its id.

    ``results``: water_body_id, scene_id, satellite, observation_date, cloud_percentage, source_url. Of results for the
    same scene and body the last date counts. The quality of a scene is what its clouds leave.
    """
    keys = ["water_body_id", "scene_id"]
    new = last_per_key(results.select(*keys, "satellite", "observation_date", "cloud_percentage", "source_url"), keys, "observation_date")
    new = new.withColumn("quality_score", scalar.scene_quality(F.col("cloud_percentage")))
    values = [c for c in new.columns if c not in keys]
    df = table.join(new.select(*keys, *[F.col(c).alias(f"_{c}") for c in values], F.lit(True).alias("_hit")), keys, "left")
    df = df.select("id", *keys, *[F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in values])
    return df.unionByName(numbered(new.join(table.select(*keys), keys, "left_anti"), _top(table), keys))


# Names in the stored documents, and a note that goes with every alert.
MODEL, PROTOTYPE = "sentinel-2-spectral-monitoring", "prototype-indicator-only"
DOCUMENT = {
    "turbidity": "turbidity_indicator", "chlorophyll": "chlorophyll_indicator", "algal": "algal_indicator", "water_area_km2": "water_area_km2",
    "anomaly_score": "anomaly_score", "anomaly_detected": "anomaly_detected", "anomaly_level": "anomaly_level", "confidence": None, "affected_area_km2": "affected_area_km2",
    "baseline_status": "baseline_status", "baseline_observation_count": "baseline_observation_count", "mode": "mode", "processing_version": "processing_version",
    "calibration_status": "calibration_status", "observation_quality": "observation_quality", "individual_scores": "individual_scores", "evidence": "explanation", "geojson": "geojson", "spatial_anomaly": "spatial_anomaly",
}
NOTE = "Spatial anomaly regions use a global historical baseline applied to current pixel-level spectral composites; they are a localization proxy, not a per-pixel historical baseline."


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), {"ignoreNullFields": "false"})


def _shaped(rows: DataFrame, table: DataFrame, made: dict[str, Column]) -> DataFrame:
    """The table's columns: made ones, else those of ``rows``, else null."""
    return rows.select(*[(made[c] if c in made else F.col(c) if c in rows.columns else F.lit(None).cast(table.schema[c].dataType)).alias(c) for c in table.columns])


def placed_results(table: DataFrame, observations: DataFrame, results: DataFrame) -> DataFrame:
    """Results with the observation of their body and scene and an analysis id of their own, after the largest of ``table``.

    Adds observation_id, analysis_id, anomaly_detected and individual_scores (the scores of the indicators that results
    have). Numbered by observation and moment of creation.
    """
    keys = ["water_body_id", "scene_id"]
    named = results.join(observations.select(F.col("id").alias("observation_id"), *keys), keys)
    scores = [F.struct(F.lit(k).alias("key"), F.col(f"{k}_score").alias("value")) for k in INDICATORS if f"{k}_score" in results.columns]
    ids = numbered(named.drop("id"), _top(table), ["observation_id", "created_at"]).withColumnRenamed("id", "analysis_id")
    return ids.withColumn("anomaly_detected", F.col("anomaly_level") != "NONE").withColumn("individual_scores", F.map_from_entries(F.array(*scores)) if scores else F.lit(None).cast("map<string,double>"))


def appended_analyses(table: DataFrame, placed: DataFrame) -> DataFrame:
    """The table with the analysis of each placed result; ``analysis_data``, if the table has it, is its whole document.

    Fields of the document that results do not have are null; so is the confidence, which an analysis never states.
    """
    version = F.coalesce("model_version", F.lit(PROTOTYPE)) if "model_version" in placed.columns else F.lit(PROTOTYPE)
    made = {"id": F.col("analysis_id"), "model_name": F.lit(MODEL), "model_version": version}
    made["analysis_data"] = _json(**{k: F.col(c) if c in placed.columns else F.lit(None).cast("string") for k, c in DOCUMENT.items()})
    return table.unionByName(_shaped(placed, table, made))


def appended_alerts(table: DataFrame, placed: DataFrame) -> DataFrame:
    """The table with an alert for each placed result above the band NONE, tied to the analysis of that very result.

    The indicator is that of the largest score, area aside. ``explanation``, if the table has it, holds the result's
    messages and scores. Numbered by body and analysis.
    """
    scores = {k: F.col(f"{k}_score") for k in INDICATORS if k != "area"}
    messages = F.col("explanation") if "explanation" in placed.columns else F.array().cast("array<string>")
    made = {
        "date": F.col("observation_date"), "indicator": dominant(scores), "severity": F.col("anomaly_level"), "status": F.lit("active"),
        "explanation": _json(messages=messages, indicator_scores=F.col("individual_scores"), spatial_note=F.lit(NOTE)),
    }
    raised = placed.where((F.col("anomaly_level") != "NONE") & (F.col("anomaly_score") >= scalar.ALERT_LEAST))
    made["id"] = F.lit(None).cast("long")
    row = _shaped(raised, table, made).drop("id")
    return table.unionByName(numbered(row, _top(table), ["water_body_id", "analysis_id"]))
