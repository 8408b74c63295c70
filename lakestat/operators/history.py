"""Timelines, trends, comparisons and anomaly histories of all water bodies at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .relational import between, latest_per_key

METRICS = ("turbidity", "chlorophyll", "anomaly_score")
ANALYSIS_ORDER = ("created_at", "id")


def with_latest_analysis(observations: DataFrame, analyses: DataFrame, how: str = "left") -> DataFrame:
    """Observations with their newest analysis: left keeps those without one, inner drops them."""
    newest = latest_per_key(analyses, ["observation_id"], ANALYSIS_ORDER).withColumnRenamed("id", "analysis_id")
    return observations.withColumnRenamed("id", "observation_id").join(newest, "observation_id", how)


def timeline(observations: DataFrame, analyses: DataFrame, start=None, end=None) -> DataFrame:
    """One row per observation, with its newest analysis or nulls; an absent flag is false."""
    df = with_latest_analysis(between(observations, "observation_date", start, end), analyses)
    detected = F.when(F.col("analysis_id").isNotNull(), F.coalesce("anomaly_detected", F.lit(False)))
    return df.select("water_body_id", "observation_id", "observation_date", "satellite", "analysis_id", *METRICS, detected.alias("anomaly_detected"))


def snapshots(observations: DataFrame, analyses: DataFrame, start=None, end=None) -> DataFrame:
    """One row per observation with its newest analysis as its JSON document tells it, or nulls.

    ``analyses``: id, observation_id, created_at, model_name, model_version, analysis_data (JSON text). Keys that are
    absent have their defaults, see ``text.evidence``.
    """
    df = with_latest_analysis(between(observations, "observation_date", start, end), analyses)
    there = F.col("analysis_id").isNotNull()
    fields = {k: F.when(there, c).alias(k) for k, c in text.evidence(F.col("analysis_data")).items()}
    return df.select("water_body_id", "observation_id", "observation_date", "analysis_id", "model_name", "model_version", *fields.values())


def trend(observations: DataFrame, analyses: DataFrame, start=None, end=None) -> DataFrame:
    """Per body: observations, those analysed, anomalies, and the range of each metric."""
    df = timeline(observations, analyses, start, end)
    ranges = [f(m).alias(f"{n}_{m}") for m in METRICS for n, f in (("min", F.min), ("max", F.max))]
    return df.groupBy("water_body_id").agg(
        F.count("*").alias("observations"), F.count("analysis_id").alias("analysed"), F.count_if("anomaly_detected").alias("anomalies"), *ranges
    )


def trend_series(observations: DataFrame, analyses: DataFrame, start=None, end=None) -> DataFrame:
    """Per body: its points in order of date, as an array."""
    point = F.struct("observation_date", "observation_id", "analysis_id", *METRICS)
    return timeline(observations, analyses, start, end).groupBy("water_body_id").agg(F.array_sort(F.collect_list(point)).alias("points"))


def comparison(observations: DataFrame, analyses: DataFrame, start=None, end=None) -> DataFrame:
    """Per body: first and last analysed observation and the change between them, null with fewer than two."""
    df = with_latest_analysis(between(observations, "observation_date", start, end), analyses, "inner")
    point, order = F.struct("observation_id", "observation_date", *METRICS), F.struct("observation_date", "observation_id")
    ends = df.groupBy("water_body_id").agg(F.count("*").alias("analysed"), F.min_by(point, order).alias("earlier"), F.max_by(point, order).alias("latest"))
    both = F.col("analysed") >= 2
    changes = [F.when(both, F.col("latest")[m] - F.col("earlier")[m]).alias(f"change_{m}") for m in METRICS]
    sides = [F.when(both, F.col(s)["observation_id"]).alias(f"{s}_id") for s in ("earlier", "latest")]
    return ends.select("water_body_id", "analysed", both.alias("available"), *sides, *changes)


def anomaly_history(observations: DataFrame, analyses: DataFrame, start=None, end=None) -> DataFrame:
    """Observations whose newest analysis found an anomaly, with the body's count of them."""
    df = with_latest_analysis(between(observations, "observation_date", start, end), analyses, "inner")
    found = df.where(F.coalesce("anomaly_detected", F.lit(False)))
    counts = found.groupBy("water_body_id").agg(F.count("*").alias("anomalies"))
    return found.select("water_body_id", "observation_id", "observation_date", "analysis_id", "anomaly_score").join(counts, "water_body_id")


def analyses_by_body(observations: DataFrame, analyses: DataFrame) -> DataFrame:
    """All analyses with the body that they are of."""
    o = observations.select(F.col("id").alias("observation_id"), "water_body_id")
    return analyses.join(o, "observation_id")
