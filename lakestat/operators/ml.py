"""Feature vectors, training rows and indicators."""

from __future__ import annotations

import logging

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel, Transformer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar

LEAST_ROWS = 10
# The columns of a feature vector in their order, each a layer's statistic, and the measured targets.
FEATURES = {
    "ndti_mean": ("ndti", "mean"),
    "ndti_median": ("ndti", "median"),
    "ndti_std": ("ndti", "std"),
    "ndti_p10": ("ndti", "p10"),
    "ndti_p90": ("ndti", "p90"),
    "red_green_ratio_mean": ("red_green", "mean"),
    "red_reflectance_mean": ("red", "mean"),
    "ndci_mean": ("ndci", "mean"),
    "ndci_median": ("ndci", "median"),
    "ndci_std": ("ndci", "std"),
    "ndci_p10": ("ndci", "p10"),
    "ndci_p90": ("ndci", "p90"),
    "green_blue_ratio_mean": ("green_blue", "mean"),
    "fai_mean": ("fai", "mean"),
    "fai_median": ("fai", "median"),
    "fai_std": ("fai", "std"),
    "fai_p10": ("fai", "p10"),
    "fai_p90": ("fai", "p90"),
    "nir_absolute_mean": ("nir", "mean"),
}
TARGETS = {"turbidity_measured": "turbidity", "chlorophyll_measured": "chlorophyll", "algal_density_measured": "algal"}
#: Name of the manifest in a folder of models.
MANIFEST = "manifest.json"


def promoted_models(spark: SparkSession, folder: str) -> tuple[str | None, dict[str, Transformer]]:
    """Version and fitted pipelines by target, of a folder's manifest; nothing without one.

    The manifest is a JSON object with model_version and models, by target: file (a saved pipeline in the folder) and
    promoted. Models that are not promoted or not there are left out.
    """
    schema = "model_version string, models map<string,struct<file:string,promoted:boolean>>"
    try:
        row = spark.read.schema(schema).json(f"{folder}/{MANIFEST}", multiLine=True).first()
    except AnalysisException:
        row = None
    if row is None:
        return None, {}
    found = {}
    for target, meta in sorted((row.models or {}).items()):
        if meta and meta.promoted:
            try:
                found[target] = PipelineModel.load(f"{folder}/{meta.file}")
            except (AnalysisException, Py4JJavaError) as e:
                logging.getLogger(__name__).warning("model of %s left out: %s", target, type(e).__name__)
    return row.model_version, found


def feature_vector(stats: DataFrame) -> DataFrame:
    """The 19 features from masked statistics; a missing one is 0."""
    own = [F.coalesce(F.col(f"{k}_{s}"), F.lit(0.0)).alias(n) if f"{k}_{s}" in stats.columns else F.lit(0.0).alias(n) for n, (k, s) in FEATURES.items()]
    return stats.select("scene_id", *own)


def training_rows(features: DataFrame, truth: DataFrame, columns: list[str], least: int = LEAST_ROWS) -> DataFrame:
    """Features and targets of the same body and date without any missing value; nothing if there are too few."""
    targets = [t for t in TARGETS if t in truth.columns]
    df = features.join(truth.select("water_body_id", "observation_date", *targets), ["water_body_id", "observation_date"])
    for c in (*columns, *targets):
        df = df.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    if not targets or df.limit(least).count() < least:
        return df.where(F.lit(False))
    return df


def indicators(stats: DataFrame, models: dict[str, Transformer] | None = None) -> DataFrame:
    """Indicators with how each came about: the composites, or a model's prediction clipped to [0, 1].

    ``models``: fitted pipelines by target, whose output column is ``prediction``.
    """
    df = stats
    for target, name in TARGETS.items():
        if models and target in models:
            df = models[target].transform(df).withColumn(name, scalar.clip(F.col("prediction"))).drop("prediction").withColumn(f"{name}_mode", F.lit("model_calibrated"))
        else:
            df = df.withColumn(name, F.round(F.coalesce(name, F.lit(0.0)), 6)).withColumn(f"{name}_mode", F.lit("spectral_indicator_only"))
    return df
