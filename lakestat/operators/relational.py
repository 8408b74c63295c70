"""Latest and first rows per key, optional filters, listings, top-k and keyed lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the largest values of ``order`` for each key: one aggregation with map-side combining, no sort."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_best"))
    return best.select(*keys, *[F.col("_best")[c].alias(c) for c in rest])


def first_per_key(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str]) -> DataFrame:
    """The first row of each key in the given order, null first; keys may be expressions, and null is a key.

    One aggregation with map-side combining.
    """
    keyed = [(k if isinstance(k, Column) else F.col(k)).alias(f"_k{i}") for i, k in enumerate(keys)]
    best = df.groupBy(*keyed).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_best"))
    return best.select("_best.*")


def last_per_key(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The last row of each key."""
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(order)).alias("_best"))
    return best.select("_best.*")


def where_given(df: DataFrame, **equal) -> DataFrame:
    """Equality filters; an empty or missing value is no filter."""
    for name, value in equal.items():
        if value not in (None, ""):
            df = df.where(F.col(name) == value)
    return df


def between(df: DataFrame, column: str, low=None, high=None) -> DataFrame:
    """Inclusive range, each side optional; a range that is upside down is an error."""
    if low is not None and high is not None and low > high:
        raise ValueError("the range starts after its end")
    if low is not None:
        df = df.where(F.col(column) >= F.lit(low))
    if high is not None:
        df = df.where(F.col(column) <= F.lit(high))
    return df


def lookup(df: DataFrame, value, key: str = "id") -> DataFrame:
    """The row of a key, or none."""
    return df.where(F.col(key) == value).limit(1)


def required(df: DataFrame, value, key: str = "id") -> DataFrame:
    """The row of a key; an error where there is none."""
    found = lookup(df, value, key)
    if found.isEmpty():
        raise LookupError(f"no {key} {value!r}")
    return found


def without_match(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """Rows of ``left`` that nothing in ``right`` refers to."""
    return left.join(right, on, "left_anti")


def violations(alerts: DataFrame, analyses: DataFrame, observations: DataFrame, bodies: DataFrame) -> DataFrame:
    """(id, error) of alerts that refer to a missing body, analysis or observation, or to one of another body."""
    b = bodies.select(F.col("id").alias("_b"))
    a = analyses.select(F.col("id").alias("_a"), F.col("observation_id").alias("_ao"))
    o = observations.select(F.col("id").alias("_o"), F.col("water_body_id").alias("_ob"))
    joined = alerts.join(b, F.col("water_body_id") == F.col("_b"), "left").join(a, F.col("analysis_id") == F.col("_a"), "left").join(o, F.col("_ao") == F.col("_o"), "left")
    error = (
        F.when(F.col("_b").isNull(), "no_body")
        .when(F.col("analysis_id").isNotNull() & F.col("_a").isNull(), "no_analysis")
        .when(F.col("_a").isNotNull() & F.col("_o").isNull(), "no_observation")
        .when(F.col("_o").isNotNull() & (F.col("_ob") != F.col("water_body_id")), "other_body")
    )
    return joined.select("id", error.alias("error")).where("error is not null")
