"""Incremental histories: a stream of records, each scored against the body's earlier ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import scalar
from ..operators.baseline import ELIGIBLE, INDICATORS, LEAST_OBSERVATIONS

OUTPUT = "water_body_id long, observation_date timestamp, prior_count long, baseline_status string, anomaly_score double, anomaly_level string"
STATE = "dates array<long>, ok array<boolean>, " + ", ".join(f"{k} array<double>" for k in INDICATORS)


def _scores(values: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    """Scores of values against rounded means and deviations; missing where any of them is."""
    mean, std = np.round(mean, 6), np.round(std, 6)
    off = np.abs(values - mean)
    with np.errstate(divide="ignore", invalid="ignore"):
        z = np.where(std < 1e-8, np.where(off >= 1e-6, 3.0, 0.0), off / std)
        score = np.round(np.clip(1 - 1 / (1 + (z / scalar.Z_SCALE) ** 2), 0, 1), 4)
    return np.where(np.isnan(values) | np.isnan(mean), np.nan, score)


def _level(score: float) -> str | None:
    return None if np.isnan(score) else next((name for below, name in scalar.BANDS if score < below), "HIGH")


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Scores the new records of a body and merges them into its history.

    Records are taken by date, so each meets what is stored and what the batch has of earlier dates: one merge and one
    running sum for all of them together.
    """
    new = pd.concat(list(batches)).sort_values(["observation_date", "seq"])
    columns = list(INDICATORS.values())
    fresh = pd.DataFrame({"at": new["observation_date"].to_numpy().astype("datetime64[us]").astype(np.int64), "ok": new["mask_quality_status"].isin(ELIGIBLE).to_numpy(), **{c: new[c].to_numpy(dtype=float) for c in columns}})
    stored = [list(x) for x in state.get] if state.exists else [[] for _ in range(2 + len(columns))]
    old = pd.DataFrame(dict(zip(["at", "ok", *columns], stored, strict=True))).astype({"at": np.int64, "ok": bool} | dict.fromkeys(columns, float))
    held = pd.concat([old, fresh]).drop_duplicates("at", keep="last").sort_values("at", ignore_index=True)

    before = np.searchsorted(held["at"].to_numpy(), fresh["at"].to_numpy())
    prior = np.concatenate([[0], np.cumsum(held["ok"])])[before]
    valid, total = prior >= LEAST_OBSERVATIONS, np.zeros(len(fresh))
    for k, c in INDICATORS.items():
        x = np.where(held["ok"], held[c], np.nan)
        there = ~np.isnan(x)
        base = x[there].mean() if there.any() else 0.0  # sums of squares around it lose no digits
        n, one, two = (np.concatenate([[0.0], np.cumsum(np.where(there, v, 0.0))])[before] for v in (there, x - base, (x - base) ** 2))
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = one / n
            total += scalar.SCORE_WEIGHTS[k] * _scores(fresh[c].to_numpy(), mean + base, np.sqrt(np.maximum(two / n - mean**2, 0)))
    score = np.where(valid, np.round(total, 4), 0.0)
    state.update(tuple(held[c].tolist() for c in ["at", "ok", *columns]))
    status = np.where(valid, "valid", "insufficient_baseline")
    yield pd.DataFrame({"water_body_id": key[0], "observation_date": new["observation_date"].to_numpy(), "prior_count": prior, "baseline_status": status, "anomaly_score": score, "anomaly_level": [_level(x) for x in score]})


def scored_stream(records: DataFrame) -> DataFrame:
    """Each record of a stream with its score, once, when it arrives; a record of a known date replaces the older one.

    ``records``: water_body_id, observation_date, seq, mask_quality_status and the indicators. The baseline is of
    strictly earlier dates, so late records are welcome; what was scored before stays as it was.
    """
    records = records.withColumn("observation_date", F.col("observation_date").cast("timestamp"))
    return records.groupBy("water_body_id").applyInPandasWithState(_update, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def daily_counts(records: DataFrame, late: str = "7 days") -> DataFrame:
    """Records per body and day of a stream, with a bound on lateness so that state is dropped."""
    at = records.withColumn("observation_date", F.col("observation_date").cast("timestamp")).withWatermark("observation_date", late)
    return at.groupBy("water_body_id", F.window("observation_date", "1 day").alias("day")).agg(F.count("*").alias("records"), F.max("cloud_percentage").alias("worst_cloud"))
