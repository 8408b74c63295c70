"""Baselines of a body's history and anomaly scores against them."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar

ELIGIBLE = ("ok", "ok_with_warning")
LEAST_OBSERVATIONS = 3
INDICATORS = {"turbidity": "turbidity_indicator", "chlorophyll": "chlorophyll_indicator", "algal": "algal_indicator", "area": "water_area_km2"}
SHARES = {"p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9}
KEYS = ("mean", "std", "median", "min", "max", "p10", "p25", "p75", "p90")


def _stats(x: Column, over=None, digits: int | None = 6, keys: tuple[str, ...] = KEYS) -> Column:
    on = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    asked = [k for k in SHARES if k in keys]
    values = {"mean": F.avg(x), "std": F.stddev_pop(x), "min": F.min(x), "max": F.max(x)}
    found = {k: on(v) for k, v in values.items() if k in keys}
    if asked:
        p = on(F.percentile(x, F.array(*[F.lit(SHARES[k]) for k in asked])))
        found |= {k: p[i] for i, k in enumerate(asked)}
    return F.struct(*[(found[k] if digits is None else F.round(found[k], digits)).alias(k) for k in keys])


def eligible(history: DataFrame) -> DataFrame:
    """Records whose mask passed its checks, warnings included."""
    return history.where(F.col("mask_quality_status").isin(*ELIGIBLE))


def whole_baseline(history: DataFrame, digits: int = 6) -> DataFrame:
    """Per body: status, count, date range and, with enough records, statistics of every indicator."""
    enough = F.col("observation_count") >= LEAST_OBSERVATIONS
    stats = [_stats(F.col(c), digits=digits).alias(k) for k, c in INDICATORS.items()]
    df = eligible(history).groupBy("water_body_id").agg(F.count("*").alias("observation_count"), F.min("observation_date").alias("first_date"), F.max("observation_date").alias("last_date"), *stats)
    df = history.select("water_body_id").distinct().join(df, "water_body_id", "left").withColumn("observation_count", F.coalesce("observation_count", F.lit(0)))
    status = F.when(enough, "valid").otherwise("insufficient_baseline")
    return df.select("water_body_id", status.alias("status"), "observation_count", "first_date", "last_date", *[F.when(enough, F.col(k)).alias(k) for k in INDICATORS])


class OrderStatistics:
    """The k-th smallest of a stretch of some values, for many stretches and k at once.

    Values are replaced by their ranks, and a stable partition of these by each bit, from the highest on, keeps how
    many have a zero there. A question goes down the bits once: n log n to build, log n to answer.
    """

    def __init__(self, values: np.ndarray) -> None:
        self.sorted = np.sort(values, kind="stable")
        ranks = np.empty(len(values), dtype=np.int64)
        ranks[np.argsort(values, kind="stable")] = np.arange(len(values))
        self.zeros = []
        for bit in range(max(1, int(len(values)).bit_length()) - 1, -1, -1):
            one = (ranks >> bit & 1).astype(bool)
            self.zeros.append(np.r_[0, np.cumsum(~one)])
            ranks = np.r_[ranks[~one], ranks[one]]

    def smallest(self, end: np.ndarray, k: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
        """The value of place k (from 0) among the values from ``start`` (the first) to before ``end``; 0 <= k < end - start."""
        low, high, rank = np.zeros_like(end) if start is None else start.copy(), end.copy(), np.zeros_like(end)
        for zeros in self.zeros:
            left = zeros[high] - zeros[low]
            right = k >= left
            k = np.where(right, k - left, k)
            low, high = (np.where(right, zeros[-1] + x - zeros[x], zeros[x]) for x in (low, high))
            rank = rank * 2 + right
        return self.sorted[rank]


def prior_percentiles(at: np.ndarray, values: np.ndarray, used: np.ndarray, shares: list[float], body: np.ndarray | None = None) -> list[np.ndarray]:
    """For each record the percentiles (interpolated) of its body's used values of strictly earlier moments; NaN if there are none."""
    body = np.zeros(len(at), dtype=np.int64) if body is None else body
    order = np.lexsort((at, body))
    used_before = np.r_[0, np.cumsum(used[order])]
    other = np.r_[True, np.diff(body[order]) != 0][: len(at)]
    later = other | np.r_[True, np.diff(at[order]) != 0][: len(at)]
    start, end = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
    for bound, begins in ((start, other), (end, later)):
        bound[order] = used_before[np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))]
    some = np.flatnonzero(end > start)
    start, end = start[some], end[some]
    statistics = OrderStatistics(values[order][used[order]])
    out = []
    for share in shares:
        place = share * (end - start - 1)
        low, high = np.floor(place).astype(np.int64), np.ceil(place).astype(np.int64)
        a, b = (statistics.smallest(end, k, start) for k in (low, high))
        of = np.full(len(at), np.nan)
        of[some] = np.where(low == high, a, (high - place) * a + (place - low) * b)
        out.append(of)
    return out


#: Records that are handed to Python as one group, on average; a body's are never divided.
GROUP = 50_000


def _with_percentiles(df: DataFrame, asked: list[str], records: int) -> DataFrame:
    """Records (of so many) with columns _{indicator}_{share} of what was before each; bodies are dealt to groups whole."""
    schema = T.StructType([*df.schema.fields, *[T.StructField(f"_{k}_{x}", T.DoubleType()) for k in INDICATORS for x in asked]])

    def run(table: pa.Table) -> pa.Table:
        body = np.asarray(table.column("water_body_id").combine_chunks().dictionary_encode("encode").indices)
        at = np.asarray(table.column("_at"))
        ok = np.asarray(table.column("_ok").combine_chunks().fill_null(False))
        for k, c in INDICATORS.items():
            x = table.column(c).combine_chunks().cast(pa.float64())
            there = ok & np.asarray(x.is_valid())
            for name, got in zip(asked, prior_percentiles(at, np.asarray(x.fill_null(0.0)), there, [SHARES[s] for s in asked], body), strict=True):
                table = table.append_column(f"_{k}_{name}", pa.array(got, mask=np.isnan(got)))
        return table

    groups = max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-records // GROUP))
    dated = df.where("_at is not null").groupBy(F.pmod(F.xxhash64("water_body_id"), F.lit(groups))).applyInArrow(run, schema)
    return dated.unionByName(df.where("_at is null"), allowMissingColumns=True)


#: The statistics that scores need.
SCORING = ("mean", "std")


def prior_baseline(history: DataFrame, digits: int | None = 6, keys: tuple[str, ...] = SCORING) -> DataFrame:
    """Every record with the statistics of eligible records strictly before it.

    The frame is by time, so records of the same moment do not see each other. Means, deviations and extremes run along
    with the frame, one step per record. Percentiles, if ``keys`` ask for them, are exact too: see ``OrderStatistics``.
    """
    at = F.unix_micros(F.col("observation_date").cast("timestamp"))
    before = W.partitionBy("water_body_id").orderBy("_at").rangeBetween(W.unboundedPreceding, -1)
    ok = F.col("mask_quality_status").isin(*ELIGIBLE) & F.col("_at").isNotNull()  # an undated record is before none
    df = history.withColumn("_at", at).withColumn("prior_count", F.count(F.when(ok, 1)).over(before))
    running = tuple(k for k in keys if k not in SHARES)
    for k, c in INDICATORS.items():
        df = df.withColumn(f"{k}_prior", _stats(F.when(ok, F.col(c)), before, digits, running))
    if asked := [k for k in keys if k in SHARES]:
        df = _with_percentiles(df.withColumn("_ok", ok), asked, history.count()).drop("_ok")
        rounded = lambda c: c if digits is None else F.round(c, digits)
        for k in INDICATORS:
            df = df.withColumn(f"{k}_prior", F.struct(*[(rounded(F.col(f"_{k}_{x}")) if x in SHARES else F.col(f"{k}_prior")[x]).alias(x) for x in keys]))
        df = df.drop(*[f"_{k}_{x}" for k in INDICATORS for x in asked])
    df = df.withColumns({f"{k}_prior": F.when(F.col("prior_count") >= LEAST_OBSERVATIONS, F.col(f"{k}_prior")) for k in INDICATORS})
    status = F.when(F.col("prior_count") >= LEAST_OBSERVATIONS, "valid").otherwise("insufficient_baseline")
    return df.withColumn("baseline_status", status).drop("_at")


def baseline_status(history: DataFrame) -> DataFrame:
    """Per body: records, eligible and excluded ones, and how many are missing to a baseline."""
    n = F.count_if(F.col("mask_quality_status").isin(*ELIGIBLE))
    df = history.groupBy("water_body_id").agg(F.count("*").alias("total"), n.alias("eligible"))
    return df.select("water_body_id", "total", "eligible", (F.col("total") - F.col("eligible")).alias("excluded"), F.greatest(F.lit(0), LEAST_OBSERVATIONS - F.col("eligible")).alias("remaining"))


# The wording of explanations, with places for the value, the deviations and the mean.
MESSAGES = {
    "TURBIDITY_ELEVATED": "TURBIDITY_ELEVATED: Turbidity indicator (%.4f) is %.1f standard deviations above baseline mean (%.4f), suggesting increased suspended sediment or particulate matter.",
    "TURBIDITY_DEPRESSED": "TURBIDITY_DEPRESSED: Turbidity indicator (%.4f) is %.1f standard deviations below baseline mean (%.4f), suggesting unusually clear water conditions.",
    "CHLOROPHYLL_ELEVATED": "CHLOROPHYLL_ELEVATED: Chlorophyll indicator (%.4f) is %.1f standard deviations above baseline mean (%.4f), suggesting increased phytoplankton activity or nutrient loading.",
    "CHLOROPHYLL_DEPRESSED": "CHLOROPHYLL_DEPRESSED: Chlorophyll indicator (%.4f) is %.1f standard deviations below baseline mean (%.4f), suggesting reduced biological productivity.",
    "ALGAL_ELEVATED": "ALGAL_ELEVATED: Algal indicator (%.4f) is %.1f standard deviations above baseline mean (%.4f), suggesting potential algal bloom or floating vegetation.",
    "ALGAL_DEPRESSED": "ALGAL_DEPRESSED: Algal indicator (%.4f) is %.1f standard deviations below baseline mean (%.4f), suggesting reduced surface algal presence.",
    "AREA_INCREASE": "AREA_INCREASE: Water surface area (%.3f km2) is %.1f standard deviations above baseline mean (%.3f km2), suggesting water level rise or flooding.",
    "AREA_DECREASE": "AREA_DECREASE: Water surface area (%.3f km2) is %.1f standard deviations below baseline mean (%.3f km2), suggesting water level decline or drought conditions.",
}
_COMPOUND = {
    ("turbidity", "chlorophyll"): "COMPOUND_ANOMALY: Both turbidity and chlorophyll indicators are simultaneously elevated, suggesting possible runoff event carrying nutrients and sediment.",
    ("chlorophyll", "algal"): "COMPOUND_ANOMALY: Both chlorophyll and algal indicators are simultaneously elevated, suggesting active algal bloom conditions.",
}


def _codes(name: str) -> tuple[str, str]:
    return ("AREA_INCREASE", "AREA_DECREASE") if name == "area" else (f"{name.upper()}_ELEVATED", f"{name.upper()}_DEPRESSED")


def anomalies(scored: DataFrame, digits: int | None = 4) -> DataFrame:
    """Records of ``prior_baseline`` with scores, level, affected area, codes and explanations.

    Scores are rounded to ``digits``, or not at all with None. Without a valid baseline: score 0, level NONE, no scores and no explanations.
    """
    valid = F.col("baseline_status") == "valid"
    df = scored
    for k, c in INDICATORS.items():
        prior = F.col(f"{k}_prior")
        df = df.withColumn(f"{k}_z", F.when(valid, scalar.z_score(F.col(c), prior["mean"], prior["std"])))
        df = df.withColumn(f"{k}_score", scalar.z_to_score(F.col(f"{k}_z"), digits))
    df = df.withColumn("anomaly_score", F.when(valid, scalar.weighted_score({k: F.col(f"{k}_score") for k in INDICATORS}, digits)).otherwise(0.0))
    df = df.withColumn("anomaly_level", scalar.band(F.col("anomaly_score")))
    df = df.withColumn("affected_area_km2", F.round(F.col("anomaly_score") * F.col("water_area_km2"), 4))
    codes, texts = [], []
    for k, c in INDICATORS.items():
        mean, z, far = F.col(f"{k}_prior")["mean"], F.col(f"{k}_z"), F.col(f"{k}_z") >= scalar.Z_SCALE
        up, down = _codes(k)
        over = F.col(c) > mean
        codes.append(F.when(far & over, up).when(far, down))
        texts.append(F.when(far & over, F.format_string(MESSAGES[up], F.col(c), z, mean)).when(far, F.format_string(MESSAGES[down], F.col(c), z, mean)))
    for pair, text in _COMPOUND.items():
        both = reduce(lambda a, b: a & b, [(F.col(f"{k}_score") > 0.5) & (F.col(INDICATORS[k]) > F.col(f"{k}_prior")["mean"]) for k in pair])
        codes.append(F.when(both, "COMPOUND_ANOMALY"))
        texts.append(F.when(both, text))
    return df.withColumn("codes", F.array_compact(F.array(*codes))).withColumn("explanation", F.array_compact(F.array(*texts)))


def dominant(scores: dict[str, Column]) -> Column:
    """Name of the largest score, the first of equal ones in the given order; ``multiple`` if all are null."""
    entries = F.array(*[F.when(s.isNotNull(), F.struct(s.alias("score"), F.lit(-i).alias("place"), F.lit(k).alias("name"))) for i, (k, s) in enumerate(scores.items())])
    return F.coalesce(F.array_max(F.array_compact(entries))["name"], F.lit("multiple"))


def alerts(scored: DataFrame) -> DataFrame:
    """One alert for each record above the band NONE, named by its dominant indicator; area alone names none."""
    found = scored.where(F.col("anomaly_score") >= scalar.ALERT_LEAST)  # where the band NONE ends
    names = {k: F.col(f"{k}_score") for k in INDICATORS if k != "area"}
    return found.select(
        "water_body_id", "observation_date", dominant(names).alias("indicator"), F.lower("anomaly_level").alias("severity"), "anomaly_score", "affected_area_km2",
        scalar.scene_quality(F.col("cloud_percentage")).alias("quality_score"), F.lit("active").alias("status"),
    )
