"""Scalar expressions: safe ratios, rescaling, calibration, water indices, scores and bands.

Missing values are NULL, never NaN. ``least`` and ``greatest`` skip NULL, so every clip is guarded.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Index ranges, weights and thresholds.
RANGES = {
    "ndti": (-0.30, 0.40), "red_green": (0.3, 2.0), "red": (0.0, 0.15), "ndci": (-0.40, 0.30), "green_blue": (0.5, 2.5),
    "nir_red": (-0.50, 0.30), "fai": (-0.02, 0.08), "nir": (0.0, 0.10), "mndwi_inverted": (-0.50, 0.30),
}
COMPOSITES = {
    "turbidity": {"ndti": 0.45, "red_green": 0.30, "red": 0.25},
    "chlorophyll": {"ndci": 0.40, "green_blue": 0.35, "nir_red": 0.25},
    "algal": {"fai": 0.50, "nir": 0.30, "mndwi_inverted": 0.20},
}
WAVELENGTH_RED, WAVELENGTH_NIR, WAVELENGTH_SWIR = 665.0, 842.0, 1610.0
MNDWI_LEAST, NDWI_LEAST, NIR_BELOW, SWIR_BELOW, SCL_WATER, SCL_MNDWI_LEAST = 0.05, 0.02, 0.18, 0.15, 6, -0.05
CLOUD_CLASSES = (3, 8, 9, 10)
DN_OFFSET, DN_SCALE = 1000, 10000.0
OFFSET_BASELINE, OFFSET_DATE = 4.0, "2022-01-25"
Z_SCALE = 1.5
SCORE_WEIGHTS = {"turbidity": 0.30, "chlorophyll": 0.30, "algal": 0.25, "area": 0.15}
BANDS = ((0.25, "NONE"), (0.50, "LOW"), (0.75, "MEDIUM"))
ALERT_LEAST = 0.25


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """x held between the bounds; NULL stays NULL."""
    return F.when(x.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), x)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where the denominator is within 1e-8 of zero."""
    return F.when(F.abs(b) > 1e-8, a / b)


def rescaled(x: Column, low: float, high: float) -> Column:
    """x mapped from [low, high] to [0, 1] and clipped; 0.5 for a range without extent."""
    if abs(high - low) < 1e-10:
        return F.when(x.isNotNull(), F.lit(0.5))
    return clip((x - low) / (high - low))


def has_offset(baseline: Column, date: Column) -> Column:
    """Whether digital numbers carry the radiometric offset: by processing baseline, else by acquisition date."""
    number = baseline.try_cast("double")
    by_baseline = F.when(number.isNotNull(), number >= OFFSET_BASELINE).otherwise(baseline >= "04.00")
    return F.coalesce(F.when(baseline.isNotNull(), by_baseline), date >= OFFSET_DATE, F.lit(False))


def reflectance(dn: Column, offset: Column) -> Column:
    """Digital number to reflectance in [0, 1]; NULL where there is no data (0 or less)."""
    return F.when(dn > 0, clip((dn - F.when(offset, DN_OFFSET).otherwise(0)) / DN_SCALE))


def index_layers(blue: Column, green: Column, red: Column, nir: Column, swir: Column) -> dict[str, Column]:
    """The raw spectral layers by name."""
    slope = (WAVELENGTH_NIR - WAVELENGTH_RED) / (WAVELENGTH_SWIR - WAVELENGTH_RED)
    return {
        "ndti": ratio(red - green, red + green), "red_green": ratio(red, green), "red": red,
        "ndci": ratio(nir - red, nir + red), "green_blue": ratio(green, blue), "nir_red": ratio(nir - red, nir + red),
        "fai": nir - (red + (swir - red) * slope), "nir": nir, "mndwi_inverted": -ratio(green - swir, green + swir),
    }


def composite(name: str, layer: dict[str, Column]) -> Column:
    """Weighted blend of rescaled layers; NULL if any is."""
    return reduce(lambda a, b: a + b, [w * rescaled(layer[k], *RANGES[k]) for k, w in COMPOSITES[name].items()])


def water_index(a: Column, b: Column) -> Column:
    """(a - b) / (a + b), -1 unless the sum is over 1e-6."""
    return F.when(a + b > 1e-6, (a - b) / (a + b)).otherwise(-1.0)


def is_water(green: Column, red: Column, nir: Column, swir: Column, scl: Column) -> Column:
    """The water rule for one pixel."""
    mndwi, ndwi = water_index(green, swir), water_index(green, nir)
    rule = [
        (mndwi > MNDWI_LEAST) & (nir < NIR_BELOW),
        (ndwi > NDWI_LEAST) & (green > red) & (swir < SWIR_BELOW),
        (scl == SCL_WATER) & (mndwi > SCL_MNDWI_LEAST),
    ]
    return reduce(lambda a, b: a | b, [F.coalesce(r, F.lit(False)) for r in rule])


def water_confidence(green: Column, nir: Column, swir: Column, scl: Column, water: Column) -> Column:
    """Confidence of a water pixel in [0, 1], 0 elsewhere."""
    base = 0.6 * clip((water_index(green, swir) + 0.2) / 0.8) + 0.4 * clip(1.0 - nir / 0.25)
    return F.when(water, clip(base + F.when(scl == SCL_WATER, 0.2).otherwise(0.0))).otherwise(0.0)


def z_score(value: Column, mean: Column, std: Column) -> Column:
    """Distance from the mean in deviations; of a constant baseline 3 for any departure, else 0."""
    off = F.abs(value - mean)
    return F.when(std < 1e-8, F.when(off >= 1e-6, 3.0).otherwise(0.0)).otherwise(off / std)


def z_to_score(z: Column, digits: int | None = 4) -> Column:
    """A score in [0, 1] that is one half at 1.5 deviations."""
    score = clip(1.0 - 1.0 / (1.0 + F.pow(z / Z_SCALE, F.lit(2.0))))
    return score if digits is None else F.round(score, digits)


def weighted_score(scores: dict[str, Column], digits: int | None = 4) -> Column:
    """Composite anomaly score."""
    score = clip(reduce(lambda a, b: a + b, [w * scores[k] for k, w in SCORE_WEIGHTS.items()]))
    return score if digits is None else F.round(score, digits)


def band(score: Column) -> Column:
    """NONE, LOW, MEDIUM or HIGH; NULL for NULL."""
    found = None
    for below, name in BANDS:
        found = F.when(score < below, name) if found is None else found.when(score < below, name)
    return found.when(score.isNotNull(), "HIGH")


def scene_quality(cloud: Column) -> Column:
    """1 less the clouded share, in [0, 1]."""
    return clip(1.0 - cloud / 100.0)


def difference(later: Column, earlier: Column) -> Column:
    """later - earlier, NULL if either is."""
    return later - earlier


def pipeline_status(mask_status: Column, baseline_status: Column) -> Column:
    """Degraded before quality_warning before insufficient_baseline before ok."""
    return (
        F.when(~mask_status.isin("ok", "ok_with_warning"), "degraded")
        .when(mask_status == "ok_with_warning", "quality_warning")
        .when(baseline_status != "valid", "insufficient_baseline")
        .otherwise("ok")
    )
