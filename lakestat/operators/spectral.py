"""Statistics of spectral layers over the water pixels of each scene."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar


def layers(pixels: DataFrame) -> DataFrame:
    """Pixels with raw, rescaled and composite layers, null outside water (column ``water``)."""
    band = {b: F.when(F.col("water"), F.col(b)) for b in ("b02", "b03", "b04", "b08", "b11")}
    raw = scalar.index_layers(band["b02"], band["b03"], band["b04"], band["b08"], band["b11"])
    df = pixels.withColumns(raw)
    held = {k: F.col(k) for k in raw}
    df = df.withColumns({f"{k}_scaled": scalar.rescaled(c, *scalar.RANGES[k]) for k, c in held.items()})
    return df.withColumns({f"{k}_composite": scalar.composite(k, held) for k in scalar.COMPOSITES})


def layer_names() -> list[str]:
    """All 21 layers: raw, rescaled, composite."""
    return [*scalar.RANGES, *(f"{k}_scaled" for k in scalar.RANGES), *(f"{k}_composite" for k in scalar.COMPOSITES)]


def masked_stats(pixels: DataFrame, digits: int = 6, names: list[str] | None = None) -> DataFrame:
    """Per scene, eight statistics of each layer, in one aggregation."""
    aggs = []
    for k in names or layer_names():
        p = F.percentile(k, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
        values = {"mean": F.avg(k), "median": p[1], "std": F.stddev_pop(k), "min": F.min(k), "max": F.max(k), "p10": p[0], "p90": p[2]}
        aggs += [F.round(v, digits).alias(f"{k}_{n}") for n, v in values.items()] + [F.count(k).alias(f"{k}_valid")]
    return layers(pixels).groupBy("scene_id").agg(*aggs)


def indicators(pixels: DataFrame, digits: int = 6, parity: bool = False) -> DataFrame:
    """Per scene the three indicators: mean composite, clipped. Without water null, or 1.0 with ``parity``."""
    found = {k: F.round(scalar.clip(F.avg(f"{k}_composite")), digits) for k in scalar.COMPOSITES}
    return layers(pixels).groupBy("scene_id").agg(*[(F.coalesce(c, F.lit(1.0)) if parity else c).alias(k) for k, c in found.items()])


def water_summary(pixels: DataFrame) -> DataFrame:
    """Per scene: pixels, water pixels, their share, area at 100 square metres each, and cloudy pixels."""
    n = F.count_if("water")
    cloudy = F.col("scl").isin(*scalar.CLOUD_CLASSES)
    return pixels.groupBy("scene_id").agg(
        F.count("*").alias("total_pixels"), n.alias("water_pixels"), (n / F.count("*") * 100).alias("water_pct"), (n * 1e-4).alias("water_area_km2"), F.count_if(cloudy).alias("cloudy_pixels")
    )
