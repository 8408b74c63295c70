"""Choice of a scene for a body and date, and scene items as observations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The widening attempts, as days either way and percent of cloud.
LADDER = ((15, 20.0), (30, 30.0), (45, 40.0), (60, 50.0), (75, 60.0), (90, 60.0))


#: Days of a stretch of time into which a body's scenes and targets are divided.
STRETCH = 730


def choose(targets: DataFrame, scenes: DataFrame, ladder=LADDER) -> DataFrame:
    """Per target (target_id, body, target_date): the first attempt with a match and the nearest scene within it.

    A scene matches an attempt if its day is within the window and its cloud below the limit. Ties go to less cloud,
    then the smaller id. An as-of join to both sides: scenes and targets of a body are sorted together by time, once
    forward and once backward, and each target takes from the sorted rows the last scene so far under each limit of
    cloud. On either side the nearest scene in time is the nearest in days as well, so these two for each limit decide
    every attempt. Stretches of time are sorted apart from each other, with the scenes that are up to the widest
    window beyond their borders. Targets and scenes without a date or body match nothing.
    """
    widest = max(d for d, _ in ladder) + 1
    stretch = lambda day: F.floor(F.unix_date(day) / STRETCH)
    limits = sorted({c for _, c in ladder})
    named = {c: f"_under_{i}" for i, c in enumerate(limits)}
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    s = scenes.select("body", micros("datetime").alias("_at"), F.to_date("datetime").alias("_day"), "cloud", "scene_id", "datetime").where((F.col("cloud") < limits[-1]) & F.col("body").isNotNull() & F.col("_at").isNotNull())
    own = stretch(F.col("_day"))
    here = [s.withColumn("_stretch", own), *[s.withColumn("_stretch", stretch(F.date_add("_day", shift))).where(F.col("_stretch") != own) for shift in (-widest, widest)]]
    s = reduce(DataFrame.unionByName, here)
    t = targets.select("target_id", "body", "target_date", micros("target_date").alias("_at"), F.to_date("target_date").alias("_day")).where("body is not null and _at is not null").withColumn("_stretch", stretch(F.col("_day")))
    rows = s.unionByName(t, allowMissingColumns=True).withColumn("_scene", F.col("scene_id").isNotNull())
    found = rows
    for side, time in (("before", F.asc("_at")), ("after", F.desc("_at"))):
        # Scenes come before targets of the same moment, the one with less cloud and the smaller id last of all.
        sofar = W.partitionBy("body", "_stretch").orderBy(time, F.desc("_scene"), F.desc("cloud"), F.desc("scene_id")).rowsBetween(W.unboundedPreceding, W.currentRow)
        scene = F.struct("_at", "_day", "cloud", "scene_id", "datetime")
        found = found.withColumns({f"{side}{named[c]}": F.last(F.when(F.col("_scene") & (F.col("cloud") < c), scene), ignorenulls=True).over(sofar) for c in limits})
    matches = []
    for attempt, (days, limit) in enumerate(ladder, 1):
        for side in ("before", "after"):
            x = F.col(f"{side}{named[limit]}")
            near = F.abs(F.date_diff(x["_day"], F.col("_day"))) <= days
            matches.append(F.when(near, F.struct(F.lit(attempt).alias("attempt"), F.abs(x["_at"] - F.col("_at")).alias("apart"), x["cloud"].alias("cloud"), x["scene_id"].alias("scene_id"), x["datetime"].alias("datetime"))))
    best = found.where(~F.col("_scene")).withColumn("_best", F.array_min(F.array_compact(F.array(*matches)))).where("_best is not null")
    return best.select("target_id", "body", "target_date", "_best.attempt", "_best.scene_id", "_best.datetime", "_best.cloud", (F.col("_best.attempt") > 1).alias("widened"))


def unmatched(targets: DataFrame, chosen: DataFrame) -> DataFrame:
    """Targets for which no attempt found a scene."""
    return targets.join(chosen.select("target_id"), "target_id", "left_anti")


def search(items: DataFrame, box: tuple[float, float, float, float], start, end, cloud_below: float) -> DataFrame:
    """Items that meet a box (xmin, ymin, xmax, ymax) in a time window with less cloud, newest first."""
    xmin, ymin, xmax, ymax = box
    meets = (F.col("xmin") <= xmax) & (F.col("xmax") >= xmin) & (F.col("ymin") <= ymax) & (F.col("ymax") >= ymin)
    return items.where(meets & F.col("datetime").between(start, end) & (F.col("cloud") < cloud_below)).orderBy(F.desc("datetime"), "scene_id")


def observation(items: DataFrame) -> DataFrame:
    """Items as observations: platform from the name where it is not given, cloud 0 where unknown."""
    platform = F.coalesce("platform", F.when(F.startswith("scene_id", F.lit("S2A")), "Sentinel-2A").when(F.startswith("scene_id", F.lit("S2B")), "Sentinel-2B").when(F.startswith("scene_id", F.lit("S2C")), "Sentinel-2C").otherwise("Sentinel-2"))
    return items.withColumn("platform", platform).withColumn("cloud", F.coalesce("cloud", F.lit(0.0)))
