"""What a dashboard shows: counts, pick-lists, search, flags, names, classes and formatted values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def counts(bodies: DataFrame, observations: DataFrame, analyses: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row: active bodies, observations, analyses and open alerts."""
    parts = [
        bodies.agg(F.count_if("active").alias("bodies")),
        observations.agg(F.count("*").alias("observations")),
        analyses.agg(F.count("*").alias("analyses")),
        alerts.agg(F.count_if(F.lower("status") == "active").alias("open_alerts")),
    ]
    keyed = [p.withColumn("_one", F.lit(1)) for p in parts]
    return reduce(lambda a, b: a.join(b, "_one"), keyed).drop("_one")


def pick_list(bodies: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column, sorted, without null."""
    return bodies.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def search(bodies: DataFrame, text: str) -> DataFrame:
    """Bodies whose name, district or type has the text, in any case."""
    found = [F.coalesce(F.contains(F.lower(c), F.lit(text.lower())), F.lit(False)) for c in ("name", "district", "type")]
    return bodies.where(reduce(lambda a, b: a | b, found))


def with_open_alert(bodies: DataFrame, alerts: DataFrame) -> DataFrame:
    """Bodies with whether an alert of theirs is open."""
    having = alerts.where(F.lower("status") == "active").select(F.col("water_body_id").alias("id")).distinct().withColumn("_has", F.lit(True))
    return bodies.join(having, "id", "left").withColumn("has_open_alert", F.coalesce("_has", F.lit(False))).drop("_has")


def with_body_name(rows: DataFrame, bodies: DataFrame) -> DataFrame:
    """Rows with their body's name, or ``#id`` where it is unknown."""
    names = bodies.select(F.col("id").alias("water_body_id"), F.col("name").alias("_name"))
    label = F.coalesce("_name", F.concat(F.lit("#"), F.col("water_body_id").cast("string")))
    return rows.join(names, "water_body_id", "left").withColumn("body_name", label).drop("_name")


def chosen_alert(alerts: DataFrame, latest_analysis: DataFrame) -> DataFrame:
    """Per body its open alert: that of the newest analysis (water_body_id, analysis_id) first, else the newest."""
    newest = latest_analysis.select("water_body_id", F.col("analysis_id").alias("_newest"))
    df = alerts.where(F.lower("status") == "active").join(newest, "water_body_id", "left")
    df = df.withColumn("tied", F.coalesce(F.col("analysis_id") == F.col("_newest"), F.lit(False))).drop("_newest")
    order = W.partitionBy("water_body_id").orderBy(F.desc("tied"), F.desc("date"), F.desc("id"))
    return df.withColumn("_at", F.row_number().over(order)).where("_at = 1").drop("_at")


def top(df: DataFrame, by: str, n: int, tie: str = "id") -> DataFrame:
    """The first n rows by a column, largest first."""
    return df.orderBy(F.desc(by), F.desc(tie)).limit(n)


def severity_class(severity: Column) -> Column:
    """high, medium, low or none, by what the word contains."""
    s = F.lower(severity)
    has = lambda *words: reduce(lambda a, b: a | b, [F.contains(s, F.lit(w)) for w in words])
    return F.when(has("critical", "high"), "high").when(has("medium", "moderate"), "medium").when(has("low"), "low").otherwise("none")


def _digits(x: Column, digits: int) -> Column:
    """A number with so many digits. Negative ones that round to zero, and a negative zero, keep their sign."""
    size = F.format_string(f"%.{digits}f", F.round(F.abs(x), digits))
    return F.when(x.cast("string").startswith("-"), F.concat(F.lit("-"), size)).otherwise(size)


def fixed(x: Column, digits: int = 2) -> Column:
    """A number with so many digits, a dash for none."""
    return F.coalesce(F.when(x.isNotNull() & ~F.isnan(x), _digits(x, digits)), F.lit("—"))


def percent(x: Column, digits: int = 1) -> Column:
    """A share as percent."""
    return F.coalesce(F.when(x.isNotNull() & ~F.isnan(x), F.concat(_digits(x * 100, digits), F.lit("%"))), F.lit("—"))


def signed(x: Column, digits: int = 3) -> Column:
    """A change with its sign."""
    return F.coalesce(F.when(x.isNotNull() & ~F.isnan(x), F.concat(F.when(x > 0, "+").otherwise(""), _digits(x, digits))), F.lit("—"))


def has_import(bodies: DataFrame) -> DataFrame:
    """One row: whether any body is not entered by hand."""
    return bodies.agg(F.coalesce(F.bool_or(F.lower("source") != "manual"), F.lit(False)).alias("has_import"))


def overriding(*maps: Column) -> Column:
    """The maps' entries together; of equal keys the last map's counts. Null maps are empty."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))

    def both(a: Column, b: Column) -> Column:
        return F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k)), b)

    return reduce(both, [F.coalesce(m, none) for m in maps])


def first_of(rows: DataFrame, newest: DataFrame, key: str) -> DataFrame:
    """What a list shows for each key: the marked newest row, or the first of the list where none is marked.

    ``newest`` (key, id) marks rows of ``rows`` (key, id, place).
    """
    df = rows.join(newest.select(key, F.col("id").alias("_marked")), key, "left")
    best = df.groupBy(key).agg(F.min_by("id", F.struct(F.coalesce(F.col("id") != F.col("_marked"), F.lit(True)), "place")).alias("id"))
    return rows.join(best, [key, "id"], "left_semi")


def feature_collections(features: DataFrame, key: str) -> DataFrame:
    """(key, collection): the features (feature_id, ring, properties) of each key as one GeoJSON FeatureCollection, by id.

    Features without a ring are left out; a key of which all are has an empty collection.
    """
    points = F.transform("ring", lambda p: F.array(p["lon"], p["lat"]))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(points).alias("coordinates"))
    one = F.struct(F.lit("Feature").alias("type"), F.col("feature_id").alias("id"), geometry.alias("geometry"), F.col("properties"))
    shown = F.when(F.col("ring").isNotNull(), F.struct(F.col("feature_id"), F.to_json(one).alias("json")))
    listed = features.groupBy(key).agg(F.array_sort(F.collect_list(shown)).alias("_f"))
    joined = F.array_join(F.transform("_f", lambda x: x["json"]), ",")
    return listed.select(key, F.concat(F.lit('{"type":"FeatureCollection","features":['), joined, F.lit("]}")).alias("collection"))


def alert_features(alerts: DataFrame, analyses: DataFrame) -> DataFrame:
    """Features of open alerts: an alert's own ring, else the regions of its analysis that have one.

    ``analyses``: id and features, an array of (ring, properties map). Numbers count from 0 before features without a
    ring go. Properties are the alert's, then the feature's, then the ids.
    """
    a = alerts.where(F.lower("status") == "active")
    base = F.create_map(F.lit("indicator"), F.col("indicator"), F.lit("severity"), F.col("severity"))
    ids = F.create_map(F.lit("alert_id"), F.col("id").cast("string"), F.lit("water_body_id"), F.col("water_body_id").cast("string"))
    own = a.where("ring is not null").select(F.col("id").cast("string").alias("feature_id"), F.col("id").alias("alert_id"), "ring", overriding(base, ids).alias("properties"))
    regions = analyses.select(F.col("id").alias("analysis_id"), "features")
    rest = a.where("ring is null").drop("ring").join(regions, "analysis_id").select("*", F.posexplode("features").alias("_n", "_f")).where(F.col("_f")["ring"].isNotNull())
    merged = overriding(base, F.col("_f")["properties"], ids)
    from_regions = rest.select(F.concat_ws("-", "id", "_n").alias("feature_id"), F.col("id").alias("alert_id"), F.col("_f")["ring"].alias("ring"), merged.alias("properties"))
    return own.unionByName(from_regions)
