"""The library's relations over the tables at hand, and the same as SQL for checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import table

TYPES = ("Lake", "Reservoir", "Pond", "Wetland")


def bodies(spark: SparkSession, d: str) -> DataFrame:
    """Water bodies: suppliers with their nation as district and region as state, on rectangles."""
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    df = table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("s_suppkey")
    lon, lat, w = 72 + (k * 37 % 800) / F.lit(100.0), 15 + (k * 53 % 700) / F.lit(100.0), 0.02 + (k % 10) / F.lit(100.0)
    corners = [(lon, lat), (lon + w, lat), (lon + w, lat + w), (lon, lat + w), (lon, lat)]
    return df.select(
        k.alias("id"), F.col("s_name").alias("name"), F.element_at(F.array(*map(F.lit, TYPES)), (k % 4 + 1).cast("int")).alias("type"), F.col("n_name").alias("district"), F.col("r_name").alias("state"),
        F.array(*[F.struct(x.alias("lon"), y.alias("lat")) for x, y in corners]).alias("ring"), (F.col("s_acctbal") > 0).alias("active"), F.when(k % 5 == 0, "manual").otherwise("survey").alias("source"),
    )


def observations(spark: SparkSession, d: str) -> DataFrame:
    """Observations: orders, of the customer's body."""
    name = F.when(F.col("o_orderstatus") == "F", "Sentinel-2A").when(F.col("o_orderstatus") == "O", "Sentinel-2B").otherwise("Sentinel-2")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("water_body_id"), F.col("o_orderdate").alias("observation_date"), name.alias("satellite"))


def analyses(spark: SparkSession, d: str) -> DataFrame:
    """Analyses: line items, of their order."""
    number = F.col("l_linenumber").cast("long") * 10**13 + F.col("l_partkey") * 10**7 + F.col("l_suppkey") * 1000 + F.floor("l_quantity")
    return table(spark, d, "lineitem").select(
        number.alias("id"), F.col("l_orderkey").alias("observation_id"), F.col("l_shipdate").alias("created_at"), (F.col("l_quantity") / 50).alias("turbidity"),
        (F.col("l_tax") * 10).alias("chlorophyll"), (F.col("l_discount") * 10).alias("anomaly_score"), (F.col("l_discount") >= 0.05).alias("anomaly_detected"),
    )


def history(spark: SparkSession, d: str) -> DataFrame:
    """History records: events of a user, with a mask status by type."""
    status = F.when(F.col("event_type") == "error", "degraded").when(F.col("event_type") == "signup", "ok_with_warning").otherwise("ok")
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").select(
        F.col("user_id").alias("water_body_id"), F.col("ts").alias("observation_date"), status.alias("mask_quality_status"), k.cast("double").alias("cloud_percentage"), (F.col("value") / 100).alias("turbidity_indicator"),
        (k / F.lit(100.0)).alias("chlorophyll_indicator"), ((F.col("value") + k) / 200).alias("algal_indicator"), (F.col("value") / 10).alias("water_area_km2"), F.col("event_id").alias("seq"),
    )


def scenes(spark: SparkSession, d: str) -> DataFrame:
    """Scene items: events, clouded by their k."""
    return table(spark, d, "events").select(F.col("event_id").alias("scene_id"), F.col("user_id").alias("body"), F.col("ts").alias("datetime"), F.get_json_object("props", "$.k").cast("double").alias("cloud"))


def targets(spark: SparkSession, d: str) -> DataFrame:
    """One date wanted of each body."""
    users = table(spark, d, "events").select("user_id").distinct()
    date = F.to_timestamp_ntz(F.lit("2024-01-10 12:00:00"))
    return users.select(F.col("user_id").alias("target_id"), F.col("user_id").alias("body"), (date + F.make_dt_interval(days=(F.col("user_id") % 10).cast("int"))).alias("target_date"))


def alerts(spark: SparkSession, d: str) -> DataFrame:
    """Alerts: error events."""
    k = F.col("event_id")
    return table(spark, d, "events").where("event_type = 'error'").select(
        k.alias("id"), F.col("user_id").alias("water_body_id"), F.when(k % 4 != 0, k % 5000).alias("analysis_id"), F.col("ts").alias("date"), F.element_at(F.array(*map(F.lit, ("turbidity", "chlorophyll", "algal"))), (k % 3 + 1).cast("int")).alias("indicator"),
        F.when(F.col("value") > 75, "CRITICAL").when(F.col("value") > 50, "Moderate").otherwise("low").alias("severity"), F.when(k % 3 == 0, "closed").otherwise("Active").alias("status"),
    )


def pixels(spark: SparkSession, d: str) -> DataFrame:
    """Pixels: each vector of 64 values is a scene of 8 by 8, its bands the values at shifted places; others are no scenes."""
    e = table(spark, d, "embeddings").where("size(embedding) = 64").select(F.col("vec_id").alias("scene_id"), "label", "embedding", F.posexplode("embedding").alias("pos", "_v"))
    at = {b: F.abs(F.get("embedding", (F.col("pos") + k) % 64).cast("double")) for k, b in enumerate(("b02", "b03", "b04", "b08", "b11"))}
    return e.select("scene_id", F.floor(F.col("pos") / 8).cast("int").alias("row"), (F.col("pos") % 8).cast("int").alias("col"), *[c.alias(b) for b, c in at.items()], ((F.col("label") + F.col("pos")) % 12).alias("scl"))


def mosaic(spark: SparkSession, d: str) -> DataFrame:
    """Pixels of mosaics: a vector of 64 values is a block of 8 by 8, wet by its first value, with single pixels turned.

    4,096 vectors in a row of ids make a scene of 64 by 64 blocks, whose middle part is the footprint.
    """
    e = table(spark, d, "embeddings").where("size(embedding) = 64 and vec_id is not null").select("vec_id", (F.col("embedding")[0] > 0).alias("wet"), F.posexplode("embedding").alias("pos", "v"))
    place = F.pmod("vec_id", F.lit(4096))
    row, col = F.floor(place / 64) * 8 + F.floor(F.col("pos") / 8), place % 64 * 8 + F.col("pos") % 8
    df = e.select(F.floor(F.col("vec_id") / 4096).alias("scene_id"), row.cast("int").alias("row"), col.cast("int").alias("col"), (F.col("wet") != (F.abs("v") > 0.3)).alias("raw"))
    return df.withColumn("expected", F.col("row").between(40, 471) & F.col("col").between(40, 471))


SQL = {
    "bodies": """bodies as (select id, name, type, district, state, active, source, lon, lat, w,
        [{'x': lon, 'y': lat}, {'x': lon + w, 'y': lat}, {'x': lon + w, 'y': lat + w}, {'x': lon, 'y': lat + w}, {'x': lon, 'y': lat}] ring from (
        select s_suppkey id, s_name name, ['Lake', 'Reservoir', 'Pond', 'Wetland'][s_suppkey % 4 + 1] type, n_name district, r_name state, s_acctbal > 0 active,
        case when s_suppkey % 5 = 0 then 'manual' else 'survey' end source, 72 + (s_suppkey * 37 % 800) / 100::double lon, 15 + (s_suppkey * 53 % 700) / 100::double lat, 0.02::double + (s_suppkey % 10) / 100::double w
        from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey))""",
    "observations": """observations as (select o_orderkey id, o_custkey water_body_id, o_orderdate observation_date,
        case o_orderstatus when 'F' then 'Sentinel-2A' when 'O' then 'Sentinel-2B' else 'Sentinel-2' end satellite from orders)""",
    "analyses": """analyses as (select l_linenumber::bigint * 10000000000000 + l_partkey * 10000000 + l_suppkey * 1000 + floor(l_quantity)::bigint id, l_orderkey observation_id, l_shipdate created_at,
        l_quantity / 50 turbidity, l_tax * 10 chlorophyll, l_discount * 10 anomaly_score, l_discount >= 0.05 anomaly_detected from lineitem)""",
    "latest": """latest as (select * from analyses qualify row_number() over (partition by observation_id order by created_at desc, id desc) = 1)""",
    "history": """history as (select *, mask_quality_status in ('ok', 'ok_with_warning') ok from (select user_id water_body_id, ts observation_date,
        case event_type when 'error' then 'degraded' when 'signup' then 'ok_with_warning' else 'ok' end mask_quality_status, k::double cloud_percentage,
        value / 100 turbidity_indicator, k / 100::double chlorophyll_indicator, (value + k) / 200 algal_indicator, value / 10 water_area_km2, event_id seq
        from (select *, json_extract(props, '$.k')::int k from events)))""",
    "scenes": "scenes as (select event_id scene_id, user_id body, ts datetime, json_extract(props, '$.k')::double cloud from events)",
    "targets": "targets as (select distinct user_id target_id, user_id body, timestamp '2024-01-10 12:00:00' + to_days((user_id % 10)::int) target_date from events)",
    "alerts": """alerts as (select event_id id, user_id water_body_id, case when event_id % 4 != 0 then event_id % 5000 end analysis_id, ts date, ['turbidity', 'chlorophyll', 'algal'][event_id % 3 + 1] indicator,
        case when value > 75 then 'CRITICAL' when value > 50 then 'Moderate' else 'low' end severity, case when event_id % 3 = 0 then 'closed' else 'Active' end status from events where event_type = 'error')""",
    "pixels": """pixels as (select vec_id scene_id, (pos // 8)::int "row", (pos % 8)::int col, abs(embedding[pos + 1]::double) b02, abs(embedding[(pos + 1) % 64 + 1]::double) b03, abs(embedding[(pos + 2) % 64 + 1]::double) b04,
        abs(embedding[(pos + 3) % 64 + 1]::double) b08, abs(embedding[(pos + 4) % 64 + 1]::double) b11, ((label + pos) % 12)::int scl from (select *, unnest(range(64))::int pos from embeddings where len(embedding) = 64))""",
    "wet": """wet as (select *, coalesce(mndwi > 0.05 and b08 < 0.18, false) or coalesce(ndwi > 0.02 and b03 > b04 and b11 < 0.15, false) or coalesce(scl = 6 and mndwi > -0.05, false) water from (
        select *, case when b03 + b11 > 1e-6 then (b03 - b11) / (b03 + b11) else -1 end mndwi, case when b03 + b08 > 1e-6 then (b03 - b08) / (b03 + b08) else -1 end ndwi from pixels))""",
}


def with_sql(*names: str) -> str:
    """A WITH clause of these relations."""
    return "with " + ",\n".join(SQL[n] for n in names) + "\n"
