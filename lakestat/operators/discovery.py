"""Candidate water bodies from map elements and feature collections, ranked and without duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from .relational import first_per_key

LEAST_KM2, LEAST_DEG2, LIMITS = 0.001, 1e-7, (1, 200)
# Names under which attributes are looked for, and values that mean nothing.
FIELDS = {
    "name": ("name", "waterbody_name", "waterbodyname", "wb_name", "wbname", "lake_name", "reservoir_name", "local_name"),
    "district": ("district", "district_name", "districtname", "dist_name", "distname"),
    "type": ("type", "waterbody_type", "waterbodytype", "category", "class"),
}
BLANKS = ("nan", "none", "null")


def field_key(name: str) -> str:
    """A column's name in lower case without anything but letters and digits."""
    return "".join(c for c in name.lower() if c.isalnum())


def first_value(df: DataFrame, field: str) -> Column:
    """The first column, in the table's order, of one of the field's names that has a meaningful value."""
    wanted = {field_key(n) for n in FIELDS[field]}
    values = [F.trim(F.col(f"`{c}`").cast("string")) for c in df.columns if field_key(c) in wanted]
    return F.coalesce(*[F.when((v != "") & ~F.lower(v).isin(*BLANKS), v) for v in values]) if values else F.lit(None).cast("string")


def water_type(water: Column, natural: Column, landuse: Column) -> Column:
    """Reservoir, Pond, Lake or Water body, by the element's tags."""
    w, n, u = F.lower(water), F.lower(natural), F.lower(landuse)
    return F.when((w == "reservoir") | (u == "reservoir"), "Reservoir").when(w == "pond", "Pond").when((w == "lake") | (n == "water"), "Lake").otherwise("Water body")


def district(tags: Column) -> Column:
    """The first district that is given, 100 characters at most."""
    return F.substring(F.coalesce(*[F.nullif(tags[k], F.lit("")) for k in ("addr:district", "district", "is_in:district")]), 1, 100)


def limited(limit: int) -> int:
    """The limit within bounds."""
    return max(LIMITS[0], min(LIMITS[1], limit))


def from_elements(elements: DataFrame, limit: int) -> DataFrame:
    """Candidates from elements (pos, type, tags map, ring): named, large enough, first of equal ones, largest first."""
    name = F.trim(F.col("tags")["name"])
    df = elements.where(F.col("type").isin("way", "relation") & F.coalesce(name != "", F.lit(False)) & geo.valid_ring(F.col("ring"), False))
    df = df.select("pos", name.alias("full_name"), water_type(F.col("tags")["water"], F.col("tags")["natural"], F.col("tags")["landuse"]).alias("type"), district(F.col("tags")).alias("district"), "ring", geo.area_deg2(F.col("ring")).alias("area_deg2"))
    df = first_per_key(df.where(F.col("area_deg2") > LEAST_DEG2), [F.lower("full_name"), F.lower("district"), "type"], ["pos"])
    return df.select("pos", F.substring("full_name", 1, 200).alias("name"), "type", "district", "ring", "area_deg2").orderBy(F.desc("area_deg2"), "pos").limit(limited(limit))


def from_features(features: DataFrame, limit: int, label: str = "Waterbody") -> DataFrame:
    """Candidates from features (pos, ring and attribute columns under any of FIELDS): named ones first, largest first."""
    df = features.withColumn("area_sq_km", geo.area_km2(F.col("ring"))).where(F.col("area_sq_km") >= LEAST_KM2)
    given = first_value(features, "name")
    df = df.select(
        "pos", F.coalesce(F.substring(given, 1, 200), F.concat(F.lit(f"{label} "), (F.col("pos") + 1).cast("string"))).alias("name"), given.isNull().alias("unnamed"),
        F.coalesce(F.substring(first_value(features, "type"), 1, 100), F.lit("Water body")).alias("type"), F.substring(first_value(features, "district"), 1, 100).alias("district"), "ring", "area_sq_km",
    )
    return df.orderBy("unnamed", F.desc("area_sq_km"), "pos").limit(limited(limit))


def stitched(lines: list[list[tuple[float, float]]]) -> list[list[tuple[float, float]]]:
    """Closed rings from lines that share end points; lines that close nothing are left out."""
    rings, rest = [], [list(x) for x in lines if len(x) > 1]
    while rest:
        ring = rest.pop(0)
        while ring[0] != ring[-1]:
            k = next((k for k, x in enumerate(rest) if ring[-1] in (x[0], x[-1])), None)
            if k is None:
                break
            line = rest.pop(k)
            ring += line[1:] if line[0] == ring[-1] else line[-2::-1]
        if len(ring) >= 4 and ring[0] == ring[-1]:
            rings.append(ring)
    return rings


def relation_rings(members: DataFrame) -> DataFrame:
    """(element_id, ring): the largest ring that the outer lines of each relation close.

    ``members``: element_id, role, line (array of lon, lat). A relation has few lines, so it is one small group.
    """
    import pandas as pd

    def run(part: pd.DataFrame) -> pd.DataFrame:
        rings = stitched([[(p["lon"], p["lat"]) for p in line] for line in part.sort_values("pos")["line"]])
        rows = [{"element_id": part["element_id"].iloc[0], "part": k, "ring": [{"lon": x, "lat": y} for x, y in r]} for k, r in enumerate(rings)]
        return pd.DataFrame(rows, columns=["element_id", "part", "ring"])

    outer = members.where(F.coalesce("role", F.lit("")).isin("outer", "") & (F.size("line") >= 2))
    rings = outer.groupBy("element_id").applyInPandas(run, "element_id long, part int, ring array<struct<lon:double,lat:double>>")
    best = rings.withColumn("area", geo.area_deg2(F.col("ring"))).groupBy("element_id").agg(F.max_by("ring", F.struct("area", -F.col("part"))).alias("ring"))
    return best
