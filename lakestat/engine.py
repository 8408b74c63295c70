"""One object with the computations behind a monitoring service's endpoints, for one body or for all."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geo
from .operators import baseline, dashboard, discovery, history, mutations, relational, scenes, spatial
from .session import settled

Source = DataFrame | Callable[[], DataFrame] | None


@dataclass
class Engine:
    """Relations by name, each a DataFrame: bodies, observations, analyses, alerts, records, items.

    Every method answers for all bodies in one plan; ``body`` narrows it, and the filter reaches the scan.
    """

    spark: SparkSession
    bodies: DataFrame
    observations: DataFrame
    analyses: DataFrame
    alerts: DataFrame
    records: DataFrame | None = None
    items: DataFrame | None = None
    state: str = field(default="Maharashtra")

    def health(self) -> dict[str, str]:
        """Whether the session answers, and its version."""
        row = self.spark.sql("SELECT 1 AS one").select("one", F.version().alias("version")).first()
        return {"status": "ok" if row.one == 1 else "error", "version": row.version}

    def _of(self, df: DataFrame, body, key: str = "water_body_id") -> DataFrame:
        return relational.where_given(df, **{key: body})

    def list_bodies(self, district: str = "", kind: str = "") -> DataFrame:
        return relational.where_given(self.bodies.where("active"), district=district, type=kind).orderBy("id")

    def body(self, key) -> DataFrame:
        return relational.lookup(self.bodies.where("active"), key)

    def nearby(self, lon: float, lat: float, km: float) -> DataFrame:
        """Active bodies within so many kilometres, nearest first: boxes first, then distances on the spheroid."""
        return spatial.near(self.bodies.where("active"), lon, lat, km).orderBy("distance_km", "id")

    def timeline(self, body=None, start=None, end=None) -> DataFrame:
        return history.timeline(self._of(self.observations, body), self.analyses, start, end)

    def trend(self, body=None, start=None, end=None) -> DataFrame:
        return history.trend(self._of(self.observations, body), self.analyses, start, end)

    def comparison(self, body=None, start=None, end=None) -> DataFrame:
        return history.comparison(self._of(self.observations, body), self.analyses, start, end)

    def anomaly_history(self, body=None, start=None, end=None) -> DataFrame:
        return history.anomaly_history(self._of(self.observations, body), self.analyses, start, end)

    def list_observations(self, body=None) -> DataFrame:
        return self._of(self.observations, body).orderBy(F.desc("observation_date"), F.desc("id"))

    def list_analyses(self, observation=None) -> DataFrame:
        return self._of(self.analyses, observation, "observation_id").orderBy(F.desc("created_at"), F.desc("id"))

    def analyses_of(self, body=None) -> DataFrame:
        return self._of(history.analyses_by_body(self.observations, self.analyses), body).orderBy(F.desc("created_at"), F.desc("id"))

    def latest_analysis(self, observation=None) -> DataFrame:
        return relational.latest_per_key(self._of(self.analyses, observation, "observation_id"), ["observation_id"], history.ANALYSIS_ORDER)

    def list_alerts(self, body=None, start=None, end=None, status: str = "") -> DataFrame:
        return relational.between(relational.where_given(self.alerts, water_body_id=body, status=status), "date", start, end).orderBy(F.desc("date"), F.desc("id"))

    def alert_geometries(self, features: DataFrame) -> DataFrame:
        return dashboard.alert_features(self.alerts, features)

    def baseline_status(self, body=None) -> DataFrame:
        return baseline.baseline_status(self._of(self.records, body))

    def scored_records(self, body=None) -> DataFrame:
        return baseline.anomalies(baseline.prior_baseline(self._of(self.records, body)))

    def new_alerts(self, body=None) -> DataFrame:
        return baseline.alerts(self.scored_records(body))

    def choose_scenes(self, targets: DataFrame) -> DataFrame:
        return scenes.choose(targets, self.items)

    def counts(self) -> DataFrame:
        return dashboard.counts(self.bodies, self.observations, self.analyses, self.alerts)

    def create_bodies(self, rows: DataFrame) -> DataFrame:
        """The bodies with new ones, valid rings only, active and with their area."""
        sound = rows.where(geo.valid_ring(F.col("ring"))).withColumn("area_sq_km", geo.area_km2(F.col("ring"))).withColumn("active", F.lit(True))
        return mutations.insert(self.bodies, sound, ["name"])

    def patch_bodies(self, changes: DataFrame) -> DataFrame:
        return mutations.patch(self.bodies, changes)

    def delete_bodies(self, ids: DataFrame) -> DataFrame:
        return mutations.soft_delete(self.bodies, ids)

    def discover(self, features: Source, elements: Source, source: str, limit: int = 200) -> DataFrame:
        """The bodies with those discovered in features, or in map elements where features fail in any way or have none.

        Each is a table, a function that reads one, or None. The candidates (at most ``limit``) are kept before it is
        decided, so that a source that fails late counts as failed; what both fail with last is raised.
        """
        found, failure = None, ValueError("no source is given")
        for given, candidates in ((features, discovery.from_features), (elements, discovery.from_elements)):
            if given is None:
                continue
            try:
                found = settled(candidates(given() if callable(given) else given, limit))
            except Exception as e:  # noqa: BLE001  a source may fail in any way
                failure = e
                continue
            if not found.isEmpty():
                break
        if found is None:
            raise failure
        return mutations.upsert_bodies(self.bodies, found, source, self.state)

    def analyze(self, results: DataFrame) -> dict[str, DataFrame]:
        """Observations, analyses and alerts with the results of a satellite analysis of active bodies.

        Every table builds on the one before: an observation is found by body and scene or made, an analysis is
        appended to it, and an alert where the anomaly reaches a band.
        """
        known = results.join(self.bodies.where("active").select(F.col("id").alias("water_body_id")), "water_body_id", "left_semi")
        observations = mutations.upsert_observations(self.observations, known)
        placed = mutations.placed_results(self.analyses, observations, known)
        return {"observations": observations, "analyses": mutations.appended_analyses(self.analyses, placed), "alerts": mutations.appended_alerts(self.alerts, placed)}

    def snapshots(self, body=None, start=None, end=None) -> DataFrame:
        return history.snapshots(self._of(self.observations, body), self.analyses, start, end)
