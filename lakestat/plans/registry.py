"""Every query of the library with its DuckDB counterpart. Doubles are rounded to 9 places where both engines sum."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..functions import geo, scalar, text
from ..operators import baseline, dashboard, discovery, history, ml, mutations, raster, relational, scenes, spatial, spectral, tiles
from ..sources.readers import table
from . import model as m

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with the SQL for the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles rounded."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_OA = m.with_sql("observations", "analyses", "latest")
_TIMELINE = """select o.water_body_id, o.id observation_id, o.observation_date, o.satellite, a.id analysis_id, a.turbidity, a.chlorophyll, a.anomaly_score,
    case when a.id is not null then coalesce(a.anomaly_detected, false) end anomaly_detected from observations o left join latest a on a.observation_id = o.id"""


# Histories.
@query(_OA + f"select water_body_id, count(*) observations, count(analysis_id) analysed, count(*) filter (where anomaly_detected) anomalies, min(turbidity) min_turbidity, max(turbidity) max_turbidity, min(chlorophyll) min_chlorophyll, max(chlorophyll) max_chlorophyll, min(anomaly_score) min_anomaly_score, max(anomaly_score) max_anomaly_score from ({_TIMELINE}) group by water_body_id")
def trend_summary(s, d):
    return history.trend(m.observations(s, d), m.analyses(s, d))


@query(_OA + _TIMELINE)
def timeline(s, d):
    return history.timeline(m.observations(s, d), m.analyses(s, d))


@query(_OA + f"select water_body_id, row_number() over (partition by water_body_id order by observation_date, observation_id) - 1 place, observation_id, analysis_id, turbidity from ({_TIMELINE})")
def trend_series(s, d):
    df = history.trend_series(m.observations(s, d), m.analyses(s, d)).select("water_body_id", F.posexplode("points").alias("place", "p"))
    return df.select("water_body_id", F.col("place").cast("long").alias("place"), "p.observation_id", "p.analysis_id", "p.turbidity")


_COMPARED = """, both_ends as (select water_body_id, count(*) n, arg_min(p, k) e, arg_max(p, k) l from (select o.water_body_id, {'id': o.id, 't': turbidity, 'c': chlorophyll, 's': anomaly_score} p, {'d': o.observation_date, 'i': o.id} k from observations o join latest a on a.observation_id = o.id) group by 1)
select water_body_id, n analysed, n >= 2 available, case when n >= 2 then e.id end earlier_id, case when n >= 2 then l.id end latest_id, case when n >= 2 then l.t - e.t end change_turbidity, case when n >= 2 then l.c - e.c end change_chlorophyll, case when n >= 2 then l.s - e.s end change_anomaly_score from both_ends"""


@query(_OA.rstrip() + _COMPARED)
def comparison(s, d):
    return history.comparison(m.observations(s, d), m.analyses(s, d))


@query(_OA + "select o.water_body_id, o.id observation_id, o.observation_date, a.id analysis_id, a.anomaly_score, count(*) over (partition by o.water_body_id) anomalies from observations o join latest a on a.observation_id = o.id where a.anomaly_detected")
def anomaly_history(s, d):
    return history.anomaly_history(m.observations(s, d), m.analyses(s, d))


@query(_OA + "select observation_id, id, created_at, turbidity, anomaly_detected from latest")
def latest_analysis(s, d):
    return relational.latest_per_key(m.analyses(s, d), ["observation_id"], ["created_at", "id"]).select("observation_id", "id", "created_at", "turbidity", "anomaly_detected")


@query(_OA + "select o.water_body_id, a.id, a.observation_id, a.created_at, a.turbidity from analyses a join observations o on a.observation_id = o.id where o.observation_date >= timestamp '1995-01-01' and o.observation_date <= timestamp '1996-12-31'")
def analyses_by_body(s, d):
    o = relational.between(m.observations(s, d), "observation_date", "1995-01-01", "1996-12-31")
    return history.analyses_by_body(o, m.analyses(s, d)).select("water_body_id", "id", "observation_id", "created_at", "turbidity")


@query(_OA + "select id, water_body_id from observations o where not exists (select 1 from analyses a where a.observation_id = o.id)")
def observations_without_analysis(s, d):
    o, a = m.observations(s, d), m.analyses(s, d)
    return relational.without_match(o, a, o.id == a.observation_id).select("id", "water_body_id")


@query(m.with_sql("observations", "analyses", "alerts", "bodies") + """select * from (select al.id, case when b.id is null then 'no_body' when al.analysis_id is not null and a.id is null then 'no_analysis' when a.id is not null and o.id is null then 'no_observation' when o.id is not null and o.water_body_id != al.water_body_id then 'other_body' end error
    from alerts al left join bodies b on b.id = al.water_body_id left join (select id, id observation_id from observations) a on a.id = al.analysis_id left join observations o on o.id = a.observation_id) where error is not null""")
def reference_violations(s, d):
    o = m.observations(s, d)
    return relational.violations(m.alerts(s, d), o.select("id", F.col("id").alias("observation_id")), o, m.bodies(s, d))


# Listings, search and dashboard.
@query(m.with_sql("bodies") + "select id, name, type, district, state from bodies where active and type = 'Lake'")
def body_listing(s, d):
    return relational.where_given(m.bodies(s, d).where("active"), type="Lake", district="").select("id", "name", "type", "district", "state").orderBy("id")


@query(m.with_sql("observations") + "select id, water_body_id, observation_date from observations where water_body_id = 7")
def observation_listing(s, d):
    return relational.where_given(m.observations(s, d), water_body_id=7).select("id", "water_body_id", "observation_date").orderBy(F.desc("observation_date"), F.desc("id"))


@query(m.with_sql("alerts") + "select id, water_body_id, date, severity from alerts where date >= timestamp '2024-01-05' and date <= timestamp '2024-01-20' and status = 'Active'")
def alert_listing(s, d):
    return relational.where_given(relational.between(m.alerts(s, d), "date", "2024-01-05", "2024-01-20"), status="Active").select("id", "water_body_id", "date", "severity").orderBy(F.desc("date"), F.desc("id"))


@query(m.with_sql("bodies") + "select id, name from bodies where id = 5")
def body_lookup(s, d):
    return relational.lookup(m.bodies(s, d), 5).select("id", "name")


@query(m.with_sql("bodies", "observations", "analyses", "alerts") + "select (select count(*) from bodies where active) bodies, (select count(*) from observations) observations, (select count(*) from analyses) analyses, (select count(*) from alerts where lower(status) = 'active') open_alerts")
def dashboard_counts(s, d):
    return dashboard.counts(m.bodies(s, d), m.observations(s, d), m.analyses(s, d), m.alerts(s, d))


@query(m.with_sql("bodies") + "select distinct district from bodies where district is not null")
def district_list(s, d):
    return dashboard.pick_list(m.bodies(s, d), "district")


@query(m.with_sql("bodies") + "select id, name from bodies where contains(lower(name), 'an') or contains(lower(district), 'an') or contains(lower(type), 'an')")
def body_search(s, d):
    return dashboard.search(m.bodies(s, d), "AN").select("id", "name")


@query(m.with_sql("bodies", "alerts") + "select id, exists (select 1 from alerts a where lower(a.status) = 'active' and a.water_body_id = b.id) has_open_alert from bodies b")
def open_alert_flags(s, d):
    return dashboard.with_open_alert(m.bodies(s, d), m.alerts(s, d)).select("id", "has_open_alert")


@query(m.with_sql("bodies", "alerts") + "select a.id, coalesce(b.name, '#' || a.water_body_id) body_name, case when lower(severity) like '%critical%' or lower(severity) like '%high%' then 'high' when lower(severity) like '%medium%' or lower(severity) like '%moderate%' then 'medium' when lower(severity) like '%low%' then 'low' else 'none' end severity_class from alerts a left join bodies b on b.id = a.water_body_id")
def named_alerts(s, d):
    return dashboard.with_body_name(m.alerts(s, d), m.bodies(s, d)).select("id", "body_name", dashboard.severity_class(F.col("severity")).alias("severity_class"))


@query(m.with_sql("alerts") + ", newest as (select water_body_id, arg_max(analysis_id, {'d': date, 'i': id}) analysis_id from alerts where analysis_id is not null group by 1) select water_body_id, id from (select a.*, coalesce(a.analysis_id = n.analysis_id, false) tied from alerts a left join newest n using (water_body_id) where lower(status) = 'active') qualify row_number() over (partition by water_body_id order by tied desc, date desc, id desc) = 1")
def chosen_alerts(s, d):
    a = m.alerts(s, d)
    newest = a.where("analysis_id is not null").groupBy("water_body_id").agg(F.max_by("analysis_id", F.struct("date", "id")).alias("analysis_id"))
    return dashboard.chosen_alert(a, newest).select("water_body_id", "id")


@query(m.with_sql("alerts") + "select id, date from alerts order by date desc, id desc limit 5")
def recent_alerts(s, d):
    return dashboard.top(m.alerts(s, d), "date", 5).select("id", "date")


@query(m.with_sql("bodies") + "select bool_or(lower(source) != 'manual') has_import from bodies")
def has_import(s, d):
    return dashboard.has_import(m.bodies(s, d))


@query("select c_custkey id, printf('%.2f', round(c_acctbal, 2)) fixed, case when c_acctbal > 0 then '+' else '' end || printf('%.2f', round(c_acctbal, 2)) signed, strftime(timestamp '2024-01-01' + to_days((c_custkey % 300)::int), '%d %b %Y %H:%M') shown from customer")
def formatted_values(s, d):
    date = F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(days=(F.col("c_custkey") % 300).cast("int"))
    return table(s, d, "customer").select(F.col("c_custkey").alias("id"), dashboard.fixed(F.col("c_acctbal")).alias("fixed"), dashboard.signed(F.col("c_acctbal"), 2).alias("signed"), F.date_format(date, "dd MMM yyyy HH:mm").alias("shown"))


@query(m.with_sql("alerts", "bodies") + """select id::varchar feature_id, id alert_id, 4 n_properties, water_body_id::varchar body, indicator, null::varchar part from alerts where lower(status) = 'active' and id % 7 = 0
    union all select id || '-' || n, id, 5, water_body_id::varchar, case n when 0 then 'a' else 'c' end, case n when 0 then 'a' else 'c' end from alerts, (select unnest([0, 2]) n) where lower(status) = 'active' and id % 7 != 0 and analysis_id in (select id from bodies where id % 3 != 0)""")
def alert_features(s, d):
    b = m.bodies(s, d)
    part = lambda r, p: F.struct(r.alias("ring"), F.create_map(F.lit("part"), F.lit(p), F.lit("indicator"), F.lit(p)).alias("properties"))
    parts = F.array(part(F.col("ring"), "a"), part(F.when(F.lit(False), F.col("ring")), "b"), part(F.col("ring"), "c"))
    analyses = b.where("id % 3 != 0").select("id", parts.alias("features"))
    square = F.array(*[F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0))])
    found = dashboard.alert_features(m.alerts(s, d).withColumn("ring", F.when(F.col("id") % 7 == 0, square)), analyses)
    p = F.col("properties")
    return found.select("feature_id", "alert_id", F.size(F.map_keys(p)).alias("n_properties"), p["water_body_id"].alias("body"), p["indicator"].alias("indicator"), p["part"].alias("part"))


@query(m.with_sql("analyses").rstrip() + """, listed as (select observation_id, id, row_number() over (partition by observation_id order by created_at desc, id desc) - 1 place from analyses)
    select observation_id, id from listed where place = case when observation_id % 2 = 0 and (observation_id, 1) in (select (observation_id, place) from listed) then 1 else 0 end""")
def shown_analyses(s, d):
    from pyspark.sql import Window as W

    at = F.row_number().over(W.partitionBy("observation_id").orderBy(F.desc("created_at"), F.desc("id"))) - 1
    listed = m.analyses(s, d).select("observation_id", "id", at.alias("place"))
    marked = listed.where("observation_id % 2 = 0 and place = 1")
    return dashboard.first_of(listed, marked, "observation_id").select("observation_id", "id")


@query(m.with_sql("bodies") + """select id, 'WB_DB_' || id code, replace(replace(name || '/' || type || '\\x', '/', '_'), '\\', '_') file_name, case when id % 3 != 0 then timestamp '2024-01-01 00:00:00' + to_days((id % 28)::int) end first_second,
    case when id % 3 != 0 then timestamp '2024-01-01 23:59:59' + to_days((id % 28)::int) end last_second, timestamp '2024-05-18 05:26:49' + to_hours(case id % 3 when 1 then -2 else 0 end) instant from bodies""")
def codes_and_days(s, d):
    k = F.col("id")
    day = F.when(k % 3 == 0, " ").otherwise(F.date_format(F.date_add(F.lit("2024-01-01"), (k % 28).cast("int")), "yyyy-MM-dd"))
    shown = F.when(k % 3 == 0, "2024-05-18T05:26:49Z").when(k % 3 == 1, "2024-05-18T05:26:49+02:00").otherwise("2024-05-18T05:26:49")
    utc = F.timestamp_micros(F.unix_micros(text.utc(shown)))
    return m.bodies(s, d).select(
        "id", text.body_code(k).alias("code"), text.safe_name(F.concat("name", F.lit("/"), "type", F.lit("\\x"))).alias("file_name"), text.day_start(day).alias("first_second"), text.day_end(day).alias("last_second"),
        F.convert_timezone(F.current_timezone(), F.lit("UTC"), utc.cast("timestamp_ntz")).alias("instant"),
    )


# Baselines and anomalies.
_NAMES = {"turbidity": "turbidity_indicator", "chlorophyll": "chlorophyll_indicator", "algal": "algal_indicator", "area": "water_area_km2"}


def _stat_sql(x: str, over: str = "") -> dict[str, str]:
    q = lambda p: f"quantile_cont({x}, {p}){over}"
    return {"mean": f"avg({x}){over}", "std": f"stddev_pop({x}){over}", "median": q(0.5), "min": f"min({x}){over}", "max": f"max({x}){over}", "p10": q(0.1), "p25": q(0.25), "p75": q(0.75), "p90": q(0.9)}


_WHOLE = ", ".join(f"case when n >= 3 then round({v}, 12) end {k}_{n}" for k in _NAMES for n, v in {s: f"{k}_{s}_raw" for s in baseline.KEYS}.items())
_WHOLE_RAW = ", ".join(f"{v} {k}_{n}_raw" for k, c in _NAMES.items() for n, v in _stat_sql(c).items())


@query(m.with_sql("history") + f"select b.water_body_id, case when coalesce(n, 0) >= 3 then 'valid' else 'insufficient_baseline' end status, coalesce(n, 0) observation_count, first_date, last_date, {_WHOLE} from (select distinct water_body_id from history) b left join (select water_body_id, count(*) n, min(observation_date) first_date, max(observation_date) last_date, {_WHOLE_RAW} from history where ok group by 1) using (water_body_id)")
def baseline_statistics(s, d):
    df = baseline.whole_baseline(m.history(s, d), 12)
    return df.select("water_body_id", "status", "observation_count", "first_date", "last_date", *[F.col(k)[n].alias(f"{k}_{n}") for k in _NAMES for n in baseline.KEYS])


@query(m.with_sql("history") + "select water_body_id, count(*) total, count(*) filter (where ok) eligible, count(*) filter (where not ok) excluded, greatest(0, 3 - count(*) filter (where ok)) remaining from history group by 1")
def baseline_status(s, d):
    return baseline.baseline_status(m.history(s, d))


_PRIOR_OVER = " over (partition by water_body_id order by observation_date range between unbounded preceding and interval 1 microsecond preceding)"
_PRIOR = (
    m.with_sql("history").rstrip()
    + ", prior as (select *, count(case when ok then 1 end)"
    + _PRIOR_OVER
    + " prior_count, "
    + ", ".join(f"round({v}, 11) {k}_{n}" for k, c in _NAMES.items() for n, v in _stat_sql(f"(case when ok then {c} end)", _PRIOR_OVER).items() if n in ("mean", "std", "median", "p90"))
    + " from history)"
)


@query(_PRIOR + " select water_body_id, seq, prior_count, " + ", ".join(f"case when prior_count >= 3 then {k}_{n} end {k}_{n}" for k in _NAMES for n in ("mean", "std", "median", "p90")) + " from prior")
def prior_baseline(s, d):
    df = baseline.prior_baseline(m.history(s, d), 11, ("mean", "std", "median", "p90"))
    return df.select("water_body_id", "seq", "prior_count", *[F.col(f"{k}_prior")[n].alias(f"{k}_{n}") for k in _NAMES for n in ("mean", "std", "median", "p90")])


def _scored_sql(digits: int | None, score_digits: int | None) -> str:
    """The scores in SQL: statistics rounded to ``digits``, scores to ``score_digits``, None for not at all."""
    r = lambda x, n: x if n is None else f"round({x}, {n})"
    stats = ", ".join(f"{r(v, digits)} {k}_{n}" for k, c in _NAMES.items() for n, v in _stat_sql(f"(case when ok then {c} end)", _PRIOR_OVER).items() if n in ("mean", "std"))
    sql = m.with_sql("history").rstrip() + f", prior as (select *, count(case when ok then 1 end){_PRIOR_OVER} prior_count, {stats} from history)"
    sql += ", z as (select *, " + ", ".join(f"{v} {k}_z" for k, v in _Z.items()) + " from prior), sc as (select *, "
    sql += ", ".join(r(f"least(1, greatest(0, 1 - 1 / (1 + ({k}_z / 1.5) * ({k}_z / 1.5)))) + ({k}_z * 0)", score_digits) + f" {k}_score" for k in _NAMES) + " from z), "
    whole = r("least(1, greatest(0, 0.3::double * turbidity_score + 0.3::double * chlorophyll_score + 0.25::double * algal_score + 0.15::double * area_score))", score_digits)
    sql += f"an as (select *, case when prior_count >= 3 then {whole} else 0 end anomaly_score from sc), "
    return sql + "lv as (select *, case when anomaly_score < 0.25 then 'NONE' when anomaly_score < 0.5 then 'LOW' when anomaly_score < 0.75 then 'MEDIUM' else 'HIGH' end anomaly_level from an)"


_Z = {k: f"case when prior_count >= 3 then case when {k}_std < 1e-8 then case when abs({c} - {k}_mean) >= 1e-6 then 3.0 else 0.0 end else abs({c} - {k}_mean) / {k}_std end end" for k, c in _NAMES.items()}
_SCORED = _scored_sql(None, None)
#: Where the default roundings are checked, values are scaled so that none lies halfway between two roundings, where engines differ.
_SCALE = 1.4142135623730951


def _scaled_sql_of(scores: str) -> str:
    scaled = ", ".join(f"{c} * {_SCALE}::double as {c}" for c in _NAMES.values())
    return scores.replace("with history as (", "with plain as (", 1).replace(", prior as (", f", history as (select * replace ({scaled}) from plain), prior as (", 1)


_ROUNDED, _EXPLAINED = _scaled_sql_of(_scored_sql(6, 4)), _scaled_sql_of(_SCORED)


def _scaled(s: SparkSession, d: str) -> DataFrame:
    return m.history(s, d).withColumns({c: F.col(c) * _SCALE for c in _NAMES.values()})


_CODES = [f"case when {k}_z >= 1.5 then case when {c} > {k}_mean then '{baseline._codes(k)[0]}' else '{baseline._codes(k)[1]}' end end" for k, c in _NAMES.items()]
_CODES += [f"case when {a}_score > 0.5 and {b}_score > 0.5 and {_NAMES[a]} > {a}_mean and {_NAMES[b]} > {b}_mean then 'COMPOUND_ANOMALY' end" for a, b in (("turbidity", "chlorophyll"), ("chlorophyll", "algal"))]


@query(_SCORED + f" select water_body_id, seq, {', '.join(f'round({k}_score, 9) {k}_score' for k in _NAMES)}, round(anomaly_score, 9) anomaly_score, anomaly_level, array_to_string(list_filter([{', '.join(_CODES)}], lambda x: x is not null), ',') codes from lv")
def anomaly_scores(s, d):
    df = rounded(baseline.anomalies(baseline.prior_baseline(m.history(s, d), None), None))
    return df.select("water_body_id", "seq", *[f"{k}_score" for k in _NAMES], "anomaly_score", "anomaly_level", F.array_join("codes", ",").alias("codes"))


@query(_SCORED + """ select water_body_id, observation_date, case when turbidity_score >= chlorophyll_score and turbidity_score >= algal_score then 'turbidity' when chlorophyll_score >= algal_score then 'chlorophyll' else 'algal' end indicator, lower(anomaly_level) severity, round(anomaly_score, 9) anomaly_score,
    round(least(1, greatest(0, 1 - cloud_percentage / 100)), 9) quality_score, 'active' status from lv where anomaly_level != 'NONE' and anomaly_score >= 0.25""")
def raised_alerts(s, d):
    found = baseline.alerts(baseline.anomalies(baseline.prior_baseline(m.history(s, d), None), None))
    return rounded(found.drop("affected_area_km2"))


@query(_ROUNDED + f" select water_body_id, seq, {', '.join(f'{k}_score' for k in _NAMES)} from lv")
def rounded_scores(s, d):
    """Scores with the default roundings: statistics to 6 places before the z-score, scores to 4.

    Their weighted sum is left out: of scores of 4 places it lies halfway between two roundings as a rule.
    """
    df = baseline.anomalies(baseline.prior_baseline(_scaled(s, d)))
    return df.select("water_body_id", "seq", *[f"{k}_score" for k in _NAMES])


def _message_sql(k: str, c: str, code: str) -> str:
    return f"printf('{baseline.MESSAGES[code]}', {c}, {k}_z, {k}_mean)"


_TEXTS = [f"case when {k}_z >= 1.5 then case when {c} > {k}_mean then {_message_sql(k, c, baseline._codes(k)[0])} else {_message_sql(k, c, baseline._codes(k)[1])} end end" for k, c in _NAMES.items()]
_TEXTS += [f"case when {a}_score > 0.5 and {b}_score > 0.5 and {_NAMES[a]} > {a}_mean and {_NAMES[b]} > {b}_mean then '{t}' end" for (a, b), t in baseline._COMPOUND.items()]


@query(_EXPLAINED + f", told as (select *, list_filter([{', '.join(_TEXTS)}], lambda x: x is not null) texts from lv where prior_count >= 3) select water_body_id, seq, array_to_string(texts, ' | ') explanation from told where len(texts) > 0")
def explanations(s, d):
    df = baseline.anomalies(baseline.prior_baseline(_scaled(s, d), None), None)
    return df.where(F.size("explanation") > 0).select("water_body_id", "seq", F.array_join("explanation", " | ").alias("explanation"))


# Spectral layers and masks.
_RAW = {
    "ndti": "r(b04 - b03, b04 + b03)", "red_green": "r(b04, b03)", "red": "b04", "ndci": "r(b08 - b04, b08 + b04)", "green_blue": "r(b03, b02)", "nir_red": "r(b08 - b04, b08 + b04)",
    "fai": "b08 - (b04 + (b11 - b04) * ((842.0::double - 665) / (1610.0::double - 665)))", "nir": "b08", "mndwi_inverted": "-r(b03 - b11, b03 + b11)",
}


def _ratio_sql(x: str) -> str:
    if "r(" not in x:
        return x
    a, b = x[x.index("r(") + 2 : -1].split(", ")
    return f"{'-' * x.startswith('-')}(case when abs({b}) > 1e-8 then ({a}) / ({b}) end)"


def _scaled_sql(k: str) -> str:
    low, high = scalar.RANGES[k]
    return f"case when {k} is not null then least(1, greatest(0, ({k} - ({low}::double)) / ({high}::double - ({low}::double)))) end"


_LAYERS = m.with_sql("pixels", "wet").rstrip() + ", raw as (select scene_id, \"row\", col, scl, mndwi, b08, " + ", ".join(f"{_ratio_sql(x)} {k}" for k, x in _RAW.items()) + " from wet where water), scaled as (select *, " + ", ".join(f"{_scaled_sql(k)} {k}_scaled" for k in _RAW) + " from raw), "
_LAYERS += "layers as (select *, " + ", ".join(" + ".join(f"{w}::double * {k}_scaled" for k, w in parts.items()) + f" {name}_composite" for name, parts in scalar.COMPOSITES.items()) + " from scaled)"
_LAYER_NAMES = spectral.layer_names()


def _layer_stats_sql(k: str) -> str:
    v = {"mean": f"avg({k})", "median": f"quantile_cont({k}, 0.5)", "std": f"stddev_pop({k})", "min": f"min({k})", "max": f"max({k})", "p10": f"quantile_cont({k}, 0.1)", "p90": f"quantile_cont({k}, 0.9)"}
    return ", ".join([*(f"round({x}, 9) {k}_{n}" for n, x in v.items()), f"count({k}) {k}_valid"])


def wet_pixels(s: SparkSession, d: str) -> DataFrame:
    """Pixels with the water rule's verdict as ``water``."""
    return raster.raw_water(m.pixels(s, d)).withColumnRenamed("raw", "water")


@query(_LAYERS + f" select s.scene_id, l.* exclude (scene_id) replace ({', '.join(f'coalesce({k}_valid, 0) as {k}_valid' for k in _LAYER_NAMES)}) from (select distinct scene_id from pixels) s left join (select scene_id, {', '.join(map(_layer_stats_sql, _LAYER_NAMES))} from layers group by 1) l using (scene_id)")
def spectral_statistics(s, d):
    return spectral.masked_stats(wet_pixels(s, d), 9)


@query(_LAYERS + " select s.scene_id, round(least(1, greatest(0, turbidity)) + turbidity * 0, 9) turbidity, round(least(1, greatest(0, chlorophyll)) + chlorophyll * 0, 9) chlorophyll, round(least(1, greatest(0, algal)) + algal * 0, 9) algal from (select distinct scene_id from pixels) s left join (select scene_id, avg(turbidity_composite) turbidity, avg(chlorophyll_composite) chlorophyll, avg(algal_composite) algal from layers group by 1) using (scene_id)")
def spectral_indicators(s, d):
    return spectral.indicators(wet_pixels(s, d), 9)


@query(m.with_sql("pixels", "wet") + "select scene_id, count(*) total_pixels, count(*) filter (where water) water_pixels, round(count(*) filter (where water) / count(*)::double * 100, 9) water_pct, round(count(*) filter (where water) * 1e-4, 9) water_area_km2, count(*) filter (where scl in (3, 8, 9, 10)) cloudy_pixels from wet group by 1")
def water_summary(s, d):
    return rounded(spectral.water_summary(wet_pixels(s, d)))


@query(m.with_sql("pixels", "wet") + 'select scene_id, "row", col, water, round(case when water then least(1, greatest(0, 0.6::double * least(1, greatest(0, (mndwi + 0.2::double) / 0.8::double)) + 0.4::double * least(1, greatest(0, 1 - b08 / 0.25::double)) + case when scl = 6 then 0.2::double else 0 end)) else 0 end, 9) confidence from wet')
def water_pixels(s, d):
    df = wet_pixels(s, d)
    return df.select("scene_id", "row", "col", "water", F.round(scalar.water_confidence(F.col("b03"), F.col("b08"), F.col("b11"), F.col("scl"), F.col("water")), 9).alias("confidence"))


@query("select p_partkey id, case when dn > 0 then least(1, greatest(0, (dn - case when o then 1000 else 0 end) / 10000::double)) end reflectance, o has_offset from (select p_partkey, (p_retailprice * 3)::int - 3000 dn, case when p_partkey % 3 = 0 then p_partkey % 2 = 1 when p_partkey % 3 = 1 then p_size >= 4 else p_partkey % 2 = 0 end o from (select *, 0 from part))")
def calibrated(s, d):
    k = F.col("p_partkey")
    base = F.when(k % 3 == 0, F.when(k % 2 == 1, "04.00").otherwise("03.01")).when(k % 3 == 1, F.format_string("%d.0", F.col("p_size")))
    date = F.when(k % 2 == 0, "2022-01-25").otherwise("2022-01-24")
    df = table(s, d, "part").select(k.alias("id"), ((F.col("p_retailprice") * 3).cast("decimal(20,6)").cast("double")).alias("x"), scalar.has_offset(base, date).alias("has_offset"))
    df = df.withColumn("dn", F.rint("x").cast("int") - 3000)
    return df.select("id", scalar.reflectance(F.col("dn"), F.col("has_offset")).alias("reflectance"), "has_offset")


def _with_prior(s: SparkSession, d: str) -> DataFrame:
    prior = (F.col("row").between(1, 6) & F.col("col").between(1, 6)).alias("expected")
    return m.pixels(s, d).select("*", prior)


def _reach_sql(name: str, pixels: str, corners: bool = False) -> str:
    """Components of the pixels of a relation: (scene_id, "row", col, root), by following neighbours from every pixel."""
    near = "greatest(abs(n.\"row\" - r.r), abs(n.col - r.c)) = 1" if corners else "abs(n.\"row\" - r.r) + abs(n.col - r.c) = 1"
    return f"""{name}_reach as (select scene_id, "row", col, "row" r, col c from {pixels} union select r.scene_id, r."row", r.col, n."row", n.col from {name}_reach r join {pixels} n on n.scene_id = r.scene_id and {near}),
    {name} as (select scene_id, "row", col, min(r * 1000 + c) root from {name}_reach group by 1, 2, 3)"""


def _recursive(sql: str) -> str:
    return sql.replace("with ", "with recursive ", 1)


_WATER = _recursive(m.with_sql("pixels", "wet").rstrip() + ", water as (select * from wet where water), ")


_COMPONENTS = _WATER + _reach_sql("comp", "water") + """, each as (select scene_id, root, count(*) n from comp group by 1, 2)
    select scene_id, count(*) components, sum(n)::bigint water_pixels, max(n) largest_pixels, round(max(n) / sum(n)::double, 9) largest_ratio, round(1 - max(n) / sum(n)::double, 9) fragmentation from each group by 1"""


@query(_COMPONENTS)
def components(s, d):
    return rounded(raster.component_summary(raster.with_components(wet_pixels(s, d))))


@query(_COMPONENTS)
def tiled_components(s, d):
    """Components tied over the borders of tiles of 4 by 4, four to a scene."""
    return rounded(raster.component_summary(tiles.with_components(wet_pixels(s, d), tile=4)))


@query(_WATER + _reach_sql("comp", "water", True) + """, each as (select scene_id, root, count(*) n from comp group by 1, 2 having count(*) * 100 > 2000), total as (select scene_id, count(*) polygons from each group by 1)
    select scene_id, polygons is not null detected, coalesce(polygons, 0)::int polygons from (select distinct scene_id from pixels) left join total using (scene_id)""")
def boundary_polygons(s, d):
    df = raster.boundaries(wet_pixels(s, d), 500000.0, 2000000.0, 10.0, 43)
    return df.select("scene_id", "detected", F.size("polygons").alias("polygons"))


# Cleaning in SQL, for scenes of 8 by 8: their footprint holds all that a closing can leave, and they are too small for more.
_CLEAN = _recursive(m.with_sql("pixels", "wet").rstrip()) + ", raw as (select * from wet where water), " + _reach_sql("c0", "raw")
_CLEAN += """, large as (select c0.* from c0 join (select scene_id, root from c0 group by 1, 2 having count(*) >= 15) using (scene_id, root)),
    wide as (select distinct p.scene_id, p."row", p.col from pixels p join large m on m.scene_id = p.scene_id and greatest(abs(p."row" - m."row"), abs(p.col - m.col)) <= 1),
    closed as (select p.scene_id, p."row", p.col from pixels p join wide w on w.scene_id = p.scene_id and greatest(abs(p."row" - w."row"), abs(p.col - w.col)) <= 1 group by 1, 2, 3 having count(*) = 9),
    dry as (select p.* from pixels p left join closed c using (scene_id, "row", col) where c.scene_id is null), """ + _reach_sql("d0", "dry")
_CLEAN += """, holes as (select scene_id, root from d0 group by 1, 2 having min("row") > 0 and max("row") < 7 and min(col) > 0 and max(col) < 7),
    mask as (select scene_id, "row", col from closed union select scene_id, "row", col from d0 join holes using (scene_id, root))"""
_CONFIDENCE = "least(1, greatest(0, 0.6::double * least(1, greatest(0, (mndwi + 0.2::double) / 0.8::double)) + 0.4::double * least(1, greatest(0, 1 - b08 / 0.25::double)) + case when scl = 6 then 0.2::double else 0 end))"


@query(_CLEAN + f""" select scene_id, "row", col, m.scene_id is not null water, round(case when m.scene_id is not null then {_CONFIDENCE} else 0 end, 9) confidence from wet w left join mask m using (scene_id, "row", col)""".replace("m.scene_id", "m.there").replace("join mask m", 'join (select *, true there from mask) m'))
def segmentation(s, d):
    """Water masks of every scene with their confidence."""
    return rounded(raster.segment(_with_prior(s, d)).select("scene_id", "row", "col", "water", "confidence"))


@query(_CLEAN + ' select scene_id, "row", col from mask')
def tiled_segmentation(s, d):
    """Water masks of every scene from tiles of 4 by 4, less than the margins that they need."""
    prior = (F.col("row").between(1, 6) & F.col("col").between(1, 6)).alias("expected")
    masks, _ = tiles.segment(raster.raw_water(m.pixels(s, d)).select("*", prior), 4)
    return tiles.pixels_of(masks, "mask", 4)


@query()
def mosaic_masks(s, d):
    """Figures of the masks of mosaics of up to 512 by 512 pixels, 64 by 64 vectors each; whole arrays in the tests."""
    masks, figures = tiles.segment(m.mosaic(s, d))
    return rounded(figures)


@query(_CLEAN + ", " + _reach_sql("comp", "mask") + """, sizes as (select scene_id, root, count(*) n from comp group by 1, 2), broken as (select scene_id, count(*) components, sum(n)::bigint water_pixels, max(n) largest_pixels from sizes group by 1),
    cloudy as (select scene_id, count(*) n from wet w where scl in (3, 8, 9, 10) and exists (select 1 from mask m where m.scene_id = w.scene_id and abs(m."row" - w."row") + abs(m.col - w.col) <= 5) group by 1),
    told as (select scene_id, 64 total_pixels, coalesce(water_pixels, 0) water_pixels, coalesce(components, 0) components, coalesce(largest_pixels, 0) largest_pixels, coalesce(1 - largest_pixels / water_pixels::double, 1) fragmentation, coalesce(c.n, 0) cloud_pixels, true has_prior, 36 expected_pixels,
        coalesce(water_pixels, 0) overlap_pixels from (select distinct scene_id from pixels) left join broken using (scene_id) left join cloudy c using (scene_id)),
    pct as (select *, water_pixels / 64::double * 100 water_pct, water_pixels * 1e-4 water_area_km2, case when water_pixels > 0 then largest_pixels / water_pixels::double else 0 end largest_ratio, cloud_pixels / greatest(water_pixels, 1)::double * 100 cloud_pct,
        case when water_pixels > 0 then 100.0 else 0 end::double inside_pct, 0::double out_pct, overlap_pixels / 36::double * 100 coverage_pct from told),
    coded as (select *, list_filter([case when water_pct < 0.5 then 'too_little_water' when water_pct > 95 then 'too_much_water' end, case when cloud_pct > 20 then 'cloud' end], lambda x: x is not null) f, list_filter([case when water_pixels > 0 and coverage_pct < 5 then 'low_coverage' end], lambda x: x is not null) w from pct)
    select scene_id, total_pixels, water_pixels, components, largest_pixels, round(fragmentation, 9) fragmentation, cloud_pixels, has_prior, expected_pixels, overlap_pixels, round(water_pct, 9) water_pct, round(water_area_km2, 9) water_area_km2, round(largest_ratio, 9) largest_ratio,
        round(cloud_pct, 9) cloud_pct, round(inside_pct, 9) inside_pct, out_pct, round(coverage_pct, 9) coverage_pct, array_to_string(f, ',') failures, array_to_string(w, ',') warnings,
        case when list_contains(f, 'cloud') then 'excessive_cloud_overlap' when len(f) > 0 then 'degraded' when len(w) > 0 then 'ok_with_warning' else 'ok' end status, len(f) = 0 is_valid from coded""")
def mask_quality(s, d):
    """The checks of every scene's mask."""
    df = rounded(raster.segment_report(_with_prior(s, d)))
    return df.withColumns({c: F.array_join(c, ",") for c in ("failures", "warnings")})


@query(m.with_sql("pixels") + """select scene_id, "row", col, 14 < (col + 1) * 10 and 54 > col * 10 and 26 < (8 - "row") * 10 and 66 > (7 - "row") * 10 touched, col * 10 + 5 > 14 and col * 10 + 5 < 54 and 75 - "row" * 10 > 26 and 75 - "row" * 10 < 66 inside from pixels""")
def footprint_pixels(s, d):
    p = m.pixels(s, d).select("scene_id", "row", "col")
    ring = F.array(*[F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in ((14.0, 26.0), (54.0, 26.0), (54.0, 66.0), (14.0, 66.0), (14.0, 26.0))])
    bodies = p.select("scene_id").distinct().withColumn("ring", ring)
    both = raster.footprint(raster.footprint(p, bodies, 0.0, 80.0, 10.0).withColumnRenamed("expected", "touched"), bodies, 0.0, 80.0, 10.0, False)
    return both.select("scene_id", "row", "col", "touched", F.col("expected").alias("inside"))


# Rings in SQL: every side of a mask pixel is followed until it comes back; of these walks that from the smallest corner
# is kept, with the corners where it turns.
_RINGS = _WATER + _reach_sql("comp", "water", True) + """, numbered as (select scene_id, "row" r, col c, dense_rank() over (partition by scene_id order by root) component from comp),
    ways as (select * from (values (0, 0, 1, -1, 0, 0, 0), (1, 1, 0, 0, 1, 1, 0), (2, 0, -1, 1, 0, 1, 1), (3, -1, 0, 0, -1, 0, 1)) v(s, hr, hc, lr, lc, dx, dy)),
    side as (select p.*, w.*, p.c + dx x, p.r + dy y from numbered p, ways w where not exists (select 1 from numbered o where o.scene_id = p.scene_id and o.r = p.r + lr and o.c = p.c + lc)),
    linked as (select e.scene_id, e.component, e.r, e.c, e.s, x, y, x + hc x1, y + hr y1, case when a.r is not null then a.r when b.r is not null then b.r else e.r end nr, case when a.r is not null then a.c when b.r is not null then b.c else e.c end nc,
        case when a.r is not null then (s + 3) % 4 when b.r is not null then s else (s + 1) % 4 end ns from side e left join numbered a on a.scene_id = e.scene_id and a.r = e.r + hr + lr and a.c = e.c + hc + lc left join numbered b on b.scene_id = e.scene_id and b.r = e.r + hr and b.c = e.c + hc),
    walk as (select scene_id, component, r fr, c fc, s fs, 0 k, x, y, x1, y1, s, s - 1 came, nr, nc, ns from linked
        union all select w.scene_id, w.component, fr, fc, fs, k + 1, l.x, l.y, l.x1, l.y1, l.s, w.s, l.nr, l.nc, l.ns from walk w join linked l on l.scene_id = w.scene_id and l.r = w.nr and l.c = w.nc and l.s = w.ns where (w.nr, w.nc, w.ns) != (fr, fc, fs)),
    ring as (select scene_id, component, sum(x * y1 - x1 * y) // 2 area, list([x, y] order by k) filter (where s != came) || [list([x, y] order by k)[1]] ring from walk group by scene_id, component, fr, fc, fs having min([x, y]) = min([x, y]) filter (where k = 0)),
    parted as (select *, row_number() over (partition by scene_id, component order by abs(area) desc, len(ring) desc, ring) - 1 part, sum(area) over (partition by scene_id, component) n from ring)"""
_TILED_RINGS = _RINGS + " select scene_id, component, area < 0 hole, abs(area)::bigint pixels, list_aggregate([p[1] || ' ' || p[2] for p in ring], 'string_agg', ',') ring from parted"
# Degrees by another series than the library's, around the latitude at the foot of a point.
_RING_DEGREES = """, spot as (select scene_id, component, part, place - 1 place, (ring[place][1] * 10) / 0.9996::double dx, (2000000 - ring[place][2] * 10) / 0.9996::double m, fl * (2 - fl) e2 from (select *, unnest(range(1, len(ring) + 1)) place from parted where {keep}), (select 1 / 298.257223563::double fl)),
    foot as (select *, mu + (3 * e1 / 2 - 27 * pow(e1, 3) / 32) * sin(2 * mu) + (21 * e1 * e1 / 16 - 55 * pow(e1, 4) / 32) * sin(4 * mu) + 151 * pow(e1, 3) / 96 * sin(6 * mu) + 1097 * pow(e1, 4) / 512 * sin(8 * mu) f from (
        select *, m / (6378137.0 * (1 - e2 / 4 - 3 * e2 * e2 / 64 - 5 * pow(e2, 3) / 256)) mu, (1 - sqrt(1 - e2)) / (1 + sqrt(1 - e2)) e1 from spot)),
    round_ as (select *, 6378137.0 / sqrt(1 - e2 * pow(sin(f), 2)) n, 6378137.0 * (1 - e2) / pow(1 - e2 * pow(sin(f), 2), 1.5) rho, pow(tan(f), 2) t, e2 / (1 - e2) ep, e2 / (1 - e2) * pow(cos(f), 2) c from foot)
    select scene_id, component, part, place, round(75 + degrees((d - (1 + 2 * t + c) * pow(d, 3) / 6 + (5 - 2 * c + 28 * t - 3 * c * c + 8 * ep + 24 * t * t) * pow(d, 5) / 120) / cos(f)), 6) lon,
        round(degrees(f - n * tan(f) / rho * (d * d / 2 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * ep) * pow(d, 4) / 24)), 6) lat from (select *, dx / n d from round_)"""


@query(_RINGS + _RING_DEGREES.format(keep="true"))
def mask_outlines(s, d):
    """Points of the rings around the components of every scene's mask, in degrees."""
    df = raster.outlines(raster.with_components(wet_pixels(s, d), corners=True), 500000.0, 2000000.0, 10.0, 43)
    df = df.select("scene_id", "component", F.col("part").cast("long").alias("part"), F.posexplode("ring").alias("place", "p"))
    return df.select("scene_id", "component", "part", F.col("place").cast("long").alias("place"), F.round("p.lon", 6).alias("lon"), F.round("p.lat", 6).alias("lat"))


@query(_TILED_RINGS)
def tiled_outlines(s, d):
    """Rings around the components of every scene's mask, joined over the borders of tiles of 4 by 4; corners as text."""
    df = tiles.outlines(wet_pixels(s, d), tile=4)
    return df.select("scene_id", "component", "hole", "pixels", F.array_join(F.transform("ring", lambda p: F.concat_ws(" ", p["x"], p["y"])), ",").alias("ring"))


@query(_RINGS + _RING_DEGREES.format(keep="n * 100 > 2000"))
def boundary_rings(s, d):
    """Points of the polygons of every scene's mask without slivers, from tiles of 4 by 4, in degrees; part 0 is the outer ring."""
    df = tiles.boundaries(wet_pixels(s, d), 500000.0, 2000000.0, 10.0, 43, tile=4).select("scene_id", "component", F.posexplode("rings").alias("part", "ring"))
    df = df.select("scene_id", "component", F.col("part").cast("long").alias("part"), F.posexplode("ring").alias("place", "p"))
    return df.select("scene_id", "component", "part", F.col("place").cast("long").alias("place"), F.round("p.lon", 6).alias("lon"), F.round("p.lat", 6).alias("lat"))


@query()
def mosaic_outlines(s, d):
    """Rings of the raw masks of mosaics of up to 512 by 512 pixels; whole arrays in the tests."""
    return tiles.outlines(m.mosaic(s, d), "raw")


_PIXEL_BASELINE = {"turbidity": (0.3, 0.1), "chlorophyll": (0.4, 0.1), "algal": (0.5, 0.1)}
_PIXEL_Z = ", ".join(f"case when {k}_composite is null then 0 else 1 - 1 / (1 + pow(abs({k}_composite - {mean}::double) / {std}::double / 1.5, 2)) end {k}_score" for k, (mean, std) in _PIXEL_BASELINE.items())
_HOT = _recursive(_LAYERS) + f", told as (select *, {_PIXEL_Z} from layers), hot as (select * from (select *, 0.3 / 0.85::double * turbidity_score + 0.3 / 0.85::double * chlorophyll_score + 0.25 / 0.85::double * algal_score score,"
_HOT += " least(1, greatest(0, 0.6::double * least(1, greatest(0, (mndwi + 0.2::double) / 0.8::double)) + 0.4::double * least(1, greatest(0, 1 - b08 / 0.25::double)) + case when scl = 6 then 0.2::double else 0 end)) confidence from told) where score >= 0.5), "
_HOT += _reach_sql("sides", "hot") + ", large as (select scene_id, root from sides group by 1, 2 having count(*) >= 4), kept as (select h.* from hot h join sides using (scene_id, \"row\", col) join large using (scene_id, root)), " + _reach_sql("around", "kept", True)


def _scored_pixels(s: SparkSession, d: str) -> DataFrame:
    df = spectral.layers(wet_pixels(s, d)).withColumn("confidence", scalar.water_confidence(F.col("b03"), F.col("b08"), F.col("b11"), F.col("scl"), F.col("water")))
    return raster.pixel_scores(df.withColumns({k: F.col(f"{k}_composite") for k in scalar.COMPOSITES}), _PIXEL_BASELINE)


@query(_HOT + """, each as (select scene_id, root, count(*) pixels, round(avg(score), 9) score, round(avg(confidence), 9) confidence, avg(turbidity_score) t, avg(chlorophyll_score) c, avg(algal_score) a from kept join around using (scene_id, "row", col) group by 1, 2)
    select scene_id, dense_rank() over (partition by scene_id order by root) region, pixels, score, confidence, round(t, 9) turbidity_score, round(c, 9) chlorophyll_score, round(a, 9) algal_score, round(pixels * 1e-4, 6) area_km2, case when t >= c and t >= a then 'turbidity' when c >= a then 'chlorophyll' else 'algal' end dominant from each""")
def anomaly_regions(s, d):
    return rounded(raster.anomaly_regions(_scored_pixels(s, d)))


@query(_HOT + """, each as (select scene_id, count(*) n, avg(confidence) c from kept group by 1) select scene_id, coalesce(n, 0) anomalous_pixels, round(n * 4e-4, 6) affected_area_km2, round(c, 4) confidence from (select distinct scene_id from pixels) left join each using (scene_id)""")
def anomaly_extent(s, d):
    return raster.anomaly_extent(_scored_pixels(s, d), raster.pixel_area_km2(20.0, 0.0, 0.0, -20.0))


# Geometry.
_AREA = """, flat as (select id, list_transform(ring, lambda p: {'x': 6378137.0 * k0 * radians(p.x), 'y': 6378137.0 * ((1 - e2) * (sin(radians(p.y)) / (1 - e2 * pow(sin(radians(p.y)), 2)) - ln((1 - sqrt(e2) * sin(radians(p.y))) / (1 + sqrt(e2) * sin(radians(p.y)))) / (2 * sqrt(e2)))) / (2 * k0)}) r
    from bodies, (select e2, cos(radians(30)) / sqrt(1 - e2 * pow(sin(radians(30)), 2)) k0 from (select f * (2 - f) e2 from (select 1 / 298.257223563::double f)))),
    areas as (select id, abs(list_sum(list_transform(range(1, len(r)), lambda i: (r[i].x - r[1].x) * (r[i + 1].y - r[1].y) - (r[i + 1].x - r[1].x) * (r[i].y - r[1].y)))) / 2 / 1e6 area from flat)"""


@query(m.with_sql("bodies").rstrip() + _AREA + " select b.id, round(area, 6) area_sq_km, round(lon, 9) xmin, round(lat, 9) ymin, round(lon + w, 9) xmax, round(lat + w, 9) ymax from bodies b join areas using (id)")
def body_areas(s, d):
    df = m.bodies(s, d)
    return df.select("id", F.round(geo.area_km2(F.col("ring")), 6).alias("area_sq_km"), *[F.round(c, 9).alias(k) for k, c in geo.bounds(F.col("ring")).items()])


@query(m.with_sql("bodies") + "select id, id % 4 = 0 valid, id % 4 in (0, 2) valid_unranged from bodies")
def polygon_checks(s, d):
    df, k, ring = m.bodies(s, d), F.col("id") % 4, F.col("ring")
    moved = F.transform(ring, lambda p: F.struct((p["lon"] + 200).alias("lon"), p["lat"].alias("lat")))
    rings = F.when(k == 0, F.array(ring)).when(k == 1, F.array(F.slice(ring, 1, 4))).when(k == 2, F.array(moved)).otherwise(F.array(ring, ring))
    return df.select("id", geo.valid_polygon(rings).alias("valid"), geo.valid_polygon(rings, False).alias("valid_unranged"))


NEAR_LON, NEAR_LAT, NEAR_KM = 75.5, 18.0, 80.0
_RADII = "6378137.0 * (1 - e2) / pow(1 - e2 * pow(sin(radians((y + {y}) / 2)), 2), 1.5) * radians(y - {y}), 6378137.0 / sqrt(1 - e2 * pow(sin(radians((y + {y}) / 2)), 2)) * cos(radians((y + {y}) / 2)) * radians(x - {x})".format(x=NEAR_LON, y=NEAR_LAT)


@query(m.with_sql("bodies") + f"select id, name, distance_km from (select id, name, round(sqrt(pow(n, 2) + pow(e, 2)) / 1000, 3) distance_km, sqrt(pow(n, 2) + pow(e, 2)) m from (select id, name, 6378137.0 * (1 - e2) / pow(1 - e2 * pow(sin(radians((y + {NEAR_LAT}) / 2)), 2), 1.5) * radians(y - {NEAR_LAT}) n, 6378137.0 / sqrt(1 - e2 * pow(sin(radians((y + {NEAR_LAT}) / 2)), 2)) * cos(radians((y + {NEAR_LAT}) / 2)) * radians(x - {NEAR_LON}) e from (select id, name, active, greatest(lon, least({NEAR_LON}, lon + w)) x, greatest(lat, least({NEAR_LAT}, lat + w)) y, f * (2 - f) e2 from bodies, (select 1 / 298.257223563::double f)) where active)) where m <= {NEAR_KM} * 1000")
def nearby_bodies(s, d):
    df = spatial.near(m.bodies(s, d).where("active"), NEAR_LON, NEAR_LAT, NEAR_KM)
    return df.select("id", "name", "distance_km").orderBy("distance_km", "id")


@query(m.with_sql("bodies") + "select id, (id % 7 * 2 - 1) / 10::double between 0 and 1 and (id % 5 * 3 - 1) / 10::double between 0 and 1 inside, false beyond from bodies")
def point_in_polygon(s, d):
    """Points on a lattice over each body's box and around it, some beside it in one direction only."""
    df, r = m.bodies(s, d), F.col("ring")
    at = [r[0][c] + (r[2][c] - r[0][c]) * (F.col("id") % n * k - 1) / 10 for c, n, k in (("lon", 7, 2), ("lat", 5, 3))]
    return df.select("id", geo.contains(r, *at).alias("inside"), geo.contains(r, r[2]["lon"] + 0.001, at[1]).alias("beyond"))


# Another series than the library's: easting and northing by powers of the distance from the middle meridian.
_UTM = """, p as (select id, lon, lat, radians(lat) f, radians(lon - (floor((lon + 180) / 6) * 6 - 177)) dl, floor((lon + 180) / 6)::int + 1 zone, fl * (2 - fl) e2 from bodies, (select 1 / 298.257223563::double fl)),
    q as (select *, e2 / (1 - e2) ep, 6378137.0 / sqrt(1 - e2 * pow(sin(f), 2)) n, pow(tan(f), 2) t, e2 / (1 - e2) * pow(cos(f), 2) c, dl * cos(f) a,
        6378137.0 * ((1 - e2 / 4 - 3 * pow(e2, 2) / 64 - 5 * pow(e2, 3) / 256) * f - (3 * e2 / 8 + 3 * pow(e2, 2) / 32 + 45 * pow(e2, 3) / 1024) * sin(2 * f) + (15 * pow(e2, 2) / 256 + 45 * pow(e2, 3) / 1024) * sin(4 * f) - 35 * pow(e2, 3) / 3072 * sin(6 * f)) mm from p)
    select id, zone, round(500000 + 0.9996 * n * (a + (1 - t + c) * pow(a, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep) * pow(a, 5) / 120), 1) x,
        round(0.9996 * (mm + n * tan(f) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * pow(a, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep) * pow(a, 6) / 720)), 1) y, round(lon, 6) lon, round(lat, 6) lat from q"""


@query(m.with_sql("bodies").rstrip() + _UTM)
def utm_round_trip(s, d):
    p = F.col("ring")[0]
    zone, south = geo.utm_zone(p["lon"]), p["lat"] < 0
    x, y = geo.to_utm(p["lon"], p["lat"], zone, south)
    df = m.bodies(s, d).select("id", x.alias("x"), y.alias("y"), zone.alias("zone"), south.alias("south"))
    lon, lat = geo.from_utm(F.col("x"), F.col("y"), F.col("zone"), F.col("south"))
    return df.select("id", "zone", F.round("x", 1).alias("x"), F.round("y", 1).alias("y"), F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


_POINTS = "points as (select c_custkey point_id, 72 + (c_custkey * 29 % 800) / 100::double lon, 15 + (c_custkey * 31 % 700) / 100::double lat from customer)"


def _points(s: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(s, d, "customer").select(k.alias("point_id"), (72 + (k * 29 % 800) / F.lit(100.0)).alias("lon"), (15 + (k * 31 % 700) / F.lit(100.0)).alias("lat"))


@query(m.with_sql("bodies").rstrip() + f""", {_POINTS}, near as (select p.point_id, b.id body, p.lon px, p.lat py, greatest(b.lon, least(p.lon, b.lon + w)) x, greatest(b.lat, least(p.lat, b.lat + w)) y, f * (2 - f) e2 from points p, bodies b, (select 1 / 298.257223563::double f)),
    m as (select *, 6378137.0 * (1 - e2) / pow(1 - e2 * pow(sin(radians((y + py) / 2)), 2), 1.5) * radians(y - py) n, 6378137.0 / sqrt(1 - e2 * pow(sin(radians((y + py) / 2)), 2)) * cos(radians((y + py) / 2)) * radians(x - px) e from near)
    select point_id, body, round(sqrt(n * n + e * e) / 1000, 3) distance_km from m where sqrt(n * n + e * e) <= 60000""")
def bodies_near_points(s, d):
    return spatial.bodies_near(_points(s, d), m.bodies(s, d), 60.0)


@query(m.with_sql("bodies").rstrip() + """, items as (select event_id scene_id, 72 + (event_id * 7 % 800) / 100::double x0, 15 + (event_id * 11 % 700) / 100::double y0, case when event_id % 50 = 0 then 6 else 0.07::double end z from events)
    select scene_id, id body from items join bodies on x0 <= lon + w and x0 + z >= lon and y0 <= lat + w and y0 + z >= lat""")
def scenes_of_bodies(s, d):
    k = F.col("event_id")
    x, y, z = 72 + (k * 7 % 800) / F.lit(100.0), 15 + (k * 11 % 700) / F.lit(100.0), F.when(k % 50 == 0, 6.0).otherwise(0.07)
    items = table(s, d, "events").select(k.alias("scene_id"), x.alias("xmin"), y.alias("ymin"), (x + z).alias("xmax"), (y + z).alias("ymax"))
    return spatial.scenes_of_bodies(items, m.bodies(s, d))


@query(m.with_sql("bodies") + "select id, 'POLYGON((' || array_to_string(list_transform(ring, lambda p: p.x || ' ' || p.y), ', ') || '))' wkt, '{\"type\":\"Polygon\",\"coordinates\":[[' || array_to_string(list_transform(ring, lambda p: '[' || p.x || ',' || p.y || ']'), ',') || ']]}' geojson from bodies")
def body_outlines(s, d):
    return m.bodies(s, d).select("id", geo.wkt(F.col("ring")).alias("wkt"), geo.geojson(F.col("ring")).alias("geojson"))


# Scenes.
_LADDER = "(values (1, 15, 20.0), (2, 30, 30.0), (3, 45, 40.0), (4, 60, 50.0), (5, 75, 60.0), (6, 90, 60.0)) l(attempt, days, most)"


@query(m.with_sql("scenes", "targets") + f"select target_id, body, target_date, attempt, scene_id, datetime, cloud, attempt > 1 widened from (select t.target_id, t.body, t.target_date, l.attempt, s.scene_id, s.datetime, s.cloud, row_number() over (partition by t.target_id order by l.attempt, abs(epoch_us(s.datetime) - epoch_us(t.target_date)), s.cloud, s.scene_id) n from targets t join scenes s on s.body = t.body join {_LADDER} on abs(date_diff('day', s.datetime::date, t.target_date::date)) <= l.days and s.cloud < l.most) where n = 1")
def scene_choice(s, d):
    return scenes.choose(m.targets(s, d), m.scenes(s, d))


@query(m.with_sql("scenes") + "select scene_id, datetime, cloud from scenes where datetime between timestamp '2024-01-05' and timestamp '2024-01-12' and cloud < 20 and body % 10 <= 5 and body % 10 + 1 >= 4 and body // 10 <= 8 and body // 10 + 1 >= 2")
def scene_search(s, d):
    b = F.col("body")
    items = m.scenes(s, d).withColumns({"xmin": b % 10, "xmax": b % 10 + 1, "ymin": F.floor(b / 10), "ymax": F.floor(b / 10) + 1})
    return scenes.search(items, (4, 2, 5, 8), F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-12").cast("timestamp_ntz"), 20.0).select("scene_id", "datetime", "cloud")


@query(m.with_sql("scenes") + "select scene_id id, case scene_id % 4 when 0 then 'Sentinel-2A' when 1 then 'Sentinel-2B' when 2 then 'given' else 'Sentinel-2' end platform from scenes")
def scene_platforms(s, d):
    k = F.col("scene_id") % 4
    items = m.scenes(s, d).select(F.col("scene_id").alias("id"), F.concat(F.when(k == 0, "S2A_").when(k == 1, "S2B_").otherwise("X_"), F.col("scene_id").cast("string")).alias("scene_id"), F.when(k == 2, "given").alias("platform"), "cloud")
    return scenes.observation(items).select("id", "platform")


# Mutations.
@query(m.with_sql("bodies") + """, cand as (select case when id % 3 = 0 then name || ' new' else name end name, type, case when id % 2 = 0 then 'D' || id end nd, 'survey' source from bodies where id % 4 = 1),
    old as (select b.id, b.name, b.type, coalesce(c.nd, b.district) district, c.name is not null or b.active active, case when c.name is not null then 'updated' else 'kept' end change from bodies b left join cand c using (name, type, source)),
    fresh as (select (select max(id) from bodies) + row_number() over (order by name, type) id, name, type, nd district, true active, 'imported' change from cand c where not exists (select 1 from bodies b where b.name = c.name and b.type = c.type and b.source = c.source))
    select * from old union all select * from fresh""")
def upserted_bodies(s, d):
    b = m.bodies(s, d).withColumn("area_sq_km", F.lit(0.0))
    k = F.col("id")
    cand = b.where(k % 4 == 1).select(F.when(k % 3 == 0, F.concat("name", F.lit(" new"))).otherwise(F.col("name")).alias("name"), "type", F.when(k % 2 == 0, F.concat(F.lit("D"), k.cast("string"))).alias("district"), "ring")
    return mutations.upsert_bodies(b, cand, "survey", "Maharashtra").select("id", "name", "type", "district", "active", "change")


@query(m.with_sql("history") + """, day as (select water_body_id, date_trunc('day', observation_date) observation_date, mask_quality_status, seq from history),
    stored as (select * from day where seq % 3 = 0 qualify row_number() over (partition by water_body_id, observation_date order by seq desc) = 1), both_ as (select *, 0 s from stored union all select *, seq + 1 from day where seq % 3 = 1)
    select water_body_id, observation_date, mask_quality_status, s > 0 replaced from both_ qualify row_number() over (partition by water_body_id, observation_date order by s desc) = 1""")
def upserted_history(s, d):
    h = m.history(s, d).select("water_body_id", F.date_trunc("day", F.col("observation_date").cast("timestamp")).cast("timestamp_ntz").alias("observation_date"), "mask_quality_status", "seq")
    stored = relational.last_per_key(h.where("seq % 3 = 0"), ["water_body_id", "observation_date"], "seq").drop("seq").withColumn("replaced", F.lit(False))
    return mutations.upsert_history(stored, h.where("seq % 3 = 1").withColumn("replaced", F.lit(True)))


@query(m.with_sql("bodies") + "select id, case when id % 2 = 0 then 'Tarn' else type end type, district, active and id % 5 != 0 active from bodies")
def patched_bodies(s, d):
    b = m.bodies(s, d).withColumn("area_sq_km", F.lit(0.0))
    changes = b.where("id % 2 = 0").select("id", F.lit("Tarn").alias("type"), F.lit(None).cast("string").alias("district"))
    return mutations.soft_delete(mutations.patch(b, changes), b.where("id % 5 = 0")).select("id", "type", "district", "active")


@query(m.with_sql("bodies") + "select id, name from bodies union all select (select max(id) from bodies) + row_number() over (order by name), name || ' II' from bodies where id <= 3")
def inserted_bodies(s, d):
    b = m.bodies(s, d).select("id", "name")
    return mutations.insert(b, b.where("id <= 3").select(F.concat("name", F.lit(" II")).alias("name")), ["name"]).select("id", "name")


# Discovery and training data.
_TAGS = "case when id % 5 = 0 then 'reservoir' when id % 5 = 1 then 'POND' when id % 5 = 2 then 'lake' end"


@query(m.with_sql("bodies") + f", e as (select id, name, case when id % 7 = 0 then '  ' else upper(substr(name, 1, 14)) end n, {_TAGS} water, case when id % 5 = 3 then 'water' end nat, case when id % 3 = 0 then district end dist, w from bodies), f as (select *, case when water = 'reservoir' then 'Reservoir' when lower(water) = 'pond' then 'Pond' when water = 'lake' or nat = 'water' then 'Lake' else 'Water body' end type from e where trim(n) != ''), g as (select *, row_number() over (partition by lower(n), lower(dist), type order by id) k from f) select id pos, trim(n) name, type, dist district from g where k = 1 order by w * w desc, id limit 200")
def discovered_elements(s, d):
    b, k = m.bodies(s, d), F.col("id")
    tags = F.map_filter(
        F.create_map(
            F.lit("name"), F.when(k % 7 == 0, "  ").otherwise(F.upper(F.substring("name", 1, 14))), F.lit("water"), F.when(k % 5 == 0, "reservoir").when(k % 5 == 1, "POND").when(k % 5 == 2, "lake"),
            F.lit("natural"), F.when(k % 5 == 3, "water"), F.lit("district"), F.when(k % 3 == 0, F.col("district")),
        ), lambda _, v: v.isNotNull(),
    )
    w = 0.02 + (k % 10) / F.lit(100.0)
    corners = [(F.lit(0.0), F.lit(0.0)), (w, F.lit(0.0)), (w, w), (F.lit(0.0), w), (F.lit(0.0), F.lit(0.0))]
    square = F.array(*[F.struct(x.alias("lon"), y.alias("lat")) for x, y in corners])
    return discovery.from_elements(b.select(k.alias("pos"), F.lit("way").alias("type"), tags.alias("tags"), square.alias("ring")), 500).select("pos", "name", "type", "district")


@query(m.with_sql("bodies").rstrip() + _AREA + " select id pos, case when id % 6 = 0 then 'Waterbody ' || (id + 1) else name end name, case when id % 4 = 0 then 'Water body' else type end type, district from bodies join areas using (id) order by id % 6 = 0, area desc, id limit 60")
def discovered_features(s, d):
    k = F.col("id")
    f = m.bodies(s, d).select(k.alias("pos"), "ring", F.when(k % 6 == 0, "None").otherwise(F.concat(F.lit(" "), "name")).alias("WB Name"), F.when(k % 4 == 0, "").otherwise(F.col("type")).alias("Category"), F.col("district").alias("DIST_NAME"))
    return discovery.from_features(f, 60).select("pos", "name", "type", "district")


@query("select d.doc_id water_body_id, d.lang observation_date, n_chars::double ndti_mean, quality turbidity_measured from documents d join labels l on l.doc_id = d.doc_id where d.n_chars is not null and l.quality is not null")
def training_rows(s, d):
    features = table(s, d, "documents").select(F.col("doc_id").alias("water_body_id"), F.col("lang").alias("observation_date"), F.col("n_chars").cast("double").alias("ndti_mean"))
    docs = table(s, d, "documents").select("doc_id", F.col("lang").alias("observation_date"))
    truth = table(s, d, "labels").join(docs, "doc_id").select(F.col("doc_id").alias("water_body_id"), "observation_date", F.col("quality").alias("turbidity_measured"))
    return ml.training_rows(features, truth, ["ndti_mean"])


_VECTOR = ", ".join(f"coalesce({k}_{n}, 0) {name}" for name, (k, n) in ml.FEATURES.items())


@query(_LAYERS + f" select scene_id, {_VECTOR} from (select distinct scene_id from pixels) left join (select scene_id, {', '.join(_layer_stats_sql(k) for k in dict.fromkeys(k for k, _ in ml.FEATURES.values()))} from layers group by 1) using (scene_id)")
def feature_vectors(s, d):
    return ml.feature_vector(spectral.masked_stats(wet_pixels(s, d), 9))


# Analyses of satellite scenes written to the tables.
_SCENES = """, found as (select user_id water_body_id, event_id % 40 scene_id, ts observation_date, ts + to_microseconds(event_id) created_at, event_id, value, json_extract(props, '$.k')::int k from events),
    stored as (select max(event_id) id, water_body_id, scene_id from found where event_id % 2 = 0 group by 2, 3),
    results as (select *, value / 100 turbidity_score, k / 100::double chlorophyll_score, (value + k) / 200 algal_score, value / 100 anomaly_score from found where event_id % 3 = 0),
    newest as (select water_body_id, scene_id, max(created_at) created_at, arg_max(k, created_at) k from results group by 1, 2),
    obs as (select coalesce(id, (select max(id) from stored) + row_number() over (partition by id is null order by water_body_id, scene_id)) id, water_body_id, scene_id, n.created_at, n.k from stored s full join newest n using (water_body_id, scene_id)),
    ana as (select row_number() over (order by o.id, r.created_at) id, o.id observation_id, r.created_at, r.*, anomaly_score >= 0.25 anomaly_detected from results r join obs o using (water_body_id, scene_id))"""
_EVENTS = "with none as (select 1)"


def _analyzed(s: SparkSession, d: str) -> dict[str, DataFrame]:
    e = table(s, d, "events")
    k, v = F.get_json_object("props", "$.k").cast("int"), F.col("value")
    at = F.col("ts") + F.make_dt_interval(secs=(F.col("event_id") / F.lit(1_000_000)).cast("decimal(18,6)"))
    body, scene = F.col("user_id").alias("water_body_id"), (F.col("event_id") % 40).alias("scene_id")
    stored = e.where("event_id % 2 = 0").groupBy(body, scene).agg(F.max("event_id").alias("id"))
    stored = stored.select("id", "water_body_id", "scene_id", F.lit("old").alias("satellite"), F.lit(None).cast("timestamp_ntz").alias("observation_date"), F.lit(None).cast("double").alias("cloud_percentage"), F.lit(None).cast("string").alias("source_url"), F.lit(None).cast("double").alias("quality_score"))
    scores = {"turbidity_score": v / 100, "chlorophyll_score": k / F.lit(100.0), "algal_score": (v + k) / 200, "area_score": F.lit(1.0)}
    results = e.where("event_id % 3 = 0").select(
        body, scene, F.lit("new").alias("satellite"), at.alias("observation_date"), at.alias("created_at"), k.cast("double").alias("cloud_percentage"), F.lit("url").alias("source_url"), *[c.alias(n) for n, c in scores.items()],
        (v / 100).alias("anomaly_score"), scalar.band(v / 100).alias("anomaly_level"), F.lit(0.5).alias("confidence"), v.alias("affected_area_km2"), F.array(F.concat(F.lit("event "), "event_id")).alias("explanation"),
    )
    analyses = s.createDataFrame([], "id long, observation_id long, created_at timestamp_ntz, anomaly_detected boolean, model_name string, model_version string, analysis_data string")
    alerts = s.createDataFrame([], "id long, water_body_id long, analysis_id long, date timestamp_ntz, indicator string, severity string, confidence double, affected_area_km2 double, explanation string, status string")
    bodies = e.select(F.col("user_id").alias("id")).distinct().withColumn("active", F.lit(True))
    return Engine(s, bodies, stored, analyses, alerts).analyze(results)


@query(m.with_sql("observations") + "select id, water_body_id, observation_date, satellite from observations union all select (select max(id) from observations) + row_number() over (order by observation_date, water_body_id, satellite), water_body_id, observation_date, satellite from observations")
def inserted_observations(s, d):
    o = m.observations(s, d)
    return mutations.insert(o, o.drop("id"), ["observation_date", "water_body_id", "satellite"])


@query(_EVENTS + _SCENES + " select id, water_body_id, scene_id, case when created_at is null then 'old' else 'new' end satellite, created_at observation_date, k::double cloud_percentage, round(least(1, greatest(0, 1 - k / 100::double)) + k * 0, 9) quality_score from obs")
def analyzed_observations(s, d):
    return rounded(_analyzed(s, d)["observations"].drop("source_url"))


@query(_EVENTS + _SCENES + " select id, observation_id, created_at, anomaly_detected, 'sentinel-2-spectral-monitoring' model_name, 'prototype-indicator-only' model_version, anomaly_score::double told_score, turbidity_score::double told_turbidity, 'event ' || event_id told_evidence, true unknown_mode from ana")
def analyzed_analyses(s, d):
    told = F.from_json("analysis_data", "anomaly_score double, individual_scores map<string, double>, evidence array<string>, mode string")
    df = _analyzed(s, d)["analyses"].withColumn("told", told).drop("analysis_data")
    return df.select("*", F.col("told.anomaly_score").alias("told_score"), F.col("told.individual_scores")["turbidity"].alias("told_turbidity"), F.col("told.evidence")[0].alias("told_evidence"), F.col("told.mode").isNull().alias("unknown_mode")).drop("told")


@query(_EVENTS + _SCENES + """ select row_number() over (order by water_body_id, id) id, water_body_id, id analysis_id, created_at date, case when turbidity_score >= chlorophyll_score and turbidity_score >= algal_score then 'turbidity' when chlorophyll_score >= algal_score then 'chlorophyll' else 'algal' end indicator,
    case when anomaly_score < 0.5 then 'LOW' when anomaly_score < 0.75 then 'MEDIUM' else 'HIGH' end severity, 'active' status, 'event ' || event_id message, algal_score::double told_algal from ana where anomaly_score >= 0.25""")
def analyzed_alerts(s, d):
    told = F.from_json("explanation", "messages array<string>, indicator_scores map<string, double>")
    df = _analyzed(s, d)["alerts"].withColumn("told", told).drop("confidence", "affected_area_km2", "explanation")
    return df.select("*", F.col("told.messages")[0].alias("message"), F.col("told.indicator_scores")["algal"].alias("told_algal")).drop("told")


@query(_OA.rstrip() + """ select o.water_body_id, o.id observation_id, a.id analysis_id, case when a.id % 4 = 0 then 0.25::double end turbidity, case when a.id % 4 = 3 then 0.5::double end chlorophyll, case when a.id % 4 = 3 then 0.125::double end confidence,
    case a.id % 4 when 0 then true when 1 then false when 3 then false end anomaly_detected, case a.id % 4 when 0 then 'a,b' when 1 then '' when 3 then '' end evidence from observations o left join latest a on a.observation_id = o.id""")
def evidence_snapshots(s, d):
    docs = ('{"turbidity": 0.25, "anomaly_detected": true, "evidence": ["a", "b"]}', "{}", '{"anomaly_detected": null, "evidence": null}', '{"chlorophyll": 0.5, "confidence": 0.125, "other": {"x": 1}}')
    k = F.col("id") % 4
    a = m.analyses(s, d).select("id", "observation_id", "created_at", F.lit("m").alias("model_name"), F.lit("1").alias("model_version"), F.element_at(F.array(*map(F.lit, docs)), (k + 1).cast("int")).alias("analysis_data"))
    df = history.snapshots(m.observations(s, d), a)
    return df.select("water_body_id", "observation_id", "analysis_id", "turbidity", "chlorophyll", "confidence", "anomaly_detected", F.array_join("evidence", ",").alias("evidence"))
