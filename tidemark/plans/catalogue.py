"""The engine's operators as queries over the driver's tables, with DuckDB SQL for each that SQL can express.

Keys start with the operator's inventory number. Sums of whole units are exact; other doubles are rounded on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions import expressions as X
from ..functions import sql as sql_functions
from ..operators import baselines as B
from ..operators import boosting, decision, features, forecast, hooks, models, quality, report, scenario, uncertainty
from ..schema import COLUMNS, DYNAMIC, METRICS
from ..sessions import checkpoint_folder, cut, written
from ..sources import csv, exports
from ..streaming import fact as stream_fact
from ..streaming import flags as stream_flags
from ..streaming import sketches
from .adapter import DROPPED, FACT, FLAWED, dropped, flawed, unified

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[name] = f
        if sql:
            _sql[name] = sql
        return f

    return add


#: Queries whose results have dates, which both engines give as text.
DATED = {
    "date": "f2_sql_ratios f4_sql_residuals f5_sql_future_days w1_w2_long_windows w1_w3_long_series t1_stream_upsert s1_s9_ingested_rows s4_data_source s5_google_normalise s6_meta_normalise s7_bing_normalise c3_dates c7_calendar c8_ratios c9_clamp c10_ordered_quantiles c14_efficiency p1_sparse_rows p2_history j1_pairs j2_j9_expected_future j3_m4_seasonal_naive w1_rolling_mean w2_rolling_std w3_lags w4_last_rows o1_sorted k1_normalised_residual k2_scaling_factor m5_m7_forecast".split(),
    "last": ["t3_stream_of_exports", "p3_k4_holdout", "w5_all_but_last_rows"],
    "first_date": ["v9_statistics"],
    "last_date": ["v9_statistics"],
}


def _texts(f: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = f(spark, sf_dir)
        return df.withColumns({c: F.col(c).cast("string") for c, t in df.dtypes if t == "date"})

    return run


def queries() -> dict[str, Query]:
    return {name: _texts(f) for name, f in _queries.items()}


def oracle_sql() -> dict[str, str]:
    def dated(name: str, sql: str) -> str:
        dates = [c for c, names in DATED.items() if name in names]
        return f"SELECT * REPLACE ({', '.join(f'{c}::VARCHAR AS {c}' for c in dates)}) FROM ({sql})" if dates else sql

    return {name: dated(name, sql) for name, sql in _sql.items()}


def r(c, places: int = 6):
    name = c if isinstance(c, str) else None
    out = F.round(F.col(c) if name else c, places)
    return out.alias(name) if name else out


def evens(*names: str) -> str:
    """As the report rounds: to 2 places, half to even."""
    return ", ".join(f"round_even({n}, 2) AS {n}" for n in names)


def rs(names, places: int = 6) -> str:
    return ", ".join(f"round({n}, {places}) AS {n}" for n in names)


ALLOWED = DEFAULTS["validation"]["valid_campaign_types"]
ORDER = "date, " + ", ".join(METRICS)
BY = f"PARTITION BY campaign_id ORDER BY {ORDER}"

# --- SQL of shared steps ---

TIME_SQL = "(isodow(date) - 1)::INT AS dow, month(date)::INT AS month, quarter(date)::INT AS quarter, dayofyear(date)::INT AS doy, weekofyear(date)::INT AS woy, (isodow(date) >= 6)::INT AS is_weekend"
RATIO_SQL = ", ".join(f"CASE WHEN {den} > 1e-10 THEN {num}::DOUBLE / {den} ELSE 0.0::DOUBLE END AS {name}" for name, (num, den) in features.RATIOS.items())
ROLL_SQL = ", ".join(
    f"CASE WHEN count({m}) OVER w{n} >= 2 THEN avg({m}::DOUBLE) OVER w{n} END AS {m}_roll_mean_{n}, coalesce(CASE WHEN count({m}) OVER w{n} >= 2 THEN stddev_samp({m}::DOUBLE) OVER w{n} END, 0.0::DOUBLE) AS {m}_roll_std_{n}"
    for m in METRICS
    for n in features.ROLLING
)
LAG_SQL = ", ".join(f"lag({m}, {k}) OVER o AS {m}_lag_{k}" for m in METRICS for k in features.LAGS)
WINDOWS_SQL = "WINDOW o AS (" + BY + "), " + ", ".join(f"w{n} AS ({BY} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" for n in features.ROLLING)
FEATURES = FACT + f",\nfeat AS (SELECT *, {TIME_SQL}, {RATIO_SQL}, {ROLL_SQL}, {LAG_SQL} FROM fact {WINDOWS_SQL})"
NAMES = [*COLUMNS, *features.feature_names()]
BUILT = FEATURES + ",\nbuilt AS (SELECT * FROM feat WHERE (" + " + ".join(f"({c} IS NULL)::INT" for c in NAMES) + f")::DOUBLE / {len(NAMES)} <= 0.3::DOUBLE)"


def base_sql(source: str, name: str = "base") -> str:
    return f""",
{name} AS (SELECT *, CASE WHEN total_spend > 0 THEN total_revenue / total_spend ELSE 0.0::DOUBLE END AS historical_roas FROM
  (SELECT campaign_id AS entity_id, channel, arg_max(campaign_type, date) AS campaign_type, sum(spend) AS total_spend, sum(revenue) AS total_revenue,
          arg_max(spend, date) AS last_daily_spend, arg_max(daily_budget, date) AS last_daily_budget FROM {source} GROUP BY campaign_id, channel))"""


def forecast_sql(source: str, p: str = "", days: int = 90) -> str:
    """Points of a forecast with weekday quantiles as its model, as {p}points; its parts have the prefix p too."""
    return f""",
{p}ranked AS (SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY date DESC) AS rn, count(*) OVER (PARTITION BY campaign_id) AS cn FROM {source}),
{p}hist AS (SELECT * FROM {p}ranked WHERE cn >= 30 AND rn <= 90),
{p}days AS (SELECT campaign_id, channel, step::INT AS step, ((SELECT max(date) FROM {p}hist) + step::INT)::DATE AS date FROM (SELECT DISTINCT campaign_id, channel FROM {p}hist), range(1, {days + 1}) t(step)),
{p}q AS (SELECT campaign_id, isodow(date) - 1 AS dow, quantile_cont(revenue, 0.1::DOUBLE) AS q10, quantile_cont(revenue, 0.5::DOUBLE) AS q50, quantile_cont(revenue, 0.9::DOUBLE) AS q90 FROM {source} GROUP BY ALL),
{p}qa AS (SELECT campaign_id, quantile_cont(revenue, 0.1::DOUBLE) AS a10, quantile_cont(revenue, 0.5::DOUBLE) AS a50, quantile_cont(revenue, 0.9::DOUBLE) AS a90 FROM {source} GROUP BY ALL),
{p}nb AS (SELECT campaign_id, avg(revenue) AS baseline FROM {p}ranked WHERE rn <= 7 GROUP BY ALL),
{p}np AS (SELECT campaign_id, isodow(date) - 1 AS dow, avg(revenue) AS pattern FROM {p}ranked WHERE rn <= 7 AND cn >= 7 GROUP BY ALL),
{p}model AS (SELECT d.*, coalesce(q10, a10) AS q10, coalesce(q50, a50) AS q50, coalesce(q90, a90) AS q90, coalesce(pattern, baseline, 0.0::DOUBLE) AS naive
  FROM {p}days d LEFT JOIN {p}q q ON q.campaign_id = d.campaign_id AND q.dow = isodow(d.date) - 1 LEFT JOIN {p}qa a ON a.campaign_id = d.campaign_id
  LEFT JOIN {p}nb b ON b.campaign_id = d.campaign_id LEFT JOIN {p}np n ON n.campaign_id = d.campaign_id AND n.dow = isodow(d.date) - 1),
{p}mixed AS (SELECT campaign_id AS entity_id, channel, step, date, list_sort([0.5::DOUBLE * q10 + 0.5::DOUBLE * naive, 0.5::DOUBLE * q50 + 0.5::DOUBLE * naive, 0.5::DOUBLE * q90 + 0.5::DOUBLE * naive]) AS v FROM {p}model),
{p}points AS (SELECT entity_id, channel, 'revenue' AS metric, h::INT AS horizon, step, date, greatest(v[1], 0.0::DOUBLE) AS p10, greatest(v[2], 0.0::DOUBLE) AS p50, greatest(v[3], 0.0::DOUBLE) AS p90
  FROM {p}mixed, (VALUES (30), (60), (90)) t(h) WHERE step <= h)"""


HOLDOUT = """,
held AS (SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY date DESC) AS hr, count(*) OVER (PARTITION BY campaign_id) AS hn FROM fact),
train AS (SELECT * EXCLUDE (hr, hn) FROM held WHERE hn >= 25 AND hr > 14), actuals AS (SELECT * EXCLUDE (hr, hn) FROM held WHERE hn >= 25 AND hr <= 14)"""
PAIRS = FACT + HOLDOUT + forecast_sql("train") + """,
pairs AS (SELECT p.entity_id, p.channel, p.horizon, p.date, a.revenue AS actual, p10, p50, p90 FROM points p JOIN actuals a ON a.campaign_id = p.entity_id AND a.date = p.date),
scores AS (SELECT *, greatest(abs(actual - p50) / greatest((p90 - p10) / 2, 1e-10::DOUBLE), 0.0::DOUBLE) AS score FROM pairs),
alpha AS (SELECT CASE WHEN count(*) < 10 THEN 1.0::DOUBLE ELSE list_sort(list(score))[least(ceil((count(*) + 1) * 0.8::DOUBLE)::BIGINT, count(*))] END AS alpha FROM scores)"""
SERIES = """,
widths AS (SELECT *, p90 - p10 AS raw, (p90 - p10) / greatest(p50, 1e-10::DOUBLE) AS rel, greatest(horizon // 3, 1) AS third FROM points),
series0 AS (SELECT entity_id, channel, horizon, count(*) AS n, avg(raw * {a}) AS avg_interval_width, avg(rel * {a}) AS avg_relative_width, stddev_pop(rel * {a}) AS sd, avg(raw) AS mean_raw,
  regr_slope(raw, step::DOUBLE) AS slope, coalesce(avg(rel) FILTER (WHERE step <= third), 0.0::DOUBLE) AS early, coalesce(avg(rel) FILTER (WHERE step > third AND step <= 2 * third), 0.0::DOUBLE) AS mid, coalesce(avg(rel) FILTER (WHERE step > 2 * third), 0.0::DOUBLE) AS late FROM widths GROUP BY ALL),
series AS (SELECT entity_id, channel, horizon, avg_interval_width, avg_relative_width, greatest(0.0::DOUBLE, 1 - least(avg_relative_width / 2.0::DOUBLE, 1.0::DOUBLE)) AS confidence_score,
  CASE WHEN n < 2 OR avg_relative_width = 0 THEN 0.0::DOUBLE ELSE sd / avg_relative_width END AS volatility,
  CASE WHEN mean_raw = 0 OR n < 3 THEN 'stable' WHEN slope / mean_raw > 0.02::DOUBLE THEN 'widening' WHEN slope / mean_raw < -0.02::DOUBLE THEN 'narrowing' ELSE 'stable' END AS stability_trend, early, mid, late FROM series0),
entities AS (SELECT entity_id, arg_min(channel, horizon) AS channel, avg(avg_interval_width) AS avg_interval_width, avg(avg_relative_width) AS avg_relative_width, avg(confidence_score) AS confidence_score,
  avg(volatility) AS volatility, arg_min(stability_trend, horizon) AS stability_trend FROM series GROUP BY entity_id)"""
POINTS = FACT + forecast_sql("fact")
UNCERTAIN = POINTS + SERIES.format(a="1.0::DOUBLE")
ISLANDS = """,
zeros AS (SELECT campaign_id, date, (revenue = 0)::INT AS z, row_number() OVER o - sum((revenue = 0)::INT) OVER (o ROWS UNBOUNDED PRECEDING) AS island FROM {source} WINDOW o AS (PARTITION BY campaign_id ORDER BY date)),
zero_runs AS (SELECT campaign_id AS entity_id, max(n)::BIGINT AS longest_zero_run FROM (SELECT campaign_id, island, sum(z) AS n FROM zeros GROUP BY ALL) GROUP BY ALL)"""
HALVES = """,
halves0 AS (SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY date) <= count(*) OVER (PARTITION BY campaign_id) // 2 AS early FROM {source}),
halves AS (SELECT campaign_id AS entity_id, count(*) AS n, coalesce(sum(spend) FILTER (WHERE early), 0) AS es, coalesce(sum(revenue) FILTER (WHERE early), 0) AS er, coalesce(sum(spend) FILTER (WHERE NOT early), 0) AS ls, coalesce(sum(revenue) FILTER (WHERE NOT early), 0) AS lr FROM halves0 GROUP BY ALL),
ratios AS (SELECT entity_id, n, CASE WHEN er > 0 THEN es / er END AS early_ratio, CASE WHEN lr > 0 THEN ls / lr END AS late_ratio FROM halves),
inflation AS (SELECT entity_id, early_ratio, late_ratio, CASE WHEN n < 30 THEN false WHEN early_ratio = 0 THEN false WHEN early_ratio IS NULL AND late_ratio IS NULL THEN false WHEN early_ratio IS NULL THEN late_ratio > 0
  WHEN late_ratio IS NULL THEN true ELSE (late_ratio - early_ratio) / early_ratio > 0.2::DOUBLE END AS cost_inflation FROM ratios)"""
ASSESSED = UNCERTAIN + base_sql("fact") + ISLANDS.format(source="fact") + HALVES.format(source="fact") + """,
assessed AS (SELECT b.entity_id, b.channel, b.campaign_type, b.total_spend AS current_spend, b.historical_roas AS current_roas, coalesce(e.confidence_score, 0.5::DOUBLE) AS confidence_score, coalesce(e.volatility, 0.5::DOUBLE) AS volatility,
  coalesce(e.stability_trend, 'stable') AS stability_trend,
  list_filter([CASE WHEN b.historical_roas < 3 THEN 'below_roas_target' END, CASE WHEN e.confidence_score < 0.5::DOUBLE THEN 'high_uncertainty' END, CASE WHEN z.longest_zero_run >= 45 THEN 'zero_revenue' END,
    CASE WHEN i.cost_inflation THEN 'cost_inflation' END, CASE WHEN b.total_spend / (SELECT sum(total_spend) FROM base) > 0.6::DOUBLE THEN 'concentration_risk' END], lambda x: x IS NOT NULL) AS flags,
  least(b.historical_roas / 3.0::DOUBLE, 3.0::DOUBLE) * coalesce(e.confidence_score, 0.5::DOUBLE) * (1 / (1 + coalesce(e.volatility, 0.5::DOUBLE))) AS score
  FROM base b LEFT JOIN entities e USING (entity_id) LEFT JOIN zero_runs z USING (entity_id) LEFT JOIN inflation i USING (entity_id))"""


def rounds_sql(n: int = 10) -> str:
    """The allocation's rounds, unrolled: stop says that a round fixed none or left none free."""
    out = """,
tot AS (SELECT sum(total_spend) AS t FROM base), r0 AS (SELECT a.entity_id, greatest(a.score, 0.0::DOUBLE) AS points, b.total_spend AS spend,
  (SELECT t FROM tot) * (CASE WHEN (SELECT sum(greatest(score, 0.0::DOUBLE)) FROM assessed) > 0 THEN greatest(a.score, 0.0::DOUBLE) / (SELECT sum(greatest(score, 0.0::DOUBLE)) FROM assessed) ELSE 1.0::DOUBLE / (SELECT count(*) FROM assessed) END) AS alloc, true AS free, false AS stop
  FROM assessed a JOIN base b USING (entity_id))"""
    for i in range(n):
        out += f""",
c{i} AS (SELECT *, free AND NOT stop AND (alloc < greatest(0.0::DOUBLE, spend * 0.5::DOUBLE) OR alloc > spend * 1.5::DOUBLE) AS hit FROM r{i}),
d{i} AS (SELECT entity_id, points, spend, CASE WHEN hit THEN least(greatest(alloc, greatest(0.0::DOUBLE, spend * 0.5::DOUBLE)), spend * 1.5::DOUBLE) ELSE alloc END AS alloc, free AND NOT hit AS free, stop OR NOT bool_or(hit) OVER () OR NOT bool_or(free AND NOT hit) OVER () AS stop FROM c{i}),
s{i} AS (SELECT coalesce(sum(alloc) FILTER (WHERE NOT free), 0) AS fixed, coalesce(sum(points) FILTER (WHERE free), 0) AS fp FROM d{i}),
r{i + 1} AS (SELECT entity_id, points, spend, CASE WHEN free AND NOT stop AND fp > 0 AND (SELECT t FROM tot) - fixed > 0 THEN ((SELECT t FROM tot) - fixed) * (points / fp) ELSE alloc END AS alloc, free, stop FROM d{i}, s{i})"""
    return out + f", allocation AS (SELECT entity_id, greatest(0.0::DOUBLE, alloc) AS allocation FROM r{n})"


ALLOCATED = ASSESSED + rounds_sql()
NAMED = ",\nnamed AS (SELECT * FROM (VALUES ('baseline', NULL::DOUBLE), ('budget_increase_10pct', 0.1::DOUBLE), ('budget_decrease_10pct', -0.1::DOUBLE)) t(scenario, relative))"

# --- frames of shared steps ---


def settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact, written once for the several uses that a query has for it."""
    return written(unified(spark, sf_dir))


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact with its rows' places in their campaigns, sorted once for last rows, holdouts and flags, and written."""
    return written(features.placed(unified(spark, sf_dir)))


def points_of(fact: DataFrame) -> DataFrame:
    return forecast.forecast(fact, models.WeekdayQuantiles().fit(fact))


def held_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, actuals = uncertainty.holdout(placed(spark, sf_dir))
    return uncertainty.pairs(points_of(train), actuals)


def entities_of(fact: DataFrame) -> DataFrame:
    return uncertainty.by_entity(uncertainty.by_series(points_of(fact)))


def assessed_of(fact: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """One row per campaign, written for the several uses that a query has for it."""
    return written(decision.assess(B.baselines(fact) if base is None else base, entities_of(fact), fact))


BASE_COLUMNS = ("entity_id", "channel", "campaign_type", "total_spend", "total_revenue", "last_daily_spend", "last_daily_budget", "historical_roas")

# --- flagship, sources ---


@query("flagship_baselines", f"WITH {BUILT}{base_sql('built')} SELECT {', '.join(BASE_COLUMNS)} FROM base")
def _(spark, sf):
    return B.baselines(features.build(unified(spark, sf)))


@query("flagship_below_target", f"WITH {FACT}{base_sql('fact')}{HALVES.format(source='fact')} SELECT entity_id, channel, historical_roas, cost_inflation FROM base JOIN inflation USING (entity_id) WHERE historical_roas < 3")
def _(spark, sf):
    fact = placed(spark, sf)
    return B.baselines(fact).join(B.cost_inflation(fact), "entity_id").where("historical_roas < 3").select("entity_id", "channel", "historical_roas", "cost_inflation")


def _raw(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    """Order lines in the shape of one channel's export: text with padding."""
    line = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_suppkey").cast("string").alias("id"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), F.col("l_extendedprice").cast("decimal(18,2)").alias("price"), F.col("l_quantity").cast("bigint").alias("q"), F.col("l_linenumber").alias("n"))
    text = lambda c: F.concat(F.lit(" "), F.col(c).cast("string"), F.lit("  "))
    bad = F.when(F.col("n") == 7, "n/a").otherwise(F.col("price").cast("string"))
    if kind == "google":
        return line.select(text("id").alias("campaign_id"), text("day").alias("segments_date"), F.when(F.col("n") == 7, "x").otherwise((F.col("price") * 1000000).cast("bigint").cast("string")).alias("metrics_cost_micros"), bad.alias("metrics_conversions_value"), text("q").alias("metrics_clicks"), text("q").alias("metrics_impressions"), text("n").alias("metrics_conversions"), F.lit(" SEARCH   ").alias("campaign_advertising_channel_type"), F.lit(" 90.0 ").alias("campaign_budget_amount"), F.concat(F.lit(" C_"), "id", F.lit(" ")).alias("campaign_name"))
    if kind == "meta":
        return line.select(text("id").alias("campaign_id"), text("day").alias("date_start"), bad.alias("spend"), bad.alias("conversion"), text("q").alias("clicks"), text("q").alias("impressions"), F.lit("").alias("daily_budget"), F.when(F.col("n") == 1, "").when(F.col("n") == 2, "Plain").when(F.col("n") == 3, "_x").otherwise("Generic_1_2").alias("campaign_name"))
    return line.select(text("id").alias("CampaignId"), text("day").alias("TimePeriod"), bad.alias("Revenue"), bad.alias("Spend"), text("q").alias("Clicks"), text("q").alias("Impressions"), text("n").alias("Conversions"), F.lit(" Search").alias("CampaignType"), F.lit("12.5").alias("DailyBudget"), F.lit(" Name ").alias("CampaignName"))


_LINES = "l AS (SELECT l_suppkey AS id, l_shipdate::DATE AS date, l_extendedprice::DECIMAL(18,2)::DOUBLE AS price, l_quantity::BIGINT AS q, l_linenumber AS n FROM lineitem)"
_GOOGLE = f"WITH {_LINES} SELECT date, 'google' AS channel, 'google_' || id AS campaign_id, 'C_' || id AS campaign_name, 'SEARCH' AS campaign_type, CASE WHEN n <> 7 THEN round(price * 1000000)::BIGINT / 1000000.0::DOUBLE END AS spend, CASE WHEN n = 7 THEN 0 ELSE price END AS revenue, q AS clicks, q AS impressions, n::DOUBLE AS conversions, 90.0::DOUBLE AS daily_budget FROM l"
_META = f"WITH {_LINES} SELECT date, 'meta' AS channel, 'meta_' || id AS campaign_id, CASE n WHEN 1 THEN '' WHEN 2 THEN 'Plain' WHEN 3 THEN '_x' ELSE 'Generic_1_2' END AS campaign_name, CASE n WHEN 1 THEN 'unknown' WHEN 2 THEN 'Plain' WHEN 3 THEN '' ELSE 'Generic' END AS campaign_type, CASE WHEN n = 7 THEN 0 ELSE price END AS spend, CASE WHEN n = 7 THEN 0 ELSE price END AS revenue, q AS clicks, q AS impressions, 0.0::DOUBLE AS conversions, 0.0::DOUBLE AS daily_budget FROM l"
_BING = f"WITH {_LINES} SELECT date, 'bing' AS channel, 'bing_' || id AS campaign_id, 'Name' AS campaign_name, 'Search' AS campaign_type, CASE WHEN n = 7 THEN 0 ELSE price END AS spend, CASE WHEN n = 7 THEN 0 ELSE price END AS revenue, q AS clicks, q AS impressions, n::DOUBLE AS conversions, 12.5::DOUBLE AS daily_budget FROM l"


@query("s5_google_normalise", _GOOGLE)
def _(spark, sf):
    return csv.GOOGLE(_raw(spark, sf, "google"))


@query("s6_meta_normalise", _META)
def _(spark, sf):
    return csv.META(_raw(spark, sf, "meta"))


@query("s7_bing_normalise", _BING)
def _(spark, sf):
    return csv.BING(_raw(spark, sf, "bing"))


_UNION = " UNION ALL ".join(f"SELECT * FROM ({q})" for q in (_GOOGLE, _META, _BING))


def _export_files(spark: SparkSession, sf: str) -> str:
    folder = f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}"
    for kind in ("google", "meta", "bing"):
        _raw(spark, sf, kind).write.mode("append").option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder)
    return folder


_UNION_AS_READ = _UNION.replace("CASE n WHEN 1 THEN '' WHEN", "CASE n WHEN 1 THEN NULL WHEN")  # empty text in a file is null


@query("s1_s9_ingested_rows", _UNION_AS_READ)
def _(spark, sf):
    return csv.ingest(spark, _export_files(spark, sf))


@query("s4_data_source", _UNION_AS_READ)
def _(spark, sf):
    exports.register(spark)
    return spark.read.format("campaign_exports").load(_export_files(spark, sf))


@query("t3_stream_of_exports", f"SELECT channel, campaign_id, count(*) AS n, count(spend) AS spends, sum(clicks)::BIGINT AS clicks, max(date) AS last FROM ({_UNION}) GROUP BY ALL")
def _(spark, sf):
    """One channel's files, then the stream stops, then the others'."""
    exports.register(spark)
    folder = f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}"
    for kind in ("google", "meta", "bing"):
        _raw(spark, sf, kind).write.mode("append").option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{folder}/in")
        if kind != "meta":
            stream = spark.readStream.format("campaign_exports").load(f"{folder}/in")
            stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("channel", "campaign_id").agg(F.count("*").alias("n"), F.count("spend").alias("spends"), F.sum("clicks").alias("clicks"), F.max("date").alias("last"))


@query("s9_union_of_dialects", f"SELECT channel, count(*) AS n, count(spend) AS spends, sum(clicks)::BIGINT AS clicks FROM ({_UNION}) GROUP BY channel")
def _(spark, sf):
    both = csv.ingest(spark, _export_files(spark, sf))
    return both.groupBy("channel").agg(F.count("*").alias("n"), F.count("spend").alias("spends"), F.sum("clicks").alias("clicks"))


# --- projections ---


@query("c1_c5_text_and_ids", "SELECT s_suppkey, CASE WHEN lower(trim(s_name)) <> 'nan' THEN trim(s_name) END AS name, 'google_' || s_suppkey AS campaign_id, CASE WHEN s_name IS NULL OR s_name = '' THEN 'unknown' ELSE split_part(s_name, '_', 1) END AS prefix FROM supplier")
def _(spark, sf):
    own = spark.read.parquet(f"{sf}/supplier.parquet").withColumn("id", F.col("s_suppkey").cast("string"))
    return own.select("s_suppkey", X.trimmed("s_name").alias("name"), X.namespaced("google", "id").alias("campaign_id"), X.first_part("s_name").alias("prefix"))


@query("c2_lenient_numbers", "SELECT event_id, coalesce(CASE WHEN isnan(TRY_CAST(props AS DOUBLE)) THEN NULL ELSE TRY_CAST(props AS DOUBLE) END, 0.0::DOUBLE) AS a, coalesce(CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END, 0.0::DOUBLE) AS b FROM events")
def _(spark, sf):
    own = spark.read.parquet(f"{sf}/events.parquet").withColumn("v", F.when(F.col("event_id") % 7 == 0, "nan").otherwise(F.col("value").cast("string")))
    return own.select("event_id", X.number_or_0("props").alias("a"), X.number_or_0("v").alias("b"))


@query("c3_dates", "SELECT DISTINCT l_shipdate::DATE AS date FROM lineitem")
def _(spark, sf):
    own = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.concat(F.lit(" "), F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit(" ")).alias("t"))
    return own.select(F.to_date(X.trimmed("t")).alias("date")).distinct()


@query("c7_calendar", f"WITH {FACT} SELECT campaign_id, date, {TIME_SQL} FROM fact")
def _(spark, sf):
    return features.time_features(unified(spark, sf)).select("campaign_id", "date", *features.TIME)


@query("c8_ratios", f"WITH {FACT} SELECT campaign_id, date, {RATIO_SQL} FROM fact")
def _(spark, sf):
    return features.ratio_features(unified(spark, sf)).select("campaign_id", "date", *features.RATIOS)


@query("c9_clamp", f"WITH {FLAWED} SELECT campaign_id, date, CASE WHEN spend < 0 THEN 0.0::DOUBLE ELSE spend END AS spend FROM flawed")
def _(spark, sf):
    return flawed(unified(spark, sf)).select("campaign_id", "date", X.clamped("spend").alias("spend"))


@query("c10_ordered_quantiles", f"WITH {FACT}, v AS (SELECT campaign_id, date, list_sort([spend - 40000, revenue - 60000, daily_budget]) AS v FROM fact) SELECT campaign_id, date, greatest(v[1], 0.0::DOUBLE) AS p10, greatest(v[2], 0.0::DOUBLE) AS p50, greatest(v[3], 0.0::DOUBLE) AS p90 FROM v")
def _(spark, sf):
    return unified(spark, sf).select("campaign_id", "date", *X.ordered_floor(F.col("spend") - 40000, F.col("revenue") - 60000, F.col("daily_budget")))


@query("c12_c13_widths_and_confidence", f"WITH {POINTS} SELECT entity_id, horizon, round(avg((p90 - p10) / greatest(p50, 1e-10::DOUBLE)), 8) AS relative_width, round(greatest(0.0::DOUBLE, 1 - least(avg((p90 - p10) / greatest(p50, 1e-10::DOUBLE)) / 2.0::DOUBLE, 1.0::DOUBLE)), 8) AS confidence FROM points GROUP BY ALL")
def _(spark, sf):
    own = points_of(settled(spark, sf)).groupBy("entity_id", "horizon").agg(F.avg(X.relative_width()).alias("w"))
    return own.select("entity_id", "horizon", F.round("w", 8).alias("relative_width"), F.round(X.confidence(F.col("w"), 2.0), 8).alias("confidence"))


@query("c14_efficiency", f"WITH {FACT} SELECT campaign_id, date, round(1 / (1 + abs(revenue) / (3 * spend + 1e-9::DOUBLE)), 9) AS efficiency FROM fact WHERE spend > 0")
def _(spark, sf):
    return unified(spark, sf).where("spend > 0").select("campaign_id", "date", F.round(X.efficiency(F.col("revenue"), F.col("spend")), 9).alias("efficiency"))


@query("c15_c16_budgets", f"WITH {FACT}{base_sql('fact')}{NAMED} SELECT scenario, entity_id AS campaign_id, round(greatest(0.0::DOUBLE, last_daily_budget * (1 + coalesce(relative, 0))), 1) AS daily_budget, round(greatest(0.1::DOUBLE, least(5.0::DOUBLE, CASE WHEN last_daily_budget > 0 THEN round(greatest(0.0::DOUBLE, last_daily_budget * (1 + coalesce(relative, 0))), 2) / last_daily_budget ELSE 1 END)), 6) AS spend_multiplier FROM base, named")
def _(spark, sf):
    base = B.baselines(unified(spark, sf))
    own = scenario.budget_map(base, scenario.default_adjustments(base), scenario.scenarios(spark))
    return own.select("scenario", "campaign_id", r("daily_budget", 1), r("spend_multiplier"))


@query("c17_score", f"WITH {ASSESSED} SELECT entity_id, round(score, 8) AS score FROM assessed")
def _(spark, sf):
    return assessed_of(placed(spark, sf)).select("entity_id", r("score", 8))


_WHOLE = "round_even(abs(change), 0)::BIGINT"
_SENTENCES = ", ".join(f"CASE WHEN list_contains(flags, '{f}') THEN '{s}' END" for f, s in decision.SENTENCES.items())
_RATIONALE = f"concat_ws(' ', CASE WHEN abs(change) < 1 THEN 'Maintain current budget.' ELSE (CASE WHEN change > 0 THEN 'Increase' ELSE 'Decrease' END) || ' budget ' || round_even(CASE WHEN spend > 0 THEN abs(change) / spend * 100 ELSE 0 END, 0)::BIGINT || '% ($' || {_WHOLE} || ').' END, {_SENTENCES}, CASE WHEN len(flags) = 0 THEN 'Campaign performing well.' END)"


@query("c18_rationale", f"WITH {ALLOCATED}, x AS (SELECT a.entity_id, a.flags, b.total_spend AS spend, allocation - b.total_spend AS change FROM assessed a JOIN base b USING (entity_id) JOIN allocation USING (entity_id)) SELECT entity_id, {_RATIONALE} AS rationale FROM x")
def _(spark, sf):
    fact = placed(spark, sf)
    base = written(B.baselines(fact))
    return decision.recommend(assessed_of(fact, base), base).select("entity_id", "rationale")


# --- checks ---


def _check(number: str, name: str, sql: str, call: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> None:
    _queries[f"{number}_{name}"] = lambda spark, sf: call(flawed(settled(spark, sf)))[0].drop("samples")
    _sql[f"{number}_{name}"] = f"WITH {FLAWED} {sql}"


def _count(name: str, condition: str, message: str) -> str:
    return f"SELECT '{name}' AS \"check\", 'warning' AS severity, '' AS subject, n AS count, {message} AS message FROM (SELECT count(*) FILTER (WHERE {condition}) AS n, count(*) AS t FROM flawed) WHERE n > 0"


_SHARE = "printf('%.1f%%', n * 100.0::DOUBLE / t)"


_check("v1", "missing_values", "SELECT 'missing_values' AS \"check\", CASE WHEN n::DOUBLE / t > 0.3::DOUBLE THEN 'error' ELSE 'warning' END AS severity, subject, n AS count, 'Column ''' || subject || ''' has ' || n || ' missing values (' || " + _SHARE + " || CASE WHEN n::DOUBLE / t > 0.3::DOUBLE THEN '), exceeding 30% threshold.' ELSE ').' END AS message FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS subject, count(*) FILTER (WHERE {c} IS NULL) AS n, count(*) AS t FROM flawed" for c in COLUMNS) + ") WHERE n > 0", quality.missing_values)
_check("v2", "negative_spend", _count("negative_spend", "spend < 0", "'Found ' || n || ' rows with negative spend. Values have been clamped to 0.0.'"), quality.negative_spend)
_check("v3", "duplicate_rows", "SELECT 'duplicate_rows' AS \"check\", CASE WHEN n::DOUBLE / t > 0.05::DOUBLE THEN 'error' ELSE 'warning' END AS severity, '' AS subject, n AS count, 'Found and removed ' || n || ' duplicate rows (' || " + _SHARE + " || ' of data).' AS message FROM (SELECT a.t, a.t - b.k AS n FROM (SELECT count(*) AS t FROM flawed) a, (SELECT count(*) AS k FROM (SELECT DISTINCT * FROM flawed)) b) WHERE n > 0", quality.duplicate_rows)
_check("v4", "future_dates", "SELECT 'future_dates' AS \"check\", CASE WHEN count(*) > 7 THEN 'error' ELSE 'warning' END AS severity, '' AS subject, count(*) AS count, 'Found ' || count(*) || ' rows with dates after 1998-01-01. These rows have been excluded.' AS message FROM flawed WHERE date > DATE '1998-01-01' HAVING count(*) > 0", lambda df: quality.future_dates(df, "1998-01-01"))
_check("v5", "invalid_campaign_types", "SELECT 'invalid_campaign_types' AS \"check\", 'warning' AS severity, channel AS subject, count(*) AS count, 'Channel ' || '''' || channel || '''' || ' has ' || count(*) || ' rows with unrecognized campaign types: [' || string_agg(DISTINCT CASE WHEN campaign_type IS NULL THEN 'None' ELSE '''' || campaign_type || '''' END, ', ') || ']. These may indicate new campaign structures.' AS message FROM flawed WHERE " + " OR ".join(f"(channel = '{c}' AND coalesce(campaign_type NOT IN ({', '.join(repr(t) for t in types)}), true))" for c, types in ALLOWED.items()) + " GROUP BY channel", lambda df: quality.invalid_campaign_types(df, ALLOWED))
_check("v6", "budget_consistency", _count("budget_consistency", "daily_budget > 0 AND spend > daily_budget", f"'Found ' || n || ' rows (' || {_SHARE} || ') where spend exceeds daily budget. This may indicate budget changes not captured in data.'"), quality.budget_consistency)
_check("v7", "zero_activity", _count("zero_activity", "spend = 0 AND impressions = 0", f"'Found ' || n || ' rows (' || {_SHARE} || ') with zero spend and zero impressions. These provide no signal.'"), quality.zero_activity)
_check("v8", "channel_coverage", "SELECT 'channel_coverage' AS \"check\", 'error' AS severity, subject, 0::BIGINT AS count, 'Channel ' || '''' || subject || '''' || ' is missing from the data. Forecasts for this channel will not be generated.' AS message FROM (VALUES ('google'), ('tiktok')) t(subject) WHERE subject NOT IN (SELECT channel FROM flawed)", lambda df: quality.channel_coverage(df, ("google", "tiktok")))


def _first(check: str, condition: str, value: str) -> str:
    return f"SELECT '{check}' AS \"check\", string_agg(v, ',' ORDER BY date, campaign_id, v) AS samples FROM (SELECT date, campaign_id, {value} AS v FROM flawed WHERE {condition} ORDER BY date, campaign_id, v LIMIT 5)"


_PLACE = "date::VARCHAR || '/' || campaign_id"


@query(
    "o2_samples",
    f"WITH {FLAWED} " + " UNION ALL ".join([
        _first("negative_spend", "spend < 0", "spend::VARCHAR"), _first("future_dates", "date > DATE '1998-01-01'", "date::VARCHAR"), _first("zero_activity", "spend = 0 AND impressions = 0", _PLACE),
        f"SELECT 'missing_values/' || subject, string_agg(v, ',' ORDER BY v) FROM (SELECT 'spend' AS subject, {_PLACE} AS v FROM flawed WHERE spend IS NULL ORDER BY v LIMIT 3) GROUP BY subject",
    ]),
)
def _(spark, sf):
    df = flawed(settled(spark, sf))
    found = quality.negative_spend(df)[0].unionByName(quality.future_dates(df, "1998-01-01")[0]).unionByName(quality.zero_activity(df)[0]).unionByName(quality.missing_values(df)[0].where("subject = 'spend'"))
    return found.select(F.concat_ws("/", "check", F.when(F.col("subject") != "", F.col("subject"))).alias("check"), F.array_join("samples", ",").alias("samples"))


@query("v9_statistics", f"WITH {FLAWED} SELECT count(*) AS rows_before, (SELECT count(*) FROM (SELECT DISTINCT * FROM flawed)) AS rows_after, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM flawed)) AS rows_removed, count(DISTINCT campaign_id) AS campaigns, count(DISTINCT channel) AS channels, min(date) AS first_date, max(date) AS last_date FROM flawed")
def _(spark, sf):
    return quality.validate(flawed(unified(spark, sf)), ALLOWED).statistics

@query("v1_v8_all_checks", f"WITH {FLAWED} SELECT 'missing_values' AS \"check\", CASE WHEN n::DOUBLE / t > 0.3::DOUBLE THEN 'error' ELSE 'warning' END AS severity, subject, n AS count FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS subject, count(*) FILTER (WHERE {c} IS NULL) AS n, count(*) AS t FROM flawed" for c in COLUMNS) + f""") WHERE n > 0
UNION ALL SELECT 'negative_spend', 'warning', '', count(*) FROM flawed WHERE spend < 0 HAVING count(*) > 0
UNION ALL SELECT 'duplicate_rows', CASE WHEN (t - k)::DOUBLE / t > 0.05::DOUBLE THEN 'error' ELSE 'warning' END, '', t - k FROM (SELECT count(*) AS t FROM flawed), (SELECT count(*) AS k FROM (SELECT DISTINCT * FROM flawed)) WHERE t > k
UNION ALL SELECT 'future_dates', CASE WHEN count(*) > 7 THEN 'error' ELSE 'warning' END, '', count(*) FROM (SELECT DISTINCT * FROM flawed) WHERE date > DATE '1998-01-01' HAVING count(*) > 0
UNION ALL SELECT 'invalid_campaign_types', 'warning', channel, count(*) FROM (SELECT DISTINCT * FROM flawed) WHERE date <= DATE '1998-01-01' AND ({" OR ".join(f"(channel = '{c}' AND coalesce(campaign_type NOT IN ({', '.join(repr(t) for t in types)}), true))" for c, types in ALLOWED.items())}) GROUP BY channel
UNION ALL SELECT 'budget_consistency', 'warning', '', count(*) FROM (SELECT DISTINCT * FROM flawed) WHERE date <= DATE '1998-01-01' AND daily_budget > 0 AND greatest(spend, 0) > daily_budget AND spend IS NOT NULL HAVING count(*) > 0
UNION ALL SELECT 'zero_activity', 'warning', '', count(*) FROM (SELECT DISTINCT * FROM flawed) WHERE date <= DATE '1998-01-01' AND spend <= 0 AND impressions = 0 HAVING count(*) > 0
UNION ALL SELECT 'channel_coverage', 'warning', '', 0""")
def _(spark, sf):
    """The chain as a whole, with a reference date; all three channels have rows."""
    return quality.validate(flawed(unified(spark, sf)), ALLOWED, reference="1998-01-01").issues.select("check", "severity", "subject", "count")


@query("p1_sparse_rows", f"WITH {BUILT} SELECT campaign_id, date FROM built")
def _(spark, sf):
    return features.build(unified(spark, sf)).select("campaign_id", "date")


@query("p2_history", f"WITH {FACT}, e AS (SELECT *, count(*) OVER (PARTITION BY campaign_id) AS n FROM fact) SELECT campaign_id, date FROM e WHERE n >= 520")
def _(spark, sf):
    return features.with_history(unified(spark, sf), 520).select("campaign_id", "date")


@query("p3_k4_holdout", f"WITH {FACT}{HOLDOUT} SELECT 'train' AS part, campaign_id, count(*) AS n, max(date) AS last FROM train GROUP BY ALL UNION ALL SELECT 'actuals', campaign_id, count(*), max(date) FROM actuals GROUP BY ALL")
def _(spark, sf):
    parts = zip(("train", "actuals"), uncertainty.holdout(settled(spark, sf)), strict=True)
    a, b = (df.groupBy(F.lit(n).alias("part"), "campaign_id").agg(F.count("*").alias("n"), F.max("date").alias("last")) for n, df in parts)
    return a.unionByName(b)


# --- joins ---


@query("j1_pairs", f"WITH {PAIRS} SELECT entity_id, channel, horizon, date, actual, {rs(('p10', 'p50', 'p90'), 4)} FROM pairs")
def _(spark, sf):
    return held_pairs(spark, sf).select("entity_id", "channel", "horizon", "date", "actual", *(r(c, 4) for c in ("p10", "p50", "p90")))


@query("j2_j9_expected_future", f"WITH {POINTS}, means AS (SELECT campaign_id, isodow(date) - 1 AS dow, " + ", ".join(f"avg({m}) AS {m}" for m in DYNAMIC) + " FROM hist GROUP BY ALL), overall AS (SELECT campaign_id, " + ", ".join(f"avg({m}) AS o_{m}" for m in DYNAMIC) + " FROM means GROUP BY ALL) SELECT d.campaign_id, d.step, d.date, " + ", ".join(f"round(coalesce(m.{m}, o.o_{m}), 4) AS {m}" for m in DYNAMIC) + " FROM days d LEFT JOIN means m ON m.campaign_id = d.campaign_id AND m.dow = isodow(d.date) - 1 LEFT JOIN overall o ON o.campaign_id = d.campaign_id")
def _(spark, sf):
    own = forecast.expected_future(forecast.eligible(unified(spark, sf)))
    return own.select("campaign_id", "step", "date", *(F.round(F.col(m), 4).alias(m) for m in DYNAMIC))


@query("j3_m4_seasonal_naive", f"WITH {POINTS} SELECT campaign_id, step, date, round(naive, 6) AS naive FROM model")
def _(spark, sf):
    fact = settled(spark, sf)
    return forecast.naive_predict(forecast.future_days(forecast.eligible(fact)), forecast.naive_fit(fact)).select("campaign_id", "step", "date", r("naive"))


@query("j7_orphans", f"WITH {POINTS}{base_sql('fact')} SELECT entity_id, round(sum(p50), 2) AS p50_total FROM points WHERE entity_id NOT IN (SELECT entity_id FROM base WHERE channel <> 'bing') GROUP BY ALL")
def _(spark, sf):
    fact = settled(spark, sf)
    return scenario.revenue_by_entity(points_of(fact)).join(B.baselines(fact).where("channel <> 'bing'"), "entity_id", "left_anti").select("entity_id", r("p50_total", 2))


@query("j8_known_campaigns", f"WITH {FACT}{base_sql('fact')} SELECT entity_id FROM base WHERE channel = 'meta'")
def _(spark, sf):
    fact = placed(spark, sf)
    base = written(B.baselines(fact))
    return decision.recommend(assessed_of(fact, base), base.where("channel = 'meta'")).select("entity_id")


@query("j10_scenario_grid", f"WITH {FACT}{base_sql('fact')}{NAMED} SELECT scenario, entity_id, relative FROM base, named WHERE relative IS NOT NULL")
def _(spark, sf):
    return scenario.default_adjustments(B.baselines(unified(spark, sf))).select("scenario", "entity_id", "relative")


@query("j11_a17_coverage_by_series", f"WITH {PAIRS} SELECT s.entity_id, s.horizon, round(coalesce(avg((actual BETWEEN p10 AND p90)::INT::DOUBLE), 0), 8) AS coverage FROM (SELECT DISTINCT entity_id, horizon FROM points) s LEFT JOIN pairs p ON p.entity_id = s.entity_id AND p.horizon = s.horizon GROUP BY ALL")
def _(spark, sf):
    train, actuals = uncertainty.holdout(placed(spark, sf))
    return uncertainty.coverage_by_series(points_of(train), actuals).select("entity_id", "horizon", r("coverage", 8))


# --- aggregations ---


@query("a1_baselines", f"WITH {FACT}{base_sql('fact')} SELECT {', '.join(BASE_COLUMNS)} FROM base")
def _(spark, sf):
    return B.baselines(unified(spark, sf))


@query("a2_weekday_means", f"WITH {FACT}, r AS (SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY date DESC) AS rn FROM fact) SELECT campaign_id, (isodow(date) - 1)::INT AS dow, " + ", ".join(f"avg({m}) AS {m}" for m in DYNAMIC) + " FROM r WHERE rn <= 90 GROUP BY ALL")
def _(spark, sf):
    return forecast.weekday_means(features.last_rows(unified(spark, sf), 90))


@query("a3_seasonal_baseline", f"WITH {POINTS} SELECT campaign_id, baseline FROM nb")
def _(spark, sf):
    return forecast.naive_fit(settled(spark, sf))[0]


@query("a4_weekday_pattern", f"WITH {POINTS} SELECT campaign_id, dow::INT AS dow, pattern FROM np")
def _(spark, sf):
    return forecast.naive_fit(settled(spark, sf))[1]


_SERIES_NUMBERS = ("avg_interval_width", "avg_relative_width", "confidence_score", "volatility", "early", "mid", "late")


@query("a5_a7_series_uncertainty", f"WITH {UNCERTAIN} SELECT entity_id, channel, horizon, stability_trend, {rs(_SERIES_NUMBERS)} FROM series")
def _(spark, sf):
    return uncertainty.by_series(points_of(settled(spark, sf))).select("entity_id", "channel", "horizon", "stability_trend", *map(r, _SERIES_NUMBERS))


@query("a8_entity_uncertainty", f"WITH {UNCERTAIN} SELECT entity_id, channel, stability_trend, {rs(_SERIES_NUMBERS[:4])} FROM entities")
def _(spark, sf):
    return entities_of(settled(spark, sf)).select("entity_id", "channel", "stability_trend", *map(r, _SERIES_NUMBERS[:4]))


@query("a9_channel_uncertainty", f"WITH {UNCERTAIN} SELECT channel, round(avg(confidence_score), 6) AS avg_confidence, round(avg(volatility), 6) AS avg_volatility, count(*) AS campaign_count, list_aggregate(coalesce(list(entity_id ORDER BY entity_id) FILTER (WHERE confidence_score < 0.5::DOUBLE), []), 'string_agg', ',') AS high FROM entities GROUP BY channel")
def _(spark, sf):
    own = uncertainty.by_channel(entities_of(settled(spark, sf)))
    return own.select("channel", r("avg_confidence"), r("avg_volatility"), "campaign_count", F.when(F.size("high_uncertainty_campaigns") > 0, F.array_join("high_uncertainty_campaigns", ",")).alias("high"))


@query("a10_overall_uncertainty", f"WITH {UNCERTAIN} SELECT round(avg(confidence_score), 6) AS overall_confidence, round(avg(volatility), 6) AS overall_volatility, count(*) FILTER (WHERE confidence_score < 0.5::DOUBLE) AS high_uncertainty_count FROM entities")
def _(spark, sf):
    return uncertainty.overall(entities_of(settled(spark, sf))).select(r("overall_confidence"), r("overall_volatility"), "high_uncertainty_count")


@query("a11_revenue_by_entity", f"WITH {POINTS} SELECT entity_id, round(sum(p50), 2) AS p50_total FROM points GROUP BY ALL")
def _(spark, sf):
    return scenario.revenue_by_entity(points_of(settled(spark, sf))).select("entity_id", r("p50_total", 2))


@query("a12_m8_scenarios_by_forecast", f"WITH {POINTS}{base_sql('fact')}{NAMED}, rev AS (SELECT sum(p50) AS revenue FROM points), spends AS (SELECT scenario, sum(bround * 90) AS spend FROM (SELECT scenario, round_even(greatest(0.0::DOUBLE, last_daily_budget * (1 + coalesce(relative, 0))), 2) AS bround FROM base JOIN (SELECT DISTINCT entity_id FROM points) USING (entity_id), named) GROUP BY scenario) SELECT scenario, round(revenue, 1) AS projected_revenue, round(spend, 1) AS projected_spend, round(revenue / spend, 6) AS projected_roas FROM rev, spends")
def _(spark, sf):
    fact = settled(spark, sf)
    own = scenario.simulate(written(B.baselines(fact)), scenario.scenarios(spark), model=models.WeekdayQuantiles().fit(fact), feature_df=fact)
    return own.select("scenario", r("projected_revenue", 1), r("projected_spend", 1), r("projected_roas"))


BY_SPEND = POINTS + base_sql("fact") + NAMED + """,
sw AS (SELECT campaign_id, isodow(date) - 1 AS dow, avg(spend) AS spend FROM hist GROUP BY ALL), sa AS (SELECT campaign_id, avg(spend) AS spend FROM sw GROUP BY ALL),
returns AS (SELECT campaign_id, quantile_cont(revenue / spend, 0.1::DOUBLE) AS r10, quantile_cont(revenue / spend, 0.5::DOUBLE) AS r50, quantile_cont(revenue / spend, 0.9::DOUBLE) AS r90 FROM fact WHERE spend > 0 GROUP BY ALL),
budgets AS (SELECT scenario, entity_id, last_daily_budget AS old, round_even(greatest(0.0::DOUBLE, last_daily_budget * (1 + coalesce(relative, 0))), 2) AS budget FROM base, named),
days8 AS (SELECT scenario, budget, naive, step, r10, r50, r90, coalesce(sw.spend, sa.spend) * CASE WHEN old > 0 THEN greatest(0.1::DOUBLE, least(5.0::DOUBLE, budget / old)) ELSE 1 END AS spend
  FROM model m JOIN budgets b ON b.entity_id = m.campaign_id LEFT JOIN sw ON sw.campaign_id = m.campaign_id AND sw.dow = isodow(m.date) - 1 LEFT JOIN sa ON sa.campaign_id = m.campaign_id LEFT JOIN returns r ON r.campaign_id = m.campaign_id),
mixed8 AS (SELECT scenario, budget, step, greatest(0.0::DOUBLE, list_sort([0.5::DOUBLE * coalesce(r10 * spend, 0) + 0.5::DOUBLE * naive, 0.5::DOUBLE * coalesce(r50 * spend, 0) + 0.5::DOUBLE * naive, 0.5::DOUBLE * coalesce(r90 * spend, 0) + 0.5::DOUBLE * naive])[2]) AS p50 FROM days8)
SELECT scenario, round(sum(p50 * CASE WHEN step <= 30 THEN 3 WHEN step <= 60 THEN 2 ELSE 1 END), 1) AS projected_revenue, round(sum(budget), 1) AS projected_spend, round(sum(p50 * CASE WHEN step <= 30 THEN 3 WHEN step <= 60 THEN 2 ELSE 1 END) / sum(budget), 6) AS projected_roas FROM mixed8 GROUP BY scenario"""


@query("m8_scenarios_by_spend", f"WITH {BY_SPEND}")
def _(spark, sf):
    fact = settled(spark, sf)
    own = scenario.simulate(written(B.baselines(fact)), scenario.scenarios(spark), model=models.SpendQuantiles().fit(fact), feature_df=fact)
    return own.select("scenario", r("projected_revenue", 1), r("projected_spend", 1), r("projected_roas"))


@query("a13_m9_scenarios_by_formula", f"WITH {POINTS}{base_sql('fact')}{NAMED}, tot AS (SELECT entity_id, sum(p50) AS p50 FROM points GROUP BY ALL), x AS (SELECT scenario, relative, b.*, p50, greatest(0.0::DOUBLE, total_spend + coalesce(total_spend * relative, 0)) AS new FROM base b LEFT JOIN tot USING (entity_id), named), y AS (SELECT scenario, sum(coalesce(p50, total_revenue) + CASE WHEN relative IS NULL THEN 0 ELSE (new - total_spend) * historical_roas * (1 / (1 + abs(new - total_spend) / (3 * total_spend + 1e-9::DOUBLE))) END) AS revenue, sum(new) AS spend FROM x GROUP BY scenario) SELECT scenario, round(revenue, 1) AS projected_revenue, round(spend, 1) AS projected_spend, round(revenue / spend, 6) AS projected_roas FROM y")
def _(spark, sf):
    fact = settled(spark, sf)
    own = scenario.simulate(written(B.baselines(fact)), scenario.scenarios(spark), points=points_of(fact))
    return own.select("scenario", r("projected_revenue", 1), r("projected_spend", 1), r("projected_roas"))


def _two_adjustments(fact: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Baselines, and for each google campaign first 100 more, then 10 % more."""
    base = B.baselines(fact)
    both = F.explode(F.array(*(F.struct(F.lit(i).alias("seq"), F.lit(a).cast("double").alias("absolute"), F.lit(x).cast("double").alias("relative")) for i, (a, x) in enumerate(((100.0, None), (None, 0.1))))))
    return base, base.where("channel = 'google'").select(F.lit("both").alias("scenario"), "entity_id", both.alias("x")).select("scenario", "entity_id", "x.*")


@query("j6_last_adjustment", f"WITH {FACT}{base_sql('fact')}, x AS (SELECT entity_id, last_daily_budget AS b, CASE WHEN channel = 'google' THEN round_even(last_daily_budget * 1.1::DOUBLE, 2) ELSE round_even(last_daily_budget, 2) END AS new FROM base) SELECT 'both' AS scenario, entity_id AS campaign_id, round(new, 1) AS daily_budget, round(CASE WHEN b > 0 THEN greatest(0.1::DOUBLE, least(5.0::DOUBLE, new / b)) ELSE 1 END, 6) AS spend_multiplier FROM x")
def _(spark, sf):
    base, changes = _two_adjustments(settled(spark, sf))
    return scenario.budget_map(base, changes, changes).select("scenario", "campaign_id", r("daily_budget", 1), r("spend_multiplier"))


@query("j6_adjustments_add_up", f"WITH {POINTS}{base_sql('fact')}, tot AS (SELECT entity_id, sum(p50) AS p50 FROM points GROUP BY ALL), x AS (SELECT 'both' AS scenario, CASE WHEN channel = 'google' THEN 1 END AS relative, b.*, p50, greatest(0.0::DOUBLE, total_spend + CASE WHEN channel = 'google' THEN 100 + total_spend * 0.1::DOUBLE ELSE 0 END) AS new FROM base b LEFT JOIN tot USING (entity_id)), y AS (SELECT scenario, sum(coalesce(p50, total_revenue) + CASE WHEN relative IS NULL THEN 0 ELSE (new - total_spend) * historical_roas * (1 / (1 + abs(new - total_spend) / (3 * total_spend + 1e-9::DOUBLE))) END) AS revenue, sum(new) AS spend FROM x GROUP BY scenario) SELECT scenario, round(revenue, 1) AS projected_revenue, round(spend, 1) AS projected_spend, round(revenue / spend, 6) AS projected_roas FROM y")
def _(spark, sf):
    fact = settled(spark, sf)
    base, named = _two_adjustments(fact)
    own = scenario.simulate(base, named.select("scenario").distinct(), named, points=points_of(fact))
    return own.select("scenario", r("projected_revenue", 1), r("projected_spend", 1), r("projected_roas"))


@query("s12_simulation_report", f"WITH {POINTS}{base_sql('fact')}{NAMED}, tot AS (SELECT entity_id, sum(p50) AS p50 FROM points GROUP BY ALL), x AS (SELECT scenario, relative, b.*, p50, greatest(0.0::DOUBLE, total_spend + coalesce(total_spend * relative, 0)) AS new FROM base b LEFT JOIN tot USING (entity_id), named), y AS (SELECT scenario, sum(coalesce(p50, total_revenue) + CASE WHEN relative IS NULL THEN 0 ELSE (new - total_spend) * historical_roas * (1 / (1 + abs(new - total_spend) / (3 * total_spend + 1e-9::DOUBLE))) END) AS revenue, sum(new) AS spend FROM x GROUP BY scenario) SELECT scenario, round_even(revenue, 2) AS projected_revenue, round_even(spend, 2) AS projected_spend, round_even(revenue / spend, 2) AS projected_roas FROM y")
def _(spark, sf):
    fact = settled(spark, sf)
    return report.simulations(scenario.simulate(written(B.baselines(fact)), scenario.scenarios(spark), points=points_of(fact)))


@query("a14_cost_inflation", f"WITH {FLAWED}{HALVES.format(source='(SELECT DISTINCT * FROM flawed)')} SELECT entity_id, early_ratio, late_ratio, cost_inflation FROM inflation")
def _(spark, sf):
    return B.cost_inflation(flawed(unified(spark, sf)).distinct())


@query("a15_decision_summary", f"WITH {ALLOCATED} SELECT sum(total_spend) AS total_current_budget, (SELECT round(sum(allocation), 1) FROM allocation) AS total_recommended_budget, (SELECT count(*) FROM assessed) AS campaigns_assessed, (SELECT count(*) FROM assessed WHERE len(flags) > 0) AS campaigns_flagged, (SELECT sum(len(flags))::BIGINT FROM assessed) AS total_flags FROM base")
def _(spark, sf):
    fact = placed(spark, sf)
    base = written(B.baselines(fact))
    assessed = assessed_of(fact, base)
    own = decision.summary(assessed, decision.recommend(assessed, base), base)
    return own.select("total_current_budget", r("total_recommended_budget", 1), "campaigns_assessed", "campaigns_flagged", "total_flags")


@query("a16_a18_coverage", f"WITH {PAIRS} SELECT count(*) AS n_pairs, count(*) FILTER (WHERE actual BETWEEN p50 - 1.5::DOUBLE * ((p90 - p10) / 2) AND p50 + 1.5::DOUBLE * ((p90 - p10) / 2)) AS inside, round(abs(inside / n_pairs - 0.8::DOUBLE), 8) AS calibration_error FROM pairs")
def _(spark, sf):
    return uncertainty.coverage(held_pairs(spark, sf), 1.5).select("n_pairs", "inside", F.round(F.abs(F.col("coverage") - X.d(0.8)), 8).alias("calibration_error"))


@query("a19_reliability", f"WITH {PAIRS}, b AS (SELECT floor(least(score, 5.0::DOUBLE) / 0.5::DOUBLE)::INT + 1 AS bin, count(*) AS n FROM scores GROUP BY ALL) SELECT t.bin::INT AS bin, (t.bin - 0.5::DOUBLE) * 0.5::DOUBLE AS center, coalesce(n, 0) AS count, CASE WHEN n IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS empirical FROM range(1, 11) t(bin) LEFT JOIN b USING (bin)")
def _(spark, sf):
    return uncertainty.reliability(held_pairs(spark, sf))


@query("a20_distinct_counts", f"WITH {FACT} SELECT channel, count(DISTINCT campaign_id) AS campaigns, count(DISTINCT date) AS days FROM fact GROUP BY channel")
def _(spark, sf):
    return unified(spark, sf).groupBy("channel").agg(F.countDistinct("campaign_id").alias("campaigns"), F.countDistinct("date").alias("days"))


# --- windows and order ---

_MEANS = [f"{m}_roll_mean_{n}" for m in METRICS for n in features.ROLLING]
_STDS = [f"{m}_roll_std_{n}" for m in METRICS for n in features.ROLLING]


@query("w1_rolling_mean", f"WITH {FEATURES} SELECT campaign_id, date, {rs(_MEANS, 6)} FROM feat")
def _(spark, sf):
    return features.in_batches(unified(spark, sf).select("campaign_id", *features.TIE_BREAK), lags=(), kinds=("mean",), places=dict.fromkeys(_MEANS, 6)).select("campaign_id", "date", *_MEANS)


@query("w2_rolling_std", f"WITH {FEATURES} SELECT campaign_id, date, {rs(_STDS, 3)} FROM feat")
def _(spark, sf):
    return features.in_batches(unified(spark, sf).select("campaign_id", *features.TIE_BREAK), lags=(), kinds=("std",), places=dict.fromkeys(_STDS, 3)).select("campaign_id", "date", *_STDS)


_LAGS = [f"{m}_lag_{k}" for m in METRICS for k in features.LAGS]


_YEAR = [f"{m}_roll_{k}_{n}" for m in ("spend", "revenue") for n in (90, 365) for k in ("mean", "std")]


def _frames(metrics: tuple[str, ...], sizes: tuple[int, ...], by: str) -> str:
    """Means and deviations over the rows before, as SQL columns, with their windows."""
    order = ", ".join(("date", *METRICS))
    own = ", ".join(f"round(CASE WHEN count({m}) OVER w{n} >= 2 THEN avg({m}) OVER w{n} END, 8) AS {m}_roll_mean_{n}, round(coalesce(CASE WHEN count({m}) OVER w{n} >= 2 THEN stddev_samp({m}) OVER w{n} END, 0.0::DOUBLE), 2) AS {m}_roll_std_{n}" for m in metrics for n in sizes)
    return f"{own} FROM fact WINDOW o AS (PARTITION BY {by} ORDER BY {order}), " + ", ".join(f"w{n} AS (PARTITION BY {by} ORDER BY {order} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" for n in sizes)


@query("w1_w2_long_windows", f"WITH {FACT} SELECT campaign_id, date, {_frames(('spend', 'revenue'), (90, 365), 'campaign_id')}")
def _(spark, sf):
    return features.rolling_features(unified(spark, sf), (90, 365)).select("campaign_id", "date", *(r(c, 2 if "_std_" in c else 8) for c in _YEAR))


_LONG = [f"spend_roll_{k}_{n}" for n in (14, 30) for k in ("mean", "std")]


@query("w1_w3_long_series", f"WITH {FACT} SELECT campaign_id, channel, date, spend, lag(spend, 30) OVER o AS spend_lag_30, {_frames(('spend',), (14, 30), 'channel')}")
def _(spark, sf):
    """A channel's rows as one series, cut into ranges of 2,000 rows."""
    fact = unified(spark, sf).select("channel", *features.TIE_BREAK, F.col("campaign_id").alias("_own"), F.col("channel").alias("campaign_id"))
    places = {c: 2 if "_std_" in c else 8 for c in _LONG}
    out = features.in_ranges(fact, lambda x: features.in_batches(x, (14, 30), (30,), metrics=("spend",), places=places), 30, 2000)
    return out.select(F.col("_own").alias("campaign_id"), "channel", "date", "spend", "spend_lag_30", *_LONG)


@query("w3_lags", f"WITH {FEATURES} SELECT campaign_id, date, {', '.join(f'{c}::DOUBLE AS {c}' for c in _LAGS)} FROM feat")
def _(spark, sf):
    return features.lag_features(unified(spark, sf)).select("campaign_id", "date", *(F.col(c).cast("double").alias(c) for c in _LAGS))


@query("w4_last_rows", f"WITH {FACT}, x AS (SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY date DESC) AS rn FROM fact) SELECT campaign_id, date, revenue FROM x WHERE rn <= 14")
def _(spark, sf):
    return features.last_rows(unified(spark, sf), 14).select("campaign_id", "date", "revenue")


@query("w5_all_but_last_rows", f"WITH {FACT}, x AS (SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY date DESC) AS rn FROM fact) SELECT campaign_id, count(*) AS n, max(date) AS last FROM x WHERE rn > 14 GROUP BY ALL")
def _(spark, sf):
    return features.all_but_last_rows(unified(spark, sf), 14).groupBy("campaign_id").agg(F.count("*").alias("n"), F.max("date").alias("last"))


@query("w6_zero_revenue_runs", f"WITH {FLAWED}{ISLANDS.format(source='(SELECT DISTINCT * FROM flawed)')} SELECT entity_id, longest_zero_run, longest_zero_run >= 5 AS zero_revenue FROM zero_runs")
def _(spark, sf):
    return B.zero_revenue(flawed(unified(spark, sf)).distinct(), 5)


@query("w8_last_row", f"WITH {FACT}{base_sql('fact')} SELECT entity_id, last_daily_spend, last_daily_budget, campaign_type FROM base")
def _(spark, sf):
    return B.baselines(unified(spark, sf)).select("entity_id", "last_daily_spend", "last_daily_budget", "campaign_type")


@query("w9_future_features", f"WITH {POINTS}, means AS (SELECT campaign_id, isodow(date) - 1 AS dow, avg(revenue) AS revenue FROM hist GROUP BY ALL), fut AS (SELECT d.campaign_id, d.date, d.step, m.revenue FROM days d JOIN means m ON m.campaign_id = d.campaign_id AND m.dow = isodow(d.date) - 1), u AS (SELECT campaign_id, date, 0 AS step, revenue FROM hist UNION ALL SELECT campaign_id, date, step, revenue FROM fut), f AS (SELECT campaign_id, step::INT AS step, CASE WHEN count(revenue) OVER w >= 2 THEN avg(revenue) OVER w END AS m, lag(revenue, 14) OVER o AS l FROM u WINDOW o AS (PARTITION BY campaign_id ORDER BY date), w AS (o ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)) SELECT campaign_id, step, round(m, 3) AS revenue_roll_mean_30, round(l, 3) AS revenue_lag_14 FROM f WHERE step > 0")
def _(spark, sf):
    history = written(forecast.eligible(unified(spark, sf)))  # read several times
    return forecast.future_features(history, forecast.expected_future(history)).select("campaign_id", "step", r("revenue_roll_mean_30", 3), r("revenue_lag_14", 3))


_FUTURE = (
    "means AS (SELECT campaign_id, isodow(date) - 1 AS dow, " + ", ".join(f"avg({m}) AS {m}" for m in DYNAMIC) + " FROM hist GROUP BY ALL), "
    "overall AS (SELECT campaign_id, " + ", ".join(f"avg({m}) AS {m}" for m in DYNAMIC) + " FROM means GROUP BY ALL), "
    "budget AS (SELECT campaign_id, arg_max(daily_budget, date) AS daily_budget FROM hist GROUP BY ALL), "
    "both_days AS (SELECT campaign_id, date, 0 AS step, " + ", ".join(f"{m}::DOUBLE AS {m}" for m in METRICS) + " FROM hist UNION ALL SELECT d.campaign_id, d.date, d.step, " + ", ".join(f"coalesce(m.{x}, o.{x})" for x in DYNAMIC) + ", b.daily_budget FROM days d LEFT JOIN means m ON m.campaign_id = d.campaign_id AND m.dow = isodow(d.date) - 1 JOIN overall o ON o.campaign_id = d.campaign_id JOIN budget b ON b.campaign_id = d.campaign_id)"
)
#: Places that all features are compared to: sums of weekday means are not exact.
_PLACES = {c: 0 if c in features.TIME else 7 if c in features.RATIOS else 4 if "_std_" in c else 5 for c in features.feature_names()}


@query("w9_all_future_features", f"WITH {POINTS}, {_FUTURE}, all_days AS (SELECT *, {TIME_SQL}, {RATIO_SQL}, {ROLL_SQL}, {LAG_SQL} FROM both_days {WINDOWS_SQL}) SELECT campaign_id, step::INT AS step, " + ", ".join(f"round({c}, {n}) AS {c}" if n else c for c, n in _PLACES.items()) + " FROM all_days WHERE step > 0")
def _(spark, sf):
    history = written(forecast.eligible(unified(spark, sf)))  # read several times
    own = forecast.future_features(history, forecast.expected_future(history), places={c: n for c, n in _PLACES.items() if n})
    return own.select("campaign_id", "step", *_PLACES)


@query("o1_sorted", f"WITH {FACT} SELECT campaign_id, date, revenue FROM fact ORDER BY campaign_id, date")
def _(spark, sf):
    return unified(spark, sf).select("campaign_id", "date", "revenue").orderBy("campaign_id", "date")


@query("o3_conformal_alpha", f"WITH {PAIRS} SELECT round(alpha, 6) AS alpha FROM alpha")
def _(spark, sf):
    return uncertainty.order_statistic(uncertainty.scored(held_pairs(spark, sf)), least=10).select(r("alpha"))


@query("o4_capped_alpha", f"WITH {PAIRS}, cap AS (SELECT quantile_cont(score, 0.5::DOUBLE) AS c FROM scores) SELECT round(list_sort(list(least(greatest(score, 0.0::DOUBLE), c)))[least(ceil((count(*) + 1) * 0.8::DOUBLE)::BIGINT, count(*))], 6) AS alpha FROM scores, cap")
def _(spark, sf):
    return uncertainty.order_statistic(uncertainty.scored(held_pairs(spark, sf)), cap_percentile=50.0).select(r("alpha"))


@query("u1_union_all", f"WITH {FACT} SELECT channel, count(*) AS n FROM (SELECT * FROM fact UNION ALL SELECT * FROM fact WHERE channel = 'meta') GROUP BY channel")
def _(spark, sf):
    fact = settled(spark, sf)
    return fact.unionByName(fact.where("channel = 'meta'")).groupBy("channel").agg(F.count("*").alias("n"))


@query("u_own_features", f"WITH {FACT}, last90 AS (SELECT campaign_id, revenue, row_number() OVER (PARTITION BY campaign_id ORDER BY date) AS i FROM (SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY date DESC) AS rn FROM fact) WHERE rn <= 90) SELECT a.campaign_id AS entity_id, round(median((b.revenue - a.revenue) / (b.i - a.i)), 6) AS trend FROM last90 a JOIN last90 b ON a.campaign_id = b.campaign_id AND a.i < b.i GROUP BY ALL")
def _(spark, sf):
    """A user's own feature: the median slope of the last 90 rows."""
    return hooks.trends(unified(spark, sf)).select("entity_id", r("trend"))


# --- conformal, models, decisions ---


@query("k1_normalised_residual", f"WITH {PAIRS} SELECT entity_id, horizon, date, round(score, 5) AS score FROM scores")
def _(spark, sf):
    return uncertainty.scored(held_pairs(spark, sf)).select("entity_id", "horizon", "date", r("score", 5))


@query("k2_scaling_factor", f"WITH {PAIRS} SELECT entity_id, horizon, date, round(CASE WHEN actual < p10 THEN (p50 - actual) / greatest(p50 - p10, 1e-10::DOUBLE) WHEN actual > p90 THEN (actual - p50) / greatest(p90 - p50, 1e-10::DOUBLE) ELSE 1 END, 5) AS score FROM pairs")
def _(spark, sf):
    return uncertainty.scored(held_pairs(spark, sf), "scaling_factor").select("entity_id", "horizon", "date", r("score", 5))


@query("k3_k5_calibrated_uncertainty", f"WITH {PAIRS}{forecast_sql('fact', 'f_')}{SERIES.replace('FROM points', 'FROM f_points').format(a='(SELECT alpha FROM alpha)')} SELECT entity_id, channel, stability_trend, {rs(_SERIES_NUMBERS[:4], 5)} FROM entities")
def _(spark, sf):
    fact = placed(spark, sf)
    train, actuals = uncertainty.holdout(fact)
    alpha = uncertainty.calibrate(points_of(train), actuals)
    own = uncertainty.by_entity(uncertainty.by_series(points_of(fact), alpha))
    return own.select("entity_id", "channel", "stability_trend", *(r(c, 5) for c in _SERIES_NUMBERS[:4]))


@query("m5_m7_forecast", f"WITH {POINTS} SELECT entity_id, channel, metric, horizon, step, date, {rs(('p10', 'p50', 'p90'), 4)} FROM points")
def _(spark, sf):
    return points_of(settled(spark, sf)).select("entity_id", "channel", "metric", "horizon", "step", "date", *(r(c, 4) for c in ("p10", "p50", "p90")))


@query("m1_m2_quantile_forest")
def _(spark, sf):
    built = features.build(settled(spark, sf))
    return forecast.forecast(built, models.ForestQuantiles().fit(built))


@query("m1_m2_quantile_boosting")
def _(spark, sf):
    built = features.build(settled(spark, sf))
    return forecast.forecast(built, boosting.BoostedQuantiles().fit(built))


@query("m8_scenarios_by_boosting")
def _(spark, sf):
    built = features.build(settled(spark, sf))
    return scenario.simulate(cut(B.baselines(built)), scenario.scenarios(spark), model=boosting.BoostedQuantiles().fit(built), feature_df=built)


@query("k3_k5_boosted_uncertainty")
def _(spark, sf):
    """Calibrated on the last days, which the model has not seen; its forecast of the days after them is judged."""
    train, actuals = uncertainty.holdout(features.build(settled(spark, sf)))
    points = cut(forecast.forecast(train, boosting.BoostedQuantiles().fit(train)))
    return uncertainty.by_entity(uncertainty.by_series(points, uncertainty.calibrate(points, actuals)))


@query("m11_budget_optimizer", f"WITH {ALLOCATED} SELECT a.entity_id, b.total_spend AS current_budget, round(allocation, 2) AS recommended_budget FROM allocation a JOIN base b USING (entity_id)")
def _(spark, sf):
    fact = placed(spark, sf)
    base = written(B.baselines(fact))
    own = decision.allocate(assessed_of(fact, base), base).join(base, "entity_id")
    return own.select("entity_id", F.col("total_spend").alias("current_budget"), F.round("allocation", 2).alias("recommended_budget"))


@query("m12_assessments", f"WITH {ASSESSED} SELECT entity_id, channel, campaign_type, current_spend, current_roas, stability_trend, array_to_string(flags, ',') AS flags, {rs(('confidence_score', 'volatility', 'score'))} FROM assessed")
def _(spark, sf):
    own = assessed_of(placed(spark, sf))
    return own.select("entity_id", "channel", "campaign_type", "current_spend", "current_roas", "stability_trend", F.array_join("flags", ",").alias("flags"), *map(r, ("confidence_score", "volatility", "score")))


# --- report ---


@query("s10_forecast_report", f"WITH {POINTS} SELECT entity_id, channel, horizon, metric, date::VARCHAR AS date, {evens('p10', 'p50', 'p90')} FROM points")
def _(spark, sf):
    return report.forecasts(points_of(settled(spark, sf)))


@query("p4_metric_filter", f"WITH {POINTS} SELECT 'revenue alone' AS report, metric, count(*) AS n FROM points GROUP BY ALL UNION ALL SELECT 'raw', m, count(*) FROM points, (VALUES ('revenue'), ('conversions')) t(m) GROUP BY ALL")
def _(spark, sf):
    """Points of two metrics: the report has revenue's, and all if raw ones are asked for."""
    points = points_of(settled(spark, sf))
    both = points.unionByName(points.withColumn("metric", F.lit("conversions")))
    parts = [report.forecasts(both, raw=raw).groupBy("metric").agg(F.count("*").alias("n")).select(F.lit(name).alias("report"), "metric", "n") for name, raw in (("revenue alone", False), ("raw", True))]
    return parts[0].unionByName(parts[1])


@query("s11_uncertainty_report", f"WITH {UNCERTAIN} SELECT entity_id, channel, stability_trend, {evens('confidence_score', 'volatility', 'avg_relative_width')} FROM entities")
def _(spark, sf):
    return report.uncertainty(entities_of(settled(spark, sf)))


@query("s13_recommendation_report", f"WITH {ALLOCATED} SELECT a.entity_id, a.channel, round_even(b.total_spend, 2) AS current_budget, round_even(allocation, 2) AS recommended_budget, round_even(allocation - b.total_spend, 2) AS budget_change, round_even(CASE WHEN current_roas <> 0 THEN current_roas END, 2) AS expected_roas FROM assessed a JOIN base b USING (entity_id) JOIN allocation USING (entity_id)")
def _(spark, sf):
    fact = placed(spark, sf)
    base = written(B.baselines(fact))
    return report.recommendations(decision.recommend(assessed_of(fact, base), base)).drop("rationale")


@query("s14_summary", f"WITH {ALLOCATED} SELECT (SELECT count(DISTINCT entity_id) FROM points) AS campaigns_forecasted, (SELECT round_even(sum(p50), 2) FROM points) AS total_forecast_revenue_p50, (SELECT round_even(avg(confidence_score), 2) FROM entities) AS overall_uncertainty_confidence, (SELECT round_even(avg(volatility), 2) FROM entities) AS overall_volatility, (SELECT count(*) FROM entities WHERE confidence_score < 0.5::DOUBLE) AS high_uncertainty_campaigns, 3::BIGINT AS scenarios_simulated, (SELECT count(*) FROM allocation) AS recommendations, (SELECT count(*) FROM assessed WHERE len(flags) > 0) AS campaigns_flagged, (SELECT sum(len(flags))::BIGINT FROM assessed) AS total_flags")
def _(spark, sf):
    fact = placed(spark, sf)
    points, base = written(points_of(fact)), written(B.baselines(fact))
    entities = written(uncertainty.by_entity(uncertainty.by_series(points)))
    assessed = written(decision.assess(base, entities, fact))
    return report.summary(points, uncertainty.overall(entities), scenario.simulate(base, scenario.scenarios(spark), points=points), decision.recommend(assessed, base), assessed)


# --- streams ---


def _as_files(drops: DataFrame, path: str, before: int = 0) -> int:
    """Add drops to the before files at path as their tasks have them, and tell how many are new: more rows make more files, not longer ones."""
    drops.write.mode("append").parquet(path)
    return len(drops.sparkSession.read.schema(drops.schema).parquet(path).inputFiles()) - before


@query("t1_stream_upsert", f"WITH {DROPPED} SELECT campaign_id, date, channel, spend, revenue, clicks, daily_budget FROM (SELECT *, row_number() OVER (PARTITION BY campaign_id, date ORDER BY drop_no DESC) AS rn FROM drops) WHERE rn = 1")
def _(spark, sf):
    """Every second drop, newer ones too, then the others, and a third of all once more; the stream stops in between, and its first part is compacted."""
    folder = f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}"
    drops, files = written(dropped(unified(spark, sf))), 0
    for i, part in enumerate((drops.where("drop % 2 = 1"), drops.where("drop % 2 = 0").unionByName(drops.where("drop % 3 = 0")))):
        new = _as_files(part, f"{folder}/in", files)
        files += new
        stream_fact.feed(stream_fact.read_drops(spark, f"{folder}/in", max(1, -(-new // 3))), f"{folder}/fact", f"{folder}/checkpoint").awaitTermination()
        if i == 0:
            stream_fact.compact(spark, f"{folder}/fact")
    return stream_fact.fact(spark, f"{folder}/fact").select("campaign_id", "date", "channel", "spend", "revenue", "clicks", "daily_budget")


@query("t2_running_flags", f"WITH {FLAWED}{ISLANDS.format(source='(SELECT DISTINCT * FROM flawed)')}{HALVES.format(source='(SELECT DISTINCT * FROM flawed)')} SELECT entity_id, longest_zero_run, longest_zero_run >= 5 AS zero_revenue, early_ratio, late_ratio, cost_inflation FROM zero_runs JOIN inflation USING (entity_id)")
def _(spark, sf):
    """Five drops of a year and a half; one row in ten of a drop's last week comes with the next. The stream stops after each."""
    folder = f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}"
    late = F.when(F.pmod(F.xxhash64("campaign_id", "date"), F.lit(10)) == 0, 7).otherwise(0)
    rows = written(flawed(unified(spark, sf)).distinct().withColumn("_drop", F.least(F.lit(4), F.floor((F.datediff("date", F.lit("1992-01-01").cast("date")) - late) / 560))))
    before = spark.conf.get(stream_flags.STORE[0])
    spark.conf.set(*stream_flags.STORE)
    try:
        for i in range(5):
            rows.where(F.col("_drop") == i).drop("_drop").write.mode("append").parquet(f"{folder}/in")
            stream = stream_flags.running_flags(spark.readStream.schema(rows.drop("_drop").schema).parquet(f"{folder}/in"), days=5)
            stream.writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/flags/batch={n}")).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(stream_flags.STORE[0], before)
    return stream_flags.last_flags(spark.read.parquet(f"{folder}/flags").drop("batch")).select("entity_id", "longest_zero_run", "zero_revenue", "early_ratio", "late_ratio", "cost_inflation")


@query("t4_distinct_sketches", f"WITH {DROPPED} SELECT channel, count(DISTINCT campaign_id) AS campaigns, count(DISTINCT date) AS days, true AS campaigns_close, true AS days_close FROM drops GROUP BY channel")
def _(spark, sf):
    """Exact counts, and whether those of the merged sketches of all drops lie within the stated error of them."""
    folder, by, counted = f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}", ["channel"], ["campaign_id", "date"]
    files = _as_files(dropped(unified(spark, sf)), f"{folder}/in")
    sketches.feed(stream_fact.read_drops(spark, f"{folder}/in", max(1, -(-files // 4))), f"{folder}/out", f"{folder}/checkpoint", by, counted).awaitTermination()
    guess = sketches.distinct(spark, f"{folder}/out", by, counted).select("channel", F.col("campaign_id").alias("_c"), F.col("date").alias("_d"))
    exact = spark.read.parquet(f"{folder}/in").groupBy("channel").agg(F.countDistinct("campaign_id").alias("campaigns"), F.countDistinct("date").alias("days"))
    close = [(F.abs(F.col(g) - F.col(c)) <= F.col(c) * sketches.error()).alias(f"{c}_close") for g, c in (("_c", "campaigns"), ("_d", "days"))]
    return exact.join(guess, "channel").select("channel", "campaigns", "days", *close)


# --- functions in SQL ---


@query("f1_sql_numbers", _sql["c2_lenient_numbers"])
def _(spark, sf):
    sql_functions.register(spark)
    spark.read.parquet(f"{sf}/events.parquet").createOrReplaceTempView("f1_events")
    return spark.sql("SELECT event_id, number_or_0(props) AS a, number_or_0(CASE WHEN event_id % 7 = 0 THEN 'nan' ELSE CAST(value AS STRING) END) AS b FROM f1_events")


@query("f2_sql_ratios", _sql["c8_ratios"])
def _(spark, sf):
    sql_functions.register(spark)
    unified(spark, sf).createOrReplaceTempView("f2_fact")
    return spark.sql("SELECT campaign_id, date, " + ", ".join(f"guarded_ratio({n}, {q}) AS {name}" for name, (n, q) in features.RATIOS.items()) + " FROM f2_fact")


@query("f3_sql_confidence", _sql["c12_c13_widths_and_confidence"])
def _(spark, sf):
    sql_functions.register(spark)
    points_of(settled(spark, sf)).createOrReplaceTempView("f3_points")
    return spark.sql("SELECT entity_id, horizon, round(w, 8) AS relative_width, round(confidence(w, 2D), 8) AS confidence FROM (SELECT entity_id, horizon, avg(relative_width(p10, p50, p90)) AS w FROM f3_points GROUP BY entity_id, horizon)")


@query("f4_sql_residuals", _sql["k1_normalised_residual"])
def _(spark, sf):
    sql_functions.register(spark)
    held_pairs(spark, sf).createOrReplaceTempView("f4_pairs")
    return spark.sql("SELECT entity_id, horizon, date, round(normalised_residual(actual, p10, p50, p90), 5) AS score FROM f4_pairs")


@query("f5_sql_future_days", f"WITH {FACT}, last AS (SELECT campaign_id, max(date) AS last FROM fact GROUP BY ALL) SELECT campaign_id, step::INT AS step, (last + step::INT) AS date FROM last, range(1, 91) t(step)")
def _(spark, sf):
    """Each campaign's 90 days after its last one, by a table function."""
    sql_functions.register(spark)
    unified(spark, sf).createOrReplaceTempView("f5_fact")
    return spark.sql("SELECT campaign_id, step, d.date FROM (SELECT campaign_id, max(date) AS last FROM f5_fact GROUP BY campaign_id), LATERAL days_after(last, 90) d")
