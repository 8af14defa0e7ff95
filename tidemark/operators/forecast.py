"""Quantile forecasts: a seasonal-naive part, a quantile model on features of history and expected future, and their even mix."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expressions import d, ordered_floor
from ..schema import COLUMNS, DYNAMIC, HORIZONS
from ..sessions import written
from . import features

QUANTILES = (0.1, 0.5, 0.9)


class QuantileModel(Protocol):
    """fit(features) -> self; predict(features) -> the frame with q10, q50, q90 added. One whose columns are all the fact's own needs no features."""

    def fit(self, df: DataFrame) -> QuantileModel: ...

    def predict(self, df: DataFrame) -> DataFrame: ...


# --- seasonal naive ---


def naive_fit(fact: DataFrame, window: int = 7) -> tuple[DataFrame, DataFrame]:
    """(campaign_id, baseline): the mean revenue of the last window rows. (campaign_id, dow, pattern): the means by weekday of the last 7 rows, of campaigns with 7."""
    base = features.last_rows(fact, window).groupBy("campaign_id").agg(F.avg("revenue").alias("baseline"))
    week = features.with_history(features.last_rows(fact, 7), 7)
    return base, week.groupBy("campaign_id", F.weekday("date").alias("dow")).agg(F.avg("revenue").alias("pattern"))


def naive_predict(days: DataFrame, fitted: tuple[DataFrame, DataFrame]) -> DataFrame:
    """days (campaign_id, date, ...) with naive: the weekday's pattern, else the baseline, else 0."""
    base, pattern = fitted
    out = days.withColumn("dow", F.weekday("date")).join(base, "campaign_id", "left").join(pattern, ["campaign_id", "dow"], "left")
    return out.withColumn("naive", F.coalesce("pattern", "baseline", d(0))).drop("pattern", "baseline", "dow")


# --- the days to come ---


def weekday_means(history: DataFrame) -> DataFrame:
    """campaign_id, dow, and the mean of each metric on that weekday."""
    return history.groupBy("campaign_id", F.weekday("date").alias("dow")).agg(*(F.avg(m).alias(m) for m in DYNAMIC))


def future_days(history: DataFrame, days: int = 90, per_campaign_start: bool = False) -> DataFrame:
    """campaign_id, channel, step (1 to days), date. All campaigns start after the last date of all, or each after its own."""
    last = history.groupBy("campaign_id", "channel").agg(F.max("date").alias("_own"))
    start = last.withColumn("_start", F.col("_own")) if per_campaign_start else last.crossJoin(F.broadcast(history.agg(F.max("date").alias("_start"))))  # one row
    return start.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(days)))).select("campaign_id", "channel", "step", F.date_add("_start", F.col("step")).alias("date"))


def expected_future(history: DataFrame, days: int = 90, overrides: DataFrame | None = None, per_campaign_start: bool = False) -> DataFrame:
    """The days to come with expected values: metrics are the campaign's weekday means (the mean of those for a weekday without any), names and
    the daily budget those of its last row.

    overrides (campaign_id, scenario, daily_budget, spend_multiplier): a copy of the days for each scenario, with its budget, and spend times its multiplier.
    """
    means = weekday_means(history)
    overall = means.groupBy("campaign_id").agg(*(F.avg(m).alias(f"_{m}") for m in DYNAMIC))
    last = history.groupBy("campaign_id").agg(F.max_by(F.struct("campaign_name", "campaign_type", "daily_budget"), F.struct(*features.TIE_BREAK)).alias("_last"))
    out = future_days(history, days, per_campaign_start).withColumn("dow", F.weekday("date")).join(means, ["campaign_id", "dow"], "left").join(overall, "campaign_id", "left").join(last, "campaign_id", "left")
    out = out.withColumns({m: F.coalesce(m, f"_{m}") for m in DYNAMIC}).withColumns({c: F.col(f"_last.{c}") for c in ("campaign_name", "campaign_type", "daily_budget")})
    if overrides is None:
        return out.select(*COLUMNS, "step")
    changed = out.join(overrides.select("campaign_id", "scenario", F.col("daily_budget").alias("_budget"), "spend_multiplier"), "campaign_id")
    return changed.withColumn("daily_budget", F.coalesce("_budget", "daily_budget")).withColumn("spend", F.col("spend") * F.coalesce("spend_multiplier", d(1))).select(*COLUMNS, "step", "scenario")


def future_features(history: DataFrame, future: DataFrame, windows: Sequence[int] = features.ROLLING, lags: Sequence[int] = features.LAGS, places: Mapping[str, int] | None = None) -> DataFrame:
    """Features of the future rows, over history and future together. With a scenario column each scenario has its own copy of the history. places: as for in_batches."""
    keys = ["scenario"] if "scenario" in future.columns else []
    past = history.select(*COLUMNS).withColumn("step", F.lit(0))
    if keys:
        past = past.crossJoin(F.broadcast(future.select("scenario").distinct()))  # the scenarios asked for: a handful
    both = past.select(*future.columns).unionByName(future)
    if keys:
        # a campaign in a scenario is a series of its own
        both = both.withColumn("_own", F.col("campaign_id")).withColumn("campaign_id", F.concat_ws("\u0001", "campaign_id", "scenario"))
    out = features.in_batches(features.ratio_features(features.time_features(both)), windows, lags, places=places, only="step")
    return out.withColumn("campaign_id", F.col("_own")).drop("_own") if keys else out


# --- the forecast ---


def ensemble(model: Column, naive: Column, weight: float = 0.5) -> Column:
    return d(weight) * model + d(1 - weight) * naive


def eligible(feature_df: DataFrame, least: int = 30, lookback: int = 90) -> DataFrame:
    """The last lookback rows of the campaigns with at least least rows."""
    if features.is_placed(feature_df):
        return features.last_rows(features.with_history(feature_df, least), lookback)
    order = W.partitionBy("campaign_id").orderBy(*(F.desc(c) for c in features.TIE_BREAK))  # one sort for both
    own = feature_df.withColumns({"_r": F.row_number().over(order), "_n": F.count("*").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))})
    return own.where((F.col("_r") <= lookback) & (F.col("_n") >= least)).drop("_r", "_n")


def forecast(feature_df: DataFrame, model: QuantileModel, horizons: Sequence[int] = HORIZONS, least: int = 30, lookback: int = 90, overrides: DataFrame | None = None, per_campaign_start: bool = False) -> DataFrame:
    """entity_id, channel, metric, horizon, step, date, p10, p50, p90 (and scenario), in one pass for all campaigns, horizons and scenarios.

    The shorter horizons are the first days of the longest, so only that is computed. The seasonal-naive value is the same for all quantiles.
    """
    fact = feature_df.select(*COLUMNS, *(features.PLACES if features.is_placed(feature_df) else ()))
    history = written(eligible(fact, least, lookback))  # read several times
    future = expected_future(history, max(horizons), overrides, per_campaign_start)
    plain = set(getattr(model, "columns", ["features"])) <= set(COLUMNS)
    # the last rows of the campaigns that are forecast are in their history, if that is long enough
    naive = naive_fit(history if lookback >= 7 else fact)
    predicted = naive_predict(model.predict(future if plain else future_features(history, future)), naive)
    mixed = [ensemble(F.col(q), F.col("naive")) for q in ("q10", "q50", "q90")]
    keys = ["scenario"] if overrides is not None else []
    points = predicted.select(*keys, F.col("campaign_id").alias("entity_id"), "channel", F.lit("revenue").alias("metric"), "step", "date", *ordered_floor(*mixed))
    spans = F.explode(F.filter(F.array(*(F.lit(h) for h in sorted(horizons))), lambda h: F.col("step") <= h))
    return points.withColumn("horizon", spans).select(*keys, "entity_id", "channel", "metric", "horizon", "step", "date", "p10", "p50", "p90")
