"""Conformal calibration and the uncertainty of forecasts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expressions import confidence, covered, d, nonconformity, relative_width, width
from ..sessions import cut
from . import features


def by_day(actuals: DataFrame) -> DataFrame:
    """entity_id, date, actual: the revenue of each campaign and day, of the first of repeated rows."""
    return actuals.groupBy(F.col("campaign_id").alias("entity_id"), "date").agg(F.min_by("revenue", F.struct(*features.TIE_BREAK)).alias("actual"))


def pairs(forecast: DataFrame, actuals: DataFrame, once: bool = False) -> DataFrame:
    """entity_id, channel, horizon, date, actual, p10, p50, p90: forecast points with the actual of their campaign and day, the first of repeated ones. once: one pair a
    day, not one per horizon."""
    points = forecast.where(F.col("horizon") == F.lit(forecast_least(forecast))) if once else forecast
    return points.join(by_day(actuals), ["entity_id", "date"]).select("entity_id", "channel", "horizon", "date", "actual", "p10", "p50", "p90")


def forecast_least(forecast: DataFrame) -> int:
    return forecast.agg(F.max("horizon")).first()[0] or 0


def scored(paired: DataFrame, kind: str = "normalized_residual") -> DataFrame:
    return paired.withColumn("score", F.greatest(nonconformity(kind), d(0)))


#: Scores are counted in so many buckets, and ranked within one.
BUCKETS = 1 << 14


def at_rank(scores: DataFrame, rank: DataFrame) -> DataFrame:
    """One row, value: the score at a rank from 1 on, by size. rank: one row, k. No row if there are fewer scores.

    Scores are counted by bucket of a rising function of theirs; sums of the BUCKETS counts give the bucket that holds the rank, and only that one's distinct scores are sorted.
    """
    own = scores.select("score", F.floor((F.atan("score") / F.lit(math.pi) + 0.5) * BUCKETS).alias("bucket"))
    counts = own.groupBy("bucket").count().withColumn("to", F.sum("count").over(W.orderBy("bucket")))  # BUCKETS rows at most
    hit = counts.crossJoin(F.broadcast(rank)).where("to >= k AND to - count < k").select("bucket", (F.col("k") - F.col("to") + F.col("count")).alias("left"))
    inside = own.join(F.broadcast(hit), "bucket").groupBy("score", "left").count().withColumn("to", F.sum("count").over(W.partitionBy("left").orderBy("score")))
    return inside.where("to >= left").agg(F.min("score").alias("value")).where("value IS NOT NULL")


def percentile(scores: DataFrame, share: float) -> DataFrame:
    """One row, value: the interpolated percentile, from the two scores next to its place."""
    place = scores.agg(((F.count("*") - 1) * d(share)).alias("p"))
    low, high = (at_rank(scores, place.select((f("p") + 1).alias("k"))).withColumnRenamed("value", name) for name, f in (("low", F.floor), ("high", F.ceil)))
    return place.crossJoin(low).crossJoin(high).select((F.col("low") + (F.col("high") - F.col("low")) * (F.col("p") - F.floor("p"))).alias("value"))  # one row each


def order_statistic(scores: DataFrame, target: float = 0.8, cap_percentile: float = 100.0, least: int = 0) -> DataFrame:
    """One row, alpha: the k-th smallest score, k = min(ceil((n + 1) * target), n); 1 for fewer than max(1, least) scores.

    A cap (a percentile, interpolated) clips the scores first. No task holds all scores (see at_rank).
    """
    own = cut(scores.select("score").where("score IS NOT NULL"))  # read several times
    if cap_percentile < 100:
        cap = percentile(own, cap_percentile / 100).select(F.col("value").alias("_cap"))
        own = own.crossJoin(F.broadcast(cap)).select(F.least(F.greatest("score", d(0)), "_cap").alias("score"))  # one row
    total = own.agg(F.count("*").alias("_n")).withColumn("k", F.least(F.ceil((F.col("_n") + 1) * d(target)), F.col("_n")))
    found = total.join(at_rank(own, total.select("k")), F.lit(True), "left")  # one row each
    return found.select(F.when(F.col("_n") < max(1, least), d(1)).otherwise(F.coalesce("value", d(1))).alias("alpha"))


def calibrate(forecast: DataFrame, actuals: DataFrame, target: float = 0.8, kind: str = "normalized_residual", once: bool = False) -> DataFrame:
    """One row, alpha: 1 with fewer than 10 pairs."""
    return order_statistic(scored(pairs(forecast, actuals, once), kind), target, least=10)


def coverage(paired: DataFrame, alpha: float | Column = 1.0, kind: str = "normalized_residual") -> DataFrame:
    """One row: n_pairs, inside, coverage (0 without pairs)."""
    a = alpha if isinstance(alpha, Column) else d(alpha)
    own = paired.agg(F.count("*").alias("n_pairs"), F.count_if(covered(a, kind)).alias("inside"))
    return own.withColumn("coverage", F.when(F.col("n_pairs") > 0, F.col("inside") / F.col("n_pairs")).otherwise(d(0)))


def coverage_by_series(forecast: DataFrame, actuals: DataFrame, alpha: float | None = None, kind: str = "normalized_residual") -> DataFrame:
    """entity_id, horizon, coverage of all series: raw bands without alpha; 0 where no actual meets the series.

    All points go through one left join: its left side is never broadcast, however small a file of points looks, and points are read once.
    """
    paired = forecast.join(by_day(actuals).withColumn("_met", F.lit(True)), ["entity_id", "date"], "left")
    inside = F.col("actual").between(F.col("p10"), F.col("p90")) if alpha is None else covered(d(alpha), kind)
    return paired.groupBy("entity_id", "horizon").agg(F.coalesce(F.avg(F.when(F.col("_met"), inside.cast("double"))), d(0)).alias("coverage"))


def reliability(paired: DataFrame, bins: int = 10, kind: str = "normalized_residual") -> DataFrame:
    """bin (from 1), center, count, empirical: scores in bins equal steps from 0 to 5, ends above left out of the last; a score of 5 or more is in none."""
    step = 5.0 / bins
    own = scored(paired, kind).withColumn("_s", F.least("score", d(5))).withColumn("bin", F.floor(F.col("_s") / step).cast("int") + 1)
    inside = covered(F.col("_s") * (1 + 1e-12), kind)
    met = own.groupBy("bin").agg(F.count("*").alias("count"), F.avg(inside.cast("double")).alias("empirical"))
    all_bins = paired.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return all_bins.join(met, "bin", "left").select("bin", ((F.col("bin") - 0.5) * step).alias("center"), F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("empirical", d(0)).alias("empirical"))


def trend(slope_over_mean: Column, n: Column) -> Column:
    return F.when((n >= 3) & (slope_over_mean > 0.02), "widening").when((n >= 3) & (slope_over_mean < -0.02), "narrowing").otherwise("stable")


def by_series(forecast: DataFrame, alpha: DataFrame | None = None, threshold: float = 2.0) -> DataFrame:
    """One row per campaign and horizon: widths scaled by alpha (a one-row frame), confidence, volatility, trend, and the mean relative widths of the thirds."""
    a = F.col("_alpha") if alpha is not None else d(1)
    own = forecast.crossJoin(F.broadcast(alpha.select(F.col("alpha").alias("_alpha")))) if alpha is not None else forecast  # one row
    own = own.withColumn("_raw", width()).withColumn("_rel", relative_width()).withColumn("_third", F.greatest(F.floor(F.col("horizon") / 3), F.lit(1)))
    scaled = own.withColumn("_srel", F.col("_rel") * a).withColumn("_sraw", F.col("_raw") * a)
    thirds = {"early": F.col("step") <= F.col("_third"), "mid": (F.col("step") > F.col("_third")) & (F.col("step") <= 2 * F.col("_third")), "late": F.col("step") > 2 * F.col("_third")}
    out = scaled.groupBy("entity_id", "channel", "horizon").agg(
        F.count("*").alias("_n"),
        F.avg("_sraw").alias("avg_interval_width"),
        F.avg("_srel").alias("avg_relative_width"),
        F.stddev_pop("_srel").alias("_sd"),
        F.avg("_raw").alias("_mean_raw"),
        F.regr_slope("_raw", F.col("step").cast("double")).alias("_slope"),
        *(F.coalesce(F.avg(F.when(c, F.col("_rel"))), d(0)).alias(k) for k, c in thirds.items()),
    )
    volatility = F.when((F.col("_n") < 2) | (F.col("avg_relative_width") == 0), d(0)).otherwise(F.col("_sd") / F.col("avg_relative_width"))
    slope = F.when(F.col("_mean_raw") != 0, F.col("_slope") / F.col("_mean_raw")).otherwise(d(0))
    return out.select("entity_id", "channel", "horizon", "avg_interval_width", "avg_relative_width", confidence(F.col("avg_relative_width"), threshold).alias("confidence_score"), volatility.alias("volatility"), trend(slope, F.col("_n")).alias("stability_trend"), *thirds)


def by_entity(series: DataFrame) -> DataFrame:
    """One row per campaign: plain means over its horizons; channel and trend of the shortest; the last thirds as a map by horizon."""
    means = ("avg_interval_width", "avg_relative_width", "confidence_score", "volatility")
    return series.groupBy("entity_id").agg(F.min_by("channel", "horizon").alias("channel"), *(F.avg(c).alias(c) for c in means), F.min_by("stability_trend", "horizon").alias("stability_trend"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("horizon").cast("string"), "late")))).alias("horizon_breakdown"))


def by_channel(entities: DataFrame) -> DataFrame:
    return entities.groupBy("channel").agg(F.avg("confidence_score").alias("avg_confidence"), F.avg("volatility").alias("avg_volatility"), F.count("*").alias("campaign_count"), F.array_sort(F.collect_list(F.when(F.col("confidence_score") < 0.5, F.col("entity_id")))).alias("high_uncertainty_campaigns"))


def overall(entities: DataFrame) -> DataFrame:
    return entities.agg(F.coalesce(F.avg("confidence_score"), d(1)).alias("overall_confidence"), F.coalesce(F.avg("volatility"), d(0)).alias("overall_volatility"), F.count_if(F.col("confidence_score") < 0.5).alias("high_uncertainty_count"))


def holdout(feature_df: DataFrame, days: int = 14) -> tuple[DataFrame, DataFrame]:
    """(the rest, the last days rows) of the campaigns with more than days + 10 rows."""
    own = features.with_history(feature_df, days + 11)
    return features.all_but_last_rows(own, days), features.last_rows(own, days)
