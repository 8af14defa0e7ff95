"""Campaign baselines and the flags that come from a campaign's history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import d
from ..schema import TIE_BREAK
from .features import is_placed, placed


def baselines(fact: DataFrame) -> DataFrame:
    """entity_id, channel, campaign_type, total_spend, total_revenue, last_daily_spend, last_daily_budget, historical_roas: sums skip nulls; the last row is by date."""
    budget = F.col("daily_budget") if "daily_budget" in fact.columns else d(0)
    own = fact.withColumn("daily_budget", budget)
    last = F.max_by(F.struct("spend", "daily_budget", "campaign_type"), F.struct(*TIE_BREAK))
    out = own.groupBy(F.col("campaign_id").alias("entity_id"), "channel").agg(F.coalesce(F.sum("spend"), d(0)).alias("total_spend"), F.coalesce(F.sum("revenue"), d(0)).alias("total_revenue"), last.alias("_last"))
    roas = F.when(F.col("total_spend") > 0, F.col("total_revenue") / F.col("total_spend")).otherwise(d(0))
    return out.select("entity_id", "channel", F.col("_last.campaign_type").alias("campaign_type"), "total_spend", "total_revenue", F.col("_last.spend").alias("last_daily_spend"), F.col("_last.daily_budget").alias("last_daily_budget"), roas.alias("historical_roas"))


def _history(fact: DataFrame) -> DataFrame:
    """entity_id, its rows (_n), longest_zero_run, and sums of spend and revenue by half, from one shuffle and one sort; neither for a placed fact.

    A run's length at a row is the row's number less that of the last row with revenue, so runs need no grouping of their own.
    """
    own = (fact if is_placed(fact) else placed(fact.select("campaign_id", *TIE_BREAK))).withColumn("_early", F.col("_place") <= F.floor(F.col("_rows") / 2))
    sums = {f"{half}_{m}": F.sum(F.when(F.col("_early") == early, F.col(m))) for half, early in (("early", True), ("late", False)) for m in ("spend", "revenue")}
    return own.groupBy(F.col("campaign_id").alias("entity_id")).agg(F.max("_rows").alias("_n"), F.max("_zeros").cast("long").alias("longest_zero_run"), *(F.coalesce(c, d(0)).alias(k) for k, c in sums.items()))


def zero_revenue(fact: DataFrame, days: int = 45) -> DataFrame:
    """entity_id, longest_zero_run, zero_revenue: whether any run of rows without revenue is at least days long."""
    return _history(fact).select("entity_id", "longest_zero_run").withColumn("zero_revenue", F.col("longest_zero_run") >= days)


def cost_inflation(fact: DataFrame, threshold: float = 0.2, least_rows: int = 30, guard: bool = False) -> DataFrame:
    """entity_id, early_ratio, late_ratio, cost_inflation: whether spend per revenue rose by over threshold from a campaign's first half of rows to its second.

    A half without revenue has a null ratio here, which stands for infinity. An infinite early ratio counts as inflation if the late one is over 0,
    though that is an improvement; guard=True says no then.
    """
    return _inflation(_history(fact), threshold, least_rows, guard).select("entity_id", "early_ratio", "late_ratio", "cost_inflation")


def history_flags(fact: DataFrame, days: int = 45, threshold: float = 0.2) -> DataFrame:
    """entity_id, zero_revenue, cost_inflation: both in one pass over the fact."""
    return _inflation(_history(fact), threshold).select("entity_id", (F.col("longest_zero_run") >= days).alias("zero_revenue"), "cost_inflation")


def _inflation(own: DataFrame, threshold: float, least_rows: int = 30, guard: bool = False) -> DataFrame:
    for half in ("early", "late"):
        own = own.withColumn(f"{half}_ratio", F.when(F.col(f"{half}_revenue") > 0, F.col(f"{half}_spend") / F.col(f"{half}_revenue")))
    e, late = F.col("early_ratio"), F.col("late_ratio")
    flag = F.when(F.col("_n") < least_rows, False).when(e == 0, False).when(e.isNull() & late.isNull(), False).when(e.isNull(), F.lit(not guard) & (late > 0)).when(late.isNull(), True).otherwise((late - e) / e > threshold)
    return own.withColumn("cost_inflation", flag)
