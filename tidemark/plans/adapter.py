"""The driver's order lines as the unified fact: a supplier is a campaign, its number modulo 3 the channel.

Amounts are whole units, so their sums are exact in any order, in Spark as in the comparison engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import d
from ..schema import COLUMNS


def unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    channel = F.when(F.col("l_suppkey") % 3 == 0, "google").when(F.col("l_suppkey") % 3 == 1, "meta").otherwise("bing")
    units = lambda c: F.round(c).cast("bigint")
    price = F.col("l_extendedprice").cast("double")
    fact = line.groupBy("l_suppkey", F.to_date("l_shipdate").alias("date")).agg(
        F.sum(units(price * (F.col("l_discount").cast("double") + F.col("l_tax").cast("double")) * F.lit(3.5))).cast("double").alias("spend"),
        F.sum(units(price * (1 - F.col("l_discount").cast("double")))).cast("double").alias("revenue"),
        F.sum(F.col("l_quantity").cast("bigint")).alias("clicks"),
        F.sum(F.col("l_quantity").cast("bigint") * 20).alias("impressions"),
        F.count("*").cast("double").alias("conversions"),
        F.max(units(price * F.lit(0.4))).cast("double").alias("daily_budget"),
    )
    fact = fact.withColumn("channel", channel).withColumn("campaign_id", F.concat_ws("_", "channel", F.col("l_suppkey").cast("string"))).withColumn("campaign_name", F.concat(F.lit("Campaign_"), F.col("l_suppkey").cast("string")))
    kind = F.when(F.col("channel") == "google", "SEARCH").when(F.col("channel") == "meta", "Generic").otherwise("Search")
    return fact.withColumn("campaign_type", kind).select(*COLUMNS)


FACT = """
line AS (SELECT l_suppkey AS k, l_shipdate::DATE AS date, l_extendedprice::DOUBLE AS price, l_discount::DOUBLE AS disc, l_tax::DOUBLE AS tax, l_quantity::BIGINT AS qty FROM lineitem),
fact0 AS (SELECT k, date, CASE k % 3 WHEN 0 THEN 'google' WHEN 1 THEN 'meta' ELSE 'bing' END AS channel,
  sum(round(price * (disc + tax) * 3.5::DOUBLE)::BIGINT)::DOUBLE AS spend, sum(round(price * (1 - disc))::BIGINT)::DOUBLE AS revenue,
  sum(qty)::BIGINT AS clicks, sum(qty * 20)::BIGINT AS impressions, count(*)::DOUBLE AS conversions, max(round(price * 0.4::DOUBLE)::BIGINT)::DOUBLE AS daily_budget
  FROM line GROUP BY k, date),
fact AS (SELECT date, channel, channel || '_' || k AS campaign_id, 'Campaign_' || k AS campaign_name,
  CASE channel WHEN 'google' THEN 'SEARCH' WHEN 'meta' THEN 'Generic' ELSE 'Search' END AS campaign_type,
  spend, revenue, clicks, impressions, conversions, daily_budget FROM fact0)"""


def flawed(fact: DataFrame) -> DataFrame:
    """The fact with faults: no spend on 13ths, negative spend on 17ths, no campaign type on 5ths, no activity on 23rds, no revenue in March 1995, and the first days of months twice."""
    day = F.dayofmonth("date")
    fact = fact.withColumn("spend", F.when(day == 23, d(0)).otherwise(F.col("spend"))).withColumn("impressions", F.when(day == 23, F.lit(0).cast("long")).otherwise(F.col("impressions")))
    out = fact.withColumn("spend", F.when(day == 13, F.lit(None).cast("double")).when(day == 17, -F.col("spend")).otherwise(F.col("spend")))
    out = out.withColumn("campaign_type", F.when(day != 5, F.col("campaign_type"))).withColumn("revenue", F.when(F.date_trunc("month", "date") == F.lit("1995-03-01").cast("timestamp"), F.lit(0.0)).otherwise(F.col("revenue")))
    return out.unionByName(out.where(day == 1))


FLAWED = (
    FACT
    + """,
flawed0 AS (SELECT date, channel, campaign_id, campaign_name, CASE WHEN day(date) <> 5 THEN campaign_type END AS campaign_type,
  CASE day(date) WHEN 13 THEN NULL WHEN 17 THEN -spend WHEN 23 THEN 0.0::DOUBLE ELSE spend END AS spend, CASE WHEN date_trunc('month', date) = DATE '1995-03-01' THEN 0.0::DOUBLE ELSE revenue END AS revenue,
  clicks, CASE day(date) WHEN 23 THEN 0::BIGINT ELSE impressions END AS impressions, conversions, daily_budget FROM fact),
flawed AS (SELECT * FROM flawed0 UNION ALL SELECT * FROM flawed0 WHERE day(date) = 1)"""
)


def dropped(fact: DataFrame) -> DataFrame:
    """The fact as monthly drops: a day's row comes in its month's; first days again in the next, with a unit more of spend; 28ths also in the one before, without amounts yet."""
    month = (F.year("date") * 12 + F.month("date")).cast("long")
    own = fact.withColumn("drop", month)
    corrected = own.where(F.dayofmonth("date") <= 5).withColumns({"drop": month + 1, "spend": F.col("spend") + 1})
    early = own.where(F.dayofmonth("date") == 28).withColumns({"drop": month - 1, "spend": d(0), "revenue": d(0)})
    return own.unionByName(corrected).unionByName(early)


DROPPED = (
    FACT
    + """,
months AS (SELECT *, year(date) * 12 + month(date) AS drop_no FROM fact),
drops AS (SELECT * FROM months UNION ALL SELECT * REPLACE (spend + 1 AS spend, drop_no + 1 AS drop_no) FROM months WHERE day(date) <= 5
  UNION ALL SELECT * REPLACE (0.0::DOUBLE AS spend, 0.0::DOUBLE AS revenue, drop_no - 1 AS drop_no) FROM months WHERE day(date) = 28)"""
)
