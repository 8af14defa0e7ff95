"""Daily drops of the unified fact as a stream: cleaning, deduplication with a watermark, and windowed totals. Rolling features stay with batch jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import clamped
from ..schema import UNIFIED


def read_drops(spark: SparkSession, path: str, files_per_batch: int = 10) -> DataFrame:
    return spark.readStream.schema(UNIFIED).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def cleaned(stream: DataFrame, late: str = "7 days") -> DataFrame:
    """Spend at least 0, and one row per campaign and day, as long as its repeats come within the watermark."""
    timed = stream.withColumn("spend", clamped("spend")).withColumn("day", F.col("date").cast("timestamp"))
    return timed.withWatermark("day", late).dropDuplicatesWithinWatermark(["campaign_id", "date"])


def weekly_totals(stream: DataFrame) -> DataFrame:
    """channel, week (its first day), spend, revenue: append-mode totals of closed weeks."""
    totals = stream.groupBy(F.window("day", "7 days", startTime="4 days"), "channel").agg(F.sum("spend").alias("spend"), F.sum("revenue").alias("revenue"))
    return totals.select("channel", F.col("window.start").cast("date").alias("week"), "spend", "revenue")
