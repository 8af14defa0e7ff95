"""Channel exports in CSV: discovery, dialects by header, and their union in the unified schema."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..schema import COLUMNS


class IngestionError(Exception):
    """A directory without usable files, or a file that no dialect fits."""


@dataclass(frozen=True)
class Dialect:
    """A kind of export: the header that tells it, the further columns that it reads, and how it becomes the unified fact."""

    name: str
    signature: frozenset[str]
    normalise: Callable[[DataFrame], DataFrame]
    reads: frozenset[str] = field(default_factory=frozenset)

    def fits(self, columns: list[str]) -> bool:
        return self.signature <= set(columns)

    def __call__(self, raw: DataFrame) -> DataFrame:
        if missing := sorted((self.signature | self.reads) - set(raw.columns)):
            raise ValueError(f"{self.name}: missing required columns {missing}")
        return self.normalise(raw).select(*COLUMNS)


def _date(c: str):
    return F.to_date(X.trimmed(c))


def google(raw: DataFrame) -> DataFrame:
    """Spend comes in millionths, and stays null where it isn't a number."""
    return raw.select(
        _date("segments_date").alias("date"),
        F.lit("google").alias("channel"),
        X.namespaced("google", "campaign_id").alias("campaign_id"),
        X.trimmed("campaign_name").alias("campaign_name"),
        X.trimmed("campaign_advertising_channel_type").alias("campaign_type"),
        (X.number("metrics_cost_micros") / X.d(1_000_000)).alias("spend"),
        X.number_or_0("metrics_conversions_value").alias("revenue"),
        X.whole_or_0("metrics_clicks").alias("clicks"),
        X.whole_or_0("metrics_impressions").alias("impressions"),
        X.number_or_0("metrics_conversions").alias("conversions"),
        X.number_or_0("campaign_budget_amount").alias("daily_budget"),
    )


def meta(raw: DataFrame) -> DataFrame:
    """The column conversion is revenue; conversions aren't told; the type is the first part of the name."""
    return raw.withColumn("_name", X.trimmed("campaign_name")).select(
        _date("date_start").alias("date"),
        F.lit("meta").alias("channel"),
        X.namespaced("meta", "campaign_id").alias("campaign_id"),
        F.col("_name").alias("campaign_name"),
        X.first_part("_name").alias("campaign_type"),
        X.number_or_0("spend").alias("spend"),
        X.number_or_0("conversion").alias("revenue"),
        X.whole_or_0("clicks").alias("clicks"),
        X.whole_or_0("impressions").alias("impressions"),
        X.d(0).alias("conversions"),
        X.number_or_0("daily_budget").alias("daily_budget"),
    )


def bing(raw: DataFrame) -> DataFrame:
    return raw.select(
        _date("TimePeriod").alias("date"),
        F.lit("bing").alias("channel"),
        X.namespaced("bing", "CampaignId").alias("campaign_id"),
        X.trimmed("CampaignName").alias("campaign_name"),
        X.trimmed("CampaignType").alias("campaign_type"),
        X.number_or_0("Spend").alias("spend"),
        X.number_or_0("Revenue").alias("revenue"),
        X.whole_or_0("Clicks").alias("clicks"),
        X.whole_or_0("Impressions").alias("impressions"),
        X.number_or_0("Conversions").alias("conversions"),
        X.number_or_0("DailyBudget").alias("daily_budget"),
    )


#: The exports' column names.
GOOGLE = Dialect(
    "google",
    frozenset({"campaign_id", "segments_date", "metrics_cost_micros", "metrics_conversions_value", "campaign_name", "campaign_advertising_channel_type"}),
    google,
    frozenset({"metrics_clicks", "metrics_conversions", "metrics_impressions", "campaign_budget_amount"}),
)
META = Dialect("meta", frozenset({"campaign_id", "date_start", "spend", "conversion", "campaign_name"}), meta, frozenset({"clicks", "impressions", "daily_budget"}))
BING = Dialect("bing", frozenset({"CampaignId", "TimePeriod", "Revenue", "Spend", "CampaignName", "CampaignType"}), bing, frozenset({"Clicks", "Impressions", "Conversions", "DailyBudget"}))


class Registry:
    """Dialects in the order in which they are asked; the first that fits a header reads the file."""

    def __init__(self, dialects: tuple[Dialect, ...] = (GOOGLE, META, BING)):
        self.dialects = list(dialects)

    def add(self, dialect: Dialect) -> None:
        self.dialects.append(dialect)

    def find(self, columns: list[str]) -> Dialect | None:
        return next((x for x in self.dialects if x.fits(columns)), None)


def discover(spark: SparkSession, directory: str) -> list[str]:
    """The CSV files right in a directory, sorted by path, by way of Spark's file system, so any store works. FileNotFoundError if there are none."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(directory)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = sorted(str(s.getPath().toString()) for s in (fs.listStatus(path) if fs.exists(path) else []) if s.isFile() and s.getPath().getName().endswith(".csv"))
    if not found:
        raise FileNotFoundError(f"no CSV files in {directory}")
    return found


def read(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, header names trimmed."""
    raw = spark.read.option("header", True).csv(path)
    return raw.toDF(*[c.strip() for c in raw.columns])


def ingest(spark: SparkSession, directory: str, registry: Registry | None = None) -> DataFrame:
    """All files of a directory in the unified schema. IngestionError names a file that no dialect fits."""
    registry, parts = registry or Registry(), []
    for path in discover(spark, directory):
        raw = read(spark, path)
        dialect = registry.find(raw.columns)
        if dialect is None:
            raise IngestionError(f"no dialect fits {path}: {raw.columns}")
        parts.append(dialect(raw))
    return reduce(DataFrame.unionByName, parts)
