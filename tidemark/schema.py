"""The unified daily fact: one row per campaign and day."""

from __future__ import annotations

from pyspark.sql import types as T

CHANNELS = ("google", "meta", "bing")
METRICS = ("spend", "revenue", "clicks", "impressions", "conversions", "daily_budget")
DYNAMIC = ("spend", "revenue", "clicks", "impressions", "conversions")
HORIZONS = (30, 60, 90)
GRANULARITIES = ("campaign", "channel", "overall")

UNIFIED = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("channel", T.StringType()),
        T.StructField("campaign_id", T.StringType()),
        T.StructField("campaign_name", T.StringType()),
        T.StructField("campaign_type", T.StringType()),
        T.StructField("spend", T.DoubleType()),
        T.StructField("revenue", T.DoubleType()),
        T.StructField("clicks", T.LongType()),
        T.StructField("impressions", T.LongType()),
        T.StructField("conversions", T.DoubleType()),
        T.StructField("daily_budget", T.DoubleType()),
    ]
)
COLUMNS = tuple(UNIFIED.fieldNames())
#: Rows of one campaign are ordered by date, then by their metrics, so that repeated days have one order everywhere.
TIE_BREAK = ("date", *METRICS)
