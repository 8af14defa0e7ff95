"""Data-quality checks of the unified fact. Each takes a frame and returns (issues, frame).

issues: check, severity (error or warning), subject (what it is about), count, message, samples (a few values), of one row per problem. Counts and
samples are made in Spark; no check collects rows. As rows have no order of their own, samples are the first by date and campaign.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expressions import clamped
from ..sessions import written

ISSUE = "check string, severity string, subject string, count long, message string, samples array<string>"
SAMPLES = 5
ORDER = ("date", "campaign_id")
Check = Callable[..., tuple[DataFrame, DataFrame]]

#: The messages that must match, by check.
MISSING_ERROR = "Column '%s' has %d missing values (%s), exceeding %s threshold."
MISSING_WARNING = "Column '%s' has %d missing values (%s)."
NEGATIVE_SPEND = "Found %d rows with negative spend. Values have been clamped to 0.0."
DUPLICATE_ROWS = "Found and removed %d duplicate rows (%s of data)."
FUTURE_DATES = "Found %d rows with dates after %s. These rows have been excluded."
INVALID_TYPES = "Channel '%s' has %d rows with unrecognized campaign types: [%s]. These may indicate new campaign structures."
BUDGET = "Found %d rows (%s) where spend exceeds daily budget. This may indicate budget changes not captured in data."
ZERO_ACTIVITY = "Found %d rows (%s) with zero spend and zero impressions. These provide no signal."
NO_CHANNEL_COLUMN = "No 'channel' column found in data."
CHANNEL_MISSING = "Channel '%s' is missing from the data. Forecasts for this channel will not be generated."
CHANNELS_PRESENT = "All expected channels present: [%s]."


def percent(ratio: Column, places: int = 1) -> Column:
    return F.format_string(f"%.{places}f%%", ratio * 100)


def first_values(df: DataFrame, value: Column, n: int = SAMPLES) -> DataFrame:
    """One row, samples: a value of each of the first n rows by date and campaign. Only n rows leave each task."""
    top = df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in ORDER), value.cast("string").alias("_value")).orderBy(*ORDER, "_value").limit(n)
    return top.agg(F.transform(F.array_sort(F.collect_list(F.struct(*ORDER, "_value"))), lambda x: x["_value"]).alias("samples"))


def _issue(counts: DataFrame, check: str, severity: str | Column, message: Column, samples: DataFrame, subject: str = "") -> DataFrame:
    """One issue from a one-row frame with a column n, if n is over 0, and a one-row frame of samples."""
    own = counts.where("n > 0").crossJoin(F.broadcast(samples))  # one row each
    return own.select(F.lit(check).alias("check"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), F.lit(subject).alias("subject"), F.col("n").cast("long").alias("count"), message.alias("message"), "samples")


def missing_values(df: DataFrame, max_ratio: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """Per column with nulls: an error over max_ratio of the rows, else a warning. One pass counts all columns. Samples are five days and campaigns of an error, three of a warning."""
    one = df.agg(F.count("*").alias("_rows"), *(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns))
    long = one.select("_rows", F.explode(F.array(*(F.struct(F.lit(c).alias("subject"), F.col(c).alias("n")) for c in df.columns))).alias("x")).select("_rows", "x.*").where("n > 0")
    return _missing_issues(long, df, max_ratio), df


def _missing_issues(long: DataFrame, df: DataFrame, max_ratio: float) -> DataFrame:
    """long: _rows, subject, n per column with nulls."""
    place = F.concat_ws("/", *(F.col(c).cast("string") for c in ORDER if c in df.columns)).alias("place")
    lost = df.select(place, F.explode(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in df.columns))).alias("subject")).where("subject IS NOT NULL")
    few = lost.withColumn("_n", F.row_number().over(W.partitionBy("subject").orderBy("place"))).where(F.col("_n") <= SAMPLES)
    few = few.groupBy("subject").agg(F.array_sort(F.collect_list("place")).alias("samples"))
    ratio = F.col("n") / F.col("_rows")
    over = ratio > max_ratio
    message = F.when(over, F.format_string(MISSING_ERROR, "subject", "n", percent(ratio), F.lit(f"{max_ratio:.0%}"))).otherwise(F.format_string(MISSING_WARNING, "subject", "n", percent(ratio)))
    return long.join(few, "subject", "left").select(F.lit("missing_values").alias("check"), F.when(over, "error").otherwise("warning").alias("severity"), "subject", F.col("n").alias("count"), message.alias("message"), F.slice("samples", 1, F.when(over, SAMPLES).otherwise(3)).alias("samples"))


def negative_spend(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    n = df.agg(F.count_if(F.col("spend") < 0).alias("n"))
    return _negative_issue(n, df), df.withColumn("spend", clamped("spend"))


def _negative_issue(n: DataFrame, df: DataFrame) -> DataFrame:
    return _issue(n, "negative_spend", "warning", F.format_string(NEGATIVE_SPEND, "n"), first_values(df.where("spend < 0"), F.col("spend")))


def duplicate_rows(df: DataFrame, max_ratio: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """Rows equal in all columns, but one of each: an error over max_ratio of the rows. They go. Samples are plain numbers from 0."""
    n = df.groupBy(*df.columns).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n"), F.sum("count").alias("rows"))
    return _duplicate_issue(n, max_ratio), df.dropDuplicates()


def _duplicate_issue(n: DataFrame, max_ratio: float) -> DataFrame:
    ratio = F.col("n") / F.col("rows")
    numbers = n.select(F.transform(F.sequence(F.lit(0), F.greatest(F.least(F.col("n"), F.lit(SAMPLES)) - 1, F.lit(0)).cast("int")), lambda x: x.cast("string")).alias("samples"))
    return _issue(n, "duplicate_rows", F.when(ratio > max_ratio, "error").otherwise("warning"), F.format_string(DUPLICATE_ROWS, "n", percent(ratio)), numbers)


def future_dates(df: DataFrame, reference=None, max_days: int = 7) -> tuple[DataFrame, DataFrame]:
    """Rows after the reference date (a date column or literal; by default one day after the last date, which none is after). They go; null dates stay.

    The severity compares the number of rows with max_days.
    """
    ref = df.agg(F.date_add(F.max("date"), 1).alias("_ref")) if reference is None else df.sparkSession.range(1).select(F.lit(reference).cast("date").alias("_ref"))
    marked = df.crossJoin(F.broadcast(ref))  # one row
    after = _after(F.col("_ref"))
    n = marked.agg(F.count_if(after).alias("n"), F.max("_ref").cast("string").alias("_ref"))
    return _future_issue(n, marked.where(after), max_days), marked.where(~after).drop("_ref")


def _after(ref: Column) -> Column:
    return F.coalesce(F.col("date") > ref, F.lit(False))


def _future_issue(n: DataFrame, rows: DataFrame, max_days: int) -> DataFrame:
    """n: one row, n and _ref as text."""
    return _issue(n, "future_dates", F.when(F.col("n") > max_days, "error").otherwise("warning"), F.format_string(FUTURE_DATES, "n", "_ref"), first_values(rows, F.col("date")))


def invalid_campaign_types(df: DataFrame, allowed: Mapping[str, Sequence[str]]) -> tuple[DataFrame, DataFrame]:
    """Per configured channel: rows whose type is null or not allowed. Samples are the first such types; null is None, and first."""
    wrong = reduce(lambda a, b: a | b, ((F.col("channel") == c) & F.coalesce(~F.col("campaign_type").isin(*types), F.lit(True)) for c, types in allowed.items()))
    kinds = df.where(wrong).groupBy("channel", "campaign_type").agg(F.count("*").alias("n")).groupBy("channel").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct(F.coalesce("campaign_type", F.lit("")).alias("key"), F.coalesce("campaign_type", F.lit("None")).alias("name"), F.col("campaign_type").isNotNull().alias("known")))).alias("kinds"))
    listed = F.array_join(F.transform("kinds", lambda x: F.when(x["known"], F.concat(F.lit("'"), x["name"], F.lit("'"))).otherwise(x["name"])), ", ")
    samples = F.slice(F.transform("kinds", lambda x: x["name"]), 1, SAMPLES)
    return kinds.select(F.lit("invalid_campaign_types").alias("check"), F.lit("warning").alias("severity"), F.col("channel").alias("subject"), F.col("n").alias("count"), F.format_string(INVALID_TYPES, "channel", "n", listed).alias("message"), samples.alias("samples")), df


#: What two checks count.
OVER_BUDGET = "daily_budget > 0 AND spend > daily_budget"
IDLE = "spend = 0 AND impressions = 0"


def budget_consistency(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _budget_issue(df.agg(F.count_if(F.expr(OVER_BUDGET)).alias("n"), F.count("*").alias("rows")), df), df


def _budget_issue(n: DataFrame, df: DataFrame) -> DataFrame:
    value = F.concat(F.lit("spend="), F.col("spend").cast("string"), F.lit(", budget="), F.col("daily_budget").cast("string"))
    return _issue(n, "budget_consistency", "warning", F.format_string(BUDGET, "n", percent(F.col("n") / F.col("rows"))), first_values(df.where(OVER_BUDGET), value))


def zero_activity(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _idle_issue(df.agg(F.count_if(F.expr(IDLE)).alias("n"), F.count("*").alias("rows")), df), df


def _idle_issue(n: DataFrame, df: DataFrame) -> DataFrame:
    value = F.concat_ws("/", F.col("date").cast("string"), "campaign_id")
    return _issue(n, "zero_activity", "warning", F.format_string(ZERO_ACTIVITY, "n", percent(F.col("n") / F.col("rows"))), first_values(df.where(IDLE), value))


def channel_coverage(df: DataFrame, expected: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """An error per expected channel without rows; if all have rows, a warning of count 0; an error if there is no channel column."""
    spark = df.sparkSession
    if "channel" not in df.columns:
        return spark.createDataFrame([("channel_coverage", "error", "channel", 0, NO_CHANNEL_COLUMN, [])], ISSUE), df
    want = spark.createDataFrame([(c,) for c in expected], "subject string")
    lost = want.join(df.select(F.col("channel").alias("subject")).distinct(), "subject", "left_anti")

    def issue(of: DataFrame, severity: str, message: Column, samples: Column) -> DataFrame:
        return of.select(F.lit("channel_coverage").alias("check"), F.lit(severity).alias("severity"), "subject", F.lit(0).cast("long").alias("count"), message.alias("message"), samples.cast("array<string>").alias("samples"))

    errors = issue(lost, "error", F.format_string(CHANNEL_MISSING, "subject"), F.array("subject"))
    full = lost.agg(F.count("*").alias("n"), F.lit("").alias("subject")).where("n = 0")
    return errors.unionByName(issue(full, "warning", F.lit(CHANNELS_PRESENT % ", ".join(f"'{c}'" for c in expected)), F.array())), df


@dataclass(frozen=True)
class Report:
    issues: DataFrame
    cleaned: DataFrame
    statistics: DataFrame

    @property
    def passed(self) -> DataFrame:
        """One row: whether there is no error."""
        return self.issues.agg((F.count_if(F.col("severity") == "error") == 0).alias("passed"))


def statistics(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: rows before and after, rows removed, campaigns, channels, first and last date."""
    a = before.agg(F.count("*").alias("rows_before"))
    b = after.agg(F.count("*").alias("rows_after"), F.countDistinct("campaign_id").alias("campaigns"), F.countDistinct("channel").alias("channels"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    return a.crossJoin(b).withColumn("rows_removed", F.col("rows_before") - F.col("rows_after"))  # one row each


def validate(df: DataFrame, allowed: Mapping[str, Sequence[str]], max_missing: float = 0.3, max_duplicates: float = 0.05, max_days: int = 7, reference=None) -> Report:
    """All checks in turn, each on what the one before left, in two jobs: df is computed once, and written; so are the cleaned rows.

    Counts are observed while those tables are written: of the rows as they come, and of those that are left, so at the end of
    each job, where a task that is run again counts once. Samples are read from the tables, of the checks that found something.
    The reference date of future_dates is as there; without one no row is after it.
    """
    spark, columns = df.sparkSession, df.columns
    seen = Observation()
    nulls = [F.count_if(F.col(f"`{c}`").isNull()).alias(f"_null_{i}") for i, c in enumerate(columns)]
    raw = written(df.observe(seen, F.count("*").alias("_rows"), F.count_if(F.col("spend") < 0).alias("_negative"), *nulls))
    before = seen.get
    each = raw.withColumn("spend", clamped("spend")).groupBy(*columns).agg(F.count("*").alias("_copies"))
    after = F.lit(False) if reference is None else _after(F.lit(reference).cast("date"))
    left = Observation()
    now = [F.count("*"), F.sum("_copies"), F.count_if(after), *(F.count_if(~after & F.expr(c)) for c in (OVER_BUDGET, IDLE)), F.min(F.when(~after, F.col("date"))), F.max(F.when(~after, F.col("date")))]
    names = ("rows", "copies", "late", "over", "idle", "first", "last")
    marked = written(each.withColumn("_late", after).observe(left, *(c.alias(n) for c, n in zip(now, names, strict=True))))
    got = left.get
    cleaned = marked.where(~F.col("_late")).select(*columns)

    def one(schema: str, *values) -> DataFrame:
        return spark.createDataFrame([values], schema)

    copies, rows = (got["copies"] or 0) - got["rows"], got["rows"] - got["late"]
    issues: list[DataFrame] = []
    lost = [(before["_rows"], c, before[f"_null_{i}"]) for i, c in enumerate(columns) if before[f"_null_{i}"]]
    if lost:
        issues.append(_missing_issues(spark.createDataFrame(lost, "_rows long, subject string, n long"), raw.select(*(c for c in columns if c in ORDER or c in [x[1] for x in lost])), max_missing))
    if before["_negative"]:
        issues.append(_negative_issue(one("n long", before["_negative"]), raw))
    if copies:
        issues.append(_duplicate_issue(one("n long, rows long", copies, got["copies"]), max_duplicates))
    if got["late"]:
        issues.append(_future_issue(one("n long, _ref string", got["late"], str(reference)), marked.where("_late"), max_days))
    issues.append(invalid_campaign_types(cleaned, allowed)[0])
    if got["over"]:
        issues.append(_budget_issue(one("n long, rows long", got["over"], rows), cleaned))
    if got["idle"]:
        issues.append(_idle_issue(one("n long, rows long", got["idle"], rows), cleaned))
    issues.append(channel_coverage(cleaned, tuple(allowed))[0])
    distinct = cleaned.agg(F.countDistinct("campaign_id").alias("campaigns"), F.countDistinct("channel").alias("channels"))
    values = one("rows_before long, rows_after long, first_date date, last_date date", before["_rows"], rows, got["first"], got["last"])
    stats = values.crossJoin(distinct).select("rows_before", "rows_after", "campaigns", "channels", "first_date", "last_date", (F.col("rows_before") - F.col("rows_after")).alias("rows_removed"))  # one row each
    return Report(reduce(DataFrame.unionByName, issues), cleaned, stats)
