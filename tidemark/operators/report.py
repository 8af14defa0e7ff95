"""The report's tables and their files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sessions import written


def rounded(c: str, places: int):
    return F.bround(c, places).alias(c)


def forecasts(points: DataFrame, places: int = 2, raw: bool = False, alpha: DataFrame | None = None) -> DataFrame:
    """The forecast points, revenue alone unless raw. Bands are as forecast; with alpha (one row) cal_p10 and cal_p90 have them calibrated."""
    own = points if raw else points.where("metric = 'revenue'")
    columns = ["entity_id", "channel", "horizon", "metric", F.col("date").cast("string").alias("date"), *(rounded(c, places) for c in ("p10", "p50", "p90"))]
    if alpha is not None:
        own = own.crossJoin(F.broadcast(alpha.select(F.col("alpha").alias("_a"))))  # one row
        half = F.col("_a") * (F.col("p90") - F.col("p10")) / 2
        columns += [F.bround(F.col("p50") - half, places).alias("cal_p10"), F.bround(F.col("p50") + half, places).alias("cal_p90")]
    return own.select(*columns)


def uncertainty(entities: DataFrame, places: int = 2) -> DataFrame:
    return entities.select("entity_id", "channel", rounded("confidence_score", places), rounded("volatility", places), "stability_trend", rounded("avg_relative_width", places))


def simulations(results: DataFrame, places: int = 2) -> DataFrame:
    return results.select("scenario", *(rounded(c, places) for c in ("projected_revenue", "projected_spend", "projected_roas")))


def recommendations(found: DataFrame, places: int = 2) -> DataFrame:
    """expected_roas is null where it is 0."""
    change = F.bround(F.col("recommended_budget") - F.col("current_budget"), places).alias("budget_change")
    return found.select("entity_id", "channel", rounded("current_budget", places), rounded("recommended_budget", places), change, F.when(F.col("expected_roas") != 0, F.bround("expected_roas", places)).alias("expected_roas"), "rationale")


def summary(points: DataFrame, overall: DataFrame, results: DataFrame, found: DataFrame, assessments: DataFrame, places: int = 2, horizon: int | None = None) -> DataFrame:
    """One row of nine numbers. The forecast revenue sums all horizons, or one."""
    own = points.where("metric = 'revenue'")
    own = own.where(F.col("horizon") == horizon) if horizon else own
    a = own.agg(F.countDistinct("entity_id").alias("campaigns_forecasted"), F.bround(F.coalesce(F.sum("p50"), F.lit(0.0)), places).alias("total_forecast_revenue_p50"))
    b = overall.select(F.bround("overall_confidence", places).alias("overall_uncertainty_confidence"), F.bround("overall_volatility", places).alias("overall_volatility"), F.col("high_uncertainty_count").alias("high_uncertainty_campaigns"))
    c = results.agg(F.count("*").alias("scenarios_simulated"))
    r = found.agg(F.count("*").alias("recommendations"))
    f = assessments.agg(F.count_if(F.size("flags") > 0).alias("campaigns_flagged"), F.coalesce(F.sum(F.size("flags").cast("long")), F.lit(0)).alias("total_flags"))
    return a.crossJoin(b).crossJoin(c).crossJoin(r).crossJoin(f)  # one row each


#: What each report is ordered by.
ORDERS = {"forecasts": ("entity_id", "horizon", "date"), "uncertainty": ("entity_id",), "simulations": ("scenario",), "recommendations": ("entity_id",)}


def write_csv(df: DataFrame, path: str, order: Sequence[str] = (), rows_per_file: int = 1_000_000) -> None:
    """CSV files in a folder, each with a header, and in path.manifest a JSON line for each: file, rows, first and last.

    Rows are in order over all files as their names follow each other, so their lines but for the headers are those of one
    sorted file. Without an order all columns count, in turn. df is computed once, and no task writes many more rows than
    rows_per_file, but for rows that are alike in the order. An empty frame writes one header.
    """
    order = list(order or df.columns)
    own = written(df)
    files = -(-own.count() // rows_per_file)
    dealt = own.repartitionByRange(files, *order) if files > 1 else own.coalesce(1)
    dealt.sortWithinPartitions(*order).write.mode("overwrite").option("header", True).csv(path)
    names = F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file")
    key = F.struct(*(F.col(f"`{c}`") for c in order))
    back = df.sparkSession.read.schema(T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields])).option("header", True).csv(path)
    lines = back.select(names, key.alias("key")).groupBy("file").agg(F.count("*").alias("rows"), F.min("key").alias("first"), F.max("key").alias("last"))
    lines.coalesce(1).sortWithinPartitions("file").write.mode("overwrite").json(f"{path}.manifest")  # one row a file


def write_json(df: DataFrame, path: str) -> None:
    """One row or a few, as one file."""
    df.coalesce(1).write.mode("overwrite").json(path)
