"""The engine's expressions as SQL functions, so that queries in text can use them: register(spark), then spark.sql.

They are SQL bodies, which Spark inlines into the query's plan: no Python runs and nothing blocks pushdown.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Name and parameters; what it returns; its body.
SCALARS = (
    ("number_or_0(x STRING)", "DOUBLE", "coalesce(CASE WHEN NOT isnan(try_cast(x AS DOUBLE)) THEN try_cast(x AS DOUBLE) END, 0D)"),
    ("guarded_ratio(num DOUBLE, den DOUBLE)", "DOUBLE", "CASE WHEN den > 1e-10D THEN num / den ELSE 0D END"),
    ("relative_width(p10 DOUBLE, p50 DOUBLE, p90 DOUBLE)", "DOUBLE", "(p90 - p10) / greatest(p50, 1e-10D)"),
    ("confidence(mean_relative_width DOUBLE, threshold DOUBLE)", "DOUBLE", "greatest(0D, 1D - least(mean_relative_width / threshold, 1D))"),
    ("normalised_residual(actual DOUBLE, p10 DOUBLE, p50 DOUBLE, p90 DOUBLE)", "DOUBLE", "abs(actual - p50) / greatest((p90 - p10) / 2D, 1e-10D)"),
)
TABLES = (("days_after(start DATE, days INT)", "step INT, date DATE", "SELECT step, date_add(start, step) FROM explode(sequence(1, days)) AS t(step)"),)


def register(spark: SparkSession, persistent: bool = False) -> list[str]:
    """Creates all functions and returns their names: temporary ones, or in the current database of the session's catalogue."""
    kind = "FUNCTION" if persistent else "TEMPORARY FUNCTION"
    for head, returns, body in SCALARS:
        spark.sql(f"CREATE OR REPLACE {kind} {head} RETURNS {returns} RETURN {body}")
    for head, returns, body in TABLES:
        spark.sql(f"CREATE OR REPLACE {kind} {head} RETURNS TABLE({returns}) RETURN {body}")
    return [head.split("(")[0] for head, _, _ in (*SCALARS, *TABLES)]
