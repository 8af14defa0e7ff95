"""Functions in SQL give what the expressions give; sketches of drops merge."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import expressions as X
from tidemark.functions import sql
from tidemark.streaming import fact, sketches


def test_scalars_equal_the_expressions(spark):
    assert set(sql.register(spark)) == {"number_or_0", "guarded_ratio", "relative_width", "confidence", "normalised_residual", "days_after"}
    texts = spark.createDataFrame([(x,) for x in ("1", " 2.5 ", "nan", "NaN", "", "x", None, "1e3", "-0")], "t string")
    assert all(a == b for a, b in texts.select(F.expr("number_or_0(t)"), X.number_or_0("t")).collect())
    rows = spark.createDataFrame([(a, b, c, e) for a in (0.0, 5.0, None) for b in (0.0, 1e-11, 2.0, None) for c in (0.0, 3.0) for e in (3.0, 9.0)], "actual double, p10 double, p50 double, p90 double")
    for mine, theirs in (("guarded_ratio(actual, p10)", X.guarded("actual", "p10")), ("relative_width(p10, p50, p90)", X.relative_width()), ("confidence(p50, 2D)", X.confidence(F.col("p50"), 2.0)), ("normalised_residual(actual, p10, p50, p90)", X.nonconformity())):
        assert all(a == b for a, b in rows.select(F.expr(mine), theirs).collect()), mine


def test_functions_are_inlined(spark):
    sql.register(spark)
    plan = spark.range(5).selectExpr("guarded_ratio(id, id + 1) AS x")._jdf.queryExecution().executedPlan().toString()
    assert "guarded_ratio" not in plan and "Python" not in plan


def test_days_after(spark):
    sql.register(spark)
    got = spark.sql("SELECT k, step, date FROM VALUES (1, DATE'2025-01-30'), (2, DATE'2024-02-28') AS t(k, d), LATERAL days_after(d, 2)").collect()
    assert sorted((r.k, r.step, str(r.date)) for r in got) == [(1, 1, "2025-01-31"), (1, 2, "2025-02-01"), (2, 1, "2024-02-29"), (2, 2, "2024-03-01")]


def test_persistent_functions_are_in_the_catalogue(spark):
    try:
        sql.register(spark, persistent=True)
        assert spark.catalog.functionExists("default.confidence") and spark.sql("SELECT default.confidence(1D, 2D)").first()[0] == 0.5
    finally:
        for name in ("number_or_0", "guarded_ratio", "relative_width", "confidence", "normalised_residual", "days_after"):
            spark.sql(f"DROP FUNCTION IF EXISTS default.{name}")


def test_sketches_merge_and_repeats_change_nothing(spark, tmp_path):
    def row(i, channel="google"):
        return (dt.date(2025, 1, 1) + dt.timedelta(i % 40), channel, None if i % 11 == 0 else f"c{i % 3000}", "n", "t", 1.0, 1.0, 1, 1, 1.0, 1.0, i)

    def put(rows):
        spark.createDataFrame(rows, fact.DROPPED).write.mode("append").parquet(str(tmp_path / "in"))
        sketches.feed(fact.read_drops(spark, str(tmp_path / "in"), 2), str(tmp_path / "out"), str(tmp_path / "checkpoint"), ["channel"], ["campaign_id", "date"]).awaitTermination()
        return {r.channel: r for r in sketches.distinct(spark, str(tmp_path / "out"), ["channel"], ["campaign_id", "date"]).collect()}

    first = [row(i) for i in range(5000)] + [row(0, "meta")]
    put(first)
    got = put(first[::2] + [row(i) for i in range(5000, 6000)])
    want = len({row(i)[2] for i in range(6000)} - {None})
    assert got["google"].campaign_id == pytest.approx(want, rel=sketches.error()) and got["google"].date == 40
    assert (got["meta"].campaign_id, got["meta"].date, got["google"].rows) == (0, 1, 5000 + 2500 + 1000)
