import datetime as dt

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import baselines, features, forecast
from tidemark.schema import UNIFIED


def fact(spark, values, campaign="meta_1", start=dt.date(2024, 1, 1), revenue=None):
    rows = [(start + dt.timedelta(days=2 * i), "meta", campaign, "n", "Generic", v, (revenue or values)[i], 10, 100, 1.0, 50.0) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, UNIFIED)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(0, 50).map(float)), min_size=1, max_size=40))
def test_rolling_and_lags_match_pandas(spark, values):
    got = features.add_features(fact(spark, values, revenue=[1.0] * len(values))).orderBy("date").toPandas()
    s = pd.Series(values, dtype=float)
    for n in features.ROLLING:
        shifted = s.shift(1).rolling(n, min_periods=2)
        np.testing.assert_allclose(got[f"spend_roll_mean_{n}"].astype(float), shifted.mean(), atol=1e-9)
        np.testing.assert_allclose(got[f"spend_roll_std_{n}"].astype(float), shifted.std().fillna(0.0), atol=1e-6)
    for k in features.LAGS:
        np.testing.assert_allclose(got[f"spend_lag_{k}"].astype(float), s.shift(k))


def test_there_are_71_features_and_two_rows_go(spark):
    df = fact(spark, [float(i) for i in range(60)])
    assert len(features.feature_names()) == 71
    assert features.build(df).count() == 58
    assert features.build(df, max_ratio=1.0).count() == 60


def test_the_plan_has_one_shuffle(spark):
    plan = features.add_features(fact(spark, [1.0, 2.0]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan


def test_calendar_and_ratios(spark):
    row = features.ratio_features(features.time_features(fact(spark, [0.0], start=dt.date(2025, 1, 4)))).first()
    assert (row.dow, row.is_weekend, row.woy) == (5, 1, 1)
    assert row.roas == 0.0 and row.ctr == 0.1


def test_baselines_last_row_and_zero_spend(spark):
    row = baselines.baselines(fact(spark, [10.0, 20.0], revenue=[40.0, 50.0])).first()
    assert (row.total_spend, row.total_revenue, row.last_daily_spend, row.historical_roas) == (30.0, 90.0, 20.0, 3.0)
    assert baselines.baselines(fact(spark, [0.0], revenue=[5.0])).first().historical_roas == 0.0
    assert baselines.baselines(fact(spark, [1.0]).limit(0)).count() == 0


@pytest.mark.parametrize(("revenue", "flag"), [([5.0] * 10 + [0.0] * 45, True), ([0.0] * 44 + [1.0] + [0.0] * 44, False)])
def test_zero_revenue_run(spark, revenue, flag):
    assert baselines.zero_revenue(fact(spark, [1.0] * len(revenue), revenue=revenue)).first().zero_revenue is flag


def test_cost_inflation(spark):
    up = fact(spark, [10.0] * 15 + [30.0] * 15, revenue=[100.0] * 30)
    assert baselines.cost_inflation(up).first().cost_inflation
    assert not baselines.cost_inflation(up.limit(29)).first().cost_inflation
    early_zero = fact(spark, [10.0] * 30, revenue=[0.0] * 15 + [10.0] * 15)
    assert baselines.cost_inflation(early_zero).first().cost_inflation
    assert not baselines.cost_inflation(early_zero, guard=True).first().cost_inflation


def test_tail_and_head(spark):
    df = fact(spark, [float(i) for i in range(10)])
    assert sorted(r.spend for r in features.last_rows(df, 3).collect()) == [7.0, 8.0, 9.0]
    assert features.all_but_last_rows(df, 3).agg(F.max("spend")).first()[0] == 6.0
    assert features.with_history(df, 11).count() == 0


@pytest.mark.parametrize("short", [1, 3, 32])
def test_long_windows_match_pandas(spark, monkeypatch, short):
    """Whatever frames they are put together from; with nulls, equal values, and values far from 0."""
    monkeypatch.setattr(features, "SHORT", short)
    rng = np.random.default_rng(short)
    values = [None if rng.random() < 0.15 else 1e6 + float(rng.integers(0, 50)) if i < 90 else 7.0 for i in range(150)]
    got = features.rolling_features(fact(spark, values, revenue=[1.0] * 150), (7, 33, 45, 64)).orderBy("date").toPandas()
    s = pd.Series(values, dtype=float)
    for n in (7, 33, 45, 64):
        shifted = s.shift(1).rolling(n, min_periods=2)
        np.testing.assert_allclose(got[f"spend_roll_mean_{n}"].astype(float), shifted.mean(), rtol=1e-12)
        want = [0.0 if np.isnan(x) else x for x in (np.std([v for v in s[max(0, i - n) : i] if not np.isnan(v)], ddof=1) if s[max(0, i - n) : i].count() > 1 else np.nan for i in range(150))]
        np.testing.assert_allclose(got[f"spend_roll_std_{n}"].astype(float), want, atol=1e-7)


def test_ranges_of_a_long_campaign(spark):
    """Equal to the plain windows; copies, equal days, null campaigns, and a campaign shorter than a range."""
    rng = np.random.default_rng(5)
    values = rng.integers(0, 40, 700).astype(float).tolist()
    df = fact(spark, values).unionByName(fact(spark, values[:20], "meta_2")).unionByName(fact(spark, values[:70], "meta_1")).unionByName(fact(spark, values[:45], None))

    def build(x):
        return features.lag_features(features.rolling_features(x, (7, 40)), (1, 40))

    got, want = features.in_ranges(df, build, 40, 50), build(df)
    assert got.columns == want.columns
    key = [c for c in want.columns if "_roll_" not in c]

    def table(x):
        return sorted(map(str, x.select(*key, *(F.round(c, 6).alias(c) for c in want.columns if "_roll_" in c)).collect()))

    assert table(got) == table(want)
    with pytest.raises(ValueError):
        features.in_ranges(df, build, 60, 50)
    assert features.in_ranges(df.limit(0), build, 40, 50).count() == 0


def test_no_task_has_a_long_campaign(spark):
    """20,000 rows of one campaign: ranges of 1,000 rows and 30 more."""
    df = spark.range(20_000).select(F.date_add(F.lit("1990-01-01").cast("date"), (F.col("id") % 9000).cast("int")).alias("date"), *(F.lit("x").alias(c) for c in ("channel", "campaign_id", "campaign_name", "campaign_type")), *(F.col("id").cast("double").alias(c) for c in ("spend", "revenue", "conversions", "daily_budget")), *(F.col("id").alias(c) for c in ("clicks", "impressions")))
    sizes = features.in_ranges(df, lambda x: x.withColumn("_size", F.count("*").over(features.W.partitionBy("campaign_id"))), 30, 1000).agg(F.max("_size"), F.count("*"), F.countDistinct("spend")).first()
    assert tuple(sizes) == (1030, 20_000, 20_000)


def test_batches_match_windows(spark):
    """Over batches of 7 rows, which cut campaigns anywhere; with nulls, null campaigns and copies of days."""
    rng = np.random.default_rng(8)
    values = [None if rng.random() < 0.2 else float(x) for x in rng.integers(0, 40, 90)]
    df = fact(spark, values, revenue=[1.0] * 90).unionByName(fact(spark, values[:9], "meta_2")).unionByName(fact(spark, values[:1], "meta_3")).unionByName(fact(spark, values[20:60], None)).unionByName(fact(spark, values[:30], "meta_2"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got, want = features.in_batches(features.ratio_features(features.time_features(df)), (3, 7, 40), (1, 30)), features.add_features(df, (3, 7, 40), (1, 30))
        assert got.dtypes == want.dtypes

        def table(x):
            return sorted(map(str, x.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in x.dtypes)).collect()))

        assert table(got) == table(want)
        assert features.in_batches(df.limit(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_both_flags_take_one_shuffle(spark):
    plan = baselines.history_flags(fact(spark, [1.0, 2.0]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_ranked_is_percentile(spark):
    """With nulls, equal values and a group without values."""
    from tidemark.operators import models

    rows = [("a", 3.0), ("a", 1.0), ("a", None), ("a", 1.0), ("a", 9.5), ("b", 2.0), ("c", None), (None, 4.0), (None, 5.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    want = df.groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, models.QUANTILES))).alias("q"))
    assert sorted(map(str, models.ranked(df, ["k"], "v").collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("places", [0, 3, 7])
def test_half_up_is_spark_round(spark, places):
    """Ties by the digits that are written, as 1.0005 or 2.675, large values and odd ones too."""
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.normal(0, 1e5, 3000), rng.integers(-10**6, 10**6, 3000) / 2000, rng.normal(0, 1e14, 300), [1.0005, 2.675, 0.5, -0.5, 1.5, -1e-9, 0.0, 1e300, 4e15 + 0.5, float("inf"), float("-inf"), float("nan")]])
    want = [r[0] for r in spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(F.round("v", places)).collect()]
    assert list(map(repr, features.half_up(values, places).tolist())) == list(map(repr, want))


def test_batches_round_and_leave_out(spark):
    """The rounded columns, of the rows asked for alone; the plan rounds nothing in the JVM."""
    df = fact(spark, [float(i * i) for i in range(40)]).withColumn("step", F.dayofmonth("date") - 20)
    places = {c: 3 for c in features.feature_names() if "_std_" in c}
    got, want = features.in_batches(df, places=places, only="step"), features.in_batches(df).where("step > 0")
    assert got.orderBy("date").collect() == want.select(*(F.round(c, places[c]).alias(c) if c in places else c for c in want.columns)).orderBy("date").collect()


def test_long_series_has_no_windows_of_rows(spark, monkeypatch):
    """Its frames are computed in batches; what is left numbers rows and sums counts."""
    from tidemark.plans import catalogue

    seen = []
    monkeypatch.setattr(features, "in_ranges", lambda df, build, reach, rows: seen.append(build(df)) or build(df))
    catalogue.queries()["w1_w3_long_series"](spark, "/root/testdata/sf0.001")
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Window" not in plan


def test_build_drops_sparse_rows_where_it_computes_them(spark):
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(i), "meta", c, c, None, None if i % 3 else 1.5 * i, float(i), i, 2 * i, 1.0, 2.0) for c in ("a", "b") for i in range(40)]
    df = spark.createDataFrame(rows, "date date, channel string, campaign_id string, campaign_name string, campaign_type string, spend double, revenue double, clicks long, impressions long, conversions double, daily_budget double")
    built = features.build(df)
    want = features.drop_sparse_rows(features.in_batches(features.ratio_features(features.time_features(df))))
    assert 0 < want.count() < len(rows)
    assert sorted(map(str, built.collect())) == sorted(map(str, want.collect()))
    plan = built._jdf.queryExecution().optimizedPlan().toString()
    assert not any(line.strip(" :+-").startswith("Filter") for line in plan.splitlines())  # a filter over so many columns isn't compiled


def test_placed_rows_give_the_same_without_sorting(spark):
    from tidemark.operators import forecast, uncertainty

    rows = [(dt.date(2024, 1, 1) + dt.timedelta(i // 2 if c == "a" else i), "meta", c, c, None, 1.0 * i, None if i % 7 == 3 else 0.0 if 20 < i < 20 + k else 2.0 * i, i, i, 1.0, 2.0) for c, k in (("a", 5), ("b", 46), ("c", 50)) for i in range(15 if c == "c" else 110)]
    df = spark.createDataFrame(rows, "date date, channel string, campaign_id string, campaign_name string, campaign_type string, spend double, revenue double, clicks long, impressions long, conversions double, daily_budget double")
    placed = features.placed(df).localCheckpoint()
    steps = {
        "eligible": lambda x: forecast.eligible(x, 30, 60),
        "last": lambda x: features.last_rows(x, 7),
        "train": lambda x: uncertainty.holdout(x)[0],
        "actuals": lambda x: uncertainty.holdout(x)[1],
        "history of train": lambda x: forecast.eligible(uncertainty.holdout(x)[0], 30, 60),
        "flags of train": lambda x: baselines.history_flags(uncertainty.holdout(x)[0], 20),
        "runs": lambda x: baselines.zero_revenue(x),
        "inflation": lambda x: baselines.cost_inflation(x),
    }
    for name, step in steps.items():
        want, own = step(df), step(placed)
        lists = lambda x, columns=want.columns: sorted(map(str, x.select(*columns).collect()))
        assert lists(own) == lists(want), name
        assert "Window" not in own._jdf.queryExecution().optimizedPlan().toString(), name


def test_future_features_see_a_history_that_a_shuffle_dealt(spark):
    """Spark 4.1 takes a union of two parts dealt by campaign_id as dealt by it, and then reads them in different numbers of partitions."""
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(i), "google", f"c{c}", "n" * 50, "SEARCH", 1.0, float(c), 1, 1, 1.0, 1.0) for c in range(40) for i in range(90)]
    own = {"spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        history = forecast.eligible(spark.createDataFrame(rows, UNIFIED))
        got = forecast.future_features(history, forecast.expected_future(history, 5), windows=(7,), lags=(14,)).select("campaign_id", "step", "revenue_roll_mean_7", "revenue_lag_14").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {(r.campaign_id, r.step): (r.revenue_roll_mean_7, r.revenue_lag_14) for r in got} == {(f"c{c}", s): (float(c), float(c)) for c in range(40) for s in range(1, 6)}
