import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark.config import DEFAULTS
from tidemark.operators import baselines, decision, forecast, models, quality, report, scenario, uncertainty
from tidemark.plans import pipeline
from tidemark.schema import UNIFIED
from tidemark.sessions import written
from tidemark.streaming import drops

ALLOWED = DEFAULTS["validation"]["valid_campaign_types"]
POINT = "entity_id string, channel string, metric string, horizon int, step int, date date, p10 double, p50 double, p90 double"
BASE = "entity_id string, channel string, campaign_type string, total_spend double, total_revenue double, last_daily_spend double, last_daily_budget double, historical_roas double"
PAIR = "entity_id string, channel string, horizon int, date date, actual double, p10 double, p50 double, p90 double"


def campaigns(spark, days=60, n=2):
    start = dt.date(2025, 1, 1)
    rows = [(start + dt.timedelta(days=i), "google", f"google_{k}", f"n{k}", "SEARCH", 10.0 + k + i % 7, 100.0 + 2 * i + 10 * (i % 7), 5 + i % 3, 100, 2.0, 50.0) for k in range(n) for i in range(days)]
    return spark.createDataFrame(rows, UNIFIED)


def test_quality_report(spark):
    good = campaigns(spark, 10)
    bad = good.withColumn("spend", F.when(F.dayofmonth("date") == 3, -5.0).otherwise(F.col("spend"))).unionByName(good.limit(2))
    bad = bad.withColumn("campaign_type", F.when(F.dayofmonth("date") != 4, F.col("campaign_type")))
    out = quality.validate(bad, ALLOWED)
    found = {(r.check, r.severity, r.subject): r["count"] for r in out.issues.collect()}
    assert found["negative_spend", "warning", ""] == 2
    assert found["missing_values", "warning", "campaign_type"] == 2
    assert found["duplicate_rows", "error", ""] == 2
    assert found["invalid_campaign_types", "warning", "google"] == 2
    assert ("channel_coverage", "error", "meta") in found
    said = {(r.check, r.subject): (r.message, r.samples) for r in out.issues.collect()}
    assert said["negative_spend", ""] == ("Found 2 rows with negative spend. Values have been clamped to 0.0.", ["-5.0", "-5.0"])
    assert said["duplicate_rows", ""] == ("Found and removed 2 duplicate rows (9.1% of data).", ["0", "1"])
    assert said["invalid_campaign_types", "google"][1] == ["None"]
    assert said["channel_coverage", "meta"] == ("Channel 'meta' is missing from the data. Forecasts for this channel will not be generated.", ["meta"])
    assert out.cleaned.where("spend < 0").count() == 0
    assert not out.passed.first()[0]
    assert out.statistics.first().rows_removed == 2


@pytest.mark.parametrize("reference", [None, "2025-01-07"])
def test_validation_equals_the_checks_one_by_one(spark, reference):
    """All issues with their messages and samples, and the rows that are left; with copies, clamped rows that become equal, nulls in each column."""
    good = campaigns(spark, 12, 3)
    odd = good.withColumn("spend", F.when(F.dayofmonth("date") == 3, -5.0).when(F.dayofmonth("date") == 5, None).otherwise(F.col("spend") * 4)).withColumn("campaign_type", F.when(F.dayofmonth("date") % 4 != 0, F.lit("ODD")))
    odd = odd.withColumn("impressions", F.when(F.dayofmonth("date") != 3, F.col("impressions")).otherwise(0))
    bad = good.unionByName(odd).unionByName(odd.limit(3)).unionByName(odd.where("spend < 0").withColumn("spend", F.lit(-6.0)))
    bad = bad.unionByName(good.limit(2).select(*(F.lit(None).cast(t).alias(c) for c, t in good.dtypes)))
    out = quality.validate(bad, ALLOWED, reference=reference)
    issues, at = [], bad
    for check, settings in ((quality.missing_values, {}), (quality.negative_spend, {}), (quality.duplicate_rows, {}), (quality.future_dates, {"reference": reference}), (quality.invalid_campaign_types, {"allowed": ALLOWED}), (quality.budget_consistency, {}), (quality.zero_activity, {}), (quality.channel_coverage, {"expected": tuple(ALLOWED)})):
        found, at = check(at, **settings)
        issues += found.collect()
    assert len(issues) >= 14
    assert sorted(map(repr, out.issues.collect())) == sorted(map(repr, issues))
    assert sorted(map(repr, out.cleaned.collect())) == sorted(map(repr, at.collect()))
    assert out.statistics.select(*sorted(out.statistics.columns)).collect() == quality.statistics(bad, at).select(*sorted(out.statistics.columns)).collect()
    none = quality.validate(bad.limit(0), ALLOWED, reference=reference)
    assert {(r.check, r.severity) for r in none.issues.collect()} == {("channel_coverage", "error")} and none.statistics.first().rows_after == 0


def test_validation_computes_its_input_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    df = campaigns(spark, 30)
    out = quality.validate(df.unionByName(df.limit(5)).repartition(3).mapInArrow(counted, df.schema), ALLOWED)
    assert out.issues.count() == 3 and out.statistics.first().rows_removed == 5 and out.cleaned.count() == 60
    assert read.value == 65


def test_full_coverage_is_a_warning(spark):
    df = spark.createDataFrame([("a",), ("b",)], "channel string")
    assert [(r.severity, r["count"]) for r in quality.channel_coverage(df, ["a", "b"])[0].collect()] == [("warning", 0)]
    assert quality.channel_coverage(df.drop("channel").withColumn("x", F.lit(1)), ["a"])[0].first().severity == "error"


def test_future_dates(spark):
    df = campaigns(spark, 10)
    issues, kept = quality.future_dates(df, "2025-01-06")
    assert issues.first().severity == "error" and kept.count() == 12
    assert quality.future_dates(df)[0].count() == 0


def test_seasonal_naive(spark):
    df = spark.createDataFrame([(dt.date(2025, 1, 1) + dt.timedelta(days=i), "c", 100.0 + 2 * i, *[0.0] * 5) for i in range(10)], "date date, campaign_id string, revenue double, spend double, clicks double, impressions double, conversions double, daily_budget double")
    days = spark.createDataFrame([("c", dt.date(2025, 1, 15)), ("x", dt.date(2025, 1, 15))], "campaign_id string, date date")
    got = {r.campaign_id: r.naive for r in forecast.naive_predict(days, forecast.naive_fit(df)).collect()}
    assert got == {"c": 114.0, "x": 0.0}


def test_forecast_shape_and_order(spark):
    df = campaigns(spark)
    points = forecast.forecast(df, models.WeekdayQuantiles().fit(df)).cache()
    assert points.count() == 2 * 180
    assert points.where("p10 > p50 OR p50 > p90 OR p10 < 0").count() == 0
    short, long = (points.where(f"horizon = {h} AND step <= 30").orderBy("entity_id", "step").select("p50").collect() for h in (30, 90))
    assert short == long
    assert forecast.forecast(df.where("date < '2025-01-20'"), models.WeekdayQuantiles().fit(df)).count() == 0


def test_forest_saves_and_refuses_another_stamp(spark, tmp_path):
    from tidemark.operators import features

    built = features.build(campaigns(spark)).cache()
    model = models.ForestQuantiles(trees=3, depth=3, least=5).fit(built)
    got = model.predict(built).select("q10", "q50", "q90").toPandas()
    assert (got.q10 <= got.q90).all() and len(got) == built.count()
    model.save(str(tmp_path / "m"), "a")
    assert models.ForestQuantiles.load(spark, str(tmp_path / "m"), "a").predict(built).count() == built.count()
    with pytest.raises(ValueError):
        models.ForestQuantiles.load(spark, str(tmp_path / "m"), "b")


@pytest.mark.parametrize(("scores", "alpha"), [([0.5, 0.6, 0.7], 0.7), ([1.0, 2.0, 100.0, 200.0, 300.0], 300.0), ([], 1.0), ([2.0], 2.0)])
def test_order_statistic(spark, scores, alpha):
    df = spark.createDataFrame([(s,) for s in scores], "score double")
    assert uncertainty.order_statistic(df).first().alpha == alpha


def pair_frame(spark):
    return spark.createDataFrame([(e, "google", 30, dt.date(2025, 1, i), a, 10.0, 20.0, 30.0) for e in ("a", "b") for i, a in ((1, 15.0), (2, 25.0), (3, 35.0))], PAIR)


def test_nonconformity_and_coverage(spark):
    pairs = pair_frame(spark)
    below = spark.createDataFrame([("a", "g", 30, dt.date(2025, 1, 1), 0.0, 10.0, 20.0, 30.0)], PAIR)
    assert uncertainty.scored(below, "scaling_factor").first().score == 2.0
    assert uncertainty.coverage(pairs, 1.0).first().coverage == pytest.approx(2 / 3)
    assert uncertainty.coverage(pairs, 2.0).first().coverage == 1.0
    assert uncertainty.coverage(pairs.limit(0)).first().coverage == 0.0
    assert sum(r["count"] for r in uncertainty.reliability(pairs).collect()) == 6


def test_calibration_needs_ten_pairs(spark):
    points = spark.createDataFrame([("a", "g", "revenue", 30, i, dt.date(2025, 1, i), 10.0, 20.0, 30.0) for i in range(1, 13)], POINT)
    actuals = spark.createDataFrame([(dt.date(2025, 1, i), "g", "a", "n", "t", 1.0, 20.0 + i, 1, 1, 1.0, 1.0) for i in range(1, 13)], UNIFIED)
    assert uncertainty.calibrate(points, actuals).first().alpha == pytest.approx(sorted(i / 10 for i in range(1, 13))[math.ceil(13 * 0.8) - 1])
    assert uncertainty.calibrate(points, actuals.where("date <= '2025-01-09'")).first().alpha == 1.0


def test_trend_and_merge(spark):
    rows = [("a", "g", "revenue", 30, i, dt.date(2025, 1, i), 100.0 - 5 * i, 100.0, 100.0 + 5 * i) for i in range(1, 11)] + [("b", "g", "revenue", 30, i, dt.date(2025, 1, i), 90.0, 100.0, 110.0) for i in range(1, 11)]
    series = uncertainty.by_series(spark.createDataFrame(rows, POINT))
    got = {r.entity_id: r for r in series.collect()}
    assert got["a"].stability_trend == "widening" and got["b"].stability_trend == "stable" and got["b"].volatility == pytest.approx(0)
    entities = uncertainty.by_entity(series)
    assert uncertainty.overall(entities.limit(0)).first().overall_confidence == 1.0
    assert uncertainty.by_channel(entities).first().campaign_count == 2


def base_frame(spark, *rows):
    return spark.createDataFrame([(*r[:2], "SEARCH", *r[2:]) for r in rows], BASE)


def test_formula_accumulates_and_floors(spark):
    base = base_frame(spark, ("a", "google", 500.0, 2000.0, 50.0, 100.0, 4.0))
    points = spark.createDataFrame([("o", "g", "revenue", 30, i + 1, dt.date(2025, 1, i + 1), 0.0, 100.0 + i, 0.0) for i in range(30)], POINT)
    changes = spark.createDataFrame([("s", "a", 0, 50.0, None), ("s", "a", 1, 30.0, None), ("t", "a", 0, None, -2.0)], scenario.ADJUSTMENT)
    named = spark.createDataFrame([("s",), ("t",), ("u",)], "scenario string")
    got = {r.scenario: r for r in scenario.simulate(base, named, changes, points=points).collect()}
    assert got["s"].projected_spend == 580.0 and got["t"].projected_spend == 0.0
    assert got["u"].projected_revenue == pytest.approx(2000.0 + 100 * 30 + 435)


def test_both_kinds_of_change_at_once_fail(spark):
    changes = spark.createDataFrame([("s", "a", 0, 1.0, 2.0)], scenario.ADJUSTMENT)
    with pytest.raises(Exception, match="absolute or relative"):
        scenario.checked(changes).collect()


def test_allocation_clamps(spark):
    base = base_frame(spark, ("big", "google", 1000.0, 1.0, 1.0, 1.0, 1.0), ("small", "google", 10.0, 1.0, 1.0, 1.0, 1.0))
    assessments = spark.createDataFrame([("big", 0.1), ("small", 5.0)], "entity_id string, score double")
    got = {r.entity_id: r.allocation for r in decision.allocate(assessments, base).collect()}
    assert got["big"] >= 500 and got["small"] <= 15
    assert decision.allocate(assessments.limit(0), base).count() == 0


def test_assessment_flags_and_texts(spark):
    base = base_frame(spark, ("a", "google", 900.0, 900.0, 1.0, 1.0, 1.0), ("b", "google", 100.0, 500.0, 1.0, 1.0, 5.0))
    unc = spark.createDataFrame([("a", 0.2, 0.4, "stable")], "entity_id string, confidence_score double, volatility double, stability_trend string")
    got = {r.entity_id: r for r in decision.assess(base, unc).collect()}
    assert got["a"].flags == ["below_roas_target", "high_uncertainty", "concentration_risk"] and got["b"].flags == []
    assert got["b"].score == pytest.approx(5 / 3 * 0.5 / 1.5)
    texts = {r.entity_id: r.rationale for r in decision.recommend(decision.assess(base, unc), base).collect()}
    assert texts["b"].endswith("Campaign performing well.") and "Campaign ROAS is below target." in texts["a"]


def test_report_rounds_and_writes_headers(spark, tmp_path):
    empty = spark.createDataFrame([], POINT)
    report.write_csv(report.forecasts(empty), str(tmp_path / "f"))
    assert next((tmp_path / "f").glob("part-*.csv")).read_text().strip().startswith("entity_id,channel,horizon")


def test_many_report_files_are_as_one(spark, tmp_path):
    import json

    rows = [(f"c{i % 7}", "google", 30, "revenue", f"2025-01-{i % 28 + 1:02d}", float(i), 'a "quoted", text' if i % 2 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "entity_id string, channel string, horizon int, metric string, date string, p50 double, note string").repartition(5)

    def lines(name):
        files = sorted((tmp_path / name).glob("part-*.csv"))
        read = [f.read_text().splitlines() for f in files]
        assert len({r[0] for r in read}) == 1
        return [f.name for f in files], [x for r in read for x in r[1:]]

    order = ("entity_id", "date", "p50")
    report.write_csv(df, str(tmp_path / "one"), order)
    report.write_csv(df, str(tmp_path / "many"), order, rows_per_file=60)
    (one, want), (many, got) = lines("one"), lines("many")
    assert (len(one), len(many)) == (1, 9) and got == want and len(got) == 500
    listed = [json.loads(x) for f in (tmp_path / "many.manifest").glob("part-*.json") for x in f.read_text().splitlines()]
    assert [x["file"] for x in listed] == many and sum(x["rows"] for x in listed) == 500
    assert all(tuple(a["last"].values()) <= tuple(b["first"].values()) for a, b in zip(listed, listed[1:], strict=False))


def test_whole_run(spark, tmp_path):
    fact = campaigns(spark, 60, 3)
    few = pipeline.Config(values={"forecast": {"boosting_rounds": 3}})
    out = pipeline.run(spark, fact, few, model_path=str(tmp_path / "model"))
    assert "alpha" not in out  # 42 held-out rows are too few
    pipeline.write(out, str(tmp_path / "out"), copy=str(tmp_path / "copy"))
    files = [sorted(x for f in (tmp_path / name).glob("part-*") for x in f.read_text().splitlines()) for name in ("out/forecasts.csv", "copy")]
    assert files[0] == files[1] and len(files[0]) == 3 * 180 + 1
    summary = spark.read.json(str(tmp_path / "out/summary.json")).first()
    assert summary.campaigns_forecasted == 3 and summary.scenarios_simulated == 3
    again = pipeline.run(spark, fact, few, model_path=str(tmp_path / "model"))
    assert sorted(map(repr, again["points"].collect())) == sorted(map(repr, out["points"].collect()))
    with pytest.raises(ValueError):  # a model of another kind is not loaded
        pipeline.run(spark, fact, pipeline.Config(values={"forecast": {"model": "forest"}}), model_path=str(tmp_path / "model"))
    assert out["points"].count() == 3 * 180


def test_stream_of_drops(spark, tmp_path):
    df = campaigns(spark, 30, 2)
    df.unionByName(df).write.parquet(str(tmp_path / "in"))
    q = drops.cleaned(drops.read_drops(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("drops").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("drops").count() == 60
    w = drops.weekly_totals(drops.cleaned(drops.read_drops(spark, str(tmp_path / "in")))).writeStream.format("memory").queryName("weeks").trigger(availableNow=True).start()
    w.awaitTermination(60)
    assert spark.table("weeks").count() >= 1


def test_baselines_feed_the_default_scenarios(spark):
    base = baselines.baselines(campaigns(spark, 40))
    assert scenario.default_adjustments(base).count() == 4


def test_ranks_and_percentiles_are_exact(spark):
    """Whatever the buckets: equal, negative, tiny and huge scores."""
    import numpy as np

    from tidemark.operators import uncertainty

    rng = np.random.default_rng(3)
    values = [*rng.normal(size=300).tolist(), *[0.25] * 200, *(rng.random(50) * 1e-9).tolist(), 1e12, -1e12]
    df = spark.createDataFrame([(float(v),) for v in values], "score double").repartition(3)
    for k in (1, 2, 150, 400, len(values)):
        got = uncertainty.at_rank(df, spark.createDataFrame([(k,)], "k long")).first()
        assert got.value == sorted(values)[k - 1]
    assert uncertainty.at_rank(df, spark.createDataFrame([(len(values) + 1,)], "k long")).count() == 0
    for share in (0.0, 0.37, 0.5, 1.0):
        assert abs(uncertainty.percentile(df, share).first().value - np.percentile(values, share * 100)) < 1e-6


def test_forest_vectors_are_those_of_an_assembler(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    df = spark.createDataFrame([(1.0, 2, None, 0.5), (3.0, None, 4.0, None), (5.0, 6, 7.0, float("inf"))], "revenue double, month int, spend_lag_1 double, spend_roll_mean_7 double")
    model = models.ForestQuantiles(columns=["month", "spend_lag_1", "spend_roll_mean_7"])
    filled = df.select("revenue", *(F.coalesce(F.col(c).cast("double"), F.lit(-1.0)).alias(c) for c in model.columns), *(F.col(c).isNull().cast("double").alias(f"{c}_no") for c in model.columns[1:]))
    want = VectorAssembler(inputCols=filled.columns[1:], outputCol="_features").transform(filled)
    own = model._vector(df, "revenue")
    lists = lambda x: sorted((r.revenue, r.v) for r in x.select("revenue", vector_to_array("_features").alias("v")).collect())
    assert lists(own) == lists(want)
    assert "UDF" not in own._jdf.queryExecution().optimizedPlan().toString()  # rows aren't put together one by one


def test_coverage_by_series_reads_points_once_and_never_broadcasts_them(spark):
    day = dt.date(2025, 1, 1)
    rows = [(c, "meta", "revenue", h, s, day + dt.timedelta(s), 10.0, 20.0, 30.0) for c in ("a", "b") for h in (1, 2) for s in range(1, h + 1)]
    points = written(spark.createDataFrame(rows, POINT))
    actual = lambda s, revenue, spend=1.0: (day + dt.timedelta(s), "meta", "a", "n", "Generic", spend, revenue, 1, 1, 1.0, 1.0)
    actuals = spark.createDataFrame([actual(1, 15.0), actual(1, 99.0, 2.0), actual(2, 50.0), actual(9, 20.0)], UNIFIED)
    found = uncertainty.coverage_by_series(points, actuals)
    assert {tuple(r) for r in found.collect()} == {("a", 1, 1.0), ("a", 2, 0.5), ("b", 1, 0.0), ("b", 2, 0.0)}
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan") == 1 and "BuildLeft" not in plan
