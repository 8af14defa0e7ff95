"""The whole run: files to report. python -m tidemark.plans.pipeline --data-dir ... --model-path ... --output-dir ..."""

from __future__ import annotations

import argparse
import hashlib
import json
import logging
import sys

from pyspark.sql import DataFrame, SparkSession

from ..config import Config
from ..operators import baselines as B
from ..operators import boosting, decision, features, forecast, models, quality, report, scenario, uncertainty
from ..sessions import cut
from ..sources import csv

LOG = logging.getLogger("tidemark")
Model = models.ForestQuantiles | boosting.BoostedQuantiles


class JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        return json.dumps({"level": record.levelname, "event": record.getMessage(), **getattr(record, "fields", {})})


def stamp(config: Config, columns: list[str]) -> str:
    """Names the settings and features that a stored model was fitted for."""
    return hashlib.sha256(json.dumps([config.values["forecast"], config.values["features"], columns], sort_keys=True).encode()).hexdigest()


def new_model(config: Config, columns: list[str] | None = None) -> Model:
    """Boosted trees, or a forest if forecast.model says so."""
    columns = columns or features.feature_names(config.get("features.rolling_windows"), config.get("features.lag_windows"))
    seed = config.get("project.random_seed", 42)
    if config.get("forecast.model", "boosting") == "forest":
        return models.ForestQuantiles(seed=seed, columns=columns)
    return boosting.BoostedQuantiles(rounds=config.get("forecast.boosting_rounds", 20), seed=seed, columns=columns)


def fitted(spark: SparkSession, feature_df: DataFrame, config: Config, path: str | None, retrain: bool) -> Model:
    model = new_model(config)
    name = stamp(config, model.columns)
    if path and not retrain:
        try:
            return type(model).load(spark, path, name)
        except ValueError:
            raise
        except Exception as e:  # no stored model yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
    model.fit(feature_df)
    if path:
        model.save(path, name)
    return model


def run(spark: SparkSession, fact: DataFrame, config: Config | None = None, model_path: str | None = None, retrain: bool = False, use_cleaned: bool = False) -> dict[str, DataFrame]:
    """All results by name. The unchecked fact is used, as the checks only report, unless use_cleaned."""
    config = config or Config()
    checked = quality.validate(fact, config.get("validation.valid_campaign_types"), config.get("validation.max_missing_ratio"), config.get("validation.max_duplicate_ratio"), config.get("validation.max_future_days"))
    feature_df = cut(features.build(checked.cleaned if use_cleaned else fact, config.get("features.rolling_windows"), config.get("features.lag_windows"), config.get("features.max_na_ratio")))
    horizons, least, lookback = config.get("forecast.horizons"), config.get("forecast.min_history_days"), config.get("forecast.lookback_window")
    model = fitted(spark, feature_df, config, model_path, retrain)
    points = cut(forecast.forecast(feature_df, model, horizons, least, lookback))
    train, actuals = uncertainty.holdout(feature_df, config.get("uncertainty.calibration_holdout_days"))
    alpha = None
    if actuals.count() >= 100:
        held = new_model(config, model.columns).fit(train)
        alpha = cut(uncertainty.calibrate(forecast.forecast(train, held, horizons, least, lookback), actuals, config.get("uncertainty.target_coverage")))
    entities = cut(uncertainty.by_entity(uncertainty.by_series(points, alpha, config.get("uncertainty.relative_width_threshold"))))
    base = cut(B.baselines(feature_df))
    results = cut(scenario.simulate(base, scenario.scenarios(spark), model=model, feature_df=feature_df))
    assessed = cut(decision.assess(base, entities, feature_df, config.get("decision.min_roas_target"), config.get("decision.volatility_threshold"), config.get("decision.cost_inflation_threshold"), config.get("decision.concentration_threshold"), config.get("decision.zero_revenue_threshold_days")))
    found = cut(decision.recommend(assessed, base, config.get("decision.max_change_ratio")))
    out = {"issues": checked.issues, "statistics": checked.statistics, "features": feature_df, "points": points, "entities": entities, "channels": uncertainty.by_channel(entities), "overall": uncertainty.overall(entities), "baselines": base, "results": results, "assessments": assessed, "recommendations": found}
    if alpha is not None:
        out["alpha"] = alpha
    return out


def write(out: dict[str, DataFrame], directory: str, config: Config | None = None, copy: str | None = None) -> None:
    """forecasts, uncertainty, simulations and recommendations as CSV folders, summary as a JSON folder; the forecasts at the path copy as well, if given."""
    config = config or Config()
    places = config.get("report.decimal_places")
    for path in filter(None, (f"{directory}/forecasts.csv", copy)):
        report.write_csv(report.forecasts(out["points"], places, config.get("report.include_raw_forecasts")), path, report.ORDERS["forecasts"])
    report.write_csv(report.uncertainty(out["entities"], places), f"{directory}/uncertainty.csv", report.ORDERS["uncertainty"])
    report.write_csv(report.simulations(out["results"], places), f"{directory}/simulations.csv", report.ORDERS["simulations"])
    report.write_csv(report.recommendations(out["recommendations"], places), f"{directory}/recommendations.csv", report.ORDERS["recommendations"])
    report.write_json(report.summary(out["points"], out["overall"], out["results"], out["recommendations"], out["assessments"], places), f"{directory}/summary.json")


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser()
    for name in ("--data-dir", "--output-dir"):
        p.add_argument(name, required=True)
    p.add_argument("--model-path")
    p.add_argument("--config")
    p.add_argument("--forecasts-copy")
    p.add_argument("--force-retrain", action="store_true")
    a = p.parse_args(args)
    handler = logging.StreamHandler(sys.stdout)
    handler.setFormatter(JsonLines())
    LOG.addHandler(handler)
    config = Config(a.config)
    LOG.setLevel(config.get("logging.level", "INFO"))
    spark = SparkSession.builder.getOrCreate()
    try:
        fact = csv.ingest(spark, a.data_dir)
    except (csv.IngestionError, FileNotFoundError) as e:
        LOG.error("ingestion_failed", extra={"fields": {"error": str(e)}})
        sys.exit(1)
    write(run(spark, fact, config, a.model_path, a.force_retrain), a.output_dir, config, a.forecasts_copy)
    LOG.info("pipeline_complete", extra={"fields": {"output_dir": a.output_dir}})


if __name__ == "__main__":
    main()
