"""Assessments of campaigns and recommended budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import d
from ..sessions import cut
from .baselines import history_flags

FLAGS = ("below_roas_target", "high_uncertainty", "zero_revenue", "cost_inflation", "concentration_risk")
#: What a recommendation says of each flag.
SENTENCES = {
    "below_roas_target": "Campaign ROAS is below target.",
    "high_uncertainty": "Forecast confidence is low.",
    "zero_revenue": "Campaign has prolonged zero revenue.",
    "cost_inflation": "Costs are outpacing revenue growth.",
    "concentration_risk": "Budget concentration is high.",
}


def score(min_roas: float):
    factor = F.least(F.col("current_roas") / d(min_roas), d(3)) if min_roas > 0 else d(1)
    return factor * F.col("confidence_score") * (1 / (1 + F.col("volatility")))


def assess(base: DataFrame, uncertainty: DataFrame, fact: DataFrame | None = None, min_roas: float = 3.0, volatility_threshold: float = 0.5, inflation: float = 0.2, concentration: float = 0.6, zero_days: int = 45) -> DataFrame:
    """entity_id, channel, campaign_type, current_spend, current_roas, confidence_score, volatility, stability_trend, flags (in the order of FLAGS), score.

    A campaign without an uncertainty gets 0.5, 0.5 and stable, and isn't flagged for it. Without a history there are no flags from it.
    """
    total = base.agg(F.sum("total_spend").alias("_sum")).select(F.when(F.col("_sum") == 0, d(1)).otherwise(F.coalesce("_sum", d(1))).alias("_total"))
    own = base.crossJoin(F.broadcast(total)).join(uncertainty.select("entity_id", F.col("confidence_score").alias("_c"), F.col("volatility").alias("_v"), F.col("stability_trend").alias("_t")), "entity_id", "left")  # total: one row
    if fact is not None:
        own = own.join(history_flags(fact, zero_days, inflation), "entity_id", "left")
    else:
        own = own.withColumns({"zero_revenue": F.lit(False), "cost_inflation": F.lit(False)})
    when = {
        "below_roas_target": F.col("historical_roas") < min_roas,
        "high_uncertainty": F.col("_c") < 1 - volatility_threshold,
        "zero_revenue": F.col("zero_revenue"),
        "cost_inflation": F.col("cost_inflation"),
        "concentration_risk": F.col("total_spend") / F.col("_total") > concentration,
    }
    flags = F.filter(F.array(*(F.when(when[f], f) for f in FLAGS)), lambda x: x.isNotNull())
    out = own.select("entity_id", "channel", "campaign_type", F.col("total_spend").alias("current_spend"), F.col("historical_roas").alias("current_roas"), F.coalesce("_c", d(0.5)).alias("confidence_score"), F.coalesce("_v", d(0.5)).alias("volatility"), F.coalesce("_t", F.lit("stable")).alias("stability_trend"), flags.alias("flags"))
    return out.withColumn("score", score(min_roas))


def allocate(assessments: DataFrame, base: DataFrame, max_change: float = 0.5, rounds: int = 10) -> DataFrame:
    """entity_id, allocation: the total budget shared by score (evenly if all are 0), each within max_change of its present spend.

    A round clamps the campaigns that are still free; those that hit a bound are fixed, and what is left is shared among the free by score, if both
    are over 0. It ends when a round fixes none, when none is free, or after rounds rounds; the last sharing isn't clamped again then,
    and the total need not be kept. Campaigns without a baseline count in the first sharing's total only. A round's three sums are all that
    the driver sees.
    """
    points = F.greatest("score", d(0))
    totals = base.agg(F.coalesce(F.sum("total_spend"), d(0))).first()[0]
    count, total_score = assessments.agg(F.count("*"), F.coalesce(F.sum(points), d(0))).first()
    if not count:
        return assessments.select("entity_id", d(0).alias("allocation"))
    own = assessments.select("entity_id", points.alias("points")).join(base.select("entity_id", F.col("total_spend").alias("spend")), "entity_id")
    share = F.col("points") / d(total_score) if total_score > 0 else d(1.0 / count)
    state = cut(own.select("*", (d(totals) * share).alias("allocation"), F.lit(True).alias("free")))
    low, high = F.greatest(d(0), F.col("spend") - F.col("spend") * max_change), F.col("spend") + F.col("spend") * max_change
    for i in range(rounds):
        hit = F.col("free") & ((F.col("allocation") < low) | (F.col("allocation") > high))
        clamped = state.select("entity_id", "points", "spend", F.when(hit, F.least(F.greatest("allocation", low), high)).otherwise(F.col("allocation")).alias("allocation"), (F.col("free") & ~hit).alias("free"), hit.alias("hit"))
        fixed, free, fixed_spend, free_points = clamped.agg(F.count_if("hit"), F.count_if("free"), F.coalesce(F.sum(F.when(~F.col("free"), F.col("allocation"))), d(0)), F.coalesce(F.sum(F.when(F.col("free"), F.col("points"))), d(0))).first()
        state = clamped.drop("hit")
        if not fixed or not free:
            break
        if free_points > 0 and totals - fixed_spend > 0:
            state = state.withColumn("allocation", F.when(F.col("free"), d(totals - fixed_spend) * (F.col("points") / d(free_points))).otherwise(F.col("allocation")))
        if i % 3 == 2:
            state = cut(state)
    return state.select("entity_id", "allocation")


def rationale():
    """Text from current_budget, recommended_budget and flags."""
    change = F.col("recommended_budget") - F.col("current_budget")
    whole = lambda x: F.bround(x, 0).cast("bigint").cast("string")
    share = F.when(F.col("current_budget") > 0, F.abs(change) / F.col("current_budget") * 100).otherwise(d(0))
    moved = F.concat(F.when(change > 0, "Increase").otherwise("Decrease"), F.lit(" budget "), whole(share), F.lit("% ($"), whole(F.abs(change)), F.lit(")."))
    told = [F.when(F.array_contains("flags", f), SENTENCES[f]) for f in FLAGS]
    return F.concat_ws(" ", F.when(F.abs(change) < 1, "Maintain current budget.").otherwise(moved), *told, F.when(F.size("flags") == 0, "Campaign performing well."))


def recommend(assessments: DataFrame, base: DataFrame, max_change: float = 0.5) -> DataFrame:
    """entity_id, channel, current_budget, recommended_budget, expected_roas, rationale of the assessed campaigns with a baseline."""
    own = assessments.join(base.select("entity_id", F.col("total_spend").alias("current_budget")), "entity_id").join(allocate(assessments, base, max_change), "entity_id")
    out = own.withColumn("recommended_budget", F.greatest(d(0), F.col("allocation"))).withColumn("rationale", rationale())
    return out.select("entity_id", "channel", "current_budget", "recommended_budget", F.col("current_roas").alias("expected_roas"), "rationale")


def summary(assessments: DataFrame, recommendations: DataFrame, base: DataFrame) -> DataFrame:
    a = assessments.agg(F.count("*").alias("campaigns_assessed"), F.count_if(F.size("flags") > 0).alias("campaigns_flagged"), F.coalesce(F.sum(F.size("flags").cast("long")), F.lit(0)).alias("total_flags"))
    r = recommendations.agg(F.coalesce(F.sum("recommended_budget"), d(0)).alias("total_recommended_budget"), F.count("*").alias("recommendations_generated"))
    b = base.agg(F.coalesce(F.sum("total_spend"), d(0)).alias("total_current_budget"))
    return b.crossJoin(r).crossJoin(a).withColumn("budget_change", F.col("total_recommended_budget") - F.col("total_current_budget"))  # one row each
