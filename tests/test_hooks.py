import datetime as dt
import itertools
import statistics

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import hooks
from tidemark.schema import UNIFIED


def fact(spark, series):
    rows = [(dt.date(2025, 1, 1) + dt.timedelta(i), "google", c, "n", "SEARCH", 1.0, v, 1, 2, 1.0, 5.0) for c, values in series.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, UNIFIED).repartition(3)


def test_own_feature_sees_rows_in_order(spark):
    df = fact(spark, {"a": [3.0, 1.0, 2.0], "b": [5.0], None: [7.0, 8.0]})

    def total(rows: pd.DataFrame, scale: float) -> pd.DataFrame:
        return pd.DataFrame({"so_far": rows["revenue"].cumsum() * scale, "name": [str(len(rows))] * len(rows)})

    got = hooks.per_campaign(df.withColumn("name", F.lit(0)), total, "so_far double, name string", scale=2.0)
    assert got.columns == [*df.columns, "so_far", "name"]
    assert sorted(((r.campaign_id, str(r.date), r.so_far, r.name) for r in got.collect()), key=repr) == sorted([("a", "2025-01-01", 6.0, "3"), ("a", "2025-01-02", 8.0, "3"), ("a", "2025-01-03", 12.0, "3"), ("b", "2025-01-01", 10.0, "1"), (None, "2025-01-01", 14.0, "2"), (None, "2025-01-02", 30.0, "2")], key=repr)
    assert hooks.per_campaign(df.limit(0), total, "so_far double, name string", scale=1.0).count() == 0


def test_sizes_are_checked(spark):
    df = fact(spark, {"a": [1.0] * 6, "b": [1.0]})
    with pytest.raises(Exception, match="campaign a has 6 rows, more than 5"):
        hooks.per_campaign(df, lambda rows: rows.assign(x=1.0), "x double", most_rows=5).count()
    with pytest.raises(Exception, match="gave 1 rows for 6"):
        hooks.per_campaign(df, lambda rows: rows.head(1).assign(x=1.0), "x double").where("campaign_id = 'a'").count()


def test_theil_sen_against_all_pairs(spark):
    series = {"a": [1.0, 5.0, None, 2.0, 9.0, 9.0], "b": [4.0], "c": [None, 2.0, None], "d": [float((i * 37) % 11) for i in range(25)]}
    got = {r.entity_id: r.trend for r in hooks.trends(fact(spark, series), lookback=20).collect()}
    for name, values in series.items():
        known = [(i, v) for i, v in enumerate(values[-20:]) if v is not None]
        slopes = [(w - v) / (j - i) for (i, v), (j, w) in itertools.combinations(known, 2)]
        assert got[name] == (pytest.approx(statistics.median(slopes)) if slopes else None)
