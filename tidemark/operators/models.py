"""Quantile models for forecasts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import d
from ..sessions import written
from . import features

QUANTILES = (0.1, 0.5, 0.9)
NAMES = ("q10", "q50", "q90")


def ranked(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, q: each group's QUANTILES of value as F.percentile gives them, by rank, so that no task holds a group's values. q is null without values."""
    order = W.partitionBy(*keys).orderBy(F.asc_nulls_last(value))
    last = F.count(value).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) - 1
    own = df.select(*keys, F.col(value).cast("double").alias("_v"), (F.row_number().over(order) - 1).alias("_at"), last.alias("_last"))

    def at(place: Column) -> Column:
        return F.max(F.when(F.col("_at") == place, F.col("_v")))

    ends = {f"_{i}{end}": at(f(F.col("_last") * d(share))) for i, share in enumerate(QUANTILES) for end, f in (("low", F.floor), ("high", F.ceil))}
    found = own.groupBy(*keys).agg(F.max("_last").alias("_last"), *(c.alias(n) for n, c in ends.items()))

    def between(i: int, share: float) -> Column:
        place, low, high = F.col("_last") * d(share), F.col(f"_{i}low"), F.col(f"_{i}high")
        return F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)

    return found.select(*keys, F.when(F.col("_last") >= 0, F.array(*(between(i, share) for i, share in enumerate(QUANTILES)))).alias("q"))


class WeekdayQuantiles:
    """Quantiles of revenue by campaign and weekday; of the campaign for a weekday without rows. All in SQL, so it has an exact oracle."""

    columns = ()  # it reads no features of the days to come

    def fit(self, df: DataFrame) -> WeekdayQuantiles:
        own = df.select("campaign_id", F.weekday("date").alias("dow"), "revenue").repartition("campaign_id")
        days = ranked(own, ["campaign_id", "dow"], "revenue")
        week = days.where("dow IS NOT NULL").groupBy("campaign_id").agg(F.map_from_entries(F.collect_list(F.struct("dow", "q"))).alias("q_day"))  # seven entries
        self.quantiles = written(ranked(own, ["campaign_id"], "revenue").withColumnRenamed("q", "q_all").join(week, "campaign_id", "left"))
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        out = df.join(self.quantiles, "campaign_id", "left")
        q = F.coalesce(F.try_element_at("q_day", F.weekday("date")), "q_all")
        return out.withColumns({n: q[i] for i, n in enumerate(NAMES)}).drop("q_day", "q_all")


class SpendQuantiles:
    """Quantiles of revenue per unit of spend, of a campaign's days with spend, times the spend of the day, so budgets move forecasts; 0 without such days. Has an exact oracle too."""

    columns = ("spend",)

    def fit(self, df: DataFrame) -> SpendQuantiles:
        own = df.where("spend > 0").select("campaign_id", (F.col("revenue") / F.col("spend")).alias("return"))
        self.returns = written(ranked(own, ["campaign_id"], "return"))
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        return df.join(self.returns, "campaign_id", "left").withColumns({n: F.coalesce(F.col("q")[i] * F.col("spend"), d(0)) for i, n in enumerate(NAMES)}).drop("q")


class ForestQuantiles:
    """A quantile regression forest: a random forest's leaves keep the quantiles of their training targets, and a prediction is their mean over the trees.

    Fitting, the leaves' quantiles and predictions are Spark jobs. There are at most trees * 2 ** depth leaves, so their table is broadcast.
    Missing features become -1, with a second column that tells so. leaky_ratios=False leaves out the ratios that contain the same day's revenue.
    """

    def __init__(self, trees: int = 20, depth: int = 5, least: int = 20, seed: int = 42, leaky_ratios: bool = True, columns: Sequence[str] | None = None):
        self.trees, self.depth, self.least, self.seed = trees, depth, least, seed
        named = list(columns or features.feature_names())
        self.columns = [c for c in named if leaky_ratios or c not in ("roas", "revenue_per_impression")]

    def _vector(self, df: DataFrame, *kept: str) -> DataFrame:
        """The columns kept, and _features, put together a batch at a time."""
        lags = [i for i, c in enumerate(self.columns) if "_lag_" in c or "_mean_" in c]
        width = len(self.columns) + len(lags)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n, columns = len(batch), batch.columns[len(kept) :]
                values = np.empty((n, width))
                for i, c in enumerate(columns):
                    values[:, i] = c.fill_null(-1.0).to_numpy(zero_copy_only=False)
                for i, lag in enumerate(lags, len(columns)):
                    values[:, i] = columns[lag].is_null().to_numpy(zero_copy_only=False)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.ravel()))
                dense = [pa.array(np.ones(n, np.int8)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.int32())), lists]  # as VectorUDT has it
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.StructArray.from_arrays(dense, ["type", "size", "indices", "values"])], [*kept, "_features"])

        wide = df.select(*kept, *(F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(self.columns)))
        return wide.mapInArrow(run, T.StructType([*wide.schema.fields[: len(kept)], T.StructField("_features", VectorUDT())]))

    def fit(self, df: DataFrame) -> ForestQuantiles:
        train = self._vector(df.where("revenue IS NOT NULL").withColumn("revenue", F.col("revenue").cast("double")), "revenue")
        self.model = RandomForestRegressor(featuresCol="_features", labelCol="revenue", predictionCol="_mean", leafCol="_leaf", numTrees=self.trees, maxDepth=self.depth, minInstancesPerNode=self.least, featureSubsetStrategy="onethird", subsamplingRate=0.8, seed=self.seed).fit(train)
        leaves = self.model.transform(train).select("revenue", F.posexplode(vector_to_array("_leaf")).alias("tree", "leaf"))
        # a leaf may hold a third of all rows, so its quantiles come from a sketch of bounded size, within 1 / 10,000 of their ranks
        self.leaves = leaves.groupBy("tree", "leaf").agg(F.percentile_approx("revenue", list(QUANTILES), 10_000).alias("q"))
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        """No shuffle: a row's leaves, by tree, are looked up in one broadcast array of all leaves' quantiles."""
        width = 2**self.depth
        places = df.sparkSession.range(self.trees * width).select(F.col("id").alias("place"))
        known = self.leaves.select((F.col("tree") * width + F.col("leaf").cast("long")).alias("place"), "q")
        # trees * 2 ** depth entries
        table = places.join(known, "place", "left").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "q"))), lambda x: x["q"]).alias("_table"))
        at = self.model.transform(self._vector(df, *df.columns)).select(*df.columns, vector_to_array("_leaf").alias("_leaf")).crossJoin(F.broadcast(table))
        found = F.filter(F.transform("_leaf", lambda leaf, i: F.get("_table", (i * width + leaf).cast("int"))), lambda q: q.isNotNull())

        def mean(j: int) -> Column:
            return F.aggregate(found, d(0), lambda total, q: total + q[j]) / F.size(found)

        return at.select(*df.columns, *(mean(i).alias(n) for i, n in enumerate(NAMES)))

    def save(self, path: str, stamp: str = "") -> None:
        """The forest, the leaves' quantiles, and a stamp of what it was fitted for."""
        self.model.write().overwrite().save(f"{path}/forest")
        self.leaves.write.mode("overwrite").parquet(f"{path}/leaves")
        spark = self.leaves.sparkSession
        spark.createDataFrame([(stamp, self.trees, self.depth, self.least, self.seed, self.columns)], "stamp string, trees int, depth int, least int, seed int, columns array<string>").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")

    @classmethod
    def load(cls, spark, path: str, stamp: str = "") -> ForestQuantiles:
        """ValueError if the stored model was fitted for another stamp."""
        from pyspark.ml.regression import RandomForestRegressionModel

        about = spark.read.parquet(f"{path}/about").first()
        if about.stamp != stamp:
            raise ValueError("the stored model was fitted with other settings or features")
        own = cls(about.trees, about.depth, about.least, about.seed, columns=list(about.columns))
        own.model = RandomForestRegressionModel.load(f"{path}/forest")
        own.leaves = spark.read.parquet(f"{path}/leaves")
        return own
