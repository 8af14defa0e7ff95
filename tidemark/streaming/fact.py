"""The unified fact as a table that drops of rows keep up to date, whether they come late, out of order or again."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..schema import COLUMNS, METRICS, UNIFIED

#: The unified columns, and the number of the drop that a row came with: of rows of one campaign and day the one of the highest counts.
DROPPED = T.StructType([*UNIFIED.fields, T.StructField("drop", T.LongType())])
KEYS = ("campaign_id", "date")


def read_drops(spark: SparkSession, path: str, files_per_batch: int = 10) -> DataFrame:
    return spark.readStream.schema(DROPPED).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def latest(rows: DataFrame) -> DataFrame:
    """One row per campaign and day: that of the last drop, of equal drops the one with the largest metrics. Any order and any number of repeats give the same; null ids and days are keys as others."""
    # one shuffle and one sort, as few rows have others to meet before it
    order = ("drop", *METRICS, *(c for c in COLUMNS if c not in METRICS and c not in KEYS))
    rank = F.row_number().over(W.partitionBy(*KEYS).orderBy(*(F.desc(c) for c in order)))
    return rows.select(*DROPPED.names).repartition(*KEYS).withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def feed(drops: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Upserts all drops that are there into the fact at path, then stops; a later call with the same checkpoint goes on with what has come since.

    Each micro-batch writes the latest rows of its own to a folder named by its number. A batch that is run again after a
    failure has the same rows and number and replaces its folder, so each row counts once. Rows meet those of other batches
    when the fact is read or compacted, so a batch costs what its own rows cost.
    """

    def put(batch: DataFrame, number: int) -> None:
        latest(batch).write.mode("overwrite").parquet(f"{path}/batches/batch={number}")

    return drops.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _folder(spark: SparkSession, path: str, name: str) -> DataFrame:
    schema = DROPPED.fields + [T.StructField(name, T.LongType())]
    try:
        return spark.read.schema(T.StructType(schema)).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], T.StructType(schema))


def rows_of(spark: SparkSession, path: str) -> DataFrame:
    """All rows that may count: those of the last compaction and of the batches since. Others are pruned by their folders."""
    bases, batches = _folder(spark, f"{path}/bases", "upto"), _folder(spark, f"{path}/batches", "batch")
    upto = bases.agg(F.max("upto")).first()[0]  # from folder names
    if upto is None:
        return batches.drop("batch")
    return bases.where(F.col("upto") == upto).drop("upto").unionByName(batches.where(F.col("batch") > upto).drop("batch"))


def fact(spark: SparkSession, path: str) -> DataFrame:
    """The unified columns, one row per campaign and day, as of the batches that are written."""
    return latest(rows_of(spark, path)).select(*COLUMNS)


def compact(spark: SparkSession, path: str) -> None:
    """Write the latest rows as one base, so that reads skip the batches so far. Only between runs of feed. Nothing is deleted."""
    last = _folder(spark, f"{path}/batches", "batch").agg(F.max("batch")).first()[0]
    if last is not None:
        latest(rows_of(spark, path)).write.mode("overwrite").parquet(f"{path}/bases/upto={last}")
