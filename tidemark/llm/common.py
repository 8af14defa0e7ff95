"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six white-space bytes that separate words and are stripped from line ends.
WHITE = "\t\n\x0b\x0c\r "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the cluster's checkpoint folder and go on from the files, so lost executors cost no recomputation.

    The folder is the session's spark.checkpoint.dir; only where that is unset and Spark runs on this machine alone a temporary one is made.
    """
    shared(df.sparkSession)
    return df.checkpoint(eager=True)


def shared(spark: SparkSession) -> str:
    """The folder of this session's checkpoints, set if it isn't yet."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-"))
    return sc.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """As cut, by a Parquet table in the same folder: for small tables that each round of a loop makes from the last one's.

    A checkpoint keeps its plan's size estimate, a product over its joins, whose digits double with each round; a table has the size of its files.
    """
    path = f"{shared(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def text_of(name: str = "text"):
    """A text column in which null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def packed(docs: DataFrame, but: tuple[str, ...] = ("text",)):
    """All columns but some as one struct, _rest, so that no name among them can clash with an operator's own."""
    names = [c for c in docs.columns if c not in but]
    return (F.struct(*(F.col(f"`{c}`").alias(c) for c in names)) if names else F.struct(F.lit(0).alias("_"))).alias("_rest")


def unpacked(docs: DataFrame, own: dict | None = None) -> list:
    """The columns of docs again, from _rest, with those in own replaced."""
    own = own or {}
    return [own[c].alias(c) if c in own else F.col("_rest").getField(c).alias(c) for c in docs.columns]
