"""A quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, text_of, unpacked
from .words import CLASS, in_groups, mixed, words

DIMENSIONS = 1 << 18
#: The classifier is fitted on SHARDS * SHARD_ROWS labelled rows at most, those of the smallest hashed doc_ids.
SHARDS, SHARD_ROWS, EPOCHS = 1, 6000, 4
REPEAT = 1  # the feature that two equal words in a row share


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (feature, value, entries in each row) of hashed words and word pairs.

    Words are runs of letters and digits, or of other ASCII characters, case kept. A value is log(1 + count), and rows have length 1.
    Feature 0 stands in each row with value 1, outside the length.
    """
    h, n = words(texts, CLASS)
    row = np.repeat(np.arange(len(texts)), n)
    follows = np.flatnonzero(row[1:] == row[:-1]) + 1 if len(row) else np.zeros(0, np.int64)
    pair = mixed(h[follows - 1] * np.uint64(3) + h[follows])
    pair = np.where(h[follows - 1] == h[follows], np.uint64(REPEAT), 2 + pair % np.uint64(DIMENSIONS - 2))
    at = np.concatenate([row * DIMENSIONS + (2 + h % np.uint64(DIMENSIONS - 2)).astype(np.int64), row[follows] * DIMENSIONS + pair.astype(np.int64)])
    at, counts = np.unique(at, return_counts=True)
    rows, value = at // DIMENSIONS, np.log1p(counts)
    value /= np.sqrt(np.bincount(rows, value**2, len(texts)))[rows]
    sizes = np.bincount(rows, minlength=len(texts))
    first = np.cumsum(sizes) - sizes
    return np.insert(at % DIMENSIONS, first, 0), np.insert(value, first, 1.0), sizes + 1


class FollowTheLeader:
    """Per-coordinate follow-the-regularised-leader updates for logistic loss, with L1 and L2 terms."""

    def __init__(self, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def update(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def held_out(parts: int, which: int):
    return F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % parts == which


def sample_of_labels(labels: DataFrame, label: str, usable, rows: int) -> DataFrame:
    """doc_id and y of at most rows labelled documents, those with the smallest hashed doc_ids. Labels that are null don't count; of differing ones the larger holds."""
    own = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & usable).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    return own.orderBy(F.xxhash64("doc_id", F.lit(9)), "doc_id").limit(rows)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 3, held: int = 1) -> np.ndarray:
    """Weights by feature. Each of SHARDS tasks fits a model on its part of the sample, and the models are averaged."""
    sample = sample_of_labels(labels, label, ~held_out(parts, held), SHARDS * SHARD_ROWS)
    # at most SHARDS * SHARD_ROWS ids: small enough for every executor
    rows = docs.select("doc_id", F.encode(text_of(), "UTF-8").alias("text")).join(F.broadcast(sample), "doc_id").withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(SHARDS)))

    def train(table: pa.Table) -> pa.Table:
        order = np.argsort(mixed(table.column("doc_id").to_numpy().astype(np.uint64)), kind="stable")
        texts, y = table.column("text").to_pylist(), table.column("y").to_numpy()
        texts, y = [texts[i] for i in order], y[order]
        blocks = [(features(texts[a:b]), a) for a, b in in_groups(texts)]
        model = FollowTheLeader()
        for _ in range(EPOCHS):
            for (at, x, sizes), a in blocks:
                ends = np.cumsum(sizes)
                for i, (e, s) in enumerate(zip(ends.tolist(), sizes.tolist(), strict=True)):
                    model.update(at[e - s : e], x[e - s : e], int(y[a + i]))
        w = model.weights(slice(None))
        return pa.table({"feature": pa.array(np.flatnonzero(w), pa.int32()), "weight": pa.array(w[w != 0])})

    out = np.zeros(DIMENSIONS)
    shards = 0
    for feature, weight in rows.groupBy("shard").applyInArrow(train, "feature int, weight double").groupBy("feature").agg(F.sum("weight")).collect():  # DIMENSIONS rows at most
        out[feature] = weight
        shards = SHARDS
    return out / max(1, shards)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """docs with score added: the model's probability for label 1 of the whole text. Null and empty texts get the model's constant."""
    known = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def probability(texts):
        import pandas as pd

        out, items = np.zeros(len(texts)), texts.tolist()
        for a, b in in_groups(items):
            at, x, sizes = features(items[a:b])
            dot = np.add.reduceat(known.value[at] * x, np.cumsum(sizes) - sizes)
            out[a:b] = 1 / (1 + np.exp(-np.clip(dot, -35, 35)))
        return pd.Series(out)

    return docs.withColumn("score", probability(F.encode(text_of(), "UTF-8")))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from a score of 0.5) of each document.

    Labels are learnt only from rows whose crc32(doc_id as text) modulo parts is not held; a null doc_id is not held out and has no label.
    Texts are the only input of a score. Without any labelled row all scores are 0.5. Repeated rows get equal scores.
    """
    scored = score(docs.select("doc_id", "text"), fit(docs, labels, label, parts, held))
    return scored.select("doc_id", F.coalesce(held_out(parts, held), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def good(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """The documents that classify predicts label 1 for, with their own columns, whatever these are called."""
    own = docs.select(packed(docs, ()), "text")
    return score(own, fit(docs, labels, label)).where("score >= 0.5").select(*unpacked(docs))
