"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, packed, text_of, unpacked

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """Add weight and target to a frame of one row per source (source, source_size).

    Sources take the weights in turn, by code point with null last. The targets share the total size by weight; none exceeds
    cap times its source, and what is cut off is shared by the others. That ends in least(cap * size, weight * level) for one
    level, which is the largest of (total - caps before) / (weight - weights before) along rising cap / weight.
    The frame has one row per source, so its unpartitioned windows are small.
    """
    turn = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int")).cast("long")
    s = sizes.withColumn("weight", turn).withColumn("_cap", F.col("source_size") * cap)
    before = W.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    share = F.sum("weight").over(W.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    s = s.withColumn("_level", left.cast("double") / share)
    return s.withColumn("target", F.least(F.col("_cap").cast("double"), F.col("weight") * F.max("_level").over(W.partitionBy()))).drop("_cap", "_level")


def random_key(seed: str) -> Column:
    """The hash-random key of a document: of its doc_id, or where that is null of its text, so that documents without one are dealt over all ranges."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(text_of())))))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: str = "mix", bucket_rows: int = 4096) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, text_hash: how many words of each document a mix with these weights takes.

    Documents get a hash-random key. Within a source they are ordered by it: a prefix of the key's hex digits is the range
    (at most some bucket_rows rows in each range, however many documents there are), sums by range and by half of its digits give
    each range's start, and a window inside a range gives each document's. A source is taken whole as often as its target
    allows; then documents are taken in order up to the target's whole words, the last one in part. So a source's taken words
    are its target rounded down, and no document counts over cap times.

    Null text: size 0. Null source: a source of its own, last. Null doc_id: the key is of the text. Rows with the same doc_id are taken one by one. No rows: no rows.
    Nothing is dropped: a document that isn't taken has taken 0.
    """
    sized = cut(docs.select("doc_id", "source", word_count(text_of()).alias("size"), random_key(seed).alias("_key"), F.xxhash64(text_of()).alias("text_hash")))
    digits = max(1, math.ceil(math.log(max(sized.count(), 2) / bucket_rows, 16)))
    # a source's key is never null, so that joins need no null-safe comparison
    sized = sized.withColumn("_source", F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source"))).withColumn("_range", F.substring("_key", 1, digits))
    ranges = sized.groupBy("_source", "_range").agg(F.sum("size").alias("_sum"), F.first("source").alias("source"))
    per_source = targets(ranges.groupBy("_source").agg(F.first("source").alias("source"), F.sum("_sum").alias("source_size")), weights, cap)
    per_source = per_source.select("_source", "source_size", "target")
    # first half of the digits, then the rest: no window has more rows than 4 times the square root of a source's ranges
    halves = ranges.select("_source", "_range", F.substring("_range", 1, digits // 2).alias("_half"), "_sum")
    sums = halves.groupBy("_source", "_half").agg(F.sum("_sum").alias("_sum"))
    sums = sums.select("_source", "_half", (F.sum("_sum").over(W.partitionBy("_source").orderBy("_half")) - F.col("_sum")).alias("_to_half"))
    within = F.sum("_sum").over(W.partitionBy("_source", "_half").orderBy("_range")) - F.col("_sum")
    starts = halves.withColumn("_within", within).join(sums, ["_source", "_half"]).select("_source", "_range", (F.col("_to_half") + F.col("_within")).alias("_start")).join(per_source, "_source")
    inside = W.partitionBy("_source", "_range").orderBy("_key", "size", "text_hash").rowsBetween(W.unboundedPreceding, W.currentRow)
    budget = F.floor("target")
    rounds = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest("source_size", F.lit(1)))).otherwise(0)
    placed = sized.join(starts, ["_source", "_range"]).withColumn("_before", F.col("_start") + F.sum("size").over(inside) - F.col("size"))
    rest = budget - rounds * F.col("source_size") - F.col("_before")
    taken = rounds * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), "text_hash")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: str = "mix") -> DataFrame:
    """The mix itself, with the columns of docs: a row for each time a document is taken whole, and one for the document at the cut of each source, with its
    first words alone and n_chars of these. Documents that the mix doesn't take have no row; so have texts without words.
    """
    keys = ["_doc", "_source", "_hash"]
    named = [F.coalesce(F.col("doc_id").cast("string"), F.lit("-")).alias("_doc"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("_source")]
    taken = mix(docs, weights, cap, seed).where("taken > 0").select(*named, F.col("text_hash").alias("_hash"), "size", "taken").groupBy(*keys).agg(F.first("size").alias("_size"), F.sum("taken").alias("_taken"))
    own = docs.select(*named, F.xxhash64(text_of()).alias("_hash"), text_of().alias("_text"), packed(docs)).dropDuplicates(keys).join(taken, keys)
    words = F.slice(F.regexp_extract_all("_text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), F.lit(1), F.greatest(F.col("_words"), F.lit(1)).cast("int"))
    whole = F.floor(F.col("_taken") / F.col("_size")).cast("int")
    rows = own.withColumn("_copy", F.explode(F.sequence(F.lit(0), whole)))
    rows = rows.withColumn("_words", F.when(F.col("_copy") < whole, F.col("_size")).otherwise(F.col("_taken") - whole * F.col("_size"))).where("_words > 0")
    rows = rows.withColumn("_text", F.when(F.col("_words") < F.col("_size"), F.array_join(words, "")).otherwise(F.col("_text")))
    new = {"text": F.col("_text")} | ({"n_chars": F.char_length("_text").cast(dict(docs.dtypes)["n_chars"])} if "n_chars" in docs.columns else {})
    return rows.select(*unpacked(docs, new))


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  md5(concat_ws(':', 'mix', coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, ''))))) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS pos FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((pos - 1) % 3 + 1)::INT]::BIGINT AS weight, source_size * 3 AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::DOUBLE
             / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level
      FROM w WINDOW b AS (ORDER BY cap::DOUBLE / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap::DOUBLE, weight * max(level) OVER ()) AS target FROM l),
p AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
             CASE WHEN t.source_size > 0 THEN floor(t.target)::BIGINT // t.source_size ELSE 0 END AS rounds,
             (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size ROWS UNBOUNDED PRECEDING))::BIGINT - d.size AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target,
       (rounds * size + greatest(0, least(size, budget - rounds * source_size - before)))::BIGINT AS taken FROM p
"""
