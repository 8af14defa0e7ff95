"""Removal of lines that other documents have too."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, cut, packed, parallelism, text_of, unpacked, written

MIN_CHARS = 10
SALTS = 8
#: Bits of a filter: some 16 a hash, and never more than 2 ** 28 (32 MB), in segments that a task each fills.
BITS, MAX_BITS, HASHES = 16, 1 << 28, 4
SEGMENT = 1 << 20


def line_key(line):
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.trim(line, F.lit(WHITE)), upper, upper.lower())


def with_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc (the doc_id, null ones last), _row (tells rows of one doc_id apart by their text) and lines: (position, key) of the lines that are long enough."""
    lines = F.transform(F.split(text_of(), "\n", -1), lambda x, i: F.struct(i.alias("at"), line_key(x).alias("key")))
    return docs.select(order_of(F.col("doc_id")).alias("doc"), F.xxhash64(text_of()).alias("_row"), F.filter(lines, lambda x: F.char_length(x["key"]) >= min_chars).alias("lines"))


def order_of(doc_id):
    return F.coalesce(doc_id.cast("long"), F.lit(2**63 - 1))


def bits_for(n: int) -> int:
    """A power of two of some BITS for each of n hashes."""
    return min(MAX_BITS, 1 << max(16, math.ceil(math.log2(BITS * max(1, n)))))


def cells(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The cells of each hash, one row per hash, all in the segment that its low bits name: double hashing over the segment."""
    h, size = hashes.view(np.uint64), np.uint64(min(SEGMENT, bits))
    segment = h & (np.uint64(bits) // size - np.uint64(1))
    spread = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    step = (h >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20) | np.uint64(1)
    inside = ((spread >> np.uint64(32))[:, None] + step[:, None] * np.arange(HASHES, dtype=np.uint64)) & (size - np.uint64(1))
    return (segment[:, None] * size + inside).astype(np.int64)


def set_bits(packed: np.ndarray, at: np.ndarray) -> None:
    """at: sorted cells."""
    if len(at):
        first = np.flatnonzero(np.concatenate([[True], at[1:] >> 3 != at[:-1] >> 3]))
        packed[at[first] >> 3] |= np.bitwise_or.reduceat((1 << (at & 7)).astype(np.uint8), first)


def has_bits(packed: np.ndarray, at: np.ndarray) -> np.ndarray:
    return packed[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0


def ragged(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False), np.diff(column.offsets.to_numpy())


def has_all(packed: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which rows of cells are all set."""
    out = has_bits(packed, at[:, 0])
    for k in range(1, HASHES):
        out &= has_bits(packed, at[:, k])
    return out


def twice_seen(hashed: DataFrame, n: int) -> DataFrame:
    """h: hashes that two rows or more of hashed (a column h, an array of distinct longs) have, and by chance a few others. n: how many hashes there are, some.

    Hashes are dealt by value, so a task has a part of them and two Bloom filters for it: of those seen once, and of those seen twice. A hash that the first
    filter has already is seen twice; the second keeps it from being given again. A task's filters have some BITS for each of its hashes
    however many there are in all. Before they are dealt, a hash that many rows of a batch have is cut to two.
    """
    parts = max(parallelism(hashed.sparkSession), math.ceil(BITS * n / MAX_BITS))
    bits = bits_for(2 * math.ceil(n / parts))

    def two_at_most(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, counts = np.unique(ragged(batch.column(0))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(h, np.minimum(counts, 2)))], ["h"])

    def watch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            h, counts = np.unique(batch.column(0).to_numpy(), return_counts=True)
            at = cells(h, bits)
            found = (has_all(once, at) | (counts > 1)) & ~has_all(twice, at)
            set_bits(once, np.sort(at.ravel()))
            set_bits(twice, np.sort(at[found].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(h[found])], ["h"])

    return hashed.mapInArrow(two_at_most, "h long").repartition(parts, "h").mapInArrow(watch, "h long")


def bloom(hashes: DataFrame) -> np.ndarray:
    """A Bloom filter of the column h, MAX_BITS at most: a task fills each segment, and the driver gets them."""
    bits = bits_for(hashes.count())
    size = min(SEGMENT, bits)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            at = np.sort(cells(batch.column(0).to_numpy(), bits).ravel())
            first = np.flatnonzero(np.concatenate([[True], at[1:] // size != at[:-1] // size])) if len(at) else []
            for part in np.split(at, first[1:]) if len(at) else ():
                set_bits(found.setdefault(int(part[0] // size), np.zeros(size // 8, np.uint8)), part % size)
        for i, own in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(own.tobytes(), 1)], pa.binary())], ["segment", "own"])

    out = np.zeros(bits // 8, np.uint8)
    dealt = hashes.withColumn("segment", F.col("h").bitwiseAND(bits // size - 1)).repartition(min(parallelism(hashes.sparkSession), bits // size), "segment")
    for i, own in dealt.select("h").mapInArrow(fill, "segment int, own binary").collect():  # bits / size rows
        out[i * size // 8 : (i + 1) * size // 8] |= np.frombuffer(zlib.decompress(own), np.uint8)
    return out


def with_known(df: DataFrame, column: str, known: np.ndarray) -> DataFrame:
    """The rows of df whose column the filter may have."""
    bits = df.sparkSession.sparkContext.broadcast(known)

    @F.pandas_udf("boolean")
    def has(hashes: pd.Series) -> pd.Series:
        return pd.Series(has_all(bits.value, cells(hashes.to_numpy(), len(bits.value) * 8)))

    return df.where(has(column))


def suspects(keyed: DataFrame, n: int) -> DataFrame:
    """doc, _row, key, at (positions): the lines whose hash may be one that two documents have. n: how many lines there are, some."""
    hashes = F.array_distinct(F.transform("lines", lambda x: F.xxhash64(x["key"])))
    filter_bits = keyed.sparkSession.sparkContext.broadcast(bloom(cut(twice_seen(keyed.select(hashes.alias("h")), n))))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = filter_bits.value
        for batch in batches:
            h, sizes = ragged(batch.column("h"))
            hit = has_all(known, cells(h, len(known) * 8))
            ends = np.cumsum(sizes)
            columns = [batch.column(n) for n in ("doc", "_row", "lines")]
            some = pa.array(np.add.reduceat(np.concatenate([hit, [False]]), np.minimum(ends - sizes, len(hit))) * (sizes > 0) > 0)
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(hit))], ["doc", "_row", "lines", "hit"]).filter(some)

    each = keyed.withColumn("h", F.transform("lines", lambda x: F.xxhash64(x["key"])))
    schema = "doc long, _row long, lines array<struct<at int, key string>>, hit array<boolean>"
    found = each.select("doc", "_row", "lines", "h").mapInArrow(probe, schema)
    found = found.select("doc", "_row", F.explode(F.filter("lines", lambda x, i: F.get("hit", i))).alias("x"))
    return found.select("doc", "_row", "x.key", "x.at")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, counts: bool = True) -> DataFrame:
    """docs with text replaced by the kept lines, and, with counts, _n_lines and _n_dropped added.

    A line's key is the line without the six ASCII white-space characters at its ends, A-Z lower-cased. A key of min_chars
    code points or more that two documents or more have loses all its lines, but for those in the smallest doc_id that has it.

    Two Bloom filters for each range of hashes find those seen twice (see twice_seen); a filter of these finds the suspects among all lines. Only suspects are shuffled, by
    key, where the key's text tells for certain which documents have it and which of them is the first. That filter has 16 bits a repeated line, up to 17 million of
    them; beyond, it lets ever more other lines through, and the result is the same.
    Lines to drop are known by the key's SHA-256 and hashed doc_id slices, so that one very common line is dealt to several tasks. Of the texts only those that lose
    a line (and, by chance of a filter of them, a few others) are shuffled to meet them; the others stay where they are.

    Null or empty text: one empty line, kept; text becomes "". Rows with one doc_id are one document. A null doc_id comes after
    all others. Columns other than doc_id and text pass through.
    """
    keyed = with_keys(docs, min_chars)
    n = docs.select(F.sum(1 + F.octet_length(text_of()) - F.octet_length(F.replace(text_of(), F.lit("\n"), F.lit(""))))).first()[0] or 1
    found = written(suspects(keyed, n))
    digest_of_key = F.unhex(F.sha2(F.encode("key", "UTF-8"), 256)).alias("_key")
    firsts = found.groupBy("key").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select(digest_of_key, "first")
    slices = firsts.withColumn("_slice", F.explode(F.array(*(F.lit(i) for i in range(SALTS)))))
    dropped = found.select(digest_of_key, "doc", "_row", "at", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int").alias("_slice")).join(slices, ["_key", "_slice"]).where("doc > first")
    dropped = written(dropped.groupBy("doc", "_row").agg(F.collect_set("at").alias("_drop")))
    return apply_drops(docs, dropped, counts)


def apply_drops(docs: DataFrame, dropped: DataFrame, counts: bool) -> DataFrame:
    known = docs.sparkSession.sparkContext.broadcast(bloom(dropped.select(F.xxhash64("doc", "_row").alias("h"))))

    @F.pandas_udf("boolean")
    def loses(hashes: pd.Series) -> pd.Series:
        return pd.Series(has_all(known.value, cells(hashes.to_numpy(), len(known.value) * 8)))

    @F.pandas_udf("string")
    def keep(texts: pd.Series, drops: pd.Series) -> pd.Series:
        kept = []
        for text, drop in zip(texts, drops, strict=True):
            if len(drop):
                parts = text.split("\n")
                stay = np.ones(len(parts), bool)
                stay[drop] = False
                text = "\n".join([x for x, s in zip(parts, stay.tolist(), strict=True) if s])
            kept.append(text)
        return pd.Series(kept)

    own = docs.select(order_of(F.col("doc_id")).alias("doc"), F.xxhash64(text_of()).alias("_row"), text_of().alias("_text"), packed(docs)).withColumn("_loses", loses(F.xxhash64("doc", "_row")))
    none = F.array().cast("array<int>")
    apart = own.where("_loses").join(dropped, ["doc", "_row"], "left").select("_rest", "_text", F.coalesce("_drop", none).alias("_drop"))
    whole = own.where("NOT _loses").select("_rest", "_text", none.alias("_drop"), F.col("_text").alias("_kept"))
    out = whole.unionByName(apart.withColumn("_kept", keep("_text", "_drop")))
    numbers = [F.size(F.split("_text", "\n", -1)).cast("long").alias("_n_lines"), F.size("_drop").cast("long").alias("_n_dropped")] if counts else []
    return out.select(*unpacked(docs, {"text": F.col("_kept")}), *numbers)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of each document."""
    return dedup_lines(docs).select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.*, f.first IS NOT NULL AND f.first <> k.doc_id AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
