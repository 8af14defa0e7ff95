"""Calendar, ratio, rolling and lag features: one shuffle by campaign, one sort, and window operators or, for whole tables, Arrow batches of sorted rows.

Windows are by row, not by calendar day: gaps in the dates don't count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import d, guarded
from ..schema import METRICS, TIE_BREAK
from ..sessions import written

ROLLING, LAGS = (7, 14, 30), (1, 7, 14, 30)
TIME = ("dow", "month", "quarter", "doy", "woy", "is_weekend")
#: Each ratio's numerator and denominator.
RATIOS = {"roas": ("revenue", "spend"), "ctr": ("clicks", "impressions"), "conv_rate": ("conversions", "clicks"), "spend_per_click": ("spend", "clicks"), "revenue_per_impression": ("revenue", "impressions")}


def by_campaign():
    return W.partitionBy("campaign_id").orderBy(*TIE_BREAK)


def time_features(df: DataFrame) -> DataFrame:
    """Monday is day 0; weeks are ISO weeks."""
    return df.withColumns({"dow": F.weekday("date"), "month": F.month("date"), "quarter": F.quarter("date"), "doy": F.dayofyear("date"), "woy": F.weekofyear("date"), "is_weekend": (F.weekday("date") >= 5).cast("int")})


def ratio_features(df: DataFrame) -> DataFrame:
    return df.withColumns({name: guarded(*parts) for name, parts in RATIOS.items()})


#: Frames of up to so many rows are summed row by row, which is the fastest there; longer ones are put together from two shorter ones.
SHORT = 32


def rolling(metric: str, n: int) -> dict[str, Column]:
    """Mean and sample deviation of the n rows before, from two of them on; the deviation is 0 where there is none."""
    frame = by_campaign().rowsBetween(-n, -1)
    enough = F.count(metric).over(frame) >= 2
    return {f"{metric}_roll_mean_{n}": F.when(enough, F.avg(F.col(metric).cast("double")).over(frame)), f"{metric}_roll_std_{n}": F.coalesce(F.when(enough, F.stddev_samp(F.col(metric).cast("double")).over(frame)), d(0))}


def _parts(n: int) -> tuple[int, int]:
    """The rows next to the current one, and those before them, that make up a frame of n rows."""
    return n - n // 2, n // 2


def moments(df: DataFrame, windows: Sequence[int]) -> DataFrame:
    """For each metric and window: how many of the rows before have a value (_n), the values' sum (_s) and their squared deviations from the mean (_q).

    A long frame's numbers follow from those of its newer part, and of its older part as the row there had them, by the rule
    for the variance of two groups; nothing is subtracted that would lose digits. So a row costs log(window) steps, not window.
    All steps have one order, so one shuffle and one sort serve them all.
    """
    order, sizes, todo = by_campaign(), set(), list(windows)
    while todo:
        n = todo.pop()
        if n not in sizes:
            sizes.add(n)
            todo += _parts(n) if n > SHORT else ()
    frames: dict[str, Column] = {}
    for n in sorted(x for x in sizes if x <= SHORT):
        frame = order.rowsBetween(-n, -1)
        for m in METRICS:
            x = F.col(m).cast("double")
            frames |= {f"_n_{m}_{n}": F.count(x).over(frame), f"_s_{m}_{n}": F.coalesce(F.sum(x).over(frame), d(0)), f"_q_{m}_{n}": F.coalesce(F.var_pop(x).over(frame) * F.count(x).over(frame), d(0))}
    out, done = df.withColumns(frames), {x for x in sizes if x <= SHORT}
    while done < sizes:
        ready = sorted(n for n in sizes - done if set(_parts(n)) <= done)
        lags = {f"_{k}_{m}_{n}_old": F.coalesce(F.lag(f"_{k}_{m}_{_parts(n)[1]}", _parts(n)[0]).over(order), F.lit(0)) for n in ready for m in METRICS for k in "nsq"}
        merged: dict[str, Column] = {}
        for n in ready:
            for m in METRICS:
                (a, s, q), (b, t, r) = ([F.col(f"_{k}_{m}_{end}") for k in "nsq"] for end in (_parts(n)[0], f"{n}_old"))
                between = F.when((a > 0) & (b > 0), (t / b - s / a) * (t / b - s / a) * (a * b / (a + b))).otherwise(d(0))
                merged |= {f"_n_{m}_{n}": a + b, f"_s_{m}_{n}": s + t, f"_q_{m}_{n}": q + r + between}
        out = out.withColumns(lags).withColumns(merged).drop(*lags)
        done |= set(ready)
    return out.drop(*(f"_{k}_{m}_{n}" for n in sizes - set(windows) for m in METRICS for k in "nsq"))


def rolling_features(df: DataFrame, windows: Sequence[int] = ROLLING) -> DataFrame:
    """Mean and sample deviation of the rows before, from two of them with a value on; the deviation is 0 where there is none."""
    long = [n for n in windows if n > SHORT]
    own = {k: c for m in METRICS for n in windows if n <= SHORT for k, c in rolling(m, n).items()}
    out = moments(df, long) if long else df
    for m in METRICS:
        for n in long:
            count, total, squares = (F.col(f"_{k}_{m}_{n}") for k in "nsq")
            own |= {f"{m}_roll_mean_{n}": F.when(count >= 2, total / count), f"{m}_roll_std_{n}": F.when(count >= 2, F.sqrt(squares / (count - 1))).otherwise(d(0))}
    return out.withColumns(own).select(*df.columns, *(f"{m}_roll_{k}_{n}" for m in METRICS for n in windows for k in ("mean", "std")))


def lag_features(df: DataFrame, lags: Sequence[int] = LAGS) -> DataFrame:
    return df.withColumns({f"{m}_lag_{k}": F.lag(m, k).over(by_campaign()) for m in METRICS for k in lags})


def _frames(x: np.ndarray, valid: np.ndarray, place: np.ndarray, windows: Sequence[int], kinds: Sequence[str]) -> dict[tuple[str, int], np.ndarray]:
    """Means and deviations over the rows before, metrics by rows. place is a row's number in its campaign; the first max(windows) rows are there for the others alone.

    Frames of 1, 2, 4, ... rows are put together from two of half the length, and others from those, by the rule for the variance of two groups, as in moments.
    """

    def older(a: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros(a.shape)
        out[:, k:] = np.where(place[k:] >= k, a[:, : a.shape[1] - k], 0.0)
        return out

    def merged(new: tuple, old: tuple, k: int) -> tuple:
        """The frame of the k rows of new and the rows before them that old has."""
        (n, s, q), (m, t, r) = new, (older(a, k) if a is not None else None for a in old)
        if q is not None:
            both, off = n * m, t * n - s * m
            q = q + r + np.divide(off * off, both * (n + m), out=np.zeros(n.shape), where=both > 0)
        return n + m, s + t, q

    powers = {1: (older(valid, 1), older(np.where(valid, x, 0.0), 1), np.zeros(x.shape) if "std" in kinds else None)}
    while 2 * (last := max(powers)) <= max(windows, default=0):
        powers[2 * last] = merged(powers[last], powers[last], last)
    out = {}
    for k in windows:
        parts = [p for p in sorted(powers, reverse=True) if k & p]
        frame, rows = powers[parts[0]], parts[0]
        for p in parts[1:]:
            frame, rows = merged(frame, powers[p], rows), rows + p
        n, s, q = frame
        enough = n >= 2
        if "mean" in kinds:
            out["mean", k] = np.ma.masked_array(s / np.maximum(n, 1), ~enough)
        if "std" in kinds:
            out["std", k] = np.where(enough, np.sqrt(q / np.maximum(n - 1, 1)), 0.0)
    return out


def half_up(x: np.ndarray, places: int) -> np.ndarray:
    """x rounded as F.round does, by the digits that a value is written with; only values next to a tie, and very large ones, go through decimals."""
    scale = 10.0**places
    with np.errstate(invalid="ignore", over="ignore"):
        y = np.abs(x) * scale
        whole = np.floor(y)
        part = y - whole
        out = np.where(x < 0, -1.0, 1.0) * ((whole + (part > 0.5)) / scale) + 0.0  # no negative zero
        unsure = ~((y < 4e14) & (np.abs(part - 0.5) > y * 5e-16 + 1e-9))
    for i in zip(*np.nonzero(unsure), strict=True):
        v = float(x[i])
        # from 2 ** 53 on a value is whole
        out[i] = float(Decimal(repr(v)).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP)) + 0.0 if abs(v) < 2**53 else v
    return out


def _rounded(column: pa.Array, places: int) -> pa.Array:
    if column.type != pa.float64():
        return column
    return pa.array(half_up(column.fill_null(0.0).to_numpy(zero_copy_only=False), places), mask=column.is_null().to_numpy(zero_copy_only=False))


def in_batches(
    df: DataFrame, windows: Sequence[int] = ROLLING, lags: Sequence[int] = LAGS, kinds: Sequence[str] = ("mean", "std"), metrics: Sequence[str] = METRICS, places: Mapping[str, int] | None = None, only: str | None = None, max_ratio: float = 1
) -> DataFrame:
    """df with what rolling_features and lag_features add, for whole tables: Spark deals the rows by campaign and sorts them, and tasks compute each batch of them at once, with as many rows before it as the widest window.

    A task holds a batch and those rows, however long its campaigns are. places: double columns that are rounded, as F.round
    does, while they are at hand. only: a column; just the rows where it is above 0 come back, the others serve as rows before.
    max_ratio: rows go as with drop_sparse_rows, which takes longer on so many columns of rows.
    """
    places = places or {}
    rolled = [(m, n, k) for m in metrics for n in windows for k in ("mean", "std") if k in kinds]
    lagged = [(m, k) for m in metrics for k in lags]
    reach = max((*windows, *lags), default=0)
    types = {f.name: f.dataType for f in df.schema.fields}
    schema = T.StructType([*df.schema.fields, *(T.StructField(f"{m}_roll_{k}_{n}", T.DoubleType()) for m, n, k in rolled), *(T.StructField(f"{m}_lag_{k}", types[m]) for m, k in lagged)])
    needed = list(dict.fromkeys(("campaign_id", *metrics)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not len(batch):
                continue
            own = pa.Table.from_batches([batch]).select(needed)
            both = (pa.concat_tables([held, own]) if held is not None else own).combine_chunks()
            first = len(both) - len(batch)
            ids = both["campaign_id"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            at = np.arange(len(both))
            every = at - np.maximum.accumulate(np.where(np.r_[True, ids[1:] != ids[:-1]], at, 0))
            place = every[first:]
            front = np.zeros(reach - first)
            columns = [both[m].combine_chunks() for m in metrics]
            valid = np.array([np.r_[front > 0, c.is_valid().to_numpy(zero_copy_only=False)] for c in columns])
            x = np.array([np.r_[front, c.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)] for c in columns])
            with np.errstate(invalid="ignore", over="ignore"):
                frames = {k: v[:, reach:] for k, v in _frames(x, valid, np.r_[np.zeros(reach - first, np.int64), every], windows, kinds).items()}
            added = []
            for m, n, k in rolled:
                values = frames[k, n][metrics.index(m)]
                added.append(pa.array(np.ma.getdata(values), pa.float64(), mask=np.ma.getmaskarray(values)))
            rows = at[first:]
            for m, k in lagged:
                added.append(columns[metrics.index(m)].take(pa.array(np.maximum(rows - k, 0), mask=place < k)))
            held = both.slice(max(len(both) - reach, 0))
            out = pa.RecordBatch.from_arrays([*batch.columns, *added], schema.names)
            if only:
                out = out.filter(pc.greater(out[only], 0))
            if max_ratio < 1:
                nulls = sum((c.is_null().to_numpy(zero_copy_only=False).astype(np.int64) for c in out.columns), np.zeros(len(out), np.int64))
                out = out.filter(pa.array(nulls / len(out.columns) <= max_ratio))
            yield pa.RecordBatch.from_arrays([_rounded(c, places[n]) if n in places else c for n, c in zip(schema.names, out.columns, strict=True)], schema.names)

    # dealt by the id's hash, not the id: Spark takes a union of parts that are each dealt by campaign_id as dealt already, though it may read them in different numbers of partitions
    return df.repartition(F.xxhash64("campaign_id")).sortWithinPartitions("campaign_id", *TIE_BREAK).mapInArrow(run, schema)


def drop_sparse_rows(df: DataFrame, max_ratio: float = 0.3) -> DataFrame:
    """Rows with at most this share of nulls over all columns; all rows from 1 on."""
    if max_ratio >= 1:
        return df
    nulls = sum((F.col(c).isNull().cast("int") for c in df.columns), F.lit(0))
    return df.where(nulls / len(df.columns) <= max_ratio)


def add_features(df: DataFrame, windows: Sequence[int] = ROLLING, lags: Sequence[int] = LAGS) -> DataFrame:
    return lag_features(rolling_features(ratio_features(time_features(df)), windows), lags)


def build(df: DataFrame, windows: Sequence[int] = ROLLING, lags: Sequence[int] = LAGS, max_ratio: float = 0.3) -> DataFrame:
    return in_batches(ratio_features(time_features(df)), windows, lags, max_ratio=max_ratio)


def feature_names(windows: Sequence[int] = ROLLING, lags: Sequence[int] = LAGS) -> list[str]:
    return [*TIME, *RATIOS, *(f"{m}_roll_{k}_{n}" for m in METRICS for n in windows for k in ("mean", "std")), *(f"{m}_lag_{k}" for m in METRICS for k in lags)]


#: Of placed.
PLACES = ("_place", "_rows", "_zeros")


def placed(df: DataFrame) -> DataFrame:
    """Adds each row's number in its campaign by TIE_BREAK, from 1 (_place), the campaign's rows (_rows), and how many rows up to this one had no revenue in a row (_zeros).

    Steps that need last rows, a holdout or runs find these columns, and then need no shuffle and sort of their own.
    """
    out = df.withColumns({"_place": F.row_number().over(by_campaign()), "_rows": F.count("*").over(by_campaign().rowsBetween(W.unboundedPreceding, W.unboundedFollowing))})
    zero = F.coalesce(F.col("revenue") == 0, F.lit(False))
    last = F.max(F.when(~zero, F.col("_place"))).over(by_campaign().rowsBetween(W.unboundedPreceding, W.currentRow))
    return out.withColumn("_zeros", F.col("_place") - F.coalesce(last, F.lit(0)))


def is_placed(df: DataFrame) -> bool:
    return set(PLACES) <= set(df.columns)


def last_rows(df: DataFrame, n: int) -> DataFrame:
    """The last n rows of each campaign."""
    if is_placed(df):
        return df.where(F.col("_rows") - F.col("_place") < n).drop(*PLACES)
    return df.withColumn("_r", F.row_number().over(W.partitionBy("campaign_id").orderBy(*(F.desc(c) for c in TIE_BREAK)))).where(F.col("_r") <= n).drop("_r")


def all_but_last_rows(df: DataFrame, n: int) -> DataFrame:
    if is_placed(df):
        return df.withColumn("_rows", F.col("_rows") - n).where(F.col("_place") <= F.col("_rows"))
    return df.withColumn("_r", F.row_number().over(W.partitionBy("campaign_id").orderBy(*(F.desc(c) for c in TIE_BREAK)))).where(F.col("_r") > n).drop("_r")


def with_history(df: DataFrame, least: int) -> DataFrame:
    """Campaigns with at least this many rows."""
    if is_placed(df):
        return df.where(F.col("_rows") >= least)
    return df.withColumn("_n", F.count("*").over(W.partitionBy("campaign_id"))).where(F.col("_n") >= least).drop("_n")


def numbered(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Adds _row: each row's number in its campaign, from 0, by TIE_BREAK. df is dealt by ranges of campaign and order, so one long campaign is spread over many tasks."""
    spark = df.sparkSession
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # rows alike in all columns of the order would all be in one range: a number of their own parts them
    own = written(df.withColumn("_any", F.monotonically_increasing_id()))
    dealt = written(own.repartitionByRange(parts, "campaign_id", *TIE_BREAK, "_any").withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy("campaign_id", "_part").count()
    before = F.coalesce(F.sum("count").over(W.partitionBy("campaign_id").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("campaign_id").alias("_campaign"), F.col("_part").alias("_of"), before.alias("_first"))
    inside = F.row_number().over(W.partitionBy("campaign_id", "_part").orderBy(*TIE_BREAK, "_any")) - 1
    joined = dealt.join(starts, F.col("campaign_id").eqNullSafe(F.col("_campaign")) & (F.col("_part") == F.col("_of")))
    return joined.withColumn("_row", F.col("_first") + inside).drop("_any", "_part", "_campaign", "_of", "_first")


def in_ranges(df: DataFrame, build: Callable[[DataFrame], DataFrame], reach: int, rows: int = 100_000) -> DataFrame:
    """build(df) for windows that look back at most reach rows, with long campaigns cut into ranges of so many rows.

    Each range also gets the reach rows before it, so its first rows see what they need; those copies then go. So a task holds
    rows + reach rows of a campaign, whatever its length, for one more shuffle and reach / rows more rows. build must keep the
    columns that it is given. Null campaigns are one series, as with plain windows.
    """
    if reach > rows:
        raise ValueError("a range must be at least as long as the reach")
    at = F.floor(F.col("_row") / rows)
    ranges = F.when(F.col("_row") % rows >= rows - reach, F.array(at, at + 1)).otherwise(F.array(at))
    copies = numbered(df).select("*", at.alias("_home"), F.explode(ranges).alias("_range")).drop("_row")
    series = F.concat_ws("\u0001", F.col("_range").cast("string"), "campaign_id")
    out = build(copies.withColumn("_campaign", F.col("campaign_id")).withColumn("campaign_id", series)).where("_home = _range")
    return out.withColumn("campaign_id", F.col("_campaign")).drop("_campaign", "_home", "_range")
