"""A user's own features, computed campaign by campaign."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import TIE_BREAK
from . import features

#: Rows of a campaign that a task holds at once, unless the caller says otherwise: daily rows of 270 years.
MOST_ROWS = 100_000


def per_campaign(df: DataFrame, compute: Callable[..., pd.DataFrame], adds: str, most_rows: int = MOST_ROWS, **settings: Any) -> DataFrame:
    """df with the columns named in adds (a DDL schema), as compute(rows, **settings) gives them for each campaign's rows, in their order.

    rows is a pandas frame; what compute returns must have as many rows as it got, in the same order, with the columns of
    adds (and may have others). A campaign is one task's work, so it may have at most most_rows rows: longer ones are an error
    that names them, not a slow task. Features that need no more than a look back should be windows, or run in ranges
    (features.in_ranges). Null campaigns are one group. Columns of df named in adds are replaced.
    """
    added = T.StructType.fromDDL(adds)
    kept = df.drop(*added.names)
    schema = T.StructType([*kept.schema.fields, *added.fields])

    def run(table: pa.Table) -> pa.Table:
        if table.num_rows > most_rows:
            raise ValueError(f"campaign {table['campaign_id'][0].as_py()} has {table.num_rows} rows, more than {most_rows}")
        table = table.sort_by([(c, "ascending") for c in TIE_BREAK if c in table.column_names])
        out = compute(table.to_pandas(), **settings)
        if len(out) != table.num_rows:
            raise ValueError(f"{getattr(compute, '__name__', 'the function')} gave {len(out)} rows for {table.num_rows}")
        for f in added.fields:
            kind = pa.from_numpy_dtype(np.dtype("float64")) if isinstance(f.dataType, T.DoubleType) else None
            table = table.append_column(f.name, pa.Array.from_pandas(out[f.name], type=kind))
        return table

    return kept.groupBy("campaign_id").applyInArrow(run, schema)


def theil_sen(rows: pd.DataFrame, metric: str = "revenue") -> pd.DataFrame:
    """trend: the median slope over all pairs of rows, by row number; null with fewer than two values. Memory grows with the square of the rows, so this is for a look back of some hundreds."""
    values = rows[metric].to_numpy(float)
    at = np.flatnonzero(~np.isnan(values))
    i, j = np.triu_indices(len(at), 1)
    slope = float(np.median((values[at[j]] - values[at[i]]) / (at[j] - at[i]))) if len(i) else None
    return rows.assign(trend=pd.Series([slope] * len(rows), index=rows.index, dtype=float))


def trends(fact: DataFrame, metric: str = "revenue", lookback: int = 90) -> DataFrame:
    """entity_id, trend: each campaign's robust slope a row over its last lookback rows."""
    own = per_campaign(features.last_rows(fact, lookback), theil_sen, "trend double", most_rows=lookback, metric=metric)
    return own.groupBy(F.col("campaign_id").alias("entity_id")).agg(F.first("trend").alias("trend"))
