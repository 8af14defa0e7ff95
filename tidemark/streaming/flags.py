"""Campaign flags as a running state: the longest run of days without revenue, cost inflation between the halves of a history, and gaps."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..schema import METRICS, TIE_BREAK

OUTPUT = "entity_id string, rows long, longest_zero_run long, zero_revenue boolean, early_ratio double, late_ratio double, cost_inflation boolean, last date, gap boolean"
NAMES = [f.split()[0] for f in OUTPUT.split(", ")]
#: What is settled: rows, the current and the longest run, sums of the halves, and the last day.
SETTLED = "n long, run long, longest long, early_spend double, early_revenue double, late_spend double, late_revenue double, last date"
#: A campaign's whole state is one value, so that it is one read and one write: what is settled; its later half and the rows that wait, as doubles; its timer.
STATE = SETTLED + ", late binary, waiting binary, timer long"
DAY_MS = 86_400_000
EPOCH = dt.date(1970, 1, 1)
SPEND, REVENUE = 1 + METRICS.index("spend"), 1 + METRICS.index("revenue")
#: The state needs a store that can delete timers.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Campaign:
    """One campaign's rows in order, with constant work for each. Only the later half of the rows (spend and revenue, 0 for null) is kept, as it moves on a row with every second one."""

    def __init__(self, settled: tuple | None, late: Iterable):
        self.n, self.run, self.longest, self.early_spend, self.early_revenue, self.late_spend, self.late_revenue, self.last = settled or (0, 0, 0, 0.0, 0.0, 0.0, 0.0, None)
        self.late = (late if isinstance(late, np.ndarray) else np.array(list(late), float)).reshape(-1, 2)

    def add(self, row: tuple) -> None:
        self.extend(np.array([[np.nan if row[0] is None else (row[0] - EPOCH).days, *(np.nan if x is None else x for x in row[1:])]], float))

    def extend(self, rows: np.ndarray) -> None:
        """Rows of a day's number and METRICS, in order; NaN is null."""
        if not len(rows):
            return
        # runs end at the rows with revenue; the first goes on from the one so far
        ends = np.flatnonzero(rows[:, REVENUE] != 0)
        bounds = np.concatenate([[-1], ends, [len(rows)]])
        runs = np.diff(bounds) - 1
        runs[0] += self.run
        self.run, self.longest = int(runs[-1]), max(self.longest, int(runs.max()))
        own = np.nan_to_num(rows[:, [SPEND, REVENUE]], nan=0.0, posinf=np.inf, neginf=-np.inf)
        every = np.concatenate([self.late, own])
        moved = (self.n + len(rows)) // 2 - self.n // 2
        (spend, revenue), (new_spend, new_revenue) = every[:moved].sum(axis=0).tolist(), own.sum(axis=0).tolist()
        self.early_spend, self.early_revenue = self.early_spend + spend, self.early_revenue + revenue
        self.late_spend, self.late_revenue = self.late_spend + new_spend - spend, self.late_revenue + new_revenue - revenue
        self.late, self.n = every[moved:], self.n + len(rows)
        self.last = None if np.isnan(rows[-1, 0]) else EPOCH + dt.timedelta(int(rows[-1, 0]))

    def settled(self) -> tuple:
        return self.n, self.run, self.longest, self.early_spend, self.early_revenue, self.late_spend, self.late_revenue, self.last

    def flags(self, days: int, threshold: float, least_rows: int) -> tuple:
        early = self.early_spend / self.early_revenue if self.early_revenue > 0 else None
        late = self.late_spend / self.late_revenue if self.late_revenue > 0 else None
        if self.n < least_rows or early == 0 or (early is None and late is None):
            dearer = False
        elif early is None:
            dearer = late > 0
        else:
            dearer = late is None or (late - early) / early > threshold
        return self.n, self.longest, self.longest >= days, early, late, dearer, self.last


def _in_order(rows: np.ndarray) -> np.ndarray:
    """By all columns in turn, nulls first."""
    null = np.isnan(rows)
    values = np.where(null, 0.0, rows)
    return rows[np.lexsort([k for i in reversed(range(rows.shape[1])) for k in (values[:, i], ~null[:, i])])]


class Running(StatefulProcessor):
    def __init__(self, days: int, threshold: float, least_rows: int, gap_days: int):
        self.days, self.threshold, self.least_rows, self.gap_days = days, threshold, least_rows, gap_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("campaign", STATE)

    def _known(self) -> tuple[Campaign, np.ndarray, int | None]:
        """The settled campaign, the rows that wait, and the timer."""
        state = self.state.get()
        if state is None:
            return Campaign(None, ()), np.empty((0, len(TIE_BREAK))), None
        *settled, late, waiting, timer = state
        return Campaign(tuple(settled), np.frombuffer(bytes(late))), np.frombuffer(bytes(waiting)).reshape(-1, len(TIE_BREAK)), timer

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """Rows of days that the watermark has passed are settled in order; later ones wait, and are counted anew each time."""
        own, waiting, timer = self._known()
        frames = [np.column_stack([frame[c].to_numpy(float, na_value=np.nan) for c in TIE_BREAK]) for frame in rows]
        waiting = _in_order(np.concatenate([waiting, *frames]))
        passed = max(timerValues.getCurrentWatermarkInMs(), 0) // DAY_MS
        done = waiting[:, 0] < passed  # not so for null days
        own.extend(waiting[done])
        settled, late, open_ = own.settled(), own.late.tobytes(), waiting[~done]
        own.extend(open_)
        due = None if own.last is None else ((own.last - EPOCH).days + self.gap_days) * DAY_MS
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        self.state.update((*settled, late, open_.tobytes(), due))
        yield self._out(key, own, False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The watermark is gap_days past the campaign's last row: its flags again, with gap."""
        own, waiting, _ = self._known()
        self.state.update((*own.settled(), own.late.tobytes(), waiting.tobytes(), None))  # the timer is gone
        own.extend(waiting)
        yield self._out(key, own, True)

    def _out(self, key: tuple, own: Campaign, gap: bool) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *own.flags(self.days, self.threshold, self.least_rows), gap)], columns=NAMES, dtype=object)

    def close(self) -> None:
        pass


def running_flags(fact: DataFrame, late: str = "10 days", days: int = 45, threshold: float = 0.2, least_rows: int = 30, gap_days: int = 30) -> DataFrame:
    """A stream of OUTPUT from a stream of the unified columns: a campaign's flags so far, for each micro-batch that has rows of it, and once more, with gap, when the watermark is gap_days past its last one.

    Flags are those of zero_revenue and cost_inflation on the same rows, whatever their order, as long as none is later than the
    watermark; such rows are dropped. Rows of one day are in the order of their metrics; null days come first and
    stay so. A campaign's state is its later half of rows and those that wait. Sums are exact for whole units; else they
    differ in the last digits from those made at once. The session's state store must be STORE's.
    """
    metrics = (F.col(m).cast("double").alias(m) for m in METRICS)
    timed = fact.select("campaign_id", F.unix_date("date").cast("double").alias("date"), *metrics, F.col("date").cast("timestamp").alias("_time")).withWatermark("_time", late)
    return timed.groupBy("campaign_id").transformWithStateInPandas(Running(days, threshold, least_rows, gap_days), OUTPUT, "Update", "EventTime")


def last_flags(flags: DataFrame) -> DataFrame:
    """One row per campaign: its last flags, of a table with running_flags' rows. A gap counts until rows come after it."""
    return flags.groupBy("entity_id").agg(F.max_by(F.struct(*(c for c in flags.columns if c != "entity_id")), F.struct("rows", "gap")).alias("_f")).select("entity_id", "_f.*")
