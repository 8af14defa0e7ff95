"""Channel exports as a Spark data source: spark.read.format("campaign_exports").load(folder), and readStream likewise.

A file is one partition. Its dialect follows from its header; columns are parsed batch by batch in Arrow, in the tasks.
"""

from __future__ import annotations

import csv as lines
import io
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from typing import ClassVar

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv as arrow_csv
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..schema import COLUMNS, UNIFIED
from .csv import BING, GOOGLE, META, IngestionError

NUMBER = r"^[ \t]*([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)[ \t]*$"
BLOCK = 8 << 20


@dataclass(frozen=True)
class Field:
    """How a unified column comes from a raw one: a kind of parse (see PARSERS), and a scale that numbers are divided by; or a constant."""

    raw: str | None
    kind: str = "text"
    scale: float = 1.0
    constant: object = None


@dataclass(frozen=True)
class Layout:
    """An export's header (the columns that tell it, and all that must be there) and its fields by unified column."""

    channel: str
    signature: frozenset[str]
    required: frozenset[str]
    fields: Mapping[str, Field]


def _of(dialect, **fields: Field) -> Layout:
    return Layout(dialect.name, dialect.signature, dialect.signature | dialect.reads, {"channel": Field(None, constant=dialect.name), **fields})


LAYOUTS = (
    _of(
        GOOGLE, date=Field("segments_date", "date"), campaign_id=Field("campaign_id", "id"), campaign_name=Field("campaign_name"), campaign_type=Field("campaign_advertising_channel_type"),
        spend=Field("metrics_cost_micros", "number", 1_000_000.0), revenue=Field("metrics_conversions_value", "number or 0"), clicks=Field("metrics_clicks", "whole or 0"), impressions=Field("metrics_impressions", "whole or 0"),
        conversions=Field("metrics_conversions", "number or 0"), daily_budget=Field("campaign_budget_amount", "number or 0"),
    ),
    _of(
        META, date=Field("date_start", "date"), campaign_id=Field("campaign_id", "id"), campaign_name=Field("campaign_name"), campaign_type=Field("campaign_name", "first part"),
        spend=Field("spend", "number or 0"), revenue=Field("conversion", "number or 0"), clicks=Field("clicks", "whole or 0"), impressions=Field("impressions", "whole or 0"),
        conversions=Field(None, constant=0.0), daily_budget=Field("daily_budget", "number or 0"),
    ),
    _of(
        BING, date=Field("TimePeriod", "date"), campaign_id=Field("CampaignId", "id"), campaign_name=Field("CampaignName"), campaign_type=Field("CampaignType"),
        spend=Field("Spend", "number or 0"), revenue=Field("Revenue", "number or 0"), clicks=Field("Clicks", "whole or 0"), impressions=Field("Impressions", "whole or 0"),
        conversions=Field("Conversions", "number or 0"), daily_budget=Field("DailyBudget", "number or 0"),
    ),
)


def text(c: pa.Array, channel: str) -> pa.Array:
    """Without the blanks around it; nan is missing."""
    t = pc.utf8_trim(c, " ")
    return pc.if_else(pc.equal(pc.utf8_lower(t), "nan"), pa.scalar(None, pa.string()), t)


def identity(c: pa.Array, channel: str) -> pa.Array:
    """With the channel before it; the channel alone if there is none."""
    t = pc.utf8_trim(c, " ")
    return pc.if_else(pc.is_null(t), channel, pc.binary_join_element_wise(channel, pc.fill_null(t, ""), "_"))


def day(c: pa.Array, channel: str) -> pa.Array:
    """ISO days; others fail, as a day that can't be read is worth a look."""
    return text(c, channel).cast(pa.date32())


def number(c: pa.Array, channel: str) -> pa.Array:
    fits = pc.match_substring_regex(c, NUMBER)
    return pc.utf8_trim(pc.if_else(fits, c, pa.scalar(None, pa.string())), " \t+").cast(pa.float64())


def number_or_0(c: pa.Array, channel: str) -> pa.Array:
    return pc.fill_null(number(c, channel), 0.0)


def whole_or_0(c: pa.Array, channel: str) -> pa.Array:
    return pc.trunc(number_or_0(c, channel)).cast(pa.int64())


def first_part(c: pa.Array, channel: str) -> pa.Array:
    t = text(c, channel)
    return pc.if_else(pc.fill_null(pc.equal(t, ""), True), "unknown", pc.list_element(pc.split_pattern(pc.fill_null(t, ""), "_"), 0))


PARSERS = {"text": text, "id": identity, "date": day, "number": number, "number or 0": number_or_0, "whole or 0": whole_or_0, "first part": first_part}


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


def files(folder: str) -> list[fs.FileInfo]:
    """The CSV files right in a folder, sorted by path. FileNotFoundError if there is no such folder."""
    system, path = opened(folder)
    found = system.get_file_info(fs.FileSelector(path))
    return sorted((f for f in found if f.is_file and f.path.endswith(".csv")), key=lambda f: f.path)


def header(system: fs.FileSystem, path: str) -> list[str]:
    with system.open_input_stream(path) as stream:
        start = stream.read(1 << 20).decode("utf-8", "replace")
    return next(lines.reader(io.StringIO(start)), [])


def batches(folder: str, path: str, layouts: tuple[Layout, ...]) -> Iterator[pa.RecordBatch]:
    """A file's rows in the unified schema. IngestionError if no layout fits its header; ValueError if one does but needs more columns."""
    system = opened(folder)[0]
    raw = header(system, path)
    names = [c.strip() for c in raw]
    layout = next((x for x in layouts if x.signature <= set(names)), None)
    if layout is None:
        raise IngestionError(f"no dialect fits {path}: {names}")
    if missing := sorted(layout.required - set(names)):
        raise ValueError(f"{layout.channel}: missing required columns {missing}")
    convert = arrow_csv.ConvertOptions(column_types={c: pa.string() for c in raw}, null_values=[""], strings_can_be_null=True, quoted_strings_can_be_null=True)
    with system.open_input_stream(path) as stream:
        for batch in arrow_csv.open_csv(stream, arrow_csv.ReadOptions(block_size=BLOCK), convert_options=convert):
            yield pa.RecordBatch.from_arrays([column(batch, names, layout, layout.fields[c], TYPES[c]) for c in COLUMNS], list(COLUMNS))


TYPES = {"date": pa.date32(), "clicks": pa.int64(), "impressions": pa.int64()} | {c: pa.string() for c in ("channel", "campaign_id", "campaign_name", "campaign_type")} | {c: pa.float64() for c in ("spend", "revenue", "conversions", "daily_budget")}


def column(batch: pa.RecordBatch, names: list[str], layout: Layout, field: Field, kind: pa.DataType) -> pa.Array:
    if field.raw is None:
        return pa.repeat(pa.scalar(field.constant, kind), len(batch))
    own = PARSERS[field.kind](batch.column(names.index(field.raw)), layout.channel)
    return (pc.divide(own, field.scale) if field.scale != 1.0 else own).cast(kind)


class FilePartition(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class ExportReader(DataSourceReader):
    def __init__(self, folder: str, layouts: tuple[Layout, ...]):
        self.folder, self.layouts = folder, layouts

    def partitions(self) -> list[FilePartition]:
        own = files(self.folder)
        if not own:
            raise FileNotFoundError(f"no CSV files in {self.folder}")
        return [FilePartition(f.path) for f in own]

    def read(self, partition: FilePartition) -> Iterator[pa.RecordBatch]:
        yield from batches(self.folder, partition.path, self.layouts)


class ExportStreamReader(DataSourceStreamReader):
    """Files in the order in which they came (by time, then path); an offset is the last one's. A file must not change once it is there."""

    def __init__(self, folder: str, layouts: tuple[Layout, ...]):
        self.folder, self.layouts = folder, layouts

    def initialOffset(self) -> dict:
        return {"time": 0, "path": ""}

    def latestOffset(self) -> dict:
        last = max(((f.mtime_ns, f.path) for f in files(self.folder)), default=(0, ""))
        return {"time": last[0], "path": last[1]}

    def partitions(self, start: dict, end: dict) -> list[FilePartition]:
        low, high = ((x["time"], x["path"]) for x in (start, end))
        return [FilePartition(f.path) for f in files(self.folder) if low < (f.mtime_ns, f.path) <= high]

    def read(self, partition: FilePartition) -> Iterator[pa.RecordBatch]:
        yield from batches(self.folder, partition.path, self.layouts)


class ExportSource(DataSource):
    """Own exports: a subclass with more layouts, registered in place of this one. Paths are those that Arrow opens (local, S3, GCS, HDFS); for others there is csv.ingest."""

    layouts: ClassVar[tuple[Layout, ...]] = LAYOUTS

    @classmethod
    def name(cls) -> str:
        return "campaign_exports"

    def schema(self) -> StructType:
        return UNIFIED

    def _folder(self) -> str:
        if not self.options.get("path"):
            raise ValueError("campaign_exports needs a folder")
        return self.options["path"]

    def reader(self, schema: StructType) -> ExportReader:
        return ExportReader(self._folder(), self.layouts)

    def streamReader(self, schema: StructType) -> ExportStreamReader:
        return ExportStreamReader(self._folder(), self.layouts)


def register(spark: SparkSession, source: type[ExportSource] = ExportSource) -> None:
    spark.dataSource.register(source)
