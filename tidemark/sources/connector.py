"""Bars behind ``spark.read.format("tidemark_bars")`` and its stream: a store of files, read by pages.

A store is a folder with Parquet or CSV files of bars, below ``ticker=…`` and ``year=…`` folders where it has them.
Folders that can't hold a wanted bar aren't listed, row groups that can't aren't read.  What is wanted is said by options,
not by pushed filters: Spark 4.1 keeps the filters that one use of a frame pushed for its other uses too, so that a frame
used twice, as in a self-join, would lack rows.  A page is a task's work: small files together, or a run of row groups of
a large one, cut by size alone, so that planning opens no file.

Options: ``path`` (roots, comma-separated: the first that has files is read, the others are its fallbacks),
``tickers`` (a JSON list), ``first`` and ``last`` (inclusive dates; bars without a date are left out where one is given),
``page_bytes`` (size of a page), ``settle`` (streams: seconds that a file must have rested before it counts, so that
none with the same time comes later).

Rows: column names are matched whatever their case and padding; a missing column is null, as are values that aren't
numbers or dates; the folder's ticker counts before the file's.  A store without files has no rows; if no root exists,
planning fails.
"""

from __future__ import annotations

import datetime
import json
import time
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .bars import DATE_NAMES, PRICE_NAMES, SCHEMA, canonical

FORMAT = "tidemark_bars"
PAGE_BYTES = 64 << 20
#: Files that a page holds at most: opening one counts as this part of a page.
FILES = 16
#: What Spark names the folder of a null key.
NULL_KEY = "__HIVE_DEFAULT_PARTITION__"
ARROW = pa.schema([("ticker", pa.string()), ("ts", pa.date32()), *((n, pa.float64()) for n in PRICE_NAMES)])


@dataclass
class Wanted:
    """Tickers (None: all) and the inclusive dates that a read asks for."""

    tickers: frozenset | None = None
    first: datetime.date = datetime.date.min
    last: datetime.date = datetime.date.max

    @classmethod
    def of(cls, options: dict) -> Wanted:
        tickers, first, last = (options.get(n) for n in ("tickers", "first", "last"))
        day = datetime.date.fromisoformat
        return cls(None if tickers is None else frozenset(json.loads(tickers)), day(first) if first else datetime.date.min, day(last) if last else datetime.date.max)

    def folder(self, key: str, value: str | None) -> bool:
        """Whether a folder ``key=value`` can hold a wanted bar."""
        if key == "ticker":
            return self.tickers is None or value in self.tickers
        if key == "year" and value is not None and value.isdigit():
            return self.first.year <= int(value) <= self.last.year
        return True

    def dated(self) -> bool:
        return self.first > datetime.date.min or self.last < datetime.date.max


@dataclass
class Piece:
    """Part ``k`` of ``n`` of a file; ``keys`` are those of its folders."""

    path: str
    keys: dict
    k: int = 0
    n: int = 1


@dataclass
class Page(InputPartition):
    root: str
    pieces: list = field(default_factory=list)


def opened(root: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a root and its path there."""
    if root.startswith("file:/") and not root.startswith("file://"):
        root = root[len("file:") :]
    return pafs.FileSystem.from_uri(root)


def files(root: str, wanted: Wanted) -> list[tuple[pafs.FileInfo, dict]] | None:
    """(file, keys of its folders) below a root, without folders that can't hold a wanted bar; None: there is no root."""
    system, top = opened(root)
    if system.get_file_info(top).type == pafs.FileType.NotFound:
        return None
    out, todo = [], [(top, {})]
    while todo:
        at, keys = todo.pop()
        alone = system.get_file_info(at)
        for x in [alone] if alone.is_file else system.get_file_info(pafs.FileSelector(at)):
            if x.base_name[:1] in "_.":
                continue
            if x.is_file:
                if x.extension in ("parquet", "csv") and x.size:
                    out.append((x, keys))
                continue
            key, sign, value = x.base_name.partition("=")
            value = None if value == NULL_KEY else unquote(value)
            if not sign:
                todo.append((x.path, keys))
            elif wanted.folder(key, value):
                todo.append((x.path, {**keys, key: value}))
    return sorted(out, key=lambda f: f[0].path)


def pages(root: str, found: list, size: int) -> list[Page]:
    """Pages of about ``size`` bytes: large Parquet files in parts, small files together."""
    out, room = [], 0
    for x, keys in found:
        n = -(-x.size // size) if x.extension == "parquet" else 1
        cost = max(x.size / n, size / FILES)
        for k in range(n):
            if not out or room < cost:
                out.append(Page(root, []))
                room = size
            out[-1].pieces.append(Piece(x.path, keys, k, n))
            room -= cost
    return out


def _cast(column: pa.ChunkedArray | pa.Array, kind: pa.DataType) -> pa.Array:
    """A column in its kind; text that can't be read so becomes null."""
    if column.type == kind:
        return column
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        text = pc.utf8_trim_whitespace(column)
        if pa.types.is_date(kind):
            day = pc.utf8_slice_codeunits(text, 0, 10)
            return pc.cast(pc.strptime(day, format="%Y-%m-%d", unit="s", error_is_null=True), kind)
        ok = pc.match_substring_regex(text, r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
        return pc.cast(pc.if_else(ok, text, None), kind)
    if pa.types.is_null(column.type):
        return pa.nulls(len(column), kind)
    return pc.cast(column, kind, safe=False)


def batches(page: Page, wanted: Wanted) -> Iterator[pa.RecordBatch]:
    """The wanted bars of a page."""
    system, _ = opened(page.root)
    for piece in page.pieces:
        parquet = piece.path.endswith(".parquet")
        part = (ds.ParquetFileFormat() if parquet else ds.CsvFileFormat()).make_fragment(piece.path, system)
        if parquet and piece.n > 1:
            total = part.metadata.num_row_groups
            groups = list(range(piece.k * total // piece.n, (piece.k + 1) * total // piece.n))
            if not groups:
                continue
            part = part.subset(row_group_ids=groups)
        own = {c.strip().lower(): c for c in part.physical_schema.names}
        date = next((own[n] for n in ("ts", *DATE_NAMES) if n in own), None)
        names = {"ts": date, **{n: own.get(n) for n in ("ticker", *PRICE_NAMES)}}
        limits = None
        if date is not None and wanted.dated() and part.physical_schema.field(date).type == pa.date32():
            limits = (ds.field(date) >= pa.scalar(wanted.first)) & (ds.field(date) <= pa.scalar(wanted.last))
        for batch in part.to_batches(columns=sorted({n for n in names.values() if n}), filter=limits):
            columns = []
            for f in ARROW:
                if f.name == "ticker" and "ticker" in piece.keys:
                    columns.append(pa.array([piece.keys["ticker"]], pa.string()).take(pa.array([0] * len(batch), pa.int32())))
                elif names[f.name] is None:
                    columns.append(pa.nulls(len(batch), f.type))
                else:
                    columns.append(_cast(batch.column(names[f.name]), f.type))
            out = pa.RecordBatch.from_arrays(columns, schema=ARROW)
            if wanted.dated():
                ts = out.column("ts")
                out = out.filter(pc.fill_null(pc.and_(pc.greater_equal(ts, pa.scalar(wanted.first)), pc.less_equal(ts, pa.scalar(wanted.last))), False))
            if wanted.tickers is not None:
                out = out.filter(pc.is_in(out.column("ticker"), pa.array(sorted(wanted.tickers), pa.string())))
            if len(out):
                yield out


def _roots(options: dict) -> list[str]:
    roots = [x.strip() for x in options.get("path", "").split(",") if x.strip()]
    if not roots:
        raise ValueError("the bar source needs a path")
    return roots


class BarReader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots, self.size, self.wanted = _roots(options), int(options.get("page_bytes", PAGE_BYTES)), Wanted.of(options)

    def partitions(self) -> list[Page]:
        missing = True
        for root in self.roots:
            # a fallback is for a store without files, not for one without wanted bars
            found = files(root, self.wanted)
            missing &= found is None
            if found or (found is not None and files(root, Wanted())):
                return pages(root, found, self.size) or [Page(root)]
        if missing:
            raise FileNotFoundError(f"no bars at {', '.join(self.roots)}")
        return [Page(self.roots[0])]  # no rows; without a page Spark would read the source as one

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        yield from batches(partition, self.wanted)


class BarStream(DataSourceStreamReader):
    """Files in the order of their times; an offset is the last file taken.  Files aren't changed once written."""

    def __init__(self, options: dict):
        self.root, self.size = _roots(options)[0], int(options.get("page_bytes", PAGE_BYTES))
        self.settle, self.wanted = float(options.get("settle", 2)), Wanted.of(options)

    @staticmethod
    def _place(x: pafs.FileInfo) -> tuple[int, str]:
        return x.mtime_ns or 0, x.path

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        until = time.time_ns() - int(self.settle * 1e9)
        last = max((self._place(x) for x, _ in files(self.root, self.wanted) or [] if (x.mtime_ns or 0) <= until), default=(-1, ""))
        return {"time": last[0], "path": last[1]}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        low, high = (start["time"], start["path"]), (end["time"], end["path"])
        found = [f for f in files(self.root, self.wanted) or [] if low < self._place(f[0]) <= high]
        return pages(self.root, found, self.size)

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        yield from batches(partition, self.wanted)

    def commit(self, end: dict) -> None:
        """Nothing is held for a batch."""


class BarSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self):
        return SCHEMA

    def reader(self, schema) -> BarReader:
        return BarReader(self.options)

    def streamReader(self, schema) -> BarStream:
        return BarStream(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    spark.dataSource.register(BarSource)


def export_store(bars: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Bars as a store: below folders of ticker and year, by ranges of time, so that a long series is many files."""
    own = bars.withColumn("year", F.year("ts")).repartitionByRange("ticker", "ts").sortWithinPartitions("ticker", "year", "ts")
    own.write.partitionBy("ticker", "year").mode(mode).parquet(path)


def connect(spark: SparkSession, *roots: str, tickers: list[str] | None = None, first: str | None = None, last: str | None = None, **options: str) -> DataFrame:
    """Bars of the first root that has some, between dates, gaps carried forward from the first one on."""
    register(spark)
    asked = {"tickers": None if tickers is None else json.dumps(tickers), "first": first, "last": last} | options
    own = spark.read.format(FORMAT).options(**{k: v for k, v in asked.items() if v is not None}).load(",".join(roots))
    return canonical(own.withColumnRenamed("ts", "date"))
