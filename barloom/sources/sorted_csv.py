"""Scan of some days out of CSV files that are sorted by time, reading only the bytes of those days.

``spark.read.format("sorted_csv")`` is a Python data source. The driver looks for the first byte of the first day and the first
byte after the last day by binary search over byte offsets, some twenty small reads for a file of any size, and plans
byte ranges of ``split_bytes`` in between; tasks read their range and nothing else. Files are reached by ``pyarrow.fs`` (local
folders, hdfs, s3, gs), so executors need no local copy.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.csv
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from barloom.functions.scalars import number, read_timestamp

PROBE = 1 << 10
SPLIT = 16 << 20
DAY = re.compile(rb'"?(\d{4}-\d{2}-\d{2})')


@dataclass
class Source:
    """One file: its size, the bytes of its header line and what was read so far."""

    fs: pa.fs.FileSystem
    path: str
    size: int
    probed: int = 0

    def read(self, at: int, n: int) -> bytes:
        with self.fs.open_input_file(self.path) as f:
            f.seek(at)
            data = f.read(min(n, self.size - at))
        self.probed += len(data)
        return data

    def header(self) -> bytes:
        """The first line with its end."""
        n = PROBE
        while True:
            data = self.read(0, n)
            end = data.find(b"\n")
            if end >= 0 or len(data) >= self.size:
                return data[: end + 1] if end >= 0 else data
            n *= 4

    def first_line(self, at: int, end: int, index: int) -> tuple[int, bytes] | None:
        """Start and day of the first line with a readable day that begins at ``at`` or later and before ``end``."""
        began = at - 1  # a line begins after a newline, which may be the byte before
        data = b""
        while at - 1 + len(data) < self.size:
            data += self.read(at - 1 + len(data), max(PROBE, len(data)))
            while (cut := data.find(b"\n")) >= 0:
                start = began + cut + 1
                if start >= end:
                    return None
                stop = data.find(b"\n", cut + 1)
                if stop < 0 and began + len(data) < self.size:
                    break  # the line goes on behind what was read
                if day := day_of(data[cut + 1 : stop if stop >= 0 else None], index):
                    return start, day
                if stop < 0:
                    return None
                began, data = began + stop, data[stop:]
            at = began + 1
        return None

    def lower(self, day: bytes, low: int, index: int, after: bool = False) -> int:
        """Offset of the first line of ``day`` or a later one (``after``: of a later one); the size if there is none."""
        high = self.size
        while low < high:
            mid = (low + high) // 2
            found = self.first_line(mid, high, index)
            if found and (found[1] <= day if after else found[1] < day):
                low = found[0] + 1
            else:
                high = mid
        found = self.first_line(low, self.size, index) if low < self.size else None
        return found[0] if found else self.size


def day_of(line: bytes, index: int) -> bytes | None:
    cells = line.split(b",", index + 1)
    found = DAY.match(cells[index].strip()) if len(cells) > index else None
    return found and found[1]


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int
    first: int  # where the day range of the file begins: a line starts there


def sources(uri: str) -> list[Source]:
    """CSV files at a path: one file, or those of a folder and the folders below it."""
    fs, path = pa.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    info = fs.get_file_info(path)
    if info.type == pa.fs.FileType.File:
        return [Source(fs, path, info.size)]
    if info.type == pa.fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    below = fs.get_file_info(pa.fs.FileSelector(path, recursive=True))
    return [Source(fs, i.path, i.size) for i in sorted(below, key=lambda i: i.path) if i.type == pa.fs.FileType.File and i.size and i.base_name.endswith(".csv")]


class SortedCsv(DataSource):
    """Options: ``path``, ``time`` (the sorted column, ISO text; default ``timestamp``), ``from`` and ``to`` (days, both included),
    ``split_bytes``. Columns are text. Quoted line breaks are not supported; rows with another number of cells are left out."""

    @classmethod
    def name(cls) -> str:
        return "sorted_csv"

    def schema(self) -> StructType:
        files = sources(self.options["path"])
        return StructType([StructField(c, StringType()) for c in names(files[0].header())] if files else [])

    def reader(self, schema: StructType) -> SortedCsvReader:
        return SortedCsvReader(schema, dict(self.options))


def names(header: bytes) -> list[str]:
    return [c.strip().strip('"') for c in header.decode("utf-8-sig").strip().split(",")]


class SortedCsvReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.columns = schema.fieldNames()
        self.uri, self.time = options["path"], options.get("time", "timestamp")
        self.days = [str(dt.date.fromisoformat(options[k])).encode() if options.get(k) else None for k in ("from", "to")]
        self.split = int(options.get("split_bytes", SPLIT))

    def day_range(self, file: Source) -> tuple[int, int]:
        """Byte range of the days in a file."""
        header = file.header()
        columns = names(header)
        if columns != self.columns or self.time not in columns:
            raise ValueError(f"columns of {file.path} are {columns}")
        index, (first, last) = columns.index(self.time), self.days
        start = file.lower(first, len(header), index) if first else len(header)
        end = file.lower(last, start, index, after=True) if last else file.size
        return start, end

    def partitions(self) -> list[Range]:
        files = sources(self.uri)
        with ThreadPoolExecutor(16) as pool:
            ranges = list(pool.map(self.day_range, files))
        out = [Range(f.path, at, min(at + self.split, b), a) for f, (a, b) in zip(files, ranges) for at in range(a, b, self.split)]
        return out or [Range("", 0, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.start >= part.end:
            return
        fs, _ = pa.fs.FileSystem.from_uri(self.uri if "://" in self.uri or self.uri.startswith("file:") else f"file://{self.uri}")
        with fs.open_input_file(part.path) as f:
            inner = part.start > part.first  # then the lines from the first newline on are this range's
            f.seek(part.start - inner)
            data = f.read(part.end - part.start + inner)
            if inner:
                cut = data.find(b"\n")
                data = data[cut + 1 :] if cut >= 0 else b""
            while data and not data.endswith(b"\n") and (more := f.read(PROBE)):
                end = more.find(b"\n")
                data += more[: end + 1] if end >= 0 else more
        if not data.strip():
            return
        read = pa.csv.ReadOptions(column_names=self.columns, use_threads=False)
        parse = pa.csv.ParseOptions(invalid_row_handler=lambda row: "skip")
        kinds = pa.csv.ConvertOptions(column_types={c: pa.string() for c in self.columns}, strings_can_be_null=True, null_values=[""], quoted_strings_can_be_null=True)
        yield from pa.csv.read_csv(pa.BufferReader(data), read, parse, kinds).to_batches(max_chunksize=10_000)


def scan_days(spark: SparkSession, path: str, first: str | None = None, last: str | None = None, time: str = "timestamp", split_bytes: int = SPLIT) -> DataFrame:
    """Lines of the days ``first .. last`` of time-sorted CSV files, all columns as text."""
    spark.dataSource.register(SortedCsv)
    reader = spark.read.format("sorted_csv").option("time", time).option("split_bytes", split_bytes)
    for key, day in (("from", first), ("to", last)):
        if day:
            reader = reader.option(key, day)
    out = reader.load(path)
    days = F.substring(F.trim(F.col(f"`{time}`")), 1, 10)
    for day, keep in ((first, days >= F.lit(first)), (last, days <= F.lit(last))):
        if day:
            out = out.where(keep)  # unreadable stamps inside the range
    return out


def read_day_csv(spark: SparkSession, path: str, day: str, numbers: Sequence[str], others: Sequence[str] = (), zone: str = "UTC", split_bytes: int = SPLIT) -> DataFrame:
    """One day of time-sorted CSV bars: ``ts`` in UTC wall time of stamps that are local to ``zone`` where they name none."""
    raw = scan_days(spark, path, day, day, split_bytes=split_bytes)
    out = raw.select(read_timestamp(F.col("timestamp"), zone=zone).alias("ts"), *others, *[number(F.col(n)).alias(n) for n in numbers])
    return out.where("ts IS NOT NULL")
