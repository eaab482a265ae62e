"""A Python data source over a stored page table whose partitions are windows of dates; batch and stream.

    spark.dataSource.register(PageWindows)
    spark.read.format("page_windows").options(path=..., start="2024-01-01", end="2024-03-31", days=7).load()
    spark.readStream.format("page_windows").options(path=..., start="2024-01-01", end="2024-03-31", days=7).load()

The table lies in folders ``date=YYYY-MM-DD``; a task opens those of its window alone and sends their rows on batch by batch. Rows carry
their window. A window that can't be read doesn't end the others: what was read of it stays, and a row with its error and nothing else follows.
A stream's offset is the number of windows that were read, so it goes on with the next one after a restart; it reads windows
whose last day, or a later one, has landed, a task for each.

Defined cases: days without a folder have no rows; an end before the start has no windows; columns that a file lacks are null, further ones are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

#: The columns of a page; another schema can be given to the reader (``.schema(...)``), with the window's columns in it.
PAGE = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("date", T.DateType())])
WINDOW = T.StructType([T.StructField("window_start", T.DateType()), T.StructField("window_end", T.DateType()), T.StructField("error", T.StringType())])


@dataclass
class DateWindow(InputPartition):
    start: date
    end: date

    def days(self) -> Iterator[date]:
        for k in range((self.end - self.start).days + 1):
            yield self.start + timedelta(days=k)


def windows(start: date, end: date, days: int) -> list[DateWindow]:
    """Consecutive inclusive windows, the last one cut at the end."""
    if days < 1:
        raise ValueError("a window has a day at least")
    firsts = range(0, (end - start).days + 1, days)
    return [DateWindow(start + timedelta(days=k), min(end, start + timedelta(days=k + days - 1))) for k in firsts]


def by_day(pages: DataFrame, path: str, date: str = "date") -> None:
    """Writes a table as this source reads it."""
    pages.repartition(date).write.partitionBy(date).parquet(path)


class _Windows:
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.path = schema, options["path"].rstrip("/")
        self.all = windows(date.fromisoformat(options["start"]), date.fromisoformat(options["end"]), int(options.get("days", 1)))

    def place(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path if "://" in self.path else "file://" + self.path.removeprefix("file:"))

    def read(self, partition: DateWindow) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(self.schema)

        def batch(rows: int, columns: dict) -> pa.RecordBatch:
            own = {"window_start": partition.start, "window_end": partition.end, **columns}
            return pa.RecordBatch.from_arrays([own[f.name].cast(f.type) if isinstance(own.get(f.name), pa.Array) else pa.array([own.get(f.name)] * rows, f.type) for f in arrow], schema=arrow)

        try:
            system, root = self.place()
            if system.get_file_info(root).type != fs.FileType.Directory:
                raise FileNotFoundError(f"no folder {self.path}")
            for day in partition.days():
                found = system.get_file_info(fs.FileSelector(f"{root}/date={day.isoformat()}", allow_not_found=True))
                for file in sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith(".parquet")):
                    with system.open_input_file(file) as f:
                        stored = pq.ParquetFile(f)
                        names = [n for n in stored.schema_arrow.names if n in arrow.names and n != "date"]
                        for part in stored.iter_batches(batch_size=1_000, columns=names):
                            yield batch(part.num_rows, {**{n: part.column(n) for n in names}, "date": day})
        except Exception as e:  # noqa: BLE001  the error is a row
            yield batch(1, {"error": (str(e) or type(e).__name__).splitlines()[0][:500]})


class PageReader(_Windows, DataSourceReader):
    def partitions(self) -> list[DateWindow]:
        return self.all


class PageStream(_Windows, DataSourceStreamReader):
    def initialOffset(self) -> dict:  # noqa: N802
        return {"window": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        system, root = self.place()
        names = [f.base_name for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True))]
        newest = max((n.removeprefix("date=") for n in names if n.startswith("date=") and n[5:6].isdigit()), default="")
        return {"window": sum(w.end.isoformat() <= newest for w in self.all)}

    def partitions(self, start: dict, end: dict) -> list[DateWindow]:
        return self.all[start["window"] : end["window"]]


class PageWindows(DataSource):
    """Options: path, start, end (inclusive, YYYY-MM-DD), days (of a window, 1)."""

    @classmethod
    def name(cls) -> str:
        return "page_windows"

    def schema(self) -> T.StructType:
        return T.StructType([*WINDOW.fields, *PAGE.fields])

    def reader(self, schema: T.StructType) -> PageReader:
        return PageReader(schema, dict(self.options))

    def streamReader(self, schema: T.StructType) -> PageStream:  # noqa: N802
        return PageStream(schema, dict(self.options))
