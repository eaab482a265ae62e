"""Which files of a glob can be read: names are rows, footers and pages are tried by tasks, the report is a table.

Files come from one listing; no job and no opening of a file happens for each of them on the driver. A task opens a file through its own file system and
decodes it row group by row group; where a store can be reached by Spark's readers alone, it gets the bytes from Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPORT = "file_path string, size long, rows long, columns array<string>, error string"
#: Schemes of stores that tasks can open themselves.
DIRECT = ("", "file", "hdfs", "s3", "s3a", "gs", "abfs", "abfss")
#: Rows decoded at once.
ROWS = 20_000


def listed(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, length, content) of the files that match. Its ``inputFiles`` are all names; rows leave out files of no bytes."""
    try:
        return spark.read.format("binaryFile").load(f"{path.rstrip('/')}/{pattern}").select("path", "length", "content")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"no file matches {pattern} in {path}") from None


def tried(file, pages: bool) -> tuple[int, list[str]]:
    """(rows, columns) of an open file, whose pages are all decoded if asked for."""
    table = pq.ParquetFile(file)
    rows = table.metadata.num_rows
    if pages:
        seen = sum(b.num_rows for b in table.iter_batches(batch_size=ROWS))
        if seen != rows:
            raise ValueError(f"{seen} rows where the footer tells {rows}")
    return rows, table.schema_arrow.names


def probe(spark: SparkSession, path: str, pattern: str = "*.parquet", pages: bool = True, keep: Callable[[str], bool] | None = None, needs: str | None = None) -> DataFrame:
    """The report: a row for each file (or table of several files) that the pattern matches and whose name ``keep`` lets through; ``error`` is null for those that can be read.

    With ``needs``, files without that column or without rows have an error as well.
    """
    base, depth = urlparse(path).path.rstrip("/"), pattern.count("/") + 1

    def match_of(name: str) -> str:
        """The name that the pattern matched: of the file, or of the folder it is in."""
        at = name.find(base + "/") + len(base) + 1
        return name[:at] + "/".join(name[at:].split("/")[:depth])

    direct = urlparse(path).scheme in DIRECT
    found = listed(spark, path, pattern)
    names = spark.createDataFrame([(n,) for n in found.inputFiles()], "path string")
    names = names.repartition(4 * spark.sparkContext.defaultParallelism)
    files = names.select("path", F.lit(None).cast("long").alias("length"), F.lit(None).cast("binary").alias("content"))
    if not direct:
        plain = F.regexp_replace(F.col("path"), "^([a-z0-9]+):/+", "$1:/")
        files = found.unionByName(files.join(found.select(plain.alias("_p")), plain == F.col("_p"), "left_anti"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, size = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                match = match_of(name)
                if keep is not None and not keep(unquote(match).rsplit("/", 1)[-1]):
                    continue
                rows, columns, error = None, None, None
                try:
                    if direct:
                        system, at = fs.FileSystem.from_uri(unquote(name))
                        size = system.get_file_info(at).size
                        with system.open_input_file(at) as f:
                            rows, columns = tried(f, pages)
                    elif not size:
                        raise ValueError("a file of no bytes")
                    else:
                        rows, columns = tried(pa.BufferReader(batch.column(2)[i].as_buffer()), pages)
                except Exception as e:  # noqa: BLE001  the error is the report
                    error = (str(e) or type(e).__name__).splitlines()[0][:500]
                values = zip((match, size, rows, columns, error), (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in values], ["file_path", "size", "rows", "columns", "error"])

    report = files.mapInArrow(run, REPORT).groupBy("file_path").agg(
        F.sum("size").alias("size"), F.sum("rows").alias("rows"), F.min("columns").alias("columns"), F.min("error").alias("error"), F.bool_and(F.array_contains("columns", needs or "")).alias("_has"),
    )
    if needs is not None:
        unfit = F.when(~F.col("_has"), f"no column {needs}").when(F.col("rows") == 0, "empty")
        report = report.withColumn("error", F.coalesce("error", unfit))
    return report.drop("_has")
