"""Files of rows by day that late rows change, kept up by signed deltas.

A layout keeps the latest row of each key, cuts each day into files of fixed stride in a total order, and stands in folders
``version=v/day=d/file_no=k``. Late rows are merged in: the latest of them for each key emits a row of weight +1 and, where the key stood
in the layout, its old row with weight -1. Days of either are dirty. Their stored rows (weight +1) and the deltas
are added up; rows of weight 0 are gone, the others are ranked anew and written as the next version, and the old folders of dirty days go
once it is there. All other files stay as they are. The consolidated rows are in the shared folder before the layout changes, and the
highest version of a dirty day holds, so a run that breaks off can be taken up by ``finish``.

Ranks need no task that holds a day: rows are range-partitioned by day and order (keys are unique, so equal times are split),
counted by partition and day, and numbered by those sums. A file is written by one task, as a stream of sorted rows.

Defined cases: a row without an arrival is older than any that has one; of rows of a key that arrived at once the largest by all columns
in order stays; null keys are one key; a null time is day -1; null totals, and those that are no finite number, are 0 cents; extra
columns are kept, but for the names day, file_no and version, which are the folders' (an error); a table without rows has no files; without late rows nothing is rewritten.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, drop_folder, filesystem, free_name, shared_path, stored

CUT = "2024-03-01 00:00:00"
#: Files of all days together, about.
FILES = 900
FILE = "day long, file_no long, n_rows long, cents long, rows_crc long, path string, columns string, ids_sha256 string, rewritten boolean"


def day_of(time: Column) -> Column:
    return F.coalesce(F.unix_date(F.to_date(time)), F.lit(-1)).cast("long")


def micros(time: Column) -> Column:
    """Microseconds since 1970 of a time without zone, read in UTC whatever the session's zone."""
    second = F.hour(time) * 3600 + F.minute(time) * 60
    return F.unix_date(F.to_date(time)).cast("long") * 86_400_000_000 + second.cast("long") * 1_000_000 + (F.date_part(F.lit("SECOND"), time) * 1_000_000).cast("long")


def latest(rows: DataFrame, key: str, arrived: str) -> DataFrame:
    """The row of each key that arrived last. Each task sends one row of a key at most."""
    rest = [c for c in rows.columns if c not in (key, arrived)]
    best = rows.groupBy(F.col(f"`{key}`").alias("_key")).agg(F.max(F.struct(F.col(f"`{arrived}`"), *[F.col(f"`{c}`") for c in rest])).alias("_row"))
    return best.select(*[F.col("_key").alias(key) if c == key else F.col(f"_row.`{c}`").alias(c) for c in rows.columns])


class Layout:
    """Daily files of rows in ``folder``; ``key``, ``time`` and ``arrived`` name columns, ``stride`` is the rows of a file."""

    def __init__(self, spark: SparkSession, folder: str, stride: int, key: str = "sale_id", time: str = "sold_at", arrived: str = "arrived_at"):
        self.spark, self.folder, self.stride = spark, folder, stride
        self.key, self.time, self.arrived = key, time, arrived

    def write(self, rows: DataFrame, version: int) -> None:
        """Rows of unique keys as the files of a version: each day ranked by time and key, cut at the stride."""
        names = rows.columns
        clash = {"day", "file_no", "version"} & {c.lower() for c in names}
        if clash:
            raise ValueError(f"columns {sorted(clash)} have the names of the layout's folders")
        day, part, at = (free_name(rows, n) for n in ("day", "_part", "_at"))
        order = [day, f"`{self.time}`", f"`{self.key}`"]
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        placed = rows.withColumn(day, day_of(F.col(f"`{self.time}`"))).repartitionByRange(parts, *order).sortWithinPartitions(*order)
        # The low 33 bits of the id are the place within the partition.
        placed = stored(placed.withColumns({part: F.spark_partition_id(), at: F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "placed")
        held = placed.groupBy(day, part).agg(F.count("*").alias("_n"), F.min(at).alias("_first"))
        earlier = F.sum("_n").over(Window.partitionBy(day).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
        shift = held.select(day, part, (F.coalesce(earlier, F.lit(0)) - F.col("_first")).alias("_shift"))
        numbered = placed.join(shift, [day, part]).withColumn("file_no", F.floor((F.col(at) + F.col("_shift")) / self.stride))
        out = numbered.select(F.col(day).alias("day"), "file_no", *[F.col(f"`{c}`") for c in names])
        files = out.repartition("day", "file_no").sortWithinPartitions("day", "file_no", f"`{self.time}`", f"`{self.key}`")
        files.write.partitionBy("day", "file_no").parquet(f"{self.folder}/version={version}")
        discard(placed)

    def rows(self) -> DataFrame:
        """The stored rows with day, file_no and version."""
        return self.spark.read.option("basePath", self.folder).parquet(self.folder)

    def versions(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(int(s.getPath().getName().removeprefix("version=")) for s in fs.listStatus(path) if s.getPath().getName().startswith("version=")) if fs.exists(path) else []

    def has_files(self) -> bool:
        """Whether any day has been written."""
        return any(self.days(v) for v in self.versions())

    def days(self, version: int) -> dict[int, str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/version={version}")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return {int(s.getPath().getName().removeprefix("day=")): str(s.getPath().toString()) for s in fs.listStatus(path) if s.getPath().getName().startswith("day=")}

    def merge(self, late: DataFrame) -> None:
        """Make it the layout of its rows and ``late`` ones."""
        names = late.columns
        winners = latest(late, self.key, self.arrived)
        packed = lambda t: F.struct(F.col(f"{t}.`{self.arrived}`"), *[F.col(f"{t}.`{c}`") for c in names if c != self.arrived])
        if self.has_files():
            base = self.rows()
            same = F.col(f"new.`{self.key}`").eqNullSafe(F.col(f"old.`{self.key}`"))
            met = winners.alias("new").join(base.select(*[f"`{c}`" for c in names], F.lit(True).alias("_there")).alias("old"), same, "left")
            met = met.filter(F.col("old._there").isNull() | (packed("new") > packed("old")))
            plus, minus = ([F.col(f"{t}.`{c}`").alias(c) for c in names] for t in ("new", "old"))
            signed = F.array(F.struct(*plus, F.lit(1).alias("_weight")), F.when(F.col("old._there"), F.struct(*minus, F.lit(-1).alias("_weight"))))
            delta = met.select(F.explode(F.array_compact(signed)).alias("_d")).select("_d.*")
        else:
            delta = winners.withColumn("_weight", F.lit(1))
        delta = stored(delta, "delta")
        # A row per day of the calendar.
        dirty = stored(delta.select(day_of(F.col(f"`{self.time}`")).alias("day")).distinct(), "dirty")
        if not dirty.limit(1).count():
            return discard(delta, dirty)
        together = delta
        if self.has_files():
            held = self.rows().join(dirty, "day", "left_semi").select(*[F.col(f"`{c}`") for c in names], F.lit(1).alias("_weight"))
            together = delta.unionByName(held)
        summed = together.groupBy(*[F.col(f"`{c}`") for c in names]).agg(F.sum("_weight").alias("_weight"))
        consolidated = stored(summed.filter("_weight > 0").drop("_weight"), "consolidated")
        self.finish(consolidated, dirty)
        discard(delta, consolidated, dirty)

    def finish(self, consolidated: DataFrame, dirty: DataFrame) -> None:
        """Write the rows of dirty days as a new version, then take away what older versions hold of these days."""
        version = max(self.versions(), default=-1) + 1
        self.write(consolidated, version)
        gone = {r["day"] for r in dirty.collect()}
        for v in range(version):
            for day, path in self.days(v).items():
                if day in gone:
                    drop_folder(self.spark, path)

    def files(self, total: str = "total") -> DataFrame:
        """One row per file of the layout, read back from it."""
        if not self.has_files():
            return self.spark.createDataFrame([], FILE)
        stamp = lambda c: F.coalesce(micros(F.col(f"`{c}`")).cast("string"), F.lit(""))
        sale = F.coalesce(F.col(f"`{self.key}`").cast("string"), F.lit(""))
        cents = F.floor(100 * F.col(f"`{total}`").cast("double") + 0.5)
        sound = F.col(f"`{total}`").isNotNull() & ~F.isnan(f"`{total}`") & (F.abs(F.col(f"`{total}`")) < 9e16)
        slim = self.rows().select(
            F.col("day").cast("long").alias("day"), F.col("file_no").cast("long").alias("file_no"), F.col("version").cast("int").alias("version"), F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.row_index").alias("at"), sale.alias("sale"), F.when(sound, cents).otherwise(0).cast("long").alias("cents"),
            F.crc32(F.concat_ws(":", sale, stamp(self.time), stamp(self.arrived)).cast("binary")).alias("crc"),
        )

        def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows come by file and place; sums and a running digest stand for the file at hand."""

            def row(first: dict, n: int, cents: int, crc: int, ids) -> pa.RecordBatch:
                system, name = filesystem(first["path"])
                columns = ",".join(pq.read_schema(name, filesystem=system).names)
                values = [first["day"], first["file_no"], n, cents, crc, first["path"], columns, ids.hexdigest(), first["version"] > 0]
                kinds = [*[pa.int64()] * 5, *[pa.string()] * 3, pa.bool_()]
                return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], [c.split()[0] for c in FILE.split(", ")])

            now, n, cents, crc, ids = None, 0, 0, 0, hashlib.sha256()
            for batch in batches:
                if not batch.num_rows:
                    continue
                codes = batch.column(3).dictionary_encode().indices.to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), batch.num_rows]
                for a, b in zip(cuts, cuts[1:]):
                    first = {c: batch.column(c)[a].as_py() for c in ("day", "file_no", "version", "path")}
                    if now is None or first["path"] != now["path"]:
                        if now is not None:
                            yield row(now, n, cents, crc, ids)
                        now, n, cents, crc, ids = first, 0, 0, 0, hashlib.sha256()
                    ids.update((("," if n else "") + ",".join(batch.column(5)[a:b].to_pylist())).encode())
                    n += b - a
                    cents += int(batch.column(6).to_numpy()[a:b].sum())
                    crc += int(batch.column(7).to_numpy()[a:b].sum())
            if now is not None:
                yield row(now, n, cents, crc, ids)

        return slim.repartition("path").sortWithinPartitions("path", "at").mapInArrow(told, FILE).withColumn("path", F.regexp_replace("path", "^file:/+", "/"))


def with_corrections(sales: DataFrame) -> DataFrame:
    """The rows and, for every third sale (by hash) of every tenth day, a later copy with another total."""
    h = F.crc32(F.col("sale_id").cast("string").cast("binary"))
    days = lambda n: F.make_dt_interval(n.cast("int"))
    changed = {"total": F.col("total") + 1, "sold_at": F.col("sold_at") + days(h % 2), "arrived_at": F.col("arrived_at") + days(1 + h % 97)}
    picked = sales.filter((h % 3 == 0) & (day_of(F.col("sold_at")) % 10 == 0))
    return sales.unionByName(picked.select(*[(changed[c].cast(t) if c in changed else F.col(f"`{c}`")).alias(c) for c, t in sales.dtypes]))


def late_layout(spark: SparkSession, sales: DataFrame, folder: str, cut: str = CUT, files: int = FILES) -> Layout:
    """The layout of the rows of ``sales`` (and their corrections) that arrived before ``cut``, and then of all."""
    layout = Layout(spark, folder, 1 + sales.count() // files)
    rows = with_corrections(sales)
    early = F.coalesce(F.col("arrived_at") < F.lit(cut).cast(dict(sales.dtypes)["arrived_at"]), F.lit(False))
    layout.write(latest(rows.filter(early), layout.key, layout.arrived), 0)
    layout.merge(rows.filter(~early))
    return layout


def op12_late_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return late_layout(spark, spark.read.parquet(f"{sf_dir}/sales.parquet"), shared_path(spark, "sales_by_day")).files()
