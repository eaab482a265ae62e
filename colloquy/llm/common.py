"""Shared helpers: shared-folder tables, prefix sums and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_ID = (1 << 63) - 1
#: Blocks in which the cells of a counting sketch travel.
BLOCKS = 16


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one of our own only where that is unset and all tasks run on this machine."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that all executors can reach")
        where = "file://" + tempfile.mkdtemp(prefix="colloquy-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, partition_by: str | None = None, compression: str | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder as Parquet and read it again.

    The copy survives the loss of any executor, unlike a local checkpoint.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    if compression:
        writer = writer.option("compression", compression)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def drop_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that no result still to be read refers to."""
    for t in tables:
        drop_folder(t.sparkSession, t.stored_path)


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the path in it, for tasks that write files of their own."""
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def free_name(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have, whatever its case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def bits_for(df: DataFrame, least: int, most: int) -> int:
    """Bits of a cell number, by the size that Spark estimates for ``df``: about a cell for each 256 bytes."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return min(most, max(least, (size // 256).bit_length()))


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cell_blocks(cells: np.ndarray) -> list[pa.Array]:
    """The columns (block, cells) of the sketch of one task."""
    return [pa.array(range(BLOCKS), pa.int32()), pa.array([p.tobytes() for p in cells.reshape(BLOCKS, -1)], pa.binary())]


def summed(sketches: DataFrame, cells: int, kind: type = np.uint32) -> np.ndarray:
    """The sketch of ``cells`` cells of all rows (block, cells): blocks are added up in ``BLOCKS`` tasks, one row of fixed size each reaches the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                one = np.frombuffer(v.as_buffer(), kind).astype(np.float64)
                total[k] = total[k] + one if k in total else one
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([v.astype(np.float32).tobytes() for v in total.values()], pa.binary())], ["block", "cells"]
        )

    rows = sketches.repartition(BLOCKS, "block").mapInArrow(add, "block int, cells binary").collect()
    out = np.zeros((BLOCKS, cells // BLOCKS), np.float32)
    for r in rows:
        out[r["block"]] = np.frombuffer(r["cells"], np.float32)
    return out.reshape(-1)


def members_of(rows: DataFrame, column: str, wanted: DataFrame, bits: int) -> DataFrame:
    """The rows whose long ``column`` may be in the same column of ``wanted``, by a bitmap of 2**(bits + 2) bits; a join has to follow.

    It spares the join the exchange of most rows. The bitmap has that size whatever the input.
    """
    spark, size = rows.sparkSession, 1 << (bits + 2)

    def place(ids: pa.Array) -> np.ndarray:
        h = ids.fill_null(0).to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - bits - 2)).astype(np.int64)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(size, bool)
        for batch in batches:
            cells[place(batch.column(0))] = True
        yield pa.RecordBatch.from_arrays(cell_blocks(np.packbits(cells)), ["block", "cells"])

    def either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                one = np.frombuffer(v.as_buffer(), np.uint8)
                total[k] = total[k] | one if k in total else one
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["block", "cells"])

    schema = "block int, cells binary"
    marked = wanted.select(column).mapInArrow(mark, schema).repartition(BLOCKS, "block").mapInArrow(either, schema).collect()
    cells = np.zeros((BLOCKS, size // 8 // BLOCKS), np.uint8)
    for r in marked:
        cells[r["block"]] |= np.frombuffer(r["cells"], np.uint8)
    sent = spark.sparkContext.broadcast(cells.reshape(-1))
    at = rows.columns.index(column)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = sent.value
        for batch in batches:
            p = place(batch.column(at))
            yield batch.filter(pa.array((bitmap[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1 == 1))

    return rows.mapInArrow(keep, rows.schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_key(column: str = "doc_id") -> Column:
    """An id that sorts nulls last and joins them with each other."""
    return F.coalesce(F.col(column).cast("long"), F.lit(MAX_ID))


def with_part(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(key, part, text): one row per row of ``docs`` under a key that is unique.

    ``key`` is the id with null as the largest value. Rows that share an id are
    parts 0, 1, ... of it in order of a hash of their text, numbered over many tasks
    where an id (or null) has many rows. The tables this runs over have unique ids, so the
    numbering is planned only when a pass over the id column alone finds a repeated one.
    """
    base = docs.select(id_key(id_column).alias("key"), F.col(text_column).cast("string").alias("text"))
    repeated = base.groupBy("key").count().filter("count > 1").limit(1).count() > 0
    if not repeated:
        return base.select("key", F.lit(0).cast("long").alias("part"), "text")
    hashed = base.select("key", "text", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("hash"), F.lit(1).alias("one"))
    return running_total(hashed, ["key"], ["hash", "text"], "one", "part", base.count()).select("key", "part", "text")


def slices(total: int, rows_each: int) -> int:
    """How many hex digits of a hash prefix split ``total`` rows into groups of about ``rows_each``."""
    digits = 0
    while total > rows_each * 16**digits and digits < 8:
        digits += 1
    return digits


def running_total(
    df: DataFrame, group: list[str], order: list[str], value: str, out: str, rows: int, rows_each: int = 2_000
) -> DataFrame:
    """Exclusive running sum of ``value`` within ``group`` in order of ``order``.

    ``order[0]`` must hold evenly spread hex strings (a hash). Groups are cut by
    a prefix of that hash, so a group that holds a third of all rows is spread
    over many tasks: sums per slice are pre-aggregated, their running totals
    make a table of ``rows / rows_each`` rows (about 16 million at most), and each
    slice then adds its own running sum. Groups are compared null-safely.
    """
    digits = slices(rows, max(rows_each, rows >> 20))
    cut = df.withColumn("_slice", F.substring(order[0], 1, digits) if digits else F.lit(""))
    keys = [F.coalesce(F.col(g).cast("string"), F.lit("\0null")).alias(f"_g{i}") for i, g in enumerate(group)]
    names = [f"_g{i}" for i in range(len(group))]
    cut = cut.select("*", *keys)
    sums = cut.groupBy(*names, "_slice").agg(F.sum(value).alias("_sum"))
    if names:
        before = Window.partitionBy(*names).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    else:
        before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*names, "_slice", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*names, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        cut.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(sums.hint("merge"), [*names, "_slice"])  # both sides are dealt by the slice already
        .withColumn(out, (F.col("_before") + F.col("_in")).cast("long"))
        .drop(*names, "_slice", "_before", "_in")
    )


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, least id reachable) over the edges of one task: labels sink along edges and jump along labels until none changes."""
    ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    label = np.arange(len(ids))
    while True:
        least = np.minimum(label[x], label[y])
        was = label.copy()
        # The labels of both ends sink, so that whole trees are hung on each other.
        for end in (x, y):
            np.minimum.at(label, was[end], least)
            np.minimum.at(label, end, least)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
        if np.array_equal(was, label):
            return ids, ids[label]


def components(edges: DataFrame, most_rounds: int = 60, each: int = 500_000) -> DataFrame:
    """(id, component): the smallest id reachable over ``edges`` (a, b), for every id in them.

    A round replaces the edges of each task (about ``each`` of them, dealt out by the hash of
    the edge, so a hot node is spread) by those from every node to the least one reachable there. Where
    one task holds all, that is the result; else alternating large-star and small-star steps
    hang the neighbours of a node on the smallest one known, by grouped minima (partial sums
    before the shuffle) and joins. Every round is written to the shared folder; nothing is gathered on the driver. It ends
    when a round changes nothing; if ``most_rounds`` don't get there, it raises.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            ids, least = least_reachable(table["a"].to_numpy(), table["b"].to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(least), pa.array(ids)], ["a", "b"])

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            e = e.union(e.select("b", "a")).toDF("u", "v")
        else:
            e = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = e.join(least, "u")
        kept = joined.filter("v > u") if large else joined
        out = kept.select(F.col("v").alias("a"), F.col("m").alias("b"))
        if not large:
            out = out.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def print_of(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    now, made = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b"), None
    seen = None
    for _ in range(most_rounds):
        size, edge_print = print_of(now)
        if seen == (size, edge_print):
            break
        seen = (size, edge_print)
        parts = max(1, -(-size // each))
        if parts == 1:
            out = stored(now.coalesce(1).mapInArrow(local, "a long, b long"), "members")
            if made is not None:
                discard(made)
            members = out.select(F.col("b").alias("id"), F.col("a").alias("component"))
            members.stored_path = out.stored_path
            return members
        shorter = now.repartition(parts, "a", "b").mapInArrow(local, "a long, b long").filter("a <> b")
        old, made = made, stored(star(star(shorter, True), False), "edges")
        if old is not None:
            discard(old)
        now = made
    else:
        raise RuntimeError(f"components have not converged after {most_rounds} rounds")
    members = now.select(F.col("b").alias("id"), F.col("a").alias("component"))
    members = members.union(now.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
    members.stored_path = now.stored_path
    return members


def add_blocks(rows: DataFrame, blocks: int) -> np.ndarray:
    """The sum of arrays of int64 that tasks sent as rows (block, cells), as float64.

    The blocks are added up in ``blocks`` tasks that hold one sum each; the
    driver receives one row of fixed size per block, whatever the input.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                one = np.frombuffer(v.as_buffer(), np.int64)
                total[k] = total[k] + one if k in total else one
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["block", "cells"]
        )

    found = rows.select("block", "cells").repartition(blocks, "block").mapInArrow(add, "block int, cells binary").collect()
    out = [np.frombuffer(r["cells"], np.int64) for r in sorted(found, key=lambda r: r["block"])]
    return np.concatenate(out).astype(np.float64) if out else np.zeros(0)


def as_blocks(cells: np.ndarray, blocks: int) -> pa.RecordBatch:
    """The rows (block, cells) for ``add_blocks``."""
    parts = np.array_split(cells.astype(np.int64), blocks)
    return pa.RecordBatch.from_arrays(
        [pa.array(range(blocks), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["block", "cells"]
    )
