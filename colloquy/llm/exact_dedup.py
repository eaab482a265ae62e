"""Exact dedup as a stateful stream whose keyed state is on disk and never expires.

A stream over the files of a table keeps, in RocksDB and for every digest of a text, the row that stays (the largest id), its
locator (file and row) and the number of rows; a batch adds to it by partial aggregates, so only digests, ids and locators are
exchanged and a text that a third of all rows hold is one row for each task. Checkpoint and state lie in a folder of
the caller: a further call goes on where the last one stopped and reads new files only.

The bytes of hits are checked: rows whose digest the state counts more than once are grouped by digest and whole text. A
bitmap of fixed size keeps other texts out of that exchange, copies in one task meet before it. Should two
texts share a digest, their rows are told apart by the texts themselves. Rows that the state missed or counted twice raise.

Defined cases: a null text is empty; a null id counts as the largest and is shown as null; of rows that share text and id, the last
by file and row stays, one row of each group; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MAX_ID, bits_for, id_key, members_of, shared_path, stored

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each of many small stores takes 4 MB of disk at once
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}
LOG = "digest string, stays struct<key: long, file: string, at: long>, n long"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session with these settings; a stream keeps those that hold when it starts."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def watchable(spark: SparkSession, path: str) -> str:
    """A path that a stream can read: that of a single file becomes a pattern that only this file matches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    one = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile()
    return f"{path[:-1]}[{path[-1]}]" if one else path


def digested(rows: DataFrame, id_column: str, text_column: str, digest: Callable[[Column], Column]) -> DataFrame:
    """(key, file, at, digest, text) of rows read from files."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    # A path is written with one slash or three, by who reads it.
    file = F.regexp_replace("_metadata.file_path", "^file:/+", "file:/")
    return rows.select(id_key(id_column).alias("key"), file.alias("file"), F.col("_metadata.row_index").alias("at"), digest(text).alias("digest"), text.alias("text"))


def take_in(spark: SparkSession, path: str, home: str, files_each: int | None = None, id_column: str = "doc_id", text_column: str = "text", digest=sha256) -> DataFrame:
    """Feeds files that the state in ``home`` hasn't seen, ``files_each`` in a batch (two for each core); (digest, stays, n) of every digest."""
    schema = spark.read.parquet(path).schema
    files_each = files_each or 2 * spark.sparkContext.defaultParallelism
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(watchable(spark, path))
    groups = (
        digested(source, id_column, text_column, digest).groupBy("digest")
        .agg(F.max(F.struct("key", "file", "at")).alias("stays"), F.count("*").alias("n"))
    )
    log = f"{home}/groups"
    spark.createDataFrame([], LOG).write.mode("ignore").parquet(f"{log}/batch=-1")
    with settings(spark, STATE):
        query = (
            # A batch that is run again replaces what it wrote.
            groups.writeStream.foreachBatch(lambda df, b: df.write.mode("overwrite").parquet(f"{log}/batch={b}"))
            .outputMode("update").option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    seen = spark.read.schema(f"{LOG}, batch long").parquet(log)
    return seen.groupBy("digest").agg(F.max_by(F.struct("stays", "n"), "batch").alias("g")).select("digest", "g.stays", "g.n")


def exact_dedup(
    spark: SparkSession, path: str, home: str, files_each: int | None = None, id_column: str = "doc_id", text_column: str = "text", digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """(key, file, at, digest, stays, n): every row of the files at ``path`` with the row that stays of its group and the group's size."""
    groups = stored(take_in(spark, path, home, files_each, id_column, text_column, digest), "groups")
    rows = digested(spark.read.parquet(path), id_column, text_column, digest)
    hits = groups.filter("n > 1").select("digest", "n", F.xxhash64("digest").alias("h"))
    maybe = members_of(rows.select(F.xxhash64("digest").alias("h"), "digest", "text"), "h", hits, bits_for(rows, 16, 24))
    texts = maybe.groupBy("digest", "text").agg(F.count("*").alias("same"))
    # Digests of one row that the bitmap let through have one text and are no hits.
    checked = stored(texts.groupBy("digest").agg(F.count("*").alias("texts"), F.sum("same").alias("rows")).filter("rows > 1"), "checked")
    wrong = checked.join(hits, "digest", "full").filter(~F.col("rows").eqNullSafe(F.col("n"))).limit(1).count()
    if wrong:
        raise RuntimeError(f"the state in {home} doesn't count the rows of {path}: files were changed or taken away since they were read")
    slim = rows.drop("text")
    if not checked.filter("texts > 1").limit(1).count():
        return slim.join(groups, "digest").select("key", "file", "at", "digest", "stays", "n")
    shared = checked.filter("texts > 1").select("digest")
    apart = rows.join(shared, "digest")
    kept = apart.groupBy("digest", "text").agg(F.max(F.struct("key", "file", "at")).alias("stays"), F.count("*").alias("n"))
    own = slim.join(shared, "digest", "left_anti").join(groups, "digest")
    return own.select("key", "file", "at", "digest", "stays", "n").unionByName(apart.join(kept, ["digest", "text"]).drop("text"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(spark, f"{sf_dir}/documents.parquet", shared_path(spark, "exact"))
    shown = lambda key: F.when(key < MAX_ID, key)
    return out.select(
        shown(F.col("key")).alias("doc_id"), shown(F.col("stays.key")).alias("keep_id"), F.col("n").alias("group_size"),
        (F.struct("key", "file", "at") == F.col("stays")).alias("kept"), F.col("digest").alias("text_sha256"),
    )


OP11_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
