"""Registered queries that ingest: captures of pages, shards of a stream, windows of a page table. Each call works in a new folder of the shared one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.history import KeyHistory
from ..session import settings, work_folder
from ..sources import windows
from ..streaming import readiness
from ..streaming.shards import RollingShards, rolling
from .catalogue import query, table


def captures(pages: DataFrame) -> DataFrame:
    """Captures of pages of five kinds, by id: there at once after a placeholder; short and changing, then the same; never; changing all the time; too late."""
    url = F.coalesce("url", F.lit(""))
    cut, long = (lambda n: F.substring(url, 1, n)), F.repeat(F.concat(url, F.lit(" ")), 20)
    wait = F.lit("Your document is on its way...")

    def at(second: int, body) -> F.Column:
        return F.struct(F.lit(second).alias("s"), body.alias("body"))

    kinds = [[at(0, wait), at(5, long)], [at(0, cut(9)), at(4, cut(12)), at(8, cut(12))], [at(0, wait), at(10, wait)], [at(0, cut(9)), at(20, cut(12))], [at(0, wait), at(50, long)]]
    shots = F.lit(None)
    for k, kind in enumerate(kinds):
        shots = F.when(F.pmod("page_id", F.lit(len(kinds))) == k, F.array(*kind)).otherwise(shots)
    first = F.lit("2024-01-01 00:00:00").cast("timestamp")
    out = pages.select("page_id", "url", F.explode(shots).alias("c"))
    return out.select(
        F.col("page_id").cast("string").alias("list_item"), F.timestamp_seconds(F.unix_seconds(first) + F.col("page_id") % 3600 + F.col("c.s")).alias("seen_at"),
        F.col("url").alias("title"), F.col("c.body").alias("body"),
    )


@query(r"""WITH p AS (SELECT page_id, coalesce(url, '') AS u, page_id % 5 AS k FROM pages)
SELECT page_id::VARCHAR AS list_item, CASE k WHEN 2 THEN 'blank' WHEN 4 THEN 'blank' WHEN 3 THEN 'late' ELSE 'ready' END AS status,
 CASE k WHEN 0 THEN trim(repeat(u || ' ', 20)) WHEN 2 THEN '' WHEN 4 THEN '' ELSE u[1:12] END AS body, (CASE WHEN k IN (2, 3, 4) THEN 3 ELSE 0 END)::INTEGER AS attempts FROM p""")
def page_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    home = work_folder(spark, "readiness")
    shots = captures(table(spark, sf_dir, "pages"))
    # Time goes on after the last page, so what never comes is given up.
    end = spark.createDataFrame([("", "2024-01-02 00:00:00", "", "")], shots.columns).withColumn("seen_at", F.col("seen_at").cast("timestamp"))
    shots.unionByName(end).write.parquet(f"{home}/landed")
    with settings(spark, readiness.ROCKS):
        stream = spark.readStream.schema(shots.schema).parquet(f"{home}/landed")
        pages = readiness.ready_pages(stream)
        pages.writeStream.format("parquet").option("path", f"{home}/pages").option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(readiness.OUT).parquet(f"{home}/pages").select("list_item", "status", "body", "attempts")


@query("SELECT conv_id, turn, role, md5(coalesce(text, '')) AS text_md5, (SELECT ceil(count(*) / 300.0) FROM conversations)::BIGINT AS n_shards FROM conversations")
def rolling_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns through a stream of several batches into shards of 300 rows, read back from them."""
    home = work_folder(spark, "shards")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns.repartition(12, "conv_id").write.parquet(f"{home}/landed")
    stream = spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 4).parquet(f"{home}/landed")
    rolling(stream, f"{home}/out", f"{home}/state", 300).awaitTermination()
    sink = RollingShards(spark, f"{home}/out", 300)
    return sink.read().select("conv_id", "turn", "role", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"), F.lit(sink.shards().count()).cast("long").alias("n_shards"))


@query("""SELECT DATE '2024-01-01' + ((page_id % 90) // 7 * 7)::INTEGER AS window_start, least(DATE '2024-03-30', DATE '2024-01-01' + ((page_id % 90) // 7 * 7 + 6)::INTEGER) AS window_end,
 page_id, url, length(html) AS n_chars, DATE '2024-01-01' + (page_id % 90)::INTEGER AS date FROM pages""")
def windowed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by day, read by windows of a week through the data source."""
    home = work_folder(spark, "pages")
    dated = table(spark, sf_dir, "pages").select("page_id", "url", "html", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 90).cast("int")).alias("date"))
    windows.by_day(dated, home)
    spark.dataSource.register(windows.PageWindows)
    read = spark.read.format("page_windows").options(path=home, start="2024-01-01", end="2024-03-30", days="7").load()
    failed = read.filter("error IS NOT NULL").select("error").limit(1).collect()
    if failed:
        raise OSError(failed[0][0])
    return read.select("window_start", "window_end", "page_id", "url", F.length("html").alias("n_chars"), "date")


@query("""WITH b AS (SELECT doc_id, text, doc_id % 3 AS batch, row_number() OVER (PARTITION BY text ORDER BY doc_id % 3, doc_id) AS r FROM documents)
SELECT doc_id, batch::INTEGER AS batch FROM b WHERE r = 1""")
def history_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in three batches (by id); those whose text no earlier batch and no smaller id of their own batch had."""
    kept, docs, out = KeyHistory(spark, work_folder(spark, "history"), ["text"]), table(spark, sf_dir, "documents").select("doc_id", "text"), None
    for batch in range(3):
        new = kept.take(docs.filter(F.col("doc_id") % 3 == batch), batch, ["doc_id"]).select("doc_id", F.lit(batch).alias("batch"))
        out = new if out is None else out.unionByName(new)
    return out
