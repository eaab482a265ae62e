"""Frames by row position over keys of any number of rows: each key is cut into buckets of rows with a halo of their neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Own rows of a bucket.
ROWS = 4_096


def numbered(df: DataFrame, by: str, date: str) -> DataFrame:
    """``df`` with ``_n``, the place of each row within its key by date, from 0.

    Rows are counted by key and month (added up before their exchange) and these counts summed along the key; then rows are numbered within
    a month. So no task holds more of a key than a month.
    """
    month = F.trunc(F.col(date), "MM")
    counts = df.groupBy(F.col(by).alias("_k"), month.alias("_m")).agg(F.count("*").alias("_c"))
    earlier = Window.partitionBy("_k").orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_k", "_m", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_start"))
    rows = df.withColumn("_month", month)
    joined = rows.join(starts, F.col(by).eqNullSafe(F.col("_k")) & F.col("_month").eqNullSafe(F.col("_m")))
    within = F.row_number().over(Window.partitionBy("_k", "_m").orderBy(date)) - 1
    return joined.withColumn("_n", F.col("_start") + within).drop("_k", "_m", "_start", "_month")


def with_halo(df: DataFrame, by: str, date: str, before: int, after: int, rows: int = ROWS) -> DataFrame:
    """``df`` with ``_bucket`` and ``_own``: each row in the bucket of its place and, not its own, in those whose rows look at it.

    Windows by key and bucket that reach ``before`` rows back and ``after`` ahead see the same rows for own rows as windows by key do. A
    bucket has ``rows`` own rows, so a key that holds most of all rows is spread over many tasks, at a cost of (before + after) / rows more rows.
    The rows of a key that fits into one bucket go there as they are; those of the others are counted and numbered first.
    """
    if rows < 1 or min(before, after) < 0:
        raise ValueError("a bucket has a row at least, and a halo isn't negative")
    # Keys of more rows than a bucket, one at most for each ``rows`` rows of ``df``: 50,000 of 200 million.
    large = F.broadcast(df.groupBy(F.col(by).alias("_large")).count().filter(F.col("count") > rows).select("_large"))
    is_large = F.col(by).eqNullSafe(F.col("_large"))
    small = df.join(large, is_large, "left_anti").withColumn("_bucket", F.lit(0).cast("long")).withColumn("_own", F.lit(True))
    placed = numbered(df.join(large, is_large, "left_semi"), by, date)
    first, last = F.floor(F.greatest(F.lit(0), F.col("_n") - after) / rows), F.floor((F.col("_n") + before) / rows)
    spread = placed.withColumn("_bucket", F.explode(F.sequence(first, last)))
    return small.unionByName(spread.withColumn("_own", F.col("_bucket") == F.floor(F.col("_n") / rows)).drop("_n"))
