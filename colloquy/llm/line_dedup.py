"""Line dedup over levelled sorted runs of line hashes. DataFrame and SQL functions only.

Documents arrive in batches of ascending id: two of about ``BATCH`` documents, then each as large as all before it, so
that n documents are 2 + log2(n / BATCH) rounds, and the last is half of them. The state is a set of runs: tables
bucketed by the line hash and sorted by it inside each bucket, so a batch
merge-joins them without a new exchange or sort of the state. A batch's new
keys (those in no run) become a run of level 0; ``fanout`` runs of one level
are merged into one of the next. Runs never share a key.

Defined cases: a null or empty text is one empty line; a null id counts as the
largest id; rows that share an id are parts of one document, each with its own
result row, and stand in one batch; an empty table gives no row; extra columns are
ignored. What a batch leaves is its places to drop; its lines and keys are deleted once its run is there, the runs at the end. Keys are compared by two independent
64-bit hashes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, documents, drop_folder, shared_path, stored, with_part

#: Documents of the first batch.
BATCH = 100_000
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without white space at its ends and with A-Z (only these) lower-cased."""
    cut = F.btrim(line, F.lit(SPACES))
    return F.when(F.octet_length(cut) == F.length(cut), F.lower(cut)).otherwise(F.translate(cut, UPPER, LOWER))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class SortedRuns:
    """Runs of (h1, h2) by level, kept as bucketed and sorted tables in the warehouse."""

    def __init__(self, spark, buckets: int, fanout: int = 3):
        self.spark, self.buckets, self.fanout = spark, buckets, fanout
        self.prefix, self.made = f"line_runs_{uuid.uuid4().hex[:12]}", 0
        self.levels: list[list[str]] = []

    def tables(self) -> list[DataFrame]:
        return [self.spark.table(t) for level in self.levels for t in level]

    def _write(self, keys: DataFrame) -> str:
        name = f"{self.prefix}_{self.made}"
        self.made += 1
        (
            keys.select("h1", "h2").repartition(self.buckets, "h1").write.format("parquet")
            .bucketBy(self.buckets, "h1").sortBy("h1").saveAsTable(name)
        )
        return name

    def add(self, keys: DataFrame, level: int = 0) -> None:
        """Add a run of keys that are in no other run. Merges full levels."""
        name = self._write(keys)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            old = self.levels[level]
            merged = self.spark.table(old[0])
            for t in old[1:]:
                merged = merged.unionByName(self.spark.table(t))
            self.levels[level] = []
            self.add(merged, level + 1)
            for t in old:
                self.spark.sql(f"DROP TABLE {t}")

    def drop(self) -> None:
        for t in [t for level in self.levels for t in level]:
            self.spark.sql(f"DROP TABLE {t}")
        self.levels = []

    def without(self, keys: DataFrame) -> DataFrame:
        """The keys that no run holds: a merge anti join with each run."""
        for run in self.tables():
            keys = keys.join(run.hint("merge"), ["h1", "h2"], "left_anti")
        return keys


def batch_ends(rows: int, first: int) -> list[float]:
    """The shares of all rows at which batches end, but for the last: two of ``first`` rows, then each as large as all before it."""
    ends, end = [], first
    while end < rows:
        ends.append(end / rows)
        end *= 2
    return ends


def line_dedup(docs: DataFrame, min_chars: int = 10, batch: int = BATCH, fanout: int = 2) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text): each document with its repeated lines dropped.

    A line whose key has ``min_chars`` code points or more and is found in two
    documents or more stays only in the smallest id that holds it. ``batch``
    only sets how much is handled at once; the result doesn't depend on it.
    """
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = with_part(docs)
    shares = batch_ends(rows.count(), batch)
    accuracy = int(min(1_000_000, max(1_000, 100 / min(shares, default=1.0))))
    cuts = sorted(set(rows.select(F.percentile_approx("key", shares, accuracy)).first()[0] or [])) if shares else []
    number = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("key"))) if cuts else F.lit(0)
    key = line_key(F.col("line"))
    hashed = (
        rows.select("key", "part", number.alias("batch"), F.posexplode_outer(lines_of(F.col("text"))).alias("at", "line"))  # never empty; outer, so that Catalyst adds no filter that splits twice
        .select("batch", "key", "part", "at", key.alias("k"))
        .filter(F.length("k") >= min_chars)
        .select("batch", "key", "part", "at", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit("line"), "k").alias("h2"))
    )
    hashed = stored(hashed, "lines", "batch")
    runs, dropped = SortedRuns(spark, buckets, fanout), shared_path(spark, "drops")
    for b in range(len(cuts) + 1):
        found = hashed.filter(F.col("batch") == b).select("key", "part", "at", "h1", "h2")
        firsts = found.groupBy("h1", "h2").agg(F.min("key").alias("holder"), F.max("key").alias("last"))
        made = []
        if runs.tables():
            firsts = stored(firsts, "firsts")
            fresh = stored(runs.without(firsts), "fresh")
            made += [firsts, fresh]
            old = firsts.join(fresh.select("h1", "h2"), ["h1", "h2"], "left_anti").select(
                "h1", "h2", F.lit(None).cast("long").alias("holder")
            )
        else:
            fresh, old = stored(firsts, "fresh"), None
            made.append(fresh)
        if b < len(cuts):
            runs.add(fresh)
        losing = fresh.filter("last > holder").select("h1", "h2", "holder")
        losing = losing.unionByName(old) if old is not None else losing
        lost = (
            found.join(losing, ["h1", "h2"])
            .filter("holder IS NULL OR key > holder")
            .groupBy("key", "part")
            .agg(F.collect_list("at").alias("lost"))
        )
        lost.write.parquet(f"{dropped}/batch={b}")
        discard(*made)
        drop_folder(spark, f"{hashed.stored_path}/batch={b}")
    drops = spark.read.schema(lost.schema).parquet(dropped)
    runs.drop()
    discard(hashed)
    lines = lines_of(F.col("text"))
    return (
        rows.join(drops.hint("merge"), ["key", "part"], "left")
        .withColumn("_lines", lines)
        .select(
            F.when(F.col("key") < (1 << 63) - 1, F.col("key")).alias("doc_id"),
            F.size("_lines").cast("long").alias("n_lines"),
            F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped"),
            F.when(F.col("lost").isNull(), F.coalesce("text", F.lit("")))
            .otherwise(
                F.array_join(
                    F.transform(
                        F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("lost")),
                        lambda i: F.get(F.col("_lines"), i),
                    ),
                    "\n",
                )
            )
            .alias("text"),
        )
    )


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = line_dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), holders AS (
  SELECT k, min(doc_id) AS holder FROM keyed WHERE length(k) >= 10 GROUP BY k
), judged AS (
  SELECT d.doc_id, d.pos, d.line, (length(d.k) >= 10 AND d.doc_id > h.holder) AS lost
  FROM keyed d LEFT JOIN holders h ON d.k = h.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE coalesce(lost, false)) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT coalesce(lost, false)), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
