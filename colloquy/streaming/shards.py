"""A sink of shards of a fixed number of rows that go on from one micro batch to the next, each row once.

A shard that a batch leaves unfinished is taken up by the next one, so all shards but the last hold exactly ``rows`` rows. What a batch
did is told by its manifest, a file that appears whole under its final name: the files it added, the unfinished one
that it replaced, and where the next batch goes on (so that one looks at one manifest, however many there are). A batch whose manifest is there has been written and isn't written again, whether its offsets were committed or not; one that broke off
before has left files that no manifest names, which are not read and are removed when it is run again. The columns of the
first batch are kept; later batches are put in their order and types, missing ones null and further ones left out.

Rows are numbered over all tasks (places in a task's file, and sums of these), so no task sees more than a shard.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..sources.writers import write_text

#: Rows of a shard.
ROWS = 30_000
MANIFEST = "batch long, added array<struct<shard: long, rows: long, path: string>>, replaced array<string>, tail struct<shard: long, rows: long, path: string>, next long"


class RollingShards:
    def __init__(self, spark: SparkSession, path: str, rows: int = ROWS):
        self.spark, self.path, self.rows = spark, path.rstrip("/"), rows

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def _read(self, path: str) -> str:
        return "\n".join(r[0] for r in self.spark.read.option("wholetext", "true").text(path).collect())

    def manifests(self) -> DataFrame:
        """What each batch did, a row per batch."""
        if not self._exists(f"{self.path}/manifest"):
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).json(f"{self.path}/manifest/*.json")

    def schema(self) -> StructType | None:
        at = f"{self.path}/schema.json"
        return StructType.fromJson(json.loads(self._read(at))) if self._exists(at) else None

    def _pinned(self, df: DataFrame) -> DataFrame:
        schema = self.schema()
        if schema is None:
            write_text(self.spark, df.schema.json(), f"{self.path}/schema.json")
            return df
        have = {c.lower() for c in df.columns}
        return df.select(*[(F.col(f"`{f.name}`") if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])

    def _last(self, batch: int) -> tuple[int, dict | None]:
        """(number of the next shard, the unfinished one), as the manifest before ``batch`` tells; only where batches were left out are all looked at."""
        at = f"{self.path}/manifest/{batch - 1:020d}.json"
        if self._exists(at):
            told = json.loads(self._read(at))
            return told["next"], told["tail"]
        last = self.manifests().filter(F.col("batch") < batch).orderBy(F.desc("batch")).select("next", "tail").first()
        return (0, None) if last is None else (last["next"], last["tail"].asDict() if last["tail"] else None)

    def _commit(self, batch: int, added: list[dict], replaced: list[str], next_: int, tail: dict | None) -> None:
        one = {"batch": batch, "added": added, "replaced": replaced, "tail": tail, "next": next_}
        write_text(self.spark, json.dumps(one), f"{self.path}/manifest/{batch:020d}.json")

    def write(self, df: DataFrame, batch: int) -> bool:
        """Writes a batch unless its manifest says that it is there; whether it was written."""
        if self._exists(f"{self.path}/manifest/{batch:020d}.json"):
            return False
        data, staged = f"{self.path}/data/batch={batch}", f"{self.path}/staged/batch={batch}"
        for left in (data, staged):  # by a run that broke off
            fs, p = self._fs(left)
            fs.delete(p, True)
        first, unfinished = self._last(batch)
        names = self._pinned(df).columns
        # Staged first: rows are numbered and read once more, and a source may give them in another order then.
        placed = self._pinned(df).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
        placed.write.parquet(staged)
        placed = self.spark.read.schema(placed.schema).parquet(staged)
        base = unfinished["rows"] if unfinished else 0
        before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        starts = placed.groupBy("_part").agg(F.count("*").alias("n")).select("_part", (before + base).alias("_start"))  # a row for each task of the batch
        numbered = placed.join(starts, "_part").withColumn("_n", F.col("_start") + F.col("_at"))
        numbered = numbered.select((F.floor(F.col("_n") / self.rows) + first).alias("shard"), "_n", *[F.col(f"`{c}`") for c in names])
        if unfinished:
            old = self.spark.read.schema(self.schema()).parquet(unfinished["path"])
            old = old.select(F.lit(first).cast("long").alias("shard"), F.col("_metadata.row_index").alias("_n"), *[F.col(f"`{c}`") for c in names])
            touched = placed.limit(1).count()
            numbered = numbered.unionByName(old) if touched else numbered
        out = numbered.repartition("shard").sortWithinPartitions("shard", "_n").drop("_n")
        out.write.partitionBy("shard").option("compression", "snappy").option("maxRecordsPerFile", 0).parquet(data)
        kept = self.spark.read.option("basePath", data).schema(f"shard long, {', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in self.schema())}").parquet(data)
        files = kept.groupBy("shard", F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("rows")).orderBy("shard").collect()  # a row per shard of the batch
        added = [{"shard": r["shard"], "rows": r["rows"], "path": r["path"]} for r in files]
        replaced = [unfinished["path"]] if unfinished and any(a["shard"] == first for a in added) else []
        if added:
            top = added[-1]
            tail = top if top["rows"] < self.rows else None
            self._commit(batch, added, replaced, top["shard"] + (tail is None), tail)
        else:
            self._commit(batch, [], [], first, unfinished)
        fs, p = self._fs(staged)
        fs.delete(p, True)
        for path in replaced:
            fs, p = self._fs(path)
            fs.delete(p, False)
        return True

    def close(self, batch: int) -> None:
        """The unfinished shard is left as it is; the next batch begins another one."""
        if not self._exists(f"{self.path}/manifest/{batch:020d}.json"):
            next_, unfinished = self._last(batch)
            self._commit(batch, [], [], next_ + (unfinished is not None), None)

    def shards(self) -> DataFrame:
        """(shard, rows, path) of what is there."""
        m = self.manifests()
        gone = m.select(F.explode("replaced").alias("path"))
        return m.select(F.explode("added").alias("a")).select("a.shard", "a.rows", "a.path").join(gone, "path", "left_anti").select("shard", "rows", "path")

    def read(self) -> DataFrame:
        """All rows that were written."""
        schema, paths = self.schema(), [r["path"] for r in self.shards().orderBy("shard").collect()]
        if schema is None:
            raise FileNotFoundError(f"nothing has been written to {self.path}")
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)


def rolling(stream: DataFrame, path: str, checkpoint: str, rows: int = ROWS) -> StreamingQuery:
    """Shards of a stream; all that is there is read, then it stops. A later call goes on from the checkpoint."""
    def write(df: DataFrame, batch: int) -> None:
        RollingShards(df.sparkSession, path, rows).write(df, batch)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{checkpoint}/offsets-{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}").trigger(availableNow=True).start()
