"""Rows seen for the first time, against a kept history of keys: batches, or the micro batches of a stream.

The history is a table of key digests in ``parts`` parts by hash, one generation for each batch, with a Bloom filter per part and generation beside
it. A batch keeps its first row of each key, asks the filters (a task holds those of one part at a time), and only keys that some filter may
know meet the exact table, in an anti join. What is new becomes a generation. After every ``every`` batches the generations are merged into one.

A batch that is run again replaces its own generation and gives the same rows, since it only looks at older ones; a merge takes in batches
before the present one alone, and is there once its folder is. Filters never change a result: one that is too full sends more keys to the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .relate import first_of

PARTS, EVERY = 64, 8
#: Bits of a filter for each key, the most of one filter, and bits set by a key.
PER_KEY, MOST_BITS, HASHES = 16, 1 << 26, 7
KEYS = "key string, h1 long, h2 long, part int"


def bits_of(h1: np.ndarray, h2: np.ndarray, size: int) -> np.ndarray:
    """The bits of each key in a filter of ``size`` bits (a power of 2), a row for each key."""
    steps = np.arange(HASHES, dtype=np.uint64)
    return ((h1.astype(np.uint64)[:, None] + steps * (h2.astype(np.uint64) | np.uint64(1))[:, None]) & np.uint64(size - 1)).astype(np.int64)


class KeyHistory:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], parts: int = PARTS, every: int = EVERY):
        self.spark, self.path, self.keys, self.parts, self.every = spark, path.rstrip("/"), keys, parts, every

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _drop(self, path: str) -> None:
        system, p = self._fs(path)
        system.delete(p, True)

    def generations(self) -> list[tuple[int, int]]:
        """(first batch, last batch) of each whole generation that counts: those that a merge has taken in don't."""
        system, p = self._fs(self.path)
        names = [s.getPath().getName() for s in system.listStatus(p)] if system.exists(p) else []
        whole = sorted(tuple(map(int, n.removeprefix("gen=").split("-"))) for n in names if n.startswith("gen=") and self._whole(n))
        return [g for g in whole if not any(o != g and o[0] <= g[0] and g[1] <= o[1] for o in whole)]

    def _whole(self, name: str) -> bool:
        system, p = self._fs(f"{self.path}/{name}/filters/_SUCCESS")
        return system.exists(p)

    def _folder(self, g: tuple[int, int]) -> str:
        return f"{self.path}/gen={g[0]}-{g[1]}"

    def keyed(self, df: DataFrame) -> DataFrame:
        """The rows with key (a digest of the key columns, missing values included), h1, h2 and part."""
        key = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in self.keys]), {"ignoreNullFields": "false"}), 256)
        return df.withColumn("key", key).withColumns({"h1": F.xxhash64("key"), "h2": F.xxhash64("key", F.lit(1))}).withColumn("part", F.pmod("h1", F.lit(self.parts)).cast("int"))

    def _write(self, keys: DataFrame, g: tuple[int, int]) -> None:
        """A generation: its keys by part, then a filter for each part; the filters' mark of success makes it whole."""
        folder = self._folder(g)
        self._drop(folder)
        keys.select("key", "h1", "h2", "part").repartition(self.parts, "part").sortWithinPartitions("part", "key").write.parquet(f"{folder}/keys")
        kept = self.spark.read.schema(KEYS).parquet(f"{folder}/keys")
        largest = kept.groupBy("part").count().agg(F.max("count")).first()[0] or 1
        size = min(MOST_BITS, 1 << max(10, int(largest * PER_KEY - 1).bit_length()))

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, cells = None, np.zeros(size, bool)

            def done() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(cells).tobytes()], pa.binary())], ["part", "filter"])

            for batch in batches:
                part = batch.column(2).to_numpy()
                for p in np.unique(part).tolist():  # rows come by part
                    if p != now:
                        if now is not None:
                            yield done()
                        now, cells = p, np.zeros(size, bool)
                    own = part == p
                    cells[bits_of(batch.column(0).to_numpy()[own], batch.column(1).to_numpy()[own], size).ravel()] = True
            if now is not None:
                yield done()

        # The whole of a part in order: a file may be read in pieces.
        by_part = kept.select("h1", "h2", "part").repartition(self.parts, "part").sortWithinPartitions("part")
        by_part.mapInArrow(build, "part int, filter binary").write.parquet(f"{folder}/filters")

    def maybe_known(self, keys: DataFrame, generations: list[tuple[int, int]]) -> DataFrame:
        """keys (key, h1, h2, part) with ``maybe``: whether the filter of its part in some generation may know it."""
        folders = [f"{self._folder(g)}/filters" for g in generations]

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, filters = None, []
            for batch in batches:
                part, maybe = batch.column(3).to_numpy(), np.zeros(batch.num_rows, bool)
                for p in np.unique(part).tolist():
                    if p != now:
                        now, filters = p, []
                        for f in folders:
                            system, at = fs.FileSystem.from_uri(f if "://" in f else "file://" + f.removeprefix("file:"))
                            got = pq.read_table(at, filesystem=system, columns=["filter"], filters=[("part", "=", p)])
                            filters += [np.frombuffer(x.as_buffer(), np.uint8) for x in got["filter"]]
                    own = np.flatnonzero(part == p)
                    h1, h2 = batch.column(1).to_numpy()[own], batch.column(2).to_numpy()[own]
                    for bits in filters:
                        at = bits_of(h1, h2, len(bits) * 8)
                        maybe[own] |= ((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(maybe)], [*batch.schema.names, "maybe"])

        by_part = keys.select("key", "h1", "h2", "part").repartition(self.parts, "part").sortWithinPartitions("part")
        return by_part.mapInArrow(ask, f"{KEYS}, maybe boolean")

    def take(self, df: DataFrame, batch: int, order: list | None = None) -> DataFrame:
        """The rows of ``df`` whose keys no earlier batch had, one for each key (the first in ``order``, then by all columns); the history then knows them."""
        older = [g for g in self.generations() if g[1] < batch]
        if len(older) >= self.every:
            older = [self.merge(older)]
        firsts = first_of(self.keyed(df), ["key"], order or [])
        here = f"{self.path}/rows/batch={batch}"
        self._drop(here)
        firsts.write.parquet(f"{here}/first")
        firsts = self.spark.read.schema(firsts.schema).parquet(f"{here}/first")
        if older:
            asked = self.maybe_known(firsts, older)
            asked.write.parquet(f"{here}/asked")
            asked = self.spark.read.schema(asked.schema).parquet(f"{here}/asked")
            known = self.spark.read.schema(KEYS).parquet(*[f"{self._folder(g)}/keys" for g in older])
            seen = asked.filter("maybe").join(known.select("part", "key"), ["part", "key"], "left_semi").select("key")
            fresh = firsts.join(seen, "key", "left_anti")
        else:
            fresh = firsts
        fresh.write.parquet(f"{here}/fresh")
        fresh = self.spark.read.schema(firsts.schema).parquet(f"{here}/fresh")
        self._write(fresh, (batch, batch))
        return fresh.drop("key", "h1", "h2", "part")

    def merge(self, generations: list[tuple[int, int]]) -> tuple[int, int]:
        """One generation of several; the old ones go once it is whole."""
        g = (generations[0][0], generations[-1][1])
        self._write(self.spark.read.schema(KEYS).parquet(*[f"{self._folder(o)}/keys" for o in generations]), g)
        for o in generations:
            if o != g:
                self._drop(self._folder(o))
        return g


def first_seen(stream: DataFrame, keys: list[str], history: str, out: str, checkpoint: str, order: list | None = None, every: int = EVERY) -> StreamingQuery:
    """A stream's rows with keys that it hasn't had before, written to ``out``, whatever time lies between; all that is there is read, then it stops."""
    def write(df: DataFrame, batch: int) -> None:
        KeyHistory(df.sparkSession, history, keys, every=every).take(df, batch, order).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
