"""Structured Streaming over landed transcript files."""

from __future__ import annotations

import logging
import time
from collections import Counter, defaultdict
from collections.abc import Callable
from threading import Event

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from .shards import ROWS, rolling


def landed(spark: SparkSession, path: str, schema: T.StructType, files_each: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(path)


def without_repeats(stream: DataFrame, keys: list[str], time: str, late: str = "1 day") -> DataFrame:
    """Each key once within the watermark, so the state stays bounded."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def window_counts(stream: DataFrame, time: str, by: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def to_shards(stream: DataFrame, path: str, checkpoint: str, rows: int = ROWS) -> StreamingQuery:
    """Rolling shards from micro batches (see ``shards``), each row once; all that is there is read, then it stops."""
    return rolling(stream, path, checkpoint, rows)


class RowsRead(StreamingQueryListener):
    """Input rows of each run of a query, however many batches it has."""

    def __init__(self):
        self.rows, self.ended = Counter(), defaultdict(Event)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.rows[str(event.progress.runId)] += event.progress.numInputRows

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended[str(event.runId)].set()

    def of(self, query: StreamingQuery, patience: float = 60.0) -> int:
        """All rows of a run that has ended; its last event follows those of its batches."""
        run = str(query.runId)
        if not self.ended[run].wait(patience):
            raise TimeoutError(f"the run {run} has not told its end")
        return self.rows[run]


def until_idle(start: Callable[[], StreamingQuery], idle: int = 3, wait: float = 1.0, most: int | None = None, spark: SparkSession | None = None) -> int:
    """Starts a query that reads what is there, again and again, until ``idle`` runs in a row bring nothing (or ``most`` runs are done); all rows read.

    A run that fails counts as one that brings nothing; its rows are read by the next one, from the checkpoint.
    """
    total, empty, runs, read = 0, 0, 0, RowsRead()
    # Listeners hear the queries of their own session; within a batch another one is active.
    streams = (spark or SparkSession.builder.getOrCreate()).streams
    streams.addListener(read)
    while empty < idle and (most is None or runs < most):
        runs += 1
        try:
            query = start()
            query.awaitTermination()
            got = read.of(query)
        except StreamingQueryException as e:
            logging.getLogger(__name__).error("run %s failed: %s", runs, str(e).splitlines()[0])
            got = 0
        total, empty = total + got, 0 if got else empty + 1
        if empty < idle and wait:
            time.sleep(wait)
    streams.removeListener(read)
    return total
