"""Captures of pages that are still loading: each page leaves once, when it is ready or given up.

A page is captured again and again until its text is there. Its state (last title and body, the last capture with a text of its own,
attempts) is kept by ``transformWithState`` in RocksDB, with event-time timers, so a replay of the same captures gives the same rows. A capture
is ready if its body is neither blank nor a placeholder, and is longer than 80 characters or the same as in the capture before. A page that
isn't ready within ``wait`` seconds has used up an attempt; after ``retries`` of them, counted from its first capture, it leaves with the last text of
its own, or blank.

Defined cases: captures without a key or time are left out; captures of a page are looked at in order of time (equal times by body) in blocks of
``BLOCK`` as they come, so a page with any number of captures needs no more memory; a page that has left is not looked at again for ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta
from itertools import islice

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import text as X

#: Signs beyond which a text counts as there, attempts, seconds of one.
LONG, RETRIES, WAIT = 80, 3, 15
FIELDS = ("title", "subheader", "transcript_subheader", "speakers", "body")
BLOCK = 1_000
OUT = "list_item string, " + ", ".join(f"{f} string" for f in FIELDS) + ", status string, attempts int"
PAGE = Row("list_item", *FIELDS, "status", "attempts")
ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true", "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


class Readiness(StatefulProcessor):
    def __init__(self, wait: float = WAIT, retries: int = RETRIES, keep: float = 86_400):
        self.wait, self.keep = (timedelta(seconds=x) // timedelta(milliseconds=1) for x in (wait, keep))
        self.retries = retries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.page = handle.getValueState("page", "done boolean, first long, before string, " + ", ".join(f"{f} string" for f in FIELDS))

    def _leave(self, key: tuple, fields: list, status: str, first: int, now: int) -> Row:
        """The row of a page; its state stays as a mark that it has left, until a timer clears it."""
        self.page.update((True, now, None, *[None] * len(FIELDS)))
        self.handle.registerTimer(now + self.keep)
        return PAGE(key[0], *(f or "" for f in fields), status, min(self.retries, (now - first) // self.wait))

    def _given_up(self, key: tuple, first: int, last: list) -> Row:
        status = "blank" if last[FIELDS.index("body")] is None else "late"
        return self._leave(key, last, status, first, first + self.retries * self.wait)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        done, first, before, *last = self.page.get() if self.page.exists() else (False, None, None, *[None] * len(FIELDS))
        while not done and (block := sorted(islice(rows, BLOCK), key=lambda r: (r.at, r.body))):
            for r in block:
                if first is None:
                    first = r.at
                    self.handle.registerTimer(first + self.retries * self.wait)
                if r.at >= first + self.retries * self.wait:  # its timer is due, whether it has been called or not
                    self.handle.deleteTimer(first + self.retries * self.wait)
                    yield self._given_up(key, first, last)
                    done = True
                    break
                if r.body and not r.waiting:
                    last = [r[f] for f in FIELDS]
                    if len(r.body) > LONG or r.body == before:
                        self.handle.deleteTimer(first + self.retries * self.wait)
                        yield self._leave(key, last, "ready", first, r.at)
                        done = True
                        break
                before = r.body
        if not done:
            self.page.update((False, first, before, *last))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if self.page.exists():
            done, first, _, *last = self.page.get()
            if done:
                self.page.clear()
            else:
                yield self._given_up(key, first, last)


def ready_pages(captures: DataFrame, key: str = "list_item", time: str = "seen_at", wait: float = WAIT, retries: int = RETRIES, late: str = "0 seconds", keep: float = 86_400) -> DataFrame:
    """A stream of captures (``key``, ``time`` and the five fields) to one row per page: list_item, the fields, status (ready, late or blank), attempts used up.

    The stream must be started with state in RocksDB (``with settings(spark, ROCKS)``). A page that is given up leaves once the time of
    other captures is past its last attempt.
    """
    known = captures.filter(F.col(key).isNotNull() & F.col(time).isNotNull()).withWatermark(time, late)
    have = set(captures.columns)
    fields = [X.clean_text(F.col(f) if f in have else F.lit(None).cast("string")).alias(f) for f in FIELDS]
    slim = known.select(F.col(key).cast("string").alias("page"), F.unix_millis(F.col(time).cast("timestamp")).alias("at"), F.col(time), *fields, X.is_placeholder(F.col("body")).alias("waiting"))
    return slim.groupBy("page").transformWithState(Readiness(wait, retries, keep), OUT, "append", "eventTime")
