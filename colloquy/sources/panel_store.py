"""A store of panels for as-of lookups: bucketed by key and span of days, so a lookup exchanges the asking side alone.

Each row of a panel holds from its date to the next one of its key (forward: from the one before). It is stored in every span of ``days``
that this time touches, up to a horizon, so the row that answers a date stands in the bucket of the date's own key and span. A lookup is one
join on both with the dates compared inside: no exchange of the store, no window over a key, and a key with half of all rows is spread
over its spans. ``shelf`` folders (by hash of the key) let a reader that asks for a few keys open a few folders.
"""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.frames import with_halo

DAYS, BUCKETS, SHELVES = 90, 16, 4
#: Columns of the store beside those of the panel.
OWN = ("_span", "_from", "_to", "shelf")


def shelf_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(SHELVES)).cast("int")


class PanelStore:
    def __init__(self, spark: SparkSession, table: str, by: str = "ticker_norm", date: str = "date", days: int = DAYS, forward: bool = False):
        self.spark, self.table, self.by, self.date, self.days, self.forward = spark, table, by, date, days, forward

    @classmethod
    def build(
        cls, panel: DataFrame, horizon: date, name: str | None = None, by: str = "ticker_norm", date: str = "date", days: int = DAYS, forward: bool = False, buckets: int = BUCKETS,
    ) -> PanelStore:
        """Writes a panel to the table ``name``. ``horizon`` is the last (forward: first) date that can be asked for.

        Rows without a key or date are left out; of rows of one key and date the last (forward: first) by all columns in order answers, as in ``relate.asof``.
        """
        clash = {c.lower() for c in OWN} & {c.lower() for c in panel.columns}
        if clash:
            raise ValueError(f"a panel can't have the columns {sorted(clash)}")
        store = cls(panel.sparkSession, name or f"panel_{uuid.uuid4().hex}", by, date, days, forward)
        rest = F.struct(*[F.col(f"`{c}`") for c in panel.columns if c not in (by, date)])
        best = (F.min if forward else F.max)(rest)
        known = panel.filter(F.col(by).isNotNull() & F.col(date).isNotNull()).withColumn(date, F.to_date(date))
        once = known.groupBy(by, date).agg(best.alias("_rest")) if len(panel.columns) > 2 else known.distinct().withColumn("_rest", F.struct(F.lit(None).alias("_none")))
        near = with_halo(once, by, date, 1, 1)
        w = Window.partitionBy(by, "_bucket").orderBy(date)
        if forward:
            near = near.withColumns({"_from": F.coalesce(F.date_add(F.lag(date).over(w), 1), F.least(F.lit(horizon), F.col(date))), "_to": F.col(date)})
        else:
            near = near.withColumns({"_from": F.col(date), "_to": F.coalesce(F.date_sub(F.lead(date).over(w), 1), F.greatest(F.lit(horizon), F.col(date)))})
        spans = F.explode(F.sequence(store.span(F.col("_from")), store.span(F.col("_to"))))
        columns = [F.col(by), F.col(date), *[F.col(f"_rest.`{c}`").alias(c) for c in panel.columns if c not in (by, date)]]
        rows = near.filter("_own").select(*columns, spans.alias("_span"), "_from", "_to", shelf_of(F.col(by)).alias("shelf"))
        (
            rows.repartition(buckets, by, "_span").write.format("parquet").partitionBy("shelf").bucketBy(buckets, by, "_span").sortBy(by, "_span", date).saveAsTable(store.table)
        )
        return store

    def span(self, day: Column) -> Column:
        return F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / self.days).cast("long")

    def read(self, keys: list | None = None) -> DataFrame:
        """The stored rows, of ``keys`` alone if given: only their shelves are opened."""
        out = self.spark.table(self.table)
        if keys is None:
            return out
        asked = self.spark.createDataFrame([(str(k),) for k in keys], "k string").select("k", shelf_of(F.col("k")).alias("s")).collect()  # what the caller listed
        return out.filter(F.col("shelf").isin(sorted({r["s"] for r in asked})) & F.col(self.by).cast("string").isin([r["k"] for r in asked]))

    def lookup(self, left: DataFrame, by: str, day: str, tolerance: int | None = None, name: str = "match") -> DataFrame:
        """``left`` with a struct of the row that holds at its date, null where there is none or it is more than ``tolerance`` days away."""
        store = self.spark.table(self.table)
        row = F.struct(F.col(f"_p.`{self.date}`").alias("_at"), *[F.col(f"_p.`{c}`") for c in store.columns if c not in (self.by, *OWN)])
        asked = left.withColumn("_ask", self.span(F.to_date(F.col(day))))
        at = F.to_date(F.col(f"_l.`{day}`"))
        on = (F.col(f"_l.`{by}`") == F.col(f"_p.`{self.by}`")) & (F.col("_l._ask") == F.col("_p._span")) & at.between(F.col("_p._from"), F.col("_p._to"))
        found = asked.alias("_l").join(store.alias("_p").hint("merge"), on, "left")
        hit = F.col(f"_p.`{self.date}`").isNotNull()
        if tolerance is not None:
            hit = hit & (F.abs(F.datediff(at, F.col(f"_p.`{self.date}`"))) <= tolerance)
        return found.select(*[F.col(f"_l.`{c}`") for c in left.columns], F.when(hit, row).alias(name))
