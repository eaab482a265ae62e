"""Joins: enrichment, universe filter, de-duplication and as-of."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def first_of(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key: the first in ``order`` (ascending, nulls first), of several such the least by all columns in order, as far as these can be compared.

    Each task sends one row of a key at most, so a key that a third of all rows have is no task of its own.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.select(*[F.col(f"`{k}`") for k in keys]).distinct()
    kinds = {f.name: f.dataType for f in df.schema}
    tie = [F.col(f"`{c}`") for c in rest if not str(kinds[c]).startswith(("MapType", "VariantType"))]
    rank = F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"o{i}") for i, o in enumerate(order)], *[t.alias(f"t{i}") for i, t in enumerate(tie)])
    best = df.groupBy(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), rank).alias("_r"))
    return best.select(*[F.col(f"_k{keys.index(c)}").alias(c) if c in keys else F.col(f"_r.`{c}`").alias(c) for c in df.columns])


def distinct_rows(*tables: DataFrame) -> DataFrame:
    """All rows once, over tables whose columns may differ."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out.distinct()


def enrich(left: DataFrame, metadata: DataFrame, left_key: str, right_key: str, order: list) -> DataFrame:
    """Left join on the company key; the first metadata row per key; an empty key matches nothing. The join is left to Spark's size check."""
    right = first_of(metadata.withColumn("_key", X.company_key(F.col(right_key))).filter("_key <> ''"), ["_key"], order)
    return left.withColumn("_key", X.company_key(F.col(left_key))).join(right, "_key", "left").drop("_key")


#: Columns of a metadata table that are kept, by the names they get.
METADATA = {
    "ticker": "ticker", "name": "metadata_name", "country": "country", "industry": "industry", "sector": "sector", "size class": "size_class",
    "exchange": "exchange", "trading region": "trading_region", "last price": "last_price",
}


def metadata_columns(metadata: DataFrame) -> DataFrame:
    """The known columns that a metadata table has, renamed; it must have a name."""
    if "name" not in metadata.columns:
        raise ValueError("the metadata table has no column 'name'")
    return metadata.select(*[F.col(f"`{k}`").alias(v) for k, v in METADATA.items() if k in metadata.columns])


def enrich_companies(segments: DataFrame, metadata: DataFrame, order: list | None = None) -> DataFrame:
    """Segments with the metadata of their company as it comes from its source. Of several rows of a name the first in ``order`` counts."""
    right = metadata_columns(metadata)
    return enrich(segments, right, "company_name", "metadata_name", order or [F.col(c) for c in right.columns])


def in_universe(df: DataFrame, symbols: DataFrame, column: str = "ticker", symbol: str = "Symbol") -> DataFrame:
    """Semi join on the normalised ticker."""
    keep = symbols.select(X.ticker(F.col(symbol)).alias("_t")).filter("_t IS NOT NULL").distinct()
    return df.join(keep, X.ticker(F.col(column)) == F.col("_t"), "left_semi")


def universe_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: rows before and after, their share in percent, tickers and transcripts that are left."""
    n = before.agg(F.count("*").alias("n_rows"))
    kept = after.agg(F.count("*").alias("n_kept"), F.count_distinct("ticker").alias("n_companies"), F.count_distinct("transcript_id").alias("n_transcripts"))
    return n.crossJoin(F.broadcast(kept)).withColumn("share", F.coalesce(F.try_divide(F.lit(100) * F.col("n_kept"), F.col("n_rows")), F.lit(0.0)))  # one row each


def not_in(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return df.join(other.select(key).distinct(), key, "left_anti")


@dataclass(frozen=True)
class Lookup:
    """What ``asof_all`` looks up: the row of ``table`` at or before (``forward``: at or after) a date, ``tolerance`` in days, as the struct ``name``."""

    table: DataFrame
    on: str
    forward: bool = False
    tolerance: int | None = None
    name: str = "match"


def asof(
    left: DataFrame, right: DataFrame, by: str, left_on: str, right_on: str, forward: bool = False,
    tolerance: int | None = None, bucket_days: int = 90, name: str = "match",
) -> DataFrame:
    """``left`` with a struct of the right row at or before (forward: at or after) its date, null where there is none: ``asof_all`` of one table."""
    return asof_all(left, by, left_on, [Lookup(right, right_on, forward, tolerance, name)], bucket_days)


def asof_all(left: DataFrame, by: str, left_on: str, lookups: list[Lookup], bucket_days: int = 90) -> DataFrame:
    """``left`` with a struct for each lookup, null where there is no row.

    The rows of all tables are cut by key and by spans of ``bucket_days`` and exchanged once, together; the last (first) right row of
    each span, told from that same exchange, carries over to the spans after (before) it.
    So one key with a third of the rows is spread over its spans, and each span is
    sorted once in each direction that is asked for. Frames run from the start of a span to the row, so the work
    is linear: a frame that ends with the span is added up anew for each row. Right rows of one key and date stand
    in order of all their columns, so the last (first) of them counts. What a row holds twice, as its key or date and as a column, travels once.
    """
    def span(c: str) -> Column:
        # Never null, so a join by spans infers no filter and its sides can read one exchange.
        return F.coalesce(F.floor(F.datediff(F.col(c), F.lit("1970-01-01")) / bucket_days), F.lit(0))

    every = range(len(lookups))
    rights = []
    for i, u in enumerate(lookups):
        payload = F.struct(F.col(u.on).alias("_at"), *[F.col(c) for c in u.table.columns if c not in (by, u.on)])
        known = u.table.filter(F.col(u.on).isNotNull() & F.col(by).isNotNull())
        rights.append(known.select(F.col(by).alias("_k"), span(u.on).alias("_b"), F.col(u.on).alias("_t"), payload.alias(f"_m{i}")))
    # Key and date of ``left`` are put back from the sides of the exchange, unless other types there have widened them.
    kinds = [(dict(left.dtypes)[by], dict(left.dtypes)[left_on]), *[(dict(u.table.dtypes)[by], dict(u.table.dtypes)[u.on]) for u in lookups]]
    back = {by: "_k", left_on: "_t"} if len(set(kinds)) == 1 else {}
    own = [F.col(c) for c in left.columns if c not in back] or [F.lit(0).alias("_none")]
    asked = F.col(by).isNotNull() & F.col(left_on).isNotNull()
    both = left.filter(asked).select(F.col(by).alias("_k"), span(left_on).alias("_b"), F.col(left_on).alias("_t"), F.struct(*own).alias("_l"))
    for r in rights:
        both = both.unionByName(r, allowMissingColumns=True)
    both = both.repartition("_k", "_b")
    edges = []
    for i, u in enumerate(lookups):
        pick = F.min_by if u.forward else F.max_by
        edges.append(pick(f"_m{i}", F.when(F.col(f"_m{i}").isNotNull(), F.struct("_t", f"_m{i}"))).alias(f"_edge{i}"))
    # All columns are used, so this reads the exchange that the frames read.
    marks = both.groupBy("_k", "_b").agg(F.count("_l").alias("_asks"), *edges)

    def latest(c: Column, forward: bool, keys: list[str], order: list[str], last: int) -> Column:
        """The last value so far; forward: from the other end."""
        w = Window.partitionBy(*keys).orderBy(*[F.desc(o) if forward else F.asc(o) for o in order])
        return F.last(c, True).over(w.rowsBetween(Window.unboundedPreceding, last))

    carried = marks.select("_k", "_b", "_asks", *[latest(F.col(f"_edge{i}"), u.forward, ["_k"], ["_b"], -1).alias(f"_far{i}") for i, u in enumerate(lookups)])
    carried = carried.filter("_asks > 0").drop("_asks")
    # Rows of ``left`` come after right rows of their date, forward before them.
    places = {False: ["_t", "_last", *[f"_m{i}" for i in every]], True: ["_t", "_first", *[f"_m{i}" for i in every]]}
    both = both.withColumn("_last", F.col("_l").isNotNull()).withColumn("_first", F.col("_l").isNull())
    near = both.select("_k", "_b", "_t", "_l", *[latest(F.col(f"_m{i}"), u.forward, ["_k", "_b"], places[u.forward], 0).alias(f"_near{i}") for i, u in enumerate(lookups)])
    found = near.filter("_l IS NOT NULL").join(carried, ["_k", "_b"], "left")
    out = [F.col(back[c]).alias(c) if c in back else F.col(f"_l.`{c}`").alias(c) for c in left.columns]
    for i, u in enumerate(lookups):
        match = F.coalesce(f"_near{i}", f"_far{i}")
        fits = match.isNotNull()
        if u.tolerance is not None:
            fits = fits & (F.abs(F.datediff(F.col("_t"), match["_at"])) <= u.tolerance)
        whole = F.struct(match["_at"].alias("_at"), *[match["_at" if c == u.on else c].alias(c) for c in u.table.columns if c != by])
        out.append(F.when(fits, whole).alias(u.name))
    # Rows that can match nothing stay where they are.
    return found.select(*out).unionByName(left.filter(~asked), allowMissingColumns=True)
