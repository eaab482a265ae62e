"""Exact interpolated quantiles without one task that holds all values."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Ranks that a sketch may be wrong by are 1 / ACCURACY of all; brackets reach three times as far.
ACCURACY = 10_000


@contextmanager
def without_inferred_filters(spark: SparkSession) -> Iterator[None]:
    """Plans made meanwhile infer no filters from constraints: over wide derived tables that takes longer than the query."""
    name = "spark.sql.constraintPropagation.enabled"
    was = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, was)


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> list[list[float] | None]:
    """Per column its quantiles at ``probs``, missing values left out; None where there are none. Runs at once; what comes back are these numbers alone.

    A sketch gives two values around each quantile. One more pass counts the rows below them and
    keeps the distinct values between them, some thousandths of all; the quantile is picked
    among these by its rank. Both passes add up before their exchange.
    """
    reach, p = 3 / ACCURACY, len(probs)
    around = [max(0.0, q - reach) for q in probs] + [min(1.0, q + reach) for q in probs]
    values = [F.col(c).cast("double") for c in columns]
    with without_inferred_filters(df.sparkSession):
        ends = df.agg(*[F.struct(F.count(v).alias("n"), F.percentile_approx(v, around, ACCURACY).alias("q")).alias(f"_{i}") for i, v in enumerate(values)]).first()
        some = [i for i in range(len(columns)) if ends[i]["n"]]
        if not some:
            return [None] * len(columns)

        def side(i: int, j: int) -> Column:
            """Below the bracket of quantile j, in it (with the value) or above it."""
            v, q = values[i], ends[i]["q"]
            k = F.when(v < q[j], -1).when(v <= q[p + j], 0).otherwise(1)
            return F.when(v.isNotNull(), F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), k.alias("k"), F.when(k == 0, v).alias("x"), v.alias("v")))

        sides = df.select(F.explode(F.array(*[side(i, j) for i in some for j in range(p)])).alias("s"))
        counted = sides.groupBy("s.i", "s.j", "s.k", "s.x").agg(F.count("*").alias("c"), F.when(F.col("k") < 0, F.max("s.v")).otherwise(F.min("s.v")).alias("v"))
        upto = F.sum("c").over(Window.partitionBy("i", "j").orderBy("k", "x"))
        at = F.lit(None).cast("double")
        for i in some:
            for j, q in enumerate(probs):
                at = F.when((F.col("i") == i) & (F.col("j") == j), F.lit(q * (ends[i]["n"] - 1))).otherwise(at)
        ranked = counted.withColumn("upto", upto).withColumn("at", at)

        def value_at(rank: Column) -> Column:
            """The first value with more than ``rank`` rows up to it; beside the bracket, only the value next to it is known."""
            known = (F.col("k") == 0) | ((F.col("k") < 0) & (F.col("upto") == rank + 1)) | ((F.col("k") > 0) & (F.col("upto") - F.col("c") == rank))
            return F.min_by(F.when(known, F.col("v")), F.when(F.col("upto") > rank, F.col("upto")))

        picked = ranked.groupBy("i", "j").agg(value_at(F.floor("at")).alias("low"), value_at(F.ceil("at")).alias("high"), F.first("at").alias("at"))
        rows = {(r["i"], r["j"]): r for r in picked.collect()}  # a row for each column and quantile
    out: list[list[float] | None] = [None] * len(columns)
    for i in some:
        out[i] = []
        for j in range(p):
            r = rows[i, j]
            if r["low"] is None or r["high"] is None:  # the sketch's bound makes this impossible; were it broken, the result must not be wrong quietly
                raise RuntimeError(f"quantile {probs[j]} of {columns[i]} lies outside its bracket")
            share = r["at"] - int(r["at"])
            out[i].append(r["low"] if r["low"] == r["high"] else (1 - share) * r["low"] + share * r["high"])
    return out


def array_of(values: list[float] | None) -> Column:
    """The numbers as a constant array of doubles; null for None."""
    return F.array(*[F.lit(v) for v in values]) if values is not None else F.lit(None).cast("array<double>")
