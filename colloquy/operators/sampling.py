"""Annotation samples, splits, labelling and classification measures."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .relate import not_in

WEIGHTS = {"Prepared": 0.34, "Q": 0.33, "A": 0.33}


def hashed(key: str, seed: int = 42) -> Column:
    """A reproducible random order."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))


def uniform(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """Exactly n rows (all, if fewer): the n least hashes, found by a distributed top-n."""
    return df.orderBy(hashed(key, seed), key).limit(n)


def extremes(df: DataFrame, n: int, score: str, key: str) -> DataFrame:
    """The n/2 lowest and the rest highest scores, each row once."""
    low = df.filter(F.col(score).isNotNull()).orderBy(F.col(score), key).limit(n // 2)
    high = df.filter(F.col(score).isNotNull()).orderBy(F.col(score).desc(), key).limit(n - n // 2)
    return low.unionByName(high).dropDuplicates([key])


def stratified(df: DataFrame, n: int, key: str, section: str = "section", score: str | None = None, weights: dict | None = None, seed: int = 42) -> DataFrame:
    """floor(n * weight) rows per section, 30 % of them extremes where scores are given, then topped up to n from the rest.

    One pass over ``df``: every row stands in line by score from both ends and by hash within
    its section, and by hash over all; the lines are cut at 2 n rows by partial sorts before
    the exchange. What is left (some n rows a line, one per key) decides the sample.
    """
    weights = weights or WEIGHTS
    none = F.lit(None).cast("double")
    value = F.col(score).cast("double") if score else none
    lines = [F.struct(F.lit(t).alias("line"), g.alias("group"), v.alias("v"), h.alias("h")) for t, g, v, h in (
        ("low", F.col(section), value, F.lit("")), ("high", F.col(section), -value, F.lit("")),
        ("hash", F.col(section), F.lit(0.0), hashed(key, seed)), ("all", F.lit(""), F.lit(0.0), hashed(key, seed)))]
    named = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(key).alias("key"), F.col(section).alias("section"), F.explode(F.array(*lines)).alias("l"))
    named = named.filter(F.col("l.v").isNotNull() & ((F.col("l.line") == "all") | F.col("section").isin(*weights)))
    order = Window.partitionBy("l.line", "l.group").orderBy("l.v", "l.h", "key")
    ranked = named.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= 2 * n)
    places = [F.min(F.when(F.col("l.line") == t, F.col("r"))).alias(t) for t in ("low", "high", "hash", "all")]
    few = ranked.groupBy("key").agg(F.first("row").alias("row"), F.first("section").alias("section"), *places)
    # From here on, at most 2 n rows for each line of each section, and of all.
    size = F.lit(0)
    for name, weight in weights.items():
        size = F.when(F.col("section") == name, int(n * weight)).otherwise(size)
    edge = F.when(F.max("low").over(Window.partitionBy("section")).isNotNull(), F.bround(size * 0.3, 0).cast("int")).otherwise(0)
    few = few.withColumn("size", size).withColumn("edge", edge)
    low = F.floor(F.col("edge") / 2)
    few = few.withColumn("extreme", F.coalesce(F.col("low") <= low, F.lit(False)) | F.coalesce(F.col("high") <= F.col("edge") - low, F.lit(False)))
    turn = F.row_number().over(Window.partitionBy("section", "extreme").orderBy(F.col("hash").asc_nulls_last()))
    few = few.withColumn("base", F.col("extreme") | (F.col("hash").isNotNull() & (turn <= F.col("size") - F.col("edge"))))
    turn = F.row_number().over(Window.partitionBy("base").orderBy(F.col("all").asc_nulls_last()))
    have = F.count_if("base").over(Window.partitionBy())
    return few.withColumn("extra", F.col("all").isNotNull() & (turn <= n - have)).filter("base OR extra").select("row.*")


#: Signs, or the span of numbers, by which ``global_ranks`` cuts the rows of one date.
SLICE, SPAN = 2, 100_000


def global_ranks(df: DataFrame, first: str, then: str, out: str, weight: str | None = None) -> DataFrame:
    """``df`` with its place (from 1) in order of ``first`` (a date, missing values last) and ``then``; with ``weight``, the sum of it up to and with the row.

    No task sees all rows: they are counted by value of ``first`` and a slice of ``then`` that fits its rows (so a value, or a missing one, that
    all share is spread), running totals of these counts give the place of each slice's first row, and rows are numbered inside their slice.
    """
    slice_ = F.substring(F.col(then).cast("string"), 1, SLICE) if dict(df.dtypes)[then] == "string" else F.floor(F.col(then) / SPAN) if dict(df.dtypes)[then] in ("int", "bigint") else F.lit(0)
    sliced, one = df.withColumn("_s", slice_), F.col(weight) if weight else F.lit(1)
    counts = sliced.groupBy(F.col(first).alias("_v"), F.col("_s").alias("_vs")).agg(F.sum(one).alias("_c"))
    per_value = counts.groupBy("_v").agg(F.sum("_c").alias("_all"))
    by_value = Window.orderBy(F.col("_v").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)  # a row for each date
    values = per_value.select(F.col("_v").alias("_w"), F.coalesce(F.sum("_all").over(by_value), F.lit(0)).alias("_value"))
    by_slice = Window.partitionBy("_v").orderBy("_vs").rowsBetween(Window.unboundedPreceding, -1)
    slices = counts.withColumn("_slice", F.coalesce(F.sum("_c").over(by_slice), F.lit(0)))
    before = slices.join(values, F.col("_v").eqNullSafe(F.col("_w"))).select("_v", "_vs", (F.col("_value") + F.col("_slice")).alias("_before"))
    inside = sliced.withColumn("_in", F.sum(one).over(Window.partitionBy(first, "_s").orderBy(then).rowsBetween(Window.unboundedPreceding, 0)))
    placed = inside.join(before, F.col(first).eqNullSafe(F.col("_v")) & F.col("_s").eqNullSafe(F.col("_vs")))
    return placed.withColumn(out, (F.col("_before") + F.col("_in")).cast("long")).drop("_v", "_vs", "_before", "_in", "_s")


def group_split(df: DataFrame, group: str, date: str, train: float = 0.7, valid: float = 0.15) -> DataFrame:
    """(group, split): groups in order of date and id, cut at shares rounded half to even."""
    groups = df.groupBy(group).agg(F.min(date).alias("_d"))
    n = groups.count()
    a = round(n * train)
    b = a + round(n * valid)
    at = global_ranks(groups, "_d", group, "_r")
    return at.select(group, F.when(F.col("_r") <= a, "train").when(F.col("_r") <= b, "valid").otherwise("test").alias("split"))


def with_split(df: DataFrame, group: str, date: str) -> DataFrame:
    return df.join(group_split(df, group, date), group)


def annotation_frame(df: DataFrame, order: list[str]) -> DataFrame:
    """Empty label columns added, preferred columns first, all others after."""
    out = df.withColumns({
        "label": F.lit(None).cast("string"), "label_reason": F.lit(None).cast("string"), "label_source": F.lit("llm"),
        "llm_model": F.lit(None).cast("string"), "label_status": F.lit("pending"),
    })
    first = [c for c in order if c in out.columns]
    return out.select(*first, *[c for c in out.columns if c not in first])


def labelled_by(
    df: DataFrame, ask: Callable[[str], str], prompt_column: str, key: str, attempts: int = 3, concurrency: int = 8, wait: float = 0.0,
    timeout: float | None = None,
) -> DataFrame:
    """Labels from a callable of the caller that answers a prompt; a row that fails stays as a failed row.

    ``concurrency`` partitions ask side by side. An answer that holds no label is asked for again, ``wait`` seconds
    times the number of the attempt later; an answer that takes more than ``timeout`` seconds counts as failed.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool = ThreadPoolExecutor(1) if timeout else None
        for batch in batches:
            rows = []
            for k, p in zip(batch[key], batch[prompt_column]):
                answer, error, n = None, None, 0
                while answer is None and n < attempts:
                    n += 1
                    try:
                        said = pool.submit(ask, p).result(timeout) if pool else ask(p)
                        found = X.label_in(said)
                        if found is None:
                            raise ValueError(f"no label in the answer: {str(said)[:200]}")
                        answer = said
                    except Exception as e:  # noqa: BLE001  the failure is the row's result
                        error = (str(e) or type(e).__name__)[:500]
                        if pool and isinstance(e, TimeoutError):
                            pool.shutdown(wait=False, cancel_futures=True)
                            pool = ThreadPoolExecutor(1)
                        if n < attempts:
                            time.sleep(wait * n)
                rows.append((k, answer, None if answer is not None else error, n))
            yield pd.DataFrame(rows, columns=[key, "raw_response", "error", "attempts"])

    kind = df.schema[key].dataType.simpleString()
    out = df.select(key, prompt_column).repartition(concurrency, key).mapInPandas(run, f"{key} {kind}, raw_response string, error string, attempts int")
    return out.transform(parsed_labels)


def parsed_labels(df: DataFrame) -> DataFrame:
    """label, label_reason, label_status from raw_response."""
    found = X.json_label(F.col("raw_response"))
    return df.withColumn("_j", found).withColumns({
        "label": X.label(F.col("_j.label")), "label_reason": X.cut(F.col("_j.reason"), 300),
        "label_status": F.when(X.label(F.col("_j.label")).isNotNull(), "ok").otherwise("failed"),
    }).drop("_j")


def trainable(df: DataFrame) -> DataFrame:
    return df.filter((F.col("label_status") == "ok") & F.col("label").isin("negative", "neutral", "positive") & (X.as_text(F.col("chunk_text")) != ""))


def classification_measures(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """accuracy and macro precision, recall, F1 over all classes seen on either side; a ratio by 0 is 0."""
    counts = df.groupBy(F.col(truth).alias("t"), F.col(guess).alias("g")).count()
    sides = counts.select(F.col("t").alias("c"), F.when(F.col("t") == F.col("g"), F.col("count")).otherwise(0).alias("hit"), F.col("count").alias("is"), F.lit(0).cast("long").alias("said"))
    sides = sides.unionByName(counts.select(F.col("g").alias("c"), F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("is"), F.col("count").alias("said")))
    by = sides.groupBy("c").agg(F.sum("hit").alias("hit"), F.sum("is").alias("is"), F.sum("said").alias("said"))
    p, r = (F.coalesce(F.try_divide("hit", c), F.lit(0.0)) for c in ("said", "is"))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("hit"), F.col("is") + F.col("said")), F.lit(0.0))
    return by.agg((F.sum("hit") / F.sum("is")).alias("accuracy"), F.avg(p).alias("macro_precision"), F.avg(r).alias("macro_recall"), F.avg(f1).alias("macro_f1"))


def grid(spark: SparkSession, **values: list) -> DataFrame:
    """All combinations of the parameters."""
    return spark.createDataFrame(list(product(*values.values())), list(values))


def best_runs(runs: DataFrame, measure: str, tie: list[str], n: int = 10) -> DataFrame:
    return runs.orderBy(F.col(measure).desc(), *tie).limit(n)
