"""Mixing sources to target weights with a time-varying curriculum.

Targets: sources by code point (null last) weigh 5, 2, 1, repeating; they share
``total`` times all words, and no target exceeds ``most`` times its source. What
a capped source leaves is shared again by weight. In closed form: sources are
filled to one common level per weight, those with the least room per weight
first.

Copies: a source takes every document ``floor(target / size)`` times and once
more those that come first in an order by hash, up to the rest of the target.

Curriculum: a source's share changes over training by a schedule of (time,
weight) knots. Its integral is the cumulative demand D(t), D(1) = 1. A copy that
covers the part [a, b) of its source's words is due when D reaches the middle of
that part, so its position is the inverse of D there; the documents are then
range-sorted by position.

Defined cases: a null or empty text has size 0 and takes nothing; a source
without words has target 0; null sources are one source, the last; rows that
share an id are separate documents; the order of equal rows doesn't show;
extra columns are kept by ``curriculum``.
"""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, documents, running_total, stored

WEIGHTS = (5, 2, 1)
#: Per weight, (time, relative weight) knots from time 0 to 1.
SCHEDULES = {5: ((0.0, 1.5), (0.7, 1.0), (1.0, 0.25)), 2: ((0.0, 1.0), (1.0, 1.0)), 1: ((0.0, 0.25), (0.5, 0.75), (1.0, 2.0))}
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def invert_demand(share: Column, knots: tuple) -> Column:
    """The time at which the integral of the piecewise linear ``knots``, scaled to 1, reaches ``share``."""
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in pairwise(knots)]
    total, done, out = sum(areas), 0.0, None
    for ((t0, w0), (t1, w1)), area in reversed(list(zip(pairwise(knots), areas))):
        done = sum(a for (x, _), a in zip(knots, areas) if x < t0)
        left = share * total - done
        slope = (w1 - w0) / (t1 - t0)
        # w0 * x + slope * x**2 / 2 = left
        x = left / w0 if slope == 0 else (F.sqrt(F.greatest(F.lit(0.0), w0 * w0 + 2 * slope * left)) - w0) / slope
        time = F.least(F.lit(float(t1)), F.lit(float(t0)) + x)
        out = time if out is None else F.when(share * total < done + area, time).otherwise(out)
    return F.greatest(F.lit(0.0), out)


def targets(sizes: DataFrame, total: float = 1.5, most: int = 2) -> DataFrame:
    """sizes (source, source_size) -> with weight, target. One row per source, so its windows are small."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1)
    ranked = sizes.withColumn("weight", weight.cast("long")).withColumn("_cap", F.col("source_size") * most)
    level = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = level.rowsBetween(Window.unboundedPreceding, -1), level.rowsBetween(0, Window.unboundedFollowing)
    budget = F.sum("source_size").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) * total
    filled = (budget - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    # The common level is that of the first source (by room per weight) that it doesn't fill.
    ranked = ranked.withColumn("_turn", F.row_number().over(level)).withColumn("_level", filled)
    ranked = ranked.withColumn("_open", F.col("_level") * F.col("weight") <= F.col("_cap"))
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.min(F.when(F.col("_open"), F.struct(F.col("_turn").alias("turn"), F.col("_level").alias("level")))).over(whole)
    target = F.when(first.isNull(), F.col("_cap").cast("double")).otherwise(
        F.least(F.col("_cap").cast("double"), first["level"] * F.col("weight"))
    )
    return ranked.withColumn("target", target).drop("_cap", "_turn", "_level", "_open")


def mixture(docs: DataFrame, total: float = 1.5, most: int = 2) -> DataFrame:
    """The columns of ``docs`` (_d), size, source_size, weight, target, copies, taken, before, source_taken."""
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_d"),
        F.col("source").cast("string").alias("source"),
        word_count(F.col("text")).alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("hash"),
        F.col("doc_id").alias("doc_id"),
    )
    return mixture_of(rows, total, most)


def mixture_of(rows: DataFrame, total: float = 1.5, most: int = 2) -> DataFrame:
    """rows: source, size, hash, doc_id and anything else. Adds target, copies, taken and the words taken before."""
    n = rows.count()
    aim = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), total, most)
    run = running_total(rows, ["source"], ["hash", "doc_id", "size"], "size", "before", n)
    tag = F.coalesce(F.col("source"), F.lit("\0null"))
    run = run.withColumn("_tag", tag).drop("source").join(aim.withColumn("_tag", tag), "_tag").drop("_tag")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - whole * F.col("source_size")
    extra = 2 * F.col("before") + F.col("size") <= 2 * rest
    copies = F.when(F.col("size") > 0, whole + F.when((whole < most) & extra, 1).otherwise(0)).otherwise(0)
    return run.withColumn("copies", copies.cast("long")).withColumn("taken", F.col("copies") * F.col("size"))


def ordered_copies(mixed: DataFrame, schedules: dict | None = None) -> DataFrame:
    """The rows of a mixture, one for each copy that is taken, with ``due`` in [0, 1], range-sorted by it."""
    # Copy number c of a document lies c rounds of its source further on.
    rounds = F.greatest(F.lit(1e-9), F.col("target") / F.col("source_size"))
    copies = mixed.filter("copies > 0").select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy")
    )
    middle = (F.col("before") + F.col("size") / 2) / F.col("source_size")
    share = F.least(F.lit(1.0), (F.col("copy") + middle) / rounds)
    due = F.lit(None).cast("double")
    for weight, knots in (schedules or SCHEDULES).items():
        due = F.when(F.col("weight") == weight, invert_demand(share, knots)).otherwise(due)
    return copies.withColumn("due", F.coalesce(due, share)).orderBy("due", "hash", "copy")


def curriculum(docs: DataFrame, total: float = 1.5, most: int = 2, schedules: dict | None = None, position: str | None = "position") -> DataFrame:
    """The columns of ``docs`` and one of the name ``position`` (if any): one row per copy, range-sorted by position in [0, 1]."""
    ordered = ordered_copies(mixture(docs, total, most), schedules)
    return ordered.select("_d.*", *([F.col("due").alias(position)] if position else []))


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    """The words that the training order takes of each document, counted in that order once it is written."""
    docs = documents(spark, sf_dir)
    slim = docs.select(
        "doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("hash"), F.monotonically_increasing_id().alias("row"),
    )
    sizes = stored(slim, "sizes")
    mixed = stored(mixture_of(sizes), "mixed")
    discard(sizes)
    order = stored(ordered_copies(mixed).select("row", "size", "due"), "order")
    words = order.groupBy("row").agg(F.sum("size").alias("taken"))
    out = mixed.drop("taken").join(words.hint("merge"), "row", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '')) AS hash,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM d GROUP BY source
), caps AS (
  SELECT *, source_size * 2 AS cap, source_size * 2 / weight::DOUBLE AS room, sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM s
), spent AS (  -- what all sources take when the common level per weight stands at one source's room
  SELECT a.source, a.room, a.budget, sum(least(b.cap::DOUBLE, a.room * b.weight)) AS used FROM caps a, caps b GROUP BY a.source, a.room, a.budget
), shut AS (  -- the sources with no more room than that are full
  SELECT coalesce(max(room) FILTER (WHERE used <= budget), -1) AS room FROM spent
), lvl AS (
  SELECT (max(c.budget) - coalesce(sum(c.cap) FILTER (WHERE c.room <= shut.room), 0)::DOUBLE) / (sum(c.weight) FILTER (WHERE c.room > shut.room))::DOUBLE AS level
  FROM caps c, shut
), t AS (
  SELECT source, source_size, weight, CASE WHEN lvl.level IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, lvl.level * weight) END AS target FROM caps, lvl
), r AS (
  SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY hash, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d
), m AS (
  SELECT r.doc_id, r.size, t.source_size, t.target, r.before, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS w
  FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (size * (w + CASE WHEN w < 2 AND 2 * before + size <= 2 * (target - w * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM m
"""
