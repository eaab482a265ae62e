"""Numeric expressions with missing values as NULL throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(c: Column) -> Column:
    """As a double; what can't be read, NaN included, is null."""
    return F.nanvl(c.try_cast("double"), F.lit(None).cast("double"))


def clip(c: Column, low=None, high=None) -> Column:
    out = c
    if low is not None:
        out = F.greatest(out, low if isinstance(low, Column) else F.lit(low))
    if high is not None:
        out = F.least(out, high if isinstance(high, Column) else F.lit(high))
    return F.when(c.isNotNull(), out)


def safe_log(c: Column) -> Column:
    return F.when(c > 0, F.ln(c))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def argmax(values: Column) -> Column:
    """Index of the first largest value."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def quarter_label(d: Column) -> Column:
    return F.concat(F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string"))


def surprise(actual: Column, estimate: Column, least: float) -> Column:
    return F.when(F.abs(estimate) >= least, (actual - estimate) / F.abs(estimate))


def drop_rate(raw: Column, kept: Column) -> Column:
    return F.when(raw > 0, F.greatest(F.lit(0.0), 1 - kept / raw)).otherwise(F.lit(0.0))


def balance(a: Column, b: Column) -> Column:
    return F.try_divide(F.least(a, b), F.greatest(a, b))


def stars(p: Column) -> Column:
    return F.when(p < 0.01, "***").when(p < 0.05, "**").when(p < 0.1, "*").otherwise("")
