"""Descriptive tables and the data behind figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from .quantiles import array_of, exact_quantiles


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Counts with missing values, and shares."""
    out = df.groupBy(column).agg(F.count("*").alias("n"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def _stats(c: Column) -> dict[str, Column]:
    q = F.percentile(c, F.array(*map(F.lit, (0.25, 0.5, 0.75))))
    return {"n": F.count(c), "mean": F.avg(c), "std": F.stddev_samp(c), "min": F.min(c), "p25": q[0], "p50": q[1], "p75": q[2], "max": F.max(c)}


def summary(df: DataFrame, columns: list[str], listwise: bool = True) -> DataFrame:
    """One row per variable, over the rows without missing values."""
    rows = df.dropna("any", subset=columns) if listwise else df
    stats = rows.agg(*[F.struct(*[v(c).alias(k) for k, v in {"n": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}.items()]).alias(f"s{i}") for i, c in enumerate(columns)])
    both = stats.select("*", *[array_of(q).alias(f"q{i}") for i, q in enumerate(exact_quantiles(rows, columns, [0.25, 0.5, 0.75]))])
    parts = [
        F.struct(F.lit(c).alias("variable"), *[F.col(f"s{i}.{k}").cast(t).alias(k) for k, t in (("n", "long"), ("mean", "double"), ("std", "double"), ("min", "double"))],
                 *[F.get(F.col(f"q{i}"), j).alias(n) for j, n in enumerate(("p25", "p50", "p75"))], F.col(f"s{i}.max").cast("double").alias("max"))
        for i, c in enumerate(columns)
    ]
    return both.select(F.explode(F.array(*parts)).alias("x")).select("x.*")


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x, y, r) for all pairs, over the rows without missing values, from one aggregate."""
    rows = df.dropna("any", subset=columns)
    pairs = [(a, b) for a in columns for b in columns]
    r = rows.agg(*[F.corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    return r.select(F.explode(F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"`{i}`").alias("r")) for i, (a, b) in enumerate(pairs)])).alias("p")).select("p.*")


def measure_comparison(df: DataFrame, columns: list[str], baseline: str) -> DataFrame:
    """mean, std, min, median, max per column without its missing values, and the correlation with the baseline over pairs."""
    one = df.agg(*[F.struct(F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"), F.corr(c, baseline).alias("corr")).alias(f"s{i}") for i, c in enumerate(columns)])
    both = one.select("*", *[array_of(q).alias(f"q{i}") for i, q in enumerate(exact_quantiles(df, columns, [0.5]))])
    parts = [
        F.struct(F.lit(c).alias("measure"), *[F.col(f"s{i}.{k}").cast("double").alias(k) for k in ("mean", "std", "min")], F.get(F.col(f"q{i}"), 0).alias("median"),
                 *[F.col(f"s{i}.{k}").cast("double").alias(k) for k in ("max", "corr")]) for i, c in enumerate(columns)
    ]
    return both.select(F.explode(F.array(*parts)).alias("x")).select("x.*")


def sample_overview(df: DataFrame, firm: str, quarter: str) -> DataFrame:
    """Rows, firms, quarters, and quarters per firm."""
    per = df.groupBy(firm).agg(F.count_distinct(quarter).alias("q"), F.count("*").alias("rows"))
    quarters = df.agg(F.count_distinct(quarter).alias("n_quarters"))
    return per.agg(
        F.sum("rows").alias("n_rows"), F.count(firm).alias("n_firms"), F.avg("q").alias("mean_quarters"), F.percentile("q", F.lit(0.5)).alias("median_quarters"), F.min("q").alias("min_quarters"), F.max("q").alias("max_quarters")
    ).crossJoin(F.broadcast(quarters))  # one row each


def firm_coverage(df: DataFrame, firm: str, ticker: str) -> DataFrame:
    per = df.groupBy(firm).agg(F.max(F.col(ticker).isNotNull()).alias("has"))
    return per.agg(F.count("*").alias("n_firms"), F.count_if("has").alias("n_with_ticker"))


def non_null(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), *[F.count(c).alias(f"n_{c}") for c in columns])


def edges(df: DataFrame, column: str, k: int) -> list[float]:
    """The distinct interpolated quantile edges."""
    (found,) = exact_quantiles(df, [column], [i / k for i in range(k + 1)])
    return list(dict.fromkeys(found or []))


def quantile_bins(df: DataFrame, column: str, k: int, out: str = "bin") -> DataFrame:
    """Bins from 1: right-closed, the least value included, repeated edges once."""
    inner = F.array(*[F.lit(e) for e in edges(df, column, k)[1:-1]]).cast("array<double>")
    number = F.size(F.filter(inner, lambda e: e < F.col(column))) + 1
    return df.withColumn(out, F.when(F.col(column).isNotNull(), number))


def bin_table(df: DataFrame, column: str, value: str, k: int) -> DataFrame:
    """mean, std, n, standard error and half width of the 95 % interval of ``value`` per quantile bin."""
    rows = quantile_bins(df.dropna("any", subset=[column, value]), column, k)
    out = rows.groupBy("bin").agg(F.avg(column).alias("mean_x"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count("*").alias("n"))
    return out.withColumn("se", F.col("std") / F.sqrt("n")).withColumn("ci95", 1.96 * F.col("se"))


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """(bin from 0, n) over equal widths, the last closed; bins without rows are left out."""
    span = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    at = F.floor(F.try_divide((F.col(column) - F.col("_lo")) * bins, F.col("_hi") - F.col("_lo")))
    rows = df.filter(F.col(column).isNotNull()).crossJoin(F.broadcast(span))
    return rows.groupBy(F.least(F.coalesce(at, F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def box(df: DataFrame, column: str) -> DataFrame:
    """Quartiles, the furthest values within 1.5 interquartile ranges, and how many lie outside."""
    (found,) = exact_quantiles(df, [column], [0.25, 0.5, 0.75])
    q1, q2, q3 = (F.lit(v).cast("double") for v in (found or [None] * 3))
    inside = (F.col(column) >= q1 - 1.5 * (q3 - q1)) & (F.col(column) <= q3 + 1.5 * (q3 - q1))
    return df.agg(F.min(F.when(inside, F.col(column))).alias("low"), F.max(F.when(inside, F.col(column))).alias("high"), F.count_if(~inside).alias("outside")).select(
        q1.alias("q1"), q2.alias("median"), q3.alias("q3"), "low", "high", "outside"
    )


def quarter_series(df: DataFrame, date: str, value: str) -> DataFrame:
    return df.withColumn("year_quarter", N.quarter_label(F.col(date))).groupBy("year_quarter").agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def year_ticks(series: DataFrame) -> DataFrame:
    """The place (from 0) of the first quarter of each year; one row per quarter comes in."""
    at = series.withColumn("_n", F.row_number().over(Window.orderBy("year_quarter")) - 1)
    return at.groupBy(F.substring("year_quarter", 1, 4).alias("year")).agg(F.min("_n").alias("tick"))


def validation_summary(v: DataFrame) -> DataFrame:
    """One row of flags over a validation table: transcripts, those that lost much, those with questions or answers and how they balance."""
    qa = (F.col("n_q") > 0) | (F.col("n_a") > 0)
    ratio = F.col("qa_balance_ratio")
    return v.agg(
        F.count("*").alias("n_transcripts"), F.avg("drop_rate").alias("mean_drop_rate"), F.max("drop_rate").alias("max_drop_rate"), F.count_if(~F.col("drop_rate_ok")).alias("n_drop_alerts"),
        F.count_if(qa).alias("n_with_qa"), F.count_if(qa & (ratio < 0.5)).alias("n_ratio_below_half"), F.count_if(qa & (ratio < 0.25)).alias("n_ratio_below_quarter"),
        F.count_if(qa & ((F.col("n_q") == 0) | (F.col("n_a") == 0))).alias("n_one_sided"), F.avg(F.when(qa, F.col("qa_balance_gap"))).alias("mean_gap"),
    )


def firm_quarters(df: DataFrame, firm: str, quarter: str) -> DataFrame:
    """One row: how many quarters the firms have: firms, mean, std, min, p25, median, p75, max."""
    per = df.filter(F.col(firm).isNotNull()).groupBy(firm).agg(F.count_distinct(quarter).alias("q"))
    s = _stats(F.col("q"))
    names = {"n": "n_firms", "mean": "mean_quarters", "std": "std_quarters", "p50": "median_quarters"}
    return per.agg(*[v.alias(names.get(k, f"{k}_quarters")) for k, v in s.items()])


def overview(df: DataFrame, firm: str, call: str, quarter: str, date: str) -> DataFrame:
    """(statistic, value) of a sample: rows, firms, calls, quarters, first and last date, quarters per firm."""
    one = df.agg(
        F.count("*").alias("a"), F.count_distinct(firm).alias("b"), F.count_distinct(call).alias("c"), F.count_distinct(quarter).alias("d"),
        F.min(F.to_date(date)).alias("e"), F.max(F.to_date(date)).alias("f"),
    ).crossJoin(F.broadcast(firm_quarters(df, firm, quarter)))  # one row each
    names = [("Observations", "a"), ("Unique firms", "b"), ("Unique earnings calls", "c"), ("Unique year-quarter", "d"), ("Start date", "e"), ("End date", "f")]
    rows = [F.struct(F.lit(n).alias("statistic"), F.col(c).cast("string").alias("value")) for n, c in names]
    rows += [F.struct(F.lit(n).alias("statistic"), F.format_string("%.2f", F.col(c).cast("double")).alias("value")) for n, c in (("Mean quarters per firm", "mean_quarters"), ("Median quarters per firm", "median_quarters"))]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def basic_checks(final: DataFrame, chunks: DataFrame, call: str = "transcript_id", quarter: str = "year_quarter") -> DataFrame:
    """(check, passed, value) over a final dataset and its labelled chunks."""
    f = final.agg(F.count("*").alias("n"), F.count_distinct(call).alias("calls"), F.count_distinct(quarter).alias("quarters"))
    shares = {}
    for c in ("section", "speaker_role"):
        shares[c] = distribution(chunks, c).agg(F.sum("share").alias(f"{c}_share"))
    n = chunks.agg(*[F.count_if((F.col("section").isin(*v)) if k[0] == "s" else (F.col("speaker_role") == v[0])).alias(k) for k, v in {
        "s_exec": ("Prepared", "A"), "s_q": ("Q",), "r_exec": ("Executive",), "r_analyst": ("Analyst",)}.items()])
    one = f
    for part in (*shares.values(), n):
        one = one.crossJoin(F.broadcast(part))  # one row each
    checks = [
        ("observations", F.col("n") > 0, F.col("n")), ("one_row_per_call", F.col("calls") == F.col("n"), F.col("n") - F.col("calls")), ("quarters", F.col("quarters") > 0, F.col("quarters")),
        ("section_shares", F.abs(F.col("section_share") - 1) < 1e-8, F.col("section_share")), ("speaker_shares", F.abs(F.col("speaker_role_share") - 1) < 1e-8, F.col("speaker_role_share")),
        ("executive_is_prepared_and_a", F.col("r_exec") == F.col("s_exec"), F.col("r_exec") - F.col("s_exec")), ("analyst_is_q", F.col("r_analyst") == F.col("s_q"), F.col("r_analyst") - F.col("s_q")),
    ]
    rows = F.array(*[F.struct(F.lit(c).alias("check"), F.coalesce(p, F.lit(False)).alias("passed"), v.cast("double").alias("value")) for c, p, v in checks])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def has_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: values that are there (not missing, NaN counts as missing), whether there is any, whether all are. One pass."""
    kinds = dict(df.dtypes)
    there = {c: F.col(f"`{c}`").isNotNull() & (~F.isnan(f"`{c}`") if kinds[c] in ("double", "float") else F.lit(True)) for c in columns}
    counts = df.agg(F.count("*").alias("_n"), *[F.count_if(v).alias(f"_{i}") for i, v in enumerate(there.values())])
    rows = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"_{i}").alias("n_values"), (F.col(f"_{i}") > 0).alias("any_value"), (F.col(f"_{i}") == F.col("_n")).alias("all_values")) for i, c in enumerate(columns)])
    return counts.select(F.explode(rows).alias("r")).select("r.*")
