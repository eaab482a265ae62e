"""Event study: features of panel rows by row position, looked up at the event."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions import numeric as N
from .frames import ROWS, with_halo
from .quantiles import exact_quantiles
from .relate import Lookup, asof_all

#: Least estimates for a surprise, days to earnings, rows for an expected return.
MIN_EPS, MIN_REVENUE, MAX_GAP, MIN_DAYS = 0.01, 1e6, 30, 60


def numbers(df: DataFrame, *columns: str) -> DataFrame:
    """The columns that are there as doubles; texts that are no number, and NaN, become missing."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: N.number(F.col(c)) for c in columns if kinds.get(c) not in (None, "bigint", "int") and not kinds[c].startswith("decimal")})


def running(x: Column, w: WindowSpec) -> Column:
    """(sum, n, infinite, nan) of the rows up to each one; sums are of finite values, so one that is not reaches no other frame."""
    odd = F.isnan(x) | (F.abs(x) == float("inf"))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return F.struct(
        F.coalesce(F.sum(F.when(~odd, x)).over(upto), F.lit(0.0)).alias("sum"), F.count(x).over(upto).alias("n"),
        F.count_if(F.abs(x) == float("inf")).over(upto).alias("infinite"), F.count_if(F.isnan(x)).over(upto).alias("nan"),
    )


def mean_between(low: Column, high: Column, least: int) -> Column:
    """The mean of the rows after ``low`` up to ``high``, both from ``running`` (null before the first row); null of fewer than ``least`` values.

    A frame of 201 rows is so one difference; added up anew for each row it takes 201 steps. Returns are logarithms of positive ratios, so the only infinite one is positive.
    """
    part = {c: high[c] - F.coalesce(low[c], F.lit(0)) for c in ("sum", "n", "infinite", "nan")}
    odd = F.when(part["nan"] > 0, F.lit(float("nan"))).when(part["infinite"] > 0, F.lit(float("inf")))
    return F.when(part["n"] >= least, F.coalesce(odd, part["sum"] / part["n"]))


def market_panel(panel: DataFrame, rows: int = ROWS) -> DataFrame:
    """panel (ticker_norm, date, close, volume) -> log returns and all frames around each row. What is no number counts as missing.

    Frames are computed in buckets of ``rows`` rows of a ticker, so one with half of all rows is many tasks.
    """
    panel = numbers(panel, "close", "volume").dropna("any", subset=["date", "close"])
    # A return looks one row back, the longest frame of returns 250.
    panel = with_halo(panel, "ticker_norm", "date", 251, 5, rows)
    w = Window.partitionBy("ticker_norm", "_bucket").orderBy("date")
    ret = panel.withColumn("ret", N.safe_log(N.ratio(F.col("close"), F.lag("close").over(w))))
    out = ret.withColumn("_upto", running(F.col("ret"), w)).withColumns({
        "_mean": mean_between(F.lag("_upto", 251).over(w), F.lag("_upto", 50).over(w), MIN_DAYS),
        "_before": F.lag("ret").over(w), "_after": F.lead("ret").over(w),
        "Volatility_0_p5": F.stddev_pop("ret").over(w.rowsBetween(0, 5)),
        "AvgVolume_m20_m1": F.avg("volume").over(w.rowsBetween(-20, -1)), "AvgVolume_0_p1": F.avg("volume").over(w.rowsBetween(0, 1)),
    }).drop("_upto")
    out = out.filter("_own")
    parts = [F.col(c) - F.col("_mean") for c in ("_before", "ret", "_after")]
    some = F.coalesce(*parts).isNotNull()
    car = F.when(some, sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0)))
    volume = F.when(F.col("AvgVolume_m20_m1") != 0, N.ratio(F.col("AvgVolume_0_p1"), F.col("AvgVolume_m20_m1")))
    return out.withColumn("CAR_m1_p1", car).withColumn("AbVol_0_p1", volume).drop("_mean", "_before", "_after", "_bucket", "_own")


MARKET = ("CAR_m1_p1", "Volatility_0_p5", "AvgVolume_m20_m1", "AvgVolume_0_p1", "AbVol_0_p1")


def market_lookup(panel: DataFrame, columns: tuple = MARKET) -> Lookup:
    """Rows without a ticker match nothing, so they go first; then the parts of the frames read one exchange of the panel."""
    frames = market_panel(panel.filter(F.col("ticker_norm").isNotNull()))
    return Lookup(frames.select("ticker_norm", "date", *[c for c in MARKET if c in columns]), "date", forward=True, name="_market")


def cap_lookup(caps: DataFrame) -> Lookup:
    return Lookup(numbers(caps, "marketCap").dropna("any", subset=["date", "marketCap"]), "date", name="_cap")


#: Columns of an earnings row, and what they give.
ESTIMATES = ("epsEstimated", "epsActual", "revenueEstimated", "revenueActual")


def surprises(c: dict[str, Column]) -> dict[str, Column]:
    return {"eps_surprise": N.surprise(c["epsActual"], c["epsEstimated"], MIN_EPS), "revenue_surprise": N.surprise(c["revenueActual"], c["revenueEstimated"], MIN_REVENUE)}


def earnings_lookup(earnings: DataFrame, max_gap: int = MAX_GAP, columns: tuple | None = None) -> Lookup:
    earnings = numbers(earnings, *ESTIMATES).dropna("any", subset=["date"])
    if columns is not None:
        made = [x.alias(name) for name, x in surprises({c: F.col(c) for c in ESTIMATES}).items() if name in columns]
        earnings = earnings.select("ticker_norm", "date", *[c for c in ESTIMATES if c in columns], *made)
    return Lookup(earnings, "date", tolerance=max_gap, name="_earned")


def market_columns(columns: tuple = MARKET) -> list[Column]:
    return [F.col("_market.date").alias("event_date"), *[F.col(f"_market.{c}").alias(c) for c in MARKET if c in columns]]


def cap_columns() -> list[Column]:
    cap = F.col("_cap.marketCap")
    return [cap.alias("marketCap"), N.safe_log(cap).alias("log_marketCap")]


def earnings_columns(columns: tuple | None = None) -> list[Column]:
    date = F.col("_earned.date").alias("earnings_date")
    if columns is not None:
        return [date, *[F.col(f"_earned.{c}").alias(c) for c in (*ESTIMATES, "eps_surprise", "revenue_surprise") if c in columns]]
    m = {c: F.col(f"_earned.{c}") for c in ESTIMATES}
    return [date, *[x.alias(c) for c, x in m.items()], *[x.alias(c) for c, x in surprises(m).items()]]


def with_market(calls: DataFrame, panel: DataFrame) -> DataFrame:
    """calls (ticker_norm, call_date, ...) -> with the features of the first trading row at or after the call."""
    return asof_all(calls, "ticker_norm", "call_date", [market_lookup(panel)]).select(*calls.columns, *market_columns())


def with_marketcap(calls: DataFrame, caps: DataFrame) -> DataFrame:
    return asof_all(calls, "ticker_norm", "call_date", [cap_lookup(caps)]).select(*calls.columns, *cap_columns())


def with_earnings(calls: DataFrame, earnings: DataFrame, max_gap: int = MAX_GAP) -> DataFrame:
    return asof_all(calls, "ticker_norm", "call_date", [earnings_lookup(earnings, max_gap)]).select(*calls.columns, *earnings_columns())


def with_outcomes(calls: DataFrame, panel: DataFrame, caps: DataFrame, earnings: DataFrame) -> DataFrame:
    """calls -> with market, caps and earnings, looked up in one exchange: ``with_market``, ``with_marketcap`` and ``with_earnings`` by one pass over the calls."""
    found = asof_all(calls, "ticker_norm", "call_date", [market_lookup(panel), cap_lookup(caps), earnings_lookup(earnings)])
    return found.select(*calls.columns, *market_columns(), *cap_columns(), *earnings_columns())


def chosen_outcomes(
    calls: DataFrame, panel: DataFrame, caps: DataFrame, earnings: DataFrame, columns: tuple, keep: Callable[[DataFrame, str], DataFrame]
) -> DataFrame:
    """calls -> with those columns of ``with_outcomes`` that ``columns`` names, made in steps so that little is on disk at once.

    ``keep`` stores a step's result under a name and gives it back: the frames, then the calls with their market rows. What the exchanges of a step
    wrote can go before the next one. Columns that aren't wanted travel nowhere, so it is for tables with one row of a ticker and date: of several, all columns tell which counts.
    """
    market = market_lookup(panel, columns)
    market = replace(market, table=keep(market.table, "frames"))
    near = asof_all(calls, "ticker_norm", "call_date", [market]).select(*calls.columns, *market_columns(columns))
    near = keep(near.select(*calls.columns, *[c for c in near.columns if c in columns and c not in calls.columns]), "market")
    lookups = [cap_lookup(caps.select("ticker_norm", "date", "marketCap")), earnings_lookup(earnings, columns=columns)]
    out = asof_all(near, "ticker_norm", "call_date", lookups).select(*near.columns, *cap_columns(), *earnings_columns(columns))
    return out.select(*near.columns, *[c for c in out.columns if c in columns and c not in near.columns])


#: Columns that a regression needs, and those that are cut.
REQUIRED = ("NegGap", "CAR_m1_p1", "eps_surprise", "revenue_surprise", "log_marketCap", "AvgVolume_m20_m1")
WINSORIZED = ("CAR_m1_p1", "eps_surprise", "revenue_surprise", "AbVol_0_p1")


def winsorized(df: DataFrame, columns: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Columns cut at exact quantiles of all rows."""
    cuts = dict(zip(columns, exact_quantiles(df, columns, [low, high])))
    return df.withColumns({c: N.clip(F.col(c), *q) for c, q in cuts.items() if q is not None})


def prepared(df: DataFrame, cut: tuple = WINSORIZED) -> DataFrame:
    """Quarter, winsorized columns (over the sample before any filter) and logs."""
    out = df.withColumn("year_quarter", N.quarter_label(F.col("call_date")))
    out = winsorized(out, [c for c in cut if c in df.columns])
    for source, name in (("AvgVolume_m20_m1", "log_AvgVolume_m20_m1"), ("n_tokens_qa", "log_n_tokens_qa")):
        if source in out.columns:
            out = out.withColumn(name, N.safe_log(F.col(source).cast("double")))
    return out


def regression_sample(df: DataFrame, required: tuple = REQUIRED) -> DataFrame:
    return df.dropna("any", subset=[c for c in required if c in df.columns])
