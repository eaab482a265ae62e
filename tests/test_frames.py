"""Frames with a halo against plain windows."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from colloquy.operators import events
from colloquy.operators.frames import numbered, with_halo

SCHEMA = "ticker_norm string, date date, close double, volume double, key int"


@pytest.fixture(scope="module")
def rows():
    """One ticker with half of the rows, one of a single row, a null one, days without rows."""
    rng, out = random.Random(2), []
    for name, n in (("HOT", 3_000), *((f"T{k}", 300) for k in range(9)), ("ONE", 1), (None, 299)):
        day = dt.date(2000, 1, 3)
        for _ in range(n):
            day += dt.timedelta(days=rng.choice([1, 1, 1, 3, 40 if n < 1000 else 2]))
            out.append((name, day, rng.choice([None, 0.0, *[rng.uniform(5, 9)] * 30]), rng.uniform(1, 9), rng.randrange(9)))
    rng.shuffle(out)
    return out


def plain(panel):
    """All frames by windows over whole tickers."""
    panel = panel.dropna("any", subset=["date", "close"])
    w = Window.partitionBy("ticker_norm").orderBy("date")
    out = panel.withColumn("ret", F.when(F.try_divide("close", F.lag("close").over(w)) > 0, F.ln(F.try_divide("close", F.lag("close").over(w)))))
    base = w.rowsBetween(-250, -50)
    return out.select(
        "ticker_norm", "date", F.when(F.count("ret").over(base) >= 60, F.avg("ret").over(base)).alias("mean"), F.lag("ret").over(w).alias("before"), F.lead("ret").over(w).alias("after"), "ret",
        F.stddev_pop("ret").over(w.rowsBetween(0, 5)).alias("vol"), F.avg("volume").over(w.rowsBetween(-20, -1)).alias("v20"), F.avg("volume").over(w.rowsBetween(0, 1)).alias("v01"),
    )


def near(a, b):
    return (a is None) == (b is None) and (a is None or a == pytest.approx(b, rel=1e-9, abs=1e-12))


@pytest.mark.parametrize("size", [7, 300, 4_096])
def test_market_panel_against_plain_windows(spark, rows, size):
    panel = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = {(r["ticker_norm"], r["date"]): r for r in plain(panel).collect()}
    got = events.market_panel(panel, size).collect()
    assert len(got) == len(want)
    for r in got:
        x = want[r["ticker_norm"], r["date"]]
        parts = [None if v is None or x["mean"] is None else v - x["mean"] for v in (x["before"], x["ret"], x["after"])]
        car = None if all(p is None for p in parts) else sum(p or 0 for p in parts)
        ab = x["v01"] / x["v20"] if x["v20"] else None
        assert near(r["CAR_m1_p1"], car) and near(r["Volatility_0_p5"], x["vol"]) and near(r["AvgVolume_m20_m1"], x["v20"]) and near(r["AvgVolume_0_p1"], x["v01"]) and near(r["AbVol_0_p1"], ab)


def test_numbers_and_halo(spark, rows):
    panel = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in numbered(panel, "ticker_norm", "date").collect():
        got.setdefault(r["ticker_norm"], []).append((r["date"], r["_n"]))
    assert all([n for _, n in sorted(v)] == list(range(len(v))) for v in got.values()) and sum(map(len, got.values())) == len(rows)
    spread = with_halo(panel, "ticker_norm", "date", 2, 1, 10)
    assert spread.filter("_own").count() == len(rows)
    sizes = spread.filter("ticker_norm = 'HOT'").groupBy("_bucket").agg(F.count("*").alias("n"), F.count_if("_own").alias("own")).collect()
    assert max(r["n"] for r in sizes) == 13 and {r["own"] for r in sizes} <= {10, 0}
    assert with_halo(panel.limit(0), "ticker_norm", "date", 2, 1).count() == 0
    with pytest.raises(ValueError):
        with_halo(panel, "ticker_norm", "date", -1, 0)


def test_one_ticker_with_half_of_the_rows_is_many_tasks(spark, rows):
    """Rows of each task of the frames' exchange."""
    panel = spark.createDataFrame(rows, SCHEMA).dropna("any", subset=["date", "close"])
    spread = with_halo(panel, "ticker_norm", "date", 251, 5, 100)
    tasks = spread.repartition(64, "ticker_norm", "_bucket").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in tasks) < sum(r["count"] for r in tasks) / 8
