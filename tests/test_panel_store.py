"""Lookups in a store of panels against as-of joins, and their plans."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from colloquy.operators import relate
from colloquy.sources.panel_store import PanelStore


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(6)
    day = lambda: dt.date(2020, 1, 1) + dt.timedelta(days=rng.randrange(1500))
    names = ["HOT"] * 5 + [f"T{k}" for k in range(6)]
    panel = [(rng.choice(names), day(), rng.choice([None, rng.random()]), rng.randrange(9)) for _ in range(900)]
    panel += panel[:40] + [(n, d, 5.0, k) for n, d, _, k in panel[40:80]] + [(None, day(), 1.0, 1), ("HOT", None, 1.0, 1)]
    calls = [(i, rng.choice([*names, "NONE", None]), rng.choice([day(), None]) if i % 9 == 0 else day()) for i in range(700)]
    calls += [(1000, "HOT", dt.date(2019, 1, 1)), (1001, "HOT", dt.date(2026, 1, 1))]
    return spark.createDataFrame(panel, "ticker_norm string, date date, close double, k int").repartition(4), spark.createDataFrame(calls, "call_id int, firm string, call_date date")


def told(df):
    return {r["call_id"]: None if r["match"] is None else (r["match"]["_at"], r["match"]["close"], r["match"]["k"]) for r in df.collect()}


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("tolerance", [None, 3])
@pytest.mark.parametrize("days", [7, 90])
def test_lookup_like_an_asof_join(spark, tables, forward, tolerance, days):
    panel, calls = tables
    store = PanelStore.build(panel, dt.date(2018, 1, 1) if forward else dt.date(2026, 2, 1), forward=forward, days=days)
    got = told(store.lookup(calls, "firm", "call_date", tolerance))
    want = told(relate.asof(calls.withColumnRenamed("firm", "ticker_norm"), panel, "ticker_norm", "call_date", "date", forward, tolerance))
    assert got == want and len(got) == calls.count() and sum(v is not None for v in got.values()) > 100
    spark.sql(f"DROP TABLE {store.table}")


def test_the_store_is_not_exchanged(spark, tables):
    panel, calls = tables
    store = PanelStore.build(panel, dt.date(2026, 2, 1))
    out = store.lookup(calls, "firm", "call_date")
    lines = out._jdf.queryExecution().executedPlan().toString().splitlines()
    at = next(i for i, x in enumerate(lines) if "SortMergeJoin" in x)
    scan = next(i for i, x in enumerate(lines) if "FileScan parquet" in x and store.table in x)
    depth = lambda x: len(x) - len(x.lstrip(" :+-*("))
    above, limit = [], depth(lines[scan])
    for x in reversed(lines[at + 1 : scan]):  # from the scan up to the join
        if depth(x) < limit:
            above.append(x)
            limit = depth(x)
    assert "Bucketed: true" in lines[scan] and not any("Exchange" in x for x in above)
    assert sum("Exchange" in x for x in lines) == 1  # that of the calls
    spark.sql(f"DROP TABLE {store.table}")


def test_reading_a_few_keys_opens_a_few_shelves(spark, tables):
    panel, _ = tables
    store = PanelStore.build(panel, dt.date(2026, 2, 1))
    got = store.read(["T1", "T3"])
    assert {r[0] for r in got.select("ticker_norm").distinct().collect()} == {"T1", "T3"}
    scan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shelf" in scan or "PartitionFilters: [shelf" in scan
    assert store.read().select("ticker_norm", "date").distinct().count() == panel.dropna("any", subset=["ticker_norm", "date"]).select("ticker_norm", "date").distinct().count()
    spark.sql(f"DROP TABLE {store.table}")


def test_odd_panels(spark, tables):
    panel, calls = tables
    store = PanelStore.build(panel.limit(0), dt.date(2026, 2, 1))
    assert set(told(store.lookup(calls, "firm", "call_date")).values()) == {None}
    spark.sql(f"DROP TABLE {store.table}")
    with pytest.raises(ValueError):
        PanelStore.build(panel.withColumn("Shelf", F.lit(1)), dt.date(2026, 2, 1))
