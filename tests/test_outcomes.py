"""Market, caps and earnings looked up together."""

import datetime as dt
import random

from pyspark.sql import functions as F

from colloquy.operators import events, relate
from colloquy.plans.catalogue import QUERIES, SQL, calls, caps, earnings, joined_calls, panel

from .conftest import same

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_one_pass_gives_what_three_lookups_give(spark):
    asked = calls(spark, SF).unionByName(spark.createDataFrame([(-1, None, dt.date(1996, 1, 1)), (-2, 3, None)], "call_id long, ticker_norm long, call_date date"))
    tables = panel(spark, SF), caps(spark, SF), earnings(spark, SF)
    got = events.with_outcomes(asked, *tables)
    want = events.with_earnings(events.with_marketcap(events.with_market(asked, tables[0]), tables[1]), tables[2])
    rows = {r["call_id"]: r for r in got.collect()}
    assert got.columns == want.columns and rows == {r["call_id"]: r for r in want.collect()} and len(rows) == 1502
    assert not any(v for k, v in rows[-1].asDict().items() if k not in asked.columns)


def test_calls_are_read_twice_for_all_lookups(spark):
    """Once for their spans, once for the lookups; chained lookups read them 27 times."""
    asked = spark.range(9).select(F.col("id").alias("call_id"), F.lit("A").alias("ticker_norm"), F.lit("2024-01-01").cast("date").alias("call_date"), F.rand(7).alias("mark"))
    out = events.with_outcomes(asked, panel(spark, SF).withColumn("ticker_norm", F.lit("A")), caps(spark, SF).withColumn("ticker_norm", F.lit("A")), earnings(spark, SF).withColumn("ticker_norm", F.lit("A")))
    assert plan_of(out).count("Range (0, 9") == 2
    assert plan_of(joined_calls(spark, SF)).count("o_orderkey") < 20


def test_steps_give_the_columns_of_one_pass(spark):
    from colloquy.session import kept

    asked = calls(spark, SF).unionByName(spark.createDataFrame([(-1, None, dt.date(1996, 1, 1)), (-2, 3, None)], "call_id long, ticker_norm long, call_date date"))
    tables, columns = (panel(spark, SF), caps(spark, SF), earnings(spark, SF)), ("AvgVolume_m20_m1", "CAR_m1_p1", "log_marketCap", "eps_surprise", "epsActual")
    got = events.chosen_outcomes(asked, *tables, columns, kept)
    assert set(got.columns) == {"call_id", "ticker_norm", "call_date", *columns}
    want = events.with_outcomes(asked, *tables).select(*got.columns)
    assert {r["call_id"]: r for r in got.collect()} == {r["call_id"]: r for r in want.collect()}


def test_tables_of_a_lookup_are_exchanged_once(spark):
    """Before, right rows were exchanged for their spans and once more for the frames."""
    left = spark.range(500).select(F.col("id").alias("call"), (F.col("id") % 7).alias("k"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 300).cast("int")).alias("d"))
    right = left.select("k", F.col("d").alias("at"), F.col("call").alias("v"))
    out = relate.asof(left, right, "k", "d", "at")
    out.collect()
    final = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    whole = [x for x in final.splitlines() if "Exchange hashpartitioning(_k" in x and "_b#" in x and "ReusedExchange" not in x]
    assert len(whole) == 1 and final.count("ReusedExchange") >= 1


def test_prep_like_sql(spark):
    names = ("lineitem", "orders", "supplier")
    assert same(spark, QUERIES["regression_prep"](spark, SF), SQL["regression_prep"], {t: f"{SF}/{t}.parquet" for t in names}) > 0


def test_lookups_run_in_linear_frames(spark):
    """A frame from a row to the end of its span is added up anew for each row."""
    right = spark.createDataFrame([("A", dt.date(2024, 1, 1), 1)], "k string, at date, v int")
    for forward in (False, True):
        plan = plan_of(relate.asof(right.select("k", "at"), right, "k", "at", "at", forward=forward))
        assert "unboundedfollowing" not in plan.lower() and "unboundedpreceding" in plan.lower()


def test_long_frames_are_differences_and_keep_infinities_apart(spark):
    rng, day, rows = random.Random(4), dt.date(2000, 1, 1), []
    for i in range(700):
        rows.append(("A", day + dt.timedelta(i), float("inf") if i == 100 else rng.uniform(5, 9), 1.0))
    out = events.market_panel(spark.createDataFrame(rows, "ticker_norm string, date date, close double, volume double"))
    assert "-250" not in plan_of(out)
    cars = {(r["date"] - day).days: r["CAR_m1_p1"] for r in out.collect()}
    assert all(cars[i] == float("-inf") for i in range(150, 351)) and all(abs(cars[i]) < 9 for i in [*range(113, 150), *range(351, 699)])
