"""Probing of files, numbering of equal rows, ties of as-of joins, first rows, ranks of one date."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from colloquy.operators import relate, sampling
from colloquy.plans import pipelines
from colloquy.sources import readers
from colloquy.sources.probe import probe


def bad_pages(path, spark):
    """A file whose footer is good and whose pages are not."""
    spark.range(1000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("v")).coalesce(1).write.parquet(str(path) + ".d")
    (part,) = (path.parent / (path.name + ".d")).glob("*.parquet")
    data = bytearray(part.read_bytes())
    data[400:4000] = bytes(3600)
    path.write_bytes(data)


def test_probe_tries_footers_and_pages(spark, tmp_path):
    for k in range(3):
        spark.range(10 * k).withColumnRenamed("id", "n" if k == 2 else "id").coalesce(1).write.parquet(str(tmp_path / "in" / f"t{k}.parquet"))
    (tmp_path / "in" / "u.parquet").write_text("no table")
    (tmp_path / "in" / "empty.parquet").write_bytes(b"")
    bad_pages(tmp_path / "in" / "w.parquet", spark)
    got = {r["file_path"].rsplit("/", 1)[1]: r for r in probe(spark, str(tmp_path / "in")).filter("NOT endswith(file_path, '.d')").collect()}
    assert {k for k, r in got.items() if r["error"]} == {"u.parquet", "empty.parquet", "w.parquet"}
    assert got["t1.parquet"]["rows"] == 10 and got["t1.parquet"]["columns"] == ["id"]
    footers = {r["file_path"].rsplit("/", 1)[1] for r in probe(spark, str(tmp_path / "in"), pages=False).filter("error IS NOT NULL").collect()}
    assert footers == {"u.parquet", "empty.parquet"}
    fit = {r["file_path"].rsplit("/", 1)[1]: r["error"] for r in probe(spark, str(tmp_path / "in"), "t*.parquet", needs="id").collect()}
    assert fit == {"t0.parquet": "empty", "t1.parquet": None, "t2.parquet": "no column id"}
    rows, bad = readers.read_glob(spark, str(tmp_path / "in"), keep=lambda n: n[0] in "tuw")
    assert rows.count() == 30 and {r[0].rsplit("/", 1)[1] for r in bad.collect()} == {"u.parquet", "w.parquet"}
    with pytest.raises(OSError):
        readers.read_glob(spark, str(tmp_path / "in"), "u*.parquet")
    with pytest.raises(FileNotFoundError):
        readers.read_glob(spark, str(tmp_path / "in"), keep=lambda n: False)


def test_probe_of_bytes_that_spark_reads(spark, tmp_path, monkeypatch):
    from colloquy.sources import probe as module

    monkeypatch.setattr(module, "DIRECT", ())
    spark.range(7).coalesce(1).write.parquet(str(tmp_path / "a.parquet"))
    (tmp_path / "b.parquet").write_text("no")
    assert {(r["file_path"].rsplit("/", 1)[1], r["rows"], r["error"] is None) for r in probe(spark, str(tmp_path)).collect()} == {("a.parquet", 7, True), ("b.parquet", None, False)}


def test_many_files_cost_no_job_each(spark, tmp_path):
    spark.range(60).repartition(30).withColumn("f", F.spark_partition_id()).write.partitionBy("f").parquet(str(tmp_path / "in"))
    spark.sparkContext.setJobGroup("probe", "")
    rows, _ = readers.read_glob(spark, str(tmp_path / "in"), "f=*")
    assert rows.count() == 60
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("probe")
    spark.sparkContext.setJobGroup("rest", "")
    assert len(jobs) < 15


def test_suffixes_of_any_case(spark, tmp_path):
    import pandas as pd

    for name in ("AA.PARQUET", "bb.Pq", "AA.pq"):
        pd.DataFrame({"close": [float(len(name))]}).to_parquet(tmp_path / name)
    got = {r["ticker_norm"]: r["close"] for r in readers.read_panels(spark, str(tmp_path), ["aa", "BB"]).collect()}
    assert got == {"AA": 10.0, "BB": 5.0}


def test_each_row_has_its_own_number(spark):
    day = "Thursday, February 19, 2026 4:30 PM"
    rows = [("a", day, None), ("a", day, None), (None, day, "a"), ("a", None, None), ("a", None, None), ("", day, "a"), ("b", "Friday, February 20, 2026 4:30 PM", None)]
    df = spark.createDataFrame(rows, "title string, subheader string, body string")
    got = pipelines.numbered(df).collect()
    assert sorted(r["transcript_id"] for r in got) == list(range(7))
    assert {r["transcript_id"] for r in got if r["subheader"] is None} == {5, 6} and {r["transcript_id"] for r in got if r["title"] == "b"} == {4}
    again = {(r["title"], r["subheader"], r["body"], r["transcript_id"]) for r in pipelines.numbered(df.repartition(3)).collect()}
    assert again == {(r["title"], r["subheader"], r["body"], r["transcript_id"]) for r in got}


def test_ranks_where_all_share_a_date(spark):
    df = spark.range(5_000).select(F.lit(None).cast("date").alias("d"), F.sha2(F.col("id").cast("string"), 256).alias("h"))
    got = [r["n"] for r in sampling.global_ranks(df, "d", "h", "n").orderBy("h").collect()]
    assert got == list(range(1, 5_001))
    weighted = sampling.global_ranks(df.withColumn("w", F.lit(2)), "d", "h", "n", "w").orderBy("h").limit(3).collect()
    assert [r["n"] for r in weighted] == [2, 4, 6]


@pytest.mark.parametrize("forward", [False, True])
def test_asof_takes_the_last_or_first_of_equal_dates(spark, forward):
    day = dt.date(2024, 1, 1)
    left = spark.createDataFrame([(1, day), (1, day + dt.timedelta(days=5 if not forward else -5)), (1, day + dt.timedelta(days=400 if not forward else -400)), (2, day)], "k int, at date")
    right = spark.createDataFrame([(1, day, v) for v in (3.0, None, 9.0, 4.0)] + [(2, day, 1.0)], "k int, date date, v double")
    for parts in (1, 4):
        got = relate.asof(left, right.repartition(parts), "k", "at", "date", forward=forward).collect()
        assert {(r["k"], r["match"]["v"]) for r in got} == {(1, None if forward else 9.0), (2, 1.0)} and len(got) == 4


def test_first_of_with_ties_and_nulls(spark):
    rows = [("a", 2, "x"), ("a", 1, "z"), ("a", 1, "y"), (None, None, "q"), (None, 3, "p"), ("b", 5, None)]
    df = spark.createDataFrame(rows, "k string, o int, v string")
    assert sorted(map(tuple, relate.first_of(df, ["k"], ["o"]).collect()), key=str) == sorted([("a", 1, "y"), (None, None, "q"), ("b", 5, None)], key=str)
    assert sorted(map(tuple, relate.first_of(df, ["k"], [F.col("o") * -1]).collect()), key=str) == sorted([("a", 2, "x"), (None, None, "q"), ("b", 5, None)], key=str)
    assert relate.first_of(df.select("k"), ["k"], []).count() == 3
