"""Readiness of pages, rolling shards and the windowed source, across restarts and failures."""

import collections
import datetime as dt

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from colloquy.session import settings
from colloquy.sources import windows
from colloquy.streaming import readiness, shards
from colloquy.streaming.shards import RollingShards

T0 = dt.datetime(2024, 1, 1)
WAITING = "Your document is on its way..."


def capture(page, second, body, title="t"):
    return (page, T0 + dt.timedelta(seconds=second), title, body)


class TestReadiness:
    SCHEMA = "list_item string, seen_at timestamp, title string, body string"

    def run(self, spark, tmp_path, batches, late="0 seconds", **how):
        """Each batch is a file that lands and one run over the same checkpoint."""
        out = []
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, self.SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            with settings(spark, readiness.ROCKS):
                stream = spark.readStream.schema(self.SCHEMA).parquet(str(tmp_path / "in"))
                q = readiness.ready_pages(stream, late=late, **how).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
                q.outputMode("append").trigger(availableNow=True).start().awaitTermination()
            out.append({(r["list_item"], r["status"], r["body"], r["attempts"]) for r in spark.read.schema(readiness.OUT).parquet(str(tmp_path / "out")).collect()})
        return out

    def test_ready_changing_late_and_never_across_restarts(self, spark, tmp_path):
        long = "A text that is there. " * 5
        one = [
            capture("long", 0, long), capture("slow", 0, WAITING), capture("short", 1, "ok"), capture("moves", 1, "a"), capture("never", 2, WAITING), capture("blank", 2, None), capture(None, 2, long),
        ]
        two = [capture("short", 9, " ok "), capture("slow", 20, long), capture("moves", 9, "b"), capture("long", 9, "another text"), capture("never", 30, WAITING)]
        three = [capture("moves", 40, "c"), capture("other", 60, long)]  # past the last attempts of all others
        four = [capture("never", 61, long), capture("short", 62, "ok"), capture("other", 63, long)]
        a, b, c, d = self.run(spark, tmp_path, [one, two, three, four])
        assert a == {("long", "ready", long.strip(), 0)}
        assert b - a == {("short", "ready", "ok", 0), ("slow", "ready", long.strip(), 1)}
        assert c - b == {("other", "ready", long.strip(), 0), ("moves", "late", "c", 3), ("never", "blank", "", 3), ("blank", "blank", "", 3)}
        assert d == c  # what has left is not looked at again

    def test_the_same_in_one_batch(self, spark, tmp_path):
        rows = [capture("gone", 0, WAITING), capture("gone", 50, "x" * 99), capture("edge", 0, WAITING), capture("edge", 44, "y" * 81), capture("eighty", 0, "z" * 80), capture("zzz", 200, WAITING)]
        (a,) = self.run(spark, tmp_path, [rows])
        assert a == {("gone", "blank", "", 3), ("edge", "ready", "y" * 81, 2), ("eighty", "late", "z" * 80, 3)}

    def test_state_is_cleared_after_a_while(self, spark, tmp_path):
        long = "x" * 99
        _, b, c = self.run(spark, tmp_path, [[capture("p", 0, long)], [capture("q", 500, long)], [capture("p", 501, long, "again"), capture("q", 501, long)]], keep=100)
        assert b == {("p", "ready", long, 0), ("q", "ready", long, 0)}
        back = spark.read.schema(readiness.OUT).parquet(str(tmp_path / "out"))
        assert collections.Counter(r["list_item"] for r in back.collect()) == {"p": 2, "q": 1}

    def test_a_page_with_very_many_captures(self, spark, tmp_path):
        rows = [capture("hot", 0.001 * i, str(i)) for i in range(3_500)] + [capture("hot", 5, "same"), capture("hot", 6, "same"), capture("end", 300, WAITING)]
        (a,) = self.run(spark, tmp_path, [rows])
        assert {(p, s) for p, s, *_ in a} == {("hot", "ready")}


class TestShards:
    def batch(self, spark, a, b, parts=3):
        return spark.range(a, b, 1, parts).select("id", F.concat(F.lit("v"), "id").alias("v"))

    def state(self, sink):
        rows = sorted((r["shard"], r["rows"]) for r in sink.shards().collect())
        return rows, sorted(r["id"] for r in sink.read().collect())

    def test_shards_go_on_over_batches(self, spark, tmp_path):
        sink = RollingShards(spark, str(tmp_path / "s"), 10)
        for k, (a, b) in enumerate([(0, 7), (7, 9), (9, 9), (9, 42), (42, 50), (50, 51)]):
            assert sink.write(self.batch(spark, a, b), k)
            rows, ids = self.state(sink)
            assert ids == list(range(b)) and rows == [(i, min(10, b - 10 * i)) for i in range(-(-b // 10))]
        files = list((tmp_path / "s" / "data").rglob("*.parquet"))
        assert len(files) == 6 and {len(spark.read.parquet(str(f)).columns) for f in files} == {2}

    def test_a_batch_is_written_once(self, spark, tmp_path):
        sink = RollingShards(spark, str(tmp_path / "s"), 10)
        sink.write(self.batch(spark, 0, 25), 0)
        assert not sink.write(self.batch(spark, 0, 25), 0) and self.state(sink)[1] == list(range(25))

    @pytest.mark.parametrize("when", ["before the manifest", "after the manifest"])
    def test_killed_between_write_and_commit(self, spark, tmp_path, monkeypatch, when):
        """The run dies in its second batch; the next run over the same checkpoint neither loses nor repeats a row."""
        for k in range(4):
            self.batch(spark, 13 * k, 13 * k + 13).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        commit, seen = RollingShards._commit, []

        def dies(self, batch, *rest):
            seen.append(batch)
            if when == "after the manifest":
                commit(self, batch, *rest)
            if batch == 1 and seen.count(1) == 1:
                raise OSError("killed")
            if when == "before the manifest":
                commit(self, batch, *rest)

        monkeypatch.setattr(RollingShards, "_commit", dies)
        stream = lambda: shards.rolling(spark.readStream.schema("id long, v string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), str(tmp_path / "s"), str(tmp_path / "cp"), 10)
        with pytest.raises(StreamingQueryException):
            stream().awaitTermination()
        stream().awaitTermination()
        rows, ids = self.state(RollingShards(spark, str(tmp_path / "s"), 10))
        assert ids == list(range(52)) and rows == [(i, 10) for i in range(5)] + [(5, 2)]
        assert seen.count(1) == (2 if when == "before the manifest" else 1)

    def test_first_schema_holds(self, spark, tmp_path):
        sink = RollingShards(spark, str(tmp_path / "s"), 10)
        sink.write(spark.createDataFrame([(1, "a")], "id int, v string"), 0)
        sink.write(spark.createDataFrame([("x", 2, 3.0)], "new string, ID long, w double"), 1)
        assert sink.read().dtypes == [("id", "int"), ("v", "string")] and sorted(map(tuple, sink.read().collect())) == [(1, "a"), (2, None)]
        with pytest.raises(FileNotFoundError):
            RollingShards(spark, str(tmp_path / "none")).read()

    def test_close_begins_another_shard(self, spark, tmp_path):
        sink = RollingShards(spark, str(tmp_path / "s"), 10)
        sink.write(self.batch(spark, 0, 4), 0)
        sink.close(1)
        sink.write(self.batch(spark, 4, 6), 2)
        assert self.state(sink) == ([(0, 4), (1, 2)], list(range(6)))


class TestWindows:
    def landed(self, spark, path, days):
        rows = [(10 * d + k, f"u{d}", f"<p>{d}</p>", dt.date(2024, 1, 1) + dt.timedelta(days=d)) for d in days for k in range(3)]
        windows.by_day(spark.createDataFrame(rows, windows.PAGE), path) if not rows else spark.createDataFrame(rows, windows.PAGE).write.mode("append").partitionBy("date").parquet(path)

    def options(self, path, **more):
        return {"path": path, "start": "2024-01-01", "end": "2024-01-17", "days": "5", **more}

    def test_batch_by_windows(self, spark, tmp_path):
        spark.dataSource.register(windows.PageWindows)
        self.landed(spark, str(tmp_path / "in"), [0, 1, 4, 5, 16, 40])
        df = spark.read.format("page_windows").options(**self.options(f"file://{tmp_path}/in")).load()
        assert df.rdd.getNumPartitions() == 4
        got = sorted((r["window_start"].day, r["window_end"].day, r["page_id"], r["date"].day) for r in df.filter("error IS NULL").collect())
        assert got == sorted((1 + d // 5 * 5, min(17, 5 + d // 5 * 5), 10 * d + k, d + 1) for d in (0, 1, 4, 5, 16) for k in range(3))

    def test_a_failing_window_is_a_row(self, spark, tmp_path):
        spark.dataSource.register(windows.PageWindows)
        self.landed(spark, str(tmp_path / "in"), [0, 6, 11])
        (tmp_path / "in" / "date=2024-01-08").mkdir()
        (tmp_path / "in" / "date=2024-01-08" / "bad.parquet").write_text("no table")
        df = spark.read.format("page_windows").options(**self.options(str(tmp_path / "in"))).load()
        bad = df.filter("error IS NOT NULL").collect()
        assert [(r["window_start"].day, r["page_id"]) for r in bad] == [(6, None)] and bad[0]["error"]
        assert sorted(r["page_id"] for r in df.filter("error IS NULL").collect()) == [0, 1, 2, 60, 61, 62, 110, 111, 112]
        lost = spark.read.format("page_windows").options(**self.options(str(tmp_path / "nowhere"))).load().collect()
        assert len(lost) == 4 and all("no folder" in r["error"] for r in lost)

    def test_windows_and_other_schemas(self, spark, tmp_path):
        assert [(w.start.day, w.end.day) for w in windows.windows(dt.date(2024, 1, 1), dt.date(2024, 1, 5), 2)] == [(1, 2), (3, 4), (5, 5)]
        assert windows.windows(dt.date(2024, 1, 2), dt.date(2024, 1, 1), 2) == []
        with pytest.raises(ValueError):
            windows.windows(dt.date(2024, 1, 2), dt.date(2024, 1, 5), 0)
        spark.dataSource.register(windows.PageWindows)
        self.landed(spark, str(tmp_path / "in"), [0])
        schema = "window_start date, window_end date, error string, page_id int, missing double"
        df = spark.read.format("page_windows").schema(schema).options(**self.options(str(tmp_path / "in"))).load()
        assert df.dtypes[-2:] == [("page_id", "int"), ("missing", "double")] and sorted(r["page_id"] for r in df.collect()) == [0, 1, 2]

    def test_stream_goes_on_after_a_restart(self, spark, tmp_path):
        spark.dataSource.register(windows.PageWindows)

        def run():
            stream = spark.readStream.format("page_windows").options(**self.options(str(tmp_path / "in"))).load()
            q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
            q.processAllAvailable()
            q.stop()
            return sorted(r["page_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

        self.landed(spark, str(tmp_path / "in"), [0, 3, 6])
        assert run() == [0, 1, 2, 30, 31, 32]  # the second window may still grow
        self.landed(spark, str(tmp_path / "in"), [8, 10])
        assert run() == sorted(10 * d + k for d in (0, 3, 6, 8) for k in range(3))
        self.landed(spark, str(tmp_path / "in"), [16])
        assert run() == sorted(10 * d + k for d in (0, 3, 6, 8, 10, 16) for k in range(3))
        assert run() == sorted(10 * d + k for d in (0, 3, 6, 8, 10, 16) for k in range(3))
