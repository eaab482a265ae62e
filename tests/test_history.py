"""Rows seen for the first time against a plain set, over batches, replays, merges and restarts of a stream."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.operators import history
from colloquy.operators.history import KeyHistory
from colloquy.plans.catalogue import QUERIES, SQL
from tests.conftest import same

SCHEMA = "a string, b int, v int"


def batch_of(seed, n=200):
    rng = random.Random(seed)
    hot = [("hot", 1, rng.randrange(1000)) for _ in range(n // 3)]
    return hot + [(rng.choice([None, "x", "y", f"k{rng.randrange(150)}"]), rng.choice([None, rng.randrange(5)]), rng.randrange(1000)) for _ in range(n)]


def plain(batches):
    seen, out = set(), []
    low = lambda r: tuple((x is not None, x or 0) if not isinstance(x, str) else (True, x) for x in r)
    for rows in batches:
        first = {}
        for r in sorted(rows, key=lambda r: (r[2], str(low(r)))):
            first.setdefault(r[:2], r)
        out.append({r[:2]: r[2] for k, r in first.items() if k not in seen})
        seen |= set(first)
    return out


def test_batches_with_merges_and_replays(spark, tmp_path):
    batches = [batch_of(k) for k in range(7)] + [[]]
    want, kept = plain(batches), KeyHistory(spark, f"file://{tmp_path}/h", ["a", "b"], parts=4, every=3)
    for k, rows in enumerate(batches):
        for _ in range(2 if k in (0, 3, 5) else 1):  # a batch that is run again
            got = kept.take(spark.createDataFrame(rows, SCHEMA).repartition(3), k, ["v"]).collect()
            assert {(r["a"], r["b"]): r["v"] for r in got} == want[k] and len(got) == len(want[k])
        assert len(kept.generations()) <= 4
    assert kept.generations()[0][0] == 0 and any(a < b for a, b in kept.generations())


def test_filters_keep_new_keys_from_the_join(spark, tmp_path):
    kept = KeyHistory(spark, str(tmp_path / "h"), ["id"], parts=4)
    kept.take(spark.range(20_000), 0)
    asked = kept.maybe_known(kept.keyed(spark.range(10_000, 40_000)), kept.generations())
    known, new = asked.filter("maybe").count(), asked.filter("NOT maybe").count()
    assert known + new == 30_000 and 10_000 <= known < 10_200
    assert kept.take(spark.range(10_000, 40_000), 1).count() == 20_000


def test_full_filters_change_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(history, "MOST_BITS", 1 << 3)
    monkeypatch.setattr(history, "PER_KEY", 1)
    kept = KeyHistory(spark, str(tmp_path / "h"), ["id"], parts=2)
    kept.take(spark.range(3_000), 0)
    assert kept.take(spark.range(2_000, 5_000), 1).count() == 2_000


def test_bits_are_within_the_filter():
    h = np.random.default_rng(0).integers(-(2**63), 2**63, 1000)
    bits = history.bits_of(h, h[::-1], 1 << 10)
    assert bits.shape == (1000, history.HASHES) and bits.min() >= 0 and bits.max() < 1 << 10


def test_stream_across_restarts(spark, tmp_path):
    batches = [batch_of(k, 60) for k in range(4)]
    want = {k for part in plain(batches) for k in part}
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        history.first_seen(stream, ["a", "b"], str(tmp_path / "h"), str(tmp_path / "out"), str(tmp_path / "cp"), ["v"], every=2).awaitTermination()
    got = [(r["a"], r["b"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert same(spark, QUERIES["history_dedup"](spark, sf), SQL["history_dedup"], {"documents": f"{sf}/documents.parquet"}) > 100
