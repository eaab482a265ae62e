"""Rounds of the line dedup: how many there are, that they don't change the result, and what they leave."""

import random

import pytest
from pyspark.sql import functions as F

from colloquy.llm import line_dedup


def rows_of(n):
    rng = random.Random(8)
    pool = [f"a line that some documents share {k}" for k in range(40)]
    return [(i, "\n".join(rng.choice(pool) if rng.random() < 0.6 else f"own line {i} {k} of this one" for k in range(rng.randint(0, 6)))) for i in range(n)]


def test_rounds_are_logarithmic():
    assert line_dedup.batch_ends(100, 100) == [] and line_dedup.batch_ends(0, 100) == []
    assert line_dedup.batch_ends(800, 100) == [1 / 8, 1 / 4, 1 / 2]
    assert len(line_dedup.batch_ends(10**10, line_dedup.BATCH)) == 17


@pytest.mark.parametrize("batch", [3, 60])
def test_the_same_result_in_few_and_many_rounds(spark, batch, monkeypatch):
    rows = rows_of(200)
    left = []
    monkeypatch.setattr(line_dedup, "drop_folder", lambda s, f: left.append(f))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in line_dedup.line_dedup(df, batch=batch).collect()}
    seen, want = {}, {}
    for i, t in rows:
        for x in {y.strip().lower() for y in t.split("\n")}:
            seen.setdefault(x, []).append(i)
    for i, t in rows:
        lines = t.split("\n")
        kept = [x for x in lines if len(x.strip()) < 10 or len(seen[x.strip().lower()]) < 2 or min(seen[x.strip().lower()]) == i]
        want[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    assert got == want
    assert len(left) == len(line_dedup.batch_ends(200, batch)) + 1


def test_the_plan_does_not_grow_with_the_rounds(spark):
    df = spark.createDataFrame(rows_of(200), "doc_id long, text string")
    few, many = (line_dedup.line_dedup(df, batch=b)._jdf.queryExecution().analyzed().toString() for b in (200, 3))
    assert abs(len(few.splitlines()) - len(many.splitlines())) <= 1
