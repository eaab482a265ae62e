"""The trainer against a plain loop, on held-out rows, and the trials against one configuration at a time."""

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from colloquy.operators import sampling, trainer
from colloquy.plans import pipelines
from colloquy.plans.catalogue import QUERIES

KINDS = {0: "flat steady unchanged even", 1: "growth strong record gain", 2: "loss decline weak miss"}


def rows_of(n, seed, noise=0.1):
    rng, out = random.Random(seed), []
    for i in range(n):
        k = rng.randrange(3)
        words = rng.choices(KINDS[k].split(), k=rng.randint(1, 6)) + rng.choices("the of and Quarter year 2024 é".split(), k=rng.randint(0, 9))
        rng.shuffle(words)
        out.append((i, " ".join(words), rng.randrange(3) if rng.random() < noise else k))
    return out


def plain_loop(train, valid, classes, bits, rounds, rate, decay):
    """The same training, row by row."""
    size = (1 << bits) + 1
    w, m, v = np.zeros((size, classes)), np.zeros((size, classes)), np.zeros((size, classes))

    def guess(text):
        words = [zlib.crc32(x.encode()) % (1 << bits) for x in re.findall(r"[a-z0-9]+|[^a-z0-9\x00-\x20]", (text or "").lower())]
        z = w[-1].copy()
        for x in words:
            z += w[x] / math.sqrt(len(words))
        e = np.exp(z - z.max())
        return words, e / e.sum()

    best = (-1.0, None)
    for t in range(1, rounds + 1):
        confusion = np.zeros((classes, classes))
        for _, text, y in valid:
            confusion[y, guess(text)[1].argmax()] += 1
        f1 = np.mean([2 * confusion[k, k] / (confusion[k].sum() + confusion[:, k].sum()) for k in range(classes)])
        if f1 > best[0]:
            best = (f1, w.copy())
        g = np.zeros_like(w)
        for _, text, y in train:
            words, p = guess(text)
            p[y] -= 1
            for x in words:
                g[x] += p / math.sqrt(len(words))
            g[-1] += p
        g /= len(train)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8) + decay * w)
    return best


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, chunk_text string, labels int")


def test_fit_against_a_plain_loop(spark):
    train, valid = rows_of(120, 1), rows_of(50, 2)
    train[0] = (0, None, 1)
    got = trainer.fit(frame(spark, train).repartition(4), frame(spark, valid), bits=8, rounds=6, rate=0.05, patience=9)
    f1, w = plain_loop(train, valid, 3, 8, 6, 0.05, 0.01)
    assert got.f1 == pytest.approx(f1) and np.allclose(got.weights, w, atol=1e-5)
    again = trainer.fit(frame(spark, train).repartition(4), frame(spark, valid), bits=8, rounds=6, rate=0.05, patience=9)
    assert np.array_equal(again.weights, got.weights)


def test_held_out_and_early_stop(spark):
    model = trainer.fit(frame(spark, rows_of(600, 3, 0.05)), frame(spark, rows_of(200, 4, 0.05)), bits=10, rounds=30, rate=0.05, patience=3)
    test = rows_of(300, 5, 0.0)
    assert np.mean(model([t for _, t, _ in test]) == [y for *_, y in test]) > 0.95 and model.rounds < 29
    assert model([]).tolist() == [] and len(model([None, "", "é"])) == 3


def test_odd_labels(spark):
    with pytest.raises(ValueError, match="labels"):
        trainer.fit(frame(spark, [(1, "a", 5)]), frame(spark, []), bits=4, rounds=1)
    assert trainer.fit(frame(spark, [(1, "a", None)]), frame(spark, []), bits=4, rounds=2).weights.shape == (17, 3)


def test_default_of_the_pipeline(spark, tmp_path):
    rows = [(f"c{i}", f"t{i % 60}", f"2024-01-{i % 60 % 28 + 1:02d}", t, ["neutral", "positive", "negative"][y], "ok") for i, t, y in rows_of(400, 6, 0.0)]
    spark.createDataFrame(rows, "chunk_id string, transcript_id string, date string, chunk_text string, label string, label_status string").write.parquet(str(tmp_path / "in"))
    out = pipelines.train_model(spark, str(tmp_path / "in"), str(tmp_path / "ready"))
    assert out["macro_f1"] > 0.9 and out["accuracy"] > 0.9


def test_trials_in_rungs(spark):
    rows = [(i, t, y, "valid" if i % 4 == 0 else "train") for i, t, y in rows_of(300, 7)]
    df = spark.createDataFrame(rows, "id long, chunk_text string, labels int, part string")
    grid = sampling.grid(spark, lr=[0.001, 0.05, 0.2], batch=[8, 16], epochs=[2], warmup=[0.0, 0.1], decay=[0.0])
    got = trainer.trials(grid, df, "chunk_text", "labels", "part", "id", 3, bits=8, sample=200).collect()
    sizes = [sum(r["rung"] == k for r in got) for k in (1, 2, 3)]
    assert sizes == [12, 4, 2]
    by_rung = {k: {r["trial"]: r for r in got if r["rung"] == k} for k in (1, 2, 3)}
    for k in (1, 2):
        ranked = sorted(by_rung[k].values(), key=lambda r: (-r["eval_f1"], r["trial"]))
        assert {r["trial"] for r in ranked[: sizes[k]]} == set(by_rung[k + 1]) and [r["place"] for r in ranked] == list(range(1, sizes[k - 1] + 1))
    # One configuration by itself over the same sample gives the same measure.
    picked = df.orderBy(F.md5(F.concat_ws(":", F.lit("42"), F.col("id").cast("string")).cast("binary")), "id").limit(200)
    table = pa.Table.from_pandas(trainer.features(picked, "chunk_text", "labels", "part", 8).toPandas(), schema=pa.schema([("label", pa.int32()), ("part", pa.string()), ("words", pa.list_(pa.int32()))]))
    for r in got:
        own = {n: r[n] for n in ("lr", "batch", "epochs", "warmup", "decay")}
        f1, steps = trainer.minibatches(trainer.Sample.of(table), 3, 8, 42, share=3.0 ** -(3 - r["rung"]), **own)
        assert f1 == pytest.approx(r["eval_f1"]) and steps == r["steps"]
    assert max(r["eval_f1"] for r in by_rung[3].values()) > 0.8


def test_queries(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["trained_scores"](spark, sf).collect()
    assert len(rows) > 50 and np.mean([r["label"] == r["guess"] for r in rows]) > 0.85
    assert sum(r["rung"] == 1 for r in QUERIES["model_trials"](spark, sf).collect()) == 48


def test_scores_hold_a_bounded_number_of_words():
    """Long texts are scored some at a time, with the same scores."""
    import tracemalloc

    rng = np.random.default_rng(3)
    model = trainer.Softmax(rng.normal(size=((1 << 8) + 1, 2)), 8)
    texts = [" ".join(rng.choice(["a", "b", "cc", "d1", "."], 20_000)) for _ in range(60)] + [None, ""]
    want = np.concatenate([model.scores([t]) for t in texts])
    tracemalloc.start()
    got = model.scores(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(got, want) and peak < 30e6
    assert model.scores([]).shape == (0, 2)
    assert list(trainer.slices([3, 9, 1, 1, 1], 3)) == [(0, 1), (1, 1), (2, 3)] and list(trainer.slices([], 3)) == []
