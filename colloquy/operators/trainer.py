"""Softmax regression on hashed words, trained by distributed gradients; grids of configurations tried a task each with successive halving.

A text is its words (runs of a-z and 0-9, lower-cased, and other signs one by one), hashed to one of 2**bits features with weight 1 / sqrt(words). Weights start at zero, sums
of gradients are integers (fixed point), so a rerun over the same files gives the same model.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import work_folder

BITS, BLOCKS = 16, 8
#: Units of a gradient's sum.
UNIT = float(1 << 32)
WORD = r"[a-z0-9]+|[^a-z0-9\x00-\x20]"
#: Words (of a row more, if it has more) that are looked at together: what a task holds beside its batch.
TOGETHER = 200_000
FEATURES = "label int, part string, words array<int>"


def features(df: DataFrame, text: str, label: str, part: str, bits: int = BITS) -> DataFrame:
    """(label, part, words): rows without a label are left out, a null text has no words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(WORD), F.lit(0))
    hashed = F.transform(words, lambda w: (F.crc32(w.cast("binary")) % (1 << bits)).cast("int"))
    return df.filter(F.col(label).isNotNull()).select(F.col(label).cast("int").alias("label"), F.col(part).alias("part"), hashed.alias("words"))


def flat(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all rows one after the other, their rows, weights of the rows)."""
    words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
    sizes = np.diff(words.offsets.to_numpy())
    return words.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(sizes)), sizes), 1 / np.sqrt(np.maximum(1, sizes))


def slices(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """(first row, rows) of runs of rows with ``most`` in all, or of one row."""
    start, total, k = 0, 0, -1
    for k, n in enumerate(sizes):
        if k > start and total + n > most:
            yield start, k - start
            start, total = k, 0
        total += n
    if k >= start:
        yield start, k + 1 - start


def probabilities(w: np.ndarray, at: np.ndarray, row: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """w: (features + 1 for the bias) x classes."""
    z = np.stack([np.bincount(row, w[at, k], len(scale)) * scale for k in range(w.shape[1])], axis=1) + w[-1]
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradient(p: np.ndarray, y: np.ndarray, at: np.ndarray, row: np.ndarray, scale: np.ndarray, size: int) -> np.ndarray:
    d = p.copy()
    d[np.arange(len(y)), y] -= 1
    per = (d * scale[:, None])[row]
    out = np.stack([np.bincount(at, per[:, k], size) for k in range(p.shape[1])], axis=1).astype(float)  # of no rows it is integers
    out[-1] += d.sum(axis=0)
    return out


def macro_f1(confusion: np.ndarray) -> float:
    """Over the classes that are there or guessed."""
    hit, there, said = np.diag(confusion), confusion.sum(axis=1), confusion.sum(axis=0)
    seen = (there + said) > 0
    return float((2 * hit[seen] / (there + said)[seen]).mean()) if seen.any() else 0.0


@dataclass
class Softmax:
    """A callable from texts to label ids."""

    weights: np.ndarray
    bits: int
    f1: float = 0.0
    rounds: int = 0

    def words_of(self, text: str | None) -> list[int]:
        return [zlib.crc32(w.encode()) % (1 << self.bits) for w in re.findall(WORD, (text or "").lower())]

    def scores(self, texts) -> np.ndarray:
        texts, parts = list(texts), [np.zeros((0, self.weights.shape[1]))]
        for start, n in slices((len(t or "") for t in texts), TOGETHER):  # a word is a sign at least
            rows = [self.words_of(t) for t in texts[start : start + n]]
            parts.append(probabilities(self.weights, *flat(pa.array(rows, pa.list_(pa.int32())))))
        return np.concatenate(parts)

    def __call__(self, texts) -> np.ndarray:
        return self.scores(texts).argmax(axis=1)


class Adam:
    def __init__(self, shape: tuple, rate: float, decay: float):
        self.m, self.v, self.t, self.rate, self.decay = np.zeros(shape), np.zeros(shape), 0, rate, decay

    def step(self, w: np.ndarray, g: np.ndarray, rate: float | None = None) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * g
        self.v = 0.999 * self.v + 0.001 * g * g
        m, v = self.m / (1 - 0.9**self.t), self.v / (1 - 0.999**self.t)
        rate = self.rate if rate is None else rate
        return w - rate * (m / (np.sqrt(v) + 1e-8) + self.decay * w)


def fit(
    train: DataFrame, valid: DataFrame, text: str = "chunk_text", label: str = "labels", classes: int = 3, bits: int = BITS, rounds: int = 40, rate: float = 0.3,
    decay: float = 0.01, patience: int = 10,
) -> Softmax:
    """The weights of the round with the best macro F1 on ``valid``; it ends after ``patience`` rounds without a better one.

    A round is one pass: tasks add up the gradient of their training rows and the confusion of their validation rows, ``BLOCKS`` tasks add these up, and
    as many rows of fixed size reach the driver. Labels are 0 .. classes - 1; others raise.
    """
    spark, size = train.sparkSession, (1 << bits) + 1
    path = work_folder(spark, "features")
    both = features(train.withColumn("_part", F.lit("train")), text, label, "_part", bits).unionByName(features(valid.withColumn("_part", F.lit("valid")), text, label, "_part", bits))
    both.write.parquet(path)
    rows = spark.read.schema(FEATURES).parquet(path)
    ends = rows.agg(F.count_if(F.col("part") == "train").alias("n"), F.count_if(~F.col("label").between(0, classes - 1)).alias("odd")).first()
    if ends["odd"]:
        raise ValueError(f"{ends['odd']} labels aren't in 0 .. {classes - 1}")
    n, w = max(1, ends["n"]), np.zeros((size, classes))
    adam, best, since = Adam(w.shape, rate, decay), Softmax(w, bits, -1.0), 0

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                total[k] = total.get(k, 0) + np.frombuffer(v.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["block", "cells"])

    for turn in range(rounds):
        sent = spark.sparkContext.broadcast(w)  # 2**bits rows

        def step(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            now, g, confusion = sent.value, np.zeros((size, classes)), np.zeros((classes, classes), np.int64)
            for whole in batches:
                for start, n in slices(pc.list_value_length(whole.column(2)).to_pylist(), TOGETHER):
                    batch = whole.slice(start, n)
                    y, part = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist())
                    at, row, scale = flat(batch.column(2))
                    p = probabilities(now, at, row, scale)
                    np.add.at(confusion, (y[part == "valid"], p[part == "valid"].argmax(axis=1)), 1)
                    own = np.flatnonzero(part == "train")
                    new = np.full(len(y), -1)
                    new[own] = np.arange(len(own))
                    mine = new[row] >= 0
                    g += gradient(p[own], y[own], at[mine], new[row[mine]], scale[own], size)
            cells = np.concatenate([np.rint(g * UNIT).astype(np.int64).ravel(), confusion.ravel()])
            parts = np.array_split(cells, BLOCKS)
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([c.tobytes() for c in parts], pa.binary())], ["block", "cells"])

        schema = "block int, cells binary"
        got = rows.mapInArrow(step, schema).repartition(BLOCKS, "block").mapInArrow(added, schema).collect()
        sent.destroy()
        cells = np.concatenate([np.frombuffer(r["cells"], np.int64) for r in sorted(got, key=lambda r: r["block"])])
        f1 = macro_f1(cells[size * classes :].reshape(classes, classes))
        if f1 > best.f1:
            best, since = Softmax(w, bits, f1, turn), 0
        elif (since := since + 1) >= patience:
            break
        w = adam.step(w, cells[: size * classes].reshape(size, classes) / UNIT / n)
    return best


# Trials

@dataclass
class Sample:
    """Features of a bounded sample, as a task holds it."""

    label: np.ndarray
    train: np.ndarray
    words: pa.Array

    @classmethod
    def of(cls, table: pa.Table) -> Sample:
        return cls(table["label"].to_numpy(), np.array(table["part"].to_pylist()) == "train", table["words"].combine_chunks())


def minibatches(sample: Sample, classes: int, bits: int, seed: int, *, lr: float, batch: int, epochs: int, warmup: float, decay: float, share: float = 1.0) -> tuple[float, int]:
    """(macro F1 on the validation rows, steps) of one configuration after ``share`` of its epochs: mini batches in a seeded order, a rate that rises over ``warmup`` of all steps and falls to zero at the end."""
    size = (1 << bits) + 1
    own, w = np.flatnonzero(sample.train), np.zeros((size, classes))
    adam, rng = Adam(w.shape, lr, decay), np.random.default_rng(seed)
    each = max(1, -(-len(own) // batch))
    every, steps = each * epochs, max(1, round(each * epochs * share))
    order = np.concatenate([rng.permutation(own) for _ in range(epochs)]) if len(own) else own
    for t in range(steps if len(own) else 0):
        e, k = divmod(t, each)
        rows = order[e * len(own) + k * batch : e * len(own) + min(len(own), (k + 1) * batch)]
        at, row, scale = flat(sample.words.take(pa.array(rows)))
        p = probabilities(w, at, row, scale)
        rise = max(1, round(warmup * every))
        rate = lr * (min(1.0, (t + 1) / rise) if t < rise else (every - t) / max(1, every - rise))
        w = adam.step(w, gradient(p, sample.label[rows], at, row, scale, size) / max(1, len(rows)), rate)
    rest, confusion = np.flatnonzero(~sample.train), np.zeros((classes, classes), np.int64)
    if len(rest):
        guess = probabilities(w, *flat(sample.words.take(pa.array(rest)))).argmax(axis=1)
        np.add.at(confusion, (sample.label[rest], guess), 1)
    return macro_f1(confusion), steps


def trials(
    grid: DataFrame, rows: DataFrame, text: str, label: str, part: str, order: str, classes: int, bits: int = 12, sample: int = 5_000, seed: int = 42, rungs: int = 3, keep: int = 3,
) -> DataFrame:
    """A row for each configuration (lr, batch, epochs, warmup, decay) and rung it reached: trial, the configuration, rung (from 1), eval_f1, steps, place.

    All configurations train for a part of their epochs; the best ``1 / keep`` of them go on to the next rung with ``keep`` times that part, so the last rung
    has whole runs. One task trains one configuration over a split that all share: the first ``sample`` rows by hash of ``order`` (a bound, since a task
    holds it), written once to the shared folder. ``part`` is 'train' or 'valid'. Ties go to the earlier configuration.
    """
    spark, path = rows.sparkSession, work_folder(rows.sparkSession, "trials")
    picked = rows.filter(F.col(label).isNotNull() & F.col(part).isin("train", "valid")).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(order).cast("string")).cast("binary")), order).limit(sample)
    features(picked, text, label, part, bits).coalesce(1).write.parquet(f"{path}/split")
    names = ["lr", "batch", "epochs", "warmup", "decay"]
    left = [r.asDict() for r in grid.select(*names).distinct().orderBy(*names).collect()]  # the configurations
    left = [{"trial": i, **c} for i, c in enumerate(left)]
    at, schema = f"{path}/split", "trial int, lr double, batch int, epochs int, warmup double, decay double, rung int, eval_f1 double, steps long"
    made = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        split = None
        for b in batches:
            for c in b.to_pylist():
                if split is None:
                    system, folder = fs.FileSystem.from_uri(at)
                    split = Sample.of(pq.read_table(folder, filesystem=system))
                f1, steps = minibatches(split, classes, bits, seed, share=c["share"], **{n: c[n] for n in names})
                out = {**{n: c[n] for n in ("trial", *names, "rung")}, "eval_f1": f1, "steps": steps}
                yield pa.RecordBatch.from_pylist([out], pa.schema([("trial", pa.int32()), ("lr", pa.float64()), ("batch", pa.int32()), ("epochs", pa.int32()), ("warmup", pa.float64()), ("decay", pa.float64()), ("rung", pa.int32()), ("eval_f1", pa.float64()), ("steps", pa.int64())]))

    for rung in range(1, rungs + 1):
        share = keep ** -(rungs - rung)
        asked = spark.createDataFrame([(c["trial"], float(c["lr"]), int(c["batch"]), int(c["epochs"]), float(c["warmup"]), float(c["decay"]), rung, float(share)) for c in left],
                                      "trial int, lr double, batch int, epochs int, warmup double, decay double, rung int, share double")
        out = asked.repartition(len(left), "trial").mapInArrow(run, schema) if left else asked.drop("share").withColumns({"eval_f1": F.lit(0.0), "steps": F.lit(0).cast("long")})
        out.write.parquet(f"{path}/rung={rung}")
        made.append(spark.read.schema(schema).parquet(f"{path}/rung={rung}"))
        best = sorted(made[-1].select("trial", "eval_f1").collect(), key=lambda r: (-r["eval_f1"], r["trial"]))  # a row for each configuration
        stay = {r["trial"] for r in best[: -(-len(best) // keep)]}
        left = [c for c in left if c["trial"] in stay]
    all_ = made[0]
    for m in made[1:]:
        all_ = all_.unionByName(m)
    from pyspark.sql import Window

    return all_.withColumn("place", F.row_number().over(Window.partitionBy("rung").orderBy(F.desc("eval_f1"), "trial")))
