"""Quality classifier: random-indexing word vectors and a two-layer network.

Word vectors: a word is all its bytes up to the signs at its end, with A-Z
lower-cased; its shape (those signs, its capitals, its length) is a word of its own.
Both are hashed to ``BUCKETS`` rows. Every row has a sparse random index vector
(``NONZERO`` entries of +-1 out of ``WIDTH``). A row's context vector is the sum of
the index vectors found beside it, over all documents, in integers, so it doesn't
depend on how the tables are cut. A document pools the mean and the spread of its
words' context vectors, and of its shapes'.

Network: tanh layer and logistic output in numpy, trained on a bounded sample of
labelled rows (``sample``, those with the least hash of their id), then a
temperature fitted on a part of it that was held back from training.

Defined cases: null or empty texts are scored like any other (a zero vector);
rows that share an id are scored each by its own text, and the least text of an id
is the one that is learned from; labels that are null or whose doc_id is null aren't used; without labels of both kinds every score is
the share of label 1 (0.5 without any); extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import add_blocks, as_blocks, documents
from .words import SIGNS, U, mix, prefix_sums, range_hash, text_chunks, word_bounds

BUCKETS, WIDTH, NONZERO, BLOCKS = 1 << 15, 32, 4, 16
HIDDEN = 32
#: Labelled rows that the network is trained on, at most.
SAMPLE = 20_000
THRESHOLD = 0.3


def index_vectors(seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(places, signs): the sparse random index vector of every row."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, WIDTH, (BUCKETS, NONZERO)), rng.choice([-1.0, 1.0], (BUCKETS, NONZERO))


def word_rows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of each word, row of its shape, first word of each text)."""
    start, end, first = word_bounds(data, offsets)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), first
    size = end - start
    tail, stem = np.zeros(len(start), U), end.copy()
    open_ = np.ones(len(start), bool)
    for k in range(1, 4):
        b = np.where(size >= k, data[np.maximum(end - k, 0)], 0)
        open_ &= SIGNS[b] & (size >= k)
        tail = (tail << U(8)) | np.where(open_, b, 0).astype(U)
        stem -= open_
    sums, down = prefix_sums(data)
    word = range_hash(sums, down, start, stem)
    upper = np.zeros(len(data) + 1, np.int32)
    np.cumsum((data >= 65) & (data <= 90), out=upper[1:])
    capitals = np.minimum(upper[end] - upper[start], 3).astype(U)
    shape = mix((tail << U(16)) | (capitals << U(8)) | np.minimum(size, 15).astype(U))
    mask = U(BUCKETS - 1)
    return (word & mask).astype(np.int64), (shape & mask).astype(np.int64), first


def context_vectors(docs: DataFrame) -> np.ndarray:
    """The unit context vector of every row, from all documents."""
    places, signs = index_vectors()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(BUCKETS * WIDTH)
        held: list[tuple] = []
        size = 0

        def flush() -> None:
            pairs = np.concatenate([a * BUCKETS + b for a, b in held])
            pairs, times = np.unique(pairs, return_counts=True)
            a, b = pairs // BUCKETS * WIDTH, pairs % BUCKETS
            for k in range(NONZERO):
                np.add(cells, np.bincount(a + places[b, k], signs[b, k] * times, len(cells)), out=cells)
            held.clear()

        for batch in batches:
            for _, _, data, off in text_chunks(batch.column(0)):
                word, tail, first = word_rows(data, off)
                inner = np.ones(max(0, len(word) - 1), bool)
                cut = first[(first > 0) & (first < len(word))]
                inner[cut - 1] = False
                a, b = word[:-1][inner], word[1:][inner]
                c, d = tail[:-1][inner], tail[1:][inner]
                held += [(a, b), (b, a), (c, d), (d, c), (word, tail), (tail, word)]
                size += 6 * len(word)
                if size > 2_000_000:
                    flush()
                    size = 0
        if held:
            flush()
        yield as_blocks(cells, BLOCKS)

    total = add_blocks(docs.select("text").mapInArrow(run, "block int, cells binary"), BLOCKS)
    c = (total if len(total) else np.zeros(BUCKETS * WIDTH)).reshape(BUCKETS, WIDTH)
    length = np.sqrt((c * c).sum(axis=1, keepdims=True))
    return (c / np.where(length > 0, length, 1)).astype(np.float32)


def pooled(data: np.ndarray, offsets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the vectors of a text's words and of their signs; one row per text."""
    word, tail, first = word_rows(data, offsets)
    n = np.diff(first).astype(np.float32)
    out = np.zeros((len(n), 4 * WIDTH), np.float32)
    some = np.flatnonzero(n > 0)
    if len(some):
        share = np.maximum(n, 1)[some, None]
        for k, rows in enumerate((word, tail)):
            v = vectors[rows]
            mean = np.add.reduceat(v, first[some], axis=0) / share
            v *= v
            square = np.add.reduceat(v, first[some], axis=0) / share
            out[some, k * 2 * WIDTH : (k * 2 + 1) * WIDTH] = mean
            out[some, (k * 2 + 1) * WIDTH : (k * 2 + 2) * WIDTH] = np.sqrt(np.maximum(square - mean * mean, 0))
    return out


class Network:
    """Two layers and a temperature."""

    def __init__(self, shift, scale, w1, b1, w2, b2, temperature=1.0):
        self.shift, self.scale, self.w1, self.b1, self.w2, self.b2, self.temperature = shift, scale, w1, b1, w2, b2, temperature

    def logit(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh(((x - self.shift) / self.scale) @ self.w1 + self.b1)
        return h @ self.w2 + self.b2

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -40, 40)))


def constant(p: float, width: int = 4 * WIDTH) -> Network:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return Network(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), float(np.log(p / (1 - p))))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 11, epochs: int = 60, rate: float = 3e-3, decay: float = 1e-4) -> Network:
    if len(y) < 10 or y.min() == y.max():
        return constant(float(y.mean()) if len(y) else 0.5, x.shape[1] if x.ndim == 2 else 4 * WIDTH)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, own = order[: len(y) // 5], order[len(y) // 5 :]
    shift, scale = x[own].mean(axis=0), x[own].std(axis=0) + 1e-3
    d = x.shape[1]
    p = [rng.normal(0, 1 / np.sqrt(d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    z = (x - shift) / scale
    batch = int(np.clip(len(own) // 30, 16, 256))
    for _ in range(epochs):
        own = rng.permutation(own)
        for s in range(0, len(own), batch):
            i = own[s : s + batch]
            h = np.tanh(z[i] @ p[0] + p[1])
            e = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - y[i]) / len(i)
            back = np.outer(e, p[2]) * (1 - h * h)
            grads = [z[i].T @ back + decay * p[0], back.sum(axis=0), h.T @ e + decay * p[2], np.array([e.sum()])]
            t += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    net = Network(shift, scale, p[0], p[1], p[2], float(p[3][0]))
    logit, best = net.logit(x[held]), None
    for temperature in np.exp(np.linspace(np.log(0.5), np.log(10), 60)):
        q = 1 / (1 + np.exp(-np.clip(logit / temperature, -40, 40)))
        loss = -np.mean(y[held] * np.log(q + 1e-9) + (1 - y[held]) * np.log(1 - q + 1e-9))
        if best is None or loss < best[0]:
            best = (loss, float(temperature))
    net.temperature = best[1]
    return net


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def quality_model(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, Network]:
    """(context vectors, network). Labels are read from rows that aren't held out."""
    vectors = context_vectors(docs)
    seen = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = (
        seen.groupBy("doc_id").agg(F.max("quality").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows of two numbers
    # One row for each label, however often its id is there.
    texts = texts.groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(vectors)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, n, data, off in text_chunks(batch.column(1)):
                x = pooled(data, off, sent.value)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, n), batch.column(2).slice(i, n), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "y", "x"]
                )

    rows = texts.select("doc_id", "text", F.col("y").cast("long").alias("y")).mapInArrow(features, "doc_id long, y long, x binary").collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["x"]))
    if not rows:
        return vectors, constant(0.5)
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in rows]).astype(np.float64)
    return vectors, fit(x, np.array([min(1, max(0, r["y"])) for r in rows], float))


def quality_scores(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    vectors, net = quality_model(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast((vectors, net))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, model = sent.value
        for batch in batches:
            for i, n, data, off in text_chunks(batch.column(1)):
                s = model(pooled(data, off, v).astype(np.float64)).astype(np.float64).reshape(-1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), pa.array(s)], ["doc_id", "score"])

    out = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(score, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, scored in place without a shuffle."""
    vectors, net = quality_model(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast((vectors, net))
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, model = sent.value
        for batch in batches:
            for i, n, data, off in text_chunks(batch.column(at)):
                good = model(pooled(data, off, v).astype(np.float64)).reshape(-1) >= THRESHOLD
                yield batch.slice(i, n).filter(pa.array(good))

    return docs.mapInArrow(keep, docs.schema)


def op2_quality(spark, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
