"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Test items are cut into passages of at most ``PASSAGE`` words. Every run of
``SEED`` words of a passage is a seed. A first pass counts, over all documents,
in how many each seed stands. A second pass looks for the seeds; each meets its
item on a diagonal (place in the document less place in the passage), and every
diagonal band with a rare seed is aligned: match 2, mismatch -1, gap -1, on the
words around, as far as an alignment of ``threshold`` through the seed can stray. A band whose seeds are all common beside the other seeds of their
item is aligned too, unless so few words of the passage stand in its window that
no alignment could reach the threshold: so common seeds cost little and lose nothing.
The score is the alignment's share of a full copy's; at ``threshold`` or more the
document holds the item, copied, edited or paraphrased.

Passages are taken in blocks of ``ITEMS`` words, each a pass over the documents, so
what is sent to the tasks has a fixed bound however large the test set is. A seed's
occurrences decide nothing but the cheaper way to the same result.

Defined cases: words are runs of letters and digits, with A-Z lower-cased; an
item of fewer words than a seed can't be found, nor can an alignment in which no run
of ``SEED`` words is copied; null texts and items are empty;
items that share an id are all its texts; rows with a null item_id are ignored;
rows that share a doc_id are told together with their best score, and so are
those whose id is null (``clean_of`` judges every row by its own text instead);
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents
from .words import SIGNS, U, mix, text_chunks, word_hashes

SEED, PASSAGE, BAND = 3, 64, 32
ITEMS = 200_000
THRESHOLD = 0.5


def grams(words: np.ndarray) -> np.ndarray:
    """The hash of each run of SEED words."""
    n = len(words) - SEED + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, U)
    for k in range(SEED):
        out += words[k : k + n] * U(0x9E3779B97F4A7C15 * (2 * k + 1) & ((1 << 64) - 1))
    return mix(out)


def passages_of(text: str) -> Iterator[np.ndarray]:
    """The words of a test item in passages of at most PASSAGE words; the last one reaches back to have as many."""
    for _, _, data, off in text_chunks(pa.array([text], pa.string())):
        words, _ = word_hashes(data, off, SIGNS)
        n = len(words)
        starts = list(range(0, max(1, n - PASSAGE + 1), PASSAGE))
        if n > PASSAGE and n % PASSAGE:
            starts.append(n - PASSAGE)
        for s in starts if n else []:
            yield words[s : min(n, s + PASSAGE)]


class Items:
    """The passages of a block of test items and their seeds in order of their hash."""

    def __init__(self, ids: list[int], passages: list[np.ndarray]):
        self.item, self.words = np.array(ids, np.int64), passages
        seeds = [grams(w) for w in self.words]
        n = [len(s) for s in seeds]
        hashes = np.concatenate(seeds) if seeds else np.zeros(0, U)
        order = np.argsort(hashes, kind="stable")
        self.hash = hashes[order]
        self.passage = np.repeat(np.arange(len(n)), n)[order]
        self.offset = np.concatenate([np.arange(k) for k in n] or [np.zeros(0, int)])[order]
        self.value, self.first, self.times = np.unique(self.hash, return_index=True, return_counts=True)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.value >> U(44)).astype(np.int64)] = True
        self.rare = np.ones(len(self.hash), bool)

    def hits(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``found``, number in ``value``) of the grams that are seeds."""
        at = np.flatnonzero(self.maybe[(found >> U(44)).astype(np.int64)])
        if not len(at) or not len(self.value):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k = np.minimum(np.searchsorted(self.value, found[at]), len(self.value) - 1)
        good = self.value[k] == found[at]
        return at[good], k[good]

    def keep_rare(self, documents_with: np.ndarray) -> None:
        """Tell seeds far more common than a quarter of the seeds of their passage from the rest."""
        if not len(self.hash):
            return
        df = np.repeat(documents_with, self.times)
        order = np.lexsort((df, self.passage))
        first = np.flatnonzero(np.r_[True, np.diff(self.passage[order]) > 0])
        size = np.diff(np.append(first, len(order)))
        quarter = np.zeros(len(self.words))
        quarter[self.passage[order[first]]] = df[order[first + (size - 1) // 4]]
        self.rare = df <= 16 + 8 * quarter[self.passage]


def text_grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, first word of each text, grams); grams that cross texts are harmless hits that alignment refuses."""
    words, first = word_hashes(data, off, SIGNS)
    return words, first, grams(words)


def align(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman of the rows of ``a`` and ``b``: (best score, column of ``b`` where it ends). Padding never matches."""
    rows, width = b.shape
    gap = np.arange(width, dtype=np.int32)
    above = np.zeros((rows, width + 1), np.int32)
    best, where = np.zeros(rows, np.int32), np.zeros(rows, np.int64)
    for i in range(a.shape[1]):
        step = np.where(a[:, i : i + 1] == b, 2, -1)
        now = np.maximum(np.maximum(above[:, :-1] + step, above[:, 1:] - 1), 0)
        now = np.maximum.accumulate(now + gap, axis=1) - gap
        top = now.argmax(axis=1)
        value = now[np.arange(rows), top]
        better = value > best
        best[better], where[better] = value[better], top[better]
        above[:, 1:] = now
    return best, where


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word): the best alignment of each document with each item it holds."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for items in blocks_of(tests_of(benchmark)):
        found = scan(spark, rows, items, threshold)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "doc_id long, item_id long, score double, start_word long, end_word long")
    best = F.max(F.struct("score", (-F.col("start_word")).alias("s"), "end_word"))
    return out.groupBy("doc_id", "item_id").agg(best.alias("b")).select(
        "doc_id", "item_id", "b.score", (-F.col("b.s")).alias("start_word"), F.col("b.end_word").alias("end_word")
    )


def blocks_of(tests: DataFrame) -> Iterator[Items]:
    """The passages of the test items in blocks of at most ITEMS words (and one passage), read one row after the other."""
    ids, passages, size = [], [], 0
    for r in tests.orderBy("i", "t").toLocalIterator():
        for words in passages_of(r["t"]):
            ids.append(r["i"])
            passages.append(words)
            size += len(words)
            if size >= ITEMS:
                yield Items(ids, passages)
                ids, passages, size = [], [], 0
    if ids:
        yield Items(ids, passages)


def counted(rows: DataFrame, items: Items) -> Items:
    """The items with their common seeds told from the rare ones, by one pass over ``rows``."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(items)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        total = np.zeros(len(own.value), np.int64)
        for batch in batches:
            for _, n, data, off in text_chunks(batch.column(0)):
                _, first, found = text_grams(data, off)
                at, k = own.hits(found)
                text = np.searchsorted(first, at, "right") - 1
                total += np.bincount(np.unique(text * len(total) + k) % max(1, len(total)), minlength=len(total))[: len(total)] if len(at) else 0
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["seed", "n"])

    found = rows.select("text").mapInArrow(count, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(len(items.value), np.int64)
    for r in found:  # at most one row per seed of the block
        df[r["seed"]] = r["n"]
    sent.destroy()
    items.keep_rare(df)
    return items


def found_in(own: Items, texts: pa.Array, threshold: float) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, item, score, start, end) of the alignments in a batch of texts."""
    for i, n, data, off in text_chunks(texts):
        words, first, found = text_grams(data, off)
        at, k = own.hits(found)
        if not len(at):
            continue
        # Each seed in each of its passages.
        reps = own.times[k]
        at = np.repeat(at, reps)
        seed = np.repeat(own.first[k], reps) + np.arange(len(at)) - np.repeat(np.cumsum(reps) - reps, reps)
        text = np.searchsorted(first, at, "right") - 1
        band = (at - own.offset[seed]) // BAND
        cells, cell = np.unique(np.stack([text, own.passage[seed], band]), axis=1, return_inverse=True)
        sure = np.bincount(cell.reshape(-1), own.rare[seed], cells.shape[1]) > 0
        for s in range(0, cells.shape[1], 1024):
            part = judged(own, cells[:, s : s + 1024], sure[s : s + 1024], words, first, threshold)
            if part is not None:
                yield i + part[0], *part[1:]


def scan(spark, rows: DataFrame, items: Items, threshold: float) -> DataFrame:
    chosen = spark.sparkContext.broadcast(counted(rows, items))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, item, score, a, b in found_in(chosen.value, batch.column(1), threshold):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), pa.array(item, pa.int64()), pa.array(score), pa.array(a), pa.array(b)],
                    ["doc_id", "item_id", "score", "start_word", "end_word"],
                )

    return rows.mapInArrow(search, "doc_id long, item_id long, score double, start_word long, end_word long")


def able(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, threshold: float) -> np.ndarray:
    """Whether enough words of each row of ``a`` stand in its row of ``b`` for a score of ``threshold``: each match gives 2, nothing else gives more than 0."""
    row = np.arange(len(a), dtype=np.int64)[:, None] << 40
    there = np.unique((b & ((1 << 40) - 1)) | row)
    wanted = (a & ((1 << 40) - 1)) | row
    at = np.minimum(np.searchsorted(there, wanted), len(there) - 1)
    inside = (there[at] == wanted) & (np.arange(a.shape[1])[None, :] < sizes[:, None])
    return 2 * inside.sum(axis=1) / (2.0 * sizes) >= threshold


def judged(own: Items, cells: np.ndarray, sure: np.ndarray, words: np.ndarray, first: np.ndarray, threshold: float):
    text, passage, band = cells
    sizes = np.array([len(own.words[p]) for p in passage])
    m = int(sizes.max())
    # At most 2 m (1 - threshold) gaps fit into a score of the threshold.
    slack = int(np.ceil(2 * m * (1 - threshold)))
    width = m + BAND + 2 * slack
    a = np.zeros((len(text), m), np.int64)
    real = np.arange(m)[None, :] < sizes[:, None]
    a[real] = np.concatenate([own.words[p] for p in passage]).view(np.int64)
    at = (band * BAND - slack)[:, None] + np.arange(width)[None, :]
    lo, hi = first[text][:, None], first[text + 1][:, None]
    inside = (at >= lo) & (at < hi)
    b = np.where(inside, words.view(np.int64)[np.clip(at, 0, max(0, len(words) - 1))], 1)
    a[~real] = 0  # neither padding equals the other; a true hash equal to 0 or 1 is not to be expected
    left = sure.copy()
    if not sure.all():
        rest = np.flatnonzero(~sure)
        left[rest] = able(a[rest], b[rest], sizes[rest], threshold)
    if not left.any():
        return None
    text, passage, band, sizes, a, b = (x[left] for x in (text, passage, band, sizes, a, b))
    best, end = align(a, b)
    score = best / (2.0 * sizes)
    good = np.flatnonzero(score >= threshold)
    if not len(good):
        return None
    # The alignment of the reversed words ends where this one starts.
    flip = np.zeros((len(good), m), np.int64)
    for r, g in enumerate(good):
        flip[r, : sizes[g]] = a[g, : sizes[g]][::-1]
    back = b[good].copy()
    back[np.arange(width)[None, :] > end[good][:, None]] = 1
    _, start = align(flip, back[:, ::-1].copy())
    start = width - 1 - start
    origin = (band[good] * BAND - slack) - first[text[good]]
    return text[good], own.item[passage[good]], score[good], origin + start, origin + end[good] + 1


def tests_of(benchmark: DataFrame) -> DataFrame:
    return benchmark.filter("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("i"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))


def clean_of(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that hold no test item. Each row is judged where it stands, by its own text: no key, no exchange."""
    spark, at, out = docs.sparkSession, docs.columns.index("text"), docs
    rows = docs.select(F.col("text").cast("string").alias("text"))
    for items in blocks_of(tests_of(benchmark)):
        out = out.mapInArrow(without(spark.sparkContext.broadcast(counted(rows, items)), at, threshold), docs.schema)
    return out


def without(chosen, at: int, threshold: float):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.ones(batch.num_rows, bool)
            for row, *_ in found_in(chosen.value, batch.column(at), threshold):
                good[row] = False
            yield batch.filter(pa.array(good))

    return keep


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
