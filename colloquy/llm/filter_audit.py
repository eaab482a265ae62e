"""What filters of documents do alone, together and in every order.

Tasks read the Arrow buffers of whole texts: byte classes and prefix sums count words, capitals, signs and code points, sorted hashes
of a document's words count the distinct ones (equal neighbours are compared byte by byte; a document where two words share a hash is
counted by its words), and a mask of failures is left of each text beside a SHA-256. Masks are then counted by groups;
per part a table of 32 masks gives all orders.

Filters: A, under 50 words; B, 100 * distinct words < 65 * words; C, 100 * capitals > 5 * code points; D, holds one of ``#$%&*|``;
E, the same text under a smaller id. Rows of one text are first counted by id, part and label where the labels join them, then
by text and part, so that a text that a third of all rows hold is a row for each part when it meets itself.

Defined cases: a null or empty text has no words and fails A alone (and E); null sources and empty ones are one part; a null id is
larger than any other, and rows that share an id and text are copies of neither; a row without a label (or with a null one, or a null id) is
neither good nor toxic, one of several labels of an id is enough; an empty table has no parts and gives no row; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import MAX_ID, documents, id_key
from .words import SPACE, prefix_sums, range_hash, text_chunks, word_bounds

FILTERS = "ABCDE"
CAPITAL = np.zeros(256, bool)
CAPITAL[ord("A") : ord("Z") + 1] = True
SIGN = np.zeros(256, bool)
SIGN[[ord(c) for c in "#$%&*|"]] = True
#: Bytes that begin a code point.
FIRST = (np.arange(256) & 0xC0) != 0x80
OUT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def counted(member: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each text are in a class."""
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum(member[data], out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def differ(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes at a and at b differ, for each pair."""
    out = np.zeros(len(a), bool)
    for i in np.flatnonzero(size > 256).tolist():
        out[i] = not np.array_equal(data[a[i] : a[i] + size[i]], data[b[i] : b[i] + size[i]])
    few = np.flatnonzero(size <= 256)
    for k in range(0, len(few), 1 << 14):
        at = few[k : k + (1 << 14)]
        n = size[at]
        first = np.cumsum(n) - n
        inside = np.arange(int(n.sum())) - np.repeat(first, n)
        out[at] = np.logical_or.reduceat(data[np.repeat(a[at], n) + inside] != data[np.repeat(b[at], n) + inside], first)
    return out


def distinct_words(data: np.ndarray, offsets: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(words, distinct words) of each text; ``bits`` of a word's hash are used."""
    start, end, first = word_bounds(data, offsets, SPACE)
    words = np.diff(first)
    sums, down = prefix_sums(data, lower=False)
    hashes = range_hash(sums, down, start, end) >> np.uint64(64 - bits)
    text = np.repeat(np.arange(len(words)), words)
    order = np.lexsort((hashes, text))
    h, t, s, n = hashes[order], text[order], start[order], (end - start)[order]
    same = np.flatnonzero((h[1:] == h[:-1]) & (t[1:] == t[:-1]))
    distinct = words - np.bincount(t[same], minlength=len(words))
    unlike = n[same] != n[same + 1]
    even = np.flatnonzero(~unlike)
    unlike[even] = differ(data, s[same[even]], s[same[even] + 1], n[same[even]])
    for i in np.unique(t[same[unlike]]).tolist():
        distinct[i] = len({data[a:b].tobytes() for a, b in zip(start[first[i] : first[i + 1]], end[first[i] : first[i + 1]])})
    return words, distinct


def failures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The mask of each text: bit 0 for A to bit 3 for D."""
    words, distinct = distinct_words(data, offsets)
    short, repeats = words < 50, 100 * distinct < 65 * words
    shouts = 100 * counted(CAPITAL, data, offsets) > 5 * counted(FIRST, data, offsets)
    signs = counted(SIGN, data, offsets) > 0
    return (short + 2 * repeats + 4 * shouts + 8 * signs).astype(np.int32)


def masks(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "source") -> DataFrame:
    """(key, part, digest, mask): one row per row, without its text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask, digest = [np.zeros(0, np.int32)], []
            for _, _, data, offsets in text_chunks(batch.column(2)):
                mask.append(failures(data, offsets))
                digest += [hashlib.sha256(data[a:b]).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(digest, pa.binary()), pa.array(np.concatenate(mask))], ["key", "part", "digest", "mask"]
            )

    base = docs.select(id_key(id_column).alias("key"), F.coalesce(F.col(part_column).cast("string"), F.lit("")).alias("part"), F.col(text_column).cast("string").alias("text"))
    return base.mapInArrow(scan, "key long, part string, digest binary, mask int")


def with_copies(rows: DataFrame) -> DataFrame:
    """rows (key, salt, part, digest, mask, good, toxic) -> (part, mask with bit 4 for E, good, toxic, n)."""
    by_id = rows.groupBy("key", "salt", "digest", "part", "good", "toxic").agg(F.first("mask").alias("mask"), F.count("*").alias("n"))
    cells = by_id.groupBy("digest", "part", "good", "toxic").agg(F.first("mask").alias("mask"), F.min(F.struct("key", "n")).alias("low"), F.sum("n").alias("n"))
    # One row for each part and label, so a text's rows are few, however many documents hold it.
    least = F.min("low.key").over(Window.partitionBy("digest"))
    firsts = F.when(F.col("low.key") == least, F.col("low.n")).otherwise(0)
    split = cells.select("part", "good", "toxic", "mask", "n", firsts.alias("firsts"))
    sums = split.groupBy("part", "good", "toxic", "mask").agg(F.sum("firsts").alias("firsts"), F.sum(F.col("n") - F.col("firsts")).alias("copies"))
    each = F.explode(F.array(F.struct(F.col("mask"), F.col("firsts").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), F.col("copies").alias("n"))))
    return sums.select("part", "good", "toxic", each.alias("m")).select("part", "good", "toxic", "m.mask", "m.n").filter("n > 0")


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """counts (part, mask, good, toxic, n) -> every order of the filters, step by step. ``1 << len(filters)`` sums stand for a part."""
    size = 1 << len(filters)
    kinds = {"all": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    per_part = counts.groupBy("part").agg(
        *[F.array(*[F.sum(F.when((F.col("mask") == m) & c, F.col("n")).otherwise(0)) for m in range(size)]).alias(k) for k, c in kinds.items()]
    )
    orders = ["".join(p) for p in permutations(filters)]
    steps, members = [], np.zeros((4, len(orders) * len(filters), size), np.int64)
    for order in orders:
        before = 0
        for k, f in enumerate(order):
            bit, at = 1 << filters.index(f), len(steps)
            for m in range(size):
                fails, earlier = bool(m & bit), bool(m & before)
                members[:, at, m] = (not fails and not earlier, fails and not earlier, fails and earlier, m == bit)
            before |= bit
            steps.append((order, k + 1, f))

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = np.array([filters.index(f) for _, _, f in steps])
        for batch in batches:
            for part, everything, good, toxic in zip(*(c.to_pylist() for c in batch.columns)):
                kept, removed, redundant, alone = (m @ np.array(everything) for m in members)
                fair = np.bincount(letters, removed, len(filters)).astype(np.int64)[letters]
                cols = [kept, removed, redundant, alone, members[1] @ np.array(good), members[1] @ np.array(toxic), fair]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(steps)), pa.array([s[0] for s in steps]), pa.array([s[1] for s in steps], pa.int32()), *map(pa.array, cols)],
                    [c.split()[0] for c in OUT.split(", ")],
                )

    return per_part.select("part", *kinds).mapInArrow(expand, OUT)


def filter_audit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "source") -> DataFrame:
    """Per part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost and the filter's removals over all orders."""
    marked = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("key"), F.lit(0).alias("salt")).agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    # Rows of null ids have no label and are spread by their text.
    salt = F.when(F.col("key") == MAX_ID, 1 + F.pmod(F.hash("digest"), F.lit(1 << 20))).otherwise(0)
    joined = masks(docs, id_column, text_column, part_column).withColumn("salt", salt).join(marked, ["key", "salt"], "left")
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    return audit(with_copies(joined.select("key", "salt", "part", "digest", "mask", *flags)))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP13_SQL = r"""
WITH d AS (
  SELECT coalesce(source, '') AS part, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), m AS (
  SELECT part, doc_id,
    (CASE WHEN len(w) < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t) THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
    + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END) AS mask
  FROM d
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), c AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask
), f AS (
  SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(f, bit)
), o AS (
  SELECT a.f || b.f || x.f || y.f || z.f AS filter_order
  FROM f a JOIN f b ON b.bit <> a.bit JOIN f x ON x.bit NOT IN (a.bit, b.bit) JOIN f y ON y.bit NOT IN (a.bit, b.bit, x.bit) JOIN f z ON a.bit + b.bit + x.bit + y.bit + z.bit = 31 AND z.bit NOT IN (a.bit, b.bit, x.bit, y.bit)
), s AS (
  SELECT filter_order, step, f.bit, (SELECT coalesce(sum(g.bit), 0) FROM f g WHERE position(g.f IN filter_order) < step)::INTEGER AS before
  FROM o, range(1, 6) r(step) JOIN f ON f.f = filter_order[step]
), e AS (
  SELECT c.part, s.filter_order, s.step, s.bit,
    coalesce(sum(n) FILTER (WHERE mask & (before | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (WHERE mask & bit > 0 AND mask & before = 0), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE mask & bit > 0 AND mask & before > 0), 0) AS redundant, coalesce(sum(n) FILTER (WHERE mask = bit), 0) AS unique_fails,
    coalesce(sum(good) FILTER (WHERE mask & bit > 0 AND mask & before = 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE mask & bit > 0 AND mask & before = 0), 0) AS toxic_lost
  FROM c, s GROUP BY c.part, s.filter_order, s.step, s.bit
)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM e
"""
