"""Nearest neighbours by a block matrix join over int8 tiles with error bounds.

Vectors are scaled to length 1 and rounded to int8 with one scale each; the
length of what rounding loses is kept. Queries and candidates are cut into
blocks; a tile is one query block against one candidate block, and only the int8
rows, scales and lengths travel to it. The product of the int8 rows gives every
similarity of the tile with a bound on its error:

    |q.v - s s' (q8.v8)| <= |dq| + (1 + |dq|) |dv|

A pair survives its tile when its upper bound reaches the k-th largest lower bound
of its query there, and then the k-th largest over all tiles. The originals of the
survivors are fetched by id, their similarity is computed again in double precision,
and a heap per query keeps the k largest. The result is exact: the bounds never drop
a pair that could be among the k.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite
component take no part; vectors are only compared within one dimension; ties go
to the smaller id; with fewer than k candidates all are returned; rows with a
null id take part in nothing; a row is never its own candidate, and rows that share
its id aren't either; rows that share an id are one candidate (and one query) with
the best of their vectors; repeated rows count once; extra columns are ignored; an
empty table gives no row.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Candidates and queries of a tile, at most, and candidates of one that is cut so that all tasks have work, at least.
BLOCK = 8192
QUERIES = 8192
LEAST = 1024
#: Similarities of a tile held at once.
CELLS = 2_000_000
TILE = "query_id long, vec_id long, low double, high double"


def usable(vector: Column) -> Column:
    """An array of doubles with only finite components, not all 0."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0)


def unit_rows(m: np.ndarray) -> np.ndarray:
    unit = m / np.abs(m).max(axis=1)[:, None]
    unit /= np.sqrt(np.einsum("ij,ij->i", unit, unit))[:, None]
    return unit


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 rows, scale, length of the rounding error) of unit rows."""
    scale = np.abs(unit).max(axis=1) / 127
    q8 = np.rint(unit / scale[:, None]).astype(np.int8)
    lost = unit - q8 * scale[:, None]
    return q8, scale, np.sqrt(np.einsum("ij,ij->i", lost, lost)) + 1e-12


def exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosines of the rows of q and v in double precision; unit rows, summed in one fixed order."""
    return np.einsum("ij,ij->i", q, v, optimize=False)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """int8 product tile. 1,000 dimensions at a time fit float32 without rounding."""
    out = np.zeros((len(a), len(b)), np.float64)
    for k in range(0, a.shape[1], 1000):
        out += a[:, k : k + 1000].astype(np.float32) @ b[:, k : k + 1000].astype(np.float32).T
    return out


def survivors(qid: np.ndarray, q: tuple, vid: np.ndarray, v: tuple, keep: int) -> Iterator[tuple]:
    """(query_id, ids, lower bounds, upper bounds) of the pairs of a tile that can be among the ``keep`` best ids of their query."""
    (q8, qs, qe), (v8, vs, ve) = q, v
    order = np.argsort(vid, kind="stable")
    first = np.flatnonzero(np.diff(vid[order], prepend=vid[order[:1]] - 1))
    repeated = len(first) < len(vid)
    step = max(1, CELLS // max(1, len(vid)))
    for a in range(0, len(qid), step):
        b = min(len(qid), a + step)
        near = product(q8[a:b], v8) * qs[a:b, None] * vs[None, :]
        slack = qe[a:b, None] + (1 + qe[a:b, None]) * ve[None, :]
        near[qid[a:b, None] == vid[None, :]] = -np.inf
        low, high = near - slack, near + slack
        # An id with several vectors has one place in the list, that of its best.
        each = np.maximum.reduceat(low[:, order], first, axis=1) if repeated else low
        k = min(keep, len(first))
        floor = np.partition(each, len(first) - k, axis=1)[:, len(first) - k]
        rows, cols = np.nonzero((high >= floor[:, None]) & np.isfinite(near))
        cut = np.searchsorted(rows, np.arange(b - a + 1))
        for i in range(b - a):
            at = slice(cut[i], cut[i + 1])
            yield qid[a + i], vid[cols[at]], low[i, cols[at]], high[i, cols[at]]


def matrix(column: pa.Array, rows: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def by_query(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, float, float]]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def sent_on(rows: Iterator[tuple], schema: pa.Schema, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding",
    block: int = BLOCK, queries: int = QUERIES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest cosines of each query among all other vectors."""
    base = vectors.select(
        F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v"), is_query.alias("q")
    ).filter(F.col("id").isNotNull() & usable(F.col("v")))
    base = base.withColumn("q", F.coalesce("q", F.lit(False)))
    # Rows of one id are rare, so that is seen first; equal ones count once.
    most = base.groupBy("id").count().agg(F.max("count")).first()[0] or 1
    if most > 1:
        base = base.groupBy("id", "v").agg(F.max("q").alias("q"))
    sizes = base.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.count_if("q").alias("m"))
    # Blocks per dimension; the table has a row per dimension. A row is copied once for each block of the other side, so sides are as long as a tile
    # allows; candidates are cut further where the tiles would be fewer than the tasks, down to LEAST.
    partitions = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mb = F.ceil(F.col("m") / queries)
    spread = F.least(F.ceil(F.col("n") / min(LEAST, block)), F.ceil(F.lit(2 * partitions) / F.greatest(mb, F.lit(1))))
    plan = sizes.select("dim", F.greatest(F.ceil(F.col("n") / block), spread).cast("int").alias("nb"), mb.cast("int").alias("mb"))

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes_ = np.diff(batch.column(1).offsets.to_numpy())
            for dim in np.unique(sizes_).tolist():
                part = batch.filter(pa.array(sizes_ == dim))
                q8, scale, lost = quantised(unit_rows(matrix(part.column(1), part.num_rows)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(part.num_rows, dim, np.int32)), part.column(0), pa.array([r.tobytes() for r in q8], pa.binary()), pa.array(scale), pa.array(lost), part.column(2)],
                    ["dim", "id", "v8", "scale", "lost", "q"],
                )

    rows = base.select("id", "v", "q").mapInArrow(quantise, "dim int, id long, v8 binary, scale double, lost double, q boolean").join(plan, "dim")
    own_block = F.pmod(F.xxhash64("id", F.lit("block")), F.col("nb")).cast("int")
    own_query = F.pmod(F.xxhash64("id", F.lit("query")), F.greatest(F.col("mb"), F.lit(1))).cast("int")
    candidates = rows.filter("mb > 0").select(
        "dim", own_block.alias("vb"), F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("qb"), "id", "v8", "scale", "lost", F.lit(False).alias("q")
    )
    asked = rows.filter("q").select(
        "dim", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("vb"), own_query.alias("qb"), "id", "v8", "scale", "lost", F.lit(True).alias("q")
    )
    def tile(table: pa.Table) -> pa.Table:
        none = np.array(table["q"].combine_chunks().to_numpy(zero_copy_only=False), bool)
        ids, out = table["id"].to_numpy(), []
        if len(none) and not none.all() and none.any():
            v8 = np.frombuffer(b"".join(table["v8"].to_pylist()), np.int8).reshape(len(ids), -1)
            scale, lost = table["scale"].to_numpy(), table["lost"].to_numpy()
            out = list(survivors(ids[none], (v8[none], scale[none], lost[none]), ids[~none], (v8[~none], scale[~none], lost[~none]), k))
        return pa.table({
            "query_id": np.repeat([o[0] for o in out], [len(o[1]) for o in out]).astype(np.int64),
            **{name: np.concatenate([o[c] for o in out] or [np.zeros(0)]).astype(kind) for c, name, kind in ((1, "vec_id", np.int64), (2, "low", float), (3, "high", float))},
        })

    # Few bytes mean much work here, so the tiles aren't put together by their size.
    tiles = candidates.unionByName(asked).repartition(partitions, "dim", "vb", "qb").groupBy("dim", "vb", "qb").applyInArrow(tile, TILE)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pairs whose upper bound reaches the k-th largest lower bound of their query; rows come by query, largest lower bound first."""

        def rest() -> Iterator[tuple]:
            now, best, floor = None, set(), -np.inf
            for q, i, low, high in by_query(batches):
                if q != now:
                    now, best, floor = q, set(), -np.inf
                if len(best) < k and i not in best:
                    best.add(i)
                    floor = low if len(best) == k else -np.inf
                if high >= floor:
                    yield q, i

        yield from sent_on(rest(), pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64())]))

    pairs = (
        tiles.repartition("query_id").sortWithinPartitions("query_id", F.desc("low"))
        .select("query_id", "vec_id", "low", "high").mapInArrow(across, "query_id long, vec_id long")
    )
    if most > 1:
        pairs = pairs.distinct()
    originals = (
        pairs.join(base.select(F.col("id").alias("vec_id"), F.col("v").alias("y")), "vec_id")
        .join(base.filter("q").select(F.col("id").alias("query_id"), F.col("v").alias("x")), "query_id")
        .filter(F.size("x") == F.size("y"))
    )

    def rescored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.diff(batch.column(2).offsets.to_numpy())
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                score = exact(*(unit_rows(matrix(part.column(c), part.num_rows)) for c in (2, 3)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score)], ["query_id", "vec_id", "score"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One heap of k ids per query; its rows come together."""

        def ranked() -> Iterator[tuple]:
            now, heap, seen = None, [], {}

            def done() -> Iterator[tuple]:
                for rank, (s, i) in enumerate(sorted(heap, reverse=True), 1):
                    yield now, rank, -i, s

            for q, i, s in by_query(batches):
                if q != now:
                    yield from done()
                    now, heap, seen = q, [], {}
                if i in seen:  # another vector of the id
                    if s <= seen[i]:
                        continue
                    if (seen[i], -i) in heap:
                        heap.remove((seen[i], -i))
                        heapq.heapify(heap)
                seen[i] = s
                (heapq.heappush if len(heap) < k else heapq.heappushpop)(heap, (s, -i))
            yield from done()

        yield from sent_on(ranked(), pa.schema([("query_id", pa.int64()), ("rank", pa.int32()), ("vec_id", pa.int64()), ("score", pa.float64())]))

    scored = originals.select("query_id", "vec_id", "x", "y").mapInArrow(rescored, "query_id long, vec_id long, score double")
    return scored.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(merge, "query_id long, rank int, vec_id long, score double")


def op4_nearest(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, F.col("vec_id") % 50 == 0)
