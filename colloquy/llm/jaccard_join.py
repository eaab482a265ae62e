"""N-gram Jaccard join by filtering under several global token orders.

A document's set holds its distinct 5-word shingles. Two documents link when
100 * intersection >= 80 * union. Under any one total order of the shingles, two
linked documents share a shingle among the first n - ceil(0.8 n) + 1 of each
(its prefix). All orders used here put rare shingles first (by a counting sketch
over all documents) and differ in the hash that breaks ties:

1. Documents of one set are one node from the start, so copies meet in no list.
2. The first order's prefixes meet in posting lists. Lists that hold the same
   nodes are merged, so a group of near copies makes a few lists and not one for
   each shared shingle.
3. A pair of a list becomes a candidate when its sizes are within the threshold and
   its parity bitmaps differ in no more bits than those of two linked sets can (each
   shingle flips one bit, so the bits that differ are at most the shingles that
   differ). A bitmap has at least half as many bits as its set has shingles; of two
   lengths, the longer is folded.
4. A candidate must also share a shingle in its prefixes under each further order.
   These prefixes travel without the texts; only the pairs that pass all orders are
   verified on their whole sets.

Pairs are taken from the lists in three rounds, so that a group of n near copies
costs about n comparisons: each node with the least node of its list; then, of the
nodes that this leaves outside the component of the list's least node, each with the
nearest node of another component by bitmap; last, every pair of a list that still lies
in different components and passes the filters. The last two rounds compare bitmaps
inside tiles of at most ``TILE`` nodes and send on only what passes. No pair is left
out unless its ends are already connected or a filter proves that they don't link.

Defined cases: words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; fewer
words than 5 are one shingle; no words or null text make an empty set, linked
with nothing; rows that share an id are one node of the graph (each row keeps
its own set size); rows with a null id take part in no link and have a null
component; extra columns are ignored. Shingles are compared by 64-bit hashes, sets
by a 64-bit hash that is made anew with another seed where two sets share it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BLOCKS, bits_for, cell_blocks, components, discard, documents, free_name, members_of, release, stored, summed
from .words import U, mix, shingle_sets, text_chunks, word_hashes

#: Bits of a cell number of the counting sketch: least and most, by the size of the input.
CELL_BITS = (20, 22)
ORDERS = 3
#: Least bits of a parity bitmap.
FOLD = 512
#: Nodes of a list compared with each other in one task; a longer list is cut into tiles.
TILE = 2048
#: Pairs of a tile looked at together.
PAIRS = 1_000_000
#: A list's shingle is salted where its cell holds ``SPREAD`` times the average of the cells and of ``LEAST_CELL`` prefixes or more.
SPREAD, LEAST_CELL = 4, 1000


def prefix_size(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def cell_of(sets: np.ndarray, bits: int) -> np.ndarray:
    return (sets >> U(64 - bits)).astype(np.int64)


def order_keys(sets: np.ndarray, levels: np.ndarray, order: int) -> np.ndarray:
    """Sort keys of shingles: how common (by powers of two), then the hash of this order."""
    level = levels[cell_of(sets, len(levels).bit_length() - 1)].astype(U)
    return (level << U(58)) | (mix(sets ^ U((order * 0x632BE59BD9B4E019 + 1) & ((1 << 64) - 1))) >> U(6))


def prefix_of(one: np.ndarray, levels: np.ndarray, order: int, percent: int) -> np.ndarray:
    size = prefix_size(len(one), percent)
    if size >= len(one):
        return one
    return one[np.argpartition(order_keys(one, levels, order), size - 1)[:size]]


def signature(one: np.ndarray, seed: int) -> int:
    return int(np.bitwise_xor.reduce(mix(one ^ U((0x5851F42D4C957F2D * (2 * seed + 1)) & ((1 << 64) - 1)))).astype(np.int64))


def nodes_of(sets: Iterator[np.ndarray], ids: np.ndarray, seed: int) -> Iterator[tuple[int, np.ndarray]]:
    """(node, set): the hash of the set; an empty set has a node of its own for each id."""
    for i, one in zip(ids.tolist(), sets):
        yield (signature(one, seed) if len(one) else signature(np.array([i], np.int64).view(U), seed + 1)), one


def parity_bitmap(one: np.ndarray) -> bytes:
    """One bit for each residue of the shingles: whether an odd number has it."""
    size = max(FOLD, 1 << max(0, (len(one) // 2 - 1)).bit_length())
    odd = np.bincount((one & U(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def set_sizes(docs: DataFrame, width: int, bits: int, seed: int) -> DataFrame:
    """Rows (id, n, node, check, fold) of each document, and rows (block, cells) of the sketch of this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << bits, np.uint32)
        names = ["id", "n", "node", "check", "fold", "block", "cells"]

        def add(pending: list) -> None:
            found, times = np.unique(cell_of(np.concatenate(pending), bits), return_counts=True)
            cells[found] += times.astype(np.uint32)

        for batch in batches:
            n, node, check, fold, pending, held = [], [], [], [], [], 0
            for i, k, data, off in text_chunks(batch.column(1)):
                ids = batch.column(0).slice(i, k).fill_null(0).to_numpy()
                for name, s in nodes_of(shingle_sets(*word_hashes(data, off), width), ids, seed):
                    n.append(len(s))
                    node.append(name)
                    check.append(signature(s, seed + 2) if len(s) else 0)
                    fold.append(parity_bitmap(s))
                    pending.append(s)
                    held += len(s)
                    if held > 2_000_000:
                        add(pending)
                        pending, held = [], 0
            if pending:
                add(pending)
            empty = len(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(check, pa.int64()), pa.array(fold, pa.binary()),
                 pa.nulls(empty, pa.int32()), pa.nulls(empty, pa.binary())], names,
            )
        # A count above 255 in one task is as good as 255: only the order of the shingles depends on it.
        yield pa.RecordBatch.from_arrays(
            [*(pa.nulls(BLOCKS, pa.int64()) for _ in range(4)), pa.nulls(BLOCKS, pa.binary()), *cell_blocks(np.minimum(cells, 255).astype(np.uint8))], names
        )

    return docs.select("id", "text").mapInArrow(run, "id long, n long, node long, check long, fold binary, block int, cells binary")


def gaps(n: np.ndarray, heads: np.ndarray, folds: list[bytes], i: np.ndarray, j: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(which of the pairs (i, j) can link by size and bitmap, the bits that differ).

    Linked sets differ in at most (100 - percent) / (100 + percent) of the sum of their sizes.
    """
    room = (100 - percent) * (n[i] + n[j])
    gap = np.bitwise_count(heads[i] ^ heads[j]).sum(axis=1, dtype=np.int64)
    good = np.flatnonzero((100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])) & ((100 + percent) * gap <= room))
    sizes = np.array([len(f) for f in folds], np.int64)
    both = np.minimum(sizes[i[good]], sizes[j[good]])
    for size in np.unique(both[both > FOLD // 8]).tolist():
        at = good[both == size]
        rows = np.unique(np.concatenate([i[at], j[at]]))
        bitmap = np.stack([folded(folds[r], size) for r in rows.tolist()])
        for s in range(0, len(at), max(1, 32_000_000 // size)):
            part = at[s : s + max(1, 32_000_000 // size)]
            x, y = np.searchsorted(rows, i[part]), np.searchsorted(rows, j[part])
            gap[part] = np.bitwise_count(bitmap[x] ^ bitmap[y]).sum(axis=1, dtype=np.int64)
    good = good[(100 + percent) * gap[good] <= room[good]]
    return good, gap[good]


def folded(fold: bytes, size: int) -> np.ndarray:
    """The bitmap of ``size`` bytes: a bit's number is a residue, so halves are added without carry."""
    out = np.frombuffer(fold, np.uint8)
    while len(out) > size:
        out = out[: len(out) // 2] ^ out[len(out) // 2 :]
    return out.view(U)


def tile_pairs(group, node, n, component, folds, left, right, percent: int, nearest: bool) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) of the candidates of a buffer: rows of one ``group`` (rising) and different components, a ``left`` with a ``right`` one."""
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.append(start, len(group)))
    own = np.repeat(np.arange(len(start)), size)
    rows = np.flatnonzero(left)
    reps = size[own[rows]]
    heads = np.stack([folded(f, FOLD // 8) for f in folds])
    out, s, ends = [], 0, np.cumsum(reps)
    while s < len(rows):
        e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + PAIRS, "right")))
        r, k = rows[s:e], reps[s:e]
        i = np.repeat(r, k)
        j = np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k) + start[own[i]]
        fit = right[j] & (component[i] != component[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
        i, j = i[fit], j[fit]
        good, gap = gaps(n, heads, folds, i, j, percent)
        i, j = i[good], j[good]
        if nearest and len(i):
            order = np.lexsort((node[j], gap, i))
            order = order[np.r_[True, i[order][1:] != i[order][:-1]]]
            i, j = i[order], j[order]
        out.append(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])]))
        s = e
    pairs = np.unique(np.concatenate(out, axis=1), axis=1) if out else np.zeros((2, 0), np.int64)
    return pairs[0], pairs[1]


def shares(x: np.ndarray, y: np.ndarray) -> bool:
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    return bool(np.any(y[np.minimum(at, len(y) - 1)] == x)) if len(x) else False


def classes(rows: DataFrame, percent: int = 80, width: int = 5, orders: int = ORDERS) -> tuple[DataFrame, DataFrame]:
    """((id, n, node) of every row, (node, class) of the nodes linked with others) of rows (id, text); an id is no null."""
    spark, made = rows.sparkSession, []

    def save(df: DataFrame, name: str) -> DataFrame:
        made.append(stored(df, name))
        return made[-1]

    bits, seed = bits_for(rows, *CELL_BITS), 0
    while True:
        first = save(set_sizes(rows, width, bits, seed), "sets")
        sets = first.filter("block IS NULL")
        nodes = save(
            sets.groupBy("node").agg(F.min("id").alias("id"), F.min("n").alias("n"), F.min("check").alias("check"), F.max("check").alias("other"),
                                     F.max("n").alias("most"), F.max("fold").alias("fold")), "nodes"
        )
        if not nodes.filter("check <> other OR n <> most").limit(1).count():
            break
        seed += 3
    cells = summed(first.filter("block IS NOT NULL").select("block", "cells"), 1 << bits, np.uint8)
    fair = max(LEAST_CELL, float(cells.sum(dtype=np.float64)) / len(cells))
    salts = np.where(cells > SPREAD * fair, np.minimum(np.ceil(cells / fair), 60_000), 0).astype(np.uint16)
    # Two arrays of a fixed number of cells.
    sent = spark.sparkContext.broadcast((np.log2(cells + 1.0).astype(np.uint8), salts))
    nodes = nodes.select("node", "id", "n", "fold")

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, many = sent.value
        told: set[int] = set()  # a set met before in this task has sent its prefix
        for batch in batches:
            for i, k, data, off in text_chunks(batch.column(1)):
                ids = batch.column(0).slice(i, k).to_numpy()
                found, who = [], []
                for name, s in nodes_of(shingle_sets(*word_hashes(data, off), width), ids, seed):
                    if len(s) and name not in told:
                        if len(told) > 500_000:
                            told.clear()
                        told.add(name)
                        found.append(prefix_of(s, levels, 0, percent))
                        who.append(name)
                if found:
                    h = np.concatenate(found)
                    node = np.repeat(np.array(who, np.int64), [len(f) for f in found])
                    salt = many[cell_of(h, bits)].astype(U)
                    salt = np.where(salt > 0, U(1) + mix(node.view(U) ^ U(99)) % np.maximum(salt, U(1)), U(0))
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(salt.astype(np.int32)), pa.array(node)], ["h", "salt", "node"])

    post = rows.mapInArrow(prefixes, "h long, salt int, node long")
    whole = Window.partitionBy("h", "salt")
    lists = (
        post.withColumn("lo", F.min("node").over(whole)).withColumn("hi", F.max("node").over(whole)).filter("lo < hi OR salt > 0")
        .withColumn("list", F.when(F.col("salt") > 0, F.col("h")).otherwise(F.bit_xor(F.xxhash64("node")).over(whole)))
        .select("list", "node").distinct()
    )
    lists = save(lists, "lists")
    release(spark)
    heads = lists.groupBy("list").agg(F.min("node").alias("lead"), F.max("node").alias("last")).filter("lead < last")
    heads = save(heads.select("list", "lead"), "heads")
    near = save(nodes.join(lists.select("node").distinct().hint("merge"), "node", "left_semi"), "near")

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            n = np.concatenate([batch.column(c).to_numpy() for c in (2, 3)])
            folds = batch.column(4).to_pylist() + batch.column(5).to_pylist()
            if m:
                top = np.stack([folded(f, FOLD // 8) for f in folds])
                good, _ = gaps(n, top, folds, np.arange(m), np.arange(m) + m, percent)
                yield batch.select([0, 1]).take(pa.array(good))

    def with_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The texts whose set is the wanted node, with their sorted prefixes under the further orders, 32 bits of each shingle."""
        levels = sent.value[0]
        told: set[int] = set()
        for batch in batches:
            for i, k, data, off in text_chunks(batch.column(2)):
                ids, wanted = (batch.column(c).slice(i, k).to_numpy() for c in (0, 1))
                at, parts = [], [[] for _ in range(1, orders)]
                for r, (name, s) in enumerate(nodes_of(shingle_sets(*word_hashes(data, off), width), ids, seed)):
                    if name == wanted[r] and name not in told:
                        told.add(name)
                        at.append(i + r)
                        for o in range(1, orders):
                            parts[o - 1].append(np.unique((prefix_of(s, levels, o, percent) & U(0xFFFFFFFF)).astype(np.uint32)).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).take(pa.array(at, pa.int64())), batch.column(2).take(pa.array(at, pa.int64())),
                     *(pa.array(p, pa.binary()) for p in parts)], ["node", "text", *(f"p{o}" for o in range(1, orders))],
                )

    def pass_orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for r in zip(*(batch.column(c) for c in range(2, 2 * orders))):
                x = [np.frombuffer(v.as_buffer(), np.uint32) for v in r]
                ok.append(all(shares(x[o], x[o + orders - 1]) for o in range(orders - 1)))
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}

        def own_set(node: int, text: str) -> np.ndarray:
            if node not in kept:
                if len(kept) >= 64:
                    kept.clear()
                ((_, _, data, off),) = text_chunks(pa.array([text], pa.string()))
                (kept[node],) = shingle_sets(*word_hashes(data, off), width)
            return kept[node]

        for batch in batches:
            ok = []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                p, q = own_set(a, x), own_set(b, y)
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    further = [f"p{o}" for o in range(1, orders)]

    def known(edges: DataFrame) -> DataFrame:
        out = components(edges)
        made.append(out)
        return out.withColumnRenamed("id", "node")

    def screened(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that sizes and bitmaps leave."""
        one = near.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("fold").alias("fa"))
        two = near.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("fold").alias("fb"))
        both = pairs.join(two.hint("merge"), "b").join(one.hint("merge"), "a")
        return both.select("a", "b", "na", "nb", "fa", "fb").mapInArrow(screen, "a long, b long")

    def linked(pairs: DataFrame) -> DataFrame | None:
        """The screened pairs (a, b) that link: by the prefixes of the further orders, then by the whole sets."""
        if not pairs.limit(1).count():
            return None
        need = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        need = save(need.join(near.select("node", "id").hint("merge"), "node").select("node", "id"), "need")
        some = members_of(rows, "id", need, bits)
        texts = some.join(need.hint("merge"), "id").select("id", "node", "text")
        texts = save(texts.mapInArrow(with_prefixes, ", ".join(["node long, text string", *(f"{p} binary" for p in further)])), "texts")
        release(spark)
        if orders > 1:
            one = texts.select(F.col("node").alias("a"), *(F.col(p).alias(f"{p}_a") for p in further))
            two = texts.select(F.col("node").alias("b"), *(F.col(p).alias(f"{p}_b") for p in further))
            both = pairs.join(two.hint("merge"), "b").join(one.hint("merge"), "a")
            both = both.select("a", "b", *(f"{p}_a" for p in further), *(f"{p}_b" for p in further))
            pairs = save(both.mapInArrow(pass_orders, "a long, b long"), "candidates")
        with_texts = (
            pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")).hint("merge"), "b")
            .join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")).hint("merge"), "a")
        )
        out = save(with_texts.select("a", "b", "x", "y").mapInArrow(judge, "a long, b long"), "links")
        release(spark)
        return out if out.limit(1).count() else None

    def tiles(found: DataFrame, nearest: bool) -> DataFrame:
        """Candidates (a, b) of the lists whose nodes lie in several components, by bitmap."""
        placed = lists.join(found.hint("merge"), "node", "left").select("list", "node", F.coalesce("component", "node").alias("c"))
        told = placed.groupBy("list").agg(F.min(F.struct("node", "c")).alias("lead"), F.count("*").alias("m"), F.min("c").alias("lo"), F.max("c").alias("hi"))
        open_ = save(told.filter("lo < hi").select("list", F.col("lead.c").alias("main"), "m"), "open")
        marked = placed.join(open_.hint("merge"), "list").withColumn("out", F.col("c") != F.col("main"))
        sent_rows = marked.filter(f"m <= {TILE}").select("list", F.lit(0).alias("x"), F.lit(0).alias("y"), "node", "c", F.col("out").alias("l"), F.lit(True).alias("r"))
        if open_.filter(f"m > {TILE}").limit(1).count():
            # The nodes outside the main component are cut into ``down`` parts and all nodes into ``across``.
            long = save(marked.filter(f"m > {TILE}"), "long")
            outside = save(long.groupBy("list").agg(F.ceil(F.count_if("out") / TILE).cast("int").alias("down")), "outside")
            cut = long.join(outside.hint("merge"), "list").withColumn("across", F.ceil(F.col("m") / TILE).cast("int"))
            at_across, at_down = (F.pmod(F.xxhash64("node", F.lit(k)), F.col(c)).cast("int") for k, c in ((1, "across"), (2, "down")))
            right = cut.select("list", at_across.alias("x"), F.explode(F.sequence(F.lit(0), F.col("down") - 1)).alias("y"), "node", "c", F.lit(False).alias("l"), F.lit(True).alias("r"))
            left = cut.filter("out").select("list", F.explode(F.sequence(F.lit(0), F.col("across") - 1)).alias("x"), at_down.alias("y"), "node", "c", F.lit(True).alias("l"), F.lit(False).alias("r"))
            sent_rows = sent_rows.unionByName(right).unionByName(left)
        sent_rows = sent_rows.join(near.select("node", "n", "fold").hint("merge"), "node")

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []

            def done(table: pa.Table) -> pa.RecordBatch:
                key = [table[c].to_numpy() for c in ("list", "x", "y")]
                new = np.zeros(table.num_rows, np.int64)
                for k in key:
                    new[1:] |= k[1:] != k[:-1]
                flags = [table[c].to_numpy().astype(bool) for c in ("l", "r")]
                a, b = tile_pairs(np.cumsum(new), table["node"].to_numpy(), table["n"].to_numpy(), table["c"].to_numpy(), table["fold"].to_pylist(), *flags, percent, nearest)
                return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

            for batch in batches:
                held.append(batch)
                if sum(x.num_rows for x in held) >= 2 * TILE:
                    table = pa.Table.from_batches(held).combine_chunks()
                    key = [table[c].to_numpy() for c in ("list", "x", "y")]
                    # Only the last group can go on in the next batch.
                    last = np.flatnonzero(np.any([k != k[-1] for k in key], axis=0))
                    cut_at = int(last[-1]) + 1 if len(last) else 0
                    if cut_at:
                        yield done(table.slice(0, cut_at))
                        held = table.slice(cut_at).to_batches()
            if held and sum(x.num_rows for x in held):
                yield done(pa.Table.from_batches(held).combine_chunks())

        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
        grouped = sent_rows.select("list", "x", "y", "node", "n", "c", "fold", "l", "r").repartition(partitions, "list", "x", "y").sortWithinPartitions("list", "x", "y")
        return grouped.mapInArrow(compare, "a long, b long").distinct()

    by_lead = lists.join(heads.hint("merge"), "list").filter("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    tried = save(screened(by_lead), "tried")
    # Rows of one id with different sets are one node of the graph.
    same_id = sets.groupBy("id").agg(F.count("*").alias("rows"), F.min("node").alias("a"), F.max("node").alias("z")).filter("a < z").select("id", "a")
    edges = save(sets.join(same_id.hint("merge"), "id").select("a", F.col("node").alias("b")).filter("a <> b").distinct(), "links")
    none = edges.limit(0)
    more = linked(tried)
    edges = edges.unionByName(more if more is not None else none)
    found = known(edges)
    for nearest in (True, False):
        pairs = save(tiles(found, nearest).join(tried.hint("merge"), ["a", "b"], "left_anti"), "tried")
        release(spark)
        more = linked(pairs)
        tried = tried.unionByName(pairs)
        if more is not None:
            edges = edges.unionByName(more)
            found = known(edges)
    linked_ = stored(found.select("node", F.col("component").alias("class")), "classes")
    discard(*[t for t in made if t is not first])
    release(spark)
    return sets.select("id", "n", "node"), linked_


def least_of(ranked: DataFrame, linked: DataFrame) -> DataFrame:
    """(node, best) of rows (node, rank): the least rank in the class of each node that stands more than once or is linked."""
    by_node = ranked.groupBy("node").agg(F.min("rank").alias("own"), F.count("*").alias("times"))
    by_node = stored(by_node.join(linked.hint("merge"), "node", "left"), "best")
    by_class = by_node.filter("class IS NOT NULL").groupBy("class").agg(F.min("own").alias("best"))
    several = by_node.filter("times > 1 OR class IS NOT NULL").join(by_class.hint("merge"), "class", "left")
    several = stored(several.select("node", F.coalesce("best", "own").alias("best")), "several")
    discard(by_node, linked)
    return several


def jaccard_components(docs: DataFrame, percent: int = 80, width: int = 5, orders: int = ORDERS) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row per row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    sets, linked = classes(rows.filter("id IS NOT NULL"), percent, width, orders)
    best = least_of(sets.select("node", F.col("id").alias("rank")), linked)
    known = sets.join(best.hint("merge"), "node", "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("best", "id").alias("component_id")
    )

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, off in text_chunks(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array([len(s) for s in shingle_sets(*word_hashes(data, off), width)], pa.int64())], ["n_shingles"])

    without = rows.filter("id IS NULL").select("text").mapInArrow(sizes, "n_shingles long")
    none = F.lit(None).cast("long")
    return known.unionByName(without.select(none.alias("doc_id"), "n_shingles", none.alias("component_id")))


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that represent their group of near copies: that with the smallest doc_id (null last) of each.

    Every row is judged by its own text. Where ids are unique and none is null, they name the rows; else the rows are
    written once with a number of their own, and equal rows of a group leave one of them.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("id"))
    odd = ids.groupBy("id").count().filter("id IS NULL OR count > 1").limit(1).count() > 0
    row = free_name(docs, "_row")
    if odd:
        docs_ = stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    else:
        docs_ = docs.withColumn(row, F.col("doc_id").cast("long"))
    rows = docs_.select(F.col(row).alias("id"), F.col("text").cast("string").alias("text"))
    sets, linked = classes(rows, **how)
    # The smallest id stands first, then the first row.
    names = docs_.select(F.col(row).alias("id"), F.col("doc_id").cast("long").alias("doc"))
    told = sets.join(names.hint("merge"), "id") if odd else sets.withColumn("doc", F.col("id"))
    told = told.filter("n > 0").select("node", "id", F.struct(F.col("doc").isNull().alias("none"), "doc", "id").alias("rank"))
    several = least_of(told, linked)
    gone = free_name(docs_, "_gone")
    lost = told.select("node", "id").join(several.hint("merge"), "node").filter("id <> best.id").select(F.col("id").alias(gone))
    return docs_.join(lost.hint("merge"), docs_[row] == F.col(gone), "left_anti").drop(row)


def op7_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))
