"""Token ids in training order: a keyed permutation of all sequences, written as fixed-stride shards.

Each document is tokenised and cut into sequences of ``length`` ids; the end of
text follows its last id and fills its last sequence. Sequences are numbered
0 .. n-1 in the order in which the documents stand in their files (by path and row).
A Feistel network over the next power of four, with a key, walks its cycle until
the number lies below n again, so it is a permutation of 0 .. n-1 that needs no
table: slot = permuted number. With ``window``, each run of that many sequences is
permuted in itself, so that an order given by the input (a curriculum) holds from
window to window. Slots are range-partitioned by shard and sorted; ``token_records``
gives the records in that order, and ``token_shards`` writes each shard as one file
of ``rows`` records of ``2 * length`` bytes (little-endian uint16), so slot s stands
at byte ``(s mod rows) * 2 * length`` of shard ``s div rows``. A reader can start at
any slot. A file appears under its name only when it is complete, so a
repeated task leaves the same file; ``shards.json`` tells how many slots there are.

Defined cases: a null or empty text is one sequence of end signs; a null doc_id
is kept as null; rows that share an id, and equal rows, are tokenised each; an empty
table gives no record; extra columns are ignored; a table that isn't read from
Parquet files is first written to the shared folder.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, documents, filesystem, release, shared_path, stored

LENGTH, ROWS, KEY, ROUNDS = 512, 4096, 0x5DEECE66D, 6
#: Ranges of shards that ``token_shards`` writes one after the other.
PASSES = 4
#: Stretches of input whose totals may be broadcast, at most; beyond, they are joined by an exchange.
RUNS = 100_000
INDEX = "slot long, shard long, byte_offset long, doc_id long, part long, n_tokens int"
OUTPUT = f"{INDEX}, record binary"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Tokenizer:
    """Byte-level BPE ids as uint16 bytes."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.end = len(ranks)
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), np.uint16).tobytes()


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def permuted(number: np.ndarray, n: int, key: int = KEY, window: int | None = None) -> np.ndarray:
    """The slot of each number in 0 .. n-1: a keyed Feistel network with cycle-walking, over each window if one is given."""
    if window is not None:
        out = np.empty(len(number), np.int64)
        turn = number // window
        for w in np.unique(turn).tolist():
            at = turn == w
            out[at] = w * window + permuted(number[at] - w * window, min(window, n - w * window), key + w)
        return out
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(int.from_bytes(hashlib.blake2b(f"{key}:{r}".encode(), digest_size=8).digest(), "little")) for r in range(ROUNDS)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            f = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            f ^= f >> np.uint64(29)
            f *= np.uint64(0xBF58476D1CE4E5B9)
            f ^= f >> np.uint64(32)
            left, right = right, left ^ (f & mask)
        return (left << np.uint64(half)) | right

    out = once(number.astype(np.uint64))
    while len(far := np.flatnonzero(out >= np.uint64(n))):
        out[far] = once(out[far])
    return out.astype(np.int64)


def placed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, file, row): every row with its place in the Parquet files it is read from."""

    def with_place(d: DataFrame) -> DataFrame:
        place = d.metadataColumn("_metadata")
        return d.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), place["file_path"].alias("file"), place["row_index"].alias("row"))

    try:
        return with_place(docs)
    except AnalysisException:
        return with_place(stored(docs.select("doc_id", "text"), "texts"))


def numbered_documents(docs: DataFrame, length: int, path: str) -> tuple[DataFrame, int, DataFrame]:
    """((doc_id, ids, n, before) of each document, the number of all sequences, the table the ids are kept in).

    The ids are written once, where their texts were read, with the running number inside
    the stretch of the file that the task read; the totals of the stretches give the rest.
    So numbering moves one row for each stretch and no ids.
    """

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path)
        end = np.array([encode.end], np.uint16).tobytes()
        file, first, last, total = None, 0, -1, 0
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                ids = [encode(t or "") + end for t in part.column(1).to_pylist()]
                size = [-(-len(x) // (2 * length)) for x in ids]
                inside, firsts = [], []
                for f, r, k in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), size):
                    if f != file or r <= last:
                        file, first, total = f, r, 0
                    inside.append(total)
                    firsts.append(first)
                    last, total = r, total + k
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.binary()), pa.array(size, pa.int64()), pa.array(inside, pa.int64()), part.column(2), pa.array(firsts, pa.int64())],
                    ["doc_id", "ids", "n", "inside", "file", "first"],
                )

    made = placed(docs).mapInArrow(tokenise, "doc_id long, ids binary, n long, inside long, file string, first long")
    made = stored(made, "tokens", compression="zstd")
    # One row for each stretch that a task read.
    runs = stored(made.groupBy("file", "first").agg(F.sum("n").alias("all")), "runs")
    count, total = runs.agg(F.count("*"), F.sum("all")).first()
    before = F.coalesce(F.sum("all").over(Window.orderBy("file", "first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("file", "first", before.alias("run"))
    runs = F.broadcast(runs) if count <= RUNS else runs.hint("merge")
    numbered = made.join(runs, ["file", "first"]).select("doc_id", "ids", "n", (F.col("run") + F.col("inside")).alias("before"))
    return numbered, int(total or 0), made


def records_of(numbered: DataFrame, n: int, low: int, high: int, length: int, rows: int, key: int, window: int | None) -> DataFrame:
    """(slot, shard, doc_id, part, n_tokens, record) of shards low .. high-1 without their padding, in slot order within partitions of whole shards."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                docs, ids, size, before = (c.to_pylist() for c in batch.slice(i, 256).columns)
                each = np.array(size, np.int64)
                who = np.repeat(np.arange(len(docs)), each)
                within = np.arange(len(who)) - np.repeat(np.cumsum(each) - each, each)
                slot = permuted(np.array(before, np.int64)[who] + within, n, key, window)
                good = np.flatnonzero((slot >= low * rows) & (slot < high * rows))
                slot, who, part = slot[good], who[good], within[good]
                record = [ids[d][p * 2 * length : (p + 1) * 2 * length] for d, p in zip(who.tolist(), part.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(slot), pa.array(slot // rows), pa.array([docs[d] for d in who.tolist()], pa.int64()), pa.array(part), pa.array([len(r) // 2 for r in record], pa.int32()), pa.array(record, pa.binary())],
                    ["slot", "shard", "doc_id", "part", "n_tokens", "record"],
                )

    spark = numbered.sparkSession
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), high - low))
    cuts = numbered.mapInArrow(cut, "slot long, shard long, doc_id long, part long, n_tokens int, record binary")
    # The slots are a permutation of 0 .. n-1, so the bounds of the ranges are known without a sample.
    at = F.floor((F.col("shard") - low) * parts / max(1, high - low)).cast("int")
    return cuts.repartitionById(parts, at).sortWithinPartitions("slot")


def padded(batches: Iterator[pa.RecordBatch], length: int, rows: int, end_id: bytes) -> Iterator[pa.RecordBatch]:
    """The rows of ``records_of`` as those of ``OUTPUT``."""
    for batch in batches:
        for i in range(0, batch.num_rows, 2048):
            part = batch.slice(i, 2048)
            full = [r + end_id * (length - len(r) // 2) for r in part.column(5).to_pylist()]
            at = pa.array([s % rows * 2 * length for s in part.column(0).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), at, part.column(2), part.column(3), part.column(4), pa.array(full, pa.binary())], ["slot", "shard", "byte_offset", "doc_id", "part", "n_tokens", "record"])


def token_records(docs: DataFrame, length: int = LENGTH, rows: int = ROWS, key: int = KEY, path: str | None = None, window: int | None = None) -> DataFrame:
    """(slot, shard, byte_offset, doc_id, part, n_tokens, record): all records in slot order within range partitions of whole shards."""
    path = path or vocabulary()
    numbered, n, _ = numbered_documents(docs, length, path)
    end_id = np.array([tokenizer(path).end], np.uint16).tobytes()
    return records_of(numbered, n, 0, -(-n // rows), length, rows, key, window).mapInArrow(lambda batches: padded(batches, length, rows, end_id), OUTPUT)


def token_shards(
    docs: DataFrame, folder: str, length: int = LENGTH, rows: int = ROWS, key: int = KEY, path: str | None = None, passes: int = PASSES,
    window: int | None = None,
) -> DataFrame:
    """Write every shard to ``folder``; returns (slot, shard, byte_offset, doc_id, part, n_tokens, record_sha256), the records as the files hold them.

    The shards are written in ``passes`` ranges, so that beside the ids and the
    files only one range's exchange stands on disk.
    """
    spark, path = docs.sparkSession, path or vocabulary()
    numbered, n, ids = numbered_documents(docs, length, path)
    end_id = np.array([tokenizer(path).end], np.uint16).tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Shards(folder)
        for batch in padded(batches, length, rows, end_id):
            out.put(batch.column(1).to_numpy(), batch.column(6).to_pylist())
            yield pa.RecordBatch.from_arrays(batch.columns[:6], batch.schema.names[:6])
        out.close()

    count, index = -(-n // rows), None
    bounds = sorted({count * k // passes for k in range(passes + 1)}) if count else []
    for low, high in zip(bounds[:-1], bounds[1:]):
        done = stored(records_of(numbered, n, low, high, length, rows, key, window).mapInArrow(write, INDEX), "index")
        index = done if index is None else index.union(done)
        release(spark)
    discard(ids)
    store, root = filesystem(folder)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/shards.json") as f:
        f.write(json.dumps({"slots": n, "rows": rows, "length": length}).encode())
    if index is None:
        return spark.createDataFrame([], f"{INDEX}, record_sha256 string")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(folder)
        now, f = None, None
        stride = 2 * length
        for batch in batches:
            shards, at, prints = batch.column(1).to_numpy(), batch.column(2).to_numpy(), []
            # Records that follow each other in a file are read at once.
            first = np.flatnonzero(np.r_[True, (shards[1:] != shards[:-1]) | (at[1:] != at[:-1] + stride)]) if len(shards) else []
            for i, j in zip(first, [*first[1:], len(shards)]):
                if shards[i] != now:
                    if f is not None:
                        f.close()
                    now, f = shards[i], store.open_input_file(f"{root}/shard-{shards[i]:08d}.bin")
                f.seek(int(at[i]))
                raw = memoryview(f.read(int(j - i) * stride))
                if len(raw) < (j - i) * stride:
                    raise ValueError(f"shard {now} ends before byte {at[j - 1] + stride}")
                prints += [hashlib.sha256(raw[k * stride : (k + 1) * stride]).hexdigest() for k in range(j - i)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints, pa.string())], [*batch.schema.names, "record_sha256"])
        if f is not None:
            f.close()

    return index.mapInArrow(read, f"{INDEX}, record_sha256 string")


class Shards:
    """Writes records in order of their slots, each shard as one file of ``folder``."""

    def __init__(self, folder: str):
        self.store, self.root = filesystem(folder)
        self.store.create_dir(self.root, recursive=True)
        self.now, self.out, self.name = None, None, ""

    def put(self, shards: np.ndarray, records: list[bytes]) -> None:
        first = np.flatnonzero(np.diff(shards, prepend=-1)).tolist()
        for a, b in zip(first, [*first[1:], len(shards)]):
            if shards[a] != self.now:
                self.close()
                self.now = int(shards[a])
                self.name = f"{self.root}/.shard-{self.now:08d}-{os.urandom(6).hex()}"
                self.out = self.store.open_output_stream(self.name)
            self.out.write(b"".join(records[a:b]))

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.store.move(self.name, f"{self.root}/shard-{self.now:08d}.bin")
            self.out = None


def read_slots(folder: str, start: int, count: int) -> Iterator[np.ndarray]:
    """The records of slots start .. start+count-1 (as far as there are any) in order, each shard read in sequence from where it is entered.

    A shard that is missing or ends early raises.
    """
    store, root = filesystem(folder)
    with store.open_input_stream(f"{root}/shards.json") as f:
        told = json.loads(f.read())
    rows, length = told["rows"], told["length"]
    slot, end = start, min(start + count, told["slots"])
    while slot < end:
        shard = slot // rows
        with store.open_input_file(f"{root}/shard-{shard:08d}.bin") as f:
            f.seek(slot % rows * 2 * length)
            while slot < min(end, (shard + 1) * rows):
                raw = f.read(2 * length)
                if len(raw) < 2 * length:
                    raise ValueError(f"shard {shard} ends before slot {slot}")
                yield np.frombuffer(raw, np.uint16)
                slot += 1


def op1_token_shards(spark, sf_dir: str) -> DataFrame:
    """The index of every record, once the shards are written, as read back from them."""
    return token_shards(documents(spark, sf_dir), shared_path(spark, "shards"))
