"""Repeated byte strings by column-wise construction of a multi-document BWT.

Candidates. Each window of ``length`` bytes picks its anchor: the gram of
``GRAM`` bytes with the least hash in it, the leftmost among equals. Equal windows
pick equal anchors, so a repeated window lies in a passage (the consecutive
windows with one anchor, at most ``length - GRAM + 1`` of them) whose anchor
occurs twice. Passages with the same bytes around the same anchor are gathered
to one, with its first place; their other places hold only later copies. An
anchor with one surrounding only has nothing further to compare: none of its
windows can stand elsewhere. The distinct passages of all other anchors are cut to the windows
that may stand in another one: windows at like distances from their anchor hold a core, and one that
only a single passage has belongs to windows that repeat nowhere. Passages that are equal then are
gathered again, and the rest is put in order by the construction.

Construction. The passages of a block are the documents of a collection. They
are read column by column from their ends: round j inserts the suffix of j
symbols of every passage at once. Where it goes follows from the BWT so far (the
LF mapping), and the common prefix with its neighbours from the common prefixes
so far. BWT, common prefixes and suffix names are columns in external files of the
shared folder, read and written in sequence once a round, and deleted at the end. At
the end, runs of suffixes that share ``length`` bytes are the classes of equal
windows; all but the first place of a class are repeats. A symbol is up to ``SYMBOL``
bytes, and a passage enters once for each phase, which makes the rounds fewer.

Skew. Anchors are counted in a sketch first. The passages of an anchor whose cell
holds far more than the average are salted by place: copies are told apart inside
each salt, then what stays (one place a salt and body) once more by body. All
distinct passages of an anchor go to one block, unless it has more than
``HOT`` of them: then its cores are counted by exchange and it is salted over blocks, each block also tells the first
place of every class of such an anchor, and a grouped minimum over the hash of
the window joins the blocks. Nothing is capped or left out.

Defined cases: null text is empty; a text of fewer than ``length`` bytes loses
nothing but can't repeat either; a null id counts as the largest; rows that share
an id are one document read in order of a hash of their text, and no string crosses rows;
extra columns are ignored. Passages and windows are compared by 128-bit hashes
between blocks and byte by byte inside them.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import MAX_ID, cell_blocks, discard, documents, drop_folder, filesystem, release, shared_path, stored, summed, with_part
from .words import U, mix, prefix_sums, range_hash, text_chunks

GRAM = 20
#: Low bits of an anchor's hash that give way to its place: a text has fewer than 2**31 bytes.
PLACE_BITS = 31
#: Bytes of a symbol; of one in a block, whose strings are cut to few windows each, so that twice as long a symbol halves the work of the rounds.
SYMBOL, WIDE = 10, 25
HOT = 2_000
#: Cells of the sketch that counts anchors. A cell is spread where it holds more than
#: ``SPREAD`` times the average of the cells and of ``LEAST_CELL`` passages.
CELL_BITS, SPREAD, LEAST_CELL = 18, 4, 500
#: Bytes that a scan handles at once: its columns of eight bytes for each stay in a core's cache.
SCAN = 1 << 17
#: Passages in a block.
BLOCK = 8_000
#: Bands of the windows of an anchor, by their distance from it.
BANDS = 9
#: Bits of a place that hold the byte offset; the part is above.
AT_BITS = 40


def passages(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, anchor hash, bytes hash) of every passage of the texts."""
    sums, down = prefix_sums(data, lower=False)
    n, w = len(data), length - GRAM + 1
    if n < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U),) * 2
    at = np.arange(n - GRAM + 1)
    gram = range_hash(sums, down, at, at + GRAM)
    # The place in the low bits makes the leftmost of equal hashes the least one. The cut is the same everywhere, so equal windows agree.
    bits = U(PLACE_BITS)
    least = ((gram >> bits) << bits) | at.astype(U)
    span, done = least, 1
    while done < w:
        step = min(done, w - done)
        span = np.minimum(span[: len(span) - step], span[step:])
        done += step
    anchor = (span & ((U(1) << bits) - U(1))).astype(np.int64)
    start = np.arange(len(anchor))
    inside = np.zeros(n + 1, bool)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= length:
            inside[a : b - length + 1] = True
    good = inside[: len(anchor)]
    new = np.empty(len(anchor), bool)
    new[0] = True
    new[1:] = (anchor[1:] != anchor[:-1]) | ~good[:-1]
    first = start[new & good]
    if not len(first):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U),) * 2
    last = np.empty(len(anchor), bool)
    last[-1] = True
    last[:-1] = (anchor[1:] != anchor[:-1]) | ~good[1:]
    end = start[last & good] + 1
    text = np.searchsorted(offsets, first, "right") - 1
    where = anchor[first]
    whole = range_hash(sums, down, first, end + length - 1)
    # The anchor's place in the passage is part of what must be equal.
    return text, first - offsets[text], end - first, gram[where], mix(whole ^ mix((where - first).astype(U) + U(1)))


class Columns:
    """The external files of a collection: a round reads its columns in sequence from one file and writes the next one."""

    def __init__(self, folder: str, **kinds):
        self.store, self.root = filesystem(f"{folder}/{uuid.uuid4().hex}")
        self.store.create_dir(self.root, recursive=True)
        self.kinds, self.turn, self.size = kinds, 0, 0

    def read(self) -> list[np.ndarray]:
        with self.store.open_input_stream(f"{self.root}/{self.turn}") as f:
            return [np.frombuffer(f.read(self.size * np.dtype(kind).itemsize), kind) for kind in self.kinds.values()]

    def write(self, *columns: np.ndarray) -> None:
        with self.store.open_output_stream(f"{self.root}/{self.turn + 1}") as f:
            for kind, values in zip(self.kinds.values(), columns):
                if len(values):
                    f.write(memoryview(np.ascontiguousarray(values, kind)).cast("B"))
        if self.turn:
            self.store.delete_file(f"{self.root}/{self.turn}")
        self.turn, self.size = self.turn + 1, len(columns[0])

    def drop(self) -> None:
        self.store.delete_dir(self.root)


def range_minimum(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(values[lo:hi]) for each pair, lo < hi."""
    out = np.empty(len(lo), values.dtype)
    power = np.frexp((hi - lo).astype(np.float64))[1] - 1
    table, level = values, 0
    top = int(power.max()) if len(power) else -1
    while level <= top:
        at = np.flatnonzero(power == level)
        if len(at):
            out[at] = np.minimum(table[lo[at]], table[hi[at] - (1 << level)])
        table = np.minimum(table[: len(table) - (1 << level)], table[1 << level :]) if len(table) > (1 << level) else table
        level += 1
    return out


def symbol_for(length: int, most: int = SYMBOL) -> int:
    """The longest symbol, up to ``most`` bytes, that divides ``length``."""
    return next(k for k in range(min(most, length), 0, -1) if length % k == 0)


def symbol_codes(data: np.ndarray, symbol: int) -> np.ndarray:
    """A number from 1 for the ``symbol`` bytes from each place on, in their order."""
    code, done = data.astype(np.uint64), 1
    while done < symbol:  # numbers of ``done`` bytes, put together to numbers of up to twice as many
        step = min(done, symbol - done)
        if done + step > 4:
            code = np.unique(code, return_inverse=True)[1].astype(np.uint64)
            both = (code[: len(code) - step] << U(32)) | code[step:]
        else:
            both = (code[: len(code) - step] << U(8 * step)) | (code[step:] & U((1 << 8 * step) - 1))
        code, done = both, done + step
    return np.unique(code, return_inverse=True)[1].astype(np.uint32) + np.uint32(1)


def stable_order(codes: np.ndarray) -> np.ndarray:
    """The stable order of 32-bit codes by two counting passes over 16 bits."""
    order = np.argsort((codes & np.uint32(0xFFFF)).astype(np.uint16), kind="stable")
    high = (codes >> np.uint32(16)).astype(np.uint16)
    return order[np.argsort(high[order], kind="stable")] if high.any() else order


def collection_order(strings: list[bytes], length: int, folder: str, symbol: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, start, common) of all suffixes of ``length`` bytes or more, in sorted order.

    ``common`` tells whether a suffix shares its first ``length`` bytes with the
    one before it. ``length`` must be a multiple of ``symbol`` bytes. The columns
    are kept in files of ``folder``.
    """
    symbol = symbol or symbol_for(length)
    deep = length // symbol
    sizes = np.array([len(s) for s in strings], np.int64)
    heads = np.concatenate([[0], np.cumsum(sizes)])
    code = symbol_codes(np.frombuffer(b"".join(strings) + bytes(symbol), np.uint8), symbol)  # in order of the symbols; 0 is the end of a string
    # Members: a string in each phase that has a suffix of ``length``; suffixes of it start at phase + symbol * k.
    owner = np.repeat(np.arange(len(strings)), symbol)
    phase = np.tile(np.arange(symbol), len(strings))
    told = sizes[owner] - phase >= length
    owner, phase = owner[told], phase[told]
    columns = np.maximum(0, (sizes[owner] - phase) // symbol)
    base = heads[owner] + phase
    m, rounds = len(owner), int(columns.max(initial=0))

    def before(member: np.ndarray, used: int) -> np.ndarray:
        """The symbol in front of the suffix of ``used`` symbols; 0 at the start of the string."""
        at = columns[member] - used - 1
        return np.where(at >= 0, code[np.minimum(base[member] + symbol * np.maximum(at, 0), len(code) - 1)], 0).astype(np.uint32)

    files = Columns(folder, bwt=np.uint32, lcp=np.uint8, member=np.int32, used=np.uint8)
    files.write(before(np.arange(m), 0), np.zeros(m), np.arange(m), np.zeros(m))
    for r in range(rounds):
        bwt, lcp, member, used = files.read()
        order = stable_order(bwt)
        order = order[int(np.count_nonzero(bwt == 0)) :]  # LF: the k-th of these goes to place m + k
        fresh = np.flatnonzero(used[order] == r)
        # Common prefixes of the new suffixes with the one before, and of those after them.
        touch = np.zeros(len(order) + 1, bool)
        touch[fresh] = True
        touch[fresh + 1] = True
        touched = np.flatnonzero(touch[1:-1]) + 1
        left, right = order[touched - 1], order[touched]
        same = np.flatnonzero(bwt[left] == bwt[right])
        grown = np.zeros(len(touched), np.uint8)
        grown[same] = np.minimum(range_minimum(lcp, left[same] + 1, right[same] + 1), deep - 1) + 1
        who = member[order[fresh]]
        old = np.ones(len(order), bool)
        old[fresh] = False
        grown_to = []
        for was, values in ((bwt, before(who, r + 1)), (lcp, 0), (member, who), (used, r + 1)):
            out = np.empty(m + len(order), was.dtype)
            out[:m] = was[:m]
            tail = out[m:]
            tail[old] = was[m:]
            tail[fresh] = values
            grown_to.append(out)
        grown_to[1][m + touched] = grown
        files.write(*grown_to)
    _, lcp, member, used = files.read()
    files.drop()
    # A suffix of fewer symbols can't share ``deep`` of them, so leaving it out parts no class.
    far = used >= deep
    start = phase[member] + symbol * (columns[member] - used)
    return owner[member[far]], start[far], lcp[far] >= deep


def cores(strings: list[bytes], anchors: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(string, band, core, from, to): the windows of each passage in bands, by their distance from the anchor, with a hash of the bytes that all windows of the band hold.

    Equal windows have equal anchors at equal distances, so they are in one band and share its core. Windows whose core stands in one passage only repeat nowhere.
    """
    band = max(1, (length - GRAM + 1) // BANDS)
    sizes = np.array([len(s) for s in strings], np.int64)
    heads = np.concatenate([[0], np.cumsum(sizes)])
    sums, down = prefix_sums(np.frombuffer(b"".join(strings), np.uint8), lower=False)
    at = np.arange(max(0, heads[-1] - GRAM + 1))
    owner = np.repeat(np.arange(len(strings)), sizes)[: len(at)]
    # The anchor is the leftmost of equal grams in each of its windows, so nothing before it in the passage is equal.
    found = np.flatnonzero((range_hash(sums, down, at, at + GRAM) == anchors[owner]) & (at + GRAM <= heads[owner + 1]))
    found = found[np.r_[True, owner[found][1:] != owner[found][:-1]]] if len(found) else found
    if len(found) != len(strings):
        raise RuntimeError("a passage without its anchor")
    where = found - heads[:-1]
    low, high = where - (sizes - length), where  # distances of the last and the first window
    first, n = low // band, high // band - low // band + 1
    which = np.repeat(np.arange(len(strings)), n)
    k = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + first[which]
    start = found[which] - k * band
    core = range_hash(sums, down, start, start + length - band + 1)
    core = mix(core ^ mix(anchors[which] + k.astype(U)))
    return which, k, core, where[which] - np.minimum((k + 1) * band - 1, high[which]), where[which] - np.maximum(k * band, low[which]) + 1


def runs(which: np.ndarray, k: np.ndarray, lo: np.ndarray, hi: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, from, to): the bands that are kept, those next to each other as one."""
    at = np.flatnonzero(keep)
    which, k, lo, hi = which[at], k[at], lo[at], hi[at]
    new = np.r_[True, (which[1:] != which[:-1]) | (k[1:] != k[:-1] + 1)] if len(at) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(at)].astype(np.int64) - 1 if len(at) else first
    return which[first], lo[last], hi[first]  # larger distances start further left


def pieces(strings: list[bytes], which: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int) -> list[bytes]:
    """The bytes of the windows from ``lo`` to ``hi`` of each string."""
    return [strings[i][a : b + length - 1] for i, a, b in zip(which.tolist(), lo.tolist(), hi.tolist())]


class Held:
    """Passages of whole groups, in order of their places: (doc, place, bytes, anchor) of each."""

    def __init__(self, docs: np.ndarray, places: np.ndarray, strings: list[bytes], anchors: np.ndarray, hot: np.ndarray):
        self.docs, self.places, self.strings, self.anchors, self.hot = docs, places, strings, anchors, hot

    def __len__(self) -> int:
        return len(self.strings)

    def take(self, at: np.ndarray, strings: list[bytes] | None = None, start: np.ndarray | int = 0) -> Held:
        return Held(self.docs[at], self.places[at] + start, [self.strings[i] for i in at.tolist()] if strings is None else strings, self.anchors[at], self.hot[at])

    def trimmed(self, length: int) -> Held:
        """Without the windows that stand in one passage only."""
        if not len(self):
            return self
        which, k, core, lo, hi = cores(self.strings, self.anchors, length)
        _, back, times = np.unique(core, return_inverse=True, return_counts=True)
        which, lo, hi = runs(which, k, lo, hi, times[back] > 1)
        return self.take(which, pieces(self.strings, which, lo, hi, length), lo)

    def gathered(self, length: int) -> tuple[list, Held]:
        """(ranges of passages that are equal to an earlier one, those that stay)."""
        seen, first, lost = set(), [], []
        for i, x in enumerate(zip(self.anchors.tolist(), self.strings)):
            if x in seen:
                lost.append((int(self.docs[i]), int(self.places[i]), int(self.places[i]) + len(x[1]) - length + 1))
            else:
                seen.add(x)
                first.append(i)
        return lost, self.take(np.array(first, np.int64))

    def contested(self, length: int) -> tuple[list, Held, Held]:
        """(ranges that repeat an earlier place, what is left to be put in order, the same of hot anchors).

        Of passages that are cut to what others have too, many are equal. What these held in common may leave the first of them alone with some
        windows, so both is done twice. Hot anchors have been cut before, over all blocks.
        """
        lost, cool = [], self.take(np.flatnonzero(~self.hot))
        for _ in range(2):
            more, cool = cool.trimmed(length).gathered(length)
            lost += more
        more, hot = self.take(np.flatnonzero(self.hot)).gathered(length)
        return lost + more, cool, hot


def judge_block(docs: np.ndarray, places: np.ndarray, strings: list[bytes], hot: np.ndarray, length: int, folder: str) -> tuple[list, list]:
    """(doc, from, to) ranges of window starts that repeat an earlier place, and (hash, hash, doc, place) of hot classes."""
    which, start, common = collection_order(strings, length, folder, symbol_for(length, WIDE))
    if not len(which):
        return [], []
    heads = np.flatnonzero(~common)
    rank = np.unique(docs, return_inverse=True)[1]
    place = places[which] + start
    key = np.lexsort((place, rank[which]))
    turn = np.empty(len(key), np.int64)
    turn[key] = np.arange(len(key))
    best = np.minimum.reduceat(turn, heads)
    again = turn != np.repeat(best, np.diff(np.append(heads, len(turn))))
    # Runs of repeats inside each string.
    w, s = which[again], start[again]
    by = np.lexsort((s, w))
    w, s = w[by], s[by]
    cut = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]) | (s[1:] != s[:-1] + 1)]) if len(w) else np.zeros(0, int)
    ends = np.r_[cut[1:], len(w)] - 1 if len(w) else cut
    lost = [(int(docs[w[a]]), int(places[w[a]] + s[a]), int(places[w[a]] + s[b] + 1)) for a, b in zip(cut, ends)]
    told = []
    for i in np.flatnonzero(~again & hot[which]):
        piece = strings[which[i]][start[i] : start[i] + length]
        h = hashlib.blake2b(piece, digest_size=16).digest()
        told.append((int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True), int(docs[which[i]]), int(place[i])))
    return lost, told


def hot_pieces(hot: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """(hot anchors' passages without the windows that stand in one of them only, the stored table that they rest on).

    The passages of such an anchor go to several blocks, and a block tells the first place of each class. So windows that nothing repeats are cut off
    before: the cores of all bands are counted by exchange.
    """
    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            strings = batch.column(3).to_pylist()
            if strings:
                which, k, core, _, _ = cores(strings, batch.column(0).to_numpy().view(U), length)
                columns = [batch.column(c).take(pa.array(which)) for c in range(3)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(k.astype(np.int32)), pa.array(core.astype(np.int64))], ["anchor", "key", "place", "k", "core"])

    bands = hot.select("anchor", "key", "place", "bytes").mapInArrow(band, "anchor long, key long, place long, k int, core long")
    # Stored, so that both sides of the join are plain exchanges and a frequent core can be split.
    shared = stored(bands.groupBy("anchor", "core").count().filter("count > 1").select("anchor", "core"), "cores")
    kept = bands.join(shared.hint("merge"), ["anchor", "core"], "left_semi").groupBy("key", "place").agg(F.collect_list("k").alias("ks"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            strings = batch.column(5).to_pylist()
            if strings:
                which, k, _, lo, hi = cores(strings, batch.column(0).to_numpy().view(U), length)
                ks = batch.column(6)
                want = np.repeat(np.arange(len(ks)), np.diff(ks.offsets.to_numpy())) * 1_000 + ks.flatten().to_numpy()
                which, lo, hi = runs(which, k, lo, hi, np.isin(which * 1_000 + k, want))
                columns = [batch.column(c).take(pa.array(which)) for c in range(5)]
                columns[3] = pa.array(columns[3].to_numpy() + lo)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(pieces(strings, which, lo, hi, length), pa.binary())], ["anchor", "body", "key", "place", "bodies", "bytes"])

    cut_ = hot.join(kept.hint("merge"), ["key", "place"]).select("anchor", "body", "key", "place", "bodies", "bytes", "ks")
    return cut_.mapInArrow(cut, "anchor long, body long, key long, place long, bodies long, bytes binary"), shared


def repeated_ranges(rows: DataFrame, length: int) -> DataFrame:
    """rows (key, part, text) -> (key, part, spans): the window starts [s, e) of each row that repeat an earlier place."""
    spark = rows.sparkSession

    def cell_of(anchor: np.ndarray) -> np.ndarray:
        # Anchors are least hashes, so their high bits are alike until mixed.
        return (mix(anchor) >> U(64 - CELL_BITS)).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << CELL_BITS, np.uint32)
        for batch in batches:
            for _, _, data, off in text_chunks(batch.column(0), SCAN):
                cells += np.bincount(cell_of(passages(data, off, length)[3]), minlength=len(cells)).astype(np.uint32)
        yield pa.RecordBatch.from_arrays(cell_blocks(cells), ["block", "cells"])

    cells = summed(rows.select("text").mapInArrow(count, "block int, cells binary"), 1 << CELL_BITS)
    fair = max(LEAST_CELL, float(cells.sum(dtype=np.float64)) / (1 << CELL_BITS))
    # Of fixed size: one number for each cell; 0 where it isn't spread.
    spread = spark.sparkContext.broadcast(np.where(cells > SPREAD * fair, np.ceil(cells / fair), 0).astype(np.uint64))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = spread.value
        for batch in batches:
            keys, parts = (batch.column(c).to_numpy() for c in (0, 1))
            for i, _, data, off in text_chunks(batch.column(2), SCAN):
                text, first, n, anchor, whole = passages(data, off, length)
                key, place = keys[i + text], (parts[i + text] << AT_BITS) + first
                many = salts[cell_of(anchor)] if len(anchor) else anchor
                salt = np.where(many > 0, U(1) + mix(key.astype(U) ^ mix(place.astype(U))) % np.maximum(many, U(1)), U(0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.astype(np.int64)), pa.array(salt.astype(np.int32)), pa.array(whole.astype(np.int64)), pa.array(key),
                     pa.array(place), pa.array(n.astype(np.int32))],
                    ["anchor", "salt", "body", "key", "place", "n"],
                )

    found = rows.mapInArrow(scan, "anchor long, salt int, body long, key long, place long, n int")
    whole = Window.partitionBy("anchor", "salt")
    ordered = whole.orderBy("body", "n", "key", "place")
    again = (
        found.withColumn("times", F.count("*").over(whole)).filter("times > 1 OR salt > 0")
        .withColumn("was", F.lag(F.struct("body", "n")).over(ordered))
        .withColumn("kind", F.when(F.col("was.body").isNull() | (F.col("was.body") != F.col("body")) | (F.col("was.n") != F.col("n")), 1).otherwise(0))
        .withColumn("bodies", F.sum("kind").over(whole))
        .select("anchor", "salt", "body", "key", "place", "n", "kind", "bodies")
    )
    again = stored(again, "passages")
    release(spark)
    # Spread anchors: a body has at most one place left for each salt.
    by_body = Window.partitionBy("anchor", "body", "n").orderBy("key", "place")
    left = again.filter("salt > 0 AND kind = 1").withColumn("turn", F.row_number().over(by_body))
    left = stored(left.select("anchor", "body", "key", "place", "n", "turn"), "spread")
    heads = left.filter("turn = 1").drop("turn")
    # Stored, so that both sides of the join are plain exchanges and a hot anchor can be split.
    bodies = stored(heads.groupBy("anchor").agg(F.count("*").alias("bodies")).filter("bodies > 1"), "bodies")
    copies = again.filter("kind = 0").select("key", "place", "n").unionByName(left.filter("turn > 1").select("key", "place", "n"))
    firsts = (
        again.filter("salt = 0 AND kind = 1 AND bodies > 1").select("anchor", "body", "key", "place", "n", "bodies")
        .unionByName(heads.join(bodies.hint("merge"), "anchor").select("anchor", "body", "key", "place", "n", "bodies"))
    )

    # The bytes of the first places, cut out of their texts.
    wanted = firsts.groupBy("key", (F.shiftright("place", AT_BITS)).alias("part")).agg(
        F.collect_list(F.struct("anchor", "body", "place", "n", "bodies")).alias("want")
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wants, x = batch.column(2), batch.column(2).flatten()
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(wants).to_numpy())])
            for i, n, data, off in text_chunks(batch.column(1)):
                raw, own = data.tobytes(), x.slice(ends[i], ends[i + n] - ends[i])
                doc = np.repeat(np.arange(n), np.diff(ends[i : i + n + 1]))
                start = off[doc] + (own.field("place").to_numpy() & ((1 << AT_BITS) - 1))
                end = start + own.field("n").to_numpy() + length - 1
                yield pa.RecordBatch.from_arrays(
                    [own.field("anchor"), own.field("body"), batch.column(0).take(pa.array(doc + i)), own.field("place"), own.field("bodies"),
                     pa.array([raw[a:b] for a, b in zip(start.tolist(), end.tolist())], pa.binary())],
                    ["anchor", "body", "key", "place", "bodies", "bytes"],
                )

    strings = (
        rows.join(wanted.hint("merge"), ["key", "part"]).select("key", "text", "want")
        .mapInArrow(cut, "anchor long, body long, key long, place long, bodies long, bytes binary")
    )
    strings = stored(strings, "strings")
    release(spark)
    cool, hot, cores_ = strings.filter(F.col("bodies") <= HOT), strings.filter(F.col("bodies") > HOT), None
    if not hot.isEmpty():
        hot, cores_ = hot_pieces(hot, length)
    salt = F.when(F.col("bodies") > HOT, F.pmod("body", F.ceil(F.col("bodies") / HOT).cast("long"))).otherwise(0)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = shared_path(spark, "bwt")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        left: list[Held] = []
        now = None

        def told_of(lost: list, told: list) -> pa.RecordBatch:
            rows_ = [(k, a, b, None, None) for k, a, b in lost] + [(k, p, p + 1, h, g) for h, g, k, p in told]
            cols = list(zip(*rows_)) if rows_ else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], ["key", "a", "b", "h", "g"])

        def settled() -> pa.RecordBatch:
            held.sort(key=lambda x: (x[0], x[1]))
            docs, places, strings_, hot_, anchors = zip(*held)
            block = Held(np.array(docs, np.int64), np.array(places, np.int64), list(strings_), np.array(anchors, np.int64).view(U), np.array(hot_, bool))
            lost, *rest = block.contested(length)
            left.extend(x for x in rest if len(x))
            return told_of(lost, [])

        def judged() -> pa.RecordBatch:
            out = told_of(*judge_block(
                np.concatenate([x.docs for x in left]), np.concatenate([x.places for x in left]), [s for x in left for s in x.strings],
                np.concatenate([x.hot for x in left]), length, folder,
            ))
            left.clear()
            return out

        for batch in batches:
            for anchor, salt_, key, place, hot_, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if (anchor, salt_) != now and len(held) >= BLOCK:
                    yield settled()
                    held = []
                    if sum(map(len, left)) >= BLOCK:
                        yield judged()
                now = (anchor, salt_)
                held.append((key, place, raw, hot_, anchor))
        if held:
            yield settled()
        if left:
            yield judged()

    judged = (
        cool.unionByName(hot).select("anchor", salt.cast("long").alias("salt"), "key", "place", (F.col("bodies") > HOT).alias("hot"), "bytes")
        .repartition(partitions, "anchor", "salt").sortWithinPartitions("anchor", "salt")
        .mapInArrow(build, "key long, a long, b long, h long, g long")
    )
    judged = stored(judged, "ranges")
    drop_folder(spark, folder)
    release(spark)
    told = judged.filter("h IS NOT NULL")
    best = told.groupBy("h", "g").agg(F.min(F.struct("key", "a")).alias("best"))
    across = told.join(best, ["h", "g"]).filter(F.struct("key", "a") != F.col("best")).select("key", "a", "b")
    ranges = (
        judged.filter("h IS NULL").select("key", "a", "b").unionByName(across)
        .unionByName(copies.select("key", F.col("place").alias("a"), (F.col("place") + F.col("n")).alias("b")))
    )
    low = (1 << AT_BITS) - 1
    # The ranges of one row; a row has no more of them than windows.
    spans = ranges.groupBy("key", F.shiftright("a", AT_BITS).alias("part")).agg(
        F.collect_list(F.struct(F.col("a").bitwiseAND(low).alias("a"), F.col("b").bitwiseAND(low).alias("b"))).alias("spans")
    )
    spans = stored(spans, "spans")
    discard(again, left, bodies, strings, judged, *([cores_] if cores_ is not None else []))
    return spans


def substring_dedup(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): each document without its repeated strings of ``length`` bytes.

    A byte goes if a string of ``length`` bytes that covers it also starts
    earlier: in a smaller id, or in the same document further up.
    """
    if length <= GRAM:
        raise ValueError(f"length must be above {GRAM}")
    rows = with_part(docs)
    spans = repeated_ranges(rows, length)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, gone, runs, kept = [], [], [], []
            for text, want in zip(batch.column(1), batch.column(2)):
                raw = (text.as_py() or "").encode()
                size.append(len(raw))
                if not want.is_valid:
                    gone.append(0), runs.append(0), kept.append(raw)
                    continue
                edge = np.zeros(len(raw) + 1, np.int32)
                np.add.at(edge, want.values.field("a").to_numpy(), 1)
                np.add.at(edge, want.values.field("b").to_numpy() + length - 1, -1)
                lost = np.cumsum(edge[:-1]) > 0
                gone.append(int(lost.sum()))
                runs.append(int(np.count_nonzero(lost[1:] & ~lost[:-1]) + lost[0]))
                kept.append(np.frombuffer(raw, np.uint8)[~lost].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in (size, gone, runs)), pa.array(kept, pa.binary())],
                ["key", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    joined = rows.join(spans.hint("merge"), ["key", "part"], "left").select("key", "text", "spans")
    out = joined.mapInArrow(strip, "key long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.select(F.when(F.col("key") < MAX_ID, F.col("key")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = substring_dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
