"""Vectorised words and shingles over the UTF-8 bytes of whole texts.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``, with A-Z lower-cased.
All functions work on the bytes of several texts at once, so that no Python
object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes handled at once; a longer text is handled alone.
CHUNK = 1 << 20
#: An odd multiplier, its inverse modulo 2**64, and the finaliser's multipliers.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: White space and all other ASCII signs that are no letters or digits.
SIGNS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK)
        for name, base in (("up", BASE), ("down", INVERSE)):
            a = np.full(size, base, U)
            a[0] = 1
            _powers[name] = np.multiply.accumulate(a)
    up, down = _powers["up"], _powers["down"]
    if len(up) > 4 * CHUNK:  # a very long text: don't keep its tables
        _powers.clear()
    return up[:n], down[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(30))
    h = h * U(MIX[0])
    h ^= h >> U(27)
    h *= U(MIX[1])
    h ^= h >> U(31)
    return h


def text_chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets): runs of texts of at most ``limit`` bytes, or one longer text; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j - i, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def prefix_sums(data: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Sums that give the polynomial hash of any byte range; see ``range_hash``."""
    up, down = powers(len(data) + 1)
    value = (LOWER[data] if lower else data).astype(U) + U(1)
    value *= up[: len(data)]
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(value, out=sums[1:])
    return sums, down


def range_hash(sums: np.ndarray, down: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    h = (sums[end] - sums[start]) * down[start]
    return mix(h + (end - start).astype(U) * U(MIX[0]))


def word_bounds(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each text): words never cross texts."""
    n = len(data)
    inside = ~between[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0], after[-1] = True, True
        before[1:] = ~inside[:-1]
        after[:-1] = ~inside[1:]
        before |= edge[:n]
        after |= edge[1:]
    start = np.flatnonzero(inside & before)
    end = np.flatnonzero(inside & after) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of the first word of each text and the end)."""
    start, end, first = word_bounds(data, offsets, between)
    sums, down = prefix_sums(data)
    return range_hash(sums, down, start, end), first


def shingle_sets(words: np.ndarray, first: np.ndarray, width: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer words than ``width`` make one shingle, none make none."""
    n = len(words)
    step = [U(pow(BASE, 2 * k + 3, 1 << 64)) for k in range(width)]
    total = np.zeros(max(0, n - width + 1), U)
    for k in range(width if n >= width else 0):
        total += words[k : n - width + 1 + k] * step[k]
    total = mix(total)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            yield np.unique(total[a : b - width + 1])
        elif b > a:
            part = words[a:b]
            yield mix(np.array([int(np.sum(part * np.array(step[: b - a], U), dtype=U)) ^ (b - a)], U))
        else:
            yield total[:0]
