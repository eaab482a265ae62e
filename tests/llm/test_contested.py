"""Passages are cut to what others hold too before they are put in order."""

import random

import numpy as np

from colloquy.llm import suffix_dedup

from .test_operators import brute_substrings, words


def passages_of(texts, length=100):
    """One group of passages per anchor that several texts hold, as (anchor, doc, place, bytes)."""
    out = []
    for doc, t in enumerate(texts):
        data = np.frombuffer(t.encode(), np.uint8)
        _, first, n, anchor, _ = suffix_dedup.passages(data, np.array([0, len(data)]), length)
        out += [(int(a), doc, int(f), t.encode()[f : f + k + length - 1]) for a, f, k in zip(anchor, first, n)]
    return sorted(out)


def held(rows):
    return suffix_dedup.Held(
        np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), [r[3] for r in rows], np.array([r[0] for r in rows], np.uint64), np.zeros(len(rows), bool),
    )


def test_passages_that_share_only_their_anchor_are_not_put_in_order():
    rng = random.Random(5)
    phrase = "the party of the first part hereby"
    block = held(passages_of([f"{words(40, rng)} {phrase} {words(40, rng)}" for _ in range(30)]))
    lost, cool, hot = block.contested(100)
    assert len(block) > 30 and not lost and not len(cool) and not len(hot)


def test_cut_passages_lose_the_windows_that_whole_ones_lose(tmp_path):
    rng = random.Random(6)
    common = words(50, rng)
    texts = [f"{words(rng.randint(1, 40), rng)} {common[rng.randint(0, 60) : rng.randint(150, len(common))]} {words(rng.randint(1, 40), rng)}" for _ in range(25)]
    block = held(sorted(passages_of(texts), key=lambda r: (r[1], r[2])))

    def windows(ranges):
        return {(d, p) for d, a, b in ranges for p in range(a, b)}

    whole, _ = suffix_dedup.judge_block(block.docs, block.places, block.strings, block.hot, 100, f"file://{tmp_path}/bwt")
    lost, cool, _ = block.contested(100)
    rest, _ = suffix_dedup.judge_block(cool.docs, cool.places, cool.strings, cool.hot, 100, f"file://{tmp_path}/bwt")
    assert windows(lost) | windows(rest) == windows(whole) and len(windows(whole)) > 500
    assert sum(map(len, cool.strings)) < sum(map(len, block.strings)) / 2


def test_blocks_tell_only_classes_that_may_repeat(spark, monkeypatch):
    """A block told every class of a hot anchor, nearly all of them of one window."""
    rng = random.Random(7)
    common, told = words(25, rng), []
    rows = [(i, f"{words(60, rng)} {common} {words(60, rng)}") for i in range(24)]
    keep = suffix_dedup.stored

    def stored(df, name, *more):
        out = keep(df, name, *more)
        if name == "ranges":
            told.append(out.filter("h IS NOT NULL").count())
        return out

    monkeypatch.setattr(suffix_dedup, "HOT", 2)
    monkeypatch.setattr(suffix_dedup, "stored", stored)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_substrings(rows, 100)
    repeated = len(common) + 20 - 99  # windows in the common passage, and those that reach over its ends by chance or by a band
    assert 0 < told[0] < 12 * repeated
