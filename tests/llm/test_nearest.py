"""Tiles where ids repeat, and how often rows are copied."""

import numpy as np
from pyspark.sql import functions as F

from colloquy.llm import ann


def tile_of(m, ids, k=5):
    q8 = ann.quantised(ann.unit_rows(m))
    return list(ann.survivors(ids, q8, ids, q8, k))


def test_pairs_that_survive_where_one_row_is_repeated():
    """A row that stands 600 times, and an id with 600 vectors, let no more pairs of other ids through."""
    rng = np.random.default_rng(4)
    m = rng.normal(size=(3_000, 32))
    ids = np.arange(3_000)
    plain = sum(len(i) for _, i, *_ in tile_of(m, ids))
    more, same = np.concatenate([m, np.repeat(m[:1], 600, axis=0)]), np.concatenate([ids, np.zeros(600, int)])
    others = sum(int((i != 0).sum()) for q, i, *_ in tile_of(more, same) if q != 0)
    assert others <= plain and plain < 20 * len(ids)
    spread = np.concatenate([m, rng.normal(size=(600, 32))])
    assert sum(int((i != 0).sum()) for q, i, *_ in tile_of(spread, same) if q != 0) <= plain


def test_an_id_with_very_many_vectors(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(700, 8))
    rows = [(i if i < 400 else 7, [float(x) for x in v]) for i, v in enumerate(m)] + [(9, [float(x) for x in m[9]])] * 600
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    u = m / np.linalg.norm(m, axis=1)[:, None]
    own = np.array([i if i < 400 else 7 for i in range(700)])
    for block in (64, 8_192):
        got = ann.nearest(df, F.col("vec_id") % 50 == 0, block=block, queries=3).collect()
        for q in range(0, 400, 50):
            best = {}
            for i, s in zip(own, u @ u[q]):
                if i != q:
                    best[i] = max(best.get(i, -9), s)
            want = sorted(best, key=lambda i: (-round(best[i], 12), i))[:5]
            assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == want
