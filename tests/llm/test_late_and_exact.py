"""Exact dedup, the day layout and the filter audit against brute force."""

import collections
import datetime as dt
import hashlib
import itertools
import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from colloquy.llm import day_layout, exact_dedup, filter_audit
from colloquy.llm.queries import QUERIES, SQL
from tests.conftest import same

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, source string"


def prose(n, rng):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Groups of copies up to a third of the rows, odd ids and texts."""
    rng = random.Random(3)
    hot, out = prose(70, rng), []
    for i in range(60):
        out.append((i, hot if i % 3 == 0 else prose(rng.randint(1, 90), rng) if i % 5 else "same words here", f"src{i % 4}" if i % 7 else None))
    out += [(60, None, "a"), (61, "", ""), (62, " \n\t", "a"), (63, "Ä € 𝄞 &", "a"), (64, "LOUD " * 60, "a"), (65, prose(4000, rng), "a")]
    out += [(None, hot, None), (None, "only here", "b"), (None, None, "b"), (7, hot, "src1"), (7, hot, "src1"), (7, hot, "src2")]
    return out


def written(spark, rows, path, parts):
    extra = {c: F.lit("x") for c in ("key", "file", "at", "digest", "n", "part", "mask", "salt", "good")}
    for k in range(parts):
        spark.createDataFrame(rows[k::parts], DOC).withColumns(extra).coalesce(1).write.mode("append").parquet(path)
    return path


def groups_of(rows):
    out = collections.defaultdict(list)
    for i, t, _ in rows:
        out[t or ""].append(math.inf if i is None else i)
    return out


def expected_dedup(rows):
    """(doc_id, keep_id, group_size) of each row; how many are kept of each text."""
    groups, shown = groups_of(rows), lambda k: None if k == math.inf else k
    return collections.Counter((i, shown(max(groups[t or ""])), len(groups[t or ""])) for i, t, _ in rows)


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.substring(F.sha2(t.cast("binary"), 256), 1, 1)], ids=["sha256", "one digit"])
def test_exact_dedup(spark, rows, tmp_path, digest):
    """In several batches; also where the digest is so short that most texts share theirs, so that bytes decide."""
    path = written(spark, rows, str(tmp_path / "docs"), 5)
    out = exact_dedup.exact_dedup(spark, path, f"file://{tmp_path}/home", files_each=2, digest=digest)
    got = out.withColumn("kept", F.struct("key", "file", "at") == F.col("stays")).collect()
    shown = lambda k: None if k == exact_dedup.MAX_ID else k
    assert collections.Counter((shown(r["key"]), shown(r["stays"]["key"]), r["n"]) for r in got) == expected_dedup(rows)
    assert len(got) == len(rows) and sum(r["kept"] for r in got) == len(groups_of(rows))
    assert all(r["stays"]["key"] == r["key"] for r in got if r["kept"])
    assert len([f for f in os.listdir(tmp_path / "home/groups") if f.startswith("batch=")]) >= 4  # three batches and the empty start


def test_exact_dedup_goes_on_from_its_state(spark, rows, tmp_path):
    path, home = str(tmp_path / "docs"), f"file://{tmp_path}/home"
    written(spark, rows[:30], path, 2)
    first = exact_dedup.take_in(spark, path, home, 1)
    assert first.agg(F.sum("n")).first()[0] == 30
    written(spark, rows[30:], path, 1)
    out = exact_dedup.exact_dedup(spark, path, home, 1)
    read = out.sparkSession.read.parquet(f"{tmp_path}/home/groups")
    assert read.filter("batch >= 2").agg(F.count("*")).first()[0] < len(groups_of(rows))  # old groups without new rows aren't touched
    shown = lambda k: None if k == exact_dedup.MAX_ID else k
    got = collections.Counter((shown(r["key"]), shown(r["stays"]["key"]), r["n"]) for r in out.collect())
    assert got == expected_dedup(rows)
    again = exact_dedup.exact_dedup(spark, path, home, 1)
    assert collections.Counter((shown(r["key"]), shown(r["stays"]["key"]), r["n"]) for r in again.collect()) == got


def test_exact_dedup_raises_where_files_change(spark, rows, tmp_path):
    path, home = str(tmp_path / "docs"), f"file://{tmp_path}/home"
    written(spark, rows[:30], path, 2)
    exact_dedup.take_in(spark, path, home)
    for f in sorted((tmp_path / "docs").glob("*.parquet"))[:1]:
        f.unlink()
    with pytest.raises(RuntimeError, match="doesn't count"):
        exact_dedup.exact_dedup(spark, path, home).collect()


def test_exact_dedup_of_an_empty_table_and_a_single_file(spark, tmp_path):
    spark.createDataFrame([], DOC).coalesce(1).write.parquet(str(tmp_path / "none"))
    assert exact_dedup.exact_dedup(spark, str(tmp_path / "none"), f"file://{tmp_path}/a").count() == 0
    assert same(spark, QUERIES["op11_exact_dedup"](spark, SF), SQL["op11_exact_dedup"], {"documents": f"{SF}/documents.parquet"}) == 200


# Filter audit


def brute_mask(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return (len(w) < 50) + 2 * (100 * len(set(w)) < 65 * len(w)) + 4 * (100 * len(re.findall("[A-Z]", t)) > 5 * len(t)) + 8 * bool(re.search(r"[#$%&*|]", t))


def brute_audit(rows, labels):
    first = {t: min(k) for t, k in groups_of(rows).items()}
    good, toxic = ({i for i, *f in labels if i is not None and f[k] == 1} for k in (0, 1))
    parts, out = collections.defaultdict(list), {}
    for i, t, s in rows:
        m = brute_mask(t) + 16 * ((math.inf if i is None else i) > first[t or ""])
        parts[s or ""].append((m, i in good, i in toxic))
    for part, docs in parts.items():
        fair = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = docs
            for k, f in enumerate(order, 1):
                bit = 1 << "ABCDE".index(f)
                gone, now = [d for d in left if d[0] & bit], [d for d in left if not d[0] & bit]
                fair[f] += len(gone)
                out[part, "".join(order), k] = [len(now), len(gone), sum(bool(d[0] & bit) for d in docs) - len(gone), sum(d[0] == bit for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone)]
                left = now
        for (p, order, k), v in out.items():
            if p == part:
                v.append(fair[order[k - 1]])
    return out


def told(df):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in df.collect()}


def test_filter_audit(spark, rows, tmp_path):
    docs = spark.read.parquet(written(spark, rows, str(tmp_path / "docs"), 3))
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 66, 2)] + [(7, 0, None), (7, 1, 1), (None, 1, 1), (3, None, None)]
    kinds = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("key", F.lit(1))
    got, want = told(filter_audit.filter_audit(docs, kinds)), brute_audit(rows, labels)
    assert got == want and len(want) == 600 * len({s or "" for *_, s in rows})


def test_filter_audit_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(spark.createDataFrame([], DOC), none).count() == 0
    rows = [(None, "t & u", None), (None, "t & u", ""), (1, None, "a"), (2, "", "a")]
    assert told(filter_audit.filter_audit(spark.createDataFrame(rows, DOC), none)) == brute_audit(rows, [])


def test_filter_audit_sql(spark):
    tables = {t: f"{SF}/{t}.parquet" for t in ("documents", "labels")}
    assert same(spark, QUERIES["op13_filter_audit"](spark, SF), SQL["op13_filter_audit"], tables) % 600 == 0


@pytest.mark.parametrize("bits", [64, 3, 1])
def test_distinct_words_where_hashes_meet(bits):
    rng = random.Random(9)
    texts = [prose(rng.randint(0, 60), rng) + " " + "w" * rng.choice([1, 255, 256, 257, 900]) + " x" * rng.randint(0, 3) for _ in range(40)] + ["", "  ", "ab ab aB é é"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    words, distinct = filter_audit.distinct_words(data, offsets, bits)
    assert words.tolist() == [len(t.split()) for t in texts] and distinct.tolist() == [len(set(t.split())) for t in texts]


# Day layout

SALE = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int"
EPOCH = dt.datetime(1970, 1, 1)
CUT = dt.datetime(2024, 3, 1)


def day(t):
    return -1 if t is None else (t - EPOCH).days


def corrected(rows):
    out = list(rows)
    for s, c, st, total, sold, arrived, p in rows:
        if s is None or sold is None:
            continue
        h = zlib.crc32(str(s).encode())
        if h % 3 == 0 and day(sold) % 10 == 0:
            later = None if arrived is None else arrived + dt.timedelta(days=1 + h % 97)
            out.append((s, c, st, None if total is None else total + 1, sold + dt.timedelta(days=h % 2), later, p))
    return out


def rank_of(r):
    lift = lambda v: (v is not None, v if v is not None else 0)
    s, c, st, total, sold, arrived, p = r
    return tuple(map(lift, (arrived,))) + tuple((v is not None, v) if v is not None else (False, 0) for v in (c, st, total, sold, p))


def winners(rows):
    best = {}
    for r in rows:
        if r[0] not in best or rank_of(r) > rank_of(best[r[0]]):
            best[r[0]] = r
    return best


def laid(best, stride):
    days = collections.defaultdict(list)
    for r in best.values():
        days[day(r[4])].append(r)
    low = lambda v, z: (v is not None, v or z)
    for d in days.values():
        d.sort(key=lambda r: (low(r[4], EPOCH), low(r[0], 0)))
    return {(d, k // stride): rs[k : k + stride] for d, rs in days.items() for k in range(0, len(rs), stride)}


def expected_files(rows, files=900):
    stride, every = 1 + len(rows) // files, corrected(rows)
    early = [r for r in every if r[5] is not None and r[5] < CUT]
    late = [r for r in every if r[5] is None or r[5] >= CUT]
    start, end = winners(early), winners(every)
    kept = [s for s, r in end.items() if any(r is x for x in late)]
    dirty = {day(end[s][4]) for s in kept} | {day(start[s][4]) for s in kept if s in start}
    us = lambda t: "" if t is None else str((t - EPOCH) // dt.timedelta(microseconds=1))
    text = lambda s: "" if s is None else str(s)
    out = {}
    for (d, k), rs in laid(end, stride).items():
        crc = sum(zlib.crc32(f"{text(r[0])}:{us(r[4])}:{us(r[5])}".encode()) for r in rs)
        cents = sum(0 if r[3] is None or not math.isfinite(r[3]) else math.floor(100 * r[3] + 0.5) for r in rs)
        out[d, k] = (len(rs), cents, crc, hashlib.sha256(",".join(text(r[0]) for r in rs).encode()).hexdigest(), d in dirty)
    return out


def result(df):
    return {(r["day"], r["file_no"]): (r["n_rows"], r["cents"], r["rows_crc"], r["ids_sha256"], r["rewritten"]) for r in df.collect()}


def sales(n, rng, repeats=True):
    """A third of the rows on one day, most of them at one time; repeated, late and broken rows."""
    out = []
    for i in range(n):
        sold = dt.datetime(2024, 1, 11) if i % 3 == 0 else dt.datetime(2024, 1, 1) + dt.timedelta(days=rng.randrange(90), seconds=rng.randrange(86_400), microseconds=rng.choice([0, 1, 999_999]))
        arrived = (sold if rng.random() < 0.9 else dt.datetime(2024, 2, 20)) + dt.timedelta(days=rng.choice([0, 0, 0, 60]), seconds=rng.randrange(99))
        total = rng.choice([None, 0.005, 1.115, 10.0, 99.99, float("nan"), -3.5])
        out.append((i, i % 7, rng.choice(["open", None, "done"]), total, None if i % 50 == 7 else sold, arrived, i % 5))
    if repeats:
        more = [(s, c, "again", t, None if so is None else so + dt.timedelta(days=rng.randrange(3)), a + dt.timedelta(days=rng.randrange(-9, 60)), p) for s, c, _, t, so, a, p in rng.sample(out, n // 5)]
        out += more + more[:5] + [(None, 1, "x", 1.0, dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 6), 1), (None, 1, "y", 2.0, None, dt.datetime(2024, 4, 6), 1), (n + 1, 1, "z", 2.0, dt.datetime(2024, 1, 7), None, 1)]
    return out


def test_day_layout_against_brute_force(spark, tmp_path):
    rows = sales(400, random.Random(4))
    layout = day_layout.late_layout(spark, spark.createDataFrame(rows, SALE).repartition(5), f"file://{tmp_path}/a", files=60)
    got, want = layout.files(), expected_files(rows, 60)
    assert result(got) == want and {True, False} == {v[-1] for v in want.values()}
    listed = {r["path"]: r for r in got.collect()}
    assert set(listed) == {str(p) for p in (tmp_path / "a").rglob("*.parquet")}
    for p, r in listed.items():
        t = pq.ParquetFile(p).read()
        assert ",".join(t.column_names) == r["columns"] == "sale_id,client_id,status,total,sold_at,arrived_at,priority" and t.num_rows == r["n_rows"]


def test_day_layout_leaves_other_files_as_they_are(spark, tmp_path):
    rows = [(i, 1, "a", 1.0, dt.datetime(2024, 1, 1 + i % 9, 5), dt.datetime(2024, 1, 20), 1) for i in range(90)]
    layout = day_layout.Layout(spark, f"file://{tmp_path}/b", 4)
    layout.write(spark.createDataFrame(rows, SALE), 0)
    seen = {p: (p.read_bytes(), p.stat().st_mtime_ns) for p in (tmp_path / "b").rglob("*.parquet")}
    # One sale moves from the third day, where it leaves the files shorter, to a new day; another stays on its day; a third is older than what is there.
    late = [(2, 1, "b", 2.0, dt.datetime(2024, 2, 1), dt.datetime(2024, 3, 5), 1), (12, 1, "b", 2.0, dt.datetime(2024, 1, 4), dt.datetime(2024, 3, 5), 1), (5, 1, "b", 2.0, dt.datetime(2024, 1, 6), dt.datetime(2024, 1, 2), 1)]
    layout.merge(spark.createDataFrame(late, SALE))
    dirty = {day(dt.datetime(2024, 1, 3)), day(dt.datetime(2024, 1, 4)), day(dt.datetime(2024, 2, 1))}
    got = layout.files().collect()
    assert {r["day"] for r in got if r["rewritten"]} == dirty and not {r["day"] for r in got if not r["rewritten"]} & dirty
    now = {p: (p.read_bytes(), p.stat().st_mtime_ns) for p in (tmp_path / "b").rglob("*.parquet")}
    assert {p: v for p, v in now.items() if p in seen} == {p: v for p, v in seen.items() if not any(f"day={d}/" in str(p) for d in dirty)}
    assert sum(r["n_rows"] for r in got) == 90
    # A day whose only sale leaves it has no files any more; a further merge makes a further version.
    layout.merge(spark.createDataFrame([(2, 1, "c", 3.0, dt.datetime(2024, 1, 3), dt.datetime(2024, 4, 5), 1)], SALE))
    days = {r["day"]: r["n_rows"] for r in layout.files().collect()}
    assert day(dt.datetime(2024, 2, 1)) not in days and layout.versions() == [0, 1, 2]
    layout.merge(spark.createDataFrame([], SALE))
    assert layout.versions() == [0, 1, 2]


def test_day_layout_taken_up_after_a_break(spark, tmp_path, monkeypatch):
    """The run stops when the new version is written and the old folders still stand."""
    rows = sales(120, random.Random(8))
    kept = {}
    monkeypatch.setattr(day_layout, "discard", lambda *t: None)
    finish = day_layout.Layout.finish

    def broken(self, consolidated, dirty):
        kept.update(consolidated=consolidated, dirty=dirty)
        with monkeypatch.context() as m:
            m.setattr(day_layout, "drop_folder", lambda *a: (_ for _ in ()).throw(OSError("stopped")))
            finish(self, consolidated, dirty)

    monkeypatch.setattr(day_layout.Layout, "finish", broken)
    with pytest.raises(OSError):
        day_layout.late_layout(spark, spark.createDataFrame(rows, SALE), f"file://{tmp_path}/c", files=30)
    layout = day_layout.Layout(spark, f"file://{tmp_path}/c", 1 + len(rows) // 30)
    finish(layout, **kept)
    want = expected_files(rows, 30)
    assert {k: v[:4] for k, v in result(layout.files()).items()} == {k: v[:4] for k, v in want.items()}


@pytest.mark.parametrize("rows", [[], sales(30, random.Random(2), False)[:1], [(1, 1, None, None, None, dt.datetime(2024, 5, 1), None)], [(1, 1, None, None, None, dt.datetime(2024, 1, 1), None)]])
def test_day_layout_of_few_rows(spark, tmp_path, rows):
    layout = day_layout.late_layout(spark, spark.createDataFrame(rows, SALE), f"file://{tmp_path}/d")
    assert result(layout.files()) == expected_files(rows)


def test_day_layout_with_clashing_names(spark, tmp_path):
    rows = sales(40, random.Random(6), False)
    extra = {c: F.lit(1) for c in ("_part", "_at", "_key", "_row", "_weight2", "h", "_shift2")}
    layout = day_layout.late_layout(spark, spark.createDataFrame(rows, SALE).withColumns(extra), f"file://{tmp_path}/e")
    assert result(layout.files()) == expected_files(rows)
    with pytest.raises(ValueError, match="names"):
        day_layout.late_layout(spark, spark.createDataFrame(rows, SALE).withColumn("Day", F.lit(1)), f"file://{tmp_path}/f")


def test_op12(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/sales.parquet").collect()]
    out = QUERIES["op12_late_layout"](spark, SF)
    assert result(out) == expected_files(rows)
    assert out.columns == [c.split()[0] for c in day_layout.FILE.split(", ")]
