import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.functions import numeric as N
from colloquy.functions import text as X
from colloquy.operators import annotation, describe, econ, events, relate, reports, sampling, tone, turns
from colloquy.sources import readers, writers
from colloquy.streaming import ingest
from colloquy.streaming.shards import RollingShards
from tests.conftest import same

SF = "/root/testdata/sf0.001"
FAST = ["section_label", "transcript_features", "section_pivot", "speaker_split", "validation", "run_merge", "company_norm", "long_date_parse",
        "sentence_split", "event_features", "marketcap_asof", "earnings_asof_tol", "qcut5", "qcut10", "histogram50", "boxplot_stats", "group_split",
        "stratified_sample", "chunk_pack", "consistency_checks", "enrich_left", "metadata_enrich", "universe_report", "annotation_prepare", "teacher_scores",
        "annotation_sample", "label_dataset", "label_status_counts", "train_ready", "merge_accounting", "article_fields", "page_text", "validation_summary", "overview_table", "firm_quarters", "regression_prep", "clf_metrics", "ols_covariances", "label_udf", "score_udf"]


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("name", FAST)
def test_against_sql(spark, name):
    from colloquy.plans.catalogue import QUERIES, SQL

    tables = {p.removesuffix(".parquet"): f"{SF}/{p}" for p in os.listdir(SF)}
    same(spark, QUERIES[name](spark, SF), SQL[name], tables)


def test_speaker_split_drops_empty_turns_and_merges_runs(spark):
    body = "intro text\nOperatorOperator\nWelcome.\nJane DoeExecutive\nHello.\nMore.\nÉric X.Analyst\nQ one?\nJane DoeExecutive\n\nBob YAnalyst\nsecond"
    raw = spark.createDataFrame([(0, body, "T - x", None), (1, body.replace("Bob Y", "Éric X."), "T", "\n Acme \nz"), (2, None, None, None)], "transcript_id long, body string, title string, subheader string").withColumn("date", F.lit(None).cast("timestamp"))
    split = turns.split_transcripts(raw)
    rows = turns.label_sections(turns.segments(split)).orderBy("transcript_id", "segment_id").collect()
    assert [(r.segment_id, r.speaker_name, r.speaker_role, r.content, r.section) for r in rows if r.transcript_id == 0] == [
        (0, "Operator", "Operator", "Welcome.", "O"), (1, "Jane Doe", "Executive", "Hello.\nMore.", "Prepared"), (2, "Éric X.", "Analyst", "Q one?", "Q"), (3, "Bob Y", "Analyst", "second", "Q")]
    assert [r.content for r in rows if r.transcript_id == 1][-1] == "Q one?\nsecond"
    assert {r.company_name for r in rows} == {"T", "Acme"}
    t = {r.transcript_id: r for r in turns.trace(split).collect()}
    assert (t[0].raw_length, t[0].segmented_length, t[0].n_raw_segments, t[0].n_merged_segments) == (128, 98, 4, 4)
    assert (t[2].raw_length, t[2].segmented_length) == (0, 0)


def test_tone_features(spark):
    rows = [(0, 0, "Prepared", 10, 0.2), (0, 0, "Prepared", 30, -0.2), (0, 1, "Q", 20, 0.5), (0, 2, "A", 60, 0.1), (1, 0, "Prepared", 5, 0.0)]
    df = spark.createDataFrame(rows, "transcript_id long, segment_id long, section string, chunk_token_count long, neg_score double")
    f = {r.transcript_id: r for r in tone.transcript_features(tone.segment_scores(df)).collect()}
    for tail, want in (("", (-0.1, 0.5, 0.1, 0.3, 0.4)), ("_seglenw", (-0.1, 0.5, 0.1, 0.2, 0.3)), ("_segmax", (0.2, 0.5, 0.1, 0.3, 0.1))):
        got = [f[0][f"Neg{s}{tail}"] for s in ("Prepared", "Q", "A", "QA", "Gap")]
        assert np.allclose(got, want), (tail, got)
    assert f[1].n_segments_q is None and f[1].n_tokens_q is None and f[1].NegQA is None and f[1].NegGap is None


def test_names_dates_labels(spark):
    for name, key in {"Acme Holdings, Inc.": "acme", "AT&T Inc.": "at and t", "Nestlé S.A.": "nestle s a", "Zinc": "zinc", "Co.": "", "Group One": "group one"}.items():
        assert one(spark, X.company_key(F.lit(name))) == key
    assert one(spark, X.ticker(F.lit(" brk.b "))) == "BRK-B"
    stamp = lambda s: one(spark, X.long_date(F.lit(s)))
    assert str(stamp("Thursday, February 19, 2026 4:30 PM")) == "2026-02-19 16:30:00"
    assert stamp("Friday, February 19, 2026 4:30 PM") is not None
    assert stamp("garbage") is None and stamp("Someday, February 19, 2026 4:30 PM") is None and stamp(" Thursday, February 19, 2026 4:30 PM") is None
    assert one(spark, X.label(X.json_label(F.lit('Sure: {"label":"POS","reason":"x"} ok'))["label"])) == "positive"
    assert one(spark, X.label(X.json_label(F.lit('{"label":"meh"}'))["label"])) is None
    assert one(spark, X.clean_text(F.lit("a  b \r\n\n c\t\td "))) == "a b\nc d"
    assert one(spark, X.css_top(F.lit("left: 1px; top: 42.5px"))) == 42.5
    assert one(spark, X.joined_texts(F.array(F.lit(" a"), F.lit("b"), F.lit(""), F.lit("a")))) == "a\nb"


@pytest.mark.parametrize("most,counts,want", [(7, [3, 4, 5, 2], [7, 7]), (4, [2, 9, 1], [2, 4, 4, 1, 1]), (50, [3, 4], [7])])
def test_packing(spark, most, counts, want):
    text = " ".join(" ".join(["w"] * (n - 1) + ["w."]) for n in counts)
    got = one(spark, tone.packed(F.lit(text), most))
    assert [len(g.split()) for g in got] == want and " ".join(got) == text


def test_asof_edges(spark):
    panel = spark.createDataFrame([("A", "2024-01-05", 1.0), ("A", "2024-01-08", 2.0), (None, "2024-01-01", 9.0)], "k string, date string, v double").withColumn("date", F.to_date("date"))
    call = spark.createDataFrame([(1, "A", "2024-01-05"), (2, "A", "2024-01-06"), (3, "A", "2024-01-09"), (4, "B", "2024-01-05"), (5, None, "2024-01-05"), (6, "A", None), (7, "A", "2023-01-01"), (8, "A", "2025-01-01")], "id int, k string, d string").withColumn("d", F.to_date("d"))
    fwd = {r.id: r.match.v if r.match else None for r in relate.asof(call, panel, "k", "d", "date", forward=True).collect()}
    assert fwd == {1: 1.0, 2: 2.0, 3: None, 4: None, 5: None, 6: None, 7: 1.0, 8: None}
    back = {r.id: r.match.v if r.match else None for r in relate.asof(call, panel, "k", "d", "date", tolerance=30).collect()}
    assert back == {1: 1.0, 2: 1.0, 3: 2.0, 4: None, 5: None, 6: None, 7: None, 8: None}
    plan = relate.asof(call, panel, "k", "d", "date")._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_numbers(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 4, 8)] + [(None,)], "v double")
    assert [round(x, 9) for x in df.agg(F.percentile("v", F.array(F.lit(0.2), F.lit(0.4), F.lit(0.5)))).first()[0]] == [1.6, 2.4, 3.0]
    assert events.winsorized(df, ["v"], 0.2, 0.4).filter("v is null").count() == 1
    bins = describe.quantile_bins(spark.createDataFrame([(float(v),) for v in [1, 1, 1, 1, 5, 6, 7, 8, 9, 10]], "v double"), "v", 5)
    assert bins.agg(F.count_distinct("bin")).first()[0] == 4
    assert one(spark, N.safe_log(F.lit(0.0))) is None and one(spark, N.number(F.lit("NaN"))) is None and one(spark, N.clip(F.lit(None).cast("int"), 1)) is None
    assert one(spark, N.surprise(F.lit(-0.4), F.lit(-0.5), 0.01)) == pytest.approx(0.2) and one(spark, N.surprise(F.lit(1.0), F.lit(0.005), 0.01)) is None
    assert one(spark, N.drop_rate(F.lit(0), F.lit(5))) == 0 and one(spark, N.balance(F.lit(0), F.lit(0))) is None


def test_splits_and_measures(spark):
    for n, want in ((10, (7, 2, 1)), (30, (21, 4, 5))):
        g = spark.range(n).select(F.col("id").alias("t"), F.lit("2024-01-01").alias("d"))
        got = {r.split: r["count"] for r in sampling.group_split(g, "t", "d").groupBy("split").count().collect()}
        assert tuple(got[k] for k in ("train", "valid", "test")) == want
    m = sampling.classification_measures(spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "t int, p int"), "t", "p").first()
    assert m.accuracy == 0.5 and m.macro_precision == pytest.approx((1 + 1 / 3) / 3) and m.macro_recall == pytest.approx(0.5)


def test_ols_against_numpy(spark):
    rng = np.random.default_rng(0)
    x, g = rng.normal(size=(200, 2)), rng.integers(0, 12, 200)
    y = 1 + x @ [2, -1] + rng.normal(size=200) + (g % 3 == 1) * 0.5
    df = spark.createDataFrame([(float(a), float(b), f"g{k}", f"q{k % 3}", float(v)) for (a, b), k, v in zip(x, g, y)], "a double, b double, g string, q string, y double")
    fit = econ.ols(df, "y", ["a", "b"], ("q",), "cluster", "g")
    d = np.column_stack([np.ones(200), g % 3 == 1, g % 3 == 2, x]).astype(float)
    beta = np.linalg.lstsq(d, y, rcond=None)[0]
    assert np.allclose(fit.params, beta)
    s = np.stack([(d[g == k] * (y - d @ beta)[g == k, None]).sum(axis=0) for k in np.unique(g)])
    inv, n_g = np.linalg.inv(d.T @ d), len(np.unique(g))
    assert np.allclose(fit.cov, inv @ (s.T @ s) @ inv * n_g / (n_g - 1) * 199 / 195)
    assert 0 <= fit.wald("a", "b")["p"] < 0.01 and fit.adjusted_r2 < fit.r2


@pytest.mark.parametrize("cov", ["classical", "hc1", "cluster"])
def test_absorbed_effects_against_columns(spark, cov):
    """Differences from means by firm give what a column for each firm gives."""
    rng = np.random.default_rng(3)
    g, x = rng.integers(0, 25, 300), rng.normal(size=(300, 2))
    y = x @ [1, -2] + g * 0.3 + (np.arange(300) % 4) * 0.2 + rng.normal(size=300)
    df = spark.createDataFrame([(float(a), float(b), int(k), f"q{i % 4}", float(v)) for i, ((a, b), k, v) in enumerate(zip(x, g, y))], "a double, b double, g int, q string, y double").repartition(3)
    cluster = "g" if cov == "cluster" else None
    dense, fast = econ.ols(df, "y", ["a", "b"], ("q", "g"), cov, cluster), econ.ols(df, "y", ["a", "b"], ("q",), cov, cluster, "g")
    assert ("Intercept" in fast.names) == (cov != "hc1")
    at = [dense.names.index(n) for n in fast.names]
    assert np.allclose(fast.params, dense.params[at]) and np.allclose(fast.errors, dense.errors[at]) and (fast.n, fast.clusters) == (dense.n, dense.clusters)
    assert fast.r2 == pytest.approx(dense.r2) and fast.adjusted_r2 == pytest.approx(dense.adjusted_r2) and np.allclose(fast.cov, dense.cov[np.ix_(at, at)])


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("x", 1.0, "2024-01-02")], "symbol string, close double, date string")
    for k, name in enumerate(("brk.b.parquet", "AA.parquet", "sub/AA.parquet")):
        target = tmp_path / "panels" / name
        target.parent.mkdir(parents=True, exist_ok=True)
        df.withColumn("close", F.lit(float(k))).toPandas().to_parquet(target)
    got = {r.ticker_norm: r.close for r in readers.read_panels(spark, str(tmp_path / "panels")).collect()}
    assert got == {"BRK-B": 0.0, "AA": 1.0}
    (tmp_path / "panels" / "bad.parquet").write_text("no")
    rows, bad = readers.read_glob(spark, str(tmp_path / "panels"))
    assert rows.count() == 2 and bad.count() == 1
    with pytest.raises(FileNotFoundError):
        readers.read_glob(spark, str(tmp_path / "panels"), "*.none")
    assert readers.optional(spark, str(tmp_path / "missing"), ["a"]) is None
    writers.write_shards(spark.range(100).coalesce(1), str(tmp_path / "shards"), 30)
    assert len(list((tmp_path / "shards").glob("*.parquet"))) == 4
    writers.write_parquet(spark.range(0), str(tmp_path / "empty"))
    assert spark.read.parquet(str(tmp_path / "empty")).columns == ["id"]


def test_stream_to_shards(spark, tmp_path):
    spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:10:00"), ("b", "2024-01-01 01:00:00")], "k string, t string").withColumn("t", F.to_timestamp("t")).write.parquet(str(tmp_path / "in"))
    stream = ingest.landed(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    ingest.to_shards(ingest.without_repeats(stream, ["k"], "t"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert RollingShards(spark, str(tmp_path / "out")).read().count() == 2


def test_pipelines_end_to_end(spark, tmp_path):
    from colloquy.plans.catalogue import stand_in_scores
    from colloquy.plans.pipelines import FeaturesPipeline, PreprocessingPipeline, ScoringPipeline

    body = "OperatorOperator\nWelcome.\nJane DoeExecutive\nGood year. We grew.\nBob YAnalyst\nWhy?\nJane DoeExecutive\nBecause."
    raw = [(f"Acme {i}", f"Acme, Inc.\nThursday", "", "", body, "", ) for i in range(2)]
    cols = "title string, subheader string, transcript_subheader string, speakers string, body string, list_item string"
    spark.createDataFrame(raw, cols).withColumn("subheader", F.lit("Thursday, February 19, 2026 4:30 PM")).write.parquet(str(tmp_path / "raw"))
    spark.createDataFrame([("ACM", "Thursday, February 19, 2026 4:30 PM")], "ticker string, metadata_name string").write.parquet(str(tmp_path / "meta"))
    out = PreprocessingPipeline(spark, str(tmp_path / "raw"), str(tmp_path / "meta"), str(tmp_path / "out")).run()
    assert (out["raw_count"], out["segments_rows"], out["chunks_rows"]) == (2, 8, 8)
    report = open(out["report_path"]).read()
    assert report.startswith("Chunk token summary | count=8 |") and "n_transcripts" in report
    assert ScoringPipeline(spark, out["chunks_path"], str(tmp_path / "scored"), stand_in_scores).run()["scored_rows"] == 6
    for kind, cols in (("market", "close double, volume double"), ("caps", "marketCap double"), ("earn", "epsEstimated double, epsActual double, revenueEstimated double, revenueActual double")):
        n = len(cols.split(","))
        pd_ = spark.createDataFrame([(f"2026-02-{d:02d}", *[float(d)] * n) for d in range(1, 28)], f"date string, {cols}").toPandas()
        (tmp_path / kind).mkdir()
        pd_.to_parquet(tmp_path / kind / "ACM.parquet")
    got = FeaturesPipeline(spark, str(tmp_path / "scored"), *[str(tmp_path / k) for k in ("market", "caps", "earn")], str(tmp_path / "features")).run()
    assert got["text_rows"] == 2 and got["regression_rows"] == 0  # too few trading days for an expected return
    assert math.isfinite(spark.read.parquet(got["text_path"]).first()["NegPrepared"])


def test_regression_data_has_every_call(spark):
    from colloquy.plans import catalogue

    sf = "/root/testdata/sf0.001"
    got = [r.call_id for r in catalogue.regression_data(spark, sf).select("call_id").collect()]
    assert sorted(got) == sorted(r.o_orderkey for r in spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey").collect())
    tickers = catalogue.earnings(spark, sf).filter("ticker_norm % 2 = 1")
    assert tickers.count() > 0


def test_names_with_accents_join(spark):
    left = spark.createDataFrame([("Nestlé S.A.",), ("Société Générale",), ("Acme & Co., Inc.",), ("Inc.",), (None,)], "company_name string")
    right = spark.createDataFrame([("NESN", "Nestle S.A.", 1.0), ("GLE", "SOCIETE GENERALE Group", 2.0), ("AC", "ACME and", 3.0), ("AD", "Acme AND Holdings", 4.0), ("X", "Corp.", 5.0)], ["ticker", "name", "last price"])
    got = {r.company_name: r for r in relate.enrich_companies(left, right).collect()}
    assert [got[n].ticker for n in ("Nestlé S.A.", "Société Générale", "Acme & Co., Inc.", "Inc.", None)] == ["NESN", "GLE", "AC", None, None]
    assert got["Nestlé S.A."].last_price == 1.0
    with pytest.raises(ValueError):
        relate.metadata_columns(right.drop("name"))


def test_global_ranks(spark):
    rows = [(k, None if k % 5 == 0 else f"2024-01-{k % 3 + 1:02d}") for k in range(40)]
    got = sampling.global_ranks(spark.createDataFrame(rows, "id long, d string"), "d", "id", "r").orderBy("r").collect()
    assert [r.id for r in got] == [k for k, d in sorted(rows, key=lambda x: (x[1] is None, x[1] or "", x[0]))] and [r.r for r in got] == list(range(1, 41))


def test_labelling_asks_again_and_times_out(spark, tmp_path):
    log = tmp_path / "asked"
    log.mkdir()

    def ask(prompt):
        import time

        n = len(list(log.glob(f"{prompt}-*")))
        (log / f"{prompt}-{n}").touch()
        if prompt == "slow":
            time.sleep(2)
        if prompt == "down":
            raise OSError("no answer")
        return '{"label": "pos", "reason": "r"}' if prompt == "good" or n == 1 else "no idea"

    df = spark.createDataFrame([(k,) for k in ("good", "later", "down", "slow")], "id string").withColumn("p", F.col("id"))
    got = {r.id: r for r in sampling.labelled_by(df, ask, "p", "id", concurrency=2, timeout=0.5).collect()}
    assert [(got[k].label_status, got[k].attempts) for k in ("good", "later", "down", "slow")] == [("ok", 1), ("ok", 2), ("failed", 3), ("failed", 3)]
    assert "no answer" in got["down"].error and got["slow"].error and got["later"].error is None


def test_label_of_an_answer_is_the_same_in_and_outside_spark(spark):
    said = ['{"label":"POS"}', 'x {"label": " neu ", "reason": 1} y', '{"label":"meh"}', "none", "", None, '{"label": null}', "[1]"]
    got = [r.v for r in spark.createDataFrame([(k, x) for k, x in enumerate(said)], "k int, x string").orderBy("k").select(X.label(X.json_label(F.col("x"))["label"]).alias("v")).collect()]
    assert got == [X.label_in(x) for x in said] == ["positive", "neutral", None, None, None, None, None, None]


def chunk_table(spark, n=60):
    rows = [(f"{t}_{k}", t, k, 1, f"2024-01-{t % 28 + 1:02d}", "O" if k == 0 else "QAP"[k % 3].replace("P", "Prepared"), f" text {t} {k} " if k != 5 else "  ", 20 if k != 4 else 5) for t in range(n) for k in range(6)]
    return spark.createDataFrame(rows, "chunk_id string, transcript_id long, segment_id long, chunk_order long, date string, section string, chunk_text string, chunk_token_count long").withColumn("extra", F.lit(1))


def test_annotation_path_through_files(spark, tmp_path):
    from colloquy.plans import pipelines

    chunks, sample, labels, ready = (str(tmp_path / x) for x in ("chunks", "sample", "labels", "ready"))
    chunk_table(spark).write.parquet(chunks)
    pipelines.build_annotation_sample(spark, chunks, str(tmp_path / "missing"), sample, 100)
    got = spark.read.parquet(sample)
    assert got.count() == 100 and got.columns[0] == "chunk_id" and got.columns[-1] == "label_status" and "extra" not in got.columns
    assert got.filter("section = 'O' OR chunk_token_count < 15 OR trim(chunk_text) = '' OR label_status <> 'pending'").count() == 0
    told = pipelines.label_dataset(spark, sample, labels, lambda p: '{"label": "%s", "reason": "r"}' % ("neg", "neu", "pos", "?")[len(p) % 4], "m", max_rows=80)
    assert told["n_rows"] == 80 and told["n_ok"] + told["n_failed"] == 80 and told["n_pending"] == 0
    done = spark.read.parquet(labels)
    assert [c for c in done.columns if c.startswith("label")] == ["label", "label_reason", "label_source", "label_status"] and done.filter("label_status = 'failed' AND (label IS NOT NULL OR error IS NULL)").count() == 0

    def train(a, b):
        assert a.count() > b.count() > 0
        return lambda texts: [1] * len(texts)

    assert 0 <= pipelines.train_model(spark, labels, ready, train)["accuracy"] <= 1
    split = spark.read.parquet(ready)
    assert split.groupBy("transcript_id").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0 and split.filter("labels IS NULL").count() == 0
    with pytest.raises(ValueError):
        annotation.train_ready(done.filter("transcript_id < 2"))
    with pytest.raises(ValueError):
        annotation.train_ready(done.filter("false"))


def test_teacher_scores_that_cannot_be_used(spark):
    df = annotation.prepared(chunk_table(spark, 2))
    for scored in (None, spark.createDataFrame([("0_1", 1)], "chunk_id string, other int"), spark.createDataFrame([(1.0,)], "neg_score double")):
        assert annotation.with_teacher(df, scored).columns == df.columns
    twice = spark.createDataFrame([("0_1", "0.5"), ("0_1", "0.5"), ("0_2", "nan"), ("0_3", "x")], "chunk_id string, neg_score string")
    got = {r.chunk_id: r.teacher_neg_score for r in annotation.with_teacher(df, twice).collect()}
    assert got["0_1"] == 0.5 and got["0_2"] is None and got["0_3"] is None and len(got) == df.count()
    assert annotation.first_existing(df, ("gvkey", "company_id", "transcript_id")) == "transcript_id" and annotation.first_existing(df, ("x",)) is None


def test_raw_files_are_accounted_for(spark, tmp_path):
    from colloquy.plans import pipelines

    one = spark.createDataFrame([("Thursday, February 19, 2026 4:30 PM", "a"), ("Thursday, February 19, 2026 4:30 PM", "a"), ("?", "b")], "subheader string, body string")
    for name, df in (("a", one), ("b", one.limit(0)), ("c", one.drop("subheader")), ("d", one.filter("body = 'a'").limit(1))):
        df.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    (tmp_path / "e.parquet").write_bytes(b"not parquet")
    got = pipelines.merge_raw_files(spark, str(tmp_path), str(tmp_path / "out"))
    assert [n.rsplit("/", 1)[1] for n, _ in got["skipped"]] == ["b.parquet", "c.parquet", "e.parquet"] and got["files"] == 2
    assert [got[k] for k in ("n_source", "n_clean", "n_unparsed", "n_duplicates", "n_merged")] == [4, 3, 1, 2, 1] and str(got["first_date"]) == "2026-02-19 16:30:00"
    with pytest.raises(ValueError):
        pipelines.merge_raw_files(spark, str(tmp_path), str(tmp_path / "out"), "b*.parquet")


def test_universe_of_a_file(spark, tmp_path):
    from colloquy.plans import pipelines

    spark.createDataFrame([(1, "brk.b "), (1, "BRK-B"), (2, "X"), (3, None)], "transcript_id long, ticker string").write.parquet(str(tmp_path / "in"))
    got = pipelines.process_file(spark, str(tmp_path / "in"), str(tmp_path / "out"), spark.createDataFrame([("BRK.B",), (None,)], "Symbol string"))
    assert (got["n_rows"], got["n_kept"], got["n_transcripts"], got["share"]) == (4, 2, 1, 50.0)


def test_checks_that_fail(spark):
    final = spark.createDataFrame([(1, "2024Q1"), (1, "2024Q2")], "transcript_id long, year_quarter string")
    chunks = spark.createDataFrame([("Executive", "Prepared"), ("Executive", "O"), ("Analyst", "Q")], "speaker_role string, section string")
    got = {r.check: r.passed for r in describe.basic_checks(final, chunks).collect()}
    assert got == {"observations": True, "one_row_per_call": False, "quarters": True, "section_shares": True, "speaker_shares": True, "executive_is_prepared_and_a": False, "analyst_is_q": True}
    assert {r.check for r in describe.basic_checks(final.limit(0), chunks.limit(0)).collect() if r.passed} == {"one_row_per_call", "executive_is_prepared_and_a", "analyst_is_q"}


def test_packing_of_long_texts(spark):
    """More sentences than one fold takes, against a plain loop."""
    import random

    rng = random.Random(4)
    texts = [" ".join(" ".join(["w"] * (rng.randint(1, 90) - 1) + [f"e{k}."]) for k in range(n)) for n in (0, 1, 255, 256, 257, 900)]
    got = tone.chunks(spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "transcript_id long, segment_id long, content string"), 64).collect()
    for i, t in enumerate(texts):
        want, now = [], []
        for s in ([x + "." for x in t.split(". ")] if len(t.split()) > 64 else [t] if t else []):
            w = s.rstrip(".").split()
            w = s.replace("..", ".").split() if len(t.split()) > 64 else w
            if len(t.split()) <= 64:
                want.append(t)
                continue
            if len(w) > 64:
                want += [now] if now else []
                want += [w[k : k + 64] for k in range(0, len(w), 64)]
                now = []
            elif len(now) + len(w) > 64:
                want.append(now)
                now = w
            else:
                now = now + w
        want += [now] if now else []
        assert [r.chunk_text for r in sorted((r for r in got if r.transcript_id == i), key=lambda r: r.chunk_order)] == [x if isinstance(x, str) else " ".join(x) for x in want], i


def test_captures_of_a_page(spark):
    rows = [("a", 1, "Your document is on its way..."), ("a", 2, "ready"), ("a", 3, "later"), ("b", 1, "your  document\tis on its way"), ("b", 2, "Your document is on its way"), ("c", 1, None)]
    got = {r.k: (r.n, r.body) for r in readers.best_captures(spark.createDataFrame(rows, "k string, n int, body string"), "k", "n").collect()}
    assert got["a"] == (2, "ready") and got["b"][0] == 2 and got["c"] == (1, None)
    out = readers.article_fields(spark.createDataFrame([(1, None), (2, "<div class='slate-editor__container'>a<div>b</div>c<div class='q slate-editor__container'>d")], "id int, html string")).orderBy("id").collect()
    assert [(r.title, r.body) for r in out] == [("", ""), ("", "a\nb\nc\nd\nd")] and "list_item" not in out[0]


def test_windows_that_fail_do_not_end_the_rest(spark):
    done = []

    def work(a, b):
        if a == "2024-01-03":
            raise OSError("gone")
        done.append((a, b))

    got = readers.for_windows(readers.date_windows(spark, "2024-01-01", "2024-01-05", 2), work)
    assert [g[2] for g in got] == [None, "gone", None] and done == [("2024-01-01", "2024-01-02"), ("2024-01-05", "2024-01-05")]


def test_models_are_loaded_once(spark, tmp_path):
    def load():
        import uuid

        import pandas as pd

        (tmp_path / uuid.uuid4().hex).touch()
        return lambda texts: pd.DataFrame([[0.2, 0.3, 0.5] if len(t.split()) == 2 else [1.0, 0.0, 0.0] for t in texts])

    df = spark.createDataFrame([(i, "one two three four" if i % 2 else "one") for i in range(40)], "id int, chunk_text string").repartition(8)
    got = tone.scored_by(df, load=load, most_tokens=2).collect()
    assert all(r.pred_label == ("negative" if r.id % 2 else "neutral") for r in got) and set(got[0].asDict()) == {"id", "chunk_text", "p_neutral", "p_positive", "p_negative", "pred_label"}
    assert 1 <= len(list(tmp_path.iterdir())) <= 8
    with pytest.raises(ValueError):
        tone.scored_by(df)


def test_numbers_that_are_texts(spark):
    panel = spark.createDataFrame([("A", f"2024-01-{d:02d}", "x" if d == 3 else str(d), "NaN" if d == 2 else "5") for d in range(1, 9)], "ticker_norm string, date string, close string, volume string")
    out = {r.date: r for r in events.market_panel(panel.withColumn("date", F.to_date("date"))).collect()}
    assert len(out) == 7 and all(r.volume in (5.0, None) for r in out.values())


def test_panels_of_some_keys(spark, tmp_path):
    import pandas as pd

    for name in ("brk.b.parquet", "AA.pq", "sub/AA.parquet", "ZZ.parquet"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        pd.DataFrame({"close": [1.0]}).to_parquet(tmp_path / name)
    got = readers.read_panels(spark, str(tmp_path), ["BRK-B", "aa"])
    assert sorted(r.ticker_norm for r in got.collect()) == ["AA", "BRK-B"]
    assert len(got.inputFiles()) <= 3 and [readers.key_of(f) for f in ("x/brk.b.parquet", "AA.pq")] == ["BRK-B", "AA"]
    with pytest.raises(FileNotFoundError):
        readers.read_panels(spark, str(tmp_path), ["none"])


def test_reports_and_shards(spark, tmp_path):
    writers.write_json(spark, {"a": "é"}, f"file://{tmp_path}/x.json")
    writers.write_json(spark, {"a": "ü"}, f"file://{tmp_path}/x.json")
    assert (tmp_path / "x.json").read_text() == '{\n  "a": "ü"\n}' and not list(tmp_path.glob("x.json.*[0-9a-f]"))
    writers.write_shards(spark.range(3).withColumn("b", F.lit("7")), str(tmp_path / "s"), 2, spark.createDataFrame([], "b int, c string, id int").schema)
    assert spark.read.parquet(str(tmp_path / "s")).dtypes == [("b", "int"), ("c", "string"), ("id", "int")]
    assert one(spark, X.first_tokens(F.lit(" a b  c d"), 2)) == " a b" and one(spark, X.first_tokens(F.lit("a b"), 2)) == "a b"


@pytest.mark.parametrize("accuracy", [10_000, 50])
def test_exact_quantiles(spark, monkeypatch, accuracy):
    """Against numpy, with ties, few rows, missing values and columns without any."""
    from colloquy.operators import quantiles

    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    rng, probs = np.random.default_rng(1), [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    for n in (1, 2, 7, 1000, 4001):
        a, b = rng.normal(size=n), rng.integers(0, 4, n)
        rows = [(float(x), int(y), None, None if k % 3 else float(x)) for k, (x, y) in enumerate(zip(a, b))]
        df = spark.createDataFrame(rows, "a double, b int, c double, d double").repartition(3)
        got = dict(zip("abcd", quantiles.exact_quantiles(df, ["a", "b", "c", "d"], probs)))
        for name, x in (("a", a), ("b", b), ("d", a[::3])):
            assert np.allclose(got[name], np.quantile(x, probs), rtol=0, atol=1e-12), (n, name)
        assert got["c"] is None


def test_reports(spark, tmp_path):
    assert [reports.p_value(p) for p in (0.0005, 0.0123, None, math.nan)] == ["<0.001", "0.012", "", ""] and reports.p_value(0.0001, True) == "$<0.001$"
    assert [reports.with_stars(1.0, p) for p in (0.001, 0.03, 0.07, 0.2)] == ["1.0000***", "1.0000**", "1.0000*", "1.0000"] and reports.with_stars(math.nan, 0.1) == ""
    assert reports.latex("a_b & 5% #1") == r"a\_b \& 5\% \#1" and reports.table_label("Main: firm effects") == "tab:main_firm_effects" and reports.shown("NegGap_seglenw") == "Negative Gap"
    assert reports.stats_line({"n": 1200, "mean": 0.5, "std": None, "min": 0, "p25": 0.25, "p50": 0.5, "p75": 0.75, "max": 1}, True).startswith("count=1,200 | mean=50.00% | std=nan% | min=0.00%")
    from colloquy.plans import pipelines

    rng = np.random.default_rng(5)
    names = ["CAR_m1_p1", *econ.CONTROLS, *[f"Neg{s}{t}" for s in ("Prepared", "QA", "Gap") for t in ("", "_seglenw", "_segmax")]]
    rows = [(f"t{i % 9}", f"2024Q{i % 3 + 1}", *map(float, rng.normal(size=len(names)))) for i in range(200)]
    spark.createDataFrame(rows, ["ticker_norm", "year_quarter", *names]).write.parquet(str(tmp_path / "data"))
    paths = pipelines.regression_reports(spark, str(tmp_path / "data"), str(tmp_path / "out"))
    assert len(paths) == 2 * len(econ.SPECS) + 2 and "Constant" in (tmp_path / "out" / "firm_effects.txt").read_text()
    tex = (tmp_path / "out" / "progressive.tex").read_text()
    assert tex.count("p-value") == len(reports.PROGRESSIVE_ORDER) and tex.count(r"\hline") == 4 and "Observations & 200" in tex


def test_inputs_that_may_be_missing(spark, tmp_path):
    spark.range(5).selectExpr("id AS chunk_token_count", "id AS other").write.parquet(str(tmp_path / "a.parquet"))
    (tmp_path / "b.parquet").write_text("no")
    got = readers.columns_or_empty(spark, str(tmp_path / "a.parquet"), "chunk_token_count int")
    assert got.dtypes == [("chunk_token_count", "int")] and got.count() == 5
    scan = got._jdf.queryExecution().executedPlan().toString()
    assert "other" not in scan.split("ReadSchema")[1]
    for path, schema in (("b.parquet", "x int"), ("c.parquet", "x int"), ("a.parquet", "x int")):
        assert readers.columns_or_empty(spark, str(tmp_path / path), schema).count() == 0
    rows, bad = readers.read_glob(spark, str(tmp_path), keep=lambda n: n.startswith("a") and not n.endswith("_old.parquet"))
    assert rows.count() == 5 and bad.count() == 0
    (tmp_path / "u.csv").write_text("Symbol,Name\n brk.b ,x\nBRK-B,y\n,z\nAA,w\n")
    assert sorted(r.Symbol for r in readers.read_universe(spark, str(tmp_path / "u.csv")).collect()) == ["AA", "BRK-B"]
    assert one(spark, X.message_content(F.lit('{"choices": [{"message": {"content": "hi"}}]}'))) == "hi" and one(spark, X.message_content(F.lit("{}"))) is None


def test_stream_until_idle(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1)], "k string, v int")
    rows.write.parquet(str(tmp_path / "in"))
    starts = []

    def start():
        starts.append(1)
        if len(starts) == 2:  # more comes in while it runs
            rows.union(rows).write.mode("append").parquet(str(tmp_path / "in"))
        return ingest.to_shards(ingest.landed(spark, str(tmp_path / "in"), rows.schema), str(tmp_path / "out"), str(tmp_path / "cp"))

    assert ingest.until_idle(start, idle=2, wait=0, spark=spark) == 3 and len(starts) == 4
    assert RollingShards(spark, str(tmp_path / "out")).read().count() == 3
    assert ingest.until_idle(start, idle=5, wait=0, most=2, spark=spark) == 0 and len(starts) == 6


def test_request_body_and_value_guards(spark):
    import json

    df = spark.createDataFrame([("a \"b\"", 0.1), (None, 0.9), ("c", math.nan), ("d", None)], "q string, t double")
    got = [json.loads(r[0]) for r in df.select(annotation.request_body(F.col("q"), "m", "sys", F.col("t"))).collect()]
    assert [g["temperature"] for g in got] == [0.5, 0.9, 0.5, 0.5] and [g["messages"][1]["content"] for g in got] == ['a "b"', "", "c", "d"]
    assert got[0]["messages"][0] == {"role": "system", "content": "sys"} and json.loads(one(spark, annotation.request_body(F.lit("x"), "m", "s")))["temperature"] == 0.5
    rows = {r["variable"]: tuple(r)[1:] for r in describe.has_values(df, ["q", "t"]).collect()}
    assert rows == {"q": (3, True, False), "t": (2, True, False)}
    assert {tuple(r)[1:] for r in describe.has_values(df.limit(0), ["q", "t"]).collect()} == {(0, False, True)}
