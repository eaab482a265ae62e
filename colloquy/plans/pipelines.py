"""Stage pipelines: files in, files and counts out, each one lazy plan up to its sink."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import annotation, describe, econ, events, relate, reports, sampling, tone, trainer, turns
from ..sources import readers, writers
from ..sources.probe import probe


def merge_raw(raw: DataFrame, date: str = "subheader") -> DataFrame:
    """Rows with a date that can be read, once each, in order of it."""
    dated = raw.withColumn("_d", X.long_date(F.col(date))).filter("_d IS NOT NULL")
    return dated.distinct().orderBy("_d", *[c for c in raw.columns]).drop("_d")


def merge_report(raw: DataFrame, date: str = "subheader") -> DataFrame:
    """One row: rows that come in, with and without a readable date, repeats among the former, rows that stay, first and last date."""
    read = raw.withColumn("_d", X.long_date(F.col(date)))
    once = read.groupBy(*raw.columns, "_d").agg(F.count("*").alias("_n"))
    good = F.col("_d").isNotNull()
    rows = F.sum(F.when(good, F.col("_n")).otherwise(0))
    return once.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_source"), F.coalesce(rows, F.lit(0)).alias("n_clean"), F.coalesce(F.sum(F.when(~good, F.col("_n"))), F.lit(0)).alias("n_unparsed"),
        F.coalesce(rows - F.count_if(good), F.lit(0)).alias("n_duplicates"), F.count_if(good).alias("n_merged"), F.min("_d").alias("first_date"), F.max("_d").alias("last_date"),
    )


def merge_raw_files(spark: SparkSession, path: str, out: str, pattern: str = "*.parquet", date: str = "subheader") -> dict:
    """Raw files merged into one table; files that are empty, unreadable or without the date column are left out and named. Raises where none is left."""
    report = readers.reported(probe(spark, path, pattern, needs=date))
    skipped = [(r["file_path"], r["error"]) for r in report.filter("error IS NOT NULL").orderBy("file_path").collect()]
    good = readers.readable(report)
    if not good:
        raise ValueError(f"no file of {path} can be merged: {skipped}")
    raw = spark.read.option("mergeSchema", "true").parquet(*good)
    writers.write_parquet(merge_raw(raw, date), out)
    return {"files": len(good), "skipped": skipped, **merge_report(raw, date).first().asDict(), "output_path": out}


def process_file(spark: SparkSession, path: str, out: str, symbols: DataFrame) -> dict:
    """A table cut down to a universe of tickers, written, with what is left of it."""
    df = spark.read.parquet(path)
    writers.write_parquet(relate.in_universe(df, symbols), out)
    return relate.universe_report(df, spark.read.parquet(out)).first().asDict()


def build_annotation_sample(spark: SparkSession, chunks: str, scored: str | None, out: str, size: int = 2500) -> str:
    """Chunks (and a teacher's scores, where the table is there) to an annotation sample."""
    teacher = readers.optional(spark, scored, ["chunk_id"]) if scored else None
    writers.write_parquet(annotation.annotation_sample(spark.read.parquet(chunks), teacher, size), out)
    return out


def label_dataset(spark: SparkSession, sample: str, out: str, ask: Callable[[str], str], model: str, max_rows: int | None = None, **how) -> dict:
    """An annotation sample with the labels of a service, in reading order; how many rows are ok and failed."""
    writers.write_parquet(annotation.sorted_chunks(annotation.labelled(spark.read.parquet(sample), ask, model, max_rows, **how)), out)
    return {**annotation.status_counts(spark.read.parquet(out)).first().asDict(), "output_path": out}


def train_model(spark: SparkSession, labelled: str, out: str, train: Callable[[DataFrame, DataFrame], Callable] = trainer.fit) -> dict:
    """The train-ready dataset is written; ``train`` (softmax regression, where none is given) gets its train and valid parts and gives a callable from texts to label ids; its measures on the test part come back."""
    writers.write_parquet(annotation.train_ready(spark.read.parquet(labelled)), out)
    ready = spark.read.parquet(out)
    guess = train(*[ready.filter(F.col("split") == s) for s in ("train", "valid")])

    def run(batches):
        for batch in batches:
            yield batch.assign(guess=list(guess(batch["chunk_text"])))

    judged = ready.filter("split = 'test'").select("chunk_text", "labels").mapInPandas(run, "chunk_text string, labels int, guess int")
    return {**sampling.classification_measures(judged, "labels", "guess").first().asDict(), "train_ready_path": out}


def numbered(raw: DataFrame) -> DataFrame:
    """transcript_id from 0 in order of date and a hash of the row; every row has one of its own, equal rows too. A rerun gives equal rows the same ids.

    Dates and hashes are ranked with the number of rows that share them, one narrow row for each different transcript.
    """
    marked = F.to_json(F.struct(*[F.col(f"`{c}`") for c in raw.columns]), {"ignoreNullFields": "false"})
    keyed = raw.withColumn("date", X.long_date(X.trimmed(F.col("subheader")))).withColumn("_h", F.sha2(marked, 256))
    groups = keyed.groupBy("date", "_h").agg(F.count("*").alias("_c"))
    ranked = sampling.global_ranks(groups, "date", "_h", "_n", "_c").select("_h", F.col("_n").alias("_to"), F.col("_c").alias("_rows"))
    # Rows of one hash are equal, so any numbering of them is the same result; few transcripts are repeated.
    copy = F.row_number().over(Window.partitionBy("_h").orderBy("_h"))
    return keyed.join(ranked, "_h").withColumn("transcript_id", (F.col("_to") - F.col("_rows") + copy - 1).cast("long")).drop("_h", "_to", "_rows")


class PreprocessingPipeline:
    """Raw transcripts to segments, chunks and a validation table. The chunk counter can be replaced."""

    def __init__(self, spark: SparkSession, raw_dir: str, metadata: str | None, out: str, most_tokens: int = 510, count: Callable = X.token_count):
        self.spark, self.raw_dir, self.metadata, self.out, self.most, self.count = spark, raw_dir, metadata, out, most_tokens, count

    def run(self) -> dict:
        raw, bad = readers.read_glob(self.spark, self.raw_dir)
        split = turns.split_transcripts(numbered(raw))
        segs = turns.label_sections(turns.segments(split))
        if self.metadata:
            metadata = self.spark.read.parquet(self.metadata)
            if "name" in metadata.columns:
                metadata = relate.metadata_columns(metadata)
            segs = relate.enrich(segs, metadata, "company_name", "metadata_name", ["ticker"])
        paths = {k: f"{self.out}/{k}" for k in ("segments", "chunks", "validation", "bad_files")}
        writers.write_parquet(segs, paths["segments"])
        segs = self.spark.read.parquet(paths["segments"])
        writers.write_parquet(tone.chunks(segs, self.most, self.count), paths["chunks"])
        writers.write_csv(turns.validation(turns.trace(split), turns.section_counts(segs)), paths["validation"])
        writers.write_csv(bad, paths["bad_files"])
        count = lambda name: self.spark.read.parquet(paths[name]).count()
        tokens = describe.summary(readers.columns_or_empty(self.spark, paths["chunks"], "chunk_token_count long"), ["chunk_token_count"]).first()
        flags = describe.validation_summary(self.spark.read.csv(paths["validation"], header=True, inferSchema=True)).first()
        report = [f"Chunk token summary | {reports.stats_line(tokens.asDict())}", *[f"{k:20}| {v}" for k, v in flags.asDict().items()]]
        paths["report"] = f"{self.out}/report.txt"
        writers.write_text(self.spark, "\n".join(report) + "\n", paths["report"])
        return {"raw_count": raw.count(), "segments_rows": count("segments"), "chunks_rows": count("chunks"), "bad_files": bad.count(), **{f"{k}_path": v for k, v in paths.items()}}


class ScoringPipeline:
    """Chunks to scored chunks by a scorer of the caller (or an array column of logits)."""

    def __init__(self, spark: SparkSession, chunks: str, out: str, scorer: Callable):
        self.spark, self.chunks, self.out, self.scorer = spark, chunks, out, scorer

    def run(self) -> dict:
        df = tone.without_operator(self.spark.read.parquet(self.chunks))
        writers.write_parquet(tone.scored_by(df, self.scorer), self.out)
        return {"scored_rows": self.spark.read.parquet(self.out).count(), "output_path": self.out}


class FeaturesPipeline:
    """Scored chunks and panels to transcript features and the regression dataset."""

    def __init__(self, spark: SparkSession, scored: str, market: str, caps: str, earnings: str, out: str):
        self.spark, self.scored, self.panels, self.out = spark, scored, (market, caps, earnings), out

    def run(self) -> dict:
        df = tone.with_neg_score(self.spark.read.parquet(self.scored))
        features = tone.transcript_features(tone.segment_scores(df))
        base = relate.first_of(df.select("transcript_id", "ticker", "date"), ["transcript_id"], ["ticker", "date"])
        writers.write_parquet(base.join(features, "transcript_id", "left"), f"{self.out}/text")
        text = self.spark.read.parquet(f"{self.out}/text")
        calls = text.withColumn("ticker_norm", X.ticker(F.col("ticker"))).withColumn("call_date", F.to_date("date"))
        market, caps, earnings = (readers.read_panels(self.spark, p) for p in self.panels)
        joined = events.with_outcomes(calls, market, caps, earnings)
        ready = events.prepared(joined)
        writers.write_parquet(events.regression_sample(ready), f"{self.out}/regression")
        count = lambda name: self.spark.read.parquet(f"{self.out}/{name}").count()
        return {"text_rows": count("text"), "regression_rows": count("regression"), "text_path": f"{self.out}/text", "regression_path": f"{self.out}/regression"}


def regression_reports(spark: SparkSession, data: str, out: str) -> list[str]:
    """All specifications over a regression dataset as text and LaTeX files; their paths."""
    paths, progressive = [], []

    def write(name: str, text: str) -> None:
        paths.append(f"{out}/{name}")
        writers.write_text(spark, text + "\n", paths[-1])

    for name, regressors, fit in econ.fits(spark.read.parquet(data)):
        if name.startswith("progressive"):
            progressive.append((f"({len(progressive) + 1})", fit))
            continue
        title = name.replace("_", " ").capitalize()
        write(f"{name}.txt", reports.result_text(title, fit, regressors))
        write(f"{name}.tex", reports.result_latex(title, fit, regressors))
        if name == "prepared_and_qa":
            write("wald.tex", reports.wald_latex("NegQA - NegPrepared = 0", fit.wald("NegQA", "NegPrepared")))
    write("progressive.tex", reports.progressive_latex(progressive))
    return paths
