"""Corpus pipeline: quality, near duplicates, test passages, source mix, training order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colloquy.llm.common import discard, shared_path, stored
from colloquy.llm.decontaminate import clean_of
from colloquy.llm.jaccard_join import one_of_each
from colloquy.llm.mixing import curriculum
from colloquy.llm.quality import keep_good
from colloquy.llm.token_shards import ROWS, token_shards

#: Sequences that are permuted among themselves: the curriculum's order holds from one such window to the next.
WINDOW = 4 * ROWS


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; each row is judged by its own text (null: empty), whatever its id.

    Equal rows are judged alike; an empty table stays empty; labels that are null, or of a null id, aren't used.
    """
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id (null last), of equal rows one.

    Rows are judged by their own texts, also where ids are null or repeated. Rows without words are copies of nothing and stay.
    """
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test passage, copied or edited, go; each row is judged by its own text, whatever its id.

    Null and empty texts hold nothing; items that are null or shorter than a seed are not looked for.
    """
    return clean_of(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights, range-sorted in curriculum order; a document that is taken twice is there twice.

    Texts without words take nothing and go; a null source is a source of its own, the last; equal rows are documents each.
    """
    return curriculum(docs, position=None)


def training_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids as records of fixed stride, written as shards; returns the index read back from them.

    Sequences are numbered as their documents stand in the files of the mix, in curriculum order, and permuted inside windows.
    A null or empty text is one record of end signs; equal rows are recorded each; an empty table gives no record.
    """
    return token_shards(docs, shared_path(spark, "shards"), window=WINDOW)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("training_order", training_order),
]

#: The classifier and the alignment are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        if before is not None:  # what a stage was given goes once its result is there; the last stage's input stays
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
