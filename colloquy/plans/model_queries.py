"""Registered queries that train: a classifier over all labelled documents, and a grid of configurations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import describe, sampling, trainer
from .catalogue import query, table


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, label, part): all labelled documents; a fifth is for validation and a fifth for the test, by checksum of the id."""
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    labels = table(spark, sf_dir, "labels").filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("label"))
    part = F.when(rest == 0, "test").when(rest == 1, "valid").otherwise("train")
    return table(spark, sf_dir, "documents").join(labels, "doc_id").select("doc_id", "text", "label", part.alias("part"))


@query()
def trained_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, label, guess, score) of every test document, by a model of the others."""
    docs = labelled_documents(spark, sf_dir)
    model = trainer.fit(docs.filter("part = 'train'"), docs.filter("part = 'valid'"), "text", "label", classes=2, rounds=30)

    def run(batches):
        for b in batches:
            p = model.scores(b["text"])
            yield b[["doc_id", "label"]].assign(guess=p.argmax(axis=1).astype("int32"), score=p[:, 1])

    return docs.filter("part = 'test'").select("doc_id", F.col("label").cast("int").alias("label"), "text").mapInPandas(run, "doc_id long, label int, guess int, score double")


@query()
def model_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configurations of a grid in three rungs over a sample of the labelled documents (the feature: 2,000 at most)."""
    grid = sampling.grid(spark, lr=[0.01, 0.03, 0.1], batch=[8, 16], epochs=[2, 3], warmup=[0.0, 0.1], decay=[0.0, 0.01])
    return trainer.trials(grid, labelled_documents(spark, sf_dir), "text", "label", "part", "doc_id", 2, sample=2_000)


GUARDED = ("sale_id", "client_id", "status", "total", "sold_at", "arrived_at", "priority")


@query(" UNION ALL ".join(f"SELECT '{c}' AS variable, count({c}) AS n_values, count({c}) > 0 AS any_value, count({c}) = count(*) AS all_values FROM sales" for c in GUARDED))
def value_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe.has_values(table(spark, sf_dir, "sales"), list(GUARDED))
