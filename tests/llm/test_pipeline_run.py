"""The whole pipeline: what it leaves, and an empty table."""

import os
import shutil

import corpus_pipeline
from colloquy.llm.common import shared_folder

SF = "/root/testdata/sf0.001"


def left(spark):
    folder = shared_folder(spark).removeprefix("file://")
    return sorted(n.rsplit("-", 1)[0] for n in os.listdir(folder)) if os.path.isdir(folder) else []


def test_stages_are_deleted_once_the_next_is_there(spark):
    before = left(spark)
    out = corpus_pipeline.run(spark, SF)
    slots = sorted(r["slot"] for r in out.select("slot").collect())
    assert slots == list(range(len(slots))) and slots
    more = left(spark)
    for name in before:
        more.remove(name)
    assert [n for n in more if n in dict(corpus_pipeline.STAGES)] == ["source_mix"]


def test_an_empty_table(spark, tmp_path):
    for name in ("labels", "benchmark"):
        shutil.copy(f"{SF}/{name}.parquet", tmp_path / f"{name}.parquet")
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
