"""Sinks: rolling shards, CSV, JSON and text reports."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Also for an empty table, whose schema is written."""
    df.write.mode(mode).parquet(path)


def write_shards(df: DataFrame, path: str, rows: int = 30_000, schema: StructType | None = None) -> None:
    """Snappy files of at most ``rows`` rows, appended. With ``schema``, columns are put in its order and types; those that are missing are null."""
    if schema is not None:
        have = {c.lower() for c in df.columns}
        df = df.select(*[(F.col(f.name) if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
    df.write.mode("append").option("compression", "snappy").option("maxRecordsPerFile", rows).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(spark: SparkSession, values: dict, path: str) -> None:
    write_text(spark, json.dumps(values, indent=2, ensure_ascii=False), path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A file of any file system that the session knows; it appears under its name when it is complete."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    part = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    fs = target.getFileSystem(conf)
    out = fs.create(part, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    fs.delete(target, False)
    if not fs.rename(part, target):
        raise OSError(f"{path} could not be written")
