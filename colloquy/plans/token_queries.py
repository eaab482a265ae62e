"""Registered queries of word pieces. The vocabulary is one that Spark derives from the test items by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.wordpiece import WordPiece
from ..operators import tone
from .catalogue import query, table

SIGNS = "abcdefghijklmnopqrstuvwxyz0123456789.,!?"


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the test items, their last three letters as pieces inside a word, and single signs of both kinds. A few thousand pieces: the items are a fixed table."""
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    found = table(spark, sf_dir, "benchmark").select(word.alias("w")).distinct()
    ends = found.filter(F.length("w") > 3).select(F.concat(F.lit("##"), F.expr("right(w, 3)")).alias("piece"))
    sign = F.explode(F.split(F.lit(SIGNS), ""))
    single = spark.range(1).select(sign.alias("c")).filter("c <> ''").select(F.explode(F.array("c", F.concat(F.lit("##"), "c"))).alias("piece"))
    return found.select(F.col("w").alias("piece")).unionByName(ends).unionByName(single).distinct()


def counter(spark: SparkSession, sf_dir: str) -> WordPiece:
    return WordPiece.of_table(vocabulary(spark, sf_dir))


@query(rf"""WITH RECURSIVE w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark),
v AS (SELECT w AS p, FALSE AS inside FROM w UNION SELECT right(w, 3), TRUE FROM w WHERE length(w) > 3
  UNION SELECT unnest(string_split('{SIGNS}', '')), FALSE UNION SELECT unnest(string_split('{SIGNS}', '')), TRUE),
d AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\p{{P}}$+<=>^`|~]|[^\s\p{{P}}\p{{Z}}$+<=>^`|~]+') AS ws FROM documents),
o AS (SELECT DISTINCT unnest(ws) AS w FROM d),
a AS (SELECT w, unnest(range(0, length(w))) AS pos FROM o WHERE length(w) <= 100),
e AS (SELECT w, pos, unnest(range(1, least(length(w) - pos, (SELECT max(length(p)) FROM v)) + 1)) AS l FROM a),
g AS (SELECT w, pos, l, substr(w, pos + 1, l) AS p, pos > 0 AS inside FROM e),
m AS (SELECT g.w, g.pos, max(g.l) AS best FROM g JOIN v ON v.p = g.p AND v.inside = g.inside GROUP BY g.w, g.pos),
walk AS (SELECT w, 0::BIGINT AS pos, 0 AS n FROM o WHERE length(w) <= 100 UNION ALL SELECT walk.w, walk.pos + m.best, walk.n + 1 FROM walk JOIN m ON m.w = walk.w AND m.pos = walk.pos),
c AS (SELECT o.w, coalesce(max(n) FILTER (WHERE walk.pos = length(o.w)), 1) AS n FROM o LEFT JOIN walk USING (w) GROUP BY o.w),
t AS (SELECT doc_id, unnest(ws) AS w FROM d)
SELECT d.doc_id, coalesce(sum(c.n), 0)::INTEGER AS n_pieces FROM d LEFT JOIN t ON t.doc_id = d.doc_id LEFT JOIN c ON c.w = t.w GROUP BY d.doc_id""")
def wordpiece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", counter(spark, sf_dir)(F.col("text")).alias("n_pieces"))


@query()
def wordpiece_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("transcript_id"), F.lit(0).alias("segment_id"), F.col("text").alias("content"))
    return tone.chunks(d, 128, counter(spark, sf_dir))
