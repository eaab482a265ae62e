"""From transcript bodies to labelled speaker turns, and their validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as X


def speaker_turns(body: Column) -> Column:
    """array<struct<header, name, role, content>>: turns with some text; what stands before the first header is dropped."""
    heads = X.speaker_headers(body)
    rest = F.split(body, X.SPEAKER_LINE, -1)
    pairs = F.arrays_zip(heads.alias("header"), F.slice(rest, 2, F.greatest(F.size(rest) - 1, F.lit(0))).alias("content"))
    turns = F.transform(
        pairs,
        lambda p: F.struct(
            p["header"].alias("header"), X.speaker_name(p["header"]).alias("name"), X.speaker_role(p["header"]).alias("role"),
            X.trimmed(p["content"]).alias("content"),
        ),
    )
    return F.filter(turns, lambda t: t.content != "")


def merged_turns(turns: Column) -> Column:
    """Consecutive turns of one speaker become one; their texts are joined by a line end.

    The places where a run begins are found first, so every text is copied once.
    """
    def begins(i: Column) -> Column:
        now, last = F.get(turns, i), F.get(turns, i - 1)
        return (i == 0) | (now["name"] != last["name"]) | (now["role"] != last["role"])

    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(turns) - 1, F.lit(0))), begins)
    ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.size(turns)))
    runs = F.arrays_zip(starts.alias("a"), ends.alias("b"))

    def run(r: Column) -> Column:
        first, rows = F.get(turns, r["a"]), F.slice(turns, r["a"] + 1, r["b"] - r["a"])
        return F.struct(first["header"].alias("header"), first["name"].alias("name"), first["role"].alias("role"), F.array_join(F.transform(rows, lambda t: t["content"]), "\n").alias("content"))

    kind = "array<struct<header:string,name:string,role:string,content:string>>"
    return F.when(F.size(turns) == 0, F.array().cast(kind)).otherwise(F.transform(runs, run))


def split_transcripts(raw: DataFrame) -> DataFrame:
    """raw (transcript_id, title, subheader, date, body) -> the same with arrays ``turns`` and ``merged``."""
    out = raw.withColumn("turns", speaker_turns(F.coalesce("body", F.lit(""))))
    return out.withColumn("merged", merged_turns(F.col("turns")))


def segments(split: DataFrame) -> DataFrame:
    """One row per merged turn; segment_id from 0."""
    # The outer form keeps Catalyst from filtering on the size of the array, which would parse every body once more.
    return split.select(
        "transcript_id", X.company_name(F.col("subheader"), F.col("title")).alias("company_name"), "date", X.as_text(F.col("title")).alias("title"),
        F.posexplode_outer("merged").alias("segment_id", "t"),
    ).filter("t IS NOT NULL").select(
        "transcript_id", F.col("segment_id").cast("long").alias("segment_id"), "company_name", "date", "title",
        F.col("t.name").alias("speaker_name"), F.col("t.role").alias("speaker_role"), F.col("t.content").alias("content"),
    )


def trace(split: DataFrame) -> DataFrame:
    """Lengths before and after segmentation, per transcript."""
    length = F.aggregate("turns", F.lit(0), lambda n, t: n + F.length(t.header) + F.length(t.content))
    return split.select(
        "transcript_id", F.length(F.coalesce("body", F.lit(""))).alias("raw_length"),
        F.when(F.size("turns") > 0, length + 2 * F.size("turns") - 1).otherwise(0).alias("segmented_length"),
        F.size("turns").alias("n_raw_segments"), F.size("merged").alias("n_merged_segments"),
    )


def run_merge(df: DataFrame, group: str, order: list[str], key: str, text: str) -> DataFrame:
    """Run-length merge over rows: consecutive rows of a group with one ``key`` become one (gaps and islands)."""
    w = Window.partitionBy(group).orderBy(*order)
    new = F.when(F.lag(key).over(w).eqNullSafe(F.col(key)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    runs = df.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.sort_array(F.collect_list(F.struct(*order, text)))
    return runs.groupBy(group, "run", key).agg(
        F.count("*").alias("n"), F.array_join(F.transform(parts, lambda s: s[text]), "\n").alias(text)
    )


def label_sections(turns: DataFrame, transcript: str = "transcript_id", segment: str = "segment_id", role: str = "speaker_role") -> DataFrame:
    """qa_started (an analyst has spoken, this turn included) and section: Prepared, Q, A or O."""
    w = Window.partitionBy(transcript).orderBy(segment).rowsBetween(Window.unboundedPreceding, 0)
    started = F.max(F.coalesce(F.col(role) == "Analyst", F.lit(False))).over(w)
    section = (
        F.when(F.col(role) == "Analyst", "Q").when((F.col(role) == "Executive") & ~F.col("qa_started"), "Prepared")
        .when(F.col(role) == "Executive", "A").otherwise("O")
    )
    return turns.withColumn("qa_started", started).withColumn("section", section)


def section_counts(turns: DataFrame) -> DataFrame:
    """One pass with a fixed set of columns; 0 where a section is missing."""
    named = {"Prepared": "n_prepared", "Q": "n_q", "A": "n_a", "O": "n_o"}
    return turns.groupBy("transcript_id").agg(*[F.count_if(F.col("section") == s).alias(n) for s, n in named.items()])


def validation(traced: DataFrame, counts: DataFrame) -> DataFrame:
    out = traced.join(counts, "transcript_id", "left").fillna(0, ["n_prepared", "n_q", "n_a", "n_o"])
    rate = N.drop_rate(F.col("raw_length"), F.col("segmented_length"))
    return out.withColumns({
        "drop_rate": rate, "drop_rate_ok": rate < 0.05, "qa_balance_gap": F.abs(F.col("n_q") - F.col("n_a")),
        "qa_balance_ratio": N.balance(F.col("n_q"), F.col("n_a")),
    })
