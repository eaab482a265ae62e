"""From chunks to an annotation sample, labels, and a dataset that is ready for training."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as X
from . import sampling

#: Columns a sample keeps, those a teacher gives, the order of the finished frame, ids of the labels.
KEPT = ("chunk_id", "transcript_id", "segment_id", "chunk_order", "company_name", "ticker", "date", "title", "speaker_name", "speaker_role", "section", "chunk_text", "chunk_token_count")
TEACHER = ("p_negative", "p_neutral", "p_positive", "pred_label", "neg_score")
ORDER = (*KEPT[:-2], "chunk_token_count", "chunk_text", "pred_label", "p_negative", "p_neutral", "p_positive", "neg_score", "teacher_neg_score", "label", "label_reason", "label_source", "llm_model", "label_status")
SORT = ("date", "transcript_id", "segment_id", "chunk_order")
LABEL_IDS = {"neutral": 0, "positive": 1, "negative": 2}
TOKENS = (15, 256)
#: Columns that labelling adds; those of an earlier run go.
LABEL_COLUMNS = ("label", "label_reason", "label_source", "llm_model", "label_status", "llm_cost", "attempts", "raw_response", "error")


def present(df: DataFrame, columns) -> list[str]:
    return [c for c in columns if c in df.columns]


def first_existing(df: DataFrame, candidates) -> str | None:
    return next(iter(present(df, candidates)), None)


def in_reading_order(df: DataFrame) -> list[Column]:
    """Sort keys: those of ``SORT`` that are there, missing values last, and the chunk's id."""
    return [F.col(c).asc_nulls_last() for c in present(df, (*SORT, "chunk_id"))]


def prepared(chunks: DataFrame, tokens: tuple[int, int] = TOKENS) -> DataFrame:
    """Known columns; no operator, no chunk outside the token bounds, no blank text; dates read where they can be."""
    out = chunks.select(*present(chunks, KEPT))
    if "section" in out.columns:
        out = out.filter(~F.col("section").eqNullSafe("O"))
    if "chunk_token_count" in out.columns:
        out = out.filter(F.col("chunk_token_count").between(*tokens))
    out = out.withColumn("chunk_text", X.as_text(F.col("chunk_text"))).filter("chunk_text <> ''")
    return out.withColumn("date", F.col("date").try_cast("timestamp")) if "date" in out.columns else out


def sorted_chunks(df: DataFrame) -> DataFrame:
    return df.orderBy(*in_reading_order(df))


def with_teacher(df: DataFrame, scored: DataFrame | None) -> DataFrame:
    """Scores of a teacher by chunk_id, where there are usable ones, and teacher_neg_score."""
    have = present(scored, TEACHER) if scored is not None else []
    if not have or "chunk_id" not in scored.columns:
        return df
    one = scored.groupBy("chunk_id").agg(F.first(F.struct(*have)).alias("_t")).select("chunk_id", "_t.*")
    out = df.join(one, "chunk_id", "left")
    if "teacher_neg_score" in out.columns:
        return out
    if "neg_score" in out.columns:
        return out.withColumn("teacher_neg_score", N.number(F.col("neg_score")))
    if {"p_negative", "p_positive"} <= set(out.columns):
        return out.withColumn("teacher_neg_score", N.number(F.col("p_negative")) - N.number(F.col("p_positive")))
    return out


def annotation_sample(chunks: DataFrame, scored: DataFrame | None = None, size: int = 2500, seed: int = 42) -> DataFrame:
    """Prepared chunks, sampled by section with a share of a teacher's extremes, as an empty annotation frame."""
    df = with_teacher(prepared(chunks), scored)
    score = "teacher_neg_score" if "teacher_neg_score" in df.columns else None
    if "section" in df.columns:
        out = sampling.stratified(df, size, "chunk_id", score=score, seed=seed)
    else:
        out = sampling.uniform(df, size, "chunk_id", seed)
    return sampling.annotation_frame(out, list(ORDER))


def prompt(df: DataFrame) -> Column:
    """The question asked about a chunk; fields that are missing are empty. The wording is fixed."""
    def field(name: str) -> Column:
        return X.as_text(F.col(name).cast("string")) if name in df.columns else F.lit("")

    heads = (("Company", "company_name"), ("Ticker", "ticker"), ("Date", "date"), ("Section", "section"), ("Speaker", "speaker_name"), ("Speaker role", "speaker_role"))
    lines = [F.concat(F.lit(f"{title}: "), field(name)) for title, name in heads]
    return F.concat(
        F.lit("Classify the following earnings-call chunk.\n\n"), F.concat_ws("\n", *lines), F.lit("\n\nChunk:\n"), field("chunk_text"),
        F.lit('\n\nReturn valid JSON only with this exact schema: {"label":"negative|neutral|positive","reason":"short explanation"}'),
    )


#: Fixed value: the least temperature that a service is asked for.
LEAST_TEMPERATURE = 0.5


def request_body(question: Column, model: str, system: str, temperature: float | Column = 0.0) -> Column:
    """The JSON of a chat request: a system and a user message. A temperature below the least one, missing or no number is that one."""
    asked = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    warm = F.greatest(F.lit(LEAST_TEMPERATURE), F.nanvl(asked.cast("double"), F.lit(LEAST_TEMPERATURE)))
    said = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    messages = F.array(said("system", F.lit(system)), said("user", F.coalesce(question, F.lit(""))))
    return F.to_json(F.struct(F.lit(model).alias("model"), messages.alias("messages"), warm.alias("temperature")))


def labelled(sample: DataFrame, ask: Callable[[str], str], model: str, max_rows: int | None = None, **how) -> DataFrame:
    """The sample (its first ``max_rows`` in reading order, if given) with the labels of a service joined back by chunk_id.

    Rows that fail stay, as failed ones. ``how`` goes to ``sampling.labelled_by``.
    """
    rows = sample if max_rows is None else sample.orderBy(*in_reading_order(sample)).limit(max_rows)
    asked = rows.select("chunk_id", prompt(rows).alias("_prompt"))
    answers = sampling.labelled_by(asked, ask, "_prompt", "chunk_id", **how)
    ok = F.col("label_status") == "ok"
    answers = answers.select(
        "chunk_id", *[F.when(ok, F.col(c)).alias(c) for c in ("label", "label_reason")], F.lit("llm").alias("label_source"), F.lit(model).alias("llm_model"),
        "label_status", F.lit(None).cast("double").alias("llm_cost"), "attempts", F.when(ok, F.col("raw_response")).alias("raw_response"), "error",
    )
    return rows.drop(*LABEL_COLUMNS).join(answers, "chunk_id", "left")


def status_counts(df: DataFrame, column: str = "label_status") -> DataFrame:
    """One row: rows, and how many are ok, failed or open."""
    status = F.coalesce(F.col(column), F.lit("pending"))
    return df.agg(F.count("*").alias("n_rows"), *[F.count_if(status == s).alias(f"n_{s}") for s in ("ok", "failed", "pending")])


def train_ready(labelled_rows: DataFrame, train: float = 0.7, valid: float = 0.15) -> DataFrame:
    """Usable labelled rows with ``labels`` (ids) and ``split`` by transcript. Raises where no row or no transcript is left for a split."""
    df = sampling.trainable(labelled_rows)
    ids = F.create_map(*[F.lit(x) for pair in LABEL_IDS.items() for x in pair])
    df = df.withColumn("chunk_text", X.as_text(F.col("chunk_text"))).withColumn("labels", ids[F.col("label")])
    split = sampling.group_split(df, "transcript_id", "date", train, valid)
    sizes = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}  # three rows
    if not sizes:
        raise ValueError("no valid labelled rows are left")
    if len(sizes) < 3:
        raise ValueError(f"a split would be empty: {sizes}")
    return df.join(split, "transcript_id")
