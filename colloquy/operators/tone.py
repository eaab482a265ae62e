"""Chunks, scores and tone features."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as X

LABELS = ("neutral", "positive", "negative")
SECTIONS = {"Prepared": ("Prepared",), "Q": ("Q",), "A": ("A",), "QA": ("Q", "A")}


#: Sentences folded together: a fold appends to its result, which is kept short by starting a new one.
FOLD = 256


def pack_bounds(counts: Column, most: int) -> Column:
    """array<struct<a,b,hard>>: runs of sentences (from 1) of at most ``most`` tokens, or one sentence of more."""
    bound = "array<struct<a:int,b:int,hard:boolean>>"
    none = F.array().cast(bound)

    def run(a: Column, b: Column, hard: bool) -> Column:
        return F.struct(a.alias("a"), b.alias("b"), F.lit(hard).alias("hard"))

    def flushed(acc: Column) -> Column:
        return F.when(acc["n"] > 0, F.concat(acc["out"], F.array(run(acc["a"], acc["i"], False)))).otherwise(acc["out"])

    def step(acc: Column, n: Column) -> Column:
        i = acc["i"] + 1
        alone = F.struct(F.concat(flushed(acc), F.array(run(i, i, True))).alias("out"), (i + 1).alias("a"), i.alias("i"), F.lit(0).alias("n"))
        new = F.struct(flushed(acc).alias("out"), i.alias("a"), i.alias("i"), n.alias("n"))
        more = F.struct(acc["out"].alias("out"), acc["a"].alias("a"), i.alias("i"), (acc["n"] + n).alias("n"))
        return F.when(n > most, alone).when((acc["n"] > 0) & (acc["n"] + n > most), new).otherwise(more)

    def block(acc: Column, part: Column) -> Column:
        now = acc["now"]
        begin = F.struct(none.alias("out"), now["a"].alias("a"), now["i"].alias("i"), now["n"].alias("n"))
        return F.struct(F.concat(acc["done"], F.array(now["out"])).alias("done"), F.aggregate(part, begin, step).alias("now"))

    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.size(counts) - 1, F.lit(0)), F.lit(FOLD)), lambda k: F.slice(counts, k + 1, FOLD))
    start = F.struct(
        F.array().cast(f"array<{bound}>").alias("done"),
        F.struct(none.alias("out"), F.lit(1).alias("a"), F.lit(0).alias("i"), F.lit(0).alias("n")).alias("now"),
    )
    return F.aggregate(parts, start, block, lambda acc: F.flatten(F.concat(acc["done"], F.array(flushed(acc["now"])))))


def pack_texts(whole: Column, texts: Column, bounds: Column, most: int, total: Column, windows: Column | None = None) -> Column:
    """array<string>: the sentences of each bound; a text whose ``total`` fits is left as it is, a sentence that doesn't is split into its ``windows``, or runs of ``most`` words."""
    def text_of(b: Column) -> Column:
        if windows is None:
            words = F.regexp_extract_all(F.get(texts, b["a"] - 1), F.lit(r"\S+"), F.lit(0))
            hard = F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(most)), lambda k: F.array_join(F.slice(words, k + 1, most), " "))
        else:
            hard = F.get(windows, b["a"] - 1)
        return F.when(b["hard"], hard).otherwise(F.array(F.array_join(F.slice(texts, b["a"], b["b"] - b["a"] + 1), " ")))

    return F.when(whole == "", F.array().cast("array<string>")).when(total <= most, F.array(whole)).otherwise(F.flatten(F.transform(bounds, text_of)))


def packed(c: Column, most: int, count: Callable[[Column], Column] = X.token_count) -> Column:
    """array<string>: sentences packed greedily up to ``most`` tokens, as one expression for short texts; ``chunks`` takes any."""
    texts = X.sentences(c)
    return pack_texts(X.as_text(c), texts, pack_bounds(F.transform(texts, count), most), most, count(X.as_text(c)))


def chunks(segs: DataFrame, most: int = 510, count: Callable[[Column], Column] = X.token_count) -> DataFrame:
    """One row per chunk: chunk_id, chunk_order (from 1, counted before empty chunks go), chunk_text, chunk_token_count.

    ``count`` is a function of columns, or a counter with ``each`` and ``windows`` (``functions.wordpiece``) whose work on all sentences is done by batches.
    """
    keep = [c for c in segs.columns if c != "content"]
    # Sentences and bounds are columns of their own: inside the expression of the texts they would be made again for every chunk.
    out = segs.select(*keep, X.as_text(F.col("content")).alias("_whole"), X.sentences(F.col("content")).alias("_texts"))
    batched = hasattr(count, "each")
    out = out.withColumn("_counts", count.each(F.col("_texts")) if batched else F.transform("_texts", count)).withColumn("_bounds", pack_bounds(F.col("_counts"), most))
    if batched:
        out = out.withColumn("_windows", count.windows(F.col("_texts"), most))
        total, cut = F.aggregate("_counts", F.lit(0), lambda a, b: a + b), F.col("_windows")
    else:
        total, cut = count(F.col("_whole")), None
    # The outer form keeps Catalyst from filtering on the size of the array, which would pack every text once more.
    texts = pack_texts(F.col("_whole"), F.col("_texts"), F.col("_bounds"), most, total, cut)
    out = out.select(*keep, F.posexplode_outer(texts).alias("_at", "chunk_text")).filter("chunk_text IS NOT NULL")
    some = F.col("chunk_text").rlike(r"\S") if batched or count is X.token_count else count(F.col("chunk_text")) > 0
    out = out.filter(some).withColumn("chunk_order", (F.col("_at") + 1).cast("long")).withColumn("chunk_token_count", count(F.col("chunk_text")).cast("long")).drop("_at")
    return out.withColumn("chunk_id", F.concat_ws("_", "transcript_id", "segment_id", "chunk_order"))


def without_operator(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("section").eqNullSafe("O"))


_loaded: dict[str, Callable] = {}


def load_once(load: Callable[[], Callable], name: str) -> Callable:
    """What ``load`` gives, made once in each Python worker."""
    if name not in _loaded:
        _loaded[name] = load()
    return _loaded[name]


def scored_by(
    df: DataFrame, score: Callable[[pd.Series], pd.DataFrame] | None = None, column: str = "chunk_text", load: Callable[[], Callable] | None = None,
    most_tokens: int | None = None,
) -> DataFrame:
    """Scores from a callable of the caller, Arrow batch by batch, shortest texts first within a partition.

    ``score`` takes a series of texts (cut to their first ``most_tokens`` tokens, if given)
    and gives one column of probabilities per label. Instead of it, ``load`` may make it: a
    model and its tokenizer are then loaded once in each Python worker and not sent there.
    """
    if (score is None) == (load is None):
        raise ValueError("either score or load is needed")
    schema = df.schema
    for name in LABELS:
        schema = schema.add(f"p_{name}", "double")
    schema = schema.add("pred_label", "string")
    key = uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = score or load_once(load, key)
        for batch in batches:
            p = model(batch["_scored"]).set_axis([f"p_{n}" for n in LABELS], axis=1).set_axis(batch.index)
            out = pd.concat([batch.drop(columns="_scored"), p.astype("float64")], axis=1)
            yield out.assign(pred_label=[LABELS[k] for k in p.to_numpy().argmax(axis=1)] if len(p) else [])

    order = "chunk_token_count" if "chunk_token_count" in df.columns else column
    text = X.first_tokens(F.col(column), most_tokens) if most_tokens else F.col(column)
    return df.withColumn("_scored", text).sortWithinPartitions(order).mapInPandas(run, schema)


def scored_by_logits(df: DataFrame, logits: Column) -> DataFrame:
    """Scores from an array column of logits, inside generated code."""
    out = df.withColumn("_p", N.softmax(logits))
    for k, name in enumerate(LABELS):
        out = out.withColumn(f"p_{name}", F.col("_p")[k])
    names = F.array(*[F.lit(n) for n in LABELS])
    return out.withColumn("pred_label", F.get(names, N.argmax(F.col("_p")))).drop("_p")


def with_neg_score(df: DataFrame) -> DataFrame:
    return df.withColumn("neg_score", F.col("p_negative") - F.col("p_positive"))


def segment_scores(df: DataFrame) -> DataFrame:
    """Per segment: the mean by tokens (at least 1 each), the tokens, the largest score."""
    weight = N.clip(F.col("chunk_token_count"), 1)
    some = df.dropna("any", subset=["transcript_id", "segment_id", "section"])
    return some.groupBy("transcript_id", "segment_id", "section").agg(
        F.try_divide(F.sum(F.col("neg_score") * weight), F.sum(F.when(F.col("neg_score").isNotNull(), weight))).alias("seg_score"),
        F.sum("chunk_token_count").alias("seg_tokens"), F.max("neg_score").alias("seg_max"),
    )


def transcript_features(segs: DataFrame) -> DataFrame:
    """All sections and measures in one aggregate: mean, mean by tokens and mean of the largest, counts and gaps."""
    aggs = []
    for name, members in SECTIONS.items():
        low, inside = name.lower(), F.col("section").isin(*members)
        score, tokens, top = (F.when(inside, F.col(c)) for c in ("seg_score", "seg_tokens", "seg_max"))
        n, t = F.nullif(F.count(F.when(inside, 1)), F.lit(0)), F.sum(tokens)
        by_tokens = F.try_divide(F.sum(score * N.clip(tokens, 1)), F.sum(tokens))
        aggs += [F.avg(score).alias(f"Neg{name}"), n.alias(f"n_segments_{low}"), t.alias(f"n_tokens_{low}"), by_tokens.alias(f"Neg{name}_seglenw"),
                 F.avg(top).alias(f"Neg{name}_segmax"), n.alias(f"n_segments_{low}_segmax"), t.alias(f"n_tokens_{low}_segmax")]
    out = segs.groupBy("transcript_id").agg(*aggs)
    for tail in ("", "_seglenw", "_segmax"):
        out = out.withColumn(f"NegGap{tail}", F.col(f"NegQA{tail}") - F.col(f"NegPrepared{tail}"))
    return out
