"""All registered queries and their SQL, by name.

The driver's tables stand in for the domain's: conversations are transcripts
(user: Executive, assistant: Analyst, system: Operator), line items by supplier
and day are market panels, orders are calls, market caps and earnings, customers
are firms, documents are chunk texts.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as X
from ..operators import annotation, describe, econ, events, relate, sampling, tone, turns
from ..session import kept, work_folder
from ..sources import readers
from ..sources.panel_store import PanelStore
from .pipelines import merge_raw, merge_report

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    """Register a query under its own name, with its SQL."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


# Transcripts

ROLE = {"user": "Executive", "assistant": "Analyst", "system": "Operator"}


def role_column() -> Column:
    out = F.lit("Unknown")
    for name, role in ROLE.items():
        out = F.when(F.col("role") == name, role).otherwise(out)
    return out


def spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    named = c.select(F.col("conv_id").alias("transcript_id"), F.col("turn").alias("segment_id"), role_column().alias("speaker_role"), F.col("text").alias("content"))
    return turns.label_sections(named)


SPOKEN = """
spoken AS (
  SELECT *, CASE WHEN speaker_role = 'Analyst' THEN 'Q' WHEN speaker_role = 'Executive' AND NOT qa_started THEN 'Prepared'
                 WHEN speaker_role = 'Executive' THEN 'A' ELSE 'O' END AS section
  FROM (SELECT *, max(coalesce(speaker_role = 'Analyst', false)) OVER (PARTITION BY transcript_id ORDER BY segment_id) AS qa_started
        FROM (SELECT conv_id AS transcript_id, turn AS segment_id, text AS content,
                CASE role WHEN 'user' THEN 'Executive' WHEN 'assistant' THEN 'Analyst' WHEN 'system' THEN 'Operator' ELSE 'Unknown' END AS speaker_role
              FROM conversations)))
"""


@query(f"WITH {SPOKEN} SELECT transcript_id, segment_id, speaker_role, qa_started, section FROM spoken")
def section_label(spark, sf_dir):
    return spoken(spark, sf_dir).select("transcript_id", "segment_id", "speaker_role", "qa_started", "section")


def logits() -> Column:
    n = F.length("content")
    return F.array(*[(n % k) / F.lit(4.0) for k in (5, 7, 11)])


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tone.without_operator(spoken(spark, sf_dir)).withColumn("chunk_token_count", X.token_count(F.col("content")).cast("long"))
    return tone.with_neg_score(tone.scored_by_logits(s, logits()))


SCORED = SPOKEN + r"""
, l AS (SELECT *, (length(content) % 5) / 4.0::DOUBLE AS a, (length(content) % 7) / 4.0::DOUBLE AS b, (length(content) % 11) / 4.0::DOUBLE AS c,
        len(regexp_extract_all(content, '\S+'))::BIGINT AS chunk_token_count FROM spoken WHERE section <> 'O'),
scored AS (SELECT *, exp(a) / (exp(a) + exp(b) + exp(c)) AS p_neutral, exp(b) / (exp(a) + exp(b) + exp(c)) AS p_positive, exp(c) / (exp(a) + exp(b) + exp(c)) AS p_negative,
           CASE WHEN a >= b AND a >= c THEN 'neutral' WHEN b >= c THEN 'positive' ELSE 'negative' END AS pred_label,
           (exp(c) - exp(b)) / (exp(a) + exp(b) + exp(c)) AS neg_score FROM l)
"""


@query(f"WITH {SCORED} SELECT transcript_id, segment_id, round(p_neutral, 6) AS p_neutral, round(p_positive, 6) AS p_positive, round(p_negative, 6) AS p_negative, pred_label, round(neg_score, 6) AS neg_score FROM scored")
def score_expression(spark, sf_dir):
    out = scored(spark, sf_dir).select("transcript_id", "segment_id", "p_neutral", "p_positive", "p_negative", "pred_label", "neg_score")
    return rounded(out, "p_neutral", "p_positive", "p_negative", "neg_score")


def stand_in_scores(texts):
    """Deterministic stand-in for a model: the softmax of the same logits, batch by batch."""
    import numpy as np
    import pandas as pd

    n = texts.fillna("").str.len().to_numpy()
    e = np.exp(np.stack([(n % k) / 4.0 for k in (5, 7, 11)], axis=1))
    return pd.DataFrame(e / e.sum(axis=1, keepdims=True))


@query(f"WITH {SCORED} SELECT transcript_id, segment_id, round(p_neutral, 6) AS p_neutral, round(p_positive, 6) AS p_positive, round(p_negative, 6) AS p_negative, pred_label FROM scored")
def score_udf(spark, sf_dir):
    df = tone.without_operator(spoken(spark, sf_dir)).select("transcript_id", "segment_id", "content")
    return rounded(tone.scored_by(df, stand_in_scores, "content").drop("content"), "p_neutral", "p_positive", "p_negative")


SEGMENTS = SCORED + """
, seg AS (SELECT transcript_id, segment_id, section, sum(neg_score * greatest(chunk_token_count, 1)) / sum(greatest(chunk_token_count, 1)) AS seg_score,
          sum(chunk_token_count)::BIGINT AS seg_tokens, max(neg_score) AS seg_max FROM scored GROUP BY ALL)
"""


@query(f"WITH {SEGMENTS} SELECT transcript_id, segment_id, section, round(seg_score, 6) AS seg_score, seg_tokens, round(seg_max, 6) AS seg_max FROM seg")
def segment_scores(spark, sf_dir):
    return rounded(tone.segment_scores(scored(spark, sf_dir)), "seg_score", "seg_max")


def _feature_sql(digits: int | None = 6) -> str:
    cols = []
    r = (lambda e: f"round({e}, {digits})") if digits else (lambda e: e)
    means = {}
    for name, members in tone.SECTIONS.items():
        inside = "section IN (" + ", ".join(f"'{m}'" for m in members) + ")"
        low = name.lower()
        means[name] = {"": f"avg(seg_score) FILTER ({inside})", "_segmax": f"avg(seg_max) FILTER ({inside})",
                       "_seglenw": f"sum(seg_score * greatest(seg_tokens, 1)) FILTER ({inside}) / nullif(sum(seg_tokens) FILTER ({inside}), 0)"}
        cols += [f"{r(e)} AS Neg{name}{tail}" for tail, e in means[name].items()]
        for tail in ("", "_segmax"):
            cols += [f"nullif(count(*) FILTER ({inside}), 0) AS n_segments_{low}{tail}", f"(sum(seg_tokens) FILTER ({inside}))::BIGINT AS n_tokens_{low}{tail}"]
    cols += [f"{r(means['QA'][t] + ' - ' + means['Prepared'][t])} AS NegGap{t}" for t in ("", "_seglenw", "_segmax")]
    return f"SELECT transcript_id, {', '.join(cols)} FROM seg GROUP BY transcript_id"


@query(f"WITH {SEGMENTS} {_feature_sql().replace('FILTER (section', 'FILTER (WHERE section')}")
def transcript_features(spark, sf_dir):
    out = tone.transcript_features(tone.segment_scores(scored(spark, sf_dir)))
    return rounded(out, *[c for c in out.columns if c.startswith("Neg")])


@query(f"""WITH {SPOKEN} SELECT transcript_id, count(*) FILTER (WHERE section = 'Prepared') AS n_prepared, count(*) FILTER (WHERE section = 'Q') AS n_q,
  count(*) FILTER (WHERE section = 'A') AS n_a, count(*) FILTER (WHERE section = 'O') AS n_o FROM spoken GROUP BY transcript_id""")
def section_pivot(spark, sf_dir):
    return turns.section_counts(spoken(spark, sf_dir))


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcript bodies built from the turns, with a header line each: what the parser must find again."""
    c = table(spark, sf_dir, "conversations")
    head = F.when(F.col("role") == "system", "OperatorOperator").otherwise(F.concat(F.lit("Speaker "), F.col("role"), role_column()))
    line = F.concat(head, F.lit("\n"), X.trimmed(F.col("text")))
    parts = F.sort_array(F.collect_list(F.struct("turn", line.alias("l"))))
    return c.groupBy(F.col("conv_id").alias("transcript_id")).agg(F.concat(F.lit("intro\n"), F.array_join(F.transform(parts, lambda p: p.l), "\n")).alias("body"))


TURNS = r"""
t AS (SELECT conv_id AS transcript_id, turn, CASE role WHEN 'system' THEN 'Operator' ELSE 'Speaker ' || role END AS speaker_name,
        CASE role WHEN 'user' THEN 'Executive' WHEN 'assistant' THEN 'Analyst' ELSE 'Operator' END AS speaker_role, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS content FROM conversations),
kept AS (SELECT *, CASE speaker_role WHEN 'Operator' THEN 16 ELSE length(speaker_name) + length(speaker_role) END AS head FROM t WHERE content <> ''),
marked AS (SELECT *, CASE WHEN lag(speaker_name || '|' || speaker_role) OVER (PARTITION BY transcript_id ORDER BY turn) IS NOT DISTINCT FROM speaker_name || '|' || speaker_role THEN 0 ELSE 1 END AS new FROM kept),
runs AS (SELECT *, sum(new) OVER (PARTITION BY transcript_id ORDER BY turn) AS run FROM marked),
merged AS (SELECT transcript_id, run - 1 AS segment_id, speaker_name, speaker_role, string_agg(content, chr(10) ORDER BY turn) AS content FROM runs GROUP BY ALL)
"""


@query(f"WITH {TURNS} SELECT transcript_id, segment_id::BIGINT AS segment_id, speaker_name, speaker_role, content FROM merged")
def speaker_split(spark, sf_dir):
    raw = bodies(spark, sf_dir).withColumns({"title": F.lit("T - x"), "subheader": F.lit(None).cast("string"), "date": F.lit(None).cast("timestamp")})
    return turns.segments(turns.split_transcripts(raw)).select("transcript_id", "segment_id", "speaker_name", "speaker_role", "content")


VALIDATION = f"""{TURNS}, raw AS (SELECT transcript_id, 5 + sum(1 + CASE speaker_role WHEN 'Operator' THEN 16 ELSE length(speaker_name) + length(speaker_role) END + 1 + length(content)) AS raw_length FROM t GROUP BY ALL),
 one AS (SELECT transcript_id, sum(head + length(content)) + 2 * count(*) - 1 AS segmented_length, count(*) AS n_raw_segments, max(run) AS n_merged_segments FROM runs GROUP BY ALL),
 counts AS (WITH {SPOKEN} SELECT transcript_id, count(*) FILTER (WHERE section = 'Prepared') AS n_prepared, count(*) FILTER (WHERE section = 'Q') AS n_q, count(*) FILTER (WHERE section = 'A') AS n_a, count(*) FILTER (WHERE section = 'O') AS n_o FROM spoken GROUP BY ALL),
checked AS (SELECT transcript_id, raw_length::BIGINT AS raw_length, segmented_length::BIGINT AS segmented_length, n_raw_segments, n_merged_segments::BIGINT AS n_merged_segments, n_prepared, n_q, n_a, n_o,
  round(greatest(0.0, 1 - segmented_length / raw_length::DOUBLE), 6) AS drop_rate, greatest(0.0, 1 - segmented_length / raw_length::DOUBLE) < 0.05 AS drop_rate_ok,
  abs(n_q - n_a) AS qa_balance_gap, round(CASE WHEN greatest(n_q, n_a) > 0 THEN least(n_q, n_a) / greatest(n_q, n_a)::DOUBLE END, 6) AS qa_balance_ratio
FROM raw JOIN one USING (transcript_id) JOIN counts USING (transcript_id))"""


@query(f"WITH {VALIDATION} SELECT * FROM checked")
def validation(spark, sf_dir):
    split = turns.split_transcripts(bodies(spark, sf_dir))
    out = turns.validation(turns.trace(split), turns.section_counts(spoken(spark, sf_dir)))
    return rounded(out, "drop_rate", "qa_balance_ratio")


@query(f"""WITH {VALIDATION} SELECT count(*) AS n_transcripts, round(avg(drop_rate), 6) AS mean_drop_rate, round(max(drop_rate), 6) AS max_drop_rate, count(*) FILTER (WHERE NOT drop_rate_ok) AS n_drop_alerts,
 count(*) FILTER (WHERE n_q > 0 OR n_a > 0) AS n_with_qa, count(*) FILTER (WHERE qa_balance_ratio < 0.5) AS n_ratio_below_half, count(*) FILTER (WHERE qa_balance_ratio < 0.25) AS n_ratio_below_quarter,
 count(*) FILTER (WHERE (n_q > 0 OR n_a > 0) AND (n_q = 0 OR n_a = 0)) AS n_one_sided, round(avg(qa_balance_gap) FILTER (WHERE n_q > 0 OR n_a > 0), 6) AS mean_gap FROM checked""")
def validation_summary(spark, sf_dir):
    return rounded(describe.validation_summary(validation(spark, sf_dir)), "mean_drop_rate", "max_drop_rate", "mean_gap")


@query(f"""WITH {SPOKEN}, final AS (SELECT DISTINCT transcript_id, year(DATE '2024-01-01' + (transcript_id % 300)::INT) || 'Q' || quarter(DATE '2024-01-01' + (transcript_id % 300)::INT) AS q FROM spoken),
 sec AS (SELECT section, count(*) AS n FROM spoken GROUP BY 1), spk AS (SELECT speaker_role, count(*) AS n FROM spoken GROUP BY 1),
 v AS (SELECT 'observations' AS "check", (SELECT count(*) FROM final)::DOUBLE AS value, 'positive' AS want
  UNION ALL SELECT 'one_row_per_call', (SELECT count(*) - count(DISTINCT transcript_id) FROM final), 'zero' UNION ALL SELECT 'quarters', (SELECT count(DISTINCT q) FROM final), 'positive'
  UNION ALL SELECT 'section_shares', (SELECT sum(n) FROM sec) / (SELECT count(*) FROM spoken), 'one' UNION ALL SELECT 'speaker_shares', (SELECT sum(n) FROM spk) / (SELECT count(*) FROM spoken), 'one'
  UNION ALL SELECT 'executive_is_prepared_and_a', (SELECT n FROM spk WHERE speaker_role = 'Executive') - (SELECT sum(n) FROM sec WHERE section IN ('Prepared', 'A')), 'zero'
  UNION ALL SELECT 'analyst_is_q', (SELECT n FROM spk WHERE speaker_role = 'Analyst') - (SELECT n FROM sec WHERE section = 'Q'), 'zero')
SELECT "check", round(value, 6) AS value, CASE want WHEN 'zero' THEN value = 0 WHEN 'one' THEN abs(value - 1) < 1e-8 ELSE value > 0 END AS passed FROM v""")
def consistency_checks(spark, sf_dir):
    s = spoken(spark, sf_dir)
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("transcript_id") % 300).cast("int"))
    final = s.select("transcript_id").distinct().withColumn("year_quarter", N.quarter_label(day))
    return rounded(describe.basic_checks(final, s), "value")


@query("""WITH e AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM e)
 SELECT user_id, run::BIGINT AS run, event_type, count(*) AS n, string_agg(props, chr(10) ORDER BY ts, event_id) AS props FROM r GROUP BY user_id, run, event_type""")
def run_merge(spark, sf_dir):
    return turns.run_merge(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type", "props")


@query(f"WITH {SPOKEN} SELECT transcript_id, segment_id, concat('Section: ', section, chr(10), 'Speaker role: ', speaker_role, chr(10), 'Chunk: ', content) AS prompt FROM spoken")
def prompt_text(spark, sf_dir):
    p = X.prompt(**{"Section": F.col("section"), "Speaker role": F.col("speaker_role"), "Chunk": F.col("content")})
    return spoken(spark, sf_dir).select("transcript_id", "segment_id", p.alias("prompt"))


def stand_in_answer(prompt: str) -> str:
    """Deterministic stand-in for a labelling service, with an answer that can't be used (and is asked for again) now and then."""
    kind = ("pos", "NEUTRAL", "neg", "maybe")[len(prompt) % 4]
    return f'Sure: {{"label": "{kind}", "reason": "length {len(prompt)}"}} ok'


@query(f"""WITH {SPOKEN}, p AS (SELECT transcript_id || '_' || segment_id AS chunk_id, length(content) AS n FROM spoken)
SELECT chunk_id, [ 'positive', 'neutral', 'negative', NULL ][n % 4 + 1] AS label, CASE WHEN n % 4 < 3 THEN 'length ' || n END AS label_reason, CASE WHEN n % 4 = 3 THEN 'failed' ELSE 'ok' END AS label_status,
 CASE WHEN n % 4 = 3 THEN 3 ELSE 1 END AS attempts FROM p""")
def label_udf(spark, sf_dir):
    df = spoken(spark, sf_dir).select(F.concat_ws("_", "transcript_id", "segment_id").alias("chunk_id"), F.col("content").alias("prompt"))
    return sampling.labelled_by(df, stand_in_answer, "prompt", "chunk_id").select("chunk_id", "label", "label_reason", "label_status", "attempts")


# Texts

@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(replace(replace(coalesce(text, ''), chr(160), ' '), chr(13), ''), '[ \t]*\n[ \t\n]*', chr(10), 'g'), '[ \t]+', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12)) AS text FROM documents""")
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.clean_text(F.col("text")).alias("text"))


@query(r"""WITH b AS (SELECT page_id, html, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS t FROM pages)
SELECT page_id, trim(regexp_replace(regexp_replace(replace(replace(coalesce(t, ''), chr(160), ' '), chr(13), ''), '[ \t]*\n[ \t\n]*', chr(10), 'g'), '[ \t]+', ' ', 'g'), ' ' || chr(9) || chr(10)) AS title FROM b""")
def page_title(spark, sf_dir):
    return readers.page_fields(table(spark, sf_dir, "pages")).select("page_id", "title")


CLEANED = r"""trim(regexp_replace(regexp_replace(replace(replace(coalesce({c}, ''), chr(160), ' '), chr(13), ''), '[ \t]*\n[ \t\n]*', chr(10), 'g'), '[ \t]+', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12))"""


@query(f"SELECT conv_id, turn, 'Call ' || conv_id AS title, '' AS subheader, role AS transcript_subheader, role || chr(10) || 'Guest' AS speakers, {CLEANED.format(c='text')} AS body, turn::VARCHAR AS list_item FROM conversations")
def article_fields(spark, sf_dir):
    """Pages built around the turns, with what the reader must find, leave out and put together."""
    c = table(spark, sf_dir, "conversations")
    safe = F.replace(F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    def div(mark: str, inner: Column) -> Column:
        return F.concat(F.lit(f'<div class="x {mark}_1ab">'), inner, F.lit("</div>"))

    marks = {k: m for k, (m, _) in readers.ARTICLE.items()}
    body = div(marks["body"], F.concat(F.lit("<style>p{}</style><div><p><b>"), safe, F.lit("</b></p></div><br>")))
    html = F.concat(
        F.lit("<html><body>menu<article>"), div(marks["title"], F.concat(F.lit("Call "), F.col("conv_id").cast("string"))), div(marks["title"], F.lit("again")),
        div(marks["transcript_subheader"], F.col("role")), div(marks["speakers"], F.col("role")), div(marks["speakers"], F.lit("Guest")), div(marks["speakers"], F.col("role")),
        body, body, F.lit("</article><div>end</div></body></html>"),
    )
    out = readers.article_fields(c.select("conv_id", "turn", html.alias("html")), key="turn")
    return out.drop("html")


@query(rf"""WITH p AS (SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS t,
 regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]+>', chr(10), 'g') AS b FROM pages)
SELECT page_id, {CLEANED.format(c='t')} AS title, {CLEANED.format(c='b')} AS body FROM p""")
def page_text(spark, sf_dir):
    return readers.page_fields(table(spark, sf_dir, "pages")).select("page_id", "title", "body")


SUFFIXES = "|".join(X.LEGAL_SUFFIXES)
KEY_SQL = rf"trim(regexp_replace(trim(regexp_replace(regexp_replace(replace(lower({{0}}), '&', ' and '), '[^a-z0-9]+', ' ', 'g'), ' +', ' ', 'g')), '(?:(?:^| )(?:{SUFFIXES}))+$', ''))"


@query("SELECT c_custkey, " + KEY_SQL.format("c_name || ' & Sons Holdings, Inc.'") + " AS key FROM customer")
def company_norm(spark, sf_dir):
    name = F.concat("c_name", F.lit(" & Sons Holdings, Inc."))
    return table(spark, sf_dir, "customer").select("c_custkey", X.company_key(name).alias("key"))


@query("SELECT c_custkey, replace(upper(trim(' br.' || c_name || ' ')), '.', '-') AS ticker FROM customer")
def ticker_norm(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", X.ticker(F.concat(F.lit(" br."), F.col("c_name"), F.lit(" "))).alias("ticker"))


@query("SELECT c_custkey, n_name AS ticker FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey IN (0, 2)")
def universe_semi(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    c = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("ticker"))
    return relate.in_universe(c, nation.filter("n_regionkey IN (0, 2)").select(F.lower("n_name").alias("Symbol")))


@query("SELECT c_custkey, CASE WHEN n_regionkey < 3 THEN n_nationkey END AS n_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey")
def enrich_left(spark, sf_dir):
    """Names with accents on one side, repeated and other names on the other."""
    nation = table(spark, sf_dir, "nation")
    accents = F.translate("n_name", "AEIOU", "ÀÉÎÕÜ")
    c = table(spark, sf_dir, "customer").join(nation.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat(accents, F.lit(", Inc.")).alias("company"))
    named = nation.select("n_nationkey", F.when(F.col("n_regionkey") < 3, F.col("n_name")).otherwise(F.concat("n_name", F.lit(" Land"))).alias("n_name"))
    twice = named.unionByName(named.withColumn("n_nationkey", F.col("n_nationkey") + 100))
    return relate.enrich(c, twice, "company", "n_name", ["n_nationkey"]).select("c_custkey", "n_nationkey")


@query("SELECT c_custkey, n_name AS metadata_name, n_nationkey AS ticker, n_regionkey AS size_class FROM customer JOIN nation ON c_nationkey = n_nationkey")
def metadata_enrich(spark, sf_dir):
    """Metadata under the names of its source, with columns that are not kept and without some that are."""
    nation = table(spark, sf_dir, "nation")
    metadata = nation.select(F.col("n_nationkey").alias("ticker"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("size class"), F.lit(1).alias("other"))
    c = table(spark, sf_dir, "customer").join(nation.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat("n_name", F.lit(" Group")).alias("company_name"))
    return relate.enrich_companies(c, metadata).drop("company_name")


@query("""WITH k AS (SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey IN (0, 2))
SELECT (SELECT count(*) FROM customer) AS n_rows, count(*) AS n_kept, count(DISTINCT n_name) AS n_companies, count(DISTINCT c_custkey % 50) AS n_transcripts, round(100.0 * count(*) / (SELECT count(*) FROM customer), 6) AS share FROM k""")
def universe_report(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    c = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select((F.col("c_custkey") % 50).alias("transcript_id"), F.col("n_name").alias("ticker"))
    kept = relate.in_universe(c, nation.filter("n_regionkey IN (0, 2)").select(F.lower("n_name").alias("Symbol")))
    return rounded(relate.universe_report(c, kept), "share")


@query("SELECT o_orderkey, o_orderdate + INTERVAL (o_orderkey % 1440) MINUTE AS parsed FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 7 = 0")
def long_date_parse(spark, sf_dir):
    at = F.col("o_orderdate") + F.make_dt_interval(mins=(F.col("o_orderkey") % 1440).cast("int"))
    day = F.element_at(F.array(*[F.lit(d) for d in ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")]), F.weekday(at) + 1)
    said = F.concat(F.when(F.col("o_orderkey") % 7 == 0, "Someday").otherwise(day), F.lit(", "), F.date_format(at, "MMMM d, yyyy h:mm a"))
    return table(spark, sf_dir, "orders").select("o_orderkey", X.long_date(said).cast("timestamp_ntz").alias("parsed"))


@query(r"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(trim(text, ' ' || chr(9) || chr(10)), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(9) || chr(10))), lambda x: x <> '') AS s FROM documents)
SELECT doc_id, len(s)::INT AS n_sentences, s[1] AS first_sentence, s[len(s)] AS last_sentence FROM s""")
def sentence_split(spark, sf_dir):
    s = X.sentences(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(s).alias("n_sentences"), F.get(s, 0).alias("first_sentence"), F.get(s, F.size(s) - 1).alias("last_sentence"))


BLANKS = "' ' || chr(9) || chr(10) || chr(13)"
CHUNKS = rf"""
RECURSIVE d AS (SELECT doc_id, trim(coalesce(text, ''), {BLANKS}) AS whole FROM documents),
s AS (SELECT doc_id, whole, len(regexp_extract_all(whole, '\S+')) AS total, list_filter(list_transform(string_split(regexp_replace(whole, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, {BLANKS})), lambda x: x <> '') AS s FROM d),
n AS (SELECT doc_id, i, len(regexp_extract_all(t, '\S+')) AS n FROM (SELECT doc_id, unnest(s) AS t, generate_subscripts(s, 1) AS i FROM s WHERE total > 64)),
c AS (SELECT doc_id, list(n ORDER BY i) AS n, list(upto ORDER BY i) AS upto FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS upto FROM n) GROUP BY doc_id),
runs AS (
  SELECT doc_id, 0::BIGINT AS a, 0::BIGINT AS b FROM c
  UNION ALL
  SELECT r.doc_id, r.b + 1, CASE WHEN c.n[r.b + 1] > 64 THEN r.b + 1 ELSE r.b + len(list_filter(c.upto[r.b + 1:], lambda x: x - coalesce(c.upto[r.b], 0) <= 64)) END
  FROM runs r JOIN c USING (doc_id) WHERE r.b < len(c.n)
),
pieces AS (
  SELECT r.doc_id, r.a, 0 AS k, array_to_string(s.s[r.a:r.b], ' ') AS t FROM runs r JOIN s USING (doc_id) JOIN c USING (doc_id) WHERE r.a > 0 AND c.n[r.a] <= 64
  UNION ALL
  SELECT doc_id, a, k, array_to_string(w[k * 64 + 1:(k + 1) * 64], ' ') FROM (SELECT r.doc_id, r.a, regexp_extract_all(s.s[r.a], '\S+') AS w, unnest(range(0, (c.n[r.a] + 63) // 64)) AS k
    FROM runs r JOIN s USING (doc_id) JOIN c USING (doc_id) WHERE r.a > 0 AND c.n[r.a] > 64)
  UNION ALL
  SELECT doc_id, 0, 0, whole FROM s WHERE total <= 64 AND whole <> ''
)
"""


@query(rf"""WITH {CHUNKS} SELECT doc_id AS transcript_id, 0 AS segment_id, t AS chunk_text, row_number() OVER w AS chunk_order, len(regexp_extract_all(t, '\S+'))::BIGINT AS chunk_token_count,
 doc_id || '_0_' || row_number() OVER w AS chunk_id FROM pieces WINDOW w AS (PARTITION BY doc_id ORDER BY a, k)""")
def chunk_pack(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("transcript_id"), F.lit(0).alias("segment_id"), F.col("text").alias("content"))
    return tone.chunks(d, 64)


@query(r"SELECT doc_id, (len(regexp_extract_all(text, '\S+')))::BIGINT AS n_tokens FROM documents")
def chunk_tokens_conserved(spark, sf_dir):
    """Packing loses and makes no token: chunks' counts add up to the document's."""
    return chunk_pack(spark, sf_dir).groupBy(F.col("transcript_id").alias("doc_id")).agg(F.sum("chunk_token_count").alias("n_tokens"))


@query("SELECT DISTINCT text, lang FROM documents")
def merge_dedup(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("text", "lang")
    return relate.distinct_rows(d, d)


def dated_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    day = F.element_at(F.array(*[F.lit(d) for d in ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")]), F.weekday("o_orderdate") + 1)
    return o.select("o_orderkey", F.concat(day, F.date_format("o_orderdate", "', 'MMMM dd, yyyy' 10:30 AM'")).alias("subheader"))


@query("""WITH r AS (SELECT o_orderkey, strftime(o_orderdate, '%A, %B %d, %Y 10:30 AM') AS subheader FROM orders UNION ALL SELECT o_orderkey, strftime(o_orderdate, '%A, %B %d, %Y 10:30 AM') FROM orders WHERE o_orderkey % 10 = 0)
SELECT DISTINCT o_orderkey, subheader FROM r""")
def merge_sorted(spark, sf_dir):
    raw = dated_orders(spark, sf_dir)
    return merge_raw(raw.unionByName(raw.filter("o_orderkey % 10 = 0")).unionByName(raw.limit(1).withColumn("subheader", F.lit("no date"))))


@query("""SELECT count(*) + 2 * count(*) FILTER (WHERE o_orderkey % 10 = 0) AS n_source, count(*) + count(*) FILTER (WHERE o_orderkey % 10 = 0) AS n_clean, count(*) FILTER (WHERE o_orderkey % 10 = 0) AS n_unparsed,
 count(*) FILTER (WHERE o_orderkey % 10 = 0) AS n_duplicates, count(*) AS n_merged, min(o_orderdate::DATE) + INTERVAL '630 minutes' AS first_date, max(o_orderdate::DATE) + INTERVAL '630 minutes' AS last_date FROM orders""")
def merge_accounting(spark, sf_dir):
    """All orders as dated rows, a tenth of them twice and a tenth once more without a date."""
    raw = dated_orders(spark, sf_dir)
    some = raw.filter("o_orderkey % 10 = 0")
    out = merge_report(raw.unionByName(some).unionByName(some.withColumn("subheader", F.lit("no date"))))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_date", "last_date")})


@query("SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text")
def dedup_first(spark, sf_dir):
    return relate.first_of(table(spark, sf_dir, "documents").select("doc_id", "text"), ["text"], ["doc_id"])


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark, sf_dir):
    said = F.concat(F.lit("Answer: "), F.col("props"), F.lit(" end"))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(X.json_part(said), "$.k").cast("bigint").alias("k"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' WHEN 2 THEN 'neutral' END AS label FROM events")
def label_normalize(spark, sf_dir):
    said = F.element_at(F.array(*map(F.lit, (" POS ", "Negative", "neu", "meh"))), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", X.label(said).alias("label"))


@query("SELECT vec_id, list_position(l, list_max(l)) - 1 AS argmax, round(exp(l[1] - list_max(l)) / list_sum(list_transform(l, lambda x: exp(x - list_max(l)))), 6) AS p0 FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS l FROM embeddings)")
def softmax_argmax(spark, sf_dir):
    v = F.transform("embedding", lambda x: x.cast("double"))
    out = table(spark, sf_dir, "embeddings").withColumn("l", v)
    return out.select("vec_id", N.argmax(F.col("l")).cast("long").alias("argmax"), F.round(N.softmax(F.col("l"))[0], 6).alias("p0"))


@query("""WITH e AS (SELECT min(o_orderdate::DATE) AS a, max(o_orderdate::DATE) AS b FROM orders), w AS (SELECT a + (30 * k)::INTEGER AS s, least(b, a + (30 * k + 29)::INTEGER) AS t FROM e, range(0, (date_diff('day', a, b) // 30) + 1) r(k))
SELECT s AS "start", t AS "end", count(o_orderkey) AS n FROM w LEFT JOIN orders ON o_orderdate::DATE BETWEEN s AND t GROUP BY s, t""")
def date_windows(spark, sf_dir):
    """Windows of 30 days over all orders, and the orders of each."""
    dates = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d"))
    ends = dates.agg(F.min("d").alias("a"), F.max("d").alias("b")).first()
    windows = readers.date_windows(spark, str(ends["a"]), str(ends["b"]), 30)
    first = F.date_add(F.lit(ends["a"]), (F.floor(F.datediff("d", F.lit(ends["a"])) / 30) * 30).cast("int"))
    counts = dates.groupBy(first.alias("start")).agg(F.count("*").alias("n"))
    return windows.join(counts, "start", "left").select("start", "end", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


# Panels and events

def suppliers(spark: SparkSession, sf_dir: str) -> Column:
    """The number of suppliers, as a one-row scalar read."""
    return F.lit(table(spark, sf_dir, "supplier").count())


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.groupBy(F.col("l_suppkey").alias("ticker_norm"), F.to_date("l_shipdate").alias("date")).agg(
        (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"), F.sum("l_quantity").alias("volume"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as calls."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("call_id"), (F.col("o_custkey") % suppliers(spark, sf_dir)).alias("ticker_norm"), F.to_date("o_orderdate").alias("call_date"))


def caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy((F.col("o_custkey") % suppliers(spark, sf_dir)).alias("ticker_norm"), F.to_date("o_orderdate").alias("date")).agg(F.max("o_totalprice").alias("marketCap"))


def earnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("ticker_norm").orderBy("date")
    c = caps(spark, sf_dir)
    return c.select("ticker_norm", "date", (F.lag("marketCap").over(w) / 1000).alias("epsEstimated"), (F.col("marketCap") / 1000).alias("epsActual"),
                    (F.lag("marketCap").over(w) * 10).alias("revenueEstimated"), (F.col("marketCap") * 10).alias("revenueActual"))


PANEL = """
panel AS (SELECT l_suppkey AS ticker_norm, l_shipdate::DATE AS date, sum(l_extendedprice) / sum(l_quantity) AS close, sum(l_quantity) AS volume FROM lineitem GROUP BY ALL),
calls AS (SELECT o_orderkey AS call_id, o_custkey % (SELECT count(*) FROM supplier) AS ticker_norm, o_orderdate::DATE AS call_date FROM orders),
caps AS (SELECT o_custkey % (SELECT count(*) FROM supplier) AS ticker_norm, o_orderdate::DATE AS date, max(o_totalprice) AS marketCap FROM orders GROUP BY ALL),
ret AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY ticker_norm ORDER BY date)) AS ret FROM panel),
frames AS (SELECT *, CASE WHEN count(ret) OVER b >= 60 THEN avg(ret) OVER b END AS m, lag(ret) OVER w AS r0, lead(ret) OVER w AS r2,
   stddev_pop(ret) OVER (PARTITION BY ticker_norm ORDER BY date ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS vol5,
   avg(volume) OVER (PARTITION BY ticker_norm ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS v20,
   avg(volume) OVER (PARTITION BY ticker_norm ORDER BY date ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS v01
   FROM ret WINDOW w AS (PARTITION BY ticker_norm ORDER BY date), b AS (PARTITION BY ticker_norm ORDER BY date ROWS BETWEEN 250 PRECEDING AND 50 PRECEDING)),
features AS (SELECT *, CASE WHEN m IS NOT NULL AND coalesce(r0, ret, r2) IS NOT NULL THEN coalesce(r0 - m, 0) + coalesce(ret - m, 0) + coalesce(r2 - m, 0) END AS car, v01 / nullif(v20, 0) AS abvol FROM frames),
market AS (SELECT c.*, f.date AS event_date, f.car AS CAR_m1_p1, f.vol5 AS Volatility_0_p5, f.v20 AS AvgVolume_m20_m1, f.v01 AS AvgVolume_0_p1, f.abvol AS AbVol_0_p1
   FROM calls c ASOF LEFT JOIN features f ON c.ticker_norm = f.ticker_norm AND c.call_date <= f.date)
"""


@query(f"WITH {PANEL} SELECT call_id, ticker_norm, call_date, event_date FROM market")
def event_forward_asof(spark, sf_dir):
    return events.with_market(calls(spark, sf_dir), panel(spark, sf_dir)).select("call_id", "ticker_norm", "call_date", "event_date")


@query(f"WITH {PANEL} SELECT call_id, round(CAR_m1_p1, 6) AS CAR_m1_p1, round(Volatility_0_p5, 6) AS Volatility_0_p5, round(AvgVolume_m20_m1, 6) AS AvgVolume_m20_m1, round(AvgVolume_0_p1, 6) AS AvgVolume_0_p1, round(AbVol_0_p1, 6) AS AbVol_0_p1 FROM market")
def event_features(spark, sf_dir):
    return rounded(events.with_market(calls(spark, sf_dir), panel(spark, sf_dir)).select("call_id", *events.MARKET), *events.MARKET)


@query(f"WITH {PANEL} SELECT call_id, marketCap, round(ln(marketCap), 6) AS log_marketCap FROM calls c ASOF LEFT JOIN caps p ON c.ticker_norm = p.ticker_norm AND c.call_date >= p.date")
def marketcap_asof(spark, sf_dir):
    return rounded(events.with_marketcap(calls(spark, sf_dir), caps(spark, sf_dir)).select("call_id", "marketCap", "log_marketCap"), "log_marketCap")


@query(f"WITH {PANEL} SELECT call_id, p.date AS cap_date, marketCap FROM calls c ASOF LEFT JOIN caps p ON c.ticker_norm = p.ticker_norm AND c.call_date >= p.date")
def panel_store_asof(spark, sf_dir):
    """Market caps from a store of panels, bucketed by ticker and span; the store stays in the warehouse."""
    asked = calls(spark, sf_dir)
    last = asked.agg(F.max("call_date")).first()[0]
    store = PanelStore.build(caps(spark, sf_dir), last)
    return store.lookup(asked, "ticker_norm", "call_date").select("call_id", F.col("match._at").alias("cap_date"), F.col("match.marketCap").alias("marketCap"))


EARN = """
earn AS (SELECT ticker_norm, date, lag(marketCap) OVER w / 1000 AS epsEstimated, marketCap / 1000 AS epsActual, lag(marketCap) OVER w * 10 AS revenueEstimated, marketCap * 10 AS revenueActual
   FROM caps WINDOW w AS (PARTITION BY ticker_norm ORDER BY date)),
earned AS (SELECT c.call_id, CASE WHEN ok THEN date END AS earnings_date, CASE WHEN ok AND abs(epsEstimated) >= 0.01 THEN (epsActual - epsEstimated) / abs(epsEstimated) END AS eps_surprise,
   CASE WHEN ok AND abs(revenueEstimated) >= 1e6 THEN (revenueActual - revenueEstimated) / abs(revenueEstimated) END AS revenue_surprise
   FROM (SELECT c.*, e.* EXCLUDE (ticker_norm), date_diff('day', e.date, c.call_date) <= 30 AS ok FROM calls c ASOF LEFT JOIN earn e ON c.ticker_norm = e.ticker_norm AND c.call_date >= e.date) c)
"""


@query(f"WITH {PANEL}, {EARN} SELECT call_id, earnings_date, round(eps_surprise, 6) AS eps_surprise, round(revenue_surprise, 6) AS revenue_surprise FROM earned")
def earnings_asof_tol(spark, sf_dir):
    out = events.with_earnings(calls(spark, sf_dir), earnings(spark, sf_dir))
    return rounded(out.select("call_id", "earnings_date", "eps_surprise", "revenue_surprise"), "eps_surprise", "revenue_surprise")


@query("WITH q AS (SELECT quantile_cont(o_totalprice, 0.01) AS a, quantile_cont(o_totalprice, 0.99) AS b FROM orders) SELECT o_orderkey, round(least(greatest(o_totalprice, a), b), 6) AS price FROM orders, q")
def winsorize(spark, sf_dir):
    out = events.winsorized(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("price")), ["price"])
    return rounded(out, "price")


PREP = f"""{PANEL}, {EARN},
joined AS (SELECT m.*, e.eps_surprise, e.revenue_surprise, ln(p.marketCap) AS log_marketCap FROM market m JOIN earned e USING (call_id)
   JOIN (SELECT call_id, marketCap FROM calls c ASOF LEFT JOIN caps p ON c.ticker_norm = p.ticker_norm AND c.call_date >= p.date) p USING (call_id)),
q AS (SELECT {", ".join(f"quantile_cont({c}, 0.01) AS {c}_a, quantile_cont({c}, 0.99) AS {c}_b" for c in events.WINSORIZED)} FROM joined)
"""


def joined_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.with_outcomes(calls(spark, sf_dir), panel(spark, sf_dir), caps(spark, sf_dir), earnings(spark, sf_dir))


@query(f"""WITH {PREP} SELECT call_id, year(call_date) || 'Q' || quarter(call_date) AS year_quarter, {", ".join(f"round(CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, {c}_a), {c}_b) END, 6) AS {c}" for c in events.WINSORIZED)},
 round(CASE WHEN AvgVolume_m20_m1 > 0 THEN ln(AvgVolume_m20_m1) END, 6) AS log_AvgVolume_m20_m1, round(log_marketCap, 6) AS log_marketCap
FROM joined, q WHERE CAR_m1_p1 IS NOT NULL AND eps_surprise IS NOT NULL AND revenue_surprise IS NOT NULL AND log_marketCap IS NOT NULL AND AvgVolume_m20_m1 IS NOT NULL""")
def regression_prep(spark, sf_dir):
    path = work_folder(spark, "calls")
    joined_calls(spark, sf_dir).select("call_id", "call_date", *events.WINSORIZED, "AvgVolume_m20_m1", "log_marketCap").write.parquet(path)  # the cuts of ``prepared`` read it again
    out = events.regression_sample(events.prepared(spark.read.parquet(path)))
    cols = [*events.WINSORIZED, "log_AvgVolume_m20_m1", "log_marketCap"]
    return rounded(out.select("call_id", "year_quarter", *cols), *cols)


#: Outcomes that a regression needs, and their cuts.
OUTCOMES = ("CAR_m1_p1", "eps_surprise", "revenue_surprise", "AvgVolume_m20_m1", "log_marketCap")


def regression_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All calls with those market outcomes and tone features of the transcript that stands for each call which the specifications need."""
    n = table(spark, sf_dir, "conversations").agg(F.count_distinct("conv_id")).first()[0]
    tone_ = tone.transcript_features(tone.segment_scores(scored(spark, sf_dir)))
    measures = [c for c in tone_.columns if c in econ.measures() or c == "n_tokens_qa"]
    out = events.chosen_outcomes(calls(spark, sf_dir), panel(spark, sf_dir), caps(spark, sf_dir), earnings(spark, sf_dir), OUTCOMES, kept)
    out = out.withColumn("transcript_id", (F.col("call_id") / 50).cast("long") % n)
    out = out.join(tone_.select("transcript_id", *measures), "transcript_id", "left").drop("transcript_id")
    return events.prepared(kept(out, "calls"))  # the cuts of ``prepared`` read it again


@query()
def regression_specs(spark, sf_dir):
    """All specifications, the progressive ones and the Wald test."""
    from ..functions.numeric import stars

    rows = econ.all_specs(regression_data(spark, sf_dir))
    out = spark.createDataFrame(rows, "spec string, variable string, coef double, se double, p double, n long, r2 double")
    return out.withColumn("stars", stars(F.col("p")))


SIMPLE = """
x AS (SELECT l_suppkey AS g, l_quantity AS x, l_extendedprice AS y FROM lineitem),
b AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_r2(y, x) AS r2, avg(x) AS mx, count(*) AS n, regr_sxx(y, x) AS sxx FROM x),
e AS (SELECT g, x - mx AS d, y - a - b.b * x AS e FROM x, b)
"""


@query(f"""WITH {SIMPLE} SELECT 'classical' AS kind, round(b.b, 4) AS slope, round(r2, 6) AS r2, round(sqrt((SELECT sum(e * e) FROM e) / (n - 2) / sxx), 4) AS se FROM b
UNION ALL SELECT 'hc1', round(b.b, 4), round(r2, 6), round(sqrt((SELECT sum(d * d * e * e) FROM e) * n / (n - 2)) / sxx, 4) FROM b
UNION ALL SELECT 'cluster', round(b.b, 4), round(r2, 6), round(sqrt((SELECT sum(s * s) * count(*) / (count(*) - 1) FROM (SELECT sum(d * e) AS s FROM e GROUP BY g)) * (n - 1) / (n - 2)) / sxx, 4) FROM b""")
def ols_covariances(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("g"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    kinds = ("classical", "hc1", "cluster")
    fits = econ.fit_all(df, [econ.Model(kind, "y", ("x",), (), kind, "g" if kind == "cluster" else None) for kind in kinds])
    rows = [(kind, float(fit.params[1]), float(fit.r2), float(fit.errors[1])) for kind, fit in zip(kinds, fits)]
    out = spark.createDataFrame(rows, "kind string, slope double, r2 double, se double")
    return out.select("kind", F.round("slope", 4).alias("slope"), F.round("r2", 6).alias("r2"), F.round("se", 4).alias("se"))


# Descriptive tables

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount"]
ORDER_EDGES = "edges AS (SELECT list_distinct(quantile_cont(o_totalprice, {q})) AS e FROM orders)"


def _bins(k: int) -> str:
    q = "[" + ", ".join(str(i / k) for i in range(k + 1)) + "]"
    return f"""WITH c AS (SELECT list_sort(list_distinct(quantile_cont(o_totalprice, {q}))) AS e FROM orders),
 r AS (SELECT o_totalprice AS x, o_orderkey % 97 AS v, len(list_filter(e[2:len(e) - 1], lambda q: q < o_totalprice)) + 1 AS bin FROM orders, c)
 SELECT bin::INT AS bin, round(avg(x), 4) AS mean_x, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, count(*) AS n, round(stddev_samp(v) / sqrt(count(*)), 6) AS se, round(1.96 * stddev_samp(v) / sqrt(count(*)), 6) AS ci95 FROM r GROUP BY bin"""


def _bin_query(spark, sf_dir, k: int) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("x"), (F.col("o_orderkey") % 97).alias("v"))
    out = describe.bin_table(o, "x", "v", k).withColumn("mean_x", F.round("mean_x", 4))
    return rounded(out, "mean", "std", "se", "ci95")


@query(_bins(5))
def qcut5(spark, sf_dir):
    return _bin_query(spark, sf_dir, 5)


@query(_bins(10))
def qcut10(spark, sf_dir):
    return _bin_query(spark, sf_dir, 10)


@query("WITH s AS (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b FROM orders) SELECT least(floor((o_totalprice - a) * 50 / (b - a)), 49)::INT AS bin, count(*) AS n FROM orders, s GROUP BY 1")
def histogram50(spark, sf_dir):
    return describe.histogram(table(spark, sf_dir, "orders"), "o_totalprice")


@query("""WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.5) AS m, quantile_cont(l_extendedprice, 0.75) AS b FROM lineitem)
SELECT round(any_value(a), 6) AS q1, round(any_value(m), 6) AS median, round(any_value(b), 6) AS q3, min(l_extendedprice) FILTER (WHERE l_extendedprice >= a - 1.5 * (b - a)) AS low,
 max(l_extendedprice) FILTER (WHERE l_extendedprice <= b + 1.5 * (b - a)) AS high, count(*) FILTER (WHERE l_extendedprice < a - 1.5 * (b - a) OR l_extendedprice > b + 1.5 * (b - a)) AS outside FROM lineitem, q""")
def boxplot_stats(spark, sf_dir):
    return rounded(describe.box(table(spark, sf_dir, "lineitem"), "l_extendedprice"), "q1", "median", "q3")


def _per_column(template: str, joiner: str = " UNION ALL ") -> str:
    return joiner.join(template.format(c=c) for c in NUMBERS)


@query(_per_column("SELECT '{c}' AS variable, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS min, quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50, quantile_cont({c}, 0.75) AS p75, max({c}) AS max FROM lineitem"))
def describe_numbers(spark, sf_dir):
    return rounded(describe.summary(table(spark, sf_dir, "lineitem"), NUMBERS), "mean", "std")


@query(" UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) AS r FROM lineitem" for a in NUMBERS for b in NUMBERS))
def corr_matrix(spark, sf_dir):
    return rounded(describe.correlations(table(spark, sf_dir, "lineitem"), NUMBERS), "r")


@query(_per_column("SELECT '{c}' AS measure, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS min, quantile_cont({c}, 0.5) AS median, max({c}) AS max, round(corr({c}, l_quantity), 6) AS corr FROM lineitem"))
def measure_compare(spark, sf_dir):
    return rounded(describe.measure_comparison(table(spark, sf_dir, "lineitem"), NUMBERS, "l_quantity"), "mean", "std", "corr")


@query("""WITH f AS (SELECT o_custkey, count(DISTINCT year(o_orderdate) || 'Q' || quarter(o_orderdate)) AS q, count(*) AS r FROM orders GROUP BY 1)
SELECT sum(r)::BIGINT AS n_rows, count(*) AS n_firms, round(avg(q), 6) AS mean_quarters, quantile_cont(q, 0.5) AS median_quarters, min(q) AS min_quarters, max(q) AS max_quarters,
 (SELECT count(DISTINCT year(o_orderdate) || 'Q' || quarter(o_orderdate)) FROM orders) AS n_quarters FROM f""")
def sample_overview(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("q", N.quarter_label(F.col("o_orderdate")))
    return rounded(describe.sample_overview(o, "o_custkey", "q"), "mean_quarters")


FIRMS = "f AS (SELECT o_custkey, count(DISTINCT year(o_orderdate) || 'Q' || quarter(o_orderdate)) AS q FROM orders GROUP BY 1)"


@query(f"""WITH {FIRMS} SELECT 'Observations' AS statistic, count(*)::VARCHAR AS value FROM orders UNION ALL SELECT 'Unique firms', count(DISTINCT o_custkey)::VARCHAR FROM orders
UNION ALL SELECT 'Unique earnings calls', count(DISTINCT o_orderkey)::VARCHAR FROM orders UNION ALL SELECT 'Unique year-quarter', count(DISTINCT year(o_orderdate) || 'Q' || quarter(o_orderdate))::VARCHAR FROM orders
UNION ALL SELECT 'Start date', min(o_orderdate)::DATE::VARCHAR FROM orders UNION ALL SELECT 'End date', max(o_orderdate)::DATE::VARCHAR FROM orders
UNION ALL SELECT 'Mean quarters per firm', printf('%.2f', avg(q)) FROM f UNION ALL SELECT 'Median quarters per firm', printf('%.2f', quantile_cont(q, 0.5)) FROM f""")
def overview_table(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("q", N.quarter_label(F.col("o_orderdate")))
    return describe.overview(o, "o_custkey", "o_orderkey", "q", "o_orderdate")


@query(f"""WITH {FIRMS} SELECT count(*) AS n_firms, round(avg(q), 6) AS mean_quarters, round(stddev_samp(q), 6) AS std_quarters, min(q) AS min_quarters, quantile_cont(q, 0.25) AS p25_quarters, quantile_cont(q, 0.5) AS median_quarters,
 quantile_cont(q, 0.75) AS p75_quarters, max(q) AS max_quarters FROM f""")
def firm_quarters(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("q", N.quarter_label(F.col("o_orderdate")))
    return rounded(describe.firm_quarters(o, "o_custkey", "q"), "mean_quarters", "std_quarters")


@query("SELECT count(*) AS n_firms, count(*) FILTER (WHERE has) AS n_with_ticker FROM (SELECT o_custkey, max(o_orderstatus = 'F') AS has FROM orders GROUP BY 1)")
def firm_coverage(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("t", F.when(F.col("o_orderstatus") == "F", "F"))
    return describe.firm_coverage(o, "o_custkey", "t")


@query("SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY event_type")
def distribution(spark, sf_dir):
    return rounded(describe.distribution(table(spark, sf_dir, "events"), "event_type"), "share")


@query("SELECT count(*) AS n_rows, count(o_totalprice) AS n_o_totalprice, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS n_filled FROM orders")
def non_null_counts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("filled", F.when(F.col("o_orderstatus") == "F", 1))
    return describe.non_null(o, ["o_totalprice", "filled"])


@query("SELECT year(o_orderdate) || 'Q' || quarter(o_orderdate) AS year_quarter, round(avg(o_totalprice), 4) AS mean, count(*) AS n FROM orders GROUP BY 1")
def quarter_series(spark, sf_dir):
    return rounded(describe.quarter_series(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice"), "mean", digits=4)


@query("WITH q AS (SELECT DISTINCT year(o_orderdate) || 'Q' || quarter(o_orderdate) AS q FROM orders), r AS (SELECT q, row_number() OVER (ORDER BY q) - 1 AS i FROM q) SELECT q[1:4] AS year, min(i) AS tick FROM r GROUP BY 1")
def year_ticks(spark, sf_dir):
    return describe.year_ticks(describe.quarter_series(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice")).withColumn("tick", F.col("tick").cast("long"))


# Samples, splits and measures

@query(f"""WITH {SPOKEN}, g AS (SELECT transcript_id, row_number() OVER (ORDER BY transcript_id % 30, transcript_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT transcript_id FROM spoken)),
 c AS (SELECT *, round_even(n * 0.7::DOUBLE, 0) AS a, round_even(n * 0.7::DOUBLE, 0) + round_even(n * 0.15::DOUBLE, 0) AS b FROM g)
SELECT s.transcript_id, s.segment_id, CASE WHEN r <= a THEN 'train' WHEN r <= b THEN 'valid' ELSE 'test' END AS split FROM spoken s JOIN c USING (transcript_id)""")
def group_split(spark, sf_dir):
    s = spoken(spark, sf_dir).withColumn("d", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("transcript_id") % 30).cast("int")))
    return sampling.with_split(s, "transcript_id", "d").select("transcript_id", "segment_id", "split")


HASH_SQL = "md5('42:' || chunk_id)"


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    return s.select(F.concat_ws("_", "transcript_id", "segment_id").alias("chunk_id"), "section", F.round("neg_score", 6).alias("teacher"))


POOL = SCORED + ", pool AS (SELECT transcript_id || '_' || segment_id AS chunk_id, section, round(neg_score, 6) AS teacher FROM scored)"


@query(f"WITH {POOL} SELECT * FROM (SELECT * FROM pool ORDER BY {HASH_SQL}, chunk_id LIMIT 50)")
def uniform_k(spark, sf_dir):
    return sampling.uniform(pool(spark, sf_dir), 50, "chunk_id")


@query(f"WITH {POOL}, a AS (SELECT * FROM pool ORDER BY teacher, chunk_id LIMIT 20), b AS (SELECT * FROM pool ORDER BY teacher DESC, chunk_id LIMIT 20) SELECT * FROM a UNION SELECT * FROM b")
def sample_extremes(spark, sf_dir):
    return sampling.extremes(pool(spark, sf_dir), 40, "teacher", "chunk_id")


def _stratified_parts(n: int, rows: str, score: str) -> str:
    """base: what the sections give; rest: all others in their order."""
    parts, sizes = [], {k: int(n * w) for k, w in sampling.WEIGHTS.items()}
    for s, size in sizes.items():
        e = round(size * 0.3)
        lo, hi = e // 2, e - e // 2
        of = f"FROM {rows} WHERE section = '{s}'"
        parts.append(f"""{s}_l AS (SELECT chunk_id {of} AND {score} IS NOT NULL ORDER BY {score}, chunk_id LIMIT {lo}), {s}_h AS (SELECT chunk_id {of} AND {score} IS NOT NULL ORDER BY {score} DESC, chunk_id LIMIT {hi}),
 {s}_e AS (SELECT chunk_id FROM {s}_l UNION SELECT chunk_id FROM {s}_h), {s}_u AS (SELECT chunk_id {of} AND chunk_id NOT IN (SELECT chunk_id FROM {s}_e) ORDER BY {HASH_SQL}, chunk_id LIMIT {size - e})""")
    union = " UNION ".join(f"SELECT chunk_id FROM {s}_{k}" for s in sizes for k in "eu")
    return f"""{", ".join(parts)}, base AS ({union}),
 rest AS (SELECT chunk_id, row_number() OVER (ORDER BY {HASH_SQL}, chunk_id) AS r FROM {rows} WHERE chunk_id NOT IN (SELECT chunk_id FROM base))"""


_STRATIFIED_KEEP = "WHERE chunk_id IN (SELECT chunk_id FROM base) OR chunk_id IN (SELECT chunk_id FROM rest WHERE r <= {n} - (SELECT count(*) FROM base))"


@query(f"WITH {POOL}, {_stratified_parts(100, 'pool', 'teacher')} SELECT * FROM pool {_STRATIFIED_KEEP.format(n=100)}")
def stratified_sample(spark, sf_dir):
    return sampling.stratified(pool(spark, sf_dir), 100, "chunk_id", score="teacher")


def chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as chunks, with a date and the columns of a chunk table."""
    s = spoken(spark, sf_dir)
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("transcript_id") % 30).cast("int"))
    return s.select(
        F.concat_ws("_", "transcript_id", "segment_id").alias("chunk_id"), "transcript_id", "segment_id", F.lit(1).alias("chunk_order"), day.cast("string").alias("date"),
        "speaker_role", "section", F.concat(F.lit(" "), F.col("content")).alias("chunk_text"), X.token_count(F.col("content")).alias("chunk_token_count"), F.lit(0).alias("unknown"),
    )


PREPARED = SCORED + r"""
, prepared AS (SELECT transcript_id || '_' || segment_id AS chunk_id, transcript_id, segment_id, 1 AS chunk_order, (DATE '2024-01-01' + (transcript_id % 30)::INT)::TIMESTAMP AS date, speaker_role, section,
   trim(content, ' ' || chr(9) || chr(10) || chr(13)) AS chunk_text, len(regexp_extract_all(content, '\S+'))::INT AS chunk_token_count FROM spoken
   WHERE section <> 'O' AND len(regexp_extract_all(content, '\S+')) BETWEEN 15 AND 256),
taught AS (SELECT p.*, round(p_negative, 6) AS p_negative, round(p_positive, 6) AS p_positive, pred_label, round(p_negative, 6) - round(p_positive, 6) AS teacher_neg_score
   FROM prepared p LEFT JOIN (SELECT * FROM scored WHERE pred_label <> 'neutral') s ON p.chunk_id = s.transcript_id || '_' || s.segment_id)
"""


def teacher(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A teacher's scores, without neg_score and without the chunks it finds neutral."""
    s = rounded(scored(spark, sf_dir), "p_negative", "p_positive").filter("pred_label <> 'neutral'")
    return s.select(F.concat_ws("_", "transcript_id", "segment_id").alias("chunk_id"), "p_negative", "p_positive", "pred_label", F.lit(1).alias("other"))


@query(f"WITH {PREPARED} SELECT chunk_id, transcript_id, segment_id, chunk_order, date, speaker_role, section, chunk_text, chunk_token_count FROM prepared ORDER BY date, transcript_id, segment_id, chunk_order")
def annotation_prepare(spark, sf_dir):
    out = annotation.sorted_chunks(annotation.prepared(chunk_rows(spark, sf_dir)))
    return out.withColumn("date", F.col("date").cast("timestamp_ntz"))


@query(f"WITH {PREPARED} SELECT chunk_id, p_negative, p_positive, pred_label, round(teacher_neg_score, 6) AS teacher_neg_score FROM taught")
def teacher_scores(spark, sf_dir):
    out = annotation.with_teacher(annotation.prepared(chunk_rows(spark, sf_dir)), teacher(spark, sf_dir))
    return rounded(out.select("chunk_id", "p_negative", "p_positive", "pred_label", "teacher_neg_score"), "teacher_neg_score")


@query(f"WITH {PREPARED}, {_stratified_parts(60, 'taught', 'teacher_neg_score')} SELECT chunk_id, section, round(teacher_neg_score, 6) AS teacher_neg_score, NULL AS label, 'pending' AS label_status FROM taught {_STRATIFIED_KEEP.format(n=60)}")
def annotation_sample(spark, sf_dir):
    out = annotation.annotation_sample(chunk_rows(spark, sf_dir), teacher(spark, sf_dir), 60)
    return rounded(out.select("chunk_id", "section", "teacher_neg_score", "label", "label_status"), "teacher_neg_score")


_LABELLED = PREPARED + """
, asked AS (SELECT *, length('Classify the following earnings-call chunk.' || chr(10) || chr(10) || 'Company: ' || chr(10) || 'Ticker: ' || chr(10) || 'Date: 2024-01-01 00:00:00' || chr(10) || 'Section: ' || section || chr(10)
   || 'Speaker: ' || chr(10) || 'Speaker role: ' || speaker_role || chr(10) || chr(10) || 'Chunk:' || chr(10) || chunk_text || chr(10) || chr(10)
   || 'Return valid JSON only with this exact schema: {"label":"negative|neutral|positive","reason":"short explanation"}') AS n FROM (SELECT * FROM prepared ORDER BY date, transcript_id, segment_id, chunk_order@LIMIT@)),
labelled AS (SELECT chunk_id, transcript_id, date, chunk_text, ['positive', 'neutral', 'negative', NULL][n % 4 + 1] AS label, CASE WHEN n % 4 < 3 THEN 'length ' || n END AS label_reason,
   CASE WHEN n % 4 = 3 THEN 'failed' ELSE 'ok' END AS label_status, CASE WHEN n % 4 = 3 THEN 3 ELSE 1 END AS attempts FROM asked)
"""
LABELLED, ALL_LABELLED = _LABELLED.replace("@LIMIT@", " LIMIT 200"), _LABELLED.replace("@LIMIT@", "")


def labelled(spark: SparkSession, sf_dir: str, max_rows: int | None = None) -> DataFrame:
    """All prepared chunks, or the first ones in reading order, labelled and joined back."""
    return annotation.labelled(annotation.prepared(chunk_rows(spark, sf_dir)), stand_in_answer, "stand-in", max_rows=max_rows)


@query(f"WITH {LABELLED} SELECT chunk_id, transcript_id, label, label_reason, 'llm' AS label_source, 'stand-in' AS llm_model, label_status, attempts, label IS NULL AS has_error FROM labelled")
def label_dataset(spark, sf_dir):
    """The first 200 chunks: the limit is what a run of the labeller is given."""
    return labelled(spark, sf_dir, 200).select("chunk_id", "transcript_id", "label", "label_reason", "label_source", "llm_model", "label_status", "attempts", F.col("error").isNotNull().alias("has_error"))


@query(f"WITH {ALL_LABELLED} SELECT count(*) AS n_rows, count(*) FILTER (WHERE label_status = 'ok') AS n_ok, count(*) FILTER (WHERE label_status = 'failed') AS n_failed, 0 AS n_pending FROM labelled")
def label_status_counts(spark, sf_dir):
    return annotation.status_counts(labelled(spark, sf_dir))


@query(f"""WITH {ALL_LABELLED}, usable AS (SELECT * FROM labelled WHERE label IS NOT NULL), g AS (SELECT transcript_id, row_number() OVER (ORDER BY date, transcript_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT transcript_id, date FROM usable)),
 c AS (SELECT *, round_even(n * 0.7::DOUBLE, 0) AS a, round_even(n * 0.7::DOUBLE, 0) + round_even(n * 0.15::DOUBLE, 0) AS b FROM g)
SELECT chunk_id, transcript_id, label, CASE label WHEN 'neutral' THEN 0 WHEN 'positive' THEN 1 ELSE 2 END AS labels, CASE WHEN r <= a THEN 'train' WHEN r <= b THEN 'valid' ELSE 'test' END AS split FROM usable JOIN c USING (transcript_id)""")
def train_ready(spark, sf_dir):
    return annotation.train_ready(labelled(spark, sf_dir)).select("chunk_id", "transcript_id", "label", "labels", "split")


@query("""WITH p AS (SELECT quality AS t, toxic AS g FROM labels), c AS (SELECT DISTINCT t AS c FROM p UNION SELECT DISTINCT g FROM p),
 k AS (SELECT c, (SELECT count(*) FROM p WHERE t = c AND g = c) AS hit, (SELECT count(*) FROM p WHERE t = c) AS i, (SELECT count(*) FROM p WHERE g = c) AS s FROM c)
SELECT round(sum(hit) / sum(i)::DOUBLE, 6) AS accuracy, round(avg(coalesce(hit / nullif(s, 0)::DOUBLE, 0)), 6) AS macro_precision, round(avg(coalesce(hit / nullif(i, 0)::DOUBLE, 0)), 6) AS macro_recall,
 round(avg(coalesce(2.0 * hit / nullif(i + s, 0), 0)), 6) AS macro_f1 FROM k""")
def clf_metrics(spark, sf_dir):
    out = sampling.classification_measures(table(spark, sf_dir, "labels"), "quality", "toxic")
    return rounded(out, *out.columns)


GRID = {"least_words": [0, 20, 50, 100], "most_signs": [2, 5, 10, 20], "most_capitals": [3, 5, 10]}
GRID_SQL = r"""
g AS (SELECT * FROM (SELECT unnest([0, 20, 50, 100])::BIGINT AS least_words) CROSS JOIN (SELECT unnest([2, 5, 10, 20])::BIGINT AS most_signs) CROSS JOIN (SELECT unnest([3, 5, 10])::BIGINT AS most_capitals)),
d AS (SELECT quality, len(regexp_extract_all(text, '\S+')) AS words, len(regexp_extract_all(text, '[^a-zA-Z0-9\s]')) AS signs, len(regexp_extract_all(text, '[A-Z]')) AS caps, length(text) AS n
  FROM (SELECT coalesce(text, '') AS text, quality FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL)),
r AS (SELECT least_words, most_signs, most_capitals, count(*) FILTER (WHERE quality = 1 AND good) AS hits, count(*) FILTER (WHERE good) AS said, count(*) FILTER (WHERE quality = 1) AS there
  FROM (SELECT g.*, quality, words >= least_words AND 100 * signs <= most_signs * n AND 100 * caps <= most_capitals * n AS good FROM g, d) g GROUP BY least_words, most_signs, most_capitals)
"""


def rule_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each setting of a rule for good texts, held against all labelled documents in one pass; a document is told of once for each of the settings."""
    text = F.coalesce("text", F.lit(""))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").filter("quality IS NOT NULL").select("doc_id", "quality"), "doc_id")
    docs = docs.select("quality", count(r"\S+").alias("words"), count(r"[^a-zA-Z0-9\s]").alias("signs"), count("[A-Z]").alias("caps"), F.length(text).alias("n"))
    settings = F.array(*[F.struct(*[F.lit(v).cast("long").alias(k) for k, v in zip(GRID, values)]) for values in product(*GRID.values())])
    rows = docs.withColumn("g", F.explode(settings)).select("*", "g.*")
    good = (F.col("words") >= F.col("least_words")) & (100 * F.col("signs") <= F.col("most_signs") * F.col("n")) & (100 * F.col("caps") <= F.col("most_capitals") * F.col("n"))
    return rows.groupBy(*GRID).agg(F.count_if(good & (F.col("quality") == 1)).alias("hits"), F.count_if(good).alias("said"), F.count_if(F.col("quality") == 1).alias("there"))


@query(f"WITH {GRID_SQL} SELECT * FROM r")
def grid_product(spark, sf_dir):
    return rule_runs(spark, sf_dir)


@query(f"WITH {GRID_SQL} SELECT *, round(2.0 * hits / (said + there), 6)::DOUBLE AS eval_f1 FROM r ORDER BY eval_f1 DESC, least_words, most_signs, most_capitals LIMIT 10")
def top_configs(spark, sf_dir):
    """The ten best settings: the report's limit."""
    runs = rule_runs(spark, sf_dir).withColumn("eval_f1", F.round(2.0 * F.col("hits") / (F.col("said") + F.col("there")), 6))
    return sampling.best_runs(runs, "eval_f1", list(GRID))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_pool(spark, sf_dir):
    return relate.not_in(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


# Sources

@query(" UNION ALL ".join(f"SELECT '{t.upper()}' AS ticker_norm, count(*) AS n FROM {t}" for t in ("customer", "orders", "part", "supplier", "lineitem")))
def keyed_scan(spark, sf_dir):
    """Rows by the key that their file's name gives, over files of different columns."""
    out = None
    for name in ("customer", "orders", "part", "supplier", "lineitem"):
        one = spark.read.parquet(f"{sf_dir}/{name}.parquet").select(F.col("_metadata.file_path").alias("f"))
        out = one if out is None else out.unionByName(one)
    key = readers.file_key(F.regexp_replace("f", r"(\w+\.parquet)/.*$", "$1"))
    return out.groupBy(key.alias("ticker_norm")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n_rows, sum(o_orderkey)::BIGINT AS keys, 0::BIGINT AS n_bad FROM orders")
def glob_scan(spark, sf_dir):
    rows, bad = readers.read_glob(spark, sf_dir, "orders*.parquet")
    return rows.agg(F.count("*").alias("n_rows"), F.sum("o_orderkey").alias("keys")).withColumn("n_bad", F.lit(bad.count()).cast("long"))


from . import ingest_queries, model_queries, token_queries  # noqa: E402, F401  they register their queries here
