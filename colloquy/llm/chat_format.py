"""Chat formatting by a grammar round trip. DataFrame and SQL functions only.

Grammar: a conversation is its turns one after the other; a turn is an opening
mark, a text and a closing mark:

    user        [INST] text [/INST]        system   <<SYS>> text <</SYS>>
    assistant   <s> text </s>              other    [ROLE:name] text [/ROLE]

A turn without control strings is rendered as it is, parsed again with one
deterministic pattern, and compared with its source. Where they differ, and
where control strings stand in the text, the text is escaped more (level 1:
the control strings and the escape sign; level 2: every bracket and escape
sign) and rendered again, until the parse is identical. A turn that parses to
itself alone also does so in a conversation, because the first closing mark
after its opening ends it, whatever follows. The parsed conversation is
compared with the source once more as a whole.

Defined cases: null text or role is empty; turns are ordered by turn (null
last), then role, then text; rows with a null conv_id are one conversation;
repeated rows are repeated turns; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONTROL = ("[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[ROLE:", "[/ROLE]")
OPEN = {"user": "[INST] ", "assistant": "<s> ", "system": "<<SYS>> "}
CLOSE = {"user": " [/INST]", "assistant": " </s>", "system": " <</SYS>>"}
#: An escaped role name. Possessive, so that it is matched by loops: a name of any length takes no stack.
NAME = r"[^\]\\]*+(?:\\.[^\]\\]*+)*+"
#: One whole turn; contiguous (\G), lazy up to the first closing mark.
TURN = rf"(?s)\G(?:\[INST\] .*? \[/INST\]|<s> .*? </s>|<<SYS>> .*? <</SYS>>|\[ROLE:{NAME}\] .*? \[/ROLE\])"
PROBE = "</s>[INST] ok [/INST]"


def escape(text: Column, level: int) -> Column:
    if level == 0:
        return text
    if level == 1:
        marks = r"(\\|\[/?INST\]|</?s>|<</?SYS>>|\[ROLE:|\[/ROLE\])"
    else:
        marks = r"([\\\[\]<>])"
    return F.regexp_replace(text, marks, r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def opening(role: Column) -> Column:
    out = F.concat(F.lit("[ROLE:"), escape(role, 2), F.lit("] "))
    for name, mark in OPEN.items():
        out = F.when(role == name, mark).otherwise(out)
    return out


def closing(role: Column) -> Column:
    out = F.lit(" [/ROLE]")
    for name, mark in CLOSE.items():
        out = F.when(role == name, mark).otherwise(out)
    return out


def parse_turn(turn: Column) -> Column:
    """struct(role, text) of one rendered turn."""
    cases = [(mark, F.lit(role), F.lit(len(mark)), F.lit(len(CLOSE[role]))) for role, mark in OPEN.items()]
    head = F.regexp_extract(turn, rf"(?s)^\[ROLE:({NAME})\] ", 1)
    role, skip, tail = unescape(head), F.length(head) + 8, F.lit(8)
    for mark, name, first, last in cases:
        hit = turn.startswith(mark)
        role, skip, tail = (F.when(hit, a).otherwise(b) for a, b in ((name, role), (first, skip), (last, tail)))
    body = F.substring(turn, skip + 1, F.length(turn) - skip - tail)
    return F.struct(role.alias("role"), unescape(body).alias("text"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation; null if some of it is outside the grammar."""
    turns = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0))
    whole = F.aggregate(turns, F.lit(0), lambda n, t: n + F.length(t)) == F.length(formatted)
    return F.when(whole, F.transform(turns, parse_turn))


def parse_is(formatted: Column, source: Column) -> Column:
    """Whether it parses to exactly one turn that equals ``source``."""
    back = parse(formatted)
    return F.coalesce((F.size(back) == 1) & (back[0] == source), F.lit(False))


def chat_format(rows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, formatted, segments, loss_spans): one row per conversation.

    ``segments`` are (text, loss) pieces whose texts make up ``formatted``;
    ``loss_spans`` are the same mask as code point ranges (start, end exclusive):
    the texts of assistant turns as they stand in ``formatted``, without marks.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    source = F.struct("role", "text")

    def render(level: int) -> Column:
        return F.concat(opening(F.col("role")), escape(F.col("text"), level), closing(F.col("role")))

    # Level 0 needs a text without control strings; the rest is rendered and parsed again until it comes back.
    free = escape(F.col("text"), 1) == F.col("text")
    shown = (
        F.when(free & parse_is(render(0), source), render(0))
        .when(parse_is(render(1), source), render(1))
        .otherwise(render(2))
    )
    first, last = F.length(opening(F.col("role"))), F.length(closing(F.col("role")))
    turns = turns.withColumn("shown", shown).withColumns({"first": first, "last": last})
    # Places are running sums over the turns, which meet here as they do in their string.
    before = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("at", F.coalesce(F.sum(F.length("shown").cast("long")).over(before), F.lit(0).cast("long")))
    packed = F.struct(F.col("turn").isNull().alias("none"), "turn", "role", "text", "at", "shown", "first", "last")
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(packed)).alias("t"))
    pieces = F.flatten(
        F.transform(
            "t",
            lambda x: F.array(
                F.struct(F.substring(x.shown, F.lit(1), x.first).alias("text"), F.lit(False).alias("loss")),
                F.struct(
                    F.substring(x.shown, x["first"] + 1, F.length(x.shown) - x["first"] - x["last"]).alias("text"),
                    (x.role == "assistant").alias("loss"),
                ),
                F.struct(F.substring(x.shown, F.length(x.shown) - x["last"] + 1, x["last"]).alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    formatted = F.array_join(F.transform("t", lambda x: x.shown), "")
    out = grouped.select("conv_id", "t", pieces.alias("segments"), formatted.alias("formatted"))
    same = parse(F.col("formatted")) == F.transform("t", lambda x: F.struct(x.role.alias("role"), x.text.alias("text")))
    said = F.filter("t", lambda x: x.role == "assistant")
    spans = F.transform(said, lambda x: F.struct((x["at"] + x["first"]).alias("start"), (x["at"] + F.length(x.shown) - x["last"]).alias("end")))
    return out.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.when(F.coalesce(same, F.lit(False)), F.col("formatted"))
        .otherwise(F.raise_error(F.concat(F.lit("no round trip for conversation "), F.col("conv_id").cast("string"))))
        .alias("formatted"),
        "segments",
        spans.alias("loss_spans"),
    )


def with_probe(rows: DataFrame) -> DataFrame:
    """The conversations and conversation -7, whose two texts are made of control strings."""
    probe = rows.sparkSession.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"),
    )
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(probe)


def digest(out: DataFrame) -> DataFrame:
    """What can be read back from the output: the turns by the parser from the formatted text, the loss from the pieces under the mask.

    The pieces must make up the formatted text and those under the mask have the lengths of the spans, else it raises. All of it is linear in the text.
    """
    turns = parse(F.col("formatted"))
    told = F.array_join(F.transform(turns, lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    masked = F.filter("segments", lambda s: s.loss)
    fits = (F.array_join(F.transform("segments", lambda s: s.text), "") == F.col("formatted")) & (
        F.transform(masked, lambda s: F.length(s.text).cast("long")) == F.transform("loss_spans", lambda s: s.end - s.start)
    )
    said = F.array_join(F.transform(masked, lambda s: unescape(s.text)), "")
    loss = F.when(F.coalesce(fits, F.lit(False)), said).otherwise(F.raise_error(F.concat(F.lit("pieces and spans differ in conversation "), F.col("conv_id").cast("string"))))
    return out.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op9_chat_format(spark, sf_dir: str) -> DataFrame:
    return digest(chat_format(with_probe(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


OP9_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *,
    CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 WHEN 'system' THEN 17
         ELSE 16 + length(regexp_replace(role, '([\\\[\]<>])', '\\\1', 'g')) END AS marks,
    length(regexp_replace(text, '(\\|\[/?INST\]|</?s>|<</?SYS>>|\[ROLE:|\[/ROLE\])', '\\\1', 'g')) AS shown
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(marks + shown)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
