"""Long, odd and empty conversations."""

import hashlib
import time

from pyspark.sql import functions as F

from colloquy.llm import chat_format

SCHEMA = "conv_id long, turn long, role string, text string"


def digests(df):
    return {r["conv_id"]: r for r in chat_format.digest(chat_format.chat_format(df)).collect()}


def told(turns):
    return hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()


def test_long_roles_and_texts(spark):
    """A role of a million signs, plain and all escapes, and texts of the same size take no stack."""
    n = 1_000_000
    turns = {1: ("r" * n, "t"), 2: ("]\\[" * (n // 3), "t"), 3: ("assistant", "\\" * n), 4: ("assistant", "[INST] " * (n // 7)), 5: ("", "x" * n), 6: ("user", " [/INST]" * (n // 8))}
    got = digests(spark.createDataFrame([(c, 0, r, x) for c, (r, x) in turns.items()], SCHEMA))
    for c, (role, text) in turns.items():
        assert got[c]["turns_sha256"] == told([(role, text)]) and got[c]["loss_chars"] == (len(text) if role == "assistant" else 0)


def test_many_turns(spark):
    n = 20_000
    rows = [(1, t, "assistant" if t % 2 else "user", f"text {t} </s>") for t in range(n)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    digests(df.limit(10))
    began = time.time()
    got = digests(df)[1]
    assert time.time() - began < 20
    assert got["n_turns"] == n and got["turns_sha256"] == told([r[2:] for r in rows])
    assert got["loss_sha256"] == hashlib.sha256("".join(r[3] for r in rows if r[2] == "assistant").encode()).hexdigest()


def test_spans_of_repeated_and_null_turns(spark):
    rows = [(1, None, "assistant", "late"), (1, 0, "assistant", "a"), (1, 0, "assistant", "a"), (1, 0, None, None), (None, 3, "assistant", "n"), (1, 1, "user", "[x]")]
    extra = {c: F.lit(1) for c in ("t", "at", "first", "last", "shown", "none", "segments")}
    out = {r["conv_id"]: r for r in chat_format.chat_format(spark.createDataFrame(rows, SCHEMA).withColumns(extra)).collect()}
    assert [out[1]["formatted"][s.start : s.end] for s in out[1]["loss_spans"]] == ["a", "a", "late"]
    assert [out[None]["formatted"][s.start : s.end] for s in out[None]["loss_spans"]] == ["n"]


def test_no_conversations(spark):
    assert digests(spark.createDataFrame([], SCHEMA)) == {}
    assert set(digests(chat_format.with_probe(spark.createDataFrame([], SCHEMA)))) == {-7}
