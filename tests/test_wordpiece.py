"""Word pieces against a plain loop and against an independent implementation of the same vocabulary."""

import pickle
import random

import pytest
from pyspark.sql import functions as F

from colloquy.functions import wordpiece
from colloquy.functions.wordpiece import WordPiece
from colloquy.operators import tone
from colloquy.plans.catalogue import QUERIES, SQL
from colloquy.plans.token_queries import vocabulary
from tests.conftest import same

SF = "/root/testdata/sf0.001"
ODD = ["", "  ", "unaffable", "Unaffable's naïve CAFÉ — résumé!", "日本語 text 中文", "a\x00b​c\tde", "10€ $5 x_y {z} `q` ~", "ß ſ İ Σίσυφος", "w" * 100, "w" * 101, "�", "한국어 é", "no line break", "...", "##a", "a##b"]


def plain_loop(vocab, word):
    if len(word) > 100:
        return ["[UNK]"]
    out, at = [], 0
    while at < len(word):
        for end in range(len(word), at, -1):
            piece = ("##" if at else "") + word[at:end]
            if piece in vocab:
                out.append(piece)
                at = end
                break
        else:
            return ["[UNK]"]
    return out


@pytest.fixture(scope="module")
def own(spark):
    return WordPiece.of_table(vocabulary(spark, SF))


def test_equal_to_a_plain_loop_on_all_documents(spark, own):
    vocab = set(own.vocabulary)
    texts = [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()] + ODD
    for t in texts:
        assert own.pieces(t or "") == [p for w in wordpiece.words(t or "") for p in plain_loop(vocab, w)]


def test_equal_to_another_implementation(spark, own):
    tokenizers = pytest.importorskip("tokenizers")
    vocab = {p: i for i, p in enumerate([*own.vocabulary, "[UNK]"])}
    other = tokenizers.Tokenizer(tokenizers.models.WordPiece(vocab, unk_token="[UNK]", max_input_chars_per_word=100))
    other.normalizer = tokenizers.normalizers.BertNormalizer(lowercase=True)
    other.pre_tokenizer = tokenizers.pre_tokenizers.BertPreTokenizer()
    texts = [r[0] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()] + ODD
    for t, e in zip(texts, other.encode_batch(texts, add_special_tokens=False)):
        assert own.pieces(t) == e.tokens, t[:80]


def test_greedy_match_and_unknown_words():
    w = WordPiece(["un", "##aff", "##able", "##a", "a", "able", "", "##"])
    assert w.pieces("Unaffable able unx a") == ["un", "##aff", "##able", "able", "[UNK]", "a"]
    assert w.pieces_of("##") == ("##",) and WordPiece([]).pieces("any text") == ["[UNK]", "[UNK]"]
    assert pickle.loads(pickle.dumps(w)).pieces("unable") == ["un", "##able"]


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(wordpiece, "MEMORY", 10)
    w = WordPiece(list("abc") + ["##a", "##b", "##c"])
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("abc") for _ in range(6))
        assert len(w.pieces(text)) == 6 and len(w.memory) <= 10
    monkeypatch.setattr(wordpiece, "MOST", 3)
    with pytest.raises(ValueError):
        WordPiece("abcd")


def brute_chunks(w, text, most):
    """The packing as a plain loop."""
    import re

    text = (text or "").strip()
    if not text:
        return []
    if w.size(text) <= most:
        return [text]
    out, now, n = [], [], 0
    for s in (s.strip() for s in re.split(r"(?<=[.!?])\s+", text)):
        if not s:
            continue
        k = w.size(s)
        if k > most:
            if now:
                out.append(" ".join(now))
            now, n = [], 0
            out += w.cut(s, most)
        elif n + k > most:
            if now:
                out.append(" ".join(now))
            now, n = [s], k
        else:
            now.append(s)
            n += k
    return out + ([" ".join(now)] if now else [])


@pytest.mark.parametrize("most", [16, 128])
def test_chunks_against_a_plain_loop(spark, own, most):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate([None, *ODD, "one. " * 50 + "two three " * 200 + "! end."])], "doc_id long, text string"))
    segs = docs.select(F.col("doc_id").alias("transcript_id"), F.lit(0).alias("segment_id"), F.col("text").alias("content"))
    got = {}
    for r in tone.chunks(segs, most, own).collect():
        got.setdefault(r["transcript_id"], []).append((r["chunk_order"], r["chunk_text"], r["chunk_token_count"]))
    for i, t in docs.collect():
        want = brute_chunks(own, t, most)
        rows = sorted(got.get(i, []))
        assert [x[1] for x in rows] == want and [x[2] for x in rows] == [own.size(c) for c in want], i


def test_columns_of_counts_and_cuts(spark, own):
    df = spark.createDataFrame([(t,) for t in [None, *ODD]], "t string")
    for t, n, head in df.select("t", own(F.col("t")), own.first(F.col("t"), 3)).collect():
        assert n == (own.size(t) if t else 0)
        assert head == (t if t is None or own.size(t) <= 3 else own.decoded(own.pieces(t)[:3]))
    assert df.limit(0).select(own(F.col("t"))).collect() == []


def test_vocabulary_of_a_file(spark, tmp_path):
    (tmp_path / "vocab.txt").write_text("[UNK]\r\nhug\n##s\n")
    assert WordPiece.of_file(spark, str(tmp_path / "vocab.txt")).pieces("Hugs bug") == ["hug", "##s", "[UNK]"]


def test_sql(spark):
    tables = {t: f"{SF}/{t}.parquet" for t in ("documents", "benchmark")}
    assert same(spark, QUERIES["wordpiece_counts"](spark, SF), SQL["wordpiece_counts"], tables) == 200


def test_plain_looks_at_a_sign_once(monkeypatch):
    """As sign by sign, over all code points; accents are found without a call for each sign of a text."""
    import unicodedata

    from colloquy.functions import wordpiece as W

    def slow(text):
        text = W.CONTROL.sub("", text)
        return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")

    every = [c for c in map(chr, range(0x110000)) if not "\ud800" <= c <= "\udfff"]
    assert not [c for c in every if W.plain(c) != slow(c)]
    assert not [k for k in range(0, len(every), 997) if W.plain("".join(every[k : k + 997])) != slow("".join(every[k : k + 997]))]
    calls = []
    real = unicodedata.category
    monkeypatch.setattr(W.unicodedata, "category", lambda c: calls.append(c) or real(c))
    W.plain("é à ü ñ " * 1_000)
    assert len(calls) < 100
