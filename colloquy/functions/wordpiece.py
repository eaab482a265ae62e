"""Greedy longest-match word pieces from a vocabulary table: counts, windows and cuts of texts.

Texts are made plain (no control signs, lower case, no accents), split at white space and around punctuation and ideographs, and each word is
walked down a trie: from each place the longest piece that the vocabulary has is taken, pieces inside a word bear a prefix there. A word
with a place that no piece fits, or of over 100 signs, is one unknown piece. Batches of texts go through Arrow; the words of a
task are remembered, up to a bound.

The vocabulary is data: a table of pieces or a file with one a line, of ``MOST`` pieces at most (it is sent to every task).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from functools import cached_property

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pieces of a vocabulary, at most, and words that a task remembers.
MOST, MEMORY = 1_000_000, 500_000
#: The prefix inside a word, the unknown piece, the longest word, ideographs that are words of their own, and signs that are punctuation besides \p{P}.
INSIDE, UNKNOWN, LONGEST = "##", "[UNK]", 100
IDEOGRAPHS = r"㐀-䶿一-鿿豈-﫿\U00020000-\U0002A6DF\U0002A700-\U0002B73F\U0002B740-\U0002B81F\U0002B820-\U0002CEAF\U0002F800-\U0002FA1F"
SIGNS = r"\p{P}$+<=>^`|~"
WORD = regex.compile(rf"[{SIGNS}{IDEOGRAPHS}]|[^\s\p{{Z}}{SIGNS}{IDEOGRAPHS}]+")
CONTROL = regex.compile(r"[^\P{C}\t\n\r]|�")
#: What decoding puts back together.
JOINED = ((" .", "."), (" ?", "?"), (" !", "!"), (" ,", ","), (" ' ", "'"), (" n't", "n't"), (" 'm", "'m"), (" 's", "'s"), (" 've", "'ve"), (" 're", "'re"))


class Marks(dict):
    """For ``str.translate``: accents go, other signs stay; a sign is looked up once."""

    def __missing__(self, code: int) -> int | None:
        self[code] = out = None if unicodedata.category(chr(code)) == "Mn" else code
        return out


MARKS = Marks()


def plain(text: str) -> str:
    if not text.isprintable() or "\ufffd" in text:  # what is printable has no control signs
        text = CONTROL.sub("", text)
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFD", text.lower()).translate(MARKS)


def words(text: str) -> list[str]:
    return WORD.findall(plain(text))


class Sizes(dict):
    """Numbers of pieces by word."""

    def __init__(self, count):
        self.count = count

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMORY:
            self.clear()
        self[word] = n = self.count(word)
        return n


class WordPiece:
    """As a counter of ``tone.chunks``: ``counter(column)``, ``counter.each(array column)`` and ``counter.windows(array column, most)``."""

    #: The pieces of a text are those of its parts between white space.
    additive = True

    def __init__(self, pieces: Iterable[str], inside: str = INSIDE, unknown: str = UNKNOWN):
        self.vocabulary, self.inside, self.unknown = sorted({p for p in pieces if p}), inside, unknown
        if len(self.vocabulary) > MOST:
            raise ValueError(f"a vocabulary has {MOST} pieces at most")
        self.memory: dict[str, tuple[str, ...]] = {}

    @classmethod
    def of_table(cls, vocabulary: DataFrame, column: str = "piece", **how) -> WordPiece:
        return cls((r[0] for r in vocabulary.select(F.col(column).cast("string")).filter(F.col(column).isNotNull()).limit(MOST + 1).collect()), **how)

    @classmethod
    def of_file(cls, spark: SparkSession, path: str, **how) -> WordPiece:
        return cls.of_table(spark.read.text(path).select(F.regexp_replace("value", r"\s+$", "").alias("piece")), **how)

    def __getstate__(self) -> dict:
        """Pieces travel, the trie and what is remembered don't."""
        return {"vocabulary": self.vocabulary, "inside": self.inside, "unknown": self.unknown, "memory": {}}

    @cached_property
    def tries(self) -> tuple[dict, dict]:
        """(pieces at the start of a word, pieces inside one): a node maps signs to nodes, and "" to the piece that ends there."""
        starts, insides = {}, {}
        for piece in self.vocabulary:
            within = piece.startswith(self.inside) and len(piece) > len(self.inside)
            for node, text in (((insides, piece[len(self.inside) :]),) if within else ()) + ((starts, piece),):
                for c in text:
                    node = node.setdefault(c, {})
                node[""] = piece
        return starts, insides

    def pieces_of(self, word: str) -> tuple[str, ...]:
        known = self.memory.get(word)
        if known is not None:
            return known
        out, at, n = [], 0, len(word)
        while at < n and n <= LONGEST:
            node, last, end = self.tries[1 if at else 0], None, at
            for k in range(at, n):
                node = node.get(word[k])
                if node is None:
                    break
                if "" in node:
                    last, end = node[""], k + 1
            if last is None:
                break
            out.append(last)
            at = end
        got = tuple(out) if at == n and out else (self.unknown,)
        if len(self.memory) >= MEMORY:
            self.memory.clear()
        self.memory[word] = got
        return got

    def pieces(self, text: str) -> list[str]:
        return [p for w in words(text) for p in self.pieces_of(w)]

    @cached_property
    def sizes(self) -> Sizes:
        return Sizes(lambda w: len(self.pieces_of(w)))

    def size(self, text: str | None) -> int:
        return sum(map(self.sizes.__getitem__, words(text))) if text else 0

    def decoded(self, pieces: list[str]) -> str:
        out = " ".join(pieces).replace(" " + self.inside, "")
        for a, b in JOINED:
            out = out.replace(a, b)
        return out.strip()

    def cut(self, text: str, most: int) -> list[str]:
        """Texts of ``most`` pieces each, put together again."""
        all_ = self.pieces(text)
        return [t for k in range(0, len(all_), most) if (t := self.decoded(all_[k : k + most]))]

    def __call__(self, text: Column) -> Column:
        own = self

        @F.pandas_udf(T.IntegerType())
        def count(texts: pd.Series) -> pd.Series:
            return pd.Series([own.size(t) for t in texts], dtype="int32")

        return count(text)

    def each(self, texts: Column) -> Column:
        """array<int>: the pieces of each text; null for null."""
        own = self

        @F.pandas_udf(T.ArrayType(T.IntegerType()))
        def counts(rows: pd.Series) -> pd.Series:
            return pd.Series([None if r is None else [own.size(t) for t in r] for r in rows])

        return counts(texts)

    def windows(self, texts: Column, most: int) -> Column:
        """array<array<string>>: texts of more than ``most`` pieces cut into windows, null for the others."""
        own = self

        @F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
        def cut(rows: pd.Series) -> pd.Series:
            return pd.Series([None if r is None else [own.cut(t, most) if own.size(t) > most else None for t in r] for r in rows])

        return cut(texts)

    def first(self, text: Column, most: int) -> Column:
        """The text's first ``most`` pieces, put together; a text that has no more is left as it is."""
        own = self

        @F.pandas_udf(T.StringType())
        def head(texts: pd.Series) -> pd.Series:
            return pd.Series([t if t is None or own.size(t) <= most else own.decoded(own.pieces(t)[:most]) for t in texts], dtype=object)

        return head(text)
