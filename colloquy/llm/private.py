"""Personal data: overlapping candidates, gradient-boosted trees, calibrated thresholds.

Base spans come from fixed formats and always stay. Generators with high recall
also propose spans that may overlap each other: digits bare or with any usual
separators (as phone, card or address), and addresses of mail or of machines whose
signs are written out, spaced or put in brackets. Boosted trees score every proposal
by format and context (digits, groups, check sum, neighbours, key words before it).
They are trained here on texts made from templates with a fixed seed: writings of
the four kinds, and what looks like them (dates, amounts, versions, hashes, order
numbers, sentences). Per kind, the threshold is the least one at which held-back
proposals reach ``PRECISION``, so that clean documents are left alone; a writing
that no generator proposes counts as missed, not as unseen. Chosen spans that
overlap a base span or a better chosen span are left out (ties: the earlier, then the
longer, then the kind listed first).

Defined cases: null text is empty; offsets are code points; rows that share an
id are judged each by its own text; extra columns are ignored; digit strings of
any length are read in one pass.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.995

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
NUMBERS = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
NUMBER = re.compile(r"[0-9]+")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PLUS = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind): the leftmost matches of each kind that pass its test, by start and kind."""
    out, at, done = [], text.find("@"), 0
    while at >= 0:
        m = DOMAIN.match(text, at + 1)
        if m:
            s = at
            while s > done and text[s - 1] in LOCAL:
                s -= 1
            if s < at:
                out.append((s, m.end(), 0))
                done = m.end()
        at = text.find("@", max(at + 1, done))
    if NUMBER.search(text):
        for m in NUMBERS.finditer(text):
            parts = [(p.start(), p.end()) for p in NUMBER.finditer(text, m.start(), m.end())]
            for k in range(0, len(parts) - 3, 4):
                four = parts[k : k + 4]
                if all(len(v := text[a:b].lstrip("0")) <= 3 and int(v or 0) <= 255 for a, b in four):
                    out.append((four[0][0], four[3][1], 1))
        for m in DIGITS.finditer(text):
            if m.end() - m.start() < 14 or m.end() - m.start() > 37:
                continue
            d = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), m.end(), 2))
        for m in PLUS.finditer(text):
            if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append((m.start(), m.end(), 3))
    return sorted(out)


# Proposals

GROUP = re.compile(r"[0-9](?:[\x20().:/_-]{0,2}[0-9]){6,29}")
AT = re.compile(r"\s?[\[({<]\s?(?:at|AT|@)\s?[\])}>]\s?|\s(?:at|AT)\s|\s@\s?|@\s")
DOT = r"(?:\s?[\[({<]\s?(?:dot|DOT|\.)\s?[\])}>]\s?|\s(?:dot|DOT)\s|\.)"
BEFORE = re.compile(rf"(?:[A-Za-z0-9_%+-]{{1,64}}(?:\s?[\[({{<](?:dot|DOT)[\])}}>]\s?|\s(?:dot|DOT)\s)){{0,3}}[A-Za-z0-9._%+-]{{1,64}}$")
AFTER = re.compile(rf"[A-Za-z0-9-]{{1,63}}(?:{DOT}[A-Za-z0-9-]{{2,63}}){{1,4}}")
ADDRESS = re.compile(r"(?<![0-9])[0-9]{1,3}(?:(?:\s?(?:\[\s?(?:\.|dot|DOT)\s?\]|\(\s?(?:\.|dot|DOT)\s?\)|_|:|,|-)\s?|\s(?:dot|DOT)\s|\s\.\s?|\.\s)[0-9]{1,3}){3}(?![0-9])")
CUES = {
    0: re.compile(r"mail|contact|write|reach|address", re.I), 1: re.compile(r"\bip\b|host|server|address|addr|node|ping|gateway|router|login", re.I),
    2: re.compile(r"card|visa|credit|payment|master|amex|charge|debit", re.I),
    3: re.compile(r"tel|phone|call|fax|mobile|cell|whatsapp|dial|ring|text me|sms|number is", re.I),
}
OTHER = re.compile(r"order|invoice|version|isbn|page|id\b|ref|date|serial|token|hash|total|sum|build|ticket|amount|no\.?\s?$|#\s?$|[$€£]\s?$", re.I)
#: Endings of addresses of mail that are common everywhere.
ENDINGS = frozenset("com org net edu gov info io eu de fr es uk it nl ch at us ca au".split())
WRITTEN = re.compile(r"\bdot\b", re.I)
DATE = re.compile(r"(?:19|20)?\d\d[-/.](?:0?\d|1[0-2])[-/.]\d{1,4}(?:[ :]\d\d){0,3}")
LETTERS = re.compile(r"[A-Za-z]+")
NAMES = ["kind", "digits", "groups", "longest", "shortest", "plus", "bracket", "dots", "dashes", "spaces", "slashes", "luhn", "letter_before",
         "letter_after", "sign_before", "sign_after", "cue", "other_cue", "first", "date", "same_groups", "words", "length", "ending",
         "written", "marked", "small_parts", "fours", "zero"]


def proposals(text: str) -> list[tuple[int, int, int]]:
    """Overlapping spans that may be personal data, with high recall."""
    out = []
    if NUMBER.search(text):
        for m in GROUP.finditer(text):
            s, e = m.span()
            n = sum(c in "0123456789" for c in m[0])
            if 13 <= n <= 19:
                out.append((s, e, 2))
            while s and text[s - 1] in "(+" and m.start() - s < 2:
                s -= 1
            if 7 <= n <= 15:
                out.append((s, e, 3))
        out += [(*m.span(), 1) for m in ADDRESS.finditer(text)]
    for m in AT.finditer(text):
        a, b = BEFORE.search(text, max(0, m.start() - 200), m.start()), AFTER.match(text, m.end())
        if a and b:
            out.append((a.start(), b.end(), 0))
    return out


def features(text: str, span: tuple[int, int, int]) -> list[float]:
    s, e, kind = span
    x, before, after = text[s:e], text[max(0, s - 24) : s], text[e : e + 3]
    found = NUMBER.findall(x)
    groups = [len(g) for g in found] or [0]
    digits = "".join(found)
    words = LETTERS.findall(x)
    return [
        kind, len(digits), len(groups), max(groups), min(groups), x.startswith("+") or x.startswith("(+"), "(" in x, x.count("."), x.count("-"),
        x.count(" "), x.count("/") + x.count(":"), luhn(digits) if digits else 0, before[-1:].isalpha(), after[:1].isalpha(),
        before[-1:] in tuple("-_=./:#$€\"'"), after[:1] in tuple("-_=/:%€$\"'"), bool(CUES[kind].search(before)), bool(OTHER.search(before)),
        int(digits[0]) if digits else -1, bool(DATE.fullmatch(x)),
        len(set(groups)) == 1, len(words), len(x), bool(words) and words[-1].lower() in ENDINGS,
        bool(WRITTEN.search(x)), any(c in x for c in "[{<@"), len(groups) == 4 and all(int(g[:4]) <= 255 and len(g) <= 3 for g in found),
        groups in ([4] * 4, [4, 6, 5]), digits.startswith("0"),
    ]


# Boosted trees

def grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> tuple:
    """A regression tree on gradients: (feature, cut, left, right) or a leaf."""
    leaf = float(-g.sum() / (h.sum() + 1.0))
    if depth == 0 or len(g) < 16:
        return (leaf,)
    best = (1e-3, None, None)
    whole = g.sum() ** 2 / (h.sum() + 1)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, cg, ch = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
        cuts = np.flatnonzero(v[1:] != v[:-1])
        if len(cuts):
            gain = cg[cuts] ** 2 / (ch[cuts] + 1) + (cg[-1] - cg[cuts]) ** 2 / (ch[-1] - ch[cuts] + 1) - whole
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], f, (v[cuts[k]] + v[cuts[k] + 1]) / 2)
    if best[1] is None:
        return (leaf,)
    left = x[:, best[1]] < best[2]
    return (best[1], best[2], grow(x[left], g[left], h[left], depth - 1), grow(x[~left], g[~left], h[~left], depth - 1))


def value(tree: tuple, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    left = x[:, tree[0]] < tree[1]
    out = np.empty(len(x))
    out[left], out[~left] = value(tree[2], x[left]), value(tree[3], x[~left])
    return out


class Boosted:
    """Trees, a calibration (slope, shift) of their sum, and a threshold per kind."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.3, seed: int = 5):
        order = np.random.default_rng(seed).permutation(len(y))
        held, own = order[: len(y) // 3], order[len(y) // 3 :]
        self.trees, self.rate, score = [], rate, np.zeros(len(own))
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            tree = grow(x[own], p - y[own], p * (1 - p), depth)
            self.trees.append(tree)
            score += rate * value(tree, x[own])
        raw, self.slope, self.shift = self.raw(x[held]), 1.0, 0.0
        for _ in range(200):
            p = 1 / (1 + np.exp(-(self.slope * raw + self.shift)))
            e = p - y[held]
            self.slope -= 0.05 * float((e * raw).mean())
            self.shift -= 0.05 * float(e.mean())
        q, self.threshold = self(x[held]), {}
        for kind in range(len(KINDS)):
            of = x[held][:, 0] == kind
            p, t = q[of], y[held][of]
            by = np.argsort(-p, kind="stable")
            right = np.cumsum(t[by]) / np.arange(1, len(by) + 1)
            ok = np.flatnonzero(right >= PRECISION)
            self.threshold[kind] = float(p[by][ok[-1]]) if len(ok) else 2.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.rate * sum((value(t, x) for t in self.trees), np.zeros(len(x)))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.raw(x) + self.shift)))


def made_texts(n: int, seed: int = 3) -> Iterator[tuple[str, int, int, int, int]]:
    """(text, start, end, kind, label): writings of the four kinds and of what looks like them."""
    rng = np.random.default_rng(seed)
    pick = lambda *a: a[rng.integers(len(a))]
    num = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    word = lambda: "".join(pick(*"abcdefghiklmnoprstuvw") for _ in range(rng.integers(2, 9)))

    def card() -> str:
        d = pick("4", "5", "37") + num(13)
        d = d[:15]
        d += next(str(c) for c in range(10) if luhn(d + str(c)))
        return d

    def wrong() -> str:
        d = card()
        return d[:-1] + str((int(d[-1]) + int(rng.integers(1, 10))) % 10)

    def amex() -> str:
        d = pick("34", "37") + num(12)
        return d + next(str(c) for c in range(10) if luhn(d + str(c)))

    grouped = lambda d, sep: sep.join(d[i : i + 4] for i in range(0, len(d), 4))
    dot = lambda: pick(" dot ", " DOT ", "[dot]", " [dot] ", "(dot)", " (dot) ", "{dot}", ".", ".")
    at = lambda: pick(" at ", " AT ", "[at]", " [at] ", "(at)", " (at) ", "{at}", " <at> ", " [@] ", " @ ", "@ ", " @")
    end = lambda: pick("com", "org", "net", "fr", "de", "es", "edu", "io")
    parts = lambda: [str(v) for v in rng.integers(0, 256, 4)]
    # (kind, 1 for personal data or 0, 1 where only a key word before it makes it personal data, what makes it)
    kinds = [
        (3, 1, 0, lambda: f"({num(3)}) {num(3)}-{num(4)}"), (3, 1, 0, lambda: f"{num(3)}-{num(3)}-{num(4)}"), (3, 1, 0, lambda: f"{num(3)}.{num(3)}.{num(4)}"),
        (3, 1, 0, lambda: f"+{pick('1', '33', '49', '34')} {num(3)} {num(3)} {num(3)}"), (3, 1, 0, lambda: f"0{num(1)} {num(2)} {num(2)} {num(2)} {num(2)}"),
        (3, 1, 1, lambda: num(rng.integers(7, 12))), (3, 1, 1, lambda: f"0{num(2)}{pick(' ', '/', '-', ' / ')}{num(rng.integers(5, 9))}"),
        (3, 1, 1, lambda: f"{num(3)}{pick('-', '.', ' ')}{num(4)}"), (3, 1, 0, lambda: f"(0{num(2)}) {num(rng.integers(6, 9))}"), (3, 1, 1, lambda: f"{num(3)} {num(3)} {num(4)}"),
        (3, 1, 1, lambda: f"00{num(2)}{pick(' ', '-')}{num(3)}{pick(' ', '-')}{num(rng.integers(5, 8))}"),
        (2, 1, 0, lambda: grouped(card(), pick(".", "/", "_", "  ", " - "))), (2, 1, 0, lambda: (lambda d: pick(".", "_", "/").join((d[:4], d[4:10], d[10:])))(amex())),
        (1, 1, 0, lambda: pick("[.]", "(.)", "[dot]", "(dot)", " dot ", " DOT ").join(parts())), (1, 1, 1, lambda: pick(" . ", ". ", " .", ",", ":").join(parts())),
        (0, 1, 0, lambda: f"{word()}{pick('', '.' + word(), num(2), '_' + word())}{at()}{word()}{dot()}{end()}"),
        (0, 1, 0, lambda: f"{word()}{pick(' dot ', '[dot]', ' (dot) ')}{word()}{at()}{word()}{dot()}{end()}"), (0, 1, 0, lambda: f"{word()}{at()}{word()}{dot()}{word()}{dot()}{end()}"),
        (3, 0, 0, lambda: f"{rng.integers(1900, 2030)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}"), (3, 0, 0, lambda: num(rng.integers(7, 16))),
        (3, 0, 0, lambda: f"{num(1)}.{num(2)}.{num(3)}.{num(2)}"), (3, 0, 0, lambda: f"{num(2)}/{num(2)}/{num(4)}"), (2, 0, 0, lambda: grouped(wrong(), pick("", " ", "-", ".", "/"))),
        (3, 0, 0, lambda: grouped(num(16), pick(" ", "-"))), (2, 0, 0, lambda: num(rng.integers(13, 20))), (3, 0, 0, lambda: f"{num(3)}-{num(1)}-{num(5)}-{num(2)}-{num(1)}"),
        (3, 0, 0, lambda: word()[:2] + num(8) + word()[:2]), (2, 0, 0, lambda: word()[:2] + num(15) + word()[:1]), (1, 0, 0, lambda: ":".join(num(2) for _ in range(4))),
        (1, 0, 0, lambda: pick("_", "-", ",", ", ").join(num(rng.integers(1, 4)) for _ in range(4))), (0, 0, 0, lambda: f"{num(2)} @ {num(1)}.{num(2)}"), (0, 0, 0, lambda: f"{word()} @ {num(2)}.{num(2)}"),
        (3, 0, 0, lambda: f"{num(2)}:{num(2)}:{num(2)}.{num(3)}"), (3, 0, 0, lambda: " ".join(num(rng.integers(1, 3)) for _ in range(6))),
        (0, 0, 0, lambda: f"{word()} at {word()}.{word()}"), (0, 0, 0, lambda: f"{word()} at {word()}. {word()}"), (0, 0, 0, lambda: f"{word()} at the {word()} dot {word()}"),
        (3, 0, 0, lambda: f"{num(3)} {num(3)}"), (3, 0, 0, lambda: f"{num(3)},{num(3)},{num(3)}"), (3, 0, 0, lambda: f"{num(4)}-{num(4)}"),
    ]
    cues = {0: ("mail: ", "contact ", "write to ", "reach me: "), 1: ("ip ", "host ", "ping ", "server at "), 2: ("card ", "visa ", "charge "),
            3: ("tel. ", "call ", "phone: ", "fax ", "dial ", "mobile ", "call me at ", "ring ", "tel ")}
    others = ("order ", "ref ", "version ", "id ", "#", "ticket ", "total ", "page ", "build ", "invoice no. ", "$")
    for _ in range(n):
        kind, label, need, make = kinds[rng.integers(len(kinds))]
        lead = ""
        if label and (need or rng.random() < 0.35):
            lead = pick(*cues[kind])
            if need and rng.random() < 0.4:  # the same writing without its key word tells nothing
                lead, label = (pick(*others) if rng.random() < 0.5 else ""), 0
        elif not label and rng.random() < 0.4:
            lead = pick(*others)
        head, body, tail = f"{word()} {word()} {lead}", make(), pick(" ", ". ", ", ", "\n", "") + word()
        tail = tail if tail[0] in " .,\n" else pick("", ".", ",")
        if not label and rng.random() < 0.15:
            head += pick("a", "=", "-", "$")
        yield head + body + tail, len(head), len(head) + len(body), kind, label


def near(p: tuple[int, int, int], q: tuple[int, int, int]) -> bool:
    return p[2] == q[2] and abs(p[0] - q[0]) <= 2 and abs(p[1] - q[1]) <= 2


@lru_cache(maxsize=1)
def model(examples: int = 12_000) -> Boosted:
    x, y = [], []
    for text, s, e, kind, label in made_texts(examples):
        base = Taken(base_spans(text))
        for p in proposals(text):
            if not base.meets(p[0], p[1]):
                x.append(features(text, p))
                y.append(float(bool(label) and near(p, (s, e, kind))))
    return Boosted(np.array(x, float), np.array(y))


class Taken:
    """Spans that don't overlap, in order; built from spans that may."""

    def __init__(self, spans: list[tuple[int, int, int]] = ()):
        self.starts, self.ends = [], []
        for s, e, *_ in sorted(spans):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(e, self.ends[-1])
            else:
                self.starts.append(s)
                self.ends.append(e)

    def meets(self, s: int, e: int) -> bool:
        k = bisect_right(self.ends, s)  # the first that ends after s
        return k < len(self.ends) and self.starts[k] < e

    def add(self, s: int, e: int) -> None:
        k = bisect_right(self.ends, s)
        self.starts.insert(k, s)
        self.ends.insert(k, e)


def all_spans(texts: list[str], bases: list[list[tuple[int, int, int]]], trees: Boosted) -> list[list[tuple[int, int, int]]]:
    """Per text, the base spans and the chosen proposals that overlap none of them; all proposals are scored together."""
    found, x = [], []
    for text, base in zip(texts, bases):
        taken = Taken(base)
        found.append(sorted({p for p in proposals(text) if not taken.meets(p[0], p[1])}))
        x += [features(text, p) for p in found[-1]]
    if not x:
        return bases
    score, at, out = trees(np.array(x, float)), 0, []
    for base, own in zip(bases, found):
        by = score[at : at + len(own)]
        at += len(own)
        taken, chosen = Taken(), []
        for k in np.lexsort(([p[2] for p in own], [-p[1] for p in own], [p[0] for p in own], -by)).tolist():
            s, e, kind = own[k]
            if by[k] >= trees.threshold[kind] and not taken.meets(s, e):
                taken.add(s, e)
                chosen.append((s, e, kind))
        out.append(sorted(base + chosen))
    return out


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def private_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans): per row, its base spans and all spans as ``kind:start:end`` by start and kind."""
    sent = docs.sparkSession.sparkContext.broadcast(model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                texts = [text or "" for text in part.column(1).to_pylist()]
                base = [base_spans(text) for text in texts]
                spans = all_spans(texts, base, sent.value)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(map(told, base), pa.string()), pa.array(map(told, spans), pa.string())], ["doc_id", "base", "spans"]
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, base string, spans string")


def redacted(text: str, spans: str) -> str:
    """The text with every span replaced by its kind; overlapping spans by that of the first."""
    out, at = [], 0
    for item in filter(None, spans.split(",")):
        kind, s, e = item.split(":")
        if int(s) >= at:
            out += [text[at : int(s)], f"<{kind}>"]
        at = max(at, int(e))
    return "".join(out) + text[at:]


def op10_private(spark, sf_dir: str) -> DataFrame:
    out = private_spans(documents(spark, sf_dir))
    counts = [F.regexp_count("base", F.lit(f"{k}:")).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")
