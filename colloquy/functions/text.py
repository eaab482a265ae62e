"""Text expressions. All are built-in functions but ``company_key``, which needs Unicode decomposition."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Legal suffixes that a company name loses.
LEGAL_SUFFIXES = (
    "inc", "incorporated", "corp", "corporation", "co", "company", "ltd", "limited", "llc", "plc", "sa",
    "spa", "ag", "nv", "se", "oyj", "ab", "asa", "holdings", "holding", "group",
)
#: Texts of a page that is still loading.
PLACEHOLDERS = ("your document is on its way...", "your document is on its way")
WEEKDAYS = "Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday"
#: Fixed value: a speaker line, that is the operator, or a letter, up to 100 more signs and the role.
SPEAKER_LINE = r"(?md)^(OperatorOperator|[\p{L}\p{Nl}\p{No}][^\n]{1,100}?(?:Executive|Analyst))$"


def trimmed(c: Column) -> Column:
    """Without any Unicode white space at both ends."""
    return F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def as_text(c: Column) -> Column:
    return F.coalesce(trimmed(c), F.lit(""))


def clean_text(c: Column) -> Column:
    """Null as empty; no-break spaces as spaces; no carriage returns; no blanks around line ends; no repeated blanks or empty lines."""
    c = F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\u00a0"), F.lit(" ")), "\r", "")
    c = F.regexp_replace(c, r"[ \t]*\n[ \t\n]*", "\n")
    return trimmed(F.regexp_replace(c, r"[ \t]+", " "))


def is_placeholder(c: Column) -> Column:
    low = F.lower(clean_text(c))
    out = F.lit(False)
    for p in PLACEHOLDERS:
        out = out | low.contains(p)
    return out


def company_name(subheader: Column, title: Column) -> Column:
    """First line of the subheader that isn't blank, else the title up to the first ' - '."""
    lines = F.filter(F.transform(F.split(as_text(subheader), "\n", -1), trimmed), lambda x: x != "")
    return F.coalesce(F.get(lines, 0), trimmed(F.substring_index(as_text(title), " - ", 1)))


def ticker(c: Column) -> Column:
    return F.replace(F.upper(trimmed(c)), F.lit("."), F.lit("-"))


def _tidy(folded: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(F.replace(folded, F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "), " +", " ")
    suffixes = "|".join(LEGAL_SUFFIXES)
    return F.trim(F.regexp_replace(F.trim(out), f"(?:(?:^| )(?:{suffixes}))+$", ""))


@F.pandas_udf(T.StringType())
def _decomposed(names: pd.Series) -> pd.Series:
    def fold(x):
        return None if x is None else "".join(ch for ch in unicodedata.normalize("NFKD", x.lower()) if not unicodedata.combining(ch))

    return names.map(fold)


def company_key(c: Column) -> Column:
    """Name key: lower case, decomposed, letters and digits, without legal suffixes at its end.

    Only names with other than ASCII characters are handed to Python.
    """
    plain = F.octet_length(c) == F.length(c)
    return _tidy(F.when(plain, F.lower(c)).otherwise(_decomposed(F.when(~plain, c))))


def long_date(c: Column) -> Column:
    """'Thursday, February 19, 2026 4:30 PM' as a timestamp; null where it isn't one. The weekday must exist, not fit."""
    rest = F.regexp_replace(c, f"^(?i:{WEEKDAYS}), ", "")
    return F.when(c.rlike(f"^(?i:{WEEKDAYS}), "), F.try_to_timestamp(rest, F.lit("MMMM d, yyyy h:mm a")))


def sentences(c: Column) -> Column:
    """Parts after '.', '!' or '?' and white space, without empty ones."""
    parts = F.split(trimmed(c), r"(?<=[.!?])[\s\p{Z}]+", -1)
    return F.filter(F.transform(parts, trimmed), lambda x: x != "")


def token_count(c: Column) -> Column:
    """Tokens of the default counter: runs without white space. They are replaced by one sign each and these are counted, so no token becomes a string of its own."""
    return F.length(F.translate(F.regexp_replace(c, r"\s*\S+\s*", "x"), " \t\n\x0b\f\r", ""))


def first_tokens(c: Column, n: int) -> Column:
    """The text up to the end of its n-th token of the default counter."""
    return F.when(token_count(c) <= n, c).otherwise(F.regexp_extract(c, rf"^\s*(?:\S+\s+){{{n - 1}}}\S+", 0))


def speaker_headers(body: Column) -> Column:
    return F.regexp_extract_all(body, F.lit(SPEAKER_LINE), F.lit(1))


def speaker_role(header: Column) -> Column:
    return (
        F.when(header == "OperatorOperator", "Operator").when(header.endswith("Executive"), "Executive")
        .when(header.endswith("Analyst"), "Analyst").otherwise("Unknown")
    )


def speaker_name(header: Column) -> Column:
    return F.when(header == "OperatorOperator", F.lit("Operator")).otherwise(trimmed(F.regexp_replace(header, "(Executive|Analyst)$", "")))


def json_part(c: Column) -> Column:
    """The text if it is an object, else what lies between its outermost braces."""
    whole = trimmed(c)
    return F.when(F.get_json_object(whole, "$").isNotNull(), whole).otherwise(F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit("")))


def json_label(c: Column) -> Column:
    return F.from_json(json_part(c), "struct<label:string, reason:string>")


def label_in(answer: str | None) -> str | None:
    """What ``label`` of ``json_label`` gives for one answer, outside Spark: for a service that must be asked again."""
    said = (answer or "").strip()
    inner = re.search(r"\{.*\}", said, re.S)
    for part in (said, inner[0] if inner else ""):
        try:
            found = json.loads(part)
        except ValueError:
            continue
        low = str(found.get("label", "")).strip().lower() if isinstance(found, dict) else ""
        return next((full for full in ("negative", "neutral", "positive") if low in (full, full[:3])), None)
    return None


def message_content(response: Column) -> Column:
    return F.get_json_object(response, "$.choices[0].message.content")


def label(c: Column) -> Column:
    """negative, neutral or positive, or null."""
    low = F.lower(trimmed(c))
    return (
        F.when(low.isin("negative", "neg"), "negative").when(low.isin("neutral", "neu"), "neutral")
        .when(low.isin("positive", "pos"), "positive")
    )


def prompt(**fields: Column) -> Column:
    """One 'name: value' line for each field and then the text."""
    parts = [F.concat(F.lit(f"{k}: "), F.coalesce(v.cast("string"), F.lit(""))) for k, v in fields.items()]
    return F.concat_ws("\n", *parts)


def cut(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def css_top(style: Column) -> Column:
    return F.regexp_extract(style, r"top:\s*(-?[0-9]+(?:\.[0-9]+)?)px", 1).try_cast("double")


def first_line(c: Column) -> Column:
    return trimmed(F.get(F.split(as_text(c), "\n", -1), 0))


def joined_texts(texts: Column) -> Column:
    """Trimmed, without empty and repeated ones, in order, one a line."""
    return F.array_join(F.array_distinct(F.filter(F.transform(texts, as_text), lambda x: x != "")), "\n")
