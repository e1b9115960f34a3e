"""Column expressions on text: tokens, sentences, slugs, excerpts, markers, identifiers, digests."""

from __future__ import annotations

import hashlib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A run of letters, digits or underscore, or one other character that is no white space (the same in Java and RE2 syntax).
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}]"
WORD = r"[\p{L}\p{N}_]+"
#: A sentence ends before white space and a capital, digit, opening bracket or quote.
SENTENCE_BREAK = r'(?<=[.!?])\s+(?=[A-Z0-9\(\["“])'
CITATION = r"\[(\d+)\]"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(_c(c), F.lit(TOKEN), F.lit(0))


def token_count(c: Column | str) -> Column:
    return F.regexp_count(_c(c), F.lit(TOKEN))


def words(c: Column | str) -> Column:
    """Lower-cased words."""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit(WORD), F.lit(0))


def sentences(c: Column | str) -> Column:
    """Sentences of a text, blank ones dropped."""
    return F.filter(F.split(_c(c), SENTENCE_BREAK), lambda s: F.trim(s) != "")


def slug(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(_c(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def squeeze(c: Column | str) -> Column:
    """White space collapsed to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(_c(c), r"[\s\p{Z}]+", " "))


def question_key(c: Column | str) -> Column:
    return squeeze(F.lower(_c(c)))


def excerpt(c: Column | str, most: int = 240) -> Column:
    s = squeeze(c)
    return F.when(F.length(s) > most, F.concat(F.substring(s, 1, most), F.lit("..."))).otherwise(s)


def around(c: Column | str, subject: Column | str, radius: int = 60) -> Column:
    """The first case-insensitive match of a literal with ``radius`` characters about it; null without match."""
    c, subject = _c(c), subject if isinstance(subject, Column) else F.lit(subject)
    at = F.instr(F.lower(c), F.lower(subject))
    start = F.greatest(at - radius, F.lit(1))
    end = F.least(at + F.length(subject) + radius - 1, F.length(c))
    cut = F.concat(F.when(start > 1, F.lit("...")).otherwise(F.lit("")), c.substr(start, end - start + 1), F.when(end < F.length(c), F.lit("...")).otherwise(F.lit("")))
    return F.when(at > 0, cut)


def breadcrumb(title: Column | str, path: Column | str) -> Column:
    """``title > a > b``; the title is not repeated when the path begins with it, empty parts are skipped."""
    title, path = _c(title), F.coalesce(_c(path), F.array().cast("array<string>"))
    rest = F.when(F.get(path, F.lit(0)) == title, F.slice(path, 2, F.greatest(F.size(path), F.lit(1)))).otherwise(path)
    return F.array_join(F.filter(F.concat(F.array(title), rest), lambda x: x.isNotNull() & (x != "")), " > ")


def heading_depth(c: Column | str) -> Column:
    """Depth of a numbered heading (1.2.3 -> 3, six at most); null when not numbered."""
    number = F.regexp_extract(_c(c), r"^\s*(\d+(?:\.\d+)*)\.?\s", 1)
    return F.when(number != "", F.least(F.length(number) - F.length(F.replace(number, F.lit("."))) + 1, F.lit(6)))


def citation_markers(c: Column | str) -> Column:
    return F.transform(F.regexp_extract_all(_c(c), F.lit(CITATION), F.lit(1)), lambda x: x.cast("int"))


def uuid5(namespace_hex: str, name: Column) -> Column:
    """Name-based UUID (version 5) of a name in a namespace given as 32 hex digits."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    variant = F.element_at(F.array(*(F.lit(x) for x in "89ab")), ((F.instr(F.lit("0123456789abcdef"), F.substring(h, 17, 1)) - 1) % 4 + 1).cast("int"))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Keyed digest as hex, from two nested digests with the padded key."""
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    key = key.ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ p for b in key)) for p in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility-composed form; Spark has no built-in for it."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def normalize_text(c: Column | str, lines: bool = False) -> Column:
    """Compatibility form without soft hyphens, broken words joined, blanks collapsed, blank lines dropped; joined by blanks or, with ``lines``, by line feeds."""
    t = F.regexp_replace(F.regexp_replace(nfkc(_c(c)), "­", ""), "\r\n?", "\n")
    t = F.regexp_replace(t, r"(?<=\p{Ll})-\n(?=\p{Ll})", "")
    parts = F.transform(F.split(t, "\n"), lambda x: F.trim(F.regexp_replace(x, "[ \t  ​]+", " ")))
    return F.array_join(F.filter(parts, lambda x: x != ""), "\n" if lines else " ")


def canonical(*fields: str) -> Column:
    """The fields as JSON with sorted keys and no blanks; nulls are kept."""
    return F.to_json(F.struct(*(F.col(f) for f in sorted(fields))), {"ignoreNullFields": "false"})


def signature(*fields: str) -> Column:
    """Digest of the settings that a result was made with."""
    return F.substring(F.sha1(canonical(*fields)), 1, 12)


def is_page_number(c: Column | str) -> Column:
    """Whether a line is a page number alone: 12, page 12, 12 of 40, 12/40."""
    return F.trim(_c(c)).rlike(r"(?i)^(page\s+)?\d{1,4}(\s*(of|/)\s*\d{1,4})?$")
