"""Text as columns: lines, words, truncation, and what is left of a line without strings and comments."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BODY = 8000
CUT_MARK = "\n/* ... cut ... */"
#: Full text knows a word as a run of letters, digits and _.
WORD = r"[\p{L}\p{N}_]+"


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def line_window(c: Column, first: int, n: int) -> Column:
    """Lines first to first + n - 1 (from 1 on)."""
    return F.slice(F.split(c, "\n"), first, n)


def line_of(text: Column, at: Column) -> Column:
    """Number of the line that holds the character at (from 1 on)."""
    head = F.substring(text, F.lit(1), at - 1)
    return (F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1).cast("long")


def cut_utf8(raw: bytes, most: int) -> bytes:
    """At most `most` bytes, no character split; at the last line end where that is past three quarters."""
    if len(raw) <= most:
        return raw
    cut = raw.rfind(b"\n", 0, most)
    if cut <= most * 3 // 4:
        cut = most
        while cut and raw[cut] & 0xC0 == 0x80:
            cut -= 1
    return raw[:cut]


@F.pandas_udf(T.StringType())
def _cut(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t is None else cut_utf8(t.encode(), MAX_BODY).decode() + CUT_MARK)


def stored_body(c: Column) -> Column:
    """A body as it is stored: of at most MAX_BODY bytes, and a mark where it was cut. Only longer bodies reach Python."""
    long = F.octet_length(c) > MAX_BODY
    return F.when(long, _cut(F.when(long, c))).otherwise(c)


_C_LITERALS = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?", re.S)


def blank_literals(source: str) -> str:
    """source with strings and comments as blanks: every character keeps its place, line ends stay."""
    return _C_LITERALS.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)


def strip_json_comments(text: str) -> str:
    """JSON out of JSON with comments and trailing commas."""
    out = re.sub(r"(\"(?:\\.|[^\"\\])*\")|//[^\n]*|/\*.*?\*/", lambda m: m[1] or "", text, flags=re.S)
    return re.sub(r"(\"(?:\\.|[^\"\\])*\")|,(?=\s*[}\]])", lambda m: m[1] or "", out)
