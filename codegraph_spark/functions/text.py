"""Text measures and sanitizers."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def loc(content: Column) -> Column:
    """Lines that are not blank."""
    return F.size(F.filter(F.split(content, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[\t\r]", "")) != ""))


def content_sha256(content: Column) -> Column:
    return F.sha2(content, 256)


#: Marks that a text is cut at; a text that holds one itself gets a space in its place.
BEGIN, END = "\x01", "\x02"


def bind(value: Column, body) -> Column:
    """body(value) with value evaluated once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def upto_last(text: Column, ends: str) -> Column:
    """The text up to the last place where these characters occur in this order, with only themselves behind the first."""
    for c in reversed(ends):
        text = F.substring(text, F.lit(1), F.length(text) - F.length(F.substring_index(text, c, -1)))
    return F.concat(text, F.lit(ends[1:])) if ends[1:] else text


def marked(text: Column, pattern: str, over: str = "") -> Column:
    """The text with a mark before and behind every match, left to right; a plain text where nothing matches. over is passed
    over without a mark where the pattern doesn't match; neither captures."""
    clean = F.when(text.contains(BEGIN) | text.contains(END), F.translate(text, BEGIN + END, "  ")).otherwise(text)
    if not over:
        return F.regexp_replace(clean, pattern, f"{BEGIN}$0{END}")
    return F.replace(F.regexp_replace(clean, f"({pattern})|({over})", f"{BEGIN}$1{END}$2"), F.lit(BEGIN + END), F.lit(""))


def matches(text: Column, pattern: str, over: str = "") -> Column:
    """array<struct<line, text>> of a pattern's matches, line counted from one; linear in the text, however many there are. over as
    in marked()."""
    number = lambda x, i: F.replace(x, F.lit(BEGIN), F.concat(F.lit(BEGIN), (i + 1).cast("string"), F.lit(":")))
    part = lambda x: F.struct(F.substring_index(x, ":", 1).cast("int").alias("line"), F.regexp_extract(x, f"(?s)^\\d+:(.*?){END}", 1).alias("text"))

    def cut(m: Column) -> Column:
        numbered = F.array_join(F.transform(F.split(m, "\n"), number), "\n")
        return F.when(m.contains(BEGIN), F.transform(F.filter(F.split(numbered, BEGIN), lambda _, i: i > 0), part)).otherwise(F.array().cast("array<struct<line:int,text:string>>"))

    return bind(marked(text, pattern, over), cut)


def line_of_match(text: Column, pattern: str) -> Column:
    return F.transform(matches(text, pattern), lambda m: m["line"])


def lines_of_matches(text: Column, pattern: str, over: str = "", until: str = "") -> Column:
    """array<struct<line, n>>: lines on which matches begin, and how many do. over as in marked(); until: characters that all
    matches end with, in order, so that what is behind their last occurrence is left out."""
    count = lambda x, i: F.struct((i + 1).alias("line"), (F.length(x) - F.length(F.replace(x, F.lit(BEGIN), F.lit("")))).alias("n"))
    cut = lambda m: F.when(m.contains(BEGIN), F.filter(F.transform(F.split(m, "\n"), count), lambda x: x["n"] > 0)).otherwise(F.array().cast("array<struct<line:int,n:int>>"))
    return bind(marked(upto_last(text, until) if until else text, pattern, over), cut)


def snippet(lines: Column, line: Column, most: int | None = None) -> Column:
    """The trimmed line of a match, from a text's lines; cut with `...` beyond `most` characters where given."""
    s = F.trim(F.try_element_at(lines, line))
    return s if most is None else F.when(F.length(s) > most, F.concat(F.substring(s, 1, most), F.lit("..."))).otherwise(s)


#: A line up to a `//` that is in no quote; possessive, so long lines don't recurse.
_LINE_COMMENT = r"""(?m)^((?:"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+(?:"|$)|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+(?:'|$)|`[^`\\\n]*+(?:\\.[^`\\\n]*+)*+(?:`|$)|[^/"'`\n]++|/(?!/))*+)//.*$"""


def js_strip_comments(content: Column) -> Column:
    """Without block and line comments; the line feeds of block comments stay, so lines keep their numbers. Texts that hold no
    comment's begin are left as they are."""
    blocks = F.regexp_extract_all(content, F.lit(r"(?s)/\*.*?\*/"), F.lit(0))
    rest = F.split(content, r"(?s)/\*.*?\*/", -1)
    kept = F.concat(F.transform(blocks, lambda b: F.regexp_replace(b, r"[^\n]", "")), F.array(F.lit("")))
    plain = F.array_join(F.zip_with(rest, kept, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    some = content.contains("/*") | content.contains("//")
    return F.when(some, F.regexp_replace(plain, _LINE_COMMENT, "$1")).otherwise(content)


def strip_triple_quoted(content: Column) -> Column:
    return F.regexp_replace(content, r"""(?s)\"\"\".*?\"\"\"|'''.*?'''""", "\n")


_PY = re.compile(r'"""(?:[^\\]|\\.)*?(?:"""|\Z)|\'\'\'(?:[^\\]|\\.)*?(?:\'\'\'|\Z)|"[^"\\\n]*(?:\\.[^"\\\n]*)*(?:"|$)|\'[^\'\\\n]*(?:\\.[^\'\\\n]*)*(?:\'|$)|#[^\n]*', re.S | re.M)
_PY_COMMENT = re.compile(r"#[^\n]*")
_DART = re.compile(r'"""(?:[^\\]|\\.)*?(?:"""|\Z)|\'\'\'(?:[^\\]|\\.)*?(?:\'\'\'|\Z)|"[^"\\\n]*(?:\\.[^"\\\n]*)*(?:"|$)|\'[^\'\\\n]*(?:\\.[^\'\\\n]*)*(?:\'|$)|//[^\n]*|/\*.*?(?:\*/|\Z)', re.S | re.M)
_VISIBLE = re.compile(r"[^\n]")


def blank(text: str, pattern: re.Pattern, only: str = "") -> str:
    """Matches overwritten by spaces, line feeds kept: the length stays. only: blank just matches that begin so."""
    return pattern.sub(lambda m: _VISIBLE.sub(" ", m[0]) if m[0].startswith(only) else m[0], text)


@F.pandas_udf(StringType())
def py_blank_strings_comments(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else blank(t, _PY))


@F.pandas_udf(StringType())
def py_blank_comments(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else blank(t, _PY, "#"))


@F.pandas_udf(StringType())
def dart_blank_strings_comments(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else blank(t, _DART))


def default_export_summary(expression: Column) -> Column:
    """What a default export is, from its first words."""
    e = F.trim(expression)
    name = F.regexp_extract(e, r"^([A-Za-z_$][\w$]*)\s*;?$", 1)
    out = F.when(e.startswith("{"), F.lit("{...}")).when(e.startswith("["), F.lit("[...]")).when(e.startswith("("), F.lit("(...)"))
    return out.when(e.rlike(r"^(async\s+)?function\b"), F.lit("function")).when(e.rlike(r"^class\b"), F.lit("class")).when(name != "", name).otherwise(F.lit("expression"))
