"""Text functions. Columns of built-in functions where Spark has them; vectorised Arrow
functions for Unicode normal forms, HTML entities and escapes, which it lacks."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


@F.pandas_udf(StringType())
def html_unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


_U = re.compile(r"\\u([0-9a-fA-F]{4})")


@F.pandas_udf(StringType())
def decode_escapes(s: pd.Series) -> pd.Series:
    r"""Literal \uXXXX sequences, surrogate pairs included, as characters."""

    def one(x: str) -> str:
        y = _U.sub(lambda m: chr(int(m[1], 16)), x)
        return y.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if y != x else x

    return s.map(one, na_action="ignore")


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|(?U)\s+\z", "")


def squeeze(c: Column) -> Column:
    return F.btrim(F.regexp_replace(c, r"(?U)\s+", " "), F.lit(" "))


def strip_tags(c: Column) -> Column:
    return squeeze(F.regexp_replace(c, r"<[^>]+>", " "))


def plain_page(html: Column) -> Column:
    """A page as plain text: scripts, styles, comments and tags out, entities decoded."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    return squeeze(html_unescape(strip_tags(bare)))


def split_last(c: Column, sep: str = ", ") -> tuple[Column, Column]:
    """Before and after the last separator; without one, the whole text twice."""
    after = F.substring_index(c, sep, -1)
    before = F.when(F.contains(c, F.lit(sep)), F.substr(c, F.lit(1), F.length(c) - F.length(after) - len(sep))).otherwise(c)
    return before, after


def whole(c: Column, pattern: str) -> Column:
    """Whether the pattern matches the whole text, a last newline included."""
    return F.rlike(c, F.lit(rf"\A(?:{pattern})\z"))


def tokens(c: Column, pattern: str, stop: tuple[str, ...] = ()) -> Column:
    found = F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(*stop)) if stop else found


def word_count(c: Column) -> Column:
    bare = strip(c)
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, r"(?U)\s+")))


def surface(c: Column) -> dict[str, Column]:
    """Eleven surface statistics of a text."""
    n = lambda p: F.regexp_count(c, F.lit(p))
    letters = n(r"\p{L}")
    return {
        "chars": F.log1p(F.length(c).cast("double")),
        "words": F.log1p(word_count(c).cast("double")),
        "exclamations": n("!"),
        "questions": n(r"\?"),
        "caps_runs": n(r"\b[A-Z]{3,}\b"),
        "elongations": n(r"(\p{L})\1{2,}"),
        "hashtags": n(r"#\w+"),
        "mentions": n(r"@\w+"),
        "urls": n(r"https?://\S+"),
        "digits": n(r"\d"),
        "upper_share": F.try_divide(n(r"\p{Lu}"), letters),
    }


EMOTICONS = {"happy": r"[:;=]-?[)D]", "sad": r"[:;=]-?[(]", "love": r"<3"}


def normalise(c: Column) -> Column:
    """A post as comparable text: tags and links out, mentions and numbers as tokens,
    repeated punctuation and letters shortened, white space squeezed, lower case."""
    for pattern, to in (
        (r"<[^>]+>", " "),
        (r"https?://\S+|www\.\S+", " url "),
        (r"(?i)^rt\s+@\w+:?", " "),
        (r"@\w+", " user "),
        *((p, f" {name} ") for name, p in EMOTICONS.items()),
        (r"(?<=[a-z])(?=[A-Z])(?<=#\w{1,60})", " "),
        (r"#", " "),
        (r"\d+(?:[.,]\d+)*", " num "),
        (r"([!?.,])\1+", "$1"),
        (r"(\p{L})\1{2,}", "$1$1"),
    ):
        c = F.regexp_replace(c, pattern, to)
    return F.lower(squeeze(c))


def ngrams(words: Column, n: int) -> Column:
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def substrings(c: Column, lo: int, hi: int) -> Column:
    """The distinct substrings of lo..hi characters."""

    def of(n: int) -> Column:
        return F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substr(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    each = [of(n) for n in range(lo, hi + 1)]
    return F.array_distinct(F.flatten(F.array(*each)))


def letter_substrings(c: Column, lo: int, hi: int) -> Column:
    """The distinct substrings of lo..hi characters that are letters only, from each
    distinct run of letters."""
    runs = F.array_distinct(F.regexp_extract_all(c, F.lit(r"\p{L}+"), F.lit(0)))
    return F.array_distinct(F.flatten(F.transform(runs, lambda w: substrings(w, lo, hi))))


UNIT_HOURS = {"minute": 1 / 60, "min": 1 / 60, "hour": 1.0, "hr": 1.0, "day": 24.0, "week": 168.0, "month": 720.0}


def longest_hours(c: Column, most: float = 9600.0, units: dict[str, float] = UNIT_HOURS) -> Column:
    """The longest duration that the text states, in hours, none above `most`."""
    pattern = rf"(\d+(?:\.\d+)?)\s*({'|'.join(sorted(units, key=len, reverse=True))})s?\b"
    table = F.create_map(*[F.lit(x) for pair in units.items() for x in pair])
    found = F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(0))
    hours = F.transform(found, lambda x: F.regexp_extract(x, pattern, 1).try_cast("double") * F.element_at(table, F.regexp_extract(x, pattern, 2)))
    return F.array_max(F.filter(hours, lambda h: h <= most))


def stable_id(*parts: Column, length: int = 20) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, length)


def half(digest: Column, parts: int = 2) -> Column:
    """The part 0.. that a hex digest falls in."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % parts
