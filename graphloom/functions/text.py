"""Tokens, digests and display forms of texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that no query is about.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in",
    "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with",
)


def tokens(text: Column) -> Column:
    """Parts of ASCII identifiers: split at underscores and inside camelCase, lower-case, without stop words and letters.

    A part is capitals followed by what is not one, so one pass finds it. An identifier does not begin with a digit, so
    digits count only inside one or after an underscore.
    """
    parts = F.regexp_extract_all(text, F.lit("[a-z][a-z0-9]+|[A-Z][a-z0-9]+|[A-Z]{2,}[a-z0-9]*|(?<=_)[0-9][a-z0-9]+"), F.lit(0))
    return F.filter(F.transform(parts, F.lower), lambda x: ~x.isin(*STOPWORDS))


def sha1_of(*parts: Column) -> Column:
    """SHA-1 of parts with NUL bytes between them; null is empty."""
    return F.sha1(F.encode(F.concat_ws("\0", *(F.coalesce(p, F.lit("")) for p in parts)), "utf-8"))


def fingerprint(rule: Column, path: Column, symbol: Column) -> Column:
    """Identity of a finding: it survives moves inside the file and changes of the measured values."""
    return sha1_of(rule, path, symbol)


def location(path: Column, line: Column) -> Column:
    return F.concat_ws(":", path, line.cast("string"))


def shorten(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def shorten_path(path: Column, limit: int) -> Column:
    """The end of a path, from a directory on if one fits."""
    tail = F.right(path, F.lit(limit - 3))
    at = F.instr(tail, "/")
    return F.when(F.length(path) > limit, F.concat(F.lit("..."), F.when(at > 0, F.substr(tail, at)).otherwise(tail))).otherwise(path)


def escape_html(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def escape_markdown(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def preview(text: Column, limit: int = 60) -> Column:
    """The first line that is not blank."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return shorten(F.coalesce(F.get(lines, F.lit(0)), F.lit("")), limit)


def iso_timestamp(text: Column) -> Column:
    """Instant of an ISO-8601 text; null if it is none."""
    return F.try_to_timestamp(text)
