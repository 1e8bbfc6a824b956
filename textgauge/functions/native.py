"""Built-in expressions for rules where the JVM's character tables agree with Python's on the text at hand (ASCII, Latin)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_marks(c: Column) -> Column:
    return F.regexp_replace(c, r"[\p{P}\p{S}]", " ")


def one_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def join_comma_groups(c: Column) -> Column:
    return F.regexp_replace(c, r"(?<=\d),(?=\d)", "")


def join_point_groups(c: Column) -> Column:
    return F.regexp_replace(c, r"(?<=\d)\.(?=\d{3}(?!\d))", "")


def comma_to_point(c: Column) -> Column:
    return F.regexp_replace(c, r"(?<=\d),(?=\d)", ".")


def bare_ordinals(c: Column, endings: str) -> Column:
    return F.regexp_replace(c, rf"\b(\d+)(?:{endings})\b", "$1")


def thai_digits(c: Column) -> Column:
    return F.translate(c, "".join(chr(0x0E50 + d) for d in range(10)), "0123456789")


def fold_yo(c: Column) -> Column:
    return F.translate(c, "ё", "е")


def words(c: Column) -> Column:
    """Cut at single spaces; none for the empty text."""
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, " "))


def characters(c: Column) -> Column:
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, ""))


def simple_words(c: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, the cut used by the native scoring queries."""
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"))


def html_escape(c: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(mark), F.lit(name))
    return c


def percent_interval(rate: Column, lo: Column, hi: Column) -> Column:
    """"12.34 (11.00–13.50)", a dash where there is no rate."""
    return F.when(rate.isNull(), F.lit("—")).otherwise(F.format_string("%.2f (%.2f–%.2f)", rate * 100, lo * 100, hi * 100))
