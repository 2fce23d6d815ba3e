"""Dates, periods, scores and percentages. Missing values are null inside; text is made at the report's edge."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspan.functions.text import BLANK, strip

#: Decimal digits of all scripts but ASCII, and what they stand for.
_DIGITS = [c for c in map(chr, range(0x80, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd"]
_WIDE, _PLAIN = "".join(_DIGITS) + "／．－", "".join(str(unicodedata.digit(c)) for c in _DIGITS) + "/.-"
_DAY = r"([0-9]{4})[/.\-]([0-9]{1,2})[/.\-]([0-9]{1,2})"


def parse_date(text: Column) -> Column:
    """The first ``Y/M/D`` anywhere, also with points or hyphens and in any script's digits; an impossible day is null."""
    own = F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), f"[{BLANK}]+", ""), _WIDE, _PLAIN)
    part = [F.regexp_extract(own, _DAY, i) for i in (1, 2, 3)]
    return F.try_to_date(F.concat_ws("-", part[0], F.lpad(part[1], 2, "0"), F.lpad(part[2], 2, "0")), "yyyy-MM-dd")


def format_date(day: Column, missing: str = "-") -> Column:
    return F.coalesce(F.date_format(day, "yyyy/MM/dd"), F.lit(missing))


def parse_period(text: Column, separators: str = r"~〜～∼\-") -> Column:
    """``start, end, text``: two dates, one with a separator before or after it, or a single day.

    The hyphen separates too, so dates written with hyphens need other ``separators``.
    """
    own = strip(F.coalesce(text, F.lit("")))
    parts = F.split(own, f"[{separators}]+", 2)
    first, second = parse_date(parts[0]), parse_date(F.get(parts, F.lit(1)))
    single = F.size(parts) == 1
    return F.struct(first.alias("start"), F.when(single, first).otherwise(second).alias("end"), own.alias("text"))


def is_current(today: Column, start: Column, end: Column) -> Column:
    """Whether ``today`` lies in the period; false when a bound is missing."""
    return F.coalesce(today.between(start, end), F.lit(False))


def parse_score(text: Column) -> Column:
    """``score, max, rate`` of ``a / b`` anywhere; the rate in percent with one decimal, none when the maximum is 0."""
    pattern = r"([0-9]+(?:\.[0-9]+)?)\s*[/／]\s*([0-9]+(?:\.[0-9]+)?)"
    own = F.coalesce(text, F.lit(""))
    a, b = (F.regexp_extract(own, pattern, i).try_cast("double") for i in (1, 2))
    return F.struct(a.alias("score"), b.alias("max"), pct(a, b).alias("rate"))


def pct(part: Column, total: Column) -> Column:
    """Percent with one decimal, ties to even; null when the total is 0 or missing."""
    return F.when(total > 0, F.bround(part / total * 100, 1))


def number_text(value: Column, missing: str = "-") -> Column:
    """A number as text, whole ones without a decimal."""
    return F.coalesce(F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string")), F.lit(missing))


def pct_text(part: Column, total: Column, missing: str = "-") -> Column:
    """The percentage as text, whole numbers without a decimal."""
    return number_text(pct(part, total), missing)
