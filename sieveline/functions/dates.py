"""Dates that come as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CURRENT = ("present", "current", "now", "till date", "to date", "ongoing", "today", "till now")
FORMATS = ("yyyy-MM-dd", "yyyy-MM", "MM/yyyy", "MMM yyyy", "MMMM yyyy", "yyyy", "MM-yyyy", "dd/MM/yyyy", "MM/dd/yyyy")


def day(text: Column) -> Column:
    """The first ten characters as a date; null if they aren't one."""
    return F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")


def whole_months(start: Column, end: Column) -> Column:
    """Difference of year and month, days ignored."""
    return (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)


def is_current(end: Column) -> Column:
    cleaned = plain(end)
    out = cleaned == ""
    for word in CURRENT:
        out = out | F.contains(cleaned, F.lit(word))
    return out


def plain(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"[,.()]", "")


def any_date(text: Column, now: Column) -> Column:
    """A date in one of the usual formats, or ``now`` for words like present; the end of a range counts."""
    cleaned = plain(text)
    last = F.trim(F.element_at(F.split(cleaned, r" to | - "), -1))
    parsed = F.coalesce(*(F.try_to_date(F.initcap(last), f) for f in FORMATS))
    return F.when(cleaned == "", None).when(is_current(text), now).otherwise(parsed)
