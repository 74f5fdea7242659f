"""Dates of partial precision and validity windows, as column expressions.

Windows are half-open [from, until). Three rules for missing bounds are kept apart: ``overlaps`` (both bounds missing is
unknown and overlaps nothing), ``history_overlap`` (missing bounds are open) and ``as_of`` (missing bounds are open).
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

FIRST, LAST = "0001-01-01", "9999-12-31"


def floor_date(value: Column, precision: Column) -> Column:
    """The first day of the year or month the date stands for; unknown precision is day."""
    d = value.cast("date")
    return F.when(precision == "year", F.trunc(d, "year")).when(precision == "month", F.trunc(d, "month")).otherwise(d)


def period_in_scope(start: Column, start_precision: Column, end: Column, end_precision: Column, lo: date | None, hi: date | None, open_ended: Column | None = None) -> Column:
    """Does a document's period meet [lo, hi)? Bounds are floored to the precision of the date they are held against."""
    s, e = start.cast("date"), end.cast("date")
    ok = s.isNotNull()
    if hi is not None:
        ok = ok & (s < F.lit(hi))
    if lo is not None:
        bound = lambda p: floor_date(F.lit(lo), p)
        closed = e.isNotNull() & (e >= bound(end_precision))
        no_end = e.isNull() & (s >= bound(start_precision))
        ok = ok & (closed | no_end | (open_ended if open_ended is not None else F.lit(False)))
    return F.coalesce(ok, F.lit(False))


def overlaps(a_from: Column, a_until: Column, b_from: Column, b_until: Column) -> Column:
    known = (a_from.isNotNull() | a_until.isNotNull()) & (b_from.isNotNull() | b_until.isNotNull())
    meet = (F.coalesce(a_from, F.lit(FIRST).cast("date")) < F.coalesce(b_until, F.lit(LAST).cast("date"))) & (F.coalesce(b_from, F.lit(FIRST).cast("date")) < F.coalesce(a_until, F.lit(LAST).cast("date")))
    return known & meet


def precedes(a_until: Column, b_from: Column) -> Column:
    return F.coalesce(a_until <= b_from, F.lit(False))


def history_overlap(valid_from: Column, valid_until: Column, lo: date | None, hi: date | None) -> Column:
    """Window test of graph traversals: each bound is optional on both sides."""
    ok = F.lit(True)
    if hi is not None:
        ok = ok & (valid_from.isNull() | (valid_from < F.lit(hi)))
    if lo is not None:
        ok = ok & (valid_until.isNull() | (valid_until > F.lit(lo)))
    return ok


def as_of(valid_from: Column, valid_until: Column, day: date) -> Column:
    return (valid_from.isNull() | (valid_from <= F.lit(day))) & (valid_until.isNull() | (valid_until > F.lit(day)))


def present_fact(status: Column, basis: Column) -> Column:
    """Only active claims whose time is stated or taken from the subject's period speak for the present."""
    return (status == "active") & basis.isin("stated", "subject_period")


def exclusive_end(inclusive: Column) -> Column:
    return F.date_add(inclusive, 1)


def inclusive_end(exclusive: Column) -> Column:
    return F.date_sub(exclusive, 1)


def label(value: Column, precision: Column) -> Column:
    """Date as text, no more precise than it is known."""
    text = F.date_format(value, "yyyy-MM-dd")
    return F.when(precision == "year", F.substring(text, 1, 4)).when(precision == "month", F.substring(text, 1, 7)).otherwise(text)


def partial_iso(text: Column) -> Column:
    """YYYY, YYYY-MM or YYYY-MM-DD within 1800..2200 to its first day, else null."""
    padded = F.when(text.rlike(r"^\d{4}$"), F.concat(text, F.lit("-01-01"))).when(text.rlike(r"^\d{4}-\d{2}$"), F.concat(text, F.lit("-01"))).when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text)
    day = F.try_to_date(padded, "yyyy-MM-dd")
    return F.when(F.year(day).between(1800, 2200), day)
