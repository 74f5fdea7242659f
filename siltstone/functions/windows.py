"""Temporal phrases and date shapes to windows and days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _day(c: Column) -> Column:
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c).when(c.rlike(r"^\d{4}-\d{2}$"), F.concat(c, F.lit("-01"))).when(c.rlike(r"^\d{4}$"), F.concat(c, F.lit("-01-01"))).cast("date")


_DATE = r"(\d{4}(?:-\d{2}(?:-\d{2})?)?)"


def phrase_window(text: Column) -> Column:
    """'since 2010', 'until 2012-05', '2010 to 2013', 'between 2010 and 2013', 'in 2011', '2010-present' to struct(from, until), half-open."""
    t = F.lower(F.trim(text))
    g = lambda p, n=1: F.nullif(F.regexp_extract(t, p, n), F.lit(""))
    span = rf"^(?:between |from )?{_DATE}\s*(?:to|until|and|–|-)\s*{_DATE}$"
    since, until, single = rf"^(?:since|from|after) {_DATE}$", rf"^(?:until|before|till) {_DATE}$", r"^(?:in |during )?(\d{4})$"
    present = rf"^(?:from |since )?{_DATE}\s*(?:to|until|–|-)\s*(?:present|now|today)$"
    start = F.coalesce(_day(g(span)), _day(g(since)), _day(g(present)), _day(g(single)))
    end = F.coalesce(_day(g(span, 2)), _day(g(until)), F.add_months(_day(g(single)), 12))
    both = F.array(F.struct(start.alias("f"), end.alias("u")))  # a one-element array, so that the bounds are worked out once
    kept = F.transform(both, lambda x: F.when(F.coalesce(x["u"] <= x["f"], F.lit(False)), F.struct(F.lit(None).cast("date").alias("f"), F.lit(None).cast("date").alias("u"))).otherwise(x))
    return F.transform(kept, lambda x: F.struct(x["f"].alias("valid_from"), x["u"].alias("valid_until")))[0]


def pdf_day(text: Column) -> Column:
    """The day of a PDF date D:YYYYMMDD..., null if impossible."""
    digits = F.regexp_extract(text, r"^D:(\d{4})(\d{2})(\d{2})", 0)
    iso = F.concat_ws("-", F.substring(digits, 3, 4), F.substring(digits, 7, 2), F.substring(digits, 9, 2))
    return F.when(digits != "", F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).cast("date"))


def iso_prefix(text: Column) -> Column:
    """The instant of a value that begins like an ISO date and time; a bare date is its midnight."""
    head = F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2}:\d{2}))?", 0)
    full = F.when(F.length(head) == 10, F.concat(head, F.lit("T00:00:00"))).otherwise(F.replace(head, F.lit(" "), F.lit("T")))
    return F.when(head != "", F.try_to_timestamp(full, F.lit("yyyy-MM-dd'T'HH:mm:ss")))


def temporal_mode(question: Column) -> Column:
    q = F.lower(question)
    return (
        F.when(q.rlike(r"\b(between|from)\b.*\b(19|20)\d{2}\b.*\b(and|to)\b.*\b(19|20)\d{2}\b"), "range").when(q.rlike(r"\b(in|during) (19|20)\d{2}\b"), "point")
        .when(q.rlike(r"\b(upcoming|next|future)\b"), "upcoming").when(q.rlike(r"\b(past|previous|former|history|ended)\b"), "past").when(q.rlike(r"\b(current|now|today|present|latest)\b"), "current").otherwise("none")
    )
