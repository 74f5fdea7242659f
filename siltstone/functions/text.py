"""String functions: name normalization, slugs, tests of wording, extraction of terms, editions, numbers and markers."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Titles before and letters after personal names.
HONORIFICS = ("dr", "mr", "mrs", "ms", "prof", "professor", "sir", "shri", "smt")
POST_NOMINALS = ("phd", "md", "jr", "sr", "msc", "mba")
# Legal forms written out.
LEGAL_FORMS = {"ltd": "limited", "pvt": "private", "inc": "incorporated", "corp": "corporation", "co": "company", "intl": "international", "univ": "university", "inst": "institute", "dept": "department", "govt": "government"}
# Words that carry no topic.
STOP_WORDS = tuple("a an and are as at be by do does for from has have how in is it its of on or that the their there these they this to was were what when where which who why will with".split())
# Fixed value: characters of a stored facet value.
FACET_WIDTH = 255


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def fold_name(c: Column) -> Column:
    """Type-agnostic form: lower case, points between letters and punctuation to spaces, apostrophes dropped (ASCII)."""
    return collapse(F.regexp_replace(F.regexp_replace(F.lower(c), "['’`]", ""), r"[^\p{L}\p{N}]+", " "))


@F.pandas_udf(T.StringType())
def fold_name_unicode(s: pd.Series) -> pd.Series:
    """``fold_name`` with compatibility decomposition, combining marks removed and full case folding."""

    def one(x: str | None) -> str | None:
        if x is None:
            return None
        x = "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)).casefold()
        x = "".join("" if c in "'’`" else c if c.isalnum() else " " for c in x)
        return " ".join(x.split())

    return s.map(one)


def person(c: Column) -> Column:
    """Folded name without leading honorifics, trailing post-nominals and digits stuck to the last word."""
    x = F.regexp_replace(fold_name(c), rf"^(?:(?:{'|'.join(HONORIFICS)}) )+", "")
    x = F.regexp_replace(x, rf"(?: (?:{'|'.join(POST_NOMINALS)}))+$", "")
    return F.regexp_replace(x, r"(\p{L})\d+$", "$1")


def organization(c: Column) -> Column:
    """Folded name, & as and, legal forms written out word by word."""
    words = F.split(fold_name(F.replace(c, F.lit("&"), F.lit(" and "))), " ")
    full = F.transform(words, lambda w: F.coalesce(*[F.when(w == k, v) for k, v in LEGAL_FORMS.items()], w))
    return F.array_join(full, " ")


def project(c: Column) -> Column:
    return F.regexp_replace(fold_name(c), r"^(?:the|a|an) ", "")


def joined_names(c: Column) -> Column:
    """Names joined by a comma without a space after it; the whole value where there is no such comma."""
    parts = F.filter(F.transform(F.split(c, r",(?=\S)"), F.trim), lambda x: x != "")
    return F.when(F.size(parts) > 1, parts).otherwise(F.array(F.trim(c)))


def initials(c: Column) -> Column:
    return F.array_join(F.transform(F.filter(F.split(fold_name(c), " "), lambda w: w != ""), lambda w: F.substring(w, 1, 1)), "")


def initials_only(c: Column) -> Column:
    words = F.filter(F.split(fold_name(c), " "), lambda w: w != "")
    last = F.element_at(words, -1)
    return (F.size(words) > 1) & F.forall(F.slice(words, 1, F.size(words) - 1), lambda w: F.length(w) == 1) & (F.length(last) > 1)


def acronym(c: Column, skip: tuple[str, ...] = STOP_WORDS) -> Column:
    words = F.filter(F.split(fold_name(c), " "), lambda w: (w != "") & ~w.isin(*skip))
    return F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def predicate_name(c: Column) -> Column:
    """A relation in words as UPPER_SNAKE."""
    return F.upper(F.regexp_replace(F.regexp_replace(F.trim(c), "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))


def literal_key(c: Column) -> Column:
    return F.lower(collapse(c))


def content_terms(c: Column, least: int = 3) -> Column:
    words = F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), 0)
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(*STOP_WORDS)))


def key_terms(c: Column) -> Column:
    """Quoted phrases, capitalized pairs, words with digits, acronyms and years; prefixes of other terms dropped."""
    patterns = [(r'"([^"]+)"', 1), (r"\b[A-Z][a-z]+ [A-Z][a-z]+\b", 0), (r"\b[A-Za-z]+[0-9][A-Za-z0-9.]*\b", 0), (r"\b[A-Z]{2,}\b", 0), (r"\b(?:19|20)[0-9]{2}\b", 0)]
    found = F.array_distinct(F.concat(*[F.regexp_extract_all(c, F.lit(p), g) for p, g in patterns]))
    return F.filter(found, lambda t: ~F.exists(found, lambda o: (o != t) & F.startswith(o, F.concat(t, F.lit(" ")))))


def stored_values(values: Column, width: int = FACET_WIDTH) -> Column:
    """Distinct values as they are stored, in order: empty ones dropped, cut to ``width`` first, made distinct second."""
    return F.array_distinct(F.transform(F.filter(values, lambda x: x != ""), lambda x: F.substring(x, 1, width)))


def editions(c: Column) -> Column:
    """Fiscal editions like 2024-25 (end is start + 1), in canonical form and order of appearance."""
    years = F.regexp_extract_all(c, F.lit(r"\b(20[0-3][0-9])\s*[-–/]\s*(?:20)?([0-9]{2})\b"), 0)
    start = lambda x: F.substring(x, 1, 4).cast("int")
    end = lambda x: F.substring(x, -2, 2).cast("int")
    good = F.filter(years, lambda x: (end(x) == (start(x) + 1) % 100) & (start(x) <= 2030))
    return F.array_distinct(F.transform(good, lambda x: F.concat(F.substring(x, 1, 4), F.lit("-"), F.substring(x, -2, 2))))


def years_in(c: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"\b((?:19|20)[0-9]{2})\b"), 1), lambda y: y.cast("int")))


def markers(c: Column) -> Column:
    """Citation markers [n] of an answer, in order."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"\[([0-9]{1,3})\]"), 1), lambda x: x.cast("int"))


def numbers(c: Column) -> Column:
    """Numbers as written, thousands separators removed."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?"), 0), lambda x: F.replace(x, F.lit(","), F.lit(""))))


def sentences(c: Column) -> Column:
    return F.filter(F.split(collapse(c), r"(?<=[.!?]) "), lambda s: s != "")


def number_soup(line: Column) -> Column:
    """A line of mostly numbers: at least four, and more than half of its words."""
    words = F.filter(F.split(F.trim(line), r"\s+"), lambda w: w != "")
    n = F.size(F.filter(words, lambda w: w.rlike(r"^[-+(]?[0-9][0-9.,%)]*$")))
    return (n >= 4) & (n * 2 > F.size(words))


def uuid5(namespace: str, name: Column) -> Column:
    """Name-based UUID (SHA-1) of ``name`` in a namespace given as 32 hex digits."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(0x3F).bitwiseOR(0x80)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))


@F.pandas_udf(T.DoubleType())
def name_score(a: pd.Series, b: pd.Series) -> pd.Series:
    """Fuzzy likeness of two folded names: best of sequence ratio, sorted-word ratio and containment; 1 if equal."""

    def one(x: str | None, y: str | None) -> float | None:
        if x is None or y is None:
            return None
        if x == y:
            return 1.0
        ratio = difflib.SequenceMatcher(None, x, y).ratio()
        ordered = difflib.SequenceMatcher(None, " ".join(sorted(x.split())), " ".join(sorted(y.split()))).ratio()
        short, long = sorted((x, y), key=len)
        inside = 0.5 + 0.5 * len(short) / len(long) if short and short in long else 0.0
        return max(ratio, ordered, inside)

    return pd.Series([one(x, y) for x, y in zip(a, b)])


def band(top: Column, runner_up: Column) -> Column:
    """accept at 0.90, or at 0.60 with a lead of 0.30; else ambiguous from 0.60, else miss."""
    lead = top - F.coalesce(runner_up, F.lit(0.0))
    return F.when((top >= 0.9) | ((top >= 0.6) & (lead >= 0.3)), "accept").when(top >= 0.6, "ambiguous").otherwise("miss")
