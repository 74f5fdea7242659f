"""Running headers and footers of paged documents: found by their share of the pages or of one side, and removed.

Up to ``WINDOW`` neighbouring short lines are joined to one key of their letters a to z, so a line broken differently on each
page still agrees. A key is boilerplate on at least half of a document's pages, or on at least 70 % of one side's pages while
the other side has none, and on at least three pages in both cases.

Defined results: pages without text count as pages and keep their text; a document of fewer than ``LEAST_PAGES`` pages, or
without boilerplate, keeps its pages as they are; copies of a page count once; sides go by the page's place in its document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

LEAST_PAGES, LEAST_COUNT, WINDOW = 4, 3, 3
SHARE, SIDE_SHARE = 0.5, 0.7
SHORTEST_KEY, LONGEST_KEY, MOST_WORDS = 12, 90, 12

_NOT_LETTERS = re.compile("[^a-z]")
_BLANK_RUNS = re.compile(r"\n{3,}")


def eligible(lines: list[str]) -> list[tuple[int, str]]:
    """(index, key) of the short lines that are neither blank nor rows of a table."""
    short = ((i, x.strip()) for i, x in enumerate(lines))
    return [(i, _NOT_LETTERS.sub("", x.lower())) for i, x in short if x and not x.startswith("|") and len(x.split()) <= MOST_WORDS]


def window_keys(lines: list[tuple[int, str]]) -> Iterator[tuple[int, int, str]]:
    """(first, number of lines, key) of every run of up to ``WINDOW`` eligible lines whose key has a length within the limits."""
    for a in range(len(lines)):
        key = ""
        for n, (_, k) in enumerate(lines[a : a + WINDOW], 1):
            key += k
            if SHORTEST_KEY <= len(key) <= LONGEST_KEY:
                yield a, n, key


def without(text: str, keys: set[str]) -> str:
    """``text`` without the lines of the windows that have one of ``keys``."""
    lines = text.splitlines()
    short = eligible(lines)
    gone = {short[a + k][0] for a, n, key in window_keys(short) if key in keys for k in range(n)}
    return _BLANK_RUNS.sub("\n\n", "\n".join(x for i, x in enumerate(lines) if i not in gone)).strip()


@F.pandas_udf(T.ArrayType(T.StringType()))
def _keys(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: sorted({k for _, _, k in window_keys(eligible(x.splitlines()))}) if x else [])


@F.pandas_udf(T.StringType())
def _without(texts: pd.Series, keys: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else without(x, set(k)) for x, k in zip(texts, keys)], dtype=object)


def numbered(pages: DataFrame) -> DataFrame:
    """Distinct pages (document_id, page_id, page_number, text) with their side, 0 for the first page's, and the document's number of pages."""
    rows = pages.select("document_id", "page_id", "page_number", "text").where("document_id IS NOT NULL").distinct()
    order = Window.partitionBy("document_id").orderBy("page_number", "page_id")
    places = rows.select("document_id", "page_id", "page_number")
    places = places.withColumn("side", (F.row_number().over(order) - 1) % 2).withColumn("n", F.count("*").over(Window.partitionBy("document_id")))
    return rows.join(places.drop("page_number"), ["document_id", "page_id"])


def running_keys(pages: DataFrame) -> DataFrame:
    """(document_id, line_key, pages, side) of all boilerplate keys; side is both, recto or verso."""
    rows = numbered(pages).where(F.col("n") >= LEAST_PAGES)
    keys = rows.select("document_id", "side", "n", F.explode(_keys("text")).alias("line_key"))
    counts = keys.groupBy("document_id", "line_key", "n").agg(F.count_if(F.col("side") == 0).alias("recto"), F.count_if(F.col("side") == 1).alias("verso"))
    total = F.col("recto") + F.col("verso")
    whole = total >= SHARE * F.col("n")
    recto = (F.col("verso") == 0) & (F.col("recto") / F.ceil(F.col("n") / 2) >= SIDE_SHARE)
    verso = (F.col("recto") == 0) & (F.col("verso") / F.floor(F.col("n") / 2) >= SIDE_SHARE)
    side = F.when(whole, "both").when(recto, "recto").when(verso, "verso")
    return counts.where(total >= LEAST_COUNT).select("document_id", "line_key", total.alias("pages"), side.alias("side")).where("side IS NOT NULL")


def clean_pages(pages: DataFrame, keys: DataFrame) -> DataFrame:
    """(document_id, page_id, page_number, clean_text) of every page, also those of documents without boilerplate."""
    lists = keys.groupBy("document_id").agg(F.collect_set("line_key").alias("keys"))
    rows = pages.select("document_id", "page_id", "page_number", "text").distinct().join(lists, "document_id", "left")
    changed = rows.where("keys IS NOT NULL").select("document_id", "page_id", "page_number", _without("text", "keys").alias("clean_text"))
    return changed.unionByName(rows.where("keys IS NULL").select("document_id", "page_id", "page_number", F.col("text").alias("clean_text")))
