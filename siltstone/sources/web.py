"""Sources of crawled pages: HTML to text, document links, relationship resolution, trace logs."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements that end a line of text, and elements whose content is no text.
_BLOCKS = frozenset("p div br li ul ol h1 h2 h3 h4 h5 h6 table tr section article header footer blockquote pre hr".split())
_SILENT = frozenset("script style noscript template".split())
# Leading zeros of a decimal reference; references beyond the last character, which the parser takes for integers of any length.
_ZEROS, _BEYOND = re.compile(r"&#0+(?=[0-9])"), re.compile(r"&#[0-9]{8,};?")


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.silent = 0

    def handle_starttag(self, tag, attrs):
        self.silent += tag in _SILENT
        if tag in _BLOCKS:
            self.parts.append("\n")
        elif tag in ("td", "th"):
            self.parts.append("\t")

    def handle_endtag(self, tag):
        self.silent -= tag in _SILENT and self.silent > 0
        if tag in _BLOCKS:
            self.parts.append("\n")

    def parse_marked_section(self, i, report=1):
        """A section without a known keyword, on which the base class raises, is a comment up to the next ``>`` as browsers read it."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.parse_bogus_comment(i, report)

    def handle_data(self, data):
        if not self.silent:
            self.parts.append(" ".join(data.split()) + (" " if data[-1:].isspace() else "") if data.strip() else " ")


def text_of_html(html: str | None) -> str | None:
    """Block-aware text: one line for each block, no blank lines, entities resolved, scripts and styles left out."""
    if html is None:
        return None
    parser = _Text()
    parser.feed(_BEYOND.sub("\ufffd", _ZEROS.sub("&#", html)))
    parser.close()
    lines = (" ".join(x.split(" ")).strip() for x in "".join(parser.parts).split("\n"))
    return "\n".join(" ".join(x.split()) if "\t" not in x else x for x in lines if x)


@F.pandas_udf(T.StringType())
def html_to_text(s: pd.Series) -> pd.Series:
    return s.map(text_of_html)


def document_links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, url, how): links to PDFs by href or bare address, each normalized address once for a page."""
    href = F.transform(F.regexp_extract_all(html, F.lit(r"""(?i)href\s*=\s*["']([^"']+\.pdf(?:\?[^"']*)?)["']"""), 1), lambda u: F.struct(F.lit(0).alias("o"), u.alias("url"), F.lit("href").alias("how")))
    bare = F.transform(F.regexp_extract_all(html, F.lit(r"""(?i)(https?://[^\s"'<>]+\.pdf)\b"""), 1), lambda u: F.struct(F.lit(1).alias("o"), u.alias("url"), F.lit("bare").alias("how")))
    found = pages.select(key, F.explode(F.concat(href, bare)).alias("l"))
    same = F.lower(F.regexp_replace(F.regexp_replace("l.url", r"^https?://", ""), r"[?#].*$", ""))
    return found.groupBy(key, same.alias("address")).agg(F.min("l").alias("m")).select(key, F.col("m.url").alias("url"), F.col("m.how").alias("how"))


def markdown_row(cells: Column) -> Column:
    """Cells of a table row as a markdown row, bars escaped."""
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.replace(F.coalesce(F.trim(c), F.lit("")), F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))


def resolve_relationships(nodes: DataFrame, included: DataFrame) -> DataFrame:
    """(id, field, labels): references of crawled nodes (id, refs: array<struct<field, type, target>>) to included rows (type, target, label)."""
    refs = nodes.select("id", F.posexplode("refs").alias("pos", "r")).select("id", "pos", "r.*")
    joined = refs.join(included, ["type", "target"])
    return joined.groupBy("id", "field").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "label"))), lambda s: s["label"]).alias("labels"))


def write_trace(events: DataFrame, folder: str) -> None:
    """Trace events as JSON lines, a folder a day."""
    events.withColumn("day", F.to_date("event_time")).write.mode("append").partitionBy("day").json(folder)
