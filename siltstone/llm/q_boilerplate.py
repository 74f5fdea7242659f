"""p3: lines repeated across the documents of one source, or the sections of one bundle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import boilerplate
from siltstone.plans.materialise import broadcast_if_small, cut, without_copies


BY = ("item_table", "group")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/canonical_section.parquet").select("section_id", "document_id", "text")


def _bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, bundle), without documents of no bundle."""
    catalog = spark.read.parquet(f"{sf_dir}/catalog_document.parquet").groupBy("document_id").agg(F.min("bundle").alias("bundle"))
    return broadcast_if_small(cut(catalog.where("bundle IS NOT NULL")))


def _identified(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Arrays of line identifiers of documents by source and of sections by bundle; each text is read once."""
    ids = boilerplate.line_ids(F.col("text"))
    docs = _documents(spark, sf_dir).withColumn("item_table", F.lit("documents"))
    docs = cut(boilerplate.identified(docs, "source", "doc_id", "doc_id", ids, keep=("item_table",)))
    sections = cut(_sections(spark, sf_dir).where("document_id IS NOT NULL").select("section_id", "document_id", ids.alias("ids")))
    sections = sections.join(_bundles(spark, sf_dir), "document_id").withColumn("item_table", F.lit("canonical_section"))
    return docs, cut(boilerplate.identified(sections, "bundle", "document_id", "section_id", F.col("ids"), keep=("item_table",)))


def _mined(spark: SparkSession, sf_dir: str) -> boilerplate.Sequences:
    docs, sections = _identified(spark, sf_dir)
    lines = boilerplate.frequent_lines(docs, BY, one_row_a_document=True).unionByName(boilerplate.frequent_lines(sections, BY))
    return boilerplate.Sequences(docs.unionByName(sections), lines, BY)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line that lies in an occurrence of a frequent sequence of its source or bundle, single lines included."""
    return _mined(spark, sf_dir).marks().select("item_table", "item_id", "line_no").distinct()


def p3_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest frequent sequences of lines of each source (item_table documents) and each bundle (canonical_section)."""
    return _mined(spark, sf_dir).sequences()


def p3_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents and canonical_section without the repeated lines of its source or bundle."""
    docs, sections = _identified(spark, sf_dir)
    a = boilerplate.remove_lines(_documents(spark, sf_dir), "source", "text", boilerplate.frequent_lines(docs, BY, one_row_a_document=True))
    whole = without_copies(_sections(spark, sf_dir), "section_id").join(_bundles(spark, sf_dir), "document_id", "left")
    b = boilerplate.remove_lines(whole, "bundle", "text", boilerplate.frequent_lines(sections, BY))
    a = a.select(F.lit("documents").alias("item_table"), F.col("doc_id").alias("item_id"), F.col("source").alias("group"), "clean_text")
    return a.unionByName(b.select(F.lit("canonical_section").alias("item_table"), F.col("section_id").alias("item_id"), F.col("bundle").alias("group"), "clean_text"))


QUERIES = {f.__name__: f for f in (p3_found, p3_sequences, p3_clean)}

_LETTERS = r"lower(regexp_replace(line, '[^\p{L}]+', '', 'g'))"


def _marked(table: str, item: str, rows: str) -> str:
    return f"""(WITH rows_ AS ({rows}),
lines AS (SELECT g, d, item, i AS line_no, string_split(t, chr(10))[i] AS line FROM (SELECT *, unnest(generate_series(1, len(string_split(t, chr(10))))) AS i FROM rows_)),
keyed AS (SELECT g, d, item, line_no, {_LETTERS} AS k FROM lines),
sizes AS (SELECT g, count(DISTINCT d) AS n FROM rows_ GROUP BY g),
often AS (SELECT g, k FROM (SELECT g, k, count(DISTINCT d) AS s FROM keyed WHERE k <> '' GROUP BY g, k) JOIN sizes USING (g) WHERE s >= 5 AND s >= 0.03 * n)
SELECT '{table}' AS item_table, item AS item_id, CAST(line_no AS BIGINT) AS line_no FROM keyed JOIN often USING (g, k))"""


SQL = {
    "p3_found": _marked("documents", "doc_id", "SELECT source AS g, doc_id AS d, doc_id AS item, text AS t FROM documents WHERE source IS NOT NULL")
    + " UNION ALL "
    + _marked(
        "canonical_section",
        "section_id",
        "SELECT DISTINCT c.bundle AS g, document_id AS d, section_id AS item, text AS t FROM canonical_section JOIN (SELECT document_id, min(bundle) AS bundle FROM catalog_document GROUP BY 1) c USING (document_id) WHERE c.bundle IS NOT NULL",
    ),
}
