"""p4: noise in the text of scanned pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import scans


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of page_content by document, and each reading of a first page in pdf_evidence as a document of its own."""
    content = spark.read.parquet(f"{sf_dir}/page_content.parquet")
    a = content.select(
        F.lit("page_content").alias("item_table"), F.col("page_id").alias("item_id"), F.coalesce("document_id", F.concat(F.lit("page "), F.col("page_id").cast("string"))).alias("document"),
        F.coalesce("page_number", F.lit(1)).alias("page"), "text",
    )
    evidence = spark.read.parquet(f"{sf_dir}/pdf_evidence.parquet")
    b = evidence.select(
        F.lit("pdf_evidence").alias("item_table"), F.col("evidence_id").alias("item_id"), F.concat(F.lit("evidence "), F.col("evidence_id").cast("string")).alias("document"),
        F.lit(1).alias("page"), F.col("head_text").alias("text"),
    )
    return a.unionByName(b)


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/catalog_document.parquet").select(F.col("document_id").alias("document"), "title")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each noisy line with the kind of its noise."""
    return scans.noisy_lines(_pages(spark, sf_dir), _titles(spark, sf_dir))[0]


def p4_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scanned document as continuous paragraphs."""
    pages = _pages(spark, sf_dir)
    _, corrections, labels = scans.noisy_lines(pages, _titles(spark, sf_dir))
    return scans.paragraphs(pages, labels, corrections)


QUERIES = {"p4_found": p4_found, "p4_paragraphs": p4_paragraphs}
SQL: dict[str, str] = {}
