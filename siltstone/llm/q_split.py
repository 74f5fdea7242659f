"""p2: oversized texts cut into overlapping pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import split
from siltstone.plans.materialise import without_copies

LIMIT, PARENT_LIMIT, OVERLAP = 512, 2400, 60


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/canonical_section.parquet").select("section_id", "heading", "text")


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/qdrant_point.parquet")
    limit = F.when(F.col("payload.is_parent"), PARENT_LIMIT).otherwise(LIMIT)
    return rows.select("chunk_id", F.lit(None).cast("string").alias("heading"), F.col("payload.chunk_text").alias("text"), limit.alias("words"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts over their limit: those the operator cuts."""
    a = split.oversized(_sections(spark, sf_dir), "section_id", F.col("text"), LIMIT, [LIMIT], OVERLAP)
    b = split.oversized(_points(spark, sf_dir), "chunk_id", F.col("text"), F.col("words"), [LIMIT, PARENT_LIMIT], OVERLAP)
    return a.select(F.lit("canonical_section").alias("item_table"), "item_id").unionByName(b.select(F.lit("qdrant_point").alias("item_table"), "item_id"))


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every text, with its text and the heading of its section; null for points. Copies of a row count once."""
    a = split.pieces(without_copies(_sections(spark, sf_dir), "section_id"), "section_id", F.col("text"), LIMIT, [LIMIT], OVERLAP, keep=("heading",))
    b = split.pieces(without_copies(_points(spark, sf_dir), "chunk_id"), "chunk_id", F.col("text"), F.col("words"), [LIMIT, PARENT_LIMIT], OVERLAP, keep=("heading",))
    return a.withColumn("item_table", F.lit("canonical_section")).unionByName(b.withColumn("item_table", F.lit("qdrant_point")))


QUERIES = {"p2_found": p2_found, "p2_pieces": p2_pieces}


def _words(text: str) -> str:
    return f"len(regexp_extract_all({text}, '[^{split.WHITE}]+'))"


SQL = {
    "p2_found": f"""
SELECT DISTINCT 'canonical_section' AS item_table, section_id AS item_id FROM canonical_section WHERE {_words('text')} > {LIMIT}
UNION ALL
SELECT DISTINCT 'qdrant_point' AS item_table, chunk_id AS item_id FROM qdrant_point
WHERE {_words('payload.chunk_text')} > CASE WHEN payload.is_parent THEN {PARENT_LIMIT} ELSE {LIMIT} END""",
}
