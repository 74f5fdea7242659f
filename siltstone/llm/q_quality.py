"""p8: text quality statistics and kinds of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import quality
from siltstone.plans.materialise import cut


def p8_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All statistics and the kind of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stats = cut(quality.statistics(docs, "doc_id", F.col("text"), F.col("lang")))
    limits = quality.fit_limits(*quality.labelled_sample(stats, spark.read.parquet(f"{sf_dir}/text_label.parquet")))
    return quality.with_kind(stats, limits)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are not mainly prose: lists, tables and junk."""
    return p8_statistics(spark, sf_dir).where("text_kind <> 'prose'").select("doc_id").distinct()


QUERIES = {"p8_found": p8_found, "p8_statistics": p8_statistics}
SQL: dict[str, str] = {}
