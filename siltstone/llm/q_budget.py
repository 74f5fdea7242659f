"""p6: texts in containers of fixed capacity; p7: sources mixed to target shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import mixing, packing, tokens


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return packing.pack(tokens.with_token_counts(docs, [F.col("doc_id")], F.col("text")), "doc_id", "n_tokens")


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every text, or of every piece of a text larger than a container."""
    return _packed(spark, sf_dir).withColumnRenamed("item_id", "doc_id")


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the containers are filled."""
    return packing.fill_report(_packed(spark, sf_dir))


def _prepared(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("source IS NOT NULL")
    counted = tokens.with_token_counts(docs, [F.col("source"), F.col("doc_id"), F.sha2("text", 256).alias("text_key")], F.col("text"))
    return mixing.prepared(counted, spark.read.parquet(f"{sf_dir}/mix_target.parquet"))


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy of every text in the mixture."""
    texts, rates = _prepared(spark, sf_dir)
    return mixing.mix(texts, rates)


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source."""
    texts, rates = _prepared(spark, sf_dir)
    return mixing.report(rates, mixing.mix(texts, rates))


QUERIES = {f.__name__: f for f in (p6_containers, p6_fill, p7_mixture, p7_shares)}
SQL: dict[str, str] = {}
