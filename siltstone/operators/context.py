"""Assembly of a context from ranked candidates: slots by source, reranking of the head, a corrective second pass, block numbers.

Candidates are rows (query_id, chunk_id, rank, ...); every operator works for all queries at once, in windows over the
candidates of one query, which are some dozens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.operators.retrieval import rrf

HEAD = 40


def slots(ranked: DataFrame, kind: Column, most: dict[str, int], floor: dict[str, int], size: int) -> DataFrame:
    """At most ``most`` candidates of each kind, the first ``floor`` of a kind before all others, ``size`` in all.

    Result: query_id, chunk_id, kind, block (number from 1, in the order of ranks). Kinds without a limit take no slot.
    """
    by_kind = Window.partitionBy("query_id", "kind").orderBy("rank", "chunk_id")
    rows = ranked.withColumn("kind", kind).withColumn("at", F.row_number().over(by_kind))
    limit = lambda of: F.coalesce(*[F.when(F.col("kind") == k, n) for k, n in of.items()], F.lit(0))
    rows = rows.where(F.col("at") <= limit(most)).withColumn("reserved", F.col("at") <= limit(floor))
    first = Window.partitionBy("query_id").orderBy(F.desc("reserved"), "rank", "chunk_id")
    rows = rows.withColumn("seat", F.row_number().over(first)).where(F.col("seat") <= size)
    return rows.select("query_id", "chunk_id", "kind", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "chunk_id")).alias("block"))


def rerank_head(ranked: DataFrame, score: Column, head: int = HEAD) -> DataFrame:
    """(query_id, chunk_id, place): the first ``head`` candidates in the order of a new score, the tail behind them as it was."""
    key = F.when(F.col("rank") <= head, -score)
    order = Window.partitionBy("query_id").orderBy((F.col("rank") > head), key.asc_nulls_last(), "rank", "chunk_id")
    return ranked.select("query_id", "chunk_id", F.row_number().over(order).alias("place"))


def corrected(first: DataFrame, second: DataFrame, threshold: float) -> DataFrame:
    """(query_id, chunk_id, rank): the first pass where its best score reaches the threshold, else both fused by reciprocal ranks."""
    weak = first.groupBy("query_id").agg(F.max("score").alias("best")).where(F.col("best") < threshold).select("query_id")
    fused = rrf([first.join(weak, "query_id", "left_semi"), second.join(weak, "query_id", "left_semi")])
    kept = first.join(weak, "query_id", "left_anti").select("query_id", "chunk_id", "rank")
    return kept.unionByName(fused.select("query_id", "chunk_id", F.col("fused_rank").alias("rank")))


def rank_positions(rows: DataFrame, by: str, score: str, item: str) -> DataFrame:
    """(by, item, position): places from 1 by falling score, null scores last, ties by item."""
    return rows.select(by, item, F.row_number().over(Window.partitionBy(by).orderBy(F.col(score).desc_nulls_last(), item)).alias("position"))
