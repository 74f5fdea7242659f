"""Incremental ingest: change detection, guarded deletes, versioned merges, retries, recovery and integrity checks.

Merges are full recomputations of a snapshot from (old snapshot, batch): running one twice gives the same snapshot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(log: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    return log.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("__rn = 1").drop("__rn")


def change_status(snapshot: DataFrame, crawl: DataFrame, pipeline_version: str) -> DataFrame:
    """Crawled documents as NEW, CHANGED or UNCHANGED against (document_id, fingerprint, pipeline_version)."""
    held = snapshot.select("document_id", F.col("fingerprint").alias("held"), F.col("pipeline_version").alias("held_version"), F.lit(True).alias("known"))
    status = F.when(F.col("known").isNull(), "NEW").when(~F.col("held").eqNullSafe(F.col("fingerprint")) | ~F.col("held_version").eqNullSafe(F.lit(pipeline_version)), "CHANGED").otherwise("UNCHANGED")
    return crawl.join(held, "document_id", "left").select("document_id", "fingerprint", status.alias("status"))


def deletions(snapshot: DataFrame, live: DataFrame, group: str, most_share: float = 0.1, least: int = 2) -> DataFrame:
    """Documents no longer live, of the groups whose losses are plausible: some live ones left, and few enough missing."""
    seen = live.select("document_id").distinct().withColumn("live", F.lit(True))
    marked = snapshot.join(seen, "document_id", "left")
    sizes = marked.groupBy(group).agg(F.count("*").alias("held"), F.count_if(F.col("live").isNull()).alias("missing"))
    safe = sizes.where((F.col("missing") < F.col("held")) & ((F.col("missing") <= least) | (F.col("missing") < most_share * F.col("held"))))
    return marked.where("live IS NULL").join(safe, group).select("document_id", group)


def high_water(snapshot: DataFrame, retries: DataFrame, group: str) -> DataFrame:
    """Where the next crawl starts: the highest mark of each group, held down to its oldest retry."""
    marks = snapshot.groupBy(group).agg(F.max("changed_mark").alias("mark"))
    floors = retries.groupBy(group).agg(F.min("changed_mark").alias("floor"))
    return marks.join(floors, group, "left").select(group, F.least("mark", "floor").alias("start"))


def retry_queue(queue: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(document_id, attempts, changed_mark): failures recorded or counted up, successes cleared."""
    new = outcomes.select("document_id", F.col("changed_mark").alias("m"), "failed")
    both = queue.join(new, "document_id", "full_outer")
    both = both.where(F.col("failed").isNull() | F.col("failed"))
    return both.select("document_id", (F.coalesce("attempts", F.lit(0)) + F.when(F.col("failed"), 1).otherwise(0)).alias("attempts"), F.least("changed_mark", "m").alias("changed_mark"))


def not_dead(candidates: DataFrame, dead: DataFrame) -> DataFrame:
    """Candidates whose link isn't known to be dead in the same state."""
    return candidates.join(dead.select("document_id", "fingerprint"), ["document_id", "fingerprint"], "left_anti")


def merge(snapshot: DataFrame, batch: DataFrame, key: str, overwrite: list[str], keep: list[str]) -> DataFrame:
    """Upsert: ``overwrite`` columns come from the batch, ``keep`` columns only where the batch has a value."""
    old = snapshot.select(key, *[F.col(c).alias(f"old_{c}") for c in [*overwrite, *keep]])
    new = batch.select(key, *overwrite, *keep, F.lit(True).alias("__in"))
    both = old.join(new, key, "full_outer")
    taken = [F.when(F.col("__in"), F.col(c)).otherwise(F.col(f"old_{c}")).alias(c) for c in overwrite]
    return both.select(key, *taken, *[F.coalesce(c, f"old_{c}").alias(c) for c in keep])


def replace_facet(facet: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """All of a document's facet rows replaced by the batch's, first spelling of a value kept."""
    kept = facet.join(batch.select(key).distinct(), key, "left_anti")
    return kept.unionByName(batch.dropDuplicates())


def merge_versions(snapshot: DataFrame, batch: DataFrame) -> DataFrame:
    """(document_id, content_hash, doc_version): the version rises only where the content changed; new documents get 1."""
    old = snapshot.select("document_id", F.col("content_hash").alias("h"), F.col("doc_version").alias("v"))
    both = old.join(batch.select("document_id", "content_hash"), "document_id", "full_outer")
    version = F.when(F.col("v").isNull(), 1).when(F.col("content_hash").isNull() | F.col("content_hash").eqNullSafe(F.col("h")), F.col("v")).otherwise(F.col("v") + 1)
    return both.select("document_id", F.coalesce("content_hash", "h").alias("content_hash"), version.alias("doc_version"))


def stranded(log: DataFrame, catalog: DataFrame, links: DataFrame, final: list[str]) -> DataFrame:
    """Documents whose last log row is not final, that the catalog lacks and that still hang off a page."""
    last = latest(log, "document_id", "id").where(~F.col("status").isin(*final))
    return last.join(catalog, "document_id", "left_anti").join(links, "document_id", "left_semi").select("document_id", "status", "id")


def offenders(rows: DataFrame, check: str, key: str, n: int = 5) -> DataFrame:
    """(check, offenders, examples): a count and the first few keys."""
    first = rows.select(key).distinct().orderBy(key).limit(n).agg(F.sort_array(F.collect_list(key)).alias("examples"))
    return rows.agg(F.count("*").alias("offenders")).join(F.broadcast(first)).select(F.lit(check).alias("check"), "offenders", "examples")


def stage_metrics(log: DataFrame, stage: str, order: str, value: str, window: int = 512) -> DataFrame:
    """Per stage: count, total, mean and maximum of all samples, nearest-rank p50 and p95 of the last ``window``."""
    recent = F.row_number().over(Window.partitionBy(stage).orderBy(F.desc(order)))
    last = log.withColumn("__rn", recent).where(F.col("__rn") <= window).groupBy(stage).agg(F.sort_array(F.collect_list(value)).alias("s"))  # at most ``window`` values
    at = lambda q: F.element_at("s", (F.bround(F.lit(q) * (F.size("s") - 1)) + 1).cast("int"))
    totals = log.groupBy(stage).agg(F.count("*").alias("n"), F.round(F.sum(value), 1).alias("total"), F.round(F.avg(value), 1).alias("mean"), F.round(F.max(value), 1).alias("most"))
    return totals.join(last, stage).select(stage, "n", "total", "mean", "most", F.round(at(0.5), 1).alias("p50"), F.round(at(0.95), 1).alias("p95"))


def shares(rows: DataFrame, family: str, outcome: str) -> DataFrame:
    """(family, outcome, n, share of the family)."""
    counted = rows.groupBy(family, outcome).agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(family)), 6))


def majority(votes: DataFrame, by: str, value: str, position: str) -> DataFrame:
    """The commonest value of each vote; ties go to a value before null, then to the earliest voter."""
    counted = votes.groupBy(by, value).agg(F.count("*").alias("n"), F.min(position).alias("at"))
    order = Window.partitionBy(by).orderBy(F.desc("n"), F.col(value).isNull(), "at")
    return counted.withColumn("__rn", F.row_number().over(order)).where("__rn = 1").select(by, value, "n")


def drift(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys on both sides whose columns differ, nulls equal."""
    other = right.select(key, *[F.col(c).alias(f"other_{c}") for c in columns])
    differs: Column = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"other_{c}"))
    return left.join(other, key).where(differs).select(key)
