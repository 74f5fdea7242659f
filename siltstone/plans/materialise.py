"""Lineage cuts and size-checked joins.

Iterative operators cut their lineage with ``DataFrame.checkpoint()`` into the shared folder named by
``spark.checkpoint.dir``. A folder is set here only where the session has none (tests, local runs).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its estimated size is at or below this many bytes.
BROADCAST_BYTES = 32 * 1024 * 1024


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the session's ``spark.checkpoint.dir``; where none is set, a local folder serves a local master and no other."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "siltstone-checkpoints"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` on the shared checkpoint folder and drop its lineage.

    The files go when the session's cleaner finds the frame unused (``spark.cleaner.referenceTracking.cleanCheckpoints``).
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _checkpoint_bytes(df: DataFrame) -> int | None:
    """Bytes of the files of a frame that is a checkpoint, or columns and rows of one, read from the file system without a job."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.child()
    if plan.getClass().getSimpleName() != "LogicalRDD":
        return None
    file = plan.rdd().getCheckpointFile()
    if file.isEmpty():
        return None
    jvm = df.sparkSession.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(file.get())
    return int(path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength())


def estimated_bytes(df: DataFrame) -> int:
    """Size of ``df``: that of its files if it is a checkpoint, else rows times the mean text width of a row, by a job."""
    known = _checkpoint_bytes(df)
    if known is not None:
        return known
    text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    row = df.agg(F.coalesce(F.sum(F.length(text) + 16), F.lit(0)).alias("b")).first()
    return int(row["b"])


def broadcast_if_small(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Hint a broadcast when ``df`` is proven small, else leave the join to sort-merge with AQE skew splitting."""
    return F.broadcast(df) if estimated_bytes(df) <= (BROADCAST_BYTES if limit is None else limit) else df


def without_copies(df: DataFrame, key: str) -> DataFrame:
    """``df`` with rows repeated in full counted once, wide columns unshuffled where no key repeats.

    Only rows whose key stands on several rows are compared; the keys are counted first, from their own column alone.
    """
    many = cut(df.groupBy(F.col(key).alias("__many")).agg(F.count("*").alias("__n")).where("__n > 1").select("__many"))
    if many.isEmpty():
        return df
    small = broadcast_if_small(many)
    same = F.col(key).eqNullSafe(F.col("__many"))
    return df.join(small, same, "left_anti").unionByName(df.join(small, same, "left_semi").distinct())
