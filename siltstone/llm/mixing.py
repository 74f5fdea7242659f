"""Sources mixed to target shares of the total size.

Tokens are summed by source, a repetition rate follows for each source, and every text is emitted floor(rate) times plus
once more with a probability equal to the fraction, decided by a seeded hash of its id.

The total is what is asked for, by default all tokens of the eligible texts. A source that would have to repeat more than
its cap stays at the cap: the mixture is smaller by what it lacks, and the report says so (wanted_tokens, mixed_tokens,
actual_share). ``reach_tokens`` reports the largest total at which no cap binds; asking for it gives every source its target.

Defined results: equal texts are one text (the smallest id stands for them), so that no text is used more often than the cap;
rows with null source, sources without a target and texts without tokens are left out; the shares of sources without texts
are divided among the others in proportion, and reported as target_share with actual_share 0; a cap below 1 or a null cap
leaves the source out; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.plans.materialise import broadcast_if_small, cut

SEED = 20


def distinct_texts(counted: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, doc_id, n_tokens) with each text once; ``counted`` has source, doc_id, text_key, n_tokens."""
    wanted = targets.where("target_share > 0 AND max_repeats >= 1").select("source").distinct()
    rows = counted.where("n_tokens > 0").join(wanted, "source", "left_semi")
    one = rows.groupBy("text_key").agg(F.min(F.struct("doc_id", "source", "n_tokens")).alias("r"))
    return one.select("r.source", "r.doc_id", "r.n_tokens")


def rates(texts: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """One row for each target: source, target_share, max_repeats, texts, available_tokens, reach_tokens, wanted_tokens, rate."""
    sums = texts.groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"), F.count("*").alias("texts"))
    t = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).join(sums, "source", "left")
    live = (F.col("available_tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") >= 1)
    per_share = F.col("max_repeats") * F.col("available_tokens") / F.col("target_share")
    shared = t.where(live).agg(F.sum("target_share").alias("share_sum"), F.min(per_share).alias("least"), F.sum("available_tokens").alias("eligible"))
    t = t.join(F.broadcast(shared))  # one row
    wanted = F.when(live, F.col("target_share") / F.col("share_sum") * (F.col("eligible") if total_tokens is None else F.lit(float(total_tokens))))
    rate = F.least(F.col("max_repeats").cast("double"), wanted / F.col("available_tokens"))
    return t.select(
        "source", "target_share", "max_repeats", F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("available_tokens", F.lit(0)).alias("available_tokens"),
        (F.col("share_sum") * F.col("least")).alias("reach_tokens"), F.coalesce(wanted, F.lit(0.0)).alias("wanted_tokens"), F.coalesce(rate, F.lit(0.0)).alias("rate"),
    )


def _chance(doc_id: Column, seed: int) -> Column:
    """Uniform in [0, 1), fixed by id and seed."""
    return F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))


def mix(texts: DataFrame, source_rates: DataFrame, seed: int = SEED) -> DataFrame:
    """(source, doc_id, copy_no from 1, n_tokens): each text as often as its source's rate says."""
    joined = texts.join(broadcast_if_small(source_rates.where("rate > 0").select("source", "rate", "max_repeats")), "source")
    extra = F.when(_chance(F.col("doc_id"), seed) < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    copies = F.least(F.col("max_repeats").cast("long"), F.floor("rate").cast("long") + extra)
    return joined.withColumn("copies", copies).where("copies > 0").select("source", "doc_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy_no"), "n_tokens")


def report(source_rates: DataFrame, mixed: DataFrame) -> DataFrame:
    """Target and actual share of every target source, with the tokens used."""
    used = mixed.groupBy("source").agg(F.sum("n_tokens").alias("mixed_tokens"), F.max("copy_no").alias("most_copies"))
    total = used.agg(F.sum("mixed_tokens").alias("total"))
    out = source_rates.join(used, "source", "left").join(F.broadcast(total))  # one row
    return out.select(
        "source", "target_share", "max_repeats", "texts", "available_tokens", "reach_tokens", "wanted_tokens", "rate", F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        F.coalesce(F.col("mixed_tokens") / F.col("total"), F.lit(0.0)).alias("actual_share"),
    )


def prepared(counted: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Distinct texts and rates, both cut so that the tokenizer runs once."""
    texts = cut(distinct_texts(counted, targets))
    return texts, cut(rates(texts, targets, total_tokens))
