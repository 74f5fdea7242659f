"""Texts placed into containers of fixed capacity, none divided unless it alone exceeds the capacity.

The global histogram of lengths (at most capacity + 1 rows, so it may come to the driver) decides everything: dynamic
programming chooses the bucket boundaries that minimise padding, and containers are then planned for buckets, not for
items: a container takes as many items of its largest bucket as its token budget allows, and what room is left is filled
from the largest buckets that still fit. (Batches that stay inside one bucket, the plain form of the method, leave a large
part of each container of a wide bucket empty; see README.) The plan says which ranks of a bucket go into which containers,
and every item finds its own place from its bucket and its rank. Ranks are counted in salted shards, so a bucket that holds
a third of all items is spread over tasks.

Defined results: an item over the capacity is divided into full pieces and one rest, which is placed as any item; an item of
no tokens goes into container 0; copies of an item count once; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.plans.materialise import cut

CAPACITY = 2048
BUCKETS = 160
#: items of one bucket that one shard may hold, on average
SHARD_ROWS = 50_000


def choose_boundaries(histogram: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of at most ``buckets`` length buckets with the least total padding, by dynamic programming."""
    sizes = sorted(histogram)
    if len(sizes) <= buckets:
        return sizes
    s = np.array(sizes, dtype=np.float64)
    n = np.array([histogram[x] for x in sizes], dtype=np.float64)
    items, tokens = np.concatenate(([0], n.cumsum())), np.concatenate(([0], (n * s).cumsum()))
    k = len(sizes)
    # cost[i, j]: padding of sizes i..j in one bucket bounded by size j
    cost = (items[1:][None, :] - items[:-1][:, None]) * s[None, :] - (tokens[1:][None, :] - tokens[:-1][:, None])
    cost[np.tril_indices(k, -1)] = np.inf
    best, came = cost[0].copy(), np.zeros((buckets, k), dtype=np.int32)
    for b in range(1, buckets):
        through = best[:-1, None] + cost[1:, :]  # the bucket before ends at i, this one is i + 1 .. j
        at = through.argmin(axis=0)
        least = through[at, np.arange(k)]
        better = least < best
        came[b] = np.where(better, at + 1, -1)
        best = np.where(better, least, best)
    bounds, j = [], k - 1
    for b in range(buckets - 1, -1, -1):
        if b and came[b, j] < 0:
            continue
        bounds.append(sizes[j])
        if b == 0 or came[b, j] == 0:
            break
        j = came[b, j] - 1
    return sorted(bounds)


def plan_containers(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Slots (bound, first_rank, per_container, containers, first_container) for ``counts`` items of each bound; containers in all.

    A run repeats one filling for as many containers as its buckets last, so there are about as many runs as buckets.
    """
    left = {b: n for b, n in counts.items() if n > 0 and b > 0}
    taken: dict[int, int] = defaultdict(int)
    slots, used = [], 0
    while left:
        room, filling = capacity, {}
        for b in sorted(left, reverse=True):
            take = min(room // b, left[b])
            if take:
                filling[b] = take
                room -= take * b
        repeat = min(left[b] // u for b, u in filling.items())
        for b, u in filling.items():
            slots.append((b, taken[b], u, repeat, used))
            taken[b] += u * repeat
            left[b] -= u * repeat
            if not left[b]:
                del left[b]
        used += repeat
    return slots, used


def pack(lengths: DataFrame, item_id: str, tokens: str, capacity: int = CAPACITY, buckets: int = BUCKETS) -> DataFrame:
    """Place every item: (container_id, item_id, piece_no from 1, first_token, n_tokens, bucket)."""
    spark = lengths.sparkSession
    items = lengths.select(F.col(item_id).alias("item_id"), F.greatest(F.col(tokens), F.lit(0)).cast("long").alias("t")).distinct()
    full = F.floor(F.col("t") / capacity).cast("long")
    rest = F.col("t") % capacity
    items = cut(items.select("item_id", "t", full.alias("full"), rest.alias("rest")))
    histogram = {r["rest"]: r["n"] for r in items.groupBy("rest").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    whole = items.where("full = 0 OR rest > 0")
    if 0 in histogram:
        histogram[0] = whole.where("rest = 0").count()
    bounds = choose_boundaries({s: n for s, n in histogram.items() if s > 0 and n > 0}, buckets)
    counts: dict[int, int] = defaultdict(int)
    for s, n in histogram.items():
        counts[0 if s == 0 else bounds[int(np.searchsorted(bounds, s))]] += n
    slots, used = plan_containers(counts, capacity)

    # bucket of a size: a lookup array of capacity entries
    of_size = [0] + [bounds[int(np.searchsorted(bounds, s))] if bounds and s <= bounds[-1] else 0 for s in range(1, capacity)]
    bucket = F.element_at(F.lit(np.array(of_size, dtype=np.int64)).cast("array<bigint>"), (F.col("rest") + 1).cast("int"))
    shards = max(1, max(counts.values(), default=1) // SHARD_ROWS)
    placed = whole.select("item_id", "full", "rest", bucket.alias("bucket"), F.pmod(F.xxhash64("item_id"), F.lit(shards)).alias("shard"))
    sizes = placed.groupBy("bucket", "shard").agg(F.count("*").alias("n"))
    before = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("bucket", "shard").orderBy("item_id")
    ranked = placed.withColumn("rn", F.row_number().over(inside)).join(offsets, ["bucket", "shard"]).withColumn("rank", F.col("offset") + F.col("rn") - 1)

    by_bucket = defaultdict(list)
    for b, first, per, _, container in slots:
        by_bucket[b].append((first, per, container))
    plan = spark.createDataFrame([(b, sorted(v)) for b, v in by_bucket.items()] or [(-1, [(0, 1, 0)])], "bucket long, runs array<struct<first: long, per: long, container: long>>")
    run = F.element_at(F.filter("runs", lambda r: r["first"] <= F.col("rank")), -1)  # the plan has a few hundred rows, whatever the input
    fitted = ranked.join(F.broadcast(plan), "bucket", "left").withColumn("run", run)
    container = F.when(F.col("bucket") == 0, F.lit(0).cast("long")).otherwise(F.col("run.container") + F.floor((F.col("rank") - F.col("run.first")) / F.col("run.per")).cast("long"))
    rests = fitted.select(container.alias("container_id"), "item_id", (F.col("full") + 1).alias("piece_no"), (F.col("full") * capacity).alias("first_token"), F.col("rest").alias("n_tokens"), "bucket")

    # full pieces have a container each, numbered after the planned ones by the same salted ranks
    large = items.where("full > 0")
    salted = large.withColumn("shard", F.pmod(F.xxhash64("item_id"), F.lit(shards)))
    run_up = Window.partitionBy("shard").orderBy("item_id").rowsBetween(Window.unboundedPreceding, -1)
    totals = salted.groupBy("shard").agg(F.sum("full").alias("n"))
    # shards add up in rows of about the root of their number, and the rows in turn, so that no task sees all shards
    width = max(1, int(shards**0.5))
    totals = totals.withColumn("row", F.floor(F.col("shard") / width))
    rows = totals.groupBy("row").agg(F.sum("n").alias("n"))
    first = rows.select("row", F.coalesce(F.sum("n").over(Window.orderBy("row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = Window.partitionBy("row").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("up", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(first, "row").select("shard", (F.col("base") + F.col("up")).alias("offset"))
    numbered = salted.withColumn("up", F.coalesce(F.sum("full").over(run_up), F.lit(0))).join(starts, "shard")
    fulls = numbered.select("item_id", (F.col("offset") + F.col("up") + used).alias("start"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("full"))).alias("piece_no"))
    fulls = fulls.select((F.col("start") + F.col("piece_no") - 1).alias("container_id"), "item_id", "piece_no", ((F.col("piece_no") - 1) * capacity).alias("first_token"), F.lit(capacity).cast("long").alias("n_tokens"), F.lit(capacity).cast("long").alias("bucket"))
    return rests.unionByName(fulls)


def fill_report(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, share of all room that is filled, least and mean fill."""
    each = placed.groupBy("container_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"))
    return each.agg(
        F.count("*").alias("containers"), F.sum("n").alias("pieces"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"),
        (F.sum("t") / (F.count("*") * capacity)).alias("filled_share"), F.count_if(F.col("t") < 0.9 * capacity).alias("containers_below_90"),
    )
