"""Temporal claims: conflicts, status, traversals over one and two hops, current-state projection and its verification.

A claim is a row (claim_id, subject_id, predicate, object_id, valid_from, valid_until, temporal_basis, status, ...). Pairs are
only formed inside one subject and predicate, by an equi-join with the interval test as its residual.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.operators import periods

# How far a claim's dates may be trusted, by where they come from.
BASIS_RANK = {"stated": 3, "subject_period": 2, "document": 1}
# Predicates that allow one object at a time.
FUNCTIONAL = ("LED_BY", "WORKS_AT")
KEY = ["subject_id", "predicate"]


def _basis_rank(c: Column) -> Column:
    return F.coalesce(*[F.when(c == k, v) for k, v in BASIS_RANK.items()], F.lit(0))


def conflict_pairs(claims: DataFrame, functional: tuple[str, ...] = FUNCTIONAL) -> DataFrame:
    """Pairs (first, second) of active claims on one functional subject and predicate with other objects and overlapping windows.

    verdict: 'supersedes' names the winner (better basis, else later start), 'contradiction' where neither wins.
    """
    live = claims.where((F.col("status") == "active") & F.col("predicate").isin(*functional))
    cols = ["claim_id", "object_id", "valid_from", "valid_until", "temporal_basis"]
    a, b = (live.select(*KEY, *[F.col(c).alias(f"{p}_{c}") for c in cols]) for p in "ab")
    pairs = a.join(b, KEY).where((F.col("a_claim_id") < F.col("b_claim_id")) & (F.col("a_object_id") != F.col("b_object_id")))
    pairs = pairs.where(periods.overlaps(*[F.col(f"{p}_{c}") for p in "ab" for c in ("valid_from", "valid_until")]))
    ra, rb = _basis_rank(F.col("a_temporal_basis")), _basis_rank(F.col("b_temporal_basis"))
    fa, fb = (F.coalesce(F.col(f"{p}_valid_from"), F.lit(periods.FIRST).cast("date")) for p in "ab")
    winner = F.when(ra > rb, F.col("a_claim_id")).when(rb > ra, F.col("b_claim_id")).when(fa > fb, F.col("a_claim_id")).when(fb > fa, F.col("b_claim_id"))
    return pairs.select(*KEY, F.col("a_claim_id").alias("first"), F.col("b_claim_id").alias("second"), winner.alias("winner"), F.when(winner.isNull(), "contradiction").otherwise("supersedes").alias("verdict"))


def statuses_after(pairs: DataFrame) -> DataFrame:
    """(claim_id, new_status): disputed wins over superseded, in whatever order the pairs come."""
    disputed = pairs.where("verdict = 'contradiction'").select(F.explode(F.array("first", "second")).alias("claim_id"), F.lit(2).alias("p"))
    beaten = pairs.where("verdict = 'supersedes'").select(F.when(F.col("winner") == F.col("first"), F.col("second")).otherwise(F.col("first")).alias("claim_id"), F.lit(1).alias("p"))
    return disputed.unionByName(beaten).groupBy("claim_id").agg(F.when(F.max("p") == 2, "disputed").otherwise("superseded").alias("new_status"))


def conflict_links(pairs: DataFrame) -> DataFrame:
    """Directed links (from_id, to_id, kind): a contradiction in both directions, a supersession from winner to loser."""
    both = pairs.where("verdict = 'contradiction'").select(F.explode(F.array(F.struct(F.col("first").alias("f"), F.col("second").alias("t")), F.struct(F.col("second").alias("f"), F.col("first").alias("t")))).alias("l"))
    one = pairs.where("verdict = 'supersedes'").select(F.col("winner").alias("from_id"), F.when(F.col("winner") == F.col("first"), F.col("second")).otherwise(F.col("first")).alias("to_id"), F.lit("SUPERSEDES").alias("kind"))
    return both.select(F.col("l.f").alias("from_id"), F.col("l.t").alias("to_id"), F.lit("CONTRADICTS").alias("kind")).unionByName(one)


def apply_status(claims: DataFrame, changes: DataFrame) -> DataFrame:
    joined = claims.join(changes, "claim_id", "left")
    return joined.withColumn("status", F.when(F.col("status") == "retracted", F.col("status")).otherwise(F.coalesce("new_status", "status"))).drop("new_status")


def current_state(claims: DataFrame, as_of: date, eligible: DataFrame | None = None) -> DataFrame:
    """Edges that may be shown as present facts: trusted basis, active, valid on the day, both ends eligible."""
    live = claims.where(periods.present_fact(F.col("status"), F.col("temporal_basis")) & periods.as_of(F.col("valid_from"), F.col("valid_until"), as_of))
    if eligible is not None:
        live = live.join(eligible.select(F.col("entity_id").alias("subject_id")), "subject_id", "left_semi").join(eligible.select(F.col("entity_id").alias("object_id")), "object_id", "left_semi")
    return live.select("subject_id", "predicate", "object_id").distinct()


def claims_as_of(claims: DataFrame, day: date, predicates: tuple[str, ...]) -> DataFrame:
    return claims.where(F.col("predicate").isin(*predicates) & periods.as_of(F.col("valid_from"), F.col("valid_until"), day))


def recency(claims: DataFrame) -> list[Column]:
    """Order of graph answers: latest end (open ends last of all dates), latest start, id."""
    return [F.desc(F.coalesce("valid_until", F.lit(periods.LAST).cast("date"))), F.desc(F.coalesce("valid_from", F.lit(periods.FIRST).cast("date"))), F.asc("claim_id")]


def one_hop(claims: DataFrame, entities: DataFrame, predicate: str | None = None, lo: date | None = None, hi: date | None = None, side: str = "either", limit: int | None = None) -> DataFrame:
    """Claims that touch the given entities (entity_id) on a side, in a window, each once; ``limit`` holds for all together."""
    live = claims.where(F.col("status") != "retracted").where(periods.history_overlap(F.col("valid_from"), F.col("valid_until"), lo, hi))
    live = live.where(F.col("predicate") == predicate) if predicate else live
    sides = {"subject": ["subject_id"], "object": ["object_id"], "either": ["subject_id", "object_id"]}[side]
    found = None
    for s in sides:
        hit = live.join(entities.select(F.col("entity_id").alias(s)), s, "left_semi").select(claims.columns)
        found = hit if found is None else found.unionByName(hit)
    found = found.dropDuplicates(["claim_id"])
    return found.orderBy(*recency(found)).limit(limit) if limit else found


def one_hop_each(claims: DataFrame, entities: DataFrame, predicate: str, limit: int) -> DataFrame:
    """The latest ``limit`` claims of each given entity as subject: the answer of one entity, for all of them."""
    found = one_hop(claims, entities, predicate, side="subject")
    return found.withColumn("__rn", F.row_number().over(Window.partitionBy("subject_id").orderBy(*recency(found)))).where(F.col("__rn") <= limit).drop("__rn")


def two_hop(claims: DataFrame, start: DataFrame, first: str, second: str, lo: date | None = None, hi: date | None = None) -> DataFrame:
    """(start_id, via_id, end_id, first_claim, second_claim): two different claims through a shared entity, no way back."""
    live = claims.where(F.col("status") != "retracted").where(periods.history_overlap(F.col("valid_from"), F.col("valid_until"), lo, hi))

    def ends(predicate: str, near: str, far: str, name: str) -> DataFrame:
        p = live.where(F.col("predicate") == predicate)
        forward = p.select(F.col("subject_id").alias(near), F.col("object_id").alias(far), F.col("claim_id").alias(name))
        return forward.unionByName(p.select(F.col("object_id").alias(near), F.col("subject_id").alias(far), F.col("claim_id").alias(name)))

    leg1 = ends(first, "start_id", "via_id", "first_claim").join(start.select(F.col("entity_id").alias("start_id")), "start_id", "left_semi")
    leg2 = ends(second, "via_id", "end_id", "second_claim")
    return leg1.join(leg2, "via_id").where("first_claim <> second_claim AND end_id <> start_id").select("start_id", "via_id", "end_id", "first_claim", "second_claim").distinct()


def reject_code(claims: DataFrame, min_confidence: float = 0.52) -> DataFrame:
    """Claims with the code of the first rule they break, null where they are accepted."""
    code = (
        F.when(F.col("claim_id").isNull(), "no_id").when(F.col("predicate").isNull(), "no_predicate").when(~F.col("predicate").isin("LED_BY", "WORKS_AT", "FUNDED_BY"), "unknown_predicate")
        .when(F.col("subject_id").isNull(), "no_subject").when(F.col("object_id").isNull(), "no_object").when(F.col("subject_id") == F.col("object_id"), "self_reference")
        .when(F.col("valid_from").isNotNull() & F.col("valid_until").isNotNull() & (F.col("valid_until") <= F.col("valid_from")), "inverted_window")
        .when(~F.col("temporal_basis").isin(*BASIS_RANK), "unknown_basis").when(F.col("confidence") < min_confidence, "low_confidence")
    )
    return claims.withColumn("code", code)


def best_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def verify_projection(claims: DataFrame, edges: DataFrame, as_of: date) -> DataFrame:
    """Differences of stored edges from the projection of the claims: (predicate, missing, unexpected)."""
    want = current_state(claims, as_of).withColumn("w", F.lit(True))
    have = edges.select("subject_id", "predicate", "object_id").distinct().withColumn("h", F.lit(True))
    both = want.join(have, ["subject_id", "predicate", "object_id"], "full_outer")
    return both.groupBy("predicate").agg(F.count_if(F.col("h").isNull()).alias("missing"), F.count_if(F.col("w").isNull()).alias("unexpected"))
