"""Temporal claims and graph traversals."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import claims as ops
from siltstone.operators import periods
from siltstone.sources.views import ctes, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
DAY = date(1998, 6, 1)


def add(name: str, run: Callable[[DataFrame], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: run(view(spark, sf_dir, "claim"))
    SQL[name] = ctes("claim").rstrip() + sql


def every(c: DataFrame) -> DataFrame:
    """All subjects as the entities asked about."""
    return c.select(F.col("subject_id").alias("entity_id")).distinct()


_OVERLAP = "coalesce(a.valid_from, DATE '0001-01-01') < coalesce(b.valid_until, DATE '9999-12-31') AND coalesce(b.valid_from, DATE '0001-01-01') < coalesce(a.valid_until, DATE '9999-12-31')"
_RANK = "CASE {}.temporal_basis WHEN 'stated' THEN 3 WHEN 'subject_period' THEN 2 WHEN 'document' THEN 1 ELSE 0 END"
_PAIRS = f""", live AS (SELECT * FROM claim WHERE status = 'active' AND predicate IN ('LED_BY', 'WORKS_AT')),
pairs AS (SELECT a.subject_id, a.predicate, a.claim_id AS first, b.claim_id AS second,
  CASE WHEN {_RANK.format('a')} > {_RANK.format('b')} THEN a.claim_id WHEN {_RANK.format('b')} > {_RANK.format('a')} THEN b.claim_id
    WHEN a.valid_from > b.valid_from THEN a.claim_id WHEN b.valid_from > a.valid_from THEN b.claim_id END AS winner
  FROM live a JOIN live b ON a.subject_id = b.subject_id AND a.predicate = b.predicate AND a.claim_id < b.claim_id AND a.object_id <> b.object_id WHERE {_OVERLAP})
"""
add("j16_conflict_pairs", lambda c: ops.conflict_pairs(c).select("subject_id", "predicate", "first", "second"), _PAIRS + "SELECT subject_id, predicate, first, second FROM pairs")
add("g04_pair_verdicts", ops.conflict_pairs, _PAIRS + "SELECT *, CASE WHEN winner IS NULL THEN 'contradiction' ELSE 'supersedes' END AS verdict FROM pairs")
_STATUS = """, folded AS (SELECT claim_id, CASE max(p) WHEN 2 THEN 'disputed' ELSE 'superseded' END AS new_status FROM (
  SELECT first AS claim_id, 2 AS p FROM pairs WHERE winner IS NULL UNION ALL SELECT second, 2 FROM pairs WHERE winner IS NULL
  UNION ALL SELECT CASE WHEN winner = first THEN second ELSE first END, 1 FROM pairs WHERE winner IS NOT NULL) GROUP BY claim_id) """
add("g05_status_fold", lambda c: ops.statuses_after(ops.conflict_pairs(c)), _PAIRS + _STATUS + "SELECT claim_id, new_status FROM folded")
add(
    "g06_apply_status",
    lambda c: ops.apply_status(c, ops.statuses_after(ops.conflict_pairs(c))).groupBy("predicate", "status").agg(F.count("*").alias("n")),
    _PAIRS + _STATUS + "SELECT predicate, CASE WHEN status = 'retracted' THEN status ELSE coalesce(new_status, status) END AS status, count(*) AS n FROM claim LEFT JOIN folded USING (claim_id) GROUP BY 1, 2",
)
add(
    "j15_links_among",
    lambda c: ops.conflict_links(ops.conflict_pairs(c)),
    _PAIRS + """SELECT first AS from_id, second AS to_id, 'CONTRADICTS' AS kind FROM pairs WHERE winner IS NULL UNION ALL SELECT second, first, 'CONTRADICTS' FROM pairs WHERE winner IS NULL
  UNION ALL SELECT winner, CASE WHEN winner = first THEN second ELSE first END, 'SUPERSEDES' FROM pairs WHERE winner IS NOT NULL""",
)
_AS_OF = "(valid_from IS NULL OR valid_from <= DATE '1998-06-01') AND (valid_until IS NULL OR valid_until > DATE '1998-06-01')"
_PRESENT = "status = 'active' AND temporal_basis IN ('stated', 'subject_period')"
add("f18_window_overlap", lambda c: c.where(periods.history_overlap(F.col("valid_from"), F.col("valid_until"), date(1997, 1, 1), date(1997, 2, 1))).select("claim_id"), " SELECT claim_id FROM claim WHERE (valid_from IS NULL OR valid_from < DATE '1997-02-01') AND (valid_until IS NULL OR valid_until > DATE '1997-01-01')")
add("f19_present_facts", lambda c: c.where(periods.present_fact(F.col("status"), F.col("temporal_basis"))).select("claim_id"), f" SELECT claim_id FROM claim WHERE {_PRESENT}")
add("f20_claims_as_of", lambda c: ops.claims_as_of(c, DAY, ("LED_BY",)).select("claim_id", "subject_id", "object_id"), f" SELECT claim_id, subject_id, object_id FROM claim WHERE predicate = 'LED_BY' AND {_AS_OF}")
add("f21_current_state", lambda c: ops.current_state(c, DAY), f" SELECT DISTINCT subject_id, predicate, object_id FROM claim WHERE {_PRESENT} AND {_AS_OF}")
add(
    "f22_projectable",
    lambda c: ops.current_state(c, DAY, c.select(F.explode(F.array("subject_id", "object_id")).alias("entity_id")).distinct().where("entity_id % 3 > 0")),
    f" SELECT DISTINCT subject_id, predicate, object_id FROM claim WHERE {_PRESENT} AND {_AS_OF} AND subject_id % 3 > 0 AND object_id % 3 > 0",
)
_ENDS = "SELECT subject_id AS near, object_id AS far, claim_id FROM live WHERE predicate = '{0}' UNION ALL SELECT object_id, subject_id, claim_id FROM live WHERE predicate = '{0}'"
add("j19_current_edges", lambda c: ops.current_state(c, DAY), f" SELECT DISTINCT subject_id, predicate, object_id FROM claim WHERE {_PRESENT} AND {_AS_OF}")
add("j20_history", lambda c: ops.one_hop(c, every(c), side="subject").groupBy("subject_id", "predicate").agg(F.sort_array(F.collect_set("object_id")).alias("objects"), F.count("*").alias("claims")), " SELECT subject_id, predicate, list_sort(list(DISTINCT object_id)) AS objects, count(*) AS claims FROM claim WHERE status <> 'retracted' GROUP BY 1, 2")
add("j21_either_end", lambda c: ops.one_hop(c, every(c), "WORKS_AT", date(1996, 1, 1), date(1997, 1, 1)).select("claim_id"), " SELECT DISTINCT claim_id FROM claim WHERE status <> 'retracted' AND predicate = 'WORKS_AT' AND (valid_from IS NULL OR valid_from < DATE '1997-01-01') AND (valid_until IS NULL OR valid_until > DATE '1996-01-01')")
add(
    "j22_two_hop",
    lambda c: ops.two_hop(c, every(c), "LED_BY", "WORKS_AT", date(1997, 1, 1), date(1998, 1, 1)),
    f""", live AS (SELECT * FROM claim WHERE status <> 'retracted' AND (valid_from IS NULL OR valid_from < DATE '1998-01-01') AND (valid_until IS NULL OR valid_until > DATE '1997-01-01')),
l1 AS ({_ENDS.format('LED_BY')}), l2 AS ({_ENDS.format('WORKS_AT')})
SELECT DISTINCT l1.near AS start_id, l1.far AS via_id, l2.far AS end_id, l1.claim_id AS first_claim, l2.claim_id AS second_claim FROM l1 JOIN l2 ON l1.far = l2.near
WHERE l1.near IN (SELECT subject_id FROM claim) AND l1.claim_id <> l2.claim_id AND l2.far <> l1.near""",
)
_LATEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY coalesce(valid_until, DATE '9999-12-31') DESC, coalesce(valid_from, DATE '0001-01-01') DESC, claim_id) AS rn FROM claim WHERE status <> 'retracted' AND predicate = '{0}') WHERE rn <= {1})"
add("t10_recent_claims", lambda c: ops.one_hop_each(c, every(c), "FUNDED_BY", 50).select("subject_id", "claim_id"), f" SELECT subject_id, claim_id FROM {_LATEST.format('FUNDED_BY', 50)}")
add("f17_overlapping_windows", lambda c: c.where(periods.overlaps(F.col("valid_from"), F.col("valid_until"), F.lit(date(1999, 1, 1)), F.lit(None).cast("date"))).select("claim_id"), " SELECT claim_id FROM claim WHERE (valid_from IS NOT NULL OR valid_until IS NOT NULL) AND coalesce(valid_until, DATE '9999-12-31') > DATE '1999-01-01'")
_CODE = """CASE WHEN claim_id IS NULL THEN 'no_id' WHEN predicate IS NULL THEN 'no_predicate' WHEN predicate NOT IN ('LED_BY', 'WORKS_AT', 'FUNDED_BY') THEN 'unknown_predicate' WHEN subject_id IS NULL THEN 'no_subject'
  WHEN object_id IS NULL THEN 'no_object' WHEN subject_id = object_id THEN 'self_reference' WHEN valid_until <= valid_from THEN 'inverted_window' WHEN confidence < 0.52 THEN 'low_confidence' END"""
add("g03_validate", lambda c: ops.reject_code(c).select("claim_id", "code"), f" SELECT claim_id, {_CODE} AS code FROM claim")
add("a26_rejections", lambda c: ops.reject_code(c).where("code IS NOT NULL").groupBy("code").agg(F.count("*").alias("n")), f" SELECT code, count(*) AS n FROM (SELECT {_CODE} AS code FROM claim) WHERE code IS NOT NULL GROUP BY code")
add("w02_best_claim", lambda c: ops.best_per_key(c, ["subject_id", "predicate"], [F.desc("confidence"), F.asc("claim_id")]).select("subject_id", "predicate", "claim_id"), " SELECT subject_id, predicate, claim_id FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, predicate ORDER BY confidence DESC, claim_id) AS rn FROM claim) WHERE rn = 1")
add("j14_siblings", lambda c: c.join(c.where("confidence > 0.598").select("subject_id", "predicate").distinct(), ["subject_id", "predicate"], "left_semi").select("claim_id"), " SELECT claim_id FROM claim WHERE (subject_id, predicate) IN (SELECT (subject_id, predicate) FROM claim WHERE confidence > 0.598)")
add("u12_superseded_evidence", lambda c: c.join(c.where("document_id % 7 > 0").select("document_id").distinct(), "document_id", "left_anti").select("claim_id"), " SELECT claim_id FROM claim WHERE document_id NOT IN (SELECT document_id FROM claim WHERE document_id % 7 > 0)")
add("u11_stale_claims", lambda c: c.where("predicate = 'LED_BY'").join(c.where("predicate = 'LED_BY' AND confidence >= 0.55").select("claim_id"), "claim_id", "left_anti").join(c.where("confidence >= 0.55").select("document_id").distinct(), "document_id", "left_semi").select("claim_id"), " SELECT claim_id FROM claim WHERE predicate = 'LED_BY' AND claim_id NOT IN (SELECT claim_id FROM claim WHERE predicate = 'LED_BY' AND confidence >= 0.55) AND document_id IN (SELECT document_id FROM claim WHERE confidence >= 0.55)")
add("g11_verify_projection", lambda c: ops.verify_projection(c, ops.current_state(c.where("document_id % 13 > 0"), date(1998, 7, 1)), DAY), f""", want AS (SELECT DISTINCT subject_id, predicate, object_id FROM claim WHERE {_PRESENT} AND {_AS_OF}),
have AS (SELECT DISTINCT subject_id, predicate, object_id FROM claim WHERE document_id % 13 > 0 AND {_PRESENT} AND {_AS_OF.replace('1998-06-01', '1998-07-01')})
SELECT coalesce(w.predicate, h.predicate) AS predicate, count(*) FILTER (WHERE h.subject_id IS NULL) AS missing, count(*) FILTER (WHERE w.subject_id IS NULL) AS unexpected
FROM want w FULL JOIN have h ON w.subject_id = h.subject_id AND w.predicate = h.predicate AND w.object_id = h.object_id GROUP BY 1""")  # fmt: skip
add("g17_evidence_mix", lambda c: c.groupBy("predicate").agg(F.sort_array(F.collect_set("temporal_basis")).alias("bases"), F.max(F.col("status") == "retracted").alias("any_retracted")), " SELECT predicate, list_sort(list(DISTINCT temporal_basis)) AS bases, bool_or(status = 'retracted') AS any_retracted FROM claim GROUP BY 1")
_LINE = lambda: F.concat(F.col("subject_id").cast("string"), F.lit(" led by "), F.col("object_id").cast("string"), F.concat(F.lit(" from "), F.date_format("valid_from", "yyyy-MM-dd")), F.coalesce(F.concat(F.lit(" to "), F.date_format(periods.inclusive_end(F.col("valid_until")), "yyyy-MM-dd")), F.lit("")))
add("proj09_claim_sentences", lambda c: ops.one_hop_each(c, every(c), "LED_BY", 20).select(_LINE().alias("line")).distinct(), f""" SELECT DISTINCT concat(subject_id, ' led by ', object_id, ' from ', strftime(valid_from, '%Y-%m-%d'), coalesce(' to ' || strftime(valid_until - INTERVAL 1 DAY, '%Y-%m-%d'), '')) AS line
  FROM {_LATEST.format('LED_BY', 20)}""")  # fmt: skip
add("d02_inclusive_ends", lambda c: c.select("claim_id", periods.inclusive_end(F.col("valid_until")).alias("last_day"), periods.exclusive_end(F.col("valid_from")).alias("day_after")), " SELECT claim_id, CAST(valid_until - INTERVAL 1 DAY AS DATE) AS last_day, CAST(valid_from + INTERVAL 1 DAY AS DATE) AS day_after FROM claim")
