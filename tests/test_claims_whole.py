"""Traversals for all subjects, with limits that hold for each of them."""

from datetime import date

from siltstone.operators import claims as ops
from siltstone.queries import claims as queries

SCHEMA = "claim_id string, subject_id long, predicate string, object_id long, valid_from date, valid_until date, status string"


def frame(spark):
    day = date(1997, 3, 1)
    rows = [(f"{s}-{i}", s, "FUNDED_BY", 100 + i, date(1990 + i, 1, 1), date(1991 + i, 1, 1) if i else None, "active") for s in (1, 7, 50) for i in range(4)]
    rows += [("l1", 3, "LED_BY", 200, day, None, "active"), ("w1", 4, "WORKS_AT", 200, day, None, "active"), ("gone", 9, "FUNDED_BY", 1, day, None, "retracted")]
    return spark.createDataFrame(rows, SCHEMA)


def test_limit_of_each_entity(spark):
    c = frame(spark)
    got = {(r.subject_id, r.claim_id) for r in ops.one_hop_each(c, queries.every(c), "FUNDED_BY", 2).collect()}
    assert got == {(s, f"{s}-{i}") for s in (1, 7, 50) for i in (0, 3)}


def test_all_subjects(spark, monkeypatch):
    c = frame(spark)
    monkeypatch.setattr(queries, "view", lambda *a: c)
    run = lambda name: queries.QUERIES[name](None, "").collect()
    assert {r.subject_id for r in run("j20_history")} == {1, 3, 4, 7, 50}
    assert {r.subject_id for r in run("t10_recent_claims")} == {1, 7, 50}
    assert {(r.start_id, r.via_id, r.end_id) for r in run("j22_two_hop")} == {(3, 200, 4)}
