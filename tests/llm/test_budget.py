"""Token counts, packing and mixing."""

import os
import random

import pytest
from pyspark.sql import functions as F

from siltstone.llm import mixing, packing, tokens

needs_vocabulary = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary here")


@needs_vocabulary
def test_counts_equal_the_tokenizer():
    c = tokens.Counter(tokens.read_vocabulary(tokens.VOCABULARY))
    rng = random.Random(1)
    letters = "ab '  \n\t\r\x1c\x85\xa0　 éß9²½_-.,'s't漢字​<|endoftext|>"
    for _ in range(3000):
        t = "".join(rng.choice(letters) for _ in range(rng.randrange(16)))
        assert c.count(t) == len(c.encode(t)), t
    assert c.count(None) == c.count("") == 0


@needs_vocabulary
def test_column(spark):
    df = spark.createDataFrame([(1, "two words"), (2, None), (3, "")], "id long, body string")
    got = tokens.with_token_counts(df, [F.col("id")], F.col("body"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 2), (2, 0), (3, 0)]


def test_boundaries_are_optimal():
    def cost(hist, bounds):
        return sum(n * (min(b for b in bounds if b >= s) - s) for s, n in hist.items())

    from itertools import combinations

    rng = random.Random(2)
    for _ in range(20):
        hist = {s: rng.randrange(1, 9) for s in rng.sample(range(1, 40), 9)}
        got = packing.choose_boundaries(hist, 4)
        best = min(cost(hist, (*c, max(hist))) for c in combinations(sorted(hist)[:-1], 3))
        assert len(got) <= 4 and got[-1] == max(hist) and cost(hist, got) == best


def test_packing(spark):
    rng = random.Random(3)
    sizes = [rng.choice([0, 3, 5, 17, 40, 60, 99, 100, 101, 250, 777]) for _ in range(400)]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)] + [(0, sizes[0])], "id long, n long")
    rows = packing.pack(df, "id", "n", capacity=100, buckets=6).collect()
    by_item, by_container = {}, {}
    for r in rows:
        by_item.setdefault(r.item_id, []).append(r)
        by_container[r.container_id] = by_container.get(r.container_id, 0) + r.n_tokens
    assert set(by_item) == set(range(400)) and max(by_container.values()) <= 100
    for i, n in enumerate(sizes):
        assert sum(r.n_tokens for r in by_item[i]) == n and (len(by_item[i]) == 1 or n > 100)
    assert sorted(by_container) == list(range(len(by_container)))
    assert sum(sizes) / (100 * len(by_container)) > 0.9


def test_packing_edges(spark):
    empty = spark.createDataFrame([], "id long, n long")
    assert packing.pack(empty, "id", "n").count() == 0
    odd = spark.createDataFrame([(1, None), (2, 0)], "id long, n long")
    assert sorted((r.item_id, r.container_id, r.n_tokens) for r in packing.pack(odd, "id", "n").collect()) == [(1, 0, 0), (2, 0, 0)]
    one = spark.createDataFrame([(7, 250)], "id long, n long")
    assert sorted((r.piece_no, r.first_token, r.n_tokens) for r in packing.pack(one, "id", "n", capacity=100).collect()) == [(1, 0, 100), (2, 100, 100), (3, 200, 50)]
    hot = spark.createDataFrame([(i, 10) for i in range(1000)], "id long, n long")
    packing_rows, packing.SHARD_ROWS = packing.SHARD_ROWS, 50
    try:
        filled = packing.pack(hot, "id", "n", capacity=100).groupBy("container_id").agg(F.sum("n_tokens").alias("t")).collect()
    finally:
        packing.SHARD_ROWS = packing_rows
    assert len(filled) == 100 and {r.t for r in filled} == {100}


def mixture(spark, texts, targets, total=None):
    counted = spark.createDataFrame(texts, "source string, doc_id long, text_key string, n_tokens long")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    one, rates = mixing.prepared(counted, t, total)
    mixed = mixing.mix(one, rates)
    return mixed.collect(), {r.source: r for r in mixing.report(rates, mixed).collect()}


def test_mixing_meets_shares_and_caps(spark):
    texts = [("big", i, f"b{i}", 10) for i in range(6000)] + [("small", 10_000 + i, f"s{i}", 10) for i in range(300)] + [("mid", 20_000 + i, f"m{i}", 10) for i in range(1500)]
    targets = [("big", 0.5, 1), ("small", 0.2, 3), ("mid", 0.2, 2), ("gone", 0.1, 2)]
    rows, report = mixture(spark, texts, targets, 40_500)
    assert report["big"].reach_tokens == pytest.approx(40_500)
    assert max(r.copy_no for r in rows if r.source == "small") == 3 and report["gone"].actual_share == 0
    for s, share in (("big", 5 / 9), ("small", 2 / 9), ("mid", 2 / 9)):
        assert abs(report[s].actual_share - share) < 0.03
    keys = [(r.doc_id, r.copy_no) for r in rows]
    assert len(keys) == len(set(keys))
    again, _ = mixture(spark, texts, targets, 40_500)
    assert sorted(keys) == sorted((r.doc_id, r.copy_no) for r in again)


def test_mixing_reports_what_caps_leave_out(spark):
    texts = [("big", i, f"b{i}", 10) for i in range(6000)] + [("small", 10_000 + i, f"s{i}", 10) for i in range(300)] + [("mid", 20_000 + i, f"m{i}", 10) for i in range(1500)]
    rows, report = mixture(spark, texts, [("big", 0.5, 1), ("small", 0.2, 3), ("mid", 0.3, 2)])  # of all 78,000 tokens
    assert report["small"].wanted_tokens == pytest.approx(15_600) and report["small"].mixed_tokens == 9000 and report["small"].most_copies == 3
    assert abs(report["big"].mixed_tokens - 39_000) < 1500 and abs(report["mid"].mixed_tokens - 23_400) < 1500
    assert report["small"].actual_share < 0.14 and sum(r.actual_share for r in report.values()) == pytest.approx(1)
    above, far = mixture(spark, texts, [("big", 0.5, 1), ("small", 0.2, 3), ("mid", 0.3, 2)], 10_000_000)
    assert len(above) == 6000 + 900 + 3000 and {r.most_copies for r in far.values()} == {1, 2, 3}


def test_mixing_counts_equal_texts_once(spark):
    texts = [("a", i, "same", 10) for i in range(50)] + [("a", 99, "other", 10), (None, 5, "x", 10), ("no target", 6, "y", 10), ("a", 7, "blank", 0)]
    rows, _ = mixture(spark, texts, [("a", 1.0, 2)], 40)
    assert sorted((r.doc_id, r.copy_no) for r in rows) == [(0, 1), (0, 2), (99, 1), (99, 2)]
    assert mixture(spark, [], [("a", 1.0, 2)])[0] == []
