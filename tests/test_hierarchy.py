"""Heavy-path hierarchies against walking up by hand."""

import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import hierarchy as h

SCHEMA = "child string, parent string, node string, path string, size long"


def build(spark, pairs):
    rows = spark.createDataFrame([(a, b, "clash", "clash", 0) for a, b in pairs], SCHEMA)
    return h.decompose(h.links(rows, h.name_key(F.col("child")), h.name_key(F.col("parent"))))


def by_hand(pairs):
    parent = {}
    for a, b in pairs:
        for x in (a, b):
            if x is not None:
                parent.setdefault(x, None)
        if a is not None and b is not None:
            parent[a] = b if parent[a] is None else min(parent[a], b)
    paths = {}
    for x in parent:
        path, y = [], x
        while y is not None and y not in path:
            path.append(y)
            y = parent[y]
        paths[x] = path[::-1] if y is None else None
    return paths


def check(spark, pairs):
    nodes = build(spark, pairs)
    rows = {r["node"]: r for r in nodes.collect()}
    paths = by_hand(pairs)
    assert set(rows) == set(paths)
    for x, p in paths.items():
        assert rows[x]["path"] == p and rows[x]["status"] == ("cycle" if p is None else "tree")
        if p:
            assert (rows[x]["root"], rows[x]["depth"]) == (p[0], len(p))
            assert rows[x]["subtree_size"] == sum(1 for q in paths.values() if q and x in q)
    pairs_below = {(r["node"], r["descendant"]) for r in h.descendants(nodes).collect()}
    assert pairs_below == {(a, x) for x, p in paths.items() if p for a in p[:-1]}


def test_random_forest_with_cycles(spark):
    rng = random.Random(4)
    names = [f"n{i:03d}" for i in range(120)]
    pairs = [(names[i], names[rng.randrange(i)] if i and rng.random() < 0.93 else None) for i in range(120)]
    pairs += [("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("under", "c2"), ("lower", "under"), ("self", "self")]
    check(spark, pairs + pairs[:30])


def test_long_chain_and_star(spark):
    check(spark, [(f"k{i:03d}", f"k{i - 1:03d}") for i in range(1, 70)] + [(f"leaf{i}", "k000") for i in range(30)])


def test_shards_and_blocks(spark, monkeypatch):
    """Children of one parent in several shards, intervals in several blocks."""
    monkeypatch.setattr(h, "SIBLINGS", 7)
    monkeypatch.setattr(h, "SPAN", 5)
    check(spark, [(f"leaf{i:02d}", "hub") for i in range(40)] + [(f"twig{i:02d}", f"leaf{i % 9:02d}") for i in range(30)] + [("hub", "top")])


def test_positions_without_paths(spark):
    rows = spark.createDataFrame([(f"k{i:04d}", f"k{i - 1:04d}") for i in range(1, 60)] + [(f"leaf{i}", "k0030") for i in range(50)], "child string, parent string")
    nodes = h.decompose(h.links(rows, F.col("child"), F.col("parent")), paths=False)
    got = {r["node"]: r for r in nodes.collect()}
    assert "path" not in nodes.columns and got["k0059"].depth == 60 and got["leaf7"].depth == 32 and got["k0030"].subtree_size == 80
    assert sorted(r.first_pos for r in got.values()) == list(range(110))
    assert all(got["k0030"].first_pos < got[f"leaf{i}"].first_pos <= got["k0030"].last_pos for i in range(50))


@pytest.mark.parametrize("pairs", [[("a", None)], [("a", "b")], [("a", "a")], [("a", "b"), ("a", "c")]])
def test_small(spark, pairs):
    check(spark, pairs)


def test_empty_and_null_names(spark):
    assert build(spark, []).count() == 0
    assert build(spark, [(None, None), (" ", " ")]).count() == 0
    assert [(r.node, r.depth) for r in build(spark, [(None, "p")]).collect()] == [("p", 1)]


def test_contradictions(spark):
    rows = [
        ("d", "Water", None, "Water", 1), ("d", "Reuse", " water", "Water > Reuse", 2), ("e", "REUSE ", None, "water >  reuse", 2), ("f", "Reuse", None, "Water > Reuse", 3), ("g", "Reuse", None, "Reuse", 1),
        ("h", "Reuse", None, None, 9), ("i", "x", "y", None, None), ("i", "y", "x", None, None), ("j", "Reuse", None, "Water > Reuse", None), ("j", "Reuse", None, "Water > Reuse", None), ("k", None, "Water", "Water", 1),
    ]
    df = spark.createDataFrame(rows, "document_id string, theme string, parent string, theme_path string, depth int")
    nodes = h.decompose(h.links(df, h.name_key(F.col("theme")), h.name_key(F.col("parent"))))
    found = h.contradicting_rows(df, nodes, "theme", "theme_path", "depth", ["document_id", "theme"])
    assert sorted(tuple(r) for r in found.collect()) == [("f", "Reuse"), ("g", "Reuse"), ("i", "x"), ("i", "y"), ("j", "Reuse")]
