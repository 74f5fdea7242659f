"""Scores and decisions equal their SQL on odd rows, and no candidate pair is shuffled."""

import pytest

from siltstone.operators import entities as ops
from siltstone.queries import entities as queries
from tests.compare import same
from tests.shuffles import rows_shuffled

ENTITIES = [("PERSON", "p2", "Ann Lee"), ("PERSON", "p10", "ann  lee"), ("PERSON", "p3", "Bo"), ("ORGANIZATION", "o1", "Basin"), ("ORGANIZATION", "o1", "Basin"), ("PROJECT", "j0", ""), ("PROJECT", "j9", "Solo"), ("ORGANIZATION", "o7", "Delta"), ("PROJECT", "j8", None)] + [("PROJECT", f"j{i:03}", "Hot") for i in range(30)]
MENTIONS = [
    ("a", 1, "PERSON", "ANN LEE"), ("b", 1, "PERSON", "bo"), ("c", 2, "PERSON", "Bo"), ("d", 2, "ORGANIZATION", "Basins"), ("e", None, "PERSON", "Bo"), ("f", 3, "PROJECT", "hot"), ("f", 3, "PROJECT", "solo"), ("g", 3, "PROJECT", "Solo"),
    ("h", 4, "PROJECT", None), ("i", 4, "PROJECT", "?"), ("j", 5, "PROJECT", "Solo"), ("j", 6, "PROJECT", "Solo"), ("k", 6, "PROJECT", "Solo"), ("l", None, "PROJECT", "Solo"), ("l", 7, "PROJECT", "Hotx"), ("m", 8, "PERSON", "none"), ("n", 9, "ORGANIZATION", "deltas"), ("c", 2, "PERSON", "Bo"), ("o", 10, "PROJECT", "hots"),
]


@pytest.mark.parametrize("name", ["e08_scores", "e09_decisions"])
def test_odd_rows(name, spark):
    duckdb = pytest.importorskip("duckdb")
    tables = {"entity": spark.createDataFrame(ENTITIES, "entity_type string, entity_id string, name string"), "mention": spark.createDataFrame(MENTIONS, "mention_id string, document_id long, entity_type string, surface string")}
    con = duckdb.connect()
    con.execute("CREATE TABLE entity (entity_type VARCHAR, entity_id VARCHAR, name VARCHAR)")
    con.execute("CREATE TABLE mention (mention_id VARCHAR, document_id BIGINT, entity_type VARCHAR, surface VARCHAR)")
    con.executemany("INSERT INTO entity VALUES (?, ?, ?)", ENTITIES)
    con.executemany("INSERT INTO mention VALUES (?, ?, ?, ?)", MENTIONS)
    sql = queries.SQL[name]
    sql = "WITH e AS" + sql[sql.index("e AS (SELECT entity_type, entity_id") + 4 :]  # the same text over these tables in place of the views
    names = ops.named(tables["entity"])
    found = ops.evidence(tables["mention"], names)
    same(ops.scored(found, names) if name == "e08_scores" else ops.decisions(tables["mention"], found), con.sql(sql))


@pytest.mark.parametrize("name", ["e08_scores", "e09_decisions"])
def test_pairs_are_not_shuffled(name, spark, tmp_path):
    n = 1500  # entities and mentions of one name
    spark.range(n).selectExpr("id AS p_partkey", "'red bolt' AS p_name").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(n).selectExpr("id AS l_orderkey", "id AS l_partkey", "id AS l_suppkey", "1 AS l_linenumber").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([], "s_suppkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([], "c_custkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    found = {}
    moved = rows_shuffled(spark, lambda: found.update(n=queries.QUERIES[name](spark, str(tmp_path)).count()))
    assert found["n"] == (n * n if name == "e08_scores" else n)
    assert moved < 40 * n
