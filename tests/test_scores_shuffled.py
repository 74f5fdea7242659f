"""What scoring shuffles: no lists or places of names beside mentions, and a mention once where names are no broadcast."""

import pytest
from py4j.protocol import Py4JJavaError

from siltstone.operators import entities as ops
from siltstone.plans import materialise
from siltstone.queries import entities as queries
from tests.compare import same
from tests.test_decisions import ENTITIES, MENTIONS


def shuffled(spark, action) -> tuple[int, int]:
    """Records and bytes that an action writes to shuffles; a stage that the store has dropped is one that was skipped."""
    context = spark.sparkContext
    store, group = context._jsc.sc().statusStore(), "shuffled"
    context.setJobGroup(group, group)
    try:
        action()
        context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        tracker = context.statusTracker()
        stages = {s for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds}
    finally:
        context._jsc.sc().clearJobGroup()
    records, size = 0, 0
    for s in stages:
        try:
            stage = store.lastStageAttempt(s)
        except Py4JJavaError as e:
            assert "NoSuchElement" in str(e)
            continue
        records, size = records + stage.shuffleWriteRecords(), size + stage.shuffleWriteBytes()
    return records, size


@pytest.fixture
def no_broadcast(spark, monkeypatch):
    monkeypatch.setattr(materialise, "BROADCAST_BYTES", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def frames(spark, tmp_path, entities, mentions):
    """Entities and mentions from files, so that no shuffle but that of the operators counts."""
    spark.createDataFrame(entities, "entity_type string, entity_id string, name string").write.parquet(f"{tmp_path}/e")
    spark.createDataFrame(mentions, "mention_id string, document_id long, entity_type string, surface string").write.parquet(f"{tmp_path}/m")
    return spark.read.parquet(f"{tmp_path}/e"), spark.read.parquet(f"{tmp_path}/m")


def test_lists_stay_out_of_shuffles(spark, tmp_path):
    names, n = 300, 6000
    entities = [("PROJECT", f"j{i}", f"name {i * 7919 % names}") for i in range(names * 40)]
    mentions = [(f"j-{i}-{i * 31 % 999}", i // 2, "PROJECT", f"Name {i * 104729 % names}") for i in range(n)]
    e, m = frames(spark, tmp_path, entities, mentions)
    listed, rows = ops.named(e), []
    _, size = shuffled(spark, lambda: rows.append(ops.scored(ops.evidence(m, listed), listed).count()))
    assert rows == [n * 40]
    assert size < 55 * n  # 83 with the places of the lists beside each mention


@pytest.mark.parametrize("many", [3, 1000])
def test_names_that_are_no_broadcast(spark, no_broadcast, monkeypatch, many):
    duckdb = pytest.importorskip("duckdb")
    monkeypatch.setattr(ops, "MANY", many)
    con = duckdb.connect()
    con.execute("CREATE TABLE entity (entity_type VARCHAR, entity_id VARCHAR, name VARCHAR)")
    con.execute("CREATE TABLE mention (mention_id VARCHAR, document_id BIGINT, entity_type VARCHAR, surface VARCHAR)")
    con.executemany("INSERT INTO entity VALUES (?, ?, ?)", ENTITIES)
    con.executemany("INSERT INTO mention VALUES (?, ?, ?, ?)", MENTIONS)
    sql = queries.SQL["e08_scores"]
    sql = "WITH e AS" + sql[sql.index("e AS (SELECT entity_type, entity_id") + 4 :]
    names = ops.named(spark.createDataFrame(ENTITIES, "entity_type string, entity_id string, name string"))
    found = ops.evidence(spark.createDataFrame(MENTIONS, "mention_id string, document_id long, entity_type string, surface string"), names)
    same(ops.scored(found, names), con.sql(sql))


def test_mentions_are_not_shuffled_by_list(spark, no_broadcast, tmp_path):
    n = 1500  # entities and mentions of one name
    e, m = frames(spark, tmp_path, [("PROJECT", f"j{i}", "Hot") for i in range(n)], [(f"j-{i}", i, "PROJECT", "hot") for i in range(n)])
    listed, rows = ops.named(e), []
    records, _ = shuffled(spark, lambda: rows.append(ops.scored(ops.evidence(m, listed), listed).count()))
    assert rows == [n * n]
    assert records < 20 * n  # 27 with a row for each list
