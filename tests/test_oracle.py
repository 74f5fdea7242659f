"""Every core query with an SQL equivalent gives the same rows as that SQL."""

import pytest

from siltstone import workload
from tests.compare import same

SQL = workload.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(name, spark, sf_dir, duck):
    same(workload.queries()[name](spark, sf_dir), duck.sql(SQL[name]))


def test_queries_without_sql_run(spark, sf_dir):
    for name in sorted(set(workload.queries()) - set(SQL)):
        df = workload.queries()[name](spark, sf_dir)
        rows = df.collect()
        assert rows, name
        key = {"t06_final_rank": ["query_id", "final_rank"], "j26_longest_spans": ["doc_id", "at"], "u13_document_batches": ["source", "doc_id"], "k09_section_kinds": ["section_id"]}.get(name)
        assert key is None or len({tuple(r[k] for k in key) for r in rows}) == len(rows), name


def test_flagship(spark, sf_dir):
    assert workload.flagship(spark, sf_dir).count() > 0
