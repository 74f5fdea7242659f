"""Catalog-shaped views derived from the driver's tables.

Each view is one portable SELECT. On Spark its tables are bound as DataFrames (no global temp names); the oracle SQL gets the
same text as common table expressions, so both sides read the same input and the operators on top are what is compared.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "cat_document": """SELECT o_orderkey AS document_id, CASE WHEN o_orderstatus='P' THEN 'pdf_attachment' ELSE 'website' END AS source_type, 'node' AS entity_type, o_orderpriority AS bundle,
  concat('Report ', CAST(o_orderkey % 97 AS VARCHAR(10)), ' of ', o_orderpriority) AS title,
  CASE WHEN o_orderkey % 50 = 0 THEN NULL WHEN o_orderkey % 4 = 0 THEN date_trunc('year', o_orderdate) WHEN o_orderkey % 4 = 1 THEN date_trunc('month', o_orderdate) ELSE o_orderdate END AS effective_start_date,
  CASE WHEN o_orderkey % 4 = 0 THEN 'year' WHEN o_orderkey % 4 = 1 THEN 'month' ELSE 'day' END AS start_precision,
  CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL '400' DAY END AS effective_end_date,
  CASE WHEN o_orderkey % 6 = 0 THEN 'month' ELSE 'day' END AS end_precision,
  1 + o_orderkey % 3 AS doc_version, o_custkey % 40 AS content_hash, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey * 10 END AS changed_mark, o_orderdate AS indexed_at
  FROM {orders}""",
    "cat_author": """SELECT DISTINCT l_orderkey AS document_id, s_name AS author, CASE WHEN s_suppkey % 10 = 0 THEN NULL ELSE lower(s_name) END AS author_norm
  FROM {lineitem} JOIN {supplier} ON s_suppkey = l_suppkey""",
    "cat_theme": """SELECT DISTINCT l_orderkey AS document_id, n_name AS theme, 'sub' AS theme_type, r_name AS parent, CASE WHEN r_regionkey < 3 THEN 'main' ELSE 'other' END AS theme_group,
  CASE WHEN n_nationkey % 7 = 0 THEN NULL ELSE concat(r_name, ' > ', n_name) END AS theme_path, 2 AS depth
  FROM {lineitem} JOIN {supplier} ON s_suppkey = l_suppkey JOIN {nation} ON n_nationkey = s_nationkey JOIN {region} ON r_regionkey = n_regionkey""",
    "cat_tag": "SELECT DISTINCT l_orderkey AS document_id, concat(l_returnflag, l_linestatus) AS tag FROM {lineitem}",
    "cat_attachment": "SELECT DISTINCT l_partkey AS file_uuid, l_orderkey AS document_id FROM {lineitem}",
    "chunk": """SELECT vec_id AS chunk_id, vec_id % 60 AS document_id, CASE WHEN vec_id % 5 = 0 THEN NULL ELSE vec_id - vec_id % 5 END AS parent_chunk_id, vec_id % 5 = 0 AS is_parent,
  CASE WHEN vec_id % 11 = 0 THEN 'toc' WHEN vec_id % 13 = 0 THEN 'glossary' END AS section_type, CASE WHEN vec_id % 3 = 0 THEN 'website' ELSE 'pdf_attachment' END AS source_type, 1 + vec_id % 2 AS doc_version, vec_id % 9 AS chunk_index, label, embedding
  FROM {embeddings}""",
    "claim": """SELECT DISTINCT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, CAST(l_shipdate AS DATE)) AS claim_id, l_partkey AS subject_id,
  CASE l_returnflag WHEN 'A' THEN 'LED_BY' WHEN 'N' THEN 'WORKS_AT' ELSE 'FUNDED_BY' END AS predicate, o_custkey AS object_id, CAST(o_orderdate AS DATE) AS valid_from,
  CASE WHEN l_linenumber = 3 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS valid_until,
  CASE l_linenumber % 3 WHEN 0 THEN 'stated' WHEN 1 THEN 'subject_period' ELSE 'document' END AS temporal_basis, CASE WHEN l_orderkey % 29 = 0 THEN 'retracted' ELSE 'active' END AS status,
  l_orderkey AS document_id, 0.5 + l_discount AS confidence
  FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey WHERE l_shipdate > o_orderdate""",
    "entity": """SELECT 'PERSON' AS entity_type, concat('p', c_custkey) AS entity_id, c_name AS name FROM {customer}
  UNION ALL SELECT 'ORGANIZATION', concat('o', s_suppkey), s_name FROM {supplier} UNION ALL SELECT 'PROJECT', concat('j', p_partkey), p_name FROM {part}""",
    "mention": """SELECT DISTINCT concat_ws('-', 'j', l_orderkey, l_partkey) AS mention_id, l_orderkey AS document_id, 'PROJECT' AS entity_type, p_name AS surface FROM {lineitem} JOIN {part} ON p_partkey = l_partkey WHERE l_linenumber = 1
  UNION ALL SELECT DISTINCT concat_ws('-', 'o', l_orderkey, l_suppkey), l_orderkey, 'ORGANIZATION', CASE WHEN l_suppkey % 4 = 0 THEN concat(s_name, 'x') ELSE upper(s_name) END FROM {lineitem} JOIN {supplier} ON s_suppkey = l_suppkey WHERE l_linenumber = 2
  UNION ALL SELECT concat_ws('-', 'p', o_orderkey, c_custkey), o_orderkey, 'PERSON', lower(c_name) FROM {orders} JOIN {customer} ON c_custkey = o_custkey WHERE o_orderkey % 3 = 0""",
    "ingest_log": """SELECT event_id AS id, user_id AS document_id, event_type AS status, ts AS event_time, value AS latency_ms, props FROM {events}""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named view, or the named table where no view has that name."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in re.findall(r"{(\w+)}", sql)}
    return spark.sql(sql, **tables)


def ctes(*names: str) -> str:
    """``WITH`` clause that defines the views for DuckDB; nothing where no name is a view."""
    parts = [f"{n} AS ({re.sub(r'{(\w+)}', r'\1', VIEWS[n])})" for n in names if n in VIEWS]
    return "WITH " + ",\n".join(parts) + "\n" if parts else ""
