"""Queries of the general data-preparation problems: timestamps (p1) and hierarchies (p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import hierarchy, timestamps
from siltstone.queries import table


def _stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = [("pdf_created", F.col("pdf_created"), None), ("file_created", F.col("file_created"), None)]
    start, precision = F.col("canonical.effective_start_date"), F.col("canonical.start_precision")
    stage = [("record_changed", F.col("record_changed"), None), ("effective_start_date", start, F.coalesce(precision, F.lit("day")))]
    values = timestamps.stated_values(table(spark, sf_dir, "pdf_evidence"), evidence, "document_id", "evidence_id")
    values = values.unionByName(timestamps.stated_values(table(spark, sf_dir, "dates_stage"), stage, "document_id", "stage_id"))
    return timestamps.normalise_stamps(values, table(spark, sf_dir, "stamp_reader"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of readings of one document that name the same moment or period."""
    return timestamps.same_meaning_pairs(_stamps(spark, sf_dir))


def p1_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stated stamp with its UTC instant or dated period, null where it names none."""
    return _stamps(spark, sf_dir).withColumnRenamed("group_id", "document_id").distinct()


def _hierarchy(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "documents_theme")
    return rows, hierarchy.decompose(hierarchy.links(rows, hierarchy.name_key(F.col("theme")), hierarchy.name_key(F.col("parent"))))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of documents_theme that contradict the tree of themes."""
    rows, nodes = _hierarchy(spark, sf_dir)
    return hierarchy.contradicting_rows(rows, nodes, "theme", "theme_path", "depth", ["document_id", "theme"])


def p5_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root, path, depth and number of nodes below, for every theme."""
    _, nodes = _hierarchy(spark, sf_dir)
    return nodes.select("node", "status", "root", F.col("depth").cast("long").alias("depth"), F.array_join("path", hierarchy.SEPARATOR).alias("path"), F.when(F.col("root").isNotNull(), F.col("subtree_size")).alias("subtree_size"))


def p5_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a theme and a theme below it."""
    return hierarchy.descendants(_hierarchy(spark, sf_dir)[1])


QUERIES = {f.__name__: f for f in (p1_found, p1_normalised, p5_found, p5_hierarchy, p5_descendants)}

_WHITE = r"\t-\r \x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _key(name: str) -> str:
    return f"nullif(lower(trim(regexp_replace({name}, '[{_WHITE}]+', ' ', 'g'))), '')"


_TREE = f"""
WITH RECURSIVE pairs AS (SELECT {_key('theme')} AS node, {_key('parent')} AS parent FROM documents_theme),
edges AS (SELECT node, min(parent) AS parent FROM (SELECT * FROM pairs UNION ALL SELECT parent, NULL FROM pairs) WHERE node IS NOT NULL GROUP BY node),
tree AS (
  SELECT node, node AS root, [node] AS path FROM edges WHERE parent IS NULL
  UNION ALL
  SELECT e.node, t.root, list_append(t.path, e.node) FROM edges e JOIN tree t ON e.parent = t.node
)"""

SQL = {
    "p5_hierarchy": _TREE
    + """, below AS (SELECT a AS node, count(*) AS n FROM (SELECT unnest(path) AS a FROM tree) GROUP BY a)
SELECT e.node, CASE WHEN t.root IS NULL THEN 'cycle' ELSE 'tree' END AS status, t.root, CAST(len(t.path) AS BIGINT) AS depth,
  array_to_string(t.path, ' > ') AS path, b.n AS subtree_size
FROM edges e LEFT JOIN tree t USING (node) LEFT JOIN below b USING (node)""",
    "p5_descendants": _TREE + " SELECT a AS node, node AS descendant FROM (SELECT unnest(path) AS a, node FROM tree) WHERE a <> node",
    "p5_found": _TREE
    + f""", stored AS (
  SELECT document_id, theme, {_key('theme')} AS node, depth, theme_path,
    list_transform(string_split(theme_path, ' > '), lambda x: coalesce({_key('x')}, '')) AS names FROM documents_theme)
SELECT DISTINCT s.document_id, s.theme FROM stored s LEFT JOIN tree t ON t.node = s.node
WHERE s.node IS NOT NULL AND (t.node IS NULL OR (s.theme_path IS NOT NULL AND (s.names <> t.path OR s.depth IS DISTINCT FROM len(t.path))))""",
}
