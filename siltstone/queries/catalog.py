"""Catalog analytics over documents, authors, themes, tags and attachments."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import catalog as ops
from siltstone.operators import periods
from siltstone.operators.catalog import Catalog, Scope
from siltstone.sources.views import ctes, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

YEAR = Scope(date_from=date(1997, 1, 1), date_to=date(1998, 1, 1))
WEB = Scope(source_type="website", date_from=date(1997, 1, 1), date_to=date(1998, 1, 1))
ASIA = Scope(theme="ASIA", theme_path="ASIA", date_from=date(1996, 1, 1), date_to=date(1999, 1, 1))
IN_YEAR = "effective_start_date >= TIMESTAMP '1997-01-01' AND effective_start_date < TIMESTAMP '1998-01-01'"
IN_ASIA = """document_id IN (SELECT document_id FROM cat_theme WHERE theme_path = 'ASIA' OR starts_with(theme_path, 'ASIA > ') OR (theme_path IS NULL AND (theme = 'ASIA' OR parent = 'ASIA')))
  AND effective_start_date >= TIMESTAMP '1996-01-01' AND effective_start_date < TIMESTAMP '1999-01-01'"""


def load(spark: SparkSession, sf_dir: str) -> Catalog:
    return Catalog(*(view(spark, sf_dir, n) for n in ("cat_document", "cat_author", "cat_theme", "cat_tag", "cat_attachment")))


def add(name: str, run: Callable[[Catalog], DataFrame], sql: str | None = None, views: tuple[str, ...] = ("cat_document",)) -> None:
    QUERIES[name] = lambda spark, sf_dir: run(load(spark, sf_dir))
    if sql:
        SQL[name] = ctes(*views) + sql


D, A, T, G, X = "cat_document", "cat_author", "cat_theme", "cat_tag", "cat_attachment"

add("s01_scan_by_source_type", lambda c: c.documents.where("source_type = 'pdf_attachment'").select("document_id", "bundle"), "SELECT document_id, bundle FROM cat_document WHERE source_type = 'pdf_attachment'")
add("s02_titled_nodes", lambda c: c.documents.where("source_type = 'website' AND title IS NOT NULL AND title <> ''").select("document_id", "title"), "SELECT document_id, title FROM cat_document WHERE source_type = 'website' AND title <> ''")
add("s07_live_ids", lambda c: c.documents.select("document_id").distinct(), "SELECT DISTINCT document_id FROM cat_document")
add(
    "f01_scope_conjunction",
    lambda c: Scope(source_type="website", bundle="1-URGENT", title_contains="report 1", author="supplier#00000000", theme_group="main", tag="nO", date_from=date(1996, 1, 1)).apply(c).select("document_id"),
    """SELECT document_id FROM cat_document WHERE source_type = 'website' AND bundle = '1-URGENT' AND lower(title) LIKE '%report 1%'
  AND document_id IN (SELECT document_id FROM cat_author WHERE lower(author) LIKE '%supplier#00000000%') AND document_id IN (SELECT document_id FROM cat_theme WHERE theme_group = 'main')
  AND document_id IN (SELECT document_id FROM cat_tag WHERE lower(tag) = 'no') AND effective_start_date >= TIMESTAMP '1996-01-01'""",
    (D, A, T, G),
)
add("f02_title_contains", lambda c: Scope(title_contains="OF 1-urg").apply(c).select("document_id"), "SELECT document_id FROM cat_document WHERE contains(lower(title), 'of 1-urg')")
add("f03_any_term", lambda c: Scope(topic_terms=["Report 7 ", "low"]).apply(c).select("document_id"), "SELECT document_id FROM cat_document WHERE contains(lower(title), 'report 7 ') OR contains(lower(title), 'low')")
add("f04_date_window", lambda c: YEAR.apply(c).select("document_id"), f"SELECT document_id FROM cat_document WHERE {IN_YEAR}")
add("f05_theme_scope", lambda c: ASIA.apply(c).select("document_id"), f"SELECT document_id FROM cat_document WHERE {IN_ASIA}", (D, T))
add("f06_theme_group", lambda c: ops.count_documents(c, Scope(theme_group="other")), "SELECT count(DISTINCT document_id) AS documents FROM cat_document WHERE document_id IN (SELECT document_id FROM cat_theme WHERE theme_group = 'other')", (D, T))
add("f07_find_tag", lambda c: ops.find_tag(c, "ro"), "SELECT tag FROM (SELECT DISTINCT tag FROM cat_tag) WHERE lower(tag) = 'ro' ORDER BY tag <> 'ro', tag LIMIT 1", (G,))
add("f12_theme_ids", lambda c: ops.ids_in_scope(c, ASIA, 2000, 10_000).select("document_id"), f"SELECT document_id FROM cat_document WHERE {IN_ASIA} ORDER BY effective_start_date DESC NULLS LAST, document_id LIMIT 2000", (D, T))
add(
    "f13_floor_by_precision",
    lambda c: c.documents.select("document_id", periods.floor_date(F.col("effective_start_date"), F.col("start_precision")).alias("floored")),
    "SELECT document_id, CAST(CASE start_precision WHEN 'year' THEN date_trunc('year', effective_start_date) WHEN 'month' THEN date_trunc('month', effective_start_date) ELSE date_trunc('day', effective_start_date) END AS DATE) AS floored FROM cat_document",
)
_LO, _HI = date(1997, 3, 15), date(1997, 9, 10)
add(
    "f14_period_overlap",
    lambda c: c.documents.where(periods.period_in_scope(F.col("effective_start_date"), F.col("start_precision"), F.col("effective_end_date"), F.col("end_precision"), _LO, _HI, F.col("bundle") == "5-LOW")).select("document_id"),
    """SELECT document_id FROM cat_document WHERE CAST(effective_start_date AS DATE) < DATE '1997-09-10' AND (
  (effective_end_date IS NOT NULL AND CAST(effective_end_date AS DATE) >= CASE end_precision WHEN 'month' THEN DATE '1997-03-01' ELSE DATE '1997-03-15' END) OR bundle = '5-LOW'
  OR (effective_end_date IS NULL AND CAST(effective_start_date AS DATE) >= CASE start_precision WHEN 'year' THEN DATE '1997-01-01' WHEN 'month' THEN DATE '1997-03-01' ELSE DATE '1997-03-15' END))""",
)


def _relaxed(c: Catalog) -> DataFrame:
    strict = Scope(bundle="no such bundle", date_from=date(1997, 1, 1), date_to=date(1997, 2, 1)).apply(c).select("document_id")
    loose = Scope(date_from=date(1997, 1, 1), date_to=date(1997, 2, 1)).apply(c).select("document_id")
    found = strict.agg((F.count("*") == 0).alias("none"))
    return strict.unionByName(loose.join(F.broadcast(found)).where("none").select("document_id"))


add("f16_relax_to_dates", _relaxed, "SELECT document_id FROM cat_document WHERE effective_start_date >= TIMESTAMP '1997-01-01' AND effective_start_date < TIMESTAMP '1997-02-01'")
add("proj01_projection", lambda c: c.documents.select(*[f for f in ("document_id", "title", "no_such_field", "bundle") if f in c.documents.columns]), "SELECT document_id, title, bundle FROM cat_document")
add(
    "proj02_record_defaults",
    lambda c: c.documents.select("document_id", F.coalesce(F.date_format("effective_start_date", "yyyy-MM-dd"), F.lit("")).alias("date"), F.coalesce("changed_mark", F.lit(0).cast("long")).alias("changed_mark")),
    "SELECT document_id, coalesce(strftime(effective_start_date, '%Y-%m-%d'), '') AS date, coalesce(changed_mark, 0) AS changed_mark FROM cat_document",
)
add(
    "proj03_timeline",
    lambda c: WEB.apply(c).groupBy(F.year("effective_start_date").cast("long").alias("year"), "bundle").agg(F.concat_ws("; ", F.slice(F.sort_array(F.collect_list(F.concat_ws("/", F.col("document_id").cast("string"), F.replace("title", F.lit("|"), F.lit("\\|"))))), 1, 5)).alias("line")),
    f"""SELECT CAST(year(effective_start_date) AS BIGINT) AS year, bundle, array_to_string(list_sort(list(concat_ws('/', CAST(document_id AS VARCHAR), replace(title, '|', '\\|'))))[1:5], '; ') AS line
  FROM cat_document WHERE source_type = 'website' AND {IN_YEAR} GROUP BY 1, 2""",
)
add(
    "proj06_date_label",
    lambda c: c.documents.select("document_id", periods.label(F.col("effective_start_date"), F.col("start_precision")).alias("label")),
    "SELECT document_id, left(strftime(effective_start_date, '%Y-%m-%d'), CASE start_precision WHEN 'year' THEN 4 WHEN 'month' THEN 7 ELSE 10 END) AS label FROM cat_document",
)
add("a01_count_documents", lambda c: ops.count_documents(c, ASIA), f"SELECT count(DISTINCT document_id) AS documents FROM cat_document WHERE {IN_ASIA}", (D, T))
for _by, _key, _views in (("bundle", "bundle", (D,)), ("year", "CAST(year(effective_start_date) AS VARCHAR)", (D,)), ("theme", "theme", (D, T)), ("tag", "tag", (D, G))):
    _join = {"theme": "JOIN cat_theme USING (document_id)", "tag": "JOIN cat_tag USING (document_id)"}.get(_by, "")
    add(
        f"a02_distribution_{_by}",
        lambda c, by=_by: ops.distribution(c, Scope(source_type="website"), by, 20),
        f"SELECT value, documents FROM (SELECT {_key} AS value, count(DISTINCT document_id) AS documents FROM cat_document {_join} WHERE source_type = 'website' GROUP BY 1 ORDER BY documents DESC, value ASC NULLS FIRST LIMIT 20) WHERE value IS NOT NULL",
        _views,
    )
add(
    "a03_distribution_author",
    lambda c: ops.distribution(c, YEAR, "author", 50),
    f"SELECT value, documents FROM (SELECT coalesce(author_norm, author) AS k, min(author) AS value, count(DISTINCT document_id) AS documents FROM cat_document JOIN cat_author USING (document_id) WHERE {IN_YEAR} GROUP BY k ORDER BY documents DESC, k LIMIT 50)",
    (D, A),
)
add(
    "a04_distribution_in_group",
    lambda c: ops.distribution(c, ASIA, "theme", 30, theme_group="other"),
    f"SELECT theme AS value, count(DISTINCT document_id) AS documents FROM cat_document JOIN cat_theme USING (document_id) WHERE theme_group = 'other' AND {IN_ASIA} GROUP BY theme ORDER BY documents DESC, theme LIMIT 30",
    (D, T),
)
add(
    "a05_cross_bundle_theme",
    lambda c: ops.cross_distribution(c, YEAR, "bundle", "theme", 100),
    f"SELECT bundle AS first_value, theme AS second_value, count(DISTINCT document_id) AS documents FROM cat_document JOIN cat_theme USING (document_id) WHERE {IN_YEAR} GROUP BY 1, 2 ORDER BY documents DESC, 1, 2 LIMIT 100",
    (D, T),
)
add(
    "j02_cross_theme_tag",
    lambda c: ops.cross_distribution(c, YEAR, "theme", "tag", 100),
    f"SELECT theme AS first_value, tag AS second_value, count(DISTINCT document_id) AS documents FROM cat_document JOIN cat_theme USING (document_id) JOIN cat_tag USING (document_id) WHERE {IN_YEAR} GROUP BY 1, 2 ORDER BY documents DESC, 1, 2 LIMIT 100",
    (D, T, G),
)
add("a06_count_authors", lambda c: ops.count_distinct_values(c, YEAR, "author"), f"SELECT count(DISTINCT coalesce(author_norm, author)) AS n_values FROM cat_document JOIN cat_author USING (document_id) WHERE {IN_YEAR}", (D, A))
add("a07_distinct_bundles", lambda c: ops.distinct_values(c, YEAR, "bundle"), f"SELECT DISTINCT bundle AS value FROM cat_document WHERE {IN_YEAR}")
add("a07_distinct_tags", lambda c: ops.distinct_values(c, Scope(), "tag"), "SELECT DISTINCT tag AS value FROM cat_tag JOIN cat_document USING (document_id)", (D, G))
add("a08_date_range", lambda c: ops.date_range(c, WEB), f"SELECT min(effective_start_date) AS first_date, max(effective_start_date) AS last_date FROM cat_document WHERE source_type = 'website' AND {IN_YEAR}")
add("a09_revision", ops.revision, "SELECT concat(strftime(max(indexed_at), '%Y-%m-%d %H:%M:%S'), '|', count(*)) AS revision FROM cat_document")
add(
    "a10_theme_vocabulary",
    lambda c: ops.theme_vocabulary(c),
    """SELECT theme, theme_type, parent, theme_group, theme_path, depth, documents FROM (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY documents DESC, theme_type, parent, theme_path) AS rn FROM (
  SELECT theme, theme_type, parent, theme_group, theme_path, depth, count(DISTINCT document_id) AS documents FROM cat_theme GROUP BY ALL)) WHERE rn = 1""",
    (T,),
)
add(
    "a11_stale_census",
    lambda c: c.documents.where("doc_version < 3").groupBy("bundle").agg(F.count("*").alias("n"), F.min("changed_mark").alias("first_mark"), F.count_if(F.col("changed_mark").isNull()).alias("unmarked")),
    "SELECT bundle, count(*) AS n, min(changed_mark) AS first_mark, count(*) FILTER (WHERE changed_mark IS NULL) AS unmarked FROM cat_document WHERE doc_version < 3 GROUP BY bundle",
)
add("a12_floors", lambda c: c.documents.where("doc_version = 2").groupBy("bundle").agg(F.min("changed_mark").alias("floor")), "SELECT bundle, min(changed_mark) AS floor FROM cat_document WHERE doc_version = 2 GROUP BY bundle")
add("a14_counts_by_type", lambda c: c.documents.groupBy("source_type", "doc_version").agg(F.count("*").alias("n")), "SELECT source_type, doc_version, count(*) AS n FROM cat_document GROUP BY 1, 2")
add("t01_list_documents", lambda c: ops.list_documents(c, Scope(source_type="website", topic_terms=["report 7 ", "low"]), 100, 50).select("document_id", "title"), """SELECT document_id, title FROM cat_document WHERE source_type = 'website' AND (contains(lower(title), 'report 7 ') OR contains(lower(title), 'low'))
  ORDER BY CAST(contains(lower(title), 'report 7 ') AS INT) + CAST(contains(lower(title), 'low') AS INT) DESC, effective_start_date DESC NULLS LAST, document_id LIMIT 100 OFFSET 50""")  # fmt: skip
add("t02_ids_in_scope", lambda c: ops.ids_in_scope(c, WEB).select("document_id"), f"SELECT document_id FROM cat_document WHERE source_type = 'website' AND {IN_YEAR} ORDER BY effective_start_date DESC NULLS LAST, document_id LIMIT 300")
add("t03_theme_documents", lambda c: ops.ids_in_scope(c, Scope(theme="NATION_12", theme_path="ASIA > NATION_12"), 2000, 10_000).select("document_id"), "SELECT document_id FROM cat_document WHERE document_id IN (SELECT document_id FROM cat_theme WHERE theme_path = 'ASIA > NATION_12' OR starts_with(theme_path, 'ASIA > NATION_12 > ') OR (theme_path IS NULL AND (theme = 'NATION_12' OR parent = 'NATION_12'))) ORDER BY effective_start_date DESC NULLS LAST, document_id LIMIT 2000", (D, T))
add("t04_list_with_total", lambda c: ops.list_with_total(c, WEB, 20), f"SELECT document_id, title, (SELECT count(DISTINCT document_id) FROM cat_document WHERE source_type = 'website' AND {IN_YEAR}) AS total FROM cat_document WHERE source_type = 'website' AND {IN_YEAR} ORDER BY effective_start_date DESC NULLS LAST, document_id LIMIT 20")
add("j01_facet_semi_join", lambda c: Scope(author="supplier#000000007").apply(c).select("document_id"), "SELECT document_id FROM cat_document WHERE document_id IN (SELECT document_id FROM cat_author WHERE contains(lower(author), 'supplier#000000007'))", (D, A))
add(
    "j03_content_abstracts",
    lambda c: ops.by_content(c, WEB, c.documents.groupBy("content_hash").agg(F.min("title").alias("abstract")).where("content_hash % 3 > 0")),
    f"SELECT document_id, abstract FROM cat_document JOIN (SELECT content_hash, min(title) AS abstract FROM cat_document GROUP BY 1 HAVING content_hash % 3 > 0) USING (content_hash) WHERE source_type = 'website' AND {IN_YEAR}",
)
add("j04_attachments", lambda c: ops.attachments_of(c, WEB), f"SELECT document_id, list_sort(list(DISTINCT file_uuid)) AS files FROM cat_attachment WHERE document_id IN (SELECT document_id FROM cat_document WHERE source_type = 'website' AND {IN_YEAR}) GROUP BY document_id", (D, X))
add(
    "j05_orphaned_files",
    lambda c: ops.orphaned_attachments(c.attachments, c.attachments, c.documents.where("document_id % 40 > 0").select("document_id")),
    "SELECT DISTINCT file_uuid FROM cat_attachment WHERE file_uuid NOT IN (SELECT file_uuid FROM cat_attachment WHERE document_id NOT IN (SELECT document_id FROM cat_document WHERE document_id % 40 > 0))",
    (D, X),
)
_TAXONOMY = "SELECT DISTINCT r_name AS theme, NULL AS parent, CASE WHEN r_regionkey < 3 THEN 'main' ELSE 'other' END AS theme_group, r_name AS theme_path, 1 AS depth FROM region UNION ALL SELECT n_name, r_name, CASE WHEN r_regionkey < 3 THEN 'main' ELSE 'other' END, concat(r_name, ' > ', n_name), 2 FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey % 4 > 0"


def n01_classify_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored names of themes against a taxonomy."""
    nation, region = view(spark, sf_dir, "nation"), view(spark, sf_dir, "region")
    group = F.when(F.col("r_regionkey") < 3, "main").otherwise("other")
    top = region.select(F.col("r_name").alias("theme"), F.lit(None).cast("string").alias("parent"), group.alias("theme_group"), F.col("r_name").alias("theme_path"), F.lit(1).alias("depth"))
    sub = nation.where("n_nationkey % 4 > 0").join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    sub = sub.select(F.col("n_name").alias("theme"), F.col("r_name").alias("parent"), group.alias("theme_group"), F.concat_ws(" > ", "r_name", "n_name").alias("theme_path"), F.lit(2).alias("depth"))
    names = nation.select(F.lower("n_name").alias("name")).unionByName(region.select(F.col("r_name").alias("name")))
    return ops.classify_themes(names, top.unionByName(sub))


QUERIES["n01_classify_themes"] = n01_classify_themes
SQL["n01_classify_themes"] = f"""WITH tax AS ({_TAXONOMY}), names AS (SELECT lower(n_name) AS name FROM nation UNION ALL SELECT r_name FROM region)
SELECT name, CASE WHEN t.theme IS NULL THEN 'unknown' WHEN t.depth = 1 THEN 'main' ELSE 'sub' END AS theme_type, t.parent, t.theme_group, coalesce(t.theme_path, name) AS theme_path, coalesce(t.depth, 1) AS depth
FROM names LEFT JOIN tax t ON lower(t.theme) = lower(name)"""
add("n05_theme_tree", ops.theme_tree, "SELECT theme_group, parent, list_sort(list(DISTINCT theme)) AS children, count(*) AS links FROM (SELECT DISTINCT theme_group, parent, theme, document_id FROM cat_theme WHERE parent IS NOT NULL) GROUP BY 1, 2", (T,))
add("n02_themes_by_group", lambda c: c.themes.groupBy("theme_group").agg(F.sort_array(F.collect_set("theme")).alias("themes")), "SELECT theme_group, list_sort(list(DISTINCT theme)) AS themes FROM cat_theme GROUP BY 1", (T,))
def n06_unique_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that lead to exactly one document, and that document."""
    d = view(spark, sf_dir, "documents").where("title IS NOT NULL")
    return d.groupBy(F.lower(F.trim("title")).alias("asked")).agg(F.count_distinct("doc_id").alias("n"), F.min("doc_id").alias("doc_id")).where("n = 1").select("asked", "doc_id")


QUERIES["n06_unique_title"] = n06_unique_title
SQL["n06_unique_title"] = "SELECT lower(trim(title)) AS asked, min(doc_id) AS doc_id FROM documents WHERE title IS NOT NULL GROUP BY 1 HAVING count(DISTINCT doc_id) = 1"


def facet_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.facet_duplicates(view(spark, sf_dir, "documents_theme"), ["document_id", "theme"])


def themes_f08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "documents_theme").where(~F.col("theme").isin(*ops.NOT_THEMES)).groupBy("theme").agg(F.count_distinct("document_id").alias("documents"))


QUERIES |= {"a13_facet_duplicates": facet_duplicates, "f08_named_themes": themes_f08}
SQL |= {
    "a13_facet_duplicates": "SELECT document_id, theme, count(*) AS copies FROM documents_theme GROUP BY 1, 2 HAVING count(*) > 1",
    "f08_named_themes": "SELECT theme, count(DISTINCT document_id) AS documents FROM documents_theme WHERE theme NOT IN ('', 'False', 'True') GROUP BY theme",
}
