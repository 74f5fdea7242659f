"""Entities, mentions, titles and small set operations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions import text
from siltstone.operators import entities as ops
from siltstone.sources import web
from siltstone.sources.views import ctes, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: view(spark, sf_dir, name))
        if sql:
            SQL[f.__name__] = (ctes(*views).rstrip() + (", " if sql.startswith("+") else " ") + sql.lstrip("+")) if views else sql
        return f

    return register


def _fold(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({c}), '[''’`]', '', 'g'), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


@query(f"SELECT entity_type, {_fold('name')} AS normalized, min(entity_id) AS entity_id, arg_min(name, entity_id) AS name, count(DISTINCT entity_id) AS ids, count(DISTINCT name) AS spellings FROM entity GROUP BY 1, 2", "entity")
def e01_seed_entities(t):
    return ops.seed(t("entity"))


@query(f"SELECT normalized, count(DISTINCT entity_type) AS types, count(DISTINCT entity_id) AS ids, count(DISTINCT entity_type) = 1 AND count(DISTINCT entity_id) = 1 AS autolink FROM (SELECT *, {_fold('name')} AS normalized FROM entity) WHERE length(normalized) >= 3 GROUP BY 1", "entity")
def e03_gazetteer(t):
    return ops.gazetteer(t("entity"))


_CANDIDATES = f"""e AS (SELECT entity_type, entity_id, {_fold('name')} AS k FROM entity), m AS (SELECT mention_id, document_id, entity_type, {_fold('surface')} AS k FROM mention),
ex AS (SELECT mention_id, document_id, m.entity_type, entity_id, 'name' AS source FROM m JOIN e USING (entity_type, k)),
nr AS (SELECT mention_id, document_id, m.entity_type, entity_id, 'prefix' AS source FROM m JOIN e ON m.entity_type = e.entity_type AND left(m.k, length(m.k) - 1) = e.k WHERE mention_id NOT IN (SELECT mention_id FROM ex)),
c AS (SELECT * FROM ex UNION ALL SELECT * FROM nr)"""


@query()
def j17_generated(t):
    """Aliases are the spellings of a seeded entity; the tables have no project codes, so the ids of projects stand for them."""
    e = t("entity")
    seeded = ops.seed(e).select("entity_type", "normalized", "entity_id")
    aliases = e.select("entity_type", "name", text.fold_name(F.col("name")).alias("normalized")).distinct().join(seeded, ["entity_type", "normalized"])
    return ops.generated(t("mention"), e, aliases, e.where("entity_type = 'PROJECT'").select(F.col("entity_id").alias("value"), "entity_id"))


_SCORES = _CANDIDATES + """, company AS (SELECT document_id, entity_type, count(DISTINCT mention_id) AS company FROM c GROUP BY 1, 2),
s AS (SELECT c.*, count(*) OVER (PARTITION BY mention_id) AS n, company FROM c JOIN company USING (document_id, entity_type)),
z AS (SELECT *, round(least(1.0, CASE source WHEN 'name' THEN 0.6 ELSE 0.42 END + CASE WHEN n = 1 THEN 0.25 ELSE 0 END + CASE WHEN company > 1 THEN 0.15 ELSE 0 END), 6) AS score FROM s)"""


@query(f"+{_SCORES} SELECT mention_id, entity_id, score FROM z", "entity", "mention")
def e08_scores(t):
    names = ops.named(t("entity"))
    return ops.scored(ops.evidence(t("mention"), names), names)


@query(f"""+{_SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY score DESC, entity_id) AS rn, lead(score) OVER (PARTITION BY mention_id ORDER BY score DESC, entity_id) AS nx FROM z),
d AS (SELECT mention_id, entity_id, CASE WHEN n > 25 THEN 'AMBIGUOUS' WHEN nx IS NOT NULL AND score - nx < 0.1 THEN 'AMBIGUOUS' WHEN score >= 0.85 THEN 'AUTO' WHEN score >= 0.6 THEN 'PROVISIONAL' ELSE 'UNRESOLVED' END AS tier FROM r WHERE rn = 1)
SELECT m.mention_id, CASE WHEN tier IN ('AUTO', 'PROVISIONAL') THEN entity_id END AS entity_id, coalesce(tier, 'UNRESOLVED') AS tier FROM (SELECT DISTINCT mention_id FROM mention) m LEFT JOIN d USING (mention_id)""", "entity", "mention")
def e09_decisions(t):
    return ops.decisions(t("mention"), ops.evidence(t("mention"), ops.named(t("entity"))))


@query("SELECT document_id, mention_id, list_sort(list_filter(list(mention_id) OVER (PARTITION BY document_id), lambda x: x <> mention_id)) AS others FROM (SELECT DISTINCT document_id, mention_id FROM mention)", "mention")
def e10_co_mentions(t):
    others = F.collect_set("mention_id").over(Window.partitionBy("document_id"))
    return t("mention").select("document_id", "mention_id").distinct().withColumn("o", others).select("document_id", "mention_id", F.sort_array(F.array_remove("o", F.col("mention_id"))).alias("others"))


_THEMES = f"names AS (SELECT DISTINCT {_fold('theme')} AS gram FROM documents_theme WHERE theme IS NOT NULL), d AS (SELECT doc_id, concat(' ', {_fold('title')}, ' ') AS t FROM documents WHERE title IS NOT NULL)"


@query(f"WITH {_THEMES} SELECT DISTINCT doc_id, gram FROM d JOIN names ON contains(t, concat(' ', gram, ' ')) WHERE len(string_split(gram, ' ')) <= 6 AND gram <> ''")
def e04_gazetteer_scan(t):
    names = t("documents_theme").select(text.fold_name(F.col("theme")).alias("normalized")).where("normalized <> ''")
    return ops.scan(t("documents").where("title IS NOT NULL"), "doc_id", "title", names).select("doc_id", "gram").distinct()


@query()
def j26_longest_spans(t):
    names = t("documents_theme").select(text.fold_name(F.col("theme")).alias("normalized")).where("normalized <> ''")
    return ops.longest_spans(ops.scan(t("documents").where("title IS NOT NULL"), "doc_id", "title", names), "doc_id")


@query(f"""WITH w AS (SELECT doc_id, list_filter(string_split({_fold('title')}, ' '), lambda x: x <> '') AS w FROM documents WHERE title IS NOT NULL),
g AS (SELECT doc_id, unnest(list_transform(generate_series(1, len(w) - 2), lambda i: array_to_string(w[i:i + 2], ' '))) AS gram FROM w WHERE len(w) >= 3)
SELECT gram, min(doc_id) AS doc_id FROM g GROUP BY gram HAVING count(DISTINCT doc_id) = 1""")
def x33_title_shingles(t):
    return ops.unique_shingles(t("documents").where("title IS NOT NULL"), "doc_id", "title")


@query("SELECT c_custkey, count(DISTINCT o_orderpriority) AS fields, min(year(o_orderdate)) AS first_year, max(year(o_orderdate)) AS last_year, CASE WHEN count(DISTINCT o_orderpriority) < 3 THEN 'few fields' WHEN max(year(o_orderdate)) - min(year(o_orderdate)) < 3 THEN 'short span' ELSE 'promote' END AS decision FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def a20_promotion(t):
    e = t("customer").join(t("orders"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_custkey").agg(F.count_distinct("o_orderpriority").alias("fields"), F.min(F.year("o_orderdate")).cast("long").alias("first_year"), F.max(F.year("o_orderdate")).cast("long").alias("last_year"))
    return e.withColumn("decision", F.when(F.col("fields") < 3, "few fields").when(F.col("last_year") - F.col("first_year") < 3, "short span").otherwise("promote"))


@query("SELECT string_split(p_name, ' ')[-1] AS surname, count(*) AS n FROM part GROUP BY 1")
def a19_surnames(t):
    return t("part").groupBy(F.element_at(F.split("p_name", " "), -1).alias("surname")).agg(F.count("*").alias("n"))


@query("WITH f AS (SELECT DISTINCT document_id, theme FROM documents_theme WHERE depth > 1), g AS (SELECT DISTINCT document_id, theme FROM documents_theme WHERE parent IS NOT NULL), c AS (SELECT count(*) FILTER (WHERE f.theme IS NOT NULL AND g.theme IS NOT NULL) AS hit, count(f.theme) AS found, count(g.theme) AS expected FROM f FULL JOIN g ON f.document_id = g.document_id AND f.theme = g.theme) SELECT hit, found, expected, round(hit / found, 6) AS precision, round(hit / expected, 6) AS recall, round(2.0 * hit / (found + expected), 6) AS f1 FROM c")
def a32_set_scores(t):
    d = t("documents_theme")
    return ops.set_scores(d.where("depth > 1"), d.where("parent IS NOT NULL"), ["document_id", "theme"])


@query("SELECT chunk_id FROM qdrant_point q JOIN (SELECT payload.document_id AS d, max(payload.doc_version) AS v FROM qdrant_point GROUP BY 1) m ON m.d = q.payload.document_id WHERE q.payload.doc_version < m.v")
def j13_superseded_points(t):
    q = t("qdrant_point").select("chunk_id", "payload.document_id", "payload.doc_version")
    newest = q.groupBy("document_id").agg(F.max("doc_version").alias("v"))
    return q.join(newest, "document_id").where("doc_version < v").select("chunk_id")


@query("SELECT document_id FROM page_content WHERE document_id IS NOT NULL GROUP BY 1 HAVING coalesce(max(length(trim(CASE WHEN extracted_via = 'ocr' THEN text END, ' ' || chr(9) || chr(10) || chr(13)))), 0) = 0")
def n24_empty_extractions(t):
    return t("page_content").where("document_id IS NOT NULL").groupBy("document_id").agg(F.coalesce(F.max(F.length(F.regexp_replace(F.when(F.col("extracted_via") == "ocr", F.col("text")), r"^[ \t\n\r]+|[ \t\n\r]+$", ""))), F.lit(0)).alias("n")).where("n = 0").select("document_id")


@query("WITH a AS (SELECT document_id, list_distinct(list(theme)) AS a FROM documents_theme WHERE theme IS NOT NULL GROUP BY 1), b AS (SELECT document_id, list_distinct(list(parent)) AS b FROM documents_theme WHERE parent IS NOT NULL GROUP BY 1) SELECT document_id, len(list_intersect(a, b)) AS shared, len(b) - len(list_intersect(a, b)) AS novel FROM a JOIN b USING (document_id)")
def n30_shadow_overlap(t):
    d = t("documents_theme")
    a, b = d.groupBy("document_id").agg(F.collect_set("theme").alias("a")), d.where("parent IS NOT NULL").groupBy("document_id").agg(F.collect_set("parent").alias("b"))
    return a.join(b, "document_id").select("document_id", F.size(F.array_intersect("a", "b")).cast("long").alias("shared"), F.size(F.array_except("b", "a")).cast("long").alias("novel"))


@query("SELECT evidence_id, regexp_extract_all(concat('<p><a href=\"', url, '\">x</a></p>'), 'href\\s*=\\s*[\"'']([^\"'']+\\.pdf(?:\\?[^\"'']*)?)[\"'']', 1)[1] AS url FROM (SELECT DISTINCT evidence_id, url FROM pdf_evidence WHERE url IS NOT NULL) WHERE regexp_matches(url, '\\.pdf(\\?|$)')")
def s09_document_links(t):
    pages = t("pdf_evidence").where("url IS NOT NULL").select("evidence_id", F.concat(F.lit('<p><a href="'), "url", F.lit('">x</a></p>')).alias("html")).distinct()
    return web.document_links(pages, "evidence_id", "html").select("evidence_id", "url")


@query("SELECT stage_id, concat('| ', replace(coalesce(trim(document_id), ''), '|', '\\|'), ' | ', replace(coalesce(trim(reader), ''), '|', '\\|'), ' |') AS row FROM dates_stage")
def s12_markdown_rows(t):
    return t("dates_stage").select("stage_id", web.markdown_row(F.array("document_id", "reader")).alias("row"))


@query()
def s08_html_to_text(t):
    return t("documents").select("doc_id", web.html_to_text(F.concat(F.lit("<article><h1>"), F.coalesce("title", F.lit("")), F.lit("</h1><p>"), "text", F.lit("</p><script>x()</script></article>"))).alias("plain"))


@query("SELECT section_id, count(*) AS headings FROM (SELECT DISTINCT section_id, i, string_split(replace(text, chr(13), ''), chr(10))[i] AS line FROM (SELECT section_id, text, unnest(generate_series(1, len(string_split(replace(text, chr(13), ''), chr(10))))) AS i FROM canonical_section)) WHERE regexp_matches(line, '^(#{1,6} \\S.*|\\d+(\\.\\d+)*\\.? [A-Z].{0,80})$') GROUP BY 1")
def k02_headings(t):
    lines = t("canonical_section").select("section_id", F.posexplode(F.split(F.regexp_replace("text", "\r", ""), "\n")).alias("i", "line")).distinct()
    return lines.where(F.col("line").rlike(r"^(#{1,6} \S.*|\d+(\.\d+)*\.? [A-Z].{0,80})$")).groupBy("section_id").agg(F.count("*").alias("headings"))


@query("SELECT p.chunk_id, q.chunk_id IS NOT NULL AS reused FROM (SELECT DISTINCT chunk_id, payload.chunk_text AS h FROM qdrant_point) p LEFT JOIN (SELECT DISTINCT chunk_id, payload.chunk_text AS h FROM qdrant_point WHERE chunk_id % 3 > 0) q ON p.chunk_id = q.chunk_id AND p.h = q.h")
def v13_reusable_vectors(t):
    p = t("qdrant_point").select("chunk_id", F.sha2("payload.chunk_text", 256).alias("h")).distinct()
    q = p.where("chunk_id % 3 > 0").withColumn("r", F.lit(True))
    return p.join(q, ["chunk_id", "h"], "left").select("chunk_id", F.coalesce("r", F.lit(False)).alias("reused"))


@query()
def u13_document_batches(t):
    d = t("documents").select("source", "doc_id", F.ceil(F.length("text") / 4).alias("n")).where("source IS NOT NULL AND text IS NOT NULL")
    return ops.batches_by_budget(d, "source", "doc_id", "n", 4000)


@query("SELECT source, min(doc_id) AS doc_id, arg_min(title, doc_id) AS title FROM documents WHERE title IS NOT NULL AND source IS NOT NULL GROUP BY source, lower(strip_accents(title))")
def u04_first_titles(t):
    """Titles of a source that differ in case or accents only are one: the first document's spelling stands."""
    d = t("documents").where("title IS NOT NULL AND source IS NOT NULL").withColumn("key", F.collate("title", "UNICODE_CI_AI"))
    return d.groupBy("source", "key").agg(F.min("doc_id").alias("doc_id"), F.min_by("title", "doc_id").alias("title")).drop("key")
