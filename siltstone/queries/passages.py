"""Chunking of documents, and small operators over passages and answers."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from siltstone.functions import text
from siltstone.operators import chunking, running
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


@query()
def k08_chunks(t):
    d = t("documents")
    return chunking.chunk(d, "doc_id", F.col("text")).drop("owned_text")


@query()
def k09_section_kinds(t):
    @F.pandas_udf(T.StringType())
    def kind(s: pd.Series) -> pd.Series:
        return s.map(lambda x: chunking.classify(x) if x else "body")

    return t("canonical_section").select("section_id", kind("text").alias("kind")).distinct()


@query()
def x17_running_keys(t):
    return running.running_keys(t("page_content"))


@query()
def x17_clean_pages(t):
    return running.clean_pages(t("page_content"), running.running_keys(t("page_content")))


@query(r"""WITH s AS (SELECT doc_id, list_filter(regexp_extract_all(trim(regexp_replace(text, '\s+', ' ', 'g')), '[^.!?]+[.!?]+'), lambda x: length(x) > 0) AS s FROM documents WHERE text IS NOT NULL) SELECT doc_id, len(list_filter(s, lambda x: regexp_matches(x, '[0-9]'))) AS cited, len(s) AS sentences FROM s""")
def x18_numbered_sentences(t):
    s = F.regexp_extract_all(text.collapse(F.col("text")), F.lit(r"[^.!?]+[.!?]+"), 0)
    return t("documents").where("text IS NOT NULL").select("doc_id", F.size(F.filter(s, lambda x: x.rlike("[0-9]"))).cast("long").alias("cited"), F.size(s).cast("long").alias("sentences"))


_TOK = r"list_distinct(list_filter(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+'), lambda w: length(w) >= 3 AND NOT list_contains(" + "[" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "], w)))"


@query(f"""WITH h AS (SELECT DISTINCT section_id, {_TOK.format('heading')} AS h, {_TOK.format('text')} AS x FROM canonical_section WHERE heading IS NOT NULL AND text IS NOT NULL)
SELECT section_id, round(len(list_intersect(h, x)) / len(h), 6) AS coverage, len(list_intersect(h, x)) >= 0.8 * len(h) AS covered FROM h WHERE len(h) > 0""")
def u10_redundant_headings(t):
    rows = t("canonical_section").where("heading IS NOT NULL AND text IS NOT NULL").select("section_id", text.content_terms(F.col("heading")).alias("h"), text.content_terms(F.col("text")).alias("x"))
    shared = F.size(F.array_intersect("h", "x"))
    return rows.where(F.size("h") > 0).select("section_id", F.round(shared / F.size("h"), 6).alias("coverage"), (shared >= 0.8 * F.size("h")).alias("covered")).distinct()


@query("""WITH d AS (SELECT doc_id, source, md5(text) AS h FROM documents WHERE trim(text) <> ''), m AS (SELECT h, min(doc_id) AS first FROM d GROUP BY 1 HAVING count(*) > 1)
SELECT m.first AS linked_to, d.doc_id FROM d JOIN m USING (h) JOIN d x ON x.doc_id = m.first WHERE d.doc_id <> m.first AND d.source IS DISTINCT FROM x.source""")
def j25_linked_sources(t):
    """Documents linked by an equal text to the first one that has it, where another source shows it: one row a document, no pairs."""
    d = t("documents").where("trim(text) <> ''").select("doc_id", "source", F.md5("text").alias("h"))
    first = d.groupBy("h").agg(F.min(F.struct("doc_id", "source")).alias("x"), F.count("*").alias("n")).where("n > 1").select("h", "x")
    linked = d.join(first, "h").where((F.col("doc_id") != F.col("x.doc_id")) & ~F.col("source").eqNullSafe(F.col("x.source")))
    return linked.select(F.col("x.doc_id").alias("linked_to"), "doc_id")


@query("SELECT c.chunk_id, CASE WHEN p.chunk_id IS NOT NULL AND coalesce(p.section_type NOT IN ('toc', 'references', 'glossary'), true) THEN 'parent' WHEN coalesce(c.section_type NOT IN ('toc', 'references', 'glossary'), true) THEN 'child' END AS admitted FROM chunk c LEFT JOIN chunk p ON p.chunk_id = c.parent_chunk_id WHERE NOT c.is_parent", "chunk")
def n12_admissible_text(t):
    c = t("chunk")
    p = c.select(F.col("chunk_id").alias("parent_chunk_id"), F.lit(True).alias("has"), F.col("section_type").alias("ps"))
    ok = lambda s: F.coalesce(~F.col(s).isin("toc", "references", "glossary"), F.lit(True))
    return c.where("NOT is_parent").join(p, "parent_chunk_id", "left").select("chunk_id", F.when(F.coalesce("has", F.lit(False)) & ok("ps"), "parent").when(ok("section_type"), "child").alias("admitted"))


@query("SELECT doc_id, round(ln(1 + length(coalesce(text, ''))), 6) AS substance, CAST(floor(ln(1 + length(coalesce(text, ''))) / ln(1.5) + 1e-9) AS BIGINT) AS band FROM documents")
def v08_substance(t):
    """Completeness of a text: the logarithm of its length, in bands of half as much again."""
    s = F.log1p(F.length(F.coalesce("text", F.lit(""))).cast("double"))
    return t("documents").select("doc_id", F.round(s, 6).alias("substance"), F.floor(s / F.log(F.lit(1.5)) + 1e-9).cast("long").alias("band"))


@query("""SELECT doc_id, CASE WHEN a IS NOT NULL THEN least(1.0, greatest(0.0, a)) WHEN bundle IS NULL THEN 0.6 ELSE 0.8 END AS authority
FROM documents LEFT JOIN (SELECT source, max(20 * target_share - 0.5) AS a FROM mix_target GROUP BY 1) USING (source)""")
def n13_authority(t):
    """A source's stated authority, clamped to 0..1, else that of the kind of document; the shares of sources stand for the statement."""
    stated = t("mix_target").groupBy("source").agg(F.max(20 * F.col("target_share") - 0.5).alias("a"))
    clamped = F.when(F.col("a").isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("a"))))
    kind = F.when(F.col("bundle").isNull(), 0.6).otherwise(0.8)
    return t("documents").join(stated, "source", "left").select("doc_id", F.coalesce(clamped, kind).alias("authority"))


@query("SELECT chunk_id, document_id, row_number() OVER (PARTITION BY document_id, label ORDER BY chunk_index, chunk_id) - 1 AS ordinal FROM chunk", "chunk")
def w09_ordinals(t):
    order = Window.partitionBy("document_id", "label").orderBy("chunk_index", "chunk_id")
    return t("chunk").select("chunk_id", "document_id", (F.row_number().over(order) - 1).cast("long").alias("ordinal"))


@query("+e AS (SELECT document_id, last(effective_end_date) AS e FROM (SELECT document_id, CAST(coalesce(effective_end_date, effective_start_date) AS DATE) AS effective_end_date FROM cat_document WHERE bundle = '1-URGENT') GROUP BY 1) SELECT document_id FROM e WHERE e IS NULL OR e >= DATE '1998-01-01' OR NOT EXISTS (SELECT 1 FROM e WHERE e IS NULL OR e >= DATE '1998-01-01')", "cat_document")
def f23_scheduled_gate(t):
    d = t("cat_document").where("bundle = '1-URGENT'").select("document_id", F.coalesce("effective_end_date", "effective_start_date").cast("date").alias("e"))
    d = d.withColumn("keep", F.col("e").isNull() | (F.col("e") >= F.lit("1998-01-01").cast("date")))
    guard = d.agg(F.coalesce(F.max("keep"), F.lit(False)).alias("any_kept"))
    return d.join(F.broadcast(guard)).where("keep OR NOT any_kept").select("document_id")


@query("SELECT content_hash, count(*) AS documents FROM cat_document WHERE content_hash NOT IN (SELECT content_hash FROM cat_document WHERE content_hash % 3 = 0) AND doc_version < 3 GROUP BY 1 ORDER BY 1 LIMIT 25", "cat_document")
def n15_enrichment_queue(t):
    d = t("cat_document")
    done = d.where("content_hash % 3 = 0").select("content_hash").distinct()
    return d.where("doc_version < 3").join(done, "content_hash", "left_anti").groupBy("content_hash").agg(F.count("*").alias("documents")).orderBy("content_hash").limit(25)


@query("SELECT document_id, list_sort(list(DISTINCT file_uuid))[1:5] AS files, count(DISTINCT file_uuid) AS n FROM cat_attachment GROUP BY 1", "cat_attachment")
def t12_first_five(t):
    return t("cat_attachment").groupBy("document_id").agg(F.slice(F.sort_array(F.collect_set("file_uuid")), 1, 5).alias("files"), F.count_distinct("file_uuid").alias("n"))


@query("""+g AS (SELECT document_id, count(DISTINCT file_uuid) AS n FROM cat_attachment GROUP BY 1), r AS (SELECT bundle, document_id, n, rank() OVER (PARTITION BY bundle ORDER BY n DESC) AS k FROM g JOIN cat_document USING (document_id)),
u AS (SELECT *, count(*) FILTER (WHERE k = 1) OVER (PARTITION BY bundle) AS tied FROM r) SELECT bundle, document_id, n FROM u WHERE k = 1 AND tied = 1""", "cat_attachment", "cat_document")
def w12_strictly_most(t):
    n = t("cat_attachment").groupBy("document_id").agg(F.count_distinct("file_uuid").alias("n")).join(t("cat_document").select("document_id", "bundle"), "document_id")
    ranked = n.withColumn("k", F.rank().over(Window.partitionBy("bundle").orderBy(F.desc("n")))).where("k = 1")
    return ranked.withColumn("tied", F.count("*").over(Window.partitionBy("bundle"))).where("tied = 1").select("bundle", "document_id", "n")


@query("SELECT document_id, CAST(start AS DATE) AS start, CASE WHEN stop < start THEN NULL ELSE CAST(stop AS DATE) END AS stop, CASE WHEN stop < start THEN 'inverted' WHEN stop IS NOT NULL AND start IS NULL THEN 'end_without_start' END AS issue FROM (SELECT document_id, effective_start_date AS start, CASE WHEN document_id % 5 = 0 THEN effective_start_date - INTERVAL 3 DAY ELSE effective_end_date END AS stop FROM cat_document)", "cat_document")
def d04_effective_range(t):
    stop = F.when(F.col("document_id") % 5 == 0, F.col("effective_start_date") - F.expr("INTERVAL 3 DAYS")).otherwise(F.col("effective_end_date"))
    d = t("cat_document").select("document_id", F.col("effective_start_date").alias("start"), stop.alias("stop"))
    inverted = F.coalesce(F.col("stop") < F.col("start"), F.lit(False))
    return d.select("document_id", F.col("start").cast("date").alias("start"), F.when(~inverted, F.col("stop")).cast("date").alias("stop"), F.when(inverted, "inverted").when(F.col("stop").isNotNull() & F.col("start").isNull(), "end_without_start").alias("issue"))


@query("SELECT document_id, CASE WHEN gap IS NULL THEN 'no_evidence' WHEN gap < 0 THEN 'before_start' WHEN gap <= 90 THEN 'close' WHEN gap <= 365 THEN 'same_year' ELSE 'distant' END AS rule FROM (SELECT document_id, date_diff('day', CAST(effective_start_date AS DATE), CAST(effective_end_date AS DATE)) AS gap FROM cat_document)", "cat_document")
def d06_gap_rules(t):
    gap = F.datediff(F.col("effective_end_date"), F.col("effective_start_date"))
    rule = F.when(gap.isNull(), "no_evidence").when(gap < 0, "before_start").when(gap <= 90, "close").when(gap <= 365, "same_year").otherwise("distant")
    return t("cat_document").select("document_id", rule.alias("rule"))
