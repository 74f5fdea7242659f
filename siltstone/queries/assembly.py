"""Context assembly, child and parent drift, facets of entities, series and small SQL forms."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions import text
from siltstone.operators import claims, context, periods
from siltstone.operators import retrieval as ops
from siltstone.queries.entities import _fold
from siltstone.queries.retrieval import _COS, _RANKED, asked
from siltstone.sources.views import ctes, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str, *views: str):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: asked(spark, sf_dir) if name == "asked" else view(spark, sf_dir, name))
        SQL[f.__name__] = (ctes(*views).rstrip() + (", " if sql.startswith("+") else " ") + sql.lstrip("+")) if views else sql
        return f

    return register


def _top(t, k: int) -> DataFrame:
    return ops.vector_top_k(t("asked"), ops.retrievable(t("chunk")), k)


@query(f"""+{_RANKED}, k AS (SELECT query_id, chunk_id, rank, source_type AS kind, row_number() OVER (PARTITION BY query_id, source_type ORDER BY rank, chunk_id) AS nth FROM r JOIN chunk USING (chunk_id) WHERE rank <= 40),
seats AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN nth <= CASE kind WHEN 'website' THEN 2 ELSE 1 END THEN 0 ELSE 1 END, rank, chunk_id) AS seat FROM k WHERE nth <= CASE kind WHEN 'website' THEN 6 ELSE 3 END)
SELECT query_id, chunk_id, kind, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id) AS BIGINT) AS block FROM seats WHERE seat <= 8""", "chunk")
def u08_slots(t):
    """Six website blocks at most and two at least, three PDF blocks at most and one at least, eight in all (W-10: their numbers)."""
    top = _top(t, 40).join(t("chunk").select("chunk_id", "source_type"), "chunk_id")
    out = context.slots(top, F.col("source_type"), {"website": 6, "pdf_attachment": 3}, {"website": 2, "pdf_attachment": 1}, 8)
    return out.withColumn("block", F.col("block").cast("long"))


@query(f"""+{_RANKED}, k AS (SELECT query_id, chunk_id, rank, label FROM r JOIN chunk USING (chunk_id) WHERE rank <= 60)
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank > 40, CASE WHEN rank <= 40 THEN label END DESC, rank, chunk_id) AS place FROM k""", "chunk")
def t11_rerank_head(t):
    """The label stands for the score of a second model, which reads the first 40 only."""
    top = _top(t, 60).join(t("chunk").select("chunk_id", "label"), "chunk_id")
    return context.rerank_head(top, F.col("label")).withColumn("place", F.col("place").cast("long"))


@query(f"""+{_RANKED}, legs AS (SELECT query_id, chunk_id, score, source_type, row_number() OVER (PARTITION BY query_id, source_type ORDER BY score DESC, chunk_id) AS rank FROM s JOIN chunk USING (chunk_id)),
a AS (SELECT * FROM legs WHERE source_type = 'website' AND rank <= 15), b AS (SELECT * FROM legs WHERE source_type <> 'website' AND rank <= 15),
weak AS (SELECT query_id FROM a GROUP BY 1 HAVING max(score) < 0.35),
fused AS (SELECT query_id, chunk_id, sum(1.0 / (60 + rank)) AS f FROM (SELECT query_id, chunk_id, rank FROM a UNION ALL SELECT query_id, chunk_id, rank FROM b) WHERE query_id IN (SELECT query_id FROM weak) GROUP BY 1, 2)
SELECT query_id, chunk_id, rank FROM a WHERE query_id NOT IN (SELECT query_id FROM weak)
UNION ALL SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(f, 12) DESC, chunk_id) FROM fused""", "chunk")
def v10_corrective_pass(t):
    kind = F.when(F.col("source_type") == "website", "web").otherwise("rest")
    found = ops.vector_top_k(t("asked"), ops.retrievable(t("chunk")), 15, F.array(kind))
    legs = [found.where(F.col("leg") == x).drop("leg") for x in ("web", "rest")]
    return context.corrected(*legs, 0.35).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH q AS (SELECT vec_id AS query_id, embedding AS qe FROM embeddings WHERE vec_id % 50 = 0),
p AS (SELECT DISTINCT vec_id, embedding FROM embeddings JOIN documents ON doc_id = vec_id WHERE text IS NOT NULL AND list_contains(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), 'water')),
s AS (SELECT query_id, vec_id AS chunk_id, {_COS.format('qe', 'embedding')} AS score FROM q, p)
SELECT query_id, chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 10""")
def v04_keyword_leg(t):
    """Points whose text has the term, in the order of their vectors."""
    hit = t("documents").where("text IS NOT NULL").where(ops.matches_terms(F.col("text"), ["water"])).select(F.col("doc_id").alias("chunk_id"))
    points = t("embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding").join(hit, "chunk_id", "left_semi")
    return ops.vector_top_k(t("asked"), points, 10).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST, event_id) AS position FROM events")
def w05_rank_positions(t):
    return context.rank_positions(t("events"), "user_id", "value", "event_id").withColumn("position", F.col("position").cast("long"))


@query("""SELECT event_id, lag(value) OVER w AS before, lead(value) OVER w AS after, CAST(ntile(4) OVER w AS BIGINT) AS quarter, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS running,
round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS smooth FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def w13_frames(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    running, three = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(-2, 0)
    return t("events").select(
        "event_id", F.lag("value").over(w).alias("before"), F.lead("value").over(w).alias("after"), F.ntile(4).over(w).cast("long").alias("quarter"),
        F.round(F.sum("value").over(running), 4).alias("running"), F.round(F.avg("value").over(three), 4).alias("smooth"),
    )


@query("""SELECT DISTINCT c.chunk_id FROM qdrant_point c JOIN qdrant_point p ON p.chunk_id = c.payload.parent_chunk_id
WHERE c.payload.doc_version IS DISTINCT FROM p.payload.doc_version OR c.payload.section_heading IS DISTINCT FROM p.payload.section_heading OR c.updated_at IS DISTINCT FROM p.updated_at""")
def j07_child_parent_drift(t):
    """Children that differ from their parent in version, heading or time; two nulls are no difference."""
    q = t("qdrant_point").select("chunk_id", "payload.parent_chunk_id", "payload.doc_version", "payload.section_heading", "updated_at").distinct()
    p = q.select(F.col("chunk_id").alias("parent_chunk_id"), *[F.col(c).alias(f"p_{c}") for c in ("doc_version", "section_heading", "updated_at")])
    same = F.lit(True)
    for c in ("doc_version", "section_heading", "updated_at"):
        same = same & F.col(c).eqNullSafe(F.col(f"p_{c}"))
    return q.join(p, "parent_chunk_id").where(~same).select("chunk_id").distinct()


@query("SELECT payload.parent_chunk_id AS parent_chunk_id, payload.chunk_index AS chunk_index, count(DISTINCT chunk_id) AS ids FROM qdrant_point WHERE NOT payload.is_parent GROUP BY 1, 2 HAVING count(DISTINCT chunk_id) > 1")
def r04_chunk_id_mismatch(t):
    """Places below a parent that more than one chunk id claims."""
    q = t("qdrant_point").where("NOT payload.is_parent").select("chunk_id", "payload.parent_chunk_id", "payload.chunk_index")
    return q.groupBy("parent_chunk_id", "chunk_index").agg(F.count_distinct("chunk_id").alias("ids")).where("ids > 1")


@query("SELECT bundle, count(DISTINCT document_id) AS documents FROM catalog_document WHERE bundle IS NULL OR bundle NOT IN ('article', 'news', 'page', 'press_release', 'report') GROUP BY 1")
def r09_unmapped_bundles(t):
    mapped = F.col("bundle").isin("article", "news", "page", "press_release", "report")
    return t("catalog_document").where(F.col("bundle").isNull() | ~mapped).groupBy("bundle").agg(F.count_distinct("document_id").alias("documents"))


@query(f"SELECT DISTINCT entity_type, {_fold('name')} AS alias, entity_id FROM entity WHERE entity_type <> 'PROJECT' AND length({_fold('name')}) >= 3", "entity")
def j11_eligible_aliases(t):
    e = t("entity").where("entity_type <> 'PROJECT'").select("entity_type", text.fold_name(F.col("name")).alias("alias"), "entity_id")
    return e.where(F.length("alias") >= 3).distinct()


@query(f"SELECT normalized, count(DISTINCT entity_id) AS entities FROM (SELECT entity_id, {_fold('name')} AS normalized FROM entity) GROUP BY 1 HAVING count(DISTINCT entity_id) > 1", "entity")
def j12_ambiguous_aliases(t):
    return t("entity").groupBy(text.fold_name(F.col("name")).alias("normalized")).agg(F.count_distinct("entity_id").alias("entities")).where("entities > 1")


@query(f"SELECT DISTINCT o.l_orderkey AS document_id, entity_id FROM (SELECT l_orderkey, upper(s_name) AS v FROM lineitem JOIN supplier ON s_suppkey = l_suppkey) o JOIN entity ON entity_type = 'ORGANIZATION' AND {_fold('name')} = {_fold('o.v')}", "entity")
def j18_field_entities(t):
    """Values of a content field as entities, by normalized name."""
    values = t("lineitem").join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey")).select(F.col("l_orderkey").alias("document_id"), text.fold_name(F.upper("s_name")).alias("key")).distinct()
    e = t("entity").where("entity_type = 'ORGANIZATION'").select(text.fold_name(F.col("name")).alias("key"), "entity_id")
    return values.join(e, "key").select("document_id", "entity_id").distinct()


@query("SELECT status, count(*) AS seen, count(DISTINCT document_id) AS documents, min(event_time) AS first_seen, max(event_time) AS last_seen FROM ingest_log GROUP BY 1", "ingest_log")
def a30_pending_summary(t):
    return t("ingest_log").groupBy("status").agg(F.count("*").alias("seen"), F.count_distinct("document_id").alias("documents"), F.min("event_time").alias("first_seen"), F.max("event_time").alias("last_seen"))


@query("SELECT document_id, status, count(*) AS calls, round(sum(latency_ms), 4) AS total, round(max(latency_ms), 4) AS slowest FROM ingest_log GROUP BY 1, 2", "ingest_log")
def a25_query_summary(t):
    return t("ingest_log").groupBy("document_id", "status").agg(F.count("*").alias("calls"), F.round(F.sum("latency_ms"), 4).alias("total"), F.round(F.max("latency_ms"), 4).alias("slowest"))


@query("(SELECT document_id FROM documents_theme INTERSECT SELECT document_id FROM pdf_evidence) EXCEPT SELECT document_id FROM page_content WHERE extracted_via = 'ocr'")
def u15_set_algebra(t):
    both = t("documents_theme").select("document_id").intersect(t("pdf_evidence").select("document_id"))
    return both.subtract(t("page_content").where("extracted_via = 'ocr'").select("document_id"))


_PARTIAL = "CASE WHEN regexp_matches(v, '^[0-9]{4}$') THEN v || '-01-01' WHEN regexp_matches(v, '^[0-9]{4}-[0-9]{2}$') THEN v || '-01' WHEN regexp_matches(v, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN v END"


@query(f"SELECT stage_id, CASE WHEN year(d) BETWEEN 1800 AND 2200 THEN d END AS day FROM (SELECT stage_id, TRY_CAST({_PARTIAL} AS DATE) AS d FROM (SELECT stage_id, canonical.effective_start_date AS v FROM dates_stage))")
def d15_partial_iso(t):
    return t("dates_stage").select("stage_id", periods.partial_iso(F.col("canonical.effective_start_date")).alias("day"))


@query("SELECT document_id, year(effective_start_date) AS y, month(effective_start_date) = 1 AND day(effective_start_date) = 1 AS year_start, day(effective_start_date) = 1 AS month_start FROM cat_document", "cat_document")
def d17_day_parts(t):
    d = F.col("effective_start_date")
    return t("cat_document").select("document_id", F.year(d).cast("long").alias("y"), ((F.month(d) == 1) & (F.day(d) == 1)).alias("year_start"), (F.day(d) == 1).alias("month_start"))


@query("SELECT event_id, round(ln(1 + abs(value)), 6) AS log, round(least(1.0, greatest(0.0, value / 100)), 6) AS clamped, round((value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()), 6) AS scaled FROM events")
def m02_scales(t):
    e = t("events").select("event_id", "value")
    ends = e.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    clamp = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") / 100))
    return e.join(F.broadcast(ends)).select("event_id", F.round(F.log1p(F.abs("value")), 6).alias("log"), F.round(clamp, 6).alias("clamped"), F.round((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")), 6).alias("scaled"))


@query("SELECT bundle, sum(CASE WHEN effective_start_date IS NULL THEN 1 ELSE 0 END) AS undated, sum(CASE WHEN title IS NOT DISTINCT FROM url THEN 1 ELSE 0 END) AS untitled, coalesce(max(year(effective_start_date)), 0) AS latest FROM catalog_document GROUP BY 1")
def m10_sql_dialect(t):
    c = t("catalog_document")
    return c.groupBy("bundle").agg(F.count_if(F.col("effective_start_date").isNull()).alias("undated"), F.count_if(F.col("title").eqNullSafe(F.col("url"))).alias("untitled"), F.coalesce(F.max(F.year("effective_start_date")), F.lit(0)).cast("long").alias("latest"))


@query("SELECT evidence_id, list_filter(list_transform(regexp_split_to_array(a, ',(?:)'), lambda x: trim(x)), lambda x: x <> '') AS names FROM (SELECT evidence_id, replace(anchor, ', ', ' ') AS a FROM pdf_evidence WHERE anchor IS NOT NULL AND trim(anchor) <> '')".replace(",(?:)", ","))
def x05_joined_names(t):
    """Names joined by commas without a space behind them."""
    rows = t("pdf_evidence").where("anchor IS NOT NULL AND trim(anchor) <> ''")
    return rows.select("evidence_id", text.joined_names(F.replace("anchor", F.lit(", "), F.lit(" "))).alias("names"))


@query(f"+{_RANKED} SELECT query_id, CASE WHEN a >= 0.9 OR (a >= 0.6 AND a - coalesce(b, 0) >= 0.3) THEN 'accept' WHEN a >= 0.6 THEN 'ambiguous' ELSE 'miss' END AS band FROM (SELECT query_id, max(score) + 0.3 AS a, max(score) FILTER (WHERE rank = 2) AS b FROM r WHERE rank <= 2 GROUP BY 1)", "chunk")
def x10_name_bands(t):
    top = _top(t, 2).groupBy("query_id").agg((F.max("score") + 0.3).alias("a"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("b"))
    return top.select("query_id", text.band(F.col("a"), F.col("b")).alias("band"))


_EDGES = "SELECT DISTINCT subject_id, predicate, object_id FROM claim WHERE status = 'active' AND temporal_basis IN ('stated', 'subject_period') AND (valid_from IS NULL OR valid_from <= DATE '{0}') AND (valid_until IS NULL OR valid_until > DATE '{0}')"


@query(" SELECT predicate, count(*) AS edges, count(DISTINCT subject_id) AS subjects FROM (" + _EDGES.format("1998-06-01") + ") GROUP BY 1", "claim")
def g08_edges_by_predicate(t):
    return claims.current_state(t("claim"), date(1998, 6, 1)).groupBy("predicate").agg(F.count("*").alias("edges"), F.count_distinct("subject_id").alias("subjects"))


@query(" " + _EDGES.format("1997-06-01") + " EXCEPT " + _EDGES.format("1998-06-01"), "claim")
def g09_retired_edges(t):
    """Edges of the generation before that this one didn't stamp again."""
    return claims.current_state(t("claim"), date(1997, 6, 1)).subtract(claims.current_state(t("claim"), date(1998, 6, 1)))


@query("SELECT DISTINCT chunk_id FROM qdrant_point q WHERE payload.document_id IS NOT NULL AND payload.doc_version < (SELECT max(x.payload.doc_version) FROM qdrant_point x WHERE x.payload.document_id = q.payload.document_id)")
def s17_swapped_out(t):
    """Points that go when a document's new version is swapped in: all but the ids to keep."""
    q = t("qdrant_point").where("payload.document_id IS NOT NULL").select("chunk_id", "payload.document_id", "payload.doc_version").distinct()
    newest = q.groupBy("document_id").agg(F.max("doc_version").alias("v"))
    keep = q.join(newest, "document_id").where("doc_version = v OR doc_version IS NULL OR v IS NULL").select("chunk_id")
    return q.join(keep, "chunk_id", "left_anti").select("chunk_id").distinct()


@query("SELECT section_id, concat_ws(' > ', bundle, title, heading) AS trail FROM (SELECT DISTINCT section_id, document_id, heading FROM canonical_section) JOIN (SELECT document_id, min(bundle) AS bundle, min(title) AS title FROM catalog_document GROUP BY 1) USING (document_id)")
def x22_breadcrumbs(t):
    c = t("catalog_document").groupBy("document_id").agg(F.min("bundle").alias("bundle"), F.min("title").alias("title"))
    return t("canonical_section").select("section_id", "document_id", "heading").distinct().join(c, "document_id").select("section_id", F.concat_ws(" > ", "bundle", "title", "heading").alias("trail"))


@query("SELECT bundle, concat(n, ' ', replace(bundle, '_', ' '), CASE WHEN n = 1 OR bundle LIKE '%s' THEN '' ELSE 's' END) AS label FROM (SELECT bundle, count(DISTINCT document_id) AS n FROM catalog_document WHERE bundle IS NOT NULL GROUP BY 1)")
def p05_count_labels(t):
    c = t("catalog_document").where("bundle IS NOT NULL").groupBy("bundle").agg(F.count_distinct("document_id").alias("n"))
    plural = F.when((F.col("n") == 1) | F.col("bundle").endswith("s"), "").otherwise("s")
    return c.select("bundle", F.concat(F.col("n").cast("string"), F.lit(" "), F.replace("bundle", F.lit("_"), F.lit(" ")), plural).alias("label"))


# names with p and a number are those of the training-data problems
QUERIES["proj05_count_labels"], SQL["proj05_count_labels"] = QUERIES.pop("p05_count_labels"), SQL.pop("p05_count_labels")
