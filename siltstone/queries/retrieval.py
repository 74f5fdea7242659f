"""Hybrid retrieval over embeddings and document titles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.operators import retrieval as ops
from siltstone.sources.views import ctes, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = (ctes(*views).rstrip() + (", " if sql.startswith("+") else " ") + sql.lstrip("+")) if views else sql
        return f

    return register


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "chunk")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 50."""
    return view(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


_COS = "coalesce(list_cosine_similarity(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[])), 0)"
_OK = "NOT is_parent AND coalesce(section_type NOT IN ('toc', 'references', 'glossary'), true)"
_Q = "q AS (SELECT vec_id AS query_id, embedding AS qe FROM embeddings WHERE vec_id % 50 = 0)"
_RANKED = f"{_Q}, s AS (SELECT query_id, chunk_id, {_COS.format('qe', 'embedding')} AS score FROM q, chunk WHERE {_OK}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s)"


@query(f"SELECT chunk_id FROM chunk WHERE {_OK} AND doc_version = 1", "chunk")
def f09_retrievable(spark, sf_dir):
    return ops.retrievable(chunks(spark, sf_dir), 1).select("chunk_id")


@query("SELECT chunk_id FROM chunk WHERE (label IN (1, 2) OR section_type IS NULL) AND NOT (source_type = 'website') AND chunk_index BETWEEN 2 AND 6", "chunk")
def f10_filter_algebra(spark, sf_dir):
    return chunks(spark, sf_dir).where((F.col("label").isin(1, 2) | F.col("section_type").isNull()) & ~(F.col("source_type") == "website") & F.col("chunk_index").between(2, 6)).select("chunk_id")


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, round({_COS.format('a.embedding', 'b.embedding')}, 6) AS cos FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def v01_cosine(spark, sf_dir):
    e = view(spark, sf_dir, "embeddings")
    a, b = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")), e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", F.round(ops.cosine(F.col("x"), F.col("y")), 6).alias("cos"))


@query(f"+{_RANKED} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM r WHERE rank <= 20", "chunk")
def v02_vector_top_k(spark, sf_dir):
    return ops.vector_top_k(asked(spark, sf_dir), ops.retrievable(chunks(spark, sf_dir)), 20).select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"+{_RANKED} SELECT query_id, chunk_id, round(score, 6) AS score FROM r WHERE rank <= 30", "chunk")
def t05_single_query(spark, sf_dir):
    return ops.vector_top_k(asked(spark, sf_dir), ops.retrievable(chunks(spark, sf_dir)), 30).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@query(f"+{_RANKED} SELECT query_id, round(max(score) - coalesce(max(score) FILTER (WHERE rank = 2), 0), 6) AS margin FROM r WHERE rank <= 2 GROUP BY 1", "chunk")
def w11_margin(spark, sf_dir):
    top = ops.vector_top_k(asked(spark, sf_dir), ops.retrievable(chunks(spark, sf_dir)), 2)
    second = F.max(F.when(F.col("rank") == 2, F.col("score")))
    return top.groupBy("query_id").agg(F.round(F.max("score") - F.coalesce(second, F.lit(0.0)), 6).alias("margin"))


@query(f"""WITH e AS (SELECT * FROM embeddings WHERE vec_id % 100 > 0), q AS (SELECT vec_id AS query_id, label AS scope, embedding AS qe FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id AS entry_id, {_COS.format('qe', 'embedding')} AS score FROM q JOIN e ON e.label = q.scope)
SELECT query_id, entry_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) AS k FROM s) WHERE k = 1 AND score >= 0.995""")
def v12_cache_lookup(spark, sf_dir):
    """The cached answer of a near-equal question of the same scope; entries whose number is divisible by 100 have expired."""
    e = view(spark, sf_dir, "embeddings")
    entries = e.where("vec_id % 100 > 0").select(F.col("vec_id").alias("chunk_id"), "embedding", F.col("label").cast("string").alias("scope"))
    scopes = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").cast("string").alias("leg"))
    top = ops.vector_top_k(asked(spark, sf_dir), entries, 1, F.array("scope"))
    return top.join(scopes, ["query_id", "leg"]).where("score >= 0.995").select("query_id", F.col("chunk_id").alias("entry_id"))


@query(f"+{_RANKED.replace('WHERE NOT', 'WHERE document_id < 20 AND NOT')} SELECT query_id, chunk_id, rank FROM r WHERE rank <= 10", "chunk")
def v03_scoped_search(spark, sf_dir):
    scope = chunks(spark, sf_dir).select("document_id").distinct().where("document_id < 20")
    return ops.vector_top_k(asked(spark, sf_dir), ops.retrievable(chunks(spark, sf_dir)).join(scope, "document_id", "left_semi"), 10).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"))


def _legs(spark, sf_dir):
    points = ops.retrievable(chunks(spark, sf_dir))
    kind = F.when(F.col("source_type") == "website", "web").otherwise("rest")
    found = ops.vector_top_k(asked(spark, sf_dir), points, 15, F.array(kind, F.lit("all")))  # one reading of the points
    return tuple(found.where(F.col("leg") == x) for x in ("web", "rest", "all"))


_LEG = "SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT s.*, source_type FROM s JOIN chunk USING (chunk_id)) WHERE {}"
_LEGS = _RANKED + f", legs AS (SELECT * FROM ({_LEG.format(chr(39).join(['source_type = ', 'website', '']))}) WHERE rank <= 15 UNION ALL SELECT * FROM ({_LEG.format(chr(39).join(['source_type <> ', 'website', '']))}) WHERE rank <= 15"


@query(f"+{_LEGS}) SELECT query_id, chunk_id, rank FROM legs", "chunk")
def u01_dual_search(spark, sf_dir):
    web, rest, _ = _legs(spark, sf_dir)
    return web.unionByName(rest).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"))


@query(f"+{_LEGS} UNION ALL SELECT query_id, chunk_id, rank FROM r WHERE rank <= 15) SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 9) AS fusion_score FROM legs GROUP BY 1, 2", "chunk")
def u02_rank_fusion(spark, sf_dir):
    return ops.rrf(list(_legs(spark, sf_dir))).select("query_id", "chunk_id", F.round("fusion_score", 9).alias("fusion_score"))


@query("SELECT doc_id FROM documents WHERE text IS NOT NULL AND (len(list_filter(['water', 'board'], x -> NOT list_contains(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), x))) = 0 OR list_contains(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), 'microgrid'))".replace("x -> ", "lambda x: "))
def f11_keyword_match(spark, sf_dir):
    return view(spark, sf_dir, "documents").where(ops.matches_terms(F.col("text"), ["Water Board", "microgrid"])).select("doc_id")


@query("SELECT word, count(*) AS documents FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(title), '[\\p{L}\\p{N}]+')) AS word FROM documents) GROUP BY word")
def a16_title_frequencies(spark, sf_dir):
    return ops.word_frequencies(view(spark, sf_dir, "documents"), "title", "doc_id")


@query("""WITH w AS (SELECT DISTINCT doc_id, regexp_replace(unnest(regexp_extract_all(lower(title), '[\\p{L}\\p{N}]+')), '^(.{3,})s$', '\\1') AS word FROM documents WHERE title IS NOT NULL),
n AS (SELECT count(*) AS n FROM documents WHERE title IS NOT NULL), df AS (SELECT word, count(*) AS df FROM w GROUP BY word),
sel AS (SELECT word, df <= greatest(25, 0.01 * n) AS rare FROM df, n WHERE df <= greatest(25, 0.1 * n)),
asked AS (SELECT DISTINCT doc_id AS query_id, regexp_replace(unnest(regexp_extract_all(lower(title), '[\\p{L}\\p{N}]+')), '^(.{3,})s$', '\\1') AS word FROM documents WHERE doc_id % 50 = 0),
hits AS (SELECT query_id, w.doc_id, count(*) AS hits, bool_or(rare) AS rare FROM asked JOIN sel USING (word) JOIN w USING (word) WHERE length(word) > 2 GROUP BY 1, 2),
ranked AS (SELECT query_id, doc_id, hits, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, doc_id) AS rank FROM hits WHERE hits >= 2 OR rare)
SELECT * FROM ranked WHERE rank <= 12""")
def v06_title_leg(spark, sf_dir):
    d = view(spark, sf_dir, "documents")
    questions = d.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("title").alias("question"))
    return ops.title_leg(questions, d.where("title IS NOT NULL").select("doc_id", "title")).withColumn("rank", F.col("rank").cast("long"))


def _candidates(spark, sf_dir):
    points = ops.retrievable(chunks(spark, sf_dir))
    top = ops.vector_top_k(asked(spark, sf_dir), points, 40)
    c = top.join(points, "chunk_id")
    stamp = F.timestamp_seconds(F.col("chunk_id") * 86400)
    authority = F.when(F.col("source_type") == "website", 2).otherwise(1)
    return c.select("query_id", "chunk_id", "parent_chunk_id", "embedding", "score", authority.alias("authority"), (F.col("chunk_id") % 400 + 20).alias("length"), ops.recency(stamp, ["query_id"]).alias("recency"), (F.col("chunk_id") % 90 + 30).alias("n_tokens"))


@query(f"+{_RANKED}, c AS (SELECT * FROM r WHERE rank <= 40) SELECT query_id, chunk_id, round(CASE WHEN max(chunk_id) OVER w = min(chunk_id) OVER w THEN 0.5 ELSE (chunk_id - min(chunk_id) OVER w) / (max(chunk_id) OVER w - min(chunk_id) OVER w) END, 6) AS recency FROM c WINDOW w AS (PARTITION BY query_id)", "chunk")
def w06_recency(spark, sf_dir):
    return _candidates(spark, sf_dir).select("query_id", "chunk_id", F.round("recency", 6).alias("recency"))


@query(f"""+{_RANKED}, c AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS i FROM r WHERE rank <= 40),
walk AS (SELECT query_id, chunk_id, i, 0 AS band, score AS leader FROM c WHERE i = 1
  UNION ALL SELECT c.query_id, c.chunk_id, c.i, CASE WHEN w.leader - c.score > 0.05 THEN w.band + 1 ELSE w.band END, CASE WHEN w.leader - c.score > 0.05 THEN c.score ELSE w.leader END FROM walk w JOIN c ON c.query_id = w.query_id AND c.i = w.i + 1)
SELECT query_id, chunk_id, band FROM walk""", "chunk")
def w07_tolerance_bands(spark, sf_dir):
    return ops.bands(_candidates(spark, sf_dir), ["query_id"], "chunk_id", "score", 0.05)


SQL["w07_tolerance_bands"] = SQL["w07_tolerance_bands"].replace("WITH", "WITH RECURSIVE", 1)


@query()
def t06_final_rank(spark, sf_dir):
    return ops.rank_key(_candidates(spark, sf_dir)).select("query_id", "chunk_id", "relevance_band", "authority", "completeness_band", "final_rank")


@query()
def u07_packed_context(spark, sf_dir):
    return ops.pack_context(ops.rank_key(_candidates(spark, sf_dir)), budget=600, limit=8)


@query(f"+{_RANKED} SELECT query_id, chunk_id, CAST(CASE WHEN rank % 2 = 1 THEN (rank + 1) / 2 ELSE 9 - rank / 2 END AS BIGINT) AS place FROM r WHERE rank <= 8", "chunk")
def t09_attention_order(spark, sf_dir):
    top = ops.vector_top_k(asked(spark, sf_dir), ops.retrievable(chunks(spark, sf_dir)), 8)
    return top.select("query_id", "chunk_id", ops.attention_order(F.col("rank"), F.lit(8)).alias("place"))


@query(f"""+{_RANKED}, judged AS (SELECT query_id, chunk_id AS item, CASE WHEN c.label = e.label THEN 1 + c.chunk_id % 2 ELSE 0 END AS grade FROM q JOIN embeddings e ON vec_id = query_id, chunk c),
hits AS (SELECT r.query_id, count(*) FILTER (WHERE grade > 0) AS found, min(rank) FILTER (WHERE grade > 0) AS first, sum(grade / log2(rank + 1)) AS dcg FROM r JOIN judged j ON j.query_id = r.query_id AND j.item = r.chunk_id WHERE rank <= 10 GROUP BY 1),
ideal AS (SELECT query_id, count(*) FILTER (WHERE grade > 0) AS relevant, sum(grade / log2(i + 1)) FILTER (WHERE i <= 10) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, item) AS i FROM judged) GROUP BY 1)
SELECT round(avg(coalesce(found / least(relevant, 10), 0)), 6) AS recall, round(avg(coalesce(1 / first, 0)), 6) AS mrr, round(avg(coalesce(dcg / idcg, 0)), 6) AS ndcg, count(*) AS queries FROM ideal LEFT JOIN hits USING (query_id) WHERE relevant > 0""", "chunk")
def a31_ranking_quality(spark, sf_dir):
    c, q = chunks(spark, sf_dir), view(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql"))
    judged = c.crossJoin(F.broadcast(q)).select("query_id", F.col("chunk_id").alias("item"), F.when(F.col("label") == F.col("ql"), 1 + F.col("chunk_id") % 2).otherwise(0).alias("grade"))
    ranked = ops.vector_top_k(asked(spark, sf_dir), ops.retrievable(c), 10).select("query_id", F.col("chunk_id").alias("item"), "rank")
    out = ops.quality(judged, ranked, 10)
    return out.select(*[F.round(x, 6).alias(x) for x in ("recall", "mrr", "ndcg")], "queries")


@query("SELECT c.chunk_id FROM chunk c WHERE c.parent_chunk_id IS NOT NULL AND c.parent_chunk_id NOT IN (SELECT chunk_id FROM chunk WHERE is_parent AND chunk_id % 25 > 0)", "chunk")
def j09_dangling_children(spark, sf_dir):
    c = chunks(spark, sf_dir)
    parents = c.where("is_parent AND chunk_id % 25 > 0").select(F.col("chunk_id").alias("parent_chunk_id"))
    return c.where("parent_chunk_id IS NOT NULL").join(parents, "parent_chunk_id", "left_anti").select("chunk_id")


@query("SELECT c.chunk_id, coalesce(p.chunk_index, c.chunk_index) AS chunk_index, p.chunk_id IS NOT NULL AS has_parent FROM chunk c LEFT JOIN chunk p ON p.chunk_id = c.parent_chunk_id WHERE NOT c.is_parent", "chunk")
def s05_parent_fetch(spark, sf_dir):
    c = chunks(spark, sf_dir)
    p = c.select(F.col("chunk_id").alias("parent_chunk_id"), F.col("chunk_index").alias("pi"), F.lit(True).alias("has"))
    return c.where("NOT is_parent").join(p, "parent_chunk_id", "left").select("chunk_id", F.coalesce("pi", "chunk_index").alias("chunk_index"), F.coalesce("has", F.lit(False)).alias("has_parent"))


@query("SELECT document_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index, chunk_id) AS rn FROM chunk WHERE NOT is_parent) WHERE rn = 1", "chunk")
def w03_lead_chunk(spark, sf_dir):
    return chunks(spark, sf_dir).where("NOT is_parent").groupBy("document_id").agg(F.min(F.struct("chunk_index", "chunk_id")).alias("m")).select("document_id", "m.chunk_id")


@query("SELECT document_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index, chunk_id) AS rn FROM chunk) WHERE rn <= 3", "chunk")
def w04_hydrate_documents(spark, sf_dir):
    first = F.row_number().over(Window.partitionBy("document_id").orderBy("chunk_index", "chunk_id"))
    return chunks(spark, sf_dir).withColumn("rn", first).where("rn <= 3").select("document_id", "chunk_id")


@query("SELECT document_id, string_agg(CAST(chunk_id AS VARCHAR), '-' ORDER BY chunk_index, chunk_id) AS text FROM chunk WHERE NOT is_parent GROUP BY 1", "chunk")
def n34_document_text(spark, sf_dir):
    return chunks(spark, sf_dir).where("NOT is_parent").groupBy("document_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "chunk_id"))), lambda s: s["chunk_id"].cast("string")), "-").alias("text"))


@query("SELECT document_id, count(*) AS points, list_sort(list(DISTINCT doc_version)) AS versions, count(*) FILTER (WHERE section_type IS NULL) AS untyped FROM chunk GROUP BY 1", "chunk")
def a15_index_state(spark, sf_dir):
    return chunks(spark, sf_dir).groupBy("document_id").agg(F.count("*").alias("points"), F.sort_array(F.collect_set("doc_version")).alias("versions"), F.count_if(F.col("section_type").isNull()).alias("untyped"))


@query("SELECT pos, c.chunk_id, document_id FROM (SELECT unnest([40, 3, 999999, 17]) AS chunk_id, unnest([0, 1, 2, 3]) AS pos) i JOIN chunk c ON c.chunk_id = i.chunk_id", "chunk")
def s04_fetch_in_order(spark, sf_dir):
    ids = spark.range(1).select(F.posexplode(F.array(*[F.lit(x).cast("long") for x in (40, 3, 999999, 17)])).alias("pos", "chunk_id"))
    return chunks(spark, sf_dir).join(F.broadcast(ids), "chunk_id").select("pos", "chunk_id", "document_id").orderBy("pos")
