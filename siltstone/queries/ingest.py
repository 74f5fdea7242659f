"""Incremental ingest, integrity checks and metrics over the catalog tables and the event log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.operators import ingest as ops
from siltstone.sources.views import ctes, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: view(spark, sf_dir, name))
        if sql:
            SQL[f.__name__] = (ctes(*views).rstrip() + (", " if sql.startswith("+") else " ") + sql.lstrip("+")) if views else sql.replace("+", "WITH ", 1) if sql.startswith("+") else sql
        return f

    return register


def snapshot(t):
    """The catalog with each document once: its latest copy."""
    return t("catalog_document").groupBy("document_id").agg(*[F.max(c).alias(c) for c in ("bundle", "fingerprint", "pipeline_version", "changed_mark", "content_hash", "doc_version", "source_type", "title", "effective_start_date")])


_SNAP = "snap AS (SELECT document_id, " + ", ".join(f"max({c}) AS {c}" for c in ("bundle", "fingerprint", "pipeline_version", "changed_mark", "content_hash", "doc_version", "source_type", "title", "effective_start_date")) + " FROM catalog_document GROUP BY document_id)"


@query("SELECT id, document_id, status, event_time, latency_ms FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY id DESC) AS rn FROM ingest_log) WHERE rn = 1", "ingest_log")
def w01_latest_log(t):
    return ops.latest(t("ingest_log"), "document_id", "id").select("id", "document_id", "status", "event_time", "latency_ms")


@query("SELECT id, status FROM ingest_log WHERE status = 'click' ORDER BY id DESC LIMIT 200", "ingest_log")
def s15_log_tail(t):
    return t("ingest_log").where("status = 'click'").orderBy(F.desc("id")).limit(200).select("id", "status")


@query("SELECT id FROM ingest_log WHERE event_time >= TIMESTAMP '2024-01-20'", "ingest_log")
def s16_pruned_log(t):
    return t("ingest_log").where(F.col("event_time") >= F.lit("2024-01-20").cast("timestamp_ntz")).select("id")


@query(f"+{_SNAP}, crawl AS (SELECT document_id, CASE WHEN length(title) % 3 = 0 THEN concat(fingerprint, 'x') ELSE fingerprint END AS fingerprint FROM snap UNION ALL SELECT concat('new-', document_id), fingerprint FROM snap WHERE bundle IS NULL) SELECT c.document_id, c.fingerprint, CASE WHEN s.document_id IS NULL THEN 'NEW' WHEN s.fingerprint IS DISTINCT FROM c.fingerprint OR s.pipeline_version IS DISTINCT FROM (SELECT max(pipeline_version) FROM snap) THEN 'CHANGED' ELSE 'UNCHANGED' END AS status FROM crawl c LEFT JOIN snap s USING (document_id)")
def i01_change_status(t):
    s = snapshot(t)
    edited = s.select("document_id", F.when(F.length("title") % 3 == 0, F.concat("fingerprint", F.lit("x"))).otherwise(F.col("fingerprint")).alias("fingerprint"))
    fresh = s.where("bundle IS NULL").select(F.concat(F.lit("new-"), "document_id").alias("document_id"), "fingerprint")
    version = s.agg(F.max("pipeline_version").alias("v")).first()["v"]
    return ops.change_status(s, edited.unionByName(fresh), version or "")


@query(f"+{_SNAP}, live AS (SELECT document_id FROM snap WHERE NOT (bundle = 'news' AND doc_version > 1) AND NOT (bundle = 'page' AND starts_with(document_id, '0'))), g AS (SELECT bundle, count(*) AS held, count(*) FILTER (WHERE document_id NOT IN (SELECT document_id FROM live)) AS missing FROM snap WHERE bundle IS NOT NULL GROUP BY 1) SELECT document_id, bundle FROM snap JOIN g USING (bundle) WHERE document_id NOT IN (SELECT document_id FROM live) AND missing < held AND (missing <= 2 OR missing < 0.1 * held)")
def i02_plausible_deletions(t):
    s = snapshot(t)
    gone = F.coalesce((F.col("bundle") == "news") & (F.col("doc_version") > 1), F.lit(False)) | F.coalesce((F.col("bundle") == "page") & F.startswith("document_id", F.lit("0")), F.lit(False))
    return ops.deletions(s.where("bundle IS NOT NULL"), s.where(~gone), "bundle")


@query(f"+{_SNAP}, f AS (SELECT bundle, min(changed_mark) AS floor FROM snap WHERE doc_version > 2 GROUP BY 1) SELECT bundle, CASE WHEN floor < mark THEN floor ELSE mark END AS start FROM (SELECT bundle, max(changed_mark) AS mark FROM snap WHERE bundle IS NOT NULL GROUP BY 1) LEFT JOIN f USING (bundle)")
def i03_high_water(t):
    s = snapshot(t).where("bundle IS NOT NULL")
    return ops.high_water(s, s.where("doc_version > 2"), "bundle")


@query(f"""+{_SNAP}, queue AS (SELECT document_id, doc_version AS attempts, changed_mark FROM snap WHERE doc_version > 1), out_ AS (SELECT document_id, changed_mark - 10 AS m, length(document_id || coalesce(title, '')) % 2 = 0 AS failed FROM snap WHERE bundle = 'news')
SELECT coalesce(q.document_id, o.document_id) AS document_id, CAST(coalesce(attempts, 0) + CASE WHEN failed THEN 1 ELSE 0 END AS INTEGER) AS attempts, least(q.changed_mark, o.m) AS changed_mark FROM queue q FULL JOIN out_ o ON q.document_id = o.document_id WHERE failed IS NULL OR failed""")
def i04_retry_queue(t):
    s = snapshot(t)
    queue = s.where("doc_version > 1").select("document_id", F.col("doc_version").alias("attempts"), "changed_mark")
    outcomes = s.where("bundle = 'news'").select("document_id", (F.col("changed_mark") - 10).alias("changed_mark"), (F.length(F.concat("document_id", F.coalesce("title", F.lit("")))) % 2 == 0).alias("failed"))
    return ops.retry_queue(queue, outcomes)


@query(f"+{_SNAP} SELECT document_id FROM snap WHERE NOT (doc_version = 1 AND bundle = 'news' AND fingerprint IS NOT NULL) OR bundle IS NULL")
def i05_live_links(t):
    s = snapshot(t)
    return ops.not_dead(s, s.where("doc_version = 1 AND bundle = 'news'")).select("document_id")


@query(f"""+{_SNAP}, batch AS (SELECT document_id, upper(bundle) AS bundle, CASE WHEN doc_version = 1 THEN title || '!' END AS title FROM snap WHERE doc_version < 3 UNION ALL SELECT concat('n', document_id), 'added', 'T' FROM snap WHERE doc_version = 1)
SELECT coalesce(s.document_id, b.document_id) AS document_id, CASE WHEN b.document_id IS NOT NULL THEN b.bundle ELSE s.bundle END AS bundle, coalesce(b.title, s.title) AS title FROM snap s FULL JOIN batch b ON s.document_id = b.document_id""")
def i07_merge(t):
    s = snapshot(t)
    batch = s.where("doc_version < 3").select("document_id", F.upper("bundle").alias("bundle"), F.when(F.col("doc_version") == 1, F.concat("title", F.lit("!"))).alias("title"))
    batch = batch.unionByName(s.where("doc_version = 1").select(F.concat(F.lit("n"), "document_id").alias("document_id"), F.lit("added").alias("bundle"), F.lit("T").alias("title")))
    return ops.merge(s, batch, "document_id", ["bundle"], ["title"])


@query("SELECT DISTINCT document_id, theme FROM documents_theme WHERE document_id NOT IN (SELECT document_id FROM documents_theme WHERE theme = 'Water') UNION ALL SELECT DISTINCT document_id, 'Replaced' FROM documents_theme WHERE theme = 'Water'")
def i08_replace_facet(t):
    facet = t("documents_theme").select("document_id", "theme").distinct()
    batch = facet.where("theme = 'Water'").select("document_id", F.lit("Replaced").alias("theme"))
    return ops.replace_facet(facet, batch, "document_id")


@query(f"""+{_SNAP}, batch AS (SELECT document_id, CASE WHEN bundle = 'news' THEN concat(content_hash, 'x') ELSE content_hash END AS content_hash FROM snap WHERE doc_version < 3 UNION ALL SELECT concat('n', document_id), content_hash FROM snap WHERE doc_version = 2)
SELECT coalesce(s.document_id, b.document_id) AS document_id, coalesce(b.content_hash, s.content_hash) AS content_hash, CASE WHEN s.doc_version IS NULL THEN 1 WHEN b.content_hash IS NULL OR b.content_hash IS NOT DISTINCT FROM s.content_hash THEN s.doc_version ELSE s.doc_version + 1 END AS doc_version
FROM snap s FULL JOIN batch b ON s.document_id = b.document_id""")
def i09_versions(t):
    s = snapshot(t)
    batch = s.where("doc_version < 3").select("document_id", F.when(F.col("bundle") == "news", F.concat("content_hash", F.lit("x"))).otherwise(F.col("content_hash")).alias("content_hash"))
    return ops.merge_versions(s, batch.unionByName(s.where("doc_version = 2").select(F.concat(F.lit("n"), "document_id").alias("document_id"), "content_hash")))


@query("SELECT document_id, status, id FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY id DESC) AS rn FROM ingest_log) WHERE rn = 1 AND status NOT IN ('purchase') AND document_id NOT IN (SELECT user_id FROM events WHERE user_id % 3 = 0) AND document_id IN (SELECT user_id FROM events WHERE value > 0)", "ingest_log")
def j06_stranded(t):
    log = t("ingest_log")
    return ops.stranded(log, log.where("document_id % 3 = 0").select("document_id"), log.where("latency_ms > 0").select("document_id"), ["purchase"])


@query(f"+{_SNAP}, p AS (SELECT DISTINCT payload.document_id AS document_id FROM qdrant_point) SELECT s.document_id FROM snap s WHERE s.document_id NOT IN (SELECT document_id FROM p WHERE document_id IS NOT NULL)")
def r01_without_points(t):
    return snapshot(t).select("document_id").join(t("qdrant_point").select("payload.document_id"), "document_id", "left_anti")


@query("SELECT DISTINCT payload.document_id AS document_id FROM qdrant_point WHERE payload.document_id IS NOT NULL AND payload.document_id NOT IN (SELECT document_id FROM catalog_document WHERE pipeline_version <> '2026.3')")
def r02_points_without_document(t):
    return t("qdrant_point").select("payload.document_id").where("document_id IS NOT NULL").distinct().join(t("catalog_document").where("pipeline_version <> '2026.3'").select("document_id"), "document_id", "left_anti")


@query("SELECT payload.document_id AS document_id, count(DISTINCT payload.doc_version) AS versions FROM qdrant_point WHERE payload.document_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT payload.doc_version) > 1")
def r03_live_versions(t):
    return t("qdrant_point").where("payload.document_id IS NOT NULL").groupBy(F.col("payload.document_id").alias("document_id")).agg(F.count_distinct("payload.doc_version").alias("versions")).where("versions > 1")


@query("SELECT DISTINCT chunk_id FROM qdrant_point WHERE NOT payload.is_parent AND payload.parent_chunk_id IS NOT NULL AND payload.parent_chunk_id NOT IN (SELECT chunk_id FROM qdrant_point WHERE payload.is_parent AND payload.section_type IS NULL AND chunk_id % 7 > 0)")
def r05_children_without_parent(t):
    q = t("qdrant_point")
    parents = q.where("payload.is_parent AND payload.section_type IS NULL AND chunk_id % 7 > 0").select(F.col("chunk_id").alias("parent"))
    return q.where("NOT payload.is_parent AND payload.parent_chunk_id IS NOT NULL").select("chunk_id", F.col("payload.parent_chunk_id").alias("parent")).join(parents, "parent", "left_anti").select("chunk_id").distinct()


@query(f"+{_SNAP} SELECT pipeline_version, count(*) AS n FROM snap WHERE pipeline_version IS DISTINCT FROM (SELECT max(pipeline_version) FROM snap) GROUP BY 1")
def r06_pipeline_drift(t):
    s = snapshot(t)
    newest = s.agg(F.max("pipeline_version").alias("v"))
    return s.join(F.broadcast(newest)).where(~F.col("pipeline_version").eqNullSafe(F.col("v"))).groupBy("pipeline_version").agg(F.count("*").alias("n"))


@query(f"+{_SNAP} SELECT 'documents_without_date' AS \"check\", count(*) AS offenders, (SELECT list_sort(list(document_id)) FROM (SELECT document_id FROM snap WHERE effective_start_date IS NULL ORDER BY document_id LIMIT 5)) AS examples FROM snap WHERE effective_start_date IS NULL")
def r07_documents_without_date(t):
    return ops.offenders(snapshot(t).where("effective_start_date IS NULL"), "documents_without_date", "document_id")


_MOVED = "(SELECT document_id, start_precision, effective_start_date + INTERVAL 3 DAY AS start, effective_end_date AS stop FROM cat_document WHERE document_id % 5 = 0 UNION ALL SELECT document_id, start_precision, effective_start_date, effective_end_date FROM cat_document WHERE document_id % 5 > 0)"


def _moved(t):
    """Documents with some start dates moved by three days and ends before them, as offenders."""
    shift = F.when(F.col("document_id") % 5 == 0, F.col("effective_start_date") + F.expr("INTERVAL 3 DAYS")).otherwise(F.col("effective_start_date"))
    return t("cat_document").select("document_id", "start_precision", shift.alias("start"), F.col("effective_end_date").alias("stop"))


@query(f"SELECT document_id FROM {_MOVED} WHERE (start_precision = 'year' AND (month(start) <> 1 OR day(start) <> 1)) OR (start_precision = 'month' AND day(start) <> 1)", "cat_document")
def r08_precision_mismatch(t):
    return _moved(t).where("(start_precision = 'year' AND (month(start) <> 1 OR day(start) <> 1)) OR (start_precision = 'month' AND day(start) <> 1)").select("document_id")


@query(f"SELECT document_id FROM (SELECT document_id, start, stop - INTERVAL 399 DAY AS stop FROM {_MOVED}) WHERE stop < start", "cat_document")
def r10_inverted_ranges(t):
    return _moved(t).where(F.col("stop") - F.expr("INTERVAL 399 DAYS") < F.col("start")).select("document_id")


@query("SELECT DISTINCT a.document_id FROM cat_document a JOIN (SELECT document_id, max(theme_group) AS g, min(theme_group) AS h FROM cat_theme GROUP BY 1) b USING (document_id) WHERE (CASE WHEN a.doc_version = 1 THEN 'main' END) IS DISTINCT FROM b.h", "cat_document", "cat_theme")
def r11_attribute_drift(t):
    side = t("cat_theme").groupBy("document_id").agg(F.min("theme_group").alias("g"))
    return ops.drift(t("cat_document").select("document_id", F.when(F.col("doc_version") == 1, "main").alias("g")), side, "document_id", ["g"])


@query(f"+{_SNAP}, p AS (SELECT DISTINCT payload.document_id AS document_id FROM qdrant_point WHERE payload.document_id IS NOT NULL) SELECT CASE WHEN s.document_id IS NULL THEN 'index_only' WHEN p.document_id IS NULL THEN 'catalog_only' ELSE 'both' END AS side, count(*) AS n FROM snap s FULL JOIN p ON s.document_id = p.document_id GROUP BY 1")
def j08_catalog_index_diff(t):
    c = snapshot(t).select("document_id", F.lit(True).alias("c"))
    p = t("qdrant_point").select("payload.document_id").where("document_id IS NOT NULL").distinct().withColumn("p", F.lit(True))
    side = F.when(F.col("c").isNull(), "index_only").when(F.col("p").isNull(), "catalog_only").otherwise("both")
    return c.join(p, "document_id", "full_outer").groupBy(side.alias("side")).agg(F.count("*").alias("n"))


@query("SELECT document_id FROM ingest_log GROUP BY document_id HAVING count(*) FILTER (WHERE status = 'purchase') = 0 OR count(*) > 60 ORDER BY count(*) DESC, document_id LIMIT 100", "ingest_log")
def j10_pending_runs(t):
    runs = t("ingest_log").groupBy("document_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "purchase").alias("done"))
    return runs.where("done = 0 OR n > 60").orderBy(F.desc("n"), "document_id").limit(100).select("document_id")


@query("""+last AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY id DESC) AS rn FROM ingest_log), s AS (SELECT status, list_sort(list(latency_ms)) AS s FROM last WHERE rn <= 512 GROUP BY 1)
SELECT status, count(*) AS n, round(sum(latency_ms), 1) AS total, round(avg(latency_ms), 1) AS mean, round(max(latency_ms), 1) AS most, round(any_value(s)[CAST(round_even(0.5 * (len(any_value(s)) - 1), 0) AS INT) + 1], 1) AS p50, round(any_value(s)[CAST(round_even(0.95 * (len(any_value(s)) - 1), 0) AS INT) + 1], 1) AS p95
FROM ingest_log JOIN s USING (status) GROUP BY status""", "ingest_log")
def a21_stage_metrics(t):
    return ops.stage_metrics(t("ingest_log"), "status", "id", "latency_ms")


@query("SELECT status, n, round(n / sum(n) OVER (), 6) AS share FROM (SELECT status, count(*) AS n FROM ingest_log GROUP BY 1)", "ingest_log")
def a22_component_share(t):
    counted = t("ingest_log").groupBy("status").agg(F.count("*").alias("n"))
    return counted.join(F.broadcast(counted.agg(F.sum("n").alias("all")))).select("status", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))


@query("SELECT family, status, n, round(n / sum(n) OVER (PARTITION BY family), 6) AS share FROM (SELECT document_id % 7 AS family, status, count(*) AS n FROM ingest_log GROUP BY 1, 2)", "ingest_log")
def a23_outcome_shares(t):
    return ops.shares(t("ingest_log").withColumn("family", F.col("document_id") % 7), "family", "status")


@query("SELECT document_id, status, count(*) AS calls, count(*) FILTER (WHERE latency_ms = 0) AS empty, round(sum(latency_ms), 2) AS total_ms FROM ingest_log GROUP BY 1, 2", "ingest_log")
def a24_trace_rollup(t):
    return t("ingest_log").groupBy("document_id", "status").agg(F.count("*").alias("calls"), F.count_if(F.col("latency_ms") == 0).alias("empty"), F.round(F.sum("latency_ms"), 2).alias("total_ms"))


@query("SELECT document_id, status, n FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY n DESC, (status IS NULL), first_id) AS rn FROM (SELECT document_id, nullif(status, 'view') AS status, count(*) AS n, min(id) AS first_id FROM ingest_log GROUP BY 1, 2)) WHERE rn = 1", "ingest_log")
def a27_majority_vote(t):
    return ops.majority(t("ingest_log").withColumn("status", F.nullif("status", F.lit("view"))), "document_id", "status", "id")


@query("SELECT document_id, status, round(count(*) / sum(count(*)) OVER (PARTITION BY document_id), 3) AS agreement FROM ingest_log GROUP BY 1, 2", "ingest_log")
def a28_label_confidence(t):
    counted = t("ingest_log").groupBy("document_id", "status").agg(F.count("*").alias("n"))
    return counted.select("document_id", "status", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("document_id")), 3).alias("agreement"))


@query("SELECT status AS surface, count(*) AS observations, min(event_time) AS first_seen, max(event_time) AS last_seen FROM ingest_log GROUP BY 1", "ingest_log")
def a29_observations(t):
    return t("ingest_log").groupBy(F.col("status").alias("surface")).agg(F.count("*").alias("observations"), F.min("event_time").alias("first_seen"), F.max("event_time").alias("last_seen"))


@query("SELECT id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM ingest_log", "ingest_log")
def m06_json_field(t):
    return t("ingest_log").select("id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT field, count(*) AS rows, min(example) AS example FROM (SELECT unnest(json_keys(props)) AS field, props AS example FROM ingest_log) GROUP BY 1", "ingest_log")
def proj12_field_audit(t):
    return t("ingest_log").select(F.explode(F.json_object_keys("props")).alias("field"), F.col("props").alias("example")).groupBy("field").agg(F.count("*").alias("rows"), F.min("example").alias("example"))


@query("SELECT id, CAST(floor(epoch(event_time)) AS BIGINT) AS unix FROM ingest_log", "ingest_log")
def d18_epoch_seconds(t):
    return t("ingest_log").select("id", F.unix_timestamp(F.col("event_time").cast("timestamp")).alias("unix"))


@query("SELECT document_id, first(author ORDER BY author) AS author FROM cat_author GROUP BY document_id", "cat_author")
def s20_backfill_facets(t):
    return t("cat_author").groupBy("document_id").agg(F.min("author").alias("author"))


@query("SELECT min(id) AS id, document_id, status FROM ingest_log GROUP BY document_id, status", "ingest_log")
def i06_first_seen(t):
    return t("ingest_log").groupBy("document_id", "status").agg(F.min("id").alias("id"))


@query("SELECT status AS outcome, count(*) AS n FROM ingest_log GROUP BY 1", "ingest_log")
def i12_outcome_tally(t):
    return t("ingest_log").groupBy(F.col("status").alias("outcome")).agg(F.count("*").alias("n"))


@query("SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY id) AS rn FROM ingest_log) WHERE rn <= 5", "ingest_log")
def i16_call_budget(t):
    return t("ingest_log").withColumn("rn", F.row_number().over(Window.partitionBy("document_id").orderBy("id"))).where("rn <= 5").select("id")
