"""Scalar functions over names, titles, texts and stamps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions import text, windows
from siltstone.sources.views import view

QUERIES = {}
SQL: dict[str, str] = {}


def add(name: str, table: str, key: str, value: Callable[[], Column], sql: str | None, where: str = "true") -> None:
    """A query of ``key`` and ``out`` over a table, and the same in SQL."""
    QUERIES[name] = lambda spark, sf_dir: view(spark, sf_dir, table).where(where).select(key, value().alias("out"))
    if sql:
        SQL[name] = f"SELECT {key}, {sql} AS out FROM {table} WHERE {where}"


_FOLD = r"trim(regexp_replace(regexp_replace(lower({0}), '[''’`]', '', 'g'), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
_STOP = "[" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "]"


def fold(c: str) -> str:
    return _FOLD.format(c)


D, K = "documents", "doc_id"
add("x01_fold_name", D, K, lambda: text.fold_name(F.col("title")), fold("title"))
add("x01_fold_unicode", D, K, lambda: text.fold_name_unicode(F.col("title")), None)
add("x02_person", "customer", "c_custkey", lambda: text.person(F.concat(F.lit("Dr. Prof "), F.col("c_name"), F.lit(", PhD"))), rf"regexp_replace(regexp_replace(regexp_replace({fold("concat('Dr. Prof ', c_name, ', PhD')")}, '^(?:(?:{'|'.join(text.HONORIFICS)}) )+', ''), '(?: (?:{'|'.join(text.POST_NOMINALS)}))+$', ''), '(\p{{L}})\d+$', '\1')")
_LEGAL = "CASE w " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in text.LEGAL_FORMS.items()) + " ELSE w END"
add("x03_organization", "supplier", "s_suppkey", lambda: text.organization(F.concat(F.col("s_name"), F.lit(" & Sons Pvt. Ltd"))), f"array_to_string(list_transform(string_split({fold("replace(concat(s_name, ' & Sons Pvt. Ltd'), '&', ' and ')")}, ' '), lambda w: {_LEGAL}), ' ')")
add("x04_project", "part", "p_partkey", lambda: text.project(F.concat(F.lit("The "), F.col("p_name"))), f"regexp_replace({fold("concat('The ', p_name)")}, '^(?:the|a|an) ', '')")
add("x06_initials", D, K, lambda: text.initials(F.col("title")), f"array_to_string(list_transform(list_filter(string_split({fold('title')}, ' '), lambda w: w <> ''), lambda w: left(w, 1)), '')", "title IS NOT NULL")
add("x08_acronym", D, K, lambda: text.acronym(F.col("title")), f"upper(array_to_string(list_transform(list_filter(string_split({fold('title')}, ' '), lambda w: w <> '' AND NOT list_contains({_STOP}, w)), lambda w: left(w, 1)), ''))", "title IS NOT NULL")
add("x12_content_terms", D, K, lambda: F.array_join(text.content_terms(F.col("title")), " "), rf"array_to_string(list_reduce(list_transform(list_filter(regexp_extract_all(lower(title), '[\p{{L}}\p{{N}}]+'), lambda w: length(w) >= 3 AND NOT list_contains({_STOP}, w)), lambda w: [w]), lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE list_concat(a, b) END), ' ')", "title IS NOT NULL AND regexp_like(title, '[0-9]')")
SQL.pop("x12_content_terms")
SQL["x12_content_terms"] = rf"SELECT doc_id, array_to_string(list_transform(list_filter(list_zip(w, generate_series(1, len(w))), lambda x: list_position(w, x[1]) = x[2]), lambda x: x[1]), ' ') AS out FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(title), '[\p{{L}}\p{{N}}]+'), lambda w: length(w) >= 3 AND NOT list_contains({_STOP}, w)) AS w FROM documents WHERE title IS NOT NULL AND regexp_matches(title, '[0-9]'))"
add("x14_slug", D, K, lambda: text.slug(F.col("title")), "regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')")
add("x18_markers", D, K, lambda: F.size(text.markers(F.concat(F.lit("As in [2] and [14], "), F.col("title")))).cast("long"), "len(regexp_extract_all(concat('As in [2] and [14], ', title), '\\[([0-9]{1,3})\\]'))", "title IS NOT NULL")
add("x19_numbers", D, K, lambda: F.array_join(F.sort_array(text.numbers(F.col("text"))), " "), r"array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?'), lambda x: replace(x, ',', '')))), ' ')", "text IS NOT NULL")
add("x23_predicate_name", "events", "event_id", lambda: text.predicate_name(F.concat(F.lit(" was "), F.col("event_type"), F.lit("-ed by!"))), "upper(regexp_replace(regexp_replace(trim(concat(' was ', event_type, '-ed by!')), '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'))")
add("x24_literal_key", "catalog_document", "document_id", lambda: text.literal_key(F.col("title")), r"lower(trim(regexp_replace(title, '\s+', ' ', 'g')))")
add("x16_number_soup", "page_content", "page_id", lambda: F.size(F.filter(F.split(F.regexp_replace("text", "\r", ""), "\n"), text.number_soup)).cast("long"), r"len(list_filter(string_split(replace(text, chr(13), ''), chr(10)), lambda l: len(regexp_extract_all(' ' || trim(l) || ' ', '\s[-+(]?[0-9][0-9.,%)]*')) >= 0 AND len(list_filter(regexp_extract_all(l, '\S+'), lambda w: regexp_matches(w, '^[-+(]?[0-9][0-9.,%)]*$'))) >= 4 AND 2 * len(list_filter(regexp_extract_all(l, '\S+'), lambda w: regexp_matches(w, '^[-+(]?[0-9][0-9.,%)]*$'))) > len(regexp_extract_all(l, '\S+'))))", "text IS NOT NULL")
add("d10_editions", "orders", "o_orderkey", lambda: F.array_join(text.editions(F.concat(F.lit("Report 20"), F.lpad((F.col("o_orderkey") % 31).cast("string"), 2, "0"), F.lit("-"), F.lpad(((F.col("o_orderkey") + F.col("o_orderkey") % 2) % 31).cast("string"), 2, "0"))), ","), "CASE WHEN ((o_orderkey + o_orderkey % 2) % 31) = (o_orderkey % 31 + 1) % 100 THEN concat('20', lpad(CAST(o_orderkey % 31 AS VARCHAR), 2, '0'), '-', lpad(CAST((o_orderkey + o_orderkey % 2) % 31 AS VARCHAR), 2, '0')) ELSE '' END")
add("n28_years", D, K, lambda: F.array_join(F.sort_array(text.years_in(F.col("title"))), ","), r"array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(title, '\b((?:19|20)[0-9]{2})\b', 1), lambda y: CAST(y AS INT)))), ',')", "title IS NOT NULL")
add("d09_pdf_day", "pdf_evidence", "evidence_id", lambda: F.date_format(windows.pdf_day(F.col("pdf_created")), "yyyy-MM-dd"), r"strftime(try_cast(regexp_replace(regexp_extract(pdf_created, '^D:\d{8}'), '^D:(\d{4})(\d{2})(\d{2})$', '\1-\2-\3') AS DATE), '%Y-%m-%d')")
add("d01_iso_prefix", "dates_stage", "stage_id", lambda: F.date_format(windows.iso_prefix(F.col("record_changed")), "yyyy-MM-dd HH:mm:ss"), r"strftime(try_cast(replace(nullif(regexp_extract(record_changed, '^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2}:\d{2}))?'), ''), 'T', ' ') AS TIMESTAMP), '%Y-%m-%d %H:%M:%S')")
_PHRASE = lambda: F.concat(F.lit("between "), (F.lit(1990) + F.col("o_orderkey") % 20).cast("string"), F.lit(" and "), (F.lit(1995) + F.col("o_custkey") % 20).cast("string"))
_W = lambda: windows.phrase_window(_PHRASE())
add("d11_phrase_window", "orders", "o_orderkey", lambda: F.transform(F.array(_W()), lambda w: F.concat_ws("/", F.date_format(w["valid_from"], "yyyy-MM-dd"), F.date_format(w["valid_until"], "yyyy-MM-dd")))[0], "CASE WHEN 1995 + o_custkey % 20 > 1990 + o_orderkey % 20 THEN concat(1990 + o_orderkey % 20, '-01-01/', 1995 + o_custkey % 20, '-01-01') ELSE '' END")
add("m03_token_estimate", D, K, lambda: F.ceil(F.length("text") / 4), "CAST(ceil(length(text) / 4) AS BIGINT)")
add("m04_sha256_id", D, K, lambda: F.concat(F.lit("claim_"), F.substring(F.sha2(F.concat_ws("\u001f", F.col("doc_id").cast("string"), "lang"), 256), 1, 24)), "concat('claim_', left(sha256(concat_ws(chr(31), CAST(doc_id AS VARCHAR), lang)), 24))")
add("m01_sigmoid", "events", "event_id", lambda: F.round(1 / (1 + F.exp(-F.col("value") / 100)), 9), "round(1 / (1 + exp(-value / 100)), 9)")
SQL["u03_stored_values"] = f"SELECT document_id, theme_path, array_to_string(list_transform(list_filter(list_zip(p, generate_series(1, len(p))), lambda x: list_position(p, x[1]) = x[2]), lambda x: x[1]), '|') AS out FROM (SELECT DISTINCT document_id, theme_path, list_transform(list_filter(string_split(theme_path, ' > '), lambda x: x <> ''), lambda x: left(x, {text.FACET_WIDTH})) AS p FROM documents_theme WHERE theme_path IS NOT NULL)"
QUERIES["u03_stored_values"] = lambda spark, sf_dir: view(spark, sf_dir, "documents_theme").where("theme_path IS NOT NULL").select("document_id", "theme_path").distinct().withColumn("out", F.array_join(text.stored_values(F.split("theme_path", " > ")), "|"))
add("x09_name_score", D, K, lambda: F.round(text.name_score(text.fold_name(F.col("title")), text.fold_name(F.concat(F.lit("Annual "), F.col("bundle")))), 6), None)
add("m04_uuid5", D, K, lambda: text.uuid5("6ba7b810-9dad-11d1-80b4-00c04fd430c8", F.col("doc_id").cast("string")), None)
add("v05_key_terms", D, K, lambda: F.array_join(text.key_terms(F.col("title")), "|"), None)
add("d14_temporal_mode", D, K, lambda: windows.temporal_mode(F.col("title")), None)
