"""Catalog analytics: filters, counts, distributions, cross-tabs, lists and hierarchy scopes over documents and their facets.

A filter on a facet is a semi-join, so no filter multiplies documents; only grouping by a facet joins it, and then documents
are counted once for each group. The facet tables are joined, never collected.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SEPARATOR = " > "
NOT_THEMES = ("", "False", "True")


def clamp(value: int, low: int, high: int) -> int:
    return max(low, min(high, value))


def contains_ci(column: Column, term: str) -> Column:
    """Case-insensitive substring; the term is taken literally, so nothing needs escaping."""
    return F.contains(F.lower(column), F.lit(term.lower()))


def any_term(column: Column, terms: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(t.lower()) for t in terms]), lambda t: F.contains(F.lower(column), t)) if terms else F.lit(True)


def theme_scope(name: str, path: str | None = None) -> Column:
    """A theme and all below it: by stored path, and by name or parent on rows without a path."""
    p = path or name
    return (F.col("theme_path") == p) | F.startswith(F.col("theme_path"), F.lit(p + SEPARATOR)) | (F.col("theme_path").isNull() & ((F.col("theme") == name) | (F.col("parent") == name)))


@dataclass
class Catalog:
    """The catalog's tables; facets may be left out where they are not asked for."""

    documents: DataFrame
    authors: DataFrame | None = None
    themes: DataFrame | None = None
    tags: DataFrame | None = None
    attachments: DataFrame | None = None


@dataclass
class Scope:
    """A conjunction of catalog filters; unset ones do not filter."""

    source_type: str | None = None
    bundle: str | None = None
    entity_type: str | None = None
    title_contains: str | None = None
    topic_terms: list[str] = field(default_factory=list)
    author: str | None = None
    theme: str | None = None
    theme_path: str | None = None
    theme_group: str | None = None
    tag: str | None = None
    date_from: date | None = None
    date_to: date | None = None

    def apply(self, c: Catalog) -> DataFrame:
        d = c.documents
        for name in ("source_type", "bundle", "entity_type"):
            if getattr(self, name) is not None:
                d = d.where(F.col(name) == getattr(self, name))
        if self.title_contains:
            d = d.where(contains_ci(F.col("title"), self.title_contains))
        if self.topic_terms:
            d = d.where(any_term(F.col("title"), self.topic_terms))
        if self.date_from:
            d = d.where(F.col("effective_start_date") >= F.lit(self.date_from).cast("timestamp_ntz"))
        if self.date_to:
            d = d.where(F.col("effective_start_date") < F.lit(self.date_to).cast("timestamp_ntz"))
        if self.author:
            d = d.join(c.authors.where(contains_ci(F.col("author"), self.author)), "document_id", "left_semi")
        if self.tag:
            d = d.join(c.tags.where(F.lower("tag") == self.tag.lower()), "document_id", "left_semi")
        if self.theme:
            d = d.join(c.themes.where(theme_scope(self.theme, self.theme_path)), "document_id", "left_semi")
        if self.theme_group:
            d = d.join(c.themes.where(F.col("theme_group") == self.theme_group), "document_id", "left_semi")
        return d


def author_key() -> Column:
    return F.coalesce("author_norm", "author")


def _grouped(c: Catalog, docs: DataFrame, by: str, theme_group: str | None = None) -> tuple[DataFrame, Column, Column]:
    """Documents joined with the facet of a dimension, its grouping key and its label."""
    if by == "author":
        return docs.join(c.authors, "document_id"), author_key(), F.min("author")
    if by == "theme":
        themes = c.themes.where(~F.col("theme").isin(*NOT_THEMES))
        themes = themes.where(F.col("theme_group") == theme_group) if theme_group else themes
        return docs.join(themes, "document_id"), F.col("theme"), F.first("theme")
    if by == "tag":
        return docs.join(c.tags, "document_id"), F.col("tag"), F.first("tag")
    key = F.year("effective_start_date").cast("string") if by == "year" else F.col(by)
    return docs, key, F.first(key)


def count_documents(c: Catalog, scope: Scope) -> DataFrame:
    return scope.apply(c).agg(F.count_distinct("document_id").alias("documents"))


def distribution(c: Catalog, scope: Scope, by: str, limit: int = 20, theme_group: str | None = None) -> DataFrame:
    """(value, documents) by bundle, author, theme, tag or year; nulls go only after the limit, as they take a place in it."""
    rows, key, label = _grouped(c, scope.apply(c), by, theme_group)
    rows = rows.withColumn("__k", key)
    counted = rows.groupBy("__k").agg(label.alias("value"), F.count_distinct("document_id").alias("documents"))
    top = counted.orderBy(F.desc("documents"), F.asc_nulls_first("__k")).limit(clamp(limit, 1, 100))
    return top.where(F.col("value").isNotNull()).select("value", "documents")


def cross_distribution(c: Catalog, scope: Scope, first: str, second: str, limit: int = 200) -> DataFrame:
    """(first_value, second_value, documents) of two different dimensions."""
    if first == second:
        raise ValueError("the two dimensions must differ")
    rows, k1, l1 = _grouped(c, scope.apply(c), first)
    rows = rows.withColumn("__k1", k1)
    rows, k2, l2 = _grouped(c, rows, second)
    rows = rows.withColumn("__k2", k2)
    counted = rows.groupBy("__k1", "__k2").agg(l1.alias("first_value"), l2.alias("second_value"), F.count_distinct("document_id").alias("documents"))
    top = counted.orderBy(F.desc("documents"), F.asc_nulls_first("__k1"), F.asc_nulls_first("__k2")).limit(clamp(limit, 1, 500))
    return top.where("first_value IS NOT NULL AND second_value IS NOT NULL").select("first_value", "second_value", "documents")


def count_distinct_values(c: Catalog, scope: Scope, by: str, approximate: bool = False) -> DataFrame:
    rows, key, _ = _grouped(c, scope.apply(c), by)
    return rows.agg((F.approx_count_distinct(key) if approximate else F.count_distinct(key)).alias("n_values"))


def distinct_values(c: Catalog, scope: Scope, by: str, limit: int = 1000) -> DataFrame:
    rows, key, _ = _grouped(c, scope.apply(c), by)
    return rows.select(key.alias("value")).where("value IS NOT NULL").distinct().orderBy("value").limit(limit)


def date_range(c: Catalog, scope: Scope) -> DataFrame:
    return scope.apply(c).agg(F.min("effective_start_date").alias("first_date"), F.max("effective_start_date").alias("last_date"))


def revision(c: Catalog) -> DataFrame:
    """A marker that changes with any indexing or removal."""
    return c.documents.agg(F.concat_ws("|", F.date_format(F.max("indexed_at"), "yyyy-MM-dd HH:mm:ss"), F.count("*").cast("string")).alias("revision"))


def theme_vocabulary(c: Catalog, limit: int = 500) -> DataFrame:
    """One row for each theme name: its tuple with most documents."""
    tuples = c.themes.where(~F.col("theme").isin(*NOT_THEMES)).groupBy("theme", "theme_type", "parent", "theme_group", "theme_path", "depth").agg(F.count_distinct("document_id").alias("documents"))
    order = Window.partitionBy("theme").orderBy(F.desc("documents"), F.asc_nulls_first("theme_type"), F.asc_nulls_first("parent"), F.asc_nulls_first("theme_path"))
    return tuples.withColumn("__rn", F.row_number().over(order)).where("__rn = 1").drop("__rn").orderBy(F.desc("documents"), "theme").limit(limit)


def list_documents(c: Catalog, scope: Scope, limit: int = 20, offset: int = 0) -> DataFrame:
    """Documents, those with more topic words first, then newest first, then by id."""
    d = scope.apply(c)
    hits = sum((F.when(contains_ci(F.col("title"), t), 1).otherwise(0) for t in scope.topic_terms), F.lit(0))
    d = d.withColumn("topic_hits", hits).orderBy(F.desc("topic_hits"), F.desc_nulls_last("effective_start_date"), "document_id")
    return d.offset(max(0, offset)).limit(clamp(limit, 1, 100))


def ids_in_scope(c: Catalog, scope: Scope, limit: int = 300, most: int = 300) -> DataFrame:
    d = scope.apply(c).select("document_id", "effective_start_date").distinct()
    return d.orderBy(F.desc_nulls_last("effective_start_date"), "document_id").limit(clamp(limit, 1, most))


def list_with_total(c: Catalog, scope: Scope, limit: int = 20) -> DataFrame:
    """A truncated list with the number of all documents beside it."""
    total = count_documents(c, scope).withColumnRenamed("documents", "total")
    return list_documents(c, scope, limit).select("document_id", "title").join(F.broadcast(total))


def by_content(c: Catalog, scope: Scope, enrichment: DataFrame) -> DataFrame:
    """Content-addressed abstracts of the documents in scope."""
    return scope.apply(c).select("document_id", "content_hash").join(enrichment, "content_hash").select("document_id", "abstract")


def attachments_of(c: Catalog, scope: Scope) -> DataFrame:
    """(document_id, files) with each document's files in order."""
    files = c.attachments.join(scope.apply(c), "document_id", "left_semi")
    return files.groupBy("document_id").agg(F.sort_array(F.collect_set("file_uuid")).alias("files"))


def orphaned_attachments(links: DataFrame, files: DataFrame, ignored_parents: DataFrame | None = None) -> DataFrame:
    """Files that no document (outside the ignored ones) links to."""
    if ignored_parents is not None:
        links = links.join(ignored_parents, "document_id", "left_anti")
    return files.select("file_uuid").distinct().join(links, "file_uuid", "left_anti")


def find_tag(c: Catalog, name: str) -> DataFrame:
    """The tag of that name, an exact match before one that differs in case."""
    return c.tags.select("tag").distinct().where(F.lower("tag") == name.lower()).orderBy((F.col("tag") != name).cast("int"), "tag").limit(1)


def theme_tree(c: Catalog) -> DataFrame:
    """Children of every parent: (theme_group, parent, children, documents)."""
    each = c.themes.where(F.col("parent").isNotNull()).groupBy("theme_group", "parent", "theme").agg(F.count_distinct("document_id").alias("n"))
    return each.groupBy("theme_group", "parent").agg(F.sort_array(F.collect_set("theme")).alias("children"), F.sum("n").alias("links"))


def classify_themes(names: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Names against a taxonomy (theme, parent, theme_group, theme_path, depth): unknown ones stand for themselves at depth 1."""
    known = taxonomy.withColumn("__k", F.lower("theme")).groupBy("__k").agg(F.min(F.struct("depth", "theme_path", "theme", "parent", "theme_group")).alias("t"))
    named = names.where(~F.col("name").isin(*NOT_THEMES)).withColumn("__k", F.lower(F.trim("name"))).join(known, "__k", "left")
    missing = F.col("t").isNull()
    return named.select(
        "name", F.when(missing, "unknown").when(F.col("t.depth") == 1, "main").otherwise("sub").alias("theme_type"), F.col("t.parent").alias("parent"), F.col("t.theme_group").alias("theme_group"),
        F.coalesce("t.theme_path", "name").alias("theme_path"), F.coalesce("t.depth", F.lit(1)).alias("depth"),
    )


def facet_duplicates(facet: DataFrame, keys: list[str]) -> DataFrame:
    return facet.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")
