"""Hybrid retrieval: filtered exact vector search, keyword and title legs, rank fusion, tolerance bands, dedup and packing.

The three scores of a candidate stay three columns: ``score`` (vector), ``fusion_score`` and ``semantic_score``. Queries are
rows of a table: each operator works for all of them at once, partitioned by query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EXCLUDED_SECTIONS = ("toc", "references", "glossary")
RRF_K = 60
NEAR_DUPLICATE = 0.92


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x))


def cosine(a: Column, b: Column) -> Column:
    """Exact cosine; 0 for empty vectors, different lengths or a zero norm."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    scale = norm(a) * norm(b)
    return F.when((F.size(a) == 0) | (F.size(a) != F.size(b)) | (scale == 0), 0.0).otherwise(dot / scale)


def retrievable(points: DataFrame, version: int | None = None) -> DataFrame:
    """Child passages of substantive sections; a missing section type passes."""
    ok = ~F.col("is_parent") & F.coalesce(~F.col("section_type").isin(*EXCLUDED_SECTIONS), F.lit(True))
    return points.where(ok & (F.col("doc_version") == version) if version is not None else ok)


#: queries in one pass over the points, and the most bytes of their vectors that a pass broadcasts
QUERIES_A_PASS, MOST_BYTES = 20_000, 64 * 1024 * 1024


def vector_top_k(queries: DataFrame, points: DataFrame, k: int, legs: Column | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank) of the k nearest points of every query, exact; with ``legs`` (an array of the legs a
    point belongs to) also leg, and the k nearest of every leg.

    Queries are a stated set. They are taken in passes by hash; a pass broadcasts the matrix of its queries, whose size is
    checked, and reads the points once for all legs. A task keeps its own k best for each query and leg, and one window merges
    them. Work is queries x points, memory is not. A zero vector scores 0; points without a vector are no candidates.
    """
    passes = max(1, -(-queries.count() // QUERIES_A_PASS))
    names = F.array(F.lit("")) if legs is None else legs.cast("array<string>")
    rows = points.where(F.col("embedding").isNotNull()).select("chunk_id", "embedding", names.alias("legs"))
    found = None
    for n in range(passes):
        one = _one_pass(queries.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == n), rows, k)
        found = one if found is None else found.unionByName(one)
    by = ["query_id"] if legs is None else ["leg", "query_id"]
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "chunk_id"))
    return (found.drop("leg") if legs is None else found).withColumn("rank", rank).where(F.col("rank") <= k)


def _unit(vectors: np.ndarray) -> np.ndarray:
    scale = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, scale, out=np.zeros_like(vectors), where=scale > 0)


def _one_pass(queries: DataFrame, points: DataFrame, k: int) -> DataFrame:
    asked = queries.where(F.col("embedding").isNotNull()).select("query_id", "embedding").toPandas()
    ids = asked["query_id"].to_numpy(dtype=np.int64)
    vectors = _unit(np.array(asked["embedding"].tolist(), dtype=np.float64).reshape(len(ids), -1))
    if vectors.nbytes > MOST_BYTES:
        raise ValueError(f"the vectors of one pass take {vectors.nbytes} bytes: lower QUERIES_A_PASS")
    shipped = points.sparkSession.sparkContext.broadcast((ids, vectors))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = shipped.value
        kept: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            if not len(ids):
                continue
            p = _unit(np.stack(batch["embedding"].to_numpy()).astype(np.float64))
            scores, chunk = q @ p.T, batch["chunk_id"].to_numpy()
            legs = batch["legs"].to_numpy()
            for leg in {x for row in legs for x in row}:
                at = np.fromiter((leg in row for row in legs), bool, len(legs))
                s, c = scores[:, at], np.broadcast_to(chunk[at], (len(ids), int(at.sum())))
                if leg in kept:
                    s, c = np.concatenate((kept[leg][0], s), axis=1), np.concatenate((kept[leg][1], c), axis=1)
                order = np.lexsort((c, -s), axis=1)[:, :k]
                kept[leg] = np.take_along_axis(s, order, axis=1), np.take_along_axis(c, order, axis=1)
        for leg, (s, c) in kept.items():
            yield pd.DataFrame({"leg": leg, "query_id": np.repeat(ids, s.shape[1]), "chunk_id": c.ravel(), "score": s.ravel()})

    return points.mapInPandas(best, "leg string, query_id long, chunk_id long, score double")


def top_k(points: DataFrame, query_vector: list[float], k: int) -> DataFrame:
    """One query: a cosine column and TakeOrderedAndProject."""
    q = F.array(*[F.lit(float(x)) for x in query_vector])
    return points.withColumn("score", cosine(F.col("embedding"), q)).orderBy(F.desc("score"), "chunk_id").limit(k)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), 0)


def matches_terms(text: Column, terms: list[str]) -> Column:
    """Any term whose words all occur in the text."""
    words = tokens(text)
    needed = [[w for w in t.lower().split() if w] for t in terms]
    return F.exists(F.array(*[F.array(*[F.lit(w) for w in n]) for n in needed]), lambda n: F.size(F.array_except(n, words)) == 0) if needed else F.lit(False)


def word_frequencies(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(word, documents): in how many documents each word stands."""
    return docs.select(doc_id, F.explode(F.array_distinct(tokens(F.col(text)))).alias("word")).groupBy("word").agg(F.count("*").alias("documents"))


def title_leg(questions: DataFrame, titles: DataFrame, k: int = 12, share: float = 0.10, rare_share: float = 0.01, floor: int = 25) -> DataFrame:
    """(query_id, doc_id, hits, rank): titles that share selective words with the question.

    A word is selective if at most ``share`` of the titles (never fewer than ``floor``) have it, rare at ``rare_share``; one
    hit is enough only if its word is rare. Plurals fold by a trailing s.
    """
    folded = lambda c: F.array_distinct(F.transform(tokens(c), lambda w: F.regexp_replace(w, "(?<=.{3})s$", "")))
    words = titles.select("doc_id", F.explode(folded(F.col("title"))).alias("word"))
    n = titles.agg(F.count("*").alias("n"))
    df = words.groupBy("word").agg(F.count("*").alias("df")).join(F.broadcast(n))
    df = df.where(F.col("df") <= F.greatest(F.lit(floor), share * F.col("n"))).select("word", (F.col("df") <= F.greatest(F.lit(floor), rare_share * F.col("n"))).alias("rare"))
    asked = questions.select("query_id", F.explode(folded(F.col("question"))).alias("word")).where(F.length("word") > 2).join(df, "word")
    hits = asked.join(words, "word").groupBy("query_id", "doc_id").agg(F.count("*").alias("hits"), F.max("rare").alias("rare")).where("hits >= 2 OR rare")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("hits"), "doc_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "doc_id", "hits", "rank")


def rrf(legs: list[DataFrame], key: str = "chunk_id", k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (query_id, key, rank) legs."""
    rows = legs[0].select("query_id", key, "rank")
    for leg in legs[1:]:
        rows = rows.unionByName(leg.select("query_id", key, "rank"))
    fused = rows.groupBy("query_id", key).agg(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("fusion_score"))
    return fused.withColumn("fused_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("fusion_score", 12)), key)))


def recency(value: Column, by: list[str]) -> Column:
    """Min-max scaled date inside the candidate set; unknown dates and a zero span are 0.5."""
    w = Window.partitionBy(*by)
    x = F.unix_timestamp(value.cast("timestamp")).cast("double")
    lo, hi = F.min(x).over(w), F.max(x).over(w)
    return F.when(x.isNull() | (hi == lo), 0.5).otherwise((x - lo) / (hi - lo))


def bands(values: DataFrame, by: list[str], item: str, value: str, tolerance: float) -> DataFrame:
    """(by, item, band): sorted downwards, a new band starts where the leader is more than ``tolerance`` above.

    A fold over the candidates of one query (some dozens), in one aggregate expression.
    """
    start = F.struct(F.lit(-1).alias("band"), F.lit(float("inf")).alias("leader"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fresh = (acc["band"] < 0) | (acc["leader"] - x["v"] > tolerance)
        band = F.when(fresh, acc["band"] + 1).otherwise(acc["band"])
        return F.struct(band.alias("band"), F.when(fresh, x["v"]).otherwise(acc["leader"]).alias("leader"), F.concat(acc["out"], F.array(band)).alias("out"))

    rows = values.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct((-F.col(value)).alias("neg"), F.col(value).alias("v"), F.col(item).alias("i")))).alias("s"))
    folded = rows.select(*by, "s", F.aggregate("s", start, step)["out"].alias("b"))
    return folded.select(*by, F.explode(F.arrays_zip("s", "b")).alias("z")).select(*by, F.col("z.s.i").alias(item), F.col("z.b").alias("band"))


def rank_key(candidates: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Final order of (query_id, chunk_id, score, authority, length, recency): relevance band, authority, completeness band, recency."""
    with_band = candidates.join(bands(candidates, ["query_id"], "chunk_id", "score", tolerance).withColumnRenamed("band", "relevance_band"), ["query_id", "chunk_id"])
    full = with_band.withColumn("completeness", F.log1p(F.col("length").cast("double")))
    nested = bands(full, ["query_id", "relevance_band", "authority"], "chunk_id", "completeness", float(np.log(1.5))).withColumnRenamed("band", "completeness_band")
    full = full.join(nested, ["query_id", "relevance_band", "authority", "chunk_id"])
    order = Window.partitionBy("query_id").orderBy("relevance_band", F.desc("authority"), "completeness_band", F.desc("recency"), F.desc("score"), "chunk_id")
    return full.withColumn("final_rank", F.row_number().over(order))


def pack_context(ranked: DataFrame, budget: int, limit: int, duplicate: float = NEAR_DUPLICATE) -> DataFrame:
    """Greedy context of every query, in rank order: skips what is over budget (the first always enters), what shares a parent
    with an admitted block, and what is a near duplicate of one. ``ranked``: query_id, chunk_id, parent_chunk_id, final_rank,
    n_tokens, embedding. One query's candidates are some dozens, so a query is folded in one Arrow group."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["final_rank", "chunk_id"])
        used, parents, vectors, rows = 0, set(), [], []
        for r in pdf.itertuples():
            if len(rows) >= limit:
                break
            parent = r.parent_chunk_id if r.parent_chunk_id is not None and r.parent_chunk_id == r.parent_chunk_id else r.chunk_id
            if parent in parents:
                continue
            v = np.asarray(r.embedding, dtype=np.float64)
            n = np.linalg.norm(v)
            v = v / n if n else v
            parents.add(parent)  # the parent is taken even where the block turns out a duplicate
            if any(float(v @ u) >= duplicate for u in vectors):
                continue
            if rows and used + r.n_tokens > budget:
                continue
            used += int(r.n_tokens)
            vectors.append(v)
            rows.append((r.query_id, len(rows) + 1, r.chunk_id, int(r.n_tokens), used))
        return pd.DataFrame(rows, columns=["query_id", "n", "chunk_id", "n_tokens", "used_tokens"])

    return ranked.groupBy("query_id").applyInPandas(fold, "query_id long, n long, chunk_id long, n_tokens long, used_tokens long")


def attention_order(rank: Column, total: Column) -> Column:
    """Position that puts the best at both ends: odd ranks forward, even ranks backward."""
    return F.when(total <= 2, rank).when(rank % 2 == 1, (rank + 1) / 2).otherwise(total - rank / 2 + 1).cast("long")


def quality(judged: DataFrame, ranked: DataFrame, k: int = 10) -> DataFrame:
    """Mean recall@k, reciprocal rank and nDCG of rankings (query_id, item, rank) under judgments (query_id, item, grade)."""
    gain = lambda g, r: g / F.log2(r + 1.0)
    hits = ranked.where(F.col("rank") <= k).join(judged, ["query_id", "item"]).groupBy("query_id").agg(F.count_if(F.col("grade") > 0).alias("found"), F.min(F.when(F.col("grade") > 0, F.col("rank"))).alias("first"), F.sum(gain(F.col("grade"), F.col("rank"))).alias("dcg"))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "item"))
    ideal = judged.withColumn("r", order).groupBy("query_id").agg(F.count_if(F.col("grade") > 0).alias("relevant"), F.sum(F.when(F.col("r") <= k, gain(F.col("grade"), F.col("r")))).alias("idcg"))
    each = ideal.join(hits, "query_id", "left").where("relevant > 0")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return each.agg(F.avg(zero(F.col("found") / F.least(F.col("relevant"), F.lit(k)))).alias("recall"), F.avg(zero(1 / F.col("first"))).alias("mrr"), F.avg(zero(F.col("dcg") / F.col("idcg"))).alias("ndcg"), F.count("*").alias("queries"))
