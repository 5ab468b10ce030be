"""Merging of ranked lists, and their collapse to pages.

A list is (query_id, source 'vector' or 'bm25', list_no, rank, key) with ``distance`` or ``score``; ranks count from 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import text as T

RRF_K, FAR = 60, 1_000_000_000
DIGITS = 12


def hits(found: DataFrame, source: str, list_no: int | Column, key: str, query_id: str = "query_id") -> DataFrame:
    """A search's result as a list, or as the lists that a column numbers."""
    distance = F.col("distance") if "distance" in found.columns else F.lit(None).cast("double")
    score = F.col("score") if "score" in found.columns else F.lit(None).cast("double")
    return found.select(F.col(query_id).alias("query_id"), F.lit(source).alias("source"), (F.lit(list_no) if isinstance(list_no, int) else list_no).alias("list_no"), "rank", F.col(key).alias("key"), distance.alias("distance"), score.alias("score"))


def reciprocal_rank_fusion(lists: DataFrame, rrf_k: int = RRF_K, limit: int | None = None) -> DataFrame:
    """One row for each (query, key): the sum of ``1 / (rrf_k + rank)`` over its lists (its first place in each), the best
    rank of each source, the best vector score with its distance (the first list's, of equals), the best BM25 score, the
    sources, and the fused rank: by score, vector rank, BM25 rank and key."""
    once = lists.groupBy("query_id", "source", "list_no", "key").agg(F.min("rank").alias("rank"), F.min_by("distance", "rank").alias("distance"), F.max("score").alias("score"))
    at = F.struct(F.col("source") != "vector", F.col("list_no"))
    vector = F.when(F.col("source") == "vector", T.vector_score("distance"))
    merged = once.withColumn("vs", vector).groupBy("query_id", "key").agg(
        F.round(F.sum(1 / (F.lit(rrf_k) + F.col("rank"))), DIGITS).alias("rrf_score"),
        F.min(F.when(F.col("source") == "vector", F.col("rank"))).alias("vector_rank"),
        F.min(F.when(F.col("source") == "bm25", F.col("rank"))).alias("bm25_rank"),
        F.max("vs").alias("vector_score"),
        F.min_by("distance", F.when(F.col("vs").isNotNull(), F.struct(-F.col("vs"), at))).alias("distance"),
        F.max("score").alias("bm25_score"),
        F.sort_array(F.collect_set("source"), asc=False).alias("sources"),
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), F.coalesce("vector_rank", F.lit(FAR)), F.coalesce("bm25_rank", F.lit(FAR)), "key")
    ranked = merged.withColumn("rank", F.row_number().over(order))
    return ranked if limit is None else ranked.filter(F.col("rank") <= limit)


def distance_merge(lists: DataFrame, k: int) -> DataFrame:
    """The least (distance, rank) of each key over vector lists; a missing distance is infinite; the first seen of equals."""
    far = F.coalesce("distance", F.lit(float("inf")))
    best = lists.groupBy("query_id", "key").agg(F.min(F.struct(far.alias("distance"), "rank", "list_no")).alias("best"))
    order = Window.partitionBy("query_id").orderBy("best.distance", "best.rank", "best.list_no", "key")
    out = best.withColumn("merged_rank", F.row_number().over(order)).filter(F.col("merged_rank") <= k)
    return out.select("query_id", "key", F.col("best.distance").alias("distance"), "merged_rank")


def collapse_to_pages(ranked: DataFrame, k: int, document: str = "document_id", page: str = "page_start") -> DataFrame:
    """The first hit of each (document, page), ranked again; k pages."""
    if k < 1:
        raise ValueError("k must be at least 1")
    doc, number = F.coalesce(F.col(document).cast("string"), F.lit("")), F.coalesce(F.col(page), F.lit(0))
    first = F.row_number().over(Window.partitionBy("query_id", doc, number).orderBy("rank"))
    kept = ranked.withColumn("__first", first).filter("__first = 1").drop("__first")
    return kept.withColumn("page_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).filter(F.col("page_rank") <= k)


def candidate_limit(k: int, vector_candidates: int = 40, bm25_candidates: int = 40) -> int:
    """How many fused hits go on to the collapse, which may leave fewer than k pages."""
    return max(4 * k, vector_candidates, bm25_candidates)
