"""Retrieval for a table of questions: dense and lexical lists of every query variant, fused and collapsed to pages."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import bm25, fusion, vector


@dataclass(frozen=True)
class Retrieval:
    mode: str = "hybrid"
    k: int = 8
    rrf_k: int = 60
    vector_candidates: int = 40
    bm25_candidates: int = 40
    metric: str = "l2"
    tag: str = ""
    document_id: str = ""

    def __post_init__(self) -> None:
        if self.mode not in ("hybrid", "vector", "bm25") or self.metric not in vector.METRICS or self.k < 1:
            raise ValueError("bad retrieval settings")

    def keep(self) -> Column | None:
        """The condition on chunks by tag and document; blank ones filter nothing."""
        wanted = [T.strip(F.coalesce(F.col(c).cast("string"), F.lit(""))) == F.lit(v.strip()) for c, v in (("tag", self.tag), ("document_id", self.document_id)) if v.strip()]
        return reduce(lambda a, b: a & b, wanted) if wanted else None


def retrieval_queries(questions: DataFrame) -> DataFrame:
    """(query_id, list_no, query) from (query_id, question, variants, previous[, rewritten]): question, variants, the
    rewritten question and the contextual query, trimmed, not blank, once each."""
    context = F.when(F.col("previous").isNotNull(), T.contextual("previous", T.strip("question")))
    rewritten = F.col("rewritten") if "rewritten" in questions.columns else F.lit(None).cast("string")
    queries = F.concat(F.array("question"), F.coalesce("variants", F.array().cast("array<string>")), F.array(rewritten), F.array(context))
    kept = F.array_distinct(F.filter(F.transform(F.filter(queries, lambda q: q.isNotNull()), T.strip), lambda q: q != ""))
    return questions.select("query_id", F.posexplode(kept).alias("list_no", "query"))


def instructed(queries: DataFrame, embed: Callable[[DataFrame], DataFrame], instruction: str | None) -> DataFrame:
    """Queries with ``embedding``, that of the query under the instruction; the query itself stays as it is."""
    told = embed(queries.withColumn("__plain", F.col("query")).withColumn("query", T.instructed("query", instruction)))
    return told.withColumn("query", F.col("__plain")).drop("__plain")


def merged_at() -> Column:
    """The time at which a task hands on a row, in microseconds: a column for rows that come out of ``retrieve``, which makes
    the pages of one question after those of another. Its clock is that of the task's machine."""
    return F.unix_micros(F.expr("reflect('java.time.Instant', 'now')").cast("timestamp"))


def retrieve(queries: DataFrame, chunks: DataFrame, how: Retrieval = Retrieval(), index: DataFrame | None = None, variants: int | None = None) -> DataFrame:
    """Pages for queries (query_id, list_no, query[, embedding]); chunks (chunk_index, document_id, page_start, text[,
    embedding, tag]). All lists of all questions are one search of either kind. Contextual queries stay out of the
    lexical search. The filter by tag and document is applied to vectors before their distances, and to lexical hits
    after their ranking. ``index``: written postings of the chunks. ``variants``: only so many lists of a question."""
    keep, lists = how.keep(), []
    queries = queries if variants is None else queries.filter(F.col("list_no") < variants)
    if how.mode != "bm25":
        found = vector.nearest(queries, chunks if keep is None else chunks.filter(keep), how.vector_candidates, how.metric, ["query_id", "list_no"], "chunk_index")
        lists.append(fusion.hits(found, "vector", F.col("list_no"), "chunk_index"))
    if how.mode != "vector":
        found = bm25.search(queries.filter(~T.is_contextual("query")), chunks, how.bm25_candidates, ["query_id", "list_no"], keep=keep, index=index, placed=False)
        lists.append(fusion.hits(found, "bm25", F.col("list_no"), "chunk_index"))
    merged = reduce(DataFrame.unionByName, lists)
    fused = fusion.reciprocal_rank_fusion(merged, how.rrf_k, fusion.candidate_limit(how.k, how.vector_candidates, how.bm25_candidates))
    payload = chunks.select(F.col("chunk_index").alias("key"), "document_id", "page_start")
    return fusion.collapse_to_pages(fused.join(payload, "key"), how.k)
