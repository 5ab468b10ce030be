"""The queries of the retrieval engine over the driver's tables, each over whole tables.

``documents`` stand for one-page documents (tag: language), ``conversations`` for documents of several pages (a page for
each turn) and chat histories, ``benchmark`` for questions, ``embeddings`` for vectors (tag: label). Searches by vector
take every vector whose id is divisible by 20 as a query; retrieval evaluation takes the user turns of the conversations
whose id is divisible by 20 as questions and the assistant turns of the same conversation as the expected pages.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright import edges, evaluation
from pagewright.config import EvaluationConfig
from pagewright.functions import text as T
from pagewright.operators import ask, assemble, bm25, chunking, extraction, fusion, metrics, pages, quality, retrieve, vector, viewer
from pagewright.operators.numbering import numbered
from pagewright.sources import files, store
from pagewright.sources.shared import shared_folder, stored
from pagewright.streaming.live import LiveIndex

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("chunk_index"), F.col("doc_id").cast("string").alias("document_id"), F.lit(1).alias("page_start"), F.col("lang").alias("tag"), "source", "text")


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _turns(spark: SparkSession, d: str) -> DataFrame:
    """Conversation pages as chunks, two turns a page; chunk_index orders by conversation and turn."""
    t = table(spark, d, "conversations")
    return t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("chunk_index"), F.col("conv_id").cast("string").alias("document_id"), F.floor(F.col("turn") / 2 + 1).cast("int").alias("page_start"), "text", "role", "conv_id", "turn")


def _vector_queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _variant(n: int) -> F.Column:
    """The question's whole text, its first eight words, its last eight words."""
    words = F.split(T.collapse("query"), " ")
    return [F.col("query"), F.array_join(F.slice(words, 1, 8), " "), F.array_join(F.slice(words, F.greatest(F.size(words) - 7, F.lit(1)), 8), " ")][n]


def _knn(metric: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = vector.nearest(_vector_queries(spark, d), table(spark, d, "embeddings"), 40, metric)
        return out.withColumn("distance", F.round("distance", 6) + F.lit(0.0))

    return run


for _m in vector.METRICS:
    QUERIES[f"knn_{_m}"] = _knn(_m)


@query
def knn_tag_filter(spark, d):
    out = vector.nearest(_vector_queries(spark, d), table(spark, d, "embeddings").filter("label = 3"), 40, "cosine")
    return out.withColumn("distance", F.round("distance", 6) + F.lit(0.0))


@query
def knn_pivots(spark, d):
    """The nearest vectors of knn_l2, over a written index of cells that are skipped where they can't hold one."""
    folder = shared_folder(spark)
    vector.write_cells(table(spark, d, "embeddings"), folder, "l2")
    out, _ = vector.nearest_in_cells(_vector_queries(spark, d), folder, 40)
    return out.withColumn("distance", F.round("distance", 6) + F.lit(0.0))


@query
def token_count(spark, d):
    return table(spark, d, "documents").select("doc_id", T.token_count("text").cast("long").alias("tokens"))


@query
def bm25_terms(spark, d):
    terms = table(spark, d, "documents").select(F.explode(T.bm25_terms("text")).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("occurrences"))


@query
def shorten_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.shorten("text", 220).alias("short"), T.shorten("text", 120, True).alias("label"))


@query
def md_completeness(spark, d):
    return table(spark, d, "documents").select("doc_id", T.completeness_issue("text").alias("issue"))


@query
def sha_ids(spark, d):
    path = F.concat(F.lit("/docs/"), F.col("lang"), F.lit("/Doc"), F.col("doc_id").cast("string"), F.lit(".md"))
    return table(spark, d, "documents").select("doc_id", F.sha2(F.col("text"), 256).alias("source_sha256"), T.document_id(path).alias("document_id"), T.question_hash("text").alias("question_hash"))


@query
def bm25_topk(spark, d):
    return bm25.search(_questions(spark, d), _chunks(spark, d), 40).select("query_id", "chunk_index", "rank", F.round("score", 6).alias("score"))


@query
def bm25_idf(spark, d):
    return bm25.term_stats(_chunks(spark, d), "chunk_index").select("term", "df", F.round("idf", 6).alias("idf"))


@query
def bm25_tag_postfilter(spark, d):
    out = bm25.search(_questions(spark, d), _chunks(spark, d), 40, keep=F.col("tag") == "de")
    return out.select("query_id", "chunk_index", "store_rank", "rank", F.round("score", 6).alias("score"))


def _lexical_list(spark, d) -> DataFrame:
    return fusion.hits(bm25.search(_questions(spark, d), _chunks(spark, d), 40), "bm25", 0, "chunk_index")


@query
def rrf_multi_query(spark, d):
    asked = _questions(spark, d).select("query_id", F.posexplode(F.array(*[_variant(n) for n in range(3)])).alias("list_no", "query"))
    lists = fusion.hits(bm25.search(asked, _chunks(spark, d), 40, ["query_id", "list_no"]), "bm25", F.col("list_no"), "chunk_index")
    out = fusion.reciprocal_rank_fusion(lists, limit=20)
    return out.select("query_id", "key", F.round("rrf_score", 9).alias("rrf_score"), "bm25_rank", F.round("bm25_score", 6).alias("bm25_score"), "rank")


def _item_vectors(spark, d, shift: int = 0) -> DataFrame:
    v = table(spark, d, "embeddings").select((F.col("vec_id") - shift).alias("query_id"), "embedding")
    return _questions(spark, d).join(v, "query_id")


@query
def rrf_hybrid(spark, d):
    dense = vector.nearest(_item_vectors(spark, d), table(spark, d, "embeddings"), 40, "cosine")
    lists = fusion.hits(dense, "vector", 0, "vec_id").unionByName(_lexical_list(spark, d))
    out = fusion.reciprocal_rank_fusion(lists, limit=40)
    return out.select("query_id", "key", F.round("rrf_score", 9).alias("rrf_score"), F.col("vector_rank").cast("double").alias("vector_rank"), F.col("bm25_rank").cast("double").alias("bm25_rank"), F.round("distance", 6).alias("distance"), F.array_join("sources", ",").alias("sources"), "rank")


@query
def distance_merge(spark, d):
    vectors = table(spark, d, "embeddings")
    lists = [fusion.hits(vector.nearest(_item_vectors(spark, d, n), vectors, 40, "l2"), "vector", n, "vec_id") for n in (0, 1)]
    out = fusion.distance_merge(lists[0].unionByName(lists[1]), 40)
    return out.withColumn("distance", F.round("distance", 6) + F.lit(0.0))


def _turn_hits(spark, d, k: int) -> DataFrame:
    turns = _turns(spark, d)
    found = bm25.search(_questions(spark, d), turns, k)
    return found.join(turns.select("chunk_index", "document_id", "page_start"), "chunk_index")


@query
def page_collapse(spark, d):
    out = fusion.collapse_to_pages(_turn_hits(spark, d, 40), 8)
    return out.select("query_id", "document_id", "page_start", "chunk_index", "page_rank")


@query
def candidate_limit(spark, d):
    """The fused list is cut before it is collapsed: a small cut leaves fewer than k pages."""
    fused = fusion.reciprocal_rank_fusion(fusion.hits(_turn_hits(spark, d, 40), "bm25", 0, "chunk_index"), limit=fusion.candidate_limit(2, 10, 10))
    payload = _turns(spark, d).select(F.col("chunk_index").alias("key"), "document_id", "page_start")
    out = fusion.collapse_to_pages(fused.join(payload, "key"), 10)
    return out.groupBy("query_id").agg(F.count("*").alias("pages"), F.max("rank").alias("last_rank"))


def _retrieved(spark, d, how: retrieve.Retrieval) -> DataFrame:
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_index"), "embedding")
    chunks = _chunks(spark, d).join(vectors, "chunk_index", "left")
    queries = retrieve.retrieval_queries(_questions(spark, d).select("query_id", F.col("query").alias("question"), F.array(_variant(1)).alias("variants"), F.lit(None).cast("string").alias("previous")))
    out = retrieve.retrieve(queries.join(_item_vectors(spark, d).select("query_id", "embedding"), "query_id"), chunks, how)
    return out.select("query_id", "document_id", "page_start", "page_rank", F.round("rrf_score", 9).alias("rrf_score"))


@query
def retrieve_hybrid(spark, d):
    return _retrieved(spark, d, retrieve.Retrieval(k=8))


def _conversation_pages(spark, d) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", (F.col("turn") + 1).cast("int").alias("page_number"), F.col("text").alias("markdown"))


@query
def pages_join(spark, d):
    return pages.join_pages(_conversation_pages(spark, d), "conv_id")


@query
def page_split(spark, d):
    return pages.split_pages(pages.join_pages(_conversation_pages(spark, d), "conv_id"))


@query
def context_window4(spark, d):
    out = pages.context_windows(_conversation_pages(spark, d), "conv_id", "page_number")
    return out.withColumn("context", F.array_join("context", ","))


def _document_pages(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.sha2("text", 256).alias("source_sha256"), F.lit(1).alias("page_number"), F.col("text").alias("markdown"))


@query
def chunk_pages(spark, d):
    return chunking.chunk_pages(_document_pages(spark, d))


@query
def chunk_index_global(spark, d):
    return numbered(_conversation_pages(spark, d).select("conv_id", "page_number"), "conv_id", "page_number")


def _eval_questions(spark, d) -> DataFrame:
    return table(spark, d, "conversations").filter("conv_id % 20 = 0 and role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "conv_id", F.col("text").alias("query"))


def _expected(spark, d) -> DataFrame:
    answers = table(spark, d, "conversations").filter("role = 'assistant'").select("conv_id", (F.col("turn") + 1).cast("int").alias("page"))
    return _eval_questions(spark, d).join(answers, "conv_id").select("query_id", F.col("conv_id").cast("string").alias("document_id"), "page")


def _scored(spark, d) -> DataFrame:
    chunks = _turns(spark, d)
    found = bm25.search(_eval_questions(spark, d), chunks, 5).join(chunks.select("chunk_index", "document_id", (F.col("turn") + 1).cast("int").alias("page")), "chunk_index")
    expected = _expected(spark, d)
    answerable = _eval_questions(spark, d).join(expected.select("query_id").distinct(), "query_id", "left_semi")
    return metrics.score_retrieval(answerable, expected, found, 5)


@query
def score_retrieval(spark, d):
    return _scored(spark, d).withColumn("first_relevant_rank", F.col("first_relevant_rank").cast("double"))


@query
def aggregate_metrics(spark, d):
    latency = _scored(spark, d).withColumn("latency_ms", (F.col("query_id") % 997).cast("double")).withColumn("error", F.lit(""))
    return metrics.aggregate_metrics(latency)


@query
def latency_percentiles(spark, d):
    rows = table(spark, d, "events")
    means = rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))
    p95 = metrics.discrete_percentile(rows, ["event_type"], "value", 0.95).select("event_type", F.col("percentile").alias("p95_value"))
    return means.join(p95, "event_type", "left")


def _question_table(spark, d) -> tuple[DataFrame, DataFrame]:
    """The user turns of all conversations as questions, and the assistant's turns of the same one as their pages."""
    t = table(spark, d, "conversations")
    q = t.filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "conv_id", F.col("text").alias("question"), F.lit(True).alias("active"))
    answers = t.filter("role = 'assistant'").select("conv_id", (F.col("turn") + 1).cast("int").alias("page"))
    name = F.concat(F.lit("c"), F.col("conv_id").cast("string"))
    p = q.join(answers, "conv_id").select(F.col("id").alias("question_id"), F.col("conv_id").cast("string").alias("document_id"), name.alias("source"), F.concat(F.lit("/"), name).alias("source_path"), "page", F.lit("").alias("reference_text"))
    return q.drop("conv_id"), p


@query
def questions_with_pages(spark, d):
    out = store.questions_with_pages(*_question_table(spark, d))
    return out.select("id", "question", F.array_join(F.transform("pages", lambda x: F.concat(x["document_id"], F.lit(":"), x["page"].cast("string"), F.lit(":"), x["source_path"])), ",").alias("pages"))


@query
def active_dataset_hash(spark, d):
    items = store.dataset_items(*_question_table(spark, d))
    return items.select("id", F.sha2("item", 256).alias("item_sha256"))


@query
def dataset_hash(spark, d):
    return store.dataset_hash(*_question_table(spark, d))


@query
def unique_name_antijoin(spark, d):
    taken = table(spark, d, "documents").filter("lang = 'en'").select(F.col("source").alias("name")).distinct()
    wanted = table(spark, d, "documents").select(F.concat(F.upper("source"), F.when(F.col("lang") == "en", F.lit(" ")).otherwise(F.concat(F.lit("-"), F.col("lang")))).alias("name")).distinct()
    return store.new_names(wanted, taken)


@query
def variants_upsert(spark, d):
    t = table(spark, d, "conversations")
    rows = t.select(F.sha2(F.col("role"), 256).alias("question_sha256"), F.col("turn").cast("string").alias("prompt_version"), F.col("text").alias("variants"), F.col("conv_id").alias("created_at"))
    return store.latest(rows, ["question_sha256", "prompt_version"], "created_at")


@query
def delete_cascade(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("evaluation_id"), F.col("l_linenumber").cast("long").alias("line"))
    gone = orders.filter("status = 'F'").select("id")
    _, left = store.without(orders, lines, gone, "id", "evaluation_id")
    return left.groupBy("evaluation_id").agg(F.count("*").alias("results"))


@query
def results_csv_rows(spark, d):
    found = bm25.search(_eval_questions(spark, d), _turns(spark, d), 5).join(_turns(spark, d).select("chunk_index", "document_id", (F.col("turn") + 1).cast("int").alias("page")), "chunk_index")
    page = lambda n: F.struct(F.concat(F.lit("c"), F.col("document_id")).alias("source"), "page", F.col(n).alias("n"))
    listed = lambda rows, n, name: rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(n, page(n).alias("p")))).alias(name)).select("query_id", F.transform(name, lambda x: x["p"]).alias(name))
    scored = _scored(spark, d)
    metric = F.struct(*[c for c in scored.columns if c != "query_id"]).alias("metrics")
    rows = scored.select("query_id", metric).join(listed(_expected(spark, d).distinct(), "page", "expected"), "query_id").join(listed(found, "rank", "retrieved"), "query_id", "left").join(_eval_questions(spark, d).select("query_id", F.col("query").alias("question")), "query_id")
    rows = rows.withColumn("retrieved", F.coalesce("retrieved", F.array().cast(rows.schema["retrieved"].dataType)))
    out = store.csv_rows(rows.select(F.col("query_id").alias("question_id"), "question", "expected", "retrieved", "metrics", (F.col("query_id") % 997).cast("double").alias("latency_ms"), F.lit(None).cast("string").alias("error")))
    return out.withColumn("posición_primer_relevante", F.col("posición_primer_relevante").cast("double"))


@query
def query_build_contextual(spark, d):
    return assemble.contextual_queries(table(spark, d, "conversations"), "conv_id", "turn", content="text")


@query
def normalize_messages(spark, d):
    return assemble.normal_messages(table(spark, d, "conversations"), content="text").select("conv_id", "turn", "role", "text")


def _cited(spark, d) -> DataFrame:
    chunks = _chunks(spark, d)
    top = bm25.search(_questions(spark, d), chunks, 8).join(chunks.select("chunk_index", "source", "text", "page_start"), "chunk_index")
    return assemble.with_source_ids(top, "rank")


@query
def context_blocks(spark, d):
    return assemble.contexts(_cited(spark, d), "source", "page_start", "text", "rank").select("query_id", F.sha2("context", 256).alias("context_sha256"), F.length("context").cast("long").alias("n_chars"))


@query
def citations_semi(spark, d):
    used = _questions(spark, d).select("query_id", F.explode(T.source_ids(F.concat(F.lit("As S1 and S3 say, S1"), F.lit(" S"), (F.col("query_id") % 9).cast("string")))).alias("source_id"))
    return assemble.used_citations(_cited(spark, d).select("query_id", "source_id", "chunk_index"), used)


@query
def grounded_answer(spark, d):
    cited = F.filter(T.source_ids("text"), lambda x: x.isin("S1", "S2", "S3"))
    answers = table(spark, d, "conversations").withColumn("text", F.when(F.col("turn") % 3 == 0, F.concat(F.col("text"), F.lit(" [S"), F.col("turn").cast("string"), F.lit("]"))).otherwise(F.col("text")))
    return answers.select("conv_id", "turn", T.grounded("text", cited).alias("answer"))


@query
def parse_source_ids(spark, d):
    text = F.when(F.col("turn") % 2 == 0, F.concat(F.lit('Sure: {"used_source_ids": ["S'), F.col("turn").cast("string"), F.lit('", " S2 ", "S2"]}'))).otherwise(F.concat(F.lit("see S"), F.col("turn").cast("string"), F.lit(", S9 and S9: "), F.col("role")))
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(T.source_ids(text), ",").alias("ids"))


@query
def parse_variants(spark, d):
    bullets = F.concat(F.lit("- "), F.col("query"), F.lit("\n1. "), _variant(1), F.lit("\n* "), F.upper(_variant(1)), F.lit("\n- "), _variant(2))
    return _questions(spark, d).select("query_id", F.array_join(T.query_variants(bullets, "query"), "|").alias("variants"))


@query
def reference_coverage(spark, d):
    """A page against itself without every third line, as an extraction that loses lines would be."""
    kept = F.filter(F.split("text", "\n"), lambda x, i: i % 3 != 2)
    rows = table(spark, d, "documents").select("doc_id", F.col("text").alias("reference"), F.array_join(kept, "\n").alias("markdown"))
    return quality.reference_coverage(rows, ["doc_id"], "reference", "markdown").select("doc_id", "tokens", "found", "coverage", "issue")


def _cache(spark, d) -> DataFrame:
    t = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list((F.col("turn") + 1).cast("int"))).alias("page_numbers"))
    total = F.size("page_numbers") + F.when(F.col("conv_id") % 3 == 0, 1).otherwise(0)
    return t.select("conv_id", F.sha2(F.col("conv_id").cast("string"), 256).alias("source_sha256"), F.lit("m").alias("parser_model"), F.when(F.col("conv_id") % 5 == 0, "v1").otherwise("v2").alias("prompt_version"), F.lit(4).alias("context_pages"), "page_numbers", total.alias("total_pages"), (F.col("conv_id") % 3 != 0).alias("complete"))


@query
def cache_pending_antijoin(spark, d):
    sources = _cache(spark, d).select("conv_id", "source_sha256", "parser_model", F.lit("v2").alias("prompt_version"), "context_pages")
    return quality.pending_sources(sources, _cache(spark, d)).select("conv_id")


@query
def cache_prefix_resume(spark, d):
    return quality.resumable(_cache(spark, d)).select("conv_id", F.col("next_page").cast("long").alias("next_page"))


@query
def viewer_filter(spark, d):
    rows = viewer.apply_filters(_chunks(spark, d), {"tag": ["en", "de"], "source": []}, "  THE and ", ["text", "source"])
    return rows.select("chunk_index", "tag")


@query
def viewer_search(spark, d):
    """The rows of viewer_filter, by an index of grams."""
    folder = shared_folder(spark)
    viewer.write_grams(_chunks(spark, d), folder, "chunk_index", ["text", "source"])
    return viewer.found_rows(spark, folder, {"tag": ["en", "de"], "source": []}, "  THE and ").select("chunk_index", "tag")


@query
def viewer_page(spark, d):
    return viewer.page_of(_chunks(spark, d).select("chunk_index", "tag", "source"), 3, 25, "chunk_index")


@query
def facets(spark, d):
    return viewer.facets(_chunks(spark, d), ["source", "tag"])


@query
def document_options(spark, d):
    t = _turns(spark, d).select("document_id", "chunk_index", F.col("role").alias("tag"), F.lit("conversation").alias("source"), F.concat(F.lit("c/"), F.col("document_id")).alias("source_path"))
    return viewer.document_options(t)


@query
def expected_chunks(spark, d):
    """Reference text of each page: its chunks in order, parted by blank lines."""
    t = _turns(spark, d)
    parts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    out = t.groupBy("document_id", "page_start").agg(parts.alias("p"))
    return out.select("document_id", "page_start", F.sha2(F.array_join(F.transform("p", lambda x: x["text"]), "\n\n"), 256).alias("text_sha256"))


@query
def bm25_index_topk(spark, d):
    """The same search over a written index, whose blocks are skipped where they can't reach the top."""
    folder = shared_folder(spark)
    bm25.write_index(_chunks(spark, d), folder)
    out, _ = bm25.top_k(_questions(spark, d), folder, 40)
    return out.select("query_id", "chunk_index", "rank", F.round("score", 6).alias("score"))


@query
def retrieve_tagged(spark, d):
    """Hybrid retrieval inside one tag: vectors are filtered before their distances, lexical hits after their ranking."""
    return _retrieved(spark, d, retrieve.Retrieval(k=8, tag=" de "))


@query
def retrieval_query_list(spark, d):
    users = table(spark, d, "conversations").filter("role = 'user'")
    previous = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    asked = users.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("question"), F.array(F.concat(F.lit("x "), F.col("text")), F.concat(F.lit(" "), F.col("text"))).alias("variants"), previous.alias("previous"), F.lower("text").alias("rewritten"))
    return retrieve.retrieval_queries(asked)


@query
def instructed_queries(spark, d):
    return _questions(spark, d).select("query_id", T.instructed("query", " Find the page that answers ").alias("query"), T.instructed("query", " ").alias("plain"))


def _pages_with_scores(spark, d) -> DataFrame:
    """Eight pages for each question, every other one with a fused lexical score of 0."""
    found = fusion.collapse_to_pages(_turn_hits(spark, d, 40), 8)
    raw = F.round("score", 6)
    return found.select("query_id", "page_rank", "rank", "chunk_index", "document_id", "page_start", raw.alias("bm25_raw_score"), F.when(F.col("rank") % 2 == 0, 0.0).otherwise(raw).alias("bm25_score"), F.array(F.lit("bm25")).alias("sources"), F.concat(F.lit("c"), F.col("document_id")).alias("source"), F.lit("").alias("tag"), F.concat(F.lit("t"), F.col("chunk_index")).alias("text"))


@query
def serialized_matches(spark, d):
    return assemble.serialized(_pages_with_scores(spark, d)).withColumn("retrieval_sources", F.array_join("retrieval_sources", ","))


@query
def matches_json(spark, d):
    return assemble.gathered_matches(_pages_with_scores(spark, d))


@query
def source_options(spark, d):
    return assemble.source_options(_pages_with_scores(spark, d))


@query
def used_source_ids(spark, d):
    text = F.concat(F.lit('{"used_source_ids": ["S9", "S'), F.col("turn").cast("string"), F.lit('", "S2", "S2"]}'))
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(T.used_ids(text, F.array(F.lit("S1"), F.lit("S2"), F.lit("S4"))), ",").alias("ids"))


@query
def truncated_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.truncated("text").alias("text"))


@query
def response_markdown(spark, d):
    value = F.when(F.col("doc_id") % 4 == 0, F.lit("5")).when(F.col("doc_id") % 4 == 1, F.lit('"  "')).otherwise(F.concat(F.lit('" &quot;'), F.col("source"), F.lit('&quot; ** "')))
    raw = F.concat(F.lit('Here: {"markdown": '), value, F.lit("} done"))
    stop = F.when(F.col("doc_id") % 7 == 0, "max_tokens").otherwise("end_turn")
    return table(spark, d, "documents").select("doc_id", T.response_markdown(raw).alias("markdown"), quality.accepted(F.replace(raw, F.lit(" **"), F.lit("")), stop).alias("accepted"))


@query
def tag_choice(spark, d):
    tag = F.when(F.col("doc_id") % 3 == 0, F.lit(" ")).otherwise(F.col("lang"))
    return table(spark, d, "documents").select("doc_id", T.tag_filter(tag, F.array(F.lit(" "), F.concat(F.lit(" "), F.col("source")))).alias("tag"))


@query
def vector_scores(spark, d):
    distance = F.when(F.col("label") != 9, (F.col("label") - 3).cast("double"))
    return table(spark, d, "embeddings").select("vec_id", F.round(T.vector_score(distance), 9).alias("score"))


@query
def viewer_rows(spark, d):
    rows = _chunks(spark, d).select("source", F.lit("md").alias("source_type"), "tag", "page_start", F.lit(0).alias("page_chunk_index"), T.token_count("text").cast("long").alias("token_count"), F.lit("direct-markdown").alias("parser_model"), F.concat(F.lit("/"), F.col("document_id")).alias("source_path"), "text")
    return viewer.table_rows(rows)


@query
def hit_diagnostics(spark, d):
    out = viewer.score_parts(_pages_with_scores(spark, d).withColumn("bm25_rank", F.col("rank")))
    return out.select("query_id", "page_rank", "scores")


@query
def question_rows(spark, d):
    q, p = _question_table(spark, d)
    return viewer.question_table(store.questions_with_pages(q.withColumn("category", F.lit("")), p))


@query
def question_counts(spark, d):
    q, _ = _question_table(spark, d)
    return store.question_counts(q.withColumn("active", F.col("id") % 3 != 0))


@query
def failed_questions(spark, d):
    rows = _scored(spark, d).withColumn("error", F.when(F.col("query_id") % 7 == 0, "x"))
    return viewer.failures_only(rows).select("query_id", "failure", F.coalesce("error", F.lit("")).alias("error"))


@query
def doctor_verdict(spark, d):
    checks = table(spark, d, "labels").select((F.col("doc_id") % 50).alias("report"), (F.col("quality") == 1).alias("ok"), (F.col("toxic") == 1).alias("required"))
    return viewer.verdict(checks, "report")


@query
def event_lines(spark, d):
    turns = table(spark, d, "conversations").filter("role = 'assistant'")
    answers = turns.select(F.concat(F.lit("s"), (F.col("conv_id") * 1000 + F.col("turn")).cast("string")).alias("session_id"), F.col("text").alias("answer"), (F.col("turn") % 2 == 0).alias("fallback"), F.array(F.lit("S1"), F.lit("S2")).alias("citations"), F.lit('[{"rank":1}]').alias("matches"))
    return ask.events(answers)


@query
def cache_manifests(spark, d):
    t = table(spark, d, "conversations")
    rows = t.select(F.sha2(F.col("conv_id").cast("string"), 256).alias("source_sha256"), F.lit("m").alias("parser_model"), F.lit("v1").alias("prompt_version"), F.lit(4).alias("context_pages"), (F.col("turn") + 1).cast("int").alias("page_number"), F.when(F.col("turn") % 3 == 2, "failed").otherwise("ok").alias("status"), F.col("role").alias("issue"), (F.lit(4) + F.col("conv_id") % 3).cast("int").alias("total_pages"))
    out = files.manifests(rows)
    failed = F.array_sort(F.transform(F.map_entries("failed_pages"), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"])))
    return out.select("source_sha256", F.array_join("page_numbers", ",").alias("page_numbers"), F.array_join(failed, ",").alias("failed"), "total_pages", "complete")


@query
def document_totals(spark, d):
    return files.totals(pages.join_pages(_conversation_pages(spark, d), "conv_id").select(T.pages_of("markdown").alias("pages")))


@query
def preview_requests(spark, d):
    have = _conversation_pages(spark, d)
    last = have.groupBy("conv_id").agg(F.max("page_number").alias("n"))
    requests = last.select("conv_id", F.array(F.col("n"), F.lit(1), F.col("n"), F.lit(99), F.lit(2)).alias("pages"))
    valid, invalid = pages.requested_pages(requests, have, "conv_id")
    kept = valid.select("conv_id", "position", "page_number", F.lit(True).alias("valid"))
    return kept.unionByName(invalid.select("conv_id", "position", "page_number", F.lit(False).alias("valid")))


@query
def iso_times(spark, d):
    return table(spark, d, "events").select("event_id", files.iso(F.col("ts").cast("timestamp")).alias("iso"))


@query
def answer_prompts(spark, d):
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("h"))
    rows = turns.select("conv_id", F.transform("h", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("history"), F.element_at("h", -1)["content"].alias("question"), F.lit("[S1] a p.1").alias("context"))
    told = rows.select("conv_id", assemble.answer_prompt("question", "context", "history").alias("m"))
    return told.select("conv_id", F.size("m").cast("long").alias("messages"), F.sha2(F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "|"), 256).alias("prompt_sha256"))


def _inputs(spark, d) -> DataFrame:
    asked = _questions(spark, d).select("query_id", F.col("query").alias("question"), F.array(_variant(1)).alias("variants"), F.lit(None).cast("string").alias("previous"))
    return ask.generation_inputs(asked, _chunks(spark, d), retrieve.Retrieval("bm25", 8))


@query
def generation_inputs(spark, d):
    return _inputs(spark, d).select("query_id", F.size("queries").cast("long").alias("queries"), F.sha2("context", 256).alias("context_sha256"), F.array_join(F.transform("options", lambda o: o["document_id"]), ",").alias("documents"))


@query
def asked(spark, d):
    """Answers by a model that says yes or nothing, and an audit that names a source which isn't there, too."""
    def answer(messages: list[dict[str, str]]) -> str:
        return " yes " if len(messages[-1]["content"]) % 2 else ""

    def audit(messages: list[dict[str, str]]) -> str:
        return '{"used_source_ids": ["S3", "S1", "S99"]}'

    return ask.ask(_inputs(spark, d), answer, audit).select("query_id", "answer", F.array_join(F.transform("citations", lambda c: F.concat(c["source_id"], F.lit("="), c["document_id"])), ",").alias("citations"))


def entry(spark: SparkSession, d: str) -> DataFrame:
    """For each question, the top eight pages by BM25."""
    found = bm25.search(_questions(spark, d), _chunks(spark, d), 40).join(_chunks(spark, d).select("chunk_index", "document_id", "page_start"), "chunk_index")
    return fusion.collapse_to_pages(found, 8).select("query_id", "document_id", "page_start", F.round("score", 6).alias("score"), "page_rank")




def _provenance(chunks: DataFrame) -> DataFrame:
    """Chunks with the columns that an index must have."""
    return chunks.withColumns({"source_path": F.concat(F.lit("/docs/"), "document_id"), "source_sha256": F.sha2("text", 256), "parser_model": F.lit("direct-markdown"), "prompt_version": F.lit("none")})


@query
def index_of_a_tag(spark, d):
    """The chunks of one tag, from the files of a written index that may hold it."""
    folder = shared_folder(spark)
    files.write_index(_provenance(_chunks(spark, d)), folder)
    return files.read_index(spark, folder, tag=" de ").select("chunk_index", "document_id", "tag", "source_sha256", "schema_version")


@query
def streamed_terms(spark, d):
    """Document frequencies of an index that follows changes: all documents, then those of one language with their source in
    front, then those of another withdrawn. A document is one chunk."""
    index = LiveIndex(spark, shared_folder(spark), chunking.ChunkLimits(1 << 30, 1 << 30, 0))
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.col("text").alias("markdown"), "lang", "source")
    batches = [docs, docs.filter("lang = 'de'").withColumn("markdown", F.concat("source", F.lit("\n"), "markdown")), docs.filter("lang = 'fr'").withColumn("markdown", F.lit(None).cast("string"))]
    for number, batch in enumerate(batches):
        index.apply(batch.select("document_id", "markdown"), number)
    return index.terms()


def _read_aloud(page: int, image: bytes, context: list[bytes]) -> tuple[str, str]:
    """A model's stand-in: it gives the page's text, cut off where its length divides by three and others are in view, and always where by seven."""
    text = image.decode()
    cut = len(text) % 7 == 0 or len(text) % 3 == 0 and len(context) > 1
    return json.dumps({"markdown": text + (" **" if cut else "")}), "end_turn"


@query
def extraction_rounds(spark, d):
    """Conversations as rendered documents, a page for each turn: pages whose answers the gates reject are asked for again, alone."""
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    content = F.encode(F.array_join(F.transform("t", lambda x: F.coalesce(x["text"], F.lit(""))), "\f"), "UTF-8")
    name = F.col("conv_id").cast("string")
    rows = turns.select(F.concat(F.lit("/x/"), name).alias("path"), content.alias("content"), F.lit("").alias("tag"), name.alias("name"), name.alias("relative_path"), name.alias("document_id"), F.sha2(F.concat(name, F.lit("\f"), content.cast("string")), 256).alias("source_sha256"))
    render = lambda body: [(i, page.encode(), page) for i, page in enumerate(body.decode().split("\f"), 1)]
    docs = extraction.parse_documents(stored(rows), render, _read_aloud, shared_folder(spark), "stand-in", "v1", pages_a_task=64)
    return docs.select("document_id", F.explode("pages").alias("p"), "failed_pages").select("document_id", "p.page_number", F.sha2("p.markdown", 256).alias("markdown_sha256"), F.map_contains_key("failed_pages", F.col("p.page_number")).alias("failed"))


@query
def contextual_flags(spark, d):
    """Of all questions of conversations, as asked and with the one before them, whether the lexical search leaves them out."""
    asked = assemble.contextual_queries(table(spark, d, "conversations"), "conv_id", "turn", content="text").select("conv_id", "turn", F.col("query").alias("contextual"))
    rows = table(spark, d, "conversations").join(asked, ["conv_id", "turn"])
    return rows.select("conv_id", "turn", T.is_contextual("text").alias("plain"), T.is_contextual("contextual").alias("with_previous"))


@query
def embedded_chunks(spark, d):
    """Chunks with the vectors that an embedder gives for batches of their texts: here their characters and their blanks."""
    embed = lambda texts: [[float(len(t)), float(t.count(" "))] for t in texts]
    return edges.embedded(_chunks(spark, d).select("chunk_index", "text"), embed).select("chunk_index", F.get("embedding", F.lit(0)).cast("double").alias("characters"), F.get("embedding", F.lit(1)).cast("double").alias("blanks"))


@query
def over_budget_documents(spark, d):
    """Documents with more pages than allowed."""
    pages = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("document_id"), "turn")
    return quality.over_budget(pages, "document_id", 5)


def _conversation_questions(asked: DataFrame, turns: DataFrame) -> DataFrame:
    """Questions (query_id, conv_id, query) with the assistant's turns of their conversation as pages, some of them told twice."""
    page = F.struct(F.concat(F.lit(" "), F.col("conv_id").cast("string")).alias("document_id"), (F.col("turn") + 1).cast("int").alias("page"), F.lit("s").alias("source"), F.lit("p").alias("source_path"), F.lit("").alias("reference_text"))
    pages = turns.filter("role = 'assistant'").groupBy("conv_id").agg(F.sort_array(F.collect_list(page)).alias("pages"))
    return asked.join(pages, "conv_id").select(F.concat(F.lit(" "), "query", F.lit(" ")).alias("question"), F.col("query_id").cast("string").alias("category"), F.concat("pages", "pages").alias("pages"))


@query
def imported_questions(spark, d):
    """All user turns, imported to a store as questions in one change, as the store lists them."""
    turns = table(spark, d, "conversations")
    asked = turns.filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "conv_id", F.col("text").alias("query"))
    kept = store.Store(spark, shared_folder(spark))
    kept.import_questions(_conversation_questions(asked, turns))
    pages = F.array_join(F.transform("pages", lambda p: F.concat(p["document_id"], F.lit(":"), p["page"].cast("string"))), ",")
    return kept.questions().select(F.col("category").cast("long").alias("query_id"), "question", "active", pages.alias("pages"))


@query
def evaluation_run(spark, d):
    """A run of the evaluation from end to end: questions imported, retrieved in batches, scored, and read from the store."""
    turns = table(spark, d, "conversations")
    kept = store.Store(spark, shared_folder(spark))
    kept.import_questions(_conversation_questions(_eval_questions(spark, d), turns))
    chunks = _turns(spark, d).select("chunk_index", "document_id", (F.col("turn") + 1).cast("int").alias("page_start"), "text")
    key = evaluation.run(kept, chunks, EvaluationConfig("run", "bm25", 5), batches=2)
    told = "expected_count long, retrieved_count long, relevant_at_1 long, relevant_at_k long, first_relevant_rank double, false_positives long, hit_at_1 double, hit_at_k double, recall_at_1 double, recall_at_k double, precision_at_k double, mrr_at_k double, failure boolean"
    asked = kept.table("questions").select(F.col("id").alias("question_id"), F.col("category").cast("long").alias("query_id"))
    return kept.results(key).select("question_id", F.from_json("metrics", told).alias("m")).join(asked, "question_id").select("query_id", "m.*")

