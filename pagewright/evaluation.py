"""A run of the evaluation: variants, one retrieval job for all questions, scores, aggregates, all kept in the store."""

from __future__ import annotations

import dataclasses
import json
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.config import EvaluationConfig
from pagewright.operators import assemble, metrics
from pagewright.operators.retrieve import Retrieval, instructed, merged_at, retrieval_queries, retrieve
from pagewright.sources.shared import stored
from pagewright.sources.store import Store

PROMPT_VERSION = "variants-1"


#: Model calls of one task at most; there are no more tasks than texts.
CALLS_A_TASK = 64


def load_variants(store: Store, questions: DataFrame, generate: Callable[[str], list[str]] | None) -> DataFrame:
    """(question, variants): cached ones, generated once for each text that has none and kept by one upsert; a generator
    that fails leaves the question alone. Texts are called for in tasks, each once, and what comes is written before it is
    kept; the driver sees none of it."""
    asked = questions.select("question").distinct()
    if generate is not None:

        def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts, found = b.column("question").to_pylist(), []
                for text in texts:
                    try:
                        found.append(generate(text) or None)
                    except Exception:
                        found.append(None)
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(found, pa.list_(pa.string()))], ["question", "found"])

        missing = stored(store.known_variants(asked, PROMPT_VERSION).filter("variants is null").select("question"))
        if n := missing.count():
            new = stored(missing.repartition(-(-n // CALLS_A_TASK)).mapInArrow(call, "question string, found array<string>"))
            store.add_variants(new.filter("found is not null"), PROMPT_VERSION)
    known = store.known_variants(asked, PROMPT_VERSION) if generate is not None else asked.withColumn("variants", F.lit(None).cast("string"))
    return known.select("question", F.coalesce(F.from_json("variants", "array<string>"), F.array().cast("array<string>")).alias("variants"))


def run(store: Store, chunks: DataFrame, config: EvaluationConfig, generate: Callable[[str], list[str]] | None = None, embed: Callable[[DataFrame], DataFrame] | None = None, batches: int = 1) -> int:
    """The evaluation's id; its row ends as completed with metrics, or as failed with the error, which is raised again.

    ``chunks``: chunk_index, document_id, page_start, text[, embedding, tag, source, source_path, page_chunk_index];
    ``embed`` adds embeddings to queries, which carry the configured instruction. The filter by tag and the distance are
    the configuration's. Questions are answered in ``batches`` jobs; the latency of a question is the time from its batch's
    start until its lists were merged to pages, told by the task that merged them; that of a question without any hit is the
    time until its batch was done."""
    questions = store.questions().filter("active")
    if questions.isEmpty():
        raise ValueError("the dataset has no active questions")
    key = store.start_evaluation(config.name, dataclasses.asdict(config))
    how = Retrieval(config.mode, config.top_k, metric=config.distance or "l2", tag=config.tag or "")
    try:
        told = load_variants(store, questions, generate if config.augment else None)
        asked = stored(questions.join(told, "question").withColumn("__batch", F.pmod(F.xxhash64("id"), F.lit(batches))))
        scored_schema = None
        for batch in range(batches):
            began = time.time()
            mine = asked.filter(F.col("__batch") == batch).withColumns({"query_id": F.col("id"), "previous": F.lit(None).cast("string")})
            queries = retrieval_queries(mine)
            if embed is not None and config.mode != "bm25":
                queries = instructed(queries, embed, config.instruction)
            pages = stored(retrieve(queries, chunks, how).withColumn("answered_at", merged_at()))
            done = time.time()
            found = pages.select("query_id", F.col("page_rank").alias("rank"), "document_id", F.col("page_start").alias("page"))
            expected = mine.select("query_id", F.inline("pages")).select("query_id", "document_id", "page")
            scored = metrics.score_retrieval(mine, expected, found, config.top_k)
            names = [c for c in scored.columns if c != "query_id"]
            scored_schema = scored.select(*names).schema
            matches = assemble.gathered_matches(assemble.with_payload(pages, chunks))
            rows = scored.join(mine, "query_id").join(matches, "query_id", "left")
            rows = stored(rows.select(F.col("query_id").alias("id"), F.lit(key).cast("long").alias("evaluation_id"), F.col("query_id").alias("question_id"), "question", F.to_json("pages").alias("expected"), F.coalesce("matches", F.lit("[]")).alias("matches"), F.to_json("variants").alias("variants"), F.to_json(F.struct(*names)).alias("metrics"), F.lit("").alias("error")))
            answered = pages.groupBy(F.col("query_id").alias("id")).agg(F.max("answered_at").alias("__at"))
            latency = F.coalesce(F.col("__at"), F.lit(int(done * 1e6))) / 1000 - began * 1000
            store.add_results(rows.join(answered, "id", "left").withColumn("latency_ms", F.greatest(latency, F.lit(0.0))).drop("__at"))
        kept = store.results(key).select(F.from_json("metrics", scored_schema).alias("m"), "latency_ms", "error").select("m.*", "latency_ms", "error")
        total = metrics.aggregate_metrics(kept).first().asDict() | {"top_k": config.top_k}
        store.end_evaluation(key, total)
    except Exception as e:
        store.end_evaluation(key, error=f"{type(e).__name__}: {e}")
        raise
    return key


PAGE = "document_id string, page int, source string, source_path string, reference_text string"


def results_file(store: Store, key: int) -> DataFrame:
    """The rows of an evaluation's results file."""
    from pagewright.sources.store import csv_rows

    rows = store.results(key)
    sample = "first_relevant_rank int, recall_at_1 double, recall_at_k double, precision_at_k double, mrr_at_k double, false_positives long, failure boolean"
    told = rows.select("question_id", "question", F.from_json("expected", f"array<struct<{_struct(PAGE)}>>").alias("expected"), F.from_json("matches", "array<struct<source: string, page: int>>").alias("retrieved"), F.from_json("metrics", sample).alias("metrics"), "latency_ms", "error")
    return csv_rows(told)


def _struct(schema: str) -> str:
    return ", ".join(": ".join(f.split()) for f in schema.split(", "))


def summary(store: Store, key: int) -> dict:
    """The metrics of a run that has ended."""
    return json.loads(store.evaluations().filter(F.col("id") == key).first()["metrics"] or "{}")
