"""Answers to a table of questions: what the model is given, its answer, the sources that an audit finds in it.

Model calls are injected (``edges.Generator``: messages to text) and run for each row where the row is; a call that fails
leaves its row without an answer, or without sources.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import assemble
from pagewright.operators.retrieve import Retrieval, instructed, retrieval_queries, retrieve

Generate = Callable[[list[dict[str, str]]], str]


def _said(rows: DataFrame, prompt: Column, generate: Generate, name: str) -> DataFrame:
    """The rows with the model's reply to each row's messages, null where the call failed or there were none."""
    from pyspark.sql.types import StringType, StructField, StructType

    told = rows.withColumn("__prompt", prompt)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for messages in b.column("__prompt").to_pylist():
                try:
                    out.append(generate(messages) if messages else None)
                except Exception:
                    out.append(None)
            kept = [n for n in b.schema.names if n != "__prompt"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in kept), pa.array(out, pa.string())], [*kept, name])

    return told.mapInArrow(run, StructType([*rows.schema.fields, StructField(name, StringType())]))


def with_variants(questions: DataFrame, generate: Generate | None) -> DataFrame:
    """Questions with ``variants``: two rewritten ones from the model, none where it fails or gives fewer."""
    none = F.array().cast("array<string>")
    if generate is None:
        return questions.withColumn("variants", none)
    told = _said(questions, assemble.variants_prompt("question"), generate, "__reply")
    found = T.query_variants(F.coalesce("__reply", F.lit("")), "question")
    return told.withColumn("variants", F.when(F.col("__reply").isNotNull() & (F.size(found) == 2), found).otherwise(none)).drop("__reply")


def rewritten(question: Column | str) -> Column:
    """The question for retrieval in the light of a conversation: the question itself, by definition."""
    return F.col(question) if isinstance(question, str) else question


def generation_inputs(questions: DataFrame, chunks: DataFrame, how: Retrieval = Retrieval(), embed: Callable[[DataFrame], DataFrame] | None = None, instruction: str | None = None, index: DataFrame | None = None) -> DataFrame:
    """(query_id, question, queries, context, options, matches): for each question (query_id, question, variants, previous)
    its retrieval queries, the context's blocks, what may be cited, and the serialized matches (JSON). ``chunks`` need
    source and text beside what ``retrieve`` asks for. A question without hits has an empty context and no options."""
    queries = retrieval_queries(questions.withColumn("rewritten", rewritten("question")))
    asked = queries if embed is None or how.mode == "bm25" else instructed(queries, embed, instruction)
    pages = assemble.with_payload(retrieve(asked, chunks, how, index), chunks)
    options = assemble.source_options(pages)
    kept = [c for c in options.columns if c != "query_id"]
    each = options.withColumn("__n", F.substring("source_id", 2, 9).cast("int")).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("__n", F.struct(*kept).alias("o")))).alias("__o"))
    each = each.select("query_id", F.transform("__o", lambda x: x["o"]).alias("options"))
    listed = queries.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("list_no", "query"))).alias("__q")).select("query_id", F.transform("__q", lambda x: x["query"]).alias("queries"))
    out = questions.select("query_id", "question").join(listed, "query_id", "left").join(assemble.contexts(pages, "source", "page_start", "text"), "query_id", "left")
    out = out.join(each, "query_id", "left").join(assemble.gathered_matches(pages), "query_id", "left")
    return out.withColumns({"context": F.coalesce("context", F.lit("")), "options": F.coalesce("options", F.array().cast(each.schema["options"].dataType)), "matches": F.coalesce("matches", F.lit("[]"))})


def ask(inputs: DataFrame, answer: Generate, audit: Generate) -> DataFrame:
    """The inputs with ``answer`` (grounded: the refusal, unless the audit finds a source of it) and ``citations``: the
    options, without their text, whose ids the audit names."""
    told = _said(inputs, assemble.answer_prompt("question", "context"), answer, "__answer")
    told = told.withColumn("__answer", T.strip(F.coalesce("__answer", F.lit(""))))
    prompt = F.when((F.col("__answer") != "") & (F.size("options") > 0), assemble.attribution_prompt("question", "__answer", "options"))
    told = _said(told, prompt, audit, "__audit")
    used = T.used_ids(F.coalesce("__audit", F.lit("")), F.transform("options", lambda o: o["source_id"]))
    cited = F.transform(F.filter("options", lambda o: F.array_contains(used, o["source_id"])), lambda o: o.dropFields("text"))
    told = told.withColumn("citations", cited)
    return told.withColumn("answer", T.grounded("__answer", "citations")).drop("__answer", "__audit")


def events(answers: DataFrame, session: str = "session_id") -> DataFrame:
    """(session, seq, event): what a client is sent, as JSON lines in order: session, reasoning (if the rows have any), a
    fallback (where they say so), answer, citations, matches, done."""
    have = set(answers.columns)
    line = lambda kind, *fields: F.to_json(F.struct(F.lit(kind).alias("type"), *fields), {"ignoreNullFields": "false"})
    reasoning = F.transform(F.coalesce("reasoning", F.array().cast("array<string>")), lambda d: line("reasoning", d.alias("delta"))) if "reasoning" in have else F.array().cast("array<string>")
    fallback = F.when(F.col("fallback"), F.array(line("fallback", F.lit("the model gave no answer").alias("reason")))).otherwise(F.array().cast("array<string>")) if "fallback" in have else F.array().cast("array<string>")
    matches = F.concat(F.lit('{"type":"matches","matches":'), F.col("matches"), F.lit("}"))
    told = F.concat(F.array(line("session", F.col(session).alias("session_id"))), reasoning, fallback, F.array(line("answer", F.col("answer").alias("delta")), line("citations", F.col("citations")), matches, line("done")))
    return answers.select(session, F.posexplode(told).alias("seq", "event"))
