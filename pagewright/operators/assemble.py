"""From ranked pages and messages to prompts: citations, context, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import text as T


def normal_messages(messages: DataFrame, role: str = "role", content: str = "content") -> DataFrame:
    """Messages with trimmed role and content; blank ones go."""
    out = messages.withColumns({role: T.strip(role), content: T.strip(content)})
    return out.filter((F.col(role) != "") & (F.col(content) != ""))


def contextual_queries(messages: DataFrame, session: str, seq: str, role: str = "role", content: str = "content") -> DataFrame:
    """For each user message after another: the query that holds both."""
    users = normal_messages(messages, role, content).filter(F.col(role) == "user")
    previous = F.lag(content).over(Window.partitionBy(session).orderBy(seq))
    asked = users.withColumn("__previous", previous).filter("__previous is not null")
    return asked.select(session, seq, T.contextual("__previous", content).alias("query"))


def with_source_ids(pages: DataFrame, rank: str = "page_rank") -> DataFrame:
    return pages.withColumn("source_id", F.concat(F.lit("S"), F.col(rank).cast("string")))


def contexts(pages: DataFrame, source: str, page: str, text: str, rank: str = "page_rank") -> DataFrame:
    """(query_id, context): the blocks in order, parted by blank lines."""
    block = T.context_block(F.col("source_id"), source, page, text)
    parts = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), block.alias("b"))))
    return with_source_ids(pages, rank).groupBy("query_id").agg(parts.alias("__p")).select("query_id", F.array_join(F.transform("__p", lambda x: x["b"]), "\n\n").alias("context"))


def used_citations(citations: DataFrame, used: DataFrame) -> DataFrame:
    """The citations whose (query_id, source_id) an answer used."""
    return citations.join(used, ["query_id", "source_id"], "left_semi")


#: What a citation carries of its match, beside the source id.
CITED = ["chunk_id", "document_id", "source", "source_path", "source_type", "page_start", "page_end", "source_pages", "chunk_index", "page_chunk_index", "tag"]
#: A match as an evaluation keeps it: name, type.
MATCH = [("rank", "int"), ("document_id", "string"), ("source", "string"), ("source_path", "string"), ("page", "int"), ("page_chunk_index", "int"), ("tag", "string"), ("text", "string"), ("distance", "double"), ("vector_score", "double"), ("bm25_score", "double"), ("rrf_score", "double"), ("retrieval_sources", "array<string>")]


def with_payload(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Ranked pages (key: their chunk's index) with the columns of their chunks."""
    rest = [c for c in chunks.columns if c not in (*pages.columns, "embedding", "vector") or c == "chunk_index"]
    return pages.drop("chunk_index").join(chunks.select(*rest), pages["key"] == F.col("chunk_index"))


def serialized(pages: DataFrame, rank: str = "page_rank") -> DataFrame:
    """(query_id, and the columns of ``MATCH``) of ranked pages: missing texts and numbers of pages are blank and 0, missing
    scores null; the lexical score is the fused one unless it is missing or 0, else the raw one."""
    have = set(pages.columns)
    has = lambda c, kind: F.col(c).cast(kind) if c in have else F.lit(None).cast(kind)
    told = {c: F.coalesce(has(c, "string"), F.lit("")) for c in ("document_id", "source", "source_path", "tag", "text")}
    told |= {"rank": F.col(rank), "page": F.coalesce(has("page_start", "int"), F.lit(0)), "page_chunk_index": F.coalesce(has("page_chunk_index", "int"), F.lit(0))}
    told |= {c: has(c, "double") for c in ("distance", "vector_score", "rrf_score")}
    told["bm25_score"] = F.coalesce(F.nullif(has("bm25_score", "double"), F.lit(0.0)), has("bm25_raw_score", "double"))
    told["retrieval_sources"] = F.coalesce(has("sources", "array<string>"), F.array().cast("array<string>"))
    return pages.select("query_id", *[told[c].cast(kind).alias(c) for c, kind in MATCH])


def gathered_matches(pages: DataFrame, rank: str = "page_rank") -> DataFrame:
    """(query_id, matches): the serialized matches of each query as a JSON list, in order."""
    each = F.array_sort(F.collect_list(F.struct(*[c for c, _ in MATCH])))
    return serialized(pages, rank).groupBy("query_id").agg(F.to_json(each, {"ignoreNullFields": "false"}).alias("matches"))


def source_options(pages: DataFrame, rank: str = "page_rank") -> DataFrame:
    """(query_id, source_id, the columns of ``CITED``, text): what may be cited; a citation is the same without the text."""
    pages = pages if "page_end" in pages.columns else pages.withColumn("page_end", F.col("page_start"))
    kept = [F.nullif(F.col(c), F.lit("")).alias(c) if c == "tag" else F.col(c) for c in CITED if c in pages.columns]
    return with_source_ids(pages, rank).select("query_id", "source_id", *kept, F.coalesce("text", F.lit("")).alias("text"))


#: Instructions for the models, by task. A caller may pass others.
SYSTEM = {
    "answer": f"Answer from the context alone, briefly and in the language of the question. Earlier messages may explain what is meant but prove nothing. If the context doesn't answer the question, say exactly: {T.REFUSAL}",
    "attribution": 'Name the sources that directly support the answer, and no others. Reply with JSON alone: {"used_source_ids": ["S1"]}; the list is empty if none does.',
    "variants": 'Rewrite the question for a search in two other ways that keep its meaning, names and numbers. Reply with JSON alone: {"queries": ["first", "second"]}.',
}


def _prompt(system: str, history: Column | None, user: Column) -> Column:
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    parts = [F.array(message("system", F.lit(system))), *([history] if history is not None else []), F.array(message("user", user))]
    return F.concat(*parts)


def normal_history(messages: Column | str) -> Column:
    """An array of (role, content), trimmed, without blank ones."""
    told = F.transform(F.col(messages) if isinstance(messages, str) else messages, lambda m: F.struct(T.strip(m["role"]).alias("role"), T.strip(m["content"]).alias("content")))
    return F.filter(told, lambda m: (m["role"] != "") & (m["content"] != ""))


def answer_prompt(question: str, context: str, history: str | None = None, system: str = SYSTEM["answer"]) -> Column:
    """Messages that ask for an answer; a question that the history ends with isn't said twice."""
    user = F.concat(F.lit("Context:\n"), F.coalesce(F.col(context), F.lit("")), F.lit("\n\nQuestion:\n"), F.col(question))
    if history is None:
        return _prompt(system, None, user)
    past = normal_history(history)
    said = (F.size(past) > 0) & F.coalesce((F.get(past, F.size(past) - 1)["role"] == "user") & (F.get(past, F.size(past) - 1)["content"] == T.strip(question)), F.lit(False))
    return _prompt(system, F.when(said, F.slice(past, F.lit(1), F.greatest(F.size(past) - 1, F.lit(0)))).otherwise(past), user)


def attribution_prompt(question: str, answer: str, options: str, history: str | None = None, system: str = SYSTEM["attribution"]) -> Column:
    """Messages that ask which sources support an answer; ``options``: an array of (source_id, source, page_start, page_end, text)."""
    def block(o: Column) -> Column:
        span = F.when(o["page_end"].isNull() | (o["page_end"] == o["page_start"]), o["page_start"].cast("string")).otherwise(F.concat(o["page_start"].cast("string"), F.lit("-"), o["page_end"].cast("string")))
        source = F.coalesce(F.nullif(T.strip(o["source"]), F.lit("")), F.lit("unknown source"))
        return F.concat(F.lit("["), T.strip(o["source_id"]), F.lit("] "), source, F.lit(" p."), span, F.lit("\n"), T.truncated(o["text"]))

    blocks = F.transform(F.filter(options, lambda o: T.strip(F.coalesce(o["source_id"], F.lit(""))) != ""), block)
    sources = F.when(F.size(blocks) > 0, F.array_join(blocks, "\n\n")).otherwise(F.lit("No sources."))
    user = F.concat(F.lit("Question:\n"), F.col(question), F.lit("\n\nAnswer:\n"), F.col(answer), F.lit("\n\nSources:\n"), sources)
    return _prompt(system, normal_history(history) if history else None, user)


def variants_prompt(question: str, system: str = SYSTEM["variants"]) -> Column:
    return _prompt(system, None, F.concat(F.lit("Question:\n"), F.col(question)))
