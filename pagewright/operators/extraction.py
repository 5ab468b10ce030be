"""Checkpointed extraction of rendered pages by an injected model call."""

from __future__ import annotations

import random
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.edges import with_retries
from pagewright.functions import text as T
from pagewright.operators import quality
from pagewright.operators.numbering import places
from pagewright.operators.pages import context_windows
from pagewright.sources import files as files_module
from pagewright.sources.shared import removed, stored

RESULT = "document_id string, page_number int, raw string, stop_reason string, calls int, kind string, error string"

_BY_SOURCE = RESULT.replace("document_id", "source_sha256")


def pending_pages(rendered: DataFrame, done: DataFrame, retry_failed: bool = False) -> DataFrame:
    """Rendered pages without a cached row; a failed page counts as done unless it is to be tried again."""
    kept = done.filter("status = 'ok'") if retry_failed else done
    return rendered.join(kept.select("document_id", "page_number"), ["document_id", "page_number"], "left_anti")


def check_budget(pages: DataFrame, most_pages: int = 200, most_calls: int = 200) -> None:
    """Raises before any call where a document has more pages than allowed, or needs more calls (one a page)."""
    for limit, what in ((most_pages, "pages"), (most_calls, "calls")):
        over = quality.over_budget(pages, "document_id", limit).limit(5).collect()
        if over:
            raise RuntimeError(f"more than {limit} {what}: {[r['document_id'] for r in over]}")


def with_context(pages: DataFrame, size: int = 4) -> DataFrame:
    """Each page with the images of the pages that it is read with: a join of page numbers, so no document is gathered."""
    around = context_windows(pages.select("document_id", "page_number"), "document_id", "page_number", size)
    wanted = around.select("document_id", "page_number", F.explode("context").alias("__other"))
    images = pages.select("document_id", F.col("page_number").alias("__other"), F.col("image").alias("__image"))
    read = wanted.join(images, ["document_id", "__other"]).groupBy("document_id", "page_number").agg(F.array_sort(F.collect_list(F.struct("__other", "__image"))).alias("__c"))
    context = read.select("document_id", "page_number", F.transform("__c", lambda x: x["__image"]).alias("context"))
    return pages.select("document_id", "page_number", "image").join(context, ["document_id", "page_number"])


Call = Callable[[int, bytes, list[bytes]], tuple[str, str]]


def extract(pages: DataFrame, call: Call, transient: tuple[type[Exception], ...] = (ConnectionError,), sleep: Callable[[float], None] = time.sleep, jitter: Callable[[], float] = random.random, deadline: float | None = None, alone: bool = False) -> DataFrame:
    """One row a page: the model's raw answer and why it stopped, or the error. ``alone``: with the page's own image as its
    context. A transient error is tried again after a while, up to five times; what still fails is ``transient``, any other
    error, which is never tried again, ``permanent``. After the deadline (seconds since the epoch) pages are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in b.to_pylist():
                if deadline is not None and time.time() >= deadline:
                    break
                raw = stop = error = None
                kind = "answer"
                try:
                    raw, stop = with_retries(lambda: call(row["page_number"], row["image"], [row["image"]] if alone else row["context"]), transient, sleep, jitter)
                except Exception as e:  # recorded, and the other pages go on
                    kind, error = "transient" if isinstance(e, transient) else "permanent", f"{type(e).__name__}: {e}"
                out.append((row["document_id"], row["page_number"], raw, stop, 1, kind, error))
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in RESULT.split(", ")])

    return pages.mapInArrow(run, RESULT)


PAGE = ["document_id", "page_number"]


def rejected(results: DataFrame, rendered: DataFrame) -> DataFrame:
    """The pages whose answers the gates don't accept: what one more call, with the page alone, may mend."""
    return validated(results, rendered).filter("status <> 'ok' and error is null").select(*PAGE)


def in_rounds(read: DataFrame, rendered: DataFrame, ask: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """The last answer of each page (``calls``: how many there were). ``ask`` gets pages and the number of the round, and
    returns their answers, computed once. The second round has those that the gates rejected in the first."""
    first = ask(read, 1)
    again = stored(rejected(first, rendered))
    second = ask(read.join(again, PAGE, "left_semi"), 2).withColumn("calls", F.lit(2))
    return first.join(second.select(*PAGE), PAGE, "left_anti").unionByName(second)


def judged(read: DataFrame, rendered: DataFrame, ask: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """What ``validated`` says of the last answers that ``in_rounds`` gives; each answer goes through the gates once."""
    first = stored(validated(ask(read, 1), rendered))
    again = first.filter("status <> 'ok' and error is null").select(*PAGE)
    second = stored(validated(ask(read.join(again, PAGE, "left_semi"), 2).withColumn("calls", F.lit(2)), rendered))
    return first.join(second.select(*PAGE), PAGE, "left_anti").unionByName(second)


def validated(results: DataFrame, rendered: DataFrame) -> DataFrame:
    """(document_id, page_number, markdown, status, issue, calls, error): markdown that ended by itself, parses, is complete and covers
    the page's own text; a failed page is empty."""
    rows = results.withColumn("markdown", quality.accepted(F.col("raw"), F.col("stop_reason")))
    key = ["document_id", "page_number"]
    covered = rows.join(rendered.select(*key, "reference"), key, "left")
    out = quality.reference_coverage(covered.withColumn("__told", F.coalesce("markdown", F.lit(""))), rows.columns, "reference", "__told").withColumn("low", F.col("issue"))
    issue = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("markdown").isNull(), "unusable answer").when(F.col("low"), "low coverage")
    out = out.withColumn("issue", issue).withColumn("status", F.when(F.col("issue").isNull(), "ok").otherwise("failed"))
    return out.select(*key, F.when(F.col("status") == "ok", T.strip("markdown")).otherwise("").alias("markdown"), "status", "issue", "calls", "error")


def _dealt(rows: DataFrame, n: int, tasks: int) -> DataFrame:
    """The n rows of a stored table, dealt evenly: as many rows a task as another, or one more."""
    placed = places(rows, "__place").withColumn("__task", F.floor(F.col("__place") * tasks / n).cast("int"))
    return placed.repartitionById(tasks, F.col("__task")).drop("__place", "__task")


class Answers:
    """Raw answers beside a page cache: each is visible as soon as its task ends, so that a run which is broken off pays for
    no page twice. A task has one page, or ``pages_a_task``; there are ``MOST_TASKS`` at most. A task writes files under its attempt's name, which
    the second algorithm of Hadoop's committer moves into place when the task ends. Of files that an attempt left when it
    failed in between, one answer a page is taken. Runs write to folders of their own, since a folder has one job's
    uncommitted files at a time. Answers are kept by source, so documents of equal content are asked for once."""

    MOST_TASKS = 10_000

    def __init__(self, spark: SparkSession, cache: str, key: dict[str, object], fresh: bool, pages_a_task: int = 1):
        self.spark, self.top, self.key, self.fresh, self.pages = spark, f"{cache.rstrip('/')}-answers", key, fresh, pages_a_task
        self.run = uuid.uuid4().hex

    def known(self, attempt: int) -> DataFrame:
        """The answers (not errors) to a round's calls, one a page, by source; of this run alone where all are to be fresh."""
        if not files_module.exists(self.spark, self.top):
            return self.spark.createDataFrame([], _BY_SOURCE)
        key = ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in self.key.items())
        rows = self.spark.read.schema(f"{_BY_SOURCE}, {key}, run string, attempt int").parquet(self.top)
        mine = rows.filter((F.col("attempt") == attempt) & (F.col("kind") == "answer"))
        for k, v in [*self.key.items(), *([("run", self.run)] if self.fresh else [])]:
            mine = mine.filter(F.col(k) == v)
        return mine.dropDuplicates(["source_sha256", "page_number"]).select(*[x.split()[0] for x in _BY_SOURCE.split(", ")])

    def asked(self, pages: DataFrame, named: DataFrame, attempt: int, extracted: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """All answers to a round's pages: known ones, and those to calls made now; of these the errors as well."""
        source = ["source_sha256", "page_number"]
        todo = stored(pages.join(named, "document_id").dropDuplicates(source).join(self.known(attempt).select(*source), source, "left_anti").withColumn("document_id", F.col("source_sha256")).drop("source_sha256"))
        n = todo.count()
        folder = f"{self.top}/run={self.run}/attempt={attempt}"
        told = self.known(attempt)
        if n:
            rows = extracted(_dealt(todo, n, min(-(-n // self.pages), self.MOST_TASKS))).withColumnRenamed("document_id", "source_sha256")
            rows.withColumns({k: F.lit(v) for k, v in self.key.items()}).write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(folder)
            told = self.known(attempt).unionByName(self.spark.read.schema(_BY_SOURCE).parquet(folder).filter("kind <> 'answer'"))
        return stored(told.join(named, "source_sha256").join(pages.select(*PAGE), PAGE, "left_semi").select(*[x.split()[0] for x in RESULT.split(", ")]))

    def forget(self) -> None:
        """Deletes this run's answers, once their pages are in the cache."""
        removed(self.spark, f"{self.top}/run={self.run}")


def parse_documents(files: DataFrame, render: Callable[[bytes], list[tuple[int, bytes, str]]], call: Call, cache: str, model: str, prompt_version: str, most_pages: int = 200, most_calls: int = 200, context_pages: int = 4, retry_failed: bool = False, refresh: bool = False, timeout: float | None = None, record_errors: bool = False, pages_a_task: int = 1, **calls) -> DataFrame:
    """Documents (those of ``files``: path, content, tag, name, relative_path, document_id, source_sha256) with pages, by
    cache, budget, calls and checkpoint. Pages that the cache has under this model, prompt version and context size are
    kept; budgets are checked before any call. The others are asked for in two rounds: all of them, then those whose answers
    the gates reject, alone. Each answer is kept as its task ends (``Answers``), so a run that is broken off, or passes its deadline, goes on
    where it stopped. A page that is rejected twice is empty and counts as done, unless ``retry_failed``. A page whose call
    ends in an error isn't done: all others are kept, then an error is raised, and the next run asks for it again;
    ``record_errors`` takes it as a failed page instead."""
    spark = files.sparkSession
    rendered = stored(files_module.rendered(files, render))
    check_budget(rendered, most_pages, most_calls)
    named = files.select("document_id", "source_sha256")
    key = {"parser_model": model, "prompt_version": prompt_version, "context_pages": context_pages}
    columns = {k: F.lit(v) for k, v in key.items()}

    def cached() -> DataFrame:
        kept = files_module.read_cache(spark, cache)
        none = spark.createDataFrame([], "document_id string, page_number int, markdown string, status string, issue string")
        if kept is None:
            return none
        mine = kept.filter((F.col("parser_model") == model) & (F.col("prompt_version") == prompt_version) & (F.col("context_pages") == context_pages))
        return mine.join(named, "source_sha256").select(*none.columns)

    todo = rendered if refresh else pending_pages(rendered, cached(), retry_failed)
    read = stored(with_context(rendered, context_pages).join(todo.select(*PAGE), PAGE, "left_semi"))
    deadline = None if timeout is None else time.time() + timeout
    answers = Answers(spark, cache, key, refresh or retry_failed, pages_a_task)
    told = stored(judged(read, rendered, lambda pages, attempt: answers.asked(pages, named, attempt, lambda x: extract(x, call, deadline=deadline, alone=attempt == 2, **calls))))
    # without a second answer, a page that was rejected once is neither done nor failed
    finished = told.filter((F.col("status") == "ok") | (F.lit(record_errors) & F.col("error").isNotNull()) | (F.col("error").isNull() & (F.col("calls") > 1)))
    total = rendered.groupBy("document_id").agg(F.count("*").cast("int").alias("total_pages"))
    done = finished.join(named, "document_id").join(total, "document_id").withColumns(columns)
    files_module.write_cache(done.select("source_sha256", *key, "page_number", "markdown", "status", "issue", "total_pages"), cache)
    now = cached().join(rendered.select(*PAGE), PAGE, "left_semi")
    if refresh or retry_failed:  # what was asked for again and didn't come is missing, whatever the cache had before
        now = now.join(todo.join(finished.select(*PAGE), PAGE, "left_anti").select(*PAGE), PAGE, "left_anti")
    now = stored(now)
    left = pending_pages(rendered, now)
    if not record_errors and (broken := told.filter("error is not null").orderBy(*PAGE).limit(5).collect()):
        raise RuntimeError(f"calls ended in errors; what is done is kept, run again to go on: {[(r['document_id'], r['page_number'], r['error']) for r in broken]}")
    if not left.isEmpty():
        raise TimeoutError(f"{left.count()} pages are left; run again to go on")
    answers.forget()
    pages = now.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page_number", F.coalesce("markdown", F.lit("")).alias("markdown")))).alias("pages"), F.map_from_entries(F.collect_list(F.when(F.col("status") != "ok", F.struct("page_number", "issue")))).alias("failed_pages"))
    none = F.array().cast("array<struct<page_number:int,markdown:string>>")
    return files.drop("content").join(pages, "document_id", "left").withColumns({"pages": F.coalesce("pages", none), "parser_model": F.lit(model), "prompt_version": F.lit(prompt_version)})


def previewed(requests: DataFrame, rendered: DataFrame, call: Callable[[int, bytes, list[bytes]], tuple[str, str]]) -> DataFrame:
    """(document_id, position, page_number, markdown) of requested pages, in order and once each, without the cache; failed
    pages are left out. A page that the document doesn't have is an error."""
    from pagewright.operators.pages import requested_pages

    wanted, invalid = requested_pages(requests, rendered.select("document_id", "page_number", "image"), "document_id")
    if bad := invalid.limit(5).collect():
        raise ValueError(f"no such pages: {[(r['document_id'], r['page_number']) for r in bad]}")
    read = with_context(rendered).join(wanted.select("document_id", "page_number"), ["document_id", "page_number"], "left_semi")
    answers = in_rounds(stored(read), rendered, lambda pages, attempt: stored(extract(pages, call, alone=attempt == 2)))
    done = validated(answers, rendered).filter("status = 'ok'")
    return wanted.select("document_id", "position", "page_number").join(done.select("document_id", "page_number", "markdown"), ["document_id", "page_number"])
