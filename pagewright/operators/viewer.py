"""Filters, facets, paging and labels of the index viewer and the evaluation tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.sources.pointers import GRACE, Pointers


def apply_filters(rows: DataFrame, in_lists: dict[str, list], needle: str = "", searched: list[str] | None = None) -> DataFrame:
    """All lists (an empty one filters nothing) and, ignoring case, the trimmed needle in any searched column."""
    for column, values in in_lists.items():
        if values:
            rows = rows.filter(F.col(column).isin(values))
    if wanted := needle.strip().lower():
        found = F.lit(False)
        for c in searched or ["text"]:
            found = found | F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(wanted))
        rows = rows.filter(found)
    return rows


#: Characters of a gram: shorter needles are looked for in every row.
GRAM = 3


def _plain(column: str) -> Column:
    return F.lower(F.coalesce(F.col(column).cast("string"), F.lit("")))


def write_grams(rows: DataFrame, folder: str, key: str, searched: list[str], grace: float = GRACE) -> None:
    """Replaces the search index below the folder, by a pointer to a new one: the rows in the order of their key, in blocks of
    64, and for each searched column, gram and block the rows that hold it, as the bits of one number. What a task finds is
    written where it is made, in the order of column and gram for each stretch of ``STRETCH`` characters or so: grams aren't shuffled."""
    spark, at = rows.sparkSession, Pointers(rows.sparkSession, folder)
    name = f"v-{uuid.uuid4().hex}"
    place = F.monotonically_increasing_id()
    laid = rows.repartitionByRange(key).sortWithinPartitions(key).withColumns({"__block": F.shiftright(place, 6), "__place": place.bitwiseAND(63).cast("int")})
    laid.write.parquet(f"{at.folder}/{name}/rows")
    kept = spark.read.parquet(f"{at.folder}/{name}/rows")
    texts = kept.select("__block", "__place", *[_plain(c).alias(f"t{n}") for n, c in enumerate(searched)])
    texts.mapInArrow(_held, "c int, gram string, __block long, bits long").write.parquet(f"{at.folder}/{name}/grams")
    at.commit({"version": (at.latest() or {"version": 0})["version"], "at": name, "searched": searched})
    at.collect(lambda state: [state["at"]], grace)


#: A task sorts the grams of so many bytes of texts at a time, or of 64 rows.
STRETCH = 1 << 20


def _column_grams(texts: list[str], block: np.ndarray, place: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(gram, number of the block, bits), in the order of gram and block, of texts with the numbers and places of their rows."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    first = np.flatnonzero(row[: 1 - GRAM] == row[GRAM - 1 :]) if len(points) >= GRAM else row[:0]
    have = np.zeros(int(points.max(initial=0)) + 1, bool)
    have[points] = True
    alphabet, letter, base = np.flatnonzero(have), np.cumsum(have)[points] - 1, int(have.sum())
    gram = np.zeros(len(first), np.int64)  # as a number: its letters are digits
    for k in range(GRAM):
        gram = gram * base + letter[first + k]
    numbers, blocks = None, int(block.max(initial=0)) + 1
    if base**GRAM * blocks >= 1 << 57:
        numbers, gram = np.unique(gram, return_inverse=True)
    key = np.sort((gram * blocks + block[row[first]]) << 6 | place[row[first]])
    heads = np.flatnonzero(np.diff(key >> 6, prepend=-1))
    bits = np.bitwise_or.reduceat(np.uint64(1) << (key & 63).astype(np.uint64), heads) if len(heads) else np.zeros(0, np.uint64)
    of, at = np.divmod(key[heads] >> 6, blocks)
    starts = np.diff(of, prepend=-1) != 0
    told = of[starts] if numbers is None else numbers[of[starts]]
    spelled = alphabet[np.stack([told // base**k % base for k in reversed(range(GRAM))], 1)].astype("<u4").tobytes().decode("utf-32-le")
    words = pa.array([spelled[i : i + GRAM] for i in range(0, len(spelled), GRAM)], pa.string())
    return words.take(pa.array(np.cumsum(starts) - 1)), at, bits.view(np.int64)


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(column, gram, block, bits) of rows in their order; a block that two stretches or tasks share has a row for each."""
    for batch in batches:
        step = max(64, batch.num_rows * STRETCH // max(batch.nbytes, 1))
        for b in (batch.slice(lo, step) for lo in range(0, batch.num_rows, step)):
            blocks, block = np.unique(b.column("__block").to_numpy(), return_inverse=True)
            for n in range(b.num_columns - 2):
                gram, at, bits = _column_grams(b.column(f"t{n}").to_pylist(), block, b.column("__place").to_numpy().astype(np.int64))
                if len(gram):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), n, np.int32)), gram, pa.array(blocks[at]), pa.array(bits)], ["c", "gram", "__block", "bits"])


def candidates(spark: SparkSession, folder: str, needle: str, searched: list[str] | None = None) -> DataFrame | None:
    """(__block, bits): the rows with every gram of the needle in one searched column; None where it is too short to tell."""
    at = Pointers(spark, folder)
    state, wanted = at.latest(), needle.strip().lower()
    if len(wanted) < GRAM:
        return None
    columns = [state["searched"].index(c) for c in searched or state["searched"]]
    asked = sorted({wanted[i : i + GRAM] for i in range(len(wanted) - GRAM + 1)})  # as many as the needle is long
    n = len(asked)
    found = spark.read.parquet(f"{at.folder}/{state['at']}/grams").filter(F.col("c").isin(columns) & F.col("gram").isin(asked))
    found = found.groupBy("c", "gram", "__block").agg(F.bit_or("bits").alias("bits"))
    both = found.groupBy("c", "__block").agg(F.bit_and("bits").alias("bits"), F.count("*").alias("n")).filter((F.col("n") == n) & (F.col("bits") != 0))
    return both.groupBy("__block").agg(F.bit_or("bits").alias("bits"))


def found_rows(spark: SparkSession, folder: str, in_lists: dict[str, list], needle: str = "", searched: list[str] | None = None) -> DataFrame:
    """The rows that ``apply_filters`` gives, of an index: those that may hold the needle are tested, and no others read whole."""
    at = Pointers(spark, folder)
    state = at.latest()
    rows = spark.read.parquet(f"{at.folder}/{state['at']}/rows")
    few = candidates(spark, folder, needle, searched)
    if few is not None:
        rows = rows.join(few, "__block").filter(F.expr("(shiftright(bits, __place) & 1L) = 1L")).drop("bits")
    return apply_filters(rows.drop("__block", "__place"), in_lists, needle, searched or state["searched"])


def page_count(rows: DataFrame, size: int) -> int:
    """How many pages of the viewer the rows fill, one at least."""
    return max(1, -(-rows.count() // size))


def page_of(rows: DataFrame, number: int, size: int, *order: str) -> DataFrame:
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def facets(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, value): the distinct values that aren't empty, of all columns in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])
    return rows.select(F.inline(pairs)).filter("value <> ''").distinct()


def document_options(chunks: DataFrame, key: str = "document_id", order: str = "chunk_index") -> DataFrame:
    """A label for each document, from its first chunk."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(order))
    label = F.concat(F.when(F.coalesce("tag", F.lit("")) != "", F.concat(F.lit("["), F.col("tag"), F.lit("] "))).otherwise(""), F.col("source"), F.lit(" · "), F.col("source_path"))
    return chunks.withColumn("__n", first).filter("__n = 1").select(key, label.alias("label"))


def question_table(questions: DataFrame) -> DataFrame:
    """(id, active, question, category, pages): the pages as ``source p.N``, parted by commas; questions as the store
    gives them."""
    pages = F.array_join(F.transform("pages", lambda p: F.concat(p["source"], F.lit(" p."), p["page"].cast("string"))), ", ")
    return questions.select("id", "active", "question", "category", pages.alias("pages"))


def _label(column: Column, **labels: str) -> Column:
    known = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.try_element_at(known, column), column)


def evaluation_table(evaluations: DataFrame) -> DataFrame:
    """Evaluations as the store keeps them, newest first: labels, a shortened hash, the settings and chosen metrics."""
    c = F.from_json("config", "mode string, distance string, instruction string, augment boolean, top_k int")
    m = F.from_json("metrics", "hit_at_k double, recall_at_k double, mrr_at_k double, failures long")
    told = evaluations.withColumns({"__c": c, "__m": m})
    return told.select(
        "id", "name", _label(F.col("status"), running="Running", completed="Completed", failed="Failed").alias("status"),
        F.substring("dataset_hash", 1, 10).alias("dataset"), "question_count",
        _label(F.col("__c.mode"), vector="Vector", bm25="BM25", hybrid="Hybrid").alias("mode"),
        F.coalesce(_label(F.col("__c.distance"), cosine="Cosine", l2="L2"), F.lit("—")).alias("distance"),
        (F.coalesce(F.col("__c.instruction"), F.lit("")) != "").alias("instruction"), F.coalesce("__c.augment", F.lit(False)).alias("augment"),
        F.col("__c.top_k").alias("k"), "__m.hit_at_k", "__m.recall_at_k", "__m.mrr_at_k", "__m.failures",
    ).orderBy(F.desc("id"))


def failures_only(results: DataFrame) -> DataFrame:
    return results.filter(F.col("failure") | (F.coalesce("error", F.lit("")) != ""))


def table_rows(chunks: DataFrame, full_text: bool = False) -> DataFrame:
    """The viewer's nine columns, with whole or shortened texts."""
    text = F.col("text") if full_text else T.shorten("text", 220)
    return chunks.select(F.col("source").alias("document"), "source_type", "tag", F.col("page_start").alias("page"), "page_chunk_index", F.col("token_count").alias("tokens"), F.col("parser_model").alias("model"), "source_path", text.alias("text"))


def score_parts(hits: DataFrame) -> DataFrame:
    """Diagnostics of ranked hits; only what is there is shown."""
    have = set(hits.columns)
    parts = [("sources", "sources", "%s"), ("rrf_score", "rrf", "%.6f"), ("vector_rank", "vector rank", "%d"), ("distance", "distance", "%.6f"), ("bm25_rank", "bm25 rank", "%d"), ("bm25_score", "bm25", "%.6f")]
    shown = []
    for column, name, form in parts:
        if column in have:
            value = F.nullif(F.array_join(column, ","), F.lit("")) if column == "sources" else F.col(column).cast("double" if "f" in form else "long")
            shown.append(F.when(value.isNotNull(), F.format_string(f"{name}={form}", value)))
    return hits.withColumn("scores", F.concat_ws(" · ", *shown))


def verdict(checks: DataFrame, *report: str) -> DataFrame:
    """Whether all required checks (ok, required) of each report are ok."""
    return checks.groupBy(*report).agg(F.bool_and(F.col("ok") | ~F.col("required")).alias("healthy"))
