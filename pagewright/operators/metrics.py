"""Retrieval quality of each question and of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import text as T

DIGITS = 9


def score_retrieval(questions: DataFrame, expected: DataFrame, retrieved: DataFrame, k: int) -> DataFrame:
    """One row for each question (query_id), also without hits: expected (query_id, document_id, page), retrieved
    (query_id, rank, document_id, page). Questions without expected pages are an error, as a division by zero."""
    pages = expected.select("query_id", T.strip(F.col("document_id").cast("string")).alias("document_id"), "page").distinct()
    counts = pages.groupBy("query_id").agg(F.count("*").alias("expected_count"))
    top = retrieved.filter(F.col("rank") <= k).select("query_id", "rank", T.strip(F.col("document_id").cast("string")).alias("document_id"), "page")
    marked = top.join(pages.withColumn("hit", F.lit(True)), ["query_id", "document_id", "page"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    page = F.struct("document_id", "page")
    found = marked.groupBy("query_id").agg(
        F.count("*").alias("retrieved_count"),
        F.count_distinct(F.when(F.col("hit") & (F.col("rank") == 1), page)).alias("relevant_at_1"),
        F.count_distinct(F.when(F.col("hit"), page)).alias("relevant_at_k"),
        F.min(F.when(F.col("hit"), F.col("rank"))).alias("first_relevant_rank"),
        F.count_if(~F.col("hit")).alias("false_positives"),
    )
    out = questions.select("query_id").join(counts, "query_id", "left").join(found, "query_id", "left").na.fill(0, ["expected_count", "retrieved_count", "relevant_at_1", "relevant_at_k", "false_positives"])
    first = F.col("first_relevant_rank")
    return out.select(
        "query_id", "expected_count", "retrieved_count", "relevant_at_1", "relevant_at_k", first, "false_positives",
        F.when(first == 1, 1.0).otherwise(0.0).alias("hit_at_1"),
        F.when(first.isNotNull(), 1.0).otherwise(0.0).alias("hit_at_k"),
        F.round(F.col("relevant_at_1") / F.col("expected_count"), DIGITS).alias("recall_at_1"),
        F.round(F.col("relevant_at_k") / F.col("expected_count"), DIGITS).alias("recall_at_k"),
        F.round(F.col("relevant_at_k") / F.lit(k), DIGITS).alias("precision_at_k"),
        F.round(F.coalesce(1 / first, F.lit(0.0)), DIGITS).alias("mrr_at_k"),
        first.isNull().alias("failure"),
    )


def discrete_percentile(rows: DataFrame, by: list[str], value: str, share: float, accuracy: int = 10_000) -> DataFrame:
    """(by, n, percentile): the nearest-rank percentile of the values that aren't null, exact, without holding a group's
    values: an approximate percentile brackets the rank (its error is below 1 / accuracy of the rows), and only values
    inside the bracket are counted one by one; those below it are one number."""
    told = rows.filter(F.col(value).isNotNull())
    low, high = max(0.0, share - 2 / accuracy), min(1.0, share + 2 / accuracy)
    marks = told.groupBy(*by).agg(F.count("*").alias("n"), F.percentile_approx(value, F.array(F.lit(low), F.lit(high)), accuracy).alias("__b"))
    inside = told.join(marks, by).filter(F.col(value) <= F.col("__b")[1])
    counts = inside.groupBy(*by, "n", F.when(F.col(value) >= F.col("__b")[0], F.col(value)).alias("__v")).agg(F.count("*").alias("__c"))
    upto = F.sum("__c").over(Window.partitionBy(*by).orderBy(F.asc_nulls_first("__v")))
    return counts.withColumn("__upto", upto).filter((F.col("__upto") >= F.ceil(F.lit(share) * F.col("n"))) & F.col("__v").isNotNull()).groupBy(*by, "n").agg(F.min("__v").alias("percentile"))


MEANS = ["hit_at_1", "hit_at_k", "recall_at_1", "recall_at_k", "precision_at_k", "mrr_at_k"]


def aggregate_metrics(results: DataFrame, latency: str = "latency_ms", error: str = "error") -> DataFrame:
    """One row for the run: macro means, sums, and the mean and nearest-rank 95th percentile of latency (a run's questions
    are few: the percentile holds their distinct latencies; ``discrete_percentile`` doesn't)."""
    return results.agg(
        F.count("*").alias("questions"),
        *[F.round(F.avg(m), 6).alias(m) for m in MEANS],
        F.sum("false_positives").alias("false_positives"),
        F.count_if("failure").alias("failures"),
        F.count_if(F.coalesce(F.col(error), F.lit("")) != "").alias("errors"),
        F.round(F.avg(latency), 6).alias("mean_latency_ms"),
        F.expr(f"percentile_disc(0.95) within group (order by {latency})").alias("p95_latency_ms"),
    )


def ranked(rows: DataFrame, *order, key: str = "query_id") -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
