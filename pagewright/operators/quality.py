"""Quality gates of extracted pages, and what is left to extract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import text as T

MIN_REFERENCE_TOKENS, MIN_COVERAGE = 40, 0.65


def reference_coverage(pages: DataFrame, key: list[str], reference: str, markdown: str) -> DataFrame:
    """The share of the reference's tokens (as a multiset) that the markdown has; null, and no issue, for short references.
    Both sides are in one row, so nothing is shuffled: the n-th of equal tokens is told apart, and arrays are intersected."""
    rows = pages.withColumns({"__r": F.sort_array(T.coverage_tokens(reference)), "__m": F.sort_array(T.coverage_tokens(markdown))})
    rows = rows.withColumns({"__ri": T.run_starts("__r"), "__mi": T.run_starts("__m")})

    def told(ordered: str, places: str) -> Column:
        def each(i: Column, j: Column) -> Column:
            last = F.coalesce(F.get(places, j + 1), F.size(ordered)) - i - 1
            return F.transform(F.sequence(F.lit(0), last), lambda n: F.concat(F.get(ordered, i), F.lit(" "), n.cast("string")))

        return F.flatten(F.transform(places, each))

    sums = rows.withColumns({"tokens": F.size("__r").cast("long"), "found": F.size(F.array_intersect(told("__r", "__ri"), told("__m", "__mi"))).cast("long")})
    out = sums.select(*key, "tokens", "found")
    coverage = F.when(F.col("tokens") >= MIN_REFERENCE_TOKENS, F.round(F.col("found") / F.col("tokens"), 6))
    return out.withColumn("coverage", coverage).withColumn("issue", F.coalesce(coverage < MIN_COVERAGE, F.lit(False)))


def accepted(raw: Column, stop_reason: Column) -> Column:
    """The validated markdown of a response: ended by itself, parseable, complete; else null."""
    text = T.response_markdown(raw)
    return F.when((stop_reason == "end_turn") & ~T.completeness_issue(text), text)


CACHE_KEY = ["source_sha256", "parser_model", "prompt_version", "context_pages"]


def pending_sources(sources: DataFrame, cache: DataFrame) -> DataFrame:
    """Sources without a complete cache entry under all four keys."""
    complete = F.coalesce("complete", F.lit(True)) & (F.coalesce("total_pages", F.size("page_numbers")) == F.size("page_numbers"))
    return sources.join(cache.filter(complete).select(*CACHE_KEY), CACHE_KEY, "left_anti")


def resumable(cache: DataFrame) -> DataFrame:
    """Partial entries that a run can go on from, with the next page: said to be partial, and exactly pages 1 to n in
    order, n below the total."""
    n = F.size("page_numbers")
    prefix = (n > 0) & (F.col("page_numbers") == F.sequence(F.lit(1), F.greatest(n, F.lit(1))))
    return cache.filter(F.col("complete").eqNullSafe(False) & prefix & (n < F.col("total_pages"))).withColumn("next_page", n + 1)


def over_budget(pages: DataFrame, key: str, most_pages: int = 200) -> DataFrame:
    return pages.groupBy(key).agg(F.count("*").alias("pages")).filter(F.col("pages") > most_pages)
