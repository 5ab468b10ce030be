"""Documents to pages and back, and context windows of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import text as T


def split_pages(docs: DataFrame, markdown: str = "markdown") -> DataFrame:
    """A row for each page, with page_number and markdown; documents without pages have none."""
    kept = [c for c in docs.columns if c != markdown]
    return docs.select(*kept, F.inline(T.pages_of(markdown)))


def join_pages(pages: DataFrame, key: str, page: str = "page_number", markdown: str = "markdown") -> DataFrame:
    gathered = F.array_sort(F.collect_list(F.struct(F.col(page).alias("page_number"), F.col(markdown).alias("markdown"))))
    return pages.groupBy(key).agg(gathered.alias("pages")).select(key, T.markdown_of("pages").alias("markdown"))


def window_around(pages: Column, place: Column, size: int = 4) -> Column:
    """``min(size, n)`` pages around place (from 0): as many before as fit, moved in at both ends."""
    width = F.least(F.lit(size), F.size(pages))
    start = F.greatest(F.lit(0), F.least(place - F.floor(width / 2).cast("int"), F.size(pages) - width))
    return F.slice(pages, start + 1, width)


def context_windows(pages: DataFrame, key: str, page: str, size: int = 4) -> DataFrame:
    """(key, page, context): the page numbers that a page is read with."""
    gathered = pages.groupBy(key).agg(F.array_sort(F.collect_list(page)).alias("__pages"))
    placed = gathered.select(key, "__pages", F.posexplode("__pages").alias("__at", page))
    return placed.select(key, page, window_around(F.col("__pages"), F.col("__at"), size).alias("context"))


def requested_pages(requests: DataFrame, rendered: DataFrame, key: str, page: str = "page_number") -> tuple[DataFrame, DataFrame]:
    """Previews: (the requested pages that exist, in order and once each; the invalid ones)."""
    wanted = requests.select(key, F.posexplode(F.array_distinct("pages")).alias("position", page))
    return wanted.join(rendered, [key, page]), wanted.join(rendered.select(key, page), [key, page], "left_anti")
