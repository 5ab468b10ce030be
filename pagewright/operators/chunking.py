"""Page-local chunks within token limits, with an overlap of whole lines: a fold over a page's lines, inside its row.

Lines are told apart by numbers alone: prefix sums of their tokens and of the lines that aren't blank. The fold's state is
a run of lines that is held, from ``s`` to the line at hand, of which those from ``new`` on haven't been in a chunk, and
the chunks so far, as (from, to, oversize). Tokens never span lines, so a run's count is a difference of prefix sums.

- A line over the limit is a chunk of its own, and closes the run before it.
- A run closes before a line that would take it over the limit, and before a heading once it has reached the target; the
  next run starts with the longest run of last lines within the overlap, or with the line itself if both don't fit.
- A run closes after a blank line once it has reached the target, and the page's last run closes at its end.
- A run that closes is a chunk if it isn't blank, and isn't an overlap alone (which it may be on a page without chunks).

Plain expressions of arrays: no Python worker, no shuffle; a page's cost is in proportion to its lines. Defined results: a null,
empty or blank page has no chunks; repeated rows have equal chunks; null ids are ``null`` in the hashed text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators.numbering import numbered

SCHEMA_VERSION = 3


@dataclass(frozen=True)
class ChunkLimits:
    target: int = 700
    most: int = 900
    overlap: int = 100

    @property
    def carried(self) -> int:
        return min(self.overlap, max(0, self.most - 1))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with the value bound to a name, so that it is worked out once however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(numbers: Column, start: Column) -> Column:
    """The prefix sums of a short array of whole numbers, after a start; an array grows with each step."""
    return F.slice(F.aggregate(numbers, F.array(start), lambda sums, n: F.concat(sums, F.array(F.element_at(sums, -1) + n))), 2, F.size(numbers))


def _sums(numbers: Column) -> Column:
    """0 and the prefix sums of an array of whole numbers, by blocks of about the square root of its size."""
    width = F.ceil(F.sqrt(F.size(numbers))).cast("int")

    def of_blocks(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda total, n: total + n))
        return _let(F.concat(F.array(F.lit(0)), _running(totals, F.lit(0))), lambda bases: F.concat(F.array(F.lit(0)), F.flatten(F.transform(blocks, lambda block, i: _running(block, F.get(bases, i))))))

    cut = lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / w).cast("int")), lambda i: F.slice(numbers, i * w + 1, w))
    return F.when(F.size(numbers) == 0, F.array(F.lit(0))).otherwise(_let(_let(width, cut), of_blocks))


def spans(tokens: Column, shown: Column, headings: Column, limits: ChunkLimits) -> Column:
    """The chunks of a page as (a, b, oversize), lines a to b - 1, from the sums of its lines' tokens, the sums of its lines
    that aren't blank, and whether a line is a heading."""
    count = lambda a, b: F.get(tokens, b) - F.get(tokens, a)
    none = F.array().cast("array<struct<a:int,b:int,oversize:boolean>>")

    def chunk(state: Column, s: Column, new: Column, end: Column) -> Column:
        """The chunks so far and the run from s to end, if it is one."""
        is_one = (F.get(shown, end) > F.get(shown, s)) & ((end > new) | (F.size(state["out"]) == 0))
        return F.when(is_one, F.concat(state["out"], F.array(F.struct(s.alias("a"), end.alias("b"), F.lit(False).alias("oversize"))))).otherwise(state["out"])

    def carried(s: Column, end: Column) -> Column:
        """Where the longest run of last lines within the overlap starts."""
        return s + F.size(F.filter(F.slice(tokens, s + 1, end - s), lambda sum_before: F.get(tokens, end) - sum_before > limits.carried))

    def state(s: Column, new: Column, out: Column) -> Column:
        return F.struct(s.cast("int").alias("s"), new.cast("int").alias("new"), out.alias("out"))

    def step(held: Column, i: Column) -> Column:
        own, after = count(i, i + 1), i + 1
        oversize = state(after, after, F.concat(chunk(held, held["s"], held["new"], i), F.array(F.struct(i.alias("a"), after.alias("b"), F.lit(True).alias("oversize")))))
        full = count(held["s"], after) > limits.most
        before = (i > held["s"]) & (full | F.get(headings, i) & (count(held["s"], i) >= limits.target))

        def closed(kept: Column) -> Column:
            """The run closes before the line: what is kept of it goes on, if the line fits after it."""
            return state(F.when(count(kept, after) > limits.most, i).otherwise(kept), i, chunk(held, held["s"], held["new"], i))

        ready = F.when(before, _let(carried(held["s"], i), closed)).otherwise(held)

        def ended(run: Column) -> Column:
            ends = (F.get(shown, after) == F.get(shown, i)) & (count(run["s"], after) >= limits.target)
            return F.when(ends, state(carried(run["s"], after), after, chunk(run, run["s"], run["new"], after))).otherwise(run)

        return F.when(own > limits.most, oversize).otherwise(_let(ready, ended))

    lines = F.size(headings)
    places = F.when(lines > 0, F.sequence(F.lit(0), lines - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, state(F.lit(0), F.lit(0), none), step, lambda held: chunk(held, held["s"], held["new"], lines))


def page_chunks(markdown: Column | str, limits: ChunkLimits = ChunkLimits()) -> Column:
    """(text, token_count, oversize) of each chunk of a page, in order."""
    text = F.coalesce(F.col(markdown) if isinstance(markdown, str) else markdown, F.lit(""))

    def of_lines(lines: Column) -> Column:
        filled = lambda pattern: F.transform(lines, lambda line: line.rlike(pattern))
        counted = F.struct(
            _let(F.transform(lines, T.token_count), _sums).alias("tokens"),
            _let(F.transform(filled(f"^{T.SPACE}*$"), lambda blank: (~blank).cast("int")), _sums).alias("shown"),
            filled(f"^{T.SPACE}*#").alias("headings"),
        )

        def of_counts(c: Column) -> Column:
            part = lambda x: F.struct(T.strip(F.array_join(F.slice(lines, x["a"] + 1, x["b"] - x["a"]), "\n")).alias("text"), (F.get(c["tokens"], x["b"]) - F.get(c["tokens"], x["a"])).alias("token_count"), x["oversize"].alias("oversize"))
            return F.transform(spans(c["tokens"], c["shown"], c["headings"], limits), part)

        return _let(counted, of_counts)

    return _let(T.lines(text), of_lines)


def chunk_id(document_id: str, source_sha256: str, page: str, place: str, text: str) -> Column:
    """The hash of a chunk's canonical JSON, with sorted keys; arguments name columns."""
    plain = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("null"))
    quoted = lambda name: F.coalesce(T.json_string(F.col(name)), F.lit("null"))
    told = {"document_id": quoted(document_id), "page": plain(page), "page_chunk_index": plain(place), "schema_version": F.lit(str(SCHEMA_VERSION)), "source_sha256": quoted(source_sha256), "text": quoted(text)}
    fields = [F.concat(F.lit(f'"{name}": '), value) for name, value in told.items()]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}")), 256)


def chunk_pages(pages: DataFrame, limits: ChunkLimits = ChunkLimits()) -> DataFrame:
    """(chunk_id, document_id, page_start, page_chunk_index, text, token_count, oversize) of pages (document_id,
    source_sha256, page_number, markdown)."""
    rows = pages.select("document_id", "source_sha256", F.col("page_number").cast("int").alias("page_start"), F.posexplode(page_chunks("markdown", limits)).alias("page_chunk_index", "__chunk"))
    rows = rows.select("document_id", "source_sha256", "page_start", "page_chunk_index", "__chunk.*")
    key = chunk_id("document_id", "source_sha256", "page_start", "page_chunk_index", "text").alias("chunk_id")
    return rows.select(key, "document_id", "page_start", "page_chunk_index", "text", "token_count", "oversize")


def with_chunk_index(chunks: DataFrame, document_number: str, *order: str) -> DataFrame:
    """The running index over all documents in order, without a single-task window."""
    return numbered(chunks, document_number, *order)
