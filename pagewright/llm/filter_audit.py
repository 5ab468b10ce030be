"""Audit of five filters in every order: what each removes, what others had removed before, what it alone removes.

The method. A task reads texts from Arrow buffers: bytes are put into classes by a table, prefix sums of the classes give each
text's code points, capitals and symbols, and the words' first bytes its words. Words are hashed from prefix hashes; a
document's hashes are sorted, and neighbours with one hash are compared byte by byte (a document in which two words share
a hash is counted anew by its words). So a document becomes a mask of the filters that it fails. Counts of masks, by part
and label, are then reduced to the steps of all orders: nothing is ever counted by document again.

Scale. Texts are read once, and leave the task as a mask and a SHA-256. The narrow rows are shuffled by id, to meet the
labels, and counted. Which copies of a text are the first is told by two partial aggregates: by (id, text), then the least
id of a text, so a text that a third of all rows hold is one row of each task. A part has 32 masks, whatever it holds;
only those become the 600 rows of a part.

Filters. A: under 200 words; B: 100 * distinct words < 50 * words; C: 100 * capitals > 2 * code points; D: one of the
symbols ``#$%&*|``; E: equal to the text of a smaller id.

Defined results. Null text: empty; so it fails A, and E if an empty one has a smaller id. Null source: part ''. A null id
is neither smaller nor greater than another and has no label. Repeated rows count each; rows with the least id of their text
all pass E. Several labels of an id: good if one is, toxic if one is. Very long texts: a block of their own. An empty
table: no rows. Extra columns don't take part.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import PrefixHash, blocks, flat, shared_folder, table, words_of

FILTERS = "ABCDE"
#: Production parameters, and the symbols of filter D.
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT = 200, 50, 2
SYMBOLS = b"#$%&*|"
_POINT, _CAPITAL, _SYMBOL = 1, 2, 4


def _classes() -> np.ndarray:
    """The class bits of each byte."""
    out = np.zeros(256, np.uint8)
    out[[b for b in range(256) if b & 0xC0 != 0x80]] |= _POINT
    out[ord("A") : ord("Z") + 1] |= _CAPITAL
    out[list(SYMBOLS)] |= _SYMBOL
    return out


def distinct_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray, rows: int, hashes: np.ndarray | None = None) -> np.ndarray:
    """The number of distinct words of each row; ``hashes``: those of the words, their prefix hashes where not given."""
    if not len(start):
        return np.zeros(rows, np.int64)
    h = PrefixHash(data)(start, end) if hashes is None else hashes
    order = np.lexsort((h, row))
    h, row, start, end = h[order], row[order], start[order], end[order]
    same = np.flatnonzero((h[1:] == h[:-1]) & (row[1:] == row[:-1]))
    size = end - start
    equal = size[same] == size[same + 1]
    bad = [same[~equal]]
    pairs = same[equal]
    n = size[pairs]
    ends = np.cumsum(n)
    lo = 0
    while lo < len(pairs):  # the bytes of at most a block of pairs at once
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + (1 << 20), "right")))
        m = n[lo:hi]
        inside = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        differs = data[np.repeat(start[pairs[lo:hi]], m) + inside] != data[np.repeat(start[pairs[lo:hi] + 1], m) + inside]
        bad.append(np.repeat(pairs[lo:hi], m)[differs])
        lo = hi
    out = np.bincount(row, minlength=rows) - np.bincount(row[same], minlength=rows)
    for r in np.unique(row[np.concatenate(bad)]).tolist():
        own = row == r
        out[r] = len({data[a:b].tobytes() for a, b in zip(start[own].tolist(), end[own].tolist(), strict=True)})
    return out


def masks(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each text of a flat column: 1, 2, 4 and 8 for the filters A to D that it fails."""
    rows = len(at) - 1
    kinds = _classes()[data]
    count = lambda bit: np.diff(np.concatenate(([0], np.cumsum(kinds & bit != 0)))[at])
    points, capitals, symbols = (count(bit) for bit in (_POINT, _CAPITAL, _SYMBOL))
    start, end, row = words_of(data, at)
    words = np.bincount(row, minlength=rows)
    fails = [words < MIN_WORDS, 100 * distinct_words(data, start, end, row, rows) < MIN_DISTINCT_PERCENT * words, 100 * capitals > MAX_CAPITAL_PERCENT * points, symbols > 0]
    return sum((f.astype(np.int32) << i for i, f in enumerate(fails)), np.zeros(rows, np.int32))


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, part, h, mask): the text's SHA-256, and the mask of filters A to D."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("h"), text.alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("part"), b.column("h"), pa.array(masks(*flat(b.column("text"))))], ["id", "part", "h", "mask"])

    return rows.mapInArrow(run, f"id {kind}, part string, h binary, mask int")


def _labelled(rows: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """The rows with ``good`` and ``toxic``. Rows without an id have no label; they are spread by their text."""
    one = lambda name: F.max(F.coalesce((F.col(name) == 1).cast("int"), F.lit(0))).alias(name)
    told = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(one("quality"), one("toxic")).withColumnRenamed("quality", "good").withColumn("salt", F.lit(0).cast("long"))
    salted = rows.withColumn("salt", F.when(F.col("id").isNull(), F.xxhash64("h", "part")).otherwise(0))
    zero = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    return salted.join(told, ["id", "salt"], "left").select("id", "salt", "part", "h", "mask", zero("good"), zero("toxic"))


def counted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, good, toxic, n): documents by the mask of all five filters; E is 16."""
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession)
    group = ["part", "mask", "good", "toxic"]
    own = _labelled(scanned(docs, id_col, text_col, part_col), labels, id_col).groupBy("id", "salt", "h", *group).agg(F.count("*").alias("n"))
    own.drop("salt").write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    passing = rows.filter("id is null").select(*group, "n")
    heads = rows.filter("id is not null").groupBy("id", "h").agg(F.collect_list(F.struct(*group, "n")).alias("rows"))
    first = heads.groupBy("h").agg(F.min_by("rows", "id").alias("rows")).select(F.inline("rows"))
    kept = passing.unionByName(first.select(*group, "n"))
    # a copy: counted with all rows, and taken off those that pass
    signed = rows.select(*group, F.lit(16).alias("e"), "n").unionByName(kept.select(*group, F.lit(0).alias("e"), "n")).unionByName(kept.select(*group, F.lit(16).alias("e"), (-F.col("n")).alias("n")))
    out = signed.withColumn("mask", F.col("mask") + F.col("e")).groupBy(*group).agg(F.sum("n").alias("n"))
    return out.filter("n > 0")


def _steps() -> list[dict]:
    """Every order's steps: the filters before, as a mask, and the step's own."""
    out = []
    for order in permutations(range(5)):
        before = 0
        for step, f in enumerate(order):
            out.append({"filter_order": "".join(FILTERS[i] for i in order), "step": step + 1, "before": before, "own": 1 << f})
            before |= 1 << f
    return out


def audited(counts: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step, from counts (part, mask, good, toxic, n). A part is reduced to what
    is left after each of the 32 sets of filters; steps are differences of that."""
    mask, n = F.col("mask"), F.col("n")
    total = lambda when, value=n: F.coalesce(F.sum(F.when(when, value)), F.lit(0).cast("long"))
    left = lambda also: F.array(*[total((mask.bitwiseAND(s) == 0) & also) for s in range(32)])
    # a document is removed by one of the filters that it fails in as many orders as by another
    orders = n * F.element_at(F.array(*[F.lit(120 // k).cast("long") for k in range(1, 6)]), F.greatest(F.bit_count(mask), F.lit(1)))
    by_filter = lambda value, when: F.array(*[total(when(1 << f), value) for f in range(5)])
    parts = counts.groupBy("part").agg(
        left(F.lit(True)).alias("left"),
        left(F.col("good") == 1).alias("good"),
        left(F.col("toxic") == 1).alias("toxic"),
        by_filter(n, lambda bit: mask == bit).alias("alone"),
        by_filter(orders, lambda bit: mask.bitwiseAND(bit) != 0).alias("shares"),
    )
    steps = F.from_json(F.lit(json.dumps(_steps())), "array<struct<filter_order:string,step:int,before:int,own:int>>")
    rows = parts.select("*", F.inline(steps))
    before, own = F.col("before"), F.col("own")
    after, place = before.bitwiseOR(own), F.bit_count(own - 1)
    lost = lambda name: F.get(name, before) - F.get(name, after)
    return rows.select(
        "part",
        "filter_order",
        "step",
        F.get("left", after).alias("kept"),
        lost("left").alias("removed"),
        (F.get("left", F.lit(0)) - F.get("left", own) - lost("left")).alias("redundant"),
        F.get("alone", place).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        F.get("shares", place).alias("shapley"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return audited(counted(docs, table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")))


SQL = r"""
with d as (
  select doc_id, coalesce(text, '') as text, coalesce(source, '') as part from documents
), l as (
  select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id
), w as (
  select doc_id, text, part, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w, min(doc_id) over (partition by text) as least from d
), m as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
         (len(w) < 200)::int + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::int
         + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text))::int
         + 8 * regexp_matches(text, '[#$%&*|]')::int + 16 * coalesce(w.doc_id > least, false)::int as mask
  from w left join l on l.doc_id = w.doc_id
), c as (
  select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from m group by part, mask
), f(f, bit) as (
  values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), o as (
  select a.f || b.f || c.f || d.f || e.f as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
  from f a, f b, f c, f d, f e where a.bit | b.bit | c.bit | d.bit | e.bit = 31
), s as (
  select filter_order, step, bits[step] as own, list_sum(bits[1:step]) - bits[step] as before from (select filter_order, bits, unnest(range(1, 6)) as step from o)
)
select part, filter_order, step::int as step,
       coalesce(sum(n) filter (mask & (own | before)::int = 0), 0)::bigint as kept,
       coalesce(sum(n) filter (mask & own <> 0 and mask & before::int = 0), 0)::bigint as removed,
       coalesce(sum(n) filter (mask & own <> 0 and mask & before::int <> 0), 0)::bigint as redundant,
       coalesce(sum(n) filter (mask = own), 0)::bigint as unique_fails,
       coalesce(sum(good) filter (mask & own <> 0 and mask & before::int = 0), 0)::bigint as good_lost,
       coalesce(sum(toxic) filter (mask & own <> 0 and mask & before::int = 0), 0)::bigint as toxic_lost,
       coalesce(sum(n * (120 // greatest(bit_count(mask), 1))) filter (mask & own <> 0), 0)::bigint as shapley
from c cross join s group by part, filter_order, step
"""
