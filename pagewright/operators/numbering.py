"""Global numbers without a single-task window: counts of ranges, prefix sums over them, a window in each."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Splitters of a group: a value is looked up among the groups' heads, then inside one group.
GROUP = 128


def constant(values: list, kind: str) -> Column:
    """An array of a Spark type as one literal, whatever its length: its text is parsed once, when the plan is made."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def range_of(column: Column, splitters: list, kind: str = "long") -> Column:
    """The number of ascending splitters at or below the value; null is 0. Two passes over arrays of a size near the square
    root of the splitters' number, in one expression of a fixed size, so that thousands of splitters cost the planner nothing."""
    if not splitters:
        return F.lit(0)
    width = max(GROUP, int(len(splitters) ** 0.5))
    groups = [splitters[i : i + width] for i in range(0, len(splitters), width)]
    below = lambda values: F.size(F.filter(values, lambda s: s <= column))
    if len(groups) == 1:
        found = below(constant(splitters, kind))
    else:
        group = below(constant([g[0] for g in groups], kind))
        found = F.when(group == 0, 0).otherwise((group - 1) * width + below(F.get(constant(groups, f"array<{kind}>"), group - 1)))
    return F.when(column.isNull(), 0).otherwise(found).cast("int")


def numbered(rows: DataFrame, key: str, *order: str, name: str = "chunk_index") -> DataFrame:
    """``name``: the rows' places, from 0, in the order of an integer ``key`` and then ``order``."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rows.approxQuantile(key, [i / parts for i in range(1, parts)], 1 / (8 * parts)) if parts > 1 else []
    splitters = sorted({int(x) for x in found})
    placed = rows.withColumn("__range", range_of(F.col(key), splitters))
    counts = {r["__range"]: r["count"] for r in placed.groupBy("__range").count().collect()}  # a row for each range
    base, bases = 0, []
    for i in range(len(splitters) + 1):
        bases.append(base)
        base += counts.get(i, 0)
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(key, *order))
    return placed.withColumn(name, F.get(constant(bases, "long"), F.col("__range")) + inside - 1).drop("__range")


def places(rows: DataFrame, name: str) -> DataFrame:
    """``name``: the rows' places, from 0, in the order in which a stored table is read. The driver gets a row for each partition."""
    at = F.monotonically_increasing_id()  # the partition's number and the row's place in it
    placed = rows.withColumns({"__part": F.shiftright(at, 33).cast("int"), "__row": at.bitwiseAND((1 << 33) - 1)})
    counts = {r["__part"]: r["count"] for r in placed.groupBy("__part").count().collect()}
    base, bases = 0, []
    for i in range(max(counts, default=0) + 1):
        bases.append(base)
        base += counts.get(i, 0)
    return placed.withColumn(name, F.get(constant(bases, "long"), F.col("__part")) + F.col("__row")).drop("__part", "__row")
