"""Exact nearest neighbours by the public definitions of the three distances: every vector compared, or pruned by pivots.

``nearest``. Queries and vectors are packed into blocks of about ``QUERY_BLOCK`` and ``VECTOR_BLOCK`` rows; a row for each
pair of blocks is compared as one product of matrices. Query blocks of up to ``MAX_BROADCAST`` bytes are broadcast, so
vectors aren't moved; larger sets meet the vectors by (block, slice), so that neither side has a hot key. A task passes on its own
top k of each query, which a window then merges. Filters are on the vectors' side, before distances (a prefilter).

``write_cells`` and ``nearest_in_cells``. A written index puts each vector into the cell of its nearest pivot, and cells
into blocks by the distance from the pivot. A query is compared with its own cell first, and with as many next ones as
hold k vectors; the k-th distance found, and the triangle inequality, then tell which shells of which other cells may hold
a nearer one. The rest isn't compared, and the result is the same. Distances are those of ``l2`` or, between vectors of
length one, of ``cosine``; ``dot`` is no metric, and has no bounds of this kind.

Defined results. Vectors that are null, and queries that are, match nothing. Ids may be of any whole or text type, and null,
which comes before all others; ties go to the smaller id. Repeated rows are vectors of their own. Vectors of another
dimension are an error. A distance that isn't a number (the cosine of a zero vector) comes after all others.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pagewright.sources.pointers import GRACE, Pointers
from pagewright.sources.shared import stored

METRICS = ("l2", "cosine", "dot")
QUERY_BLOCK, VECTOR_BLOCK, DIGITS, MAX_BROADCAST = 1024, 2048, 9, 1 << 26
#: Rows of tops that a task holds at most before it passes some on.
HELD = 1 << 21


def _matrix(column: pa.Array) -> np.ndarray:
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("vectors differ in dimension")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def distances(queries: np.ndarray, vectors: np.ndarray, metric: str) -> np.ndarray:
    """Squared l2, 1 - cosine, or 1 - dot product."""
    if queries.shape[1] != vectors.shape[1]:
        raise ValueError("vectors differ in dimension")
    dots = queries @ vectors.T
    if metric == "dot":
        return 1 - dots
    norms_q, norms_v = (np.einsum("ij,ij->i", m, m) for m in (queries, vectors))
    if metric == "cosine":
        with np.errstate(divide="ignore", invalid="ignore"):
            return 1 - dots / np.sqrt(norms_q[:, None] * norms_v[None])
    return np.maximum(0, norms_q[:, None] + norms_v[None] - 2 * dots)


#: What stands for a null id: before every other.
_NULL_ID = -(1 << 63)


def keyed(rows: DataFrame, vector_id: str, column: str) -> tuple[DataFrame, str]:
    """(id, v) without nulls, and the id's type: long, or string, where a mark before each id leaves room for the null one."""
    if isinstance(rows.schema[vector_id].dataType, StringType):
        return rows.select(F.coalesce(F.concat(F.lit("="), F.col(vector_id)), F.lit("")).alias("id"), F.col(column).alias("v")).filter("v is not null"), "string"
    return rows.select(F.coalesce(F.col(vector_id).cast("long"), F.lit(_NULL_ID)).alias("id"), F.col(column).alias("v")).filter("v is not null"), "long"


def shown_id(column: str, kind: str):
    """The id as it was given."""
    return F.when(F.col(column) != "", F.substring(column, 2, 1 << 30)) if kind == "string" else F.when(F.col(column) != _NULL_ID, F.col(column))


def _numbered(queries: DataFrame, by: list[str], column: str) -> DataFrame:
    """The queries with a number ``id``, which stays the same as they are read again, and their vector ``v``."""
    return stored(queries.select(*by, F.col(column).alias("v")).withColumn("id", F.monotonically_increasing_id()))


def ids_of(column: pa.Array) -> np.ndarray:
    return column.to_numpy() if not pa.types.is_string(column.type) else np.array(column.to_pylist(), dtype=np.str_)


def _packed(rows: DataFrame, size: int, kind: str = "long") -> DataFrame:
    """(part, ids, body, n): rows (id, v) as blocks of one partition's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                b = batch.slice(at, size)
                ids = pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column("id"))
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), ids, pa.array([_matrix(b.column("v")).tobytes()], pa.binary()), pa.array([b.num_rows])], ["part", "ids", "body", "n"])

    return rows.mapInArrow(run, f"part long, ids array<{kind}>, body binary, n long")


def least_of(q: np.ndarray, d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k least (distance, id) of each query."""
    order = np.lexsort((ids, d, q))
    q, d, ids = q[order], d[order], ids[order]
    edges = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.zeros(0, np.int64)
    place = np.arange(len(q)) - np.repeat(edges, np.diff(np.append(edges, len(q))))
    top = place < k
    return q[top], d[top], ids[top]


def _checked(metric: str, k: int, allowed: tuple[str, ...] = METRICS) -> None:
    if metric not in allowed or k < 1:
        raise ValueError(f"metric must be one of {allowed} and k at least 1")


def _ranked(found: DataFrame, asked: DataFrame, by: list[str], k: int, kind: str, vector_id: str) -> DataFrame:
    """(by, vector_id, rank, distance) from (q, id, distance)."""
    rank = F.row_number().over(Window.partitionBy("q").orderBy("distance", "id"))
    top = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    return top.join(asked.select(F.col("id").alias("q"), *by), "q").select(*by, shown_id("id", kind).alias(vector_id), "rank", "distance")


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 40, metric: str = "l2", query_id: str | list[str] = "query_id", vector_id: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(query_id, vector_id, rank, distance) of the k nearest vectors of each query; ``query_id`` may be several columns."""
    _checked(metric, k)
    by = [query_id] if isinstance(query_id, str) else list(query_id)
    numbers = _numbered(queries, by, column)
    asked = numbers.select("id", "v").filter("v is not null")
    n, wide = asked.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    blocks = max(1, -(-n // QUERY_BLOCK))
    asked = _packed(asked.repartition(blocks), QUERY_BLOCK).withColumnsRenamed({"part": "block", "ids": "q_ids", "body": "q_body", "n": "q_n"})
    rows, kind = keyed(vectors, vector_id, column)
    packed = _packed(rows, VECTOR_BLOCK, kind)
    packed = packed.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    if 8 * n * wide <= MAX_BROADCAST:
        met = packed.join(F.broadcast(asked), "block")
    else:
        slices = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        met = packed.withColumn("slice", F.pmod(F.xxhash64("ids"), F.lit(slices))).join(asked.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long")))), ["block", "slice"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple] = {}  # of each block of queries that the task meets: its top k so far

        def told(key: bytes) -> pa.RecordBatch:
            q, d, ids = held[key]
            return pa.RecordBatch.from_arrays([pa.array(np.frombuffer(key, np.int64)[q]), pa.array(ids), pa.array(d)], ["q", "id", "distance"])

        for b in batches:
            for i in range(b.num_rows):
                q_ids = np.asarray(b.column("q_ids")[i].values, np.int64)
                matrix = np.frombuffer(b.column("q_body")[i].as_buffer()).reshape(len(q_ids), -1)
                ids = ids_of(b.column("ids")[i].values)
                v = np.frombuffer(b.column("body")[i].as_buffer()).reshape(len(ids), -1)
                key = q_ids.tobytes()
                parts = [held[key]] if key in held else []
                for at in range(0, len(matrix), 256):
                    found = np.round(distances(matrix[at : at + 256], v, metric), DIGITS) + 0.0  # no negative zero
                    ranked = np.where(np.isnan(found), np.inf, found)
                    most = np.partition(ranked, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1]
                    q, j = np.nonzero(ranked <= most[:, None])
                    parts.append((q + at, found[q, j], ids[j]))
                held[key] = least_of(*(np.concatenate(x) for x in zip(*parts, strict=True)), k)
            while sum(len(q) for q, _, _ in held.values()) > HELD:
                most_held = max(held, key=lambda x: len(held[x][0]))
                yield told(most_held)
                del held[most_held]
        for key in held:
            yield told(key)

    out = met.select("q_ids", "q_body", "ids", "body").mapInArrow(run, f"q long, id {kind}, distance double")
    return _ranked(out, numbers, by, k, kind, vector_id)


#: Metrics with bounds by the triangle inequality; most pivots; what bounds allow for, in parts and absolutely.
BOUNDED, PIVOTS, SLACK = ("l2", "cosine"), 256, 1e-6


def _unit(m: np.ndarray, metric: str) -> np.ndarray:
    """Vectors between which the plain distance orders as the metric does."""
    if metric == "l2":
        return m
    norms = np.sqrt(np.einsum("ij,ij->i", m, m))
    return m / np.where(norms > 0, norms, 1)[:, None]


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(distances(x, y, "l2"))


def _radius(distance: np.ndarray, metric: str) -> np.ndarray:
    """The plain distance that a distance of the metric is, widened by what rounding may have taken."""
    wide = np.where(np.isnan(distance), np.inf, distance) + 10.0**-DIGITS
    return np.sqrt(wide if metric == "l2" else 2 * wide) * (1 + SLACK) + SLACK


def write_cells(vectors: DataFrame, folder: str, metric: str = "l2", vector_id: str = "vec_id", column: str = "embedding", pivots: int | None = None, grace: float = GRACE) -> None:
    """Replaces the index of vectors below the folder, by a pointer to a new one. Pivots are a sample of about the square
    root of the vectors' number, ``PIVOTS`` at most; only they and a row for each of them reach the driver. Vectors are
    range-partitioned by cell and distance, so a cell of any size is spread, and moved once."""
    _checked(metric, 1, BOUNDED)
    spark, at = vectors.sparkSession, Pointers(vectors.sparkSession, folder)
    name = f"v-{uuid.uuid4().hex}"
    rows, kind = keyed(vectors, vector_id, column)
    n = rows.count()
    wanted = pivots or min(PIVOTS, max(1, int(n**0.5)))
    chosen = rows.select(F.xxhash64("id", "v").alias("h"), "v").orderBy("h").limit(wanted).collect()
    points = np.unique(_unit(np.array([r["v"] for r in chosen], np.float64), metric), axis=0) if chosen else np.zeros((0, 0))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = _apart(_unit(_matrix(b.column("v")), metric), points)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(cell)), cell])], ["id", "v", "cell", "r"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            edges = np.concatenate(([0], np.flatnonzero(cell[1:] != cell[:-1]) + 1, [len(cell)])) if len(cell) else []
            for lo, hi in zip(edges[:-1], edges[1:]):
                for i in range(int(lo), int(hi), VECTOR_BLOCK):
                    b = batch.slice(i, min(VECTOR_BLOCK, int(hi) - i))
                    ids, r = (pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(c)) for c in ("id", "r"))
                    ends = b.column("r")[0].as_py(), b.column("r")[b.num_rows - 1].as_py()
                    yield pa.RecordBatch.from_arrays([pa.array([int(cell[i])], pa.int32()), ids, pa.array([_matrix(b.column("v")).tobytes()], pa.binary()), r, pa.array([ends[0]]), pa.array([ends[1]]), pa.array([b.num_rows])], ["cell", "ids", "body", "r", "least", "most", "n"])

    element = vectors.schema[column].dataType.simpleString()
    placed = rows.mapInArrow(place, f"id {kind}, v {element}, cell int, r double") if n else rows.select("id", "v", F.lit(0).alias("cell"), F.lit(0.0).alias("r"))
    blocks = placed.repartitionByRange("cell", "r").sortWithinPartitions("cell", "r").mapInArrow(pack, f"cell int, ids array<{kind}>, body binary, r array<double>, least double, most double, n long")
    blocks.write.parquet(f"{at.folder}/{name}/blocks")
    cells = spark.read.parquet(f"{at.folder}/{name}/blocks").groupBy("cell").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most")).collect()  # a row for each pivot
    state = {"version": (at.latest() or {"version": 0})["version"], "at": name, "metric": metric, "kind": kind, "vector_id": vector_id, "n": n}
    at.commit(state | {"pivots": points.tolist(), "cells": sorted([r["cell"], r["n"], r["least"], r["most"]] for r in cells)})
    at.collect(lambda kept: [kept["at"]], grace)


def nearest_in_cells(queries: DataFrame, folder: str, k: int = 40, query_id: str | list[str] = "query_id", column: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """The rows that ``nearest`` gives for the vectors of a written index, and (query_id, compared): with how many vectors each
    query was compared."""
    spark = queries.sparkSession
    state = Pointers(spark, folder).latest()
    if state is None:
        raise FileNotFoundError(folder)
    metric, kind = state["metric"], state["kind"]
    _checked(metric, k, BOUNDED)
    by = [query_id] if isinstance(query_id, str) else list(query_id)
    numbers = _numbered(queries, by, column)
    asked = numbers.select("id", "v").filter("v is not null")
    points = np.array(state["pivots"], np.float64) if state["pivots"] else np.zeros((0, 0))
    cells = np.array([c[0] for c in state["cells"]], np.int64)
    sizes, least, most = (np.array([c[i] for c in state["cells"]], np.float64) for i in (1, 2, 3))
    between = _apart(points, points)
    blocks = spark.read.parquet(f"{folder.rstrip('/')}/{state['at']}/blocks")
    visit = "id long, v array<double>, cell int, d double, radius double"

    def visits(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows or not len(cells):
                    continue
                m = _matrix(b.column("v"))
                d = _apart(_unit(m, metric), points)
                near = d[:, cells]
                order = np.argsort(near, axis=1, kind="stable")
                held = np.take_along_axis(np.broadcast_to(sizes, near.shape), order, 1)
                seen = np.zeros(near.shape, bool)
                np.put_along_axis(seen, order, (np.cumsum(held, 1) - held) < k, 1)  # nearest cells until they hold k
                if first:
                    radius = np.full(len(m), np.inf)
                    take = seen
                else:
                    radius = _radius(b.column("kth").to_numpy(zero_copy_only=False), metric)
                    home = d.argmin(1)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        # of a vector nearer to its pivot than to the query's own: at least so far behind the plane between them
                        plane = (near**2 - d[np.arange(len(m)), home][:, None] ** 2) / (2 * between[home][:, cells])
                    bound = np.maximum.reduce([near - most, least - near, np.nan_to_num(plane, nan=0.0, posinf=0.0, neginf=0.0)])
                    take = ~seen & (bound * (1 - SLACK) - SLACK <= radius[:, None])
                q, c = np.nonzero(take)
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(q)), b.column("v").take(pa.array(q)).cast(pa.list_(pa.float64())), pa.array(cells[c].astype(np.int32)), pa.array(near[q, c]), pa.array(radius[q])], ["id", "v", "cell", "d", "radius"])

        return run

    def compared(visitors: DataFrame) -> DataFrame:
        """(q, id, distance, n): the top k of each query in each block of its cells, and how many vectors it met there."""

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell = batch.column("cell").to_numpy()
                edges = np.concatenate(([0], np.flatnonzero(cell[1:] != cell[:-1]) + 1, [len(cell)])) if len(cell) else []
                for lo, hi in zip(edges[:-1], edges[1:]):
                    for i in range(int(lo), int(hi), QUERY_BLOCK):
                        b = batch.slice(i, min(QUERY_BLOCK, int(hi) - i))
                        listed = [pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(c)) for c in ("id", "d", "radius")]
                        low, high = ((b.column("d").to_numpy() + sign * b.column("radius").to_numpy()) for sign in (-1, 1))
                        yield pa.RecordBatch.from_arrays([pa.array([int(cell[i])], pa.int32()), *listed, pa.array([_matrix(b.column("v")).tobytes()], pa.binary()), pa.array([low.min()]), pa.array([high.max()])], ["cell", "q_ids", "d", "radius", "q_body", "low", "high"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    told = {c: np.asarray(b.column(c)[i].values) for c in ("q_ids", "d", "radius", "r")}
                    ids, r = ids_of(b.column("ids")[i].values), told["r"]
                    v = np.frombuffer(b.column("body")[i].as_buffer()).reshape(len(ids), -1)
                    matrix = np.frombuffer(b.column("q_body")[i].as_buffer()).reshape(len(told["q_ids"]), -1)
                    lo = np.searchsorted(r, told["d"] - told["radius"] - SLACK)
                    hi = np.searchsorted(r, told["d"] + told["radius"] + SLACK, "right")
                    parts, met = [], np.maximum(hi - lo, 0)
                    for q in np.flatnonzero(met).tolist():
                        a, z = int(lo[q]), int(hi[q])
                        found = np.round(distances(matrix[q : q + 1], v[a:z], metric)[0], DIGITS) + 0.0
                        parts.append((np.full(z - a, q), found, ids[a:z]))
                    if not parts:
                        continue
                    q, d, found = least_of(*(np.concatenate(x) for x in zip(*parts, strict=True)), k)
                    counts = np.where(np.concatenate(([True], q[1:] != q[:-1])), met[q], 0)
                    yield pa.RecordBatch.from_arrays([pa.array(told["q_ids"][q]), pa.array(found), pa.array(d), pa.array(counts.astype(np.int64))], ["q", "id", "distance", "n"])

        turns = visitors.withColumn("turn", F.pmod(F.xxhash64("id"), F.lit(64))).repartition("cell", "turn").sortWithinPartitions("cell", "d")
        packed = turns.select("id", "v", "cell", "d", "radius").mapInArrow(pack, "cell int, q_ids array<long>, d array<double>, radius array<double>, q_body binary, low double, high double")
        met = blocks.join(packed, "cell").filter((F.col("low") - SLACK <= F.col("most")) & (F.col("high") + SLACK >= F.col("least")))
        return met.select("q_ids", "d", "radius", "q_body", "ids", "r", "body").mapInArrow(run, f"q long, id {kind}, distance double, n long")

    early = stored(compared(asked.mapInArrow(visits(True), visit)))
    place = F.row_number().over(Window.partitionBy("q").orderBy("distance", "id"))
    kth = early.withColumn("place", place).filter(F.col("place") == k).select(F.col("q").alias("id"), F.col("distance").alias("kth"))
    late = stored(compared(asked.join(kth, "id", "left").withColumn("kth", F.coalesce("kth", F.lit(float("inf")))).mapInArrow(visits(False), visit)))
    found = early.unionByName(late)
    counts = found.groupBy(F.col("q").alias("id")).agg(F.sum("n").alias("compared")).join(numbers.select("id", *by), "id").select(*by, "compared")
    return _ranked(found.drop("n"), numbers, by, k, kind, state["vector_id"]), counts
