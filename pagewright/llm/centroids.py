"""Centroid clustering of integer vectors by rounds, with Hamerly's bounds; every number that decides is an exact integer.

The method. Beside its cluster each vector keeps an upper bound of the distance to its own centroid and a lower bound of that
to any other. When centroids move, the upper bound grows by the own centroid's drift and the lower one shrinks by the
largest drift of the others. A vector whose upper bound lies below its lower one, or below half the distance from its
centroid to the next, stays where it is. For the others the upper bound is made exact, and those that are still ambiguous
get a full scan in integers. Bounds are widened by more than floating point can be wrong, and compared strictly, so ties
always come to a scan.

Scale. Vectors are read once; each round reads a table of (id, vector, cluster, bounds) and writes the next, in partitions
that stay as they are: no vector is shuffled. Tasks are given ``k`` centroids of ``dimension`` numbers; what is summed is a row
for each cluster, component and task, added up by Spark, of which the driver gets ``k * dimension``. The round before last is
deleted as soon as the next is written.

Defined results. Vectors that are null, of another length, or hold a null, NaN or infinite component don't take part. A null id
counts as an empty text where the first centroids are drawn, and repeated rows are told apart by nothing: each is a vector of its own;
vectors of equal id are drawn in order of their components. Fewer vectors than ``k``: as many clusters. Equal distances: the
smaller number. An empty table: no rows. Components beyond 2**62 are held there, and distances and sums beyond a long at the greatest one.
Extra columns don't take part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import removed, shared_folder, table

K, DIMENSION, ROUNDS, SCALE = 16, 64, 3, 64
#: Up to this size of components, distances are exact in double precision: 64 products of 2**44 and their sums stay below 2**53.
EXACT = 1 << 22
LONG, HELD = (1 << 63) - 1, 1 << 62
#: Relative and absolute error that the bounds allow for.
SLACK, LEAST = 1e-12, 1e-6


def integer_vectors(rows: DataFrame, vector_col: str = "embedding", dimension: int = DIMENSION, scale: int = SCALE) -> DataFrame:
    """The rows that take part, with ``v``: their components times ``scale``, floored."""
    v = F.col(vector_col)
    whole = (F.size(v) == dimension) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    held = lambda x: F.greatest(F.lit(-float(HELD)), F.least(F.lit(float(HELD)), x))
    return rows.filter(F.coalesce(whole, F.lit(False))).withColumn("v", F.transform(v, lambda x: F.floor(held(x.cast("double") * scale))))


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to rows: longs, or Python's integers where components are large."""
    if max(np.abs(v).max(initial=0), np.abs(c).max(initial=0)) <= EXACT and v.shape[1] <= 64:
        x, y = v.astype(np.float64), c.astype(np.float64)
        return ((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * (x @ y.T)).astype(np.int64)
    x, y = v.astype(object), c.astype(object)
    return np.stack([((x - row) ** 2).sum(1) for row in y], 1)


def squared_own(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to the centroids beside them."""
    if max(np.abs(v).max(initial=0), np.abs(c).max(initial=0)) <= EXACT:
        return ((v - c) ** 2).sum(1)
    return ((v.astype(object) - c.astype(object)) ** 2).sum(1)


def _roots(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64))


class Moved:
    """Centroids, and what the bounds need to know of how they came from those before."""

    def __init__(self, now: np.ndarray, before: np.ndarray | None = None):
        self.now = now
        apart = squared(now, now).astype(np.float64)
        np.fill_diagonal(apart, np.inf)
        self.half = np.sqrt(apart.min(1)) / 2 * (1 - SLACK) - LEAST
        self.drift = _roots(squared_own(now, before)) * (1 + SLACK) + LEAST if before is not None else np.zeros(len(now))
        others = np.array([np.delete(self.drift, i).max(initial=0) for i in range(len(now))])
        self.other_drift = others

    def assigned(self, v: np.ndarray, cluster: np.ndarray | None, upper: np.ndarray | None, lower: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cluster, upper and lower bound of each vector, and which were scanned."""
        n = len(v)
        if cluster is None:
            cluster, upper, lower, scan = np.zeros(n, np.int64), np.zeros(n), np.zeros(n), np.arange(n)
        else:
            upper = (upper + self.drift[cluster]) * (1 + SLACK)
            lower = (lower - self.other_drift[cluster]) - np.abs(lower) * SLACK
            floor = np.maximum(lower, self.half[cluster])
            doubtful = np.flatnonzero(~(upper < floor))
            upper[doubtful] = _roots(squared_own(v[doubtful], self.now[cluster[doubtful]])) * (1 + SLACK) + LEAST
            scan = doubtful[~(upper[doubtful] < floor[doubtful])]
        if len(scan):
            d = squared(v[scan], self.now)
            best = d.argmin(1) if d.dtype != object else np.array([min(range(len(r)), key=r.__getitem__) for r in d], np.int64)
            cluster[scan] = best
            upper[scan] = _roots(d[np.arange(len(scan)), best]) * (1 + SLACK) + LEAST
            rest = d.astype(np.float64)
            rest[np.arange(len(scan)), best] = np.inf
            lower[scan] = np.sqrt(rest.min(1)) * (1 - SLACK) - LEAST
        return cluster, upper, lower, scan


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def _round(rows: DataFrame, moved: Moved, kind: str, last: bool) -> DataFrame:
    """The rows with cluster and bounds under the centroids; of the last round with the exact distance instead."""
    dimension, fresh = moved.now.shape[1], "cluster" not in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column("v"), dimension)
            known = (None, None, None) if fresh else (b.column("cluster").to_numpy().astype(np.int64), b.column("upper").to_numpy().copy(), b.column("lower").to_numpy().copy())
            cluster, upper, lower, scan = moved.assigned(v, *known)
            scans = np.zeros(b.num_rows, np.int32) if fresh else b.column("scans").to_numpy().copy()
            scans[scan] += 1
            if last:
                d = squared_own(v, moved.now[cluster])
                held = d if d.dtype != object else np.array([min(x, LONG) for x in d], np.int64)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(cluster.astype(np.int32)), pa.array(held, pa.int64()), pa.array(scans)], ["id", "cluster", "distance", "scans"])
            else:
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(cluster.astype(np.int32)), pa.array(upper), pa.array(lower), pa.array(scans)], ["id", "v", "cluster", "upper", "lower", "scans"])

    schema = f"id {kind}, cluster int, distance long, scans int" if last else f"id {kind}, v array<long>, cluster int, upper double, lower double, scans int"
    return rows.mapInArrow(run, schema)


def _sums(rows: DataFrame, k: int, dimension: int) -> dict[tuple[int, int], tuple[int, int]]:
    """Of each cluster and component: the number of vectors and the exact sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = np.zeros(k, np.int64), np.zeros((k, dimension), np.int64), np.zeros((k, dimension), np.int64)
        for b in batches:
            v, cluster = _matrix(b.column("v"), dimension), b.column("cluster").to_numpy()
            order = np.argsort(cluster, kind="stable")
            found, first = np.unique(cluster[order], return_index=True)
            if len(found):
                n[found] += np.diff(np.append(first, len(order)))
                high[found] += np.add.reduceat(v[order] >> 32, first, axis=0)
                low[found] += np.add.reduceat(v[order] & 0xFFFFFFFF, first, axis=0)
        c, j = np.nonzero(np.repeat(n[:, None] > 0, dimension, 1))
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(n[c]), pa.array(high[c, j]), pa.array(low[c, j])], ["c", "j", "n", "high", "low"])

    parts = rows.select("v", "cluster").mapInArrow(run, "c int, j int, n long, high long, low long")
    wide = lambda name: F.sum(F.col(name).cast("decimal(38,0)")).alias(name)
    total = parts.groupBy("c", "j").agg(F.sum("n").alias("n"), wide("high"), wide("low"))
    return {(r["c"], r["j"]): (r["n"], (int(r["high"]) << 32) + int(r["low"])) for r in total.collect()}  # k * dimension rows


def clustered(rows: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding", dimension: int = DIMENSION, scale: int = SCALE) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256, scans) of every vector that takes part."""
    spark, folder = rows.sparkSession, shared_folder(rows.sparkSession)
    kind = rows.schema[id_col].dataType.simpleString()
    current = integer_vectors(rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("__v")), "__v", dimension, scale).select("id", "v")
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = current.select(drawn.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    centroids = np.array([r["v"] for r in first], np.int64).reshape(-1, dimension)
    if not len(centroids):
        return spark.createDataFrame([], f"{id_col} {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, scans int")
    moved = Moved(centroids)
    for i in range(rounds):
        _round(current, moved, kind, False).write.parquet(f"{folder}/round{i}")
        if i:
            removed(spark, f"{folder}/round{i - 1}")
        current = spark.read.parquet(f"{folder}/round{i}")
        after = centroids.copy()
        for (c, j), (n, total) in _sums(current, len(centroids), dimension).items():
            after[c, j] = total // n
        moved, centroids = Moved(after, centroids), after
    _round(current, moved, kind, True).write.parquet(f"{folder}/last")
    if rounds:
        removed(spark, f"{folder}/round{rounds - 1}")
    last = spark.read.parquet(f"{folder}/last")
    inertia = {r["cluster"]: int(r["d"]) for r in last.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # k rows
    total = min(sum(inertia.values()), LONG)
    told = [(c, min(inertia[c], LONG), total, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c in sorted(inertia)]
    clusters = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return last.join(F.broadcast(clusters), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "scans")  # k rows


def op12_hamerly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).drop("scans")


def _sql(k: int = K, rounds: int = ROUNDS, dimension: int = DIMENSION) -> str:
    nearest = "{a} as (select rid, c as cluster, d from (select rid, c, d, row_number() over (partition by rid order by d, c) as n from (select v.rid, {m}.c, list_sum(list_transform(list_zip(v.v, {m}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as d from v cross join {m})) where n = 1)"
    parts = [
        f"""v as (
  select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings
  where len(embedding) = {dimension} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {dimension}
)""",
        f"m0 as (select row_number() over (order by h, v) - 1 as c, v from (select sha256('1:' || coalesce(vec_id::varchar, '')) as h, v from v order by h, v limit {k}))",
    ]
    for i in range(rounds):
        parts.append(nearest.format(a=f"a{i}", m=f"m{i}"))
        parts.append(f"""s{i} as (
  select cluster, j, sum(x)::bigint as s, count(*) as n
  from (select cluster, unnest(v.v) as x, unnest(range({dimension})) as j from a{i} join v using (rid)) group by cluster, j
), u{i} as (
  select cluster, list(((s - ((s % n) + n) % n) // n)::bigint order by j) as v from s{i} group by cluster
), m{i + 1} as (
  select m{i}.c, coalesce(u{i}.v, m{i}.v) as v from m{i} left join u{i} on u{i}.cluster = m{i}.c
)""")
    parts.append(nearest.format(a="z", m=f"m{rounds}"))
    return f"""with {", ".join(parts)}
select v.vec_id, z.cluster::int as cluster, z.d::bigint as distance, (sum(z.d) over (partition by z.cluster))::bigint as cluster_inertia,
       (sum(z.d) over ())::bigint as inertia, sha256(list_aggregate(list_transform(m{rounds}.v, lambda x: x::varchar), 'string_agg', ',')) as centroid_sha256
from z join v using (rid) join m{rounds} on m{rounds}.c = z.cluster"""


SQL = _sql()
