"""What the operators share: flat views of Arrow text, bounded blocks, prefix hashes, splitters and shared folders."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators.numbering import constant, range_of  # noqa: F401
from pagewright.sources.shared import removed, shared_folder, top_folder  # noqa: F401

#: Bytes of text that an operator holds as numpy arrays at once (a longer single text is a block of its own).
BLOCK_BYTES = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _checkpoints(spark: SparkSession) -> None:
    """Sets the session's checkpoint folder, if it has none, below the shared one."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"{top_folder(spark)}/checkpoints")


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with its file system, as Spark resolves it: a path without a scheme lies on the default one."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return found.replace("file:/", "file:///", 1) if found.startswith("file:/") and not found.startswith("file://") else found


def checkpointed(df: DataFrame) -> DataFrame:
    """The frame, computed once and kept in the shared folder, so that a lost executor costs no recomputation."""
    _checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def renamed(docs: DataFrame) -> DataFrame:
    """The rows under names by place (u0, u1, ...), which no operator uses for columns of its own."""
    return docs.toDF(*[f"u{i}" for i in range(len(docs.columns))])


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and its n + 1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return body, at - at[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows again, in batches of at most ``limit`` bytes of a text column, or of one row."""
    for batch in batches:
        _, at = flat(batch.column(column))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
            yield batch.slice(first, last - first)
            first = last


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the public splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n + 1 powers of an odd base and of its inverse, modulo 2**64."""
    return tuple(np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, b, np.uint64))), dtype=np.uint64) for b in (base, pow(base, -1, 1 << 64)))


class PrefixHash:
    """Hashes of any slices of a byte array in constant time each: an odd-base polynomial modulo 2**64, scrambled.

    Equal slices have equal hashes wherever they lie. Two bases make 128 bits where one isn't enough. Powers are kept from
    block to block; those for a longer text than ``BLOCK_BYTES`` go with it.
    """

    def __init__(self, data: np.ndarray, base: int = 0x9E3779B97F4A7C15):
        n = len(data)
        with np.errstate(over="ignore"):
            self._power, self._back = _powers(base, BLOCK_BYTES) if n <= BLOCK_BYTES else _powers.__wrapped__(base, n)
            self._sum = np.concatenate(([np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self._power[:n], dtype=np.uint64)))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self._sum[end] - self._sum[start]) * self._back[start] + (end - start).astype(np.uint64))


def words_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word ``[^\\x20\\x09-\\x0D]+`` of the rows of a flat text."""
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    inside = ~gap
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= gap[:-1]
    closes[:-1] &= gap[1:]
    inner = at[1:-1][(at[1:-1] < len(data)) & (at[1:-1] > 0)]  # a row's first byte opens a word, its last one closes one
    opens[inner] = inside[inner]
    closes[inner - 1] = inside[inner - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return start, end, np.searchsorted(at, start, "right") - 1


def quantiles(df: DataFrame, column: str, parts: int) -> list[int]:
    """At most ``parts - 1`` ascending splitters of an integer column; rows at or above a splitter lie right of it."""
    if parts < 2:
        return []
    found = df.approxQuantile(column, [i / parts for i in range(1, parts)], 1 / (8 * parts))
    return sorted({int(x) for x in found})


def parts_for(df: DataFrame) -> int:
    """Shuffle partitions of the session: what range-partitioned operators use as well."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
