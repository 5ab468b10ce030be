"""Sharding by sampled splitters: shards of near-equal bytes over an order of text hashes, equal texts together.

The method. The key is the text's hash. Keys are sampled with a chance in proportion to the row's size; the sample's
quantiles are splitters; rows are range-partitioned by them; a range that turned out overfull is subdivided by splitters
from a sample of its own. Groups of equal texts with more than ``1 / HEAVY`` of a shard's bytes (fewer than ``HEAVY *
shards`` of them) stay out of the ranges: each goes whole to the shard with the most room, the largest first, and is cut
only if no shard has room for it. The exact bytes of each range, as prefix sums, then place all other groups, whole as
well, into the room that is left: a group goes where its first byte falls. So a shard misses its equal part by less than
about ``2 / HEAVY`` of it or by one row, whatever the sample was; only a larger single row does more.

Scale. Texts are read once, for a table of (id, size, checksum, hash, number of the row); of that, only the rows are
shuffled, once, and the hashes' sums. A heavy group is spread over as many ranges as its rows need. The driver holds the
splitters, the sums of the ranges, their sample (``SAMPLES_A_RANGE`` numbers each) and the heavy groups. A range is
streamed, never held.

Defined results. Null text: size 1 (no bytes plus 1), and checksum 0, equal to an empty text. Null id: before all ids.
Very long texts: a row of their size. Repeated rows: a slot each. Slots follow (hash, id), or row numbers inside a heavy
group. An empty table: no rows. Extra columns don't take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from pagewright.llm.common import parts_for, shared_folder, table

SHARDS = 16
ROWS_A_RANGE, SAMPLES_A_RANGE, OVERFULL, ROUNDS, HEAVY = 2_000_000, 32, 2.0, 4, 64


def _sampled(rows: DataFrame, samples: int, total: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys, ascending, and weights of a Poisson sample of about ``samples`` rows, each with a chance in proportion to its size."""
    chance = F.col("size") * F.lit(samples / max(total, 1))
    drawn = rows.filter(F.rand(seed) < chance).select("h", F.greatest(F.lit(1.0), chance).alias("w")).toArrow()
    h, w = drawn.column("h").to_numpy(), drawn.column("w").to_numpy()
    order = np.argsort(h, kind="stable")
    return h[order], w[order]


def quantiles_of(sample: tuple[np.ndarray, np.ndarray], parts: int) -> np.ndarray:
    """At most ``parts - 1`` splitters; keys at or above a splitter lie right of it."""
    h, w = sample
    if not len(h) or parts < 2:
        return np.zeros(0, np.int64)
    upto = np.cumsum(w)
    return np.unique(h[np.searchsorted(upto, upto[-1] * np.arange(1, parts) / parts)])


def _with_range(rows: DataFrame, splitters: np.ndarray, heavy: np.ndarray, first: np.ndarray) -> DataFrame:
    """The rows with ``range``: by the splitters, or one of a heavy group's ranges ``first[i]`` to ``first[i + 1] - 1``."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column("h").to_numpy()
            out = np.searchsorted(splitters, h, "right")
            if len(heavy):
                i = np.minimum(np.searchsorted(heavy, h), len(heavy) - 1)
                own = np.flatnonzero(heavy[i] == h)
                i = i[own]
                out[own] = first[i] + b.column("u").to_numpy()[own] % (first[i + 1] - first[i])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out.astype(np.int32))], [*b.schema.names, "range"])

    return rows.mapInArrow(place, StructType([*rows.schema.fields, StructField("range", IntegerType())]))


def places_of(groups: np.ndarray, total: int, shards: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Of each heavy group (bytes, descending): the ends of its pieces and their shards; and the room left in each shard."""
    part = total / shards
    room = np.full(shards, part)
    out = []
    for size in groups.tolist():
        ends, where, left = [], [], float(size)
        while True:
            s = int(room.argmax())
            take = left if left <= room[s] + part / HEAVY or room[s] <= 0 else room[s]
            room[s] -= take
            left -= take
            ends.append(size - left)
            where.append(s)
            if left <= 0:
                break
        out.append((np.array(ends), np.array(where, np.int32)))
    return out, np.maximum(room, 0)


def sharded(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every row, by the law of near-equal bytes."""
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    numbered = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("crc"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("u"))
    numbered.write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")

    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    sums = rows.groupBy("h").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).filter((F.col("n") > 1) & (F.col("bytes") > total / (shards * HEAVY)))
    found = sorted((-r["bytes"], r["h"], r["n"]) for r in sums.collect())  # fewer than shards * HEAVY
    pieces, room = places_of(np.array([-b for b, _, _ in found], np.int64), total, shards)
    order = sorted(range(len(found)), key=lambda i: found[i][1])
    heavy = np.array([found[i][1] for i in order], np.int64)
    light = rows.filter(~F.col("h").isin(heavy.tolist())) if found else rows

    rest = total + sum(b for b, _, _ in found)
    ranges = max(parts_for(docs), 2 * shards, -(-n // ROWS_A_RANGE))
    heavy_ranges = [-(-found[i][2] * ranges // n) for i in order]
    splitters = quantiles_of(_sampled(light, SAMPLES_A_RANGE * ranges, rest, 1), ranges)
    for seed in range(2, 3 + ROUNDS):
        first = len(splitters) + 1 + np.cumsum([0, *heavy_ranges])
        placed = _with_range(rows, splitters, heavy, first)
        held = {r["range"]: r["bytes"] for r in placed.groupBy("range").agg(F.sum("size").alias("bytes")).collect()}
        full = [r for r, b in held.items() if r <= len(splitters) and b > OVERFULL * rest / ranges]
        if not full or seed == 2 + ROUNDS:
            break
        over = sum(held[r] for r in full)
        parts = max(2 * len(full), round(over * ranges / rest))
        finer = np.union1d(splitters, quantiles_of(_sampled(placed.filter(F.col("range").isin(full)), SAMPLES_A_RANGE * parts, over, seed), parts))
        if len(finer) == len(splitters):  # single rows fill the ranges
            break
        splitters = finer

    # where a range's bytes begin: among those of all light ranges, or of its heavy group's
    bases = np.zeros(int(first[-1]), np.int64)
    sizes = np.array([held.get(r, 0) for r in range(int(first[-1]))], np.int64)
    for lo, hi in zip([0, *first[:-1].tolist()], first.tolist(), strict=True):
        bases[lo:hi] = np.cumsum(sizes[lo:hi]) - sizes[lo:hi]
    share = room if room.sum() > 0 else np.ones(shards)
    ends = [np.cumsum(share) * (rest / share.sum()), *(pieces[i][0] for i in order)]
    where = [np.arange(shards, dtype=np.int32), *(pieces[i][1] for i in order)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, byte, last, upto = None, 0, (None, 0), {}
        for b in batches:
            r, size, h = (b.column(x).to_numpy() for x in ("range", "size", "h"))
            shard, place = np.empty(len(r), np.int32), np.empty(len(r), np.int64)
            for lo, hi in _runs(r):
                if r[lo] != now:
                    now, byte, last, upto = int(r[lo]), int(bases[r[lo]]), (None, 0), {}
                queue = int(np.searchsorted(first, now, "right"))
                begin = byte + np.cumsum(size[lo:hi]) - size[lo:hi]
                byte = int(begin[-1] + size[hi - 1])
                if not queue:  # a group goes where its first row does
                    own = h[lo:hi]
                    new = np.concatenate(([own[0] != last[0]], own[1:] != own[:-1]))
                    heads = np.concatenate(([last[1]], begin[new]))[np.cumsum(new)]
                    begin, last = heads, (own[-1], int(heads[-1]))
                s = where[queue][np.minimum(np.searchsorted(ends[queue], begin, "right"), len(ends[queue]) - 1)]
                shard[lo:hi] = s
                for x, y in _runs(s):
                    at = upto.get(int(s[x]), 0)
                    place[lo + x : lo + y] = at + np.arange(y - x)
                    upto[int(s[x])] = at + y - x
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("size"), b.column("crc"), b.column("range"), pa.array(shard), pa.array(place)], ["id", "size", "crc", "range", "shard", "place"])

    spread = placed.repartitionById(int(first[-1]), F.col("range")).sortWithinPartitions("range", "h", "id", "crc", "u")
    spread.select("id", "size", "crc", "h", "range").mapInArrow(deal, f"id {kind}, size long, crc long, range int, shard int, place long").write.parquet(f"{folder}/dealt")
    dealt = spark.read.parquet(f"{folder}/dealt")
    counts = sorted((r["shard"], r["range"], r["count"]) for r in dealt.groupBy("shard", "range").count().collect())
    upto: dict[int, int] = {}
    begins = []
    for s, r, count in counts:
        begins.append((r, s, upto.get(s, 0)))
        upto[s] = upto.get(s, 0) + count
    begins = spark.createDataFrame(begins, "range int, shard int, begin long")
    out = dealt.join(F.broadcast(begins), ["range", "shard"])  # a row or so for each range
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("place") + F.col("begin")).alias("slot"))


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    edges = np.concatenate(([0], np.flatnonzero(x[1:] != x[:-1]) + 1, [len(x)]))
    return [(int(a), int(b)) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a]


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharded(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
