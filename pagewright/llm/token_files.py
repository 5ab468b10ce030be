"""Token files: flat unsigned ids, 64-bit document offsets, memory-mapped.

Format. A folder of shards in ascending order of document id. A shard is ``NAME.bin`` (all its ids, little-endian
unsigned 16 or 32 bit, one document after another), ``NAME.idx`` (64-bit little-endian offsets into it, in ids: one for
each document and one for the end) and ``NAME.doc`` (64-bit document ids). The manifest has a row for each shard with
its rows and ids; the prefix sums over it are the bases that make a shard's offsets global.

Scale. Documents are range-partitioned by quantiles of their id, tokenised, sorted and streamed into their shard's
files in the shared folder: a task holds one Arrow batch. The driver sees the manifest alone. A file name holds the
attempt that wrote it and only the attempt that succeeded is in the manifest, so repeated or speculative tasks do no harm.

Defined results. Null text: the end id alone. Very long texts: a row held by one task. Null id: read as the least id,
-2**63, and given back as null. Repeated ids: a document each, in order of text. An empty table: no shards, no rows.
Extra columns don't take part. The folder must be on a file system that the workers' pyarrow opens (local or shared
disks, HDFS, object stores); a path without scheme lies on Spark's default file system.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import parts_for, qualified, quantiles, range_of, shared_folder, table
from pagewright.llm.tokens import tokenized
from pagewright.llm.vocab import library_word_ids

END_ID, WIDTH = 1, 2
_NULL_ID = -(1 << 63)
MANIFEST = "shard int, name string, n_docs long, n_tokens long"


def _file(folder: str, name: str) -> tuple[pafs.FileSystem, str]:
    fs, path = pafs.FileSystem.from_uri(folder)
    return fs, f"{path}/{name}"


def write_token_files(docs: DataFrame, folder: str, path: str, encoder=library_word_ids, end_id: int | None = END_ID, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> list[tuple]:
    """Writes the shards below ``folder`` and returns the manifest: (shard, name, n_docs, n_tokens), ascending."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("k"), F.col(text_col).alias("text"))
    splitters, folder = quantiles(rows, "k", parts_for(docs)), qualified(docs.sparkSession, folder)
    rows = rows.withColumn("shard", range_of(F.col("k"), splitters)).repartitionById(len(splitters) + 1, F.col("shard"))
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, shard, counts = "", None, [0, 0]
        files: list = []
        for b in batches:
            if not b.num_rows:
                continue
            if not files:
                shard = b.column("shard")[0].as_py()
                name = f"{shard:06d}-{uuid.uuid4().hex}"
                fs, at = _file(folder, name)
                fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
                files = [fs.open_output_stream(f"{at}.{x}") for x in ("bin", "idx", "doc")]
                files[1].write(np.zeros(1, "<i8").tobytes())
            ends = counts[1] + np.cumsum(b.column("n_tokens").to_numpy())
            for out in b.column("ids").to_pylist():
                files[0].write(out)
            files[1].write(ends.astype("<i8").tobytes())
            files[2].write(b.column("k").to_numpy().astype("<i8").tobytes())
            counts = [counts[0] + b.num_rows, int(ends[-1])]
        for f in files:
            f.close()
        if files:
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "name": [name], "n_docs": pa.array([counts[0]], pa.int64()), "n_tokens": pa.array([counts[1]], pa.int64())})

    written = tokenized(rows.sortWithinPartitions("shard", "k", "text"), encoder, path, end_id, width, then=write, then_schema=MANIFEST)
    return sorted(map(tuple, written.collect()))


class Flat:
    """A flat file of numbers, memory-mapped on a local disk; elsewhere slices are read as they are asked for."""

    def __init__(self, folder: str, name: str, kind: str):
        fs, path = _file(folder, name)
        self.kind, self.mapped = np.dtype(kind), None
        size = fs.get_file_info(path).size
        self.n = size // self.kind.itemsize
        if isinstance(fs, pafs.LocalFileSystem):
            self.mapped = np.memmap(path, kind, "r") if size else np.zeros(0, kind)
        else:
            self.file = fs.open_input_file(path)

    def __getitem__(self, part: slice) -> np.ndarray:
        if self.mapped is not None:
            return self.mapped[part]
        lo, hi, _ = part.indices(self.n)
        return np.frombuffer(self.file.read_at(max(0, hi - lo) * self.kind.itemsize, lo * self.kind.itemsize), self.kind)


def read_token_files(spark: SparkSession, folder: str, manifest: list[tuple], width: int = WIDTH) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    kind, folder = f"<u{width}", qualified(spark, folder)
    bases = np.concatenate(([0], np.cumsum([m[3] for m in manifest], dtype=np.int64)))
    shards = spark.createDataFrame([(i, *m, int(bases[i])) for i, m in enumerate(manifest)], f"i int, {MANIFEST}, base long")
    shards = shards.repartitionById(max(1, len(manifest)), F.col("i"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                offsets, keys, ids = (Flat(folder, f"{row['name']}.{x}", k) for x, k in (("idx", "<i8"), ("doc", "<i8"), ("bin", kind)))
                for lo in range(0, keys.n, 1024):
                    k, at = np.array(keys[lo : lo + 1024], np.int64), np.array(offsets[lo : lo + 1025], np.int64)
                    crc = [zlib.crc32(ids[x:y].astype("<u4").tobytes()) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(k, mask=k == _NULL_ID), pa.array(at[:-1] + row["base"]), pa.array(np.diff(at)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    manifest = write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(spark, folder, manifest)
