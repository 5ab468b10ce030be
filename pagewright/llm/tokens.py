"""Whole texts to token ids, as one binary column of little-endian unsigned integers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StructField, StructType


def id_bytes(vocabulary: int) -> int:
    """Bytes of an id: the smallest of 2 and 4 that holds all ids below ``vocabulary``."""
    return 2 if vocabulary <= 1 << 16 else 4


def tokenized(docs: DataFrame, encoder: Callable[[str], Callable[[str], list[int]]], path: str, end_id: int | None, width: int = 2, text_col: str = "text", then: Callable | None = None, then_schema: str | None = None) -> DataFrame:
    """The rows without their text, with ``ids`` (binary, ``width`` bytes an id, ``end_id`` last) and ``n_tokens``.

    ``encoder(path)`` gives a worker its encoder. Null text is empty. Columns named ids or n_tokens give way. ``then``
    goes on with a task's batches in the same Python worker, to ``then_schema``: a second operator would start workers of
    its own, and workers that are used again for either would each hold an encoder.
    """
    kept = [f for f in docs.schema.fields if f.name not in (text_col, "ids", "n_tokens")]
    kind, end = np.dtype(f"<u{width}"), [] if end_id is None else [end_id]
    schema = StructType([*kept, StructField("ids", BinaryType()), StructField("n_tokens", LongType())])
    names = [f.name for f in kept]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_one = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                ids = [np.array(encode_one(x or "") + end, kind) for x in b.column(text_col).to_pylist()]
                columns = [b.column(n) for n in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([len(x) for x in ids], pa.int64())], [*names, "ids", "n_tokens"])

    rows = docs.select(*names, text_col)
    return rows.mapInArrow(lambda batches: then(encode(batches)), then_schema) if then else rows.mapInArrow(encode, schema)
