"""Model calls stay outside plans, behind these small interfaces; the fakes are deterministic."""

from __future__ import annotations

import hashlib
import ipaddress
from collections.abc import Callable, Iterator
from typing import Protocol
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class Generator(Protocol):
    def __call__(self, messages: list[dict[str, str]]) -> str: ...


def hash_embedder(dimension: int = 64) -> Embedder:
    """Unit vectors from hashed words: equal texts are equal, and texts with common words are near."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(dimension)
            for word in text.lower().split() or [""]:
                h = hashlib.sha256(word.encode()).digest()
                v[h[0] % dimension] += 1 - 2 * (h[1] & 1)
            out.append((v / (np.linalg.norm(v) or 1)).tolist())
        return out

    return embed


#: Rows whose texts and vectors a task holds as Python objects at once.
ROWS = 256


def embedded(rows: DataFrame, embed: Embedder, text: str = "text", batch: int = 4) -> DataFrame:
    """The rows with ``embedding``, by batches in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = -(-ROWS // batch) * batch  # the embedder is given the same batches, wherever a slice ends
        for whole in batches:
            for lo in range(0, whole.num_rows, step):
                b = whole.slice(lo, step)
                texts = [t or "" for t in b.column(text).to_pylist()]
                found = [v for i in range(0, len(texts), batch) for v in embed(texts[i : i + batch])]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(pa.float32()))], [*b.schema.names, "embedding"])

    from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("embedding", ArrayType(FloatType()))]))


def retry_delay(attempt: int, jitter: float) -> float:
    return min(16.0, 2.0**attempt) * (0.5 + 0.5 * jitter)


def with_retries(call: Callable[[], str], transient: type[Exception], sleep: Callable[[float], None], jitter: Callable[[], float], most: int = 5) -> str:
    for attempt in range(most):
        try:
            return call()
        except transient:
            sleep(retry_delay(attempt, jitter()))
    return call()


def is_local_endpoint(url: str, allowed: frozenset[str] = frozenset()) -> bool:
    """Loopback, link-local and private addresses, and hosts that are allowed by name."""
    host = (urlsplit(url).hostname or "").lower()
    if host == "localhost" or host in allowed:
        return True
    try:
        address = ipaddress.ip_address(host)
    except ValueError:
        return False
    return address.is_loopback or address.is_link_local or address.is_private and not address.is_unspecified
