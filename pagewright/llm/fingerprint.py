"""Lempel-Ziv phrase fingerprints, and their likeness.

The method. A text's UTF-8 bytes are parsed into dictionary phrases (each the shortest string that isn't yet in the
dictionary); the phrases are hashed to 64 bits; the ``K`` least hashes, cut to their upper 32 bits, are the signature.
Two signatures' likeness estimates the share of phrases that the texts have in common: of the ``K`` least hashes of
either, those in both. A dictionary holds every prefix of its phrases, so membership falls with length and the end of a
phrase is found by a search from the last phrase's length instead of byte by byte.

Scale. Documents are range-partitioned by quantiles of their id, and the first document of each range is sent to the
range before it as well; so each text moves once, and a task meets each document's successor by holding one row back.

Defined results. Null text: as an empty one, whose signature is the empty string; two empty signatures are alike (1.0),
an empty and another one aren't (0.0). Very long texts: a row and its phrases, held by one task. Null id: before all ids.
Repeated ids: in order of text. One document alone is its own successor. An empty table: no rows. Extra columns don't
take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import PrefixHash, constant, parts_for, quantiles, range_of, table

K = 64
_NULL_ID = -(1 << 63)


def phrase_ends(data: bytes, seen: set[bytes], start: int) -> list[int]:
    """The ends of the phrases of ``data[start:]``, which ``seen`` gets; an unfinished last phrase isn't one."""
    ends, n, i, size = [], len(data), start, 1
    note, keep = ends.append, seen.add
    while i < n:
        j = i + size
        if j > n:
            j = n
        p = data[i:j]
        if p in seen:
            while p in seen:
                j += 1
                if j > n:
                    return ends
                p = data[i:j]
        else:
            while j - i > 1 and (q := data[i : j - 1]) not in seen:
                p = q
                j -= 1
        keep(p)
        note(j)
        size = j - i
        i = j
    return ends


def _with_edit(text: bytes, edited: bytes, common: int) -> tuple[list[int], list[int]]:
    """The phrase ends of both, which share their first ``common`` bytes and so the phrases that end there."""
    seen: set[bytes] = set()
    head = phrase_ends(text[:common], seen, 0)
    at = head[-1] if head else 0
    rest = phrase_ends(text, set(seen), at) if text != edited else None
    other = phrase_ends(edited, seen, at)
    return head + (other if rest is None else rest), head + other


def signatures(texts: list[bytes], ends: list[list[int]], k: int = K) -> list[np.ndarray]:
    """The ``k`` least phrase hashes of each text, ascending, 32 bits each."""
    hashed = PrefixHash(np.frombuffer(b"".join(texts), np.uint8))
    base = np.cumsum([0, *map(len, texts)])
    counts = [len(e) for e in ends]
    stop = np.concatenate([np.asarray(e, np.int64) + base[i] for i, e in enumerate(ends)] or [np.zeros(0, np.int64)])
    start = np.concatenate(([0], stop[:-1])) if len(stop) else stop
    first = np.cumsum([0, *counts])
    some = [i for i, c in enumerate(counts) if c]
    start[first[some]] = base[some]
    h = (hashed(start, stop) >> np.uint64(32)).astype(np.uint32)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        own = h[a:b]
        out.append(np.unique(np.partition(own, k - 1)[:k] if len(own) > k else own))
    return out


def likeness(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    x, y = set(a.tolist()), set(b.tolist())
    least = sorted(x | y)[:k]
    return len([v for v in least if v in x and v in y]) / len(least)


def _hex(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def _successors(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(range, tail, k, text), partitioned by range and sorted: each range's documents and, as its tail, the first of the next."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    splitters = quantiles(rows, "k", parts_for(docs))
    ids = rows.select("k", range_of(F.col("k"), splitters).alias("range"))
    firsts = sorted((r["range"], r["k"]) for r in ids.groupBy("range").agg(F.min("k").alias("k")).collect())  # one row a range
    first, before = [None] * (len(splitters) + 1), [None] * (len(splitters) + 1)
    for i, (r, k) in enumerate(firsts):
        first[r], before[r] = k, firsts[i - 1][0]
    rows = rows.withColumn("range", range_of(F.col("k"), splitters))

    def look_up(values: list) -> F.Column:
        return F.get(constant(values, "long"), F.col("range"))

    own = F.struct(F.col("range").alias("r"), F.lit(False).alias("tail"))
    copy = F.struct(look_up(before).cast("int").alias("r"), F.lit(True).alias("tail"))
    places = F.when(F.col("k") == look_up(first), F.array(own, copy)).otherwise(F.array(own))
    spread = rows.select("k", "text", F.explode(places).alias("p")).select(F.col("p.r").alias("range"), F.col("p.tail").alias("tail"), "k", "text")
    return spread.repartitionById(len(splitters) + 1, F.col("range")).sortWithinPartitions("range", "tail", "k", "text")


def fingerprinted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document: the edit
    puts the start of the next document in place of the text's last half."""
    import hashlib

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def report(rows: list[tuple[int, str]], after: str) -> pa.RecordBatch:
        texts, ends, told = [], [], []
        for (key, text), follower in zip(rows, [*(t for _, t in rows[1:]), after], strict=True):
            half = len(text) // 2
            head = text[: len(text) - half]
            edited = (head + follower[:half]).encode()
            raw = text.encode()
            a, b = _with_edit(raw, edited, len(head.encode()))
            texts += [raw, edited]
            ends += [a, b]
            told.append((None if key == _NULL_ID else key, len(text), hashlib.sha256(edited).hexdigest()))
        last = after.encode()
        found = signatures([*texts, last], [*ends, phrase_ends(last, set(), 0)], k)
        own, changed = found[:-1:2], found[1:-1:2]
        near = [(likeness(a, b, k), likeness(a, c, k)) for a, b, c in zip(own, changed, [*own[1:], found[-1]], strict=True)]
        columns = [*zip(*told, strict=True), map(_hex, own), map(_hex, changed), *zip(*near, strict=True)]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, str]] = []
        size = 0
        for b in batches:
            for tail, key, text in zip(b.column("tail").to_pylist(), b.column("k").to_pylist(), b.column("text").to_pylist(), strict=True):
                if tail:
                    if held:
                        yield report(held, text)
                    held, size = [], 0  # of several tails, which share an id, the first is the successor
                    continue
                if size > 1 << 19:
                    yield report(held, text)
                    held, size = [], 0
                held.append((key, text))
                size += len(text)

    out = _successors(docs, id_col, text_col).mapInArrow(parse, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("doc_id", id_col)


def op1_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprinted(table(spark, sf_dir, "documents"))
