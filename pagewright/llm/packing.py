"""Mixture-controlled packing: deficit round-robin over source queues, as a closed form.

The method. Each source is a queue of its documents' tokens, in runs of a quantum (a sixteenth of a window). A window
takes as many runs from each queue as the queue's target share has earned it; what is earned but isn't a whole run, the
deficit, is carried to the next window. Serving the queue with the largest deficit is serving the run with the least
virtual time ``(2j + 1) / (2 * weight)``, j being its place in its queue, so the first x runs served are the x least
virtual times: ``taken`` finds how many are each queue's for any x, and ``ranks`` the x of a run. So any task starts at any
window with the deficits that a sequential run would carry there, across partitions. Inside a window the queues are
served in turn. An exhausted queue's share goes to the others in proportion. What is left of each queue after its whole
runs, less than a quantum, fills the last windows. All windows but the last are full: only the last is padded.
Documents are cut freely, each token lies in one window. Over any stretch of windows a queue is within a quantum or so
of its share.

Scale. Texts are tokenised once, into a table in the shared folder with each document's place in its (part, queue);
the places' bases are prefix sums over one row for each part and queue; a document finds its pieces by itself, in
arrays of at most ``CELLS`` (runs or windows by queues) numbers. The driver holds a name and a total for each queue. The
number of queues changes the time of a run, in proportion, and nothing else.

Defined results. Null text: the end id alone. Null source: a queue of its own. Null or repeated ids, and repeated rows:
a document each. Very long texts: cut into windows like all others. Ties in virtual time: the first queue by name. An
empty table: no rows. Extra columns don't take part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.llm.common import shared_folder, table
from pagewright.llm.tokens import tokenized
from pagewright.llm.vocab import library_byte_ids

WINDOW, END_ID, RUNS_A_WINDOW, WIDTH = 1024, 0, 16, 2
#: Numbers of an array that a task makes at once, or so (a single document's runs are worked off in parts as well).
CELLS = 1 << 20
#: Most rows of bases (parts by queues, about 50 bytes each) that a join broadcasts.
MAX_BROADCAST = 200_000
PIECES = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


def taken(x: np.ndarray, totals: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """How many of the first x runs served are each queue's; one row for each x. Ties go to the first queue."""
    w = weights.astype(np.float64)
    ends = np.unique(np.concatenate(([0.0], totals / w)))  # virtual times at which a queue runs out
    served = np.minimum(ends[:, None] * w, totals).sum(1)
    v = np.interp(x, served, ends)
    out = np.clip(np.floor(v[:, None] * w + 0.5), 0, totals).astype(np.int64)

    def least(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t = np.where(a < totals, (2 * a + 1) / (2 * w), np.inf)
        q = t.argmin(1)
        return q, t[np.arange(len(t)), q]

    def most(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t = np.where(a > 0, (2 * a - 1) / (2 * w), -np.inf)[:, ::-1]
        q = t.argmax(1)
        return t.shape[1] - 1 - q, t[np.arange(len(t)), q]

    live = np.arange(len(x))
    while len(live):  # at most about half as many rounds as there are queues
        a = out[live]
        lack = x[live] - a.sum(1)
        q_in, t_in = least(a)
        q_out, t_out = most(a)
        swap = (lack == 0) & ((t_out > t_in) | ((t_out == t_in) & (q_out > q_in)))  # a rounded threshold
        add, cut = (lack > 0) | swap, (lack < 0) | swap
        out[live[add], q_in[add]] += 1
        out[live[cut], q_out[cut]] -= 1
        live = live[add | cut]
    return out


def _before(t: np.ndarray, totals: np.ndarray, w: np.ndarray) -> np.ndarray:
    """How many runs of each queue have a virtual time below t."""
    n = np.clip(np.floor(t * w + 0.5), 0, totals)
    n -= (n > 0) & ((2 * n - 1) / (2 * w) >= t)  # a rounded threshold
    n += (n < totals) & ((2 * n + 1) / (2 * w) < t)
    return n


def ranks(queue: np.ndarray, run: np.ndarray, totals: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """How many runs are served before each run (queue, place in it)."""
    w = weights.astype(np.float64)
    t = ((2 * run + 1) / (2 * w[queue]))[:, None]
    n = _before(t, totals, w)
    n += (np.arange(len(w)) < queue[:, None]) & (n < totals) & ((2 * n + 1) / (2 * w) == t)
    n[np.arange(len(n)), queue] = run
    return n.sum(1).astype(np.int64)


def pieces_of(queue: np.ndarray, at: np.ndarray, n: np.ndarray, totals: np.ndarray, weights: np.ndarray, window: int = WINDOW) -> dict[str, np.ndarray]:
    """The pieces of documents (queue, place in it, tokens): document, start in it, length, window and offset in it."""
    per = next(r for r in range(min(RUNS_A_WINDOW, window), 0, -1) if window % r == 0)
    quantum = window // per
    whole, rest = totals // quantum, totals % quantum
    served = int(whole.sum())
    base = served * quantum + np.cumsum(rest) - rest  # where the remainders of the queues begin
    step = max(1, CELLS // len(totals))

    runs = (at + n - 1) // quantum - at // quantum + 1
    doc = np.repeat(np.arange(len(at)), runs)
    run = np.arange(len(doc)) - np.repeat(np.cumsum(runs) - runs - at // quantum, runs)
    first, last = np.maximum(run * quantum, at[doc]), np.minimum((run + 1) * quantum, (at + n)[doc])
    q, length = queue[doc], last - first
    place = base[q] + first - whole[q] * quantum  # of remainders; whole runs follow
    full = np.flatnonzero(run < whole[q])
    for lo in range(0, len(full), step):
        own = full[lo : lo + step]
        seq, where = np.unique(ranks(q[own], run[own], whole, weights) // per, return_inverse=True)
        begin = taken(np.minimum(seq * per, served), whole, weights)
        took = taken(np.minimum((seq + 1) * per, served), whole, weights) - begin
        ahead = (np.cumsum(took, 1) - took - begin)[where, q[own]]  # runs of the window's queues that come first
        place[own] = (seq[where] * per + ahead + run[own]) * quantum + first[own] - run[own] * quantum

    cross = np.flatnonzero(place // window != (place + length - 1) // window)  # remainders alone
    upto = (place[cross] // window + 1) * window - place[cross]
    doc, first, place = (np.insert(x, cross + 1, y) for x, y in ((doc, doc[cross]), (first, first[cross] + upto), (place, place[cross] + upto)))
    length = np.insert(length, cross + 1, length[cross] - upto)
    length[cross + np.arange(len(cross))] = upto
    joins = (doc[1:] == doc[:-1]) & (place[1:] == place[:-1] + length[:-1]) & (place[1:] % window > 0)
    heads = np.flatnonzero(np.concatenate(([True], ~joins)))
    return {"doc": doc[heads], "start": first[heads] - at[doc[heads]], "length": np.add.reduceat(length, heads), "sequence_id": place[heads] // window, "offset": place[heads] % window}


def packed(docs: DataFrame, path: str, encoder=library_byte_ids, end_id: int | None = END_ID, window: int = WINDOW, weights: dict[str, float] | None = None, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The pieces of all documents. ``weights``: target shares by source (in proportion; default: each source's tokens)."""
    spark = docs.sparkSession
    name = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("-"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), name.alias("source"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, upto = TaskContext.get().partitionId(), {}
        for b in batches:
            at = []
            for q, n in zip(b.column("source").to_pylist(), b.column("n_tokens").to_pylist(), strict=True):
                at.append(upto.get(q, 0))
                upto[q] = at[-1] + n
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * len(at), pa.int32()), pa.array(at, pa.int64())], [*b.schema.names, "part", "at"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    folder = f"{shared_folder(spark)}/tokens"
    schema = f"doc_id {kind}, source string, ids binary, n_tokens long, part int, at long"
    tokenized(rows, encoder, path, end_id, width, then=place, then_schema=schema).write.parquet(folder)
    tokens = spark.read.parquet(folder)

    sums = tokens.groupBy("part", "source").agg(F.sum("n_tokens").alias("__n"))
    bases = sums.withColumn("base", F.sum("__n").over(Window.partitionBy("source").orderBy("part")) - F.col("__n")).select("part", "source", "base")
    found = {r["source"]: (r["n"], r["parts"]) for r in sums.groupBy("source").agg(F.sum("__n").alias("n"), F.count("*").alias("parts")).collect()}
    names = sorted(q for q, (n, _) in found.items() if n)
    totals = np.array([found[q][0] for q in names], np.int64)
    share = totals.astype(np.float64) if weights is None else np.array([weights.get(q[1:], 0) or 1e-9 for q in names])
    number = {q: i for i, q in enumerate(names)}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                b = batch.slice(lo, 512).filter(pa.compute.greater(batch.slice(lo, 512).column("n_tokens"), 0))
                if not b.num_rows:
                    continue
                queues = np.array([number[q] for q in b.column("source").to_pylist()])
                n = b.column("n_tokens").to_numpy()
                p = pieces_of(queues, b.column("at").to_numpy() + b.column("base").to_numpy(), n, totals, share, window)
                wide = [memoryview(np.frombuffer(x, f"<u{width}").astype("<u4").tobytes()) for x in b.column("ids").to_pylist()]
                crc = [zlib.crc32(wide[d][4 * s : 4 * (s + m)]) for d, s, m in zip(p["doc"].tolist(), p["start"].tolist(), p["length"].tolist(), strict=True)]
                of = pa.array(p["doc"])
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(of), pa.array(p["start"]), pa.array(p["length"]), pa.array(crc, pa.int64()), pa.array(n[p["doc"]]), pa.array(p["sequence_id"]), pa.array(p["offset"]), b.column("source").take(of)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"])

    few = sum(parts for _, parts in found.values()) <= MAX_BROADCAST
    placed = tokens.join(F.broadcast(bases) if few else bases, ["part", "source"])
    return placed.mapInArrow(cut, PIECES.format(id=kind)).withColumn("source", F.when(F.col("source") != "-", F.expr("substring(source, 2)")))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
