"""A lexical index that follows a stream of documents: a document that comes again replaces its chunks, one without text goes.

The index is a list of segments, one for each batch of the stream, named by a pointer (``sources.pointers``). A segment has
the batch's documents, their chunks and postings, and by how much the batch changes each term's document frequency: up for
its own chunks, down for those that it replaces. A row is live if no later segment has its document. ``FAN`` segments are
merged into one with live rows alone, so an index of any age has few, and a row is written again once for so many batches.
A batch that Spark runs again, since the program ended between its commit and the stream's own, is known by its number
and changes nothing.

Defined results. A null id is the empty one. Of several rows of a document in one batch, the one that is last by ``order``
counts, of equals the one with the greatest text; without ``order`` the greatest text. A null text deletes the document; an
empty one has no chunks. An index serves one stream: a batch from another checkpoint is an error.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators import bm25
from pagewright.operators.chunking import ChunkLimits, chunk_pages
from pagewright.operators.pages import split_pages
from pagewright.sources.pointers import GRACE, Pointers
from pagewright.sources.shared import stored

FAN = 8
KEY = ["document_id", "seq"]
DOCS = "document_id string, seq long"
CHUNKS = "chunk_id string, document_id string, page_start int, page_chunk_index int, text string, token_count int, oversize boolean, seq long"
POSTINGS = "chunk_id string, document_id string, dl int, term string, tf long, seq long"
TERMS = "term string, df long"
SCHEMAS = {"docs": DOCS, "chunks": CHUNKS, "postings": POSTINGS, "terms": TERMS}


class LiveIndex:
    def __init__(self, spark: SparkSession, folder: str, limits: ChunkLimits = ChunkLimits(), order: str | None = None, grace: float = GRACE):
        self.spark, self.folder, self.limits, self.order, self.grace = spark, folder.rstrip("/"), limits, order, grace
        self._at = Pointers(spark, self.folder)

    def state(self) -> dict:
        return self._at.latest() or {"version": 0, "segments": [], "batch": -1, "stream": None, "n": 0, "length": 0}

    def _read(self, kind: str, state: dict) -> DataFrame:
        at = [f"{self.folder}/{s}/{kind}" for s in state["segments"]]
        return self.spark.read.schema(SCHEMAS[kind]).parquet(*at) if at else self.spark.createDataFrame([], SCHEMAS[kind])

    def _live(self, kind: str, state: dict) -> DataFrame:
        """The rows of documents that no later segment has."""
        if len(state["segments"]) < 2:
            return self._read(kind, state)
        docs = self._read("docs", state)
        last = docs.groupBy("document_id").agg(F.max("seq").alias("last"), F.count("*").alias("n")).filter("n > 1")
        old = docs.join(last, "document_id").filter("seq < last").select(*KEY)  # as many as were replaced since the last merge
        return self._read(kind, state).join(old, KEY, "left_anti")

    def chunks(self) -> DataFrame:
        return self._live("chunks", self.state()).drop("seq")

    def postings(self) -> DataFrame:
        """(chunk_id, dl, term, tf): what ``bm25.search`` takes as an index, with chunks named by ``chunk_id``."""
        return self._live("postings", self.state()).select("chunk_id", "dl", "term", "tf")

    def terms(self) -> DataFrame:
        """(term, df) as kept from batch to batch."""
        return self._read("terms", self.state()).filter(F.col("term") != bm25.CHUNK).groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")

    def stats(self) -> tuple[int, float | None]:
        """The number of chunks and their mean length, as kept from batch to batch."""
        state = self.state()
        return state["n"], state["length"] / state["n"] if state["n"] else None

    def _write(self, name: str, **tables: DataFrame) -> None:
        for kind, rows in tables.items():
            rows.select(*[f.split()[0] for f in SCHEMAS[kind].split(", ")]).write.parquet(f"{self.folder}/{name}/{kind}")

    def apply(self, batch: DataFrame, number: int, stream: str = "") -> None:
        """Takes in a batch (document_id, markdown[, order]) of the stream."""
        state = self.state()
        if state["stream"] not in (None, stream):
            raise RuntimeError(f"the index follows another stream: {state['stream']}")
        if number <= state["batch"]:
            return
        rank = F.struct(F.col(self.order), "markdown") if self.order else F.struct("markdown")
        rows = batch.withColumn("document_id", F.coalesce("document_id", F.lit("")))
        rows = stored(rows.groupBy("document_id").agg(F.max_by("markdown", rank).alias("markdown")) if self.order else rows.groupBy("document_id").agg(F.max("markdown").alias("markdown")))
        name, seq = f"s-{uuid.uuid4().hex}", F.lit(number).cast("long").alias("seq")
        self._write(name, docs=rows.select("document_id", seq))
        pages = split_pages(rows.filter("markdown is not null").withColumn("source_sha256", F.sha2("markdown", 256)))
        self._write(name, chunks=chunk_pages(pages, self.limits).select("*", seq))
        new = self.spark.read.schema(CHUNKS).parquet(f"{self.folder}/{name}/chunks")
        counted = lambda chunks: bm25.postings(chunks, "chunk_id", also=("document_id", "seq"))
        self._write(name, postings=counted(new))
        added = self.spark.read.schema(POSTINGS).parquet(f"{self.folder}/{name}/postings")
        gone = counted(self._live("chunks", state).join(rows.select("document_id"), "document_id", "left_semi"))
        signed = added.select("term", "dl", F.lit(1).cast("long").alias("by")).unionByName(gone.select("term", "dl", F.lit(-1).cast("long").alias("by")))
        changes = stored(signed.groupBy("term").agg(F.sum("by").alias("df"), F.sum(F.col("by") * F.col("dl")).alias("length")))
        self._write(name, terms=changes.filter("df <> 0"))
        total = changes.filter(F.col("term") == bm25.CHUNK).first()
        state |= {"segments": [*state["segments"], name], "batch": number, "stream": stream, "n": state["n"] + (total["df"] if total else 0), "length": state["length"] + (total["length"] if total else 0)}
        if len(state["segments"]) >= FAN:
            state["segments"] = [self._merged(state)]
        self._at.commit(state)
        self._at.collect(lambda kept: kept["segments"], self.grace)

    def _merged(self, state: dict) -> str:
        name = f"s-{uuid.uuid4().hex}"
        chunks = self._live("chunks", state)
        docs = chunks.select(*KEY).distinct()  # those that are gone need no mark: there is nothing older
        terms = self._read("terms", state).groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
        self._write(name, docs=docs, chunks=chunks, postings=self._live("postings", state), terms=terms)
        return name

    def follow(self, source: str, checkpoint: str, schema: str = "document_id string, markdown string"):
        """A streaming query that takes in what there is below ``source`` (JSON lines) and then ends."""
        docs = self.spark.readStream.schema(schema).json(source)
        return docs.writeStream.foreachBatch(lambda batch, number: self.apply(batch, number, checkpoint)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
