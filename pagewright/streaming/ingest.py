"""Incremental indexing: new Markdown rows in a watched folder become chunks as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators.chunking import ChunkLimits, chunk_pages
from pagewright.operators.pages import split_pages


def chunk_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, limits: ChunkLimits = ChunkLimits()):
    """A query that chunks JSON lines (document_id, markdown) below ``source`` into Parquet below ``sink``; a batch that is
    run again replaces its own output, so chunks come out once."""
    docs = spark.readStream.schema("document_id string, markdown string").json(source)

    def index(batch: DataFrame, number: int) -> None:
        pages = split_pages(batch.withColumn("source_sha256", F.sha2("markdown", 256)))
        chunk_pages(pages, limits).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return docs.writeStream.foreachBatch(index).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
