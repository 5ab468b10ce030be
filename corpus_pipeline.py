"""From raw documents to packed training sequences: quality rules, near-duplicates, repeated passages, packing.

``STAGES`` are (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's ``docs``. All but the last return the columns of ``documents``.

Defined results. Nulls, ties, empty and long texts, repeated rows and extra columns: as each operator's module says. Of
rows that are equal in id and text one goes on from the near-duplicate stage. An empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import minhash, packing, quality, suffix_dedup
from pagewright.llm.common import shared_folder, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose their boilerplate lines."""
    return quality.cleaned(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that are linked by a similarity of 0.8 on five-word shingles, the least id stays."""
    kept = minhash.near_duplicates(docs, size=5, threshold=0.8).filter("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    n, distinct = docs.agg(F.count("*"), F.count_distinct("doc_id")).first()
    rows = docs if n == distinct else docs.dropDuplicates(["doc_id", "text"])
    return rows.join(kept, rows["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every byte of a 100-byte string that also starts earlier goes."""
    return suffix_dedup.deduplicated(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of full sequences of 1024 tokens that each hold all sources in proportion."""
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("packed_sequences", packed_sequences)]

#: Neither components nor the packing schedule can be put as SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), shared_folder(spark)
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
