"""Indexes that skip what can't matter give the rows of a full search; what replaces them leaves readers theirs."""

import os
import pathlib
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pagewright.operators import bm25, vector
from pagewright.operators.retrieve import Retrieval, retrieve
from pagewright.sources import files, pointers, shared, store

WORDS = [f"w{i}" for i in range(400)]


def passages(rng, n):
    """Chunks in runs about one subject, as pages of a document are."""
    out = []
    for i in range(n):
        subject = [f"s{i // 40}x{j}" for j in range(6)]
        out.append((i, " ".join([*rng.choices(WORDS, k=rng.randrange(5, 40)), *rng.choices(subject, k=rng.randrange(0, 6))])))
    return out


def test_blocks_that_cannot_reach_the_top_are_not_read(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    rows = [*passages(rng, 900), (900, None), (901, ""), (902, "same words"), (903, "same words"), (904, "same words")]
    chunks = spark.createDataFrame(rows, "chunk_index long, text string").repartition(3)
    asked = [(i, 0, f"s{i}x1 s{i}x2 w{i} w{i + 1}") for i in range(12)] + [(50, 0, "same words"), (50, 1, "nowhere"), (51, 0, "w1 w2 w3 w4 w5"), (52, 0, None)]
    queries = spark.createDataFrame(asked, "query_id long, list_no int, query string")
    both, folder = ["query_id", "list_no"], f"file://{tmp_path}/index"
    rows, counts = bm25.top_k(queries, folder, 5, both)
    assert rows.count() == counts.count() == 0
    bm25.write_index(chunks, folder)
    for k in (1, 5, 2000):
        want = sorted(map(tuple, bm25.search(queries, chunks, k, both).select(*both, "chunk_index", "store_rank", "rank", "score").collect()))
        got, counts = bm25.top_k(queries, folder, k, both)
        assert sorted(map(tuple, got.collect())) == want and want
        read = {r.query_id: (r["blocks"], r["read"]) for r in counts.filter("list_no = 0").collect()}
        assert all(n <= m for m, n in read.values())
        if k == 5:
            assert sum(read[i][1] for i in range(12)) < 0.75 * sum(read[i][0] for i in range(12)), read
    assert sorted(map(tuple, bm25.search(queries, chunks, 5, both, index=bm25.read_index(spark, folder)).collect())) == sorted(map(tuple, bm25.search(queries, chunks, 5, both).collect()))


def test_a_reader_keeps_the_index_that_is_replaced(spark, tmp_path):
    folder = f"file://{tmp_path}/index"
    one = spark.createDataFrame([(1, "uno dos"), (2, "dos"), (3, "tres")], "chunk_index long, text string")
    bm25.write_index(one, folder, grace=0.0)
    reader = bm25.read_index(spark, folder)
    for i in range(3):
        bm25.write_index(one.withColumn("text", F.lit(f"new{i}")), folder, grace=0.0)
    assert {r.term for r in reader.collect()} == {"", "uno", "dos", "tres"}
    assert {r.term for r in bm25.read_index(spark, folder).collect()} == {"", "new2"}
    for i in range(pointers.KEPT):
        bm25.write_index(one, folder, grace=0.0)
    assert sum(n.startswith("v-") for n in os.listdir(tmp_path / "index")) == pointers.KEPT


def indexed(spark, n=4000):
    rows = [(f"p{i}", "sha", "m", "v", i, f"d{i % 50:02d}", f"t{i % 10}" if i % 7 else None, f"text {i}") for i in range(n)]
    return spark.createDataFrame(rows, "source_path string, source_sha256 string, parser_model string, prompt_version string, chunk_index long, document_id string, tag string, text string")


def test_a_tag_opens_its_files_alone(spark, tmp_path):
    folder, chunks = f"file://{tmp_path}/chunks", indexed(spark)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert files.write_index(chunks, folder)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    every = files.read_index(spark, folder)
    assert every.count() == 4000 and len(every.inputFiles()) >= 12
    for how in ({"tag": " t3 "}, {"document_id": "d07"}, {"tag": "t3", "document_id": "d13"}, {"tag": "zz"}):
        found = files.read_index(spark, folder, **how)
        want = every.filter(" and ".join(f"trim({c}) = '{v.strip()}'" for c, v in how.items()))
        assert sorted(r.chunk_index for r in found.collect()) == sorted(r.chunk_index for r in want.collect())
        if "tag" in how:
            assert len(found.inputFiles()) <= 4, how
    assert not files.write_index(chunks.filter("false"), folder) and files.read_index(spark, folder).count() == 4000


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_pivots_spare_comparisons(spark, tmp_path, metric, monkeypatch):
    monkeypatch.setattr(vector, "VECTOR_BLOCK", 64)
    rng = np.random.default_rng(7)
    middles = rng.normal(size=(20, 8)) * 5
    rows = [(i, (middles[i % 20] + rng.normal(size=8) * 0.3).round(2).tolist()) for i in range(2000)]
    rows += [(2000 + i, rows[3][1]) for i in range(5)] + [(None, rows[4][1]), (3000, None), (3001, [0.0] * 8)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    asked = spark.createDataFrame([("a", i, rows[i * 31][1]) for i in range(40)] + [("b", 0, None), ("c", 0, [0.0] * 8), ("d", 0, rng.normal(size=8).tolist())], "name string, no int, embedding array<double>")
    by, folder = ["name", "no"], f"file://{tmp_path}/cells"
    with pytest.raises(FileNotFoundError):
        vector.nearest_in_cells(asked, folder)
    vector.write_cells(frame, folder, metric)
    for k in (1, 7, 3000):
        want = sorted(map(repr, vector.nearest(asked, frame, k, metric, by).collect()))
        got, counts = vector.nearest_in_cells(asked, folder, k, by)
        assert sorted(map(repr, got.collect())) == want
        if k == 7:
            compared = {(r.name, r.no): r.compared for r in counts.collect()}
            assert sum(compared["a", i] for i in range(40)) < 0.3 * 40 * 2007
            assert compared["c", 0] <= 2007 and ("b", 0) not in compared
    vector.write_cells(frame.filter("false"), folder, metric)
    got, counts = vector.nearest_in_cells(asked, folder, 3, by)
    assert got.count() == counts.count() == 0
    with pytest.raises(ValueError):
        vector.write_cells(frame, folder, "dot")


def test_ids_of_any_kind(spark):
    v = lambda x: [float(x), 0.0]
    frame = spark.createDataFrame([("b", v(1)), ("a", v(1)), (None, v(1)), ("", v(1)), ("é", v(0)), ("x", None)], "vec_id string, embedding array<double>")
    asked = spark.createDataFrame([("q", v(1)), (None, v(0))], "query_id string, embedding array<double>")
    got = {(r.query_id, r["rank"]): r.vec_id for r in vector.nearest(asked, frame, 5).collect()}
    assert [got["q", i] for i in range(1, 6)] == [None, "", "a", "b", "é"] and got[None, 1] == "é"
    numbers = spark.createDataFrame([(2, v(1)), (None, v(1)), (None, v(1)), (-5, v(1))], "vec_id int, embedding array<float>")
    assert [r.vec_id for r in vector.nearest(asked.limit(1), numbers, 4).orderBy("rank").collect()] == [None, None, -5, 2]


def test_a_question_with_many_lists(spark):
    chunks = spark.createDataFrame([(i, f"d{i}", 1, f"word{i}", [float(i), 1.0]) for i in range(80)], "chunk_index long, document_id string, page_start int, text string, embedding array<double>")
    queries = spark.createDataFrame([(1, n, f"word{n}", [float(n), 1.0]) for n in range(70)], "query_id long, list_no int, query string, embedding array<double>")
    for mode in ("vector", "hybrid"):
        got = retrieve(queries, chunks, Retrieval(mode, 80, vector_candidates=1, bm25_candidates=1)).collect()
        assert {r.query_id for r in got} == {1} and {r.key for r in got} == set(range(70))
    named = queries.withColumn("query_id", F.lit("one"))
    assert {r.query_id for r in retrieve(named, chunks, Retrieval("vector", 5)).collect()} == {"one"}


def test_appends_leave_few_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "FAN", 3)
    s = store.Store(spark, f"file://{tmp_path}/store", grace=0.0)
    s.append_messages("x", [("user", "0")])
    reader = s.messages("x")
    for i in range(1, 6):
        s.append_messages("x", [("user", str(i))])
    assert [r.content for r in reader.collect()] == ["0"]  # what a reader began with is still there
    for i in range(6, 24):
        s.append_messages("x", [("user", str(i))])
    assert [r.content for r in s.messages("x").collect()] == [str(i) for i in range(24)]
    assert len(s._state()["tables"]["messages"]) <= 2 * 3
    s.collect()
    named = {x for n in s._at.names() for folders in s._at.read(n)["tables"].values() for x in folders}
    assert {n for n in os.listdir(tmp_path / "store") if not n.startswith((".", "current-"))} == named and len(named) < 24
    (tmp_path / "store/messages-left-by-a-crash").mkdir()
    assert s.collect() == ["messages-left-by-a-crash"] and s.messages("x").count() == 24


def test_a_written_block_is_one_row(spark, tmp_path):
    rng = random.Random(5)
    folder = f"file://{tmp_path}/index"
    bm25.write_index(spark.createDataFrame(passages(rng, 200), "chunk_index long, text string"), folder)
    at = next(n for n in os.listdir(tmp_path / "index") if n.startswith("v-"))
    blocks = spark.read.parquet(f"{folder}/{at}/blocks")
    assert 200 / 2**bm25.BITS <= blocks.count() <= 200 / 2**bm25.BITS + 8 and blocks.agg(F.sum("n")).first()[0] == 200


def test_packs_are_written_in_small_row_groups(spark, tmp_path):
    words = "array_join(transform(sequence(1, 600), i -> abs(xxhash64(id, i)) % 200000), ' ')"
    chunks = spark.range(4500).coalesce(1).selectExpr("id as chunk_index", f"{words} as text")
    at = len(shared._named)
    found = bm25.search(chunks.limit(3).selectExpr("chunk_index as query_id", "text as query"), chunks, 2)
    assert [(r["query_id"], r["chunk_index"]) for r in found.filter("rank = 1").orderBy("query_id").collect()] == [(0, 0), (1, 1), (2, 2)]
    bm25.write_index(chunks, str(tmp_path))
    folders = [*(f.removeprefix("file://") for f in shared._named[at:]), str(tmp_path)]
    files = [f for x in folders for f in pathlib.Path(x).rglob("*.parquet")]
    groups = [g.row_group(i).total_byte_size for g in (pq.ParquetFile(f).metadata for f in files) for i in range(g.num_row_groups)]
    assert sum(groups) > 6 * shared.GROUP and max(groups) < 2.5 * shared.GROUP  # a row of a search's packs has half a group
