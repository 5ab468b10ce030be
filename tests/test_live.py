"""The streamed index equals one that is built anew, batch after batch; gram search gives the rows of a scan."""

import json
import os
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pagewright.operators import bm25, viewer
from pagewright.operators.chunking import ChunkLimits, chunk_pages
from pagewright.operators.pages import split_pages
from pagewright.streaming import live

LIMITS = ChunkLimits(8, 12, 3)


def same_as_rebuilt(spark, index, docs):
    rows = spark.createDataFrame([(k, v) for k, v in docs.items() if v is not None], "document_id string, markdown string")
    chunks = chunk_pages(split_pages(rows.withColumn("source_sha256", F.sha2("markdown", 256))), LIMITS)
    want = bm25.postings(chunks, "chunk_id")
    order = lambda frame: sorted(map(tuple, frame.select("chunk_id", "dl", "term", "tf").collect()))
    assert order(index.postings()) == order(want)
    assert sorted(map(tuple, index.terms().collect())) == sorted(map(tuple, want.filter("term <> ''").groupBy("term").count().collect()))
    n, avgdl = want.filter("term = ''").agg(F.count("*"), F.avg("dl")).first()
    assert index.stats() == (n, pytest.approx(avgdl))
    asked = spark.createDataFrame([(1, "alpha w1 w2"), (2, "gone w3")], "query_id long, query string")
    hits = lambda how: sorted(map(tuple, bm25.search(asked, chunks, 5, key="chunk_id", index=how).collect()))
    assert hits(index.postings()) == hits(None)


def test_a_changing_stream_equals_a_rebuild(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(live, "FAN", 3)
    rng = random.Random(2)
    text = lambda: "\n\n".join(" ".join(rng.choices(["alpha", "w1", "w2", "w3", "gone"], k=rng.randrange(1, 12))) for _ in range(rng.randrange(1, 4)))
    (tmp_path / "in").mkdir()
    index = live.LiveIndex(spark, f"file://{tmp_path}/index", LIMITS, "at", grace=0.0)
    docs, at = {}, 0
    batches = [{f"d{i}": text() for i in range(6)}, {"d1": text(), "d2": None, "d7": text()}, {"d2": text(), "d1": None, "d3": docs.get("d3")}, {"d8": "", "d0": text(), "d7": text()}]
    for n, batch in enumerate(batches):
        lines = []
        for key, value in batch.items():
            at += 2
            lines += [{"document_id": key, "markdown": text(), "at": at - 1}, {"document_id": key, "markdown": value, "at": at}]
        rng.shuffle(lines)
        (tmp_path / f"in/{n}.json").write_text("".join(json.dumps(x) + "\n" for x in lines))
        index.follow(f"file://{tmp_path}/in", f"file://{tmp_path}/cp", "document_id string, markdown string, at long").awaitTermination()
        docs |= batch
        same_as_rebuilt(spark, index, docs)
        assert len(index.state()["segments"]) < 3
    before = index.state()
    index.apply(spark.createDataFrame([("d0", "again", 99)], "document_id string, markdown string, at long"), before["batch"], f"file://{tmp_path}/cp")
    assert index.state() == before  # a batch that is run again
    with pytest.raises(RuntimeError):
        index.apply(spark.createDataFrame([("d0", "again", 99)], "document_id string, markdown string, at long"), 99, "other")
    index.apply(spark.createDataFrame([], "document_id string, markdown string, at long"), 98, f"file://{tmp_path}/cp")
    index.apply(spark.createDataFrame([(None, "null id", 1)], "document_id string, markdown string, at long"), 99, f"file://{tmp_path}/cp")
    same_as_rebuilt(spark, index, docs | {"": "null id"})
    assert len([n for n in os.listdir(tmp_path / "index") if n.startswith("s-")]) <= 8 + 3


def test_grams_find_what_a_scan_finds(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, rng.choice("ab"), "".join(rng.choice(["x", "Y", "é", " ", "\n", "😀", "z"]) for _ in range(rng.randrange(30))), rng.choice([None, "src one", "ÉTÉ"])) for i in range(500)]
    rows += [(500, "a", None, None), (501, "a", "The needle", "x"), (502, None, "no", "needles")]
    frame = spark.createDataFrame(rows, "chunk_index long, tag string, text string, source string").repartition(3)
    folder = f"file://{tmp_path}/grams"
    viewer.write_grams(frame, folder, "chunk_index", ["text", "source"])
    for needle in ("", "x", "xy", "xyé", " NEEDLE ", "été", "😀z", "z\nx", "src one", "xxxx", "nowhere", "y y"):
        for searched in (None, ["text"], ["source"]):
            for lists in ({}, {"tag": ["a"]}):
                want = sorted(r.chunk_index for r in viewer.apply_filters(frame, lists, needle, searched or ["text", "source"]).collect())
                got = viewer.found_rows(spark, folder, lists, needle, searched)
                assert sorted(r.chunk_index for r in got.collect()) == want and got.columns == frame.columns, needle
    bits = lambda needle: sum(bin(r.bits & (2**64 - 1)).count("1") for r in viewer.candidates(spark, folder, needle).collect())
    assert bits("needle") == 2 and bits("nowhere") == 0 and bits("xyé") < 120 and viewer.candidates(spark, folder, "xy") is None


def test_grams_are_written_where_they_are_found(spark, tmp_path, monkeypatch):
    """No row a gram is shuffled: a task writes a sorted stretch, and blocks that stretches share are put together."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdé😀") for _ in range(rng.randrange(40))) for _ in range(300)]
    block, place = np.arange(300) // 64, np.arange(300) % 64
    want = {}
    for i, t in enumerate(texts):
        for k in range(len(t) - 2):
            key = (t[k : k + 3], i // 64)
            want[key] = want.get(key, 0) | 1 << i % 64
    gram, at, bits = viewer._column_grams(texts, block, place)
    assert list(zip(gram.to_pylist(), at.tolist())) == sorted(want)
    assert {(g, b): x & (2**64 - 1) for g, b, x in zip(gram.to_pylist(), at.tolist(), bits.tolist())} == want
    wide = [chr(0x4E00 + i) + chr(0x1F300 + i % 99) + "x" for i in range(20000)] + ["", "xy"]
    gram, at, _ = viewer._column_grams(wide, np.arange(20002) * 1000, np.zeros(20002, np.int64))  # too many for one number
    assert sorted(gram.to_pylist()) == sorted(wide[:20000]) and len(viewer._column_grams([], block[:0], place[:0])[0]) == 0
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "chunk_index long, text string").repartition(3)
    viewer.write_grams(frame, f"file://{tmp_path}/grams", "chunk_index", ["text"])
    at = next(n for n in os.listdir(tmp_path / "grams") if n.startswith("v-"))
    plan = viewer.candidates(spark, f"file://{tmp_path}/grams", texts[7][:4])._jdf.queryExecution().executedPlan().toString()
    assert "In(gram" in plan or "EqualTo(gram" in plan  # files' statistics tell which parts to read
    files = [tmp_path / "grams" / at / "grams" / n for n in os.listdir(tmp_path / "grams" / at / "grams") if n.endswith(".parquet")]
    assert files and all((x := pq.read_table(f).column("gram").to_pylist()) == sorted(x) for f in files)  # a stretch each
