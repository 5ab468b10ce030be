import hashlib
import json

import pytest
from pyspark.sql import functions as F

from pagewright import edges
from pagewright.operators import bm25, vector
from pagewright.sources import files, pointers, store
from pagewright.sources.store import Store, latest
from pagewright.streaming.ingest import chunk_stream


def test_store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    a = s.save_question(" What? ", [("d", 2), (" d", 2), ("d", 1)])
    assert [(r.id, r.question, len(r.pages)) for r in s.questions().collect()] == [(a, "What?", 2)]
    e = s.start_evaluation("Comparativa", {"k": 5})
    with pytest.raises(ValueError):
        s.start_evaluation("  comparativa  ", {})
    before = s.evaluations().first().dataset_hash
    s.save_question("What?", [("d", 3)], a)
    other = s.start_evaluation("second", {})
    assert s.evaluations().first().dataset_hash != before and other > e > a
    s.add_results(spark.createDataFrame([(1, e, a, "What?", "[]", "[]", "[]", "{}", 1.0, "")], s.table("evaluation_results").schema))
    s.delete_question(a)
    assert s.questions().count() == 0 and s.table("evaluation_results").count() == 1
    s.end_evaluation(e, {"hit_at_1": 1.0})
    s.delete_evaluation(e)
    assert s.table("evaluation_results").count() == 0 and [r.id for r in s.evaluations().collect()] == [other]
    with pytest.raises(KeyError):
        s.save_question("x", [("d", 1)], 999)
    with pytest.raises(ValueError):
        s.save_question(" ", [("d", 1)])


def test_pages_keep_what_they_are_given(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    a = s.save_question("q", [("d", 1, " src ", "/p", "old"), ("d", 1, "src", "/p", " new "), ("c", 2)], category=" x ", notes="n")
    got = s.question(a)
    assert [tuple(p.values()) for p in got["pages"]] == [("c", 2, "", "", ""), ("d", 1, "src", "/p", "new")] and (got["category"], got["notes"]) == ("x", "n")
    assert s.delete_question(a) and not s.delete_question(a) and not s.delete_evaluation(9)
    for call in (s.question, s.evaluation):
        with pytest.raises(KeyError):
            call(a)
    assert s.list_tables() == ["questions", "relevant_pages"] and s.table_exists("questions") and not s.table_exists("x")


def test_dataset_hash_is_that_of_the_canonical_json(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    text = 'What is "x"\\y?\n\tñ \x01\x1f\r日'
    ids = [s.save_question(text, [("d", 10), ("d", 9), ('a"b', 1)]), s.save_question("second", [("d", 1)]), s.save_question("idle", [("d", 1)], active=False)]
    s.start_evaluation("run", {})
    want = [{"id": ids[0], "question": text, "relevant_pages": [{"document_id": 'a"b', "page": 1}, {"document_id": "d", "page": 9}, {"document_id": "d", "page": 10}]}, {"id": ids[1], "question": "second", "relevant_pages": [{"document_id": "d", "page": 1}]}]
    row = s.evaluations().first()
    assert row.dataset_hash == hashlib.sha256(json.dumps(want, ensure_ascii=False, sort_keys=True).encode()).hexdigest() and row.question_count == 2


class Crash(Exception):
    pass


def test_a_crash_leaves_the_old_or_the_new_state(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/store"
    s = Store(spark, folder)
    s.save_question("first", [("d", 1)])
    real = s._at.fs

    class Stops:  # ends the program at one of the file system's changes
        def __init__(self, at):
            self.left = at

        def __getattr__(self, name):
            def call(*args):
                if name in ("create", "rename", "delete"):
                    self.left -= 1
                    if self.left < 0:
                        raise Crash
                return getattr(real, name)(*args)

            return call

    for at in range(3):
        s._at.fs = Stops(at)
        try:
            s.save_question(f"again {at}", [("d", 1)])
        except Crash:
            pass
        found = [r.question for r in Store(spark, folder).questions().collect()]
        assert found == ["first", *([] if at < 2 else ["again 2"])]
    s._at.fs = real
    assert s.save_question("next", [("d", 1)]) == 3
    for i in range(10):
        s.append_messages("x", [("user", str(i))])
    assert len(s._at.names()) <= 8 and s.messages("x").count() == 10


def test_sessions(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    a = s.resolve_session(None)
    assert s.resolve_session(a) == a and s.messages(a).count() == 0
    with pytest.raises(KeyError):
        s.resolve_session("unknown")
    s.append_messages(a, [("user", "hi")])
    assert s.delete_session(a) and not s.delete_session(a) and s.messages(a).count() == 0


def test_variants_and_messages(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    s.save_variants("q", "v2", ["a"])
    s.save_variants(" q ", "v2", ["b"])
    assert s.variants("q", "v2") == ["b"] and s.variants("q", "v1") is None
    s.append_messages("x", [("user", "1"), ("assistant", "2")])
    s.append_messages("x", [("user", "3")])
    assert [r.content for r in s.messages("x").collect()] == ["1", "2", "3"]
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "k int, at int, v string")
    assert latest(rows, ["k"], "at").first().v == "b"


def test_files_and_index(spark, tmp_path):
    (tmp_path / "docs/guias").mkdir(parents=True)
    (tmp_path / "docs/guias/guide.md").write_bytes(b"<!-- PAGE 3 -->\r\nuno\n<!-- PAGE 4 -->\ndos\n")
    (tmp_path / "docs/ignored.txt").write_text("x")
    got = files.load_markdown(spark, f"file://{tmp_path}/docs").collect()
    assert [(r.tag, [tuple(p) for p in r.pages]) for r in got] == [("guias", [(3, "uno"), (4, "dos")])]
    assert files.listed(spark, f"file://{tmp_path}/docs").count() == 2
    (tmp_path / "docs/guias/A b.PDF").write_bytes(b"xy")
    url = {r.name: (r.url, r.extension, r.tag) for r in files.listed(spark, f"file://{tmp_path}/docs").collect()}
    assert url["A b.PDF"] == ("/files/guias/A%20b.PDF", "pdf", "guias") and url["ignored.txt"][2] == ""
    none = "array<struct<page_number:int,markdown:string>>"
    pdf = lambda rows: rows.select("path", "document_id", "source_sha256", F.array().cast(none).alias("pages"), F.lit("m").alias("parser_model"), F.lit("v").alias("prompt_version"), "tag", "name", "relative_path")
    both = files.load_directory(spark, f"file://{tmp_path}/docs", pdf)
    assert [r.name for r in both.collect()] == ["A b.PDF", "guide.md"] and tuple(files.totals(both).first()) == (2, 2)
    assert [r.name for r in files.load_directory(spark, f"file://{tmp_path}/docs").collect()] == ["guide.md"]
    with pytest.raises(FileNotFoundError):
        files.load_directory(spark, f"file://{tmp_path}/missing")
    assert files.safe_relative("a/b.MD") == "a/b.MD" and files.safe_tag(" x ") == "x"
    for bad in ("../a.md", "/a.md", "a.txt", "a//b.md", "c:/a.md"):
        with pytest.raises(ValueError):
            files.safe_relative(bad)
    with pytest.raises(ValueError):
        files.safe_tag("a/b")
    index = f"file://{tmp_path}/index"
    chunks = spark.createDataFrame([("d", "p", "s", "m", "v", [1.0])], "document_id string, source_path string, source_sha256 string, parser_model string, prompt_version string, vector array<double>")
    assert files.write_index(chunks, index) and not files.write_index(chunks.filter("false"), index)
    assert "vector" not in files.read_index(spark, index).columns and files.read_index(spark, index).count() == 1
    assert files.list_tables(spark, f"file://{tmp_path}") == ["docs", "index"] and files.table_exists(spark, f"file://{tmp_path}", "index")
    assert files.write_index(files.read_index(spark, index, True).drop("schema_version"), index)  # an index may be made from itself
    chunks.withColumn("schema_version", F.lit(2)).write.parquet(f"{index}-old")
    with pytest.raises(RuntimeError):
        files.read_index(spark, f"{index}-old")
    image = spark.createDataFrame([("d", bytearray(b"ab"))], "document_id string, content binary")
    assert [(r.page_number, r.reference) for r in files.rendered(image, lambda c: [(i + 1, c, chr(x)) for i, x in enumerate(c)]).collect()] == [(1, "a"), (2, "b")]


def test_edges(spark):
    embed = edges.hash_embedder(8)
    rows = spark.createDataFrame([("a b",), (None,)], "text string")
    assert [len(r.embedding) for r in edges.embedded(rows, embed).collect()] == [8, 8]
    assert edges.is_local_endpoint("http://127.0.0.1:1/") and edges.is_local_endpoint("http://10.0.0.1") and not edges.is_local_endpoint("http://example.com")
    slept, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise TimeoutError
        return "ok"

    assert edges.with_retries(flaky, (TimeoutError,), slept.append, lambda: 1.0) == "ok" and slept == [1.0, 2.0]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"document_id": "d", "markdown": "uno dos"}\n')
    for _ in range(2):
        chunk_stream(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/cp").awaitTermination()
    assert [r.text for r in spark.read.parquet(f"file://{tmp_path}/out").collect()] == ["uno dos"]


def test_model_files(spark, tmp_path):
    for name, body in (("a-q4.gguf", b"GGUF"), ("b-q4.gguf", b"GGUF" + b"x" * 20), ("c-q4.gguf", b"GGUF" + b"y" * 20), ("d.gguf", b"HTML" + b"z" * 20)):
        (tmp_path / name).write_bytes(body)
    got = files.model_files(spark, f"file://{tmp_path}", {"chat": "*-q4.gguf", "other": "d*.gguf", "none": "x*"})
    assert got["chat"].endswith("/b-q4.gguf") and got["other"] is None and got["none"] is None


def test_lexical_index(spark, tmp_path):
    chunks = spark.createDataFrame([(i, t, "a" if i < 3 else "b") for i, t in enumerate(["uno dos", "dos tres tres", "", None, "tres", "cuatro", "cinco"])], "chunk_index long, text string, tag string")
    folder = f"file://{tmp_path}/bm25"
    queries = spark.createDataFrame([(1, 0, "Tres dos"), (1, 1, "cuatro"), (2, 0, "nada")], "query_id long, list_no int, query string")
    both = ["query_id", "list_no"]
    assert bm25.search(queries, chunks, query_id=both, index=bm25.read_index(spark, folder)).count() == 0
    bm25.write_index(chunks, folder)
    want = sorted(map(tuple, bm25.search(queries, chunks, query_id=both).collect()))
    assert want and sorted(map(tuple, bm25.search(queries, chunks, query_id=both, index=bm25.read_index(spark, folder)).collect())) == want
    assert [(r.chunk_index, r.store_rank, r["rank"]) for r in bm25.search(queries, chunks, query_id=both, keep=F.col("tag") == "b").orderBy("list_no", "rank").collect()] == [(4, 2, 1), (5, 1, 1)]
    pointers.Pointers(spark, f"{folder}-old").commit({"version": 0, "schema_version": 2})
    with pytest.raises(RuntimeError):
        bm25.read_index(spark, f"{folder}-old")


def test_vectors_in_many_blocks(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=4), 1)]) for i in range(300)] + [(300 + i, None if i % 2 else [1.0, 0.0, 0.0, 0.0]) for i in range(40)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = frame.filter("vec_id % 7 = 0").withColumnRenamed("vec_id", "query_id")
    want = sorted(map(tuple, vector.nearest(asked, frame, 5, "cosine").collect()))
    full = np.array([v for _, v in rows if v])
    ids = [i for i, v in rows if v]
    for q in {r[0] for r in want}:
        d = np.round(vector.distances(np.array([dict(rows)[q]]), full, "cosine")[0], 9) + 0.0
        assert [(r[1], r[3]) for r in sorted(want, key=lambda r: r[2]) if r[0] == q] == [(i, x) for x, i in sorted(zip(d.tolist(), ids))[:5]]
    for name, value in (("QUERY_BLOCK", 10), ("VECTOR_BLOCK", 16)):
        monkeypatch.setattr(vector, name, value)
    assert sorted(map(tuple, vector.nearest(asked, frame, 5, "cosine").collect())) == want
    monkeypatch.setattr(vector, "MAX_BROADCAST", 0)
    assert sorted(map(tuple, vector.nearest(asked, frame, 5, "cosine").collect())) == want
    assert vector.nearest(asked.filter("false"), frame).count() == 0 and vector.nearest(asked, frame.filter("false")).count() == 0


def test_questions_are_imported_in_one_change(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    first = s.save_question("before", [("d", 1)])
    schema = f"question string, category string, pages {store.PAGES}"
    page = lambda d, n, ref="": (d, n, " s ", None, ref)
    rows = spark.createDataFrame([(" one ", " c ", [page(" d ", 2, "old"), page("d", 1), page("d", 2, " new ")]), ("two", None, [page("e", 3)])], schema).repartition(2)
    version = s._state()["version"]
    assert s.import_questions(rows) == 2 and s._state()["version"] == version + 1
    told = {r.question: r for r in s.questions().collect()}
    assert sorted(r.id for r in told.values()) == [first, first + 1, first + 2] and all(r.active for r in told.values())
    assert told["one"].category == "c" and [tuple(p) for p in told["one"].pages] == [("d", 1, "s", "", ""), ("d", 2, "s", "", "new")] and told["two"].category == ""
    for bad in ((" ", "", [page("d", 1)]), ("q", "", []), ("q", "", None), (None, "", [page("d", 1)]), ("q", "", [page(" ", 1)]), ("q", "", [page("d", 0)]), ("q", "", [page("d", None)])):
        with pytest.raises(ValueError):
            s.import_questions(rows.unionByName(spark.createDataFrame([bad], schema)))
    assert s.import_questions(rows.filter("false")) == 0 and s.table("questions").count() == 3
    assert s.save_question("after", [("d", 1)]) == first + 3
