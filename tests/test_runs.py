import glob
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from pagewright import edges, evaluation
from pagewright.config import EvaluationConfig, Settings
from pagewright.functions import text as T
from pagewright.operators import ask, extraction, viewer
from pagewright.operators.retrieve import Retrieval, retrieval_queries, retrieve
from pagewright.sources import files
from pagewright.sources.shared import stored
from pagewright.sources.store import CSV_COLUMNS, Store, write_csv


def test_evaluation_run(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    store.save_question("alpha", [("d", 1)])
    store.save_question("missing word", [("d", 3)])
    chunks = spark.createDataFrame([(i, "d", i + 1, t) for i, t in enumerate(["alpha beta", "gamma", "delta", "epsilon"])], "chunk_index long, document_id string, page_start int, text string")
    asked = f"{tmp_path}/asked"

    def generate(q):
        with open(asked, "a") as f:
            f.write(q + "\n")
        if q == "broken":
            raise ValueError
        return [q + " beta"]

    key = evaluation.run(store, chunks, EvaluationConfig("run", "bm25", 2, augment=True), generate)
    row = store.evaluations().first()
    assert (row.id, row.status) == (key, "completed") and json.loads(row.metrics)["hit_at_k"] == 0.5
    calls = lambda: sorted(open(asked).read().split("\n")[:-1])
    assert store.table("evaluation_results").count() == 2 and calls() == ["alpha", "missing word"]
    took = [r.latency_ms for r in store.results(key).collect()]
    assert len(set(took)) == 2 and all(0 < t < 600_000 for t in took) and json.loads(row.metrics)["p95_latency_ms"] == max(took)
    evaluation.run(store, chunks, EvaluationConfig("again", "bm25", 2, augment=True), generate)
    assert len(calls()) == 2  # cached
    store.save_question("broken", [("d", 1)])
    for n in (3, 4):  # what failed is asked for again, and leaves the question alone
        told = {r.question: r.variants for r in evaluation.load_variants(store, store.questions(), generate).collect()}
        assert told == {"alpha": ["alpha beta"], "missing word": ["missing word beta"], "broken": []} and len(calls()) == n
    with pytest.raises(Exception):
        evaluation.run(store, chunks.drop("text"), EvaluationConfig("broken", "bm25", 2))
    assert store.evaluations().first().status == "failed"


def chunk_rows(spark):
    rows = [(i, f"d{i % 3}", 1 + i // 3, f"alpha {'beta' if i % 2 else 'gamma'} word{i}", "x" if i % 2 else "y", f"s{i % 3}", f"/p/{i % 3}", 0) for i in range(12)]
    return spark.createDataFrame(rows, "chunk_index long, document_id string, page_start int, text string, tag string, source string, source_path string, page_chunk_index int")


def test_a_run_filters_by_tag_and_keeps_its_matches(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    store.save_question("beta word3", [("d0", 2, "s0", "/p/0", "ref")])
    store.save_question("gamma word4", [("d1", 2, "s1", "/p/1", "ref")])
    chunks, seen = chunk_rows(spark), []
    embed = edges.hash_embedder(32)

    def embedded(queries):
        seen.extend(r["query"] for r in queries.select("query").collect())
        return edges.embedded(queries, embed, "query")

    vectors = edges.embedded(chunks, embed)
    key = evaluation.run(store, vectors, EvaluationConfig("tagged", "hybrid", 2, instruction="find", tag=" x "), embed=embedded, batches=2)
    assert all(q.startswith("Instruct: find") for q in seen) and len(seen) == 2
    told = store.evaluation(key)
    by = {r["question"]: r for r in told["results"]}
    assert told["config"]["tag"] == " x " and set(by) == {"beta word3", "gamma word4"} and all(r["latency_ms"] > 0 for r in told["results"])
    for r in told["results"]:
        assert [m["rank"] for m in r["matches"]] == [1, 2] and {m["tag"] for m in r["matches"]} == {"x"}
        assert set(r["matches"][0]) == {"rank", "document_id", "source", "source_path", "page", "page_chunk_index", "tag", "text", "distance", "vector_score", "bm25_score", "rrf_score", "retrieval_sources"}
    first = by["beta word3"]
    assert (first["matches"][0]["document_id"], first["matches"][0]["page"]) == ("d0", 2) and first["metrics"]["hit_at_1"] == 1.0
    assert by["gamma word4"]["metrics"]["failure"]  # its page has the other tag
    assert first["expected"] == [{"document_id": "d0", "page": 2, "source": "s0", "source_path": "/p/0", "reference_text": "ref"}]
    rows = evaluation.results_file(store, key).orderBy("id_pregunta").collect()
    assert rows[0].asDict().keys() == dict.fromkeys(CSV_COLUMNS).keys() and rows[0]["páginas_esperadas"] == "s0 p.2" and rows[0]["páginas_recuperadas"].startswith("s0 p.2; ")
    write_csv(evaluation.results_file(store, key), f"file://{tmp_path}/csv")
    text = "".join(p.read_text("utf-8") for p in sorted((tmp_path / "csv").glob("*.csv")))
    assert text.startswith("\ufeffid_pregunta,pregunta,") and "beta word3" in text
    assert [r.dataset for r in viewer.evaluation_table(store.evaluations()).collect()] == [told["dataset_hash"][:10]]
    with pytest.raises(ValueError):
        evaluation.run(Store(spark, f"file://{tmp_path}/empty"), chunks, EvaluationConfig("none", "bm25"))


def test_retrieval_inside_a_tag_or_document(spark):
    chunks = edges.embedded(chunk_rows(spark), edges.hash_embedder(32))
    asked = spark.createDataFrame([(1, "alpha beta word5", [], None), (2, "alpha gamma word4", ["word8"], "before")], "query_id long, question string, variants array<string>, previous string")
    queries = edges.embedded(retrieval_queries(asked), edges.hash_embedder(32), "query")
    for how, ok in ((Retrieval(k=4, tag="x"), lambda r: r.chunk_index % 2 == 1), (Retrieval("bm25", 4, document_id="d1"), lambda r: r.document_id == "d1"), (Retrieval("vector", 4, tag="y", document_id="d2"), lambda r: r.document_id == "d2" and r.chunk_index % 2 == 0)):
        got = retrieve(queries, chunks, how).withColumnRenamed("key", "chunk_index").collect()
        assert got and all(ok(r) for r in got)


def test_ask(spark):
    chunks = chunk_rows(spark).withColumns({"chunk_id": F.lit("c"), "source_type": F.lit("md"), "page_end": F.col("page_start")})
    asked = spark.createDataFrame([(1, "beta word3"), (2, "beta word5"), (3, "unknown"), (4, "gamma word4")], "query_id long, question string")

    def model(messages):
        text = messages[-1]["content"]
        if "Rewrite" in messages[0]["content"]:
            return '{"queries": ["word7", "word9"]}' if "word3" in text else "only one"
        if "word5" in text.rsplit("Question", 1)[1]:
            raise ConnectionError
        return " It says so [S1]. "

    questions = ask.with_variants(asked, model).withColumn("previous", F.lit(None).cast("string"))
    assert {r.query_id: r.variants for r in questions.collect()} == {1: ["word7", "word9"], 2: [], 3: [], 4: []}
    inputs = ask.generation_inputs(questions, chunks, Retrieval("bm25", 2))
    told = {r.query_id: r for r in inputs.collect()}
    assert told[1].queries == ["beta word3", "word7", "word9"] and told[1].context.startswith("[S1] s0 p.2\n") and told[3].context == "" and told[3].options == []
    audits = []

    def audit(messages):
        audits.append(messages)
        return '{"used_source_ids": ["S1", "S7", "S1"]}' if "word3" in messages[-1]["content"] else "[]"

    out = ask.ask(inputs, model, audit)
    got = {r.query_id: r for r in out.collect()}
    assert got[1].answer == "It says so [S1]." and [c.source_id for c in got[1].citations] == ["S1"] and "text" not in got[1].citations[0]
    assert got[2].answer == got[3].answer == got[4].answer == T.REFUSAL and not got[4].citations
    lines = [json.loads(r.event) for r in ask.events(out.withColumn("session_id", F.lit("s"))).filter("session_id = 's'").orderBy("seq").collect()]
    assert {x["type"] for x in lines} == {"session", "answer", "citations", "matches", "done"}


def test_documents_are_parsed_once(spark, tmp_path):
    pdf = spark.createDataFrame([(f"/x/{n}.pdf", bytearray(range(1, n + 1)), "t", f"{n}.pdf", f"t/{n}.pdf", f"doc{n}", f"sha{n}") for n in (3, 6)], "path string, content binary, tag string, name string, relative_path string, document_id string, source_sha256 string")
    render = lambda content: [(i, bytes([b]), "") for i, b in enumerate(content, 1)]
    folder = f"file://{tmp_path}/cache"
    tried = tmp_path / "tried"
    tried.mkdir()

    def call(page, image, context):
        with open(tried / f"{page}", "a") as f:
            f.write("x")
        if page == 2 and len((tried / "2").read_text()) < 3:
            raise ConnectionError("once more")
        if page == 5:
            raise ValueError("broken")
        return json.dumps({"markdown": f"page {page} with {len(context)}"}), "end_turn"

    parse = lambda **more: extraction.parse_documents(pdf, render, call, folder, "m", "v1", sleep=lambda s: None, record_errors=True, **more)
    with pytest.raises(RuntimeError, match="pages"):
        parse(most_pages=5)
    with pytest.raises(RuntimeError, match="calls"):
        parse(most_calls=5)
    assert not list(tried.iterdir())
    with pytest.raises(TimeoutError):
        parse(timeout=-1)
    assert not list(tried.iterdir())
    got = {r.document_id: r for r in parse().collect()}
    assert [p.markdown for p in got["doc3"].pages] == ["page 1 with 3", "page 2 with 3", "page 3 with 3"] and got["doc3"].failed_pages == {}
    assert [p.page_number for p in got["doc6"].pages] == [1, 2, 3, 4, 5, 6] and got["doc6"].pages[4].markdown == "" and "ValueError" in got["doc6"].failed_pages[5]
    assert got["doc6"].pages[0].markdown == "page 1 with 4" and (got["doc6"].tag, got["doc6"].parser_model) == ("t", "m")
    before = {p.name: len(p.read_text()) for p in tried.iterdir()}
    assert {r.document_id: r.pages for r in parse().collect()} == {k: r.pages for k, r in got.items()}
    assert {p.name: len(p.read_text()) for p in tried.iterdir()} == before  # all from the cache, a failed page as well
    parse(retry_failed=True)
    assert len((tried / "5").read_text()) > before["5"] and len((tried / "1").read_text()) == before["1"]
    told = {r.source_sha256: r for r in files.manifests(files.read_cache(spark, folder)).collect()}
    assert told["sha6"].complete and told["sha6"].page_numbers == [1, 2, 3, 4, 5, 6] and list(told["sha6"].failed_pages) == [5]
    rendered = files.rendered(pdf, render)
    ask_for = lambda pages: spark.createDataFrame([("doc6", pages)], "document_id string, pages array<int>")
    shown = extraction.previewed(ask_for([4, 1, 4, 5]), rendered, call).orderBy("position").collect()
    assert [(r.page_number, r.markdown) for r in shown] == [(4, "page 4 with 4"), (1, "page 1 with 4")]
    with pytest.raises(ValueError):
        extraction.previewed(ask_for([9]), rendered, call)


def pages_of_a_document(spark, n=6, reference=lambda i: ""):
    return spark.createDataFrame([("d", i, bytes([i]), reference(i)) for i in range(1, n + 1)], "document_id string, page_number int, image binary, reference string")


def test_extraction(spark, tmp_path):
    rendered = pages_of_a_document(spark, 6, lambda n: "words " * 60 if n == 2 else "short")
    extraction.check_budget(rendered)
    with pytest.raises(RuntimeError):
        extraction.check_budget(rendered, most_pages=5)
    done = spark.createDataFrame([("d", 1, "ok"), ("d", 6, "failed")], "document_id string, page_number int, status string")
    assert extraction.pending_pages(rendered, done).count() == 4 and extraction.pending_pages(rendered, done, True).count() == 5
    tried = str(tmp_path)

    def call(page, image, context):
        with open(f"{tried}/{page}", "a") as f:
            f.write("x")
        if page == 3:
            raise PermissionError("no access")
        if page == 4 and len(context) > 1:
            return "no json", "end_turn"
        return json.dumps({"markdown": f"page {page} of {len(context)}" + (" **" if page == 5 else "")}), "end_turn"

    answers = extraction.in_rounds(extraction.with_context(rendered), rendered, lambda pages, n: stored(extraction.extract(pages, call, alone=n == 2)))
    got = {r.page_number: r for r in extraction.validated(answers, rendered).collect()}
    assert (got[1].markdown, got[1].status) == ("page 1 of 4", "ok")
    assert got[2].issue == "low coverage" and got[3].issue.startswith("PermissionError") and got[3].markdown == ""
    assert (got[4].markdown, got[4].calls) == ("page 4 of 1", 2) and got[5].issue == "unusable answer"
    # what the gates reject is asked for once more; a permanent error, and what they accept, isn't
    assert [len((tmp_path / str(n)).read_text()) for n in range(1, 7)] == [1, 2, 1, 2, 2, 1]
    assert rendered.select(F.max("page_number")).first()[0] == 6


def test_each_answer_goes_through_the_gates_once(spark, monkeypatch):
    words = " ".join(f"word{i}" for i in range(60))
    pages = [("d", n, b"image", words if n == 2 else "") for n in range(1, 7)]
    rendered = spark.createDataFrame(pages, "document_id string, page_number int, image binary, reference string")

    def call(page, image, context):
        if page == 3:
            raise PermissionError("no access")
        cut = page == 5 or page == 4 and len(context) > 1
        return json.dumps({"markdown": f"page {page} of {len(context)}" + (" **" if cut else "")}), "end_turn"

    read, ask = extraction.with_context(rendered), lambda pages, n: stored(extraction.extract(pages, call, alone=n == 2))
    want = sorted(extraction.validated(extraction.in_rounds(read, rendered, ask), rendered).collect())
    gates, judged = extraction.validated, []

    def counted(results, rendered):
        judged.append(results.count())
        return gates(results, rendered)

    monkeypatch.setattr(extraction, "validated", counted)
    assert sorted(extraction.judged(read, rendered, ask).collect()) == want
    assert judged == [6, 3] and [(r.page_number, r.status, r.calls) for r in want] == [(1, "ok", 1), (2, "failed", 2), (3, "failed", 1), (4, "ok", 2), (5, "failed", 2), (6, "ok", 1)]


def one_file(spark, n=5):
    return spark.createDataFrame([("/x/a.pdf", bytearray(range(1, n + 1)), "t", "a.pdf", "t/a.pdf", "doc", "sha")], "path string, content binary, tag string, name string, relative_path string, document_id string, source_sha256 string")


def test_a_run_that_is_broken_off_pays_for_no_page_twice(spark, tmp_path):
    """Pages 1 to 3 are answered; then the worker dies, as in a crash, and with it the run."""
    tried, cache = tmp_path / "tried", f"{tmp_path}/cache"
    tried.mkdir()
    render = lambda content: [(i, bytes([b]), "") for i, b in enumerate(content, 1)]

    def call(page, image, context):
        with open(f"{tried}/{page}", "a") as f:
            f.write("x")
        if page > 3 and not os.path.exists(f"{tried}/again"):
            limit = time.time() + 60
            while time.time() < limit and len(glob.glob(f"{cache}-answers/run=*/attempt=1/part-*")) < 3:
                time.sleep(0.05)
            os._exit(1)
        if page == 2 and len(context) > 1:
            return json.dumps({"markdown": "cut **"}), "end_turn"
        return json.dumps({"markdown": f"page {page} with {len(context)}"}), "end_turn"

    parse = lambda **more: extraction.parse_documents(one_file(spark), render, call, f"file://{cache}", "m", "v1", sleep=lambda s: None, **more)
    with pytest.raises(Exception):
        parse()
    assert files.read_cache(spark, f"file://{cache}") is None
    first = {p.name: len(p.read_text()) for p in tried.iterdir()}
    assert first["1"] == first["2"] == first["3"] == 1
    (tried / "again").write_text("")
    [doc] = parse().collect()
    assert [p.markdown for p in doc.pages] == ["page 1 with 4", "page 2 with 1", "page 3 with 4", "page 4 with 4", "page 5 with 4"] and doc.failed_pages == {}
    counts = {n: len((tried / str(n)).read_text()) for n in range(1, 6)}
    assert counts[1] == counts[3] == 1 and counts[2] == 2 and counts[4] == first.get("4", 0) + 1 and counts[5] == first.get("5", 0) + 1
    parse().collect()
    assert {n: len((tried / str(n)).read_text()) for n in range(1, 6)} == counts  # all from the cache


def test_errors_leave_the_other_pages_done(spark, tmp_path):
    tried, cache = tmp_path / "tried", f"file://{tmp_path}/cache"
    tried.mkdir()
    render = lambda content: [(i, bytes([b]), "") for i, b in enumerate(content, 1)]

    def call(page, image, context):
        with open(f"{tried}/{page}", "a") as f:
            f.write("x")
        if page == 2 and not os.path.exists(f"{tried}/again"):
            raise PermissionError("second page failure")
        if page == 3 and not os.path.exists(f"{tried}/again"):
            raise ConnectionError("busy")
        return json.dumps({"markdown": f"page {page}"}), "end_turn"

    parse = lambda **more: extraction.parse_documents(one_file(spark), render, call, cache, "m", "v1", sleep=lambda s: None, **more)
    with pytest.raises(RuntimeError, match="second page failure"):
        parse()
    count = lambda: [len((tried / str(n)).read_text()) for n in range(1, 6)]
    assert count() == [1, 1, 6, 1, 1]  # the busy one five times more
    told = files.manifests(files.read_cache(spark, cache)).first()
    assert told.page_numbers == [1, 4, 5] and not told.complete
    (tried / "again").write_text("")
    assert [p.markdown for p in parse().first().pages] == [f"page {n}" for n in range(1, 6)] and count() == [1, 2, 7, 1, 1]
    assert [p.markdown for p in parse(refresh=True).first().pages] == [f"page {n}" for n in range(1, 6)] and count() == [2, 3, 8, 2, 2]


def test_upload(spark, tmp_path):
    (tmp_path / "new.md").write_text("one")
    (tmp_path / "other.md").write_text("two")
    docs = f"file://{tmp_path}/docs"
    put = lambda name, *more, **how: files.upload(spark, f"file://{tmp_path}/{name}", docs, *more, **how)
    assert put("new.md", "a/b.md", "tag") == "tag/a/b.md"
    with pytest.raises(FileExistsError):
        put("other.md", "a/b.md", "tag")
    assert (tmp_path / "docs/tag/a/b.md").read_text() == "one"
    assert put("other.md", "a/b.md", "tag", overwrite=True) and (tmp_path / "docs/tag/a/b.md").read_text() == "two"
    assert put("other.md", "c.md", overwrite=True) == "c.md"
    for bad in ("../c.md", "/c.md", "c.txt", "a//c.md"):
        with pytest.raises(ValueError):
            put("new.md", bad)
    with pytest.raises(Exception):
        put("none.md", "d.md")
    assert sorted(p.name for p in (tmp_path / "docs").rglob("*") if p.is_file() and p.suffix != ".crc") == ["b.md", "c.md"]
    assert [r.relative_path for r in files.load_directory(spark, docs).orderBy("relative_path").collect()] == ["c.md", "tag/a/b.md"]


def test_settings():
    assert Settings(retrieval_top_k=3).effective_top_k == 3 and Settings().effective_top_k == 8
    assert EvaluationConfig("x", "bm25").distance is None
    for bad in ({"name": " "}, {"name": "x", "top_k": 21}, {"name": "x", "distance": "dot"}):
        with pytest.raises(ValueError):
            EvaluationConfig(**bad)
