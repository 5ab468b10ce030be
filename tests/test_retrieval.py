import bisect
import math
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagewright.operators import assemble, bm25, chunking, fusion, metrics, quality, retrieve, vector
from pagewright.operators.numbering import range_of


def chunk_frame(spark, texts):
    return spark.createDataFrame([(i, "doc-1", i + 1, t) for i, t in enumerate(texts)], "chunk_index long, document_id string, page_start int, text string")


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_vector_order(spark, metric):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None)], "vec_id long, embedding array<float>")
    q = v.filter("vec_id = 0").withColumnRenamed("vec_id", "query_id")
    assert [(r.vec_id, r.rank) for r in vector.nearest(q, v, 5, metric).orderBy("rank").collect()] == [(0, 1), (1, 2)]
    assert vector.nearest(q.filter("false"), v, 5, metric).count() == 0


def brute(texts, query, k1=1.5, b=0.75):
    docs = [[w.lower() for w in re.findall(r"\w+", t)] for t in texts]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    df = Counter(w for d in docs for w in set(d))
    out = []
    for i, d in enumerate(docs):
        tf, s = Counter(d), 0.0
        for w in [w.lower() for w in re.findall(r"\w+", query)]:
            idf = max(0.0, math.log(n - df[w] + 0.5) - math.log(df[w] + 0.5)) if w in df else 0.0
            s += idf * tf[w] * (k1 + 1) / (tf[w] + k1 * (1 - b + b * len(d) / avg))
        if s > 0:
            out.append((i, round(s, 6)))
    return sorted(out, key=lambda x: (-x[1], x[0]))


def test_bm25_against_brute_force(spark):
    texts = ["ornitorrinco exclusivo", "texto común", "otro documento", "texto texto largo de verdad", "", "INC-001 uno", "INC-021 uno", "INC-060 uno"]
    for query in ("ornitorrinco texto texto", "INC-060", "nada"):
        got = [(r.chunk_index, round(r.score, 6)) for r in bm25.search(asked(spark, query), chunk_frame(spark, texts)).orderBy("rank").collect()]
        assert got == brute(texts, query)


def test_bm25_filter_comes_after_the_ranking(spark):
    chunks = chunk_frame(spark, ["a b", "a c", "x", "y", "z"])
    got = bm25.search(asked(spark, "a b"), chunks, keep=F.col("chunk_index") == 1).first()
    assert (got.store_rank, got.rank) == (2, 1)


def lists(spark, *rows):
    return spark.createDataFrame(rows, "query_id long, source string, list_no int, rank int, key long, distance double, score double")


def test_rrf_adds_up_lists(spark):
    two = lists(spark, (0, "bm25", 0, 1, 0, None, 2.0), (0, "bm25", 0, 2, 1, None, 1.0), (0, "bm25", 1, 1, 1, None, 3.0), (0, "bm25", 1, 2, 2, None, 1.0))
    got = fusion.reciprocal_rank_fusion(two).orderBy("rank").collect()
    assert got[0].key == 1 and got[0].rrf_score == pytest.approx(1 / 62 + 1 / 61) and got[0].bm25_score == 3.0
    for parts in (1, 8):
        assert fusion.reciprocal_rank_fusion(two.repartition(parts)).orderBy("rank").collect() == got


def test_rrf_first_list_wins_ties_and_a_duplicate_counts_once(spark):
    dense = lists(spark, (0, "vector", 0, 1, 7, -0.5, None), (0, "vector", 1, 1, 7, -0.9, None), (0, "vector", 0, 2, 7, -0.4, None))
    got = fusion.reciprocal_rank_fusion(dense).first()
    assert (got.distance, got.vector_score, got.rrf_score) == (-0.5, 1.0, pytest.approx(2 / 61))


def test_collapse_and_hybrid(spark):
    hits = spark.createDataFrame([(0, "d", 4, 1), (0, "d", 4, 2), (0, "d", 7, 3)], "query_id long, document_id string, page_start int, rank int")
    assert [(r.page_start, r.page_rank) for r in fusion.collapse_to_pages(hits, 2).orderBy("page_rank").collect()] == [(4, 1), (7, 2)]
    with pytest.raises(ValueError):
        fusion.collapse_to_pages(hits, 0)
    chunks = chunk_frame(spark, ["alpha beta", "gamma", "delta"]).withColumn("embedding", F.array(F.col("chunk_index").cast("float"), F.lit(1.0).cast("float")))
    queries = asked(spark, "alpha").select("query_id", F.lit(0).alias("list_no"), "query", F.array(F.lit(2.0).cast("float"), F.lit(1.0).cast("float")).alias("embedding"))
    pages = retrieve.retrieve(queries, chunks, retrieve.Retrieval(k=3), variants=1).orderBy("page_rank").collect()
    assert [p.page_start for p in pages][0] == 1 and len(pages) == 3


def test_retrieval_queries(spark):
    rows = spark.createDataFrame([(1, " q ", ["v", "q", " "], "before")], "query_id long, question string, variants array<string>, previous string")
    got = [r.query for r in retrieve.retrieval_queries(rows).orderBy("list_no").collect()]
    assert got[:2] == ["q", "v"] and got[2].startswith("Previous user question: before")


def test_metrics(spark):
    questions = spark.createDataFrame([(1,), (2,)], "query_id long")
    expected = spark.createDataFrame([(1, "doc-1", 2), (1, "doc-1", 4), (2, "z", 1)], "query_id long, document_id string, page int")
    got = spark.createDataFrame([(1, 1, "doc-1", 2), (1, 2, "other", 8), (1, 3, " doc-1", 4)], "query_id long, rank int, document_id string, page int")
    a, b = metrics.score_retrieval(questions, expected, got, 3).orderBy("query_id").collect()
    assert (a.hit_at_1, a.recall_at_1, a.recall_at_k, a.mrr_at_k, a.false_positives) == (1.0, 0.5, 1.0, 1.0, 1) and a.precision_at_k == pytest.approx(2 / 3)
    assert b.failure and b.retrieved_count == 0 and b.mrr_at_k == 0.0
    run = metrics.aggregate_metrics(metrics.score_retrieval(questions, expected, got, 3).withColumn("latency_ms", F.col("query_id").cast("double")).withColumn("error", F.lit(None).cast("string"))).first()
    assert (run.failures, run.hit_at_1, run.p95_latency_ms) == (1, 0.5, 2.0)


def parts(spark, texts, limits=chunking.ChunkLimits()):
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    return [[tuple(c) for c in r.c] for r in rows.select("i", chunking.page_chunks("text", limits).alias("c")).orderBy("i").collect()]


def test_chunking(spark):
    L = chunking.ChunkLimits
    one = lambda text, limits=L(): parts(spark, [text], limits)[0]
    assert one("uno dos tres\n", L(3, 20, 2)) == [("uno dos tres", 3, False)]
    line = " ".join("abcdefghijkl")
    assert one(line, L(3, 5, 1)) == [(line, 12, True)]
    found = one("uno dos tres\ncuatro\n\n# seis\nsiete ocho", L(4, 6, 2))
    assert [p[0] for p in found] == ["uno dos tres\ncuatro", "cuatro\n\n# seis\nsiete ocho"]
    assert parts(spark, [None, " \n ", ""]) == [[], [], []]
    assert all(n <= 900 or big for _, n, big in one("\n".join("w " * 30 for _ in range(200))))


def slow_parts(text, limits):
    """The definition, over line numbers."""
    lines = text.splitlines()
    n = [len(re.findall(r"\w+|[^\w\s]", line)) for line in lines]
    total = lambda a, b: sum(n[a:b])
    out, s, new = [], 0, 0

    def emit(end):
        body = "\n".join(lines[s:end]).strip()
        if body and (end > new or not out):
            out.append((body, total(s, end), False))

    carried = lambda end: next(x for x in range(s, end + 1) if total(x, end) <= limits.carried)
    for i, line in enumerate(lines):
        if n[i] > limits.most:
            emit(i)
            out.append((line.strip(), n[i], True))
            s = new = i + 1
            continue
        if i > s and (total(s, i + 1) > limits.most or line.strip().startswith("#") and total(s, i) >= limits.target):
            emit(i)
            kept = carried(i)
            s, new = (i if total(kept, i + 1) > limits.most else kept), i
        if not line.strip() and total(s, i + 1) >= limits.target:
            emit(i + 1)
            s, new = carried(i + 1), i + 1
    emit(len(lines))
    return out


def test_chunks_equal_the_definition(spark):
    rng = random.Random(9)
    kinds = ["", "  ", "# head", "  ## h", "uno", "uno dos tres", "a b c d e f g h", "x, y!", "\u2028z", "\u00a0", "é\x0bñ ß", "***"]
    texts = ["\n".join(rng.choice(kinds) for _ in range(rng.randrange(40))) for _ in range(150)]
    texts += ["\n".join(["w " * rng.randrange(12) for _ in range(5000)]), "x" * 50_000, "\n" * 3000 + "end"]
    for limits in (chunking.ChunkLimits(4, 7, 3), chunking.ChunkLimits(1, 1, 0), chunking.ChunkLimits(5, 30, 40), chunking.ChunkLimits()):
        assert parts(spark, texts, limits) == [slow_parts(t, limits) for t in texts]
    frame = spark.createDataFrame([("d", "s", 1, texts[0])], "document_id string, source_sha256 string, page_number int, markdown string")
    plan = chunking.chunk_pages(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan


def test_chunk_ids_are_stable_and_pages_stay_apart(spark):
    pages = spark.createDataFrame([("d", "s", 1, "uno dos tres cuatro cinco seis\n\nsiete ocho"), ("d", "s", 2, "pagina dos"), ("d", "s", 3, None)], "document_id string, source_sha256 string, page_number int, markdown string")
    one, two = (sorted(chunking.chunk_pages(pages.repartition(n), chunking.ChunkLimits(5, 8, 2)).collect()) for n in (1, 4))
    assert one == two and {r.page_start for r in one} == {1, 2}
    numbered = chunking.with_chunk_index(spark.createDataFrame([(d, p) for d in (5, 1, 9) for p in (2, 1)], "d long, p int"), "d", "p").orderBy("chunk_index").collect()
    assert [tuple(r) for r in numbered] == [(1, 1, 0), (1, 2, 1), (5, 1, 2), (5, 2, 3), (9, 1, 4), (9, 2, 5)]


def test_quality_and_resume(spark):
    words = " ".join(f"palabra{i}" for i in range(60))
    rows = spark.createDataFrame([(1, words, " ".join(words.split()[:10])), (2, words, words), (3, "few words", "")], "id long, reference string, markdown string")
    got = {r.id: r.issue for r in quality.reference_coverage(rows, ["id"], "reference", "markdown").collect()}
    assert got == {1: True, 2: False, 3: False}
    cache = spark.createDataFrame([(1, False, [1, 2], 5), (2, False, [2, 1], 5), (3, False, [1, 1, 3], 5), (4, True, [1], 5), (5, False, [], 5)], "id long, complete boolean, page_numbers array<int>, total_pages int")
    assert [(r.id, r.next_page) for r in quality.resumable(cache).collect()] == [(1, 3)]


def test_messages(spark):
    rows = spark.createDataFrame([(1, 0, " user", "a "), (1, 1, "assistant", "b"), (1, 2, "user", " c"), (1, 3, "user", "  ")], "s long, seq int, role string, content string")
    assert assemble.normal_messages(rows).count() == 3
    assert assemble.contextual_queries(rows, "s", "seq").first().query == "Previous user question: a\nLatest follow-up question: c"


def test_discrete_percentile(spark):
    import random

    from pagewright.operators import metrics

    rng = random.Random(4)
    rows = [(g, float(rng.randrange(5 if g == "few" else 10**6))) for g, n in (("few", 300), ("many", 4000), ("one", 1)) for _ in range(n)] + [("few", None)]
    frame = spark.createDataFrame(rows, "g string, v double")
    for share in (0.5, 0.95, 1.0):
        want = frame.filter("v is not null").groupBy("g").agg(F.count("*"), F.expr(f"percentile_disc({share}) within group (order by v)"))
        for accuracy in (10_000, 50):
            got = metrics.discrete_percentile(frame, ["g"], "v", share, accuracy)
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_ranges_of_many_splitters(spark):
    rng = random.Random(1)
    for n in (0, 1, 5, 128, 129, 1000, 20_000):
        splitters = sorted(rng.sample(range(-(10**6), 10**6), n))
        values = [None, -(10**7), 10**7, *splitters[:50], *(rng.randrange(-(10**6), 10**6) for _ in range(50))]
        began = time.monotonic()
        got = spark.createDataFrame([(v,) for v in values], "v long").select("v", range_of(F.col("v"), splitters).alias("r"))
        got._jdf.queryExecution().executedPlan()
        assert time.monotonic() - began < 5
        assert [r.r for r in got.collect()] == [0 if v is None else bisect.bisect_right(splitters, v) for v in values]
    words = sorted({"".join(rng.choice("ab\0\u00e9\U0001f600") for _ in range(4)) for _ in range(400)})
    got = spark.createDataFrame([(w,) for w in [*words, "", "zz"]], "v string").select(range_of(F.col("v"), words, "string").alias("r"))
    assert [r.r for r in got.collect()] == [*range(1, len(words) + 1), 0, bisect.bisect_right(words, "zz")]


def test_a_search_moves_tops_and_never_hits(spark):
    texts = [f"w{i % 7} w{i % 11} w{i % 13} common{i % 3}" for i in range(300)]
    chunks = chunk_frame(spark, texts).repartition(3)
    queries = spark.createDataFrame([(q, f"w{q % 7} w{q} W{q} common1 missing") for q in range(13)], "query_id long, query string")
    out = bm25.search(queries, chunks, 4)
    plan = out._jdf.queryExecution().toString()
    assert "hashpartitioning(query_id" not in plan and "MapInArrow" in plan
    rows = [t.split() for t in texts]
    df = {w: sum(w in r for r in rows) for r in rows for w in r}
    for q in range(13):
        asked = [f"w{q % 7}", f"w{q}", f"w{q}", "common1"]
        told = []
        for i, r in enumerate(rows):
            part = [max(0.0, math.log(len(rows) - df[w] + 0.5) - math.log(df[w] + 0.5)) * 2.5 * r.count(w) / (r.count(w) + 1.5) for w in asked if w in r]
            told.append((-round(sum(part), 9), i))
        want = [(i, -s) for s, i in sorted(told) if s < 0][:4]
        got = [(r["chunk_index"], r["score"]) for r in out.filter(out.query_id == q).orderBy("rank").collect()] if q in (0, 5, 12) else None
        assert got is None or [(i, pytest.approx(s)) for i, s in want] == got
