import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import pages


def one(spark, value, *columns):
    kind = "array<string>" if isinstance(value, list) else "string"
    return spark.createDataFrame([(value,)], f"t {kind}").select(*columns).first()


def test_tokens_follow_python(spark):
    texts = ["uno, dos_3 é!", "", "a\x1cb", "日本 語。x", "one\ntwo  three..."]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.token_count("t"), T.bm25_terms("t")).collect()
    for t, n, terms in rows:
        assert n == len(re.findall(r"\w+|[^\w\s]", t))
        assert terms == [w.lower() for w in re.findall(r"\w+", t)]


def test_lines_and_strip(spark):
    for t in ["a\r\nb\x0bc\x1dd", "a\n", "\n\na", "x y\x85z"]:
        assert one(spark, t, T.lines("t"))[0] == t.splitlines()
    assert one(spark, "\x1c   a b　\n", T.strip("t"))[0] == "a b"


def test_shorten(spark):
    assert list(one(spark, "ab  cd ef", T.shorten("t", 6), T.shorten("t", 6, True))) == ["ab cd ...", "ab cd..."]
    assert one(spark, None, T.shorten("t", 6))[0] == ""


def test_pages_round_trip(spark):
    got = one(spark, "lost\n<!-- PAGE 3 -->\n one \n<!--PAGE 4-->\ntwo\n", T.pages_of("t").alias("p"), T.markdown_of(T.pages_of("t")).alias("m"))
    assert [tuple(p) for p in got.p] == [(3, "one"), (4, "two")]
    assert got.m == "<!-- PAGE 3 -->\n\none\n\n<!-- PAGE 4 -->\n\ntwo\n"
    assert [tuple(p) for p in one(spark, " plain ", T.pages_of("t").alias("p")).p] == [(1, "plain")]
    assert one(spark, " ", T.pages_of("t").alias("p")).p == []


def test_context_window(spark):
    got = spark.range(1).select(pages.window_around(F.sequence(F.lit(1), F.lit(6)), F.lit(3), 4), pages.window_around(F.sequence(F.lit(1), F.lit(3)), F.lit(2), 4)).first()
    assert list(got) == [[2, 3, 4, 5], [1, 2, 3]]


def test_model_answers(spark):
    assert one(spark, 'x {"markdown": "a &quot;b&quot; "} y', T.response_markdown("t"))[0] == 'a "b"'
    assert one(spark, '{"markdown": 5}', T.response_markdown("t"))[0] is None
    assert one(spark, "Texto cortado **", T.completeness_issue("t"))[0]
    assert not one(spark, "a \\** **b**", T.completeness_issue("t"))[0]
    assert one(spark, "S2, S1 and S2", T.source_ids("t"))[0] == ["S2", "S1"]
    assert one(spark, "- q\n- A b\n2) a  B\n* c", T.query_variants("t", F.lit("Q")))[0] == ["A b", "c"]
    assert one(spark, '{"queries": ["q", "x", "y", "z"]}', T.query_variants("t", F.lit("Q")))[0] == ["x", "y"]
    assert one(spark, "- schß\n- SCHSS\n- ı\n- I", T.query_variants("t", F.lit("Q"), 4))[0] == ["schß", "ı", "I"]
    assert one(spark, [" ", " b ", "c"], T.tag_filter(F.lit(" "), "t"))[0] == "b"
    assert one(spark, "an answer", T.grounded("t", F.array()))[0] == T.REFUSAL


@settings(max_examples=25, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab \n\t.,é_1")), max_size=40))
def test_collapse_is_pythons(spark, t):
    assert one(spark, t, T.collapse("t"))[0] == " ".join(t.split())


def test_intermediate_tables_are_released(spark):
    import os

    from pagewright.sources import shared

    kept = shared._named[:]
    shared._named.clear()
    try:
        rows = shared.stored(spark.range(5))
        folder = shared._named[-1].removeprefix("file://")
        assert rows.count() == 5 and os.path.isdir(folder)
        shared.shared_folder(spark)  # named, never written
        assert shared.release(spark) == 1 and not os.path.exists(folder) and shared.release(spark) == 0
    finally:
        shared._named[:] = kept


def test_a_cluster_must_name_a_shared_folder():
    from types import SimpleNamespace

    import pytest

    from pagewright.sources import shared

    session = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))
    assert shared.top_folder(session("local[4]")).startswith("file:///") and shared.top_folder(session("local")).startswith("file:///")
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,512]"):
        with pytest.raises(RuntimeError):
            shared.top_folder(session(master))
