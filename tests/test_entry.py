import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
LLM = {n for n in entry.queries() if n.startswith("op") or n == "pipeline"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(repr([round(v, 6) if isinstance(v, float) else v for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - LLM))
def test_query_equals_its_oracle(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.execute(f"select {', '.join(columns)} from ({entry.oracle_sql()[name]})").fetchall()
    assert plain(tuple(r) for r in got.select(*columns).collect()) == plain(want)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
