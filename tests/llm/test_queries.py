"""The registered queries over the smallest tables: against their SQL where there is one, else for whole results."""

import os

import duckdb
import pytest

from rowparity.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        path = f"{DATA}/{name}"
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_matches_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    cursor = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall())


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in ("op2_decontamination", "op7_passages", "op9_chat_formatting", "op11_embedding_whitening", "op12_source_divergence")])
def test_every_document_has_its_rows(spark, name):
    ids = {r["doc_id"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert {r["doc_id"] for r in queries.QUERIES[name](spark, DATA).collect()} == ids
