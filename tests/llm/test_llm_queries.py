import os

import pytest

from loamdex.llm import queries

SMALL = "/root/testdata/sf0.001"
HERE = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")


@HERE
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for f in os.listdir(SMALL):
        db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
    df = queries.QUERIES[name](spark, SMALL)
    want = db.execute(queries.SQL[name])
    at = [d[0] for d in want.description]
    assert sorted(at) == sorted(df.columns)
    assert sorted(map(repr, ([r[c] for c in at] for r in df.collect()))) == sorted(repr(list(r)) for r in want.fetchall())


COLUMNS = {
    "p1_found": {"collection": "string", "id_a": "bigint", "id_b": "bigint"},
    "p2_found": {"query_id": "bigint", "uri": "string", "chunk_index": "int"},
    "p4_found": {"uri": "string"},
    "p6_found": {"chunk_id": "bigint"},
    "p7_found": {"doc_id": "bigint", "term": "string"},
    "p8_ids": {"doc_id": "bigint", "ids": "array<int>"},
    "p9_found": {"mix_name": "string", "source": "string"},
    "p10_found": {"doc_id": "bigint"},
}


@HERE
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_rows_are_distinct_and_of_the_given_columns(spark, name):
    df = queries.QUERIES[name](spark, SMALL)
    if name in COLUMNS:
        assert dict(df.dtypes) == COLUMNS[name]
    rows = [repr(r) for r in df.collect()]
    assert rows and len(set(rows)) == len(rows)
