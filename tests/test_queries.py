import os

import pytest

import __spark_entry__ as entry
from loamdex.plans import queries as core

SMALL = "/root/testdata/sf0.001"


def test_entry_has_the_core_queries():
    assert set(core.QUERIES) <= set(entry.queries()) and set(core.SQL) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_does_without_the_optional_part(monkeypatch):
    import builtins

    real = builtins.__import__

    def refuse(name, *args, **kw):
        if name.startswith("loamdex.llm") or (name == "loamdex" and "llm" in (args[2] or ())):
            raise ImportError(name)
        return real(name, *args, **kw)

    monkeypatch.setattr(builtins, "__import__", refuse)
    assert set(entry.queries()) == set(core.QUERIES)


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    return [plain(v) for v in value] if isinstance(value, (list, tuple)) else value


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(core.SQL))
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for f in os.listdir(SMALL):
        db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
    df = core.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    want = db.execute(core.SQL[name])
    at = [d[0] for d in want.description]
    assert sorted(at) == columns
    expected = sorted(repr([plain(r[at.index(c)]) for c in columns]) for r in want.fetchall())
    assert sorted(repr([plain(r[c]) for c in columns]) for r in df.collect()) == expected


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.SQL)))
def test_query_without_sql_runs(spark, name):
    assert core.QUERIES[name](spark, SMALL).count() > 0


def test_the_package_is_shipped_once(spark):
    from loamdex.session import ship

    ship(spark)
    before = list(spark.sparkContext._python_includes)
    ship(spark)
    assert "loamdex.zip" in before and spark.sparkContext._python_includes == before
