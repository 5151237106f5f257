import math
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from loamdex.functions.text import fold, glob_regex, query_terms
from loamdex.operators.filters import first_of_file, narrowed, page, parse_after, skill_page, tool_page
from loamdex.operators.hybrid import fuse, search
from loamdex.operators.keyword import bm25_batch, bm25_search, fts_query, fts_search, parsed_query, phrases, postings, syntax_search
from loamdex.operators.vector import CellIndex, vector_batch, vector_search

CHUNK = "uri string, chunk_index int, text string, title string, file_type string, vector array<float>"


def chunks(spark, *rows):
    return spark.createDataFrame([(u, i, t, title, "md", v) for u, i, t, title, v in rows], CHUNK)


@pytest.fixture(scope="module")
def three(spark):
    return chunks(
        spark,
        ("a", 0, "Payment processing: errors of PAYMENT cards é", "Guide", [1.0, 0.0, 0.0]),
        ("b", 0, "quarterly revenue and budget", None, [0.0, 1.0, 0.0]),
        ("c", 0, "database pool; payment pool", "Payment", [-1.0, 0.0, 0.0]),
        ("d", 0, None, None, None),
        ("d", 1, "", "", [0.0, 0.0, 0.0]),
        ("e", 0, "x of y", None, [1.0, 0.0]),
    ).cache()


def keys(df):
    return [(r["uri"], r["chunk_index"]) for r in df.collect()]


def test_bm25_scores(three):
    got = {r["uri"]: r["score"] for r in bm25_search(three, "payment errors").collect()}
    dl, avg, n = {"a": 7, "c": 4}, (7 + 4 + 4 + 1) / 6, 6

    def part(tf, d, df):
        return math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * d / avg))

    assert got == {"a": pytest.approx(part(2, dl["a"], 2) + part(1, dl["a"], 1), abs=1e-6), "c": pytest.approx(part(1, dl["c"], 2), abs=1e-6)}


def test_bm25_rules(three):
    assert keys(bm25_search(three, "x y")) == [] and keys(bm25_search(three, "")) == []
    assert keys(bm25_search(three, "é")) == [("a", 0)]  # two bytes
    once, twice = (bm25_search(three, q).collect()[0]["score"] for q in ("revenue", "revenue Revenue"))
    assert twice == pytest.approx(2 * once, abs=2e-6)
    assert keys(bm25_search(three, "guide")) == []  # the title isn't searched
    assert query_terms("Don't 12½ x_y") == ["don", "12½"]


def test_bm25_batch_is_the_single_search(spark, three):
    asked = [(1, "payment errors payment"), (2, "pool budget"), (3, "nothing here"), (4, None)]
    got = bm25_batch(three, spark.createDataFrame(asked, "query_id bigint, query_text string"), 2).collect()
    for i, q in asked:
        want = [(r["uri"], r["score"]) for r in bm25_search(three, q or "", 2).collect()]
        mine = [(r["uri"], r["score"]) for r in sorted(got, key=lambda r: r["place"]) if r["query_id"] == i]
        assert [m[0] for m in mine] == [w[0] for w in want] and [m[1] for m in mine] == pytest.approx([w[1] for w in want], abs=2e-6)


def test_postings(three):
    rows = {(r["uri"], r["term"]): (r["tf"], r["dl"]) for r in postings(three).collect()}
    assert rows["a", "payment"] == (2, 7) and rows["c", "pool"] == (2, 4) and ("e", "x") not in rows


def test_full_text_engine_equals_sqlite(spark):
    rng = random.Random(2)
    words = "budget Größe résumé pool naïve a x1 schedule Zürich ñandú C++ don't".split()
    rows = [(f"u{i}", i % 3, " ".join(rng.choices(words, k=rng.randrange(30))), " ".join(rng.choices(words, k=2)) if i % 4 else None) for i in range(80)]
    db = sqlite3.connect(":memory:")
    try:
        db.execute("CREATE VIRTUAL TABLE f USING fts5(uri UNINDEXED, text, chunk_index UNINDEXED, title, tokenize = 'unicode61 remove_diacritics 2')")
    except sqlite3.OperationalError:
        pytest.skip("no full-text engine in this sqlite3")
    db.executemany("INSERT INTO f VALUES (?, ?, ?, ?)", [(u, t, i, title or "") for u, i, t, title in rows])
    df = spark.createDataFrame(rows, "uri string, chunk_index int, text string, title string")
    for query in ("budget", "grosse Größe", "RESUME x", "don't budget", "C++ nandu", "a", "zurich schedule pool", 'say "pool'):
        match = fts_query(query)
        want = dict(db.execute("SELECT uri, -bm25(f) FROM f WHERE f MATCH ?", (match,)).fetchall()) if match else {}
        got = {r["uri"]: r["score"] for r in fts_search(df, query, None).collect()}
        assert set(got) == set(want), query
        assert all(got[u] == pytest.approx(want[u], abs=2e-6) for u in want), query
    assert phrases("don't x Émile") == [["don", "t"], ["emile"]] and fold("Ünïted") == ["united"]


def test_query_syntax(three):
    assert keys(syntax_search(three, "+payment -database")) == [("a", 0)]
    assert keys(syntax_search(three, "title:payment")) == [("c", 0)]
    assert keys(syntax_search(three, '"payment pool"')) == [("c", 0)]
    assert keys(syntax_search(three, "-payment")) == []
    assert parsed_query('+a1 -"b2 c3" text:d4') == [("+", None, ["a1"]), ("-", None, ["b2", "c3"]), ("", "text", ["d4"])]
    for bad in ('"open', "size:3"):
        with pytest.raises(ValueError):
            parsed_query(bad)


def test_vector_search_rules(three):
    got = [(r["uri"], r["chunk_index"], r["score"]) for r in vector_search(three, [2.0, 0.0, 0.0], 0).collect()]
    assert got == [("a", 0, 1.0), ("b", 0, 0.0), ("d", 0, 0.0), ("d", 1, 0.0), ("e", 0, 0.0), ("c", 0, -1.0)]
    assert keys(vector_search(three, [2.0, 0.0, 0.0], 1)) == [("a", 0)]


def test_vector_batch_is_the_single_search(spark, three, monkeypatch):
    from loamdex.operators import vector

    asked = [(1, [2.0, 0.1, 0.0]), (2, [0.0, -1.0, 0.0]), (3, [0.0, 0.0, 0.0]), (4, [1.0, 1.0])]
    df = spark.createDataFrame(asked, "query_id bigint, vector array<float>")
    for block in (10_000, 2):
        monkeypatch.setattr(vector, "QUERY_BLOCK", block)
        got = vector_batch(three, df, 3).orderBy("query_id", "place").collect()
        for i, v in asked:
            want = [(r["uri"], r["chunk_index"], r["score"]) for r in vector_search(three, v, 3).collect()]
            assert [(r["uri"], r["chunk_index"], r["score"]) for r in got if r["query_id"] == i] == want


def test_cells_find_most_neighbours(spark):
    rng = random.Random(5)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(30)]
    rows = [(f"u{i:04}", 0, "t", None, "md", [c + rng.gauss(0, 0.3) for c in rng.choice(centres)]) for i in range(1500)]
    df = spark.createDataFrame(rows, CHUNK)
    index = CellIndex.fit(df)
    assigned = index.assign(df).cache()
    hits = 0
    for i in range(0, 200, 10):
        q = rows[i][5]
        hits += len(set(keys(vector_search(df, q, 10))) & set(keys(index.search(assigned, q, 10))))
    assert hits >= 0.9 * 200
    with pytest.raises(ValueError):
        index.search(assigned, [1.0], 3)
    assert index.assign(df.limit(1).withColumn("vector", F.array_repeat(F.lit(0.0).cast("float"), 16))).collect()[0]["cell"] is None


def hit_list(spark, *rows):
    return spark.createDataFrame([(u, 0, f"{tag}{u}", s) for tag, u, s in rows], "uri string, chunk_index int, text string, score double")


def test_fusion(spark):
    vector, keyword = hit_list(spark, ("v", "a", 0.9), ("v", "b", 0.8)), hit_list(spark, ("k", "b", 9.0), ("k", "c", 1.0))
    got = [(r["uri"], round(r["score"], 6), r["text"]) for r in fuse(vector, keyword, 0.5, 10).collect()]
    assert got == [("b", 0.016261, "vb"), ("a", 0.008197, "va"), ("c", 0.008065, "kc")]
    assert [r["uri"] for r in fuse(vector, keyword, 9.0, 1).collect()] == ["a"]
    twice = hit_list(spark, ("v", "a", 0.9), ("v", "a", 0.8))
    assert fuse(twice, keyword, 1.0, 1).collect()[0]["score"] == pytest.approx(1 / 61 + 1 / 62)


def test_modes_fall_back_to_keywords(three):
    assert keys(search(three, "payment", None, 5, "vector_only")) == keys(bm25_search(three, "payment", 5))
    assert keys(search(three, "budget", [1.0, 0.0, 0.0], 1, "vector_only")) == [("a", 0)]
    with pytest.raises(ValueError):
        search(three, "x", None, 5, "best")


def found(spark):
    rows = [(f"file:///r/{p}", i, t, 1.0 - n / 10) for n, (p, i, t) in enumerate([("src/a.py", 0, "py"), ("src/a.py", 1, "py"), ("b.md", 0, "md"), ("deep/er/SKILL.md", 0, "md"), ("deep/er/SKILL.md", 1, "md"), ("c.md", 0, "md")])]
    return spark.createDataFrame(rows, "uri string, chunk_index int, file_type string, score double")


def test_filters_come_after_the_limit(spark):
    hits = page(found(spark), 3)
    assert keys(narrowed(hits, file_type="md")) == [("file:///r/b.md", 0)]
    assert keys(narrowed(hits, threshold=0.95)) == [("file:///r/src/a.py", 0)]
    assert len(keys(narrowed(hits, path="*/src/*"))) == 2 and keys(narrowed(hits, path="[")) == []
    sources = spark.createDataFrame([("file:///r/b.md", 5000), ("file:///r/src/a.py", None)], "uri string, modified_at bigint")
    assert keys(narrowed(hits, sources, since=5000)) == [("file:///r/b.md", 0)] and keys(narrowed(hits, sources, since=5001)) == []


def test_pages(spark):
    hits = found(spark)
    assert keys(page(hits, 2, 4)) == [("file:///r/deep/er/SKILL.md", 1), ("file:///r/c.md", 0)]
    shown = tool_page(hits, 2, 1, path="/r/").orderBy("place").collect()
    assert [r["place"] for r in shown] == [2, 3] and shown[0]["total"] == 6 and shown[0]["has_more"]
    assert tool_page(hits, 0, -5, file_type="py").count() == 1
    assert keys(skill_page(hits)) == [("file:///r/deep/er/SKILL.md", 0)]
    assert len(keys(first_of_file(hits))) == 4


def test_globs():
    import re

    def match(pattern, text):
        return bool(re.match(glob_regex(pattern), text))

    assert match("*/src/*", "/a/b/src/c/d.py") and match("*.{rs,py}", "/x/y.py") and not match("*.rs", "/x.rs/y")
    assert match("/a?c/[!x]*", "/abc/yz") and not match("/a?c/[!x]*", "/abc/xz") and match("a.b", "a.b") and not match("a.b", "axb")
    assert glob_regex("[a") is None and glob_regex("{a") is None


def test_dates():
    assert parse_after("2025-01-01") == 1735689600 and parse_after("7d", 10**6) == 10**6 - 7 * 86400
    assert parse_after("2w", 0) == -14 * 86400 and parse_after("1m", 0) == -30 * 86400
    assert parse_after("2025-02-31") == parse_after("2025-03-03")
    for bad in ("yesterday", "2025-13-01", "d", "1969-12-31", "2025-01-32", ""):
        with pytest.raises(ValueError):
            parse_after(bad)


def test_vector_batch_passes_on_few_rows_of_ties_and_odd_vectors(spark):
    from loamdex.operators import vector
    from pyspark.sql.types import DoubleType, StructField, StructType

    rng = random.Random(7)
    odd = [None, [], [0.0, 0.0], [1.0, None], [1.0], [float("nan"), 1.0], [float("inf"), 0.0]]
    rows = [(f"u{rng.randrange(400)}", i, "t", None, "md", v) for i, v in enumerate(odd + [[1.0, 0.0]] * 300 + [[0.0, 0.0]] * 300 + [[rng.gauss(0, 1), rng.gauss(0, 1)] for _ in range(400)])]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, CHUNK).coalesce(1).cache()
    for some, places in ((df, 4), (df.where(F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < 9))), 4)):
        asked = [(1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, [-1.0, 0.5]), (4, [3.0, 0.0, 0.0])]
        queries = spark.createDataFrame(asked, "query_id bigint, vector array<float>")
        got = vector_batch(some, queries, places).orderBy("query_id", "place").collect()
        for i, v in asked:
            want = [(r["uri"], r["chunk_index"], repr(r["score"])) for r in vector_search(some, v, places).collect()]
            assert [(r["uri"], r["chunk_index"], repr(r["score"] + 0.0)) for r in got if r["query_id"] == i] == want
        schema = StructType([queries.schema["query_id"], some.schema["uri"], some.schema["chunk_index"], StructField("score", DoubleType())])
        assert vector._block(some, queries.toArrow(), places, schema).count() == len(asked) * places


def test_vector_batch_takes_bounded_memory():
    import tracemalloc

    import numpy as np

    from loamdex.operators.vector import _nearest

    x = np.random.default_rng(1).normal(size=(10_000, 8)).astype(np.float32)
    tracemalloc.start()
    best = _nearest(x, np.arange(len(x)), x, len(x), 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (best.row[:, 0] == np.arange(len(x))).all() and peak < 100e6


def test_bm25_batch_never_makes_rows_of_hits(spark, monkeypatch):
    from loamdex.operators import keyword

    rng = random.Random(3)
    words = "budget ledger pool vector folder gateway".split()
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 9))) for _ in range(60)] * 5 + ["", None, "x"]
    df = spark.createDataFrame([(f"u{i}", i % 3, t) for i, t in enumerate(texts)], "uri string, chunk_index int, text string").coalesce(1).cache()
    asked = [(i, " ".join(rng.choices([*words, "absent"], k=i % 5))) for i in range(40)] + [(40, None), (41, "absent")]
    queries = spark.createDataFrame(asked, "query_id bigint, query_text string")
    passed, scored = [], keyword._scored
    monkeypatch.setattr(keyword, "_scored", lambda *a: passed.append(scored(*a)) or passed[-1])
    for tile, block in (((256, 1024), 50_000), ((7, 16), 9)):
        monkeypatch.setattr(keyword, "TILE", tile)
        monkeypatch.setattr(keyword, "QUERY_BLOCK", block)
        passed.clear()
        got = bm25_batch(df, queries, 3).orderBy("query_id", "place").collect()
        assert sum(p.where(F.col("query_id") == 3).count() for p in passed) <= 3 * 4  # k a task, though most of 303 chunks are hits
        for i in (3, 4, 8, 14, 29, 40, 41):
            want = [(r["uri"], r["score"]) for r in bm25_search(df, asked[i][1] or "", 3).collect()]
            assert [(r["uri"], pytest.approx(r["score"], abs=2e-6)) for r in got if r["query_id"] == i] == want


def test_bm25_batch_takes_rows_of_one_chunk_together(spark):
    schema, queries = "uri string, chunk_index int, text string", spark.createDataFrame([(1, "budget pool")], "query_id bigint, query_text string")
    rows = [("a", 0, "budget of pool"), ("b", 0, "vector"), ("a", 0, "pool and gateway and folder")]
    got = bm25_batch(spark.createDataFrame(rows, schema), queries, 5).collect()
    dl, avg, n, df = 8, 9 / 3, 3, 1
    want = sum(math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg)) for tf in (1, 2))
    assert [(r["uri"], r["place"]) for r in got] == [("a", 1)] and got[0]["score"] == pytest.approx(want, abs=1e-6)
