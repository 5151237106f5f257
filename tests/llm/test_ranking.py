import math
import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from loamdex.llm.ranking import beta_order_probability, fused_top, ranked_hits

QUERY = "query_id bigint, alpha float, search_mode string"
HIT = "query_id bigint, engine string, uri string, chunk_index int, score float"


def top(spark, queries, hits, k=5):
    return [tuple(r) for r in fused_top(spark.createDataFrame(queries, QUERY), spark.createDataFrame(hits, HIT), k).orderBy("query_id", "uri", "chunk_index").collect()]


def brute(hits, alpha, k):
    alpha = 0.7 if alpha is None else min(1, max(0, alpha))
    best = {}
    for _, e, u, c, s in hits:
        if s is not None and not math.isnan(s):
            best[e, u, c] = max(s, best.get((e, u, c), -math.inf))
    lists = {e: sorted((-s, u, c) for (x, u, c), s in best.items() if x == e) for e in {x for x, _, _ in best}}
    others = sum(e != "vector" for e in lists)
    weight = {e: alpha if e == "vector" else (1 - alpha) / others for e in lists}
    weight = {e: w for e, w in weight.items() if w > 0}
    whole, n = sum(weight.values()), len(weight)
    items = {x[1:] for e in weight for x in lists[e]}
    rank = {e: {x[1:]: i + 1 for i, x in enumerate(lists[e])} for e in weight}
    scores = {}
    for item in items:
        placed, sofar, least = sorted((rank[e][item] / len(items), -weight[e] / whole) for e in weight if item in rank[e]), 0, math.inf
        for i, (x, w) in enumerate(placed, 1):
            sofar -= w
            least = min(least, sum(math.comb(n, j) * x**j * (1 - x) ** (n - j) for j in range(i, n + 1)) / sofar)
        scores[item] = round(least, 9)
    return sorted(sorted(items, key=lambda x: (scores[x], x))[:k])


def test_the_probability_is_that_of_order_statistics(spark):
    cases = [(x, k, n) for n in range(1, 6) for k in range(1, n + 1) for x in (0.01, 0.3, 0.999, 1.0)]
    df = spark.createDataFrame(cases, "x double, k int, n int")
    for x, k, n, p in df.select("x", "k", "n", beta_order_probability(F.col("x"), F.col("k"), F.col("n"))).collect():
        assert p == pytest.approx(sum(math.comb(n, j) * x**j * (1 - x) ** (n - j) for j in range(k, n + 1)), abs=1e-12)


@pytest.mark.parametrize("alpha", [0.0, 0.35, None, 1.0, 7.0, -2.0])
def test_equals_brute_force(spark, alpha):
    rng = random.Random(3)
    hits = [(1, e, f"u{rng.randrange(12)}", rng.randrange(2), rng.choice([None, float("nan"), 0.5, rng.random() * 900])) for e, _ in product(("vector", "fts5", "tantivy", "other"), range(14))]
    assert [x[1:] for x in top(spark, [(1, alpha, "hybrid")], hits)] == brute(hits, alpha, 5)


def test_no_range_of_scores_decides(spark):
    hits = [(1, e, u, 0, 10.0 - i) for e, us in (("vector", "dabc"), ("fts5", "eabc"), ("tantivy", "fabc")) for i, u in enumerate(us)]
    scaled = [(q, e, u, c, s * 1e6 if e == "fts5" else s) for q, e, u, c, s in hits]
    assert top(spark, [(1, 0.5, "hybrid")], hits, 3) == top(spark, [(1, 0.5, "hybrid")], scaled, 3) == [(1, u, 0) for u in "abc"]


def test_repeats_modes_and_nothing(spark):
    hits = [(1, "vector", "a", 0, 0.9), (1, "fts5", "b", 0, 9.0), (1, "fts5", "b", 0, 9.0), (1, "tantivy", "c", 0, float("nan")), (2, "fts5", "a", 0, 1.0), (3, "vector", None, None, 1.0), (3, "fts5", None, None, 1.0)]
    queries = [(1, 0.4, "hybrid"), (1, 0.4, "hybrid"), (2, 0.4, "keyword_only"), (3, 0.5, "hybrid"), (4, 0.5, "hybrid"), (None, 0.5, "hybrid")]
    assert top(spark, queries, hits) == [(1, "a", 0), (1, "b", 0), (3, None, None)]
    assert top(spark, queries, hits, 1)[0] == (1, "b", 0)
    assert top(spark, queries, []) == [] and top(spark, [], hits) == []


def test_extra_columns_are_no_matter(spark):
    queries = spark.createDataFrame([(1, 0.5, "hybrid", 1, 2)], QUERY + ", score int, n int")
    hits = spark.createDataFrame([(1, "vector", "a", 0, 1.0, 3, 4)], HIT + ", alpha int, rank int")
    assert ranked_hits(queries, hits).count() == 1


def test_buckets_grow_with_the_score(spark):
    rng = random.Random(8)
    scores = sorted({0.0, 1.0, 2.0, 0.5, -0.5, -2.0, 3e38, 1e-38, 5e-324, 1e308, math.inf, -math.inf, *(2.0**e for e in range(-60, 60)), *(math.nextafter(2.0**e, 0) for e in range(-60, 60)), *(rng.uniform(-1, 1) * 10 ** rng.randrange(-9, 9) for _ in range(500))})
    from loamdex.llm.ranking import score_bucket

    df = spark.createDataFrame([(s,) for s in scores], "s double")
    got = [r["b"] for r in df.select("s", score_bucket(F.col("s")).alias("b")).orderBy("s").collect()]
    assert got == sorted(got) and len(set(got)) > 300


def test_long_lists(spark):
    rng = random.Random(9)
    hits = [(1, e, f"u{i:04}", 0, round(rng.gauss(0, 3), 2)) for e in ("vector", "fts5") for i in rng.sample(range(900), 600)]
    assert [x[1:] for x in top(spark, [(1, 0.6, "hybrid")], hits, 20)] == brute([(*h[:4], float(__import__("numpy").float32(h[4]))) for h in hits], 0.6, 20)
