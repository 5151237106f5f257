from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loamdex.llm import mixing
from loamdex.llm.mixing import mix_shares, number_in_source, sample_mix, short_sources

DOC = "doc_id bigint, source string, text string, copies int"
TARGET = "mix_name string, source string, target_share double, max_repeats int, budget_tokens bigint"


@pytest.fixture
def docs(spark):
    rows = [(i, "big" if i % 3 else "small", "one two three four " * (1 + i % 4), 7) for i in range(300)]
    return spark.createDataFrame(rows + [(900, "none", None, 7), (901, "none", "", 7), (902, None, "x y z", 7)], DOC).repartition(5)


def test_short_sources(spark, docs):
    targets = [("m", "big", 0.5, 1, 100), ("m", "small", 0.9, 2, 10**6), ("m", "absent", 0.1, 9, 12), ("m", "none", 0.1, 9, 12), ("z", "absent", 0.0, 9, 12), ("n", "big", None, 2, 5), (None, "absent", 0.5, 1, 5)]
    got = {tuple(r) for r in short_sources(docs, spark.createDataFrame(targets, TARGET)).collect()}
    assert got == {("m", "small"), ("m", "absent"), ("m", "none"), (None, "absent")}


def test_shares_are_reached_and_repeats_capped(spark, docs):
    targets = [("m", "big", 0.6, 3, 3000), ("m", "small", 0.4, 2, 3000), ("n", "small", 0.9, 2, 10**5), ("n", "absent", 0.1, 5, 10**5)]
    df = spark.createDataFrame(targets, TARGET)
    drawn = sample_mix(docs, df, seed=5).collect()
    assert max(r["copies"] for r in drawn if r["mix_name"] == "n") == 2 and min(r["copies"] for r in drawn) >= 1
    assert len({(r["mix_name"], r["doc_id"]) for r in drawn}) == len(drawn)
    shares = {(r["mix_name"], r["source"]): r for r in mix_shares(docs, df, seed=5).collect()}
    for key, share in {("m", "big"): 0.6, ("m", "small"): 0.4}.items():
        assert shares[key]["actual_share"] == pytest.approx(share, rel=0.08) and not shares[key]["short"]
    # A source that is too small gives every document max_repeats times.
    assert shares["n", "small"]["documents"] == 100 and shares["n", "small"]["short"]
    assert shares["n", "absent"]["actual_share"] == 0 and shares["n", "absent"]["documents"] == 0
    again = sample_mix(docs.repartition(2), df, seed=5).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, drawn))


def test_copies_follow_the_interval_of_each_document(spark, docs):
    rows = number_in_source(docs.select("doc_id", "source").where("source is not null")).collect()
    places = defaultdict(list)
    for r in rows:
        places[r["source"]].append(r["position"])
    assert all(sorted(p) == list(range(1, len(p) + 1)) for p in places.values())
    drawn = sample_mix(docs, spark.createDataFrame([("m", "big", 1.0, 1, 150)], TARGET)).count()
    tokens = sum(r["tokens"] for r in sample_mix(docs, spark.createDataFrame([("m", "big", 1.0, 1, 10**9)], TARGET)).collect())
    assert abs(drawn - 200 * 150 / tokens) < 1


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], TARGET)
    assert sample_mix(docs, none).count() == 0 and mix_shares(docs.limit(0), none).count() == 0
    assert sample_mix(docs.limit(0), spark.createDataFrame([("m", "big", 0.6, 3, 3000)], TARGET)).count() == 0


def test_short_sources_follow_from_the_sample(spark, docs, monkeypatch):
    targets = spark.createDataFrame([("m", "big", 0.5, 1, 100), ("m", "small", 0.9, 2, 10**6), ("m", "absent", 0.1, 9, 12), ("n", "small", 1.0, 3, 10**6)], TARGET)
    want = {("m", "small"), ("n", "small"), ("m", "absent")}
    for seed in range(3):
        assert {tuple(r) for r in short_sources(docs, targets, seed).collect()} == want
    draw = mixing.draw
    # A sampler that leaves out a document has not used up the source.
    monkeypatch.setattr(mixing, "draw", lambda *args: draw(*args).where("doc_id <> 3"))
    assert {tuple(r) for r in short_sources(docs, targets).collect()} == {("m", "absent")}
    monkeypatch.setattr(mixing, "draw", lambda *args: draw(*args).withColumn("copies", F.lit(1)))
    assert {tuple(r) for r in short_sources(docs, targets).collect()} == {("m", "absent")}


def test_a_share_that_is_just_reached_is_not_short(spark, docs):
    one = spark.createDataFrame([("m", "small", 1.0, 1, 10**9)], TARGET)
    tokens = mix_shares(docs, one).first()["drawn_tokens"]
    rows = [(f"{r} {d}", "small", 1.0, r, r * tokens + d) for r in (1, 3, 7) for d in (-1, 0, 1)]
    got = {r["mix_name"] for r in short_sources(docs, spark.createDataFrame(rows, TARGET)).collect()}
    assert got == {"1 1", "3 1", "7 1"}


def test_targets_without_a_mix_or_repeated(spark, docs):
    rows = [(None, "small", 0.9, 2, 10**6), (None, "small", 0.9, 2, 10**6), (None, "small", 0.5, 1, 1000), ("m", "big", 0.5, 0, 100)]
    df = spark.createDataFrame(rows, TARGET)
    assert {tuple(r) for r in short_sources(docs, df).collect()} == {(None, "small"), ("m", "big")}
    shares = {(r["mix_name"], r["target_share"]): r for r in mix_shares(docs, df).collect()}
    assert len(shares) == 3 and shares[None, 0.9]["documents"] == 100 and shares[None, 0.9]["short"]
    assert not shares[None, 0.5]["short"] and shares[None, 0.5]["actual_share"] == pytest.approx(0.5, abs=0.1)
    assert max(r["copies"] for r in sample_mix(docs, df).collect()) == 2
