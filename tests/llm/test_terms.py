import math
import re
from collections import Counter

import pytest

from loamdex.llm.terms import characteristic_terms

DOC = "doc_id bigint, text string, term int, tf int"


def found(spark, docs, probes, k=1):
    df = spark.createDataFrame([(i, t, 1, 1) for i, t in docs], DOC)
    rows = characteristic_terms(df, spark.createDataFrame([(p,) for p in probes], "doc_id bigint"), k).collect()
    return sorted((r["doc_id"], r["term"], r["score"]) for r in rows)


def brute(docs, probes, k):
    terms = {i: [x.lower() for x in re.findall(r"[^\W_]+", t or "") if len(x.encode()) >= 2] for i, t in docs}
    total = Counter(x for ts in terms.values() for x in ts)
    mean = sum(total.values()) / len(docs)
    out = []
    for p in probes:
        scores = {}
        for t, tf in Counter(terms.get(p, [])).items():
            rate, n = total[t] / len(docs), tf * math.log2(1 + mean / len(terms[p]))
            chance = (1 / (1 + rate)) * (rate / (1 + rate)) ** n
            scores[t] = -math.log2(chance) / (n + 1)
        out += [(p, t, pytest.approx(scores[t])) for t in sorted(scores, key=lambda t: (-round(scores[t], 9), t))[:k]]
    return sorted(out, key=lambda x: x[:2])


def test_equals_brute_force(spark):
    words = "the of a4 zebra Émile 共通 x budget".split()
    docs = [(i, " ".join(words[(i * j) % len(words)] for j in range(1, 6 + i % 9))) for i in range(60)] + [(60, None), (61, ""), (62, " .. ")]
    assert found(spark, docs, [1, 5, 17, 60, 61, 62, 99], 3) == brute(docs, [1, 5, 17, 60, 61, 62, 99], 3)


def test_rare_and_repeated_beats_common(spark):
    docs = [(1, "the the the zebra zebra x"), (2, "the the cat"), (3, "the dog"), (4, None)]
    assert [r[:2] for r in found(spark, docs, [1, 4, 1, None])] == [(1, "zebra")]


def test_ties_go_by_term_and_nothing_gives_nothing(spark):
    assert [r[1] for r in found(spark, [(1, "beta alpha"), (2, "gamma delta")], [1])] == ["alpha"]
    assert found(spark, [], [1]) == [] and found(spark, [(1, "a b")], []) == []
