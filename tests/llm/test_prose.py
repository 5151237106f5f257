import numpy as np
import pytest

from loamdex.llm.prose import EXAMPLES, PROSE_SHARE, distributions, divergence, not_prose, prose_statistics, statistics

SENTENCE = "There are small notes and there are long ones, and we must not mix the two before lunch. "
GERMAN = "Der Bericht ist seit dem Sommer nicht mehr in dem Schrank, und keiner von uns weiß, warum das so ist. "


def share(text):
    return statistics([text])[0][6]


@pytest.mark.parametrize("text", [SENTENCE * 3, GERMAN * 2, SENTENCE * 3 + "\n\n- a list\n- of two", "# Title\n\n" + SENTENCE, SENTENCE.replace(" ", "\n", 40), "月末に、報告書の中にある文書を削除します。なぜ残っているのか、まだ分かっていません。", "﻿" + SENTENCE, SENTENCE.replace(". ", ".\r\n\r\n") * 2])
def test_prose(text):
    assert share(text) >= PROSE_SHARE


@pytest.mark.parametrize("text", [" ".join(SENTENCE), "- Add pool in market\n- Fix store in garden\n- Drop old paint\n- Rename street in letters\n", "a,b,c\n1,2,3\n4,5,6\n", "[server]\nkey = 12\nlog_path = \"/var/x\"\nuse_cache = true\n", "2024-01-01T00:00:00Z INFO [x-1] job took=35ms\n" * 4, "aGVsbG8gd29ybGQxMjM0NTY3ODkw" * 20, SENTENCE + "\n\n" + "- green garden table\n" * 40])
def test_other_structures(text):
    assert share(text) < PROSE_SHARE


def test_examples_are_nearest_to_themselves():
    assert {k.partition("-")[0] for k in EXAMPLES} >= {"prose", "list", "table", "log", "settings", "junk"}
    for name, text in EXAMPLES.items():
        assert statistics([text])[0][8] == name.partition("-")[0]


def test_divergence_is_that_of_jensen_and_shannon():
    p, q = np.array([[1.0, 0, 0], [1, 1, 2]]), np.array([[0, 1.0, 0]])
    d = divergence(p, q)
    assert d[0, 0] == pytest.approx(1, abs=0.05) and divergence(p, p).diagonal() == pytest.approx([0, 0]) and (divergence(p, q) == divergence(q, p).T).all()


def test_counts_add_up():
    blocks = ["Hallo, Welt 12!", "", "共通の一覧 x"]
    chars, words = distributions(blocks)
    assert chars.sum(1).tolist() == [len(b) for b in blocks] and words.sum(1).tolist() == [3, 0, 2]
    n, length, lines, function, symbols, ends, *_ = statistics(["The cat sat.\non a mat"])[0]
    assert (n, lines) == (6, 2) and function == pytest.approx(3 / 6) and ends == 0.5 and length == pytest.approx(15 / 6)
    assert statistics([None, "", " \n", "﻿", "\0\r\n"]) == [None] * 5


def test_rows(spark):
    rows = [(1, "text", SENTENCE), (2, "code", "x = 1"), (3, None, "a,b\n1,2\n3,4"), (4, "text", None), (5, "text", " "), (1, "text", SENTENCE), (6, "data", "key: value, " * 100_000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, content_type string, text string, prose int")
    assert sorted(r["doc_id"] for r in prose_statistics(docs).collect()) == [1, 1, 3, 6]
    assert sorted(r["doc_id"] for r in not_prose(docs).collect()) == [3, 6]
    assert prose_statistics(docs.limit(0)).count() == 0
