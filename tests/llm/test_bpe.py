import base64
import subprocess
import sys
import unicodedata
from pathlib import Path

import pytest

import __spark_entry__ as entry
from loamdex.llm import bpe


def test_p8_ids_equals_tiktoken(spark, tmp_path):
    public, tiktoken = pytest.importorskip("public_tokenizers"), pytest.importorskip("tiktoken")
    with open(public.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [None, "", "  \n", "It's <|endoftext|> 12½ naïve 共通\r\n\x00é _x__", "ab" * 900, "x" * 5000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    rows = dict(map(tuple, entry.queries()["p8_ids"](spark, str(tmp_path)).collect()))
    assert rows == {i: own.encode_ordinary(t or "") for i, t in enumerate(texts)}


def test_a_worker_that_imports_only_the_module_has_what_it_needs():
    code = "import pyarrow as pa; from loamdex.llm import bpe; print(list(bpe._slices(pa.array(['a', None]))))"
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(bpe.__file__).parents[2], capture_output=True, text=True, check=False)
    assert done.stdout.strip() == "[(0, 2)]", done.stderr


@pytest.fixture
def folder():
    return pytest.importorskip("public_tokenizers")


def official(public, name):
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bpe.read_ranks(public.path(name)), special_tokens={})


def test_two_vocabularies_in_one_session(spark, folder):
    names = ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")
    text = "Größere Wörter, 共通の一覧 and 12 naïve words"
    df = spark.createDataFrame([(text,)], "text string").coalesce(1)
    for _ in range(3):
        for name in names:
            ids = bpe.encode_column(df, vocabulary=folder.path(name)).collect()[0]["ids"]
            assert ids == official(folder, name).encode_ordinary(text)


def test_both_sides_of_the_matrix_width(folder):
    own, encoder = official(folder, "byte_bpe_50k.tiktoken"), bpe.ByteBPE(bpe.read_ranks(folder.path("byte_bpe_50k.tiktoken")))
    for n in (1, 2, 8, 9, bpe.MATRIX_WIDTH - 1, bpe.MATRIX_WIDTH, bpe.MATRIX_WIDTH + 1, 5000):
        for text in ("a" * n, "ab" * n, "é" * n, ("Xyz" * n)[:n], "=" * n):
            assert encoder.encode([text, None, ""]) == [bytes(memoryview(bpe.np.array(own.encode_ordinary(text), "<i4"))), b"", b""], (n, text[:5])


def test_the_cache_is_bounded_and_changes_nothing(folder, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 2000)
    encoder = bpe.ByteBPE(bpe.read_ranks(folder.path("byte_bpe_50k.tiktoken")))
    texts = [f"word{i} again and again {'x' * i}" for i in range(300)]
    apart = [encoder.encode([t])[0] for t in texts]
    assert encoder.cached_bytes < 10_000 and all(len(w) <= bpe.CACHE_PIECE_CHARS for w in encoder.cache)
    assert encoder.encode(texts) == apart


def test_splits_as_the_public_pattern_does(folder):
    regex = pytest.importorskip("regex")
    public, own = regex.compile(folder.PATTERN), bpe.split_pattern()
    for c in [*range(0x0, 0x3000), *range(0xA000, 0xA800), *range(0x1F600, 0x1F650)]:
        text = f"ab{chr(c)}c {chr(c)}1 {chr(c)}\n"
        if own.findall(text) != public.findall(text):
            # Tables of different Unicode versions: characters that one of them does not know yet.
            assert unicodedata.category(chr(c)) == "Cn" or not regex.match(r"\P{Cn}", chr(c)) or c in range(0x1C80, 0x1C90), hex(c)


def test_counting_and_clashing_columns(spark):
    df = spark.createDataFrame([("one two", 5, 9), (None, 5, 9), ("", 5, 9)], "text string, tokens int, ids int")
    assert [tuple(r) for r in bpe.count_tokens(df).collect()] == [("one two", 9, 2), (None, 9, 0), ("", 9, 0)]
    assert bpe.encode_column(df.limit(0)).collect() == []
