from hypothesis import given, settings
from hypothesis import strategies as st

from loamdex.llm.splitting import oversized, split_bytes, split_oversized

CHUNK = "chunk_id bigint, content_type string, text string, byte_range struct<start_off: bigint, end_off: bigint>, chunk_size int"
PROFILE = "content_type string, chunk_size int, chunk_overlap int, text string"


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=400) | st.text("ab .\n。ü", max_size=400), st.integers(4, 90), st.integers(0, 120))
def test_pieces_fit_overlap_and_lose_nothing(text, size, overlap):
    raw = text.encode()
    parts = split_bytes(raw, size, overlap)
    assert parts[0][0] == 0 and parts[-1][1] == len(raw) and all(b - a <= size for a, b in parts)
    assert [raw[a:b].decode() for a, b in parts] and (len(parts) > 1) == (len(raw) > size)
    lead = max(0, min(overlap, size - 4))
    for (_, end), (start, stop) in zip(parts, parts[1:], strict=False):
        assert start <= end < stop and end - start <= lead
        # All of the overlap is there, but for part of a character at its start or the text's own start.
        assert start == 0 or end - start > lead - 4
    assert b"".join([raw[parts[0][0] : parts[0][1]], *[raw[p[1] : q[1]] for p, q in zip(parts, parts[1:], strict=False)]]) == raw


def test_cuts_at_the_strongest_boundary_near_the_middle():
    raw = b"one two three. four five six\n\nseven eight nine ten eleven"
    assert split_bytes(raw, 40, 0) == [(0, 30), (30, len(raw))]
    assert split_bytes(b"x" * 100, 60, 0) == [(0, 50), (50, 100)]


def test_only_oversized_chunks_have_pieces(spark):
    rows = [(1, "text", "word " * 30, (100, 250), 1), (2, "text", "short", None, 1), (3, "text", None, None, 1), (4, "none", "x" * 900, None, 1), (5, None, "x" * 900, None, 1), (6, "code", "é" * 40, None, 1), (6, "code", "é" * 40, None, 1), (7, "odd", "x" * 900, None, 1), (8, "code", "", None, 1)]
    profiles = [("text", 50, 10, None), ("text", 60, 0, None), ("code", 64, None, None), ("odd", None, 1, None), (None, 1, 1, None)]
    pieces = split_oversized(spark.createDataFrame(rows, CHUNK), spark.createDataFrame(profiles, PROFILE))
    got = sorted(pieces.collect(), key=lambda r: (r["chunk_id"], r["piece_index"]))
    assert {r["chunk_id"] for r in got} == {1, 6} and sorted(r[0] for r in oversized(pieces).collect()) == [1, 6]
    first = [r for r in got if r["chunk_id"] == 1]
    assert all(len(r["text"].encode()) <= 50 and r["text"].encode() == (b"word " * 30)[r["byte_range"]["start_off"] : r["byte_range"]["end_off"]] for r in first)
    assert first[0]["source_range"]["start_off"] == 100 and first[-1]["source_range"]["end_off"] == 250
    assert [r["source_range"] for r in got if r["chunk_id"] == 6] == [None] * 4


def test_very_long_text(spark):
    text = "no boundary at all".replace(" ", "") * 60_000
    pieces = split_oversized(spark.createDataFrame([(1, "text", text, None, 1)], CHUNK), spark.createDataFrame([("text", 512, 64, None)], PROFILE))
    n, least, most = pieces.selectExpr("count(*)", "min(octet_length(text))", "max(octet_length(text))").collect()[0]
    assert n > len(text) / 512 and most <= 512 and least > 100


def test_empty_tables(spark):
    assert split_oversized(spark.createDataFrame([], CHUNK), spark.createDataFrame([], PROFILE)).count() == 0
