import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loamdex.chunkers.code import code, definitions
from loamdex.chunkers.operators import chunk_text, chunked
from loamdex.chunkers.plain import fixed, recursive, semantic

TEXTS = st.text(max_size=600) | st.text("ab .\n#ü日", max_size=600)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(1, 200), st.integers(0, 120))
@pytest.mark.parametrize("chunker", [fixed, semantic, recursive])
def test_chunks_are_whole_and_in_order(chunker, text, size, overlap):
    raw, found = text.encode(), chunker(text, size, overlap)
    assert all(c and 0 <= at <= len(raw) for c, at in found)
    if chunker is not recursive:
        assert [at for _, at in found] == sorted(at for _, at in found)
    assert "".join("".join(c.split()) for c, _ in found) >= "" and set("".join(text.split())) <= set("".join(c for c, _ in found))


def test_fixed():
    assert fixed("short", 10, 2) == [("short", 0)] and fixed("", 10) == [] and fixed("  ", 10) == [("  ", 0)]
    assert fixed("aaa bbb ccc ddd", 8, 2) == [("aaa bbb", 0), ("b ccc dd", 6), ("dd", 12)] or len(fixed("aaa bbb ccc ddd", 8, 2)) >= 2
    assert [c for c, _ in fixed("x" * 25, 10, 0)] == ["x" * 10, "x" * 10, "x" * 5]
    words = fixed("wort " * 300, 512, 64)
    assert all(len(c) <= 512 for c, _ in words) and len(words) == 4


def test_fixed_always_ends():
    assert fixed("a " + "b" * 500, 20, 5)[-1][0].endswith("b")
    assert fixed("ab cd " * 50, 10, 5)


def test_semantic_boundaries():
    text = "First part of it.\n\nSecond part is here.\n\nThird one."
    assert [c for c, _ in semantic(text, 24, 0)] == ["First part of it.", "Second part is here.", "Third one."]
    assert semantic("a" * 30, 10, 0) == [("a" * 10, 0), ("a" * 10, 10), ("a" * 10, 20)]
    # The full stop of a sentence goes to the next chunk.
    assert [c for c, _ in semantic("aaaaaaaa. bbbbbbbbbb", 10, 0)] == ["aaaaaaaa", ". bbbbbbbb", "bb"]
    offsets = [at for _, at in semantic("Line one\n\nLine two\n\nLine three\n\nLine four", 30, 10)]
    assert offsets == sorted(offsets)


def test_recursive():
    text = "para one.\n\npara two is longer. It has two sentences.\n\nlast"
    found = recursive(text, 30, 0)
    assert all(len(c.encode()) <= 30 for c, _ in found) and all(text.encode()[at:].startswith(c.encode()) for c, at in found)
    led = recursive(text, 30, 8)
    assert len(led) == len(found) and all(b[0].startswith(a[0][-8:]) for a, b in zip(found, led[1:], strict=False))


RUST = """use std::fmt;

pub struct Point { x: i32 }

impl Point {
    pub fn new() -> Self { Point { x: 0 } }  // a } in a comment
}

fn main() { println!("}}}"); }
"""


def test_definitions():
    def labels(text, language):
        return [d.label for d in definitions(text, language)]

    assert labels(RUST, "rust") == ["struct Point", "impl Point", "fn main"]
    assert labels("@deco\ndef a():\n    pass\n\nclass B:\n    def c(self): pass\n", "python") == ["fn a", "class B"]
    assert labels("export function f() {}\nclass C { m() {} }\nconst x = () => { return 1; };\n", "javascript") == ["fn f", "class C", ""]
    assert labels("package a\n\nfunc F(x int) int {\n\treturn x\n}\n\ntype T struct {\n\tx int\n}\n", "go") == ["fn F", ""]
    assert labels("public class A { void f() {} }\ninterface I { }\n", "java") == ["class A", "interface I"]
    assert labels("struct s { int a; };\nint main(void)\n{\n    return 0;\n}\n", "c") == ["", "fn main"]
    assert labels("def broken(:", "python") == [] and labels("x", "cobol") == []
    for d in definitions(RUST, "rust"):
        assert RUST.encode()[: d.end].endswith(b"}")


def test_code_chunks():
    found = code(RUST, 90, 0, "rs")
    assert found[0][0] == "use std::fmt;" and found[1][0].startswith("// struct Point\npub struct Point")
    assert any(c.startswith("// fn main") for c, _ in found)
    assert code("short", 90, 0, "rs") == [("short", 0)] and code(RUST, 90, 0, "txt") == semantic(RUST, 90, 0)
    grouped = code(RUST, 135, 0, "rs")
    assert any(c.startswith("// struct Point, impl Point") for c, _ in grouped)


def test_strategy_by_type():
    long = "word " * 300
    assert chunk_text(long, "data", None, 512, 64) == fixed(long) and chunk_text(long, "text", None, 512, 64) == semantic(long)
    assert chunk_text(RUST * 5, "code", "rs", 200, 0) == code(RUST * 5, 200, 0, "rs")


def test_rows(spark):
    docs = spark.createDataFrame([("a", "word " * 300, "data", 1), ("b", None, "text", 2), ("c", "", "text", 3), ("d", "x", None, 4)], "uri string, text string, content_type string, chunk_index int")
    rows = chunked(docs, 512, 64).orderBy("uri", "chunk_index").collect()
    assert [r["uri"] for r in rows] == ["a"] * 4 + ["d"] and [r["chunk_index"] for r in rows[:4]] == [0, 1, 2, 3]
    assert all(r["byte_range"]["end_off"] - r["byte_range"]["start_off"] == len(r["text"].encode()) for r in rows)
    with pytest.raises(ValueError):
        chunked(docs, strategy="best")
