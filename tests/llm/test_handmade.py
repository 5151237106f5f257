from pyspark.sql import functions as F

from loamdex.llm.handmade import kind_of, merkle_nodes, not_by_hand, shared_files

HAND = "import a\n\ndef f(x):\n    return x\n"
DOC = "uri string, source string, content_type string, text string"


def test_kinds():
    assert kind_of("/r/src/vendor_portal/a.py", HAND) is None and kind_of("/r/src/vendor/b/a.py", HAND) == "vendored"
    assert kind_of("/r/a.py", "# Code generated by x. DO NOT EDIT.\n" + HAND) == "generated"
    assert kind_of("/r/a.py", "# Written by hand; this replaces the generated version.\n" + HAND) is None
    assert kind_of("/r/a.js", "function a(b){return c.d(e)||1}" * 20) == "minified"
    assert kind_of("/r/a.c", "T x[] = {\n" + "0xa0, 0xeb, 0x9c, 0x51,\n" * 9 + "};\n") == "data"
    assert kind_of("/r/vendor/a.py", " \n") is None and kind_of(None, None) is None


def body(name):
    return f"def {name}(x):\n" + f"    {name}.add(x, {name})\n" * 9


def test_subtrees_of_unrelated_collections_are_vendored(spark):
    rows = [
        ("/c/repos/a/lib/p/x.py", "a", body("tree")),
        ("/c/repos/a/lib/p/tiny.py", "a", "x"),
        ("/c/repos/b/deep/er/p/x.py", "b", body("tree").replace("\n", "\r\n")),
        ("/c/repos/b/deep/er/p/tiny.py", None, "x"),
        ("/c/repos/a/own.py", "a", body("own") * 9),
        ("/c/repos/a/own2.py", "a", body("own") * 9),
        ("/c/repos/b/own.py", "b", body("other") * 9),
        ("/c/repos/e/blank.py", "e", " \n"),
        ("/c/repos/f/blank.py", "f", " \n"),
        ("/c/repos/c/m.py", "c", body("mirror")),
        ("/c/repos/d/m.py", "d", body("mirror")),
        (None, "a", body("tree")),
    ]
    docs = spark.createDataFrame([(u, s, "code", t) for u, s, t in rows], DOC)
    tree = {"/c/repos/a/lib/p/x.py", "/c/repos/a/lib/p/tiny.py", "/c/repos/b/deep/er/p/x.py", "/c/repos/b/deep/er/p/tiny.py"}
    assert {r["uri"] for r in shared_files(docs).collect()} == tree
    assert {(r["uri"], r["kind"]) for r in not_by_hand(docs.withColumn("kind", F.lit(1)).withColumn("path", F.lit(2))).collect()} == {(u, "vendored") for u in tree}
    assert not_by_hand(docs.limit(0)).count() == 0


def test_a_directory_hash_is_that_of_its_files(spark):
    def roots(files):
        df = spark.createDataFrame([(p, 1, h, h * 7, 5) for p, h in files], "path string, collection bigint, h1 bigint, h2 bigint, size bigint")
        return {r["path"]: (r["h1"], r["h2"]) for r in merkle_nodes(df).collect()}

    a = roots([("r/p/x", 1), ("r/p/q/y", 2), ("s/p/x", 1), ("s/p/q/y", 2), ("t/p/x", 2), ("t/p/q/y", 1), ("u/p/z", 1), ("u/p/q/y", 2)])
    assert a["r/p"] == a["s/p"] and a["r"] == a["s"]
    assert len({a["r/p"], a["t/p"], a["u/p"]}) == 3 and a["r/p/q"] == a["u/p/q"]


def test_files_of_several_rows_count_once(spark):
    docs = spark.createDataFrame([("/r/a.js", None, "code", "function a(b){return c.d(e)||1}" * 20)] * 3 + [("/r/b.md", None, "text", "# Code generated by x. DO NOT EDIT.")], DOC)
    assert [tuple(r) for r in not_by_hand(docs).collect()] == [("/r/a.js", "minified")]
