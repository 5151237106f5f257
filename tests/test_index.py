import io
import json
import os
import threading
import time
from urllib.request import urlopen

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamdex.config import Config
from loamdex.embed import embedders, models
from loamdex.embed.embedders import HashingEmbedder, VisionEmbedder, mean_pooled
from loamdex.embed.operators import cache_stats, embedded, looked_up, put, text_hash, with_image_vectors, with_vectors
from loamdex.errors import ConfigError, LoamdexError, ModelError, ParseError, StorageError, UsageError, exit_code
from loamdex.functions.vector import cosine, literal, normalised, truncated, unpacked, zeros
from loamdex.operators import metadata
from loamdex.operators.export import export_lines, iterate_lines, write_jsonl
from loamdex.plans.ingest import prune, remove, scan
from loamdex.serve import cli
from loamdex.serve.engine import Engine
from loamdex.serve.http import answer, server
from loamdex.serve.output import context, format_results, line_range, round2, shortened, size_text
from loamdex.serve.tools import ToolServer
from loamdex.sources.filesystem import FilesystemSource, ScanOptions, listed, walk
from loamdex.sources.ignore import Overrides, Rules
from loamdex.sources.mime import MIME_OF, extension_of, mime_of_name, sniff
from loamdex.store import Index
from loamdex.streaming.watch import Debouncer, FolderWatcher, debounced, debounced_counts, watch

FILES = {
    "readme.md": "# Payments\n\nHow payment processing works and what error handling does.\n",
    "notes.txt": "Notes on quarterly revenue, the budget and two forecasts.\n",
    "main.rs": "struct Config { port: u16 }\n\nimpl Config { fn server(&self) {} }\n\nfn main() { run(); }\n",
    "utils.py": "class Money:\n    pass\n\ndef revenue(x):\n    return x\n\ndef currency(x):\n    return x\n",
    "data.json": '{"name": "shop", "tags": ["a", "b"]}',
    "data.csv": "name,score,department\nann,3,x\nbob,4,y\ncid,5,z\n",
    "page.html": "<html><head><title>Shop page</title></head><body><h1>Welcome</h1><p>Buy bread here</p></body></html>",
    "config.toml": "[server]\nport = 1\n\n[client]\nname = 'x'\n",
    "src/lib.rs": "pub fn version() -> &'static str { \"1\" }\n",
    "src/__init__.py": "x = 1\n",
    "src/deep/er/far.txt": "far away\n",
    ".hidden/secret.md": "secret\n",
    "build/out.txt": "built\n",
    "skip.log": "log\n",
    ".gitignore": "build/\n*.log\n!keep.log\n",
    "keep.log": "kept\n",
    "skills/a/SKILL.md": "---\nname: bake\ndescription: Bakes bread\n---\n# Bake\n\nBake bread with flour.\n",
}


@pytest.fixture
def corpus(tmp_path):
    for name, body in FILES.items():
        path = tmp_path / "c" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body)
    return tmp_path / "c"


@pytest.fixture
def index(spark, tmp_path):
    return Index(spark, tmp_path / "index")


def names(corpus, **options):
    return {os.path.relpath(p, corpus) for p, _, _ in walk(str(corpus), ScanOptions(**options))}


def test_walk(corpus, monkeypatch):
    monkeypatch.setenv("XDG_CONFIG_HOME", str(corpus / "none"))
    every = names(corpus)
    assert every == set(FILES) - {".hidden/secret.md", "build/out.txt", "skip.log", ".gitignore"} and "src/__init__.py" in every
    assert names(corpus, max_depth=1) == {n for n in every if "/" not in n}
    assert names(corpus, include=["*.rs"]) == {"main.rs", "src/lib.rs"}
    assert names(corpus, exclude=["src", "*.md"]) == {n for n in every if not n.startswith("src") and not n.endswith(".md")}
    assert names(corpus / "gone") == set()
    (corpus / "src" / ".gitignore").write_text("/lib.rs\ndeep/**/far.txt\n")
    assert names(corpus) == every - {"src/lib.rs", "src/deep/er/far.txt"}


def test_ignore_rules():
    rules = Rules(["# c", "*.pyc", "/top", "a/b", "dir/", "!x.pyc", r"\#odd", "d[0-9]?", "**/deep/z"])
    for path, is_dir, out in (("m/n.pyc", False, True), ("x.pyc", False, False), ("top", False, True), ("s/top", False, None), ("a/b", False, True), ("c/a/b", False, None), ("q/dir", True, True), ("q/dir", False, None), ("#odd", False, True), ("d1x", False, True), ("p/q/deep/z", False, True), ("other", False, None)):
        assert rules.verdict(path, is_dir) is out, path
    assert Overrides(["[bad"], []).left_out("x", False) in (True, False)


def test_mime():
    assert mime_of_name("/a/b.rs") == "text/x-rust" and mime_of_name("/a/B.RS") is None and extension_of("/a.b/.hidden") is None and extension_of("/x/y.tar.gz") == "gz"
    assert sniff(b"\x89PNG\r\n\x1a\n") == "image/png" and sniff(b"PK\x03\x04....word/") == MIME_OF["docx"] and sniff(b"plain") is None and sniff(b"  <!DOCTYPE HTML>") == "text/html"


def test_discovery(spark, corpus):
    def found(**o):
        return {os.path.basename(r["path"]): r for r in FilesystemSource().discover(spark, ScanOptions([str(corpus)], **o)).collect()}

    rows = found()
    r = rows["readme.md"]
    assert r["uri"] == f"file://{r['path']}" and len(r["content_hash"]) == 32 and r["size"] == len(FILES["readme.md"]) and r["mime_type"] == "text/markdown" and abs(r["modified_at"] - time.time()) < 100
    assert set(found(file_types=["rs"])) == {"main.rs", "lib.rs"} and "page.html" in found(file_types=["html"]) and "data.json" in found(file_types=["json"])
    assert set(found(max_file_size=20)) == {n for n, row in rows.items() if row["size"] <= 20}
    (corpus / "noext").write_text("?")
    assert "noext" not in found()
    gone = spark.createDataFrame([(str(corpus / "gone"), 1, 1)], "path string, size bigint, modified_at bigint")
    assert listed(gone).count() == 0


def test_scan_is_incremental(spark, corpus, index, tmp_path):
    options = ScanOptions([str(corpus)])
    assert scan(spark, index, ScanOptions([str(corpus)], dry_run=True)).discovered == 13 and not index.exists()
    (corpus / "bad.docx").write_bytes(b"broken")
    (corpus / "empty.txt").write_text("")
    first = scan(spark, index, options, HashingEmbedder(8), 200, 20)
    assert (first.discovered, first.skipped, first.indexed, first.errors) == (15, 0, 14, 1) and first.chunks >= 13 and first.file_types["rs"] == 2 and "bad.docx" in first.failures[0][0]
    chunks = index.table("chunks")
    assert {r[0] for r in chunks.select("content_type").distinct().collect()} == {"text", "code", "data"} and chunks.where(F.size("vector") != 8).count() == 0
    assert index.table("sources").where(F.col("uri").endswith("empty.txt")).collect()[0]["chunk_count"] == 0
    again = scan(spark, index, options, HashingEmbedder(8), 200, 20)
    assert (again.skipped, again.indexed, again.errors) == (14, 0, 1)
    (corpus / "notes.txt").write_text("entirely new words")
    (corpus / "more.txt").write_text("Notes on nothing")
    (corpus / "bad.docx").unlink()
    third = scan(spark, index, options, HashingEmbedder(8), 200, 20)
    assert (third.discovered, third.skipped, third.indexed) == (15, 13, 2)
    mine = index.table("chunks").where(F.col("uri").endswith("notes.txt"))
    assert [r["text"] for r in mine.collect()] == ["entirely new words"]
    assert len(list((tmp_path / "index").glob("v=*"))) == 2
    (corpus / "more.txt").unlink()
    before = index.table("sources").count()
    assert scan(spark, index, options).skipped == 14 and index.table("sources").count() == before
    assert prune(index) == 1 and index.table("sources").where(F.col("uri").endswith("more.txt")).count() == 0
    assert remove(index, str(corpus / "src")) == 0 and remove(index, str(corpus / "src"), prefix=True) == 3
    assert remove(index, f"file://{corpus}/readme.md") == 1 and index.table("chunks").where(F.col("uri").endswith("readme.md")).count() == 0


def test_a_failed_scan_changes_nothing(spark, corpus, index, monkeypatch):
    options = ScanOptions([str(corpus)])
    scan(spark, index, options)
    version = index.version
    (corpus / "new.txt").write_text("new")
    with monkeypatch.context() as m:
        m.setattr(os, "replace", lambda *_: (_ for _ in ()).throw(OSError("full")))
        with pytest.raises(OSError):
            scan(spark, index, options)
    assert index.version == version and index.table("sources").where(F.col("uri").endswith("new.txt")).count() == 0
    with index.lock(), pytest.raises(StorageError):
        scan(spark, Index(spark, index.folder), options)
    assert scan(spark, index, options).indexed == 1
    (index.folder / "CURRENT").write_text("?")
    with pytest.raises(StorageError):
        index.table("chunks")


@pytest.fixture
def engine(spark, corpus, index):
    scan(spark, index, ScanOptions([str(corpus)]), HashingEmbedder(32))
    return Engine(index, Config(), HashingEmbedder(32))


def test_engine(engine, index):
    def first(*args, **kw):
        return os.path.basename(engine.search(*args, **kw)[0]["uri"])

    assert first("payment error") == "readme.md" and first("revenue budget forecasts", mode="keyword") == "notes.txt" and first("bread flour", mode="vector") in ("SKILL.md", "page.html")
    assert {r["file_type"] for r in engine.search("revenue fn", 10, file_type="py")} == {"py"}
    assert all("/src/" in r["uri"] for r in engine.search("version fn", 10, path="*/src/*"))
    assert engine.search("payment", 5, threshold=0.5) == [] and len(engine.search("payment", 5, "keyword", since=0)) > 0 and engine.search("payment", 5, since=2**40) == []
    assert next(engine.streamed("payment", 3))["uri"].endswith("readme.md")
    plain = Engine(index)
    assert plain.mode("vector") == "keyword" and plain.search("payment", 3, "vector")[0]["uri"].endswith("readme.md")
    assert engine.status()["total_sources"] == 13 and engine.status()["file_type_counts"]["rs"] == 2
    assert Engine(Index(index.spark, index.folder / "none")).search("x") == []
    with pytest.raises(LoamdexError):
        Engine(index, keyword="none")


def test_http(engine, index):
    assert answer(engine, "/health") == (200, "text/plain", "ok")
    status, _, body = answer(engine, "/api/search?q=payment&limit=3&mode=keyword")
    found = json.loads(body)
    assert status == 200 and found["mode"] == "keyword" and found["total"] == len(found["results"]) and found["results"][0]["uri"].endswith("readme.md") and "byte_range" not in found["results"][0]
    assert {r["file_type"] for r in json.loads(answer(engine, "/api/search?q=payment+fn&type=rs")[2])["results"]} <= {"rs"}
    assert answer(Engine(index), "/api/search?q=x&mode=vector")[0] == 400 and answer(engine, "/api/search")[0] == 400 and answer(engine, "/nope")[0] == 404
    assert json.loads(answer(engine, "/api/status")[2])["has_embedder"]
    running = server(engine, port=0)
    threading.Thread(target=running.serve_forever, daemon=True).start()
    with urlopen(f"http://127.0.0.1:{running.server_port}/health") as r:
        assert r.read() == b"ok"
    running.shutdown()


def test_tools(engine):
    tools = ToolServer(engine)

    def call(name, **arguments):
        out = tools.handle({"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": name, "arguments": arguments}})
        return json.loads(out["result"]["content"][0]["text"]) if "result" in out else out["error"]

    found = call("search", query="payment error", limit=2, context=2)
    assert found["results"][0]["path"].endswith("readme.md") and "payment" in found["results"][0]["snippet"] and found["query_mode"] == "hybrid"
    skills = call("search_skills", query="bread flour", detail="full")["skills"]
    assert [(s["name"], s["scope"], s["files"]) for s in skills] == [("bake", "project", [])] and skills[0]["body"].startswith("# Bake")
    assert call("search_skills", query="bread", scope="personal")["skills"] == []
    assert call("status")["total_files"] == 13 and any(d.endswith("/src") for d in call("status")["source_directories"])
    assert call("nothing")["code"] == -32602 and call("search")["code"] == -32602
    out = io.StringIO()
    tools.run(io.StringIO('{"id":1,"method":"initialize"}\n\n{"method":"notifications/initialized"}\n{"id":2,"method":"tools/list"}\n{bad\n{"id":3,"method":"x"}\n'), out)
    lines = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [x.get("id") for x in lines] == [1, 2, None, 3] and len(lines[1]["result"]["tools"]) == 3 and lines[2]["error"]["code"] == -32700 and lines[3]["error"]["code"] == -32601


def test_command_line(spark, corpus, tmp_path, monkeypatch, capsys):
    monkeypatch.setenv("LOAMDEX_HOME", str(tmp_path / "home"))
    monkeypatch.setattr(cli, "spark_session", lambda: spark)

    def run(*argv):
        code = cli.main(argv)
        return code, capsys.readouterr().out.strip()

    assert run("search", "payment") == (0, "No results found.")
    assert run("--json", "scan", str(corpus), "--dry-run")[1].startswith("{") and "indexed: 13" in run("scan", str(corpus))[1]
    assert json.loads(run("--json", "search", "payment", "error", "-n", "1")[1])[0]["uri"].endswith("readme.md")
    assert "readme.md" in run("search", "payment", "-c")[1] and run("--format", "csv", "search", "payment")[1].startswith("uri,score")
    assert run("search", "payment", "-t", "rs")[1] == "No results found." and run("search", "payment", "--after", "2020-01-01")[1] != "No results found."
    assert run("search", "x", "--after", "never")[0] == 2 and run("search", "x", "--vector-only", "--keyword-only")[0] == 2
    assert json.loads(run("--json", "status")[1])["total_sources"] == 13 and len(run("list")[1].splitlines()) == 13
    code, _ = run("export", "-o", str(tmp_path / "out.jsonl"), "-t", "md")
    rows = [json.loads(x) for x in open(tmp_path / "out.jsonl")]
    assert code == 0 and rows and {r["file_type"] for r in rows} == {"md"} and "vector" not in rows[0] and len(rows[0]["byte_range"]) == 2
    assert run("remove", str(corpus / "readme.md"))[1] == "removed" and "not found" in run("remove", str(corpus / "readme.md"))[1]
    assert run("config", "default.chunk_size", "256")[1] == "default.chunk_size = 256" and run("config", "default.chunk_size")[1] == "default.chunk_size = 256"
    assert "not found" in run("config", "a.b")[1] and run("config", "a.b", "1")[0] == 3 and run("config", "server.port", "x")[0] == 3 and "[search]" in run("config")[1]
    assert "bge-m3" in run("models", "list")[1] and run("models", "download", "bge-m3")[0] == 4 and run("scan", str(corpus), "--model", "nope")[0] == 4


def test_exit_codes():
    assert [exit_code(e) for e in (None, UsageError(), ConfigError(), ModelError(), StorageError(), ParseError("p", "m"), OSError(), KeyError())] == [0, 2, 3, 4, 5, 1, 5, 1]


def test_config(tmp_path):
    c = Config()
    c.set("search.hybrid_alpha", "0.4")
    c.set("server.host", 'a"b')
    c.save(tmp_path / "c.toml")
    read = Config.load(tmp_path / "c.toml")
    assert read == c and read.get("search.rerank") == "true" and read.get("ignore.patterns") is None and read.get("default") is None
    (tmp_path / "c.toml").write_text("[broken")
    with pytest.raises(ConfigError):
        Config.load(tmp_path / "c.toml")
    with pytest.raises(ConfigError):
        c.set("search.rerank", "true")


def test_output(tmp_path):
    path = tmp_path / "f.txt"
    path.write_text("one\ntwo\nthree\nfour\nfive\nsix\n")
    uri = f"file://{path}"
    assert context(uri, (8, 13)) == ["   1 one", "   2 two", "   3>three", "   4 four", "   5 five"] and context(uri, None) is None and context("http://x", (0, 1)) is None and context(uri, (999, 1000)) is None
    assert line_range(uri, (8, 13)) == "2-3" and line_range("file:///gone", (0, 1)) == ""
    assert [size_text(n) for n in (1023, 1024, 1536, 1 << 20, 1 << 40)] == ["1023B", "1.0KB", "1.5KB", "1.0MB", "1024.0GB"]
    assert round2(0.125) == 0.13 and round2(-0.125) == -0.13 and shortened("é" * 150) == "é" * 150 + "..." and shortened("x" * 201) == "x" * 200 + "..."
    rows = [{"uri": uri, "text": 'a "b"\nc', "score": 0.5, "chunk_index": 0, "file_type": "txt", "content_type": "text", "title": None, "byte_range": {"start_off": 4, "end_off": 7}}]
    assert format_results(rows, "csv").splitlines()[1] == f'{uri},0.5000,0,txt,"a ""b"" c"' and json.loads(format_results(rows, "json"))[0]["byte_range"] == [4, 7]
    assert format_results(rows) == f'  1. {path}  0.50\n     a "b" c' and "   2>two" in format_results(rows, with_context=True) and format_results([]) == "No results found."


def test_embedding(spark):
    e = HashingEmbedder(16)
    a, b = e.embed_batch(["same words here", "here same WORDS"])
    assert np.allclose(a, b) and np.isclose(np.linalg.norm(a), 1) and not e.embed_batch([""]).any()
    pooled = mean_pooled(np.array([[[1.0, 0], [0, 1], [9, 9]]]), np.array([[1, 1, 0]]))
    assert np.allclose(pooled, [[2**-0.5, 2**-0.5]])

    class Failing(HashingEmbedder):
        def embed_batch(self, texts):
            raise RuntimeError

    rows = spark.createDataFrame([(1, "a b"), (2, None)], "id int, text string")
    assert [r["vector"] for r in embedded(rows, Failing(2)).orderBy("id").collect()] == [[0.0, 0.0]] * 2
    image = VisionEmbedder("none", "v", 4).prepare(np.full((100, 50, 3), 255, np.uint8))
    assert image.shape == (3, 224, 224) and np.allclose(image[0], (1 - 0.48145466) / 0.26862954, atol=1e-4)
    assert embedders.BATCH == 32


def test_cache(spark):
    chunks = spark.createDataFrame([("u", 0, "one"), ("u", 1, "two"), ("v", 0, "one"), ("w", 0, None)], "uri string, chunk_index int, text string")
    made, cache = with_vectors(chunks, HashingEmbedder(4))
    assert cache.count() == 2 and {len(r["vector"]) for r in made.collect()} == {4}
    again, grown = with_vectors(chunks, HashingEmbedder(4), cache)
    assert grown.count() == cache.count()
    assert {tuple(r["vector"] or ()) for r in again.collect()} == {tuple(r["vector"] or ()) for r in made.collect()}
    known = spark.createDataFrame([(b"h", "m", [1.0], 5), (b"h", "m", [2.0], 9), (b"h", "m", None, 10), (b"g", "n", [3.0], 1)], "hash binary, model string, vector array<float>, created_at bigint")
    asked = spark.createDataFrame([(1, b"h"), (2, b"g"), (3, None)], "id int, text_hash binary")
    assert [(r["id"], r["vector"], r["cached"]) for r in looked_up(asked, known).orderBy("id").collect()] == [(1, [2.0], True), (2, [3.0], True), (3, None, False)]
    assert looked_up(asked, known, "n").where("cached").count() == 1
    assert put(known.drop("created_at"), spark.createDataFrame([(b"g", "n", [4.0])], "hash binary, model string, vector array<float>")).where(F.col("hash") == b"g").collect()[0]["vector"] == [4.0]
    assert {tuple(r) for r in cache_stats(known).collect()} == {("m", 3, 1, 8), ("n", 1, 1, 4)}
    assert spark.range(1).select(text_hash(F.lit("a")).alias("h")).collect()[0]["h"].hex().startswith("ca978112")
    none, _ = with_vectors(chunks, None)
    assert {len(r["vector"]) for r in none.collect()} == {768}


def test_image_vectors(spark):
    chunks = spark.createDataFrame([("i", 0, "image", [1.0]), ("i", 1, "image", None), ("j", 0, "image", [2.0]), ("t", 0, "text", [3.0]), ("t", 1, "text", None)], "uri string, chunk_index int, content_type string, vector array<float>")
    images = spark.createDataFrame([("i", [9.0]), ("t", [8.0])], "uri string, image_vector array<float>")
    got = {(r["uri"], r["chunk_index"]): r["vector"] for r in with_image_vectors(chunks, images).collect()}
    assert got["i", 0] == got["i", 1] == [9.0] and got["j", 0] == [2.0] and got["t", 0] == [3.0] and len(got["t", 1]) == 768


def test_models(tmp_path):
    assert models.get_model("bge-m3").pooling == "cls" and models.model_file("int8") == "model_int8.onnx" and models.batch_size(768, 1) == 23 and models.batch_size(768, 10**6) == 256 and models.batch_size(10**6, 1) == 8
    manager = models.ModelManager(tmp_path)
    with pytest.raises(ModelError):
        manager.ensure("bge-m3")
    (tmp_path / "bge-m3").mkdir()
    (tmp_path / "bge-m3" / "model.onnx").write_bytes(b"x")
    assert manager.ensure("bge-m3").name == "model.onnx" and manager.available() == ["bge-m3"]
    with pytest.raises(ModelError):
        models.get_model("none")


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0]), ([0.0, 0.0], None), (None, [])], "a array<float>, b array<float>")
    rows = df.select(cosine("a", literal([3.0, 4.0])).alias("c"), cosine("a", "b").alias("d"), normalised("a").alias("n"), truncated("a", 1).alias("t"), F.size(zeros(5)).alias("z")).collect()
    assert [r["c"] for r in rows] == [pytest.approx(1), 0.0, 0.0] and [r["d"] for r in rows] == [0.0] * 3 and rows[0]["n"] == pytest.approx([0.6, 0.8]) and rows[0]["t"] == [1.0] and rows[1]["n"] == [0.0, 0.0] and rows[0]["z"] == 5
    stored = [[1.5, -2.25, 0.0], [float("inf"), 1e-42, 3.4e38], []]
    packed = spark.createDataFrame([(np.array(v, "<f4").tobytes(),) for v in stored] + [(None,), (b"\0\0\x80\x3fxx",)], "raw binary")
    got = [r["v"] for r in unpacked(packed, "raw", "v").collect()]
    assert got[:3] == [pytest.approx([float(np.float32(x)) for x in v]) for v in stored] and got[3] is None and got[4] == [1.0]


SOURCE = "source_id bigint, uri string, content_hash binary, file_type string, modified_at bigint, indexed_at bigint, chunk_count int, status string"


def test_metadata(spark):
    history = spark.createDataFrame([(1, "file:///a/x", b"1", "md", 1000, 1, 2, None), (2, "file:///a/x", b"2", "md", 5000, 2, 3, "indexed"), (3, "file:///b", b"3", None, None, 1, None, None), (4, "http://c", b"4", "py", 9000, 1, 4, "deleted"), (5, None, b"5", "py", 9000, 1, 4, None)], SOURCE)
    now = metadata.current_sources(history)
    assert sorted(r["source_id"] for r in now.collect()) == [2, 3, 4] and metadata.living(now).count() == 2
    t = metadata.totals(now).collect()[0]
    assert (t["total_sources"], t["total_chunks"], t["file_type_counts"]) == (3, 7, {"md": 1, "py": 1, "unknown": 1})
    assert metadata.totals(now.limit(0)).collect()[0]["total_chunks"] == 0
    assert {tuple(r) for r in metadata.index_stats(now).collect()} == {("md", 1, 3, False), ("py", 1, 4, False), ("unknown", 1, 0, False), (None, 3, 7, True)}
    assert [r[0] for r in metadata.modified_since(now, 5000).orderBy("uri").collect()] == ["file:///a/x", "http://c"]
    items = spark.createDataFrame([("file:///a/x", b"2"), ("file:///b", b"9"), ("file:///new", b"1")], "uri string, content_hash binary")
    assert {r["uri"]: r["state"] for r in metadata.classified(items, now).collect()} == {"file:///a/x": "same", "file:///b": "changed", "file:///new": "new"}
    grown = metadata.upserted(now, spark.createDataFrame([(9, "file:///b", b"8", "md", 1, 7, 1, None), (8, "file:///b", b"7", "md", 1, 6, 1, None)], SOURCE))
    assert {r["uri"]: bytes(r["content_hash"]) for r in grown.collect()} == {"file:///a/x": b"2", "file:///b": b"8", "http://c": b"4"}
    one = spark.createDataFrame([("file:///a",)], "uri string")
    assert metadata.removed(now, one).count() == 3 and metadata.removed(now, one, prefix=True).count() == 2
    assert [r["uri"] for r in metadata.stale(now, items.limit(1)).collect()] == ["file:///b"]
    assert {r["uri"] for r in metadata.stale_on_disk(now).collect()} == {"file:///a/x", "file:///b"}
    assert [r[0] for r in metadata.parent_directories(now).collect()] == ["", "/a", "http:/"]
    meta = metadata.with_setting(metadata.with_setting(spark.createDataFrame([], "key string, value string"), "k", "1"), "k", "2")
    assert metadata.setting(meta, "k") == "2" and metadata.setting(meta, "x") is None and meta.count() == 1


def test_export(spark, tmp_path):
    chunks = spark.createDataFrame([("u", 'te"xt', 0, "text", "md", None, (1, 2), [0.5]), ("v", "x", 1, "code", "rs", "T", None, None)], "uri string, text string, chunk_index int, content_type string, file_type string, title string, byte_range struct<start_off: bigint, end_off: bigint>, vector array<float>")
    rows = [json.loads(x) for x in iterate_lines(chunks, vectors=True)]
    assert rows[0] == {"uri": "u", "text": 'te"xt', "chunk_index": 0, "content_type": "text", "file_type": "md", "byte_range": [1, 2], "vector": [0.5]} and "title" in rows[1]
    write_jsonl(chunks, str(tmp_path / "out"), "rs")
    assert [json.loads(r[0])["uri"] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["v"] and export_lines(chunks.limit(0)).count() == 0


def test_debounce(spark, tmp_path):
    now = [0.0]
    d = Debouncer(1000, lambda: now[0])
    (tmp_path / "a").write_text("")
    d.add(str(tmp_path / "a"))
    now[0] = 0.9
    d.add(str(tmp_path / "gone"))
    now[0] = 1.8
    assert d.take() is None
    now[0] = 1.95
    assert d.take() == [str(tmp_path / "a")] and d.take() is None
    events = spark.sql("SELECT timestamp_seconds(t) AS ts, p AS path FROM VALUES (0, 'a'), (5, 'b'), (5, 'a'), (15, 'c'), (86399, 'x'), (86402, 'y'), (200000, 'z'), (NULL, 'n') AS v(t, p)")
    got = [(r["events"], r["members"]) for r in debounced(events, 10).orderBy("started").collect()]
    assert got == [(3, ["a", "b"]), (1, ["c"]), (2, ["x", "y"]), (1, ["z"])]
    assert [(r["events"], r["members"]) for r in debounced_counts(events, 10, "ts", "path").orderBy("started").collect()] == [(n, len(m)) for n, m in got]


def test_watching(spark, tmp_path):
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.txt").write_text("1")
    watcher = FolderWatcher([str(tmp_path / "w")])
    assert watcher.look() == []
    (tmp_path / "w" / "a.txt").write_text("22")
    (tmp_path / "w" / "b.txt").write_text("1")
    assert [os.path.basename(p) for p in watcher.look()] == ["a.txt", "b.txt"]
    seen, stop = [], threading.Event()
    query = watch(spark, [str(tmp_path / "w")], lambda folders: (seen.append(folders), stop.set()), 200, str(tmp_path / "check"), stop)
    deadline = time.time() + 60
    time.sleep(3)
    (tmp_path / "w" / "b.txt").write_text("333")
    while not seen and time.time() < deadline:
        time.sleep(0.2)
    query.stop()
    assert seen and seen[0] == [str(tmp_path / "w")]
