"""The command line: ``python -m loamdex COMMAND``."""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Sequence
from dataclasses import asdict

from pyspark.sql import SparkSession

from loamdex.config import Config, home
from loamdex.embed.embedders import Embedder, HashingEmbedder, OnnxEmbedder
from loamdex.embed.models import MODELS, ModelManager, get_model
from loamdex.errors import ConfigError, LoamdexError, ModelError, UsageError, exit_code
from loamdex.operators.export import iterate_lines
from loamdex.operators.filters import parse_after
from loamdex.operators.metadata import list_sources
from loamdex.plans.ingest import prune, remove, scan
from loamdex.serve.engine import Engine
from loamdex.serve.output import format_results, size_text
from loamdex.sources.filesystem import ScanOptions
from loamdex.store import Index


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loamdex", description="Index documents and search them.")
    p.add_argument("--index", default=os.environ.get("LOAMDEX_INDEX"), help="name of the index")
    p.add_argument("--format", choices=("human", "json", "csv"), default=os.environ.get("LOAMDEX_FORMAT", "human"))
    p.add_argument("--json", action="store_const", const="json", dest="format", help="the same as --format json")
    p.add_argument("-q", "--quiet", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)

    s = sub.add_parser("scan", help="index files")
    s.add_argument("paths", nargs="+")
    s.add_argument("--max-depth", type=int)
    s.add_argument("--max-file-size", type=int)
    s.add_argument("--include", action="append", default=[])
    s.add_argument("--exclude", action="append", default=[])
    s.add_argument("-t", "--type", action="append", default=[], dest="types")
    s.add_argument("--model", default=os.environ.get("LOAMDEX_MODEL"))
    s.add_argument("--dry-run", action="store_true")

    s = sub.add_parser("search", help="search the index")
    s.add_argument("query", nargs="+")
    s.add_argument("-n", "--max-results", type=int)
    s.add_argument("-t", "--type")
    s.add_argument("--path")
    s.add_argument("--threshold", type=float, default=0.0)
    s.add_argument("--vector-only", action="store_true")
    s.add_argument("--keyword-only", action="store_true")
    s.add_argument("-c", "--context", action="store_true")
    s.add_argument("--after", help="7d, 2w, 3m or YYYY-MM-DD")
    s.add_argument("--engine", choices=("fts", "bm25", "syntax"), default="fts")
    s.add_argument("--model", default=os.environ.get("LOAMDEX_MODEL"))

    s = sub.add_parser("watch", help="index files as they change")
    s.add_argument("paths", nargs="+")
    s.add_argument("--debounce", type=int, default=1000)
    sub.add_parser("status", help="what is indexed")
    sub.add_parser("list", help="indexed files")
    s = sub.add_parser("remove", help="take a file out of the index")
    s.add_argument("uri")
    s.add_argument("--prefix", action="store_true", help="and everything below it")
    sub.add_parser("prune", help="take files that are gone out of the index")
    s = sub.add_parser("config", help="view or change settings")
    s.add_argument("key", nargs="?")
    s.add_argument("value", nargs="?")
    s = sub.add_parser("models", help="embedding models")
    s.add_argument("action", choices=("list", "download"))
    s.add_argument("name", nargs="?")
    s = sub.add_parser("serve", help="the index over HTTP")
    s.add_argument("--host")
    s.add_argument("--port", type=int)
    sub.add_parser("tools", help="the index as tools over standard input")
    s = sub.add_parser("export", help="the chunks as JSON lines")
    s.add_argument("--vectors", action="store_true")
    s.add_argument("-o", "--output")
    s.add_argument("-t", "--type")
    return p


def spark_session() -> SparkSession:
    builder = SparkSession.builder.appName("loamdex").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if not os.environ.get("MASTER") and not os.environ.get("SPARK_MASTER"):
        builder = builder.master("local[*]").config("spark.sql.shuffle.partitions", "8")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def embedder_of(config: Config, name: str | None) -> Embedder | None:
    """The model that was asked for, or the settings' own if its files are there; ``hashing`` needs none."""
    if name == "hashing":
        return HashingEmbedder()
    spec, manager = get_model(name or config.default.model), ModelManager(config.models_dir())
    if name is None and spec.name not in manager.available():
        return None
    return OnnxEmbedder(manager.ensure(spec.name), spec.name, spec.dimensions, spec.pooling)


def _scan(index: Index, config: Config, a: argparse.Namespace) -> str:
    options = ScanOptions(a.paths, a.max_depth, a.max_file_size or config.default.max_file_size, a.include, [*config.ignore.patterns, *a.exclude], a.types, a.dry_run)
    stats = scan(index.spark, index, options, embedder_of(config, a.model), config.default.chunk_size, config.default.chunk_overlap)
    if a.format == "json":
        return json.dumps(asdict(stats), indent=2)
    names = ("discovered", "skipped", "indexed", "chunks", "errors", "cache_hits")
    if a.format == "csv":
        return ",".join(names) + "\n" + ",".join(str(getattr(stats, n)) for n in names)
    types = [f"  {t}: {n}" for t, n in sorted(stats.file_types.items())]
    failures = [f"  {u}: {e}" for u, e in stats.failures]
    return "\n".join([*(f"{n}: {getattr(stats, n)}" for n in names), *types, *failures])


def _search(index: Index, config: Config, a: argparse.Namespace) -> str:
    if a.vector_only and a.keyword_only:
        raise UsageError("--vector-only and --keyword-only exclude each other")
    mode = "vector" if a.vector_only else "keyword" if a.keyword_only else "hybrid"
    try:
        since = parse_after(a.after) if a.after else None
    except ValueError as e:
        raise UsageError(str(e)) from e
    engine = Engine(index, config, embedder_of(config, a.model), a.engine)
    rows = engine.search(" ".join(a.query), a.max_results or config.search.max_results, mode, a.threshold, a.type, a.path, since)
    return format_results(rows, a.format, a.context)


def _config(config: Config, a: argparse.Namespace) -> str:
    if a.key is None:
        return config.toml()
    if a.value is None:
        value = config.get(a.key)
        return f"{a.key}: key not found" if value is None else f"{a.key} = {value}"
    config.set(a.key, a.value)
    config.save()
    return f"{a.key} = {a.value}"


def _models(config: Config, a: argparse.Namespace) -> str:
    manager = ModelManager(config.models_dir())
    if a.action == "list":
        there = manager.available()
        return "\n".join(f"{m.name}  {m.dimensions}  {'installed' if m.name in there else 'not installed'}" for m in MODELS.values())
    spec = get_model(a.name or config.default.model)
    raise ModelError(f"there is no network: put the files of {spec.repo} into {manager.path(spec.name).parent}")


def _status(index: Index, a: argparse.Namespace) -> str:
    s = Engine(index).status()
    if a.format == "json":
        return json.dumps(s, indent=2)
    types = [f"  {t}: {n}" for t, n in sorted(s["file_type_counts"].items())]
    return "\n".join([f"sources: {s['total_sources']}", f"chunks: {s['total_chunks']}", f"size: {size_text(s['index_size_bytes'])}", *types])


def _list(index: Index, a: argparse.Namespace) -> str:
    rows = [(r["uri"], r["file_type"], r["chunk_count"]) for r in list_sources(index.table("sources")).toLocalIterator()]
    if a.format == "json":
        return json.dumps([dict(zip(("uri", "file_type", "chunk_count"), r, strict=True)) for r in rows], indent=2)
    if a.format == "csv":
        return "\n".join(["uri,file_type,chunk_count", *(",".join(map(str, r)) for r in rows)])
    return "\n".join(f"{u}  {t}  {n} chunks" for u, t, n in rows) or "No sources indexed."


def _watch(index: Index, config: Config, a: argparse.Namespace) -> str:
    from loamdex.streaming.watch import watch

    def again(folders: list[str]) -> None:
        stats = scan(index.spark, index, ScanOptions(folders), embedder_of(config, None), config.default.chunk_size, config.default.chunk_overlap)
        if not a.quiet:
            print(f"indexed {stats.indexed}, skipped {stats.skipped}", flush=True)

    query = watch(index.spark, a.paths, again, a.debounce)
    try:
        query.awaitTermination()
    except KeyboardInterrupt:
        query.stop()
    return ""


def _export(index: Index, a: argparse.Namespace) -> str:
    lines = iterate_lines(index.table("chunks"), a.type, a.vectors)
    if not a.output:
        for line in lines:
            print(line)
        return ""
    part = f"{a.output}.part"
    with open(part, "w", encoding="utf-8") as f:
        n = sum(1 for line in lines if f.write(line + "\n"))
    os.replace(part, a.output)
    return f"{n} chunks exported"


def run(argv: Sequence[str] | None = None) -> str:
    """What a command prints."""
    a = _parser().parse_args(argv)
    config = Config.load()
    if a.index:
        config.index_name = a.index
    if a.command == "config":
        if a.key is None and a.value is not None:
            raise ConfigError("Must specify a key when setting a value")
        return _config(config, a)
    if a.command == "models":
        return _models(config, a)
    index = Index(spark_session(), config.index_dir())
    if a.command == "scan":
        return _scan(index, config, a)
    if a.command == "search":
        return _search(index, config, a)
    if a.command == "watch":
        return _watch(index, config, a)
    if a.command == "status":
        return _status(index, a)
    if a.command == "list":
        return _list(index, a)
    if a.command == "remove":
        return "removed" if remove(index, a.uri if "://" in a.uri else os.path.realpath(a.uri), a.prefix) else f"{a.uri}: not found"
    if a.command == "prune":
        return f"{prune(index)} removed"
    if a.command == "export":
        return _export(index, a)
    engine = Engine(index, config, embedder_of(config, None))
    if a.command == "serve":
        from loamdex.serve.http import server

        server(engine, a.host or config.server.host, a.port or config.server.port).serve_forever()
    else:
        from loamdex.serve.tools import ToolServer

        ToolServer(engine, (str(home() / "skills"),)).run(sys.stdin, sys.stdout)
    return ""


def main(argv: Sequence[str] | None = None) -> int:
    try:
        text = run(argv)
    except (LoamdexError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return exit_code(e)
    if text:
        print(text)
    return 0
