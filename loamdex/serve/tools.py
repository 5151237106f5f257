"""The index as tools of an assistant: JSON-RPC, one message a line, over standard input and output."""

from __future__ import annotations

import json
import os
from typing import IO

from loamdex import __doc__ as ABOUT
from loamdex.errors import LoamdexError
from loamdex.operators.filters import skill_page, tool_page
from loamdex.operators.metadata import parent_directories
from loamdex.parsers.rich import skill
from loamdex.serve.engine import MODES, Engine
from loamdex.serve.output import bare_path, context, line_range, round2, shortened, size_text

PROTOCOL = "2024-11-05"


def _schema(required: list[str], **fields: str) -> dict:
    return {"type": "object", "properties": {k: {"type": v} for k, v in fields.items()}, "required": required}


TOOLS = {
    "search": ("Search the indexed files by meaning and by words.", _schema(["query"], query="string", limit="integer", offset="integer", file_type="string", path="string", mode="string", context="integer")),
    "search_skills": ("Search skill files by name, description or ability.", _schema(["query"], query="string", limit="integer", scope="string", detail="string")),
    "status": ("What is indexed: files, chunks, size, types and folders.", _schema([])),
}


def _span(row: dict) -> tuple[int, int] | None:
    return (row["byte_range"]["start_off"], row["byte_range"]["end_off"]) if row.get("byte_range") else None


class ToolServer:
    """Answers to the messages of one client."""

    def __init__(self, engine: Engine, skill_folders: tuple[str, ...] = ()):
        self.engine, self.personal = engine, tuple(os.path.expanduser(f) for f in skill_folders)

    def search(self, query: str, limit: int | None = None, offset: int | None = None, file_type: str | None = None, path: str | None = None, mode: str | None = None, context: int | None = None) -> dict:
        limit, offset = min(50, max(1, 10 if limit is None else limit)), max(0, offset or 0)
        around = min(10, max(0, 2 if context is None else context))
        wanted = mode if mode in MODES else "hybrid"
        rows = [r.asDict(recursive=True) for r in tool_page(self.engine.hits(query, limit + offset + 10, wanted), limit, offset, file_type, path).orderBy("place").collect()]
        total = rows[0]["total"] if rows else 0
        return {"results": [self._result(r, around) for r in rows], "total": total, "has_more": total > offset + limit, "query_mode": self.engine.mode(wanted)}

    def _result(self, row: dict, around: int) -> dict:
        lines = context(row["uri"], _span(row), around, mark=False) if around else None
        return {"path": bare_path(row["uri"]), "lines": line_range(row["uri"], _span(row)), "score": round2(row["score"]), "type": row["file_type"], "snippet": "\n".join(lines) if lines else shortened(row["text"] or "")}

    def search_skills(self, query: str, limit: int | None = None, scope: str | None = None, detail: str | None = None) -> dict:
        """``scope`` is all, personal (one of the given folders) or project; ``detail`` is metadata, instructions or full."""
        limit = min(20, max(1, 5 if limit is None else limit))
        found = skill_page(self.engine.hits(query, 5 * limit, "hybrid"), limit)
        out = []
        for r in found.collect():
            path = bare_path(r["uri"])
            own = path.startswith(self.personal) if self.personal else False
            place = "personal" if own else "project" if "/skills/" in path else "indexed"
            if scope in ("personal", "project") and place != scope:
                continue
            try:
                with open(path, encoding="utf-8") as f:
                    read = skill(f.read())
            except (OSError, UnicodeDecodeError):
                continue
            if read is None:
                continue
            head, body = read
            entry = {"name": head.name or "unknown", "description": head.description or "", "path": path, "scope": place, "score": round2(r["score"])}
            if detail in ("instructions", "full"):
                entry |= {"frontmatter": head.raw, "body": body}
            if detail == "full":
                folder = os.path.dirname(path)
                near = [os.path.relpath(os.path.join(d, f), folder) for d, _, fs in os.walk(folder) for f in fs if f != "SKILL.md" and os.path.relpath(d, folder).count("/") < 1]
                entry["files"] = sorted(near)
            out.append(entry)
        return {"skills": out, "total": len(out)}

    def status(self) -> dict:
        s = self.engine.status()
        folders = [r["directory"] for r in parent_directories(self.engine.index.table("sources")).toLocalIterator()]
        return {"total_files": s["total_sources"], "total_chunks": s["total_chunks"], "index_size_bytes": s["index_size_bytes"], "index_size": size_text(s["index_size_bytes"]), "file_types": s["file_type_counts"], "source_directories": folders}

    def handle(self, message: dict) -> dict | None:
        """The answer to a message, None to a notification."""
        ident, method, params = message.get("id"), message.get("method"), message.get("params") or {}
        if ident is None:
            return None

        def reply(**body: object) -> dict:
            return {"jsonrpc": "2.0", "id": ident, **body}

        if method == "initialize":
            return reply(result={"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "loamdex", "version": "1"}, "instructions": ABOUT})
        if method == "ping":
            return reply(result={})
        if method == "tools/list":
            return reply(result={"tools": [{"name": n, "description": d, "inputSchema": s, "annotations": {"readOnlyHint": True}} for n, (d, s) in TOOLS.items()]})
        if method != "tools/call":
            return reply(error={"code": -32601, "message": f"no method {method}"})
        name, given = params.get("name"), params.get("arguments") or {}
        if name not in TOOLS:
            return reply(error={"code": -32602, "message": f"no tool {name}"})
        missing = [k for k in TOOLS[name][1]["required"] if k not in given]
        unknown = [k for k in given if k not in TOOLS[name][1]["properties"]]
        if missing or unknown:
            return reply(error={"code": -32602, "message": f"missing {missing}, unknown {unknown}"})
        try:
            found = getattr(self, name)(**given)
        except LoamdexError as e:
            return reply(error={"code": -32603, "message": str(e)})
        return reply(result={"content": [{"type": "text", "text": json.dumps(found, indent=2, ensure_ascii=False)}], "isError": False})

    def run(self, lines: IO[str], out: IO[str]) -> None:
        for line in lines:
            if not line.strip():
                continue
            try:
                answer = self.handle(json.loads(line))
            except ValueError as e:
                answer = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(e)}}
            if answer is not None:
                print(json.dumps(answer, ensure_ascii=False), file=out, flush=True)
