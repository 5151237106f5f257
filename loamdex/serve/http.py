"""The index over HTTP: /health, /api/search and /api/status."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from loamdex.errors import LoamdexError
from loamdex.serve.engine import MODES, Engine


def answer(engine: Engine, target: str) -> tuple[int, str, str]:
    """(status, content type, body) of a GET request."""
    url = urlsplit(target)
    given = {k: v[-1] for k, v in parse_qs(url.query, keep_blank_values=True).items()}
    try:
        if url.path == "/health":
            return 200, "text/plain", "ok"
        if url.path == "/api/status":
            return 200, "application/json", json.dumps({"status": "ok", "stats": engine.status(), "has_embedder": engine.embedder is not None})
        if url.path != "/api/search":
            return 404, "text/plain", "not found"
        if "q" not in given:
            return 400, "text/plain", "q is missing"
        mode = given.get("mode") if given.get("mode") in MODES else "hybrid"
        if mode == "vector" and engine.embedder is None:
            return 400, "text/plain", "Vector search requested but no embedding model is loaded"
        limit = int(given.get("limit", engine.config.search.max_results))
        rows = engine.search(given["q"], limit, mode, threshold=float("-inf"), file_type=given.get("type"))
        kept = [{k: r.get(k) for k in ("uri", "text", "score", "chunk_index", "content_type", "file_type", "title")} for r in rows]
        return 200, "application/json", json.dumps({"results": kept, "total": len(kept), "mode": engine.mode(mode)})
    except ValueError as e:
        return 400, "text/plain", str(e)
    except LoamdexError as e:
        return 500, "text/plain", str(e)


def server(engine: Engine, host: str = "127.0.0.1", port: int = 7820) -> ThreadingHTTPServer:
    """A server that isn't running yet; call serve_forever()."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            status, kind, body = answer(engine, self.path)
            raw = body.encode()
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(raw)))
            self.send_header("Access-Control-Allow-Origin", "*")
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, *_: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
