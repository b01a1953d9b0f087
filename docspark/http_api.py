"""The store over HTTP: ``GET /health``, ``/ready``, ``/status`` and ``POST /api/query``, with the standard library alone."""

from __future__ import annotations

import json
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from docspark.kb import Store

MOST_CHARS = 2000


def respond(store: Store, method: str, path: str, body: bytes, key: str | None, sent_key: str | None) -> tuple[int, dict[str, Any]]:
    """Status and answer of a request. With a ``key`` queries must send it."""
    if method == "GET" and path == "/health":
        return 200, {"status": "ok"}
    if method == "GET" and path == "/ready":
        ready = store.versions.current() is not None
        return (200 if ready else 503), {"ready": ready}
    if method == "GET" and path == "/status":
        return 200, store.status()
    if method != "POST" or path != "/api/query":
        return 404, {"error": "no such path"}
    if key and sent_key != key:
        return 401, {"error": "bad key"}
    try:
        asked = json.loads(body or b"{}")
        query = str(asked.get("query") or "").strip()
    except (ValueError, AttributeError):
        return 400, {"error": "the body must be a JSON object"}
    if not query:
        return 400, {"error": "the query is empty"}
    if len(query) > MOST_CHARS:
        return 413, {"error": f"the query is longer than {MOST_CHARS} characters"}
    try:
        return 200, store.open().answer(query, str(asked.get("length") or "normal")).first().asDict(recursive=True)
    except Exception as e:  # whatever the engine says, the caller gets a clean error
        return 502, {"error": type(e).__name__}


def server(store: Store, port: int = 8080, key: str | None = None, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server that isn't running yet; ``serve_forever`` starts it."""

    def answer(method: str) -> Callable[[BaseHTTPRequestHandler], None]:
        def handle(self: BaseHTTPRequestHandler) -> None:
            n = int(self.headers.get("Content-Length") or 0)
            body = self.rfile.read(min(n, 1 << 20))
            status, out = respond(store, method, self.path.split("?")[0], body, key, self.headers.get("X-API-Key"))
            raw = json.dumps(out, ensure_ascii=False, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        return handle

    kind = type("Handler", (BaseHTTPRequestHandler,), {"do_GET": answer("GET"), "do_POST": answer("POST"), "log_message": lambda *a: None})
    return ThreadingHTTPServer((host, port), kind)
