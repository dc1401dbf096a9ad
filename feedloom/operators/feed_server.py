"""The exported feed over HTTP: one file, its health check, and the headers that readers of other origins need."""

from __future__ import annotations

import hashlib
import logging
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

FEED, HEALTH = "/api/v1/events.json", "/healthz"
#: How long caches may keep the feed.
CACHE = "public, max-age=60, stale-while-revalidate=600"
log = logging.getLogger(__name__)


def tag_of(body: bytes) -> str:
    """The tag that :func:`feedloom.functions.urls.etag` gives the same body."""
    return f'"{hashlib.sha256(body).hexdigest()[:32]}"'


def matches(header: str, tag: str) -> bool:
    """Whether an If-None-Match header names the tag: a list, a star, or weak forms."""
    return any(x in ("*", tag) for x in (h.strip().removeprefix("W/") for h in header.split(",")))


class _Handler(BaseHTTPRequestHandler):
    path_of_feed: Path
    timeout = 10

    def _send(self, code: int, body: bytes = b"", **headers: str) -> None:
        self.send_response(code)
        self.send_header("Access-Control-Allow-Origin", "*")
        for name, value in headers.items():
            self.send_header(name.replace("_", "-"), value)
        if code not in (204, 304):
            self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        if self.command != "HEAD" and code not in (204, 304):
            self.wfile.write(body)

    def _read(self) -> None:
        path = self.path.partition("?")[0]
        if path == HEALTH:  # never reads the feed
            return self._send(200, b'{"status":"ok"}\n', Content_Type="application/json")
        if path != FEED:
            return self._send(404, b'{"error":"not found"}\n', Content_Type="application/json")
        try:
            body = self.path_of_feed.read_bytes()
        except OSError:
            log.exception("feed not readable")
            return self._send(500, b'{"error":"internal error"}\n', Content_Type="application/json", Cache_Control="no-store")
        tag = tag_of(body)
        if matches(self.headers.get("If-None-Match", ""), tag):
            return self._send(304, ETag=tag, Cache_Control=CACHE)
        return self._send(200, body, Content_Type="application/json; charset=utf-8", ETag=tag, Cache_Control=CACHE)

    def do_GET(self) -> None:
        began = time.monotonic()
        self._read()
        log.info("%s %s %.1f ms", self.command, self.path, 1000 * (time.monotonic() - began))

    do_HEAD = do_GET

    def do_OPTIONS(self) -> None:
        self._send(204, Access_Control_Allow_Methods="GET, HEAD, OPTIONS", Access_Control_Max_Age="86400")

    def log_message(self, format: str, *args) -> None:
        """Requests have their own line."""


def server(feed: str | Path, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A server of the feed file, not yet started: call ``serve_forever``, and ``shutdown`` from another thread."""
    return ThreadingHTTPServer((host, port), type("Handler", (_Handler,), {"path_of_feed": Path(feed)}))
