"""A store's requests and answers in HTTP shapes, and a small server over them.

``GET /v1/keys/<key>`` (the value's bytes, or 404), ``PUT`` and ``DELETE`` of the same (204), ``GET /v1/scan`` with ``prefix``,
or else ``from`` and ``to`` (pairs, values in base64), ``POST /v1/batch`` (operations, 204), ``GET /v1/stats``. Keys are UTF-8.
"""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from kvlake.functions.codec import to_json
from kvlake.sources.store import Store, write_json_batch

#: The names of the figures in answers, by field of ``Stats``.
STATS = {
    "memtable_bytes": "memTableSizeBytes",
    "memtable_entries": "memTableEntryCount",
    "level_count": "levelCount",
    "files_per_level": "fileCountPerLevel",
    "bytes_per_level": "diskSizeBytesPerLevel",
    "file_count": "totalSstFileCount",
    "file_bytes": "totalSstDiskSizeBytes",
    "block_cache_bytes": "blockCacheCurrentSizeBytes",
    "block_cache_max_bytes": "blockCacheMaxSizeBytes",
    "wal_bytes": "walSizeBytes",
}
Answer = tuple[int, str, bytes]


def _json(x: object) -> Answer:
    return 200, "application/json", json.dumps(x).encode()


def answer(store: Store, method: str, url: str, body: bytes = b"") -> Answer:
    """Status, content type and body of a request; 404 for what isn't there, 400 for what can't be read."""
    at = urlsplit(url)
    asked = {k: v[0].encode() for k, v in parse_qs(at.query, keep_blank_values=True).items()}
    done: Answer = (204, "", b"")
    try:
        if at.path.startswith("/v1/keys/"):
            key = unquote(at.path.removeprefix("/v1/keys/")).encode()
            if method == "GET":
                value = store.get(key)
                return (404, "", b"") if value is None else (200, "application/octet-stream", value)
            if method == "PUT":
                store.put(key, body)
                return done
            if method == "DELETE":
                store.delete(key)
                return done
        elif (method, at.path) == ("GET", "/v1/scan"):
            found = store.scan_prefix(asked["prefix"]) if "prefix" in asked else store.scan(asked.get("from"), asked.get("to"))
            return _json([to_json(bytes(r.key), bytes(r.value)) for r in found.toLocalIterator()])
        elif (method, at.path) == ("POST", "/v1/batch"):
            write_json_batch(store, json.loads(body))
            return done
        elif (method, at.path) == ("GET", "/v1/stats"):
            return _json({STATS[k]: v for k, v in vars(store.stats()).items()})
    except (ValueError, KeyError, TypeError) as e:
        return 400, "text/plain", str(e).encode()
    return 404, "", b""


def server(store: Store, port: int = 0, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server over ``store``; ``serve_forever`` runs it."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            status, kind, out = answer(store, self.command, self.path, body)
            self.send_response(status)
            if kind:
                self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(out)))
            self.end_headers()
            self.wfile.write(out)

        do_GET = do_PUT = do_DELETE = do_POST = _answer

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
