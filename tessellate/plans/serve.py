"""The catalog over HTTP, on the loopback interface only: GET /api/data."""

from __future__ import annotations

from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import SparkSession

from .catalog import bundle

# Headers of every answer.
HEADERS = {"Cache-Control": "no-store", "X-Content-Type-Options": "nosniff", "Referrer-Policy": "no-referrer", "Content-Security-Policy": "default-src 'self'"}


def handler(spark: SparkSession, root: str) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            known = self.path.split("?")[0] == "/api/data"
            body = bundle(spark, root).encode("utf-8") if known else b"not found"
            self.send_response(200 if known else 404)
            self.send_header("Content-Type", "application/json; charset=utf-8" if known else "text/plain")
            self.send_header("Content-Length", str(len(body)))
            for k, v in HEADERS.items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    return Handler


def server(spark: SparkSession, root: str, port: int = 8000) -> ThreadingHTTPServer:
    return ThreadingHTTPServer(("127.0.0.1", port), handler(spark, root))
