"""Read-only view of upcoming cards over HTTP (SRV-02), as a WSGI application.

Views are reread on every request. GET and HEAD are the only methods; a view that is not there yet is a 503, one that
fails a 500, both without details of the failure.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from http import HTTPStatus
from socketserver import ThreadingMixIn
from wsgiref.simple_server import WSGIRequestHandler, WSGIServer, make_server

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame

UPCOMING = "/api/predictions/upcoming"
READING = ("GET", "HEAD")
#: On every reply: nothing in it is to be run, framed, sniffed or stored.
GUARDS = [("Content-Security-Policy", "default-src 'none'; frame-ancestors 'none'; base-uri 'none'"), ("X-Content-Type-Options", "nosniff"), ("Cache-Control", "no-store")]

View = Callable[[], DataFrame]
App = Callable[[dict, Callable], Iterable[bytes]]


def lines(view: DataFrame) -> bytes:
    """One row a line as JSON; a card is a few dozen bouts."""
    return "".join(f"{row}\n" for row in view.toJSON().collect()).encode()


def answer(views: Mapping[str, View], method: str, path: str) -> tuple[HTTPStatus, bytes]:
    """Status and body for a request; the body of a refusal is the status's phrase."""
    if method not in READING:
        status = HTTPStatus.METHOD_NOT_ALLOWED
    elif path not in views:
        status = HTTPStatus.NOT_FOUND
    else:
        try:
            return HTTPStatus.OK, lines(views[path]())
        except (FileNotFoundError, AnalysisException):  # Spark's word for a table that is not there
            status = HTTPStatus.SERVICE_UNAVAILABLE
        except Exception:
            status = HTTPStatus.INTERNAL_SERVER_ERROR
    return status, status.phrase.encode()


def application(views: Mapping[str, View]) -> App:
    """The WSGI application over a table of routes."""

    def app(environ: dict, start: Callable) -> Iterable[bytes]:
        method = environ["REQUEST_METHOD"]
        status, body = answer(views, method, environ.get("PATH_INFO", ""))
        kind = "application/x-ndjson" if status is HTTPStatus.OK else "text/plain"
        allow = [("Allow", ", ".join(READING))] if status is HTTPStatus.METHOD_NOT_ALLOWED else []
        start(f"{status.value} {status.phrase}", [("Content-Type", f"{kind}; charset=utf-8"), ("Content-Length", str(len(body))), *allow, *GUARDS])
        return [] if method == "HEAD" else [body]

    return app


class _Threads(ThreadingMixIn, WSGIServer):
    daemon_threads = True


class _Quiet(WSGIRequestHandler):
    def log_message(self, *_: object) -> None:
        """No request is logged."""


def serve(load: View, host: str = "127.0.0.1", port: int = 8000) -> WSGIServer:
    return make_server(host, port, application({UPCOMING: load}), server_class=_Threads, handler_class=_Quiet)
