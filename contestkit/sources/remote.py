"""Fetching on the driver (SRC-14, SRC-15): gated, retried, cached. Executors only read what was stored."""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

Transport = Callable[[str, float], tuple[int, bytes]]


class FetchError(Exception):
    """A request that failed; ``kind`` tells how: unauthorized, forbidden, rate_limited, server, schema, offline, challenge or other."""

    def __init__(self, kind: str, message: str) -> None:
        super().__init__(f"{kind}: {message}")
        self.kind = kind


def over_http(url: str, timeout: float) -> tuple[int, bytes]:
    try:
        with urllib.request.urlopen(url, timeout=timeout) as reply:  # noqa: S310
            return reply.status, reply.read()
    except urllib.error.HTTPError as e:
        return e.code, e.read()


_KINDS = {401: "unauthorized", 403: "forbidden", 429: "rate_limited"}


@dataclass
class Client:
    """JSON over HTTP. Nothing is sent unless both gates are open."""

    transport: Transport = over_http
    allow_network: bool = False
    allow_billable: bool = False
    retries: int = 3
    pause: float = 1.0
    timeout: float = 30.0
    sleep: Callable[[float], None] = time.sleep

    def json(self, url: str) -> object:
        if not (self.allow_network and self.allow_billable):
            raise FetchError("offline", "network or billable requests are not allowed")
        for attempt in range(self.retries + 1):
            status, body = self.transport(url, self.timeout)
            if status == 200:
                try:
                    return json.loads(body)
                except ValueError as e:
                    raise FetchError("schema", "the reply is no JSON") from e
            kind = _KINDS.get(status, "server" if status >= 500 else "other")
            if kind not in ("rate_limited", "server") or attempt == self.retries:
                raise FetchError(kind, f"status {status}")
            self.sleep(self.pause * 2**attempt)
        raise AssertionError


def cached_page(url: str, folder: Path, transport: Transport = over_http, offline: bool = True, delay: float = 1.0, classify: Callable[[str], str] | None = None) -> str:
    """The page from the cache, else fetched, checked for a challenge and stored under the hash of its address."""
    path = folder / f"{hashlib.sha256(url.encode()).hexdigest()[:32]}.html"
    if path.exists():
        return path.read_text(encoding="utf-8")
    if offline:
        raise FetchError("offline", f"{url} is not cached")
    status, body = transport(url, 30.0)
    if status != 200:
        raise FetchError(_KINDS.get(status, "other"), f"status {status}")
    page = body.decode("utf-8", "replace")
    if classify and classify(page) == "challenge":
        raise FetchError("challenge", url)
    folder.mkdir(parents=True, exist_ok=True)
    staged = path.with_suffix(".tmp")
    staged.write_text(page, encoding="utf-8")
    staged.replace(path)
    time.sleep(delay)
    return page
