"""Gated HTTP as a Spark data source, in batches and as a stream (SRC-14, SRC-15).

    spark.dataSource.register(HttpFeed)
    spark.read.format("http_feed").option("url", "https://x/odds?at={time}").option("start", ...).option("step", 3600).option("end", ...)...

Requests are planned as partitions and sent by executors. Replies are kept below ``cache``, a folder that all executors mount, under the hash of their
address: what is there is not fetched again, so a partition that failed and runs again pays for the rest only. One rate gate serves all partitions: a request
takes the next free slot of time, by exclusively creating its file below ``cache``. Nothing is sent unless both gates are open.
"""

from __future__ import annotations

import hashlib
import importlib
import json
import os
import time
import uuid
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from contestkit.sources.remote import Client, FetchError, Transport, over_http

SCHEMA = "url string, time timestamp, payload string, cached boolean"


class Requests(InputPartition):
    """Addresses with the times that they ask for (ISO text, or none)."""

    def __init__(self, wanted: list[tuple[str, str | None]]) -> None:
        super().__init__(0)
        self.wanted = wanted


class Settings:
    """The options, as all readers need them."""

    def __init__(self, options: dict[str, str]) -> None:
        options = {k.lower(): v for k, v in options.items()}  # Spark's options know no case
        self.url, self.cache = options["url"], options["cache"].removeprefix("file://")
        self.rate = float(options.get("rate", 1.0))
        self.allowed = all(options.get(k, "false").lower() == "true" for k in ("allownetwork", "allowbillable"))
        self.n_partitions = int(options.get("partitions", 4))
        self.transport_name = options.get("transport")
        self.step = timedelta(seconds=float(options.get("step", 3600)))
        parse = lambda x: datetime.fromisoformat(x.replace("Z", "+00:00")).astimezone(timezone.utc)
        self.start, self.end = (parse(options[k]) if k in options else None for k in ("start", "end"))
        if "{time}" in self.url and self.start is None:
            raise ValueError("a url with {time} needs the option start")

    def transport(self) -> Transport:
        """Over HTTP, or the function that the option names as module:function."""
        if not self.transport_name:
            return over_http
        module, _, name = self.transport_name.partition(":")
        return getattr(importlib.import_module(module), name)

    def at(self, k: int) -> tuple[str, str | None]:
        """The k-th request."""
        if "{time}" not in self.url:
            return self.url, None
        when = (self.start + k * self.step).strftime("%Y-%m-%dT%H:%M:%SZ")
        return self.url.replace("{time}", when), when

    def due(self, now: datetime) -> int:
        """How many requests there are up to now, and to the end."""
        if "{time}" not in self.url:
            return 1
        last = min(now, self.end) if self.end else now
        return max(0, (last - self.start) // self.step + 1)

    def planned(self, first: int, stop: int) -> list[Requests]:
        """Requests first to stop - 1, dealt to the partitions in runs."""
        wanted = [self.at(k) for k in range(first, stop)]
        size = -(-len(wanted) // self.n_partitions) or 1
        return [Requests(wanted[k : k + size]) for k in range(0, len(wanted), size)]

    # what executors do

    def wait(self) -> None:
        """Takes the next free slot of 1 / rate seconds, over all partitions, and waits for it."""
        folder = f"{self.cache}/slots"
        os.makedirs(folder, exist_ok=True)
        slot = int(time.time() * self.rate) + 1
        while True:
            try:
                os.close(os.open(f"{folder}/{slot}", os.O_CREAT | os.O_EXCL | os.O_WRONLY))
                break
            except FileExistsError:
                slot += 1
        time.sleep(max(0.0, slot / self.rate - time.time()))

    def fetched(self, url: str) -> tuple[str, bool]:
        """(payload, whether it was in the cache)."""
        path = f"{self.cache}/{hashlib.sha256(url.encode()).hexdigest()}.json"
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                return f.read(), True
        if not self.allowed:
            raise FetchError("offline", f"{url} is not cached, and requests are not allowed")

        def gated(address: str, timeout: float) -> tuple[int, bytes]:
            self.wait()
            return self.transport()(address, timeout)

        payload = json.dumps(Client(gated, True, True, pause=1 / self.rate).json(url), ensure_ascii=False)
        staged = f"{path}.{uuid.uuid4().hex}"
        with open(staged, "w", encoding="utf-8") as f:
            f.write(payload)
        os.replace(staged, path)
        return payload, False

    def rows(self, partition: Requests) -> Iterator[tuple]:
        for url, when in partition.wanted:
            payload, cached = self.fetched(url)
            yield url, when and datetime.strptime(when, "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=timezone.utc), payload, cached


class _Reader(DataSourceReader):
    def __init__(self, settings: Settings) -> None:
        self.settings = settings

    def partitions(self) -> list[InputPartition]:
        return self.settings.planned(0, self.settings.due(datetime.now(timezone.utc)))

    def read(self, partition: Requests) -> Iterator[tuple]:
        return self.settings.rows(partition)


class _StreamReader(DataSourceStreamReader):
    """Offsets are numbers of requests; a batch has those that fell due since the last one."""

    def __init__(self, settings: Settings) -> None:
        self.settings = settings

    def initialOffset(self) -> dict:
        return {"requests": 0}

    def latestOffset(self) -> dict:
        return {"requests": self.settings.due(datetime.now(timezone.utc))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.settings.planned(start["requests"], end["requests"])

    def read(self, partition: Requests) -> Iterator[tuple]:
        return self.settings.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class HttpFeed(DataSource):
    """Options: url (with {time} for a series), cache, start, end, step (seconds), rate (requests a second over all partitions), partitions, allowNetwork, allowBillable, transport."""

    @classmethod
    def name(cls) -> str:
        return "http_feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(Settings(dict(self.options)))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(Settings(dict(self.options)))
