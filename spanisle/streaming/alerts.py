"""Alerts on stream events: registrations, pushed and pulled delivery, and a sink that turns micro-batches into events."""

from __future__ import annotations

import json
import threading
import urllib.request
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from itertools import chain, islice

from pyspark.sql import DataFrame


@dataclass
class DatabaseAlert:
    id: int
    query: str
    one_time: bool


@dataclass
class ClientAlert:
    id: int
    alert: int
    push_url: str | None
    one_time: bool
    active: bool = True
    queue: list[list] = field(default_factory=list)


def post(url: str, data: list) -> None:
    """Pushes data to an address as a JSON object."""
    body = json.dumps({"data": data}, default=str).encode()
    urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": "application/json"}), timeout=60).close()  # noqa: S310


class AlertRegistry:
    """Thread-safe; clients with an address are told by `push`, others ask."""

    def __init__(self, push: Callable[[str, list], None] = post):
        self.push = push
        self.alerts: list[DatabaseAlert] = []
        self.clients: list[ClientAlert] = []
        self._lock = threading.RLock()

    def register(self, query: str, one_time: bool = False, notify_url: str | None = None, push: bool = False) -> ClientAlert:
        """One alert for each query, whatever its case; one active client for each address that is pushed to."""
        with self._lock:
            a = next((x for x in self.alerts if x.query.lower() == query.lower()), None)
            if a is None:
                a = DatabaseAlert(len(self.alerts) + 1, query, one_time)
                self.alerts.append(a)
            url = notify_url if push else None
            if url:
                for c in self.clients:
                    if c.active and c.alert == a.id and c.push_url == url:
                        return c
            c = ClientAlert(len(self.clients) + 1, a.id, url, one_time)
            self.clients.append(c)
            return c

    def raise_event(self, alert: int, data: list) -> list[str]:
        """Tells all active clients; gives the addresses that were pushed to.  A pushed one-time client ends with this."""
        return self._tell(alert, [data])

    def _tell(self, alert: int, chunks: Iterable[list]) -> list[str]:
        """One event in chunks: each is pushed by itself, and clients that ask get all of them at once."""
        with self._lock:
            if not any(a.id == alert for a in self.alerts):
                raise KeyError(f"no alert {alert}")
            told = [c for c in self.clients if c.active and c.alert == alert]
            urls, asking = [c.push_url for c in told if c.push_url], [c for c in told if not c.push_url]
            for c in told:
                c.active = not (c.push_url and c.one_time)
        if asking:
            chunks = list(chunks)
            with self._lock:
                for c in asking:
                    c.queue.append([x for data in chunks for x in data])
        for data in chunks:
            for u in urls:
                self.push(u, data)
        return urls

    def status(self, client: int) -> str:
        """`{"data": [...]}` of what waits for a client, or `None`; a one-time client ends with its first answer."""
        with self._lock:
            c = next((x for x in self.clients if x.id == client), None)
            if c is None or not c.active or not c.queue:
                return "None"
            data = [x for q in c.queue for x in q]
            c.queue.clear()
            c.active = not c.one_time
            return json.dumps({"data": data})

    def sink(self, alert: int, most: int = 1000) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: all rows of a batch are one event, pushed in chunks of `most`."""

        def write(df: DataFrame, batch: int) -> None:
            rows = (json.loads(x) for x in df.toJSON().toLocalIterator())
            chunks = iter(lambda: list(islice(rows, most)), [])
            if first := next(chunks, None):
                self._tell(alert, chain([first], chunks))

        return write
