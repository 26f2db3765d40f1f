"""HTTP sources as Spark data sources: pages, windows and ids are partitions, the transport is injectable.

A connector is a plan of requests (a list of partitions made on the driver from its options) and a reader of one partition
that pages through the service and yields one JSON text per record. A partition is retried as a whole and yields the same
records again, so a lost executor costs a repeat of its requests, not a gap. A service that does not answer after all
retries, or gives fewer records than it reports, raises: Spark then retries the partition, and fails rather than leave a gap. A service's rate limit holds over all partitions: the
requests are dealt to at most ``parallel`` of them (an option, 4 by default), and each keeps to its share of the rate.
The transport is any picklable callable ``(url, params) -> (status, body)``; tests pass recorded replies.
"""

from __future__ import annotations

import json
import threading
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import date, timedelta
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Transport = Callable[[str, dict], tuple[int, Any]]

# fixed values: request limits and stop rules of the services
RETRIES, RETRY_WAIT = 5, 2.0
BUSY, BUSY_WAIT = 429, 10.0
CALLS, PER_SECONDS = 100, 60.0
STORE_CALLS, STORE_SECONDS = 200, 300.0
QUESTION_PAGE, QUESTION_SKIP = 1000, 20_000
PARTY_SKIP, MEMBER_SKIP = 200_000, 500_000
DAILY_FROM = 9_500
#: Partitions that a connector reads in, unless its options say otherwise.
PARALLEL = 4


def http(url: str, params: dict, timeout: float = 10.0) -> tuple[int, Any]:
    """GET of a JSON document with the standard library."""
    full = url + ("?" + urllib.parse.urlencode(params) if params else "")
    try:
        with urllib.request.urlopen(urllib.request.Request(full, headers={"Accept": "application/json"}), timeout=timeout) as reply:
            return reply.status, json.load(reply)
    except urllib.error.HTTPError as e:
        return e.code, None


def http_text(url: str, params: dict, timeout: float = 60.0) -> tuple[int, str | None]:
    """GET of a text document, with three further tries where the service fails."""
    for wait in (0.0, 1.5, 3.0, 4.5):
        time.sleep(wait)
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"Connection": "close"}), timeout=timeout) as reply:
                return reply.status, reply.read().decode(errors="replace")
        except urllib.error.HTTPError as e:
            if e.code not in (500, 502, 503, 504):
                return e.code, None
            status = e.code
        except OSError:
            status = 599
    return status, None


@dataclass
class Limiter:
    """No more than ``calls`` in any ``seconds``."""

    calls: int = CALLS
    seconds: float = PER_SECONDS
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    at: list[float] = field(default_factory=list)

    def wait(self) -> None:
        now = self.clock()
        self.at = [t for t in self.at if now - t < self.seconds]
        if len(self.at) >= self.calls:
            self.sleep(self.seconds - (now - self.at[0]))
        self.at.append(self.clock())


class Incomplete(RuntimeError):
    """Not all records of a request could be read."""


def fetch(transport: Transport, url: str, params: dict, limiter: Limiter | None = None, retries: int = RETRIES, sleep: Callable[[float], None] = time.sleep) -> Any:
    """The body of a 200 reply; None where the service says that it has nothing. Raises :class:`Incomplete` if no try succeeds."""
    for attempt in range(retries):
        if limiter:
            limiter.wait()
        try:
            status, body = transport(url, params)
        except OSError:
            status, body = 599, None
        if status == 200:
            return body
        if 400 <= status < 500 and status != BUSY:
            return None
        if attempt + 1 < retries:
            sleep(BUSY_WAIT if status == BUSY else RETRY_WAIT)
    raise Incomplete(f"{url} gave status {status} in each of {retries} tries, last for {params}")


def months(start: date, end: date) -> list[tuple[date, date]]:
    """Calendar months from ``start`` to ``end``, both clipped."""
    out, at = [], start
    while at <= end:
        last = (at.replace(day=28) + timedelta(days=4)).replace(day=1) - timedelta(days=1)
        out.append((at, min(last, end)))
        at = last + timedelta(days=1)
    return out


def days(start: date, end: date) -> list[tuple[date, date]]:
    return [(start + timedelta(days=i),) * 2 for i in range((end - start).days + 1)]


@dataclass(frozen=True)
class Service:
    """How one service is asked. ``records(body)`` are a page's records, ``count(body)`` the total it reports, if any."""

    url: str
    page: int
    records: Callable[[Any], list]
    count: Callable[[Any], int | None] = lambda body: None
    most: int = 10**9
    paging: str = "skip"  # skip | page | none


def _results(body: Any) -> list:
    return (body or {}).get("results", [])


def _total(body: Any) -> int | None:
    return ((body or {}).get("head", {}).get("counts", {}) or {}).get("resultCount")


API = "https://api.oireachtas.ie/v1"
SERVICES: dict[str, Service] = {
    "oireachtas_questions": Service(f"{API}/questions", QUESTION_PAGE, _results, _total, QUESTION_SKIP),
    "oireachtas_debates": Service(f"{API}/debates", 50, _results, _total),
    "oireachtas_members": Service(f"{API}/members", 50, _results, _total, MEMBER_SKIP),
    "oireachtas_parties": Service(f"{API}/parties", 50, lambda b: ((b or {}).get("results", {}) or {}).get("house", {}).get("parties", []) if isinstance((b or {}).get("results"), dict) else _results(b), _total, PARTY_SKIP),
    "boards": Service("https://www.boards.ie/api/v2/discussions", 50, lambda b: b or [], paging="page"),
    "boards_comments": Service("https://www.boards.ie/api/v2/comments", 500, lambda b: b or [], paging="page"),
    "steam_app_list": Service("https://api.steampowered.com/IStoreService/GetAppList/v1/", 0, lambda b: (b or {}).get("response", {}).get("apps", []), paging="none"),
    "steam_store": Service("https://store.steampowered.com/api/appdetails", 0, lambda b: [v["data"] for v in (b or {}).values() if v and v.get("success")], paging="none"),
    "steam_review": Service("https://store.steampowered.com/appreviews/{id}", 0, lambda b: [(b or {})["query_summary"]] if (b or {}).get("query_summary") else [], paging="none"),
    "steam_current_user": Service("https://api.steampowered.com/ISteamUserStats/GetNumberOfCurrentPlayers/v1", 0, lambda b: [(b or {}).get("response") or {}], paging="none"),
}


@dataclass
class Request(InputPartition):
    params: dict
    url: str
    tag: dict


@dataclass
class Batch(InputPartition):
    """The requests of one partition, and into how many parts the rate is shared."""

    requests: list[Request]
    parts: int


def share_of(calls: int, seconds: float, parts: int) -> tuple[int, float]:
    """The rate that each of ``parts`` readers may keep so that all together stay within the whole one."""
    return (calls // parts, seconds) if calls >= parts else (1, seconds * parts / calls)


def pages(service: Service, request: Request, transport: Transport, limiter: Limiter | None = None, sleep=time.sleep) -> Iterator[Any]:
    """The records of one partition, page by page, until a short page or the reported count; raises if that count, or the end before the skip cap, is not reached."""
    if service.paging == "none":
        body = fetch(transport, request.url, request.params, limiter, sleep=sleep)
        yield from service.records(body)
        return
    at, got, total = (0 if service.paging == "skip" else 1), 0, None
    while True:
        ask = {"skip": at, "limit": service.page} if service.paging == "skip" else {"page": at, "limit": service.page}
        body = fetch(transport, request.url, request.params | ask, limiter, sleep=sleep)
        records = service.records(body) if body is not None else []
        yield from records
        got += len(records)
        total = service.count(body) if body is not None else total
        if total is not None and got >= total:
            return
        if not records or len(records) < service.page:
            if total is not None:
                raise Incomplete(f"{request.url} gave {got} of {total} records for {request.params}")
            return
        at += service.page if service.paging == "skip" else 1
        if service.paging == "skip" and at > service.most:
            raise Incomplete(f"{request.url} holds more than the {got} records that may be skipped through for {request.params}: ask for shorter windows")


def requests(name: str, options: dict[str, Any], transport: Transport = http) -> list[Request]:
    """The partitions of a connector: date windows, ids, or one."""
    service = SERVICES[name]
    base = {k: v for k, v in options.items() if k not in ("ids", "date_start", "date_end", "discussion_id", "category_id")}
    ids = [x for x in str(options.get("ids", "")).split(",") if x]
    span = [date.fromisoformat(options[k]) for k in ("date_start", "date_end") if options.get(k)]
    if name == "boards_comments":
        window = {"dateInserted": f"[{span[0]},{span[-1]}]"} if span else {}
        return [Request(base | {"discussionid": i} | window, service.url, {"discussionID": int(i)}) for i in ids]
    if name == "boards":
        asked = base | {"CategoryID": options.get("category_id")}
        return [Request(asked | {"dateLastComment": str(a)}, service.url, {}) for a, _ in days(span[0], span[-1])] if span else [Request(asked, service.url, {})]
    if name == "steam_store":
        return [Request(base | {"appids": i}, service.url, {"AppID": int(i)}) for i in ids]
    if name == "steam_review":
        return [Request(base | {"json": 1, "purchase_type": "all", "num_per_page": 1}, service.url.format(id=i), {"AppID": int(i)}) for i in ids]
    if name == "steam_current_user":
        return [Request(base | {"appid": i}, service.url, {"AppID": int(i)}) for i in ids]
    if name == "oireachtas_questions" and span:
        spans, limiter, lock = months(span[0], span[-1]), Limiter(), threading.Lock()

        def windows(ab: tuple[date, date]) -> list[tuple[date, date]]:
            # a month that holds more than the service lets one page through is asked day by day
            with lock:
                limiter.wait()
            probe = fetch(transport, service.url, base | {"date_start": str(ab[0]), "date_end": str(ab[1]), "skip": 0, "limit": 1})
            return days(*ab) if (_total(probe) or 0) >= DAILY_FROM else [ab]

        with ThreadPoolExecutor(8) as pool:
            return [Request(base | {"date_start": str(x), "date_end": str(y)}, service.url, {}) for found in pool.map(windows, spans) for x, y in found]
    if name == "oireachtas_debates" and span:
        return [Request(base | {"date": str(a)}, service.url, {}) for a, _ in days(span[0], span[-1])]
    if name == "steam_app_list":
        base = {"include_games": 1, "cc": "ie", "l": "en", "max_results": 50_000} | base
    if span:
        base |= {"date_start": str(span[0]), "date_end": str(span[-1])}
    return [Request(base, service.url, {})]


class _Reader(DataSourceReader):
    def __init__(self, name: str, options: dict, transport: Transport) -> None:
        self.name, self.options, self.transport = name, options, transport

    def partitions(self) -> list[Batch]:
        parallel = int(self.options.get("parallel", PARALLEL))
        asked = requests(self.name, {k: v for k, v in self.options.items() if k != "parallel"}, self.transport)
        parts = max(1, min(parallel, len(asked)))
        return [Batch(asked[i::parts], parts) for i in range(parts)]

    def read(self, partition: Batch) -> Iterator[tuple]:
        rate = (STORE_CALLS, STORE_SECONDS) if self.name.startswith("steam") else (CALLS, PER_SECONDS)
        limiter = Limiter(*share_of(*rate, partition.parts))
        for request in partition.requests:
            empty = True
            for record in pages(SERVICES[self.name], request, self.transport, limiter):
                empty = False
                yield (json.dumps(record | request.tag if isinstance(record, dict) else record),)
            if empty and self.name == "steam_current_user":
                # a game without an answer keeps its row
                yield (json.dumps(request.tag),)


def source(name: str, transport: Transport = http) -> type[DataSource]:
    """A data source class for ``spark.dataSource.register``: one column ``value`` with a JSON text per record."""
    if name not in SERVICES:
        raise KeyError(f"unknown connector {name!r}; known: {', '.join(sorted(SERVICES))}")

    class Connector(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "value string"

        def reader(self, schema) -> DataSourceReader:
            return _Reader(name, dict(self.options), transport)

    return Connector


def load(spark: SparkSession, name: str, transport: Transport = http, **options: str) -> DataFrame:
    spark.dataSource.register(source(name, transport))
    return spark.read.format(name).options(**options).load()
