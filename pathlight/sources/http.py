"""Measurement services over HTTP. `fetch(url) -> (status, headers, body)` does the transport and can be replaced in tests.

Services answer with documents of bounded size, so the driver reads them and hands their
text to Spark; several measurements are fetched in tasks of their own.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections.abc import Callable, Iterator
from urllib.parse import urlencode, urljoin, urlsplit
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

Fetch = Callable[[str], tuple[int, dict[str, str], str]]
MOST_RETRIES = 3
STOPPED, ONGOING = 4, 2


class HttpError(RuntimeError):
    pass


def plain_fetch(url: str, timeout: float = 30.0) -> tuple[int, dict[str, str], str]:
    with urlopen(Request(url), timeout=timeout) as r:  # noqa: S310
        return r.status, dict(r.headers), r.read().decode()


def retry_after(header: str | None) -> float:
    """Seconds to wait: 5 for a missing, bad or negative header, a tenth of a second for 0."""
    try:
        n = int(header or "")
    except ValueError:
        return 5.0
    return 5.0 if n < 0 else n or 0.1


def truncated(body: str, most: int = 200) -> str:
    """The first bytes of a body, marked where they are not all."""
    raw = body.encode()
    return body if len(raw) <= most else raw[:most].decode(errors="ignore") + "..."


def get(url: str, fetch: Fetch = plain_fetch, sleep: Callable[[float], None] = time.sleep) -> str:
    """The body; only status 429 is tried again, and errors show the first 200 bytes."""
    for tries in range(MOST_RETRIES + 1):
        status, headers, body = fetch(url)
        if status == 429 and tries < MOST_RETRIES:
            sleep(retry_after({k.lower(): v for k, v in headers.items()}.get("retry-after")))
            continue
        if not 200 <= status < 300:
            raise HttpError(f"status {status}: {truncated(body)}")
        return body
    raise HttpError("too many requests")


def query(base: str, **given) -> str:
    kept = {k: v for k, v in given.items() if v not in (None, "", 0)}
    return f"{base}?{urlencode(kept)}" if kept else base


class Cache:
    """Documents in files named by the hash of what was asked for."""

    def __init__(self, folder: str):
        self.folder = folder

    @staticmethod
    def key(*parts: object) -> str:
        return hashlib.sha256(":".join(map(str, parts)).encode()).hexdigest()

    def path(self, key: str) -> str:
        return os.path.join(self.folder, f"{key}.json")

    def has(self, key: str) -> bool:
        return os.path.exists(self.path(key))

    def load(self, key: str) -> str:
        with open(self.path(key), encoding="utf-8") as f:
            return f.read()

    def store(self, key: str, text: str) -> None:
        os.makedirs(self.folder, exist_ok=True)
        with open(self.path(key), "w", encoding="utf-8") as f:
            f.write(text)


class MeasurementService:
    """A measurement archive: results, status, search, and waiting for results."""

    def __init__(self, base: str, fetch: Fetch = plain_fetch, sleep: Callable[[float], None] = time.sleep, cache: Cache | None = None):
        self.base, self.fetch, self.sleep, self.cache = base.rstrip("/"), fetch, sleep, cache

    def _get(self, url: str) -> str:
        return get(url, self.fetch, self.sleep)

    def results(self, measurement: int, start: int = 0, stop: int = 0) -> str:
        key = Cache.key(measurement, start, stop)
        if self.cache and self.cache.has(key):
            return self.cache.load(key)
        text = self._get(query(f"{self.base}/measurements/{measurement}/results/", start=start, stop=stop))
        if self.cache:
            self.cache.store(key, text)
        return text

    def status(self, measurement: int) -> dict:
        return json.loads(self._get(f"{self.base}/measurements/{measurement}/"))

    def search(self, kind: str = "", status: int = 0, description: str = "", page_size: int = 0) -> Iterator[dict]:
        """Every page's results, following links to the next."""
        url = query(f"{self.base}/measurements/", type=kind, status=status, description__contains=description, page_size=page_size)
        while url:
            page = json.loads(self._get(url))
            yield from page.get("results") or []
            url = page.get("next")

    def wait(self, measurement: int, timeout: float, clock: Callable[[], float] = time.monotonic) -> str:
        """Results once the measurement has stopped or is under way; asks after 5 s, then ever later up to 30 s."""
        end, pause = clock() + timeout, 5.0
        while True:
            if (self.status(measurement).get("status") or {}).get("id") in (STOPPED, ONGOING):
                return self.results(measurement)
            if clock() + pause > end:
                raise TimeoutError(f"measurement {measurement} is not ready")
            self.sleep(pause)
            pause = min(2 * pause, 30.0)

    def frame(self, spark: SparkSession, measurements: list[int], start: int = 0, stop: int = 0) -> DataFrame:
        """measurement and value, the text of its results; each is fetched in a task of its own."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for df in batches:
                yield pd.DataFrame({"measurement": df["measurement"], "value": [self.results(int(m), start, stop) for m in df["measurement"]]})

        ids = spark.createDataFrame([(m,) for m in measurements], "measurement bigint")
        return ids.repartition(max(1, len(measurements)), "measurement").mapInPandas(run, "measurement bigint, value string")


def resolve_uri(base: str, uri: str) -> str:
    """uri against the scheme and host of base; absolute ones stay."""
    at = urlsplit(base)
    return urljoin(f"{at.scheme}://{at.netloc}/", uri)


def latency_text(base: str, src: str, dst: str, seconds: int, fetch: Fetch = plain_fetch, sleep: Callable[[float], None] = time.sleep) -> str:
    """The points of the first archive record of a pair, as text; an empty list where there is no record."""
    meta = json.loads(get(query(base, source=src, destination=dst, **{"time-range": seconds}), fetch, sleep))
    if not meta:
        return "[]"
    for event in meta[0].get("event-types") or []:
        if event.get("event-type") == "packet-trace" and event.get("base-uri"):
            return get(resolve_uri(base, event["base-uri"]), fetch, sleep)
    raise HttpError("the record has no packet trace")


class AsnResolver:
    """Addresses to AS numbers, remembered; whatever fails is 0."""

    def __init__(self, base: str, fetch: Fetch = plain_fetch):
        self.base, self.fetch, self.known = base, fetch, {}

    def resolve(self, ip: str) -> int:
        if ip not in self.known:
            try:
                asns = json.loads(get(query(self.base, resource=ip), self.fetch, lambda _: None))["data"]["asns"]
                self.known[ip] = int(asns[0])
            except Exception:  # noqa: BLE001
                self.known[ip] = 0
        return self.known[ip]

    def frame(self, hops: DataFrame) -> DataFrame:
        """ip and asn of the distinct answering addresses, looked up in tasks."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for df in batches:
                yield pd.DataFrame({"ip": df["ip"], "asn": [self.resolve(i) for i in df["ip"]]})

        return hops.filter("NOT anonymous AND ip <> ''").select("ip").distinct().mapInPandas(run, "ip string, asn bigint")


def load_dotenv(text: str, env: dict[str, str]) -> dict[str, str]:
    """KEY=VALUE lines into env: comments go, quotes around a value go, what is set stays."""
    for line in text.splitlines():
        key, eq, value = line.strip().partition("=")
        if not eq or key.startswith("#"):
            continue
        value = value.strip()
        if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"":
            value = value[1:-1]
        env.setdefault(key.strip(), value)
    return env
