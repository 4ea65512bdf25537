"""HTTP bodies as a table, with retries: a map over rows of addresses, for sources that are fetched and not stored.

A request is tried again after 429 (waiting what Retry-After says, in seconds or as a date), after a
status of 500 or more, and after a broken connection, each time longer (doubling, with jitter, capped).
Any other status is an answer. Nothing is fetched twice by one task unless it is retried.
"""

from __future__ import annotations

import email.utils
import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

CAP = 60.0
RESULT = "url string, status int, body binary, attempts int, error string"


def wait_before(attempt: int, status: int | None, retry_after: str | None, now: float, jitter: float, first: float = 1.0) -> float | None:
    """Seconds to wait before the next attempt, or None if the answer is final. ``attempt`` counts from 1, ``jitter`` is in [0, 1)."""
    if status is not None and status != 429 and status < 500:
        return None
    if status == 429 and retry_after:
        word = retry_after.strip()
        if word.isdigit():
            return min(float(word), CAP)
        try:
            return min(max(email.utils.parsedate_to_datetime(word).timestamp() - now, 0.0), CAP)
        except (TypeError, ValueError):
            pass
    return min(first * 2 ** (attempt - 1) * (1 + jitter), CAP)


def fetch_one(url: str, attempts: int, first: float, sleep: Callable[[float], None] = time.sleep) -> tuple[int | None, bytes | None, int, str | None]:
    """(status, body, attempts made, error) of one address."""
    status, body, error = None, None, None
    for n in range(1, attempts + 1):
        status, body, error, after = None, None, None, None
        try:
            with urllib.request.urlopen(url, timeout=30) as answer:
                status, body = answer.status, answer.read()
        except urllib.error.HTTPError as e:
            status, body, after = e.code, e.read(), e.headers.get("Retry-After")
        except (urllib.error.URLError, OSError) as e:
            error = str(e)
        wait = wait_before(n, status, after, time.time(), random.random(), first)
        if wait is None or n == attempts:
            return status, body, n, error
        sleep(wait)
    return status, body, attempts, error


def fetch(addresses: DataFrame, attempts: int = 5, first: float = 1.0) -> DataFrame:
    """(url, status, body, attempts, error) of the distinct, non-null addresses in the column url."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            urls = b.column(0).to_pylist()
            got = [fetch_one(u, attempts, first) for u in urls]
            kinds = (pa.int32(), pa.binary(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(urls, pa.string()), *(pa.array([g[i] for g in got], k) for i, k in enumerate(kinds))], names=["url", "status", "body", "attempts", "error"])

    return addresses.select("url").where("url is not null").distinct().mapInArrow(run, RESULT)
