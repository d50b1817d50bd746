"""A paginated service of release calendars, read page by page through a fetch function (HTTP, or a folder of recorded pages)."""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the service's largest page.
PAGE = 1000
Fetch = Callable[[str, dict], dict]


class ServiceError(RuntimeError):
    """An answer other than success; the address is never part of the message, as it holds the key."""


def recorded(folder: str) -> Fetch:
    """Pages recorded as <endpoint>-<offset>.json."""

    def fetch(endpoint: str, params: dict) -> dict:
        path = os.path.join(folder, f"{endpoint.replace('/', '_')}-{params.get('offset', 0)}.json")
        if not os.path.exists(path):
            raise ServiceError(f"{endpoint}: no such page")
        with open(path) as f:
            return json.load(f)

    return fetch


def http(base: str, key: str, timeout: float = 30.0) -> Fetch:
    """The service itself, answering in JSON. Errors name the endpoint and the status, never the address."""

    def fetch(endpoint: str, params: dict) -> dict:
        query = urllib.parse.urlencode({**params, "api_key": key, "file_type": "json"})
        try:
            with urllib.request.urlopen(f"{base.rstrip('/')}/{endpoint}?{query}", timeout=timeout) as answer:
                return json.load(answer)
        except urllib.error.HTTPError as e:
            raise ServiceError(f"{endpoint}: status {e.code}") from None
        except (urllib.error.URLError, OSError, ValueError) as e:
            raise ServiceError(f"{endpoint}: {type(e).__name__}") from None

    return fetch


def vintages(spark: SparkSession, fetch: Fetch, series: str) -> DataFrame:
    """All vintages of a series: realtime_start, date, value; a value the service marks as missing is NULL."""
    found = pages(fetch, "series/observations", "observations", {"series_id": series, "realtime_start": "1776-07-04", "realtime_end": "9999-12-31"})
    rows = spark.createDataFrame([(r["realtime_start"], r["date"], r["value"]) for r in found], "realtime_start string, date string, value string")
    return rows.select(*[F.col(c).try_cast("date").alias(c) for c in ("realtime_start", "date")], F.col("value").try_cast("double").alias("value"))


def pages(fetch: Fetch, endpoint: str, items: str, params: dict | None = None) -> list[dict]:
    """All items of an endpoint, page after page until the count it states is reached."""
    out: list[dict] = []
    while True:
        try:
            page = fetch(endpoint, {**(params or {}), "limit": PAGE, "offset": len(out)})
        except ServiceError:
            raise
        except Exception as e:
            raise ServiceError(f"{endpoint}: {type(e).__name__}") from None
        out += page[items]
        if not page[items] or len(out) >= page.get("count", 0):
            return out


def releases(spark: SparkSession, fetch: Fetch) -> DataFrame:
    rows = [(int(r["id"]), r["name"]) for r in pages(fetch, "releases", "releases")]
    return spark.createDataFrame(rows, "release_id long, name string")


def find_release(table: DataFrame, name: str) -> int:
    """The id of a release: an exact name in any case first, else the only one that contains it; else an error naming up to ten."""
    want = name.strip().lower()
    hits = table.withColumn("n", F.lower(F.trim("name"))).filter(F.contains("n", F.lit(want))).withColumn("exact", F.col("n") == want)
    found = hits.orderBy(F.col("exact").desc(), "name").limit(11).collect()
    exact = [r for r in found if r["exact"]]
    if len(exact) == 1 or (not exact and len(found) == 1):
        return (exact or found)[0]["release_id"]
    raise LookupError(f"{name!r} fits {', '.join(r['name'] for r in found[:10]) or 'no release'}")


def release_dates(spark: SparkSession, fetch: Fetch, release_id: int, first: str, last: str) -> DataFrame:
    rows = [(r["date"],) for r in pages(fetch, "release/dates", "release_dates", {"release_id": release_id})]
    d = spark.createDataFrame(rows, "date string").select(F.col("date").try_cast("date").alias("date")).distinct()
    return d.filter(F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date"))).orderBy("date")
