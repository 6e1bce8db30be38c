"""Bounds of requests, as check columns; a request is valid if none is false. A null value takes the default and is valid where there is one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls

# Bounds of the requests' numbers, and of the lengths of their texts.
SEARCH = {
    "topK": (1, 50), "crawlMaxDepth": (1, 5), "crawlMaxPages": (1, 20), "crawlTimeoutMs": (1000, 120000), "crawlConcurrency": (1, 10), "siteCrawlMaxDepth": (1, 10), "siteCrawlMaxPages": (1, 500), "siteCrawlConcurrency": (1, 10),
}
CRAWL = {"maxDepth": (1, 5), "maxPages": (1, 20), "timeoutMs": (1000, 120000)}
SITE = {"maxDepth": (1, 10), "maxPages": (1, 500), "concurrency": (1, 10), "timeoutMs": (1000, 600000)}
QUERY_LENGTH, LANG_LENGTH, URL_LENGTH = (1, 500), (0, 10), (5, 2048)
FRESHNESS, FORMATS = ("any", "day", "week", "month"), ("markdown", "html", "text")


def is_http_url(url: Column) -> Column:
    said = F.trim(url)
    return F.lower(urls.part(said, 1)).isin("http", "https") & (urls.part(said, 2) != "") & F.length(url).between(*URL_LENGTH)


def checks(requests: DataFrame, bounds: dict[str, tuple[int, int]]) -> dict[str, Column]:
    """A check for each column there is: numbers, q, lang, url, freshness and format."""
    there = set(requests.columns)
    out = {c: F.coalesce(F.col(c).between(*b), F.lit(True)) for c, b in bounds.items() if c in there}
    if "q" in there:
        out["q"] = F.coalesce(F.length("q").between(*QUERY_LENGTH), F.lit(False))
    if "lang" in there:
        out["lang"] = F.coalesce(F.length("lang").between(*LANG_LENGTH), F.lit(True))
    if "url" in there:
        out["url"] = F.coalesce(is_http_url(F.col("url")), F.lit(False))
    if "freshness" in there:
        out["freshness"] = F.coalesce(F.col("freshness").isin(*FRESHNESS), F.lit(True))
    if "format" in there:
        out["format"] = F.coalesce(F.col("format").isin(*FORMATS), F.lit(True))
    return out


def validate(requests: DataFrame, bounds: dict[str, tuple[int, int]] = SEARCH) -> DataFrame:
    """The requests with `failed` (the names of what is out of bounds, sorted) and `valid`."""
    found = sorted(checks(requests, bounds).items())
    failed = F.filter(F.array(*[F.when(~ok, F.lit(name)) for name, ok in found]), lambda x: x.isNotNull())
    return requests.withColumn("failed", failed).withColumn("valid", F.size("failed") == 0)
