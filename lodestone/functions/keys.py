"""Cache keys: a kind and a hash of what a request is told apart by."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def flag(c: Column) -> Column:
    """A boolean as the keys write it."""
    return F.when(c, "True").otherwise("False")


def key(kind: str, *parts: Column) -> Column:
    """A null part counts as empty."""
    raw = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(f"oc:{kind}:"), F.substring(F.sha2(raw, 256), 1, 16))


def crawl_options(max_depth: Column, max_pages: Column, timeout_ms: Column, concurrency: Column, only_main: Column, bypass_cache: Column) -> Column:
    """The options that tell crawls apart; whether robots are respected is not among them."""
    return F.concat_ws("|", *[c.cast("string") for c in (max_depth, max_pages, timeout_ms, concurrency)], flag(only_main), flag(bypass_cache))


def search(query: Column, freshness: Column, top_k: Column, need_content: Column, need_crawl: Column, need_map: Column, need_site_crawl: Column, form: Column, lang: Column, options: Column) -> Column:
    """Of a search request; crawl options count where a crawl is asked for, the language where it is given."""
    parts = F.concat_ws(":", F.trim(query), freshness, top_k.cast("string"), flag(need_content), flag(need_crawl), flag(need_map), flag(need_site_crawl), form)
    parts = F.concat(parts, F.when(need_crawl, F.concat(F.lit(":"), options)).otherwise(""), F.when(F.coalesce(lang, F.lit("")) != "", F.concat(F.lit(":"), lang)).otherwise(""))
    return key("search", parts)


def content(url: Column) -> Column:
    return key("content", url)


def robots(domain: Column) -> Column:
    return key("robots", domain)


def url_map(domain: Column, patterns: Column) -> Column:
    """By domain and include patterns, as both choose the content."""
    return key("map", domain, F.array_join(patterns, ","))
