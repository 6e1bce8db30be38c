"""Content of urls: the gates before a crawl, the choice among captured answers, two layers of cleaning, and caches.

Tables stand in for the network: captured answers, pages, robots texts, resolved addresses, caches, cooldowns. A table
that is left out holds nothing: robots then allow all, and names that are in no dns table are unsafe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, urls
from ..sources import store
from . import crawl as links
from . import html, payload
from . import markdown as md

CRAWL_MOST, FETCH_MOST = 100_000, 50_000


def with_safety(rows: DataFrame, dns: DataFrame | None = None) -> DataFrame:
    """Adds `safe`: http or https to a host that is not local, whose address, or whose every address in dns (host, address), lies outside the blocked networks."""
    literal = urls.safe_literal(F.col("url"))
    if dns is None:
        return rows.withColumn("safe", F.coalesce(literal, F.lit(False)))
    hosts = dns.groupBy(F.lower("host").alias("_host")).agg(F.bool_and(~F.coalesce(urls.blocked_address(F.col("address")), F.lit(True))).alias("_safe"))
    out = rows.withColumn("_host", urls.host(F.col("url"))).join(hosts, "_host", "left")
    return out.withColumn("safe", F.coalesce(literal, "_safe", F.lit(False))).drop("_host", "_safe")


def _sanitized(c: Column, most: int) -> Column:
    return md.repair_decimals(text.sanitize(c, most))


def cleaned(rows: DataFrame, strip: bool = False, most: int = CRAWL_MOST) -> DataFrame:
    """Rows with `found` (payload.fields) as content, markdown and title, cleaned: readable content of raw html first, no pages that stop robots, no navigation (asked more gently where nothing is left), no links where they are over three tenths, sanitised."""
    held = rows.withColumn("_read", F.when(F.col("found.raw_html").isNotNull(), html.main("found.raw_html")))
    read = F.col("_read.markdown")
    held = held.withColumn("_content", F.coalesce(read, "found.content")).withColumn("_markdown", F.coalesce(read, "found.markdown"))
    held = held.withColumn("title", F.coalesce("found.title", F.when(read.isNotNull(), text.as_text(F.col("_read.title")))))
    for c in ("_content", "_markdown"):
        held = held.withColumn(c, F.when(~text.is_bot_page(F.col(c)), F.col(c)))
    clean = lambda c: F.when(F.col(c).isNotNull(), md.clean(F.col(c), not strip))
    gentle = lambda c: F.when(F.col(c).isNotNull() & ~F.col(c).eqNullSafe(read), md.clean(F.col(c), not strip, 0.6, 50))
    held = held.withColumn("_first", clean("_content")).withColumn("_clean_markdown", clean("_markdown"))
    held = held.withColumn("_clean", F.when(F.col("_first") != "", F.col("_first")).otherwise(F.coalesce(F.nullif(gentle("_content"), F.lit("")), F.nullif(gentle("_markdown"), F.lit("")), F.col("_first"))))
    heavy = text.link_density(F.col("_clean")) > 0.3
    held = held.withColumn("_heavy", heavy)
    for c in ("_clean", "_clean_markdown"):
        held = held.withColumn(c, F.when(F.col("_heavy"), md.strip_links(F.col(c))).otherwise(F.col(c)))
    out = held.withColumn("content", _sanitized(F.col("_clean"), most)).withColumn("markdown", _sanitized(F.nullif("_clean_markdown", F.lit("")), most))
    return out.drop("_read", "_content", "_markdown", "_first", "_clean", "_clean_markdown", "_heavy")


def crawl_urls(
    requests: DataFrame, answers: DataFrame, robots: DataFrame | None = None, dns: DataFrame | None = None, cache: DataFrame | None = None, as_of: Column | None = None, form: str = "markdown", strip: bool = False, ttl: int = 86400, agent: str = "LodestoneBot"
) -> DataFrame:
    """url, content, markdown, title, success, partial, source and status of each request (url).

    answers: captured attempts (url, attempt, status, body); cache: (url, content, partial, stored_at). status says
    what decided: skipped, unsafe, robots, cache, crawl, empty (an answer without content) or failed (no answer).
    """
    held = with_safety(requests.select("url"), dns).withColumn("_domain", F.lower(urls.part(F.col("url"), 2)))
    if robots is not None:
        allowed = links.robots_allowed(held.select(F.col("_domain").alias("domain"), "url").distinct(), robots, agent).select("url", "allowed")
        held = held.join(allowed, "url", "left")
    else:
        held = held.withColumn("allowed", F.lit(True))
    if cache is not None:
        rows = cache.select("url", F.col("content").alias("_kept"), F.col("partial").alias("_kept_partial"), "stored_at")
        held = store.lookup(held, rows, "url", ttl, F.current_timestamp() if as_of is None else as_of)
    else:
        held = held.withColumn("hit", F.lit(False)).withColumn("_kept", F.lit(None).cast("string")).withColumn("_kept_partial", F.lit(None).cast("boolean"))
    gate = F.when(urls.skipped(F.col("url")), "skipped").when(~F.col("safe"), "unsafe").when(~F.coalesce("allowed", F.lit(True)), "robots").when(F.col("hit"), "cache")
    held = held.withColumn("status", gate)
    asked = held.filter("status IS NULL").select("url").distinct()
    got = store.first_answer(answers.join(asked, "url", "left_semi"), "url").select("url", payload.extract(F.col("body")).alias("found"))
    got = cleaned(got, strip).select("url", "content", "markdown", "title", F.col("found.partial").alias("partial"), F.lit(True).alias("_answered"))
    held = held.join(got, "url", "left")
    held = held.withColumn("status", F.coalesce("status", F.when(F.col("_answered") & F.col("content").isNotNull(), "crawl").when(F.col("_answered"), "empty").otherwise("failed")))
    crawled, cached = F.col("status") == "crawl", F.col("status") == "cache"
    return held.select(
        "url", F.when(crawled, payload.select_format(F.col("content"), F.col("markdown"), F.lit(None).cast("string"), F.lit(form))).when(cached, F.col("_kept")).alias("content"), F.when(crawled, F.col("markdown")).alias("markdown"),
        F.when(crawled | (F.col("status") == "empty"), F.col("title")).alias("title"), (crawled | (cached & F.col("_kept").isNotNull())).alias("success"),
        F.when(crawled, F.col("partial")).when(cached, F.col("_kept_partial")).otherwise(F.lit(True)).alias("partial"), F.when(cached, "cache").otherwise("crawl").alias("source"), "status",
    )


def to_cache(crawled: DataFrame, as_of: Column) -> DataFrame:
    """(url, content, partial, stored_at) that a crawl adds to the cache: what was answered, and that nothing was."""
    return crawled.filter(F.col("status").isin("crawl", "empty", "failed")).select("url", "content", F.when(F.col("status") == "crawl", F.col("partial")).otherwise(F.lit(True)).alias("partial"), as_of.alias("stored_at"))


def fetch_content(requests: DataFrame, pages: DataFrame, dns: DataFrame | None = None, cooling: DataFrame | None = None, cache: DataFrame | None = None, as_of: Column | None = None, cooldown: int = 300, ttl: int = 86400) -> DataFrame:
    """url, content, partial and status of each request (url): its domain cools, it is unsafe, it is cached; else readable content over 100 characters, else the page's plain text over 100, else it failed.

    pages: (url, html); cooling: (domain, stored_at); cache: (url, content, partial, stored_at).
    """
    now = F.current_timestamp() if as_of is None else as_of
    held = with_safety(requests.select("url"), dns).withColumn("_domain", urls.domain(F.col("url")))
    if cooling is not None:
        cool = store.fresh(cooling, cooldown, now).select(F.col("domain").alias("_domain"), F.lit(True).alias("_cool")).distinct()
        held = held.join(cool, "_domain", "left")
    else:
        held = held.withColumn("_cool", F.lit(False))
    if cache is not None:
        held = store.lookup(held, cache.select("url", F.col("content").alias("_kept"), F.col("partial").alias("_kept_partial"), "stored_at"), "url", ttl, now)
    else:
        held = held.withColumn("hit", F.lit(False)).withColumn("_kept", F.lit(None).cast("string")).withColumn("_kept_partial", F.lit(None).cast("boolean"))
    held = held.withColumn("status", F.when(F.col("_cool"), "cooling").when(~F.col("safe"), "unsafe").when(F.col("hit"), "cache"))
    got = pages.join(held.filter("status IS NULL").select("url").distinct(), "url", "left_semi").groupBy("url").agg(F.first("html").alias("html"))
    got = got.withColumn("_read", html.main("html")["markdown"]).withColumn("_plain", text.plain_fallback(F.col("html")))
    long = lambda c: F.when(F.length(F.trim(c)) > 100, F.col(c))
    got = got.select("url", F.coalesce(long("_read"), "_plain").alias("_found"), long("_read").isNull().alias("_part"))
    held = held.join(got, "url", "left")
    held = held.withColumn("status", F.coalesce("status", F.when(F.col("_found").isNull(), "failed").otherwise("fetch")))
    fetched, cached = F.col("status") == "fetch", F.col("status") == "cache"
    content = F.when(fetched, text.sanitize(F.col("_found"), FETCH_MOST)).when(cached, F.col("_kept"))
    return held.select("url", content.alias("content"), F.when(fetched, F.col("_part")).when(cached, F.col("_kept_partial")).otherwise(F.lit(True)).alias("partial"), "status")


def newly_cooling(fetched: DataFrame, as_of: Column) -> DataFrame:
    """(domain, stored_at) of the domains that a fetch failed on."""
    return fetched.filter("status = 'failed'").select(urls.domain(F.col("url")).alias("domain"), as_of.alias("stored_at")).distinct()
