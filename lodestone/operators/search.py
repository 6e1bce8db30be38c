"""A search from captured results to the answer: normalise, merge, gate, rank, cut, sanitise, project."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, text, urls
from . import ranking


def second_page(results: DataFrame, key: str, least: int) -> DataFrame:
    """All rows of page 1, and those of page 2 only where the key has fewer than `least` on page 1. Columns page and key.

    The keys' counts are aggregated before they meet the rows.
    """
    short = results.groupBy(key).agg(F.count_if(F.col("page") == 1).alias("_n")).filter(F.col("_n") < least).select(F.col(key).alias("_key"), F.lit(True).alias("_short"))
    met = results.join(short, F.col(key).eqNullSafe(F.col("_key")), "left")
    return met.filter("page = 1 OR (page = 2 AND _short)").select(*results.columns)


def normalize_results(raw: DataFrame) -> DataFrame:
    """title, url (canonical), original_url, snippet, source, engines, score, parsed_date and category of raw results, with defaults; other columns stay.

    Rows without a title go. A missing url is '/', a missing list of engines is empty.
    """
    empty = F.lit("")
    own = {
        "title": F.trim(F.coalesce("title", empty)), "original_url": F.coalesce("url", empty), "snippet": F.trim(F.coalesce(F.nullif("content", empty), F.col("snippet"), empty)), "source": F.coalesce("engine", F.lit("unknown")),
        "engines": F.coalesce("engines", F.array().cast("array<string>")), "score": F.coalesce("score", F.lit(0.0)), "parsed_date": dates.parse_date(F.col("publishedDate")), "category": F.coalesce("category", F.lit("general")),
        "url": urls.normalize(F.coalesce("url", empty)),
    }
    return raw.withColumns(own).drop("content", "engine", "publishedDate").filter("title <> ''")


def search(raw: DataFrame, asked: DataFrame, as_of: str, k: int = 10, lang: str = "en", freshness: str = "any", fuzzy: bool = True, most: int = 500) -> DataFrame:
    """query_id, place, title, url (as captured), snippet, score, source and content_partial of the k best results of each query.

    raw: captured results with query_id, rank and page; asked: (query_id, q), a row for each query. Results of one
    query (a few pages of a search) are few; fuzzy merging gathers them.
    """
    rows = normalize_results(second_page(raw, "query_id", k))
    merged = ranking.merge_fuzzy(rows) if fuzzy else ranking.merge_exact(rows, ["query_id", "url"])
    ranked = ranking.rank(ranking.gate(merged.join(asked, "query_id"), lang), as_of, lang, freshness, k)
    snippet = text.sanitize(F.col("snippet"), most)
    return ranked.select("query_id", "place", "title", F.coalesce("original_url", "url").alias("url"), snippet.alias("snippet"), "score", "source", F.lit(False).alias("content_partial"))


def enrich(results: DataFrame, crawled: DataFrame, fetched: DataFrame, on: tuple[str, ...] = ("url",)) -> DataFrame:
    """The results with content and content_partial: of the crawl (url, content, partial), else of the fetch, else none.

    on: the columns by which captures belong to results. Each result stays one row: of several captures the best
    counts, which has content, is not partial, and stands first in order of content.
    """
    empty = F.lit("")

    def best(captured: DataFrame, name: str) -> DataFrame:
        content = F.nullif("content", empty)
        one = captured.groupBy(*on).agg(F.min(F.struct(content.isNull().alias("none"), "partial", content.alias("content"))).alias("_best"))
        return one.select(*on, F.col("_best.content").alias(name), F.col("_best.partial").alias(f"{name}_partial"))

    out = results.drop("content", "content_partial").join(best(crawled, "_crawl"), list(on), "left").join(best(fetched, "_fetch"), list(on), "left")
    partial = F.when(F.col("_crawl").isNotNull(), F.col("_crawl_partial")).otherwise(F.coalesce("_fetch_partial", F.lit(True)))
    return out.withColumn("content", F.coalesce("_crawl", "_fetch")).withColumn("content_partial", partial).drop("_crawl", "_crawl_partial", "_fetch", "_fetch_partial")


def first_per_domain(rows: DataFrame, order: list[str], url: str = "url") -> DataFrame:
    """Adds `domain`, and `first`: whether the row is its domain's first in the order (of rows equal in it, all)."""
    held = rows.withColumn("domain", urls.domain(F.col(url)))
    least = held.groupBy("domain").agg(F.min(F.struct(*order)).alias("_first"))
    return held.join(least, "domain").withColumn("first", F.struct(*order) == F.col("_first")).drop("_first")


def related(rows: DataFrame, mapped: DataFrame, order: list[str]) -> DataFrame:
    """The rows with relatedUrls, a domain's urls (mapped: domain, pos, url) at the first row of the domain alone."""
    lists = mapped.groupBy("domain").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "url"))), lambda x: x["url"]).alias("_urls"))
    held = first_per_domain(rows, order).join(lists, "domain", "left")
    return held.withColumn("relatedUrls", F.when(F.col("first"), F.col("_urls"))).drop("_urls", "first", "domain")


def numbered_within(rows: DataFrame, key: str, order: list, k: int) -> DataFrame:
    """The first k rows of each key, with their place from 1; a task keeps no more than k of a key before they meet."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)
