"""Relations that the engine works on, from captured tables; nothing is fetched."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, urls
from .shared import numbered, scratch

RESULT = "title string, url string, content string, snippet string, engine string, engines array<string>, score double, publishedDate string, category string, rank int, query_id int, page int"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def results_json(spark: SparkSession, path: str) -> DataFrame:
    """Captured search results; unreadable lines give null rows, unknown fields are left out."""
    return spark.read.schema(RESULT).option("mode", "PERMISSIVE").json(path)


def patterns(spark: SparkSession, path: str, default: list[str]) -> list[str]:
    """Regular expressions from a text file: no comments or blanks, none over 500 characters or invalid; the defaults if none is left."""
    import re

    found = []
    for r in spark.read.text(path).filter(~F.trim("value").startswith("#") & (F.trim("value") != "") & (F.length(F.trim("value")) <= 500)).collect():
        try:
            re.compile(r[0].strip())
            found.append(r[0].strip())
        except re.error:
            continue
    return found or default


def search_results(pages: DataFrame) -> DataFrame:
    """Pages as ranked results: title, canonical url, snippet, engines by number of the page, and a date before AS_OF."""
    held = pages.select(
        F.col("page_id").alias("rank"), F.col("url").alias("original_url"), urls.normalize(F.col("url")).alias("url"), text.page_title(F.col("html")).alias("title"),
        text.truncate(text.page_text(F.col("html")), 500).alias("snippet"), F.slice(F.array(F.lit("alpha"), F.lit("beta"), F.lit("gamma")), 1, F.pmod("page_id", F.lit(3)).cast("int") + 1).alias("engines"),
        (F.lit("2024-02-01").cast("timestamp") - F.make_dt_interval(F.pmod("page_id", F.lit(90)).cast("int"))).alias("parsed_date"),
    )
    return held.filter("title <> ''")


def sitemap_urls(xml: DataFrame) -> DataFrame:
    """(domain, pos, url, is_index) of sitemap and sitemap-index documents (domain, xml)."""
    loc = lambda path: F.xpath("xml", F.lit(f"//*[local-name()='{path}']/*[local-name()='loc']/text()"))
    both = F.array(F.struct(F.lit(False).alias("is_index"), loc("url").alias("locs")), F.struct(F.lit(True).alias("is_index"), loc("sitemap").alias("locs")))
    return xml.select("domain", F.explode(both).alias("s")).select("domain", "s.is_index", F.posexplode("s.locs").alias("pos", "url")).withColumn("url", F.trim("url"))


def sitemap_lists(roots: DataFrame, sitemaps: DataFrame, depth: int = 3) -> DataFrame:
    """(domain, url, pos) of all pages from root sitemaps (domain, root) through indexes to the depth given, each index once for a domain; sitemaps: (url, xml).

    pos puts them in the order of depth, then of the path through the indexes.
    """
    found, seen = None, roots.select("domain", F.col("root").alias("url")).distinct()
    frontier = seen.withColumn("pos", F.lit(""))
    held = sitemaps.select(F.col("url").alias("domain"), "xml")
    step = F.lpad(F.col("p").cast("string"), 7, "0")
    for level in range(depth + 1):
        at = frontier.select(F.col("domain").alias("of"), F.col("url").alias("domain"), F.col("pos").alias("before"))
        listed = sitemap_urls(held.join(frontier.select(F.col("url").alias("domain")).distinct(), "domain", "left_semi")).withColumnRenamed("pos", "p")
        got = scratch(listed.join(at, "domain").select(F.col("of").alias("domain"), "url", "is_index", F.concat("before", step).alias("pos")), "sitemaps")
        pages = got.filter("NOT is_index").select("domain", "url", F.concat(F.lit(str(level)), "pos").alias("pos"))
        found = pages if found is None else found.union(pages)
        frontier = got.filter("is_index").groupBy("domain", "url").agg(F.min("pos").alias("pos")).join(seen, ["domain", "url"], "left_anti")
        frontier = scratch(frontier, "indexes")
        seen = seen.union(frontier.select("domain", "url"))
        if frontier.isEmpty():
            break
    first = found.groupBy("domain", "url").agg(F.min("pos").alias("at"))
    return numbered(first, ["domain"], ["at", "url"], "pos").select("domain", "url", "pos")


def sitemap_tree(roots: DataFrame, xml: DataFrame, depth: int = 3) -> DataFrame:
    """(url) of all pages from root sitemaps (url) through indexes to the depth given; xml: (domain, xml), the domain being the sitemap's url."""
    listed = sitemap_lists(roots.select(F.lit("").alias("domain"), F.col("url").alias("root")), xml.select(F.col("domain").alias("url"), "xml"), depth)
    return listed.select("url").distinct()
