"""Links, URL maps and breadth-first traversal over captured pages."""

from __future__ import annotations

from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..sources.shared import scratch


def links(pages: DataFrame, root: bool = False) -> DataFrame:
    """(page_id, pos, src, href, url): every followable link of a page, absolute. root: relative to the site's root, not the page."""
    pattern = r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    whole = F.regexp_extract_all("html", F.lit(pattern), F.lit(0))
    href = F.coalesce(*[F.nullif(F.regexp_extract("tag", pattern, k), F.lit("")) for k in (1, 2, 3)], F.lit(""))
    found = pages.select("page_id", F.col("url").alias("src"), F.posexplode(whole).alias("pos", "tag")).withColumn("href", F.trim(href)).drop("tag")
    found = found.filter((F.col("href") != "") & ~F.col("href").startswith("#") & ~F.lower("href").rlike("^(javascript|mailto|tel):"))
    return found.withColumn("url", urls.absolute(F.col("href"), F.concat(urls.site(F.col("src")), F.lit("/")) if root else F.col("src")))


def same_domain(rows: DataFrame, domain: str = "domain") -> DataFrame:
    """Rows whose url has just the domain (port and www count)."""
    return rows.filter(urls.part(F.col("url"), 2).eqNullSafe(F.col(domain)))


def url_map(sitemap: DataFrame, linked: DataFrame) -> DataFrame:
    """(domain, url, pos, origin): both lists' urls once, sitemap first, in order of appearance. Inputs are (domain, url, pos)."""
    both = sitemap.withColumn("part", F.lit(0)).unionByName(linked.withColumn("part", F.lit(1)))
    return both.groupBy("domain", "url").agg(F.min(F.struct("part", "pos")).alias("first")).select("domain", "url", F.col("first.pos").alias("pos"), F.when(F.col("first.part") == 0, "sitemap").otherwise("links").alias("origin"))


def matching(df: DataFrame, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """Rows whose url matches an include pattern (all, if there is none) and no exclude pattern."""
    if include:
        df = df.filter(F.col("url").rlike("|".join(f"(?:{urls.glob(p)})" for p in include)))
    return df.filter(~F.col("url").rlike("|".join(f"(?:{urls.glob(p)})" for p in exclude))) if exclude else df


def map_sites(sites: DataFrame, sitemaps: DataFrame, pages: DataFrame, robots: DataFrame | None = None, dns: DataFrame | None = None, include: list[str] = (), agent: str = "LodestoneBot", depth: int = 3) -> DataFrame:
    """(domain, url, pos, origin) of each site (url): its sitemap's urls to the depth of indexes, then its page's links, of its own domain, safe, allowed and included, each once.

    sitemaps: (url, xml); pages: (url, html) of the sites; robots: (domain, robots_txt), all allowed without; dns as fetch.with_safety().
    """
    from ..sources.tables import sitemap_lists
    from .fetch import with_safety

    held = sites.select("url", urls.part(F.col("url"), 2).alias("domain"), urls.site(F.col("url")).alias("site")).distinct()
    roots = held.select("domain", F.concat("site", F.lit("/sitemap.xml")).alias("root")).distinct()
    listed = same_domain(sitemap_lists(roots, sitemaps, depth)).select("domain", "url", "pos")
    found = pages.join(held.select("url", "domain"), "url").select(F.xxhash64("url").alias("page_id"), "url", "html", "domain")
    linked = links(found, root=True).join(found.select("page_id", "domain").distinct(), "page_id")
    linked = same_domain(linked).select("domain", "url", F.col("pos").cast("long").alias("pos"))
    out = with_safety(matching(url_map(listed, linked), include), dns).filter("safe").drop("safe")
    if robots is not None:
        allowed = robots_allowed(out.select("domain", "url"), robots, agent).filter("allowed").select("domain", "url").distinct()
        out = out.join(allowed, ["domain", "url"], "left_semi")
    return out


def crawl_sites(
    seeds: DataFrame, pages: DataFrame, max_depth: int = 3, max_pages: int = 100, include: list[str] = (), exclude: list[str] = (), fail_limit: int = 3, robots: DataFrame | None = None, dns: DataFrame | None = None, agent: str = "LodestoneBot"
) -> DataFrame:
    """(job, url, depth, place, success, title) of breadth-first crawls, in the order of visits.

    seeds: (job, pos, url); pages: (url, html), a visit to any other url fails. A domain is left once fail_limit visits
    in a row have failed there; a job ends after max_pages visits. Only links of pages that were visited are followed.
    Each depth is one join and one written table; a job's frontier is cut to the visits that it has left.
    """
    from ..functions import text
    from .fetch import with_safety

    known = pages.groupBy("url").agg(F.first("html").alias("html"))
    domain = F.lower(urls.part(F.col("url"), 2))
    spent = None  # (job, domain, run, left): failures in a row so far, and whether the domain is left
    done = None
    frontier = matching(seeds.select("job", "pos", "url"), include, exclude)
    for depth in range(max_depth + 1):
        first = frontier.groupBy("job", "url").agg(F.min("pos").alias("pos"))
        if done is not None:
            first = first.join(done.select("job", "url"), ["job", "url"], "left_anti")
        ask = with_safety(first, dns).filter("safe").drop("safe").withColumn("domain", domain)
        if robots is not None:
            allowed = robots_allowed(ask.select("domain", "url").distinct(), robots, agent).filter("allowed").select("url").distinct()
            ask = ask.join(allowed, "url", "left_semi")
        ask = ask.join(known.select("url", F.lit(True).alias("success"), text.page_title(F.col("html")).alias("title")), "url", "left").withColumn("success", F.coalesce("success", F.lit(False)))
        ask = ask.join(spent, ["job", "domain"], "left") if spent is not None else ask.withColumn("run", F.lit(0)).withColumn("left", F.lit(False))
        ask = ask.filter(~F.coalesce("left", F.lit(False))).withColumn("carried", F.coalesce("run", F.lit(0)))
        w = Window.partitionBy("job", "domain").orderBy("pos", "url")
        ask = ask.withColumn("island", F.sum(F.col("success").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        within = F.row_number().over(Window.partitionBy("job", "domain", "island").orderBy("pos", "url")) - F.when(F.col("island") > 0, 1).otherwise(0)
        ask = ask.withColumn("now", F.when(F.col("success"), 0).otherwise(within + F.when(F.col("island") == 0, F.col("carried")).otherwise(0)))
        ended = F.min(F.when(F.col("now") >= fail_limit, F.struct("pos", "url"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
        ask = ask.withColumn("gone", ended.isNotNull()).filter("NOT gone")
        used = F.lit(0) if done is None else F.coalesce("used", F.lit(0))
        if done is not None:
            ask = ask.join(done.groupBy("job").agg(F.count(F.lit(1)).cast("int").alias("used")), "job", "left")
        order = Window.partitionBy("job").orderBy("pos", "url")
        ask = ask.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= max_pages).filter(F.col("nth") + used <= max_pages).withColumn("place", (F.col("nth") + used - 1).cast("int"))
        visited = scratch(ask.select("job", "url", F.lit(depth).alias("depth"), "place", "success", "title", "domain", "pos", "now"), "visits")
        if visited.isEmpty():
            break
        last = visited.groupBy("job", "domain").agg(F.max_by("now", F.struct("pos", "url")).alias("run"), (F.max("now") >= fail_limit).alias("left"))
        if spent is not None:
            last = last.unionByName(spent.join(last.select("job", "domain"), ["job", "domain"], "left_anti"))
        spent = scratch(last, "domains")
        done = visited if done is None else done.unionByName(visited)
        if depth == max_depth:
            break
        opened = visited.filter("success").select("job", "place", "url").join(known, "url")
        next_ = links(opened.select(F.struct("job", "place").alias("page_id"), "url", "html"))
        next_ = next_.select(F.col("page_id.job").alias("job"), F.struct(F.col("page_id.place"), "pos").alias("at"), "url")
        frontier = matching(next_.groupBy("job", "url").agg(F.min("at").alias("at")), include, exclude).select("job", (F.col("at.place").cast("long") * 1_000_000 + F.col("at.pos")).alias("pos"), "url")
    if done is None:
        return seeds.sparkSession.createDataFrame([], "job string, url string, depth int, place int, success boolean, title string")
    return done.select("job", "url", "depth", "place", "success", "title")


def progress(visits: DataFrame, key: str = "job") -> DataFrame:
    """(key, discovered, crawled, failed) of visits."""
    return visits.groupBy(key).agg(F.count(F.lit(1)).alias("discovered"), F.count_if("success").alias("crawled"), F.count_if(~F.col("success")).alias("failed"))


def traverse(seeds: DataFrame, edges: DataFrame, max_depth: int, max_pages: int | None = None) -> DataFrame:
    """(url, depth): breadth-first over (src, dst), each url at its smallest depth; at most max_pages by depth, then url.

    One join for each depth; what was visited is a written table, so that a lost executor repeats one step at most.
    """
    frontier = scratch(seeds.select("url").distinct().withColumn("depth", F.lit(0)), "frontier")
    seen = frontier
    for depth in range(1, max_depth + 1):
        reached = edges.join(frontier, edges["src"] == frontier["url"]).select(F.col("dst").alias("url")).distinct().join(seen, "url", "left_anti")
        frontier = scratch(reached.withColumn("depth", F.lit(depth)), "frontier")
        seen = seen.union(frontier)
        if frontier.isEmpty():
            break
    return seen.orderBy("depth", "url").limit(max_pages) if max_pages else seen


def robots_allowed(rows: DataFrame, robots: DataFrame, agent: str = "LodestoneBot") -> DataFrame:
    """(domain, url, allowed) for urls under robots texts (domain, robots_txt); domains without one allow all."""

    @F.pandas_udf("boolean")
    def allowed(text: pd.Series, url: pd.Series) -> pd.Series:
        parsed: dict[str, RobotFileParser] = {}
        out = []
        for t, u in zip(text, url):
            if t is None:
                out.append(True)
                continue
            if t not in parsed:
                parsed[t] = RobotFileParser()
                parsed[t].parse(t.splitlines())
            out.append(parsed[t].can_fetch(agent, u))
        return pd.Series(out)

    return rows.join(robots, "domain", "left").withColumn("allowed", allowed("robots_txt", "url")).drop("robots_txt")


def failure_runs(outcomes: DataFrame, key: str, order: list[str], least: int) -> DataFrame:
    """(key, length, first order columns) of runs of `least` or more failures (column failed); a success ends a run."""
    w = Window.partitionBy(key).orderBy(*order)
    held = outcomes.withColumn("island", F.sum((~F.col("failed")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("failed")
    return held.groupBy(key, "island").agg(F.count(F.lit(1)).alias("length"), F.min(F.struct(*order)).alias("first")).filter(F.col("length") >= least).select(key, "length", "first.*")
