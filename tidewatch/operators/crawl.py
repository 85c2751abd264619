"""Traversal of the link graph, a level at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, START_HINTS, START_PATHS, WatchConfig
from ..functions.text import anchor_is_ignored, looks_like_sitemap, sitemap_locs, sitemaps_in_robots
from ..functions.urls import base_domain, build, canonical_url, is_attachment, netloc, normalize_url, path, resolve, same_base_domain, scheme, www_variants
from ..session import written


def reach(edges: DataFrame, roots: DataFrame, depth: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., node, depth): nodes reachable from the roots with the smallest number of steps, at most `depth`. Cycles are fine: each level
    drops what was visited. edges: by..., src, dst; roots: by..., node."""
    keys = [*by, "node"]
    level = visited = written(roots.select(*keys).distinct().withColumn("depth", F.lit(0)))
    step = 0
    while depth is None or step < depth:
        step += 1
        found = level.join(edges.withColumnRenamed("src", "node"), keys).select(*by, F.col("dst").alias("node")).distinct()
        level = written(found.join(visited, keys, "left_anti").withColumn("depth", F.lit(step)))
        if level.isEmpty():
            break
        visited = visited.unionByName(level)
    return visited


def site_links(links: DataFrame, sites: DataFrame) -> DataFrame:
    """(site_key, src, dst): canonical ends of links (base, url) between pages of the base domain of a site's host. sites: site_key, host."""
    rows = links.select(canonical_url("base").alias("src"), canonical_url("url").alias("dst")).withColumn("__d", base_domain(netloc("src")))
    own = sites.select("site_key", base_domain("host").alias("__d")).distinct()
    return rows.where(base_domain(netloc("dst")) == F.col("__d")).join(own, "__d").select("site_key", "src", "dst").distinct()


def crawl(links: DataFrame, queue: DataFrame, config: WatchConfig = DEFAULT) -> DataFrame:
    """Second phase: site_key, url and depth of what is visited, following the links (site_key, src, dst) of all pages from the queue."""
    return reach(links, queue.select("site_key", F.col("url").alias("node")), config.depth, ("site_key",)).withColumnRenamed("node", "url")


def discover(links: DataFrame, starts: DataFrame, config: WatchConfig = DEFAULT) -> DataFrame:
    """First phase: (site_key, url, depth, ordinal, fetched) in the order of a first-in-first-out queue. Links (base, url, anchor, pos) to the
    start's base domain are followed unless they are attachments or their anchor says nothing; the first `discovery_pages` addresses of a site
    are fetched, what they name is found. starts: site_key, url (after redirects)."""
    named = links.where(~is_attachment("url") & ~anchor_is_ignored("anchor")).select(F.col("base").alias("src"), F.col("url").alias("dst"), "pos")
    first = starts.select("site_key", normalize_url("url").alias("url"), F.lit(0).alias("depth"), F.lit(1).cast("long").alias("ordinal"), netloc("url").alias("host"))
    level = found = written(first.dropDuplicates(["site_key"]))
    step, turn = 0, Window.partitionBy("site_key").orderBy("parent", "pos", "url")
    while True:
        step += 1
        pages = level.where(F.col("ordinal") <= config.discovery_pages)
        near = pages.join(named, pages["url"] == named["src"]).where(same_base_domain(netloc("dst"), "host"))
        near = near.groupBy("site_key", "host", F.col("dst").alias("url")).agg(F.min(F.struct(F.col("ordinal").alias("parent"), "pos")).alias("at")).select("site_key", "host", "url", "at.*")
        near = near.join(found.select("site_key", "url"), ["site_key", "url"], "left_anti").join(found.groupBy("site_key").agg(F.max("ordinal").alias("last")), "site_key")
        level = written(near.select("site_key", "url", F.lit(step).alias("depth"), (F.col("last") + F.row_number().over(turn)).alias("ordinal"), "host"))
        if level.isEmpty():
            break
        found = found.unionByName(level)
    return found.select("site_key", "url", "depth", "ordinal", (F.col("ordinal") <= config.discovery_pages).alias("fetched"))


def seeds(found: DataFrame, config: WatchConfig = DEFAULT) -> DataFrame:
    """(site_key, url, pos): what discovery found beside the start, the first `seeds` of a site."""
    return found.where((F.col("ordinal") > 1) & (F.col("ordinal") <= config.seeds + 1)).select("site_key", "url", (F.col("ordinal") - 2).alias("pos"))


def start_candidates(sites: DataFrame, tries: int | None = DEFAULT.start_tries) -> DataFrame:
    """(site columns, candidate, ordinal): scheme x host x path, with and without trailing slash, then hints; first of each, in order."""
    u = F.trim(F.col("url"))
    u = normalize_url(F.when(u.rlike(r"^[a-zA-Z]+://"), u).otherwise(F.concat(F.lit("https://"), u)))
    first = F.when(path(u) == "", F.lit("/")).otherwise(path(u))
    schemes = F.array_distinct(F.array(scheme(u), F.lit("https"), F.lit("http")))
    paths = F.concat(F.array(first), F.array(*map(F.lit, START_PATHS)))
    slashed = F.flatten(F.transform(paths, lambda p: F.when(F.endswith(p, F.lit("/")), F.array(p)).otherwise(F.array(p, F.concat(p, F.lit("/"))))))
    every = F.concat(slashed, F.array(*map(F.lit, START_HINTS)))
    urls = F.flatten(F.transform(schemes, lambda s: F.flatten(F.transform(www_variants(netloc(u)), lambda h: F.transform(every, lambda p: build(s, h, p, F.lit("")))))))
    urls = F.array_distinct(urls)
    return sites.select("*", F.posexplode(F.slice(urls, 1, tries) if tries else urls).alias("ordinal", "candidate"))


def first_success(attempts: DataFrame, by: list[str], order: str = "ordinal") -> DataFrame:
    """Of each group the first attempt with status 200 that looks like HTML, else the last attempt. attempts: status, html BOOLEAN."""
    ok = (F.col("status") == 200) & F.col("html")
    row = F.struct(*attempts.columns)
    best = F.coalesce(F.min_by(F.when(ok, row), F.when(ok, F.col(order))), F.max_by(row, order))
    return attempts.groupBy(*by).agg(best.alias("r")).select("r.*")


def best_effort_text(responses: DataFrame) -> DataFrame:
    """(url, body, ctype) of the responses that brought a text: a status from 200 to 399 and a body."""
    return responses.where(F.col("status").between(200, 399) & (F.coalesce("body", F.lit("")) != "")).select("url", "body", "ctype")


def sitemap_urls(responses: DataFrame, roots: DataFrame, fetches: int = 40, children: int = 200, most: int = DEFAULT.sitemap_urls) -> DataFrame:
    """(site_key, url, ordinal): addresses from robots and nested sitemaps of any depth, normalised, the first of each canonical form.
    responses: url, body, and status and ctype where they are known; roots: site_key, base. Sitemaps are fetched first in, first out, each
    address once, at most `fetches` a site; those without a response count."""
    known = responses if "ctype" in responses.columns else responses.withColumn("ctype", F.lit(None).cast("string"))
    known = best_effort_text(known) if "status" in known.columns else known
    known = known.select(normalize_url("url").alias("url"), "body", "ctype")
    robots = roots.join(known.select(F.col("url").alias("__r"), "body"), normalize_url(resolve("base", F.lit("/robots.txt"))) == F.col("__r"), "left")
    defaults = F.array(*[normalize_url(resolve("base", F.lit(p))) for p in ("/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml")])
    level = robots.select("site_key", F.lit(0).alias("step"), F.lit(0).alias("parent"), F.posexplode(F.array_distinct(F.concat(sitemaps_in_robots("body"), defaults))).alias("pos", "node"))
    bodies = known.where(looks_like_sitemap("body", "ctype")).select(F.col("url").alias("node"), "body")
    turn, queue, step = Window.partitionBy("site_key").orderBy("step", "parent", "pos", "node"), None, 0
    while True:
        queue = level if queue is None else queue.drop("n").unionByName(level)
        once = queue.groupBy("site_key", F.coalesce(canonical_url("node"), "node").alias("same")).agg(F.min(F.struct("step", "parent", "pos", "node")).alias("q"))
        queue = written(once.select("site_key", "q.*").withColumn("n", F.row_number().over(turn)).where(F.col("n") <= fetches))
        latest = queue.where(F.col("step") == step)
        if latest.isEmpty():
            break
        step += 1
        level = latest.join(bodies, "node").select("site_key", F.lit(step).alias("step"), F.col("n").alias("parent"), F.posexplode(F.slice(sitemap_locs("body", "sitemap"), 1, children)).alias("pos", "node"))
    found = queue.join(bodies, "node").select("site_key", "n", F.posexplode(sitemap_locs("body", "url")).alias("i", "url"))
    first = found.groupBy("site_key", canonical_url("url").alias("same")).agg(F.min(F.struct("n", "i", "url")).alias("at"))
    order = Window.partitionBy("site_key").orderBy("at")
    return first.withColumn("ordinal", F.row_number().over(order)).where(F.col("ordinal") <= most).select("site_key", "at.url", "ordinal")
