"""Link hits, reports and seed scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, SCRIPTED_SEEDS, SEED_HINTS, WatchConfig
from ..functions.html import anchors, is_scripted
from ..functions.text import keyword, link_blob, link_is_generic
from ..functions.urls import any_of, canonical_url, col, is_attachment, is_valid_url, netloc, normalize_url, resolve, scheme, sha1_key, should_skip_href


def first_by(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key: what dropDuplicates can't promise."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, base, url, anchor, pos): the links of each page, skipped ones left out, the first of each URL. Anchors are taken once by a
    generator; what follows runs on plain columns."""
    found = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("base"), F.posexplode(anchors(html_col)).alias("pos", "a"))
    rows = found.select("page_id", "base", "pos", "a.anchor", resolve("base", F.col("a.href")).alias("href"))
    rows = rows.withColumn("url", normalize_url("href")).where(is_valid_url("url"))
    rows = rows.where(is_attachment("url") | ~should_skip_href("url"))
    return first_by(rows, ["page_id", "url"], ["pos"]).select("page_id", "base", "url", "anchor", "pos")


def link_hits(links: DataFrame, state: DataFrame, dead: DataFrame | None = None, config: WatchConfig = DEFAULT, order: tuple[str, ...] = ("page_id", "pos")) -> DataFrame:
    """Links (url, anchor, and the order columns) whose anchor or file name holds a keyword, to addresses unknown so far: first link of each."""
    rows = links.withColumn("keyword", keyword(link_blob("anchor", "url"), config.keywords, config.strict))
    rows = rows.where(F.col("keyword").isNotNull() & ~link_is_generic("anchor")).withColumn("url", canonical_url("url")).withColumn("url_key", sha1_key("url"))
    if dead is not None:
        rows = rows.join(dead.select(canonical_url("url").alias("url")).distinct(), "url", "left_anti")
    rows = rows.join(state.select("url_key"), "url_key", "left_anti")
    return first_by(rows, ["url_key"], list(order)).withColumn("status", F.lit("NOWE"))


def report(hits: DataFrame, order: list) -> DataFrame:
    """NOWE and ZMIANA rows, each URL once in a run."""
    return first_by(hits.where(F.col("status").isin("NOWE", "ZMIANA")), ["url"], order)


def seed_score(url, hints=SEED_HINTS) -> Column:
    return F.when(any_of(F.lower(col(url)), hints), F.lit(18)).otherwise(F.lit(10))


def scripted_seeds(starts: DataFrame, paths: tuple[str, ...] = SCRIPTED_SEEDS) -> DataFrame:
    """(site_key, url, score): the extra seeds of sites whose start page is made by scripts. starts: site_key, url (after redirects), html."""
    urls = F.array(*[normalize_url(F.concat(scheme("url"), F.lit("://"), netloc("url"), F.lit(p))) for p in paths])
    return starts.where(is_scripted("html")).select("site_key", F.explode(urls).alias("url"), F.lit(20).alias("score")).distinct()


def seed_scores(urls: DataFrame, scripted: DataFrame | None = None) -> DataFrame:
    """The best score of each address, those of scripted_seeds included."""
    rows = urls.select("url", seed_score("url").alias("score"))
    rows = rows if scripted is None else rows.unionByName(scripted.select("url", "score"))
    return rows.groupBy("url").agg(F.max("score").alias("score"))
