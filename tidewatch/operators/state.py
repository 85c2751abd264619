"""Remembered state: lookups, status classification, transitions, merge, purge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, WatchConfig
from ..functions.ttl import checked_at, must_fetch, parse_time, still_seen
from ..functions.urls import canonical_url, col, is_first_phase_listing, url_key

STATE = "url_key string, found_at string, last_checked string, etag string, last_modified string, gmina string, title string, url string, keywords array<string>, att_sig string, status string"
FIELDS = [x.split()[0] for x in STATE.split(", ")]


def lookup(candidates: DataFrame, state: DataFrame, key: str = "url_key", final_key: str | None = None) -> DataFrame:
    """candidates with a struct `prev`: the state of the final key, else of the key; null if neither is known."""
    prev = state.select(F.col("url_key").alias("__k"), F.struct(*[c for c in state.columns]).alias("prev"))
    out = candidates.join(prev, candidates[key] == prev["__k"], "left").drop("__k")
    if final_key is None:
        return out
    final = prev.select(F.col("__k").alias("__f"), F.col("prev").alias("__final"))
    return out.join(final, out[final_key] == final["__f"], "left").withColumn("prev", F.coalesce("__final", "prev")).drop("__f", "__final")


def attachments_added(now, before) -> Column:
    return F.size(F.array_except(col(now), F.coalesce(col(before), F.array().cast("array<string>")))) > 0


def page_status(generic, known, matched, added) -> Column:
    """NOWE, ZMIANA, HIT or NO_MATCH. Generic pages and pages without keyword never match; a removed attachment is no change."""
    return F.when(col(generic) | ~col(matched), F.lit("NO_MATCH")).when(~col(known), F.lit("NOWE")).when(col(added), F.lit("ZMIANA")).otherwise(F.lit("HIT"))


def response_kind(status, ctype, final_url, body, blocked, visible_tag) -> Column:
    """not_modified, blocked, pdf, http_err, non_html or html; in that order. A PDF is one before its status is looked at."""
    low = F.lower(F.coalesce(col(final_url), F.lit("")))
    return (
        F.when(col(status) == 304, "not_modified")
        .when((col(status) == 200) & col(blocked), "blocked")
        .when(F.contains(F.lower(F.coalesce(col(ctype), F.lit(""))), F.lit("pdf")) | F.endswith(low, F.lit(".pdf")), "pdf")
        .when(F.coalesce(col(status), F.lit(-1)) != 200, "http_err")
        .when((F.length(col(body)) > 800) & ~col(visible_tag), "non_html")
        .otherwise("html")
    )


def transition(kind, status) -> Column:
    """What a response that brings no page does: HIT on 304, BLOCKED, DEAD on 404 and 410, FAILED for what is tried again, else null."""
    k, s = col(kind), col(status)
    failed = s.isin(403, 429) | (s >= 500) | k.isin("timeout", "exc")
    return F.when(k == "not_modified", "HIT").when(k == "blocked", "BLOCKED").when(k.isin("html"), F.lit(None)).when(s.isin(404, 410) & (k == "http_err"), "DEAD").when(failed & (k != "pdf"), "FAILED")


def record(rows: DataFrame, as_of: Column) -> DataFrame:
    """State rows of classified pages (url_key, prev, gmina, title, url, keyword, att_sig, status, etag, last_modified): found_at is kept."""
    now = F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss")
    return rows.select("url_key", F.coalesce("prev.found_at", now).alias("found_at"), now.alias("last_checked"), "etag", "last_modified", "gmina", F.left("title", F.lit(240)).alias("title"), "url", F.array_compact(F.array("keyword")).alias("keywords"), "att_sig", "status")


def aliases(rows: DataFrame, key: str = "url_key", final_key: str = "final_key") -> DataFrame:
    """One row for each distinct key of a page: the requested and the final address."""
    return rows.withColumn("url_key", F.explode(F.array_distinct(F.array_compact(F.array(key, final_key)))))


def merge(state: DataFrame, delta: DataFrame) -> DataFrame:
    """New rows replace old ones of their key; untouched rows stay."""
    new, old = delta.select([F.col(c).alias(f"n_{c}") for c in FIELDS]), state.select(FIELDS)
    both = old.join(new, old["url_key"] == new["n_url_key"], "full_outer")
    return both.select([F.when(F.col("n_url_key").isNotNull(), F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in FIELDS])


def newest(shards: DataFrame) -> DataFrame:
    """The union of several state files: of each key the row checked last, ties to the smaller url."""
    w = Window.partitionBy("url_key").orderBy(F.desc_nulls_last(checked_at("last_checked", "found_at")), "url")
    return shards.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def by_url(state: DataFrame) -> DataFrame:
    """Adds, for rows stored under other keys, the row under their URL's key, unless it is there."""
    keyed = state.where("url is not null and url <> ''").withColumn("__k", url_key("url")).where("__k <> url_key")
    twins = keyed.withColumn("url_key", F.col("__k")).drop("__k").dropDuplicates(["url_key"])
    return state.unionByName(twins.join(state.select("url_key"), "url_key", "left_anti"))


def gate(candidates: DataFrame, state: DataFrame, as_of: Column, config: WatchConfig = DEFAULT) -> DataFrame:
    """Candidates (url) that must be fetched now, with their key and prev. Filters before any body is read."""
    keyed = lookup(candidates.withColumn("url_key", url_key("url")), state)
    return keyed.where(must_fetch("prev.status", checked_at("prev.last_checked", "prev.found_at"), as_of, "url", config))


def purge_seen(seen: DataFrame, as_of: Column, config: WatchConfig = DEFAULT) -> DataFrame:
    return seen.where(still_seen(parse_time("seen_at"), as_of, config.seen_days))


def purge_seeds(seeds: DataFrame, as_of: Column, config: WatchConfig = DEFAULT) -> DataFrame:
    """Seed sets without a time stay."""
    return seeds.where((F.coalesce("ts", F.lit("")) == "") | still_seen(parse_time("ts"), as_of, config.seed_days))


def not_dead(urls: DataFrame, dead: DataFrame, on: tuple[str, ...] = ("site_key",)) -> DataFrame:
    """Anti join on the canonical address within a site."""
    gone = dead.select(*on, canonical_url("url").alias("__c")).distinct()
    return urls.withColumn("__c", canonical_url("url")).join(gone, [*on, "__c"], "left_anti").drop("__c")


def queue(retry: DataFrame, frontier: DataFrame, seeds: DataFrame, config: WatchConfig = DEFAULT) -> DataFrame:
    """Order of a site's work: the first retries in reverse, then the saved frontier, or the seeds if there is none.
    retry: site_key, url, pos; frontier: site_key, url, depth, pos; seeds: site_key, url, pos."""
    r = retry.where(F.col("pos") < config.retries).select("site_key", "url", F.lit(0).alias("depth"), (F.col("pos") * -1).cast("long").alias("rank"), F.lit(0).alias("part"))
    f = frontier.select("site_key", "url", "depth", F.col("pos").cast("long").alias("rank"), F.lit(1).alias("part"))
    s = seeds.join(frontier.select("site_key").distinct(), "site_key", "left_anti").where(F.col("pos") < config.seeds).select("site_key", "url", F.lit(0).alias("depth"), F.col("pos").cast("long").alias("rank"), F.lit(1).alias("part"))
    rows = r.unionByName(f).unionByName(s).withColumn("url", canonical_url("url"))
    first = Window.partitionBy("site_key", "url").orderBy("part", "rank")
    rows = rows.withColumn("__n", F.row_number().over(first)).where("__n = 1")
    return rows.withColumn("order_rank", F.row_number().over(Window.partitionBy("site_key").orderBy("part", "rank", "url"))).select("site_key", "url", "depth", "order_rank")


def retry_rows(failed: DataFrame, known: DataFrame) -> DataFrame:
    """New retry entries (site_key, url): canonical, each once, none that an earlier run queued."""
    new = failed.select("site_key", canonical_url("url").alias("url")).distinct()
    return new.join(known.select("site_key", canonical_url("url").alias("url")).distinct(), ["site_key", "url"], "left_anti")


def outcomes(responses: DataFrame, state: DataFrame, as_of: Column) -> dict[str, DataFrame]:
    """What responses without a page do. responses: site_key, gmina, url, final_url, kind, status. Gives
    `delta`, state rows for merge, one a key: BLOCKED and FAILED under the final and the requested key, with what was known of the page kept and
    its validators cleared; HIT on 304 for known keys, and for a requested key that is unknown a copy of the final one's row;
    `retry` (site_key, url) of blocked and failed pages, `dead` (site_key, url) of those that are gone, canonical, each once."""
    now = F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss")
    own = responses.withColumn("final", canonical_url(F.coalesce(F.nullif("final_url", F.lit("")), "url"))).withColumn("next", transition("kind", "status"))
    own = own.where("next is not null").withColumn("own_key", url_key("url")).withColumn("final_key", F.sha1("final"))
    own = own.select("site_key", "gmina", "final", "next", "own_key", "final_key")
    known = lookup(lookup(own.where("next <> 'DEAD'"), state, "own_key").withColumnRenamed("prev", "was"), state, "final_key").withColumnRenamed("prev", "is")
    prev = F.coalesce("is", "was")
    bad = known.where("next in ('BLOCKED', 'FAILED')").withColumn("prev", prev)
    nothing = F.array().cast("array<string>")
    kept = bad.select(F.explode(F.array_distinct(F.array("final_key", "own_key"))).alias("url_key"), F.coalesce("prev.found_at", now).alias("found_at"), now.alias("last_checked"), F.lit("").alias("etag"), F.lit("").alias("last_modified"), "gmina", F.coalesce("prev.title", F.lit("")).alias("title"), F.col("final").alias("url"), F.coalesce("prev.keywords", nothing).alias("keywords"), F.coalesce("prev.att_sig", F.lit("")).alias("att_sig"), F.col("next").alias("status"))
    renewed = lambda key, row: F.when(row.isNotNull(), F.struct(F.col(key).alias("url_key"), row.alias("row")))
    same = known.where("next = 'HIT'").select(F.explode(F.array_compact(F.array_distinct(F.array(renewed("final_key", F.col("is")), renewed("own_key", F.coalesce("was", "is")))))).alias("x"))
    same = same.select([F.col("x.url_key") if c == "url_key" else now.alias(c) if c == "last_checked" else F.lit("HIT").alias(c) if c == "status" else F.col(f"x.row.{c}") for c in FIELDS])
    once = Window.partitionBy("url_key").orderBy("status", "url", "title", "found_at")
    delta = kept.unionByName(same).withColumn("__n", F.row_number().over(once)).where("__n = 1").drop("__n")
    listed = lambda *kinds: own.where(F.col("next").isin(*kinds)).select("site_key", F.col("final").alias("url")).distinct()
    return {"delta": delta, "retry": listed("BLOCKED", "FAILED"), "dead": listed("DEAD")}


def dead_rows(gone: DataFrame, dead: DataFrame) -> DataFrame:
    """The dead addresses (site_key, url) with new ones added, canonical, each once."""
    both = dead.select("site_key", canonical_url("url").alias("url")).unionByName(gone.select("site_key", canonical_url("url").alias("url")))
    return both.where("url is not null").distinct()


def frontier_rows(found: DataFrame, fetched: DataFrame, config: WatchConfig = DEFAULT) -> DataFrame:
    """What a stopped run leaves for the next one: site_key, url, depth, pos of found addresses (site_key, url, depth) not fetched (site_key,
    url), in the order of their depth. Empty for a run that came to its end, which clears the saved one. Those too deep are left out."""
    done = fetched.select("site_key", canonical_url("url").alias("url")).distinct()
    left = found.where(F.col("depth") <= config.depth).groupBy("site_key", canonical_url("url").alias("url")).agg(F.min("depth").alias("depth")).join(done, ["site_key", "url"], "left_anti")
    return left.withColumn("pos", F.row_number().over(Window.partitionBy("site_key").orderBy("depth", "url")) - 1)


def seed_cache_get(sites: DataFrame, cache: DataFrame, as_of: Column, config: WatchConfig = DEFAULT) -> DataFrame:
    """sites (site_key, ...) with allowed_host, start_final and seeds of the cache, null where it has none that is fresh: no older than
    `seed_days`, or without a time. A time that can't be read isn't fresh."""
    fresh = cache.where((F.coalesce("ts", F.lit("")) == "") | still_seen(parse_time("ts"), as_of, config.seed_days))
    return sites.join(fresh.select("site_key", "allowed_host", "start_final", "seeds"), "site_key", "left")


def seed_cache_put(cache: DataFrame, found: DataFrame, as_of: Column) -> DataFrame:
    """The cache with the rows of found (site_key, allowed_host, start_final, seeds) in place of older ones, stamped."""
    new = found.select("site_key", "allowed_host", "start_final", "seeds", F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss").alias("ts"))
    return cache.join(new.select("site_key"), "site_key", "left_anti").select(new.columns).unionByName(new)


def mark_seen(seen: DataFrame, urls: DataFrame, as_of: Column) -> DataFrame:
    """seen (url_key, seen_at) with the keys of urls (url) stamped; listing and home pages are never marked."""
    new = urls.where(~is_first_phase_listing("url")).select(url_key("url").alias("url_key")).distinct()
    return seen.join(new, "url_key", "left_anti").select("url_key", "seen_at").unionByName(new.withColumn("seen_at", F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss")))


def with_times(seen: DataFrame, as_of: Column) -> DataFrame:
    """Before a save: keys without a time get this one."""
    return seen.withColumn("seen_at", F.coalesce(F.nullif("seen_at", F.lit("")), F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss")))
