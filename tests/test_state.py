import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewatch.config import SCRIPTED_SEEDS, WatchConfig
from tidewatch.functions import ttl as T
from tidewatch.operators import crawl, links, state
from tidewatch.sources import readers, sinks

CASES = [(True, True, True, True, "NO_MATCH"), (False, False, True, False, "NOWE"), (False, False, False, False, "NO_MATCH"), (False, True, True, False, "HIT"), (False, True, True, True, "ZMIANA"), (False, True, False, True, "NO_MATCH")]


def as_of():
    return F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")


def test_status_table(spark):
    df = spark.createDataFrame(CASES, "generic boolean, known boolean, matched boolean, added boolean, want string")
    assert df.where(state.page_status("generic", "known", "matched", "added") != F.col("want")).isEmpty()


@pytest.mark.parametrize(("checked", "found", "want"), [("2024-01-01T00:00:00", None, True), ("2024-01-01T00:00:01", None, False), ("", "2023-12-31T00:00:00", True), ("junk", "2024-01-01T23:00:00", True), (None, None, True)])
def test_gate_boundary(spark, checked, found, want):
    df = spark.createDataFrame([(checked, found, "NO_MATCH", "https://a.pl/x")], "c string, f string, s string, u string")
    assert df.select(T.must_fetch("s", T.checked_at("c", "f"), as_of(), "u")).first()[0] is want


def test_gate_by_status(spark):
    rows = [("BLOCKED", "2024-01-01T21:00:00", True), ("BLOCKED", "2024-01-01T21:00:01", False), ("FAILED", "2024-01-01T22:00:00", True), ("SEEN", "2024-01-01T23:59:59", True), (None, None, True)]
    df = spark.createDataFrame(rows, "s string, c string, want boolean").withColumn("u", F.lit("https://a.pl/x"))
    assert df.where(T.must_fetch("s", T.checked_at("c", F.lit(None).cast("string")), as_of(), "u") != F.col("want")).isEmpty()


def test_transitions(spark):
    rows = [("not_modified", 304, "HIT"), ("blocked", 429, "BLOCKED"), ("http_err", 404, "DEAD"), ("http_err", 410, "DEAD"), ("http_err", 503, "FAILED"), ("timeout", None, "FAILED"), ("http_err", 400, None), ("pdf", 404, None), ("html", 200, None)]
    df = spark.createDataFrame(rows, "k string, s int, want string")
    assert df.where(~state.transition("k", "s").eqNullSafe(F.col("want"))).isEmpty()


def test_merge_keeps_untouched_rows(spark):
    row = lambda k, s: tuple({"url_key": k, "status": s, "keywords": []}.get(c) for c in state.FIELDS)
    old, new = spark.createDataFrame([row("a", "HIT"), row("b", "HIT")], state.STATE), spark.createDataFrame([row("b", "ZMIANA"), row("c", "NOWE")], state.STATE)
    assert {(r.url_key, r.status) for r in state.merge(old, new).collect()} == {("a", "HIT"), ("b", "ZMIANA"), ("c", "NOWE")}


def test_queue(spark):
    retry = spark.createDataFrame([("s", f"https://a.pl/r{i}", i) for i in range(201)], "site_key string, url string, pos int")
    frontier = spark.createDataFrame([("s", "https://a.pl/f", 2, 0)], "site_key string, url string, depth int, pos int")
    seeds = spark.createDataFrame([("s", "https://a.pl/seed", 0), ("t", "https://b.pl/seed", 0)], "site_key string, url string, pos int")
    got = [(r.site_key, r.url) for r in state.queue(retry, frontier, seeds).orderBy("site_key", "order_rank").collect()]
    assert got[0] == ("s", "https://a.pl/r199") and got[200] == ("s", "https://a.pl/f") and got[201] == ("t", "https://b.pl/seed") and len(got) == 202


def test_cyclic_graph(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 7)], "src long, dst long")
    roots = spark.createDataFrame([(1,)], "node long")
    assert {(r.node, r.depth) for r in crawl.reach(edges, roots, 4).collect()} == {(1, 0), (2, 1), (3, 2), (4, 3), (5, 4)}
    assert crawl.reach(edges, roots).count() == 7


def test_start_candidates(spark):
    rows = crawl.start_candidates(spark.createDataFrame([("A.pl/x",)], "url string")).orderBy("ordinal").collect()
    assert [r.candidate for r in rows[:5]] == ["https://a.pl/x", "https://a.pl/x/", "https://a.pl/", "https://a.pl/bip/", "https://a.pl/BIP/"] and len(rows) == 16


def sitemap(children=(), pages=()):
    tags = [f"<sitemap><loc>{c}</loc></sitemap>" for c in children] + [f"<url><loc>{p}</loc></url>" for p in pages]
    return f"<sitemapindex>{''.join(tags)}</sitemapindex>"


def test_sitemaps_of_any_depth(spark):
    files = [("https://a.pl/sitemap-index.xml", sitemap(["https://a.pl/s1.xml"]))]
    files += [(f"https://a.pl/s{i}.xml", sitemap([f"https://a.pl/s{i + 1}.xml", "https://a.pl/s1.xml"], [f"https://a.pl/p{i}"])) for i in range(1, 7)]
    many = [f"https://b.pl/c{i}.xml" for i in range(60)]
    files += [("https://b.pl/robots.txt", "Sitemap: https://b.pl/all.xml"), ("https://b.pl/all.xml", sitemap(many))]
    files += [(c, sitemap([], [c.replace(".xml", "")])) for c in many]
    roots = spark.createDataFrame([("a", "https://a.pl"), ("b", "https://b.pl"), ("c", "https://c.pl")], "site_key string, base string")
    got = {}
    for r in crawl.sitemap_urls(spark.createDataFrame(files, "url string, body string"), roots).orderBy("ordinal").collect():
        got.setdefault(r.site_key, []).append(r.url)
    assert got == {"a": [f"https://a.pl/p{i}" for i in range(1, 7)], "b": [f"https://b.pl/c{i}" for i in range(36)]}  # 40 fetches: 4 first ones, 36 children


def test_scripted_seeds(spark):
    starts = spark.createDataFrame([("a", "https://a.pl/bip/", "<script src='x.js'></script>"), ("b", "https://b.pl/", f"<p>{'text ' * 200}</p>"), ("c", "https://c.pl/", None)], "site_key string, url string, html string")
    seeds = links.scripted_seeds(starts)
    got = {(r.site_key, r.url, r.score) for r in seeds.collect()}
    assert len(got) == len(SCRIPTED_SEEDS) and {("a", "https://a.pl/rss", 20), ("a", "https://a.pl/sitemap.xml?page=2", 20), ("a", "https://a.pl/index.php?id=ostatnio_dodane", 20)} <= got and {s for s, *_ in got} == {"a"}
    urls = spark.createDataFrame([("https://a.pl/rss",), ("https://a.pl/oze",), ("https://a.pl/x",)], "url string")
    scores = {r.url: r.score for r in links.seed_scores(urls, seeds).collect()}
    assert len(scores) == len(SCRIPTED_SEEDS) + 2 and [scores[f"https://a.pl/{x}"] for x in ("rss", "feed", "oze", "x")] == [20, 20, 18, 10]


def test_link_hits(spark):
    found = spark.createDataFrame([(1, 0, "https://a.pl/d1", "Projekt MPZP Centrum"), (2, 0, "https://www.a.pl/d1/", "Drugi projekt mpzp"), (1, 1, "https://a.pl/d2", "bip"), (1, 2, "https://a.pl/old", "Stary mpzp tutaj")], "page_id long, pos int, url string, anchor string")
    known = spark.createDataFrame([("x", "https://a.pl/old")], "k string, url string").select(F.sha1("url").alias("url_key"))
    assert [(r.url, r.page_id, r.keyword, r.status) for r in links.link_hits(found, known).collect()] == [("https://a.pl/d1", 1, "mpzp", "NOWE")]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "s.csv").write_bytes("name,url\r\nA, a.pl\r\nB,http://b.pl/x?y=1\r\n,https://c.pl\r\n\r\n".encode())
    sites = readers.sites(spark, str(tmp_path / "s.csv"))
    assert [(r.name, r.url, r.pos) for r in sites.collect()] == [("A", "https://a.pl", 0), ("B", "http://b.pl/x?y=1", 1)]
    assert readers.shard_rows(sites, 1).first().name == "B" and readers.shard_rows(sites, 9).isEmpty()
    (tmp_path / "c.json").write_text('{"schema": 10, "urls_seen": {"k": "2024-01-01T00:00:00"}, "content_seen": {"k": {"status": "SEEN", "url": "https://a.pl/q"}}, "page_fprints": {}, "gmina_frontiers": {"s": [["https://a.pl/1", 3]]}}')
    t = readers.state_files(spark, str(tmp_path / "c.json"))
    assert t["content_state"].first().status == "SEEN" and t["dead_urls"].isEmpty() and t["frontier"].first().depth == 3
    assert state.by_url(t["content_state"]).count() == 2
    out = str(tmp_path / "out")
    assert all(df.isEmpty() for df in readers.load_state(spark, out).values())
    sinks.save_state(t, out, "run1")
    sinks.save_state(readers.empty_state(spark), out, "run2")
    (tmp_path / "out/run2/_COMPLETE").unlink()  # a run that failed midway
    assert readers.load_state(spark, out)["urls_seen"].count() == 1 and readers.load_state(spark, out)["dead_urls"].isEmpty()
    (tmp_path / "old.json").write_text('{"found_items": {"a": 1}, "urls_seen": {"k": "t"}}')
    assert all(df.isEmpty() for df in readers.state_files(spark, str(tmp_path / "old.json")).values())
    assert all(df.isEmpty() for df in readers.empty_state(spark).values())


def test_purge_boundary(spark):
    at = dt.datetime(2023, 1, 2)
    df = spark.createDataFrame([("a", at.isoformat()), ("b", (at - dt.timedelta(seconds=1)).isoformat()), ("c", "junk")], "url_key string, seen_at string")
    assert [r.url_key for r in state.purge_seen(df, as_of()).collect()] == ["a"]


def test_discovery_stops_at_the_page_limit(spark):
    """A chain and a cycle: with two pages fetched a site, the third is found but what it names isn't."""
    rows = [(f"https://a.pl/{i}", f"https://{'b' if i == 9 else 'a'}.pl/{j}", "Anchor text", k) for i in range(4) for k, j in enumerate((i + 1, (i + 2) % 5))] + [("https://a.pl/0", "https://other.com/", "Anchor text", 5)]
    found = spark.createDataFrame(rows, "base string, url string, anchor string, pos int")
    starts = spark.createDataFrame([("s", "https://www.a.pl/0#x"), ("t", "https://c.pl/")], "site_key string, url string")
    starts = starts.withColumn("url", F.when(F.col("site_key") == "s", "https://a.pl/0#x").otherwise(F.col("url")))
    all_ = {(r.site_key, r.url[-1], r.depth, r.ordinal) for r in crawl.discover(found, starts).collect()}
    assert all_ == {("s", "0", 0, 1), ("s", "1", 1, 2), ("s", "2", 1, 3), ("s", "3", 2, 4), ("s", "4", 2, 5), ("t", "/", 0, 1)}
    few = crawl.discover(found, starts, WatchConfig(discovery_pages=2))
    assert {(r.url[-1], r.fetched) for r in few.where("site_key = 's'").collect()} == {("0", True), ("1", True), ("2", False), ("3", False)}
    assert [(r.site_key, r.url[-1], r.pos) for r in crawl.seeds(few, WatchConfig(seeds=2)).orderBy("pos").collect()] == [("s", "1", 0), ("s", "2", 1)]


def test_first_success(spark):
    rows = spark.createDataFrame([("a", 1, 404, True), ("a", 2, 200, False), ("a", 3, 200, True), ("a", 4, 200, True), ("b", 1, 500, False), ("b", 2, 403, False)], "g string, ordinal int, status int, html boolean")
    assert {(r.g, r.ordinal) for r in crawl.first_success(rows, ["g"]).collect()} == {("a", 3), ("b", 2)}


def test_a_stopped_run_is_resumed(spark):
    """The saved frontier comes back in order, before it the retries, and seeds are ignored; a run that came to its end clears it."""
    found = spark.createDataFrame([("s", "https://a.pl/1", 0), ("s", "https://www.a.pl/2/", 2), ("s", "https://a.pl/3", 1), ("s", "https://a.pl/9", 5)], "site_key string, url string, depth int")
    done = found.where("depth = 0").select("site_key", "url")
    left = state.frontier_rows(found, done)
    retry = spark.createDataFrame([("s", "https://a.pl/r", 0)], "site_key string, url string, pos int")
    seeds = spark.createDataFrame([("s", "https://a.pl/seed", 0), ("t", "https://t.pl/seed", 0)], "site_key string, url string, pos int")
    got = [(r.site_key, r.url, r.depth) for r in state.queue(retry, left, seeds).orderBy("site_key", "order_rank").collect()]
    assert got == [("s", "https://a.pl/r", 0), ("s", "https://a.pl/3", 1), ("s", "https://a.pl/2", 2), ("t", "https://t.pl/seed", 0)]
    assert state.frontier_rows(found, found).isEmpty()


def test_purge_seeds_and_their_cache(spark):
    rows = spark.createDataFrame([("new", "2022-12-20T00:00:00"), ("old", "2022-11-01T00:00:00"), ("junk", "x"), ("none", "")], "site_key string, ts string")
    cache = rows.withColumns({"allowed_host": F.lit("h"), "start_final": F.lit("f"), "seeds": F.array(F.lit("u"))})
    at = F.lit("2023-01-02 00:00:00").cast("timestamp_ntz")
    assert {r.site_key for r in state.purge_seeds(cache, at).collect()} == {"new", "none"}
    assert {r.site_key for r in state.seed_cache_get(rows.select("site_key"), cache, at).where("seeds is not null").collect()} == {"new", "none"}


def test_stream_state_ends(spark, tmp_path):
    """A key's state ends a day after its last event let through, when a later batch has moved the watermark past that."""
    from tidewatch.streaming import recheck as R

    day = dt.datetime(2024, 1, 1)
    batches = [[("a", day, "FAILED"), ("a", day + dt.timedelta(minutes=30), "FAILED"), ("a", day + dt.timedelta(minutes=61), "X")], [("b", day + dt.timedelta(days=9), "FAILED")], [("b", day + dt.timedelta(days=10), "FAILED")], [("a", day + dt.timedelta(days=11), "FAILED")]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "key string, ts timestamp, status string").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    source = spark.readStream.schema("key string, ts timestamp, status string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    out = str(tmp_path / "out")
    q = R.recheck(source, {"FAILED": 60, "X": 10**6}, ttl_days=1).writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "_c").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.key, r.ts, r.due) for r in spark.read.parquet(out).collect())
    assert [d for k, _, d in got if k == "a"] == [True, False, True, True]  # without an end the last one would wait for 694 days
