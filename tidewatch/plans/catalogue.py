"""Registered queries and their SQL. Each runs over its whole table; remembered state is derived from the table in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions import html as H
from ..functions import text as X
from ..functions import ttl as T
from ..functions import urls as U
from ..operators import crawl, diagnostics, state
from ..operators import links as L
from ..session import shared_dir, ship
from ..streaming import recheck as R

#: Words of the test vocabulary: the default keywords don't occur in the tables.
KEYS = ("oning", "thble", "the", "attion", "queau", "lich")
STRICT = ("the",)
ENDS = ("/the", "/of", "/de")
MARKERS = ("%%%", "***")
NOISE = (r"\bth\w*\s*:\s*\d+",)
AS_OF = "2024-02-01 00:00:00"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def of(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return of


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(values) -> str:
    return "[" + ",".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def instr(x: str, values) -> str:
    return "(" + " OR ".join(f"contains({x}, '{v}')" for v in values) + ")"


# ---- shared SQL
PARTS = r"""parts AS (SELECT page_id, url, html, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?', ['s','h','p','q']) r FROM pages),
norm AS (SELECT page_id, url, html, lower(r.s) s, r.h h, r.p p, coalesce(array_to_string(list_sort(list_filter(string_split(r.q, '&'), lambda x: x <> '' AND NOT starts_with(lower(x), 'utm_') AND NOT list_contains({tracking}, lower(split_part(x, '=', 1))))), '&'), '') q FROM parts),
n AS (SELECT *, s || '://' || h || p || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS normalized,
 'https://' || regexp_replace(lower(h), '^www\.', '') || CASE WHEN p IN ('', '/') THEN '/' ELSE regexp_replace(p, '/$', '') END || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS canonical,
 string_split(regexp_replace(lower(h), '^www\.', ''), '.') labels FROM norm),
k AS (SELECT *, sha1(canonical) url_key, CASE WHEN len(labels) <= 2 THEN array_to_string(labels, '.') WHEN labels[-1] IN ('pl','uk') AND labels[-2] IN ('com','net','org','gov','edu') THEN array_to_string(labels[-3:], '.') ELSE array_to_string(labels[-2:], '.') END AS site FROM n)""".replace("{tracking}", quoted(C.TRACKING))
UNESCAPE = "replace(replace(replace(replace(replace(replace(replace(replace({x}, '&copy;', '©'), '&middot;', '·'), '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"
COLLAPSE = r"trim(regexp_replace({x}, '[\s\x{{a0}}]+', ' ', 'g'))"


def stripped(x: str, *tags: str) -> str:
    for t in tags:
        x = rf"regexp_replace({x}, '(?is)<{t}\b[^>]*>.*?</{t}\s*>', ' ', 'g')"
    return x


def texted(x: str) -> str:
    return COLLAPSE.format(x=UNESCAPE.format(x=rf"regexp_replace({x}, '(?s)<!--.*?-->|<[^>]*>', ' ', 'g')"))


TEXT = texted(stripped("html", "script", "style", "noscript"))
TAG = lambda t: texted(rf"regexp_extract(html, '(?is)<{t}\b[^>]*>(.*?)</{t}\s*>', 1)")
SEEN = f"""{PARTS},
t AS (SELECT *, {TEXT} txt, {TAG('h1')} h1, {TAG('title')} title FROM k)"""
LOW = lambda x: COLLAPSE.format(x=f"lower({x})")


def keyword_sql(x: str) -> str:
    tests = [rf"regexp_matches(b, '(^|[^\pL\pN_]){k}([^\pL\pN_]|$)')" if k in STRICT else f"contains(b, '{k}')" for k in KEYS]
    return "CASE " + " ".join(f"WHEN {t} THEN '{k}'" for t, k in zip(tests, KEYS, strict=True)) + " END"


LINKS = rf"""raw AS (SELECT page_id, url AS base, s, h, unnest(regexp_extract_all(html, '(?is)(<a\b[^>]*>.*?)</a\s*>', 1)) a, generate_subscripts(regexp_extract_all(html, '(?is)(<a\b[^>]*>.*?)</a\s*>', 1), 1) - 1 AS pos FROM k),
hr AS (SELECT *, {UNESCAPE.format(x=r"regexp_extract(a, '(?is)^<a\b[^>]*?\bhref\s*=\s*[\"'']?([^\"''>\s]*)', 1)")} href, {texted(r"regexp_replace(a, '(?is)^<a\b[^>]*>', '')")} anchor FROM raw),
li AS (SELECT page_id, base, pos, anchor, s || '://' || h || href AS url FROM hr WHERE href <> ''),
skip AS (SELECT *, {instr('lower(url)', C.IGNORED_URLS)} OR regexp_matches(lower(url), 'prognoza.pogody|prognoza_pogody|/wersja/\d+/?$') OR len(list_filter({quoted(C.BAD_EXTENSIONS)}, lambda e: ends_with(lower(url), e))) > 0 AS bad FROM li),
links AS (SELECT page_id, base, url, anchor, pos FROM skip WHERE NOT bad QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY pos) = 1)"""


# ---- Spark side
def keyed(pages: DataFrame) -> DataFrame:
    return pages.withColumn("canonical", U.canonical_url("url")).withColumn("url_key", U.sha1_key("canonical")).withColumn("site", U.base_domain(U.netloc("url")))


def all_links(pages: DataFrame) -> DataFrame:
    return L.extract(pages)


def remembered(pages: DataFrame) -> DataFrame:
    """Prior state of two thirds of the pages, as it would be stored."""
    status = F.element_at(F.array(*map(F.lit, ("HIT", "NO_MATCH", "BLOCKED", "FAILED", "NOWE"))), (F.col("page_id") % 5 + 1).cast("int"))
    at = F.date_format(F.lit(AS_OF).cast("timestamp_ntz") - F.make_dt_interval(hours=(F.col("page_id") % 48).cast("int")), "yyyy-MM-dd'T'HH:mm:ss")
    rows = keyed(pages.where("page_id % 3 <> 0")).select("url_key", at.alias("last_checked"), F.lit("2023-12-01T00:00:00").alias("found_at"), F.col("canonical").alias("url"), status.alias("status"), "page_id")
    return L.first_by(rows, ["url_key"], ["page_id"]).drop("page_id")


PREV = f"prev AS (SELECT url_key, canonical AS url, strftime(TIMESTAMP '{AS_OF}' - to_hours((page_id % 48)::INT), '%Y-%m-%dT%H:%M:%S') last_checked, '2023-12-01T00:00:00' found_at, ['HIT','NO_MATCH','BLOCKED','FAILED','NOWE'][(page_id % 5 + 1)::INT] status FROM k WHERE page_id % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY url_key ORDER BY page_id) = 1)"


@query(f"WITH {PARTS} SELECT page_id, normalized FROM k")
def q01_normalize_url(spark, d):
    return read(spark, d, "pages").select("page_id", U.normalize_url("url").alias("normalized"))


@query(f"WITH {PARTS} SELECT page_id, canonical FROM k")
def q02_canonical_url(spark, d):
    return read(spark, d, "pages").select("page_id", U.canonical_url("url").alias("canonical"))


@query(f"WITH {PARTS} SELECT page_id, url_key FROM k")
def q03_url_key(spark, d):
    return read(spark, d, "pages").select("page_id", U.url_key("url").alias("url_key"))


@query(f"WITH {PARTS} SELECT page_id, site FROM k")
def q04_base_domain(spark, d):
    return read(spark, d, "pages").select("page_id", U.base_domain(U.netloc("url")).alias("site"))


@query(f"WITH {PARTS} SELECT site, count(*) pages, count(DISTINCT url_key) keys FROM k GROUP BY site")
def q05_site_rollup(spark, d):
    return keyed(read(spark, d, "pages").select("page_id", "url")).groupBy("site").agg(F.count("*").alias("pages"), F.countDistinct("url_key").alias("keys"))


@query(f"WITH {PARTS} SELECT page_id, p IN ('', '/') AS home, {instr('lower(url)', C.LISTING)} AS listing, {instr('lower(url)', C.IGNORED_URLS)} AS ignored, {instr('lower(url)', C.LISTING)} OR p IN ('', '/') AS first_phase FROM k")
def q06_url_predicates(spark, d):
    return read(spark, d, "pages").select("page_id", U.is_home_url("url").alias("home"), U.is_listing_url("url").alias("listing"), U.url_is_ignored("url").alias("ignored"), U.is_first_phase_listing("url").alias("first_phase"))


@query(rf"""WITH parts AS (SELECT regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?', ['s','h','p','q']) r FROM pages),
t AS (SELECT lower(r.s) || '://' || r.h || r.p || CASE WHEN r.q <> '' THEN '?' || array_to_string(list_sort(list_transform(string_split(r.q, '&'), lambda x: CASE WHEN list_contains({quoted(C.PAGING_KEYS)}, lower(split_part(x, '=', 1))) THEN split_part(x, '=', 1) || '=' ELSE x END)), '&') ELSE '' END AS template FROM parts)
SELECT template, count(*) pages FROM t GROUP BY template""")
def q07_pagination_template(spark, d):
    return read(spark, d, "pages").groupBy(U.pagination_template("url").alias("template")).agg(F.count("*").alias("pages"))


@query(f"SELECT page_id, {TEXT} AS fast_text FROM pages")
def q08_fast_text(spark, d):
    return read(spark, d, "pages").select("page_id", H.fast_text("html").alias("fast_text"))


@query(f"SELECT page_id, title, h1, left(coalesce(nullif(h1, ''), nullif(title, ''), url), 240) AS shown FROM (SELECT page_id, url, {TAG('title')} title, {TAG('h1')} h1 FROM pages)")
def q09_title_h1(spark, d):
    rows = read(spark, d, "pages").select("page_id", "url", H.first_tag("html", "title").alias("title"), H.first_tag("html", "h1").alias("h1"))
    return rows.select("page_id", "title", "h1", X.page_title("h1", F.lit(""), "title", "url").alias("shown"))


@query(rf"SELECT page_id, length({TEXT}) < 300 OR (len(regexp_extract_all(html, '(?i)<script\b[^>]*\bsrc\s*=')) > 10 AND length({TEXT}) < 500) AS scripted FROM pages")
def q10_js_shell(spark, d):
    return read(spark, d, "pages").select("page_id", H.is_scripted("html").alias("scripted"))


@query(f"SELECT page_id, {instr('lower(html)', MARKERS)} OR (length({TEXT}) < 600 AND regexp_matches(left(lower(html), 4000), '" + "|".join(C.BLOCK_PHRASES) + "')) AS blocked FROM pages")
def q11_block_page(spark, d):
    return read(spark, d, "pages").select("page_id", X.is_block_page("html", H.visible_text("html"), MARKERS).alias("blocked"))


@query(f"WITH {SEEN} SELECT page_id, CASE WHEN {instr('lower(url)', C.LISTING)} THEN true WHEN p IN ('', '/') AND length(txt) < 600 THEN true WHEN trim(title || ' ' || h1) = '' THEN false WHEN length(lower(title) || ' ' || lower(h1)) <= 90 AND regexp_matches(lower(title || ' ' || h1), '(the|der)') AND length(txt) < 300 THEN true ELSE regexp_matches(lower(h1), '^(the|de).*$') END AS generic FROM t")
def q12_generic_page(spark, d):
    rows = read(spark, d, "pages").select("page_id", "url", H.first_tag("html", "title").alias("title"), H.first_tag("html", "h1").alias("h1"), H.fast_text("html").alias("txt"))
    return rows.select("page_id", X.is_generic_page("title", "h1", "url", "txt", "(the|der)", "^(the|de).*$").alias("generic"))


@query(r"SELECT doc_id, " + COLLAPSE.format(x=r"regexp_replace(text, '(?i)(licen[cs]e|reserved)\s*\w*', '', 'g')") + " AS clean FROM documents")
def q13_noise_strip(spark, d):
    return read(spark, d, "documents").select("doc_id", X.strip_noise("text", (r"(?-U)(licen[cs]e|reserved)\s*\w*",)).alias("clean"))


@query(f"SELECT doc_id, {keyword_sql('b')} AS keyword FROM (SELECT doc_id, {LOW('text')} b FROM documents)")
def q14_keyword_first(spark, d):
    return read(spark, d, "documents").select("doc_id", X.keyword("text", KEYS, STRICT).alias("keyword"))


@query(rf"SELECT doc_id, regexp_matches({LOW('text')}, '(^|[^\pL\pN_])(of|le|der)([^\pL\pN_]|$)') AS hit FROM documents")
def q15_keyword_strict(spark, d):
    return read(spark, d, "documents").select("doc_id", X.keyword("text", ("of", "le", "der"), ()).isNotNull().alias("hit"))


@query(f"SELECT lang, keyword, count(*) documents FROM (SELECT lang, {keyword_sql('b')} keyword FROM (SELECT lang, {LOW('text')} b FROM documents)) GROUP BY ALL")
def q16_keyword_counts(spark, d):
    return read(spark, d, "documents").groupBy("lang", X.keyword("text", KEYS, STRICT).alias("keyword")).agg(F.count("*").alias("documents"))


@query(f"WITH {PARTS}, {LINKS} SELECT page_id, url, anchor, pos FROM links")
def q17_links(spark, d):
    return all_links(read(spark, d, "pages")).select("page_id", "url", "anchor", F.col("pos").cast("long").alias("pos"))


@query(f"WITH {PARTS}, {LINKS} SELECT url, page_id, pos, anchor FROM links QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id, pos) = 1")
def q18_link_dedup_first(spark, d):
    return L.first_by(all_links(read(spark, d, "pages")), ["url"], ["page_id", "pos"]).select("url", "page_id", F.col("pos").cast("long").alias("pos"), "anchor")


ATT = f"att AS (SELECT page_id, list_sort(list_distinct(list('https://' || regexp_replace(lower(h), '^www\\.', '') || href))) a FROM hr WHERE href <> '' AND len(list_filter({quoted(ENDS)}, lambda e: ends_with(lower(s || '://' || h || href), e))) > 0 GROUP BY page_id)"


@query(f"WITH {PARTS}, {LINKS}, {ATT} SELECT k.page_id, coalesce(array_to_string(a, ' '), '') AS attachments FROM k LEFT JOIN att USING (page_id)")
def q19_attachments(spark, d):
    return read(spark, d, "pages").select("page_id", F.array_join(H.attachments("html", "url", ENDS), " ").alias("attachments"))


STATUS = f"""WITH {SEEN}, {PREV}, {LINKS}, {ATT},
b AS (SELECT t.page_id, t.url_key, t.canonical, {LOW("title || ' ' || h1 || ' ' || txt")} b, {instr('lower(t.url)', C.LISTING)} AS generic, prev.status AS old, prev.found_at, coalesce(len(a), 0) >= 2 AS added FROM t LEFT JOIN prev USING (url_key) LEFT JOIN att USING (page_id)),
st AS (SELECT page_id, url_key, canonical, {keyword_sql('b')} AS keyword, old, found_at, generic, added FROM b),
res AS (SELECT *, CASE WHEN generic OR keyword IS NULL THEN 'NO_MATCH' WHEN old IS NULL THEN 'NOWE' WHEN added THEN 'ZMIANA' ELSE 'HIT' END AS status FROM st)"""


def classified(spark, d) -> DataFrame:
    """Pages against remembered state. What state knew of attachments is all but what a page with two or more of them has gained."""
    pages = read(spark, d, "pages")
    rows = keyed(pages).select("page_id", "url", "canonical", "url_key", H.first_tag("html", "title").alias("title"), H.first_tag("html", "h1").alias("h1"), H.fast_text("html").alias("txt"), H.attachments("html", "url", ENDS).alias("att"))
    rows = state.lookup(rows, remembered(pages))
    found = X.keyword(F.concat_ws(" ", "title", "h1", "txt"), KEYS, STRICT)
    rows = rows.select("page_id", "url_key", "canonical", found.alias("keyword"), U.is_listing_url("url").alias("generic"), "prev", "att")
    added = state.attachments_added("att", F.slice("att", 1, 1))
    return rows.select("page_id", "url_key", "canonical", "keyword", "prev", state.page_status("generic", F.col("prev").isNotNull(), F.col("keyword").isNotNull(), added).alias("status"))


@query(f"{STATUS} SELECT page_id, url_key, keyword, status FROM res")
def q20_page_status(spark, d):
    return classified(spark, d).select("page_id", "url_key", "keyword", "status")


@query(f"{STATUS} SELECT status, count(*) pages, count(keyword) matched FROM res GROUP BY status")
def q21_status_counts(spark, d):
    return classified(spark, d).groupBy("status").agg(F.count("*").alias("pages"), F.count("keyword").alias("matched"))


@query(f"""WITH {PARTS}, {PREV}, j AS (SELECT page_id, p, k.url, prev.status, TIMESTAMP '{AS_OF}' - strptime(last_checked, '%Y-%m-%dT%H:%M:%S') AS age FROM k LEFT JOIN prev USING (url_key))
SELECT page_id, CASE WHEN status IS NULL OR p IN ('', '/') OR {instr('lower(url)', C.LISTING)} THEN true WHEN status IN ('HIT','NOWE','ZMIANA','NO_MATCH') THEN age >= INTERVAL 24 HOUR WHEN status = 'BLOCKED' THEN age >= INTERVAL 180 MINUTE ELSE age >= INTERVAL 120 MINUTE END AS due FROM j""")
def q22_ttl_gate(spark, d):
    pages = read(spark, d, "pages").select("page_id", "url")
    rows = state.lookup(keyed(pages), remembered(pages))
    return rows.select("page_id", T.must_fetch("prev.status", T.checked_at("prev.last_checked", "prev.found_at"), F.lit(AS_OF).cast("timestamp_ntz"), "url").alias("due"))


@query("SELECT user_id, seen_at FROM (SELECT user_id, max(ts) seen_at FROM events GROUP BY user_id) WHERE seen_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 2 DAY")
def q23_purge(spark, d):
    last = read(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("seen_at"))
    return last.where(T.still_seen("seen_at", F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"), 2))


@query(f"""{STATUS}, new AS (SELECT url_key, status, coalesce(found_at, '2024-02-01T00:00:00') found_at, '2024-02-01T00:00:00' last_checked FROM res WHERE page_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY url_key ORDER BY page_id) = 1)
SELECT coalesce(new.url_key, prev.url_key) url_key, coalesce(new.status, prev.status) status, coalesce(new.found_at, prev.found_at) found_at, coalesce(new.last_checked, prev.last_checked) last_checked FROM prev FULL OUTER JOIN new USING (url_key)""")
def q24_state_merge(spark, d):
    """A crawl that reached the pages of even id, merged into state: untouched rows stay."""
    none = F.lit(None).cast("string")
    rows = L.first_by(classified(spark, d).where("page_id % 2 = 0"), ["url_key"], ["page_id"])
    rows = rows.select("url_key", "prev", none.alias("etag"), none.alias("last_modified"), none.alias("gmina"), none.alias("title"), F.col("canonical").alias("url"), "keyword", none.alias("att_sig"), "status")
    old = remembered(read(spark, d, "pages"))
    old = old.select([F.col(c) if c in old.columns else F.lit(None).cast("array<string>" if c == "keywords" else "string").alias(c) for c in state.FIELDS])
    return state.merge(old, state.record(rows, F.lit(AS_OF).cast("timestamp_ntz"))).select("url_key", "status", "found_at", "last_checked")


@query(f"WITH {PARTS} SELECT DISTINCT page_id, unnest([url_key, sha1('https://' || site || p)]) AS url_key FROM k")
def q25_alias_rows(spark, d):
    rows = keyed(read(spark, d, "pages").select("page_id", "url")).withColumn("final_key", F.sha1(F.concat(F.lit("https://"), "site", U.path("url"))))
    return state.aliases(rows).select("page_id", "url_key")


@query(f"WITH {PARTS}, {LINKS}, {ATT} SELECT page_id, array_to_string(list_filter(a, lambda x: NOT list_contains(a[1:1], x)), ' ') AS added FROM att")
def q26_att_diff(spark, d):
    rows = read(spark, d, "pages").select("page_id", H.attachments("html", "url", ENDS).alias("a")).where("size(a) > 0")
    before = H.deserialize(H.serialize(F.slice("a", 1, 1)))
    return rows.select("page_id", F.array_join(F.array_except("a", before), " ").alias("added"))


GENERIC = f"(contains(l, 'biuletyn informacji publicznej') OR l = 'bip' OR (length(l) <= 6 AND contains(l, 'bip')) OR length(l) < 8 OR {instr('l', C.IGNORED_ANCHORS)})"


@query(rf"""WITH {PARTS}, {PREV}, {LINKS},
c AS (SELECT page_id, pos, anchor, lower(anchor) l, lower(anchor || ' ' || regexp_extract(url, '([^/]*)$', 1)) b, regexp_extract(url, '^[a-z]+://([^/]*)(.*)$', ['h','p']) r FROM links),
h AS (SELECT page_id, pos, {keyword_sql('b')} keyword, 'https://' || regexp_replace(lower(r.h), '^www\.', '') || r.p AS url FROM c WHERE NOT {GENERIC})
SELECT url, page_id, pos, keyword FROM h WHERE keyword IS NOT NULL AND sha1(url) NOT IN (SELECT url_key FROM prev) QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id, pos) = 1""")
def q27_link_hits(spark, d):
    pages = read(spark, d, "pages")
    hits = L.link_hits(all_links(pages), remembered(pages), config=C.WatchConfig(keywords=KEYS, strict=STRICT))
    return hits.select("url", "page_id", F.col("pos").cast("long").alias("pos"), "keyword")


@query(f"WITH {PARTS} SELECT page_id FROM k WHERE (site, canonical) NOT IN (SELECT site, canonical FROM k WHERE page_id % 7 = 0)")
def q28_dead_anti(spark, d):
    pages = keyed(read(spark, d, "pages").select("page_id", "url")).withColumnRenamed("site", "site_key")
    return state.not_dead(pages, pages.where("page_id % 7 = 0")).select("page_id")


KIND = "CASE WHEN status = 304 THEN 'not_modified' WHEN status = 200 AND value > 40 THEN 'blocked' WHEN event_type = 'view' THEN 'pdf' WHEN status <> 200 THEN 'http_err' WHEN length(props) < 9 THEN 'html' ELSE 'html' END"
STATUSES = "CASE event_type WHEN 'error' THEN 500 WHEN 'click' THEN 304 WHEN 'signup' THEN 404 ELSE 200 END"


@query(f"SELECT event_id, kind, CASE WHEN kind = 'not_modified' THEN 'HIT' WHEN kind = 'blocked' THEN 'BLOCKED' WHEN kind = 'html' THEN NULL WHEN status = 404 AND kind = 'http_err' THEN 'DEAD' WHEN status >= 500 AND kind <> 'pdf' THEN 'FAILED' END AS next FROM (SELECT *, {KIND} AS kind FROM (SELECT *, {STATUSES} AS status FROM events))")
def q29_response_class(spark, d):
    rows = read(spark, d, "events").withColumn("status", F.expr(STATUSES)).withColumn("ctype", F.when(F.col("event_type") == "view", "application/pdf").otherwise("text/html"))
    rows = rows.withColumn("kind", state.response_kind("status", "ctype", F.lit("https://a.pl/x"), "props", F.col("value") > 40, F.lit(True)))
    return rows.select("event_id", "kind", state.transition("kind", "status").alias("next"))


@query("SELECT user_id, count(*) reports FROM events WHERE event_type = 'error' GROUP BY user_id HAVING count(*) > 3")
def q30_error_counts(spark, d):
    rows = read(spark, d, "events").select("user_id", F.when(F.col("event_type") == "error", 403).otherwise(200).alias("status"), F.lit("html").alias("kind"))
    return diagnostics.problem_hosts(rows, "user_id")


@query("SELECT user_id, event_id, n FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) n FROM events WHERE event_type = 'error') WHERE n <= 60")
def q31_first_n_errors(spark, d):
    rows = read(spark, d, "events").where("event_type = 'error'")
    return diagnostics.error_samples(rows, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", F.col("n").cast("long").alias("n"))


@query("SELECT event_id, count(*) OVER w = 8 AND min((event_type <> 'signup')::INT) OVER w = 1 AS all_bad FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)")
def q32_rolling_all(spark, d):
    return diagnostics.all_of_last(read(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") != "signup").select("event_id", "all_bad")


@query(f"WITH {PARTS} SELECT DISTINCT site, url AS loc FROM k")
def q33_sitemap(spark, d):
    """Sitemaps made of the pages of each site, at most 1,000 a file, parsed again."""
    xml = F.concat(F.lit("<url><loc>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>"))
    files = keyed(read(spark, d, "pages").select("page_id", "url")).groupBy("site", F.floor(F.col("page_id") / 1000).alias("part")).agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list(xml), "\n"), F.lit("</urlset>")).alias("body"))
    return files.where(X.looks_like_sitemap("body")).select("site", F.explode(X.raw_locs("body")).alias("loc")).distinct()


@query(f"WITH {PARTS} SELECT page_id, s || '://' || h || '/map.xml' AS sitemap FROM k")
def q34_robots(spark, d):
    body = F.concat(F.lit("User-agent: *\r\nDisallow: /x\r\nSITEMAP:  "), U.scheme("url"), F.lit("://"), U.netloc("url"), F.lit("/map.xml\r\nsitemap: nowhere\r\nSitemap: "), U.scheme("url"), F.lit("://"), U.netloc("url"), F.lit("/map.xml"))
    return read(spark, d, "pages").select("page_id", F.explode(X.sitemaps_in_robots(body)).alias("sitemap"))


@query(rf"""WITH {PARTS}, hosts AS (SELECT DISTINCT s, h FROM k),
sch AS (SELECT s, h, unnest(list_filter([s, 'https', 'http'], lambda x, i: i = list_position([s, 'https', 'http'], x))) sch, generate_subscripts(list_filter([s, 'https', 'http'], lambda x, i: i = list_position([s, 'https', 'http'], x)), 1) i FROM hosts),
ho AS (SELECT *, unnest(CASE WHEN starts_with(lower(h), 'www.') THEN [lower(h), lower(h)[5:]] ELSE [lower(h), 'www.' || lower(h)] END) host, unnest([1, 2]) j FROM sch),
pa AS (SELECT s, h, i, j, sch || '://' || host || unnest(list_concat(flatten(list_transform({quoted(('/', *C.START_PATHS))}, lambda p: CASE WHEN ends_with(p, '/') THEN [p] ELSE [p, p || '/'] END)), {quoted(C.START_HINTS)})) u, generate_subscripts(list_concat(flatten(list_transform({quoted(('/', *C.START_PATHS))}, lambda p: CASE WHEN ends_with(p, '/') THEN [p] ELSE [p, p || '/'] END)), {quoted(C.START_HINTS)}), 1) n FROM ho),
f AS (SELECT s, h, u, i, j, n FROM pa QUALIFY row_number() OVER (PARTITION BY s, h, u ORDER BY i, j, n) = 1)
SELECT s || '://' || h AS site, u AS candidate, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY s, h ORDER BY i, j, n) - 1 AS ordinal FROM f) WHERE ordinal < 16""")
def q35_start_candidates(spark, d):
    sites = read(spark, d, "pages").select(F.concat(U.scheme("url"), F.lit("://"), U.netloc("url")).alias("url")).distinct()
    return crawl.start_candidates(sites).select(F.col("url").alias("site"), "candidate", F.col("ordinal").cast("long").alias("ordinal"))


@query(f"WITH {PARTS}, {LINKS} SELECT url, max(CASE WHEN {instr('lower(url)', C.SEED_HINTS)} THEN 18 ELSE 10 END) AS score FROM links GROUP BY url")
def q36_seed_scores(spark, d):
    return L.seed_scores(all_links(read(spark, d, "pages")))


EDGES = "e AS (SELECT page_id src, (page_id * 7 + 3) % (SELECT count(*) FROM pages) dst FROM pages UNION SELECT page_id, (page_id * page_id + 1) % (SELECT count(*) FROM pages) FROM pages)"


def edges(spark, d) -> tuple[DataFrame, DataFrame]:
    pages = read(spark, d, "pages").select("page_id")
    n = pages.count()
    at = F.col("page_id")
    both = F.explode(F.array((at * 7 + 3) % n, (at * at + 1) % n))
    return pages.select(at.alias("src"), both.alias("dst")).distinct(), pages.where("page_id = 1").select(at.alias("node"))


@query(f"WITH RECURSIVE {EDGES}, r AS (SELECT 1::BIGINT node UNION SELECT dst FROM r JOIN e ON src = node) SELECT node FROM r")
def q37_discovery(spark, d):
    return crawl.reach(*edges(spark, d)).select("node")


@query(f"WITH RECURSIVE {EDGES}, r AS (SELECT 1::BIGINT node, 0 AS depth UNION SELECT dst, depth + 1 FROM r JOIN e ON src = node WHERE depth < 4) SELECT node, min(depth) AS depth FROM r GROUP BY node")
def q38_crawl_depth4(spark, d):
    return crawl.reach(*edges(spark, d), depth=4)


@query("""WITH s AS (SELECT user_id, CASE WHEN count_if(event_type = 'view') = 0 THEN 'START_FAIL' WHEN count_if(event_type = 'error') > 20 THEN 'WORKER_ERROR' WHEN max(value) > 200 THEN 'INCOMPLETE' ELSE 'OK' END status FROM events GROUP BY user_id)
SELECT count(*) total, count_if(status = 'OK')::BIGINT ok, count_if(status = 'START_FAIL')::BIGINT start_fail FROM s""")
def q39_diag_summary(spark, d):
    kind = F.col("event_type")
    sites = read(spark, d, "events").groupBy("user_id").agg((F.count_if(kind == "view") > 0).alias("started"), (F.count_if(kind == "error") > 20).alias("failed"), (F.max("value") > 200).alias("stopped"))
    return diagnostics.summary(diagnostics.site_status(sites))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def q40_json_props(spark, d):
    return read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(f"WITH {PARTS} SELECT site, count(*) pages FROM k GROUP BY site ORDER BY pages DESC, site LIMIT 20")
def q41_top_sites(spark, d):
    return keyed(read(spark, d, "pages").select("page_id", "url")).groupBy("site").agg(F.count("*").alias("pages")).orderBy(F.desc("pages"), "site").limit(20)


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def q42_session_dedup(spark, d):
    return L.first_by(read(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("SELECT user_id, event_type, count(*) n FROM events GROUP BY ALL")
def q43_counter_maps(spark, d):
    """Counter maps per site, taken apart again."""
    maps = diagnostics.counts(read(spark, d, "events"), ["user_id"], "event_type")
    return maps.select("user_id", F.explode("counts").alias("event_type", "n"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY part, rank, event_id) AS order_rank FROM (SELECT *, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END part, CASE WHEN event_type = 'error' THEN -event_id ELSE event_id END rank FROM events)")
def q44_work_queue(spark, d):
    """Retries first and in reverse, then the frontier."""
    rows = read(spark, d, "events").select(F.col("user_id").cast("string").alias("site_key"), F.concat(F.lit("https://a.pl/"), F.col("event_id")).alias("url"), F.lit(0).alias("depth"), F.col("event_id").alias("pos"), "event_type")
    none = rows.where("false").select("site_key", "url", "pos")
    out = state.queue(rows.where("event_type = 'error'").select("site_key", "url", "pos"), rows.where("event_type <> 'error'").drop("event_type"), none, C.WatchConfig(retries=2**62))
    return out.select(F.regexp_extract("url", r"(\d+)$", 1).cast("long").alias("event_id"), F.col("order_rank").cast("long").alias("order_rank"))


@query()
def s01_stateful_recheck(spark, d):
    """The recheck gate over the event stream, run to its end; the batch twin is in the tests."""
    ship(spark)
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    rows = stream.select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "error", "FAILED").otherwise("NO_MATCH").alias("status"))
    out = shared_dir(spark)
    R.recheck(rows, {"FAILED": 120, "NO_MATCH": 1440}).writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "_state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(R.OUT).parquet(out)


# ---- hand-made pages beside the tables: forms that the tables don't hold. What they must give is written out in the SQL.
SITE = [
    (-1, "https://www.f.pl/a/begin.html", '<title>T &oacute;</title><h2>Two &#380;</h2><h3>Three</h3><meta name="description" content="About &quot;it&quot;"><a href="one.html">First page</a> <a href=\'../two/\'>Second page</a><a href="https://other.net/x">Elsewhere</a><a href="my plan.pdf">The plan</a><a href=?p=2>Next sheet</a>'),
    (-2, "https://www.f.pl/a/one.html", '<h1> </h1><p class="big page-title">Selected heading</p><a href=../two/./three.html>Third page</a><a href="begin.html#top">Back again</a><a href="/up/../up.PDF">Upper file</a>'),
    (-3, "https://www.f.pl/two/three.html", '<a href="//f.pl/four">Fourth page</a><a title="a>b" href="four/">Within four'),
    (-4, "https://f.pl/four", '<a href="five.html">Fifth page</a><a href="/four">Same page</a>'),
    (-5, "https://f.pl/five.html", '<a href="six.html">Sixth page</a>'),
    (-6, "https://f.pl/six.html", '<a href="seven.html">Seventh page</a><a href="mailto:a@f.pl">Write to us</a>'),
]


def with_fixtures(spark, d) -> DataFrame:
    return read(spark, d, "pages").select("page_id", "url", "html").unionByName(spark.createDataFrame(SITE, "page_id long, url string, html string"))


@query(f"""WITH {PARTS}, {LINKS} SELECT page_id, url, anchor, pos FROM links UNION ALL (VALUES
(-1, 'https://www.f.pl/a/one.html', 'First page', 0), (-1, 'https://www.f.pl/two/', 'Second page', 1), (-1, 'https://other.net/x', 'Elsewhere', 2), (-1, 'https://www.f.pl/a/my plan.pdf', 'The plan', 3), (-1, 'https://www.f.pl/a/begin.html?p=2', 'Next sheet', 4),
(-2, 'https://www.f.pl/two/three.html', 'Third page', 0), (-2, 'https://www.f.pl/a/begin.html', 'Back again', 1), (-2, 'https://www.f.pl/up.PDF', 'Upper file', 2),
(-3, 'https://f.pl/four', 'Fourth page', 0), (-3, 'https://www.f.pl/two/four/', 'Within four', 1), (-4, 'https://f.pl/five.html', 'Fifth page', 0), (-4, 'https://f.pl/four', 'Same page', 1), (-5, 'https://f.pl/six.html', 'Sixth page', 0), (-6, 'https://f.pl/seven.html', 'Seventh page', 0))""")
def q45_links_of_any_form(spark, d):
    """References of every form: relative, with dot segments, of a query alone, with blanks, bare, and of other schemes."""
    return all_links(with_fixtures(spark, d)).select("page_id", "url", "anchor", F.col("pos").cast("long").alias("pos"))


@query(f"""SELECT page_id, title, h1, '' AS h2, trim(title || ' ' || h1) AS blob FROM (SELECT page_id, {TAG('title')} title, {TAG('h1')} h1 FROM pages) UNION ALL (VALUES
(-1, 'T ó', '', 'Two ż', 'T ó Two ż Three About "it"'), (-2, '', 'Selected heading', '', 'Selected heading'), (-3, '', '', '', ''), (-4, '', '', '', ''), (-5, '', '', '', ''), (-6, '', '', '', ''))""")
def q46_headings(spark, d):
    """Title, headings and their blob, with character references, h3, description and headings by selector."""
    return with_fixtures(spark, d).select("page_id", H.headings("html").alias("x")).select("page_id", "x.title", "x.h1", "x.h2", "x.blob")


@query(f"""WITH {PARTS}, {LINKS},
f0 AS (SELECT a.page_id, l.url, min(pos) AS pos FROM k a JOIN k b ON a.normalized = b.normalized JOIN links l ON l.page_id = b.page_id
 WHERE l.url <> a.normalized AND length(lower(anchor)) > 2 AND NOT {instr('lower(anchor)', C.IGNORED_ANCHORS)} AND len(list_filter({quoted(C.ATTACHMENTS)}, lambda e: ends_with(lower(l.url), e))) = 0 GROUP BY ALL),
f AS (SELECT page_id, url, row_number() OVER (PARTITION BY page_id ORDER BY pos, url) + 1 AS ordinal FROM f0)
SELECT page_id::VARCHAR AS site_key, normalized AS url, 0 AS depth, 1::BIGINT AS ordinal FROM k UNION ALL SELECT page_id::VARCHAR, url, 1, ordinal FROM f UNION ALL (VALUES
('-1', 'https://www.f.pl/a/begin.html', 0, 1), ('-1', 'https://www.f.pl/a/one.html', 1, 2), ('-1', 'https://www.f.pl/two/', 1, 3), ('-1', 'https://www.f.pl/a/begin.html?p=2', 1, 4), ('-1', 'https://www.f.pl/two/three.html', 2, 5),
('-1', 'https://f.pl/four', 3, 6), ('-1', 'https://www.f.pl/two/four/', 3, 7), ('-1', 'https://f.pl/five.html', 4, 8), ('-1', 'https://f.pl/six.html', 5, 9), ('-1', 'https://f.pl/seven.html', 6, 10))""")
def q47_site_discovery(spark, d):
    """First phase over extracted links: each page of the table starts a site of its own, and one hand-made site has a cycle and depth 6."""
    pages = with_fixtures(spark, d)
    starts = pages.where("page_id >= -1").select(F.col("page_id").cast("string").alias("site_key"), "url")
    links = all_links(pages).withColumn("base", U.normalize_url("base"))
    return crawl.discover(links, starts).select("site_key", "url", "depth", "ordinal")


@query(f"""WITH {PARTS}, {LINKS},
c AS (SELECT l.page_id, 'https://' || regexp_replace(lower(regexp_extract(l.url, '^[a-z]+://([^/]*)', 1)), '^www\\.', '') || regexp_extract(l.url, '^[a-z]+://[^/]*(.*)$', 1) AS url, canonical FROM links l JOIN (SELECT page_id, canonical FROM k) USING (page_id))
SELECT DISTINCT page_id::VARCHAR AS site_key, canonical AS url, 0 AS depth FROM k UNION ALL SELECT DISTINCT page_id::VARCHAR, url, 1 FROM c WHERE url <> canonical AND page_id NOT IN (SELECT page_id FROM (SELECT page_id, count(*) OVER (PARTITION BY url_key) n FROM k) WHERE n > 1)
UNION ALL SELECT DISTINCT k.page_id::VARCHAR, c.url, 1 FROM k JOIN c ON k.canonical = c.canonical WHERE c.url <> k.canonical AND k.page_id IN (SELECT page_id FROM (SELECT page_id, count(*) OVER (PARTITION BY url_key) n FROM k) WHERE n > 1)
UNION ALL (VALUES ('-1', 'https://f.pl/a/begin.html', 0), ('-1', 'https://f.pl/a/one.html', 1), ('-1', 'https://f.pl/two', 1), ('-1', 'https://f.pl/a/my plan.pdf', 1), ('-1', 'https://f.pl/a/begin.html?p=2', 1), ('-1', 'https://f.pl/two/three.html', 2), ('-1', 'https://f.pl/up.PDF', 2),
('-1', 'https://f.pl/four', 3), ('-1', 'https://f.pl/two/four', 3), ('-1', 'https://f.pl/five.html', 4))""")
def q48_site_crawl(spark, d):
    """Second phase over extracted links, canonical, within the site, to depth 4."""
    pages = with_fixtures(spark, d)
    queue = pages.where("page_id >= -1").select(F.col("page_id").cast("string").alias("site_key"), U.canonical_url("url").alias("url"))
    links = crawl.site_links(all_links(pages), queue.select("site_key", U.netloc("url").alias("host")))
    return crawl.crawl(links, queue).select("site_key", "url", "depth")


WORDS = ["Projekt MPZP dla obrębu", "złoze", "plan og&oacute;lny", "Plan   Ogólny gminy i miejscowy plan", "farma wiatrowa", "wiatraki", "oze.", "wz", None]


@query(r"""WITH b AS (SELECT doc_id, trim(regexp_replace(lower(text), '[\s\x{a0}]+', ' ', 'g')) b FROM documents)
SELECT doc_id, CASE """ + " ".join(f"WHEN regexp_matches(b, '(^|[^\\pL\\pN_]){k}([^\\pL\\pN_]|$)') THEN '{k}'" if k in C.STRICT or len(k) <= 3 else f"WHEN contains(b, '{k.lower()}') THEN '{k}'" for k in C.KEYWORDS) + """ END AS keyword FROM b UNION ALL (VALUES
(-1, 'mpzp'), (-2, NULL), (-3, NULL), (-4, 'miejscowy plan'), (-5, 'farma wiatrowa'), (-6, 'wiatr'), (-7, 'oze'), (-8, NULL), (-9, NULL))""")
def q49_default_keywords(spark, d):
    """The default keywords, which the tables don't hold, over all documents and a few sentences that do."""
    more = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(WORDS)], "doc_id long, text string")
    return read(spark, d, "documents").select("doc_id", "text").unionByName(more).select("doc_id", X.keyword("text").alias("keyword"))


MARKED = [(-1, "<p>Zbyt du\u017co jednoczesnych po\u0142\u0105cze\u0144</p>"), (-2, "<p>Service Unavailable</p>"), (-3, "<p>Service Unavailable</p>" + "long text " * 80), (-4, "<p style='color:#13aabb'>x</p>"), (-5, None), (-6, "<p>fine</p>")]


@query(f"SELECT page_id, {instr('lower(html)', C.BLOCK_MARKERS)} OR (length({TEXT}) < 600 AND regexp_matches(left(lower(html), 4000), '" + "|".join(C.BLOCK_PHRASES) + "')) AS blocked FROM pages UNION ALL (VALUES (-1, true), (-2, true), (-3, false), (-4, true), (-5, false), (-6, false))")
def q50_default_block_markers(spark, d):
    pages = read(spark, d, "pages").select("page_id", "html").unionByName(spark.createDataFrame(MARKED, "page_id long, html string"))
    return pages.select("page_id", X.is_block_page("html", H.visible_text("html")).alias("blocked"))


NOISY = ["a Wygenerowano: 2024-01-02 03:04:05 b Odsłon: 12", "WYGENEROWANO: 3 stycznia 2024 r. 3:04:05 x", "odsłony: 7 pobrań:3  y", "bez zmian"]


@query("SELECT doc_id, " + COLLAPSE.format(x="regexp_replace(" * len(C.NOISE) + "text" + "".join(f", '(?i){p}', '', 'g')" for p in C.NOISE)) + " AS clean FROM documents UNION ALL (VALUES (-1, 'a b'), (-2, 'x'), (-3, 'y'), (-4, 'bez zmian'))")
def q51_default_noise(spark, d):
    more = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(NOISY)], "doc_id long, text string")
    return read(spark, d, "documents").select("doc_id", "text").unionByName(more).select("doc_id", X.strip_noise("text").alias("clean"))


ANSWERS = f"""a AS (SELECT *, 'https://s' || user_id || '.pl/e' || event_id AS url, 'https://s' || user_id || '.pl/e' || event_id || CASE WHEN event_id % 4 = 0 THEN '/f' ELSE '' END AS final,
 CASE WHEN kind = 'not_modified' THEN 'HIT' WHEN kind = 'blocked' THEN 'BLOCKED' WHEN kind = 'html' THEN NULL WHEN status = 404 AND kind = 'http_err' THEN 'DEAD' WHEN status >= 500 AND kind <> 'pdf' THEN 'FAILED' END AS next FROM (SELECT *, {KIND} AS kind FROM (SELECT *, {STATUSES} AS status FROM events))),
st AS (SELECT sha1(url) k, 'own' title FROM a WHERE event_id % 3 = 0 UNION ALL SELECT sha1(final), 'final' FROM a WHERE event_id % 20 = 0)"""


def answers(spark, d) -> tuple[DataFrame, DataFrame]:
    """Responses made of the events, a quarter of them redirected; and remembered state of a third of the requested and a few final pages."""
    rows = read(spark, d, "events").withColumn("status", F.expr(STATUSES)).withColumn("ctype", F.when(F.col("event_type") == "view", "application/pdf").otherwise("text/html"))
    rows = rows.withColumn("kind", state.response_kind("status", "ctype", F.lit("https://a.pl/x"), "props", F.col("value") > 40, F.lit(True)))
    url = F.concat(F.lit("https://s"), "user_id", F.lit(".pl/e"), "event_id")
    rows = rows.withColumn("url", url).withColumn("final_url", F.when(F.col("event_id") % 4 == 0, F.concat("url", F.lit("/f"))).otherwise(F.col("url")))
    rows = rows.select("event_id", F.col("user_id").cast("string").alias("site_key"), F.lit("g").alias("gmina"), "url", "final_url", "kind", "status")
    known = rows.where("event_id % 3 = 0").select("url", F.lit("own").alias("title")).unionByName(rows.where("event_id % 20 = 0").select(F.col("final_url").alias("url"), F.lit("final").alias("title")))
    old = known.select(U.url_key("url").alias("url_key"), F.lit("2023-12-01T00:00:00").alias("found_at"), F.lit("2023-12-02T00:00:00").alias("last_checked"), F.lit("e").alias("etag"), F.lit("m").alias("last_modified"), F.lit("g").alias("gmina"), "title", "url", F.array(F.lit("oze")).alias("keywords"), F.lit("[]").alias("att_sig"), F.lit("NOWE").alias("status"))
    return rows, old


@query(f"""WITH {ANSWERS}, j AS (SELECT a.*, o.title own, f.title fin FROM a LEFT JOIN st o ON o.k = sha1(a.url) LEFT JOIN st f ON f.k = sha1(a.final)),
bad AS (SELECT unnest(list_distinct([sha1(url), sha1(final)])) url_key, next status, CASE WHEN coalesce(fin, own) IS NULL THEN '2024-02-01T00:00:00' ELSE '2023-12-01T00:00:00' END found_at, '2024-02-01T00:00:00' last_checked, '' etag, coalesce(fin, own, '') title, final url, CASE WHEN coalesce(fin, own) IS NULL THEN '' ELSE 'oze' END keywords FROM j WHERE next IN ('BLOCKED', 'FAILED')),
hit AS (SELECT sha1(final) url_key, fin title, final url FROM j WHERE next = 'HIT' AND fin IS NOT NULL UNION SELECT sha1(url), coalesce(own, fin), CASE WHEN own IS NULL THEN final ELSE url END FROM j WHERE next = 'HIT' AND coalesce(own, fin) IS NOT NULL)
SELECT * FROM bad UNION ALL SELECT url_key, 'HIT', '2023-12-01T00:00:00', '2024-02-01T00:00:00', 'e', title, url, 'oze' FROM hit""")
def q52_outcomes(spark, d):
    """State rows of responses without a page: what was known is kept, validators are cleared on failure, both keys are written."""
    rows, old = answers(spark, d)
    delta = state.outcomes(rows, state_first(old), F.lit(AS_OF).cast("timestamp_ntz"))["delta"]
    return delta.select("url_key", "status", "found_at", "last_checked", "etag", "title", "url", F.array_join("keywords", " ").alias("keywords"))


def state_first(old: DataFrame) -> DataFrame:
    return L.first_by(old, ["url_key"], ["title"])


@query(f"WITH {ANSWERS} SELECT DISTINCT CASE WHEN next = 'DEAD' THEN 'dead' ELSE 'retry' END AS list, user_id::VARCHAR AS site_key, final AS url FROM a WHERE next IN ('BLOCKED', 'FAILED', 'DEAD') AND NOT (next <> 'DEAD' AND event_id % 10 = 0)")
def q53_retry_and_dead(spark, d):
    """New entries of the retry and dead lists; a tenth of the addresses had been queued before."""
    rows, old = answers(spark, d)
    out = state.outcomes(rows, state_first(old), F.lit(AS_OF).cast("timestamp_ntz"))
    known = rows.where("event_id % 10 = 0").select("site_key", F.col("final_url").alias("url"))
    retry = state.retry_rows(out["retry"], known).select(F.lit("retry").alias("list"), "site_key", "url")
    return retry.unionByName(state.dead_rows(out["dead"], known.where("false")).select(F.lit("dead").alias("list"), "site_key", "url"))


@query("SELECT site_key, url, depth, row_number() OVER (PARTITION BY site_key ORDER BY depth, url) - 1 AS pos FROM (SELECT user_id::VARCHAR site_key, 'https://a.pl/' || event_id AS url, (event_id % 7)::INT AS depth, event_type FROM events) WHERE depth <= 4 AND event_type <> 'view'")
def q54_frontier(spark, d):
    """What a stopped run saves: found, not too deep, not fetched."""
    rows = read(spark, d, "events").select(F.col("user_id").cast("string").alias("site_key"), F.concat(F.lit("https://a.pl/"), "event_id").alias("url"), (F.col("event_id") % 7).cast("int").alias("depth"), "event_type")
    return state.frontier_rows(rows, rows.where("event_type = 'view'")).withColumn("pos", F.col("pos").cast("long"))


@query("""WITH c AS (SELECT user_id::VARCHAR site_key, 'https://old/' AS start_final, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') ts, ['a', 'b'] seeds, max(ts) checked FROM events GROUP BY user_id),
p AS (SELECT site_key, CASE WHEN site_key::INT % 5 = 0 THEN 'https://new/' ELSE start_final END AS start_final, CASE WHEN site_key::INT % 5 = 0 THEN 1 ELSE 2 END::INT n, CASE WHEN site_key::INT % 5 = 0 THEN TIMESTAMP '2024-02-01' ELSE checked END AS checked FROM c)
SELECT DISTINCT e.user_id::VARCHAR AS site_key, p.start_final, n AS seeds FROM events e LEFT JOIN p ON p.site_key = e.user_id::VARCHAR AND checked >= TIMESTAMP '2024-02-29 12:00:00' - INTERVAL 30 DAY""")
def q55_seed_cache(spark, d):
    """Seed sets stored, some renewed, then looked up when the older ones are stale."""
    events = read(spark, d, "events").withColumn("site_key", F.col("user_id").cast("string"))
    stamp = F.date_format(F.max("ts"), "yyyy-MM-dd'T'HH:mm:ss")
    old = events.groupBy("site_key").agg(stamp.alias("ts")).select("site_key", F.lit("h").alias("allowed_host"), F.lit("https://old/").alias("start_final"), F.array(F.lit("a"), F.lit("b")).alias("seeds"), "ts")
    new = old.where("int(site_key) % 5 = 0").withColumn("start_final", F.lit("https://new/")).withColumn("seeds", F.array(F.lit("a")))
    cache = state.seed_cache_put(old, new, F.lit(AS_OF).cast("timestamp_ntz"))
    return state.seed_cache_get(events.select("site_key").distinct(), cache, F.lit("2024-02-29 12:00:00").cast("timestamp_ntz")).select("site_key", "start_final", F.when(F.col("seeds").isNotNull(), F.size("seeds")).alias("seeds"))


@query(f"WITH {PARTS}, m AS (SELECT DISTINCT url_key FROM k WHERE p NOT IN ('', '/') AND NOT {instr('lower(url)', C.LISTING)}) SELECT url_key, '2024-02-01T00:00:00' AS seen_at FROM m UNION ALL SELECT DISTINCT sha1(user_id::VARCHAR), '2024-01-01T00:00:00' FROM events")
def q56_mark_seen(spark, d):
    """Keys of fetched pages beside those that an earlier run had marked."""
    seen = read(spark, d, "events").select(F.sha1(F.col("user_id").cast("string")).alias("url_key")).distinct().withColumn("seen_at", F.lit(""))
    seen = state.with_times(seen, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    return state.mark_seen(seen, read(spark, d, "pages").select("url"), F.lit(AS_OF).cast("timestamp_ntz"))


MAPS = [
    ("https://m.pl/robots.txt", 200, "text/plain", "User-agent: *\nSitemap: https://www.m.pl/main.xml\nsitemap:https://m.pl/main.xml#again"),
    ("https://www.m.pl/main.xml", 200, "text/html", "<sitemapindex><sitemap><loc>https://m.pl/a.xml</loc></sitemap><sitemap><loc>nowhere</loc></sitemap></sitemapindex>"),
    ("https://m.pl/a.xml", 200, "application/xml", "<loc>https://m.pl/1</loc><loc>https://www.m.pl/1/</loc><loc>https://m.pl/2?utm_source=x</loc>"),
    ("https://m.pl/sitemap-index.xml", 200, "text/xml", "<urlset><url><loc>https://m.pl/3</loc></url></urlset>"),
    ("https://m.pl/sitemap.xml", 404, "text/xml", "<urlset><url><loc>https://m.pl/gone</loc></url></urlset>"),
    ("https://m.pl/sitemap_index.xml", 200, "text/html", "<html>no sitemap</html>"),
]


@query(f"WITH {PARTS}, f AS (SELECT s || '://' || h AS base, canonical, normalized, page_id FROM k) SELECT base AS site_key, arg_min(normalized, page_id) AS url, row_number() OVER (PARTITION BY base ORDER BY min(page_id)) AS ordinal FROM f GROUP BY base, canonical UNION ALL (VALUES ('https://m.pl', 'https://m.pl/3', 1), ('https://m.pl', 'https://m.pl/1', 2), ('https://m.pl', 'https://m.pl/2', 3))")
def q57_sitemap_collection(spark, d):
    """Robots and nested sitemaps of every host, made of its pages; and a hand-made site with an index, a malformed file and a missing one."""
    pages = read(spark, d, "pages").select("page_id", "url", F.concat(U.scheme("url"), F.lit("://"), U.netloc("url")).alias("base"))
    xml = F.concat(F.lit("<url><loc>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>"))
    files = pages.groupBy("base").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", xml.alias("x")))), lambda e: e["x"]), "").alias("x"))
    files = files.select(F.concat("base", F.lit("/sitemap.xml")).alias("url"), F.lit(200).alias("status"), F.lit("text/xml").alias("ctype"), F.concat(F.lit("<urlset>"), "x", F.lit("</urlset>")).alias("body"))
    responses = files.unionByName(spark.createDataFrame(MAPS, "url string, status int, ctype string, body string"))
    roots = pages.select(F.col("base").alias("site_key"), "base").distinct().unionByName(spark.createDataFrame([("https://m.pl", "https://m.pl")], "site_key string, base string"))
    return crawl.sitemap_urls(responses, roots, most=2**31 - 1).withColumn("ordinal", F.col("ordinal").cast("long"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) n, count(*) OVER (PARTITION BY user_id) c FROM events) SELECT user_id, n - 1 AS n, 'start_attempts=' || c AS line FROM r WHERE n = 1 UNION ALL SELECT user_id, n, lpad(n::VARCHAR, 2, '0') || ') kind=' || event_type || ' status=403 ms=None url=https://a.pl/' || event_id FROM r WHERE n <= 8")
def q58_start_report(spark, d):
    rows = read(spark, d, "events").select("user_id", "event_id", F.col("event_type").alias("kind"), F.lit(403).alias("status"), F.lit(None).cast("int").alias("ms"), F.concat(F.lit("https://a.pl/"), "event_id").alias("try_url"))
    return diagnostics.start_fail_report(rows, "user_id", "event_id").withColumn("n", F.col("n").cast("long"))


@query(f"""{STATUS}, new AS (SELECT url_key, status, coalesce(found_at, '2024-02-01T00:00:00') found_at, '2024-02-01T00:00:00' last_checked FROM res QUALIFY row_number() OVER (PARTITION BY url_key ORDER BY page_id) = 1)
SELECT * FROM new UNION ALL SELECT DISTINCT sha1('gone' || user_id), 'HIT', '2023-12-01T00:00:00', '2024-01-31T00:00:00' FROM events""")
def q59_state_merge_all(spark, d):
    """Every page merged into state, which also holds addresses that no page has; those stay untouched."""
    none = F.lit(None).cast("string")
    rows = L.first_by(classified(spark, d), ["url_key"], ["page_id"])
    rows = rows.select("url_key", "prev", none.alias("etag"), none.alias("last_modified"), none.alias("gmina"), none.alias("title"), F.col("canonical").alias("url"), "keyword", none.alias("att_sig"), "status")
    gone = read(spark, d, "events").select(F.sha1(F.concat(F.lit("gone"), "user_id")).alias("url_key"), F.lit("2024-01-31T00:00:00").alias("last_checked"), F.lit("2023-12-01T00:00:00").alias("found_at"), none.alias("url"), F.lit("HIT").alias("status")).distinct()
    old = remembered(read(spark, d, "pages")).unionByName(gone)
    old = old.select([F.col(c) if c in old.columns else F.lit(None).cast("array<string>" if c == "keywords" else "string").alias(c) for c in state.FIELDS])
    return state.merge(old, state.record(rows, F.lit(AS_OF).cast("timestamp_ntz"))).select("url_key", "status", "found_at", "last_checked")
