"""URL functions as column expressions; all stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C

PARTS = r"(?s)^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def any_of(text: Column, needles) -> Column:
    """One alternation, so that a value is scanned once."""
    return text.rlike("|".join(re.escape(n) for n in needles))


def bound(x: Column, of) -> Column:
    """of(x) with x evaluated once, however often `of` uses it."""
    return F.element_at(F.transform(F.array(x), of), 1)


def parts(u) -> Column:
    """[scheme, host, path, query] by one match."""
    return F.split(F.regexp_replace(col(u), PARTS, "$1\x01$2\x01$3\x01$4"), "\x01")


def scheme(u) -> Column:
    return F.lower(F.regexp_extract(col(u), PARTS, 1))


def netloc(u) -> Column:
    return F.regexp_extract(col(u), PARTS, 2)


def path(u) -> Column:
    return F.regexp_extract(col(u), PARTS, 3)


def query(u) -> Column:
    return F.regexp_extract(col(u), PARTS, 4)


def decode(x: Column) -> Column:
    return F.coalesce(F.try_url_decode(x), F.replace(x, F.lit("+"), F.lit(" ")))


def encode(x: Column) -> Column:
    return F.replace(F.replace(F.url_encode(x), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def clean_query(q: Column, blank: tuple[str, ...] = (), drop: bool = True) -> Column:
    """Pairs with lower-case trimmed keys, without tracking keys, stably sorted by key, encoded again; values of `blank` keys emptied."""
    pairs = F.filter(F.split(q, "&"), lambda p: p != "")
    pairs = F.transform(pairs, lambda p, i: F.struct(F.lower(F.trim(decode(F.substring_index(p, "=", 1)))).alias("k"), i.alias("i"), decode(F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, "^[^=]*=", "")).otherwise(F.lit(""))).alias("v")))
    keep = lambda p: (p["k"] != "") & ~F.startswith(p["k"], F.lit("utm_")) & ~p["k"].isin(*C.TRACKING)
    pairs = F.array_sort(F.filter(pairs, keep if drop else (lambda p: p["k"] != "")))
    value = lambda p: F.when(p["k"].isin(*blank), F.lit("")).otherwise(p["v"]) if blank else p["v"]
    return F.array_join(F.transform(pairs, lambda p: F.concat(encode(p["k"]), F.lit("="), encode(value(p)))), "&")


def build(s: Column, host: Column, p: Column, q: Column) -> Column:
    return F.concat(F.when(s != "", F.concat(s, F.lit(":"))).otherwise(F.lit("")), F.when(host != "", F.concat(F.lit("//"), host)).otherwise(F.lit("")), p, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")))


def normalize_url(u) -> Column:
    """Fragment dropped, query cleaned."""
    return bound(parts(u), lambda x: build(F.lower(x[0]), x[1], x[2], clean_query(x[3])))


def without_www(host: Column) -> Column:
    return F.regexp_replace(host, r"^www\.", "")


def canonical_url(u) -> Column:
    """https, lower-case host without www., no fragment, no parameters of the last segment, one trailing slash stripped."""

    def of(x: Column) -> Column:
        p = F.regexp_replace(F.regexp_replace(x[2], r";[^/]*$", ""), r"(?<=.)/$", "")
        return build(F.lit("https"), without_www(F.lower(x[1])), F.when(p == "", F.lit("/")).otherwise(p), clean_query(x[3]))

    return bound(parts(F.trim(col(u))), of)


def url_key(u) -> Column:
    return F.sha1(canonical_url(u))


def sha1_key(u) -> Column:
    """Key of an address that is canonical already."""
    return F.sha1(col(u))


def is_home_url(u) -> Column:
    return path(u).isin("", "/")


def is_listing_url(u, needles=C.LISTING) -> Column:
    return any_of(F.lower(F.coalesce(col(u), F.lit(""))), needles)


def is_first_phase_listing(u) -> Column:
    return is_listing_url(u) | is_home_url(u)


def is_valid_url(u) -> Column:
    return F.coalesce(col(u).rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]+"), F.lit(False))


def url_is_ignored(u, needles=C.IGNORED_URLS) -> Column:
    return any_of(F.lower(F.coalesce(col(u), F.lit(""))), needles)


def ends_with_any(text: Column, ends) -> Column:
    return text.rlike("(?:" + "|".join(re.escape(e) for e in ends) + ")$")


def should_skip_href(u) -> Column:
    low = F.lower(F.coalesce(col(u), F.lit("")))
    return low.rlike("|".join(C.IGNORED_PATHS)) | url_is_ignored(u) | ends_with_any(low, C.BAD_EXTENSIONS) | ends_with_any(low, C.ATTACHMENTS)


def is_attachment(u, ends=C.ATTACHMENTS) -> Column:
    return ends_with_any(F.lower(F.coalesce(col(u), F.lit(""))), ends)


def base_domain(host) -> Column:
    """Two labels, or three below a second-level suffix such as com.pl."""
    h = without_www(F.lower(F.trim(col(host))))
    labels = F.split(h, r"\.")
    n = F.size(labels)
    three = F.element_at(labels, -1).isin("pl", "uk") & F.try_element_at(labels, F.lit(-2)).isin("com", "net", "org", "gov", "edu")
    return F.when(n <= 2, h).when(three, F.array_join(F.slice(labels, -3, 3), ".")).otherwise(F.array_join(F.slice(labels, -2, 2), "."))


def same_base_domain(a, b) -> Column:
    return (col(a) != "") & (col(b) != "") & (base_domain(a) == base_domain(b))


def site_key(name, url) -> Column:
    return F.sha1(F.concat_ws("|", F.lower(F.trim(col(name))), base_domain(netloc(url))))


def pagination_template(u) -> Column:
    """URL with the values of paging keys emptied: pages of one listing share it."""
    return build(scheme(u), netloc(u), path(u), clean_query(query(u), C.PAGING_KEYS, drop=False))


def filename(u) -> Column:
    return F.element_at(F.split(path(u), "/"), -1)


def www_variants(host) -> Column:
    h = F.lower(col(host))
    return F.when(h == "", F.array()).when(F.startswith(h, F.lit("www.")), F.array(h, without_www(h))).otherwise(F.array(h, F.concat(F.lit("www."), h)))


def _without_dots(p: Column) -> Column:
    """A path without its segments `.` and `..`; what climbs above the root stays at the root."""
    parts = F.split(p, "/")
    last = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x))))
    return F.array_join(F.concat(kept, last), "/")


def resolve(base, href) -> Column:
    """The address that a reference means on a page, by RFC 3986: absolute, //host, /path, relative, dot segments, ?query and #fragment.
    References of other schemes stay as they are. Null if either is null. A dot segment with parameters (`..;x`) counts as a name."""
    b = parts(base)

    def of(h: Column, x: Column, own: Column) -> Column:
        s, p, q = F.lower(x[0]), x[2], x[3]
        f = F.regexp_extract(h, r"#(.*)$", 1)
        relative = F.regexp_replace(F.concat(F.lit("/"), F.regexp_replace(own[2], "[^/]*$", ""), p), "/{2,}", "/")
        target = F.when(p == "", own[2]).when(F.startswith(p, F.lit("/")), p).otherwise(relative)
        target = bound(target, lambda t: F.when((p != "") & t.rlike(r"(?:^|/)\.\.?(?:/|$)"), _without_dots(t)).otherwise(t))
        target = bound(target, lambda t: F.when((t != "") & ~F.startswith(t, F.lit("/")), F.concat(F.lit("/"), t)).when((t == "") & (p != ""), F.lit("/")).otherwise(t))
        joined = build(F.lower(own[0]), own[1], target, F.when((p == "") & (q == ""), own[3]).otherwise(q))
        joined = F.concat(joined, F.when(f != "", F.concat(F.lit("#"), f)).otherwise(F.lit("")))
        other = F.concat(F.lower(own[0]), F.lit(":"), F.regexp_replace(h, "^[a-zA-Z][a-zA-Z0-9+.\\-]*:", ""))
        return F.when(h == "", col(base)).when((s != "") & (s != F.lower(own[0])), h).when(x[1] != "", other).otherwise(joined)

    clean = F.regexp_replace(F.regexp_replace(col(href), r"^[\x00-\x20\xA0]+|[\x00-\x20\xA0]+$", ""), r"[\t\r\n]", "")
    return bound(clean, lambda h: bound(F.struct(parts(h).alias("x"), b.alias("own")), lambda y: of(h, y["x"], y["own"])))
