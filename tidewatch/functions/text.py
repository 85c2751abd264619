"""Text predicates and keyword matching as column expressions."""

from __future__ import annotations

import re
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C
from .urls import any_of, bound, canonical_url, col, filename, is_home_url, is_listing_url, is_valid_url, normalize_url


def collapse(x) -> Column:
    """Unicode white space to single blanks, trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(col(x), F.lit("")), r"(?U)\s+", " "))


def keyword(blob, keywords=C.KEYWORDS, strict=C.STRICT) -> Column:
    """The first keyword in list order that occurs; strict and short ones as whole words. Null if none."""
    t = F.lower(collapse(blob))
    out = None
    for k in keywords:
        low = k.strip().lower()
        if not low:
            continue
        whole = low in strict or len(low) <= 3
        test = t.rlike(rf"(?U)(?<!\w){re.escape(low)}(?!\w)") if whole else F.contains(t, F.lit(low))
        out = F.when(test, F.lit(k)) if out is None else out.when(test, F.lit(k))
    return out if out is not None else F.lit(None).cast("string")


def anchor_is_ignored(x, phrases=C.IGNORED_ANCHORS) -> Column:
    t = F.lower(collapse(x))
    return (F.length(t) <= 2) | any_of(t, phrases)


def is_block_page(html, visible, markers=C.BLOCK_MARKERS) -> Column:
    low = F.lower(F.coalesce(col(html), F.lit("")))
    return (low != "") & (any_of(low, markers) | ((F.length(col(visible)) < 600) & F.left(low, F.lit(4000)).rlike("|".join(C.BLOCK_PHRASES))))


def strip_noise(x, patterns=C.NOISE) -> Column:
    out = F.coalesce(col(x), F.lit(""))
    for p in patterns:
        out = F.regexp_replace(out, "(?iu)" + p, "")
    return collapse(out)


def is_generic_page(title, h1, url, text, site=C.SITE_WORDS, category=C.CATEGORY_TITLES) -> Column:
    """Listings, short home pages, bare site titles and bare category labels."""
    t, h = F.lower(F.trim(F.coalesce(col(title), F.lit("")))), F.lower(F.trim(F.coalesce(col(h1), F.lit(""))))
    n = F.length(F.trim(F.coalesce(col(text), F.lit(""))))
    blob = collapse(F.concat_ws(" ", t, h))
    label = F.when(h != "", h).otherwise(t)
    return F.when(is_listing_url(url), True).when(is_home_url(url) & (n < 600), True).when(blob == "", False).when((F.length(blob) <= 90) & blob.rlike("(?iu)" + site) & (n < 300), True).otherwise((label != "") & label.rlike("(?iu)" + category))


def looks_html(ctype, body) -> Column:
    return F.contains(F.lower(F.coalesce(col(ctype), F.lit(""))), F.lit("html")) | F.coalesce(F.left(col(body), F.lit(2000)).rlike(r"<[^>]+>"), F.lit(False))


def looks_like_sitemap(body, ctype=None) -> Column:
    """By content type, where it is known, or by the start of the document."""
    low = F.lower(F.left(F.ltrim(F.coalesce(col(body), F.lit(""))), F.lit(4000)))
    marked = any_of(low, ("<urlset", "<sitemapindex", 'xmlns="http://www.sitemaps.org'))
    return marked if ctype is None else marked | ((low != "") & F.contains(F.lower(F.coalesce(col(ctype), F.lit(""))), F.lit("xml")))


def decoded(body) -> Column:
    """Text of UTF-8 bytes; bytes that aren't UTF-8 are left out, as are replacement characters that were there before."""
    return F.replace(F.make_valid_utf8(col(body).cast("string")), F.lit("\ufffd"), F.lit(""))


def link_is_generic(title) -> Column:
    """Link titles that say nothing: site names, ignored anchors, very short ones."""
    t = collapse(title)
    low = F.lower(t)
    return F.contains(low, F.lit("biuletyn informacji publicznej")) | (low == "bip") | ((F.length(low) <= 6) & F.contains(low, F.lit("bip"))) | anchor_is_ignored(low) | (F.length(t) < 8)


def link_blob(anchor, url) -> Column:
    return F.concat_ws(" ", F.coalesce(col(anchor), F.lit("")), filename(url))


def page_title(h1, h2, title, url) -> Column:
    return F.left(F.coalesce(*(F.nullif(col(c), F.lit("")) for c in (h1, h2, title)), col(url)), F.lit(240))


def first_of_each(urls: Column) -> Column:
    """Normalised valid addresses in order, the first of each canonical form."""
    valid = F.transform(F.filter(urls, is_valid_url), lambda x: F.struct(normalize_url(x).alias("u"), canonical_url(x).alias("c")))
    return bound(valid, lambda xs: F.transform(F.filter(xs, lambda x, i: F.array_position(F.transform(xs, lambda y: y["c"]), x["c"]) == i + 1), lambda x: x["u"]))


def sitemaps_in_robots(body) -> Column:
    """Values of `Sitemap:` lines in order: valid addresses, normalised, the first of each canonical form."""
    lines = F.transform(F.split(F.coalesce(col(body), F.lit("")), r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    found = F.transform(F.filter(lines, lambda x: F.lower(x).startswith("sitemap:")), lambda x: F.trim(F.regexp_replace(x, "^[^:]*:", "")))
    return first_of_each(found)


def raw_locs(body, kind: str = "url") -> Column:
    """<loc> values of <url> or <sitemap> entries in order, as written, repeats included. Entries may lack their end tag. Of a document without
    any entry of either kind every <loc> with an address counts as a page."""
    entry = rf"(?is)<(?:\w+:)?{kind}(?=[\s>])[^>]*>(.*?)(?=</(?:\w+:)?{kind}\s*>|<(?:\w+:)?{kind}(?=[\s>])|$)"
    text = F.coalesce(col(body), F.lit(""))
    loc = lambda x: F.trim(unescape(F.regexp_extract(x, r"(?is)<(?:\w+:)?loc\b[^>]*>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</(?:\w+:)?loc", 1)))
    own = F.transform(F.regexp_extract_all(text, F.lit(entry), 1), loc)
    if kind == "url":
        bare = F.regexp_extract_all(text, F.lit(r"(?i)<loc>\s*(https?://[^<\s]+)\s*</loc>"), 1)
        own = F.when(text.rlike(r"(?i)<(?:\w+:)?(?:url|sitemap)[\s>]"), own).otherwise(bare)
    return F.filter(own, lambda x: x != "")


def sitemap_locs(body, kind: str = "url") -> Column:
    """raw_locs that are valid addresses, normalised, the first of each. Canonical repeats are for a key to drop: a sitemap may hold 50,000
    entries, and this list is one row's."""
    return F.array_distinct(F.transform(F.filter(raw_locs(body, kind), is_valid_url), normalize_url))


#: Character references and what they mean, in one text: the standard's named ones of one character, and numbers that mean Windows-1252.
NAMED = "".join(f"&{n}{v}" for n, v in html5.items() if n.endswith(";") and len(v) == 1 and n != "amp;")
NAMED += "".join(f"&#{code};" + bytes([code]).decode("cp1252", "replace") for code in range(0x80, 0xA0))


def unescape(x: Column) -> Column:
    """Character references, decimal, hexadecimal or named, become characters, each once; `&amp;` last. Unknown ones and those without a
    semicolon stay."""
    listed = F.lit(NAMED)
    named = lambda e: bound(F.instr(listed, e), lambda at: F.when(at > 0, F.substring(listed, at + F.length(e), F.lit(1))))

    def char(e: Column) -> Column:
        hexed, digits = F.regexp_extract(e, r"^&#[xX]0*([0-9a-fA-F]{1,6});$", 1), F.regexp_extract(e, r"^&#0*(\d{1,7});$", 1)
        code = F.when(hexed != "", F.conv(hexed, 16, 10)).otherwise(digits).try_cast("int")
        plain = F.when((code > 0) & (code < 0xD800) | (code > 0xDFFF) & (code < 0x110000), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        numbered = lambda c: F.when(code.between(0x80, 0x9F), named(F.concat(F.lit("&#"), c.cast("string"), F.lit(";")))).otherwise(F.coalesce(plain, F.lit("\ufffd")))
        return F.when(code.isNotNull(), numbered(code)).otherwise(F.coalesce(named(e), e))

    def of(t: Column) -> Column:
        found = F.array_distinct(F.regexp_extract_all(t, F.lit(r"&(?:#\d+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);"), F.lit(0)))
        found = F.filter(found, lambda e: e != "&amp;")
        return F.replace(F.aggregate(found, t, lambda acc, e: F.replace(acc, e, char(e))), F.lit("&amp;"), F.lit("&"))

    return bound(x, lambda t: F.when(F.contains(t, F.lit("&")), of(t)).otherwise(t))
