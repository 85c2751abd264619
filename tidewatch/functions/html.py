"""HTML: column expressions for the common case, and one Arrow parse for broken or nested markup."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from .. import config as C
from .text import collapse, strip_noise, unescape
from .urls import bound, col, is_attachment, is_valid_url, netloc, normalize_url, path, resolve, same_base_domain, should_skip_href, without_www

ATTRIBUTES = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"
HREF = r"""(?is)^<a(?=[\s/])(?:[^>"']|"[^"]*+"|'[^']*+')*?(?<=[\s"'/])href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
MAIN = r"(?is)<main\b|<[^>]+\b(?:id|class)\s*=\s*[\"'][^\"']*(?:content|tresc|main|article)"


def _drop(x: Column, *tags: str) -> Column:
    for t in tags:
        x = F.regexp_replace(x, rf"(?is)<{t}\b[^>]*>.*?</{t}\s*>", " ")
    return x


def _text(x: Column) -> Column:
    return collapse(unescape(F.regexp_replace(x, r"(?s)<!--.*?-->|<[^>]*>", " ")))


def visible_text(html) -> Column:
    return _text(_drop(F.coalesce(col(html), F.lit("")), "script", "style", "noscript"))


def fast_text(html, noise=C.NOISE, most: int = C.TEXT_CHARS) -> Column:
    """Body text; navigation is dropped only where the page marks its main content."""
    body = _drop(F.coalesce(col(html), F.lit("")), "script", "style", "noscript")
    body = F.when(body.rlike(MAIN), _drop(body, "nav", "header", "footer", "aside")).otherwise(body)
    return F.left(strip_noise(_text(body), noise), F.lit(most))


def first_tag(html, tag: str) -> Column:
    return _text(F.regexp_extract(F.coalesce(col(html), F.lit("")), rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1))


def is_scripted(html) -> Column:
    """Pages whose text comes from scripts: under 300 characters, or many external scripts and under 500."""
    n = F.length(visible_text(html))
    return (F.coalesce(col(html), F.lit("")) != "") & ((n < 300) | ((F.regexp_count(col(html), F.lit(r"(?i)<script\b[^>]*\bsrc\s*=")) > 10) & (n < 500)))


def headings(html, selectors: tuple[str, ...] = C.HEADING_SELECTORS) -> Column:
    """struct<title, h1, h2, blob>: blob is title, h1, h2, h3 and the meta description. Pages without h1, h2 and h3 take as h1 the text of the
    first element of a selector that has 6 characters or more. An element ends at the first end tag of its name; `parse` nests them."""
    page = F.coalesce(col(html), F.lit(""))

    def chosen(selector: str) -> Column:
        inside, name = page, selector.split()[-1]
        for outer in selector.split()[:-1]:
            inside = F.regexp_extract(inside, rf"(?is)<{outer}\b[^>]*>(.*?)</{outer}\s*>", 1)
        attribute = "id" if name[0] == "#" else "class"
        value = name[1:] if name[0] == "#" else rf"(?:[^\"'>]*\s)?{name[1:]}(?:\s[^\"'>]*)?"
        return _text(F.regexp_extract(inside, rf"(?s)<(\w+)\b[^>]*\s{attribute}\s*=\s*(?:\"{value}\"|'{value}'|{name[1:]}(?=[\s>]))[^>]*>(.*?)</\1\s*>", 2))

    def of(x: Column) -> Column:
        fallback = F.coalesce(*[bound(chosen(s), lambda t: F.when(F.length(t) >= 6, t)) for s in selectors], F.lit(""))
        h1 = F.when((x["h1"] == "") & (x["h2"] == "") & (x["h3"] == ""), fallback).otherwise(x["h1"])
        meta = F.regexp_extract(page, rf"(?is)<meta(?=[^>]*\sname\s*=\s*[\"']?description[\"'\s>/])[^>]*?\scontent\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", 1)
        meta = collapse(unescape(F.regexp_replace(meta, "^[\"']|[\"']$", "")))
        return bound(h1, lambda t: F.struct(x["title"].alias("title"), t.alias("h1"), x["h2"].alias("h2"), collapse(F.concat_ws(" ", x["title"], t, x["h2"], x["h3"], meta)).alias("blob")))

    return bound(F.struct(*[first_tag(html, t).alias(t) for t in ("title", "h1", "h2", "h3")]), of)


def anchors(html) -> Column:
    """array<struct<href, anchor>> in document order. An anchor ends at its end tag, at the next anchor or with the page; values in quotes may
    hold blanks and `>`; empty references are left out."""
    tags = F.regexp_extract_all(F.coalesce(col(html), F.lit("")), F.lit(rf"(?is)(<a(?=[\s/>]){ATTRIBUTES}>.*?)(?=</a\s*>|<a[\s/>]|$)"), 1)
    href = lambda t: F.concat(*[F.regexp_extract(t, HREF, k) for k in (1, 2, 3)])
    pairs = F.transform(tags, lambda t: F.struct(F.trim(F.regexp_replace(unescape(href(t)), r"^\s+|\s+$", "")).alias("href"), _text(F.regexp_replace(t, rf"(?is)^<a{ATTRIBUTES}>", "")).alias("anchor")))
    return F.filter(pairs, lambda p: p["href"] != "")


def links(html, base) -> Column:
    """array<struct<url, anchor, pos>>: resolved links that are valid and not skipped (attachments stay); the first of each URL."""
    all_ = F.transform(anchors(html), lambda p, i: F.struct(normalize_url(resolve(base, p["href"])).alias("url"), p["anchor"].alias("anchor"), i.alias("pos")))
    kept = F.filter(all_, lambda p: p["url"].isNotNull() & is_valid_url(p["url"]) & (is_attachment(p["url"]) | ~should_skip_href(p["url"])))
    return F.filter(kept, lambda p: F.array_position(F.transform(kept, lambda q: q["url"]), p["url"]) == F.array_position(F.transform(kept, lambda q: q["pos"]), p["pos"]))


def attachments(html, base, ends=C.ATTACHMENTS) -> Column:
    """Sorted distinct attachment addresses: https, host without www., no query; a query defeats the match."""
    urls = F.transform(anchors(html), lambda p: normalize_url(resolve(base, p["href"])))
    kept = F.filter(urls, lambda u: u.isNotNull() & is_attachment(u, ends))
    return F.array_sort(F.array_distinct(F.transform(kept, lambda u: F.concat(F.lit("https://"), without_www(F.lower(netloc(u))), path(u)))))


def serialize(attachment_set) -> Column:
    return F.to_json(F.array_sort(F.array_distinct(col(attachment_set))))


def deserialize(signature) -> Column:
    return F.coalesce(F.from_json(col(signature), "array<string>"), F.array().cast("array<string>"))


class _Page(HTMLParser):
    """Title, headings, text and links of one page, with nesting."""

    SKIP = {"script", "style", "noscript"}
    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skip, self.open, self.found, self.text, self.links, self.picked = 0, [], {}, [], [], {}

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.skip += 1
        if tag in self.VOID:
            return
        a = dict(attrs)
        self.open.append((tag, a, len(self.text)))
        if tag == "a" and a.get("href"):
            self.links.append([a["href"], ""])

    def handle_endtag(self, tag):
        if tag in self.SKIP and self.skip:
            self.skip -= 1
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                for t, a, start in reversed(self.open[i:]):
                    said = " ".join(self.text[start:])
                    if t in ("title", "h1", "h2", "h3"):
                        self.found.setdefault(t, said)
                    names = {"#" + (a.get("id") or ""), *("." + c for c in (a.get("class") or "").split())}
                    for s in names & {x.split()[-1] for x in C.HEADING_SELECTORS}:
                        self.picked.setdefault(s, said)
                    if t == "a" and self.links:
                        self.links[-1][1] = self.links[-1][1] or said
                del self.open[i:]
                break

    def handle_data(self, data):
        if not self.skip and data.strip():
            self.text.append(" ".join(data.split()))


LINK = StructType([StructField("href", StringType()), StructField("anchor", StringType())])
PARSED = StructType([StructField(n, StringType()) for n in ("title", "h1", "h2", "text")] + [StructField("links", ArrayType(LINK))])


@F.pandas_udf(PARSED)
def parse(html: pd.Series) -> pd.DataFrame:
    """One pass over broken or nested markup; headings fall back to the usual selectors."""
    rows = []
    for h in html:
        p = _Page()
        p.feed(h or "")
        p.close()
        h1 = p.found.get("h1", "")
        if not (h1 or p.found.get("h2") or p.found.get("h3")):
            h1 = next((p.picked[s] for s in (x.split()[-1] for x in C.HEADING_SELECTORS) if len(p.picked.get(s, "")) >= 6), "")
        rows.append((p.found.get("title", ""), h1, p.found.get("h2", ""), " ".join(p.text)[: C.TEXT_CHARS], [{"href": a, "anchor": t} for a, t in p.links]))
    return pd.DataFrame(rows, columns=["title", "h1", "h2", "text", "links"])


def same_site(url, host) -> Column:
    return same_base_domain(netloc(url), col(host))
