import random
from urllib.parse import parse_qsl, urlencode, urljoin, urlparse, urlunparse

from pyspark.sql import functions as F

from tidewatch.functions import html as H
from tidewatch.functions import text as X
from tidewatch.functions import urls as U


def values(spark, rows, *exprs):
    df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], ", ".join(f"c{i} string" for i in range(len(rows[0]) if isinstance(rows[0], tuple) else 1)))
    got = df.select(*exprs).collect()
    return [r[0] if len(r) == 1 else tuple(r) for r in got]


def test_normalize_url(spark):
    assert values(spark, ["https://a.pl/x?B=2&a&utm_x=1&&c=%20x+y#f", "https://a.pl/?lang=pl&sid=1"], U.normalize_url("c0")) == ["https://a.pl/x?a=&b=2&c=+x+y", "https://a.pl/"]


def test_canonical_url_and_key(spark):
    assert values(spark, ["HTTP://WWW.Ex.pl:8080/A/?b=2&a#f", "http://a.pl"], U.canonical_url("c0")) == ["https://ex.pl:8080/A?a=&b=2", "https://a.pl/"]
    keys = values(spark, ["HTTP://WWW.Ex.pl:8080/A/?b=2&a#f", "https://bip.wiazow.madkom.pl/api"], U.url_key("c0"))
    assert keys == ["f06d9ed51a3b5f03c333742863374e1ce92e4a5c", "8cd9748ed157db3215c53412ce11be7185238230"]


def test_base_domain(spark):
    hosts = ["bip.gminaolawa.pl", "bip.wiazow.madkom.pl", "ugostaszewo.ssdip.bip.gov.pl", "bip.brzeznica.com.pl", "localhost"]
    assert values(spark, hosts, U.base_domain("c0")) == ["gminaolawa.pl", "madkom.pl", "bip.gov.pl", "brzeznica.com.pl", "localhost"]


def test_resolve_agrees_with_urljoin(spark):
    r = random.Random(1)
    bases = ["https://a.pl", "https://a.pl/", "https://a.pl/x/y.html", "https://a.pl/x/y/", "http://a.pl/x//y?q=1#f", "https://a.pl/x/../y/z"]
    words = ["..", ".", "/", "//", "a", "b.html", "?p=2", "#f", "q w", "ż", "http:", "https:", "mailto:x@y", "javascript:void(0)", "h.pl", "?", "&x=1", "%20"]
    rows = [(b, "".join(r.choice(words) for _ in range(r.randint(1, 5)))) for b in bases for _ in range(400)]
    rows += [("https://a.pl/x/y.html", "../z?q=1#f"), ("https://a.pl/x/", "//b.pl/c"), ("https://a.pl/x/y", "?p=2"), ("https://a.pl/x", "../../../z"), ("https://a.pl/x", "\n a b.pdf\t")]
    empty = lambda u: u.replace("?#", "#").removesuffix("?")  # noqa: E731  a query without content means nothing
    got = values(spark, rows, U.resolve("c0", "c1"))
    assert [empty(g) for g in got] == [empty(urljoin(b, h.strip())) for b, h in rows]
    assert values(spark, [(None, "x"), ("https://a.pl", None)], U.resolve("c0", "c1")) == [None, None]


def canonical(u: str) -> str:
    """U2 with the standard library."""
    p = urlparse(u.strip())
    gone = {"fbclid", "gclid", "yclid", "sid", "session", "sessionid", "phpsessid", "jsessionid", "print", "format", "lang", "locale", "language"}
    q = [(k.strip().lower(), v) for k, v in parse_qsl(p.query, keep_blank_values=True)]
    q = sorted(((k, v) for k, v in q if k and not k.startswith("utm_") and k not in gone), key=lambda x: x[0])
    path = p.path or "/"
    return urlunparse(("https", p.netloc.lower().strip().removeprefix("www."), path[:-1] if path != "/" and path.endswith("/") else path, "", urlencode(q), ""))


def test_canonical_agrees_with_the_standard_library(spark):
    r = random.Random(7)
    rows = ["http://www.A.pl/" + "".join(r.choice("abcXYZ?&=/.;+ _-") for _ in range(r.randint(0, 25))) for _ in range(1500)]
    rows += ["http://www.A.pl/ ;", "https://a.pl", "https://a.pl/x;p/", "https://a.pl/x;p", "HTTP://WWW.Ex.pl:8080/A/?b=2&a&B=1#f", "https://a.pl/%C5%BC?x=%C5%BC&utm_x=1&sid=2"]
    assert values(spark, rows, U.canonical_url("c0")) == [canonical(u) for u in rows]


def test_predicates(spark):
    assert values(spark, ["javascript:void(0)", "mailto:a@b.c", None, "https://a.pl"], U.is_valid_url("c0")) == [False, False, False, True]
    assert values(spark, ["https://a.pl/montage/1", None], U.is_listing_url("c0")) == [True, False]
    assert values(spark, ["ok", "Drukuj stronę", "Obwieszczenie", None], X.anchor_is_ignored("c0")) == [True, True, False, True]
    assert values(spark, ['<p style="color:#13aabb">', "", "<p>x</p>"], X.is_block_page("c0", "c0")) == [True, False, False]


def test_keyword_order_and_words(spark):
    texts = ["Projekt MPZP dla obrębu", "złoze", "ęoze x", "plan ogólny i miejscowy plan", "plan ogólny", "", None]
    assert values(spark, texts, X.keyword("c0")) == ["mpzp", None, None, "miejscowy plan", "plan ogólny", None, None]


def test_attachments(spark):
    page = '<a href="/f/Plan.PDF">x</a><a href="/f/a.pdf?x=1">y</a>'
    assert values(spark, [(page, "http://www.a.pl/")], H.attachments("c0", "c1")) == [["https://a.pl/f/Plan.PDF"]]
    assert values(spark, ["", "xx", '["b","a"]', None], F.array_sort(H.deserialize("c0"))) == [[], [], ["a", "b"], []]


def test_html(spark):
    page = '<title>T &amp; U</title><script>var t="</p>";</script><nav>menu</nav><main><h1>H</h1><p>body<!-- no --></p></main>'
    assert values(spark, [page], H.first_tag("c0", "title"), ) == ["T & U"]
    assert values(spark, [page, None], H.fast_text("c0")) == ["T & U H body", ""]
    got = values(spark, ['<div class="page-title">Long enough</div><p>x <b>y'], H.parse("c0"))[0]
    assert got["h1"] == "Long enough" and got["text"] == "Long enough x y"
    links = values(spark, [('<a href="/a">one</a><a href="/a#z">two</a><a href="/x.jpg">no</a><a href="/d.pdf">doc</a>', "https://s.pl/q")], H.links("c0", "c1"))[0]
    assert [(x["url"], x["anchor"]) for x in links] == [("https://s.pl/a", "one"), ("https://s.pl/d.pdf", "doc")]


def test_feeds(spark):
    assert values(spark, ["SiteMap: https://a.pl/m.xml\r\nsitemap: x\nSitemap: https://a.pl/m.xml"], X.sitemaps_in_robots("c0")) == [["https://a.pl/m.xml"]]
    bad = "<urlset><url><loc> https://a.pl/?a=1&amp;b=2 </loc></url><url><loc>https://a.pl/2</loc></url><url>"
    assert values(spark, [bad], X.sitemap_locs("c0")) == [["https://a.pl/?a=1&b=2", "https://a.pl/2"]]


def test_noise_and_generic(spark):
    assert values(spark, ["a Wygenerowano: 2024-01-02 03:04:05 b Odsłon: 12"], X.strip_noise("c0")) == ["a b"]
    rows = [("x", "Decyzje", "https://a.pl/z", "t"), ("x", "Decyzje środowiskowe", "https://a.pl/z", "t"), ("", "", "https://a.pl/", "t"), ("", "", "https://a.pl/z", "t")]
    assert values(spark, rows, X.is_generic_page("c0", "c1", "c2", "c3")) == [True, False, True, False]


def test_hrefs_of_any_form(spark):
    page = """<a href="page2.html">rel</a><a href='../up.pdf'>up</a><a href="my plan.pdf">blank</a><a href=bare.html>bare</a><a data-href="no" href="?p=2">query</a>
    <a href="./x">dot<a title="a>b" href="/abs">next</a><a href="">none</a><a name="n">none</a><a href="#top">top</a><a href="mailto:a@b.pl">mail</a><abbr href="/no">no</abbr><a href="/end">end"""
    base = "https://a.pl/d/e.html"
    want = [("page2.html", "rel"), ("../up.pdf", "up"), ("my plan.pdf", "blank"), ("bare.html", "bare"), ("?p=2", "query"), ("./x", "dot"), ("/abs", "next"), ("#top", "top"), ("mailto:a@b.pl", "mail"), ("/end", "end")]
    assert [tuple(x) for x in values(spark, [page], H.anchors("c0"))[0]] == want
    got = values(spark, [(page, base)], H.links("c0", "c1"))[0]
    assert [x["url"] for x in got] == [urljoin(base, h).split("#")[0] for h, _ in want if not h.startswith("mailto")]
    assert values(spark, [(page, base)], H.attachments("c0", "c1")) == [["https://a.pl/d/my plan.pdf", "https://a.pl/up.pdf"]]


def test_entities(spark):
    from html import unescape

    rows = ["plan og&oacute;lny", "&#243;&#xF3;&#XF3;", "&amp;lt; &lt;b&gt; &amp;amp;", "a & b &bogus; &", "&#146;&#0;&#1114112;&#128512;", "&nbsp;&NotEqualTilde;", None]
    want = [unescape(x) if x and "bogus" not in x else x for x in rows]
    want[2], want[5] = "&lt; <b> &amp;", "\xa0&NotEqualTilde;"
    assert values(spark, rows, X.unescape(F.col("c0"))) == want


def test_headings(spark):
    pages = ["<title>T</title><h2>two</h2><h3>three</h3><meta content='d &oacute;' name=description>", '<div class="x page-title">short</div><p class="title big">Long &amp; enough</p>', '<p id="title">Selected</p><h3> </h3>', None, '<p class="subtitle">Not this one</p>']
    want = [("T", "", "two", "T two three d ó"), ("", "Long & enough", "", "Long & enough"), ("", "Selected", "", "Selected"), ("", "", "", ""), ("", "", "", "")]
    assert [tuple(x) for x in values(spark, pages, H.headings("c0"))] == want


def test_sitemaps(spark):
    bodies = ["<urlset><url><loc>nope</loc></url><url><loc> https://a.pl/1?utm_x=1 </loc><url><loc><![CDATA[https://a.pl/2]]></loc></url>", "<loc>https://a.pl/1</loc> <loc>ftp</loc> x <loc>https://a.pl/1#f</loc>", "<s:urlset><s:url><s:loc>https://a.pl/3</s:loc></s:url></s:urlset>", None]
    assert values(spark, bodies, X.sitemap_locs("c0")) == [["https://a.pl/1", "https://a.pl/2"], ["https://a.pl/1"], ["https://a.pl/3"], []]
    assert values(spark, ["<sitemapindex><sitemap><loc>https://a.pl/m.xml</loc></sitemap></sitemapindex>"], X.sitemap_locs("c0", "sitemap"), X.sitemap_locs("c0")) == [(["https://a.pl/m.xml"], [])]
    assert values(spark, [("<x/>", "text/xml"), ("", "text/xml"), (' <a xmlns="http://www.sitemaps.org/x">', None), ("<html>", "text/html")], X.looks_like_sitemap("c0", "c1")) == [True, False, True, False]
    assert values(spark, ["Sitemap: https://www.a.pl/m.xml?b=1&a=2#x\rsitemap: https://a.pl/m.xml?a=2&b=1\n SITEMAP:nowhere"], X.sitemaps_in_robots("c0")) == [["https://www.a.pl/m.xml?a=2&b=1"]]


def test_decoding_leaves_out_what_is_not_utf8(spark):
    df = spark.createDataFrame([(bytearray(b"a\xffb\xc5\xbc\xc5"),), (None,)], "b binary")
    assert [r[0] for r in df.select(X.decoded("b")).collect()] == ["abż", None]
