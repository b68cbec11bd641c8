"""Page scanning against the standard library's parsers and by hand."""

import re
import time
from collections import Counter
from html.entities import html5
from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse

import pytest
from pyspark.sql import functions as F

from pageprism.functions import html as H
from pageprism.functions import urls as U
from pageprism.operators import extract as E
from pageprism.operators import scoring as S
from pageprism.operators import trackers as T
from pageprism.sources.fixtures import view


class Walker(HTMLParser):
    """Text, tags and attributes in document order."""

    def __init__(self, text):
        super().__init__(convert_charrefs=False)
        self.tags, self.text, self.raw, self.scripts = [], [], None, []
        self.feed(text)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.tags.append((tag, {k: v or "" for k, v in attrs}))
        self.raw = tag if tag in ("script", "style") else None
        if tag == "script":
            self.scripts.append("")

    def handle_startendtag(self, tag, attrs):
        self.tags.append((tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        self.raw = None

    def handle_data(self, data):
        if self.raw == "script":
            self.scripts[-1] += data
        elif self.raw is None:
            self.text.append(data)

    def handle_entityref(self, name):
        self.text.append(html5.get(name + ";", "&" + name))

    def handle_charref(self, name):
        self.text.append(chr(int(name[1:], 16) if name[0] in "xX" else int(name)))


def pages_df(spark, htmls, url="https://www.example.com/dir/page?x=1"):
    rows = [(i, url, h) for i, h in enumerate(htmls)]
    return E.parse_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string"))


@pytest.mark.parametrize("name", ["pages", "web_pages"])
def test_same_as_stdlib_parser(spark, sf, name):
    raw = spark.read.parquet(f"{sf}/pages.parquet") if name == "pages" else view(spark, sf, name)
    got = E.parse_pages(raw).select(
        "html", "words", "scripts", "inline_styles",
        F.transform("anchors", lambda a: a["href"]).alias("hrefs"),
        F.transform("images", lambda i: F.struct(i["src"], i["alt"], i["title"], i["width"])).alias("images"),
        F.transform("link_tags", lambda x: x["href"]).alias("links"),
        F.transform("headings", lambda h: h["level"]).alias("levels"),
    ).collect()
    for r in got:
        w = Walker(r["html"])
        assert r["words"] == re.findall(r"\b\w+\b", "".join(w.text).lower())
        assert r["hrefs"] == [a["href"] for t, a in w.tags if t == "a" and "href" in a]
        assert [tuple(i) for i in r["images"]] == [
            (a.get("src"), a.get("alt", ""), a.get("title", ""), a.get("width")) for t, a in w.tags if t == "img"
        ]
        assert r["links"] == [a.get("href") for t, a in w.tags if t == "link"]
        assert r["levels"] == [int(t[1]) for t, _ in w.tags if re.fullmatch("h[1-6]", t)]
        assert r["inline_styles"] == [a["style"] for _, a in w.tags if "style" in a]
        assert [s["body"] for s in r["scripts"]] == w.scripts


def test_top_keywords_against_counter(spark, sf):
    raw = view(spark, sf, "web_pages")
    got = E.parse_pages(raw).select("words", E.top_keywords(F.col("words")).alias("k")).collect()
    for r in got:
        kept = {w: c for w, c in Counter(r["words"]).items() if w not in set(E.STOP_WORDS) and len(w) > 2}
        want = sorted(kept.items(), key=lambda x: x[1], reverse=True)[:20]
        assert [(k["word"], k["cnt"]) for k in r["k"]] == want


BASES = ["https://www.example.com/dir/page?x=1", "http://h:80", "https://a.b/", "http://a.b/c/d/;p?q"]
HREFS = [
    "/x", "//other.org/p?q#f", "x", "./x", "../x", "../../x/", "../../../x", "?y=2", "#f", "", "x//y/../z", "/a/./b/../c",
    "..", ".", "x/..", "/..", "/../a/..", "mailto:a@b.c", "javascript:void(0)", "tel:1", "http://x.org/a/../b", "httpd", "x?",
    "x#", "/a//b", "x?y=/../z", " /lead", "/tab\tbed", "g;x=1/../y", "//x.org",
]


def test_resolve_same_as_urljoin(spark):
    rows = [(b, h) for b in BASES for h in HREFS]
    df = spark.createDataFrame(rows, "b string, h string").withColumn("base", U.base_parts(F.col("b")))
    for r in df.select("b", "h", U.resolve(F.col("base"), F.col("h")).alias("u")).collect():
        want = r["h"] if r["h"].startswith("http") else urljoin(r["b"], r["h"])
        assert r["u"] == want, (r["b"], r["h"])


def test_netloc_same_as_urlparse(spark):
    urls = BASES + ["mailto:x", "//h/p", "HTTP://User:pw@WWW.Host:81/x", "www.example.com/x", "", "https:foo"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    for r in df.select("u", U.netloc(F.col("u")).alias("n"), U.site_key(F.col("u")).alias("k")).collect():
        assert r["n"] == urlparse(r["u"]).netloc
        assert r["k"] == urlparse(r["u"]).netloc.lower().replace("www.", "")


def test_titles(spark):
    cases = {
        "<title>A &amp; B</title>": "A & B", "<p>x": E.NO_TITLE, "<title></title>": None, "<title>a<b>c</b></title>": None,
        "<TITLE lang=x> t </TITLE><title>u</title>": " t ", "<!-- <title>no</title> --><title>yes</title>": "yes",
        '<a title="<title>z</title>">': E.NO_TITLE,
    }
    got = {r["html"]: r["title"] for r in pages_df(spark, list(cases)).select("html", "title").collect()}
    assert got == cases


def test_entities(spark):
    df = spark.createDataFrame(
        [("&lt;b&gt; &amp;amp; &#65;&#x42; &nbsp;&eacute; &unknown; &amp x &#0; &euro;",)], "t string"
    )
    r = df.select(H.decode_text(F.col("t")).alias("t"), H.decode_attr(F.col("t")).alias("a")).first()
    assert r["t"] == "<b> &amp; AB  é &unknown & x � €"
    assert r["a"] == "<b> &amp; AB  é &unknown; & x � €"


def test_attributes_last_wins_and_quotes(spark):
    p = pages_df(spark, ["<a href=/one href='/two' title=\"x > y\">t</a><IMG ALT=q SRC = 's.png'/>"]).select(
        F.get("anchors", F.lit(0)).alias("a"), F.get("images", F.lit(0)).alias("i")).first()
    assert (p["a"]["href"], p["a"]["title"], p["a"]["text"]) == ("/two", "x > y", "t")
    assert (p["i"]["src"], p["i"]["alt"]) == ("s.png", "q")


def test_long_and_broken_markup_ends(spark):
    """No stack overflow and no runaway matching on hostile pages."""
    big = [
        "<a " + 'x="1" ' * 20000 + ">t</a>", "<" * 100000, "<a " * 50000, "<!--" + "x" * 200000, "<script>" + "<" * 100000,
        "<h1>" + "<b>" * 50000, '<a href="' + "x=" * 50000, "<a href=x>" * 20000, "&" * 100000, "á " * 50000,
    ]
    got = pages_df(spark, big).select("page_id", F.size("anchors").alias("n"), F.size("words").alias("w")).orderBy("page_id").collect()
    assert [r["n"] for r in got][7] == 20000


def page(words=0, **parts):
    return "<p>" + "word " * words + "</p>" + "".join(parts.values())


def scores(spark, htmls):
    return {r["page_id"]: r for r in S.page_analysis(pages_df(spark, htmls)).collect()}


def test_thresholds(spark):
    n = lambda k, tag: tag * k
    htmls = [page(w) for w in (299, 300, 301, 1000, 1001)]
    htmls += [n(k, "<script>x</script>") for k in (10, 11, 20, 21)]
    htmls += [n(k, '<p style="a">') for k in (20, 21, 50, 51)]
    htmls += ["<h1>a</h1>" + n(k, "<h4>x</h4>") for k in (4, 5, 9, 10, 14, 15)]
    r = scores(spark, htmls)
    assert [r[i]["content_richness"] for i in range(5)] == ["Low", "Low", "Medium", "Medium", "High"]
    assert [r[i]["performance_score"] for i in range(5, 13)] == [100, 90, 90, 80, 100, 93, 93, 85]
    assert [r[i]["content_type"] for i in range(13, 19)] == ["Landing Page", "Unknown", "Unknown"] + ["Content-Rich Page"] * 3
    assert [r[i]["content_depth"] for i in range(13, 19)] == ["Shallow", "Medium", "Medium", "Medium", "Medium", "Deep"]


def test_health_score_bounds(spark):
    good = '<title>t</title><meta name="description" content="d"><link rel="canonical" href="/c">' + page(500)
    bad = "<title></title>" + "<img>" * 9 + '<script>gtag("x")</script>' * 6
    got = [r["health_score"] for r in S.health_score(pages_df(spark, [good, bad])).orderBy("page_id").collect()]
    assert got == [100, 100 - 15 - 10 - 5 - 10 - 10 - 5]


def test_tracker_chain(spark):
    """A script that names a tool but has no id is dropped, not passed on."""
    cases = [
        "<script>gtag('config','G-ABCDEFGHIJ'); fbq('init','123456789')</script>",
        "<script>gtag(); fbq('init','123456789')</script>",
        "<script>fbq('init','12345678')</script>",
        "<script>hjid: 12; hotjar</script>",
        "<script>VWO</script>",
        "<script src=google-analytics.js>UA-1-2</script>",
    ]
    got = {(r["page_id"], r["tool"], r["kept"]) for r in T.tracker_class(pages_df(spark, cases)).collect()}
    assert got == {
        (0, "google_analytics", True), (1, "google_analytics", False), (2, "facebook_pixel", False),
        (3, "hotjar", True), (4, "other_tracking", True), (5, "google_analytics", True),
    }
    levels = spark.createDataFrame([(i,) for i in range(7)], "t bigint").select(T.intensity(F.col("t")).alias("x"))
    assert [r["x"] for r in levels.collect()] == ["None", "Light", "Moderate", "Moderate", "Heavy", "Heavy", "Very Heavy"]
