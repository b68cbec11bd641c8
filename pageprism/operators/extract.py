"""Page extraction: html to columns, without a shuffle.

``parse_pages`` adds one array or scalar column per kind of content; an
operator takes the columns it needs and column pruning drops the rest.
A page stays one row, so no page's content crosses the network.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import urls as U
from ..functions.cols import count_if_in, let, n, one_of, per_jvm, present, rows
from ..sources.sinks import materialize

NO_TITLE = "No title found"

# Words left out of the keyword count.
STOP_WORDS = (
    "the a an and or but in on at to for of with by is are was were be been have has had do does did will would "
    "could should may might must can this that these those i you he she it we they me him her us them my your his "
    "her its our their mine yours his hers ours theirs"
).split()

# Script patterns in the order they are tried.
SCRIPT_PATTERNS = [
    "google-analytics", "gtag", "ga(", "googletagmanager", "facebook", "fbq", "pixel", "hotjar", "mixpanel",
]

# Hosts counted as social media.
SOCIAL_DOMAINS = [
    "facebook.com", "twitter.com", "instagram.com", "linkedin.com",
    "youtube.com", "tiktok.com", "pinterest.com", "reddit.com",
]

FEED_TYPES = ["application/rss+xml", "application/atom+xml"]
TOP_WORDS = 20


def _title() -> Column:
    first = F.get(F.filter("titled", lambda e: e.rlike("(?i)^<title")), F.lit(0))

    def pick(e: Column) -> Column:
        return F.when(e.isNull(), F.lit(NO_TITLE)).otherwise(
            let(H.element_body(e), lambda b: F.when((b != "") & ~F.contains(b, F.lit(H.MARK)), H.decode_text(b)))
        )

    return let(first, pick)


def _metas() -> Column:
    tags = F.transform(H.named(F.col("marks"), "meta"), H.attributes)
    pairs = F.transform(
        tags,
        lambda a: F.struct(
            F.coalesce(H.attr(a, "name"), H.attr(a, "property"), F.lit("")).alias("name"),
            F.coalesce(H.attr(a, "content"), F.lit("")).alias("content"),
        ),
    )
    return pairs


def _link_tags() -> Column:
    tags = F.transform(H.named(F.col("marks"), "link"), H.attributes)
    return F.transform(
        tags,
        lambda a: F.struct(*[H.attr(a, k).alias(k) for k in ("rel", "href", "title", "type")]),
    )


def _images() -> Column:
    tags = F.transform(H.named(F.col("marks"), "img"), H.attributes)
    text = lambda a, k: F.coalesce(H.attr(a, k), F.lit("")).alias(k)
    return F.transform(
        tags,
        lambda a: F.struct(
            H.attr(a, "src").alias("src"),
            text(a, "alt"),
            text(a, "title"),
            H.attr(a, "width").alias("width"),
            H.attr(a, "height").alias("height"),
            text(a, "loading"),
            text(a, "decoding"),
        ),
    )


def _scripts() -> Column:
    def one(m: Column) -> Column:
        return let(
            H.attributes(H.open_tag(m)),
            lambda a: F.struct(
                H.attr(a, "type").alias("type"),
                H.attr(a, "src").alias("src"),
                H.raw_body(m, "script").alias("body"),
            ),
        )

    return F.transform(H.named(F.col("marks"), "script"), one)


def _inline_styles() -> Column:
    tags = F.filter(F.col("marks"), lambda m: F.contains(F.lower(m), F.lit("style")))
    values = F.transform(tags, lambda m: let(H.attributes(H.open_tag(m)), lambda a: H.attr(a, "style")))
    return F.filter(values, lambda v: v.isNotNull())


def _headings() -> Column:
    found = F.filter("titled", lambda e: e.rlike("(?i)^<h"))
    return F.transform(
        found, lambda e: F.struct(F.substring(e, 3, 1).cast("bigint").alias("level"), H.inner_text(e).alias("text"))
    )


def _anchors() -> Column:
    found = H.scan_anchors(F.col("html"))
    opened = F.transform(found, lambda e: F.struct(H.attributes(H.open_tag(e)).alias("a"), e.alias("e")))
    linked = F.filter(opened, lambda x: F.array_contains(x["a"]["names"], "href"))
    base = F.col("base")

    def one(x: Column) -> Column:
        a = x["a"]
        return let(
            F.struct(
                H.attr(a, "href").alias("href"),
                H.inner_text(x["e"]).alias("text"),
                F.coalesce(H.attr(a, "title"), F.lit("")).alias("title"),
                H.attr(a, "rel").alias("rel"),
                F.coalesce(H.attr(a, "target"), F.lit("")).alias("target"),
            ),
            lambda s: s.withField("full_url", U.resolve(base, s["href"])),
        )

    def scoped(s: Column) -> Column:
        return let(
            U.netloc(s["full_url"]),
            lambda loc: s.withField("netloc", loc)
            .withField("internal", loc == base["netloc"])
            .withField("social", (loc != base["netloc"]) & one_of(loc, SOCIAL_DOMAINS)),
        )

    return F.transform(F.transform(linked, one), scoped)


@per_jvm
def _page_columns() -> dict[str, Column]:
    return {
        "title": _title(),
        "metas": _metas(),
        "link_tags": _link_tags(),
        "images": _images(),
        "scripts": _scripts(),
        "styles": F.transform(H.named(F.col("marks"), "style"), lambda m: H.raw_body(m, "style")),
        "inline_styles": _inline_styles(),
        "headings": _headings(),
        "anchors": _anchors(),
        "words": H.words(H.visible_text(F.col("html"))),
    }


def parse_pages(pages: DataFrame, *want: str) -> DataFrame:
    """``(page_id, url, html)`` to one wide row per page.

    ``want`` names the columns to add; without it all are added, and column
    pruning still keeps unread ones from being computed.
    """
    made = _page_columns()
    scanned = pages.withColumns(
        {
            "marks": H.scan_marks(F.col("html")),
            "titled": H.scan_titles_and_headings(F.col("html")),
            "base": U.base_parts(F.col("url")),
        }
    )
    parsed = scanned.withColumns({k: c for k, c in made.items() if k in want or not want})
    return parsed.drop("marks", "titled", "base")


# ---- per-row helpers on parsed pages ------------------------------------
@per_jvm
def last_meta(name: str) -> Column:
    """Content of the last meta tag of that name, NULL if there is none."""
    return F.try_element_at(
        F.transform(F.filter(F.col("metas"), lambda m: m["name"] == name), lambda m: m["content"]), F.lit(-1)
    )


@per_jvm
def first_link(token: str) -> Column:
    """href of the first link tag whose rel has the token."""
    return F.get(F.filter(F.col("link_tags"), lambda x: H.has_token(x["rel"], token)), F.lit(0))["href"]


@per_jvm
def stylesheets() -> Column:
    return F.filter(F.col("link_tags"), lambda x: H.has_token(x["rel"], "stylesheet"))


@per_jvm
def external_css() -> Column:
    return F.transform(F.filter(stylesheets(), lambda x: present(x["href"])), lambda x: x["href"])


@per_jvm
def internal_css() -> Column:
    return F.filter(F.col("styles"), lambda s: s != "")


@per_jvm
def inline_scripts() -> Column:
    return F.transform(F.filter(F.col("scripts"), lambda s: s["body"] != ""), lambda s: s["body"])


@per_jvm
def external_scripts() -> Column:
    return F.transform(F.filter(F.col("scripts"), lambda s: s["src"].isNotNull()), lambda s: s["src"])


@per_jvm
def feeds() -> Column:
    return F.filter(
        F.col("link_tags"), lambda x: H.has_token(x["rel"], "alternate") & F.coalesce(x["type"].isin(FEED_TYPES), F.lit(False))
    )


@per_jvm
def json_ld() -> Column:
    """Bodies of the JSON-LD scripts that parse."""
    blocks = F.filter(F.col("scripts"), lambda s: F.coalesce(s["type"] == "application/ld+json", F.lit(False)))
    return F.filter(F.transform(blocks, lambda s: s["body"]), lambda b: F.try_parse_json(b).isNotNull())


@per_jvm
def meta_names(prefix: str = "") -> Column:
    names = F.transform(F.filter(F.col("metas"), lambda m: m["name"] != ""), lambda m: m["name"])
    return F.filter(F.array_distinct(names), lambda x: x.startswith(prefix))


def _run_starts(s: Column, field: str) -> Column:
    """Where a run of equal ``field`` values starts in a sorted array."""
    at = F.transform(s, lambda x, i: F.when((i == 0) | (F.get(s, i - 1)[field] != x[field]), i))
    return F.filter(at, lambda i: i.isNotNull())


@per_jvm
def meta_dict() -> Column:
    """Distinct meta names in order of first use, each with its last content."""
    placed = F.filter(
        F.transform("metas", lambda m, i: F.struct(m["name"].alias("name"), i.alias("i"), m["content"].alias("content"))),
        lambda m: m["name"] != "",
    )

    def last_of_runs(s: Column) -> Column:
        return let(
            _run_starts(s, "name"),
            lambda st: F.transform(
                st,
                lambda at, j: F.struct(
                    F.get(s, at)["i"].alias("first"),
                    F.get(s, at)["name"].alias("name"),
                    F.get(s, F.coalesce(F.get(st, j + 1), F.size(s)) - 1)["content"].alias("content"),
                ),
            ),
        )

    in_order = F.array_sort(let(F.array_sort(placed), last_of_runs))
    return F.transform(in_order, lambda m: m.dropFields("first"))


@per_jvm
def script_hits() -> Column:
    """Per script the first pattern found in its body or source."""

    def one(s: Column) -> Column:
        body, src = F.lower(s["body"]), F.lower(F.coalesce(s["src"], F.lit("")))
        kind = F.lit(None).cast("string")
        for p in reversed(SCRIPT_PATTERNS):
            kind = F.when(F.contains(body, F.lit(p)) | F.contains(src, F.lit(p)), F.lit(p)).otherwise(kind)
        return F.struct(
            kind.alias("type"), F.coalesce(s["src"], F.lit("")).alias("src"), H.preview(s["body"]).alias("preview")
        )

    return F.filter(F.transform(F.col("scripts"), one), lambda x: x["type"].isNotNull())


def top_keywords(words: Column) -> Column:
    """The most frequent words of a page, ties by first use.

    Sorting the words brings equal ones together; the lengths of the runs are
    the counts.  All inside the row: n log n, no shuffle.
    """
    placed = F.filter(
        F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))),
        lambda x: (F.length(x["w"]) > 2) & ~x["w"].isin(STOP_WORDS),
    )

    def counted(s: Column) -> Column:
        return let(
            _run_starts(s, "w"),
            lambda st: F.transform(
                st,
                lambda at, j: F.struct(
                    (at - F.coalesce(F.get(st, j + 1), F.size(s))).alias("neg"),
                    F.get(s, at)["i"].alias("first"),
                    F.get(s, at)["w"].alias("word"),
                ),
            ),
        )

    ranked = F.slice(F.array_sort(let(F.array_sort(placed), counted)), 1, TOP_WORDS)
    return F.transform(
        ranked,
        lambda x, i: F.struct(
            x["word"].alias("word"), (-x["neg"]).cast("bigint").alias("cnt"), (i + 1).cast("bigint").alias("rank")
        ),
    )


# ---- operators ------------------------------------------------------------
def scan_pages(parsed: DataFrame) -> DataFrame:
    return parsed.select(
        "page_id",
        "url",
        "title",
        F.length("html").cast("bigint").alias("html_length"),
        n(F.col("anchors")).alias("links"),
        n(F.col("inline_styles")).alias("inline_styles"),
        n(internal_css()).alias("internal_css"),
        n(external_css()).alias("external_css"),
        n(inline_scripts()).alias("inline_scripts"),
        n(external_scripts()).alias("external_scripts"),
        n(F.col("words")).alias("word_count"),
    )


def fetch_state() -> Column:
    return (
        F.when(~F.coalesce(U.has_web_scheme(F.col("url")), F.lit(False)), F.lit("bad_scheme"))
        .when(F.col("html").isNull(), F.lit("fetch_failed"))
        .when(F.col("html") == "", F.lit("empty"))
        .otherwise(F.lit("ok"))
    )


def quarantine(fetched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fetched pages as (pages to be parsed, pages set aside with their state).

    A page of another scheme, or one never fetched, has no record and so no
    score; an empty page goes on and gives an empty record.
    """
    bad = fetch_state().isin("bad_scheme", "fetch_failed")
    return fetched.filter(~bad), fetched.withColumn("state", fetch_state()).filter(F.col("state").isin("bad_scheme", "fetch_failed"))


def scan_quarantine(fetched: DataFrame) -> DataFrame:
    """Label each fetched page: usable, without content, or never fetched."""
    return fetched.select(
        "page_id",
        "url",
        fetch_state().alias("state"),
        F.length(F.coalesce("html", F.lit(""))).cast("bigint").alias("html_length"),
    )


def page_title(parsed: DataFrame) -> DataFrame:
    return parsed.select("page_id", "title")


def _meta_rows(parsed: DataFrame) -> DataFrame:
    return rows(parsed, meta_dict()).select(
        "page_id", "pos", F.col("e.name").alias("name"), F.col("e.content").alias("content")
    )


def meta_tags(parsed: DataFrame) -> DataFrame:
    return _meta_rows(parsed)


def open_graph(parsed: DataFrame) -> DataFrame:
    return _meta_rows(parsed).filter(F.col("name").startswith("og:")).drop("pos")


def twitter_cards(parsed: DataFrame) -> DataFrame:
    return _meta_rows(parsed).filter(F.col("name").startswith("twitter:")).drop("pos")


def page_directives(parsed: DataFrame) -> DataFrame:
    return parsed.select("page_id", *[last_meta(k).alias(k) for k in ("robots", "viewport", "charset", "language")])


def canonical_url(parsed: DataFrame) -> DataFrame:
    return parsed.select("page_id", first_link("canonical").alias("canonical_url"))


def favicon_url(parsed: DataFrame) -> DataFrame:
    return parsed.select("page_id", first_link("icon").alias("favicon"))


def sitemap_url(parsed: DataFrame) -> DataFrame:
    return parsed.select("page_id", first_link("sitemap").alias("sitemap"))


def rss_feeds(parsed: DataFrame) -> DataFrame:
    return rows(parsed, feeds()).select("page_id", "pos", "e.href", "e.title", "e.type")


def structured_data(parsed: DataFrame) -> DataFrame:
    return parsed.select(
        "page_id",
        n(json_ld()).alias("blocks"),
        F.get_json_object(F.get(json_ld(), F.lit(0)), "$.name").alias("first_name"),
    )


def structured_values(parsed: DataFrame) -> DataFrame:
    """Every value in the linked-data blocks of each page: ``block`` (from 1), ``path``, ``type``, ``value``.

    Objects and arrays are taken apart level by level until only plain values are left, so there are as many steps as the deepest
    block has levels. The path joins keys and positions (from 0) by slashes, in keys ``~`` and ``/`` are written ``~0`` and ``~1``. Values are text as in
    the block (texts without quotes), of null and empty containers null. Blocks that are no JSON are left out.
    """
    blocks = rows(parsed, F.transform(json_ld(), lambda b: F.struct(b.alias("text"))))
    level = blocks.select("page_id", F.col("pos").cast("bigint").alias("block"), F.lit("").alias("path"), F.try_parse_json("e.text").alias("v"))
    done = None
    while True:
        kind = F.schema_of_variant("v")
        level = materialize(level.select("page_id", "block", "path", "v", F.regexp_extract(kind, "^[A-Z]+", 0).alias("kind")), "values")
        holds = F.col("kind").isin("OBJECT", "ARRAY")
        inside = level.filter(holds).lateralJoin(level.sparkSession.tvf.variant_explode(F.col("v").outer()))
        key = F.coalesce(F.replace(F.replace("key", F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")), F.col("pos").cast("string"))
        deeper = inside.select("page_id", "block", F.concat("path", F.lit("/"), key).alias("path"), F.col("value").alias("v"))
        empty = F.col("kind").isin("OBJECT", "ARRAY") & F.to_json("v").isin("{}", "[]")
        plain = level.filter(~holds | empty)
        name = F.when(F.col("kind") == "OBJECT", "object").when(F.col("kind") == "ARRAY", "array").when(F.col("kind") == "STRING", "string")
        name = name.when(F.col("kind") == "BOOLEAN", "boolean").when(F.col("kind") == "VOID", "null").otherwise("number")
        value = F.when(~holds, F.variant_get("v", "$", "string"))
        found = plain.select("page_id", "block", "path", name.alias("type"), value.alias("value"))
        done = found if done is None else done.unionByName(found)
        if level.filter(holds).isEmpty():
            return done
        level = deeper



def headings(parsed: DataFrame) -> DataFrame:
    return rows(parsed, F.col("headings")).select("page_id", "pos", "e.level", "e.text")


def images(parsed: DataFrame) -> DataFrame:
    return rows(parsed, F.col("images")).select("page_id", "pos", "e.*")


def _anchor_rows(parsed: DataFrame) -> DataFrame:
    return rows(parsed, F.col("anchors")).select("page_id", "pos", "e.*")


def links_flat(parsed: DataFrame) -> DataFrame:
    return _anchor_rows(parsed).select("page_id", "pos", "href")


def link_resolve(parsed: DataFrame) -> DataFrame:
    rel = F.array_join(F.regexp_extract_all("rel", F.lit(r"\S+"), F.lit(0)), " ").alias("rel")
    return _anchor_rows(parsed).select("page_id", "pos", "href", "full_url", "text", "title", rel, "target")


def link_scope(parsed: DataFrame) -> DataFrame:
    return _anchor_rows(parsed).select("page_id", "pos", "full_url", "netloc", "internal")


def social_links(parsed: DataFrame) -> DataFrame:
    return _anchor_rows(parsed).filter("social").select("page_id", "pos", "full_url")


def script_hit_rows(parsed: DataFrame) -> DataFrame:
    return rows(parsed, script_hits()).select("page_id", "pos", "e.*")


def word_count(parsed: DataFrame) -> DataFrame:
    return parsed.select("page_id", n(F.col("words")).alias("word_count"))


@per_jvm
def keywords() -> Column:
    return top_keywords(F.col("words"))


def top_keyword_rows(parsed: DataFrame) -> DataFrame:
    return rows(parsed, keywords()).select("page_id", "e.*")


@per_jvm
def speed_columns() -> dict[str, Column]:
    return {
        "total_images": n(F.col("images")),
        "images_without_alt": count_if_in(F.col("images"), lambda i: i["alt"] == ""),
        "total_scripts": n(F.col("scripts")),
        "total_stylesheets": n(stylesheets()),
        "styled_elements": n(F.col("inline_styles")),
        "total_links": n(F.col("anchors")),
    }


def speed_indicators(parsed: DataFrame) -> DataFrame:
    return parsed.select("page_id", *[c.alias(k) for k, c in speed_columns().items()])


def text_rows(parsed: DataFrame, arr: Column, name: str) -> DataFrame:
    return rows(parsed, arr, elem=name)
