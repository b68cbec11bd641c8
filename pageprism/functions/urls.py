"""URL and name scalars as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cols import let


def netloc(url: Column) -> Column:
    """Authority part (port and user info kept), '' if there is none."""
    return F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)", 1)


def whole_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def url_path(url: Column) -> Column:
    """Path without query, fragment and the parameters of its last segment."""
    return F.regexp_replace(whole_path(url), F.lit(r";[^/]*$"), F.lit(""))


def site_key(url: Column) -> Column:
    """Lower-cased authority with every ``www.`` removed."""
    return F.replace(F.lower(netloc(url)), F.lit("www."), F.lit(""))


def base_parts(url: Column) -> Column:
    return F.struct(
        F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1).alias("scheme"),
        netloc(url).alias("netloc"),
        whole_path(url).alias("path"),
        F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1).alias("query"),
        url.alias("url"),
    )


def _fold(segments: Column) -> Column:
    """Path text of segments with ``.`` and ``..`` resolved.

    Any run of segments folds to the segments left and the number of earlier ones it
    takes away, and such results fold in the same way. Runs of about the cube root
    of the number of segments are folded in three levels, so arrays are
    copied to the power 4/3 of their number at most: a path of a million
    segments ends, too.
    """
    state = lambda kept, up: F.struct(kept.alias("kept"), up.alias("up"))
    start = state(F.array().cast("array<string>"), F.lit(0))

    def step(acc: Column, seg: Column) -> Column:
        kept, up = acc["kept"], acc["up"]
        return (
            F.when((seg == "..") & (F.size(kept) > 0), state(F.slice(kept, F.lit(1), F.size(kept) - 1), up))
            .when(seg == "..", state(kept, up + 1))
            .when(seg == ".", acc)
            .otherwise(state(F.concat(kept, F.array(seg)), up))
        )

    def merge(acc: Column, r: Column) -> Column:
        left = F.size(acc["kept"]) - r["up"]
        rest = F.slice(acc["kept"], F.lit(1), F.greatest(left, F.lit(0)))
        return state(F.concat(rest, r["kept"]), acc["up"] - F.least(left, F.lit(0)))

    def runs(arr: Column, width: Column, fold) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(arr) - 1) / width).cast("int"))
        return F.transform(starts, lambda i: F.aggregate(F.slice(arr, i * width + 1, width), start, fold))

    def folded(segs: Column) -> Column:
        width = F.ceil(F.cbrt(F.size(segs))).cast("int")
        ends_in_dots = F.element_at(segs, -1).isin(".", "..")
        small = lambda: runs(segs, width, step)
        kept = let(let(small(), lambda r: runs(r, width, merge)), lambda r: F.aggregate(r, start, merge)["kept"])
        return let(
            kept,
            lambda k: F.concat(F.array_join(k, "/"), F.when(ends_in_dots & (F.size(k) > 0), F.lit("/")).otherwise(F.lit(""))),
        )

    return let(let(segments, folded), lambda w: F.when(w.startswith("/"), w).otherwise(F.concat(F.lit("/"), w)))


def _absolute_path(folder: Column, path: Column) -> Column:
    """Path below the site root; a relative one also loses its empty inner segments."""

    def relative(p: Column) -> Column:
        inner = lambda parts: F.filter(parts, lambda x, i: (i == 0) | (i == F.size(parts) - 1) | (x != ""))
        return F.when(p.rlike(r"//|/\."), _fold(let(F.split(p, "/"), inner))).otherwise(p)

    rooted = F.when(path.rlike(r"/\."), _fold(F.split(path, "/"))).otherwise(path)
    return F.when(path.startswith("/"), rooted).otherwise(let(F.concat(folder, path), relative))


def resolve(base: Column, href: Column) -> Column:
    """Absolute form of ``href`` on a page whose ``base_parts`` are ``base``."""

    def joined(h: Column) -> Column:
        path = F.regexp_extract(h, r"^([^?#]*)", 1)
        query = F.regexp_extract(h, r"^[^?#]*\?([^#]*)", 1)
        frag = F.regexp_extract(h, r"#(.*)$", 1)
        tail = lambda mark, v: F.when(v != "", F.concat(F.lit(mark), v)).otherwise(F.lit(""))
        root = F.concat(base["scheme"], F.lit("://"), base["netloc"])
        folder = F.coalesce(F.nullif(F.regexp_extract(base["path"], r"^(.*/)", 1), F.lit("")), F.lit("/"))
        return (
            F.when(h == "", base["url"])
            .when(h.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), h)
            .when(h.startswith("//"), F.concat(base["scheme"], F.lit(":"), path, tail("?", query), tail("#", frag)))
            .when(
                path == "",
                F.concat(
                    root, base["path"], tail("?", F.when(query != "", query).otherwise(base["query"])), tail("#", frag)
                ),
            )
            .otherwise(F.concat(root, _absolute_path(folder, path), tail("?", query), tail("#", frag)))
        )

    cleaned = F.regexp_replace(href, F.lit(r"^[\x00-\x20]+|[\t\r\n]+"), F.lit(""))
    return F.when(href.startswith("http"), href).otherwise(let(cleaned, joined))


def normalize_domain(raw: Column) -> Column:
    """Authority without ``www.``, or the raw text; trailing slashes removed."""
    loc = netloc(raw)
    picked = F.when(loc != "", F.replace(loc, F.lit("www."), F.lit(""))).otherwise(raw)
    return F.rtrim(picked, F.lit("/"))


# Fixed value: accepted domain names, label by label.
DOMAIN_PATTERN = r"^[a-zA-Z0-9]([a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?(\.[a-zA-Z0-9]([a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?)*$"


def domain_valid(domain: Column) -> Column:
    return domain.rlike(DOMAIN_PATTERN) & (F.length(domain) <= 253)


def has_web_scheme(url: Column) -> Column:
    return url.startswith("http://") | url.startswith("https://")


def ensure_scheme(domain: Column) -> Column:
    return F.when(has_web_scheme(domain), domain).otherwise(F.concat(F.lit("https://"), domain))


def safe_name(url: Column, stamp: Column) -> Column:
    """Directory name of a scrape; the suffix hashes url and time, so reruns agree."""
    domain = F.replace(F.replace(netloc(url), F.lit("www."), F.lit("")), F.lit("."), F.lit("_"))
    flat = F.translate(url_path(url), "/\\", "__")
    path = F.when(flat.isin("", "_"), F.lit("home")).otherwise(F.regexp_replace(flat, F.lit("^_+"), F.lit("")))
    text = F.left(F.date_format(stamp, "yyyyMMdd_HHmmss_SSSSSS"), F.lit(19))
    suffix = F.left(F.sha2(F.concat(url, F.lit("|"), text), 256), F.lit(8))
    return F.concat_ws("_", domain, path, text, suffix)


def title_case(text: Column) -> Column:
    """Capital after every non-letter, lower case elsewhere."""
    runs = F.regexp_extract_all(text, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(
        F.transform(runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.lower(F.substring(r, F.lit(2), F.length(r))))), ""
    )


def full_name(given: Column, family: Column) -> Column:
    """Given and family name, or the one present, or NULL."""
    joined = F.concat_ws(" ", F.nullif(given, F.lit("")), F.nullif(family, F.lit("")))
    return F.nullif(joined, F.lit(""))


def display_name(given: Column, family: Column, email: Column) -> Column:
    local = F.replace(F.split_part(email, F.lit("@"), F.lit(1)), F.lit("."), F.lit(" "))
    return F.coalesce(full_name(given, family), title_case(local))


def token_name(given: Column, family: Column, email: Column) -> Column:
    return F.coalesce(full_name(given, family), F.nullif(email, F.lit("")), F.lit("Unknown User"))


def safe_label(name: Column) -> Column:
    """Letters, digits, blanks, ``-`` and ``_`` only; right-trimmed."""
    return F.rtrim(F.regexp_replace(name, F.lit(r"[^\p{L}\p{N} _\-]"), F.lit("")))


def stored_path(path: Column, bucket: str) -> Column:
    """Move local, relative or bare directory names below the bucket."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.when(path.startswith("s3://"), path).otherwise(
        F.concat(F.lit(f"s3://{bucket}/scraped_sites/"), name)
    )
