"""HTML scanning with JVM-side regular expressions.

Every loop in the patterns is possessive: matching stays linear in the
page length and never recurses, whatever the markup looks like.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cols import let

# Replaces each tag, so that neighbouring text nodes stay apart.
MARK = "\u0001"

# Rest of a tag after its first letters, honouring quoted attribute values.
_INSIDE = r"""[^=>]*+(?:=(?:\s*+"[^"]*+"|\s*+'[^']*+')?+[^=>]*+)*+"""
TAIL = _INSIDE + ">"
# A tag cut off by the end of the page: taken as a whole, so that the tag
# starts within it are not tried one after the other.
CUT_OFF = rf"</?[a-z]{_INSIDE}\z"
BOUND = r"(?=[\s/>])"

# Parts that hide whatever looks like markup inside them.
COMMENT = r"<!--.*?(?:-->|\z)"
SCRIPT = rf"<script{BOUND}{TAIL}.*?(?:</script\s*+>|\z)"
STYLE = rf"<style{BOUND}{TAIL}.*?(?:</style\s*+>|\z)"
DECLARATION = r"<[!?][^>]*+(?:>|\z)"
HIDING = rf"{COMMENT}|{SCRIPT}|{STYLE}"
WITH_ATTRIBUTES = rf"<[a-z][^\s/>=]*+[\s/]{TAIL}"

# Everything that is not text.
NON_TEXT = rf"(?is){HIDING}|{DECLARATION}|</?[a-z]{TAIL}|{CUT_OFF}"
# Group 1: scripts, styles, tags with attributes, bare image tags.
MARKS = rf"(?is){COMMENT}|{DECLARATION}|({SCRIPT}|{STYLE}|{WITH_ATTRIBUTES}|<img>)|{CUT_OFF}"
OPEN_TAG = rf"(?is)^<[a-z]{TAIL}"
ATTR = r"""([^\s/>=][^\s/>=]*+)(?:\s*+=++\s*+("[^"]*+"|'[^']*+'|[^\s>]*+))?+"""
SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]"
# The same characters one by one, for trimming.
BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
WORD = r"[\p{L}\p{N}_]+"


def _elements(name: str) -> str:
    """Group 1: elements up to the next open or close tag of the same family."""
    body = rf"(?:[^<]++|{HIDING}|<(?!/?{name}[\s/>])(?:/?[a-z]{_INSIDE}(?:>|\z))?+)*+"
    return rf"(?is){HIDING}|{DECLARATION}|(<{name}{BOUND}{TAIL}{body})|{WITH_ATTRIBUTES}|{CUT_OFF}"


ANCHORS = _elements("a")
TITLES_AND_HEADINGS = _elements("(?:h[1-6]|title)")


# ---- entities ---------------------------------------------------------
def _pack_entities() -> str:
    first = ("amp;", "lt;", "gt;", "quot;", "nbsp;", "copy;")
    ordered = {**{k: html5[k] for k in first}, **html5}
    return "\u0002".join(f"{k}\u0003{v}" for k, v in ordered.items())


_NAMES = _pack_entities()


def _named_character(key: Column) -> Column:
    # The table is one foldable expression: the optimizer makes it a map literal.
    return F.try_element_at(F.str_to_map(F.lit(_NAMES), F.lit("\u0002"), F.lit("\u0003")), key)


#: Numbers 128 to 159 mean Windows-1252 characters, where that has one.
_CP1252 = {chr(i): bytes([i]).decode("cp1252", "ignore") for i in range(128, 160) if bytes([i]).decode("cp1252", "ignore")}


def _code_point(cp: Column) -> Column:
    bad = cp.isNull() | (cp <= 0) | (cp > 0x10FFFF) | cp.between(0xD800, 0xDFFF)
    safe = F.when(bad, F.lit(0xFFFD)).otherwise(cp).cast("bigint")
    return F.translate(F.decode(F.unhex(F.lpad(F.hex(safe), 8, "0")), "UTF-32"), "".join(_CP1252), "".join(_CP1252.values()))


def _decode(text: Column, in_attribute: bool) -> Column:
    def piece(p: Column) -> Column:
        name = F.regexp_extract(p, "^&([a-zA-Z0-9]+)", 1)
        hexa = F.regexp_extract(p, "^&#[xX]([0-9a-fA-F]+)", 1)
        deci = F.regexp_extract(p, "^&#([0-9]+)", 1)
        cp = F.coalesce(
            F.conv(F.nullif(hexa, F.lit("")), 16, 10).try_cast("bigint"), F.nullif(deci, F.lit("")).try_cast("bigint")
        )
        if in_attribute:
            named = F.coalesce(_named_character(F.substring(p, F.lit(2), F.length(p))), p)
        else:
            named = F.coalesce(_named_character(F.concat(name, F.lit(";"))), F.concat(F.lit("&"), name))
        return (
            F.when((p == "&") | ~p.startswith("&"), p)
            .when(p.startswith("&#"), _code_point(cp))
            .otherwise(named)
        )

    pattern = F.lit(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);?|[^&]+|&")
    pieces = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), piece)
    return F.when(F.contains(text, F.lit("&")), F.array_join(pieces, "")).otherwise(text)


def decode_text(text: Column) -> Column:
    """Decode character references of text; an unknown one loses its semicolon."""
    return _decode(text, in_attribute=False)


def decode_attr(text: Column) -> Column:
    """Decode character references of attribute values."""
    return _decode(text, in_attribute=True)


# ---- tags -------------------------------------------------------------
def _found(html: Column, pattern: str) -> Column:
    return F.filter(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), lambda m: m != "")


def scan_marks(html: Column) -> Column:
    """Script and style elements, tags with attributes, image tags; in document order."""
    return _found(html, MARKS)


def scan_anchors(html: Column) -> Column:
    return _found(html, ANCHORS)


def scan_titles_and_headings(html: Column) -> Column:
    return _found(html, TITLES_AND_HEADINGS)


def visible_text(html: Column) -> Column:
    """Text nodes joined without separator, character references decoded."""
    marked = F.regexp_replace(html, F.lit(NON_TEXT), F.lit(MARK))
    return F.replace(let(marked, decode_text), F.lit(MARK), F.lit(""))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def named(marks: Column, tag: str) -> Column:
    return F.filter(marks, lambda m: m.rlike(rf"(?i)^<{tag}[\s/>]"))


def _unquote(raw: Column) -> Column:
    bare = F.when(raw.rlike("^[\"']"), F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)
    return decode_attr(bare)


def open_tag(element: Column) -> Column:
    return F.regexp_extract(element, OPEN_TAG, 0)


def attributes(tag: Column) -> Column:
    """Names and values of an open tag, reversed so that the last duplicate is found first."""
    body = F.regexp_replace(tag, F.lit(r"^<[^\s/>]*+"), F.lit(""))
    return let(
        body,
        lambda b: F.struct(
            F.reverse(F.transform(F.regexp_extract_all(b, F.lit(ATTR), F.lit(1)), F.lower)).alias("names"),
            F.reverse(F.transform(F.regexp_extract_all(b, F.lit(ATTR), F.lit(2)), _unquote)).alias("values"),
        ),
    )


def attr(parsed: Column, name: str) -> Column:
    """Value of an attribute, '' if it has none, NULL if absent."""
    return F.get(parsed["values"], F.array_position(parsed["names"], name).cast("int") - 1)


def element_body(element: Column) -> Column:
    """What follows the open tag, with a mark for each thing that is not text."""
    return F.regexp_replace(F.regexp_replace(element, F.lit(OPEN_TAG), F.lit("")), F.lit(NON_TEXT), F.lit(MARK))


def inner_text(element: Column) -> Column:
    """Text of an element: every text node trimmed, joined without separator."""
    apart = let(element_body(element), decode_text)
    joined = F.regexp_replace(apart, F.lit(f"(?<!{SPACE})(?:{SPACE}*+{MARK})++{SPACE}*+"), F.lit(""))
    return F.btrim(joined, F.lit(BLANKS))


def raw_body(mark: Column, name: str) -> Column:
    """Body of a script or style element."""
    return F.regexp_replace(
        mark, F.lit(rf"(?is)^<{name}{BOUND}{TAIL}|</{name}\s*+>\z"), F.lit("")
    )


def has_token(rel: Column, token: str) -> Column:
    """Whitespace-separated token test, as used for ``rel``."""
    return F.coalesce(F.array_contains(F.split(rel, r"\s+"), token), F.lit(False))


def preview(text: Column) -> Column:
    """First 200 characters, with an ellipsis if anything was cut."""
    return F.when(F.length(text) > 200, F.concat(F.left(text, F.lit(200)), F.lit("..."))).otherwise(text)
