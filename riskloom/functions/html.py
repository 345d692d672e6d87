"""Reading tags and text out of captured HTML with built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.functions.expr import let
from riskloom.functions.regex import extract, extract_all, java, matches
from riskloom.functions.text import clean, collapse_spaces

# ---- fixed values -------------------------------------------------------------------------

COMMENT = r"<!--[\s\S]*?-->"
INERT = r"<(script|style|noscript)\b[^>]*>[\s\S]*?</\1>"
TAG = r"<[^>]+>"
TITLE = r"<title[^>]*>([\s\S]*?)</title>"
HTML_TAG = r"<html\b[^>]*>"
H1 = r"<h1(?:\s[^>]*)?>"
SCRIPT = r"<script\b([^>]*)>([\s\S]*?)</script>"
HAS_SRC = r"\bsrc\s*="
DATA_TYPE = r"\btype\s*=\s*[\"']?[^\"'>]*(?:ld\+json|json|importmap)"
HTML_START = r"^\s*(?:<!doctype\s+html|<html[\s>]|<head[\s>]|<body[\s>])"
ICON_RELS = ["icon", "apple-touch-icon", "mask-icon"]

# ---- end of fixed values ------------------------------------------------------------------


def tags(html: Column, name: str) -> Column:
    return extract_all(html, rf"<{name}\b[^>]*>", 0)


def attr(tag: Column, name: str) -> Column:
    """Attribute value, ``''`` when present and empty, null when absent.

    One regex per attribute: the raw value with its quotes, which are then taken off.
    """
    raw = extract(tag, rf"\b{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", 1)
    return let(
        raw,
        lambda r: F.when(
            r != "",
            F.when(F.left(r, F.lit(1)).isin('"', "'"), F.substr(r, F.lit(2), F.length(r) - 2)).otherwise(r),
        ),
    )


def strip_comments(html: Column) -> Column:
    return F.regexp_replace(html, java(COMMENT), " ")


def strip_inert(html: Column) -> Column:
    return F.regexp_replace(html, java(INERT, True), " ")


def visible_text_length(html: Column) -> Column:
    text = F.regexp_replace(strip_inert(strip_comments(html)), java(TAG), " ")
    return F.length(F.trim(collapse_spaces(text)))


def inline_script_bytes(html: Column) -> Column:
    scripts = F.arrays_zip(
        extract_all(html, SCRIPT, 1).alias("attrs"), extract_all(html, SCRIPT, 2).alias("body")
    )
    code = F.filter(
        scripts, lambda s: ~matches(s["attrs"], HAS_SRC) & ~matches(s["attrs"], DATA_TYPE)
    )
    return F.aggregate(
        code, F.lit(0).cast("long"), lambda n, s: n + F.octet_length(s["body"]).cast("long")
    )


def starts_like_html(body: Column) -> Column:
    return matches(body, HTML_START)


def rels(tag: Column) -> Column:
    return F.split(F.lower(F.coalesce(attr(tag, "rel"), F.lit(""))), r"\s+")


def _first(items: Column) -> Column:
    return F.get(items, F.lit(0))


def page_signal_columns(html: Column, doc: Column, full: Column, visible: Column) -> dict[str, Column]:
    """The signals of one page, read over the whole document; ``full`` has no comments."""
    metas = F.transform(
        tags(doc, "meta"),
        lambda t: F.struct(
            F.lower(F.coalesce(attr(t, "name"), attr(t, "property"), F.lit(""))).alias("key"),
            clean(attr(t, "content")).alias("content"),
        ),
    )

    def meta(key: str) -> Column:
        return _first(F.filter(metas, lambda m: (m["key"] == key) & m["content"].isNotNull()))[
            "content"
        ]

    links = tags(doc, "link")
    canonical = _first(
        F.filter(
            F.transform(
                F.filter(links, lambda t: F.array_contains(rels(t), "canonical")),
                lambda t: clean(attr(t, "href")),
            ),
            lambda h: h.isNotNull(),
        )
    )
    icons = F.array(*[F.lit(r) for r in ICON_RELS])
    images = tags(visible, "img")
    text = F.trim(collapse_spaces(F.regexp_replace(visible, java(TAG), " ")))
    return {
        "title": clean(F.nullif(extract(doc, TITLE, 1), F.lit(""))),
        "meta_description": meta("description"),
        "canonical": canonical,
        "og_title": meta("og:title"),
        "og_image": meta("og:image"),
        "lang": clean(attr(extract(doc, HTML_TAG, 0), "lang")),
        "h1_count": F.size(extract_all(visible, H1, 0)),
        "json_ld_blocks": F.size(
            F.filter(
                tags(doc, "script"),
                lambda t: F.lower(F.coalesce(attr(t, "type"), F.lit(""))).contains("ld+json"),
            )
        ),
        "img_total": F.size(images),
        "img_without_alt": F.size(F.filter(images, lambda t: attr(t, "alt").isNull())),
        "favicon_link": F.exists(links, lambda t: F.arrays_overlap(rels(t), icons)),
        "body_text_length": F.length(text),
        "inline_script_bytes": inline_script_bytes(html),
    }
