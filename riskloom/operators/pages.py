"""Page-level jobs: one row in, one row out, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import html as H
from riskloom.functions.expr import let, record
from riskloom.functions.regex import extract, extract_all, matches
from riskloom.functions.text import js_trim
from riskloom.functions.urls import absolutize_in, base_parts, host_of, page_url_in
from riskloom.rules import web as rules

# ---- fixed values -------------------------------------------------------------------------

ANCHOR_HREF = r"<a\b[^>]*?\shref=[\"']([^\"']*)[\"']"
SITEMAP_LOC = r"<loc>([\s\S]*?)</loc>"
XML_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&")]
SCRIPT_SRC = r"<script\b[^>]*?\ssrc=[\"']([^\"']*)[\"']"
IMG_SRC = r"<img\b[^>]*?\ssrc=[\"']([^\"']*)[\"']"
LINK_TAG = r"<link\b[^>]*>"
REL_VALUE = r"\brel=[\"']([^\"']*)[\"']"
HREF_VALUE = r"\bhref=[\"']([^\"']*)[\"']"
NON_ASSET_REL = r"\b(?:canonical|alternate|preconnect|dns-prefetch)\b"
ICON_REL = r"\bicon\b"
SCRIPT_REFS = [
    r"<script[^>]+src=[\"']([^\"']+)[\"']",
    r"<link[^>]+href=[\"']([^\"']+\.js)[\"']",
    r"[\"'](/assets/[A-Za-z0-9._-]+\.js)[\"']",
]
CHUNK_REF = r"[\"'`]([./][A-Za-z0-9/._-]*\.js)[\"'`]"

# ---- end of fixed values ------------------------------------------------------------------


def page_signals(pages: DataFrame, html: str = "html") -> DataFrame:
    """Fourteen signals per page. The stripped texts are columns so each is computed once, and the
    document itself does not travel past this projection."""
    keys = [c for c in pages.columns if c != html]
    windows = (
        pages.withColumn("_full", H.strip_comments(F.col(html)))
        .withColumn("_visible", H.strip_inert(F.col("_full")))
    )
    signals = H.page_signal_columns(
        F.col(html), F.col("_full"), F.col("_full"), F.col("_visible")
    )
    return windows.select(*keys, *[c.alias(n) for n, c in signals.items()])


def detect_framework(html: Column) -> Column:
    # Each outcome is tested over the whole document; the first in list order wins.
    found = None
    for name, pattern, fold in rules.FRAMEWORKS:
        cond = matches(html, pattern, fold)
        found = F.when(cond, name) if found is None else found.when(cond, name)
    module = F.exists(
        H.tags(html, "script"),
        lambda t: matches(F.coalesce(H.attr(t, "type"), F.lit("")), "module")
        & matches(t, r"\bcrossorigin\b"),
    )
    vite = matches(html, rules.VITE_ENTRY, False) | module
    react = matches(html, rules.REACT_ROOT, False)
    return found.when(vite & react, "Vite + React").when(vite, "Vite")


def platform_domain(host: Column) -> Column:
    out = None
    for suffix in rules.PLATFORM_DOMAINS:
        cond = (host == suffix) | host.endswith("." + suffix)
        out = F.when(cond, suffix) if out is None else out.when(cond, suffix)
    return out


def _own_parts(base: Column) -> Column:
    return record(base=base_parts(base), host=host_of(base))


def internal_links(html: Column, base: Column) -> Column:
    """Distinct same-host pages in document order, the page itself left out."""

    def collect(own: Column) -> Column:
        found = F.transform(
            extract_all(html, ANCHOR_HREF, 1), lambda ref: page_url_in(ref, own["base"])
        )
        urls = F.transform(
            F.filter(found, lambda p: p.isNotNull() & (p["host"] == own["host"])), lambda p: p["url"]
        )
        self_url = F.coalesce(page_url_in(base, own["base"])["url"], F.lit(""))
        return F.array_except(urls, F.array(self_url))

    return let(_own_parts(base), collect)


def decode_xml(text: Column) -> Column:
    out = js_trim(text)
    for entity, char in XML_ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def sitemap_urls(xml: Column, host: Column) -> Column:
    def collect(base: Column) -> Column:
        found = F.transform(
            extract_all(xml, SITEMAP_LOC, 1), lambda loc: page_url_in(decode_xml(loc), base)
        )
        same = F.filter(found, lambda p: p.isNotNull() & (p["host"] == base["host"]))
        return F.array_distinct(F.transform(same, lambda p: p["url"]))

    return let(base_parts(F.concat(F.lit("https://"), host, F.lit("/"))), collect)


def _resolved(refs: Column, base: Column, same_host: bool) -> Column:
    """Absolute URLs of the references, each once, in order."""

    def collect(own: Column) -> Column:
        urls = F.filter(
            F.transform(refs, lambda r: absolutize_in(r, own["base"])), lambda u: u.isNotNull()
        )
        if same_host:
            urls = F.filter(urls, lambda u: host_of(u) == own["host"])
        return F.array_distinct(urls)

    return let(_own_parts(base), collect)


def page_assets(html: Column, base: Column) -> Column:
    """Same-host scripts, then images, then linked files, each once."""
    link_tags = F.filter(
        extract_all(html, LINK_TAG, 0),
        lambda t: ~matches(extract(t, REL_VALUE, 1), NON_ASSET_REL),
    )
    hrefs = F.transform(link_tags, lambda t: extract(t, HREF_VALUE, 1))
    refs = F.concat(
        extract_all(html, SCRIPT_SRC, 1),
        extract_all(html, IMG_SRC, 1),
        F.filter(hrefs, lambda h: h != ""),
    )
    return _resolved(refs, base, same_host=True)


def favicon_href(html: Column) -> Column:
    icons = F.filter(
        F.transform(
            F.filter(
                extract_all(html, LINK_TAG, 0),
                lambda t: matches(extract(t, REL_VALUE, 1), ICON_REL),
            ),
            lambda t: F.trim(extract(t, HREF_VALUE, 1)),
        ),
        lambda h: h != "",
    )
    return F.get(icons, F.lit(0))


def script_urls(html: Column, base: Column) -> Column:
    """Every script a page refers to, same host or not."""
    refs = F.concat(*[extract_all(html, p, 1) for p in SCRIPT_REFS])
    return _resolved(refs, base, same_host=False)


def bundle_chunks(js: Column, base: Column) -> Column:
    """One more level of scripts named in a bundle, where secrets often sit in a lazy chunk."""
    refs = extract_all(js, CHUNK_REF, 1, ignore_case=False)
    return F.filter(_resolved(refs, base, same_host=False), lambda u: u.endswith(".js"))


def fingerprint_columns() -> dict[str, Column]:
    """Twelve signals of a home page row that carries page signals, files and bundle bytes."""
    c = F.col
    client = (c("body_text_length") < rules.EMPTY_TEXT_CHARS) & c("has_script_src")
    signals = [
        ("default platform domain", c("platform_domain").isNotNull()),
        ("content rendered by scripts only", client),
        ("no title", c("title").isNull()),
        ("no meta description", c("meta_description").isNull()),
        ("no Open Graph tags", c("og_title").isNull() & c("og_image").isNull()),
        ("no canonical URL", c("canonical").isNull()),
        ("no structured data", c("json_ld_blocks") == 0),
        ("no sitemap.xml", ~c("has_sitemap")),
        ("no favicon", ~c("favicon_link") & ~c("favicon_ok")),
        ("no lang attribute", c("lang").isNull()),
        ("no llms.txt", ~c("has_llms")),
        ("scripts over 1 MB", c("js_bytes") > rules.HEAVY_BYTES),
    ]
    fired = F.filter(
        F.array(*[F.when(cond, F.lit(name)) for name, cond in signals]), lambda s: s.isNotNull()
    )
    return {
        "client_rendered": client,
        "signals": fired,
        "score": F.size(fired),
        "total": F.lit(rules.FINGERPRINT_TOTAL),
    }
