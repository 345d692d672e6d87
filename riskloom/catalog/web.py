"""Website queries: pages, sites, checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.catalog import seeds
from riskloom.catalog.registry import expression, query
from riskloom.functions import html as H
from riskloom.operators import config as C
from riskloom.operators import pages as P
from riskloom.operators import sites as S
from riskloom.operators.captures import site_files
from riskloom.functions.text import format_bytes, page_outline, same_outline
from riskloom.functions.urls import host_of, normalize_page_url
from riskloom.rules import web as rules
from riskloom.sources.captures import captured_responses
from riskloom.sources.tables import table

# ---- SQL twins: page signals ---------------------------------------------------------------

NOCOMMENT = "regexp_replace(html, '<!--[\\s\\S]*?-->', ' ', 'g')"
INERT = r"(?i)<script\b[^>]*>[\s\S]*?</script>|<style\b[^>]*>[\s\S]*?</style>|<noscript\b[^>]*>[\s\S]*?</noscript>"


def _sql_attr(tag: str, name: str) -> str:
    p = rf"""(?i)\b{name}\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))"""
    return (
        f"CASE WHEN regexp_matches({tag}, '{p}') THEN regexp_extract({tag}, '{p}', 1) || "
        f"regexp_extract({tag}, '{p}', 2) || regexp_extract({tag}, '{p}', 3) END"
    )


def _sql_clean(text: str) -> str:
    return f"nullif(trim(regexp_replace({text}, '\\s+', ' ', 'g')), '')"


def _sql_meta(key: str) -> str:
    return (
        f"list_filter(metas, lambda m: m.key = '{key}' AND m.content IS NOT NULL)[1].content"
    )


expression(
    "page_windows",
    f"""SELECT site, page_id, url, html, {NOCOMMENT} AS doc,
    regexp_replace({NOCOMMENT}, '{INERT}', ' ', 'g') AS visible FROM site_pages""",
)
expression(
    "page_tags",
    rf"""SELECT site, page_id, url, html, doc, visible,
    list_transform(regexp_extract_all(doc, '(?i)<meta\b[^>]*>'), lambda t: {{'key':
        lower(coalesce({_sql_attr('t', 'name')}, {_sql_attr('t', 'property')}, '')),
        'content': {_sql_clean(_sql_attr('t', 'content'))}}}) AS metas,
    list_transform(regexp_extract_all(doc, '(?i)<link\b[^>]*>'), lambda t: {{'rels':
        regexp_split_to_array(lower(coalesce({_sql_attr('t', 'rel')}, '')), '\s+'),
        'href': {_sql_clean(_sql_attr('t', 'href'))}}}) AS links,
    regexp_extract_all(visible, '(?i)<img\b[^>]*>') AS images,
    list_zip(regexp_extract_all(html, '(?i)<script\b([^>]*)>([\s\S]*?)</script>', 1),
        regexp_extract_all(html, '(?i)<script\b([^>]*)>([\s\S]*?)</script>', 2)) AS scripts
    FROM page_windows""",
)
expression(
    "page_signal_rows",
    rf"""SELECT site, page_id, url,
    {_sql_clean("regexp_extract(doc, '(?i)<title[^>]*>([\\s\\S]*?)</title>', 1)")} AS title,
    {_sql_meta('description')} AS meta_description,
    list_filter(list_filter(links, lambda l: list_contains(l.rels, 'canonical')), lambda l: l.href IS NOT NULL)[1].href AS canonical,
    {_sql_meta('og:title')} AS og_title, {_sql_meta('og:image')} AS og_image,
    {_sql_clean(_sql_attr(r"regexp_extract(doc, '(?i)<html\b[^>]*>')", 'lang'))} AS lang,
    len(regexp_extract_all(visible, '(?i)<h1(?:\s[^>]*)?>')) AS h1_count,
    len(list_filter(regexp_extract_all(doc, '(?i)<script\b[^>]*>'),
        lambda t: contains(lower(coalesce({_sql_attr('t', 'type')}, '')), 'ld+json'))) AS json_ld_blocks,
    len(images) AS img_total,
    len(list_filter(images, lambda t: ({_sql_attr('t', 'alt')}) IS NULL)) AS img_without_alt,
    len(list_filter(links, lambda l: list_has_any(l.rels, ['icon', 'apple-touch-icon', 'mask-icon']))) > 0 AS favicon_link,
    length(trim(regexp_replace(regexp_replace(visible, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS body_text_length,
    coalesce(list_sum(list_transform(list_filter(scripts, lambda s: NOT regexp_matches(s[1], '(?i)\bsrc\s*=')
        AND NOT regexp_matches(s[1], '(?i)\btype\s*=\s*["'']?[^"''>]*(?:ld\+json|json|importmap)')),
        lambda s: strlen(s[2]))), 0)::BIGINT AS inline_script_bytes
    FROM page_tags""",
)

SIGNALS = (
    "title, meta_description, canonical, og_title, og_image, lang, h1_count, json_ld_blocks, "
    "img_total, img_without_alt, favicon_link, body_text_length, inline_script_bytes"
)


@query("scan_pages", "SELECT page_id, url, strlen(html) AS html_bytes FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", "url", F.octet_length("html").cast("long").alias("html_bytes")
    )


@query("page_signals", f"SELECT site, page_id, url, {SIGNALS} FROM page_signal_rows")
def _(spark, sf):
    return P.page_signals(seeds.site_pages(spark, sf))


@query(
    "strip_comments",
    f"SELECT page_id, length({NOCOMMENT}) AS kept, md5({NOCOMMENT}) AS digest FROM site_pages",
)
def _(spark, sf):
    out = H.strip_comments(F.col("html"))
    return seeds.site_pages(spark, sf).select(
        "page_id", F.length(out).cast("long").alias("kept"), F.md5(out.cast("binary")).alias("digest")
    )


@query(
    "strip_inert",
    f"""SELECT page_id, length(t) AS kept, md5(t) AS digest
    FROM (SELECT page_id, regexp_replace(html, '{INERT}', ' ', 'g') AS t FROM site_pages)""",
)
def _(spark, sf):
    out = H.strip_inert(F.col("html"))
    return seeds.site_pages(spark, sf).select(
        "page_id", F.length(out).cast("long").alias("kept"), F.md5(out.cast("binary")).alias("digest")
    )


@query("visible_text_length", "SELECT page_id, body_text_length AS visible FROM page_signal_rows")
def _(spark, sf):
    return seeds.site_pages(spark, sf).select(
        "page_id", H.visible_text_length(F.col("html")).cast("long").alias("visible")
    )


@query("inline_script_bytes", "SELECT page_id, inline_script_bytes FROM page_signal_rows")
def _(spark, sf):
    return seeds.site_pages(spark, sf).select(
        "page_id", H.inline_script_bytes(F.col("html")).alias("inline_script_bytes")
    )


def _sql_framework(h: str) -> str:
    module = (
        rf"len(list_filter(regexp_extract_all({h}, '(?i)<script\b[^>]*>'), lambda t: regexp_matches(coalesce("
        rf"{_sql_attr('t', 'type')}, ''), '(?i)module') AND regexp_matches(t, '(?i)\bcrossorigin\b'))) > 0"
    )
    root = rules.REACT_ROOT.replace("'", "''").replace('\\"', '"')
    vite = f"(regexp_matches({h}, '{rules.VITE_ENTRY}') OR {module})"
    return (
        f"CASE {_cases(h)} "
        f"WHEN {vite} AND regexp_matches({h}, '{root}') THEN 'Vite + React' WHEN {vite} THEN 'Vite' END"
    )


def _cases(h: str) -> str:
    return " ".join(
        f"WHEN regexp_matches({h}, '{'(?i)' if fold else ''}{p}') THEN '{name}'"
        for name, p, fold in rules.FRAMEWORKS
    )


@query("detect_framework", f"SELECT page_id, {_sql_framework('html')} AS framework FROM site_pages")
def _(spark, sf):
    return seeds.site_pages(spark, sf).select(
        "page_id", P.detect_framework(F.col("html")).alias("framework")
    )


# Hosts of the given pages put under one of the suffixes in turn, every third one left alone.
_SUFFIXES = "[" + ", ".join(f"'{d}'" for d in rules.PLATFORM_DOMAINS) + "]"
_PLATFORM_HOST = (
    f"CASE WHEN page_id % 3 = 0 THEN site ELSE site || '.' || {_SUFFIXES}[(page_id % 11)::INT + 1] END"
)
_PLATFORM_CASES = " ".join(
    f"WHEN host = '{d}' OR ends_with(host, '.{d}') THEN '{d}'" for d in rules.PLATFORM_DOMAINS
)


@query(
    "platform_domain",
    f"""SELECT page_id, host, CASE {_PLATFORM_CASES} END AS platform
    FROM (SELECT page_id, {_PLATFORM_HOST} AS host FROM (SELECT page_id, {seeds.HOST_SQL} AS site FROM pages))""",
)
def _(spark, sf):
    site = host_of(F.col("url"))
    suffixes = F.array(*[F.lit(d) for d in rules.PLATFORM_DOMAINS])
    host = F.when(F.col("page_id") % 3 == 0, site).otherwise(
        F.concat_ws(".", site, F.get(suffixes, (F.col("page_id") % 11).cast("int")))
    )
    return (
        table(spark, sf, "pages")
        .select("page_id", host.alias("host"))
        .withColumn("platform", P.platform_domain(F.col("host")))
    )


# ---- links ----------------------------------------------------------------------------------

ASSET_EXT = r"(?i)\.(?:pdf|jpe?g|png|gif|svg|webp|zip|mp4|css|js|xml|ico|woff2?|txt)$"


def _sql_encode(text: str, unsafe: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all({text}, '[{unsafe}]+|[^{unsafe}]+'), "
        f"lambda r: CASE WHEN regexp_matches(r, '^[{unsafe}]') THEN url_encode(r) ELSE r END), '')"
    )


_PATH_UNSAFE = r'\x00-\x20"<>`{}\x7F-\x{10FFFF}'


def _sql_resolved(ref: str, base: str, alias: str) -> str:
    """Columns scheme, host, path, query of a reference without dot segments or odd schemes."""
    return f"""SELECT *,
        CASE WHEN regexp_matches({ref}, '(?i)^https?:') THEN lower(regexp_extract({ref}, '^([A-Za-z]+):', 1))
            ELSE lower(regexp_extract({base}, '^([A-Za-z]+):', 1)) END AS r_scheme,
        CASE WHEN regexp_matches({ref}, '(?i)^https?://') THEN lower(regexp_extract({ref}, '^[^:]*://([^/?#]*)', 1))
            ELSE lower(regexp_extract({base}, '^[^:]*://([^/?#]*)', 1)) END AS r_host,
        regexp_extract(regexp_replace({ref}, '#.*$', ''), '^(?:[A-Za-z]+://[^/?#]*)?([^?]*)', 1) AS r_path,
        regexp_extract(regexp_replace({ref}, '#.*$', ''), '(\\?.*)$', 1) AS r_query
        FROM {alias}"""


_NORMAL = rf"""CASE WHEN trim(ref) = '' OR starts_with(trim(ref), '#')
    OR regexp_matches(trim(ref), '(?i)^(?:mailto|tel|sms|javascript|data|blob|about):')
    OR regexp_matches(n_path, '{ASSET_EXT}') THEN NULL ELSE
    r_scheme || '://' || r_host || CASE WHEN length(n_path) > 1 AND ends_with(n_path, '/')
        THEN left(n_path, length(n_path) - 1) ELSE n_path END || n_query END"""


def _sql_normalized(source: str) -> str:
    """``source`` has ``ref`` and ``base``; adds ``normal``. References are rooted or absolute."""
    return f"""SELECT *, {_NORMAL} AS normal FROM (SELECT *,
        {_sql_encode("CASE WHEN r_path = '' THEN '/' ELSE r_path END", _PATH_UNSAFE)} AS n_path,
        CASE WHEN regexp_matches(r_query, '(?i)[?&]utm_') THEN
            CASE WHEN len(kept) = 0 THEN '' ELSE '?' || array_to_string(kept, '&') END
            WHEN r_query = '?' THEN '' ELSE r_query END AS n_query
        FROM (SELECT *, list_filter(string_split(substr(r_query, 2), '&'),
            lambda x: NOT regexp_matches(x, '(?i)^utm_') AND x <> '') AS kept
        FROM ({_sql_resolved('trim(ref)', 'base', source)})))"""


expression(
    "own_urls",
    f"SELECT page_id, normal FROM ({_sql_normalized('(SELECT page_id, url AS ref, url AS base FROM pages)')})",
)


@query("normalize_page_url", "SELECT page_id, normal FROM own_urls")
def _(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", normalize_page_url(F.col("url"), F.col("url")).alias("normal")
    )


expression(
    "anchor_refs",
    r"""SELECT site, page_id, url AS base, unnest(refs) AS ref, generate_subscripts(refs, 1) AS pos
    FROM (SELECT site, page_id, url, regexp_extract_all(html, '(?i)<a\b[^>]*?\shref=["'']([^"'']*)["'']', 1) AS refs
    FROM site_pages)""",
)
expression(
    "link_rows",
    f"""SELECT site, page_id, normal AS link, min(pos) AS pos FROM ({_sql_normalized('anchor_refs')}) a
    WHERE normal IS NOT NULL AND r_host = site
    AND normal <> (SELECT o.normal FROM own_urls o WHERE o.page_id = a.page_id)
    GROUP BY site, page_id, normal""",
)


@query(
    "internal_links",
    "SELECT page_id, link, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS pos FROM link_rows",
)
def _(spark, sf):
    return seeds.site_pages(spark, sf).select(
        "page_id",
        F.posexplode(P.internal_links(F.col("html"), F.col("url"))).alias("pos", "link"),
    )


@query("distinct_urls", "SELECT DISTINCT site, link FROM link_rows")
def _(spark, sf):
    return (
        seeds.site_pages(spark, sf)
        .select("site", F.explode(P.internal_links(F.col("html"), F.col("url"))).alias("link"))
        .distinct()
    )


expression(
    "sitemap_refs",
    r"""SELECT site, 'https://' || site || '/' AS base, pos,
    replace(replace(replace(replace(replace(trim(loc), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&') AS ref
    FROM (SELECT site, unnest(locs) AS loc, generate_subscripts(locs, 1) AS pos
    FROM (SELECT site, regexp_extract_all(body, '(?i)<loc>([\s\S]*?)</loc>', 1) AS locs FROM site_file_bodies
    WHERE role = 'sitemap'))""",
)
expression(
    "sitemap_rows",
    f"""SELECT site, normal AS link, min(pos) AS pos FROM ({_sql_normalized('sitemap_refs')})
    WHERE normal IS NOT NULL AND r_host = site GROUP BY site, normal""",
)


@query(
    "sitemap_urls",
    "SELECT site, link, row_number() OVER (PARTITION BY site ORDER BY pos) - 1 AS pos FROM sitemap_rows",
)
def _(spark, sf):
    files = site_files(captured_responses(seeds.responses(spark, sf, ["sitemap"])))
    return files.select(
        "site", F.posexplode(P.sitemap_urls(F.col("sitemap_xml"), F.col("site"))).alias("pos", "link")
    )


expression(
    "asset_refs",
    r"""SELECT site, page_id, base, unnest(refs) AS ref, generate_subscripts(refs, 1) AS pos FROM (
    SELECT site, page_id, url AS base, list_concat(list_concat(
        regexp_extract_all(html, '(?i)<script\b[^>]*?\ssrc=["'']([^"'']*)["'']', 1),
        regexp_extract_all(html, '(?i)<img\b[^>]*?\ssrc=["'']([^"'']*)["'']', 1)),
        list_filter(list_transform(list_filter(regexp_extract_all(html, '(?i)<link\b[^>]*>'),
            lambda t: NOT regexp_matches(regexp_extract(t, '(?i)\brel=["'']([^"'']*)["'']', 1),
                '(?i)\b(?:canonical|alternate|preconnect|dns-prefetch)\b')),
            lambda t: regexp_extract(t, '(?i)\bhref=["'']([^"'']*)["'']', 1)), lambda h: h <> '')) AS refs
    FROM site_pages)""",
)
expression(
    "asset_rows",
    f"""SELECT site, page_id, base, r_scheme || '://' || r_host || r_path || r_query AS asset, min(pos) AS pos
    FROM ({_sql_resolved('trim(ref)', 'base', 'asset_refs')}) WHERE trim(ref) <> '' AND r_host = site
    GROUP BY ALL""",
)


@query(
    "page_assets",
    "SELECT page_id, asset, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS pos FROM asset_rows",
)
def _(spark, sf):
    return seeds.site_pages(spark, sf).select(
        "page_id", F.posexplode(P.page_assets(F.col("html"), F.col("url"))).alias("pos", "asset")
    )


expression(
    "script_refs",
    r"""SELECT page_id, url AS base, unnest(list_concat(list_concat(
        regexp_extract_all(html, '(?i)<script[^>]+src=["'']([^"'']+)["'']', 1),
        regexp_extract_all(html, '(?i)<link[^>]+href=["'']([^"'']+\.js)["'']', 1)),
        regexp_extract_all(html, '(?i)["''](/assets/[A-Za-z0-9._-]+\.js)["'']', 1))) AS ref FROM site_pages""",
)


@query(
    "script_urls",
    f"""SELECT DISTINCT page_id, r_scheme || '://' || r_host || r_path || r_query AS script
    FROM ({_sql_resolved('ref', 'base', 'script_refs')})""",
)
def _(spark, sf):
    return seeds.site_pages(spark, sf).select(
        "page_id", F.explode(P.script_urls(F.col("html"), F.col("url"))).alias("script")
    )


expression(
    "chunk_refs",
    r"""SELECT site, url AS bundle, unnest(regexp_extract_all(body, '["''`]([./][A-Za-z0-9/._-]*\.js)["''`]', 1)) AS ref
    FROM responses WHERE role = 'bundle'""",
)


@query(
    "bundle_chunks",
    """SELECT DISTINCT site, bundle, CASE WHEN starts_with(ref, './') THEN
        regexp_extract(bundle, '^(.*/)', 1) || substr(ref, 3)
        ELSE 'https://' || site || ref END AS chunk FROM chunk_refs""",
)
def _(spark, sf):
    return seeds.responses(spark, sf, ["bundle"]).select(
        "site",
        F.col("url").alias("bundle"),
        F.explode(P.bundle_chunks(F.col("body"), F.col("url"))).alias("chunk"),
    )


_FLAT = "lower(trim(regexp_replace({h}, '\\s+', ' ', 'g')))"


@query(
    "same_page",
    f"""SELECT page_id, CASE WHEN length(a) = 0 OR length(b) = 0 THEN a = b
    ELSE abs(length(a) - length(b)) <= 0.1 * greatest(length(a), length(b)) AND left(a, 400) = left(b, 400) END AS same
    FROM (SELECT p.page_id, {_FLAT.format(h='p.html')} AS a, {_FLAT.format(h='h.html')} AS b
    FROM site_pages p JOIN homes USING (site) JOIN site_pages h ON h.page_id = homes.page_id)""",
)
def _(spark, sf):
    """Pages shrink to their length and opening where they are read; the home's are joined to them."""
    pages = seeds.site_pages(spark, sf).select("site", "page_id", page_outline(F.col("html")).alias("own"))
    homes = S.of_home(pages, home=F.col("own"))
    return pages.join(homes, "site").select("page_id", same_outline(F.col("own"), F.col("home")).alias("same"))


expression("homes", "SELECT site, min(page_id) AS page_id FROM site_pages GROUP BY site")


@query(
    "format_bytes",
    """SELECT page_id, CASE WHEN n >= 1048576 THEN printf('%.1f MB', n / 1048576.0)
    WHEN n >= 1024 THEN CAST(floor(n / 1024.0 + 0.5) AS BIGINT) || ' KB' ELSE n || ' B' END AS shown
    FROM (SELECT page_id, strlen(html) * (page_id % 3) * (page_id % 3) * 40 + page_id AS n FROM pages)""",
)
def _(spark, sf):
    m = F.col("page_id") % 3
    n = F.octet_length("html") * m * m * 40 + F.col("page_id")
    return table(spark, sf, "pages").select("page_id", format_bytes(n).alias("shown"))


# ---- site files -----------------------------------------------------------------------------

_HTML_START = r"(?i)^\s*(?:<!doctype\s+html|<html[\s>]|<head[\s>]|<body[\s>])"
expression(
    "site_file_bodies",
    f"""SELECT site, role, body FROM responses WHERE role IN ('robots', 'llms', 'sitemap') AND status = 200
    AND NOT coalesce(regexp_matches(body, '{_HTML_START}'), false)""",
)
expression(
    "site_file_rows",
    rf"""SELECT site, bool_or(role = 'robots' AND ok) AS has_robots, bool_or(role = 'llms' AND ok) AS has_llms,
    bool_or(role = 'sitemap' AND ok) AS has_sitemap,
    bool_or(role = 'favicon' AND ok AND NOT regexp_matches(coalesce(json_extract_string(headers, '$."Content-Type"'), ''), '(?i)text/html')) AS favicon_ok,
    max(CASE WHEN role = 'notfound' THEN status END) AS notfound_status
    FROM (SELECT *, status = 200 AND NOT coalesce(regexp_matches(body, '{_HTML_START}'), false) AS ok
    FROM responses WHERE role IN ('home', 'robots', 'llms', 'sitemap', 'favicon', 'notfound')) GROUP BY site""",
)


@query("site_files", "SELECT * FROM site_file_rows")
def _(spark, sf):
    roles = ["home", "robots", "llms", "sitemap", "favicon", "notfound"]
    files = site_files(captured_responses(seeds.responses(spark, sf, roles)))
    return files.select(
        "site",
        F.col("robots_txt").isNotNull().alias("has_robots"),
        F.col("llms_txt").isNotNull().alias("has_llms"),
        F.col("sitemap_xml").isNotNull().alias("has_sitemap"),
        "favicon_ok",
        "notfound_status",
    )


expression(
    "candidate_rows",
    """SELECT s.site, s.link, s.pos FROM sitemap_rows s UNION ALL
    SELECT l.site, l.link, l.pos FROM link_rows l JOIN homes USING (site, page_id)
    WHERE l.site NOT IN (SELECT site FROM sitemap_rows)""",
)


@query(
    "crawl_frontier",
    """SELECT site, link, row_number() OVER (PARTITION BY site ORDER BY pos) AS rank
    FROM candidate_rows c JOIN (SELECT site, normal FROM homes JOIN own_urls USING (page_id)) USING (site)
    WHERE link <> normal""",
)
def _(spark, sf):
    files = site_files(captured_responses(seeds.responses(spark, sf, ["sitemap"])))
    return S.crawl_frontier(seeds.site_pages(spark, sf), files).select("site", "link", "rank")


# ---- site checks ----------------------------------------------------------------------------

expression(
    "config_rows",
    """SELECT site, CASE WHEN json_valid(json) THEN json END AS json,
    CASE WHEN json_valid(json) THEN json_type(json) END AS kind,
    CASE WHEN json_valid(json) AND json_type(json) = 'OBJECT' AND json_extract_string(json, '$.intent.aiCrawlers') IN ('open', 'blocked')
        THEN json_extract_string(json, '$.intent.aiCrawlers') END AS ai_crawlers,
    CASE WHEN json_valid(json) AND json_type(json) = 'OBJECT' AND json_extract_string(json, '$.intent.siteType') IN ('website', 'app', 'internal')
        THEN json_extract_string(json, '$.intent.siteType') END AS site_type FROM site_configs""",
)
_CHECK_LIST = ", ".join(f"'{ch}'" for ch in rules.CHECK_IDS)
expression(
    "suppress_rows",
    f"""SELECT site, id, last(reason ORDER BY pos) AS reason FROM (
    SELECT site, pos, json_extract_string(e, '$.id') AS id, trim(json_extract_string(e, '$.reason')) AS reason
    FROM (SELECT site, unnest(items) AS e, generate_subscripts(items, 1) AS pos FROM (
        SELECT site, json_extract(json, '$.suppress[*]') AS items FROM config_rows
        WHERE kind = 'OBJECT' AND json_type(json, '$.suppress') = 'ARRAY')))
    WHERE id IN ({_CHECK_LIST}) AND reason <> '' GROUP BY site, id""",
)
_TYPE_ROWS = ", ".join(
    f"('{t}', '{ch}', '{rules.SITE_TYPE_REASON[t]}')"
    for t, checks in rules.NOT_APPLICABLE_BY_SITE_TYPE.items()
    for ch in checks
)
expression("type_checks", f"SELECT * FROM (VALUES {_TYPE_ROWS}) AS v(site_type, id, reason)")
expression(
    "declared",
    "SELECT sites.site, ai_crawlers, site_type FROM sites LEFT JOIN config_rows USING (site)",
)
expression(
    "na_rows",
    f"""SELECT site, id, max_by(reason, prec) AS reason FROM (
    SELECT site, id, reason, 1 AS prec FROM declared JOIN type_checks USING (site_type)
    UNION ALL SELECT site, unnest(['web_robots_blocks_ai', 'web_missing_llms_txt']), '{rules.REASON_BLOCKED}', 2
        FROM declared WHERE ai_crawlers = 'blocked'
    UNION ALL SELECT site, 'web_ai_block_incomplete', '{rules.REASON_OPEN}', 2
        FROM declared WHERE ai_crawlers IS DISTINCT FROM 'blocked') GROUP BY site, id""",
)


def _declared(spark, sf):
    parsed = C.parse_configs(seeds.site_configs(spark, sf))
    return seeds.sites(spark, sf).select("site").join(parsed, "site", "left")


@query("scan_site_config", "SELECT site, kind = 'OBJECT' AS usable, ai_crawlers, site_type, (SELECT count(*) FROM suppress_rows s WHERE s.site = c.site) AS suppressions FROM (SELECT site, coalesce(kind, '') AS kind, ai_crawlers, site_type FROM config_rows) c")
def _(spark, sf):
    parsed = C.parse_configs(seeds.site_configs(spark, sf))
    fatal = F.exists("warnings", lambda w: w["kind"].isin("not_json", "not_an_object"))
    return parsed.select(
        "site",
        (~fatal).alias("usable"),
        "ai_crawlers",
        "site_type",
        F.size(C.suppress_map(F.col("suppress"))).cast("long").alias("suppressions"),
    )


expression(
    "config_warning_rows",
    f"""SELECT site, 'not_json' AS kind, '' AS detail FROM config_rows WHERE kind IS NULL
    UNION ALL SELECT site, 'not_an_object', '' FROM config_rows WHERE kind <> 'OBJECT'
    UNION ALL SELECT site, 'schema_version', json_extract_string(json, '$.schemaVersion') FROM config_rows
        WHERE kind = 'OBJECT' AND json_extract_string(json, '$.schemaVersion') <> '1'
    UNION ALL SELECT site, 'intent_not_object', '' FROM config_rows
        WHERE kind = 'OBJECT' AND json_type(json, '$.intent') <> 'OBJECT'
    UNION ALL SELECT site, 'ai_crawlers', json_extract_string(json, '$.intent.aiCrawlers') FROM config_rows
        WHERE kind = 'OBJECT' AND json_extract_string(json, '$.intent.aiCrawlers') IS NOT NULL AND ai_crawlers IS NULL
    UNION ALL SELECT site, 'site_type', json_extract_string(json, '$.intent.siteType') FROM config_rows
        WHERE kind = 'OBJECT' AND json_extract_string(json, '$.intent.siteType') IS NOT NULL AND site_type IS NULL
    UNION ALL SELECT site, 'suppress_not_array', '' FROM config_rows
        WHERE kind = 'OBJECT' AND json_type(json, '$.suppress') <> 'ARRAY'
    UNION ALL SELECT site, 'unknown_key', k FROM (SELECT site, unnest(json_keys(json)) AS k FROM config_rows WHERE kind = 'OBJECT')
        WHERE k NOT IN ('schemaVersion', 'intent', 'suppress')
    UNION ALL SELECT site, CASE WHEN id IS NULL THEN 'suppress_without_id' WHEN reason = '' THEN 'suppress_without_reason'
        ELSE 'not_suppressible' END, CASE WHEN id IS NULL THEN '' ELSE id END FROM (
        SELECT site, json_extract_string(e, '$.id') AS id, coalesce(trim(json_extract_string(e, '$.reason')), '') AS reason
        FROM (SELECT site, unnest(json_extract(json, '$.suppress[*]')) AS e FROM config_rows
            WHERE kind = 'OBJECT' AND json_type(json, '$.suppress') = 'ARRAY'))
        WHERE id IS NULL OR reason = '' OR id NOT IN ({_CHECK_LIST})""",
)


@query("config_warnings", "SELECT * FROM config_warning_rows")
def _(spark, sf):
    return C.parse_configs(seeds.site_configs(spark, sf)).select("site", F.inline("warnings"))


@query("not_applicable_checks", "SELECT * FROM na_rows")
def _(spark, sf):
    return _declared(spark, sf).select(
        "site",
        F.explode(C.not_applicable(F.col("site_type"), F.col("ai_crawlers"))).alias("id", "reason"),
    )
