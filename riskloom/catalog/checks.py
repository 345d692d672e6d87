"""Website check queries: robots policies, the 19 checks, and the report tables over them."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.catalog import seeds
from riskloom.catalog.registry import expression, query
from riskloom.catalog.web import _CHECK_LIST, _declared, _sql_framework
from riskloom.operators import captures as K
from riskloom.operators import config as C
from riskloom.operators import robots as R
from riskloom.operators import sites as S
from riskloom.operators.pages import page_signals
from riskloom.rules import web as rules
from riskloom.sources.captures import captured_responses

_BOTS = "[" + ", ".join(f"'{b}'" for b in rules.AI_BOTS) + "]"


def _responses(spark, sf, roles=None):
    return captured_responses(seeds.responses(spark, sf, roles))


# ---- robots ---------------------------------------------------------------------------------

expression(
    "robots_line_rows",
    r"""SELECT site, unnest(lines) AS raw, generate_subscripts(lines, 1) - 1 AS pos FROM (
    SELECT site, regexp_split_to_array(body, '\r?\n') AS lines FROM site_file_bodies
    WHERE role = 'robots' AND NOT regexp_matches(body, '(?i)^\s*(<!doctype|<html)'))""",
)
expression(
    "directive_rows",
    r"""SELECT site, pos, lower(regexp_extract(line, '^([A-Za-z-]+)\s*:', 1)) AS field,
    trim(regexp_extract(line, '^[A-Za-z-]+\s*:\s*(.*)$', 1)) AS value
    FROM (SELECT site, pos, trim(split_part(raw, '#', 1)) AS line FROM robots_line_rows)
    WHERE regexp_matches(line, '^[A-Za-z-]+\s*:')""",
)
expression(
    "robots_group_rows",
    """SELECT * FROM (SELECT site, pos, field, value, sum(starts) OVER (PARTITION BY site ORDER BY pos)::INT AS group_id
    FROM (SELECT *, CASE WHEN field = 'user-agent' AND coalesce(lag(field) OVER (PARTITION BY site ORDER BY pos), '') <> 'user-agent'
        THEN 1 ELSE 0 END AS starts FROM directive_rows WHERE field NOT IN ('sitemap', 'host'))) WHERE group_id > 0""",
)
expression(
    "agent_block_rows",
    r"""SELECT a.site, a.agent, bool_or(r.field = 'disallow' AND regexp_matches(r.value, '^/\**$'))
        AND NOT bool_or(r.field = 'allow' AND starts_with(r.value, '/')) AS blocks
    FROM (SELECT DISTINCT site, group_id, lower(value) AS agent FROM robots_group_rows WHERE field = 'user-agent') a
    JOIN robots_group_rows r USING (site, group_id) GROUP BY ALL""",
)
expression(
    "bot_rows",
    f"""SELECT s.site, b.bot, b.ord, n.blocks AS own, coalesce(w.blocks, false) AS wild
    FROM (SELECT DISTINCT site FROM robots_group_rows) s
    CROSS JOIN (SELECT unnest({_BOTS}) AS bot, generate_subscripts({_BOTS}, 1) AS ord) b
    LEFT JOIN agent_block_rows n ON n.site = s.site AND n.agent = lower(b.bot)
    LEFT JOIN agent_block_rows w ON w.site = s.site AND w.agent = '*'""",
)
expression(
    "robots_verdict_rows",
    """SELECT *, CASE WHEN via_wildcard THEN list_append(named, '*') ELSE named END AS blocking FROM (
    SELECT site, coalesce(list(bot ORDER BY ord) FILTER (WHERE coalesce(own, wild)), []) AS bots,
    coalesce(list(bot ORDER BY ord) FILTER (WHERE own), []) AS named,
    bool_or(own IS NULL AND wild) AS via_wildcard FROM bot_rows GROUP BY site)""",
)
expression(
    "managed_line_rows",
    r"""SELECT site, pos, raw, marker IS NULL AND coalesce(last_value(marker IGNORE NULLS) OVER (
        PARTITION BY site ORDER BY pos ROWS UNBOUNDED PRECEDING), '') = 'begin' AS inside
    FROM (SELECT *, CASE WHEN regexp_matches(trim(raw), '(?i)^#\s*BEGIN\s+Cloudflare\s+Managed\s+content') THEN 'begin'
        WHEN regexp_matches(trim(raw), '(?i)^#\s*END\s+Cloudflare\s+Managed\s+content') THEN 'end' END AS marker
    FROM robots_line_rows)""",
)
expression(
    "managed_agent_rows",
    r"""SELECT DISTINCT site, lower(trim(regexp_extract(trim(raw), '(?i)^user-agent\s*:\s*(.+)$', 1))) AS agent
    FROM managed_line_rows WHERE inside AND regexp_matches(trim(raw), '(?i)^user-agent\s*:\s*(.+)$')""",
)
expression(
    "managed_rows",
    """SELECT site, CASE WHEN inside_count = 0 THEN 'none' WHEN inside_count = len(blocking) THEN 'all' ELSE 'some' END AS covers
    FROM (SELECT v.site, v.blocking, (SELECT count(*) FROM managed_agent_rows m WHERE m.site = v.site
        AND list_contains(list_transform(v.blocking, lambda b: lower(b)), m.agent)) AS inside_count FROM robots_verdict_rows v)""",
)


def _robots_files(spark, sf):
    return K.site_files(_responses(spark, sf, ["robots"]))


@query("robots_groups", "SELECT site, group_id, pos, field, value FROM robots_group_rows")
def _(spark, sf):
    return R.robots_groups(R.robots_lines(_robots_files(spark, sf)))


@query("robots_group_blocks", "SELECT site, agent, blocks FROM agent_block_rows")
def _(spark, sf):
    return R.agent_blocks(R.robots_groups(R.robots_lines(_robots_files(spark, sf))))


@query("managed_block_lines", "SELECT site, pos, raw, inside FROM managed_line_rows")
def _(spark, sf):
    return R.managed_lines(R.robots_lines(_robots_files(spark, sf)))


@query("robots_blocked_bots", "SELECT site, bot FROM bot_rows WHERE coalesce(own, wild)")
def _(spark, sf):
    return R.robots_verdicts(_robots_files(spark, sf)).select("site", F.explode("bots").alias("bot"))


@query("robots_blocking_agents", "SELECT site, unnest(blocking) AS agent, via_wildcard FROM robots_verdict_rows")
def _(spark, sf):
    return R.robots_verdicts(_robots_files(spark, sf)).select(
        "site", F.explode("blocking_agents").alias("agent"), "via_wildcard"
    )


@query("robots_managed", "SELECT site, covers FROM managed_rows")
def _(spark, sf):
    return R.robots_verdicts(_robots_files(spark, sf)).select("site", F.col("managed_covers").alias("covers"))


@query(
    "ai_block_incomplete",
    """SELECT d.site, b.bot FROM declared d
    CROSS JOIN (SELECT unnest(%s) AS bot) b WHERE d.ai_crawlers = 'blocked' AND NOT EXISTS (
    SELECT 1 FROM bot_rows x WHERE x.site = d.site AND x.bot = b.bot AND coalesce(x.own, x.wild))""" % _BOTS,
)
def _(spark, sf):
    blocked = _declared(spark, sf).filter(F.col("ai_crawlers") == "blocked").select("site")
    verdicts = R.robots_verdicts(_robots_files(spark, sf)).select("site", "bots")
    shut = F.coalesce("bots", F.array().cast("array<string>"))
    return blocked.join(verdicts, "site", "left").select("site", F.explode(R.open_bots(shut)).alias("bot"))


# ---- assets, console, bundles ---------------------------------------------------------------

expression(
    "home_asset_rows",
    """SELECT site, asset, status, pos FROM (SELECT a.site, a.asset, row_number() OVER (PARTITION BY a.site ORDER BY a.pos) AS pos
    FROM asset_rows a JOIN homes USING (site, page_id)) JOIN (SELECT site, url AS asset, status FROM responses
    WHERE role = 'asset') USING (site, asset)""",
)


@query("broken_assets", "SELECT site, asset, status FROM home_asset_rows WHERE status >= 400")
def _(spark, sf):
    return S.broken_assets(seeds.site_pages(spark, sf), _responses(spark, sf, ["asset"])).select(
        "site", "asset", "status"
    )


@query("assets_checked", "SELECT site, count(*) AS checked FROM home_asset_rows GROUP BY site")
def _(spark, sf):
    return S.asset_rollup(seeds.site_pages(spark, sf), _responses(spark, sf, ["asset"])).select(
        "site", F.col("assets_checked").alias("checked")
    )


_NOT_JS = "(?i)" + rules.NOT_A_JS_ERROR
expression(
    "console_rows",
    rf"""SELECT site, type, text, row_number() OVER (PARTITION BY site ORDER BY min(seq)) AS rank FROM (
    SELECT site, type, seq, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM console_messages
        WHERE type IN ('error', 'pageerror'))
    WHERE text <> '' AND NOT (type = 'error' AND regexp_matches(text, '{_NOT_JS}'))
    GROUP BY site, type, text""",
)


@query("console_errors", "SELECT site, type, text, rank FROM console_rows")
def _(spark, sf):
    return S.console_errors(seeds.console_messages(spark, sf)).select("site", "type", "text", "rank")


expression(
    "bundle_rank_rows",
    """SELECT site, url, body, row_number() OVER (PARTITION BY site ORDER BY hop, url) AS rank FROM responses
    WHERE role = 'bundle' AND status BETWEEN 200 AND 299""",
)
expression(
    "js_byte_rows",
    """SELECT site, sum(strlen(body))::BIGINT AS js_bytes, count(*) AS bundles FROM bundle_rank_rows GROUP BY site""",
)


@query("js_bytes", "SELECT * FROM js_byte_rows")
def _(spark, sf):
    return K.js_bytes(_responses(spark, sf, ["bundle"]))


@query(
    "caps",
    """SELECT site, 'bundles' AS what, count(*) AS n FROM bundle_rank_rows WHERE rank <= 1 GROUP BY site
    UNION ALL SELECT site, 'console', count(*) FROM console_rows WHERE rank <= 2 GROUP BY site""",
)
def _(spark, sf):
    """Run limits are a choice of the caller, by rank; here 1 bundle and 2 console errors a site."""
    bundles = K.ranked_bundles(_responses(spark, sf, ["bundle"]), []).filter("rank <= 1")
    console = S.console_errors(seeds.console_messages(spark, sf)).filter("rank <= 2")
    parts = [df.select("site", F.lit(what).alias("what")) for df, what in ((bundles, "bundles"), (console, "console"))]
    return parts[0].unionByName(parts[1]).groupBy("site", "what").agg(F.count("*").alias("n"))


# ---- the checks -----------------------------------------------------------------------------

expression(
    "rollup_rows",
    """SELECT site, count(*) AS total, arg_min(url, page_id) AS home_url,
    arg_min({'t': title}, page_id).t AS home_title, arg_min(body_text_length, page_id) AS home_text,
    count_if(body_text_length < 200) AS n_empty, count_if(title IS NULL) AS n_title,
    count_if(meta_description IS NULL) AS n_desc, count_if(og_title IS NULL OR og_image IS NULL) AS n_og,
    count_if(canonical IS NULL) AS n_canonical, count_if(json_ld_blocks = 0) AS n_ld,
    count_if(h1_count = 0) AS n_no_h1, count_if(h1_count > 1) AS n_many_h1, max(h1_count) AS max_h1,
    count_if(lang IS NULL) AS n_lang, count(title) AS n_titles, min(title) AS min_title, max(title) AS max_title,
    sum(img_total)::BIGINT AS images, sum(img_without_alt)::BIGINT AS no_alt, count_if(img_without_alt > 0) AS n_alt,
    bool_or(favicon_link) AS icon_link, max(inline_script_bytes) AS inline_max
    FROM page_signal_rows GROUP BY site""",
)
expression(
    "fact_rows",
    """SELECT r.*, regexp_extract(home_url, '^[a-z]+://[^/?#]*') AS origin, d.ai_crawlers, d.site_type
    FROM rollup_rows r JOIN declared d USING (site)""",
)


def _of(n: str) -> str:
    return f"{n} || ' of ' || total || CASE WHEN total = 1 THEN ' page' ELSE ' pages' END"


def _finding(check: str, frm: str, where: str, evidence: str, source: str = "NULL", count: str = "NULL") -> str:
    return (
        f"SELECT f.site, '{check}' AS id, '{rules.SEVERITY[check]}' AS severity, {source} AS source, "
        f"{evidence} AS evidence, ({count})::BIGINT AS count FROM {frm} WHERE ({where}) "
        f"AND NOT EXISTS (SELECT 1 FROM na_rows n WHERE n.site = f.site AND n.id = '{check}')"
    )


def _count_check(check: str, n: str, what: str) -> str:
    return _finding(check, "fact_rows f", f"{n} > 0", f"{_of(n)} || '{what}'", count=n)


_FILES = "fact_rows f LEFT JOIN site_file_rows s USING (site)"
_HOME_ICON = "(SELECT site, regexp_matches(html, '(?i)<link[^>]*icon[^>]*href=\"data:') AS inlined FROM site_pages JOIN homes USING (site, page_id))"
_OPEN = "coalesce(list_filter(" + _BOTS + ", lambda b: NOT list_contains(coalesce(v.bots, []), b)), [])"
CHECK_SQL = {
    "web_robots_blocks_ai": _finding(
        "web_robots_blocks_ai",
        "fact_rows f JOIN robots_verdict_rows v USING (site) JOIN managed_rows m USING (site)",
        "len(bots) > 0",
        "'Disallow: / under ' || array_to_string(blocking, ', ') || ' shuts out ' || array_to_string(bots, ', ') || "
        "CASE WHEN covers = 'none' THEN '' ELSE '; ' || covers || ' inside a Cloudflare block' END",
        "origin || '/robots.txt'",
        "len(bots)",
    ),
    "web_ai_block_incomplete": _finding(
        "web_ai_block_incomplete",
        "fact_rows f LEFT JOIN robots_verdict_rows v USING (site)",
        f"ai_crawlers = 'blocked' AND len({_OPEN}) > 0",
        f"'still allowed: ' || array_to_string({_OPEN}, ', ')",
        "origin || '/robots.txt'",
        f"len({_OPEN})",
    ),
    "web_empty_html": _finding(
        "web_empty_html",
        "fact_rows f",
        "home_text < 200",
        f"'home has ' || home_text || ' visible characters; ' || {_of('n_empty')} || ' below 200'",
        "home_url",
        "n_empty",
    ),
    "web_broken_assets": _finding(
        "web_broken_assets",
        "fact_rows f JOIN (SELECT site, count(*) AS n, array_to_string(list(asset || ' ' || status ORDER BY pos)[1:10], ' | ') AS listed "
        "FROM home_asset_rows WHERE status >= 400 GROUP BY site) b USING (site)",
        "n > 0",
        "n || ' broken: ' || listed",
        count="n",
    ),
    "web_console_errors": _finding(
        "web_console_errors",
        "fact_rows f JOIN (SELECT site, count(*) AS n, array_to_string(list('[' || type || '] ' || text ORDER BY rank)[1:5], ' | ') AS listed "
        "FROM console_rows GROUP BY site) c USING (site)",
        "n > 0",
        "n || ' errors: ' || listed",
        "home_url",
        "n",
    ),
    "web_duplicate_titles": _finding(
        "web_duplicate_titles",
        "fact_rows f",
        "total >= 2 AND home_title IS NOT NULL AND n_titles = total AND min_title = max_title",
        "'all ' || total || ' pages share the title: ' || home_title",
        count="total",
    ),
    "web_missing_title": _finding(
        "web_missing_title",
        "fact_rows f",
        "home_title IS NULL",
        f"{_of('n_title')} || ' without a title, the home page among them'",
        "home_url",
        "n_title",
    ),
    "web_missing_meta_description": _count_check("web_missing_meta_description", "n_desc", " without a meta description"),
    "web_missing_og": _count_check("web_missing_og", "n_og", " without og:title or og:image"),
    "web_missing_canonical": _count_check("web_missing_canonical", "n_canonical", " without a canonical link"),
    "web_missing_structured_data": _count_check("web_missing_structured_data", "n_ld", " without JSON-LD"),
    "web_h1_structure": _finding(
        "web_h1_structure",
        "fact_rows f",
        "n_no_h1 > 0 OR n_many_h1 > 0",
        f"concat_ws('; ', CASE WHEN n_no_h1 > 0 THEN {_of('n_no_h1')} || ' without an h1' END, "
        f"CASE WHEN n_many_h1 > 0 THEN {_of('n_many_h1')} || ' with several, up to ' || max_h1 END)",
        count="n_no_h1 + n_many_h1",
    ),
    "web_missing_sitemap": _finding(
        "web_missing_sitemap", _FILES, "NOT coalesce(has_sitemap, false)", "'no sitemap.xml answered'", "origin || '/sitemap.xml'"
    ),
    "web_missing_llms_txt": _finding(
        "web_missing_llms_txt", _FILES, "NOT coalesce(has_llms, false)", "'no llms.txt answered'", "origin || '/llms.txt'"
    ),
    "web_missing_lang": _count_check("web_missing_lang", "n_lang", " without a lang attribute"),
    "web_missing_alt": _finding(
        "web_missing_alt",
        "fact_rows f",
        "no_alt > 0",
        f"no_alt || ' of ' || images || ' images without alt, on ' || {_of('n_alt')}",
        count="no_alt",
    ),
    "web_missing_404": _finding(
        "web_missing_404",
        _FILES,
        "notfound_status > 0 AND notfound_status < 400",
        "'an unknown URL answered ' || notfound_status",
        "origin || '/'",
    ),
    "web_missing_favicon": _finding(
        "web_missing_favicon",
        f"fact_rows f LEFT JOIN site_file_rows s USING (site) JOIN {_HOME_ICON} h USING (site)",
        "NOT coalesce(favicon_ok, false) AND NOT inlined AND NOT icon_link",
        "'no icon served or linked'",
        "origin || '/favicon.ico'",
    ),
    "web_heavy_bundle": _finding(
        "web_heavy_bundle",
        "fact_rows f LEFT JOIN js_byte_rows j USING (site)",
        "coalesce(js_bytes, 0) + inline_max > 1048576",
        "printf('%.1f MB', (coalesce(js_bytes, 0) + inline_max) / 1048576.0) || ' of uncompressed scripts'",
        count="coalesce(js_bytes, 0) + inline_max",
    ),
}
expression("web_finding_rows", " UNION ALL ".join(CHECK_SQL[ch] for ch in rules.CHECK_IDS))


def _facts(spark, sf, checks=None, responses=None):
    pages = seeds.site_pages(spark, sf)
    return S.site_facts(
        pages,
        _responses(spark, sf) if responses is None else responses,
        seeds.site_configs(spark, sf),
        seeds.console_messages(spark, sf),
        checks,
    )


def _register(check: str) -> None:
    @query(check, CHECK_SQL[check])
    def _(spark, sf):
        return S.web_findings(_facts(spark, sf, [check]), [check])


for _check in rules.CHECK_IDS:
    _register(_check)


@query("checks_not_evaluated", """SELECT site, id FROM (
    SELECT site, 'web_duplicate_titles' AS id FROM rollup_rows WHERE total < 2
    UNION ALL SELECT site, 'web_missing_alt' FROM rollup_rows WHERE images = 0
    UNION ALL SELECT site, 'web_broken_assets' FROM rollup_rows WHERE site NOT IN (SELECT site FROM home_asset_rows))""")
def _(spark, sf):
    facts = _facts(spark, sf, ["web_broken_assets"])
    ne = S.not_evaluated(F.col("total"), F.col("images"), F.col("assets_checked"))
    return facts.select("site", F.explode(ne).alias("id", "reason")).select("site", "id")


expression(
    "ne_rows",
    """SELECT site, 'web_duplicate_titles' AS id FROM rollup_rows WHERE total < 2
    UNION ALL SELECT site, 'web_missing_alt' FROM rollup_rows WHERE images = 0
    UNION ALL SELECT site, 'web_broken_assets' FROM rollup_rows WHERE site NOT IN (SELECT site FROM home_asset_rows)
    UNION ALL SELECT site, 'web_console_errors' FROM rollup_rows WHERE site NOT IN (SELECT site FROM console_messages)""",
)
expression(
    "matrix_rows",
    f"""SELECT r.site, c.id, CASE WHEN ne.id IS NOT NULL THEN 'not evaluated' WHEN na.id IS NOT NULL THEN 'not applicable'
    WHEN w.id IS NOT NULL AND s.id IS NOT NULL THEN 'suppressed' WHEN w.id IS NOT NULL THEN 'fail' ELSE 'ok' END AS status
    FROM rollup_rows r CROSS JOIN (SELECT unnest([{_CHECK_LIST}]) AS id) c
    LEFT JOIN ne_rows ne ON ne.site = r.site AND ne.id = c.id LEFT JOIN na_rows na ON na.site = r.site AND na.id = c.id
    LEFT JOIN web_finding_rows w ON w.site = r.site AND w.id = c.id
    LEFT JOIN suppress_rows s ON s.site = r.site AND s.id = c.id""",
)


@query("web_check_matrix", "SELECT site, id, status FROM matrix_rows")
def _(spark, sf):
    return S.check_matrix(_facts(spark, sf))


@query(
    "checks_passed",
    "SELECT site, count_if(status = 'ok') AS passed, count_if(status IN ('ok', 'fail')) AS checkable FROM matrix_rows GROUP BY site",
)
def _(spark, sf):
    return S.checks_passed(S.check_matrix(_facts(spark, sf)))


def _suppressions(spark, sf):
    return C.parse_configs(seeds.site_configs(spark, sf)).select(
        "site", F.explode(C.suppress_map(F.col("suppress"))).alias("id", "reason")
    )


@query(
    "apply_suppressions",
    """SELECT w.site, w.id, s.reason AS suppressed_reason FROM web_finding_rows w LEFT JOIN suppress_rows s
    ON s.site = w.site AND s.id = w.id UNION ALL SELECT site, 'leaky_header_' || lower(h.key), NULL FROM leaky_rows h""",
)
def _(spark, sf):
    web = S.web_findings(_facts(spark, sf)).select("site", "id", F.lit("web").alias("kind"))
    security = K.leaky_headers(_responses(spark, sf, ["home"])).select(
        "site", "id", F.lit(None).cast("string").alias("kind")
    )
    return C.apply_suppressions(web.unionByName(security), _suppressions(spark, sf)).select(
        "site", "id", "suppressed_reason"
    )


@query(
    "drop_not_applicable",
    """SELECT site, id FROM (SELECT site, 'web_missing_og' AS id FROM rollup_rows WHERE n_og > 0
    UNION ALL SELECT site, 'web_missing_canonical' FROM rollup_rows WHERE n_canonical > 0
    UNION ALL SELECT site, 'web_missing_lang' FROM rollup_rows WHERE n_lang > 0)
    EXCEPT SELECT site, id FROM na_rows""",
)
def _(spark, sf):
    """The general form over any findings table, here three checks before they were filtered."""
    rollup = S.site_rollup(page_signals(seeds.site_pages(spark, sf)))
    checks = ["web_missing_og", "web_missing_canonical", "web_missing_lang"]
    fired = F.array(*[F.when(F.col("n_" + ch) > 0, F.lit(ch)) for ch in checks])
    raw = rollup.select("site", F.explode(F.array_compact(fired)).alias("id"))
    na = _declared(spark, sf).select(
        "site", F.explode(C.not_applicable(F.col("site_type"), F.col("ai_crawlers"))).alias("id", "reason")
    )
    return C.drop_not_applicable(raw, na)


@query(
    "evidence_top_k",
    """SELECT site, id, page_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY site, id ORDER BY page_id) AS rank FROM (
    SELECT site, page_id, unnest(list_filter([
        CASE WHEN body_text_length < 200 THEN 'web_empty_html' END, CASE WHEN title IS NULL THEN 'web_missing_title' END,
        CASE WHEN meta_description IS NULL THEN 'web_missing_meta_description' END,
        CASE WHEN og_title IS NULL OR og_image IS NULL THEN 'web_missing_og' END,
        CASE WHEN canonical IS NULL THEN 'web_missing_canonical' END,
        CASE WHEN json_ld_blocks = 0 THEN 'web_missing_structured_data' END,
        CASE WHEN h1_count <> 1 THEN 'web_h1_structure' END, CASE WHEN lang IS NULL THEN 'web_missing_lang' END,
        CASE WHEN img_without_alt > 0 THEN 'web_missing_alt' END], lambda x: x IS NOT NULL)) AS id
    FROM page_signal_rows)) WHERE rank <= 8""",
)
def _(spark, sf):
    return S.first_pages(page_signals(seeds.site_pages(spark, sf))).select("site", "id", "page_id", "rank")


expression(
    "fingerprint_rows",
    f"""SELECT s.site, platform_domain, framework, client_rendered, score FROM (
    SELECT p.site, CASE {" ".join(f"WHEN p.site = '{d}' OR ends_with(p.site, '.{d}') THEN '{d}'" for d in rules.PLATFORM_DOMAINS)} END AS platform_domain,
    {_sql_framework("t.doc")} AS framework,
    p.body_text_length < 200 AND regexp_matches(t.doc, '(?i)<script[^>]*\\bsrc\\s*=') AS client_rendered,
    (p.title IS NULL)::INT + (p.meta_description IS NULL)::INT + (p.og_title IS NULL AND p.og_image IS NULL)::INT
    + (p.canonical IS NULL)::INT + (p.json_ld_blocks = 0)::INT + (p.lang IS NULL)::INT
    + (NOT p.favicon_link AND NOT coalesce(f.favicon_ok, false))::INT
    + (f.site IS NOT NULL AND NOT f.has_sitemap)::INT + (f.site IS NOT NULL AND NOT f.has_llms)::INT
    + (coalesce(j.js_bytes, 0) > 1048576)::INT AS base
    FROM page_signal_rows p JOIN homes h USING (site, page_id) JOIN page_windows t USING (site, page_id)
    LEFT JOIN site_file_rows f USING (site) LEFT JOIN js_byte_rows j USING (site)) s,
    LATERAL (SELECT base + (platform_domain IS NOT NULL)::INT + client_rendered::INT AS score)""",
)


@query("stack_fingerprint", "SELECT site, platform_domain, framework, client_rendered, score FROM fingerprint_rows")
def _(spark, sf):
    roles = ["home", "robots", "llms", "sitemap", "favicon", "notfound", "bundle"]
    return S.stack_fingerprint(seeds.site_pages(spark, sf), _responses(spark, sf, roles)).select(
        "site", "platform_domain", "framework", "client_rendered", "score"
    )
