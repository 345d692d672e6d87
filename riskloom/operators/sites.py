"""Site-level website checks from page signals and captures.

Pages are reduced to one narrow row per site by a single aggregation that combines on the map
side, so a site holding a third of all pages costs its mappers, not one reducer. Everything
after it works on that one row per site. Lists of pages are never gathered: the affected pages
are a table of their own (``affected_pages``), and a report takes the first few with a rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.expr import each
from riskloom.functions.html import attr, strip_comments, tags
from riskloom.functions.text import collapse_spaces, format_bytes
from riskloom.functions.regex import matches
from riskloom.functions.urls import host_of, normalize_page_url, origin_of
from riskloom.operators.captures import js_bytes as bundle_bytes
from riskloom.operators.captures import site_files
from riskloom.operators.config import not_applicable, parse_configs, suppress_map
from riskloom.operators.pages import (
    detect_framework,
    favicon_href,
    fingerprint_columns,
    internal_links,
    page_assets,
    page_signals,
    platform_domain,
    sitemap_urls,
)
from riskloom.operators.robots import open_bots, robots_verdicts
from riskloom.rules import web as rules
from riskloom.sources.scratch import written

#: Parts of a site whose first console errors are found on their own before those of the site.
CONSOLE_PARTS = 64


def page_conditions() -> dict[str, Column]:
    """What puts a page on the list of affected pages, per check."""
    c = F.col
    return {
        "web_empty_html": c("body_text_length") < rules.EMPTY_TEXT_CHARS,
        "web_missing_title": c("title").isNull(),
        "web_missing_meta_description": c("meta_description").isNull(),
        "web_missing_og": c("og_title").isNull() | c("og_image").isNull(),
        "web_missing_canonical": c("canonical").isNull(),
        "web_missing_structured_data": c("json_ld_blocks") == 0,
        "web_h1_structure": c("h1_count") != 1,
        "web_missing_lang": c("lang").isNull(),
        "web_missing_alt": c("img_without_alt") > 0,
    }


def site_rollup(signals: DataFrame) -> DataFrame:
    """One row per site; home is the page with the lowest ``page_id``."""
    c = F.col
    counts = [F.count_if(cond).alias("n_" + check) for check, cond in page_conditions().items()]
    return signals.groupBy("site").agg(
        F.count("*").alias("total"),
        F.min_by(F.struct("url", "title", "body_text_length"), c("page_id")).alias("home"),
        *counts,
        F.count_if(c("h1_count") == 0).alias("n_no_h1"),
        F.count_if(c("h1_count") > 1).alias("n_many_h1"),
        F.max("h1_count").alias("max_h1"),
        F.count("title").alias("n_titles"),
        F.min("title").alias("min_title"),
        F.max("title").alias("max_title"),
        F.sum("img_total").alias("images"),
        F.sum("img_without_alt").alias("images_without_alt"),
        F.bool_or("favicon_link").alias("any_favicon_link"),
        F.max("inline_script_bytes").alias("inline_max"),
    )


def of_home(pages: DataFrame, **facts: Column) -> DataFrame:
    """Per site the facts of its home page, the one with the lowest ``page_id``.

    Facts are made where pages are read and picked by an aggregation that combines on the map side, so
    no document is shuffled.
    """
    narrow = pages.select("site", "page_id", *[c.alias(name) for name, c in facts.items()])
    picked = F.min_by(F.struct(*facts), F.col("page_id")).alias("_home")
    return narrow.groupBy("site").agg(picked).select("site", "_home.*")


def home_facts(pages: DataFrame) -> DataFrame:
    """Per site: assets of the home page, inlined icon."""
    html, url = F.col("html"), F.col("url")
    return of_home(
        pages,
        home_url=url,
        assets=page_assets(html, url),
        icon_inlined=F.coalesce(matches(favicon_href(html), "^data:"), F.lit(False)),
    )


def crawl_frontier(pages: DataFrame, files: DataFrame) -> DataFrame:
    """``(site, link, rank)``: what to fetch after the home page, all of it, the first first. Sitemap
    entries where there are any, links of the home page otherwise."""
    homes = of_home(
        pages, linked=internal_links(F.col("html"), F.col("url")), own=normalize_page_url(F.col("url"), F.col("url"))
    )
    listed = sitemap_urls(F.coalesce("sitemap_xml", F.lit("")), F.col("site"))
    candidates = F.filter(
        F.when(F.size("_listed") > 0, F.col("_listed")).otherwise(F.col("linked")),
        lambda u: F.col("own").isNull() | (u != F.col("own")),
    )
    return (
        homes.join(files.select("site", "sitemap_xml"), "site", "left")
        .withColumn("_listed", listed)
        .select("site", F.posexplode(candidates).alias("pos", "link"))
        .select("site", "link", (F.col("pos") + 1).alias("rank"))
    )


def asset_results(pages: DataFrame, responses: DataFrame) -> DataFrame:
    """``(site, pos, asset, status)`` for the home assets that were requested."""
    wanted = home_facts(pages).select("site", "home_url", F.posexplode("assets").alias("pos", "asset"))
    got = responses.filter(F.col("role") == "asset").select("site", F.col("url").alias("asset"), "status")
    return wanted.join(got, ["site", "asset"])


def broken_assets(pages: DataFrame, responses: DataFrame) -> DataFrame:
    """Answered with an error; status 0 is our side not getting through and proves nothing."""
    return asset_results(pages, responses).filter(F.col("status") >= 400)


def asset_rollup(pages: DataFrame, responses: DataFrame) -> DataFrame:
    """Counts of all home assets and the first ten broken ones."""
    results = asset_results(pages, responses)
    order = Window.partitionBy("site").orderBy("pos", "status")
    first = results.filter(F.col("status") >= 400).withColumn("rank", F.row_number().over(order))
    line = F.struct("rank", F.concat_ws(" ", "asset", F.col("status").cast("string")).alias("line"))
    listed = first.filter(F.col("rank") <= rules.LISTED_ASSETS).groupBy("site").agg(_joined(line).alias("assets_listed"))
    counts = results.groupBy("site").agg(
        F.count("*").alias("assets_checked"), F.count_if(F.col("status") >= 400).alias("assets_broken")
    )
    return counts.join(listed, "site", "left").withColumn("assets_listed", F.coalesce("assets_listed", F.lit("")))


def _joined(line: Column) -> Column:
    """The few ranked lines of a group in one text."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), " | ")


def _distinct_errors(messages: DataFrame) -> DataFrame:
    """``(site, type, text, seq)``: cleaned runtime errors, each once per site, with its first place.

    Repeats are merged map-side, so a site that logs one error a billion times sends one row per mapper.
    """
    return (
        messages.filter(F.col("type").isin("error", "pageerror"))
        .withColumn("text", F.trim(collapse_spaces(F.col("text"))))
        .filter(
            (F.col("text") != "")
            & ~((F.col("type") == "error") & matches(F.col("text"), rules.NOT_A_JS_ERROR))
        )
        .groupBy("site", "type", "text")
        .agg(F.min("seq").alias("seq"))
    )


def console_errors(messages: DataFrame) -> DataFrame:
    """Cleaned runtime errors, all distinct ones per site, ranked by first appearance.

    Errors are dealt by ranges of (site, place), which splits a site of very many. A rank is what lies in the
    site's earlier parts and before it in its own.
    """
    dealt = _distinct_errors(messages).repartitionByRange("site", "seq", "type", "text")
    parts = written(dealt.withColumn("_part", F.spark_partition_id()), "errors")
    earlier = Window.partitionBy("site").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parts.groupBy("site", "_part").agg(F.count("*").alias("_size"))
    offsets = sizes.select("site", "_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("site", "_part").orderBy("seq", "type", "text"))
    ranked = parts.withColumn("_inside", inside).join(offsets, ["site", "_part"])
    return ranked.select("site", "type", "text", "seq", (F.col("_offset") + F.col("_inside")).alias("rank"))


def console_rollup(messages: DataFrame) -> DataFrame:
    """Per site with a console capture: how many errors, and the first five.

    The first five come from the first five of parts, so no task ranks a whole site.
    """
    errors = _distinct_errors(messages)
    most = rules.LISTED_CONSOLE_ERRORS
    order = [F.col("seq"), F.col("type"), F.col("text")]
    part = F.pmod(F.xxhash64("type", "text"), F.lit(CONSOLE_PARTS))
    early = F.row_number().over(Window.partitionBy("site", "_part").orderBy(*order))
    first = errors.withColumn("_part", part).withColumn("_early", early).filter(F.col("_early") <= most)
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("site").orderBy(*order)))
    line = F.struct("rank", F.concat(F.lit("["), "type", F.lit("] "), "text").alias("line"))
    listed = first.filter(F.col("rank") <= most).groupBy("site")
    kept = errors.groupBy("site").agg(F.count("*").alias("console_count"))
    kept = kept.join(listed.agg(_joined(line).alias("console_listed")), "site", "left")
    captured = messages.select("site").distinct()
    return captured.join(kept, "site", "left").select(
        "site",
        F.lit(True).alias("console_checked"),
        F.coalesce("console_count", F.lit(0)).alias("console_count"),
        "console_listed",
    )


# The inputs each check needs beyond the page rollup. A job that asks for some checks reads and
# joins only what those need.
NEEDS = {
    "web_robots_blocks_ai": {"robots", "config"},
    "web_ai_block_incomplete": {"robots", "config"},
    "web_broken_assets": {"assets"},
    "web_console_errors": {"console"},
    "web_missing_sitemap": {"files", "config"},
    "web_missing_llms_txt": {"files", "config"},
    "web_missing_404": {"files"},
    "web_missing_favicon": {"files", "home"},
    "web_heavy_bundle": {"bundles"},
    "web_missing_structured_data": {"config"},
    "web_missing_canonical": {"config"},
    "web_missing_og": {"config"},
    "web_missing_meta_description": {"config"},
    "web_duplicate_titles": {"config"},
    "web_empty_html": {"config"},
}


def site_facts(
    pages: DataFrame,
    responses: DataFrame,
    configs: DataFrame,
    console: DataFrame,
    checks: list[str] | None = None,
    signals: DataFrame | None = None,
) -> DataFrame:
    """The wide row per site that all checks read. ``signals`` may be a persisted table."""
    wanted = rules.CHECK_IDS if checks is None else checks
    needs = set().union(*[NEEDS.get(ch, set()) for ch in wanted])
    out = site_rollup(page_signals(pages) if signals is None else signals)
    no_strings = F.array().cast("array<string>")
    fill: dict[str, Column] = {}
    if needs & {"files", "robots"}:
        files = site_files(responses)
        if "files" in needs:
            out = out.join(
                files.select(
                    "site",
                    F.col("llms_txt").isNotNull().alias("has_llms"),
                    F.col("sitemap_xml").isNotNull().alias("has_sitemap"),
                    "favicon_ok",
                    "notfound_status",
                    "notfound_distinct",
                ),
                "site",
                "left",
            )
            fill |= {"has_llms": F.lit(False), "has_sitemap": F.lit(False), "favicon_ok": F.lit(False),
                     "notfound_status": F.lit(0), "notfound_distinct": F.lit(True)}
        if "robots" in needs:
            out = out.join(robots_verdicts(files), "site", "left")
            fill |= {"bots": no_strings, "blocking_agents": no_strings, "managed_covers": F.lit("none")}
    if "assets" in needs:
        out = out.join(asset_rollup(pages, responses), "site", "left")
        fill |= {"assets_checked": F.lit(0), "assets_broken": F.lit(0)}
    if "home" in needs:
        out = out.join(home_facts(pages).select("site", "icon_inlined"), "site", "left")
        fill["icon_inlined"] = F.lit(False)
    if "console" in needs:
        out = out.join(console_rollup(console), "site", "left")
        fill |= {"console_checked": F.lit(False), "console_count": F.lit(0)}
    if "bundles" in needs:
        out = out.join(bundle_bytes(responses), "site", "left")
        fill["js_bytes"] = F.lit(0)
    if "config" in needs or checks is None:
        parsed = parse_configs(configs).select("site", "ai_crawlers", "site_type", "suppress")
        out = out.join(parsed, "site", "left")
    else:
        out = out.withColumns(
            {"ai_crawlers": F.lit(None).cast("string"), "site_type": F.lit(None).cast("string")}
        )
    return out.withColumns({name: F.coalesce(F.col(name), default) for name, default in fill.items()})


def _of(n: Column, total: Column) -> Column:
    return F.concat(
        n.cast("string"), F.lit(" of "), total.cast("string"), F.when(total == 1, " page").otherwise(" pages")
    )


def check_columns(checks: list[str]) -> dict[str, Column]:
    """``struct<id,severity,source,evidence,count>`` where the check fails, else null."""
    c = F.col
    total = c("total")
    origin = origin_of(c("home.url"))
    open_ = None
    out: dict[str, Column] = {}

    def add(check: str, cond, source, evidence, count) -> None:
        if check not in checks:
            return
        out[check] = F.when(
            cond(),
            F.struct(
                F.lit(check).alias("id"),
                F.lit(rules.SEVERITY[check]).alias("severity"),
                source().cast("string").alias("source"),
                evidence().alias("evidence"),
                count().cast("long").alias("count"),
            ),
        )

    def none():
        return F.lit(None)

    def home():
        return c("home.url")

    def at(path: str):
        return lambda: F.concat(origin, F.lit(path))

    def text(*parts):
        return lambda: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    def pages_with(check: str, what: str):
        n = c("n_" + check)
        add(check, lambda: n > 0, none, lambda: F.concat(_of(n, total), F.lit(what)), lambda: n)

    bots = F.size("bots")
    open_ = open_bots(c("bots"))
    add(
        "web_robots_blocks_ai",
        lambda: bots > 0,
        at("/robots.txt"),
        lambda: F.concat(
            F.lit("Disallow: / under "), F.array_join("blocking_agents", ", "), F.lit(" shuts out "),
            F.array_join("bots", ", "),
            F.when(c("managed_covers") == "none", "").otherwise(
                F.concat(F.lit("; "), c("managed_covers"), F.lit(f" inside a {rules.MANAGED_VENDOR} block"))
            ),
        ),
        lambda: bots,
    )
    add(
        "web_ai_block_incomplete",
        lambda: (c("ai_crawlers") == "blocked") & (F.size(open_) > 0),
        at("/robots.txt"),
        lambda: F.concat(F.lit("still allowed: "), F.array_join(open_, ", ")),
        lambda: F.size(open_),
    )
    n_empty = c("n_web_empty_html")
    add(
        "web_empty_html",
        lambda: c("home.body_text_length") < rules.EMPTY_TEXT_CHARS,
        home,
        lambda: F.concat(
            F.lit("home has "), c("home.body_text_length").cast("string"),
            F.lit(" visible characters; "), _of(n_empty, total), F.lit(" below 200"),
        ),
        lambda: n_empty,
    )
    add(
        "web_broken_assets",
        lambda: c("assets_broken") > 0,
        none,
        lambda: F.concat(c("assets_broken").cast("string"), F.lit(" broken: "), c("assets_listed")),
        lambda: c("assets_broken"),
    )
    add(
        "web_console_errors",
        lambda: c("console_count") > 0,
        home,
        lambda: F.concat(c("console_count").cast("string"), F.lit(" errors: "), c("console_listed")),
        lambda: c("console_count"),
    )
    add(
        "web_duplicate_titles",
        lambda: (total >= 2)
        & c("home.title").isNotNull()
        & (c("n_titles") == total)
        & (c("min_title") == c("max_title")),
        none,
        text("all ", total, " pages share the title: ", c("home.title")),
        lambda: total,
    )
    n_title = c("n_web_missing_title")
    add(
        "web_missing_title",
        lambda: c("home.title").isNull(),
        home,
        lambda: F.concat(_of(n_title, total), F.lit(" without a title, the home page among them")),
        lambda: n_title,
    )
    pages_with("web_missing_meta_description", " without a meta description")
    pages_with("web_missing_og", " without og:title or og:image")
    pages_with("web_missing_canonical", " without a canonical link")
    pages_with("web_missing_structured_data", " without JSON-LD")
    add(
        "web_h1_structure",
        lambda: (c("n_no_h1") > 0) | (c("n_many_h1") > 0),
        none,
        lambda: F.concat_ws(
            "; ",
            F.when(c("n_no_h1") > 0, F.concat(_of(c("n_no_h1"), total), F.lit(" without an h1"))),
            F.when(
                c("n_many_h1") > 0,
                F.concat(_of(c("n_many_h1"), total), F.lit(" with several, up to "), c("max_h1").cast("string")),
            ),
        ),
        lambda: c("n_no_h1") + c("n_many_h1"),
    )
    add("web_missing_sitemap", lambda: ~c("has_sitemap"), at("/sitemap.xml"), text("no sitemap.xml answered"), none)
    add("web_missing_llms_txt", lambda: ~c("has_llms"), at("/llms.txt"), text("no llms.txt answered"), none)
    pages_with("web_missing_lang", " without a lang attribute")
    add(
        "web_missing_alt",
        lambda: c("images_without_alt") > 0,
        none,
        lambda: F.concat(
            c("images_without_alt").cast("string"), F.lit(" of "), c("images").cast("string"),
            F.lit(" images without alt, on "), _of(c("n_web_missing_alt"), total),
        ),
        lambda: c("images_without_alt"),
    )
    add(
        "web_missing_404",
        lambda: (c("notfound_status") > 0) & ((c("notfound_status") < 400) | ~c("notfound_distinct")),
        at("/"),
        text("an unknown URL answered ", c("notfound_status")),
        none,
    )
    add(
        "web_missing_favicon",
        lambda: ~c("favicon_ok") & ~c("icon_inlined") & ~c("any_favicon_link"),
        at("/favicon.ico"),
        text("no icon served or linked"),
        none,
    )
    js = c("js_bytes") + c("inline_max")
    add(
        "web_heavy_bundle",
        lambda: js > rules.HEAVY_BYTES,
        none,
        lambda: F.concat(format_bytes(js), F.lit(" of uncompressed scripts")),
        lambda: js,
    )
    return out


def failed_checks(facts: DataFrame, checks: list[str] | None = None) -> DataFrame:
    """Adds ``fired`` (what failed and applies) and ``na`` to the per-site row.

    Checks that do not apply are dropped here, once, for every check alike.
    """
    wanted = rules.CHECK_IDS if checks is None else checks
    columns = check_columns(wanted)
    candidates = F.array(*[columns[ch] for ch in wanted])
    return facts.withColumn("na", not_applicable(F.col("site_type"), F.col("ai_crawlers"))).withColumn(
        "fired",
        F.filter(
            candidates, lambda f: f.isNotNull() & ~F.coalesce(F.map_contains_key(F.col("na"), f["id"]), F.lit(False))
        ),
    )


def web_findings(facts: DataFrame, checks: list[str] | None = None) -> DataFrame:
    """One row per site and failed check, before suppressions."""
    return failed_checks(facts, checks).select("site", each(F.col("fired")))


def affected_pages(signals: DataFrame) -> DataFrame:
    """``(site, id, page_id, url)`` for every page-level check; no shuffle, nothing gathered."""
    hit = F.array(*[F.when(cond, F.lit(check)) for check, cond in page_conditions().items()])
    return signals.select(
        "site", F.explode(F.filter(hit, lambda h: h.isNotNull())).alias("id"), "page_id", "url"
    )


def first_pages(signals: DataFrame, keep: int = rules.LISTED_PAGES) -> DataFrame:
    """The first pages of each finding, for a report; a group limit before the shuffle."""
    order = Window.partitionBy("site", "id").orderBy("page_id")
    return (
        affected_pages(signals)
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= keep)
    )


def not_evaluated(total: Column, images: Column, assets_checked: Column) -> Column:
    """``map<check id, reason>`` of checks the capture could not have failed."""
    def entry(cond: Column, check: str, reason: str) -> Column:
        return F.when(cond, F.struct(F.lit(check).alias("key"), F.lit(reason).alias("value")))

    return F.map_from_entries(
        F.filter(
            F.array(
                entry(total < 2, "web_duplicate_titles", "needs at least 2 pages"),
                entry(images == 0, "web_missing_alt", "no images on the captured pages"),
                entry(assets_checked == 0, "web_broken_assets", "no referenced assets to request"),
            ),
            lambda e: e.isNotNull(),
        )
    )


def check_matrix(facts: DataFrame) -> DataFrame:
    """Every check of every site in one of five states, in order of precedence."""
    ids = F.array(*[F.lit(ch) for ch in rules.CHECK_IDS])
    ne = not_evaluated(F.col("total"), F.col("images"), F.col("assets_checked"))
    prepared = (
        failed_checks(facts)
        .withColumn("ne", ne)
        .withColumn("silenced", suppress_map(F.col("suppress")))
        .withColumn("_failed", F.transform("fired", lambda f: f["id"]))
    )

    def state(check: Column) -> Column:
        no_browser = ~F.col("console_checked") & check.isin(rules.NEEDS_BROWSER)
        failed = F.array_contains(F.col("_failed"), check)
        return (
            F.when(no_browser | F.map_contains_key(F.col("ne"), check), "not evaluated")
            .when(F.map_contains_key(F.col("na"), check), "not applicable")
            .when(failed & F.map_contains_key(F.col("silenced"), check), "suppressed")
            .when(failed, "fail")
            .otherwise("ok")
        )

    return prepared.select(
        "site",
        F.inline(F.transform(ids, lambda ch: F.struct(ch.alias("id"), state(ch).alias("status")))),
    )


def checks_passed(matrix: DataFrame) -> DataFrame:
    return matrix.groupBy("site").agg(
        F.count_if(F.col("status") == "ok").alias("passed"),
        F.count_if(F.col("status").isin("ok", "fail")).alias("checkable"),
    )


def stack_fingerprint(pages: DataFrame, responses: DataFrame) -> DataFrame:
    """Twelve signals of the home page, scored."""
    whole = strip_comments(F.col("html"))
    facts = page_signals(
        pages.withColumn("_whole", whole)
        .withColumn("framework", detect_framework(F.col("_whole")))
        .withColumn("has_script_src", F.exists(tags(F.col("_whole"), "script"), lambda t: attr(t, "src").isNotNull()))
        .drop("_whole")
    )
    signals = of_home(facts, **{c: F.col(c) for c in facts.columns if c not in ("site", "page_id")})
    host = F.regexp_replace(host_of(F.col("url")), r":\d+\z", "")
    files = site_files(responses).select(
        "site",
        F.col("llms_txt").isNotNull().alias("has_llms"),
        F.col("sitemap_xml").isNotNull().alias("has_sitemap"),
        "favicon_ok",
        F.lit(True).alias("has_files"),
    )
    # Without captured site files the two file signals are never counted against a site.
    known = F.coalesce(F.col("has_files"), F.lit(False))
    joined = (
        signals.withColumn("platform_domain", platform_domain(host))
        .join(files, "site", "left")
        .join(bundle_bytes(responses).select("site", "js_bytes"), "site", "left")
        .withColumn("has_llms", ~known | F.col("has_llms"))
        .withColumn("has_sitemap", ~known | F.col("has_sitemap"))
        .withColumn("favicon_ok", F.coalesce("favicon_ok", F.lit(False)))
        .withColumn("js_bytes", F.coalesce("js_bytes", F.lit(0)))
    )
    return joined.select(
        "site",
        "platform_domain",
        "framework",
        *[col.alias(name) for name, col in fingerprint_columns().items()],
    )
