"""Website checks on hand-made sites."""

import json

from pyspark.sql import functions as F

from riskloom.operators import captures as K
from riskloom.operators import config as C
from riskloom.operators import robots as R
from riskloom.operators import sites as S
from riskloom.operators.pages import page_signals
from riskloom.rules import web as rules
from riskloom.sources.captures import captured_responses

GOOD = (
    '<!doctype html><html lang="en"><head><title>{t}</title><meta name="description" content="d">'
    '<link rel="canonical" href="/x"><link rel="icon" href="/f.svg"><meta property="og:title" content="t">'
    '<meta property="og:image" content="/i.png"><script type="application/ld+json">{{}}</script></head>'
    "<body><h1>h</h1>" + "visible words " * 30 + '<img src="/p.jpg" alt="p"></body></html>'
)
SHELL = (
    '<!doctype html><html><head><title>App</title></head><body><div id="root"></div>'
    '<script type="module" crossorigin src="/assets/index-a1b2c3d4.js"></script></body></html>'
)


def _pages(spark, rows):
    return spark.createDataFrame(rows, "site string, page_id long, url string, html string")


def _responses(spark, rows):
    full = [(s, role, 0, url, st, json.dumps(h), None, body) for s, role, url, st, h, body in rows]
    return captured_responses(
        spark.createDataFrame(
            full, "site string, role string, hop int, url string, status int, headers string, location string, body string"
        )
    )


def _console(spark, rows=()):
    return spark.createDataFrame(list(rows), "site string, seq long, type string, text string")


def _configs(spark, rows=()):
    return spark.createDataFrame(list(rows), "site string, json string")


def _files(site, base, good=True):
    if not good:
        return [(site, "home", base, 200, {}, SHELL), (site, "notfound", base + "nope", 200, {}, SHELL)]
    return [
        (site, "home", base, 200, {}, GOOD.format(t="A")),
        (site, "robots", base + "robots.txt", 200, {}, "User-agent: *\nAllow: /"),
        (site, "llms", base + "llms.txt", 200, {}, "# notes"),
        (site, "sitemap", base + "sitemap.xml", 200, {}, "<urlset></urlset>"),
        (site, "favicon", base + "favicon.ico", 200, {}, "ICO"),
        (site, "notfound", base + "nope", 404, {}, "no"),
    ]


def _fired(spark, pages, responses, configs=(), console=()):
    facts = S.site_facts(
        _pages(spark, pages), _responses(spark, responses), _configs(spark, configs), _console(spark, console)
    )
    return {r.id for r in S.web_findings(facts).collect()}, facts


def test_well_built_site_has_no_findings(spark):
    base = "https://g.example.org/"
    fired, facts = _fired(
        spark,
        [("g.example.org", 1, base, GOOD.format(t="A")), ("g.example.org", 2, base + "b", GOOD.format(t="B"))],
        _files("g.example.org", base),
    )
    assert fired == set()
    states = {r.id: r.status for r in S.check_matrix(facts).collect()}
    assert states["web_console_errors"] == "not evaluated"
    assert states["web_ai_block_incomplete"] == "not applicable"
    assert states["web_missing_og"] == "ok"


def test_empty_shell(spark):
    base = "https://s.example.org/"
    fired, _ = _fired(
        spark, [("s.example.org", 1, base, SHELL), ("s.example.org", 2, base + "b", SHELL)], _files("s.example.org", base, False)
    )
    assert {
        "web_empty_html", "web_duplicate_titles", "web_missing_meta_description", "web_missing_og",
        "web_missing_canonical", "web_missing_structured_data", "web_h1_structure", "web_missing_sitemap",
        "web_missing_llms_txt", "web_missing_lang", "web_missing_404", "web_missing_favicon",
    } == fired


def test_one_finding_per_site_and_check(spark):
    base = "https://m.example.org/"
    pages = [("m.example.org", i, f"{base}{i}", SHELL) for i in range(40)]
    facts = S.site_facts(_pages(spark, pages), _responses(spark, _files("m.example.org", base)), _configs(spark), _console(spark))
    rows = S.web_findings(facts).collect()
    assert len(rows) == len({r.id for r in rows})
    assert S.affected_pages(page_signals(_pages(spark, pages))).filter("id = 'web_missing_lang'").count() == 40


def test_declarations(spark):
    base = "https://d.example.org/"
    pages = [("d.example.org", 1, base, SHELL)]
    fired, facts = _fired(
        spark,
        pages,
        _files("d.example.org", base, False),
        [("d.example.org", '{"intent":{"aiCrawlers":"blocked","siteType":"internal"},"suppress":[{"id":"web_missing_lang","reason":"r"},{"id":"stripe_secret","reason":"r"}]}')],
    )
    assert "web_ai_block_incomplete" in fired
    assert not fired & set(rules.NOT_APPLICABLE_BY_SITE_TYPE["internal"])
    states = {r.id: r.status for r in S.check_matrix(facts).collect()}
    assert states["web_missing_lang"] == "suppressed"
    parsed = C.parse_configs(
        _configs(spark, [("d", '{"suppress":[{"id":"stripe_secret","reason":"r"}]}')])
    ).first()
    assert [w.kind for w in parsed.warnings] == ["not_suppressible"] and parsed.suppress == []


def test_security_findings_cannot_be_suppressed(spark):
    findings = spark.createDataFrame(
        [("s", "stripe_secret", None), ("s", "web_missing_og", "web")], "site string, id string, kind string"
    )
    silenced = spark.createDataFrame([("s", "stripe_secret", "x"), ("s", "web_missing_og", "y")], "site string, id string, reason string")
    got = {r.id: r.suppressed_reason for r in C.apply_suppressions(findings, silenced).collect()}
    assert got == {"stripe_secret": None, "web_missing_og": "y"}


def test_robots(spark):
    cases = {
        "User-agent: GPTBot\nDisallow: /": {"GPTBot"},
        "User-agent: *\nDisallow: /": set(rules.AI_BOTS),
        "User-agent: GPTBot\nDisallow:": set(),
        "User-agent: *\nDisallow: /admin\nAllow: /": set(),
        "User-agent: GPTBot\nUser-agent: ClaudeBot\nDisallow: /": {"GPTBot", "ClaudeBot"},
        "User-agent: *\nDisallow: /\n\nUser-agent: GPTBot\nAllow: /": set(rules.AI_BOTS) - {"GPTBot"},
        "<!doctype html><html></html>": set(),
    }
    files = spark.createDataFrame([(t, t) for t in cases], "site string, robots_txt string")
    got = {r.site: set(r.bots) for r in R.robots_verdicts(files).collect()}
    assert {t: got.get(t, set()) for t in cases} == cases


def test_page_parsing(spark):
    html = "<!-- <title>old</title> --><title> Real\n one </title><script>var a='<h1>x</h1><img>'</script><h1 class=a>h</h1><img src=a alt=''><img src=b>"
    row = page_signals(_pages(spark, [("s", 1, "https://s/", html)])).first()
    assert (row.title, row.h1_count, row.img_total, row.img_without_alt) == ("Real one", 1, 2, 1)
    far = "<style>" + "x" * 210_000 + "</style><h1>late</h1>"
    assert page_signals(_pages(spark, [("s", 1, "https://s/", far)])).first().h1_count == 1


def test_transport(spark):
    def hops(name, rows):
        return [(name, "plain_http", i, f"http://{name}/", st, "{}", loc, None) for i, (st, loc) in enumerate(rows)]

    data = (
        hops("up", [(301, "https://up/")])
        + hops("served", [(200, None)])
        + hops("loop", [(302, "http://a/"), (302, "http://b/"), (302, "http://c/")])
        + hops("refused", [(0, None)])
        + hops("denied", [(302, "http://x/"), (403, None)])
    )
    schema = "site string, role string, hop int, url string, status int, headers string, location string, body string"
    got = {r.site: r.verdict for r in K.redirect_hops(spark.createDataFrame(data, schema)).collect()}
    assert got == {"up": "upgraded", "served": "served", "loop": "served", "refused": "unavailable", "denied": "unavailable"}
