"""Inputs beyond the sizes at which work used to stop."""

import json
import time

from pyspark.sql import functions as F

from riskloom.operators import captures as K
from riskloom.operators import guard as G
from riskloom.operators import sites as S
from riskloom.operators.injection import hidden_spans
from riskloom.operators.pages import page_signals
from riskloom.operators.secrets import scan_secrets
from riskloom.sources.captures import packed_tree

RESPONSE = "site string, role string, hop int, url string, status int, headers map<string,string>, location string, body string"


def response(role, hop=0, url="u", status=200, body="", site="s"):
    return (site, role, hop, url, status, {}, None, body)


def test_page_signals_read_whole_documents(spark):
    css = "<style>" + "a{b:c}" * 40_000 + "</style>"
    late = "<link rel=canonical href=/c><meta name=description content=d>"
    html = "<html><head>" + css + late + "</head><body>" + "x " * 3_000_000 + "<h1>end</h1></body></html>"
    row = page_signals(spark.createDataFrame([(1, html)], "page_id long, html string")).first()
    assert (row.canonical, row.meta_description, row.h1_count) == ("/c", "d", 1)
    assert row.body_text_length > 5_000_000


def test_all_console_errors_count(spark):
    rows = [("s", k, "error", "x" * 400 + f" different at the end {k}") for k in range(40)]
    messages = spark.createDataFrame(rows, "site string, seq int, type string, text string")
    row = S.console_rollup(messages).first()
    assert row.console_count == 40 and row.console_listed.count(" | ") == 4


def test_all_assets_bundles_and_maps(spark):
    html = "".join(f"<img src='/a{k:03}.png'>" for k in range(50))
    pages = spark.createDataFrame([("https://s", 1, "https://s/", html)], "site string, page_id long, url string, html string")
    rows = [response("asset", url=f"https://s/a{k:03}.png", status=404, site="https://s") for k in range(50)]
    for k in range(60):
        rows.append(response("bundle", k, f"https://s/b{k}.js", body="abc\n//# sourceMappingURL=m%d.map" % k, site="https://s"))
    rows.append(response("sourcemap", url="https://s/m58.map", body='{"mappings": "", "sources": []}', site="https://s"))
    responses = spark.createDataFrame(rows, RESPONSE)
    assets = S.asset_rollup(pages, responses).first()
    assert (assets.assets_checked, assets.assets_broken) == (50, 50) and assets.assets_listed.count(" | ") == 9
    assert K.js_bytes(responses).first().bundles == 60
    assert [r["rank"] for r in K.source_maps(responses).collect()] == [59]


def test_frontier_lists_every_link(spark):
    html = "".join(f"<a href='/p{k}'>x</a>" for k in range(30))
    pages = spark.createDataFrame([("s.example", 1, "https://s.example/", html)], "site string, page_id long, url string, html string")
    files = spark.createDataFrame([("s.example", None)], "site string, sitemap_xml string")
    assert sorted(r["rank"] for r in S.crawl_frontier(pages, files).collect()) == list(range(1, 31))


def test_long_hidden_text_is_a_span(spark):
    text = "<!-- " + "word " * 2000 + "-->"
    spans = spark.createDataFrame([(text,)], "t string").select(hidden_spans(F.col("t")).alias("s")).first().s
    assert any(len(x if isinstance(x, str) else str(x)) > 9000 for x in spans)


def test_dashed_line_takes_linear_time(spark):
    line = "a-b_" * 250_000 + "api_key = '" + "k9" * 10 + "'"
    table = spark.createDataFrame([("r", "x.js", line)], "repo string, path string, content string")
    scan_secrets(table.limit(0)).collect()
    start = time.time()
    found = [r.id for r in scan_secrets(table).collect()]
    assert found == ["generic_secret_assign"] and time.time() - start < 20


def test_payload_leaves_in_document_order_at_any_depth(spark):
    deep = "bottom"
    for _ in range(40):
        deep = {"z": [deep]}
    payload = {"title": "Note:", "body": "disable", "a": [1, True, None, 2.5, 2.0], "nested": deep}
    rows = [(json.dumps(payload),), ("no json",), (None,)]
    table = spark.createDataFrame(rows, "payload string")
    got = [r.f for r in table.select(G.flatten_payload(F.col("payload")).alias("f")).collect()]
    assert got == ["Note:\ndisable\n1\ntrue\n\n2.5\n2\nbottom", "no json", None]


def test_first_capture_of_a_role_counts(spark):
    rows = [
        response("robots", 1, "u", body="User-agent: z"),
        response("robots", 0, "u", body="User-agent: a"),
        response("notfound", 0, "n", 404, "<html>gone"),
        response("notfound", 1, "n", 200, "<html>home page"),
        response("home", 0, "h", 200, "<html>home page"),
    ]
    row = K.site_files(spark.createDataFrame(rows, RESPONSE)).first()
    assert row.robots_txt == "User-agent: a" and row.notfound_status == 404 and row.notfound_distinct


def test_packed_tree_keeps_dot_names(spark):
    rows = [("r", ".env", "A=1"), ("r", "_app.tsx", "x"), ("r", "node_modules/a.js", "x"), ("r", "src/big.js", "y" * 3_000_000)]
    got = {r.path: r["size"] for r in packed_tree(spark.createDataFrame(rows, "repo string, path string, content string")).collect()}
    assert got == {".env": 3, "_app.tsx": 1, "src/big.js": 3_000_000}
