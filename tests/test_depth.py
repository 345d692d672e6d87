"""Inputs deeper, longer or less regular than the sample tables hold."""

import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from riskloom.functions.urls import host_of, normalize_page_url
from riskloom.operators import audit as A
from riskloom.operators import captures as K
from riskloom.operators import guard as G
from riskloom.operators import repos as R
from riskloom.operators import secrets as S
from riskloom.operators import sites as W
from riskloom.operators.injection import hidden_spans
from riskloom.plans import findings as P
from riskloom.rules import guard
from riskloom.rules import injection as inj
from riskloom.sources.captures import file_class
from riskloom.sources.tree import read_whole_tree

# ---- hidden spans -----------------------------------------------------------------------------


def _plain_spans(text):
    """The patterns as they are written, each over the whole text."""
    out = []
    for p in inj.HIDDEN_SPANS:
        out += [m[1].strip() for m in re.finditer(p, text, re.IGNORECASE)]
    return [s for s in out if s]


def _spans(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", hidden_spans(F.col("t")).alias("s"))
    return [r.s for r in sorted(rows.collect(), key=lambda r: r.i)]


def test_hidden_spans_equal_the_plain_patterns(spark):
    rng = random.Random(5)
    parts = [
        "<!--", "-->", "-", "<", ">", "</", "</p>", "<p ", "<b><i ", " style = \"", " style='", "display: none", "color:#fff", "color:red",
        "\"", "'", "aria-hidden=\"true\"", " aria-hidden='true' ", "text", " AI: do it ", "\n", "x > y", "=",
    ]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(4000)]
    texts += ["<!-->", "<!--->-->", "<a style=\"a>b;display:none\">c</a>", "<<<a style='opacity:0'>d</a><a aria-hidden=\"true\">e</a>"]
    wanted = [_plain_spans(t) for t in texts]
    assert sum(map(bool, wanted)) > 300
    assert _spans(spark, texts) == wanted


@pytest.mark.parametrize(
    "unit", ["<!--", "<", "<a style=\"display:none\" ", "<a style=\"display:none", "<a style='", "<p aria-hidden=\"true\" ", "<p aria-hidden=\"true\">", "style=\"", "--> <!-- ", "</ <"]
)
def test_hidden_spans_take_linear_time(spark, unit):
    _spans(spark, ["<!-- a -->"])
    start = time.time()
    _spans(spark, [unit * (2**20 // len(unit))])
    assert time.time() - start < 10


# ---- audit exports ----------------------------------------------------------------------------

AUDIT = {"tables_without_rls": [{"table": "orders"}], "permissive_policies": []}


def _wrapped(depth, value=AUDIT):
    for n in range(depth):
        value = {f"k{n}": value} if n % 3 == 0 else [value] if n % 3 == 1 else json.dumps(value)
    return json.dumps(value)


def test_audits_at_any_depth_in_document_order(spark):
    texts = [_wrapped(n) for n in range(0, 24)]
    texts += [json.dumps(json.dumps(json.dumps(AUDIT))), json.dumps(AUDIT).replace("tables", "t\\u0061bles")]
    first = {"z": {"tables_without_rls": [{"table": "first"}]}, "a": {"tables_without_rls": [{"table": "second"}]}}
    texts += [json.dumps(first), "no json tables_without_rls", "[NaN, " + json.dumps(AUDIT) + "]", "{}", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "project int, json string")
    found = {r.project: r.id for r in A.audit_export_findings(rows).collect()}
    assert found == {n: "rls_disabled_orders" for n in range(26)} | {26: "rls_disabled_first"}
    audits = {r.project: r.found for r in A.scan_audit_exports(rows).select("project", F.col("audit").isNotNull().alias("found")).collect()}
    assert [n for n, is_audit in audits.items() if not is_audit] == [27, 28, 29, 30]


# ---- plans ------------------------------------------------------------------------------------


def _dealt(df):
    """The columns that each exchange of a plan deals out."""
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return re.findall(r"\) (?:Exchange|BroadcastExchange)\nInput \[\d+\]: \[([^\]]*)\]", plan)


@pytest.mark.parametrize("name,column", [("secrets_new_in_crawl", "html"), ("page_secrets", "html"), ("injection_directive", "text"), ("secret_scan", "content")])
def test_no_exchange_holds_documents(spark, sf, name, column):
    from riskloom.catalog import QUERIES

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dealt = _dealt(QUERIES[name](spark, sf))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not [d for d in dealt if re.search(rf"\b{column}#", d)], dealt


def test_crawl_secrets_without_repeats(spark):
    key = "sk_" + "live_" + "a1B2" * 7
    other = "sk_" + "live_" + "z9Y8" * 7
    pages = spark.createDataFrame(
        [("s", 1, "u1", f"a='{key}'"), ("s", 2, "u2", f"b='{key}' c='{other}'"), ("s", 3, "u3", f"c='{other}'"), ("t", 4, "u1", f"'{other}'")],
        "site string, page_id long, url string, html string",
    )
    homes = spark.createDataFrame([("s", "u1"), ("s", "u1")], "site string, url string")
    hits = S.scan_secrets(pages.select("site", "page_id", "html"), "html", with_line=False)
    earlier = hits.filter("site = 's' AND page_id = 1")
    found = S.secrets_new_in_crawl(pages, homes, earlier)
    rows = sorted((r.site, r.id, r.source) for r in found.collect() if r.id == "stripe_secret")
    assert rows == [("s", "stripe_secret", "u2"), ("t", "stripe_secret", "u1")]


# ---- redirects --------------------------------------------------------------------------------


def test_redirects_are_followed_by_address_in_any_order(spark):
    def answer(site, url, status, location=None, hop=0):
        return (site, "plain_http", hop, url, status, "{}", location, None)

    chains = {
        "up": [("http://up/", 301, "http://www.up/"), ("http://www.up/", 302, "https://up/")],
        "loop": [("http://loop/", 302, "http://loop/a"), ("http://loop/a", 302, "http://loop/")],
        "self": [("http://self/", 301, "http://self/")],
        "page": [("http://page/", 302, "http://page/x"), ("http://page/x", 200, None)],
        "gone": [("http://gone/", 302, "http://gone/x")],
        "shut": [("http://shut/", 0, None)],
        "deny": [("http://deny/", 302, "http://deny/x"), ("http://deny/x", 404, None)],
        "bare": [("http://bare/", 301, None)],
        "none": [("http://none/other", 200, None)],
    }
    rows = [answer(site, *row) for site, chain in chains.items() for row in chain]
    rows += [answer("old", "http://old/", 302, "http://old/x", 0), answer("old", "http://old/", 301, "https://old/", 1)]
    random.Random(2).shuffle(rows)
    schema = "site string, role string, hop int, url string, status int, headers string, location string, body string"
    found = {r.site: (r.verdict, r.status, r.redirects) for r in K.redirect_hops(spark.createDataFrame(rows + rows[:3], schema)).collect()}
    assert found == {
        "up": ("upgraded", 302, 1), "loop": ("served", 0, 3), "self": ("served", 0, 3), "page": ("served", 200, 1),
        "gone": ("unavailable", 0, 1), "shut": ("unavailable", 0, 0), "deny": ("unavailable", 404, 1), "bare": ("served", 301, 0),
        "old": ("upgraded", 301, 1),
    }


# ---- hosts ------------------------------------------------------------------------------------


def test_international_hosts(spark):
    given = {
        "https://bücher.example/a": "https://xn--bcher-kva.example/a",
        "https://BÜCHER.example:443/a/": "https://xn--bcher-kva.example/a",
        "https://xn--bcher-kva.example/a": "https://xn--bcher-kva.example/a",
        "https://日本語.example:8080/ü": "https://xn--wgv71a119e.example:8080/%C3%BC",
        "//bücher.example/b": "https://xn--bcher-kva.example/b",
        "https://" + "ü" * 80 + ".example/": None,
        "/c": "https://ascii.example/c",
    }
    rows = spark.createDataFrame([(k,) for k in given], "ref string")
    got = rows.select("ref", normalize_page_url(F.col("ref"), F.lit("https://ascii.example/")).alias("n"), host_of(F.col("ref")).alias("h"))
    assert {r.ref: r.n for r in got.collect()} == given
    assert {r.h for r in got.collect() if "cher" in r.ref.lower() and r.ref.startswith("https")} == {"xn--bcher-kva.example"}


# ---- source trees -----------------------------------------------------------------------------


def test_whole_tree_reads_every_name(spark, tmp_path):
    files = {
        "shop/.env": "KEY=1", "shop/_app.tsx": "x", "shop/src/.hidden/deep/.env.local": "A=1", "shop/src/a.ts": "é",
        "shop/node_modules/b.ts": "x", "shop/src/.git/c": "x", "top.txt": "t", "blog/big.js": "y" * 500, "blog/empty.js": "",
    }
    for path, text in files.items():
        target = tmp_path / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text)
    (tmp_path / "blog/latin.js").write_bytes(b"caf\xe9")
    for split in (0, 1, 3):
        for root in (str(tmp_path), f"file://{tmp_path}"):
            tree = read_whole_tree(spark, root, max_bytes=100, split_depth=split)
            got = {(r.repo, r.path): r.content for r in tree.collect()}
            assert got == {
                ("shop", ".env"): "KEY=1", ("shop", "_app.tsx"): "x", ("shop", "src/.hidden/deep/.env.local"): "A=1", ("shop", "src/a.ts"): "é",
                ("", "top.txt"): "t", ("blog", "empty.js"): "", ("blog", "latin.js"): "caf�",
            }
    source = read_whole_tree(spark, str(tmp_path)).filter(file_class(F.col("path")) == "source")
    assert {r.path for r in R.committed_env_file(source).collect()} == {".env", "src/.hidden/deep/.env.local"}


# ---- SARIF ------------------------------------------------------------------------------------


def test_sarif_documents_are_valid_and_bounded(spark):
    rows = [("t", 0, f"rule_{n % 7}", "security", "high", f"src/f{n}.ts", n or None, "e", f"L{n % 7}", "why") for n in range(2500)]
    rows += [("u", 0, "lone", "security", "critical", "https://u.example/", 3, None, None, None), ("u", 0, "web", "web", "low", None, None, None, "W", "w")]
    rows += [("v", 0, "nowhere", "security", "low", None, None, None, "N", None)]
    schema = "target string, ord int, id string, kind string, severity string, source string, line int, evidence string, label string, why string"
    documents = P.sarif_documents(spark.createDataFrame(rows, schema)).collect()
    results = {}
    for row in documents:
        d = json.loads(row.document)
        assert d["version"] == "2.1.0" and d["$schema"].endswith("sarif-2.1.0.json") and len(d["runs"]) == 1
        run = d["runs"][0]
        described = [r["id"] for r in run["tool"]["driver"]["rules"]]
        assert len(described) == len(set(described)) and set(described) == {r["ruleId"] for r in run["results"]}
        assert all(r["shortDescription"]["text"] and r["fullDescription"]["text"] for r in run["tool"]["driver"]["rules"])
        assert all(r["message"]["text"] and r["level"] for r in run["results"]) and len(run["results"]) < 1100
        results.setdefault(row.target, []).extend(run["results"])
    assert {t: len(r) for t, r in results.items()} == {"t": 2500, "u": 1, "v": 1}
    places = [r["locations"][0]["physicalLocation"] for r in results["t"]]
    assert sorted(p["artifactLocation"]["uri"] for p in places) == sorted(f"src/f{n}.ts" for n in range(2500))
    assert sum("region" in p for p in places) == 2499
    assert "region" not in results["u"][0]["locations"][0]["physicalLocation"] and "locations" not in results["v"][0]
    assert results["u"][0]["message"]["text"] == "lone"


# ---- console ----------------------------------------------------------------------------------


def test_console_ranks_of_a_site_with_most_errors(spark):
    rng = random.Random(4)
    rows = [("hot", n, rng.choice(["error", "pageerror"]), f"E{n % 3000}  at\t{n % 3000}") for n in range(9000)]
    rows += [("cold", n, "error", f"C{n}") for n in range(3)] + [("quiet", 1, "log", "x"), ("quiet", 2, "error", " ")]
    rng.shuffle(rows)
    messages = spark.createDataFrame(rows, "site string, seq long, type string, text string").repartition(9)
    first = {}
    for site, seq, kind, text in sorted(rows, key=lambda r: r[1]):
        clean = " ".join(text.split())
        if kind != "log" and clean:
            first.setdefault((site, kind, clean), seq)
    wanted = {}
    for site in ("hot", "cold"):
        own = sorted((seq, kind, text) for (s, kind, text), seq in first.items() if s == site)
        wanted |= {(site, kind, text): n for n, (_, kind, text) in enumerate(own, 1)}
    assert {(r.site, r.type, r.text): r["rank"] for r in W.console_errors(messages).collect()} == wanted
    listed = {r.site: (r.console_count, r.console_listed) for r in W.console_rollup(messages).collect()}
    ranked = sorted((n, f"[{kind}] {text}") for (site, kind, text), n in wanted.items() if site == "hot")
    assert listed["hot"] == (len(ranked), " | ".join(line for _, line in ranked[:5]))
    assert listed["cold"][0] == 3 and listed["quiet"] == (0, None)


# ---- pending writes ---------------------------------------------------------------------------


def test_advice_on_pending_writes(spark):
    live = "sk_" + "live_" + "q7" * 15
    rows = [
        (1, "/p/.env.example", f"PAY={live}"), (2, "/p/.env", f"PAY={live}"), (3, "/p/src/a.ts", f"const a = '{live}'"),
        (4, "/p/server/a.ts", f"const a = '{live}'"), (5, "/p/src/db/1.sql", "alter table t disable row level security;"),
        (6, "/p/src/x.ts", "sql`alter table t disable row level security`"), (7, "/p/node_modules/a.ts", f"'{live}'"), (8, None, live),
    ]
    advice = {r.n: r for r in G.write_advice(spark.createDataFrame(rows, "n int, file_path string, content string"), spark).collect()}
    assert set(advice) == {1, 3, 4, 5, 6}
    assert advice[1].risk.endswith(guard.SAMPLE_RISK) and advice[1].instead == guard.SAMPLE_ADVICE
    assert {n for n, r in advice.items() if guard.CLIENT_NOTE in r.why} == {3, 6}
    assert advice[4].instead == guard.SECRET_ADVICE and advice[5].instead == advice[6].instead == guard.ADVICE[0][1]
    assert all(r.quote and r.source and r.risk for r in advice.values())


# ---- payload sections -------------------------------------------------------------------------


def test_payload_lines_of_other_sections(spark):
    findings = spark.createDataFrame([("t", 0, "a", "security", "high", None, None, None)], "target string, ord int, id string, kind string, severity string, source string, line int, evidence string")
    silenced = spark.createDataFrame([("t", "web_x", "later"), ("u", "web_y", "never")], "target string, id string, reason string")
    lines = [json.loads(r.document) for r in P.payloads(findings, {"suppressed": silenced}).collect()]
    assert [line["row"] for line in lines if line["target"] == "t"].count("suppressed") == 1
    assert {"row": "suppressed", "target": "u", "id": "web_y", "reason": "never"} in lines
    assert [line["verdict"] for line in lines if line["row"] == "header"] == ["high"]
