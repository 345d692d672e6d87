"""Secrets, migrations, source trees, hook events; batch against stream."""

import json

from pyspark.sql import functions as F

from riskloom.catalog import seeds as D
from riskloom.operators import audit as A
from riskloom.operators import guard as G
from riskloom.operators import repos as R
from riskloom.operators import secrets as S
from riskloom.sources.captures import file_class, read_source_tree
from riskloom.streaming import guard_stream as stream


def _ids(spark, text):
    df = spark.createDataFrame([(text,)], "content string")
    return {r.id for r in S.scan_secrets(df).collect()}


def test_secret_classes(spark):
    for value, rule in [
        (D.STRIPE_LIVE, "stripe_secret"), (D.STRIPE_TEST, "stripe_test_secret"), (D.OPENAI, "openai_key"),
        (D.ANTHROPIC, "anthropic_key"), (D.AWS, "aws_access_key"), (D.GITHUB, "github_token"),
        (D.GOOGLE, "google_api_key"), (D.SLACK, "slack_token"), (D.DB_URL, "db_connection_string"),
        (D.RESEND, "resend_key"), (D.SENDGRID, "sendgrid_key"), (D.TWILIO, "twilio_key"),
        (D.PEM, "private_key"), (D.SB_SECRET, "supabase_secret_key"), (D.SERVICE_JWT, "supabase_service_role"),
    ]:
        assert rule in _ids(spark, f'const k = "{value}"'), rule


def test_public_and_placeholder_values_stay_silent(spark):
    for text in [
        f'k = "{D.ANON_JWT}"', f'apikey: "{D.ANON_JWT}"', 'api_key = "your_api_key_here"',
        f'h = "Bearer {D.ANON_JWT}"', f'k="{D.SB_PUBLIC}";h="Bearer "+k', "h = `Bearer ${process.env.TOKEN}`",
        'curl -H "Authorization: Bearer YOUR_TOKEN_HERE"', 'T = "replace-with-your-token-value"; h = "Bearer " + T',
        'var q="i18next.translation.store.0123456789abcdef.x";h="Bearer ".concat(q)',
        f'var B="{D.OTHER_LITERAL}";var B="{D.BEARER}";h="Bearer ".concat(B)',
    ]:
        assert not _ids(spark, text) & {"hardcoded_bearer", "generic_secret_assign", "supabase_service_role"}, text


def test_bearer(spark):
    assert "hardcoded_bearer" in _ids(spark, f'h={{A:"Bearer {D.BEARER}"}}')
    assert "hardcoded_bearer" in _ids(spark, f'B="{D.BEARER}";h="Bearer ".concat(B)')


def test_value_is_never_emitted_and_line_is_right(spark):
    df = spark.createDataFrame([(f'a = 1\nk = "{D.STRIPE_LIVE}"\n',)], "content string")
    row = S.scan_secrets(df).first()
    assert row.line == 2 and D.STRIPE_LIVE not in json.dumps(row.asDict())


def test_migrations(spark):
    sql = (
        "create table public.profiles (id int);\ncreate table public.safe (id int);\n"
        "alter table only public.safe enable row level security;\n"
        'create policy "p" on public.profiles for select using (true);\n'
        'ALTER TABLE IF EXISTS "public"."orders" DISABLE ROW LEVEL SECURITY;\n'
        "grant all on orders to anon;"
    )
    files = spark.createDataFrame(
        [("r", 1, "m/1.sql", sql), ("orm", 1, "m/1.sql", "create table plain (id int);")],
        "repo string, seq long, path string, content string",
    )
    got = {(r.repo, r.id, r.severity, r.line) for r in R.migration_findings(files).collect()}
    assert got == {
        ("r", "rls_disabled_profiles", "high", 1), ("r", "permissive_policy", "critical", 4),
        ("r", "rls_turned_off_orders", "critical", 5), ("r", "grant_anon_orders", "high", 6),
    }
    context = spark.createDataFrame([("orm",)], "repo string")
    assert ("orm", "rls_disabled_plain") in {(r.repo, r.id) for r in R.migration_findings(files, context).collect()}


def test_source_tree(spark, tmp_path):
    for path, text in {
        "repo1/src/a.ts": "x", "repo1/node_modules/b.ts": "x", "repo2/.env": "A=1", "repo2/db/1.sql": "select 1",
        "repo2/big.js": "y" * 100, "repo2/notes.md": "n",
    }.items():
        target = tmp_path / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text)
    tree = read_source_tree(spark, str(tmp_path), max_bytes=50)
    # Spark's file readers skip names that start with a dot, so .env arrives through a table.
    got = {(r.repo, r.path, r["class"]) for r in tree.withColumn("class", file_class(F.col("path"))).collect()}
    assert got == {
        ("repo1", "src/a.ts", "source"), ("repo2", "db/1.sql", "migration"),
        ("repo2", "notes.md", None),
    }


def test_hosts_and_moments(spark):
    expected = {
        0: ("claude-code", "prompt"), 1: ("claude-code", "action"), 2: ("claude-code", "content"),
        3: ("codex", "prompt"), 4: ("codex", "action"), 5: ("codex", "content"), 6: ("cursor", "action"),
        7: ("cursor", "content"), 8: ("copilot", "action"), 9: ("copilot", "content"), 10: ("gemini", "prompt"),
        11: ("gemini", "action"), 12: ("gemini", "content"), 13: ("windsurf", "action"), 14: ("opencode", "prompt"),
        15: ("opencode", "action"), 16: ("opencode", "content"), 17: ("cursor", "prompt"), 19: ("claude-code", "action"),
        20: ("claude-code", "action"),
    }
    events = spark.createDataFrame([(k, t.replace("{id}", str(k))) for k, t in D.EVENT_SEEDS], "event_id long, payload string")
    rows = {r.event_id: r for r in G.verdicts(events, spark).collect()}
    assert {k: (rows[k].host, rows[k].moment) for k in expected} == expected
    # Every risky template is found; a prompt on a host that only blocks is a note all the same.
    assert all(rows[k].risks for k in expected)
    assert rows[4].action == "ask" and rows[0].action == "note"
    assert 22 not in rows and rows[21].risks == []
    assert {r.rule_id for r in rows[20].risks} == {"stripe_secret"}


def test_malformed_payloads(spark):
    bad = ["", "null", "7", "[]", '{"hook_event_name":"PreToolUse","tool_name":"Write","tool_input":null}',
           '{"hook_event_name":"UserPromptSubmit","prompt":42}', '{"hook_event_name":"PostToolUse","tool_response":{"a":{"b":{"c":{"d":{"e":{"f":1}}}}}}}']
    events = spark.createDataFrame(list(enumerate(bad)), "event_id long, payload string")
    assert all(r.risks == [] for r in G.verdicts(events, spark).collect())


def test_stream_equals_batch(spark, sf, tmp_path):
    events = D.hook_events(spark, sf)
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    events.limit(0).write.parquet(source)
    for part in range(3):
        events.filter(F.col("event_id") % 3 == part).coalesce(1).write.mode("append").parquet(source)
    risks = stream.guard_risks(stream.read_events(spark, source), spark)
    query = stream.write_risks(risks, out, state, once=True)
    query.awaitTermination(240)
    assert query.exception() is None
    columns = ["event_id", "host", "moment", "action", "rule_id"]
    streamed = sorted(map(tuple, spark.read.parquet(out).select(columns).collect()))
    batch = sorted(map(tuple, stream.guard_risks(events, spark).select(columns).collect()))
    assert streamed == batch and batch


def test_audit_wrappings(spark):
    inner = {"tables_without_rls": [{"table": "t"}]}
    shapes = [inner, {"a": {"b": inner}}, [{"x": json.dumps(inner)}], json.dumps(json.dumps(inner)), {"no": 1}]
    raw = spark.createDataFrame(
        [(str(i), s if isinstance(s, str) else json.dumps(s)) for i, s in enumerate(shapes)], "project string, json string"
    )
    assert {r.project for r in A.audit_export_findings(raw).collect()} == {"0", "1", "2", "3"}
