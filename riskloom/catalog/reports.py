"""The findings table and its reports, plus audit exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.catalog import seeds
from riskloom.catalog.captures import _first_firebase
from riskloom.catalog.checks import _facts, _suppressions
from riskloom.catalog.repos import supabase_repos
from riskloom.catalog.registry import expression, literal, oracle_of, query, values
from riskloom.operators import audit as A
from riskloom.operators import captures as K
from riskloom.operators import config as C
from riskloom.operators import repos as R
from riskloom.operators import secrets as S
from riskloom.operators import sites as W
from riskloom.plans import findings as P
from riskloom.rules import catalog
from riskloom.sources.captures import captured_responses, file_class
from riskloom.sources.scratch import written

# ---- audit exports --------------------------------------------------------------------------

expression(
    "audit_rows",
    """SELECT project, json(audit) AS audit FROM (SELECT project, CASE json_valid(json) WHEN true THEN CASE
    WHEN json_exists(json, '$.audit') THEN json_extract(json, '$.audit')::VARCHAR
    WHEN json_exists(json, '$.tables_without_rls') THEN json
    WHEN json_exists(json, '$.rows') THEN json_extract(json, '$.rows[0].result')::VARCHAR
    WHEN json_exists(json, '$[0].jsonb_pretty') THEN json_extract_string(json, '$[0].jsonb_pretty') END END AS audit FROM audit_exports)""",
)


@query("scan_audit_export", "SELECT project, audit IS NOT NULL AS found, coalesce(len(json_keys(audit)), 0) AS lists FROM audit_rows")
def _(spark, sf):
    audits = A.scan_audit_exports(seeds.audit_exports(spark, sf))
    return audits.select(
        "project",
        F.col("audit").isNotNull().alias("found"),
        F.coalesce(F.size(F.json_object_keys(F.to_json("audit"))), F.lit(0)).alias("lists"),
    )


@query(
    "audit_export_findings",
    """SELECT project, 'rls_disabled_' || json_extract_string(x, '$.table') AS id, 'high' AS severity, 6 AS check_no,
        'supabase:public.' || json_extract_string(x, '$.table') AS source, 'relrowsecurity = false' AS evidence
        FROM (SELECT project, unnest(json_extract(audit, '$.tables_without_rls[*]')) AS x FROM audit_rows)
    UNION ALL SELECT project, 'permissive_policy', 'critical', 7, 'supabase:public.' || json_extract_string(x, '$.table'),
        json_extract_string(x, '$.policy') || ' uses (true)' FROM (SELECT project, unnest(json_extract(audit, '$.permissive_policies[*]')) AS x FROM audit_rows)
    UNION ALL SELECT project, 'security_definer', 'medium', 10, 'supabase:public.' || json_extract_string(x, '$.function'), 'prosecdef = true'
        FROM (SELECT project, unnest(json_extract(audit, '$.security_definer_functions[*]')) AS x FROM audit_rows)""",
)
def _(spark, sf):
    return A.audit_export_findings(seeds.audit_exports(spark, sf))


# ---- the findings table ---------------------------------------------------------------------


def _families(spark, sf):
    # A dozen families read the captures, so they are derived once, like the table that a user has.
    r = written(captured_responses(seeds.responses(spark, sf)), "responses")
    firebase = _first_firebase(spark, sf)
    probes, writes = K.table_probes(r), K.write_probes(r)
    files = seeds.source_files(spark, sf).filter(file_class(F.col("path")) == "source")
    sql = seeds.sql_files(spark, sf)
    return [
        (K.missing_headers(r), "site", "security"),
        (K.leaky_headers(r), "site", "security"),
        (K.plain_http_served(r), "site", "security"),
        (K.source_map_exposed(r), "site", "security"),
        (K.firebase_rtdb_open(firebase, r), "site", "security"),
        (K.firebase_storage_open(firebase, r), "site", "security"),
        (K.rls_exposed(probes), "site", "security"),
        (K.rls_writable(probes, writes), "site", "security"),
        (K.graphql_introspection(r), "site", "security"),
        (_unsuppressed(spark, sf, r), "site", "web"),
        (S.scan_secrets(files), "repo", "security"),
        (R.nextjs_no_security_headers(files), "repo", "security"),
        (R.unguarded_mutation(files), "repo", "security"),
        (R.formula_injection(files), "repo", "security"),
        (R.committed_env_file(files), "repo", "security"),
        (R.migration_findings(sql, supabase_repos(spark, sf)), "repo", "security"),
        (S.site_secrets(seeds.site_pages(spark, sf), "html", "page_id"), "site", "security"),
        (S.site_secrets(r.filter((F.col("role") == "bundle") & F.col("status").between(200, 299)), "body", "hop"), "site", "security"),
        (S.secrets_in_data(probes), "site", "security"),
        (A.audit_export_findings(seeds.audit_exports(spark, sf)), "project", "security"),
    ]


def _unsuppressed(spark, sf, responses=None):
    """Web findings that the site's declaration does not silence; what it silences is not counted."""
    web = W.web_findings(_facts(spark, sf, responses=responses)).withColumn("kind", F.lit("web"))
    return C.apply_suppressions(web, _suppressions(spark, sf)).filter("suppressed_reason IS NULL")


def _findings(spark, sf):
    """The findings table, written once: a report reads it as often as it needs and runs no family again."""
    return written(P.all_findings(_families(spark, sf)), "findings")


_PARTS = [
    ("missing_headers", "site", "security"),
    ("leaky_headers", "site", "security"),
    ("plain_http_served", "site", "security"),
    ("source_map_exposed", "site", "security"),
    ("firebase_rtdb_open", "site", "security"),
    ("firebase_storage_open", "site", "security"),
    ("rls_exposed", "site", "security"),
    ("rls_writable", "site", "security"),
    ("graphql_introspection", "site", "security"),
    (None, "site", "web"),
    (None, "repo", "security"),
    ("nextjs_no_security_headers", "repo", "security"),
    ("unguarded_mutation", "repo", "security"),
    ("formula_injection", "repo", "security"),
    ("committed_env_file", "repo", "security"),
    (None, "repo", "security"),
    ("page_secrets", "site", "security"),
    ("bundle_secrets", "site", "security"),
    ("secrets_in_data", "site", "security"),
    ("audit_export_findings", "project", "security"),
]
_MIGRATIONS = [
    "tables_without_rls", "rls_turned_off", "policy_dropped", "permissive_policy", "security_definer", "grant_anon",
]


def _finding_sql() -> str:
    parts = []
    for ord_, (name, target, kind) in enumerate(_PARTS):
        if ord_ == 9:
            sources = ["""SELECT w.* FROM web_finding_rows w WHERE NOT EXISTS (
                SELECT 1 FROM suppress_rows s WHERE s.site = w.site AND s.id = w.id)"""]
        elif ord_ == 10:
            sources = ["SELECT repo, path, id, severity FROM secret_rows"]
        elif name is None:
            sources = [oracle_of(m) for m in _MIGRATIONS]
        else:
            sources = [oracle_of(name)]
        parts += [f"SELECT {target} AS target, {ord_} AS ord, id, '{kind}' AS kind, severity FROM ({s})" for s in sources]
    return " UNION ALL ".join(parts)


expression("finding_rows", _finding_sql())


@query("all_findings", "SELECT * FROM finding_rows")
def _(spark, sf):
    return _findings(spark, sf).select("target", "ord", "id", "kind", "severity")


_COUNTS = ", ".join(f"count_if(severity = '{s}') AS {s}" for s in catalog.SEVERITIES)


@query("severity_counts", f"SELECT target, kind, {_COUNTS} FROM finding_rows GROUP BY target, kind")
def _(spark, sf):
    return P.severity_counts(_findings(spark, sf))


_WORST = """SELECT target, min(CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END)
    FILTER (WHERE kind = 'security') AS worst FROM finding_rows GROUP BY target"""


@query(
    "verdict",
    f"SELECT target, CASE WHEN worst = 0 THEN 'critical' WHEN worst = 1 THEN 'high' WHEN worst >= 2 THEN 'medium' ELSE 'clean' END AS verdict FROM ({_WORST})",
)
def _(spark, sf):
    return P.verdicts(_findings(spark, sf)).select("target", "verdict")


@query("gate", f"SELECT target, coalesce(worst = 0, false) AS gate_fails FROM ({_WORST})")
def _(spark, sf):
    return P.verdicts(_findings(spark, sf)).select("target", "gate_fails")


@query(
    "findings_by_severity",
    """SELECT target, CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS rank, ord, id
    FROM finding_rows ORDER BY 1, 2, 3, 4""",
)
def _(spark, sf):
    ordered = P.findings_by_severity(_findings(spark, sf))
    return ordered.select("target", P.severity_rank(F.col("severity")).alias("rank"), "ord", "id")


@query(
    "finding_prevalence",
    """SELECT id, count(DISTINCT target) AS affected, (SELECT count(*) FROM sites) AS scanned,
    round(count(DISTINCT target) / (SELECT count(*) FROM sites), 4) AS share
    FROM finding_rows WHERE kind = 'web' GROUP BY id""",
)
def _(spark, sf):
    web = P.as_findings(_unsuppressed(spark, sf), "site", 9, "web")
    return P.prevalence(web, seeds.sites(spark, sf).select(F.col("site").alias("target")))


expression("rule_texts", values(catalog.RULES, "rule, check_no, cwe, label, why, label_es, why_es"))
_RULE_CASE = "CASE " + " ".join(f"WHEN starts_with(id, '{p}') THEN '{p}'" for p in catalog.PREFIXES) + " ELSE id END"
expression("finding_rules", f"SELECT *, {_RULE_CASE} AS rule FROM finding_rows")


@query(
    "localize_findings",
    """SELECT target, id, check_no, cwe, coalesce(label_es, label) AS label, coalesce(why_es, why) AS why
    FROM finding_rules LEFT JOIN rule_texts USING (rule)""",
)
def _(spark, sf):
    return P.localize(_findings(spark, sf), spark, "es").select("target", "id", "check_no", "cwe", "label", "why")


_LEVEL = "CASE severity " + " ".join(f"WHEN {literal(s)} THEN {literal(v)}" for s, v in catalog.SARIF_LEVEL.items()) + " END"


@query(
    "sink_sarif",
    f"""SELECT target, id AS rule_id, {_LEVEL} AS level, label || '. ' || why AS message
    FROM finding_rules LEFT JOIN rule_texts USING (rule) WHERE kind = 'security'""",
)
def _(spark, sf):
    return P.sarif_results(P.localize(_findings(spark, sf), spark)).select("target", "rule_id", "level", "message")


_RESULT = "results array<struct<ruleId:string,level:string,message:struct<text:string>>>"
_RULES = "tool struct<driver:struct<rules:array<struct<id:string>>>>"


@query(
    "sarif_documents",
    f"""SELECT target, rule_id, level, message, true AS has_rule FROM (SELECT target, id AS rule_id, {_LEVEL} AS level,
    label || '. ' || why AS message FROM finding_rules LEFT JOIN rule_texts USING (rule) WHERE kind = 'security')""",
)
def _(spark, sf):
    """The results as they stand in the documents, each with whether its run describes its rule exactly once."""
    documents = P.sarif_documents(P.localize(_findings(spark, sf), spark))
    runs = documents.select("target", F.from_json("document", f"runs array<struct<{_RULES.replace(' ', ':', 1)},{_RESULT.replace(' ', ':', 1)}>>").alias("d"))
    run = F.col("d.runs")[0]
    rules = F.transform(run["tool"]["driver"]["rules"], lambda r: r["id"])
    results = runs.select("target", rules.alias("rules"), F.explode(run["results"]).alias("r"))
    once = F.size(F.filter("rules", lambda i: i == F.col("r.ruleId"))) == 1
    return results.select(
        "target", F.col("r.ruleId").alias("rule_id"), "r.level", F.col("r.message.text").alias("message"), once.alias("has_rule")
    )


@query(
    "sink_payload",
    f"""SELECT target, 'header' AS row, NULL AS id, NULL AS severity, verdict FROM ({oracle_of("verdict")})
    UNION ALL SELECT target, 'finding', id, severity, NULL FROM finding_rows""",
)
def _(spark, sf):
    documents = P.payloads(_findings(spark, sf))
    return documents.select(
        "target", *[F.get_json_object("document", f"$.{name}").alias(name) for name in ("row", "id", "severity", "verdict")]
    )


def _sections(spark, sf, responses, web):
    """What a payload tells besides findings; ``web`` are the web findings before suppression."""
    silenced = C.apply_suppressions(web, _suppressions(spark, sf)).filter("suppressed_reason IS NOT NULL")
    rls = K.rls_rollup(K.table_probes(responses), K.write_probes(responses), K.openapi_tables(responses))
    return {
        "suppressed": silenced.select(F.col("site").alias("target"), "id", "severity", F.col("suppressed_reason").alias("reason")),
        "fingerprint": W.stack_fingerprint(seeds.site_pages(spark, sf), responses).withColumnRenamed("site", "target"),
        "rls": rls.withColumnRenamed("site", "target"),
    }


@query(
    "payload_sections",
    f"""SELECT target, row, count(*) AS n, string_agg(word, ',' ORDER BY word) AS words FROM (
    SELECT w.site AS target, 'suppressed' AS row, w.id || ': ' || s.reason AS word FROM web_finding_rows w JOIN suppress_rows s ON s.site = w.site AND s.id = w.id
    UNION ALL SELECT site, 'fingerprint', 'score ' || score FROM fingerprint_rows
    UNION ALL SELECT site, 'rls', probed || ' probed, ' || exposed || ' exposed, ' || enumerated || ' listed' FROM ({oracle_of("rls_rollup")}))
    GROUP BY ALL""",
)
def _(spark, sf):
    """The lines of the payloads' other sections, read back from the documents."""
    responses = written(captured_responses(seeds.responses(spark, sf)), "responses")
    web = W.web_findings(_facts(spark, sf, responses=responses)).withColumn("kind", F.lit("web"))
    none = P.as_findings(web.limit(0), "site", 9, "web")
    documents = P.payloads(none, _sections(spark, sf, responses, web))

    def read(name):
        return F.get_json_object("document", f"$.{name}")

    word = (
        F.when(F.col("row") == "suppressed", F.concat_ws(": ", read("id"), read("reason")))
        .when(F.col("row") == "fingerprint", F.concat(F.lit("score "), read("score")))
        .otherwise(F.concat(read("probed"), F.lit(" probed, "), read("exposed"), F.lit(" exposed, "), read("enumerated"), F.lit(" listed")))
    )
    lines = documents.withColumn("row", read("row")).withColumn("word", word)
    words = F.array_join(F.array_sort(F.collect_list("word")), ",")  # a site has few suppressions
    return lines.groupBy("target", "row").agg(F.count("*").alias("n"), words.alias("words"))
