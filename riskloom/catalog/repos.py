"""Queries over repository files: classes, secrets, migrations, back-end patterns."""

from __future__ import annotations


from pyspark.sql import functions as F

from riskloom.catalog import seeds
from riskloom.catalog.registry import expression, oracle_of, query
from riskloom.functions.regex import extract_all
from riskloom.operators import captures as K
from riskloom.operators import repos as R
from riskloom.operators import secrets as S
from riskloom.rules import secrets as rules
from riskloom.sources.captures import (
    SAMPLE_ENV,
    SCANNED_EXTENSIONS,
    SCANNED_NAMES,
    captured_responses,
    file_class,
    packed_tree,
    SKIPPED_DIRS,
)


def _lit(pattern: str, fold: bool = False) -> str:
    return "'" + ("(?i)" if fold else "") + pattern.replace("'", "''") + "'"


# ---- source files ---------------------------------------------------------------------------

expression(
    "file_rows",
    rf"""SELECT repo, path, content, CASE WHEN ext = '.sql' THEN 'migration'
    WHEN ext IN ({", ".join(_lit(e) for e in SCANNED_EXTENSIONS)}) OR base IN ({", ".join(_lit(n) for n in SCANNED_NAMES)})
        OR is_env THEN 'source' END AS class, is_env FROM (SELECT *,
    base = '.env' OR (starts_with(base, '.env') AND NOT regexp_matches(base, {_lit(SAMPLE_ENV, True)})) AS is_env FROM (
    SELECT *, regexp_extract(path, '([^/]*)$', 1) AS base, regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^.+(\.[^.]*)$', 1) AS ext
    FROM (SELECT repo, path, content FROM source_files UNION ALL SELECT repo, path, content FROM sql_files)))""",
)


def _all_files(spark, sf):
    columns = ["repo", "path", "content"]
    return seeds.source_files(spark, sf).select(columns).unionByName(seeds.sql_files(spark, sf).select(columns))


def _source_files(spark, sf):
    return seeds.source_files(spark, sf).filter(file_class(F.col("path")) == "source")


@query("classify_source_file", "SELECT repo, path, class FROM file_rows")
def _(spark, sf):
    return _all_files(spark, sf).select("repo", "path", file_class(F.col("path")).alias("class"))


@query(
    "scan_source_tree",
    f"""SELECT repo, path, strlen(content)::BIGINT AS size FROM file_rows
    WHERE NOT regexp_matches(path, '(^|/)({"|".join(d.replace(".", "[.]") for d in SKIPPED_DIRS)})/')""",
)
def _(spark, sf):
    """Trees packed as (repo, path, content), which keep names that start with a dot or underscore."""
    return packed_tree(_all_files(spark, sf)).select("repo", "path", "size")


@query(
    "supabase_context",
    """SELECT repo, bool_or(contains(path, 'supabase/') OR (class = 'source' AND (
    (regexp_extract(path, '([^/]*)$', 1) = 'package.json' AND contains(content, '@supabase')) OR contains(content, '.supabase.co')))) AS supabase
    FROM file_rows GROUP BY repo""",
)
def _(spark, sf):
    kept = F.when(file_class(F.col("path")) == "source", F.col("content")).otherwise("")
    return R.supabase_context(_all_files(spark, sf).withColumn("content", kept))


# ---- secrets --------------------------------------------------------------------------------

_PADDED = "translate(split_part({v}, '.', 2), '-_', '+/') || repeat('=', (4 - length(split_part({v}, '.', 2)) % 4) % 4)"


def _role(v: str) -> str:
    return f"CASE WHEN starts_with({v}, 'eyJ') THEN json_extract_string(decode(from_base64({_PADDED.format(v=v)})), '$.role') END"


def _public(v: str) -> str:
    return f"(starts_with({v}, 'sb_publishable_') OR coalesce({_role(v)} = 'anon', false))"


def _placeholder(v: str) -> str:
    return f"regexp_matches({v}, {_lit(rules.PLACEHOLDER, True)})"


def _token(v: str) -> str:
    jwt = "^" + rules.JWT.removeprefix(r"\b") + "$"
    return (
        f"(regexp_matches({v}, {_lit(jwt)}) OR (NOT contains({v}, '.') AND regexp_matches({v}, '[0-9]') "
        f"AND regexp_matches({v}, '[A-Za-z]'))) AND NOT {_placeholder(v)} AND NOT {_public(v)}"
    )


def _secret_sql(keys: str, text: str, source: str, generic: bool = True) -> str:
    parts = []
    for r in rules.RULES:
        if r.id == rules.GENERIC_ID and not generic:
            continue
        cond = "true"
        if r.id == "supabase_service_role":
            cond = f"{_role('v')} = 'service_role'"
        if r.id == rules.GENERIC_ID:
            cond = f"NOT {_placeholder('v')} AND NOT {_public('v')}"
        parts.append(
            f"SELECT {keys}, '{r.id}' AS id, v AS value, '{r.severity}' AS severity FROM (SELECT {keys}, "
            f"unnest(regexp_extract_all({text}, {_lit(r.pattern)}, {r.group})) AS v FROM {source}) WHERE {cond}"
        )
    parts.append(
        f"SELECT {keys}, 'hardcoded_bearer', v, 'high' FROM (SELECT {keys}, unnest(regexp_extract_all({text}, "
        f"{_lit(rules.BEARER_INLINE)}, 1)) AS v FROM {source}) WHERE {_token('v')}"
    )
    parts.append(
        f"""SELECT {keys}, 'hardcoded_bearer', v, 'high' FROM (SELECT {keys}, name, min(a[2]) AS v, count(DISTINCT a[2]) AS n
        FROM (SELECT {keys}, name, unnest(pairs) AS a FROM (SELECT {keys}, unnest(list_distinct(list_filter(list_concat(
            regexp_extract_all({text}, {_lit(rules.BEARER_USE)}, 1), regexp_extract_all({text}, {_lit(rules.BEARER_USE)}, 2)),
            lambda x: x <> ''))) AS name, list_zip(regexp_extract_all({text}, {_lit(rules.ASSIGNMENT)}, 1),
            regexp_extract_all({text}, {_lit(rules.ASSIGNMENT)}, 2)) AS pairs FROM {source}))
        WHERE a[1] = name GROUP BY {keys}, name) WHERE n = 1 AND {_token('v')}"""
    )
    return "SELECT DISTINCT * FROM (" + " UNION ALL ".join(parts) + ")"


expression("scanned_files", "SELECT repo, path, content FROM file_rows WHERE class = 'source'")
expression("secret_rows", _secret_sql("repo, path", "content", "scanned_files"))


@query(
    "secret_scan",
    "SELECT repo, path, id, severity, sha256(value) AS secret_sha256, left(value, 4) || '…' || right(value, 2) AS preview FROM secret_rows",
)
def _(spark, sf):
    return S.scan_secrets(_source_files(spark, sf)).select(
        "repo", "path", "id", "severity", "secret_sha256", "preview"
    )


@query(
    "secret_source_line",
    """SELECT repo, path, id, 1 + length(p) - length(replace(p, chr(10), '')) AS line FROM (SELECT s.*,
    left(f.content, instr(f.content, s.value) - 1) AS p FROM secret_rows s JOIN scanned_files f USING (repo, path))""",
)
def _(spark, sf):
    return S.scan_secrets(_source_files(spark, sf)).select("repo", "path", "id", F.col("line").cast("long"))


@query("hardcoded_bearer", "SELECT repo, path, sha256(value) AS secret_sha256 FROM secret_rows WHERE id = 'hardcoded_bearer'")
def _(spark, sf):
    return _source_files(spark, sf).select(
        "repo", "path", F.explode(S.bearer_literals(F.col("content"))).alias("v")
    ).select("repo", "path", F.sha2(F.col("v").cast("binary"), 256).alias("secret_sha256"))


@query(
    "jwt_role",
    f"""SELECT page_id, {_role('t')} AS role FROM (SELECT page_id, unnest(regexp_extract_all(html, {_lit(rules.JWT)})) AS t FROM site_pages)""",
)
def _(spark, sf):
    return seeds.site_pages(spark, sf).select(
        "page_id", F.explode(extract_all(F.col("html"), rules.JWT, 0, False)).alias("t")
    ).select("page_id", S.jwt_role(F.col("t")).alias("role"))


@query(
    "secret_placeholder_filter",
    f"""SELECT repo, path, sha256(v) AS secret_sha256, {_placeholder('v')} AS placeholder, {_public('v')} AS public_key
    FROM (SELECT repo, path, unnest(regexp_extract_all(content, {_lit("(?i)" + rules.GENERIC)}, 1)) AS v FROM scanned_files)""",
)
def _(spark, sf):
    v = F.col("v")
    return _source_files(spark, sf).select(
        "repo", "path", F.explode(extract_all(F.col("content"), "(?i)" + rules.GENERIC, 1, False)).alias("v")
    ).select(
        "repo",
        "path",
        F.sha2(v.cast("binary"), 256).alias("secret_sha256"),
        S.is_placeholder(v).alias("placeholder"),
        S.is_public_key(v).alias("public_key"),
    )


expression("crawled", "SELECT site, page_id, url, html FROM site_pages WHERE page_id NOT IN (SELECT page_id FROM homes)")
expression("home_docs", "SELECT site, page_id, url, html FROM site_pages JOIN homes USING (site, page_id)")
expression("crawl_secret_rows", _secret_sql("site, page_id, url", "html", "crawled"))
expression("home_secret_rows", _secret_sql("site, page_id, url", "html", "home_docs"))


@query(
    "secrets_new_in_crawl",
    """SELECT site, id, sha256(value) AS secret_sha256, arg_min(url, page_id) AS source FROM crawl_secret_rows c
    WHERE NOT EXISTS (SELECT 1 FROM home_secret_rows h WHERE h.site = c.site AND h.id = c.id AND h.value = c.value)
    AND url NOT IN (SELECT url FROM home_docs) GROUP BY site, id, value""",
)
def _(spark, sf):
    pages = seeds.site_pages(spark, sf)
    homes = pages.groupBy("site").agg(F.min_by("url", F.col("page_id")).alias("url"), F.min("page_id").alias("page_id"))
    hits = S.scan_secrets(pages.select("site", "page_id", "html"), "html", with_line=False)
    first_pass = hits.join(homes.select("site", "page_id"), ["site", "page_id"])  # one home a site
    return S.secrets_new_in_crawl(pages, homes, first_pass)


expression("page_secret_rows", _secret_sql("site, page_id, url", "html", "site_pages"))
expression("bundle_bodies", "SELECT site, hop, url, body FROM responses WHERE role = 'bundle' AND status BETWEEN 200 AND 299")
expression("bundle_secret_rows", _secret_sql("site, hop, url", "body", "bundle_bodies"))


@query(
    "page_secrets",
    """SELECT site, id, severity, arg_min(url, page_id) AS source, sha256(value) AS secret_sha256
    FROM page_secret_rows GROUP BY site, id, severity, value""",
)
def _(spark, sf):
    return S.site_secrets(seeds.site_pages(spark, sf), "html", "page_id")


@query(
    "bundle_secrets",
    """SELECT site, id, severity, arg_min(url, {'hop': hop, 'url': url}) AS source, sha256(value) AS secret_sha256
    FROM bundle_secret_rows GROUP BY site, id, severity, value""",
)
def _(spark, sf):
    return S.site_secrets(_bundles(spark, sf), "body", "hop")


def _bundles(spark, sf):
    answered = (F.col("role") == "bundle") & F.col("status").between(200, 299)
    return captured_responses(seeds.responses(spark, sf, ["bundle"])).filter(answered)


expression("readable_rows", "SELECT site, source, body FROM probe_rows WHERE readable")
expression("data_secret_rows", _secret_sql("site, source", "body", "readable_rows", generic=False))


@query(
    "secrets_in_data",
    "SELECT site, source, 'data_' || id AS id, severity, sha256(value) AS secret_sha256 FROM data_secret_rows",
)
def _(spark, sf):
    probes = K.table_probes(captured_responses(seeds.responses(spark, sf, ["table"])))
    return S.secrets_in_data(probes).select("site", "source", "id", "severity", "secret_sha256")


@query(
    "supabase_config",
    f"""SELECT page_id, project_url, CASE WHEN anon IS NOT NULL THEN 'anon-jwt' WHEN pub <> '' THEN 'publishable' END AS key_kind,
    sha256(coalesce(anon, nullif(pub, ''))) AS key_sha256 FROM (SELECT page_id, regexp_extract(html, {_lit(rules.SUPABASE_URL)}) AS project_url,
    list_filter(regexp_extract_all(html, {_lit(rules.JWT)}), lambda t: {_role('t')} = 'anon')[1] AS anon,
    regexp_extract(html, {_lit(rules.SUPABASE_PUBLISHABLE)}) AS pub FROM site_pages) WHERE project_url <> ''""",
)
def _(spark, sf):
    return (
        seeds.site_pages(spark, sf)
        .select("page_id", S.supabase_config(F.col("html")).alias("c"))
        .filter(F.col("c").isNotNull())
        .select("page_id", "c.project_url", "c.key_kind", F.sha2(F.col("c.anon_key").cast("binary"), 256).alias("key_sha256"))
    )


# ---- migrations -----------------------------------------------------------------------------


def _located(pattern: str, groups: int) -> str:
    """One row per match: m, g1.., line, k. Lines come from newlines before each match."""
    p = _lit(pattern, True)
    cols = "".join(f", regexp_extract_all(content, {p}, {g})[i] AS g{g}" for g in range(1, groups + 1))
    return f"""SELECT repo, seq, path, i - 1 AS k, regexp_extract_all(content, {p})[i] AS m{cols},
    1 + length(head) - length(replace(head, chr(10), '')) AS line FROM (SELECT *,
    array_to_string(regexp_split_to_array(content, {p})[1:i], '') || array_to_string(regexp_extract_all(content, {p})[1:i - 1], '') AS head
    FROM (SELECT *, unnest(range(1, len(regexp_extract_all(content, {p})) + 1)) AS i FROM sql_files))"""


# A repetition of 240 any-characters is written as is: RE2 allows counts up to 1000.
for _name, _pattern, _groups in [
    ("disable_rows", R.DISABLE_RLS, 1),
    ("drop_policy_rows", R.DROP_POLICY, 1),
    ("permissive_rows", R.PERMISSIVE_POLICY, 0),
    ("definer_rows", R.SECURITY_DEFINER, 0),
    ("grant_rows", R.GRANT_ANON, 3),
    ("create_rows", R.CREATE_TABLE, 1),
    ("enable_rows", R.ENABLE_RLS, 1),
]:
    expression(_name, _located(_pattern, _groups))

_FLAT = "regexp_replace(m, '\\s+', ' ', 'g')"
MIGRATION_SQL = {
    "rls_turned_off": f"SELECT repo, 'rls_turned_off_' || lower(g1) AS id, 'critical' AS severity, path, line, {_FLAT} AS evidence FROM disable_rows",
    "policy_dropped": f"SELECT repo, 'policy_dropped_' || lower(g1) AS id, 'medium' AS severity, path, line, {_FLAT} AS evidence FROM drop_policy_rows",
    "permissive_policy": f"SELECT repo, 'permissive_policy' AS id, 'critical' AS severity, path, line, left({_FLAT}, 120) AS evidence FROM permissive_rows",
    "security_definer": "SELECT repo, 'security_definer' AS id, 'medium' AS severity, path, line, 'SECURITY DEFINER' AS evidence FROM definer_rows",
    "grant_anon": f"SELECT repo, 'grant_anon_' || lower(g2) AS id, CASE WHEN regexp_matches(g1, '(?i)\\b(insert|update|delete|all)\\b') THEN 'high' ELSE 'medium' END AS severity, path, line, left({_FLAT}, 120) AS evidence FROM grant_rows",
    "tables_without_rls": f"""SELECT repo, 'rls_disabled_' || t AS id, 'high' AS severity, arg_min(path, seq * 1000 + k) AS path,
        arg_min(line, seq * 1000 + k) AS line, 'no ENABLE ROW LEVEL SECURITY for this table in the repository' AS evidence
        FROM (SELECT *, lower(g1) AS t FROM create_rows) c
        WHERE NOT EXISTS (SELECT 1 FROM enable_rows e WHERE e.repo = c.repo AND lower(e.g1) = c.t)
        AND repo IN (SELECT repo FROM sql_files WHERE regexp_matches(content, {_lit(R.RLS_MODEL, True)})
            UNION ALL SELECT repo FROM ({oracle_of("supabase_context")}) WHERE supabase) GROUP BY repo, t""",
}
_JOBS = {
    "rls_turned_off": R.rls_turned_off,
    "policy_dropped": R.policy_dropped,
    "permissive_policy": R.permissive_policy,
    "security_definer": R.security_definer,
    "grant_anon": R.grant_anon,
    "tables_without_rls": R.tables_without_rls,
}


def supabase_repos(spark, sf):
    """Repositories that use Supabase by their files, whether or not a migration shows it."""
    kept = F.when(file_class(F.col("path")) == "source", F.col("content")).otherwise("")
    return R.supabase_context(_all_files(spark, sf).withColumn("content", kept)).filter("supabase")


def _register(name: str) -> None:
    @query(name, MIGRATION_SQL[name])
    def _(spark, sf):
        gate = [supabase_repos(spark, sf)] if name == "tables_without_rls" else []
        return _JOBS[name](seeds.sql_files(spark, sf), *gate)


for _name in _JOBS:
    _register(_name)


@query("create_table_events", "SELECT repo, seq, k AS pos, lower(g1) AS table_name, path, line FROM create_rows")
def _(spark, sf):
    return R.create_table_events(seeds.sql_files(spark, sf))


@query("enable_rls_events", "SELECT repo, lower(g1) AS table_name, path, line FROM enable_rows")
def _(spark, sf):
    return R.enable_rls_events(seeds.sql_files(spark, sf))


# ---- back-end patterns ----------------------------------------------------------------------


def _has(text: str, pattern: str, fold: bool) -> str:
    return f"regexp_matches({text}, {_lit(pattern, fold)})"


_PATH_ID = "regexp_replace(path, '[^A-Za-z0-9]', '_', 'g')"
BACKEND_SQL = {
    "nextjs_no_security_headers": f"SELECT repo, 'nextjs_no_security_headers' AS id, 'medium' AS severity, path FROM scanned_files WHERE {_has('path', R.NEXT_CONFIG, False)} AND NOT {_has('content', R.HEADERS_CALL, False)} AND NOT {_has('content', R.HEADER_NAMES, True)}",
    "unguarded_mutation": f"SELECT repo, 'unguarded_mutation_' || {_PATH_ID} AS id, 'high' AS severity, path FROM scanned_files WHERE ({_has('path', R.ROUTE_HANDLER, False)} OR {_has('content', R.SERVER_ACTION, False)}) AND ({_has('content', R.MUTATION_CALL, True)} OR {_has('content', R.MUTATION_SQL, True)}) AND NOT {_has('content', R.AUTH_GUARD, True)}",
    "formula_injection": f"SELECT repo, 'formula_injection_' || {_PATH_ID} AS id, 'medium' AS severity, path FROM scanned_files WHERE {_has('content', R.SPREADSHEET, True)} AND {_has('content', R.SHEET_WRITE, False)} AND NOT {_has('content', R.SHEET_SAFE, True)}",
    "committed_env_file": "SELECT repo, 'committed_env_file' AS id, 'high' AS severity, path FROM file_rows WHERE is_env",
}
_BACKEND = {
    "nextjs_no_security_headers": R.nextjs_no_security_headers,
    "unguarded_mutation": R.unguarded_mutation,
    "formula_injection": R.formula_injection,
    "committed_env_file": R.committed_env_file,
}


def _register_backend(name: str) -> None:
    @query(name, BACKEND_SQL[name])
    def _(spark, sf):
        return _BACKEND[name](_source_files(spark, sf))


for _name in _BACKEND:
    _register_backend(_name)
