"""Queries over captured responses: headers, transport, source maps, backends."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.catalog import seeds
from riskloom.catalog.registry import expression, query
from riskloom.operators import captures as K
from riskloom.sources.captures import captured_responses


def _responses(spark, sf, roles):
    return captured_responses(seeds.responses(spark, sf, roles))


@query(
    "scan_responses",
    """SELECT site, role, hop, url, status, location, coalesce(strlen(body), 0) AS body_bytes,
    json_extract_string(headers, '$."Server"') AS server FROM responses""",
)
def _(spark, sf):
    return captured_responses(seeds.responses(spark, sf)).select(
        "site",
        "role",
        "hop",
        "url",
        "status",
        "location",
        F.coalesce(F.octet_length("body"), F.lit(0)).cast("long").alias("body_bytes"),
        F.try_element_at("headers", F.lit("server")).alias("server"),
    )


_HEADERS = ", ".join(
    f"('{h}', '{s}', '{c}', '{n}')"
    for (h, s, c), n in zip(
        K.EXPECTED_HEADERS,
        ["Content-Security-Policy", "Strict-Transport-Security", "X-Frame-Options", "X-Content-Type-Options"],
    )
)


@query(
    "missing_headers",
    f"""SELECT site, 'missing_header_' || h AS id, severity, cwe FROM responses
    CROSS JOIN (VALUES {_HEADERS}) AS e(h, severity, cwe, shown) WHERE role = 'home'
    AND coalesce(json_extract_string(headers, '$."' || shown || '"'), '') = ''""",
)
def _(spark, sf):
    return K.missing_headers(_responses(spark, sf, ["home"]))


expression(
    "leaky_rows",
    """SELECT site, key, value FROM (SELECT site, unnest(['X-Powered-By', 'Server']) AS key, headers FROM responses WHERE role = 'home'),
    LATERAL (SELECT json_extract_string(headers, '$."' || key || '"') AS value)
    WHERE coalesce(value, '') <> '' AND lower(value) NOT IN ('cloudflare', 'vercel')""",
)


@query(
    "leaky_headers",
    """SELECT site, 'leaky_header_' || lower(key) AS id, 'low' AS severity, lower(key) || ': ' || value AS evidence FROM leaky_rows""",
)
def _(spark, sf):
    return K.leaky_headers(_responses(spark, sf, ["home"]))


expression(
    "hop_rows",
    """SELECT site, url, coalesce(verdict, 'served') AS verdict, CASE WHEN verdict IS NULL THEN 0 ELSE status END AS status, redirects FROM (
    WITH RECURSIVE answers AS (SELECT site, url, min({'s': status, 'l': location}) AS a FROM responses WHERE role = 'plain_http' GROUP BY ALL),
    steps AS (
      SELECT site, url, url AS at, 0 AS redirects, NULL::VARCHAR AS verdict, 0 AS status FROM answers WHERE url = 'http://' || site || '/'
      UNION ALL
      SELECT s.site, s.url, a.a.l, s.redirects + CASE WHEN a.a.s BETWEEN 300 AND 399 AND a.a.l <> '' AND NOT starts_with(a.a.l, 'https://') THEN 1 ELSE 0 END,
        CASE WHEN a.a.s BETWEEN 300 AND 399 AND a.a.l <> '' THEN CASE WHEN starts_with(a.a.l, 'https://') THEN 'upgraded' END
            WHEN coalesce(a.a.s, 0) = 0 OR a.a.s >= 400 THEN 'unavailable' ELSE 'served' END, coalesce(a.a.s, 0)
      FROM steps s LEFT JOIN answers a ON a.site = s.site AND a.url = s.at WHERE s.verdict IS NULL AND s.redirects < 3)
    SELECT * FROM steps QUALIFY row_number() OVER (PARTITION BY site, url ORDER BY redirects DESC, verdict IS NOT NULL DESC) = 1)""",
)


@query("redirect_hops", "SELECT * FROM hop_rows")
def _(spark, sf):
    return K.redirect_hops(_responses(spark, sf, ["plain_http"]))


@query(
    "plain_http_served",
    """SELECT site, 'plain_http_no_redirect' AS id, 'medium' AS severity, url AS source, status, redirects
    FROM hop_rows WHERE verdict = 'served'""",
)
def _(spark, sf):
    return K.plain_http_served(_responses(spark, sf, ["plain_http"]))


expression(
    "map_rows",
    r"""SELECT b.site, b.rank, b.map_url, m.embeds FROM (SELECT site, rank, regexp_extract(url, '^(.*/)', 1) || ref AS map_url
    FROM (SELECT site, rank, url, regexp_extract(body, '//[#@]\s*sourceMappingURL=([^\s''"]+)', 1) AS ref FROM bundle_rank_rows)
    WHERE ref <> '' AND NOT starts_with(ref, 'data:')) b
    JOIN (SELECT DISTINCT site, url AS map_url, regexp_matches(body, '"sourcesContent"\s*:\s*\[') AS embeds FROM responses
    WHERE role = 'sourcemap' AND status BETWEEN 200 AND 299 AND regexp_matches(body, '"(?:mappings|sources)"\s*:')) m
    USING (site, map_url)""",
)


@query(
    "source_map_exposed",
    """SELECT site, 'sourcemap_exposed_' || regexp_replace(regexp_extract(m, '([^/]*)$', 1), '[^A-Za-z0-9]', '_', 'g') AS id,
    'medium' AS severity, m AS source, e AS embeds_source
    FROM (SELECT site, arg_min(map_url, rank) AS m, arg_min(embeds, rank) AS e FROM map_rows GROUP BY site)""",
)
def _(spark, sf):
    return K.source_map_exposed(_responses(spark, sf, ["bundle", "sourcemap"]))


@query(
    "shared_source_maps",
    """SELECT file_name, sites FROM (SELECT regexp_extract(map_url, '([^/]*)$', 1) AS file_name, count(DISTINCT site) AS sites
    FROM map_rows GROUP BY 1) WHERE sites > 1""",
)
def _(spark, sf):
    return K.shared_source_maps(_responses(spark, sf, ["bundle", "sourcemap"]))


def _sql_group(pattern: str) -> str:
    return "nullif(regexp_extract(html, '(?i)" + pattern.replace("\\\"", '"').replace("'", "''") + "', 1), '')"


expression(
    "firebase_rows",
    f"""SELECT site, page_id, project_id, database_url, storage_bucket FROM (SELECT site, page_id,
    {_sql_group(K.FIREBASE_PROJECT)} AS project_id, {_sql_group(K.FIREBASE_DATABASE)} AS database_url,
    {_sql_group(K.FIREBASE_BUCKET)} AS storage_bucket FROM site_pages
    WHERE regexp_matches(html, '{K.FIREBASE_KEY}')) WHERE coalesce(project_id, database_url, storage_bucket) IS NOT NULL""",
)


@query("firebase_config", "SELECT * FROM firebase_rows")
def _(spark, sf):
    return (
        seeds.site_pages(spark, sf)
        .select("site", "page_id", K.firebase_config(F.col("html")).alias("c"))
        .filter(F.col("c").isNotNull())
        .select("site", "page_id", "c.*")
    )


def _first_firebase(spark, sf):
    """The first configuration of a site in page order; documents stay behind the projection."""
    return (
        seeds.site_pages(spark, sf)
        .select("site", "page_id", K.firebase_config(F.col("html")).alias("config"))
        .filter(F.col("config").isNotNull())
        .groupBy("site")
        .agg(F.min_by("config", F.col("page_id")).alias("config"), F.min("page_id").alias("page_id"))
    )


expression(
    "first_firebase_rows",
    """SELECT * FROM firebase_rows f WHERE page_id = (SELECT min(page_id) FROM firebase_rows g WHERE g.site = f.site)""",
)


@query("first_config_wins", "SELECT site, page_id, project_id FROM first_firebase_rows")
def _(spark, sf):
    return _first_firebase(spark, sf).select("site", "page_id", F.col("config.project_id").alias("project_id"))


@query(
    "firebase_rtdb_open",
    """SELECT site, 'firebase_rtdb_open' AS id, CASE WHEN arg_min(empty, rank) THEN 'high' ELSE 'critical' END AS severity,
    arg_min(base, rank) || '/.json' AS source FROM (
    SELECT f.site, b.rank, b.base, trim(r.body) = 'null' AS empty FROM first_firebase_rows f, LATERAL (
        SELECT 0 AS rank, 'https://' || project_id || '-default-rtdb.firebaseio.com' AS base
        UNION ALL SELECT 1, 'https://' || project_id || '.firebaseio.com') b
    JOIN responses r ON r.site = f.site AND r.role = 'rtdb' AND r.url = b.base || '/.json?shallow=true'
    WHERE r.status BETWEEN 200 AND 299 AND NOT contains(r.body, '"error"')) GROUP BY site""",
)
def _(spark, sf):
    return K.firebase_rtdb_open(_first_firebase(spark, sf), _responses(spark, sf, ["rtdb"]))


@query(
    "firebase_storage_open",
    """SELECT site, 'firebase_storage_open' AS id, 'high' AS severity,
    'firebasestorage.googleapis.com/v0/b/' || storage_bucket || '/o' AS source FROM first_firebase_rows
    WHERE storage_bucket IS NOT NULL AND EXISTS (SELECT 1 FROM responses r WHERE r.site = first_firebase_rows.site
    AND r.role = 'storage' AND r.status = 200 AND contains(r.url, '/b/' || storage_bucket || '/o'))""",
)
def _(spark, sf):
    return K.firebase_storage_open(_first_firebase(spark, sf), _responses(spark, sf, ["storage"]))


@query(
    "graphql_introspection",
    """SELECT site, 'graphql_introspection' AS id, 'medium' AS severity, url AS source FROM responses WHERE role = 'graphql'
    AND status BETWEEN 200 AND 299 AND (contains(body, '"__schema"') OR contains(body, '"queryType"')) AND regexp_matches(body, '"data"\\s*:')""",
)
def _(spark, sf):
    return K.graphql_introspection(_responses(spark, sf, ["graphql"]))


expression(
    "openapi_docs",
    "SELECT site, json(body) AS doc FROM (SELECT site, CASE WHEN json_valid(body) THEN body END AS body FROM responses WHERE role = 'openapi')",
)
expression(
    "openapi_rows",
    """SELECT site, table_name FROM (SELECT site, unnest(json_keys(doc, '$.definitions')) AS table_name FROM openapi_docs
    UNION SELECT site, regexp_replace(p, '^/', '') FROM (SELECT site, unnest(json_keys(doc, '$.paths')) AS p FROM openapi_docs))
    WHERE table_name <> '' AND NOT contains(table_name, '/')""",
)


@query("openapi_tables", "SELECT * FROM openapi_rows")
def _(spark, sf):
    return K.openapi_tables(_responses(spark, sf, ["openapi"]))


@query(
    "table_name_union",
    """SELECT site, table_name, list_contains(json_keys(doc, '$.definitions'), table_name) AS defined,
    list_contains(json_keys(doc, '$.paths'), '/' || table_name) AS has_path FROM openapi_rows JOIN openapi_docs USING (site)""",
)
def _(spark, sf):
    body = F.col("body")
    keys = {
        "_d": F.json_object_keys(F.get_json_object(body, "$.definitions")),
        "_p": F.json_object_keys(F.get_json_object(body, "$.paths")),
    }
    return (
        _responses(spark, sf, ["openapi"])
        .withColumns(keys)
        .select("site", F.explode(K.openapi_table_names(body)).alias("table_name"), "_d", "_p")
        .select(
            "site",
            "table_name",
            F.array_contains("_d", F.col("table_name")).alias("defined"),
            F.array_contains("_p", F.concat(F.lit("/"), "table_name")).alias("has_path"),
        )
    )


_SENSITIVE = "|".join(K.SENSITIVE_COLUMNS)
expression(
    "probe_rows",
    rf"""SELECT site, table_name, source, outcome, first IS NOT NULL AS readable, rows_total,
    coalesce(len(json_keys(first)), 0) AS n_columns, body, coalesce(list_filter(json_keys(first), lambda k: regexp_matches(lower(k), '{_SENSITIVE}')), []) AS leaked
    FROM (SELECT site, regexp_extract(url, '/rest/v1/([^/?]+)', 1) AS table_name, regexp_replace(url, '\?.*$', '') AS source,
    CASE status WHEN 0 THEN 'error' WHEN 200 THEN 'exposed' WHEN 404 THEN 'absent' ELSE 'protected' END AS outcome,
    CASE WHEN status = 200 THEN json_extract(body, '$[0]') END AS first, body,
    CASE WHEN status = 200 THEN try_cast(split_part(json_extract_string(headers, '$."Content-Range"'), '/', 2) AS BIGINT) END AS rows_total
    FROM responses WHERE role = 'table')""",
)
expression(
    "write_rows",
    """SELECT site, regexp_extract(url, '/rest/v1/([^/?]+)', 1) AS table_name, CASE WHEN status IN (401, 403) THEN 'blocked'
    WHEN status BETWEEN 200 AND 299 THEN 'writable' ELSE 'inconclusive' END AS write FROM responses WHERE role = 'write'""",
)


def _probes(spark, sf):
    return K.table_probes(_responses(spark, sf, ["table"]))


@query(
    "classify_table_probe",
    "SELECT site, table_name, outcome, readable, rows_total, n_columns, array_to_string(leaked, ',') AS leaked FROM probe_rows",
)
def _(spark, sf):
    return _probes(spark, sf).select(
        "site", "table_name", "outcome", "readable", "rows_total", "n_columns", F.array_join("leaked_columns", ",").alias("leaked")
    )


@query("classify_write_probe", "SELECT site, table_name, write FROM write_rows")
def _(spark, sf):
    return K.write_probes(_responses(spark, sf, ["write"]))


@query("leaked_columns", "SELECT site, table_name, unnest(leaked) AS column_name FROM probe_rows")
def _(spark, sf):
    return _probes(spark, sf).select("site", "table_name", F.explode("leaked_columns").alias("column_name"))


@query(
    "rls_exposed",
    """SELECT site, 'rls_exposed_' || table_name AS id, CASE WHEN len(leaked) > 0 THEN 'critical' ELSE 'high' END AS severity, source,
    coalesce(rows_total::VARCHAR, '?') || ' rows readable with the public key' || CASE WHEN len(leaked) > 0
    THEN '; sensitive columns: ' || array_to_string(leaked, ', ') ELSE '' END AS evidence FROM probe_rows WHERE readable""",
)
def _(spark, sf):
    return K.rls_exposed(_probes(spark, sf))


@query(
    "rls_writable",
    """SELECT site, 'rls_writable_' || table_name AS id, 'critical' AS severity, source FROM probe_rows JOIN write_rows USING (site, table_name)
    WHERE readable AND write = 'writable'""",
)
def _(spark, sf):
    return K.rls_writable(_probes(spark, sf), K.write_probes(_responses(spark, sf, ["write"])))


@query(
    "rls_rollup",
    """SELECT p.*, coalesce(e.enumerated, 0) AS enumerated FROM (SELECT site, count(*) AS probed, count_if(readable) AS exposed,
    count_if(readable AND len(leaked) > 0) AS with_pii, count_if(readable AND coalesce(write = 'writable', false)) AS writable
    FROM probe_rows LEFT JOIN write_rows USING (site, table_name) GROUP BY site) p
    LEFT JOIN (SELECT site, count(*) AS enumerated FROM openapi_rows GROUP BY site) e USING (site)""",
)
def _(spark, sf):
    r = _responses(spark, sf, ["table", "write", "openapi"])
    return K.rls_rollup(K.table_probes(r), K.write_probes(r), K.openapi_tables(r))
