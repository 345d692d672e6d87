"""One row per rule: checklist item, weakness class and reader-facing text in two languages."""

from __future__ import annotations

# ---- fixed values -------------------------------------------------------------------------

SEVERITIES = ["critical", "high", "medium", "low"]
SARIF_LEVEL = {"critical": "error", "high": "error", "medium": "warning", "low": "note"}
VERDICT_CLEAN = "clean"

# Ids that carry a table, path, header or file name after the rule.
PREFIXES = [
    "rls_turned_off_", "policy_dropped_", "grant_anon_", "rls_disabled_", "rls_exposed_",
    "rls_writable_", "unguarded_mutation_", "formula_injection_", "sourcemap_exposed_",
    "missing_header_", "leaky_header_", "data_",
]

# ---- end of fixed values ------------------------------------------------------------------

# (rule, checklist item, weakness, label, why, Spanish label, Spanish why); null falls back.
RULES: list[tuple[str, int | None, str | None, str, str, str | None, str | None]] = [
    ("rls_turned_off_", 6, "CWE-863", "Row level security switched off", "Policies of the table stop applying.", "Seguridad por filas apagada", "Las políticas de la tabla dejan de aplicarse."),
    ("policy_dropped_", 6, "CWE-863", "Policy dropped", "Check what still grants access to the table.", "Política eliminada", "Revisa qué concede acceso a la tabla."),
    ("permissive_policy", 7, "CWE-863", "Policy lets everyone in", "A condition that is always true protects nothing.", "La política deja pasar a todos", "Una condición siempre cierta no protege nada."),
    ("security_definer", 10, "CWE-269", "Function runs with its owner's rights", "It bypasses the caller's policies.", "La función usa los permisos de su dueño", None),
    ("grant_anon_", 6, "CWE-863", "Rights granted to anonymous callers", "Anyone with the public key holds this role.", "Permisos para llamadas anónimas", None),
    ("rls_disabled_", 6, "CWE-863", "Table without row level security", "The public API can read its rows.", "Tabla sin seguridad por filas", "La API pública puede leer sus filas."),
    ("rls_exposed_", 6, "CWE-863", "Table readable without signing in", "Rows were returned with the public key alone.", "Tabla legible sin iniciar sesión", "Se devolvieron filas solo con la clave pública."),
    ("rls_writable_", 6, "CWE-862", "Table writable without signing in", "An unauthenticated write was accepted.", "Tabla escribible sin iniciar sesión", None),
    ("graphql_introspection", 23, "CWE-200", "Schema readable by anyone", "The type graph maps the whole data model.", "Esquema legible por cualquiera", None),
    ("firebase_rtdb_open", 6, "CWE-863", "Realtime database readable by anyone", "A shallow read needed no sign-in.", "Base en tiempo real legible por cualquiera", None),
    ("firebase_storage_open", 6, "CWE-863", "Storage bucket can be listed", "Every uploaded file can be found.", "El bucket se puede listar", None),
    ("nextjs_no_security_headers", 22, "CWE-693", "Framework config sends no security headers", "Framing and injected scripts meet no defence.", "La configuración no envía cabeceras de seguridad", None),
    ("unguarded_mutation_", 11, "CWE-862", "Data changed without an authorization check", "Verify the caller on the server.", "Cambia datos sin comprobar autorización", "Verifica en el servidor a quien llama."),
    ("formula_injection_", 16, "CWE-1236", "Export may carry formulas", "A cell starting with = runs when opened.", "La exportación puede llevar fórmulas", None),
    ("committed_env_file", 3, "CWE-540", "Environment file in the tree", "Its values belong in the host's settings.", None, None),
    ("missing_header_", 22, None, "Security header missing", "The browser falls back to its weaker default.", "Falta una cabecera de seguridad", None),
    ("leaky_header_", 23, "CWE-200", "Header names the technology", "Versions lead to known weaknesses.", "La cabecera revela la tecnología", None),
    ("plain_http_no_redirect", 22, "CWE-319", "Served over plain HTTP", "The page can be read and changed in transit.", "Se sirve por HTTP sin cifrar", None),
    ("sourcemap_exposed_", 23, "CWE-540", "Source map served", "The original source can be downloaded.", "Mapa de fuentes servido", None),
    ("data_", 6, "CWE-798", "Credential inside readable rows", "Whoever reads the table holds the key.", "Credencial dentro de filas legibles", None),
    *[
        (rule, 1, "CWE-798", "Credential in code", "Whoever reads the file holds the key.", "Credencial en el código", None)
        for rule in (
            "supabase_service_role", "supabase_secret_key", "stripe_secret", "stripe_test_secret",
            "openai_key", "anthropic_key", "google_api_key", "aws_access_key", "github_token",
            "slack_token", "db_connection_string", "resend_key", "sendgrid_key", "twilio_key",
            "private_key", "generic_secret_assign", "hardcoded_bearer",
        )
    ],
    ("web_robots_blocks_ai", None, None, "Crawlers of AI assistants are shut out", "The site cannot be quoted in answers.", "Rastreadores de asistentes bloqueados", None),
    ("web_ai_block_incomplete", None, None, "Declared block has gaps", "Some crawlers still read the site.", "El bloqueo declarado tiene huecos", None),
    ("web_empty_html", None, None, "Page carries no text", "Readers without scripts see nothing.", "La página no trae texto", "Quien no ejecuta scripts no ve nada."),
    ("web_broken_assets", None, None, "Referenced files fail", "Visitors see missing parts.", "Ficheros referenciados fallan", None),
    ("web_console_errors", None, None, "Scripts throw errors", "Something is broken for every visitor.", "Los scripts lanzan errores", None),
    ("web_duplicate_titles", None, None, "One title on every page", "The pages compete with each other.", "Un mismo título en todas las páginas", None),
    ("web_missing_title", None, None, "No title", "Search results show a made-up headline.", "Sin título", None),
    ("web_missing_meta_description", None, None, "No description", "Search results quote arbitrary text.", "Sin descripción", None),
    ("web_missing_og", None, None, "No sharing preview", "Shared links show as bare addresses.", "Sin vista previa al compartir", None),
    ("web_missing_canonical", None, None, "No canonical address", "Copies of the page split its weight.", "Sin dirección canónica", None),
    ("web_missing_structured_data", None, None, "No structured data", "Engines guess what the page is about.", "Sin datos estructurados", None),
    ("web_h1_structure", None, None, "Main heading missing or repeated", "The topic of the page is unclear.", "Encabezado principal ausente o repetido", None),
    ("web_missing_sitemap", None, None, "No sitemap", "Unlinked pages stay unseen.", "Sin mapa del sitio", None),
    ("web_missing_llms_txt", None, None, "No llms.txt", "Assistants piece the offer together.", "Sin llms.txt", None),
    ("web_missing_lang", None, None, "No language declared", "Readers and translators guess.", "Sin idioma declarado", None),
    ("web_missing_alt", None, None, "Images without a text", "Screen readers have nothing to say.", "Imágenes sin texto", None),
    ("web_missing_404", None, None, "Unknown addresses answer", "Engines index pages that do not exist.", "Direcciones inexistentes responden", None),
    ("web_missing_favicon", None, None, "No icon", "Tabs and bookmarks show a blank.", "Sin icono", None),
    ("web_heavy_bundle", None, None, "Heavy scripts", "Phones show a blank page for seconds.", "Scripts pesados", None),
]
SCHEMA = "rule string, check_no int, cwe string, label string, why string, label_es string, why_es string"
