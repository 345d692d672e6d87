"""Website checks: ids, severities, watched crawlers, host suffixes, applicability by site type."""

from __future__ import annotations

# ---- fixed values -------------------------------------------------------------------------

EMPTY_TEXT_CHARS = 200
HEAVY_BYTES = 1_048_576
FINGERPRINT_TOTAL = 12
LISTED_ASSETS = 10
LISTED_CONSOLE_ERRORS = 5
LISTED_PAGES = 8

PLATFORM_DOMAINS = [
    "vercel.app", "netlify.app", "lovable.app", "bolt.new", "pages.dev", "github.io", "web.app",
    "firebaseapp.com", "replit.app", "onrender.com", "surge.sh",
]

AI_BOTS = [
    "GPTBot", "OAI-SearchBot", "ChatGPT-User", "ClaudeBot", "anthropic-ai", "Claude-Web",
    "PerplexityBot", "CCBot", "Google-Extended", "Applebot-Extended", "Bytespider",
    "meta-externalagent",
]

# (id, severity) in report order.
WEB_CHECKS = [
    ("web_robots_blocks_ai", "high"),
    ("web_ai_block_incomplete", "medium"),
    ("web_empty_html", "high"),
    ("web_broken_assets", "high"),
    ("web_console_errors", "high"),
    ("web_duplicate_titles", "high"),
    ("web_missing_title", "high"),
    ("web_missing_meta_description", "medium"),
    ("web_missing_og", "medium"),
    ("web_missing_canonical", "medium"),
    ("web_missing_structured_data", "medium"),
    ("web_h1_structure", "medium"),
    ("web_missing_sitemap", "medium"),
    ("web_missing_llms_txt", "medium"),
    ("web_missing_lang", "medium"),
    ("web_missing_alt", "medium"),
    ("web_missing_404", "low"),
    ("web_missing_favicon", "low"),
    ("web_heavy_bundle", "low"),
]

NOT_APPLICABLE_BY_SITE_TYPE = {
    "website": [],
    "app": ["web_missing_llms_txt", "web_missing_structured_data", "web_missing_sitemap"],
    "internal": [
        "web_missing_llms_txt", "web_missing_structured_data", "web_missing_sitemap",
        "web_missing_canonical", "web_missing_og", "web_missing_meta_description",
        "web_duplicate_titles", "web_empty_html", "web_robots_blocks_ai",
    ],
}

FRAMEWORKS = [
    ("Next.js", r"/_next/", False),
    ("Nuxt", r"__NUXT__|/_nuxt/", False),
    ("SvelteKit", r"__sveltekit|/_app/immutable/", True),
    ("Gatsby", r"___gatsby|/page-data/|gatsby-chunk-mapping", True),
    ("Astro", r"astro-island|data-astro", True),
    ("Create React App", r"/static/js/main\.[0-9a-f]{6,}\.js", True),
]
VITE_ENTRY = r"/assets/index-[A-Za-z0-9_-]{6,}\.js"
REACT_ROOT = r"id=[\"']root[\"']|data-reactroot|__REACT_DEVTOOLS"

MANAGED_BEGIN = r"^#\s*BEGIN\s+Cloudflare\s+Managed\s+content"
MANAGED_END = r"^#\s*END\s+Cloudflare\s+Managed\s+content"
MANAGED_VENDOR = "Cloudflare"

NOT_A_JS_ERROR = r"^(failed to load resource|refused to (load|connect|execute|frame)|access to (fetch|xmlhttprequest|script)|net::err_|the resource .* was preloaded|mixed content|a cookie associated|error with permissions-policy|third-party cookie)"

# ---- end of fixed values ------------------------------------------------------------------

CHECK_IDS = [check for check, _ in WEB_CHECKS]
SEVERITY = dict(WEB_CHECKS)
NEEDS_BROWSER = ["web_console_errors"]

REASON_APP = "declared as an app"
REASON_INTERNAL = "declared as an internal tool"
REASON_BLOCKED = "AI crawlers are blocked on purpose"
REASON_OPEN = "no intent to block AI crawlers declared"
SITE_TYPE_REASON = {"app": REASON_APP, "internal": REASON_INTERNAL}
