"""Verb and noun tables per language. Edit these lists to extend every rule at once.

Entries are pattern fragments. A verb entry is a stem and matches any further letters; an entry
ending in ``$`` is an exact form, for stems that would swallow words of another language.
"""

from __future__ import annotations

LANGS = ("en", "es", "pt")

# ---- fixed values -------------------------------------------------------------------------

VERBS: dict[str, dict[str, list[str]]] = {
    "en": {
        "weaken": [
            "disabl", r"turn\s*off", r"switch\s*off", "remov", "delet", "skip", "skipp", "bypass",
            r"get\s+rid\s+of", r"comment\s*out", r"strip\s+out", "drop",
        ],
        "expose": ["expos", "publish", "leak", r"open\s+up", "ship"],
        "place": [r"hard[-\s]?cod", "paste", "inlin", "embed"],
        "ship": ["commit", "push", "upload", r"check\s+in"],
        "emit": ["log", "print", r"console\.log", "dump"],
        "allow": ["allow", "permit", "grant", "enabl"],
    },
    "es": {
        "weaken": [
            "desactiv", "desabilit", "deshabilit", "quita", "quitar", "quite$", "apag", "elimin",
            "s[áa]ltate", "omit", "anul", "desconect", "coment",
        ],
        "expose": ["expon", "expong", "public", "filtr", "abra", "abrir"],
        "place": [
            "pon$", "ponga", "poner", "pone$", "mete$", "meter", "pega", "pegar", "incrust",
            "hardcode",
        ],
        "ship": ["sube", "subir", "commit", "push"],
        "emit": ["imprim", "muestr", "log", r"console\.log"],
        "allow": ["permit", "habilit", "otorg"],
    },
    "pt": {
        "weaken": [
            "desativ", "desabilit", "remov", "tira", "tirar", "pula", "pule$", "pular",
            "desli[gq]", "ignor", "apag", "exclui", "excluir", "exclua", "coment", "burl",
        ],
        "expose": ["exponha", "expor", "exp[õ]e$", "public", "vaz", "abra", "abrir"],
        "place": ["coloc", "p[õ]e$", "ponha", "incorpor", "hardcode"],
        "ship": ["suba$", "sube$", "subir", "envia", "enviar", "envie$", "commit", "push"],
        "emit": ["imprim", "mostr", "log", r"console\.log"],
        "allow": ["permit", "habilit", "conced"],
    },
}

NEGATIONS: dict[str, list[str]] = {
    "en": ["never", "not", "n'?t", "avoid", "without", r"instead\s+of", r"rather\s+than"],
    "es": [
        "no", "nunca", "jam[áa]s", "ning[úu]n", "ninguna", "evita", "evitar", r"en\s+vez\s+de",
        r"en\s+lugar\s+de",
    ],
    "pt": [
        "n[ãa]o", "nunca", "jamais", "nenhum", "nenhuma", "evite", "evitar", r"em\s+vez\s+de",
        r"ao\s+inv[ée]s\s+de",
    ],
}

UI_NOUNS: dict[str, list[str]] = {
    "en": [
        "button", "banner", "screen", "page", "link", "form", "modal", "dialog", "navbar", "nav",
        "header", "footer", "sidebar", "icon", "label", "placeholder", "component", "animation",
        "spinner", "css", "styl", "copy", "text",
    ],
    "es": [
        "bot[óo]n", "botones", "pantalla", "p[áa]gina", "enlace", "formulario", "modal",
        "men[úu]", "cabecera", r"pie\s+de\s+p[áa]gina", "barra", "icono", "etiqueta",
        "componente", "animaci[óo]n", "estilo", "texto", "vista",
    ],
    "pt": [
        "bot[ãa]o", "bot[õo]es", "tela", "p[áa]gina", "link", "formul[áa]rio", "modal", "menu",
        "cabe[çc]alho", "rodap[ée]", "barra", "[íi]cone", "r[óo]tulo", "componente",
        "anima[çc][ãa]o", "estilo", "texto",
    ],
}

PUBLIC_WORD: dict[str, list[str]] = {"en": ["public"], "es": ["p[úu]blic"], "pt": ["p[úu]blic"]}

DATASTORES: dict[str, list[str]] = {
    "en": ["table", "tables", "bucket", "buckets", "storage", "database", "db", "dataset"],
    "es": ["tabla", "tablas", "bucket", "almacenamiento", r"base\s+de\s+datos"],
    "pt": ["tabela", "tabelas", "bucket", "armazenamento", r"banco\s+de\s+dados"],
}

AUTH: dict[str, list[str]] = {
    "en": [
        "auth", "authentication", "authorization", "login", r"sign[-\s]?in", r"session\s*check",
        r"protected\s+route", "requireAuth", r"auth\s*wall",
        r"auth\s*(check|guard|middleware|requirement)",
    ],
    "es": [
        "autenticaci[óo]n", "autorizaci[óo]n", r"inicio\s+de\s+sesi[óo]n", "sesi[óo]n", "login",
        "auth", r"ruta\s+protegida",
    ],
    "pt": [
        "autentica[çc][ãa]o", "autoriza[çc][ãa]o", "login", "auth", "sess[ãa]o",
        r"rota\s+protegida",
    ],
}

# Tooling and file names that stay English in every language.
UNIVERSAL_EXCLUDES = [
    r"\b(eslint|prettier|lint|tsc|type[-\s]?check|webpack|vite|babel)\b",
    r"\b(e2e|end[-\s]to[-\s]end|playwright|cypress|vitest|jest|storybook|mock|fixture|snapshot|seed)\b",
    r"\b(localhost|docker[-\s]?compose|\.env\.(example|sample|template|dist)|\.gitignore|gitignore)\b",
    r"\brls[-_]?(test|fixture|demo|example|spec)\b",
]

# Identifiers, dangerous in any language.
SERVICE_KEY = r"(service[-_\s]?role|service[-_\s]?key|sb_secret|admin\s*key|master\s*key)"
CLIENT_SIDE = r"(client|frontend|front[-\s]?end|browser|react|next|vue|svelte|cliente|navegador)"
RLS = (
    r"(rls|row[-\s]?level\s+security|seguridad\s+a\s+nivel\s+de\s+fila"
    r"|seguran[çc]a\s+a\s+n[íi]vel\s+de\s+linha)"
)
SECRET = (
    r"(api[-\s]?key|secret|token|password|credential|credencial|contrase[ñn]a|senha"
    r"|access[-\s]?key|private[-\s]?key|connection\s+string)"
)
SECURITY_CONTROL = (
    r"(security|seguridad|seguran[çc]a|csrf|xss|sanitiz|rate[-\s]?limit"
    r"|l[íi]mite\s+de\s+peticiones|signature\s+verification|certificate\s+verification"
    r"|ssl\s+verification)"
)

# ---- end of fixed values ------------------------------------------------------------------


def _alternation(items: list[str]) -> str:
    """Alternatives joined, those with the same first letter under one branch.

    Java tries alternatives one by one at every position, so a flat list of forty words costs
    forty attempts per character. At any position only words with the right first letter can
    match and their order is kept, so the language and the match are unchanged.
    """
    branches: list[tuple[str | None, list[str]]] = []
    by_letter: dict[str, list[str]] = {}
    for item in dict.fromkeys(items):
        first, follow = item[:1], item[1:2]
        if first.isascii() and first.isalpha() and follow not in tuple("?*+{"):
            if first not in by_letter:
                by_letter[first] = []
                branches.append((first, by_letter[first]))
            by_letter[first].append(item[1:])
        else:
            branches.append((None, [item]))
    out = []
    for letter, rest in branches:
        if letter is None:
            out.append(rest[0])
        elif len(rest) == 1:
            out.append(letter + rest[0])
        else:
            inner = _alternation(rest)
            shared = len({r[:1] for r in rest}) == 1 and rest[0][:1].isalpha()
            out.append(letter + (inner if shared and "|" not in _outside(inner) else f"(?:{inner})"))
    return "|".join(out)


def _outside(pattern: str) -> str:
    """The pattern without what stands in parentheses."""
    out, depth = [], 0
    for ch in pattern:
        depth += ch == "("
        if depth == 0:
            out.append(ch)
        depth -= ch == ")"
    return "".join(out)


def group(items: list[str]) -> str:
    return "(?:" + _alternation(items) + ")"


def stems(items: list[str]) -> str:
    return group([i[:-1] if i.endswith("$") else i + r"[\p{L}]*" for i in items])


def alternatives(pattern: str) -> list[str]:
    """The top-level alternatives of a parenthesised pattern."""
    inner = pattern[1:-1].removeprefix("?:")
    out, depth, start = [], 0, 0
    for i, ch in enumerate(inner):
        depth += (ch == "(") - (ch == ")")
        if ch == "|" and depth == 0:
            out.append(inner[start:i])
            start = i + 1
    return [*out, inner[start:]]


def all_verbs(lang: str) -> list[str]:
    return [stem for role in VERBS[lang].values() for stem in role]


def lexicon_rows() -> list[tuple[str, str, str, bool]]:
    """The tables as rows ``(lang, role, stem, is_exact)``, for a lexicon DataFrame."""
    tables = {
        "negation": NEGATIONS,
        "ui_noun": UI_NOUNS,
        "public_word": PUBLIC_WORD,
        "datastore": DATASTORES,
        "auth": AUTH,
    }
    rows = []
    for lang in LANGS:
        for role, items in VERBS[lang].items():
            rows += [(lang, role, i.rstrip("$"), i.endswith("$")) for i in items]
        for role, table in tables.items():
            rows += [(lang, role, i, False) for i in table[lang]]
    return rows
