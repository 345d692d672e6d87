"""Prompt risk rules: what a user asks an agent to do."""

from __future__ import annotations

from dataclasses import dataclass

from riskloom.rules import lexicon as lx

# Names of the scanner itself. "The scanner says RLS is off" reports a finding and is not a
# request, so a reporting verb next to one of these names vetoes the clause.
SCANNER_NAMES = ("riskloom",)

# ---- fixed values -------------------------------------------------------------------------

NOT_WORD = r"(?<![\p{L}\p{N}_])"

DISCUSSION = [
    r"\b(explain|document\w*|describe|why\s+(is|does|would|should)|what\s+(is|does)|how\s+(does|do)\s+I)\b",
    r"\b(explica\w*|documenta\w*|describe|por\s+qu[ée]|qu[ée]\s+(es|significa)|c[óo]mo\s+(hago|puedo))\b",
    r"\b(explique|documente|descreva|por\s+que|o\s+que\s+[ée]|como\s+(fa[çc]o|posso))\b",
    r"\b(unit\s+test|test\s+that|write\s+a\s+test|add\s+a\s+test|prueba\s+unitaria|teste\s+unit[áa]rio)\b",
    r"\b(out\s+of|away\s+from|off\s+of|fuera\s+del?|lejos\s+del?|para\s+fora\s+d[oa]s?|longe\s+d[oa]s?)\s+(the\s+|el\s+|la\s+|o\s+|a\s+)?(client|frontend|front[-\s]?end|browser|bundle|repo|code|cliente|navegador|c[óo]digo)\b",
]
REPORTS_AFTER = r"(says?|said|report\w*|found|flags?|flagged|dice|dijo|reporta\w*|encontr[óo]|marc[óo]|diz|disse|achou|apontou)"
REPORTS_BEFORE = r"(says?|said|report\w*|found|flags?|flagged|dice|dijo|reporta\w*|encontr[óo]|diz|disse|achou)"

RLS_STATE = r"\b" + lx.RLS + r"\b[^\n]{0,20}\b(off|disabled|desactivad|desativad)"
SERVICE_KEY_THEN_CLIENT = lx.SERVICE_KEY + r"[^\n]{0,40}\b" + lx.CLIENT_SIDE + r"\b"
CLIENT_THEN_SERVICE_KEY = r"\b" + lx.CLIENT_SIDE + r"\b[^\n]{0,40}" + lx.SERVICE_KEY
EVERYONE = "(anonymous|everyone|anyone|todos|qualquer)"
PUBLIC_EXCLUDES = [
    r"\b(method|class|field|property|function|member|constructor|interface|variable|const|getter|setter|struct|enum|m[ée]todo|clase|classe|fun[çc][ãa]o|funci[óo]n)\b",
    r"\b(repo|repository|reposit[óo]rio|gist|package|npm|site|website|landing|blog|docs?|documentaci[óo]n|documenta[çc][ãa]o|profile|perfil)\b",
]
CORS = [
    r"\b(allow|permit\p{L}*|libera\p{L}*)\s+(all|any|todos?|todas?|qualquer|cualquier)[^\n]{0,10}\b(origins?|or[íi]genes|origens)\b",
    r"cors[^\n]{0,25}(\*|origin\s*[:=]\s*(true|['\"]\*['\"]))",
    r"access-control-allow-origin[^\n]{0,10}\*",
]
SECRET_IN_CODE = (
    r"\b(put|write|escrib\p{L}*|pon\p{L}*|coloc\p{L}*)\b[^\n]{0,25}"
    + lx.SECRET
    + r"[^\n]{0,30}\b(in\s+the\s+(code|source|bundle|component|repo)|directly|inline|en\s+el\s+c[óo]digo|no\s+c[óo]digo|direto)\b"
)
ENV_FILE = r"\.env\b"
SECRET_METADATA = [
    r"\b(name|names|prefix|suffix|id|shape|type|length|last\s*4|placeholder|redact|mask|masked|nombre|nome|prefijo|prefixo)\b",
]

RULE_IDS = [
    "disable-rls", "service-role-client", "make-public", "remove-auth", "cors-wildcard", "hardcode-secret",
    "disable-security", "commit-env",
]
#: Rules that are no verb with an object: whole patterns, tried first.
WHOLE = {
    "disable-rls": [RLS_STATE],
    "service-role-client": [SERVICE_KEY_THEN_CLIENT, CLIENT_THEN_SERVICE_KEY],
    "cors-wildcard": CORS,
    "hardcode-secret": [SECRET_IN_CODE],
}
#: (rule, first part, second part, characters between, in either order). Parts are verb roles of the lexicon
#: or objects; every row is made once per language.
PAIRS = [
    ("disable-rls", "weaken", "rls", 30, True),
    ("service-role-client", "expose", "service key", 30, True),
    ("make-public", "datastore", "public", 25, True),
    ("make-public", "allow", "public or everyone", 30, False),
    ("remove-auth", "weaken", "auth", 30, False),
    ("hardcode-secret", "place", "secret", 30, False),
    ("disable-security", "weaken", "security control", 30, False),
    ("commit-env", "ship", "env file", 30, False),
    ("commit-env", "emit", "secret", 30, False),
]
EXCLUDES = {"make-public": PUBLIC_EXCLUDES, "commit-env": SECRET_METADATA}
VETOED_BY_UI = ["make-public", "remove-auth"]

# ---- end of fixed values ------------------------------------------------------------------


@dataclass(frozen=True)
class IntentRule:
    id: str
    patterns: tuple[str, ...]
    exclude: tuple[str, ...] = ()
    ui_veto: bool = False


def _parts(lang: str) -> dict[str, tuple[str, str, str]]:
    """Per part its pattern, and how a boundary before and after it is written."""
    objects = {"rls": lx.RLS, "service key": lx.SERVICE_KEY, "secret": lx.SECRET, "env file": ENV_FILE}
    objects |= {"security control": lx.SECURITY_CONTROL, "auth": lx.group(lx.AUTH[lang])}
    public = lx.stems(lx.PUBLIC_WORD[lang])
    # The alternation is deliberately open: "everyone" and its translations are a branch of their own.
    objects["public or everyone"] = public + "|" + EVERYONE
    out = {name: (NOT_WORD, pattern, "") for name, pattern in objects.items()}
    out |= {role: (r"\b", lx.stems(stems), r"\b") for role, stems in lx.VERBS[lang].items()}
    return out | {"datastore": (r"\b", lx.group(lx.DATASTORES[lang]), r"\b"), "public": (r"\b", public, "")}


def _pair(lang: str, first: str, second: str, gap: int, either: bool) -> list[str]:
    parts = _parts(lang)
    out = []
    for one, two in ((first, second), (second, first))[: 2 if either else 1]:
        (before, x, after), (start, y, end) = parts[one], parts[two]
        # The part that comes last needs no boundary after it, but for a store, which is a noun.
        out.append(rf"{before}{x}{after}[^\n]{{0,{gap}}}{start}{y}{end if two == 'datastore' else ''}")
    return out


def _compiled(rule: str) -> IntentRule:
    patterns = list(WHOLE.get(rule, []))
    for of, *row in PAIRS:
        if of == rule:
            patterns += [p for lang in lx.LANGS for p in _pair(lang, *row)]
    return IntentRule(rule, tuple(patterns), tuple(EXCLUDES.get(rule, ())), rule in VETOED_BY_UI)


RULES: tuple[IntentRule, ...] = tuple(map(_compiled, RULE_IDS))


def discussion_patterns(scanner_names: tuple[str, ...] = SCANNER_NAMES) -> list[str]:
    names = lx.group(list(scanner_names))
    return DISCUSSION + [
        rf"\b{names}\b[^\n]{{0,40}}\b{REPORTS_AFTER}\b",
        rf"\b{REPORTS_BEFORE}\b[^\n]{{0,40}}\b{names}\b",
    ]


def negation_patterns() -> list[str]:
    return [
        rf"\b{lx.group(lx.NEGATIONS[lang])}\b\s+(?:[\p{{L}}\p{{N}}_'’-]+\s+){{0,2}}"
        rf"{lx.stems(lx.all_verbs(lang))}\b"
        for lang in lx.LANGS
    ]


def ui_patterns() -> list[str]:
    return [rf"\b{lx.group(lx.UI_NOUNS[lang])}\p{{L}}*\b" for lang in lx.LANGS]


# What a clause must hold for any rule to match: the targets themselves, so no hit can be lost.
PREFILTER = lx.group(
    [
        a
        for p in (lx.RLS, lx.SERVICE_KEY, lx.SECRET, lx.SECURITY_CONTROL, EVERYONE)
        for a in lx.alternatives(p)
    ]
    + ["p[úu]blic", "cors", r"origins?\b", r"or[íi]genes", "origens", "access-control-allow-origin"]
    + [a for lang in lx.LANGS for a in lx.AUTH[lang]]
    + [ENV_FILE]
)

# Parts of those targets, for a first look at the whole prompt.
TARGET_WORDS = (
    "rls level nivel nível service sb_secret admin master key secret token password credential "
    "credencial contrase senha connection security seguridad seguran csrf xss sanitiz limit límite "
    "verification anonymous everyone anyone todos qualquer .env public públic cors origin orígen "
    "origen auth login sign session sesi protected protegida autentica autoriza sess"
).split()
