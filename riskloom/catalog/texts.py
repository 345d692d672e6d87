"""Prompt and content queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.catalog import seeds
from riskloom.catalog.registry import expression, literal, oracle_of, query, values
from riskloom.functions.regex import matches
from riskloom.functions.text import (
    collapse_paragraphs,
    normalize_content,
    normalize_prompt,
    quote_of,
    split_clauses,
)
from riskloom.operators import injection as J
from riskloom.operators import intent as I
from riskloom.rules import injection as inj
from riskloom.rules import intent as rules
from riskloom.rules.lexicon import AUTH, LANGS, RLS, SECRET, SECURITY_CONTROL, SERVICE_KEY, UNIVERSAL_EXCLUDES, VERBS, alternatives

# ---- SQL twins ------------------------------------------------------------------------------
# DuckDB's regular expressions have no lookaround. The two places a rule looks behind are a
# boundary before the target, which the twin writes as the character that stands there.

_GAP_LOOK = r"[^\n]{0,30}" + rules.NOT_WORD
_GAP_PLAIN = r"[^\n]{0,29}[^\p{L}\p{N}_\n]"


def _re(pattern: str) -> str:
    p = pattern.replace(_GAP_LOOK, _GAP_PLAIN).replace(rules.NOT_WORD, r"(?:^|[^\p{L}\p{N}_])")
    return "'(?i)" + p.replace("'", "''") + "'"


def _any(text: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({text}, {_re(p)})" for p in patterns) + ")"


expression(
    "prompt_norm",
    r"SELECT conv_id, turn, expected_id, regexp_replace(text, '[ \t]+', ' ', 'g') AS normal FROM prompts",
)
expression(
    "clause_rows",
    r"""SELECT conv_id, turn, unnest(cs) AS clause, generate_subscripts(cs, 1) - 1 AS pos FROM (
    SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(normal, '[.!?;]+(?:\s|$)|[\n\r]+'),
        lambda c: regexp_replace(c, '^\s+|\s+$', '', 'g')), lambda c: c <> '') AS cs FROM prompt_norm)""",
)
expression(
    "clause_flags",
    f"""SELECT *, CASE WHEN {_any('clause', rules.discussion_patterns())} THEN 'discussion'
    WHEN {_any('clause', rules.negation_patterns())} THEN 'negation'
    WHEN {_any('clause', UNIVERSAL_EXCLUDES)} THEN 'tooling' END AS veto,
    {_any('clause', rules.ui_patterns())} AS ui FROM clause_rows""",
)


def _rule_sql(rule: rules.IntentRule) -> str:
    cond = _any("clause", rule.patterns)
    if rule.exclude:
        cond += f" AND NOT {_any('clause', rule.exclude)}"
    if rule.ui_veto:
        cond += " AND NOT ui"
    return f"SELECT conv_id, turn, '{rule.id}' AS rule_id, pos FROM clause_flags WHERE veto IS NULL AND {cond}"


expression(
    "intent_rows",
    "SELECT conv_id, turn, rule_id, min(pos) AS clause_pos FROM ("
    + " UNION ALL ".join(_rule_sql(r) for r in rules.RULES)
    + ") GROUP BY ALL",
)


@query("normalize_prompt", "SELECT conv_id, turn, length(normal) AS n, md5(normal) AS digest FROM prompt_norm")
def _(spark, sf):
    normal = normalize_prompt(F.col("text"))
    return (
        seeds.prompts(spark, sf)
        .select("conv_id", "turn", normal.alias("normal"))
        .select("conv_id", "turn", F.length("normal").cast("long").alias("n"), F.md5(F.col("normal").cast("binary")).alias("digest"))
    )


def _clauses(spark, sf):
    return I.prompt_clauses(seeds.prompts(spark, sf).drop("expected_id"))


@query("split_clauses", "SELECT conv_id, turn, pos, clause FROM clause_rows")
def _(spark, sf):
    return _clauses(spark, sf)


@query("intent_vetoes", "SELECT conv_id, turn, pos, veto FROM clause_flags WHERE veto IS NOT NULL")
def _(spark, sf):
    return (
        _clauses(spark, sf)
        .select("conv_id", "turn", "pos", I.veto_reason(F.col("clause")).alias("veto"))
        .filter(F.col("veto").isNotNull())
    )


_UI_RULES = [r for r in rules.RULES if r.ui_veto]
_UI_HIT = " OR ".join(
    f"({_any('clause', r.patterns)}" + (f" AND NOT {_any('clause', r.exclude)}" if r.exclude else "") + ")"
    for r in _UI_RULES
)


@query("intent_ui_veto", f"SELECT conv_id, turn, pos, clause FROM clause_flags WHERE ui AND ({_UI_HIT})")
def _(spark, sf):
    """Clauses that a rule would have matched had they not been about the interface."""
    clause = F.col("clause")
    hit = F.lit(False)
    for rule in _UI_RULES:
        hit = hit | I._rule_matches(rule, clause, F.lit(False))
    return _clauses(spark, sf).filter(matches(clause, rules.PREFILTER) & I.has_ui_noun(clause) & hit)


@query("intent_scan", "SELECT conv_id, turn, rule_id, clause_pos FROM intent_rows")
def _(spark, sf):
    return I.scan_prompts(seeds.prompts(spark, sf).drop("expected_id")).select(
        "conv_id", "turn", "rule_id", "clause_pos"
    )


@query(
    "first_risk_per_rule",
    """SELECT i.conv_id, i.turn, i.rule_id, c.clause FROM intent_rows i JOIN clause_rows c
    ON c.conv_id = i.conv_id AND c.turn = i.turn AND c.pos = i.clause_pos""",
)
def _(spark, sf):
    return I.scan_prompts(seeds.prompts(spark, sf).drop("expected_id")).select(
        "conv_id", "turn", "rule_id", "clause"
    )


@query(
    "rule_precision",
    """SELECT count(*) AS n, count_if(p.expected_id IS NULL) AS benign,
    count_if(p.expected_id IS NULL AND h.n > 0) AS false_positives,
    count_if(p.expected_id IS NOT NULL) AS risky, count_if(p.expected_id IS NOT NULL AND h.expected) AS recalled
    FROM prompts p LEFT JOIN (SELECT i.conv_id, i.turn, count(*) AS n, bool_or(i.rule_id = q.expected_id) AS expected
    FROM intent_rows i JOIN prompts q ON q.conv_id = i.conv_id AND q.turn = i.turn GROUP BY ALL) h
    ON h.conv_id = p.conv_id AND h.turn = p.turn""",
)
def _(spark, sf):
    """Hits of each labelled prompt stay in its row, so labels need no join back."""
    hits = I.prompt_hits(F.col("_normal"))
    rows = seeds.prompts(spark, sf).withColumn("_normal", normalize_prompt(F.col("text"))).select(
        "expected_id", F.transform(hits, lambda h: h["rule_id"]).alias("ids")
    )
    benign = F.col("expected_id").isNull()
    return rows.agg(
        F.count("*").alias("n"),
        F.count_if(benign).alias("benign"),
        F.count_if(benign & (F.size("ids") > 0)).alias("false_positives"),
        F.count_if(~benign).alias("risky"),
        F.count_if(~benign & F.array_contains("ids", F.col("expected_id"))).alias("recalled"),
    )


# ---- received content -----------------------------------------------------------------------

# The given texts hold a few single letters in a row that folding joins; the twin folds the same
# runs by hand: a run is at least three letters with one separator between each two.
expression(
    "text_norm",
    r"SELECT doc_id, text, regexp_replace(text, '[ \t]+', ' ', 'g') AS normal FROM texts",
)
expression(
    "text_passes",
    r"""SELECT doc_id, normal, array_to_string(list_transform(regexp_split_to_array(normal, '\n\s*\n'),
    lambda p: regexp_replace(regexp_replace(p, '\s*\n\s*', ' ', 'g'), '^\s+|\s+$', '', 'g')), chr(10)) AS collapsed FROM text_norm""",
)


def _first_hit(text: str, patterns) -> str:
    cases = " ".join(
        f"WHEN regexp_matches({text}, {_re(p)}) THEN regexp_extract({text}, {_re(p)})" for p in patterns
    )
    return f"CASE {cases} END"


def _sql_quote(text: str) -> str:
    flat = f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"
    return f"CASE WHEN length({flat}) > 200 THEN left({flat}, 200) || '…' ELSE {flat} END"


expression(
    "turn_tag_rows",
    r"""SELECT doc_id, tag, unnest(found) AS tag_text, generate_subscripts(found, 1) AS pos FROM (
    SELECT doc_id, 'system' AS tag, regexp_extract_all(normal, '(?i)</system\s*>|<system(?:\s[^>]*)?>') AS found FROM text_norm
    UNION ALL SELECT doc_id, 'assistant', regexp_extract_all(normal, '(?i)</assistant\s*>|<assistant(?:\s[^>]*)?>') FROM text_norm)""",
)
expression(
    "orphan_rows",
    """SELECT doc_id, tag, tag_text, pos FROM (SELECT *,
    coalesce(sum(CASE WHEN starts_with(tag_text, '</') THEN 0 ELSE 1 END) OVER w, 0) AS opens,
    coalesce(sum(CASE WHEN starts_with(tag_text, '</') THEN 1 ELSE 0 END) OVER w, 0) AS closes
    FROM turn_tag_rows WINDOW w AS (PARTITION BY doc_id, tag ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    WHERE starts_with(tag_text, '</') AND closes >= opens""",
)
expression(
    "override_rows",
    f"""SELECT doc_id, coalesce({_first_hit('normal', inj.OVERRIDE)}, (SELECT first(tag_text ORDER BY CASE tag WHEN 'system' THEN 0 ELSE 1 END, pos)
    FROM orphan_rows o WHERE o.doc_id = t.doc_id), {_first_hit('collapsed', inj.OVERRIDE)}) AS hit FROM text_passes t""",
)


# Folding by character: a separator goes if it stands between single letters, three at least. The twin has no
# NFKC; the given texts hold nothing that it would change.
INVISIBLE_SQL = "\u00ad\u200b-\u200f\u2060\ufeff"
expression(
    "content_chars",
    rf"""SELECT doc_id, cs, list_concat([false, false, false, false], list_transform(cs, lambda c: regexp_matches(c, '\p{{L}}')), [false, false, false, false]) AS l,
    list_concat([false, false, false, false], list_transform(cs, lambda c: regexp_matches(c, '[\p{{L}}\p{{N}}]')), [false, false, false, false]) AS w
    FROM (SELECT doc_id, regexp_extract_all(regexp_replace(text, '[{INVISIBLE_SQL}]', '', 'g'), '(?s).') AS cs FROM texts)""",
)
expression(
    "content_norm",
    r"""SELECT doc_id, regexp_replace(array_to_string(list_filter(cs, lambda c, i: NOT (c IN ('.', '-', '_', ' ') AND (
    (l[i+3] AND NOT w[i+2] AND l[i+5] AND coalesce(cs[i+2] IN ('.', '-', '_', ' '), false) AND l[i+7] AND NOT w[i+8])
    OR (NOT w[i] AND l[i+1] AND i > 2 AND coalesce(cs[i-2] IN ('.', '-', '_', ' '), false) AND l[i+3] AND l[i+5] AND NOT w[i+6])))), ''), '[ \t]+', ' ', 'g') AS normal
    FROM content_chars""",
)


@query("normalize_content", "SELECT doc_id, length(normal) AS n, md5(normal) AS digest FROM content_norm")
def _(spark, sf):
    return (
        seeds.texts(spark, sf)
        .select("doc_id", normalize_content(F.col("text")).alias("normal"))
        .select("doc_id", F.length("normal").cast("long").alias("n"), F.md5(F.col("normal").cast("binary")).alias("digest"))
    )


@query(
    "collapse_paragraphs",
    r"""SELECT doc_id, length(c) AS n, md5(c) AS digest FROM (SELECT doc_id, array_to_string(list_transform(
    regexp_split_to_array(text, '\n\s*\n'), lambda p: regexp_replace(regexp_replace(p, '\s*\n\s*', ' ', 'g'), '^\s+|\s+$', '', 'g')),
    chr(10)) AS c FROM texts)""",
)
def _(spark, sf):
    return (
        seeds.texts(spark, sf)
        .select("doc_id", collapse_paragraphs(F.col("text")).alias("c"))
        .select("doc_id", F.length("c").cast("long").alias("n"), F.md5(F.col("c").cast("binary")).alias("digest"))
    )


def _content(spark, sf, rule):
    return (
        J.scan_content(seeds.texts(spark, sf).select("doc_id", "text"), rule_ids=[rule])
        .filter(F.col("rule_id") == rule)
        .select("doc_id", "rule_id", "quote")
    )


@query(
    "injection_override",
    f"SELECT doc_id, 'injection-override' AS rule_id, {_sql_quote('hit')} AS quote FROM override_rows WHERE hit IS NOT NULL",
)
def _(spark, sf):
    return _content(spark, sf, "injection-override")


def _negated(prefix: str) -> str:
    return (
        f"regexp_matches(regexp_replace(right({prefix}, 80), '^[\\s\\S]*(\\. |\\n)', '\\1'), {_re(inj.NEGATION)})"
    )


def _prefix(text: str, p: str) -> str:
    return f"regexp_extract({text}, {_re('^([' + chr(92) + 's' + chr(92) + 'S]*?)(?:' + p + ')')}, 1)"


def _exfil_case(text: str) -> str:
    cases = " ".join(
        f"WHEN regexp_matches({text}, {_re(p)}) THEN CASE WHEN NOT {_negated(_prefix(text, p))} THEN regexp_extract({text}, {_re(p)}) END"
        for p in inj.EXFIL
    )
    return f"CASE {cases} END"


@query(
    "injection_exfil",
    f"""SELECT doc_id, 'injection-exfil' AS rule_id, {_sql_quote('hit')} AS quote FROM (SELECT doc_id,
    coalesce({_exfil_case('normal')}, {_exfil_case('collapsed')}) AS hit FROM text_passes) WHERE hit IS NOT NULL""",
)
def _(spark, sf):
    return _content(spark, sf, "injection-exfil")


# A directive's patterns look around at three places. The twin works on a marked copy of the text, one character
# for one, so that places and lengths are those of the text: the "e" of ".env" before a sample's ending is marked,
# and so is the first letter of an assistant's name behind an article. A hyphen after a name is kept out by the
# character that follows. The verbs' endings are written once.
_ARTICLES = inj.NOT_DETERMINED.removeprefix(r"(?<!").removesuffix(")")
_NAMES = alternatives(inj.AI_NAME)
_ANY_NAME = "(?:" + "|".join(f"[{name[0]}\\x04]{name[1:]}" for name in _NAMES) + ")"


def _marked(text: str) -> str:
    out = f"regexp_replace({text}, '(?i)\\.e(nv\\.(?:example|sample|template|dist))', '.' || chr(3) || '\\1', 'g')"
    for name in _NAMES:
        out = f"regexp_replace({out}, '(?i)({_ARTICLES}){name[0]}({name[1:]})', '\\1' || chr(4) || '\\2', 'g')"
    return out


def _unmarked_vocative() -> str:
    first, second, third = (v.replace(inj.NOT_DETERMINED, "") for v in inj.VOCATIVE)
    second = second.replace(inj.NOT_ATTRIBUTIVE + r"[^,:.\n]{0,30}:", r"(?:[^,:.\n-][^,:.\n]{0,29})?:")
    second = second.replace("(?:ai\\s+|a\\.i\\.\\s+)", "(?:[a\\x04]i\\s+|[a\\x04]\\.i\\.\\s+)")
    second, third = (v.replace(inj.AI_NAME, _ANY_NAME) for v in (second, third))
    return "(?:" + "|".join([first.replace(inj.NOT_ATTRIBUTIVE, ""), second, third]) + ")"


def _directive_pairs() -> list[tuple[str, str]]:
    """``directive_patterns`` for the marked text: before the verb, and from it on."""
    out = []
    for lang in LANGS:
        items = [s for role in ("weaken", "expose", "place", "ship", "emit") for s in VERBS[lang][role]]
        stems = "|".join(i for i in items if not i.endswith("$"))
        exact = "|".join([i[:-1] for i in items if i.endswith("$")] + [inj.PLACEMENT])
        verbs = rf"(?:(?:{stems})\p{{L}}*|{exact})"
        for target in [RLS, SERVICE_KEY, SECURITY_CONTROL, SECRET, r"\.env\b", "(?:" + "|".join(AUTH[lang]) + ")"]:
            core = rf"{verbs}\b[^\n]{{0,40}}{target}"
            out.append((rf"{_unmarked_vocative()}[^\n]{{0,60}}\b", core))
            out.append((r"\b", rf"{core}[^\n]{{0,30}},\s*{_ANY_NAME}s?\b"))
    return out


def _directive_case(text: str, marked: str) -> str:
    cases = []
    for before, core in _directive_pairs():
        whole = literal("(?i)" + before + core)
        prefix = f"regexp_extract({marked}, {literal('(?i)^([' + chr(92) + 's' + chr(92) + 'S]*?' + before + ')' + core)}, 1)"
        hit = f"regexp_extract({marked}, {whole})"
        quote = f"substr({text}, instr({marked}, {hit}), length({hit}))"
        cases.append(f"WHEN regexp_matches({marked}, {whole}) THEN CASE WHEN NOT {_negated(prefix)} THEN {quote} END")
    return "CASE " + " ".join(cases) + " END"


# Texts without a target or a name cannot hold a directive; the others are few.
expression(
    "directive_texts",
    rf"""SELECT *, {_marked('normal')} AS marked, {_marked('collapsed')} AS flat_marked FROM (
    SELECT doc_id, normal, array_to_string(list_transform(regexp_split_to_array(normal, '\n\s*\n'),
        lambda p: regexp_replace(regexp_replace(p, '\s*\n\s*', ' ', 'g'), '^\s+|\s+$', '', 'g')), chr(10)) AS collapsed FROM content_norm)
    WHERE regexp_matches(normal, '(?i){inj.AI_NAME}') AND regexp_matches(normal, {literal("(?i)" + inj.PREFILTER_DIRECTIVE)})""",
)
expression(
    "injected_rows",
    f"""SELECT doc_id, coalesce({_directive_case('normal', 'marked')}, {_directive_case('collapsed', 'flat_marked')}) AS hit FROM directive_texts""",
)


@query(
    "injection_directive",
    f"SELECT doc_id, 'injection-directive' AS rule_id, {_sql_quote('hit')} AS quote FROM injected_rows WHERE hit IS NOT NULL",
)
def _(spark, sf):
    return _content(spark, sf, "injection-directive")


@query(
    "negation_veto",
    f"""SELECT doc_id, {_negated(_prefix('normal', inj.EXFIL[0]))} AS negated FROM text_norm
    WHERE regexp_matches(normal, {_re(inj.EXFIL[0])})""",
)
def _(spark, sf):
    normal = F.col("normal")
    return (
        seeds.texts(spark, sf)
        .select("doc_id", normalize_content(F.col("text")).alias("normal"))
        .filter(matches(normal, inj.EXFIL_TARGET) & matches(normal, inj.EXFIL[0]))
        .select("doc_id", J.negated_before(J.text_before(normal, inj.EXFIL[0])).alias("negated"))
    )


def _span_sql(col: str) -> str:
    parts = ", ".join(
        f"regexp_extract_all({col}, {_re(p)}, 1)" for p in inj.HIDDEN_SPANS
    )
    return (
        f"list_filter(list_transform(flatten([{parts}]), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')"
    )


expression(
    "page_span_rows",
    f"""SELECT page_id, unnest(spans) AS span, generate_subscripts(spans, 1) - 1 AS pos FROM (
    SELECT page_id, {_span_sql('html')} AS spans FROM site_pages)""",
)


@query("hidden_spans", "SELECT page_id, pos, span FROM page_span_rows")
def _(spark, sf):
    return seeds.site_pages(spark, sf).select(
        "page_id", F.posexplode(J.hidden_spans(F.col("html"))).alias("pos", "span")
    )


@query(
    "injection_hidden",
    f"""SELECT doc_id, 'injection-hidden' AS rule_id, {_sql_quote('hit')} AS quote FROM (SELECT doc_id,
    list_filter({_span_sql('text')}, lambda s: regexp_matches(s, {_re(inj.NAMES_AN_AI)}))[1] AS hit FROM texts) WHERE hit IS NOT NULL""",
)
def _(spark, sf):
    return _content(spark, sf, "injection-hidden")


@query("quote_of", f"SELECT doc_id, {_sql_quote('text')} AS quote FROM texts")
def _(spark, sf):
    return seeds.texts(spark, sf).select("doc_id", quote_of(F.col("text")).alias("quote"))


@query("orphan_close_tags", "SELECT doc_id, tag, pos - 1 AS pos, tag_text FROM orphan_rows")
def _(spark, sf):
    """Every orphan, found by counting opens and closes before each tag inside the row.

    Nothing is set aside on the raw text: a tag may be one only after normalisation.
    """
    texts = seeds.texts(spark, sf).select("doc_id", normalize_content(F.col("text")).alias("normal"))

    def orphans(tag):
        found = J.orphan_closes(F.col("normal"), tag)
        return F.transform(found, lambda o: F.struct(F.lit(tag).alias("tag"), o["pos"].alias("pos"), o["tag_text"].alias("tag_text")))

    return texts.select("doc_id", F.inline(F.concat(*[orphans(tag) for tag in inj.TURN_TAGS])))


# ---- precision over both corpora --------------------------------------------------------------

expression(
    "content_hit_rows",
    " UNION ALL ".join(
        f"SELECT DISTINCT doc_id, rule_id FROM ({oracle_of(name)})"
        for name in ("injection_override", "injection_exfil", "injection_directive", "injection_hidden")
    ),
)
_CORPUS_RULES = [("prompt", r.id) for r in rules.RULES] + [("content", r) for r in [*J.RULES_ON_TEXT, "injection-hidden"]]
expression("corpus_rules", values(_CORPUS_RULES, "corpus, rule_id"))
expression(
    "labelled_hits",
    """SELECT 'prompt' AS corpus, 'und' AS lang, expected_id, list(rule_id) AS ids
    FROM prompts LEFT JOIN intent_rows USING (conv_id, turn) GROUP BY conv_id, turn, expected_id
    UNION ALL SELECT 'content', coalesce(lang, 'und'), expected_id, list(rule_id)
    FROM texts LEFT JOIN content_hit_rows USING (doc_id) GROUP BY doc_id, lang, expected_id""",
)


@query(
    "rule_precision_by_rule",
    """SELECT corpus, rule_id, CASE WHEN grouping(lang) = 1 THEN 'all' ELSE lang END AS lang, count(*) AS n,
    count_if(expected_id IS NULL) AS benign, count_if(expected_id IS NULL AND list_contains(ids, rule_id)) AS false_positives,
    count_if(expected_id = rule_id) AS risky, count_if(expected_id = rule_id AND list_contains(ids, rule_id)) AS recalled
    FROM labelled_hits JOIN corpus_rules USING (corpus) GROUP BY GROUPING SETS ((corpus, rule_id, lang), (corpus, rule_id))""",
)
def _(spark, sf):
    """False positives and recall per rule and language, and per rule over all languages.

    Each labelled text is scanned once and carries its hits in its row; counts are combined on the map side.
    """
    prompts = seeds.prompts(spark, sf).withColumn("_normal", normalize_prompt(F.col("text"))).select(
        F.lit("prompt").alias("corpus"), F.lit("und").alias("lang"), "expected_id", I.prompt_hits(F.col("_normal")).alias("hits")
    )
    found = J.content_hits(*map(F.col, ("_normal", "_flat", "_spans", "_languages")))
    texts = J.with_normal(seeds.texts(spark, sf), "text").select(
        F.lit("content").alias("corpus"), F.coalesce("lang", F.lit("und")).alias("lang"), "expected_id", found.alias("hits")
    )
    tried = F.when(F.col("corpus") == "prompt", F.array(*[F.lit(r) for c, r in _CORPUS_RULES if c == "prompt"])).otherwise(
        F.array(*[F.lit(r) for c, r in _CORPUS_RULES if c == "content"])
    )
    narrow = [d.withColumn("ids", F.transform("hits", lambda h: h["rule_id"])).drop("hits") for d in (prompts, texts)]
    rows = narrow[0].unionByName(narrow[1]).withColumn("rule_id", F.explode(tried))
    hit, benign, risky = F.array_contains("ids", F.col("rule_id")), F.col("expected_id").isNull(), F.col("expected_id") == F.col("rule_id")
    keys = [F.col(k) for k in ("corpus", "rule_id", "lang")]
    counts = rows.groupingSets([keys, keys[:2]], *keys).agg(
        F.grouping("lang").alias("over_all"),
        F.count("*").alias("n"),
        F.count_if(benign).alias("benign"),
        F.count_if(benign & hit).alias("false_positives"),
        F.count_if(risky).alias("risky"),
        F.count_if(risky & hit).alias("recalled"),
    )
    lang = F.when(F.col("over_all") == 1, "all").otherwise(F.col("lang"))
    return counts.withColumn("lang", lang).drop("over_all")
