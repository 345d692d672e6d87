"""Injected instructions in text an agent received. Row-local like the prompt job."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable
from functools import lru_cache, reduce
from operator import and_, or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from riskloom.functions.expr import let, record
from riskloom.functions.literals import automaton, fold, runs
from riskloom.functions.regex import extract, extract_all, java, matches, mentions
from riskloom.functions.text import (
    collapse_paragraphs,
    fold_content,
    js_trim,
    nfkc,
    quote_of,
)
from riskloom.operators.intent import first_per_rule
from riskloom.rules import injection as rules
from riskloom.rules.lexicon import LANGS, alternatives

_JOIN = "\u0001"


def negated_before(prefix: Column) -> Column:
    """Whether a negation governs what follows: the last 80 characters, cut at a sentence end."""
    window = F.right(prefix, F.lit(rules.NEGATION_WINDOW))
    sentence = F.regexp_replace(window, r"^[\s\S]*(?=\. |\n)", "")
    return matches(sentence, rules.NEGATION)


def text_before(text: Column, pattern: str) -> Column:
    """The text up to the first match of ``pattern`` (which must match)."""
    return F.regexp_extract(text, "(?iu)^([\\s\\S]*?)(?:" + java(pattern) + ")", 1)


def _hit(rule_id: str, quote: Column, before: Column | None) -> Column:
    negated = F.lit(False) if before is None else negated_before(before)
    return F.struct(
        F.lit(rule_id).alias("rule_id"),
        quote_of(quote, rules.QUOTE_LIMIT).alias("quote"),
        negated.alias("negated"),
    )


def first_of(text: Column, rule_id: str, patterns: list[str], veto: bool) -> Column:
    """The first pattern that matches decides, even when its first match is then vetoed."""
    def one(p: str) -> Column:
        return let(
            extract(text, p, 0),
            lambda found: F.when(
                found != "", _hit(rule_id, found, text_before(text, p) if veto else None)
            ),
        )

    return F.coalesce(*[one(p) for p in patterns])


def turn_tags(text: Column, tag: str) -> Column:
    """Opening and closing ``<tag>`` in order: ``array<struct<tag_text,is_close>>``."""
    found = extract_all(text, rf"</{tag}\s*>|<{tag}(?:\s[^>]*)?>")
    return F.transform(
        found, lambda t: F.struct(t.alias("tag_text"), t.startswith("</").alias("is_close"))
    )


def orphan_closes(text: Column, tag: str) -> Column:
    """Closing tags with no open one before them: ``array<struct<pos,tag_text>>``.

    Walking the tags in order: closes so far >= opens so far at a closing tag makes it an orphan.
    Row-local, so the same expression serves batch and stream.
    """
    none = F.array().cast("array<struct<pos:int,tag_text:string>>")
    start = record(opens=F.lit(0), closes=F.lit(0), hits=none)
    numbered = F.transform(
        turn_tags(text, tag),
        lambda t, i: record(pos=i, tag_text=t["tag_text"], is_close=t["is_close"]),
    )
    walked = F.aggregate(
        numbered,
        start,
        lambda s, t: record(
            opens=s["opens"] + F.when(t["is_close"], 0).otherwise(1),
            closes=s["closes"] + F.when(t["is_close"], 1).otherwise(0),
            hits=F.when(
                t["is_close"] & (s["closes"] >= s["opens"]),
                F.concat(s["hits"], F.array(record(pos=t["pos"], tag_text=t["tag_text"]))),
            ).otherwise(s["hits"]),
        ),
        lambda s: s["hits"],
    )
    return F.when(matches(text, f"</{tag}"), walked).otherwise(none)


def orphan_close(text: Column) -> Column:
    """The first orphan of the first turn tag that has one, or null."""
    return F.coalesce(
        *[F.get(orphan_closes(text, tag), F.lit(0))["tag_text"] for tag in rules.TURN_TAGS]
    )


def override_hit(text: Column, low: Column | None = None) -> Column:
    """``low``: lower-cased text that holds the words of ``text``. A pattern is only tried where it holds what the
    pattern cannot do without, and the common gate only where something was found."""
    held = low if low is not None else F.lower(text)
    found = []
    for pattern, parts in zip(rules.OVERRIDE, rules.OVERRIDE_PARTS, strict=True):
        worth = reduce(and_, [mentions(held, words) for words in parts])
        found.append(F.when(worth, first_of(text, "injection-override", [pattern], veto=False)))
    orphan = F.when(held.contains("</"), orphan_close(text))
    found.append(let(orphan, lambda o: F.when(o.isNotNull(), _hit("injection-override", o, None))))
    return let(F.coalesce(*found), lambda hit: F.when(hit.isNotNull() & matches(text, rules.PREFILTER_OVERRIDE), hit))


def exfil_hit(text: Column, strict: bool = False) -> Column:
    found = _strict_exfil(text) if strict else first_of(text, "injection-exfil", rules.EXFIL, veto=True)
    return F.when(matches(text, rules.EXFIL_TARGET) & matches(text, rules.EXTERNAL_DEST), found)


def _directive(text: Column, before_verb: str, from_verb: str) -> Column:
    prefix = F.regexp_extract(
        text, "(?iu)^([\\s\\S]*?" + java(before_verb) + ")" + java(from_verb), 1
    )
    return let(
        extract(text, before_verb + from_verb, 0),
        lambda found: F.when(found != "", _hit("injection-directive", found, prefix)),
    )


@lru_cache(maxsize=1)
def _directive_automaton():
    return automaton(rules.directive_words())


def directives_of(text: str) -> int:
    """A bit for each of ``rules.directive_patterns``, in their order, that may match in a text: on some line a
    verb's letters come before a target's, with the end of the word and the gap between, and near them an
    assistant is spoken to before the verb, or called after the target."""
    low, verbs, pairs = fold(_one_space(text)), {}, {}
    spoken_to: list[int] = []
    called: list[int] = []
    for end, (length, parts) in _directive_automaton().iter(low):
        for part, lang, which in parts:
            start = end + 1 - length
            if part == "name":
                if _is_spoken_to(low, start, end + 1):
                    spoken_to.append(end + 1)
                if low[:start].endswith(",") if start < 2 else "," in (low[start - 1], low[start - 2]):
                    called.append(start)
            elif part == "verb":
                verbs.setdefault(lang, []).append(end + 1)
            else:
                # Longer words end later though they start before, hence the slack in what is forgotten.
                near = verbs[lang] = [v for v in verbs.get(lang, ()) if _reaches(low, v, start - _SLACK)]
                reach = [v for v in near if v <= start and _reaches(low, v, start)]
                if reach:
                    pairs.setdefault((lang, which), []).append((min(reach), max(reach), start))
    found = 0
    for (lang, which), places in pairs.items():
        bit = _pattern_bit(lang, 2 * which)
        if any(_within(spoken_to, v - _NAME_REACH, w) for v, w, _ in places):
            found |= 1 << bit
        if any(_within(called, t, t + _NAME_REACH) for _, _, t in places):
            found |= 2 << bit
    return found


def _pattern_bit(lang: str, pattern: int) -> int:
    """The bit of a language's pattern: two for each target, one before the verb and one behind the target."""
    return 2 * rules.DIRECTIVE_TARGETS * _LANG_BIT[lang] + pattern


def languages_of(text: str) -> int:
    """A bit for each language in which a directive may stand in a text."""
    found, each = directives_of(text), 2 * rules.DIRECTIVE_TARGETS
    return sum(1 << bit for bit in _LANG_BIT.values() if found >> each * bit & (1 << each) - 1)


def _one_space(text: str) -> str:
    """Every run of white space as one character, a line's end where it holds one: patterns let any run pass
    between an assistant's name and what it is told."""
    return _BLANKS.sub(lambda m: "\n" if "\n" in m[0] else " ", text)


def _is_spoken_to(low: str, start: int, end: int) -> bool:
    """Whether what stands next to a name's letters allows one of the shapes of ``rules.VOCATIVE``."""
    if low.startswith(_LONG_NAMES, start):
        return True
    if start and low[start - 1] in " \n" and low.find(":", end, end + _VOCATIVE_GAP) >= 0:
        return True
    for at in (end, end + 1) if low.startswith("s", end) else (end,):
        rest = at + 1 if low[at : at + 1] in (" ", "\n") else at
        if low[rest : rest + 1] in (",", ":") or rest > at and low.startswith(rules.TOLD, rest):
            return True
    return False


def _within(places: list[int], low: int, high: int) -> bool:
    at = bisect_left(places, low)
    return at < len(places) and places[at] <= high


_BLANKS = re.compile("[\\s\ufeff]{2,}|[^\\S \\n]|\ufeff")
#: Names of several words are found by the letters of the first.
_LONG_NAMES = tuple(fold(runs(a)[0]) for a in alternatives(rules.AI_NAME) if "\\s" in a)
#: Characters, white space counted once, that may stand between a name and its colon, and between a name and
#: the end of the verb or the start of the target; both with room to spare.
_VOCATIVE_GAP, _NAME_REACH = 34, 320
_LANG_BIT = {lang: bit for bit, lang in enumerate(LANGS)}
#: Characters of a target that may come before its first fixed letters; more than any of the words has.
_TARGET_LEAD, _SLACK = 4, 64


def _reaches(low: str, verb: int, target: int) -> bool:
    """Whether a verb whose letters end at ``verb`` reaches a target at or after ``target`` on its line."""
    while verb < target and low[verb].isalpha():
        verb += 1
    return target - verb <= rules.DIRECTIVE_GAP + _TARGET_LEAD and "\n" not in low[verb:target]


@F.arrow_udf(LongType())
def _languages(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else directives_of(t) for t in texts.to_pylist()], pa.int64())


def _prefiltered(low: Column) -> Column:
    return mentions(low, rules.WORDS_TARGET)


def directive_languages(normal: Column, flat: Column) -> Column:
    """``directives_of`` the paragraphs' text, in which all that lines hold stands as near; null where no target
    is named. Goes to Python, so it cannot stand inside a lambda."""
    return _languages(F.when(let(F.lower(normal), _prefiltered), F.coalesce(flat, normal)))


def directive_hit(text: Column, languages: Column | None = None, strict: bool = False) -> Column:
    """The patterns in order, language by language; the veto is anchored at the verb.

    A pattern is only tried where its bit of ``directives_of`` is set; without ``languages`` all are.
    """
    one = _strict_directive if strict else _directive
    hits = []
    for lang, pairs in rules.directive_patterns().items():
        for k, pair in enumerate(pairs):
            hit = one(text, *pair)
            bit = F.lit(1 << _pattern_bit(lang, k)).cast("long")
            hits.append(hit if languages is None else F.when(languages.bitwiseAND(bit) != 0, hit))
    return F.coalesce(*hits)


# ---- every match ----------------------------------------------------------------------------


def _first_live(text: Column, rule_id: str, before: str, from_anchor: str) -> Column:
    """The first of all matches, one after another, whose anchor no negation governs.

    The anchor of each match is marked, the text cut at the marks, and the last characters before each carried
    along, so a text of many matches is read once.
    """
    mark = "\u0001"
    pattern = f"(?iu)({java(before)})({java(from_anchor)})"
    clean = F.translate(text, mark, "")
    pieces = F.split(F.regexp_replace(clean, pattern, f"$1{mark}$2"), mark)
    quotes = F.regexp_extract_all(clean, F.lit(pattern), F.lit(0))
    window = F.lit(rules.NEGATION_WINDOW)
    start = record(tail=F.lit(""), at=F.lit(-1), live=F.lit(-1))

    def step(s: Column, piece: Column) -> Column:
        # With the piece read, its end is the anchor of match ``at + 1``.
        tail = F.right(F.concat(s["tail"], F.right(piece, window)), window)
        at = s["at"] + 1
        free = (s["live"] < 0) & (at < F.size(pieces) - 1) & ~negated_before(tail)
        return record(tail=tail, at=at, live=F.when(free, at).otherwise(s["live"]))

    return let(
        F.aggregate(pieces, start, step, lambda s: s["live"]),
        lambda live: F.when(live >= 0, _hit(rule_id, F.get(quotes, live), None)),
    )


def _short(pattern: str) -> str:
    """With gaps that stop at the nearest match, so that one match does not swallow the next."""
    return re.sub(r"(\[\^\\n\]\{0,\d+\})", r"\1?", pattern)


def _strict_directive(text: Column, before_verb: str, from_verb: str) -> Column:
    found = _first_live(text, "injection-directive", _short(before_verb), _short(from_verb))
    return F.when(matches(text, before_verb + from_verb), found)


def _strict_exfil(text: Column) -> Column:
    return F.coalesce(*[F.when(matches(text, p), _first_live(text, "injection-exfil", "", _short(p))) for p in rules.EXFIL])


def _rule_hits(strict: bool, languages: Column | None, low: Column) -> dict[str, Callable[[Column], Column]]:
    return {
        "injection-override": lambda t: override_hit(t, low),
        "injection-exfil": lambda t: exfil_hit(t, strict),
        "injection-directive": lambda t: directive_hit(t, languages, strict),
    }


RULES_ON_TEXT = ["injection-override", "injection-exfil", "injection-directive"]


def _up_to_last(raw: Column, closer: str) -> Column:
    """The text up to its last ``closer``, so that a search from any opener before it finds one."""
    rest = F.substring_index(raw, closer, -1)
    return F.left(raw, F.length(raw) - F.length(rest))


def hidden_spans(raw: Column) -> Column:
    """Bodies a human reader would not see, in rule order then document order. Linear in the text.

    Openers after the last closer are not searched from. An element's pattern is tried once in each run up to
    the next ``>``: if it fails from the run's first ``<``, it does from the others, so the run is passed over.
    """
    gates = {"<!--": "-->", r"style\s*=": "</", "aria-hidden": "</"}
    per_rule = []
    for (gate, closer), p in zip(gates.items(), rules.HIDDEN_SPANS):
        once = p if p.startswith("<!--") else rf"<(?=[^>]*>){p.removeprefix('<')}|<[^>]*+"
        found = F.filter(extract_all(_up_to_last(raw, closer), once, 1), lambda body: body != "")
        per_rule.append(F.when(matches(raw, gate), found).otherwise(F.array().cast("array<string>")))
    return F.filter(F.transform(F.concat(*per_rule), js_trim), lambda s: s != "")


def with_normal(df: DataFrame, text: str, rule_ids: list[str] | None = None) -> DataFrame:
    """Adds ``_normal``, ``_flat`` (its paragraphs, one a line; null where it has one line), ``_spans`` (hidden
    spans as one NFKC string, or null) and ``_languages``.

    Each pair of Python calls sits in one projection, so Spark sends them to Python in one Arrow batch.
    """
    joined = F.nullif(F.array_join(hidden_spans(F.col(text)), _JOIN), F.lit(""))
    spelt = df.withColumn("_joined", joined).withColumns({"_nfkc": nfkc(F.col(text)), "_spans": nfkc(F.col("_joined"))})
    return with_languages(spelt.withColumn("_normal", fold_content(F.col("_nfkc"))), rule_ids).drop("_joined", "_nfkc")


def with_languages(df: DataFrame, rule_ids: list[str] | None = None) -> DataFrame:
    """Adds ``_flat`` and ``_languages`` next to ``_normal``; ``_flat`` is null where none of the rules may match."""

    def worth(low: Column) -> Column:
        wanted = [cond for rule_id, cond in _worth(low).items() if rule_ids is None or rule_id in rule_ids]
        return reduce(or_, wanted, F.lit(False))

    # Lower case once for all the words looked for: a search that another one decides shares nothing with it.
    wanted = F.col("_normal").contains("\n") & let(F.lower(F.col("_normal")), worth)
    flat = F.when(wanted, collapse_paragraphs(F.col("_normal")))
    return df.withColumn("_flat", flat).withColumn("_languages", directive_languages(F.col("_normal"), F.col("_flat")))


def hidden_hit(spans: Column) -> Column:
    named = F.filter(
        F.transform(F.split(spans, _JOIN), fold_content), lambda s: matches(s, rules.NAMES_AN_AI)
    )
    return let(
        F.get(named, F.lit(0)),
        lambda first: F.when(first.isNotNull(), _hit("injection-hidden", first, None)),
    )


def _worth(low: Column) -> dict[str, Column]:
    """Per rule, whether the lower-cased text holds a word the rule cannot do without."""
    return {
        "injection-override": mentions(low, rules.WORDS_OVERRIDE),
        "injection-exfil": mentions(low, rules.WORDS_DEST) & mentions(low, rules.WORDS_TARGET),
        "injection-directive": _prefiltered(low),
    }


def content_hits(
    normal: Column, flat: Column, spans: Column, languages: Column, rule_ids: list[str] | None = None, strict: bool = False
) -> Column:
    """``array<struct<rule_id,quote,negated>>``, each rule once, line pass before paragraph pass.

    The arguments are the columns of ``with_normal``. The paragraph pass only runs where it reads differently
    from the line pass. ``strict``: a match that a negation excuses does not excuse the others.
    """
    wanted = [*RULES_ON_TEXT, "injection-hidden"] if rule_ids is None else rule_ids
    rules_on_text = [r for r in RULES_ON_TEXT if r in wanted]

    def both_passes(low: Column) -> Column:
        hits = _rule_hits(strict, languages, low)
        worth = _worth(low) | {"injection-directive": F.coalesce(languages, F.lit(0)) != 0}
        # Both passes share one copy of the patterns.
        texts = F.array_compact(F.array(normal, flat))
        return F.flatten(
            F.transform(
                texts,
                lambda t: F.array(*[F.when(worth[r], hits[r](t)) for r in rules_on_text]),
            )
        )

    parts = []
    if rules_on_text:
        parts.append(let(F.lower(normal), both_passes))
    if "injection-hidden" in wanted:
        parts.append(F.array(F.when(spans.isNotNull(), hidden_hit(spans))))
    live = F.filter(F.concat(*parts), lambda h: h.isNotNull() & ~h["negated"])
    return first_per_rule(live, "rule_id")


def scan_content(
    df: DataFrame, text: str = "text", rule_ids: list[str] | None = None, strict: bool = False
) -> DataFrame:
    """Injection hits, one row per text and rule, with a quote of the matched text.

    No filter sits above the normal form, so it is computed once per row (see ``scan_prompts``).
    """
    keys = [c for c in df.columns if c != text]
    hits = content_hits(*map(F.col, ("_normal", "_flat", "_spans", "_languages")), rule_ids, strict)
    return (
        with_normal(df, text, rule_ids)
        .select(*keys, F.explode(hits).alias("hit"))
        .select(*keys, "hit.rule_id", "hit.quote")
    )
