"""Prompt risk: one job from a prompt column to rule hits.

Everything is row-local: a prompt is cut into clauses inside its own row, vetoes and rules run
over that array and only the hits leave the row. No shuffle, no skew, and legal on a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.expr import let
from riskloom.functions.regex import matches, matches_any, mentions
from riskloom.functions.text import normalize_prompt, split_clauses
from riskloom.rules import intent as rules
from riskloom.rules.lexicon import UNIVERSAL_EXCLUDES


def veto_reason(clause: Column, scanner_names: tuple[str, ...] = rules.SCANNER_NAMES) -> Column:
    """Why a clause is excused from every rule, or null."""
    return (
        F.when(matches_any(clause, rules.discussion_patterns(scanner_names)), "discussion")
        .when(matches_any(clause, rules.negation_patterns()), "negation")
        .when(matches_any(clause, UNIVERSAL_EXCLUDES), "tooling")
    )


def has_ui_noun(clause: Column) -> Column:
    return matches_any(clause, rules.ui_patterns())


def _rule_matches(rule: rules.IntentRule, clause: Column, ui: Column) -> Column:
    cond = matches_any(clause, list(rule.patterns))
    if rule.exclude:
        cond = cond & ~matches_any(clause, list(rule.exclude))
    if rule.ui_veto:
        cond = cond & ~ui
    return cond


def _clause_hits(clause: Column, pos: Column) -> Column:
    ui = has_ui_noun(clause)
    hits = F.array(
        *[
            F.when(
                _rule_matches(rule, clause, ui),
                F.struct(F.lit(rule.id).alias("rule_id"), pos.alias("clause_pos"), clause.alias("clause")),
            )
            for rule in rules.RULES
        ]
    )
    return F.filter(hits, lambda h: h.isNotNull())


def prompt_hits(
    normal: Column, scanner_names: tuple[str, ...] = rules.SCANNER_NAMES
) -> Column:
    """``array<struct<rule_id,clause_pos,clause>>``, each rule once, at its first clause."""
    named = let(F.lower(normal), lambda low: mentions(low, rules.TARGET_WORDS))
    return F.when(named, _hits(normal, scanner_names)).otherwise(
        F.array().cast("array<struct<rule_id:string,clause_pos:int,clause:string>>")
    )


def _hits(normal: Column, scanner_names: tuple[str, ...]) -> Column:
    clauses = F.transform(
        split_clauses(normal), lambda c, i: F.struct(c.alias("clause"), i.alias("pos"))
    )
    live = F.filter(
        clauses,
        lambda c: matches(c["clause"], rules.PREFILTER)
        & veto_reason(c["clause"], scanner_names).isNull(),
    )
    hits = F.flatten(F.transform(live, lambda c: _clause_hits(c["clause"], c["pos"])))
    return first_per_rule(hits, "rule_id")


def first_per_rule(hits: Column, field: str) -> Column:
    """Keep the first element per value of ``field``; at most one per rule, so the list is short."""
    return let(
        hits,
        lambda hs: F.aggregate(
            hs,
            F.filter(hs, lambda h: F.lit(False)),
            lambda acc, h: F.when(F.exists(acc, lambda a: a[field] == h[field]), acc).otherwise(
                F.concat(acc, F.array(h))
            ),
        ),
    )


def prompt_clauses(prompts: DataFrame, text: str = "text") -> DataFrame:
    """One row per clause with its veto and UI flags: the evidence behind a verdict."""
    keys = [c for c in prompts.columns if c != text]
    return (
        prompts.withColumn("_normal", normalize_prompt(F.col(text)))
        .select(*keys, F.posexplode(split_clauses(F.col("_normal"))).alias("pos", "clause"))
    )


def scan_prompts(
    prompts: DataFrame,
    text: str = "text",
    scanner_names: tuple[str, ...] = rules.SCANNER_NAMES,
) -> DataFrame:
    """Rule hits, one row per prompt and rule.

    The normal form is bound inside the expression. As a column with a filter on it, the filter
    would be pushed below the projection and the normalisation done twice.
    """
    keys = [c for c in prompts.columns if c != text]
    hits = let(normalize_prompt(F.col(text)), lambda normal: prompt_hits(normal, scanner_names))
    return prompts.select(*keys, F.explode(hits).alias("hit")).select(
        *keys, "hit.rule_id", "hit.clause_pos", "hit.clause"
    )
