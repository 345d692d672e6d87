"""Credentials in source files, pages, bundles and returned rows.

The job never emits a value: a finding carries its SHA-256 and a masked preview.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.expr import let, record
from riskloom.functions.regex import extract_all, java, matches, mentions
from riskloom.rules import secrets as rules


def jwt_role(token: Column) -> Column:
    """The ``role`` claim of a JWT's payload, or null."""
    body = F.translate(F.split_part(token, F.lit("."), F.lit(2)), "-_", "+/")
    padded = F.concat(body, F.repeat(F.lit("="), F.pmod(-F.length(body), F.lit(4)).cast("int")))
    decoded = F.try_to_binary(padded, F.lit("base64")).cast("string")
    return F.when(token.startswith("eyJ"), F.get_json_object(decoded, "$.role"))


def is_public_key(value: Column) -> Column:
    """Provably public: an anon JWT or a publishable key."""
    return matches(value, rules.PUBLIC_KEY, False) | F.coalesce(jwt_role(value) == "anon", F.lit(False))


def is_placeholder(value: Column) -> Column:
    return matches(value, rules.PLACEHOLDER)


def _looks_like_token(value: Column) -> Column:
    """Letters and digits, one piece (or a JWT), no placeholder, not a public key."""
    jwt = matches(value, "^" + rules.JWT.removeprefix(r"\b") + "$", False)
    one_piece = ~value.contains(".") & matches(value, "[0-9]") & matches(value, "[A-Za-z]")
    return (jwt | one_piece) & ~is_placeholder(value) & ~is_public_key(value)


_NONE = "array<struct<id:string,value:string>>"


def _worth(text: Column, rule_id: str) -> Column:
    """Whether the text holds letters that the rule cannot do without, as they are written in the rule."""
    held = [mentions(text, words) for words in rules.PARTS[rule_id]]
    return reduce(and_, held)


def _of_rule(text: Column, rule: rules.SecretRule) -> Column:
    found = extract_all(text, rule.pattern, rule.group, ignore_case=False)
    if rule.id == "supabase_service_role":
        found = F.filter(found, lambda v: F.coalesce(jwt_role(v) == "service_role", F.lit(False)))
    if rule.id == rules.GENERIC_ID:
        found = F.filter(found, lambda v: ~is_placeholder(v) & ~is_public_key(v))
    found = F.transform(found, lambda v: record(id=F.lit(rule.id), value=v))
    none = F.array().cast(_NONE)
    if rule.id == rules.GENERIC_ID:  # the one rule that is blind to case
        return F.when(let(F.lower(text), lambda low: _worth(low, rule.id)), found).otherwise(none)
    return F.when(_worth(text, rule.id), found).otherwise(none)


def bearer_literals(text: Column) -> Column:
    """Token literals that end up behind ``Bearer``: inline, or one assignment away.

    An identifier with two candidate literals proves nothing, so it yields none.
    """
    inline = F.filter(extract_all(text, rules.BEARER_INLINE, 1, False), _looks_like_token)
    used = F.array_distinct(
        F.filter(
            F.concat(
                extract_all(text, rules.BEARER_USE, 1, False),
                extract_all(text, rules.BEARER_USE, 2, False),
            ),
            lambda n: n != "",
        )
    )
    assigned = F.arrays_zip(
        extract_all(text, rules.ASSIGNMENT, 1, False).alias("name"),
        extract_all(text, rules.ASSIGNMENT, 2, False).alias("value"),
    )

    def one_hop(pairs: Column) -> Column:
        literals = F.transform(
            used,
            lambda n: F.array_distinct(
                F.transform(F.filter(pairs, lambda p: p["name"] == n), lambda p: p["value"])
            ),
        )
        certain = F.filter(literals, lambda vs: F.size(vs) == 1)
        return F.filter(F.flatten(certain), _looks_like_token)

    hop = F.when(F.size(used) > 0, let(assigned, one_hop)).otherwise(F.array().cast("array<string>"))
    return F.when(text.contains("Bearer"), F.array_distinct(F.concat(inline, hop))).otherwise(
        F.array().cast("array<string>")
    )


def secret_values(text: Column, generic: bool = True) -> Column:
    """``array<struct<id,value>>`` of one text, each pair once. A rule's pattern is only tried on texts that hold
    its fixed letters: a text with one kind of credential is not read by the patterns of all."""
    chosen = [r for r in rules.RULES if generic or r.id != rules.GENERIC_ID]
    bearer = F.transform(
        bearer_literals(text), lambda v: record(id=F.lit("hardcoded_bearer"), value=v)
    )
    return F.array_distinct(F.concat(*[_of_rule(text, r) for r in chosen], bearer))


def _line_of(text: Column, value: Column) -> Column:
    """Line of the first occurrence: newlines before it, counted on the prefix."""
    prefix = F.left(text, F.instr(text, value) - 1)
    return F.length(prefix) - F.length(F.translate(prefix, "\n", "")) + 1


def masked(value: Column) -> Column:
    return F.concat(F.left(value, F.lit(4)), F.lit("…"), F.right(value, F.lit(2)))


def _lookup(table: dict[str, str], key: Column) -> Column:
    out = None
    for name, value in table.items():
        out = F.when(key == name, value) if out is None else out.when(key == name, value)
    return out


def scan_secrets(df: DataFrame, text: str = "content", with_line: bool = True, generic: bool = True) -> DataFrame:
    """One row per text and distinct secret: id, severity, line, hash, preview. Row-local."""
    keys = [c for c in df.columns if c != text]
    found = let(F.col(text), lambda t: F.transform(
        secret_values(t, generic),
        lambda s: record(
            id=s["id"],
            line=_line_of(t, s["value"]) if with_line else F.lit(None).cast("int"),
            secret_sha256=F.sha2(s["value"].cast("binary"), 256),
            preview=masked(s["value"]),
        ),
    ))
    return df.select(*keys, F.inline(found)).withColumn(
        "severity", _lookup(rules.SEVERITY, F.col("id"))
    )


def secrets_new_in_crawl(
    pages: DataFrame, scanned_urls: DataFrame, earlier: DataFrame, text: str = "html"
) -> DataFrame:
    """Secrets on crawled pages that no earlier pass reported, each key once per site.

    ``pages`` is ``(site, page_id, url, html)``, ``scanned_urls`` is ``(site, url)`` and ``earlier``
    is ``(site, id, secret_sha256)``. Pages are scanned where they are read; only hits are joined and
    shuffled, and repeats are merged map-side.

    The optimiser pushes a semi or anti join below the generator of the hits, where it would deal out whole
    documents; it leaves an outer join where it stands.
    """
    hits = scan_secrets(pages.select("site", "page_id", "url", text), text, with_line=False)
    scanned = scanned_urls.select("site", "url").distinct().withColumn("_scanned", F.lit(True))
    fresh = hits.join(scanned, ["site", "url"], "left").filter("_scanned IS NULL")
    return (
        fresh.groupBy("site", "id", "secret_sha256")
        .agg(F.min_by("url", F.col("page_id")).alias("source"))
        .join(earlier.select("site", "id", "secret_sha256"), ["site", "id", "secret_sha256"], "left_anti")
    )


def site_secrets(texts: DataFrame, text: str, order: str) -> DataFrame:
    """``(site, id, severity, source, secret_sha256)``: each secret of a site once, at its first text.

    ``texts`` is ``(site, url, text, order)``. Row-local scan; only hits are shuffled, merged map-side.
    """
    hits = scan_secrets(texts.select("site", "url", order, text), text, with_line=False)
    return hits.groupBy("site", "id", "severity", "secret_sha256").agg(
        F.min_by("url", F.struct(order, "url")).alias("source")
    )


def secrets_in_data(probes: DataFrame) -> DataFrame:
    """Secrets pasted into rows anyone can read; the generic rule is too noisy for row JSON."""
    hits = scan_secrets(
        probes.filter(F.col("row_json").isNotNull()).select("site", "source", "row_json"),
        "row_json",
        with_line=False,
        generic=False,
    )
    return hits.withColumn("id", F.concat(F.lit("data_"), F.col("id"))).drop("line")


def supabase_config(text: Column) -> Column:
    """``struct<project_url,anon_key,key_kind>``: the first project and its public key, or null."""
    tokens = F.filter(
        extract_all(text, rules.JWT, 0, False), lambda t: F.coalesce(jwt_role(t) == "anon", F.lit(False))
    )
    anon = F.get(tokens, F.lit(0))
    publishable = F.get(extract_all(text, rules.SUPABASE_PUBLISHABLE, 0, False), F.lit(0))
    ref = F.regexp_extract(text, java(rules.SUPABASE_URL), 0)
    return F.when(
        ref != "",
        let(
            record(anon=anon, publishable=publishable),
            lambda k: record(
                project_url=ref,
                anon_key=F.coalesce(k["anon"], k["publishable"]),
                key_kind=F.when(k["anon"].isNotNull(), "anon-jwt").when(
                    k["publishable"].isNotNull(), "publishable"
                ),
            ),
        ),
    )


def first_per_site(df: DataFrame, value: str, order: str) -> DataFrame:
    """The value with the lowest order per site, combined on the map side."""
    return df.filter(F.col(value).isNotNull()).groupBy("site").agg(
        F.min_by(value, F.col(order)).alias(value)
    )
