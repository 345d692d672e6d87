"""Site declarations: validation, what does not apply, what is silenced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.text import js_trim
from riskloom.rules import web as rules

# ---- fixed values -------------------------------------------------------------------------

SCHEMA_VERSION = "1"
KNOWN_KEYS = ["schemaVersion", "intent", "suppress"]
AI_CRAWLERS = ["open", "blocked"]
SITE_TYPES = ["website", "app", "internal"]

# ---- end of fixed values ------------------------------------------------------------------


def _kind(v: Column) -> Column:
    """``OBJECT``, ``ARRAY``, ``STRING`` … of a variant; null when the variant is null."""
    return F.regexp_extract(F.schema_of_variant(v), r"^(\w+)", 1)


def _get(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _text(v: Column) -> Column:
    """The value as text when it is a JSON string, else null."""
    return F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _shown(v: Column) -> Column:
    return F.coalesce(_text(v), F.to_json(v))


def parse_configs(raw: DataFrame) -> DataFrame:
    """``(site, ai_crawlers, site_type, suppress, warnings)``, one row per declaration.

    Nothing is dropped silently: each rejected value is a ``struct<kind,detail>`` warning.
    """
    root = raw.select("site", "json", F.try_parse_json("json").alias("root"))
    is_object = F.coalesce(_kind(F.col("root")) == "OBJECT", F.lit(False))
    obj = root.withColumn("_ok", is_object).withColumns(
        {
            "_version": F.when(F.col("_ok"), _get(F.col("root"), "$.schemaVersion")),
            "_intent": F.when(F.col("_ok"), _get(F.col("root"), "$.intent")),
            "_ai": F.when(F.col("_ok"), _get(F.col("root"), "$.intent.aiCrawlers")),
            "_type": F.when(F.col("_ok"), _get(F.col("root"), "$.intent.siteType")),
            "_suppress": F.when(F.col("_ok"), _get(F.col("root"), "$.suppress")),
            "_keys": F.when(F.col("_ok"), F.json_object_keys("json")),
        }
    )
    entries = F.transform(
        F.try_variant_get("_suppress", "$", "array<variant>"),
        lambda e: F.struct(
            F.nullif(_text(_get(e, "$.id")), F.lit("")).alias("id"),
            js_trim(F.coalesce(_text(_get(e, "$.reason")), F.lit(""))).alias("reason"),
        ),
    )
    no_entries = F.array().cast("array<struct<id:string,reason:string>>")
    c = F.col

    def warn(cond: Column, kind: str, detail: Column | str = "") -> Column:
        detail = F.lit(detail) if isinstance(detail, str) else detail
        return F.when(cond, F.struct(F.lit(kind).alias("kind"), detail.alias("detail")))

    rejected = F.transform(
        c("_entries"),
        lambda e: F.coalesce(
            warn(e["id"].isNull(), "suppress_without_id"),
            warn(e["reason"] == "", "suppress_without_reason", e["id"]),
            warn(~e["id"].isin(rules.CHECK_IDS), "not_suppressible", e["id"]),
        ),
    )
    unknown = F.transform(
        F.filter(
            F.coalesce("_keys", F.array().cast("array<string>")), lambda k: ~k.isin(KNOWN_KEYS)
        ),
        lambda k: F.struct(F.lit("unknown_key").alias("kind"), k.alias("detail")),
    )
    ai, kind = _text(c("_ai")), _text(c("_type"))
    has_intent = F.coalesce(_kind(c("_intent")) == "OBJECT", F.lit(False))
    single = F.array(
        warn(c("root").isNull(), "not_json"),
        warn(c("root").isNotNull() & ~c("_ok"), "not_an_object"),
        warn(c("_version").isNotNull() & (_shown(c("_version")) != SCHEMA_VERSION), "schema_version", _shown(c("_version"))),
        warn(c("_intent").isNotNull() & ~has_intent, "intent_not_object"),
        warn(c("_ai").isNotNull() & ~F.coalesce(ai.isin(AI_CRAWLERS), F.lit(False)), "ai_crawlers", _shown(c("_ai"))),
        warn(c("_type").isNotNull() & ~F.coalesce(kind.isin(SITE_TYPES), F.lit(False)), "site_type", _shown(c("_type"))),
        warn(c("_suppress").isNotNull() & (_kind(c("_suppress")) != "ARRAY"), "suppress_not_array"),
    )
    return (
        obj.withColumn("_entries", F.when(_kind(c("_suppress")) == "ARRAY", entries).otherwise(no_entries))
        .withColumn("_rejected", rejected)
        .select(
            "site",
            F.when(ai.isin(AI_CRAWLERS), ai).alias("ai_crawlers"),
            F.when(kind.isin(SITE_TYPES), kind).alias("site_type"),
            F.filter(
                c("_entries"),
                lambda e: e["id"].isNotNull() & (e["reason"] != "") & e["id"].isin(rules.CHECK_IDS),
            ).alias("suppress"),
            F.filter(F.concat(single, c("_rejected"), unknown), lambda w: w.isNotNull()).alias(
                "warnings"
            ),
        )
    )


def not_applicable(site_type: Column, ai_crawlers: Column) -> Column:
    """``map<check id, reason>``; the crawler reasons overwrite the site-type ones."""
    def entry(check: str, reason: str) -> Column:
        return F.struct(F.lit(check).alias("key"), F.lit(reason).alias("value"))

    none = F.array().cast("array<struct<key:string,value:string>>")
    by_crawlers = {
        True: ["web_robots_blocks_ai", "web_missing_llms_txt"],
        False: ["web_ai_block_incomplete"],
    }

    def by_type(blocked: bool) -> Column:
        out = None
        for kind, checks in rules.NOT_APPLICABLE_BY_SITE_TYPE.items():
            left = [ch for ch in checks if ch not in by_crawlers[blocked]]
            if not left:
                continue
            items = F.array(*[entry(ch, rules.SITE_TYPE_REASON[kind]) for ch in left])
            out = F.when(site_type == kind, items) if out is None else out.when(site_type == kind, items)
        return out.otherwise(none)

    def whole(blocked: bool) -> Column:
        reason = rules.REASON_BLOCKED if blocked else rules.REASON_OPEN
        own = F.array(*[entry(ch, reason) for ch in by_crawlers[blocked]])
        return F.map_from_entries(F.concat(by_type(blocked), own))

    return F.when(ai_crawlers == "blocked", whole(True)).otherwise(whole(False))


def suppress_map(suppress: Column) -> Column:
    """``map<check id, reason>``; the last entry for an id wins."""
    entries = F.coalesce(suppress, F.array().cast("array<struct<id:string,reason:string>>"))
    ids = F.array_distinct(F.transform(entries, lambda e: e["id"]))
    return F.map_from_arrays(
        ids,
        F.transform(
            ids,
            lambda i: F.try_element_at(F.filter(entries, lambda e: e["id"] == i), F.lit(-1))["reason"],
        ),
    )


def apply_suppressions(findings: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Adds ``suppressed_reason``; only web findings can have one.

    ``suppressions`` is ``(site, id, reason)`` with one row per pair.
    """
    rules_side = suppressions.select(
        F.col("site").alias("_site"), F.col("id").alias("_id"), F.col("reason").alias("suppressed_reason")
    )
    cond = (
        (F.col("site") == F.col("_site"))
        & (F.col("id") == F.col("_id"))
        & (F.coalesce(F.col("kind"), F.lit("security")) == "web")
    )
    return findings.join(rules_side, cond, "left").drop("_site", "_id")


def drop_not_applicable(findings: DataFrame, na: DataFrame) -> DataFrame:
    """``na`` is ``(site, id)``."""
    return findings.join(na.select("site", "id"), ["site", "id"], "left_anti")
