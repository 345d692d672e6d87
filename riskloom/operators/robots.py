"""robots.txt policies. One file per site, so a window over a site's lines is bounded by a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.regex import extract, matches
from riskloom.functions.text import js_trim
from riskloom.rules import web as rules

_FIELD = r"^([A-Za-z-]+)\s*:\s*([^\n]*)$"


def robots_lines(files: DataFrame) -> DataFrame:
    """``(site, pos, raw)`` of accepted robots files; a page served in its place is none."""
    policy = files.filter(
        F.col("robots_txt").isNotNull() & ~matches(F.col("robots_txt"), r"^\s*(<!doctype|<html)")
    )
    return policy.select(
        "site", F.posexplode(F.split("robots_txt", r"\r?\n")).alias("pos", "raw")
    )


def directives(lines: DataFrame) -> DataFrame:
    line = js_trim(F.split_part(F.col("raw"), F.lit("#"), F.lit(1)))
    return (
        lines.withColumn("_line", line)
        .filter(matches(F.col("_line"), _FIELD))
        .select(
            "site",
            "pos",
            F.lower(extract(F.col("_line"), _FIELD, 1)).alias("field"),
            js_trim(extract(F.col("_line"), _FIELD, 2)).alias("value"),
        )
    )


def robots_groups(lines: DataFrame) -> DataFrame:
    """Directives with their group. Neighbouring user-agent lines share one; ``sitemap`` and
    ``host`` lines do not come between; anything before the first agent belongs to none."""
    by_pos = Window.partitionBy("site").orderBy("pos")
    is_agent = F.col("field") == "user-agent"
    starts = is_agent & ~F.coalesce(F.lag(is_agent).over(by_pos), F.lit(False))
    return (
        directives(lines)
        .filter(~F.col("field").isin("sitemap", "host"))
        .withColumn("_starts", starts.cast("int"))
        .withColumn("group_id", F.sum("_starts").over(by_pos).cast("int"))
        .filter(F.col("group_id") > 0)
        .select("site", "group_id", "pos", "field", "value")
    )


def agent_blocks(groups: DataFrame) -> DataFrame:
    """``(site, agent, blocks)`` over the union of all groups that name the agent."""
    root = (F.col("field") == "disallow") & F.col("value").rlike(r"^/\**\z")
    reopened = (F.col("field") == "allow") & F.col("value").startswith("/")
    per_group = groups.groupBy("site", "group_id").agg(
        F.collect_set(F.when(F.col("field") == "user-agent", F.lower("value"))).alias("agents"),
        F.bool_or(root).alias("root"),
        F.bool_or(reopened).alias("reopened"),
    )
    return (
        per_group.select("site", F.explode("agents").alias("agent"), "root", "reopened")
        .groupBy("site", "agent")
        .agg((F.bool_or("root") & ~F.bool_or("reopened")).alias("blocks"))
    )


def managed_lines(lines: DataFrame) -> DataFrame:
    """Lines with ``inside``: between the begin and end markers a CDN writes."""
    by_pos = Window.partitionBy("site").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    raw = js_trim(F.col("raw"))
    marker = F.when(matches(raw, rules.MANAGED_BEGIN), "begin").when(
        matches(raw, rules.MANAGED_END), "end"
    )
    return (
        lines.withColumn("_marker", marker)
        .withColumn("_last", F.last("_marker", ignorenulls=True).over(by_pos))
        .select(
            "site",
            "pos",
            "raw",
            (F.col("_marker").isNull() & F.coalesce(F.col("_last") == "begin", F.lit(False))).alias(
                "inside"
            ),
        )
    )


def managed_agents(lines: DataFrame) -> DataFrame:
    agent_line = r"^user-agent\s*:\s*([^\n]+)$"
    raw = js_trim(F.col("raw"))
    return (
        managed_lines(lines)
        .filter(F.col("inside") & matches(raw, agent_line))
        .select("site", F.lower(js_trim(extract(raw, agent_line, 1))).alias("agent"))
        .distinct()
    )


def robots_verdicts(files: DataFrame) -> DataFrame:
    """One row per site with a policy: blocked bots, the agents that block them, managed cover.

    The per-site map has one entry per agent its file names, so it is bounded by the file.
    """
    lines = robots_lines(files)
    per_agent = agent_blocks(robots_groups(lines)).groupBy("site").agg(
        F.map_from_entries(F.collect_list(F.struct("agent", "blocks"))).alias("by_agent")
    )
    managed = managed_agents(lines).groupBy("site").agg(F.collect_set("agent").alias("managed"))

    wildcard = F.coalesce(F.try_element_at("by_agent", F.lit("*")), F.lit(False))
    bots = F.array(
        *[
            F.struct(
                F.lit(bot).alias("bot"),
                F.try_element_at("by_agent", F.lit(bot.lower())).alias("own"),
            )
            for bot in rules.AI_BOTS
        ]
    )
    shut = F.filter(F.col("_bots"), lambda b: F.coalesce(b["own"], F.col("_wildcard")))
    named = F.filter(F.col("_bots"), lambda b: F.coalesce(b["own"], F.lit(False)))
    via = F.size(F.col("bots")) > F.size(F.col("named"))
    inside = F.size(
        F.filter(
            F.col("blocking_agents"),
            lambda a: F.array_contains(F.coalesce("managed", F.array().cast("array<string>")), F.lower(a)),
        )
    )
    return (
        per_agent.withColumn("_wildcard", wildcard)
        .withColumn("_bots", bots)
        .withColumn("bots", F.transform(shut, lambda b: b["bot"]))
        .withColumn("named", F.transform(named, lambda b: b["bot"]))
        .withColumn("via_wildcard", F.col("_wildcard") & via)
        .withColumn(
            "blocking_agents",
            F.when(F.col("via_wildcard"), F.concat("named", F.array(F.lit("*")))).otherwise(
                F.col("named")
            ),
        )
        .join(managed, "site", "left")
        .withColumn("_inside", inside)
        .withColumn(
            "managed_covers",
            F.when(F.col("_inside") == 0, "none")
            .when(F.col("_inside") == F.size("blocking_agents"), "all")
            .otherwise("some"),
        )
        .select("site", "bots", "named", "via_wildcard", "blocking_agents", "managed_covers")
    )


def open_bots(bots):
    """Watched crawlers that are not in the blocked list."""
    return F.array_except(F.array(*[F.lit(b) for b in rules.AI_BOTS]), bots)
