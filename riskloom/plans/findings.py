"""The findings table and the reports over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.rules import catalog
from riskloom.sources.tables import dimension

COLUMNS = ["target", "ord", "id", "kind", "severity", "source", "line", "evidence"]


def as_findings(df: DataFrame, target: str, ord_: int, kind: str = "security") -> DataFrame:
    """A family's output in the common shape; columns a family lacks are null."""
    have = set(df.columns)

    def col(name: str, type_: str) -> Column:
        return (F.col(name) if name in have else F.lit(None)).cast(type_).alias(name)

    source = F.col("source") if "source" in have else (F.col("path") if "path" in have else F.lit(None))
    return df.select(
        F.col(target).alias("target"),
        F.lit(ord_).alias("ord"),
        "id",
        F.lit(kind).alias("kind"),
        "severity",
        source.cast("string").alias("source"),
        col("line", "int"),
        col("evidence", "string"),
    )


def all_findings(families: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """Union of ``(family, target column, kind)`` in report order."""
    out = None
    for ord_, (df, target, kind) in enumerate(families):
        part = as_findings(df, target, ord_, kind)
        out = part if out is None else out.unionByName(part)
    return out


def rule_of(id_: Column) -> Column:
    """The rule behind an id: ids of some rules end in a table, path, header or file name."""
    out = None
    for prefix in catalog.PREFIXES:
        cond = id_.startswith(prefix)
        out = F.when(cond, prefix) if out is None else out.when(cond, prefix)
    return out.otherwise(id_)


def severity_rank(severity: Column) -> Column:
    out = None
    for rank, name in enumerate(catalog.SEVERITIES):
        out = F.when(severity == name, rank) if out is None else out.when(severity == name, rank)
    return out


def severity_counts(findings: DataFrame) -> DataFrame:
    kind = F.coalesce("kind", F.lit("security")).alias("kind")
    return findings.groupBy("target", kind).agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in catalog.SEVERITIES]
    )


def verdicts(findings: DataFrame) -> DataFrame:
    """``(target, verdict, gate_fails)`` from security findings only; web findings never gate."""
    security = F.coalesce("kind", F.lit("security")) == "security"
    worst = F.min(F.when(security, severity_rank(F.col("severity"))))
    return (
        findings.groupBy("target")
        .agg(worst.alias("worst"))
        .select(
            "target",
            F.when(F.col("worst") == 0, "critical")
            .when(F.col("worst") == 1, "high")
            .when(F.col("worst") >= 2, "medium")
            .otherwise(catalog.VERDICT_CLEAN)
            .alias("verdict"),
            F.coalesce(F.col("worst") == 0, F.lit(False)).alias("gate_fails"),
        )
    )


def findings_by_severity(findings: DataFrame) -> DataFrame:
    """A report's order: a range sort over the whole table, critical first within a target."""
    return findings.orderBy("target", severity_rank(F.col("severity")), "ord", "source", "line", "id")


def prevalence(findings: DataFrame, targets: DataFrame) -> DataFrame:
    """Per id: targets affected and their share of all targets."""
    total = targets.agg(F.count_distinct("target").alias("n"))
    affected = findings.select("id", "target").distinct().groupBy("id").agg(
        F.count("*").alias("affected")
    )
    return affected.withColumn("scanned", total.scalar()).withColumn(
        "share", F.round(F.col("affected") / F.col("scanned"), 4)
    )


def localize(findings: DataFrame, spark: SparkSession, lang: str = "en") -> DataFrame:
    """Adds check, weakness, label and why. Spanish falls back to English field by field."""
    rules = dimension(spark, catalog.RULES, catalog.SCHEMA)
    texts = {
        name: F.coalesce(f"{name}_es", name) if lang == "es" else F.col(name)
        for name in ("label", "why")
    }
    side = rules.select(
        F.col("rule").alias("_rule"), "check_no", "cwe", *[c.alias(n) for n, c in texts.items()]
    )
    return (
        findings.withColumn("_rule", rule_of(F.col("id"))).join(F.broadcast(side), "_rule", "left").drop("_rule")
    )


# ---- sinks ----------------------------------------------------------------------------------


def sarif_results(localized: DataFrame, *extra: str) -> DataFrame:
    """One result per security finding; ``path`` and line apart, an address kept whole."""
    level = None
    for severity, name in catalog.SARIF_LEVEL.items():
        cond = F.col("severity") == severity
        level = F.when(cond, name) if level is None else level.when(cond, name)
    return localized.filter(F.coalesce("kind", F.lit("security")) != "web").select(
        "target",
        F.col("id").alias("rule_id"),
        level.alias("level"),
        F.col("source").alias("uri"),
        F.when(~F.coalesce(F.col("source").rlike("(?i)^https?:"), F.lit(False)), F.col("line")).alias("start_line"),
        F.concat_ws(". ", "label", "why").alias("message"),
        *extra,
    )


def sarif_rules(localized: DataFrame) -> DataFrame:
    """Rule metadata from the first finding of each id."""
    first = F.struct("ord", "target", "source", "line")
    return (
        localized.filter(F.coalesce("kind", F.lit("security")) != "web")
        .groupBy("id")
        .agg(F.min_by(F.struct("label", "why"), first).alias("m"))
        .select(F.col("id").alias("rule_id"), "m.label", "m.why")
    )


#: Results a SARIF document holds, about: large targets have several documents.
SARIF_RESULTS = 1000
SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"


def sarif_documents(localized: DataFrame, results: int = SARIF_RESULTS) -> DataFrame:
    """``(target, part, document)``: valid SARIF 2.1.0 with one run, its results and each of their rules once.

    Results of a large target are dealt over documents by a hash, so no task holds more than a document's.
    """
    found = sarif_results(localized.withColumn("_label", F.col("label")).withColumn("_why", F.col("why")), "_label", "_why")
    sizes = found.groupBy("target").agg(F.ceil(F.count("*") / F.lit(results)).alias("_parts"))
    named = sizes.select(F.col("target").alias("_target"), "_parts")
    text = F.coalesce(F.nullif("message", F.lit("")), F.col("rule_id"))
    part = F.pmod(F.xxhash64("rule_id", "uri", "start_line", "message"), F.col("_parts"))
    place = F.struct(
        F.struct(F.col("uri").alias("uri")).alias("artifactLocation"),
        F.when(F.col("start_line").isNotNull(), F.struct(F.col("start_line").alias("startLine"))).alias("region"),
    )
    location = F.when(F.col("uri").isNotNull(), F.array(F.struct(place.alias("physicalLocation"))))
    result = F.struct(
        F.col("rule_id").alias("ruleId"), "level", F.struct(text.alias("text")).alias("message"), location.alias("locations")
    )
    name = F.coalesce("_label", F.col("rule_id"))
    rule = F.struct(
        F.col("rule_id").alias("id"), name.alias("name"), F.struct(name.alias("text")).alias("shortDescription"),
        F.struct(F.coalesce("_why", name).alias("text")).alias("fullDescription"),
    )
    runs = (
        found.join(named, F.col("target") == F.col("_target"))
        .groupBy("target", part.alias("part"))
        .agg(F.array_sort(F.collect_list(result)).alias("results"), F.array_sort(F.collect_set(rule)).alias("rules"))
    )
    tool = F.struct(F.struct(F.lit("riskloom").alias("name"), F.lit(str(SCHEMA_VERSION)).alias("version"), "rules").alias("driver"))
    document = F.struct(
        F.lit(SARIF_SCHEMA).alias("$schema"),
        F.lit("2.1.0").alias("version"),
        F.array(F.struct(tool.alias("tool"), "results")).alias("runs"),
    )
    return runs.select("target", "part", F.to_json(document).alias("document"))


def write_sarif(localized: DataFrame, path: str) -> None:
    """One document a line, in as many files as the session's shuffle gives."""
    sarif_documents(localized).select("document").write.mode("overwrite").text(path)


SCHEMA_VERSION = 1


def payloads(findings: DataFrame, sections: dict[str, DataFrame] | None = None) -> DataFrame:
    """``(target, document)``: JSON lines, a header per target, a line per finding, and lines of other sections.

    The header has the verdict and the counts. ``sections`` names tables with a ``target`` whose rows become
    lines of their own: what was suppressed and why, fingerprints, probed tables. However many findings a
    target has, none are gathered. ``findings`` is read several times, so pass a written table.
    """
    counts = severity_counts(findings)
    per_kind = {
        name: counts.filter(F.col("kind") == kind).select("target", F.struct(*catalog.SEVERITIES).alias(name))
        for kind, name in (("security", "counts"), ("web", "web_counts"))
    }
    head = verdicts(findings).join(findings.groupBy("target").agg(F.count("*").alias("findings")), "target")
    for part in per_kind.values():
        head = head.join(part, "target", "left")
    header = F.struct(
        F.lit("header").alias("row"), F.lit(SCHEMA_VERSION).alias("schemaVersion"),
        "target", "verdict", "gate_fails", "findings", "counts", "web_counts",
    )
    line = F.struct(F.lit("finding").alias("row"), "target", "ord", "id", "kind", "severity", "source", "line", "evidence")
    out = head.select("target", F.to_json(header).alias("document")).unionByName(
        findings.select("target", F.to_json(line).alias("document"))
    )
    for name, rows in (sections or {}).items():
        row = F.struct(F.lit(name).alias("row"), *rows.columns)
        out = out.unionByName(rows.select("target", F.to_json(row).alias("document")))
    return out


def write_payloads(findings: DataFrame, path: str, sections: dict[str, DataFrame] | None = None) -> None:
    payloads(findings, sections).select("document").write.mode("overwrite").text(path)
