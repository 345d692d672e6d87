"""Repository files: SQL migrations and back-end source patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.regex import located, matches
from riskloom.functions.text import collapse_spaces
from riskloom.sources.captures import base_name, is_real_env

# ---- fixed values -------------------------------------------------------------------------

SCHEMA = r"(?:[\"'`]?\w+[\"'`]?\s*\.\s*)?[\"'`]?(\w+)[\"'`]?"
CREATE_TABLE = r"create\s+table\s+(?:if\s+not\s+exists\s+)?" + SCHEMA
ENABLE_RLS = r"alter\s+table\s+(?:if\s+exists\s+)?(?:only\s+)?" + SCHEMA + r"\s+enable\s+row\s+level\s+security"
DISABLE_RLS = r"alter\s+table\s+(?:if\s+exists\s+)?(?:only\s+)?" + SCHEMA + r"\s+disable\s+row\s+level\s+security"
DROP_POLICY = r"drop\s+policy\s+(?:if\s+exists\s+)?(?:\"[^\"]+\"|'[^']+'|`[^`]+`|[\w-]+)\s+on\s+(?:only\s+)?" + SCHEMA
PERMISSIVE_POLICY = r"create\s+policy[\s\S]{0,240}?using\s*\(\s*true\s*\)"
SECURITY_DEFINER = r"security\s+definer"
GRANT_ANON = r"grant\s+([\w, ]+?)\s+on\s+(?:table\s+)?(?:public\.)?[\"'`]?(\w+)[\"'`]?\s+to\s+(anon|public)\b"
WRITES = r"\b(insert|update|delete|all)\b"
RLS_MODEL = r"enable\s+row\s+level\s+security|create\s+policy|\bto\s+(anon|authenticated)\b"
EVIDENCE_CHARS = 120

NEXT_CONFIG = r"(^|/)next\.config\.(js|ts|mjs|cjs)$"
HEADERS_CALL = r"headers\s*\("
HEADER_NAMES = r"(content-security-policy|x-frame-options|strict-transport-security)"
SERVER_ACTION = r"[\"']use server[\"']"
ROUTE_HANDLER = r"(^|/)route\.(t|j)sx?$"
MUTATION_CALL = r"\.(create|createMany|update|updateMany|upsert|delete|deleteMany)\s*\("
MUTATION_SQL = r"\b(insert|update|delete)\s+(into\s+)?[\"'`\w]"
AUTH_GUARD = r"require(User|Role|Auth|Admin|Session)|getServerSession|\bgetSession\b|\bauth\s*\(\)|currentUser|verifySession|\bgetUser\s*\(|assertAuth|checkAuth|authorize|isAuthenticated|ensureUser"
SPREADSHEET = r"exceljs|\bxlsx\b|sheetjs|csv-stringify|papaparse|json2csv"
SHEET_WRITE = r"\.addRow\s*\(|\.addRows\s*\(|aoa_to_sheet|json_to_sheet|writeBuffer|stringify\s*\("
SHEET_SAFE = r"formula|\\t|\bsanitiz|['\"`]'\s*\+|replace\(\s*/\^\[="

# ---- end of fixed values ------------------------------------------------------------------


def _events(files: DataFrame, pattern: str, groups: int, word: str) -> DataFrame:
    """Matches of a pattern with their line; files without the word never meet the pattern."""
    keys = [c for c in files.columns if c != "content"]
    return files.filter(F.lower("content").contains(word)).select(
        *keys, F.posexplode(located(F.col("content"), pattern, groups)).alias("k", "m")
    )


def _source(line: Column) -> Column:
    return F.concat_ws(":", "path", line.cast("string"))


def _per_table(files: DataFrame, pattern: str, word: str, prefix: str, severity: str) -> DataFrame:
    table = F.lower("m.g1")
    return _events(files, pattern, 1, word).select(
        "repo",
        F.concat(F.lit(prefix), table).alias("id"),
        F.lit(severity).alias("severity"),
        "path",
        F.col("m.line").alias("line"),
        collapse_spaces(F.col("m.match")).alias("evidence"),
    )


def rls_turned_off(files: DataFrame) -> DataFrame:
    return _per_table(files, DISABLE_RLS, "disable", "rls_turned_off_", "critical")


def policy_dropped(files: DataFrame) -> DataFrame:
    return _per_table(files, DROP_POLICY, "policy", "policy_dropped_", "medium")


def _per_match(files: DataFrame, pattern: str, word: str, id_: str, severity: str, evidence: Column) -> DataFrame:
    return _events(files, pattern, 0, word).select(
        "repo",
        F.lit(id_).alias("id"),
        F.lit(severity).alias("severity"),
        "path",
        F.col("m.line").alias("line"),
        evidence.alias("evidence"),
    )


def permissive_policy(files: DataFrame) -> DataFrame:
    evidence = F.left(collapse_spaces(F.col("m.match")), F.lit(EVIDENCE_CHARS))
    return _per_match(files, PERMISSIVE_POLICY, "policy", "permissive_policy", "critical", evidence)


def security_definer(files: DataFrame) -> DataFrame:
    return _per_match(
        files, SECURITY_DEFINER, "definer", "security_definer", "medium", F.lit("SECURITY DEFINER")
    )


def grant_anon(files: DataFrame) -> DataFrame:
    writes = matches(F.col("m.g1"), WRITES)
    return _events(files, GRANT_ANON, 3, "grant").select(
        "repo",
        F.concat(F.lit("grant_anon_"), F.lower("m.g2")).alias("id"),
        F.when(writes, "high").otherwise("medium").alias("severity"),
        "path",
        F.col("m.line").alias("line"),
        F.left(collapse_spaces(F.col("m.match")), F.lit(EVIDENCE_CHARS)).alias("evidence"),
    )


def create_table_events(files: DataFrame) -> DataFrame:
    return _events(files, CREATE_TABLE, 1, "create").select(
        "repo", "seq", F.col("k").alias("pos"), F.lower("m.g1").alias("table_name"), "path", F.col("m.line").alias("line")
    )


def enable_rls_events(files: DataFrame) -> DataFrame:
    return _events(files, ENABLE_RLS, 1, "enable").select(
        "repo", F.lower("m.g1").alias("table_name"), "path", F.col("m.line").alias("line")
    )


def repos_with_rls_model(files: DataFrame) -> DataFrame:
    return files.filter(matches(F.col("content"), RLS_MODEL)).select("repo").distinct()


def supabase_context(files: DataFrame) -> DataFrame:
    """``(repo, supabase)`` from file paths and scanned contents."""
    by_path = F.col("path").contains("supabase/")
    by_content = (
        ((base_name(F.col("path")) == "package.json") & F.col("content").contains("@supabase"))
        | F.col("content").contains(".supabase.co")
    )
    return files.groupBy("repo").agg(F.bool_or(by_path | by_content).alias("supabase"))


def tables_without_rls(sql_files: DataFrame, supabase_repos: DataFrame | None = None) -> DataFrame:
    """Tables created and never protected in repositories that use the RLS model.

    Reduced to one row per (repo, table) before any join, so a huge repository joins on its
    table names and not on one repository key. Order is ignored: one ENABLE anywhere counts.
    """
    created = create_table_events(sql_files).groupBy("repo", "table_name").agg(
        F.min_by(F.struct("path", "line"), F.struct("seq", "pos")).alias("at")
    )
    protected = enable_rls_events(sql_files).select("repo", "table_name").distinct()
    gate = repos_with_rls_model(sql_files)
    if supabase_repos is not None:
        gate = gate.unionByName(supabase_repos.select("repo")).distinct()
    return (
        created.join(protected, ["repo", "table_name"], "left_anti")
        .join(gate, "repo", "left_semi")
        .select(
            "repo",
            F.concat(F.lit("rls_disabled_"), F.col("table_name")).alias("id"),
            F.lit("high").alias("severity"),
            F.col("at.path").alias("path"),
            F.col("at.line").alias("line"),
            F.lit("no ENABLE ROW LEVEL SECURITY for this table in the repository").alias("evidence"),
        )
    )


def migration_findings(sql_files: DataFrame, supabase_repos: DataFrame | None = None) -> DataFrame:
    out = tables_without_rls(sql_files, supabase_repos)
    for job in (rls_turned_off, policy_dropped, permissive_policy, security_definer, grant_anon):
        out = out.unionByName(job(sql_files))
    return out


def _path_id(prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.regexp_replace("path", "[^A-Za-z0-9]", "_"))


def _file_finding(id_: Column, severity: str) -> list[Column]:
    return [F.col("repo"), id_.alias("id"), F.lit(severity).alias("severity"), F.col("path")]


def nextjs_no_security_headers(files: DataFrame) -> DataFrame:
    content = F.col("content")
    return files.filter(
        matches(F.col("path"), NEXT_CONFIG, False)
        & ~matches(content, HEADERS_CALL, False)
        & ~matches(content, HEADER_NAMES)
    ).select(*_file_finding(F.lit("nextjs_no_security_headers"), "medium"))


def unguarded_mutation(files: DataFrame) -> DataFrame:
    content = F.col("content")
    server_side = matches(F.col("path"), ROUTE_HANDLER, False) | matches(content, SERVER_ACTION, False)
    mutates = matches(content, MUTATION_CALL) | matches(content, MUTATION_SQL)
    return files.filter(server_side & mutates & ~matches(content, AUTH_GUARD)).select(
        *_file_finding(_path_id("unguarded_mutation_"), "high")
    )


def formula_injection(files: DataFrame) -> DataFrame:
    content = F.col("content")
    return files.filter(
        matches(content, SPREADSHEET)
        & matches(content, SHEET_WRITE, False)
        & ~matches(content, SHEET_SAFE)
    ).select(*_file_finding(_path_id("formula_injection_"), "medium"))


def committed_env_file(files: DataFrame) -> DataFrame:
    return files.filter(is_real_env(F.col("path"))).select(
        *_file_finding(F.lit("committed_env_file"), "high")
    )
