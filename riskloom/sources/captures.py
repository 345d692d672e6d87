"""Readers that bring captured inputs into the tables the jobs expect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.regex import matches

# ---- fixed values -------------------------------------------------------------------------

SKIPPED_DIRS = (
    "node_modules .git dist build .next .nuxt out coverage .vercel .turbo .cache vendor .svelte-kit"
).split()
SCANNED_EXTENSIONS = (
    ".js .ts .jsx .tsx .mjs .cjs .vue .svelte .astro .html .json .py .rb .go .php .java .yaml "
    ".yml .toml .sh"
).split()
SCANNED_NAMES = ["Dockerfile", "dockerfile", "Procfile"]
SAMPLE_ENV = r"\.env\.(example|sample|template)$"

# ---- end of fixed values ------------------------------------------------------------------


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def extension(path: Column) -> Column:
    """Extension with its dot; a leading dot is part of the name (``.env`` has none)."""
    return F.regexp_extract(base_name(path), r"^.+(\.[^.]*)\z", 1)


def is_real_env(path: Column) -> Column:
    base = base_name(path)
    return (base == ".env") | (base.startswith(".env") & ~matches(base, SAMPLE_ENV))


def file_class(path: Column) -> Column:
    """``migration``, ``source``, or null for files that are not scanned."""
    ext = extension(path)
    scanned = (
        ext.isin(SCANNED_EXTENSIONS) | base_name(path).isin(SCANNED_NAMES) | is_real_env(path)
    )
    return F.when(ext == ".sql", "migration").when(scanned, "source")


def read_source_tree(
    spark: SparkSession, root: str, repo_depth: int = 1, max_bytes: int | None = None
) -> DataFrame:
    """``(repo, path, size, content)`` of every text file below ``root``.

    The first ``repo_depth`` folders below the root name the repository. Name filters, and the
    size limit if one is given, come before ``content`` is decoded; Spark packs small files into shared
    partitions.
    Spark's file readers skip names that start with a dot or underscore; ``sources.tree`` reads them.
    """
    skipped = "|".join(d.replace(".", r"\.") for d in SKIPPED_DIRS)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    if max_bytes is not None:
        files = files.filter(F.col("length") <= max_bytes)
    clean_root = root.rstrip("/")
    below = F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), f"^.*?\\Q{clean_root}\\E/", "")
    parts = F.split(below, "/")
    return (
        files.withColumn("_below", below)
        .filter(~F.col("_below").rlike(f"(?:^|/)(?:{skipped})/"))
        .select(
            F.array_join(F.slice(parts, 1, repo_depth), "/").alias("repo"),
            F.array_join(F.slice(parts, repo_depth + 1, 1 << 30), "/").alias("path"),
            F.col("length").alias("size"),
            # Bytes that are no UTF-8 become replacement characters, as when read as text.
            F.expr("decode(content, 'UTF-8')").alias("content"),
        )
    )


def packed_tree(files: DataFrame) -> DataFrame:
    """``(repo, path, size, content)`` of files packed into a table, the skipped folders left out."""
    skipped = "|".join(d.replace(".", r"\.") for d in SKIPPED_DIRS)
    kept = files.filter(~F.col("path").rlike(f"(?:^|/)(?:{skipped})/"))
    return kept.select("repo", "path", F.octet_length("content").cast("long").alias("size"), "content")


def captured_responses(raw: DataFrame) -> DataFrame:
    """Headers as a map with lower-case names; accepts a JSON string or a map."""
    headers = F.col("headers")
    if raw.schema["headers"].dataType.typeName() == "string":
        headers = F.from_json(headers, "map<string,string>")
    lowered = F.transform_keys(headers, lambda k, _: F.lower(k))
    return raw.withColumn("headers", lowered)


def hook_payloads(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Adds ``event`` (variant). Text that is not a JSON object becomes ``{prompt: text}``.

    Arrays are objects to the specification but carry none of the keys read later, so they stay.
    """
    parsed = F.try_parse_json(F.col(payload))
    kind = F.schema_of_variant(parsed)
    structured = kind.startswith("OBJECT") | kind.startswith("ARRAY")
    wrapped = F.parse_json(F.to_json(F.struct(F.col(payload).alias("prompt"))))
    return raw.withColumn(
        "event", F.when(F.coalesce(structured, F.lit(False)), parsed).otherwise(wrapped)
    )
