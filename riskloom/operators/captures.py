"""Checks over captured HTTP responses: site files, headers, transport, bundles, backends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.html import starts_like_html
from riskloom.functions.regex import extract, extract_or_null, matches
from riskloom.functions.text import page_outline, same_outline
from riskloom.functions.urls import absolutize
from riskloom.rules import web as rules

# ---- fixed values -------------------------------------------------------------------------

# (header, severity, cwe)
EXPECTED_HEADERS = [
    ("content-security-policy", "medium", "CWE-693"),
    ("strict-transport-security", "low", "CWE-319"),
    ("x-frame-options", "low", "CWE-1021"),
    ("x-content-type-options", "low", "CWE-430"),
]
LEAKY_HEADERS = ["x-powered-by", "server"]
LEAKY_ALLOWED = r"^(cloudflare|vercel)$"
MAX_HOPS = 3
SOURCE_MAP_REF = r"//[#@]\s*sourceMappingURL=([^\s'\"]+)"
FIREBASE_KEY = r"AIza[0-9A-Za-z_-]{35}"
FIREBASE_PROJECT = r"[\"']?projectId[\"']?\s*[:=]\s*[\"']([a-z0-9-]+)[\"']"
FIREBASE_DATABASE = r"[\"']?databaseURL[\"']?\s*[:=]\s*[\"'](https://[^\"']+?(?:firebaseio\.com|firebasedatabase\.app))[\"']"
FIREBASE_BUCKET = r"[\"']?storageBucket[\"']?\s*[:=]\s*[\"']([a-z0-9.-]+\.(?:appspot\.com|firebasestorage\.app))[\"']"
SENSITIVE_COLUMNS = (
    "email phone password password_hash hashed_password stripe_customer_id stripe_id api_key apikey "
    "secret token access_token refresh_token ssn dni credit_card card_number address full_name "
    "first_name last_name date_of_birth birthdate ip_address"
).split()

# ---- end of fixed values ------------------------------------------------------------------


def is_html(row_headers: Column, body: Column) -> Column:
    type_ = F.coalesce(F.try_element_at(row_headers, F.lit("content-type")), F.lit(""))
    return matches(type_, "text/html") | F.coalesce(starts_like_html(body), F.lit(False))


def site_files(responses: DataFrame) -> DataFrame:
    """Well-known files per site. A 200 whose body opens like a page counts as missing."""
    role, status, body = F.col("role"), F.col("status"), F.col("body")
    served = (status == 200) & ~F.coalesce(starts_like_html(body), F.lit(False))

    order = F.struct("hop", "url")

    def first(condition: Column, value: Column) -> Column:
        """Of several captures of one role the first one counts."""
        return F.min_by(F.when(condition, value), F.when(condition, order))

    # Only the outlines of the two pages compared leave the map side, not the pages.
    outlined = F.when(role.isin("home", "notfound"), page_outline(body))
    picked = responses.filter(role.isin("home", "robots", "llms", "sitemap", "favicon", "notfound"))
    probe = F.struct("status", F.col("_outline").alias("outline"))
    return (
        picked.withColumn("_outline", outlined)
        .withColumn("_icon", (role == "favicon") & (status == 200) & ~is_html(F.col("headers"), body))
        .withColumn("_served", served)
        .withColumn("body", F.when(role.isin("robots", "llms", "sitemap"), body))
        .groupBy("site")
        .agg(
            *[
                first((role == name) & F.col("_served"), F.col("body")).alias(alias)
                for name, alias in (("robots", "robots_txt"), ("llms", "llms_txt"), ("sitemap", "sitemap_xml"))
            ],
            F.coalesce(F.bool_or("_icon"), F.lit(False)).alias("favicon_ok"),
            first(role == "notfound", probe).alias("_probe"),
            first(role == "home", F.col("_outline")).alias("_home"),
        )
        .withColumn("notfound_status", F.coalesce("_probe.status", F.lit(0)))
        .withColumn(
            "notfound_distinct",
            (F.col("notfound_status") == 0)
            | (F.col("notfound_status") >= 400)
            | ~F.coalesce(same_outline(F.col("_probe.outline"), F.col("_home")), F.lit(False)),
        )
        .drop("_home", "_probe")
    )


def missing_headers(responses: DataFrame) -> DataFrame:
    expected = F.array(
        *[
            F.struct(F.lit(h).alias("header"), F.lit(s).alias("severity"), F.lit(c).alias("cwe"))
            for h, s, c in EXPECTED_HEADERS
        ]
    )
    absent = F.filter(
        expected,
        lambda e: F.coalesce(F.try_element_at(F.col("headers"), e["header"]), F.lit("")) == "",
    )
    return (
        responses.filter(F.col("role") == "home")
        .select("site", F.inline(absent))
        .select(
            "site", F.concat(F.lit("missing_header_"), F.col("header")).alias("id"), "severity", "cwe"
        )
    )


def leaky_headers(responses: DataFrame) -> DataFrame:
    return (
        responses.filter(F.col("role") == "home")
        .select("site", F.explode("headers").alias("header", "value"))
        .filter(
            F.col("header").isin(LEAKY_HEADERS)
            & (F.col("value") != "")
            & ~matches(F.col("value"), LEAKY_ALLOWED)
        )
        .select(
            "site",
            F.concat(F.lit("leaky_header_"), F.col("header")).alias("id"),
            F.lit("low").alias("severity"),
            F.concat_ws(": ", "header", "value").alias("evidence"),
        )
    )


def _answers(responses: DataFrame) -> DataFrame:
    """``(site, url, status, location)``: what each plain-HTTP address answered, by the address asked.

    Captures of one chain under its first address, told apart by ``hop``, get the address that the hop before
    named. An address captured several times counts once.
    """
    chain = Window.partitionBy("site", "url").orderBy("hop")
    named = F.when(F.col("hop") > 0, F.lag("location").over(chain))
    asked = responses.filter(F.col("role") == "plain_http").select(
        "site", F.coalesce(named, F.col("url")).alias("url"), F.coalesce("status", F.lit(0)).alias("status"), "location"
    )
    return asked.groupBy("site", "url").agg(F.min(F.struct("status", "location")).alias("a")).select("site", "url", "a.*")


def redirect_hops(responses: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """Where a plain-HTTP request for each site's root ended: upgraded, served or unavailable.

    Captures may come in any order: each step looks up the address that the last answer named. An address that
    was not captured is unavailable. A chain that is still plain after ``max_hops`` answers, a loop among them,
    is served.
    """
    answers = _answers(responses)
    root = F.concat(F.lit("http://"), "site", F.lit("/"))
    live = answers.filter(F.col("url") == root).select(
        "site", "url", F.col("url").alias("_at"), F.lit(None).cast("string").alias("verdict"),
        F.lit(0).alias("status"), F.lit(0).alias("redirects"),
    )
    named = answers.select(
        F.col("site").alias("_site"), F.col("url").alias("_url"), F.col("status").alias("_status"), F.col("location").alias("_to")
    )
    for hop in range(max_hops):
        open_ = F.col("verdict").isNull()
        asked = open_ & (F.col("site") == F.col("_site")) & (F.col("_at") == F.col("_url"))
        got = F.coalesce("_status", F.lit(0))
        redirect = got.between(300, 399) & F.coalesce(F.col("_to") != "", F.lit(False))
        secure = redirect & F.col("_to").startswith("https://")
        ended = (
            F.when(secure, "upgraded").when(redirect, F.lit(None))
            .when((got == 0) | (got >= 400), "unavailable").otherwise("served")
        )
        live = live.join(named, asked, "left").select(
            "site",
            "url",
            F.when(open_ & ended.isNull(), F.col("_to")).alias("_at"),
            F.when(open_, ended).otherwise(F.col("verdict")).alias("verdict"),
            F.when(open_ & ended.isNotNull(), got).otherwise(F.col("status")).alias("status"),
            F.when(open_, F.when(ended.isNull(), hop + 1).otherwise(hop)).otherwise(F.col("redirects")).alias("redirects"),
        )
    return live.select("site", "url", F.coalesce("verdict", F.lit("served")).alias("verdict"), "status", "redirects")


def plain_http_served(responses: DataFrame) -> DataFrame:
    return (
        redirect_hops(responses)
        .filter(F.col("verdict") == "served")
        .select(
            "site",
            F.lit("plain_http_no_redirect").alias("id"),
            F.lit("medium").alias("severity"),
            F.col("url").alias("source"),
            "status",
            "redirects",
        )
    )


def ranked_bundles(responses: DataFrame, extra: list[Column]) -> DataFrame:
    """The answered bundles of each site in load order. Only the named columns travel."""
    order = Window.partitionBy("site").orderBy("hop", "url")
    return (
        responses.filter((F.col("role") == "bundle") & F.col("status").between(200, 299))
        .select("site", "hop", "url", *extra)
        .withColumn("rank", F.row_number().over(order))
    )


def js_bytes(responses: DataFrame) -> DataFrame:
    answered = responses.filter((F.col("role") == "bundle") & F.col("status").between(200, 299))
    size = F.octet_length("body").cast("long")
    return answered.groupBy("site").agg(F.sum(size).alias("js_bytes"), F.count("*").alias("bundles"))


def source_map_url(body: Column, url: Column) -> Column:
    ref = extract(body, SOURCE_MAP_REF, 1, ignore_case=False)
    return F.when((ref != "") & ~ref.startswith("data:"), absolutize(ref, url))


def source_maps(responses: DataFrame) -> DataFrame:
    """Every bundle's map that is served and reads like one, with its bundle rank.

    Map bodies are judged where they are read; the join moves two flags, not the bodies.
    """
    map_url = source_map_url(F.col("body"), F.col("url")).alias("map_url")
    bundles = ranked_bundles(responses, [map_url]).filter(
        F.col("map_url").isNotNull()
    )
    body = F.col("body")
    maps = responses.filter(
        (F.col("role") == "sourcemap")
        & F.col("status").between(200, 299)
        & matches(body, r"\"(?:mappings|sources)\"\s*:", False)
    ).select(
        "site",
        F.col("url").alias("map_url"),
        matches(body, r"\"sourcesContent\"\s*:\s*\[", False).alias("embeds_source"),
    )
    return bundles.join(maps.distinct(), ["site", "map_url"]).select(
        "site", "rank", "map_url", "embeds_source"
    )


def source_map_exposed(responses: DataFrame) -> DataFrame:
    """At most one per site: the earliest bundle whose map is served."""
    file_name = F.regexp_extract("m.map_url", r"([^/]*)\z", 1)
    return (
        source_maps(responses)
        .groupBy("site")
        .agg(F.min_by(F.struct("map_url", "embeds_source"), F.col("rank")).alias("m"))
        .select(
            "site",
            F.concat(F.lit("sourcemap_exposed_"), F.regexp_replace(file_name, "[^A-Za-z0-9]", "_")).alias("id"),
            F.lit("medium").alias("severity"),
            F.col("m.map_url").alias("source"),
            F.col("m.embeds_source").alias("embeds_source"),
        )
    )


def shared_source_maps(responses: DataFrame) -> DataFrame:
    """Map file names exposed on more than one site."""
    return (
        source_maps(responses)
        .select("site", F.regexp_extract("map_url", r"([^/]*)\z", 1).alias("file_name"))
        .distinct()
        .groupBy("file_name")
        .agg(F.count("*").alias("sites"))
        .filter(F.col("sites") > 1)
    )


def firebase_config(text: Column) -> Column:
    """``struct<project_id,database_url,storage_bucket>``; null without an API key beside it."""
    config = F.struct(
        extract_or_null(text, FIREBASE_PROJECT).alias("project_id"),
        extract_or_null(text, FIREBASE_DATABASE).alias("database_url"),
        extract_or_null(text, FIREBASE_BUCKET).alias("storage_bucket"),
    )
    some = matches(text, FIREBASE_PROJECT) | matches(text, FIREBASE_DATABASE) | matches(text, FIREBASE_BUCKET)
    return F.when(matches(text, FIREBASE_KEY, False) & some, config)


def rtdb_bases(config: Column) -> Column:
    database = F.regexp_replace(config["database_url"], r"/\z", "")
    project = config["project_id"]
    return (
        F.when(config["database_url"].isNotNull(), F.array(database))
        .when(
            project.isNotNull(),
            F.array(
                F.concat(F.lit("https://"), project, F.lit("-default-rtdb.firebaseio.com")),
                F.concat(F.lit("https://"), project, F.lit(".firebaseio.com")),
            ),
        )
        .otherwise(F.array().cast("array<string>"))
    )


def firebase_rtdb_open(configs: DataFrame, responses: DataFrame) -> DataFrame:
    """``configs`` is ``(site, config)``. The first base that answers openly is reported."""
    bases = configs.select("site", F.posexplode(rtdb_bases(F.col("config"))).alias("rank", "base"))
    answers = responses.filter(
        (F.col("role") == "rtdb")
        & F.col("status").between(200, 299)
        & ~F.coalesce(F.col("body").contains('"error"'), F.lit(False))
    ).select(
        "site",
        F.regexp_replace("url", r"/\.json\?shallow=true\z", "").alias("base"),
        (F.trim("body") == "null").alias("empty"),
    )
    return (
        bases.join(answers, ["site", "base"])
        .groupBy("site")
        .agg(F.min_by(F.struct("base", "empty"), F.col("rank")).alias("hit"))
        .select(
            "site",
            F.lit("firebase_rtdb_open").alias("id"),
            F.when(F.col("hit.empty"), "high").otherwise("critical").alias("severity"),
            F.concat(F.col("hit.base"), F.lit("/.json")).alias("source"),
        )
    )


def firebase_storage_open(configs: DataFrame, responses: DataFrame) -> DataFrame:
    prefix = "https://firebasestorage.googleapis.com/v0/b/"
    open_ = responses.filter((F.col("role") == "storage") & F.col("status").between(200, 299)).select(
        "site", F.regexp_extract("url", r"/v0/b/([^/]+)/o", 1).alias("bucket")
    ).distinct()
    buckets = configs.select("site", F.col("config.storage_bucket").alias("bucket")).filter(
        F.col("bucket").isNotNull()
    )
    return buckets.join(open_, ["site", "bucket"]).select(
        "site",
        F.lit("firebase_storage_open").alias("id"),
        F.lit("high").alias("severity"),
        F.concat(F.lit(prefix.removeprefix("https://")), F.col("bucket"), F.lit("/o")).alias("source"),
    )


def graphql_introspection(responses: DataFrame) -> DataFrame:
    body = F.col("body")
    return responses.filter(
        (F.col("role") == "graphql")
        & F.col("status").between(200, 299)
        & matches(body, r"\"__schema\"|\"queryType\"", False)
        & matches(body, r"\"data\"\s*:", False)
    ).select(
        "site", F.lit("graphql_introspection").alias("id"), F.lit("medium").alias("severity"), F.col("url").alias("source")
    )


def openapi_table_names(body: Column) -> Column:
    """Keys of ``definitions`` and single-segment ``paths``, each once; empty for other bodies."""
    none = F.array().cast("array<string>")
    definitions = F.coalesce(F.json_object_keys(F.get_json_object(body, "$.definitions")), none)
    paths = F.coalesce(F.json_object_keys(F.get_json_object(body, "$.paths")), none)
    names = F.filter(
        F.transform(paths, lambda p: F.regexp_replace(p, "^/", "")),
        lambda n: (n != "") & ~n.contains("/"),
    )
    return F.array_union(definitions, names)


def openapi_tables(responses: DataFrame) -> DataFrame:
    return responses.filter(F.col("role") == "openapi").select(
        "site", F.explode(openapi_table_names(F.col("body"))).alias("table_name")
    )


def sensitive_columns(names: Column) -> Column:
    pattern = "|".join(SENSITIVE_COLUMNS)
    return F.filter(names, lambda n: F.lower(n).rlike(pattern))


def table_probes(responses: DataFrame) -> DataFrame:
    """Captured table reads classified, with the columns of the one row that was read."""
    status, body = F.col("status"), F.col("body")
    range_ = F.try_element_at("headers", F.lit("content-range"))
    total = F.split_part(range_, F.lit("/"), F.lit(2))
    rows = F.from_json(body, "array<map<string,string>>")
    readable = (F.col("outcome") == "exposed") & (F.coalesce(F.size(F.col("_rows")), F.lit(0)) > 0)
    first = F.map_keys(F.get(F.col("_rows"), F.lit(0)))
    return (
        responses.filter(F.col("role") == "table")
        .withColumn(
            "outcome",
            F.when((status == 0) | ((status == 200) & F.try_parse_json(body).isNull()), "error")
            .when(status == 200, "exposed")
            .when(status == 404, "absent")
            .otherwise("protected"),
        )
        .withColumn("_rows", F.when(F.col("outcome") == "exposed", rows))
        .withColumn("readable", F.coalesce(readable, F.lit(False)))
        .withColumn("_names", F.when(F.col("readable"), first))
        .select(
            "site",
            F.regexp_extract("url", r"/rest/v1/([^/?]+)", 1).alias("table_name"),
            F.regexp_replace("url", r"\?.*\z", "").alias("source"),
            "outcome",
            "readable",
            F.when(F.col("outcome") == "exposed", total.try_cast("bigint")).alias("rows_total"),
            F.coalesce(F.size("_names"), F.lit(0)).alias("n_columns"),
            F.coalesce(sensitive_columns(F.col("_names")), F.array().cast("array<string>")).alias("leaked_columns"),
            F.when(F.col("readable"), body).alias("row_json"),
        )
    )


def write_probes(responses: DataFrame) -> DataFrame:
    status = F.col("status")
    return responses.filter(F.col("role") == "write").select(
        "site",
        F.regexp_extract("url", r"/rest/v1/([^/?]+)", 1).alias("table_name"),
        F.when(status.isin(401, 403), "blocked")
        .when(status.between(200, 299), "writable")
        .otherwise("inconclusive")
        .alias("write"),
    )


def rls_exposed(probes: DataFrame) -> DataFrame:
    pii = F.size("leaked_columns") > 0
    return probes.filter("readable").select(
        "site",
        F.concat(F.lit("rls_exposed_"), F.col("table_name")).alias("id"),
        F.when(pii, "critical").otherwise("high").alias("severity"),
        "source",
        F.concat(
            F.coalesce(F.col("rows_total").cast("string"), F.lit("?")),
            F.lit(" rows readable with the public key"),
            F.when(pii, F.concat(F.lit("; sensitive columns: "), F.array_join("leaked_columns", ", "))).otherwise(""),
        ).alias("evidence"),
    )


def rls_writable(probes: DataFrame, writes: DataFrame) -> DataFrame:
    return (
        probes.filter("readable")
        .join(writes.filter(F.col("write") == "writable"), ["site", "table_name"])
        .select(
            "site",
            F.concat(F.lit("rls_writable_"), F.col("table_name")).alias("id"),
            F.lit("critical").alias("severity"),
            "source",
        )
    )


def rls_rollup(probes: DataFrame, writes: DataFrame, enumerated: DataFrame) -> DataFrame:
    """Per project: probed, enumerated, exposed, with personal data, writable."""
    listed = enumerated.groupBy("site").agg(F.count("*").alias("enumerated"))
    readable = F.col("readable")
    return (
        probes.join(writes, ["site", "table_name"], "left")
        .groupBy("site")
        .agg(
            F.count("*").alias("probed"),
            F.count_if(readable).alias("exposed"),
            F.count_if(readable & (F.size("leaked_columns") > 0)).alias("with_pii"),
            F.count_if(readable & F.coalesce(F.col("write") == "writable", F.lit(False))).alias("writable"),
        )
        .join(listed, "site", "left")
        .withColumn("enumerated", F.coalesce("enumerated", F.lit(0)))
    )
