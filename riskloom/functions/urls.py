"""URL resolution as column expressions, following the WHATWG rules that matter for crawling.

International host names become their ``xn--`` form, by the Unicode mapping of the JVM (IDNA 2003: ``ß`` is
``ss``); a host that has none makes no URL. Not covered: credentials in the authority, percent-decoding.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.functions.expr import let, record
from riskloom.functions.text import js_trim

# ---- fixed values -------------------------------------------------------------------------

ASSET_EXTENSIONS = (
    "pdf jpg jpeg png gif svg webp zip mp4 css js xml ico woff woff2 txt"
).split()
NON_PAGE_SCHEMES = "mailto tel sms javascript data blob about".split()

# ---- end of fixed values ------------------------------------------------------------------

_ASSET_PATH = r"(?i)\.(?:" + "|".join(ASSET_EXTENSIONS) + r")\z"
_NON_PAGE = r"(?i)^(?:#|(?:" + "|".join(NON_PAGE_SCHEMES) + "):)"
_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_HTTP = r"(?i)^(https?):[/\\]*([^/?#\\]+)([^?#]*)(\?[^#]*)?"
_PATH_UNSAFE = r'\x00-\x20"<>`{}\x7F-\x{10FFFF}'
_QUERY_UNSAFE = r"\x00-\x20\"<>'\x7F-\x{10FFFF}"


def _encode(part: Column, unsafe: str) -> Column:
    """Percent-encode the unsafe runs of a URL part, leaving the rest alone."""
    runs = F.regexp_extract_all(part, F.lit(f"[{unsafe}]+|[^{unsafe}]+"), F.lit(0))
    encoded = F.transform(
        runs,
        lambda r: F.when(
            r.rlike(f"^[{unsafe}]"), F.replace(F.url_encode(r), F.lit("+"), F.lit("%20"))
        ).otherwise(r),
    )
    return F.when(part.rlike(f"[{unsafe}]"), F.array_join(encoded, "")).otherwise(part)


def _remove_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments by folding over the path's segments."""

    def fold(segments: Column) -> Column:
        kept = F.aggregate(
            segments,
            F.array().cast("array<string>"),
            lambda acc, s: F.when(s == ".", acc)
            .when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
            .otherwise(F.concat(acc, F.array(s))),
        )
        ends_dotted = F.try_element_at(segments, F.lit(-1)).isin(".", "..")
        tail = F.when(ends_dotted, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.lit("/"), F.array_join(F.concat(kept, tail), "/"))

    dotted = path.rlike(r"/\.\.?(?:/|\z)")
    return F.when(dotted, let(F.slice(F.split(path, "/"), 2, 1 << 30), fold)).otherwise(path)


def _ascii_host(host: Column) -> Column:
    """A host with its port in ASCII letters; null where it cannot be written in them."""
    name = F.regexp_replace(host, r":\d*\z", "")
    spelt = F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), name)
    port = F.regexp_extract(host, r"(:\d*)\z", 1)
    return F.when(host.rlike(r"[^\x00-\x7F]"), F.lower(F.concat(spelt, port))).otherwise(F.lower(host))


def _authority(raw: Column, scheme: Column) -> Column:
    default = F.when(scheme == "https", r":443").otherwise(":80")
    return let(
        _ascii_host(raw),
        lambda h: F.when(h.endswith(default), F.regexp_replace(h, r":\d+\z", "")).otherwise(h),
    )


def host_of(url: Column) -> Column:
    """Lower-cased host with any non-default port; null when the URL is not http(s)."""
    raw = _ascii_host(F.regexp_extract(url, _HTTP, 2))
    default = F.when(F.lower(F.left(url, F.lit(5))) == "https", ":443").otherwise(":80")
    host = F.when(raw.endswith(default), F.regexp_replace(raw, r":\d+\z", "")).otherwise(raw)
    return F.nullif(host, F.lit(""))


def origin_of(url: Column) -> Column:
    scheme = F.lower(F.regexp_extract(url, _HTTP, 1))
    return F.when(scheme != "", F.concat(scheme, F.lit("://"), host_of(url)))


def base_parts(url: Column) -> Column:
    """What resolving needs to know of the base, once per document."""
    return record(
        scheme=F.lower(F.regexp_extract(url, _HTTP, 1)),
        host=F.regexp_extract(url, _HTTP, 2),
        path=F.regexp_extract(url, _HTTP, 3),
        query=F.regexp_extract(url, _HTTP, 4),
    )


def _resolve(t: Column, base: Column) -> Column:
    """``struct<scheme,host,path,query>``; null when the result is no http(s) URL.

    ``t`` is the trimmed reference, ``base`` the parts of the base; both are lambda variables.
    """

    def from_pieces(r: Column) -> Column:
        absolute = r["scheme"].isin("http", "https")
        net = (r["scheme"] == "") & r["path"].startswith("//")
        scheme = F.when(absolute, r["scheme"]).otherwise(base["scheme"])
        host = (
            F.when(absolute, F.regexp_extract(r["path"], r"^[^:]*:/*([^/]*)", 1))
            .when(net, F.regexp_extract(r["path"], r"^//+([^/]*)", 1))
            .otherwise(base["host"])
        )
        folder = F.regexp_extract(base["path"], r"^(.*/)", 1)
        path = (
            F.when(absolute, F.regexp_replace(r["path"], r"^[^:]*:/*[^/]*", ""))
            .when(net, F.regexp_replace(r["path"], r"^//+[^/]*", ""))
            .when(r["path"].startswith("/"), r["path"])
            .when(r["path"] == "", base["path"])
            .otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), r["path"]))
        )
        query = F.when((r["path"] == "") & (r["query"] == ""), base["query"]).otherwise(r["query"])
        usable = (absolute | (r["scheme"] == "")) & (base["scheme"] != "")
        return F.when(usable, record(scheme=scheme, host=host, path=path, query=query))

    def finish(p: Column) -> Column:
        return F.when(
            p["host"] != "",
            record(
                scheme=p["scheme"],
                host=_authority(p["host"], p["scheme"]),
                path=let(
                    F.when(p["path"] == "", "/").otherwise(p["path"]),
                    lambda path: _encode(_remove_dots(path), _PATH_UNSAFE),
                ),
                query=let(
                    F.when(p["query"] == "?", "").otherwise(p["query"]),
                    lambda q: _encode(q, _QUERY_UNSAFE),
                ),
            ),
        )

    def cut(bare: Column) -> Column:
        return record(
            scheme=F.lower(F.regexp_extract(bare, _SCHEME, 1)),
            path=F.translate(F.regexp_extract(bare, r"^([^?]*)", 1), "\\", "/"),
            query=F.regexp_extract(bare, r"^[^?]*(\?[\s\S]*)\z", 1),
        )

    bare = F.regexp_replace(t, r"#[\s\S]*\z", "")
    return let(bare, lambda b: let(let(cut(b), from_pieces), finish))


def _trimmed(ref: Column) -> Column:
    return F.translate(js_trim(ref), "\t\n\r", "")


def absolutize_in(ref: Column, base: Column) -> Column:
    """Absolute URL of an asset reference against ``base_parts``, fragment dropped, or null."""
    return let(
        _trimmed(ref),
        lambda t: F.when(
            (t != "") & ~t.rlike(_NON_PAGE),
            let(
                _resolve(t, base),
                lambda p: F.concat(p["scheme"], F.lit("://"), p["host"], p["path"], p["query"]),
            ),
        ),
    )


def _drop_utm(query: Column) -> Column:
    kept = F.filter(
        F.split(F.substr(query, F.lit(2)), "&"),
        lambda kv: ~F.lower(kv).startswith("utm_") & (kv != ""),
    )
    cleaned = let(
        F.array_join(kept, "&"), lambda j: F.when(j == "", "").otherwise(F.concat(F.lit("?"), j))
    )
    return F.when(query.rlike(r"(?i)[?&]utm_"), cleaned).otherwise(query)


def page_url_in(ref: Column, base: Column) -> Column:
    """``struct<host,url>`` of a crawlable page, or null when the reference is no page.

    Fragment, ``utm_*`` parameters and the trailing slash are dropped. Remaining parameters are
    kept byte for byte.
    """

    def build(p: Column) -> Column:
        path = F.when(F.length(p["path"]) > 1, F.regexp_replace(p["path"], r"/\z", "")).otherwise(
            p["path"]
        )
        url = F.concat(p["scheme"], F.lit("://"), p["host"], path, _drop_utm(p["query"]))
        return F.when(
            p.isNotNull() & ~p["path"].rlike(_ASSET_PATH), record(host=p["host"], url=url)
        )

    return let(
        _trimmed(ref),
        lambda t: F.when((t != "") & ~t.rlike(_NON_PAGE), let(_resolve(t, base), build)),
    )


def absolutize(ref: Column, base: Column) -> Column:
    return let(base_parts(base), lambda b: absolutize_in(ref, b))


def normalize_page_url(ref: Column, base: Column) -> Column:
    return let(base_parts(base), lambda b: page_url_in(ref, b))["url"]
