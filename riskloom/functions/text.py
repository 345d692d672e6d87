"""Text normalisation shared by the prompt, content and page jobs."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from riskloom.functions.expr import let
from riskloom.functions.regex import SPACE, SPACE_SET

# Soft hyphen, zero-width characters, direction marks, word joiner, BOM.
INVISIBLE = r"[\x{00AD}\x{200B}-\x{200F}\x{2060}\x{FEFF}]"

# Characters NFKC may change or combine: everything but ASCII, the plain letters and punctuation
# of Latin-1, the euro sign, dashes and curly quotes.
_MAY_CHANGE = (
    r"[\xA0\xA8\xAA\xAF\xB2-\xB5\xB8-\xBA\xBC-\xBE\x{100}-\x{2012}\x{2015}-\x{2017}\x{201A}\x{201B}"
    r"\x{201E}-\x{20AB}\x{20AD}-\x{10FFFF}]"
)


@F.arrow_udf(StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    # Arrow's own kernel leaves NFKC text decomposed, so each value goes through the standard library.
    values = [None if t is None else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()]
    return pa.array(values, type=texts.type)


def nfkc(text: Column) -> Column:
    """Unicode NFKC. Spark has no built-in for it, so this is the one Python function.

    Rows that cannot change are passed as null: they cost a bit in the Arrow batch instead of
    their text, and the table is read once.
    """
    ascii_only = F.octet_length(text) == F.length(text)
    return F.coalesce(_nfkc(F.when(~ascii_only & text.rlike(_MAY_CHANGE), text)), text)


def js_trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|(?<!{SPACE}){SPACE}+\\z", "")


def collapse_spaces(text: Column) -> Column:
    return F.regexp_replace(text, f"{SPACE}+", " ")


def clean(text: Column) -> Column:
    """Whitespace collapsed and trimmed; null when nothing is left."""
    return F.nullif(F.trim(collapse_spaces(text)), F.lit(""))


def normalize_prompt(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(nfkc(text), INVISIBLE, ""), r"[ \t]+", " ")


# Letters separated one by one (r.l.s, d-i-s-a-b-l-e), three at least. The separators are
# dropped in place: each alternative looks for one separator with the right letters around it.
_SEPARATED = r"\p{L}[.\-_ ]\p{L}[.\-_ ]\p{L}(?![\p{L}\p{N}])"
_SEPARATOR = (
    r"(?<=(?<![\p{L}\p{N}])\p{L})[.\-_ ](?=\p{L}[.\-_ ]\p{L}(?![\p{L}\p{N}]))"
    r"|(?<=(?<![\p{L}\p{N}])\p{L}[.\-_ ]\p{L})[.\-_ ](?=\p{L}(?![\p{L}\p{N}]))"
)


def fold_separated_letters(text: Column) -> Column:
    return F.when(text.rlike(_SEPARATED), F.regexp_replace(text, _SEPARATOR, "")).otherwise(text)


def fold_content(nfkc_text: Column) -> Column:
    """The JVM half of content normalisation, for text that already went through NFKC."""
    visible = F.regexp_replace(nfkc_text, INVISIBLE, "")
    return F.regexp_replace(fold_separated_letters(visible), r"[ \t]+", " ")


def normalize_content(text: Column) -> Column:
    return fold_content(nfkc(text))


def collapse_paragraphs(text: Column) -> Column:
    """One line per paragraph, so a rule can reach from a heading to the line below it."""
    blank = f"\\n{SPACE}*\\n"
    inner = f"[{SPACE_SET}&&[^\\n]]*\\n{SPACE}*"
    return F.array_join(
        F.transform(
            F.split(text, blank), lambda p: js_trim(F.regexp_replace(p, inner, " "))
        ),
        "\n",
    )


def split_clauses(normal: Column) -> Column:
    """Sentences and lines, trimmed, empties dropped. A run of enders is tried once, at its start."""
    breaks = f"(?<![.!?;])[.!?;]++(?={SPACE}|\\z)|[\\n\\r]+"
    return F.filter(F.transform(F.split(normal, breaks), js_trim), lambda c: c != "")


def quote_of(text: Column, limit: int = 200) -> Column:
    flat = F.trim(collapse_spaces(text))
    return F.when(F.length(flat) > limit, F.concat(F.left(flat, F.lit(limit)), F.lit("…"))).otherwise(
        flat
    )


def count_newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, "\n", ""))


def format_bytes(n: Column) -> Column:
    return (
        F.when(n >= 1048576, F.format_string("%.1f MB", n / 1048576.0))
        .when(n >= 1024, F.concat(F.floor(n / 1024.0 + 0.5).cast("string"), F.lit(" KB")))
        .otherwise(F.concat(n.cast("string"), F.lit(" B")))
    )


#: Two pages open alike if so many characters agree. This is the rule, not a bound on the work.
OPENING_CHARS = 400


def page_outline(html: Column, opening: int = OPENING_CHARS) -> Column:
    """What ``same_outline`` needs of a document: its length and opening, white space and case aside."""
    flat = F.lower(F.trim(collapse_spaces(html)))
    return let(flat, lambda f: F.struct(F.length(f).alias("length"), F.left(f, F.lit(opening)).alias("opening")))


def same_outline(a: Column, b: Column) -> Column:
    """Two documents that read as one page: similar length and the same opening."""
    la, lb = a["length"], b["length"]
    close = F.abs(la - lb) <= 0.1 * F.greatest(la, lb)
    return F.when((la == 0) | (lb == 0), la == lb).otherwise(close & (a["opening"] == b["opening"]))


def same_page(a: Column, b: Column) -> Column:
    return same_outline(page_outline(a), page_outline(b))


