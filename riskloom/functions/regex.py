"""Rule patterns are written in the ECMAScript dialect and compiled here to Java's.

The two dialects disagree on four points that change results:

* ``\\b`` and ``\\w`` are ASCII in the rules; Java's ``\\b`` is not (and moved in JDK 19);
* ``\\s`` covers all Unicode spaces in the rules, only ASCII ones in Java;
* ``$`` also matches before a final newline in Java;
* case folding is Unicode in the rules, ASCII under Java's plain ``(?i)``.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.functions.expr import let, record

_WORD = "A-Za-z0-9_"
BOUNDARY = f"(?:(?<=[{_WORD}])(?![{_WORD}])|(?<![{_WORD}])(?=[{_WORD}]))"
# The space separators and the six controls and marks the rules count as white space.
SPACE_SET = r" \t\n\x0B\f\r\x{2028}\x{2029}\x{FEFF}\p{Zs}"
SPACE = f"[{SPACE_SET}]"
ANY = r"[\s\S]"


def _is_word(ch: str) -> bool:
    return ch.isascii() and (ch.isalnum() or ch == "_")


@lru_cache(maxsize=None)
def java(pattern: str, ignore_case: bool = False) -> str:
    """Java source for one rule pattern."""
    out: list[str] = []
    i, in_class = 0, False
    while i < len(pattern):
        if pattern.startswith(ANY, i) and not in_class:
            out.append(ANY)
            i += len(ANY)
            continue
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            esc = pattern[i + 1]
            if esc == "b" and not in_class:
                before = pattern[i - 1] if i else ""
                literal_before = bool(before) and _is_word(before) and pattern[i - 2 : i - 1] != "\\"
                after = pattern[i + 2 : i + 3]
                literal_after = bool(after) and _is_word(after)
                # One known side makes the other side a plain negative lookaround.
                if literal_before and not literal_after:
                    out.append(f"(?![{_WORD}])")
                elif literal_after and not literal_before:
                    out.append(f"(?<![{_WORD}])")
                else:
                    out.append(BOUNDARY)
            elif esc == "s":
                out.append(SPACE_SET if in_class else SPACE)
            elif esc == "S" and not in_class:
                out.append(f"[^{SPACE_SET}]")
            elif esc == "u" and pattern[i + 2 : i + 3] != "{":
                out.append(f"\\x{{{pattern[i + 2:i + 6]}}}")
                i += 4
            else:
                out.append(ch + esc)
            i += 2
            continue
        if in_class:
            if ch == "]":
                in_class = False
            elif ch in "[&":
                out.append("\\")
        elif ch == "[":
            in_class = True
            if pattern[i + 1 : i + 2] == "^":
                out.append("[^")
                i += 2
                continue
        elif ch == "$":
            out.append(r"\z")
            i += 1
            continue
        out.append(ch)
        i += 1
    return ("(?iu)" if ignore_case else "") + "".join(out)


def matches(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    return text.rlike(java(pattern, ignore_case))


def matches_any(text: Column, patterns: list[str], ignore_case: bool = True) -> Column:
    cond = F.lit(False)
    for pattern in patterns:
        cond = cond | matches(text, pattern, ignore_case)
    return cond


def mentions(lowered: Column, words: list[str]) -> Column:
    """Whether lower-cased text holds one of the words: a byte search, far cheaper than a regex.

    Used as a first gate; the words must be parts of whatever the gated patterns match.
    """
    out = F.lit(False)
    for word in words:
        out = out | F.contains(lowered, F.lit(word))
    return out


def extract(text: Column, pattern: str, group: int = 1, ignore_case: bool = True) -> Column:
    """The group of the first match, ``''`` where nothing matched."""
    return F.regexp_extract(text, java(pattern, ignore_case), group)


def extract_or_null(text: Column, pattern: str, group: int = 1, ignore_case: bool = True) -> Column:
    return F.nullif(extract(text, pattern, group, ignore_case), F.lit(""))


def extract_all(text: Column, pattern: str, group: int = 0, ignore_case: bool = True) -> Column:
    return F.regexp_extract_all(text, F.lit(java(pattern, ignore_case)), F.lit(group))


def replace_all(text: Column, pattern: str, by: str, ignore_case: bool = False) -> Column:
    return F.regexp_replace(text, java(pattern, ignore_case), by)


def located(text: Column, pattern: str, groups: int = 1, ignore_case: bool = True) -> Column:
    """Every match as ``array<struct<match,g1..gn,line>>``, linear in the text.

    The text is read twice, for the matches and for what lies between them. Of both only the newlines are kept, with
    a mark for each match; cut into lines, each line contributes its own number once per mark: the k-th number
    belongs to the k-th match. Groups are read from the match alone, so a pattern with groups must not look beyond
    its match but for a word's end.
    """
    mark = "\u0001"
    clean = F.replace(text, F.lit(mark), F.lit(""))
    read = record(found=extract_all(clean, pattern, 0, ignore_case), between=F.split(clean, java(pattern, ignore_case)))

    def one(r: Column) -> Column:
        after = F.transform(r["found"], lambda m: F.concat(F.lit(mark), _newlines(m)))
        pieces = F.zip_with(F.transform(r["between"], _newlines), after, lambda b, m: F.concat(b, F.coalesce(m, F.lit(""))))
        lines = F.transform(F.split(F.array_join(pieces, ""), "\n"), lambda line, i: F.array_repeat(i + 1, F.length(line)))

        def described(m: Column, line: Column) -> Column:
            parts = {f"g{g}": extract(m, pattern, g, ignore_case) for g in range(1, groups + 1)}
            return record(match=m, **parts, line=line)

        return F.zip_with(r["found"], F.flatten(lines), described)

    return let(read, one)


def _newlines(text: Column) -> Column:
    return F.repeat(F.lit("\n"), F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))))
