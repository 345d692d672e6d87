"""Literals that a rule's alternatives cannot do without, and one pass over a text for all of them.

A pattern tells which texts it could match by the letters it always holds. An Aho-Corasick automaton finds all
such letters of all rules in one pass, with places, so that only texts in which the parts of a rule stand near
one another are shown to the pattern itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import ahocorasick

_CLASSES = re.compile(r"\[[^\]]*\]|\\p\{\w+\}|\\.|\((?:\?[:=!<]+)?|[)|^$.]|[^\\\[\]()|^$.]")
_OFTEN = re.compile(r"[*+?]|\{\d+(?:,\d*)?\}")


def runs(fragment: str) -> list[str]:
    """The stretches of plain characters that every match of a pattern without top-level ``|`` holds, in order.

    Groups, classes and what may be absent part them. Escaped punctuation is plain.
    """
    out, now, depth, at = [], "", 0, 0
    while at < len(fragment):
        token = _CLASSES.match(fragment, at)[0]
        at += len(token)
        often = _OFTEN.match(fragment, at)
        at += len(often[0]) if often else 0
        if token.startswith("("):
            out, now, depth = [*out, now], "", depth + 1
            continue
        if token == ")":
            depth -= 1
            out, now = [*out, now], ""
            continue
        plain = len(token) == 1 and token not in "^$.|" or len(token) == 2 and token[0] == "\\" and not token[1].isalnum()
        if depth == 0 and plain and not often:
            now += token[-1]
        else:
            out, now = [*out, now], ""
    return [run for run in [*out, now] if run]


_FEW = re.compile(r"\[([^\]\\^-]{1,4})\](?![*+?{])")


def spellings(fragment: str) -> list[str]:
    """A pattern with each class of a few characters written out as one of them."""
    few = _FEW.search(fragment)
    if few is None:
        return [fragment]
    return [s for char in few[1] for s in spellings(fragment[: few.start()] + re.escape(char) + fragment[few.end() :])]


def _simple_fold(char: str) -> str:
    """A character as case-blind patterns compare it: upper, then lower case, one character each."""
    upper = char.upper() if len(char.upper()) == 1 else char
    return upper.lower() if len(upper.lower()) == 1 else {"İ": "i"}.get(upper, upper)


_FOLD = {c: _simple_fold(chr(c)) for c in range(0x10000) if _simple_fold(chr(c)) != chr(c).lower()}


def fold(text: str) -> str:
    """Lower case, one character for each, as the rules' patterns see it."""
    return text.lower() if text.isascii() else "".join(_FOLD.get(ord(c)) or (c.lower() if len(c.lower()) == 1 else c) for c in text)


def automaton(words: Iterable[tuple[str, object]]) -> ahocorasick.Automaton:
    """Finds the words, each with a tuple of all values it was given with, and its length."""
    values: dict[str, list] = {}
    for word, value in words:
        values.setdefault(fold(word), []).append(value)
    found = ahocorasick.Automaton()
    for word, own in values.items():
        found.add_word(word, (len(word), tuple(own)))
    found.make_automaton()
    return found
