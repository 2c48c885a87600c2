"""Keyword rules as regular expressions (FN-12)."""

from __future__ import annotations

import html
import re

from pyspark.sql import Column, functions as F

from newsgrist.functions.text import let

# Characters that a case-blind search takes for an ASCII letter: s, k and i.
_LOOKALIKES = {"s": "\u017f", "k": "\u212a", "i": "\u0130\u0131"}
# Word characters of a boundary, itself case-blind; spelled out to keep it off the flags,
# under which every test of a character costs several times more.
_WORD = "[a-zA-Z0-9_" + "".join(_LOOKALIKES.values()) + "]"


def _clean(keyword: str) -> str:
    return " ".join(html.unescape(keyword).split()).lower()


def _edges(keyword: str) -> tuple[str, str]:
    """Boundary before and after: no word character beside a word, no symbol beside a symbol."""
    first, last = keyword[0], keyword[-1]
    before = rf"(?<!{_WORD})" if first.isalnum() or first == "_" else r"(?U:(?<!\S))"
    after = rf"(?!{_WORD})" if last.isalnum() or last == "_" else r"(?U:(?!\S))"
    return before, after


def _quote(keyword: str) -> str:
    return re.sub(r"([\\.\[\]{}()*+?^$|#&~\-])", r"\\\1", keyword)


def _may_start(keywords: list[str]) -> str:
    """Look-ahead for the first characters of the keywords; '' if one is not ASCII.

    It fails at most positions of a text, and far sooner than look-behind and keywords.
    """
    first = {k[0] for k in keywords}
    if not all(c.isascii() for c in first):
        return ""
    letters = {x for c in first for x in (c, c.upper(), *_LOOKALIKES.get(c, ""))}
    return f"(?=[{''.join(_quote(x) for x in sorted(letters))}])"


def keyword_pattern(keyword: str) -> str:
    """Pattern of one keyword."""
    return any_keyword_pattern([keyword])


def any_keyword_pattern(keywords: list[str]) -> str:
    """Pattern that finds any of the keywords: one regex pass per category.

    Keywords with the same boundaries share them, so the look-behind is tried once per
    position and not once per keyword.
    """
    groups: dict[tuple[str, str], list[str]] = {}
    for keyword in filter(None, map(_clean, keywords)):
        groups.setdefault(_edges(keyword), []).append(keyword)
    parts = [
        f"{_may_start(words)}{before}(?iU:{'|'.join(map(_quote, words))}){after}"
        for (before, after), words in groups.items()
    ]
    return "|".join(parts)


def pattern_column(keyword: Column) -> Column:
    """``keyword_pattern`` of clean lower-case keywords in a column."""

    def edge(at: str, word: str, symbol: str) -> Column:
        return F.when(keyword.rlike(at), F.lit(word)).otherwise(F.lit(symbol))

    quoted = F.regexp_replace(keyword, r"([\\.\[\]{}()*+?^$|#&~\-])", r"\\$1")
    before = edge(r"\A[\p{L}\p{N}_]", f"(?<!{_WORD})", r"(?U:(?<!\S))")
    after = edge(r"[\p{L}\p{N}_]\z", f"(?!{_WORD})", r"(?U:(?!\S))")
    return F.concat(before, F.lit("(?iU:"), quoted, F.lit(")"), after)


def folded(text: Column) -> Column:
    """Lower case, with look-alikes of ASCII letters made ASCII."""
    for letter, others in _LOOKALIKES.items():
        for other in others:
            text = F.replace(text, F.lit(other), F.lit(letter))
    return F.lower(text)


def contains_keyword(text: Column, fold: Column, keyword: str) -> Column:
    """Whether the keyword occurs in ``text``; ``fold`` is ``folded(text)``.

    The substring test costs a fraction of the regex and rules out nearly all pairs.
    """
    found = text.rlike(keyword_pattern(keyword))
    plain = _clean(keyword)
    return F.contains(fold, F.lit(plain)) & found if plain.isascii() else found


def matched_keywords(text: Column, keywords: list[str]) -> Column:
    """JN-1: keywords found in clean text, in rule order; patterns stay literals, so each is
    compiled once per task."""
    keywords = [k for k in keywords if _clean(k)]
    if not keywords:
        return F.array().cast("array<string>")
    pair = F.struct(text.alias("t"), folded(text).alias("f"))
    return let(
        pair,
        lambda p: F.array_compact(
            F.array(*[F.when(contains_keyword(p["t"], p["f"], k), F.lit(k)) for k in keywords])
        ),
    )
