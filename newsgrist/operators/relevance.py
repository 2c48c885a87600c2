"""Category detection and scoring (JN-1, JN-2, AGG-1, AGG-2, AGG-3)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from newsgrist import fixed_values as fixed
from newsgrist.functions import text
from newsgrist.functions.patterns import (
    any_keyword_pattern, contains_keyword, folded, matched_keywords,
)
from newsgrist.functions.pinned import pinned


@dataclass(frozen=True)
class Rules:
    """Categories with their keywords (rule order), weights and threshold."""

    categories: dict[str, list[str]] = field(default_factory=lambda: dict(fixed.DEFAULT_RULES))
    title_weight: float = fixed.TITLE_WEIGHT
    description_weight: float = fixed.DESCRIPTION_WEIGHT
    category_weight: float = fixed.CATEGORY_WEIGHT
    threshold: float = fixed.THRESHOLD

    def __post_init__(self) -> None:
        """Blank keywords match nothing: they are left out."""
        kept = {c: [k for k in words or [] if k and k.strip()] for c, words in self.categories.items()}
        object.__setattr__(self, "categories", kept)


def keyword_matches(value: Column, keywords: list[str]) -> Column:
    """JN-1 for any text: cleaned first, [] for null or empty."""
    return matched_keywords(text.clean_text(value), keywords)


def source_tagged(category: str) -> Column:
    """JN-2: incoming ``categories`` name this category, whatever the case."""
    wanted = category.lower()
    return F.coalesce(
        F.exists("categories", lambda c: F.lower(c) == F.lit(wanted)), F.lit(False)
    )


def score(articles: DataFrame, rules: Rules, *, normalized: bool = False) -> DataFrame:
    """AGG-1..3: sets ``categories`` and ``relevance_score``, adds ``is_relevant`` and
    ``matched_keywords``.

    ``normalized`` says title and description come from ``normalize``, so only entities are
    cleaned again. Narrow, no shuffle. Scoring costs one regex per category and field; single keywords
    are looked for only in the categories a row hit.
    """
    keep = {
        *articles.columns, "relevance_score", "categories", "is_relevant", "matched_keywords",
    }
    names = list(rules.categories)
    any_of = {c: any_keyword_pattern(k) for c, k in rules.categories.items() if k}
    clean = text.clean_again if normalized else text.clean_text
    prepared = articles.withColumns(
        {
            "_title": clean(F.coalesce("title", F.lit(""))),
            "_body": clean(F.coalesce("description", F.lit(""))),
        }
    )
    flags = {
        f"_{side}_{i}": F.col(f"_{side}").rlike(any_of[c]) if c in any_of else F.lit(False)
        for side in ("title", "body")
        for i, c in enumerate(names)
    } | {f"_tag_{i}": source_tagged(c) for i, c in enumerate(names)}
    # A filter on the score then runs on the flags, before the keyword search.
    hits = pinned(prepared, "*", **flags) if flags else prepared

    def hit(side: str, i: int) -> Column:
        return F.col(f"_{side}_{i}")

    def found(i: int) -> Column:
        return hit("title", i) | hit("body", i) | hit("tag", i)

    def points(condition: Column, weight: float) -> Column:
        return F.when(condition, F.lit(float(weight))).otherwise(F.lit(0.0))

    total: Column = F.lit(0.0)
    for i in range(len(names)):
        total = (
            total
            + points(hit("title", i), rules.title_weight)
            + points(hit("body", i), rules.description_weight)
            + points(found(i), rules.category_weight)
        )
    # A keyword has no line break in it, so it cannot match across the two fields.
    both = F.concat_ws("\n", "_title", "_body")
    in_text = [hit("title", i) | hit("body", i) for i in range(len(names))]

    def search(pair: Column) -> Column:
        found_words = [
            F.when(in_text[i], F.when(contains_keyword(pair["t"], pair["f"], k), F.lit(k)))
            for i, c in enumerate(names)
            for k in rules.categories[c]
        ]
        return F.array_sort(F.array_distinct(F.array_compact(F.array(*found_words))))

    no_words = F.array().cast("array<string>")
    if any(rules.categories.values()):
        any_hit = in_text[0]
        for flag in in_text[1:]:
            any_hit = any_hit | flag
        pair = F.struct(both.alias("t"), folded(both).alias("f"))
        words = F.when(any_hit, text.let(pair, search)).otherwise(no_words)
    else:
        words = no_words
    categories = [F.when(found(i), F.lit(c)) for i, c in enumerate(names)]
    scored = hits.withColumns(
        {
            "relevance_score": total,
            "categories": F.array_compact(F.array(*categories)).cast("array<string>"),
            "is_relevant": total >= F.lit(float(rules.threshold)),
            "matched_keywords": words,
        }
    )
    return scored.drop(*[c for c in scored.columns if c not in keep])
