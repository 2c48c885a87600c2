"""Data quality (DQ-1, DQ-2, DQ-3, SRC-17)."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsgrist import fixed_values as fixed
from newsgrist.functions.text import is_blank
from newsgrist.operators.relevance import Rules
from newsgrist.operators.store import constraint_violations

RULE_SCHEMA = "cat_ord int, category string, kw_ord int, keyword string"


def store_audit(store: DataFrame) -> DataFrame:
    """DQ-1: (level, rule, key, n). Key and null rules are errors; a hash that is not 64
    characters or a sent row without a time is a warning."""
    errors = constraint_violations(store).select(F.lit("error").alias("level"), "rule", "key", "n")
    checks = {
        "content_hash length": F.length("content_hash") != 64,
        "sent without time": F.col("sent") & F.col("sent_at").isNull(),
    }
    counts = store.agg(*[F.count_if(c).alias(name) for name, c in checks.items()])
    pairs = F.array(
        *[F.struct(F.lit(name).alias("rule"), F.col(f"`{name}`").alias("n")) for name in checks]
    )
    warnings = counts.select(F.inline(pairs)).where("n > 0").select(
        F.lit("warning").alias("level"), "rule", F.lit(None).cast("string").alias("key"), "n"
    )
    return errors.unionByName(warnings)


def store_status(audit: DataFrame) -> DataFrame:
    """'ok' if the audit found no error."""
    bad = F.count_if(F.col("level") == "error") > 0
    return audit.agg(F.when(bad, "damaged").otherwise("ok").alias("database_health"))


def usable_secrets(secrets: Iterable[str | None]) -> list[str]:
    """Distinct secrets long enough to mask, in order."""
    return sorted({s for s in secrets if s and len(s) >= fixed.MIN_SECRET_LENGTH})


def any_of(words: list[str]) -> str:
    """A pattern of all ``words`` (sorted, distinct) as a tree of their common beginnings: at
    each position a search follows one branch only, and takes the longest word."""
    head = os.path.commonprefix([words[0], words[-1]])
    rests = [w[len(head) :] for w in words]
    branches = [any_of(list(group)) for _, group in groupby([r for r in rests if r], key=lambda r: r[0])]
    if not branches:
        return re.escape(head)
    return f"{re.escape(head)}(?:{'|'.join(branches)}){'' if rests[0] else '?'}"


def mask(text: Column, secrets: Iterable[str | None] = (), patterns: list[str] | None = None) -> Column:
    """DQ-2: literal secrets, then token patterns, become ``***REDACTED***``. All secrets are
    looked for in one pass; where several begin, the longest is masked."""
    words = usable_secrets(secrets)
    if words:
        text = F.regexp_replace(text, any_of(words), fixed.MASK)
    for pattern in fixed.TOKEN_PATTERNS if patterns is None else patterns:
        text = F.regexp_replace(text, f"(?U){pattern}", fixed.MASK)
    return text


def mask_columns(
    rows: DataFrame, columns: list[str], secrets: Iterable[str | None] = (),
    patterns: list[str] | None = None,
) -> DataFrame:
    """DQ-2 over text columns; ``masked`` counts the replacements in a row."""
    secrets = list(secrets)
    masked = rows.withColumns(
        {f"_masked_{c}": mask(F.col(c), secrets, patterns) for c in columns}
    )
    marker = F.lit(re.escape(fixed.MASK))
    hits = [
        F.coalesce(F.regexp_count(f"_masked_{c}", marker) - F.regexp_count(c, marker), F.lit(0))
        for c in columns
    ]
    total = hits[0]
    for hit in hits[1:]:
        total = total + hit
    return masked.select(
        *[F.col(f"_masked_{c}").alias(c) if c in columns else F.col(c) for c in rows.columns],
        total.alias("masked"),
    )


def rules_frame(spark: SparkSession, categories: dict[str, list]) -> DataFrame:
    """SRC-17: the rule set as rows in rule order, names and keywords trimmed, blank or
    non-text keywords left out."""
    rows = []
    for cat_ord, (category, keywords) in enumerate(categories.items()):
        kept = [k.strip() for k in keywords or [] if isinstance(k, str) and k.strip()]
        rows += [(cat_ord, category.strip(), kw_ord, k) for kw_ord, k in enumerate(kept)]
        if not kept:
            rows.append((cat_ord, category.strip(), None, None))
    return spark.createDataFrame(rows, RULE_SCHEMA)


def rules_of(table: DataFrame, **numbers: float) -> Rules:
    """SRC-17: a validated rule table (``RULE_SCHEMA``) as the rules of a run.

    The table is configuration: some hundreds of rows come to the driver. Names and keywords
    are trimmed and blank keywords dropped; any other fault raises.
    """
    rows = table.orderBy("cat_ord", "kw_ord").collect()
    faults = audit_rules(table).limit(3).collect()
    if faults:
        raise ValueError("; ".join(f"{f.rule}: {f.key}" for f in faults))
    categories: dict[str, list[str]] = {}
    for row in rows:
        kept = categories.setdefault(row.category.strip(), [])
        if row.keyword and row.keyword.strip():
            kept.append(row.keyword.strip())
    return Rules(categories=categories, **numbers)


def audit_rules(rules: DataFrame) -> DataFrame:
    """DQ-3 for a rule table: (rule, key) of every fault."""
    blank_name = rules.where(is_blank(F.col("category"))).select(
        F.lit("category name is blank").alias("rule"), F.col("cat_ord").cast("string").alias("key")
    )
    no_words = (
        rules.groupBy("cat_ord", "category")
        .agg(F.count_if(~is_blank(F.col("keyword"))).alias("n"))
        .where("n = 0")
        .select(F.lit("category has no keywords").alias("rule"), F.col("category").alias("key"))
    )
    return blank_name.unionByName(no_words)


def audit_sources(sources: DataFrame) -> DataFrame:
    """DQ-3 for a source table: (rule, key) of every fault, each by the source's name or
    the rank it shares."""
    on, kind = F.col("enabled"), F.col("kind")
    queries = F.filter(F.coalesce("queries", F.array().cast("array<string>")), lambda q: ~is_blank(q))
    checks = {
        "source name is blank": is_blank(F.col("name")),
        "feed has no url": (kind == "feed") & on & is_blank(F.col("url")),
        "feed url is not http": (kind == "feed") & on & ~is_blank(F.col("url"))
        & ~F.coalesce("url", F.lit("")).rlike(r"\Ahttps?://"),
        "max_items is not positive": F.coalesce("max_items", F.lit(0)) <= 0,
        "story feed is blank": (kind == "stories") & on & is_blank(F.col("story_feed")),
        "no search queries": (kind == "repos") & on & (F.size(queries) == 0),
    }
    faults = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in checks.items()]))
    own = sources.select(F.explode(faults).alias("rule"), F.col("name").alias("key"))
    # Two sources of one rank would have no order.
    ranks = sources.groupBy("source_rank").agg(F.count("*").alias("n")).where("n > 1")
    return own.unionByName(
        ranks.select(F.lit("source rank is not unique").alias("rule"), F.col("source_rank").cast("string").alias("key"))
    )


def check_numbers(*, threshold, weights, max_age_hours, limit) -> None:
    """DQ-3 for run parameters: raises on the first bad one."""
    def number(value) -> bool:
        return isinstance(value, (int, float)) and not isinstance(value, bool)

    if not number(threshold) or threshold < 0:
        raise ValueError(f"threshold must be a number of at least 0, got {threshold!r}")
    for weight in weights:
        if not number(weight):
            raise ValueError(f"weight must be a number, got {weight!r}")
    if not number(max_age_hours) or max_age_hours <= 0:
        raise ValueError(f"max_age_hours must be positive, got {max_age_hours!r}")
    if not isinstance(limit, int) or isinstance(limit, bool) or limit <= 0:
        raise ValueError(f"notification limit must be a positive integer, got {limit!r}")
