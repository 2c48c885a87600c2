"""Checks against stored articles (JN-3, JN-4, JN-7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from newsgrist.functions.keys import having, rows_having
from newsgrist.functions.lineage import cut_lineage
from newsgrist.operators.filters import unsent


def not_in_history(
    articles: DataFrame, store: DataFrame, row_id: str = "seq", filters: DataFrame | None = None
) -> DataFrame:
    """JN-3: articles whose url and hash are both new. ``row_id`` is unique; urls may repeat.
    ``filters`` are those of the store's keys, if it has any."""
    keys = cut_lineage(articles.select(row_id, "url", "content_hash"))
    return articles.join(in_history(keys, store, row_id, filters), row_id, "left_anti")


def in_history(
    articles: DataFrame, store: DataFrame, row_id: str = "seq", filters: DataFrame | None = None
) -> DataFrame:
    """The other side of JN-3: ``row_id`` of articles (data at rest) whose url or hash is
    stored."""
    return rows_having(articles, row_id, ["url", "content_hash"], store, filters)


def exists_flags(
    probes: DataFrame, store: DataFrame, row_id: str = "seq", filters: DataFrame | None = None
) -> DataFrame:
    """JN-4: ``found`` per probe row, by id or url or content hash.

    Null or empty identifiers match nothing; probes may repeat a key any number of times.
    The probes themselves meet the answer once, by ``row_id``.
    """
    keys = cut_lineage(probes.select(row_id, "id", "url", "content_hash"))
    hits = rows_having(keys, row_id, ["id", "url", "content_hash"], store, filters)
    found = F.coalesce("_found", F.lit(False))
    hits = hits.withColumn("_found", F.lit(True))
    return probes.join(hits, row_id, "left").withColumn("found", found).drop("_found")


def lookup(store: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """JN-7: stored articles for a list of ids, urls or hashes, at most one per key.

    Hashes may repeat in the store; the earliest row (``created_at``, ``id``) answers. The
    store is scanned, not shuffled, while the keys are few enough to be broadcast.
    """
    keys = cut_lineage(keys.select(column))
    if column != "content_hash":
        return having(store, keys, column)
    candidates = having(store.select(column, "created_at", "id"), keys, column)
    first = candidates.groupBy(column).agg(F.min(F.struct("created_at", "id")).alias("first"))
    return having(store, cut_lineage(first.select(F.col("first.id").alias("id"))), "id")


def top_unsent(store: DataFrame, min_score: float, limit: int) -> DataFrame:
    """TOP-1: best unsent articles; ``id`` breaks ties. Each task keeps at most ``limit`` rows."""
    return (
        unsent(store, min_score)
        .orderBy(F.desc("relevance_score"), F.desc("discovered_at"), "id")
        .limit(limit)
    )


def most_recent(store: DataFrame, limit: int) -> DataFrame:
    """TOP-2."""
    return store.orderBy(F.desc("discovered_at"), "id").limit(limit)
