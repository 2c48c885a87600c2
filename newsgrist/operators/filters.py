"""Row filters (FLT-1, FLT-2, FLT-4, FLT-5, SRC-15, SRC-16)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsgrist.functions.lineage import cut_lineage
from newsgrist.functions.skew import with_settings
from newsgrist.functions.text import is_blank

Instant = datetime | str


def _as_timestamp(value: Instant) -> Column:
    return F.lit(value).cast("timestamp")


def is_fresh(published_at: Column, max_age_hours: float, now: Instant) -> Column:
    """FLT-1: undated, or not older than ``max_age_hours`` before ``now`` (inclusive)."""
    if not max_age_hours > 0:
        raise ValueError(f"max_age_hours must be positive, got {max_age_hours}")
    cutoff = F.timestamp_micros(
        F.unix_micros(_as_timestamp(now)) - F.lit(round(max_age_hours * 3_600_000_000))
    )
    return published_at.isNull() | (published_at >= cutoff)


def fresh(articles: DataFrame, max_age_hours: float, now: Instant) -> DataFrame:
    return articles.where(is_fresh(F.col("published_at"), max_age_hours, now))


def valid_entries(raw: DataFrame) -> DataFrame:
    """FLT-2: title and url hold more than white space."""
    return raw.where(~is_blank(F.col("title")) & ~is_blank(F.col("url")))


def relevant(scored: DataFrame, threshold: float) -> DataFrame:
    """FLT-4."""
    return scored.where(F.col("relevance_score") >= F.lit(threshold))


def unsent(store: DataFrame, min_score: float = 0.0) -> DataFrame:
    """FLT-5: both conditions reach the Parquet scan."""
    return store.where(~F.col("sent") & (F.col("relevance_score") >= F.lit(min_score)))


def head_per_source(raw: DataFrame, sources: DataFrame) -> DataFrame:
    """SRC-15: the first ``max_items`` records of each source, in record order.

    The places (source, ord) are dealt to sorted ranges and counted there; sums of the counts
    before a range tell in which one a source reaches its cap. Only that range is ranked, and
    the records are cut at the place found. A cap may be larger than a task; ``ord`` is unique
    within a source.
    """
    limits = sources.where("max_items > 0").select(F.col("name").alias("source"), "max_items")
    places = with_settings(raw.select("source", "ord"), limits, "source", F.col("ord"))
    places = places.repartitionByRange("source", "ord").withColumn("_range", F.spark_partition_id())
    places = cut_lineage(places)
    counts = places.groupBy("source", "_range", "max_items").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    left = F.col("max_items") - F.col("before")
    reached = counts.where((left > 0) & (left <= F.col("n"))).select("source", "_range", left.alias("left"))
    rank = F.row_number().over(Window.partitionBy("source", "_range").orderBy("ord"))
    last = places.join(reached, ["source", "_range"]).withColumn("rank", rank).where("rank = left")
    ends = cut_lineage(limits.join(last.select("source", F.col("ord").alias("_last")), "source", "left").select("source", "_last"))
    kept = with_settings(raw, ends, "source", F.col("ord"))
    return kept.where(F.col("_last").isNull() | (F.col("ord") <= F.col("_last"))).drop("_last")


def enabled_only(raw: DataFrame, sources: DataFrame) -> DataFrame:
    """SRC-16: records of enabled sources."""
    names = sources.where("enabled").select(F.col("name").alias("source"))
    return with_settings(raw, names, "source", F.col("ord"))
