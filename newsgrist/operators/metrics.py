"""Counts and reports (AGG-4..7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Where a record of a run ended up.
INVALID, STALE, IRRELEVANT = "invalid", "stale", "below_threshold"
REPEATED, STORED, NEW = "duplicate_in_run", "duplicate_in_history", "persisted"


def article_counts(store: DataFrame, min_score: float = 0.0) -> DataFrame:
    """AGG-4."""
    return store.agg(
        F.count("*").alias("total_articles"),
        F.count_if("sent").alias("sent_articles"),
        F.count_if(~F.col("sent") & (F.col("relevance_score") >= min_score)).alias("unsent_articles"),
    )


def status_report(store: DataFrame, threshold: float) -> DataFrame:
    """AGG-5: one pass. Negative scores count in the total only."""
    counts = article_counts(store).columns
    open_row = ~F.col("sent")
    report = store.agg(
        F.count("*").alias("total_articles"),
        F.count_if("sent").alias("sent_articles"),
        F.count_if(open_row & (F.col("relevance_score") >= 0)).alias("unsent_articles"),
        F.count_if(open_row & (F.col("relevance_score") >= threshold)).alias("unsent_relevant"),
    )
    return report.select(
        *counts,
        "unsent_relevant",
        (F.col("unsent_articles") - F.col("unsent_relevant")).alias("unsent_filtered"),
    )


def record_counts() -> list[Column]:
    """The counters of AGG-6 that come from staged records: for an aggregate, or to be observed
    while the records are written."""

    def ended(*stages: str) -> Column:
        return F.count_if(F.col("stage").isin(*stages))

    return [
        F.count("*").alias("raw_articles"),
        F.count_if(F.col("stage") != INVALID).alias("processed_articles"),
        ended(STALE, IRRELEVANT).alias("filtered_articles"),
        ended(REPEATED, STORED).alias("duplicate_articles"),
        ended(NEW).alias("persisted_articles"),
    ]


def run_summary(
    staged: DataFrame | dict[str, int], sources: DataFrame, errors: DataFrame, outbox: DataFrame,
    results: DataFrame | None, *, dry_run: bool, good: DataFrame | None = None,
) -> DataFrame:
    """AGG-6: the counters of a run as one row.

    ``staged`` has a row per raw record with its ``stage``, or is what ``record_counts`` gave
    when they were written; ``results`` is null in a dry run.
    ``good`` names the sources with a usable payload: an enabled source without one did not
    succeed, whether or not it left an error. Without ``good`` all enabled sources without
    an error count.
    """
    if isinstance(staged, dict):
        records = sources.sparkSession.createDataFrame([staged], ", ".join(f"{k} bigint" for k in staged))
    else:
        records = staged.agg(*record_counts())
    enabled = sources.where("enabled").select(F.col("name").alias("source"))
    if good is None:
        failed = errors.where(F.col("query").isNull()).select("source")
        worked = enabled.join(failed, "source", "left_anti")
    else:
        worked = enabled.join(good.select("source"), "source", "left_semi")
    succeeded = worked.agg(F.count("*").alias("sources_succeeded"))
    attempted = sources.where("enabled").agg(F.count("*").alias("sources_attempted"))
    eligible = outbox.agg(F.count("*").alias("eligible_for_notification"))
    parts = [records, succeeded, attempted, eligible]
    if results is not None:
        parts.append(
            results.agg(
                F.count_if("ok").alias("sent_articles"),
                F.count_if(~F.col("ok")).alias("failed_notifications"),
            )
        )
    # One-row results put into one row by union and max, without a join.
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    names = rows.columns
    row = rows.agg(*[F.max(c).alias(c) for c in names])
    for name in ("sent_articles", "failed_notifications"):
        if name not in names:
            row = row.withColumn(name, F.lit(0).cast("bigint"))
    return row.select(
        "sources_attempted",
        "sources_succeeded",
        "raw_articles", "processed_articles", "filtered_articles", "duplicate_articles",
        "persisted_articles", "eligible_for_notification", "sent_articles",
        "failed_notifications", F.lit(dry_run).alias("dry_run"),
    )


def source_quality(
    staged: DataFrame, errors: DataFrame | None = None, sent: DataFrame | None = None
) -> DataFrame:
    """AGG-7: per source, records fetched, valid, duplicate, relevant, persisted, sent, errors.

    ``sent`` has a row per delivered article, ``errors`` one per failed fetch, both with
    ``source``. Counting is one union and one aggregate; a hot source combines map-side.
    """
    events = staged.select("source", "stage")
    for extra, stage in ((errors, "error"), (sent, "sent")):
        if extra is not None:
            events = events.unionByName(extra.select("source", F.lit(stage).alias("stage")))
    stage = F.col("stage")
    return events.groupBy("source").agg(
        F.count_if(~stage.isin("error", "sent")).alias("items_fetched"),
        F.count_if(~stage.isin("error", "sent", INVALID)).alias("items_valid"),
        F.count_if(stage.isin(REPEATED, STORED)).alias("items_duplicate"),
        F.count_if(stage.isin(REPEATED, STORED, NEW)).alias("items_relevant"),
        F.count_if(stage == NEW).alias("items_persisted"),
        F.count_if(stage == "sent").alias("items_sent"),
        F.count_if(stage == "error").alias("errors"),
    )
