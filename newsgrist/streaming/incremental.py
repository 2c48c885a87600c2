"""Incremental runs (STR-1..3).

A cron run becomes an ``availableNow`` query: it takes the payload files landed since the
last one and stops. The query's checkpoint remembers which files are done, and the batch id
makes a repeated batch overwrite its own writes.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsgrist.functions.urls import canonical_url
from newsgrist.operators.filters import Instant, is_fresh
from newsgrist.operators.store import ArticleStore
from newsgrist.plans.jobs import Deliver, Settings, run, run_records
from newsgrist.schema import ERROR_SCHEMA, PAYLOAD_SCHEMA


def landed_payloads(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Stream of payload files (Parquet) as they land."""
    return (
        spark.readStream.schema(PAYLOAD_SCHEMA)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(path)
    )


def each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Run ``work(batch, batch_id)`` over everything available now, then return."""
    query = (
        stream.writeStream.foreachBatch(work)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def incremental_run(
    payloads: DataFrame, sources: DataFrame, store_path: str, checkpoint: str,
    settings: Settings = Settings(), *, now: datetime | None = None,
    deliver: Deliver | None = None,
) -> None:
    """STR-1: JOB-3 per micro-batch of landed payloads, against the stored history."""

    def work(batch: DataFrame, batch_id: int) -> None:
        store = ArticleStore(batch.sparkSession, store_path)
        # Store batch 0 is the empty table.
        at = now or datetime.now(timezone.utc)
        run(batch, sources, store, settings, batch_id=batch_id + 1, now=at, deliver=deliver)

    each_batch(payloads, work, checkpoint)


def incremental_records(
    raw: DataFrame, sources: DataFrame, store_path: str, checkpoint: str,
    settings: Settings = Settings(), *, now: datetime | None = None,
) -> None:
    """STR-1 for a stream of raw records, as a dry run."""

    def work(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        errors = spark.createDataFrame([], ERROR_SCHEMA)
        at = now or datetime.now(timezone.utc)
        run_records(
            batch, errors, sources, ArticleStore(spark, store_path), settings,
            batch_id=batch_id + 1, now=at,
        )

    each_batch(raw, work, checkpoint)


def fresh_stream(articles: DataFrame, max_age_hours: float, now: Instant) -> DataFrame:
    """STR-2: late records are dropped against the run's clock, undated ones kept.

    A plain filter, not a watermark: a watermark follows the newest event seen and trims
    state, it does not drop rows of a stateless query.
    """
    return articles.where(is_fresh(F.col("published_at"), max_age_hours, now))


def url_dedup_stream(articles: DataFrame, event_time: str, delay: str) -> DataFrame:
    """STR-3: one record per canonical url within ``delay``, with bounded state.

    Weaker than DD-1: urls only, and repeats further apart than ``delay`` pass.
    """
    return (
        articles.withColumn("norm_url", canonical_url(F.col("url")))
        .withWatermark(event_time, delay)
        .dropDuplicatesWithinWatermark(["norm_url"])
    )
