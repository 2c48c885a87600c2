"""Composite jobs (JOB-1..3, DD-4)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, functions as F

from newsgrist import fixed_values as fixed
from newsgrist.functions.lineage import cut_lineage
from newsgrist.operators import metrics
from newsgrist.operators.dedup import drop_duplicates, find_duplicates
from newsgrist.operators.filters import is_fresh
from newsgrist.operators.history import in_history
from newsgrist.operators.normalize import (
    normalize, published_time, split_quarantine, with_errors,
)
from newsgrist.operators.outbox import build_outbox
from newsgrist.operators.quality import check_numbers
from newsgrist.operators.relevance import Rules, score
from newsgrist.operators.store import ArticleStore
from newsgrist.sources import scan_all


def with_order(raw: DataFrame) -> DataFrame:
    """Adds ``seq``, the order of the records: the order struct, unless there is one."""
    return raw if "seq" in raw.columns else raw.withColumn("seq", F.col("ord"))


def score_job(raw: DataFrame, rules: Rules) -> DataFrame:
    """JOB-1: normalize and score; no shuffle."""
    good, _ = split_quarantine(raw)
    return score(normalize(good), rules, normalized=True)


def batch_job(raw: DataFrame, rules: Rules, known: DataFrame | None = None) -> DataFrame:
    """JOB-2: normalize, dedup, then score; irrelevant rows stay."""
    good, _ = split_quarantine(with_order(raw))
    articles = normalize(good)
    return score(drop_duplicates(articles, normalized=True, known=known), rules, normalized=True)


def staged_run(
    raw: DataFrame, rules: Rules, store: DataFrame, *, now: datetime | str,
    max_age_hours: float = fixed.MAX_AGE_HOURS, filters: DataFrame | None = None,
) -> DataFrame:
    """JOB-3 up to the write: every raw record with the ``stage`` it reached.

    The order is part of the result: freshness, score and threshold, then dedup, then the
    history check (a row in history still blocks later rows of the run).

    One pass over the input: text of invalid or stale records is set to null before any
    cleaning, and of irrelevant ones before the result is written, so both cost next to
    nothing. Afterwards only keys are shuffled. Records with one ``seq`` come from a fetch
    that landed twice; one of them stays.
    """
    if "published_at" not in raw.columns:
        raw = raw.withColumn("published_at", F.lit(None).cast("timestamp"))
    raw = with_order(raw)
    # Before any cleaning, and on the order alone.
    repeats = raw.groupBy("seq").agg(F.count("*").alias("n")).where("n > 1")
    if not repeats.isEmpty():
        raw = raw.dropDuplicates(["seq"])
    raw = with_errors(raw)
    raw = raw.withColumn("published_at", published_time(raw))
    alive = F.col("error").isNull() & is_fresh(F.col("published_at"), max_age_hours, now)
    texts = [c for c in ("title", "url", "author", "description", "content") if c in raw.columns]
    blanked = raw.withColumn("_alive", alive).withColumns(
        {c: F.when(F.col("_alive"), F.col(c)) for c in texts}
    )
    scored = score(normalize(blanked), rules, normalized=True)
    stage = (
        F.when(F.col("error").isNotNull(), metrics.INVALID)
        .when(~F.col("_alive"), metrics.STALE)
        .when(F.col("is_relevant"), metrics.NEW)
        .otherwise(metrics.IRRELEVANT)
    )
    payload = ["title", "url", "author", "description", "content_hash", "metadata"]
    staged = cut_lineage(
        scored.withColumn("stage", stage)
        .withColumns({c: F.when(F.col("stage") == metrics.NEW, F.col(c)) for c in payload})
        .drop("_alive")
    )

    relevant = staged.where(F.col("stage") == metrics.NEW)
    in_run = find_duplicates(relevant, normalized=True, reasons=False)
    in_run = cut_lineage(in_run.withColumn("_in_run", F.lit(True)))
    # First of their kind only: urls are unique here, so the history joins meet no hot key.
    keys = relevant.select("seq", "url", "content_hash").join(in_run, "seq", "left_anti")
    in_store = in_history(cut_lineage(keys), store, filters=filters).withColumn("_in_store", F.lit(True))
    stage = (
        F.when(F.col("_in_run"), metrics.REPEATED)
        .when(F.col("_in_store"), metrics.STORED)
        .otherwise(F.col("stage"))
    )
    return (
        staged.join(in_run, "seq", "left")
        .join(in_store, "seq", "left")
        .withColumn("stage", stage)
        .drop("_in_run", "_in_store")
    )


def written_run(staged: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """Staged records at rest, and their counters, observed by the job that writes them."""
    seen = Observation()
    written = cut_lineage(staged.observe(seen, *metrics.record_counts()))
    return written, seen.get


@dataclass(frozen=True)
class Settings:
    """Parameters of a run."""

    rules: Rules = Rules()
    max_age_hours: float = fixed.MAX_AGE_HOURS
    notification_limit: int = fixed.NOTIFICATION_LIMIT

    def check(self) -> None:
        rules = self.rules
        check_numbers(
            threshold=rules.threshold,
            weights=(rules.title_weight, rules.description_weight, rules.category_weight),
            max_age_hours=self.max_age_hours,
            limit=self.notification_limit,
        )


class Run(NamedTuple):
    """What a run leaves behind."""

    staged: DataFrame
    outbox: DataFrame
    summary: DataFrame
    errors: DataFrame


Deliver = Callable[[DataFrame], DataFrame]


def run_records(
    raw: DataFrame, errors: DataFrame, sources: DataFrame, store: ArticleStore,
    settings: Settings = Settings(), *, batch_id: int, now: datetime, deliver: Deliver | None = None,
    good: DataFrame | None = None,
) -> Run:
    """JOB-3 on raw records: stage, append, select the outbox, deliver, mark.

    ``deliver`` maps the outbox (at most ``notification_limit`` rows) to (id, ok, sent_at);
    without it the run is dry. Running a batch id again gives the same table, and delivers
    only what was not delivered before. ``good`` names the sources with a usable payload.
    """
    settings.check()
    threshold = settings.rules.threshold
    stored = store.create().read(without_batch=batch_id)
    filters = store.key_filters(without_batch=batch_id)
    staged, counts = written_run(
        staged_run(raw, settings.rules, stored, now=now, max_age_hours=settings.max_age_hours, filters=filters)
    )
    new = staged.where(F.col("stage") == metrics.NEW)
    store.append(new, batch_id, now)
    outbox = store.save_outbox(
        build_outbox(store.read(), threshold, settings.notification_limit), batch_id
    )
    results = None
    if deliver is not None:
        done = cut_lineage(store.read().where("sent").select("id"))
        results = cut_lineage(deliver(outbox.join(done, "id", "left_anti")))
        # A replay adds to the marks of its batch: they are read before they are replaced.
        store.mark_sent(results, batch_id)
    summary = metrics.run_summary(
        counts, sources, errors, outbox, results, dry_run=deliver is None, good=good
    )
    return Run(staged, outbox, summary, errors)


def run(
    payloads: DataFrame, sources: DataFrame, store: ArticleStore,
    settings: Settings = Settings(), *, batch_id: int, now: datetime | None = None,
    deliver: Deliver | None = None,
) -> Run:
    """JOB-3 on landed payloads. The registered scans write their records once: scanning and
    scoring in one stage would be more code than Spark compiles, and each would run again for
    the other's results."""
    scan = scan_all(payloads, sources)
    return run_records(
        scan.raw, scan.errors, sources, store, settings, good=scan.good,
        batch_id=batch_id, now=now or datetime.now(timezone.utc), deliver=deliver,
    )
