"""JOB-3, AGG-6, AGG-7, FLT-1, FLT-6 and STR-1..3."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsgrist.operators import filters, metrics
from newsgrist.operators.relevance import Rules
from newsgrist.operators.store import ArticleStore
from newsgrist.plans.jobs import Settings, run, run_records, staged_run, written_run
from newsgrist.plans.queries import QUERIES
from newsgrist.schema import ERROR_SCHEMA, PAYLOAD_SCHEMA, SOURCE_SCHEMA, STORE_SCHEMA
from newsgrist.streaming import incremental

NOW = datetime(2026, 9, 19, 12)
RULES = Rules({"AI": ["artificial intelligence", "llm"], "Programming": ["python"]})
RAW = ("source string, title string, url string, author string, published_at timestamp, description string,"
       " content string, ord struct<source_rank:int,query_rank:int,pos:bigint>")


def raws(spark, rows):
    """(source, title, url, description, hours old or None)"""
    data = [(s, t, u, None, None if h is None else NOW - timedelta(hours=h), d, None, (0, 0, i))
            for i, (s, t, u, d, h) in enumerate(rows)]
    return spark.createDataFrame(data, RAW).repartition(3)


def stages(spark, rows, store=None, **kw):
    store = spark.createDataFrame([], STORE_SCHEMA) if store is None else store
    staged = staged_run(raws(spark, rows), RULES, store, now=NOW, **kw)
    return [r.stage for r in staged.orderBy("seq").collect()]


def test_stages(spark):
    rows = [
        ("a", "Python one", "https://e.com/1", None, 1),
        ("a", "Python old", "https://e.com/2", None, 60),
        ("a", "Python undated", "https://e.com/3", None, None),
        ("a", "Weather", "https://e.com/4", None, 1),
        ("b", "Python again", "https://e.com/1?utm_source=x", None, 1),
        ("b", "Python broken", "http://[bad", None, 1),
        ("b", "LLM edge", "https://e.com/5", None, 48),
    ]
    assert stages(spark, rows) == [metrics.NEW, metrics.STALE, metrics.NEW, metrics.IRRELEVANT,
                                   metrics.REPEATED, metrics.INVALID, metrics.NEW]


def test_scored_before_dedup(spark):
    """Same title and source; the first one is below the threshold and must not block."""
    rows = [("a", "News today", "https://e.com/1", "nothing", 1),
            ("a", "News today", "https://e.com/2", "python and llm", 1)]
    strict = Rules(RULES.categories, threshold=4)
    empty = spark.createDataFrame([], STORE_SCHEMA)
    out = staged_run(raws(spark, rows), strict, empty, now=NOW).orderBy("seq").collect()
    assert [r.stage for r in out] == [metrics.IRRELEVANT, metrics.NEW]


def test_stored_row_still_blocks_the_run(spark):
    """Row 1 is in history by url; row 2 shares only its title and is dropped by it."""
    stored = spark.createDataFrame([], STORE_SCHEMA).select("url", "content_hash").union(
        spark.createDataFrame([("https://e.com/1", "h")], "url string, content_hash string"))
    rows = [("a", "Python x", "https://e.com/1", None, 1), ("a", "Python x", "https://e.com/9", None, 1)]
    assert stages(spark, rows, stored) == [metrics.STORED, metrics.REPEATED]


def test_text_times(spark):
    rows = raws(spark, [("a", "Python", "https://e.com/1", None, 1)])
    text = rows.withColumn("published_at", F.lit("Sat, 12 Sep 2026 10:00:00 +0000"))
    empty = spark.createDataFrame([], STORE_SCHEMA)
    assert staged_run(text, RULES, empty, now=NOW).first().stage == metrics.STALE


def test_freshness_bounds(spark):
    df = spark.createDataFrame([(NOW - timedelta(hours=48),), (NOW - timedelta(hours=48, seconds=1),), (None,)], "published_at timestamp")
    assert filters.fresh(df, 48, NOW).count() == 2
    assert filters.fresh(df, 47.5, NOW).count() == 1
    for bad in (0, -1):
        with pytest.raises(ValueError):
            filters.fresh(df, bad, NOW)


def test_no_publication_time_at_all(spark):
    rows = raws(spark, [("a", "Python", "https://e.com/1", None, 1)]).drop("published_at")
    assert staged_run(rows, RULES, spark.createDataFrame([], STORE_SCHEMA), now=NOW).first().stage == metrics.NEW


def test_large_ranks_and_many_queries(spark):
    at = [(2_000_000, 0, 0), (2_000_000, 200, 5), (1_999_999, 150, 1 << 40), (2_000_000, 200, 4)]
    rows = [("a", f"Python {i}", "https://e.com/same", None, None, None, None, o) for i, o in enumerate(at)]
    out = staged_run(spark.createDataFrame(rows, RAW), RULES, spark.createDataFrame([], STORE_SCHEMA), now=NOW)
    assert {tuple(r.seq): r.stage for r in out.collect()} == {o: metrics.NEW if o[0] == 1_999_999 else metrics.REPEATED for o in at}


FEED = """<rss version="2.0"><channel>{}</channel></rss>"""
ITEM = "<item><title>{}</title><link>https://e.com/{}</link></item>"


def payloads(spark, bodies):
    data = [(s, "feed", None, 200, NOW, FEED.format("".join(ITEM.format(t, u) for t, u in items))) for s, items in bodies]
    return spark.createDataFrame(data, PAYLOAD_SCHEMA)


def feed_sources(spark, *names):
    rows = [(i, "feed", n, True, 30, "https://x", [], None, []) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, SOURCE_SCHEMA)


def deliver(outbox):
    return outbox.select("id", (~F.col("title").contains("fails")).alias("ok"), F.lit(NOW).alias("sent_at"))


def counters(result):
    return result.summary.first().asDict()


def test_full_runs(spark, tmp_path):
    store = ArticleStore(spark, str(tmp_path / "store"))
    src = feed_sources(spark, "one", "two", "down")
    pay = payloads(spark, [("one", [("Python a", 1), ("LLM fails", 2), ("Rain", 3)]), ("two", [("Python b", 1), ("llm c", 4)])])
    pay = pay.union(spark.createDataFrame([("down", "feed", None, 500, NOW, "")], PAYLOAD_SCHEMA))
    dry = counters(run(pay, src, store, Settings(RULES), batch_id=1, now=NOW))
    want = {"sources_attempted": 3, "sources_succeeded": 2, "raw_articles": 5, "processed_articles": 5, "filtered_articles": 1,
            "duplicate_articles": 1, "persisted_articles": 3, "eligible_for_notification": 3, "sent_articles": 0,
            "failed_notifications": 0, "dry_run": True}
    assert dry == want
    assert store.read().where("sent").count() == 0

    # The same payloads again: nothing new, the backlog is delivered.
    second = run(pay, src, store, Settings(RULES), batch_id=2, now=NOW, deliver=deliver)
    got = counters(second)
    assert (got["persisted_articles"], got["duplicate_articles"], got["eligible_for_notification"]) == (0, 4, 3)
    assert (got["sent_articles"], got["failed_notifications"], got["dry_run"]) == (2, 1, False)
    assert {r.title for r in store.read().where("not sent").collect()} == {"LLM fails"}
    quality = {r.source: r for r in metrics.source_quality(second.staged, second.errors).collect()}
    assert quality["down"].errors == 1 and quality["one"].items_fetched == 3 and quality["two"].items_duplicate == 2

    # Batch 2 replayed: the same outbox, the same table.
    replay = run(pay, src, store, Settings(RULES), batch_id=2, now=NOW, deliver=deliver)
    assert sorted(r.id for r in replay.outbox.collect()) == sorted(r.id for r in second.outbox.collect())
    assert store.read().count() == 3 and store.read().where("sent").count() == 2

    # The failed one stays eligible; the limit holds.
    third = counters(run(pay, src, store, Settings(RULES, notification_limit=1), batch_id=3, now=NOW, deliver=deliver))
    assert (third["eligible_for_notification"], third["failed_notifications"]) == (1, 1)


def test_counters_are_observed_by_the_write(spark):
    """They equal an aggregate over the records, which is then not needed."""
    stages = [metrics.INVALID, metrics.STALE, metrics.IRRELEVANT, metrics.REPEATED, metrics.STORED, metrics.NEW, metrics.NEW]
    staged = spark.createDataFrame([(s,) for s in stages * 30], "stage string").repartition(5)
    written, counts = written_run(staged)
    assert counts == written.agg(*metrics.record_counts()).first().asDict()
    src, none = feed_sources(spark, "one"), spark.createDataFrame([], ERROR_SCHEMA)
    box = spark.createDataFrame([], "id string")
    summary = metrics.run_summary(counts, src, none, box, None, dry_run=True)
    assert "parquet" not in summary._jdf.queryExecution().optimizedPlan().toString().lower()
    assert summary.first() == metrics.run_summary(written, src, none, box, None, dry_run=True).first()


def test_bad_settings_raise_before_any_work(spark, tmp_path):
    store = ArticleStore(spark, str(tmp_path / "s"))
    with pytest.raises(ValueError):
        run_records(raws(spark, []), spark.createDataFrame([], ERROR_SCHEMA), feed_sources(spark), store,
                    Settings(RULES, max_age_hours=0), batch_id=1, now=NOW)


def test_one_source_lands_twice(spark, tmp_path):
    """Two bodies at shifted positions, one of them landed twice, and a repeated position."""
    store = ArticleStore(spark, str(tmp_path / "store"))
    first = payloads(spark, [("one", [("Python a", 1), ("Python b", 2)])])
    second = payloads(spark, [("one", [("Python c", 3), ("Python a", 1), ("Python b", 2)])])
    both = first.union(second.withColumn("fetched_at", F.col("fetched_at") + F.expr("interval 1 hour"))).union(first)
    out = run(both, feed_sources(spark, "one"), store, Settings(RULES), batch_id=1, now=NOW)
    assert out.staged.select("seq").distinct().count() == out.staged.count() == 5
    assert {r.title for r in store.read().collect()} == {"Python a", "Python b", "Python c"}


def test_replay_does_not_deliver_again(spark, tmp_path):
    store = ArticleStore(spark, str(tmp_path / "store"))
    src, pay = feed_sources(spark, "one", "silent"), payloads(spark, [("one", [("Python a", 1), ("LLM fails", 2)])])
    handed = []

    def counting(outbox):
        handed.extend(r.id for r in outbox.collect())
        return deliver(outbox)

    for _ in range(2):
        out = run(pay, src, store, Settings(RULES), batch_id=1, now=NOW, deliver=counting)
    ids = {r.title: r.id for r in store.read().collect()}
    assert handed.count(ids["Python a"]) == 1 and handed.count(ids["LLM fails"]) == 2
    assert [r.title for r in store.read().where("sent").collect()] == ["Python a"]
    # A source without any payload did not succeed.
    assert (counters(out)["sources_attempted"], counters(out)["sources_succeeded"]) == (2, 1)


def test_fetches_without_an_answer_fail(spark, tmp_path):
    none = spark.createDataFrame([("one", "feed", None, None, NOW, None), ("two", "feed", None, 200, NOW, None)], PAYLOAD_SCHEMA)
    out = run(none, feed_sources(spark, "one", "two"), ArticleStore(spark, str(tmp_path / "s")), Settings(RULES), batch_id=1, now=NOW)
    assert {(e.source, e.message) for e in out.errors.collect()} == {("one", "no response"), ("two", "no body")}
    assert counters(out)["sources_succeeded"] == 0


def test_incremental(spark, tmp_path):
    landing, store, mark = (str(tmp_path / n) for n in ("landing", "store", "mark"))
    src = feed_sources(spark, "one")
    step = lambda: incremental.incremental_run(
        incremental.landed_payloads(spark, landing), src, store, mark, Settings(RULES), now=NOW)
    payloads(spark, [("one", [("Python a", 1), ("Rain", 2)])]).write.mode("append").parquet(landing)
    step()
    assert {r.title for r in ArticleStore(spark, store).read().collect()} == {"Python a"}
    step()  # nothing landed
    payloads(spark, [("one", [("Python a", 1), ("Python b", 3)])]).write.mode("append").parquet(landing)
    step()
    assert {r.title for r in ArticleStore(spark, store).read().collect()} == {"Python a", "Python b"}


def test_stream_filters(spark, tmp_path):
    path = str(tmp_path / "in")
    rows = [("https://e.com/1?utm_source=a", NOW), ("https://e.com/1", NOW), ("https://e.com/2", NOW - timedelta(days=9)), ("https://e.com/3", None)]
    df = spark.createDataFrame(rows, "url string, published_at timestamp")
    df.write.parquet(path)
    seen = {}

    def collect(name):
        def work(batch, _):
            seen.setdefault(name, []).extend(batch.collect())
        return work

    stream = lambda: spark.readStream.schema(df.schema).parquet(path)
    incremental.each_batch(incremental.fresh_stream(stream(), 48, NOW), collect("fresh"), str(tmp_path / "c1"))
    assert len(seen["fresh"]) == 3
    dated = stream().where("published_at is not null")
    incremental.each_batch(incremental.url_dedup_stream(dated, "published_at", "30 days"), collect("urls"), str(tmp_path / "c2"))
    assert sorted(r.norm_url for r in seen["urls"]) == ["https://e.com/1", "https://e.com/2"]


def test_streams_of_files_and_folders(spark, tmp_path):
    rows = [(i, f"https://e.example.org/{i}", "<title>t</title>") for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder, single = tmp_path / "folder", tmp_path / "single"
    single.mkdir()
    pages.repartition(3).write.parquet(str(folder / "pages.parquet"))
    part = tmp_path / "part"
    pages.coalesce(1).write.parquet(str(part))
    next(part.glob("*.parquet")).rename(single / "pages.parquet")
    for path in (folder, single):
        got = QUERIES["stream_freshness"](spark, str(path))
        assert sorted(r.pos for r in got.collect()) == list(range(20))


def test_repeats_go_before_cleaning(spark, monkeypatch):
    from newsgrist.plans import jobs
    written = []
    monkeypatch.setattr(jobs, "cut_lineage", lambda df: written.append(df) or df)
    raw = raws(spark, [("s", "python a", "https://e.com/1", None, 1), ("s", "python b", "https://e.com/2", None, 1)])
    staged = staged_run(raw.unionByName(raw), RULES, spark.createDataFrame([], STORE_SCHEMA), now=NOW)
    assert staged.count() == 2 and written[0].count() == 2


def test_summary_writes_no_texts(spark, monkeypatch):
    from newsgrist.plans import queries
    from newsgrist.sources import Scan
    written = []
    real = queries.written_run
    monkeypatch.setattr(queries, "written_run", lambda df: written.append(df.columns) or real(df))
    staged = staged_run(raws(spark, [("s", "python a", "https://e.com/1", "x", 1)]), RULES, spark.createDataFrame([], STORE_SCHEMA), now=NOW)
    scan = Scan(None, spark.createDataFrame([], ERROR_SCHEMA), staged.select("source"))
    src = spark.createDataFrame([(0, "feed", "s", True, 9, "", [], "", [])], SOURCE_SCHEMA)
    monkeypatch.setattr(queries, "_payload_run", lambda *_: (scan, src, staged))
    row = QUERIES["payload_summary"](spark, "").first()
    assert (row.raw_articles, row.persisted_articles, row.sent_articles, row.failed_notifications) == (1, 1, 1, 0)
    assert "description" not in written[0] and "title" not in written[0]
