"""The registered queries: one or more per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from newsgrist.functions.lineage import cut_lineage, scratch_path
from newsgrist.functions.patterns import matched_keywords
from newsgrist.functions.text import clean_text
from newsgrist.functions.urls import canonical_url
from newsgrist.operators import filters, history, metrics, outbox, quality, relevance
from newsgrist.operators.dedup import drop_duplicates, flag_duplicates, known_keys
from newsgrist.operators.normalize import split_quarantine
from newsgrist.operators.rulejoin import rule_index, score_by_table
from newsgrist.operators.store import (
    ArticleStore, append_violations, constraint_violations, decode_rows, encode_rows, upserted,
    with_delivery,
)
from newsgrist.plans import payloads, testbed as tb
from newsgrist.plans.jobs import Settings, batch_job, run, score_job, staged_run, with_order, written_run
from newsgrist.schema import ERROR_SCHEMA, PAYLOAD_SCHEMA, STORE_SCHEMA
from newsgrist.sources import scan_all, scan_feeds, scan_repos, scan_stories
from newsgrist.sources.contract import metadata_of
from newsgrist.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

FRESH_HOURS = 48
RUN_HOURS = 24 * 7 - 1
K = 50
SECRET = "token"
MAIL = r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+"


def _plain(df: DataFrame) -> DataFrame:
    """Times as UTC wall time, so results do not depend on the reader's zone."""
    times = [f.name for f in df.schema if isinstance(f.dataType, T.TimestampType)]
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in times}) if times else df


def query(fn: Query) -> Query:
    def answer(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return _plain(fn(spark, sf_dir))

    QUERIES[fn.__name__] = answer
    return fn


def _joined(column: str) -> Column:
    return F.array_join(column, "|").alias(column)


ARTICLE_FIELDS = ["title", "url", "source", "description", "published_at", "content_hash"]


# -- normalization ---------------------------------------------------------------------

@query
def normalize_pages(spark, sf_dir):
    return tb.articles(tb.raw_pages(spark, sf_dir)).select("ord.pos", *ARTICLE_FIELDS)


@query
def normalize_documents(spark, sf_dir):
    return tb.articles(tb.raw_documents(spark, sf_dir)).select("doc_id", *ARTICLE_FIELDS)


@query
def canonical_urls(spark, sf_dir):
    pages = tb.table(spark, sf_dir, "pages")
    return pages.select("page_id", "url", canonical_url(F.col("url")).alias("norm_url"))


@query
def quarantine(spark, sf_dir):
    """Every 25th page gets a host no url parser accepts."""
    broken = F.when(
        F.col("ord.pos") % 25 == 7, F.regexp_replace("url", "://", "://[")
    ).otherwise(F.col("url"))
    _, bad = split_quarantine(tb.raw_pages(spark, sf_dir).withColumn("url", broken))
    return bad.select("ord.pos", "url", "error")


# -- filters ---------------------------------------------------------------------------

@query
def fresh_articles(spark, sf_dir):
    feed = tb.event_feed(spark, sf_dir)
    return filters.fresh(feed, FRESH_HOURS, tb.NOW).select("event_id", "source", "published_at")


@query
def fresh_pages(spark, sf_dir):
    """A quarter of the pages has no time and stays."""
    pages = tb.raw_pages(spark, sf_dir)
    return filters.fresh(pages, RUN_HOURS, tb.NOW).select("ord.pos", "published_at")


@query
def valid_entries(spark, sf_dir):
    raw = tb.raw_documents(spark, sf_dir)
    blank = F.when(F.col("doc_id") % 11 == 5, F.lit(" \t")).otherwise(F.col("title"))
    return filters.valid_entries(raw.withColumn("title", blank)).select("doc_id", "title", "url")


@query
def source_head_n(spark, sf_dir):
    raw, sources = tb.documents_by_source(spark, sf_dir), tb.sources(spark, sf_dir)
    return filters.head_per_source(raw, sources).select("doc_id", "source")


@query
def enabled_sources(spark, sf_dir):
    raw, sources = tb.documents_by_source(spark, sf_dir), tb.sources(spark, sf_dir)
    return filters.enabled_only(raw, sources).select("doc_id", "source")


@query
def source_union(spark, sf_dir):
    """SET-1: records of all source kinds in one order."""
    parts = [tb.raw_pages(spark, sf_dir), tb.raw_documents(spark, sf_dir).drop("doc_id"),
             tb.event_feed(spark, sf_dir).drop("event_id")]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    return with_order(rows).select(_place().alias("seq"), "source", "source_id", "url")


def _place() -> Column:
    """Rank and position of a record as one number, for the result only."""
    return F.col("seq.source_rank").cast("bigint") * (1 << 43) + F.col("seq.pos")


# -- relevance -------------------------------------------------------------------------

def _scored(spark, sf_dir) -> DataFrame:
    return relevance.score(tb.articles(tb.raw_documents(spark, sf_dir)), tb.RULES, normalized=True)


@query
def keyword_matches(spark, sf_dir):
    words = [k for group in tb.RULES.categories.values() for k in group]
    found = matched_keywords(clean_text(F.col("text")), words)
    return tb.table(spark, sf_dir, "documents").select("doc_id", F.array_join(found, "|").alias("keywords"))


@query
def source_tag_match(spark, sf_dir):
    """Tags are the language and source of a document; German is asked for as 'DE'."""
    tagged = tb.table(spark, sf_dir, "documents").withColumn("categories", F.array("source", "lang"))
    return tagged.select("doc_id", relevance.source_tagged("DE").alias("tagged"))


@query
def relevance_scores(spark, sf_dir):
    return _scored(spark, sf_dir).select("doc_id", "relevance_score", "is_relevant")


@query
def relevant_articles(spark, sf_dir):
    return filters.relevant(_scored(spark, sf_dir), tb.RULES.threshold).select("doc_id", "relevance_score")


@query
def category_lists(spark, sf_dir):
    return _scored(spark, sf_dir).select("doc_id", _joined("categories"))


@query
def matched_keyword_lists(spark, sf_dir):
    return _scored(spark, sf_dir).select("doc_id", _joined("matched_keywords"))


@query
def top_relevant_pages(spark, sf_dir):
    """Flagship: pages normalized, scored, filtered, best 50."""
    scored = score_job(tb.raw_pages(spark, sf_dir), tb.RULES)
    best = filters.relevant(scored, tb.RULES.threshold)
    return (
        best.select(F.col("ord.pos").alias("page_id"), "title", "url", _joined("categories"), "relevance_score")
        .orderBy(F.desc("relevance_score"), "page_id")
        .limit(K)
    )


# -- dedup -----------------------------------------------------------------------------

def _documents(spark, sf_dir) -> DataFrame:
    return tb.articles(tb.raw_documents(spark, sf_dir))


@query
def dedup_first(spark, sf_dir):
    return drop_duplicates(_documents(spark, sf_dir), normalized=True).select("doc_id", "url")


@query
def dedup_split(spark, sf_dir):
    return flag_duplicates(_documents(spark, sf_dir), normalized=True).select("doc_id", "is_duplicate")


@query
def dedup_reason(spark, sf_dir):
    """With external hashes (one per 50 documents' length class), so all families occur."""
    rows = _documents(spark, sf_dir).withColumn(
        "content_hash",
        F.when(F.col("doc_id") % 9 == 1, F.concat(F.lit("h"), (F.col("doc_id") % 301).cast("string"))),
    )
    return flag_duplicates(rows).select("doc_id", "duplicate_reason")


@query
def dedup_preloaded(spark, sf_dir):
    raw = tb.raw_documents(spark, sf_dir)
    known = known_keys(
        urls_seen=raw.where("doc_id % 10 = 4").select("url"),
        titles_seen=raw.where("doc_id % 10 = 6").select("title", "source"),
    )
    rows = _documents(spark, sf_dir)
    return flag_duplicates(rows, normalized=True, known=known).select("doc_id", "duplicate_reason")


@query
def dedup_events(spark, sf_dir):
    """Heavy clashes: five titles per user share few urls."""
    rows = tb.articles(tb.event_feed(spark, sf_dir))
    return drop_duplicates(rows, normalized=True).select("event_id", "url", "title")


# -- history and lookups ---------------------------------------------------------------

@query
def history_anti(spark, sf_dir):
    stored, filters = tb.history(spark, sf_dir), tb.history_filters(spark, sf_dir)
    new = history.not_in_history(_documents(spark, sf_dir), stored, filters=filters)
    return new.select("doc_id", "url")


@query
def exists_flags(spark, sf_dir):
    doc = F.col("doc_id")
    probes = _documents(spark, sf_dir).select(
        "seq", "doc_id",
        F.when(doc % 2 == 0, (doc + 1).cast("string")).alias("id"),
        F.when(doc % 3 == 0, F.col("url")).otherwise("").alias("url"),
        F.when(doc % 7 == 0, F.col("content_hash")).alias("content_hash"),
    )
    stored, filters = tb.history(spark, sf_dir), tb.history_filters(spark, sf_dir)
    return history.exists_flags(probes, stored, filters=filters).select("doc_id", "found")


@query
def lookup_keys(spark, sf_dir):
    """By hash: clashing documents share one only if their text does too."""
    stored = tb.as_store(_documents(spark, sf_dir))
    keys = stored.where("cast(id as bigint) % 3 = 1")
    parts = [
        history.lookup(stored, keys, c).select(F.lit(c).alias("looked_up_by"), "id", "title")
        for c in ("id", "url", "content_hash")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# -- store -----------------------------------------------------------------------------

STORE_FIELDS = ["id", "title", "url", "relevance_score", "sent", "created_at"]


def _upserts(spark, sf_dir) -> DataFrame:
    """Every tenth document with another title and score, some twice."""
    raw = tb.raw_documents(spark, sf_dir).where("doc_id % 10 = 0")
    rows = tb.as_store(_scored_rows(raw)).withColumn("seq", F.col("id").cast("bigint") * 2)
    first = rows.withColumns({"title": F.concat(F.lit("new "), "title"), "relevance_score": F.lit(7.5),
                              "created_at": F.lit(tb.NOW).cast("timestamp")})
    again = first.where("seq % 60 = 0").withColumns(
        {"title": F.concat(F.lit("again "), "title"), "seq": F.col("seq") + 1}
    )
    return first.unionByName(again)


def _scored_rows(raw: DataFrame) -> DataFrame:
    return relevance.score(tb.articles(raw), tb.RULES, normalized=True)


@query
def upsert_articles(spark, sf_dir):
    return upserted(tb.store(spark, sf_dir), _upserts(spark, sf_dir)).select(*STORE_FIELDS)


def _results(store: DataFrame, limit: int = K) -> DataFrame:
    """Deliveries of the best unsent rows; every fourth id fails."""
    best = history.top_unsent(store, tb.RULES.threshold, limit)
    return best.select(
        "id", (F.col("id").cast("bigint") % 4 != 0).alias("ok"),
        F.lit(tb.NOW).cast("timestamp").alias("sent_at"),
    )


@query
def mark_sent(spark, sf_dir):
    store = tb.store(spark, sf_dir)
    return with_delivery(store, _results(store)).select("id", "sent", "sent_at")


@query
def apply_delivery(spark, sf_dir):
    store = tb.store(spark, sf_dir)
    return outbox.delivery_counts(_results(store))


@query
def store_encode(spark, sf_dir):
    return encode_rows(tb.store(spark, sf_dir)).select(
        "id", "published_at", "discovered_at", "sent_at", "categories", "sent"
    )


@query
def store_roundtrip(spark, sf_dir):
    """Encoded, damaged here and there, and decoded again."""
    doc = F.col("id").cast("bigint")
    encoded = encode_rows(tb.store(spark, sf_dir))
    damaged = encoded.withColumns(
        {
            "categories": F.when(doc % 5 == 1, '{"a": 1}').when(doc % 5 == 2, "[oops").otherwise(F.col("categories")),
            "published_at": F.when(doc % 6 == 1, "yesterday").otherwise(F.col("published_at")),
            "discovered_at": F.when(doc % 7 == 1, "12:00").otherwise(F.col("discovered_at")),
        }
    )
    decoded = decode_rows(damaged, tb.NOW)
    return decoded.select("id", "published_at", "discovered_at", "sent_at", _joined("categories"), "sent")


@query
def constraint_violation_rows(spark, sf_dir):
    """Not deduplicated, so urls clash."""
    rows = tb.as_store(_documents(spark, sf_dir))
    gaps = rows.withColumn("source", F.when(F.col("id").cast("bigint") % 8 != 2, F.col("source")))
    return constraint_violations(gaps)


@query
def append_check(spark, sf_dir):
    stored = tb.history(spark, sf_dir)
    batch = tb.as_store(_documents(spark, sf_dir).where("doc_id % 5 <> 0"))
    return append_violations(stored, batch, tb.history_filters(spark, sf_dir))


@query
def store_audit(spark, sf_dir):
    rows = tb.as_store(_documents(spark, sf_dir))
    doc = F.col("id").cast("bigint")
    rows = rows.withColumns(
        {"sent_at": F.when(doc % 6 != 0, F.col("sent_at")),
         "content_hash": F.when(doc % 9 == 0, "short").otherwise(F.col("content_hash"))}
    )
    return quality.store_audit(rows)


@query
def store_health(spark, sf_dir):
    return quality.store_status(quality.store_audit(tb.store(spark, sf_dir)))


@query
def mask_secrets(spark, sf_dir):
    docs = tb.table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.mask_columns(docs, ["text"], [SECRET, "abc"], [MAIL])


# Stands for a list that a deployment passes in.
MANY_SECRETS = [str(n) for n in range(1000, 6000)]


@query
def mask_many_secrets(spark, sf_dir):
    docs = tb.table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.mask_columns(docs, ["text"], MANY_SECRETS, [])


@query
def source_head_share(spark, sf_dir):
    """A cap of a fiftieth of all documents, which only hot sources reach."""
    raw, sources = tb.documents_by_source(spark, sf_dir), tb.sources(spark, sf_dir)
    cap = tb.table(spark, sf_dir, "documents", spread=False).count() // 50
    capped = sources.withColumn("max_items", F.lit(cap))
    return filters.head_per_source(raw, capped).select("doc_id", "source")


# -- top-k, counts, reports ------------------------------------------------------------

TOP_FIELDS = ["id", "title", "relevance_score", "discovered_at"]


@query
def unsent_articles(spark, sf_dir):
    return filters.unsent(tb.store(spark, sf_dir), tb.RULES.threshold).select("id", "relevance_score")


@query
def unsent_top_k(spark, sf_dir):
    return history.top_unsent(tb.store(spark, sf_dir), tb.RULES.threshold, K).select(*TOP_FIELDS)


@query
def recent_top_k(spark, sf_dir):
    return history.most_recent(tb.store(spark, sf_dir), K).select(*TOP_FIELDS)


@query
def article_counts(spark, sf_dir):
    return metrics.article_counts(tb.store(spark, sf_dir), tb.RULES.threshold)


@query
def status_report(spark, sf_dir):
    return metrics.status_report(tb.store(spark, sf_dir), tb.RULES.threshold)


def _staged(spark, sf_dir) -> DataFrame:
    return staged_run(
        tb.raw_documents(spark, sf_dir), tb.RULES, tb.history(spark, sf_dir),
        now=tb.NOW, max_age_hours=RUN_HOURS, filters=tb.history_filters(spark, sf_dir),
    )


@query
def full_run(spark, sf_dir):
    staged = _staged(spark, sf_dir)
    return staged.where(F.col("stage") == metrics.NEW).select("doc_id", "url", "relevance_score", _joined("categories"))


@query
def run_stages(spark, sf_dir):
    return _staged(spark, sf_dir).select("doc_id", "stage")


@query
def run_summary(spark, sf_dir):
    sources = tb.sources(spark, sf_dir)
    errors = spark.createDataFrame([], ERROR_SCHEMA)
    box = history.top_unsent(tb.store(spark, sf_dir), tb.RULES.threshold, K)
    return metrics.run_summary(_staged(spark, sf_dir), sources, errors, box, None, dry_run=True)


@query
def source_quality(spark, sf_dir):
    store = tb.store(spark, sf_dir)
    sent = store.join(_results(store).where("ok").select("id"), "id", "left_semi")
    return metrics.source_quality(_staged(spark, sf_dir), None, sent)


# -- outbox ----------------------------------------------------------------------------

@query
def outbox_messages(spark, sf_dir):
    """All stored articles as messages."""
    return outbox.with_message(tb.store(spark, sf_dir)).select("id", "message")


@query
def outbox_dry_run(spark, sf_dir):
    return outbox.build_outbox(tb.store(spark, sf_dir), tb.RULES.threshold, K).select("id", "message")


@query
def message_budget(spark, sf_dir):
    """Three budgets that force each way of shortening."""
    stored = tb.store(spark, sf_dir).select("id", "title", "url", "source", "author", "published_at", "description", "categories")
    sizes = [
        outbox.with_message(stored, max_message_length=n).select(F.lit(n).alias("budget"), "id", "message")
        for n in (250, 140, 50)
    ]
    return sizes[0].unionByName(sizes[1]).unionByName(sizes[2])


# -- jobs ------------------------------------------------------------------------------

@query
def score_job_pages(spark, sf_dir):
    scored = score_job(tb.raw_pages(spark, sf_dir), tb.RULES)
    return scored.select("ord.pos", "title", "url", "relevance_score", "is_relevant", _joined("matched_keywords"))


@query
def batch_job_documents(spark, sf_dir):
    done = batch_job(tb.raw_documents(spark, sf_dir), tb.RULES)
    return done.select("doc_id", "url", "relevance_score", "is_relevant", _joined("categories"))


@query
def batch_job_all_sources(spark, sf_dir):
    """Pages and documents together, in source order."""
    rows = tb.raw_pages(spark, sf_dir).unionByName(tb.raw_documents(spark, sf_dir).drop("doc_id"))
    return batch_job(rows, tb.RULES).select(_place().alias("seq"), "url", "relevance_score", _joined("categories"))


# -- sources ---------------------------------------------------------------------------

@query
def feed_scan(spark, sf_dir):
    raw, *_ = scan_feeds(*payloads.landed("feed", spark, sf_dir))
    return raw.select(
        "source", "ord.pos", "source_id", "title", "url", "author", "published_at", "description",
        F.array_join("metadata.entry_tags", "|").alias("tags"),
    )


@query
def story_scan(spark, sf_dir):
    raw, *_ = scan_stories(*payloads.landed("story", spark, sf_dir))
    return raw.select(
        "source", "ord.pos", "source_id", "title", "url", "author", "published_at",
        "metadata.score", "metadata.story_feed",
    )


@query
def repo_scan(spark, sf_dir):
    raw, *_ = scan_repos(*payloads.landed("repo", spark, sf_dir))
    return raw.select(
        "source", "metadata.query", "ord.pos", "source_id", "title", "url", "author",
        "published_at", "description", "metadata.stars",
    )


@query
def scan_errors(spark, sf_dir):
    parts = [
        scan_feeds(*payloads.landed("feed", spark, sf_dir)).errors,
        scan_stories(*payloads.landed("story", spark, sf_dir)).errors,
        scan_repos(*payloads.landed("repo", spark, sf_dir)).errors,
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def rule_audit(spark, sf_dir):
    """Sources of the feeds, with faults planted by rank."""
    _, sources = payloads.landed("feed", spark, sf_dir)
    rank = F.col("source_rank")
    faulty = sources.withColumns(
        {
            "url": F.when(rank % 10 == 1, "").when(rank % 10 == 2, "ftp://x").otherwise(F.col("url")),
            "max_items": F.when(rank % 7 == 0, 0).otherwise(F.col("max_items")),
        }
    )
    return quality.audit_sources(faulty)


def _payload_run(spark, sf_dir):
    """Feeds that landed twice or three times, up to the write, over an empty history."""
    landed, sources = payloads.landed("twice", spark, sf_dir)
    scan = scan_all(landed, sources)
    empty = spark.createDataFrame([], STORE_SCHEMA)
    return scan, sources, staged_run(scan.raw, tb.RULES, empty, now=tb.NOW, max_age_hours=RUN_HOURS)


@query
def payload_run(spark, sf_dir):
    _, _, staged = _payload_run(spark, sf_dir)
    hour = (F.unix_seconds("ord.fetched_at") - F.unix_seconds(F.lit(tb.NOW).cast("timestamp"))) / 3600
    return staged.select("source", hour.cast("int").alias("landing"), "ord.pos", "stage")


def _payload_results(staged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(outbox, results): the best persisted records; those of documents 0 mod 4 fail."""
    number = F.regexp_extract("url", "([0-9]+)$", 1).cast("bigint")
    best = staged.where(F.col("stage") == metrics.NEW).orderBy(F.desc("relevance_score"), number).limit(K)
    box = best.select("source", number.alias("id"))
    return box, box.select("source", "id", (F.col("id") % 4 != 0).alias("ok"))


@query
def payload_summary(spark, sf_dir):
    """Counters with failed fetches, silent sources and deliveries."""
    scan, sources, staged = _payload_run(spark, sf_dir)
    # Only what is counted and delivered is written: texts stay where the run has put them.
    staged, counts = written_run(staged.select("source", "stage", "url", "relevance_score"))
    box, results = _payload_results(staged)
    return metrics.run_summary(counts, sources, scan.errors, box, results, dry_run=False, good=scan.good)


@query
def payload_source_quality(spark, sf_dir):
    scan, _, staged = _payload_run(spark, sf_dir)
    _, results = _payload_results(staged)
    return metrics.source_quality(staged, scan.errors, results.where("ok").select("source"))


@query
def escaped_urls(spark, sf_dir):
    """A document's text as an escaped query, with signs that need not be escaped."""
    words = F.col("text")
    url = F.concat(
        F.lit("HTTPS://News.example.com:443//d/?utm_medium=x&q="), F.replace(F.url_encode(words), F.lit("+"), F.lit("%20")),
        F.lit("&b=%7E%2a&a="), F.url_encode(F.col("lang")), F.lit("#f"),
    )
    docs = tb.table(spark, sf_dir, "documents").select("doc_id", url.alias("url"))
    return docs.select("doc_id", canonical_url(F.col("url")).alias("norm_url"))


@query
def metadata_messages(spark, sf_dir):
    """Messages of repository records: stars with separators, language, score and author."""
    part = F.col("p_partkey")
    text = F.lit(None).cast("string")
    rows = tb.table(spark, sf_dir, "part").select(
        part.cast("string").alias("id"), F.col("p_name").alias("title"),
        F.concat(F.lit("https://code.example.com/"), part.cast("string")).alias("url"), F.lit("repos").alias("source"),
        F.when(part % 3 != 0, F.concat(F.lit("own"), (part % 7).cast("string"))).alias("author"),
        tb.after_base(part, 60).alias("published_at"), text.alias("description"),
        F.array().cast("array<string>").alias("categories"),
        metadata_of(
            stars=F.when(part % 5 != 0, (part * 977).cast("string")).otherwise("12k+"),
            language=F.when(part % 4 == 1, F.col("p_brand")), score=F.when(part % 6 == 2, F.col("p_size").cast("string")),
        ).alias("metadata"),
    )
    return outbox.with_message(rows).select("id", "message")


SYMBOLS = {"Sys": ["c++", "c#", "rust", " "], "Web": [" node.js", ".net", "go", ""]}
PHRASES = [
    "Modern C++ code", "Modern C++20 code", "All of (c#) here", "C# or Rust", "The .NET core", "Old asp.net core",
    "Go, gopher", "On Node.js now", "cargo and rusty", "c++",
]


def _picked(words: list[str], n: Column) -> Column:
    """One of ``words`` by number; the driver's texts hold few words of the rules themselves."""
    return F.get(F.array(*[F.lit(w) for w in words]), (n % len(words)).cast("int"))


@query
def rule_table_scores(spark, sf_dir):
    """Rules from a validated table, with keywords that are no words: over all documents, each
    with a phrase before its title and its description."""
    rules = quality.rules_of(quality.rules_frame(spark, SYMBOLS), threshold=tb.RULES.threshold)
    doc = F.col("doc_id")
    rows = tb.raw_documents(spark, sf_dir).select(
        doc, F.concat_ws(" ", _picked(PHRASES, doc), F.col("title")).alias("title"),
        F.concat_ws(" ", _picked(PHRASES, F.floor(doc / len(PHRASES))), F.coalesce("description", F.lit(""))).alias("description"),
        F.array().cast("array<string>").alias("categories"),
    )
    scored = relevance.score(rows, rules)
    return scored.select("doc_id", "relevance_score", _joined("categories"), _joined("matched_keywords"))


def rule_table(spark, sf_dir) -> DataFrame:
    """Every word of the documents as a keyword, by its length, and two-word phrases of the
    benchmark: about as many rules as there are different words."""
    words = tb.table(spark, sf_dir, "documents", spread=False).select(
        F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), F.lit(0)))).alias("keyword")
    ).distinct()
    phrases = tb.table(spark, sf_dir, "benchmark").select(
        F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+ [a-z]+"), F.lit(0))).alias("keyword")
    ).distinct()
    by_length = F.concat(F.lit("len"), F.char_length("keyword").cast("string"))
    return words.select(by_length.alias("category"), "keyword").unionByName(phrases.select(F.lit("phrases").alias("category"), "keyword"))


@query
def rule_join_scores(spark, sf_dir):
    """Rules as data over all documents, each tagged with the name of a category."""
    rows = tb.raw_documents(spark, sf_dir).select(
        "doc_id", "title", "description", F.array(F.concat(F.lit("LEN"), (F.col("doc_id") % 9).cast("string"))).alias("categories"),
    )
    scored = score_by_table(cut_lineage(rows), rule_index(rule_table(spark, sf_dir)), "doc_id")
    return scored.select(
        "doc_id", "relevance_score", _joined("categories"), F.size("matched_keywords").cast("bigint").alias("n_matched"),
        F.md5(F.array_join("matched_keywords", "|")).alias("matched_md5"),
    )


@query
def default_rule_scores(spark, sf_dir):
    """The default rules over all documents, each with one of their keywords in capitals before
    its description."""
    rules = relevance.Rules()
    words = [w.upper() for group in rules.categories.values() for w in group]
    rows = tb.raw_documents(spark, sf_dir).select(
        "doc_id", "title", F.concat(_picked(words, F.col("doc_id")), F.lit(", "), F.coalesce("description", F.lit(""))).alias("description"),
        F.array().cast("array<string>").alias("categories"),
    )
    return relevance.score(rows, rules).select("doc_id", "relevance_score", _joined("categories"), _joined("matched_keywords"))


# -- incremental -----------------------------------------------------------------------

def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables as a stream: its one file, or the files of its folder.

    A stream reads files of a folder; named by a pattern, the table may be either.
    """
    schema = tb.table(spark, sf_dir, name, spread=False).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{{{name}}}.parquet")


def _collected(stream: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """The stream's output, as a table in the shared folder."""
    path = scratch_path(spark, name)

    def work(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/data/batch={batch_id}")

    incremental.each_batch(stream, work, f"{path}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{path}/data/batch=*")


@query
def incremental_run(spark, sf_dir):
    """Documents as a stream, through the full run into a stored table."""
    raw = tb.documents_as_raw(_stream(spark, sf_dir, "documents")).drop("doc_id")
    path = scratch_path(spark, "articles")
    settings = Settings(rules=tb.RULES, max_age_hours=RUN_HOURS, notification_limit=K)
    incremental.incremental_records(
        raw, tb.sources(spark, sf_dir), f"{path}/store", f"{path}/checkpoint", settings,
        now=tb.NOW,
    )
    return ArticleStore(spark, f"{path}/store").read().select("url", "title", "relevance_score", "sent")


@query
def incremental_payloads(spark, sf_dir):
    """Landed feeds as a stream through the full run, delivered, and the batch run again."""
    landed, sources = payloads.landed("twice", spark, sf_dir)
    folder = scratch_path(spark, "landing")
    landed.write.parquet(folder)
    path = scratch_path(spark, "articles")
    settings = Settings(rules=tb.RULES, max_age_hours=RUN_HOURS, notification_limit=K)
    store = ArticleStore(spark, f"{path}/store")

    def deliver(box: DataFrame) -> DataFrame:
        number = F.regexp_extract("url", "([0-9]+)$", 1).cast("bigint")
        return box.select("id", (number % 4 != 0).alias("ok"), F.lit(tb.NOW).cast("timestamp").alias("sent_at"))

    now = datetime.fromisoformat(tb.NOW)
    incremental.incremental_run(
        incremental.landed_payloads(spark, folder), sources, store.path, f"{path}/checkpoint", settings, now=now, deliver=deliver,
    )
    run(spark.read.schema(PAYLOAD_SCHEMA).parquet(folder), sources, store, settings, batch_id=1, now=now, deliver=deliver)
    return store.read().select("url", "source", "relevance_score", "sent")


@query
def stream_freshness(spark, sf_dir):
    pages = tb.pages_as_raw(_stream(spark, sf_dir, "pages")).select("ord.pos", "published_at")
    return _collected(incremental.fresh_stream(pages, RUN_HOURS, tb.NOW), spark, "fresh")


@query
def stream_url_dedup(spark, sf_dir):
    """Distinct urls of the event stream, within a watermark longer than the data."""
    events = _stream(spark, sf_dir, "events").select(
        F.concat(F.lit("https://e.example.org/"), F.col("user_id").cast("string"), F.lit("?utm_id=1")).alias("url"),
        F.col("ts").cast("timestamp").alias("published_at"),
    )
    kept = incremental.url_dedup_stream(events, "published_at", "60 days")
    return _collected(kept.select("norm_url"), spark, "urls")
