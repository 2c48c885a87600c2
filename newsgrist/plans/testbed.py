"""Views over the driver's tables (FIXTURES.md section 2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsgrist.functions import bloom
from newsgrist.functions.lineage import scratch_path
from newsgrist.operators.dedup import drop_duplicates
from newsgrist.operators.normalize import normalize
from newsgrist.operators.relevance import Rules, score
from newsgrist.operators.store import KEYS
from newsgrist.plans.jobs import with_order
from newsgrist.schema import STORE_COLUMNS

NOW = "2024-01-08 00:00:00"
BASE = "2024-01-01 00:00:00"

RULES = Rules(
    categories={
        "English": ["the", "this"],
        "German": ["der", "und"],
        "Romance": ["les", "que", "para"],
        "Legal": ["license", "token"],
        "Tech": ["ai"],
    },
    title_weight=3, description_weight=1, category_weight=1, threshold=3,
)


# Tables with text to clean: worth spreading over the cores before any regex runs.
_TEXT_TABLES = {"documents": "doc_id", "pages": "page_id", "events": "event_id"}


def table(spark: SparkSession, sf_dir: str, name: str, *, spread: bool = True) -> DataFrame:
    """One of the driver's tables.

    A text table that Spark reads in fewer tasks than there are cores is spread by its key;
    a larger one is read as it is.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if spread and name in _TEXT_TABLES and df.rdd.getNumPartitions() < cores:
        df = df.repartition(cores, _TEXT_TABLES[name])
    return df


def after_base(amount: Column, seconds: int) -> Column:
    """``amount`` units of ``seconds`` after the base time."""
    start = F.unix_seconds(F.lit(BASE).cast("timestamp"))
    return F.timestamp_seconds(start + amount * seconds)


def _ord(rank: int, pos: Column) -> Column:
    return F.struct(
        F.lit(rank).alias("source_rank"), F.lit(0).alias("query_rank"),
        F.lit(None).cast("timestamp").alias("fetched_at"), F.lit(None).cast("bigint").alias("body_id"),
        pos.cast("bigint").alias("pos"),
    )


def pages_as_raw(pages: DataFrame) -> DataFrame:
    page = F.col("page_id")
    return pages.select(
        F.regexp_extract("url", "^https?://([^/?#]*)", 1).alias("source"),
        F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"),
        "url",
        page.cast("string").alias("source_id"),
        F.when(page % 7 != 0, after_base(page, 3600)).alias("published_at"),
        F.regexp_extract("html", "(?s)<article>(.*?)</article>", 1).alias("description"),
        _ord(0, page).alias("ord"),
    )


def raw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_as_raw(table(spark, sf_dir, "pages"))


def documents_as_raw(documents: DataFrame, *, own_source: bool = False) -> DataFrame:
    doc = F.col("doc_id")
    shown = F.when(doc % 7 == 3, doc - 3).otherwise(doc).cast("string")
    coarse = F.concat(F.lit("feed"), (doc % 4).cast("string"))
    source = F.col("source") if own_source else coarse
    breaks = F.instr("text", "\n")
    return documents.select(
        source.alias("source"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.concat(
            F.lit("https://news.example.com/d/"), shown, F.lit("?utm_source="), shown,
            F.lit("&id="), shown,
        ).alias("url"),
        doc.cast("string").alias("source_id"),
        after_base(doc, 60).alias("published_at"),
        F.when(breaks > 0, F.substr("text", breaks + 1)).alias("description"),
        _ord(1, doc).alias("ord"),
        "doc_id",
    )


def raw_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_as_raw(table(spark, sf_dir, "documents"))


def event_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id").cast("string")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("source"),
        F.concat("event_type", F.lit(" "), user).alias("title"),
        F.concat(
            F.lit("https://e.example.org/"), user, F.lit("?k="),
            F.get_json_object("props", "$.k"),
        ).alias("url"),
        F.col("event_id").cast("string").alias("source_id"),
        F.col("ts").cast("timestamp").alias("published_at"),
        _ord(2, F.col("event_id")).alias("ord"),
        "event_id",
    )


def articles(raw: DataFrame) -> DataFrame:
    return normalize(with_order(raw))


def as_store(scored: DataFrame) -> DataFrame:
    """Store columns of scored ``raw_documents``."""
    doc = F.col("doc_id")
    return scored.withColumns(
        {
            "id": doc.cast("string"),
            "discovered_at": after_base(doc, 60),
            "created_at": after_base(doc, 60),
            "sent": doc % 3 == 0,
            "sent_at": F.when(doc % 3 == 0, after_base(doc + 1, 60)),
        }
    ).select(*STORE_COLUMNS)


_TABLES: dict[tuple[str, str, str], DataFrame] = {}


def at_rest(name: str, spark: SparkSession, sf_dir: str, build) -> DataFrame:
    """A derived table, written once per application: stored articles are data at rest."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _TABLES:
        path = scratch_path(spark, name)
        build().write.parquet(path)
        _TABLES[key] = spark.read.parquet(path)
    return _TABLES[key]


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth document, as stored by an earlier run."""
    raw = raw_documents(spark, sf_dir).where("doc_id % 5 = 0")
    return at_rest("history", spark, sf_dir, lambda: as_store(articles(raw)))


def history_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Bloom filter of its keys, as written next to it."""
    return at_rest("history_keys", spark, sf_dir, lambda: bloom.build(history(spark, sf_dir), KEYS))


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, deduplicated and scored."""

    def build() -> DataFrame:
        kept = drop_duplicates(articles(raw_documents(spark, sf_dir)), normalized=True)
        return as_store(score(kept, RULES, normalized=True))

    return at_rest("store", spark, sf_dir, build)


def documents_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``raw_documents`` under the documents' own source names."""
    documents = table(spark, sf_dir, "documents", spread=False)
    return documents_as_raw(documents, own_source=True)


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of the documents' own sources: ranked by number, every fourth disabled."""
    names = table(spark, sf_dir, "documents", spread=False).select(F.col("source").alias("name")).distinct()
    rank = F.regexp_extract("name", "([0-9]+)$", 1).cast("int")
    return names.select(
        rank.alias("source_rank"), F.lit("feed").alias("kind"), "name",
        (rank % 4 != 0).alias("enabled"), F.lit(10).alias("max_items"),
    )
