"""Record schemas and the explicit row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

METADATA = (
    "struct<feed_categories:array<string>,entry_tags:array<string>,story_feed:string,"
    "type:string,score:string,descendants:bigint,query:string,stars:string,forks:bigint,"
    "language:string,topics:array<string>,created_at:string,updated_at:string,"
    "pushed_at:string>"
)
# A record's place in the processing order: its source, the query, the fetch (time, then a
# digest of the body, as a source may land more than once in a run) and the item in it.
ORD = "struct<source_rank:int,query_rank:int,fetched_at:timestamp,body_id:bigint,pos:bigint>"

RAW_SCHEMA = (
    "source string, title string, url string, source_id string, author string, "
    "published_at timestamp, description string, content string, "
    f"metadata {METADATA}, ord {ORD}"
)
RAW_COLUMNS = [
    "source", "title", "url", "source_id", "author", "published_at", "description",
    "content", "metadata", "ord",
]

STORE_SCHEMA = (
    "id string, title string, url string, source string, author string, "
    "published_at timestamp, description string, categories array<string>, "
    "relevance_score double, discovered_at timestamp, content_hash string, "
    f"sent boolean, sent_at timestamp, metadata {METADATA}, created_at timestamp"
)
STORE_COLUMNS = [
    "id", "title", "url", "source", "author", "published_at", "description", "categories",
    "relevance_score", "discovered_at", "content_hash", "sent", "sent_at", "metadata",
    "created_at",
]
STORE_REQUIRED = [
    "id", "title", "url", "source", "categories", "relevance_score", "discovered_at",
    "sent", "created_at",
]

PAYLOAD_SCHEMA = (
    "source string, kind string, query string, http_status int, fetched_at timestamp, "
    "body string"
)
SOURCE_SCHEMA = (
    "source_rank int, kind string, name string, enabled boolean, max_items int, url string, "
    "categories array<string>, story_feed string, queries array<string>"
)
ERROR_SCHEMA = "source string, kind string, query string, message string"

def empty_metadata() -> Column:
    return F.lit(None).cast(METADATA)


def conform(df: DataFrame, columns: list[str], schema: str, *extra: str) -> DataFrame:
    """``columns`` in order and of their types, null where absent; then ``extra`` as it is."""
    types = {f.name: f.dataType for f in df.sparkSession.createDataFrame([], schema).schema}
    return df.select(
        *[
            (F.col(c) if c in df.columns else F.lit(None)).cast(types[c]).alias(c)
            for c in columns
        ],
        *extra,
    )
