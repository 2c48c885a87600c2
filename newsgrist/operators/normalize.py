"""Raw records to articles (PRJ-1, PRJ-2, FN-9, FLT-6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from newsgrist.functions import text, times, urls
from newsgrist.schema import empty_metadata

RAW_DEFAULTS = {
    "source_id": "string", "author": "string", "description": "string", "content": "string",
}


def _digest(title: Column, url: Column, description: Column, content: Column) -> Column:
    blank = F.lit("")
    parts = [F.coalesce(p, blank) for p in (title, url, description, content)]
    return F.coalesce(F.sha2(F.concat_ws("\n", *parts), 256), blank)


def content_hash(
    title: Column, url: Column, description: Column | None = None, content: Column | None = None
) -> Column:
    """FN-9 of arbitrary fields: each is normalized, then hashed."""
    none = F.lit(None).cast("string")
    return _digest(
        text.clean_title(title),
        urls.canonical_url(url),
        text.clean_text(none if description is None else description),
        text.clean_text(none if content is None else content),
    )


def published_time(raw: DataFrame) -> Column:
    """FN-8 of ``published_at``, which may be text or a timestamp."""
    if isinstance(raw.schema["published_at"].dataType, T.StringType):
        return times.parse_timestamp(F.col("published_at"))
    return F.col("published_at").cast("timestamp")


def with_errors(raw: DataFrame) -> DataFrame:
    """``raw`` plus ``error``: why a record cannot be normalized, null for good ones."""
    return raw.withColumn("error", urls.url_error(F.coalesce("url", F.lit(""))))


def normalize(raw: DataFrame) -> DataFrame:
    """PRJ-1 over valid records: clean fields, canonical url, UTC time, content hash.

    ``ord``, ``metadata`` and further columns are carried along; ``content`` enters the hash
    and is dropped. The second cleaning pass inside the hash is skipped for text that
    cannot change.
    """
    for name, kind in RAW_DEFAULTS.items():
        if name not in raw.columns:
            raw = raw.withColumn(name, F.lit(None).cast(kind))
    if "published_at" not in raw.columns:
        raw = raw.withColumn("published_at", F.lit(None).cast("timestamp"))
    if "metadata" not in raw.columns:
        raw = raw.withColumn("metadata", empty_metadata())
    author = F.col("author")
    # Tags go in a projection of their own: decoding reads its input more than once.
    untagged = raw.withColumns(
        {
            "title": text.without_title_tags(F.col("title")),
            "description": text.without_description_tags(F.col("description")),
        }
    )
    cleaned = untagged.withColumns(
        {
            "title": text.clean_text(F.col("title")),
            "url": urls.canonical_url(F.col("url")),
            "source": text.clean_text(F.col("source")),
            "author": F.when(F.coalesce(author, F.lit("")) != "", text.clean_text(author)),
            "description": text.clean_text(F.col("description")),
            "published_at": published_time(raw),
            "content": text.clean_text(F.col("content")),
        }
    )
    return cleaned.withColumns(
        {
            "content_hash": _digest(
                text.clean_title_again(F.col("title")),
                urls.canonical_url(F.col("url")),
                text.clean_again(F.col("description")),
                F.col("content"),
            ),
            "description": F.nullif(F.col("description"), F.lit("")),
            "categories": F.array().cast("array<string>"),
            "relevance_score": F.lit(0.0),
            "sent": F.lit(False),
            "sent_at": F.lit(None).cast("timestamp"),
        }
    ).drop("content", "source_id")


def split_quarantine(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """FLT-6: (records to process, records set aside with their ``error``)."""
    checked = with_errors(raw)
    return (
        checked.where(F.col("error").isNull()).drop("error"),
        checked.where(F.col("error").isNotNull()),
    )
