"""Story id lists and story items (SRC-9..11, FLT-3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsgrist.functions.pinned import pinned
from newsgrist.functions.text import is_blank, strip
from newsgrist.functions.times import epoch_timestamp
from newsgrist.sources.contract import (
    Scan, errors_of, http_error, metadata_of, order_of, payloads_of,
)


def json_kind(value: Column) -> Column:
    """Type name of a VARIANT, such as STRING, BIGINT or OBJECT."""
    return F.regexp_extract(F.schema_of_variant(value), r"\A[A-Z]+", 0)


def json_elements(value: Column) -> Column:
    """The elements of a JSON list; null for any other type."""
    return F.try_variant_get(value, "$", "array<variant>")


def json_text(item: Column, path: str) -> Column:
    """A non-empty JSON string; null for any other type."""
    value = F.try_variant_get(item, path, "variant")
    text = F.try_variant_get(item, path, "string")
    return F.when((json_kind(value) == "STRING") & (text != ""), text)


def is_true(item: Column, path: str) -> Column:
    """The JSON value true itself, not 1 or 'true'."""
    value = F.try_variant_get(item, path, "variant")
    flag = (json_kind(value) == "BOOLEAN") & F.try_variant_get(item, path, "boolean")
    return F.coalesce(flag, F.lit(False))


def scan_stories(payloads: DataFrame, sources: DataFrame) -> Scan:
    """A payload with a null ``query`` is a feed's id list; the others are items, ``query``
    being the item id. Items that are missing, failed or not objects are skipped."""
    fetched = pinned(
        payloads_of("stories", payloads, sources), "*", json=F.try_parse_json(F.col("body"))
    )
    status = http_error(F.col("http_status"), F.col("body"))

    lists = fetched.where("query is null").withColumn(
        "problem",
        F.coalesce(
            status,
            F.when(F.col("json").isNull(), F.lit("invalid JSON")),
            F.when(json_kind(F.col("json")) != "ARRAY", F.lit("story ids are not a list")),
        ),
    )
    errors = errors_of(lists.where("problem is not null"), "stories", F.col("problem"))
    ids = (
        lists.where("problem is null")
        .select(
            "source", "source_rank", "story_feed", "max_items", "fetched_at", "body_id",
            F.posexplode(json_elements(F.col("json"))).alias("pos", "id"),
        )
        .where(F.col("pos") < F.col("max_items"))
        .withColumn("item_id", F.try_variant_get(F.col("id"), "$", "string"))
    )
    items = fetched.where(F.col("query").isNotNull() & status.isNull()).where(
        json_kind(F.col("json")) == "OBJECT"
    )
    # An item that landed more than once counts as it was fetched last.
    stamp = F.struct("fetched_at", "body_id")
    last = items.groupBy("source", "query").agg(F.max(stamp).alias("stamp"))
    items = items.withColumn("stamp", stamp).join(last, ["source", "query", "stamp"], "left_semi")
    items = items.select("source", F.col("query").alias("item_id"), F.col("json").alias("item"))

    item = F.col("item")
    rows = ids.join(items, ["source", "item_id"])
    kind = json_text(item, "$.type")
    title, url = json_text(item, "$.title"), json_text(item, "$.url")
    keep = ~is_true(item, "$.deleted") & ~is_true(item, "$.dead") & (kind == "story")
    raw = pinned(
        rows.where(keep),
        "source",
        title=strip(title),
        url=strip(url),
        source_id=F.try_variant_get(item, "$.id", "string"),
        author=strip(json_text(item, "$.by")),
        published_at=epoch_timestamp(F.try_variant_get(item, "$.time", "string")),
        description=strip(json_text(item, "$.text")),
        content=F.lit(None).cast("string"),
        metadata=metadata_of(
            story_feed=F.col("story_feed"),
            type=F.lit("story"),
            score=F.try_variant_get(item, "$.score", "string"),
            descendants=F.try_variant_get(item, "$.descendants", "bigint"),
        ),
        ord=order_of(0, F.col("pos")),
    )
    good = lists.where("problem is null").select("source")
    return Scan(raw.where(~is_blank(F.col("title")) & ~is_blank(F.col("url"))), errors, good)
