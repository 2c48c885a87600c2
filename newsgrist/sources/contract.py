"""The source contract and the union over kinds (SRC-1, SRC-8, SRC-16, SET-1).

A scan maps (payloads, sources) to raw records and errors. Payloads are landed response
bodies; sources say which are enabled, in what order, and how many items each may give.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from newsgrist.functions.skew import with_settings
from newsgrist.schema import ERROR_SCHEMA, METADATA, RAW_COLUMNS, RAW_SCHEMA

_META_FIELDS = [f.split(":", 1) for f in METADATA[len("struct<"):-1].split(",")]


class Scan(NamedTuple):
    raw: DataFrame
    errors: DataFrame
    good: DataFrame | None = None  # (source): those with a usable payload


class SourceFailure(Exception):
    """A source failed in strict mode."""


SCANNERS: dict[str, Callable[[DataFrame, DataFrame], Scan]] = {}


def register(kind: str, scan: Callable[[DataFrame, DataFrame], Scan]) -> None:
    """SRC-1: add a source kind. Its scan returns RAW_SCHEMA records and errors."""
    SCANNERS[kind] = scan


def metadata_of(**fields: Column) -> Column:
    """The metadata struct with the given fields, the others null."""
    return F.struct(
        *[
            fields.get(name, F.lit(None)).cast(kind).alias(name)
            for name, kind in _META_FIELDS
        ]
    )


def order_of(query_rank: Column | int, pos: Column) -> Column:
    rank = F.lit(query_rank) if isinstance(query_rank, int) else query_rank
    return F.struct(
        F.col("source_rank"), rank.cast("int").alias("query_rank"), F.col("fetched_at"),
        F.col("body_id"), pos.cast("bigint").alias("pos"),
    )


def payloads_of(kind: str, payloads: DataFrame, sources: DataFrame) -> DataFrame:
    """SRC-16: payloads of the enabled sources of one kind, with the source's settings.

    ``sources`` is the configured list, a row per source.
    """
    settings = sources.where(F.col("enabled") & (F.col("kind") == kind)).select(
        F.col("name").alias("source"), "source_rank", "max_items", "categories", "story_feed",
        "queries",
    )
    landed = payloads.where(F.col("kind") == kind).withColumn("body_id", F.xxhash64("query", "body"))
    return with_settings(landed, settings, "source", F.col("body_id"))


def http_error(status: Column, body: Column) -> Column:
    """A message for a fetch that gave no status, one outside 2xx or no body, else null."""
    return (
        F.when(status.isNull(), F.lit("no response"))
        .when(~status.between(200, 299), F.concat(F.lit("HTTP status "), status.cast("string")))
        .when(body.isNull(), F.lit("no body"))
    )


def errors_of(failed: DataFrame, kind: str, message: Column, query: Column | None = None) -> DataFrame:
    return failed.select(
        "source",
        F.lit(kind).alias("kind"),
        (F.lit(None) if query is None else query).cast("string").alias("query"),
        message.alias("message"),
    )


def scan_all(payloads: DataFrame, sources: DataFrame, *, strict: bool = False) -> Scan:
    """SRC-8: union over all kinds. Failed sources are reported and left out; ``strict``
    raises instead."""
    spark = payloads.sparkSession
    raw = spark.createDataFrame([], RAW_SCHEMA)
    errors = spark.createDataFrame([], ERROR_SCHEMA)
    good = spark.createDataFrame([], "source string")
    for scan in SCANNERS.values():
        part = scan(payloads, sources)
        raw = raw.unionByName(part.raw.select(*RAW_COLUMNS))
        errors = errors.unionByName(part.errors)
        # A kind that does not tell has worked where there are records.
        good = good.unionByName((part.raw if part.good is None else part.good).select("source"))
    if strict:
        first = errors.limit(1).collect()
        if first:
            raise SourceFailure(f"{first[0].source}: {first[0].message}")
    return Scan(raw, errors, good)
