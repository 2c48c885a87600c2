"""Repository search results (SRC-12..14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsgrist.functions.pinned import pinned
from newsgrist.functions.text import is_blank, strip
from newsgrist.functions.times import parse_iso
from newsgrist.sources.contract import (
    Scan, errors_of, http_error, metadata_of, order_of, payloads_of,
)
from newsgrist.sources.stories import json_elements, json_kind, json_text

_FALSY = ["", "0", "0.0", "false", "[]", "{}"]


def _falsy(item: Column, path: str) -> Column:
    value = F.try_variant_get(item, path, "string")
    return value.isNull() | value.isin(_FALSY)


def scan_repos(payloads: DataFrame, sources: DataFrame) -> Scan:
    """One payload per search query. A failed query loses only its own results; the source
    fails (an error with a null query) if none of its configured queries has a usable
    payload although one has landed. Queries that are not configured are left out."""
    fetched = payloads_of("repos", payloads, sources).where(~is_blank(F.col("query")))
    wanted = F.transform("queries", strip)
    fetched = fetched.withColumn("query", strip(F.col("query")))
    fetched = pinned(fetched, "*", json=F.try_parse_json(F.col("body")))
    fetched = fetched.withColumn("query_rank", F.array_position(wanted, F.col("query"))).where("query_rank > 0")
    found = F.try_variant_get(F.col("json"), "$.items", "variant")
    problem = F.coalesce(
        http_error(F.col("http_status"), F.col("body")),
        F.when(F.col("json").isNull(), F.lit("invalid JSON")),
        F.when(
            found.isNull() | (json_kind(found) != "ARRAY"), F.lit("response has no list of items")
        ),
    )
    searched = fetched.withColumns({"problem": problem, "items": found}).drop("body", "json")

    failed = searched.where("problem is not null")
    by_query = errors_of(failed, "repos", F.col("problem"), F.col("query"))
    per_source = searched.groupBy("source").agg(
        F.every(F.col("problem").isNotNull()).alias("lost"),
        F.max_by("problem", "query_rank").alias("last"),
    )
    lost = errors_of(
        per_source.where("lost"), "repos", F.concat(F.lit("all queries failed: "), F.col("last"))
    )

    rows = (
        searched.where("problem is null")
        .select(
            "source", "source_rank", "max_items", "query", "query_rank", "fetched_at", "body_id",
            F.posexplode(json_elements(F.col("items"))).alias("pos", "repo"),
        )
        .where((F.col("pos") < F.col("max_items")) & (json_kind(F.col("repo")) == "OBJECT"))
    )
    repo = F.col("repo")

    def plain(path: str, kind: str = "string") -> Column:
        return F.try_variant_get(repo, path, kind)

    name = F.coalesce(
        json_text(repo, "$.full_name"), F.when(_falsy(repo, "$.full_name"), json_text(repo, "$.name"))
    )
    raw = pinned(
        rows.where(plain("$.id").isNotNull()),
        "source",
        title=strip(name),
        url=strip(json_text(repo, "$.html_url")),
        source_id=plain("$.id"),
        author=strip(json_text(repo, "$.owner.login")),
        published_at=parse_iso(json_text(repo, "$.created_at")),
        description=strip(json_text(repo, "$.description")),
        content=F.lit(None).cast("string"),
        metadata=metadata_of(
            query=F.col("query"),
            stars=plain("$.stargazers_count"),
            forks=plain("$.forks_count", "bigint"),
            language=plain("$.language"),
            topics=F.coalesce(
                plain("$.topics", "array<string>"), F.array().cast("array<string>")
            ),
            created_at=plain("$.created_at"),
            updated_at=plain("$.updated_at"),
            pushed_at=plain("$.pushed_at"),
        ),
        ord=order_of(F.col("query_rank"), F.col("pos")),
    )
    good = searched.where("problem is null").select("source")
    return Scan(
        raw.where(~is_blank(F.col("title")) & ~is_blank(F.col("url"))), by_query.unionByName(lost), good
    )
